"""Readers: tables of a scale-factor directory, files, and repositories."""
