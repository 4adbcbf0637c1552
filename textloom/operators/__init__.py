"""Relational, ranking, vector, text, web, code and conversation operators."""
