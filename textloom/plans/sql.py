"""Pieces shared by the SQL twins (DuckDB dialect)."""


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def pieces(x: str) -> str:
    return rf"[w for w in string_split_regex({strip(x)}, '\s+') if w <> '']"


def words(x: str) -> str:
    inner = rf"regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}_\s]+', ' ', 'g')"
    return rf"[w for w in string_split_regex({strip(inner)}, '\s+') if length(w) > 1]"
