"""Text expressions.  All are built-in functions, so they stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Frequent words for the four-language detector.
DETECT_WORDS = {
    "en": ["the", "and", "of", "to", "in", "is", "that", "for", "with", "are", "this", "from", "by", "at"],
    "de": ["der", "die", "das", "und", "ist", "nicht", "ein", "eine", "den", "mit", "auf", "für", "von", "dem"],
    "fr": ["le", "la", "les", "et", "des", "est", "une", "dans", "pour", "que", "sur", "du", "au", "avec"],
    "es": ["el", "los", "las", "una", "que", "por", "con", "para", "del", "es", "se", "en", "al", "como"],
}

# fixed values: patterns of the plain detector, in the order they are replaced
PII_PATTERNS = {
    "email": r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}",
    "phone": r"\+?[0-9][0-9 ().\-]{6,}[0-9]",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "card": r"[0-9]{4}[ \-]?[0-9]{4}[ \-]?[0-9]{4}[ \-]?[0-9]{4}",
    "ip": r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}",
}
REDACTED = "[REDACTED]"


def stripped(text: Column) -> Column:
    """Without white space at both ends, line ends included."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def pieces(text: Column) -> Column:
    """Split at white space; blank text gives an empty array, null gives null."""
    return F.filter(F.split(stripped(text), r"\s+"), lambda w: w != "")


def words(text: Column) -> Column:
    """Lower-case words of at least two characters: runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, at least 1; null counts as empty."""
    return F.greatest(F.lit(1), F.floor(F.coalesce(F.length(text), F.lit(0)) / 4)).cast("bigint")


def syllables(word: Column) -> Column:
    """Vowel groups of a word, less a final e, at least 1."""
    low = F.lower(word)
    return F.greatest(F.lit(1), F.regexp_count(low, F.lit("[aeiouy]+")) - F.endswith(low, F.lit("e")).cast("int"))


def sentence_pieces(text: Column) -> Column:
    """Number of pieces between full stops, question and exclamation marks; a trailing mark adds one."""
    return F.size(F.split(text, r"[.!?]+"))


def readability(text: Column) -> Column:
    """Flesch reading ease between 0 and 100; 0 for text without words."""
    all_words = pieces(text)
    n = F.size(all_words)
    beats = F.aggregate(all_words, F.lit(0), lambda acc, w: acc + syllables(w))
    ease = 206.835 - 1.015 * n / sentence_pieces(text) - 84.6 * beats / n
    return F.when(n == 0, F.lit(0.0)).otherwise(F.least(F.lit(100.0), F.greatest(F.lit(0.0), ease)))


def pii_counts(text: Column) -> dict[str, Column]:
    """Matches of each kind in the text as it stands."""
    return {kind: F.regexp_count(text, F.lit(p)) for kind, p in PII_PATTERNS.items()}


def has_pii(text: Column) -> Column:
    found = F.lit(False)
    for p in PII_PATTERNS.values():
        found = found | F.coalesce(text.rlike(p), F.lit(False))
    return found


def redacted(text: Column) -> Column:
    """Each kind replaced in turn; what an earlier kind took is not seen by a later one."""
    for p in PII_PATTERNS.values():
        text = F.regexp_replace(text, p, r"\[REDACTED\]")
    return text


def detected_language(text: Column) -> Column:
    """Language with the largest share of its frequent words among the first 100; ``unknown`` for short text or a share of 0.1 or less.

    Ties go to en, de, fr, es in this order.  One fold over the words counts for
    all languages, so the words are made once.
    """
    first = F.slice(F.filter(F.split(F.lower(stripped(text)), r"\s+"), lambda w: w != ""), 1, 100)
    none = F.struct(F.lit(0).alias("n"), *[F.lit(0).alias(code) for code in DETECT_WORDS])

    def count(acc: Column, w: Column) -> Column:
        hits = [(acc[code] + w.isin(*known).cast("int")).alias(code) for code, known in DETECT_WORDS.items()]
        return F.struct((acc["n"] + 1).alias("n"), *hits)

    def best(acc: Column) -> Column:
        top = F.greatest(*[acc[code] for code in DETECT_WORDS])
        return F.when(top * 10 > acc["n"], F.coalesce(*[F.when(acc[code] == top, F.lit(code)) for code in DETECT_WORDS])).otherwise(F.lit("unknown"))

    return F.when(F.length(stripped(text)) >= 10, F.aggregate(first, none, count, best)).otherwise(F.lit("unknown"))


def piece_count(text: Column) -> Column:
    """Number of pieces between white space, without a lambda, so the plan computes it once however often it is used."""
    bare = stripped(text)
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, r"\s+")))


def quality_score(text: Column, pii: Column, language: Column) -> Column:
    """1.0, lowered for short texts, few words, many signs and personal data, raised for long and known ones; at most 1."""
    n = piece_count(text)
    signs = F.length(F.regexp_replace(text, r"[\p{L}\p{N}\s]+", "")) / F.length(text)
    score = (
        F.when(F.length(text) < 50, 0.5).otherwise(1.0)
        * F.when(n < 10, 0.6).when(n > 100, 1.1).otherwise(1.0)
        * F.when(signs > 0.3, 0.7).otherwise(1.0)
        * F.when(pii, 0.8).otherwise(1.0)
        * F.when(language != "unknown", 1.1).otherwise(1.0)
    )
    return F.least(F.lit(1.0), score)


def clipped(text: Column, n: int, mark: str = "...") -> Column:
    """The first ``n`` characters, with a mark if there were more."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit(mark))).otherwise(text)
