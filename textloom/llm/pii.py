"""Personal information inside free text: find it, replace it by typed placeholders.

Method: bootstrapped contextual extraction.  One pass over the texts collects
candidate spans with their lexical patterns (words to the left and right, shape,
partner word).  A few seeds - known names, street words, and words that announce
a kind of number - label instances; Spark scores patterns by the instances they
share and instances by their patterns, for some rounds; patterns and words that
come out confident find the identifiers no seed knew.

Scores live in small aggregated tables (patterns, words); texts are read twice.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from textloom.llm.words import FUNCTION_WORDS
from textloom.session import checkpointed

KINDS = ("email", "phone", "id_number", "street_address", "name")
PLACEHOLDER = {kind: f"[{kind.upper()}]" for kind in KINDS}
#: Rounds of scoring, and the scores from which an instance counts as found and a word as a name.
ROUNDS, SURE, NAME_SURE = 3, 0.75, 0.4
#: A name word needs this many different partners that are names already.
MIN_PARTNERS = 2
#: Name words are broadcast in blocks of about this many of a role (about 30 bytes each).
LEXICON_ROWS = 1_000_000

# fixed values: seeds. Left contexts that announce a kind of number (the last kind is: not personal).
SEED_CONTEXTS = {
    "phone": r"\b(?:call|phone|tel|telephone|mobile|office|fax|reach me under|telefonisch erreichbar unter|telefon|handy|joindre le service au|téléphone|tél|teléfono(?: de guardia)?|telefone|telemóvel|telefoon|mobiel)\W*$",
    "id_number": r"\b(?:security (?:number|no)|passport(?: number| no)?(?: is)?|ssn|national insurance(?: number)?|tax (?:id|number)|identity (?:card|number)|ausweisnummer|steuer-?id|steuernummer|sozialversicherungsnummer|reisepass(?:nummer)?"
    r"|sécurité sociale|passeport|numéro fiscal|carte d'identité|dni|nie|nif|cif|pasaporte|seguridad social|contribuinte|cpf|cartão de cidadão|passaporte|bsn|burgerservicenummer|paspoort(?:nummer)?|rijksregisternummer)\W*$",
    "other": r"\b(?:build|version|epoch|ticket|range|isbn|issn|commit|touches|started|ended|id run|run id|order|invoice no|page|section|chapter|port|line|rows?|bytes|serial|model|part|sku|batch|issue|pull request|revision|release|seite|version|auftrag|bestellung|ligne|página|pedido|bladzijde|bestelling)\W*$",
}
_SEED_CONTEXT = {kind: re.compile(p, re.I) for kind, p in SEED_CONTEXTS.items()}
#: Words before a name that are not part of it.
ADDRESS_FORMS = frozenset(
    "herr herrn frau fräulein dr prof mr mrs ms miss sir madam madame monsieur mme mlle m señor señora sr sra don doña senhor senhora dona sr. sra. mevrouw meneer heer dhr mw applicant signed dear".split()
)
_STREET_EN = r"Street|St|Road|Rd|Lane|Ln|Avenue|Ave|Boulevard|Blvd|Row|Court|Ct|Drive|Dr|Square|Sq|Terrace|Place|Pl|Way|Close|Crescent|Gardens|Grove|Hill|Parkway|Mews|Walk|Alley|Quay|Loop"
_STREET_DE = r"[sS]tra(?:ß|ss)e|[sS]tr\.?|[gG]asse|[pP]latz|[aA]llee|[wW]eg|[rR]ing|[dD]amm|[uU]fer|[sS]teig|[pP]fad|[mM]arkt|[hH]of|[gG]raben|[sS]peicher|[bB]rücke|[cC]haussee|[tT]or"
_STREET_NL = r"straat|laan|gracht|plein|kade|singel|dijk|steeg|pad|weg|hof"
_STREET_FR = r"rue|avenue|av\.|boulevard|bd\.?|place|impasse|allée|allee|chemin|quai|cours|square|route|passage|sentier|ruelle|faubourg"
_STREET_ES = r"calle|c/|plaza|pza\.?|avenida|avda\.?|av\.|paseo|camino|carretera|ronda|travesía|callejón|glorieta|rambla"
_STREET_PT = r"rua|r\.|avenida|av\.|travessa|largo|praça|praca|estrada|alameda|calçada|beco|rotunda"
_CAP = r"[A-ZÀ-Þ][\w'’\-]*"
_PART = r"(?:d[eu]s?|del|de la|de los|de las|d'|da|do|das|dos|e|y|la|le|les|van|der?|den|l')"
#: A house number that may belong to an address, and what may stand after or before it.
_HOUSE = re.compile(r"(?<![\w.(+\-/=#:])\d{1,5}(?![\d)%\-/:=])")
_AFTER_HOUSE = (
    re.compile(rf"[A-Za-z]? (?:{_CAP} ){{1,4}}(?:{_STREET_EN})(?![\w-])\.?"),
    re.compile(rf"(?: ?(?:bis|ter|quater|[A-D])(?!\w))?,? (?i:{_STREET_FR})\b\.? (?:{_PART} ?)*{_CAP}(?: (?:{_PART} ?)*{_CAP})*"),
)
_BEFORE_HOUSE = (
    re.compile(rf"(?<![\w.])(?:(?:Am|An|Auf|Im|In|Zum|Zur|Unter|Hinter|Vor)(?: de[rnm])? )?(?:[A-ZÄÖÜ]\w+(?:er|en|e|es) )?(?:[A-ZÄÖÜ]\w*(?:-[A-ZÄÖÜ]\w*)*[ -]?)?(?:{_STREET_DE}) $"),
    re.compile(rf"(?<![\w.])(?i:{_STREET_ES}|{_STREET_PT})(?: {_PART})* {_CAP}(?: (?:{_PART} )*{_CAP})*,? (?:[nN][º°.o]+ ?)?$"),
    re.compile(rf"(?<![\w.])(?:{_CAP} )?[A-Z][\w'’\-]*(?:{_STREET_NL}) $"),
)
_FLAT = re.compile(r"(?<!\w)(?:Flat|Apt|Apartment|Unit|Suite|Floor)\.? \w{1,5},? $")
_LOOSE_BEFORE = re.compile(rf"(?<![\w.,])(?:{_CAP} ){{2,3}}$")
_LOOSE_AFTER = re.compile(rf" (?:{_CAP} ){{1,3}}{_CAP}")
_LETTER = re.compile(r" ?[a-z](?!\w)")
_ADDRESS_TAIL = re.compile(
    rf"(?:,? ?\(?(?:Apt|Flat|Suite|Unit)\.? \w{{1,4}}\)?)?(?:, \d{{1,2}}º ?\w)?(?:,? \((?:{_CAP} ?(?:{_PART} )*)+\)|,? (?:[A-Z]{{1,2}}-)?\d{{4,5}}(?: [A-Z]{{2}})? {_CAP}(?:[ -](?:{_PART} )*{_CAP})*| à {_CAP}(?:-\w+)*|, {_CAP}(?: {_CAP})?(?:, [A-Z]{{2}} \d{{4,5}})?(?=[.,;\n]|$))?"
)
_DOT, _AT = r"(?:\.|\s?\[dot\]\s?|\s?\(dot\)\s?)", r"(?:\s?[@＠]\s?|\s?\[at\]\s?|\s?\(at\)\s?)"
_BOX, _LABEL = r"(?<![\w.+'\-])[A-Za-z0-9_][\w.+'\-]*", r"[A-Za-z0-9\-]+"
_EMAIL = re.compile(rf"{_BOX}(?:{_DOT}[\w+'\-]+)*{_AT}{_LABEL}(?:{_DOT}{_LABEL})*{_DOT}[A-Za-z]{{2,24}}(?!\w)")
_SPELT_EMAIL = re.compile(rf"{_BOX}(?: (?:DOT|dot) [\w+'\-]+)* (?:AT|at) {_LABEL}(?:\.{_LABEL})*(?: (?:DOT|dot) {_LABEL})+(?!\w)")
_NUMBER = re.compile(r"\d(?:(?:[ .\-/]|\) ?| ?\()?\d|[A-Z]{1,2}(?=\d)| [A-Z] (?=\d))+")
_NINO = re.compile(r"(?<!\w)[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D](?!\w)")
_NAME_RUN = re.compile(rf"(?<![\w@.’'\-])([A-ZÀ-Þ][a-zß-ÿ][\w'’\-]*|D['’][A-ZÀ-Þ]\w+)[  ]+(?:[A-Z]\. )?(?=([A-ZÀ-Þ][a-zß-ÿ][\w'’\-]*|D['’][A-ZÀ-Þ]\w+))")
_FUNCTION = frozenset().union(*FUNCTION_WORDS.values())
_LAST_WORDS = re.compile(r"[^\W\d_]*\W*[^\W\d_]*\W*$")
_DIGITS = re.compile(r"\d+")
_CANDIDATE = "chunk_id string, family string, start int, stop int, kind string, shape string, left string, right string"


def shape_of(text: str) -> str:
    """Digits as 9 (a leading 0 stays), capitals as A, other signs as they are."""
    return re.sub(r"[A-Z]", "A", re.sub(r"(?<!^)\d|^[1-9]", "9", text))


def contexts(text: str, start: int, stop: int) -> tuple[str, str]:
    """The last two words before a span, and the first word after it, digits as 0."""
    before = text[max(0, start - 40) : start].rsplit("\n", 1)[-1]
    left = _LAST_WORDS.search(_DIGITS.sub("0", before.lower())).group()
    after = re.match(r"[^\w\n]*\w*", text[stop : stop + 24].lower()).group()
    return left[-30:], _DIGITS.sub("0", after)


def emails(text: str) -> list[tuple[int, int]]:
    found = []
    if " DOT " in text or " dot " in text:
        found += [m.span() for m in _SPELT_EMAIL.finditer(text)]
    if "@" in text or "＠" in text or "at]" in text or "at)" in text:
        for m in _EMAIL.finditer(text):
            start = m.start() + (7 if m.group()[:7].lower() == "mailto:" else 0)
            if not any(s < m.end() and start < e for s, e in found):
                found.append((start, m.end()))
    return found


def number_spans(text: str) -> list[tuple[int, int]]:
    found: list[tuple[int, int]] = []
    for m in _NUMBER.finditer(text):
        start, stop = m.span()
        if stop - start < 6 or sum(c.isdigit() for c in m.group()) < (5 if any(c.isalpha() for c in m.group()) else 6):
            continue
        insured = _NINO.match(text, max(0, start - 3)) or _NINO.match(text, max(0, start - 2))
        if insured:
            found.append(insured.span())
            continue
        while start and text[start - 1] in "+(" and start > m.start() - 2:
            start -= 1
        if start == m.start() and start and text[start - 1].isascii() and text[start - 1].isupper():
            start -= 1 + (start > 1 and text[start - 2].isupper() and text[start - 2].isascii())
        if start and (text[start - 1].isalnum() or text[start - 1] in "_@"):
            continue
        tail = re.match(r"-?[A-Z](?!\w)", text[stop : stop + 3])
        stop += tail.end() if tail else 0
        if stop < len(text) and (text[stop].isalnum() or text[stop] in "_@" or (text[stop] in "-:" and text[stop + 1 : stop + 2].isalnum())):
            continue
        found.append((start, stop))
    return found


def address_spans(text: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Spans with a street word, and looser spans of the same build."""
    sure: list[tuple[int, int]] = []
    loose: list[tuple[int, int]] = []
    for m in _HOUSE.finditer(text):
        start, stop = m.span()
        if sure and start < sure[-1][1]:
            continue
        before, after = text[max(0, start - 60) : start].rsplit("\n", 1)[-1], text[stop : stop + 70].split("\n", 1)[0]
        found = None
        if after[:1] in " ,abcdefghABCD" and after[1:4].strip():
            for pattern in _AFTER_HOUSE:
                match = pattern.match(after)
                if match:
                    flat = _FLAT.search(before)
                    found = (start - len(before) + flat.start() if flat else start, stop + match.end())
                    break
        if found is None and before[-1:] == " " and len(before) > 4:
            for pattern in _BEFORE_HOUSE:
                match = pattern.search(before)
                if match:
                    letter = _LETTER.match(text, stop)
                    found = (start - len(before) + match.start(), letter.end() if letter else stop)
                    break
        if found:
            tail = _ADDRESS_TAIL.match(text, found[1])
            sure.append((found[0], tail.end() if tail else found[1]))
        elif before[-1:] == " " and (match := _LOOSE_BEFORE.search(before)):
            loose.append((start - len(before) + match.start(), stop))
        elif match := _LOOSE_AFTER.match(after):
            loose.append((start, stop + match.end()))
    return sure, loose


def _seed_kind(left: str) -> str | None:
    for kind, pattern in _SEED_CONTEXT.items():
        if pattern.search(left):
            return kind
    return None


def candidates_of(chunk_id: str, text: str) -> Iterator[tuple]:
    taken = emails(text)
    for start, stop in taken:
        yield chunk_id, "email", start, stop, "email", "", "", ""
    digits = _DIGITS.search(text)
    addresses: list[tuple[int, int]] = []
    if digits:
        addresses, loose = address_spans(text)
        for known, spans in (("street_address", addresses), (None, loose)):
            for start, stop in spans:
                if not any(s < stop and start < e for s, e in taken):
                    left, right = contexts(text, start, stop)
                    yield chunk_id, "address", start, stop, known, "", left, right
        for start, stop in number_spans(text):
            if any(s < stop and start < e for s, e in taken) or any(s <= start < e for s, e in addresses):
                continue
            left, right = contexts(text, start, stop)
            yield chunk_id, "number", start, stop, _seed_kind(left), shape_of(text[start:stop]), left, right


def _candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in _CANDIDATE.split(", ")]
    for batch in batches:
        rows, pairs = [], Counter()
        for chunk_id, text in zip(batch["chunk_id"], batch["content"]):
            rows.extend(candidates_of(chunk_id, text))
            for m in _NAME_RUN.finditer(text):
                given, family = m.group(1).lower(), m.group(2).lower()
                if given not in _FUNCTION and family not in _FUNCTION:
                    left, _ = contexts(text, m.start(), m.start())
                    pairs[given, family, left] += 1
        rows.extend((None, "name", n, 0, None, given, left, family) for (given, family, left), n in pairs.items())
        yield pd.DataFrame(rows, columns=columns)


def candidates(chunks: DataFrame) -> DataFrame:
    """Candidate spans with their patterns; name candidates come aggregated (shape and right hold the two words)."""
    return chunks.where(F.col("content").isNotNull()).select("chunk_id", "content").mapInPandas(_candidates, _CANDIDATE)


def _shares(rows: DataFrame, node: str, kinds: tuple[str, ...]) -> DataFrame:
    """For each value of a pattern column, the smoothed share of every kind among the labelled instances it stands with."""
    sums = [F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(f"_{k}") for k in kinds]
    got = rows.groupBy(node).agg(*sums)
    total = sum(F.col(f"_{k}") for k in kinds)
    return got.select(node, *[((F.col(f"_{k}") + 0.1) / (total + 0.1 * len(kinds))).alias(f"{node}_{k}") for k in kinds])


def scored_patterns(cand: DataFrame, family: str, kinds: tuple[str, ...], nodes: tuple[str, ...], rounds: int = ROUNDS) -> DataFrame:
    """The pattern triples of a family with the kind they stand for and its probability.

    Seeds label triples; each round shares of kinds flow from labelled triples to
    their patterns and back to all triples that have one of them.
    """
    spark = cand.sparkSession
    triples = cand.where(F.col("family") == family).groupBy("shape", "left", "right", F.col("kind").alias("seed")).agg(F.count("*").alias("n"))
    # a pattern that is very frequent counts by the number of its contexts rather than its rows
    triples = checkpointed(spark, triples.withColumn("n", F.log1p("n")))
    state = triples.withColumn("kind", F.col("seed")).withColumn("p", F.when(F.col("seed").isNotNull(), F.lit(1.0)))
    for _ in range(rounds):
        labelled = state.where((F.col("p") >= SURE) & F.col("kind").isNotNull())
        state = triples
        for node in nodes:
            state = state.join(_shares(labelled, node, kinds), node, "left")
        likely = {k: F.lit(1.0) for k in kinds}
        for node in nodes:
            for k in kinds:
                likely[k] = likely[k] * F.coalesce(F.col(f"{node}_{k}"), F.lit(1.0 / len(kinds)))
        total = sum(likely.values(), F.lit(0.0))
        best = F.greatest(*likely.values()) if len(kinds) > 1 else likely[kinds[0]]
        kind = F.coalesce(*[F.when(likely[k] == best, F.lit(k)) for k in kinds])
        state = state.select(
            "shape", "left", "right", "seed", "n",
            F.coalesce("seed", kind).alias("kind"), F.when(F.col("seed").isNotNull(), F.lit(1.0)).otherwise(best / total).alias("p"),
        )
        state = checkpointed(spark, state)
    return state


def name_words(cand: DataFrame, names: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(word, role) of given and family names, the known ones and those found.

    A word gets the share of its partners in the other role that are names already,
    raised by the contexts it stands in; known names are certain.
    """
    spark = cand.sparkSession
    pairs = cand.where("family = 'name'").select(F.col("shape").alias("given"), F.col("right").alias("family"), "left")
    pairs = checkpointed(spark, pairs.where(~F.col("given").isin(*ADDRESS_FORMS)).distinct())
    known = names.where("name_text is not null").select(F.lower(F.trim("name_text")).alias("word"), F.when(F.col("name_kind") == "given", "given").otherwise("family").alias("role")).distinct()
    words = known.withColumn("score", F.lit(1.0))
    both = pairs.select("given", "family").distinct()
    for _ in range(rounds):
        given = words.where("role = 'given'").select(F.col("word").alias("given"), F.col("score").alias("given_score"))
        family = words.where("role = 'family'").select(F.col("word").alias("family"), F.col("score").alias("family_score"))
        rated = both.join(given, "given", "left").join(family, "family", "left").na.fill(0.0, ["given_score", "family_score"])
        # left contexts: the share of their pairs that hold two names
        strong = F.when((F.col("given_score") >= NAME_SURE) & (F.col("family_score") >= NAME_SURE), 1.0).otherwise(0.0)
        in_context = pairs.join(rated, ["given", "family"]).withColumn("is_name", strong)
        context = in_context.groupBy("left").agg((F.sum("is_name") / (F.count("*") + 2)).alias("context_score"))
        with_context = in_context.join(context, "left").groupBy("given", "family", "given_score", "family_score").agg(F.max("context_score").alias("context_score"))
        up = lambda role, other: with_context.groupBy(F.col(role).alias("word")).agg(
            F.sum(F.when(F.col(f"{other}_score") >= NAME_SURE, 1).otherwise(0)).alias("partners"),
            (F.sum(F.when(F.col(f"{other}_score") >= NAME_SURE, F.greatest(F.col(f"{other}_score"), "context_score")).otherwise(0.0)) / (F.count("*") + 0.5)).alias("score"),
        ).withColumn("role", F.lit(role))
        grown = up("given", "family").unionByName(up("family", "given")).where((F.col("score") >= NAME_SURE) & (F.col("partners") >= MIN_PARTNERS))
        words = grown.select("word", "role", "score").unionByName(known.withColumn("score", F.lit(1.0))).groupBy("word", "role").agg(F.max("score").alias("score"))
        words = checkpointed(spark, words)
    # a hyphenated given name is the pair of its parts, known or not by itself
    return words.select("word", "role")


class NameFinder:
    """Finds names by their words: given before family, initials, family before given after a comma, in any case."""

    def __init__(self, given: set[str], family: set[str]):
        import ahocorasick

        self.given, self.family = given, family
        self.machine = ahocorasick.Automaton()
        for word in family:
            self.machine.add_word(word, len(word))
        if family:
            self.machine.make_automaton()

    _BEFORE = re.compile(r"(?<!\w)(?:(?P<first>[^\W\d_][\w'’]*(?:-[^\W\d_][\w'’]*)?)(?P<mid>(?:[  ]+[^\W\d_]\.)*)[  ]+|(?P<initial>[^\W\d_]\.(?:[  ]?[^\W\d_]\.)*)[  ]+)$")
    _AFTER = re.compile(r",[  ]+(?:(?P<first>[^\W\d_][\w'’]*(?:-[^\W\d_][\w'’]*)?)(?![\w@])(?:[  ]+[^\W\d_]\.)?|(?P<initial>[^\W\d_]\.))")

    def _is_given(self, word: str) -> bool:
        word = word.lower()
        return word in self.given or ("-" in word and any(part in self.given for part in word.split("-")))

    def spans(self, text: str) -> list[tuple[int, int]]:
        if not self.family:
            return []
        low = text.lower()
        if len(low) != len(text):
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        found: list[tuple[int, int]] = []
        for at, size in self.machine.iter(low):
            stop = at + 1
            start = stop - size
            before, after = text[start - 1 : start], text[stop : stop + 2]
            if before and (before.isalnum() or before in "_.@+-'’＠") or after and (after[0].isalnum() or after[0] in "_@+-＠" or (after[0] == "." and after[1:].isalnum())):
                continue
            m = self._BEFORE.search(text, max(0, start - 48), start)
            begin = None
            if m and m.group("initial") and (m.group("initial")[0].isupper()) and (not m.start() or not text[m.start() - 1].isalnum()):
                begin = m.start()
                lead = self._BEFORE.search(text, max(0, begin - 40), begin)
                if lead and lead.group("first") and self._is_given(lead.group("first")):
                    begin = lead.start("first")
            elif m and m.group("first") and m.group("mid") and not self._is_given(m.group("first")):
                begin = m.start("mid") + len(m.group("mid")) - len(m.group("mid").lstrip())
            elif m and m.group("first") and self._is_given(m.group("first")) and (not m.start() or text[m.start() - 1] not in "_.@+-＠"):
                begin = m.start("first")
                lead = self._BEFORE.search(text, max(0, begin - 40), begin)
                if lead and lead.group("first") and not lead.group("mid") and self._is_given(lead.group("first")) and lead.end() == begin:
                    begin = lead.start("first")
            end = stop
            if begin is None:
                a = self._AFTER.match(text, stop)
                if a and (a.group("initial") or self._is_given(a.group("first"))):
                    begin, end = start, a.end()
                elif m and m.group("first") and m.group("first").lower() in ADDRESS_FORMS and text[start].isupper():
                    begin = start
            if begin is not None and not (found and begin < found[-1][1]):
                found.append((begin, end))
        return found


def find_pii(chunks: DataFrame, names: DataFrame) -> DataFrame:
    """(chunk_id, kind, start, stop) of each value found in content, positions in code points from 0.

    Null, empty and blank content has none.  Spans of one chunk do not overlap: a
    value inside an e-mail address or street address is part of it.  A chunk id
    that repeats gives its spans once for each different row, so callers that
    need one row for each span take distinct ones.
    """
    spark = chunks.sparkSession
    cand = checkpointed(spark, candidates(chunks))
    fixed = cand.where("family = 'email' or (family = 'address' and kind is not null)").select("chunk_id", "kind", "start", "stop")
    numbers = scored_patterns(cand, "number", ("phone", "id_number", "other"), ("shape", "left", "right"))
    numbers = numbers.where(F.col("p") >= SURE).select("shape", "left", "right", F.col("kind").alias("found")).groupBy("shape", "left", "right").agg(F.max_by("found", F.lit(1)).alias("found"))
    numbered = cand.where("family = 'number'").join(numbers, ["shape", "left", "right"]).where("found <> 'other'").select("chunk_id", F.col("found").alias("kind"), "start", "stop")
    # an address without a street word counts where its left context nearly always holds one
    streets = cand.where("family = 'address' and length(left) > 3").groupBy("left").agg(F.avg(F.col("kind").isNotNull().cast("int")).alias("share"), F.count("*").alias("n"))
    loose = cand.where("family = 'address' and kind is null").join(streets.where("share >= 0.6 and n >= 5"), "left")
    loose = loose.select("chunk_id", F.lit("street_address").alias("kind"), "start", "stop")
    words = name_words(cand, names)
    return fixed.unionByName(numbered).unionByName(loose).unionByName(named_spans(chunks, words))


def named_spans(chunks: DataFrame, words: DataFrame) -> DataFrame:
    """(chunk_id, kind, start, stop) of the names made of the given words."""
    sizes = {r.role: r["count"] for r in words.groupBy("role").count().collect()}  # two rows
    blocks = {role: max(1, -(-sizes.get(role, 0) // LEXICON_ROWS)) for role in ("given", "family")}
    texts = chunks.where(F.col("content").isNotNull()).select("chunk_id", "content")
    found = None
    # a name needs one word of each role, so every block of given names meets every block of family names
    for g in range(blocks["given"]):
        for f in range(blocks["family"]):
            part = texts.mapInPandas(_finding(chunks.sparkSession, _block(words, "given", blocks, g), _block(words, "family", blocks, f)), "chunk_id string, kind string, start int, stop int")
            found = part if found is None else found.unionByName(part)
    return found


def _block(words: DataFrame, role: str, blocks: dict[str, int], at: int) -> set[str]:
    """One block of at most about LEXICON_ROWS words of a role."""
    mine = words.where((F.col("role") == role) & (F.pmod(F.xxhash64("word"), F.lit(blocks[role])) == at))
    return {r.word for r in mine.select("word").collect()}


def _finding(spark, given: set[str], family: set[str]):
    lexicon = spark.sparkContext.broadcast((given, family))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = NameFinder(*lexicon.value)
        for batch in batches:
            out = [(chunk_id, "name", start, stop) for chunk_id, text in zip(batch["chunk_id"], batch["content"]) for start, stop in finder.spans(text)]
            yield pd.DataFrame(out, columns=["chunk_id", "kind", "start", "stop"])

    return find


def placed(content: Column, spans: Column) -> Column:
    """A text with its spans (array of start, stop, kind, sorted, not overlapping) replaced by placeholders."""
    first = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, span: Column) -> Column:
        mark = F.concat(F.lit("["), F.upper(span["kind"]), F.lit("]"))
        out = F.concat(acc["out"], F.substring(content, acc["at"] + 1, span["start"] - acc["at"]), mark)
        return F.when(span["start"] >= acc["at"], F.struct(out.alias("out"), span["stop"].alias("at"))).otherwise(acc)

    return F.aggregate(spans, first, step, lambda acc: F.concat(acc["out"], F.substring(content, acc["at"] + 1, F.length(content))))


def redact(chunks: DataFrame, names: DataFrame) -> DataFrame:
    """``chunks`` with content redacted and contains_pii set right; null content stays null with contains_pii false."""
    # rows are told apart by id and content, so an id that is null or comes with two contents is safe
    key = F.concat_ws("|", F.coalesce("chunk_id", F.lit("")), F.xxhash64("content").cast("string"), F.length("content").cast("string"))
    keyed = chunks.withColumn("_key", key)
    found = find_pii(keyed.select(F.col("_key").alias("chunk_id"), "content").distinct(), names).distinct()
    spans = found.groupBy(F.col("chunk_id").alias("_key")).agg(F.array_sort(F.collect_list(F.struct("start", "stop", "kind"))).alias("_spans"))
    joined = keyed.join(spans, "_key", "left").drop("_key")
    content = F.when(F.col("_spans").isNull() | F.col("content").isNull(), F.col("content")).otherwise(placed(F.col("content"), F.col("_spans")))
    return joined.withColumn("content", content).withColumn("contains_pii", F.col("_spans").isNotNull()).drop("_spans")
