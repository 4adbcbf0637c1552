"""Language of each document and of each segment in another language, with a confidence.

Method: a linear-chain conditional random field over the words of a text.  Affix,
character n-gram and lexicon features score each word for each language, learned
transitions tie neighbours together, and forward-backward gives every word its
marginal probabilities.  Letters weighted by them decide lines and documents.

A word is what stands between white space; signs inside part it for its features,
and what has no letter is no word.

Training: Spark draws a bounded sample of labelled rows (``SAMPLE_PER_LANGUAGE`` of
each language, the first ``SAMPLE_WORDS`` words of those whose label agrees with at
least three of their function words), shards fit a model each, and the parameters
are averaged.  Applying it covers every row and every word.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from textloom.llm.main_body import BAD, line_labels
from textloom.llm.words import FUNCTION_WORDS, LANGUAGES

BUCKETS = 1 << 14
#: Bounds of the training sample: rows of each language, and words of each row.
SAMPLE_PER_LANGUAGE, SAMPLE_WORDS = 500, 400
#: A training sequence runs through the field in parts of this many words.
FIT_WORDS = 64
SHARDS = 4
STEPS = 30
#: Fewer letters of natural language than this give no language to a row, and to a line none of its own.
MIN_LETTERS = 40
#: A line has a language of its own only if the field is at least this sure of it.
MIN_SURE = 0.55
#: A sequence longer than this many words runs through the field in parts of this many; no word is left out.
MAX_WORDS = 1500
#: Words of one block of padded sequences.
BLOCK_WORDS = 200_000

K = len(LANGUAGES)
_WORDS = re.compile(r"[^\W\d_]+")
_ADDRESS = re.compile(r"\S*[@＠]\s?\S+|\S+@\s?\S*|\S+\s?(?:\[at\]|\(at\)| AT )\s?\S+(?:\s?(?:\[dot\]| DOT )\s?\S+)*|\w+://\S+")
_CODE = re.compile(r"^[^\w]*(?:[\w.]+\([^)]*[=,][^)]*\)|[\w.]+\s*=\s*\S+)\W*$")

#: Names of the languages in labels, in lower case without country.
LABELS = {
    "en": "en eng english englisch anglais inglés ingles inglês engels",
    "de": "de deu ger german deutsch allemand alemán aleman alemão duits",
    "fr": "fr fra fre french französisch franzosisch français francais francés frances francês frans",
    "es": "es spa spanish spanisch espagnol español espanol castellano espanhol spaans",
    "pt": "pt por portuguese portugiesisch portugais portugués portugues português portugees",
    "nl": "nl nld dut dutch niederländisch niederlandisch néerlandais neerlandais neerlandés neerlandes neerlandês holandés holandês nederlands",
}
_BY_LABEL = {name: code for code, names in LABELS.items() for name in names.split()}


def label_code(label: Column) -> Column:
    """Code of a language label in any spelling, with or without a country; null for null, blank and unknown ones."""
    name = F.lower(F.trim(label))
    bare = F.regexp_extract(name, r"^([\p{L}]+)(?:[-_ (].*)?$", 1)
    pairs = F.create_map(*[F.lit(x) for pair in _BY_LABEL.items() for x in pair])
    return F.coalesce(pairs[name], pairs[bare])


@lru_cache(maxsize=200_000)
def _features(token: str) -> tuple[int, ...]:
    """Buckets of the words in a token: each word, its affixes and n-grams, special letters, and the lexicons it stands in."""
    found: list[int] = []
    for word in _WORDS.findall(token.lower()):
        flat = word if word.isascii() else "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))
        framed = f"^{flat}$"
        names = [f"w{word}", f"v{flat}"]
        names += [f"p{flat[:n]}" for n in (1, 2, 3) if len(flat) > n] + [f"s{flat[-n:]}" for n in (1, 2, 3, 4) if len(flat) > n]
        names += [f"g{framed[i : i + 3]}" for i in range(len(framed) - 2)] + [f"b{framed[i : i + 2]}" for i in range(len(framed) - 1)]
        names += [f"c{c}" for c in sorted(set(word)) if not c.isascii()]
        found += [K + zlib.crc32(n.encode()) % (BUCKETS - K) for n in names]
        found += [i for i, code in enumerate(LANGUAGES) if word in FUNCTION_WORDS[code]]
    return tuple(found)


def _forward_backward(scores: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals (rows, words, labels), expected transitions, and log-likelihood normalisers of padded sequences."""
    n, steps, _ = scores.shape
    pot = np.exp(scores - scores.max(axis=2, keepdims=True))
    top = scores.max(axis=2)
    move = np.exp(trans)
    alpha, scale = np.empty_like(pot), np.ones((n, steps))
    a, ones = pot[:, 0], np.ones(K)
    for t in range(steps):
        if t:
            a = (a @ move) * pot[:, t]
        total = a @ ones
        live = t < lengths
        scale[:, t] = np.where(live, total, 1.0)
        a = a / total[:, None]
        alpha[:, t] = a
    beta = np.ones((n, K))
    marginals = np.empty_like(pot)
    pairs = np.zeros((K, K))
    for t in range(steps - 1, -1, -1):
        marginal = alpha[:, t] * beta
        marginals[:, t] = marginal / (marginal @ ones)[:, None]
        if t:
            live = (t < lengths)[:, None]
            weighted = np.where(live, pot[:, t] * beta, 0.0)
            back = weighted @ move.T
            norm = ((alpha[:, t - 1] * back) @ ones)[:, None]
            safe = np.where(norm > 0, norm, 1.0)
            pairs += move * ((alpha[:, t - 1] / safe).T @ weighted)
            beta = np.where(live, back / np.where(live, (back @ ones)[:, None], 1.0) * K, 1.0)
    mask = np.arange(steps)[None, :] < lengths[:, None]
    return marginals, pairs, (np.where(mask, np.log(scale) + top, 0.0)).sum(axis=1)


def _posteriors(pot: np.ndarray, lengths: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Marginals (rows, words, labels) of padded sequences of potentials."""
    return _swept(np.ascontiguousarray(pot.transpose(1, 0, 2)), lengths, move).transpose(1, 0, 2)


def _swept(pot: np.ndarray, lengths: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Marginals (words, rows, labels) of padded sequences of potentials in the same shape, without what only training needs.

    Sums are brought back to one every fourth word; potentials have 1 as their
    largest, so nothing leaves the range of a float in between.
    """
    steps = len(pot)
    back, ones = np.ascontiguousarray(move.T), np.ones((K, 1), pot.dtype)
    alpha = np.empty_like(pot)
    a = alpha[0] = pot[0]
    for t in range(1, steps):
        a = a @ move
        a *= pot[t]
        if t % 4 == 0:
            a /= a @ ones
        alpha[t] = a
    beta = np.ones_like(a)
    for t in range(steps - 1, 0, -1):
        alpha[t] *= beta
        turned = (pot[t] * beta) @ back
        if t % 4 == 0:
            turned /= turned @ ones
        live = t < lengths
        beta = turned if live.all() else np.where(live[:, None], turned, beta)
    alpha[0] *= beta
    alpha /= alpha @ ones
    return alpha


def fit(sequences: list[tuple[list[str], list[int]]], steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Weights (bucket, language) and transitions of a field fitted to (words, labels) by adaptive gradient steps."""
    weights, trans = np.zeros((BUCKETS, K)), np.zeros((K, K))
    weights[np.arange(K), np.arange(K)] = 1.0
    if not sequences:
        return weights, trans
    sequences = [(words[i : i + FIT_WORDS], labels[i : i + FIT_WORDS]) for words, labels in sequences for i in range(0, len(words), FIT_WORDS)]
    index: dict[str, int] = {}
    coded = [np.array([index.setdefault(w, len(index)) for w in words]) for words, _ in sequences]
    feats = [_features(w) for w in index]
    flat, of_type = np.concatenate([np.array(f) for f in feats]), np.repeat(np.arange(len(feats)), [len(f) for f in feats])
    lengths = np.array([len(c) for c in coded])
    width = int(lengths.max())
    ids, gold = np.zeros((len(coded), width), int), np.zeros((len(coded), width), int)
    for row, (code, (_, labels)) in enumerate(zip(coded, sequences)):
        ids[row, : len(code)], gold[row, : len(code)] = code, labels
    mask = np.arange(width)[None, :] < lengths[:, None]
    truth = np.eye(K)[gold[mask]]
    seen_pairs = np.zeros((K, K))
    both = mask[:, 1:]
    np.add.at(seen_pairs, (gold[:, :-1][both], gold[:, 1:][both]), 1.0)
    to_types, to_buckets = _summing(ids[mask], len(feats)), _summing(flat, BUCKETS)
    starts = np.r_[0, np.cumsum([len(f) for f in feats])[:-1]]
    grown_w, grown_t = np.full_like(weights, 1e-8), np.full_like(trans, 1e-8)
    for _ in range(steps):
        by_type = np.add.reduceat(weights[flat], starts, axis=0)
        marginals, pairs, _ = _forward_backward(by_type[ids], lengths, trans)
        type_error = to_types(truth - marginals[mask])
        step_w = to_buckets(type_error[of_type]) / len(coded) - 1e-4 * weights
        step_t = (seen_pairs - pairs) / len(coded) - 1e-4 * trans
        grown_w += step_w**2
        grown_t += step_t**2
        weights += 0.25 * step_w / np.sqrt(grown_w)
        trans += 0.25 * step_t / np.sqrt(grown_t)
    return weights, trans


def _summing(keys: np.ndarray, size: int):
    """A function that sums rows by their keys; sorting once makes each call a run over sorted rows."""
    order = np.argsort(keys, kind="stable")
    sorted_keys = keys[order]
    firsts = np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]])

    def sums(rows: np.ndarray) -> np.ndarray:
        out = np.zeros((size, rows.shape[1]))
        out[sorted_keys[firsts]] = np.add.reduceat(rows[order], firsts, axis=0)
        return out

    return sums


def _lexicon_votes(words: list[str]) -> np.ndarray:
    return np.array([sum(w in FUNCTION_WORDS[code] for w in words) for code in LANGUAGES])


def training_sequence(text: str, label: str) -> tuple[list[str], list[int]] | None:
    """Words of a row with a language each, if the row's label agrees with its function words.

    A line whose function words clearly speak for another language has that one.
    """
    own = LANGUAGES.index(label)
    tokens, labels = [], []
    total = np.zeros(K)
    for line in text.split("\n"):
        found = [t for t in line.split() if any(map(str.isalpha, t))]
        votes = _lexicon_votes(_WORDS.findall(line.lower()))
        total += votes
        ranked = np.sort(votes)
        clear = ranked[-1] >= 4 and ranked[-1] >= 2 * ranked[-2] + 1
        tokens += found
        labels += [int(votes.argmax()) if clear else own] * len(found)
    if len(tokens) < 8 or total.argmax() != own or total[own] < 3:
        return None
    return tokens[:SAMPLE_WORDS], labels[:SAMPLE_WORDS]


class _Vocabulary(dict):
    """Token to number; a token met for the first time gets its potentials and its number of letters, one without letters is 0."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights, self.pot, self.sizes, self.used = weights, np.ones((4096, K), "float32"), np.zeros(4096, "float32"), 1

    def __missing__(self, token: str) -> int:
        features = _features(token)
        if not features:
            self[token] = 0
            return 0
        i = self[token] = self.used
        self.used += 1
        if i >= len(self.sizes):
            self.pot, self.sizes = np.concatenate([self.pot, np.ones_like(self.pot)]), np.concatenate([self.sizes, np.zeros_like(self.sizes)])
        score = self.weights[list(features)].sum(axis=0)
        self.pot[i] = np.exp(np.maximum(score - score.max(), -60.0))
        self.sizes[i] = sum(map(str.isalpha, token))
        return i


def _prose(line: str) -> str:
    """A line without mailboxes and addresses of pages."""
    if "@" in line or "＠" in line or "at]" in line or "at)" in line or "://" in line or " DOT " in line:
        return _ADDRESS.sub(" ", line)
    return line


class Field:
    """A fitted field ready to label texts."""

    def __init__(self, weights: np.ndarray, trans: np.ndarray):
        self.weights, self.move = weights.astype("float32"), np.exp(trans).astype("float32")
        self.words = _Vocabulary(self.weights)

    def _marginals(self, ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Marginals of each word, the sequences given by start and length."""
        out = np.empty((len(ids), K), "float32")
        order = np.argsort(lengths, kind="stable")
        at = 0
        while at < len(order):
            # sequences of like length share a block of a bounded size
            part = order[at : at + max(1, BLOCK_WORDS // int(lengths[order[min(len(order), at + 1024) - 1]]))][:1024]
            size = lengths[part]
            span = np.arange(int(size.max()))
            where = starts[part][None, :] + np.minimum(span[:, None], size[None, :] - 1)
            live = span[:, None] < size[None, :]
            out[where[live]] = _swept(self.words.pot[ids[where]], size, self.move)[live]
            at += len(part)
        return out

    def label(self, texts: list[list[tuple[int, str]]]) -> list[tuple[str | None, float, list[tuple[int, str, float]]]]:
        """For each row of (line number, line): its language, confidence, and its lines in another language."""
        if len(self.words) > 400_000:
            self.words = _Vocabulary(self.weights)
        flat, numbers, owners, counts = [], [], [], []
        for row, lines in enumerate(texts):
            for line_no, line in lines:
                tokens = _prose(line).split()
                if tokens and not _CODE.match(line):
                    numbers.append(line_no)
                    owners.append(row)
                    counts.append(len(tokens))
                    flat += tokens
        out: list[tuple[str | None, float, list[tuple[int, str, float]]]] = [(None, 0.0, []) for _ in texts]
        ids = np.fromiter(map(self.words.__getitem__, flat), np.int64, len(flat))
        words = ids > 0
        if not words.any():
            return out
        line_of = np.repeat(np.arange(len(counts)), counts)[words]
        ids = ids[words]
        begin = np.flatnonzero(np.r_[True, line_of[1:] != line_of[:-1]])
        told = line_of[begin]
        owner, numbers = np.array(owners)[told], np.array(numbers)[told].tolist()
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        ends = np.r_[begin[first][1:], len(ids)]
        spans = [(s, min(MAX_WORDS, e - s)) for b, e in zip(begin[first], ends) for s in range(b, e, MAX_WORDS)]
        sizes = self.words.sizes[ids]
        mass = self._marginals(ids, np.array([s for s, _ in spans]), np.array([n for _, n in spans])) * sizes[:, None]
        by_line, line_size = np.add.reduceat(mass, begin, axis=0), np.add.reduceat(sizes, begin)
        best = by_line.argmax(axis=1)
        letters, likely = np.zeros((len(texts), K)), np.zeros((len(texts), K))
        np.add.at(letters, (owner, best), line_size)
        np.add.at(likely, owner, by_line)
        total, main = letters.sum(axis=1), letters.argmax(axis=1)
        for row in np.flatnonzero(total >= MIN_LETTERS):
            out[row] = (LANGUAGES[main[row]], float(likely[row, main[row]] / total[row]), [])
        sure = by_line[np.arange(len(best)), best] / line_size
        other = (best != main[owner]) & (line_size >= MIN_LETTERS) & (sure >= MIN_SURE) & (total[owner] >= MIN_LETTERS)
        for i in np.flatnonzero(other):
            out[owner[i]][2].append((numbers[i], LANGUAGES[best[i]], float(sure[i])))
        return out


def sample_rows(texts: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """(text, label) of at most about ``per_language`` labelled rows of each language: those of the smallest hashes of their ids.

    Only ids and labels are ranked, so no text is shuffled; rows of one id count
    as one and come together.
    """
    labelled = texts.where(F.col("text").isNotNull()).select("text", label_code(F.col("language")).alias("label"), F.xxhash64("rec_id").alias("mark")).where("label is not null")
    nth = F.row_number().over(Window.partitionBy("label").orderBy("mark"))
    # at most six rows
    most = {r.label: r.most for r in labelled.select("label", "mark").withColumn("nth", nth).where(F.col("nth") <= per_language).groupBy("label").agg(F.max("mark").alias("most")).collect()}
    drawn = F.lit(False)
    for label, mark in most.items():
        drawn = drawn | ((F.col("label") == label) & (F.col("mark") <= mark))
    return labelled.where(drawn).select("text", "label")


def train(texts: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, shards: int = SHARDS) -> tuple[np.ndarray, np.ndarray]:
    """Fit a field on each shard of the sample and average the parameters, weighted by words.

    Without labelled rows the function words alone decide.
    """

    def fit_shard(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sequences = [s for batch in batches for s in map(training_sequence, batch["text"], batch["label"]) if s]
        if sequences:
            weights, trans = fit(sequences)
            yield pd.DataFrame([(float(sum(len(w) for w, _ in sequences)), weights.astype("float32").tobytes(), trans.astype("float32").tobytes())], columns=["n", "w", "t"])

    fitted = sample_rows(texts, per_language).repartition(shards, F.xxhash64("text")).mapInPandas(fit_shard, "n double, w binary, t binary").collect()
    if not fitted:
        return fit([])
    share = np.array([r.n for r in fitted]) / sum(r.n for r in fitted)
    weights = sum(p * np.frombuffer(r.w, "float32").reshape(BUCKETS, K) for p, r in zip(share, fitted))
    trans = sum(p * np.frombuffer(r.t, "float32").reshape(K, K) for p, r in zip(share, fitted))
    return weights, trans


_JUDGED = "rec_id string, label string, lang string, confidence double, lines array<struct<line_no:int,lang:string,confidence:double>>"


def _field(model) -> Field:
    """The field of a broadcast model; a worker keeps it, with the words it has met, from task to task."""
    weights, trans = model.value
    key = hash((weights[::61].tobytes(), trans.tobytes()))
    if key not in _FIELDS:
        _FIELDS.clear()
        _FIELDS[key] = Field(weights, trans)
    return _FIELDS[key]


_FIELDS: dict[int, Field] = {}
_LINE = pa.struct([("line_no", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64())])


def _result(ids: pa.Array, labels: pa.Array, found: list) -> pa.RecordBatch:
    flat = [line for _, _, others in found for line in others]
    offsets = np.cumsum([0, *(len(others) for _, _, others in found)])
    values = pa.StructArray.from_arrays([pa.array([x[i] for x in flat], _LINE.field(i).type) for i in range(3)], fields=list(_LINE))
    lines = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
    return pa.RecordBatch.from_arrays([ids, labels, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), lines], names=["rec_id", "label", "lang", "confidence", "lines"])


def label_chunks(chunks: DataFrame, model) -> DataFrame:
    """(rec_id, label, lang, confidence, lines) for document_chunks; ``model`` is a broadcast of ``train``'s result."""
    rows = chunks.where(F.col("content").isNotNull()).select("chunk_id", "language", "content")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = _field(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                ids, labels, texts = batch.slice(at, 2000).columns
                yield _result(ids, labels, field.label([list(enumerate(text.split("\n"), 1)) for text in texts.to_pylist()]))

    return rows.mapInArrow(judge, _JUDGED)


def label_pages(pages: DataFrame, model) -> DataFrame:
    """The same for the main body of web_content, with or without html."""
    rows = pages.where(F.col("content").isNotNull()).select(F.col("web_id").cast("string").alias("web_id"), "language", "content", "raw_html", "title")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = _field(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                ids, labels, *texts = batch.slice(at, 1000).columns
                bodies = []
                for content, html, title in zip(*(t.to_pylist() for t in texts)):
                    judged = line_labels(content, html, title)
                    bodies.append([(i, line) for i, (line, label) in enumerate(zip(content.split("\n"), judged), 1) if label != BAD])
                yield _result(ids, labels, field.label(bodies))

    return rows.mapInArrow(judge, _JUDGED)


def labelled_texts(pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """(rec_id, text, language) of both tables, for training."""
    web = pages.select(F.col("web_id").cast("string").alias("rec_id"), F.col("content").alias("text"), "language")
    return web.unionByName(chunks.select(F.col("chunk_id").alias("rec_id"), F.col("content").alias("text"), "language"))


def identify(pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """(tab, rec_id, label, lang, confidence, lines) of every row of both tables that has content.

    Rows with fewer than 40 letters of natural language have a null language and
    no lines.  A tie goes to the language that comes first in ``LANGUAGES``.
    Repeated rows come out as often as they go in; empty tables give no rows.
    """
    spark = chunks.sparkSession
    model = spark.sparkContext.broadcast(train(labelled_texts(pages, chunks)))
    web = label_pages(pages, model).select(F.lit("web_content").alias("tab"), "*")
    return web.unionByName(label_chunks(chunks, model).select(F.lit("document_chunks").alias("tab"), "*"))


def mislabelled(judged: DataFrame) -> DataFrame:
    """(tab, rec_id, line_no, lang): rows without a right label as line 0, and lines in another language."""
    known = judged.where(F.col("lang").isNotNull())
    wrong = known.where(~F.coalesce(label_code(F.col("label")) == F.col("lang"), F.lit(False)))
    rows = wrong.select("tab", "rec_id", F.lit(0).alias("line_no"), "lang")
    lines = known.select("tab", "rec_id", F.explode("lines").alias("line")).select("tab", "rec_id", "line.line_no", "line.lang")
    return rows.unionByName(lines)
