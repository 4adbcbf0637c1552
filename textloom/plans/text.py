"""Text queries over documents and their chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from textloom.functions import text as fx
from textloom.functions.once import computed_once
from textloom.operators import chunking, knn, text
from textloom.plans import search, sql
from textloom.session import spread
from textloom.sources.tables import table


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents").select("doc_id", "text", "source", "lang", "user_id", "namespace"))


def _given(spark, sf):
    return _docs(spark, sf).where("text is not null")


def token_stats(spark, sf):
    rows = _given(spark, sf).select(F.coalesce("source", F.lit("?")).alias("source"), F.size(fx.words(F.col("text"))).alias("n"))
    return rows.groupBy("source").agg(F.count("*").alias("docs"), F.sum("n").alias("words"), F.max("n").cast("bigint").alias("longest"), F.round(F.avg("n"), 4).alias("mean_words"))


def token_estimate(spark, sf):
    return _docs(spark, sf).groupBy(F.coalesce("source", F.lit("?")).alias("source")).agg(F.sum(fx.token_estimate(F.col("text"))).alias("tokens"))


def key_phrases(spark, sf):
    found = text.key_phrases(_docs(spark, sf))
    return found.select("doc_id", F.col("n").cast("bigint").alias("n"), "phrase", "uses", F.col("rank").cast("bigint").alias("rank"))


def readability(spark, sf):
    return _given(spark, sf).select("doc_id", F.round(fx.readability(F.col("text")), 4).alias("ease"))


def entities(spark, sf):
    found = text.entities(F.col("text"))
    return _given(spark, sf).select("doc_id", *[F.to_json(c).alias(name) if name == "capitalised" else F.size(c).cast("bigint").alias(name) for name, c in found.items()])


def pii_detect(spark, sf):
    return _given(spark, sf).select("doc_id", *[c.cast("bigint").alias(kind) for kind, c in fx.pii_counts(F.col("text")).items()])


def pii_redact(spark, sf):
    return _given(spark, sf).select("doc_id", F.md5(fx.redacted(F.col("text"))).alias("digest"), fx.has_pii(F.col("text")).alias("contains_pii"))


def pii_by_source(spark, sf):
    flagged = _given(spark, sf).select(F.coalesce("source", F.lit("?")).alias("source"), fx.has_pii(F.col("text")).cast("int").alias("p"))
    return flagged.groupBy("source").agg(F.count("*").alias("docs"), F.sum("p").alias("with_pii"))


def lang_detect(spark, sf):
    return _given(spark, sf).select("doc_id", fx.detected_language(F.col("text")).alias("language"))


def lang_confusion(spark, sf):
    pairs = _given(spark, sf).select(F.coalesce(F.lower("lang"), F.lit("?")).alias("label"), fx.detected_language(F.col("text")).alias("language"))
    return pairs.groupBy("label", "language").agg(F.count("*").alias("docs"))


def _scored(spark, sf):
    docs = _given(spark, sf).where("text <> ''").select("doc_id", "text")
    seen = computed_once(docs, pii=fx.has_pii(F.col("text")), clean=fx.redacted(F.col("text")))
    known = computed_once(seen.drop("text"), language=fx.detected_language(F.col("clean")))
    return computed_once(known, quality=fx.quality_score(F.col("clean"), F.col("pii"), F.col("language"))).select("doc_id", "quality")


def quality_score(spark, sf):
    return _scored(spark, sf).select("doc_id", F.round("quality", 6).alias("quality"))


def quality_filter(spark, sf):
    return _scored(spark, sf).where(F.round("quality", 9) >= 0.7).select("doc_id")


def quality_vs_labels(spark, sf):
    labels = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label")).where("label is not null")
    return _scored(spark, sf).join(labels, "doc_id").groupBy("label").agg(F.count("*").alias("docs"), F.round(F.avg("quality"), 6).alias("mean_quality"))


def chunk_sentences(spark, sf):
    rows = chunking.chunked(_docs(spark, sf).select("doc_id", "text"))
    return rows.select("doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), F.length("content").cast("bigint").alias("chars"), F.md5("content").alias("digest"))


def chunk_windows(spark, sf):
    rows = _docs(spark, sf).select("doc_id", F.posexplode(chunking.windows(F.col("text"))).alias("chunk_index", "w"))
    return rows.select("doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), F.col("w.start_char").cast("bigint").alias("start_char"), F.md5("w.content").alias("digest"))


def chunk_stats(spark, sf):
    rows = chunking.chunked(_docs(spark, sf).select("doc_id", "text"))
    sizes = rows.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.max(F.length("content")).alias("longest"))
    return sizes.groupBy("chunks").agg(F.count("*").alias("docs"), F.max("longest").cast("bigint").alias("longest"))


def ingest_pipeline(spark, sf):
    rows = text.ingested(_docs(spark, sf).select("doc_id", "text"))
    return rows.select("doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), F.col("chars").cast("bigint").alias("chars"), F.col("words").cast("bigint").alias("words"), "contains_pii", "language", F.round("quality", 6).alias("quality"))


def document_statistics(spark, sf):
    """Chunks, documents, mean quality and languages of each user, from the latest upload of each chunk."""
    chunks = table(spark, sf, "document_chunks").select("chunk_id", "document_id", "user_id", "quality_score", "content", "ingested_at")
    latest = Window.partitionBy("document_id", "chunk_id").orderBy(F.col("ingested_at").desc_nulls_last())
    kept = chunks.withColumn("nth", F.row_number().over(latest)).where("nth = 1")
    return kept.groupBy("user_id").agg(
        F.count("*").alias("chunks"), F.countDistinct("document_id").alias("documents"), F.round(F.avg("quality_score"), 6).alias("mean_quality"), F.sum(F.length("content")).alias("chars")
    )


def file_types(spark, sf):
    rows = table(spark, sf, "processing_results").select(text.file_type(F.col("filename"), F.col("file_type")).alias("kind"), "total_chunks", F.size("errors").alias("e"))
    return rows.groupBy("kind").agg(F.count("*").alias("files"), F.sum("total_chunks").alias("chunks"), F.sum((F.col("e") > 0).cast("int")).alias("failed"))


def chunk_fetch(spark, sf):
    """Chunks of every fiftieth document in order."""
    chunks = table(spark, sf, "document_chunks").select("document_id", "chunk_index", "chunk_id", F.length("content").alias("chars"))
    wanted = table(spark, sf, "processing_results").where(F.substring("document_id", 5, 20).cast("bigint") % 50 == 0).select("document_id")
    return chunks.join(wanted, "document_id", "left_semi").select("document_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), "chunk_id", F.col("chars").cast("bigint").alias("chars"))


def hash_embed_search(spark, sf, questions=search._queries):
    """Titles of every fiftieth document against all documents, by hashed word vectors."""
    docs = _docs(spark, sf)
    rows = text.hash_vectors(docs.select(F.col("doc_id").alias("vec_id"), "text"), "vec_id")
    found = knn.knn(rows, text.hash_vectors(questions(spark, sf), "qid"), 5)
    return found.select("qid", F.col("vec_id").alias("doc_id"), F.col("rank").cast("bigint").alias("rank"), F.round("score", 6).alias("score"))


_GIVEN = "SELECT doc_id, text, source, lang FROM documents WHERE text IS NOT NULL"
_SYL = "greatest(1, len(regexp_extract_all(lower(w), '[aeiouy]+')) - CASE WHEN ends_with(lower(w), 'e') THEN 1 ELSE 0 END)"


def _pii_any(x: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({x}, '{p}')" for p in fx.PII_PATTERNS.values()) + ")"


def _redacted(x: str) -> str:
    for p in fx.PII_PATTERNS.values():
        x = f"regexp_replace({x}, '{p}', '[REDACTED]', 'g')"
    return x


def _language(x: str) -> str:
    first = rf"list_slice([w for w in string_split_regex(lower({sql.strip(x)}), '\s+') if w <> ''], 1, 100)"
    hit = {c: f"len([w for w in {first} if w IN ({', '.join(repr(k) for k in known)})])" for c, known in fx.DETECT_WORDS.items()}
    best = f"greatest({', '.join(hit.values())})"
    cases = " ".join(f"WHEN {h} = {best} THEN '{c}'" for c, h in hit.items())
    return f"CASE WHEN length({sql.strip(x)}) >= 10 AND {best} * 10 > len({first}) THEN CASE {cases} END ELSE 'unknown' END"


def _quality(x: str, pii: str, language: str) -> str:
    n = f"len({sql.pieces(x)})"
    signs = rf"CAST(length(regexp_replace({x}, '[\p{{L}}\p{{N}}\s]', '', 'g')) AS DOUBLE) / length({x})"
    return f"""least(1.0, (CASE WHEN length({x}) < 50 THEN 0.5 ELSE 1.0 END) * (CASE WHEN {n} < 10 THEN 0.6 WHEN {n} > 100 THEN 1.1 ELSE 1.0 END)
      * (CASE WHEN {signs} > 0.3 THEN 0.7 ELSE 1.0 END) * (CASE WHEN {pii} THEN 0.8 ELSE 1.0 END) * (CASE WHEN {language} <> 'unknown' THEN 1.1 ELSE 1.0 END))::DOUBLE"""


_SCORED = f"""s AS (SELECT doc_id, {_quality('clean', 'pii', 'language')} AS quality FROM (SELECT doc_id, pii, clean, {_language('clean')} AS language
  FROM (SELECT doc_id, {_pii_any('text')} AS pii, {_redacted('text')} AS clean FROM documents WHERE text IS NOT NULL AND text <> '')))"""

# a fold over a list of strings: the chunks so far, parted by character 1, are the accumulator
_CHUNKS = rf"""c AS (SELECT doc_id, unnest(chunks) AS content, unnest(range(len(chunks))) AS chunk_index FROM (
  SELECT doc_id, string_split(list_reduce(parts, lambda a, s: CASE WHEN length(split_part(a, chr(1), -1)) + 1 + length(s) <= 512 THEN a || ' ' || s ELSE a || chr(1) || s END), chr(1)) AS chunks
  FROM (SELECT doc_id, CASE WHEN length(text) <= 10000
      THEN [s for s in string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(2), 'g'), chr(2)) if s <> '']
      ELSE [s for s in string_split_regex(text, '\n+') if trim(s) <> ''] END AS parts
    FROM documents WHERE text IS NOT NULL AND regexp_replace(text, '\s+', '', 'g') <> '')))"""


def _phrase(n: int) -> str:
    gram = " || ' ' || ".join(f"w[i + {j}]" for j in range(1, n + 1))
    return f"""SELECT doc_id, phrase, count(*) AS uses, min(pos) AS first, {n} AS n FROM (
      SELECT doc_id, unnest(list_transform(range(len(w) - {n - 1}), lambda i: {gram})) AS phrase, unnest(range(len(w) - {n - 1})) AS pos FROM t WHERE len(w) >= {n}) GROUP BY doc_id, phrase"""


_HASH = f"""list_transform(range({text.EMBED_DIM}), lambda b: CAST(len([x for x in buckets if x = b]) AS DOUBLE))"""
_BUCKETS = f"[CAST(('0x' || substr(md5(w), 1, 8)) AS BIGINT) % {text.EMBED_DIM} for w in {sql.words('text')}]"

QUERIES = {f.__name__: f for f in (token_stats, token_estimate, key_phrases, readability, entities, pii_detect, pii_redact, pii_by_source, lang_detect, lang_confusion, quality_score, quality_filter, quality_vs_labels, chunk_sentences, chunk_windows, chunk_stats, ingest_pipeline, document_statistics, file_types, chunk_fetch, hash_embed_search)}

SQL = {
    "token_stats": f"""SELECT coalesce(source, '?') AS source, count(*) AS docs, CAST(sum(n) AS BIGINT) AS words, max(n) AS longest, round(avg(n), 4) AS mean_words
        FROM (SELECT source, len({sql.words('text')}) AS n FROM ({_GIVEN})) GROUP BY 1""",
    "token_estimate": "SELECT coalesce(source, '?') AS source, CAST(sum(greatest(1, coalesce(length(text), 0) // 4)) AS BIGINT) AS tokens FROM documents GROUP BY 1",
    "key_phrases": f"""WITH t AS (SELECT doc_id, {sql.words('text')} AS w FROM ({_GIVEN})), g AS ({_phrase(2)} UNION ALL {_phrase(3)}),
        r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, n ORDER BY uses DESC, first) AS rank FROM g QUALIFY rank <= 5)
        SELECT doc_id, CAST(n AS BIGINT) AS n, phrase, uses, rank FROM r""",
    "readability": rf"""WITH t AS (SELECT doc_id, {sql.pieces('text')} AS w, len(string_split_regex(text, '[.!?]+')) AS s FROM ({_GIVEN}))
        SELECT doc_id, round(CASE WHEN len(w) = 0 THEN 0.0 ELSE least(100.0, greatest(0.0, 206.835 - 1.015 * CAST(len(w) AS DOUBLE) / s - 84.6 * CAST(list_sum([{_SYL} for w in w]) AS DOUBLE) / len(w))) END, 4) AS ease FROM t""",
    "entities": rf"""SELECT doc_id, CAST(len(regexp_extract_all(text, '{text.ENTITY_PATTERNS['dates']}')) AS BIGINT) AS dates, CAST(least(20, len(regexp_extract_all(text, '{text.ENTITY_PATTERNS['numbers']}'))) AS BIGINT) AS numbers,
        CAST(len(regexp_extract_all(text, '{text.ENTITY_PATTERNS['urls']}')) AS BIGINT) AS urls, CAST(len(regexp_extract_all(text, '{text.ENTITY_PATTERNS['emails']}')) AS BIGINT) AS emails,
        CAST(to_json(list_slice(list_sort(list_distinct(regexp_extract_all(text, '{text.ENTITY_PATTERNS['capitalised']}'))), 1, 30)) AS VARCHAR) AS capitalised FROM ({_GIVEN})""",
    "pii_detect": "SELECT doc_id, " + ", ".join(f"CAST(len(regexp_extract_all(text, '{p}')) AS BIGINT) AS {k}" for k, p in fx.PII_PATTERNS.items()) + f" FROM ({_GIVEN})",
    "pii_redact": f"SELECT doc_id, md5({_redacted('text')}) AS digest, {_pii_any('text')} AS contains_pii FROM ({_GIVEN})",
    "pii_by_source": f"SELECT coalesce(source, '?') AS source, count(*) AS docs, count(*) FILTER ({_pii_any('text')}) AS with_pii FROM ({_GIVEN}) GROUP BY 1",
    "lang_detect": f"SELECT doc_id, {_language('text')} AS language FROM ({_GIVEN})",
    "lang_confusion": f"SELECT label, language, count(*) AS docs FROM (SELECT coalesce(lower(lang), '?') AS label, {_language('text')} AS language FROM ({_GIVEN})) GROUP BY 1, 2",
    "quality_score": f"WITH {_SCORED} SELECT doc_id, round(quality, 6) AS quality FROM s",
    "quality_filter": f"WITH {_SCORED} SELECT doc_id FROM s WHERE round(quality, 9) >= 0.7",
    "quality_vs_labels": f"WITH {_SCORED} SELECT l.quality AS label, count(*) AS docs, round(avg(s.quality), 6) AS mean_quality FROM s JOIN labels l USING (doc_id) WHERE l.quality IS NOT NULL GROUP BY 1",
    "chunk_sentences": f"WITH {_CHUNKS} SELECT doc_id, chunk_index, length(content) AS chars, md5(content) AS digest FROM c",
    "chunk_windows": """WITH w AS (SELECT doc_id, text, unnest(range(0, length(text), 1950)) AS start_char FROM documents WHERE length(text) > 0)
        SELECT doc_id, CAST(start_char / 1950 AS BIGINT) AS chunk_index, start_char, md5(substr(text, start_char + 1, 2000)) AS digest FROM w""",
    "chunk_stats": f"""WITH {_CHUNKS}, s AS (SELECT doc_id, count(*) AS chunks, max(length(content)) AS longest FROM c GROUP BY doc_id)
        SELECT chunks, count(*) AS docs, max(longest) AS longest FROM s GROUP BY chunks""",
    "ingest_pipeline": f"""WITH {_CHUNKS}, a AS (SELECT doc_id, chunk_index, length(content) AS chars, len({sql.pieces('content')}) AS words, {_pii_any('content')} AS contains_pii, {_redacted('content')} AS clean FROM c),
        b AS (SELECT *, {_language('clean')} AS language FROM a), q AS (SELECT *, {_quality('clean', 'contains_pii', 'language')} AS quality FROM b)
        SELECT doc_id, chunk_index, chars, words, contains_pii, language, round(quality, 6) AS quality FROM q WHERE quality >= 0.7""",
    "document_statistics": """WITH k AS (SELECT *, row_number() OVER (PARTITION BY document_id, chunk_id ORDER BY ingested_at DESC NULLS LAST) AS nth FROM document_chunks QUALIFY nth = 1)
        SELECT user_id, count(*) AS chunks, count(DISTINCT document_id) AS documents, round(avg(quality_score), 6) AS mean_quality, CAST(sum(length(content)) AS BIGINT) AS chars FROM k GROUP BY user_id""",
    "file_types": rf"""WITH t AS (SELECT lower(regexp_extract(filename, '\.([A-Za-z0-9]+)$', 1)) AS ext, lower(regexp_replace(trim(file_type), '^\.', '')) AS given, total_chunks, len(errors) AS e FROM processing_results)
        SELECT CASE WHEN ext IN {text.FILE_TYPES} THEN ext WHEN given IN {text.FILE_TYPES} THEN given ELSE 'txt' END AS kind, count(*) AS files, CAST(sum(total_chunks) AS BIGINT) AS chunks, count(*) FILTER (e > 0) AS failed FROM t GROUP BY 1""",
    "chunk_fetch": """SELECT document_id, CAST(chunk_index AS BIGINT) AS chunk_index, chunk_id, length(content) AS chars FROM document_chunks
        WHERE document_id IN (SELECT document_id FROM processing_results WHERE CAST(substr(document_id, 5) AS BIGINT) % 50 = 0)""",
    "hash_embed_search": f"""WITH q AS (SELECT min(doc_id) AS qid, title AS text FROM documents WHERE doc_id % 50 = 0 AND title IS NOT NULL GROUP BY title),
        v AS (SELECT doc_id, {_HASH} AS v FROM (SELECT doc_id, {_BUCKETS} AS buckets FROM documents WHERE text IS NOT NULL) WHERE len(buckets) > 0),
        a AS (SELECT qid, {_HASH} AS v FROM (SELECT qid, {_BUCKETS} AS buckets FROM q) WHERE len(buckets) > 0),
        s AS (SELECT qid, doc_id, round(list_cosine_similarity(a.v, v.v), 9) AS score FROM a, v),
        r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 5)
        SELECT qid, doc_id, rank, round(score, 6) AS score FROM r""",
}
