"""Queries over replies, cited contexts, records of code, and vectors of chunks and elements."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import best, chunking, code, replies, store, text
from textloom.plans import search
from textloom.plans.text import _BUCKETS, _CHUNKS, _HASH
from textloom.sources.tables import table


def _listed(spark, sf, questions, k):
    docs = table(spark, sf, "documents").select("doc_id", "source", "title", "text")
    return best.with_documents(best.best(search._documents(spark, sf), questions(spark, sf), k), docs)


def pairwise_prompts(spark, sf, questions=search._queries):
    """Prompts for all pairs of the five best documents of each question."""
    first = _listed(spark, sf, questions, 5).select("qid", "doc_id", "rank", F.col("text").alias("body"))
    other = first.select("qid", F.col("doc_id").alias("other_id"), F.col("rank").alias("other_rank"), F.col("body").alias("other_body"))
    pairs = first.join(other, "qid").where("rank < other_rank").join(questions(spark, sf), "qid")
    return pairs.select("qid", "doc_id", "other_id", F.md5(replies.pairwise_prompt(F.col("text"), F.col("body"), F.col("other_body"))).alias("digest"))


def _replied(spark, sf, questions):
    """The thirty best documents of each question, and a reply for those with a label: its quality in words."""
    ranked = best.best(search._documents(spark, sf), questions(spark, sf), 30)
    told = search._prior(spark, sf).select("doc_id", F.concat(F.lit("Score: "), (F.col("prior") * 2).cast("int").cast("string")).alias("reply"))
    return ranked, ranked.select("qid", "doc_id").join(told, "doc_id")


def reply_rerank(spark, sf, questions=search._queries):
    return search._out(replies.mixed_with_replies(*_replied(spark, sf, questions)))


def reply_rerank_tops(spark, sf, questions=search._queries):
    return search._out(replies.mixed_over_tops(*_replied(spark, sf, questions)))


def cited_context(spark, sf, questions=search._queries):
    rows = replies.cited_context(_listed(spark, sf, questions, 5))
    return rows.select("qid", "cited", F.length("context").cast("bigint").alias("chars"), F.md5("context").alias("digest"))


def joint_confidence(spark, sf):
    """Quality of the chunks of each document as one confidence."""
    rows = replies.joint_confidence(table(spark, sf, "document_chunks"), "document_id", "quality_score")
    return rows.select("document_id", "answers", F.round("confidence", 6).alias("confidence"))


def prompt_format(spark, sf):
    rows = table(spark, sf, "conversations").where("text is not null")
    return rows.select("conv_id", "turn", "received_at", F.md5(replies.tagged_prompt(F.col("text"))).alias("digest"))


def element_records(spark, sf):
    rows = store.element_records(table(spark, sf, "code_elements"), table(spark, sf, "code_files"))
    return rows.select("element_id", "name", "code_md5", F.md5("markdown").alias("digest"))


def repository_records(spark, sf):
    rows = store.repository_records(table(spark, sf, "code_files"))
    return rows.select("repo", F.length("markdown").cast("bigint").alias("chars"), F.md5("markdown").alias("digest"))


def _shape(vectors):
    """What is compared of a vector: the places in use and the largest value."""
    return F.size(F.filter("vector", lambda x: x > 0)).cast("bigint").alias("used"), F.array_max("vector").alias("peak")


def chunk_vectors(spark, sf):
    """Chunks of all documents with their vectors, under the document's id and the chunk's number."""
    parts = chunking.chunked(search._documents(spark, sf).select("doc_id", "text"))
    keyed = parts.select(F.concat(F.col("doc_id").cast("string"), F.lit("_"), F.col("chunk_index").cast("string")).alias("chunk_id"), F.col("content").alias("text"))
    return text.hash_vectors(keyed, "chunk_id").select("chunk_id", *_shape("vector"))


def repository_vectors(spark, sf):
    """A vector for the record of each repository and for the text of each element, under the repository's namespace."""
    whole = store.repository_records(table(spark, sf, "code_files")).select(F.concat(F.lit("repository_"), "repo").alias("id"), F.col("markdown").alias("text"))
    elements = table(spark, sf, "code_elements")
    each = code.element_text(elements).select(F.concat(F.lit("element_"), F.col("element_id").cast("string")).alias("id"), "text")
    space = whole.select("id", F.expr("substr(id, 12)").alias("namespace")).unionByName(
        elements.select(F.concat(F.lit("element_"), F.col("element_id").cast("string")).alias("id"), code.repository(F.col("file_path")).alias("namespace"))
    )
    return text.hash_vectors(whole.unionByName(each), "id").join(space, "id").select("namespace", "id", *_shape("vector"))


QUERIES = {
    f.__name__: f
    for f in (pairwise_prompts, reply_rerank, reply_rerank_tops, cited_context, joint_confidence, prompt_format, element_records, repository_records, chunk_vectors, repository_vectors)
}

_NL = "chr(10)"


def _clip(x: str, n: int) -> str:
    return f"CASE WHEN length({x}) > {n} THEN substr({x}, 1, {n}) || '...' ELSE {x} END"


_REPLIED = f"""WITH {search._BASE}, r AS (SELECT x.*, 'Score: ' || CAST(CAST(prior * 2 AS INT) AS VARCHAR) AS reply, CASE WHEN prior IS NULL THEN 0.5::DOUBLE WHEN prior * 2 > 1 THEN prior * 2 / 10 ELSE prior * 2 END AS told
  FROM ({search._top('bm', 30)}) x LEFT JOIN prior USING (doc_id))"""
_RECORDS = f"""n AS (SELECT *, split_part(file_path, '/', 1) AS repo FROM code_files),
t AS (SELECT repo, count(*) AS files, sum(line_count) AS lines, avg(CASE WHEN documentation IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS documented FROM n GROUP BY repo),
l AS (SELECT repo, language, count(*) AS n FROM n WHERE language IS NOT NULL GROUP BY repo, language QUALIFY row_number() OVER (PARTITION BY repo ORDER BY count(*) DESC, language) <= 3),
k AS (SELECT repo, language, string_agg('- ' || file_path, {_NL} ORDER BY nth) AS keys FROM (SELECT repo, language, file_path, row_number() OVER (PARTITION BY repo, language ORDER BY coalesce(complexity_score, 0) DESC, line_count DESC NULLS LAST, file_path) AS nth FROM n) WHERE nth <= 2 GROUP BY ALL),
s AS (SELECT repo, string_agg('## ' || language || ' (' || n || ' files)' || {_NL} || keys, {_NL} || {_NL} ORDER BY n DESC, language) AS spoken FROM l JOIN k USING (repo, language) GROUP BY repo),
u AS (SELECT repo, array_to_string(list_slice(list_sort(list_distinct(flatten(list(imports)))), 1, 10), ', ') AS packages FROM n GROUP BY repo),
records AS (SELECT repo, concat_ws({_NL} || {_NL}, '# ' || repo, 'Files: ' || files || ', lines: ' || coalesce(lines, 0) || ', documented: ' || CAST(round(100 * documented) AS INT) || ' %', spoken, 'Packages: ' || nullif(packages, '')) AS markdown
  FROM t LEFT JOIN s USING (repo) LEFT JOIN u USING (repo))"""
_PEAK = "len([x for x in v if x > 0]) AS used, list_max(v) AS peak"

SQL = {
    "pairwise_prompts": f"""WITH {search._BASE}, r AS (SELECT x.qid, x.doc_id, x.rank, t.text AS body FROM ({search._top('bm', 5)}) x JOIN documents t USING (doc_id))
        SELECT a.qid, a.doc_id, b.doc_id AS other_id, md5('Which document answers the question better?' || {_NL} || 'Question: ' || q.text || {_NL} || 'Document A: ' || {_clip('a.body', 300)} || {_NL} || 'Document B: ' || {_clip('b.body', 300)} || {_NL} || 'Answer A or B:') AS digest
        FROM r a JOIN r b ON a.qid = b.qid AND a.rank < b.rank JOIN q ON a.qid = q.qid""",
    "reply_rerank": f"""{_REPLIED}, m AS (SELECT qid, doc_id, rank AS old, CASE WHEN rank > 20 THEN score ELSE 0.7 * told + 0.3 * score END AS score FROM r)
        SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY old > 20, CASE WHEN old <= 20 THEN round(score, 9) END DESC NULLS LAST, old) AS rank, round(score, 6) AS score FROM m""",
    "reply_rerank_tops": f"""{_REPLIED}, z AS (SELECT qid, doc_id, rank AS old, score, CASE WHEN rank <= 20 THEN told ELSE 0 END AS told FROM r),
        m AS (SELECT qid, doc_id, old, 0.7 * coalesce(told / nullif(max(told) OVER (PARTITION BY qid), 0), 0) + 0.3 * coalesce(score / nullif(max(score) OVER (PARTITION BY qid), 0), 0) AS score FROM z)
        SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, old) AS rank, round(score, 6) AS score FROM m""",
    "cited_context": f"""WITH {search._BASE}, r AS (SELECT x.qid, x.rank, '[Source ' || x.rank || ': ' || coalesce(t.source, 'unknown') || ' - ' || coalesce(t.title, 'untitled') || ']' AS head, coalesce(t.text, '') AS text, 6000 // count(*) OVER (PARTITION BY x.qid) AS share
          FROM ({search._top('bm', 5)}) x JOIN documents t USING (doc_id)),
        c AS (SELECT qid, rank, head || {_NL} || substr(text, 1, share) AS part, sum(length(head) + length(substr(text, 1, share))) OVER (PARTITION BY qid ORDER BY rank) AS upto FROM r),
        g AS (SELECT qid, count(*) AS cited, string_agg(part, {_NL} || '---' || {_NL} ORDER BY rank) AS context FROM c WHERE upto <= 6000 GROUP BY qid)
        SELECT qid, cited, length(context) AS chars, md5(context) AS digest FROM g""",
    "joint_confidence": "SELECT document_id, count(quality_score) AS answers, round(CASE WHEN count(quality_score) > 0 THEN least(1.0::DOUBLE, avg(quality_score) + least(0.2::DOUBLE, (count(quality_score) - 1) * 0.1::DOUBLE)) ELSE 0.0::DOUBLE END, 6) AS confidence FROM document_chunks GROUP BY document_id",
    "prompt_format": rf"""SELECT conv_id, turn, received_at, md5(CASE WHEN regexp_matches(text, '<\|(?:user|assistant|system)\|>') THEN text ELSE '<|user|> ' || text || {_NL} || '<|assistant|>' END) AS digest FROM conversations WHERE text IS NOT NULL""",
    "element_records": f"""SELECT element_id, regexp_replace(concat_ws('_', replace(file_path, '/', '_'), regexp_replace(lower(name), '[^a-z0-9_-]', '_', 'g'), lower(type)), '_+', '_', 'g') AS name, md5(e.content) AS code_md5,
        md5(concat_ws({_NL}, '# ' || type || ' `' || name || '`', 'File: ' || file_path || ' (' || coalesce(e.language, 'unknown') || ')', 'Lines: ' || start_line || '-' || end_line, 'Complexity: ' || complexity,
          CASE WHEN coalesce(trim(docstring), '') <> '' THEN {_NL} || docstring || {_NL} ELSE 'No documentation.' END, CASE WHEN len(parameters) > 0 THEN 'Parameters: ' || array_to_string(parameters, ', ') END, 'Returns: ' || return_type,
          '```' || {_NL} || e.content || {_NL} || '```', 'Its file has ' || f.line_count || ' lines and ' || len(coalesce(f.imports, [])) || ' imports.')) AS digest
        FROM code_elements e LEFT JOIN code_files f USING (file_path)""",
    "repository_records": f"WITH {_RECORDS} SELECT repo, length(markdown) AS chars, md5(markdown) AS digest FROM records",
    "chunk_vectors": f"""WITH {_CHUNKS}, x AS (SELECT doc_id || '_' || chunk_index AS chunk_id, content AS text FROM c), b AS (SELECT chunk_id, {_BUCKETS} AS buckets FROM x), y AS (SELECT chunk_id, {_HASH} AS v FROM b WHERE len(buckets) > 0) SELECT chunk_id, {_PEAK} FROM y""",
    "repository_vectors": f"""WITH {_RECORDS}, e AS (SELECT split_part(file_path, '/', 1) AS namespace, 'element_' || element_id AS id, concat_ws({_NL}, type, name, language, substr(docstring, 1, 250), array_to_string(parameters, ', '), return_type,
          substr(array_to_string(list_slice(string_split(content, {_NL}), 1, 5), {_NL}), 1, 500)) AS text FROM code_elements),
        x AS (SELECT * FROM e UNION ALL SELECT repo, 'repository_' || repo, markdown FROM records), b AS (SELECT namespace, id, {_BUCKETS} AS buckets FROM x), y AS (SELECT namespace, id, {_HASH} AS v FROM b WHERE len(buckets) > 0)
        SELECT namespace, id, {_PEAK} FROM y""",
}
