"""Context and conversation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from textloom.functions import text as fx
from textloom.operators import best, context, ranking
from textloom.plans import search, sql
from textloom.sources.tables import table


def _ranked(spark: SparkSession, sf: str, k: int, questions) -> DataFrame:
    """The k best documents of each question, with what they hold; only listed documents meet their text."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "title", "source")
    return best.with_documents(best.best(docs, questions(spark, sf), k), docs).withColumn("size", F.length("text"))


def context_budget(spark, sf, questions=search._queries):
    kept = context.within_budget(_ranked(spark, sf, 10, questions))
    return kept.select("qid", "doc_id", F.col("rank").cast("bigint").alias("rank"), "upto")


def rag_sources(spark, sf, questions=search._queries):
    found = context.sources(_ranked(spark, sf, 5, questions))
    return found.select("qid", F.col("rank").cast("bigint").alias("rank"), "doc_id", "title", F.md5("preview").alias("preview"), F.round("score", 6).alias("score"))


def rag_prompt(spark, sf, questions=search._queries):
    found = context.rag_prompt(_ranked(spark, sf, 3, questions), questions(spark, sf))
    return found.select("qid", F.length("prompt").cast("bigint").alias("chars"), F.md5("prompt").alias("digest"))


def rag_confidence(spark, sf, questions=search._queries):
    """Confidence of an answer that quotes the first sentence of the best document."""
    quoted = _ranked(spark, sf, 5, questions).select("qid", "rank", "score", F.substring("text", 1, 100).alias("text"))
    ranked = quoted.withColumn("part", ranking.by_top(F.col("score")))
    got = ranked.groupBy("qid").agg(F.avg("part").alias("mean_score"), F.count("*").alias("n"), F.max(F.when(F.col("rank") == 1, F.size(fx.pieces(F.col("text"))))).alias("words"))
    return got.select("qid", F.round(context.answer_confidence(F.col("mean_score"), F.col("n"), F.col("words")), 6).alias("confidence"))


def hybrid_mode_union(spark, sf, questions=search._queries):
    """Two documents and one code element for each question, tagged by where they come from."""
    asked = questions(spark, sf)
    docs = ranking.top_k(ranking.bm25(table(spark, sf, "documents").select("doc_id", "text"), asked), 2).withColumn("tab", F.lit("documents"))
    elements = table(spark, sf, "code_elements").select(F.col("element_id").alias("doc_id"), F.concat_ws(" ", "name", "docstring").alias("text"))
    code = ranking.top_k(ranking.bm25(elements, asked), 1).withColumn("tab", F.lit("code_elements"))
    both = docs.unionByName(code)
    return both.select("qid", "tab", F.col("doc_id").alias("id"), F.col("rank").cast("bigint").alias("rank"), F.round("score", 6).alias("score"))


def _turns(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", "text", "received_at")


def conv_dedup(spark, sf):
    return context.delivered_once(_turns(spark, sf)).select("conv_id", "turn", "role", "text")


def conv_recent_turns(spark, sf):
    return context.recent_turns(context.delivered_once(_turns(spark, sf)), 3).select("conv_id", "turn", F.col("back").cast("bigint").alias("back"), "text")


def conv_history(spark, sf):
    """Turns kept in the history: changed ones, the last twenty of each conversation."""
    kept = context.recent_turns(context.changed_turns(context.delivered_once(_turns(spark, sf))), 20)
    return kept.groupBy("conv_id").agg(F.count("*").alias("kept"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"))


def conv_prompt(spark, sf):
    found = context.conversation_prompt(context.delivered_once(_turns(spark, sf)))
    return found.select("conv_id", F.length("prompt").cast("bigint").alias("chars"), F.md5("prompt").alias("digest"))


def task_routing(spark, sf):
    questions = context.delivered_once(_turns(spark, sf)).where("lower(role) = 'user' and coalesce(text, '') <> ''")
    return context.routed(questions).select("conv_id", "turn", "agents", "main", F.round("complexity", 6).alias("complexity"))


def turn_gap(spark, sf):
    """Turns, roles and lateness of each conversation."""
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "created_at", "received_at")
    late = F.unix_micros(F.col("received_at").cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))
    return turns.groupBy("conv_id").agg(F.count("*").alias("rows"), F.countDistinct("turn").alias("turns"), F.max(late).alias("latest_us"))


_ONCE = "o AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id, turn ORDER BY received_at ASC NULLS LAST, coalesce(text, '')) AS nth FROM conversations QUALIFY nth = 1)"
_RANKED = f"WITH {search._BASE}, b AS ({search._top('bm', 10)}), r AS (SELECT b.*, t.text, t.title, t.source, length(t.text) AS size FROM b JOIN documents t USING (doc_id))"


def _any(x: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


_HITS = {agent: _any("lower(text)", words) for agent, words in context.AGENT_WORDS.items()}
_AGENTS = "[a for a in [" + ", ".join(f"CASE WHEN {h} THEN '{a}' END" for a, h in _HITS.items()) + "] if a IS NOT NULL]"

QUERIES = {f.__name__: f for f in (context_budget, rag_sources, rag_prompt, rag_confidence, hybrid_mode_union, conv_dedup, conv_recent_turns, conv_history, conv_prompt, task_routing, turn_gap)}

SQL = {
    "context_budget": f"""{_RANKED}, u AS (SELECT qid, doc_id, rank, CAST(sum(size) OVER (PARTITION BY qid ORDER BY rank) AS BIGINT) AS upto FROM r)
        SELECT qid, doc_id, rank, upto FROM u WHERE upto <= 8000 OR rank = 1""",
    "rag_sources": f"""{_RANKED} SELECT qid, rank, doc_id, coalesce(nullif(title, ''), nullif(source, ''), 'Document ' || doc_id) AS title,
        md5(CASE WHEN length(text) > 250 THEN substr(text, 1, 250) || '...' ELSE text END) AS preview, round(score, 6) AS score FROM r WHERE rank <= 5""",
    "rag_prompt": f"""{_RANKED}, p AS (SELECT qid, string_agg('[' || rank || '] ' || coalesce(title, 'untitled') || chr(10) || substr(text, 1, 1500), chr(10) || chr(10) ORDER BY rank) AS ctx FROM r WHERE rank <= 3 GROUP BY qid),
        z AS (SELECT q.qid, 'Context:' || chr(10) || coalesce(ctx, 'none') || chr(10) || chr(10) || 'Question: ' || q.text AS prompt FROM q LEFT JOIN p USING (qid))
        SELECT qid, length(prompt) AS chars, md5(prompt) AS digest FROM z""",
    "rag_confidence": f"""{_RANKED}, t AS (SELECT *, score / nullif(max(score) OVER (PARTITION BY qid), 0) AS part FROM r WHERE rank <= 5),
        g AS (SELECT qid, avg(part) AS m, count(*) AS n, max(CASE WHEN rank = 1 THEN len({sql.pieces('substr(text, 1, 100)')}) END) AS w FROM t GROUP BY qid)
        SELECT qid, round(0.4::DOUBLE * least(1.0::DOUBLE, greatest(0.0::DOUBLE, m)) + 0.3::DOUBLE * least(1.0::DOUBLE, n / 5.0::DOUBLE) + 0.2::DOUBLE * (CASE WHEN w < 5 THEN 0.2 WHEN w < 20 THEN 0.6 ELSE 1.0 END)::DOUBLE + 0.1::DOUBLE, 6) AS confidence FROM g""",
    "hybrid_mode_union": f"""WITH {search._BASE}, cd AS (SELECT element_id AS doc_id, tokens, len(tokens) AS dl FROM (SELECT element_id, {sql.words("concat_ws(' ', name, docstring)")} AS tokens FROM code_elements) WHERE len(tokens) > 0),
        cn AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM cd),
        ctf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, dl, unnest(tokens) AS term FROM cd) WHERE term IN (SELECT term FROM qt) GROUP BY doc_id, dl, term),
        cdf AS (SELECT term, count(*) AS df FROM ctf GROUP BY term),
        cbm AS (SELECT qid, doc_id, sum(qtf * ln((n_docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM ctf JOIN cdf USING (term) JOIN qt USING (term) CROSS JOIN cn GROUP BY qid, doc_id),
        a AS ({search._top('bm', 2)}), c AS ({search._top('cbm', 1)})
        SELECT qid, 'documents' AS tab, doc_id AS id, rank, round(score, 6) AS score FROM a UNION ALL SELECT qid, 'code_elements', doc_id, rank, round(score, 6) FROM c""",
    "conv_dedup": f"WITH {_ONCE} SELECT conv_id, turn, role, text FROM o",
    "conv_recent_turns": f"WITH {_ONCE} SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back, text FROM o QUALIFY back <= 3",
    "conv_history": f"""WITH {_ONCE}, c AS (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM o),
        k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM c WHERE before IS NULL OR text IS NULL OR before <> text QUALIFY back <= 20)
        SELECT conv_id, count(*) AS kept, min(turn) AS first_turn, max(turn) AS last_turn FROM k GROUP BY conv_id""",
    "conv_prompt": f"""WITH {_ONCE}, k AS (SELECT conv_id, turn, CASE WHEN lower(trim(role)) = 'bot' THEN 'assistant' WHEN lower(trim(role)) IN ('user', 'assistant', 'system') THEN lower(trim(role)) END AS r, text FROM o),
        p AS (SELECT conv_id, string_agg('<|' || r || '|> ' || text, chr(10) ORDER BY turn) || chr(10) || '<|assistant|>' AS prompt FROM k WHERE r IS NOT NULL AND coalesce(text, '') <> '' GROUP BY conv_id)
        SELECT conv_id, length(prompt) AS chars, md5(prompt) AS digest FROM p""",
    "task_routing": rf"""WITH {_ONCE}, q AS (SELECT conv_id, turn, text, {_AGENTS} AS agents, len([w for w in string_split_regex(lower(text), '\s+') if w <> '']) AS n FROM o WHERE lower(role) = 'user' AND coalesce(text, '') <> '')
        SELECT conv_id, turn, coalesce(array_to_string(agents, ','), '') AS agents, coalesce(agents[1], 'rag') AS main,
          round(least(1.0::DOUBLE, 0.3::DOUBLE + (CASE WHEN n > 20 THEN 0.3 WHEN n > 10 THEN 0.15 ELSE 0.0 END)::DOUBLE + 0.2::DOUBLE * (CASE WHEN len(agents) > 1 THEN 1 ELSE 0 END) + 0.1::DOUBLE * (CASE WHEN contains(text, '?') THEN 1 ELSE 0 END)), 6) AS complexity FROM q""",
    "turn_gap": "SELECT conv_id, count(*) AS rows, count(DISTINCT turn) AS turns, max(epoch_us(received_at) - epoch_us(created_at)) AS latest_us FROM conversations GROUP BY conv_id",
}
