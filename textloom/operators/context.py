"""Context assembly: budget, sources, prompts, confidence, conversations, routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from textloom.functions.text import clipped

BUDGET = 8000


def within_budget(ranked: DataFrame, budget: int = BUDGET, size: str = "size") -> DataFrame:
    """Rows in rank order while their sizes fit the budget; the first is always kept, the first overflow ends the list."""
    upto = F.sum(size).over(Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("upto", upto).where((F.col("upto") <= budget) | (F.col("rank") == 1))


def sources(ranked: DataFrame, preview: int = 250) -> DataFrame:
    """(qid, rank, doc_id, title, preview, score): what an answer cites."""
    title = F.coalesce(F.nullif("title", F.lit("")), F.nullif("source", F.lit("")), F.concat(F.lit("Document "), F.col("doc_id").cast("string")))
    return ranked.select("qid", "rank", "doc_id", title.alias("title"), clipped(F.col("text"), preview).alias("preview"), "score")


def rag_prompt(ranked: DataFrame, asked: DataFrame, docs: int = 3, chars: int = 1500) -> DataFrame:
    """(qid, prompt): the question below its best documents, each cut to ``chars``."""
    part = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.coalesce("title", F.lit("untitled")), F.lit("\n"), F.substring("text", 1, chars))
    listed = ranked.where(F.col("rank") <= docs).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", part.alias("part")))).alias("parts"))
    context = F.array_join(F.transform("parts", lambda p: p["part"]), "\n\n")
    joined = asked.join(listed, "qid", "left")
    return joined.select("qid", F.concat(F.lit("Context:\n"), F.coalesce(context, F.lit("none")), F.lit("\n\nQuestion: "), F.col("text")).alias("prompt"))


def answer_confidence(mean_score: Column, n: Column, words: Column) -> Column:
    """Clamped mean score, number of sources up to five, and length of the answer; 0.05 without sources."""
    length = F.when(words < 5, 0.2).when(words < 20, 0.6).otherwise(1.0)
    score = 0.4 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), mean_score)) + 0.3 * F.least(F.lit(1.0), n / 5) + 0.2 * length + 0.1
    return F.when(n == 0, 0.05).otherwise(score)


def delivered_once(turns: DataFrame) -> DataFrame:
    """One row for each conversation and turn: the one received first."""
    nth = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy(F.col("received_at").asc_nulls_last(), F.coalesce("text", F.lit(""))))
    return turns.withColumn("nth", nth).where("nth = 1").drop("nth")


def role_of(role: Column) -> Column:
    """user, assistant or system; other spellings folded, unknown ones null."""
    low = F.lower(F.trim(role))
    return F.when(low == "bot", "assistant").when(low.isin("user", "assistant", "system"), low)


def recent_turns(turns: DataFrame, n: int) -> DataFrame:
    """The last n turns of each conversation, 1 the newest."""
    back = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").desc()))
    return turns.withColumn("back", back).where(F.col("back") <= n)


def changed_turns(turns: DataFrame) -> DataFrame:
    """Turns whose text differs from the one before in the conversation; the first counts as changed."""
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return turns.withColumn("before", before).where("before is null or text is null or before <> text").drop("before")


def conversation_prompt(turns: DataFrame) -> DataFrame:
    """(conv_id, prompt): role-tagged turns in order, unknown roles and empty texts left out."""
    kept = turns.withColumn("role", role_of(F.col("role"))).where("role is not null and coalesce(text, '') <> ''")
    line = F.concat(F.lit("<|"), F.col("role"), F.lit("|> "), F.col("text"))
    listed = kept.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("lines"))
    return listed.select("conv_id", F.concat(F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), F.lit("\n<|assistant|>")).alias("prompt"))


#: Words that point to an agent, in the order a question is classified.
AGENT_WORDS = {
    "code": ("code", "function", "import", "parser", "código", "analyseur de code", "codeprüfung"),
    "research": ("research", "crawler", "web", "search", "suche", "recherche", "búsqueda"),
    "document": ("document", "chunk", "page", "heading", "footnote", "seiten", "datei", "fichier", "fichero"),
}


def routed(questions: DataFrame) -> DataFrame:
    """Agents a question names, its main one (``rag`` for none), and how complex it is between 0 and 1."""
    low = F.lower("text")
    hits = {agent: _any_of(low, words) for agent, words in AGENT_WORDS.items()}
    agents = F.array_compact(F.array(*[F.when(hit, F.lit(agent)) for agent, hit in hits.items()]))
    n = F.size(F.filter(F.split(low, r"\s+"), lambda w: w != ""))
    complexity = F.least(F.lit(1.0), 0.3 + F.when(n > 20, 0.3).when(n > 10, 0.15).otherwise(0.0) + 0.2 * (F.size(agents) > 1).cast("int") + 0.1 * low.contains("?").cast("int"))
    return questions.withColumn("agents", F.concat_ws(",", agents)).withColumn("main", F.coalesce(F.get(agents, F.lit(0)), F.lit("rag"))).withColumn("complexity", complexity)


def _any_of(text: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | text.contains(w)
    return found
