"""Mixing sources to target weights.

Method: iterative proportional fitting.  Token weights of the cells source x
language x topic are raked to the marginals of the three, trimmed where a cell
would have to repeat its records more often than its source allows, and raked
again; documents are then sampled by the calibrated rates.

Only cell totals (one row for each combination that occurs) take part in the
fitting; documents are touched twice, to count their tokens and to be sampled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from textloom.llm.encode import token_count
from textloom.llm.language import label_code
from textloom.session import checkpointed

#: Rounds of raking; shares settle well before.
ROUNDS = 8
#: Share of what the scarcest source could give at most that the mixture asks for, so that trimming has room.
HEADROOM = 0.95
#: Documents of one source that are sampled together; a source has as many such shards as its size asks for.
SHARD_ROWS = 20_000
#: Cells up to this number are sent to all tasks; more are joined by their keys.
BROADCAST_CELLS = 100_000


def clean_source(source: Column) -> Column:
    """One spelling for a source: lower case, words joined by ``_``, as in ``readme`` for ``READ_me``."""
    name = F.regexp_replace(F.regexp_replace(F.lower(F.trim(source)), r"[\s\-_.]+", "_"), r"^_+|_+$", "")
    return F.when(name == "read_me", F.lit("readme")).otherwise(name)


def weighed(documents: DataFrame, targets: DataFrame, path: str | None = None) -> DataFrame:
    """Documents of the target sources with their size in tokens and the cell they fall in.

    Null source falls out, as does any source without a target; languages come in
    one spelling, and null or unknown ones count as a value of their own, as does a
    null namespace; texts without a token have no weight and fall out.
    """
    names = targets.select(clean_source(F.col("source")).alias("_source"), "target_share", "max_repeats")
    sized = documents.select(
        "doc_id",
        clean_source(F.col("source")).alias("_source"),
        F.coalesce(label_code(F.col("lang")), F.lit("?")).alias("language"),
        F.coalesce("namespace", F.lit("?")).alias("topic"),
        "text",
    )
    joined = sized.join(names, "_source")
    counted = joined.select("doc_id", F.col("_source").alias("source"), "language", "topic", "target_share", "max_repeats", token_count(F.col("text"), path).alias("tokens"))
    return counted.where("tokens > 0")


def _rake(cells: DataFrame, by: str, goal: str) -> DataFrame:
    """Scale the cells' weights so that their sum over ``by`` meets ``goal``."""
    total = F.sum("weight").over(Window.partitionBy(by))
    return cells.withColumn("weight", F.when(total > 0, F.col("weight") * F.col(goal) / total).otherwise(0.0))


def fitted_cells(docs: DataFrame, rounds: int = ROUNDS, headroom: float = HEADROOM) -> DataFrame:
    """Cells (source, language, topic) with tokens, weight and rate (expected uses of each record).

    Marginals: the target shares for source, the corpus shares of tokens for
    language and topic.  The size of the mixture is what the scarcest source
    allows at ``max_repeats`` uses, times ``headroom``.  Source is raked last, so
    its shares hold.
    """
    spark = docs.sparkSession
    cells = docs.groupBy("source", "language", "topic").agg(
        F.sum("tokens").cast("double").alias("tokens"), F.count("*").alias("docs"), F.first("target_share").alias("share"), F.first("max_repeats").alias("max_repeats")
    )
    cells = checkpointed(spark, cells)
    sources = cells.groupBy("source").agg(F.sum("tokens").alias("have"), F.first("share").alias("share"), F.first("max_repeats").alias("max_repeats"))
    reach = sources.agg(F.sum("share").alias("all_shares"), F.min(F.when(F.col("share") > 0, F.col("have") * F.col("max_repeats") / F.col("share"))).alias("size"))
    everything = cells.agg(F.sum("tokens").alias("corpus"))
    cells = cells.crossJoin(F.broadcast(reach)).crossJoin(F.broadcast(everything))  # one row each
    size = F.col("size") * F.col("all_shares") * headroom
    by_language, by_topic = Window.partitionBy("language"), Window.partitionBy("topic")
    cells = (
        cells.withColumn("goal_source", size * F.col("share") / F.col("all_shares"))
        .withColumn("goal_language", size * F.sum("tokens").over(by_language) / F.col("corpus"))
        .withColumn("goal_topic", size * F.sum("tokens").over(by_topic) / F.col("corpus"))
        .withColumn("weight", F.col("tokens"))
    )
    most = F.col("tokens") * F.col("max_repeats")
    for turn in range(rounds):
        for by in ("language", "topic", "source"):
            cells = _rake(cells, by, f"goal_{by}")
        cells = cells.withColumn("weight", F.least("weight", most))
        if turn % 2 == 1:
            cells = checkpointed(spark, cells)
    # what trimming took from a source goes to its cells that have room, in proportion to the room
    own = Window.partitionBy("source")
    room = F.sum(most - F.col("weight")).over(own)
    lack = F.col("goal_source") - F.sum("weight").over(own)
    cells = cells.withColumn("weight", F.when((lack > 0) & (room > 0), F.col("weight") + (most - F.col("weight")) * F.least(lack / room, F.lit(1.0))).otherwise(F.col("weight")))
    return cells.select("source", "language", "topic", "tokens", "docs", "share", "max_repeats", "weight", (F.col("weight") / F.col("tokens")).alias("rate"))


def sampled(docs: DataFrame, cells: DataFrame, seed: int = 7) -> DataFrame:
    """(doc_id, source, tokens, uses) of each document used, by systematic sampling within shards of a source.

    Within a shard documents lie in order of size and take up ``rate`` each; one
    is used as often as the marks 0.5, 1.5, ... fall in its stretch.  What the
    tokens of the shard then lack or have too many is moved in single uses, in
    random order by ``seed``, so a shard meets its goal to within about half a
    document and no document is used more than ``max_repeats`` times.
    """
    shards = F.greatest(F.lit(1), F.ceil(F.sum("docs").over(Window.partitionBy("source")) / SHARD_ROWS)).cast("int")
    rates = cells.withColumn("shards", shards).select("source", "language", "topic", "rate", "shards")
    few = cells.select("source").limit(BROADCAST_CELLS + 1).count() <= BROADCAST_CELLS
    rated = docs.join(F.broadcast(rates) if few else rates, ["source", "language", "topic"])
    rated = rated.withColumn("shard", F.pmod(F.xxhash64("doc_id"), "shards"))
    shard = Window.partitionBy("source", "shard")
    upto = F.sum("rate").over(shard.orderBy("tokens", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    uses = F.floor(F.round(upto + 0.5, 9)) - F.floor(F.round(upto - F.col("rate") + 0.5, 9))
    most = F.col("max_repeats").cast("long")
    drawn = rated.withColumn("uses", F.least(uses, most))
    # the largest documents leave a rest, which documents in random order make good
    drawn = drawn.withColumn("rest", F.sum((F.col("rate") - F.col("uses")) * F.col("tokens")).over(shard))
    movable = F.when(F.col("rest") > 0, F.col("uses") < most).otherwise(F.col("uses") > 0)
    moved = F.sum(F.when(movable, F.col("tokens")).otherwise(0)).over(shard.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    step = F.when(movable & (moved - F.col("tokens") / 2 <= F.abs("rest")), F.signum("rest").cast("long")).otherwise(F.lit(0))
    settled = drawn.withColumn("uses", F.col("uses") + step).where("uses > 0")
    return settled.select("doc_id", "source", "language", "topic", "tokens", "uses")


def mix_sources(documents: DataFrame, targets: DataFrame, path: str | None = None, headroom: float = HEADROOM, seed: int = 7) -> DataFrame:
    """The documents of the mixture with the number of times each is used.

    Empty tables give an empty mixture.  Two documents of the same id are two
    records.  A source without documents gives nothing; the others keep their
    shares in proportion.  ``headroom`` is the part of the largest possible mixture
    to give, ``seed`` the order in which single uses are moved.
    """
    docs = checkpointed(documents.sparkSession, weighed(documents, targets, path))
    return sampled(docs, fitted_cells(docs, headroom=headroom), seed)


def marginal_report(documents: DataFrame, targets: DataFrame, path: str | None = None, headroom: float = HEADROOM, seed: int = 7) -> DataFrame:
    """(axis, value, tokens, mixed_tokens, target_share, actual_share) of each source, language and topic of the mixture.

    The target of a language or topic is its share of the tokens there are, that
    of a source its share among the sources with documents.  Empty tables give no rows.
    """
    docs = checkpointed(documents.sparkSession, weighed(documents, targets, path))
    drawn = sampled(docs, fitted_cells(docs, headroom=headroom), seed).select("source", "language", "topic", (F.col("tokens") * F.col("uses")).alias("mixed"))
    axes = ("source", "language", "topic")

    def along(rows: DataFrame, *sums: Column) -> DataFrame:
        pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("value")) for a in axes])).alias("at")
        summed = rows.groupBy(*axes).agg(*sums)
        return summed.select(pairs, *[c for c in summed.columns if c not in axes]).select("at.axis", "at.value", *[c for c in summed.columns if c not in axes])

    have = along(docs, F.sum("tokens").alias("tokens"), F.max("target_share").alias("share")).groupBy("axis", "value").agg(F.sum("tokens").alias("tokens"), F.max("share").alias("share"))
    got = along(drawn, F.sum("mixed").alias("mixed")).groupBy("axis", "value").agg(F.sum("mixed").alias("mixed_tokens"))
    rows = have.join(got, ["axis", "value"], "left").withColumn("mixed_tokens", F.coalesce("mixed_tokens", F.lit(0)))
    own = Window.partitionBy("axis")
    goal = F.when(F.col("axis") == "source", F.col("share")).otherwise(F.col("tokens"))
    return rows.select(
        "axis", "value", "tokens", "mixed_tokens", (goal / F.nullif(F.sum(goal).over(own), F.lit(0.0))).alias("target_share"), (F.col("mixed_tokens") / F.nullif(F.sum("mixed_tokens").over(own), F.lit(0))).alias("actual_share")
    )


def share_report(documents: DataFrame, targets: DataFrame, path: str | None = None) -> DataFrame:
    """One row for each target source: target and actual share of tokens, documents, uses and most uses of one record.

    ``reachable_share`` is the target in proportion to the sources that have documents.
    """
    mixed = mix_sources(documents, targets, path)
    given = mixed.groupBy("source").agg(
        F.sum(F.col("tokens") * F.col("uses")).alias("tokens"), F.count("*").alias("documents"), F.sum("uses").alias("uses"), F.max("uses").alias("most_uses")
    )
    rows = targets.select(clean_source(F.col("source")).alias("source"), "target_share", "max_repeats").join(given, "source", "left")
    none = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("tokens", "documents", "uses", "most_uses")]
    rows = rows.select("source", "target_share", "max_repeats", *none)
    every = Window.partitionBy(F.lit(1))  # one row for each target source
    reachable = F.when(F.col("tokens") > 0, F.col("target_share") / F.sum(F.when(F.col("tokens") > 0, F.col("target_share"))).over(every)).otherwise(0.0)
    actual = F.when(F.sum("tokens").over(every) > 0, F.col("tokens") / F.sum("tokens").over(every)).otherwise(0.0)
    return rows.select("*", reachable.alias("reachable_share"), actual.alias("actual_share"))
