"""Lines repeated across one site's documents.

Method: every partition builds a bounded heavy-hitter summary (frequent lines with
a count and a per-site error bound, as in Misra and Gries); summaries merge by
adding counts and errors; what could reach the threshold by count plus error is a
candidate.  A second pass counts the candidates exactly, over distinct urls, and
the confirmed lines are removed with a broadcast set, or a join where the set is
larger than the bound.

No line is lost: a line that is in no summary can stand on at most ``error`` pages
of its site, so a site whose error reaches the threshold has all its lines counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from textloom.session import checkpointed

#: A line is repeated if it stands on this many different urls of one site.
MIN_URLS = 5
#: Counters one partition keeps before it prunes.
SUMMARY_SIZE = 1_000_000
#: Confirmed lines are broadcast up to this many rows of 16 bytes, and joined with a shuffle beyond.
BROADCAST_ROWS = 200_000


def site_of(domain: Column, url: Column) -> Column:
    """Domain, or the url's host where it is null, in lower case without leading ``www.`` or ``m.``."""
    host = F.regexp_extract(F.trim(url), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://)?(?:[^/@?#]*@)?([^/:?#]+)", 1)
    return F.regexp_replace(F.lower(F.trim(F.coalesce(domain, host))), r"^(?:www\.|m\.)+", "")


def letters_of(line: Column) -> Column:
    """A line in lower case with its letters only (Unicode)."""
    return F.regexp_replace(F.lower(line), r"[^\p{L}]+", "")


def row_key() -> Column:
    """Tells rows apart by all that their lines depend on."""
    return F.xxhash64("web_id", "url", "domain", "content")


def page_lines(pages: DataFrame) -> DataFrame:
    """(web_id, row_key, site, line_no, line, line_key) of each line that has letters; lines split at ``\\n``, counted from 1."""
    site = site_of(F.col("domain"), F.col("url"))
    lines = pages.where(F.col("content").isNotNull()).select(
        "web_id", row_key().alias("row_key"), site.alias("site"), F.posexplode(F.split("content", "\n")).alias("at", "line")
    )
    keyed = lines.withColumn("letters", letters_of(F.col("line"))).where("letters <> ''")
    return keyed.select("web_id", "row_key", "site", (F.col("at") + 1).alias("line_no"), "line", F.xxhash64("site", "letters").alias("line_key"))


def _summaries(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Frequent (site, line) counters of a partition; rows without a line key carry the site's error."""
    counts: dict[tuple[int, int], int] = {}
    errors: dict[int, int] = {}
    for batch in batches:
        frame = pd.DataFrame({"site": batch.column(0).to_numpy(zero_copy_only=False), "line": batch.column(1).to_numpy(zero_copy_only=False)})
        for key, n in frame.value_counts(sort=False).items():
            counts[key] = counts.get(key, 0) + n
        while len(counts) > size:
            cut = max(1, int(np.partition(np.fromiter(counts.values(), np.int64, len(counts)), len(counts) // 2)[len(counts) // 2]))
            for site in {site for site, _ in counts}:
                errors[site] = errors.get(site, 0) + cut
            counts = {key: n - cut for key, n in counts.items() if n > cut}
    rows = [(site, line, n) for (site, line), n in counts.items()]
    sites, lines, ns = zip(*rows) if rows else ((), (), ())
    names = ["site_key", "line_key", "n"]
    yield pa.RecordBatch.from_arrays([pa.array(sites, pa.int64()), pa.array(lines, pa.int64()), pa.array(ns, pa.int64())], names=names)
    if errors:
        yield pa.RecordBatch.from_arrays(
            [pa.array(errors.keys(), pa.int64()), pa.array([None] * len(errors), pa.int64()), pa.array(errors.values(), pa.int64())], names=names
        )


def candidate_lines(keys: DataFrame, min_urls: int = MIN_URLS, size: int = SUMMARY_SIZE) -> tuple[DataFrame, DataFrame]:
    """(line keys that may reach the threshold, site keys whose error alone reaches it), from (site_key, line_key) rows."""
    summary = keys.mapInArrow(lambda batches: _summaries(batches, size), "site_key long, line_key long, n long")
    merged = summary.groupBy("site_key", "line_key").agg(F.sum("n").alias("n"))
    errors = merged.where("line_key is null").select("site_key", F.col("n").alias("error"))
    lines = merged.where("line_key is not null")
    bounded = lines.join(errors, "site_key", "left").where(F.col("n") + F.coalesce("error", F.lit(0)) >= min_urls)
    return bounded.select("line_key"), errors.where(F.col("error") >= min_urls).select("site_key")


def repeated_lines(pages: DataFrame, min_urls: int = MIN_URLS, size: int = SUMMARY_SIZE) -> DataFrame:
    """Keys (line_key) of the lines that stand on at least ``min_urls`` different urls of their site."""
    # a page names each of its lines once, so nothing is shuffled before the summaries
    site = site_of(F.col("domain"), F.col("url"))
    letters = F.array_distinct(F.transform(F.split("content", "\n"), letters_of))
    once = pages.where(F.col("content").isNotNull() & F.col("url").isNotNull()).select("url", site.alias("site"), F.explode(letters).alias("letters")).where("letters <> ''")
    keys = once.select(F.xxhash64("site").alias("site_key"), F.xxhash64("site", "letters").alias("line_key"), F.xxhash64("url").alias("url_key"))
    candidates, open_sites = candidate_lines(keys.select("site_key", "line_key"), min_urls, size)
    sure = keys.join(candidates, "line_key", "left_semi")
    if open_sites.limit(1).count():
        whole = keys.join(open_sites, "site_key", "left_semi")
        sure = sure.unionByName(whole)
    # the distinct (line, url) pairs are spread by both keys, so a line of a third of all pages has no task of its own
    pairs = sure.select("line_key", "url_key").distinct()
    return pairs.groupBy("line_key").agg(F.count("*").alias("urls")).where(F.col("urls") >= min_urls).select("line_key")


def _marks(pages: DataFrame, min_urls: int, size: int) -> DataFrame:
    """(web_id, row_key, line_no) of each occurrence of a repeated line."""
    confirmed = checkpointed(pages.sparkSession, repeated_lines(pages, min_urls, size))
    if confirmed.count() <= BROADCAST_ROWS:
        confirmed = F.broadcast(confirmed)
    return page_lines(pages).join(confirmed, "line_key", "left_semi").select("web_id", "row_key", "line_no")


def mark_repeated(pages: DataFrame, min_urls: int = MIN_URLS, size: int = SUMMARY_SIZE) -> DataFrame:
    """(web_id, line_no) of each occurrence of a repeated line.

    Null content has no lines; blank lines and lines without letters are never
    cases; rows without domain and url form one site of their own; a null url is
    no url.  A row that repeats gives one row in the result.
    """
    return _marks(pages, min_urls, size).select("web_id", "line_no").distinct()


def without_repeated(pages: DataFrame, min_urls: int = MIN_URLS, size: int = SUMMARY_SIZE) -> DataFrame:
    """``pages`` with the repeated lines taken out of content, and their number as ``removed_lines``.

    Null content stays null with 0 removed lines.  Rows are told apart by id and
    content, so an id may be null or come with several contents.
    """
    marks = _marks(pages, min_urls, size).groupBy("web_id", "row_key").agg(F.collect_set("line_no").alias("_gone"))
    marks = marks.select(F.col("web_id").alias("_id"), F.col("row_key").alias("_row"), "_gone")
    lines = F.split("content", "\n")
    kept = F.filter(lines, lambda _, i: ~F.array_contains(F.col("_gone"), i + 1))
    return (
        pages.withColumn("_key", row_key())
        .join(marks, (F.col("_key") == F.col("_row")) & F.col("web_id").eqNullSafe(F.col("_id")), "left")
        .withColumn("content", F.when(F.col("_gone").isNull(), F.col("content")).otherwise(F.array_join(kept, "\n")))
        .withColumn("removed_lines", F.coalesce(F.size("_gone"), F.lit(0)))
        .drop("_gone", "_key", "_row", "_id")
    )
