"""Web pages: addresses, per-site caps, engine merging, html parts, topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Sites left out of research unless asked for (whole host suffixes).
SOCIAL_HOSTS = ("social.example", "video.example", "photos.example", "forum.example.org")


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.trim(url), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/@?#]*@)?([^/:?#]+)", 1))


def site(url: Column) -> Column:
    """The host without a leading ``www.`` or ``m.``."""
    return F.regexp_replace(host(url), r"^(?:www\.|m\.)", "")


def normal_url(url: Column) -> Column:
    """Scheme, www. and m., fragment, tracking query and a trailing slash taken off, host in lower case."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), r"[#].*$", ""), r"[?].*$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/]*(/.*)?$", 1), r"/+$", "")
    return F.concat(site(url), path)


def capped_by_site(pages: DataFrame, cap: int, order: str) -> DataFrame:
    """At most ``cap`` rows of each site in the given order; the group limit runs before the exchange."""
    nth = F.row_number().over(Window.partitionBy("site").orderBy(order))
    return pages.withColumn("nth", nth).where(F.col("nth") <= cap)


def merged_engines(pages: DataFrame, engines: tuple[str, ...]) -> DataFrame:
    """One row for each normal url: that of the first engine in order, then of the smallest id."""
    rank = F.coalesce(*[F.when(F.col("source_engine") == e, F.lit(i)) for i, e in enumerate(engines)], F.lit(len(engines)))
    best = Window.partitionBy("normal_url").orderBy(rank, "web_id")
    return pages.withColumn("nth", F.row_number().over(best)).where("nth = 1").drop("nth")


def excluded(pages: DataFrame, hosts: tuple[str, ...] = SOCIAL_HOSTS) -> DataFrame:
    """Pages outside the given hosts and their subdomains."""
    hit = F.lit(False)
    for h in hosts:
        hit = hit | (F.col("site") == h) | F.endswith("site", F.lit("." + h))
    return pages.where(~hit)


def html_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def html_language(html: Column) -> Column:
    return F.lower(F.regexp_extract(html, r"(?i)<html[^>]*\blang=\"([^\"]*)\"", 1))


def html_text(html: Column) -> Column:
    """Text of a page: comments, scripts, styles, navigation and footers dropped, tags stripped, space collapsed."""
    body = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    for tag in ("script", "style", "nav", "footer", "aside", "form", "head"):
        body = F.regexp_replace(body, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(body, r"<[^>]*>", " "), r"\s+", " "))


def related_topics(pages: DataFrame, k: int = 5) -> DataFrame:
    """(site, topic, pages): the k words that stand in most titles of a site, those inside a longer one left out.

    A word is compared with the parts of the site's longer words by an equi-join, so
    no pairs of a site's words are formed; the parts grow with the square of a
    word's length.
    """
    found = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("title"), F.lit(r"[a-zß-ÿ]{4,}"), F.lit(0))))
    counts = pages.where("title is not null").select("site", found.alias("topic")).groupBy("site", "topic").agg(F.count("*").alias("pages"))
    order = Window.partitionBy("site").orderBy(F.col("pages").desc(), "topic")
    longer = counts.where(F.length("topic") > 4).select("site", "topic", F.explode(F.sequence(F.lit(1), F.length("topic") - 3)).alias("start"))
    parts = longer.select("site", F.col("topic").alias("longer"), F.explode(F.transform(F.sequence(F.lit(4), F.length("topic") - F.col("start") + 1), lambda n: F.substring("topic", F.col("start"), n))).alias("topic"))
    inside = parts.where("topic <> longer").select("site", "topic")
    # sites may be null: such rows are a group of their own, and none of their words is inside another's
    kept = counts.join(inside, ["site", "topic"], "left_anti")
    return kept.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k).select("site", "topic", "pages")


def research_confidence(pages: DataFrame, key: str) -> DataFrame:
    """Confidence of each group of pages from their number, sites, length, and how many name an author or a date."""
    got = pages.groupBy(key).agg(
        F.count("*").alias("n"), F.countDistinct("site").alias("sites"), F.avg(F.coalesce("word_count", F.lit(0))).alias("mean_words"),
        F.avg(((F.coalesce("author", F.lit("")) != "") | F.col("publish_date").isNotNull()).cast("double")).alias("signed"), F.max(F.col("publish_date").isNotNull().cast("int")).alias("dated"),
    )
    cap = lambda c, top: F.least(c / top, F.lit(1.0))
    total = 0.15 * cap(F.col("n"), 3) + 0.15 * cap(F.col("sites"), 2) + 0.1 * cap(F.col("mean_words"), 1000) + 0.1 * F.col("signed") + 0.05 * F.col("dated")
    return got.select(key, "n", F.least(F.lit(0.95), F.greatest(F.lit(0.1), total / 0.55)).alias("confidence"))
