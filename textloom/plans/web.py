"""Web queries over web_content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from textloom.functions.once import computed_once
from textloom.operators import ranking, web
from textloom.plans import sql
from textloom.session import spread
from textloom.sources.tables import table

ENGINES = ("engine_a", "engine_b", "feed")


def _pages(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    pages = table(spark, sf, "web_content").select("web_id", "url", *columns)
    return pages.withColumn("site", web.site(F.col("url"))).withColumn("normal_url", web.normal_url(F.col("url")))


def url_normalise(spark, sf):
    return _pages(spark, sf).select("web_id", "site", "normal_url")


def site_cap(spark, sf):
    return web.capped_by_site(_pages(spark, sf), 5, "web_id").select("web_id", "site", F.col("nth").cast("bigint").alias("nth"))


def site_exclude(spark, sf):
    return web.excluded(_pages(spark, sf), ("test", "social.example")).select("web_id", "site")


def engine_merge(spark, sf):
    return web.merged_engines(_pages(spark, sf, "source_engine"), ENGINES).select("normal_url", "web_id")


def html_title_lang(spark, sf):
    pages = spread(table(spark, sf, "web_content").where("raw_html is not null").select("web_id", "raw_html"))
    return pages.select("web_id", web.html_title(F.col("raw_html")).alias("title"), web.html_language(F.col("raw_html")).alias("language"))


def html_main_text(spark, sf):
    pages = spread(table(spark, sf, "web_content").where("raw_html is not null").select("web_id", "raw_html"))
    pages = computed_once(pages, text=web.html_text(F.col("raw_html")))
    return pages.select("web_id", F.length("text").cast("bigint").alias("chars"), F.md5("text").alias("digest"))


def page_links(spark, sf):
    """Links within and out of the site, all of each page."""
    links = _pages(spark, sf, "links").select("web_id", "site", F.explode("links").alias("link"))
    return links.groupBy("web_id").agg(F.count("*").alias("links"), F.sum((web.site(F.col("link")) == F.col("site")).cast("int")).alias("own"))


def _titles(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "web_content").where("web_id % 50 = 0 and title is not null")
    return pages.groupBy(F.col("title").alias("text")).agg(F.min("web_id").alias("qid"))


def page_rerank(spark, sf, questions=_titles):
    """Pages by BM25 of title and summary, or the start of content, against the titles of every fiftieth page."""
    pages = table(spark, sf, "web_content").select("web_id", "title", "summary", "content")
    text = F.concat_ws(" ", "title", F.coalesce(F.nullif("summary", F.lit("")), F.substring("content", 1, 1000)))
    docs = pages.select(F.col("web_id").alias("doc_id"), text.alias("text"))
    ranked = ranking.top_k(ranking.bm25(docs, questions(spark, sf)), 5)
    return ranked.select("qid", F.col("doc_id").alias("web_id"), F.col("rank").cast("bigint").alias("rank"), F.round("score", 6).alias("score"))


def research_confidence(spark, sf):
    pages = _pages(spark, sf, "word_count", "author", "publish_date", "source_engine")
    found = web.research_confidence(pages.withColumn("engine", F.coalesce("source_engine", F.lit("?"))), "engine")
    return found.select("engine", "n", F.round("confidence", 6).alias("confidence"))


def related_topics(spark, sf):
    return web.related_topics(_pages(spark, sf, "title"))


def latest_fetch(spark, sf):
    """The newest fetch of each page; a tie goes to the larger id."""
    pages = _pages(spark, sf, "extraction_time")
    return pages.groupBy("normal_url").agg(F.max_by("web_id", F.struct("extraction_time", "web_id")).alias("web_id"), F.count("*").alias("fetches"))


_HOST = r"lower(regexp_extract(trim({u}), '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/@?#]*@)?([^/:?#]+)', 1))"


def _site(u: str) -> str:
    return rf"regexp_replace({_HOST.format(u=u)}, '^(?:www\.|m\.)', '')"


_NORMAL = rf"{_site('url')} || regexp_replace(regexp_extract(regexp_replace(regexp_replace(trim(url), '[#].*$', ''), '[?].*$', ''), '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/]*(/.*)?$', 1), '/+$', '')"
_P = f"p AS (SELECT *, {_site('url')} AS site, {_NORMAL} AS normal_url FROM web_content)"


def _html_text(x: str) -> str:
    x = f"regexp_replace({x}, '(?s)<!--.*?-->', ' ', 'g')"
    for tag in ("script", "style", "nav", "footer", "aside", "form", "head"):
        x = rf"regexp_replace({x}, '(?is)<{tag}\b[^>]*>.*?</{tag}>', ' ', 'g')"
    return rf"trim(regexp_replace(regexp_replace({x}, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"


QUERIES = {f.__name__: f for f in (url_normalise, site_cap, site_exclude, engine_merge, html_title_lang, html_main_text, page_links, page_rerank, research_confidence, related_topics, latest_fetch)}

SQL = {
    "url_normalise": f"WITH {_P} SELECT web_id, site, normal_url FROM p",
    "site_cap": f"WITH {_P} SELECT web_id, site, row_number() OVER (PARTITION BY site ORDER BY web_id) AS nth FROM p QUALIFY nth <= 5",
    "site_exclude": f"WITH {_P} SELECT web_id, site FROM p WHERE NOT (site IN ('test', 'social.example') OR ends_with(site, '.test') OR ends_with(site, '.social.example'))",
    "engine_merge": f"""WITH {_P} SELECT normal_url, web_id FROM (SELECT *, row_number() OVER (PARTITION BY normal_url
        ORDER BY CASE source_engine WHEN 'engine_a' THEN 0 WHEN 'engine_b' THEN 1 WHEN 'feed' THEN 2 ELSE 3 END, web_id) AS nth FROM p) WHERE nth = 1""",
    "html_title_lang": r"""SELECT web_id, trim(regexp_extract(raw_html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, lower(regexp_extract(raw_html, '(?i)<html[^>]*\blang="([^"]*)"', 1)) AS language
        FROM web_content WHERE raw_html IS NOT NULL""",
    "html_main_text": f"SELECT web_id, length(t) AS chars, md5(t) AS digest FROM (SELECT web_id, {_html_text('raw_html')} AS t FROM web_content WHERE raw_html IS NOT NULL)",
    "page_links": f"""WITH {_P}, l AS (SELECT web_id, site, unnest(links) AS link FROM p)
        SELECT web_id, count(*) AS links, count(*) FILTER ({_site('link')} = site) AS own FROM l GROUP BY web_id""",
    "page_rerank": f"""WITH t AS (SELECT web_id AS doc_id, concat_ws(' ', title, coalesce(nullif(summary, ''), substr(content, 1, 1000))) AS text FROM web_content),
        q AS (SELECT min(web_id) AS qid, title AS text FROM web_content WHERE web_id % 50 = 0 AND title IS NOT NULL GROUP BY title),
        qt AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest({sql.words('text')}) AS term FROM q) GROUP BY qid, term),
        d AS (SELECT doc_id, tokens, len(tokens) AS dl FROM (SELECT doc_id, {sql.words('text')} AS tokens FROM t) WHERE len(tokens) > 0),
        n AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM d),
        tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, dl, unnest(tokens) AS term FROM d) WHERE term IN (SELECT term FROM qt) GROUP BY doc_id, dl, term),
        df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
        bm AS (SELECT qid, doc_id, sum(qtf * ln((n_docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM tf JOIN df USING (term) JOIN qt USING (term) CROSS JOIN n GROUP BY qid, doc_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bm QUALIFY rank <= 5)
        SELECT qid, doc_id AS web_id, rank, round(score, 6) AS score FROM r""",
    "research_confidence": f"""WITH {_P}, g AS (SELECT coalesce(source_engine, '?') AS engine, count(*) AS n, count(DISTINCT site) AS sites, avg(coalesce(word_count, 0)) AS mean_words,
        avg(CASE WHEN coalesce(author, '') <> '' OR publish_date IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS signed, max(CASE WHEN publish_date IS NOT NULL THEN 1 ELSE 0 END) AS dated FROM p GROUP BY 1)
        SELECT engine, n, round(least(0.95::DOUBLE, greatest(0.1::DOUBLE, (0.15::DOUBLE * least(n / 3.0, 1.0)::DOUBLE + 0.15::DOUBLE * least(sites / 2.0, 1.0)::DOUBLE + 0.1::DOUBLE * least(mean_words / 1000, 1.0)::DOUBLE + 0.1::DOUBLE * signed + 0.05::DOUBLE * dated) / 0.55::DOUBLE)), 6) AS confidence FROM g""",
    "related_topics": f"""WITH {_P}, w AS (SELECT site, unnest(list_distinct(regexp_extract_all(lower(title), '[a-zß-ÿ]{{4,}}'))) AS topic FROM p WHERE title IS NOT NULL),
        c AS (SELECT site, topic, count(*) AS pages FROM w GROUP BY site, topic),
        t AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY pages DESC, topic) AS nth FROM c),
        k AS (SELECT site, topic, pages FROM t WHERE NOT EXISTS (SELECT 1 FROM t l WHERE l.site = t.site AND l.topic <> t.topic AND contains(l.topic, t.topic))),
        r AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY pages DESC, topic) AS again FROM k QUALIFY again <= 5)
        SELECT site, topic, pages FROM r""",
    "latest_fetch": f"""WITH {_P}, r AS (SELECT normal_url, web_id, row_number() OVER (PARTITION BY normal_url ORDER BY extraction_time DESC NULLS LAST, web_id DESC) AS nth, count(*) OVER (PARTITION BY normal_url) AS fetches FROM p)
        SELECT normal_url, web_id, fetches FROM r WHERE nth = 1""",
}
