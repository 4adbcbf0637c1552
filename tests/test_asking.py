"""Every asking row has its rows, also those that share a title or have none."""

import pytest

from textloom.plans import asking

DOCS = [
    (50, "red apple", "about fruit"), (100, "red apple", "wine"), (150, None, "green tea"), (200, None, "green tea"),
    (250, None, None), (300, "green tea", "red wine"), (301, "red apple", "not asking"),
]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("asking"))
    spark.createDataFrame([(*d, "s", "u", "en", "n") for d in DOCS], "doc_id long, title string, text string, source string, user_id string, lang string, namespace string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(d, b, t) for d, b, t in DOCS], "web_id long, title string, content string").selectExpr("*", "'' as summary").write.parquet(f"{at}/web_content.parquet")
    return at


def test_who_asks_what(spark, sf):
    got = {r.asker: (r.qid, r.text) for r in asking._asking(spark, sf, "documents", "doc_id", "text").collect()}
    assert got == {50: (50, "red apple"), 100: (50, "red apple"), 150: (150, "green tea"), 200: (150, "green tea"), 250: (250, ""), 300: (300, "green tea")}


@pytest.mark.parametrize("name", ["bm25_topk_each", "tfidf_topk_each", "hash_embed_search_each", "page_rerank_each"])
def test_every_asking_row_has_its_rows(spark, sf, name):
    found = {}
    for r in asking.QUERIES[name](spark, sf).collect():
        found.setdefault(r.asker, []).append((r.rank, r.web_id if "page" in name else r.doc_id))
    assert set(found) == {50, 100, 150, 200, 250, 300}
    assert found.pop(250) == [(None, None)] and all(None not in row for rows in found.values() for row in rows)
    assert sorted(found[50]) == sorted(found[100]) and sorted(found[150]) == sorted(found[200]) == sorted(found[300])
