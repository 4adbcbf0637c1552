import random

from pyspark.sql import functions as F

from textloom.llm.mixture import clean_source, marginal_report, mix_sources, share_report

DOCS = "doc_id long, text string, lang string, source string, namespace string, tokens int, shard string"
TARGETS = "source string, target_share double, max_repeats int"


def corpus(spark, n=2500):
    rng = random.Random(5)
    sources = ["manual"] * 6 + ["forum ", "Forum", "read_me", "README", "other", None, "glossary"]
    rows = [(i, "word " * rng.choice([3, 20, 40, 200]), rng.choice(["en", "EN", "de", None]), rng.choice(sources), rng.choice(["a", "b", None]), 1, "x") for i in range(n)]
    return spark.createDataFrame(rows + [(n, None, "en", "manual", "a", 1, "x"), (n + 1, "", "en", "manual", "a", 1, "x")], DOCS)


def test_shares_and_repeats(spark):
    targets = spark.createDataFrame([("manual", 0.4, 1), ("forum", 0.3, 3), ("readme", 0.2, 4), ("glossary", 0.05, 2), ("absent", 0.05, 2)], TARGETS)
    report = {r.source: r for r in share_report(corpus(spark), targets).collect()}
    assert set(report) == {"manual", "forum", "readme", "glossary", "absent"}
    for name, r in report.items():
        assert abs(r.actual_share - r.reachable_share) < 0.01, r
        assert r.most_uses <= r.max_repeats
    assert report["absent"].tokens == 0 and abs(sum(r.actual_share for r in report.values()) - 1) < 1e-9


def test_mixture_rows(spark):
    targets = spark.createDataFrame([("manual", 0.5, 1), ("forum", 0.5, 2)], TARGETS)
    rows = mix_sources(corpus(spark), targets).collect()
    assert rows and all(1 <= r.uses <= (1 if r.source == "manual" else 2) for r in rows)
    assert len({r.doc_id for r in rows}) == len(rows)


def test_same_result_again(spark):
    targets = spark.createDataFrame([("manual", 0.5, 1), ("forum", 0.5, 2)], TARGETS)
    runs = [sorted((r.doc_id, r.uses) for r in mix_sources(corpus(spark).repartition(n), targets).collect()) for n in (1, 5)]
    assert runs[0] == runs[1]


def test_empty(spark):
    targets = spark.createDataFrame([("manual", 1.0, 1)], TARGETS)
    empty = corpus(spark, 1).limit(0)
    assert mix_sources(empty, targets).count() == 0
    assert share_report(empty, targets).first().actual_share == 0.0
    assert mix_sources(corpus(spark, 50), targets.limit(0)).count() == 0


def test_spellings(spark):
    df = spark.createDataFrame([(" Meeting Notes ",), ("meeting-notes",), ("READ_me",), (None,)], "s string").select(clean_source(F.col("s")).alias("s"))
    assert [r.s for r in df.collect()] == ["meeting_notes", "meeting_notes", "readme", None]


def test_marginals_add_up_and_say_how_far_off(spark):
    targets = spark.createDataFrame([("manual", 0.4, 1), ("forum", 0.4, 4), ("absent", 0.2, 2)], TARGETS)
    rows = marginal_report(corpus(spark), targets).collect()
    assert {r.axis for r in rows} == {"source", "language", "topic"} and {r.value for r in rows if r.axis == "language"} == {"en", "de", "?"}
    for axis in ("source", "language", "topic"):
        assert abs(sum(r.target_share for r in rows if r.axis == axis) - 1) < 1e-9 and abs(sum(r.actual_share for r in rows if r.axis == axis) - 1) < 1e-9
    assert all(abs(r.actual_share - r.target_share) < 0.02 for r in rows)
    assert marginal_report(corpus(spark, 1).limit(0), targets).count() == 0


def test_headroom_seed_and_joined_cells(spark, monkeypatch):
    targets = spark.createDataFrame([("manual", 0.5, 1), ("forum", 0.5, 2)], TARGETS)
    docs = corpus(spark)
    runs = {}
    for name, given in {"whole": {}, "half": {"headroom": 0.5}, "other": {"seed": 8}}.items():
        runs[name] = sorted((r.doc_id, r.uses, r.tokens) for r in mix_sources(docs, targets, **given).collect())
    sizes = {name: sum(u * t for _, u, t in rows) for name, rows in runs.items()}
    assert abs(sizes["half"] / sizes["whole"] - 0.5 / 0.95) < 0.02 and abs(sizes["other"] / sizes["whole"] - 1) < 0.02
    monkeypatch.setattr("textloom.llm.mixture.BROADCAST_CELLS", 1)
    assert sorted((r.doc_id, r.uses, r.tokens) for r in mix_sources(docs, targets).collect()) == runs["whole"]
