from pyspark.sql import functions as F

from textloom.operators import replies


def ranked(spark, n, scores=None):
    return spark.createDataFrame([(1, i, i, float(scores[i - 1] if scores else n - i)) for i in range(1, n + 1)], "qid int, doc_id int, rank int, score double")


def told(spark, rows):
    return spark.createDataFrame(rows, "qid int, doc_id int, reply string")


def test_replies_reorder_the_first_rows_only(spark):
    rows = replies.mixed_with_replies(ranked(spark, 5, [0.2, 0.2, 0.1, 9.0, 8.0]), told(spark, [(1, 1, "1"), (1, 2, "9"), (1, 3, None), (1, 5, "10")]), scored=3)
    got = [(r.doc_id, round(r.score, 6)) for r in rows.orderBy("rank").collect()]
    assert got == [(1, 0.76), (2, 0.69), (3, 0.38), (4, 9.0), (5, 8.0)]


def test_replies_over_the_tops_rank_all_rows_together(spark):
    rows = replies.mixed_over_tops(ranked(spark, 3, [1.0, 4.0, 2.0]), told(spark, [(1, 1, "0"), (1, 2, "5")]), scored=2)
    assert [(r.doc_id, round(r.score, 6)) for r in rows.orderBy("rank").collect()] == [(2, 1.0), (3, 0.15), (1, 0.075)]
    none = replies.mixed_over_tops(ranked(spark, 2, [0.0, 0.0]), told(spark, [(1, 1, "0"), (1, 2, "0")]))
    assert [(r.doc_id, r.score) for r in none.orderBy("rank").collect()] == [(1, 0.0), (2, 0.0)]
    assert replies.mixed_over_tops(ranked(spark, 0), told(spark, [])).count() == 0


def test_cited_context_shares_the_budget(spark):
    rows = spark.createDataFrame([(1, 1, "s", "t", "x" * 100), (1, 2, None, None, None), (1, 3, "s", "t", "z" * 100), (2, 1, "s", "t", "y" * 500)], "qid int, rank int, source string, title string, text string")
    got = {r.qid: r for r in replies.cited_context(rows, budget=150).collect()}
    assert got[1].cited == 2 and got[1].context == "[Source 1: s - t]\n" + "x" * 50 + "\n---\n[Source 2: unknown - untitled]\n"
    assert 2 not in got  # an excerpt that fills the budget leaves no room for its own source line
    assert {r.qid: r.cited for r in replies.cited_context(rows.withColumn("text", F.lit("a"))).collect()} == {1: 3, 2: 1}


def test_joint_confidence(spark):
    rows = spark.createDataFrame([("a", 0.5), ("a", 0.7), ("a", None), ("b", 0.95), ("b", 0.95), ("c", None), ("d", 0.2)] + [("e", 0.1)] * 9, "k string, c double")
    assert {r.k: (r.answers, round(r.confidence, 6)) for r in replies.joint_confidence(rows, "k", "c").collect()} == {"a": (2, 0.7), "b": (2, 1.0), "c": (0, 0.0), "d": (1, 0.2), "e": (9, 0.3)}


def test_tagged_prompts_stay(spark):
    rows = spark.createDataFrame([("<|user|> hi",), ("hi",), ("",), (None,)], "text string")
    assert [r[0] for r in rows.select(replies.tagged_prompt(F.col("text"))).collect()] == ["<|user|> hi", "<|user|> hi\n<|assistant|>", "<|user|> \n<|assistant|>", None]
