import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from textloom.functions import text as fx
from textloom.operators import chunking
from textloom.operators.text import file_type, ingested


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "text string").select(expr).first()[0]


@pytest.mark.parametrize("value, want", [(None, 1), ("", 1), ("abcdefgh", 2)])
def test_token_estimate(spark, value, want):
    assert one(spark, fx.token_estimate(F.col("text")), value) == want


@pytest.mark.parametrize("value, want", [("Größe, und-so_x a 12!", ["größe", "und", "so_x", "12"]), ("", []), (" . ", [])])
def test_words(spark, value, want):
    assert one(spark, fx.words(F.col("text")), value) == want


def test_redaction_order_and_idempotence(spark):
    value = "a.b@c.org 555-12-1234 1.2.3.4 4111 1111 1111 1111"
    once = one(spark, fx.redacted(F.col("text")), value)
    assert once.startswith("[REDACTED]") and "@" not in once and "4111" not in once
    assert one(spark, fx.redacted(F.col("text")), once) == once


def test_language_ties_and_threshold(spark):
    assert one(spark, fx.detected_language(F.col("text")), "the der xx yy zz aa bb cc") == "en"
    assert one(spark, fx.detected_language(F.col("text")), "the x y z a b c d e f") == "unknown"  # exactly a tenth
    assert one(spark, fx.detected_language(F.col("text")), "the of") == "unknown"


def test_quality_stack(spark):
    expr = fx.quality_score(F.col("text"), F.lit(True), F.lit("en"))
    assert one(spark, expr, "few words here") == pytest.approx(0.5 * 0.6 * 0.8 * 1.1)


@pytest.mark.parametrize("name, declared, want", [("a.PDF", None, "pdf"), ("x", ".docx", "docx"), ("x.zip", "html", "html"), (None, None, "txt")])
def test_file_type(spark, name, declared, want):
    df = spark.createDataFrame([(name, declared)], "n string, d string")
    assert df.select(file_type(F.col("n"), F.col("d"))).first()[0] == want


def test_fold_limits_and_long_parts(spark):
    df = spark.createDataFrame([(1, "Aa. " + "b" * 30 + ". Cc. Dd."), (2, None), (3, " \n "), (4, "")], "doc_id long, text string")
    rows = chunking.chunked(df, size=10).orderBy("doc_id", "chunk_index").collect()
    assert [r.content for r in rows] == ["Aa.", "b" * 30 + ".", "Cc. Dd."]


def test_overlap_is_carried(spark):
    df = spark.createDataFrame([(1, "Aaaa. Bbbb. Cccc.")], "doc_id long, text string")
    assert [r.content for r in chunking.chunked(df, size=11, overlap=3).orderBy("chunk_index").collect()] == ["Aaaa. Bbbb.", "bb. Cccc."]
    with pytest.raises(ValueError):
        chunking.folded(F.col("x"), size=5, overlap=5)


def test_windows_cover_the_text(spark):
    value = "".join(chr(97 + i % 26) for i in range(5003))
    got = one(spark, chunking.windows(F.col("text"), 2000, 50), value)
    assert got[0].content == value[:2000] and got[-1].start_char + len(got[-1].content) == len(value)
    assert one(spark, chunking.windows(F.col("text")), "") is None


def test_snapped_windows(spark):
    value = "word " * 1000
    rows = chunking.snapped_windows(spark.createDataFrame([(1, value), (2, None), (3, "")], "doc_id long, text string"), 200, 20).collect()
    assert {r.doc_id for r in rows} == {1}
    covered = set()
    for r in rows:
        assert value[r.start_char : r.start_char + len(r.content)] == r.content
        covered |= set(range(r.start_char, r.start_char + len(r.content)))
    assert covered == set(range(len(value)))


def test_ingestion_measures_before_redaction(spark):
    text = "Write to ann.b@example.org about the open list of the week and the rest of it, which is long enough to keep."
    row = ingested(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.chars == len(text) and row.contains_pii and "[REDACTED]" in row.content


@settings(max_examples=15, deadline=None)
@given(st.text(alphabet="abc .!?\n", max_size=200))
def test_sentence_chunks_keep_every_word(spark, value):
    rows = chunking.chunked(spark.createDataFrame([(1, value)], "doc_id long, text string"), size=20).orderBy("chunk_index").collect()
    assert " ".join(r.content for r in rows).split() == value.split()


@pytest.mark.parametrize(
    "reply, want",
    [("1. What is stored here?\n- Why so late?\nNo question.\nshort?\n* How many rows are there?\nWho reads them at last?", ["What is stored here?", "Why so late?", "How many rows are there?"]), ("", []), (None, None)],
)
def test_follow_ups(spark, reply, want):
    from textloom.operators.replies import follow_ups

    assert one(spark, follow_ups(F.col("text")), reply) == want


def test_cleaned_reply(spark):
    from textloom.operators.replies import cleaned_reply

    assert one(spark, cleaned_reply(F.col("text"), F.lit("Ask: ")), "Ask: <|end|>\n Assistant: Fine.</s> ") == "Fine."
    assert one(spark, cleaned_reply(F.col("text")), None) is None
