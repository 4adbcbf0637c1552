import os

import pytest
from pyspark.sql import functions as F

from textloom.llm import encode

pytestmark = pytest.mark.skipif(not os.path.exists(encode.rank_file()), reason="no tokenizer files")

TEXTS = [None, "", " ", "hello  world\n\n  x", "don't  stop<|endoftext|>", "数据 – é é 👩‍💻 \x1c!", "a" * 5000, "word " * 60_000, "\n" * 300]


def test_same_as_the_other_library(spark):
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(f"{encode.TOKENIZERS}/byte_bpe_50k.json")
    other.encode_special_tokens = True
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, ids int")
    for r in encode.encode_corpus(df).collect():
        assert list(r.ids) == (other.encode(TEXTS[r.doc_id], add_special_tokens=False).ids if TEXTS[r.doc_id] else [])


@pytest.mark.parametrize("size", [1, 7, 64, 1000])
def test_pieces_change_nothing(size):
    path = encode.rank_file()
    for text in filter(None, TEXTS):
        assert "".join(encode.pieces(text, size)) == text
        assert [i for p in encode.pieces(text, size) for i in encode.encoder(path).encode_ordinary(p)] == encode.encoder(path).encode_ordinary(text)


def test_round_trip(spark):
    df = spark.createDataFrame([(i, t or "") for i, t in enumerate(TEXTS)], "doc_id long, text string")
    back = df.withColumn("ids", encode.token_ids(F.col("text"))).withColumn("back", encode.token_text(F.col("ids")))
    assert back.where("back <> text").count() == 0 and back.count() == len(TEXTS)
    assert encode.encode_corpus(df.limit(0)).count() == 0


def test_broken_ids_decode_to_something(spark):
    df = spark.createDataFrame([([255],), (None,), ([],)], "ids array<int>")
    assert len([r[0] for r in df.select(encode.token_text(F.col("ids"))).collect()]) == 3
