"""Streams of documents and conversation turns."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from textloom.operators.text import ingested

HISTORY = 20


def document_stream(spark: SparkSession, folder: str) -> DataFrame:
    """New text files of a folder as documents; the path is the id."""
    return spark.readStream.format("text").option("wholetext", "true").load(folder).select(F.col("value").alias("text"), F.input_file_name().alias("doc_id"))


def ingest(documents: DataFrame, out: str, checkpoint: str):
    """Chunk, redact, score and store what has arrived, then stop; files already taken are not taken again."""
    rows = ingested(documents.select("doc_id", "text"))
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def history(turns: DataFrame, keep: int = HISTORY) -> DataFrame:
    """(conv_id, turns, last_text): the last ``keep`` changed turns of each conversation as state, updated as turns arrive."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        texts = list(state.get[0]) if state.exists else []
        for batch in batches:
            for text in batch.sort_values("turn")["text"]:
                if text is not None and (not texts or texts[-1] != text):
                    texts.append(text)
        texts = texts[-keep:]
        state.update((texts,))
        yield pd.DataFrame({"conv_id": [key[0]], "turns": [len(texts)], "last_text": [texts[-1] if texts else None]})

    return turns.select("conv_id", "turn", "text").groupBy("conv_id").applyInPandasWithState(
        update, "conv_id long, turns int, last_text string", "texts array<string>", "update", GroupStateTimeout.NoTimeout
    )
