"""Decoding of a stream of words (an addition: the batch operators are the same)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lexiforge.operators import models


def decode_stream(words: DataFrame, scorer: models.TransducerScorer) -> DataFrame:
    """Best outputs of a streaming DataFrame (word_id, word). Stateless, so no watermark is needed."""
    return models.transduce(words, scorer)


def segment_stream(stream: DataFrame, out: str, checkpoint: str, each_batch):
    """Start a query that writes each_batch(words of a micro-batch) to Parquet, a folder for each batch, so that a batch that is
    run again replaces itself."""
    return stream.writeStream.foreachBatch(lambda df, k: each_batch(df).write.mode("overwrite").parquet(f"{out}/batch={k}")).option("checkpointLocation", checkpoint).start()
