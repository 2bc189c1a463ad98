"""Prediction on streams: row-local, so stateless, in append mode and without a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from glyphmill.functions.vectorised import Functions


def predict_stream(df: DataFrame, functions: Functions, text_col: str = "text", k: int = 1, threshold: float = 0.0) -> DataFrame:
    """The stream with a column of predictions."""
    return functions.predict(df, text_col, k, threshold)


def run_to_end(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes what is available now as Parquet and waits for it."""
    query = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return query
