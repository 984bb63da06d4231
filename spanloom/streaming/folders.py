"""The folder-to-folder driver as a file stream: each new token file is cleaned once.

De-duplication happens inside the document row, so it needs no streaming state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from spanloom.operators.lines import LOOK_BACK_PASSES, dedupe_docs
from spanloom.sources.readers import parse_line_docs
from spanloom.sources.sinks import line_text


def stream_line_docs(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, tokens, tags`` of the ``.txt`` token files that arrive in ``folder``."""
    return parse_line_docs(spark.readStream.option("pathGlobFilter", "*.txt").text(folder, wholetext=True), folder)


def clean_folder(spark: SparkSession, source: str, target: str, checkpoint: str,
                 passes: tuple[int, ...] = LOOK_BACK_PASSES) -> StreamingQuery:
    """Start a query that writes the cleaned lines of all files not yet processed, then stops.

    ``checkpoint`` remembers what has been processed; it belongs to ``target``, so pass the same
    one for every run.
    """
    lines = dedupe_docs(stream_line_docs(spark, source), passes).select("doc_id", line_text().alias("value"))
    return (lines.writeStream.format("text").partitionBy("doc_id").outputMode("append")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start(target))
