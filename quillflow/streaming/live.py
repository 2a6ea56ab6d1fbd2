"""Live import: the same pipelines over Structured Streaming.

All handlers are stateless on a stream; children are unrolled to the pipeline's depth when the plan is built. The field
report is the one aggregate, kept up to date in complete mode.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import model
from ..operators.base import blank
from ..plans.flow import Pipeline


def start(docs: DataFrame, pipeline: Pipeline, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Imports a stream of documents into Parquet, with statuses; exactly once by the sink's log."""
    out = pipeline.run(docs).select("reference", "depth", "child_index", "content", F.to_json("metadata").alias("metadata"), model.status().alias("status"))
    writer = out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def each_batch(docs: DataFrame, pipeline: Pipeline, handle: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Response processors over a stream: a function of each micro-batch of imported documents."""
    writer = pipeline.run(docs).writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def report(docs: DataFrame, max_samples: int = 3) -> DataFrame:
    """The field report of a stream: occurrences and the least distinct samples, for complete mode."""
    flat = docs.filter(model.active()).select(F.explode("metadata").alias("field", "v"))
    kept = F.filter("v", lambda s: ~blank(s))
    return flat.groupBy("field").agg(F.count("*").alias("occurrences"), F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_set(kept)))), 1, max_samples).alias("samples"))


