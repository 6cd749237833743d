"""Articles that arrive as files, resolved batch by batch with a structured stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.schema import SCHEMAS


def article_stream(spark: SparkSession, folder: str, per_trigger: int = 100) -> DataFrame:
    """JSON lines of articles as they arrive in ``folder``."""
    return spark.readStream.schema(SCHEMAS["articles"]).option("maxFilesPerTrigger", per_trigger).json(folder)


def resolve_stream(articles: DataFrame, resolve: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> StreamingQuery:
    """Runs ``resolve`` on each batch of new articles and appends its decisions to ``sink``, a folder for each batch.

    A batch that runs again after a failure overwrites its own folder, so decisions stand once.
    """

    def step(batch: DataFrame, number: int) -> None:
        resolve(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return articles.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
