"""Incremental scoring as a stream: new runs are scored as their files arrive, and appended once.

The compared library skips runs that its score table already holds; as a stream, the same
rule makes a replayed batch harmless.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.tables import append_scores, unscored


def score_as_they_come(runs: DataFrame, score: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, key: list[str]) -> StreamingQuery:
    """Start a query that scores each batch of ``runs`` (a streaming table) and appends what is new to ``path``."""

    def batch(df: DataFrame, _: int) -> None:
        spark = df.sparkSession
        fresh = score(df)
        try:
            known = spark.read.schema(fresh.schema).parquet(path)
        except Exception as e:  # no score yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            append_scores(fresh, path)
            return
        append_scores(unscored(fresh, known, key), path)

    return runs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
