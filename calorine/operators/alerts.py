"""The notification queue."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from calorine.functions import scalar as S

QUEUE_SIZE, SPACING_MS, BACKOFF_MS, BACKOFF_MOST_MS = 20, 2_000, 15_000, 600_000


def admit(requests: DataFrame, enabled: bool = True, online: bool = True, size: int = QUEUE_SIZE) -> DataFrame:
    """What enters the queue: messages that aren't empty, in order of arrival, the first ``size`` of them.

    Disabled: none; offline: only those that may be cached.  The cap is the feature.
    """
    wanted = requests.where("coalesce(message, '') <> ''")
    if not enabled:
        wanted = wanted.where(F.lit(False))
    if not online:
        wanted = wanted.where("cache")
    return wanted.orderBy("arrival", "seq").limit(size)


def next_due(queue: DataFrame, now_ms: int) -> DataFrame:
    """The item to send: due, alerts before summaries, then the earliest, then the first to arrive."""
    return queue.where(F.col("next_attempt_ms") <= now_ms).orderBy("is_summary", "next_attempt_ms", "arrival").limit(1)


def after_failure(queue: DataFrame, now_ms: int) -> DataFrame:
    """Next attempt after the present backoff, which doubles up to its cap."""
    return queue.withColumns({"next_attempt_ms": F.lit(now_ms) + F.col("backoff_ms"), "backoff_ms": F.least(F.col("backoff_ms") * 2, F.lit(BACKOFF_MOST_MS))})


def retry_schedule(requests: DataFrame, attempts: int) -> DataFrame:
    """When each failed attempt of a request is followed by the next."""
    steps = requests.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(attempts - 1))))
    steps = steps.withColumn("backoff_ms", S.backoff(BACKOFF_MS, F.col("attempt"), BACKOFF_MOST_MS))
    before = Window.partitionBy("seq", "arrival").orderBy("attempt").rowsBetween(Window.unboundedPreceding, 0)
    return steps.withColumn("next_attempt_ms", F.col("arrival") + F.sum("backoff_ms").over(before))


def deliver(batch: DataFrame, send: Callable[[str, str], bool]) -> DataFrame:
    """Try each request of a micro-batch once; (seq, ok) of each.  ``send`` posts (title, message).

    A request with seq 0 needs no acknowledgement.  For ``foreachBatch``; failed ones go back to the retry table.
    """

    def attempt(rows):
        for pdf in rows:
            yield pdf.assign(ok=[bool(send(t or "", m)) for t, m in zip(pdf["title"], pdf["message"])])[["seq", "ok"]]

    return batch.select("seq", "title", "message").mapInPandas(attempt, "seq bigint, ok boolean")
