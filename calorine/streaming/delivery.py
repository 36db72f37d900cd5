"""The notification queue on streams: stored, retried, acknowledged at least once.

A queue holds at most twenty requests.  Its state after micro-batch N is a table of its own, so a batch that is tried again starts from
the state before it, sends again what it had sent, and writes the same folders.  What was sent, and what was dropped when the queue was full,
is kept by batch likewise.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calorine.operators.alerts import BACKOFF_MOST_MS, BACKOFF_MS, QUEUE_SIZE, SPACING_MS
from calorine.sources.shared import batch_before, delete, scope, written

#: kind: waiting (state), sent (an attempt, ok or not), dropped (no room), clock (a queue's last attempt, state).
EVENTS = "queue bigint, kind string, seq bigint, arrival bigint, is_summary boolean, title string, message string, attempt int, backoff_ms bigint, next_attempt_ms bigint, at_ms bigint, ok boolean"
NAMES = [c.split()[0] for c in EVENTS.split(", ")]
#: Sends (title, message, attempt from 1) and tells whether that was accepted.
Sender = Callable[[str, str, int], bool]


class _Queue:
    """One queue in time order: waiting requests as dicts, and when it last tried one."""

    def __init__(self, send: Sender):
        self.send, self.waiting, self.last = send, [], None

    def until(self, now_ms: int) -> Iterator[dict]:
        """The attempts due up to a time: one every two seconds at most, alerts first, then the earliest due, then the first to arrive."""
        while self.waiting:
            at = min(w["next_attempt_ms"] for w in self.waiting)
            if self.last is not None:
                at = max(at, self.last + SPACING_MS)
            if at > now_ms:
                return
            due = min((w for w in self.waiting if w["next_attempt_ms"] <= at), key=lambda w: (w["is_summary"], w["next_attempt_ms"], w["arrival"], w["seq"]))
            self.last, due["attempt"] = at, due["attempt"] + 1
            ok = bool(self.send(due["title"] or "", due["message"], due["attempt"]))
            yield due | {"kind": "sent", "at_ms": at, "ok": ok}
            if ok:
                self.waiting.remove(due)
            else:
                due["next_attempt_ms"] = at + due["backoff_ms"]
                due["backoff_ms"] = min(2 * due["backoff_ms"], BACKOFF_MOST_MS)

    def admit(self, request: dict) -> dict | None:
        """The request waits, or is dropped if twenty do."""
        if len(self.waiting) >= QUEUE_SIZE:
            return request | {"kind": "dropped"}
        self.waiting.append(request | {"kind": "waiting", "attempt": 0, "backoff_ms": BACKOFF_MS, "next_attempt_ms": request["arrival"]})
        return None


def run_queues(state: DataFrame, requests: DataFrame, now_ms: int, send: Sender) -> DataFrame:
    """The events of the queues when ``requests`` (queue, seq, arrival, is_summary, title, message) come to ``state``, up to ``now_ms``.

    Requests without a message or a queue don't count; those of a time come before that time's attempts.  A queue's state goes first, then its requests in order of arrival, streaming through a task
    a batch at a time; a queue holds no more than its twenty requests.
    """

    def walk(stream: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, queue, out = None, _Queue(send), []

        def close() -> list[dict]:
            ended = list(queue.until(now_ms)) if key is not None else []
            ended += queue.waiting
            if queue.last is not None:
                ended.append({"kind": "clock", "at_ms": queue.last})
            return [e | {"queue": key} for e in ended]

        for rows in stream:
            for row in rows.to_dict("records"):
                if row["queue"] != key:
                    out += close()
                    key, queue = row["queue"], _Queue(send)
                if row["kind"] == "clock":
                    queue.last = int(row["at_ms"])
                elif row["kind"] == "waiting":
                    queue.waiting.append({n: row[n] for n in ("kind", "seq", "arrival", "is_summary", "title", "message", "attempt", "backoff_ms", "next_attempt_ms")})
                else:
                    request = {n: row[n] for n in ("seq", "arrival", "is_summary", "title", "message")}
                    found = [dict(e) for e in queue.until(request["arrival"] - 1)]
                    found += [e] if (e := queue.admit(request)) else []
                    out += [e | {"queue": key} for e in found]
            if len(out) > 5_000:
                yield frame(out)
                out = []
        yield frame(out + close())

    def frame(events: list[dict]) -> pd.DataFrame:
        return pd.DataFrame({n: pd.Series([e.get(n) for e in events], dtype=object) for n in NAMES})

    new = requests.where("coalesce(message, '') <> '' AND queue IS NOT NULL").select("queue", "seq", "arrival", "is_summary", "title", "message")
    rows = state.withColumn("place", F.lit(0)).unionByName(new.withColumn("place", F.lit(1)), allowMissingColumns=True)
    # Numbers of state rows are filled in, so that pandas keeps whole numbers.
    whole = [F.coalesce(F.col(n), F.lit(0)).cast("long").alias(n) for n in ("seq", "arrival", "attempt", "backoff_ms", "next_attempt_ms", "at_ms")]
    ordered = rows.select("queue", "place", "kind", F.coalesce("is_summary", F.lit(False)).alias("is_summary"), "title", "message", *whole)
    ordered = ordered.repartition("queue").sortWithinPartitions("queue", "place", "arrival", "seq")
    return ordered.mapInPandas(walk, EVENTS)


class DeliverySink:
    """A micro-batch sink: ``spark.writeStream.foreachBatch(DeliverySink(path, send))``.

    The clock of a batch is the latest arrival seen so far, so a run can be repeated; attempts due later wait for the next batch or for ``drain``.
    """

    def __init__(self, path: str, send: Sender):
        self.path, self.send = path, send

    def _before(self, spark: SparkSession, batch_id: int) -> tuple[DataFrame, int]:
        """The state and clock that the batch before left, whatever this one has written."""
        last = batch_before(spark, f"{self.path}/events", batch_id)
        if last is None:
            return spark.createDataFrame([], EVENTS), 0
        stored = spark.read.schema(EVENTS).parquet(f"{self.path}/events/batch={last}")
        return stored.where("kind IN ('waiting', 'clock')"), stored.agg(F.max(F.when(F.col("kind") == "now", F.col("at_ms")))).first()[0] or 0

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        state, clock = self._before(batch.sparkSession, batch_id)
        with scope(batch.sparkSession):
            rows = written(batch.select("queue", "seq", "arrival", "is_summary", "title", "message"), "requests")  # read twice, computed once
            latest = rows.agg(F.max("arrival")).first()[0]
            self._step(state, rows, batch_id, max(clock, latest or 0))

    def _step(self, state: DataFrame, batch: DataFrame, batch_id: int, now_ms: int) -> None:
        now = state.sparkSession.createDataFrame([("now", now_ms)], "kind string, at_ms bigint")
        events = run_queues(state, batch, now_ms, self.send).unionByName(now, allowMissingColumns=True)
        events.write.mode("overwrite").parquet(f"{self.path}/events/batch={batch_id}")

    def drain(self, spark: SparkSession, batch_id: int, now_ms: int) -> None:
        """A tick without requests: what is due up to ``now_ms`` is tried."""
        state, _ = self._before(spark, batch_id)
        none = spark.createDataFrame([], "queue bigint, seq bigint, arrival bigint, is_summary boolean, title string, message string")
        self._step(state, none, batch_id, now_ms)

    def events(self, spark: SparkSession) -> DataFrame:
        """All that was sent or dropped, and what waited after each batch."""
        return spark.read.schema(EVENTS + ", batch int").parquet(f"{self.path}/events")

    def forget(self, spark: SparkSession, below: int) -> None:
        """Delete what batches before ``below`` have left, once it is of no more use."""
        for r in self.events(spark).where(F.col("batch") < below).select("batch").distinct().collect():
            delete(spark, f"{self.path}/events/batch={r['batch']}")
