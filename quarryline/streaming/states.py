"""What becomes of files, as a stream with state: one digest a path, which expires.

A row is a sight of a file: its path, a digest of its contents, when. A path that
has not been seen is ``added``, one whose digest differs ``changed``, each once;
one that has not been seen for the time given is ``expired`` and forgotten, so that
state does not grow with all paths there ever were. A restart goes on from the
stream's checkpoint.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "path string, state string, digest string, at timestamp"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FileStates(StatefulProcessor):
    def __init__(self, expire_seconds: int) -> None:
        self.expire_ms = 1000 * expire_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "digest string, seen long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803  Spark's names
        sights = sorted(((r["at"], r["digest"]) for r in rows), key=lambda s: (s[0], s[1] is None, s[1] or ""))  # of one path in one batch
        digest, seen = last = self.held.get() or (None, None)
        for at, now in sights:
            ms = int(at.timestamp() * 1000)
            if seen is None or now != digest:
                yield Row(path=key[0], state="added" if seen is None else "changed", digest=now, at=at)
            digest, seen = now, max(ms, seen or ms)
        if (digest, seen) != tuple(last):
            self.held.update((digest, seen))
        self._wait(last[1], seen)

    def _wait(self, before: int | None, seen: int) -> None:
        """One timer a path, moved on with each later sight. The state says when it was set for, which saves a call for their list."""
        if before != seen:
            if before is not None:
                self.handle.deleteTimer(before + self.expire_ms)
            self.handle.registerTimer(seen + self.expire_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        digest, seen = self.held.get()
        self.held.clear()
        yield Row(path=key[0], state="expired", digest=digest, at=datetime.datetime.fromtimestamp(seen / 1000))

    def close(self) -> None:
        pass


def file_states(sights: DataFrame, expire_seconds: int, late_seconds: int = 0) -> DataFrame:
    """``path, state, digest, at`` of a stream ``path, digest, at``, added, changed or expired; ``late_seconds`` is how far out of order sights may come.

    Sights of a path are taken in the order of their time within a batch; null
    paths do not count.
    """
    spark = sights.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    rows = sights.select("path", "digest", "at").where("path is not null and at is not null").withWatermark("at", f"{late_seconds} seconds")
    return rows.groupBy("path").transformWithState(FileStates(expire_seconds), outputStructType=OUT, outputMode="Append", timeMode="EventTime")


def run(states: DataFrame, path: str, checkpoint: str) -> None:
    """Appends what is new to Parquet files at ``path`` and ends with the stream's present input."""
    query = states.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
