"""What a stream of fetches tells of each URL: a state for every URL, with late rows and expiry by event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

EVENTS = "url string, event string, fetched_at long, sha256 string, before string, seen long"
_STATE = "fetched_at long, sha256 string, seen long"


class Tracker(StatefulProcessor):
    """Keeps the last fetch of a URL, and tells of each row what it is.

    added: the first; changed or unchanged: later than the last, by its content; stale: not later, so the state stays; expired: nothing came for
    `ttl` seconds of event time after the last fetch, so the state goes.  Rows of a batch are taken in the order of their times.
    """

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = tuple(self.last.get()) if self.last.exists() else None
        began, out = known, []
        frames = [r for r in rows if len(r)]
        batch = pd.concat(frames).sort_values(["fetched_at", "sha256"]) if frames else pd.DataFrame({"fetched_at": [], "sha256": []})
        for at, sha in zip(batch["fetched_at"].tolist(), batch["sha256"].tolist()):
            seen = 1 + (known[2] if known else 0)
            if known and at <= known[0]:
                out.append((key[0], "stale", at, sha, known[1], seen))
                known = (known[0], known[1], seen)
            else:
                event = "added" if known is None else "unchanged" if known[1] == sha else "changed"
                out.append((key[0], event, at, sha, known[1] if known else None, seen))
                known = (at, sha, seen)
        if known is not None:
            self.last.update(known)
            if began is None or began[0] != known[0]:
                if began is not None:
                    self.handle.deleteTimer(self._due(began[0]))
                self.handle.registerTimer(self._due(known[0]))
        if out:
            yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.last.exists():
            at, sha, seen = self.last.get()
            if self._due(at) <= expiredTimerInfo.getExpiryTimeInMs():
                self.last.clear()
                yield _frame([(key[0], "expired", at, None, sha, seen)])

    def _due(self, fetched_at: int) -> int:
        return 1000 * (fetched_at + self.ttl)

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["url", "event", "fetched_at", "sha256", "before", "seen"])


def tracked(fetches: DataFrame, ttl: int, late: int) -> DataFrame:
    """The events of a stream of url, fetched_at (Unix seconds) and sha256; rows over `late` seconds behind the newest are dropped.

    The session's state store must be RocksDB (spark.sql.streaming.stateStore.providerClass).
    """
    timed = fetches.where("url is not null and fetched_at is not null").select("url", "fetched_at", F.coalesce("sha256", F.lit("")).alias("sha256"), F.timestamp_seconds("fetched_at").alias("at"))
    keyed = timed.withWatermark("at", f"{late} seconds").groupBy("url")
    return keyed.transformWithStateInPandas(Tracker(ttl), outputStructType=EVENTS, outputMode="Append", timeMode="EventTime")


def track(fetches: DataFrame, folder: str, checkpoint: str, ttl: int, late: int) -> StreamingQuery:
    """Runs the stream to its end now and adds its events to a folder of Parquet files, each once."""
    spark = fetches.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    events = tracked(fetches, ttl, late)
    return events.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def standing(events: DataFrame) -> DataFrame:
    """url, fetched_at, sha256 and seen of the URLs that the events leave: not those that expired since."""
    kept = events.where("event != 'stale'")
    last = kept.groupBy("url").agg(F.max(F.struct("fetched_at", (F.col("event") == "expired").alias("gone"), "sha256")).alias("s"))
    seen = events.groupBy("url").agg(F.count_if(F.col("event") != "expired").alias("seen"))
    return last.where("not s.gone").select("url", "s.fetched_at", "s.sha256").join(seen, "url")
