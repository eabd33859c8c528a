"""Change detection with the state API: a value per key, a time to live, and timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "site string, status string, content_hash string"


class ChangeDetector(StatefulProcessor):
    """Keeps a key's last snapshot and content hash; emits a row each time the hash changes.

    With ``forget_after`` (milliseconds) a key that is not written for so long is
    forgotten, and new when it comes again. With ``silent_after`` a key for which
    nothing lands for so long is reported once as silent.
    """

    def __init__(self, forget_after: int | None = None, silent_after: int | None = None):
        self.forget_after, self.silent_after = forget_after, silent_after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "snapshot long, content_hash string", self.forget_after)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen, last = self.last.get() if self.last.exists() else (None, None)
        taken = ((int(n), h) for part in rows for n, h in zip(part["snapshot"], part["content_hash"].astype(object).where(part["content_hash"].notna(), None)))
        found = sorted(taken, key=lambda row: (row[0], row[1] is not None, row[1] or ""))
        out = []
        for snapshot, content in found:
            if seen is not None and snapshot < seen:
                continue  # a snapshot that lands after a newer one says nothing new
            if seen is None or content != last:
                out.append(("new" if seen is None else "updated", content))
            seen, last = snapshot, content
        if seen is not None:
            self.last.update((seen, last))
        if self.silent_after is not None:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.silent_after)
        if out:
            yield pd.DataFrame({"site": key[0], "status": [s for s, _ in out], "content_hash": [h for _, h in out]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"site": [key[0]], "status": ["silent"], "content_hash": [None]})

    def close(self) -> None:
        pass


def detect_changes(crawl: DataFrame, key: str, forget_after: int | None = None, silent_after: int | None = None) -> DataFrame:
    """New and updated keys of a stream of crawled records.

    ``snapshot`` numbers the crawls. Rows of a key are taken in that order, so a
    backlog of crawls gives what a run after each of them gives. A key has one row a
    crawl, which bounds its group; state holds one value a key. The state API asks for
    the RocksDB store, which ``runner.run_available`` sets.
    """
    timed = forget_after is not None or silent_after is not None
    return crawl.select(key, "snapshot", "content_hash").groupBy(key).transformWithStateInPandas(
        ChangeDetector(forget_after, silent_after), outputStructType=OUTPUT, outputMode="Update", timeMode="ProcessingTime" if timed else "None"
    )
