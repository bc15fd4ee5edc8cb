"""The revision chain of a page feed as keyed state of a stream.

Each page has a state of its own: the contents that it has had, its pointer, and
when it was first and last seen. A batch touches the states of its own pages only,
so its work does not grow with what was stored before; ``reverse.ingest`` reads
stored tables instead. Order is that of arrival: batches one after the other, and
within a batch by seq.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

#: What an arrival tells, and the page's state after it; ``arrival`` counts a page's arrivals from 1.
CHAIN = (
    "page_id string, seq long, revision_id string, content_sha256 string, changed boolean, pointer_before string, arrival long, first_seen long, last_seen long"
)
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class PageState(StatefulProcessor):
    """State: ``seen``, a page's contents and their revisions; ``page``, its pointer, times in microseconds and count of arrivals."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._seen = handle.getMapState("seen", "content_sha256 string", "revision_id string")
        self._page = handle.getValueState("page", "revision_id string, first_seen long, last_seen long, arrivals long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """A batch's arrivals of a page, one after the other."""
        arrived = pd.concat(list(rows)).sort_values("seq", kind="stable")
        pointer, first, last, count = self._page.get() or (None, None, None, 0)
        fresh: dict[str, str] = {}
        out = []
        for seq, revision, content, at in zip(arrived["seq"], arrived["revision_id"], arrived["content_sha256"], arrived["at"], strict=True):
            changed = content not in fresh and not self._seen.containsKey((content,))
            if changed:
                fresh[content] = revision
                self._seen.updateValue((content,), (revision,))
            first, last, count = (at if count == 0 else first), at, count + 1
            out.append((key[0], seq, revision, content, changed, pointer, count, first, last))
            pointer = revision
        self._page.update((pointer, None if pd.isna(first) else int(first), None if pd.isna(last) else int(last), count))
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in CHAIN.split(", ")])
        yield frame.astype({"arrival": "int64", "first_seen": "Int64", "last_seen": "Int64"})

    def close(self) -> None:
        pass


def keeps_state(spark: SparkSession) -> None:
    """Keyed state of this kind lives in RocksDB, on disk and in changelogs under the checkpoint, not in a task's memory."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def chain(arrived: DataFrame) -> DataFrame:
    """A stream of arrivals, as ``pages.arrivals`` makes them, as a stream of chain rows in append mode."""
    keeps_state(arrived.sparkSession)
    slim = arrived.select("page_id", F.col("seq").cast("long"), "revision_id", "content_sha256", F.unix_micros("fetched_at").alias("at"))
    rows = slim.groupBy("page_id").transformWithStateInPandas(PageState(), CHAIN, "append", "None")
    times = {c: F.timestamp_micros(F.col(c)) for c in ("first_seen", "last_seen")}
    return rows.withColumns(times)


def start(arrived: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the chain of a stream of arrivals to files at ``path``, each batch once, and stop when all that is there has come."""
    return chain(arrived).writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(rows: DataFrame) -> DataFrame:
    """(page_id, latest_revision_id, first_seen_at, last_seen_at, arrivals) after all rows of a chain."""
    last = F.max_by(F.struct("revision_id", "first_seen", "last_seen", "arrival"), "arrival").alias("p")
    return rows.groupBy("page_id").agg(last).select(
        "page_id", F.col("p.revision_id").alias("latest_revision_id"), F.col("p.first_seen").alias("first_seen_at"), F.col("p.last_seen").alias("last_seen_at"), F.col("p.arrival").alias("arrivals")
    )
