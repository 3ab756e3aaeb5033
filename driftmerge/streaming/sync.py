"""Incremental exchange: cursors over a transport, and change streams merged by micro-batches."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from driftmerge.functions.staging import fresh, stage
from driftmerge.operators import merge
from driftmerge.operators.feed import newest, since
from driftmerge.replica import Replica
from driftmerge.sources import files, payload
from driftmerge.sources.transport import Transport


def has_unsent(replica: Replica) -> bool:
    """Whether a local change is newer than what was sent."""
    last = replica.changes().where(F.col("site_id") == F.lit(replica.site_id)).agg(F.max("db_version")).first()[0]
    return (last or 0) > replica.cursor("send_dbversion")


def send(replica: Replica, transport: Transport) -> int:
    """Upload local changes after the cursor; how many. The cursor moves last, so an upload that breaks off is done again."""
    feed = replica.changes()
    fresh_ones = stage(feed.where(F.col("site_id") == F.lit(replica.site_id)).where(since(replica.cursor("send_dbversion"), replica.cursor("send_seq"))))
    count = fresh_ones.count()
    if count:
        transport.upload(payload.encode(fresh_ones, replica.schemas.current), replica.site_id)
    at = newest(feed).first()
    replica.set_cursors(send_dbversion=at["db_version"], send_seq=at["seq"])
    return count


def check(replica: Replica, transport: Transport, allowed=None) -> int:
    """Merge what other replicas have uploaded since; how many changes came in. Batches count as received once merged.

    Payloads and changes that can't be read are skipped; ``replica.report`` has their numbers.
    """
    batches = transport.pending(replica.site_id, replica.received)
    if not batches:
        return 0
    changes = stage(payload.decode(transport.download(batches), accepted=replica.schemas.hashes, skip=True))
    got = replica.apply(changes, allowed)
    last = replica.received
    for site, number in batches:
        last[site] = max(number, last.get(site, 0))
    replica.set_received(last)
    return got


def sync(replica: Replica, transport: Transport, wait_ms: int = 100, retries: int = 1, allowed=None) -> int:
    """send(), then check() until something came in or the retries are used up."""
    send(replica, transport)
    for attempt in range(max(1, retries)):
        if got := check(replica, transport, allowed):
            return got
        if attempt + 1 < retries:
            time.sleep(wait_ms / 1000)
    return 0


def reset(replica: Replica) -> None:
    """Zero the cursors, so everything is sent and read again; merging twice changes nothing."""
    replica.set_cursors(send_dbversion=0, send_seq=0)
    replica.set_received({})


def logout(replica: Replica) -> None:
    """Forget all rows, clocks and cursors; the same tables are replicated afterwards, empty, under a new site id."""
    specs, spark, path = replica.specs, replica.spark, replica.path
    replica.cleanup("*")
    again = Replica(spark, path)
    for spec in specs:
        again.enable(spec, spark.createDataFrame([], spec.schema), force=True)
    replica.__dict__.update(again.__dict__)


class StreamMerge:
    """State that a stream of changes is merged into, as one Parquet folder for each micro-batch.

    A micro-batch starts from the newest complete state before its own number and overwrites its own folder, so one that is
    run again after a failure counts once, and a stream that is started again at the same path goes on. Earlier states are
    left to be cleaned up.
    """

    def __init__(self, spark: SparkSession, key: list[str], columns: list[str], path: str | None = None):
        self.spark, self.key, self.columns = spark, key, columns
        self.path = path or fresh(spark, "stream")

    def _last(self, before: int | None = None) -> int | None:
        found = [int(n.removeprefix("state-")) for n in files.names(self.spark, self.path) if n.startswith("state-") and files.exists(self.spark, f"{self.path}/{n}/_SUCCESS")]
        return max((n for n in found if before is None or n < before), default=None)

    def _batch(self, changes: DataFrame, number: int) -> None:
        changes = changes.select(*self.key, *merge.CHANGE)
        last = self._last(number)
        known = changes if last is None else self.spark.read.schema(changes.schema).parquet(f"{self.path}/state-{last}").unionByName(changes)
        won = merge.cells(merge.merged(known, self.key, self.columns), self.key, self.columns)
        won.select(*self.key, *merge.CHANGE).write.mode("overwrite").parquet(f"{self.path}/state-{number}")

    def state(self) -> DataFrame:
        """The changes that hold after the last micro-batch."""
        return self.spark.read.parquet(f"{self.path}/state-{self._last()}")

    def start(self, changes: DataFrame) -> StreamingQuery:
        """Merge a stream of changes as far as it has come, then stop."""
        return changes.writeStream.foreachBatch(self._batch).option("checkpointLocation", f"{self.path}/checkpoint").trigger(availableNow=True).start()
