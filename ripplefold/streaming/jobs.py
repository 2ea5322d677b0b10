"""The job queue over a stream of deliveries.

The state of a pull request is its latest delivery, so a newer one supersedes it. A delivery that comes again changes
nothing, and one that comes late, however late, is superseded by the newer one at once: no row is dropped, and no watermark
is needed. The state holds one delivery of each pull request; a polling worker forgets those that are quiet for
``QUIET_DAYS``. A single pass over what is there has no time to wait for, so it forgets none.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def unique_deliveries(deliveries: DataFrame, key: str = "delivery_id", ts: str = "created_at", delay: str = "2 hours") -> DataFrame:
    """Deliveries once within the watermark, for senders that repeat themselves within it; later rows are dropped."""
    return deliveries.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


#: Days without a delivery after which a pull request is forgotten.
QUIET_DAYS = 30
CHANGES = "owner string, repo string, pull_number int, delivery_id string, state string, superseded_by string"


def _advance(quiet_days: int | None, key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    columns = ["owner", "repo", "pull_number", "delivery_id", "state", "superseded_by"]
    if state.hasTimedOut:
        state.remove()
        yield pd.DataFrame([], columns=columns)
        return
    latest = state.get if state.exists else (None, None)
    rows = []
    batch = pd.concat(list(frames)).sort_values(["created_at", "delivery_id"])
    for delivery, at in zip(batch["delivery_id"], batch["created_at"]):
        stamp = int(pd.Timestamp(at).value)
        if latest[0] == delivery:
            continue
        if latest[0] is None or (stamp, delivery) > (latest[1], latest[0]):
            if latest[0] is not None:
                rows.append((*key, latest[0], "superseded", delivery))
            latest = (delivery, stamp)
            rows.append((*key, delivery, "pending", None))
        else:
            rows.append((*key, delivery, "superseded", latest[0]))
    state.update(latest)
    if quiet_days:
        state.setTimeoutDuration(quiet_days * 86_400_000)
    yield pd.DataFrame(rows, columns=columns)


def queue_changes(deliveries: DataFrame, quiet_days: int | None = None) -> DataFrame:
    """(owner, repo, pull_number, delivery_id, state, superseded_by): every change of state, in append mode.

    A delivery that was superseded once stays so; a pull request keeps one delivery in state, or none after
    ``quiet_days`` without a delivery, which only a polling worker may ask for.
    """
    timeout = GroupStateTimeout.ProcessingTimeTimeout if quiet_days else GroupStateTimeout.NoTimeout
    return deliveries.groupBy("owner", "repo", "pull_number").applyInPandasWithState(functools.partial(_advance, quiet_days), CHANGES, "delivery string, stamp bigint", "append", timeout)


def by_batch(root: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes each batch to a folder of its number, so a batch that is run again replaces itself."""
    return lambda batch, number: batch.write.mode("overwrite").parquet(f"{root}/batch={number}")


def final_states(changes: DataFrame) -> DataFrame:
    """(delivery_id, state) of each delivery after all ``changes``, whatever their order."""
    gone = F.max((F.col("state") == "superseded").cast("int"))
    return changes.groupBy("delivery_id").agg(F.when(gone == 1, "superseded").otherwise("pending").alias("state"))


def drain(changes: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, poll_seconds: int | None = None, at_start: Callable[[], None] | None = None) -> StreamingQuery:
    """Start a worker: ``sink(batch, number)`` gets each batch; one pass over what is there unless polling is asked.

    ``at_start`` runs first, to give stale jobs back to the queue. A worker that already drains into the checkpoint is
    returned as it is, so two never run at once.
    """
    name = "drain-" + hashlib.sha256(checkpoint.encode()).hexdigest()[:16]
    for running in changes.sparkSession.streams.active:
        if running.name == name:
            return running
    if at_start is not None:
        at_start()
    writer = changes.writeStream.queryName(name).foreachBatch(sink).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=f"{poll_seconds} seconds") if poll_seconds else writer.trigger(availableNow=True)
    return writer.start()
