"""The ledger as state of a stream: outcomes of attempts come in, in any order, and what is known of each file goes out.

Each file of a collection has a state of its own: when it was last done, with which content, and the times of the
failures after that. So an attempt told late, or twice, changes nothing that a table of all attempts
would not say. The state of a file that failed has a timer; when event time passes it, the file is told as due
again, once for each failure. A file of which nothing was heard for `forget` is dropped from the state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "path string, collection string, hash string, status string, retry_count int, us long, event string"
STATE = "done long, hash string, failed_hash string, failures array<long>, told boolean"
#: Before any time that a row has.
NEVER = -(1 << 62)


def ledger_stream(attempts: DataFrame, late: str = "1 hour", retry_after: str = "10 minutes", forget: str = "30 days", most: int = 3) -> DataFrame:
    """path, collection, hash, status, retry_count, at, event of a stream of attempts (path, collection, hash, status, at).

    Event `status` rows tell how a file stands after what a batch brought; the last of a file is its ledger row. A `retry`
    row tells that a failed file is due again, if it failed fewer than `most` times since it was last done. Status is
    `failed` or anything else, which counts as done. Rows without a path, collection, status or time are left out, and so
    are those that come more than `late` behind the newest of an earlier batch.
    """
    wait, keep_for = (int(pd.Timedelta(x).total_seconds() * 1e6) for x in (retry_after, forget))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, hash_, failed_hash, failures, told = state.get if state.exists else (NEVER, None, None, [], False)
        failures = set(() if failures is None else map(int, failures))
        row = lambda event: pd.DataFrame({"path": [key[0]], "collection": [key[1]], "hash": [failed_hash if failures else hash_], "status": ["failed" if failures else "indexed"], "retry_count": [len(failures)], "us": [max(failures) if failures else done], "event": [event]})
        if state.hasTimedOut:
            if failures and not told and len(failures) < most:
                yield row("retry")
                state.update((done, hash_, failed_hash, sorted(failures), True))
                state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, (max(failures) + keep_for) // 1000))
            else:
                state.remove()
            return
        last = max(failures, default=NEVER)
        for rows in batches:
            for at, status, hashed in zip(rows["us"].tolist(), rows["status"], rows["hash"]):
                if status != "failed":
                    # of two that were done at once the greater content stands
                    if (at, hashed or "") > (done, hash_ or ""):
                        done, hash_ = at, hashed
                elif at > done:
                    if (at, hashed or "") >= (max(failures, default=NEVER), failed_hash or ""):
                        failed_hash = hashed
                    failures.add(at)
        failures = {at for at in failures if at > done}
        told = told and max(failures, default=NEVER) == last
        state.update((done, hash_, failed_hash if failures else None, sorted(failures), told))
        due = max(failures) + wait if failures and not told and len(failures) < most else max([done, *failures]) + keep_for
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, due // 1000))
        yield row("status")

    timed = attempts.select("path", "collection", "hash", "status", F.col("at").cast("timestamp").alias("at"))
    sound = timed.where("path is not null and collection is not null and status is not null and at is not null")
    # times as numbers: what pandas is given would depend on the session's zone
    named = sound.withColumn("us", F.unix_micros("at")).withWatermark("at", late)
    told = named.groupBy("path", "collection").applyInPandasWithState(step, OUT, STATE, "update", GroupStateTimeout.EventTimeTimeout)
    return told.select("path", "collection", "hash", "status", "retry_count", F.timestamp_micros("us").alias("at"), "event")


def append_told(stream: DataFrame, target: str, checkpoint: str):
    """A query that writes what each batch tells into a folder of its own, so that a repeated batch replaces itself; `batch` orders them."""

    def add(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.outputMode("update").foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
