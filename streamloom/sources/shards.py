"""Shards of a run: started together as barrier tasks, or waited for where they were started elsewhere."""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable

import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame, SparkSession

from .runs import done_ranks

STATUS = "rank int, status string, error string, seconds double, done int"


class ShardsMissing(TimeoutError):
    """Shards that had not been written to their end when the time was over."""

    def __init__(self, missing: list[int]) -> None:
        super().__init__(f"shards {missing} are missing")
        self.missing = missing


def run_shards(spark: SparkSession, ranks: int, work: Callable[[int, int], None], timeout: float) -> DataFrame:
    """Run work(rank, ranks) once for each rank, all at the same time on executors; a row for each: rank, status, error, seconds, done.

    The tasks form a barrier: each tells the others how it ended, so every row knows how many are done, and nothing goes
    on before all have ended. status is "done", "failed" with the error, or "timeout" for work that takes longer than
    timeout seconds; a shard that fails does not take the others with it. A lost executor starts all of them again, so
    work must be able to go on where it stopped, as runs by key do. The cluster needs a free core for each rank.
    """

    def run(batches):
        for batch in batches:
            for rank in batch.column(0).to_pylist():
                found: list[str | None] = []

                def one(r=rank, out=found):
                    try:
                        work(r, ranks)
                        out.append(None)
                    except Exception as e:  # noqa: BLE001  (told to all)
                        out.append(f"{type(e).__name__}: {e}")

                began = time.monotonic()
                thread = threading.Thread(target=one, daemon=True)
                thread.start()
                thread.join(timeout)
                own = {"rank": rank, "status": "timeout" if not found else "done" if found[0] is None else "failed", "error": found[0] if found else None, "seconds": time.monotonic() - began}
                every = [json.loads(m) for m in BarrierTaskContext.get().allGather(json.dumps(own))]
                done = sum(s["status"] == "done" for s in every)
                yield pa.RecordBatch.from_pylist([{**own, "done": done}], schema=pa.schema([("rank", pa.int32()), ("status", pa.string()), ("error", pa.string()), ("seconds", pa.float64()), ("done", pa.int32())]))

    return spark.range(0, ranks, 1, ranks).mapInArrow(run, STATUS, barrier=True)


def wait_for_shards(spark: SparkSession, path: str, ranks: int, timeout: float = 43_200, poll: float = 10) -> list[int]:
    """Wait until all shards of a run under path are written to their end; ShardsMissing names those that are not when the time is over."""
    until = time.monotonic() + timeout
    while True:
        done = done_ranks(spark, path, ranks)
        if len(done) == ranks:
            return done
        if time.monotonic() >= until:
            raise ShardsMissing([r for r in range(ranks) if r not in done])
        time.sleep(max(0.0, min(poll, until - time.monotonic())))
