"""Sums that partitions make by themselves, merged up a tree of fixed fan-in."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundloom.llm.common import cut, tidy

FAN_IN = 16
STATE = "part bigint, state binary"


def _batch(part: int, state: Any) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([pickle.dumps(state)], pa.binary())], names=["part", "state"])


def summed(rows: DataFrame, start: Callable[[], Any], add: Callable[[Any, pa.RecordBatch], Any], merge: Callable[[Any, Any], Any], fan_in: int = FAN_IN) -> Any:
    """The state of all rows, or None if there are none.

    Each partition starts a state and adds its batches to it; states meet in
    the order of their partitions, fan_in at a time, so no task reads more than
    that many at once and the driver gets one. A state's size must not depend on
    the number of rows. Levels are cut by checkpoints.
    """

    def partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, any_rows = start(), False
        for batch in batches:
            if batch.num_rows:
                state, any_rows = add(state, batch), True
        if any_rows:
            yield _batch(TaskContext.get().partitionId(), state)

    def level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None
        for batch in batches:
            for part, state in zip(batch.column("part").to_pylist(), batch.column("state"), strict=True):
                one = pickle.loads(state.as_py())  # noqa: S301  written by the function above
                if part == at:
                    held = merge(held, one)
                    continue
                if held is not None:
                    yield _batch(at, held)
                at, held = part, one
        if held is not None:
            yield _batch(at, held)

    now = cut(rows.mapInArrow(tidy(partition), STATE))
    while (n := now.agg(F.max("part"), F.count(F.lit(1))).first())[1] > 1:
        up = now.select(F.floor(F.col("part") / fan_in).alias("part"), F.col("part").alias("before"), "state")
        groups = n[0] // fan_in + 1
        now = cut(up.repartition(groups, "part").sortWithinPartitions("part", "before").drop("before").mapInArrow(level, STATE))
    last = now.first()
    return None if last is None else pickle.loads(last["state"])  # noqa: S301
