"""Answers of a box-query service: retried requests as rows, from a table of requests or as a Spark data source.

The service is a function ask(request, attempt) that returns the body or raises
Refused (a request that will be refused again) or any other error. Tests and
queries give one that replays recorded answers; a user gives one that opens a
connection. It runs inside tasks, so it must be picklable.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

Ask = Callable[[dict, int], str]


class Refused(Exception):
    """The service refuses the request as such (status 400)."""


def answer(ask: Ask, request: dict, retries: int = 3, pause: float = 0.2) -> tuple[str, int, str | None, str | None]:
    """status, attempts, body, error. Attempt k is followed by a pause of k times pause; a refused request isn't tried again."""
    error = None
    for attempt in range(1, retries + 1):
        try:
            return "ok", attempt, ask(request, attempt), None
        except Refused as no:
            return "refused", attempt, None, str(no)
        except Exception as failed:  # whatever a network does is tried again
            error = f"{type(failed).__name__}: {failed}"
        if attempt < retries:
            time.sleep(pause * attempt)
    return "unreachable", retries, None, error


def fetch(requests: DataFrame, ask: Ask, retries: int = 3, pause: float = 0.2) -> DataFrame:
    """requests with status, attempts, body and error: one row each. Repartition requests by what the service bears."""
    if retries < 1:
        raise ValueError("at least one attempt")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [answer(ask, r, retries, pause) for r in f.to_dict("records")]
            yield pd.concat([f, pd.DataFrame(found, columns=["status", "attempts", "body", "error"], index=f.index)], axis=1)

    return requests.mapInPandas(run, f"{kinds}, status string, attempts int, body string, error string")


class _Box(InputPartition):
    def __init__(self, box: tuple[float, float, float, float]) -> None:
        self.box = box


class _Boxes(DataSourceReader):
    def __init__(self, ask: Ask, options) -> None:
        self.ask = ask
        self.bounds = tuple(float(v) for v in options["bounds"].split(","))
        self.step, self.retries, self.pause = float(options["step"]), int(options.get("retries", "3")), float(options.get("pause", "0.2"))
        if len(self.bounds) != 4 or self.step <= 0 or self.retries < 1:
            raise ValueError("bounds takes x0,y0,x1,y1; step and retries must be positive")

    def partitions(self) -> list[_Box]:
        x0, y0, x1, y1 = self.bounds
        count = lambda a, b: max(0, -int(-(b - a) // self.step))
        at = lambda a, k, end: (a + k * self.step, min(end, a + (k + 1) * self.step))
        spans = [(at(x0, i, x1), at(y0, j, y1)) for j in range(count(y0, y1)) for i in range(count(x0, x1))]
        return [_Box((x[0], y[0], x[1], y[1])) for x, y in spans]

    def read(self, partition: _Box) -> Iterator[tuple]:
        if partition is None:  # an empty extent
            return
        box = partition.box
        yield *box, *answer(self.ask, dict(zip(("x0", "y0", "x1", "y1"), box, strict=True)), self.retries, self.pause)


def box_source(format_name: str, ask: Ask) -> type[DataSource]:
    """A data source for spark.dataSource.register(): one partition for each box of a grid.

    Options: bounds (x0,y0,x1,y1), step, retries, pause. Columns: x0, y0, x1,
    y1, status, attempts, body, error; tables.recorded_answers() reads bodies.
    The driver lists the boxes; for more of them than it should hold, use
    fetch() over a table.
    """

    class Boxes(DataSource):
        @classmethod
        def name(cls) -> str:
            return format_name

        def schema(self) -> str:
            return "x0 double, y0 double, x1 double, y1 double, status string, attempts int, body string, error string"

        def reader(self, schema) -> DataSourceReader:
            return _Boxes(ask, self.options)

    return Boxes
