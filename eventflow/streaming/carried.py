"""Streams whose state is tables: each micro-batch reads what the one before left and writes its own.

A micro-batch is an ordinary job over its rows and the carried tables, with everything a job has: partial
aggregation, joins that split hot keys, memory that spills. Carried and emitted tables are folders named
by the number of the micro-batch. A repeated micro-batch reads the same ones and overwrites its own, so
with the stream's checkpoint each row counts once, also after a restart.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventflow.session import checkpoint_root
from eventflow.sources.small import delete, names_in, read_text, write_text
from eventflow.streaming.running import start


@dataclass
class Batch:
    """One micro-batch: its rows, and the tables around it."""

    spark: SparkSession
    root: str
    number: int
    rows: DataFrame
    counts: dict[str, int] = field(default_factory=dict)
    late: int = 0

    def _path(self, kind: str, name: str, number: int) -> str:
        return f"{self.root}/{kind}/{name}/batch_id={number}"

    def carried(self, name: str, schema: str) -> DataFrame:
        """What the micro-batch before left under this name; empty before the first."""
        if self.number == 0:  # made by Spark alone: rows given by Python, even none, start Python in all tasks
            fields = T.StructType.fromDDL(schema)
            return self.spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in fields])
        return self.spark.read.schema(schema).parquet(self._path("carried", name, self.number - 1))

    def carry(self, name: str, df: DataFrame, counted: dict[str, Column] | None = None) -> DataFrame:
        """Leave rows to the next micro-batch; returns them as written.

        ``counted`` are aggregates taken as the rows go by, found in ``counts`` afterwards.
        """
        if not counted:
            return self._write(self._path("carried", name, self.number), df)
        seen = Observation()
        observed = df.observe(seen, *[v.alias(k) for k, v in counted.items()])
        written = self._write(self._path("carried", name, self.number), observed)
        self.counts |= seen.get
        return written

    def emit(self, name: str, df: DataFrame) -> DataFrame:
        """Add rows to a result; returns them as written."""
        return self._write(self._path("emitted", name, self.number), df)

    def _write(self, path: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def note(self, name: str, values: dict[str, int]) -> None:
        """Leave a few numbers, in a file that only the driver writes and reads."""
        write_text(self.spark, f"{self._path('notes', name, self.number)}.json", json.dumps(values))

    def noted(self, name: str) -> dict[str, int]:
        """The numbers of the micro-batch before; none before the first."""
        if self.number == 0:
            return {}
        return json.loads(read_text(self.spark, f"{self._path('notes', name, self.number - 1)}.json"))

    def clock(
        self, lags: dict[str, int], ts: str = "ts", kind: str | None = "kind"
    ) -> tuple[int | None, int | None]:
        """The watermark before this micro-batch and after it, in microseconds; ``late`` counts rows behind the first.

        It is the least, over the inputs named in ``lags``, of the latest time so far less the lag;
        none as long as an input has had no row. ``kind`` names a row's input; None: there is one.
        """
        before = self.noted("clock")
        name = F.lit(next(iter(lags))) if kind is None else F.col(kind)

        def mark(latest: dict[str, int]) -> int | None:
            if any(name not in latest for name in lags):
                return None
            return min(latest[name] - lag for name, lag in lags.items())

        at, passed = F.unix_micros(F.col(ts).cast("timestamp")), mark(before)
        here = self.rows.groupBy(name.alias("input")).agg(
            F.max(at).alias("latest"), F.count_if(F.lit(False) if passed is None else at < passed).alias("late")
        )
        seen = dict(before)
        for row in here.where(F.col("input").isin(*lags)).collect():  # a row per input
            self.late += row.late
            if row.latest is not None:
                seen[row.input] = max(row.latest, seen.get(row.input, row.latest))
        self.note("clock", seen)
        return passed, mark(seen)


class Carried:
    """A stream worked off by ``step``, which is given one ``Batch`` after the other."""

    def __init__(self, stream: DataFrame, step: Callable[[Batch], None], folder: str | None = None):
        self.stream, self.step = stream, step
        self.spark = stream.sparkSession
        self.root = folder or f"{checkpoint_root(self.spark)}/carried-{uuid.uuid4().hex}"

    def _do(self, rows: DataFrame, number: int) -> None:
        # Written by the stream's session and read by the caller's, whose plans adapt to what they find.
        path = f"{self.root}/input/batch_id={number}"
        rows.write.mode("overwrite").parquet(path)
        self.step(Batch(self.spark, self.root, number, self.spark.read.schema(rows.schema).parquet(path)))
        for old in (f"input/batch_id={number - 1}", *self._carried(number - 2)):
            delete(self.spark, f"{self.root}/{old}")

    def _carried(self, number: int) -> list[str]:
        return [f"carried/{n}/batch_id={number}" for n in names_in(self.spark, f"{self.root}/carried")]

    def run(self, feed: Iterable[None] | None = None, finish: Callable[[], None] | None = None) -> Carried:
        """Work off all input there is.

        ``feed``: an iterator that makes more input available at each step; what is there is worked off
        before the next step. ``finish`` ends the inputs (rows far ahead in time), which closes what is open.
        """
        checkpoint = f"{self.root}/checkpoint"
        if feed is not None:
            # Each step is a run of its own: a trigger that goes on meanwhile would find steps half given, and every
            # micro-batch more is one more pass over what is carried.
            for _ in feed:
                start(self.stream, self._do, checkpoint).awaitTermination()
        else:
            start(self.stream, self._do, checkpoint).awaitTermination()
        if finish is not None:
            finish()
            start(self.stream, self._do, checkpoint).awaitTermination()
        return self

    def table(self, name: str, schema: str | T.StructType) -> DataFrame:
        """All rows emitted under a name so far."""
        shape = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        try:
            rows = self.spark.read.schema(shape).parquet(f"{self.root}/emitted/{name}")
        except AnalysisException:  # no micro-batch yet
            return self.spark.createDataFrame([], shape)
        return rows.select(*shape.names)

    def notes(self, name: str) -> dict[int, dict[str, int]]:
        """The numbers that each micro-batch left under a name."""
        found = [n for n in names_in(self.spark, f"{self.root}/notes/{name}") if n.endswith(".json") and n[0] != "."]
        return {
            int(n.removeprefix("batch_id=").removesuffix(".json")): json.loads(
                read_text(self.spark, f"{self.root}/notes/{name}/{n}")
            )
            for n in found
        }


def split_late(rows: DataFrame, mark: int | None, ts: str = "ts") -> tuple[DataFrame, DataFrame]:
    """Rows on time, and rows behind the watermark. Rows without time are on time."""
    if mark is None:
        return rows, rows.limit(0)
    late = F.coalesce(F.unix_micros(F.col(ts).cast("timestamp")) < mark, F.lit(False))
    return rows.where(~late), rows.where(late)


def lag_of(stream: DataFrame, ts: str = "ts") -> int:
    """The lag of a stream's watermark (see ``with_event_time``), in microseconds."""
    return int(stream.schema[ts].metadata.get("spark.watermarkDelayMs", 0)) * 1000
