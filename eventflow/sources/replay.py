"""Stored tables as streams in order of event time.

A table's files are in no order of time, so read as a stream they need a lag as long as the table. Here
the rows are sorted into ranges of time once, and the ranges given to a stream one after the other: a lag
of one range's width covers all disorder, and state holds what is open in a range or two.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventflow.functions.timing import Duration, epoch_micros_text, micros_of
from eventflow.session import checkpoint_root
from eventflow.streaming.running import table_stream

_RANGE = "__range"


class Replay:
    """Tables given out range by range; all of them stand at the same range."""

    def __init__(self, spark: SparkSession, width: Duration):
        self.spark, self.width = spark, micros_of(width)
        self.root = f"{checkpoint_root(spark)}/replay-{uuid.uuid4().hex}"
        self.ranges: dict[int, list[str]] = {}
        self.ends: dict[str, DataFrame] = {}

    def add(self, name: str, rows: DataFrame, ts: str, end: DataFrame | None = None) -> DataFrame:
        """The rows as a stream. Rows without time come first; ``end``: rows given out after all ranges."""
        micros = epoch_micros_text(rows, ts)
        sorted_ = rows.withColumn(_RANGE, F.expr(f"coalesce({micros} div {self.width}, -9223372036854775807)"))
        # Sorted by time over all tasks, so that a task writes to few ranges and a large range has many files.
        by_time = sorted_.repartitionByRange(_RANGE, ts)
        by_time.write.partitionBy(_RANGE).parquet(f"{self.root}/sorted/{name}")
        for folder in self._list(f"{self.root}/sorted/{name}"):
            if folder.startswith(f"{_RANGE}="):
                self.ranges.setdefault(int(folder.split("=")[1]), []).append(name)
        target = f"{self.root}/given/{name}"
        rows.limit(0).write.parquet(target)
        if end is not None:
            self.ends[name] = end
        return table_stream(self.spark, target)

    def feed(self) -> Iterator[None]:
        """Gives out one range after the other, then the ends."""
        for number in sorted(self.ranges):
            for name in self.ranges[number]:
                self._give(f"{self.root}/sorted/{name}/{_RANGE}={number}", f"{self.root}/given/{name}", number)
            yield
        for name, rows in self.ends.items():
            rows.write.mode("append").parquet(f"{self.root}/given/{name}")
        if self.ends:
            yield

    def _files(self, path: str):
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return place, place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _list(self, path: str) -> list[str]:
        place, files = self._files(path)
        return [s.getPath().getName() for s in files.listStatus(place)] if files.exists(place) else []

    def _give(self, source: str, target: str, number: int) -> None:
        for name in self._list(source):
            if name.startswith("part-"):
                old, files = self._files(f"{source}/{name}")
                new, _ = self._files(f"{target}/r{number}-{name}")
                if not files.rename(old, new):
                    raise OSError(f"cannot give out {source}/{name}")
