"""How filters interact in every order, kept up to date file by file.

Documents come as a stream of files. A micro-batch reduces each text to a digest and a mask of the
filters it fails. One filter (E) fails a text that a smaller id has, anywhere in the table: so the
rows of the smallest id of each text are kept as state, keyed by the digest. When a smaller id
arrives, the former holders' masks are retracted from the counters of their parts and counted again
with E. The counters are sums per (part, mask, label flags): what 120 filter orders give follows from
those alone.

A micro-batch reads the state of the one before and writes its own, both merged by bucket of the
digest, and the counters' changes into a folder of its own. A repeated micro-batch overwrites both,
so a restart from the checkpoint counts each row once.
"""

from __future__ import annotations

import itertools
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventflow.llm.common import new_folder, partitions, words_of
from eventflow.session import pin
from eventflow.streaming.running import start, table_stream

FILTERS = "ABCDE"
ALL_ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]
LEAST_WORDS, DISTINCT_SHARE, CAPITAL_SHARE = 100, 80, 10
MICRO_BATCHES = 4

_BIT = {name: 1 << i for i, name in enumerate(FILTERS)}
_COUNTED = ["part", "mask", "good", "toxic"]
_CHANGES = "part string, mask int, good boolean, toxic boolean, n bigint"
_STATE = (
    "digest binary, id bigint, "
    "holders array<struct<part:string,mask:int,good:boolean,toxic:boolean,n:bigint>>"
)


def own_mask(text: Column) -> Column:
    """Bits of the filters A to D that a text fails; null is empty."""
    text = F.coalesce(text, F.lit(""))
    words = words_of(text)
    n_words = F.size(words).cast("long")
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
    fails = {
        "A": n_words < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < DISTINCT_SHARE * n_words,
        "C": 100 * capitals.cast("long") > CAPITAL_SHARE * F.length(text).cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }
    return sum((F.when(v, _BIT[k]).otherwise(0) for k, v in fails.items()), F.lit(0))


def rated_flags(labels: DataFrame) -> DataFrame:
    """One row per labelled id: whether any of its rows says quality 1, and toxic 1."""
    return labels.groupBy(F.col("doc_id").cast("long").alias("rated_id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"),
    )


def reduced(docs: DataFrame) -> DataFrame:
    """What the audit keeps of a document: id, part (its language; null is empty), digest, mask."""
    return docs.select(
        F.col("doc_id").cast("long").alias("id"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)).alias("digest"),
        own_mask(F.col("text")).alias("mask"),
    )


@dataclass
class Audit:
    """State and counters of one audit, in a folder that driver and executors share."""

    spark: SparkSession
    labels: DataFrame
    folder: str
    buckets: int

    def __post_init__(self):
        self._name = f"audit_{uuid.uuid4().hex}"
        self._flags = pin(rated_flags(self.labels))

    def _table(self, number: int) -> str:
        return f"{self._name}_{number + 1}"

    def _drop(self, number: int) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self._table(number)}")
        jvm, settings = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for part in ("state", "rows"):
            path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{part}/{number}")
            path.getFileSystem(settings).delete(path, True)

    def _state(self, number: int) -> DataFrame:
        """The state that micro-batch ``number`` left, one row per text, bucketed by digest."""
        name = self._table(number)
        if not self.spark.catalog.tableExists(name):
            path = f"{self.folder}/state/{number}"
            fields = _STATE.replace(":", ": ")
            self.spark.sql(
                f"CREATE TABLE {name} ({fields}) USING parquet CLUSTERED BY (digest) "
                f"SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}'"
            )
        return self.spark.table(name)

    def _groups(self, rows: DataFrame) -> DataFrame:
        """Rows with an id, per (digest, part, mask, flags): how many, the smallest id, how many have it."""
        flagged = rows.join(self._flags, rows["id"] == self._flags["rated_id"], "left").select(
            "digest",
            "id",
            "part",
            "mask",
            F.coalesce("good", F.lit(False)).alias("good"),
            F.coalesce("toxic", F.lit(False)).alias("toxic"),
        )
        # First by id too: copies of a text, however many, are counted where their ids are.
        each = flagged.groupBy("id", "digest", *_COUNTED).agg(F.count(F.lit(1)).alias("c"))
        return each.groupBy("digest", *_COUNTED).agg(
            F.sum("c").alias("n"), F.min(F.struct("id", "c")).alias("least")
        )

    def add(self, batch: DataFrame, number: int) -> None:
        """Count a micro-batch; to be called with rising numbers, a repeated one redoes its own."""
        path = f"{self.folder}/rows/{number}"
        batch.write.mode("overwrite").parquet(path)
        rows = self.spark.read.schema(batch.schema).parquet(path)
        groups = pin(self._groups(rows.where("id is not null")))
        fresh = groups.groupBy("digest").agg(
            F.min("least.id").alias("new_id"),
            F.collect_list(
                F.struct(*_COUNTED, "n", F.col("least.id").alias("id"), F.col("least.c").alias("c"))
            ).alias("groups"),
        )
        old = self._state(number - 1).select("digest", F.col("id").alias("old_id"), "holders")
        merged = fresh.join(old.hint("merge"), "digest", "full_outer").select(
            "digest",
            F.least("new_id", "old_id").alias("id"),
            F.coalesce(F.col("old_id") > F.col("new_id"), F.lit(False)).alias("lowered"),
            F.coalesce("groups", F.array()).alias("groups"),
            F.coalesce("holders", F.array()).alias("holders"),
        )
        merged = merged.withColumn(
            "joining",
            F.expr(
                "transform(filter(groups, g -> g.id = id), "
                "g -> struct(g.part, g.mask, g.good, g.toxic, g.c as n))"
            ),
        )
        placed = merged.select(
            "digest",
            "id",
            F.when(F.col("lowered"), F.col("joining"))
            .otherwise(F.concat("holders", "joining"))
            .alias("holders"),
            self._changes().alias("changes"),
        )
        placed = pin(placed)
        self._state(number)  # the table, if it is not there yet
        placed.select("digest", "id", "holders").repartition(self.buckets, "digest").write.insertInto(
            self._table(number), overwrite=True
        )
        self.spark.catalog.refreshTable(self._table(number))
        changes = placed.select(F.inline("changes")).unionByName(
            rows.where("id is null").select(
                "part", "mask", F.lit(False).alias("good"), F.lit(False).alias("toxic"), F.lit(1).alias("n")
            )
        )
        summed = changes.groupBy(*_COUNTED).agg(F.sum("n").alias("n")).where("n <> 0")
        summed.write.mode("overwrite").parquet(f"{self.folder}/changes/{number}")
        if number > 0:  # a repeat of this micro-batch reads the one before
            self._drop(number - 2)

    def _changes(self) -> Column:
        """What a text's new rows change in the counters: (part, mask, flags, n) with n of either sign."""
        bit = _BIT["E"]
        return F.expr(
            f"""concat(
                transform(joining, g -> struct(g.part, g.mask, g.good, g.toxic, g.n)),
                transform(groups, g -> struct(g.part, g.mask | {bit} as mask, g.good, g.toxic,
                    g.n - if(g.id = id, g.c, 0L) as n)),
                if(lowered, transform(holders, h -> struct(h.part, h.mask, h.good, h.toxic, -h.n as n)),
                    array()),
                if(lowered, transform(holders, h -> struct(h.part, h.mask | {bit} as mask, h.good, h.toxic, h.n)),
                    array()))"""
        )

    def counters(self) -> DataFrame:
        """Documents per (part, mask, good, toxic) after all micro-batches so far."""
        try:
            changes = self.spark.read.schema(_CHANGES).parquet(f"{self.folder}/changes/*")
        except AnalysisException:  # no micro-batch yet
            changes = self.spark.createDataFrame([], _CHANGES)
        return changes.groupBy(*_COUNTED).agg(F.sum("n").alias("n")).where("n > 0")

    def close(self) -> None:
        """Take the state's tables out of the session's catalog; their files stay with the checkpoint."""
        for row in self.spark.sql(f"SHOW TABLES LIKE '{self._name}*'").collect():
            self.spark.sql(f"DROP TABLE IF EXISTS {row.tableName}")


def audit_files(
    spark: SparkSession, path: str, labels: DataFrame, files_each: int | None = None
) -> DataFrame:
    """The counters over all documents under ``path``, worked off as available-now micro-batches.

    Documents need doc_id, text and lang; other columns are left out. ``files_each`` is the number of
    files of a micro-batch; without it the files are dealt over ``MICRO_BATCHES``. Equal ids and texts
    make no smaller id: each of such rows counts, none fails E by the other. A null id is no smaller id
    for anyone and has none. A null text is the empty text. Labels may have several rows for an id, and
    ids without a document. No documents give no rows.
    """
    if files_each is None:
        files_each = -(-len(spark.read.parquet(path).inputFiles()) // MICRO_BATCHES) or 1
    folder = new_folder(spark, "filter-audit")
    audit = Audit(spark, labels, folder, partitions(spark))
    query = start(reduced(table_stream(spark, path, files_each)), audit.add, f"{folder}/checkpoint")
    query.awaitTermination()
    audit.close()
    return audit.counters()


def all_orders(counters: DataFrame) -> DataFrame:
    """One row per part, filter order and step, zeros included, from the counters.

    ``kept`` after the step, ``removed`` by it, ``redundant``: fails its filter but was removed before,
    ``unique_fails``: fails its filter alone, ``good_lost`` and ``toxic_lost`` among the removed,
    ``shapley``: what the filter removes in this part, summed over all orders.
    """
    steps = [
        (order, i + 1, _BIT[name], sum(_BIT[x] for x in order[:i]))
        for order in ALL_ORDERS
        for i, name in enumerate(order)
    ]
    spark = counters.sparkSession
    placed = spark.createDataFrame(steps, "filter_order string, step int, step_bit int, step_before int")
    # 600 steps, but only 80 different ones: a filter and the set of those before it.
    different = sorted({(bit, before) for *_, bit, before in steps})
    laid_out = F.array(
        *[F.struct(F.lit(bit).alias("bit"), F.lit(before).alias("before")) for bit, before in different]
    )
    hit, earlier = F.expr("mask & bit <> 0"), F.expr("mask & before <> 0")

    def count(where: Column, times: Column | None = None) -> Column:
        return F.sum(F.when(where, F.col("n") if times is None else F.col("n") * times).otherwise(0)).cast("long")

    # In 120 / k of the 120 orders the filter comes first of the k that a document fails.
    first_in = F.lit(len(ALL_ORDERS)) / F.bit_count("mask")
    results = (
        counters.withColumn("at", F.explode(laid_out))
        .select(*_COUNTED, "n", "at.*")
        .groupBy("part", "bit", "before")
        .agg(
            count(F.expr("mask & (before | bit) = 0")).alias("kept"),
            count(hit & ~earlier).alias("removed"),
            count(hit & earlier).alias("redundant"),
            count(F.col("mask") == F.col("bit")).alias("unique_fails"),
            count(hit & ~earlier & F.col("good")).alias("good_lost"),
            count(hit & ~earlier & F.col("toxic")).alias("toxic_lost"),
            count(hit, first_in).alias("shapley"),
        )
    )
    same_step = (F.col("bit") == F.col("step_bit")) & (F.col("before") == F.col("step_before"))
    named = results.join(placed, same_step)
    return named.drop("bit", "before", "step_bit", "step_before")
