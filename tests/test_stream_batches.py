"""Stream queries over tables of several files in no order, one file in a micro-batch, against the batch SQL."""

import shutil

import pytest
from oracle import difference, duck
from pyspark.sql import functions as F

import __spark_entry__ as entry
from eventflow import workload

STREAMS = sorted(n for n in entry.queries() if n.startswith("stream_"))
SPLIT = ("events", "orders", "lineitem", "customer", "documents")


@pytest.fixture(scope="module")
def in_files(spark, sf_dir, tmp_path_factory):
    folder = tmp_path_factory.mktemp("files")
    for name in (*SPLIT, "nation"):
        source = f"{sf_dir}/{name}.parquet"
        if name in SPLIT:
            rows = spark.read.parquet(source)
            rows.repartition(3, F.xxhash64(rows.columns[0])).write.parquet(f"{folder}/{name}.parquet")
        else:
            shutil.copy(source, f"{folder}/{name}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", STREAMS)
def test_batches_do_not_matter(name, spark, sf_dir, in_files, monkeypatch):
    monkeypatch.setattr(workload, "FILES_PER_BATCH", 1)
    got = entry.queries()[name](spark, in_files)
    assert difference(got, duck(sf_dir), entry.oracle_sql()[name]) is None
