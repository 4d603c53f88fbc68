"""The filter audit against a plain version: files in any order, repeated micro-batches, odd rows."""

import random

import brute
import pytest

from eventflow.llm import filter_audit
from eventflow.llm.common import new_folder

NAMES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def rows_of(df):
    return {(r.part, r.filter_order, r.step): tuple(r[n] for n in NAMES) for r in df.collect()}


def documents(seed=1):
    rng = random.Random(seed)
    texts = [None, "", " ".join(f"w{i}" for i in range(120)), "SHOUT " * 30, "a $ b", "x y z", "one two " * 60, "Q" + "q" * 9, "Q" + "q" * 8]
    docs = [(i, rng.choice(texts), rng.choice(["en", "de", None, ""])) for i in range(120)]
    docs += [(None, "x y z", "en"), (None, "x y z", "en"), (5, docs[5][1], "de"), (5, docs[5][1], "de"), (-3, "a $ b", "fr")]
    rng.shuffle(docs)
    return docs


LABELS = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 120, 3)] + [(0, 1, 0), (0, None, None), (500, 1, 1), (None, 1, 1), (-3, 1, 1)]


def written(spark, docs, files):
    path = new_folder(spark, "audit-test")
    for i in range(files):
        frame = spark.createDataFrame([(*d, "b", 1) for d in docs[i::files]], "doc_id bigint, text string, lang string, part string, mask int")
        frame.coalesce(1).write.mode("append").parquet(path)
    return path


@pytest.mark.parametrize(("files", "each"), [(5, 1), (4, None), (3, 9)])
def test_any_cut_into_micro_batches(spark, files, each):
    docs = documents(files)
    labels = spark.createDataFrame([(*x, "z") for x in LABELS], "doc_id bigint, quality int, toxic int, good string")
    made = filter_audit.audit_files(spark, written(spark, docs, files), labels, each)
    assert rows_of(filter_audit.all_orders(made)) == brute.audit_rows(docs, LABELS)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("audit_")]


def test_a_smaller_id_takes_the_earlier_mask_back(spark):
    labels = spark.createDataFrame([(9, 1, 0)], "doc_id bigint, quality int, toxic int")
    audit = filter_audit.Audit(spark, labels, new_folder(spark, "audit"), 3)
    seen = []
    for number, ids in enumerate([[9, 9, 12], [7], [7, 3, None], [4]]):
        batch = spark.createDataFrame([(i, "same", "en") for i in ids], "doc_id bigint, text string, lang string")
        for _ in range(2):  # a repeated micro-batch
            audit.add(filter_audit.reduced(batch), number)
        bit = 16
        rows = audit.counters().collect()
        seen.append((sum(r.n for r in rows if not r.mask & bit), sum(r.n for r in rows if r.mask & bit), sum(r.n for r in rows if r.good and r.mask & bit)))
    audit.close()
    assert seen == [(2, 1, 0), (1, 3, 2), (2, 5, 2), (2, 6, 2)]


def test_odd_and_no_documents(spark, odd, odd_rows, none):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    for frame, rows in ((odd, odd_rows), (none, [])):
        path = new_folder(spark, "audit-odd")
        frame.write.parquet(path)
        made = filter_audit.all_orders(filter_audit.audit_files(spark, path, labels))
        assert rows_of(made) == brute.audit_rows([(r.doc_id, r.text, r.lang) for r in rows], [])
