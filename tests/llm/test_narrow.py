"""Token files, shards, digests, mixes and packing against plain versions."""

from collections import Counter, defaultdict

import brute
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from eventflow.llm import digest_index, mixing, packing, sharding, token_files
from eventflow.llm.common import new_folder
from eventflow.llm.queries import QUERIES
from eventflow.llm.tokens import BYTE_BPE, WORD_BPE, encoder


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    return sorted(rows, key=lambda r: r.doc_id)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab'sé 1 .\n\t\x1c ́İΣ日!<|>\x85"), max_size=14), max_size=6))
def test_encoder_equals_library(texts):
    for name in (WORD_BPE, BYTE_BPE):
        got = encoder(public_tokenizers.path(name)).encode(pa.array(texts, pa.string()))
        assert [list(g) for g in got] == brute.encoded(name, texts)


def test_token_files(spark, sf_dir, docs):
    got = {r.doc_id: r for r in QUERIES["op1_token_files"](spark, sf_dir).collect()}
    start = 0
    for d, ids in zip(docs, brute.encoded(WORD_BPE, [d.text for d in docs]), strict=True):
        r = got[d.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids) + 1, brute.crc([*ids, 1]))
        start += len(ids) + 1
    assert len(got) == len(docs)


def test_token_files_of_odd_rows(spark, odd, odd_rows, none):
    folder = new_folder(spark, "t")
    token_files.write_tokens(odd, folder, public_tokenizers.path(WORD_BPE), 1, shards=3)
    got = token_files.read_all(spark, folder).collect()
    ids = brute.encoded(WORD_BPE, [r.text for r in odd_rows])
    want = Counter((r.doc_id, brute.crc([*i, 1])) for r, i in zip(odd_rows, ids, strict=True))
    assert Counter((r.key, brute.crc(np.frombuffer(r.ids, "<u4"))) for r in got) == want
    starts = sorted((r.start, r.n_tokens) for r in got)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))
    asked = spark.createDataFrame([(3,), (3,), (77,), (8,)], "key long")
    assert sorted(r.key for r in token_files.fetch(spark, folder, asked).collect()) == [3, 8]
    empty = new_folder(spark, "t")
    token_files.write_tokens(none, empty, public_tokenizers.path(WORD_BPE), 1)
    assert token_files.read_all(spark, empty).count() == 0


def test_perfect_hash():
    keys = np.random.default_rng(3).integers(0, 2**64, 20_000, dtype=np.uint64)
    fields, slots = token_files.perfect_hash(np.unique(keys))
    assert sorted(slots) == list(range(len(slots)))
    assert (token_files.find_slots(fields, np.unique(keys)) == slots).all()


def test_shards(spark, sf_dir, docs):
    got = QUERIES["op2_rendezvous_shards"](spark, sf_dir).collect()
    text = {d.doc_id: (d.text or "").encode() for d in docs}
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r["size"] == len(text[r.doc_id]) + 1
        assert (r.shard, r.grown_shard) == (brute.shard(r.doc_id, 16), brute.shard(r.doc_id, 17))
        assert r.grown_shard in (r.shard, 16)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len(got) == len(docs)


def test_shards_of_odd_rows(odd, odd_rows, none):
    for given_, n in ((sharding.sized(odd), len(odd_rows)), (sharding.sized(none), 0)):
        got = sharding.shard_records(given_, "doc_id", [1.0, 3.0], ["doc_id", "text_crc32", "size"]).collect()
        by = defaultdict(list)
        for r in got:
            by[r.shard].append(r.slot)
        assert len(got) == n and all(sorted(s) == list(range(len(s))) for s in by.values())
    with pytest.raises(ValueError):
        sharding.assign_shard(F.lit(1), [1.0, 0.0])


def test_weights_are_met(spark):
    counts = Counter(
        r[0] for r in spark.range(20_000).select(sharding.assign_shard(F.col("id"), [1.0, 3.0])).collect()
    )
    assert abs(counts[1] / 20_000 - 0.75) < 0.02


def test_digests_over_two_batches(spark, odd, odd_rows, none):
    path = new_folder(spark, "digests")
    got = digest_index.DigestIndex(spark, path, 4).deduplicate(odd).collect()
    groups = defaultdict(list)
    for r in odd_rows:
        groups[brute.SPACE.sub(" ", r.text or "")].append(r.doc_id)
    kept = Counter(r.keep_id for r in got if r.kept)
    assert len(got) == len(odd_rows) and sum(kept.values()) == len(groups)
    assert kept == Counter(min((i for i in g if i is not None), default=None) for g in groups.values())
    # Another session's handle on the same path: nothing is new but the last row.
    more = odd.withColumn("doc_id", F.col("doc_id") + 100).unionByName(
        odd.limit(1).withColumn("text", F.lit("unseen")).withColumn("doc_id", F.lit(7).cast("long"))
    )
    again = digest_index.DigestIndex(spark, path, 4).deduplicate(more).collect()
    assert [r.doc_id for r in again if r.kept] == [7]
    assert digest_index.DigestIndex(spark, path, 4).rows().count() == len(groups) + 1
    assert digest_index.DigestIndex(spark, new_folder(spark, "digests")).deduplicate(none).count() == 0


def test_mix(spark, sf_dir, docs):
    rows = [(d.doc_id, d.source, len(brute.WORD.findall(d.text or ""))) for d in docs]
    sizes, aims = brute.targets(rows, (5, 2, 1), 3)
    got = QUERIES["op8_source_mix"](spark, sf_dir).collect()
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - aims[r.source]) < 1e-6
        assert 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    assert len(got) == len(docs)
    assert all(abs(taken[s] - aims[s]) <= 2 * 128 for s in aims)
    again = QUERIES["op8_source_mix"](spark, sf_dir).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mix_of_odd_rows(odd, odd_rows, none):
    got = mixing.Mix(odd, (5, 2, 1), 3, block_words=16).taken().collect()
    assert len(got) == len(odd_rows)
    assert all(r.taken <= 3 * r["size"] for r in got)
    assert mixing.Mix(none, (1,)).taken().count() == 0


def test_slots_visit_blocks_evenly(odd):
    mix = mixing.Mix(odd, (5, 2, 1), 3, block_words=16, shard_slots=700)
    by = defaultdict(Counter)
    for r in mix.slots().collect():
        by[r.source][r.block] += 1
    blocks = {r.of: r.blocks for r in mix.sources.collect()}
    for source, counts in by.items():
        assert set(counts) <= set(range(blocks[source]))
        every = [counts[b] for b in range(blocks[source])]
        assert max(every) - min(every) <= 1


def check_packing(rows, lengths, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert Counter(r.length for r in rows) == Counter(lengths)
    return len(by)


def test_packing(spark, sf_dir, docs):
    got = QUERIES["op10_best_fit_packing"](spark, sf_dir).collect()
    ids = brute.encoded(BYTE_BPE, [d.text for d in docs])
    lengths, want = [], {}
    for d, i in zip(docs, ids, strict=True):
        full = [*i, 0]
        first = len(full) % 2048 or 2048
        edges = [0, *range(first, len(full) + 1, 2048)]
        for p, (a, b) in enumerate(zip(edges, edges[1:])):
            lengths.append(b - a)
            want[(d.doc_id, p)] = (a, b - a, brute.crc(full[a:b]))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want
    bins = check_packing(got, lengths, 2048)
    assert bins <= -(-sum(lengths) // 2048) * 1.02 + 2


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 40), max_size=30))
def test_plan_places_every_piece_once(counts):
    rows = packing.plan_packing(counts, 30)
    room = Counter()
    for length in counts:
        spans = sorted((first, n * c) for of, first, n, c, _, _ in rows if of == length)
        assert [a for a, _ in spans] == list(np.cumsum([0] + [n for _, n in spans])[:-1])
        assert sum(n for _, n in spans) == counts[length]
    for length, _, n, c, seq, at in rows:
        for s in range(seq, seq + n):
            for k in range(c):
                for x in range(at + k * length, at + (k + 1) * length):
                    room[(s, x)] += 1
    assert all(v == 1 and x < 30 for (_, x), v in room.items())
    larger = [n for n in counts if 3 * n > 30]
    for s in {s for s, _ in room}:
        large = sum(c for of, _, n, c, seq, _ in rows if of in larger and seq <= s < seq + n)
        assert large <= 2


def test_packing_of_odd_rows(odd, odd_rows, none):
    path = public_tokenizers.path(BYTE_BPE)
    placed = packing.pack_documents(odd, path, 0, 2048, keep_ids=True)
    check_packing(placed.collect(), [r.length for r in placed.collect()], 2048)
    whole = packing.sequences(placed).collect()
    assert all(len(r.ids) == 4 * r.n for r in whole)
    assert placed.where("piece = 0").count() == len(odd_rows)
    assert packing.pack_documents(none, path).count() == 0
