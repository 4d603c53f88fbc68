"""Readers, writers, keyed tables, trade messages and generators."""

import os
import struct

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from eventflow import schemas
from eventflow.functions import codec, values
from eventflow.operators import latency as L
from eventflow.operators import shaping as S
from eventflow.sinks import files, tables
from eventflow.sources import generate as G
from eventflow.sources import readers


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode())


def test_lines_from_several_paths(spark, tmp_path):
    write(tmp_path / "a.txt", "1\n2\n")
    write(tmp_path / "b.txt", "3\n")
    both = readers.read_lines(spark, [str(tmp_path / "a.txt"), str(tmp_path / "b.txt")])
    assert sorted(r.value for r in both.collect()) == ["1", "2", "3"]


@pytest.mark.parametrize("spread", [True, False])
def test_offsets_are_byte_positions_per_file(spark, tmp_path, spread):
    texts = {
        "a.txt": "one\nzwölf\n\nlast",
        "b.txt": "".join(f"line {i} {'x' * (i % 40)}\n" for i in range(3000)),
        "c.txt": "dos\r\nlines\r\n",
    }
    for name, text in texts.items():
        write(tmp_path / name, text)
    expected = set()
    for name, text in texts.items():
        at = 0
        for line in text.encode().split(b"\n"):
            if at < len(text.encode()):
                expected.add((name, at, line.rstrip(b"\r").decode()))
            at += len(line) + 1
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        lines = readers.read_lines_with_offset(spark, str(tmp_path), spread)
        got = {(os.path.basename(r.path), r.offset, r.line) for r in lines.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == expected
    keyed = S.keyed_lines(lines)
    assert keyed.columns == ["path", "key", "value"]


def test_offsets_move_no_lines_and_hold_over_batches_and_packed_splits(spark, tmp_path):
    texts = {f"{i}.txt": "".join(f"{i}-{j}-{'é' * (j % 7)}\r\n" * (j % 3) for j in range(i * 40)) for i in range(6)}
    for name, text in texts.items():
        write(tmp_path / name, text)
    expected = set()
    for name, text in texts.items():
        at = 0
        for line in text.encode().split(b"\n")[:-1]:
            expected.add((name, at, line.decode().rstrip("\r")))
            at += len(line) + 1
    for options in ({"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "1"}, {}):
        options = options | {"spark.sql.execution.arrow.maxRecordsPerBatch": "7"}
        for key, value in options.items():
            spark.conf.set(key, value)
        try:
            lines = readers.read_lines_with_offset(spark, str(tmp_path))
            assert "hashpartitioning" not in lines._jdf.queryExecution().executedPlan().toString()
            got = [(os.path.basename(r.path), r.offset, r.line) for r in lines.collect()]
        finally:
            for key in options:
                spark.conf.unset(key)
        assert len(got) == len(expected) and set(got) == expected


def test_folder_layout_of_latency_logs(spark, tmp_path):
    write(tmp_path / "n1/run-a/t-1000/part-00000", "(k,1,5)\n(k,1,7)\nbroken\n")
    write(tmp_path / "n1/run-a/t-1000/x/part-00001", "(k,1,9)\n")
    write(tmp_path / "n1/run-a/t-2000/part-00000", "(k,1,40)\n")
    write(tmp_path / "n1/run-a/t-2000/other", "(k,1,999)\n")
    lines = readers.read_latency_log(spark, str(tmp_path), "folders")
    assert {r.run for r in lines.collect()} == {"run-a"}
    stats = L.folder_log_stats(lines).orderBy("time").collect()
    assert [(r.n, r.min_ms, r.max_ms, r.avg_ms) for r in stats] == [
        (3, 5, 9, 7.0),
        (1, 40, 40, 40.0),
    ]
    with pytest.raises(ValueError):
        readers.read_latency_log(spark, str(tmp_path), "zip")


def test_kafka_options():
    options = readers.trade_stream_options("h:9092", "t", "earliest", 24, 32768)
    assert options == {
        "kafka.bootstrap.servers": "h:9092",
        "subscribe": "t",
        "startingOffsets": "earliest",
        "minPartitions": "24",
        "maxOffsetsPerTrigger": "32768",
    }


def test_text_writers(spark, tmp_path):
    counts = spark.createDataFrame([("a b", 2), ('say "x"', 1)], "word string, n long")
    files.write_tsv(counts, str(tmp_path / "tsv"))
    assert {r.value for r in spark.read.text(str(tmp_path / "tsv")).collect()} == {
        "a b\t2",
        'say "x"\t1',
    }
    files.write_csv(counts.repartition(3), str(tmp_path / "csv"), single=True)
    parts = [p for p in os.listdir(tmp_path / "csv") if p.startswith("part-")]
    assert len(parts) == 1
    files.write_lines(S.comma_lines(counts), str(tmp_path / "lines"))
    assert {r.value for r in spark.read.text(str(tmp_path / "lines")).collect()} == {
        "a b,2",
        'say "x",1',
    }
    with pytest.raises(Exception, match="already exists"):
        files.write_lines(S.comma_lines(counts), str(tmp_path / "lines"))


def test_each_run_has_its_path():
    assert files.run_path("/out/x", 17) == "/out/x_17"
    assert files.run_path("/out/x").startswith("/out/x_1")


def test_peek_counts_rows_in_passing(spark):
    seen = Observation("look")
    df = files.peek(spark.range(100), seen, highest=F.max("id"))
    assert df.where("id < 5").count() == 5
    assert seen.get == {"rows": 100, "highest": 99}


def kv(spark, rows):
    return spark.createDataFrame(rows, "key long, at long, value string")


@pytest.mark.parametrize("rewrite", [True, False])
def test_upsert_keeps_the_last_write(spark, tmp_path, rewrite):
    path = str(tmp_path / "table")

    def write(rows, **options):
        tables.upsert_table(kv(spark, rows), path, ["key"], "at", rewrite=rewrite, **options)

    def rows():
        return {r.key: r.value for r in readers.read_table(spark, path, ["key"]).collect()}

    assert tables.versions(spark, path) == {}
    write([(1, 1, "a"), (2, 1, "b"), (1, 2, "c")])
    write([(2, 0, "d"), (3, 5, "e"), (3, 4, "f")])
    write([(4, 0, "g")])
    assert rows() == {1: "c", 2: "d", 3: "e", 4: "g"}
    write([(9, 1, "z")], clear=True)
    assert rows() == {9: "z"}


def test_unfinished_versions_do_not_count(spark, tmp_path):
    path = tmp_path / "table"
    tables.upsert_table(kv(spark, [(1, 1, "a")]), str(path), ["key"], "at")
    (path / "full=00000002").mkdir()
    assert list(tables.versions(spark, str(path))) == [1]
    tables.upsert_table(kv(spark, [(2, 1, "b")]), str(path), ["key"], "at")
    assert readers.read_table(spark, str(path), ["key"]).count() == 2


def test_a_repeated_version_is_written_once(spark, tmp_path):
    path = str(tmp_path / "table")
    first = tables.upsert_table(kv(spark, [(1, 1, "a")]), path, ["key"], "at", write_id="a-1")
    again = tables.upsert_table(kv(spark, [(1, 1, "other")]), path, ["key"], "at", write_id="a-1")
    assert first == again
    assert readers.read_table(spark, path, ["key"]).first().value == "a"
    with pytest.raises(FileNotFoundError):
        readers.read_table(spark, str(tmp_path / "none"), ["key"])


def test_catalog_tables_are_read_by_name(spark):
    spark.range(3).createOrReplaceTempView("three")
    assert readers.read_table(spark, "three").count() == 3
    with pytest.raises(Exception, match="(?i)not found|not_found"):
        readers.read_table(spark, "no_such_table").count()


# Trade messages

EDGES = [
    ("A", 0, 0, 0),
    ("ABCDE", 1704067200123, 10000, 100),
    ("ZZ", -1, -1, -(2**31)),
    ("", 2**53, 2**31 - 1, 7),
]


def trades_of(spark, rows):
    return spark.createDataFrame(rows, "ticker string, ms long, price int, quantity int").select(
        F.timestamp_millis("ms").alias("time"), "ticker", "quantity", "price"
    )


def test_messages_have_the_fixed_layout(spark):
    for row in codec.encode_trade(trades_of(spark, EDGES[:3])).collect():
        assert len(row.value) == 21
    got = {bytes(r.value) for r in codec.encode_trade(trades_of(spark, EDGES[:3])).collect()}
    assert got == {
        t.ljust(5).encode() + struct.pack(">qii", ms, price, quantity)
        for t, ms, price, quantity in EDGES[:3]
    }


def test_messages_are_read_back(spark):
    sent = trades_of(spark, EDGES[:3])
    back = codec.decode_trade(codec.encode_trade(sent))
    assert back.columns == ["time", "ticker", "quantity", "price"]
    assert sorted(back.collect()) == sorted(sent.collect())


def test_any_number_is_decoded_with_its_sign(spark):
    numbers = [(-(2**63), -(2**31), 2**31 - 1), (2**63 - 1, 5, -5)]
    blobs = [(bytearray(b"AB   " + struct.pack(">qii", *n)),) for n in numbers]
    df = spark.createDataFrame(blobs, "value binary")
    parts = df.select(
        codec._long(F.col("value"), 6).alias("t"),
        codec._int(F.col("value"), 14).alias("p"),
        codec._int(F.col("value"), 18).alias("q"),
    )
    assert [tuple(r) for r in parts.collect()] == numbers


def test_a_long_ticker_is_refused(spark):
    with pytest.raises(Exception, match="longer than 5"):
        codec.encode_trade(trades_of(spark, [("ABCDEF", 1, 1, 1)])).collect()


# Generators


def test_sequence_is_evenly_spaced(spark):
    rows = G.sequence(spark, 10, per_second=4, start_micros=10**6).orderBy("seq")
    micros = [r[0] for r in rows.select(F.unix_micros("ts")).collect()]
    assert micros == [10**6 + i * 250_000 for i in range(10)]


def test_generated_records_keep_to_their_ranges(spark):
    seq = G.sequence(spark, 5000)
    auctions = G.gen_auctions(seq, 50, "2 seconds", "6 seconds")
    assert auctions.schema.names == schemas.AUCTION.names
    lasts = (F.unix_millis("expires") - F.unix_millis("ts")).alias("d")
    low, high = auctions.select(lasts).agg(F.min("d"), F.max("d")).first()
    assert 2000 <= low < 2100 and 5900 < high < 6000
    spans = auctions.agg(
        F.count_distinct("seller_id"), F.min("seller_id"), F.max("category"), F.min("category")
    ).first()
    assert tuple(spans) == (50, 0, 127, 0)
    bids = G.gen_bids(seq, 10, 100)
    assert bids.schema.names == schemas.BID.names
    assert bids.where("auction_id <> id % 10 or price < 0 or price >= 100").count() == 0
    assert G.gen_bids(seq, 10, 0, per_auction=7).where("auction_id <> id div 7").count() == 0
    assert G.gen_bids(seq, 10, G.rising_price()).where("price >= greatest(1, id div 100)").count() == 0


def test_random_numbers_repeat_and_differ_by_factor(spark):
    numbers = spark.range(1000)
    one = numbers.select(values.seq_random(F.col("id"), 1000).alias("r"))
    assert one.exceptAll(numbers.select(values.seq_random(F.col("id"), 1000))).count() == 0
    other = numbers.where(
        values.seq_random(F.col("id"), 1000) == values.seq_random(F.col("id") * 137, 1000)
    )
    assert other.count() < 20


def test_persons_cycle_through_states(spark):
    people = G.gen_persons(G.sequence(spark, 101)).orderBy("id").collect()
    assert (people[4].state, people[50].state, people[99].state) == ("CA", "AL", "WY")
    assert people[7].name == "Seller #7" and len(set(p.state for p in people)) == 50
    bare = G.gen_persons(G.sequence(spark, 100), keys=5, with_state=False)
    assert bare.where("state is not null or id >= 5").count() == 0


def test_moving_sellers(spark):
    rows = G.gen_auctions_of_moving_sellers(G.sequence(spark, 3000), 10, "1 second")
    assert rows.where("seller_id < 0 or seller_id > id div 100").count() == 0
    early = rows.where("id < 100 and seller_id = 0 and category = 1")
    assert early.count() > 80
    late = rows.where("id >= 1000 and seller_id <= id div 100 - 10")
    assert late.count() == 0


def test_tickers(spark):
    trades = G.gen_trades(G.sequence(spark, 60), 27)
    names = [r.ticker for r in trades.orderBy("time").collect()]
    assert names[:2] == ["AA", "BA"] and names[25:28] == ["ZA", "AB", "AA"]
    with pytest.raises(ValueError):
        values.letters_for(26**5 + 1)


@pytest.mark.parametrize("total", [1, 2, 20, 21, 22, 100])
def test_generated_text_equals_the_writing_loop(spark, total):
    text = ""
    for i in range(total):
        text += str(i % 7) + ("\n" if i % 20 == 0 else " ")
    expected = [line.strip() for line in (text + "\n").split("\n") if line.strip()]
    lines = G.gen_words(G.text_line_numbers(spark, total), total, 7).orderBy("line")
    assert [r.value for r in lines.collect()] == expected


def test_item_labels(spark):
    rows = G.item_descriptions(spark, 12).orderBy("auction_id").collect()
    assert rows[11] == (11, "Auctioned Item #00011") and len(rows) == 12


def test_generate_from_functions(spark):
    rows = G.generate(
        G.sequence(spark, 3), twice=lambda n, t: n * 2, when=lambda n, t: t
    )
    assert [r.twice for r in rows.orderBy("twice").collect()] == [0, 2, 4]


def test_generators_do_not_shuffle(spark):
    for df in (
        G.gen_trades(G.sequence(spark, 10), 5),
        G.gen_auctions(G.sequence(spark, 10), 5, "1 second", "2 seconds"),
        G.gen_words(G.text_line_numbers(spark, 100), 100, 7),
    ):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_null_orders_keep_their_row(spark):
    rows = spark.createDataFrame([(1, None, "a"), (2, None, "b"), (2, 5, "c")], "key int, at int, v string")
    got = {(r.key, r.at, r.v) for r in tables.last_per_key(rows, ["key"], "at").collect()}
    assert got == {(1, None, "a"), (2, 5, "c")}
