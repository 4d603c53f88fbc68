"""Streams over several micro-batches, late rows, restarts; compared with their batch twins."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from eventflow import schemas
from eventflow.operators import auctions as A
from eventflow.operators import shaping as S
from eventflow.operators import text as T
from eventflow.operators import windows as W
from eventflow.sinks import files, tables
from eventflow.sources import generate as G
from eventflow.sources import readers
from eventflow.streaming import auctions as SA
from eventflow.streaming import running as SR
from eventflow.streaming.processors import leading_offers

T0 = datetime(2024, 1, 1)
FAR = 100_000


def at(seconds):
    return T0 + timedelta(seconds=seconds)


class Feed:
    """A folder that micro-batches arrive in, one file each."""

    def __init__(self, spark, folder, schema):
        self.spark, self.folder, self.schema, self.files = spark, folder, schema, 0
        folder.mkdir()

    def add(self, rows):
        staging = self.folder.parent / f".{self.folder.name}-{self.files}"
        df = self.spark.createDataFrame(rows, self.schema)
        df.coalesce(1).write.parquet(str(staging))
        part = next(p for p in staging.iterdir() if p.name.startswith("part-"))
        (self.folder / f"{self.files:04d}.parquet").write_bytes(part.read_bytes())
        self.files += 1

    def stream(self, ts="ts"):
        reader = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1)
        return W.with_event_time(reader.parquet(str(self.folder)), ts)


def test_leading_offers_are_the_rising_records():
    offers = [(1, 10, 5), (2, 10, 5), (3, 12, 4), (4, 15, 9), (5, 15, 7), (6, 20, 9), (7, 1, 3)]
    assert leading_offers(offers) == [(7, 1, 3), (1, 10, 5), (4, 15, 9)]


def winning(spark, tmp_path, steps, hot=None, folder=None):
    """Run steps of (auctions, bids), each in a micro-batch of its own."""
    lots = Feed(spark, tmp_path / "auctions", schemas.AUCTION)
    offers = Feed(spark, tmp_path / "bids", schemas.BID)
    folder = str(tmp_path / "run")
    rows = None
    for auctions, bids in steps:
        lots.add(auctions)
        offers.add(bids)
        won = SA.winning_bids(lots.stream(), offers.stream(), "1000 seconds", hot=hot, salts=4)
        rows = SR.run_to_table(won, folder=folder, allow_late=True)  # every step is a restart
    return {(r.auction_id, r.bid_id) for r in rows.collect()}


MARK = ([(990, at(FAR), 0, 0, at(2 * FAR))], [(990, at(FAR), 991, 1)])


@pytest.mark.parametrize("hot", [None, [1, 3]])
def test_winning_bids_across_batches_and_restarts(spark, tmp_path, hot):
    steps = [
        # Bids on 1 and 2 come before their auctions; 1 at expiry and after; a tie on 2.
        ([], [(10, at(5), 1, 7), (11, at(6), 2, 4), (12, at(4), 2, 4)]),
        (
            [(1, at(6), 5, 0, at(50)), (2, at(6), 5, 1, at(60)), (3, at(6), 6, 1, at(70))],
            [(13, at(50), 1, 9), (14, at(51), 1, 99), (15, at(7), 4, 1)],
        ),
        # The watermark is now 6: a bid of second 1 is late and does not count.
        ([], [(16, at(1), 2, 1000), (17, at(52), 2, 5), (18, at(80), 3, 5)]),
        MARK,
    ]
    assert winning(spark, tmp_path, steps, hot) == {(1, 13), (2, 17)}


def test_bid_at_expiry_in_the_batch_that_closes_the_auction(spark, tmp_path):
    steps = [
        ([(1, at(0), 5, 0, at(50))], [(10, at(1), 1, 5)]),
        ([(990, at(FAR), 0, 0, at(2 * FAR))], [(11, at(50), 1, 8), (12, at(FAR), 991, 1)]),
    ]
    assert winning(spark, tmp_path, steps) == {(1, 11)}


def test_rolling_results_follow_the_winning_bids(spark, tmp_path):
    auctions = [(i, at(i), i % 2, i % 3, at(100 + (i * 7) % 40)) for i in range(30)]
    bids = [(100 + i, at(i % 90), i % 30, (i * 37) % 101) for i in range(200)]
    lots = Feed(spark, tmp_path / "auctions", schemas.AUCTION)
    offers = Feed(spark, tmp_path / "bids", schemas.BID)
    lots.add(auctions)
    offers.add(bids)
    for mark in (at(120), at(FAR)):
        lots.add([(990, mark, 0, 0, at(2 * FAR))])
        offers.add([(990, mark, 991, 1)])
    batch = A.winning_bids(
        spark.createDataFrame(auctions, schemas.AUCTION),
        spark.createDataFrame(bids, schemas.BID),
    )
    won = lambda: SA.winning_bids(lots.stream(), offers.stream(), "1 day")
    for stream, table in (
        (SA.q04_average_price_for_category(won()), A.q04_average_price_for_category(batch)),
        (SA.q06_avg_selling_price(won(), 3), A.q06_avg_selling_price(batch, 3)),
    ):
        got = SR.run_to_table(stream).select(table.columns)
        assert got.count() == 30
        assert got.exceptAll(table).count() == 0
    final = SR.current_rows(SR.run_to_table(SA.q04_final(won()), "update"), ["category"])
    assert final.select("category", "average_price", "latest_auction_end").exceptAll(
        A.q04_final(batch)
    ).count() == 0


@pytest.fixture
def bid_feed(spark, tmp_path):
    feed = Feed(spark, tmp_path / "bids", schemas.BID)
    for part in range(3):
        feed.add(
            [(i, at(i), (i * i) % 7, (i * 31) % 53) for i in range(part * 100, part * 100 + 100)]
        )
    feed.add([(9999, at(FAR), 0, 0)])
    return feed


def closed(spark, feed, build):
    """The batch result without the sentinel row's windows."""
    bids = spark.read.schema(feed.schema).parquet(str(feed.folder))
    return build(bids).where(F.col("window_end") <= F.lit(at(FAR)))


@pytest.mark.parametrize("method", ["direct", "panes"])
def test_sliding_counts(spark, bid_feed, method):
    def build(bids):
        return W.sliding_count(bids, "ts", "auction_id", "40 seconds", "10 seconds", method)

    got = SR.run_to_table(build(bid_feed.stream()))
    want = closed(spark, bid_feed, build)
    assert got.count() > 0
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


@pytest.mark.parametrize("slide", ["10 seconds", "2 seconds"])
def test_hot_items(spark, bid_feed, slide):
    counts, ranking = SA.q05_hot_items(bid_feed.stream(), "40 seconds", slide, 3)
    got = SR.run_to_table(counts, per_batch=ranking)
    want = closed(spark, bid_feed, lambda b: A.q05_hot_items(b, "40 seconds", slide, 3))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_highest_bids(spark, bid_feed):
    got = SR.run_to_table(A.q07_highest_bid(bid_feed.stream(), "30 seconds"))
    want = closed(spark, bid_feed, lambda b: A.q07_highest_bid(b, "30 seconds"))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_late_rows_count_while_their_window_is_open_but_not_their_pane(spark, tmp_path):
    feed = Feed(spark, tmp_path / "bids", schemas.BID)
    feed.add([(1, at(5), 1, 0), (2, at(35), 1, 0)])
    feed.add([(3, at(36), 1, 0)])
    feed.add([(4, at(6), 1, 0)])  # late against the watermark before this batch, 35
    feed.add([(5, at(FAR), 1, 0)])
    totals = {}
    for method in ("direct", "panes"):
        counts = W.sliding_count(feed.stream(), "ts", [], "40 seconds", "10 seconds", method)
        rows = SR.run_to_table(counts, allow_late=True).where(F.col("window_start") == F.lit(at(0)))
        totals[method] = rows.first().n
    assert totals == {"direct": 4, "panes": 3}


def test_persons_and_auctions_in_any_order(spark, tmp_path):
    people = Feed(spark, tmp_path / "persons", schemas.PERSON)
    lots = Feed(spark, tmp_path / "auctions", schemas.AUCTION)
    lots.add([(10, at(5), 1, 0, at(99)), (11, at(6), 2, 0, at(99))])
    people.add([(2, at(4), "b", "CA")])
    lots.add([(12, at(8), 2, 0, at(99)), (13, at(9), 2, 1, at(99))])
    people.add([(1, at(9), "a", "OR"), (3, at(9), "c", "NY")])
    joined = A.q03_local_item_suggestion(people.stream(), lots.stream(), ttl="60 seconds")
    got = {(r.seller_name, r.auction_id) for r in SR.run_to_table(joined).collect()}
    assert got == {("a", 10), ("b", 11), ("b", 12)}
    with pytest.raises(ValueError):
        A.q03_local_item_suggestion(people.stream(), lots.stream())


def test_new_users(spark, tmp_path):
    people = Feed(spark, tmp_path / "persons", schemas.PERSON)
    lots = Feed(spark, tmp_path / "auctions", schemas.AUCTION)
    persons = [(i % 4, at(i * 7), f"p{i}", None) for i in range(12)]
    auctions = [(i, at(i * 4), i % 5, 0, None) for i in range(20)]
    for k in range(2):
        people.add(persons[k * 6 : k * 6 + 6])
        lots.add(auctions[k * 10 : k * 10 + 10])
    people.add([(77, at(FAR), "x", None)])
    lots.add([(78, at(FAR), 78, 0, None)])
    args = ("20 seconds", "10 seconds")
    got = SR.run_to_table(A.q08_monitor_new_users(people.stream(), lots.stream(), *args))
    want = A.q08_monitor_new_users(
        spark.createDataFrame(persons, schemas.PERSON),
        spark.createDataFrame(auctions, schemas.AUCTION),
        *args,
    )
    assert want.count() > 0
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_side_input_on_a_stream(spark, bid_feed):
    joined = A.q13_bounded_side_input(bid_feed.stream(), G.item_descriptions(spark, 3))
    rows = SR.run_to_table(joined)
    assert rows.count() == 301
    assert rows.where("description is null and auction_id < 3").count() == 0


def test_word_counts_are_updated_batch_by_batch(spark, tmp_path):
    folder = tmp_path / "text"
    folder.mkdir()
    run = str(tmp_path / "run")
    totals = []
    for i, text in enumerate(["a b a\n", "a c\n"]):
        (folder / f"{i}.txt").write_text(text)
        lines = readers.read_lines(spark, str(folder), stream=True)
        counted = SR.run_to_table(T.word_count(lines), "update", folder=run)
        totals.append({r.word: r.n for r in SR.current_rows(counted, ["word"]).collect()})
    assert totals == [{"a": 2, "b": 1}, {"a": 3, "b": 1, "c": 1}]
    assert counted.where("word = 'a'").count() == 2


def test_running_word_count_of_a_stream(spark, tmp_path):
    folder = tmp_path / "text"
    folder.mkdir()
    (folder / "x.txt").write_text("a b a")
    words = T.tokenize(readers.read_lines(spark, str(folder), stream=True))
    rows = SR.run_to_table(T.running_word_count(words, []), "update").collect()
    assert {(r.word, r.n) for r in rows} == {("a", 2), ("b", 1)}


def test_windows_by_arrival_hold_every_row(spark, bid_feed, tmp_path):
    bids = spark.readStream.schema(schemas.BID).parquet(str(bid_feed.folder))
    arriving = W.with_event_time(W.with_arrival(bids), "arrival")
    counts = W.arrival_window_count(arriving, "arrival", "auction_id", "1 hour", "30 minutes")
    rows = SR.run_to_table(counts, "update")
    latest = SR.current_rows(rows, ["window_start", "window_end", "auction_id"])
    assert latest.agg(F.sum("n")).first()[0] == 2 * 301


def drain(writer):
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def test_stream_writers(spark, bid_feed, tmp_path):
    bids = bid_feed.stream()
    lines = S.comma_lines(bids, "id", "price")
    drain(files.write_lines(lines, str(tmp_path / "lines"), str(tmp_path / "c1")))
    assert spark.read.text(str(tmp_path / "lines")).count() == 301
    drain(files.write_csv(bids, str(tmp_path / "csv"), checkpoint=str(tmp_path / "c2")))
    assert spark.read.csv(str(tmp_path / "csv")).count() == 301
    drain(
        files.write_per_batch(
            lines, str(tmp_path / "t"), str(tmp_path / "c3"), lambda b: 1000 * b
        )
    )
    folders = sorted(p.name for p in (tmp_path / "t").iterdir())
    assert folders == ["t-0", "t-1000", "t-2000", "t-3000"]
    logs = readers.read_latency_log(spark, str(tmp_path / "t"), "folders")
    assert logs.where("batch_ms = 1000").count() == 100
    with pytest.raises(ValueError):
        files.write_lines(lines, str(tmp_path / "x"))


def test_one_stream_two_sinks(spark, bid_feed, tmp_path):
    seen = []

    def count(batch, batch_id):
        seen.append(batch.count())

    def save(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{tmp_path}/rows/batch_id={batch_id}")

    drain(files.fan_out(bid_feed.stream(), str(tmp_path / "c"), count, save))
    assert seen == [100, 100, 100, 1]
    assert spark.read.parquet(f"{tmp_path}/rows").count() == 301


@pytest.mark.parametrize("rewrite_every", [3, 100])
def test_stream_into_a_keyed_table(spark, bid_feed, tmp_path, rewrite_every):
    path = str(tmp_path / "table")
    writer = tables.upsert_stream(
        bid_feed.stream(), path, ["auction_id"], "id", str(tmp_path / "c"), rewrite_every
    )
    drain(writer)
    kinds = [f.rsplit("/", 1)[1][:4] for _, f in sorted(tables.versions(spark, path).items())]
    assert kinds == ["full", "part", "full" if rewrite_every == 3 else "part", "part"]
    table = readers.read_table(spark, path, ["auction_id"])
    rows = {r.auction_id: r.id for r in table.collect()}
    expected = {}
    for i in [*range(300), 9999]:
        expected[0 if i == 9999 else (i * i) % 7] = i
    assert rows == expected


def test_every_write_into_a_keyed_table_counts(spark, tmp_path):
    """A batch write, a stream, another write in between, and a second stream with its own checkpoint."""
    path, source = str(tmp_path / "table"), str(tmp_path / "in")
    shape = "key int, at int, v string"

    def arrive(*rows):
        spark.createDataFrame(list(rows), shape).coalesce(1).write.mode("append").parquet(source)

    def stream(checkpoint):
        rows = spark.readStream.schema(shape).parquet(source)
        drain(tables.upsert_stream(rows, path, ["key"], "at", str(tmp_path / checkpoint)))

    def now():
        return {r.key: r.v for r in readers.read_table(spark, path, ["key"]).collect()}

    tables.upsert_table(spark.createDataFrame([(1, 1, "old"), (3, 1, "stays")], shape), path, ["key"], "at")
    arrive((1, 2, "new"), (2, 2, "added"))
    stream("c1")
    assert now() == {1: "new", 2: "added", 3: "stays"}
    tables.upsert_table(spark.createDataFrame([(2, 3, "batch")], shape), path, ["key"], "at", rewrite=False)
    arrive((4, 4, "later"))
    stream("c1")
    assert now() == {1: "new", 2: "batch", 3: "stays", 4: "later"}
    stream("c2")
    assert now() == {1: "new", 2: "added", 3: "stays", 4: "later"}


def test_generated_stream_repeats_the_table(spark):
    stream = G.gen_bids(G.sequence_stream(spark, 50), 10)
    query = (
        stream.writeStream.format("memory").queryName("generated").trigger(once=True).start()
    )
    query.awaitTermination()
    table = G.gen_bids(G.sequence(spark, 1000), 10)
    got = spark.table("generated").select("id", "auction_id", "price")
    assert got.count() >= 50
    assert got.exceptAll(table.select("id", "auction_id", "price")).count() == 0


def test_query_reports_its_watermark(spark, bid_feed, tmp_path):
    counts = W.sliding_total(bid_feed.stream(), "ts", "40 seconds", "10 seconds")
    query = SR.start(counts, lambda b, i: b.collect(), str(tmp_path / "c"))
    query.awaitTermination()
    assert SR.watermark_of(query).startswith("2024-01-02")


def test_trade_monitor_from_messages_to_report(spark, tmp_path):
    """Messages are decoded, counted per window, and the latency of the counts is reported."""
    from eventflow.functions import codec
    from eventflow.operators import latency as L
    from eventflow.streaming import measuring as M

    trades = G.gen_trades(G.sequence(spark, 4000, per_second=40, start_micros=10**15), 60)
    folder = tmp_path / "topic"
    codec.encode_trade(trades).repartition(1).write.parquet(str(folder))
    messages = spark.readStream.schema("key long, value binary").parquet(str(folder))
    stream = W.with_event_time(codec.decode_trade(messages), "time")
    counts = M.trade_monitor(stream, "20 seconds", "5 seconds")
    arrivals = M.measure(counts, "window_end")
    table = M.trade_monitor(trades, "20 seconds", "5 seconds")
    assert table.where("ticker not like '%AA'").count() == 0
    last = trades.agg(F.max("time")).first()[0]
    closed_times = table.where(F.col("window_end") <= F.lit(last)).select("window_end").distinct()
    assert arrivals.select("ts").exceptAll(closed_times).count() == 0
    assert arrivals.count() == closed_times.count() > 10
    M.write_report(arrivals, str(tmp_path / "report"), 0, 10**9)
    log = [r.value for r in spark.read.text(str(tmp_path / "report/log")).collect()]
    assert len(log) >= 1 and all(int(line.split(",")[1]) >= 0 for line in log)
    back = L.parse_profile(spark.read.text(str(tmp_path / "report/histogram")))
    assert back.count() >= 1


def test_latency_counts_the_work_of_a_batch(spark, tmp_path):
    """A column that takes a second to compute is in the latency, though the log does not read it."""
    import time

    from eventflow.streaming import measuring as M

    @F.udf("long")
    def slow(n):
        time.sleep(1.0)
        return n

    spark.range(1).select(F.lit(at(5)).alias("ts"), "id").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, id long").parquet(str(tmp_path / "in"))
    began = time.time()
    arrivals = M.measure(stream.withColumn("worked", slow("id")), "ts", folder=str(tmp_path / "out")).collect()
    assert len(arrivals) == 1
    assert arrivals[0].arrival.timestamp() - began > 1.0
    assert spark.read.parquet(str(tmp_path / "out/rows")).first().worked == 0
    fixed = M.measure(stream, "ts", folder=str(tmp_path / "fixed"), clock=lambda n: 7_000_000 + n).collect()
    assert [r.arrival.timestamp() for r in fixed] == [7.0]


def test_a_batch_folder_keeps_its_time_when_repeated(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run has lost its checkpoint and does batch 0 again
        writer = files.write_per_batch(stream, str(tmp_path / "out/run"), str(tmp_path / "c"))
        writer.option("checkpointLocation", str(tmp_path / f"c{_}")).trigger(availableNow=True).start().awaitTermination()
    assert len(list((tmp_path / "out/run").glob("t-*"))) == 1
