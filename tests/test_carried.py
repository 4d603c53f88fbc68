"""Streams that carry tables: winning bids over restarts, repeats, late rows and orphans; replay by time."""

import random
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from test_streaming import Feed, at

from eventflow import schemas
from eventflow.operators import auctions as A
from eventflow.operators import windows as W
from eventflow.sources.replay import Replay
from eventflow.streaming import carried as C
from eventflow.streaming import closing as SC

WAIT, FAR = 100, 100_000
MARK = ([(990, at(FAR), 0, 0, at(2 * FAR))], [(990, at(FAR), 991, 1)])


def expected(auctions, bids):
    """(winners, orphans) of auctions (id, start, seller, category, end) and bids (id, ts, auction, price) in seconds."""
    lots = {}
    for lot in sorted(auctions, key=lambda a: a[1]):
        lots.setdefault(lot[0], lot)
    offers, orphans = defaultdict(list), []
    for bid in bids:
        lot = lots.get(bid[2])
        if lot is None or not lot[1] - WAIT <= bid[1] <= lot[4] + WAIT:
            orphans.append((bid[2], bid[0]))
        elif bid[1] <= lot[4]:
            offers[lot[0]].append((-bid[3], bid[1], bid[0]))
    return {k: min(v)[2] for k, v in offers.items()}, sorted(orphans)


def timed(rows, *columns):
    return [tuple(at(x) if i in columns else x for i, x in enumerate(r)) for r in rows]


def work_off(spark, tmp_path, steps, follow=None):
    lots, offers = Feed(spark, tmp_path / "auctions", schemas.AUCTION), Feed(spark, tmp_path / "bids", schemas.BID)
    run = None
    for auctions, bids in steps:
        lots.add(auctions)
        offers.add(bids)
        run = SC.winning_bids(lots.stream(), offers.stream(), f"{WAIT} seconds", follow, str(tmp_path / "run")).run()
    return run


def test_any_cut_gives_the_same(spark, tmp_path):
    """Random auctions and bids in order of time, a third of the bids on one auction, in several cuts; every step is a restart."""
    rng = random.Random(2)
    auctions = [(i, 10 * i, i % 3, i % 2, 10 * i + rng.randint(5, 200)) for i in range(30)]
    bids = [(n, rng.randint(0, 500), 7 if n % 3 == 0 else rng.randint(0, 34), rng.randint(1, 9)) for n in range(300)]
    want, orphans = expected(auctions, bids)
    for cuts in ([600], [100, 110, 300, 600]):
        steps, low = [], 0
        for high in cuts:
            steps.append((
                timed([a for a in auctions if low <= a[1] < high], 1, 4),
                timed([b for b in bids if low <= b[1] < high], 1),
            ))
            low = high
        folder = tmp_path / str(len(cuts))
        folder.mkdir()
        run = work_off(spark, folder, [*steps, MARK])
        assert {r.auction_id: r.bid_id for r in run.table("won", SC.WON).collect()} == want
        assert sorted((r.auction_id, r.bid_id) for r in run.table("orphans", SC.ORPHANS).collect()) == orphans
        assert run.table("late", SC.LATE).count() == 0


def test_late_rows_are_kept_apart(spark, tmp_path):
    steps = [
        ([(1, at(0), 5, 0, at(400))], [(10, at(5), 1, 7)]),
        ([(2, at(200), 5, 0, at(300))], [(11, at(205), 1, 5)]),
        ([(3, at(20), 5, 0, at(300))], [(12, at(199), 1, 99), (13, at(200), 1, 8)]),
        MARK,
    ]
    run = work_off(spark, tmp_path, steps)
    late = {(r.kind, r.key, r.bid_id) for r in run.table("late", SC.LATE).collect()}
    assert late == {("auction", 3, None), ("bid", 1, 12)}
    assert {(r.auction_id, r.bid_id) for r in run.table("won", SC.WON).collect()} == {(1, 13)}


def test_a_step_given_slowly_is_one_batch(spark, tmp_path):
    """Each micro-batch is a pass over what is carried, so a step's files must not be worked off one by one."""
    lots, offers = Feed(spark, tmp_path / "auctions", schemas.AUCTION), Feed(spark, tmp_path / "bids", schemas.BID)
    run = SC.winning_bids(lots.stream(), offers.stream(), "50 seconds", folder=str(tmp_path / "run"))

    def feed():
        for auctions, bids in [
            ([(1, at(0), 5, 0, at(40))], [(10, at(5), 1, 7), (11, at(45), 1, 9)]),
            ([(2, at(60), 5, 0, at(90))], [(12, at(61), 2, 5)]),
            MARK,
        ]:
            lots.add(auctions)
            time.sleep(3)
            offers.add(bids)
            yield

    run.run(feed())
    assert sorted(run.notes("state")) == [0, 1, 2]
    assert {(r.auction_id, r.bid_id) for r in run.table("won", SC.WON).collect()} == {(1, 10), (2, 12)}


def test_what_is_decided_is_not_carried(spark, tmp_path):
    """Bids after the expiry go no further; a winner that was emitted is not carried again."""
    steps = [
        ([(1, at(0), 5, 0, at(40)), (2, at(1), 5, 0, at(900))], [(10, at(5), 1, 7), (11, at(45), 1, 9), (12, at(46), 3, 9)]),
        ([(4, at(80), 5, 0, at(900))], [(13, at(80), 2, 5)]),
        ([(5, at(90), 5, 0, at(900))], [(14, at(90), 2, 4)]),
    ]
    run = work_off(spark, tmp_path, steps)

    def carried(name, number, column):
        rows = spark.read.parquet(f"{run.root}/carried/{name}/batch_id={number}")
        return sorted(r[0] for r in rows.select(column).collect())

    assert {(r.auction_id, r.bid_id) for r in run.table("won", SC.WON).collect()} == {(1, 10)}
    assert carried("met", 1, "bid_id") == [12, 13]
    assert carried("leading", 2, "bid_id") == [13]
    assert carried("lots", 2, "auction_id") == [1, 2, 4, 5]


def test_a_repeated_batch_counts_once(spark, tmp_path):
    lots, offers = Feed(spark, tmp_path / "auctions", schemas.AUCTION), Feed(spark, tmp_path / "bids", schemas.BID)
    run = SC.winning_bids(lots.stream(), offers.stream(), "50 seconds", SC.rolling_averages, str(tmp_path / "run"))
    kinds = run.stream.schema.simpleString().removeprefix("struct<").removesuffix(">")
    names = [f.name for f in run.stream.schema]

    def rows(*given):
        return spark.createDataFrame([tuple(g.get(n) for n in names) for g in given], kinds.replace(":", " "))

    steps = [
        rows({"kind": "auction", "key": 1, "ts": at(0), "expires": at(9), "category": 4, "seller_id": 3},
             {"kind": "bid", "key": 1, "ts": at(2), "bid_id": 5, "price": 70}),
        rows({"kind": "auction", "key": 2, "ts": at(20), "expires": at(30), "category": 4, "seller_id": 3},
             {"kind": "bid", "key": 2, "ts": at(22), "bid_id": 6, "price": 30}),
        rows({"kind": "auction", "key": 3, "ts": at(FAR), "expires": at(2 * FAR)}, {"kind": "bid", "key": 9, "ts": at(FAR)}),
    ]
    for number, step in enumerate(steps):
        for _ in range(2):
            run.step(C.Batch(spark, run.root, number, step))
    won = run.table("won", SC.WON).orderBy("auction_id").collect()
    assert [(r.auction_id, r.bid_id, r.price) for r in won] == [(1, 5, 70), (2, 6, 30)]
    averages = run.table("rolling", SC.ROLLING).orderBy("auction_id").collect()
    assert [r.average_price for r in averages] == [70.0, 50.0]
    assert run.notes("state")[2]["lots"] == 1


@pytest.mark.parametrize("n", [1, 3])
def test_averages_that_follow(spark, tmp_path, n):
    rng = random.Random(n)
    auctions = [(i, 5 * i, rng.randint(0, 2), rng.choice([None, 0, 1]), 5 * i + rng.randint(1, 60)) for i in range(40)]
    bids = [(i, a[1], a[0], rng.randint(1, 50)) for i, a in enumerate(auctions)]
    steps = [(timed(auctions[k : k + 10], 1, 4), timed(bids[k : k + 10], 1)) for k in range(0, 40, 10)]

    def follow(batch, won):
        SC.rolling_averages(batch, won)
        SC.last_prices(n)(batch, won)

    run = work_off(spark, tmp_path, [*steps, MARK], follow)
    won = run.table("won", SC.WON)
    for name, schema, want in (
        ("rolling", SC.ROLLING, A.q04_average_price_for_category(won)),
        ("last", SC.LAST, A.q06_avg_selling_price(won, n)),
    ):
        got = {r.auction_id: r.average_price for r in run.table(name, schema).collect()}
        assert got == pytest.approx({r.auction_id: r.average_price for r in want.collect()})
        assert len(got) == 40


def test_replay_gives_ranges_in_order(spark):
    rows = spark.range(1000).select(
        F.when(F.col("id") % 50 != 0, F.timestamp_seconds(F.pmod(F.xxhash64("id"), F.lit(1000)))).alias("ts"), "id"
    ).repartition(5)
    replay = Replay(spark, "100 seconds")
    stream = replay.add("t", rows.where("ts is null or ts < timestamp_seconds(300) or ts >= timestamp_seconds(500)"), "ts")
    seen = []

    def step(batch):
        mark = batch.clock({"t": 100_000_000}, kind=None)[0]
        seen.append((mark, [r.ts for r in batch.rows.collect()], batch.late))

    C.Carried(W.with_event_time(stream, "ts", "100 seconds"), step).run(replay.feed())
    times = [sorted(t for t in ts if t) for _, ts, _ in seen]
    times = [t for t in times if t]
    assert len(times) == 8
    assert all(a[-1] < b[0] for a, b in zip(times, times[1:], strict=False))
    assert sum(len(ts) for _, ts, _ in seen) == sum(len(t) for t in times) + 20
    assert all(late == 0 for *_, late in seen)
