"""Every operator as a query over the driver's tables: (spark, folder) -> DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventflow.functions import codec, values
from eventflow.operators import aggregates as U
from eventflow.operators import auctions as A
from eventflow.operators import latency as L
from eventflow.operators import reports as R
from eventflow.operators import shaping as S
from eventflow.operators import text as T
from eventflow.operators import windows as W
from eventflow.session import checkpoint_root
from eventflow.sinks import files
from eventflow.sinks import tables as K
from eventflow.sources import generate as G
from eventflow.sources import readers, star
from eventflow.sources.replay import Replay
from eventflow.streaming import auctions as SA
from eventflow.streaming import closing as SC
from eventflow.streaming import measuring as SM
from eventflow.streaming import running as SR
from eventflow.streaming.carried import Carried

Query = Callable[[SparkSession, str], DataFrame]
Build = Callable[[star.Load], DataFrame]

QUERIES: dict[str, Query] = {}

FIXED_SIZE = {"nation", "region"}
# Files of a table in one micro-batch of a stream. Results do not depend on it.
FILES_PER_BATCH = 1_000
STREAMED = ("events", "orders", "lineitem", "customer", "documents")


def query(build: Callable[[star.Load], DataFrame]) -> Callable[[star.Load], DataFrame]:
    """Register a query under its function name; it is given a table loader."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return build(star.loader(spark, folder))

    QUERIES[build.__name__] = run
    return build


class StreamedTables:
    """A loader whose tables are streams; nations do not grow and stay a table.

    ``close`` says that the tables in ``ends`` are complete: a row far ahead in time
    moves the watermark past everything before it and stays in open windows itself.
    """

    def __init__(self, spark: SparkSession, folder: str, ends: tuple[str, ...]):
        self.spark, self.folder, self.ends = spark, folder, ends
        self.table = star.loader(spark, folder)
        self.marks = f"{checkpoint_root(spark)}/ends-{uuid.uuid4().hex}"
        for name in ends:
            self.table(name).limit(0).write.parquet(f"{self.marks}/{name}")

    def __call__(self, name: str) -> DataFrame:
        if name in FIXED_SIZE:
            return self.table(name)
        rows = SR.table_stream(self.spark, f"{self.folder}/{name}.parquet", FILES_PER_BATCH)
        if name not in self.ends:
            return rows
        return rows.unionByName(SR.table_stream(self.spark, f"{self.marks}/{name}"))

    def close(self) -> None:
        for name in self.ends:
            rows = star.end_rows(self.spark, name, self.table(name).schema)
            rows.write.mode("append").parquet(f"{self.marks}/{name}")


def stream_query(*ends: str) -> Callable[[Build], Build]:
    """As ``query``, with tables read as streams; times come back without zone.

    ``ends`` names the tables whose last windows wait for the end of the input.
    """

    def register(build: Build) -> Build:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            tables = StreamedTables(spark, folder, ends)
            with SR.state_partitions(spark, SR.partitions_for(tables.table, STREAMED)):
                return zone_less(build(tables))

        QUERIES[build.__name__] = run
        return build

    return register


def on_time(df: DataFrame, table: str, ts: str = "ts") -> DataFrame:
    """Event time with the lag that covers the disorder of the table the rows are from."""
    return W.with_event_time(df, ts, star.LAGS[table])


def zone_less(df: DataFrame) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select(
        *[
            F.col(c).cast("timestamp_ntz").alias(c) if kinds[c] == "timestamp" else F.col(c)
            for c in df.columns
        ]
    )


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def won(load: star.Load) -> DataFrame:
    return A.winning_bids(star.auctions(load), star.auction_bids(load))


# Stateless queries


@query
def q01_currency_conversion(load):
    return A.q01_currency_conversion(star.bids(load))


@query
def q02_selection(load):
    return A.q02_selection(star.bids(load))


@query
def sieve(load):
    return S.sieve(A.q01_currency_conversion(star.bids(load)), "id", 7)


@query
def q13_bounded_side_input(load):
    return A.q13_bounded_side_input(star.bids(load), star.items(load))


@query
def tagged_union(load):
    merged = S.tagged_union(person=star.persons(load), auction=star.auctions(load))
    return merged.select("kind", "id", "ts", "name", "state", "seller_id", "category", "expires")


@query
def ticker_suffix(load):
    return S.ticker_suffix(star.trades(load))


@query
def split_fields(load):
    return S.split_fields(star.log_lines(load), 5).select(
        *[F.col("fields")[i].alias(f"field_{i}") for i in range(5)]
    )


@query
def comma_lines(load):
    return S.comma_lines(L.latency_log(star.arrivals(load), "ts", "arrival"))


# Joins and what follows them


@query
def q03_local_item_suggestion(load):
    return A.q03_local_item_suggestion(star.persons(load), star.auctions(load), star.STATES)


@query
def q03_within_ttl(load):
    return A.q03_local_item_suggestion(
        star.persons(load), star.auctions(load), star.STATES, ttl="1000 days"
    )


@query
def q03_hot_sellers(load):
    """The hot-key plan, with the sellers that hold the most auctions taken as hot."""
    from eventflow.plans.skew import hot_keys

    auctions = star.auctions(load)
    hot = hot_keys(auctions, "seller_id", share=0.001, min_rows=1)
    return A.q03_local_item_suggestion(star.persons(load), auctions, star.STATES, hot=hot)


@query
def winning_bids(load):
    return won(load).select("auction_id", "seller_id", "category", "expires", "price")


@query
def winning_bids_of_started(load):
    best = A.winning_bids(star.auctions(load), star.auction_bids(load), require_started=True)
    return best.select("auction_id", "seller_id", "category", "expires", "price")


@query
def winning_bids_hot_auctions(load):
    """The hot-key plan of the same join."""
    from eventflow.plans.skew import hot_keys

    bids = star.auction_bids(load)
    hot = hot_keys(bids, "auction_id", share=0.00015, min_rows=1)
    best = A.winning_bids(star.auctions(load), bids, hot=hot)
    return best.select("auction_id", "seller_id", "category", "expires", "price")


@query
def q04_average_price_for_category(load):
    return rounded(A.q04_average_price_for_category(won(load)), "average_price")


@query
def q04_average_price_spread(load):
    return rounded(A.q04_average_price_for_category(won(load), spread=True), "average_price")


@query
def q04_final(load):
    return rounded(A.q04_final(won(load)), "average_price")


@query
def q06_avg_selling_price(load):
    return rounded(A.q06_avg_selling_price(won(load)), "average_price")


@query
def q06_avg_selling_price_spread(load):
    priced = A.q06_avg_selling_price(won(load), spread=True, block_rows=16)
    return rounded(priced, "average_price")


# Windows


@query
def q05_hot_items(load):
    return A.q05_hot_items(star.bids(load), "1 day", "6 hours")


@query
def q05_hot_items_panes(load):
    return A.q05_hot_items(star.bids(load), "1 day", "30 minutes")


@query
def q07_highest_bid(load):
    return A.q07_highest_bid(star.bids(load), "1 hour")


@query
def q08_monitor_new_users(load):
    met = A.q08_monitor_new_users(star.new_users(load), star.sales(load), "1 day", "12 hours")
    return met.drop("state")


@query
def sliding_total(load):
    return W.sliding_total(star.bids(load), "ts", "1 day", "6 hours")


@query
def trade_sliding_count(load):
    return W.sliding_count(star.trades(load), "time", "ticker", "1 day", "6 hours", "direct")


@query
def trade_sliding_count_panes(load):
    return W.sliding_count(star.trades(load), "time", "ticker", "1 day", "6 hours", "panes")


@query
def trade_sliding_count_uneven(load):
    return W.sliding_count(star.trades(load), "time", "ticker", "1 day", "10 hours")


@query
def trade_tumbling_count(load):
    return W.tumbling_count(star.trades(load), "time", "ticker", "6 hours")


@query
def trade_suffix_count(load):
    counts = W.sliding_count(star.trades(load), "time", "ticker", "1 day", "6 hours")
    return S.ticker_suffix(counts)


@query
def arrival_window_count(load):
    return W.arrival_window_count(star.arrivals(load), "arrival", "user_id", "1 day", "6 hours")


# Aggregates of one's own


@query
def user_aggregate(load):
    """Count, mean and variance of the prices of each ticker."""
    return rounded(U.aggregate(star.trades(load), ["ticker"], U.variance("price")), "mean", "variance")


@query
def user_aggregate_sliding(load):
    """The same over sliding windows, panes added and deducted."""
    trades = star.trades(load)
    moved = U.sliding_aggregate(trades, "time", ["ticker"], U.variance("price"), "1 day", "2 hours")
    return rounded(moved, "mean", "variance")


@query
def user_aggregate_pick_any(load):
    """The label of each auction and its bids, over sliding windows."""
    bids = star.bids(load).withColumn("label", values.item_label(F.col("auction_id")))
    return U.sliding_aggregate(bids, "ts", ["auction_id"], U.pick_any("label", "string"), "1 day", "6 hours")


@query
def user_aggregate_spread(load):
    """Lowest and highest price of each ticker over sliding windows, which nothing can be taken out of."""
    return U.sliding_aggregate(
        star.trades(load), "time", ["ticker"], U.spread_of("price", "int"), "1 day", "2 hours"
    )


# Words


@query
def tokenize(load):
    documents = load("documents").select("doc_id", "text")
    return T.tokenize_with_place(documents, "text")


@query
def word_count(load):
    return T.word_count(star.lines(load))


@query
def running_word_count(load):
    words = T.tokenize_with_place(load("documents").select("doc_id", "text"), "text")
    return T.running_word_count(words, ["doc_id", "place"])


@query
def running_word_count_spread(load):
    words = T.tokenize_with_place(load("documents").select("doc_id", "text"), "text")
    return T.running_word_count(words, ["doc_id", "place"], spread=True)


# Generators over the events' numbers


@query
def generated_bids(load):
    rising = G.rising_price(values.lehmer_mix)
    return G.gen_bids(star.numbered(load), 100, rising, mix=values.lehmer_mix)


@query
def generated_auctions(load):
    return G.gen_auctions(
        star.numbered(load), 100, "1 hour", "3 hours", mix=values.lehmer_mix
    )


@query
def generated_auctions_of_moving_sellers(load):
    return G.gen_auctions_of_moving_sellers(
        star.numbered(load), 20, "1 hour", mix=values.lehmer_mix
    )


@query
def generated_persons(load):
    return G.gen_persons(star.numbered(load))


@query
def generated_trades(load):
    return G.gen_trades(star.numbered(load), 1000)


@query
def generated_text(load):
    """As many lines as there are documents."""
    documents = load("documents")
    total = (documents.agg(F.count(F.lit(1)).alias("n")).scalar() - 1) * G.WORDS_PER_LINE + 1
    return G.gen_words(documents.select(F.col("doc_id").alias("id")), total, 997)


@query
def item_descriptions(load):
    return star.items(load)


# Trade messages and keyed tables


@query
def trade_encode(load):
    messages = codec.encode_trade(star.trades(load))
    return messages.select("key", F.hex("value").alias("message"))


@query
def trade_codec_roundtrip(load):
    return zone_less(codec.decode_trade(codec.encode_trade(star.trades(load))))


@query
def upsert_table(load):
    """Clicks and errors laid over all other events, by user: the latest of them wins, else the latest other."""
    events = load("events").select("user_id", "event_id", "ts", "value", "event_type")
    newer = F.coalesce(F.col("event_type").isin("click", "error"), F.lit(False))
    old = K.last_per_key(events.where(~newer), ["user_id"], "event_id")
    return K.merge_last(old, events.where(newer), ["user_id"], "event_id")


# Latency and reports


@query
def latency_log(load):
    return L.latency_log(star.arrivals(load), "ts", "arrival")


@query
def latency_log_spread(load):
    return L.latency_log(star.arrivals(load), "ts", "arrival", spread=True)


_DAY_MS = 86_400_000
_WARMUP, _TOTAL = 2 * _DAY_MS, 25 * _DAY_MS


@query
def latency_profile(load):
    log = L.latency_log(star.arrivals(load), "ts", "arrival")
    return rounded(L.latency_profile(log, _WARMUP, _TOTAL), "percentile", "inverse")


@query
def latency_phases(load):
    log = L.latency_log(star.arrivals(load), "ts", "arrival")
    return log.withColumn("phase", L.phase_of(F.col("elapsed_ms"), _WARMUP, _TOTAL))


@query
def latency_alerts(load):
    return L.latency_alerts(L.latency_log(star.arrivals(load), "ts", "arrival"), 600_000)


@query
def record_latency(load):
    return L.record_latency(star.arrivals(load), "ts", "arrival")


@query
def merge_histograms(load):
    latencies = L.record_latency(star.arrivals(load), "ts", "arrival")
    per_user = latencies.groupBy("user_id", "latency_ms").agg(F.count(F.lit(1)).alias("n"))
    return L.merge_histograms(per_user)


@query
def latency_log_stats(load):
    stats = L.latency_log_stats(star.log_lines(load), "2024-01-01")
    return rounded(zone_less(stats), "avg_ms")


@query
def latency_log_summary(load):
    return L.latency_log_summary(L.latency_log_stats(star.log_lines(load), "2024-01-01"))


@query
def folder_log_stats(load):
    return rounded(zone_less(L.folder_log_stats(star.folder_lines(load))), "avg_ms")


@query
def batch_max_latency(load):
    latencies = L.record_latency(star.arrivals(load), "ts", "arrival")
    return R.batch_max_latency(latencies, F.expr("event_id div 100"))


@query
def throughput_report(load):
    latencies = L.record_latency(star.arrivals(load), "ts", "arrival")
    report = R.throughput_report(latencies, "ts", "user_id", "1 day", "latency_ms")
    return rounded(report, "per_second")


@query
def gaps(load):
    return R.gaps(star.bids(load), "ts", "auction_id", 36_000_000, ["id"])


@query
def gaps_spread(load):
    return R.gaps(
        star.bids(load), "ts", "auction_id", 36_000_000, ["id"], spread=True, block_rows=8
    )


@query
def watermark_delay(load):
    return R.watermark_delay(star.arrivals(load), "ts", "arrival", 3_600_000, 7_200_000)


@query
def watermark_delay_spread(load):
    return R.watermark_delay(
        star.arrivals(load), "ts", "arrival", 3_600_000, 7_200_000, spread=True
    )


# Streaming twins: the tables arrive as streams and are worked off to their end


@stream_query()
def stream_q02_selection(load):
    return SR.run_to_table(A.q02_selection(star.bids(load)))


@stream_query()
def stream_q03_local_item_suggestion(load):
    auctions = on_time(star.auctions(load), "orders")
    persons = on_time(star.persons(load), "customer")
    return SR.run_to_table(
        A.q03_local_item_suggestion(persons, auctions, star.STATES, ttl="1000 days")
    )


@stream_query("events")
def stream_q05_hot_items(load):
    bids = on_time(star.bids(load), "events")
    counts, ranking = SA.q05_hot_items(bids, "1 day", "6 hours")
    return SR.run_to_table(counts, per_batch=ranking, finish=load.close)


@stream_query("events")
def stream_q07_highest_bid(load):
    return SR.run_to_table(A.q07_highest_bid(on_time(star.bids(load), "events"), "1 hour"), finish=load.close)


@stream_query("events")
def stream_q08_monitor_new_users(load):
    met = A.q08_monitor_new_users(
        on_time(star.new_users(load), "events"),
        on_time(star.sales(load), "events"),
        "1 day",
        "12 hours",
    )
    return SR.run_to_table(met, finish=load.close).drop("state")


@stream_query("events")
def stream_trade_sliding_count_panes(load):
    trades = on_time(star.trades(load), "events", "time")
    return SR.run_to_table(
        W.sliding_count(trades, "time", "ticker", "1 day", "6 hours", "panes"),
        finish=load.close,
    )


@stream_query()
def stream_word_count(load):
    counts = SR.run_to_table(T.word_count(star.lines(load)), "update")
    return SR.current_rows(counts, ["word"])


# Messages to counts to a latency report; the clock that stamps results stands still.
REPORT_MICROS = 1_717_200_000_000_000  # 2024-06-01


def _monitored(load):
    messages = codec.encode_trade(star.trades(load))
    trades = on_time(codec.decode_trade(messages), "events", "time")
    counts = SM.trade_monitor(trades, "1 day", "6 hours", "AA")
    arrivals = SM.measure(counts, "window_end", clock=lambda _: REPORT_MICROS, finish=load.close)
    return L.latency_log(arrivals, "ts", "arrival")


@stream_query("events")
def stream_trade_monitor(load):
    return _monitored(load)


@stream_query("events")
def stream_trade_monitor_profile(load):
    return rounded(L.latency_profile(_monitored(load), _WARMUP, _TOTAL), "percentile", "inverse")


# Through the file sinks and back through the sources


def _new_path(load, name: str) -> str:
    return f"{checkpoint_root(load('events').sparkSession)}/{name}-{uuid.uuid4().hex}"


@query
def text_log_roundtrip(load):
    """Log lines written as text files and read as a latency log."""
    path, spark = _new_path(load, "log"), load("events").sparkSession
    files.write_lines(star.log_lines(load), path)
    stats = L.latency_log_stats(readers.read_latency_log(spark, path), "2024-01-01")
    return rounded(zone_less(stats), "avg_ms")


@query
def text_line_widths(load):
    """Log lines written as text files: how many have each width in bytes, by the offsets they are read with."""
    path, spark = _new_path(load, "offsets"), load("events").sparkSession
    files.write_lines(star.log_lines(load), path)
    lines = readers.read_lines_with_offset(spark, path)
    after = F.lead("offset").over(Window.partitionBy("path").orderBy("offset"))
    end = F.coalesce(after, F.col("offset") + F.octet_length("line") + 1)
    return lines.select((end - F.col("offset")).alias("width")).groupBy("width").agg(F.count(F.lit(1)).alias("n"))


@query
def tsv_word_count(load):
    """Word counts written as tab-separated lines and read again."""
    path, spark = _new_path(load, "words"), load("events").sparkSession
    files.write_tsv(T.word_count(star.lines(load)).select("word", "n"), path)
    parts = F.split("value", "\t")
    return readers.read_lines(spark, path).select(parts[0].alias("word"), parts[1].cast("bigint").alias("n"))


@query
def csv_latency_log(load):
    """A latency log written as comma-separated files and read again."""
    path, spark = _new_path(load, "csv"), load("events").sparkSession
    files.write_csv(L.latency_log(star.arrivals(load), "ts", "arrival"), path)
    return spark.read.schema("elapsed_ms bigint, latency_ms bigint").csv(path)


@stream_query()
def stream_batch_folders(load):
    """A folder of lines per micro-batch, read back as a latency log."""
    path = _new_path(load, "folders")
    spark = load("events").sparkSession
    events = load("events").select("user_id", "event_id", F.round("value").cast("bigint").alias("latency"))
    lines = events.select(F.format_string("(%d,%d,%d)", "user_id", "event_id", "latency").alias("value"))
    files.write_per_batch(lines, f"{path}/run", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    stats = L.folder_log_stats(readers.read_latency_log(spark, f"{path}/run", "folders"))
    return stats.agg(F.sum("n").alias("n"), F.min("min_ms").alias("min_ms"), F.max("max_ms").alias("max_ms"))


@stream_query()
def stream_fan_out(load):
    """One stream written to two sinks, text lines and a table, and both read back."""
    path = _new_path(load, "fan")
    spark = load("events").sparkSession
    bids = star.bids(load)

    def as_lines(batch: DataFrame, number: int) -> None:
        text = F.concat_ws(",", "id", "auction_id", "price")
        batch.select(text.alias("value")).write.mode("overwrite").text(f"{path}/lines/{number}")

    def as_table(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/table/{number}")

    writer = files.fan_out(bids, f"{path}/checkpoint", as_lines, as_table)
    writer.trigger(availableNow=True).start().awaitTermination()
    fields = F.split("value", ",")
    lines = readers.read_lines(spark, f"{path}/lines/*").select(
        F.lit("lines").alias("sink"), *[fields[i].cast("bigint").alias(n) for i, n in enumerate(("id", "auction_id", "price"))]
    )
    table = spark.read.parquet(f"{path}/table/*").select(F.lit("table").alias("sink"), "id", "auction_id", "price")
    return lines.unionByName(table)


@query
def keyed_table_in_batches(load):
    """All events written into a keyed table in four batches by rising number, and read back."""
    path, spark = _new_path(load, "keyed"), load("events").sparkSession
    events = load("events").select("user_id", "event_id", "ts", "value", "event_type")
    most = events.agg(F.max("event_id")).scalar()
    quarter = F.coalesce((F.col("event_id") * 4 / (most + 1)).cast("int"), F.lit(0))
    for number in range(4):
        K.upsert_table(events.where(quarter == number), path, ["user_id"], "event_id", rewrite=number == 2)
    return readers.read_table(spark, path, ["user_id"])


# Orders and line items are in no order of time: replayed in ranges, state holds a range or two.
RANGE = "900 days"
# Bids on these come any time before their auction, so they wait as long as the table.
ANY_TIME = "3660 days"


def closing_query(build):
    """Register a query over the run of winning bids that ``build`` asks for, of orders and line items replayed by time."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        load = star.loader(spark, folder)
        return zone_less(build(lambda **options: replayed_bids(load, **options)))

    QUERIES[build.__name__] = run
    return build


def replayed_bids(load: star.Load, follow=None, wait: str = ANY_TIME) -> Carried:
    spark = load("orders").sparkSession
    replay = Replay(spark, RANGE)

    def given(name: str, view: Callable[[star.Load], DataFrame]) -> DataFrame:
        # Replayed are the view's columns, not all those of the table.
        end = view(lambda table: star.end_rows(spark, table, load(table).schema))
        return W.with_event_time(replay.add(name, view(load), "ts", end), "ts", RANGE)

    auctions, bids = given("orders", star.auctions), given("lineitem", star.auction_bids)
    return SC.winning_bids(auctions, bids, wait, follow).run(replay.feed())


@closing_query
def stream_winning_bids(closing):
    best = closing().table("won", SC.WON)
    return best.select("auction_id", "seller_id", "category", "expires", "price")


@closing_query
def stream_q04_average_price_for_category(closing):
    averages = closing(follow=SC.rolling_averages).table("rolling", SC.ROLLING)
    return rounded(averages, "average_price")


@closing_query
def stream_q06_avg_selling_price(closing):
    averages = closing(follow=SC.last_prices(10)).table("last", SC.LAST)
    return rounded(averages, "average_price")


@closing_query
def stream_orphan_bids(closing):
    """Bids that no auction claims within the longest duration before its start and after its end, and when they go."""
    run = closing(wait=star.MAX_DURATION)
    return run.table("orphans", SC.ORPHANS).select("auction_id", "bid_ts", "price", "removed_after")


@closing_query
def stream_winning_bids_within(closing):
    """Winning bids where bids count from the longest duration before the start: state holds a range or two."""
    best = closing(wait=star.MAX_DURATION).table("won", SC.WON)
    return best.select("auction_id", "seller_id", "category", "expires", "price")
