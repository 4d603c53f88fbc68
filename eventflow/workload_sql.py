"""The same queries in plain SQL, written apart from the Spark ones, to check results against."""

from __future__ import annotations

# Views over the tables; each query names the ones it uses.
VIEWS = {
    "bid": """
        SELECT event_id AS id, ts, user_id AS auction_id,
               CAST(round(value * 100) AS BIGINT) AS price
        FROM events""",
    "auction": """
        SELECT o_orderkey AS id, o_orderdate AS ts, o_custkey AS seller_id,
               CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1 AS category,
               o_orderdate + to_days(CAST(30 + o_orderkey % 61 AS INTEGER)) AS expires
        FROM orders""",
    "auction_bid": """
        SELECT l_orderkey AS auction_id, l_shipdate AS ts,
               CAST(round(l_extendedprice * 100) AS BIGINT) AS price
        FROM lineitem""",
    "person": """
        SELECT c_custkey AS id, TIMESTAMP '1995-01-01 00:00:00' AS ts, c_name AS name,
               n_name AS state
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "trade": """
        SELECT ts AS time, user_id, event_id,
               chr(CAST(65 + user_id % 26 AS INTEGER))
               || chr(CAST(65 + (user_id // 26) % 26 AS INTEGER))
               || chr(CAST(65 + (user_id // 676) % 26 AS INTEGER)) AS ticker,
               100 AS quantity, CAST(round(value * 100) AS INTEGER) AS price
        FROM events""",
    "arrived": """
        SELECT event_id, user_id,
               time_bucket(INTERVAL '10 minutes', ts, TIMESTAMP '1970-01-01') AS ts,
               time_bucket(INTERVAL '10 minutes', ts, TIMESTAMP '1970-01-01')
               + to_seconds(CAST(round(value * 60) AS BIGINT)) AS arrival
        FROM events""",
    "arrived_ms": """
        SELECT event_id, user_id, ts, arrival, epoch_ms(ts) AS t, epoch_ms(arrival) AS a
        FROM arrived""",
    "item": """
        SELECT c_custkey AS auction_id,
               'Auctioned Item #' || lpad(CAST(c_custkey AS VARCHAR), 5, '0') AS description
        FROM customer""",
    "piece": """
        SELECT doc_id, regexp_split_to_array(text, '[ \\t\\n\\r\\f]+') AS parts
        FROM documents""",
    "word": """
        SELECT * FROM (
            SELECT doc_id, CAST(unnest(range(len(parts))) AS INTEGER) AS place,
                   unnest(parts) AS word
            FROM piece)
        WHERE word <> ''""",
    "seq": "SELECT event_id AS seq, ts FROM events",
    "mixed": """
        SELECT seq, ts,
               (seq % 2147483647) * 48271 % 2147483647 AS m,
               ((seq * 137) % 2147483647) * 48271 % 2147483647 AS m_seller,
               ((seq * 271) % 2147483647) * 48271 % 2147483647 AS m_lasts,
               ((seq * 743) % 2147483647) * 48271 % 2147483647 AS m_kind
        FROM seq""",
    "log_line": """
        SELECT CASE WHEN event_type = 'error'
               THEN concat_ws(',', strftime(date_trunc('minute', ts), '%H:%M:%S'),
                              event_id, user_id, event_type)
               ELSE concat_ws(',', strftime(date_trunc('minute', ts), '%H:%M:%S'),
                              event_id, user_id, event_type, CAST(round(value) AS BIGINT))
               END AS value
        FROM events""",
    "log_field": """
        SELECT f FROM (SELECT string_split(value, ',') AS f FROM log_line) WHERE len(f) = 5""",
    "log_stat": """
        SELECT CAST('2024-01-01 ' || f[1] AS TIMESTAMP) AS time, count(*) AS n,
               min(CAST(f[5] AS BIGINT)) AS min_ms, max(CAST(f[5] AS BIGINT)) AS max_ms,
               avg(CAST(f[5] AS BIGINT)) AS avg_ms
        FROM log_field GROUP BY 1""",
    "won": """
        SELECT auction_id, seller_id, category, expires, price FROM (
            SELECT a.id AS auction_id, seller_id, category, expires, b.price,
                   row_number() OVER (PARTITION BY a.id ORDER BY b.price DESC, b.ts) AS r
            FROM auction a JOIN auction_bid b ON a.id = b.auction_id AND b.ts <= a.expires)
        WHERE r = 1""",
    # The sequential rule, said with a self-contained scan: rows by arrival, highest so far.
    "scanned": """
        SELECT t, a, max(t) OVER (ORDER BY a, t ROWS BETWEEN UNBOUNDED PRECEDING
                                  AND 1 PRECEDING) AS high,
               first_value(t) OVER (ORDER BY a, t) AS start
        FROM arrived_ms""",
    "latency": """
        SELECT t - start AS elapsed_ms, a - t AS latency_ms
        FROM scanned WHERE high IS NULL OR t > high""",
}

# What a view is built on.
NEEDS = {
    "arrived_ms": ["arrived"],
    "word": ["piece"],
    "mixed": ["seq"],
    "log_field": ["log_line"],
    "log_stat": ["log_line", "log_field"],
    "won": ["auction", "auction_bid"],
    "scanned": ["arrived", "arrived_ms"],
    "latency": ["arrived", "arrived_ms", "scanned"],
}

ORACLES: dict[str, str] = {}


def sql(names: str | tuple[str, ...], views: str, body: str) -> None:
    needed: list[str] = []
    for view in views.split():
        for name in [*NEEDS.get(view, []), view]:
            if name not in needed:
                needed.append(name)
    head = ", ".join(f"{name} AS ({VIEWS[name].strip()})" for name in needed)
    text = f"WITH {head} {body.strip()}" if needed else body.strip()
    for name in (names,) if isinstance(names, str) else names:
        ORACLES[name] = text


def sliding(
    rows: str, ts: str, size: str, slide: str, keys: str, where: str = "", before: str = ""
) -> str:
    """Window counts: every row is placed in all windows that hold it."""
    by = f", {keys}" if keys else ""
    before = before or size  # how far back a window may start, in whole slides
    return f"""
        SELECT s AS window_start, s + INTERVAL '{size}' AS window_end{by}, count(*) AS n
        FROM (SELECT {ts} AS row_time, unnest(generate_series(
                  time_bucket(INTERVAL '{slide}', {ts}, TIMESTAMP '1970-01-01')
                      - INTERVAL '{before}',
                  time_bucket(INTERVAL '{slide}', {ts}, TIMESTAMP '1970-01-01'),
                  INTERVAL '{slide}')) AS s{by}
              FROM {rows} {where})
        WHERE s <= row_time AND s + INTERVAL '{size}' > row_time
        GROUP BY ALL"""


sql("q01_currency_conversion", "bid", "SELECT id, ts, auction_id, price * 8 // 10 AS price FROM bid")
sql(
    ("q02_selection", "stream_q02_selection"),
    "bid",
    "SELECT ts, auction_id, price FROM bid WHERE auction_id % 128 = 0",
)
sql(
    "sieve",
    "bid",
    "SELECT id, ts, auction_id, price * 8 // 10 AS price FROM bid WHERE id % 7 = 0",
)
sql(
    "q13_bounded_side_input",
    "bid item",
    "SELECT bid.*, description FROM bid LEFT JOIN item USING (auction_id)",
)
sql(
    "tagged_union",
    "person auction",
    """
    SELECT 'person' AS kind, id, ts, name, state, CAST(NULL AS BIGINT) AS seller_id,
           CAST(NULL AS INTEGER) AS category, CAST(NULL AS TIMESTAMP) AS expires FROM person
    UNION ALL
    SELECT 'auction', id, ts, NULL, NULL, seller_id, category, expires FROM auction""",
)
sql(
    "ticker_suffix",
    "trade",
    "SELECT time, ticker, quantity, price FROM trade WHERE ticker LIKE '%AA'",
)
sql(
    "split_fields",
    "log_field",
    "SELECT f[1] AS field_0, f[2] AS field_1, f[3] AS field_2, f[4] AS field_3, f[5] AS field_4 FROM log_field",
)
sql("comma_lines", "latency", "SELECT elapsed_ms || ',' || latency_ms AS value FROM latency")

_Q03 = """
    SELECT p.name AS seller_name, p.state AS seller_state, a.ts AS auction_start,
           a.id AS auction_id, a.category
    FROM person p JOIN auction a ON p.id = a.seller_id
    WHERE p.state IN ('NATION_1', 'NATION_5', 'NATION_12') AND a.category = 0"""
sql(("q03_local_item_suggestion", "q03_hot_sellers"), "person auction", _Q03)
sql(
    ("q03_within_ttl", "stream_q03_local_item_suggestion"),
    "person auction",
    _Q03 + " AND a.ts BETWEEN p.ts - INTERVAL '1000 days' AND p.ts + INTERVAL '1000 days'",
)
sql(("winning_bids", "winning_bids_hot_auctions"), "won", "SELECT * FROM won")
sql(
    "winning_bids_of_started",
    "auction auction_bid",
    """
    SELECT a.id AS auction_id, seller_id, category, expires, max(price) AS price
    FROM auction a JOIN auction_bid b
      ON a.id = b.auction_id AND b.ts <= a.expires AND b.ts >= a.ts
    GROUP BY ALL""",
)
_Q04 = """
    SELECT auction_id, category, expires,
           round(CAST(sum(price) OVER w AS DOUBLE) / count(*) OVER w, 6) AS average_price,
           max(expires) OVER w AS latest_auction_end
    FROM won
    WINDOW w AS (PARTITION BY category ORDER BY expires, auction_id
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
_Q06 = """
    SELECT auction_id, seller_id, expires,
           round(avg(price) OVER (PARTITION BY seller_id ORDER BY expires, auction_id
                                  ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS average_price
    FROM won"""
sql(
    (
        "q04_average_price_for_category",
        "q04_average_price_spread",
        "stream_q04_average_price_for_category",
    ),
    "won",
    _Q04,
)
sql(
    ("q06_avg_selling_price", "q06_avg_selling_price_spread", "stream_q06_avg_selling_price"),
    "won",
    _Q06,
)
sql("stream_winning_bids", "won", "SELECT * FROM won")
sql(
    "q04_final",
    "won",
    """
    SELECT category, round(avg(price), 6) AS average_price, max(expires) AS latest_auction_end
    FROM won GROUP BY category""",
)

_TOP = """
    SELECT window_start, window_end, CAST(rank AS INTEGER) AS rank, auction_id, n FROM (
        SELECT *, row_number() OVER (PARTITION BY window_end ORDER BY n DESC, auction_id) AS rank
        FROM ({counts}))
    WHERE rank <= 10"""
_COUNTS = sliding("bid", "ts", "1 day", "6 hours", "auction_id")
sql(("q05_hot_items", "stream_q05_hot_items"), "bid", _TOP.format(counts=_COUNTS))
sql(
    "q05_hot_items_panes",
    "bid",
    _TOP.format(counts=sliding("bid", "ts", "1 day", "30 minutes", "auction_id")),
)
_Q07 = """
    SELECT window_start, window_start + INTERVAL '1 hour' AS window_end, id, ts, auction_id, price
    FROM (SELECT *, date_trunc('hour', ts) AS window_start,
                 row_number() OVER (PARTITION BY date_trunc('hour', ts)
                                    ORDER BY price DESC, id) AS r
          FROM bid)
    WHERE r = 1"""
sql(("q07_highest_bid", "stream_q07_highest_bid"), "bid", _Q07)


def _q08() -> str:
    places = """
        SELECT user_id, ts, unnest([time_bucket(INTERVAL '12 hours', ts, TIMESTAMP '1970-01-01')
                                        - INTERVAL '12 hours',
                                    time_bucket(INTERVAL '12 hours', ts, TIMESTAMP '1970-01-01')
                                   ]) AS s
        FROM events WHERE event_type = '{kind}'"""
    return f"""
    SELECT p.s AS window_start, p.s + INTERVAL '24 hours' AS window_end, p.user_id AS id,
           person_ts, 'Seller #' || p.user_id AS name, auctions
    FROM (SELECT s, user_id, min(ts) AS person_ts FROM ({places.format(kind='signup')})
          GROUP BY ALL) p
    JOIN (SELECT s, user_id, count(*) AS auctions FROM ({places.format(kind='purchase')})
          GROUP BY ALL) a ON p.s = a.s AND p.user_id = a.user_id"""


sql(("q08_monitor_new_users", "stream_q08_monitor_new_users"), "", _q08())
sql("sliding_total", "bid", sliding("bid", "ts", "1 day", "6 hours", ""))
_TRADES = sliding("trade", "time", "1 day", "6 hours", "ticker")
sql(
    ("trade_sliding_count", "trade_sliding_count_panes", "stream_trade_sliding_count_panes"),
    "trade",
    _TRADES,
)
sql(
    "trade_sliding_count_uneven",
    "trade",
    sliding("trade", "time", "1 day", "10 hours", "ticker", before="30 hours"),
)
sql("trade_tumbling_count", "trade", sliding("trade", "time", "6 hours", "6 hours", "ticker"))
sql(
    "trade_suffix_count",
    "trade",
    sliding("trade", "time", "1 day", "6 hours", "ticker", "WHERE ticker LIKE '%AA'"),
)
sql(
    "arrival_window_count",
    "arrived",
    sliding("arrived", "arrival", "1 day", "6 hours", "user_id"),
)

_MOMENTS = """count(price) AS n, round(avg(price), 6) AS mean,
    round((count(price) * sum(price::HUGEINT * price) - sum(price::HUGEINT) * sum(price))::DOUBLE
          / (count(price) * count(price)), 6) AS variance"""


def user_windows(view: str, ts: str, size: int, slide: int, key: str, values: str) -> str:
    """Aggregates of rows copied into each of their windows; size and slide in hours."""
    return f"""
    SELECT s AS window_start, s + INTERVAL '{size} hours' AS window_end, {key}, {values}
    FROM (SELECT *, unnest([time_bucket(INTERVAL '{slide} hours', {ts}, TIMESTAMP '1970-01-01')
                            - to_hours(CAST({slide} * i AS INTEGER)) FOR i IN range({size // slide})]) AS s
          FROM {view})
    GROUP BY s, {key}"""


sql("user_aggregate", "trade", f"SELECT ticker, {_MOMENTS} FROM trade GROUP BY ticker")
sql("user_aggregate_sliding", "trade", user_windows("trade", "time", 24, 2, "ticker", _MOMENTS))
sql(
    "user_aggregate_spread",
    "trade",
    user_windows("trade", "time", 24, 2, "ticker", "min(price) AS low, max(price) AS high"),
)
sql(
    "user_aggregate_pick_any",
    "bid",
    user_windows(
        "bid", "ts", 24, 6, "auction_id",
        "count(*) AS n, 'Auctioned Item #' || lpad(CAST(auction_id AS VARCHAR), 5, '0') AS value",
    ),
)

sql("tokenize", "word", "SELECT doc_id, place, word FROM word")
sql(
    ("word_count", "stream_word_count"),
    "word",
    "SELECT word, count(*) AS n FROM word GROUP BY word",
)
sql(
    ("running_word_count", "running_word_count_spread"),
    "word",
    """
    SELECT doc_id, place, word,
           row_number() OVER (PARTITION BY word ORDER BY doc_id, place) AS n
    FROM word""",
)

sql(
    "generated_bids",
    "mixed",
    """
    SELECT seq AS id, ts, seq % 100 AS auction_id, m % greatest(1, seq // 100) AS price
    FROM mixed""",
)
sql(
    "generated_auctions",
    "mixed",
    """
    SELECT seq AS id, ts, m_seller % 100 AS seller_id, CAST(m_kind % 128 AS INTEGER) AS category,
           ts + to_milliseconds(3600000 + m_lasts % 7200000) AS expires
    FROM mixed""",
)
sql(
    "generated_auctions_of_moving_sellers",
    "mixed",
    """
    SELECT seq AS id, ts,
           CASE WHEN seq // 100 >= m % 20 THEN seq // 100 - m % 20 ELSE 0 END AS seller_id,
           CAST(CASE WHEN seq // 100 >= m % 20 THEN m % 10 ELSE 1 END AS INTEGER) AS category,
           CASE WHEN seq // 100 >= m % 20 THEN ts + INTERVAL '1 hour'
                ELSE TIMESTAMP '1970-01-01' END AS expires
    FROM mixed""",
)
sql(
    "generated_persons",
    "seq",
    """
    SELECT seq AS id, ts, 'Seller #' || seq AS name,
           ['AL','AK','AZ','AR','CA','CO','CT','DE','FL','GA','HI','ID','IL','IN','IA','KS','KY',
            'LA','ME','MD','MA','MI','MN','MS','MO','MT','NE','NV','NH','NJ','NM','NY','NC','ND',
            'OH','OK','OR','PA','RI','SC','SD','TN','TX','UT','VT','VA','WA','WV','WI','WY'
           ][seq % 50 + 1] AS state
    FROM seq""",
)
sql(
    "generated_trades",
    "seq",
    """
    SELECT ts AS time,
           chr(CAST(65 + (seq % 1000) % 26 AS INTEGER))
           || chr(CAST(65 + ((seq % 1000) // 26) % 26 AS INTEGER))
           || chr(CAST(65 + ((seq % 1000) // 676) % 26 AS INTEGER)) AS ticker,
           100 AS quantity, 10000 AS price
    FROM seq""",
)
# Written word by word: a word's line is the number of line ends before it.
sql(
    "generated_text",
    "",
    """
    SELECT line, string_agg(CAST(i % 997 AS VARCHAR), ' ' ORDER BY i) AS value
    FROM (SELECT i, CASE WHEN i = 0 THEN 0 ELSE (i - 1) // 20 + 1 END AS line
          FROM (SELECT unnest(range(0, (SELECT (count(*) - 1) * 20 + 1 FROM documents))) AS i))
    GROUP BY line""",
)
sql("item_descriptions", "item", "SELECT * FROM item")

sql(
    "trade_encode",
    "trade",
    """
    SELECT epoch_us(time) // 1000 AS key,
           upper(hex(encode(rpad(ticker, 5, ' ')))) || upper(lpad(format('{:x}', epoch_us(time) // 1000), 16, '0'))
           || upper(lpad(format('{:x}', price), 8, '0')) || upper(lpad(format('{:x}', quantity), 8, '0'))
           AS message
    FROM trade""",
)
sql(
    "trade_codec_roundtrip",
    "trade",
    """
    SELECT date_trunc('milliseconds', time) AS time, ticker, quantity, price FROM trade""",
)
sql(
    "upsert_table",
    "",
    """
    SELECT user_id, event_id, ts, value, event_type FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id
                                     ORDER BY coalesce(event_type IN ('click', 'error'), FALSE) DESC, event_id DESC) AS r
        FROM events)
    WHERE r = 1""",
)

sql(("latency_log", "latency_log_spread"), "latency", "SELECT * FROM latency")
sql(
    "latency_phases",
    "latency",
    """
    SELECT *, CASE WHEN elapsed_ms < 172800000 THEN 'warming up'
                   WHEN elapsed_ms < 2160000000 THEN 'measuring' ELSE 'done' END AS phase
    FROM latency""",
)
sql(
    "latency_profile",
    "latency",
    """,
    measured AS (
        SELECT latency_ms FROM latency
        WHERE elapsed_ms >= 172800000 AND elapsed_ms <= coalesce(
            (SELECT min(elapsed_ms) FROM latency WHERE elapsed_ms >= 2160000000), 9e18)),
    total AS (SELECT count(*) AS everything FROM measured),
    summed AS (
        SELECT latency_ms, CAST(sum(count(*)) OVER (ORDER BY latency_ms) AS BIGINT) AS total_count
        FROM measured GROUP BY latency_ms),
    level AS (
        SELECT 100.0::DOUBLE * (1.0 - pow(0.5, h)) + j * 10.0::DOUBLE * pow(0.5, h) AS p
        FROM (SELECT unnest(range(63)) AS h), (SELECT unnest(range(5)) AS j)),
    placed AS (
        SELECT p, min(latency_ms) AS latency_ms, min(total_count) AS total_count
        FROM level, summed, total
        WHERE p < 100 AND 100.0::DOUBLE * total_count / everything >= p
        GROUP BY p),
    shown AS (
        SELECT p, latency_ms, total_count FROM placed, total
        WHERE total_count < everything
           OR p = (SELECT min(p) FROM placed, total WHERE total_count = everything)
        UNION ALL
        SELECT 100.0, max(latency_ms), max(total_count) FROM summed)
    SELECT latency_ms, round(p / 100.0, 6) AS percentile, total_count,
           CASE WHEN p < 100 THEN round(100.0 / (100.0 - p), 6) END AS inverse
    FROM shown""",
)
_MONITORED_PROFILE = ORACLES["latency_profile"].split("measured AS", 1)[1].replace("FROM latency", "FROM monitored")
sql("latency_alerts", "latency", "SELECT * FROM latency WHERE latency_ms >= 600000")
sql(
    "record_latency",
    "arrived_ms",
    "SELECT event_id, user_id, ts, arrival, a - t AS latency_ms FROM arrived_ms",
)
sql(
    "merge_histograms",
    "arrived_ms",
    "SELECT a - t AS latency_ms, count(*) AS n FROM arrived_ms GROUP BY 1",
)
sql(
    "latency_log_stats",
    "log_stat",
    "SELECT time, n, min_ms, max_ms, round(avg_ms, 6) AS avg_ms FROM log_stat",
)
sql(
    "latency_log_summary",
    "log_stat",
    """
    SELECT CAST(coalesce(trunc(avg(avg_ms)), -1) AS BIGINT) AS avg_ms,
           coalesce(min(min_ms), -1) AS min_ms, coalesce(max(max_ms), -1) AS max_ms
    FROM log_stat""",
)
sql(
    "folder_log_stats",
    "",
    """
    SELECT date_trunc('hour', ts) AS time, count(*) AS n,
           min(CAST(round(value) AS BIGINT)) AS min_ms, max(CAST(round(value) AS BIGINT)) AS max_ms,
           round(avg(CAST(round(value) AS BIGINT)), 6) AS avg_ms
    FROM events GROUP BY 1""",
)
sql(
    "batch_max_latency",
    "arrived_ms",
    "SELECT event_id // 100 AS batch, greatest(max(a - t), 0) AS max_latency_ms FROM arrived_ms GROUP BY 1",
)
sql(
    "throughput_report",
    "arrived_ms",
    """
    SELECT date_trunc('day', ts) AS window_start,
           date_trunc('day', ts) + INTERVAL '1 day' AS window_end, user_id, count(*) AS n,
           max(a - t) AS worst_delay_ms, round(count(*) / 86400.0::DOUBLE, 6) AS per_second
    FROM arrived_ms GROUP BY ALL""",
)
sql(
    ("gaps", "gaps_spread"),
    "bid",
    """
    SELECT auction_id, ts, gap_ms FROM (
        SELECT auction_id, ts,
               (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY auction_id ORDER BY ts, id))
               // 1000 AS gap_ms
        FROM bid)
    WHERE gap_ms > 36000000""",
)
sql(
    ("watermark_delay", "watermark_delay_spread"),
    "arrived_ms",
    """
    SELECT event_id, user_id, ts, arrival, high - high % 3600000 AS watermark_ms,
           a - (high - high % 3600000) AS delay_ms, a - (high - high % 3600000) > 7200000 AS behind
    FROM (SELECT *, max(t) OVER (ORDER BY a, t) AS high FROM arrived_ms)""",
)

_CLAIMED = "ts BETWEEN a.ts - INTERVAL '91 days' AND expires + INTERVAL '91 days'"
sql(
    "stream_orphan_bids",
    "auction auction_bid",
    f"""
    SELECT auction_id, b.ts AS bid_ts, price, b.ts + INTERVAL '91 days' AS removed_after
    FROM auction_bid b LEFT JOIN auction a ON a.id = b.auction_id AND b.{_CLAIMED}
    WHERE a.id IS NULL""",
)
sql(
    "stream_winning_bids_within",
    "auction auction_bid",
    f"""
    SELECT auction_id, seller_id, category, expires, price FROM (
        SELECT a.id AS auction_id, seller_id, category, expires, b.price,
               row_number() OVER (PARTITION BY a.id ORDER BY b.price DESC, b.ts) AS r
        FROM auction a JOIN auction_bid b ON a.id = b.auction_id AND b.ts <= a.expires AND b.{_CLAIMED})
    WHERE r = 1""",
)

VIEWS["monitored"] = f"""
    SELECT epoch_ms(window_end) - min(epoch_ms(window_end)) OVER () AS elapsed_ms,
           1717200000000 - epoch_ms(window_end) AS latency_ms
    FROM (SELECT DISTINCT window_end FROM (
        {sliding("trade", "time", "1 day", "6 hours", "ticker", "WHERE ticker LIKE '%AA'")}))"""
NEEDS["monitored"] = ["trade"]
sql("stream_trade_monitor", "monitored", "SELECT * FROM monitored")
sql("stream_trade_monitor_profile", "monitored", ", measured AS" + _MONITORED_PROFILE)
ORACLES["text_log_roundtrip"] = ORACLES["latency_log_stats"]
sql("text_line_widths", "log_line", "SELECT strlen(value) + 1 AS width, count(*) AS n FROM log_line GROUP BY 1")
ORACLES["tsv_word_count"] = ORACLES["word_count"]
ORACLES["csv_latency_log"] = ORACLES["latency_log"]
sql(
    "stream_batch_folders",
    "",
    """
    SELECT count(*) AS n, min(CAST(round(value) AS BIGINT)) AS min_ms, max(CAST(round(value) AS BIGINT)) AS max_ms
    FROM events""",
)
sql(
    "stream_fan_out",
    "bid",
    "SELECT sink, id, auction_id, price FROM bid, (SELECT unnest(['lines', 'table']) AS sink)",
)
sql(
    "keyed_table_in_batches",
    "",
    """
    SELECT user_id, event_id, ts, value, event_type FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events)
    WHERE r = 1""",
)
