"""The same queries as SQL over the test tables, for comparison in DuckDB."""

from __future__ import annotations

# Views over the test tables (FIXTURES.md).

LISTINGS = """listings AS (
  SELECT l_partkey AS item_id, s_nationkey AS world_id, CAST(l_shipdate AS DATE) AS listed_date,
    concat(l_orderkey, '-', l_linenumber) AS listing_id,
    CAST(floor(l_extendedprice / l_quantity) AS BIGINT) AS price_per_unit,
    CAST(l_quantity AS INTEGER) AS quantity, CAST(floor(l_extendedprice) AS BIGINT) AS total,
    CAST(floor(l_extendedprice * l_tax) AS BIGINT) AS tax, l_returnflag = 'R' AS is_hq,
    l_linestatus = 'F' AS is_crafted, s_name AS retainer_name,
    CAST(epoch(l_shipdate) AS BIGINT) AS last_review_time
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"""

EVENTS_K = """ek AS (
  SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
    CAST(floor(value * 100) AS BIGINT) AS price FROM events)"""

SALES = EVENTS_K + """, sales AS (
  SELECT user_id % 10 AS item_id, k % 5 AS world_id, CAST(ts AS DATE) AS sale_date,
    CAST(floor(epoch(ts)) AS BIGINT) AS sale_timestamp, price AS price_per_unit,
    1 + k % 3 AS quantity, price * (1 + k % 3) AS total, k % 2 = 0 AS is_hq,
    concat('user-', user_id) AS buyer_name, event_type = 'error' AS is_mannequin
  FROM ek)"""

SALES_FINE = """sales AS (
  SELECT l_partkey AS item_id, s_nationkey AS world_id, CAST(l_shipdate AS DATE) AS sale_date,
    CAST(epoch(l_shipdate) AS BIGINT) AS sale_timestamp,
    CAST(floor(l_extendedprice / l_quantity) AS BIGINT) AS price_per_unit,
    CAST(l_quantity AS INTEGER) AS quantity, CAST(floor(l_extendedprice) AS BIGINT) AS total,
    l_returnflag = 'R' AS is_hq, c_name AS buyer_name, l_linestatus = 'F' AS is_mannequin
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey)"""

DIMS = """items AS (SELECT p_partkey AS item_id, p_name AS item_name FROM part),
worlds AS (SELECT n_nationkey AS world_id, n_name AS world_name FROM nation),
centers AS (
  SELECT r_name AS data_center, r_regionkey AS center_position, n_name AS world_name,
    n_nationkey AS position FROM nation JOIN region ON n_regionkey = r_regionkey)"""

# Rows of the JSON event streams.

LISTING_EVENTS = """listing_rows AS (
  SELECT CAST(l_partkey AS INTEGER) AS item,
    1704067200 + (l_partkey * 7919
      + CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) * 104729)
      % 432000 AS "lastReviewTime",
    CAST(floor(l_extendedprice / l_quantity) AS BIGINT) AS "pricePerUnit",
    CAST(l_quantity AS INTEGER) + j - 1 AS quantity, l_returnflag = 'R' AS hq,
    l_linestatus = 'F' AS "isCrafted", s_name AS "retainerName",
    concat(l_orderkey, '-', l_linenumber, '-', j) AS "listingID",
    CAST(floor(l_extendedprice) AS BIGINT) AS total,
    CAST(floor(l_extendedprice * l_tax) AS BIGINT) AS tax, s_nationkey AS world
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey, (VALUES (1), (2)) v(j)
  WHERE j <= l_linenumber % 3),
listing_events AS (
  SELECT *, CAST(epoch_ms("lastReviewTime" * 1000) AS DATE) AS dt FROM listing_rows),
latest_listings AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY "listingID" ORDER BY "lastReviewTime" DESC) AS rn
    FROM listing_events) WHERE rn = 1)"""

SALE_EVENTS = EVENTS_K + """, sale_events AS (
  SELECT CAST(user_id AS INTEGER) AS item, k % 2 = 0 AS hq, price AS "pricePerUnit",
    k % 3 AS quantity, CAST(floor(epoch(ts)) AS BIGINT) + j AS ts, price * (k % 3) AS total,
    CASE WHEN k % 7 <> 0 THEN concat('user-', user_id) END AS "buyerName",
    event_type = 'error' AS "onMannequin", k % 5 AS world,
    CAST(epoch_ms((CAST(floor(epoch(ts)) AS BIGINT) + j) * 1000) AS DATE) AS dt
  FROM ek, (VALUES (1), (2)) v(j) WHERE j <= k % 3)"""

# Marts.

PRICE_SUMMARY = """price_summary AS (
  SELECT item_id, item_name, world_id, world_name, is_hq, COUNT(*) AS listing_count,
    AVG(price_per_unit) AS avg_price, MIN(price_per_unit) AS min_price,
    MAX(price_per_unit) AS max_price, CAST(SUM(quantity) AS BIGINT) AS total_quantity
  FROM listings LEFT JOIN items USING (item_id) LEFT JOIN worlds USING (world_id) GROUP BY ALL)"""

HQ_PREMIUM = """by_quality AS (
  SELECT item_id, world_id, is_hq, COUNT(*) AS n, AVG(price_per_unit) AS p
  FROM listings GROUP BY ALL),
hq_premium AS (
  SELECT item_id, item_name, world_id, world_name, high.p AS hq_avg_price,
    normal.p AS nq_avg_price, high.n AS hq_listings, normal.n AS nq_listings,
    ROUND((high.p - normal.p) / normal.p * 100, 2) AS hq_premium_pct
  FROM (FROM by_quality WHERE is_hq) high
  JOIN (FROM by_quality WHERE NOT is_hq AND p > 0) normal USING (item_id, world_id)
  LEFT JOIN items USING (item_id) LEFT JOIN worlds USING (world_id))"""

PRICE_BOUNDS = """price_bounds AS (
  SELECT item_id, is_hq, quantile_cont(price_per_unit, 0.05) AS p05,
    quantile_cont(price_per_unit, 0.85) AS p85
  FROM listings GROUP BY ALL HAVING COUNT(*) >= 10)"""

PRICE_BAND = PRICE_BOUNDS + """, price_band AS (
  SELECT item_id, is_hq, world_id, price_per_unit
  FROM listings JOIN price_bounds USING (item_id, is_hq)
  WHERE price_per_unit >= p05 AND price_per_unit <= p85)"""

ARBITRAGE = PRICE_BAND + """, lowest AS (
  SELECT item_id, world_id, is_hq, MIN(price_per_unit) AS min_price
  FROM price_band GROUP BY ALL HAVING MIN(price_per_unit) > 0),
spread AS (
  SELECT item_id, is_hq, MIN(min_price) AS cheapest_price, MAX(min_price) AS priciest_price
  FROM lowest GROUP BY ALL),
arbitrage AS (
  SELECT item_id, item_name, world_id, world_name, is_hq, min_price, cheapest_price,
    priciest_price,
    ROUND((priciest_price - cheapest_price) / cheapest_price * 100, 2) AS profit_margin_pct
  FROM lowest JOIN spread USING (item_id, is_hq)
  LEFT JOIN items USING (item_id) LEFT JOIN worlds USING (world_id))"""

PRICE_HISTORY = """price_history AS (
  SELECT item_id, item_name, world_id, world_name, is_hq, sale_date, COUNT(*) AS sale_count,
    AVG(price_per_unit) AS avg_price, MIN(price_per_unit) AS min_price,
    MAX(price_per_unit) AS max_price, CAST(SUM(quantity) AS BIGINT) AS total_volume
  FROM sales LEFT JOIN items USING (item_id) LEFT JOIN worlds USING (world_id) GROUP BY ALL),
velocity AS (SELECT * EXCLUDE (min_price, max_price) FROM price_history)"""


def sql(select: str, *views: str) -> str:
    return f"WITH {', '.join(views)}\n{select}" if views else select


L = (LISTINGS, DIMS)
M1 = (*L, PRICE_SUMMARY)
M2 = (*L, HQ_PREMIUM)
M3 = (*L, ARBITRAGE)
M45 = (SALES, DIMS, PRICE_HISTORY)

PRICE_COLUMNS = """item_name, world_name, is_hq, listing_count, ROUND(avg_price, 0) AS avg_price,
  min_price, max_price"""
TOP_PRICES = "ORDER BY listing_count DESC, item_id, world_id, is_hq LIMIT"
TOP_VELOCITY = "ORDER BY sale_count DESC, item_id, world_id, is_hq, sale_date LIMIT"
TOP_MARGIN = """FROM arbitrage WHERE profit_margin_pct >= 50
  ORDER BY profit_margin_pct DESC, item_id, world_id, is_hq LIMIT"""

PREMIUM_PAGE = """page AS (
  SELECT item_id, world_id, item_name, world_name, ROUND(hq_avg_price, 0) AS hq_avg_price,
    ROUND(nq_avg_price, 0) AS nq_avg_price, hq_listings, nq_listings, hq_premium_pct
  FROM hq_premium ORDER BY hq_premium_pct DESC, item_id, world_id LIMIT 200)"""

HISTORY_PAGE = """page AS (
  SELECT item_id, world_id, item_name, world_name, is_hq, sale_date, sale_count,
    ROUND(avg_price, 0) AS avg_price, min_price, max_price, total_volume,
    COALESCE(item_name, 'Unknown') AS label
  FROM price_history ORDER BY sale_date DESC, item_id, world_id, is_hq LIMIT 500)"""

HEADLINES = r"""body AS (
  SELECT page_id, regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>',
    '', 'g') AS body FROM pages),
entries AS (
  SELECT page_id, unnest(regexp_extract_all(body, '(?is)<li\b[^>]*>(.*?)</li>', 1)[1:8]) AS entry,
    unnest(range(1, len(regexp_extract_all(body, '(?is)<li\b[^>]*>(.*?)</li>', 1)[1:8]) + 1)) AS position
  FROM body),
headlines AS (
  SELECT page_id, CAST(position AS INTEGER) AS position,
    CASE WHEN regexp_matches(entry, '(?is)<a\b[^>]*>.*?</a>')
      THEN trim(regexp_replace(regexp_extract(entry, '(?is)<a\b[^>]*>(.*?)</a>', 1),
        '\s*<[^>]*>\s*', '', 'g')) ELSE 'Unknown' END AS title, '' AS date
  FROM entries)"""

QUOTES = """ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id, world_id ORDER BY price_per_unit, listing_id,
      listed_date, quantity, total, tax, retainer_name, is_hq, is_crafted) AS cheap,
    row_number() OVER (PARTITION BY item_id, world_id ORDER BY listed_date DESC, price_per_unit,
      listing_id, quantity, total, tax, retainer_name, is_hq, is_crafted) AS recent,
    CASE WHEN is_hq THEN 'HQ' ELSE 'NQ' END || ' x' || quantity AS what
  FROM listings),
quotes AS (
  SELECT item_id, world_id,
    CAST(count(*) FILTER (WHERE cheap <= 5) AS INTEGER) AS listings,
    CAST(count(*) FILTER (WHERE recent <= 3) AS INTEGER) AS recent_sales,
    string_agg('  ' || what || ' @ ' || format('{:,}', price_per_unit) || ' gil (total: '
      || format('{:,}', total) || ' gil)', chr(10) ORDER BY cheap) FILTER (WHERE cheap <= 5) AS offers,
    string_agg('  ' || what || ' sold @ ' || format('{:,}', price_per_unit) || ' gil',
      chr(10) ORDER BY recent) FILTER (WHERE recent <= 3) AS sold
  FROM ranked GROUP BY item_id, world_id)"""

ITEM_DETAILS = """details AS (
  SELECT p_partkey AS item_id, p_name AS item_name,
    CASE WHEN p_partkey % 2 = 1 THEN p_brand WHEN p_partkey % 5 <> 0 THEN p_type
      ELSE 'Unknown' END AS category,
    CASE WHEN p_partkey % 2 = 1 OR p_partkey % 7 <> 0 THEN CAST(p_size AS VARCHAR)
      ELSE '?' END AS item_level,
    CASE WHEN p_partkey % 2 = 0 OR p_partkey % 3 <> 0 THEN CAST(p_size AS VARCHAR)
      ELSE '?' END AS equip_level,
    CASE WHEN p_partkey % 2 = 0 THEN p_size > 25 ELSE p_size > 10 AND p_size % 2 = 1 END AS can_be_hq,
    COALESCE(text, 'No description available.') AS description
  FROM part LEFT JOIN documents ON p_partkey = doc_id)"""

LOG = EVENTS_K + """, log AS (
  SELECT ts, date_trunc('minute', ts) AS window_start, event_id // 4 AS request, event_id % 4 AS part,
    k * 10 AS tokens_in, k + 1 AS tokens_out, value * 10000 AS duration_ms
  FROM ek),
requests AS (
  SELECT request, MIN(ts) AS started, NULLIF(MAX(part), 0) AS rounds,
    CASE WHEN request % 5 <> 0 THEN MAX(ts) FILTER (WHERE part = 3) END AS closed,
    CASE WHEN request % 5 <> 0 AND request % 7 <> 0
      THEN MAX(duration_ms) FILTER (WHERE part = 3) END AS duration_ms,
    CASE WHEN request % 2 = 0 THEN 'GET' ELSE 'POST' END AS method, '/route' || request % 3 AS route
  FROM log GROUP BY request)"""


def _checks_sql(listings: str, sales: str) -> str:
    """The check report over given listings and sales."""
    not_null = {
        ("listings", "stg_listings", "warn"): ["listing_id", "item_id", "world_id", "price_per_unit", "quantity"],
        ("sales", "stg_sales", "warn"): ["item_id", "world_id", "price_per_unit", "quantity"],
        ("price_summary", "price_summary", "error"): ["item_id", "world_id", "item_name", "listing_count", "min_price"],
        ("arbitrage", "arbitrage", "error"): ["item_id", "world_id", "profit_margin_pct"],
        ("hq_premium", "hq_premium", "error"): ["item_id", "hq_avg_price", "nq_avg_price"],
        ("velocity", "velocity", "error"): ["item_id", "sale_count", "total_volume"],
        ("price_history", "price_history", "error"): ["item_id", "sale_date", "sale_count"],
        ("items", "item_names", "error"): ["item_id", "item_name"],
        ("worlds", "world_names", "error"): ["world_id", "world_name"],
    }
    unique = {
        ("listings", "stg_listings", "warn"): ["listing_id"],
        ("items", "item_names", "error"): ["item_id"],
        ("worlds", "world_names", "error"): ["world_id", "world_name"],
    }
    rows = {
        ("arbitrage", "arbitrage", "error", "margin_not_negative"): "profit_margin_pct < 0",
        ("arbitrage", "arbitrage", "error", "cheapest_not_above_priciest"):
            "cheapest_price > priciest_price",
        ("hq_premium", "hq_premium", "error", "both_prices_positive"):
            "hq_avg_price <= 0 OR nq_avg_price <= 0",
        ("listings", "stg_listings", "warn", "price_not_negative"): "price_per_unit < 0",
        ("listings", "stg_listings", "warn", "quantity_positive"): "quantity <= 0",
        ("sales", "stg_sales", "warn", "total_is_price_times_quantity"):
            "ABS(total - price_per_unit * quantity) > 1",
    }
    parts = []

    def add(check: str, target: str, severity: str, source: str) -> None:
        parts.append(
            f"""SELECT '{check}' AS "check", '{target}' AS target, '{severity}' AS severity,
            COUNT(*) AS failures FROM {source}"""
        )

    for (view, target, severity), columns in not_null.items():
        for c in columns:
            add(f"not_null_{c}", target, severity, f"{view} WHERE {c} IS NULL")
    for (view, target, severity), columns in unique.items():
        for c in columns:
            repeated = f"(SELECT {c} FROM {view} WHERE {c} IS NOT NULL GROUP BY {c} HAVING COUNT(*) > 1)"
            add(f"unique_{c}", target, severity, repeated)
    for (view, target, severity, name), condition in rows.items():
        add(name, target, severity, f"{view} WHERE {condition}")
    report = "report AS (" + " UNION ALL ".join(parts) + ")"
    return sql(
        """SELECT *, CASE WHEN failures = 0 THEN 'pass' ELSE severity END AS status FROM report""",
        listings, sales, DIMS, PRICE_SUMMARY, HQ_PREMIUM, ARBITRAGE, PRICE_HISTORY, report,
    )


INGESTED_LISTINGS = LISTING_EVENTS + """, listings AS (
  SELECT item AS item_id, world AS world_id, dt AS listed_date, "listingID" AS listing_id,
    "pricePerUnit" AS price_per_unit, quantity, total, tax, hq AS is_hq FROM latest_listings)"""

INGESTED_SALES = SALE_EVENTS + """, sales AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT item AS item_id, world AS world_id, dt AS sale_date, ts AS sale_timestamp,
      "pricePerUnit" AS price_per_unit, quantity, total, hq AS is_hq,
      row_number() OVER (PARTITION BY item, world, ts ORDER BY "pricePerUnit") AS rn
    FROM sale_events) WHERE rn = 1)"""

ORACLE: dict[str, str] = {
    "stg_listings": sql("SELECT * FROM listings", LISTINGS),
    "stg_sales": sql("SELECT * FROM sales", SALES),
    "listings_latest": sql(
        """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY listing_id
        ORDER BY last_review_time DESC, item_id DESC, world_id DESC, listed_date DESC,
        price_per_unit DESC, quantity DESC, total DESC, tax DESC, is_hq DESC, is_crafted DESC,
        retainer_name DESC) AS rn FROM listings) WHERE rn = 1""",
        LISTINGS,
    ),
    "sales_latest": sql(
        """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY item_id, world_id,
        sale_timestamp ORDER BY arrival DESC) AS rn FROM (
        SELECT user_id % 10 AS item_id, k % 5 AS world_id,
          CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS sale_timestamp, price AS price_per_unit,
          event_id AS arrival FROM ek)) WHERE rn = 1""",
        EVENTS_K,
    ),
    "partition_scan": sql(
        """SELECT CAST(item_id AS INTEGER) AS item, world_id AS world, sale_date AS dt,
        price_per_unit AS "pricePerUnit", quantity FROM sales
        WHERE world_id = 3 AND sale_date BETWEEN DATE '2024-01-08' AND DATE '2024-01-21'""",
        SALES,
    ),
    "lake_peek": sql(
        """SELECT item_id AS item, world_id AS world, price_per_unit AS "pricePerUnit", quantity,
        is_hq AS hq, retainer_name AS "retainerName" FROM listings
        ORDER BY item, world, "pricePerUnit", quantity, hq, "retainerName" LIMIT 20""",
        LISTINGS,
    ),
    "dim_items": "SELECT p_partkey AS item_id, trim(p_name) AS item_name FROM part WHERE p_partkey <> 0",
    "dim_worlds": "SELECT s_suppkey * 40 AS world_id, s_name AS world_name FROM supplier WHERE s_suppkey * 40 < 3000",
    "dim_worlds_file": """SELECT CAST(s_suppkey * 40 AS INTEGER) AS world_id, s_name AS world_name
        FROM supplier WHERE s_suppkey * 40 < 3000""",
    "dim_centers": """SELECT n_name AS data_center, n_nationkey AS center_position,
        s_name || suffix AS world_name, position
        FROM supplier JOIN nation ON s_nationkey = n_nationkey
        CROSS JOIN (VALUES (0, ''), (1, ' II')) v(position, suffix)""",
    "region_worlds": """SELECT s_name AS world_name FROM supplier
        JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        WHERE r_name = 'AMERICA'""",
    "parse_listings": sql("SELECT * FROM listing_events", LISTING_EVENTS),
    "parse_sales": sql("SELECT * FROM sale_events", SALE_EVENTS),
    "route_channels": """SELECT 'raw.' || event_type AS topic, COUNT(*) AS events FROM events
        WHERE event_type IN ('click', 'purchase') GROUP BY event_type""",
    "topic_messages": "SELECT event_id, user_id, value FROM events",
    "price_summary": sql("SELECT * FROM price_summary", *M1),
    "hq_premium": sql("SELECT * FROM hq_premium", *M2),
    "price_bounds": sql(
        "SELECT item_id, is_hq, ROUND(p05, 6) AS p05, ROUND(p85, 6) AS p85 FROM price_bounds",
        LISTINGS, PRICE_BOUNDS,
    ),
    "price_bounds_hot": sql(
        "SELECT item_id, is_hq, ROUND(p05, 6) AS p05, ROUND(p85, 6) AS p85, TRUE AS same FROM price_bounds",
        LISTINGS, PRICE_BOUNDS,
    ),
    "price_band": sql("SELECT * FROM price_band", LISTINGS, PRICE_BAND),
    "arbitrage": sql("SELECT * FROM arbitrage", *M3),
    "mart_order": sql("SELECT * FROM arbitrage", *M3),
    "velocity": sql("SELECT * FROM velocity", *M45),
    "price_history": sql("SELECT * FROM price_history", *M45),
    "velocity_fine": sql("SELECT * FROM velocity", SALES_FINE, DIMS, PRICE_HISTORY),
    "price_history_fine": sql("SELECT * FROM price_history", SALES_FINE, DIMS, PRICE_HISTORY),
    "top_arbitrage": sql(
        f"""SELECT item_name, world_name, is_hq, min_price, cheapest_price, priciest_price,
        profit_margin_pct {TOP_MARGIN} 20""",
        *M3,
    ),
    "top_velocity": sql(
        f"""SELECT item_name, world_name, sale_date, sale_count, total_volume,
        ROUND(avg_price, 0) AS avg_price FROM velocity {TOP_VELOCITY} 20""",
        *M45,
    ),
    "price_lookup": sql(
        f"""SELECT {PRICE_COLUMNS} FROM price_summary WHERE item_name ILIKE '%RED_W%t%'
        {TOP_PRICES} 20""",
        *M1,
    ),
    "market_snapshot": sql(
        f"SELECT {PRICE_COLUMNS} FROM price_summary WHERE item_name ILIKE '%Bolt%' {TOP_PRICES} 10",
        *M1,
    ),
    "item_search": sql(
        "SELECT * FROM items WHERE item_name ILIKE '%ring%' ORDER BY item_id LIMIT 10", DIMS
    ),
    "center_worlds": """SELECT n_name AS data_center, s_name AS world_name
        FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE lower(n_name) = 'nation_7'""",
    "center_prices": sql(
        """SELECT * FROM price_summary WHERE world_name IN
        (SELECT world_name FROM centers WHERE lower(data_center) = 'asia')""",
        *M1,
    ),
    "formatted_arbitrage": sql(
        f"""SELECT item_name, world_name, CASE WHEN is_hq THEN '★ HQ' ELSE 'NQ' END AS quality,
        format('{{:,}}', min_price) || ' gil' AS min_price,
        format('{{:,}}', cheapest_price) || ' gil' AS cheapest_price,
        format('{{:,}}', priciest_price) || ' gil' AS priciest_price,
        CAST(CAST(CAST(profit_margin_pct AS DECIMAL(18, 2)) AS DECIMAL(18, 1)) AS VARCHAR) || '%'
          AS margin {TOP_MARGIN} 20""",
        *M3,
    ),
    "page_arbitrage_metrics": sql(
        f"SELECT COUNT(*) AS opportunities FROM (SELECT * {TOP_MARGIN} 200)", *M3
    ),
    "page_prices": sql(
        f"SELECT {PRICE_COLUMNS}, total_quantity FROM price_summary {TOP_PRICES} 200", *M1
    ),
    "page_price_metrics": sql(
        f"""SELECT COUNT(DISTINCT item_name) AS unique_items,
        CAST(SUM(listing_count) AS BIGINT) AS total_listings
        FROM (SELECT * FROM price_summary {TOP_PRICES} 200)""",
        *M1,
    ),
    "page_premium": sql("SELECT * FROM page", *M2, PREMIUM_PAGE),
    "page_premium_metrics": sql(
        "SELECT median(hq_premium_pct) AS median_premium, COUNT(*) AS hq_rows FROM page",
        *M2, PREMIUM_PAGE,
    ),
    "page_premium_bars": sql(
        """SELECT COALESCE(item_name, 'Unknown') AS label, hq_premium_pct FROM page
        ORDER BY hq_premium_pct DESC, item_id, world_id LIMIT 20""",
        *M2, PREMIUM_PAGE,
    ),
    "page_velocity_metrics": sql(
        f"""SELECT CAST(SUM(sale_count) AS BIGINT) AS total_sales,
        CAST(SUM(total_volume) AS BIGINT) AS total_volume
        FROM (SELECT * FROM velocity {TOP_VELOCITY} 200)""",
        *M45,
    ),
    "page_history": sql("SELECT * FROM page", *M45, HISTORY_PAGE),
    "history_labels": sql("SELECT DISTINCT label FROM page", *M45, HISTORY_PAGE),
    "history_series": sql(
        "SELECT sale_date, avg_price FROM page WHERE label = 'small ring'", *M45, HISTORY_PAGE
    ),
    "sql_rows": sql(
        """SELECT world_name, CAST(SUM(listing_count) AS BIGINT) AS listings,
        MAX(max_price) AS highest FROM price_summary GROUP BY world_name
        ORDER BY world_name LIMIT 20""",
        *M1,
    ),
    "fenced_sql": r"""SELECT doc_id, md5(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS sql_md5
        FROM documents""",
    "dq_report": _checks_sql(LISTINGS, SALES),
    "dq_duplicate_listings": sql(
        """SELECT listing_id, COUNT(*) AS n_records FROM listings WHERE listing_id IS NOT NULL
        GROUP BY listing_id HAVING COUNT(*) > 1""",
        LISTINGS,
    ),
    "dq_sale_totals": sql(
        "SELECT * FROM sales WHERE ABS(total - price_per_unit * quantity) > 1", SALES_FINE
    ),
    "snapshot_items": sql(
        """SELECT world_name, CAST(item_id AS INTEGER) AS item_id,
        CAST(COUNT(*) AS INTEGER) AS listings_count, AVG(price_per_unit) AS average_price,
        CAST(SUM(quantity) AS BIGINT) / 7 AS sale_velocity
        FROM listings l JOIN worlds w ON l.world_id = w.world_id
        GROUP BY world_name, item_id HAVING COUNT(*) >= 2""",
        *L,
    ),
    "live_quotes": sql(
        """SELECT i.item_name || ' #' || i.item_id AS item_name, world_name AS world, listings,
        recent_sales, 'Live listings for ' || i.item_name || ' #' || i.item_id || ' on ' || world_name
          || ':' || chr(10) || offers || chr(10) || 'Recent sales:' || chr(10) || sold AS report
        FROM quotes q JOIN items i ON q.item_id = i.item_id JOIN worlds w ON q.world_id = w.world_id""",
        *L, QUOTES,
    ),
    "item_details": sql(
        """SELECT * REPLACE (md5(description) AS description), concat_ws(chr(10),
          item_name || ' (ID: ' || item_id || ')', '  Category: ' || category,
          '  Item Level: ' || item_level, '  Equip Level: ' || equip_level,
          '  Can be HQ: ' || CASE WHEN can_be_hq THEN 'Yes' ELSE 'No' END,
          '  Description: ' || CASE WHEN length(description) > 300
            THEN substring(description, 1, 300) || '...' ELSE description END) AS report
        FROM details""",
        ITEM_DETAILS,
    ),
    "page_headlines": sql("SELECT * FROM headlines", HEADLINES),
    "page_headline_reports": sql(
        """SELECT p.page_id, COALESCE(
          'Latest news:' || chr(10) || string_agg('  - ' || title, chr(10) ORDER BY position),
          'Could not parse the news page. The page structure may have changed.') AS report
        FROM pages p LEFT JOIN headlines h ON p.page_id = h.page_id GROUP BY p.page_id""",
        HEADLINES,
    ),
    "usage_totals": r"""SELECT CAST(SUM(w) FILTER (WHERE role <> 'assistant') AS BIGINT) AS input_tokens,
        CAST(SUM(w) FILTER (WHERE role = 'assistant') AS BIGINT) AS output_tokens,
        (CAST(SUM(w) FILTER (WHERE role <> 'assistant') AS DOUBLE) * 1.0::DOUBLE
         + CAST(SUM(w) FILTER (WHERE role = 'assistant') AS DOUBLE) * 5.0::DOUBLE)
         / 1000000 AS cost_usd
        FROM (SELECT role, len(regexp_extract_all(text, '\S+')) AS w FROM conversations)""",
    "usage_tools": """SELECT event_type AS tool_name, COUNT(*) AS calls FROM events
        WHERE event_type <> 'view' GROUP BY event_type""",
    "usage_tool_calls": "SELECT COUNT(*) AS calls FROM events WHERE event_type <> 'view'",
    "usage_rates": sql(
        """SELECT window_start, CAST(SUM(tokens_in) AS BIGINT) / 60 AS input_per_second,
        CAST(SUM(tokens_out) AS BIGINT) / 60 AS output_per_second,
        (CAST(SUM(tokens_in) AS DOUBLE) * 1.0::DOUBLE + CAST(SUM(tokens_out) AS DOUBLE) * 5.0::DOUBLE)
          / 1000000 / 60 * 60 AS cost_per_minute FROM log GROUP BY window_start""",
        LOG,
    ),
    "usage_means": sql(
        """SELECT date_trunc('minute', closed) AS window_start,
        ROUND(SUM(duration_ms) / COUNT(duration_ms), 4) AS mean_duration_ms,
        CAST(SUM(rounds) AS BIGINT) / COUNT(rounds) AS mean_iterations
        FROM requests WHERE closed IS NOT NULL GROUP BY 1""",
        LOG,
    ),
    "usage_routes": sql(
        """SELECT date_trunc('minute', closed) AS window_start, method, route,
        COUNT(*) / 60 AS requests_per_second
        FROM requests WHERE closed IS NOT NULL GROUP BY 1, method, route""",
        LOG,
    ),
    "usage_active": sql(
        """SELECT window_start, CAST(SUM(change) OVER (ORDER BY window_start) AS BIGINT) AS active
        FROM (SELECT window_start, SUM(change) AS change FROM (
          SELECT date_trunc('minute', started) AS window_start, 1 AS change FROM requests
          UNION ALL SELECT date_trunc('minute', closed), -1 FROM requests WHERE closed IS NOT NULL)
          GROUP BY window_start)""",
        LOG,
    ),
    "usage_active_at": sql(
        """SELECT route, COUNT(*) FILTER (WHERE started <= TIMESTAMP '2024-01-15 12:00:00'
        AND (closed IS NULL OR closed > TIMESTAMP '2024-01-15 12:00:00')) AS active
        FROM requests GROUP BY route""",
        LOG,
    ),
    "stream_ingest": sql("SELECT * FROM latest_listings", LISTING_EVENTS),
    "stream_upsert": sql("SELECT * FROM latest_listings", LISTING_EVENTS),
    "stream_latest": sql(
        """SELECT world, dt, COUNT(*) AS sales FROM
        (SELECT DISTINCT item, world, ts, dt FROM sale_events) GROUP BY world, dt""",
        SALE_EVENTS,
    ),
    "stream_rates": """SELECT window_start, CAST(i AS BIGINT) / 60 AS input_per_second,
        n * 2 / 60 AS output_per_second,
        (CAST(i AS DOUBLE) * 1.0::DOUBLE + CAST(n * 2 AS DOUBLE) * 5.0::DOUBLE) / 1000000 / 60 * 60
          AS cost_per_minute
        FROM (SELECT date_trunc('minute', ts) AS window_start, SUM(length(event_type)) AS i,
          COUNT(*) AS n FROM events GROUP BY 1)""",
    "pipeline_run": _checks_sql(INGESTED_LISTINGS, INGESTED_SALES),
}

# A stream gives the same figures as a query over the whole log.
ORACLE["stream_means"] = ORACLE["usage_means"]
ORACLE["stream_active"] = ORACLE["usage_active"]

# What a second session reads from the published marts is what the marts hold.
ORACLE["published_pages"] = " UNION ALL ".join(
    f"SELECT '{name}' AS page, item_name, world_name, CAST({figure} AS DOUBLE) AS figure FROM ({ORACLE[name]})"
    for name, figure in {
        "top_arbitrage": "profit_margin_pct",
        "price_lookup": "listing_count",
        "top_velocity": "sale_count",
        "hq_premium": "hq_premium_pct",
        "price_summary": "listing_count",
        "arbitrage": "profit_margin_pct",
    }.items()
)
