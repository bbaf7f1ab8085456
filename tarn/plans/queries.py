"""Registered queries of the engine: dialect text, run by our compiler, and DuckDB text for the same rows.

Every query reads its whole tables. Sums of doubles are rounded, since their last digits hang on the
order of adding up.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.compile import Session
from tarn.operators.asof import asof_join
from tarn.operators.merge_tree import latest, summed
from tarn.plans import schema_queries, statement_queries

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")


def session(spark: SparkSession, sf_dir: str) -> Session:
    """The tables of a data set; each is read only where a query names it."""
    out = Session(spark)
    plain = out.table

    def table(parts: tuple[str, ...]) -> DataFrame:
        if parts[-1] in TABLES and len(parts) == 1:
            return spark.read.parquet(f"{sf_dir}/{parts[-1]}.parquet")
        return plain(parts)

    out.table = table
    return out


# name: (dialect, DuckDB); a lone text serves both
SQL: dict[str, tuple[str, str] | str] = {
    "flagship": (
        """WITH paid AS (SELECT c.c_custkey AS k, c.c_name AS name, c.c_nationkey AS nation, count() AS n, round(sum(o.o_totalprice), 2) AS total
           FROM customer AS c LEFT JOIN orders AS o ON c.c_custkey = o.o_custkey WHERE c.c_acctbal > 0 GROUP BY c.c_custkey, c.c_name, c.c_nationkey HAVING n > 5)
           SELECT name, n, total, n_name, rank() OVER (PARTITION BY nation ORDER BY total DESC, k) AS place FROM paid INNER JOIN nation ON nation = n_nationkey""",
        """WITH paid AS (SELECT c.c_custkey AS k, c.c_name AS name, c.c_nationkey AS nation, count(*) AS n, round(sum(o.o_totalprice), 2) AS total
           FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey WHERE c.c_acctbal > 0 GROUP BY ALL HAVING count(*) > 5)
           SELECT name, n, total, n_name, rank() OVER (PARTITION BY nation ORDER BY total DESC, k) AS place FROM paid JOIN nation ON nation = n_nationkey""",
    ),
    "project_filter": "SELECT o_orderkey, o_totalprice * 2 AS double_price, o_orderkey + 1 AS next_key FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'F'",
    "no_from": "SELECT 1 AS one, 'x' AS letter",
    "distinct": "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders",
    "like": "SELECT c_custkey, c_name FROM customer WHERE c_name LIKE '%9%' AND NOT c_name LIKE '%1%'",
    "in_list": "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderkey NOT IN (1, 2, 3)",
    "in_tuple": "SELECT o_orderkey FROM orders WHERE (o_orderstatus, o_orderpriority) IN (('F', '1-URGENT'), ('O', '2-HIGH'))",
    "between": "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_discount NOT BETWEEN 0.02 AND 0.05",
    "is_null": "SELECT c.c_custkey AS k, o.o_orderkey IS NULL AS lone FROM customer AS c LEFT JOIN orders AS o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 400000 WHERE o.o_orderkey IS NULL OR o.o_orderstatus IS NOT NULL",
    "case_when": "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band, CASE o_orderstatus WHEN 'F' THEN 1 ELSE 0 END AS done FROM orders",
    "where_alias": ("SELECT o_orderkey, o_totalprice / 1000 AS kilo FROM orders WHERE kilo > 300", "SELECT o_orderkey, o_totalprice / 1000 AS kilo FROM orders WHERE o_totalprice / 1000 > 300"),
    "division": ("SELECT o_orderkey, o_totalprice / (o_orderkey % 2) AS q, 7 / 2 AS half, -o_orderkey % 4 AS m FROM orders", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE o_totalprice / (o_orderkey % 2) END AS q, 7 / 2 AS half, -o_orderkey % 4 AS m FROM orders"),
    "cast": ("SELECT o_orderkey, CAST(o_totalprice AS Int64) AS whole, CAST(o_orderkey AS String) AS text, CAST(o_totalprice AS Decimal(12, 1)) AS tenth FROM orders WHERE o_totalprice % 1 < 0.5 AND o_totalprice % 0.1 < 0.04", "SELECT o_orderkey, CAST(trunc(o_totalprice) AS BIGINT) AS whole, CAST(o_orderkey AS VARCHAR) AS text, CAST(o_totalprice AS DECIMAL(12, 1)) AS tenth FROM orders WHERE o_totalprice % 1 < 0.5 AND o_totalprice % 0.1 < 0.04"),
    "extract_part": ("SELECT o_orderkey, EXTRACT(YEAR FROM o_orderdate) AS y, EXTRACT(MONTH FROM o_orderdate) AS m, EXTRACT(DAY FROM o_orderdate) AS d FROM orders", "SELECT o_orderkey, EXTRACT(YEAR FROM o_orderdate)::INT AS y, EXTRACT(MONTH FROM o_orderdate)::INT AS m, EXTRACT(DAY FROM o_orderdate)::INT AS d FROM orders"),
    "interval_arith": ("SELECT o_orderkey, o_orderdate + INTERVAL 1 QUARTER AS q, o_orderdate - INTERVAL 2 WEEK AS w, o_orderdate + INTERVAL 3 HOUR AS h FROM orders", "SELECT o_orderkey, o_orderdate + INTERVAL 3 MONTH AS q, o_orderdate - INTERVAL 14 DAY AS w, o_orderdate + INTERVAL 3 HOUR AS h FROM orders"),
    "cte_chain": ("WITH a AS (SELECT l_orderkey AS k, sum(l_quantity) AS q FROM lineitem GROUP BY l_orderkey), b AS (SELECT k, q FROM a WHERE q > 100) SELECT o_orderstatus, count() AS n, sum(q) AS total FROM b INNER JOIN orders ON k = o_orderkey GROUP BY o_orderstatus", "WITH a AS (SELECT l_orderkey AS k, sum(l_quantity) AS q FROM lineitem GROUP BY l_orderkey), b AS (SELECT k, q FROM a WHERE q > 100) SELECT o_orderstatus, count(*) AS n, sum(q) AS total FROM b JOIN orders ON k = o_orderkey GROUP BY o_orderstatus"),
    "from_subquery": "SELECT s.k AS k, s.n AS n FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey) AS s WHERE s.n > 10",
    "in_subquery": "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)",
    "not_in_subquery": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)",
    "join_inner": "SELECT n_name, r_name FROM nation INNER JOIN region ON n_regionkey = r_regionkey",
    "join_left": "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000",
    "join_right": "SELECT o_orderkey, c_custkey FROM orders RIGHT JOIN customer ON c_custkey = o_custkey AND o_totalprice > 300000",
    "join_full": "SELECT s_suppkey, n_nationkey FROM supplier FULL JOIN nation ON s_nationkey = n_nationkey AND s_acctbal > 5000",
    "join_cross": "SELECT r_name, n_name FROM region CROSS JOIN nation",
    "join_using": ("SELECT o_custkey, a.n AS n, b.s AS s FROM (SELECT o_custkey, count() AS n FROM orders GROUP BY o_custkey) AS a INNER JOIN (SELECT o_custkey, round(max(o_totalprice), 2) AS s FROM orders GROUP BY o_custkey) AS b USING (o_custkey)", "SELECT o_custkey, a.n AS n, b.s AS s FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) a JOIN (SELECT o_custkey, round(max(o_totalprice), 2) AS s FROM orders GROUP BY o_custkey) b USING (o_custkey)"),
    "join_theta": "SELECT a.s_suppkey AS a, b.n_nationkey AS b FROM supplier AS a INNER JOIN nation AS b ON a.s_nationkey < b.n_nationkey AND a.s_acctbal > 9000",
    "join_global": ("SELECT c_custkey, n_name FROM customer GLOBAL INNER JOIN nation ON c_nationkey = n_nationkey", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey"),
    "join_asof": (
        "SELECT e.event_id AS event_id, p.event_id AS purchase_id FROM (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error') AS e LEFT ASOF JOIN (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase') AS p ON e.user_id = p.user_id AND e.ts >= p.ts",
        "SELECT e.event_id AS event_id, p.event_id AS purchase_id FROM (SELECT * FROM events WHERE event_type = 'error') e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts >= p.ts",
    ),
    "array_join": ("SELECT vec_id, count() AS n, round(max(x), 5) AS top FROM embeddings ARRAY JOIN embedding AS x GROUP BY vec_id", "SELECT vec_id, count(*) AS n, round(max(x), 5) AS top FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings) GROUP BY vec_id"),
    "group_by": ("SELECT o_orderstatus, count() AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean, min(o_orderkey) AS low, max(o_orderkey) AS high FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean, min(o_orderkey) AS low, max(o_orderkey) AS high FROM orders GROUP BY o_orderstatus"),
    "group_by_alias": ("SELECT toYYYYMM(o_orderdate) AS month, count() AS n FROM orders GROUP BY month", "SELECT (year(o_orderdate) * 100 + month(o_orderdate))::INT AS month, count(*) AS n FROM orders GROUP BY month"),
    "group_by_all": ("SELECT o_orderstatus, o_orderpriority, count() AS n FROM orders GROUP BY ALL", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL"),
    "global_aggregate": "SELECT count(*) AS n, min(o_orderkey) AS low FROM orders WHERE o_totalprice > 1000",
    "having": ("SELECT o_custkey, count() AS n FROM orders GROUP BY o_custkey HAVING n > 12", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12"),
    "cube": ("SELECT o_orderstatus, o_orderpriority, count() AS n FROM orders GROUP BY o_orderstatus, o_orderpriority WITH CUBE", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)"),
    "rollup": ("SELECT o_orderstatus, o_orderpriority, count() AS n FROM orders GROUP BY o_orderstatus, o_orderpriority WITH ROLLUP", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)"),
    "totals": ("SELECT o_orderstatus, count() AS n FROM orders GROUP BY o_orderstatus WITH TOTALS HAVING n > 10 ORDER BY n", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), ())"),
    "agg_count_if": ("SELECT o_orderstatus, countIf(o_totalprice > 100000) AS big, round(sumIf(o_totalprice, o_orderpriority = '1-URGENT'), 2) AS urgent FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, count_if(o_totalprice > 100000) AS big, round(sum(o_totalprice) FILTER (o_orderpriority = '1-URGENT'), 2) AS urgent FROM orders GROUP BY o_orderstatus"),
    "agg_arg_max": ("SELECT o_orderstatus, argMax(o_orderkey, o_orderkey * 7 % 1009 * 100000 + o_orderkey) AS top, argMin(o_custkey, o_orderkey) AS first FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, arg_max(o_orderkey, o_orderkey * 7 % 1009 * 100000 + o_orderkey) AS top, arg_min(o_custkey, o_orderkey) AS first FROM orders GROUP BY o_orderstatus"),
    "agg_quantiles": ("SELECT o_orderstatus, round(quantileExactInclusive(0.9)(o_totalprice), 4) AS p90, round(medianExactInclusive(o_totalprice), 4) AS mid FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, round(quantile_cont(o_totalprice, 0.9), 4) AS p90, round(quantile_cont(o_totalprice, 0.5), 4) AS mid FROM orders GROUP BY o_orderstatus"),
    "agg_uniq_exact": ("SELECT event_type, uniqExact(user_id) AS users FROM events GROUP BY event_type", "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type"),
    "agg_uniq_approx": ("SELECT event_type, abs(uniq(user_id) - uniqExact(user_id)) <= 0.08 * uniqExact(user_id) AS close FROM events GROUP BY event_type", "SELECT event_type, true AS close FROM events GROUP BY 1"),
    "agg_uniq_state": ("SELECT abs(uniqMerge(u) - max(e)) <= 0.08 * max(e) AS close FROM (SELECT user_id % 3 AS part, uniqState(event_id) AS u, 0 AS z FROM events GROUP BY part) CROSS JOIN (SELECT uniqExact(event_id) AS e FROM events)", "SELECT true AS close"),
    "agg_top_k": ("SELECT o_orderstatus, arrayStringConcat(topK(3)(o_orderpriority), '|') AS most FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, string_agg(o_orderpriority, '|' ORDER BY n DESC) AS most FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY n DESC) <= 3) GROUP BY 1"),
    "agg_state_merge": ("SELECT s, round(sumMerge(a), 2) AS total, round(avgMerge(b), 4) AS mean, countMerge(c) AS n FROM (SELECT o_orderstatus AS s, o_custkey % 7 AS part, sumState(o_totalprice) AS a, avgState(o_totalprice) AS b, countState() AS c FROM orders GROUP BY s, part) GROUP BY s", "SELECT o_orderstatus AS s, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean, count(*) AS n FROM orders GROUP BY o_orderstatus"),
    "agg_group_array": ("SELECT o_custkey, length(arrayStringConcat(groupArray(o_orderstatus))) AS n FROM orders GROUP BY o_custkey", "SELECT o_custkey, length(string_agg(o_orderstatus, ''))::INT AS n FROM orders GROUP BY o_custkey"),
    "win_row_number": "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders",
    "win_rank": "SELECT o_orderkey, rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority) AS r, dense_rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority) AS d FROM orders",
    "win_lead_lag": "SELECT event_id, lead(value, 1, 0.0) OVER (PARTITION BY user_id ORDER BY ts) AS after, lag(value) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events",
    "win_first_nth": "SELECT event_id, first_value(event_id) OVER (PARTITION BY user_id ORDER BY ts) AS one, nth_value(event_id, 2) OVER (PARTITION BY user_id ORDER BY ts) AS two FROM events",
    "win_ntile": "SELECT o_orderkey, ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS q, round(percent_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 6) AS p, round(cume_dist() OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 6) AS c FROM orders",
    "win_rows_frame": "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS s, count(*) OVER (PARTITION BY user_id ORDER BY ts ROWS 3 PRECEDING) AS n FROM events",
    "win_range_frame": "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 500 PRECEDING AND 100 FOLLOWING) AS n FROM orders",
    "win_cumsum": ("SELECT event_id, round(cumsum(value) OVER (PARTITION BY user_id ORDER BY ts), 4) AS s FROM events", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING), 4) AS s FROM events"),
    "order_limit_offset": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 20 OFFSET 5",
    "order_collate": ("SELECT n_name FROM nation ORDER BY n_name COLLATE 'en' LIMIT 100", "SELECT n_name FROM nation"),
    "limit_by": ("SELECT o_custkey, o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 2 BY o_custkey", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2"),
    "fill_range": ("SELECT o_custkey % 50 * 3 AS k, count() AS n FROM orders GROUP BY k ORDER BY k WITH FILL FROM 0 TO 160 STEP 1", "SELECT g.k::BIGINT AS k, n FROM (SELECT unnest(range(0, 160)) AS k) g FULL JOIN (SELECT o_custkey % 50 * 3 AS k, count(*) AS n FROM orders GROUP BY 1) t USING (k)"),
    "fill_interval": (
        "SELECT toStartOfHour(ts) AS h, count() AS n FROM events WHERE event_type = 'error' GROUP BY h ORDER BY h WITH FILL FROM toDateTime('2024-01-01 00:00:00') TO toDateTime('2024-02-05 00:00:00') STEP INTERVAL 1 HOUR",
        "SELECT g.h AS h, n FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-01 00:00:00', TIMESTAMP '2024-02-04 23:00:00', INTERVAL 1 HOUR)) AS h) g LEFT JOIN (SELECT date_trunc('hour', ts) AS h, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1) t USING (h)",
    ),
    "fill_prefix": (
        "SELECT user_id, toDate(ts) AS d, count() AS n FROM events GROUP BY user_id, d ORDER BY user_id, d WITH FILL STEP INTERVAL 1 DAY",
        "WITH t AS (SELECT user_id, ts::DATE AS d, count(*) AS n FROM events GROUP BY ALL), g AS (SELECT user_id, unnest(generate_series(min(d), max(d), INTERVAL 1 DAY))::DATE AS d FROM t GROUP BY 1) SELECT g.user_id AS user_id, g.d AS d, n FROM g LEFT JOIN t ON g.user_id = t.user_id AND g.d = t.d",
    ),
    "limit_by_fill": (
        "SELECT o_custkey % 20 * 5 AS k, o_orderstatus AS s, count() AS n FROM orders GROUP BY k, s ORDER BY k WITH FILL FROM 0 TO 100, s LIMIT 1 BY k",
        "WITH t AS (SELECT o_custkey % 20 * 5 AS k, o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY k ORDER BY s) = 1) SELECT g.k::BIGINT AS k, s, n FROM (SELECT unnest(range(0, 100)) AS k) g LEFT JOIN t USING (k)",
    ),
    "limit_by_distinct": (
        "SELECT DISTINCT o_custkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 2 BY o_orderstatus, o_orderpriority",
        "WITH d AS (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1) SELECT o_custkey FROM d QUALIFY row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) <= 2",
    ),
    "limit_by_totals": (
        "SELECT o_orderstatus, o_orderpriority, count() AS n FROM orders GROUP BY o_orderstatus, o_orderpriority WITH TOTALS ORDER BY n DESC, o_orderpriority LIMIT 1 BY o_orderstatus",
        "SELECT * FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY n DESC, o_orderpriority) = 1) UNION ALL SELECT NULL, NULL, count(*) FROM orders",
    ),
    "totals_fill": (
        "SELECT o_custkey % 10 * 2 AS k, count() AS n FROM orders GROUP BY k WITH TOTALS ORDER BY k WITH FILL FROM 0 TO 25",
        "SELECT g.k::BIGINT AS k, n FROM (SELECT unnest(range(0, 25)) AS k) g LEFT JOIN (SELECT o_custkey % 10 * 2 AS k, count(*) AS n FROM orders GROUP BY 1) t USING (k) UNION ALL SELECT NULL, count(*) FROM orders",
    ),
    "star": ("SELECT * FROM nation", "SELECT * FROM nation"),
    "star_of_alias": ("SELECT n.*, r_name FROM nation n INNER JOIN region r ON n.n_regionkey = r.r_regionkey", "SELECT n.*, r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey"),
    "query_settings": ("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 50 SETTINGS limit = 20, offset = 5", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 5"),
    "win_over_all": ("SELECT o_orderkey, count() OVER () AS n, max(o_totalprice) OVER () AS top FROM orders", "SELECT o_orderkey, count(*) OVER () AS n, max(o_totalprice) OVER () AS top FROM orders"),
    "join_cross_comma": "SELECT r_name, n_name FROM region CROSS JOIN nation WHERE r_regionkey = n_regionkey",
    "table_function_remote": ("SELECT n_name FROM remote('localhost', 'nation')", "SELECT n_name FROM nation"),
    "table_function_cluster": ("SELECT n_name FROM cluster('c', 'nation')", "SELECT n_name FROM nation"),
    "fn_misc": (
        "SELECT event_id, toUnixTimestamp64Milli(ts) AS ms, toStartOfMinute(ts) AS m, splitByChar('-', formatDateTime(ts, '%Y-%m-%d'))[2] AS mm, domain(concat('https://host', toString(user_id), '.example.org/p?q=1')) AS d, formatReadableSize(event_id * 1000 + 1) AS size FROM events",
        "SELECT event_id, epoch_us(ts) // 1000 AS ms, date_trunc('minute', ts) AS m, strftime(ts, '%m') AS mm, 'host' || user_id || '.example.org' AS d, CASE WHEN (event_id * 1000 + 1) >= 1073741824 THEN printf('%.2f GiB', (event_id * 1000 + 1) / 1073741824.0) WHEN (event_id * 1000 + 1) >= 1048576 THEN printf('%.2f MiB', (event_id * 1000 + 1) / 1048576.0) WHEN (event_id * 1000 + 1) >= 1024 THEN printf('%.2f KiB', (event_id * 1000 + 1) / 1024.0) ELSE printf('%.2f B', ((event_id * 1000 + 1))::DOUBLE) END AS size FROM events",
    ),
    "fn_uuid_ip": ("SELECT n_nationkey, length(generateUUIDv4()) AS n, toIPv4('10.0.0.1') AS ip, sipHash64(n_name) = sipHash64(n_name) AS same, currentDatabase() = currentDatabase() AS db FROM nation", "SELECT n_nationkey, 36::INT AS n, '10.0.0.1' AS ip, true AS same, true AS db FROM nation"),
    "agg_quantile_sketch": ("SELECT o_orderstatus, abs(quantile(0.9)(o_totalprice) - quantileExact(0.9)(o_totalprice)) < 500 AS high, abs(median(o_totalprice) - medianExact(o_totalprice)) < 500 AS mid FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, true AS high, true AS mid FROM orders GROUP BY 1"),
    "fill_staleness": (
        "SELECT o_custkey % 20 * 10 AS k, count() AS n FROM orders GROUP BY k ORDER BY k WITH FILL STEP 1 STALENESS 3",
        "WITH t AS (SELECT o_custkey % 20 * 10 AS k, count(*) AS n FROM orders GROUP BY 1) SELECT k, n FROM t UNION ALL SELECT k + s AS k, NULL AS n FROM t, (VALUES (1), (2)) v(s)",
    ),
    "fill_interpolate": (
        "SELECT o_custkey % 30 * 4 AS k, count() AS n, max(o_orderkey) AS top FROM orders GROUP BY k ORDER BY k WITH FILL STEP 1 INTERPOLATE (n AS n + 1, top)",
        "WITH t AS (SELECT o_custkey % 30 * 4 AS k, count(*) AS n, max(o_orderkey) AS top FROM orders GROUP BY 1), g AS (SELECT unnest(range(min(k), max(k) + 1)) AS k FROM t) SELECT g.k::BIGINT AS k, (last_value(n IGNORE NULLS) OVER w + g.k - last_value(t.k IGNORE NULLS) OVER w)::BIGINT AS n, last_value(top IGNORE NULLS) OVER w AS top FROM g LEFT JOIN t USING (k) WINDOW w AS (ORDER BY g.k)",
    ),
    "numbers_tvf": ("SELECT number, number * number AS sq FROM numbers(1000)", "SELECT range AS number, range * range AS sq FROM range(1000)"),
    "fn_string": (
        "SELECT c_custkey, lower(c_name) AS lo, upper(c_mktsegment) AS up, substring(c_name, 3, 4) AS sub, length(c_name) AS n, concat(c_name, '-', c_mktsegment) AS c, startsWith(c_name, 'Cust') AS st, trim(concat('  ', c_name, ' ')) AS t, replaceAll(c_name, '0', 'o') AS r, toString(c_custkey) AS s, position(c_name, '#') AS p FROM customer",
        "SELECT c_custkey, lower(c_name) AS lo, upper(c_mktsegment) AS up, substring(c_name, 3, 4) AS sub, length(c_name)::INT AS n, concat(c_name, '-', c_mktsegment) AS c, starts_with(c_name, 'Cust') AS st, trim('  ' || c_name || ' ') AS t, replace(c_name, '0', 'o') AS r, c_custkey::VARCHAR AS s, strpos(c_name, '#')::INT AS p FROM customer",
    ),
    "fn_date": (
        "SELECT event_id, toDate(ts) AS d, toStartOfHour(ts) AS h, toStartOfMonth(ts) AS m, toYYYYMM(ts) AS ym, toDayOfWeek(ts) AS dow, toMonday(ts) AS monday, toStartOfWeek(ts) AS sunday, formatDateTime(ts, '%Y-%m-%d %H') AS f, dateDiff('day', toDate('2024-01-01'), toDate(ts)) AS days, toHour(ts) AS hour, toYear(ts) AS y FROM events",
        "SELECT event_id, ts::DATE AS d, date_trunc('hour', ts) AS h, date_trunc('month', ts)::DATE AS m, (year(ts) * 100 + month(ts))::INT AS ym, isodow(ts)::INT AS dow, date_trunc('week', ts)::DATE AS monday, (date_trunc('week', ts + INTERVAL 1 DAY)::DATE - INTERVAL 1 DAY)::DATE AS sunday, strftime(ts, '%Y-%m-%d %H') AS f, datediff('day', DATE '2024-01-01', ts::DATE) AS days, hour(ts)::INT AS hour, year(ts)::INT AS y FROM events",
    ),
    "fn_math": (
        "SELECT o_orderkey, plus(o_orderkey, 1) AS a, minus(o_orderkey, 2) AS b, multiply(o_orderkey, 3) AS c, round(divide(o_totalprice, 7), 6) AS d, modulo(o_orderkey, 5) AS e, abs(-o_orderkey) AS f, round(sqrt(o_totalprice), 6) AS g, pow(o_orderkey, 2) AS h, intDiv(o_orderkey, 3) AS i, least(o_orderkey, 100) AS j, greatest(o_orderkey, 100) AS k, ceil(o_totalprice) AS l, round(log(o_totalprice), 8) AS m FROM orders",
        "SELECT o_orderkey, o_orderkey + 1 AS a, o_orderkey - 2 AS b, o_orderkey * 3 AS c, round(o_totalprice / 7, 6) AS d, o_orderkey % 5 AS e, abs(-o_orderkey) AS f, round(sqrt(o_totalprice), 6) AS g, pow(o_orderkey, 2) AS h, o_orderkey // 3 AS i, least(o_orderkey, 100) AS j, greatest(o_orderkey, 100) AS k, ceil(o_totalprice)::BIGINT AS l, round(ln(o_totalprice), 8) AS m FROM orders",
    ),
    "fn_cond": (
        "SELECT o_orderkey, if(o_totalprice > 100000, 'a', 'b') AS i, multiIf(o_totalprice > 300000, 3, o_totalprice > 200000, 2, 1) AS m, coalesce(nullIf(o_orderstatus, 'F'), 'z') AS c, greaterOrEquals(o_orderkey, 10) AS g, and(equals(o_orderstatus, 'F'), less(o_orderkey, 500)) AS both FROM orders",
        "SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'a' ELSE 'b' END AS i, (CASE WHEN o_totalprice > 300000 THEN 3 WHEN o_totalprice > 200000 THEN 2 ELSE 1 END)::INT AS m, coalesce(nullif(o_orderstatus, 'F'), 'z') AS c, o_orderkey >= 10 AS g, o_orderstatus = 'F' AND o_orderkey < 500 AS both FROM orders",
    ),
    "fn_json": ("SELECT event_id, JSONExtractString(props, 'k') AS s, JSONExtractInt(props, 'k') AS i FROM events", "SELECT event_id, json_extract_string(props, '$.k') AS s, json_extract_string(props, '$.k')::BIGINT AS i FROM events"),
    "fn_array_map": (
        "SELECT o_orderkey, array(o_orderkey, o_custkey)[2] AS second, has([o_orderstatus, 'X'], 'X') AS x, arrayStringConcat(arrayMap(v -> concat(v, '!'), splitByChar('-', o_orderpriority)), '|') AS parts, map('a', o_orderkey, 'b', 2)['a'] AS a FROM orders",
        "SELECT o_orderkey, o_custkey AS second, true AS x, array_to_string(list_transform(string_split(o_orderpriority, '-'), lambda v: v || '!'), '|') AS parts, o_orderkey AS a FROM orders",
    ),
    "fn_hash": ("SELECT o_orderkey, MD5(o_orderpriority) AS m, SHA256(o_orderpriority) AS s FROM orders", "SELECT o_orderkey, md5(o_orderpriority) AS m, sha256(o_orderpriority) AS s FROM orders"),
    "view_daily_sales": (
        "SELECT toDate(o_orderdate) AS day, count() AS orders, round(sum(o_totalprice), 2) AS revenue, round(avg(o_totalprice), 6) AS mean, uniqExact(o_custkey) AS customers FROM orders WHERE o_orderstatus != 'P' GROUP BY day ORDER BY day DESC",
        "SELECT o_orderdate::DATE AS day, count(*) AS orders, round(sum(o_totalprice), 2) AS revenue, round(avg(o_totalprice), 6) AS mean, count(DISTINCT o_custkey) AS customers FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1",
    ),
    "view_top_products": (
        "WITH sales AS (SELECT l_partkey AS k, sum(l_quantity) AS q, round(sum(l_extendedprice), 2) AS revenue FROM lineitem GROUP BY l_partkey) SELECT p_partkey, p_brand, q, revenue, row_number() OVER (PARTITION BY p_brand ORDER BY revenue DESC, p_partkey) AS place FROM part LEFT JOIN sales ON p_partkey = k WHERE q IS NOT NULL ORDER BY p_brand, place LIMIT 3 BY p_brand",
        "WITH sales AS (SELECT l_partkey AS k, sum(l_quantity) AS q, round(sum(l_extendedprice), 2) AS revenue FROM lineitem GROUP BY l_partkey) SELECT p_partkey, p_brand, q, revenue, row_number() OVER (PARTITION BY p_brand ORDER BY revenue DESC, p_partkey) AS place FROM part JOIN sales ON p_partkey = k QUALIFY place <= 3",
    ),
}


def _dialect(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: session(spark, sf_dir).sql(text)


def udf_inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared SQL functions are worked into the query."""
    from tarn.sqlfront.parser import parse_expr

    s = session(spark, sf_dir)
    s.functions = {"net": parse_expr("(price, rate) -> round(price * (1 - rate), 5)"), "band": parse_expr("(x) -> multiIf(net(x, 0.1) > 200000, 'big', 'small')")}
    return s.sql("SELECT o_orderkey, net(o_totalprice, 0.25) AS net_price, band(o_totalprice) AS size FROM orders")


def dict_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dictionary over a table, looked up by key; unknown keys give nulls."""
    from tarn.apply import Warehouse

    w = Warehouse(spark)
    tables = session(spark, sf_dir)
    plain = w._lookup
    w._lookup = lambda parts: tables.table(parts) if parts[-1] in TABLES else plain(parts)
    w.run_script("CREATE DICTIONARY nations (n_nationkey Int32, n_name String DEFAULT '?', n_regionkey Int32) PRIMARY KEY n_nationkey SOURCE(LOCAL(TABLE 'nation')) LAYOUT(HASHED()) LIFETIME(60)")
    customers = tables.table(("customer",)).select("c_custkey", "c_nationkey")
    return w.lookup(customers, "nations", {"n_nationkey": "c_nationkey"}, ["n_name"]).select("c_custkey", "n_name")


def replacing_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest event of every user."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "event_id", "event_type")
    return latest(events, ["user_id"], "ts")


def summing_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one key summed."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderkey")
    return summed(orders, ["o_custkey"], ["o_orderkey"])


def asof_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next later purchase after every error, by > on the other side."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "ts", "event_type")
    out = asof_join(events.where("event_type = 'error'"), events.where("event_type = 'purchase'"), [("user_id", "user_id")], ("ts", "<", "ts"), inner=True, held="p")
    return out.select("event_id", F.col("p.event_id").alias("purchase_id"))


CODE: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "udf_inline": (udf_inline, "SELECT o_orderkey, round(o_totalprice * (1 - 0.25), 5) AS net_price, CASE WHEN round(o_totalprice * (1 - 0.1), 5) > 200000 THEN 'big' ELSE 'small' END AS size FROM orders"),
    "dict_lookup": (dict_lookup, "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey"),
    "replacing_latest": (replacing_latest, "SELECT user_id, ts, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"),
    "summing_merge": (summing_merge, "SELECT o_custkey, sum(o_orderkey)::BIGINT AS o_orderkey FROM orders GROUP BY o_custkey"),
    "asof_strict": (asof_strict, "SELECT e.event_id AS event_id, p.event_id AS purchase_id FROM (SELECT * FROM events WHERE event_type = 'error') e ASOF JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts < p.ts"),
    **schema_queries.QUERIES,
    **statement_queries.QUERIES,
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: _dialect(t if isinstance(t, str) else t[0]) for n, t in SQL.items()} | {n: f for n, (f, _) in CODE.items()}
ORACLE_SQL: dict[str, str] = {n: t if isinstance(t, str) else t[1] for n, t in SQL.items() if isinstance(t, str) or t[1]} | {n: q for n, (_, q) in CODE.items() if q}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["flagship"](spark, sf_dir)
