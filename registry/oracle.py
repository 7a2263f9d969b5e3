"""SQL twins of the registered queries, for DuckDB over the same tables."""

from __future__ import annotations

from collections.abc import Mapping

from registry.fixtures import TREE_MODEL


def r(expression: str, digits: int) -> str:
    """Round half-even."""
    scale = 10**digits
    return f"round_even(({expression}) * {scale}, 0) / {scale}"


def tidy(expression: str) -> str:
    """A double rounded to six decimals off the ties, as the queries do."""
    return r(f"{expression} + CAST(1.37e-8 AS DOUBLE)", 6)


def out(**columns: str) -> str:
    """Select list of tidied doubles."""
    return ", ".join(f"{tidy(expression)} AS {name}" for name, expression in columns.items())


def doubles(*names: str) -> str:
    return out(**{name: name for name in names})


LINE_TX = """
  SELECT o_custkey AS ctc_id, CAST(o_orderdate AS DATE) AS order_date, o_orderpriority AS source,
         n_name AS location, l_linenumber,
         CASE WHEN l_returnflag = 'R' THEN -floor(l_extendedprice) ELSE floor(l_extendedprice) END AS value
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
"""
ORDER_TX = """
  SELECT o_custkey AS ctc_id, CAST(o_orderdate AS DATE) AS order_date, o_orderpriority AS source,
         n_name AS location, floor(o_totalprice) AS value
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
"""

CALENDAR = """CAST(month({0}) AS BIGINT) AS month, CAST(year({0}) AS BIGINT) AS year,
  CAST(isodow({0}) - 1 AS BIGINT) AS day_of_week, CAST(dayofyear({0}) AS BIGINT) AS day_of_year"""
CALENDAR_NAMES = "month, year, day_of_week, day_of_year"

FORECAST_LABEL = r(
    "CAST(1000 AS DOUBLE) + CAST(10 AS DOUBLE) * month + CAST(0.5 AS DOUBLE) * year"
    " + CAST(25 AS DOUBLE) * day_of_week + CAST(1.5 AS DOUBLE) * day_of_year",
    4,
)
CLV_LABEL = r(
    "CAST(5 AS DOUBLE) + CAST(12 AS DOUBLE) * no_visit + CAST(0.513711 AS DOUBLE) * value"
    " + CAST(0.01 AS DOUBLE) * customer_age + CAST(0.02 AS DOUBLE) * recency"
    " + CAST(-0.03 AS DOUBLE) * days_since_last_visit",
    4,
)


# Sums of rounded values are taken in decimals: exact, so row order cannot tip a rounding tie.
MEAN_FREQUENCY = "CAST(sum(CAST(frequency AS DECIMAL(28,3))) AS DOUBLE) / count(*)"


def rfm(source: str, as_of: str) -> str:
    return f"""
  SELECT ctc_id, location, count(*) AS no_visit, avg(value) AS value,
         CAST({as_of} - min(order_date) AS BIGINT) AS customer_age,
         CAST(max(order_date) - min(order_date) AS BIGINT) AS recency,
         CAST({as_of} - max(order_date) AS BIGINT) AS days_since_last_visit
  FROM (SELECT DISTINCT ctc_id, order_date, location, value FROM {source}
        WHERE ctc_id IS NOT NULL AND order_date IS NOT NULL AND location IS NOT NULL AND value IS NOT NULL)
  GROUP BY ctc_id, location
"""


def distinct(columns: str, source: str = "tx") -> str:
    present = " AND ".join(f"{c.strip()} IS NOT NULL" for c in columns.split(","))
    return f"SELECT DISTINCT {columns} FROM {source} WHERE {present}"


ALL = "ctc_id, order_date, source, location, value"
NO_SOURCE = "ctc_id, order_date, location, value"
NO_SOURCE_NO_LOCATION = "ctc_id, order_date, value"


def running(source: str, metric: str) -> str:
    return f"""
  SELECT CAST(row_number() OVER (ORDER BY year, day_of_year) AS BIGINT) AS days, year, day_of_year,
         {r(f'sum({metric}) OVER (ORDER BY year, day_of_year ROWS UNBOUNDED PRECEDING)', 2)} AS {metric}
  FROM (SELECT year, day_of_year, sum({metric}) AS {metric} FROM {source} GROUP BY year, day_of_year)
"""


def overview(group: str, condition: str) -> str:
    infix = "" if group == "all" else f"{group}_"
    count = "total_customer" if group == "all" else f"no_{group}_cus"
    total = "sum(total_transaction)"
    return f"""
  SELECT location, avg(clv_3m) AS avg_{infix}clv_3m, avg(value) AS avg_{infix}transaction,
         {r(total, 3) if group == "all" else total} AS total_{infix}transaction, count(*) AS {count}
  FROM clv WHERE {condition} GROUP BY location
"""


def overview_names(group: str) -> list[str]:
    infix = "" if group == "all" else f"{group}_"
    return [f"avg_{infix}clv_3m", f"avg_{infix}transaction", f"total_{infix}transaction"]


def segment(source: str) -> str:
    return f"""
  SELECT location, avg(clv_3m) AS clv, avg(value) AS aov, {r('sum(total_transaction)', 3)} AS revenue,
         count(*) AS users, {r(MEAN_FREQUENCY, 3)} AS frequency
  FROM {source} GROUP BY location
"""


def ranked(order: str) -> str:
    return f"""
  SELECT ctc_id, total_transaction FROM (
    SELECT *, row_number() OVER (ORDER BY total_transaction {order}, ctc_id) AS place FROM totals)
  WHERE place <= (SELECT CAST(round_even(count(*) * 0.25, 0) AS BIGINT) FROM clv)
"""


def summary_group(group: str, source: str) -> str:
    orders = "CAST(sum(no_visit) AS BIGINT) AS total_no_orders," if group == "all" else ""
    users = "total_users" if group == "all" else f"{group}_users"
    return f"""
  SELECT period, location, {orders} avg(clv_3m) AS avg_clv_{group}, avg(value) AS avg_revenue_{group},
         {r('sum(total_transaction)', 3)} AS total_revenue_{group}, count(*) AS {users}
  FROM {source} GROUP BY period, location
"""


def summaries(tagged: str, tail: str) -> dict[str, str]:
    """The summary tables over ``tagged``, with ``tail`` appended to their names."""
    return {
        f"limits{tail}": f"""
  SELECT period, {r(MEAN_FREQUENCY, 3)} AS churn_frequency FROM {tagged}
  WHERE no_visit > 1 GROUP BY period""",
        f"all{tail}": summary_group("all", tagged),
        f"repeat{tail}": summary_group("repeat", f"(SELECT * FROM {tagged} WHERE no_visit >= 2)"),
        f"new{tail}": summary_group("new", f"(SELECT * FROM {tagged} WHERE no_visit = 1)"),
        f"churn{tail}": summary_group(
            "churn",
            f"""(SELECT t.* FROM {tagged} t JOIN limits{tail} l ON t.period = l.period
                 WHERE no_visit > 1 AND days_since_last_visit > 3 * churn_frequency)""",
        ),
        f"executive{tail}": f"""
  SELECT period, location, total_no_orders, avg_revenue_all, avg_clv_all, total_revenue_all,
         total_users - churn_users AS total_users, repeat_users, new_users, churn_users
  FROM all{tail} JOIN repeat{tail} USING (period, location) JOIN new{tail} USING (period, location)
  JOIN churn{tail} USING (period, location)""",
    }


def tagged(current: str, previous: str) -> str:
    return f"""
  SELECT 'current' AS period, * FROM first_visit WHERE {current}
  UNION ALL SELECT 'previous', * FROM first_visit WHERE {previous}
"""


YEAR = tagged("year = 1997", "year = 1996")
MONTH = tagged("year = 1997 AND month = 1", "year = 1996 AND month = 12")
RANGE = tagged(
    "order_date BETWEEN DATE '1997-03-01' AND DATE '1997-08-31'",
    "order_date BETWEEN DATE '1996-03-01' AND DATE '1996-08-31'",
)
OPEN_RANGE = tagged("order_date >= DATE '2000-01-01'", "order_date >= DATE '1999-01-01'")

EVERYTHING = tagged("true", "true")


def views(tx: str) -> dict[str, str]:
    """Named subqueries over one fixture, in dependency order."""
    return {
        "tx": tx,
        "tx_copies": f"""
  SELECT {ALL} FROM tx UNION ALL SELECT {ALL} FROM tx WHERE l_linenumber = 1
  UNION ALL SELECT ctc_id, order_date, 'COPY', location, value FROM tx WHERE l_linenumber = 1"""
        if "l_linenumber" in tx
        else "SELECT 1",
        "contacts": """
  SELECT c_custkey AS ctc_id,
         CASE WHEN c_acctbal < 0 THEN NULL WHEN c_custkey % 7 = 0 THEN '18-24'
              WHEN c_custkey % 7 = 1 THEN '25-34' WHEN c_custkey % 7 = 2 THEN '35-44'
              WHEN c_custkey % 7 = 3 THEN '45-54' WHEN c_custkey % 7 = 4 THEN '55-64'
              WHEN c_custkey % 7 = 5 THEN '65-74' ELSE '75+' END AS age_category
  FROM customer""",
        "clean_contacts": distinct("ctc_id, age_category", "contacts"),
        "geo": f"""
  SELECT n_name AS location, {r("50 + n_nationkey * CAST(0.12345 AS DOUBLE)", 3)} AS latitude,
         {r("-3 + n_nationkey * CAST(0.23456 AS DOUBLE)", 3)} AS longitude FROM nation""",
        "as_of": "SELECT max(order_date) AS as_of FROM tx",
        "daily": f"""
  SELECT value, {CALENDAR.format("order_date")} FROM (
    SELECT order_date, sum(value) AS value FROM ({distinct(NO_SOURCE_NO_LOCATION)})
    WHERE order_date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31' AND value > 0 GROUP BY order_date)""",
        "span": f"""
  SELECT {CALENDAR.format("day")} FROM (
    SELECT CAST(unnest(generate_series(CAST(min(o_orderdate) AS DATE),
           CAST(max(o_orderdate) AS DATE) + 30, INTERVAL 1 DAY)) AS DATE) AS day FROM orders)""",
        "span_scored": f"SELECT *, {FORECAST_LABEL} AS label FROM span",
        "forecast": f"""
  SELECT *, {FORECAST_LABEL} AS label FROM (
    SELECT {CALENDAR.format("day")} FROM (
      SELECT CAST(unnest(generate_series(DATE '1997-01-01', DATE '1998-01-30', INTERVAL 1 DAY)) AS DATE) AS day))""",
        "actual_totals": running("daily", "value"),
        "forecast_totals": running("forecast", "label"),
        "span_totals": running("span_scored", "label"),
        "rfm": rfm("tx", "(SELECT as_of FROM as_of)"),
        "clv": f"""
  SELECT *, {CLV_LABEL} AS clv_3m, value AS total_transaction,
         {r("recency / CAST(no_visit AS DOUBLE)", 3)} AS frequency FROM rfm""",
        "overview_all": overview("all", "true"),
        "overview_loyal": overview("loyal", "no_visit >= 3"),
        "overview_new": overview("new", "no_visit = 1"),
        "overview_repeat": overview("repeat", "no_visit > 1"),
        "location_overview": f"""
  SELECT *, {r("no_loyal_cus / CAST(total_customer AS DOUBLE)", 3)} * 100 AS loyal_cus_percent
  FROM overview_all JOIN overview_loyal USING (location) JOIN overview_new USING (location)
  JOIN overview_repeat USING (location)""",
        "location_geo": "SELECT * FROM location_overview JOIN geo USING (location)",
        "visits": f"""
  SELECT ctc_id, location, order_date, source, sum(value) AS value FROM ({distinct(ALL)})
  GROUP BY ctc_id, location, order_date, source""",
        "visits_age": """
  SELECT v.*, coalesce(age_category, 'Unknown') AS age_category
  FROM visits v LEFT JOIN clean_contacts c ON v.ctc_id = c.ctc_id""",
        "age_revenue": f"""
  SELECT age_category, location, count(*) AS total_cus, {r("sum(value)", 3)} AS age_cat_total_transaction
  FROM visits_age GROUP BY age_category, location""",
        "age_share": f"""
  SELECT a.*, {r("age_cat_total_transaction / location_total", 3)} * 100 AS age_cat_revenue_per
  FROM age_revenue a LEFT JOIN (SELECT location, sum(age_cat_total_transaction) AS location_total
                                FROM age_revenue GROUP BY location) t ON a.location = t.location""",
        "age_clv": """
  SELECT coalesce(age_category, 'Unknown') AS age_category, location, count(*) AS total_clv_cus,
         CAST(sum(CAST(clv_3m AS DECIMAL(28,4))) AS DOUBLE) AS clv_3m, avg(clv_3m) AS avg_clv_3m, median(clv_3m) AS median_clv_3m,
         min(clv_3m) AS min_clv_3m, max(clv_3m) AS max_clv_3m, stddev_samp(clv_3m) AS std_clv_3m
  FROM clv LEFT JOIN clean_contacts c ON clv.ctc_id = c.ctc_id
  GROUP BY coalesce(age_category, 'Unknown'), location""",
        "age_analytics": f"""
  SELECT age_category, location, total_cus, age_cat_total_transaction, age_cat_revenue_per,
         total_clv_cus, {r("clv_3m", 2)} AS clv_3m, avg_clv_3m, median_clv_3m, min_clv_3m, max_clv_3m,
         std_clv_3m
  FROM age_share JOIN age_clv USING (age_category, location)""",
        "daily_location": f"""
  SELECT location, total_cus, value, {CALENDAR.format("order_date")} FROM (
    SELECT order_date, location, count(*) AS total_cus, {r("avg(value)", 3)} AS value
    FROM ({distinct(ALL)}) GROUP BY order_date, location)""",
        "weekday": """
  SELECT day_of_week, location, CAST(sum(total_cus) AS BIGINT) AS total_cus, avg(value) AS value
  FROM daily_location GROUP BY day_of_week, location""",
        "churn_threshold": f"""
  SELECT {r(MEAN_FREQUENCY, 3)} AS churn_frequency FROM clv WHERE no_visit > 1""",
        "totals": """
  SELECT ctc_id, sum(total_transaction) AS total_transaction FROM clv GROUP BY ctc_id""",
        "top_ids": ranked("DESC"),
        "low_ids": ranked("ASC"),
        "seg_all": segment("clv"),
        "seg_loyal": segment("(SELECT * FROM clv WHERE no_visit >= 3)"),
        "seg_repeat": segment("(SELECT * FROM clv WHERE no_visit >= 2)"),
        "seg_top": segment("(SELECT * FROM clv WHERE ctc_id IN (SELECT ctc_id FROM top_ids))"),
        "seg_low": segment("(SELECT * FROM clv WHERE ctc_id IN (SELECT ctc_id FROM low_ids))"),
        "seg_risk": segment("(SELECT * FROM clv WHERE days_since_last_visit > 2 * frequency)"),
        "seg_churn": segment(
            """(SELECT * FROM clv WHERE no_visit > 1
                AND days_since_last_visit > 3 * (SELECT churn_frequency FROM churn_threshold))"""
        ),
        "segments": " UNION ALL ".join(
            f"SELECT '{name}' AS segment, * FROM seg_{name}"
            for name in ("all", "loyal", "repeat", "top", "low", "risk", "churn")
        ),
        "first_visit": f"""
  SELECT *, {CALENDAR.format("order_date")} FROM (
    SELECT *, CAST((SELECT as_of FROM as_of) - CAST(customer_age AS INTEGER) AS DATE) AS order_date FROM clv)""",
        "tagged_year": YEAR,
        "tagged_month": MONTH,
        "tagged_range": RANGE,
        "tagged_open": OPEN_RANGE,
        "tagged_everything": EVERYTHING,
        **summaries("tagged_year", "_y"),
        **summaries("tagged_month", "_m"),
        **summaries("tagged_range", "_r"),
        **summaries("tagged_open", "_o"),
        **summaries("tagged_everything", "_e"),
        "period_nodes": """
  SELECT *, day >> level AS slot FROM (
    SELECT *, date_diff('day', DATE '0001-01-01', order_date) AS day,
           CAST(unnest(range((SELECT CASE WHEN x = 0 THEN 1 ELSE length(bin(x)) + 1 END FROM (
             SELECT xor(min(date_diff('day', DATE '0001-01-01', order_date)),
                        max(date_diff('day', DATE '0001-01-01', order_date))) AS x FROM first_visit)))) AS INTEGER)
             AS level FROM first_visit)""",
        "period_totals": """
  SELECT location, level, slot, count(*) AS users, CAST(sum(no_visit) AS BIGINT) AS orders, sum(clv_3m) AS clv_3m,
         sum(value) AS value, sum(total_transaction) AS total_transaction,
         count(*) FILTER (no_visit >= 2) AS repeat_users, count(*) FILTER (no_visit = 1) AS new_users,
         count(*) FILTER (no_visit > 1) AS came_back,
         sum(CAST(frequency AS DECIMAL(28,3))) FILTER (no_visit > 1) AS frequency
  FROM period_nodes GROUP BY location, level, slot""",
        "period_idle": """
  SELECT location, level, slot, idle,
         CAST(sum(n) OVER (PARTITION BY location, level, slot ORDER BY idle DESC) AS BIGINT) AS at_least
  FROM (SELECT location, level, slot, days_since_last_visit AS idle, count(*) AS n FROM period_nodes
        WHERE no_visit > 1 GROUP BY ALL)""",
        "compared": """
  SELECT c.location, """
        + ", ".join(
            f"{side}.{source} AS {name}_{tail}"
            for side, tail in (("c", "selected"), ("p", "prev"))
            for name, source in {
                "customers": "total_users",
                "orders": "total_no_orders",
                "revenue": "total_revenue_all",
                "aov": "avg_revenue_all",
                "new_customers": "new_users",
                "repeat_customers": "repeat_users",
                "churn_customers": "churn_users",
                "aclv_customers": "avg_clv_all",
            }.items()
        )
        + """
  FROM (SELECT * FROM executive_y WHERE period = 'current') c
  LEFT JOIN (SELECT * FROM executive_y WHERE period = 'previous') p ON c.location = p.location""",
    }


def with_views(named: Mapping[str, str], select: str) -> str:
    body = ",\n".join(f"{name} AS ({sql})" for name, sql in named.items())
    return f"WITH {body}\n{select}"


LINE = views(LINE_TX)
ORDER = views(ORDER_TX)


def on_lines(select: str) -> str:
    return with_views(LINE, select)


def on_orders(select: str) -> str:
    return with_views(ORDER, select)


CLV_DOUBLES = doubles("value", "clv_3m", "total_transaction", "frequency")
RFM_KEYS = "ctc_id, location, no_visit, customer_age, recency, days_since_last_visit"
SEGMENT_DOUBLES = doubles("clv", "aov", "revenue", "frequency")
SUMMARY_DOUBLES = doubles("avg_revenue_all", "avg_clv_all", "total_revenue_all")
COMPARED_DOUBLES = doubles(
    *[f"{name}_{tail}" for name in ("revenue", "aov", "aclv_customers") for tail in ("selected", "prev")]
)
COMPARED_COUNTS = ", ".join(
    f"{name}_{tail}"
    for name in ("customers", "orders", "new_customers", "repeat_customers", "churn_customers")
    for tail in ("selected", "prev")
)


def overview_query(group: str) -> str:
    count = "total_customer" if group == "all" else f"no_{group}_cus"
    return on_lines(f"SELECT location, {count}, {doubles(*overview_names(group))} FROM overview_{group}")


OVERVIEW_COUNTS = "location, total_customer, no_loyal_cus, no_new_cus, no_repeat_cus"
OVERVIEW_DOUBLES = doubles(
    *[n for group in ("all", "loyal", "new", "repeat") for n in overview_names(group)],
    "loyal_cus_percent",
)


def segment_query(name: str, prefix: str, on=on_lines) -> str:
    rounded = out(**{f"{prefix}_{m}": m for m in ("clv", "aov", "revenue", "frequency")})
    return on(f"SELECT location, users AS {prefix}_users, {rounded} FROM seg_{name}")


def period_query(view: str) -> str:
    return on_lines(
        f"SELECT period AS which, ctc_id, location, order_date, {doubles('clv_3m')} FROM {view}"
    )


def summary_query(group: str) -> str:
    users = "total_no_orders, total_users" if group == "all" else f"{group}_users"
    names = [f"avg_clv_{group}", f"avg_revenue_{group}", f"total_revenue_{group}"]
    return on_lines(f"SELECT period, location, {users}, {doubles(*names)} FROM {group}_y")


EXECUTIVE = (
    f"SELECT period, location, total_no_orders, {SUMMARY_DOUBLES}, total_users, repeat_users,"
    " new_users, churn_users FROM executive"
)
PLACE = "'NATION_3'"


AGE_DOUBLES = doubles(
    "age_cat_total_transaction", "age_cat_revenue_per", "clv_3m", "avg_clv_3m", "median_clv_3m",
    "min_clv_3m", "max_clv_3m", "std_clv_3m",
)

PUBLISHED = {
    "as_of": "as_of",
    "clv": "clv",
    "actual_totals": "actual_totals",
    "forecast_totals": "forecast_totals",
    "location_overview": "location_geo",
    "age_analytics": "age_analytics",
    "weekday_revenue": "weekday",
    "segments": "segments",
    "first_visit": "first_visit",
    "period_totals": "period_totals",
    "period_idle": "period_idle",
    "locations": "(SELECT DISTINCT location FROM tx)",
}


PUBLISHED_NUMBERS = {
    "clv": "ctc_id no_visit value customer_age recency days_since_last_visit clv_3m total_transaction frequency",
    "actual_totals": "days year day_of_year value",
    "forecast_totals": "days year day_of_year label",
    "location_overview": "total_customer no_loyal_cus no_new_cus no_repeat_cus loyal_cus_percent latitude longitude "
    + " ".join(n for group in ("all", "loyal", "new", "repeat") for n in overview_names(group)),
    "age_analytics": "total_cus age_cat_total_transaction age_cat_revenue_per total_clv_cus clv_3m avg_clv_3m"
    " median_clv_3m min_clv_3m max_clv_3m std_clv_3m",
    "weekday_revenue": "day_of_week total_cus value",
    "segments": "clv aov revenue users frequency",
    "first_visit": "ctc_id no_visit value customer_age recency days_since_last_visit clv_3m total_transaction"
    " frequency month year day_of_week day_of_year",
    "period_totals": "level slot users orders clv_3m value total_transaction repeat_users new_users came_back frequency",
    "period_idle": "level slot idle at_least",
}
COUNTS = set(
    "ctc_id no_visit customer_age recency days_since_last_visit days year day_of_year total_customer no_loyal_cus"
    " no_new_cus no_repeat_cus total_cus total_clv_cus day_of_week users month level slot orders repeat_users new_users"
    " came_back idle at_least".split()
)


def publish_query() -> str:
    """Rows of each published table, and the sum of each number in it."""
    rows = []
    for name, view in PUBLISHED.items():
        rows.append(
            f"SELECT '{name}' AS table_name, count(*) AS table_rows, '' AS column_name,"
            f" CAST(NULL AS DOUBLE) AS total FROM {view}"
        )
        for column in PUBLISHED_NUMBERS.get(name, "").split():
            value = column if column in COUNTS else tidy(column)
            total = tidy(f"CAST(sum(CAST({value} AS DECIMAL(28,6))) AS DOUBLE)")
            rows.append(f"SELECT '{name}', count(*), '{column}', {total} FROM {view}")
    return on_lines(" UNION ALL ".join(rows))


def text(expression: str, exact: bool = False) -> str:
    """A number as text: a count as it is, another one to six decimals."""
    if exact:
        return f"CAST({expression} AS VARCHAR)"
    return f"CAST(CAST({tidy(expression)} AS DECIMAL(28,6)) AS VARCHAR)"


def listed(field: str, value: str, view: str, order: str) -> str:
    """One row per element of an array field."""
    place = f"CAST(row_number() OVER (ORDER BY {order}) - 1 AS BIGINT)"
    return f"SELECT '{field}' AS field, {place} AS place, {value} AS value FROM {view}"


def single(field: str, value: str, view: str) -> str:
    """One row with a single value, null if the view has no row."""
    return f"SELECT '{field}' AS field, CAST(-1 AS BIGINT) AS place, (SELECT {value} FROM {view}) AS value"


def fields(prefix: str, columns: Mapping[str, str], view: str, order: str, exact: str) -> list[str]:
    """Array fields, name to column; the columns in ``exact`` are texts or counts."""
    return [
        listed(f"{prefix}{name}", text(column, column in exact.split()), view, order)
        for name, column in columns.items()
    ]


MAP_FIELDS = {
    "loc_total_transaction": "total_transaction",
    "loc_avg_clv": "avg_clv_3m",
    "loc_avg_loyal_clv": "avg_loyal_clv_3m",
    "loc_loyal_cus_percentage": "loyal_cus_percent",
    "no_new_cus": "no_new_cus",
    "no_repeat_cus": "no_repeat_cus",
    "tot_repeat_transaction": "total_repeat_transaction",
    "latitude": "latitude",
    "longitude": "longitude",
    "map_location": "location",
}


def map_fields(prefix: str = "") -> list[str]:
    return fields(prefix, MAP_FIELDS, "location_geo", "location", "no_new_cus no_repeat_cus location")


def age_fields() -> list[str]:
    here = f"age_analytics WHERE location = {PLACE} AND age_category"
    known = {
        "age_category": "age_category",
        "age_category_rev_percentage": "age_cat_revenue_per",
        "avg_clv": "avg_clv_3m",
        "no_cus_age_group": "total_cus",
        "val_of_revenue": "age_cat_total_transaction",
    }
    unknown = {
        "analytics_graph_unknown": "age_cat_revenue_per",
        "unknown_avg_clv": "avg_clv_3m",
        "unknown_tot_cus": "total_cus",
        "unknown_val_of_rev": "age_cat_total_transaction",
    }
    return fields("analytics_graph.", known, f"{here} <> 'Unknown'", "age_category", "age_category total_cus") + [
        single(name, text(column, column == "total_cus"), f"{here} = 'Unknown'") for name, column in unknown.items()
    ]


def weekday_fields() -> list[str]:
    columns = {"day_of_day_of_week": "day_of_week", "transaction_value": "value"}
    return fields("revenue_graph.", columns, f"weekday WHERE location = {PLACE}", "day_of_week", "day_of_week")


def segment_fields(form) -> list[str]:
    return [
        form(f"{name}_cus_clv.{metric}", text(metric, metric == "users"), f"seg_{name} WHERE location = {PLACE}")
        for name in ("all", "loyal", "repeat", "top", "low", "risk", "churn")
        for metric in ("users", "frequency", "aov", "clv", "revenue")
    ]


def summary_fields() -> list[str]:
    names = (
        "customers orders revenue aov new_customers repeat_customers churn_customers aclv_customers".split()
    )
    rows = []
    for name in [f"{n}_{side}" for side in ("prev", "selected") for n in names]:
        value = f"(SELECT {text(f'CAST({name} AS DOUBLE)')} FROM compared WHERE location = {PLACE})"
        rows.append(
            f"SELECT 'executive_summary.{name}' AS field, CAST(-1 AS BIGINT) AS place, coalesce({value}, '-') AS value"
        )
    return rows


def graph_fields() -> list[str]:
    predicted = {"prediction_val": "label", "day_of_year": "days"}
    return [
        *fields("prediction_graph.", {"transaction_val": "value"}, "actual_totals", "days", ""),
        *fields("prediction_graph.", predicted, "forecast_totals", "days", "days"),
        *map_fields("prediction_graph."),
    ]


def document_query(rows: list[str], on=None) -> str:
    return (on or on_lines)(" UNION ALL ".join(f"SELECT * FROM ({row})" for row in rows))


DASHBOARD = [*graph_fields(), *segment_fields(single), *age_fields(), *weekday_fields(), *summary_fields()]


def least_squares(train: str, target: str, names: list[str], score: str) -> dict[str, str]:
    """Views of a regression: ``predicted`` holds ``score`` with ``prediction``.

    Each feature is freed of the ones before it by simple regressions (``z`` columns). Freed features
    are uncorrelated, so the target's slopes on them are simple regressions as well.
    """
    out, rows = {}, train
    for j, name in enumerate(names):
        slopes = "".join(f", regr_slope({name}, z{i}) AS b{j}_{i}" for i in range(j))
        out[f"fit{j}"] = f"SELECT avg({name}) AS a{j}{slopes} FROM {rows}"
        freed = f"{name} - a{j}" + "".join(f" - b{j}_{i} * z{i}" for i in range(j))
        out[f"train{j}"] = f"SELECT r.*, {freed} AS z{j} FROM {rows} r, fit{j}"
        out[f"score{j}"] = f"SELECT r.*, {freed} AS z{j} FROM {score if j == 0 else f'score{j - 1}'} r, fit{j}"
        rows = f"train{j}"
    last = len(names) - 1
    slopes = ", ".join(f"regr_slope({target}, z{j}) AS slope{j}" for j in range(len(names)))
    out["slopes"] = f"SELECT avg({target}) AS level, {slopes} FROM {rows}"
    terms = " + ".join(f"slope{j} * z{j}" for j in range(len(names)))
    out["predicted"] = f"SELECT *, level + {terms} AS prediction FROM score{last}, slopes"
    return out


def coarse(expression: str, digits: int) -> str:
    """A prediction rounded to four decimals, then off the ties to fewer."""
    return tidy(r(f"{r(expression, 4)} + CAST(1.37e-8 AS DOUBLE)", digits))


CUTOFF = "((SELECT as_of FROM as_of) - 90)"
TRAINING = f"""
SELECT {RFM_KEYS}, {doubles("value")}, {tidy("coalesce(target, 0)")} AS target
FROM ({rfm(f"(SELECT * FROM tx WHERE order_date <= {CUTOFF})", CUTOFF)}) f
LEFT JOIN (SELECT ctc_id, location, sum(value) AS target FROM ({distinct(NO_SOURCE)})
           WHERE order_date > {CUTOFF} AND order_date <= {CUTOFF} + 90 GROUP BY ctc_id, location) s
USING (ctc_id, location)
"""

ORACLE: dict[str, str] = {
    "contacts_clean": on_lines("SELECT * FROM clean_contacts"),
    "transactions_typed": on_lines(f"SELECT ctc_id, order_date, source, location, {doubles('value')} FROM tx"),
    "transactions_from_csv": on_lines(f"SELECT ctc_id, order_date, source, location, {doubles('value')} FROM tx"),
    "contacts_from_csv": on_lines("""
SELECT c_custkey AS ctc_id, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS post_code,
       CAST(18 + c_custkey % 60 AS INTEGER) AS age, CAST(NULL AS DATE) AS birth_date, age_category
FROM customer JOIN contacts ON c_custkey = ctc_id"""),
    "as_of_date": on_lines("SELECT * FROM as_of"),
    "tx_distinct_full": on_lines(distinct(ALL, "tx_copies")),
    "tx_distinct_loc": on_lines(distinct(NO_SOURCE, "tx_copies")),
    "tx_distinct_daily": on_lines(distinct(NO_SOURCE_NO_LOCATION, "tx_copies")),
    "tx_distinct_nested": on_lines(f"""
SELECT 'full' AS name, {ALL} FROM ({distinct(ALL, "tx_copies")})
UNION ALL SELECT 'loc', ctc_id, order_date, NULL, location, value FROM ({distinct(NO_SOURCE, "tx_copies")})
UNION ALL SELECT 'daily', ctc_id, order_date, NULL, NULL, value FROM ({distinct(NO_SOURCE_NO_LOCATION, "tx_copies")})"""),
    "daily_revenue": on_lines("SELECT * FROM daily"),
    "calendar_features": f"""
SELECT o_orderkey, order_date, {CALENDAR.format("order_date")}
FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS order_date FROM orders)""",
    "forecast_calendar": on_lines("SELECT * FROM span"),
    "forecast_scored": on_lines(f"SELECT {CALENDAR_NAMES}, {doubles('label')} FROM span_scored"),
    "actual_forecast_union": on_lines(f"""
SELECT {doubles("value")}, {CALENDAR_NAMES}, CAST(NULL AS DOUBLE) AS label FROM daily
UNION ALL SELECT CAST(NULL AS DOUBLE), {CALENDAR_NAMES}, {tidy("label")} FROM forecast"""),
    "cumulative_revenue": on_lines(f"SELECT days, year, day_of_year, {doubles('value')} FROM actual_totals"),
    "cumulative_forecast": on_lines(f"SELECT days, year, day_of_year, {doubles('label')} FROM span_totals"),
    "cumulative_self_join": on_lines(f"""
SELECT CAST(row_number() OVER (ORDER BY year, day_of_year) AS BIGINT) AS days, x.days AS days_x, year,
       day_of_year, {tidy("x.value")} AS value_x, y.days AS days_y, {tidy("y.value")} AS value_y
FROM actual_totals x JOIN actual_totals y USING (year, day_of_year)"""),
    "forecast_report": on_lines(f"""
SELECT days, {tidy("label")} AS prediction_val, {tidy("value")} AS transaction_val
FROM forecast_totals f FULL JOIN actual_totals a USING (days)"""),
    "rfm_in_two_parts": on_lines(f"SELECT {RFM_KEYS}, {doubles('value')} FROM rfm"),
    "rfm_features": on_lines(f"SELECT {RFM_KEYS}, {doubles('value')} FROM rfm"),
    "clv_scored": on_lines(f"SELECT {RFM_KEYS}, {CLV_DOUBLES} FROM clv"),
    "overview_all": overview_query("all"),
    "overview_loyal": overview_query("loyal"),
    "overview_new": overview_query("new"),
    "overview_repeat": overview_query("repeat"),
    "location_overview": on_lines(f"SELECT {OVERVIEW_COUNTS}, {OVERVIEW_DOUBLES} FROM location_overview"),
    "location_overview_orders": on_orders(
        f"SELECT {OVERVIEW_COUNTS}, {OVERVIEW_DOUBLES} FROM location_overview"
    ),
    "location_geo": on_lines(f"""
SELECT {OVERVIEW_COUNTS}, {OVERVIEW_DOUBLES}, {doubles("latitude", "longitude")} FROM location_geo"""),
    "locations": on_lines("SELECT DISTINCT location FROM tx"),
    "visits": with_views(
        {**LINE, "found": f"""
  SELECT ctc_id, location, order_date, source, sum(value) AS value
  FROM ({distinct(ALL, "tx_copies")}) GROUP BY ctc_id, location, order_date, source"""},
        f"SELECT ctc_id, location, order_date, source, {doubles('value')} FROM found",
    ),
    "visits_with_age": on_lines(
        f"SELECT ctc_id, location, order_date, source, age_category, {doubles('value')} FROM visits_age"
    ),
    "age_revenue": on_lines(f"""
SELECT age_category, location, total_cus, {doubles("age_cat_total_transaction")} FROM age_revenue"""),
    "age_revenue_share": on_lines(f"""
SELECT age_category, location, total_cus, {doubles("age_cat_total_transaction", "age_cat_revenue_per")}
FROM age_share"""),
    "age_clv_stats": on_lines(f"""
SELECT age_category, location, total_clv_cus, {doubles("clv_3m", "avg_clv_3m", "median_clv_3m",
"min_clv_3m", "max_clv_3m", "std_clv_3m")} FROM age_clv"""),
    "age_analytics": on_lines(
        f"SELECT age_category, location, total_cus, total_clv_cus, {AGE_DOUBLES} FROM age_analytics"
    ),
    "age_for_location": on_lines(f"""
SELECT age_category, age_category = 'Unknown' AS is_unknown, total_cus,
       {doubles("age_cat_revenue_per", "avg_clv_3m", "age_cat_total_transaction")}
FROM age_analytics WHERE location = {PLACE}"""),
    "daily_location_revenue": on_lines(
        f"SELECT location, total_cus, {doubles('value')}, {CALENDAR_NAMES} FROM daily_location"
    ),
    "weekday_revenue": on_lines(f"SELECT day_of_week, location, total_cus, {doubles('value')} FROM weekday"),
    "weekday_for_location": on_lines(
        f"SELECT day_of_week, {doubles('value')} FROM weekday WHERE location = {PLACE}"
    ),
    "segment_all": segment_query("all", "cus"),
    "segment_loyal": segment_query("loyal", "loyal"),
    "segment_repeat": segment_query("repeat", "repeat"),
    "top_customers": on_orders(f"SELECT ctc_id, {doubles('total_transaction')} FROM top_ids"),
    "segment_top": segment_query("top", "top", on_orders),
    "low_customers": on_orders(f"SELECT ctc_id, {doubles('total_transaction')} FROM low_ids"),
    "segment_low": segment_query("low", "low", on_orders),
    "segment_risk": segment_query("risk", "risk"),
    "churn_threshold": on_lines(f"SELECT {doubles('churn_frequency')} FROM churn_threshold"),
    "segment_churn": segment_query("churn", "churn"),
    "segments_long": on_lines(f"SELECT segment, location, users, {SEGMENT_DOUBLES} FROM segments"),
    "segments_long_orders": on_orders(f"SELECT segment, location, users, {SEGMENT_DOUBLES} FROM segments"),
    "segments_for_location": on_orders(f"""
SELECT n.segment, users, {SEGMENT_DOUBLES}
FROM (SELECT unnest(['all', 'loyal', 'repeat', 'top', 'low', 'risk', 'churn']) AS segment) n
LEFT JOIN (SELECT * FROM segments WHERE location = {PLACE}) s ON n.segment = s.segment"""),
    "first_visit": on_lines(f"SELECT {RFM_KEYS}, {CLV_DOUBLES}, order_date, {CALENDAR_NAMES} FROM first_visit"),
    "period_year": period_query("tagged_year"),
    "period_month": period_query("tagged_month"),
    "period_range": period_query("tagged_range"),
    "period_open_range": period_query("tagged_open"),
    "period_tagged": on_lines(
        f"SELECT period, ctc_id, location, order_date, {doubles('clv_3m')} FROM tagged_open"
    ),
    "summary_all": summary_query("all"),
    "summary_repeat": summary_query("repeat"),
    "summary_new": summary_query("new"),
    "summary_churn": summary_query("churn"),
    "executive_summary": on_lines(EXECUTIVE + "_y"),
    "executive_summary_range": on_lines(EXECUTIVE + "_r"),
    "executive_summary_periods": on_lines(
        " UNION ALL ".join(
            f"SELECT '{kind}' AS kind, * FROM ({EXECUTIVE}_{kind[0]})"
            for kind in ("year", "month", "range", "open", "everything")
        )
    ),
    "summary_compare_periods": on_lines(f"SELECT location, {COMPARED_COUNTS}, {COMPARED_DOUBLES} FROM compared"),
    "summary_compare": on_lines(f"SELECT location, {COMPARED_COUNTS}, {COMPARED_DOUBLES} FROM compared"),
    "summary_compare_location": on_lines(f"""
SELECT one.location, {COMPARED_COUNTS}, {COMPARED_DOUBLES}
FROM (SELECT {PLACE} AS location) one LEFT JOIN compared ON one.location = compared.location"""),
    "report_payload": document_query(map_fields()),
    "publish": publish_query(),
    "publish_in_two_parts": publish_query(),
    "dashboard": document_query(DASHBOARD),
    "document_ages": document_query(age_fields()),
    "document_weekdays": document_query(weekday_fields()),
    "document_segments": document_query(
        segment_fields(lambda field, value, view: listed(field, value, view, "location")), on_orders
    ),
    "document_summary": document_query(summary_fields()),
    "document_summary_periods": document_query(summary_fields()),
    "document_locations": document_query(
        [listed("locations", "location", "(SELECT DISTINCT location FROM tx)", "location")]
    ),
    "document_json_roundtrip": document_query(summary_fields()),
    "locations_json_roundtrip": on_lines(
        "SELECT CAST(row_number() OVER (ORDER BY location) - 1 AS INTEGER) AS place, location"
        " FROM (SELECT DISTINCT location FROM tx)"
    ),
    "model_load_scored": on_lines(f"SELECT {RFM_KEYS}, {CLV_DOUBLES} FROM clv"),
    "clv_trees_scored": on_lines(
        f"SELECT {RFM_KEYS}, {doubles('value', 'total_transaction', 'frequency')},"
        f" {tidy(r(TREE_MODEL.sql(), 4))} AS clv_3m FROM clv"
    ),
    "clv_training_set": on_lines(TRAINING),
    "clv_model_fit": with_views(
        {
            **LINE,
            "training": TRAINING,
            **least_squares("training", "target", "no_visit value recency days_since_last_visit".split(), "rfm"),
        },
        f"SELECT ctc_id, location, {coarse('prediction', 1)} AS clv_3m FROM predicted",
    ),
    "forecast_model_fit": with_views(
        {
            **LINE,
            "all_days": f"""
  SELECT value, {CALENDAR.format("order_date")} FROM (
    SELECT order_date, sum(value) AS value FROM ({distinct(NO_SOURCE_NO_LOCATION)})
    WHERE value > 0 GROUP BY order_date)""",
            **least_squares("all_days", "value", "month year day_of_week day_of_year".split(), "span"),
        },
        f"SELECT {CALENDAR_NAMES}, {coarse('prediction', 0)} AS label FROM predicted",
    ),
}
