"""Registered queries: sources (HTML, sheets, sinks, config) and report assembly."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from shelfpulse.checks.oracle_views import several_accounts, with_views
from shelfpulse.checks.q_core import MARKET_SHARE_SQL_CTES
from shelfpulse.checks import q_recs as RQ
from shelfpulse.checks import q_stores  # noqa: F401  (registers statements used below)
from shelfpulse.checks import q_summaries as SQ
from shelfpulse.checks.q_drill import drill_ctes, drivers_sql, frames, inputs
from shelfpulse.checks.registry import L1, L2, ORACLE, register
from shelfpulse.plans import families as FA
from shelfpulse.plans import report as R
from shelfpulse.plans import stores as ST
from shelfpulse.plans import summaries as SU
from shelfpulse.session import checkpoint_dir
from shelfpulse.sources import pages as PG
from shelfpulse.sources import sheets as SH
from shelfpulse.sources import sinks as SK
from shelfpulse.sources.tables import scan_table
from shelfpulse.sources.views import Views

ACCOUNTS_SQL = """
acc AS (SELECT page_id AS id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS primary_email_domain FROM pages),
cfg AS (SELECT user_id AS account_id, props AS config, event_type AS config_type FROM events)"""


def _accounts(spark, sf):
    p = scan_table(spark, sf, "pages")
    return p.select(F.col("page_id").alias("id"),
                    F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("primary_email_domain"))


def _configs(spark, sf):
    e = scan_table(spark, sf, "events")
    return e.select(F.col("user_id").alias("account_id"), F.col("props").alias("config"),
                    F.col("event_type").alias("config_type"))


@register("account_config", "WITH " + ACCOUNTS_SQL.strip() + """
SELECT c.account_id, json_extract_string(c.config, '$.k') AS db_name, a.primary_email_domain,
  split_part(a.primary_email_domain, '.', 1) AS domain,
  upper(substr(split_part(a.primary_email_domain, '.', 1), 1, 1)) || lower(substr(split_part(a.primary_email_domain, '.', 1), 2)) AS brand_name,
  true AS build_blinkit
FROM cfg c LEFT JOIN acc a ON c.account_id = a.id WHERE c.config_type = 'click'""")
def q_account_config(spark, sf):
    return R.account_config(_configs(spark, sf), _accounts(spark, sf), "click", "$.k")


@register("account_options", "WITH " + ACCOUNTS_SQL.strip() + """,
ac AS (SELECT c.account_id, json_extract_string(c.config, '$.k') AS db_name,
         split_part(a.primary_email_domain, '.', 1) AS domain
       FROM cfg c LEFT JOIN acc a ON c.account_id = a.id WHERE c.config_type = 'click')
SELECT DISTINCT domain, db_name FROM ac WHERE domain IN ('m', 'www') AND db_name IS NOT NULL""")
def q_account_options(spark, sf):
    cfg = R.account_config(_configs(spark, sf), _accounts(spark, sf), "click", "$.k")
    return R.account_options(cfg, ["m", "www"])[1]


@register("html_list_items", """
SELECT page_id, CAST(generate_subscripts(items, 1) - 1 AS BIGINT) AS pos,
  trim(regexp_replace(regexp_replace(unnest(items), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS item
FROM (SELECT page_id, regexp_extract_all(html, '(?s)<li[^>]*>(.*?)</li>', 1) AS items FROM pages)""")
def q_html_list_items(spark, sf):
    return PG.extract_list_items(scan_table(spark, sf, "pages"))


def _scratch(spark, name):
    return os.path.join(checkpoint_dir(spark), "sinks", f"{name}-{uuid.uuid4().hex}")


SHEET_CLEAN_SQL = """
SELECT CAST(c_custkey AS VARCHAR) AS custkey,
  CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_mktsegment END AS segment, c_name AS name
FROM customer"""


@register("sheet_clean", SHEET_CLEAN_SQL)
def q_sheet_clean(spark, sf):
    """Customer table round-tripped through a header CSV with blank cells, then cleaned."""
    c = scan_table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias(" custkey "),
        F.when(F.col("c_mktsegment") == "BUILDING", "").otherwise(F.col("c_mktsegment")).alias("segment"),
        F.lit("").alias("always_blank"), F.col("c_name").alias("name"))
    path = _scratch(spark, "sheet")
    c.write.mode("overwrite").option("header", True).csv(path)
    return SH.read_sheet(spark, path)


@register("sink_write_or_append", """
SELECT *, CAST(NULL AS VARCHAR) AS note FROM nation
UNION ALL SELECT *, CAST(NULL AS VARCHAR) AS note FROM nation
UNION ALL SELECT *, 'widened' AS note FROM nation""")
def q_sink_write_or_append(spark, sf):
    """Nation written (create), appended, then widened by region's columns; read back."""
    path = _scratch(spark, "sink")
    n = scan_table(spark, sf, "nation")
    SK.write_or_append(spark, n, path)
    SK.write_or_append(spark, n, path)
    SK.write_or_append(spark, n.withColumn("note", F.lit("widened")), path)
    return SK.read_merged(spark, path)


@register("sink_overwrite", "SELECT * FROM region")
def q_sink_overwrite(spark, sf):
    path = _scratch(spark, "overwrite")
    SK.write_table(scan_table(spark, sf, "region"), path, "overwrite")
    SK.write_table(scan_table(spark, sf, "region"), path, "overwrite")
    return spark.read.parquet(path)


@register("sink_append", "SELECT * FROM region UNION ALL SELECT * FROM region")
def q_sink_append(spark, sf):
    path = _scratch(spark, "append")
    SK.write_table(scan_table(spark, sf, "region"), path, "overwrite")
    SK.write_table(scan_table(spark, sf, "region"), path, "append")
    return spark.read.parquet(path)


# ------------------------------------------------------------------ report
def _report_parts(spark, sf, v=None):
    v = v or Views.shared(spark, sf)
    ms = inputs(v)["ms"]()
    down = frames(spark, sf, "down", v)
    up = frames(spark, sf, "up", v)
    summary = R.offtake_summary(ms, up["drivers"], down["drivers"])
    return summary, down, up


# The report's platforms, in its order (the test mapping's market segments).
PLATFORMS = ("automobile", "building", "furniture", "household", "machinery")
PREFIXES = R.platform_prefixes(PLATFORMS)


def _summary(spark, sf, v):
    offtake = _report_parts(spark, sf, v)[0]
    coverage = ST.new_store_coverage(v.store_catalog(), v.window_slice("store_listing", L1, L2), L1, L2)
    return FA.report_summary(offtake, ST.psl_by(inputs(v)["psl"](), ["account", "gc_platform"]), coverage)


def _summary_markers(summary):
    return R.to_markers(R.on_spine(R.known_platforms(summary, PLATFORMS), PLATFORMS), "1*", [F.col("place")], FA.SUMMARY_FIELDS, len(PLATFORMS))


def _pair(rows, number, fields, order):
    """The two leading rows of an account as one of the families 2*, 3*, 4*, NL_."""
    return R.to_markers(rows, number, order, fields, 2)


def _markers(spark, sf, accounts="single"):
    """All marker families of the report, written once per session."""
    v = Views.shared(spark, sf, accounts)
    return v.materialize(("markers", L1, L2), lambda: _build_markers(spark, sf, v))


def _build_markers(spark, sf, v):
    down, up = (frames(spark, sf, side, v) for side in ("down", "up"))
    i = RQ.Inputs(spark, sf, v)
    keep = lambda key, build: v.materialize(("report", key), build)
    summary = keep("summary", lambda: _summary(spark, sf, v))
    osa, sov, discount = (keep(name, lambda: build(spark, sf, i)) for name, build in (
        ("osa", RQ.osa_recs), ("sov", RQ.sov_recs), ("discount", RQ.discount_recs)))
    rank = down["brand_rows"]
    happened = SQ.happened_rows(spark, sf, v)
    drainers = FA.drainer_rows(RQ.merged_recs(osa, sov), happened, SU.impact_by_city(down["drivers"], down["cities"]))
    gainers = FA.gainer_rows(SQ.gain_rows(spark, sf, v), up["drivers"])
    launches = FA.launch_rows(SQ.registry_launches(v))
    names = lambda side: {p: prefix + side for p, prefix in PREFIXES.items()}
    parts = [
        _summary_markers(summary),
        _pair(FA.recommended(FA.with_impact(osa, rank)), "2*", FA.OSA_FIELDS, FA.worst_first()),
        _pair(FA.recommended(FA.with_impact(sov, rank)), "3*", FA.SOV_FIELDS, FA.worst_first()),
        _pair(FA.with_impact(discount, rank), "4*", FA.DISCOUNT_FIELDS, FA.worst_first()),
        R.platform_markers(R.known_platforms(drainers, PLATFORMS), names("D"), FA.worst_first(), FA.DRAINER_FIELDS, numbers=FA.DRAINER_NUMBERS),
        R.platform_markers(R.known_platforms(gainers, PLATFORMS), names("G"), FA.best_first(), FA.GAINER_FIELDS),
        _pair(launches, "NL_", FA.LAUNCH_FIELDS, [F.col("gc_platform")]),
    ]
    out = summary.select("account").distinct().select("account", F.explode(F.array(
        F.struct(F.lit("Brand").alias("marker"), R.capitalise("account").alias("value")),
        F.struct(F.lit("m1").alias("marker"), F.date_format(F.to_date(F.lit(L2[0])), "MMM").alias("value")),
        F.struct(F.lit("m2").alias("marker"), F.date_format(F.to_date(F.lit(L1[0])), "MMM").alias("value")),
    )).alias("kv")).select("account", "kv.marker", "kv.value")
    for p in parts:
        out = out.unionByName(p)
    return out


SUMMARY_MARKERS = R.marker_names("1*", len(FA.SUMMARY_FIELDS), len(PLATFORMS))
MARKERS = (["Brand", "m1", "m2"] + SUMMARY_MARKERS + R.marker_names("2*", len(FA.OSA_FIELDS), 2)
           + R.marker_names("3*", len(FA.SOV_FIELDS), 2) + R.marker_names("4*", len(FA.DISCOUNT_FIELDS), 2)
           + [f"{p}D{slot}_{n}" for p in PREFIXES.values() for slot in (1, 2) for n in FA.DRAINER_NUMBERS]
           + [f"{p}G{slot}_{n + 1}" for p in PREFIXES.values() for slot in (1, 2) for n in range(len(FA.GAINER_FIELDS))]
           + R.marker_names("NL_", len(FA.LAUNCH_FIELDS), 2))


def fmt_amt_sql(x: str) -> str:
    return (f"CASE WHEN {x} >= 1e7 THEN '₹' || printf('%.1f', round({x} / 1e7, 1)) || ' Cr ' "
            f"ELSE '₹' || printf('%.1f', round({x} / 1e5, 1)) || ' L' END")


GAIN_DRAIN_SQL = drill_ctes("down") + drivers_sql("up", "_up") + """,
g AS (SELECT account, gc_platform, bgr AS gainers_bgr, pct_change AS gainers_change,
        bgr || '(' || printf('%.1f', round(pct_change, 1)) || '%)' AS gainers
      FROM drivers_up WHERE rank = 1),
d AS (SELECT account, gc_platform, bgr AS drainers_bgr, pct_change AS drainers_change,
        bgr || '(' || printf('%.1f', round(pct_change, 1)) || '%)' AS drainers
      FROM drivers WHERE rank = 1),
m AS (SELECT coalesce(g.account, d.account) AS account, coalesce(g.gc_platform, d.gc_platform) AS gc_platform,
        coalesce(gainers_bgr, '') AS gb, coalesce(drainers_bgr, '') AS db, coalesce(gainers_change, 0.0) AS gc,
        coalesce(gainers, '') AS gainers, coalesce(drainers, '') AS drainers
      FROM g FULL JOIN d ON g.account = d.account AND g.gc_platform = d.gc_platform),
gdm AS (SELECT account, gc_platform,
        CASE WHEN gb = db AND NOT gc > 0 THEN '' ELSE gainers END AS gainers,
        CASE WHEN gb = db AND gc > 0 THEN '' ELSE drainers END AS drainers FROM m),
po AS (SELECT account, gc_platform,
        coalesce(CAST(SUM(CASE WHEN date_period = 'dr1' THEN CAST(actual_sum AS DECIMAL(38,6)) END) AS DOUBLE), 0.0) AS o1,
        coalesce(CAST(SUM(CASE WHEN date_period = 'dr2' THEN CAST(actual_sum AS DECIMAL(38,6)) END) AS DOUBLE), 0.0) AS o2
       FROM ms WHERE is_own_brand = 1 GROUP BY 1, 2)"""


@register("gain_drain_merge", with_views(GAIN_DRAIN_SQL + "\nSELECT * FROM gdm", ("pid_metrics", "product_dim")))
def q_gain_drain_merge(spark, sf):
    _, down, up = _report_parts(spark, sf)
    return R.gain_drain_merge(up["drivers"], down["drivers"])


@register("offtake_summary", with_views(GAIN_DRAIN_SQL + f"""
SELECT po.account, po.gc_platform, po.o1 AS offtake, {fmt_amt_sql('po.o2')} AS prev_offtake,
  CASE WHEN po.o1 - po.o2 > 0 THEN '(↑ ' ELSE '(↓ ' END || {fmt_amt_sql('abs(po.o1 - po.o2)')} || ')' AS share_delta,
  coalesce(gdm.gainers, '') AS gainers, coalesce(gdm.drainers, '') AS drainers
FROM po LEFT JOIN gdm ON po.account = gdm.account AND po.gc_platform = gdm.gc_platform""",
                                          ("pid_metrics", "product_dim")))
def q_offtake_summary(spark, sf):
    return _report_parts(spark, sf)[0]


@register("platform_mix", with_views(MARKET_SHARE_SQL_CTES + """,
p AS (SELECT account, gc_platform,
        coalesce(SUM(CASE WHEN date_period = 'dr2' THEN CAST(actual_sum AS DECIMAL(38,6)) END), 0) AS m1,
        coalesce(SUM(CASE WHEN date_period = 'dr1' THEN CAST(actual_sum AS DECIMAL(38,6)) END), 0) AS m2
      FROM ms GROUP BY 1, 2),
t AS (SELECT *, SUM(m1) OVER (PARTITION BY account) AS t1, SUM(m2) OVER (PARTITION BY account) AS t2,
        row_number() OVER (PARTITION BY account ORDER BY m1 + m2 DESC, gc_platform) AS platform_rank FROM p)
SELECT account, gc_platform, platform_rank, CAST(m1 AS DOUBLE) AS offtake_dr2, CAST(m2 AS DOUBLE) AS offtake_dr1,
  round(100 * CAST(m1 AS DOUBLE) / CAST(t1 AS DOUBLE), 1) AS share_dr2,
  round(100 * CAST(m2 AS DOUBLE) / CAST(t2 AS DOUBLE), 1) AS share_dr1,
  round(100 * CAST(m2 AS DOUBLE) / CAST(t2 AS DOUBLE), 1) - round(100 * CAST(m1 AS DOUBLE) / CAST(t1 AS DOUBLE), 1) AS share_delta,
  round(100 * CAST(t2 - t1 AS DOUBLE) / CAST(t1 AS DOUBLE), 1) AS total_change_pct
FROM t WHERE platform_rank <= 3""", ("pid_metrics", "product_dim")))
def q_platform_mix(spark, sf):
    v = Views.shared(spark, sf)
    return R.platform_mix(inputs(v)["ms"]())


@register("markers_long")
def q_markers_long(spark, sf):
    return _markers(spark, sf)


@register("report_row")
def q_report_row(spark, sf):
    return R.report_row(_markers(spark, sf), MARKERS)


@register("report_row_accounts")
def q_report_row_accounts(spark, sf):
    """The report of several accounts (order priorities) by one job, one row each."""
    return R.report_row(_markers(spark, sf, "by_priority"), MARKERS)


def _templates(spark, sf):
    d = scan_table(spark, sf, "documents")
    ph = F.concat(F.lit(" {{ Brand }} {{m1}}-{{m2}} {{1*"), ((F.col("doc_id") % 20) + 1).cast("string"),
                  F.lit("}} {{"), F.when(F.col("doc_id") % 7 == 0, F.lit("absent")).otherwise(F.lit("m2")),
                  F.lit("}}"))
    return d.select(F.lit("main").alias("account"), F.col("doc_id").alias("slide_id"),
                    F.concat(F.col("text"), ph).alias("text"))


@register("template_render")
def q_template_render(spark, sf):
    return R.render_templates(_templates(spark, sf), _markers(spark, sf), leave_missing=True)


@register("template_drop_empty")
def q_template_drop_empty(spark, sf):
    r = R.render_templates(_templates(spark, sf), _markers(spark, sf), leave_missing=False)
    return r.where("keep")


@register("sheet_union", """
SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey,
  'customer' AS sheet FROM customer
UNION ALL BY NAME
SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name, CAST(s_nationkey AS VARCHAR) AS s_nationkey,
  'supplier' AS sheet FROM supplier""")
def q_sheet_union(spark, sf):
    """Two sheets (customer, supplier) written as header CSVs, read back, cleaned, unioned by name."""
    paths = {}
    for name, cols in (("customer", ["c_custkey", "c_name", "c_nationkey"]),
                       ("supplier", ["s_suppkey", "s_name", "s_nationkey"])):
        path = _scratch(spark, f"sheet-{name}")
        scan_table(spark, sf, name).select(*[F.col(c).cast("string") for c in cols]).write.option(
            "header", True).csv(path)
        paths[name] = path
    return SH.union_sheets(SH.read_sheets(spark, paths))


@register("markers_wide")
def q_markers_wide(spark, sf):
    """The platform-summary family alone, one wide row per account."""
    return R.report_row(_summary_markers(_summary(spark, sf, Views.shared(spark, sf))), SUMMARY_MARKERS)


# list items of a page as DuckDB reads them: place from 1, inner text, entities decoded
PAGE_ITEMS = """
li AS (SELECT page_id, generate_subscripts(items, 1) AS pos, unnest(items) AS item
       FROM (SELECT page_id, regexp_extract_all(html, '(?s)<li>(.*?)</li>', 1) AS items FROM pages)),
item AS (SELECT page_id, pos, replace(replace(replace(replace(
    trim(regexp_replace(regexp_replace(item, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')),
    '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') AS name FROM li)"""


def _page_items(spark, sf, item, before, after):
    """Pages whose list items are rewritten: ``item`` is a function of place and inner markup."""
    items = F.regexp_extract_all("html", F.lit("(?s)<li>(.*?)</li>"), 1)
    rows = F.array_join(F.transform(items, lambda x, i: item(i + 1, x)), "")
    return scan_table(spark, sf, "pages").select("page_id", F.concat(before, rows, after).alias("html"))


@register("html_table_dates", f"""WITH {PAGE_ITEMS}
SELECT page_id, make_date(2000, CAST(page_id % 12 + 1 AS INTEGER), CAST(pos AS INTEGER)) AS date, name FROM item
UNION ALL SELECT page_id, make_date(2000, CAST(page_id % 12 + 1 AS INTEGER), 28), 'Tom & Eve 2 x < 3' FROM pages""")
def q_html_table_dates(spark, sf):
    """Month tables made of the pages' list items: the month by page, the day by place; with a
    short row, an empty row, a day that is no date, entities, a nested table and open cells."""
    month = F.date_format(F.make_date(F.lit(2000), (F.col("page_id") % 12 + 1).cast("int"), F.lit(1)), "MMMM")
    before = F.concat(F.lit("<table><thead><tr><th>"), month, F.lit("</th><th>Name</th></tr></thead><tbody><tr></tr><tr><td>3</td></tr>"))
    after = F.lit("<tr><td>99</td><td>no day</td></tr><tr><td>28<td>Tom &amp; Eve <table><tr><td>2 x</td></tr></table> &lt; 3</tbody></table>")
    pages = _page_items(spark, sf, lambda i, x: F.concat(F.lit("<tr><td>"), i.cast("string"), F.lit(" <i>st</i></td><td>"), x,
                                                         F.lit("</td></tr>")), before, after)
    return PG.extract_table_rows(pages, 2000, keep=["page_id"], ordered=False)


@register("html_day_cells", f"""WITH {PAGE_ITEMS}
SELECT page_id, make_date(2000, CAST(page_id % 12 + 1 AS INTEGER), CAST(pos AS INTEGER)) AS date, name FROM item
UNION ALL SELECT page_id, DATE '2000-12-31', unnest(['one', 'two & three']) FROM pages""")
def q_html_day_cells(spark, sf):
    """Calendar cells made of the pages' list items, with several names a day, other cells and
    other boxes, and days that are no dates."""
    day = lambda i: F.concat(F.lit("2000-"), F.lpad((F.col("page_id") % 12 + 1).cast("string"), 2, "0"), F.lit("-"),
                             F.lpad(i.cast("string"), 2, "0"))
    after = F.lit('<td class="single-day" data-date="2000-12-31"><p><div class="a dayCal">one</div><div class="monthCal">two &amp; <b>three</b></div>'
                  '<div class="note">none</div></td><td class="single-day" data-date="2000-13-01"><div class="dayCal">x</div></td>'
                  '<td class="other" data-date="2000-01-01"><div class="dayCal">y</div></td></tr></table>')
    pages = _page_items(spark, sf, lambda i, x: F.concat(
        F.lit('<td class="cell single-day" data-date="'), day(i), F.lit('"><div class="dayCal">'), x, F.lit("</div></td>")),
        F.lit("<table><tr>"), after)
    return PG.extract_day_cells(pages, keep=["page_id"])


ORDER_DAYS_SQL = "SELECT DISTINCT CAST(o_orderdate AS DATE) AS date, o_orderstatus AS name FROM orders WHERE year(o_orderdate) = 2000"


def _order_days(spark, sf):
    """Order days and statuses of 2000, one row per month with its days (at most 31 x statuses)."""
    d = (scan_table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("date"), F.col("o_orderstatus").alias("name"))
         .where(F.year("date") == 2000).distinct())
    return d.groupBy(F.month("date").alias("m"), F.date_format("date", "MMMM").alias("month")).agg(
        F.sort_array(F.collect_list(F.struct("date", "name"))).alias("days"))


@register("html_table_dates_orders", ORDER_DAYS_SQL)
def q_html_table_dates_orders(spark, sf):
    """Month tables printed from the order days and read back."""
    rows = F.array_join(F.transform("days", lambda d: F.concat(
        F.lit("<tr><td>"), F.dayofmonth(d["date"]).cast("string"), F.lit(" <b>day</b></td><td> "), d["name"],
        F.lit("</td></tr>"))), "")
    html = F.concat(F.lit("<p>x</p><table><thead><tr><th>"), F.col("month"), F.lit(" list</th><th>Name</th></tr></thead><tbody>"),
                    rows, F.lit("<tr><td>99</td><td>no day</td></tr></tbody></table>"))
    return PG.extract_table_rows(_order_days(spark, sf).select(html.alias("html")), 2000, ordered=False)


@register("html_day_cells_orders", ORDER_DAYS_SQL)
def q_html_day_cells_orders(spark, sf):
    """Calendar day cells printed from the order days and read back."""
    cells = F.array_join(F.transform("days", lambda d: F.concat(
        F.lit('<td class="single-day" data-date="'), d["date"].cast("string"), F.lit('"><div class="dayCal">'), d["name"],
        F.lit("</div></td>"))), "")
    html = F.concat(cells, F.lit('<td class="single-day" data-date="2000-13-01"><div class="dayCal">x</div></td>'))
    return PG.extract_day_cells(_order_days(spark, sf).select(html.alias("html")))


def _text(x: str) -> str:
    return f"printf('%.1f', round_even(({x}) * 10.0, 0) / 10.0)"


def _flat_sql(src: str, part: str, order: str, fields, slots: int, marker) -> str:
    """The leading ``slots`` rows per ``part`` of ``src``, one marker per field."""
    return "\nUNION ALL\n".join(
        f"SELECT account, {marker(i)} AS marker, coalesce(CAST({c} AS VARCHAR), '') AS value "
        f"FROM (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY {order}) AS slot FROM {src}) WHERE slot <= {slots}"
        for i, c in enumerate(fields))


def _pair_sql(src: str, prefix: str, order: str, fields, slots: int = 2) -> str:
    return _flat_sql(src, "account", order, fields, slots,
                     lambda i: f"'{prefix}' || CAST((slot - 1) * {len(fields)} + {i + 1} AS VARCHAR)")


def _platform_sql(src: str, side: str, order: str, fields, numbers) -> str:
    """Two slots per account and platform; the platform's capital, the side, the slot, the field."""
    return _flat_sql(src, "account, gc_platform", order, fields, 2,
                     lambda i: f"upper(substr(gc_platform, 1, 1)) || '{side}' || CAST(slot AS VARCHAR) || '_{numbers[i]}'")


def _markers_sql() -> str:
    """The whole report from the statements of its parts."""
    said = "trim(replace(coalesce(recommendation, ''), chr(10), ' ')) <> ''"
    worst = "rank_impact ASC NULLS LAST, gc_platform, bgr, brand"
    cat = "account, gc_platform, bgr, brand"
    named = lambda q: (f"SELECT q.*, b.sales_impact AS rank_impact, q.bgr || ' (' || q.gc_platform || ')' AS name "  # noqa: E731
                       f"FROM ({q}) q JOIN down_rows b USING ({cat})")
    lakh = "CASE WHEN {0} >= 1e7 THEN '₹' || " + _text("{0} / 1e7") + " || '{1}' ELSE '₹' || " + _text("{0} / 1e5") + " || ' L' END"
    return f"""WITH down_rows AS ({ORACLE["drilldown_down"]}),
up_drivers AS ({ORACLE["best_categories"]}),
offt AS ({ORACLE["offtake_summary"]}),
plat_psl AS ({ORACLE["psl_by_platform"]}),
cover AS ({ORACLE["new_store_coverage"]}),
summ AS (
  SELECT o.account, o.gc_platform, {lakh.format("o.offtake", " Cr ")} AS offtake_text, o.share_delta, o.gainers, o.drainers,
    {lakh.format("p.psl_mrp", " Cr")} || chr(10) || '(' || {_text("100 * p.psl_mrp / nullif(o.offtake, 0)")} || '% of offtake)' AS psl,
    CAST(CAST(round_even(100.0 * c.listed_in_new_stores / nullif(c.new_stores, 0), 0) AS BIGINT) AS VARCHAR) || '%' AS listing_pct,
    'out of ' || CAST(c.new_stores AS VARCHAR) || ' stores' AS new_stores
  FROM offt o LEFT JOIN plat_psl p USING (account, gc_platform) LEFT JOIN cover c USING (account, gc_platform)
),
spine AS (
  SELECT a.account, p.gc_platform, p.place, o.* EXCLUDE (account, gc_platform)
  FROM (SELECT DISTINCT account FROM summ) a
  JOIN (SELECT unnest([{", ".join(f"'{p}'" for p in PLATFORMS)}]) AS gc_platform, unnest(range({len(PLATFORMS)})) AS place) p ON true
  LEFT JOIN summ o ON o.account = a.account AND o.gc_platform = p.gc_platform
),
osa_f AS ({named(RQ.ORACLE_EXTRA["osa_recs"])}),
sov_f AS ({named(RQ.ORACLE_EXTRA["sov_recs"])}),
dis_f AS ({named(RQ.ORACLE_EXTRA["discount_recs"])}),
hap AS ({SQ.WHAT_HAPPENED_SQL}),
imp AS ({ORACLE["impact_text"]}),
tr AS ({RQ.ORACLE_EXTRA["text_rules"]}),
drain AS (
  SELECT h.account, h.gc_platform, h.bgr, h.brand, h.gc_city, h.what_happened1, h.what_happened2, h.what_happened3,
    t.recommendation, i.geo_text, i.sales_impact AS rank_impact, {_text("abs(i.sales_impact) / 100000")} || ' L' AS impact,
    CAST(i.share_dr1 AS VARCHAR) || '% (' || {_text("i.pct_change")} || '%)' AS ms
  FROM hap h JOIN (SELECT * FROM tr WHERE {said}) t USING ({cat}) LEFT JOIN imp i USING ({cat})
),
gain AS (
  SELECT q.*, b.sales_impact AS rank_impact FROM ({SQ.GAIN_SUMMARY_SQL}) q JOIN up_drivers b USING ({cat})
  WHERE q.what_worked IS NULL OR q.what_worked <> ''
),
laun AS (
  SELECT *, {_text("wt_osa_dr1")} || '% (' || {_text("change_wt_osa")} || '%)' AS osa, {_text("market_share_dr1")} || '%' AS share
  FROM ({ORACLE["new_launches_registry"]})
),
mk AS MATERIALIZED (
  SELECT DISTINCT account, 'Brand' AS marker, upper(substr(account, 1, 1)) || lower(substr(account, 2)) AS value FROM summ
  UNION ALL SELECT DISTINCT account, 'm1', strftime(DATE '{L2[0]}', '%b') FROM summ
  UNION ALL SELECT DISTINCT account, 'm2', strftime(DATE '{L1[0]}', '%b') FROM summ
  UNION ALL {_pair_sql('spine', '1*', 'place', FA.SUMMARY_FIELDS, len(PLATFORMS))}
  UNION ALL {_pair_sql(f'(SELECT * FROM osa_f WHERE {said})', '2*', worst, FA.OSA_FIELDS)}
  UNION ALL {_pair_sql(f'(SELECT * FROM sov_f WHERE {said})', '3*', worst, FA.SOV_FIELDS)}
  UNION ALL {_pair_sql('dis_f', '4*', worst, FA.DISCOUNT_FIELDS)}
  UNION ALL {_platform_sql('drain', 'D', worst, FA.DRAINER_FIELDS, FA.DRAINER_NUMBERS)}
  UNION ALL {_platform_sql('gain', 'G', worst.replace('ASC', 'DESC'), FA.GAINER_FIELDS, range(1, 6))}
  UNION ALL {_pair_sql('laun', 'NL_', 'gc_platform', FA.LAUNCH_FIELDS)}
)"""


MARKERS_LONG_SQL = _markers_sql()


def _wide_sql(names: list[str]) -> str:
    cols = ", ".join(f"coalesce(max(CASE WHEN marker = '{n}' THEN value END), '') AS \"{n}\"" for n in names)
    return f"SELECT account, {cols} FROM mk GROUP BY account"


ORACLE_EXTRA = {
    "report_row_accounts": several_accounts(MARKERS_LONG_SQL + "\n" + _wide_sql(MARKERS)),
    "markers_long": MARKERS_LONG_SQL + "\nSELECT * FROM mk",
    "report_row": MARKERS_LONG_SQL + "\n" + _wide_sql(MARKERS),
    "markers_wide": MARKERS_LONG_SQL + "\n" + _wide_sql(SUMMARY_MARKERS).replace(
        "FROM mk", "FROM mk WHERE marker LIKE '1*%'"),
}


def _template_sql(leave_missing: bool, keep_only: bool) -> str:
    def val(marker_expr: str) -> str:
        return f"(SELECT value FROM mk WHERE mk.account = t.account AND mk.marker = {marker_expr})"
    k = "'1*' || CAST(t.doc_id % 20 + 1 AS VARCHAR)"
    last = "CASE WHEN t.doc_id % 7 = 0 THEN 'absent' ELSE 'm2' END"
    missing = "'{{' || name || '}}'" if leave_missing else "''"
    body = f""",
t AS (SELECT 'main' AS account, doc_id, text FROM documents),
v AS (
  SELECT t.account, t.doc_id, t.text,
    {val("'Brand'")} AS v_brand, {val("'m1'")} AS v_m1, {val("'m2'")} AS v_m2,
    {k} AS k_name, {val(k)} AS v_k, {last} AS last_name, {val(last)} AS v_last
  FROM t
),
r AS (
  SELECT account, doc_id AS slide_id,
    text || ' ' || coalesce(v_brand, '') || ' ' || coalesce(v_m1, '') || '-' || coalesce(v_m2, '') || ' '
      || coalesce(v_k, {missing.replace('name', 'k_name')}) || ' ' || coalesce(v_last, {missing.replace('name', 'last_name')}) AS rendered,
    (trim(coalesce(v_brand, '')) <> '' OR trim(coalesce(v_m1, '')) <> '' OR trim(coalesce(v_m2, '')) <> ''
      OR trim(coalesce(v_k, '')) <> '' OR trim(coalesce(v_last, '')) <> '') AS keep
  FROM v
)
SELECT * FROM r{' WHERE keep' if keep_only else ''}"""
    return MARKERS_LONG_SQL + body


ORACLE_EXTRA["template_render"] = _template_sql(True, False)
ORACLE_EXTRA["template_drop_empty"] = _template_sql(False, True)
