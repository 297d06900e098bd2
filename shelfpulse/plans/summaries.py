"""Text summaries over the drill-down frames: impact by city (H20), what
happened (H19), gain summary (H21), new launches (H22).

Each summary is a bounded per-row computation: the candidate rows of one driver
(at most three cities, at most two competitors) are gathered with
``collect_list`` after a top-k, and the text is built with column expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfpulse.functions.exprs import pandas_round
from shelfpulse.functions.text import printed
from shelfpulse.operators.topk import SKEW_SALT, top_k

CAT = ["account", "gc_platform", "bgr", "brand"]
CITY = ["account", "gc_platform", "bgr", "gc_city", "brand"]
UP, DOWN = "↑", "↓"

# Report labels of the metric changes (brand level), in the reference's order.
BRAND_CHANGE_LABELS = (
    ("change_wt_osa", "OSA", "wt_osa_dr1"),
    ("change_wt_discounting", "Discounting", "wt_discounting_dr1"),
    ("change_sov", "overall SOV", "sov_dr1"),
    ("change_adsov", "Ad SOV", "ad_sov_dr1"),
)


def py_num(c, decimals: int = 1) -> Column:
    """Python ``str(round(x, n))`` / ``f"{x:.nf}"`` for values printed with one decimal."""
    return printed(f"%.{decimals}f", pandas_round(c, decimals))


def arrow(c) -> Column:
    return F.when(c > 0, F.lit(UP)).otherwise(F.lit(DOWN))


# ------------------------------------------------------------------ H20
def impact_by_city(drivers: DataFrame, cities: DataFrame, share_cut: float = 50.0) -> DataFrame:
    """Impact text and city text per losing category.

    * impact text: sales loss in lakhs, with the category share and its change
      when the share fell, or the "share did not decline" wording otherwise;
    * city text: the top cities (by loss) with their % of the category's loss:
      one city when it carries >= 50 %, else two when the first two do, else
      (three reach 50 %) the first two, else every listed city "name (p%)".
      The reference cuts the list to one city before these branches (X7); we
      keep three so the branches are reachable.
    """
    imp = F.col("sales_impact")
    lakhs = py_num(F.abs(imp) / 100000)
    text = F.when(F.col("pct_change") >= 0, F.concat(
        F.lit("While Pan-India share did not decline, localized impact in this segment led to a "
              "sales loss of INR "), lakhs, F.lit(" lakhs"))).otherwise(F.concat(
        F.lit("Sales Opportunity Loss: INR "), lakhs, F.lit(" lakhs\n\nCategory Share: "),
        py_num("share_dr1"), F.lit("% ("), py_num("pct_change"), F.lit("%)\n")))
    d = drivers.select(*CAT, "sales_impact", "share_dr1", "pct_change", text.alias("impact_text"))
    c = cities.where(F.col("city_rank") <= 3).select(
        *CAT, "city_rank", "gc_city", F.col("sales_impact").alias("__ci"))
    j = c.join(d.select(*CAT, F.col("sales_impact").alias("__di")), CAT)
    j = j.withColumn("__p", pandas_round(F.try_divide(F.col("__ci"), F.col("__di")) * 100, 1))
    g = j.groupBy(*CAT).agg(F.array_sort(F.collect_list(F.struct("city_rank", "gc_city", "__p"))).alias("__c"))
    p = lambda i: F.col("__c")[i]["__p"]
    n = lambda i: F.col("__c")[i]["gc_city"]
    ip = lambda i: F.rint(p(i)).cast("bigint").cast("string")
    one = F.concat(n(0), F.lit("("), ip(0), F.lit("%)"))
    two = F.concat(one, F.lit(", "), n(1), F.lit("("), ip(1), F.lit("%)"))
    fallback = F.array_join(F.transform("__c", lambda x: F.concat(
        x["gc_city"], F.lit(" ("), F.rint(x["__p"]).cast("bigint").cast("string"), F.lit("%)"))), ", ")
    size = F.size("__c")
    geo = (F.when((size >= 1) & (p(0) >= share_cut), one)
           .when((size >= 2) & (p(0) + p(1) >= share_cut), two)
           .when((size >= 3) & (p(0) + p(1) + p(2) >= share_cut), two)
           .otherwise(fallback))
    return d.join(g.select(*CAT, geo.alias("geo_text")), CAT)


# ------------------------------------------------------------------ H19
def select_moves(changes: Sequence[tuple[str, str, str]], sign: int, k: int = 2) -> tuple[Column, Column]:
    """The ``k`` metric changes moving in the wanted direction (most first);
    when none does, the ``k`` largest by absolute value and the status flips.

    Returns (array of structs(label, change, level col value), status word).
    Ties keep the listed order (Python's stable sort).
    """
    items = [F.struct(F.lit(i).alias("i"), F.lit(label).alias("label"),
                      F.col(ch).cast("double").alias("v"), F.col(lvl).cast("double").alias("lvl"))
             for i, (ch, label, lvl) in enumerate(changes)]
    arr = F.filter(F.array(*items), lambda x: x["v"].isNotNull())
    s = float(sign)
    signed = F.filter(arr, lambda x: x["v"] * s > 0)
    signed = F.array_sort(F.transform(signed, lambda x: F.struct((-x["v"] * s).alias("o"), x["i"].alias("i"),
                                                                    x["label"].alias("label"), x["v"].alias("v"),
                                                                    x["lvl"].alias("lvl"))))
    fall = F.array_sort(F.transform(arr, lambda x: F.struct((-F.abs(x["v"])).alias("o"), x["i"].alias("i"),
                                                             x["label"].alias("label"), x["v"].alias("v"),
                                                             x["lvl"].alias("lvl"))))
    has = F.size(signed) > 0
    sel = F.when(has, F.slice(signed, 1, k)).otherwise(F.slice(fall, 1, k))
    want, other = ("decreased", "increased") if sign < 0 else ("increased", "decreased")
    return sel, F.when(has, F.lit(want)).otherwise(F.lit(other))


def brand_block(df: DataFrame, sign: int) -> DataFrame:
    """Performance line and brand text of each brand row (own: falls, competitor: rises)."""
    sel, status = select_moves(BRAND_CHANGE_LABELS, sign)
    d = df.withColumn("__sel", sel).withColumn("__status", status)
    perf = F.concat(F.col("brand"), F.lit(" "),
                    F.array_join(F.transform("__sel", lambda x: x["label"]), " and "),
                    F.lit(" "), F.col("__status"))
    ms = F.concat(F.lit("MS "), py_num("share_dr1"), F.lit("% ("), arrow(F.col("pct_change")),
                  py_num(F.abs(F.col("pct_change"))), F.lit("%)"))
    parts = F.concat(F.array(ms), F.transform("__sel", lambda x: F.concat(
        x["label"], F.lit(" "), py_num(F.coalesce(x["lvl"], F.lit(0.0))), F.lit("% ("), arrow(x["v"]),
        py_num(F.abs(x["v"])), F.lit("%)"))))
    text = F.concat(F.col("brand"), F.lit(" "), F.array_join(parts, "\n\n"))
    return d.withColumn("performance_line", perf).withColumn("brand_text", text).drop("__sel", "__status")


def with_sku_text(rows: DataFrame, skus: DataFrame | None) -> DataFrame:
    """Blanks (NULL) the brand text of rows without a SKU whose share changed."""
    if skus is None:
        return rows
    moved = (skus.where(F.col("change_market_share").isNotNull()).select(*CITY).distinct()
             .withColumn("__sku", F.lit(True)))
    return (rows.join(moved, CITY, "left")
            .withColumn("brand_text", F.when(F.col("__sku"), F.col("brand_text"))).drop("__sku"))


def what_happened(own_rows: DataFrame, comp_rows: DataFrame, metrics_change: DataFrame,
                  own_skus: DataFrame | None = None, comp_skus: DataFrame | None = None,
                  max_comps: int = 2) -> DataFrame:
    """Per own driver brand row: its text, the texts of the rising competitors
    in the same platform x category x city, and one performance column (H19).

    Competitor metrics come from the brand metric changes (left join on the
    city x brand keys, flag 0).  At most ``max_comps`` competitors per city.
    With the drivers' and competitors' SKU rows given, a brand without one has
    no text (its performance line stays).
    """
    own = with_sku_text(brand_block(own_rows, -1), own_skus).select(*CITY, "brand_text", "performance_line")
    m = metrics_change.where(F.col("is_own_brand") == 0).drop("is_own_brand")
    comp = comp_rows.drop(*[c for c in metrics_change.columns if c not in CITY and c in comp_rows.columns])
    comp = with_sku_text(brand_block(comp.join(m, CITY, "left"), +1), comp_skus)
    where = ["account", "gc_platform", "bgr", "gc_city"]
    comp = top_k(comp, where, [F.col("pct_change").desc_nulls_last(), F.col("brand").asc_nulls_last()],
                 max_comps, F.col("pct_change").isNotNull(), rank_col="__r")
    cg = comp.groupBy(*where).agg(F.array_sort(F.collect_list(
        F.struct("__r", "brand_text", "performance_line"))).alias("__comp"))
    j = own.join(cg, where, "left")
    comps = F.coalesce(F.col("__comp"), F.array())
    texts = F.concat(F.array(F.col("brand_text")), F.transform(comps, lambda x: x["brand_text"]))
    perfs = F.concat(F.array(F.col("performance_line")), F.transform(comps, lambda x: x["performance_line"]))
    return j.select(*CITY, *[F.get(texts, i).alias(f"what_happened{i + 1}") for i in range(1 + max_comps)],
                    F.array_join(perfs, "\n").alias("performance"))


# ------------------------------------------------------------------ H22
def new_launches(sku_master: DataFrame, dim: DataFrame, sku_cmp: DataFrame, l1_end) -> DataFrame:
    """Competitor SKUs first seen since the start of the month before L1's end,
    best per platform by current share among those whose OSA rose (H22).

    Products are limited to the account's product dimension (semi join, C3);
    title, category and own flag come from it (C10); SKU x city changes from
    the SKU compare (left join), then one row per platform (F9).
    """
    start = F.date_trunc("month", F.add_months(F.to_date(F.lit(str(l1_end))), -1)).cast("date")
    d = dim.select("product_id", "title", "is_own_brand", F.lower("bgr").alias("bgr")).dropDuplicates(["product_id"])
    b = (sku_master.join(d.select("product_id"), "product_id", "left_semi")
         .where(F.col("first_seen") >= start)
         .withColumn("gc_platform", F.lower("gc_platform")))
    b = b.join(d, "product_id", "left").where(F.col("is_own_brand") == 0)
    cols = ["change_market_share", "market_share_dr1", "change_wt_osa", "wt_osa_dr1"]
    a = sku_cmp.select("account", "gc_platform", "bgr", "gc_city", "brand", "product_id", "title", *cols)
    j = b.join(a, ["account", "gc_platform", "bgr", "product_id", "title"], "left")
    best = top_k(j, ["account", "gc_platform"],
                 [F.col("market_share_dr1").desc_nulls_last(), F.col("product_id").asc_nulls_last(),
                  F.col("gc_city").asc_nulls_last()], 1, F.col("change_wt_osa") > 0, rank_col=None,
                 salt=SKEW_SALT)
    return (best.withColumn("wt_osa_dr1", pandas_round("wt_osa_dr1", 1))
            .withColumn("change_wt_osa", pandas_round("change_wt_osa", 1)))



# ------------------------------------------------------------------ H21
def city_share_text(cities: DataFrame, drivers: DataFrame, k: int = 2) -> DataFrame:
    """``c1 (x%)`` / ``c1 (x%) and c2 (y%)`` of each gaining driver's top cities,
    x = city impact as % of the category impact (pandas rounding)."""
    c = cities.where(F.col("city_rank") <= k).select(*CAT, "city_rank", "gc_city",
                                                      F.col("sales_impact").alias("__ci"))
    c = c.join(drivers.select(*CAT, F.col("sales_impact").alias("__di")), CAT)
    c = c.withColumn("__t", F.concat(F.col("gc_city"), F.lit(" ("),
                                     py_num(F.col("__ci") / F.col("__di") * 100), F.lit("%)")))
    g = c.groupBy(*CAT).agg(F.array_sort(F.collect_list(F.struct("city_rank", "__t"))).alias("__a"))
    return g.select(*CAT, F.array_join(F.transform("__a", lambda x: x["__t"]), " and ").alias("geo_text"))


def gain_summary(best: DataFrame, cat_metrics: DataFrame, cities: DataFrame, brand_rows: DataFrame,
                 sku_cmp: DataFrame, contribution: DataFrame, kw_scores: DataFrame) -> DataFrame:
    """Result text of each gaining category and what worked.

    Result: offtake gain (Cr / L), sales growth %, category share and change,
    top cities.  What worked, per the brand row of the top city: OSA up ->
    the two most contributing SKUs whose listing rose; ad SOV up -> two
    relevant keywords whose ad SOV rose (relevance > 1 and change > 0, X4),
    picked from the ten best scored; discount up -> discount and share text.
    Lines are attached by category and brand (the reference matches on the
    category only, so a second brand would overwrite the first).
    """
    m = cat_metrics.where(F.col("is_own_brand") == 1).select(*CAT, "market_share_dr1")
    d = best.join(m, CAT, "left")
    geo = city_share_text(cities, best)
    d = d.join(geo, CAT, "left")
    x = F.col("sales_impact")
    off = F.when(x >= 1e7, F.concat(py_num(x / 1e7), F.lit(" Cr"))).otherwise(F.concat(py_num(x / 1e5), F.lit(" L")))
    growth = py_num(F.try_divide(100 * (F.col("actual_sales_dr1") - F.col("actual_sales_dr2")),
                                 F.col("actual_sales_dr2")))
    ms = F.concat(F.col("market_share_dr1").cast("string"), F.lit("% ("), py_num("pct_change"), F.lit("%)"))
    result = F.concat(F.lit("Offtake: "), off, F.lit(" ("), growth, F.lit("%)\nCategory Share: "), ms,
                      F.lit("\n"), F.coalesce(F.col("geo_text"), F.lit("")))
    d = d.select(*CAT, result.alias("result"), off.alias("offtake"),
                 F.coalesce(F.col("geo_text"), F.lit("")).alias("geo_text"), ms.alias("ms"))

    where = ["account", "gc_platform", "bgr", "gc_city"]
    br = brand_rows
    skus = (sku_cmp.join(br.select(*CITY).distinct(), CITY, "left_semi")
            .join(contribution.select(*where, "product_id", "title", "contribution_pct"),
                  [*where, "product_id", "title"], "left")
            .where(F.col("change_ds_listing") > 0))
    skus = top_k(skus, CITY, [F.col("contribution_pct").desc_nulls_last(), F.col("product_id")], 2,
                 rank_col="__r", salt=SKEW_SALT)
    sk = skus.groupBy(*CITY).agg(F.array_sort(F.collect_list(F.struct("__r", "title"))).alias("__s"))
    kw = kw_scores.withColumn("change_adsov", F.col("sov_dr1") - F.col("sov_dr2")).where(
        (F.col("relevant_score") > 1) & (F.col("change_adsov") > 0))
    kw = kw.join(br.select(*where).distinct(), where, "left_semi")
    kw10 = top_k(kw, where, [F.col("final_score").desc_nulls_last(), F.col("keyword")], 10, rank_col=None,
                 salt=SKEW_SALT)
    kw2 = top_k(kw10, where, [F.col("change_adsov").desc_nulls_last(), F.col("keyword")], 2, rank_col="__r")
    kg = kw2.groupBy(*where).agg(F.array_sort(F.collect_list(F.struct("__r", "keyword"))).alias("__k"))
    b = br.join(sk, CITY, "left").join(kg, where, "left")
    titles = F.transform(F.coalesce(F.col("__s"), F.array()), lambda s: s["title"])
    acct = F.concat(F.upper(F.substring("account", 1, 1)), F.lower(F.substring("account", 2, 1 << 30)))
    osa_head = lambda lead: F.concat(F.lit(lead), acct, F.lit("'s OSA increased to "),
                                     F.col("wt_osa_dr1").cast("string"), F.lit("%(+"),
                                     printed("%.0f", F.rint(F.col("change_wt_osa"))),
                                     F.lit("%) by fixing DS listing for "))
    osa_line = F.when(F.col("change_wt_osa") > 0, F.when(F.size(titles) == 1, F.concat(
        osa_head("•"), titles[0], F.lit(" in "), F.col("gc_city"))).when(F.size(titles) >= 2, F.concat(
        osa_head("• "), titles[0], F.lit(" and "), titles[1], F.lit(" in "), F.col("gc_city"))))
    kws = F.transform(F.coalesce(F.col("__k"), F.array()), lambda s: s["keyword"])
    sov_line = F.when(F.col("change_adsov") > 0, F.when(F.size(kws) > 0, F.concat(
        F.lit("• SOV increased to "), py_num("ad_sov_dr1"), F.lit("(+"), py_num("change_adsov"),
        F.lit("%) by targeting relevant keywords - "), F.array_join(kws, ", "))).otherwise(F.lit("")))
    dis_line = F.when(F.col("change_wt_discounting") > 0, F.concat(
        F.lit("• Discounting increased to "), F.col("wt_discounting_dr1").cast("string"), F.lit("(+"),
        py_num("change_wt_discounting"), F.lit("%) ,resulting in market share increase to "),
        F.col("share_dr1").cast("string"), F.lit("("), py_num("pct_change"), F.lit("%)")))
    worked = b.select(*CAT, F.concat_ws("\n", osa_line, sov_line, dis_line).alias("what_worked"))
    return d.join(worked, CAT, "left")
