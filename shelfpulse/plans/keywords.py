"""Keyword relevance (H12), keyword x brand ad share of voice (H13) and SKU
contribution (H14)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfpulse.functions.exprs import safe_div
from shelfpulse.functions.text import kw_score, relevance
from shelfpulse.operators.periods import filter_periods, period_label
from shelfpulse.operators.topk import SKEW_SALT, top_k
from shelfpulse.operators.windows import with_group_totals

KW_GROUP = ("account", "gc_platform", "bgr", "gc_city")


def keyword_totals(kw: DataFrame, l1, l2, group: Sequence[str] = KW_GROUP,
                   once: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Per period x group x keyword: own ad SOV, category share and volume share.

    * ``ad_sov`` = own ad impressions / all ad impressions (0 when none), SQL round 1;
    * ``cat_share`` = keyword impressions over the group's, ``vol_share`` =
      keyword weight (max per keyword) over the group's, both SQL round 1.

    ``once`` may write the aggregate and read it back: rows and group totals then start
    from it and the impressions are scanned once.
    """
    f = filter_periods(kw, "snapshot_date", l1, l2).withColumn(
        "date_period", period_label("snapshot_date", l1, l2, "dr2"))
    own_ad = F.sum(F.col("is_own_brand") * F.col("ad_impressions"))
    g = f.groupBy("date_period", *group, "keyword").agg(
        F.sum("total_impressions").alias("tot_imp"),
        F.sum("ad_impressions").alias("ad_imp"),
        F.when(F.sum("ad_impressions") == 0, F.lit(0.0)).otherwise(
            F.round(safe_div(own_ad.cast("double") * 100.0, F.sum("ad_impressions").cast("double")), 1)
        ).alias("ad_sov"),
        F.max("keyword_weight").alias("max_keyword_weight"))
    g = once(g) if once else g
    # keywords per category x city grow with the data: group totals joined back
    g = with_group_totals(g, ["date_period", *group], ["tot_imp", "max_keyword_weight"])
    return g.select(
        "date_period", *group, "keyword", "max_keyword_weight", "ad_sov",
        F.round(safe_div(100.0 * F.col("tot_imp").cast("double"),
                         F.col("__tot_tot_imp").cast("double")), 1).alias("cat_share"),
        F.round(safe_div(100.0 * F.col("max_keyword_weight").cast("double"),
                         F.col("__tot_max_keyword_weight").cast("double")), 1).alias("vol_share"))


def keyword_scores(totals: DataFrame, group: Sequence[str] = KW_GROUP,
                   relevant: bool = True) -> DataFrame:
    """Current-period keywords with relevance, score and both periods' ad SOV.

    ``relevant=True``: relevance > 1 and volume share > 1; ``False``: the low
    relevance set, 0 < relevance <= 1 and volume share > 1.  ``sov_dr1`` /
    ``sov_dr2``: ad SOV of the keyword in each period (the reference's pivot,
    mean per period, joined back on the keyword keys).
    """
    keys = [*group, "keyword"]
    # the period pivot of ad SOV as a window over the keyword keys: same rows as
    # pivot + left join, without a second pass over the totals
    w = Window.partitionBy(*keys)
    p = F.col("date_period")
    d = (totals.withColumn("sov_dr1", F.avg(F.when(p == "dr1", F.col("ad_sov"))).over(w))
         .withColumn("sov_dr2", F.avg(F.when(p == "dr2", F.col("ad_sov"))).over(w)))
    cur = (d.where(F.col("date_period") == "dr1")
           .withColumn("relevant_score", relevance("cat_share", "vol_share")))
    if relevant:
        cur = cur.where((F.col("relevant_score") > 1) & (F.col("vol_share") > 1))
    else:
        cur = cur.where((F.col("relevant_score") <= 1) & (F.col("relevant_score") > 0)
                        & (F.col("vol_share") > 1))
    return cur.withColumn("final_score", kw_score("vol_share", "relevant_score"))


def keyword_recs(scored: DataFrame, group: Sequence[str] = KW_GROUP, k: int = 2) -> DataFrame:
    """Keywords to bid per group (D17): the first ``k`` (by score) whose ad SOV
    fell, else the single best-scored keyword.

    Two salted top-k selections (falling keywords, any keyword) keep at most
    ``k + 1`` rows per group; only those are gathered into the list, so a
    category with very many keywords never lands in one task or one array.
    """
    order = [F.col("final_score").desc_nulls_last(), F.col("keyword").asc_nulls_last()]
    fell = F.coalesce(F.col("sov_dr1") < F.col("sov_dr2"), F.lit(False))
    top_fell = top_k(scored, group, order, k, fell, rank_col="__r", salt=SKEW_SALT).withColumn("__src", F.lit(1))
    best = top_k(scored, group, order, 1, rank_col="__r", salt=SKEW_SALT).withColumn("__src", F.lit(2))
    both = top_fell.unionByName(best).select(*group, "keyword", "__r", "__src")
    g = both.groupBy(*group).agg(
        F.min("__src").alias("__use"),
        F.collect_list(F.struct("__src", "__r", "keyword")).alias("__a"))
    picked = F.filter(F.array_sort("__a"), lambda x: x["__src"] == F.col("__use"))
    return g.select(*group, F.transform(picked, lambda x: x["keyword"]).alias("recommended_keywords"))


def keyword_brand_sov(kw: DataFrame, dim: DataFrame, l1, l2,
                      group: Sequence[str] = KW_GROUP) -> DataFrame:
    """Ad SOV of each brand on each keyword (H13), NULL -> 0.

    Brand totals and keyword totals come from one aggregate plus a window
    (instead of a second scan and a USING join); the own flag from the
    product dimension's distinct (brand, flag) pairs.
    """
    f = filter_periods(kw, "snapshot_date", l1, l2).withColumn(
        "date_period", period_label("snapshot_date", l1, l2, "dr1"))
    g = f.groupBy("date_period", *group, "keyword", "brand").agg(
        F.sum("ad_impressions").alias("own_imp"))
    w = Window.partitionBy("date_period", *group, "keyword")
    z = g.select("date_period", *group, "keyword", "brand",
                 F.round(safe_div(100 * F.col("own_imp").cast("double"),
                                  F.sum("own_imp").over(w).cast("double")), 1).alias("ad_sov"))
    flags = dim.select("brand", "is_own_brand").distinct()
    out = z.join(flags, ["brand"], "left").withColumn("gc_platform", F.lower("gc_platform"))
    return out.na.fill({"ad_sov": 0.0, "is_own_brand": 0})


def contribution(facts: DataFrame, l1, keys=("account", "product_id", "title", "gc_platform",
                                              "bgr", "gc_city"),
                 part_keys=("account", "gc_platform", "bgr", "gc_city")) -> DataFrame:
    """Own SKU share of own sales per platform x category x city over L1."""
    f = facts.where(F.col("snapshot_date").between(F.to_date(F.lit(str(l1[0]))),
                                                   F.to_date(F.lit(str(l1[1]))))
                    & (F.col("is_own_brand") == 1))
    g = with_group_totals(f.groupBy(*keys).agg(F.sum("reported_offtake_mrp").alias("total_mrp")),
                          list(part_keys), ["total_mrp"])
    return g.select(*keys, F.round(safe_div(100.0 * F.col("total_mrp").cast("double"),
                                            F.col("__tot_total_mrp").cast("double")), 1)
                    .alias("contribution_pct"))
