"""Rule-based recommendations on the drill-down rows: availability (H16) and
discount (H18), plus the text merge of recommendation blocks (H23).

The reference fills these tables row by row with ``.values[0]`` lookups; here
every lookup is a join to a first-row-per-key frame (C15) and every rule is a
column expression, so all drivers of all accounts are handled in one plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfpulse.functions.exprs import pandas_round
from shelfpulse.functions.text import printed
from shelfpulse.operators.topk import SKEW_SALT, top_k
from shelfpulse.plans.summaries import py_num

CAT = ["account", "gc_platform", "bgr", "brand"]
CITY = ["account", "gc_platform", "bgr", "gc_city", "brand"]

# Rule thresholds.
LISTING_GAP = 5
BACKEND_LOW = 5
FRONTEND_LOW = 3


def pct_text(c) -> F.Column:
    return F.concat(py_num(c), F.lit("%"))


def driver_context(drivers: DataFrame, cat_metrics: DataFrame, cities: DataFrame,
                   metric: str) -> DataFrame:
    """Category-level context of each driver: share, share change, the metric
    and its change, sales impact, and the top one or two cities with their %
    of the category's impact (D16 + C15)."""
    m = cat_metrics.where(F.col("is_own_brand") == 1).select(
        *CAT, F.col(f"{metric}_dr1").alias(f"cat_{metric}_dr1"),
        F.col(f"change_{metric}").alias(f"cat_change_{metric}"))
    d = drivers.select(*CAT, F.col("share_dr1").alias("cat_share_dr1"),
                       F.col("pct_change").alias("cat_change_market_share"),
                       F.col("sales_impact").alias("cat_sales_impact")).join(m, CAT, "left")
    c = cities.where(F.col("city_rank") <= 2).select(*CAT, "city_rank", "gc_city",
                                                      F.col("sales_impact").alias("__sl"))
    c = c.join(d.select(*CAT, "cat_sales_impact"), CAT)
    c = c.withColumn("__pct", F.rint(100 * F.col("__sl") / F.col("cat_sales_impact")).cast("bigint"))
    g = c.groupBy(*CAT).agg(F.array_sort(F.collect_list(F.struct("city_rank", "gc_city", "__pct"))).alias("__c"))
    geo = F.array_join(F.transform("__c", lambda x: F.concat(
        x["gc_city"], F.lit(" ("), x["__pct"].cast("string"), F.lit("%)"))), " , ")
    g = g.select(*CAT, geo.alias("top_geo"), F.col("__c")[0]["gc_city"].alias("top_city"))
    return d.join(g, CAT, "left")


def psl_text(c) -> F.Column:
    x = F.col(c) if isinstance(c, str) else c
    return F.when(x >= 1e7, F.concat(F.lit("₹"), py_num(x / 1e7), F.lit(" Cr"))) \
            .otherwise(F.concat(F.lit("₹"), py_num(x / 1e5), F.lit(" L")))


def osa_recommendations(brand_rows: DataFrame, drivers: DataFrame, cat_metrics: DataFrame,
                        cities: DataFrame, psl_rows: DataFrame, store_counts: DataFrame,
                        doi: DataFrame) -> DataFrame:
    """OSA block per losing driver whose city-level OSA fell.

    * potential sales loss of the category (sum over the store rows, SQL round 0);
    * the SKU with the largest loss in the top city (first row per key, C15);
    * listing gap = stores with high loss minus stores listing the SKU;
    * rules: gap > 5 -> fix listing; back-end days 0 -> no stock; < 5 ->
      stock-out risk; else front-end days < 3 -> transfer issue;
    * a block with no rule line (fewer than three lines) is blanked.
    """
    rows = brand_rows.where(F.col("change_wt_osa") < 0)
    ctx = driver_context(drivers, cat_metrics, cities, "wt_osa")
    r = rows.select(*CAT, "wt_osa_dr1", "change_wt_osa").join(ctx, CAT)
    psl_cat = psl_rows.groupBy("account", "gc_platform", "bgr").agg(
        F.round(F.sum(F.col("psl_mrp").cast("decimal(38,2)")), 0).cast("double").alias("psl_mrp"))
    r = r.join(psl_cat, ["account", "gc_platform", "bgr"], "left")
    sku = (psl_rows.groupBy("account", "gc_platform", "bgr", "gc_city", "product_id", "title")
           .agg(F.sum(F.col("psl_mrp").cast("decimal(38,2)")).alias("__p")))
    sku = top_k(sku, ["account", "gc_platform", "bgr", "gc_city"],
                [F.col("__p").desc_nulls_last(), F.col("product_id")], 1, rank_col=None,
                salt=SKEW_SALT).withColumnRenamed("gc_city", "top_city").drop("__p")
    r = r.join(sku, ["account", "gc_platform", "bgr", "top_city"], "left")
    # store counts of the chosen SKU in the same category and city (one row per key)
    sc = store_counts.select("account", "gc_platform", "bgr", F.col("gc_city").alias("top_city"), "product_id",
                             "title", "high_psl_stores", "listed_in")
    r = r.join(sc, ["account", "gc_platform", "bgr", "top_city", "product_id", "title"], "left")
    dd = doi.select("account", "gc_platform", "bgr", F.col("gc_city").alias("top_city"), "product_id",
                    F.col("backend_doi").alias("bdoi"), F.col("frontend_doi").alias("fdoi"))
    r = r.join(dd, ["account", "gc_platform", "bgr", "top_city", "product_id"], "left")
    city = F.col("top_city")
    gap = F.col("high_psl_stores") - F.col("listed_in")
    lines = F.array(
        F.when(gap > LISTING_GAP, F.concat(F.lit("• Fix DS listing in "), gap.cast("string"),
                                           F.lit(" stores in "), city, F.lit("\n"))),
        F.when(F.col("bdoi") == 0, F.concat(F.lit("• No stock available, fix backend inventory in "),
                                            city, F.lit("\n")))
         .when(F.col("bdoi") < BACKEND_LOW, F.concat(
             F.lit("• Stock-out risk, Only "), F.col("bdoi").cast("string"), F.lit(" days of stock left in "),
             city, F.lit("; backend inventory needs to be refilled\n")))
         .otherwise(F.when(F.col("fdoi") < FRONTEND_LOW, F.concat(
             F.lit("• Fix transfer issue from warehouse to DS in "), city, F.lit("\n")))))
    fired = F.filter(lines, lambda x: x.isNotNull())
    rec = F.when(F.size(fired) > 0, F.concat(
        F.lit("OSA Recommendations:\n- "), F.coalesce(F.col("title"), F.lit("")), F.lit(":\n"),
        F.array_join(fired, ""))).otherwise(F.lit(""))
    return r.select(
        *CAT, "top_geo",
        pct_text("cat_share_dr1").alias("share_dr1"),
        pct_text("cat_change_market_share").alias("pct_change"),
        pct_text("cat_wt_osa_dr1").alias("wt_osa_dr1"),
        pct_text("cat_change_wt_osa").alias("change_wt_osa"),
        F.concat(F.lit("OSA dropped from "),
                 (F.col("wt_osa_dr1") - F.col("change_wt_osa")).cast("bigint").cast("string"),
                 F.lit("% to "), py_num("wt_osa_dr1"), F.lit("%\nTop impacted cities are "),
                 F.coalesce(F.col("top_geo"), F.lit(""))).alias("what_happened"),
        psl_text("psl_mrp").alias("potential_sales_loss"),
        rec.alias("recommendation"))


def discount_recommendations(brand_rows: DataFrame, drivers: DataFrame, cat_metrics: DataFrame,
                             cities: DataFrame, tiers: DataFrame, comp_rows: DataFrame) -> DataFrame:
    """Discount block per losing driver whose city-level discount fell.

    Competitor: same platform x category x city, raised discount and share;
    among the four largest by current share, the one that raised discount most
    (F4).  Candidates are first limited to the driver's price tier, then, when
    none qualifies, to any tier of the category.
    """
    rows = brand_rows.where(F.col("change_wt_discounting") < 0)
    ctx = driver_context(drivers, cat_metrics, cities, "wt_discounting")
    r = rows.select(*CITY, "ppu_category", "wt_discounting_dr1", "change_wt_discounting").join(ctx, CAT)
    t = tiers.where(F.col("is_own_brand") == 0).select(*CAT, F.col("ppu_category").alias("__tier"))
    comp = (comp_rows.join(t, CAT, "left")
            .where((F.col("change_wt_discounting") > 0) & (F.col("pct_change") > 0)))
    where = ["account", "gc_platform", "bgr", "gc_city"]
    drv = r.select(*where, "ppu_category").distinct()
    order1 = [F.col("share_dr1").desc_nulls_last(), F.col("brand")]
    order2 = [F.col("change_wt_discounting").desc_nulls_last(), F.col("brand")]

    def pick(cands, keys, out):
        first = top_k(cands, keys, order1, 4, rank_col=None)
        return top_k(first, keys, order2, 1, rank_col=None).select(*keys, F.struct(
            F.col("brand").alias("comp"), F.col("wt_discounting_dr1").alias("comp_current"),
            F.col("change_wt_discounting").alias("comp_change"), F.col("share_dr1").alias("comp_share"),
            F.col("pct_change").alias("comp_ms_delta")).alias(out))
    same = comp.join(drv.withColumnRenamed("ppu_category", "__tier"), [*where, "__tier"], "left_semi")
    anyt = comp.join(drv.select(*where).distinct(), where, "left_semi")
    # the driver's own tier first, any tier when nobody in it qualifies
    tiered = pick(same, [*where, "__tier"], "__same").withColumnRenamed("__tier", "ppu_category")
    j = r.join(tiered, [*where, "ppu_category"], "left").join(pick(anyt, where, "__any"), where, "left")
    j = j.withColumn("__best", F.coalesce("__same", "__any")).select("*", "__best.*")
    signed0 = lambda c: printed("%+.0f", F.rint(F.col(c)))
    what = F.when(F.col("comp").isNotNull(), F.concat(
        F.lit("\n"), F.col("comp"), F.lit(" increased discounting to "),
        printed("%.0f", F.rint(F.col("comp_current"))), F.lit("% ("), signed0("comp_change"),
        F.lit("%) in "), F.col("gc_city"))).otherwise(F.lit(""))
    why = F.when(F.col("comp").isNotNull(), F.concat(
        F.col("comp"), F.lit("'s MS increased to "), py_num("comp_share"), F.lit("% ("),
        signed0("comp_ms_delta"), F.lit("%) in "), F.col("gc_city"))).otherwise(F.lit(""))
    return j.select(*CITY, what.alias("what_happened"), why.alias("why_it_matters"),
                    pct_text("cat_wt_discounting_dr1").alias("wt_discounting_dr1"),
                    pct_text("cat_change_wt_discounting").alias("change_wt_discounting"),
                    pct_text("cat_share_dr1").alias("share_dr1"),
                    pct_text("cat_change_market_share").alias("pct_change"))


# ------------------------------------------------------------------ H17
def quoted_list(arr) -> F.Column:
    """``“a”`` or ``“a” and “b”`` from an array of at most two names (X23: one or two)."""
    q = F.transform(arr, lambda x: F.concat(F.lit("“"), x, F.lit("”")))
    return F.array_join(q, " and ")


def sov_recommendations(brand_rows: DataFrame, drivers: DataFrame, cat_metrics: DataFrame,
                        cities: DataFrame, tiers: DataFrame, merged_comp: DataFrame,
                        sku_cmp: DataFrame, contribution: DataFrame, kw_scores: DataFrame,
                        kw_recs: DataFrame, kw_low: DataFrame, kw_brand_change: DataFrame,
                        min_contribution: float = 5.0, restore_drop: float = -5.0) -> DataFrame:
    """SOV block per losing driver whose city-level overall SOV fell.

    * SKU: own SKU of the city with > 5 % contribution whose SOV and OSA both
      fell, largest contribution first;
    * target OSA: best competitor OSA in the city within the price tier, else
      any tier (D24, X21); when the brand already beats it, its previous level
      (X22); the restore line needs the SKU's OSA drop <= -5 and rounds the
      target up to a multiple of 5;
    * competitor: among the four largest competitors by share that raised ad
      SOV, the one that raised it most (F4); its keywords with rising ad SOV in
      the same platform x category x city (X20), best score first, one or two
      (X23);
    * keywords to bid (H12 recommendations) and one low-relevance keyword with
      ad spend to drop (ad SOV > 0, relevance < 0.5: top ten by ad SOV, lowest
      score first).
    """
    where = ["account", "gc_platform", "bgr", "gc_city"]
    rows = brand_rows.where(F.col("change_sov") < 0)
    ctx = driver_context(drivers, cat_metrics, cities, "sov")
    r = rows.select(*CITY, "ppu_category", "sov_dr1", "change_sov", "wt_osa_dr1", "change_wt_osa").join(
        ctx.drop("top_geo"), CAT)
    # SKU with the largest contribution among falling ones
    own_sku = (sku_cmp.join(contribution.select(*where, "product_id", "title", "contribution_pct"),
                            [*where, "product_id", "title"], "left")
               .where((F.col("contribution_pct") > min_contribution) & (F.col("change_sov") < 0)
                      & (F.col("change_wt_osa") < 0)))
    own_sku = top_k(own_sku, where, [F.col("contribution_pct").desc_nulls_last(), F.col("product_id")], 1,
                    rank_col=None, salt=SKEW_SALT).select(
        *where, "title", F.col("change_sov").alias("sku_change_sov"),
        F.col("change_wt_osa").alias("sku_change_wt_osa"))
    r = r.join(own_sku, where, "left")
    # target OSA from competitors of the city, same tier first
    t = tiers.where(F.col("is_own_brand") == 0).select(*CAT, F.col("ppu_category").alias("__tier"))
    mc = merged_comp.join(t, CAT, "left")
    tgt = (mc.join(r.select(*where, "ppu_category").distinct(), where)
           .groupBy(*where, "ppu_category").agg(
               F.coalesce(F.max(F.when(F.col("__tier") == F.col("ppu_category"), F.col("wt_osa_dr1"))),
                          F.max(F.when(F.col("__tier").isNotNull(), F.col("wt_osa_dr1")))).alias("__target")))
    r = r.join(tgt, [*where, "ppu_category"], "left")
    r = r.withColumn("target_osa", F.when(F.col("wt_osa_dr1") > F.col("__target"),
                                          F.col("wt_osa_dr1") - F.col("change_wt_osa"))
                     .otherwise(F.col("__target")))
    # competitor raising ad SOV (platform x category, like the reference)
    cand = mc.where((F.col("__tier").isNotNull()) & (F.col("change_adsov") > 0))
    g2 = ["account", "gc_platform", "bgr"]
    first4 = top_k(cand, g2, [F.col("share_dr1").desc_nulls_last(), F.col("brand"), F.col("gc_city")], 4,
                   rank_col=None)
    comp = top_k(first4, g2, [F.col("change_adsov").desc_nulls_last(), F.col("brand"), F.col("gc_city")], 1,
                 rank_col=None).select(*g2, F.col("brand").alias("comp_ms"))
    r = r.join(comp, g2, "left")
    # the competitor's rising keywords in the row's city
    kb = kw_brand_change.where(F.col("change_ad_sov") > 0).select(*where, "brand", "keyword")
    kb = kb.join(kw_scores.select(*where, "keyword", "final_score"), [*where, "keyword"], "left")
    kb = kb.join(r.select(*where, F.col("comp_ms").alias("brand")).distinct(), [*where, "brand"], "left_semi")
    kb2 = top_k(kb, where, [F.col("final_score").desc_nulls_last(), F.col("keyword")], 2, rank_col="__r")
    kbl = kb2.groupBy(*where).agg(F.array_sort(F.collect_list(F.struct("__r", "keyword"))).alias("__k"))
    r = r.join(kbl.select(*where, F.transform("__k", lambda x: x["keyword"]).alias("comp_keywords")), where, "left")
    r = r.join(kw_recs.select(*where, F.col("recommended_keywords").alias("rec_keywords")), where, "left")
    low = kw_low.where((F.col("ad_sov") > 0) & (F.col("relevant_score") < 0.5))
    low10 = top_k(low, where, [F.col("ad_sov").desc_nulls_last(), F.col("keyword")], 10, rank_col=None,
                  salt=SKEW_SALT)
    drop1 = top_k(low10, where, [F.col("final_score").asc_nulls_last(), F.col("keyword")], 1,
                  rank_col=None).select(*where, F.col("keyword").alias("drop_keyword"))
    r = r.join(drop1, where, "left")

    f1 = lambda c: printed("%.1f", pandas_round(c, 1))
    what1 = F.concat(F.lit("• Overall SOV dropped from "), f1(F.col("sov_dr1") - F.col("change_sov")),
                     F.lit("% to "), f1(F.col("sov_dr1")), F.lit("%"))
    what2 = F.when(F.col("top_city").isNotNull(),
                   F.concat(F.lit("• Top impacted geographies – "), F.col("top_city")))
    what = F.concat_ws("\n", what1, what2)
    rca = F.concat_ws("\n",
                      F.when(F.col("title").isNotNull(), F.concat(
                          F.lit("• "), F.col("title"), F.lit(" SOV declined "), f1(F.abs("sku_change_sov")),
                          F.lit("% due to OSA drop"))),
                      F.when(F.size(F.coalesce("comp_keywords", F.array())) > 0, F.concat(
                          F.lit("• "), F.col("comp_ms"), F.lit(" gained SOV on KWs – "),
                          quoted_list(F.col("comp_keywords")))),
                      what2)
    restore = F.when(F.col("title").isNotNull() & (F.col("sku_change_wt_osa") <= restore_drop)
                     & F.col("target_osa").isNotNull(), F.concat(
        F.lit("• "), F.col("title"), F.lit(": Restore OSA to "),
        (F.ceil(F.col("target_osa") / 5) * 5).cast("double").cast("string"), F.lit("% to improve organic SOV")))
    bid = F.when(F.size(F.coalesce("rec_keywords", F.array())) > 0, F.concat(
        F.lit("• Increase Ad SOV on "), quoted_list(F.slice("rec_keywords", 1, 2)), F.lit(" KWs")))
    drop = F.when(F.col("drop_keyword").isNotNull(), F.concat(F.lit("• Remove ad spends from "),
                                                              F.col("drop_keyword")))
    lines = F.filter(F.array(restore, bid, drop), lambda x: x.isNotNull())
    rec = F.when(F.size(lines) > 0, F.concat(F.lit("Sov Recommendation:\n"), F.array_join(lines, "\n"))) \
           .otherwise(F.lit(""))
    return r.select(*CITY, what.alias("what_happened"), rca.alias("rca"), rec.alias("recommendation"),
                    pct_text("cat_share_dr1").alias("share_dr1"),
                    pct_text("cat_change_market_share").alias("pct_change"),
                    pct_text("cat_sov_dr1").alias("sov_dr1_text"),
                    pct_text("cat_change_sov").alias("change_sov_text"))


# ------------------------------------------------------------------ H23
# Titles of the two blocks and the words of a line that moves.
BLOCK_TITLES = ("sov recommendation", "osa recommendation", "osa recommendations")
MOVING_WORDS = "restore osa"


def _block(col: str) -> F.Column:
    """A recommendation block as an array of (line, kind, name, body).

    The blocks are written by this module: a title, ``- name:`` headers and
    ``•`` points.  ``kind`` is title, header, point or text; ``name`` is what a
    header or point has before its first colon, ``body`` what follows it (the
    whole point without a colon)."""
    lines = F.filter(F.transform(F.split(F.coalesce(F.col(col), F.lit("")), "\n"), lambda s: F.trim(s)),
                     lambda s: s != "")

    def parsed(s):
        kind = (F.when(F.lower(F.rtrim(F.translate(s, ":", " "))).isin(*BLOCK_TITLES), "title")
                .when(s.startswith("-"), "header").when(s.startswith("•"), "point").otherwise("text"))
        marked = s.startswith("-") | s.startswith("•")
        rest = F.when(marked, F.trim(F.substr(s, F.lit(2)))).otherwise(s)
        colon = F.instr(rest, ":")
        return F.struct(s.alias("line"), kind.alias("kind"),
                        F.when(marked & (colon > 1), F.trim(F.substring_index(rest, ":", 1))).alias("name"),
                        F.when(colon > 0, F.trim(F.substr(rest, colon + 1))).otherwise(rest).alias("body"))
    return F.transform(lines, parsed)


def _subject(block: str, kind: str) -> F.Column:
    """Name of the first header (point) that has one."""
    return F.try_element_at(F.filter(block, lambda e: (e["kind"] == kind) & e["name"].isNotNull()), F.lit(1))["name"]


def _printed(lines: F.Column, titles: F.Column) -> F.Column:
    """Lines of a block as text; NULL when nothing but titles is left."""
    return F.when(F.size(lines) > titles, F.array_join(lines, "\n"))


def merge_recommendations(df: DataFrame, sov_col: str = "recommendation_sov",
                          osa_col: str = "recommendation_osa") -> DataFrame:
    """Move "restore OSA" lines from the SOV block into the OSA block.

    Both blocks are parsed, regrouped and printed again.  A moved line keeps its
    body: as a point when both blocks are about the same SKU or the SOV block
    names none, else under a header of its SKU.  A block of titles only is
    NULL, and rows without any recommendation are dropped (B16).
    """
    moves = lambda e: F.contains(F.regexp_replace(F.lower(e["line"]), r"\s+", " "), F.lit(MOVING_WORDS))
    d = df.withColumns({"__sov": _block(sov_col), "__osa": _block(osa_col)})
    d = d.withColumns({"__from": _subject("__sov", "point"), "__to": _subject("__osa", "header")})
    own_header = F.col("__from").isNotNull() & ~F.coalesce(F.col("__from") == F.col("__to"), F.lit(False))
    moved = F.transform(F.filter("__sov", moves), lambda e: F.when(
        own_header, F.concat(F.lit("- "), F.col("__from"), F.lit(": "), e["body"])).otherwise(
        F.concat(F.lit("• "), e["body"])))
    stays = F.filter("__sov", lambda e: ~moves(e))
    titles = lambda block: F.size(F.filter(block, lambda e: e["kind"] == "title"))
    line = lambda e: e["line"]
    d = d.withColumns({
        osa_col: _printed(F.concat(F.transform("__osa", line), moved), titles("__osa")),
        sov_col: _printed(F.transform(stays, line), titles(stays))}).drop("__sov", "__osa", "__from", "__to")
    both = F.concat_ws("\n\n", F.col(osa_col), F.col(sov_col))
    return d.where(both != "").withColumn("recommendation", both)
