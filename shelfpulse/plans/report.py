"""Report assembly: platform summary (H15), marker families (H24), the one-row-per-
account report (H25), template rendering (A12) and account configuration
(A13, A14).

Everything stays long and lazy -- ``(account, marker, value)`` rows -- until
the final pivot to the fixed marker list, so all accounts are built by one job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfpulse.functions.text import capitalise, domain_of, fixed, fmt_amount, fmt_change, json_field, printed

def platform_offtake(ms: DataFrame) -> DataFrame:
    """Own sales per account x platform in both periods (D15 pivot with 0 fill)."""
    own = ms.where(F.col("is_own_brand") == 1).withColumn(
        "__v", F.col("actual_sum").cast("decimal(38,6)"))
    p = own.groupBy("account", "gc_platform").agg(
        F.coalesce(F.sum(F.when(F.col("date_period") == "dr1", F.col("__v"))).cast("double"), F.lit(0.0)).alias("offtake_dr1"),
        F.coalesce(F.sum(F.when(F.col("date_period") == "dr2", F.col("__v"))).cast("double"), F.lit(0.0)).alias("offtake_dr2"))
    return p.withColumn("offtake_change", F.col("offtake_dr1") - F.col("offtake_dr2"))


def first_per_platform(drivers: DataFrame, order: Sequence[Column], label: str) -> DataFrame:
    """First driver category per account x platform with ``category(x.x%)`` text."""
    w = Window.partitionBy("account", "gc_platform").orderBy(*order)
    d = drivers.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") == 1)
    return d.select("account", "gc_platform", F.col("bgr").alias(f"{label}_bgr"),
                    F.col("pct_change").alias(f"{label}_change"),
                    F.concat(F.col("bgr"), F.lit("("), fixed("pct_change"), F.lit("%)")).alias(label))


def gain_drain_merge(best: DataFrame, worst: DataFrame) -> DataFrame:
    """Top gaining and draining category per platform.

    Full outer merge on the platform with blanks / zeros filled; when the same
    category (also: both missing) is on both sides, the drainer is blanked if
    the gainer's change is positive, else the gainer is blanked.
    """
    g = first_per_platform(best, [F.col("sales_impact").desc_nulls_last(), F.col("bgr"),
                                  F.col("brand")], "gainers")
    d = first_per_platform(worst, [F.col("sales_impact").asc_nulls_last(), F.col("bgr"),
                                   F.col("brand")], "drainers")
    m = g.join(d, ["account", "gc_platform"], "full")
    m = (m.na.fill({"gainers_bgr": "", "drainers_bgr": "", "gainers": "", "drainers": ""})
         .na.fill({"gainers_change": 0.0, "drainers_change": 0.0}))
    same = F.col("gainers_bgr") == F.col("drainers_bgr")
    pos = F.col("gainers_change") > 0
    return m.select("account", "gc_platform",
                    F.when(same & ~pos, F.lit("")).otherwise(F.col("gainers")).alias("gainers"),
                    F.when(same & pos, F.lit("")).otherwise(F.col("drainers")).alias("drainers"))


def offtake_summary(ms: DataFrame, best: DataFrame, worst: DataFrame) -> DataFrame:
    """Per account x platform: own sales now, before (text), change text, top
    gainer and drainer category (H15).

    Sales sums are the own-brand ``actual_sum`` of each period (pivot with 0
    fill, D15); platforms without drivers get blanks (outer merge, C14).
    """
    base = platform_offtake(ms)
    cat = gain_drain_merge(best, worst)
    j = base.join(cat, ["account", "gc_platform"], "left").na.fill({"gainers": "", "drainers": ""})
    return j.select("account", "gc_platform", F.col("offtake_dr1").alias("offtake"),
                    fmt_amount("offtake_dr2").alias("prev_offtake"),
                    fmt_change("offtake_change").alias("share_delta"),
                    "gainers", "drainers")


def platform_mix(ms: DataFrame, n: int = 3) -> DataFrame:
    """Total change and platform shares in both periods, top ``n`` platforms.

    The reference reads month numbers nobody produces (X12); here the two
    periods are the two columns.  Shares use SQL rounding to one decimal; the
    top platforms are the ``n`` largest by combined sales (F6).
    """
    v = F.col("actual_sum").cast("decimal(38,6)")
    p = ms.groupBy("account", "gc_platform").agg(
        F.coalesce(F.sum(F.when(F.col("date_period") == "dr2", v)), F.lit(0)).alias("__m1"),
        F.coalesce(F.sum(F.when(F.col("date_period") == "dr1", v)), F.lit(0)).alias("__m2"))
    wa = Window.partitionBy("account")
    t1 = F.sum("__m1").over(wa)
    t2 = F.sum("__m2").over(wa)
    d = (p.withColumn("share_dr2", F.round(F.try_divide(100 * F.col("__m1").cast("double"), t1.cast("double")), 1))
         .withColumn("share_dr1", F.round(F.try_divide(100 * F.col("__m2").cast("double"), t2.cast("double")), 1))
         .withColumn("total_change_pct", F.round(F.try_divide(
             100 * (t2 - t1).cast("double"), t1.cast("double")), 1)))
    d = d.withColumn("share_delta", F.col("share_dr1") - F.col("share_dr2"))
    w = Window.partitionBy("account").orderBy((F.col("__m1") + F.col("__m2")).desc(), F.col("gc_platform"))
    d = d.withColumn("platform_rank", F.row_number().over(w).cast("bigint")).where(F.col("platform_rank") <= n)
    return d.select("account", "gc_platform", "platform_rank",
                    F.col("__m1").cast("double").alias("offtake_dr2"),
                    F.col("__m2").cast("double").alias("offtake_dr1"),
                    "share_dr2", "share_dr1", "share_delta", "total_change_pct")


def to_markers(df: DataFrame, prefix: str, order: Sequence[Column], cols: Sequence[str],
               slots: int, key: str = "account", sep: str = "") -> DataFrame:
    """Rank rows into ``slots`` per account and flatten to markers.

    Slot ``s`` (1-based) column ``c`` (index ``i``) becomes marker
    ``prefix + sep + str((s - 1) * len(cols) + i + 1)``.  Empty slots are
    filled by the final pivot with blanks.  Output: (account, marker, value).
    """
    w = Window.partitionBy(key).orderBy(*order)
    d = df.withColumn("__slot", F.row_number().over(w)).where(F.col("__slot") <= slots)
    n = len(cols)
    types = dict(df.dtypes)

    def text(c):
        # numbers print with one decimal (the report's convention), text as is
        return fixed_pandas(F.col(c)) if types[c] in ("double", "float") else F.col(c).cast("string")
    items = F.array(*[F.struct(F.lit(i).alias("i"), text(c).alias("v")) for i, c in enumerate(cols)])
    e = d.select(key, "__slot", F.explode(items).alias("__it"))
    marker = F.concat(F.lit(prefix + sep),
                      ((F.col("__slot") - 1) * n + F.col("__it.i") + 1).cast("string"))
    return e.select(key, marker.alias("marker"), F.coalesce(F.col("__it.v"), F.lit("")).alias("value"))


def on_spine(df: DataFrame, platforms: Sequence[str], key: str = "account") -> DataFrame:
    """One row per account and platform of the report's fixed list, in its order
    (``place``); platforms without a row get NULLs, none is left out."""
    spine = df.select(key).distinct().select(
        key, F.posexplode(F.array(*map(F.lit, platforms))).alias("place", "gc_platform"))
    return spine.join(df, [key, "gc_platform"], "left")


def known_platforms(df: DataFrame, platforms: Sequence[str], col: str = "gc_platform") -> DataFrame:
    """``df`` as it is; a row of a platform that the report has no place for ends the job with
    that platform's name, as it would be left out of the report without a word.  NULL and the
    platforms of the list pass."""
    c = F.col(col)
    unknown = F.raise_error(F.concat(F.lit("platform without a place in the report: "), c)).cast("string")
    return df.withColumn(col, F.when(c.isNull() | c.isin(*platforms), c).otherwise(unknown))


def platform_prefixes(platforms: Sequence[str]) -> dict[str, str]:
    """The marker prefix of each platform: as many of its first letters, in upper case, as tell
    it from the others (one where the initials differ).  A name that begins another one has no
    such letters and is rejected, as is a name that comes twice."""
    out = {}
    for p in platforms:
        others = [q.upper() for q in platforms if q is not p]
        n = next((n for n in range(1, len(p) + 1) if not any(q.startswith(p[:n].upper()) for q in others)), None)
        if n is None:
            raise ValueError(f"no marker prefix tells platform {p!r} from the others")
        out[p] = p[:n].upper()
    return out


def platform_markers(df: DataFrame, prefixes: dict[str, str], order: Sequence[Column], cols: Sequence[str],
                     slots: int = 2, key: str = "account", numbers: Sequence[int] | None = None) -> DataFrame:
    """The first ``slots`` rows of every account and platform as markers (H24):
    ``<platform's prefix><slot>_<field number>``; fields count from 1 unless ``numbers``
    says otherwise.  Output: (account, marker, value)."""
    numbers = numbers or range(1, len(cols) + 1)
    w = Window.partitionBy(key, "gc_platform").orderBy(*order)
    names = F.create_map(*[F.lit(x) for pair in prefixes.items() for x in pair])
    types = dict(df.dtypes)
    text = lambda c: fixed_pandas(F.col(c)) if types[c] in ("double", "float") else F.col(c).cast("string")
    items = F.array(*[F.struct(F.lit(i).alias("i"), text(c).alias("v")) for i, c in zip(numbers, cols)])
    d = (df.withColumn("__slot", F.row_number().over(w)).where(F.col("__slot") <= slots)
         .select(key, F.try_element_at(names, F.col("gc_platform")).alias("__p"), "__slot", F.explode(items).alias("__it"))
         .where(F.col("__p").isNotNull()))
    return d.select(key, F.concat("__p", F.col("__slot").cast("string"), F.lit("_"), F.col("__it.i").cast("string"))
                    .alias("marker"), F.coalesce(F.col("__it.v"), F.lit("")).alias("value"))


def fixed_pandas(c) -> Column:
    """``x`` rounded half-to-even on its binary value (numpy) and printed with one decimal."""
    return printed("%.1f", F.rint(c * 10.0) / 10.0)


def marker_names(prefix: str, n_cols: int, slots: int, sep: str = "") -> list[str]:
    return [f"{prefix}{sep}{i}" for i in range(1, n_cols * slots + 1)]


def report_row(markers_long: DataFrame, names: Sequence[str], key: str = "account") -> DataFrame:
    """One wide row per account with the full fixed marker list, blanks for missing.

    ``pivot`` with an explicit value list: one aggregate, no distinct-values job.
    """
    wide = markers_long.groupBy(key).pivot("marker", list(names)).agg(F.first("value"))
    return wide.select(key, *[F.coalesce(F.col(f"`{n}`"), F.lit("")).alias(n) for n in names])


def render_templates(templates: DataFrame, values: DataFrame, leave_missing: bool = False,
                     key: str = "account") -> DataFrame:
    """Fill ``{{ key }}`` placeholders per account and slide.

    ``templates`` carries the account it is rendered for (one template set per
    account, as the reference fills one deck per account), so rendering is an
    equi-join on (account, marker) -- no template x account product.

    Values are gathered into one map per account (as many entries as the report has markers)
    and joined to the templates, which are dealt by slide once and then filled row by row, in
    more tasks than the file has row groups: no text is exploded, and no join deals texts by
    marker, of which there are few.  The pieces of all rows of a slide are then
    put in one order, by place and text.  A missing key renders blank, or stays as
    written with ``leave_missing``.  ``keep`` tells whether any placeholder of the slide got a
    non-blank value; slides with no placeholder count as kept, NULL texts make no slide.
    """
    pat = r"\{\{\s*([^}]*?)\s*\}\}"
    found = (values.where(F.col(key).isNotNull() & F.col("marker").isNotNull())
             .groupBy(key, "marker").agg(F.collect_list(F.struct("value")).alias("__values"))
             .groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("marker", "__values"))).alias("__map")))
    t = (templates.where(F.col("text").isNotNull()).repartition(key, "slide_id")
         .select(key, "slide_id", "text", F.regexp_extract_all("text", F.lit(pat), 1).alias("__keys"))
         .join(found, key, "left"))
    none = F.array(F.struct(F.lit(None).cast("string").alias("value")))
    # per placeholder its name and values (one NULL where it has none)
    filled = F.transform("__keys", lambda k: F.struct(
        k.alias("k"), F.coalesce(F.try_element_at(F.col("__map"), k), none).alias("v")))
    t = t.select(key, "slide_id", F.split("text", pat).alias("__parts"), filled.alias("__filled"))
    shown = lambda f, v: F.coalesce(v["value"], F.concat(F.lit("{{"), f["k"], F.lit("}}")) if leave_missing else F.lit(""))
    piece = lambda i, x: F.struct(i.alias("pos"), x.alias("piece"))
    # the part before each placeholder with each of its values, then the part after the last one
    pieces = F.flatten(F.transform("__parts", lambda part, i: F.when(
        i < F.size("__filled"), F.transform(F.get("__filled", i)["v"], lambda v: piece(i, F.concat(part, shown(F.get("__filled", i), v)))))
        .otherwise(F.array(piece(i, part)))))
    some = F.exists("__filled", lambda f: F.exists(f["v"], lambda v: F.trim(F.coalesce(v["value"], F.lit(""))) != ""))
    out = t.select(key, "slide_id", pieces.alias("__pieces"), (F.size("__filled") == 0).alias("__bare"), some.alias("__some"))
    # rows of the same slide are one slide
    out = out.groupBy(key, "slide_id").agg(
        F.array_join(F.transform(F.array_sort(F.flatten(F.collect_list("__pieces"))), lambda p: p["piece"]), "").alias("rendered"),
        F.min("__bare").alias("__bare"), F.max("__some").alias("__some"))
    return out.select(key, "slide_id", "rendered", (F.col("__bare") | F.col("__some")).alias("keep"))


def account_config(configs: DataFrame, accounts: DataFrame, config_type: str | None = None,
                   field: str = "$.model_name") -> DataFrame:
    """Configs of a type with a JSON field, left-joined to accounts, with the
    e-mail domain (text before the first dot) and constant build flags (A13)."""
    c = configs if config_type is None else configs.where(F.col("config_type") == config_type)
    c = c.select("account_id", json_field("config", field).alias("db_name"))
    a = accounts.select(F.col("id").alias("account_id"), "primary_email_domain")
    j = c.join(a, "account_id", "left")
    return j.select("account_id", "db_name", "primary_email_domain",
                    domain_of("primary_email_domain").alias("domain"),
                    capitalise(domain_of("primary_email_domain")).alias("brand_name"),
                    F.lit(True).alias("build_blinkit"))


def account_options(cfg: DataFrame, domains: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Distinct sorted domains, and the databases of the chosen domains (all when none)."""
    dom = cfg.where(F.col("domain").isNotNull()).select("domain").distinct().orderBy("domain")
    sel = cfg if not domains else cfg.where(F.col("domain").isin(*domains))
    dbs = sel.where(F.col("db_name").isNotNull()).select("domain", "db_name").distinct()
    return dom, dbs
