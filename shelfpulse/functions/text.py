"""Text and JSON column functions.

All are JVM-side column expressions (whole-stage codegen), no Python UDFs.
Formatting rounds first (SQL half-up) and then prints with a fixed number of
decimals, so the text is the same in Spark and in the DuckDB oracle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfpulse.functions.exprs import col_of, pandas_round

# Currency sign, arrows, unit thresholds and suffixes of the report text.
RUPEE = "₹"
UP = "↑"
DOWN = "↓"
CRORE = 1e7
LAKH = 1e5


def printed(pattern: str, x: Column) -> Column:
    """``x`` printed by a format pattern; NULL stays NULL (Spark would print ``n``)."""
    return F.when(x.isNotNull(), F.format_string(pattern, x))


def fixed(c, decimals: int = 1) -> Column:
    """``x`` printed with ``decimals`` decimals after SQL rounding."""
    return printed(f"%.{decimals}f", F.round(col_of(c).cast("double"), decimals))


def fmt_amount(c, style: str = "default") -> Column:
    """Amount text (K1): >= 1e7 -> ``x/1e7`` + ``Cr`` else ``x/1e5`` + ``L``.

    Styles: ``default`` (``₹1.2 Cr `` with a trailing space, ``₹1.2 L``),
    ``nospace`` (no trailing space), ``nosign`` (no currency sign),
    ``lakh`` (always lakh).
    """
    x = col_of(c).cast("double")
    sign = "" if style == "nosign" else RUPEE
    cr_suffix = " Cr" if style in ("nospace", "nosign") else " Cr "
    lakh = F.concat(F.lit(sign), fixed(x / LAKH), F.lit(" L"))
    if style == "lakh":
        return lakh
    return F.when(x >= CRORE, F.concat(F.lit(sign), fixed(x / CRORE), F.lit(cr_suffix))).otherwise(lakh)


def fmt_change(c, style: str = "default") -> Column:
    """``(↑ amount)`` when positive, ``(↓ amount)`` otherwise (K2)."""
    x = col_of(c).cast("double")
    amt = fmt_amount(F.abs(x), style)
    return F.when(x > 0, F.concat(F.lit(f"({UP} "), amt, F.lit(")"))) \
            .otherwise(F.concat(F.lit(f"({DOWN} "), amt, F.lit(")")))


def fmt_pct(c, change=None, label: str | None = None) -> Column:
    """``12.3%``; with ``change``: ``12.3% (↑1.2%)``; with ``label``: ``MS 12.3% (↑1.2%)`` (K3)."""
    v = F.concat(fixed(c), F.lit("%"))
    if change is not None:
        ch = col_of(change).cast("double")
        arrow = F.when(ch > 0, F.lit(UP)).otherwise(F.lit(DOWN))
        v = F.concat(v, F.lit(" ("), arrow, fixed(F.abs(ch)), F.lit("%)"))
    if label:
        v = F.concat(F.lit(label + " "), v)
    return v


def month_name(c, short: bool = False) -> Column:
    """Month name of a date, or of a month number 1-12 (K4)."""
    x = col_of(c)
    return F.date_format(x, "MMM" if short else "MMMM")


def domain_of(c) -> Column:
    """Text before the first dot (K5)."""
    return F.split(col_of(c), r"\.").getItem(0)


def capitalise(c) -> Column:
    """First letter upper, rest lower (Python ``str.capitalize``) (K5)."""
    x = col_of(c)
    return F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 2147483647)))


def json_field(c, path: str) -> Column:
    """``config->>'name'`` (K6)."""
    return F.get_json_object(col_of(c), path)


# Flag name prefix and default platforms of the job config.
FLAG_PREFIX = "build_normalized_offtake_"
DEFAULT_PLATFORMS = ("blinkit", "instamart", "zepto")


def json_flags(c, prefix: str = FLAG_PREFIX, platforms: Sequence[str] = DEFAULT_PLATFORMS) -> list[Column]:
    """Build flags from a job-config JSON (K7).

    Returns ``[name, build_<p> ...]`` columns.  The text is read as a VARIANT, entry by
    entry, so an entry or field of another type is no flag and spoils no other; texts such
    as "true" count as booleans.  Broken JSON or missing keys give an empty name and
    all-false flags (X16); when a name repeats, the last entry wins (like a dict update).
    """
    cfg = F.try_parse_json(col_of(c))
    entries = F.coalesce(F.try_variant_get(cfg, "$.dbt.variables", "array<variant>"), F.array().cast("array<variant>"))
    named = F.transform(entries, lambda e: F.struct(F.try_variant_get(e, "$.name", "string").alias("name"),
                                                    F.try_variant_get(e, "$.value", "boolean").alias("value")))
    out = [F.coalesce(F.try_variant_get(cfg, "$.redshift.database", "string"), F.lit("")).alias("name")]
    for p in platforms:
        values = F.filter(named, _is_named(prefix + p))
        out.append(F.coalesce(F.try_element_at(values, F.lit(-1))["value"], F.lit(False)).alias(f"build_{p}"))
    return out


def _is_named(name: str):
    return lambda e: e["name"] == F.lit(name)


def relevance(cat_share, vol_share) -> Column:
    """``round(cat_share / vol_share, 2)``, 0 when the divisor is 0 (K12, pandas rounding)."""
    v = col_of(vol_share).cast("double")
    return F.when(v == 0, F.lit(0.0)).otherwise(
        pandas_round(F.try_divide(col_of(cat_share).cast("double"), v), 2))


def kw_score(vol_share, rel) -> Column:
    """``vol_share * log1p(relevance)`` (K12), not rounded."""
    return col_of(vol_share).cast("double") * F.log1p(col_of(rel).cast("double"))
