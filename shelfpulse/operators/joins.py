"""Join operators.

No operator here hints a broadcast of a side whose size grows with the data:
Catalyst/AQE broadcast a side only after measuring it under
``spark.sql.autoBroadcastJoinThreshold``, else they shuffle both sides on the
join keys (and AQE splits skewed partitions).  Only sides whose size is fixed
by construction (a literal spine, a one-row frame) are broadcast explicitly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def null_safe_on(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Join condition that matches NULL keys to NULL keys (pandas merge, N3)."""
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(right[k])
        cond = c if cond is None else cond & c
    return cond


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str],
                   how: str = "left") -> DataFrame:
    """Equi-join on ``keys`` with NULL = NULL, keeping one copy of each key."""
    r = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys],
                     *[c for c in right.columns if c not in keys])
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(r[f"__r_{k}"])
        cond = c if cond is None else cond & c
    out = left.join(r, cond, how)
    if how in ("right", "full", "outer", "full_outer"):
        for k in keys:
            out = out.withColumn(k, F.coalesce(left[k], F.col(f"__r_{k}")))
    return out.drop(*[f"__r_{k}" for k in keys])


def join_dim(fact: DataFrame, dim: DataFrame, keys: Sequence[str] | str = "product_id",
             how: str = "left") -> DataFrame:
    """Fact -> dimension lookup."""
    return fact.join(dim, list([keys] if isinstance(keys, str) else keys), how)


def keep_valid(fact: DataFrame, dim: DataFrame, key: str = "product_id",
               pred: Column | None = None) -> DataFrame:
    """Keep fact rows whose key is in the (filtered) dimension: a semi join."""
    d = dim if pred is None else dim.where(pred)
    return fact.join(d.select(key), key, "left_semi")


def keep_in(df: DataFrame, ids: DataFrame, keys: Sequence[str] | str) -> DataFrame:
    """``IN (subquery)`` as a semi join (C3); never a driver-side id list."""
    return df.join(ids, list([keys] if isinstance(keys, str) else keys), "left_semi")


def keep_groups(df: DataFrame, wanted: DataFrame, keys: Sequence[str],
                read_as: dict[str, Column] | None = None) -> DataFrame:
    """Rows of the groups in ``wanted`` (C3): the semi join of a later lookup, put below the
    aggregates the lookup reads.  It takes or leaves a group as a whole, so sums, shares and
    ranks within a group are those of all rows.  NULL keys match nothing, as in the lookup.

    ``read_as`` says how a key of ``df`` is read (say, in lower case) before it is looked up.
    """
    w = wanted.select(*[F.col(k).alias(f"__w_{k}") for k in keys])
    cond = [(read_as or {}).get(k, F.col(k)) == F.col(f"__w_{k}") for k in keys]
    return df.join(w, cond, "left_semi")


def lookup_flag(df: DataFrame, source: DataFrame, keys: Sequence[str],
                flag: str = "is_own_brand") -> DataFrame:
    """Left join to distinct (keys, flag); a key with two flags fans out."""
    return df.join(source.select(*keys, flag).distinct(), list(keys), "left")


def left_with_filter(left: DataFrame, right: DataFrame, keys: Sequence[str],
                     right_pred: Column) -> DataFrame:
    """Left join whose ON clause carries a constant predicate on the right."""
    return left.join(right.where(right_pred), list(keys), "left")


def on_spine(df: DataFrame, spine: DataFrame, keys: Sequence[str],
             defaults: dict | None = None) -> DataFrame:
    """Reindex to a fixed key list: spine left join data, missing -> default."""
    out = spine.join(df, list(keys), "left")
    return out.na.fill(defaults) if defaults else out


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key by an explicit order (D18 / C15 lookups)."""
    from pyspark.sql import Window
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")
