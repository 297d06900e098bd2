"""Small SQL fragments shared by the oracle statements (DuckDB dialect)."""

from __future__ import annotations

# Fixed values of the registered queries: L1 (current) and L2 (comparison) windows.
L1 = ("2000-01-01", "2000-12-31")
L2 = ("1999-01-01", "1999-12-31")


def between(col: str, lo: str, hi: str) -> str:
    return f"{col} BETWEEN DATE '{lo}' AND DATE '{hi}'"


def label(col: str = "snapshot_date", first: str = "dr1", l1=L1, l2=L2) -> str:
    a = f"WHEN {between(col, *l1)} THEN 'dr1'"
    b = f"WHEN {between(col, *l2)} THEN 'dr2'"
    return f"CASE {a if first == 'dr1' else b} {b if first == 'dr1' else a} END"


def in_periods(col: str = "snapshot_date", l1=L1, l2=L2) -> str:
    return f"({between(col, *l1)} OR {between(col, *l2)})"


def null_least(a: str, b: str) -> str:
    return f"(CASE WHEN ({a}) IS NULL OR ({b}) IS NULL THEN NULL ELSE LEAST({a}, {b}) END)"


def null_greatest(a: str, b: str) -> str:
    return f"(CASE WHEN ({a}) IS NULL OR ({b}) IS NULL THEN NULL ELSE GREATEST({a}, {b}) END)"


def capped(col: str = "snapshot_date", till: str = "platform_offtake_uploaded_till",
           l1=L1, l2=L2) -> str:
    c2 = (f"{col} BETWEEN DATE '{l2[0]}' AND "
          + null_least(f"{till} - INTERVAL 1 MONTH", f"DATE '{l2[1]}'"))
    c1 = f"{col} BETWEEN DATE '{l1[0]}' AND " + null_least(till, f"DATE '{l1[1]}'")
    return f"(({c2}) OR ({c1}))"


def weight(*cols: str) -> str:
    c = f"COALESCE({', '.join(cols)})" if len(cols) > 1 else cols[0]
    return null_greatest(c, "1")


def safe_div(a: str, b: str) -> str:
    return f"(({a}) / NULLIF({b}, 0))"
