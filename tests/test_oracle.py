"""Registered queries against their DuckDB oracle on the smallest scale factor."""

import pytest

from shelfpulse.checks import compare, registry

SMALL = "/root/testdata/sf0.001"
KEYS = ["market_share", "share_impact_city_brand", "brand_metrics_change", "category_metrics",
        "compare_periods", "price_tier_quantile", "keyword_scores", "keyword_recs", "pareto_tags",
        "sku_osa", "worst_categories", "rising_competitors", "offtake_summary", "impact_text",
        "top_geo", "format_change", "html_list_items", "account_config", "report_row_accounts",
        "what_happened", "text_rules", "new_store_coverage", "new_launches_registry", "competitor_sku"]


@pytest.fixture(scope="module")
def duck():
    return compare.duck_con(SMALL)


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, duck, key):
    registry.load_all()
    sdf = registry.QUERIES[key](spark, SMALL)
    srows = [tuple(r) for r in sdf.collect()]
    res = duck.execute(registry.ORACLE[key])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(sdf.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert compare._rows(sdf.columns, srows, False) == compare._rows(dcols, drows, False)


def test_every_query_has_a_key_and_runs_lazily(spark):
    registry.load_all()
    assert len(registry.QUERIES) >= 100
    assert set(registry.ORACLE) <= set(registry.QUERIES)
