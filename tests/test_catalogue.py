"""Every query of the library against its SQL, and a look at what has none."""

import pytest

from tidegate.plans import catalogue, places


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_matches_sql(spark, sf_dir, same_rows, name):
    same_rows(catalogue.QUERIES[name](spark, sf_dir), catalogue.ORACLES[name])


def test_display_order_shows_each_option_once_and_keeps_its_rules(spark, sf_dir):
    """A query without SQL: its order is held to the rules one by one; small cases are in test_operators."""
    shown = catalogue.QUERIES["diverse_order"](spark, sf_dir).toPandas()
    rows = places.displayable(spark, sf_dir).toPandas().merge(shown, on=["request_id", "option_id"])
    assert set(catalogue.QUERIES) - set(catalogue.ORACLES) == {"diverse_order", "outings_apart", "new_places_apart"}  # the latter two: test_sky
    assert len(rows) == len(shown)
    for _, g in rows.sort_values("shown").groupby("request_id"):
        assert g["shown"].tolist() == list(range(1, len(g) + 1)) and g["venue_id"].is_unique
        assert g.iloc[0]["merit"] == g[(g["standing"] == g.iloc[0]["standing"]) & ~g["off"] & ((g["taste"] > 0.5) | ~(g["taste"] > 0.5).any())]["merit"].max() or g.iloc[0]["taste"] >= 0.5
        late = g[g["shown"] > 3]
        assert (late["standing"] == "ready").tolist() == sorted((late["standing"] == "ready").tolist(), reverse=True) or g["taste"].max() > 0.5


def test_same_shows_come_from_all_occurrences(spark):
    got = catalogue.QUERIES["fuzzy_same_show"](spark, "/root/testdata/sf0.01").collect()  # sf0.001 has no pair
    assert len(got) == 4 and any(r.a_id % 4 > 1 or r.b_id % 4 > 1 for r in got)  # DuckDB without the filter: 4, with it: 2


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_radius_filter_is_no_cross_join(spark, sf_dir):
    plan = catalogue.QUERIES["radius_pairs"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
