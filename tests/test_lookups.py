"""Stored keys: a lookup by name is pushed into Parquet, which skips what can't hold it."""

import pytest
from pyspark.sql import functions as F

from metaloom import index_queries
from metaloom.plans import build, catalog, sql


@pytest.fixture(scope="module")
def saved(spark, tmp_path_factory):
    return index_queries.index(spark, "/root/testdata/sf0.001").save(str(tmp_path_factory.mktemp("index")))


def scanned(df):
    """The rows that leave the scan of a plan without a shuffle, once it has run."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().get("numOutputRows").get().value()


def test_equality_is_pushed_and_skips(saved):
    name = saved.symbols.first()["name"]
    found = saved.symbols.where(build.named(saved.symbols, "symbols", name.upper())).select("name_key")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert f"EqualTo(name_key,{name.lower()})" in plan and scanned(found) > 0
    # between the least and the greatest name, so ranges don't tell; the Bloom filter does
    assert scanned(saved.symbols.where(build.named(saved.symbols, "symbols", name + "x")).select("name_key")) == 0
    assert "EqualTo(callee_key" in saved.edges.where(build.named(saved.edges, "edges", "red widget"))._jdf.queryExecution().executedPlan().toString()


def test_rows_are_the_same(spark, saved):
    plain = index_queries.index(spark, "/root/testdata/sf0.001")
    for ask in (lambda c: c.get_function_context("red widget"), lambda c: c.verify_call("Red Widget", "small ring"), lambda c: c.read_function("RED widget", include_body=False)):
        assert list(map(str, ask(catalog.Catalog(saved)).collect())) == list(map(str, ask(catalog.Catalog(plain)).collect()))


def test_a_lookup_groups_its_own_edges_alone(saved):
    """The one row is broadcast to the edges before they are grouped: nothing of other symbols is shuffled."""
    edges = catalog.Catalog._of(saved.edges, saved.symbols.limit(1)).groupBy("src_symbol_id").agg(F.collect_set("callee_name"))
    plan = edges._jdf.queryExecution().executedPlan().toString()
    assert plan.index("HashAggregate") < plan.index("BroadcastHashJoin") and "LeftSemi" in plan


def test_functions_of_a_stored_index(spark, saved):
    sql.register(saved, "saved_")
    placed = catalog.Catalog(saved).placed
    name = placed.first()["name"]
    got = spark.sql(f"SELECT count(*) AS n FROM saved_functions_named('{name.upper()}')").first()["n"]
    assert got == placed.where(F.col("name") == name).count() > 0
    found = spark.sql("SELECT name_key FROM saved_placed WHERE name_key = 'zzz'")
    assert "EqualTo(name_key,zzz)" in found._jdf.queryExecution().executedPlan().toString()
    assert spark.sql("SELECT * FROM saved_functions_like('%')").isEmpty()
