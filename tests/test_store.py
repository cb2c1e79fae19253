import os

import pytest
from conftest import SF
from test_semantic import BASE, CATALOG, star  # noqa: F401

from tidemark.plans import semantic as s
from tidemark.plans import store


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


SPECS = [
    BASE,
    {**BASE, "measures": ["energy", "intensity", "substance"], "dimensions": ["sector", "fy"], "shape": "comparison"},
    {"measures": ["substance"], "dimensions": ["company"], "shape": "ranking", "sort": {"direction": "asc"}, "limit": 2},
    {"measures": ["energy"], "dimensions": ["fy", "assurance_status"], "shape": "timeseries", "limit": 250},
    {**BASE, "filters": [{"dimension": "fy", "operator": "gte", "value": 2025}, {"dimension": "sector", "operator": "in", "value": ["S2", "S9"]}]},
    {**BASE, "measures": ["substance"], "filters": [{"dimension": "completeness", "operator": "score_band", "value": [2, 6]}]},
]


@pytest.mark.parametrize("spec", SPECS)
def test_same_answers_with_and_without_the_store(spark, star, tmp_path, spec):  # noqa: F811
    metrics, scores, companies = star
    more = spark.createDataFrame(
        [(1, None, "energy", 9.0, "n1"), (2, 2024, "energy", None, "n2"), (77, 2025, "energy", 5.0, "unknown"), (None, 2025, "energy", 5.0, "null"), (3, 2024, "intensity", 2.5, "n3"), (4, 2025, "energy", 4.0, "p4")],
        metrics.schema,
    )
    metrics = metrics.unionByName(more)
    facts = store.FactStore(spark, str(tmp_path)).publish("k", store.dimensioned_facts(metrics, scores, companies))
    rows = lambda result: sorted(map(repr, result.data.collect()))
    assert rows(store.answer(facts, spec, "pro", CATALOG))
    assert rows(store.answer(facts, spec, "pro", CATALOG)) == rows(s.semantic_query(metrics, scores, companies, spec, "pro", CATALOG))


def test_empty_tables_give_an_empty_build(spark, star, tmp_path):  # noqa: F811
    none = [df.limit(0) for df in star]
    facts = store.FactStore(spark, str(tmp_path)).publish("k", store.dimensioned_facts(*none))
    assert store.answer(facts, BASE, "pro", CATALOG).data.collect() == []


def test_a_build_is_made_once_for_each_state_of_its_input(spark, star, tmp_path):  # noqa: F811
    facts, source, calls = store.dimensioned_facts(*star), f"{tmp_path}/in", []
    shelf = store.FactStore(spark, f"{tmp_path}/store")
    spark.range(5).write.parquet(source)

    def ask(settings):
        return shelf.ensure(store.fingerprint(spark, [source], settings), lambda: calls.append(settings) or facts).inputFiles()

    first = ask({"minimum": 5})
    assert first == ask({"minimum": 5}) and len(calls) == 1
    assert ask({"minimum": 6}) != first and len(calls) == 2
    spark.range(6).write.mode("append").parquet(source)
    assert ask({"minimum": 5}) != first and len(calls) == 3
    assert shelf.find("another") is None


def test_content_is_of_rows_and_settings_in_any_order(spark):
    df = spark.range(50).selectExpr("id % 7 AS a", "cast(id AS string) AS b")
    same = store.content([df], {"x": 1})
    assert same == store.content([df.repartition(7, "b")], {"x": 1})
    others = [store.content([df], {"x": 2}), store.content([df.where("b <> '3'")], {"x": 1}), store.content([df.withColumnRenamed("a", "c")], {"x": 1}), store.content([df, df], {"x": 1})]
    assert len({same, *others}) == 5


def test_a_build_without_its_line_is_not_seen(spark, star, tmp_path):  # noqa: F811
    shelf = store.FactStore(spark, str(tmp_path))
    assert shelf.find("k") is None
    shelf.publish("k", store.dimensioned_facts(*star))
    shelf.publish("k", store.dimensioned_facts(*star))  # a second writer of the same build
    assert shelf.find("k").count() == 18
    assert len([name for name in os.listdir(tmp_path) if name.startswith("facts-")]) == 2


@pytest.mark.parametrize(("name", "measures", "exchanges"), [("q5_grouped_average", 1, 1), ("q8_multi_measure", 3, 3), ("a6_top_k_ranking", 1, 0)])
def test_plans_read_the_store_only(spark, name, measures, exchanges):
    from tidemark import catalog

    catalog.load_all()

    plan = plan_of(catalog.QUERIES[name](spark, SF))
    assert "lineitem" not in plan and "Join" not in plan and "BroadcastExchange" not in plan
    assert plan.count("Exchange hashpartitioning") == exchanges and plan.count("FileScan parquet") == measures
    assert plan.count("PartitionFilters: [isnotnull(measure") == measures
