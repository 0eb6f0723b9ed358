"""Every query against its SQL in a second engine, on the driver's smallest tables."""

import os

import duckdb
import numpy as np
import pytest

from factloom.plans.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def other():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def rows_of(frame, columns):
    values = frame[columns].astype(object)
    return sorted(map(repr, values.where(frame[columns].notna(), None).values.tolist()))


def test_halves_are_rounded_as_by_the_sql(spark, tmp_path):
    """Prices on half a unit of the value: a cast of the second engine takes them to the even number."""
    con = duckdb.connect()
    con.execute("create table orders as select i::bigint as o_orderkey, 1::bigint as o_custkey, [20000, 25000, 60000, 75000, 110000, 125000, 130000][1 + i % 7]::double as o_totalprice, timestamp '1995-01-01' as o_orderdate from range(14) t(i)")
    con.execute(f"copy orders to '{tmp_path}/orders.parquet'")
    mine, theirs = QUERIES["reconciled_candidates"](spark, str(tmp_path)).toPandas(), con.execute(SQL["reconciled_candidates"]).df()
    assert rows_of(mine, sorted(theirs.columns)) == rows_of(theirs, sorted(theirs.columns))


def test_rules_parse_a_text_once(spark):
    plan = QUERIES["rule_decisions"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan and QUERIES["rule_decisions"](spark, DATA).count() > 0


#: What the rows of a query say of its cases, as SQL of the second engine over the result ``t``.
CASES = {
    "quote_verdicts": "count(*) filter (snippet is null) > 0 and max(length(snippet)) > 100",
    "model_replies": "count(distinct relation_type) = 4 and max(confidence) = 1 and min(confidence) = 0",
    "entity_mentions": "count(*) > 1000 and count(*) filter (context is null) > 0 and count(*) filter (type is not null and name = 'Unknown Entity') > 0",
    "stage_states": "count(distinct parse) = 3 and count(distinct line) = 4",
    "rule_ladder": "count(distinct reason) = 2 and count(*) filter (contains(explanation, 'qualifier')) > 0",
    "name_pairs": "count(*) filter (form = '' and merges) > 0 and count(*) filter (form = '' and not merges) > 0 and count(*) filter (form like '% ltd') > 0",
    "period_forms": "count(*) filter (period = '') > 0 and count(*) filter (starts_with(period, 'CY')) > 0 and count(*) filter (starts_with(period, 'long ')) > 0",
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_query_has_its_cases(spark, name):
    t = QUERIES[name](spark, DATA).toPandas()  # noqa: F841 - read by its name
    assert duckdb.connect().execute(f"select {CASES[name]} from t").fetchone()[0]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, other, name):
    mine, theirs = QUERIES[name](spark, DATA).toPandas(), other.execute(SQL[name]).df()
    columns = sorted(theirs.columns)
    assert sorted(mine.columns) == columns
    assert rows_of(mine, columns) == rows_of(theirs, columns)


def test_every_vector_asks_for_its_neighbours(spark, tmp_path):
    """All vectors are queries; rows without a distance come last in both engines, also where there are few others."""
    rng = np.random.default_rng(11)
    rows = [(i, i % 3, rng.normal(size=4).round(3).tolist()) for i in range(60)] + [(i, 3, rng.normal(size=4).round(3).tolist()) for i in range(60, 66)]
    odd = [None, [0.0] * 4, None, [0.0] * 4, [float("nan"), 1.0, 0.0, 0.0], [0.0] * 4]
    rows += [(70 + i, 3 if i else 2, v) for i, v in enumerate(odd)] + [(80, None, [1.0] * 4), (None, 3, [1.0] * 4)]
    spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>").repartition(2).write.parquet(f"{tmp_path}/embeddings.parquet")
    mine = QUERIES["knn_same_entity"](spark, str(tmp_path)).toPandas()
    c = duckdb.connect()
    c.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    theirs = c.execute(SQL["knn_same_entity"]).df()
    assert rows_of(mine, list(theirs.columns)) == rows_of(theirs, list(theirs.columns))
    assert set(mine["query"]) == {*range(66), *range(70, 76)} and len(mine) == 72 * 10
