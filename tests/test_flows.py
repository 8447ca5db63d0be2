"""Flows as tables, replay from the nearest stored rows, dependent states in order, sources by name."""

import pytest
from pyspark.sql import functions as F

from tessera.sources.registry import SourceRegistry
from tessera.sources.states import StateStore


@pytest.fixture
def store(spark, tmp_path):
    s = StateStore(spark, f"file://{tmp_path}")
    s.ran = []

    def step(name, f):
        def run(df, **kw):
            s.ran.append(name)
            return f(df, **kw)

        s.register(name, run)

    step("over", lambda df, least: df.where(F.col("x") >= least))
    step("double", lambda df: df.withColumn("x", F.col("x") * 2))
    step("both", lambda df, other: df.unionByName(other))
    return s


def xs(df):
    return sorted(r["x"] for r in df.collect())


def test_a_flow_is_a_table_that_outlives_its_states(spark, store):
    ids = store.run_flow_saved(spark.range(10).withColumnRenamed("id", "x"), [("over", {"least": 4}), ("double", {})], "numbers")
    assert [xs(store.load(k)) for k in ids] == [list(range(10)), list(range(4, 10)), list(range(8, 20, 2))]
    flow = store.flow_from_path(ids[-1])
    assert [(r["step"], r["operation"], r["params"], r["state_id"]) for r in flow.orderBy("step").collect()] == [(1, "over", '{"least": 4}', ids[1]), (2, "double", "{}", ids[2])]
    store.save_flow("big", flow)
    store.delete(ids[0])
    assert store.states.count() == 0
    assert xs(store.run_flow(spark.range(5, 7).withColumnRenamed("id", "x"), store.flow("big"))) == [10, 12]
    assert store.flow_from_path("nowhere").count() == 0


def test_replay_starts_at_the_nearest_stored_rows(spark, store):
    ids = store.run_flow_saved(spark.range(10).withColumnRenamed("id", "x"), [("over", {"least": 4}), ("double", {}), ("over", {"least": 11})], "numbers")
    store.ran.clear()
    assert xs(store.replay(ids[3])) == [12, 14, 16, 18] and store.ran == []
    store.drop_data(ids[3])
    assert store.nearest_snapshot(ids[3]) == (ids[2], [("over", {"least": 11})])
    assert xs(store.replay(ids[3])) == [12, 14, 16, 18] and store.ran == ["over"]
    store.drop_data(ids[2])
    store.ran.clear()
    assert xs(store.replay(ids[3])) == [12, 14, 16, 18] and store.ran == ["double", "over"]
    store.drop_data(ids[1]), store.drop_data(ids[0])
    with pytest.raises(ValueError, match="give a source"):
        store.replay(ids[3])
    assert xs(store.replay(ids[3], spark.range(5, 8).withColumnRenamed("id", "x"))) == [12, 14]
    with pytest.raises(ValueError, match="no state"):
        store.replay("nowhere")


def test_a_diamond_of_states_runs_each_once_in_order(spark, store):
    a = store.save(spark.range(4).withColumnRenamed("id", "x"), "a")
    b = store.save(store.steps["double"](store.load(a)), "b", a, "double")
    c = store.save(store.steps["over"](store.load(a), least=2), "c", a, "over", {"least": 2})
    d = store.save(store.steps["both"](store.load(b), other=store.load(c)), "d", b, "both")
    store.depend(d, c, "other")
    e = store.save(store.steps["double"](store.load(d)), "e", d, "double")
    apart = store.save(spark.range(1).withColumnRenamed("id", "x"), "apart")
    assert {(r["id"], r["depth"]) for r in store.stale(a).collect()} == {(a, 0), (b, 1), (c, 1), (d, 2), (e, 3)}
    with pytest.raises(ValueError, match="already depends"):
        store.depend(a, e, "circle")
    store.ran.clear()
    store.update(a, spark.range(2, 5).withColumnRenamed("id", "x"))
    ran = store.push_dependencies(a).orderBy("place").collect()
    assert [r["title"] for r in ran][2:] == ["d", "e"] and {r["title"] for r in ran[:2]} == {"b", "c"} and [r["rows"] for r in ran][2:] == [6, 6]
    assert sorted(store.ran[:2]) == ["double", "over"] and store.ran[2:] == ["both", "double"]
    assert xs(store.load(d)) == [2, 3, 4, 4, 6, 8] and xs(store.load(e)) == [4, 6, 8, 8, 12, 16] and xs(store.load(apart)) == [0]
    assert [r["title"] for r in store.push_dependencies(e).collect()] == []


def test_sources_by_name(spark, tmp_path):
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    class Squares(DataSource):
        @classmethod
        def name(cls):
            return "squares"

        def schema(self):
            return "x bigint, task int"

        def reader(self, schema):
            n = int(self.options["n"])

            class Reader(DataSourceReader):
                def partitions(self):
                    return [InputPartition(i) for i in range(4)]

                def read(self, partition):
                    for i in range(partition.value, n, 4):
                        yield i * i, partition.value

            return Reader()

    sources = SourceRegistry(spark, f"file://{tmp_path}/registry")
    assert sources.table.count() == 0 and sources.add_kind(Squares) == "squares"
    one = sources.register("small", "squares", n=10)
    got = sources.read("small")
    assert got.rdd.getNumPartitions() == 4 and sorted((r["x"], r["task"]) for r in got.collect()) == sorted((i * i, i % 4) for i in range(10))
    assert sources.register("small", "squares", n=10) == one != sources.register("small", "squares", n=3)
    assert sources.read("small").count() == 3 and sources.table.count() == 1
    spark.range(3).write.parquet(f"file://{tmp_path}/rows")
    sources.register("rows", "parquet", f"file://{tmp_path}/rows")
    again = SourceRegistry(spark, f"file://{tmp_path}/registry")
    assert again.read("rows").count() == 3
    assert {(r["name"], r["column_name"], r["data_type"]) for r in again.objects().collect()} == {("small", "x", "bigint"), ("small", "task", "int"), ("rows", "id", "bigint")}
    spark.range(2).withColumnRenamed("id", "other").write.mode("overwrite").parquet(f"file://{tmp_path}/rows")
    with pytest.raises(ValueError, match="other columns"):
        again.read("rows")
    with pytest.raises(ValueError, match="no source"):
        again.read("none")
