"""Early stopping, retrieval, contracts, sinks, runner, sessions."""

import numpy as np
import pytest

from seqloom.functions import dense, training
from seqloom.plans import contracts, runner
from seqloom.plans.dialect import DUCKDB, SPARK, expand
from seqloom.plans.registry import GRAPH
from seqloom.sources import sinks, tables
from seqloom.sources.staging import materialize

RNG = np.random.default_rng(0)


def test_early_stopping_resumes():
    a = training.EarlyStopping(2, 0.01)
    assert [a.update(x, i) for i, x in enumerate([1.0, 0.5, 0.499])] == [False, False, False]
    b = training.EarlyStopping.resume(a.state())
    assert b.update(0.498, 3) and b.best == 0.498
    with pytest.raises(ValueError):
        b.update(float("nan"), 4)


def test_top_k_by_blocks(spark):
    q = [(i, [float(x) for x in RNG.normal(size=4)]) for i in range(9)] + [(50, [0.0] * 4), (51, None)]
    it = [(100 + i, [float(x) for x in RNG.normal(size=4)]) for i in range(40)] + [(300, None)]
    queries = spark.createDataFrame(q, "query_id long, vector array<double>")
    items = spark.createDataFrame(it, "item_id long, vector array<double>")
    one = sorted(map(tuple, dense.exact_top_k(queries, items, 5).collect()))
    assert one == sorted(map(tuple, dense.exact_top_k(queries, items, 5, block_items=7).collect()))
    assert len(one) == 45
    near = {(r["query_id"], r["item_id"]) for r in dense.lsh_top_k(queries, items, 5, tables=32, bits=3).collect()}
    assert len(near & {(r[0], r[1]) for r in one}) / 45 >= 0.9


def test_hashed_top_k_finds_the_neighbours(spark):
    # the registered queries' parameters over the tables' vectors
    q, it = (materialize(GRAPH.frame(spark, x, "/root/testdata/sf0.01"), x) for x in ("query_vectors", "index_vectors"))
    exact = {(r["query_id"], r["item_id"]) for r in dense.exact_top_k(q, it, 50).collect()}
    near = {(r["query_id"], r["item_id"]) for r in dense.lsh_top_k(q, it, 50).collect()}
    assert len(exact & near) / len(exact) >= 0.95


def test_macros():
    assert expand("select @count_if(a in (1, 2)) from x where @size(@map(v, x + 1)) > 0", SPARK) == "select count_if(a in (1, 2)) from x where cast(size(transform(v, x -> x + 1)) as bigint) > 0"
    assert "filter (where a > 1)" in expand("@count_if(a > 1)", DUCKDB)
    assert GRAPH.duckdb("split_counts").startswith("with ")
    with pytest.raises(KeyError):
        GRAPH.frame(None, "no_such_relation")


def test_contracts(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, "b")], "k long, v string")
    with pytest.raises(contracts.ContractError):
        contracts.assert_unique(df, "k")
    contracts.assert_unique(df, "k", "v")
    with pytest.raises(contracts.ContractError):
        contracts.assert_same_keys(df, df.where("v = 'a'"), "v")
    with pytest.raises(contracts.ContractError):
        contracts.Settings("x", tokens={"item": {"padding": 1}})
    with pytest.raises(contracts.ContractError):
        contracts.Settings("x").selected_gap()
    s = contracts.Settings.load('{"output_root": "%s/out", "ks": [5]}' % tmp_path, debug=True)
    assert s.selected_gap() == 1800 and s.root.endswith("out_debug")
    contracts.write_manifest(spark, s, "one", rows=3)
    assert contracts.require_manifest(spark, s, "one", rows=3) == {"rows": 3}
    with pytest.raises(contracts.ContractError):
        contracts.require_manifest(spark, s, "one", rows=4)
    with pytest.raises(contracts.ContractError):
        contracts.require_manifest(spark, s, "two")
    with pytest.raises(ValueError):
        tables.require_columns(df, ["missing"])


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan")), (2, 1.5)], "k long, v double")
    path = str(tmp_path / "t")
    sinks.write_parquet(df, path)
    with pytest.raises(Exception):  # noqa: B017
        sinks.write_parquet(df, path)
    sinks.write_parquet(df, path, overwrite=True)
    sinks.write_json(df, str(tmp_path / "j"))
    assert [r["v"] for r in spark.read.schema("k long, v double").json(str(tmp_path / "j")).orderBy("k").collect()] == [None, 1.5]
    sinks.write_csv(df, str(tmp_path / "c"))
    assert sinks.describe_files(spark.read.parquet(path)).where("length > 0").count() > 0


def test_runner_selects_and_resumes(spark, sf001, tmp_path):
    assert [s.name for s in runner.select(runner.STAGES, "strength", "features")] == ["strength", "drift", "features"]
    with pytest.raises(contracts.ContractError):
        runner.select(runner.STAGES, "drift", "protocol")
    settings = contracts.Settings(str(tmp_path / "run"))
    with pytest.raises(contracts.ContractError):
        runner.run(spark, GRAPH, sf001, settings, "strength", "strength")
    assert [r["stage"] for r in runner.run(spark, GRAPH, sf001, settings, stop="strength")] == ["protocol", "strength"]
    assert runner.run(spark, GRAPH, sf001, settings, "drift", "drift")[0]["status"] == "completed"
    assert "| recall | 0.5 |" in runner.markdown("x", "p", "h", {"recall": 0.5})


def test_streaming_sessions(spark, tmp_path):
    from seqloom.streaming.sessions import session_stream

    rows = [(1, "2024-01-01 00:00:00", 1), (1, "2024-01-01 00:30:00", 0), (1, "2024-01-01 01:00:01", 1), (2, "2024-01-01 00:00:00", None)]
    df = spark.createDataFrame(rows, "user_id long, t string, action_type int").selectExpr("user_id", "cast(t as timestamp) as time", "action_type")
    path = str(tmp_path / "events")
    df.write.parquet(path)
    batch = sorted((r["user_id"], r["event_count"], r["clicks"]) for r in session_stream(df, 1800).collect())
    assert batch == [(1, 1, 1), (1, 2, 1), (2, 1, 0)]  # a gap of 1800 s stays, one of 1801 s splits
    stream = session_stream(spark.readStream.schema(df.schema).parquet(path), 1800)
    query = stream.writeStream.format("memory").queryName("sessions").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("sessions").count() == 3
