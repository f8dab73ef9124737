"""Settings files, first rows, the protocol document, the audit of contracts, reports."""

import json

import pytest

from seqloom.plans import contracts, runner
from seqloom.plans.registry import GRAPH


def test_settings_from_a_file(spark, tmp_path):
    pytest.importorskip("yaml")
    path = tmp_path / "settings.yaml"
    path.write_text("output_root: out/x  # below the file\nks: [10, 500]\ntrain_ratio: 0.7\n")
    s = contracts.Settings.read(spark, f"file://{path}", debug=True)
    assert s.root == f"file://{tmp_path}/out/x_debug" and s.ks == (10, 500) and s.train_ratio == 0.7
    path.write_text("output_root: /abs\n")
    assert contracts.Settings.read(spark, f"file://{path}").root == "/abs"
    for bad in ("output_root: a\nnames: 1\n", "- a\n", "output_root: a\nks: [0]\n"):
        path.write_text(bad)
        with pytest.raises(contracts.ContractError):
            contracts.Settings.read(spark, f"file://{path}")
    assert contracts.Settings.load(json.dumps({"output_root": "a"})).ks == (10, 50, 100, 500)
    contracts.check_apart("/a/b6", "/a/b")
    with pytest.raises(contracts.ContractError):
        contracts.check_apart("/a/b/c", "/a/b")


def test_first_rows(spark):
    df = spark.createDataFrame([(i % 3, -i) for i in range(30)], "k long, v long").repartition(5)
    assert [tuple(r) for r in runner.first_rows(df, 3, "k").collect()] == [(0, -27), (0, -24), (0, -21)]
    assert runner.first_rows(df, 0, "k").count() == 0
    with pytest.raises(contracts.ContractError):
        runner.first_rows(df, 3)


def test_protocol_document(spark, sf001, tmp_path):
    s = contracts.Settings(f"file://{tmp_path}/o")
    doc = runner.protocol_document(spark, GRAPH, sf001, s)
    assert [x["split"] for x in doc["splits"]] == ["test", "train", "validation"] and doc["cutoffs"]["validation_start"] < doc["cutoffs"]["test_start"]
    cuts = doc["cutoffs"]
    assert all((x["max_ts"] < cuts["validation_start"]) == (x["split"] == "train") for x in doc["splits"])
    json.dumps(doc)


def test_contract_audit_finds_what_is_wrong(spark, sf001):
    found = {r["check_name"]: r["violations"] for r in runner.contract_audit(spark, GRAPH, sf001).collect()}
    assert set(found) == set(runner.CHECKS) and not any(found.values())
    counts = spark.createDataFrame([(1, 5)], "item_rid long, train_event_count long")
    found = {r["check_name"]: r["violations"] for r in runner.contract_audit(spark, GRAPH, sf001, item_train_counts=counts).collect()}
    assert found["training counts end at the cutoff"] == 1


def test_experiment_report():
    text = runner.experiment_report("U2", "p", "h", "s", [{"split": "test", "k": 10, "recall": 0.25, "ndcg": 0.1, "delta_vs_previous": None}, {"split": "test", "k": 500, "recall": 0.5, "ndcg": 0.2, "delta_vs_previous": 0.125}])
    assert text.startswith("# U2\n") and "| test | 10 | 0.2500 | 0.1000 | - |\n| test | 500 | 0.5000 | 0.2000 | 0.1250 |" in text
