"""Spark and DuckDB on the same tables, for operators whose plans are short; the driver compares all of them."""

import math

import duckdb
import pytest

from seqloom.plans import registry

KEYS = """scan_projection events_exploded null_fill contract_violations normalize_ints pk_profile null_action_profile vector_profile action_composition length_bands gap_quantiles
gap_log_histogram item_popularity top_contribution popularity_groups cold_start_distribution mm_coverage feature_profile target_audit click_targets next_click_samples temporal_cutoffs
split_counts item_strength drift_daily sequence_offsets session_gap_stats itemcf_pairs""".split()


@pytest.fixture(scope="module")
def duck(sf001):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events embeddings".split():
        con.execute(f"create view {t} as select * from '{sf001}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


@pytest.mark.parametrize("key", KEYS)
def test_parity(spark, sf001, duck, key):
    df = registry.queries()[key](spark, sf001)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    want = duck.sql(registry.oracle_sql()[key])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)


def test_entry_imports_without_the_corpus_operators(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "seqloom", tmp_path / "seqloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'split_counts' in q and not [k for k in q if k.startswith('op')]; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
