"""Blocked search, the inverted file, exact quantiles, bucketed tables and banded pairs."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqloom.functions import dense, quantiles
from seqloom.plans.registry import GRAPH
from seqloom.sources.staging import bucketed


def vectors(spark, x, name):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"{name} long, vector array<double>")


def brute(q, x, k, skip=None):
    scores = np.round(q @ x.T, 6)
    out = {}
    for i, row in enumerate(scores):
        order = [j for j in sorted(range(len(x)), key=lambda j, row=row: (-row[j], j)) if not skip or j not in skip.get(i, ())]
        out[i] = order[:k]
    return out


def lists(frame):
    out = {}
    for r in frame.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["item_id"])
    return out


@pytest.mark.parametrize(("items", "queries"), [(1000, 1000), (40, 30), (7, 200)])
def test_blocked_search_is_exact(spark, items, queries):
    rng = np.random.default_rng(1)
    x, q = rng.integers(-3, 4, (150, 4)) / 4, rng.integers(-3, 4, (90, 4)) / 4  # many ties
    q[(q == 0).all(1)] = 0.25
    frame = dense.exact_top_k(vectors(spark, q, "query_id"), vectors(spark, x, "item_id"), 12, block_items=items, block_queries=queries)
    assert lists(frame) == brute(q, x, 12)
    skip = {i: {int(j) for j in rng.choice(150, 20)} for i in range(0, 90, 2)}
    own = vectors(spark, q, "query_id").join(spark.createDataFrame([(i, list(s)) for i, s in skip.items()], "query_id long, skip array<bigint>"), "query_id", "left")
    assert lists(dense.exact_top_k(own, vectors(spark, x, "item_id"), 12, block_items=items, block_queries=queries)) == brute(q, x, 12, skip)


def test_blocked_search_collects_nothing_and_broadcasts_nothing(spark):
    x = np.eye(8)
    frame = dense.exact_top_k(vectors(spark, x, "query_id"), vectors(spark, x, "item_id"), 3)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "FlatMapCoGroupsInArrow" in plan


def test_search_with_missing_and_zero_vectors(spark):
    items = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0])], "item_id long, vector array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.5]), (2, None), (3, [0.0, 0.0])], "query_id long, vector array<double>")
    assert lists(dense.exact_top_k(queries, items, 5)) == {1: [1, 3]}
    assert dense.exact_top_k(queries, items.limit(0), 5).count() == 0 and dense.exact_top_k(queries.limit(0), items, 5).count() == 0
    index = dense.VectorIndex.build(items)
    assert lists(index.top_k(queries, 5, 2)) == {1: [1, 3]}
    assert dense.VectorIndex.build(items.limit(0)).top_k(queries, 5, 1).count() == 0


def test_inverted_file_finds_neighbours_in_few_lists(spark, monkeypatch):
    monkeypatch.setattr(dense, "LIST_ITEMS", 16)  # lists in several parts
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(60, 16))
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    x = unit(centres[rng.integers(0, 60, 3000)] + 0.25 * rng.normal(size=(3000, 16)))
    q = unit(centres[rng.integers(0, 60, 120)] + 0.25 * rng.normal(size=(120, 16)))
    queries, items = vectors(spark, q, "query_id"), vectors(spark, x, "item_id")
    index = dense.VectorIndex.build(items, rounds=4)
    assert index.lists.count() == 3000 and index.lists.select("item_id").distinct().count() == 3000
    probes = index.probes_for(queries, 10)
    want, got = brute(q, x, 10), lists(index.top_k(queries, 10, probes))
    recall = np.mean([len(set(want[i]) & set(got.get(i, []))) / 10 for i in want])
    assert recall >= 0.95 and index.compared(queries, probes) < 0.1
    assert lists(index.top_k(queries, 10, len(index.centroids))) == want  # all lists: exact


@pytest.mark.parametrize("bins", [2, 7, 4096])
def test_exact_quantiles(spark, bins):
    rng = np.random.default_rng(bins)
    for values in ([5], [3, 3, 3], [-(2**40), 0, 2**40], rng.integers(-50, 10**6, 400).tolist(), [0] * 300 + [10**9]):
        df = spark.createDataFrame([(int(v),) for v in values] + [(None,)], "v long").repartition(3)
        got = quantiles.exact_quantiles(df, "v", {"a": 0.0, "b": 0.5, "c": 0.9, "d": 0.99, "e": 1.0}, bins)
        assert (got["count"], got["minimum"], got["maximum"]) == (len(values), min(values), max(values))
        for name, share in (("a", 0), ("b", 0.5), ("c", 0.9), ("d", 0.99), ("e", 1)):
            assert np.isclose(got[name], np.quantile(values, share), rtol=1e-12)
    assert quantiles.exact_quantiles(df.limit(0), "v", {"a": 0.5}) == {"count": 0, "minimum": None, "maximum": None, "a": None}


def test_bucketed_table_is_read_without_a_shuffle(spark):
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        table = bucketed(spark.range(5000).selectExpr("id % 97 as k", "id % 2 as w", "id as v"), "pairs", ("w", "k"))
        joined = spark.range(300).selectExpr("id % 120 as k", "id % 2 as w", "id as q").join(table, ["w", "k"])
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1  # the other side's
        assert joined.count() == sum(1 for q in range(300) for v in range(5000) if v % 97 == q % 120 and v % 2 == q % 2)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)


def test_item_cf_reads_its_neighbours_by_bucket(spark, sf001):
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        frame = GRAPH.frame(spark, "itemcf_retrieve", sf001)
        plan = frame._jdf.queryExecution().executedPlan().toString()
        side = plan[: plan.index("itemcf_neighbors_")].splitlines()[-6:]
        assert "Bucketed: true" in plan and not any("Exchange" in line for line in side)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)


def test_pairs_by_bands(spark):
    rng = np.random.default_rng(5)
    rows = [(u, p, int(rng.integers(1, 30)), int(rng.integers(0, 2)), p) for u, n in ((1, 200), (2, 21), (3, 1)) for p in range(n)]
    events = spark.createDataFrame(rows, "user_id long, pos long, item_rid long, action_type int, ts long").withColumn("history_end", F.col("pos"))
    cut = spark.createDataFrame([(10**9, 10**9)], "validation_start long, test_start long")
    known = spark.createDataFrame([(i,) for i in range(1, 20)], "item_rid long")
    got = {(r["user_id"], r["item_rid"], r["neighbor_item_rid"]) for r in GRAPH.frame(spark, "itemcf_pairs", interactions=events, temporal_cutoffs=cut, known_items=known).collect()}
    want = {(a[0], a[2], b[2]) for a in rows for b in rows if a[0] == b[0] and 1 <= abs(a[1] - b[1]) <= 20 and a[2] != b[2] and b[2] < 20}
    assert got == want


def test_item_cf_adds_up_where_a_users_lists_arrive(spark, sf001):
    """After the one shuffle by user neither scores nor ranks are shuffled again."""
    for name in ("itemcf_retrieve", "itemcf_ranked"):
        plan = GRAPH.frame(spark, name, sf001)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan[plan.index("Window") : plan.index("REPARTITION_BY_COL")].rpartition("\n")[0]


def test_exact_lists_are_not_shuffled_and_wanted_items_alone(spark):
    rng = np.random.default_rng(9)
    q, x = rng.standard_normal((40, 6)), rng.standard_normal((90, 6))
    items = vectors(spark, x, "item_id")
    for size in (30, 90):
        whole = dense.exact_top_k(vectors(spark, q, "query_id"), items, 12, block_items=size, block_queries=7)
        assert "Window" not in whole._jdf.queryExecution().executedPlan().toString()
        ranks = {(r["query_id"], r["item_id"]): r["rank"] for r in whole.collect()}
        asked = vectors(spark, q, "query_id").withColumn("wanted", F.col("query_id") * 2)
        got = {(r["query_id"], r["item_id"]): r["rank"] for r in dense.exact_top_k(asked, items, 12, block_items=size, block_queries=7).collect()}
        assert got == {k: v for k, v in ranks.items() if k[1] == 2 * k[0]} and got


@pytest.mark.parametrize("name", ["channel_overlap", "channel_incremental", "channel_complementarity", "rrf_fusion", "rrf_weight_grid", "ablation_deltas"])
def test_whole_lists_are_neither_written_nor_multiplied(name):
    """Fusion, overlap and metrics take lists of one split and experiment, or only the targets' places."""
    written = GRAPH.keep | set(GRAPH.buckets)
    lists = {"itemcf_retrieve", "dense_retrieve", "channel_retrieve", "channel_top", "fused_scores", "fused_ranks", "channel_dims", "history_dims"}
    seen, todo = set(), [name]
    while todo:
        node = todo.pop()
        if node in GRAPH.operators and node not in seen:
            seen.add(node)
            todo += GRAPH.inputs(node)
    assert not seen & lists and "itemcf_neighbors" in seen & written


def test_packed_lists_are_the_rows_lists(spark):
    rng = np.random.default_rng(11)
    q, x = rng.integers(-2, 3, (40, 5)) / 2, rng.integers(-2, 3, (90, 5)) / 2
    q[0] = 0
    for size in (30, 90):
        rows = lists(dense.exact_top_k(vectors(spark, q, "query_id"), vectors(spark, x, "item_id"), 12, block_items=size, block_queries=7))
        packed = dense.exact_top_k(vectors(spark, q, "query_id"), vectors(spark, x, "item_id"), 12, block_items=size, block_queries=7, packed=True)
        assert {r["query_id"]: r["items"] for r in packed.collect()} == rows and 0 not in rows


def test_fused_place_of_the_target(spark):
    """Against a ranking of the whole fused list, with ties and targets in one list, in both and in none."""
    rng = np.random.default_rng(12)
    rows = []
    for s in range(30):
        a, b = ([int(i) for i in rng.permutation(40)[: rng.integers(1, 30)]] if s % 5 else None for _ in range(2))
        rows.append((s, int(rng.integers(0, 50)), a, b))
    channels = spark.createDataFrame(rows, "sample_id long, target_item_rid long, first_items array<bigint>, second_items array<bigint>")
    got = {(r["sample_id"], r["alpha"]): r["rank"] for r in GRAPH.frame(spark, "test_fused_targets", test_channels=channels).collect()}
    want = {}
    for s, target, a, b in rows:
        for alpha in (0.0, 0.25, 0.5, 0.75, 1.0):
            score = {i: round((alpha / (61 + a.index(i)) if i in (a or ()) else 0) + ((1 - alpha) / (61 + b.index(i)) if i in (b or ()) else 0), 12) for i in {*(a or ()), *(b or ())}}
            order = sorted(score, key=lambda i: (-score[i], i))
            if target in order:
                want[s, alpha] = order.index(target) + 1
    assert got == want and want


def test_approximate_search_shuffles_no_pairs(spark, monkeypatch):
    """Hashing compares what agrees in a table's signs; items pass by in blocks, without rows of pairs or ranks."""
    rng = np.random.default_rng(13)
    x, q = rng.integers(-2, 3, (120, 6)) / 2 + 0.01, rng.integers(-2, 3, (50, 6)) / 2 + 0.01
    planes = np.random.default_rng(7).standard_normal((3, 4, 6))
    sign = lambda v: np.einsum("nd,tbd->ntb", v, planes) > 0
    near = (sign(q)[:, None] == sign(x)[None]).all(3).any(2)
    skip = {i: set(np.flatnonzero(~near[i]).tolist()) for i in range(len(q))}
    want = {i: o for i, o in brute(q, x, 7, skip).items() if o}
    for size in (1 << 14, 16):
        monkeypatch.setattr(dense, "BLOCK_ITEMS", size)
        frame = dense.lsh_top_k(vectors(spark, q, "query_id"), vectors(spark, x, "item_id"), 7, tables=3, bits=4, probes=0)
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "Join" not in plan and lists(frame) == want
    monkeypatch.setattr(dense, "LIST_ITEMS", 16)
    index = dense.VectorIndex.build(vectors(spark, x, "item_id"), rounds=2)
    frame = index.top_k(vectors(spark, q, "query_id"), 7, len(index.centroids))
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Join" not in plan and lists(frame) == brute(q, x, 7)


def test_negatives_are_shuffled_by_number_and_by_user_only(spark, sf001):
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        frame = GRAPH.frame(spark, "negative_top", sf001)
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan[: plan.index("REPARTITION_BY_COL")].rpartition("\n")[0]
        assert "negative_draws" not in GRAPH.inputs("negative_samples") and "softmax_scores" not in GRAPH.inputs("softmax_loss")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)


def test_what_a_function_reads_again_is_written(spark, sf001, monkeypatch):
    """Quantiles read the gaps in several rounds; each would shuffle all events anew."""
    from seqloom.plans import graph

    labels, write = [], graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, label, *by: labels.append(label) or write(df, label, *by))
    GRAPH.frame(spark, "gap_quantiles", sf001)
    assert labels.count("gaps") == 1


def test_ranks_of_targets_take_lists_of_reached_samples_only(spark):
    """A sample whose target is in no list of its history has no rank, and gets no lists."""
    rng = np.random.default_rng(21)
    neighbors = [(w, i, int(j), float(rng.integers(1, 9)) / 8, 1) for w in ("equal", "click3") for i in range(40) for j in rng.permutation(60)[:6]]
    events = [(u, p, int(rng.integers(0, 40)), int(rng.integers(0, 2)), p, p) for u in range(25) for p in range(int(rng.integers(1, 30)))]
    ends = {u: p + 1 for u, p, *_ in events}
    samples = [(("validation", "test")[u % 2], 100 + u, u, int(rng.integers(0, 60)), ends[u]) for u in ends]
    given = {
        "itemcf_neighbors": spark.createDataFrame(neighbors, "weight_variant string, item_rid long, neighbor_item_rid long, similarity double, rank long"),
        "interactions": spark.createDataFrame(events, "user_id long, pos long, item_rid long, action_type int, ts long, history_end long"),
        "query_samples": spark.createDataFrame(samples, "split string, sample_id long, user_id long, target_item_rid long, history_end_position long"),
        "item_strength": spark.createDataFrame([(i, 1, "Tail") for i in range(60)], "item_rid long, train_event_count long, strength_group string"),
    }
    lists = GRAPH.frame(spark, "itemcf_ranked", **given).collect()
    want = {(r["variant"], r["sample_id"]): r["rank"] for r in lists if r["item_rid"] == r["target_item_rid"]}
    got = {(r["variant"], r["sample_id"]): r["target_rank"] for r in GRAPH.frame(spark, "itemcf_ranks", **given).collect()}
    assert {k: v for k, v in got.items() if v is not None} == want and len(got) == 3 * len(samples) and want
    reached = {r["sample_id"] for r in GRAPH.frame(spark, "all_reached", **given).collect()}
    of = {}
    for _, i, j, *_ in neighbors:
        of.setdefault(i, set()).add(j)
    assert reached == {s for _, s, u, target, _ in samples if any(target in of[i] for v, _, i, *_ in events if v == u)} and len(reached) < len(samples)
    for name in ("itemcf_ranks", "itemcf_metrics", "select_best_variant", "retrieval_metrics", "recall_comparison", "ablation_deltas", "channel_complementarity", "channel_incremental"):
        assert not {"itemcf_ranked", "test_ranked", "validation_ranked"} & set(GRAPH.needed(name, {}))
    assert not {"dense_ranks", "test_dense_vectors"} & set(GRAPH.needed("select_best_variant", {}))


def test_hashing_places_items_once_a_batch(monkeypatch):
    """Items get their buckets once, not once for every few queries, and the same pairs are admitted as by a look at each."""
    rng = np.random.default_rng(22)
    planes, q, x = rng.standard_normal((5, 4, 6)), rng.standard_normal((75, 6)), rng.standard_normal((40, 6))
    admit = dense.Hashed(planes, 2)
    wanted = admit.asks(q)
    want = np.array([[any(wanted[i, b] for b in dense._buckets(x[j : j + 1], planes, 0)[0]) for j in range(40)] for i in range(75)])
    assert (admit.pairs(q, wanted, admit.places(x, None)) == want).all() and 0 < want.sum() < want.size
    calls, buckets = [], dense._buckets
    monkeypatch.setattr(dense, "_buckets", lambda v, *a: calls.append(len(v)) or buckets(v, *a))
    monkeypatch.setattr(dense, "SCORE_BYTES", 8 * 50 * 10)  # ten queries at a time
    table = lambda kind, v: pa.table({"row": np.zeros(len(v), np.int64), "kind": np.full(len(v), kind), "cell": np.zeros(len(v), np.int64), "id": np.arange(len(v)), "vector": pa.array(v.tolist()), "skip": pa.nulls(len(v), pa.list_(pa.int64())), "wanted": pa.nulls(len(v), pa.int64())})
    rows = [b for t in (table(0, q), table(1, x)) for b in t.to_batches()]
    assert sum(b.num_rows for b in dense._stream_scorer(7, 6, True, admit)(rows)) > 0
    assert calls == [75, 40]
