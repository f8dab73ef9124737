"""Operators on hand-computed inputs, bound to the graph in place of the canonical relations."""

import pytest

from seqloom.plans.registry import GRAPH

EVENTS = "user_id long, item_rid long, action_type int, ts long, pos long, history_end long"


def events(spark, sequences):
    """Rows of `interactions` from {user: [(item, action, time), ...]}."""
    rows = []
    for user, seq in sequences.items():
        for pos, (item, action, ts) in enumerate(seq):
            rows.append((user, item, action, ts, pos, sum(t < ts for _, _, t in seq)))
    return spark.createDataFrame(rows, EVENTS)


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_targets_have_strict_prefixes(spark):
    e = events(spark, {1: [(10, 1, 5), (11, 0, 5), (12, 1, 5), (13, None, 7), (14, 1, 9)]})
    got = rows(GRAPH.frame(spark, "click_targets", interactions=e), "target_position")
    # ties with the target are no history
    assert got == [(1, 10, 5, 0, 0), (1, 12, 5, 2, 0), (1, 14, 9, 4, 4)]
    samples = rows(GRAPH.frame(spark, "next_click_samples", interactions=e), "sample_id")
    assert [(s[0], s[3], s[7]) for s in samples] == [(0, 14, 4)]


def test_cutoffs_choose_the_nearest_boundary(spark):
    times = [1, 2, 3, 4, 5, 6, 7, 8, 9, 10]
    s = spark.createDataFrame([(i, i, 0, 0, t, 1, 0, 1, 1) for i, t in enumerate(times)], "sample_id long, user_id long, target_item_oid long, target_item_rid long, target_timestamp long, target_position long, history_start_position long, history_end_position long, history_length long")
    assert rows(GRAPH.frame(spark, "temporal_cutoffs", next_click_samples=s)) == [(9, 10)]
    more = s.union(s.withColumn("target_timestamp", s.target_timestamp + 10)).union(s.withColumn("target_timestamp", s.target_timestamp + 20))
    cut = rows(GRAPH.frame(spark, "temporal_cutoffs", next_click_samples=more))
    assert cut == [(25, 28)]
    split = {r["split"]: r["sample_count"] for r in GRAPH.frame(spark, "split_counts", next_click_samples=more).collect()}
    assert split == {"train": 24, "validation": 3, "test": 3}


def test_strength_uses_training_events_only(spark):
    e = events(spark, {1: [(10, 0, 1), (10, 0, 2)] + [(11, 0, 100 + i) for i in range(100)]})
    cut = spark.createDataFrame([(50, 80)], "validation_start long, test_start long")
    assert rows(GRAPH.frame(spark, "item_train_counts", interactions=e, temporal_cutoffs=cut)) == [(10, 2)]
    assert rows(GRAPH.frame(spark, "item_strength", interactions=e, temporal_cutoffs=cut), "item_rid") == [(10, 2, "Tail"), (11, 0, "Unseen")]


def test_itemcf_by_hand(spark):
    e = events(spark, {1: [(1, 0, 1), (2, 1, 2), (3, None, 3), (1, 1, 4)], 2: [(1, 1, 1), (2, 0, 2)]})
    cut = spark.createDataFrame([(50, 80)], "validation_start long, test_start long")
    known = spark.createDataFrame([(1,), (2,)], "item_rid long")
    given = {"interactions": e, "temporal_cutoffs": cut, "known_items": known}
    got = {(a, b): (x, y) for a, b, x, y in rows(GRAPH.frame(spark, "itemcf_similarity", **given))}
    # equal: user 1 has 1:2, 2:1 and user 2 has 1:1, 2:1; click3: 1:4, 2:3 and 1:3, 2:1
    assert got[(1, 2)][0] == pytest.approx((2 * 1 + 1 * 1) / ((5 * 2) ** 0.5))
    assert got[(1, 2)][1] == pytest.approx((4 * 3 + 3 * 1) / ((25 * 10) ** 0.5))
    assert set(got) == {(1, 2), (2, 1)}
    late = spark.createDataFrame([(2, 3)], "validation_start long, test_start long")
    assert rows(GRAPH.frame(spark, "itemcf_similarity", **given | {"temporal_cutoffs": late})) == []


def test_sessions_split_after_the_gap_only(spark):
    rows_in = [(1, 1, 1, t) for t in (0, 1800, 3601, 3602)]
    a = spark.createDataFrame(rows_in, "user_id long, item_rid long, action_type int, ts long")
    got = {(s, g): (short, long) for s, g, short, long in rows(GRAPH.frame(spark, "session_split", activity=a))}
    # the gap of exactly 1800 s doesn't split, the one of 1801 s does
    assert got[(1000003, 1800)] == (1, 2)
    assert got[(1000003, 3600)] == (3, 0)


def test_metrics_by_hand(spark):
    ranks = spark.createDataFrame(
        [("m", "test", 1, 5, "Head", 1), ("m", "test", 2, 6, "Head", 60), ("m", "test", 3, 7, "Tail", None)],
        "variant string, split string, sample_id long, target_item_rid long, strength_group string, target_rank long",
    )
    got = {(r["strength_group"], r["k"]): (r["sample_count"], r["recall"], r["ndcg"]) for r in GRAPH.frame(spark, "retrieval_metrics", channel_ranks=ranks).collect()}
    assert got[("Overall", 10)] == (3, pytest.approx(1 / 3), pytest.approx(0.333333, abs=1e-6))
    assert got[("Head", 100)][1] == 1.0 and got[("Tail", 100)] == (1, 0.0, 0.0) and got[("Unseen", 10)] == (0, 0.0, 0.0)
    assert len(got) == 20


def test_early_stopping_replay_agrees_with_the_class(spark):
    from seqloom.functions.training import EarlyStopping

    losses = [1.0, 0.9, 0.89999, 0.899985, 0.5, 0.49999, 0.49998, 0.49997, 0.1]
    table = spark.createDataFrame(list(enumerate(losses, 1)), "epoch long, loss double")
    executed = {r["epoch"] for r in GRAPH.frame(spark, "early_stopping_replay", epoch_losses=table).where("executed").collect()}
    stopper, want = EarlyStopping(3, 1e-4), set()
    for epoch, loss in enumerate(losses, 1):
        want.add(epoch)
        if stopper.update(loss, epoch):
            break
    assert executed == want and stopper.best_epoch == 8


def test_user_lists_keep_missing_and_oov_apart(spark):
    raw = spark.createDataFrame([(1, 5, 1, [3, 4]), (2, None, 2, None), (3, 9, None, [])], "user_id long, f103 long, f104 int, f106 array<long>")
    users = spark.createDataFrame([(1, True), (2, False), (3, False)], "user_id long, in_train boolean")
    vocab = spark.createDataFrame([("user", "f103", 5, 3), ("user", "f104", 1, 3), ("user", "f106", 3, 3)], "entity string, field string, value long, token long")
    got = rows(GRAPH.frame(spark, "user_features", user_raw=raw, relevant_users=users, feature_vocab=vocab), "user_id")
    assert got == [(1, 3, False, False, 3, False, False, "3,2"), (2, 1, True, False, 2, False, True, "1"), (3, 2, False, True, 1, True, False, "")]


def test_vocabulary_coverage_has_every_field(spark):
    raw = spark.createDataFrame([(1, 5, 1, [3, 4]), (2, None, 2, None), (3, 9, None, []), (4, 5, 1, [3])], "user_id long, f103 long, f104 int, f106 array<long>")
    users = spark.createDataFrame([(1, True), (2, False), (3, False), (7, False)], "user_id long, in_train boolean")
    vocab = spark.createDataFrame([("user", "f103", 5, 3), ("user", "f104", 1, 3), ("user", "f106", 3, 3), ("item", "f100", 8, 3), ("item", "f100", 9, 4), ("item", "f121", 1, 3)], "entity string, field string, value long, token long")
    items = spark.createDataFrame([(1, 8, None, 2, 1), (2, 7, None, 2, 2), (3, None, 4, None, 1)], "item_rid long, f100 long, f101 long, f102 long, f121 long")
    side = spark.createDataFrame([(False, False), (True, False), (False, True)], "f100_missing boolean, f100_oov boolean")
    got = {r[:2]: tuple(r[2:7]) for r in GRAPH.frame(spark, "vocab_coverage", user_raw=raw, relevant_users=users, feature_vocab=vocab, item_features=items, candidate_side=side).collect()}
    # (rows, missing, out of vocabulary, values, known); the list of a user is missing as a whole, of its elements 4 isn't known
    want = {("user", "f103"): (4, 2, 1, 4, 1), ("user", "f104"): (4, 2, 1, 4, 1), ("user", "f106"): (4, 2, 1, 2, 1), ("candidate", "f100"): (3, 1, 1, 3, 2)}
    assert got == want | {("item", "f100"): (3, 1, 1, 3, 2), ("item", "f101"): (3, 2, 1, 3, 0), ("item", "f102"): (3, 1, 2, 3, 0), ("item", "f121"): (3, 0, 1, 3, 1)}


def test_recall_audit_reads_the_hashed_lists(spark):
    exact = spark.createDataFrame([(q, i, 1.0 - i / 100, i) for q in (1, 2) for i in range(1, 51)], "query_id long, item_id long, score double, rank long")
    near = exact.where("query_id = 1 or rank > 10")  # the second query's list lacks the ten best
    near = near.selectExpr("query_id", "item_id", "score", "case when query_id = 1 then rank else rank - 10 end as rank")
    got = {(r["method"], r["k"]): (r["mean_overlap"], r["min_overlap"], r["query_count"]) for r in GRAPH.frame(spark, "ann_recall_audit", dense_topk_exact=exact, dense_topk_lsh=near, dense_topk_index=exact).collect()}
    assert {k: v for (m, k), v in got.items() if m == "hashing"} == {10: (0.5, 0.0, 2), 50: (0.9, 0.8, 2), 100: (0.9, 0.8, 2), 500: (0.9, 0.8, 2)}
    assert {k: v for (m, k), v in got.items() if m == "inverted_file"} == dict.fromkeys((10, 50, 100, 500), (1.0, 1.0, 2))


LIMITS = "max_history long, short_events long, long_events long"


def test_batches_keep_whole_histories(spark):
    e = events(spark, {1: [(10, 1, t) for t in range(70)]})
    val = spark.createDataFrame([(5, 1, 10, 70, 70)], "sample_id long, user_id long, target_item_rid long, target_timestamp long, history_end_position long")
    tokens = spark.createDataFrame([(10, 11)], "item_rid long, item_token long")
    given = {"val_samples": val, "interactions": e, "item_tokens": tokens}
    assert rows(GRAPH.frame(spark, "two_tower_batches", **given)) == [(5, 10, 11, 70, 770)]
    limit = spark.createDataFrame([(50, 20, 100)], LIMITS)
    assert rows(GRAPH.frame(spark, "two_tower_batches", batch_limits=limit, **given)) == [(5, 10, 11, 50, 550)]
    split = spark.createDataFrame([(5, 1800, 30, 130)], "sample_id long, gap_seconds long, short_length long, long_length long")
    assert rows(GRAPH.frame(spark, "session_batches", session_split=split)) == [(5, 1800, 30, 130, False, False)]
    assert rows(GRAPH.frame(spark, "session_batches", session_split=split, batch_limits=limit)) == [(5, 1800, 20, 100, True, True)]


def test_scan_gives_all_users(spark):
    from seqloom.operators.profile import first_users

    e = events(spark, {u: [(10, 1, 5), (11, 0, 6)] for u in range(1, 61)})
    scan = lambda **x: GRAPH.frame(spark, "scan_projection", interactions=first_users(e, **x))
    assert scan().count() == 120
    assert {r["user_id"] for r in scan(max_users=3).collect()} == {1, 2, 3} and scan(max_users=3).count() == 6


def test_negatives_and_loss_for_all_samples(spark):
    import math

    e = events(spark, {u: [(i, 1, i) for i in range(1, 31)] for u in range(1, 121)})  # whole histories of 30 items
    samples = spark.createDataFrame([(u, u, 31, 30, "train" if u % 2 else "validation") for u in range(1, 121)] + [(999, 1, 31, 30, "test")], "sample_id long, user_id long, target_item_rid long, history_end_position long, split string")
    given = {"split_samples": samples, "interactions": e}
    pool = lambda n: spark.createDataFrame([(i, 1) for i in range(1, n + 1)], "item_rid long, train_event_count long")
    for n in (51, 5000):  # of 51 items, exactly 20 are neither target nor history
        got = {}
        for s, i, place in rows(GRAPH.frame(spark, "negative_samples", item_train_counts=pool(n), **given)):
            got.setdefault(s, {})[place] = i
        assert set(got) == set(range(1, 121))
        assert all(sorted(x) == list(range(1, 21)) and len(set(x.values())) == 20 and min(x.values()) > 31 for x in got.values())
    assert len({i for x in got.values() for i in x.values()}) > 1200  # from the whole pool
    with pytest.raises(Exception, match="not enough eligible negatives"):
        GRAPH.frame(spark, "negative_samples", item_train_counts=pool(50), **given).collect()
    vectors = spark.createDataFrame([(u, [1.0, 0.0]) for u in range(1, 120)], "sample_id long, vector array<double>")
    index = spark.createDataFrame([(31, [0.5, 0.5])], "item_id long, vector array<double>")
    loss = dict(r[::2] for r in rows(GRAPH.frame(spark, "softmax_loss", item_train_counts=pool(51), loss_vectors=vectors, index_vectors=index, **given)))
    assert loss == {u: pytest.approx(math.log(math.exp(0.5) + 20) - 0.5 if u < 120 else math.log(21), abs=1e-6) for u in range(1, 121)}


def test_counts_and_samples_come_without_the_map_of_items(spark):
    assert "item_map" not in GRAPH.needed("next_click_features", {}) and "item_map" not in GRAPH.needed("drift_daily", {})
    e = spark.createDataFrame([(1, 10, 0, 5, 0, 0), (1, 10, 1, 6, 1, 1), (1, None, 1, 7, 2, 2), (2, 11, 1, 30, 0, 0), (2, 12, 1, 40, 1, 1)], "user_id long, item_rid long, action_type int, ts long, pos long, history_end long")
    given = {"interactions": e, "temporal_cutoffs": spark.createDataFrame([(20, 35)], "validation_start long, test_start long")}
    known = {"item_map": GRAPH.frame(spark, "item_map", interactions=e)}
    for name in ("item_strength", "sample_rows", "next_click_samples", "split_counts"):
        got, want = (sorted(GRAPH.frame(spark, name, **given, **more).collect(), key=repr) for more in ({}, known))
        assert got == want and got
    # the map from the counts has the same rows
    beside = GRAPH.with_neighbors("candidate_side", {})
    assert "item_counts" in beside.inputs("item_map")
    assert sorted(beside.frame(spark, "item_map", **given).collect(), key=repr) == sorted(known["item_map"].collect(), key=repr)


def test_batches_read_the_histories_of_validation_samples_only():
    needed = GRAPH.needed("collated_events", {})
    assert "collated_history" in needed and "model_events" not in needed
