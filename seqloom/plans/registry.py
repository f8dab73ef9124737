"""All queries by name, with the SQL that expresses the same result."""

from __future__ import annotations

from ..operators.dense import DENSE
from ..operators.evaluation import EVALUATION
from ..operators.features import FEATURES
from ..operators.itemcf import ITEMCF
from ..operators.models import MODELS
from ..operators.profile import PROFILE
from ..operators.protocol import PROTOCOL
from ..operators.relations import RELATIONS
from .graph import Graph

#: Relations that only feed other operators.
INTERNAL = {"all_reach_weights", "all_reached", "all_reached_weights", "all_reached_lists", "all_reached_ranked", "all_target_ranks", "selection_reach_weights", "selection_reached", "selection_reached_weights", "selection_reached_lists", "selection_reached_ranked", "selection_target_ranks", "test_reach_weights", "test_reached", "test_reached_weights", "test_reached_lists", "test_reached_ranked", "test_target_ranks", "validation_reach_weights", "validation_reached", "validation_reached_weights", "validation_reached_lists", "validation_reached_ranked", "validation_target_ranks", "test_hit_weights", "test_hit_lists", "test_hit_ranked", "test_hits", "test_hit_recent_lists", "test_hit_channels", "test_dense_target_ranks", "test_hit_dense_lists", "validation_hit_weights", "validation_hit_lists", "validation_hit_ranked", "validation_hits", "validation_hit_recent_lists", "validation_hit_channels", "validation_dense_target_ranks", "validation_hit_dense_lists", "collated_targets", "collated_history", "item_counts", "drawn_items", "negative_top", "short_samples", "short_redraws", "sample_losses", "audited_lists", "vector_events", "query_events", "channel_events", "loss_events", "rank_counts", "test_weights", "test_user_lists", "test_ranked", "validation_weights", "validation_user_lists", "validation_ranked", "test_recent_lists", "test_channels", "test_channel_targets", "test_fused_places", "test_fused_targets", "test_dense_events", "test_dense_vectors", "test_dense_lists", "validation_recent_lists", "validation_channels", "validation_channel_targets", "validation_fused_places", "validation_fused_targets", "validation_dense_events", "validation_dense_vectors", "validation_dense_lists", "model_gap", "model_bounds", "model_targets", "model_events", "model_items", "model_draw_numbers", "model_negative_draws", "model_negative_redraws", "model_negative_samples", "model_trained", "variant_ranks", "variant_metrics", "banded_events", "near_pairs", "both_ways", "known_pairs", "neighbor_lists", "history_weights", "user_lists_of_neighbors", "itemcf_ranked", "train_candidates", "ann_lists", "gaps", "count_histogram", "popularity_thresholds", "popularity_labels", "candidate_fields", "valid_vectors", "sample_rows", "sample_offsets", "timestamp_counts", "boundaries", "first_cutoff", "split_samples", "ordered_targets", "additions", "strength_groups", "drift_targets", "drift_days", "side_values", "item_coverage", "train_users", "user_vocab_values", "item_vocab_values", "user_vocab", "item_vocab", "user_lists", "val_samples", "train_prefix_sums", "activity_events", "activity_samples", "session_candidates", "session_starts", "length_counts", "batch_limits", "train_events", "known_items", "item_norms", "pair_sums", "query_samples", "experiments", "cutoffs_k", "metric_groups", "rank_pairs", "channel_lists", "alphas", "fused_scores", "fused_ranks", "ablation_metrics", "channel_ranks", "channel_retrieve", "pooling", "channel_dims", "channel_vectors", "channel_top", "channel_target_ranks", "dense_retrieve", "dense_ranks", "vector_rows", "history_dims", "query_vectors", "index_vectors", "history_items", "negative_pool", "loss_samples", "pool_ranges", "pool_size", "draw_numbers", "negative_draws", "negative_redraws", "loss_dims", "loss_vectors", "softmax_scores", "epoch_losses"}
#: Without a SQL form: hashing decides which pairs are compared.
ROWS_ONLY = {"dense_topk_lsh", "dense_topk_index", "training_history", "variant_ablation", "ann_recall_audit"}

#: Costly where several branches of a plan need them.
KEEP = frozenset(
    "events_plain model_targets model_events model_negative_draws variant_ranks variant_metrics gaps user_vocab item_vocab timestamp_counts banded_events dense_topk_lsh dense_topk_index interactions split_samples item_strength item_train_counts drift_daily feature_vocab user_features candidate_side eval_candidates activity_events session_split "
    "test_hits validation_hits item_map item_counts collated_targets user_raw train_users user_vocab_values item_vocab_values negative_top short_samples channel_vectors test_dense_vectors validation_dense_vectors ablation_metrics rank_counts vector_events itemcf_neighbors itemcf_retrieve itemcf_ranks retrieval_metrics item_norms fused_scores fused_ranks rank_pairs history_dims query_vectors index_vectors dense_topk_exact channel_dims channel_top dense_retrieve channel_ranks channel_retrieve user_action_ratios negative_draws loss_dims softmax_scores".split()
)

#: Of these, the ones that are written in buckets of the keys by which they are looked up.
BUCKETS = {"itemcf_neighbors": ("weight_variant", "item_rid")}

#: Selections from others.
COLUMNS_OF = {"events_plain": "interactions", "item_map": "item_counts", "item_train_counts": "item_counts", "item_strength": "item_counts"}

GRAPH = Graph(RELATIONS | PROFILE | PROTOCOL | FEATURES | ITEMCF | EVALUATION | DENSE | MODELS, KEEP, BUCKETS, COLUMNS_OF)


def names() -> list[str]:
    return [n for n in GRAPH.operators if n not in INTERNAL and (n not in RELATIONS or n == "item_map")]


def queries() -> dict:
    return {n: GRAPH.query(n) for n in names()}


def oracle_sql() -> dict[str, str]:
    return {n: GRAPH.duckdb(n) for n in names() if n not in ROWS_ONLY}
