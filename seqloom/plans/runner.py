"""Ordered stages with start and stop points; each writes its result and a manifest."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..sources.sinks import write_parquet
from .contracts import ContractError, Settings, require_manifest, write_manifest
from .graph import Graph


@dataclass(frozen=True)
class Stage:
    """Materialises operators; later stages read these instead of computing them again."""

    name: str
    outputs: tuple[str, ...]
    after: tuple[str, ...] = ()


STAGES = [
    Stage("protocol", ("interactions", "item_map", "next_click_samples", "split_samples", "temporal_cutoffs")),
    Stage("strength", ("eval_candidates", "item_train_counts", "strength_thresholds", "item_strength"), ("protocol",)),
    Stage("drift", ("drift_daily", "drift_trend"), ("protocol", "strength")),
    Stage("features", ("feature_vocab", "user_features", "candidate_side", "mm_alignment"), ("protocol", "strength")),
    Stage("itemcf", ("itemcf_neighbors", "itemcf_retrieve", "itemcf_ranks"), ("protocol", "strength")),
    Stage("evaluation", ("retrieval_metrics", "channel_complementarity", "select_best_variant", "rrf_weight_grid"), ("itemcf",)),
]


def select(stages: list[Stage], start: str | None = None, stop: str | None = None) -> list[Stage]:
    """The stages from start to stop, both included."""
    names = [s.name for s in stages]
    for x in (start, stop):
        if x is not None and x not in names:
            raise ContractError(f"no stage {x}; there are {names}")
    chosen = stages[names.index(start) if start else 0 : names.index(stop) + 1 if stop else None]
    if not chosen:
        raise ContractError("start comes after stop")
    return chosen


def run(spark: SparkSession, graph: Graph, data_root: str, settings: Settings, start: str | None = None, stop: str | None = None, overwrite: bool = False) -> list[dict]:
    """Runs the stages; what earlier ones wrote is read from their tables."""
    known: dict = {}
    order = select(STAGES, start, stop)
    for stage in STAGES:
        if stage in order:
            break
        require_manifest(spark, settings, stage.name)
        known |= {o: spark.read.parquet(settings.path(stage.name, o)) for o in stage.outputs}
    report = []
    for stage in order:
        for needed in stage.after:
            require_manifest(spark, settings, needed)
        began = time.time()
        for output in stage.outputs:
            path = settings.path(stage.name, output)
            write_parquet(graph.frame(spark, output, data_root, **known), path, overwrite)
            known[output] = spark.read.parquet(path)
        write_manifest(spark, settings, stage.name, outputs=list(stage.outputs))
        report.append({"stage": stage.name, "seconds": round(time.time() - began, 2), "status": "completed"})
    return report


def markdown(name: str, problem: str, hypothesis: str, result: dict) -> str:
    """A short experiment report."""
    lines = [f"# {name}", "", f"Problem: {problem}", "", f"Hypothesis: {hypothesis}", "", "| metric | value |", "|-|-|"]
    return "\n".join([*lines, *(f"| {k} | {v} |" for k, v in result.items())]) + "\n"


def first_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows in the order of the columns, then of all others: the same rows wherever the data lie."""
    if n < 0 or not order:
        raise ContractError("first rows need a number and an order")
    return df.orderBy(*order, *(c for c in df.columns if c not in order)).limit(n)


def protocol_document(spark: SparkSession, graph: Graph, data_root: str, settings: Settings) -> dict:
    """The evaluation protocol in numbers, from the stages' tables where they are there, else computed."""
    def rows(name: str) -> list[dict]:
        try:
            df = spark.read.parquet(settings.path("protocol", name))
        except Exception:  # the reader's error depends on the file system
            df = graph.frame(spark, name, data_root)
        return [r.asDict() for r in df.collect()]  # one-row results and counts by split

    cut, targets = rows("temporal_cutoffs")[0], graph.frame(spark, "target_audit", data_root).first().asDict()
    return {"protocol_version": settings.protocol_version, "cutoffs": cut, "splits": sorted(rows("split_counts"), key=lambda r: r["split"]), "targets": targets, "ratios": [settings.train_ratio, settings.validation_ratio], "ks": list(settings.ks)}


#: What must hold between the relations: name and SQL of the violations.
CHECKS = {
    "item ids are unique": "select item_rid from {item_map} group by item_rid having count(*) > 1",
    "targets come after their history": "select sample_id from {split_samples} s join {interactions} e on s.user_id = e.user_id and e.pos = s.history_end_position - 1 where e.ts >= s.target_timestamp",
    "targets are candidates": "select s.target_item_oid from {split_samples} s left join {eval_candidates} c on s.target_item_oid = c.item_oid where s.split <> 'train' and c.item_oid is null",
    "training counts end at the cutoff": "select t.item_rid from {item_train_counts} t left join (select item_rid, count(*) as n from {interactions} e cross join {temporal_cutoffs} c where e.ts < c.validation_start group by item_rid) x on t.item_rid = x.item_rid where x.n is null or x.n <> t.train_event_count",
    "known items have tokens of their own": "select item_token from {item_tokens} where item_token > 1 group by item_token having count(*) > 1",
}


def contract_audit(spark: SparkSession, graph: Graph, data_root: str, **given: DataFrame) -> DataFrame:
    """(check, violations) of every contract; only the counts come together."""
    checked = Graph(graph.operators | {f"check_{i}": f"select {name!r} as check_name, count(*) as violations from ({sql}) v" for i, (name, sql) in enumerate(CHECKS.items())}, graph.keep, graph.buckets)
    out = None
    for i in range(len(CHECKS)):
        own = checked.frame(spark, f"check_{i}", data_root, **given)
        out = own if out is None else out.unionByName(own)
    return out


def experiment_report(variant: str, problem: str, hypothesis: str, solution: str, rows: list[dict]) -> str:
    """A report over an ablation's rows (split, k, recall, ndcg, delta_vs_previous)."""
    head = ["split", "k", "recall", "ndcg", "delta_vs_previous"]
    shown = lambda v: "-" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    table = ["| " + " | ".join(head) + " |", "|" + "-|" * len(head), *("| " + " | ".join(shown(r[c]) for c in head) + " |" for r in sorted(rows, key=lambda r: (r["split"], r["k"])))]
    return "\n".join([f"# {variant}", "", "## Problem", "", problem, "", "## Hypothesis", "", hypothesis, "", "## Solution", "", solution, "", "## Result", "", *table]) + "\n"
