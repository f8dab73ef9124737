"""Contracts between stages: schemas, violations, manifests, fixed tokens, settings."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The special tokens.
ITEM_TOKENS = {"padding": 0, "unknown": 1}
CATEGORY_TOKENS = {"padding": 0, "missing": 1, "oov": 2}
ACTION_TOKENS = {"padding": 0, "exposure": 1, "click": 2, "unknown": 3}


class ContractError(ValueError):
    pass


def resolve_path(value: str, base: str) -> str:
    """An absolute path or URI as it is; a relative path below base."""
    return value if value.startswith("/") or "://" in value or value.startswith("file:") else f"{base.rstrip('/')}/{value}"


def check_apart(inner: str, outer: str) -> None:
    """A stage's output must not lie within another's."""
    if f"{inner.rstrip('/')}/".startswith(f"{outer.rstrip('/')}/"):
        raise ContractError(f"{inner} lies within {outer}")


def check_special_tokens(configured: dict[str, dict[str, int]]) -> None:
    """The configured special tokens must be the fixed ones."""
    for name, fixed in (("item", ITEM_TOKENS), ("category", CATEGORY_TOKENS), ("action", ACTION_TOKENS)):
        if configured.get(name, fixed) != fixed:
            raise ContractError(f"{name} tokens must be {fixed}, not {configured[name]}")


def assert_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df, if its columns have the schema's names and types (in any order)."""
    have = {f.name: f.dataType for f in df.schema}
    wrong = {f.name: (f.dataType.simpleString(), have[f.name].simpleString() if f.name in have else None) for f in schema if have.get(f.name) != f.dataType}
    if wrong:
        raise ContractError(f"wrong or missing columns (wanted, found): {wrong}")
    return df


def assert_none(violations: DataFrame, what: str, show: int = 5) -> None:
    """Raises with a few examples if there are violations; only these come to the driver."""
    rows = violations.limit(show).collect()
    if rows:
        raise ContractError(f"{what}: {[r.asDict() for r in rows]}")


def assert_unique(df: DataFrame, *keys: str) -> None:
    assert_none(df.groupBy(*keys).count().where("count > 1"), f"{keys} is not unique")


def assert_same_keys(a: DataFrame, b: DataFrame, key: str) -> None:
    """Both tables must have the same keys."""
    assert_none(a.select(key).join(b.select(key), key, "left_anti"), f"{key} lacks a partner on the right")
    assert_none(b.select(key).join(a.select(key), key, "left_anti"), f"{key} lacks a partner on the left")


@dataclass(frozen=True)
class Settings:
    """All parameters of the staged computation; `debug` results go beside the real ones."""

    output_root: str
    protocol_version: str = "1"
    train_ratio: float = 0.8
    validation_ratio: float = 0.1
    pair_window: int = 20
    neighbors: int = 500
    session_gap: int | None = None
    ks: tuple[int, ...] = (10, 50, 100, 500)
    debug: bool = False
    tokens: dict = field(default_factory=dict)

    def __post_init__(self):
        if not (0 < self.train_ratio < 1 and 0 < self.validation_ratio < 1 and self.train_ratio + self.validation_ratio < 1):
            raise ContractError("the ratios must be positive and add up to less than 1")
        if any(k <= 0 for k in self.ks) or len(set(self.ks)) != len(self.ks):
            raise ContractError("ks must be positive and distinct")
        check_special_tokens(self.tokens)

    @classmethod
    def load(cls, text: str, **changes) -> Settings:
        """From YAML text where PyYAML is installed, else from JSON (which is YAML too); unknown keys raise."""
        try:
            import yaml
        except ModuleNotFoundError:
            given = json.loads(text)
        else:
            given = yaml.safe_load(text)
        if not isinstance(given, dict):
            raise ContractError("settings are a mapping")
        unknown = set(given) - set(cls.__dataclass_fields__)
        if unknown:
            raise ContractError(f"unknown settings {sorted(unknown)}")
        if "ks" in given:
            given["ks"] = tuple(given["ks"])
        return replace(cls(**given), **changes)

    @classmethod
    def read(cls, spark: SparkSession, path: str, base: str | None = None, **changes) -> Settings:
        """From a file on any file system that Spark reads; a relative output_root counts from `base`, or from the file's folder."""
        text = "".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
        own = cls.load(text, **changes)
        return replace(own, output_root=resolve_path(own.output_root, base or path.rpartition("/")[0]))

    @property
    def root(self) -> str:
        return self.output_root.rstrip("/") + ("_debug" if self.debug else "")

    def path(self, *parts: str) -> str:
        return "/".join([self.root, *parts])

    def selected_gap(self) -> int:
        """The frozen session gap; debug runs may use 1800 s without one."""
        if self.session_gap is None and not self.debug:
            raise ContractError("no session gap was selected")
        return self.session_gap or 1800


def write_manifest(spark: SparkSession, settings: Settings, stage: str, **values) -> None:
    """A one-row table with the protocol's version and the stage's values."""
    body = json.dumps(values, sort_keys=True, default=str)
    row = [(stage, settings.protocol_version, body, hashlib.sha256(json.dumps(asdict(settings), sort_keys=True, default=str).encode()).hexdigest())]
    spark.createDataFrame(row, "stage string, protocol_version string, body string, settings_sha256 string").coalesce(1).write.mode("overwrite").json(settings.path("manifests", stage))


def require_manifest(spark: SparkSession, settings: Settings, stage: str, **expected) -> dict:
    """The stage's values, if it ran under this protocol version and with the expected values."""
    try:
        row = spark.read.schema("stage string, protocol_version string, body string, settings_sha256 string").json(settings.path("manifests", stage)).first()
    except Exception as e:  # the reader's error depends on the file system
        raise ContractError(f"no manifest of stage {stage}") from e
    if row is None or row["protocol_version"] != settings.protocol_version:
        raise ContractError(f"stage {stage} ran under version {row and row['protocol_version']}, not {settings.protocol_version}")
    values = json.loads(row["body"])
    wrong = {k: (v, values.get(k)) for k, v in expected.items() if values.get(k) != v}
    if wrong:
        raise ContractError(f"stage {stage} (wanted, found): {wrong}")
    return values


def action_token(column: Column) -> Column:
    """1 exposure, 2 click, 3 for null and everything else."""
    return F.when(column == 0, ACTION_TOKENS["exposure"]).when(column == 1, ACTION_TOKENS["click"]).otherwise(ACTION_TOKENS["unknown"])
