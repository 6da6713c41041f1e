"""Targets and stages as a table, and results kept under target, stage and layer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("pretrain", "sft", "dpo", "rlvr", "chat")
SCHEMA = "target string, stage string, position int, kind string, table string, source_columns array<string>, prompt_path string, tokens long"


def catalog(spark: SparkSession, stages: list[dict]) -> DataFrame:
    """A table of stages; each needs target, stage, kind and table."""
    rows = []
    for i, s in enumerate(stages):
        if s["kind"] not in KINDS:
            raise ValueError(f"unknown kind {s['kind']}")
        rows.append((s["target"], s["stage"], i, s["kind"], s["table"], s.get("source_columns", []), s.get("prompt_path"), s.get("tokens")))
    return spark.createDataFrame(rows, SCHEMA)


def save(result: DataFrame, root: str, target: str, stage: str, layer: str, slug: str) -> str:
    """Writes a result to root/target=/stage=/layer=/slug= and returns that path; a rerun replaces it."""
    path = f"{root}/target={target}/stage={stage}/layer={layer}/slug={slug}"
    result.write.mode("overwrite").parquet(path)
    return path


def find(spark: SparkSession, root: str, target: str | None = None, stage: str | None = None, layer: str | None = None) -> DataFrame:
    """All results of a layer under a root; partition columns prune what is read."""
    df = spark.read.option("mergeSchema", "true").parquet(root)
    for name, value in (("target", target), ("stage", stage), ("layer", layer)):
        if value is not None:
            df = df.where(F.col(name) == value)
    return df


def significant(column: str, digits: int = 12):  # noqa: ANN201
    """A double rounded to significant digits, so that the order of summation does not show."""
    c = F.col(column)
    power = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(c))))
    return F.when((c == 0) | F.isnan(c) | (F.abs(c) == float("inf")), c).otherwise(F.rint(c * power) / power)


def fingerprint(*columns: str):  # noqa: ANN201
    """Twelve hexadecimal digits of the canonical JSON of some columns."""
    return F.left(F.sha2(F.to_json(F.struct(*sorted(columns))), 256), F.lit(12))
