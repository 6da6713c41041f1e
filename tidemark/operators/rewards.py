"""What scores an RL row, and how a mix is composed; languages of texts by the mass of their letters."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EXACT, TESTS, CONSTRAINTS, JUDGE, UNKNOWN = "exact answer match", "unit tests", "constraint checker", "LLM judge", "unknown"
#: The family of each kind of reward.
FAMILY = {EXACT: "rlvr", TESTS: "rlvr", CONSTRAINTS: "rlvr", JUDGE: "rlaif", UNKNOWN: "unknown"}


@dataclass
class RewardRules:
    """Rules in order: a whole table's kind, kinds of row tags by prefix, kinds of sources by name, by part of the name."""

    tables: dict[str, str] = field(default_factory=dict)
    tags: dict[str, str] = field(default_factory=dict)
    sources: dict[str, str] = field(default_factory=dict)
    parts: dict[str, str] = field(default_factory=dict)

    def kind(self, table: str, tag: Column, source: Column) -> Column:
        if table in self.tables:
            return F.lit(self.tables[table])
        out = [F.when(F.startswith(tag, F.lit(t)), k) for t, k in self.tags.items()]
        out += [F.when(source == s, k) for s, k in self.sources.items()]
        out += [F.when(F.contains(F.lower(source), F.lit(p)), k) for p, k in self.parts.items()]
        return F.coalesce(*out, F.lit(UNKNOWN)) if out else F.lit(UNKNOWN)


def family(kind: Column) -> Column:
    out = None
    for k, f in FAMILY.items():
        out = (F.when if out is None else out.when)(kind == k, f)
    return out.otherwise("unknown")


def composition(rows: DataFrame, kind: str = "kind") -> DataFrame:
    """(family, kind, rows, share), shares only if every row's kind is known: a partly known mix has no composition."""
    g = rows.groupBy(kind).agg(F.count(F.lit(1)).alias("rows")).withColumn("family", family(F.col(kind)))
    w = Window.partitionBy()  # one row a kind
    known = F.max((F.col(kind) == UNKNOWN).cast("int")).over(w) == 0
    return g.select("family", F.col(kind).alias("kind"), "rows", F.when(known, F.round(F.col("rows") / F.sum("rows").over(w), 6)).alias("share"))


UNDETERMINED = "undetermined"


def letter_vote(pieces: DataFrame, key: list[str], code: str, prob: str, letters: str, least: int = 12, share: float = 0.5) -> DataFrame:
    """key + (lang, confidence) from labelled pieces: the language with most letters times probability wins.

    Confidence is over all letters, so both mixed and unsure texts are pulled down; at or below ``share``, or with fewer
    than ``least`` letters, a text is undetermined. Ties go to the code that sorts first.
    """
    by = pieces.groupBy(*key, code).agg(F.sum(F.col(letters) * F.col(prob)).alias("weight"), F.sum(letters).alias("n"))
    best = by.groupBy(*key).agg(F.sum("n").alias("mass"), F.min_by(F.struct(code, "weight"), F.struct(-F.col("weight"), F.col(code))).alias("m"))
    conf = F.try_divide(F.col("m.weight").cast("double"), F.col("mass").cast("double"))
    sure = (F.col("mass") >= least) & (conf > share)
    return best.select(*key, F.when(sure, F.col(f"m.{code}")).otherwise(UNDETERMINED).alias("lang"), F.when(F.col("mass") >= least, F.round(conf, 6)).otherwise(0.0).alias("confidence"))
