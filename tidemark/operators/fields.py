"""From table schemas to the text fields of training examples, by the side of the example they stand on.

Sides: prompt, response, chosen, rejected, reference, rollout. A table's schema is matched against fixed names of
columns; every text column that is neither training text nor known metadata is reported as not searched. Leaves of nested
columns are zipped before any lambda or explode, so only they are read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIDES = ("prompt", "response", "chosen", "rejected", "reference", "rollout")

#: Names of columns and fields that hold training text, and of those that do not.
RESPONSE_ROLES = ("assistant", "model")
PLAIN = {"prompt": "prompt", "solution": "reference", "constraint": "reference", "ground_truth": "reference"}
LISTS = {"ground_truth": "reference", "outputs": "rollout"}
STRUCTS = {("reward_model", "ground_truth"): "reference"}
MESSAGES = ("messages", "chosen", "rejected", "source_prompt", "conversation")
EXTRAS = {"functions": "prompt", "reasoning_content": "response", "function_calls": "response", "tool_calls": "response", "function_call": "response", "refusal": "response"}
METADATA = frozenset(
    "id custom_id prompt_id conversation_hash key dataset dataset_source source_dataset source original_dataset data_source model chosen_model rejected_model predicted_label preference_type setting_key setting_name "
    "domain ability topic characters constraint_type difficulty_explanation extra_info difficulty language hashed_ip header openai_moderation detoxify_moderation turn timestamp toxic redacted state country".split()
)
NO_VALUE, NO_COLUMN = "(no source value)", "(no source column)"

_TEXT = T.StringType()


@dataclass
class Plan:
    """What of a table is searched: pieces (side, column, array<struct<turn, role, text>>), leaves read, columns left out."""

    pieces: list[tuple[str, str, Column]] = field(default_factory=list)
    leaves: list[tuple[str, ...]] = field(default_factory=list)
    unsearched: list[str] = field(default_factory=list)

    def sides(self) -> list[str]:
        return [s for s in SIDES if any(p[0] == s for p in self.pieces)]

    def texts(self, side: str) -> Column:
        """All texts of a side of a row, as one array."""
        mine = [F.transform(p[2], lambda m: m["text"]) for p in self.pieces if p[0] == side]
        return mine[0] if len(mine) == 1 else F.concat(*mine)


def _empty() -> Column:
    return F.array().cast("array<struct<turn:int,role:string,text:string>>")


def _items(role: Column | None, text: Column, shift: Column | int = 0) -> Column:
    """array<struct<turn, role, text>> from parallel arrays; nulls and empty arrays give none."""
    zipped = F.arrays_zip(text.alias("t"), role.alias("r")) if role is not None else F.transform(text, lambda t: F.struct(t.alias("t"), F.lit(None).cast("string").alias("r")))
    out = F.transform(zipped, lambda m, i: F.struct((i + shift).cast("int").alias("turn"), m["r"].alias("role"), m["t"].alias("text")))
    return F.coalesce(F.filter(out, lambda m: m["text"].isNotNull()), _empty())


def emits(role: Column) -> Column:
    """Whether a turn of this role is text the model is fit to produce."""
    return F.lower(F.coalesce(role, F.lit(""))).isin(*RESPONSE_ROLES)


def _fields(schema: T.StructType, column: str) -> dict[str, T.DataType]:
    kind = schema[column].dataType if column in schema.names else None
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        return {f.name: f.dataType for f in kind.elementType.fields}
    return {}


def branch(schema: T.StructType, capped: bool = True) -> Column:
    """Number of leading turns that a pair's sides share, compared on the fields that can be searched.

    capped: each side's last turn is its answer however far the sides agree.
    """
    have = _fields(schema, "chosen")
    names = [n for n in ("role", "content", *EXTRAS) if have.get(n) == _TEXT]
    zipped = F.arrays_zip(*[F.col(f"{s}.{n}").alias(f"{s}_{n}") for s in ("chosen", "rejected") for n in names])

    def same(z: Column) -> Column:
        out = F.lit(True)
        for n in names:
            out = out & (F.coalesce(z[f"chosen_{n}"], F.lit("")) == F.coalesce(z[f"rejected_{n}"], F.lit("")))
        return out

    sizes = [F.greatest(F.lit(0), F.coalesce(F.size(s), F.lit(0))) for s in ("chosen", "rejected")]
    shorter = F.least(*sizes)
    first = F.array_position(F.transform(zipped, same), False).cast("int")
    shared = F.when(F.coalesce(first, F.lit(0)) > 0, F.least(first - 1, shorter)).otherwise(shorter)
    return F.greatest(F.lit(0), F.least(shared, *[s - 1 for s in sizes])) if capped else shared


def _pair(plan: Plan, schema: T.StructType) -> None:
    at = branch(schema)
    have = _fields(schema, "chosen")
    extras = {n: s for n, s in EXTRAS.items() if have.get(n) == _TEXT}
    for side in ("chosen", "rejected"):
        items = _items(F.col(f"{side}.role"), F.col(f"{side}.content"))
        tail = F.filter(items, lambda m: m["turn"] >= at)
        if side == "chosen":
            plan.pieces.append(("prompt", side, F.filter(items, lambda m: m["turn"] < at)))
        plan.pieces.append((side, side, F.filter(tail, lambda m: emits(m["role"]))))
        plan.pieces.append(("prompt", side, F.filter(tail, lambda m: ~emits(m["role"]))))
        plan.leaves += [(side, "content"), (side, "role")]
        for n, s in extras.items():
            extra = _items(F.col(f"{side}.role"), F.col(f"{side}.{n}"))
            if s == "response":
                plan.pieces.append((side, f"{side}.{n}", F.filter(extra, lambda m: m["turn"] >= at)))
                if side == "chosen":
                    plan.pieces.append(("prompt", f"{side}.{n}", F.filter(extra, lambda m: m["turn"] < at)))
            else:
                plan.pieces.append(("prompt", f"{side}.{n}", extra))
            plan.leaves.append((side, n))


def text_plan(schema: T.StructType, sides: tuple[str, ...] = SIDES) -> Plan:
    """The plan for a table's schema, limited to some sides (columns only they need are not read)."""
    plan = Plan()
    pair = bool(_fields(schema, "chosen")) and bool(_fields(schema, "rejected"))
    for f in schema.fields:
        name, kind = f.name, f.dataType
        have = _fields(schema, name)
        if name in MESSAGES and have:
            if pair and name in ("chosen", "rejected"):
                if name == "chosen":
                    _pair(plan, schema)
                continue
            role = F.col(f"{name}.role") if have.get("role") == _TEXT else None
            items = _items(role, F.col(f"{name}.content"))
            if name == "source_prompt" or role is None:  # the whole conversation is given to the policy
                plan.pieces.append(("prompt", name, items))
                plan.leaves.append((name, "content"))
            else:
                produced = name if name in ("chosen", "rejected") else "response"
                plan.pieces.append((produced, name, F.filter(items, lambda m: emits(m["role"]))))
                plan.pieces.append(("prompt", name, F.filter(items, lambda m: ~emits(m["role"]))))
                plan.leaves += [(name, "content"), (name, "role")]
            if name != "source_prompt":
                for n, s in EXTRAS.items():
                    if have.get(n) == _TEXT:
                        plan.pieces.append((s, f"{name}.{n}", _items(role, F.col(f"{name}.{n}"))))
                        plan.leaves.append((name, n))
        elif name in PLAIN and kind == _TEXT:
            plan.pieces.append((PLAIN[name], name, _items(None, F.array(F.col(name)))))
            plan.leaves.append((name,))
        elif name in LISTS and kind == T.ArrayType(_TEXT):
            plan.pieces.append((LISTS[name], name, _items(None, F.col(name))))
            plan.leaves.append((name,))
        elif isinstance(kind, T.StructType) and any((name, s) in STRUCTS and kind[s].dataType == _TEXT for s in kind.fieldNames()):
            for s in kind.fieldNames():
                if (name, s) in STRUCTS and kind[s].dataType == _TEXT:
                    plan.pieces.append((STRUCTS[name, s], f"{name}.{s}", _items(None, F.array(F.col(f"{name}.{s}")))))
                    plan.leaves.append((name, s))
        elif name not in METADATA and (kind == _TEXT or kind == T.ArrayType(_TEXT)):
            plan.unsearched.append(name)
    plan.pieces = [p for p in plan.pieces if p[0] in sides]
    used = {p[1].split(".")[0] for p in plan.pieces}
    plan.leaves = list(dict.fromkeys(x for x in plan.leaves if x[0] in used))
    return plan


def source_label(df: DataFrame, columns: list[str]) -> Column:
    """The source of a row: the first of the columns that exists (of a list its first element), null and '' as one label."""
    for c in columns:
        if c in df.columns:
            kind = df.schema[c].dataType
            value = F.get(F.col(c), 0) if isinstance(kind, T.ArrayType) else F.col(c).cast("string")
            return F.coalesce(F.nullif(value, F.lit("")), F.lit(NO_VALUE))
    return F.lit(NO_COLUMN)


def field_rows(df: DataFrame, key: str, sources: list[str], plan: Plan | None = None) -> DataFrame:
    """The long form: (row, source, side, field, turn, role, text), one row for each non-null text."""
    plan = plan or text_plan(df.schema)

    def named(side: str, name: str, items: Column) -> Column:
        return F.transform(items, lambda m: F.struct(F.lit(side).alias("side"), F.lit(name).alias("field"), m["turn"].alias("turn"), m["role"].alias("role"), m["text"].alias("text")))

    parts = [named(*p) for p in plan.pieces]
    if not parts:
        return df.select(F.col(key).alias("row"), source_label(df, sources).alias("source"), F.lit("").alias("side"), F.lit("").alias("field"), F.lit(0).alias("turn"), F.lit("").alias("role"), F.lit("").alias("text")).limit(0)
    return df.select(F.col(key).alias("row"), source_label(df, sources).alias("source"), F.explode(F.concat(*parts)).alias("f")).select("row", "source", "f.*")


def first_prompt(df: DataFrame) -> Column:
    """The text a row asks: the first user turn with content, else the prompt column; white space stripped."""
    from tidemark.functions.text import stripped

    options = []
    for name in ("messages", "conversation", "chosen", "source_prompt"):
        if _fields(df.schema, name):
            zipped = F.arrays_zip(F.col(f"{name}.role").alias("r"), F.col(f"{name}.content").alias("t"))
            user = F.filter(zipped, lambda m: (m["r"] == "user") & (F.length(stripped(m["t"])) > 0))
            options.append(stripped(F.get(user, 0)["t"]))
    if "prompt" in df.columns:
        options.insert(0, F.nullif(stripped(F.col("prompt")), F.lit("")))
    return F.coalesce(*options)
