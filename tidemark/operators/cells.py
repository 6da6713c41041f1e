"""Cells as text, rows as fixtures, numbers as words, batches of items for a judge and what its replies say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH = 20


def cell_text(df: DataFrame, column: str) -> Column:
    """The searchable text of a cell: a string as it is, plain values of a list by lines, anything nested as JSON; null as ''."""
    kind, c = df.schema[column].dataType, F.col(column)
    if isinstance(kind, T.StringType):
        out = c
    elif isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, T.StructType | T.ArrayType | T.MapType):
        out = F.array_join(c.cast("array<string>"), "\n")
    elif isinstance(kind, T.StructType | T.ArrayType | T.MapType):
        out = F.to_json(c)
    else:
        out = c.cast("string")
    return F.coalesce(out, F.lit(""))


def shrunk(c: Column, kind: T.DataType, chars: int = 4000, items: int = 8) -> Column:
    """A value with its strings cut to ``chars`` and its lists to ``items``, at any depth."""
    if isinstance(kind, T.StringType):
        return F.left(c, F.lit(chars))
    if isinstance(kind, T.ArrayType):
        return F.transform(F.slice(c, 1, items), lambda x: shrunk(x, kind.elementType, chars, items))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[shrunk(c[f.name], f.dataType, chars, items).alias(f.name) for f in kind.fields]))
    return c


def fixture_rows(df: DataFrame, chars: int = 4000, items: int = 8) -> DataFrame:
    return df.select(*[shrunk(F.col(f"`{f.name}`"), f.dataType, chars, items).alias(f.name) for f in df.schema.fields])


def percent(x: Column) -> Column:
    """A rate with two telling figures; '—' for null."""
    p = x * 100
    out = F.when(x.isNull(), "—").when(x <= 0, "0%").when(p >= 10, F.format_string("%.0f%%", p))
    for digits, least in ((1, 1.0), (2, 0.1), (3, 0.01), (4, 0.001)):
        out = out.when(p >= least, F.format_string(f"%.{digits}f%%", p))
    return out.otherwise(F.format_string("%.5f%%", p))


def one_in(x: Column) -> Column:
    """A rate as odds; '' for null and 0."""
    return F.when(x > 0, F.concat(F.lit("1 in "), F.format_number(F.round(1 / x), 0))).otherwise("")


def bytes_text(n: Column) -> Column:
    return F.when(n >= 1e9, F.format_string("%.2f GB", n / 1e9)).otherwise(F.format_string("%.0f MB", n / 1e6))


def iso_utc(time: Column) -> Column:
    """A time as ISO-8601 in UTC, to the second."""
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def snapshot(metadata: Column) -> Column:
    """The crawl snapshot a document's metadata (JSON, possibly cut) tells: a dump field, else a part of a segment path; null if none."""
    dump = F.regexp_extract(metadata, r'"(?:cc_)?dump": ?"([^"]+)"', 1)
    part = F.regexp_extract(metadata, r'"(?:cc_segment|segment|provenance)": ?"(?:[^"]*[/ ])?(CC-MAIN-[^/ "]+)', 1)
    return F.nullif(F.coalesce(F.nullif(dump, F.lit("")), part), F.lit(""))


def batches(numbered: DataFrame, key: str, number: str = "row_number", size: int = BATCH) -> DataFrame:
    """(key, batch, place) of rows with a dense number from 0."""
    return numbered.select(key, F.floor(F.col(number) / size).cast("long").alias("batch"), (F.col(number) % size).cast("long").alias("place"))


def read_replies(asked: DataFrame, replies: DataFrame, labels: list[str]) -> DataFrame:
    """(key.., batch, place, label, dropped): what a judge's replies say of each item asked.

    asked: (.., batch, place); replies: (batch, status, reply) with status ok or refused. A reply is a list of
    {"i": place, "label": label} anywhere in its text. dropped tells why an item has no label: no reply, refused, unparsed
    (no such list), invalid (a label that is none), unlabelled (not in the list). Of two labels the last counts.
    """
    listed = F.from_json(F.regexp_extract(F.coalesce("reply", F.lit("")), r"(?s)(\[.*\])", 1), "array<struct<i:string,label:string>>")
    r = replies.select(F.col("batch").alias("_batch"), "status", listed.alias("listed"))
    j = asked.join(r, asked["batch"] == r["_batch"], "left")
    mine = F.filter("listed", lambda x: x["i"].try_cast("long") == F.col("place"))
    label = F.get(mine, F.size(mine) - 1)["label"]
    why = (
        F.when(F.col("_batch").isNull(), "no reply")
        .when(F.col("status") != "ok", "refused")
        .when(F.col("listed").isNull(), "unparsed")
        .when(F.size(mine) == 0, "unlabelled")
        .when(~F.coalesce(label.isin(labels), F.lit(False)), "invalid")
    )
    return j.withColumn("dropped", why).withColumn("label", F.when(F.col("dropped").isNull(), label)).drop("_batch", "status", "listed")


def net(df: DataFrame, group: Column, label: Column, toward: str, away: str) -> DataFrame:
    """(group, toward, away, net) counts of two labels and their difference."""
    t = df.groupBy(group.alias("group")).agg(F.count_if(label == toward).alias("toward"), F.count_if(label == away).alias("away"))
    return t.withColumn("net", F.col("toward") - F.col("away"))
