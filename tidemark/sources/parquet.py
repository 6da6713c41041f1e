"""Parquet footers as a table, the bytes a scan would read, and a gate before it runs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FOOTER = "file string, row_groups int, rows long, leaf string, compressed_bytes long, partial boolean"


def files(spark: SparkSession, path: str) -> DataFrame:
    """(file, size, source): the data files of a path; nothing of their contents is read."""
    df = spark.read.format("binaryFile").load(path)
    return df.select(F.col("path").alias("file"), F.col("length").alias("size"), F.element_at(F.split("path", "/"), -2).alias("source"))


def footers(spark: SparkSession, path: str) -> DataFrame:
    """One row a file and leaf column: its compressed bytes, and the file's rows. Footers are read by the tasks."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        for batch in batches:
            out = []
            for uri in batch["file"]:
                system, where = fs.FileSystem.from_uri(uri)
                meta = pq.ParquetFile(system.open_input_file(where)).metadata
                sizes: dict[str, int] = {}
                for g in range(meta.num_row_groups):
                    for c in range(meta.num_columns):
                        chunk = meta.row_group(g).column(c)
                        sizes[chunk.path_in_schema] = sizes.get(chunk.path_in_schema, 0) + chunk.total_compressed_size
                out += [(uri, meta.num_row_groups, meta.num_rows, leaf, size, "partial-" in uri) for leaf, size in sizes.items()]
            yield pd.DataFrame(out, columns=["file", "row_groups", "rows", "leaf", "compressed_bytes", "partial"])

    return files(spark, path).select("file").mapInPandas(read, FOOTER)


def _reads(leaf: Column, wanted: tuple[str, ...]) -> Column:
    """Whether a physical leaf belongs to a column, or to one of its fields: list levels in between do not matter."""
    head = F.split(leaf, r"\.")
    inside = F.get(head, 0) == wanted[0]
    return inside if len(wanted) == 1 else inside & (F.element_at(head, -1) == wanted[-1])


def scan_cost(footer: DataFrame, leaves: list[tuple[str, ...]]) -> DataFrame:
    """(files, rows, bytes): what a scan of the leaves reads of all files."""
    any_ = F.lit(False)
    for leaf in leaves:
        any_ = any_ | _reads(F.col("leaf"), leaf)
    per = footer.groupBy("file").agg(F.max("rows").alias("rows"), F.sum(F.when(any_, F.col("compressed_bytes")).otherwise(0)).alias("bytes"))
    return per.agg(F.count(F.lit(1)).alias("files"), F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"))


class ScanTooLarge(RuntimeError):
    pass


def guard(cost: DataFrame, max_gb: float, agreed: bool = False) -> int:
    """The bytes of a planned scan; refuses before any job over the data if they exceed the limit and nobody agreed."""
    bytes_ = cost.first().bytes or 0
    if bytes_ > max_gb * 1e9 and not agreed:
        raise ScanTooLarge(f"the scan reads {bytes_ / 1e9:.2f} GB; the limit is {max_gb} GB")
    return bytes_


def row_page(df: DataFrame, key: str, offset: int, length: int) -> DataFrame:
    """Rows number offset to offset + length of a table with a dense row number: a range filter that reaches the scan."""
    return df.where((F.col(key) >= offset) & (F.col(key) < offset + length))


def numbered(df: DataFrame, order: str) -> DataFrame:
    """A dense row number over an order: counts of each range first, so no task sorts all rows.

    The ranges are told by bounds on the order itself (quantiles, one value a range), not by the partition a row happens
    to be in, so both passes agree however partitions are merged or computed again.
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    got = df.select(F.percentile_approx(order, [i / parts for i in range(1, parts)], 10_000).alias("q")).first().q if parts > 1 else None
    bounds = F.array(*[F.lit(b) for b in sorted(set(got))]) if got else None
    part = F.coalesce(F.size(F.filter(bounds, lambda b: b < F.col(order))), F.lit(0)) if got else F.lit(0)
    ranged = df.withColumn("_part", F.when(F.col(order).isNull(), F.lit(-1)).otherwise(part))
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))  # a row for each range
    before = counts.withColumn("before", F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).drop("n")
    return ranged.join(F.broadcast(before), "_part").withColumn("row_number", F.col("before") + F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1).drop("_part", "before")
