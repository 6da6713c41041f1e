"""Corpus shards: names to source and topic, heads of compressed JSON lines, ordered streams of token ids."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class NameRules:
    """How directory names tell source and topic: name prefixes, marks of bookkeeping, spellings of topics."""

    sources: list[tuple[str, str]]
    aliases: dict[str, str] = field(default_factory=dict)
    #: filtering marks, and numbers that stand alone
    #: Fixed value: parts of a name that tell how its shard was filtered, not where it is from.
    bookkeeping: str = r"(?i)high[-_]quality|vigintile\d*|subset|decon\w*|fim|length|denyagain|part\d+|(?<![0-9a-z])(?:\d+e\d+|\d+)(?![0-9a-z])"

    def split(self, directory: Column) -> Column:
        """struct(source, topic); a name without a known prefix is its own source and has no topic."""
        name = F.regexp_replace(F.regexp_replace(directory, r"^ingredient\d+-", ""), r"-\d+$", "")
        out = None
        for prefix, source in sorted(self.sources, key=lambda x: -len(x[0])):
            rest = F.regexp_replace(F.substring(name, F.lit(len(prefix) + 1), F.length(name)), self.bookkeeping, " ")
            topic = F.regexp_replace(F.regexp_replace(rest, r"[-_\s]+", "_"), r"^_+|_+$", "")
            known = F.create_map(*[F.lit(x) for pair in self.aliases.items() for x in pair]) if self.aliases else None
            value = F.struct(F.lit(source).alias("source"), (F.coalesce(F.try_element_at(known, topic), topic) if known is not None else topic).alias("topic"))
            out = (F.when if out is None else out.when)(F.startswith(name, F.lit(prefix)), value)
        own = F.struct(name.alias("source"), F.lit("").alias("topic"))
        return own if out is None else out.otherwise(own)


def group_sizes(files: DataFrame, rules: NameRules) -> DataFrame:
    """(source, topic, shards, bytes) of a listing (file, size), largest first."""
    directory = F.element_at(F.split("file", "/"), -2)
    s = files.select(rules.split(directory).alias("g"), "size").groupBy("g.source", "g.topic").agg(F.count(F.lit(1)).alias("shards"), F.sum("size").alias("bytes"))
    return s.orderBy(F.desc("bytes"), "source", "topic")


def shard_heads(spark: SparkSession, path: str, read_bytes: int = 96 * 1024) -> DataFrame:
    """(file, line, record): whole JSON lines within the first bytes of each shard; a line cut at the end is left out.

    Shards may be plain, gzip or zstandard; only the head of a file is read, through its own file system.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import gzip
        import io

        import zstandard
        from pyarrow import fs

        for batch in batches:
            out = []
            for uri in batch["file"]:
                system, where = fs.FileSystem.from_uri(uri)
                head = system.open_input_file(where).read(read_bytes)
                if uri.endswith((".zst", ".zstd")):
                    d = zstandard.ZstdDecompressor().decompressobj()
                    try:
                        head = d.decompress(head)
                    except zstandard.ZstdError:
                        head = b""
                elif uri.endswith(".gz"):
                    stream, head = gzip.GzipFile(fileobj=io.BytesIO(head)), b""
                    try:
                        while part := stream.read(4096):
                            head += part
                    except EOFError:
                        pass
                for n, line in enumerate(head.split(b"\n")):
                    try:
                        json.loads(line)
                    except ValueError:
                        continue
                    out.append((uri, n, line.decode("utf-8", "replace")))
            yield pd.DataFrame(out, columns=["file", "line", "record"])

    listing = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"))
    return listing.mapInPandas(read, "file string, line int, record string")


@dataclass
class StreamLayout:
    """A run's token stream: every step has ``sequences`` sequences of ``length`` uint16 ids, cut over shards of a size."""

    steps: int
    sequences: int
    length: int
    shard_bytes: list[int]

    @property
    def step_bytes(self) -> int:
        return self.sequences * self.length * 2

    def check(self) -> None:
        if self.step_bytes * self.steps != sum(self.shard_bytes):
            raise ValueError(f"{self.steps} steps of {self.step_bytes} bytes do not fill shards of {sum(self.shard_bytes)} bytes")

    def segments(self, step: int) -> list[tuple[int, int, int]]:
        """(shard, offset, bytes) of a step; a step may run over a shard's end."""
        start, out, base = step * self.step_bytes, [], 0
        stop = start + self.step_bytes
        for k, size in enumerate(self.shard_bytes):
            a, b = max(start, base), min(stop, base + size)
            if a < b:
                out.append((k, a - base, b - a))
            base += size
        return out


def read_steps(spark: SparkSession, shards: list[str], layout: StreamLayout, steps: list[int]) -> DataFrame:
    """(step, sequence, ids): each step read by one task through byte ranges and cut into sequences."""
    layout.check()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            for step in batch["step"]:
                raw = b""
                for k, offset, n in layout.segments(int(step)):
                    system, where = fs.FileSystem.from_uri(shards[k])
                    f = system.open_input_file(where)
                    f.seek(offset)
                    raw += f.read(n)
                ids = np.frombuffer(raw, "<u2").astype(np.int32).reshape(layout.sequences, layout.length)
                yield pd.DataFrame({"step": int(step), "sequence": np.arange(layout.sequences), "ids": list(ids)})

    at = spark.createDataFrame([(int(s),) for s in steps], "step long").repartition(max(1, len(steps)))
    return at.mapInPandas(read, "step long, sequence long, ids array<int>")


def markdown_table(lines: DataFrame, value: str = "value") -> DataFrame:
    """(row, column, name, cell) of a Markdown table held as text lines (line, value): header names, rule line skipped."""
    cells = F.transform(F.split(F.regexp_replace(F.trim(value), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    t = lines.where(F.startswith(F.trim(value), F.lit("|")) & ~F.rlike(value, F.lit(r"^[\s|:-]+$"))).select("line", cells.alias("cells"))
    head = t.agg(F.min_by("cells", "line").alias("names"), F.min("line").alias("first"))
    body = t.join(F.broadcast(head), F.col("line") > F.col("first"))
    return body.select(F.col("line").alias("row"), "names", F.posexplode("cells").alias("column", "cell")).select("row", "column", F.get("names", F.col("column")).alias("name"), "cell")
