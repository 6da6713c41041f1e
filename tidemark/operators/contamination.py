"""Benchmark probes in training text, by an n-gram equi-join instead of a scan with thousands of patterns.

A probe is the middle ``size`` words of an item's text. Texts are cut at white space; a window of words can only hold a
probe if its inner words equal the probe's inner words, so windows and probes meet by a hash of those, and the meeting
is verified on the words themselves: the first word must end with the probe's first, the last begin with its last,
without a letter or digit beyond.

Scale: each word of a text is hashed once and the hashes of all windows of a length are differences of running sums. A
bit set of fixed size that holds the probes' hashes lets a text leave out, where it is read, the windows that no probe
has; only the others become rows. One row a (text, probe) leaves the join.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.stats import wilson

SIZE, LEAST = 13, 8
_BLANK = r"[\t\n\f\r ]+"
_SPLIT = re.compile(_BLANK)


def word_array(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), _BLANK), lambda w: F.length(w) > 0)


def probes(items: DataFrame, size: int = SIZE, least: int = LEAST) -> DataFrame:
    """(item_id, part, probe, words): the middle window of each question and answer of at least ``least`` words."""
    parts = items.select("item_id", F.explode(F.create_map(F.lit("question"), "question", F.lit("answer"), "answer")).alias("part", "body")).where("body is not null")
    words = parts.withColumn("w", word_array(F.col("body"))).where(F.size("w") >= least)
    n = F.least(F.size("w"), F.lit(size))
    return words.select("item_id", "part", F.slice("w", F.floor((F.size("w") - n) / 2).cast("int") + 1, n).alias("words")).withColumn("probe", F.array_join("words", " "))


def _edge(a: Column, probe: Column, first: bool) -> Column:
    """Whether a text word holds the probe's outer word at its inner end with no letter or digit beyond."""
    extra = F.length(a) - F.length(probe)
    beyond = F.substring(a, extra, F.lit(1)) if first else F.substring(a, F.length(probe) + 1, F.lit(1))
    own = F.left(probe, F.lit(1)) if first else F.right(probe, F.lit(1))
    whole = ~(F.rlike(own, F.lit("[0-9a-z_]")) & F.rlike(beyond, F.lit("[0-9a-z_]")))
    return (F.endswith(a, probe) if first else F.startswith(a, probe)) & ((extra == 0) | whole)


_BASE = np.uint64(0xD1342543DE82EF95)  # odd, so it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


class _Roller:
    """Hashes of all windows of words; hashes of words are kept between batches."""

    KEPT = 500_000

    def __init__(self) -> None:
        self.known: dict[str, int] = {}
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def sums(self, words: list[str]) -> np.ndarray:
        if len(self.known) > self.KEPT:
            self.known.clear()
        known = self.known
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w)
        if len(self.up) <= len(words):
            n = max(1 << 16, 2 * len(words))
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                p = np.full(n, base, np.uint64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        return np.r_[np.uint64(0), np.cumsum(h * self.up[: len(h)], dtype=np.uint64)]

    def windows(self, sums: np.ndarray, inner: int) -> np.ndarray:
        """The hash of the ``inner`` words from each place on."""
        n = len(sums) - inner
        if n <= 0:
            return np.zeros(0, np.uint64)
        h = (sums[inner:] - sums[:n]) * self.down[:n]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))


#: bits of the set of probe hashes that is sent to the tasks; its size does not grow with the probes
BITS = 1 << 24


def _probe_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    roll = _Roller()
    for batch in batches:
        keys = []
        for w in batch.column(2).to_pylist():
            inner = w[1:-1]
            keys.append(int(roll.windows(roll.sums(inner), len(inner))[0]) if inner else 0)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.array(keys, np.uint64).view(np.int64), pa.int64())], names=[*batch.schema.names, "key"])


def _bits(keys: DataFrame) -> Broadcast:
    """The bit set of the hashes of a column key."""
    at = F.pmod("key", F.lit(BITS))  # BITS divides 2**64, so signed and unsigned hashes agree
    rows = keys.select(F.shiftright(at, 6).alias("word"), F.expr("shiftleft(1L, CAST(pmod(key, 64) AS INT))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(BITS // 64, np.uint64)
    out[rows.column("word").to_numpy().astype(np.int64)] = rows.column("bits").to_numpy().astype(np.int64).view(np.uint64)
    return keys.sparkSession.sparkContext.broadcast(out)


def _scan(batches: Iterator[pa.RecordBatch], lengths: list[int], sought: Broadcast) -> Iterator[pa.RecordBatch]:
    """The key columns and (n, key, tw) of the windows whose hash the bit set holds; the last column is the text."""
    roll, bits = _Roller(), sought.value
    for batch in batches:
        owner: list[np.ndarray] = []
        out_n, out_key, out_words = [], [], []
        for i, text in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
            words = [w for w in _SPLIT.split(text) if w] if text else []
            if len(words) < lengths[0]:
                continue
            sums = roll.sums(words)
            for n in lengths:
                if len(words) < n:
                    break
                key = roll.windows(sums, n - 2)[1 : len(words) - n + 2] if n > 2 else np.zeros(len(words) - n + 1, np.uint64)
                at = key % np.uint64(BITS)
                hit = np.flatnonzero((bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1))
                if len(hit):
                    owner.append(np.full(len(hit), i))
                    out_n += [n] * len(hit)
                    out_key.append(key[hit])
                    out_words += [words[k : k + n] for k in hit.tolist()]
        rows = pa.array(np.concatenate(owner) if owner else np.zeros(0, np.int64))
        keys = np.concatenate(out_key).view(np.int64) if out_key else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c).take(rows) for c in range(batch.num_columns - 1)), pa.array(out_n, pa.int32()), pa.array(keys, pa.int64()), pa.array(out_words, pa.list_(pa.string()))],
            names=[*batch.schema.names[:-1], "n", "key", "tw"],
        )


def probe_hits(texts: DataFrame, keys: list[str], text: str, found: DataFrame) -> DataFrame:
    """keys + (item_id, part): every probe found in every text, once for each pair."""
    kind = found.schema["item_id"].dataType.simpleString()
    p = found.select("item_id", "part", "words").mapInArrow(_probe_keys, f"item_id {kind}, part string, words array<string>, key long").withColumn("n", F.size("words"))
    lengths = sorted(r.n for r in p.select("n").distinct().collect())  # at most SIZE - LEAST + 1 values
    kept = [f"key_{i}" for i in range(len(keys))]  # names of their own, whatever the table's are
    base = texts.select(*[F.col(k).alias(n) for k, n in zip(keys, kept)], F.lower(F.col(text)).alias("low"))
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in base.schema.fields[:-1])
    sought = _bits(p.select("key"))
    cut = base.mapInArrow(lambda it: _scan(it, lengths or [SIZE], sought), f"{ddl}, n int, key long, tw array<string>")
    met = cut.join(p, ["key", "n"])
    same = F.slice("tw", 2, F.greatest(F.lit(0), F.col("n") - 2)) == F.slice("words", 2, F.greatest(F.lit(0), F.col("n") - 2))
    first = _edge(F.get("tw", 0), F.get("words", 0), True)
    last = _edge(F.element_at("tw", -1), F.element_at("words", -1), False)
    return met.where(same & first & last).select(*[F.col(n).alias(k) for k, n in zip(keys, kept)], "item_id", "part").distinct()


#: the sets of items that a training table gives: what was read, produced, scored, rejected
ITEM_SETS = {"question_read": ("question", ("prompt",)), "question_produced": ("question", ("response", "chosen")), "answer_produced": ("answer", ("response", "chosen")), "answer_scored": ("answer", ("reference", "rollout")), "answer_rejected": ("answer", ("rejected",))}


def side_hits(rows: DataFrame, key: str, items: DataFrame) -> DataFrame:
    """(row, side, item_id, part): probes found in the texts of training rows, by the side they stand on, once each.

    The rows' schema tells the sides (see `fields`); null and empty texts hold nothing.
    """
    from tidemark.operators import fields

    long = fields.field_rows(rows, key, []).select("row", "side", "text")
    return probe_hits(long, ["row", "side"], "text", probes(items))


def side_counts(hit: DataFrame) -> DataFrame:
    """For each side and part the rows that hold a probe and the items found."""
    return hit.groupBy("side", "part").agg(F.countDistinct("row").alias("rows"), F.countDistinct("item_id").alias("items"))


def item_sets(hit: DataFrame, items: DataFrame) -> DataFrame:
    """For each benchmark its items, those seen at all and those of each of ITEM_SETS."""
    flags = [F.bool_or((F.col("part") == part) & F.col("side").isin(*sides)).alias(name) for name, (part, sides) in ITEM_SETS.items()]
    seen = hit.groupBy("item_id").agg(F.lit(True).alias("any_seen"), *flags)
    return items.select("item_id", "benchmark").join(seen, "item_id", "left").groupBy("benchmark").agg(F.count(F.lit(1)).alias("items"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(c) for c in ("any_seen", *ITEM_SETS)])


def item_rollup(hit: DataFrame, items: DataFrame) -> DataFrame:
    """For each benchmark its items, items seen at all and by part, with the share seen and its bounds."""
    seen = hit.groupBy("item_id").agg(F.bool_or(F.col("part") == "question").alias("q"), F.bool_or(F.col("part") == "answer").alias("a"))
    base = items.select("item_id", "benchmark").join(seen, "item_id", "left").groupBy("benchmark").agg(
        F.count(F.lit(1)).alias("items"), F.count(F.when(F.col("q") | F.col("a"), 1)).alias("seen"), F.count_if(F.coalesce("q", F.lit(False))).alias("question_seen"), F.count_if(F.coalesce("a", F.lit(False))).alias("answer_seen")
    )
    low, high = wilson(F.col("seen"), F.col("items"))
    return base.select("*", low.alias("lo"), high.alias("hi"))
