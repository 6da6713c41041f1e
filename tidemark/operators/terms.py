"""Counts of word n-grams and posting lists of character trigrams.

n-grams are counted by 64-bit hashes: a batch sums its own counts before anything is shuffled, one exchange sums the rest,
and only those frequent enough are read once more for their words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import trigrams
from tidemark.operators.contamination import BITS, _bits, _Roller, _SPLIT


def _grams(text: str | None, size: int, roll: _Roller) -> tuple[list[str], np.ndarray]:
    words = [w for w in _SPLIT.split(text) if w] if text else []
    return words, roll.windows(roll.sums(words), size) if len(words) >= size else np.zeros(0, np.uint64)


def _counted(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    roll = _Roller()
    for batch in batches:
        keys, counts = [], []
        for text in batch.column(0).to_pylist():
            k, n = np.unique(_grams(text, size, roll)[1], return_counts=True)
            keys.append(k)
            counts.append(n)
        if not keys:
            continue
        k, n = np.concatenate(keys), np.concatenate(counts)
        each, at, docs = np.unique(k, return_inverse=True, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(each.view(np.int64)), pa.array(np.bincount(at, n, len(each)).astype(np.int64)), pa.array(docs.astype(np.int64))], names=["key", "occurrences", "documents"])


def _spelled(batches: Iterator[pa.RecordBatch], size: int, wanted: Broadcast) -> Iterator[pa.RecordBatch]:
    roll, bits = _Roller(), wanted.value
    for batch in batches:
        found: dict[int, str] = {}
        for text in batch.column(0).to_pylist():
            words, key = _grams(text, size, roll)
            at = key % np.uint64(BITS)
            for i in np.flatnonzero((bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).tolist():
                if int(key[i]) not in found:
                    found[int(key[i])] = " ".join(words[i : i + size])
        yield pa.RecordBatch.from_arrays([pa.array(np.array(list(found), np.uint64).view(np.int64), pa.int64()), pa.array(list(found.values()), pa.string())], names=["key", "gram"])


def ngram_counts(texts: DataFrame, text: str, size: int = 3, least: int = 1) -> DataFrame:
    """(gram, occurrences, documents): word n-grams that occur at least ``least`` times, in lower case, words cut at white space.

    documents counts rows; null texts and texts of fewer words hold none.
    """
    low = texts.select(F.lower(F.col(text)).alias("low"))
    counts = low.mapInArrow(lambda it: _counted(it, size), "key long, occurrences long, documents long").groupBy("key").agg(F.sum("occurrences").alias("occurrences"), F.sum("documents").alias("documents"))
    often = counts.where(F.col("occurrences") >= least)
    wanted = _bits(often.select("key"))
    words = low.mapInArrow(lambda it: _spelled(it, size, wanted), "key long, gram string").groupBy("key").agg(F.min("gram").alias("gram"))
    return often.join(words, "key").select("gram", "occurrences", "documents")


def postings(df: DataFrame, key: str, text: str, block: int = 1_000_000) -> DataFrame:
    """(gram, block, items, first_item, postings): the sorted keys of the texts that hold a trigram, in blocks of the keys' range.

    A block holds at most ``block`` keys, so the list of a common trigram is never one row.
    """
    g = df.select(F.col(key).alias("k"), F.explode(trigrams(F.col(text))).alias("gram"))
    cut = g.groupBy("gram", F.floor(F.col("k") / block).alias("block"))
    return cut.agg(F.count(F.lit(1)).alias("items"), F.min("k").alias("first_item"), F.array_sort(F.collect_list("k")).alias("postings"))
