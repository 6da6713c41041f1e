"""Evaluation texts inside training text (problem 7): an FM-index for each shard of documents.

A shard is a bounded run of documents of one task. Its words (runs of letters and digits, case folded) become numbers;
words that no evaluation phrase uses are all the same break, and stretches between breaks that are too short for a
phrase are left out, as none can hold one. All phrases of ``words`` consecutive words of the items are searched in
step through wavelet ranks; occurrences are located by sampled suffix positions and merged into removal spans.

Scale. One pass over the documents and no shuffle of text: only hits leave a task. The items are the stated query set:
they are taken in blocks of at most ``BLOCK`` phrases, one pass over the documents for each block, so what is sent to
the tasks is bounded whatever the number of items. Exact: an occurrence is one if and only if its words are equal.

Defined results: null or empty texts and items have no occurrence; questions or answers of fewer than ``words`` words
cannot leak; equal phrases count for each item that holds them; repeated ids merge; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.fm_index import FMIndex
from tidemark.llm.shared_spans import merge_spans

WORDS = 10
#: phrases of one pass
BLOCK = 200_000
#: characters of one shard
SHARD = 16_000_000

WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.casefold()) if text else []


class Phrases:
    """All phrases of a block of items: a matrix of word numbers and the items of each row."""

    def __init__(self, items: list[tuple[int, str, str | None]], words: int) -> None:
        self.vocabulary: dict[str, int] = {}
        self.words = words
        rows: dict[tuple[int, ...], set[tuple[int, str]]] = {}
        for item, part, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            for i in range(len(ids) - words + 1):
                rows.setdefault(tuple(ids[i : i + words]), set()).add((item, part))
        self.matrix = np.array(list(rows), np.int64).reshape(len(rows), words)
        self.owners = [sorted(v) for v in rows.values()]


def _shard_hits(texts: list[str], phrases: Phrases) -> Iterator[tuple[int, int, int, str]]:
    """(text index, first word, item, part) of each occurrence in one shard."""
    pieces, where = [], []
    get = phrases.vocabulary.get
    for t, text in enumerate(texts):
        found = words_of(text)
        ids = np.fromiter((get(w, 0) for w in found), np.int64, len(found))
        edge = np.flatnonzero(np.diff(np.r_[0, (ids > 0).astype(np.int8), 0]))
        for s, e in zip(edge[::2], edge[1::2]):
            if e - s >= phrases.words:
                pieces.append(np.r_[ids[s:e], 0])
                where.append((t, s))
    if not pieces:
        return
    starts = np.r_[0, np.cumsum([len(p) for p in pieces])[:-1]]
    index = FMIndex(np.concatenate(pieces))
    low, high = index.search(phrases.matrix)
    hit = np.flatnonzero(high > low)
    counts = (high - low)[hit]
    if not len(hit):
        return
    within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    position = index.locate(np.repeat(low[hit], counts) + within)
    run = np.searchsorted(starts, position, side="right") - 1
    for k, p, r in zip(np.repeat(hit, counts).tolist(), position.tolist(), run.tolist()):
        t, s = where[r]
        for item, part in phrases.owners[k]:
            yield t, int(s) + p - int(starts[r]), item, part


_HIT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("part", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("words", pa.int64())])


def _search(batches: Iterator[pa.RecordBatch], phrases: Phrases) -> Iterator[pa.RecordBatch]:
    def flush(ids: list[int], texts: list[str]) -> pa.RecordBatch:
        by: dict[tuple[int, int, str], list[int]] = {}
        for t, w, item, part in _shard_hits(texts, phrases):
            by.setdefault((t, item, part), []).append(w)
        bounds: dict[int, list[tuple[int, int]]] = {}
        rows = []
        for (t, item, part), at in by.items():
            if t not in bounds:  # character places of the words, for texts with a hit only
                bounds[t] = _places(texts[t])
            at.sort()
            first = last = at[0]
            for w in [*at[1:], None]:
                if w is not None and w <= last + phrases.words:
                    last = w
                    continue
                stop = last + phrases.words
                rows.append((ids[t], item, part, bounds[t][first][0], bounds[t][stop - 1][1], stop - first))
                if w is not None:
                    first = last = w
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_HIT)], schema=_HIT)

    ids: list[int] = []
    texts: list[str] = []
    size = 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids.append(i)
            texts.append(t)
            size += len(t)
            if size >= SHARD:
                yield flush(ids, texts)
                ids, texts, size = [], [], 0
    if texts:
        yield flush(ids, texts)


def _places(text: str) -> list[tuple[int, int]]:
    """Character places of the words of the folded text, in the text as it is."""
    folded = text.casefold()
    if len(folded) == len(text):
        return [m.span() for m in WORD.finditer(folded)]
    origin = [i for i, c in enumerate(text) for _ in c.casefold()]
    return [(origin[m.start()], origin[m.end() - 1] + 1) for m in WORD.finditer(folded)]


def leaked_spans(docs: DataFrame, items: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, part, start, stop, words): stretches of a document that stand in an item, by part of the item."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    parts = items.select(F.col("item_id").cast("long").alias("item_id"), F.explode(F.create_map(F.lit("question"), "question", F.lit("answer"), "answer")).alias("part", "body")).where("item_id is not null and length(body) > 0")
    out: DataFrame | None = None

    def one_pass(block: list[tuple[int, str, str | None]]) -> DataFrame:
        phrases = spark.sparkContext.broadcast(Phrases(block, words))
        return texts.mapInArrow(lambda it: _search(it, phrases.value), "doc_id long, item_id long, part string, start long, stop long, words long")

    block: list[tuple[int, str, str | None]] = []
    size = 0
    for r in parts.toLocalIterator():
        block.append((r.item_id, r.part, r.body))
        size += len(words_of(r.body))
        if size >= BLOCK:
            out, block, size = one_pass(block) if out is None else out.unionByName(one_pass(block)), [], 0
    if block or out is None:
        out = one_pass(block) if out is None else out.unionByName(one_pass(block))
    return out


def leaked_pairs(docs: DataFrame, items: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, item_id), each once."""
    return leaked_spans(docs, items, words).select("doc_id", "item_id").distinct()


def removal_spans(docs: DataFrame, items: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, start, stop): what to cut from each document, overlapping and touching stretches of all items merged."""
    return merge_spans(leaked_spans(docs, items, words).select("doc_id", "start", "stop"), ["doc_id"])


def leaks_by_benchmark(docs: DataFrame, items: DataFrame, words: int = WORDS) -> DataFrame:
    """For each benchmark and split its items, how many of them leaked, into how many documents."""
    key = ["benchmark", "split"]
    pairs = leaked_pairs(docs, items, words)
    base = items.select("item_id", *key).dropDuplicates(["item_id"])
    total = base.groupBy(*key).agg(F.count(F.lit(1)).alias("items"))
    hit = pairs.join(base, "item_id").groupBy(*key).agg(F.countDistinct("item_id").alias("leaked_items"), F.countDistinct("doc_id").alias("documents"))
    same = [total[k].eqNullSafe(hit[k]) for k in key]
    return total.join(hit, same, "left").select(
        *[total[k] for k in key],
        total["items"],
        F.coalesce(hit["leaked_items"], F.lit(0)).cast("long").alias("leaked_items"),
        F.coalesce(hit["documents"], F.lit(0)).cast("long").alias("documents"),
    )
