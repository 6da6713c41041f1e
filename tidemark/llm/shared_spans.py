"""Long exact spans shared between records (problem 9): relative Lempel-Ziv parsing against indexed reference blocks.

Texts are dealt over reference blocks; each block is indexed (`relative_lz`), and every text is factored greedily against
every block that can hold a factor of ``min_chars`` of it. Which blocks can is told by winnowed anchors (`anchors`): a
stretch of that length cannot avoid a common one. Only stretches around anchors that another text holds too take part, as
no factor lies elsewhere. Factors of at least ``min_chars``, followed to their exact ends, are the shared spans.

Scale. Exact copies count as one text from the start. Anchors (about one in 60 characters) are counted with map-side
combine; those held by one text are dropped. What moves on are stretches around the others: once into their block, and
once for each block that holds an anchor of theirs. So a stretch that n texts hold costs n rows for each block, not for
each text. A block takes about ``BLOCK_CHARS`` characters and a task about ``QUERY_CHARS`` of the texts factored against
it; holders of a frequent anchor are salted. The share (`shared_share`) needs one other holder of a window only: windows
are counted, not paired, and only those around anchors whose surroundings differ between texts.

Defined results: null texts and texts below ``min_chars`` share nothing (share 0, or null for a null text); a text with
a repeated id counts once per id; a stretch repeated in one text only is not shared; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.anchors import anchors, code_points, fingerprints
from tidemark.llm.relative_lz import ReferenceBlock
from tidemark.session import ensure_checkpoint_dir

MIN_CHARS = 320
#: anchor window; the rest of a span is the run from which an anchor is chosen
WIDTH = 200
#: characters of a reference block, and of the texts that one task factors against it
BLOCK_CHARS, QUERY_CHARS = 2_000_000, 4_000_000
#: holders of an anchor that are routed together
ROUTED = 10_000


def _sketch(batches: Iterator[pa.RecordBatch], min_chars: int, width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        owner, pos, h = anchors(batch.column(1).to_pylist(), width, min_chars - width + 1)
        if not len(owner):
            continue
        order = np.lexsort((pos, h, owner))
        owner, pos, h = owner[order], pos[order].astype("<i4"), h[order]
        starts = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])])
        offsets = np.r_[starts, len(owner)].astype(np.int32) * 4
        places = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(pos.tobytes())])
        yield pa.RecordBatch.from_arrays([pa.array(h[starts].view(np.int64)), batch.column(0).take(pa.array(owner[starts])), places], names=["anchor", "id", "at"])


def _texts(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where(F.col("id").isNotNull() & (F.length("text") >= min_chars))


def copy_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(id, class_id) of the texts that have an exact copy; class_id is the least id of the class."""
    keyed = _texts(docs, id_col, text_col, min_chars).select("id", F.unhex(F.md5("text")).alias("copy_key"))
    classes = keyed.groupBy("copy_key").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return keyed.join(classes, "copy_key").select("id", "class_id").distinct()


def _cut(batches: Iterator[pa.RecordBatch], min_chars: int, width: int) -> Iterator[pa.RecordBatch]:
    """Of each text the stretches around its shared anchors, merged, with the places of these anchors in the text."""
    part = pa.list_(pa.struct([("start", pa.int32()), ("text", pa.string())]))
    around = min_chars - width
    for batch in batches:
        parts, chars, places, names = [], [], [], []
        for text, marks in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            at = [(int(p), m["anchor"]) for m in marks for p in np.frombuffer(m["at"], "<i4")]
            at.sort()
            cut = _merged([(max(0, p - around), min(len(text), p + width + around)) for p, _ in at])
            parts.append([{"start": a, "text": text[a:b]} for a, b in cut])
            chars.append(sum(b - a for a, b in cut))
            places.append([p for p, _ in at])
            names.append([h for _, h in at])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(parts, part), pa.array(chars, pa.int64()), pa.array(places, pa.list_(pa.int32())), pa.array(names, pa.list_(pa.int64()))],
            names=["id", "parts", "chars", "places", "anchors"],
        )


def _merged(parts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, stop in sorted(parts):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out


_STRETCHES = "id long, parts array<struct<start:int,text:string>>, chars long, places array<int>, anchors array<long>"


def stretches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, width: int = WIDTH) -> DataFrame:
    """One row for each different text that holds an anchor of another: its stretches around such anchors."""
    texts = _texts(docs, id_col, text_col, min_chars)
    # copies count as one text: all but the least id of a class are left out (few rows; broadcast only if so measured)
    others = copy_classes(docs, id_col, text_col, min_chars).where("id <> class_id").select("id")
    single = texts.join(others, "id", "left_anti").select("id", "text")
    sketch = single.mapInArrow(lambda it: _sketch(it, min_chars, width), "anchor long, id long, at binary")
    # how many texts hold an anchor is counted, combined in the map tasks, before any row goes by anchor
    counts = sketch.groupBy("anchor").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("anchor")
    marks = sketch.join(counts, "anchor").groupBy("id").agg(F.collect_list(F.struct("anchor", "at")).alias("marks"))  # of one text
    ensure_checkpoint_dir(docs.sparkSession)
    cut = single.join(marks, "id").select("id", "text", "marks").mapInArrow(lambda it: _cut(it, min_chars, width), _STRETCHES)
    return cut.checkpoint()  # the part of the texts that can be shared; read several times


def _factored(queries: pa.Table, references: pa.Table, min_chars: int) -> pa.Table:
    """Links (doc_a, doc_b) between the texts of a block and those factored against it; pairs inside the block once."""
    ids = references.column("id_in_block").to_pylist()
    parts = references.column("parts_in_block").to_pylist()
    owners = np.repeat(np.array(ids, np.int64), [len(p) for p in parts]) if ids else np.zeros(0, np.int64)
    block = ReferenceBlock(owners, [x["text"] for p in parts for x in p], min_chars)
    inside = set(ids)
    left, right = [], []
    for own, cut in zip(queries.column("id").to_pylist(), queries.column("parts").to_pylist()):
        met: list[np.ndarray] = []
        for x in cut:
            codes = code_points(x["text"])
            met += [block.texts_with(codes, f, own) for f in block.factors(codes, own)]
        if met:
            other = np.unique(np.concatenate(met))
            if own in inside:
                other = other[other < own]
            left.append(np.minimum(other, own))
            right.append(np.maximum(other, own))
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
    return pa.table({"doc_a": pa.array(a, pa.int64()), "doc_b": pa.array(b, pa.int64())})


def _links(cut: DataFrame, min_chars: int) -> DataFrame:
    total = cut.agg(F.sum("chars")).first()[0] or 0
    n = max(1, -(-total // BLOCK_CHARS))
    dealt = cut.select("id", "parts", "chars", "anchors", F.pmod(F.xxhash64("id"), F.lit(n)).alias("block"))
    if n == 1:
        route = dealt.select("id", "block", "chars")
    else:
        # a text goes to its own block and those before it in which another text holds one of its anchors
        held = dealt.select("id", "block", "chars", F.explode(F.array_distinct("anchors")).alias("anchor"))
        there = held.groupBy("anchor", "block").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count(F.lit(1)).alias("n"))
        salts = held.groupBy("anchor").agg(F.ceil(F.count(F.lit(1)) / ROUTED).cast("int").alias("salts"))
        hot = salts.where("salts > 1")
        query = held.join(hot, "anchor", "left").withColumn("salt", F.pmod(F.xxhash64("id"), F.coalesce("salts", F.lit(1))).cast("int")).select("anchor", "salt", "id", "chars", F.col("block").alias("own"))
        target = there.join(hot, "anchor", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts", "n")
        met = query.join(target, ["anchor", "salt"]).where("block <= own and not (least = id and most = id)")
        route = met.select("id", "block", "chars").distinct()
    chunks = route.groupBy("block").agg(F.ceil(F.sum("chars") / QUERY_CHARS).cast("int").alias("chunks"))
    queries = route.join(chunks, "block").select("id", "block", F.pmod(F.xxhash64("id", F.lit(7)), F.col("chunks")).cast("int").alias("chunk")).join(dealt.select("id", "parts"), "id")
    references = dealt.join(chunks, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "id", "parts")
    references = references.toDF("r_block", "r_chunk", "id_in_block", "parts_in_block")  # columns of their own
    both = queries.groupBy("block", "chunk").cogroup(references.groupBy("r_block", "r_chunk"))
    return both.applyInArrow(lambda q, r: _factored(q, r, min_chars), "doc_a long, doc_b long")


def shared_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, width: int = WIDTH) -> DataFrame:
    """Links between different texts: (doc_a, doc_b), doc_a < doc_b the least ids of their classes of copies, once each."""
    return _links(stretches(docs, id_col, text_col, min_chars, width), min_chars)


def shared_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """Every pair (doc_a < doc_b) of ids whose texts share ``min_chars`` characters, copies written out."""
    links = shared_links(docs, id_col, text_col, min_chars).select("doc_a", "doc_b")
    classes = copy_classes(docs, id_col, text_col, min_chars)

    def members(side: str) -> DataFrame:
        return classes.select(F.col("class_id").alias(side), F.col("id").alias(f"{side}_member"))

    wide = (
        links.join(members("doc_a"), "doc_a", "left")
        .join(members("doc_b"), "doc_b", "left")
        .select(F.coalesce("doc_a_member", "doc_a").alias("x"), F.coalesce("doc_b_member", "doc_b").alias("y"))
        .select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"))
    )
    same = (
        classes.select("class_id", F.col("id").alias("doc_a"))
        .join(classes.select("class_id", F.col("id").alias("doc_b")), "class_id")
        .where("doc_a < doc_b")
        .select("doc_a", "doc_b")
    )
    return wide.unionByName(same).distinct()


def merge_spans(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Union of the intervals [start, stop) of each key, as disjoint intervals."""
    w = Window.partitionBy(*keys).orderBy("start", "stop")
    upto = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return (
        spans.withColumn("new", (F.col("start") > F.coalesce(upto, F.lit(-1))).cast("int"))
        .withColumn("run", F.sum("new").over(w))
        .groupBy(*keys, "run")
        .agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
        .drop("run")
    )


def _surroundings(batches: Iterator[pa.RecordBatch], min_chars: int, width: int) -> Iterator[pa.RecordBatch]:
    """(anchor, id, start, stop, around): every place of an anchor with the hash of all windows' worth of text around it."""
    around = min_chars - width
    for batch in batches:
        rows: list[list] = [[], [], [], [], []]
        for own, parts, places, names in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4))):
            starts = np.array([p["start"] for p in parts])
            which = np.searchsorted(starts, places, side="right") - 1
            for p, h, k in zip(places, names, which.tolist()):
                text, off = parts[k]["text"], parts[k]["start"]
                a, b = max(0, p - around - off), min(len(text), p + width + around - off)
                for col, v in zip(rows, (h, own, off + a, off + b, xxhash.xxh3_64_intdigest(f"{p - off - a}:{text[a:b]}") - (1 << 63))):
                    col.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.int32()), pa.array(rows[3], pa.int32()), pa.array(rows[4], pa.int64())], names=["anchor", "id", "start", "stop", "around"])


def _window_rows(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[pa.RecordBatch]:
    """(print, id, most, start) of every window in the wanted stretches of a text."""
    for batch in batches:
        prints, ids, most, starts = [], [], [], []
        for own, parts, wanted in zip(*(batch.column(i).to_pylist() for i in range(3))):
            begins = np.array([p["start"] for p in parts])
            done: set[int] = set()
            for w in wanted:
                p = parts[int(np.searchsorted(begins, w["start"], side="right")) - 1]
                codes = code_points(p["text"][w["start"] - p["start"] : w["stop"] - p["start"]])
                if len(codes) < min_chars:
                    continue
                fp = fingerprints(codes, min_chars)
                where = np.arange(len(fp)) + w["start"]
                fresh = np.array([(x, w["most"]) not in done for x in where.tolist()])
                done.update((x, w["most"]) for x in where.tolist())
                prints.append(fp[fresh].view(np.int64))
                starts.append(where[fresh])
                ids.append(np.full(int(fresh.sum()), own))
                most.append(np.full(int(fresh.sum()), w["most"]))
        flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (prints, ids, most, starts)]
        yield pa.RecordBatch.from_arrays([pa.array(flat[0], pa.int64()), pa.array(flat[1], pa.int64()), pa.array(flat[2], pa.int64()), pa.array(flat[3].astype(np.int32), pa.int32())], names=["print", "id", "most", "start"])


def _covered(cut: DataFrame, min_chars: int, width: int) -> DataFrame:
    """(class_id, start, stop): stretches of each text that stand in another one.

    Places of an anchor with the same surroundings in several texts are covered as they are, from one of these texts.
    Where surroundings differ, every window is looked up in the windows of one text of each surroundings.
    """
    seen = cut.mapInArrow(lambda it: _surroundings(it, min_chars, width), "anchor long, id long, start int, stop int, around long")
    kinds = seen.groupBy("anchor", "around").agg(F.min("id").alias("least"), F.max("id").alias("most"))
    several = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"))
    told = kinds.join(several, "anchor")
    place = seen.join(told, ["anchor", "around"])
    alike = place.where(F.col("least") < F.col("most")).where(F.col("stop") - F.col("start") >= min_chars).select(F.col("id").alias("class_id"), "start", "stop")
    # of surroundings that several texts have, one text stands for all; most tells that there are others
    asked = place.where("kinds > 1 and id = least").groupBy("id").agg(F.collect_set(F.struct("start", "stop", "most")).alias("wanted"))  # of one text
    windows = cut.select("id", "parts").join(asked, "id").select("id", "parts", "wanted").mapInArrow(lambda it: _window_rows(it, min_chars), "print long, id long, most long, start int")
    shared = windows.groupBy("print").agg(F.min("id").alias("a"), F.max("most").alias("b")).where("a < b").select("print")
    found = windows.where("id = most").join(shared, "print").select(F.col("id").alias("class_id"), "start", (F.col("start") + min_chars).alias("stop"))
    return merge_spans(alike.unionByName(found), ["class_id"])


def shared_share(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """For every record: its length, its class of copies, the spans and characters that stand elsewhere too, and their share.

    A record with a copy is one span, shared whole. No pair of records is formed.
    """
    covered = _covered(stretches(docs, id_col, text_col, min_chars), min_chars, WIDTH).groupBy("class_id").agg(F.sum(F.col("stop") - F.col("start")).alias("covered"), F.count(F.lit(1)).alias("n_spans"))
    classes = copy_classes(docs, id_col, text_col, min_chars).select(F.col("id"), "class_id", F.lit(True).alias("copied"))
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.length(text_col).alias("n_chars")).dropDuplicates(["id"])
    out = base.join(classes, "id", "left").withColumn("class_id", F.coalesce("class_id", "id")).join(covered, "class_id", "left")
    none = F.lit(0)
    shared = F.when(F.col("copied"), F.col("n_chars").cast("long")).otherwise(F.coalesce("covered", none).cast("long"))
    return out.select(
        F.col("id").alias("doc_id"),
        "class_id",
        F.col("n_chars").cast("long").alias("n_chars"),
        F.when(F.col("copied"), F.lit(1)).otherwise(F.coalesce("n_spans", none)).cast("long").alias("spans"),
        F.when(F.col("n_chars").isNotNull(), shared).alias("shared_chars"),
        F.when(F.col("n_chars") > 0, shared / F.col("n_chars")).alias("shared_share"),
    )
