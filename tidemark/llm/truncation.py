"""Text cut off by field limits (problem 3): aligned near copies, open structures and closing-word terminality.

1. Forms. A turn that ends with an end mark or a closed block is complete; one that leaves a code block, bracket, formula,
   link or table row open is cut.
2. Near copies. Turns of other form are looked up among all texts by min-hash banding of five-word shingles, of whole texts
   and of their heads of 16, 32, 64 ... words, so that a copy is met wherever it was cut. Pairs in which the longer text
   holds 0.8 of the shorter one's shingles are aligned; the copy whose alignment ends inside a word or sentence of the
   other is cut, the one whose end is the end of a sentence there is complete.
3. Terminality. What has no such copy is scored by a logistic model of how sentences close: their last words, their first
   words with their length, and words never seen whole. It learns from the texts themselves: lines and sentences that
   something follows, and lines of closed code blocks, are whole, the same clipped at a random character are cut.
4. Field limits. Lengths at which a source's open-ended turns pile up far beyond neighbouring lengths are limits; there a
   turn is cut if it is more likely cut than not.

Scale. Turns are scored where they are read. Only open-ended turns seek a copy: a bit set of fixed size that holds their
band keys lets the other texts leave out, before any exchange, the bands that none of them seeks. Open-ended turns meet
all longer texts of their bands, of those with the same words up to three times the head one for all, and all these pairs
are verified. The open-ended turns of a band are dealt over blocks of about ``BLOCK``, so no band is gathered in one task;
exact copies meet once. The model is fitted on about ``SAMPLE_ROWS`` rows a table, taken by hash at the scan; all else
covers all rows.

Defined results: null, empty and wordless turns are not cut; a turn that repeats the user turn before it is a copy, not
a cut; repeated rows are each reported; a turn under 16 words is judged by form and terminality only.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.minhash import BANDS, SIMILAR, Sketcher, WORD, containment, words
from tidemark.session import ensure_checkpoint_dir

#: rows of each table from which the terminality model is fitted, about; those below a cut of the hash of row_id
SAMPLE_ROWS = 6000
#: whole sentences used at most
SAMPLE_SENTENCES = 50_000
#: doubtful texts of a band that meet its texts in one block
BLOCK = 64
#: bits of the set of band keys that are sought; its size does not grow with the data
SOUGHT_BITS = 1 << 25
#: pairs of words compared at most to choose between places at which closing words stand
COMPARED = 20_000_000

_CLOSED = re.compile(r"[.!?…。！？；][\"'”’»)\]*_]*\Z|```\s*\Z|[\U0001F300-\U0001FAFF☀-➿️]\Z|(?:^|\n)\s*(?:-{3,}|\*{3,}|_{3,}|—+)\Z|</\w+>\Z")
_RESULT = re.compile(r"(?:^|\n)\s*(?:#{1,6}|=|->|=>|\*\*)?\s*[-+]?[\d.,]*\d%?(?:\*\*)?\Z|\\boxed\{[^{}]*\}\$?\Z|(?:^|[ \n(])\[\d+\]\Z|(?:[:：]|\b(?:no|nr|tel|tél|núm)\.|n°)\s*\+?\(?\d[\d .()/-]*\d\Z|[:：]\s*(?=[^\n:：]*\d)(?:[\w'’.,º-]+ ){0,6}(?:[A-ZÀ-Ý][\w'’-]+|[\w-]*\d)\Z")
_LINK = re.compile(r"(?:https?://|www\.)\S*\Z")
_LINK_DONE = re.compile(r"https?://[\w.-]+\.[a-z]{2,}(?::\d+)?/\S*[^\W_]\Z|https?://[\w.-]+\.(?:com|org|net|edu|gov|io|example|test|invalid|de|fr|es|br|cn|uk)/?\Z")
_CODE = re.compile(r"```(.*?)```", re.S)
_THINK = re.compile(r"<think>.*?</think>", re.S)
_BULLET = re.compile(r"^\s*(?:[-*•]|\d+[.)])\s+")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"'”’»)]*\s+|(?<=[。！？；])[”’》)]*|\n+")
_UNIT = re.compile(r"[㐀-鿿]|[^\W\d_㐀-鿿]+(?:['’-][^\W\d_㐀-鿿]+)*|\d+|[^\w\s]")
_CODED = re.compile(r"[\w.+-]+ ?[\[(](?:at|AT)[\])] ?[\w-]+(?: ?[\[(](?:dot|DOT)[\])] ?[\w-]+|\.\w[\w.-]*)*|[\w.+-]*@[\w.:-]+\w|\w*\d\w*(?:[.,:/-]\w*\d\w*)*")
_PAIRS = {")": "(", "]": "[", "}": "{", "”": "“", "»": "«", "）": "（", "」": "「", "》": "《"}


def open_structure(text: str) -> str | None:
    """What a text leaves open: code, link, formula, table or bracket."""
    if text.count("```") % 2:
        return "code"
    body = re.sub(r"```.*?```", " ", text, flags=re.S) if "```" in text else text
    end = body.rstrip()
    link = _LINK.search(end)
    if link:
        return None if _LINK_DONE.match(link[0]) else "link"
    if end.count("$$") % 2:
        return "formula"
    last = end[end.rfind("\n") + 1 :]
    if last.startswith("|") and last.count("|") > 1 and not last.endswith("|") and len(last) - last.rfind("|") < 30 and not _CLOSED.search(last):
        return "table"
    stack: list[str] = []
    for c in end[-2000:] if len(end) > 2000 and not any(x in end[:-2000] for x in "([{") else end:
        if c in "([{“«（「《":
            stack.append(c)
        elif c in _PAIRS:
            if stack and stack[-1] == _PAIRS[c]:
                stack.pop()
    return "bracket" if stack and not _CLOSED.search(end) else None


def closed_form(text: str) -> bool:
    """Whether the end alone shows that a text is complete."""
    end = text.rstrip()
    if _CLOSED.search(end) or _RESULT.search(end):
        return True
    last = end[end.rfind("\n") + 1 :].strip()
    if last.endswith("|") and last.count("|") > 2:
        return True
    return bool(end) and (end[-1] in ")]}»”" or bool((m := _LINK.search(end)) and _LINK_DONE.match(m[0])))


def tail(text: str) -> str:
    """The last sentence or line of a text, as far as it goes."""
    last = text.rstrip()
    last = last[last.rfind("\n") + 1 :]
    parts = [x for x in _SENTENCE.split(last) if x and x.strip()]
    return _BULLET.sub("", parts[-1] if parts else last).strip()


def _plain(text: str) -> str:
    """Addresses and all that holds a digit are one number: what they are does not tell how a sentence closes."""
    return _CODED.sub("0", text) if _CODED.search(text) else text


def units(text: str) -> list[str]:
    return ["0" if w.isdigit() else w.lower() for w in _UNIT.findall(_plain(text))]


class Terminality:
    """Logistic model: the probability that a sentence is whole, from how it opens and closes."""

    BITS = 18

    def __init__(self) -> None:
        self.vocabulary: set[str] = set()
        self.weights = np.zeros(1 << self.BITS, np.float32)

    def features(self, sentence: str) -> np.ndarray:
        u = units(sentence)
        raw = _UNIT.findall(_plain(sentence))
        seen = [w if w in self.vocabulary else ("<X>" if r[:1].isupper() else "<x>") for w, r in zip(u, raw)]
        n = len(seen)
        pad = ["^"] * 5 + seen
        f = ["bias", f"n={min(n, 40)}"]
        f += [f"e{k}={' '.join(pad[-k:])}" for k in (1, 2, 3, 4, 5)]
        head = [" ".join(seen[:k]) for k in (1, 2, 3)]
        f += [f"h{k}n={h}|{n}" for k, h in enumerate(head)]
        f += [f"h{k}e1={h}|{pad[-1]}" for k, h in enumerate(head)]
        f += [f"h{k}e2={h}|{pad[-2]} {pad[-1]}" for k, h in enumerate(head)]
        f += [f"g={pad[-4]} {pad[-3]} _ {pad[-1]}", f"g2={pad[-4]} {pad[-3]}", f"g3={pad[-5]} {pad[-4]}", f"last={seen[-1] if seen else ''}", f"raw={raw[-1][:1].isupper() if raw else ''}"]
        return np.array([xxhash.xxh32_intdigest(x) & ((1 << self.BITS) - 1) for x in f], np.int64)

    def fit(self, whole: list[str], seed: int = 5, epochs: int = 6) -> Terminality:
        r = random.Random(seed)
        counts = Counter(w for s in whole for w in units(s))
        self.vocabulary = {w for w, n in counts.items() if n >= 3}
        rows, labels = [], []
        for s in whole:
            rows.append(self.features(s))
            labels.append(1.0)
            if len(s) > 3:
                cut = s[: r.randint(1, len(s) - 1)].rstrip()
                if cut and units(cut) != units(s):
                    rows.append(self.features(cut))
                    labels.append(0.0)
        if not rows:
            return self
        x, y = np.stack(rows), np.array(labels, np.float32)
        weights = np.zeros(1 << self.BITS, np.float64)
        square = np.full(1 << self.BITS, 1e-8)
        order = np.random.default_rng(seed)
        for _ in range(epochs):
            for batch in np.array_split(order.permutation(len(x)), max(1, len(x) // 512)):
                p = 1 / (1 + np.exp(-weights[x[batch]].sum(1)))
                g = (p - y[batch])[:, None].repeat(x.shape[1], 1)
                step = np.bincount(x[batch].ravel(), g.ravel(), len(weights))
                live = step != 0
                square[live] += step[live] ** 2
                weights[live] -= 0.15 * step[live] / np.sqrt(square[live]) + 1e-5 * weights[live]
        self.weights = weights.astype(np.float32)
        return self

    def score(self, sentence: str) -> float:
        return float(1 / (1 + np.exp(-self.weights[self.features(sentence)].sum())))


def whole_sentences(texts: list[str]) -> list[str]:
    """Sentences and lines of texts that something follows or an end mark closes, without the mark; lines of closed code blocks."""
    out = []
    for t in texts:
        for code in _CODE.findall(t) if "```" in t else ():
            out += [x.strip() for x in code.split("\n")[1:] if len(x.strip()) > 2 and x.rstrip()[-1].isalnum()]
        t = re.sub(r"```.*?(?:```|\Z)", "\n", t, flags=re.S)
        parts = [x.strip() for x in _SENTENCE.split(t) if x and x.strip()]
        if parts and not _CLOSED.search(t.rstrip()):
            parts.pop()
        for p in parts:
            p = _BULLET.sub("", p)
            p = re.sub(r"[.!?…。！？；][\"'”’»)\]]*\Z", "", p).strip()
            if len(p) > 2 and p[-1].isalnum():
                out.append(p)
    return out


def hash_sample(df: DataFrame, rows: int) -> DataFrame:
    """About so many rows, those below a cut of the hash of row_id that follows from the number of rows.

    The cut is made where the rows are read: nothing but the sample moves, however large the table. Never more than twice
    as many (row_ids that repeat without end).
    """
    n = df.count()  # of the file footers
    if n <= rows:
        return df
    space = 1 << 30
    return df.where(F.pmod(F.xxhash64("row_id"), F.lit(space)) < int(space * rows / n)).limit(2 * rows)


_trained: dict[tuple, Broadcast] = {}


def terminality_model(frames: list[tuple[DataFrame, str]]) -> Broadcast:
    """A model fitted on samples of (rows with row_id, array column of turns); once a session and data set."""
    spark = frames[0][0].sparkSession
    texts: list[str] = []
    for df, col in frames:
        rows = hash_sample(df, SAMPLE_ROWS).select("row_id", F.col(f"{col}.content").alias("c")).collect()
        texts += [t for r in sorted(rows, key=lambda r: (r.row_id is None, r.row_id)) for t in r.c or [] if t]
    whole = whole_sentences(texts)
    random.Random(3).shuffle(whole)
    whole = whole[:SAMPLE_SENTENCES]
    key = (spark.sparkContext.applicationId, xxhash.xxh64_intdigest("\n".join(whole)))
    if key not in _trained:
        _trained[key] = spark.sparkContext.broadcast(Terminality().fit(whole))
    return _trained[key]


# ---------------------------------------------------------------------------------------------------------------- turns


def fold(col: Column) -> Column:
    """Letters and digits of a text in lower case: equal for texts that differ superficially."""
    return F.regexp_replace(F.lower(col), r"[^\p{L}\p{N}]+", "")


def turns(df: DataFrame, stage: str, side: str, source: str) -> DataFrame:
    """One row a turn: (stage, row_id, side, turn, source, role, content, calls, user, asked).

    user is the content of the nearest user turn before, asked whether there is one.

    Only role, content and function_calls are read of the nested column.
    """
    kind = {f.name for f in df.schema[side].dataType.elementType.fields}
    calls = F.col(f"{side}.function_calls") if "function_calls" in kind else F.transform(F.col(f"{side}.role"), lambda x: F.lit(None).cast("string"))
    zipped = F.arrays_zip(F.col(f"{side}.role").alias("role"), F.col(f"{side}.content").alias("content"), calls.alias("calls"))
    base = df.select(F.lit(stage).alias("stage"), F.col("row_id").cast("long").alias("row_id"), F.lit(side).alias("side"), F.col(source).alias("source"), zipped.alias("ts"))

    def before(i: Column) -> Column:
        users = F.filter(F.slice(F.col("ts"), F.lit(1), i), lambda m: F.lower(F.trim(m["role"])) == "user")
        return F.get(users, F.size(users) - 1)

    full = base.withColumn("ts", F.transform("ts", lambda m, i: F.struct(m["role"].alias("role"), m["content"].alias("content"), m["calls"].alias("calls"), before(i).alias("user"))))
    out = full.select("stage", "row_id", "side", "source", F.posexplode("ts").alias("turn", "m"))
    return out.select("stage", "row_id", "side", "turn", "source", F.lower(F.trim("m.role")).alias("role"), "m.content", "m.calls", F.col("m.user.content").alias("user"), F.col("m.user.role").isNotNull().alias("asked"))


def all_turns(sft: DataFrame, dpo: DataFrame) -> DataFrame:
    return turns(sft, "sft", "messages", "source_dataset").unionByName(turns(dpo, "dpo", "chosen", "dataset_source")).unionByName(turns(dpo, "dpo", "rejected", "dataset_source"))


def _ends(batches: Iterator[pa.RecordBatch], model: Broadcast, keep: int) -> Iterator[pa.RecordBatch]:
    """Of each batch the turns that no end mark or closed block ends, with what is open and the terminality.

    A turn that ends with a closing bracket, a result or a link has none: only an alignment can show it cut.
    """
    m: Terminality = model.value
    for batch in batches:
        rows, chars, opened, score = [], [], [], []
        for i, text in enumerate(batch.column(keep).to_pylist()):
            if not text or not any(c.isalnum() for c in text[-400:]):
                continue
            what = open_structure(text)
            whole = what is None and closed_form(text)
            if whole and _CLOSED.search(text.rstrip()):
                continue
            rows.append(i)
            chars.append(len(text))
            opened.append(what)
            score.append(None if whole else m.score(tail(text)))
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(i).take(pa.array(rows, pa.int64())) for i in range(keep + 1)), pa.array(chars, pa.int32()), pa.array(opened, pa.string()), pa.array(score, pa.float64())],
            names=[*batch.schema.names, "chars", "open", "score"],
        )


def _band_batches(batches: Iterator[pa.RecordBatch], seeks: bool, sought: Broadcast | None) -> Iterator[pa.RecordBatch]:
    """(band, key, chars, same): band keys of texts; seeks: of the longest head and the whole; sought: only those in the set."""
    sketch = Sketcher()
    bits = sought.value if sought is not None else None
    for batch in batches:
        best: dict[int, int] = {k: i for i, k in enumerate(batch.column(0).to_pylist())}
        pick = np.array(list(best.values()), np.int64)
        texts = batch.column(1).take(pa.array(pick)).to_pylist()
        which, span, same, keys = sketch.head_bands(texts, seeks)
        flat, row = keys.ravel(), np.repeat(np.arange(len(which)), BANDS)
        if bits is not None and len(flat):
            at = flat.view(np.uint64) % np.uint64(SOUGHT_BITS)
            hit = np.flatnonzero((bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1))
            flat, row = flat[hit], row[hit]
        sizes = np.array([len(t) for t in texts], np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(flat), batch.column(0).take(pa.array(pick[which[row]] if len(row) else np.zeros(0, np.int64))), pa.array(sizes[which[row]] if len(row) else np.zeros(0, np.int32)), pa.array(same[row])],
            names=["band", "key", "chars", "same"],
        )


def sought_bands(bands: DataFrame) -> Broadcast:
    """The bit set of the band keys of a column band: SOUGHT_BITS / 64 words at most, whatever the number of keys."""
    at = F.pmod("band", F.lit(SOUGHT_BITS))  # SOUGHT_BITS divides 2**64, so signed and unsigned keys agree
    words_of = bands.select(F.shiftright(at, 6).alias("word"), F.expr("shiftleft(1L, CAST(pmod(band, 64) AS INT))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(SOUGHT_BITS // 64, np.uint64)
    out[words_of.column("word").to_numpy().astype(np.int64)] = words_of.column("bits").to_numpy().astype(np.int64).view(np.uint64)
    return bands.sparkSession.sparkContext.broadcast(out)


def _costs(t: list[str], w: np.ndarray) -> np.ndarray:
    """Least edit cost of t against a stretch of w that ends at each word of w."""
    cost = np.zeros(len(w) + 1)
    for i, x in enumerate(t):
        same = np.array([1.0 if y != x and not y.startswith(x) else 0.0 for y in w]) if i == len(t) - 1 else (w != x).astype(float)
        step = np.minimum(cost[:-1] + same, cost[1:] + 1)
        cost = np.r_[cost[0] + 1, step]
        run = np.minimum.accumulate(cost - np.arange(len(cost)))  # gaps in a
        cost = np.minimum(cost, run + np.arange(len(cost)))
    return cost[1:]


def align_end(a: list[str], b: list[str], reach: int = 40) -> int:
    """Place in b at which the last word of a comes to stand, by semi-global alignment of the last words of a with all of b.

    -1 if more than a quarter of them differ. Where they stand in b more than once, more words of a are taken until one
    place fits best; if that leaves a choice, or would compare over ``COMPARED`` pairs of words, the place nearest to the
    length of a is taken.
    """
    if not a or not b:
        return -1
    w = np.array(b, object)
    cost = _costs(a[-reach:], w)
    if cost.min() > 0.25 * len(a[-reach:]):
        return -1
    at = np.flatnonzero(cost == cost.min())
    while True:
        heads = at[np.r_[True, np.diff(at) > 1]]  # neighbouring places are one
        if len(heads) == 1 or reach >= len(a) or 2 * reach * len(b) > COMPARED:
            return int(heads[np.abs(heads - (len(a) - 1)).argmin()])
        reach *= 2
        cost = _costs(a[-reach:], w)
        at = at[cost[at] == cost[at].min()]


class _Prepared:
    """Words, their ends and shingles of texts, kept for the pairs that come next."""

    KEPT = 2000

    def __init__(self) -> None:
        self.sketch = Sketcher()
        self.texts: dict[int, tuple[list[str], list[int], np.ndarray]] = {}

    def __call__(self, key: int, text: str) -> tuple[list[str], list[int], np.ndarray]:
        got = self.texts.get(key)
        if got is None:
            if len(self.texts) >= self.KEPT:
                self.texts.clear()
            low = text.lower()
            w = words(text)
            got = self.texts[key] = (w, [m.end() for m in WORD.finditer(low)] if len(low) == len(text) else [], self.sketch.shingles(text))
        return got


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, cut) for near copies: 2 if the alignment ends inside a word, 1 inside a sentence, 0 at an end of the longer text."""
    short, long = _Prepared(), _Prepared()
    for batch in batches:
        keys, cuts = [], []
        for key, other, a, b in zip(*(batch.column(n).to_pylist() for n in ("key", "long_key", "text", "long_text"))):
            wa, _, sa = short(key, a)
            wb, ends, sb = long(other, b)
            if not wa or len(ends) != len(wb) or containment(sa, sb) < SIMILAR:
                continue
            at = align_end(wa, wb)
            if at < 0 or at >= len(wb) or at >= len(wb) - 1 and wb[-1] == wa[-1]:
                continue
            rest = b[ends[at] : ends[at] + 12]
            inside_word = wb[at] != wa[-1] and wb[at].startswith(wa[-1])
            sentence_end = bool(re.match(r"[\"'”’»)\]]*(?:[.!?…。！？；]|\s*\n|\s*\Z)", rest))
            keys.append(key)
            cuts.append(2 if inside_word else 0 if sentence_end else 1)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(cuts, pa.int32())], names=["key", "cut"])


def open_ended(ts: DataFrame, model: Broadcast) -> DataFrame:
    """Turns whose form leaves doubt: stage, row_id, side, turn, source, content, chars, open, score."""
    pick = ts.where(F.col("content").isNotNull() & ~F.coalesce((F.col("role").isin("assistant", "model")) & (fold(F.col("content")) == fold(F.col("user"))), F.lit(False)))
    cols = ["stage", "row_id", "side", "turn", "source", "content"]
    ddl = "stage string, row_id long, side string, turn int, source string, content string, chars int, open string, score double"
    return pick.select(*cols).mapInArrow(lambda it: _ends(it, model, 5), ddl)


def copy_verdicts(doubtful: DataFrame, ts: DataFrame) -> DataFrame:
    """(key, cut): verdict of `_align` with longer near copies, for contents (key is their digest) that have one."""
    key = F.xxhash64("content").alias("key")
    shape = "band long, key long, chars int, same long"
    contents = doubtful.groupBy(key).agg(F.first("content").alias("text"))
    mine = contents.select("key", "text").mapInArrow(lambda it: _band_batches(it, True, None), shape).select("band", "key", "chars")
    sought = sought_bands(mine)
    every = ts.where("length(content) > 0").select(key, "content").mapInArrow(lambda it: _band_batches(it, False, sought), shape)
    # the doubtful texts of a band are dealt over blocks by hash, and each text of the band meets every block
    blocks = mine.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"), F.min("chars").alias("shortest"))
    held = mine.join(blocks.where("blocks > 1").select("band", "blocks"), "band", "left").withColumn("block", F.pmod(F.xxhash64("key"), F.coalesce("blocks", F.lit(1))).cast("int")).drop("blocks")
    # texts that go on alike for three times the head end the alignment alike: one of them stands for all
    alike = every.groupBy("band", "same").agg(F.max("chars").alias("long_chars"), F.max("key").alias("long_key"))
    others = alike.join(blocks, "band").where("long_chars > shortest").select("band", "long_key", "long_chars", "blocks")
    others = others.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    pairs = held.join(others, ["band", "block"]).where((F.col("long_chars") > F.col("chars")) & (F.col("key") != F.col("long_key"))).select("key", "long_key").distinct()
    wanted = pairs.select(F.col("long_key")).distinct()
    long_text = ts.where("length(content) > 0").select(F.xxhash64("content").alias("long_key"), F.col("content").alias("long_text")).join(wanted, "long_key", "left_semi").groupBy("long_key").agg(F.first("long_text").alias("long_text"))
    full = pairs.join(contents, "key").join(long_text, "long_key").select("key", "long_key", "text", "long_text")
    return full.mapInArrow(_align, "key long, cut int").groupBy("key").agg(F.max("cut").alias("cut"))


def field_limits(doubtful: DataFrame) -> DataFrame:
    """(stage, source, chars): lengths at which open-ended turns of a source pile up (3 or more, ten times the neighbours)."""
    n = doubtful.where(F.col("score") < 0.5).groupBy("stage", "source", "chars").agg(F.count(F.lit(1)).alias("n"))
    near = Window.partitionBy("stage", "source").orderBy("chars").rangeBetween(-30, 30)
    return n.withColumn("around", F.sum("n").over(near) - F.col("n")).where("n >= 3 and n * 6 > around and chars >= 64").select("stage", "source", "chars")


#: below this terminality a turn without a copy is cut; at a field limit, below the second
CUT, CUT_AT_LIMIT = 0.12, 0.5
#: from this terminality on a turn that ends with a whole word is no cut copy: the longer text goes on where it may end
WHOLE = 0.9


def truncated_turns(sft: DataFrame, dpo: DataFrame) -> DataFrame:
    """(stage, row_id, side, turn, source, evidence, score): every cut turn."""
    ts = all_turns(sft, dpo)
    model = terminality_model([(sft, "messages"), (dpo, "chosen")])
    ensure_checkpoint_dir(sft.sparkSession)
    doubtful = open_ended(ts, model).checkpoint()  # a small part of the turns, used three times
    verdicts = copy_verdicts(doubtful, ts)
    limits = field_limits(doubtful).withColumn("at_limit", F.lit(True))
    d = doubtful.withColumn("key", F.xxhash64("content")).drop("content")
    d = d.join(verdicts, "key", "left")
    same = [d["stage"] == limits["stage"], d["source"].eqNullSafe(limits["source"]), d["chars"] == limits["chars"]]
    d = d.join(limits, same, "left").select(d["stage"], "row_id", "side", "turn", d["source"], "open", "score", "cut", "at_limit")
    unsettled = F.coalesce(F.col("cut") > 0, F.lit(True))
    evidence = (
        F.when(F.col("open").isNotNull(), F.concat(F.lit("open "), F.col("open")))
        .when((F.col("cut") == 2) | (F.col("cut") == 1) & (F.coalesce("score", F.lit(0.0)) < WHOLE), "alignment")
        .when(unsettled & F.col("at_limit") & (F.col("score") < CUT_AT_LIMIT), "limit")
        .when(unsettled & (F.col("score") < CUT), "closing words")
    )
    return d.withColumn("evidence", evidence).where("evidence is not null").select("stage", "row_id", "side", "turn", "source", "evidence", "score")


def truncation_rates(sft: DataFrame, dpo: DataFrame) -> DataFrame:
    """For each stage and source its turns, cut turns and their share."""
    every = all_turns(sft, dpo).groupBy("stage", "source").agg(F.count(F.lit(1)).alias("turns"))
    cut = truncated_turns(sft, dpo).groupBy("stage", "source").agg(F.count(F.lit(1)).alias("cut"))
    same = [every["stage"] == cut["stage"], every["source"].eqNullSafe(cut["source"])]
    n = F.coalesce(cut["cut"], F.lit(0)).cast("long")
    return every.join(cut, same, "left").select(every["stage"], every["source"], every["turns"], n.alias("cut_turns"), (n / every["turns"]).alias("cut_share"))
