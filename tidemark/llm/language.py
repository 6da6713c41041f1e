"""Language of texts and of their stretches (problem 2): a linear-chain CRF over words.

Words are labelled by affix, character n-gram, script and lexicon features and by learned transitions, one set inside a
sentence and one across a sentence end, so that a stray foreign word does not turn its sentence while a sentence in
another language does. Posterior probabilities come from forward-backward; a stretch's confidence is their mean.

Training: the rows of ``lang_samples`` (bounded by ``MAX_SAMPLES``) and texts joined from sentences of different samples,
on the driver, once for a session. Labelling: one pass, no shuffle, any text length; features are taken once for each
distinct word of a task.

Defined results: null, empty or wordless texts (code, numbers, addresses) have no language: no segment, an empty list of
languages, text language null with confidence 0. Ties go to the label that sorts first.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.crf import ChainCRF

#: labelled rows used at most for training (the table is fixed in size; the least sample_ids are taken)
MAX_SAMPLES = 5000

_FENCE = re.compile(r"```.*?(?:```|\Z)", re.S)
_INLINE = re.compile(r"`[^`\n]*`|https?://\S+|\bwww\.\S+|\S+@\S+|<[^<>\n]{1,40}>|\[[A-Z]+_?\d*\]")
_ROLE = re.compile(r"\A\s*(?:user|human|assistant|system)\s*:\s*", re.I)
_CODE_LINE = re.compile(
    r"^(?: {4,}|\t)|^\s*(?:SELECT|FROM|WHERE|GROUP BY|ORDER BY|JOIN|INSERT|UPDATE|CREATE|DELETE)\b|^\s*(?:def|class|import|from|return|assert|print|while|for|if|elif|else)\b.*(?:[:)\]]|return \w+|==.*)\s*$"
    r"|^\s*\w+\s*(?:=|\+=|-=)\s|\w\(.*\)\s*(?:==|\{|;)|^\s*[\[{].*[\]}]\s*$|^\s*\|.*\|\s*$|^\s*return \w+\s*$"
)
_PIECE = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[.!?…]+(?=[\"'”’»)\]*_]*(?:\s|$))|[。？！；]|\n")
_HAN = re.compile(r"[㐀-鿿豈-﫿]")
_ENDS = frozenset(".!?…。？！；\n")


def clean(text: str) -> str:
    """The text with code, addresses on the net and markers blanked out; places of characters do not change."""
    if "`" in text:
        text = _FENCE.sub(lambda m: "\n" * len(m[0]), text)
    if any(c in text for c in "=({|") or "    " in text or "FROM" in text or "GROUP" in text:
        text = "\n".join(" " * len(x) if _CODE_LINE.search(x) else x for x in text.split("\n"))
    text = _INLINE.sub(lambda m: " " * len(m[0]), text)
    if ":" in text[:40]:
        text = _ROLE.sub(lambda m: " " * len(m[0]), text)
    return text


def pieces(text: str) -> tuple[list[str], list[tuple[int, int]], np.ndarray, np.ndarray]:
    """Words in lower case, their places, the sentence number of each and 1 where a word opens a sentence."""
    words, spans, sentence = [], [], []
    number = 0
    for m in _PIECE.finditer(clean(text)):
        w = m[0]
        if w[0] in _ENDS:
            number += 1
        else:
            words.append(w.lower())
            spans.append(m.span())
            sentence.append(number)
    s = np.array(sentence, np.int64)
    opens = np.zeros(len(s), np.int8)
    opens[1:] = s[1:] != s[:-1]
    return words, spans, s, opens


#: Frequent words of each language, a lexicon feature of the model (words of several languages stand in each).
LEXICON = {
    "en": "the of and to in is that it was for on are as with be at this have from or by but what all when there can an your how do will about more could thanks say why would",
    "de": "der die das und ist in den von zu mit sich auf für nicht ein eine als auch es an werden aus dass wie einem über war oder aber ich du kannst bitte danke warum was genauer",
    "fr": "le la les de des du et est un une dans que qui en pour pas par sur plus ne se ce il au avec cette nous vous je tu mais où comme peux pourquoi comment merci",
    "es": "el la los las de que y en un una ser se no por con su para como lo todo pero más o este si me ya qué sobre mi también así puedes gracias cómo algo del",
    "pt": "o a os as de que e do da em um uma para é com não por mais dos como mas ao ele das à seu sua ou já você também só pelo isso pode falar sobre obrigado qual",
}
_LEX: dict[str, list[str]] = {}
for _lang, _words in LEXICON.items():
    for _w in _words.split():
        _LEX.setdefault(_w, []).append(_lang)


def word_features(word: str) -> list[str]:
    if not word:
        return ["empty"]
    if _HAN.search(word):
        return ["script=han", f"h={word[:1]}"]
    out = ["bias", f"w={word}"]
    out += [f"p{n}={word[:n]}" for n in (1, 2, 3, 4) if n < len(word)]
    out += [f"s{n}={word[-n:]}" for n in (1, 2, 3, 4) if n < len(word)]
    marked = f"^{word}$"
    out += [f"g={marked[i : i + 2]}" for i in range(len(marked) - 1)]
    out += [f"g={marked[i : i + 3]}" for i in range(len(marked) - 2)]
    lex = _LEX.get(word)
    if lex:
        out += [f"lex={x}" for x in lex] if len(lex) > 1 else [f"lex={lex[0]}", f"only={lex[0]}"]
    if not word.isascii():
        out += [f"c={c}" for c in word if c > "\x7f"]
    return out


def _training(samples: list[tuple[str, str]], labels: list[str], seed: int = 7) -> tuple[list[list[str]], list[np.ndarray], list[np.ndarray]]:
    rng = random.Random(seed)
    index = {x: i for i, x in enumerate(labels)}
    sentences: dict[str, list[list[str]]] = {x: [] for x in labels}
    for lang, text in samples:
        words, _, s, _ = pieces(text)
        for k in dict.fromkeys(s.tolist()):
            sentences[lang].append([w for w, n in zip(words, s) if n == k])
    bags = {k: v for k, v in sentences.items() if v}
    seqs, gold, kinds = [], [], []

    def add(parts: list[tuple[str, list[str]]]) -> None:
        seqs.append([w for _, p in parts for w in p])
        gold.append(np.concatenate([np.full(len(p), index[x]) for x, p in parts]))
        kinds.append(np.concatenate([np.r_[1, np.zeros(len(p) - 1)] for _, p in parts]).astype(np.int8))

    for lang, group in bags.items():
        for p in group:
            add([(lang, p)])
    langs = list(bags)
    for _ in range(600):  # texts of one language, and of several in turn
        main, other = rng.choice(langs), rng.choice(langs)
        share = rng.choice((0.0, 0.0, 0.0, 0.2, 0.5))
        parts = []
        for _ in range(rng.randint(2, 6)):
            lang = other if rng.random() < share else main
            p = list(rng.choice(bags[lang]))
            if rng.random() < 0.1 and len(p) > 6:  # a quoted term of another language inside a sentence
                q, alien = rng.choice(bags[rng.choice(langs)]), rng.randint(1, len(p) - 2)
                p[alien : alien + 1] = q[: rng.randint(1, 2)]
            parts.append((lang, p))
        add(parts)
    return seqs, gold, kinds


def train(samples: list[tuple[str, str]]) -> ChainCRF:
    """A CRF from (language, text) rows."""
    labels = sorted({x for x, _ in samples})
    model = ChainCRF(labels, word_features, bits=16, kinds=2)
    if labels:
        model.fit(*_training(samples, labels), epochs=40)
    return model


_trained: dict[tuple, Broadcast] = {}


def language_model(samples: DataFrame) -> Broadcast:
    """The model of a table (lang, text, sample_id), trained once a session and sent to the executors."""
    spark = samples.sparkSession
    rows = samples.where("lang is not null and length(trim(text)) > 0").orderBy("sample_id").limit(MAX_SAMPLES).select("lang", "text").collect()
    data = tuple((r.lang, r.text) for r in rows)
    key = (spark.sparkContext.applicationId, hash(data))
    if key not in _trained:
        _trained[key] = spark.sparkContext.broadcast(train(list(data)))
    return _trained[key]


def label(texts: list[str], model: ChainCRF) -> list[dict]:
    """For each text its words' places, sentence numbers, label numbers and posteriors."""
    cut = [pieces(t) for t in texts]
    marg = model.marginals([c[0] for c in cut], [c[3] for c in cut])
    return [{"words": c[0], "spans": c[1], "sentence": c[2], "p": p, "y": p.argmax(1) if len(p) else np.zeros(0, np.int64)} for c, p in zip(cut, marg)]


#: a stretch counts as a sentence from this many words, or Chinese characters
SENTENCE_WORDS = 4
SENTENCE_HAN = 4


def _sizes(words: list[str], starts: np.ndarray) -> np.ndarray:
    """Size of each stretch that begins at ``starts``, 1 being the least of a sentence."""
    han = np.add.reduceat(np.array([len(w) if "㐀" <= w[0] <= "鿿" else 0 for w in words]), starts)
    plain = np.add.reduceat(np.array([len(w) > 1 or w in "aàeéoóyàuûñ" for w in words], np.int64), starts)
    return np.where(han > 0, han / SENTENCE_HAN, plain / SENTENCE_WORDS)


def sentence_languages(found: dict, labels: list[str], sure: float = 0.8) -> dict[str, float]:
    """Languages in which at least one whole sentence is written, with the confidence of the surest sentence.

    A sentence is a stretch up to an end mark or line end with enough words; its language is that of most of its words
    by posterior. A long unbroken run in a second language inside a sentence counts too (a quoted or joined sentence).
    """
    out: dict[str, float] = {}
    s, p, y, words = found["sentence"], found["p"], found["y"], found["words"]
    if not len(s):
        return out
    starts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    stops = np.r_[starts[1:], len(s)]
    means = np.add.reduceat(p, starts, axis=0) / (stops - starts)[:, None]
    best = means.argmax(1)
    for i in np.flatnonzero(_sizes(words, starts) >= 1).tolist():
        a, b, k = int(starts[i]), int(stops[i]), int(best[i])
        if means[i, k] < sure:  # in doubt the rest of the text decides
            k = int((means[i] + p.mean(0)).argmax())
            if means[i, k] < 0.4:
                continue
        out[labels[k]] = max(out.get(labels[k], 0.0), float(means[i, k]))
        inside = y[a:b]
        if (inside != k).any():
            runs = np.flatnonzero(np.r_[True, inside[1:] != inside[:-1]])
            ends = np.r_[runs[1:], len(inside)]
            for c, d in zip(runs[(inside[runs] != k)], ends[(inside[runs] != k)]):
                if _sizes(words[a + c : a + d], np.zeros(1, np.int64))[0] >= 1.5 and (q := float(p[a + c : a + d, inside[c]].mean())) >= 0.9:
                    out[labels[inside[c]]] = max(out.get(labels[inside[c]], 0.0), q)
    return out


def segments(found: dict, text: str, labels: list[str]) -> list[tuple[int, int, str, float, int]]:
    """Stretches of one language: (start, stop, language, confidence, words)."""
    y, p, spans = found["y"], found["p"], found["spans"]
    if not len(y):
        return []
    edges = np.r_[np.flatnonzero(np.r_[True, y[1:] != y[:-1]]), len(y)]
    return [(spans[a][0], spans[b - 1][1], labels[y[a]], float(p[a:b, y[a]].mean()), int(b - a)) for a, b in zip(edges[:-1], edges[1:])]


_SEGMENT = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64()), ("words", pa.int32())])
_LANG = pa.struct([("lang", pa.string()), ("confidence", pa.float64())])

LABELLED = "lang string, confidence double, sentence_langs array<struct<lang:string,confidence:double>>, segments array<struct<start:int,stop:int,lang:string,confidence:double,words:int>>"


def _label_batches(batches: Iterator[pa.RecordBatch], model: Broadcast, keep: int) -> Iterator[pa.RecordBatch]:
    crf: ChainCRF = model.value
    labels = crf.labels
    for batch in batches:
        texts = [t or "" for t in batch.column(keep).to_pylist()]
        lang, conf, sent, segs = [], [], [], []
        for t, f in zip(texts, label(texts, crf)):
            mean = f["p"].mean(0) if len(f["p"]) else None
            k = int(mean.argmax()) if mean is not None else -1
            lang.append(labels[k] if k >= 0 else None)
            conf.append(float(mean[k]) if k >= 0 else 0.0)
            sent.append([{"lang": a, "confidence": b} for a, b in sorted(sentence_languages(f, labels).items())])
            segs.append([dict(zip(("start", "stop", "lang", "confidence", "words"), x)) for x in segments(f, t, labels)])
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(i) for i in range(keep)), pa.array(lang, pa.string()), pa.array(conf, pa.float64()), pa.array(sent, pa.list_(_LANG)), pa.array(segs, pa.list_(_SEGMENT))],
            names=[*batch.schema.names[:keep], "lang", "confidence", "sentence_langs", "segments"],
        )


def label_languages(df: DataFrame, keys: list[str], text: str, samples: DataFrame) -> DataFrame:
    """The key columns with each text's language, confidence, languages of whole sentences and segments."""
    model = language_model(samples)
    keep = df.select(*keys, text)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep.schema.fields[:-1])
    n = len(keys)
    return keep.mapInArrow(lambda it: _label_batches(it, model, n), f"{ddl}, {LABELLED}")


#: Spellings of declared languages.
SPELLINGS = {
    "en": ["en", "eng", "english", "englisch", "anglais", "inglés", "ingles", "inglês", "英语", "英文"],
    "de": ["de", "deu", "ger", "german", "deutsch", "allemand", "alemán", "aleman", "alemão", "alemao", "德语", "德文"],
    "fr": ["fr", "fra", "fre", "french", "französisch", "français", "francais", "francés", "frances", "francês", "法语", "法文"],
    "es": ["es", "spa", "spanish", "castilian", "spanisch", "espagnol", "español", "espanol", "espanhol", "西班牙语", "西班牙文"],
    "pt": ["pt", "por", "portuguese", "portugiesisch", "portugais", "portugués", "portugues", "português", "葡萄牙语", "葡萄牙文"],
    "zh": ["zh", "zho", "chi", "cmn", "chinese", "mandarin", "chinesisch", "chinois", "chino", "chinês", "chines", "中文", "汉语", "普通话"],
}
MISSING = ["", "und", "unknown", "none", "null", "n/a"]


def declared(col: Column) -> Column:
    """Two-letter code of a declared language in any spelling; null if missing, the folded spelling if not known."""
    folded = F.lower(F.regexp_replace(col, r"^\s+|\s+$", ""))
    base = F.regexp_extract(folded, r"^([^-_]*)", 1)
    out = F.when(col.isNull() | folded.isin(MISSING) | base.isin(MISSING), F.lit(None).cast("string"))
    for code, names in SPELLINGS.items():
        out = out.when(folded.isin(names) | base.isin(names), F.lit(code))
    return out.otherwise(folded)


def user_texts(sft: DataFrame, dpo: DataFrame, rl: DataFrame) -> DataFrame:
    """(stage, row_id, text, language): all user turns of an sft row together, prompts of the others; null prompts are out."""
    zipped = F.arrays_zip(F.col("messages.role").alias("role"), F.col("messages.content").alias("content"))
    user = F.filter(zipped, lambda m: (F.lower(F.trim(m["role"])) == "user") & m["content"].isNotNull())
    a = sft.select(F.lit("sft").alias("stage"), "row_id", F.array_join(F.transform(user, lambda m: m["content"]), "\n\n").alias("text"), "language")
    b = dpo.where("prompt is not null").select(F.lit("dpo").alias("stage"), "row_id", F.col("prompt").alias("text"), "language")
    c = rl.where("prompt is not null").select(F.lit("rlvr").alias("stage"), "row_id", F.col("prompt").alias("text"), "language")
    return a.unionByName(b).unionByName(c)


def label_cases(sft: DataFrame, dpo: DataFrame, rl: DataFrame, samples: DataFrame) -> DataFrame:
    """(stage, row_id, lang) of rows whose declared language is missing or wrong or whose text is in several languages."""
    texts = user_texts(sft, dpo, rl).withColumn("said", declared(F.col("language"))).drop("language")
    found = label_languages(texts, ["stage", "row_id", "said"], "text", samples).select("stage", "row_id", "said", F.col("sentence_langs.lang").alias("langs"))
    case = F.col("said").isNull() | ~F.array_contains("langs", F.col("said")) | (F.size("langs") > 1)
    return found.where(case).select("stage", "row_id", F.explode("langs").alias("lang")).distinct()
