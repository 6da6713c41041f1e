"""Personal information inside free text (problem 4): a skip-chain conditional random field.

Tokens are words, chains of digits and separators, and e-mail-like strings. A chain CRF scores each token from its own
and its neighbours' features; tokens that recur in a record (a name, a number, a part of a double name) are tied by skip
edges whose potentials are learned from how often such pairs carry the same label, and loopy message passing makes the
labels of a record agree. Spans of a label become typed placeholders; all other characters stay.

Every token of every turn is scored; a turn is a chain, and ties reach over all turns of its record. What the model has
labelled must have the forms that a value cannot do without (`PiiModel._plausible`): an at sign; seven digits, or six with
letters; a street word and a number; two capitalised words, one of them unknown, two unknown words in lower case, or a
Chinese family name with one or two characters. Not found are, by this, single names and streets without a number; names
in lower case that nothing introduces and Chinese names in running text are scored, but the model rarely labels them.
Training is on texts composed by a grammar (`pii_training`), once a session on the driver; from which posterior on a token
is taken is set on texts with cue words that training has not seen. Labelling is one pass without a shuffle.

Defined results: null and empty turns stay as they are and hold nothing; masks already present stay; repeated records
are labelled alike, row by row; texts may be of any length.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.crf import ChainCRF, skip_chain_marginals
from tidemark.llm.pii_training import KINDS, SURNAMES, documents

#: training documents made, and labelled-language samples used as background at most
TRAINING = 4500
#: documents made to set the thresholds
TUNING = 800
MAX_SAMPLES = 2000

_MASK = r"[\[<][A-Z]{2,}(?:_[A-Z]+)*_?\d*[\]>]"
_MAIL = r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+|[\w.+-]+ ?[\[(]at[\])] ?[\w-]+(?:(?: ?[\[(]dot[\])] ?|\.)[\w-]+)+|[\w.+-]*@[\w:./-]*"
_NUMBER = r"\+?\(?\d[\d()./:-]*(?:[  ][\d(][\d()./:-]*)*\d(?:[A-Za-z]\b)?(?: ?(?:ext\.?|x) ?\d+)?"
_OTHERS = rf"{_NUMBER}|\d+[A-Za-z]?\b|[A-Z]{{1,2}}\d{{6,}}[A-Z]?|[^\W\d_]+(?:['’-][^\W\d_]+)*|_+|\n|\S"
_TOKEN = re.compile(rf"{_MASK}|https?://\S+|{_MAIL}|{_OTHERS}", re.I)
#: the same where no at sign follows the word, with both cases written out, which is tried faster
_ANY = "A-Za-zİıſK"
_PLAIN = re.compile(
    rf"[\[<][{_ANY}]{{2,}}(?:_[{_ANY}]+)*_?\d*[\]>]|[hH][tT][tT][pP][sSſ]?://\S+"
    rf"|\+?\(?\d[\d()./:-]*(?:[  ][\d(][\d()./:-]*)*\d(?:[{_ANY}]\b)?(?: ?(?:[eE][xX][tT]\.?|[xX]) ?\d+)?"
    rf"|\d+[{_ANY}]?\b|[{_ANY}]{{1,2}}\d{{6,}}[{_ANY}]?|[^\W\d_]+(?:['’-][^\W\d_]+)*|_+|\n|\S"
)
_WORDS_HAN = re.compile(r"[㐀-鿿]")

#: Words that name a street in six languages.
STREET_WORDS = (
    "Street|St|Lane|Road|Rd|Avenue|Ave|Row|Terrace|Crescent|Close|Drive|Court|Place|Way|Boulevard|Blvd|Square|Alley|Hill|Gardens|Grove|Mews|Walk|Rue|Chemin|Impasse|Allée|Quai|"
    "Calle|Avenida|Plaza|Paseo|Camino|Rua|Travessa|Praça|Largo|Alameda|Estrada|rue|avenue|boulevard|chemin|impasse|allée|quai|calle|avenida|plaza|paseo|rua|travessa|praça|alameda"
)
_STREET_ENDS = r"(?:stra(?:ß|ss)e|gasse|weg|allee|platz|ring|damm|ufer|steig|pfad|chaussee)"
_STREET = re.compile(rf"\b(?:{STREET_WORDS})\b|\b[A-ZÄÖÜ]\w+{_STREET_ENDS}\b|[㐀-鿿]{{1,6}}(?:路|街|大道|巷|弄)\d+ ?号")
_STREET_HAN = re.compile(r"[路街道巷弄号]")
_LINK = r"(?:[ \xa0]+(?:de l['’]|d['’]|l['’])?[^\W\d_]+(?:['’-][^\W\d_]+)*)"
#: the form of an address: a number before or behind a street word and the words that belong to it
_ADDRESS = re.compile(
    rf"\b\d{{1,4}}[A-Za-z]?(?: bis| ter)?,?(?:[ \xa0]+[A-ZÄÖÜÉ][\w'’-]+){{0,3}}[ \xa0]+(?:{STREET_WORDS})\b(?:[ \xa0]+(?:de|du|des|de la|del|la|las|los)(?: la)?\b{_LINK}{{1,2}})?"
    rf"|\b(?:{STREET_WORDS})\b{_LINK}{{1,4}},? \d{{1,4}}\b|\b[A-ZÄÖÜ]\w+{_STREET_ENDS} \d{{1,4}}[a-z]?\b|[㐀-鿿]{{1,6}}(?:路|街|大道|巷|弄)\d+ ?号"
)
_PROPER = r"[^\W\d_a-zß-öø-ÿ][^\W\d_]+(?:['’-][^\W\d_]+)*"
_UPPER_PAIR = re.compile(rf"\b({_PROPER}),?[  ]+(?:([^\W\d_a-zß-öø-ÿ])\.[  ]+|(?:de|da|do|dos|das|del|di|von|van|der|le|la|el|al)[  ]+(?:la[  ]+|der[  ]+|los[  ]+)?)?({_PROPER})")
#: Words that introduce a name, in any case.
_INTRODUCED = re.compile(r"\b(?:name is|name's|name:|i am|i'm|named|called|ich heiße|mein name ist|je m'appelle|me llamo|mi nombre es|eu me chamo|meu nome é)[  ]+([^\W\d_]{2,})[  ]+([^\W\d_]{2,})", re.I)
_HAN_NAME = re.compile(rf"(?:姓名|联系人|收件人|寄件人|患者|客户|作者|签名|名叫|我叫|我是|名字)[：:是为]?\s?([{SURNAMES}][㐀-鿿]{{1,2}})|([{SURNAMES}][㐀-鿿]{{1,2}})(?=先生|女士|老师|医生|说|写道)")
_AT = re.compile(r"@|[\[(]at[\])]", re.I)

#: in lower case, what each form of `_INTRODUCED` holds
_INTRODUCING = ("name", "i am", "i'm", "called", "ich heiße", "je m'appelle", "me llamo", "mi nombre es", "eu me chamo", "meu nome é")
#: characters labelled at once, whole records (a memory bound, not a cap on the data)
AT_ONCE = 1_000_000
#: posteriors (of all kinds together) tried as the least at which a token is personal data of its likeliest kind; in
#: doubt a value is masked, so none is above one half
TRIED = (0.1, 0.2, 0.3, 0.4, 0.5)
#: Forms of dates, host addresses and book numbers, which are no phone or identity number.
_NOT_NUMBER = re.compile(r"[(\s]*(?:\d{4}-\d\d-\d\d|\d{1,2}[./]\d{1,2}[./]\d{4}|\d{1,3}(?: ?\. ?\d{1,3}){3}(?:[:/]\d+)?|97[89][ -]\d[\d -]{6,12}[\dX])(?:[)\s]|\Z)")
#: Form of a path on a host of a copy or version-control command, which is no mail address.
_HOST_PATH = re.compile(r"@[\w.-]+:[^\s\d]*/|@[\d.]+$")


#: what a token of a form cannot be, in the order of KINDS, as a log potential
_NEVER = -30.0
_FORMS = {
    "mail": np.array([0, 0, _NEVER, _NEVER, _NEVER, _NEVER]),
    "long number": np.array([0, _NEVER, 0, 0, _NEVER, _NEVER]),
    "short number": np.array([0, _NEVER, 0, 0, 0, _NEVER]),
    "word": np.array([0, _NEVER, _NEVER, _NEVER, 0, 0]),
    "mark": np.zeros(6),
}
#: potentials of the place between two turns, which is nobody's
_BETWEEN = np.array([[0] + [_NEVER] * (len(KINDS) - 1)], np.float32)


def forms(words: list[str]) -> np.ndarray:
    """Log potentials that rule out kinds a token's form cannot have."""
    out = np.zeros((len(words), len(KINDS)))
    for i, w in enumerate(words):
        digits = sum(c.isdigit() for c in w)
        form = "mail" if _AT.search(w) else "long number" if digits >= 7 else "short number" if digits else "word" if w[:1].isalpha() and len(w) > 1 else "mark"
        out[i] = _FORMS[form]
    return out


def _matches(text: str) -> Iterator[re.Match]:
    """The matches of `_TOKEN` in order; `_MAIL` is tried only at words that an at sign follows, so time is linear."""
    at = 0
    if "@" in text or "]" in text or ")" in text:
        for sign in _AT.finditer(text):
            if sign.start() < at:
                continue
            start = sign.start()
            if text[start] != "@" and start > at and text[start - 1] == " ":
                start -= 1
            while start > at and (text[start - 1].isalnum() or text[start - 1] in "_.+-"):
                start -= 1
            for m in _PLAIN.finditer(text, at):
                if m.start() >= start:
                    break
                yield m
                at = m.end()
            if at <= sign.start():
                m = _TOKEN.search(text, max(at, start))
                yield m
                at = m.end()
    yield from _PLAIN.finditer(text, at)


def tokens(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    out, spans = [], []
    for m in _matches(text):
        w = m[0]
        if len(w) > 1 and _WORDS_HAN.search(w):  # Chinese by the character
            for i, c in enumerate(w):
                out.append(c)
                spans.append((m.start() + i, m.start() + i + 1))
        else:
            out.append(w)
            spans.append(m.span())
    return out, spans


def spans_of(text: str, words: list[str]) -> list[tuple[int, int]]:
    """Where the words of a text stand; between them is nothing but blanks."""
    out, at = [], 0
    for w in words:
        a = text.find(w, at)
        at = a + len(w)
        out.append((a, at))
    return out


def words_of(text: str) -> list[str]:
    """The words of `tokens`, where no spans are wanted."""
    if ("@" in text or "]" in text or ")" in text) and _AT.search(text):
        return tokens(text)[0]
    words = _PLAIN.findall(text)
    if not text.isascii() and _WORDS_HAN.search(text):
        words = [c for w in words for c in (w if len(w) > 1 and _WORDS_HAN.search(w) else (w,))]
    return words


def _shape(word: str) -> str:
    out = re.sub(r"[^\W\d_]", lambda m: "A" if m[0].isupper() else "a", re.sub(r"\d", "0", word))
    return out if any(c == "0" for c in out) else re.sub(r"(.)\1+", r"\1", out)


class Features:
    """Hashed features of a token; ``known`` are words of certain language, none of them a name."""

    def __init__(self, known: set[str]) -> None:
        self.known = known

    def __call__(self, word: str) -> list[str]:
        if not word:
            return ["edge"]
        word, _, marks = word.partition("\x01")  # marks: the forms of several tokens that it is part of
        return [*(f"form={m}" for m in marks), *self.own(word)]

    def own(self, word: str) -> list[str]:
        low = word.lower()
        digits = sum(c.isdigit() for c in word)
        if digits:
            shape = _shape(word)
            groups = "-".join(str(len(g)) for g in re.findall(r"\d+", word))
            seps = "".join(sorted(set(re.sub(r"[\w]", "", word))))
            return ["digits", f"n={digits}", f"shape={shape[:24]}", f"groups={groups[:24]}", f"seps={seps}", f"head={low[:3]}" if digits < 5 else f"head={word[:2]}", f"plus={word[0] == '+'}", f"tail={_shape(word[-2:])}", f"at={'@' in word}", f"url={low.startswith('http')}", f"nn={min(digits, 12) // 3},{seps}"]
        if "@" in word or "[at]" in low or "(at)" in low:
            host = re.split(r"@|[\[(]at[\])]", low)[-1].strip()
            return ["mail", f"host={bool(re.search(r'(?:[.]|dot[])] ?)[a-z]{2,}$', host))}", f"colon={':' in word}", f"user={word[0] != '@'}"]
        if not word[0].isalpha():
            return [f"w={low}", "punct"]
        known = low in self.known or all(p in self.known for p in re.split(r"['’-]", low))
        out = [f"w={low}", f"shape={_shape(word)[:12]}", f"known={known},{word[:1].isupper()}", f"s3={low[-3:]}", f"s2={low[-2:]}", f"len={min(len(word), 9)}"]
        if _STREET.fullmatch(word):
            out.append(f"street={low if len(low) < 10 else low[-4:]}")
            out.append("street")
        return out


class FormCRF(ChainCRF):
    """The chain with the potentials of `forms` added where words are scored."""

    def _scores(self, words: list[str]) -> np.ndarray:
        out = super()._scores(words)
        out[self.offsets.index(0)] += forms([w.partition("\x01")[0] for w in words])
        return out


class _Kept(dict):
    """What a function says of a word, kept for the words of a batch and the next ones (a memory bound, no cap)."""

    def __init__(self, say: Callable[[str], object]) -> None:
        self.say = say

    def __missing__(self, word: str) -> object:
        if len(self) > ChainCRF.KEPT:
            self.clear()
        self[word] = out = self.say(word)
        return out


class PiiModel:
    def __init__(self, samples: list[str], seed: int = 11) -> None:
        known = {w.lower() for s in samples for w in re.findall(r"[^\W\d_]+", s)}
        docs = documents(samples, TRAINING, seed)
        # words of the patterns are known as well; the invented ones are not
        common: dict[str, int] = {}
        for d in docs:
            for t, k in d:
                if k == "O":
                    for w in set(re.findall(r"[^\W\d_]+", t)):
                        common[w.lower()] = common.get(w.lower(), 0) + 1
        known |= {w for w, n in common.items() if n >= 6}
        self.known = known
        self._keep()
        self.features = Features(known)
        self.crf = FormCRF(KINDS, self.features, offsets=(-3, -2, -1, 0, 1, 2, 3), bits=15)
        seqs, seen, gold = [], [], []
        for d in docs:
            text = "".join(t for t, _ in d)
            ends = np.cumsum([len(t) for t, _ in d])
            words, spans = tokens(text)
            if not words:
                continue
            marked_words = self.marked(text, words)
            piece = np.searchsorted(ends, [s for s, _ in spans], side="right")
            seqs.append(words)
            seen.append(marked_words)
            gold.append(np.array([KINDS.index(d[i][1]) for i in piece]))
        self.crf.fit(seen, gold, epochs=35, rate=0.2)
        joint = np.full((len(KINDS), len(KINDS)), 0.5)
        for words, y in zip(seqs, gold):
            for a, b in skip_edges(words, known):
                joint[y[a], y[b]] += 1
                joint[y[b], y[a]] += 1
        joint /= joint.sum()
        side = joint.sum(1)
        self.agree = 0.5 * np.clip(np.log(joint / np.outer(side, side)), -3, 3)
        self.thresholds = np.r_[1.0, np.full(len(KINDS) - 1, 0.3)]
        self._tune(documents(samples, TUNING, seed + 1, unseen=True))

    def _keep(self) -> None:
        known = self.known
        self.streets, self.keys = _Kept(lambda w: bool(_STREET.search(w))), _Kept(lambda w: _keys(w, known))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("streets", "keys")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._keep()

    def _tune(self, docs: list[list[tuple[str, str]]]) -> None:
        """Sets for each kind the threshold of the best F measure on labelled texts."""
        truth = [[(k, *span) for (_, k), span in zip(d, _spans([t for t, _ in d])) if k != "O"] for d in docs]
        records = [["".join(t for t, _ in d)] for d in docs]
        best = np.zeros(len(KINDS))
        chosen = self.thresholds.copy()
        for level in TRIED:
            self.thresholds[1:] = level
            found = self.label(records)
            for k, kind in enumerate(KINDS[1:], 1):
                want = sum(x[0] == kind for spans in truth for x in spans)
                got = sum(x[1] == kind for out in found for x in out)
                hit = sum(any(x[0] == o[1] and o[2] < x[2] and x[1] < o[3] for o in ((y[0], y[1], y[2], y[3]) for y in out)) for spans, out in zip(truth, found) for x in spans if x[0] == kind)
                f = 2 * hit / max(1, want + got)
                if f > best[k] + 1e-3:
                    best[k], chosen[k] = f, level
        self.thresholds = chosen

    def marked(self, text: str, words: list[str]) -> list[str]:
        """The words with marks for the forms they are part of: a of an address, n of two capitalised words, one unknown."""
        known = self.known
        forms_at: list[tuple[int, int, str]] = []
        if "号" in text or any(map(self.streets.__getitem__, words)):
            forms_at += [(*m.span(), "a") for m in _ADDRESS.finditer(text)]
        forms_at += [(*m.span(), "n") for m in _UPPER_PAIR.finditer(text) if m[1].lower() not in known or m[3].lower() not in known]
        low = text.lower()
        if any(x in low for x in _INTRODUCING) or any(x in text for x in "İıſ"):
            forms_at += [(m.start(1), m.end(2), "l") for m in _INTRODUCED.finditer(text) if m[1].lower() not in known and m[2].lower() not in known]
        if not text.isascii() and _WORDS_HAN.search(text):
            forms_at += [(*m.span(1 if m[1] else 2), "h") for m in _HAN_NAME.finditer(text)]
        if not forms_at:
            return words
        out = list(words)
        spans = spans_of(text, words)
        starts = [s for s, _ in spans]
        for a, b, mark in forms_at:
            for i in range(bisect_left(starts, a), len(spans)):
                if spans[i][1] > b:
                    break
                out[i] += ("" if "\x01" in out[i] else "\x01") + mark
        return out

    def _trim(self, kind: str, words: list[str], a: int, b: int) -> tuple[int, int]:
        """The span without line ends and marks at its ends, a name also without known words before it.

        A name is completed by neighbouring unknown capitalised words, a street by its number.
        """
        if kind == "name":
            proper = lambda w: w[0].isupper() and w[0].isalpha() and len(w) > 1 and w.lower() not in self.known
            if words[a][0] >= "㐀" and words[a][0] <= "鿿":
                return a, b
            while a and proper(words[a - 1]):
                a -= 1
            if a > 2 and words[a - 1] == "." and len(words[a - 2]) == 1 and proper(words[a - 3]):
                a -= 3
            if b + 2 < len(words) and len(words[b]) == 1 and words[b].isupper() and words[b + 1] == ".":
                b += 2
            while b < len(words) and proper(words[b]):
                b += 1
        elif kind == "street":
            number = lambda w: len(w) < 6 and w[0].isdigit()
            for back in (1, 2):
                if a >= back and number(words[a - back]) and (back == 1 or words[a - 1] in (",", "bis", "ter")):
                    a -= back
                    break
            while b < len(words) and (_STREET.fullmatch(words[b]) or (a < b and words[b][0].isupper() and words[b - 1].lower() in ("de", "la", "du", "des", "da", "do", "das", "dos", "del"))):
                b += 1
            for on in (0, 1):
                if b + on < len(words) and number(words[b + on]) and (on == 0 or words[b] == ","):
                    b += on + 1
                    break
        elif kind == "id_number" and a and len(words[a - 1]) == 2 and words[a - 1].isupper() and words[a - 1].isascii():
            a -= 1
            if b < len(words) and len(words[b]) == 1 and words[b].isupper():
                b += 1
        loose = lambda w: not (w[0].isalnum() or w[0] in "+(@")
        while a < b and loose(words[a]):
            a += 1
        while a < b and loose(words[b - 1]):
            b -= 1
        if kind == "name":
            while b - a > 2 and words[a].lower() in self.known:
                a += 1
        if kind == "street":
            while b - a > 2 and words[a].islower() and words[a] in self.known and not _STREET.fullmatch(words[a]):
                a += 1
            for i in range(a + 1, b - 1):
                if words[i] == "." and len(words[i - 1]) > 4 and not words[i + 1][0].isdigit():
                    b = i
                    break
        return a, b

    def _plausible(self, kind: str, words: list[str], before: str) -> bool:
        """The form an entity must have whatever its context, but for the token before it."""
        text = " ".join(words)
        digits = sum(c.isdigit() for c in text)
        if kind == "email":
            return bool(_AT.search(text)) and not _HOST_PATH.search(text)
        if kind in ("phone", "id_number"):
            letters = sum("A" <= c <= "Z" for c in text) if kind == "id_number" else 0
            return (digits >= 7 or digits >= 6 and letters >= 2) and before != "#" and not _NOT_NUMBER.match(text)
        if kind == "street":
            return digits >= 1 and bool(_STREET.search(text) or _STREET_HAN.search(text))
        if any(not (w[0].isalpha() or w in ".,-'’") for w in words):
            return False
        if all("㐀" <= w[0] <= "鿿" for w in words):
            return 2 <= len(words) <= 3 and words[0] in SURNAMES
        if all(w.islower() for w in words):
            return len(words) == 2 and not any(w in self.known for w in words)
        proper = [w for w in words if w[:1].isupper() and len(w) > 1]
        unknown = sum(w.lower() not in self.known for w in proper)
        return len(proper) >= 2 and unknown >= (len(proper) if all(w.isupper() for w in proper) else 1)

    def label(self, records: list[list[str | None]]) -> list[list[tuple[int, str, int, int, float]]]:
        """For each record (its turns' texts) the spans found: (turn, kind, start, stop, confidence)."""
        out: list[list[tuple[int, str, int, int, float]]] = []
        part: list[list[str | None]] = []
        size = 0
        for turns in records:
            part.append(turns)
            size += sum(len(t) for t in turns if t)
            if size >= AT_ONCE:
                out += self._label(part)
                part, size = [], 0
        return out + self._label(part)

    def _label(self, records: list[list[str | None]]) -> list[list[tuple[int, str, int, int, float]]]:
        turns = [(i, t, w) for i, texts in enumerate(records) for t, text in enumerate(texts) if text and (w := words_of(text))]
        emissions = self.crf.emissions([self.marked(records[i][t], w) for i, t, w in turns])
        # turns without an edge are chains of their own; the others of a record are joined by places that are nobody's
        single, joined = list(range(len(turns))), []
        edges: list[list[tuple[int, int]]] = []
        ends = np.cumsum([0, *(len(w) + 1 for *_, w in turns)])
        bounds = np.searchsorted([i for i, *_ in turns], np.arange(len(records) + 1))
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            words = [w for k in range(lo, hi) for w in (*turns[k][2], "\n")]
            if tied := skip_edges(words, self.known, self.keys):
                begin = ends[lo : hi + 1] - ends[lo]
                at = np.array(tied)
                of = np.searchsorted(begin, at, side="right") - 1
                pick = np.unique(of)
                sizes = np.diff(begin)[pick]
                shift = np.zeros(hi - lo, np.int64)
                shift[pick] = np.cumsum(sizes) - sizes - begin[pick]
                edges.append([(a, b) for a, b in (at + shift[of]).tolist()])
                joined.append([lo + x for x in pick.tolist()])
        for ks in joined:
            for k in ks:
                single[k] = -1
        single = [k for k in single if k >= 0]
        marg: list[np.ndarray] = [np.zeros(0)] * len(turns)
        infer = lambda e, x: skip_chain_marginals(e, x, self.crf.trans, self.crf.start, self.agree)
        for k, m in zip(single, infer([emissions[k] for k in single], [[]] * len(single))):
            marg[k] = m
        for ks, m in zip(joined, infer([np.concatenate([x for k in ks for x in (emissions[k], _BETWEEN)]) for ks in joined], edges)):
            at = 0
            for k in ks:
                n = len(turns[k][2])
                marg[k] = m[at : at + n]
                at += n + 1
        least = self.thresholds[1:].min()
        out: list[list[tuple[int, str, int, int, float]]] = [[] for _ in records]
        for (i, t, words), p in zip(turns, marg):
            if 1 - p[:, 0].min() <= least:
                continue
            kinds = 1 + p[:, 1:].argmax(1)
            y = np.where(1 - p[:, 0] > self.thresholds[kinds], kinds, 0)
            if not y.any():
                continue
            where = spans_of(records[i][t], words)
            edge = np.r_[np.flatnonzero(np.r_[True, y[1:] != y[:-1]]), len(y)]
            for a, b in zip(edge[:-1], edge[1:]):
                k = int(y[a])
                if not k:
                    continue
                kind = KINDS[k]
                c, d = self._trim(kind, words, a, b)
                if kind == "name" and (street := [x for x in range(max(0, c - 3), c) if _STREET.fullmatch(words[x])]):
                    kind = "street"  # a street named after somebody
                    c, d = self._trim(kind, words, street[0], d)
                if c < d and self._plausible(kind, words[c:d], words[c - 1] if c else ""):
                    out[i].append((t, kind, where[c][0], where[d - 1][1], float(p[c:d, k].mean())))
        return out


def _spans(texts: list[str]) -> list[tuple[int, int]]:
    ends = np.cumsum([len(t) for t in texts]).tolist()
    return list(zip([0, *ends[:-1]], ends))


def _keys(word: str, known: set[str]) -> tuple[str, ...]:
    """By what a telling word is tied to others."""
    if len(word) < 3 or not (word[0].isupper() or word[0].isdigit() or word[0] in "+(" or "@" in word):
        return ()
    low = word.lower()
    if low in known:
        return ()
    return (low,) if word[0].isdigit() else tuple({low, *(p for p in re.split(r"['’-]", low) if len(p) > 3)})


def skip_edges(words: list[str], known: set[str], keys: dict[str, tuple[str, ...]] | None = None) -> list[tuple[int, int]]:
    """Pairs of places with the same or a similar telling token: each occurrence is tied to the one before it."""
    keys = _Kept(lambda w: _keys(w, known)) if keys is None else keys
    last: dict[str, int] = {}
    out = []
    for i, telling in enumerate(map(keys.__getitem__, words)):
        for key in telling:
            if key in last and last[key] != i:
                out.append((last[key], i))
            last[key] = i
    return list(dict.fromkeys(out))


_trained: dict[tuple, Broadcast] = {}


def pii_model(samples: DataFrame) -> Broadcast:
    """The model with a table (text, sample_id) of plain sentences as background; trained once a session."""
    spark = samples.sparkSession
    rows = tuple(r.text for r in samples.where("length(trim(text)) > 0").orderBy("sample_id").limit(MAX_SAMPLES).select("text").collect())
    key = (spark.sparkContext.applicationId, hash(rows))
    if key not in _trained:
        _trained[key] = spark.sparkContext.broadcast(PiiModel(list(rows)))
    return _trained[key]


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with [KIND] in place of each span (disjoint, in order)."""
    out, at = [], 0
    for kind, a, b in spans:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


_FOUND = pa.list_(pa.struct([("turn", pa.int32()), ("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("confidence", pa.float64())]))
FOUND = "found array<struct<turn:int,kind:string,start:int,stop:int,confidence:double>>"


def _batches(batches: Iterator[pa.RecordBatch], model: Broadcast, keep: int, with_text: bool) -> Iterator[pa.RecordBatch]:
    m: PiiModel = model.value
    for batch in batches:
        records = [x or [] for x in batch.column(keep).to_pylist()]
        found = m.label(records)
        rows = [i for i, f in enumerate(found) if f] if not with_text else list(range(len(found)))
        cols = [batch.column(i).take(pa.array(rows, pa.int64())) for i in range(keep)]
        names = [*batch.schema.names[:keep], "found"]
        cols.append(pa.array([[dict(zip(("turn", "kind", "start", "stop", "confidence"), x)) for x in found[i]] for i in rows], _FOUND))
        if with_text:
            out = []
            for i in rows:
                turns = list(records[i])
                for t in {f[0] for f in found[i]}:
                    turns[t] = masked(turns[t], sorted(((k, a, b) for u, k, a, b, _ in found[i] if u == t), key=lambda x: x[1]))
                out.append(turns)
            cols.append(pa.array(out, pa.list_(pa.string())))
            names.append("masked")
        yield pa.RecordBatch.from_arrays(cols, names=names)


def find_pii(df: DataFrame, keys: list[str], turns: str, samples: DataFrame, with_text: bool = False) -> DataFrame:
    """The key columns and what was found in the turns (array of strings); with_text: all rows, and the masked turns."""
    model = pii_model(samples)
    keep = df.select(*keys, turns)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep.schema.fields[:-1])
    n = len(keys)
    return keep.mapInArrow(lambda it: _batches(it, model, n, with_text), f"{ddl}, {FOUND}" + (", masked array<string>" if with_text else ""))


def turn_texts(sft: DataFrame, chat: DataFrame) -> DataFrame:
    """(stage, row_id, turns): only the contents are read from the nested columns."""
    a = sft.select(F.lit("sft").alias("stage"), F.col("row_id").cast("long").alias("row_id"), F.col("messages.content").alias("turns"))
    b = chat.select(F.lit("chat").alias("stage"), F.col("row_id").cast("long").alias("row_id"), F.col("conversation.content").alias("turns"))
    return a.unionByName(b).where("row_id is not null and size(turns) > 0")


def pii_cases(sft: DataFrame, chat: DataFrame, samples: DataFrame) -> DataFrame:
    """(stage, row_id, turn, kind), once each."""
    found = find_pii(turn_texts(sft, chat), ["stage", "row_id"], "turns", samples)
    kinds = F.array_distinct(F.transform("found", lambda f: F.struct(f["turn"].alias("turn"), f["kind"].alias("kind"))))
    return found.select("stage", "row_id", F.explode(kinds).alias("f")).select("stage", "row_id", "f.turn", "f.kind")
