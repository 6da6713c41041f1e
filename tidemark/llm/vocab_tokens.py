"""The tokenizer of a piece vocabulary: greedy longest pieces of lower-case words, everything else by the character."""

from __future__ import annotations

import re

from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame

_UNIT = re.compile(r"[㐀-鿿豈-﫿\U00020000-\U0003ffff]|[^\W_㐀-鿿豈-﫿\U00020000-\U0003ffff]+|[^\w\s]|_")
#: pieces a vocabulary may have to be sent to the tasks
MAX_PIECES = 2_000_000


class VocabTokenizer:
    """Counts tokens; the counts of words are kept, as most words recur."""

    KEPT = 500_000

    def __init__(self, pieces: list[str]) -> None:
        self.begin = {p for p in pieces if not p.startswith("##")}
        self.inner = {p[2:] for p in pieces if p.startswith("##")}
        self.longest = max((len(p) for p in pieces), default=0)
        self.counts: dict[str, int] = {}

    def split(self, word: str) -> list[str]:
        """Pieces of one word, or [UNK] where at some position nothing fits."""
        out, at = [], 0
        while at < len(word):
            known = self.inner if at else self.begin
            for end in range(min(len(word), at + self.longest), at, -1):
                if word[at:end] in known:
                    out.append(("##" if at else "") + word[at:end])
                    at = end
                    break
            else:
                return ["[UNK]"]
        return out

    def tokens(self, text: str) -> list[str]:
        return [p for w in _UNIT.findall(text.lower()) for p in self.split(w)]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if len(self.counts) > self.KEPT:
            self.counts = {}
        counts, total = self.counts, 0
        for w in _UNIT.findall(text.lower()):
            n = counts.get(w)
            if n is None:
                n = counts[w] = len(self.split(w))
            total += n
        return total


_sent: dict[tuple, Broadcast] = {}


def tokenizer(vocab: DataFrame) -> Broadcast:
    """The tokenizer of a table (token_id, piece), sent to the tasks; its size is checked."""
    spark = vocab.sparkSession
    rows = vocab.where("piece is not null").select("piece").limit(MAX_PIECES + 1).collect()
    if len(rows) > MAX_PIECES:
        raise ValueError(f"a vocabulary of more than {MAX_PIECES} pieces")
    pieces = sorted(r.piece for r in rows)
    key = (spark.sparkContext.applicationId, hash(tuple(pieces)))
    if key not in _sent:
        _sent[key] = spark.sparkContext.broadcast(VocabTokenizer(pieces))
    return _sent[key]
