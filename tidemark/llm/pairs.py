"""Broken prompt and response pairs (problem 6).

Each answer is set against the nearest user turn before it and gets at most one defect, the first that holds:

- ``empty``: null, or no letter or digit outside the think block;
- ``copy``: compressed with the user turn as a zstandard dictionary next to nothing is left of it;
- ``refusal``: by a dictionary of refusing and courteous phrases in six languages every sentence refuses or is courtesy;
- ``truncated``: by the terminal-context models of `truncation`;
- ``language``: its language, by the model of `language`, is neither used in the user turn nor named there; where the
  lexicons tell the same language of both sides beyond doubt the model is not asked.

Scale: one pass over the turns without a shuffle for all but truncation, whose verdicts are joined by turn.

Defined results: a turn without a user turn before it, or with function calls, is not looked at; a null user turn can
only have empty, refusing or cut answers; repeated rows are each reported.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.language import LEXICON, SPELLINGS, label, language_model, sentence_languages
from tidemark.llm.truncation import all_turns, truncated_turns

_THINK = re.compile(r"<think>.*?</think>", re.S)
_SPLIT = re.compile(r"(?<=[.!?…])[\"'”’»)]*\s+|(?<=[。！？；])|\n+")
_PLAIN = re.compile(r"[^\w]+|_+")

#: Phrases that decline, by language.
_DO_EN = r"(?:help|assist|answer|discuss|provid|write|fulfil|comply|do (?:that|this|it|so)|be able to (?:do|help)|continu|engag|respond|support|shar|talk|speak|carry|complet|generat|creat|produc|address|go into|offer|tak(?:e|ing) (?:on|part)|process|handle|grant|accommodat|give (?:you|advice|guidance)|comment)"
_REFUSE = re.compile(
    "|".join(
        [
            rf"\b(?:can(?:'|’)?t|cannot|can not|won(?:'|’)t|will not|couldn(?:'|’)t|(?:un|not )able to|am unable to|refuse to|decline to|not going to|(?:would|(?:'|’)d) rather not|prefer not to|do not wish to|don(?:'|’)t want to|not willing to|not in a position to)\b(?! stress)[\w ,]{{0,24}}\b{_DO_EN}",
            r"\bsomething (?:that )?I (?:can(?:'|’)?t|cannot|won(?:'|’)t|will not|am not able to|am unable to|don(?:'|’)t) (?:be able to )?(?:do|help|discuss|offer|provide)",
            r"\bagainst (?:the|my|our) (?:\w+ )?(?:polic|guideline|rule|principle)",
            r"\b(?:outside|beyond|not within) (?:of )?what I(?: am|(?:'|’)m| can| may)",
            r"\b(?:not (?:allowed|permitted)|no permission|don(?:'|’)t have (?:the )?permission|do not have permission) to\b",
            r"\bnot comfortable\b",
            r"\b(?:have|need) to pass on\b|\b(?:must|have to|need to) (?:decline|refuse|turn down|reject)(?: to\b| (?:this|that|the|your) (?:request|task|question|one|topic))",
            r"\bnot a (?:topic|subject|request|question)\b.*\bI (?:can|may|am)",
            r"\bmy (?:guidelines|polic(?:y|ies)|rules|instructions|principles) (?:do not|don(?:'|’)t|does not|prevent|forbid|prohibit|keep)",
            r"\bno(?:, |\. )?I won(?:'|’)t\b",
            r"\bnot possible for me to\b|\bimpossible for me to\b|\bmir (?:leider )?nicht möglich\b|\bm(?:'|’)est (?:pas possible|impossible)|\bno me es posible\b|\bme resulta imposible\b|\bnão me é possível\b",
            # German
            r"\b(?:kann|darf|möchte|werde|will|könnte)\b[^.!?]{0,60}\bnicht\b[^.!?]{0,30}(?:helfen|beantworten|sprechen|schreiben|antworten|unterstützen|nachkommen|besprechen|erledigen|bearbeiten|weiterhelfen|äußern|liefern|diskutieren|eingehen|dienen)",
            r"\b(?:muss|möchte)\b[^.!?]{0,40}\bablehnen\b|\blehne\b[^.!?]{0,40}\bab\b|\bkeine (?:Auskunft|Antwort|Hilfe)\b",
            r"\b(?:Richtlinien|Vorgaben|Regeln|Vorschriften|Grundsätze)\b[^.!?]{0,30}\b(?:erlauben|verbieten|untersagen|gestatten|lassen)",
            r"\bdas (?:schreibe|mache|tue|beantworte) ich nicht\b|\bnicht in der Lage\b|\baußerhalb dessen, was\b|\bnicht (?:erlaubt|gestattet)\b|\büber(?:steigt|schreitet)\b[^.!?]{0,30}\bich\b",
            # French
            r"\bne (?:peux|puis|pourrai|saurais|suis) (?:malheureusement )?pas\b[^.!?]{0,40}\b(?:aider|répondre|parler|rédiger|écrire|fournir|traiter|discuter|aborder|satisfaire|donner|faire|mesure|autoris|habilit)",
            r"\bm(?:'|’)interdi|\bne (?:rédigerai|écrirai|ferai|répondrai|traiterai) pas\b|\bdéclin(?:er|e)\b[^.!?]{0,20}\b(?:demande|requête|question)|\bdépasse ce que je\b|\bpréfère ne pas\b|\b(?:dois|vais) (?:refuser|décliner)|\bne me permet|\bpas (?:autorisé|en mesure)",
            # Spanish
            r"\bno (?:puedo|podré|podría|voy a|quiero|debo)\b[^.!?]{0,30}\b(?:ayudar|responder|hablar|escribir|ofrecer|tratar|atender|contestar|cumplir|hacer|dar|proporcionar|redactar)",
            r"\bprefiero no\b|\bno me permit|\b(?:debo|tengo que|he de) (?:rechazar|declinar)|\bno (?:escribiré|redactaré|responderé|haré)\b|\bno est(?:oy|á) (?:autorizad|permitid)|\bfuera de lo que (?:puedo|me)\b|\b(?:supera|excede|sobrepasa) lo que (?:puedo|me)\b",
            # Portuguese
            r"\bnão (?:posso|poderei|poderia|vou|quero|devo|consigo)\b[^.!?]{0,30}\b(?:ajudar|responder|falar|escrever|oferecer|tratar|atender|cumprir|fazer|dar|fornecer|redigir)",
            r"\bprefiro não\b|\bnão (?:me )?permit|\b(?:devo|tenho (?:de|que)|preciso) (?:recusar|rejeitar|declinar)|\bnão (?:escreverei|redigirei|responderei|farei)\b|\bnão est(?:ou|á) (?:autorizad|permitid)|\b(?:fora|além) do que (?:posso|me)\b|\b(?:ultrapassa|foge a?o?) ?o? que (?:posso|me)\b",
            # Chinese
            r"(?:不能|无法|不便|不可以|没办法|不方便|不会|不愿|不想|恕难).{0,8}(?:回答|帮|协助|提供|讨论|谈|写|满足|完成|处理|从命|答复|参与)|拒绝(?:这|此|该|您|你|回答|这个)?.{0,4}(?:要求|请求|问题|回答)|超出了?我|不允许我|规定.{0,6}不(?:允许|许)|(?:不能|无法)(?:为您|给您|帮您)",
        ]
    ),
    re.I,
)
#: Phrases that only keep a refusal polite, by language.
_COURTESY = re.compile(
    "|".join(
        [
            r"\b(?:hope you (?:\w+ )?understand|feel free|let me know|please (?:consult|ask|contact|reach)|consult (?:a|someone)|talk about something|anything else|something else|another (?:question|topic|task)|point you|thank(?:s| you) for (?:your (?:question|understanding|message)|asking)|what you are after|sorry|apolog|hello|hi\b|happy to help|good (?:morning|day)|i understand)",
            r"(?:Verständnis|wende dich|wenden Sie sich|Danke für|etwas anderes|andere Frage|tut mir leid|leider|Entschuldig|Hallo|gerne)",
            r"(?:n(?:'|’)hésitez|adressez-vous|merci (?:pour|de)|vous comprenez|autre (?:question|chose|sujet)|désolé|bonjour|espère)",
            r"(?:consulte|gracias por|espero que|otra (?:pregunta|cosa)|algo más|otro tema|lo siento|no dude|hola|disculp)",
            r"(?:procure|obrigad[oa] (?:pel|por)|compreenda|entenda|outra (?:pergunta|coisa)|mais alguma|outro (?:tema|assunto)|sinto muito|desculpe|fique à vontade|olá|lamento)",
            r"(?:换一个|换个|咨询|谢谢|感谢|理解|谅解|其他问题|别的|抱歉|对不起|您好|你好|专业人士)",
        ]
    ),
    re.I,
)
#: a phrase that declines holds one of these; a sentence without any need not be matched
_NEEDED = (
    "n't", "n’t", "not", "unable", "refuse", "decline", "against", "outside", "beyond", "permission", "pass on", "turn down", "reject", "impossible", "my guideline", "my polic", "my rule", "my instruction", "my principle", "nicht", "ablehn", "lehne",
    "keine ", "richtlinien", "vorgaben", "regeln", "vorschriften", "grundsätze", "außerhalb", "übersteigt", "überschreitet", "pas", "interdi", "déclin", "refuser", "permet", "no ", "no,", "imposible", "rechazar", "declinar", "permit", "fuera de", "supera", "excede", "sobrepasa",
    "não", "recusar", "rejeitar", "fora d", "além d", "ultrapassa", "foge", "不", "无法", "没办法", "恕难", "拒绝", "超出",
)


#: sentences of this many words or fewer, or Chinese characters, beside a refusal add nothing
_SHORT_WORDS, _SHORT_HAN = 8, 14


def refuses(text: str) -> bool:
    """Whether a text only declines: some sentence refuses and no other says anything."""
    sentences = [x.strip() for x in _SPLIT.split(text) if x and any(c.isalnum() for c in x)]
    refused = 0
    for s in sentences:
        if re.search(r"[\"“„«「].+[\"”“»」]", s):  # quoting a refusal is no refusal
            return False
        low = s.lower()
        if any(k in low for k in _NEEDED) and _REFUSE.search(s):
            refused += 1
            continue
        if _COURTESY.search(s):
            continue
        han = sum("㐀" <= c <= "鿿" for c in s)
        if any(c.isdigit() for c in s) or (han > _SHORT_HAN if han else len(s.split()) > _SHORT_WORDS):
            return False
    return refused > 0


def folded(text: str) -> bytes:
    return _PLAIN.sub(" ", text.lower()).strip().encode()


#: an answer of this many bytes that only repeats a part of a longer user turn is a copy too; a shorter one may quote
PART = 160


def copies(user: str, answer: str) -> bool:
    """Whether an answer only repeats the user turn, by what zstandard cannot take from it as a dictionary."""
    a, u = folded(answer), folded(user)
    if not a or not u or not min(0.6 * len(u), PART) <= len(a) <= 1.25 * len(u) + 24:
        return False
    if a == u:
        return True
    if len(u) < 8:
        return False
    d = zstandard.ZstdCompressionDict(u, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    frame = zstandard.ZstdCompressor(level=3, dict_data=d, write_content_size=False, write_checksum=False).compress(a)
    alone = zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False).compress(a)
    return len(frame) <= 16 + 0.06 * len(a) and len(frame) < 0.5 * len(alone)


_NAMED = {code: re.compile("|".join(re.escape(n) for n in names if len(n) > 3 or not n.isascii()), re.I) for code, names in SPELLINGS.items()}


def languages_asked(text: str) -> set[str]:
    """Languages whose name stands in a text."""
    return {code for code, rx in _NAMED.items() if rx.search(text)}


_ONLY: dict[str, str] = {}
for _lang, _words in LEXICON.items():
    for _w in _words.split():
        _ONLY[_w] = "" if _w in _ONLY else _lang
_ONLY = {w: g for w, g in _ONLY.items() if g}
_LETTERS = re.compile(r"[㐀-鿿]|[^\W\d_㐀-鿿]+")
#: words that only one language has, needed to tell it, and the share of them it must have
CLEAR, CLEAR_SHARE = 4, 0.85


def clear_language(text: str) -> str | None:
    """The language of a text that its words or script leave no doubt of, else None."""
    units = _LETTERS.findall(text.lower())
    han = sum(len(w) == 1 and "㐀" <= w <= "鿿" for w in units)
    if han:
        return "zh" if han >= 8 and han > CLEAR_SHARE * len(units) else None
    votes: dict[str, int] = {}
    for w in units:
        g = _ONLY.get(w)
        if g:
            votes[g] = votes.get(g, 0) + 1
    if not votes:
        return None
    best = max(votes, key=lambda g: (votes[g], g))
    return best if votes[best] >= CLEAR and votes[best] >= CLEAR_SHARE * sum(votes.values()) else None


#: answers labelled together; bounds the memory of a task
CHUNK = 1000


def _defects(batches: Iterator[pa.RecordBatch], model: Broadcast, keep: int) -> Iterator[pa.RecordBatch]:
    crf = model.value
    for batch in (b.slice(i, CHUNK) for b in batches for i in range(0, b.num_rows, CHUNK)):
        contents, users = batch.column(keep).to_pylist(), batch.column(keep + 1).to_pylist()
        out: list[str | None] = [None] * len(contents)
        foreign = [False] * len(contents)
        rest = []
        user_langs: dict[str, str | None] = {}
        for i, (c, u) in enumerate(zip(contents, users)):
            body = _THINK.sub("", c) if c and "<think>" in c else c or ""
            if not any(x.isalnum() for x in body):
                out[i] = "empty"
            elif u and copies(u, body):
                out[i] = "copy"
            elif refuses(body):
                out[i] = "refusal"
            elif u and not ((lang := clear_language(body)) and (user_langs[u] if u in user_langs else user_langs.setdefault(u, clear_language(u))) == lang):
                rest.append((i, body, u))
        texts = list(dict.fromkeys([b for _, b, _ in rest] + [u for _, _, u in rest]))
        found = dict(zip(texts, label(texts, crf)))
        for i, body, u in rest:
            mine = sentence_languages(found[body], crf.labels)
            if not mine:
                continue
            theirs = found[u]
            used = set(sentence_languages(theirs, crf.labels)) | ({crf.labels[int(theirs["p"].sum(0).argmax())]} if len(theirs["p"]) else set())
            total = found[body]["p"].sum(0)
            main = crf.labels[int(total.argmax())]
            if used and main in mine and main not in used and total.max() > 0.7 * total.sum() and theirs["p"][:, int(total.argmax())].mean() < FOREIGN:
                foreign[i] = main not in languages_asked(u)
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(keep)), pa.array(out, pa.string()), pa.array(foreign, pa.bool_())], names=[*batch.schema.names[:keep], "defect", "foreign_lang"])


#: share of the user turn in the answer's language from which the answer is not foreign
FOREIGN = 0.12


def answers(ts: DataFrame) -> DataFrame:
    """Turns with an answering role after a user turn, without function calls."""
    called = F.coalesce(F.trim("calls"), F.lit("")).isin("", "[]", "null")
    return ts.where(F.col("role").isin("assistant", "model") & F.col("asked") & called)


def defective_answers(sft: DataFrame, dpo: DataFrame, samples: DataFrame) -> DataFrame:
    """(stage, row_id, side, turn, source, defect), one row for each defective answer."""
    model = language_model(samples)
    keys = ["stage", "row_id", "side", "turn", "source"]
    looked = answers(all_turns(sft, dpo)).select(*keys, "content", "user").mapInArrow(
        lambda it: _defects(it, model, len(keys)), "stage string, row_id long, side string, turn int, source string, defect string, foreign_lang boolean"
    )
    cut = truncated_turns(sft, dpo).select("stage", "row_id", "side", "turn", F.lit(True).alias("cut"))
    kind = F.coalesce("defect", F.when(F.col("cut"), "truncated"), F.when(F.col("foreign_lang"), "language"))
    return looked.join(cut, ["stage", "row_id", "side", "turn"], "left").select(*keys, kind.alias("defect")).where("defect is not null")


def defect_rates(sft: DataFrame, dpo: DataFrame, samples: DataFrame) -> DataFrame:
    """For each stage, source and defect the number of answers that have it."""
    return defective_answers(sft, dpo, samples).groupBy("stage", "source", "defect").agg(F.count(F.lit(1)).alias("answers"))
