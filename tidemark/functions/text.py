"""Text functions as column expressions, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = r"[\t\n\x0B\f\r\x1C-\x20\x85\xA0  -     　]"


def stripped(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, rf"^{WHITE}+|{WHITE}+\z", "")


def literal_test(pattern: str, case_sensitive: bool = False):  # noqa: ANN201
    """A predicate on a text column: it contains the string."""
    if case_sensitive:
        return lambda t: F.contains(t, F.lit(pattern))
    return lambda t: F.contains(F.lower(t), F.lit(pattern.lower()))


#: what RE2 has no notion of, and Java has
_FOREIGN = ("(?=", "(?!", "(?<=", "(?<!", "(?>", "*+", "++", "?+")


def regex_test(pattern: str, case_sensitive: bool = False):  # noqa: ANN201
    """A predicate: the regular expression occurs. Patterns that only backtracking engines have are refused."""
    if any(x in pattern for x in _FOREIGN) or any(f"\\{d}" in pattern for d in "123456789"):
        raise ValueError("look-around, possessive quantifiers and back-references are not supported")
    flags = "(?d)" if case_sensitive else "(?iud)"
    return lambda t: F.rlike(t, F.lit(flags + pattern))


def snippet(text: Column, pattern: str, width: int = 240) -> Column:
    """A window of about ``width`` characters centred on the first match of a literal, with … on cut sides."""
    at = F.instr(F.lower(text), pattern.lower())
    size = max(width, len(pattern))
    start = F.greatest(F.lit(1), at - F.lit((size - len(pattern)) // 2))
    cut = F.substring(text, start, F.lit(size))
    return F.when(at > 0, F.concat(F.when(start > 1, "…").otherwise(""), cut, F.when(start + size - 1 < F.length(text), "…").otherwise("")))


def excerpt(text: Column, budget: int, parts: int = 3) -> Column:
    """A text within ``budget`` characters: evenly spaced spans joined by a marker that counts against the budget."""
    marker = "\n\n[…]\n\n"
    span = (budget - len(marker) * (parts - 1)) // parts
    step = F.floor((F.length(text) - span) / (parts - 1)).cast("int")
    spans = [F.substring(text, (step * i + 1).cast("int"), F.lit(span)) for i in range(parts)]
    return F.when(text.isNull() | (F.length(text) <= budget), text).otherwise(F.concat_ws(marker, *spans))


def clip(text: Column, limit: int) -> Column:
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.left(text, F.lit(limit)), F.lit("\n…[truncated]")))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+\z", "")


def fnv32(text: Column, length: int = 400) -> Column:
    """FNV-1a of the first code points of a text, as eight hexadecimal digits."""
    codes = F.transform(F.filter(F.split(F.left(text, F.lit(length)), ""), lambda c: F.length(c) > 0), lambda c: F.ascii(c).cast("long"))
    h = F.aggregate(codes, F.lit(2166136261).cast("long"), lambda a, c: ((a.bitwiseXOR(c)) * F.lit(16777619)).bitwiseAND(F.lit(4294967295)))
    return F.lpad(F.lower(F.hex(h)), 8, "0")


#: What is no prose: code blocks, formulas, addresses, inline code, commands of formula text.
NOISE = (r"(?s)```.*?```", r"(?s)\$\$.*?\$\$|\$[^$\n]+\$|\\\[.*?\\\]|\\\(.*?\\\)", r"https?://\S+|www\.\S+", r"`[^`\n]+`", r"\\[a-zA-Z]+")


def strip_noise(text: Column) -> Column:
    """Without code blocks, formulas, addresses, inline code and LaTeX commands."""
    for pattern in NOISE:
        text = F.regexp_replace(text, pattern, " ")
    return text


def letters(text: Column) -> Column:
    """Letters, combining marks included."""
    return F.length(F.regexp_replace(text, r"[^\p{L}\p{M}]", ""))


def host(url: Column) -> Column:
    """Host of an address in lower case, without www; null if it has none."""
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


def trigrams(text: Column) -> Column:
    """Distinct three-character pieces of a text in lower case."""
    low = F.lower(text)
    pieces = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(low) - 2)), lambda i: F.substring(low, i, F.lit(3)))
    return F.when(F.length(low) >= 3, F.array_distinct(pieces)).otherwise(F.array().cast("array<string>"))


def before_think(text: Column) -> Column:
    """The reasoning before a closing think mark, null if there is none."""
    return F.when(F.contains(text, F.lit("</think>")), F.regexp_replace(F.substring_index(text, "</think>", 1), r"^\s*<think>", ""))


def after_think(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("</think>")), F.regexp_replace(text, r"(?s)\A.*?</think>\s*", "")).otherwise(text)


def occurrences(text: Column, pattern: str) -> Column:
    """How often a literal stands in a text, occurrences not overlapping, without regard to case."""
    low = F.lower(text)
    return ((F.length(low) - F.length(F.replace(low, F.lit(pattern.lower()), F.lit("")))) / len(pattern)).cast("long")


#: The shape of a chat-bot credential (account id, time stamp and signature in base64url) and its marker.
#: In serialized text an escape (\\n, \\u00e9) is a boundary too; a backslash alone is none.
CREDENTIAL = r"(?:(?<![\w\\-])|(?<=\\[nrtbf\\])|(?<=\\u[0-9a-fA-F]{4}))([A-Za-z0-9_-]{20,30})\.[A-Za-z0-9_-]{6}\.[A-Za-z0-9_-]{25,110}(?![\w-])"
CREDENTIAL_MARKER = "[REDACTED_DISCORD_TOKEN]"


def redact(text: Column) -> Column:
    """Credentials of that shape whose first part decodes to digits become a marker; other dotted strings stay."""
    found = F.regexp_extract_all(text, F.lit(CREDENTIAL), F.lit(0))

    def is_account(token: Column) -> Column:
        first = F.translate(F.substring_index(token, ".", 1), "-_", "+/")
        padded = F.rpad(first, (F.ceil(F.length(first) / 4) * 4).cast("int"), F.lit("="))
        return F.coalesce(F.rlike(F.try_to_binary(padded, F.lit("base64")).cast("string"), F.lit(r"\A[0-9]+\z")), F.lit(False))

    tokens = F.array_distinct(F.filter(found, is_account))
    return F.aggregate(tokens, text, lambda t, x: F.replace(t, x, F.lit(CREDENTIAL_MARKER)))
