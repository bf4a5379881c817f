"""Text functions: folding, chunk windows, casing."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK_LENGTH = 500
CHUNK_STRIDE = 480
ALL_CAPS_SHARE = 0.6


def fold(text: Column) -> Column:
    """Lower case, runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def chunks(text: Column, length: int = CHUNK_LENGTH, stride: int = CHUNK_STRIDE) -> Column:
    """array<struct<offset:int,text:string>>: windows every ``stride`` characters, the last being the first short one."""
    if length <= 0 or stride <= 0:
        raise ValueError("chunk length and stride must be positive")
    n = F.length(text)
    more = F.when(n <= length, 0).otherwise(F.floor((n - length) / stride) + 1)
    starts = F.transform(F.sequence(F.lit(0), more.cast("int")), lambda k: k * stride)
    windows = F.transform(starts, lambda o: F.struct(o.cast("int").alias("offset"), F.substring(text, o + 1, F.lit(length)).alias("text")))
    return F.filter(F.when(n > 0, windows).otherwise(F.array()).cast("array<struct<offset:int,text:string>>"), lambda c: c["text"] != "")


def rebase(start: Column, end: Column, offset: Column) -> tuple[Column, Column]:
    return start + offset, end + offset


def mostly_uppercase(text: Column) -> Column:
    """More than 60 % of the letters are capitals."""
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    return F.coalesce((letters > 0) & (F.regexp_count(text, F.lit(r"\p{Lu}")) > letters * ALL_CAPS_SHARE), F.lit(False))


# Plain-string versions for code that runs in workers.


def fold_with_offsets(text: str) -> tuple[str, list[int]]:
    """The folded text and, for each of its characters, the place in the text it comes from."""
    out: list[str] = []
    places: list[int] = []
    for i, c in enumerate(text):
        if c.isspace():
            if out and out[-1] != " ":
                out.append(" ")
                places.append(i)
            continue
        for low in c.lower():
            out.append(low)
            places.append(i)
    if out and out[-1] == " ":
        out.pop()
        places.pop()
    return "".join(out), places


def is_word_char(c: str) -> bool:
    return unicodedata.category(c)[0] in "LN"


def whole_word_places(folded: str, phrase: str) -> list[int]:
    """Where a phrase occurs, overlaps included, not within a longer word."""
    if not phrase:
        return []
    out, at = [], folded.find(phrase)
    guard_left, guard_right = is_word_char(phrase[0]), is_word_char(phrase[-1])
    while at >= 0:
        end = at + len(phrase)
        left = guard_left and at > 0 and is_word_char(folded[at - 1])
        right = guard_right and end < len(folded) and is_word_char(folded[end])
        if not left and not right:
            out.append(at)
        at = folded.find(phrase, at + 1)
    return out


def bare(text: str) -> str:
    """Letters and digits in lower case, marks dropped: how readings of one word are compared."""
    return "".join(c for c in unicodedata.normalize("NFKD", text).lower() if is_word_char(c))


def texts_agree(one: str, other: str) -> bool:
    """Whether the shorter text occurs in the longer with at most a third of its letters misread (one at least is allowed)."""
    a, b = sorted((bare(one), bare(other)), key=len)
    if not a:
        return True
    row = [0] * (len(b) + 1)  # cheapest edits of a's prefix against a stretch of b ending here
    for i, c in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(b, 1):
            last, row[j] = row[j], min(last + (c != d), row[j] + 1, row[j - 1] + 1)
    return min(row) <= max(1, len(a) // 3)


def title_case(text: str) -> str:
    """Words of capitals alone get one capital; the length stays."""
    import re

    def turn(m: re.Match) -> str:
        w = m[0]
        low = w[1:].lower()
        return w[0] + low if len(low) == len(w) - 1 else w

    return re.sub(r"[^\W\d_]{2,}", lambda m: turn(m) if m[0].isupper() else m[0], text)


def normalise_casing(text: str) -> str:
    letters = [c for c in text if unicodedata.category(c).startswith("L")]
    upper = sum(unicodedata.category(c) == "Lu" for c in letters)
    return title_case(text) if letters and upper > ALL_CAPS_SHARE * len(letters) else text
