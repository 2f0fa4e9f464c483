"""Phrase replacement outside protected parts.

A text is cut at its protected parts (code, table rows, quotes, addresses, slash lists); only the gaps are
rewritten, so nothing has to be masked and put back.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tonewright.functions import fixed_values as V
from tonewright.functions.text import FIRST_WIDE, any_wide, fitting, java, needed, wide

#: Flags are local to each part, so that all go into one alternation, tried in order at each place. A text is searched only for the
#: parts whose marks it holds: the class of words before an @ or a slash is tried at every letter.
MARKS = [["```"], ["`"], ["|"], ["“", "「", "『", '"'], ["http", "www."], ["@"], ["/"]]
PARTS = [f"({p[:4]}:{p[4:]})".replace("((?s):", "(?s:").replace("((?m):", "(?m:") if p[:4] in ("(?s)", "(?m)") else f"(?:{p})" for p in V.PROTECTED]
PROTECTED = "|".join(PARTS)


def parted(text: Column) -> tuple[Column, Column]:
    """What lies between protected parts, and the parts, as arrays; the first is one longer."""
    regex = fitting(text, list(zip(PARTS, MARKS, strict=True)), java(PROTECTED).removesuffix(PROTECTED))
    return F.split(text, regex, -1), F.regexp_extract_all(text, regex, F.lit(0))


def gaps(text: Column, change) -> Column:
    """The text with `change` applied to what lies between protected parts."""
    pieces, kept = parted(text)
    changed = F.transform(pieces, change)
    return F.array_join(F.flatten(F.transform(F.arrays_zip(changed.alias("c"), kept.alias("k")), lambda x: F.array(F.coalesce(x["c"], F.lit("")), F.coalesce(x["k"], F.lit(""))))), "")


#: Every phrase begins with a wide character, which is quicker to see than the words that may lead it.
AT_WIDE = rf"(?=[\x{{{FIRST_WIDE:x}}}-\x{{10ffff}}])"
#: Of which every text with a phrase holds one.
PHRASE_WORDS = sorted({w for p, _ in V.PHRASES for w in needed(p)})
assert all(needed(p) for p, _ in V.PHRASES) and all(map(wide, PHRASE_WORDS))


def replaced(text: Column) -> Column:
    """All phrases in order of priority, each once over the text; a text without a word of any is left as it is."""
    out = text
    for pattern, by in V.PHRASES:
        out = F.regexp_replace(out, F.lit(AT_WIDE + java(pattern)), F.lit(by))
    return F.when(any_wide(text, PHRASE_WORDS), out).otherwise(text)


def tidy(text: Column) -> Column:
    """Doubled commas and blanks, orphaned particles, blanks before Chinese marks, white space at the ends."""
    steps = [("[,，]{2,}", "，"), (r"[ \t]{2,}", " "), ("(全方位|多维度|深度|全面)的", "$1"), (r"\s+([，。！？；：）】」])", "$1"), (r"\A\s+|(?<!\s)\s+\z", "")]
    for pattern, by in steps:
        text = F.regexp_replace(text, F.lit(java(pattern)), F.lit(by))
    return text


def rewritten(text: Column) -> Column:
    """The text with phrases replaced and tidied; unchanged where no phrase matches."""
    out = gaps(text, replaced)
    return F.when(out == text, text).otherwise(tidy(out))
