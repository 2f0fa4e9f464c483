"""Chinese punctuation: half-width marks next to Chinese become full-width, runs and blanks are tidied.

Code, addresses and mail are cut out first and put back as they were; a removed part counts as a neighbour
that is not Chinese. Conditions on neighbours are look-arounds, so every mark sees the original text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tonewright.functions import fixed_values as V
from tonewright.functions.text import fitting

HAN = r"\x{4e00}-\x{9fff}"
NEAR = rf"[{HAN}\x{{3000}}-\x{{303f}}\x{{ff00}}-\x{{ffef}}\x{{2026}}]"
ALNUM = "[A-Za-z0-9]"
#: Addresses and tokens that have to stay as they are.
URL = r"(?:https?://|www\.)[^\s\x{4e00}-\x{9fff}\x{ff0c}\x{3002}\x{ff01}\x{ff1f}\x{ff1b}\x{ff1a}\x{3001}\x{ff08}\x{ff09}\x{3010}\x{3011}\x{300c}\x{300d}\x{300e}\x{300f}]+"
PARTS = [V.PROTECTED[0], V.PROTECTED[1], URL, V.PROTECTED[5]]
PROTECTED = "(?U)(?s:```.*?```)|" + "|".join(f"(?:{p})" for p in PARTS[1:])
#: The same one by one, with what each match holds.
MARKED = [("(?s:```.*?```)", ["```"]), *((f"(?:{p})", words) for p, words in zip(PARTS[1:], (["`"], ["http", "www."], ["@"]), strict=True))]
HALF, FULL = ",;:!?.", "，；：！？。"
TOKENS = [r"\bv?\d+(?:\.\d+){1,4}\b", r"\b\d{1,3}(?:,\d{3})+\b", r"\b\d{1,2}:\d{2}(?::\d{2})?\b"]


def swap(text: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(text, F.lit(pattern), F.lit(by))


def ellipses(text: Column) -> Column:
    for run in (r"\.{3,}", r"\x{2026}+"):
        edge = r"(?<!\.)" if run[1] == "." else r"(?<!\x{2026})"
        text = swap(text, rf"(?<={NEAR}){edge}{run}|{edge}{run}(?={NEAR})", "……")
    return text


def collapse_mixed(text: Column) -> Column:
    """Runs of half- and full-width forms of one mark next to Chinese become one half-width mark."""
    for half, full in zip("!?.,;:", ("！", "？", "", "，", "；", "："), strict=True):
        run = rf"[\{half}{full}]"
        before, after = rf"(?<!{run})(?<!{ALNUM})", rf"(?!{run})(?!{ALNUM})"
        whole = rf"{before}{run}{{2,}}{after}"
        text = swap(text, rf"(?<={NEAR}){whole}|{whole}(?={NEAR})", half)
    return text


def parens(text: Column) -> Column:
    inner, han = r"([^()\n]*)", rf"([^()\n]*[{HAN}][^()\n]*)"
    for _ in range(2):
        text = swap(text, rf"\({han}\)|(?<={NEAR})\({inner}\)|\({inner}\)(?={NEAR})", "（$1$2$3）")
    return text


#: A half-width mark next to Chinese; a full stop only without letters or digits beside it. The mark comes first, so that
#: neighbours are looked at beside marks alone.
BESIDE = rf"(?:(?<={NEAR}.)|(?={NEAR}))"
WIDENED = rf"[,;:!?]{BESIDE}|\.(?<!{ALNUM}.)(?!{ALNUM}){BESIDE}"


def woven(pieces: Column, found: Column) -> Column:
    """Pieces of a text and what stood between them, put together again."""
    pairs = F.arrays_zip(pieces.alias("p"), found.alias("k"))
    return F.array_join(F.flatten(F.transform(pairs, lambda x: F.array(F.coalesce(x["p"], F.lit("")), F.coalesce(x["k"], F.lit(""))))), "")


def widen(text: Column) -> Column:
    """Marks next to Chinese made full-width; all are found in the text as it came, so none is a neighbour to another."""
    found = F.transform(F.regexp_extract_all(text, F.lit(WIDENED), 0), lambda m: F.translate(m, HALF, FULL))
    return woven(F.split(text, WIDENED, -1), found)


#: Stand-ins for marks about to be widened: they are not Chinese to their neighbours.
MARKS = "\ue010\ue011\ue012\ue013\ue014\ue015"


def widen_free(text: Column) -> Column:
    """The same of a text without MARKS, which is looked at once a mark and never twice."""
    for half, mark in zip(HALF, MARKS, strict=True):
        guard = rf"(?<!{ALNUM}.)(?!{ALNUM})" if half == "." else ""
        text = swap(text, rf"\{half}{guard}{BESIDE}", mark)
    return F.translate(text, MARKS, FULL)


def collapse(text: Column) -> Column:
    for mark in FULL:
        text = swap(text, mark + "{2,}", mark)
    return swap(text, "……+", "……")


def blanks(text: Column) -> Column:
    text = swap(text, rf"(?<=[{HAN}])[ \t]+(?=[{HAN}])", "")
    text = swap(text, r"(?<![ \t])[ \t]+(?=[，。！？；：、）】」』…])", "")
    return swap(text, r"(?<=[（【「『])[ \t]+", "")


STEPS = {"pn03_ellipsis": ellipses, "pn04_precollapse": collapse_mixed, "pn05_parens": parens, "pn06_widen": widen, "pn07_collapse": collapse, "pn08_spaces": blanks}
HOLE = "\ue01f"
#: Characters of the text that look like a hole or a mark are held back themselves.
HELD_BACK = rf"{PROTECTED}|[{HOLE}{MARKS}]"


def held_back(text: Column) -> Column:
    """`HELD_BACK` without the parts that the text can't hold."""
    return fitting(text, MARKED, "(?U)", f"[{HOLE}{MARKS}]")


#: Up to the end of the line of the last Chinese character or full-width mark.
REACHED = rf"(?s)\A.*{NEAR}[^\n]*"


def reached(text: Column) -> Column:
    """As much of a text as the steps can change.

    All that a step matches lies on a line with a character of NEAR, before or after other steps. Of protected parts only
    fenced code goes over lines, so a text with fences is taken whole, as is one whose bytes are no characters.
    """
    whole = F.contains(text, F.lit("```")) | ~F.is_valid_utf8(text)
    return F.when(whole, text).otherwise(F.regexp_extract(text, REACHED, 0))


def normalized_whole(text: Column) -> Column:
    """All steps, looked for everywhere."""
    kept = F.regexp_extract_all(text, held_back(text), F.lit(0))
    out = F.regexp_replace(text, held_back(text), F.lit(HOLE))
    for step in STEPS.values():
        out = widen_free(out) if step is widen else step(out)
    return woven(F.split(out, HOLE, -1), kept)


def normalized(text: Column) -> Column:
    """All steps, protected parts left as they are. They are looked for as far as they can reach; the rest stays as it is."""
    head = reached(text)
    return F.concat(normalized_whole(head), F.substring(text, F.length(head) + F.lit(1), F.length(text)))


def protected_tokens(text: Column) -> Column:
    """Code, addresses, mail, versions, grouped numbers and times, each once, by kind and then by place."""
    kinds = ["(?U)(?s:```.*?```)", *(f"(?U){p}" for p in PARTS[1:]), *(f"(?U){p}" for p in TOKENS)]
    return F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(k), 0) for k in kinds])))


def tokens_preserved(before: Column, after: Column) -> Column:
    return F.forall(protected_tokens(before), lambda t: F.contains(after, t))
