"""Rule rewriting in canonical mode: of the matches of one pattern the leftmost, and of those the longest, is taken.

Deletions and fixed replacements are plain Columns (`deleted`, used one by one); the whole rewrite works on
spans that depend on one another and runs as an Arrow UDF. Line breaks are kept by two private-use characters
that the text itself does not hold.

A rule runs only where a word that all its matches hold is in the text. A pattern that spans from an opening to
a closing is tried only at openings that have their closing ahead, which is looked up in sorted places: an
opening without one costs a search in a list, not a scan to the end of the text.
"""

from __future__ import annotations

import functools
import itertools
import re
from bisect import bisect_left
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tonewright.functions import fixed_values as V
from tonewright.functions import rewrite_values as R
from tonewright.functions.text import computed_once, has, java, needed, stripped
from tonewright.operators.scene import with_guess

ANY_CASE, WHOLE = re.I, re.I | re.S
#: A sentence's rest: up to and with its end.
REST_ZH, REST_EN = r"[^。！？\n]*[。！？\n]?", r"[^.!?\n]*[.!?\n]?"


def longest_first(patterns: list[str]) -> str:
    """One alternation; plain words before those they begin with."""
    return "|".join(sorted(patterns, key=len, reverse=True))


def deleted(text: Column, pattern_id: str) -> Column:
    """The text without what one deleting pattern matches."""
    flags = "(?s)" if pattern_id == "p22" else ""
    return F.regexp_replace(text, F.lit(flags + java(longest_first(R.DELETED[pattern_id]), True)), F.lit(""))


def after_last(word: str, text: str) -> str:
    return text.rsplit(word, 1)[-1].strip()


def reversal(m: re.Match) -> str:
    """not X but Y, in Chinese: keep what Y is."""
    return ("是" + m[0].partition("而是")[2]).strip()


def both_halves(m: re.Match) -> str:
    """not only X, also Y, in Chinese: both halves without their connectors."""
    bare = m[0][len(m[1]) :]
    halves = re.split("也|而且|又", bare, maxsplit=1)
    return "".join(halves).strip("，, ")


def joined_halves(m: re.Match) -> str:
    """not only X but also Y: X and Y. both X and Y: the tail."""
    if m["only"]:
        halves = [h.strip() for h in (m["first"], m["second"])]
        return " and ".join(h for h in halves if h)
    return m["tail"].strip()


def last_clause(m: re.Match) -> str:
    """A symmetric filler: its last clause without connectors."""
    if "，" not in m[0]:
        return ""
    clause = m[0].rsplit("，", 1)[1]
    for word in R.CONNECTORS:
        clause = clause.replace(word, "").strip()
    return clause.strip("，。").strip()


def english_filler(m: re.Match) -> str:
    """Both hands without their frames; else what stands after but also, or after and."""
    whole = m[0]
    bare = lambda s: re.sub(r"^[，,。.\s]+", "", s).strip()
    hands = re.split(r"on\s+the\s+other\s+hand", whole, maxsplit=1, flags=re.I)
    if "on the other hand" in whole.lower() and len(hands) == 2:
        first = bare(re.sub(r"^on\s+one\s+hand\s*[,.]?\s*", "", hands[0].strip(), flags=re.I))
        return " ".join(filter(None, (first, bare(hands[1]))))
    found = re.search(r"but\s+also", whole, re.I) or re.search(r"\band\b", whole, re.I)
    return bare(whole[found.end() :].strip()) if found else ""


def staged(m: re.Match) -> str:
    """We need to X. We should Y. Z: one sentence."""
    steps = [s.strip() for s in m.groups() if s]
    steps[0] = steps[0][:1].upper() + steps[0][1:]
    steps[1:] = [re.sub(r"^(?:We should|We can|We)\s+", "", s, flags=re.I).strip() for s in steps[1:]]
    if steps[-1] and not steps[-1].lower().startswith("then"):
        steps[-1] = "then " + steps[-1]
    at = m.start() - 1
    while at >= 0 and m.string[at].isspace():
        at -= 1
    return ("" if at >= 0 and m.string[at] == "。" else " ") + ", ".join(steps) + "."


class Rule:
    """A pattern and what replaces its matches. Not tried on texts without a word that every match holds."""

    def __init__(self, pattern: str, by: str | Callable[[re.Match], str], flags: int = 0):
        self.expression, self.by = re.compile(pattern, flags), by
        fold = bool(flags & re.I)
        self.folded = fold and java(pattern, True) != java(pattern, False)
        self.words = needed(pattern, fold)

    def possible(self, text: str, lowered: Callable[[], str]) -> bool:
        held = lowered() if self.folded else text
        return not self.words or any(w in held for w in self.words)

    def apply(self, text: str) -> str:
        return self.expression.sub(self.by, text)


class Spanning(Rule):
    """A pattern from an opening to a closing. ways: its openings with the closings that have to follow, each the

    first such place after what went before, without a character of `stop` between. Matches are those of the pattern.
    """

    def __init__(self, pattern: str, by: str | Callable[[re.Match], str], flags: int, ways: list[tuple[str, str, list[str]]]):
        super().__init__(pattern, by, flags)
        self.ways = [(re.compile(head, flags), re.compile(f"[{re.escape(stop)}]") if stop else None, [re.compile(c, flags) for c in closings]) for head, stop, closings in ways]

    def starts(self, text: str) -> list[int]:
        """Openings whose closings are ahead."""
        found = set()
        for head, stop, closings in self.ways:
            heads = [m.span() for m in head.finditer(text)]
            if not heads:
                continue
            stops = [m.start() for m in stop.finditer(text)] if stop else []
            places = [[m.span() for m in c.finditer(text)] for c in closings]
            begins = [[a for a, _ in p] for p in places]
            for start, at in heads:
                for place, begin in zip(places, begins, strict=True):
                    n = bisect_left(begin, at)
                    barred = bisect_left(stops, at)
                    if n == len(place) or (barred < len(stops) and stops[barred] < begin[n]):
                        break
                    at = place[n][1]
                else:
                    found.add(start)
        return sorted(found)

    def apply(self, text: str) -> str:
        out, end = [], 0
        for start in self.starts(text):
            if start >= end and (m := self.expression.match(text, start)):
                out += [text[end:start], self.by(m) if callable(self.by) else m.expand(self.by)]
                end = m.end()
        return "".join([*out, text[end:]]) if out else text

    def cut_out(self, text: str, left: str, right: str) -> tuple[str, list[str]]:
        """The text with numbers between two marks for its matches, and the matches."""
        held: list[str] = []
        out, end = [], 0
        for start in self.starts(text):
            if start >= end and (m := self.expression.match(text, start)):
                out += [text[end:start], f"{left}{len(held)}{right}"]
                held.append(m[0])
                end = m.end()
        return "".join([*out, text[end:]]), held


#: A literal, a run up to a closing, the closing: 让我们[^。]*?[，,].
UP_TO = re.compile(r"(?P<head>[^\[(\\]+?\??[^\[(\\]*)\[\^(?P<stop>[^\]]+)\]\*\??(?P<closing>\[[^\]]+\]|\\\.)")


def way(pattern: str) -> tuple[str, str, list[str]]:
    """How one alternative of a removal spans: plain ones open and need no closing."""
    found = UP_TO.fullmatch(pattern)
    return (found["head"], found["stop"], [found["closing"]]) if found else (pattern, "", [])


@functools.lru_cache(4096)
def alternation(patterns: tuple[str, ...], flags: int) -> re.Pattern:
    return re.compile("|".join(patterns), flags)


class Alternatives(Rule):
    """Removals in one alternation. On a text only those are tried of which it holds a word that all their matches hold."""

    def __init__(self, patterns: list[str], flags: int):
        super().__init__(longest_first(patterns), "", flags)
        self.flags = flags
        self.branches = [(p, needed(p, bool(flags & re.I))) for p in sorted(patterns, key=len, reverse=True)]
        self.words = tuple({w for _, words in self.branches for w in words}) if all(words for _, words in self.branches) else ()

    def apply(self, text: str) -> str:
        held = text.lower() if self.folded else text
        tried = tuple(p for p, words in self.branches if not words or any(w in held for w in words))
        return alternation(tried, self.flags).sub("", text) if tried else text


def removal(patterns: list[str], flags: int = ANY_CASE) -> Rule:
    ways = [way(p) for p in patterns]
    return Spanning(longest_first(patterns), "", flags, ways) if any(closings for *_, closings in ways) else Alternatives(patterns, flags)


def ordered(patterns: list[str], flags: int = 0) -> list[Rule]:
    """Removals one after another, where the order of the list matters."""
    return [removal([p], flags) for p in patterns]


#: Patterns of which something stays, in the chain and alone.
REVERSAL_ZH = f"(?:(?:不是|并非)[^，,。]*?[，,]\\s*而是|不是[^，,。]*?而是){REST_ZH}"
REVERSAL_EN = rf"(?:not\s+(?:just\s+)?[^,]*?,\s*but\s+|not\s+(?!only\s)[^,]*?\s+but\s+(?!also))({REST_EN})"
IMBALANCE_ZH = f"(?:一方面|不仅)[^，,。]*?[，,]\\s*更重要的是({REST_ZH})"
IMBALANCE_EN = rf"not (?:only|just)[^,]*?,\s*but more importantly({REST_EN})"
COORDINATION_ZH = f"(?:既[^，,。]*?[，,]\\s*(?:又|而且)|(?:不仅|不但)[^，,。]*?[，,]\\s*(?:而且|也)){REST_ZH}"
COORDINATION_EN = rf"(not only)\s+([^,]+?)\s+but also\s+({REST_EN})|both\s+[^,]+?\s+and\s+({REST_EN})"
CROSS_SENTENCE = {"but also": r"not only\s+[\s\S]*?\s+but also\s+[\s\S]*?[.!?]", "also": r"not only\s+[\s\S]*?\s+also\s+[\s\S]*?[.!?]"}

#: Ways of the patterns that span further than a removal: openings, what must not come between, closings.
CLAUSE = "，,。"
WAYS = {
    "reversal_zh": [("不是|并非", CLAUSE, [r"[，,]\s*而是"]), ("不是", CLAUSE, ["而是"])],
    "reversal_en": [(r"not\s", ",", [r",\s*but\s"]), (r"not\s", ",", [r"(?<=\s)but\s"])],
    "lists": [
        ("第[一二三四五]点[是为：:]", "", []), ("第[一二三四五]项[是为：:]", "", []), (r"point\s+\d+[：:]", "", []), ("首先[，,]", "", ["其次[，,]", "最后|第三"]),
        ("first[ly]?[，,]", "", ["second[ly]?[，,]", "finally|third"]), (r"1[.)]\s", "", [r"2[.)]\s", r"3[.)]\s"]),
    ],
    "一方面[^。]*另一方面[^。]*": [("一方面", "。", ["另一方面"])],
    "既[^。]*又[^。]*": [("既", "。", ["又"])],
    "不仅[^。]*而且[^。]*": [("不仅", "。", ["而且"])],
    "虽然[^。]*但[^。]*[^。]*": [("虽然", "。", ["但"])],
    r"On one hand[\s\S]*?on the other hand[\s\S]*?[。.]": [("On one hand", "", ["on the other hand", "[。.]"])],
    r"not only[^.]*but also[^.]*": [("not only", ".", ["but also"])],
    r"both[^.]*and[^.]*": [("both", ".", ["and"])],
}


def symmetric(patterns: list[str], by: Callable[[re.Match], str]) -> list[Rule]:
    return [Spanning(p, by, re.I, WAYS[p]) if p in WAYS else Rule(p, by, re.I) for p in patterns]


def plainer(m: re.Match) -> str:
    return R.PLAIN_ZH.get(m[0]) or R.PLAIN_EN[m[0].lower()]


def steps() -> list[Rule]:
    """The rules in the order they apply."""
    second = lambda m: m[1].strip()
    chain: list[Rule] = [
        Spanning(REVERSAL_ZH, reversal, re.I, WAYS["reversal_zh"]),
        Spanning(REVERSAL_EN, second, re.I, WAYS["reversal_en"]),
        *(removal(R.DELETED[p]) for p in ("p02", "p03", "p04", "p06")),
        Spanning(IMBALANCE_ZH, second, re.I, [("一方面|不仅", CLAUSE, [r"[，,]\s*更重要的是"])]),
        Spanning(IMBALANCE_EN, second, re.I, [("not (?:only|just)", ",", [r",\s*but more importantly"])]),
        removal(R.DELETED["p08"]),
        removal(R.DELETED["p09"]),
        removal(R.ORDINALS_ZH),
        Rule(f"(?:{longest_first(R.ORDINALS_EN)})([,，])?", lambda m: "," if m[1] else "", re.I),
        *(removal(R.DELETED[p]) for p in ("p11", "p12", "p13")),
        Rule("|".join(f"{v}(?=(?:{nouns}))" for v, nouns in R.VERBS.items()), ""),
        removal(R.NOUN_PHRASES_EN),
        removal(R.DELETED["p15"]),
        removal(R.DELETED["p16"]),
        Rule(longest_first(list(R.PLAIN_ZH)) + r"|\b(?:" + longest_first(list(R.PLAIN_EN)) + r")\b", plainer, re.I),
        removal(R.DELETED["p19"]),
        Spanning(
            f"(?=(既|不仅|不但))(?:既[^，,。]*?[，,]\\s*(?:又|而且)|(?:不仅|不但)[^，,。]*?[，,]\\s*(?:而且|也)){REST_ZH}", both_halves, 0,
            [("既", CLAUSE, [r"[，,]\s*(?:又|而且)"]), ("不仅|不但", CLAUSE, [r"[，,]\s*(?:而且|也)"])],
        ),
        Spanning(
            rf"(?P<only>not only)\s+(?P<first>[^,]+?)\s+but also\s+(?P<second>{REST_EN})|both\s+[^,]+?\s+and\s+(?P<tail>{REST_EN})", joined_halves, re.I,
            [(r"not only\s", ",", [r"(?<=\s)but also\s"]), (r"both\s", ",", [r"(?<=\s)and\s"])],
        ),
        removal(R.DELETED["p21"]),
        Spanning(longest_first(R.DELETED["p22"]), "", WHOLE, WAYS["lists"]),
        removal(R.DELETED["p24"]),
        Spanning(rf"(?:{R.ENGLISH_SUBJECTS})\s+([^。]*?[。！])", r"系统\1", re.I, [(rf"(?:{R.ENGLISH_SUBJECTS})\s", "", ["[。！]"])]),
        *ordered([re.escape(w) for w in V.TIER1_ZH]),
        *ordered([re.escape(w.rstrip(".,;:!?")) for w in V.TIER1_EN], re.I),
        *ordered(V.MECHANICAL),
        *symmetric(V.SYMMETRY, last_clause),
        *symmetric(V.SYMMETRY_EN, english_filler),
        Spanning(CROSS_SENTENCE["but also"], lambda m: after_last("but also", m[0]), re.I, [(r"not only\s", "", [r"(?<=\s)but also\s", "[.!?]"])]),
        Spanning(CROSS_SENTENCE["also"], lambda m: after_last("also", m[0]), re.I, [(r"not only\s", "", [r"(?<=\s)also\s", "[.!?]"])]),
        *ordered(V.CLOSERS + V.CLOSERS_EN + V.ABSTRACT_SUBJECTS + V.ABSTRACT_SUBJECTS_EN + V.CONNECTORS_EN + V.IDIOMS + V.DENSITY + V.MODIFIERS),
        *(Rule(blank_led(p), by) for p, by in R.LEFTOVERS),
    ]
    return chain


def blank_led(pattern: str) -> str:
    """A pattern led by blanks starts where they begin, not at each of them."""
    return r"(?:(?<!\s)\s+|(?<!\s))" + pattern.removeprefix(r"\s*") if pattern.startswith(r"\s*") else pattern


# --- fixed values: clean-up patterns that results depend on ---

WORD = "a-zA-Z0-9一-鿿"
RESIDUE = [
    Rule(p, by)
    for p, by in (
        ("，{2,}", "，"), ("。{2,}", "。"), ("…{2,}", "…"), (r"\s+", " "), (r"^[，,。！？\s]+", ""),
        (f"(?<![{WORD}])[是的](?![{WORD}])", ""), ("的、", "的"), ("(?<=系统性)的", ""), ("(?<=全面)的", ""),
        (f"(?<![{WORD}])、", ""), (f"、(?![{WORD}])", ""), ("、的", ""), (f"(?<![{WORD}])，(?![{WORD}])", ""),
    )
]
#: After an end mark; after a full stop that is not inside a number, a version or an abbreviation.
BETWEEN = re.compile(r"(?<=[。！？!?])|(?<=\.)(?= )|(?<=\.)(?<![A-Za-z0-9]\.)(?![A-Za-z0-9 ])|(?<= \.)(?=[A-Za-z0-9])")
STAGED = [
    Spanning(r"\s*\b(We need to .*?)[.]\s*(\w.+?)[.]\s*(.+?)(?:[.]|$)", staged, re.I, [(r"(?:(?<!\s)\s+|(?<!\s))\bWe need to ", "\n", [r"[.]\s*\w", "[.]"])]),
    Spanning(r"\s*\b(We need to .*?)[.]\s*(\w.+?)(?:[.]|$)", staged, re.I, [(r"(?:(?<!\s)\s+|(?<!\s))\bWe need to ", "\n", [r"[.]\s*\w"])]),
]
FINAL = [Rule(p, by) for p, by in (("。{2,}", "。"), (r"\.{2,}", "."), (r"^[，,。！？\s]+", ""))]
AFTER_MARK = re.compile(r"([，。！？、：；）」』】…])[ \t]+(?=[^ \t])")

# --- the chain ---

STEPS = steps()


def applied(text: str, chain: list[Rule]) -> str:
    folded: list[str] = []

    def lowered() -> str:
        if not folded:
            folded.append(text.lower())
        return folded[0]

    for rule in chain:
        if rule.possible(text, lowered) and (made := rule.apply(text)) != text:
            text = made
            folded.clear()
    return text


def merged(text: str) -> str:
    """Sentences trimmed and joined by one blank, staged run-ups made one sentence."""
    parts = (re.sub(r"^[，,]\s*", "", p.strip()).strip() for p in BETWEEN.split(text))
    return applied(re.sub(r" ([，。！？.!?])", r"\1", " ".join(p for p in parts if p)), STAGED)


#: Breaks with the blanks around them; a run of blanks is looked at once.
EMPTY_LINES = re.compile(r"(?:(?<![ \t])[ \t]+)?\n[ \t]*\n+[ \t]*")
LINE_END = re.compile(r"(?:(?<![ \t])[ \t]+)?\n[ \t]*")


def stand_ins(text: str, count: int) -> list[str]:
    """Private-use characters that the text does not hold."""
    held = set(re.findall("[\ue000-\uf8ff\U000f0000-\U000ffffd]", text))
    free = (c for c in map(chr, itertools.chain(range(0xE000, 0xF900), range(0xF0000, 0xFFFFE))) if c not in held)
    return [next(free) for _ in range(count)]


@functools.lru_cache(64)
def around(mark: str) -> re.Pattern:
    return re.compile(rf"(?:(?<!\s)\s+)?{re.escape(mark)}\s*")


def rewrite(text: str | None) -> str:
    """One text rewritten by all rules; null is empty."""
    text = text or ""
    paragraph, line = stand_ins(text, 2)
    text = LINE_END.sub(line, EMPTY_LINES.sub(paragraph, text))
    text = applied(merged(applied(applied(text, STEPS), RESIDUE)), FINAL)
    return AFTER_MARK.sub(r"\1", around(line).sub("\n", around(paragraph).sub("\n\n", text))).strip()


@F.pandas_udf(StringType())
def rewritten(texts: pd.Series) -> pd.Series:
    return texts.map(rewrite)


def whitelisted(text: Column, golden: list[str]) -> Column:
    """Is the text, without white space at its ends, one of the golden inputs?"""
    return F.coalesce(stripped(text).isin([g.strip() for g in golden]), F.lit(False))


MARKDOWN_KEPT = re.compile(r"\s*(?:#{1,6}\s|\||!\[[^\]]*\]\([^)]*\)\s*$|(?:[-*_]\s*){3,}$)|\s*$")
INLINE_KEPT = Spanning(
    r"`[^`\n]+`|!?\[[^\]]*\]\([^)]*\)|https?://[^\s)]+", "", 0, [("`", "\n", ["`"]), (r"!?\[", "]", [r"\]\(", r"\)"]), ("https?://", "", [])],
)


def rewrite_markdown(text: str | None) -> str:
    """Line by line: fences, headings, rules, tables and pictures stay; inline code, links and addresses are held back."""
    out, fence = [], ""
    for line in (text or "").split("\n"):
        mark = re.match(r"\s*(```+|~~~+)", line)
        if mark or fence:
            if mark and not fence:
                fence = mark[1][:3]
            elif mark and mark[1].startswith(fence):
                fence = ""
            out.append(line)
        elif MARKDOWN_KEPT.match(line):
            out.append(line)
        else:
            # The first two unused characters are those of line breaks, of which there are none in a line.
            left, right = stand_ins(line, 4)[2:]
            bare, held = INLINE_KEPT.cut_out(line, left, right)
            lead = re.match(r"\s*(?:[-*+]\s+|\d+[.)]\s+|>\s*)?", bare)[0]
            out.append(lead + re.sub(f"{left}([0-9]+){right}", lambda m, held=held: held[int(m[1])], rewrite(bare[len(lead) :])))
    return "\n".join(out)


def with_rewrite(df: DataFrame, text: str = "text", scene: str = "base", golden: list[str] | None = None) -> DataFrame:
    """Adds rewritten and changed. The scene is kept for the interface; rules do not depend on it.

    golden: inputs that alone may be rewritten (the strict whitelist); all may, if it is not given.
    """
    del scene
    whole = F.coalesce(F.col(text), F.lit(""))
    out = rewritten(whole if golden is None else F.when(whitelisted(whole, golden), whole).otherwise(F.lit("")))
    df = computed_once(df.withColumn("__out", out), rewritten=F.col("__out") if golden is None else F.when(whitelisted(whole, golden), F.col("__out")).otherwise(whole)).drop("__out")
    return df.withColumn("changed", F.col("rewritten") != whole)


def with_scene_rewrite(df: DataFrame, text: str = "text", path: str = "path") -> DataFrame:
    """Files rewritten by the scene of each: adds output, scene, scene_confidence, needs_confirmation, guessed_scene, scene_evidence, changed."""
    keep = df.columns
    df = with_rewrite(with_guess(df, "__guess", text, path), text)
    g = F.col("__guess")
    return df.select(
        *keep, F.col("rewritten").alias("output"), g["scene"].alias("scene"), F.round(g["confidence"], 3).alias("scene_confidence"), g["needs_confirmation"].alias("needs_confirmation"),
        F.when(g["needs_confirmation"], g["guessed_scene"]).alias("guessed_scene"), g["evidence"].alias("scene_evidence"), "changed",
    )


# --- single patterns as Columns ---


def ordinals_deleted(text: Column) -> Column:
    """p10: Chinese ordinals go; English ones go but for a comma after them."""
    text = F.regexp_replace(text, F.lit(longest_first(R.ORDINALS_ZH)), F.lit(""))
    text = F.regexp_replace(text, F.lit(java(f"(?:{longest_first(R.ORDINALS_EN)})[,，]", True)), F.lit(","))
    # A marker keeps commas just left behind from being looked at again: the second pass takes bare ordinals only.
    return F.regexp_replace(text, F.lit(java(f"(?:{longest_first(R.ORDINALS_EN)})", True)), F.lit(""))


def verbs_freed(text: Column) -> Column:
    """p14 in Chinese: the light verb goes, the verb stays."""
    for light, verbs in R.VERBS.items():
        text = F.regexp_replace(text, F.lit(f"{light}({verbs})"), F.lit("$1"))
    return text


def plain_words(text: Column) -> Column:
    """p17: formal words by plain ones."""
    for formal, plain in R.PLAIN_ZH.items():
        text = F.replace(text, F.lit(formal), F.lit(plain))
    for formal, plain in R.PLAIN_EN.items():
        text = F.regexp_replace(text, F.lit(java(rf"\b{formal}\b", True)), F.lit(plain))
    return text


def subjects_replaced(text: Column) -> Column:
    """p26: an English subject of a Chinese sentence becomes a Chinese one."""
    return F.regexp_replace(text, F.lit(java(rf"(?:{R.ENGLISH_SUBJECTS})\s+([^。]*?[。！])", True)), F.lit("系统$1"))


def chain_deleted(text: Column, patterns: list[str]) -> Column:
    """Patterns deleted one after another, case counts."""
    for p in patterns:
        text = F.regexp_replace(text, F.lit(java(p)), F.lit(""))
    return text


LISTED_DELETIONS = V.CLOSERS + V.CLOSERS_EN + V.ABSTRACT_SUBJECTS + V.ABSTRACT_SUBJECTS_EN + V.CONNECTORS_EN + V.IDIOMS + V.DENSITY + V.MODIFIERS


def leftovers_cleaned(text: Column) -> Column:
    for pattern, by in R.LEFTOVERS:
        text = F.regexp_replace(text, F.lit(java(pattern)), F.lit(by))
    return text


def finally_cleaned(text: Column) -> Column:
    for pattern, by in (("。{2,}", "。"), (r"\.{2,}", "."), (r"\A[，,。！？\s]+", "")):
        text = F.regexp_replace(text, F.lit(java(pattern)), F.lit(by))
    return text


# --- patterns whose replacement follows from the match, as Columns ---


def each_replaced(text: Column, pattern: str, change: Callable[[Column], Column], ignore_case: bool = False) -> Column:
    """The text with every match of a pattern changed. Texts without a word that every match holds are not searched."""
    regex = F.lit(java(pattern, ignore_case))
    pairs = F.arrays_zip(F.split(text, regex, -1).alias("gap"), F.regexp_extract_all(text, regex, F.lit(0)).alias("hit"))
    woven = F.flatten(F.transform(pairs, lambda x: F.array(F.coalesce(x["gap"], F.lit("")), F.coalesce(change(x["hit"]), F.lit("")))))
    return F.when(has(text, pattern, ignore_case), F.array_join(woven, "")).otherwise(text)


def group_kept(pattern: str, group: int, ignore_case: bool = False) -> Callable[[Column], Column]:
    """Of a match one group, trimmed."""
    return lambda m: stripped(F.regexp_extract(m, java(pattern, ignore_case), group))


def dropped_up_to(match: Column, pattern: str, ignore_case: bool = False) -> Column:
    """What stands after the first place of a pattern."""
    return F.regexp_replace(match, F.lit(java(rf"(?s)\A.*?(?:{pattern})", ignore_case)), F.lit(""))


def filled(parts: list[Column], between: str) -> Column:
    """The parts that are not empty, joined."""
    return F.array_join(F.filter(F.array(*parts), lambda p: p != ""), between)



def reversals_zh(text: Column) -> Column:
    """p01 in Chinese: what the thing is stays."""
    return each_replaced(text, REVERSAL_ZH, lambda m: stripped(F.concat(F.lit("是"), dropped_up_to(m, "而是"))), True)


def reversals_en(text: Column) -> Column:
    """p01 in English: what stands after but stays."""
    return each_replaced(text, REVERSAL_EN, group_kept(REVERSAL_EN, 1, True), True)


def imbalances(text: Column) -> Column:
    """p07: what is said to matter more stays."""
    for pattern in (IMBALANCE_ZH, IMBALANCE_EN):
        text = each_replaced(text, pattern, group_kept(pattern, 1, True), True)
    return text


def coordinations_zh(text: Column) -> Column:
    """p20 in Chinese: both halves without their connectors."""
    def change(m: Column) -> Column:
        bare = F.regexp_replace(m, F.lit(r"\A(?:既|不仅|不但)"), F.lit(""))
        return F.btrim(F.regexp_replace(bare, F.lit(r"(?s)\A(.*?)(?:也|而且|又)"), F.lit("$1")), F.lit("，, "))
    return each_replaced(text, COORDINATION_ZH, change)


def coordinations_en(text: Column) -> Column:
    """p20 in English: not only X but also Y becomes X and Y; of both X and Y the tail stays."""
    def change(m: Column) -> Column:
        first, second, tail = (group_kept(COORDINATION_EN, n, True)(m) for n in (2, 3, 4))
        only = F.startswith(F.lower(m), F.lit("not only"))
        return F.when(only, filled([first, second], " and ")).otherwise(tail)
    return each_replaced(text, COORDINATION_EN, change, True)


def symmetry_collapsed(text: Column) -> Column:
    """Chinese symmetric fillers: the last clause without connectors; nothing of one without clauses."""
    def change(m: Column) -> Column:
        clause = F.substring_index(m, "，", -1)
        for word in R.CONNECTORS:
            clause = stripped(F.replace(clause, F.lit(word), F.lit("")))
        return F.when(F.contains(m, F.lit("，")), stripped(F.btrim(clause, F.lit("，。")))).otherwise(F.lit(""))
    for pattern in V.SYMMETRY:
        text = each_replaced(text, pattern, change, True)
    return text


def symmetry_collapsed_en(text: Column) -> Column:
    """English symmetric fillers: both hands without their frames, else what stands after but also, or after and."""
    bare = lambda c: stripped(F.regexp_replace(c, F.lit(java(r"\A[，,。.\s]+")), F.lit("")))
    also, conjunction = r"but\s+also", r"\band\b"

    def change(m: Column) -> Column:
        hands = F.split(m, F.lit(java(r"on\s+the\s+other\s+hand", True)), 2)
        first = F.regexp_replace(stripped(F.get(hands, F.lit(0))), F.lit(java(r"\Aon\s+one\s+hand\s*[,.]?\s*", True)), F.lit(""))
        framed = F.contains(F.lower(m), F.lit("on the other hand"))
        tail = F.when(has(m, also, True), bare(dropped_up_to(m, also, True))).when(has(m, conjunction, True), bare(dropped_up_to(m, conjunction, True)))
        return F.when(framed, filled([bare(first), bare(F.get(hands, F.lit(1)))], " ")).otherwise(tail)
    for pattern in V.SYMMETRY_EN:
        text = each_replaced(text, pattern, change, True)
    return text


def cross_sentences(text: Column) -> Column:
    """not only ... but also, or also, over sentences: what stands after the last also stays."""
    for word, pattern in CROSS_SENTENCE.items():
        text = each_replaced(text, pattern, lambda m, w=word: stripped(F.substring_index(m, w, -1)), True)
    return text


def laid_out(text: Column) -> Column:
    """The layout that rewriting keeps: paragraphs parted by one empty line, lines without blanks at their ends."""
    lines = lambda p: stripped(F.regexp_replace(p, F.lit(LINE_END.pattern), F.lit("\n")))
    return stripped(F.array_join(F.transform(F.split(text, F.lit(EMPTY_LINES.pattern), -1), lines), "\n\n"))


def residue_cleaned(text: Column) -> Column:
    """Doubled marks, runs of white space and particles that deletions left alone."""
    for rule in RESIDUE:
        text = F.regexp_replace(text, F.lit(java(rule.expression.pattern)), F.lit(rule.by))
    return text


def sentences_joined(text: Column) -> Column:
    """Sentences trimmed, without a comma before them, joined by one blank; none before an end mark."""
    parts = F.transform(F.split(text, F.lit(java(BETWEEN.pattern)), -1), lambda p: stripped(F.regexp_replace(stripped(p), F.lit(java(r"\A[，,]\s*")), F.lit(""))))
    return F.regexp_replace(F.array_join(F.filter(parts, lambda p: p != ""), " "), F.lit(" ([，。！？.!?])"), F.lit("$1"))
