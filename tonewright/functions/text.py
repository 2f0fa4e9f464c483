"""Column building blocks: one regular-expression dialect, spans, counts.

Patterns are written once (`fixed_values`) and run by Java with Unicode classes (`\\s`, `\\d`, `\\w`) and with `.`
stopping at line feeds only. Every pattern is a literal: a pattern in a column would be compiled again a row.

Most texts hold nothing of what most patterns look for. Every match of a pattern holds one of a few literals, which
`needed` reads from the pattern; a search for bytes tells whether the pattern has to be run at all.
"""

from __future__ import annotations

import functools
import re
import re._constants as kinds
import re._parser as parser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A lazy run before the needle makes every failed start rescan the sentence. A match can only start where the
#: one before ended or after a full stop, which this look-around says first; matches stay the same.
SENTENCE_START = r"(?:\G|(?<=。))"
LAZY_HEAD = "[^。]*?"


#: Java recurses a level for each turn of a group, and a text of thousands of turns ends in a stack overflow. It turns
#: possessive groups in a loop. No group that is repeated without end here can give back a turn that what follows takes.
ENDLESS_GROUP = re.compile(r"(?<=(?<!\\)\))([*+])(?![*+?])")
MOST_LITERALS = 24


def java(pattern: str, ignore_case: bool = False) -> str:
    """The pattern in Java's dialect, with the flags all patterns have."""
    pattern = ENDLESS_GROUP.sub(r"\1+", pattern)
    if pattern.startswith(LAZY_HEAD):
        pattern = SENTENCE_START + pattern
    # Only the flags that can make a difference: folding case or classes costs time at every character.
    plain = re.sub(r"\\(?:x\{[0-9a-fA-F]+\}|.)", "", pattern)
    flags = ("i" if ignore_case and re.search("[A-Za-zäöüßéèàçñ]", plain) else "") + ("U" if re.search(r"\\[sSdDwWbB]", pattern) else "") + ("d" if re.search(r"[.^$]", plain) else "")
    if "i" in flags and "U" not in flags:
        flags += "u"
    return f"(?{flags})" + pattern if flags else pattern


def best(choices: list[set[str] | None]) -> set[str] | None:
    """The set whose words are longest, few words counting as long ones; of equal ones one without marks that every text holds."""
    known = [c for c in choices if c and all(c) and len(c) <= MOST_LITERALS]
    return max(known, key=lambda c: (min(len(w.encode()) for w in c) - 0.1 * len(c), not c & {".", ","}), default=None)


#: Characters beyond ASCII that patterns in any case take for ASCII letters (s, i, i, k).
FOLDING = "\u017f\u0131\u0130\u212a"


def literals(items, folded: bool, plain: bool = False) -> set[str] | None:
    """Words of which every match of a parsed pattern holds one; None if there are no such words. plain: in texts without `FOLDING`."""
    choices: list[set[str] | None] = []
    run = ""
    for kind, value in [*items, (None, None)]:
        if kind is kinds.LITERAL:
            run += chr(value)
            continue
        if run:
            # Letters that more than one other character folds to are no part of a folded word.
            parts = re.split("[iksIKS]", run) if folded and not plain else [run]
            choices.append({max(parts, key=len).lower() if folded else run})
            run = ""
        if kind is kinds.SUBPATTERN:
            choices.append(literals(value[3], folded, plain))
        elif kind is kinds.BRANCH:
            each = [literals(x, folded, plain) for x in value[1]]
            choices.append(None if None in each else set().union(*each))
        elif kind in (kinds.MAX_REPEAT, kinds.MIN_REPEAT, kinds.POSSESSIVE_REPEAT) and value[0]:
            choices.append(literals(value[2], folded, plain))
        elif kind is kinds.IN and not folded and all(k is kinds.LITERAL for k, _ in value):
            choices.append({chr(c) for _, c in value})
    return best(choices)


def parsed(pattern: str):
    return parser.parse(re.sub(r"\\x\{([0-9a-fA-F]+)\}", lambda m: re.escape(chr(int(m[1], 16))), pattern))


@functools.cache
def needed(pattern: str, ignore_case: bool = False, plain: bool = False) -> tuple[str, ...]:
    """Words of which every match holds one, in lower case if case is ignored; none if there are no such words. plain: in texts without `FOLDING`."""
    folded = "i" in java(pattern, ignore_case).partition(")")[0] if java(pattern, ignore_case).startswith("(?") else False
    return tuple(sorted(literals(parsed(pattern), folded, plain) or ()))


def fixed_array(values: list[str] | list[tuple[str, ...]]) -> Column:
    """A literal array of strings, or of structs with fields a, b, ... of strings."""
    quoted = lambda v: "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    made = [quoted(v) if isinstance(v, str) else "named_struct(" + ", ".join(f"'{name}', {quoted(x)}" for name, x in zip("abc", v, strict=False)) + ")" for v in values]
    return F.expr(f"array({', '.join(made)})")


def holds_one(text: Column, words) -> Column:
    """Does the text hold one of the words, byte by byte?"""
    words = list(words)
    if len(words) > 3:
        return F.exists(fixed_array(words), lambda w: F.contains(text, w))
    return functools.reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


#: Words of characters from here on are looked for in what is left of a text without all others.
FIRST_WIDE = 0x2000
FIRST_WIDE_BYTE = chr(FIRST_WIDE).encode()[0]


def wide(word: str) -> bool:
    return all(ord(c) >= FIRST_WIDE for c in word)


def wide_runs(text: Column) -> Column:
    """Runs of wide characters, parted by line feeds: a wide word is in them if it is in the text."""
    return F.regexp_replace(text, F.lit(rf"[\x00-\x{{{FIRST_WIDE - 1:x}}}]+"), F.lit("\n"))


#: Letters of English text from the most to the least frequent.
FREQUENT = " etaoinshrdlcumwfgypbvk"


def rare_end(word: str) -> str:
    """The word in lower case from its least frequent character on, three characters at least: a search for it stops at few places."""
    low = word.lower()
    return low[max(range(max(len(low) - 2, 1)), key=lambda i: FREQUENT.find(low[i]) % (len(FREQUENT) + 1)) :]


class Held(NamedTuple):
    """Where words are looked for instead of in a whole text: listed wide words that it holds, and the text as it stands and in lower case.

    lowered: unless `odd`, only the listed ASCII words that the text holds in any case. odd: does it hold a character that only folding takes
    for an ASCII letter? near: the text as far as a match can reach that holds a wide word and is no longer than `REACH`.
    """

    wide: Column
    narrow: Column
    lowered: Column
    odd: Column
    near: Column
    listed: frozenset[str]

    def holds(self, text: Column, words, folded: bool = False) -> Column:
        """As `holds_one` of the text; if `folded`, of the text in lower case, and every text that is odd."""
        listed = [w for w in words if w in self.listed]
        others = [w for w in words if w not in self.listed]
        ascii_ = [(w.lower(), w) for w in listed if w.isascii()]
        inside = lambda w: F.contains(self.lowered, w["a"]) & (F.lit(True) if folded else F.contains(self.narrow, w["b"]))
        found = [F.exists(fixed_array(ascii_), inside)] if ascii_ else []
        kinds = [(self.wide, [w for w in listed if not w.isascii()])]
        kinds += [(F.lower(text), others)] if folded else [(self.narrow, [w for w in others if w.isascii()]), (text, [w for w in others if not w.isascii()])]
        found += [holds_one(where, own) for where, own in kinds if own]
        return functools.reduce(lambda a, b: a | b, ([self.odd] if folded else []) + found)


def trie(words: list[str]) -> str:
    """A pattern of the longest of the words at a place. Many first characters are tried by groups of a range of characters."""
    after: dict[str, list[str]] = {}
    for w in words:
        if w:
            after.setdefault(w[0], []).append(w[1:])
    branches = [(c, re.escape(c) + trie(after[c])) for c in sorted(after)]
    if not branches:
        return ""
    groups = [branches[i : i + 12] for i in range(0, len(branches), 12)]
    alone = lambda g: "|".join(b for _, b in g)
    made = "|".join(f"(?=[{re.escape(g[0][0])}-{re.escape(g[-1][0])}])(?:{alone(g)})" for g in groups) if len(groups) > 2 else alone(branches)
    return f"(?:{made})" + ("?" if "" in words else "")


def held_words(text: Column, words) -> Column:
    """What the text holds of the words, parted by line feeds: at each place the longest, of which shorter ones there are the beginning."""
    return F.array_join(F.regexp_extract_all(text, F.lit(f"(?=({trie(sorted(words))}))"), 1), "\n")


class Scan:
    """Of a batch of texts: what of the listed words each holds, in one search of the batch's bytes for all of them."""

    #: As `REACH`; white space of Python is that of Java and four marks more, so this reaches as far at least.
    AFTER = r"(?:\s*+\S){0,%d}+\s*+"
    FIELDS = "wide string, ascii string, odd boolean, near string"

    def __init__(self, words) -> None:
        self.wide: dict[str, list[str]] = {}
        for w in sorted(words):
            if w and wide(w):
                self.wide.setdefault(w[0], []).append(w)
        self.ascii = [w.encode() for w in sorted({w.lower() for w in words if w.isascii() and len(w) > 2})]
        self.any = "|".join(re.escape(w.decode()) for w in self.ascii)
        self.after = re.compile(self.AFTER % REACH)

    def up_to_last_wide(self, text: bytes, last: int) -> str:
        tail = text[last:].decode()
        return text[:last].decode() + tail[: self.after.match(tail, 1).end()]

    def wide_in(self, text: str) -> str:
        return "\n".join([w for c in self.wide.keys() & set(text) for w in self.wide[c] if w in text])

    def __call__(self, texts: pa.Array) -> pa.Array:
        if not len(texts):
            return pa.array([], pa.struct([("wide", pa.string()), ("ascii", pa.string()), ("odd", pa.bool_()), ("near", pa.string())]))
        odd = pc.match_substring_regex(texts, f"[{FOLDING}]")
        texts = texts.cast(pa.large_binary())
        places, data = (np.frombuffer(b or b"", kind) for b, kind in zip(texts.buffers()[1:], (np.int64, np.uint8), strict=True))
        places = places[texts.offset : texts.offset + len(texts) + 1]
        # Only characters from `FIRST_WIDE` on begin with such a byte.
        begun = np.flatnonzero(data[places[0] : places[-1]] >= FIRST_WIDE_BYTE) + places[0]
        before = np.searchsorted(begun, places)
        some = pc.match_substring_regex(texts, self.any, ignore_case=True).to_pylist() if self.any else [False] * len(texts)
        out: list[tuple[str, str, str]] = []
        for i, text in enumerate(texts.to_pylist()):
            near = self.up_to_last_wide(text, int(begun[before[i + 1] - 1] - places[i])) if before[i + 1] > before[i] else ""
            low = text.lower() if some[i] else b""
            out.append((self.wide_in(near), b"\n".join([w for w in self.ascii if w in low]).decode(), near))
        wide_, ascii_, near_ = (pa.array(own, pa.string()) for own in zip(*out, strict=True))
        return pa.StructArray.from_arrays([wide_, ascii_, odd, near_], [f.split()[0] for f in self.FIELDS.split(", ")])


def with_held(df: DataFrame, into: str, text: Column, words=()) -> tuple[DataFrame, Held]:
    """Adds what words are looked for in. One pass of the bytes of Arrow batches finds which of the words are there.

    Without words, these are all wide runs and the whole text in lower case.
    """
    scan = Scan(words)
    df = df.withColumn(into, F.arrow_udf(lambda texts: scan(texts), Scan.FIELDS)(F.coalesce(text, F.lit(""))))
    part = F.col(into)
    found, low = (part["wide"], part["ascii"]) if words else (wide_runs(part["near"]), F.lower(text))
    df = computed_once(df, **{f"{into}_wide": found, f"{into}_low": F.when(part["odd"], F.lower(text)).otherwise(low), f"{into}_odd": part["odd"], f"{into}_near": part["near"]})
    listed = frozenset({*(w for own in scan.wide.values() for w in own), *(w for w in words if w.isascii() and len(w) > 2)})
    return df.drop(into), Held(F.col(f"{into}_wide"), text, F.col(f"{into}_low"), F.col(f"{into}_odd"), F.col(f"{into}_near"), listed)


#: Characters other than white space that a pattern searched up to the last wide word may look at, from where it starts.
REACH = 160


def up_to_last_wide(text: Column) -> Column:
    """The text up to its last wide character and `REACH` visible ones more: no pattern of a shorter reach that needs a wide word looks further."""
    return F.regexp_extract(text, rf"(?U)\A(?:[\x00-\x{{{FIRST_WIDE - 1:x}}}]*+[\x{{{FIRST_WIDE:x}}}-\x{{10ffff}}]++)++(?:\s*+\S){{0,{REACH}}}+\s*+", 0)


def reach(items) -> int | None:
    """How many characters a parsed pattern can look at, white space repeated without end not counted; None if there is no bound."""
    total = 0
    for kind, value in items:
        if kind in (kinds.LITERAL, kinds.NOT_LITERAL, kinds.ANY, kinds.IN):
            own = 1
        elif kind is kinds.SUBPATTERN:
            own = reach(value[3])
        elif kind is kinds.BRANCH:
            each = [reach(x) for x in value[1]]
            own = None if None in each else max(each)
        elif kind in (kinds.MAX_REPEAT, kinds.MIN_REPEAT, kinds.POSSESSIVE_REPEAT):
            one = reach(value[2])
            alone = value[2][0] if len(value[2]) == 1 else (None, None)
            if value[1] is kinds.MAXREPEAT:
                # Wide characters end before the cut; white space is passed over by it.
                ends = alone[0] is kinds.LITERAL and alone[1] >= FIRST_WIDE or alone == (kinds.IN, [(kinds.CATEGORY, kinds.CATEGORY_SPACE)])
                own = 0 if ends else None
            else:
                own = None if one is None else one * value[1]
        elif kind in (kinds.ASSERT, kinds.ASSERT_NOT) and value[0] == 1:
            own = reach(value[1])
        elif kind is kinds.AT and value in (kinds.AT_BEGINNING, kinds.AT_BEGINNING_STRING):
            own = 0
        else:
            own = None
        if own is None:
            return None
        total += own
    return total


@functools.cache
def near_wide(pattern: str, ignore_case: bool = False) -> bool:
    """Does every match hold a wide word, and is a match's end near enough for `up_to_last_wide`?"""
    words = needed(pattern, ignore_case)
    return bool(words) and all(map(wide, words)) and bounded(pattern)


def bounded(pattern: str) -> bool:
    """Is a match that begins before the last wide character over before the cut of `up_to_last_wide`?"""
    far = reach(parsed(pattern))
    return far is not None and far < REACH


def can_match(text: Column, pattern: str, ignore_case: bool = False, held: Held | None = None) -> Column | None:
    """A quick condition that every text with a match meets, if there is one. held: what the text holds, if it is at hand."""
    words = needed(pattern, ignore_case, held is not None)
    if not words:
        return None
    folded = java(pattern, ignore_case) != java(pattern, False)
    if held:
        return held.holds(text, words, folded)
    return holds_one(F.lower(text) if folded else text, words)


def fitting(text: Column, parts: list[tuple[str, list[str]]], flags: str = "", always: str = "(?!)") -> Column:
    """One pattern of the parts that the text can hold, in order, and `always`. parts: patterns, and words of which every match holds one."""
    return F.concat(F.lit(flags), F.concat_ws("|", *[F.when(holds_one(text, words), F.lit(p)) for p, words in parts], F.lit(always)))


NO_TEXTS = "cast(array() as array<string>)"
NO_SPANS = "cast(array() as array<struct<s:int,e:int,t:string>>)"


def reached(text: Column, pattern: str, ignore_case: bool, held: Held | None) -> Column:
    """The text, or as much of it as the pattern can reach, if that is at hand."""
    return text if held is None or not near_wide(pattern, ignore_case) else held.near


def find_all(text: Column, pattern: str, ignore_case: bool = False, group: int = 0, held: Held | None = None) -> Column:
    """All matches, left to right."""
    found = F.regexp_extract_all(reached(text, pattern, ignore_case, held), F.lit(java(pattern, ignore_case)), group)
    able = can_match(text, pattern, ignore_case, held)
    return found if able is None else F.when(able, found).otherwise(F.expr(NO_TEXTS))


def count_matches(text: Column, pattern: str, ignore_case: bool = False) -> Column:
    return F.size(find_all(text, pattern, ignore_case))


def has(text: Column, pattern: str, ignore_case: bool = False, held: Held | None = None) -> Column:
    able = can_match(text, pattern, ignore_case, held)
    found = F.rlike(reached(text, pattern, ignore_case, held), F.lit(java(pattern, ignore_case)))
    return found if able is None else able & found


def replace_all(text: Column, pattern: str, by: str, ignore_case: bool = False) -> Column:
    """Java's replacement syntax: $1 is a group."""
    return F.regexp_replace(text, F.lit(java(pattern, ignore_case)), F.lit(by))


def any_of(text: Column, words: list[str]) -> Column:
    """Does the text hold one of the words? Matched literally; a word that holds a shorter one is not looked for."""
    return holds_one(text, [w for w in words if not any(v != w and v in w for v in words)])


def any_wide(text: Column, words: list[str]) -> Column:
    """As `any_of`, for wide words: they are looked for in the wide runs, which as the only element of an array are made once."""
    return F.transform(F.array(wide_runs(text)), lambda runs: any_of(runs, words))[0]


def present(text: Column, words: list[str]) -> Column:
    """The words that the text holds, in list order."""
    return F.filter(fixed_array(words), lambda w: F.contains(text, w))


def count_word(text: Column, word: str) -> Column:
    """Occurrences that do not overlap."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))) / F.lit(len(word))).cast("int")


def count_characters(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def without_space(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(r"(?U)\s"), F.lit(""))


def stripped(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(F.regexp_replace(text, F.lit(r"(?U)\A\s+"), F.lit("")), F.lit(r"(?U)(?<!\s)\s+\z"), F.lit(""))


def spans(text: Column, pattern: str, ignore_case: bool = False, held: Held | None = None) -> Column:
    """array<struct<s, e, t>> of all matches: half-open code-point offsets and texts."""
    # Most texts have no match; one search tells.
    return F.when(has(text, pattern, ignore_case, held), placed(reached(text, pattern, ignore_case, held), F.lit(java(pattern, ignore_case)))).otherwise(F.expr(NO_SPANS))


#: Spans of pairs x of a piece and the match after it: offsets are summed up left to right within blocks of 256, as what a fold
#: appends to is copied each time, and then over the blocks. Written as SQL, which takes a fraction of the time to build.
SUMMED = f"""x -> aggregate(
  transform(sequence(1, greatest(size(x), 1), 256), k -> aggregate(slice(x, k, 256), named_struct('n', 0, 'out', {NO_SPANS}), (a, p) -> named_struct(
    'n', a.n + length(p.`0`) + length(p.`1`),
    'out', array_append(a.out, named_struct('s', a.n + length(p.`0`), 'e', a.n + length(p.`0`) + length(p.`1`), 't', p.`1`))))),
  named_struct('n', 0, 'out', array({NO_SPANS})),
  (a, b) -> named_struct('n', a.n + b.n, 'out', array_append(a.out, transform(b.out, y -> named_struct('s', y.s + a.n, 'e', y.e + a.n, 't', y.t)))),
  a -> flatten(a.out))"""


def placed(text: Column, regex: Column) -> Column:
    """Spans of all matches, in time that grows with their number. Offsets come from the pieces between the matches and the matches."""
    pieces, found = F.split(text, regex, -1), F.regexp_extract_all(text, regex, 0)
    # As the only element of an array the matches and the pairs are made once, not once a use.
    pairs = F.transform(F.array(found), lambda x: F.arrays_zip(F.slice(pieces, 1, F.size(x)).alias("0"), x.alias("1")))
    return F.call_function("transform", pairs, F.expr(SUMMED))[0]


def outermost(spans: Column) -> Column:
    """Spans that no other covers, by place; of equal ones the first. A sweep by start, longest first, with the furthest end so far."""
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("back"), x["t"].alias("t"))))

    def step(state: Column, x: Column) -> Column:
        kept = F.when(-x["back"] > state["end"], F.array_append(state["out"], F.struct(x["s"].alias("s"), (-x["back"]).alias("e"), x["t"].alias("t")))).otherwise(state["out"])
        return F.struct(F.greatest(state["end"], -x["back"]).alias("end"), kept.alias("out"))

    return F.aggregate(ordered, F.struct(F.lit(-1).alias("end"), F.expr(NO_SPANS).alias("out")), step, lambda s: s["out"])


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns behind a generator of one row, which the optimiser does not copy into each of their uses."""
    made = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select("*", F.inline(F.array(made)))


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"
