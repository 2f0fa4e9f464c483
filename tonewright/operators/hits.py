"""Hits: what the rules find in a body, as array<struct<category, pattern_id, matched, penalty>>.

A rule is a name, a penalty and a way to find; arrays of rules are concatenated in a fixed order. Nothing is
exploded until a caller wants rows, so scoring needs no shuffle.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonewright.functions import fixed_values as V
from tonewright.functions.text import Held, NO_SPANS, NO_TEXTS, any_of, bounded, computed_once, find_all, fixed_array, has, holds_one, java, needed, outermost, placed, present, reached, replace_all, spans, wide, wide_runs, with_held, without_space

HIT = "array<struct<category:string,pattern_id:string,matched:string,penalty:int>>"
SLANG = "p27_over_colloquial"
UNDUE = "p06_undue_caution"
UNDUE_PATTERNS = [
    # fixed values
    "有人可能会说", "有观点认为", "有人可能会认为", "不可否认的是", "诚然", "毋庸置疑",
    "it could be argued", "it has been argued", "some might say", "some would argue", "one could argue", "admittedly", "it is often said",
]
#: Words that a longer listed word covers, with what may not stand before them.
COVERED = {"玩意儿": "这那", "动嘴": "动"}


Scenes = dict[str, Column] | str


def each_scene(scene: Scenes, value_of) -> Column:
    """What `value_of` says of a scene's name, as a Column. scene: a name, or {name: condition that a row is of this scene}."""
    if isinstance(scene, str):
        return F.lit(value_of(scene))
    values = {name: value_of(name) for name in scene}
    if len({repr(v) for v in values.values()}) == 1:
        return F.lit(next(iter(values.values())))
    base = values.get("base", next(iter(values.values())))
    chosen = [F.when(scene[name], F.lit(v)) for name, v in values.items() if v != base]
    return F.coalesce(*chosen, F.lit(base))


def as_hits(texts: Column, category: str, pattern_id: str | None, penalty: int | Column) -> Column:
    """Hits from an array of matched texts."""
    return F.transform(texts, lambda t: F.struct(F.lit(category).alias("category"), F.lit(pattern_id).cast("string").alias("pattern_id"), t.alias("matched"), F.lit(penalty).alias("penalty")))


def every(body: Column, patterns: list[str], ignore_case: bool = True, held: Held | None = None) -> Column:
    return F.flatten(F.array(*[find_all(body, p, ignore_case, held=held) for p in patterns]))


def found_in(body: Column, words: list[str], held: Held | None) -> Column:
    """The wide words that the body holds: of what it holds of all listed ones, if that is at hand."""
    return present(body if held is None or not held.listed.issuperset(words) else held.wide, words)


@functools.cache
def vocabulary() -> frozenset[str]:
    """Words that scoring looks for in whole texts, whatever the scene."""
    words = {*V.TIER1_ZH, *V.IDIOMS, *V.RESIDUAL_WORDS, *V.STRONG_KEYWORDS, *V.WEAK_KEYWORDS, *map(sought, V.HARD_SLANG + V.LIGHT_COLLOQUIAL)}
    words.update(w.rstrip(".,;:!?").lower() for w in V.TIER1_EN)
    patterns = [(p, any_case) for _, _, own, any_case in LISTED.values() for p in own] + [(p, True) for p in UNDUE_PATTERNS]
    patterns += [(p, False) for p in V.SENTENCES.values() if not p.endswith(CLOSED)] + [(p, False) for _, _, own in V.JUDGED.values() for p in own]
    # Of patterns up to the last mark, words of ASCII are looked for up to there.
    words.update(w for p in V.SENTENCES.values() if p.endswith(CLOSED) for w in needed(p) if wide(w))
    return frozenset(words.union(*(needed(p, any_case, True) for p, any_case in patterns)))


def tier1_zh(body: Column, held: Held | None = None) -> Column:
    return as_hits(found_in(body, V.TIER1_ZH, held), "tier1_zh", None, 5)


def tier1_en(body: Column, held: Held | None = None) -> Column:
    """Words without their final marks, in any case; the hit carries the listed form."""
    lowered = F.lower(body) if held is None else held.lowered
    listed_words = fixed_array([(w.rstrip(".,;:!?").lower(), w) for w in V.TIER1_EN])
    return as_hits(F.transform(F.filter(listed_words, lambda x: F.contains(lowered, x["a"])), lambda x: x["b"]), "tier1_en", None, 5)


#: Listed patterns: rule id -> (category, penalty, patterns, any case). Every occurrence is a hit.
LISTED = {
    "rl03_mechanical": ("mechanical_ordering", 3, V.MECHANICAL, False),
    "rl04_symmetry": ("symmetry_fillers", 4, V.SYMMETRY, True),
    "rl05_symmetry_en": ("symmetry_fillers_en", 4, V.SYMMETRY_EN, True),
    "rl06_closers": ("summary_closers", 3, V.CLOSERS + V.CLOSERS_EN, True),
    "rl07_abstract": ("abstract_subjects", 3, V.ABSTRACT_SUBJECTS + V.ABSTRACT_SUBJECTS_EN + V.CONNECTORS_EN, True),
    "rl09_density": ("density_fillers", 3, V.DENSITY, True),
    "rl10_modifiers": ("redundant_modifiers", 2, V.MODIFIERS, True),
}


def listed(body: Column, rule: str, scene: Scenes = "base", held: Held | None = None) -> Column:
    category, penalty, patterns, ignore_case = LISTED[rule]
    return as_hits(every(body, patterns, ignore_case, held), category, None, each_scene(scene, lambda s: penalties(s).get(category, penalty)))


def idioms(body: Column, scene: Scenes = "base", held: Held | None = None) -> Column:
    return as_hits(found_in(body, V.IDIOMS, held), "idiom_fillers", None, each_scene(scene, lambda s: penalties(s).get("idiom_fillers", 3)))


def penalties(scene: str) -> dict[str, int]:
    return V.PROFILES[scene].get("penalties", {})


def residual(body: Column, held: Held | None = None) -> Column:
    """Jargon nouns that the first tier does not already count."""
    return as_hits(found_in(body, [w for w in V.RESIDUAL_WORDS if w not in V.TIER1_ZH], held), "lexicon_residual", None, 4)


def parallel_items(body: Column, pattern: str, items: int, some: Column, near: Column | None = None) -> Column:
    """Texts of enumerations whose items are short and hollow: one strong keyword, or a keyword in every item.

    The text is searched once; items are taken from what was found, of which one alone may begin with the text.
    near: the text as far as one with a keyword can reach, if that is at hand.
    """
    wrapped = f"(?U)^{V.WRAPPERS}+|{V.WRAPPERS}+$"
    led = pattern.removeprefix(r"(?:^|[。！？\n])")
    known = V.STRONG_KEYWORDS + V.WEAK_KEYWORDS

    def hollow(found: Column, no: Column) -> Column:
        first = (no == 0) & F.startswith(body, found)
        item = lambda i: F.when(first, F.regexp_extract(found, java(rf"\A(?:|[。！？\n]){led}"), i)).otherwise(F.regexp_extract(found, java(rf"\A[。！？\n]{led}"), i))
        bare = lambda part: F.regexp_replace(part, F.lit(wrapped), F.lit(""))
        some_strong = lambda parts: F.exists(parts, lambda part: any_of(part, V.STRONG_KEYWORDS))
        judge = lambda parts: F.forall(parts, lambda part: F.length(bare(part)) <= V.LONGEST_ITEM) & (some_strong(parts) | F.forall(parts, lambda part: any_of(part, known)))
        # As the only element of an array, the items are made once, not once a word that is looked for in them.
        return any_of(found, known) & F.transform(F.array(F.array(*[item(i) for i in range(1, items + 1)])), judge)[0]

    # Whatever its items, an enumeration without a keyword in it is none. some: does the body hold one?
    within = body if near is None or not bounded(pattern) else near
    return F.when(some, F.filter(find_all(within, pattern), hollow)).otherwise(F.expr(NO_TEXTS))


#: Last characters of sentence patterns that no match goes beyond.
CLOSED = ("[。！]", "[。？]")


def up_to_last_mark(body: Column) -> Column:
    """The body up to its last Chinese end mark: patterns that end in one are searched there, as no match reaches further."""
    return F.regexp_extract(body, r"(?s)\A.*[。！？]", 0)


def near_keywords(body: Column, held: Held) -> Column:
    """The body as far as a bounded match with a keyword in it can reach."""
    return F.when(held.holds(body, [w for w in V.STRONG_KEYWORDS + V.WEAK_KEYWORDS if not wide(w)]), body).otherwise(held.near)


def in_closed(held: Held | None, closed: Column) -> Held | None:
    """Where the words of patterns up to the last mark are looked for: wide ones in what the whole body holds, others up to the mark."""
    return None if held is None else held._replace(narrow=closed, listed=frozenset(w for w in held.listed if wide(w)))


def some_keyword(body: Column, held: Held | None = None) -> Column:
    known = V.STRONG_KEYWORDS + V.WEAK_KEYWORDS
    return any_of(body, known) if held is None else held.holds(body, known)


def sentence(body: Column, pattern_id: str, held: Held | None = None, closed: Column | None = None, some: Column | None = None, near: Column | None = None) -> Column:
    """closed: the body up to its last mark; some: does it hold a keyword; near: how far one with a keyword can reach; if they are at hand."""
    pattern = V.SENTENCES[pattern_id]
    some = some_keyword(body, held) if some is None else some
    if pattern == V.TRIAD:
        found = parallel_items(body, pattern, 3, some, near)
    elif pattern == V.FOURFOLD:
        found = parallel_items(body, pattern, 4, some, near)
    else:
        up_to_mark = closed is not None and pattern.endswith(CLOSED)
        found = find_all(closed if up_to_mark else body, pattern, held=in_closed(held, closed) if up_to_mark else held)
    return as_hits(found, "pattern", pattern_id, 0 if pattern_id == "p23_false_precision" else 2)


def undue_caution(body: Column, held: Held | None = None) -> Column:
    return as_hits(every(body, UNDUE_PATTERNS, held=held), "pattern", UNDUE, 2)


def unquoted(body: Column) -> Column:
    """Code and quoted lines blanked out."""
    masked = replace_all(body, "(?s)```.*?```", " ")
    masked = replace_all(masked, r"`[^`\n]+`", " ")
    return F.when(holds_one(body, "`>"), replace_all(masked, r"(?m)^\s*>.*$", " ")).otherwise(body)


def word_pattern(word: str, covered: bool = True) -> str:
    """A listed word as a pattern: English ones stand alone; others are not looked for inside a longer listed word, if `covered`."""
    if word.isascii():
        return java(f"(?<![A-Za-z]){word}(?![A-Za-z])", True)
    return java((f"(?<![{COVERED[word]}])" if covered and word in COVERED else "") + word)


def sought(word: str) -> str:
    """What a listed word is looked for by: what is wide in it, if anything is."""
    return "".join(c for c in word if wide(c)) or word.lower()


def word_spans(masked: Column, words: list[str], held: tuple[Column, Column] | None = None, covered: bool = True) -> Column:
    """Spans of listed words by position; words inside a longer listed word are left out, if `covered`. held: where wide and other words are looked for."""
    wide_in, lowered = (masked, F.lower(masked)) if held is None else held
    # Only the words that a text holds are searched for: their patterns come from a table, and are compiled where they are needed.
    pairs = [(sought(w), word_pattern(w, covered)) for w in words]
    kinds = [(wide_in, [x for x in pairs if wide(x[0])]), (lowered, [x for x in pairs if not wide(x[0])])]
    inside = lambda where: lambda x: F.contains(where, x["a"])
    there = F.concat(*[F.filter(fixed_array(own), inside(where)) for where, own in kinds if own])
    return F.array_sort(F.flatten(F.transform(there, lambda x: placed(masked, x["b"]))))


def outermost_words(masked: Column, words: list[str]) -> Column:
    """Spans of listed words that no span of another listed word covers."""
    return outermost(word_spans(masked, words, covered=False))


def slang(body: Column, masked: Column, held: tuple[Column, Column] | None = None, always: bool = True) -> Column:
    """struct<hard, light, n_chars>: counts need a density per hundred visible characters as well.

    held: where wide and other words are looked for. Unless `always`, n_chars is 1 where no light word needs it.
    """
    hard, light = (F.transform(word_spans(masked, words, held), lambda s: s["t"]) for words in (V.HARD_SLANG, V.LIGHT_COLLOQUIAL))
    n = F.greatest(F.length(without_space(body)), F.lit(1))
    if not always:
        n = F.when(F.size(light) > 0, n).otherwise(F.lit(1))
    return F.struct(hard.alias("hard"), light.alias("light"), n.alias("n_chars"))


def slang_severity(found: Column) -> Column:
    n, density = F.size(found["light"]), F.size(found["light"]) / (found["n_chars"] / F.lit(100.0))
    worst = (F.size(found["hard"]) > 0) | ((n >= 6) & (density > 0.55))
    return F.when(worst, "rewrite").when((n >= 3) & (density > 0.25), "warn").otherwise("pass")


def slang_hits(found: Column, scene: Scenes = "base") -> Column:
    hard_penalty, light_penalty = (each_scene(scene, lambda s, own=own: penalties(s).get(SLANG, own)) for own in (3, 1))
    hard, light = (as_hits(found[kind], "pattern", SLANG, cost) for kind, cost in (("hard", hard_penalty), ("light", light_penalty)))
    return F.concat(hard, F.when((slang_severity(found) != "pass") & (light_penalty > 0), light).otherwise(F.expr(f"cast(array() as {HIT})")))


#: What a text must hold for a pattern to match at all, where that is far quicker to see than the pattern, and as far as a match can reach.
NEEDED = {V.JUDGED["p29_maxim_golden_line"][2][0]: (r"的[，,]\s*比", r"(?s)\A.*比.{0,40}")}


def judged(body: Column, pattern_id: str, penalty: int | Column | None = None, held: Held | None = None) -> Column:
    """Hits of a judged pattern: distinct spans of its expressions, none below its least number."""
    own, least, patterns = V.JUDGED[pattern_id]
    guarded = lambda p: F.when(has(body, NEEDED[p][0], held=held), spans(F.regexp_extract(reached(body, p, False, held), NEEDED[p][1], 0), p)).otherwise(F.expr(NO_SPANS)) if p in NEEDED else spans(body, p, held=held)
    found = F.array_distinct(F.array_sort(F.flatten(F.array(*[guarded(p) for p in patterns]))))
    found = F.filter(found, lambda s: F.rlike(s["t"], F.lit(r"(?U)\S")))
    texts = F.transform(found, lambda s: s["t"])
    if least > 1:
        texts = F.when(F.size(found) >= least, texts).otherwise(F.expr(NO_TEXTS))
    return as_hits(texts, "pattern", pattern_id, own if penalty is None else penalty)


def active(scene: str) -> list[str]:
    """Judged patterns of a scene."""
    return V.BASE_JUDGED + V.PROFILES[scene].get("extra", [])


def price(scene: str, pattern_id: str) -> int:
    """What a hit of a judged pattern costs in a scene; 0 if the pattern is not active there."""
    return penalties(scene).get(pattern_id, V.JUDGED[pattern_id][0]) if pattern_id in active(scene) else 0


def scene_hits(df: DataFrame, scene: Scenes, body: str = "body", near: str | None = None) -> DataFrame:
    """Adds `hits`: all hits of a scene, its penalties, exemptions and closed categories applied; and the body up to its last wide word as `near`, if named.

    The patterns run once, whatever the number of scenes; only prices and exemptions differ by row.
    """
    names = [scene] if isinstance(scene, str) else list(scene)
    b = F.col(body)
    df, held = with_held(df, "__held", b, vocabulary())
    df = computed_once(df, __bare=unquoted(b), __closed=up_to_last_mark(held.near), __some=some_keyword(b, held))
    df = computed_once(df, __few=F.when(F.col("__some"), near_keywords(b, held)))
    same = F.col("__bare") == b
    df = computed_once(df, __bare_wide=F.when(same, held.wide).otherwise(wide_runs("__bare")), __bare_low=F.when(same, held.lowered).otherwise(F.lower("__bare")))
    df = computed_once(df, __slang=slang(b, F.col("__bare"), (F.col("__bare_wide"), F.col("__bare_low")), always=False))
    rules = list(LISTED)
    parts = [tier1_zh(b, held), tier1_en(b, held), *(listed(b, r, scene, held) for r in rules[:5]), idioms(b, scene, held), *(listed(b, r, scene, held) for r in rules[5:]), residual(b, held)]
    parts += [sentence(b, p, held, F.col("__closed"), F.col("__some"), F.col("__few")) for p in V.SENTENCES] + [undue_caution(b, held), slang_hits(F.col("__slang"), scene)]
    for p in dict.fromkeys(p for name in names for p in active(name)):
        cost = each_scene(scene, lambda s, p=p: price(s, p))
        costs = {price(name, p) for name in names}
        if costs == {0}:
            continue
        found = judged(b, p, cost, held)
        parts.append(F.when(cost > 0, found).otherwise(F.expr(f"cast(array() as {HIT})")) if 0 in costs else found)
    hits = F.flatten(F.array(*parts))
    for name in names:
        here = F.lit(True) if isinstance(scene, str) else scene[name]
        if V.PROFILES[name].get("off"):
            hits = F.filter(hits, counted(V.PROFILES[name]["off"], here))
        for key, words in V.PROFILES[name].get("exempt", {}).items():
            hits = F.filter(hits, spared(key, words, here))
    df = computed_once(df, hits=hits)
    return (df.withColumn(near, held.near) if near else df).drop("__slang", "__held_wide", "__held_low", "__held_odd", "__held_near", "__bare", "__bare_wide", "__bare_low", "__closed", "__some", "__few")


def counted(off: list[str], here: Column):
    """A condition on hits: not of a category that this scene leaves out."""
    return lambda h: ~(here & h["category"].isin(off))


def spared(key: str, words: list[str], here: Column):
    """A condition on hits: not an exempt word of this rule in this scene."""
    return lambda h: ~(here & (F.coalesce(h["pattern_id"], h["category"]) == key) & any_of(h["matched"], words))
