"""Scores, summaries and actions from hits."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonewright.functions import fixed_values as V
from tonewright.functions.text import NO_TEXTS, any_of, computed_once, near_wide, replace_all, stripped, up_to_last_wide
from tonewright.operators.hits import Scenes, each_scene, judged, scene_hits
from tonewright.operators.scene import AUTO, known, with_chosen

LEAST_BODY = 200
CLEAN = "未检测到明显 AI 味特征"


def without_code(text: Column) -> Column:
    """Fenced blocks and inline code removed."""
    return F.when(F.contains(text, F.lit("`")), replace_all(replace_all(text, "(?s)```.*?```", ""), r"`[^`\n]+`", "")).otherwise(text)


def with_body(df: DataFrame, text: str = "text", body: str = "body") -> DataFrame:
    """The text that is judged: without code, unless hardly anything else is left. Null text is empty."""
    whole = F.coalesce(F.col(text), F.lit(""))
    df = computed_once(df, __cut=without_code(whole))
    mostly_code = F.contains(whole, F.lit("`")) & (F.length(whole) > LEAST_BODY) & (F.length(stripped(F.col("__cut"))) < LEAST_BODY)
    return computed_once(df, **{body: F.when(mostly_code, whole).otherwise(F.col("__cut"))}).drop("__cut")


def raw_penalty(hits: Column) -> Column:
    return F.aggregate(hits, F.lit(0).cast("long"), lambda a, h: a + h["penalty"])


def norm_penalty(raw: Column, length: Column) -> Column:
    return raw * F.lit(1000.0) / F.greatest(length, F.lit(1))


def score_of(raw: Column, norm: Column) -> Column:
    base = F.greatest(F.lit(0), (F.lit(100) - F.sqrt(norm) * 10).cast("int"))
    return F.when(raw <= 5, F.greatest(F.lit(85), base)).otherwise(base)


def action_of(score: Column, compliance: Column, scene: Scenes) -> Column:
    warn_at, rewrite_at, block_at = (each_scene(scene, lambda s, i=i: V.PROFILES[s]["policy"][i]) for i in range(3))
    return F.when(compliance | (score <= block_at), "block").when(score < rewrite_at, "rewrite").when(score < warn_at, "warn").otherwise("pass")


def summary_of(hits: Column) -> Column:
    """Counts a category, categories in order."""
    names = F.array_sort(F.array_distinct(F.transform(hits, lambda h: h["category"])))
    parts = F.transform(names, lambda c: F.concat(c, F.lit(": "), F.size(F.filter(hits, lambda h: h["category"] == c)).cast("string"), F.lit(" 处")))
    return F.when(F.size(hits) == 0, F.lit(CLEAN)).otherwise(F.concat(F.lit("命中 "), F.array_join(parts, "；")))


def categories_of(hits: Column) -> Column:
    """Last matched text of each category among the first twenty hits, as category=text joined by a bar."""
    first = F.slice(hits, 1, 20)
    names = F.array_sort(F.array_distinct(F.transform(first, lambda h: h["category"])))
    last = lambda c: F.element_at(F.filter(first, lambda h: h["category"] == c), -1)["matched"]
    return F.array_join(F.transform(names, lambda c: F.concat(c, F.lit("="), last(c))), "|")


def red_lines(text: Column, patterns: list[str], asked: Column) -> list[Column]:
    """The ids of the patterns that the text matches, null for others; none is tried unless `asked`."""
    return [F.when(asked & (F.size(judged(text, p)) > 0), F.lit(p)) for p in patterns]


def cross_compliance(text: Column, scene: Scenes, near: Column | None = None) -> Column:
    """Red-line patterns of other scenes whose domain the whole text touches, as an array of ids. near: the text up to its last wide word, if it is at hand."""
    found = []
    for name, profile in V.PROFILES.items():
        if name != scene and profile.get("compliance"):
            inside = touched(text, profile["domain"], profile["compliance"], near)
            found.append(inside if isinstance(scene, str) or name not in scene else F.when(~scene[name], inside))
    return F.flatten(F.array_compact(F.array(*found))) if found else F.expr(f"{NO_TEXTS}")


def touched(text: Column, domain: list[str], patterns: list[str], near: Column | None = None) -> Column:
    """The ids of the patterns that a text of the domain matches; null for other texts."""
    within = all(near_wide(p) for own in patterns for p in V.JUDGED[own][2])
    lines = lambda t: F.array_compact(F.array(*red_lines(t if within else text, patterns, F.lit(True))))
    # As the only element of an array, the part of the text that holds what is wide in it is cut once.
    return F.transform(F.array(up_to_last_wide(text) if near is None else near), lambda t: F.when(any_of(t, domain), lines(t)))[0]


def own_compliance(body: Column, scene: Scenes) -> Column:
    """Red-line patterns of the row's own scene that its body matches, as an array of ids."""
    names = [scene] if isinstance(scene, str) else list(scene)
    found = [x for name in names for x in red_lines(body, V.PROFILES[name].get("compliance", []), F.lit(True) if isinstance(scene, str) else scene[name])]
    return F.array_compact(F.array(*found)) if found else F.expr(f"{NO_TEXTS}")


def of_patterns(ids: list[str]):
    """A condition on hits: of one of these patterns."""
    return lambda h: F.coalesce(h["pattern_id"].isin(ids), F.lit(False))


def own_line(hits: Column, scene: Scenes) -> Column:
    """Is one of the hits a red line of the row's own scene?"""
    names = [scene] if isinstance(scene, str) else list(scene)
    crossed = [(F.lit(True) if isinstance(scene, str) else scene[n]) & F.exists(hits, of_patterns(red)) for n in names if (red := V.PROFILES[n].get("compliance"))]
    return functools.reduce(lambda a, b: a | b, crossed, F.lit(False))


def by_row(scene: Column) -> dict[str, Column]:
    return {name: scene == name for name in V.PROFILES}


def with_conditions(df: DataFrame, scene: str | Column | Scenes | None, text: str) -> tuple[DataFrame, Scenes]:
    """The frame with each row's scene as __scene, and the scene as scoring takes it: one name, or a condition a name."""
    if isinstance(scene, dict):
        return df.withColumn("__scene", F.coalesce(*[F.when(here, F.lit(name)) for name, here in scene.items()])), scene
    if isinstance(scene, Column) or (scene or "").strip().lower() in AUTO:
        return with_chosen(df, scene, "__scene", text), by_row(F.col("__scene"))
    return df.withColumn("__scene", F.lit(known(scene))), known(scene)


def with_red_line(df: DataFrame, scene: str | Column | Scenes = "base", text: str = "text", into: str = "red_line") -> DataFrame:
    """Adds whether the text crosses a red line, and nothing else of the score is computed."""
    keep = df.columns
    df, which = with_conditions(df, scene, text)
    df = with_body(df, text, "__body")
    whole = F.coalesce(F.col(text), F.lit(""))
    crossed = (F.size(own_compliance(F.col("__body"), which)) > 0) | (F.size(cross_compliance(whole, which)) > 0)
    return computed_once(df, **{into: crossed}).select(*keep, into)


def with_score(df: DataFrame, scene: str | Column | Scenes | None = "base", text: str = "text") -> DataFrame:
    """Adds scene, body, hits, raw, norm_penalty, score, summary, hit_count, hits_per_1k, char_count, compliance_cross_scene, compliance_hit, action.

    scene: a name or alias, `auto` (each text's own), or a Column of these; base for what is unknown.
    """
    df, which = with_conditions(df, scene, text)
    df = scene_hits(with_body(df, text), which, near="__near")
    hits, size = F.col("hits"), F.greatest(F.length("body"), F.lit(1))
    whole = F.coalesce(F.col(text), F.lit(""))
    near = F.when(F.col("body") == whole, F.col("__near")).otherwise(up_to_last_wide(whole))
    # Both are read by several of the columns below.
    df = computed_once(df, raw=raw_penalty(hits), __own=own_line(hits, which))
    df = df.withColumn("char_count", size)
    df = df.withColumn("norm_penalty", norm_penalty(F.col("raw"), F.col("char_count")))
    df = df.withColumn("score", score_of(F.col("raw"), F.col("norm_penalty")))
    df = df.withColumn("hit_count", F.size(hits)).withColumn("hits_per_1k", F.col("hit_count") * 1000.0 / F.col("char_count"))
    df = computed_once(df, compliance_cross_scene=F.when(~F.col("__own"), cross_compliance(whole, which, near))).drop("__near")
    df = df.withColumn("compliance_hit", F.col("__own") | F.coalesce(F.size("compliance_cross_scene") > 0, F.lit(False))).drop("__own")
    df = df.withColumn("summary", summary_of(hits)).withColumn("action", action_of(F.col("score"), F.col("compliance_hit"), which))
    return df.withColumn("scene", F.col("__scene")).drop("__scene")


def hit_rows(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row a hit, numbered in order."""
    return df.select(key, F.posexplode("hits").alias("hit_no", "h")).select(key, "hit_no", "h.category", "h.pattern_id", "h.matched", "h.penalty")


def hit_report(df: DataFrame) -> DataFrame:
    """Hits, penalties and documents by scene and category, with totals of each and of all (null: all)."""
    each = df.select("scene", "doc_id", F.explode("hits").alias("h")).select("scene", "doc_id", "h.category", "h.penalty")
    # A row a document and category first: distinct documents are then counted without a set of ids a total.
    small = each.groupBy("doc_id", "scene", "category").agg(F.count("*").alias("n"), F.sum("penalty").alias("cost"))
    return small.cube("scene", "category").agg(F.sum("n").alias("hits"), F.sum("cost").cast("long").alias("penalty"), F.count_distinct("doc_id").alias("docs"))


def version_report(df: DataFrame, scene: str = "base", keys: tuple[str, str] = ("doc_id", "version")) -> DataFrame:
    """Scores of versions of texts, in order: score, the score before, and whether it fell. A first version has no score before."""
    document, version = keys
    scored = with_score(df, scene).select(document, version, "score")
    before = F.lag("score").over(Window.partitionBy(document).orderBy(version))
    return scored.withColumn("before", before).withColumn("fell", F.coalesce(F.col("score") < F.col("before"), F.lit(False)))
