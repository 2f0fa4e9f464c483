"""Scenes: measures of a text, weighted signals, the guess, and profiles by name."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonewright.functions import fixed_values as V
from tonewright.functions.text import any_of, computed_once, count_characters, count_matches, count_word, has, without_space

SCENES = list(V.SCENE_TARGET)


def with_features(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds `features`: thirteen measures, rates a thousand visible characters."""
    df = computed_once(df, __t=F.coalesce(F.col(text), F.lit("")))
    t = F.col("__t")
    parts = F.filter(F.split(t, r"[。！？!?\n]+", -1), lambda s: F.rlike(s, F.lit(r"(?U)\S")))
    df = df.withColumn("__n", F.greatest(F.length(without_space(t)), F.lit(1))).withColumn("__parts", parts)
    rate = lambda c: c / F.col("__n") * 1000.0
    emoji = count_matches(t, V.EMOJI)
    mean = F.aggregate("__parts", F.lit(0.0), lambda a, s: a + F.length(s)) / F.size("__parts")
    made = {
        "chars": F.col("__n").cast("double"), "emoji": emoji.cast("double"), "emoji_ratio": rate(emoji),
        "first_person": rate(count_word(t, "我")), "colloquial": rate(count_characters(t, V.PARTICLES)),
        "avg_sent_len": F.when(F.size("__parts") > 0, mean).otherwise(0.0),
        "has_code_fence": F.when(F.contains(t, F.lit("```")), 1.0).otherwise(0.0),
        "inline_code": count_matches(t, r"`[^`\n]{1,40}`").cast("double"), "tags": count_matches(t, r"#[^\s#]{1,20}").cast("double"),
        "url_or_path": count_matches(t, r"(?:https?://|/[\w.-]+/)").cast("double"), "versions": count_matches(t, r"\bv?\d+\.\d+(?:\.\d+)?\b").cast("double"),
        "list_items": count_matches(t, r"(?m)^\s*(?:[-*+]|\d+[.)])\s+").cast("double"), "latin_ratio": rate(count_matches(t, "[A-Za-z]{2,}")),
    }
    return computed_once(df, features=F.struct(*[c.alias(name) for name, c in made.items()])).drop("__n", "__parts")


def signals(t: Column, f: Column) -> dict[str, list[tuple[str, float, Column]]]:
    """Scene -> (label, weight, condition), in order. Labels, weights and limits."""
    return {
        "social-note": [
            ("大量 emoji", 2.0, f["emoji"] >= 3), ("emoji 密度高", 1.0, f["emoji_ratio"] >= 8), ("带 #话题 标签", 1.5, f["tags"] >= 2),
            ("第一人称叙事", 2.0, f["first_person"] >= 10), ("亲历动作句", 1.0, any_of(t, V.ACTIONS)), ("口语语气词", 1.0, f["colloquial"] >= 6),
            ("短句为主", 1.0, (f["avg_sent_len"] > 0) & (f["avg_sent_len"] <= 20)), ("无代码块", 0.5, f["has_code_fence"] == 0),
        ],
        "health-content": [
            ("对读者给建议", 1.5, has(t, V.ADVICE)), ("症状描述词", 0.8, any_of(t, V.SYMPTOMS)), ("就医/诊断动作", 0.7, any_of(t, V.MEDICAL_ACTS)),
            ("免责/筛查表述", 0.8, any_of(t, V.DISCLAIMERS)), ("宠物主体", 0.3, any_of(t, V.PETS)), ("非个人叙事口吻", 1.2, f["first_person"] < 8),
        ],
        "tech-doc": [
            ("有代码块", 2.5, f["has_code_fence"] >= 1), ("行内代码", 1.0, f["inline_code"] >= 2), ("文件路径/URL", 1.0, f["url_or_path"] >= 2),
            ("版本号", 0.5, f["versions"] >= 1), ("性能指标", 1.0, any_of(t, V.METRICS)), ("英文占比高", 1.0, f["latin_ratio"] >= 120), ("结构化列表", 0.5, f["list_items"] >= 3),
        ],
    }


def with_guess(df: DataFrame, into: str, text: str = "text", path: str | None = None) -> DataFrame:
    """Adds one struct of scene, confidence, guessed_scene, needs_confirmation, evidence and a score a scene."""
    keep = df.columns
    df = with_features(df, text)
    t = F.col("__t")
    where = F.lower(F.coalesce(F.col(path), F.lit(""))) if path else None
    evidence = []
    for name, own in signals(t, F.col("features")).items():
        hinted = [("路径先验", V.PATH_PRIOR, any_of(where, V.PATH_HINTS[name]))] if where is not None else []
        parts = [F.when(c, F.struct(F.lit(w).alias("w"), F.lit(f"{name}:{label}(+{w})").alias("why"))) for label, w, c in own + hinted]
        evidence.append(F.array_compact(F.array(*parts)).alias(f"__{name}"))
    df = df.select("*", *evidence)
    df = df.select("*", *[F.aggregate(f"__{s}", F.lit(0.0), lambda a, x: a + x["w"]).alias(f"__score_{s}") for s in SCENES])
    # Of equal scores the scene listed first wins: its number is lower.
    ranked = F.array_sort(F.array(*[F.struct((-F.col(f"__score_{s}")).alias("back"), F.lit(i).alias("no"), F.lit(s).alias("name"), F.lit(V.SCENE_TARGET[s]).alias("target")) for i, s in enumerate(SCENES)]))
    df = df.withColumn("__r", ranked)
    top, second = -F.col("__r")[0]["back"], -F.col("__r")[1]["back"]
    blank, little = ~has(t, r"\S"), top < V.LEAST_EVIDENCE
    confidence = F.least(top / F.col("__r")[0]["target"], F.lit(V.MOST_CONFIDENCE))
    sure = (confidence >= V.CONFIDENT_AT) & ((top - second) / (top + 1.0) >= V.MARGIN_AT)
    name = F.col("__r")[0]["name"]
    why = F.concat(*[F.transform(f"__{s}", lambda x: x["why"]) for s in SCENES])
    guess = F.struct(
        F.when(blank | little, "base").when(sure, name).otherwise("base").alias("scene"),
        F.when(blank | little, 0.0).otherwise(confidence).alias("confidence"),
        F.when(~blank & ~little, name).alias("guessed_scene"),
        F.when(blank, False).when(little, True).otherwise(~sure).alias("needs_confirmation"),
        F.when(blank, F.array(F.lit("空文本"))).when(little, F.array(F.lit("无足够特征判定场景"))).otherwise(why).alias("evidence"),
        *[F.when(~blank, F.col(f"__score_{s}")).alias(f"score_{s}") for s in SCENES],
    )
    return computed_once(df, **{into: guess}).select(*keep, into)


def with_scene(df: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """Adds scene, confidence, guessed_scene, needs_confirmation, evidence and a score a scene."""
    return with_guess(df, "__guess", text, path).select(*df.columns, "__guess.*")


AUTO = ["auto", "自动"]


def known(name: str | None) -> str:
    """Profile of a name or alias, as `resolved`, for a name that is at hand; an unknown one is reported."""
    key = (name or "base").strip().lower().replace(" ", "-")
    aliases = {a: scene for scene, profile in reversed(V.PROFILES.items()) for a in (scene, *profile["aliases"])}
    found = aliases.get(key) or aliases.get(key.replace("_", "-"))
    if found is None:
        warnings.warn(f"unknown scene {name!r}: base is used; scenes are {', '.join(V.PROFILES)}", RuntimeWarning, stacklevel=3)
    return found or "base"


def with_chosen(df: DataFrame, scene: str | Column | None, into: str, text: str = "text", path: str | None = None) -> DataFrame:
    """Adds the scene to judge each row by: of a name or alias, or of the text where that is `auto`; base where neither is known.

    scene: one name for all rows, or a Column of names.
    """
    if not isinstance(scene, Column):
        if (scene or "").strip().lower() not in AUTO:
            return df.withColumn(into, F.lit(known(scene)))
        return with_guess(df, into, text, path).withColumn(into, F.col(into)["scene"])
    keep = df.columns
    asked = F.trim(F.lower(scene))
    df = with_guess(df.withColumn("__name", asked).withColumn("__named", resolved(scene)), "__guess", text, path)
    return df.select(*keep, F.when(F.col("__name").isin(AUTO), F.col("__guess.scene")).otherwise(F.col("__named")).alias(into))


def canonical(name: Column) -> Column:
    """Profile of a name or alias: lower case, trimmed, spaces and (at a second try) underscores as hyphens; null if unknown."""
    alias = {}
    for scene, profile in V.PROFILES.items():
        for a in [scene, *profile["aliases"]]:
            alias.setdefault(a, scene)
    table = F.create_map(*[F.lit(x) for pair in alias.items() for x in pair])
    key = F.replace(F.trim(F.lower(name)), F.lit(" "), F.lit("-"))
    return F.coalesce(F.element_at(table, key), F.element_at(table, F.replace(key, F.lit("_"), F.lit("-"))))


def resolved(name: Column) -> Column:
    """As `canonical`, with base for what is unknown or missing."""
    return F.coalesce(canonical(name), F.lit("base"))
