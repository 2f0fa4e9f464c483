"""Read-only detectors: arrays of findings a document, their total severity, and density by document or paragraph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonewright.functions import fixed_values as V
from tonewright.functions.text import find_all, has, present

PREVIEW = 50


def tier1(text: Column) -> Column:
    """word@line of each listed word's first occurrence; case counts."""
    words = V.TIER1_ZH + V.TIER1_EN
    def placed(w: str) -> Column:
        before = F.substring_index(text, w, 1)
        line = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1
        return F.when(F.contains(text, F.lit(w)), F.concat(F.lit(w + "@"), line.cast("string")))
    return F.array_compact(F.array(*[placed(w) for w in words]))


def first_of(text: Column, patterns: list[str], prefix: str, ignore_case: bool = False) -> Column:
    """The first match of each pattern, cut to a preview."""
    def one(p: str) -> Column:
        found = find_all(text, p, ignore_case)
        return F.when(F.size(found) > 0, F.concat(F.lit(prefix), F.substring(F.element_at(found, 1), 1, PREVIEW), F.lit("...")))
    return F.array_compact(F.array(*[one(p) for p in patterns]))


def symmetry(text: Column) -> Column:
    across = F.transform(find_all(text, V.CROSS_SENTENCE_EN, True), lambda t: F.concat(F.lit("对称填充(EN-跨句): "), F.substring(t, 1, PREVIEW), F.lit("...")))
    return F.concat(first_of(text, V.SYMMETRY, "对称填充: "), first_of(text, V.SYMMETRY_EN, "对称填充(EN): ", True), across)


def mechanical(text: Column) -> Column:
    return F.array_compact(F.array(*[F.when(has(text, p), F.lit("机械排序: " + p)) for p in V.MECHANICAL]))


def closers(text: Column) -> Column:
    return first_of(text, V.CLOSERS, "总结性结尾: ")


def abstract(text: Column) -> Column:
    return first_of(text, V.ABSTRACT_SUBJECTS, "抽象主语: ")


def idioms(text: Column) -> Column:
    return F.transform(present(text, V.IDIOMS), lambda w: F.concat(F.lit("成语 filler: "), w))


def em_dash(text: Column) -> Column:
    return F.when(has(text, V.EM_DASHES), F.array(F.lit("破折号过度使用（连续 2 个以上）"))).otherwise(F.expr("cast(array() as array<string>)"))


DETECTORS = {"tier1": tier1, "symmetry": symmetry, "mechanical": mechanical, "summary_closer": closers, "abstract": abstract, "idiom": idioms, "em_dash": em_dash}


def with_detections(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds an array a detector, their total and the severity."""
    whole = F.coalesce(F.col(text), F.lit(""))
    df = df.select("*", *[f(whole).alias(name) for name, f in DETECTORS.items()])
    total = sum((F.size(name) for name in DETECTORS), F.lit(0))
    return df.withColumn("total", total).withColumn("severity", F.when(total == 0, "无大碍").when(total <= 2, "轻改").otherwise("重写"))


def density_columns(text: Column, tier2_limit: int = 3, tier3_limit: int = 1) -> list[Column]:
    """tier2 (idioms present), tier3 (abstract subjects and closers, each occurrence, case counts), should_rewrite."""
    tier2 = F.size(present(text, V.IDIOMS))
    tier3 = F.aggregate(F.array(*[F.size(find_all(text, p)) for p in V.ABSTRACT_SUBJECTS + V.ABSTRACT_SUBJECTS_EN + V.CLOSERS + V.CLOSERS_EN]), F.lit(0), lambda a, x: a + x)
    return [tier2.cast("long").alias("tier2"), tier3.cast("long").alias("tier3"), ((tier2 >= tier2_limit) | (tier3 >= tier3_limit)).cast("int").alias("should_rewrite")]
