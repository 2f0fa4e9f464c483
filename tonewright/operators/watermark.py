"""Character forensics: zero-width characters, full-width letters, compatibility characters, one dominant character."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonewright.functions.text import computed_once

ZERO_WIDTH = "\u200b\u200c\u200d\ufeff"
#: Full-width letters and digits lie at a fixed distance from their ASCII forms.
WIDE = "".join(chr(c + 0xFEE0) for c in (*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x30, 0x3A)))
NARROW = "".join(chr(ord(c) - 0xFEE0) for c in WIDE)
DOMINANT_SHARE, DOMINANT_COUNT = 0.08, 20


def zero_width_count(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, ZERO_WIDTH, ""))


def wide_count(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, WIDE, ""))


def compatibility_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"[\x{f900}-\x{faff}]"), 0))


def cleaned(text: Column) -> Column:
    """Without zero-width characters, full-width letters and digits made narrow."""
    return F.translate(F.translate(text, ZERO_WIDTH, ""), WIDE, NARROW)


def dominant(text: Column) -> Column:
    """struct<top: struct<n, back, ch>, total>: the most frequent Chinese character, of equals the one seen first.

    Characters are sorted with their places and counted run by run, so a text costs its length, however many kinds it has.
    """
    han = F.regexp_replace(text, F.lit(r"[^\x{4e00}-\x{9fff}]"), F.lit(""))
    placed = F.array_sort(F.transform(F.split(han, ""), lambda c, i: F.struct(c.alias("ch"), i.alias("at"))))
    none = F.expr("named_struct('n', 0, 'back', 0, 'ch', '')")
    start = F.struct(none.alias("run"), none.alias("top"))

    def step(state: Column, x: Column) -> Column:
        same = state["run"]["ch"] == x["ch"]
        run = F.struct(
            F.when(same, state["run"]["n"] + 1).otherwise(1).alias("n"),
            F.when(same, state["run"]["back"]).otherwise(F.lit(0) - x["at"]).alias("back"),
            x["ch"].alias("ch"),
        )
        return F.struct(run.alias("run"), F.greatest(state["top"], run).alias("top"))

    top = F.aggregate(F.filter(placed, lambda x: x["ch"] != ""), start, step, lambda state: state["top"])
    return F.struct(F.when(F.length(han) > 0, top).alias("top"), F.length(han).alias("total"))


def with_watermark(df: DataFrame, text: str = "text", clean: bool = False) -> DataFrame:
    """Adds cleaned_text, zero_width_removed, homoglyph_replaced, bom_detected, synthid_suspect, dominant_char, warnings."""
    keep = df.columns
    df = df.withColumn("__t", F.coalesce(F.col(text), F.lit("")))
    t = F.col("__t")
    df = computed_once(df, zero_width_removed=zero_width_count(t), bom_detected=F.contains(t, F.lit("\ufeff")), __wide=wide_count(t), __compat=compatibility_count(t), __d=dominant(t))
    top = F.col("__d.top")
    share = top["n"] / F.col("__d.total")
    df = df.withColumn("synthid_suspect", F.coalesce((share > DOMINANT_SHARE) & (top["n"] > DOMINANT_COUNT), F.lit(False)))
    df = df.withColumn("dominant_char", F.when(F.col("synthid_suspect"), top["ch"]))
    note = lambda n, before, after: F.when(n > 0, F.concat(F.lit(before), n.cast("string"), F.lit(after)))
    if clean:
        notes = [F.when(F.col("bom_detected"), F.lit("检测到 BOM (U+FEFF)，已移除")), note(F.col("zero_width_removed"), "移除 ", " 个零宽字符"), note(F.col("__wide"), "替换 ", " 处同形字/全角字符")]
    else:
        notes = [note(F.col("zero_width_removed"), "检测到 ", " 个零宽字符"), F.when(F.col("bom_detected"), F.lit("检测到 BOM (U+FEFF)")), note(F.col("__wide"), "检测到 ", " 个全角 ASCII 字符"), note(F.col("__compat"), "检测到 ", " 个 CJK 兼容字符")]
    return df.select(
        *keep,
        (cleaned(t) if clean else t).alias("cleaned_text"),
        "zero_width_removed",
        (F.col("__wide") if clean else F.lit(0)).alias("homoglyph_replaced"),
        "bom_detected", "synthid_suspect", "dominant_char",
        F.array_compact(F.array(*notes)).alias("warnings"),
    )
