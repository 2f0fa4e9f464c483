"""The positive score: five measures of concrete writing and their weighted sum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonewright.functions import fixed_values as V
from tonewright.functions.text import computed_once, count_matches, count_word, has, without_space

SENTENCE_ENDS = r"[。！？!?；;\n]+"
MEASURES = {"specificity": 0.25, "detail_density": 0.25, "sentence_variance": 0.15, "professional_terms": 0.20, "complexity": 0.15}


def clamp(value: Column) -> Column:
    """Cut to an integer, then to 0..100."""
    return F.greatest(F.lit(0), F.least(F.lit(100), value.cast("int")))


def total(parts: list[Column]) -> Column:
    return F.aggregate(F.array(*parts), F.lit(0), lambda a, x: a + x)


def sentences(text: Column) -> Column:
    """Sentences with something in them, white space at their ends removed."""
    parts = F.transform(F.split(text, SENTENCE_ENDS, -1), lambda s: F.regexp_replace(s, F.lit(r"(?U)\A\s+|(?<!\s)\s+\z"), F.lit("")))
    return F.filter(parts, lambda s: F.length(s) > 0)


def with_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the counts that the measures need, each computed once."""
    t = F.coalesce(F.col(text), F.lit(""))
    df = computed_once(df, __t=t)
    t = F.col("__t")
    runs = F.regexp_extract_all(t, F.lit(f"[\\x{{4e00}}-\\x{{9fff}}&&[^{V.STOP_CHARACTERS}]]+"), 0)
    df = computed_once(
        df,
        __chars=F.length(without_space(t)),
        __abstract=total([count_word(t, w) for w in V.ABSTRACT_WORDS]),
        __specific=total([count_matches(t, p) for p in V.SPECIFIC]),
        __sentences=sentences(t),
        __words=F.filter(runs, lambda w: (F.length(w) >= 2) & (F.length(w) <= 6)),
        __blank=~has(t, r"\S"),
    )
    return computed_once(df, __lengths=F.transform("__sentences", lambda s: F.length(without_space(s))))


def specificity() -> Column:
    hundred = F.greatest(F.col("__chars") / 100.0, F.lit(1.0))
    hollow = clamp(F.lit(100) - (F.col("__abstract") / hundred - 2) * 12.5)
    concrete = clamp((F.col("__specific") / hundred - 0.5) * 22)
    return F.when(F.col("__blank"), 50).otherwise((hollow * F.lit(0.4) + concrete * F.lit(0.6)).cast("int"))


def detail_density() -> Column:
    hundred = F.greatest(F.col("__chars") / 100.0, F.lit(1.0))
    return F.when(F.col("__blank"), 50).otherwise(clamp((F.col("__specific") / hundred - 0.5) * 28.5))


def variation() -> Column:
    """Sample deviation of sentence lengths over their mean."""
    n = F.size("__lengths")
    mean = F.aggregate("__lengths", F.lit(0.0), lambda a, x: a + x) / n
    squares = F.aggregate("__lengths", F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
    return F.when(mean > 0, F.sqrt(squares / (n - 1)) / mean).otherwise(0.0)


def sentence_variance() -> Column:
    cv = F.col("__cv")
    line = (F.lit(30) + (cv - 0.08) / F.lit(0.50 - 0.08) * 70).cast("int")
    return F.when(F.size("__lengths") < 2, 50).when(cv <= 0.08, 30).when(cv >= 0.50, 100).otherwise(line)


def professional_terms() -> Column:
    words = F.col("__words")
    long = F.filter(words, lambda w: F.length(w) >= 4)
    hollow = F.filter(long, lambda w: w.isin([w for w in V.ABSTRACT_WORDS if len(w) >= 4]))
    ratio = F.size(long) / F.size(words) * (F.lit(1.0) - F.when(F.size(long) > 0, F.size(hollow) / F.size(long)).otherwise(0.0))
    return F.when(F.col("__blank") | (F.size(words) == 0), 50).otherwise(clamp((ratio - 0.1) * 250))


def complexity() -> Column:
    commas = F.transform("__sentences", lambda s: F.length(s) - F.length(F.translate(s, "，,", "")))
    mean = F.aggregate(commas, F.lit(0.0), lambda a, x: a + x) / F.size("__sentences")
    some = F.when(mean < 0.5, (F.lit(40) + mean * 40).cast("int")).when(mean <= 2.0, 100).when(mean <= 3.5, (F.lit(100) - (mean - 2.0) * 26.6).cast("int"))
    return F.when(F.size("__sentences") == 0, 50).otherwise(some.otherwise(F.greatest(F.lit(0), (F.lit(60) - (mean - 3.5) * 15).cast("int"))))


def with_professionalism(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the five measures and `professionalism`, all integers from 0 to 100."""
    keep = df.columns
    df = with_counts(df, text)
    df = df.withColumn("__cv", F.when(F.size("__lengths") >= 2, variation()))
    made = {"specificity": specificity(), "detail_density": detail_density(), "sentence_variance": sentence_variance(), "professional_terms": professional_terms(), "complexity": complexity()}
    df = df.select(*keep, *[c.cast("int").alias(name) for name, c in made.items()])
    weighed = sum((F.col(name) * F.lit(w) for name, w in list(MEASURES.items())[1:]), F.col("specificity") * F.lit(MEASURES["specificity"]))
    # A sum of hundredths: rounding away binary noise keeps 84.99999 from being cut to 84.
    return df.withColumn("professionalism", F.round(weighed, 9).cast("int"))
