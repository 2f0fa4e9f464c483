"""Text files, directories, golden cases and reports in and out of DataFrames.

Sources are never overwritten: what the command line calls in-place repair writes to another folder here.
"""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Least number of splits a core of a table whose rows are costly.
SPLITS = 4


def spread(df: DataFrame) -> DataFrame:
    """Deals rows to all cores where the input has few splits a core, so that no core waits for the longest; many files stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(SPLITS * cores) if df.rdd.getNumPartitions() < SPLITS * cores else df


def read_texts(spark: SparkSession, *paths: str) -> DataFrame:
    """path and text of whole UTF-8 files; globs and several paths are allowed."""
    return spark.read.text(list(paths), wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_folder(spark: SparkSession, folder: str, pattern: str = "*.md") -> DataFrame:
    """All files of a folder tree whose names match."""
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    return reader.text(folder, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def from_strings(spark: SparkSession, texts: list[str | None]) -> DataFrame:
    """doc_id and text of strings in memory (standard input, tests)."""
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """Cases of a JSON file: a list of them, or an object with `test_cases`. Whatever has no input is left out."""
    fields = "id string, input string, expected_pattern_mode string, expected_legacy_mode string, note string"
    raw = spark.read.schema(f"{fields}, test_cases array<struct<{fields.replace(' string', ':string')}>>").option("multiLine", "true").json(path)
    names = [f.split()[0] for f in fields.split(", ")]
    nested = raw.filter("test_cases is not null").select(F.inline("test_cases")).select(*names)
    return raw.filter("test_cases is null").select(*names).unionByName(nested).filter("input is not null")


def plain_value(raw: str):
    """A scalar of a settings file: quoted text, true, false, null, a number, or text as it stands."""
    raw = raw.strip()
    if len(raw) > 1 and raw[0] == raw[-1] and raw[0] in "'\"":
        return raw[1:-1]
    named = {"true": True, "false": False, "null": None, "~": None, "": None}
    if raw.lower() in named:
        return named[raw.lower()]
    for kind in (int, float):
        try:
            return kind(raw)
        except ValueError:
            continue
    return raw


def read_settings(spark: SparkSession, path: str, *section: str) -> dict:
    """The scalars of one section of a YAML file of nested mappings, e.g. ("gateway", "hook"); {} if it is not there.

    Only indented `key: value` lines, comments and blank lines are read; lists and other YAML are passed over.
    """
    (whole,) = spark.read.text(path, wholetext=True).first() or ("",)
    found: dict = {}
    above: list[tuple[int, str]] = []
    for line in whole.splitlines():
        bare = re.sub(r"(^|\s)#.*$", "", line).rstrip()
        key, colon, value = bare.strip().partition(":")
        if not colon or bare.lstrip().startswith("-"):
            continue
        depth = len(bare) - len(bare.lstrip())
        while above and above[-1][0] >= depth:
            above.pop()
        if value.strip() == "":
            above.append((depth, key.strip()))
        elif tuple(name for _, name in above) == section:
            found[key.strip()] = plain_value(value)
    return found


def write_texts(df: DataFrame, folder: str, text: str = "text") -> None:
    """One text a row, as text files."""
    df.select(F.col(text).alias("value")).write.text(folder)


def json_reports(df: DataFrame, *columns: str) -> DataFrame:
    """Adds `report`, the columns as one JSON object."""
    return df.withColumn("report", F.to_json(F.struct(*columns)))


def unified_diff(before: str, after: str):
    """Column: unified diff of two text columns, line by line."""
    @F.pandas_udf("string")
    def diff(a: pd.Series, b: pd.Series) -> pd.Series:
        lines = lambda t: (t or "").splitlines(keepends=True)
        return pd.Series(["".join(difflib.unified_diff(lines(x), lines(y), "original", "rewritten")) for x, y in zip(a, b, strict=True)])

    return diff(before, after)
