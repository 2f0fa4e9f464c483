"""Registered queries: names match, results are not constant, checks agree with Spark on a few of them."""

import collections
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
SOME = ["rl03_mechanical", "ps05_forced_triads", "ps36_absolute_claim", "ps27_over_colloquial", "sc05_score", "dt02_symmetry", "pf06_professionalism", "sn06_scene", "wm05_watermark", "dd06_exact_copies", "rw14_delete_p12"]


def test_checks_have_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert len(__spark_entry__.queries()) > 120


@pytest.mark.parametrize("gone", [["tonewright/llm", "tests/llm"], ["tonewright/llm", "tests/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_queries_without_the_training_data_operators(tmp_path, gone):
    """The rest registers its queries whichever of the optional parts are deleted."""
    root = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
    copy = shutil.copytree(root, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse"))
    for path in gone:
        shutil.rmtree(copy / path) if (copy / path).is_dir() else (copy / path).unlink(missing_ok=True)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q); print(len(q), 'pipeline' in q, any(n.startswith('op1_') for n in q))"
    env = os.environ | {"PYTHONPATH": str(copy)}
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    count, pipeline, operators = done.stdout.split()
    assert int(count) > 120 and pipeline == "False"
    assert operators == str((copy / "tonewright/llm").exists())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", SOME)
def test_query_agrees_with_check(spark, name):
    frame = __spark_entry__.queries()[name](spark, SF)
    connection = duckdb.connect()
    connection.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    names = sorted(frame.columns)
    want = connection.sql(f"SELECT {', '.join(names)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
    got = [tuple(r) for r in frame.select(*names).collect()]
    plain = lambda rows: collections.Counter(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows)
    assert plain(got) == plain(want)
    assert len(set(got)) > 1
