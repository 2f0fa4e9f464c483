"""Source divergence, filter interaction and quality rules against brute force; the byte scanner against Python."""

import collections
import itertools
import random
import re
import time

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tonewright.llm import byte_scan, filter_audit, html_tree, line_quality, source_audit
from tonewright.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TEXTS = [None, "", " ", "\n\n", "a", "É x \x0b\x1cy", "日本語 テキスト", "A" * 700_000 + " b", "word " * 120_000, "Ab#", "x\ny\nx\n", "\U0001f600 a \U0001f600 b \U0001f600 a", "a\x00b a\x00c"]


def frame(spark, rows):
    """Rows of doc_id, text, lang, source, with columns named like the operators' own."""
    made = [(i, t, lang, s, 1, "m", 2.0, [3]) for i, t, lang, s in rows]
    return spark.createDataFrame(made, "doc_id long, text string, lang string, source string, h1 int, mask string, n double, lines array<int>")


def messy(rng, count=160):
    vocabulary = ["Alpha", "beta", "GAMMA", "delta#", "é", "of", "the", "und", "x1y", "%"]
    pool = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 150))) for _ in range(30)]
    lines = ["Home | About | Contact 3", "home  | about | contact 7", "All rights reserved"]
    rows = []
    for i in range(count):
        text = rng.choice([rng.choice(pool), "\n".join(rng.sample(lines, 2) + [rng.choice(pool)]), rng.choice([None, "", "Same TEXT " * 60])])
        rows.append((rng.choice([i, i, 3, None]), text, rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s1", "s2", "s3", None])))
    return rows


def test_scan_of_bytes():
    texts = pa.array([t for t in TEXTS if t is None or len(t) < 1000])
    for limit in (1, 20, 10**6):
        found = []
        for start, end, data, offsets in byte_scan.text_bytes(texts, limit):
            inside = byte_scan.WORD_BYTES[data]
            begins, ends, before = byte_scan.runs(inside, offsets)
            words = byte_scan.run_strings(data, inside, begins, ends).to_pylist()
            found += [words[a:b] for a, b in itertools.pairwise(before)]
        assert found == [WORD.findall(t or "") for t in texts.to_pylist()]


def test_word_hashes_do_not_depend_on_the_block():
    words = [b"a", b"ab", b"long" * 70_000, b"ab", b"tail"]
    data = np.frombuffer(b" ".join(words), np.uint8)
    begins, ends, _ = byte_scan.runs(byte_scan.WORD_BYTES[data], np.array([0, len(data)]))
    together = byte_scan.run_hashes(data, begins, ends)
    alone = [int(byte_scan.run_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0]) for w in words]
    assert together.tolist() == alone and len(set(alone)) == 4


def brute_counts(text):
    words = WORD.findall(text or "")
    return (len(words), len(set(words)), sum("A" <= c <= "Z" for c in text or ""), sum(c in "#$%&*|" for c in text or ""), len(text or ""))


def test_counts_of_whole_texts():
    found = list(zip(*(x.tolist() for x in filter_audit.counts(pa.array(TEXTS))), strict=True))
    assert found == [brute_counts(t) for t in TEXTS]


def test_equal_hashes_of_unequal_words_are_told_apart():
    texts = ["a b c a", "b b", "", "c d"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    begins, ends, before = byte_scan.runs(byte_scan.WORD_BYTES[data], np.cumsum([0, *map(len, texts)]))
    found = filter_audit.distinct_words(data, begins, ends, before, hashed=lambda d, b, e: np.zeros(len(b), np.uint64))
    assert found.tolist() == [len(set(t.split())) for t in texts]


def brute_interactions(rows, labels):
    good = {i for i, q, t in labels if q == 1 and i is not None}
    toxic = {i for i, q, t in labels if t == 1 and i is not None}
    ids = collections.defaultdict(set)
    for i, t, *_ in rows:
        if i is not None:
            ids[t or ""].add(i)
    parts = collections.defaultdict(list)
    for i, t, lang, _ in rows:
        n, distinct, capitals, symbols, points = brute_counts(t)
        fails = {"A": n < 100, "B": 100 * distinct < 80 * n, "C": 100 * capitals > 10 * points, "D": symbols > 0, "E": i is not None and min(ids[t or ""]) < i}
        parts[lang or ""].append(({f for f in fails if fails[f]}, i in good, i in toxic))
    out, removed_in_all = {}, collections.Counter()
    for part, docs in parts.items():
        for order in map("".join, itertools.permutations("ABCDE")):
            left = list(docs)
            for step, f in enumerate(order):
                goes = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                removed_in_all[part, f] += len(goes)
                late = sum(f in d[0] for d in docs) - len(goes)
                out[part, order, step + 1] = [len(left), len(goes), late, sum(d[0] == {f} for d in docs), sum(d[1] for d in goes), sum(d[2] for d in goes)]
    return {k: (*v, removed_in_all[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_filter_interactions(spark):
    rng = random.Random(2)
    rows = messy(rng)
    rows += [(1000 + i, "the same words again", "en", "s1") for i in range(60)] + [(7, None, None, None)] * 3 + [(2000, " ".join(f"w{i}" for i in range(200)), "en", "s")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 1100, 3)] + [(3, 1, 0), (3, 0, 1), (None, 1, 1)]
    marks = spark.createDataFrame([(*x, "en") for x in labels], "doc_id long, quality int, toxic int, part string")
    found = filter_audit.interactions(frame(spark, rows), marks).collect()
    assert {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in found} == brute_interactions(rows, labels)
    assert len(found) == 600 * len({r[2] or "" for r in rows})
    assert filter_audit.interactions(frame(spark, rows).limit(0), marks).count() == 0
    assert filter_audit.interactions(frame(spark, rows[:5]), marks.limit(0)).count() > 0


def brute_quality(rows, max_docs, max_share, least):
    digits = str.maketrans("123456789", "000000000")
    normal = lambda line: " ".join(WORD.findall(line)).translate(ASCII_LOWER).translate(digits)
    holders, hosts = collections.defaultdict(set), collections.defaultdict(set)
    for i, t, _, s in rows:
        hosts[s or ""].add(i)
        for line in (t or "").split("\n"):
            if WORD.search(line):
                holders[s or "", normal(line)].add(i)
    out = []
    for i, t, _, s in rows:
        text = t or ""
        words = WORD.findall(text)
        windows = collections.Counter(itertools.pairwise(itertools.pairwise(words)))
        repeated = {k + j for k, w in enumerate(itertools.pairwise(itertools.pairwise(words))) if windows[w] > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        gone = sum(len(WORD.findall(x)) for x in lines if len(holders[s or "", normal(x)]) > max(max_docs, max_share * len(hosts[s or ""])))
        failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
        kept = not failed and len(words) - gone >= least * len(words)
        out.append((i, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated), failed, gone, kept))
    return collections.Counter(out)


def test_quality_rules(spark):
    rng = random.Random(5)
    body = [" ".join(f"w{rng.randrange(4000)}" for _ in range(70)) for _ in range(60)]
    rows = messy(rng) + [(500 + i, f"Page {i} of {i * 7}\n" + " ".join(["menu"] + [f"m{k}" for k in range(65)]) + "\n" + b.replace(" ", "\n" if i % 9 == 0 else " "), "en", "s1") for i, b in enumerate(body)]
    rows += [(900 + i, " ".join(f"m{k}" for k in range(80)) + "\nshort tail", "en", "s1") for i in range(40)] + [(i, t, "en", "s4") for i, t in enumerate(TEXTS)] + [(None, None, None, None), rows[-1], rows[-1]]
    for limits in ((10, 0.05, 0.5), (3, 0.0, 0.9)):
        found = line_quality.judge(frame(spark, rows), *limits).collect()
        assert collections.Counter(map(tuple, found)) == brute_quality(rows, *limits)
        assert {r.kept for r in found if not r.base_failed} == {True, False}
    assert line_quality.judge(frame(spark, rows).limit(0)).count() == 0


def test_lines_of_many_words_hash_alike():
    for n in (3, 70_000):
        line = " ".join(f"w{i}" for i in range(n)).encode()
        data = np.frombuffer(line + b"\nx\n" + line.upper().replace(b" ", b"\t "), np.uint8)
        _, sizes, h1, h2, words = line_quality.scan_block(data, np.array([0, len(line) + 3, len(data)]))
        assert sizes.tolist() == [2, 1] and n in words.tolist()
        assert len(set(h1.tolist())) == len(set(h2.tolist())) == 2


def brute_divergence(rows, min_docs, top):
    held, groups = collections.Counter(), collections.defaultdict(collections.Counter)
    for _, t, lang, s in rows:
        terms = TERM.findall((t or "").translate(ASCII_LOWER))
        groups[lang or "", s or ""].update(terms)
        held.update((lang or "", x) for x in set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [x for (name, x), d in held.items() if name == lang and d >= min_docs]
        own = {s: c for (name, s), c in groups.items() if name == lang}
        whole = sum(own.values(), collections.Counter())

        def shares(counts, kept=kept):
            total = sum(counts[x] for x in kept) + 5 * len(kept)
            return {x: 1 + 10**9 * (counts[x] + 5) // total for x in kept}

        p, q = {s: shares(c) for s, c in own.items()}, shares(whole)
        for s in own:
            pairs = [(-sum(abs(p[s][x] - p[o][x]) for x in kept), o.encode(), o) for o in own if o != s]
            terms = [(q[x] - p[s][x], x.encode(), x) for x in kept if own[s][x] and p[s][x] > q[x]]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item, -v, rank) for rank, (v, _, item) in enumerate(items, 1)]
    return sorted(out)


@pytest.mark.parametrize("min_docs,top,finish", [(4, 5, 1000), (2, 3, 2), (1, 50, 1), (200, 5, 10)])
def test_source_divergence(spark, min_docs, top, finish):
    rng = random.Random(8)
    names = ["ab", "abc", "abcd", "abd", "é", "éa", "日本", "日本語", "\U0001f600", "zz", *(f"t{chr(97 + i)}{chr(97 + j)}" for i in range(5) for j in range(5))]
    rows = messy(rng, 120)
    rows += [(i, " ".join(rng.choices(names, k=rng.randrange(12))).replace("ta", "TA"), rng.choice(["en", "de"]), rng.choice(["s1", "s1", "s2", "s3", "ß", ""])) for i in range(150)]
    rows += [(i, " ".join(names), "tie", s) for i in range(3) for s in ("a", "b")] + [(9, "word", "one", "only"), (9, None, "one", "none"), (9, "123 _", None, None)]
    found = source_audit.divergence(frame(spark, rows), min_docs, top, finish).collect()
    assert sorted((r.lang, r.source, r.part, r["item"], r.value, r["rank"]) for r in found) == brute_divergence(rows, min_docs, top)


def test_divergence_of_nothing(spark):
    assert source_audit.divergence(frame(spark, messy(random.Random(1), 3)).limit(0)).count() == 0


def test_largest_rows_with_many_ties(spark):
    rng = random.Random(4)
    items = sorted({"".join(rng.choice("abé") for _ in range(rng.randrange(1, 7))) for _ in range(300)})
    rows = [(g, x, 7 if g == "tied" else rng.choice([1, 7, 2**30 - 1])) for g in ("tied", "mixed", "few") for x in items[: 4 if g == "few" else None]]
    df = spark.createDataFrame(rows, "g string, item string, value long")
    for k, finish in ((10, 1), (37, 2), (120, 50)):
        found = sorted((r.g, r["rank"], r["item"]) for r in source_audit.largest(df, ["g"], k, finish).collect())
        want = [(g, n + 1, x) for g in ("few", "mixed", "tied") for n, (_, x, _) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1].encode()))[:k])]
        assert found == want


def test_shares_are_exact(spark):
    from pyspark.sql import functions as F

    rng = random.Random(3)
    cases = [(rng.randrange(10**k), rng.randrange(10**k, 9 * 10**k), rng.randrange(1, 10**6)) for k in range(1, 15) for _ in range(20)] + [(0, 0, 1)]
    df = spark.createDataFrame(cases, "c long, n long, v long")
    for r in df.withColumn("p", source_audit.share(F.col("c"), F.col("n"), F.col("v"))).collect():
        assert r.p == 1 + 10**9 * (r.c + 5) // (r.n + 5 * r.v)


@pytest.mark.parametrize("name", ["op11_source_divergence", "op12_filter_audit", "op13_line_quality"])
def test_queries_agree_with_their_sql(spark, name):
    connection = duckdb.connect()
    for table in ("documents", "labels"):
        connection.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    frame = QUERIES[name](spark, SF)
    names = sorted(frame.columns)
    want = connection.sql(f"SELECT {', '.join(names)} FROM ({SQL[name]})").fetchall()
    assert collections.Counter(map(tuple, frame.select(*names).collect())) == collections.Counter(want)


HOSTILE = {
    "quotes": "<a b=\"'", "pairs": '<a "x ', "open": "<a ", "no end": "<aaaa", "buttons": "<p><button><div>", "cells": "<div><td>", "items": "<li><div>", "ends": "<b><div></b>",
    "comments": "<!-- ", "bare": "<", "attributes": "<a xx xx", "bodies": "<div><body>",
}


@pytest.mark.parametrize("bit", HOSTILE.values(), ids=HOSTILE)
def test_pages_without_closings_take_linear_time(bit):
    times = []
    for size in (50_000, 500_000):
        began = time.process_time()
        html_tree.parse("<p>text</p>" + bit * (size // len(bit)) + ("y=z>" if bit.endswith("xx") else ""))
        times.append(time.process_time() - began)
    assert times[1] < 20 * max(times[0], 0.1)


def test_tags_end_outside_quotes():
    page = html_tree.parse("<p title=\"a>b\">one<a href='>'>two</a></p><div class='x'>three<img src=\"unclosed>four</div>")
    assert [t for t in page.text if t] == ["one", "two", 'three<img src="unclosed>four']
    assert page.names[page.tag.index("div")] == ("x",)
