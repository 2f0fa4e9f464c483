"""Near-duplicates, line dedup, search, classifiers, extraction and the pipeline against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tonewright.llm import ann_forest, html_tree, langid_ecoc, line_runs, simhash_pivot, toxicity_cnn

SF = "/root/testdata/sf0.001"


def brute_fingerprint(text, k=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, radius=2):
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and bin(fps[a] ^ fps[b]).count("1") <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("limit", [512, 2])
def test_simhash_components(spark, limit):
    rng = random.Random(4)
    base = [" ".join(rng.choice("ab cd ef gh ij kl mn op".split()) + str(rng.randint(0, 9)) for _ in range(60)) for _ in range(6)]
    texts = [None, "", "one", "one two", " \t", *base]
    for t in base:
        for _ in range(8):
            words = t.split()
            words[rng.randrange(len(words))] = "zz"
            texts.append(" ".join(words))
    rows = [(i * 3 + 1, t, 0, "c") for i, t in enumerate(texts)] + [(1, None, 0, "c"), (None, base[0], 0, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int, component_id string")
    found = simhash_pivot.near_duplicates(df, bin_limit=limit).collect()
    assert len(found) == len(rows)
    fps = {i: brute_fingerprint(t) for i, t, *_ in rows if i is not None}
    want = brute_components(fps)
    for r in found:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert r.fingerprint == f"{fps[r.doc_id]:016x}" and r.component_id == want[r.doc_id]
    assert len(set(want.values())) < len(want) - 3
    assert simhash_pivot.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("limit", [512, 1])
def test_links_on_dense_fingerprints(spark, limit):
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 2**63, 5, dtype=np.uint64)
    fps = {int(s) ^ (1 << int(a)) ^ (1 << int(b)) for s in seeds for a, b in rng.integers(0, 63, (40, 2))} | {int(x) for x in rng.integers(0, 2**63, 50, dtype=np.uint64)}
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    roots = {r.node: r.root for r in simhash_pivot.components(simhash_pivot.links(df, bin_limit=limit)).collect()}
    want = brute_components({x: x for x in fps})
    assert {x: roots.get(x, x) for x in fps} == want


def test_pivots_discard_no_link():
    rng = np.random.default_rng(5)
    references = simhash_pivot.pivots()
    x = rng.integers(0, 2**63, 200, dtype=np.uint64)
    y = x ^ (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64))
    gap = np.abs(simhash_pivot.distances(x, references).astype(int) - simhash_pivot.distances(y, references).astype(int))
    assert gap.max() <= 1


def brute_lines(rows):
    docs = {}
    for i, text in rows:
        docs.setdefault((2**63 if i is None else i), []).append((text or "").split("\n"))
    strip = " \t\n\x0b\x0c\r"
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    owner = {}
    for i in sorted(docs):
        for lines in docs[i]:
            for line in lines:
                key = line.strip(strip).translate(lower)
                if len(key) >= 10:
                    owner.setdefault(key, i)
    out = []
    for i, copies in docs.items():
        for lines in copies:
            kept = [x for x in lines if owner.get(x.strip(strip).translate(lower), i) == i]
            out.append((None if i == 2**63 else i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("batches,fanout", [(4, 2), (1, 2), (7, 3)])
def test_line_dedup(spark, batches, fanout):
    rng = random.Random(batches)
    pool = ["Shared Line Number %d" % i for i in range(12)] + ["short", "", "  Padded shared LINE \t", "ÉCOLE de la ville", "école de la ville"]
    rows = [(rng.randrange(40), "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 9)))) for _ in range(60)]
    rows += [(3, None), (5, ""), (None, "Shared Line Number 1\nonly here, once"), (6, "Only in six, twice\nonly in six, TWICE"), (9, "\n".join(["Shared Line Number 2"] * 3000))]
    rows += [rows[0], rows[0]]
    df = spark.createDataFrame([(i, t, "x", 7) for i, t in rows], "doc_id long, text string, mark string, doomed int")
    out = line_runs.drop_lines(df, batches=batches, fanout=fanout)
    assert out.columns == ["doc_id", "text", "mark", "doomed", "n_lines", "n_dropped"]
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in out.collect()), key=str)
    assert got == brute_lines(rows)
    assert line_runs.drop_lines(df.limit(0)).count() == 0
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_")]


def brute_nearest(rows, k):
    good = [(i, np.array(v, float)) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) and len(v) == 8]
    out = {}
    for i, v in good:
        if i % 20 == 0:
            out[i] = sorted((-float(v @ w), j) for j, w in good if j != i)[:k]
    return out


def test_search_is_exact_when_all_leaves_are_visited(spark):
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(300)]
    rows += [(1000 + 20 * i, rows[40][1]) for i in range(40)]  # many copies
    rows += [(400, None), (420, [0.0] * 8), (440, [float("nan")] * 8), (460, [1.0, None] + [0.0] * 6), (480, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, label int")
    found = ann_forest.nearest(df, F.col("vec_id") % 20 == 0, 20, trees=3, leaf_rows=16, target=1.0, slice_rows=32).collect()
    want = brute_nearest(rows, 20)
    got = {}
    for r in sorted(found, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == set(want)
    for q, hits in want.items():
        assert [h[0] for h in got[q]] == [j for _, j in hits]
        assert np.allclose([h[1] for h in got[q]], [-s for s, _ in hits])
    few = ann_forest.nearest(df.filter("vec_id < 5"), F.col("vec_id") == 0, 20)
    assert few.count() == 4
    assert ann_forest.nearest(df.limit(0), F.lit(True)).count() == 0
    assert ann_forest.nearest(df.filter("vec_id = 0"), F.lit(True)).count() == 0


def test_search_ties_of_different_vectors(spark):
    rng = np.random.default_rng(11)
    rows = [(int(i), rng.integers(0, 3, 8).astype(float).tolist()) for i in rng.permutation(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = ann_forest.nearest(df, F.col("vec_id") % 20 == 0, 5, trees=3, leaf_rows=2000, target=1.0).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {q: [j for _, j in hits] for q, hits in brute_nearest(rows, 5).items()}


@pytest.mark.parametrize("kind", ["clustered", "uniform", "long and short"])
def test_search_recall_of_the_forest(spark, kind, monkeypatch):
    """The forest alone finds 9 in 10 of the nearest without visiting the whole table."""
    rng = np.random.default_rng(17)
    n, dims = 12_000, 24
    vectors = rng.normal(size=(n, dims))
    if kind == "clustered":
        vectors = rng.normal(size=(60, dims))[rng.integers(0, 60, n)] + 0.15 * vectors
    if kind == "long and short":
        vectors *= rng.lognormal(0, 0.5, (n, 1))
    vectors = vectors.astype(np.float32).astype(float)
    shares, own = [], ann_forest.Forest.share_for
    monkeypatch.setattr(ann_forest.Forest, "share_for", lambda self, *a: shares.append(own(self, *a)) or shares[-1])
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors.tolist())], "vec_id long, embedding array<double>")
    found = ann_forest.nearest(df, F.col("vec_id") % 200 == 0, 20).groupBy("query_id").agg(F.collect_list("vec_id").alias("v"), F.max("rank").alias("n")).collect()
    assert len(found) == n // 200 and all(r.n == 20 == len(set(r.v)) for r in found)
    hits = 0
    for r in found:
        scores = vectors @ vectors[r.query_id]
        scores[r.query_id] = -np.inf
        hits += len(set(np.argsort(-scores, kind="stable")[:20].tolist()) & set(r.v))
    assert hits >= 0.9 * 20 * len(found)
    assert shares[0] < {"clustered": 0.1, "uniform": 0.5, "long and short": 0.5}[kind]


def test_search_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in df.collect()]
    vectors, ids = np.array([v for _, v in rows], float), np.array([i for i, _ in rows])
    found = ann_forest.nearest(df, F.col("vec_id") % 20 == 0).groupBy("query_id").agg(F.collect_list("vec_id").alias("v")).collect()
    hits = total = 0
    for r in found:
        i = int(np.flatnonzero(ids == r.query_id)[0])
        scores = vectors @ vectors[i]
        scores[i] = -np.inf
        hits += len(set(ids[np.lexsort((ids, -scores))[:20]].tolist()) & set(r.v))
        total += 20
    assert hits / total >= 0.9


def test_search_ignores_clashing_columns(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding").limit(60)
    clashing = df.select("*", *[F.lit("x").alias(c) for c in ("v", "ids", "k1", "query_id", "rank", "score", "tree", "leaf")])
    search = lambda d: sorted(map(tuple, ann_forest.nearest(d, F.col("vec_id") % 20 == 0, 5, target=1.0).collect()))
    assert search(clashing) == search(df) != []


def words(rng, stems, n):
    return " ".join("".join(rng.choice(stems) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_language_id(spark):
    rng = random.Random(1)
    stems = {"aa": "ka lo mi ter".split(), "bb": "sch ung ein keit".split(), "cc": "éa oui elle ç".split()}
    rows = [(i, words(rng, stems[name], rng.randint(3, 60)), name, "s", 0.5) for i, name in enumerate(rng.choice(list(stems)) for _ in range(240))]
    rows += [(900, None, "aa", "s", 0.1), (901, "", "bb", "s", 0.1), (902, "123 !? ½²", "cc", "s", 0.1), (903, "ka lo mi", None, "s", 0.1), (3, rows[3][1], rows[3][2], "s", 0.1), (None, rows[4][1], rows[4][2], "s", 0.1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double")
    model = langid_ecoc.train(langid_ecoc.training_rows(df, F.col("doc_id") % 3 != 1))
    assert model.languages == ["aa", "bb", "cc"]
    out = langid_ecoc.identify(df, model).collect()
    assert len(out) == len(rows)
    by_id = {r.doc_id: r for r in out}
    for i in (900, 901, 902):
        assert by_id[i].lang_pred == "und" and by_id[i].score == 0
    held = [(by_id[i].lang_pred == name) for i, _, name, *_ in rows if i is not None and i < 240 and i % 3 == 1]
    assert np.mean(held) > 0.97
    assert all(0 <= r.score <= 1 for r in out)
    nothing = langid_ecoc.train(langid_ecoc.training_rows(df.limit(0), F.lit(True)))
    assert {r.lang_pred for r in langid_ecoc.identify(df, nothing).collect()} == {"und"}
    distance = langid_ecoc.codewords(4)
    assert min((distance[a] != distance[b]).sum() for a in range(4) for b in range(a)) >= 5


def test_decoding_is_loss_weighted():
    """Distances, the nearest codeword, its score and the ambiguity flag, added up bit by bit."""
    rng = np.random.default_rng(4)
    code = langid_ecoc.codewords(4)
    bits = code.shape[1]
    model = langid_ecoc.LanguageModel(list("abcd"), code, rng.normal(0, 3, (langid_ecoc.FEATURES, bits)).astype(np.float32), rng.normal(size=bits).astype(np.float32), rng.uniform(0.1, 3, bits))
    texts = ["ka lo mi", "schung ein", "élan voilà", "ter an sol ve ri", "x"]
    names, scores, unsure = model.predict([*texts, "", None, "12 !?"])
    for i, text in enumerate(texts):
        x = langid_ecoc.features(text)
        margins = [float(x @ model.weights[:, b] + model.bias[b]) for b in range(bits)]
        away = [sum(model.trust[b] * np.log1p(np.exp(-margins[b] * code[k, b])) for b in range(bits)) / sum(model.trust) for k in range(4)]
        assert np.allclose(model.distances(x[None])[0], away, rtol=1e-4)
        near = int(np.argmin(away))
        energy = [np.exp(-(a - min(away)) * bits / 2) for a in away]
        assert names[i] == "abcd"[near] and abs(scores[i] - 1 / sum(energy)) < 1e-3
        assert unsure[i] == (sorted(away)[1] - min(away) < langid_ecoc.AMBIGUOUS_GAP)
    assert names[5:] == ["und"] * 3 and scores[5:] == [0.0] * 3


def test_convolutions_and_pooling():
    """Logits of the classifier against windows multiplied out one by one."""
    rng = np.random.default_rng(6)
    size = len(toxicity_cnn.KERNELS) * toxicity_cnn.FILTERS
    filters = [rng.normal(size=(k, toxicity_cnn.WIDTH, toxicity_cnn.FILTERS)).astype(np.float32) for k in toxicity_cnn.KERNELS]
    model = toxicity_cnn.ToxicityModel(rng.normal(size=(toxicity_cnn.BUCKETS, toxicity_cnn.WIDTH)).astype(np.float32), filters, rng.normal(size=size), rng.normal(size=size), 0.3)
    texts = ["one two three four five", "one", "Two two, two!", "", None, "a b", "one two " * 50]
    raw, _ = model.logits(texts)
    for text, got in zip(texts, raw, strict=True):
        vectors = [sum(model.embedding[b] for b in toxicity_cnn.buckets(w)) for w in toxicity_cnn.WORD.findall((text or "").lower())]
        pooled = []
        for k, own in zip(toxicity_cnn.KERNELS, filters, strict=True):
            padded = vectors + [np.zeros(toxicity_cnn.WIDTH)] * max(0, k - len(vectors))
            windows = [sum(padded[i + j] @ own[j] for j in range(k)) for i in range(len(padded) - k + 1)]
            pooled += np.max(windows, axis=0).tolist()
        assert abs(got - (np.maximum(np.array(pooled) + model.bias, 0) @ model.out + model.shift)) < 1e-3


def test_training_decides(spark):
    """From noise, which is where training starts unless asked otherwise, held-out loss falls by training alone."""
    rng = random.Random(12)
    clean = "ka lo mi ter an sol ve ri".split()
    rows = []
    for _ in range(1500):
        text, toxic = words(rng, clean, rng.randint(10, 60)).split(), int(rng.random() < 0.4)
        text.insert(rng.randrange(len(text)), "vilo" + rng.choice(clean) if toxic else "dolu" + rng.choice(clean))
        rows.append((" ".join(text), "aa", toxic))
    held, y = rows[1200:], np.array([r[2] for r in rows[1200:]])
    for log_odds in (True, False):
        losses = []
        for epochs in (0, 12):
            p = np.clip(toxicity_cnn.train(rows[:1200], 0.4, epochs=epochs, log_odds=log_odds).score([t for t, _, _ in held]), 1e-6, 1 - 1e-6)
            losses.append(float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()))
        assert losses[1] < 0.2 * losses[0] and np.mean((p >= 0.5) == y) > 0.97
    assert losses[0] > 0.5  # untrained noise knows nothing


def test_toxicity(spark):
    rng = random.Random(2)
    clean = "ka lo mi ter an sol ve ri".split()
    rows, labels = [], []
    for i in range(500):
        text = words(rng, clean, rng.randint(5, 80)).split()
        toxic = int(rng.random() < 0.3)
        for _ in range(2 * toxic):
            text.insert(rng.randrange(len(text)), "vilo" + rng.choice(clean))
        rows.append((i, " ".join(text), rng.choice(["aa", "bb", None]), "s"))
        labels.append((i, 1, toxic))
    rows += [(900, None, "aa", "s"), (901, "", "aa", "s"), (902, "ka " * 60000 + "viloka viloter", "aa", "s"), (1, rows[1][1], "aa", "s"), (None, "ka", "aa", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, predicted string")
    marks = spark.createDataFrame([*labels, (5, 0, None), (None, 0, 1), (99999, 0, 1)], "doc_id long, quality int, toxic int")
    sample, share = toxicity_cnn.training_rows(df, marks, F.col("doc_id") % 5 != 0)
    model = toxicity_cnn.train(sample, share, epochs=6, log_odds=True)
    out = toxicity_cnn.score_documents(df, model).collect()
    assert len(out) == len(rows)
    by_id = {r.doc_id: r for r in out}
    held = [by_id[i].predicted == y for i, _, y in labels if i % 5 == 0]
    assert np.mean(held) > 0.95
    assert by_id[902].predicted == 1 and by_id[901].predicted == by_id[900].predicted == 0
    assert all(0 <= r.score <= 1 for r in out)
    sample, share = toxicity_cnn.training_rows(df, marks.limit(0), F.lit(True))
    assert {r.score for r in toxicity_cnn.score_documents(df, toxicity_cnn.train(sample, share)).collect()} == {0.0}


PAGE = (
    "<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>About</a></li></ul></nav>"
    "<div class='ad'>Buy this now, please do. It is cheap.</div><article><h1>Head &amp; tail</h1><p><b>First words of it.<br><p>Second   paragraph,\nwith <a href='/x'>a link</a> and more text in it.</p>"
    "<script>var x = '</p>';</script><ul><li>one thing</li><li>another thing</li></ul></article>"
    "<section class='comments'><h3>Comments</h3><div class='comment'><b>Bob</b><p>I like this page very much, thank you.</p></div></section><footer>&copy; 2020 Somebody. All rights kept.</footer></body></html>"
)


def test_extraction(spark):
    rows = [(1, "u", PAGE, "t"), (2, None, None, "t"), (3, "u", "", "t"), (4, "u", PAGE[: PAGE.index("another")] + "ano</l", "t"), (1, "u", PAGE, "t"), (5, "u", "<div>" * 3000 + "deep", "t"), (6, "u", "<p <p & <", "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = html_tree.extract_pages(df).collect()
    assert len(out) == len(rows)
    by_id = {r.page_id: r for r in out}
    assert by_id[1].text.split("\n\n") == ["Head & tail", "First words of it.", "Second paragraph, with a link and more text in it.", "one thing", "another thing"]
    assert by_id[1].n_chars == len(by_id[1].text)
    assert by_id[2].text == by_id[3].text == ""
    assert by_id[4].text.endswith("one thing\n\nano")
    assert html_tree.extract_pages(df.limit(0)).count() == 0


STORY = "This is a paragraph of the story with enough words in it to be read as prose, and it goes on for a while, as paragraphs do."
#: Pages written by hand, none of them by the grammar the model learns from, and their main texts.
BY_HAND = [
    (
        f"<html><body><header><a href=/>Site</a> <a href=/x>News</a></header><div id=main><article><h2>The title of it</h2><p>{STORY}</p><p>{STORY} <math><mi>x</mi>=<mn>2</mn></math></p>"
        f"<noscript>Shown without scripts too.</noscript></article><aside class=sidebar><h3>Related</h3><ul><li><a href=1>One link</a></li><li><a href=2>Two link</a></li></ul></aside></div>"
        f"<section id=comments><h3>Comments</h3><div class=comment><p>Nice story, thanks a lot for it.</p></div></section><footer>Copyright 2020</footer></body></html>",
        ["The title of it", STORY, STORY + " x=2", "Shown without scripts too."],
    ),
    (
        f"<body><div class='topbar menu'><a href=a>Home</a><a href=b>About</a></div><div class='cookie-notice'>We use cookies. <button>OK</button></div><div class=content><div class=post-body><h1>Another title</h1><p>{STORY}</p>"
        f"<ul><li>first point of the list here</li><li>second point</li></ul><p>{STORY}</p></div></div><div class='ad-banner'>Buy our great shoes now!</div><form><label>Email</label><input><button>Send</button></form><div class=footer>Imprint | Privacy</div></body>",
        ["Another title", STORY, "first point of the list here", "second point", STORY],
    ),
    (
        f"<body><nav class=crumbs><a href=1>a</a> / <a href=2>b</a></nav><main><h1>Third title</h1><p>{STORY}</p><blockquote>{STORY}</blockquote><table><tr><td>cell one</td><td>cell two</td></tr></table><pre>code  here</pre></main>"
        "<div class=share><a href=x>Share</a><a href=y>Tweet</a></div></body>",
        ["Third title", STORY, STORY, "cell one", "cell two", "code here"],
    ),
]


@pytest.mark.parametrize("page,blocks", BY_HAND)
def test_pages_by_hand(page, blocks):
    (text,) = html_tree.extract([page], html_tree.trained_model())
    assert text.split("\n\n") == blocks


def test_deep_and_unclosed_pages_end():
    import time

    began = time.perf_counter()
    deep = ["<div>" * 20_000 + "deep" + "</div>" * 20_000, "<b>" * 20_000 + "x" + "</i>" * 20_000, "<p>" * 30_000 + "y", "<ul>" + "<li><a href='x'>z</a>" * 20_000]
    for page in deep:
        assert len(html_tree.parse(page).parent) > 20_000
    assert time.perf_counter() - began < 20


def test_marginals_are_exact():
    """Sum-product against the sum over all labellings of a small tree."""
    page = html_tree.parse("<div class='a'><p>x y</p><span>z</span></div>")
    forest = html_tree.assemble([page])
    rng = np.random.default_rng(1)
    model = html_tree.TreeModel(rng.normal(size=html_tree.BUCKETS), rng.normal(size=(3, html_tree.DENSE)), rng.normal(size=(len(html_tree.KINDS), 2, 2)))
    n = len(page.parent)
    unary = np.bincount(forest.rows, model.sparse[forest.columns], n) + (forest.dense * model.dense[np.minimum(forest.kind, 2)]).sum(1)
    total, each = 0.0, np.zeros(n)
    for mask in range(1 << n):
        y = [(mask >> i) & 1 for i in range(n)]
        weight = np.exp(sum(unary[i] * y[i] for i in range(n)) + sum(model.edges[forest.kind[i], y[p], y[i]] for i, p in enumerate(page.parent) if p >= 0))
        total += weight
        each += weight * np.array(y)
    assert np.allclose(model.marginals(forest)[0], each / total)


def test_held_out_pages():
    model = html_tree.trained_model()
    pages = [html_tree.parse(p) for p in html_tree.labelled_pages(60, 321)]
    forest = html_tree.assemble(pages)
    gold = np.concatenate([html_tree.complete_labels(p) for p in pages])
    texts = (forest.kind == 0) & ~forest.skipped & (forest.dense[:, 1] > 0)
    assert (((model.marginals(forest)[0] >= 0.5) == gold)[texts]).mean() > 0.98


def shingle_set(text, k=5):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("slice_rows", [2048, 3])
def test_similar_documents(spark, slice_rows, monkeypatch):
    monkeypatch.setattr(simhash_pivot.wide_pairs, "__defaults__", (slice_rows,))
    rng = random.Random(9)
    base = [" ".join("w%d" % rng.randrange(3000) for _ in range(300)) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(base)] + [(900, None), (901, ""), (902, "one two"), (903, "one two"), (None, base[0])]
    for i, t in enumerate(base[:20]):  # near copies: one word in a hundred changed
        words_ = t.split()
        for k in (50, 150, 250):
            words_[k] = "changed"
        rows.append((100 + i, " ".join(words_)))
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, node string")
    found = {r.doc_id: r.component_id for r in simhash_pivot.similar_documents(df).collect()}
    assert set(found) == {i for i, _ in rows if i is not None}
    assert all(found[100 + i] == i for i in range(20)) and all(found[i] == i for i in range(40))
    assert found[900] == found[901] == 900 and found[902] == found[903] == 902
    assert simhash_pivot.similar_documents(df.limit(0)).count() == 0


def edited(rng, text, edits, apart=6):
    """The text with so many words replaced, at least `apart` words from each other and from both ends."""
    words_ = text.split()
    for k in rng.sample(range(1, len(words_) // apart - 1), edits):
        words_[k * apart] = "e%d" % rng.randrange(10**9)
    return " ".join(words_)


@pytest.mark.parametrize("length,edits", [(100, 2), (304, 6), (304, 5), (604, 13)])
def test_similar_pairs_all_meet(spark, length, edits):
    rng = random.Random(length + edits)
    base = [" ".join("w%d" % rng.randrange(30000) for _ in range(length)) for _ in range(100)]
    rows = [x for i, t in enumerate(base) for x in ((i, t), (1000 + i, edited(rng, t, edits)))]
    assert all(0.8 <= jaccard(shingle_set(a), shingle_set(b)) < 0.85 for (_, a), (_, b) in zip(rows[::2], rows[1::2], strict=True))
    found = {r.doc_id: r.component_id for r in simhash_pivot.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {i: i % 1000 for i, _ in rows}


@pytest.mark.parametrize("slice_rows", [1024, 7])
def test_similar_groups_of_variants(spark, slice_rows, monkeypatch):
    monkeypatch.setattr(simhash_pivot.wide_pairs, "__defaults__", (slice_rows,))
    rng = random.Random(5)
    rows = []
    for _ in range(15):
        text = " ".join("w%d" % rng.randrange(30000) for _ in range(304))
        rows += [(len(rows) + k, edited(rng, text, rng.choice([3, 4, 5]))) for k in range(30)]
    sets = [shingle_set(t) for _, t in rows]
    want = list(range(len(rows)))  # every root is the smallest of its component
    for a in range(len(rows)):
        for b in range(a - a % 30, a):
            if want[a] != want[b] and jaccard(sets[a], sets[b]) >= 0.8:
                low, high = sorted((want[a], want[b]))
                want = [low if x == high else x for x in want]
    assert 15 < len(set(want)) < len(rows)
    found = {r.doc_id: r.component_id for r in simhash_pivot.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == dict(enumerate(want))


def test_sets_differ_at_least_as_their_fingerprints_and_pivots_do():
    rng = np.random.default_rng(8)
    for n, edits in [(3, 1), (200, 30), (900, 200), (5000, 700)]:
        one = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        two = np.unique(np.concatenate([one[edits:], rng.integers(0, 2**63, edits * 2, dtype=np.uint64)]))
        members = len(np.setxor1d(one, two))
        a, b = (np.frombuffer(simhash_pivot.parities(x), np.uint64) for x in (one, two))
        words = min(len(a), len(b))
        bits = [int(np.bitwise_count(simhash_pivot.folded(a, w) ^ simhash_pivot.folded(b, w)).sum()) for w in (words, 16)]
        assert members >= bits[0] >= bits[1] >= int(simhash_pivot.pivot_differences(simhash_pivot.folded(a, 16), simhash_pivot.folded(b, 16)))
        far = rng.integers(0, 2**63, 16, dtype=np.uint64)
        assert simhash_pivot.pivot_differences(simhash_pivot.folded(a, 16), far) <= np.bitwise_count(simhash_pivot.folded(a, 16) ^ far).sum()


@pytest.mark.parametrize("size,rare", [(1, 1), (5, 0), (30, 30), (30, 4), (500, 500), (500, 150), (500, 90), (20000, 20000)])
def test_first_members_are_enough(size, rare):
    """The least favourable pair: all that differs is rare. Its chance of sharing no first member, by the ratio of each draw."""
    n = simhash_pivot.prefix_length(size, rare, 0.8)
    certain = size - -(-4 * size // 5) + 1
    assert 1 <= n <= certain
    if n < certain:
        differ, union = int(0.25 * size), rare
        chance = 1.0
        for k in range(n):
            chance *= max(0, differ - k) / (union - k)
        assert n <= rare and chance <= 1e-15
    assert simhash_pivot.prefix_length(20000, 20000, 0.8) < 30


def test_similar_documents_are_found_through_their_simhash(spark, monkeypatch):
    """Without any shared rare shingle to meet under, what the pivot table links is there."""
    rng = random.Random(12)
    rows = []
    for i in range(6):
        text = " ".join("w%d" % rng.randrange(30000) for _ in range(3000))
        rows += [(i, text), (100 + i, edited(rng, text, 1))]
    near = [i for i in range(6) if bin(simhash_pivot.majority(simhash_pivot.shingle_hashes(rows[2 * i][1].encode(), 5)) ^ simhash_pivot.majority(simhash_pivot.shingle_hashes(rows[2 * i + 1][1].encode(), 5))).count("1") <= simhash_pivot.RADIUS]
    assert near
    meeting = simhash_pivot.meeting_nodes
    monkeypatch.setattr(simhash_pivot, "meeting_nodes", lambda base: meeting(base).limit(0))
    found = {r.doc_id: r.component_id for r in simhash_pivot.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {**{i: i for i in range(6)}, **{100 + i: i if i in near else 100 + i for i in range(6)}}


def test_a_trained_model_holds_no_words():
    model = toxicity_cnn.train([(f"bad vile nasty {i}" if i % 2 else f"river bird mill {i}", "en", i % 2) for i in range(60)], 0.5, epochs=2)
    assert not model.rows and not len(model.table) and model.table.base is None
    assert len(model.score(["bad vile", "river bird", None])) == 3


def test_near_dedup_of_repeated_ids(spark):
    import corpus_pipeline

    rng = random.Random(3)
    a, b, c = (" ".join("w%d" % rng.randrange(3000) for _ in range(100)) for _ in range(3))
    rows = [(1, a), (5, edited(rng, a, 1)), (5, b), (5, b), (7, c), (8, edited(rng, b, 1)), (None, a)]
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()
    assert sorted(map(repr, kept)) == sorted(repr(r) for r in spark.createDataFrame([rows[i] for i in (0, 2, 3, 4, 6)], "doc_id long, text string").collect())


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    before = None
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / re.sub(r"\W", "_", name)))
        out = spark.read.parquet(str(tmp_path / re.sub(r"\W", "_", name)))
        if name != "best-fit packing":
            assert out.columns == columns
        rows, own = {r.doc_id: r for r in docs.collect()}, out.collect()
        if name == "line dedup":
            want = {i: t for i, _, _, t in brute_lines([(i, r.text) for i, r in rows.items()])}
            assert {r.doc_id: r.text for r in own} == want
            assert all(r.n_chars == len(r.text) for r in own)
        elif name == "SimHash near-dedup":
            sets = {i: shingle_set(r.text) for i, r in rows.items()}
            kept = {r.doc_id for r in own}
            assert len({rows[i].text for i in kept}) == len(kept)  # one of each text
            for i in set(rows) - kept:  # what goes is like something with a smaller id
                assert max(jaccard(sets[i], sets[j]) for j in rows if j != i) >= 0.8
            missed = [(a, b) for a in kept for b in kept if a < b and jaccard(sets[a], sets[b]) >= 0.9]
            assert not missed
        elif name == "best-fit packing":
            assert {r.doc_id for r in own} == set(rows)
        else:
            assert 0.6 * len(rows) < len(own) <= len(rows)
            assert all(rows[r.doc_id].text == r.text for r in own)
        docs, before = out, len(own)
    assert before
    assert corpus_pipeline.run(spark, SF).count() == before


def test_pipeline_with_clashing_columns_and_no_rows(spark):
    """Stages keep columns that are named as the operators name their own, whatever these hold; empty tables stay empty."""
    import corpus_pipeline

    extra = ["score", "predicted", "lang_pred", "ambiguous", "node", "size", "row", "n_lines", "n_dropped", "text_hash", "component_id", "u", "v", "Score"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.select("*", *[F.concat(F.lit(f"{c} "), F.col("doc_id").cast("string")).alias(c) for c in extra if c != "Score"])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out, want = stage(spark, odd, SF), stage(spark, docs, SF)
        assert out.columns == odd.columns, name
        assert sorted(r.doc_id for r in out.collect()) == sorted(r.doc_id for r in want.collect()), name
        assert all(r["node"] == f"node {r.doc_id}" and r["n_lines"] == f"n_lines {r.doc_id}" for r in out.collect()), name
        assert stage(spark, docs.limit(0), SF).columns == docs.columns and stage(spark, docs.limit(0), SF).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), SF).count() == 0


def test_digest_columns(spark):
    rows = line_runs.op6_line_dedup(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = {i: (n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in brute_lines([(r.doc_id, r.text) for r in docs])}
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in rows} == want
    assert zlib.crc32(b"7") % 5 in range(5)


def test_near_dedup_does_not_depend_on_the_sample_that_orders_shingles(spark, monkeypatch):
    """Whether nothing, a part or all is counted as common, components are those of all pairs."""
    rng = random.Random(17)
    head, rows = " ".join("h%d" % i for i in range(120)), []
    for _ in range(6):
        text = head + " " + " ".join("w%d" % rng.randrange(30000) for _ in range(184))
        rows += [(len(rows) + k, edited(rng, text, rng.choice([3, 4, 5]))) for k in range(8)]
    sets = [shingle_set(t) for _, t in rows]
    want = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if want[a] != want[b] and jaccard(sets[a], sets[b]) >= 0.8:
                low, high = sorted((want[a], want[b]))
                want = [low if x == high else x for x in want]
    assert 6 < len(set(want)) < len(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for sampled, common, least in ((1, 1, 10**6), (4, 5, 1), (10**9, 10**6, 1)):
        for name, value in (("SAMPLED_ROWS", sampled), ("COMMON", common), ("COMMON_LEAST", least)):
            monkeypatch.setattr(simhash_pivot, name, value)
        assert {r.doc_id: r.component_id for r in simhash_pivot.similar_documents(df).collect()} == dict(enumerate(want))
