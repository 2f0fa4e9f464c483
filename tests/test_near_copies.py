"""Near copies over a corpus against all pairs, and their groups against brute force."""

import difflib
import random
import time

import pytest
from pyspark.sql import functions as F

from tonewright.operators import near_copies
from tonewright.operators.paragraphs import near

SF = "/root/testdata/sf0.001"


def all_links(forms):
    """forms: (node, form). Later forms are held against earlier ones."""
    ordered = sorted(forms)
    return {(a, b) for i, (a, x) in enumerate(ordered) for b, y in ordered[i + 1 :] if near(y, x)}


def roots_of(ids, pairs):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_links_of_documents_are_those_of_all_pairs(spark):
    nodes = near_copies.corpus_nodes(spark.read.parquet(f"{SF}/documents.parquet"))
    forms = [(r.node, r.form) for r in nodes.collect()]
    want = all_links(forms)
    assert {(r.a, r.b) for r in near_copies.links(nodes.select("node", "form")).collect()} == want and want


@pytest.mark.parametrize("size", [30, 70, 250, 900])
def test_groups_of_edited_texts(spark, size):
    rng = random.Random(size)
    word = lambda: "".join(rng.choices("abcdefghijkl的是河边鸟", k=rng.randrange(2, 8)))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "short"), (5, "short!"), (None, "no id"), (6, "SHORT")]
    for base in range(8):
        words = [word() for _ in range(size // 5)]
        rows.append((100 * base + 100, " ".join(words)))
        for copy in range(12):
            if copy % 4 == 0:  # chains: each copy of the one before
                words = list(words)
            edited = list(words)
            for _ in range(max(1, len(words) // 25)):
                edited[rng.randrange(len(edited))] = word()
            words = edited if copy % 4 == 3 else words
            rows.append((100 * base + 101 + copy, " ".join(edited) + ("\n" if copy % 2 else "")))
    rows += [rows[-1], rows[-1]]
    df = spark.createDataFrame([(i, t, 1, "m") for i, t in rows], "doc_id long, text string, first int, mark string")
    found = near_copies.near_copies(df).collect()
    assert len(found) == len(rows)
    nodes = {r.node: r.form for r in near_copies.corpus_nodes(df).collect()}
    form_of = {r.id: r.form for r in near_copies.marked_rows(df, "doc_id", "text").collect()}
    node_of = {form: node for node, form in nodes.items()}
    root = roots_of(nodes, all_links(nodes.items()))
    for r in found:
        assert r.first == (None if r.doc_id is None else root[node_of[form_of[r.doc_id]]])
    groups = [r.first for r in found if r.doc_id is not None]
    assert all(r.group_rows == groups.count(r.first) for r in found if r.doc_id is not None)
    assert near_copies.near_copies(df.limit(0)).count() == 0


def test_pairs_grow_with_the_forms_under_one_key(spark):
    rng = random.Random(3)
    shared = "".join(rng.choices("abcdefghij", k=400))
    forms = [(i, shared + "".join(rng.choices("klmnopqrst", k=30))) for i in range(300)]
    nodes = spark.createDataFrame(forms, "node long, form string")
    assert near_copies.candidate_pairs(nodes).count() <= 300 * near_copies.WINDOW * 2 * near_copies.BANDS
    assert {r.root for r in near_copies.components(near_copies.links(nodes)).collect()} == {0}


def test_components_of_long_chains(spark):
    rng = random.Random(5)
    pairs = [(i, i + 1) for i in range(0, 200)] + [(1000 + i, 1000) for i in range(1, 50)] + [(5, 5)]
    rng.shuffle(pairs)
    found = near_copies.components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {r.node: r.root for r in found} == {**{i: 0 for i in range(201)}, **{i: 1000 for i in range(1000, 1050)}} and len(found) == 251
    assert near_copies.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_string_keys(spark):
    text = "the river runs past the old mill and the birds sing in the trees"
    df = spark.createDataFrame([("b", text), ("a", text + "s"), ("c", "something else entirely, in other words")], "name string, body string")
    assert {r["name"]: r["first"] for r in near_copies.near_copies(df, "name", "body").collect()} == {"a": "a", "b": "a", "c": "c"}
    assert df.select(F.lit(1)).count() == 3


def test_the_predicate_is_the_librarys_ratio():
    rng = random.Random(4)
    alphabets = ["abc", "abcdefghijklmnopqrstuvwxyz", "".join(map(chr, range(0x4E00, 0x4F90))), "ab" * 40 + "qxzjk"]
    passed = 0
    for size in [12, 60, 199, 200, 201, 400, 900] * 40:
        letters = rng.choice(alphabets)
        a = "".join(rng.choices(letters, k=size))
        b = list(a)
        for _ in range(rng.randrange(1 + size // 8)):
            at = rng.randrange(len(b))
            b[at : at + rng.randrange(3)] = rng.choices(letters, k=rng.randrange(4)) or [letters[0]]
        b = "".join(b)
        for threshold in (0.6, 0.8, 0.9, 0.95, 1.0):
            short, long = sorted((len(a), len(b)))
            want = short >= 12 and short / long >= 0.6 and difflib.SequenceMatcher(None, a, b).ratio() >= threshold
            assert near(a, b, threshold) == want
            passed += want
    assert 100 < passed < 1300


def test_long_texts_that_the_ratio_tears_apart_are_told_quickly():
    """Nearly all characters are frequent, so the library meets few and far blocks; it visits every character for each."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("etaoinshrdlucmfwygpb" * 30 + "vkjxqz", k=6))
    words = [word() for _ in range(8000)]
    edited = [word() if rng.random() < 0.04 else w for w in words]
    began = time.process_time()
    for _ in range(3):
        near("".join(words), "".join(edited))
    assert time.process_time() - began < 1.5


def strewn(rng, base, step):
    """A copy with every `step`-th character another one."""
    return "".join(rng.choice("龙凤虎豹") if i % step == 0 else c for i, c in enumerate(base))


def test_links_are_all_pairs_whatever_the_changes(spark):
    """Characters changed evenly over a text leave no long n-gram; a group of 40 has all its links."""
    rng = random.Random(11)
    letters = "".join(map(chr, range(0x4E00, 0x4F90)))
    forms = []
    for size in (30, 120, 190, 215, 240, 900):
        base = "".join(rng.choices(letters, k=size))
        forms += [base, strewn(rng, base, 11), strewn(rng, base, 12), strewn(rng, base, 25), base[: -size // 8], base + base[: size // 6]]
    shared = "".join(rng.choices("abcdefghij", k=400))
    forms += [shared + "".join(rng.choices("klmnopqrst", k=30)) for _ in range(40)]
    forms += ["ab" * 100 + "".join(rng.choices("abc", k=9)) for _ in range(8)] + ["".join(rng.choices("abc", k=rng.randrange(12, 30))) for _ in range(80)]
    rng.shuffle(forms)
    forms = list(enumerate(dict.fromkeys(forms)))
    nodes = spark.createDataFrame(forms, "node long, form string")
    want = all_links(forms)
    found = near_copies.links(nodes).collect()
    assert {(r.a, r.b) for r in found} == want and len(found) == len(want) > 40 * 39 // 2
    roots = {i: i for i, _ in forms} | {r.node: r.root for r in near_copies.groups(nodes).collect()}
    assert roots == roots_of([i for i, _ in forms], want)


def test_cells_of_many_slices_hold_every_pair_once(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "SLICE_BYTES", 4096)
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefghijkl的是河边鸟", k=rng.randrange(2, 8)))
    forms = []
    for base in range(12):
        words = [word() for _ in range(30 + 3 * base)]
        for _ in range(6):
            forms.append("".join(w if rng.random() > 0.03 else word() for w in words))
    forms = [(f"k{i}", f) for i, f in enumerate(dict.fromkeys(forms))]
    nodes = spark.createDataFrame(forms, "node string, form string")
    for threshold in (0.8, 0.9):
        ordered = sorted(forms)
        want = {(a, b) for i, (a, x) in enumerate(ordered) for b, y in ordered[i + 1 :] if near(y, x, threshold)}
        pairs = [(r.a, r.b) for r in near_copies.candidate_pairs(nodes, threshold).collect()]
        assert len(pairs) == len(set(pairs)) and want <= set(pairs) and want
        assert {(r.a, r.b) for r in near_copies.links(nodes, threshold).collect()} == want


def test_alike_forms_never_lie_further_apart_than_most():
    """The bound on n-grams holds for every pair that the predicate passes, with the parities of equal forms equal."""
    rng = random.Random(13)
    alphabets = ["ab", "abcdefghijklmnopqrstuvwxyz", "".join(map(chr, range(0x4E00, 0x4F90))), "ab" * 40 + "qxzjk"]
    passed = 0
    for size in [12, 15, 60, 199, 200, 230, 400, 900, 2500] * 60:
        letters = rng.choice(alphabets)
        a = "".join(rng.choices(letters, k=size))
        b = list(a)
        for _ in range(rng.randrange(1 + size // 7)):
            at = rng.randrange(len(b))
            b[at : at + rng.randrange(3)] = rng.choices(letters, k=rng.randrange(3)) or [letters[0]]
        b = "".join(b)
        for threshold in (0.7, 0.9):
            if near(a, b, threshold):
                one, two = near_copies.parities(a), near_copies.parities(b)
                words = min(len(one), len(two))
                apart = int(near_copies.np.bitwise_count(near_copies.folded(one, words) ^ near_copies.folded(two, words)).sum())
                most = near_copies.most_apart(near_copies.np.array([len(a) + len(b)]), near_copies.np.array([near_copies.starts(b)]), near_copies.GRAM, threshold)
                assert apart <= most[0] and near_copies.np.array_equal(one, near_copies.parities(a))
                passed += 1
    assert passed > 300
