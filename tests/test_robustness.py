"""Texts that must not break anything: private-use characters, openings without closings, many alike paragraphs, calls that hang."""

import difflib
import random
import string
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tonewright.functions.text import outermost, placed
from tonewright.operators import model, paragraphs, punctuation, rewrite
from tonewright.sources import files
from tonewright.streaming import messages

PRIVATE = ["a b  c", "a 5  b", "xyz", "0`q`", "中,文.`x`", "", "[a](b)9"]


def column(spark, texts, make):
    return [r[0] for r in files.from_strings(spark, texts).select(make(F.col("text")), "doc_id").orderBy("doc_id").collect()]


def test_private_use_characters_stay(spark):
    marks = lambda t: [c for c in t or "" if "\ue000" <= c <= "\uf8ff"]
    assert [rewrite.rewrite_markdown(t) for t in PRIVATE[:4]] == PRIVATE[:4]
    for make in (punctuation.normalized, rewrite.rewritten, *punctuation.STEPS.values()):
        assert [marks(t) for t in column(spark, PRIVATE, make)] == [marks(t) for t in PRIVATE]
    assert column(spark, PRIVATE[:4], punctuation.normalized) == PRIVATE[:4]
    assert column(spark, ["好,;:!?好", "a,好.b", "好.a", "好,,好", ",好", "好.好."], punctuation.widen) == ["好，;:!？好", "a，好.b", "好.a", "好，，好", "，好", "好。好。"]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n`[]()不是，。而首先first, "))))
def test_any_text_is_rewritten_without_losing_private_characters(text):
    kept = [c for c in text if "\ue000" <= c <= "\uf8ff"]
    for out in (rewrite.rewrite(text), rewrite.rewrite_markdown(text)):
        left = iter(kept)
        # Rules may delete a passage with all that is in it, but bring nothing in.
        assert all(c in left for c in out if "\ue000" <= c <= "\uf8ff")


OPENINGS = ["not only a ", "We need to go ", "不是", "一方面", "既", "不仅", "虽然", "让我们", "first, ", "首先，", "1. ", "This ", "both a ", "On one hand ", "这并非", "it's not about ", "[", "`a", "   \n   ", "not a ", "， "]


@pytest.mark.parametrize("opening", OPENINGS)
def test_openings_without_closings_take_linear_time(opening):
    times = []
    for size in (40_000, 400_000):
        text = opening * (size // len(opening))
        began = time.process_time()
        rewrite.rewrite(text)
        rewrite.rewrite_markdown(text)
        times.append(time.process_time() - began)
    assert times[1] < 20 * max(times[0], 0.1)


def former(forms, threshold):
    """Every form against all kept ones."""

    def near(a, b):
        if not a or not b:
            return a == b
        short, long = sorted((len(a), len(b)))
        return short >= 12 and short / long >= 0.6 and difflib.SequenceMatcher(None, a, b).ratio() >= threshold

    chosen, norms, exact, similar = [], [], 0, 0
    for i, form in enumerate(forms):
        if form in norms:
            exact += 1
        elif len(form) >= 12 and any(near(form, other) for other in norms):
            similar += 1
        else:
            norms.append(form)
            chosen.append(i)
    return chosen, exact, similar


@pytest.mark.parametrize("threshold", [0.9, 0.75, 0.5, 1.0])
def test_kept_paragraphs_are_those_of_all_comparisons(threshold):
    rng = random.Random(6)
    forms = ["", "短", "a" * 11, "a" * 300]
    base = ["".join(rng.choice("abcdefgh的是不一") for _ in range(rng.randrange(5, 240))) for _ in range(25)]
    for b in base:
        forms.append(b)
        for _ in range(5):
            x = list(b)
            for _ in range(rng.randrange(1 + len(x) // 6)):
                k = rng.randrange(len(x) + 1)
                x[k : k + rng.randrange(2)] = rng.choice(["", "z", "zq"])
            forms.append("".join(x))
    rng.shuffle(forms)
    assert paragraphs.kept_numbers(forms, threshold) == former(forms, threshold)
    for a, b in zip(forms, forms[1:], strict=False):
        assert 2 * paragraphs.common_length(a, b) >= 2 * sum(m.size for m in difflib.SequenceMatcher(None, a, b).get_matching_blocks())


def test_many_unlike_paragraphs_take_seconds():
    rng = random.Random(7)
    unlike = ["".join(rng.choices(string.ascii_lowercase, k=150)) for _ in range(3000)]
    anagrams = ["".join(rng.sample(unlike[0], 150)) for _ in range(1000)]
    began = time.process_time()
    assert len(paragraphs.kept_numbers(unlike + anagrams, 0.9)[0]) == 4000
    assert time.process_time() - began < 20


def test_span_offsets_in_many_matches(spark):
    texts = ["ab" * 1000, "", "x", "ab", "xab" * 257 + "y", "é ab日ab"]
    for got, text in zip(column(spark, texts, lambda t: placed(t, F.lit("ab"))), texts, strict=True):
        assert [(s.s, s.e, s.t) for s in got] == [(i, i + 2, "ab") for i in range(len(text)) if text.startswith("ab", i)]
    times = []
    for n in (10_000, 100_000):
        df = files.from_strings(spark, ["ab," * n]).select(F.size(placed(F.col("text"), F.lit("ab"))).alias("n"))
        began = time.perf_counter()
        assert df.first().n == n
        times.append(time.perf_counter() - began)
    assert times[1] < 10 * max(times[0], 0.5)


def test_outermost_spans(spark):
    spans = [(0, 5, "a"), (1, 3, "b"), (0, 5, "a"), (4, 6, "c"), (4, 9, "d"), (9, 9, "e"), (10, 11, "f"), (0, 4, "g")]
    df = spark.createDataFrame([(spans,), ([],)], "x array<struct<s:int,e:int,t:string>>")
    got = [[tuple(s) for s in r[0]] for r in df.select(outermost(F.col("x"))).collect()]
    assert got == [[(0, 5, "a"), (4, 9, "d"), (10, 11, "f")], []]


def test_each_call_has_its_own_time():
    def call(n):
        if n < 8:
            time.sleep(6)
        return f"reply {n}"

    began = time.monotonic()
    found = model.call_all(list(range(14)), call, timeout=1.0, at_once=8)
    assert time.monotonic() - began < 3
    assert found == [(None, "TimeoutError")] * 8 + [(f"reply {n}", None) for n in range(8, 14)]


def test_calls_that_never_end_stop_further_ones():
    sent = []

    def hang(n):
        sent.append(n)
        time.sleep(5)

    began = time.monotonic()
    found = model.call_all(list(range(50)), hang, timeout=0.3, at_once=4, left_behind=4)
    assert time.monotonic() - began < 3 and len(sent) < 8
    assert [e for _, e in found] == ["TimeoutError"] * len(sent) + ["the model answers no calls"] * (50 - len(sent))
    assert model.call_all([], hang, 1.0) == []


def test_chunks_as_rows_give_what_a_sequence_gives(spark):
    def transport(request):
        text = request[-1]["content"]
        if "坏" in text:
            raise ValueError("refused " + str(text.count("坏")))
        return f"<think>x</think>[{len(text)}]" + text.split("\n")[1][:5]

    rng = random.Random(9)
    parts = ["".join(rng.choices("河边鸟树路人走看听说山水天地", k=179)) + "。" for _ in range(12)]
    bad = [p if i not in (7, 9) else "坏" * (i - 5) + p for i, p in enumerate(parts)]
    long = "\n\n".join(parts)
    texts = [long, long, "短文。", None, "", "\n\n".join(bad), "不问我"]
    df = spark.createDataFrame([(i, t, {"k": i}) for i, t in enumerate(texts)] + [(0, long, {"k": 0})], "doc_id long, text string, error map<string,int>")
    made = model.rewrite_with_model(df, transport, limit=400, only=F.col("doc_id") != 6, context="背景", sections={"一": "二"})
    rows = made.orderBy("doc_id").collect()
    assert made.columns == ["doc_id", "text", "error", "model_text", "model_error"] and len(rows) == 8
    ask = lambda c: model.ask(transport, model.messages(c, "base", "背景", {"一": "二"}))
    clean = {r.doc_id: r.o for r in model.prepared(df.select("doc_id", "text"), "o").collect()}
    for r in rows:
        if r.doc_id == 6:
            assert r.model_text is None and r.model_error is None
        elif r.doc_id == 5:
            assert r.model_text == texts[5] and r.model_error == "refused 2"
        else:
            assert r.model_text == "\n\n".join(ask(c) for c in model.chunks(clean[r.doc_id], 400)) and r.model_error is None
    assert model.rewrite_with_model(df.limit(0), transport).count() == 0


def test_awaited_transports_and_prompts():
    async def transport(request):
        return "<think></think>ok"

    assert model.ask(transport, []) == "ok"
    system = model.messages("x")[0]["content"]
    assert all(w in system for w in model.BANNED) and all(a in system and b in system for a, b in model.EXAMPLES)
    assert "First person" not in system and "Background" in model.messages("x", context="c")[1]["content"]


def test_messages_that_come_again_are_replaced(spark, tmp_path):
    long = "今天我们去河边散步,看到很多鸟。" * 15
    write = messages.write_batch(str(tmp_path / "out"))
    batches = [[("m1", long), ("m2", "短,的")], [("m1", long + "后来下雨了,我们回家。"), ("m3", "新的")], [("m1", "撤回了")]]
    for k, rows in enumerate(batches[:2]):
        write(spark.createDataFrame(rows, messages.SCHEMA), k)
    write(spark.createDataFrame(batches[1], messages.SCHEMA), 1)  # runs again
    read = lambda folder: [spark.read.parquet(str(tmp_path / folder / kind)) for kind in ("sent", "edited")]
    seen = sorted((r.message_id, r.text) for r in messages.latest(*read("out")).collect())
    assert [m for m, _ in seen] == ["m1", "m2", "m3"] and "下雨了，" in seen[0][1]
    messages.compact(spark, str(tmp_path / "out"), 1, str(tmp_path / "small"))
    assert sorted((r.message_id, r.text) for r in messages.latest(*read("small")).collect()) == seen
    write(spark.createDataFrame(batches[2], messages.SCHEMA), 2)
    assert {r.message_id: r.text for r in messages.latest(*read("out")).collect()}["m1"] == "撤回了"


def test_normalizing_looks_no_further_than_it_can_reach(spark):
    """The same as steps that look everywhere, on lines with and without Chinese; a long ASCII tail costs next to nothing."""
    rng = random.Random(21)
    bits = ["汉字", "，", "。", "……", "...", "....", "!", "!!", "?", ",", ";", ":", "(", ")", "(a", "b)", "（", "）", " ", "  ", "\t", "\n", "\n", "\n\n", "x", "ab 1", "`c,汉`", "`", "```", "www.a.b/c", "http://x,y", "m@n.op", "", "", "「", "！", "é", "😀", "\r", " "]
    texts = ["".join(rng.choices(bits, k=rng.randrange(1, 40))) for _ in range(1500)] + ["", "\n", "汉,\n(a)汉", "汉(a\nb)", "(汉)(b), c\n, d", "```汉,\n```,汉\n, a"]
    assert column(spark, texts, punctuation.normalized) == column(spark, texts, punctuation.normalized_whole)
    df = spark.createDataFrame([("汉字,汉字\n" + "word, (word) ... and so on! " * 2000,)] * 40 + [(None,)], "text string").repartition(1)
    times = []
    for make in (punctuation.normalized_whole, punctuation.normalized):
        made = df.select(F.xxhash64(make(F.col("text"))).alias("h"))
        assert made.filter("h is not null").count() == 41
        began = time.perf_counter()
        found = sorted(made.collect())
        times.append((time.perf_counter() - began, found))
    assert times[0][1] == times[1][1] and times[1][0] < times[0][0]
