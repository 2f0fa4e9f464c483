"""Patterns of which a part stays: the Columns against the chain's own rules, written results, hard texts."""

import re

import pytest

from tonewright.operators import phrases, rewrite
from tonewright.plans.seeds import SNIPPETS, SPAN_SNIPPETS
from tonewright.sources import files

HARD = ["", "不是" * 300 + "而是", "not only " * 300 + "but also x.", "abc，d", "İ not just ß, but ﬁ.", "\n\n \n", "，", "既" * 50 + "，又"]
TEXTS = SNIPPETS + SPAN_SNIPPETS + HARD


def one(spark, texts, column):
    from pyspark.sql import functions as F

    return [r.o for r in files.from_strings(spark, texts).select("doc_id", column(F.col("text")).alias("o")).orderBy("doc_id").collect()]


def chained(*steps):
    """A Python rewriting by patterns, flags and what a match becomes."""
    def run(text):
        for pattern, flags, by in steps:
            text = re.sub(pattern, by, text, flags=flags)
        return text
    return run


def joined(text):
    parts = (re.sub(r"^[，,]\s*", "", p.strip()).strip() for p in rewrite.BETWEEN.split(text))
    return re.sub(r" ([，。！？.!?])", r"\1", " ".join(p for p in parts if p))


def layout(text):
    paragraph, line = rewrite.stand_ins(text, 2)
    text = rewrite.LINE_END.sub(line, rewrite.EMPTY_LINES.sub(paragraph, text))
    return rewrite.around(paragraph).sub("\n\n", rewrite.around(line).sub("\n", text)).strip()


SECOND = lambda m: m[1].strip()
HALVES = r"(?P<only>not only)\s+(?P<first>[^,]+?)\s+but also\s+(?P<second>" + rewrite.REST_EN + r")|both\s+[^,]+?\s+and\s+(?P<tail>" + rewrite.REST_EN + ")"
CASES = {
    "reversals_zh": chained((rewrite.REVERSAL_ZH, re.I, rewrite.reversal)),
    "reversals_en": chained((rewrite.REVERSAL_EN, re.I, SECOND)),
    "imbalances": chained((rewrite.IMBALANCE_ZH, re.I, SECOND), (rewrite.IMBALANCE_EN, re.I, SECOND)),
    "coordinations_zh": chained(("(?=(既|不仅|不但))" + rewrite.COORDINATION_ZH, 0, rewrite.both_halves)),
    "coordinations_en": chained((HALVES, re.I, rewrite.joined_halves)),
    "symmetry_collapsed": chained(*((p, re.I, rewrite.last_clause) for p in rewrite.V.SYMMETRY)),
    "symmetry_collapsed_en": chained(*((p, re.I, rewrite.english_filler) for p in rewrite.V.SYMMETRY_EN)),
    "cross_sentences": chained(*((p, re.I, lambda m, w=w: rewrite.after_last(w, m[0])) for w, p in rewrite.CROSS_SENTENCE.items())),
    "residue_cleaned": lambda text: rewrite.applied(text, rewrite.RESIDUE),
    "sentences_joined": joined,
    "laid_out": layout,
}


@pytest.mark.parametrize("name", CASES)
def test_column_equals_rule(spark, name):
    got = one(spark, TEXTS, getattr(rewrite, name))
    want = [CASES[name](t) for t in TEXTS]
    assert got == want
    assert any(a != b for a, b in zip(got, TEXTS, strict=True))


WRITTEN = [
    ("reversals_zh", "这不是运气，而是方法。好。", "这是方法。好。"),
    ("reversals_en", "It was not just fast, but small.", "It was small."),
    ("imbalances", "不仅快，更重要的是稳。", "稳。"),
    ("coordinations_zh", "既便宜，又好用。", "便宜，好用。"),
    ("coordinations_en", "It is not only fast but also small.", "It is fast and small."),
    ("symmetry_collapsed", "一方面降，另一方面升。", "升。"),
    ("symmetry_collapsed_en", "On one hand it is cheap, on the other hand it breaks.", "it is cheap, it breaks."),
    ("cross_sentences", "Not only A. B but also C works!", "C works!"),
    ("residue_cleaned", "，好，，行。。", "好，行。"),
    ("sentences_joined", "甲。 ，乙！v1.2 好. Then", "甲。 乙！ v1.2 好. Then"),
    ("laid_out", " 甲 \n 乙\n\n\n 丙 ", "甲\n乙\n\n丙"),
]


@pytest.mark.parametrize("name, before, after", WRITTEN)
def test_written_results(spark, name, before, after):
    assert one(spark, [before, ""], getattr(rewrite, name)) == [after, ""]


def test_protected_parts_come_back(spark):
    pieces = one(spark, TEXTS, lambda t: phrases.parted(t)[0])
    kept = one(spark, TEXTS, lambda t: phrases.parted(t)[1])
    woven = ["".join(a + b for a, b in zip(g, [*k, ""], strict=True)) for g, k in zip(pieces, kept, strict=True)]
    assert woven == TEXTS
    assert "`a`" in sum(kept, []) and "https://a.b/c" in sum(kept, [])


def test_alternatives_are_tried_by_their_words():
    """A removal gives what its whole alternation gives, and tries no alternative without its word in the text."""
    from tonewright.operators import rewrite as R
    from tonewright.plans.seeds import SNIPPETS, SPAN_SNIPPETS

    rules = [r for r in R.STEPS if isinstance(r, R.Alternatives)]
    assert len(rules) > 10
    for rule in rules:
        shown = [w for _, words in rule.branches for w in words]
        for text in [*SNIPPETS, *SPAN_SNIPPETS, *(p for p, _ in rule.branches), *(p.upper() for p, _ in rule.branches), " ".join(shown)]:
            assert rule.apply(text) == rule.expression.sub("", text)
    plain = R.Alternatives(["alpha beta", "gamma delta"], R.ANY_CASE)
    R.alternation.cache_clear()
    assert plain.apply("It is GAMMA delta.") == "It is ." and plain.apply("nothing") == "nothing"
    assert R.alternation.cache_info().currsize == 1
