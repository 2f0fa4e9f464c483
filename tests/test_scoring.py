"""Hits, scores and actions on our own sentences."""

import math

import pytest
from pyspark.sql import functions as F

from tonewright.functions import fixed_values as V
from tonewright.functions.text import SENTENCE_START, java, spans
from tonewright.operators import hits as H
from tonewright.operators import scene, score
from tonewright.sources.files import from_strings


def run(spark, texts, scene="base"):
    return score.with_score(from_strings(spark, texts), scene).orderBy("doc_id").collect()


def test_clean_null_and_empty(spark):
    for row in run(spark, [None, "", "今天吃了面条，味道很好。", "We walked home in the rain."]):
        assert (row.score, row.raw, row.action, row.hit_count) == (100, 0, "pass", 0)
        assert row.summary == score.CLEAN


def test_first_tier_and_order(spark):
    (row,) = run(spark, ["值得注意的是，Moreover 这个闭环。"])
    words = [h.matched for h in row.hits if h.category.startswith("tier1")]
    assert words == ["值得注意的", "值得注意的是", "闭环", "Moreover"]


@pytest.mark.parametrize(
    "raw,length,want",
    [(0, 10, 100), (5, 10, 85), (6, 1000, int(100 - math.sqrt(6) * 10)), (100, 100, 0), (6, 60, 0)],
)
def test_formula(spark, raw, length, want):
    df = spark.createDataFrame([(raw, length)], "r long, n int")
    assert df.select(score.score_of(F.col("r"), score.norm_penalty(F.col("r"), F.col("n")))).first()[0] == want


@pytest.mark.parametrize("value,want", [(100, "pass"), (85, "pass"), (84, "warn"), (70, "warn"), (69, "rewrite"), (56, "rewrite"), (55, "block"), (0, "block")])
def test_actions(spark, value, want):
    df = spark.createDataFrame([(value,)], "s int")
    assert df.select(score.action_of(F.col("s"), F.lit(False), "base")).first()[0] == want
    assert df.select(score.action_of(F.col("s"), F.lit(True), "base")).first()[0] == "block"


CASES = [
    ("p28_body_reaction", "听到消息我头皮发麻。", "他的头皮屑很多。"),
    ("p29_maxim_golden_line", "越是着急，越容易出错。", "他越走越远。"),
    ("p30_staged_candor", "老实说我不太懂。", "他很老实。"),
    ("p31_rhetorical_identity", "作为一名医生，我建议多喝水。", "他是一名医生。"),
    ("p32_template_enumeration", "三件事要记住。", "三个维度都好。"),
    ("p33_contrastive_negation", "这不是运气，而是方法。", "它不是医生，也替代不了医生。"),
    ("p34_em_dash_abuse", "他说—你听—好。", "他来了——就一次。"),
    ("p35_medical_claim", "能根治这种病。", "有效提升效率。"),
    ("p36_absolute_claim", "这是唯一能用的办法。", "第一次来，唯一标识。"),
    ("p37_replace_doctor", "这样就不用去医院了。", "建议去医院。"),
    ("p38_vague_elevation", "我成长了很多。", "我成长了很多，因为学会了做饭。"),
    ("p39_three_part_parallelism", "不只是累，不只是困，更是难过。", "不只是累，更是难过。"),
    ("p40_marketing_hype", "这是神器。", "手感拉满。"),
]


@pytest.mark.parametrize("pattern,positive,near_miss", CASES)
def test_judged_patterns(spark, pattern, positive, near_miss):
    df = from_strings(spark, [positive, near_miss]).select("doc_id", F.size(H.judged(F.col("text"), pattern)).alias("n")).orderBy("doc_id")
    first, second = (r.n for r in df.collect())
    assert first >= 1 and second == 0


def test_enumerations_need_hollow_short_items(spark):
    texts = ["\n高效赋能、全面协同、深度转型。", "\n苹果、梨子、桃子。", "\n功能、性能、系统测试。", "\n表是按照功能分类的规则的集合体系，链是按照时机分类的，最后是全面的。"]
    df = from_strings(spark, texts).select("doc_id", F.size(H.sentence(F.col("text"), "p05_forced_triads")).alias("n")).orderBy("doc_id")
    assert [r.n for r in df.collect()] == [1, 0, 0, 0]


def test_lazy_head_is_the_plain_pattern(spark):
    """The look-around before lazy heads changes no match."""
    import re

    texts = ["甲。乙此外丙。丁另外戊！己此外。", "没有。", "此外！此外！尾", "a" * 2000 + "此外。"]
    pattern = V.SENTENCES["p12_excessive_transitions"]
    assert SENTENCE_START in java(pattern)
    got = from_strings(spark, texts).select("doc_id", F.transform(H.sentence(F.col("text"), "p12_excessive_transitions"), lambda h: h["matched"]).alias("m")).orderBy("doc_id").collect()
    assert [r.m for r in got] == [re.findall(pattern, t) for t in texts]


def test_patterns_agree_with_python(spark):
    """Every pattern finds in Java what Python's engine finds, on all seeds at once."""
    import re

    from tonewright.plans.seeds import SNIPPETS

    df = from_strings(spark, SNIPPETS).cache()
    listed = [(p, any_case) for _, _, patterns, any_case in H.LISTED.values() for p in patterns] + [(p, False) for p in V.SENTENCES.values()]
    columns = [F.expr("0").alias("c")] + [F.regexp_extract_all("text", F.lit(java(p, i)), 0).alias(f"c{k}") for k, (p, i) in enumerate(listed)]
    rows = df.select("doc_id", *columns).orderBy("doc_id").collect()
    for row, text in zip(rows, SNIPPETS, strict=True):
        for k, (p, any_case) in enumerate(listed):
            assert list(row[f"c{k}"]) == [m.group() for m in re.finditer(p, text, re.I if any_case else 0)], (p, text)


def test_spans_count_code_points(spark):
    row = from_strings(spark, ["🙂猫🙂🙂猫x猫"]).select(spans(F.col("text"), "猫").alias("s")).first()
    assert [(s.s, s.e, s.t) for s in row.s] == [(1, 2, "猫"), (4, 5, "猫"), (6, 7, "猫")]


def test_slang_is_covered_by_longer_words(spark):
    b = F.col("text")
    rows = from_strings(spark, ["这玩意儿，玩意儿，emo 与 emotion，动动嘴。", "`躺平`\n> 绝绝子\n好"]).select("doc_id", H.slang(b, H.unquoted(b)).alias("f")).orderBy("doc_id").collect()
    assert rows[0].f.hard == ["这玩意儿", "玩意儿", "emo"] and rows[0].f.light == ["动动嘴"]
    assert rows[1].f.hard == []


def test_profiles_change_penalties(spark):
    text = "首先，打开文件。" + "渲染引擎很稳定。" * 3
    base, tech = run(spark, [text])[0], run(spark, [text], "tech-doc")[0]
    assert base.raw > tech.raw
    assert not [h for h in tech.hits if h.matched == "引擎"]
    social = run(spark, ["家人们，绝绝子！"], "social-note")[0]
    assert social.raw == 0 and social.hit_count == 2


def test_red_lines(spark):
    own = run(spark, ["这药能根治猫癣。"], "health-content")[0]
    cross = run(spark, ["这药能根治猫癣。"], "base")[0]
    outside = run(spark, ["这补丁能根治抖动。"], "base")[0]
    assert own.action == cross.action == "block" and own.compliance_hit and cross.compliance_cross_scene == ["p35_medical_claim"]
    assert not outside.compliance_hit


def test_code_is_not_judged(spark):
    code = "```\n赋能闭环生态\n```\n" + "今天下雨，我们在家看书。" * 30
    row = run(spark, [code])[0]
    assert row.raw == 0 and "赋能" not in row.body
    assert run(spark, ["```\n" + "赋能" * 150 + "\n```"])[0].raw > 0


def test_length_does_not_matter(spark):
    text = "首先，我们赋能闭环。"
    one, ten = run(spark, [text * 3, text * 30])
    assert abs(one.norm_penalty - ten.norm_penalty) >= 0
    assert 0 <= ten.score <= 100


SCENES_OF = {
    "social-note": "我家猫😀😀😀 #养猫 #日常\n我拍了照啊吧呢！我去买菜。我摸它。说实话这三件事要记住，神器。",
    "tech-doc": "```\nx\n```\n用 `a` 和 `b`，P99 延迟，v1.2.3，https://a.b /usr/bin/ 。\n- a\n- b\n- c\n首先看引擎，100% 可用。",
    "base": "首先，值得注意的是，这个闭环赋能生态，头皮发麻。一方面好，另一方面也好。",
}


def test_scene_of_each_row(spark):
    """A scene by row gives what that scene gives alone; names may be aliases, unknown ones are base, auto is the text's own."""
    texts = list(SCENES_OF.values())
    names = ["social-note", "tech-doc", "health-content", "base", "auto"]
    rows = [(len(texts) * k + i, t, name) for k, name in enumerate(names) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, asked string")
    got = {r.doc_id: r for r in score.with_score(df, F.col("asked")).collect()}
    alone = {name: run(spark, texts, name) for name in names[:4]}
    fields = ["scene", "score", "raw", "hit_count", "summary", "action", "compliance_hit"]
    for i, text, name in rows:
        want = alone[list(SCENES_OF)[i % 3] if name == "auto" else name][i % 3]
        assert [got[i][f] for f in fields] == [want[f] for f in fields], (name, text)
        assert [tuple(h) for h in got[i].hits] == [tuple(h) for h in want.hits]


def test_scene_names(spark):
    text = SCENES_OF["social-note"]
    assert [scene.known(n) for n in ("xiaohongshu", " Social Note ", "coder_pr", None, "default")] == ["social-note", "social-note", "tech-doc", "base", "base"]
    with pytest.warns(RuntimeWarning, match="unknown scene"):
        assert scene.known("no such scene") == "base"
    names = spark.createDataFrame([(0, text, "coder_pr"), (1, text, "???"), (2, text, None), (3, text, "自动")], "doc_id long, text string, scene string")
    assert [r.s for r in scene.with_chosen(names, F.col("scene"), "s").orderBy("doc_id").collect()] == ["tech-doc", "base", "base", "social-note"]


def test_red_line_alone(spark):
    texts = ["这药能根治猫癣。", "根治线上抖动。", "今天天晴。", None]
    df = from_strings(spark, texts)
    for name in ("base", "auto"):
        alone = [r.red_line for r in score.with_red_line(df, name).orderBy("doc_id").collect()]
        assert alone == [r.compliance_hit for r in run(spark, texts, name)]


def test_long_enumerations_and_runs(spark):
    """Texts whose matches repeat a group thousands of times; no search may recurse a level a time."""
    long = ["高效" + "、甲" * 10_000 + "。", "深度全面" * 5_000 + "赋能业务", "AbCd" * 10_000, "不仅" + "，" * 20_000, "`a" * 5_000, "1,000" * 4_000, "首先，" * 8_000]
    rows = run(spark, long)
    assert any(h.pattern_id == "p18_repetition_rhythm" and len(h.matched) == 20_003 for h in rows[0].hits)
    from tonewright.operators import gate, professional

    df = from_strings(spark, long)
    assert professional.with_professionalism(df).count() == len(long) == scene.with_scene(df).count()
    assert {r.route for r in gate.with_delivery(df).collect()} <= {"rules", "model", "original"}


def test_guards_never_hide_a_match(spark):
    """Every match of every pattern holds one of the pattern's necessary literals, in any case where case is ignored."""
    import re

    from tonewright.functions.text import needed

    shown = [*SCENES_OF.values(), *(x for case in CASES for x in case[1:]), "IN CONCLUSION it is. On This Basis, ok. ULTIMATELY so. This Initiative Helps us. \u212aelvin \u017fo"]
    for pattern, ignore in [*((p, False) for p in V.SENTENCES.values()), *((p, True) for p in V.CLOSERS_EN + V.ABSTRACT_SUBJECTS_EN + V.CONNECTORS_EN + V.SYMMETRY_EN), *((p, False) for x in V.JUDGED.values() for p in x[2])]:
        written = re.sub(r"\\x\{([0-9a-fA-F]+)\}", lambda m: chr(int(m[1], 16)), pattern)
        for text in shown:
            for m in re.finditer(written, text, re.I if ignore else 0):
                words = needed(pattern, ignore)
                assert not words or any(w in (m[0].lower() if ignore else m[0]) for w in words), (pattern, m[0])


def test_acceptance_sets(spark):
    """Every adversarial sentence is found, every plain one is left alone."""
    from tonewright.plans import seeds

    rows = run(spark, seeds.ADVERSARIAL + seeds.PLAIN, "social-note")
    dirty = [r.raw > 0 or r.compliance_hit for r in rows]
    assert all(dirty[: len(seeds.ADVERSARIAL)]) and not any(dirty[len(seeds.ADVERSARIAL) :])
    assert all(r.score == 100 for r in rows[len(seeds.ADVERSARIAL) :])


def test_words_are_found_in_short_runs(spark):
    """What a Latin text holds of wide characters is short, and every hit is found as in the whole text."""
    from tonewright.functions.text import wide_runs, with_held

    texts = ["赋能与闭环。" + "the tion of and, " * 500, "\u212aey: 栓Q 芭比Q EMO yyds，此外，robust。", "\u0130n summary, DELVE \u0130t. This is \u017feen。", "！全面、深度、广度。\n？赋能，协同，引领！", "。", None, "既快，又稳。" * 30]
    df = from_strings(spark, texts).select("doc_id", F.coalesce("text", F.lit("")).alias("body"))
    b = F.col("body")
    assert df.select(F.length(wide_runs(b))).first()[0] < 20
    df, held = with_held(df, "h", b)
    pairs = {p: (H.sentence(b, p), H.sentence(b, p, held, H.up_to_last_mark(b))) for p in V.SENTENCES} | {p: (H.judged(b, p), H.judged(b, p, held=held)) for p in V.JUDGED}
    pairs |= {r: (H.listed(b, r), H.listed(b, r, "base", held)) for r in H.LISTED} | {"en": (H.tier1_en(b), H.tier1_en(b, held)), "zh": (H.tier1_zh(b), H.tier1_zh(b, held)), "undue": (H.undue_caution(b), H.undue_caution(b, held))}
    pairs["slang"] = (H.slang(b, b)["hard"], H.slang(b, b, (held.wide, held.lowered))["hard"])
    row = df.select(*[F.collect_list(x).alias(f"{k}{i}") for k, two in pairs.items() for i, x in enumerate(two)]).first()
    for k in pairs:
        assert row[f"{k}0"] == row[f"{k}1"], k
    assert row["slang1"][1] == ["栓Q", "芭比Q", "EMO", "yyds"]
    assert len(row["en1"][2]) == 1 and row["p05_forced_triads1"][3]
