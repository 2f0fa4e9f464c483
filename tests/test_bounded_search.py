"""Scoring searches long texts no further than what is wide in them reaches, and finds the same."""

from pyspark.sql import functions as F

from tonewright.functions import fixed_values as V
from tonewright.functions.text import REACH, bounded, held_words, near_wide, rare_end, up_to_last_wide
from tonewright.operators import hits as H
from tonewright.sources.files import SPLITS, spread

LONG = "It was found that one, two, three came. " * 40
TEXTS = [
    "", "总之就是这样。总之算了！方面a, b, c\n", "。赋能" + " " * 300 + "a, b, c\n" + LONG, LONG + "\n高效 , robust x, yy。" + LONG, LONG + "\nholistic a, b c, d e\n",
    "不只是累，不只是困，" + LONG + "更是难过。", "我成长了很多" + "x" * 30 + "因为" + LONG, "第一" + LONG, "—" * 5 + LONG + "— ", "说到底，" + "\n" * 500 + "是" + LONG,
    "100 % " + LONG + "3.5% 的，" + " " * 400 + "比他更强", "ſeveral K İ overall" + LONG, "芭比Q 栓q emo YYDS" + LONG, "猫" + LONG + "三天见效" + LONG,
]


def test_what_is_cut_off_holds_no_hit(spark):
    b = F.col("body")
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, body string")
    plain = [H.sentence(b, p).alias(p) for p in V.SENTENCES] + [H.judged(b, p).alias(p) for p in V.BASE_JUDGED]
    each = {r["doc_id"]: [tuple(h) for p in (*V.SENTENCES, *V.BASE_JUDGED) for h in r[p]] for r in df.select("doc_id", *plain).collect()}
    made = {r["doc_id"]: [tuple(h) for h in r["hits"] if h["pattern_id"] not in (None, H.UNDUE, H.SLANG)] for r in H.scene_hits(df, "base").collect()}
    assert made == each and sum(map(len, made.values())) > 20


def test_searches_are_short(spark):
    text = "赋能" + LONG
    row = spark.createDataFrame([(text,)], "t string").select(F.length(up_to_last_wide(F.col("t"))).alias("n"), held_words(F.lit("首先进一步"), ["首先", "先进", "进", "一步"]).alias("w")).first()
    assert row["n"] < 2 * REACH and row["w"] == "首先\n先进\n进\n一步"
    assert bounded(V.TRIAD) and bounded(V.FOURFOLD) and not bounded("总之[^。]*?[。！]")
    far = [p for _, _, own in V.JUDGED.values() for p in own if not near_wide(p)]
    assert len(far) == 3 and all(w.endswith(rare_end(w)) for w in ("moreover", "100", "at"))


def test_few_splits_are_dealt_out(spark):
    cores = spark.sparkContext.defaultParallelism
    assert spread(spark.range(0, 1000, 1, cores)).rdd.getNumPartitions() == SPLITS * cores
    assert spread(spark.range(0, 1000, 1, 9 * cores)).rdd.getNumPartitions() == 9 * cores


def test_one_search_of_a_batch_finds_the_words():
    """what of the words a text holds is found in one search for all words; words with i, k and s are looked for whole."""
    import pyarrow as pa

    from tonewright.functions.text import Scan, needed

    scan = Scan({"赋能", "赋", "能", "In a sense", "basis", "robust"})
    texts = pa.array(["x", "ROBUST, in A sense" + LONG, "", LONG + "赋能" + LONG, "é ba\u017fis", "zz赋", "basis 能 \u212a"])
    rows = scan(texts).to_pylist()
    assert [sorted(r["wide"].split("\n")) for r in rows] == [[""], [""], [""], ["能", "赋", "赋能"], [""], ["赋"], ["能"]]
    assert [r["ascii"] for r in rows] == ["", "in a sense\nrobust", "", "", "", "", "basis"] and [r["odd"] for r in rows] == [False] * 4 + [True, False, True]
    assert len(LONG) < len(rows[3]["near"]) < len(LONG) + 2 * REACH and rows[6]["near"] == "basis 能 \u212a"
    assert scan(texts.slice(3, 2)).to_pylist() == rows[3:5] and scan(texts.slice(0, 0)).to_pylist() == [] and scan(pa.array(["", ""])).to_pylist() == [rows[2]] * 2
    assert needed("In a sense[^,]*[,]", True, True) == ("in a sense",) and "in a sense" in H.vocabulary() and needed("In a sense[^,]*[,]", True) == ("n a ",)
