"""One query an operator, over seeded documents or the tables themselves, with its SQL check."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tonewright.functions import fixed_values as V
from tonewright.functions.text import computed_once, present, stripped
from tonewright.operators import detect, gate, model, near_copies, paragraphs, phrases, professional, punctuation, rewrite, scene, score, watermark
from tonewright.operators import hits as H
from tonewright.plans import checks as C
from tonewright.plans.seeds import seeded, seeded_alone, seeded_long, seeded_spans, with_acceptance
from tonewright.sources import files
from tonewright.sources.files import spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def hit_report(make: Callable[[Column], Column]) -> Query:
    """doc_id, n_hits and the matched texts of one rule."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = score.with_body(seeded(spark, sf_dir)).select("doc_id", make(F.col("body")).alias("h"))
        return found.select("doc_id", F.size("h").cast("long").alias("n_hits"), F.array_join(F.transform("h", lambda x: x["matched"]), C.BAR).alias("matched"))
    return run


register("rl01_tier1_zh", hit_report(H.tier1_zh), C.listed_report(C.words("body", V.TIER1_ZH)))
register("rl02_tier1_en", hit_report(H.tier1_en), C.listed_report(C.tier1_en_list("body")))
for _rule, (_category, _cost, _patterns, _any_case) in H.LISTED.items():
    register(_rule, hit_report(lambda b, r=_rule: H.listed(b, r)), C.listed_report(C.matches("body", _patterns, _any_case)))
register("rl08_idioms", hit_report(H.idioms), C.listed_report(C.words("body", V.IDIOMS)))
register("rl11_residual", hit_report(H.residual), C.listed_report(C.words("body", [w for w in V.RESIDUAL_WORDS if w not in V.TIER1_ZH])))
for _p in V.SENTENCES:
    register(f"ps{_p[1:]}", hit_report(lambda b, p=_p: H.sentence(b, p)), C.listed_report(C.sentence_list("body", _p)))
register("ps06_undue_caution", hit_report(H.undue_caution), C.listed_report(C.matches("body", H.UNDUE_PATTERNS, True)))
for _p in V.JUDGED:
    register(f"ps{_p[1:]}", hit_report(lambda b, p=_p: H.judged(b, p)), C.report(C.judged_rows(_p)))


def slang_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("body")
    found = score.with_body(seeded(spark, sf_dir)).select("doc_id", H.slang(b, H.unquoted(b)).alias("f"))
    return found.select(
        "doc_id", F.array_join("f.hard", C.BAR).alias("hard_hits"), F.array_join("f.light", C.BAR).alias("light_hits"),
        F.col("f.n_chars").cast("long").alias("n_chars"), H.slang_severity(F.col("f")).alias("severity"),
    )


register("ps27_over_colloquial", slang_query, C.slang_sql())


def score_query(scene: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = score.with_score(seeded(spark, sf_dir), scene)
        return df.select("doc_id", "scene", "score", "raw", F.col("hit_count").cast("long"), F.col("char_count").cast("long"), F.col("compliance_hit").cast("int"), "action")
    return run


for _scene, _name in (("base", "sc05_score"), ("social-note", "sc05_score_social"), ("health-content", "sc05_score_health"), ("tech-doc", "sc04_exemptions_tech")):
    register(_name, score_query(_scene), C.score_sql(_scene))


def summary_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.with_score(seeded(spark, sf_dir)).select("doc_id", "summary")


register("sc07_summary", summary_query, C.summary_sql())


def actions_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = score.with_score(seeded(spark, sf_dir))
    return df.groupBy("action").agg(F.count("*").alias("n"), F.sum("score").cast("long").alias("total_score"), F.sum("hit_count").cast("long").alias("hits"))


register("sc11_actions", actions_query, f"SELECT action, count(*) AS n, sum(score)::BIGINT AS total_score, sum(hit_count)::BIGINT AS hits FROM ({C.score_sql('base')}) GROUP BY action")


def detector_query(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = seeded(spark, sf_dir).select("doc_id", detect.DETECTORS[name](F.col("text")).alias("l"))
        return found.select("doc_id", F.size("l").cast("long").alias("n_found"), F.array_join("l", C.BAR).alias("found"))
    return run


for _i, _name in enumerate(detect.DETECTORS, 1):
    register(f"dt{_i:02d}_{_name}", detector_query(_name), C.detector_sql(_name))


def severity_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.with_detections(seeded(spark, sf_dir)).select("doc_id", F.col("total").cast("long"), "severity")


register("dt09_severity", severity_query, C.severity_sql(list(detect.DETECTORS)))


# --- bodies and scoring details ---


def body_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = score.with_body(seeded(spark, sf_dir))
    return df.select("doc_id", F.length("body").cast("long").alias("body_chars"), F.md5(F.col("body").cast("binary")).alias("body_md5"))


register("sc02_body", body_query, f"{C.WITH} SELECT doc_id, length(body) AS body_chars, md5(body) AS body_md5 FROM bodies")
register(
    "sc01_strip_code",
    lambda spark, sf_dir: seeded(spark, sf_dir).select("doc_id", F.length(score.without_code(F.col("text"))).cast("long").alias("chars_left")),
    f"{C.WITH} SELECT doc_id, length(cut) AS chars_left FROM bare",
)


def details_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = score.with_score(seeded(spark, sf_dir))
    return df.select("doc_id", F.round("norm_penalty", 6).alias("norm_penalty"), F.round("hits_per_1k", 6).alias("hits_per_1k"))


register("sc08_details", details_query, f"SELECT doc_id, round(raw * 1000.0 / greatest(char_count, 1), 6) AS norm_penalty, round(hit_count * 1000.0 / greatest(char_count, 1), 6) AS hits_per_1k FROM ({C.score_sql('base')})")
register("sc08_categories", lambda spark, sf_dir: score.with_score(seeded(spark, sf_dir)).select("doc_id", score.categories_of(F.col("hits")).alias("categories")), C.categories_sql())


def cross_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeded(spark, sf_dir).select("doc_id", F.array_join(score.cross_compliance(F.col("text"), "base"), ",").alias("red_lines"))


register("sc10_cross_compliance", cross_query, C.cross_sql())
register(
    "sc09_own_compliance",
    lambda spark, sf_dir: score.with_body(seeded(spark, sf_dir)).select(
        "doc_id", F.array_join(F.array_compact(F.array(*[F.when(F.size(H.judged(F.col("body"), p)) > 0, F.lit(p)) for p in V.PROFILES["health-content"]["compliance"]])), ",").alias("red_lines")
    ),
    C.own_compliance_sql(),
)
register(
    "sc03_hit_rows",
    lambda spark, sf_dir: score.hit_rows(score.with_score(seeded(spark, sf_dir))).groupBy("category", F.coalesce("pattern_id", F.lit("-")).alias("pattern_id")).agg(
        F.count("*").alias("n"), F.sum("penalty").cast("long").alias("penalty"), F.countDistinct("doc_id").alias("docs")
    ),
    C.hit_rows_sql(),
)

# --- density ---


def density_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeded(spark, sf_dir).select("doc_id", *detect.density_columns(F.col("text")))


register("dt10_density", density_query, C.density_sql())


def paragraph_density_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = seeded(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("idx", "par"))
    df = parts.select("doc_id", F.col("idx").cast("long"), *detect.density_columns(F.col("par"), 2, 1), F.concat(F.substring("par", 1, detect.PREVIEW), F.when(F.length("par") > detect.PREVIEW, "...").otherwise("")).alias("preview"))
    return df.filter("tier2 + tier3 > 0")


register("dt11_paragraph_density", paragraph_density_query, C.paragraph_density_sql())
register(
    "dt12_mock_detector",
    lambda spark, sf_dir: seeded(spark, sf_dir).filter(F.contains("text", F.lit("值得注意的是"))).select("doc_id", F.lit("p08").alias("pattern_id")),
    f"WITH {C.SEEDED_SQL} SELECT doc_id, 'p08' AS pattern_id FROM seeded WHERE contains(text, '值得注意的是')",
)



def model_detector_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model's replies list of each document, by a transport that answers as a service would."""
    detector = model.create_detector(True, "openai", model.mock_detector_transport)
    each = lambda d: F.concat_ws(":", d["pattern_id"], d["matched_text"], d["confidence"].cast("string"))
    return detector(seeded(spark, sf_dir)).select("doc_id", F.size("detections").cast("long").alias("found"), F.array_join(F.transform("detections", each), "|").alias("listed"))


register("dt13_model_detector", model_detector_query, C.detector_transport_sql())

# --- professionalism ---


def professional_query(*names: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return professional.with_professionalism(seeded(spark, sf_dir)).select("doc_id", *names)
    return run


for _i, _m in enumerate(professional.MEASURES, 1):
    register(f"pf{_i:02d}_{_m}", professional_query(_m), C.professional_sql(_m))
register("pf06_professionalism", professional_query("professionalism"), C.professional_sql("professionalism"))

# --- character forensics ---


def watermark_query(clean: bool) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = watermark.with_watermark(seeded(spark, sf_dir), clean=clean)
        return df.select(
            "doc_id", F.col("zero_width_removed").cast("long"), F.col("homoglyph_replaced").cast("long"), F.col("bom_detected").cast("int"), F.col("synthid_suspect").cast("int"),
            F.coalesce("dominant_char", F.lit("")).alias("dominant_char"), F.array_join("warnings", "|").alias("warnings"), F.md5(F.col("cleaned_text").cast("binary")).alias("cleaned_md5"),
        )
    return run


register("wm05_watermark", watermark_query(False), C.watermark_sql(False))
register("wm05_watermark_clean", watermark_query(True), C.watermark_sql(True))
register(
    "wm01_zero_width", lambda spark, sf_dir: seeded(spark, sf_dir).select("doc_id", watermark.zero_width_count(F.col("text")).cast("long").alias("n")),
    f"WITH {C.SEEDED_SQL} SELECT doc_id, len(regexp_extract_all(text, '[\\x{{200b}}\\x{{200c}}\\x{{200d}}\\x{{feff}}]'))::BIGINT AS n FROM seeded",
)
register(
    "wm02_full_width", lambda spark, sf_dir: seeded(spark, sf_dir).select("doc_id", watermark.wide_count(F.col("text")).cast("long").alias("n")),
    f"WITH {C.SEEDED_SQL} SELECT doc_id, len(regexp_extract_all(text, '[Ａ-Ｚａ-ｚ０-９]'))::BIGINT AS n FROM seeded",
)
register(
    "wm03_compatibility", lambda spark, sf_dir: seeded(spark, sf_dir).select("doc_id", watermark.compatibility_count(F.col("text")).cast("long").alias("n")),
    f"WITH {C.SEEDED_SQL} SELECT doc_id, len(regexp_extract_all(text, '[\\x{{f900}}-\\x{{faff}}]'))::BIGINT AS n FROM seeded",
)
register("wm04_dominant_char", lambda spark, sf_dir: watermark.with_watermark(seeded(spark, sf_dir)).select("doc_id", F.coalesce("dominant_char", F.lit("")).alias("ch")), C.dominant_sql())

# --- scenes ---


def features_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scene.with_features(seeded(spark, sf_dir))
    return df.select("doc_id", *[F.round(f"features.{n}", 6).alias(n) for n in C.FEATURES])


def scene_query(*columns: str, path: bool = False) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = seeded(spark, sf_dir)
        if path:
            df = df.withColumn("path", F.when(F.col("doc_id") % 3 == 0, F.lit("docs/Blog/x.md")).when(F.col("doc_id") % 3 == 1, F.lit("src/a.py")))
        df = scene.with_scene(df, path="path" if path else None)
        made = {
            "confidence": F.round("confidence", 6), "guessed_scene": F.coalesce("guessed_scene", F.lit("-")), "needs_confirmation": F.col("needs_confirmation").cast("int"),
            "evidence": F.array_join("evidence", "|"), **{f"score_{s}": F.round(f"score_{s}", 6) for s in scene.SCENES},
        }
        return df.select("doc_id", *[made.get(c, F.col(c)).alias(c.replace("-", "_")) for c in columns])
    return run


_ALL = ["scene", "confidence", "guessed_scene", "needs_confirmation", *(f"score_{s}" for s in scene.SCENES)]
register("sn01_features", features_query, C.features_sql())
for _no, _s in (("sn02", "social-note"), ("sn03", "health-content"), ("sn04", "tech-doc")):
    register(f"{_no}_signals_{_s.partition('-')[0]}", scene_query(f"score_{_s}"), C.scene_sql([f"score_{_s}"]))
register("sn05_path_prior", scene_query(*_ALL, path=True), C.scene_sql(_ALL, path=True))
register("sn06_scene", scene_query(*_ALL), C.scene_sql(_ALL))
register("sn07_recognize", scene_query("scene"), C.scene_sql(["scene"]))


def asking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that ask for a scene: by name, by alias, by themselves, or for one that isn't there."""
    return seeded(spark, sf_dir).withColumn("asked", F.expr(C.asked_sql()))


def chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scene.with_chosen(asking(spark, sf_dir), F.col("asked"), "scene").select("doc_id", "scene")


def names_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a name of a scene each, some of them unknown or written otherwise."""
    return seeded(spark, sf_dir).select("doc_id", F.get(F.array(*map(F.lit, C.NAMES)), (F.col("doc_id") % len(C.NAMES)).cast("int")).alias("name"))


def by_scene(table: Callable[[SparkSession], DataFrame]) -> Query:
    """A small table of scenes with the number of documents that ask for each."""
    return lambda spark, sf_dir: chosen(spark, sf_dir).groupBy("scene").agg(F.count("*").alias("docs")).join(F.broadcast(table(spark)), "scene")


register("sn08_resolve_profile", lambda spark, sf_dir: names_frame(spark, sf_dir).select("doc_id", "name", scene.resolved(F.col("name")).alias("profile"), scene.canonical(F.col("name")).isNull().cast("int").alias("fell_back")), C.by_name(C.resolve_sql()))
register("sn12_canonical", lambda spark, sf_dir: names_frame(spark, sf_dir).select("doc_id", "name", F.coalesce(scene.canonical(F.col("name")), F.lit("?")).alias("canonical")), C.by_name(C.canonical_sql()))
register("sn10_active_patterns", by_scene(lambda spark: spark.createDataFrame([(s, p) for s in V.PROFILES for p in H.active(s)], "scene string, pattern_id string")), C.with_scene_counts(C.active_sql()))
register("sn11_profiles", by_scene(lambda spark: spark.createDataFrame([(s, p["label"], *p["policy"]) for s, p in V.PROFILES.items()], "scene string, label string, warn_at int, rewrite_at int, block_at int")), C.with_scene_counts(C.profiles_sql()))

# --- phrases, punctuation, paragraphs ---



def word_query(listed: list[str]) -> Query:
    """Documents that hold each of the listed words."""
    return lambda spark, sf_dir: seeded(spark, sf_dir).select(F.explode(present(F.col("text"), listed)).alias("word")).groupBy("word").agg(F.count("*").alias("docs"))


def unlisted_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by leftover word that is no first-tier word: an anti-join with a fixed small table."""
    tier1 = spark.createDataFrame([(w,) for w in V.TIER1_ZH], "word string")
    return word_query(V.RESIDUAL_WORDS)(spark, sf_dir).join(F.broadcast(tier1), "word", "left_anti")


register("ph05_residual_words", word_query(V.RESIDUAL_WORDS), C.with_word_counts(V.RESIDUAL_WORDS))
register("ph02_replacements", lambda spark, sf_dir: seeded(spark, sf_dir).select("doc_id", F.md5(phrases.replaced(F.col("text")).cast("binary")).alias("md5")), C.replacements_sql())
register("ph04_phrase_rewrite", lambda spark, sf_dir: seeded(spark, sf_dir).select("doc_id", phrases.rewritten(F.col("text")).alias("out")).select("doc_id", F.length("out").cast("long").alias("n"), F.md5(F.col("out").cast("binary")).alias("md5")), C.phrases_sql())
register("ph03_cleanup", lambda spark, sf_dir: seeded(spark, sf_dir).select("doc_id", F.md5(phrases.tidy(F.col("text")).cast("binary")).alias("md5")), C.tidy_sql())
register("pn01_normalized", lambda spark, sf_dir: seeded(spark, sf_dir).select("doc_id", punctuation.normalized(F.col("text")).alias("out")).select("doc_id", F.length("out").cast("long").alias("n"), F.md5(F.col("out").cast("binary")).alias("md5")), C.normalized_sql())
for _name, _step in punctuation.STEPS.items():
    register(_name, lambda spark, sf_dir, f=_step: seeded(spark, sf_dir).select("doc_id", F.md5(f(F.col("text")).cast("binary")).alias("md5")), C.PUNCTUATION_SQL.get(_name))
register("pn09_protected_tokens", lambda spark, sf_dir: seeded(spark, sf_dir).select("doc_id", F.array_join(punctuation.protected_tokens(F.col("text")), "|").alias("tokens")), C.protected_tokens_sql())
register(
    "pn10_tokens_preserved",
    lambda spark, sf_dir: seeded(spark, sf_dir).select("doc_id", punctuation.tokens_preserved(F.col("text"), F.replace(F.col("text"), F.lit("v1."), F.lit("v 1."))).cast("int").alias("kept")),
    C.tokens_preserved_sql(),
)
register("dd01_normal_form", lambda spark, sf_dir: seeded(spark, sf_dir).select("doc_id", F.md5(paragraphs.normal_form(F.col("text")).cast("binary")).alias("md5")), C.normal_form_sql())
register("dd02_paragraphs", lambda spark, sf_dir: seeded(spark, sf_dir).select("doc_id", F.size(paragraphs.paragraphs(F.col("text"))).cast("long").alias("n")), C.paragraphs_sql())
register("dd04_without_notes", lambda spark, sf_dir: seeded(spark, sf_dir).select("doc_id", F.md5(paragraphs.without_notes(F.col("text")).cast("binary")).alias("md5")), C.notes_sql())
register(
    "dd05_dedup",
    lambda spark, sf_dir: paragraphs.with_dedup(seeded(spark, sf_dir)).select("doc_id", "removed_exact", "removed_near", "paragraphs_before", "paragraphs_after", "after_chars", F.md5(F.col("deduped").cast("binary")).alias("md5")),
)
register("dd06_exact_copies", lambda spark, sf_dir: paragraphs.exact_copies(spark.read.parquet(f"{sf_dir}/documents.parquet")), C.exact_copies_sql())

register("dd06_near_copies", lambda spark, sf_dir: near_copies.near_copies(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", F.col("first").alias("first_id"), "copies", "group_rows"))
register(
    "dd03_near_pairs",
    lambda spark, sf_dir: near_copies.links(near_copies.corpus_nodes(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("node", "form")),
)

# --- rule rewriting ---


def digest(make: Callable[[Column], Column]) -> Query:
    """doc_id, length and digest of a text made from the seeded one."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = seeded(spark, sf_dir).select("doc_id", make(F.col("text")).alias("o"))
        return df.select("doc_id", F.length("o").cast("long").alias("n"), F.md5(F.col("o").cast("binary")).alias("md5"))
    return run


_NUMBERS = {"p02": "rw04", "p03": "rw05", "p04": "rw06", "p06": "rw08", "p08": "rw10", "p09": "rw11", "p11": "rw13", "p12": "rw14", "p13": "rw15", "p15": "rw17", "p16": "rw18", "p19": "rw21", "p21": "rw23", "p22": "rw24", "p24": "rw26"}
for _p, _no in _NUMBERS.items():
    register(f"{_no}_delete_{_p}", digest(lambda t, p=_p: rewrite.deleted(t, p)), C.deleted_sql(_p))


def without_tier1(text: Column) -> Column:
    for w in V.TIER1_ZH:
        text = F.replace(text, F.lit(w), F.lit(""))
    return text


register("rw30_tier1_deletion", digest(without_tier1), C.tier1_deleted_sql())
register("rw01_rewrite", digest(lambda t: rewrite.rewritten(t)))


def report_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores before and after the rules."""
    df = score.with_score(rewrite.with_rewrite(seeded(spark, sf_dir))).select("doc_id", "rewritten", "changed", F.col("score").alias("score_before"))
    df = score.with_score(df, text="rewritten")
    return df.select("doc_id", F.col("changed").cast("int"), "score_before", F.col("score").alias("score_after"))


register("sc12_report", report_query)

# --- gates and the model ---


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.with_score(seeded(spark, sf_dir))


register(
    "gt01_exit_codes",
    lambda spark, sf_dir: scored(spark, sf_dir).select("doc_id", gate.exit_code(F.col("action"), F.col("compliance_hit"), True).alias("gated"), gate.exit_code(F.col("action"), F.col("compliance_hit"), False).alias("ungated")),
    C.gate_sql(),
)


def rewritten_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewrite.with_rewrite(seeded(spark, sf_dir)).select("doc_id", "rewritten")


# Strategies look at the score, and the strict check at the words, of what the rules have made of a text.
register(
    "gt02_strategies",
    lambda spark, sf_dir: score.with_score(rewritten_once(spark, sf_dir), text="rewritten").select("doc_id", *[gate.needs_model(s, F.col("score")).cast("int").alias(n) for s, n in (("auto", "auto_llm"), ("rules", "rules"), ("rules+llm", "rules_llm"))]),
)
register("gt03_strict", lambda spark, sf_dir: rewritten_once(spark, sf_dir).select("doc_id", gate.strict_code(F.col("rewritten")).alias("code")))
register("gt07_structured", lambda spark, sf_dir: seeded(spark, sf_dir).select("doc_id", gate.structured(F.col("text")).cast("int").alias("structured")), C.structured_sql())
register("gt06_eligible", lambda spark, sf_dir: seeded_long(spark, sf_dir).select("doc_id", gate.eligible(F.col("text")).cast("int").alias("eligible")), C.eligible_sql())
register("gt08_delivery", lambda spark, sf_dir: gate.with_delivery(seeded(spark, sf_dir)).select("doc_id", "route", "candidate_score", F.md5(F.col("delivered").cast("binary")).alias("md5")))
register("lm02_strip_thinking", lambda spark, sf_dir: seeded(spark, sf_dir).select("doc_id", F.md5(model.without_thinking(F.col("text")).cast("binary")).alias("md5")), C.thinking_sql())
register(
    "lm04_model_rewrite",
    lambda spark, sf_dir: model.rewrite_with_model(spread(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "text")), model.mock_transport).select("conv_id", "turn", F.length("model_text").cast("long").alias("n"), F.md5(F.col("model_text").cast("binary")).alias("md5")),
)
register("io07_json_report", lambda spark, sf_dir: files.json_reports(scored(spark, sf_dir), "score", "action").select("doc_id", "report"), C.report_sql())


def acceptance_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By set: texts, those found dirty, and the scores' range. All adversarial ones have to be dirty, no plain one may be."""
    df = score.with_score(with_acceptance(spark, sf_dir), "social-note")
    kind = F.when(F.col("doc_id") <= -100, "plain").when(F.col("doc_id") < 0, "adversarial").otherwise("corpus")
    dirty = F.count_if((F.col("raw") > 0) | F.col("compliance_hit"))
    return df.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), dirty.alias("dirty"), F.min("score").alias("least"), F.max("score").alias("most"))


register("ac01_acceptance", acceptance_query, C.acceptance_sql())


def versions_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as it is, with phrases replaced, and without first-tier words too: no version may score less than the one before."""
    df = computed_once(seeded(spark, sf_dir), plain=phrases.replaced(F.col("text")))
    made = df.select("doc_id", F.posexplode(F.array(F.col("text"), F.col("plain"), without_tier1(F.col("plain")))).alias("no", "text"))
    report = score.version_report(made.select("doc_id", (F.col("no") + 1).alias("version"), "text"))
    return report.select("doc_id", "version", "score", F.coalesce("before", F.lit(-1)).alias("before"), F.col("fell").cast("int"))


register("ac01_versions", versions_query, C.versions_sql())


def report_cube_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = score.hit_report(score.with_score(asking(spark, sf_dir), F.col("asked")))
    return df.select(F.coalesce("scene", F.lit("*")).alias("scene"), F.coalesce("category", F.lit("*")).alias("category"), "hits", "penalty", "docs")


register("rp01_scene_category_cube", report_cube_query, C.cube_sql())

# --- implicit relational operators ---


def domain_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by profile and domain word: the words are a fixed small table."""
    rows = [(s, w) for s, p in V.PROFILES.items() for w in p.get("domain", [])]
    domain = F.broadcast(spark.createDataFrame(rows, "profile string, word string"))
    return seeded(spark, sf_dir).join(domain, F.contains("text", "word")).groupBy("profile", "word").agg(F.count("*").alias("docs"))


register("im01_anti_join", unlisted_query, C.with_word_counts([w for w in V.RESIDUAL_WORDS if w not in V.TIER1_ZH]))
register("im02_domain_join", domain_query, C.domain_sql())
register("im03_span_cover", lambda spark, sf_dir: score.with_body(seeded(spark, sf_dir)).select("doc_id", F.explode(H.word_spans(H.unquoted(F.col("body")), V.HARD_SLANG)).alias("s")).groupBy("doc_id", F.col("s.t").alias("word")).agg(F.count("*").alias("n")), C.covered_sql())
register("im03_outermost", lambda spark, sf_dir: score.with_body(seeded(spark, sf_dir)).select("doc_id", F.explode(H.outermost_words(H.unquoted(F.col("body")), V.HARD_SLANG + V.LIGHT_COLLOQUIAL)).alias("s")).groupBy("doc_id", F.col("s.t").alias("word")).agg(F.count("*").alias("n")), C.outermost_sql())
register("im04_having", lambda spark, sf_dir: score.hit_rows(scored(spark, sf_dir)).groupBy("doc_id", "category").agg(F.count("*").alias("n")).filter("n >= 2"), C.having_sql())
register("im06_ordered_distinct", lambda spark, sf_dir: seeded(spark, sf_dir).select("doc_id", F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Z]{2,}"), 0))), "|").alias("acronyms")), C.distinct_sql())
register("im09_preview", lambda spark, sf_dir: seeded(spark, sf_dir).select("doc_id", F.substring("text", 1, 50).alias("preview")), C.preview_sql())

# --- single rewriting patterns and the rest of the inventory ---

_REWRITING = {
    "rw12_delete_p10": rewrite.ordinals_deleted, "rw16_verbs_p14": rewrite.verbs_freed, "rw19_plain_p17": rewrite.plain_words, "rw28_subjects_p26": rewrite.subjects_replaced,
    "rw31_mechanical": lambda t: rewrite.chain_deleted(t, V.MECHANICAL), "rw35_listed": lambda t: rewrite.chain_deleted(t, rewrite.LISTED_DELETIONS),
    "rw36_leftovers": rewrite.leftovers_cleaned, "rw39_final": rewrite.finally_cleaned,
}
for _name, _make in _REWRITING.items():
    register(_name, digest(_make), C.rewriting_sql()[_name])


def span_digest(make: Callable[[Column], Column]) -> Query:
    """As `digest`, over documents led by openings and closings."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = seeded_spans(spark, sf_dir).select("doc_id", make(F.col("text")).alias("o"))
        return df.select("doc_id", F.length("o").cast("long").alias("n"), F.md5(F.col("o").cast("binary")).alias("md5"))
    return run


_SPANNING = {
    "rw02_layout": rewrite.laid_out, "rw03_reversals_zh": rewrite.reversals_zh, "rw03_reversals_en": rewrite.reversals_en, "rw09_imbalances": rewrite.imbalances,
    "rw22_coordinations_zh": rewrite.coordinations_zh, "rw22_coordinations_en": rewrite.coordinations_en, "rw32_symmetry_zh": rewrite.symmetry_collapsed,
    "rw33_symmetry_en": rewrite.symmetry_collapsed_en, "rw34_cross_sentence": rewrite.cross_sentences, "rw37_residue": rewrite.residue_cleaned, "rw38_sentences": rewrite.sentences_joined,
}
for _name, _make in _SPANNING.items():
    register(_name, span_digest(_make), C.span_sql().get(_name))


def protected_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of each document that no phrase may touch, and what lies between them."""
    pieces, kept = phrases.parted(F.col("text"))
    df = seeded_spans(spark, sf_dir).select("doc_id", pieces.alias("g"), kept.alias("k"))
    joined = lambda c: F.md5(F.array_join(c, C.BAR).cast("binary"))
    return df.select("doc_id", F.size("k").cast("long").alias("parts"), joined("k").alias("parts_md5"), joined("g").alias("gaps_md5"))


register("ph01_protected_parts", protected_query, C.span_sql()["ph01_protected_parts"])


@F.pandas_udf(StringType())
def markdown_column(texts: pd.Series) -> pd.Series:
    return texts.map(rewrite.rewrite_markdown)


def keyword_query(listed: list[str]) -> Query:
    return lambda spark, sf_dir: seeded(spark, sf_dir).select("doc_id", F.array_join(present(F.col("text"), listed), "|").alias("found"))


register("rl12_strong_keywords", keyword_query(V.STRONG_KEYWORDS), C.keyword_sql(V.STRONG_KEYWORDS))
register("rl13_weak_keywords", keyword_query(V.WEAK_KEYWORDS), C.keyword_sql(V.WEAK_KEYWORDS))


def counts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = professional.with_counts(seeded(spark, sf_dir))
    return df.select("doc_id", F.col("__abstract").cast("long").alias("abstract_words"), F.col("__specific").cast("long").alias("specifics"))


register("rl15_rl16_counts", counts_query, C.counts_sql())


def accessors(spark: SparkSession) -> DataFrame:
    """What the profiles say of each rule: its price, whether its category is left out, whether it is a red line, its exempt words."""
    rules = spark.createDataFrame(list(C.ACCESSOR_COSTS.items()), "key string, cost int")
    fields = "scene string, penalties map<string,int>, off array<string>, compliance array<string>, exempt map<string,array<string>>"
    profiles = spark.createDataFrame([(s, p.get("penalties", {}), p.get("off", []), p.get("compliance", []), p.get("exempt", {})) for s, p in V.PROFILES.items()], fields)
    each = profiles.join(F.broadcast(rules))
    return each.select(
        "scene", "key", F.coalesce(F.element_at("penalties", F.col("key")), "cost").alias("penalty"), F.array_contains("off", F.col("key")).cast("int").alias("off"),
        F.array_contains("compliance", F.col("key")).cast("int").alias("compliance"), F.coalesce(F.array_join(F.element_at("exempt", F.col("key")), "|"), F.lit("")).alias("exempt"),
    )


register("sn13_accessors", by_scene(accessors), C.with_scene_counts(C.accessor_sql()))


def whitelist_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are a golden input but for white space at their ends: a semi-join with a fixed small table."""
    golden = F.broadcast(spark.createDataFrame([(w.strip(),) for w in C.WHITELIST], "bare string"))
    df = seeded_alone(spark, sf_dir).withColumn("bare", stripped(F.col("text")))
    return df.join(golden, "bare", "left_semi").select("doc_id")


register("im07_whitelist", whitelist_query, C.whitelist_sql())


def top_scenes_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scene.with_scene(seeded(spark, sf_dir))
    each = F.array(*[F.struct((-F.col(f"score_{s}")).alias("back"), F.lit(i).alias("no"), F.lit(s).alias("name")) for i, s in enumerate(scene.SCENES)])
    top = df.select("doc_id", F.posexplode(F.slice(F.array_sort(each), 1, 2)).alias("at", "x"))
    return top.select("doc_id", F.col("x.name").alias("name"), F.round(-F.col("x.back"), 6).alias("score"), (F.col("at") + 1).cast("int").alias("rank"))


register("im05_top_scenes", top_scenes_query, C.top_scenes_sql())
register("gt04_density_code", lambda spark, sf_dir: density_query(spark, sf_dir).select("doc_id", F.col("should_rewrite").alias("code")), C.gate_density_sql())


def preview_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(s, p["label"], *p["policy"], ",".join(p.get("compliance", []))) for s, p in V.PROFILES.items()]
    profiles = F.broadcast(spark.createDataFrame(rows, "scene string, label string, warn_at int, rewrite_at int, block_at int, compliance string"))
    return scene.with_scene(seeded(spark, sf_dir)).select("doc_id", "scene").join(profiles, "scene")


register("gt05_scene_preview", preview_query, C.preview_scene_sql())


def prepared_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is sent at once and whether an edit is to follow (async mode)."""
    df = gate.with_send(seeded_long(spark, sf_dir), {"enabled": True, "mode": "async_edit"})
    return df.select("doc_id", F.length("send_text").cast("long").alias("sent_chars"), F.col("pending_text").isNotNull().cast("int").alias("edit_follows"))


register("gt09_prepare_send", prepared_query, f"WITH {C.LONG_SQL}, e AS ({C.eligible_sql()}) SELECT s.doc_id, length(text) AS sent_chars, eligible AS edit_follows FROM long s JOIN e USING (doc_id)")
register(
    "gt09_send_sync",
    lambda spark, sf_dir: gate.with_send(seeded_long(spark, sf_dir), {"enabled": True, "mode": "sync"}).select("doc_id", F.length("send_text").cast("long").alias("sent_chars"), F.md5(F.col("send_text").cast("binary")).alias("md5")),
)
register(
    "gt10_edits",
    lambda spark, sf_dir: gate.with_edit(seeded_long(spark, sf_dir), {"enabled": True, "mode": "async_edit"}, model.mock_transport).select("doc_id", F.md5(F.col("edited").cast("binary")).alias("md5")),
)
register("gt11_keys", lambda spark, sf_dir: seeded(spark, sf_dir).select("doc_id", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", gate.settings_lines(F.col("line")).alias("s")).filter("s is not null").select("doc_id", "s.name", "s.value", gate.usable_key(F.col("s.value")).cast("int").alias("usable")), C.keys_sql())

# --- scenes asked for by row ---


def profile_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(s, p["label"], p["policy"][0], p["policy"][2]) for s, p in V.PROFILES.items()]
    profiles = F.broadcast(spark.createDataFrame(rows, "scene string, label string, warn_at int, block_at int"))
    return chosen(spark, sf_dir).join(profiles, "scene").select("doc_id", "scene", "label", "warn_at", "block_at")


def score_by_row_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = score.with_score(asking(spark, sf_dir), F.col("asked"))
    return df.select("doc_id", "scene", "score", "raw", F.col("hit_count").cast("long"), F.col("char_count").cast("long"), F.col("compliance_hit").cast("int"), "action")


register("sn09_profile_for_text", profile_query, C.profile_for_text_sql())
register("gt12_scene_choice", chosen, C.chosen_sql())
register("sc05_score_by_row", score_by_row_query, C.score_by_row_sql())
register(
    "rw42_scene_rewrite",
    lambda spark, sf_dir: rewrite.with_scene_rewrite(seeded(spark, sf_dir).withColumn("path", F.when(F.col("doc_id") % 3 == 0, F.lit("docs/Blog/x.md")))).select("doc_id", "scene", "scene_confidence", F.col("changed").cast("int"), F.md5(F.col("output").cast("binary")).alias("md5")),
)
register(
    "rw41_strict_whitelist",
    lambda spark, sf_dir: rewrite.with_rewrite(seeded_alone(spark, sf_dir), golden=C.WHITELIST).select("doc_id", F.col("changed").cast("int"), F.length("rewritten").cast("long").alias("n")),
)


def prompt_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """System prompt by the scene asked for, user prompt by the text."""
    df = scene.with_chosen(asking(spark, sf_dir), F.col("asked"), "scene")
    user = F.concat(F.lit("---\n"), F.col("text"), F.lit("\n---"))
    return df.select("doc_id", F.md5(model.system_of(F.col("scene")).cast("binary")).alias("system_md5"), F.md5(user.cast("binary")).alias("user_md5"))


register("lm03_prompts", prompt_query, C.prompt_sql())
register("lm01_chunks", lambda spark, sf_dir: seeded(spark, sf_dir).select("doc_id", F.posexplode(model.in_chunks("text", F.lit(model.MAX_CHARS))).alias("no", "chunk")).select("doc_id", "no", F.length("chunk").alias("n")))
register("rw43_markdown", digest(lambda t: markdown_column(t)))


def items_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = seeded(spark, sf_dir).select("doc_id", F.explode(F.split("text", "[、，,]", -1)).alias("s"))
    bare = F.regexp_replace("s", F.lit(f"(?U)^{V.WRAPPERS}+|{V.WRAPPERS}+$"), F.lit(""))
    return parts.groupBy("doc_id").agg(F.max(F.length(bare)).cast("long").alias("longest"))


register("sc13_item_length", items_query, C.item_length_sql())
