"""Gates: exit codes, strategies, eligibility, and the staged delivery pipeline up to the model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonewright.functions.text import computed_once, count_matches, stripped
from tonewright.operators import detect, model, phrases, punctuation, score
from tonewright.operators import scene as scenes

#: Defaults of the delivery settings; unknown keys of an overlay are ignored, as are nulls.
SETTINGS = {
    "enabled": False, "min_chars": 200, "pass_score": 85, "llm_timeout": 90, "llm_max_chunk_chars": 1500,
    "min_keep_chars": 80, "mode": "sync", "skip_code_for_llm": True, "scene": "auto", "respect_compliance": True,
}
MEDIA = ["MEDIA:", "[[as_document]]", "[[audio_as_voice]]"]
PICTURE = r"(?i)!\[[^\]]*\]\([^)]*\)|<img\s"


def settings(overlay: dict | None) -> dict:
    return SETTINGS | {k: v for k, v in (overlay or {}).items() if k in SETTINGS and v is not None}


def exit_code(action: Column, compliance: Column, gate: bool, force: bool = False) -> Column:
    """2 for a red line (unless forced) and, at a gate, for block; 1 at a gate for warn; else 0."""
    red = compliance & F.lit(not force)
    return F.when(red | (F.lit(gate) & (action == "block")), 2).when(F.lit(gate) & (action == "warn"), 1).otherwise(0)


def needs_model(strategy: str, score_after_rules: Column, trigger: int = 70) -> Column:
    """Does a strategy send the text to the model? `auto` asks for a low score after the rules."""
    if strategy not in ("rules", "rules+llm", "llm-only", "auto"):
        raise ValueError(f"unknown strategy {strategy}")
    return (score_after_rules < trigger) if strategy == "auto" else F.lit(strategy != "rules")


def strict_code(rewritten: Column) -> Column:
    """3 if a first-tier word is left."""
    return F.when(F.size(detect.tier1(rewritten)) > 0, 3).otherwise(0)


def eligible(text: Column, min_chars: int = SETTINGS["min_chars"], least_share: float = 0.3) -> Column:
    """Long enough, no media or pictures, at least twenty Chinese characters and a share of all."""
    t = stripped(F.coalesce(text, F.lit("")))
    marked = F.rlike(t, F.lit("|".join(f"\\Q{m}\\E" for m in MEDIA))) | F.rlike(t, F.lit(PICTURE))
    enough = count_matches(t, r"[\x{4e00}-\x{9fff}]") >= F.greatest(F.lit(20), (F.length(t) * F.lit(least_share)).cast("int"))
    return (F.length(t) >= min_chars) & ~marked & enough


def structured(text: Column) -> Column:
    """Code, addresses or mail in the text: the model is not to touch it."""
    return F.rlike(text, F.lit(punctuation.PROTECTED))


def with_delivery(df: DataFrame, scene: str | Column = SETTINGS["scene"], text: str = "text", pass_score: int = SETTINGS["pass_score"], respect_compliance: bool = True) -> DataFrame:
    """Adds normalized, scene, candidate, candidate_score, delivered and route.

    The scene is that of the normalized text. Routes: original (a red line: the text goes out as it came), rules (good
    enough after normalising and phrases), model (to be rewritten by a model; `delivered` holds the normalised text until then).
    """
    keep = [c for c in df.columns if c != "scene"]
    df = computed_once(df, normalized=punctuation.normalized(F.coalesce(F.col(text), F.lit(""))))
    df = scenes.with_chosen(df, scene, "__chosen", "normalized")
    fixed = None if isinstance(scene, Column) or (scene or "").strip().lower() in scenes.AUTO else scenes.known(scene)
    which = fixed or score.by_row(F.col("__chosen"))
    df = score.with_red_line(df, which, "normalized") if respect_compliance else df.withColumn("red_line", F.lit(False))
    out = stripped(phrases.rewritten(F.col("normalized")))
    df = computed_once(df, __out=out)
    usable = (F.col("__out") != "") & (F.col("__out") != F.col("normalized")) & punctuation.tokens_preserved(F.col("normalized"), F.col("__out"))
    # A text that goes out as it came needs no candidate and no score.
    df = computed_once(df, candidate=F.when(F.col("red_line"), "").when(usable, F.col("__out")).otherwise(F.col("normalized")))
    df = score.with_score(df, which, "candidate").select(*keep, "normalized", F.col("__chosen").alias("scene"), "red_line", "candidate", F.col("score").alias("candidate_score"))
    red, good = F.col("red_line"), F.col("candidate_score") >= pass_score
    delivered = F.when(red, F.col(text)).when(good, punctuation.normalized(F.col("candidate"))).otherwise(F.col("normalized"))
    return df.withColumn("delivered", delivered).withColumn("route", F.when(red, "original").when(good, "rules").otherwise("model"))


def delivered_by_model(staged: DataFrame, transport: model.Transport, overlay: dict | None = None) -> DataFrame:
    """Of `with_delivery`, rows of route `model` rewritten: `delivered` is the accepted rewrite, else the normalised text stays.

    Adds model_error, why a rewrite failed; a rewrite that was not accepted is an error of its own.
    """
    held = settings(overlay)
    keep = staged.columns
    asked = F.col("route") == "model"
    made = model.rewrite_with_model(staged, transport, "candidate", F.col("scene"), int(held["llm_max_chunk_chars"]), only=asked, timeout=float(held["llm_timeout"]))
    made = made.withColumn("__rewrite", F.when(F.col("model_error").isNull(), stripped(F.col("model_text"))))
    judged = score.with_score(made.select(*keep, "model_error", "__rewrite", F.col("scene").alias("__as")), score.by_row(F.col("__as")), "__rewrite")
    judged = judged.select(*[F.col(c) if c != "scene" else F.col("__as").alias("scene") for c in keep], "model_error", "__rewrite", F.col("score").alias("__score"))
    good = accepted(F.col("candidate"), F.col("__rewrite"), F.col("__score"), int(held["pass_score"]), int(held["min_keep_chars"]), F.col("normalized"))
    used = (F.col("route") == "model") & good
    why = F.when((F.col("route") == "model") & ~good, F.coalesce("model_error", F.lit("not accepted")))
    return judged.select(*[F.when(used, punctuation.normalized(F.col("__rewrite"))).otherwise(F.col("delivered")).alias("delivered") if c == "delivered" else F.col(c) for c in keep], why.alias("model_error"))


def with_send(df: DataFrame, overlay: dict | None = None, transport: model.Transport | None = None, text: str = "text") -> DataFrame:
    """Adds send_text and pending_text: what goes out at once, and what is to be edited later (null if nothing is).

    Not enabled, or a text that is not eligible: the text as it came. Mode async_edit: the text as it came, and it again to
    be edited. Mode sync: the delivered text; without a transport, texts that need a model go out normalised.
    """
    held = settings(overlay)
    keep = df.columns
    whole = F.coalesce(F.col(text), F.lit(""))
    due = F.lit(bool(held["enabled"])) & eligible(F.col(text), int(held["min_chars"]))
    if held["mode"] == "async_edit" or not held["enabled"]:
        return df.select(*keep, whole.alias("send_text"), F.when(due, whole).alias("pending_text"))
    given = df.withColumn("__due", due).withColumn("__given", F.when(F.col("__due"), whole).otherwise(F.lit("")))
    staged = with_delivery(given, held["scene"], "__given", int(held["pass_score"]), bool(held["respect_compliance"]))
    done = staged if transport is None else delivered_by_model(staged, transport, overlay)
    return done.select(*[c for c in keep if c in done.columns], F.when(F.col("__due"), F.col("delivered")).otherwise(whole).alias("send_text"), F.lit(None).cast("string").alias("pending_text"))


def with_edit(df: DataFrame, overlay: dict | None = None, transport: model.Transport | None = None, text: str = "text") -> DataFrame:
    """Adds edited: what a text that was sent as it came is to be replaced by; null where nothing is to be done.

    Null if not enabled, not eligible, technical (code, addresses) where these are skipped, unchanged, or whatever failed.
    """
    held = settings(overlay)
    keep = df.columns
    whole = F.coalesce(F.col(text), F.lit(""))
    if not held["enabled"]:
        return df.withColumn("edited", F.lit(None).cast("string"))
    due = eligible(F.col(text), int(held["min_chars"]))
    due = due & ~structured(whole) if held["skip_code_for_llm"] else due
    given = df.withColumn("__due", due).withColumn("__given", F.when(F.col("__due"), whole).otherwise(F.lit("")))
    staged = with_delivery(given, held["scene"], "__given", int(held["pass_score"]), bool(held["respect_compliance"]))
    done = staged if transport is None else delivered_by_model(staged, transport, overlay)
    out = stripped(F.col("delivered"))
    return done.select(*[c for c in keep if c in done.columns], F.when(F.col("__due") & (out != "") & (out != whole), out).alias("edited"))


def usable_key(value: Column) -> Column:
    """Is a key there, and not a variable that nobody filled in?"""
    return F.coalesce((value != "") & ~F.contains(value, F.lit("${")) & ~F.startswith(value, F.lit("$")), F.lit(False))


def settings_lines(lines: Column) -> Column:
    """struct<name, value> of a line `NAME=value`; null for comments and other lines. Quotes around the value go."""
    bare = stripped(lines)
    name = stripped(F.substring_index(bare, "=", 1))
    value = stripped(F.substring(bare, F.length(F.substring_index(bare, "=", 1)) + F.lit(2), F.length(bare)))
    value = F.btrim(F.btrim(value, F.lit('"')), F.lit("'"))
    return F.when(F.contains(bare, F.lit("=")) & ~F.startswith(bare, F.lit("#")), F.struct(name.alias("name"), value.alias("value")))


def resolve_key(environment: dict[str, str], lines: DataFrame | None, name: str, fallback: str, line: str = "value") -> str | None:
    """A key from the environment if it is usable there, else the first usable value of `fallback` in the lines of settings files."""
    given = environment.get(name, "")
    if given and "${" not in given and not given.startswith("$"):
        return given
    if lines is None:
        return None
    found = lines.select(settings_lines(F.col(line)).alias("s")).filter((F.col("s.name") == fallback) & usable_key(F.col("s.value"))).first()
    return found["s"]["value"] if found else None


def accepted(before: Column, after: Column, score_after: Column, pass_score: int = SETTINGS["pass_score"], min_keep: int = SETTINGS["min_keep_chars"], source: Column | None = None) -> Column:
    """Is a model's rewrite to be used? Its tokens are whole, and it scores well or is not suspiciously short (beside the source)."""
    whole = punctuation.tokens_preserved(before, after) & (after != "")
    kept = (F.length(after) >= min_keep) & (F.length(after) >= F.length(before if source is None else source) * F.lit(0.3))
    return F.coalesce(whole & ((score_after >= pass_score) | kept), F.lit(False))
