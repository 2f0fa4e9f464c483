"""Rewriting by a language model: chunks, prompts, replies. The call itself is an injected function.

A transport takes a list of messages ({role, content}) and returns the reply's text, or an awaitable of it. Nothing
here opens a connection; whatever a transport raises, and a call that takes too long, leaves the text as it was.

A text's chunks are rows of their own while the model is asked, dealt over all partitions, and are put together in
order afterwards. A partition has a bounded number of calls on their way. Each call's clock runs from the moment it
is sent; one that runs out is left behind in a thread that keeps nothing from ending, and makes room for the next.
"""

from __future__ import annotations

import asyncio
import inspect
import json
import queue
import re
import threading
import time
from collections import deque
from collections.abc import Awaitable, Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from tonewright.functions.text import stripped
from tonewright.operators import paragraphs, rewrite
from tonewright.operators import scene as scenes

Transport = Callable[[list[dict]], str | Awaitable[str]]
MAX_CHARS = 1700
CHUNK_CHARS = 1500  # of a delivery
TIMEOUT = 90.0  # seconds a call
CALLS = 8  # on their way at once from a partition
LEFT_BEHIND = 64  # calls without an answer after which a partition sends no more until one of them ends
INSTRUCTIONS = "Rewrite the text in plain words. Keep facts, numbers, names, code and addresses as they are. Answer with the text alone."
#: Phrases that a rewritten text must not hold.
BANNED = [
    "不仅……而且", "更重要的是", "值得注意的是", "综上所述", "总而言之", "全方位", "多维度", "多层次", "高质量发展", "数字化转型", "赋能", "助力", "众所周知", "在当今时代", "不可否认",
]
#: Formulaic sentences and how a person would put them.
EXAMPLES = [
    ("赋能一线，全面提升服务效能", "给客服加了查询订单的入口，平均少等两分钟"),
    ("打造全方位的安全防护体系", "登录要短信验证，三次输错就锁十分钟"),
    ("众所周知，备份的重要性不言而喻", "上个月硬盘坏了一块，靠前一晚的备份恢复"),
    ("It is worth noting that the migration significantly improved performance", "After the migration a page loads in 0.8 s instead of 3 s"),
]
#: Additions to the instructions by scene.
SCENE_NOTES = {
    "social-note": "First person, short spoken sentences; keep every personal detail; no headings, lists or closing remarks; keep the length within a tenth.",
    "health-content": "Describe experience, conclude no diagnosis; claim no effect; keep every advice to see a doctor word by word; keep uncertainty uncertain.",
}
EMPTY_REPLY_TRIES = 3


def pack_greedily(parts: list[str], limit: int, join: str, overhead: int) -> list[str]:
    """Parts joined as long as they stay within the limit; every part costs its overhead too."""
    out: list[list[str]] = []
    size = 0
    for part in parts:
        if out and size + len(part) + overhead <= limit:
            out[-1].append(part)
            size += len(part) + overhead
        else:
            out.append([part])
            size = len(part) if len(out) > 1 else len(part) + overhead
    return [join.join(x) for x in out]


def chunks(text: str, limit: int = MAX_CHARS) -> list[str]:
    """Paragraphs packed up to the limit; longer paragraphs by sentences of their own."""
    out: list[str] = []
    run: list[str] = []
    for paragraph in re.split(r"\n\s*\n", text):
        if len(paragraph) <= limit:
            run.append(paragraph)
            continue
        out += pack_greedily(run, limit, "\n\n", 2)
        out += pack_greedily(re.split(r"(?<=[。！？!?])\s*", paragraph), limit, "", 0)
        run = []
    return out + pack_greedily(run, limit, "\n\n", 2)


def without_thinking(reply: Column) -> Column:
    return F.trim(F.regexp_replace(reply, F.lit(r"(?s)<think>.*?</think>\s*"), F.lit("")))


def system_prompt(scene: str = "base") -> str:
    """Instructions, what must not be written, examples, and what the scene adds."""
    banned = "Never write: " + " / ".join(BANNED)
    shown = "Examples:\n" + "\n".join(f"- {formulaic}\n  -> {plain}" for formulaic, plain in EXAMPLES)
    return "\n\n".join(filter(None, (INSTRUCTIONS, banned, shown, SCENE_NOTES.get(scene))))


def user_prompt(text: str, context: str | None = None, sections: dict[str, str] | None = None) -> str:
    """The text, and what is known of its background, in all and by section."""
    parts = [f"---\n{text}\n---"]
    if context or sections:
        parts.append("Background, for where the text speaks of it; the text is right where they differ:")
    if context:
        parts.append(context)
    parts += [f"- {title}: {detail}" for title, detail in (sections or {}).items()]
    return "\n".join(parts)


def system_of(scene: Column) -> Column:
    """The system prompt of a scene in a column."""
    prompts = F.lit(system_prompt())
    for name in SCENE_NOTES:
        prompts = F.when(scene == name, F.lit(system_prompt(name))).otherwise(prompts)
    return prompts


def messages(text: str, scene: str = "base", context: str | None = None, sections: dict[str, str] | None = None) -> list[dict]:
    """System and user message of one chunk."""
    return [{"role": "system", "content": system_prompt(scene)}, {"role": "user", "content": user_prompt(text, context, sections)}]


def reply_of(transport: Transport, request: list[dict]) -> str:
    """The transport's answer, awaited if it has to be."""
    answer = transport(request)
    return (asyncio.run(awaited(answer)) if inspect.isawaitable(answer) else answer) or ""


async def awaited(answer: Awaitable[str]) -> str:
    return await answer


def ask(transport: Transport, request: list[dict], tries: int = EMPTY_REPLY_TRIES) -> str:
    """The reply without its thinking; a reply of nothing else is asked for again."""
    for _ in range(tries):
        reply = re.sub(r"<think>.*?</think>\s*", "", reply_of(transport, request), flags=re.S).strip()
        if reply:
            return reply
    raise RuntimeError("the model answered with nothing but thinking")


def call_all(requests: list, call: Callable, timeout: float, at_once: int = CALLS, left_behind: int = LEFT_BEHIND) -> list[tuple[str | None, str | None]]:
    """Reply and error of each request. At most `at_once` calls are on their way; each has `timeout` seconds from when it is sent.

    Calls out of time no longer count, though their threads may go on. With `left_behind` of those, the next request
    waits for one of them to end, as long as a call may take; if none does, what is left fails without being sent.
    """
    found: list[tuple[str | None, str | None]] = [(None, None)] * len(requests)
    done: queue.SimpleQueue = queue.SimpleQueue()
    waiting, deadlines, late = deque(range(len(requests))), {}, set()
    held_since: float | None = None

    def run(i: int) -> None:
        try:
            done.put((i, call(requests[i]), None))
        except Exception as error:  # the contract of the gate: any failure keeps the text
            done.put((i, None, str(error) or type(error).__name__))

    while waiting or deadlines:
        while waiting and len(deadlines) < at_once and len(late) < left_behind:
            i = waiting.popleft()
            deadlines[i], held_since = time.monotonic() + timeout, None
            threading.Thread(target=run, args=(i,), daemon=True).start()
        if waiting and not deadlines:
            held_since = held_since or time.monotonic()
            if time.monotonic() >= held_since + timeout:
                return [r if n not in waiting else (None, "the model answers no calls") for n, r in enumerate(found)]
        try:
            i, reply, error = done.get(timeout=max(0.0, min(deadlines.values(), default=(held_since or 0.0) + timeout) - time.monotonic()))
            if deadlines.pop(i, None) is not None:
                found[i] = (reply, error)
            late.discard(i)
        except queue.Empty:
            pass
        for i in [i for i, end in deadlines.items() if end <= time.monotonic()]:
            del deadlines[i]
            late.add(i)
            found[i] = (None, TimeoutError.__name__)
    return found


@F.pandas_udf(ArrayType(StringType()))
def in_chunks(texts: pd.Series, limits: pd.Series) -> pd.Series:
    return pd.Series([chunks(t or "", n) for t, n in zip(texts, limits, strict=True)])


def prepared(df: DataFrame, into: str, text: str = "text", dedup: bool = True) -> DataFrame:
    """Adds what a model is given of a text: without repeated paragraphs, and rewritten by the rules."""
    keep = df.columns
    df = df.withColumn("__source", F.coalesce(F.col(text), F.lit("")))
    if dedup:
        df = paragraphs.with_dedup(df.select(*keep, "__source"), "__source").withColumn("__source", F.col("deduped"))
    return df.select(*keep, rewrite.rewritten(F.col("__source")).alias(into))


def with_replies(rows: DataFrame, chunk: str, scene: str, transport: Transport, timeout: float, **about) -> DataFrame:
    """Adds reply and error to rows of one chunk each; rows whose chunk is null are not sent."""
    names = rows.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, scenes_ = (batch.column(names.index(c)).to_pylist() for c in (chunk, scene))
            sent = [i for i, t in enumerate(texts) if t is not None]
            answers = dict(zip(sent, call_all([messages(texts[i], scenes_[i], **about) for i in sent], lambda m: ask(transport, m), timeout), strict=True))
            made = [[answers[i][k] if i in answers else None for i in range(len(texts))] for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(m, pa.string()) for m in made)], names=[*names, "reply", "error"])

    return rows.mapInArrow(run, f"{fields}, reply string, error string")


def rewrite_with_model(
    df: DataFrame, transport: Transport, text: str = "text", scene: str | Column = "base", limit: int = CHUNK_CHARS,
    *, only: Column | None = None, timeout: float = TIMEOUT, dedup: bool = True, context: str | None = None, sections: dict[str, str] | None = None, spread: int | None = None,
) -> DataFrame:
    """Adds model_text and model_error. Of the rows that `only` picks (all, if it is not given) each text is prepared, cut into

    chunks and sent, a chunk a row over `spread` partitions (as many as a shuffle has, if it is not given); a call may take
    `timeout` seconds. A text of which a chunk fails stays as it was, with the first chunk's error. Other rows get null in
    both. Rows that are alike in all columns are asked for once.
    """
    keep = df.columns
    df = scenes.with_chosen(df.withColumn("__asked", F.lit(True) if only is None else F.coalesce(only, F.lit(False))), scene, "__scene", text)
    # Rows that are not asked for carry no text to prepare.
    df = prepared(df.withColumn("__sent", F.when(F.col("__asked"), F.col(text))), "__clean", "__sent", dedup)
    whole = F.struct(*[df[c] for c in keep])
    parts = F.when(F.col("__asked"), in_chunks(F.col("__clean"), F.lit(limit))).otherwise(F.array(F.lit(None).cast("string")))
    content = F.to_json(F.struct(whole.alias("row"), F.col("__asked"), F.col("__scene")))
    rows = df.select(whole.alias("__row"), "__scene", F.sha2(content, 256).alias("__key"), F.posexplode(parts).alias("__no", "__chunk"))
    # The first chunk carries the row.
    rows = rows.withColumn("__row", F.when(F.col("__no") == 0, F.col("__row")))
    parallel = spread or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parallel, "__key", "__no").groupBy("__key", "__no").agg(*[F.first(c).alias(c) for c in ("__chunk", "__scene", "__row")], F.count("*").alias("__times"))
    rows = with_replies(rows, "__chunk", "__scene", transport, timeout, context=context, sections=sections)
    answers = F.array_sort(F.collect_list(F.struct("__no", "reply", "error", F.col("__chunk").isNotNull().alias("sent"))))
    texts = rows.groupBy("__key").agg(F.first("__row", ignorenulls=True).alias("__row"), F.max("__times").alias("__times"), answers.alias("a"))
    failed = F.get(F.filter("a", lambda x: x["error"].isNotNull()), 0)["error"]
    joined = F.when(failed.isNull(), F.array_join(F.transform("a", lambda x: x["reply"]), "\n\n")).otherwise(F.col("__row")[text])
    texts = texts.select("__row", F.when(F.col("a")[0]["sent"], joined).alias("model_text"), failed.alias("model_error"), F.explode(F.expr("array_repeat(0, int(__times))")))
    return texts.select(*[F.col("__row")[c].alias(c) for c in keep], "model_text", "model_error")


def mock_transport(request: list[dict]) -> str:
    """Answers with the text it was given, its exclamation marks made full stops."""
    text = request[-1]["content"].rpartition("\n---")[0].removeprefix("---\n")
    return "<think>too loud</think>\n" + text.translate(str.maketrans("!！", ".。"))


def parse_detections(reply: Column) -> Column:
    """Detections of a model's reply: a JSON list, or an object with detections, results or items; fences are dropped."""
    item = "array<struct<pattern_id:string,pattern_name:string,confidence:double,matched_text:string,suggestion:string>>"
    bare = stripped(F.regexp_replace(reply, F.lit(r"(?m)^```\w*\s*$"), F.lit("")))
    nested = F.from_json(bare, f"struct<detections:{item},results:{item},items:{item}>")
    # An object read as a list would be one item without fields.
    listed = F.when(F.startswith(bare, F.lit("[")), F.from_json(bare, item))
    return F.coalesce(listed, nested["detections"], nested["results"], nested["items"], F.expr(f"cast(array() as {item})"))


MOCK_WORD = "值得注意的是"


def mock_detections(text: Column) -> Column:
    return F.when(F.contains(text, F.lit(MOCK_WORD)), F.array(F.lit(MOCK_WORD))).otherwise(F.expr("cast(array() as array<string>)"))


def mock_detector_transport(request: list[dict]) -> str:
    """Answers like a service: a fenced list of one detection for a text with the mock's word, else an empty one."""
    found = [{"pattern_id": "p08", "pattern_name": "meta", "confidence": 0.9, "matched_text": MOCK_WORD, "suggestion": ""}] if MOCK_WORD in request[-1]["content"] else []
    return f"```json\n{json.dumps(found, ensure_ascii=False)}\n```"


DETECT = (
    "Check the text for formulaic writing; change nothing. Answer with a JSON list of objects with pattern_id, pattern_name, confidence (0 to 1), "
    "matched_text (word by word from the text) and suggestion, or with [] if there is none."
)


def with_detections(df: DataFrame, transport: Transport, text: str = "text", timeout: float = 30.0) -> DataFrame:
    """Adds detections, what a model's reply lists; none where the call fails or the reply can't be read."""
    keep = df.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            requests = [[{"role": "system", "content": DETECT}, {"role": "user", "content": t or ""}] for t in rows[text]]
            # A detector that can't be reached finds nothing.
            yield rows.assign(__reply=[reply or "[]" for reply, _ in call_all(requests, lambda m: reply_of(transport, m), timeout)])

    asked = df.mapInPandas(run, f"{fields}, __reply string")
    return asked.select(*keep, parse_detections(F.col("__reply")).alias("detections"))


PROVIDERS = ("mock", "openai", "anthropic")


def create_detector(enabled: bool, provider: str = "mock", transport: Transport | None = None):
    """A function that adds detections to a frame, or None if it is not enabled; only the mock needs no transport."""
    provider = provider.lower().strip()
    if provider not in PROVIDERS:
        raise ValueError(f"unknown provider {provider}, not one of {', '.join(PROVIDERS)}")
    if not enabled:
        return None
    if provider == "mock":
        return lambda df, text="text": df.withColumn("detections", mock_detections(F.col(text)))
    if transport is None:
        raise ValueError(f"provider {provider} needs a transport")
    return lambda df, text="text": with_detections(df, transport, text)
