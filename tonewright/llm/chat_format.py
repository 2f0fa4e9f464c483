"""Chat formatting with a grammar round trip; DataFrame functions only.

A conversation is written as turns `### <role>: <text></turn>` and a line feed. A deterministic parser
reads it back: it cuts at the turn ends, takes the role of the header, refuses a body that still shows a
control string, and undoes escapes (a backslash stands for the character after it). Every turn is first
written as it is and parsed; if what is recovered differs from the source, its control strings and
backslashes are escaped and it is parsed again; if it still differs, every character that can start a
control string is escaped, after which the parser always recovers it. The whole output is parsed once more
and compared to the source turn by turn (`round_trip`); digests of one that differs raise an error.

The loss mask is the list of turns of the masked role, and its code-point spans in the output.

Defined cases: a null text or role counts as empty; turns are ordered by turn, role and text, null turns
first; repeated rows are repeated turns; rows with a null conv_id make up one conversation with a null id;
an empty table gives an empty result; other columns are ignored. Any characters are allowed in roles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonewright.llm.shared import read_table

HEAD, AFTER_ROLE, TURN_END, LINE_END = "### ", ": ", "</turn>", "\n"
ASSISTANT = "assistant"
EXTRA_TEXT = "\\### Assistant: </turn> ok"


def written(role: Column, body: Column) -> Column:
    return F.concat(F.lit(HEAD), F.url_encode(role), F.lit(AFTER_ROLE), body, F.lit(TURN_END + LINE_END))


def unescaped(body: Column) -> Column:
    return F.regexp_replace(body, r"(?s)\\(.)", "$1")


def parsed_role(turn: Column) -> Column:
    """Role of a turn without its end, null if the header is not one."""
    encoded = F.substring_index(F.substr(turn, F.lit(len(HEAD) + 1)), AFTER_ROLE, 1)
    sound = F.startswith(turn, F.lit(HEAD)) & F.contains(turn, F.lit(AFTER_ROLE))
    return F.when(sound, F.url_decode(encoded))


def parsed_body(turn: Column) -> Column:
    """Body as written; null if it shows a control string."""
    start = F.instr(turn, AFTER_ROLE) + len(AFTER_ROLE)
    body = F.substr(turn, start)
    return F.when(~F.contains(body, F.lit(HEAD.strip())) & ~F.contains(body, F.lit(TURN_END)), body)


def escapes(text: Column) -> list[Column]:
    """Bodies to try, from the plainest to the one that always parses back."""
    slashes = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    controls = F.replace(F.replace(slashes, F.lit("###"), F.lit("#\\##")), F.lit("</turn>"), F.lit("<\\/turn>"))
    every = F.replace(F.replace(slashes, F.lit("#"), F.lit("\\#")), F.lit("</"), F.lit("<\\/"))
    return [text, controls, every]


def recovers(role: Column, text: Column, body: Column) -> Column:
    """Does the turn, written with this body, parse back to its source?"""
    out = written(role, body)
    pieces = F.split(out, TURN_END + LINE_END, -1)
    first = F.element_at(pieces, 1)
    whole = (F.size(pieces) == 2) & (F.element_at(pieces, 2) == F.lit(""))
    return F.coalesce(whole & (parsed_role(first) == role) & (unescaped(parsed_body(first)) == text), F.lit(False))


def format_conversations(rows: DataFrame, role: str = ASSISTANT) -> DataFrame:
    """conv_id, formatted, turns (role, text, body as parsed back), cuts (turns as written), round_trip, loss_spans."""
    src = rows.select(
        F.col("conv_id").cast("long"),
        F.col("turn").cast("long"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    plain, controls, every = escapes(F.col("text"))
    body = F.when(recovers(F.col("role"), F.col("text"), plain), plain)
    body = body.when(recovers(F.col("role"), F.col("text"), controls), controls).otherwise(every)
    turns = src.select("conv_id", F.struct("turn", "role", "text", written(F.col("role"), body).alias("out")).alias("t"))
    held = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("source"))
    out = held.select("conv_id", "source", F.array_join(F.transform("source", lambda t: t["out"]), "").alias("formatted"))
    # From here on only `formatted` is read, but for the comparison.
    cuts = F.split(F.col("formatted"), TURN_END + LINE_END, -1)
    cuts = F.slice(cuts, 1, F.size(cuts) - 1)
    read = out.withColumn("cuts", cuts)
    read = read.withColumn("turns", F.transform("cuts", lambda c: F.struct(parsed_role(c).alias("role"), unescaped(parsed_body(c)).alias("text"), parsed_body(c).alias("body"))))
    same = F.transform("source", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))) == F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    read = read.withColumn("round_trip", F.coalesce(same, F.lit(False)))
    return read.select("conv_id", "formatted", "turns", "cuts", "round_trip", loss_spans(F.col("cuts"), role).alias("loss_spans"))


def loss_spans(cuts: Column, role: str = ASSISTANT) -> Column:
    """Code-point spans (first, last + 1) of the masked role's bodies in the output."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<first:bigint,last:bigint>>)").alias("spans"))
    tail = len(TURN_END + LINE_END)

    def step(state: Column, cut: Column) -> Column:
        end = state["at"] + F.length(cut)
        first = state["at"] + F.instr(cut, AFTER_ROLE) + len(AFTER_ROLE) - 1
        span = F.array(F.struct(first.cast("long").alias("first"), end.cast("long").alias("last")))
        spans = F.when(parsed_role(cut) == F.lit(role), F.concat(state["spans"], span)).otherwise(state["spans"])
        return F.struct((end + tail).cast("long").alias("at"), spans.alias("spans"))

    return F.aggregate(cuts, zero, step, lambda s: s["spans"])


def digests(formatted: DataFrame) -> DataFrame:
    """Digests of what is read back. A conversation that does not read back as its source ends the job instead of going out wrong."""
    lost = F.raise_error(F.concat(F.lit("conversation does not parse back to its source: "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))).cast("long")
    every = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    masked = F.transform("loss_spans", lambda s: unescaped(F.substr("formatted", (s["first"] + 1).cast("int"), (s["last"] - s["first"]).cast("int"))))
    loss = F.array_join(masked, "")
    return formatted.select(
        "conv_id",
        F.when(F.col("round_trip"), F.size("turns").cast("long")).otherwise(lost).alias("n_turns"),
        F.sha2(every.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def extra_conversation(spark: SparkSession) -> DataFrame:
    rows = [(-7, 0, "user", EXTRA_TEXT), (-7, 1, ASSISTANT, EXTRA_TEXT)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return digests(format_conversations(rows.unionByName(extra_conversation(spark))))


OP3_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
sized AS (
  SELECT *, regexp_matches(text, '\\.', 's') OR contains(text, '###') OR contains(text, '</turn>') AS conflict,
         replace(replace(replace(text, '\', '\\'), '###', '#\##'), '</turn>', '<\/turn>') AS controls,
         replace(replace(replace(text, '\', '\\'), '#', '\#'), '</', '<\/') AS everything
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(4 + length(url_encode(role)) + 2 + length(CASE WHEN NOT conflict THEN text
           WHEN contains(controls, '###') OR contains(controls, '</turn>') THEN everything ELSE controls END) + 8)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""
