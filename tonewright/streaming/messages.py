"""Two-phase delivery of a message stream: originals at once, edits as they are ready.

Every micro-batch writes phase 1 (the text as it came) and phase 2 (the edit, where one is due). Both are keyed
by message id and written per batch id, so a batch that runs again after a failure replaces its own output. A message
that comes again in a later batch replaces what was there: readers see its newest text, and an edit only if it is
of that text. `compact` folds the batches so far into one, which then counts as the newest of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonewright.operators import gate

SCHEMA = "message_id string, text string"


def edits(messages: DataFrame, scene: str = gate.SETTINGS["scene"], min_chars: int = gate.SETTINGS["min_chars"]) -> DataFrame:
    """message_id and edited: only for eligible messages that change and need no model."""
    due = gate.with_delivery(messages.filter(gate.eligible(F.col("text"), min_chars)), scene)
    return due.filter((F.col("route") == "rules") & (F.col("delivered") != F.col("text"))).select("message_id", F.col("delivered").alias("edited"))


def write_batch(folder: str, scene: str = gate.SETTINGS["scene"], min_chars: int = gate.SETTINGS["min_chars"]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: phase 1 and phase 2 of a batch, replaced if the batch runs again."""

    def run(batch: DataFrame, batch_id: int) -> None:
        # A batch is read twice, and of texts with one id the same has to be taken both times.
        messages = batch.groupBy("message_id").agg(F.max("text").alias("text"))
        messages.select("message_id", "text").write.mode("overwrite").parquet(f"{folder}/sent/batch={batch_id}")
        edits(messages, scene, min_chars).write.mode("overwrite").parquet(f"{folder}/edited/batch={batch_id}")

    return run


def deliver(stream: DataFrame, folder: str, checkpoint: str, scene: str = gate.SETTINGS["scene"], min_chars: int = gate.SETTINGS["min_chars"]):
    """Starts the query over a stream of SCHEMA; it ends when the input is used up."""
    writer = stream.writeStream.foreachBatch(write_batch(folder, scene, min_chars)).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def newest(rows: DataFrame, value: str) -> DataFrame:
    """Of each message the row of its newest batch; copies meet before they are dealt out."""
    return rows.groupBy("message_id").agg(F.max(F.struct("batch", value)).alias("last")).select("message_id", "last.batch", f"last.{value}")


def latest(sent: DataFrame, edited: DataFrame) -> DataFrame:
    """A row a message: the edit of its newest text where there is one, else that text. Both have the batch they came in."""
    text, edit = newest(sent, "text"), newest(edited, "edited")
    return text.join(edit, ["message_id", "batch"], "left").select("message_id", F.coalesce("edited", "text").alias("text"))


def compact(spark: SparkSession, folder: str, upto: int, into: str) -> None:
    """Batches up to a number as one batch of that number, in another folder; later ones may be read beside it."""
    for kind, value in (("sent", "text"), ("edited", "edited")):
        rows = spark.read.option("basePath", f"{folder}/{kind}").parquet(f"{folder}/{kind}").filter(F.col("batch") <= upto)
        kept = newest(rows, value)
        if kind == "edited":  # an edit of an older text is none
            texts = newest(spark.read.parquet(f"{folder}/sent").filter(F.col("batch") <= upto), "text")
            kept = kept.join(texts, ["message_id", "batch"], "left_semi")
        kept.select("message_id", value).write.mode("overwrite").parquet(f"{into}/{kind}/batch={upto}")
