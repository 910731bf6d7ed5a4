"""An append-only log of submissions and decisions, and what it means for the live entities.

Events: submission_id, event (PENDING, APPROVED, REJECTED), timestamp, seq, doc_id, files, reviewer, notes, prompt_version, model.
The latest event of a submission is its state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import numbered

EVENT = "submission_id bigint, event string, timestamp string, seq bigint, doc_id string, files array<string>, reviewer string, notes string, prompt_version string, model string"


def submit(entities: DataFrame, first_id: int = 1, timestamp: str = "2024-01-01T00:00:00Z", prompt_version: str = "v1", model: str = "rules") -> DataFrame:
    """A PENDING event per source document, with the files of its entities. Ids follow the documents' order and have no gaps."""
    docs = entities.groupBy(F.col("source_document").alias("doc_id")).agg(F.array_sort(F.collect_set("file")).alias("files"))
    return numbered(docs, "doc_id", "submission_id", first_id).select(
        "submission_id", F.lit("PENDING").alias("event"), F.lit(timestamp).alias("timestamp"), F.lit(0).cast("bigint").alias("seq"), "doc_id", "files",
        F.lit(None).cast("string").alias("reviewer"), F.lit(None).cast("string").alias("notes"), F.lit(prompt_version).alias("prompt_version"), F.lit(model).alias("model"),
    )


def current(events: DataFrame) -> DataFrame:
    """One row per submission: its latest event, with document and files from its submission."""
    latest = events.groupBy("submission_id").agg(F.max_by(F.struct("event", "timestamp", "reviewer", "notes"), "seq").alias("l"), F.min_by(F.struct("doc_id", "files", "prompt_version", "model"), "seq").alias("s"))
    return latest.select("submission_id", F.col("l.event").alias("status"), "s.*", "l.timestamp", "l.reviewer", "l.notes")


def list_pending(events: DataFrame) -> DataFrame:
    return current(events).where("status = 'PENDING'").orderBy("submission_id")


def decide(events: DataFrame, decisions: DataFrame) -> DataFrame:
    """``events`` and the decisions (submission_id, event, reviewer, notes, timestamp, seq) that change a state. Approving what
    is approved, deciding on unknown submissions and other events than APPROVED or REJECTED do nothing."""
    state = current(events).select("submission_id", "status", "doc_id", "files", "prompt_version", "model")
    news = decisions.where("event in ('APPROVED', 'REJECTED')").join(state, "submission_id").where("event <> status")
    return events.unionByName(news.select(*events.columns))


def _rejected_files(events: DataFrame) -> DataFrame:
    return current(events).where("status = 'REJECTED'").select("submission_id", "doc_id", "timestamp", F.explode("files").alias("file"))


def live(entities: DataFrame, events: DataFrame) -> DataFrame:
    """Entities less the files of rejected submissions; files that are gone already don't matter."""
    return entities.join(_rejected_files(events).select("file").distinct(), "file", "left_anti")


def quarantine(entities: DataFrame, events: DataFrame) -> DataFrame:
    """The entities that rejections removed, with the folder they are kept under."""
    out = _rejected_files(events).select("file", F.concat_ws("_", "doc_id", F.regexp_replace("timestamp", r"[^0-9]", "")).alias("quarantine_dir")).dropDuplicates(["file"])
    return entities.join(out, "file")


def hydrate_pending(events: DataFrame, entities: DataFrame) -> DataFrame:
    """(submission_id, doc_id, n_cards, cards): pending submissions with the cards of their files' entities."""
    pending = current(events).where("status = 'PENDING'").select("submission_id", "doc_id", F.explode_outer("files").alias("file"))
    card = F.struct("file", "class", "label", "source_section")
    cards = pending.join(entities.select("file", card.alias("card")), "file", "left")
    return cards.groupBy("submission_id", "doc_id").agg(F.array_sort(F.collect_list("card")).alias("cards")).withColumn("n_cards", F.size("cards").cast("bigint"))
