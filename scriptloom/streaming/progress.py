"""Resumable translation as a stream: new entries in, accepted translations upserted batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..model import Profile
from ..operators import translate as T
from ..sources.store import ProgressStore


def translate_stream(entries: DataFrame, profile: Profile, store: str, checkpoint: str, pause: float = 0.5, parallel: int | None = None) -> StreamingQuery:
    """Translate a stream of entries; ``store`` is a folder that executors share.

    Each batch is in the journal below the store as soon as it is answered, and a micro-batch that
    is run again finds there, or in the store, what it has paid for.
    """

    def one(batch: DataFrame, number: int) -> None:
        kept = ProgressStore(batch.sparkSession, store)
        journal = T.journal_folder(batch.sparkSession, f"{kept.folder}/journal")
        results = T.translate(batch, kept.read(), profile, pause=pause, journal=journal, parallel=parallel)
        kept.append(T.accepted(results), number)
        T.forget_journal(batch.sparkSession, journal)

    return entries.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored(spark, store: str) -> DataFrame:
    """Translations accepted so far; later micro-batches win."""
    return ProgressStore(spark, store).read()
