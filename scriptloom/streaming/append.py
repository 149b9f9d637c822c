"""Growing lists as a stream: what a list gained since it was last seen is translated, and nothing before that again."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.store import ProgressStore

GAINED = "name string, pos long, text string"


def gained(snapshots: DataFrame) -> DataFrame:
    """(name, pos, text) of members that a list (name, items: all of it so far) has beyond its length at the last snapshot.

    State is one length a list. Where a micro-batch holds several snapshots of a list, the
    longest one counts; one that is shorter than what was seen adds nothing; null lists are empty.
    """

    def grow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = state.get[0] if state.exists else 0
        longest: list = []
        for frame in frames:
            for items in frame["items"]:
                if items is not None and len(items) > len(longest):
                    longest = list(items)
        state.update((max(seen, len(longest)),))
        if len(longest) > seen:
            yield pd.DataFrame({"name": key[0], "pos": range(seen, len(longest)), "text": longest[seen:]})

    return snapshots.select("name", "items").groupBy("name").applyInPandasWithState(grow, GAINED, "length long", "append", GroupStateTimeout.NoTimeout)


def append_stream(snapshots: DataFrame, store: str, out: str, checkpoint: str) -> StreamingQuery:
    """Write (name, pos, shown) of new members to a folder for each micro-batch of ``out``.

    They are looked up in the translations of ``store`` as these are when the micro-batch runs;
    later ones refresh nothing. A micro-batch that is run again replaces its folder.
    """

    def one(batch: DataFrame, number: int) -> None:
        table = ProgressStore(batch.sparkSession, store).read().select("text", "tr")
        shown = batch.join(table, "text", "left").select("name", "pos", F.coalesce("tr", "text").alias("shown"))
        shown.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return gained(snapshots).writeStream.foreachBatch(one).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
