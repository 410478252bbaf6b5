"""Sessions of votes as keyed state of a stream.

A session's votes are kept by card: the last vote of a card counts, at the card's first
place, as in ``votes.merged``. A session ends when no vote has come for a while of event
time; its votes are then given out and forgotten.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

VOTES = "session string, place long, card string, variant string, clip string, tier string, at timestamp"


class Session(StatefulProcessor):
    """State of a session: its votes by card, how many places are taken, and when it ends."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.votes = handle.getMapState("votes", "card string", "place long, variant string, clip string, tier string, at timestamp, seq long")
        self.clock = handle.getValueState("clock", "places long, ends long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        places, ends = self.clock.get() if self.clock.exists() else (0, 0)
        last = ends - self.idle_ms if ends else 0
        first, newest = {}, {}  # by card: the rows of a micro-batch come in any order
        for batch in rows:
            for row in batch.itertuples(index=False):
                order = row.at, row.seq, row.tier or ""
                first[row.card] = min(first.get(row.card, order), order)
                if row.card not in newest or newest[row.card][0] <= order:
                    newest[row.card] = order, row
                last = max(last, int(row.at.timestamp() * 1000))
        for card in sorted(newest, key=lambda c: (first[c], c)):
            _, row = newest[card]
            held = self.votes.getValue((card,)) if self.votes.containsKey((card,)) else None
            place = places if held is None else held[0]
            places += held is None
            if held is None or (row.at, row.seq) >= (pd.Timestamp(held[4]), held[5]):
                self.votes.updateValue((card,), (place, row.variant, row.clip, row.tier, row.at.to_pydatetime(), int(row.seq)))
        if last + self.idle_ms != ends:
            if ends:
                self.handle.deleteTimer(ends)
            self.handle.registerTimer(last + self.idle_ms)
            self.clock.update((int(places), int(last + self.idle_ms)))
        else:
            self.clock.update((int(places), int(ends)))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        rows = sorted((place, card, variant, clip, tier, at) for (card,), (place, variant, clip, tier, at, _) in self.votes.iterator())
        self.votes.clear()
        self.clock.clear()
        yield pd.DataFrame([(key[0], *r) for r in rows], columns=["session", "place", "card", "variant", "clip", "tier", "at"])

    def close(self) -> None:
        pass


def ended_sessions(votes: DataFrame, idle: str, late: str) -> DataFrame:
    """The votes of every session that has ended, as a stream of VOTES rows.

    votes: a stream of ``session``, ``card`` (if null or empty, made of variant and clip),
    ``variant``, ``clip``, ``tier``, ``at`` (a timestamp) and ``seq`` (a long, the order of
    votes at one time). Votes without a session, a time or a card go. A session ends when
    event time, less ``late``, has passed its last vote by ``idle``; a vote behind that
    begins a new session.
    """
    made = F.coalesce(F.nullif("card", F.lit("")), F.when(F.col("variant").isNotNull() & F.col("clip").isNotNull(), F.concat_ws("|", "variant", "clip")))
    named = votes.withColumn("card", made).where("card is not null and session is not null and at is not null")
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    seen = named.select("session", "card", "variant", "clip", "tier", "at", F.coalesce("seq", F.lit(0)).cast("long").alias("seq")).withWatermark("at", late)
    return seen.groupBy("session").transformWithStateInPandas(Session(idle_ms), outputStructType=StructType.fromDDL(VOTES), outputMode="Append", timeMode="EventTime")
