"""Keyed state of streams, in Spark's own state store.

A trigger reads and writes the entries of its own keys only, so its cost follows its rows and not
the history. State is part of the checkpoint: a trigger that runs again starts from the state before it.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import LongType, StringType, StructField, StructType

STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # Only the changes of a trigger go to the checkpoint, not all state.
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def on_disk_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state on the executors' disks, with changes in the checkpoint."""
    before = {name: spark.conf.get(name, None) for name in STORE}
    for name, value in STORE.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def token_of(column: str):
    """A key for any id: null ids are one id, apart from the empty one."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


# --- ids that are given out until they succeed --------------------------------


class GiveOut(StatefulProcessor):
    """Gives an id out once, and again when a failure of the last try is reported and the id has come again.

    State per id: number of tries, whether the last one counts as open or done, and the last row that
    came meanwhile.
    """

    def __init__(self, columns: list[str]):
        self.columns = columns

    def init(self, handle):
        self.seen = handle.getValueState("seen", "tries bigint, taken boolean, again binary")

    def handleInputRows(self, key, rows, timerValues):
        tries, taken, again = self.seen.get() if self.seen.exists() else (0, False, None)
        before = (tries, taken, again is not None)
        came, failed = None, []
        for pdf in rows:
            pdf.columns = [*self.columns, "_token", "_failed"]  # Spark renames those that are no Python names
            failed += pdf["_failed"].dropna().astype("int64").tolist()
            arrived = pdf[pdf["_failed"].isna()]
            if came is None and len(arrived):
                came = arrived.iloc[:1][self.columns]
        if taken and tries in failed:
            taken = False
        if came is None and not taken and again is not None:
            came = pickle.loads(again)
        if came is not None and not taken:
            tries, taken, again = tries + 1, True, None
            yield came.assign(_token=key[0], _try=tries)
        elif came is not None and again is None:
            again = pickle.dumps(came)
        if before != (tries, taken, again is not None):
            self.seen.update((tries, taken, again))

    def close(self):
        pass


def one_per_token(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One arrival per id and Arrow batch, so that a hot id sends few rows; reports stay."""
    for pdf in batches:
        yield pdf[pdf["_failed"].notna() | ~pdf.duplicated(["_token", "_failed"])]


def give_out(arrivals: DataFrame, reports: DataFrame, key: str) -> DataFrame:
    """Rows of ``arrivals`` to process now, with ``_token`` and ``_try``; ``reports`` are failed tries of tokens."""
    fields = arrivals.schema.fields
    rows = arrivals.select("*", token_of(key).alias("_token"), F.lit(None).cast("bigint").alias("_failed"))
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in fields]
    events = rows.unionByName(reports.select(*nothing, "_token", F.col("_try").alias("_failed")))
    shape = StructType([StructField(f.name, f.dataType) for f in events.schema.fields])
    given = StructType([*shape.fields[: len(fields)], StructField("_token", StringType()), StructField("_try", LongType())])
    slim = events.mapInPandas(one_per_token, shape)
    return slim.groupBy("_token").transformWithStateInPandas(GiveOut([f.name for f in fields]), given, "append", "none")


# --- the frame before each frame ----------------------------------------------

#: A group holds up to 2**BITS places; the places of a level are the groups of the level below.
BITS = 10
LEVELS = 4  # enough for 32-bit indexes: the groups of the top level span 2**40
ROUTED = "token string, level int, grp bigint, place bigint, video_id string, at bigint, vec array<double>"
ANSWER = "token string, level int, place bigint, video_id string, at bigint, vec array<double>, before bigint, prev array<double>"


def to_levels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Every frame at level 0, and at each level above only the last frame per place and Arrow batch."""
    for pdf in batches:
        for level in range(LEVELS):
            rows = pdf.assign(level=level, place=pdf["at"].to_numpy() >> (BITS * level))
            if level:
                rows = rows[rows["at"] == rows.groupby(["token", "place"])["at"].transform("max")]
            group = 0 if level == LEVELS - 1 else rows["place"].to_numpy() >> BITS
            yield rows.assign(grp=group)[["token", "level", "grp", "place", "video_id", "at", "vec"]]


def _ordered(vec) -> list:
    """A sort key that takes NaN as the largest number, as Spark does."""
    return [(1, 0.0) if x != x else (0, x) for x in vec]


class FrameBefore(StatefulProcessor):
    """Last frame of the nearest earlier place in the same group, after the rows of this trigger are in.

    State per (video, level, group): its places in order, and the last frame of each place.
    """

    def init(self, handle):
        self.order = handle.getValueState("order", "places binary")
        self.last = handle.getMapState("last", "place bigint", "at bigint, vec array<double>")

    def _put(self, place: int, new: list[tuple], known: bool) -> tuple[int, list]:
        at = max(row[1] for row in new)
        most = [row[2] for row in new if row[1] == at]
        vec = most[0] if len(most) == 1 else max(most, key=_ordered)
        if known:
            held = self.last.getValue((place,))
            if held[0] > at:
                return int(held[0]), held[1]
        self.last.updateValue((place,), (at, vec.tolist()))
        return at, vec

    def handleInputRows(self, key, rows, timerValues):
        token, level, _ = key
        new: dict[int, list[tuple]] = {}
        for pdf in rows:
            for place, video, at, vec in zip(*(pdf[c] for c in ("place", "video_id", "at", "vec"))):
                new.setdefault(int(place), []).append((video, int(at), np.asarray(vec, np.float64)))
        known = np.frombuffer(self.order.get()[0], np.int64) if self.order.exists() else np.empty(0, np.int64)
        held = set(known.tolist())
        current = {place: self._put(place, group, place in held) for place, group in new.items()}
        order = np.union1d(known, np.fromiter(new, np.int64, len(new)))
        if len(order) > len(known):
            self.order.update((order.tobytes(),))
        out = []
        for place, group in new.items():
            rank = int(np.searchsorted(order, place)) - 1
            before, prev = None, None
            if rank >= 0:
                earlier = int(order[rank])
                before, prev = current[earlier] if earlier in current else self.last.getValue((earlier,))
            for video, at, vec in group if level == 0 else group[:1]:
                out.append((token, level, place, video, at, vec if level == 0 else None, before, prev))
        names = ["token", "level", "place", "video_id", "at", "vec", "before", "prev"]
        yield pd.DataFrame(out, columns=names).astype({"before": "Int64"})

    def close(self):
        pass


def frames_before(frames: DataFrame) -> DataFrame:
    """Answers of all levels for a stream of ``token, video_id, at, vec`` (see :func:`nearest`).

    A level has one group per 1,024 places of the level below, so a hot video is spread over many groups,
    and the levels above get one frame per place. ``at`` is a 32-bit index.
    """
    routed = frames.select("token", "video_id", "at", "vec").mapInPandas(to_levels, ROUTED)
    return routed.groupBy("token", "level", "grp").transformWithStateInPandas(FrameBefore(), ANSWER, "append", "none")


def nearest(answers: DataFrame) -> DataFrame:
    """``video_id, at, vec, before, prev`` per frame: the answer of the lowest level that has one.

    Only frames that are the first of their group look at the levels above, one row per group.
    """
    carry = answers.filter(F.col("level") == LEVELS - 1).select("token", F.col("place").alias("up"), F.col("before").alias("up_before"), F.col("prev").alias("up_prev"))
    for level in range(LEVELS - 2, -1, -1):
        rows = answers.filter(F.col("level") == level)
        found = rows.filter(F.col("before").isNotNull())
        above = rows.filter(F.col("before").isNull()).withColumn("up", F.shiftright("place", BITS)).join(carry, ["token", "up"], "left")
        above = above.select(*rows.drop("before", "prev").columns, F.col("up_before").alias("before"), F.col("up_prev").alias("prev"))
        rows = found.unionByName(above)
        if level:
            carry = rows.select("token", F.col("place").alias("up"), F.col("before").alias("up_before"), F.col("prev").alias("up_prev"))
    return rows.select("video_id", "at", "vec", "before", "prev")
