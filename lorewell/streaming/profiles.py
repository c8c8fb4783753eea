"""Profiles and transitions that follow a stream of interactions, with state for each user."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from math import log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from lorewell.functions.scalar import DAY
from lorewell.sources.scratch import shared_folder

#: What a batch tells of a user: the logarithm of what it adds to an item's weight, its last interaction, and changes of transition counts; `seq` numbers a user's batches.
CHANGES = "u long, seq long, kind string, i long, next_i long, value double"
#: An interaction as the state holds it.
SPOT = np.dtype([("t", "f8"), ("i", "i8")])
#: Shares of the users that are handed to Python together; a checkpoint holds for this number.
SHARES = 1024
_ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def sums_by(at: np.ndarray, n: int, logs: np.ndarray) -> np.ndarray:
    """log(sum of exp(logs)) of n groups, by the group of each."""
    most = np.full(n, -np.inf)
    np.maximum.at(most, at, logs)
    return most + np.log(np.bincount(at, np.exp(logs - most[at]), n))


def steps(rows: np.ndarray) -> Counter:
    """How often an item follows another in rows (t, i) in order."""
    items = rows["i"].tolist()
    return Counter(zip(items[:-1], items[1:], strict=True))


class ProfileProcessor(StatefulProcessor):
    """Keeps each user's last interaction and ordered history, for a share of the users at a time.

    A weight at time T is exp(kept - T ln 2 / half-life), where kept is log(sum of
    2^(t / half-life)) of all rows: a batch tells its own part of that sum, whose readers add the parts up,
    so a weight needs no state, and no order of arrival.  A row that is not older than the last one extends
    the transitions from there; an older one is put in its place, and the pairs
    that this breaks are taken back.  The state is read once and written twice for a user and batch, whatever
    the number of rows; the history is one piece of bytes for each user and batch and is read only where a row is late."""

    def __init__(self, half_life: float):
        self.rate = log(2.0) / half_life / DAY

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getMapState("last", "u long", "t double, i long, seq long")
        self.history = handle.getMapState("history", "u long, seq long", "rows binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames = list(rows)
        u, i, t = (np.concatenate([f[c].to_numpy() for f in frames]) for c in "uit")
        order = np.lexsort((i, t, u))
        u, i, t = u[order], i[order], t[order]
        spots = np.empty(len(u), SPOT)
        spots["t"], spots["i"] = t, i
        first = np.flatnonzero(np.diff(u, prepend=u[0] - 1))
        seqs, told, taken = [], {name: [] for name in ("u", "seq", "kind", "i", "next_i", "value")}, np.diff(u, prepend=u[0] - 1) == 0
        before_i = np.roll(i, 1)  # `taken`: rows whose step from the item before is new

        def tell(users, seq, kind, items, nexts, values):
            for name, column in zip(told, (users, seq, [kind] * len(users), items, nexts, values), strict=True):
                told[name].extend(column)

        for a, b, user in zip(first.tolist(), [*first[1:].tolist(), len(u)], u[first].tolist(), strict=True):
            new, before = spots[a:b], self.last.getValue((user,))
            seq = (before[2] if before else 0) + 1
            last = (float(t[b - 1]), int(i[b - 1]))
            if before is not None and (t[a], i[a]) < (before[0], before[1]):
                old = np.sort(np.concatenate([np.frombuffer(self.history.getValue((user, k))[0], SPOT) for k in range(1, seq)]), order=("t", "i"))
                changed = steps(np.sort(np.concatenate([old, new]), order=("t", "i")))
                changed.subtract(steps(old))
                pairs = [(x, y, float(n)) for (x, y), n in changed.items() if n]
                tell([user] * len(pairs), [seq] * len(pairs), "step", *zip(*pairs, strict=True)) if pairs else None
                taken[a:b] = False
                last = max(last, (before[0], before[1]))
            elif before is not None:
                taken[a], before_i[a] = True, before[1]
            self.history.updateValue((user, seq), (new.tobytes(),))
            self.last.updateValue((user,), (*last, seq))
            seqs.append(seq)
            tell([user], [seq], "last", [last[1]], [None], [last[0]])
        seq = np.repeat(seqs, np.diff(first, append=len(u)))
        parts = pd.DataFrame({"u": u, "i": i}).groupby(["u", "i"], sort=False).ngroup().to_numpy()
        _, one = np.unique(parts, return_index=True)
        tell(u[one].tolist(), seq[one].tolist(), "weight", i[one].tolist(), [None] * len(one), sums_by(parts, len(one), t * self.rate).tolist())
        if taken.any():
            some = pd.DataFrame({"u": u, "seq": seq, "i": before_i, "next_i": i})[taken].value_counts().reset_index()
            tell(*(some[c].tolist() for c in ("u", "seq")), "step", *(some[c].tolist() for c in ("i", "next_i")), some["count"].astype(float).tolist())
        yield pd.DataFrame(told | {"next_i": pd.array(told["next_i"], "Int64")})

    def close(self) -> None:
        pass


def profile_changes(stream: DataFrame, half_life: float) -> DataFrame:
    """CHANGES of a stream of interactions (u, i, t)."""
    rows = stream.where("u IS NOT NULL AND i IS NOT NULL AND t IS NOT NULL").select(F.col("u").cast("long"), F.col("i").cast("long"), F.col("t").cast("double"))
    return rows.withColumn("share", F.pmod(F.xxhash64("u"), F.lit(SHARES))).groupBy("share").transformWithStateInPandas(ProfileProcessor(half_life), CHANGES, "append", "none")


def start(stream: DataFrame, path: str, checkpoint: str, half_life: float = 30) -> StreamingQuery:
    """Appends the changes to a Parquet folder; started again with its checkpoint, it goes on where it was."""
    conf = stream.sparkSession.conf
    before = conf.get(_ROCKS[0], None)
    conf.set(*_ROCKS)  # the store that such state needs; the query keeps it
    try:
        return profile_changes(stream, half_life).writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.unset(_ROCKS[0]) if before is None else conf.set(_ROCKS[0], before)


def current_profiles(changes: DataFrame, half_life: float) -> DataFrame:
    """(u, i, w): the decayed weights at each user's last interaction, as `profiles.decayed` has them of all rows."""
    own, last = changes.where("kind = 'weight'"), changes.where("kind = 'last'").groupBy("u").agg(F.max("value").alias("t"))
    at = F.exp(F.col("value") - F.col("t") * (log(2.0) / half_life / DAY))  # at the last interaction no part is large
    return own.join(last, "u").groupBy("u", "i").agg(F.sum(at).alias("w"))


def current_transitions(changes: DataFrame) -> DataFrame:
    """(i, next_i, n, score), as `profiles.transitions` has them of all rows."""
    n = F.sum("value").cast("long").alias("n")
    return changes.where("kind = 'step'").groupBy("i", "next_i").agg(n).where("n > 0").withColumn("score", F.log1p("n"))


def replayed(interactions: DataFrame, half_life: float, batches: int = 4) -> DataFrame:
    """The changes of a table of interactions that is streamed in micro-batches by ranges of time."""
    spark = interactions.sparkSession
    at = f"{shared_folder(spark)}/lorewell/replay-{uuid.uuid4().hex}"
    interactions.repartitionByRange(batches, "t").write.parquet(f"{at}/in")
    stream = spark.readStream.schema(interactions.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    query = start(stream, f"{at}/out", f"{at}/checkpoint", half_life)
    query.awaitTermination()
    return spark.read.schema(CHANGES).parquet(f"{at}/out")
