"""Runs of periodically repeated words, by Karp-Miller-Rosenberg names."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewell.llm._shared import distinct_spans, ragged, small_batches, spans, text_slices

#: A run has at least LEAST words and POWER periods.
LEAST, POWER = 6, 4
#: Candidates extended at a time.
EXTENDED = 1 << 19


def named(words: np.ndarray) -> list[np.ndarray]:
    """Names of all blocks of 1, 2, 4, ... words that occur more than once: equal names, equal blocks.

    A block of 2 n words is named after the pair of its halves' names.  What occurs
    once, or holds a negative word, is -1; each array ends with one -1 more.  The last
    level is the last one that has a repeated block, so no common extension of two
    places is as long as twice its blocks."""
    levels: list[np.ndarray] = []
    at = np.flatnonzero(words >= 0)
    key, width = words[at], 1
    while True:
        _, back, counts = np.unique(key, return_inverse=True, return_counts=True)
        name = np.where(counts > 1, np.cumsum(counts > 1) - 1, -1)[back]
        at = at[name >= 0]
        if not len(at):
            return levels
        level = np.full(len(words) + 1, -1, np.int32)
        level[at] = name[name >= 0]
        levels.append(level)
        at = at[at + width < len(words)]
        at = at[level[at + width] >= 0]  # where both halves of a block of the next level have names
        key = level[at].astype(np.int64) << 32 | level[at + width]
        width *= 2


def extended(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray, back: bool = False) -> np.ndarray:
    """How many words from places a and b on (or, with `back`, before them) are the same, by descending levels."""
    a, b, total = a.copy(), b.copy(), np.zeros(len(a), np.int64)
    end = len(levels[0]) - 1 if levels else 0
    for k in reversed(range(len(levels))):
        width, level = 1 << k, levels[k]
        if back:
            inside = a >= width
            same = level[np.where(inside, a - width, end)]
            same = (same >= 0) & (same == level[np.where(inside, b - width, end)])
            a[same] -= width
            b[same] -= width
        else:
            same = level[a]
            same = (same >= 0) & (same == level[b])
            a[same] += width
            b[same] += width
        total[same] += width
    return total


def runs_of(words: np.ndarray, lengths: np.ndarray, least: int = LEAST, power: int = POWER) -> np.ndarray:
    """(start, end, period) of every run in the flat words of texts, longest text first, each followed by a -1.

    A run of period q and at least 4 q words holds grid points j, j + q and j + 2 q for which
    the q words from j on, from j + q on and from j + 2 q on are the same: two blocks of names, from
    either end, compare q words.  The first such point of a stretch is extended both
    ways.  A stretch that has a smaller period too was found by that one already."""
    levels = named(words)
    ends = np.cumsum(lengths + 1)
    found: list[np.ndarray] = [np.zeros((0, 3), np.int64)]
    held: list[tuple[np.ndarray, int]] = []

    def flush() -> None:
        if not held:
            return
        j, q = np.concatenate([x for x, _ in held]), np.repeat([q for _, q in held], [len(x) for x, _ in held])
        held.clear()
        start = j - extended(levels, j, j + q, back=True)
        end = j + q + extended(levels, j, j + q)
        long = end - start >= np.maximum(least, power * q)
        found.append(np.stack([start, end, q], axis=1)[long])

    waiting = 0
    for q in range(1, int(lengths[0]) // power + 1 if len(lengths) else 0):
        level = q.bit_length() - 1
        if level >= len(levels):
            break
        texts = int(np.searchsorted(-lengths, -power * q, "right"))  # those long enough come first
        if not texts:
            break
        reach = int(ends[texts - 1])
        left = levels[level][:reach:q]
        right = levels[level][q - (1 << level) : reach : q]
        n = min(len(left), len(right)) - 1
        same = (left[:n] >= 0) & (left[:n] == left[1 : n + 1]) & (right[:n] >= 0) & (right[:n] == right[1 : n + 1])
        k = np.flatnonzero(same[:-1] & same[1:])
        if len(k):
            k = k[(k == 0) | ~same[k - 1]]
            held.append((k * q, q))
            waiting += len(k)
            if waiting > EXTENDED:
                flush()
                waiting = 0
    flush()
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    fresh = np.ones(len(runs), bool)
    fresh[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    return runs[fresh]


def _slice(raw: np.ndarray, offsets: np.ndarray, ids: list, places: Callable | None) -> tuple[np.ndarray, list[np.ndarray], list[bytes]]:
    """Words, runs and collapsed text of each row of a slice of bytes."""
    inside = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    starts, ends, first = spans(inside, offsets)
    counts = np.diff(first)
    order = np.argsort(-counts, kind="stable")
    lengths = counts[order]
    at = ragged(first[:-1][order], lengths)  # the texts' words, longest text first
    begin = np.cumsum(lengths) - lengths
    if places is not None:
        for k, row in enumerate(order.tolist()):
            if lengths[k] and (moved := places(ids[row], int(lengths[k]))) is not None:
                at[begin[k] : begin[k] + lengths[k]] = first[row] + moved
    distinct, name = distinct_spans(raw, starts, ends)
    # only repetitions within a text count: a word's name is its text and its bytes, -1 follows each text
    flat = np.full(len(at) + len(lengths), -1, np.int64)
    own = np.repeat(np.arange(len(lengths)), lengths)
    spot = np.arange(len(at)) + own
    flat[spot] = own * max(1, len(distinct)) + name[at] if len(at) else 0
    runs = runs_of(flat, lengths)
    # words after the first period of a run go
    change = np.zeros(len(flat) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 1], -1)
    kept = (np.cumsum(change[:-1]) == 0)[spot]
    at, own = at[kept], own[kept]
    sizes = ends[at] - starts[at] + 1
    data = np.append(raw, np.uint8(32))[ragged(starts[at], sizes)]
    stops = np.cumsum(sizes)
    data[stops - 1] = 32
    bounds = np.concatenate([[0], stops])[np.searchsorted(own, np.arange(len(lengths) + 1))]
    owner = np.searchsorted(begin + np.arange(len(lengths)), runs[:, 0], "right") - 1
    local = np.stack([runs[:, 0] - begin[owner] - owner, runs[:, 1] - runs[:, 0], runs[:, 2]], axis=1)
    local = local[np.lexsort((local[:, 2], local[:, 0], owner))]
    cut = np.searchsorted(np.sort(owner), np.arange(len(lengths) + 1))
    all_runs, collapsed = [local[:0]] * len(lengths), [b""] * len(lengths)
    for k, row in enumerate(order.tolist()):
        all_runs[row] = local[cut[k] : cut[k + 1]]
        collapsed[row] = data[bounds[k] : max(bounds[k], bounds[k + 1] - 1)].tobytes()
    return counts, all_runs, collapsed


def periodic_runs(documents: DataFrame, text: str = "text", places: Callable[[object, int], np.ndarray | None] | None = None) -> DataFrame:
    """Every maximal stretch of a text's words that repeats with a smallest period q, is at least 6 words and 4 q long.

    Words are `[^\\x20\\x09-\\x0D]+`, numbered from 0 and compared byte by byte.
    Blocks of 1, 2, 4, ... words are named by the pairs of their halves' names; for each
    period, grid points whose next words repeat are extended by descending levels.
    `places` may give, for a doc_id and its number of words, which word stands at each
    place.  Returns doc_id, n_words, runs (array of start, length, period, by start,
    then period) and collapsed: the words that no run repeats after its first period,
    joined by one space.  Null and empty texts have no words, no runs and an empty
    collapsed text; repeated rows and ties (two runs over the same words with other
    borders) are all kept; an empty table gives no rows; further columns are ignored.
    A narrow map: no shuffle, no group.  A slice of 2 MB of text is searched at once, a
    longer text alone, with four bytes for each word and level that has repeats.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for i, j, raw, offsets in text_slices(batch.column("text")):
                counts, runs, collapsed = _slice(raw, offsets, ids.slice(i, j - i).to_pylist() if places else [], places)
                flat = np.concatenate(runs) if runs else np.zeros((0, 3), np.int64)
                fields = [pa.array(np.ascontiguousarray(flat[:, k])) for k in range(3)]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(r) for r in runs])]), pa.int32()), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(counts.astype(np.int64)), lists, pa.array(collapsed, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    rows = small_batches(documents).select("doc_id", documents[text].cast("string").alias("text"))
    return rows.mapInArrow(search, f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def planted(doc_id: object, n: int) -> np.ndarray | None:
    """The production query's rewriting: for every tenth doc_id by crc32, a stretch up to the end is repeated."""
    if doc_id is None:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    return np.where(at < a, at, a + (at - a) % p)


def digests(runs: DataFrame) -> DataFrame:
    """The query's columns of `periodic_runs`: number of runs, the longest one, sha256 of all runs and of the collapsed text."""
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    one = runs.withColumn("best", best)
    return one.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.s").alias("start"), (-F.col("best.l")).alias("length"), F.col("best.p").alias("period"),
        F.expr("(-1000 * best.l) div best.p").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
