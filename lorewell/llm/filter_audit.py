"""How quality filters interact, from packed bitmap indexes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorewell.llm._shared import distinct_spans, small_batches, spans, spread_join, text_slices, written

#: Filters by the letter of their bit, the last one compares texts of the whole table.
FILTERS = "ABCDE"
#: Least words, least share of distinct words, largest share of capitals (percent), forbidden characters.
LEAST_WORDS, DISTINCT, CAPITALS, FORBIDDEN = 50, 65, 5, b"#$%&*|"
#: Rows of a bitmap index that is counted at once.
INDEXED = 1 << 20
ALL = (1 << len(FILTERS)) - 1


def failures(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The bits of filters A to D that each row of a slice of bytes fails."""
    kind = np.zeros(256, np.uint8)  # 1: white space, 2: capital, 4: not the first byte of a character, 8: forbidden
    kind[[32, *range(9, 14)]] |= 1
    kind[65:91] |= 2
    kind[128:192] |= 4
    kind[list(FORBIDDEN)] |= 8
    classes = kind[raw]

    def each(bit: int) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(classes & bit != 0)])[offsets])

    starts, ends, first = spans(classes & 1 == 0, offsets)
    words, rows = np.diff(first), len(offsets) - 1
    distinct, name = distinct_spans(raw, starts, ends)
    own = np.repeat(np.arange(rows), words)
    different = np.bincount(np.unique(own * max(1, len(distinct)) + name) // max(1, len(distinct)), minlength=rows)
    points = np.diff(offsets) - each(4)
    out = (words < LEAST_WORDS) * 1 | (100 * different < DISTINCT * words) * 2 | (100 * each(2) > CAPITALS * points) * 4 | (each(8) > 0) * 8
    return out.astype(np.int32)


def counted(part: pa.Array, bits: np.ndarray) -> pa.RecordBatch:
    """For each part, set S of filters gone before and next filter f: rows that f removes, with quality and toxic label among them, and rows then kept.

    `bits` has the failed filters and, above them, the two labels.  Rows are ordered by
    part and each part has whole 64-bit words of every bitset, so that a part's own
    bitset is a range of words; its rows are marked in `member`.  What S leaves is
    `member` AND NOT each of its filters, counts are popcounts summed over the range."""
    coded = part.dictionary_encode()
    codes = coded.indices.to_numpy()
    order = np.argsort(codes, kind="stable")
    sizes = np.bincount(codes, minlength=len(coded.dictionary))
    words = (sizes + 63) // 64
    begin = np.cumsum(words) - words
    place = np.arange(len(codes)) + np.repeat(begin * 64 - (np.cumsum(sizes) - sizes), sizes)

    def bitset(marked: np.ndarray) -> np.ndarray:
        flat = np.zeros(int(words.sum()) * 64, bool)
        flat[place] = marked
        return np.packbits(flat).view(np.uint64)

    ordered = bits[order]
    fails = [bitset(ordered >> f & 1 != 0) for f in range(len(FILTERS))]
    quality, toxic = (bitset(ordered >> f & 1 != 0) for f in (len(FILTERS), len(FILTERS) + 1))
    left = {0: bitset(np.ones(len(codes), bool))}
    for s in range(1, ALL + 1):
        low = (s & -s).bit_length() - 1
        left[s] = left[s & (s - 1)] & ~fails[low]

    def popcounts(x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(np.bitwise_count(x), begin, dtype=np.int64)

    columns: list[list] = [[] for _ in range(6)]
    for s in range(ALL):
        for f in range(len(FILTERS)):
            if not s >> f & 1:
                gone = left[s] & fails[f]
                for c, x in zip(columns, (np.full(len(sizes), s), np.full(len(sizes), f), popcounts(gone), popcounts(gone & quality), popcounts(gone & toxic), popcounts(left[s | 1 << f])), strict=True):
                    c.append(x)
    n = len(columns[0])
    parts = pa.chunked_array([coded.dictionary] * n).combine_chunks()
    return pa.RecordBatch.from_arrays([parts, *(pa.array(np.concatenate(c).astype(np.int64)) for c in columns)], ["part", "s", "f", "removed", "good_lost", "toxic_lost", "kept"])


def filter_facts(documents: DataFrame, text: str = "text", part: str = "source") -> DataFrame:
    """(doc_id, part, digest, bits): the text's 128-bit BLAKE2b and the filters among A to D that it fails."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits, digests = np.zeros(batch.num_rows, np.int32), []
            for i, j, raw, offsets in text_slices(batch.column("text")):
                bits[i:j] = failures(raw, offsets)
                data = memoryview(np.ascontiguousarray(raw))
                digests += [hashlib.blake2b(data[a:b], digest_size=16).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array(digests, pa.binary()), pa.array(bits)], ["doc_id", "part", "digest", "bits"])

    rows = small_batches(documents).select("doc_id", F.coalesce(documents[part].cast("string"), F.lit("")).alias("part"), documents[text].cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, part string, digest binary, bits int")


def interaction_counts(facts: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, s, f, removed, good_lost, toxic_lost, kept): `counted` of facts with filter E and the labels, summed over all partitions."""
    facts = written(facts, "audit-facts")
    copies = facts.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("q"), F.max((F.col("toxic") == 1).cast("int")).alias("t"))
    marked = spread_join(facts, copies.drop("n"), ["digest"], "doc_id", "left", copies).withColumn("e", F.coalesce((F.col("doc_id") > F.col("first")).cast("int"), F.lit(0))).drop("digest", "first")
    shift = lambda c, k: F.shiftleft(F.coalesce(F.col(c), F.lit(0)), k)
    n = len(FILTERS)
    rows = marked.join(known, "doc_id", "left").select("part", F.col("bits").bitwiseOR(shift("e", n - 1)).bitwiseOR(shift("q", n)).bitwiseOR(shift("t", n + 1)).alias("bits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= INDEXED:
                yield from index(held)
                held, size = [], 0
        yield from index(held)

    def index(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if sum(b.num_rows for b in held):
            table = pa.Table.from_batches(held).combine_chunks()
            yield counted(table.column("part").combine_chunks(), table.column("bits").to_numpy())

    found = rows.mapInArrow(run, "part string, s long, f long, removed long, good_lost long, toxic_lost long, kept long")
    return found.groupBy("part", "s", "f").agg(*(F.sum(c).alias(c) for c in ("removed", "good_lost", "toxic_lost", "kept")))


def filter_audit(documents: DataFrame, labels: DataFrame, text: str = "text", part: str = "source") -> DataFrame:
    """For each part and each order of the five filters, what every step keeps, removes and loses.

    Filters fail a text of under 50 words (A), of too few distinct words (B), of too
    many capitals (C), with a forbidden character (D), or equal to the text of a smaller
    doc_id anywhere (E; texts are equal where 128 bits of BLAKE2b are).  Every partition
    makes packed bitsets of its rows' failures and labels; AND-NOT and popcount give,
    for each set of filters gone before and each next filter, the counts, which are
    summed over partitions.  All 120 orders read theirs from these 80.

    Null and empty texts are equal, have no words and fail A alone besides E; a null
    part is the empty string.  Repeated rows count as often as they stand; of rows with
    one doc_id none makes another fail E; a null doc_id is never smaller, fails no E and
    has no label.  A document is good (toxic) if any of its labels says so.  An empty
    table gives no rows; further columns are ignored.  Texts are read once, in slices
    of 2 MB (a longer text alone); what is shuffled is some 40 bytes a document.
    Returns part, filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley.
    """
    spark = documents.sparkSession
    counts = interaction_counts(filter_facts(documents, text, part), labels)
    # a set of k filters precedes f in k! (4 - k)! orders
    orders_of = F.element_at(F.array(*[F.lit(x) for x in (24, 6, 4, 6, 24)]), F.bit_count("s") + 1)
    own = Window.partitionBy("part", "f")
    total = F.max(F.when(F.col("s") == 0, F.col("removed"))).over(own)
    alone = F.max(F.when(F.expr(f"s = {ALL} - shiftleft(1, CAST(f AS INT))"), F.col("removed"))).over(own)
    each = counts.withColumns({"unique_fails": alone, "redundant": total - F.col("removed"), "shapley": F.sum(F.col("removed") * orders_of).over(own)})
    steps = [("".join(p), k + 1, sum(1 << FILTERS.index(x) for x in p[:k]), FILTERS.index(p[k])) for p in permutations(FILTERS) for k in range(len(FILTERS))]
    orders = spark.createDataFrame(steps, "filter_order string, step int, s long, f long")
    return each.join(F.broadcast(orders), ["s", "f"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


#: The same from flags of each document, grouped by the 128 combinations; sets of filters as texts.
ORACLE_SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), known AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS q, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS x FROM labels GROUP BY doc_id
), flags AS (
  SELECT part,
    CASE WHEN len(w) < 50 THEN 1 ELSE 0 END AS a,
    CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 1 ELSE 0 END AS b,
    CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 1 ELSE 0 END AS c,
    CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 1 ELSE 0 END AS d,
    CASE WHEN words.doc_id > min(words.doc_id) OVER (PARTITION BY t) THEN 1 ELSE 0 END AS e,
    coalesce(q, 0) AS q, coalesce(x, 0) AS x
  FROM words LEFT JOIN known ON words.doc_id = known.doc_id
), cube AS (
  SELECT part, a, b, c, d, e, q, x, count(*) AS n,
    (CASE WHEN a = 1 THEN 'A' ELSE '' END) || (CASE WHEN b = 1 THEN 'B' ELSE '' END) || (CASE WHEN c = 1 THEN 'C' ELSE '' END) || (CASE WHEN d = 1 THEN 'D' ELSE '' END) || (CASE WHEN e = 1 THEN 'E' ELSE '' END) AS failed
  FROM flags GROUP BY ALL
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (
  SELECT l1.f || l2.f || l3.f || l4.f || l5.f AS filter_order
  FROM letters l1, letters l2, letters l3, letters l4, letters l5
  WHERE l1.f NOT IN (l2.f, l3.f, l4.f, l5.f) AND l2.f NOT IN (l3.f, l4.f, l5.f) AND l3.f NOT IN (l4.f, l5.f) AND l4.f <> l5.f
), steps AS (
  SELECT filter_order, step, filter_order[step:step] AS f, filter_order[1:step - 1] AS before
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), found AS (
  SELECT part, filter_order, CAST(step AS INTEGER) AS step, f,
    CAST(sum(CASE WHEN gone = 0 AND NOT own THEN n ELSE 0 END) AS BIGINT) AS kept,
    CAST(sum(CASE WHEN gone = 0 AND own THEN n ELSE 0 END) AS BIGINT) AS removed,
    CAST(sum(CASE WHEN gone > 0 AND own THEN n ELSE 0 END) AS BIGINT) AS redundant,
    CAST(sum(CASE WHEN own AND length(failed) = 1 THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
    CAST(sum(CASE WHEN gone = 0 AND own AND q = 1 THEN n ELSE 0 END) AS BIGINT) AS good_lost,
    CAST(sum(CASE WHEN gone = 0 AND own AND x = 1 THEN n ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM (SELECT cube.*, steps.*, contains(failed, f) AS own, length(regexp_replace(failed, '[^x' || before || ']', '', 'g')) AS gone FROM cube, steps)
  GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM found
"""
