"""Benchmark decontamination by a distributed positional inverted index."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewell.llm._shared import give_back, gram_hashes, lower_ascii, mixed, ragged, small_batches, span_hashes, spans, sum_arrays, text_slices, written

#: Words of a window, and positions left free between two documents of a shard (a phrase needs a word at each, so none runs across).
WINDOW, GAP = 10, 1
#: Text of a shard of the index.
SHARD_BYTES = 1 << 19
#: Largest benchmark text that is broadcast at once; a larger benchmark is searched in parts of this size (an item is in one part).
QUERY_BYTES = 8 << 20
#: Places of rarest terms that are followed at a time.
PLACES = 1 << 18

INDEX = "doc_ids array<long>, first array<long>, terms binary, begins binary, postings binary"


def words(texts: pa.Array, limit: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Word hashes of slices of texts (A-Z lowered; words of ASCII letters, digits and all other characters), and each row's first."""
    for i, j, raw, offsets in text_slices(texts, limit):
        low = lower_ascii(raw)
        inside = (low >= 128) | ((low >= 48) & (low <= 57)) | ((low >= 97) & (low <= 122))
        starts, ends, first = spans(inside, offsets)
        yield i, j, span_hashes(low, starts, ends), first


@dataclass
class Queries:
    """The distinct windows of one part of the benchmark, dealt by their rarest terms.

    A window is words[start : start + size].  `order` holds the places of its words
    from the rarest to the most frequent of the corpus; `terms` are the rarest terms,
    the windows of term k are own[begin[k] : begin[k + 1]].  The items that hold window w
    are items[item_begin[w] : item_begin[w + 1]], positions in `names`."""

    words: np.ndarray
    start: np.ndarray
    size: np.ndarray
    items: np.ndarray
    item_begin: np.ndarray
    names: list
    order: np.ndarray | None = None
    terms: np.ndarray | None = None
    begin: np.ndarray | None = None
    own: np.ndarray | None = None

    def rank(self, vocabulary: np.ndarray, counts: np.ndarray) -> Queries:
        """Orders the words of every window by their count in the corpus."""
        longest = int(self.size.max(initial=1))
        place = np.arange(longest)
        at = np.minimum(self.start[:, None] + place, max(len(self.words) - 1, 0))
        count = np.zeros(at.shape, np.int64) if not at.size else counts[np.searchsorted(vocabulary, self.words)][at]
        count[place >= self.size[:, None]] = np.iinfo(np.int64).max
        self.order = np.argsort(count, axis=1, kind="stable").astype(np.uint8 if longest <= 256 else np.int64)
        rarest = self.words[self.start + self.order[:, 0]] if len(self.start) else self.words[:0]
        self.own = np.argsort(rarest, kind="stable")
        self.terms, self.begin = np.unique(rarest[self.own], return_index=True)
        self.begin = np.append(self.begin, len(self.own))
        return self


def query_windows(rows: list[tuple], window: int = WINDOW) -> Queries:
    """The distinct windows of (item_id, text) rows; an item of fewer words than `window`, but some, is one window."""
    hashes, lengths = [], []
    for _, _, own, first in words(pa.array([t for _, t in rows], pa.string()), QUERY_BYTES):
        hashes.append(own)
        lengths.append(np.diff(first))
    flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    lengths = np.concatenate(lengths) if lengths else np.zeros(0, np.int64)
    names = list(dict.fromkeys(n for n, _ in rows))
    number = {n: k for k, n in enumerate(names)}
    of_row = np.array([number[n] for n, _ in rows], np.int64)
    begin = np.cumsum(lengths) - lengths
    sizes = np.minimum(lengths, window)
    n_windows = np.where(lengths > 0, lengths - sizes + 1, 0)
    start, size, item = ragged(begin, n_windows), np.repeat(sizes, n_windows), np.repeat(of_row, n_windows)
    keys = np.zeros((len(start), 2), np.uint64)
    for n in np.unique(size).tolist():
        some = size == n
        for side, salt in enumerate((0, 0x9E3779B97F4A7C15)):
            keys[some, side] = gram_hashes(mixed(flat ^ np.uint64(salt)), n)[start[some]]
    _, first, back = np.unique(np.column_stack([keys, size.astype(np.uint64)]), axis=0, return_index=True, return_inverse=True) if len(start) else (None, start, start)
    pairs = np.unique(np.column_stack([back.ravel(), item]), axis=0)
    return Queries(flat, start[first], size[first], pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(first) + 1)), names)


class Shard:
    """One shard of the index: postings (ascending positions) of each term that its documents hold."""

    def __init__(self, doc_ids, first, terms: bytes, begins: bytes, postings: bytes):
        self.doc_ids, self.first = doc_ids, np.asarray(first, np.int64)
        self.terms, self.begins, self.postings = np.frombuffer(terms, np.uint64), np.frombuffer(begins, np.uint32).astype(np.int64), np.frombuffer(postings, np.uint32).astype(np.int64)
        #: every posting with the number of its term before it: ascending, so one search finds a position in any term's list
        self.places = np.repeat(np.arange(len(self.terms), dtype=np.int64), np.diff(self.begins)) << 32 | self.postings

    def documents_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, positions, "right") - 1

    def numbers_of(self, terms: np.ndarray) -> np.ndarray:
        """The number of each term, or -1 where the shard does not hold it."""
        if not len(self.terms):
            return np.full(len(terms), -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def rarest(self, q: Queries) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(window, position of its rarest term) for every posting of a rarest term: only terms that both sides hold cost anything."""
        if len(q.terms) <= len(self.terms):
            number = self.numbers_of(q.terms)
            mine = np.flatnonzero(number >= 0)
            number = number[mine]
        else:
            at = np.minimum(np.searchsorted(q.terms, self.terms), max(len(q.terms) - 1, 0))
            number = np.flatnonzero(q.terms[at] == self.terms) if len(q.terms) else at[:0]
            mine = at[number]
        listed, windows = np.diff(self.begins)[number], np.diff(q.begin)[mine]
        # a row for each window of a found term; of a long list a stretch at a time
        window = q.own[ragged(q.begin[mine], windows)]
        begin, length = np.repeat(self.begins[number], windows), np.repeat(listed, windows)
        done = 0
        while done < len(window):
            total = np.cumsum(length[done:])
            stop = done + max(1, int(np.searchsorted(total, PLACES, "right")))
            yield np.repeat(window[done:stop], length[done:stop]), self.postings[ragged(begin[done:stop], length[done:stop])]
            done = stop

    def phrases(self, q: Queries) -> tuple[np.ndarray, np.ndarray]:
        """(window, position) where a window's words stand one after the other: offset-adjusted lists, from the rarest term on."""
        windows, positions = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for window, position in self.rarest(q):
            start = position - q.order[window, 0]
            for k in range(1, q.order.shape[1]):
                going = np.flatnonzero(k < q.size[window])
                if not len(going):
                    break
                offset = q.order[window[going], k].astype(np.int64)
                number = self.numbers_of(q.words[q.start[window[going]] + offset])
                wish = number << 32 | (start[going] + offset)
                at = np.minimum(np.searchsorted(self.places, wish), len(self.places) - 1)
                keep = np.ones(len(window), bool)
                keep[going] = (number >= 0) & (start[going] + offset >= 0) & (self.places[at] == wish)
                window, start = window[keep], start[keep]
            windows.append(window)
            positions.append(start)
        return np.concatenate(windows), np.concatenate(positions)

    def near(self, q: Queries, within: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, position of its rarest term) where all its words stand within so many words of it, in any order, in the same document."""
        windows, positions = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for window, position in self.rarest(q):
            for k in range(1, q.order.shape[1]):
                going = np.flatnonzero(k < q.size[window])
                if not len(going):
                    break
                number = self.numbers_of(q.words[q.start[window[going]] + q.order[window[going], k]])
                wish, doc = number << 32 | position[going], self.documents_of(position[going])
                at = np.searchsorted(self.places, wish)
                ok = np.zeros(len(going), bool)
                for side in (np.maximum(at - 1, 0), np.minimum(at, len(self.places) - 1)):
                    there = self.places[side]
                    ok |= (there >> 32 == number) & (np.abs(there - wish) <= within) & (self.documents_of(there & 0xFFFFFFFF) == doc)
                keep = np.ones(len(window), bool)
                keep[going] = ok
                window, position = window[keep], position[keep]
            windows.append(window)
            positions.append(position)
        return np.concatenate(windows), np.concatenate(positions)


def build_index(documents: DataFrame, text: str = "text") -> DataFrame:
    """Postings of all words of whole texts, in shards of documents.

    Every document is in exactly one shard; a shard's postings are sorted by term,
    then position.
    """

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch.column("doc_id").to_pylist()
            for i, j, hashes, first in words(batch.column("text"), SHARD_BYTES):
                position = np.arange(len(hashes)) + np.repeat(np.arange(j - i), np.diff(first)) * GAP
                order = np.argsort(hashes, kind="stable")
                terms, begin = np.unique(hashes[order], return_index=True)
                begins = np.append(begin, len(order)).astype(np.uint32)
                yield pa.RecordBatch.from_pydict(
                    {"doc_ids": [docs[i:j]], "first": [(first + np.arange(j - i + 1) * GAP).tolist()], "terms": [terms.tobytes()], "begins": [begins.tobytes()], "postings": [position[order].astype(np.uint32).tobytes()]},
                    schema=pa.schema([("doc_ids", pa.list_(pa.int64())), ("first", pa.list_(pa.int64())), ("terms", pa.binary()), ("begins", pa.binary()), ("postings", pa.binary())]),
                )

    rows = small_batches(documents).select(documents["doc_id"].cast("long").alias("doc_id"), documents[text].alias("text"))
    return rows.mapInArrow(index, INDEX)


def corpus_counts(index: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """How often each word of a sorted vocabulary (the benchmark's) occurs in the whole corpus, from the index alone."""
    known = index.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batch: pa.RecordBatch, total: np.ndarray) -> None:
        for terms, begins in zip(batch.column("terms").to_pylist(), batch.column("begins").to_pylist(), strict=True):
            own, sizes = np.frombuffer(terms, np.uint64), np.diff(np.frombuffer(begins, np.uint32).astype(np.int64))
            at = np.minimum(np.searchsorted(known.value, own), len(known.value) - 1)
            mine = known.value[at] == own
            total[at[mine]] += sizes[mine]

    return sum_arrays(index.select("terms", "begins"), count, len(vocabulary))


def _parts(benchmark: DataFrame) -> Iterator[list[tuple]]:
    """The (item_id, text) rows of a benchmark, in parts of at most QUERY_BYTES of text or one item; one part at least."""
    part: list[tuple] = []
    size = 0
    for item, text in benchmark.select("item_id", "text").toLocalIterator():
        own = len(text.encode()) if text else 0
        if part and size + own > QUERY_BYTES:
            yield part
            part, size = [], 0
        part.append((None if item is None else str(item), text))
        size += own
    yield part


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", within: int | None = None, index: DataFrame | None = None) -> DataFrame:
    """What of each document occurs in the benchmark, by exact windows of words and, on request, by words near one another.

    A window is `window` consecutive words of an item (all its words if it has
    fewer, but some).  The positional index holds all words of all documents and is
    written to the shared folder (or given as `index`, from build_index, for many
    benchmarks).  Windows are dealt by their rarest term in the whole corpus; a shard
    follows only the postings of rarest terms that it holds, and intersects them with
    the offset-adjusted lists of the other words, so the work follows the corpus and
    the places found, not windows times shards.  The windows go to all tasks, those
    of a larger benchmark than QUERY_BYTES in parts: a task holds one part at a time
    and joins what the parts cover and the items they hit.

    Null and empty texts have no words.  Equal item texts are hit together; rows
    with the same item_id are one item; items with a null id count as one, which the
    digest leaves out; repeated rows are repeated documents; an empty table of
    documents gives no rows, an empty benchmark hits nothing.  Returns doc_id,
    n_words, n_hit, n_items, items_sha256, contaminated; with `within` also
    near_items, the sorted ids of items with a window all of whose words stand within
    so many words of its rarest one, in any order.
    """
    spark = documents.sparkSession
    index = written(build_index(documents, text), "positional-index") if index is None else index
    parts, vocabulary = [], np.zeros(0, np.uint64)
    for items in _parts(benchmark):
        own = query_windows(items, window)
        parts.append(spark.sparkContext.broadcast(own))
        vocabulary = np.union1d(vocabulary, own.words)
    counts = corpus_counts(index, vocabulary) if len(vocabulary) else np.zeros(0, np.int64)
    queries = []
    for part in parts:
        queries.append(spark.sparkContext.broadcast(part.value.rank(vocabulary, counts)))
        part.destroy()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # parts are read anew for each step, so several parts take a batch of shards at once
            step = 1 if len(queries) == 1 else max(batch.num_rows, 1)
            for nth in range(0, batch.num_rows, step):
                shards = [Shard(r["doc_ids"], r["first"], r["terms"], r["begins"], r["postings"]) for r in batch.slice(nth, step).to_pylist()]
                covers = [np.zeros(int(shard.first[-1]) + 1, np.int32) for shard in shards]
                hits: list[dict[int, set]] = [{} for _ in shards]
                close: list[dict[int, set]] = [{} for _ in shards]
                for part in queries:
                    q = part.value
                    for shard, cover, hit, by in zip(shards, covers, hits, close, strict=True):
                        found, at = shard.phrases(q)
                        np.add.at(cover, at, 1)
                        np.add.at(cover, at + q.size[found], -1)
                        _name(shard, q, found, at, hit)
                        if within is not None:
                            _name(shard, q, *shard.near(q, within), by)
                    if len(queries) > 1:
                        vars(part).pop("_value", None)
                for shard, cover, hit, by in zip(shards, covers, hits, close, strict=True):
                    out = _found(shard, cover, hit)
                    yield out if within is None else out.append_column("near_items", pa.array([sorted(by.get(d, set()) - {None}) for d in range(len(shard.doc_ids))], pa.list_(pa.string())))
            give_back()

    schema = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    return index.mapInArrow(search, schema if within is None else f"{schema}, near_items array<string>")


def _name(shard: Shard, q: Queries, windows: np.ndarray, positions: np.ndarray, hits: dict[int, set]) -> None:
    """Adds the items of found windows to the documents where they were found."""
    pairs = np.unique(np.column_stack([shard.documents_of(positions), windows]), axis=0)
    for d, w in pairs.tolist():
        hits.setdefault(d, set()).update(q.names[x] for x in q.items[q.item_begin[w] : q.item_begin[w + 1]].tolist())


def _found(shard: Shard, cover: np.ndarray, hits: dict[int, set]) -> pa.RecordBatch:
    """The rows of a shard's documents."""
    n = len(shard.doc_ids)
    n_words = np.diff(shard.first) - GAP
    inside = np.concatenate([[0], np.cumsum(np.cumsum(cover) > 0)])
    n_hit = inside[shard.first[1:]] - inside[shard.first[:-1]]
    n_items = np.zeros(n, np.int64)
    digest = [hashlib.sha256(b"").hexdigest()] * n
    for d, own in hits.items():
        n_items[d] = len(own)
        digest[d] = hashlib.sha256(",".join(sorted(own - {None})).encode()).hexdigest()
    return pa.RecordBatch.from_arrays([pa.array(shard.doc_ids, pa.int64()), pa.array(n_words), pa.array(n_hit), pa.array(n_items), pa.array(digest), pa.array(n_hit > 0)], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


ORACLE_SQL = """
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[p : p + least(10, len(w)) - 1], ' ') AS g
  FROM iw, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS u(p) WHERE len(w) > 0
), sizes AS (SELECT DISTINCT n FROM windows
), grams AS (
  SELECT doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') AS g
  FROM dw, sizes, unnest(range(1, len(w) - n + 2)) AS u(p) WHERE len(w) >= n
), hits AS (SELECT g.doc_id, g.n, g.p, x.item_id FROM grams g JOIN windows x ON g.n = x.n AND g.g = x.g
), hit_words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT doc_id, n, p FROM hits), unnest(range(p, p + n)) AS u(q) GROUP BY doc_id
), hit_items AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(i, ',' ORDER BY i)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hits) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""
