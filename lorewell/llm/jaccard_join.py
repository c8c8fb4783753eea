"""N-gram Jaccard join: a size-aware heavy-light join with connected components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewell.llm._shared import components, drop_written, gram_hashes, lower_ascii, mixed, small_batches, span_hashes, spans, spread_join, sum_arrays, text_slices, with_ids, written

#: Words of a shingle, and the threshold in hundredths.
SHINGLE, PERCENT = 5, 80
#: Largest set size that the cost model may call small (subsets grow as binomials).
MOST_SMALL = 24
#: Shingles of a block of postings; members of a tile of a list; bits of the difference filter; counters of the frequency sketch.
BLOCK, TILE, BITS, COUNTERS = 2_000_000, 1024, 1024, 1 << 18
#: Bytes of a posting, and of a bucket of them (as many buckets as the shingles of all documents need).
POSTING, BUCKET_BYTES = 6, 8 << 20
#: A posting that several documents of its block share.
SHARED = 0xFFFF


def shingle_sets(texts: pa.Array, k: int = SHINGLE) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its shingles."""
    for i, j, raw, offsets in text_slices(texts):
        low = lower_ascii(raw)
        starts, ends, first = spans(~((low == 32) | ((low >= 9) & (low <= 13))), offsets)
        hashes = span_hashes(low, starts, ends)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            yield np.unique(gram_hashes(hashes[a:b], k))


def _signature(s: np.ndarray) -> tuple[int, int]:
    import xxhash

    data = s.tobytes()
    return xxhash.xxh3_64_intdigest(data) - (1 << 63), xxhash.xxh3_64_intdigest(data, seed=1) - (1 << 63)


def needed(a: int, b: int, percent: int = PERCENT) -> int:
    """The least overlap with which sets of these sizes reach the threshold: 100 i >= percent (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


def _partners(n: int, percent: int) -> range:
    """Sizes that a set of n can link with."""
    return range(-(-percent * n // 100), 100 * n // percent + 1)


def subset_cost(n: int, percent: int = PERCENT) -> int:
    """Subsets that a small set of n emits."""
    return sum(comb(n, needed(n, s, percent)) for s in _partners(n, percent) if needed(n, s, percent) <= n)


def boundary(histogram: dict[int, int], list_length: float, percent: int = PERCENT) -> int:
    """The largest size called small: where enumerating subsets of all sets up to it and scanning lists for the rest costs least."""
    prefix = {n: n - -(-percent * n // 100) + 1 for n in histogram}
    best, at = None, 0
    for x in range(MOST_SMALL + 1):
        cost = sum(c * (subset_cost(n, percent) if n <= x else prefix[n] * (1 + list_length)) for n, c in histogram.items())
        if best is None or cost < best:
            best, at = cost, x
    return at


def _classes(rows: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles and a 128-bit signature of each document's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, hi, lo = [], [], []
            for s in shingle_sets(batch.column("text"), k):
                a, b = _signature(s)
                n.append(len(s))
                hi.append(a)
                lo.append(b)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64())], ["doc_id", "n", "hi", "lo"])

    return rows.mapInArrow(run, "doc_id long, n long, hi long, lo long")


def _with_shared_shingles(rows: DataFrame, n_shingles: int, k: int, percent: int) -> DataFrame:
    """doc_ids of documents enough of whose shingles occur in other documents too (a superset of all that link).

    Postings go packed, by ranges of the hash: a block of documents sends each of
    its shingles once, without a document where several of the block hold it, so
    a shingle of a third of all rows costs a posting for each block.
    """
    bits = min(32, max(4, (POSTING * n_shingles // BUCKET_BYTES).bit_length()))
    schema = "bucket long, block long, rest binary, docs binary, doc_ids binary, lack binary"
    names = ["bucket", "block", "rest", "docs", "doc_ids", "lack"]

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 24
        sets: list[np.ndarray] = []
        ids: list[int] = []
        seen: set[tuple[int, int]] = set()
        size = 0

        def packed() -> pa.RecordBatch:
            lengths = np.fromiter(map(len, sets), np.int64, len(sets))
            flat = np.concatenate(sets)
            owner = np.repeat(np.arange(len(sets), dtype=np.uint16), lengths)
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            fresh = np.concatenate([[True], flat[1:] != flat[:-1]])
            begin = np.flatnonzero(fresh)
            several = np.diff(np.append(begin, len(flat))) > 1
            credit = np.bincount(owner[np.repeat(several, np.diff(np.append(begin, len(flat))))], minlength=len(sets))
            flat, owner = flat[begin], np.where(several, np.uint16(SHARED), owner[begin])
            rest = ((flat << np.uint64(bits)) >> np.uint64(32)).astype("<u4")
            bucket = (flat >> np.uint64(64 - bits)).astype(np.int64)
            stops = np.searchsorted(bucket, np.arange((1 << bits) + 1))
            some = np.flatnonzero(np.diff(stops))
            lack = (-(-percent * lengths // 100) - credit).astype("<i8")
            last = (1 << bits) + block % (1 << bits)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([*some.tolist(), last], pa.int64()),
                    pa.array([block] * (len(some) + 1), pa.int64()),
                    pa.array([*(rest[stops[b] : stops[b + 1]].tobytes() for b in some), None], pa.binary()),
                    pa.array([*(owner[stops[b] : stops[b + 1]].astype("<u2").tobytes() for b in some), None], pa.binary()),
                    pa.array([*([None] * len(some)), np.array(ids, "<i8").tobytes()], pa.binary()),
                    pa.array([*([None] * len(some)), lack.tobytes()], pa.binary()),
                ],
                names,
            )

        for batch in batches:
            for doc, s in zip(batch.column("doc_id").to_pylist(), shingle_sets(batch.column("text"), k), strict=True):
                if doc is None or not len(s):
                    continue
                sig = _signature(s)
                if sig in seen:
                    continue
                seen.add(sig)
                sets.append(s)
                ids.append(doc)
                size += len(s)
                if size >= BLOCK or len(sets) == SHARED - 1:
                    yield packed()
                    block, size = block + 1, 0
                    sets.clear()
                    ids.clear()
                    seen.clear()
        if sets:
            yield packed()

    def match(table: pa.Table) -> pa.Table:
        empty = pa.table({"block": pa.array([], pa.int64()), "docs": pa.array([], pa.binary()), "doc_ids": pa.array([], pa.binary()), "lack": pa.array([], pa.binary())})
        listed = table.filter(pc.is_valid(table["doc_ids"])).select(["block", "docs", "doc_ids", "lack"])
        table = table.filter(pc.is_valid(table["rest"]))
        if not table.num_rows:
            return listed if listed.num_rows else empty
        rest = [np.frombuffer(x, "<u4") for x in table["rest"].to_pylist()]
        docs = np.concatenate([np.frombuffer(x, "<u2") for x in table["docs"].to_pylist()])
        row = np.repeat(np.arange(len(rest)), [len(x) for x in rest])
        flat = np.concatenate(rest)
        order = np.argsort(flat, kind="stable")
        flat = flat[order]
        same = np.concatenate([[False], flat[1:] == flat[:-1]])
        common = same.copy()
        common[:-1] |= same[1:]
        hit = order[common]
        hit = hit[docs[hit] != SHARED]
        hit = hit[np.argsort(row[hit], kind="stable")]
        stops = np.searchsorted(row[hit], np.arange(len(rest) + 1))
        blocks = table["block"].to_pylist()
        some = np.flatnonzero(np.diff(stops)).tolist()
        out = pa.table({"block": pa.array([blocks[r] for r in some], pa.int64()), "docs": pa.array([docs[hit[stops[r] : stops[r + 1]]].tobytes() for r in some], pa.binary()), "doc_ids": pa.nulls(len(some), pa.binary()), "lack": pa.nulls(len(some), pa.binary())})
        return pa.concat_tables([out, listed]) if listed.num_rows else out

    def enough(table: pa.Table) -> pa.Table:
        own = table.filter(pc.is_valid(table["doc_ids"])).to_pylist()
        if not own:
            return pa.table({"doc_id": pa.array([], pa.int64())})
        ids, lack = np.frombuffer(own[0]["doc_ids"], "<i8"), np.frombuffer(own[0]["lack"], "<i8").copy()
        for x in table["docs"].to_pylist():
            if x is not None:
                lack -= np.bincount(np.frombuffer(x, "<u2"), minlength=len(ids))
        return pa.table({"doc_id": pa.array(ids[lack <= 0], pa.int64())})

    return (
        rows.mapInArrow(post, schema)
        .groupBy("bucket")
        .applyInArrow(match, "block long, docs binary, doc_ids binary, lack binary")
        .groupBy("block")
        .applyInArrow(enough, "doc_id long")
    )


def parity_bits(s: np.ndarray) -> np.ndarray:
    """For each of BITS bins of the hash whether an odd number of shingles falls in it: where two sets' bits differ their bins hold a shingle of only one, so the distance is at most the sets' difference."""
    return np.packbits((np.bincount((s >> np.uint64(20)).astype(np.int64) & (BITS - 1), minlength=BITS) & 1).astype(bool))


def may_reach(na: np.ndarray, nb, distance: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes, whose difference is at least `distance`, may reach the threshold."""
    both = na + nb
    return (np.minimum(na, nb) * 100 >= percent * np.maximum(na, nb)) & (distance <= both - 2 * -(-percent * both // (100 + percent)))


def _sets(rows: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(batch.column("text"), k))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(len, sets), pa.int64()), pa.array([parity_bits(s).tobytes() for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["rep", "n", "bits", "shingles"])

    return rows.mapInArrow(run, "rep long, n long, bits binary, shingles binary")


def _frequency_sketch(sets: DataFrame) -> np.ndarray:
    """Counters of how often shingles occur, by low bits of the hash: of fixed size, summed on the executors."""

    def add(batch: pa.RecordBatch, total: np.ndarray) -> None:
        flat = np.frombuffer(b"".join(batch.column("shingles").to_pylist()), np.uint64)
        total += np.bincount((flat & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)

    return sum_arrays(sets.select("shingles"), add, COUNTERS)


def _small_links(sets: DataFrame, most: int, percent: int) -> DataFrame:
    """Links of small sets with small sets: sets that hold the same subset of the needed size, around one of the smaller size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        choices: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            reps, keys, less = [], [], []
            for row in batch.to_pylist():
                own = np.frombuffer(row["shingles"], np.uint64)
                n = len(own)
                for s in _partners(n, percent):
                    c = needed(n, s, percent)
                    if s > most or c > n:
                        continue
                    if (n, c) not in choices:
                        choices[n, c] = np.array(list(combinations(range(n), c)), np.uint8)
                    a, b = min(n, s), max(n, s)
                    salt = mixed(np.array([a << 32 | b], np.uint64))[0]
                    h = mixed(np.bitwise_xor.reduce(mixed(own ^ salt)[choices[n, c]], axis=1) + salt)
                    keys.append(h.view(np.int64))
                    reps.append(np.full(len(h), row["rep"]))
                    less.append(np.full(len(h), n == a))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, reps, less)], ["key", "rep", "less"])

    keyed = sets.where(F.col("n") <= most).mapInArrow(run, "key long, rep long, less boolean")
    centre = written(keyed.groupBy("key").agg(F.min(F.when(F.col("less"), F.col("rep"))).alias("a"), F.count("*").alias("n")).where("n > 1 AND a IS NOT NULL"), "subset-centres")
    total = centre.agg(F.sum("n")).first()[0] or 0
    return spread_join(keyed, centre.drop("n"), ["key"], "rep", counts=centre, total=total).where("rep <> a").select("a", F.col("rep").alias("b")).distinct()


def _inverted_lists(sets: DataFrame, most: int, sketch: np.ndarray, percent: int) -> DataFrame:
    """(h, rep, a, c): postings of shingles that several sets list, with the smallest rep and the length of each list.

    Each large set, and each small set near the boundary, is listed under its
    prefix in a fixed order (rare before frequent by the sketch, then by hash): sets
    that reach the threshold meet in a list."""
    rank = sets.sparkSession.sparkContext.broadcast(sketch)
    least = -(-percent * (most + 1) // 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, reps = [], []
            for row in batch.to_pylist():
                own = np.frombuffer(row["shingles"], np.uint64)
                p = len(own) - -(-percent * len(own) // 100) + 1
                order = np.lexsort((own, rank.value[(own & np.uint64(COUNTERS - 1)).astype(np.int64)]))[:p]
                hashes.append(own[order].view(np.int64))
                reps.append(np.full(p, row["rep"]))
            if hashes:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes)), pa.array(np.concatenate(reps))], ["h", "rep"])

    postings = written(sets.where(F.col("n") >= least).select("rep", "shingles").mapInArrow(run, "h long, rep long"), "postings")
    heads = written(postings.groupBy("h").agg(F.min("rep").alias("a"), F.count("*").alias("c")).where("c > 1"), "list-heads")
    lists = written(spread_join(postings, heads, ["h"], "rep", counts=heads.withColumnRenamed("c", "n")), "inverted-lists")
    drop_written(postings)
    drop_written(heads)
    return lists


def _words(bits: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(bits), np.uint64).reshape(-1, BITS // 64)


def _may_link(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and parity bits allow."""
    side = lambda x: sets.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = _words(batch.column("bitsa").to_pylist()), _words(batch.column("bitsb").to_pylist())
                ok = may_reach(batch.column("na").to_numpy(), batch.column("nb").to_numpy(), np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64), percent)
                yield batch.select(["a", "b"]).filter(pa.array(ok))

    pairs = written(pairs, "list-pairs")
    total = pairs.count()
    both = spread_join(spread_join(pairs, side("a"), ["a"], "b", counts=pairs.groupBy("a").agg(F.count("*").alias("n")), total=total), side("b"), ["b"], "a", counts=pairs.groupBy("b").agg(F.count("*").alias("n")), total=total)
    return both.select("a", "b", "na", "nb", "bitsa", "bitsb").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold, exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                same = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * same >= percent * (len(x) + len(y) - same))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    pairs = written(pairs, "pairs")
    side = lambda x: with_ids(sets.select(F.col("rep").alias(x), F.col("shingles").alias(f"s{x}")), pairs.select(x).distinct(), x)
    total = pairs.count()
    both = spread_join(spread_join(pairs, side("a"), ["a"], "b", counts=pairs.groupBy("a").agg(F.count("*").alias("n")), total=total), side("b"), ["b"], "a", counts=pairs.groupBy("b").agg(F.count("*").alias("n")), total=total)
    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _large_links(sets: DataFrame, lists: DataFrame, most: int, percent: int) -> DataFrame:
    """Links that connect all sets of the inverted lists which links connect.

    First each list's members are tested with its first member; these links' components
    are labels.  Then lists are scanned for pairs with different labels only, so a
    large family of copies costs no square of its size; a list of more than TILE
    members is scanned tile against tile in many tasks.  Pairs are sieved by size and
    parity bits before the sets themselves are joined for the exact test."""
    heads = _may_link(lists.where("rep <> a").select("a", F.col("rep").alias("b")).distinct(), sets, percent)
    first = written(_verified(heads, sets, percent), "first-links")
    labels = components(first, "labels")
    labelled = lists.join(labels, F.col("rep") == F.col("id"), "left").select("h", "rep", "c", F.coalesce("component", "rep").alias("label"))
    mixed_lists = written(labelled.groupBy("h").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("n")).where("x <> y"), "mixed-lists")
    open_lists = written(spread_join(labelled, mixed_lists.select("h"), ["h"], "rep", "left_semi", counts=mixed_lists, total=lists.count()), "open-lists")
    drop_written(mixed_lists)
    groups = max(1, -(-open_lists.count() // 8192))
    placed = (
        open_lists.withColumn("g", F.ceil(F.col("c") / TILE))
        .withColumn("t", F.pmod(F.xxhash64("rep"), F.col("g")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("g") - 1)))
        .select("rep", "label", "t", F.least("t", "other").alias("lo"), F.xxhash64("h", F.least("t", "other"), F.greatest("t", "other")).alias("key"))
        .join(sets.select("rep", "n", "bits"), "rep")
        .withColumn("part", F.pmod("key", F.lit(groups)))
    )

    def scan(table: pa.Table) -> pa.Table:
        key, rep, n, label = (table[c].to_numpy() for c in ("key", "rep", "n", "label"))
        second = table["t"].to_numpy() != table["lo"].to_numpy()
        bits = _words(table["bits"].to_pylist())
        order = np.argsort(key, kind="stable")
        found: set[tuple[int, int]] = set()
        for rows in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
            across = second[rows].any() and not second[rows].all()
            for k, i in enumerate(rows[:-1].tolist()):
                others = rows[k + 1 :]
                others = others[(label[others] != label[i]) & (np.maximum(n[others], n[i]) > most)]
                if across:
                    others = others[second[others] != second[i]]
                if len(others):
                    others = others[may_reach(n[others], n[i], np.bitwise_count(bits[others] ^ bits[i]).sum(axis=1, dtype=np.int64), percent)]
                    found.update((min(rep[i], x), max(rep[i], x)) for x in rep[others].tolist())
        pairs = sorted(found)
        return pa.table({"a": pa.array([int(x) for x, _ in pairs], pa.int64()), "b": pa.array([int(x) for _, x in pairs], pa.int64())})

    rest = placed.groupBy("part").applyInArrow(scan, "a long, b long").distinct()
    return first.unionByName(_verified(rest, sets, percent))


def jaccard_join(documents: DataFrame, k: int = SHINGLE, percent: int = PERCENT, text: str = "text") -> DataFrame:
    """Groups whole texts by Jaccard similarity of their word shingles, exactly.

    A-Z is lowered, words are split at ASCII white space; a text of fewer words than
    k, but some, has one shingle.  Documents with equal sets are one class.  Classes
    too few of whose shingles occur elsewhere cannot link and are left alone (packed
    postings, pre-aggregated for each block).  Of the rest, small sets emit their
    subsets of the needed overlap size and meet under them; large sets meet in
    inverted lists of their rarest shingles and are tested exactly; the boundary is
    where the measured sizes make the total cost least.

    Null, empty and wordless texts have an empty set and link with nothing; repeated
    rows share a class (a doc_id is taken to name one text); a null doc_id gets a null component; an empty table gives no
    rows.  Returns doc_id, n_shingles, component_id (the smallest doc_id reachable by
    links, itself included).
    """
    rows = small_batches(documents).select(documents["doc_id"].cast("long").alias("doc_id"), documents[text].alias("text"))
    classes = written(_classes(rows, k), "classes")
    n_docs, n_shingles = classes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    several = written(classes.where("n > 0 AND doc_id IS NOT NULL").groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"), F.count("*").alias("c")).where("c > 1"), "equal-sets")
    copies = spread_join(classes, several.select("hi", "lo", "rep"), ["hi", "lo"], "doc_id", "left", counts=several.withColumnRenamed("c", "n"), total=n_docs)
    members = written(copies.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("rep", "doc_id")).otherwise(F.col("doc_id")).alias("rep")), "members")
    drop_written(classes)
    shared = _with_shared_shingles(rows, n_shingles, k, percent)
    reps = written(shared.join(members, "doc_id").select(F.col("rep").alias("doc_id")).distinct(), "candidates")
    kept = with_ids(rows, reps, "doc_id")
    sets = written(_sets(kept, k).dropDuplicates(["rep"]), "shingle-sets")

    histogram = {r["n"]: r["c"] for r in sets.where(F.col("n") <= 4 * MOST_SMALL).groupBy("n").agg(F.count("*").alias("c")).collect()}
    sketch = _frequency_sketch(sets)
    used = sketch[sketch > 0]
    most = boundary(histogram, min(float(used.mean()) if len(used) else 0.0, 64.0), percent)
    links = _large_links(sets, _inverted_lists(sets, most, sketch, percent), most, percent)
    if most:
        links = links.unionByName(_small_links(sets, most, percent))
    found = components(links, "links")
    sizes = several.groupBy("rep").agg(F.sum("c").alias("n"))
    whole = spread_join(members, found.withColumnRenamed("id", "rep"), ["rep"], "doc_id", "left", counts=sizes, total=n_docs)
    return whole.select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))


ORACLE_SQL = """
WITH RECURSIVE dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[p : p + least(5, len(w)) - 1], ' ') AS g
  FROM dw, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS u(p) WHERE len(w) > 0
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)
), ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT DISTINCT a AS v, a AS r FROM ways
  UNION
  SELECT w.b, reach.r FROM reach JOIN ways w ON w.a = reach.v WHERE reach.r < w.b
)
SELECT dw.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, least(dw.doc_id, coalesce(c.m, dw.doc_id)) AS component_id
FROM dw LEFT JOIN sizes s ON s.doc_id = dw.doc_id LEFT JOIN (SELECT v, min(r) AS m FROM reach GROUP BY v) c ON c.v = dw.doc_id
"""
