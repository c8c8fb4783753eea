"""Best-fit packing by a grouping genetic algorithm, distributed as islands with elite migration."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewell.llm._shared import drop_written, ragged, small_batches, written
from lorewell.llm._tokens import encoded, tokenizer_path

#: Production tokenizer, end id and capacity.
TOKENIZER, END_ID, CAPACITY = "word_bpe_49k.json", 1, 4096
#: Pieces of a block, islands of a block, epochs between migrations, generations of an epoch, packings of an island.
BLOCK, ISLANDS, EPOCHS, GENERATIONS, POPULATION = 8192, 2, 3, 200, 4
#: Displaced pieces that a repair takes at once.
POOL = 360


def pieces(documents: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, text: str = "text") -> DataFrame:
    """The pieces of all documents: doc_id, piece, start, length, ids_crc32."""
    path = path or tokenizer_path(TOKENIZER)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u4")
        for batch in batches:
            docs = batch.column("doc_id").to_pylist()
            rows: list[tuple] = []
            for i, flat, lengths in encoded(batch.column("text"), path):
                flat, stop = flat.astype("<u4", copy=False), 0
                for k, n in enumerate(lengths.tolist()):
                    ids, stop = np.concatenate([flat[stop : stop + n], end]), stop + n
                    for piece, a in enumerate(range(0, n + 1, capacity)):
                        part = ids[a : a + capacity]
                        rows.append((docs[i + k], piece, a, len(part), zlib.crc32(part.tobytes())))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = small_batches(documents).select(documents["doc_id"].cast("long").alias("doc_id"), documents[text].alias("text"))
    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def least_bins(lengths: np.ndarray, capacity: int) -> int:
    """No packing has fewer bins: what is longer than half a bin stands alone, and of the rest only so much fits beside it (for every least length that counts)."""
    own = np.sort(lengths)
    total = np.concatenate([[0], np.cumsum(own)])
    half = int(np.searchsorted(own, capacity // 2, "right"))
    counted = np.unique(np.concatenate([[0], own[:half]]))  # pieces below this are left out
    low, high = np.searchsorted(own, counted), np.searchsorted(own, capacity - counted, "right")
    room = (high - half) * capacity - (total[high] - total[half])
    rest = np.maximum(0, -(-(total[half] - total[low] - room) // capacity))
    return int((len(own) - half + rest).max(initial=0))


class Packer:
    """Packings of one block: an array with the bin of each piece (lengths in descending order)."""

    def __init__(self, lengths: np.ndarray, capacity: int, rng: np.random.Generator):
        self.lengths, self.capacity, self.rng = lengths, capacity, rng
        self.bound = least_bins(lengths, capacity)

    def best_fit(self, bins: np.ndarray, todo: np.ndarray, room: np.ndarray) -> np.ndarray:
        """Puts the pieces of `todo`, in this order, each where the least room is left over; opens new bins as needed."""
        free = sorted((int(r), b) for b, r in enumerate(room.tolist()) if r > 0)
        n = len(room)
        for k, length in zip(todo.tolist(), self.lengths[todo].tolist(), strict=True):
            at = bisect_left(free, (length, -1))
            if at == len(free):
                left, b, n = self.capacity - length, n, n + 1
            else:
                left, b = free.pop(at)
                left -= length
            bins[k] = b
            if left:
                insort(free, (left, b))
        return bins

    def fresh(self, noise: float) -> np.ndarray:
        """Without noise, best fit in descending order; else bins filled one by one with the least slack, ties at random."""
        n = len(self.lengths)
        if not noise:
            return self.best_fit(np.full(n, -1), np.argsort(-self.lengths, kind="stable"), np.zeros(0, np.int64))
        return self.least_slack(np.full(n, -1), np.arange(n), 0)

    def least_slack(self, bins: np.ndarray, todo: np.ndarray, n: int) -> np.ndarray:
        """Packs the pieces of `todo` into new bins from number n on: the longest piece left, then pairs (or one) that leave least room."""
        order = todo[np.argsort(self.lengths[todo], kind="stable")]
        sizes, first = np.unique(self.lengths[order], return_index=True)
        left = np.diff(np.append(first, len(order)))
        taken = first + left  # pieces of a size go from the end
        while len(sizes):
            room, k = self.capacity, len(sizes) - 1
            while True:
                taken[k] -= 1
                left[k] -= 1
                bins[order[taken[k]]] = n
                room -= int(sizes[k])
                fit = int(np.searchsorted(sizes, room, "right"))
                some = np.flatnonzero(left[:fit])
                if not len(some):
                    break
                own = sizes[some]
                other = np.searchsorted(own, room - own, "right") - 1
                twice = (other == np.arange(len(some))) & (left[some] < 2)
                other = other - twice
                both = own + np.where(other >= 0, own[np.maximum(other, 0)], 0)
                best = np.flatnonzero(both == both.max())
                k = int(some[best[self.rng.integers(len(best))]])
            n += 1
            keep = left > 0
            if not keep[-1] or keep.sum() < 0.8 * len(keep):
                sizes, left, taken = sizes[keep], left[keep], taken[keep]
        return bins

    def exact(self, pool: np.ndarray) -> list[np.ndarray]:
        """Disjoint pairs and triples of the pool that fill a bin exactly, those of the pieces with fewest choices first."""
        pool = pool[np.argsort(self.lengths[pool], kind="stable")]
        own = self.lengths[pool]
        i, j = np.triu_indices(len(pool), 1)
        rest = self.capacity - own[i] - own[j]
        pairs = rest == 0
        low = np.maximum(np.searchsorted(own, rest), j + 1)
        n = np.where(rest > 0, np.maximum(np.searchsorted(own, rest, "right") - low, 0), 0)
        sets = np.concatenate([np.column_stack([np.repeat(i, n), np.repeat(j, n), ragged(low, n)]), np.column_stack([i[pairs], j[pairs], j[pairs]])])
        sets = sets[self.rng.permutation(len(sets))]
        chosen = []
        while len(sets):
            choices = np.bincount(sets[:, :2].ravel(), minlength=len(pool)) + np.bincount(sets[:, 2][sets[:, 2] != sets[:, 1]], minlength=len(pool))
            rarest = np.where(choices > 0, choices, len(sets) + 1).argmin()
            some = np.flatnonzero((sets == rarest).any(axis=1))
            one = sets[some[choices[sets[some]].sum(axis=1).argmin()]]
            chosen.append(pool[np.unique(one)])
            sets = sets[~np.isin(sets, one).any(axis=1)]
        return chosen

    def fills(self, bins: np.ndarray) -> np.ndarray:
        return np.bincount(bins, weights=self.lengths).astype(np.int64)

    def worth(self, bins: np.ndarray) -> tuple[int, float]:
        """Fewer bins first; then fuller ones, so that what is left over gathers in few."""
        fills = self.fills(bins)
        return -len(fills), float((fills / self.capacity) ** 2 @ np.ones(len(fills)))

    def done(self, bins: np.ndarray) -> bool:
        """Whether no packing has fewer bins."""
        return int(bins.max(initial=-1)) + 1 <= self.bound

    def crossover(self, into: np.ndarray, donor: np.ndarray) -> np.ndarray:
        """Injects whole well-filled bins of `donor`, removes the bins of `into` that hold their pieces as well as
        unfilled ones, repairs by exact sets of the displaced pieces, and best-fits the others."""
        fills, own = self.fills(donor), self.fills(into)
        well = np.flatnonzero(fills >= np.quantile(fills, 0.5))
        most = max(1, min(len(well), POOL // 12))
        chosen = self.rng.choice(well, int(self.rng.integers(1, most + 1)), replace=False)
        given = np.isin(donor, chosen)
        lost = np.zeros(len(own), bool)
        lost[into[given]] = True
        sizes = np.bincount(into, minlength=len(own))
        unfilled = np.flatnonzero((own < self.capacity) & ~lost)
        unfilled = unfilled[np.argsort(own[unfilled] + self.rng.random(len(unfilled)), kind="stable")]
        if self.rng.random() < 0.5:
            unfilled = self.rng.permutation(unfilled)
        budget = POOL - int(sizes[lost].sum() - given.sum())
        lost[unfilled[: max(1, int(np.searchsorted(np.cumsum(sizes[unfilled]), budget)))]] = True
        stay = ~lost[into] & ~given
        child = np.full(len(into), -1)
        names = np.full(len(own), -1)
        n = int((~lost).sum())
        names[~lost] = np.arange(n)
        child[stay] = names[into[stay]]
        order = np.full(len(fills), -1)
        order[chosen] = n + np.arange(len(chosen))
        child[given] = order[donor[given]]
        n += len(chosen)
        displaced = np.flatnonzero(child < 0)
        for some in self.exact(self.rng.choice(displaced, POOL, replace=False) if len(displaced) > POOL else displaced):
            child[some] = n
            n += 1
        rest = np.flatnonzero(child < 0)
        room = self.capacity - np.bincount(child[child >= 0], weights=self.lengths[child >= 0], minlength=n).astype(np.int64)
        plain = self.best_fit(child.copy(), rest[np.argsort(-self.lengths[rest], kind="stable")], room)
        return max(plain, self.least_slack(child, rest, n), key=self.worth)

    def evolve(self, population: list[np.ndarray], generations: int, size: int) -> list[np.ndarray]:
        """The population after some generations, best first."""
        while len(population) < size:
            population.append(self.fresh(float(len(population))))
            if self.done(population[-1]):
                break
        worths = [self.worth(p) for p in population]
        for _ in range(generations):
            best = max(range(len(population)), key=worths.__getitem__)
            if len(population) < 2 or self.done(population[best]):
                break
            a, b = self.rng.choice(len(population), 2, replace=False).tolist()
            child = self.crossover(population[a], population[b])
            worth = self.worth(child)
            if worth >= worths[a]:
                population[a], worths[a] = child, worth
        return [population[k] for k in sorted(range(len(population)), key=worths.__getitem__, reverse=True)][:size]


def _packed(population: list[np.ndarray]) -> bytes:
    return np.stack(population).astype("<i4").tobytes()


def _pack_level(open_pieces: DataFrame, n: int, level: int, capacity: int) -> DataFrame:
    """Packs pieces (uid, length) in blocks; returns uid, block, bin, fill, length."""
    blocks = max(1, -(-n // BLOCK))
    grouped = (
        open_pieces.withColumn("block", F.pmod(F.xxhash64("uid", F.lit(level)), F.lit(blocks)))
        .groupBy("block")
        .agg(F.sort_array(F.collect_list(F.struct("length", "uid")), asc=False).alias("items"))
        .select("block", F.col("items.length").alias("lengths"), F.col("items.uid").alias("uids"))
    )
    islands = written(grouped.withColumn("island", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(ISLANDS - 1).cast("long")))), "islands")
    state = islands.withColumn("population", F.lit(b""))
    tasks = max(1, min(blocks * ISLANDS, 4096))

    def evolve(epoch: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    lengths = np.asarray(row["lengths"], np.int64)
                    packer = Packer(lengths, capacity, np.random.default_rng([row["block"], row["island"], epoch, level]))
                    known = np.frombuffer(row["population"], "<i4").astype(np.int64).reshape(-1, len(lengths))
                    best = packer.evolve([*known], GENERATIONS, POPULATION)
                    n_bins, fullness = packer.worth(best[0])
                    yield pa.RecordBatch.from_pydict({"block": [row["block"]], "island": [row["island"]], "n_bins": [-n_bins], "fullness": [fullness], "done": [packer.done(best[0])], "population": [_packed(best)], "elite": [_packed(best[:1])]})

        return run

    evolved = None
    for epoch in range(EPOCHS):
        before, evolved = evolved, written(state.repartition(tasks, "block", "island").mapInArrow(evolve(epoch), "block long, island long, n_bins long, fullness double, done boolean, population binary, elite binary"), "evolved")
        if before is not None:
            drop_written(before)
        if not evolved.groupBy("block").agg(F.max("done").alias("done")).where("not done").limit(1).count():
            break
        # each island's elite moves to the next one in the ring
        moving = evolved.select("block", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).cast("long").alias("island"), F.col("elite").alias("guest"))
        state = islands.join(evolved.select("block", "island", "population").join(moving, ["block", "island"]).select("block", "island", F.concat("population", "guest").alias("population")), ["block", "island"])
    best = evolved.groupBy("block").agg(F.max_by("elite", F.struct(-F.col("n_bins"), "fullness", -F.col("island"))).alias("elite"))

    def laid_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths, bins = np.asarray(row["lengths"], np.int64), np.frombuffer(row["elite"], "<i4").astype(np.int64)
                order = np.lexsort((-lengths, bins))
                before = np.cumsum(lengths[order]) - lengths[order]
                first = np.searchsorted(bins[order], bins[order])
                fill = np.bincount(bins, weights=lengths).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.asarray(row["uids"], np.int64)[order]), pa.array(np.full(len(bins), row["block"], np.int64)), pa.array(bins[order]), pa.array(fill[bins[order]]), pa.array(lengths[order]), pa.array(before - before[first])],
                    ["uid", "block", "bin", "fill", "length", "offset"],
                )

    whole = islands.where("island = 0").select("block", "lengths", "uids").join(best, "block")
    packed = written(whole.mapInArrow(laid_out, "uid long, block long, bin long, fill long, length long, offset long"), "packed")
    drop_written(evolved)
    drop_written(islands)
    return packed


def best_fit_packing(documents: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, text: str = "text") -> DataFrame:
    """Packs the token pieces of all documents into as few sequences of `capacity` tokens as it can.

    Only documents longer than `capacity` are cut; a full piece is a sequence of its
    own.  The other pieces are dealt by a hash into blocks of about BLOCK pieces
    (bounded, whatever the data; a hot source or repeated rows spread evenly).  For
    each block, islands evolve populations of packings by grouping crossover with
    repair (exact sets of the displaced pieces, then least slack or best fit) and
    exchange elites, unless a packing has as few bins as any can; bins that stay
    unfilled in a block are pooled and packed again, level by level, until one block
    is left or a level combines nothing more.

    Null text is empty; an empty document is one piece of the end id alone; repeated
    rows are repeated documents; an empty table gives no rows.  Returns doc_id,
    piece, start, length, ids_crc32, sequence_id, offset (gapless from 0).
    """
    cut = written(pieces(documents, path, capacity, end_id, text).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    placed = cut.where(F.col("length") == capacity).select("uid", (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    todo, level = cut.where(F.col("length") < capacity).select("uid", "length"), 0
    n, open_bins = todo.count(), None
    while n:
        packed = _pack_level(todo, n, level, capacity)
        first, unfilled = F.col("offset") == 0, F.col("fill") < capacity
        n_bins, left_bins, left = packed.agg(F.count_if(first), F.count_if(first & unfilled), F.count_if(unfilled)).first()
        last = n <= BLOCK or (open_bins is not None and n_bins >= open_bins)  # one block, or nothing combined any more
        settled = packed if last else packed.where(~unfilled)
        placed = placed.unionByName(settled.select("uid", (F.lit(level << 56) + F.col("block") * (1 << 30) + F.col("bin")).cast("long").alias("sequence_id"), "offset"))
        if last:
            break
        todo = packed.where(unfilled).select("uid", "length")
        n, open_bins, level = left, left_bins, level + 1
    return cut.join(placed, "uid").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
