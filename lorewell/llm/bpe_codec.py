"""Byte-level BPE: encoding by tree concatenation, decoding by table."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewell.llm._shared import give_back, ragged, small_batches
from lorewell.llm._tokens import load, tokenizer_path
from lorewell.llm.token_count import NONE, RankMerger

#: Production tokenizer file.
TOKENIZER = "byte_bpe_50k.json"
# Fixed value: how byte-level pre-tokenizers of this kind split a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters outside these blocks may be classed by another version of Unicode than the library's: such texts are split by the library itself.
FAMILIAR = r"[^\x00-ԯ‐-⁤₠-₿ぁ-ヿ一-鿯가-힣]"
#: Bytes of a leaf, tokens on each side of a join in the first window.
LEAF, WINDOW = 32, 4
#: Characters of a text from which it is cut into parts for several tasks.
PART = 1 << 16
#: Bytes of text encoded at a time, bytes of new pieces merged at a time, and pieces and bytes of them that a worker keeps.
SLICE, MERGED, KEPT_PIECES, KEPT_BYTES = 1 << 20, 1 << 18, 250_000, 8 << 20


class TreeEncoder(RankMerger):
    """Byte-pair encoding of pieces of text that pre-tokenization does not split further.

    A piece is cut into leaves, all leaves of all pieces are merged at once, and
    neighbours are joined level by level.  At a join, a window of some tokens on each
    side is encoded again; if its first token is the left side's token there and its
    last one the right side's, then every two adjacent tokens of the joined sequence
    stand as they would alone, which makes it the encoding of the joined bytes (the first merge across
    a border of tokens would be the same among those two alone).  Otherwise the window is doubled."""

    def __init__(self, path: str):
        super().__init__(path)
        spec = json.load(open(path, encoding="utf-8"))
        shown = {int(i): b for b, i in enumerate(self.inner)}
        char = {c: shown[i] for c, i in spec["model"]["vocab"].items() if i in shown}
        table = {i: bytes(char[c] for c in token) for token, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        table |= {i: s.encode() for s, i in self.special.items()}
        rows = [table.get(i, b"") for i in range(max(table) + 1)]
        self.bytes_of = np.frombuffer(b"".join(rows), np.uint8)
        self.length = np.fromiter(map(len, rows), np.int64, len(rows))
        self.begin = np.cumsum(self.length) - self.length

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all ids, one after the other."""
        return self.bytes_of[ragged(self.begin[ids], self.length[ids])]

    def merged(self, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of each sequence of bytes (none empty), laid flat, and their numbers."""
        owner, symbols = np.repeat(np.arange(len(lengths)), lengths), self.inner[data]
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            place = self._find(symbols[:-1] << 20 | symbols[1:])
            rank = np.append(np.where((place >= 0) & (owner[:-1] == owner[1:]), self.rank[place], NONE), NONE)
            begin = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            sizes = np.diff(np.append(begin, len(symbols)))
            least = np.repeat(np.minimum.reduceat(rank, begin), sizes)
            if not (live := least < NONE).all():
                done.append((owner[~live], symbols[~live]))
            where = np.flatnonzero((rank == least) & live)
            # of overlapping pairs of one rank (aaa), every second one from the left
            fresh = np.concatenate([[True], np.diff(where) != 1])[: len(where)]
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(where)), 0))
            where = where[(np.arange(len(where)) - run) % 2 == 0]
            symbols[where] = self.into[place[where]]
            live[where + 1] = False
            symbols, owner = symbols[live], owner[live]
        owner, symbols = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (owner, symbols)
        return symbols[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(lengths))

    def joined(self, flat: np.ndarray, lengths: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Adjacent token sequences with one owner, joined in a tree: the owners' tokens laid flat, and their numbers."""
        while (owner[1:] == owner[:-1]).any():
            new = np.concatenate([[True], owner[1:] != owner[:-1]])
            rank = np.arange(len(owner)) - np.maximum.accumulate(np.where(new, np.arange(len(owner)), 0))
            left = np.flatnonzero((rank[:-1] % 2 == 0) & ~new[1:])
            flat, lengths, owner = self._level(flat, lengths, owner, left)
        return flat, lengths

    def _level(self, flat: np.ndarray, lengths: np.ndarray, owner: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each sequence `left` joined with the one after it."""
        ends = np.cumsum(lengths)
        middle, k = ends[left], np.full(len(left), WINDOW)
        source, size = [flat], len(flat)
        at, n, cut_left, cut_right = (np.zeros(len(left), np.int64) for _ in range(4))  # of each join: where its window's tokens are, how many, and the tokens it replaces on either side
        todo = np.arange(len(left))
        while len(todo):
            a, b = np.minimum(k[todo], lengths[left[todo]]), np.minimum(k[todo], lengths[left[todo] + 1])
            window = flat[ragged(middle[todo] - a, a + b)]
            sizes = np.add.reduceat(self.length[window], np.cumsum(a + b) - (a + b))
            tokens, counts = self.merged(self.decode(window), sizes)
            begin = np.cumsum(counts) - counts
            agree = ((a == lengths[left[todo]]) | (tokens[begin] == flat[middle[todo] - a])) & ((b == lengths[left[todo] + 1]) | (tokens[begin + counts - 1] == flat[middle[todo] + b - 1]))
            at[todo], n[todo], cut_left[todo], cut_right[todo] = size + begin, counts, a, b
            source.append(tokens)
            size += len(tokens)
            todo = todo[~agree]
            k[todo] *= 2
        # kept tokens of each sequence, with the window's after those of a left one
        start, length = ends - lengths, lengths.copy()
        length[left] -= cut_left
        start[left + 1] += cut_right
        length[left + 1] -= cut_right
        starts, sizes = np.zeros(2 * len(lengths), np.int64), np.zeros(2 * len(lengths), np.int64)
        starts[::2], sizes[::2] = start, length
        starts[2 * left + 1], sizes[2 * left + 1] = at, n
        out = np.concatenate(source)[ragged(starts, sizes)]
        total = sizes[::2] + sizes[1::2]
        total[left] += total[left + 1]
        stay = np.ones(len(lengths), bool)
        stay[left + 1] = False
        return out, total[stay], owner[stay]

    def pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of each piece (none empty), laid flat, and their numbers."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        leaves = np.int64(1) << np.ceil(np.log2(np.maximum(1, -(-lengths // LEAF)))).astype(np.int64)  # halves of halves
        owner = np.repeat(np.arange(len(pieces)), leaves)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(leaves) - leaves, leaves)
        bounds = nth * lengths[owner] // leaves[owner]
        sizes = (nth + 1) * lengths[owner] // leaves[owner] - bounds
        flat, counts = self.merged(np.frombuffer(b"".join(pieces), np.uint8), sizes)
        return self.joined(flat, counts, owner)


class Splitter:
    """Texts to pieces (pre-tokens and special strings), and long texts to parts."""

    def __init__(self, path: str, special: dict[str, int]):
        import regex

        self.library = load(path).pre_tokenizer
        self.find = regex.compile(PATTERN).findall
        self.strange = regex.compile(FAMILIAR).search
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
        self.kinds = [(regex.compile(r"\p{L}").match, "L"), (regex.compile(r"\p{N}").match, "N"), (regex.compile(r"\s").match, "S")]

    def split(self, text: str) -> list[str]:
        """The pieces of a text without special strings."""
        if self.strange(text) is None:
            return self.find(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]

    def sections(self, text: str) -> Iterator[tuple[str, bool]]:
        """The text between special strings, and these, which are marked."""
        at = 0
        for m in self.special.finditer(text) if self.special else ():
            if m.start() > at:
                yield text[at : m.start()], False
            yield m.group(), True
            at = m.end()
        if at < len(text):
            yield text[at:], False

    def kind(self, c: str) -> str:
        return "?" if self.strange(c) else next((k for match, k in self.kinds if match(c)), "P")

    def border(self, text: str, p: int) -> str | None:
        """How pieces lie around place p: 'between' two of them, 'inside' one that goes on, or None where more than these characters decide."""
        a, b = self.kind(text[p - 1]), self.kind(text[p])
        if "?" in (a, b) or "'" in text[max(0, p - 3) : p + 1]:
            return None
        if a == b:  # the last white space before a word goes with the word
            return None if a == "S" and p + 1 < len(text) and self.kind(text[p + 1]) != "S" else "inside"
        return None if a == "S" else "between"

    def parts(self, text: str, size: int) -> Iterator[tuple[str, str]]:
        """Parts of about `size` characters of a text, each with how it is joined to the part before: 'between', 'inside', or 'special' where it is a special string."""
        how = "between"
        for section, special in self.sections(text):
            if special:
                yield section, "special"
                how = "between"
                continue
            at = 0
            while at < len(section):
                p, next_how = at + size, None
                while p < len(section) and (next_how := self.border(section, p)) is None:
                    p += 1
                yield section[at:p], how
                at, how = p, next_how or "between"
            how = "between"


class Codec:
    """A worker's encoder with the pieces that it has met."""

    def __init__(self, path: str):
        self.tree = tree_encoder(path)
        self.splitter = Splitter(path, self.tree.special)
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.flat, self.used, self.held = np.zeros(1 << 16, np.uint32), 0, 0
        self.begin, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def rows(self, pieces: list[str]) -> np.ndarray:
        """The place of each piece among those met; new ones are encoded first, all at once."""
        unseen = [p for p in set(pieces) if p not in self.place]
        bounds = np.cumsum(np.fromiter(map(len, unseen), np.int64, len(unseen))) // MERGED
        for new in ([unseen[k] for k in some] for some in np.split(np.arange(len(unseen)), np.flatnonzero(np.diff(bounds)) + 1) if len(some)):
            data = [p.encode() for p in new]
            flat, counts = self.tree.pieces(data)
            if self.used + len(flat) > len(self.flat):
                self.flat = np.concatenate([self.flat[: self.used], np.zeros(max(self.used, len(flat)), np.uint32)])
            self.flat[self.used : self.used + len(flat)] = flat
            self.place.update(zip(new, range(len(self.begin), len(self.begin) + len(new)), strict=True))
            self.begin = np.concatenate([self.begin, self.used + np.cumsum(counts) - counts])
            self.length = np.concatenate([self.length, counts])
            self.used += len(flat)
            self.held += sum(map(len, data))
        return np.fromiter(map(self.place.__getitem__, pieces), np.int64, len(pieces))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if len(self.place) > KEPT_PIECES or self.held > KEPT_BYTES:
            self.clear()
        split, found = self.splitter, []
        for text in texts:
            if split.special and split.special.search(text):
                found.append(list(chain.from_iterable([s] if special else split.split(s) for s, special in split.sections(text))))
                self._keep_special()
            else:
                found.append(split.split(text))
        rows = self.rows(list(chain.from_iterable(found)))
        sizes = self.length[rows]
        ids = self.flat[ragged(self.begin[rows], sizes)]
        bounds = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int64)]
        return [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]

    def _keep_special(self) -> None:
        """A special string is a piece of one id (no other piece looks like it: letters and signs never stand in one)."""
        for s, i in self.tree.special.items():
            if s not in self.place:
                self.flat = np.append(self.flat[: self.used], np.array([i], np.uint32))
                self.place[s] = len(self.begin)
                self.begin, self.length = np.append(self.begin, self.used), np.append(self.length, 1)
                self.used += 1

    def part(self, text: str, special: bool) -> tuple[np.ndarray, int, int]:
        """The ids of a part, and how many of them its first and its last piece have."""
        if special:
            return np.array([self.tree.special[text]], np.uint32), 1, 1
        flat, counts = self.tree.pieces([p.encode() for p in self.splitter.split(text)])
        return flat.astype(np.uint32), int(counts[0]), int(counts[-1])


_trees: dict[str, TreeEncoder] = {}
_codecs: dict[str, Codec] = {}


def tree_encoder(path: str) -> TreeEncoder:
    """The worker's tables of a tokenizer file; all that decoding needs."""
    if path not in _trees:
        _trees[path] = TreeEncoder(path)
    return _trees[path]


def codec(path: str) -> Codec:
    """The worker's codec for a tokenizer file; it outlives tasks where workers are used again."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    lengths = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(lengths, (lengths[i - 1] if i else 0) + SLICE, "right")))
        yield i, j
        i = j


def bpe_encode(documents: DataFrame, path: str | None = None, text: str = "text", part: int = PART, decoded: bool = False) -> DataFrame:
    """(doc_id, ids) of every whole text: the tokenizer's ids without special tokens added, as little-endian unsigned 32-bit integers in a binary.

    Texts are split into pre-tokens; each distinct one is encoded by `TreeEncoder`, in
    leaves that are joined as a tree.  A text of more than `part` characters is cut into parts that
    several tasks encode, and the parts are joined in the same way: a cut lies between
    two pre-tokens, or inside one, whose two sides are then joined by windows.  A
    special token's string is its id, as the library takes it.

    Null and empty texts have no ids; repeated rows, also those with one doc_id, keep
    a row each; an empty table gives no rows; further columns are ignored.  With
    `decoded` the same tasks decode the ids again (column text, as `bpe_decode`).  Texts up to
    `part` characters are a narrow map; of longer ones the text is shuffled by part, and
    the ids by document.  The file must be a byte-level BPE without a normalizer.
    """
    path = path or tokenizer_path(TOKENIZER)
    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = small_batches(documents).select("doc_id", F.coalesce(documents[text].cast("string"), F.lit("")).alias("text"))

    schema = f"doc_id {kind}, ids binary" + ", text string" * decoded

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _decoded(batches, path) if decoded else batches

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for i, j in _slices(batch.column("text")):
                ids = [x.astype("<u4", copy=False).tobytes() for x in own.encode(batch.column("text").slice(i, j - i).to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(ids, pa.binary())], ["doc_id", "ids"])
            give_back()

    short = rows.where(F.length("text") <= part).mapInArrow(lambda batches: finished(encode(batches)), schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = codec(path).splitter
        for batch in batches:
            for k, t in enumerate(batch.column("text")):
                some = list(splitter.parts(t.as_py(), part))
                n = len(some)
                yield pa.RecordBatch.from_arrays([pa.array([batch.column("row")[k].as_py()] * n, pa.int64()), pa.array(batch.column("doc_id").slice(k, 1).to_pylist() * n, batch.schema.field("doc_id").type), pa.array(range(n), pa.int32()), pa.array([x for x, _ in some], pa.string()), pa.array([how for _, how in some], pa.string())], ["row", "doc_id", "part", "text", "how"])

    def encode_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            done = [own.part(t, how == "special") for t, how in zip(batch.column("text").to_pylist(), batch.column("how").to_pylist(), strict=True)]
            ids = pa.array([x.astype("<u4", copy=False).tobytes() for x, _, _ in done], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), batch.column("part"), batch.column("how"), ids, pa.array([a for _, a, _ in done], pa.int64()), pa.array([b for _, _, b in done], pa.int64())], ["row", "doc_id", "part", "how", "ids", "head", "tail"])
            give_back()

    def join(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        flat = concatenated(tree_encoder(path), *(table.column(c).to_pylist() for c in ("ids", "how", "head", "tail")))
        one = pa.table({"doc_id": table.column("doc_id").slice(0, 1), "ids": pa.array([flat.astype("<u4").tobytes()], pa.binary())})
        return pa.Table.from_batches(finished(iter(one.to_batches())))

    # the number names a row of a fixed scan: the same one when a lost task is run again
    long = rows.where(F.length("text") > part).withColumn("row", F.monotonically_increasing_id())
    parts = long.mapInArrow(cut, f"row long, doc_id {kind}, part int, text string, how string").repartition("row", "part")
    ids = parts.mapInArrow(encode_parts, f"row long, doc_id {kind}, part int, how string, ids binary, head long, tail long")
    return short.unionByName(ids.groupBy("row").applyInArrow(join, schema))


def concatenated(tree: TreeEncoder, ids: list[bytes], how: list[str], head: list[int], tail: list[int]) -> np.ndarray:
    """The ids of a text from those of its parts: pieces cut by a border are joined in a tree, all others stay."""
    sequences, owners, owner = [], [], -1
    for k, data in enumerate(ids):
        own = np.frombuffer(data, "<u4").astype(np.int64)
        goes_on = k + 1 < len(ids) and how[k + 1] == "inside"
        first = head[k] if how[k] == "inside" else 0
        if how[k] != "inside":
            owner += 1
        if first == len(own) or (not first and not goes_on):  # one piece, or nothing to join
            sequences.append(own)
            owners.append(owner)
            continue
        last = tail[k] if goes_on else 0
        for some in (own[:first], own[first : len(own) - last], own[len(own) - last :]):
            if len(some):
                sequences.append(some)
                owners.append(owner)
            owner += 1
        owner -= 1 if last else 0
    if not sequences:
        return np.zeros(0, np.int64)
    return tree.joined(np.concatenate(sequences), np.fromiter(map(len, sequences), np.int64, len(sequences)), np.asarray(owners))[0]


def _decoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Batches of doc_id and ids with the text of the ids."""
    tree = tree_encoder(path)
    for batch in batches:
        texts = [tree.decode(np.frombuffer(x or b"", "<u4")).tobytes() for x in batch.column("ids").to_pylist()]
        try:
            column = pa.array(texts, pa.binary()).cast(pa.string())
        except pa.ArrowInvalid:
            column = pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), column], ["doc_id", "ids", "text"])
        del texts, column
        give_back()


def bpe_decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids, text): the text of ids as the library decodes them, special tokens kept; bytes that are no UTF-8 become U+FFFD.  Null ids give an empty text."""
    path = path or tokenizer_path(TOKENIZER)
    kind = encoded.schema["doc_id"].dataType.simpleString()
    return small_batches(encoded).select("doc_id", "ids").mapInArrow(lambda batches: _decoded(batches, path), f"doc_id {kind}, ids binary, text string")


def round_trip(documents: DataFrame, path: str | None = None, text: str = "text", part: int = PART) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every text, encoded and decoded."""
    decoded = bpe_encode(documents, path, text, part, decoded=True)
    return decoded.select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
