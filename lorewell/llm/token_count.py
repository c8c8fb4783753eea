"""Token counts by rank-synchronous array merging."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lorewell.llm._shared import small_batches, text_slices
from lorewell.llm._tokens import cache_for, chunks, folded, load, special_strings, tokenizer_path

#: Production tokenizer file and limit.
TOKENIZER, LIMIT = "word_bpe_49k.json", 2048
#: No pair.
NONE = np.int64(1) << np.int64(40)


class RankMerger:
    """Byte-pair merging of many symbol sequences at once.

    Sequences lie one after the other in one flat array with an owner for each
    symbol.  A round ranks every adjacent pair inside a sequence, finds each
    sequence's lowest rank, merges all (leftmost, non-overlapping) pairs of that
    rank in every sequence, and closes the gaps; sequences without a ranked pair
    are done."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        vocab = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        left = np.fromiter((vocab[a] for a, _ in merges), np.int64, len(merges))
        right = np.fromiter((vocab[b] for _, b in merges), np.int64, len(merges))
        into = np.fromiter((vocab[a + b] for a, b in merges), np.int64, len(merges))
        keys = left << 20 | right
        order = np.argsort(keys, kind="stable")
        self.rank, self.into = order.astype(np.int64), into[order]
        self.bits = 21
        self.table = np.full(1 << self.bits, -1, np.int32)  # open addressing; the pair's place in `keys`
        self.keys = keys[order]
        todo, at = np.arange(len(keys)), self._slot(self.keys)
        while len(todo):
            free = self.table[at] < 0
            self.table[at[free]] = todo[free]
            lost = self.table[at] != todo
            todo, at = todo[lost], (at[lost] + 1) & ((1 << self.bits) - 1)
        # Byte-level alphabets show printable bytes as themselves and the others from U+0100 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(shown)]
        char = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}
        self.inner = np.array([vocab.get(char[b], -1) for b in range(256)], np.int64)
        self.final = np.array([vocab.get(char[b] + self.suffix, -1) for b in range(256)], np.int64)
        if (self.inner < 0).any() or (self.final < 0).any():
            raise ValueError("the tokenizer's alphabet does not hold every byte")

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each pair in `keys`, or -1."""
        at = self._slot(keys)
        got = self.table[at].astype(np.int64)
        todo = np.flatnonzero((got >= 0) & (self.keys[got] != keys))
        while len(todo):
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            got[todo] = self.table[at[todo]]
            todo = todo[(got[todo] >= 0) & (self.keys[got[todo]] != keys[todo])]
        return got

    def counts(self, data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Symbols that survive in each sequence of bytes."""
        out = lengths.astype(np.int64).copy()
        owner = np.repeat(np.arange(len(lengths)), lengths)
        symbols = self.inner[data]
        last = np.cumsum(lengths) - 1
        last = last[lengths > 0]
        symbols[last] = self.final[data[last]]
        while len(symbols) > 1:
            place = self._find(symbols[:-1] << 20 | symbols[1:])
            rank = np.where((place >= 0) & (owner[:-1] == owner[1:]), self.rank[place], NONE)
            rank = np.append(rank, NONE)
            begin = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            least = np.minimum.reduceat(rank, begin)
            sizes = np.diff(np.append(begin, len(symbols)))
            live = least < NONE
            done = begin[~live]
            out[owner[done]] = sizes[~live]
            if not live.any():
                return out
            keep = np.repeat(live, sizes)
            chosen = (rank == np.repeat(least, sizes)) & keep
            # runs of overlapping pairs (aaa): every second one, from the left
            where = np.flatnonzero(chosen)
            fresh = np.concatenate([[True], np.diff(where) != 1])
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(where)), 0))
            where = where[(np.arange(len(where)) - run) % 2 == 0]
            symbols[where] = self.into[place[where]]
            keep[where + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        if len(symbols):
            out[owner] = 1
        return out


def chunk_counter(path: str):
    """For chunks of text, their token counts by `RankMerger` (as one id each, the count, for the chunk cache)."""
    import regex

    tok, merger = load(path), RankMerger(path)
    spec = json.load(open(path, encoding="utf-8"))
    pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
    split = regex.compile(pattern)

    def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        pieces, owners = [], []
        for k, w in enumerate(words):
            if w.isascii():
                w = w.lower()
                if w.isalpha():
                    pieces.append(w)
                    owners.append(k)
                    continue
            else:
                w = tok.normalizer.normalize_str(w)
            found = split.findall(w)
            pieces += found
            owners += [k] * len(found)
        data = [p.encode() for p in pieces]
        counts = merger.counts(np.frombuffer(b"".join(data), np.uint8), np.fromiter(map(len, data), np.int64, len(data)))
        total = np.bincount(np.asarray(owners, np.int64), weights=counts, minlength=len(words))
        return total.astype(np.uint32), np.ones(len(words), np.int64)

    return encode


def _merged(raw: np.ndarray, offsets: np.ndarray, cache, path: str) -> np.ndarray:
    """Tokens of each row of bytes that holds no special string."""
    starts, ends, first = chunks(raw, offsets)
    rows = cache.lookup(folded(raw, path), starts, ends)
    each = cache.flat[cache.starts[rows]].astype(np.int64)
    return np.diff(np.concatenate([[0], np.cumsum(each)])[first])


def _around_special(raw: np.ndarray, offsets: np.ndarray, special: re.Pattern, cache, path: str) -> np.ndarray:
    """Tokens of each row: one for each special string, and those of the text between them."""
    out = np.zeros(len(offsets) - 1, np.int64)
    parts: list[bytes] = []
    owner: list[int] = []
    for k in range(len(out)):
        found = special.split(raw[offsets[k] : offsets[k + 1]].tobytes())
        out[k] = len(found) - 1
        parts += found
        owner += [k] * len(found)
    counts = _merged(np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64), cache, path)
    np.add.at(out, owner, counts)
    return out


def token_count(documents: DataFrame, path: str | None = None, limit: int = LIMIT, text: str = "text") -> DataFrame:
    """Tokens of every whole text, as the tokenizer's library counts them without special tokens.

    Pre-tokens are held as ragged numpy arrays and merged rank-synchronously; each
    distinct chunk of text is merged once per worker.  A special token's string is one
    token, as the library takes it, and parts the text around it.  Null and empty texts have 0
    bytes and 0 tokens, repeated rows are counted alike, an empty table gives no rows.  Returns doc_id, n_bytes (UTF-8), n_tokens, over_limit
    (n_tokens > limit).  A narrow map: no shuffle, memory bounded by a slice of
    text (a longer text is taken alone) and the chunk cache.
    """
    path = path or tokenizer_path(TOKENIZER)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, strings = cache_for("count", path, chunk_counter), special_strings(path)
        special = re.compile(b"|".join(re.escape(x) for x in sorted(strings, key=len, reverse=True))) if strings else None
        for batch in batches:
            n_bytes, n_tokens = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for i, j, raw, offsets in text_slices(batch.column("text")):
                n_tokens[i:j] = _merged(raw, offsets, cache, path)
                n_bytes[i:j] = np.diff(offsets)
                if special and special.search(raw.tobytes()):
                    n_tokens[i:j] += _around_special(raw, offsets, special, cache, path) - n_tokens[i:j]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_bytes), pa.array(n_tokens), pa.array(n_tokens > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = small_batches(documents).select("doc_id", documents[text].alias("text"))
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
