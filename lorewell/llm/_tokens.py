"""Tokenizer files applied through a cache of word chunks.

Texts are cut by byte classes into chunks that the tokenizer's own pre-tokenizer
never joins across (white space; changes between ASCII letters, digits and
punctuation).  Each distinct chunk is encoded once per worker and slice, and whole
texts are put together from the chunks' ids with numpy.  Texts that hold one of the
tokenizer's special strings are encoded whole."""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from lorewell.llm._shared import distinct_spans, ragged, spans, text_slices

#: Chunks, and bytes of chunks, kept by a worker before the cache starts anew.
CACHE_CHUNKS, CACHE_BYTES = 400_000, 8 << 20
#: Chunks encoded at a time (the library's results are large while they live).
ENCODED = 8192
#: Single-token words sent to the library as one text.
JOINED = 256

_loaded: dict[str, object] = {}


def tokenizer_path(name: str) -> str:
    """Where the public tokenizer file of this name is installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def load(path: str):
    """The library's tokenizer, once per worker."""
    if path not in _loaded:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _loaded[path] = t
    return _loaded[path]


def chunks(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of the chunks, and for each row the index of its first."""
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    high = raw >= 128
    letter = ((raw | 32) >= 97) & ((raw | 32) <= 122)
    digit = (raw >= 48) & (raw <= 57)
    kind = letter.astype(np.uint8) + digit.astype(np.uint8) * np.uint8(2)
    cut = np.zeros(len(raw), bool)
    # a new chunk where the class of ASCII bytes changes, but not between an apostrophe and a letter ('s) or at other bytes
    cut[1:] = (kind[1:] != kind[:-1]) & ~high[1:] & ~high[:-1] & ~((raw[:-1] == 39) & letter[1:])
    return spans(~space, offsets, cut)


class ChunkCache:
    """From the bytes of a chunk to what `encode` gives for it: its ids, laid out flat."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]):
        self.encode = encode
        self.clear()

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.held = 0
        self.flat, self.used, self.starts, self.lengths = np.zeros(1 << 16, np.uint32), 0, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def lookup(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The cache row of each chunk; unseen ones are encoded first."""
        if not len(starts):
            return np.zeros(0, np.int64)
        if len(self.place) > CACHE_CHUNKS or self.held > CACHE_BYTES:
            self.clear()
        distinct, back = distinct_spans(raw, starts, ends)
        new = [w for w in distinct if w not in self.place]
        if new:
            parts = [self.encode([w.decode("utf-8", "replace") for w in new[k : k + ENCODED]]) for k in range(0, len(new), ENCODED)]
            flat, lengths = (np.concatenate(x) for x in zip(*parts, strict=True))
            if self.used + len(flat) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros(max(len(flat), len(self.flat)), np.uint32)])
            self.flat[self.used : self.used + len(flat)] = flat
            self.place.update(zip(new, range(len(self.starts), len(self.starts) + len(new)), strict=True))
            self.starts = np.concatenate([self.starts, self.used + np.cumsum(lengths) - lengths])
            self.lengths = np.concatenate([self.lengths, lengths])
            self.used += len(flat)
            self.held += sum(map(len, new))
        return np.fromiter(map(self.place.__getitem__, distinct), np.int64, len(distinct))[back]


def _one_word(w: str) -> bool:
    return w.isalpha() and (w.isascii() or unicodedata.normalize("NFC", w).lower().isalpha())


def library_encoder(path: str) -> Callable[[list[str]], tuple[np.ndarray, np.ndarray]]:
    """Encodes chunks by the library; words of letters alone go many to a text, told apart by the ids that end a word."""
    tok = load(path)
    vocab = tok.get_vocab(with_added_tokens=False)
    ends = np.zeros(max(vocab.values()) + 1, bool)
    for piece, i in vocab.items():
        ends[i] = piece.endswith("</w>")
    joinable = bool(ends.any())

    def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        plain = np.fromiter((joinable and _one_word(w) for w in words), bool, len(words))
        lengths = np.zeros(len(words), np.int64)
        where = np.flatnonzero(plain)
        batch = [" ".join(words[k] for k in where[i : i + JOINED].tolist()) for i in range(0, len(where), JOINED)]
        joined = [np.asarray(x.ids, np.uint32) for x in tok.encode_batch_fast(batch, add_special_tokens=False)]
        joined = np.concatenate(joined) if joined else np.zeros(0, np.uint32)
        stops = np.flatnonzero(ends[joined]) + 1
        if len(stops) != len(where):
            raise ValueError("words and word ends differ")
        lengths[where] = np.diff(stops, prepend=0)
        rest = np.flatnonzero(~plain)
        others = [np.asarray(x.ids, np.uint32) for x in tok.encode_batch_fast([words[k] for k in rest.tolist()], add_special_tokens=False)]
        lengths[rest] = [len(x) for x in others]
        flat = np.zeros(int(lengths.sum()), np.uint32)
        begin = np.cumsum(lengths) - lengths
        flat[ragged(begin[where], lengths[where])] = joined
        if others:
            flat[ragged(begin[rest], lengths[rest])] = np.concatenate(others)
        return flat, lengths

    return encode


_caches: dict[tuple, ChunkCache] = {}


def cache_for(kind: str, path: str, make: Callable[[str], Callable]) -> ChunkCache:
    """The worker's cache for a tokenizer file; it outlives tasks where workers are used again."""
    if (kind, path) not in _caches:
        _caches[kind, path] = ChunkCache(make(path))
    return _caches[kind, path]


def folded(raw: np.ndarray, path: str) -> np.ndarray:
    """The bytes with A-Z lowered where the tokenizer lowers all letters itself: fewer distinct chunks, the same ids.

    A letter before a byte of another script stays: a mark there may combine with the small letter, but not with the capital."""
    normalizer = load(path).normalizer
    if normalizer is None or normalizer.normalize_str("AbZ") != "abz" or not len(raw):
        return raw
    capital = (raw >= 65) & (raw <= 90)
    capital[:-1] &= raw[1:] < 128
    return raw + capital.astype(np.uint8) * np.uint8(32)


def special_strings(path: str) -> list[bytes]:
    return [t.content.encode() for t in load(path).get_added_tokens_decoder().values()]


def encoded(texts: pa.Array, path: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For slices of rows: the first row, the slice's ids laid flat, and each row's number of ids."""
    cache = cache_for("library", path, library_encoder)
    special = special_strings(path)
    for i, j, raw, offsets in text_slices(texts):
        starts, ends, first = chunks(raw, offsets)
        rows = cache.lookup(folded(raw, path), starts, ends)
        lens = cache.lengths[rows]
        flat = cache.flat[ragged(cache.starts[rows], lens)]
        bounds = np.concatenate([[0], np.cumsum(lens)])[first]
        data = raw.tobytes()
        if any(s in data for s in special):
            parts = []
            for k in range(j - i):
                own = data[offsets[k] : offsets[k + 1]]
                if any(s in own for s in special):
                    parts.append(np.asarray(load(path).encode(own.decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32))
                else:
                    parts.append(flat[bounds[k] : bounds[k + 1]])
            yield i, np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))
        else:
            yield i, flat, np.diff(bounds)
