"""Language ID by a bidirectional gated recurrent network over bytes, trained in numpy."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorewell.llm._shared import small_batches, text_slices

#: Units of each direction, and bytes after which the state starts anew.
UNITS, SPAN = 8, 96
#: The bounded training sample: documents of each language, and spans of each document.
DOCS_PER_LANGUAGE, SPANS_PER_DOC = 256, 8
#: Places of the hash order from which the sample is drawn, and how many times the sample is looked at.
PLACES, MARGIN = 1 << 24, 8
#: Training: passes over the sample, spans of a batch, step size.
PASSES, BATCH, STEP = 4, 128, 0.02
#: Spans that are labelled at a time.
LABELLED = 4096
UNKNOWN = "und"


def soft(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|): the squashing function (its slope is (1 - |soft|)^2)."""
    d = np.abs(x)
    d += 1
    return np.divide(x, d, out=d)


class Direction:
    """A gated recurrent layer over byte columns; states are (units, spans)."""

    def __init__(self, rng: np.random.Generator, units: int = UNITS):
        self.units = units
        self.w = (rng.standard_normal((256, 3 * units)) * 0.3).astype(np.float32)
        self.u = (rng.standard_normal((3 * units, units)) / np.sqrt(units)).astype(np.float32)

    def gates(self, x: np.ndarray, h: np.ndarray):
        k = self.units
        g = np.take(self.w, x, axis=0).T
        u = self.u @ h
        zr = soft(g[: 2 * k] + u[: 2 * k])
        zr += 1
        zr *= 0.5
        n = soft(g[2 * k :] + zr[k:] * u[2 * k :])
        return zr, u[2 * k :], n, n + zr[:k] * (h - n)

    def states(self, xs: np.ndarray, keep: bool = False):
        """States after each step of xs (steps, spans); with `keep`, also what the backward pass needs."""
        h = np.zeros((self.units, xs.shape[1]), np.float32)
        out, kept = np.empty((len(xs), self.units, xs.shape[1]), np.float32), []
        for t, x in enumerate(xs):
            zr, c, n, new = self.gates(x, h)
            if keep:
                kept.append((zr, c, n, h))
            out[t] = h = new
        return out, kept

    def backward(self, xs: np.ndarray, kept: list, d_out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of w and u by backpropagation through time."""
        k = self.units
        d_g = np.empty((len(xs), 3 * k, xs.shape[1]), np.float32)
        d_u, d_h = np.zeros_like(self.u), np.zeros_like(d_out[0])
        for t in range(len(xs) - 1, -1, -1):
            zr, c, n, h = kept[t]
            d = d_h + d_out[t]
            z, r = zr[:k], zr[k:]
            d_n = d * (1 - z) * (1 - np.abs(n)) ** 2
            d_c = d_n * r
            d_z = d * (h - n) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
            d_r = d_n * c * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
            through = np.concatenate([d_z, d_r, d_c])
            d_g[t, :k], d_g[t, k : 2 * k], d_g[t, 2 * k :] = d_z, d_r, d_n
            d_u += through @ h.T
            d_h = d * z + self.u.T @ through
        flat, values = xs.ravel(), d_g.transpose(1, 0, 2).reshape(3 * k, -1)
        return np.stack([np.bincount(flat, weights=v, minlength=256) for v in values], axis=1).astype(np.float32), d_u


class ByteTagger:
    """Labels every byte with the probabilities of the learned languages, seeing the bytes on both sides."""

    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.ahead, self.back = Direction(rng), Direction(rng)
        self.v = (rng.standard_normal((len(languages), 2 * UNITS)) * 0.3).astype(np.float32)
        self.b = np.zeros((len(languages), 1), np.float32)

    def probabilities(self, xs: np.ndarray, keep: bool = False):
        """(steps, languages, spans)."""
        f, kept_f = self.ahead.states(xs, keep)
        b, kept_b = self.back.states(xs[::-1], keep)
        logits = self.v[:, :UNITS] @ f + self.v[:, UNITS:] @ b[::-1] + self.b
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        return (logits, f, b, kept_f, kept_b) if keep else logits

    def train(self, spans: np.ndarray, lengths: np.ndarray, labels: np.ndarray, seed: int = 11) -> None:
        """Adam on the mean cross-entropy of every byte's label."""
        rng = np.random.default_rng(seed)
        weights = [self.ahead.w, self.ahead.u, self.back.w, self.back.u, self.v, self.b]
        first, second, step = [np.zeros_like(x) for x in weights], [np.zeros_like(x) for x in weights], 0
        inside = np.arange(spans.shape[1])[:, None] < lengths[None, :]
        total = max(1, PASSES * (-(-len(spans) // BATCH)))
        for _ in range(PASSES):
            for part in np.array_split(rng.permutation(len(spans)), -(-len(spans) // BATCH)):
                xs, mask = np.ascontiguousarray(spans[part].T), inside[:, part]
                p, f, b, kept_f, kept_b = self.probabilities(xs, keep=True)
                p[:, labels[part], np.arange(len(part))] -= 1
                p *= (mask / max(1, mask.sum()))[:, None, :].astype(np.float32)
                d_v = np.concatenate([np.einsum("tcn,thn->ch", p, f), np.einsum("tcn,thn->ch", p, b[::-1])], axis=1)
                d_wf, d_uf = self.ahead.backward(xs, kept_f, self.v[:, :UNITS].T @ p)
                d_wb, d_ub = self.back.backward(xs[::-1], kept_b, (self.v[:, UNITS:].T @ p)[::-1])
                step += 1
                rate = STEP * (1 - (step - 1) / total) + 1e-4
                for w, g, m, s in zip(weights, (d_wf, d_uf, d_wb, d_ub, d_v, p.sum(axis=(0, 2))[:, None]), first, second, strict=True):
                    m += 0.1 * (g - m)
                    s += 0.01 * (g * g - s)
                    w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)

    def pooled(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For each row of bytes the mean probabilities over all its bytes (rows, languages)."""
        sizes = np.diff(offsets)
        spans = -(-sizes // SPAN)
        owner = np.repeat(np.arange(len(sizes)), spans)
        begin = offsets[:-1][owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(spans) - spans, spans)) * SPAN
        length = np.minimum(offsets[1:][owner] - begin, SPAN)
        padded = np.concatenate([raw, np.zeros(SPAN, np.uint8)])
        total = np.zeros((len(sizes), len(self.languages)))
        steps = np.arange(SPAN)[:, None]
        for a in range(0, len(owner), LABELLED):
            some = slice(a, a + LABELLED)
            inside = steps < length[None, some]
            p = self.probabilities(np.where(inside, padded[begin[None, some] + steps], 0))
            np.add.at(total, owner[some], np.einsum("tcn,tn->nc", p, inside.astype(np.float32)))
        return total / np.maximum(sizes, 1)[:, None]


def fold(doc_id: Column) -> Column:
    """crc32 of the doc_id as text, modulo 4; remainder 2 is held out (a null doc_id counts as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4


def training_spans(documents: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE, text: str = "text") -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """The bounded labelled sample: languages, spans (rows of SPAN bytes), their lengths and labels.

    Of each language the `docs_per_language` labelled training documents first in a hash order of
    doc_id; of each of these SPANS_PER_DOC spans at places drawn from its content."""
    rows = documents.where((fold(F.col("doc_id")) != 2) & F.col("lang").isNotNull() & F.col(text).isNotNull() & (F.col(text) != ""))
    rows = rows.select("doc_id", "lang", F.col(text).alias("text"), F.pmod(F.xxhash64("doc_id"), F.lit(PLACES)).alias("place"), F.xxhash64(F.lit(1), F.col(text)).alias("own"))
    # only places so low that about MARGIN times the sample lies below them are compared, so that no task meets all of a language
    sizes = F.broadcast(rows.groupBy("lang").agg(F.count("*").alias("size")))
    low = rows.select("lang", "place", "doc_id", "own").join(sizes, "lang").where(F.col("place") * F.col("size") < MARGIN * docs_per_language * PLACES)
    order = Window.partitionBy("lang").orderBy("place", "doc_id", "own")
    picked = low.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= docs_per_language).select("lang", "doc_id", "own").distinct()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, parts = [], []
            for lang, t in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                data = t.encode()
                rng = np.random.default_rng(zlib.crc32(data))
                for at in rng.integers(0, max(1, len(data) - SPAN + 1), 1 if len(data) <= SPAN else SPANS_PER_DOC).tolist():
                    langs.append(lang)
                    parts.append(data[at : at + SPAN])
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(parts, pa.binary())], ["lang", "part"])

    # the sample is at most docs_per_language rows of each language, so it may be broadcast
    # (a repeated row is drawn once)
    own = rows.join(F.broadcast(picked), ["lang", "doc_id", "own"]).dropDuplicates(["lang", "doc_id", "own"])
    found = own.select("lang", "text").mapInArrow(cut, "lang string, part binary").orderBy("lang", "part").collect()
    languages = sorted({r["lang"] for r in found})
    spans = np.zeros((len(found), SPAN), np.uint8)
    for k, r in enumerate(found):
        spans[k, : len(r["part"])] = np.frombuffer(r["part"], np.uint8)
    return languages, spans, np.array([len(r["part"]) for r in found], np.int64), np.array([languages.index(r["lang"]) for r in found], np.int64)


def train(documents: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE, text: str = "text") -> ByteTagger:
    languages, spans, lengths, labels = training_spans(documents, docs_per_language, text)
    model = ByteTagger(languages)
    if len(languages) > 1:
        model.train(spans, lengths, labels)
    return model


def labelled(texts: pa.Array, model: ByteTagger) -> tuple[np.ndarray, np.ndarray]:
    """The best language (past the last: none) and its probability for each text."""
    best, score = np.full(len(texts), len(model.languages)), np.zeros(len(texts))
    for i, j, raw, offsets in text_slices(texts):
        letters = np.concatenate([[0], np.cumsum(((raw | 32) >= 97) & ((raw | 32) <= 122))])
        some = letters[offsets[1:]] > letters[offsets[:-1]]
        for k in np.flatnonzero(~some & (np.diff(offsets) > 0)).tolist():
            some[k] = any(map(str.isalpha, raw[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "replace")))
        if model.languages and some.any():
            p = model.pooled(raw, offsets)
            best[i:j] = np.where(some, p.argmax(axis=1), len(model.languages))
            score[i:j] = np.where(some, np.clip(p.max(axis=1), 0, 1), 0)
    return best, score


def predict(documents: DataFrame, model: ByteTagger, text: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred and score of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.languages, UNKNOWN], object)
        for batch in batches:
            best, score = labelled(batch.column("text"), model)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names[best].tolist(), pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    rows = small_batches(documents).select(documents["doc_id"].alias("doc_id"), (fold(documents["doc_id"]) == 2).alias("held_out"), documents[text].alias("text"))
    kind = dict(documents.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def keep_languages(documents: DataFrame, keep: Callable[[str, float], bool], docs_per_language: int = DOCS_PER_LANGUAGE, text: str = "text") -> DataFrame:
    """The whole rows whose predicted language and score `keep` accepts, all columns as they are, without a shuffle.

    The network is trained as in language_id; texts that are null or have no letter
    are offered as 'und' with score 0."""
    model = train(documents, docs_per_language, text)
    place = documents.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*model.languages, UNKNOWN]
        for batch in batches:
            best, score = labelled(batch.column(place), model)
            yield batch.filter(pa.array([keep(names[b], float(s)) for b, s in zip(best.tolist(), score.tolist(), strict=True)], pa.bool_()))

    return small_batches(documents).mapInArrow(run, documents.schema)


def language_id(documents: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE, text: str = "text") -> DataFrame:
    """Predicts the language of every whole text from its bytes alone.

    A network of two gated recurrent directions (its state starts anew every SPAN
    bytes) is trained on the driver by backpropagation through time, on a bounded
    sample of training documents (see training_spans); then every byte of every text
    gets probabilities, and a document's are their mean.  Texts that are null or have
    no letter are 'und' with score 0, and so is every text when there is no labelled
    row; repeated rows are predicted alike; an empty table gives no rows.  Returns
    doc_id, held_out, lang_pred, score.  Prediction is a narrow map without shuffle.
    """
    return predict(documents, train(documents, docs_per_language, text), text)
