"""BPE codec, periodic runs and the filter audit against the library and brute force."""

import base64
import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from test_operators import TRICKY, docs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---- 11
@pytest.fixture(scope="module")
def byte_bpe():
    from lorewell.llm._tokens import load, tokenizer_path

    return load(tokenizer_path("byte_bpe_50k.json"))


def mixed_texts(n, seed=1):
    rng = random.Random(seed)
    parts = ["a", "ab", "the", "A", "23", "'", "'s", "'ll", "re", " ", "  ", "\n", "\t", "!", "...", "é", "日本", "😀", "<|endoftext|>", "<|endo", "　", "ß", "=", "\xa0", "։", "ա", "\x1c", "'re", "\U0001e6c0", "₏"]
    return ["".join(rng.choice(some) * rng.choice([1, 1, 1, 2, 7]) for _ in range(rng.randint(0, 90))) for some in (rng.sample(parts, rng.randint(1, len(parts))) for _ in range(n))]


UNSPLIT = ["a" * 40_001, "ab" * 9001, base64.b64encode(random.Random(3).randbytes(20_000)).decode().replace("+", "x").replace("/", "y"), "=" * 9999, " " * 5000, "日本" * 3000]


def test_bpe_matches_the_library(spark, byte_bpe):
    from lorewell.llm.bpe_codec import bpe_decode, bpe_encode, round_trip

    texts = [*TRICKY, *UNSPLIT, *mixed_texts(300)]
    expected = {k: byte_bpe.encode(t or "", add_special_tokens=False).ids for k, t in enumerate(texts)}
    df = docs(spark, texts)
    for part in (37, 1 << 16):
        got = bpe_decode(bpe_encode(df, part=part)).collect()
        assert len(got) == len(texts)
        for r in got:
            assert np.frombuffer(r["ids"], "<u4").tolist() == expected[r["doc_id"]], texts[r["doc_id"]]
            assert r["text"] == byte_bpe.decode(expected[r["doc_id"]], skip_special_tokens=False) == (texts[r["doc_id"]] or "")
    for r in round_trip(df, part=1000).collect():
        ids = expected[r["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest())


def test_bpe_rows_stay_apart(spark):
    from lorewell.llm.bpe_codec import bpe_decode, bpe_encode

    df = spark.createDataFrame([(1, "x y " * 500, 9), (1, "x y " * 500, 9), (1, "z" * 3000, 9), (None, "q" * 2500, 9), (None, None, 9)], "doc_id long, text string, row long")
    got = sorted(((r["doc_id"], r["text"]) for r in bpe_decode(bpe_encode(df, part=100)).collect()), key=str)
    assert got == sorted(((r["doc_id"], r["text"] or "") for r in df.collect()), key=str)
    assert bpe_encode(df.limit(0)).count() == 0


def test_tree_joins_and_invalid_bytes(byte_bpe):
    from lorewell.llm._tokens import tokenizer_path
    from lorewell.llm.bpe_codec import codec

    own = codec(tokenizer_path("byte_bpe_50k.json"))
    data = [t.encode() for t in UNSPLIT if t[0] not in " "]
    flat, counts = own.tree.pieces(data)
    stops = np.cumsum(counts)
    assert [flat[b - n : b].tolist() for b, n in zip(stops, counts, strict=True)] == [byte_bpe.encode(t.decode(), add_special_tokens=False).ids for t in data]
    broken = [byte_bpe.encode("日", add_special_tokens=False).ids[0], 220]
    assert own.tree.decode(np.array(broken)).tobytes().decode("utf-8", "replace") == byte_bpe.decode(broken, skip_special_tokens=False)


# ---- 12
def brute_runs(words):
    """Every maximal stretch by its definition, its smallest period tested directly."""
    found = set()
    n = len(words)
    for q in range(1, n // 4 + 1):
        same = [words[i] == words[i + q] for i in range(n - q)]
        i = 0
        while i < len(same):
            j = i
            while j < len(same) and same[j]:
                j += 1
            length = j - i + q
            if j > i and length >= max(6, 4 * q) and not any(all(words[x] == words[x + p] for x in range(i, i + length - p)) for p in range(1, q)):
                found.add((i, length, q))
            i = max(j, i + 1)
    gone = {x for s, length, q in found for x in range(s + q, s + length)}
    return sorted(found, key=lambda r: (r[0], r[2])), " ".join(w for k, w in enumerate(words) if k not in gone)


def test_runs_match_brute_force(spark):
    from lorewell.llm.periodic_runs import digests, periodic_runs, planted

    rng = random.Random(5)
    texts = [*TRICKY]
    for _ in range(250):
        words = []
        while len(words) < rng.randint(0, 70):
            block = [rng.choice("abcd"[: rng.randint(1, 4)]) for _ in range(rng.randint(1, 6))]
            words += (block * rng.randint(1, 9))[: rng.randint(1, 40)]
        texts.append(rng.choice(["", " ", "\n"]) + rng.choice([" ", "  ", "\t"]).join(words))
    texts += [("a b c d " * 1200) + "tail", " ".join(f"w{k}" for k in range(3000))]
    df = docs(spark, texts)
    assert sum(planted(k, 5) is not None for k in range(len(texts))) > 10
    for places in (None, planted):
        for r in periodic_runs(df, places=places).collect():
            words = WORD.findall(texts[r["doc_id"]] or "")
            if places and words and (moved := places(r["doc_id"], len(words))) is not None:
                words = [words[k] for k in moved]
            runs, collapsed = brute_runs(words) if len(words) < 1000 else ([(0, 4800, 4)] if not places and "tail" in words else None, None)
            if runs is not None:
                assert [tuple(x) for x in r["runs"]] == runs, texts[r["doc_id"]]
                assert collapsed is None or r["collapsed"] == collapsed
            assert r["n_words"] == len(words)
    by_id = {r["doc_id"]: r for r in periodic_runs(df, places=planted).collect()}
    for r in digests(periodic_runs(df, places=planted)).collect():
        runs = [tuple(x) for x in by_id[r["doc_id"]]["runs"]]
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(by_id[r["doc_id"]]["collapsed"].encode()).hexdigest()
    assert periodic_runs(df.limit(0)).count() == 0
    again = spark.createDataFrame([(7, "x " * 9, 1), (7, "x " * 9, 1), (None, "x " * 9, 1)], "doc_id long, text string, runs int")
    assert [(r["doc_id"], r["collapsed"], len(r["runs"])) for r in periodic_runs(again).collect()] == [(7, "x", 1), (7, "x", 1), (None, "x", 1)]


# ---- 13
def brute_audit(rows, labels):
    known = {d: (any(a == 1 for x, a, _ in labels if x == d), any(b == 1 for x, _, b in labels if x == d)) for d, _, _ in labels if d is not None}
    flags = []
    for d, t, part in rows:
        t = t or ""
        words = WORD.findall(t)
        smaller = any((u or "") == t and d is not None and e is not None and e < d for e, u, _ in rows)
        fails = {x for x, bad in zip("ABCDE", (len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search("[#$%&*|]", t)), smaller), strict=True) if bad}
        flags.append((part or "", fails, *known.get(d, (False, False))))
    out = {}
    for part in {p for p, *_ in flags}:
        own = [f[1:] for f in flags if f[0] == part]
        removed_all = dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone, left = [x for x in left if f in x[0]], [x for x in left if f not in x[0]]
                removed_all[f] += len(gone)
                out[part, order, step] = [len(left), len(gone), sum(f in x[0] for x in own) - len(gone), sum(x[0] == {f} for x in own), sum(x[1] for x in gone), sum(x[2] for x in gone)]
        for (p, order, step), x in out.items():
            if p == part:
                x.append(removed_all[order[step - 1]])
    return out


def test_audit_matches_brute_force(spark):
    from lorewell.llm.filter_audit import filter_audit

    rng = random.Random(2)
    words = ["word", "Other", "THIRD", "über", "a#b", *(f"w{k}" for k in range(200))]
    texts = [None, "", "  ", "x " * 60, "ÀÉ" * 40, *(" ".join(rng.choices(words[rng.randint(0, 5) :], k=rng.randint(30, 90))) for _ in range(60))]
    rows = [(d, rng.choice(texts), rng.choice([None, "", "s1", "s2"])) for d in [*range(150), None, None, 7, 7]]
    rows += [(d, None, "all null") for d in range(200, 270)]
    labels = [(d, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for d in [*range(0, 150, 2), 4, 4, None]]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, bits int, part string")
    known = spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, part string")
    got = filter_audit(df, known)
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {(r["part"], r["filter_order"], r["step"]): [r[c] for c in names] for r in got.collect()} == brute_audit(rows, labels)
    assert got.count() == 600 * 4
    assert filter_audit(df.limit(0), known).count() == 0
    assert filter_audit(df, known.limit(0)).agg({"good_lost": "sum"}).first()[0] == 0


def test_bitmap_blocks_sum_up(spark, monkeypatch):
    from lorewell.llm import filter_audit

    df = spark.createDataFrame([(k, "A b # " * (k % 30), f"s{k % 70}") for k in range(3000)], "doc_id long, text string, source string").repartition(3)
    known = spark.createDataFrame([(k, k % 2, k % 3 == 0) for k in range(0, 3000, 5)], "doc_id long, quality int, toxic boolean").selectExpr("doc_id", "quality", "int(toxic) AS toxic")
    whole = sorted(map(tuple, filter_audit.filter_audit(df, known).collect()))
    monkeypatch.setattr(filter_audit, "INDEXED", 100)
    assert sorted(map(tuple, filter_audit.filter_audit(df, known).collect())) == whole and len(whole) == 600 * 70
