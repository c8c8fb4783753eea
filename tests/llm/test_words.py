"""Words whose polynomial hashes modulo 2^64 are equal (Thue-Morse words and their complements), and frequent keys."""

import hashlib
import zlib

import numpy as np
import pytest
from test_operators import brute_components, brute_decontamination, docs, ids_of, tokenizer  # noqa: F401


def thue_morse(n, a="a", b="b"):
    return "".join(a if bin(k).count("1") % 2 == 0 else b for k in range(n))


PAIRS = [(thue_morse(n), thue_morse(n, "b", "a")) for n in (1024, 2048)]
TEXTS = [t for p in PAIRS for t in (*p, f"so {p[0]} it is {p[1]}", f"so {p[1]} it is {p[0]}")]


def test_token_files_and_counts_of_colliding_words(spark, tokenizer):  # noqa: F811
    from lorewell.llm.best_fit_packing import best_fit_packing
    from lorewell.llm.token_count import token_count
    from lorewell.llm.token_output import token_output

    df = docs(spark, TEXTS).coalesce(1)
    want = [np.array([*ids_of(tokenizer, t), 1], "<u4") for t in TEXTS]
    assert [(r["n_tokens"], r["ids_crc32"]) for r in token_output(df).orderBy("doc_id").collect()] == [(len(w), zlib.crc32(w.tobytes())) for w in want]
    assert [r["n_tokens"] for r in token_count(df).orderBy("doc_id").collect()] == [len(w) - 1 for w in want]
    assert [r["ids_crc32"] for r in best_fit_packing(df).orderBy("doc_id").collect()] == [zlib.crc32(w.tobytes()) for w in want]


def test_sets_and_windows_of_colliding_words(spark):
    from lorewell.llm.decontamination import decontaminate
    from lorewell.llm.jaccard_join import jaccard_join

    df = docs(spark, TEXTS)
    assert [(r["n_shingles"], r["component_id"]) for r in jaccard_join(df).orderBy("doc_id").collect()] == brute_components(TEXTS)
    items = [(1, PAIRS[0][0]), (2, "it is " + PAIRS[1][1])]
    got = [tuple(r)[1:] for r in decontaminate(df, spark.createDataFrame(items, "item_id long, text string")).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").orderBy("doc_id").collect()]
    assert got == brute_decontamination(TEXTS, items) and sum(r[4] for r in got) == 4 and got[1][3] == hashlib.sha256(b"").hexdigest()


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_spread_join_is_a_join(spark, how):
    from lorewell.llm._shared import spread_join

    rows = spark.createDataFrame([(1, k) for k in range(3000)] + [(k % 700, k) for k in range(2, 5000)] + [(None, 7)], "k long, x long")
    values = spark.createDataFrame([(k, k * k) for k in range(0, 700, 2)] + [(1, 1)], "k long, y long")
    got, want = spread_join(rows, values, ["k"], "x", how), rows.join(values, "k", how)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
