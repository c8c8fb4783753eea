"""Hand-computed fixtures of the loading, profile, ranking and evaluation rules."""

import math
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorewell.operators import evaluation, loading, profiles, scoring
from lorewell.operators import statistics as S
from lorewell.plans import app, enrichment, models
from lorewell.sources.interactions import read_csv_safely, read_interactions, read_items, read_targets, with_columns
from lorewell.sources.sinks import append_feedback, write_submission

DAY = 86400


def ix(spark, rows):
    return spark.createDataFrame(rows, "u long, i long, t long")


def test_split_keeps_last_fifth_for_validation(spark):
    got = {r["t"]: (round(r["r"], 6), r["is_train"]) for r in loading.time_split(ix(spark, [(1, k, k) for k in range(1, 6)])).collect()}
    assert got == {1: (0.2, True), 2: (0.4, True), 3: (0.6, True), 4: (0.8, False), 5: (1.0, False)}


def test_split_single_time_and_ties(spark):
    assert loading.train_part(ix(spark, [(1, 5, 9)])).count() == 0
    assert sorted(r["i"] for r in loading.train_part(ix(spark, [(1, 1, 1), (1, 2, 1), (1, 3, 2)])).collect()) == [1, 2]


def test_decay_sums_repeats_and_keeps_zero_weights(spark):
    got = {r["i"]: r["w"] for r in profiles.decayed(ix(spark, [(1, 1, 0), (1, 2, DAY), (1, 1, DAY)]), 1).collect()}
    assert got[1] == pytest.approx(1.5) and got[2] == pytest.approx(1.0)
    far = profiles.decayed(ix(spark, [(1, 1, 0), (1, 2, 1100 * DAY)]), 1)
    assert {r["i"]: r["w"] for r in far.collect()} == {1: 0.0, 2: 1.0}
    x = profiles.tfidf(far, 1)
    assert {r["i"]: r["x"] for r in x.collect()} == {1: 0.0, 2: pytest.approx(1.0)}
    assert {(r["i"], r["j"]): r["s"] for r in profiles.item_similarity(x).collect()}[1, 2] == 0.0


def test_tfidf_by_hand(spark):
    w = spark.createDataFrame([(1, 1, 1.0), (1, 2, 2.0), (2, 1, 1.0)], "u long, i long, w double")
    a, b = 1.0 * (math.log(4 / 3) + 1), 2.0 * (math.log(4 / 2) + 1)
    got = {(r["u"], r["i"]): r["x"] for r in profiles.tfidf(w, 3).collect()}
    assert got[1, 1] == pytest.approx(a / math.hypot(a, b)) and got[2, 1] == pytest.approx(1.0)


def test_bm25_mean_length_counts_empty_users(spark):
    w = spark.createDataFrame([(1, 1, 2.0)], "u long, i long, w double")
    want = 2.0 * 2.2 / (2.0 + 1.2 * (0.25 + 0.75 * 2.0 / (2.0 / 4))) * math.log(1 + 3.5 / 1.5)
    assert profiles.bm25(w, 4).first()["x"] == pytest.approx(want)


def test_transitions_keep_loops(spark):
    got = {(r["i"], r["next_i"]): r["score"] for r in profiles.transitions(ix(spark, [(1, 1, 1), (1, 2, 2), (1, 1, 3), (1, 1, 4)])).collect()}
    assert got == {(1, 2): pytest.approx(math.log(2)), (2, 1): pytest.approx(math.log(2)), (1, 1): pytest.approx(math.log(2))}


def test_average_precision(spark):
    pred = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 3, 3), (2, 4, 1), (2, 5, 2), (2, 6, 3), (3, 1, 1)], "u long, i long, rank int")
    truth = spark.createDataFrame([(1, 2), (1, 9), (1, 2), (2, 4), (2, 6), (2, 7), (2, 8)], "u long, i long")
    got = {r["u"]: r["ap"] for r in evaluation.average_precision(pred, truth, 3).collect()}
    assert got == {1: pytest.approx(0.25), 2: pytest.approx((1 + 2 / 3) / 3)}
    assert evaluation.map_at_k(pred, truth.limit(0), 3).first()["map_at_k"] is None


def test_author_cap_and_refill(spark):
    rows = [(1, i, r, 1.0 / r) for r, i in enumerate([10, 11, 12, 13, 14, 15], 1)]
    cand = spark.createDataFrame(rows, "u long, i long, rank int, score double")
    authors = spark.createDataFrame([(10, "A"), (11, "A"), (12, "A"), (13, None), (14, "Unknown"), (15, None)], "i long, Author string")
    got = [r["i"] for r in models.diversify(cand, authors, 5).orderBy("rank").collect()]
    assert got == [10, 11, 13, 14, 15]
    assert [r["i"] for r in models.diversify(cand, authors, 6).orderBy("rank").collect()][-1] == 12


def test_padding_zero_outranks_negative(spark):
    top = spark.createDataFrame([(1, 5, 1, 0.5), (1, 6, 2, -0.5)], "u long, i long, rank int, score double")
    users = spark.createDataFrame([(1,), (2,)], "u long")
    items = spark.createDataFrame([(k,) for k in range(1, 8)], "i long")
    got = {u: [r["i"] for r in scoring.padded(top, users, items, 3).where(F.col("u") == u).orderBy("rank").collect()] for u in (1, 2)}
    assert got == {1: [5, 1, 2], 2: [1, 2, 3]}


def _data(spark):
    rows = [(u, (u * 7 + k * k) % 11, k * DAY * (1 + u % 3)) for u in range(12) for k in range(1, 9)]
    full = ix(spark, rows).distinct()
    items = spark.createDataFrame([(i, f"title{i % 4} word{i}", f"au{i % 3}", "fiction") for i in range(11)], "i long, Title string, Author string, Subjects string")
    vectors = spark.createDataFrame([(i, [math.cos(i), math.sin(i)]) for i in range(11)], "i long, e array<double>")
    return models.Data(loading.train_part(full), full, full, items, vectors), full


def test_block_and_join_scores_agree(spark):
    data, _ = _data(spark)
    m = models.CosineRecommender(30).fit(data)
    blocks = {(r["u"], r["rank"]): (r["i"], r["score"]) for r in m.predict(5).collect()}
    scores = scoring.join_scores(m.x, profiles.item_similarity(m.x))
    joins = {(r["u"], r["rank"]): (r["i"], r["score"]) for r in scoring.padded(scoring.top_k(scores, 5), data.users, data.items, 5).collect()}
    assert blocks == joins and len(blocks) == data.n_users * 5


@pytest.mark.parametrize("k", [5, 11])
def test_block_and_join_scores_agree_with_seen_items(spark, monkeypatch, k):
    data, full = _data(spark)
    sparse = ix(spark, [(20, 0, 1), (20, 1, 2), *[(21, i, i) for i in range(9)]])
    data = models.Data(data.train.unionByName(sparse), full.unionByName(sparse).unionByName(ix(spark, [(22, 0, 0)])), full)
    m = models.HistoryFilterRecommender(30).fit(data)
    listed = lambda df: sorted((r["u"], r["rank"], r["i"], r["score"]) for r in df.collect())
    blocks = listed(m.predict(k))
    monkeypatch.setattr(scoring, "cosine_side", lambda *a, **b: None)
    assert listed(m.predict(k)) == blocks and len(blocks) == data.n_users * k
    assert [r[2] for r in blocks if r[0] == 22][:3] == [0, 1, 2]
    assert [r[2] for r in blocks if r[0] == 21 and r[3] > -math.inf] == [9, 10] or k == 11


def test_production_score_against_dense_arithmetic(spark):
    import numpy as np

    data, _ = _data(spark)
    m = models.semantic_hybrid(half_lives=(1, 250), factors=4).fit(data)
    got = {(r["u"], r["i"]): r["score"] for r in m.predict(11).collect()}
    users, items = sorted({u for u, _ in got}), list(range(11))
    dense = lambda df, v: np.array([[{(r["u"], r["i"]): r[v] for r in rows}.get((u, i), 0.0) for i in items] for u in users]) if (rows := df.collect()) is not None else None
    x = [dense(m.profiles[f"x{k}"], "x") for k in (0, 1)]
    unit = lambda a, axis: np.divide(a, np.linalg.norm(a, axis=axis, keepdims=True), out=np.zeros_like(a), where=np.linalg.norm(a, axis=axis, keepdims=True) > 0)
    cos = [unit(a, 0).T @ unit(a, 0) for a in x]
    e = np.array([[math.cos(i), math.sin(i)] for i in items])
    total = sum(0.5 * (0.5 * a @ s + 0.5 * a @ (e @ e.T)) for a, s in zip(x, cos, strict=True))
    r = dense(data.train.groupBy("u", "i").agg(F.log1p(F.count("*")).alias("r")), "r")
    u, s, vt = np.linalg.svd(r, full_matrices=False)
    p, q = unit(u[:, :4] * np.sqrt(s[:4]), 1), unit(vt[:4].T * np.sqrt(s[:4]), 1)
    total += 0.15 * (p @ q.T + 1) / 2 + 0.5 * x[1]
    total += 0.2 * x[1].sum(axis=0) / x[1].sum(axis=0).max()
    words = {(t["i"], t["term"]): t["x"] for t in models.keyword_tfidf(data.metadata, models.soup(F.col("Title"), F.col("Author"), F.col("Subjects"))).collect()}
    terms = sorted({t for _, t in words})
    k = np.array([[words.get((i, t), 0.0) for t in terms] for i in items])
    total += 0.15 * x[1] @ (k @ k.T)
    t = np.zeros((11, 11))
    for row in profiles.transitions(data.train).collect():
        t[row["i"], row["next_i"]] = row["score"]
    total += 0.3 * x[0] @ t
    assert max(abs(got[uu, i] - total[a, i]) for a, uu in enumerate(users) for i in items) < 2e-6


def test_every_model_gives_k_rows(spark):
    data, full = _data(spark)
    for name, make in models.MODELS.items():
        got = make().fit(data).predict(4).groupBy("u").count().collect()
        assert {r["count"] for r in got} == {4} and len(got) == data.n_users, name


def test_history_comes_last(spark):
    data, _ = _data(spark)
    seen = {(r["u"], r["i"]) for r in data.train.select("u", "i").collect()}
    rows = models.HistoryFilterRecommender(30).fit(data).predict(11).collect()
    for u in {r["u"] for r in rows}:
        flags = [(u, r["i"]) in seen for r in sorted((r for r in rows if r["u"] == u), key=lambda r: r["rank"])]
        assert flags == sorted(flags)


def test_enrichment_parses_and_keeps_what_is_there(spark):
    items = spark.createDataFrame([(1, "T", "A", "old", None, None), (2, "T2", None, None, None, None), (3, "x", "y", None, None, None)], "i long, Title string, Author string, description string, clean_author string, category string")

    def client(prompt):
        if "ID:3" in prompt:
            raise RuntimeError("no answer")
        return '{"items": [{"id": "2", "desc": "first", "auth": "B", "cat": "C"}, {"id": "x", "desc": "bad"}, {"id": "2", "desc": "last", "auth": "B2", "cat": "C2"}]}'

    got = {r["i"]: (r["description"], r["clean_author"]) for r in enrichment.enrich(items, client, size=1).collect()}
    assert got == {1: ("old", None), 2: ("last", "B2"), 3: (None, None)}


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "ix.csv").write_text("u,i,t\n1,2,3\n1,2,3\n1,2,4\n")
    (tmp_path / "items.csv").write_text("i,Title,Author\n2,A,\n")
    (tmp_path / "targets.csv").write_text("user_id\n5\n1\n5\n")
    inter = read_interactions(spark, f"{tmp_path}/ix.csv")
    assert inter.count() == 2
    assert read_items(spark, f"{tmp_path}/items.csv").first().asDict() == {"i": 2, "Title": "A", "Author": "", "Subjects": "", "Publisher": ""}
    assert read_csv_safely(spark, f"{tmp_path}/none.csv") is None
    targets = read_targets(spark, f"{tmp_path}/targets.csv", inter)
    assert [r["user_id"] for r in targets.orderBy("ordinal").collect()] == [5, 1]
    assert read_targets(spark, f"{tmp_path}/none.csv", inter).count() == 1
    pred = spark.createDataFrame([(1, 7, 1, 1.0), (1, 3, 2, 0.5)], "u long, i long, rank int, score double")
    sub = app.submission(pred, targets, inter, 2)
    assert [r["recommendation"] for r in sub.orderBy("ordinal").collect()] == ["2", "7 3"]
    write_submission(sub, f"{tmp_path}/sub")
    assert spark.read.option("header", True).csv(f"{tmp_path}/sub").count() == 2
    assert append_feedback(spark, f"{tmp_path}/fb", 1, 2, True) and append_feedback(spark, f"{tmp_path}/fb", 1, 3, False)
    assert spark.read.option("header", True).csv(f"{tmp_path}/fb").count() == 2


def test_statistics_edges(spark):
    counts = spark.createDataFrame([(1, 1), (2, 2), (3, 3), (4, 10)], "u long, count long")
    d = S.describe_counts(counts).first()
    assert d["p50"] == 2.5 and d["max"] == 10
    assert {r["label"]: r["n"] for r in S.binned(counts).collect()} == {"1": 1, "2": 1, "3-5": 1, "6-10": 1, "11-20": 0, "21-50": 0, "51-100": 0, "100+": 0}
    assert with_columns(spark.createDataFrame([(1, None)], "i long, Title string")).first()["Title"] == ""


def test_stream_of_days(spark, tmp_path):
    from lorewell.streaming.daily import start

    rows = spark.sql("SELECT timestamp'2024-01-01 05:00:00' AS ts, 'a' AS event_type UNION ALL SELECT timestamp'2024-01-01 06:00:00', 'a' UNION ALL SELECT timestamp'2024-01-09 06:00:00', 'b'")
    rows.write.parquet(f"{tmp_path}/in")
    q = start(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/cp")
    q.awaitTermination(60)
    assert [(str(r["day"]), r["event_type"], r["count"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [("2024-01-01", "a", 2)]


def test_encoder_is_unit_and_deterministic(spark):
    from lorewell.functions.encoder import encode

    items = spark.createDataFrame([(1, "été rouge"), (2, "")], "i long, s string")
    got = {r["i"]: r["e"] for r in encode(items, F.col("s")).collect()}
    assert sum(x * x for x in got[1]) == pytest.approx(1.0) and not any(got[2])


def test_tuning_queries_run_the_whole_grid_and_all_models(spark, monkeypatch):
    from lorewell.plans import queries, tuning

    calls = []
    monkeypatch.setattr(queries, "_data", lambda *a, **b: None)
    monkeypatch.setattr(queries.loading, "validation_part", lambda ix: spark.range(0))
    monkeypatch.setattr(queries.I, "event_interactions", lambda *a: None)
    monkeypatch.setattr(queries.tuning, "grid_search", lambda data, truth, **changes: calls.append(changes))
    monkeypatch.setattr(queries.tuning, "run_experiments", lambda chosen, data, truth, own: calls.append(chosen))
    monkeypatch.setattr(queries, "_enriched_data", lambda *a: None)
    monkeypatch.setattr(models.EnsembleRecommender, "fit", lambda self, data: calls.append(self.factors) or self)
    monkeypatch.setattr(models.EnsembleRecommender, "predict", lambda self, k=10: None)
    queries.grid_search(spark, "")
    queries.experiments(spark, "")
    queries.topk_hybrid(spark, "")
    assert calls == [{}, models.MODELS, 100]
    assert len(tuning.ALPHAS) * len(tuning.WEIGHTS) * len(tuning.REBUYS) * len(tuning.POPS) == 192


@pytest.mark.parametrize("name", ["semantic_hybrid", "coupled_semantic", "enriched_semantic", "ensemble_hybrid", "soup"])
def test_ensembles_in_arrays_and_by_joins_agree(spark, monkeypatch, name):
    from lorewell.operators import scoring
    from lorewell.plans import models

    rng = np.random.default_rng(5)
    ix = spark.createDataFrame([(int(u), int(i), float(t)) for u, i, t in zip(rng.integers(0, 25, 400), rng.integers(0, 40, 400), rng.integers(0, 4_000_000, 400), strict=True)], "u long, i long, t double").distinct()
    words = ["red", "blue", "ring", "bolt", "steel", "brass"]
    items = spark.createDataFrame([(k, " ".join(rng.choice(words, 3)), f"A{k % 7}", "tools", "P") for k in range(45)], "i long, Title string, Author string, Subjects string, Publisher string")
    e = rng.standard_normal((44, 8))
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    vectors = spark.createDataFrame([(k, v) for k, v in enumerate(e.tolist())], "i long, e array<double>")
    users = ix.select("u").union(spark.createDataFrame([(99,)], "u long"))

    def model():
        return models.EnsembleRecommender(content="soup", half_lives=(7, 90), diagonal=1.0, svd=0) if name == "soup" else getattr(models, name)(**({"factors": 6} if name == "semantic_hybrid" else {}))

    arrays = model().fit(models.Data(ix, users, items, items, vectors))
    assert arrays.side is not None
    want = {(r["u"], r["rank"]): (r["i"], r["score"]) for r in arrays.predict(6).collect()}
    monkeypatch.setattr(scoring, "BROADCAST_BYTES", 8000 if name == "ensemble_hybrid" else 600)
    joins = model().fit(models.Data(ix, users, items, items, vectors))
    assert joins.side is None
    got = {(r["u"], r["rank"]): (r["i"], r["score"]) for r in joins.predict(6).collect()}
    assert got.keys() == want.keys() and len(got) == 26 * 6
    for key, (i, score) in want.items():
        assert got[key][1] == pytest.approx(score, abs=3e-6)
    assert sum(got[key][0] == i for key, (i, _) in want.items()) >= 0.98 * len(want)


def test_strict_cast(spark, tmp_path):
    from lorewell.sources.interactions import read_interactions

    (tmp_path / "good.csv").write_text("x,t,i,u\na,1.5,2,1\nb,1.5,2,1\na,,2,\n")
    assert sorted(map(str, read_interactions(spark, str(tmp_path / "good.csv")).collect())) == ["Row(u=1, i=2, t=1.5)", "Row(u=None, i=2, t=None)"]
    for bad in ("abc", "1.5"):
        (tmp_path / f"{bad}.csv").write_text(f"u,i,t\n1,{bad},3\n")
        with pytest.raises(Exception, match="is no bigint"):
            read_interactions(spark, str(tmp_path / f"{bad}.csv")).collect()


def test_exports_and_epoch_units(spark, tmp_path):
    from lorewell.sources.sinks import write_eda

    day = 86400
    for unit in (1, 1000, 1_000_000):
        rows = [(1, 5, 9e8 * unit), (1, 6, (9e8 + day) * unit), (2, 5, 9e8 * unit), (3, 5, None)]
        names = write_eda(spark.createDataFrame(rows, "u long, i long, t double"), f"{tmp_path}/{unit}")
        tables = [spark.read.option("header", True).csv(f"{tmp_path}/{unit}/{n}.csv").collect() for n in names]
        assert [[tuple(r) for r in t] for t in tables] == [[("1", "2"), ("2", "1"), ("3", "1")], [("5", "3"), ("6", "1")], [("1998-07-09", "2"), ("1998-07-10", "1")]]


def test_free_text_search(spark):
    from pyspark.sql import functions as F

    from lorewell.plans.app import search_by_meaning

    items = spark.createDataFrame([(1, "red ring"), (2, "blue bolt"), (3, "red bolt ring")], "i long, text string")
    got = search_by_meaning(items, F.col("text"), "Ring, red!", 2).collect()
    assert [(r["i"], r["rank"]) for r in got] == [(1, 1), (3, 2)] and got[0]["score"] == 1.0
    assert search_by_meaning(items, F.col("text"), "  ").count() == 0
    model = lambda texts: [[float(len(t)), 1.0] for t in texts]
    assert search_by_meaning(items, F.col("text"), "12345678", 1, model=model).first()["i"] == 1


def test_ease_and_log_svd_against_dense_arithmetic(spark):
    from lorewell.operators.profiles import decayed, tfidf
    from lorewell.plans import models

    rng = np.random.default_rng(6)
    ix = spark.createDataFrame([(int(u), int(i), float(t)) for u, i, t in zip(rng.integers(0, 12, 150), rng.integers(0, 15, 150), rng.integers(0, 2_000_000, 150), strict=True)], "u long, i long, t double").distinct()
    data = models.Data(ix, ix, ix)
    x = np.zeros((12, 15))
    for r in tfidf(decayed(ix, 30), 12).collect():
        x[r["u"], r["i"]] = r["x"]
    p = np.linalg.inv(x.T @ x + 500 * np.eye(15))
    b = -p / np.diag(p)[None, :]
    np.fill_diagonal(b, 0)
    counts = np.zeros((12, 15))
    for r in ix.groupBy("u", "i").count().collect():
        counts[r["u"], r["i"]] = math.log1p(r["count"])
    u, s, vt = np.linalg.svd(counts)
    low = (u[:, :4] * np.sqrt(s[:4])) @ (np.sqrt(s[:4])[:, None] * vt[:4])
    for model, scores in ((models.EASERecommender(500.0, 30), x @ b), (models.LogSVDRecommender(4), low)):
        for r in model.fit(data).predict(5).collect():
            assert r["score"] == pytest.approx(np.sort(np.round(scores[r["u"]], 6))[::-1][r["rank"] - 1], abs=3e-6)


def test_ease_after_fork_ends():
    """In a process that has forked before its first linear algebra, as each has that starts a session."""
    code = (
        "import os, numpy as np\n"
        "from lorewell.operators.latent import ease_weights\n"
        "if (child := os.fork()) == 0: os._exit(0)\n"
        "os.waitpid(child, 0)\n"
        "x = np.random.default_rng(3).random((50, 1500))\n"
        "b = ease_weights(x.T @ x, 500.0)\n"
        "p = np.linalg.inv(x.T @ x + 500.0 * np.eye(1500))\n"
        "want = -p / np.diag(p); np.fill_diagonal(want, 0)\n"
        "assert np.allclose(b, want, atol=1e-9)\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120, cwd=Path(__file__).parents[1])


def test_grid_from_one_pass_agrees_with_a_model_for_each_setting(spark, monkeypatch):
    from lorewell.plans import tuning

    rng = np.random.default_rng(8)
    rows = {(int(u), int(i), float(t)) for u, i, t in zip(rng.integers(0, 20, 300), rng.integers(0, 30, 300), rng.integers(0, 4_000_000, 300), strict=True)}
    train = spark.createDataFrame([r for r in rows if r[2] < 3_000_000], "u long, i long, t double")
    truth = spark.createDataFrame([r for r in rows if r[2] >= 3_000_000] + [(77, 3, 1.0), (77, 3, 2.0)], "u long, i long, t double")
    e = rng.standard_normal((28, 6))
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    vectors = spark.createDataFrame([(k, v) for k, v in enumerate(e.tolist())], "i long, e array<double>")
    data = models.Data(train, train, train.unionByName(truth), None, vectors)
    grid = {"alphas": (0.4, 0.7), "weights": ((0.8, 0.2),), "rebuys": (2.0,), "pops": (0.0, 0.2), "factors": 5}
    got = tuning.grid_search(data, truth, **grid).collect()
    monkeypatch.setattr(tuning, "_mixed_scores", lambda *a: None)
    want = tuning.grid_search(data, truth, **grid).collect()
    assert [r[:4] for r in got] == [r[:4] for r in want]
    assert [r["map_at_k"] for r in got] == pytest.approx([r["map_at_k"] for r in want])
    assert len(got) == 4 and [r["best"] for r in got].count(True) == 1 and len({r["map_at_k"] for r in got}) > 1
    none = tuning.grid_search(data, truth.limit(0), **grid).collect()
    assert len(none) == 4 and {r["map_at_k"] for r in none} == {None} and none[0]["best"]
