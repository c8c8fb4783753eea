"""Every query of the library over the bundled tables, with the equivalent SQL where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorewell.functions import text as T
from lorewell.functions.scalar import cut
from lorewell.operators import evaluation, latent, loading, profiles, scoring
from lorewell.operators import statistics as S
from lorewell.operators.vector_index import VectorIndex
from lorewell.operators.word_vectors import WordVectors
from lorewell.plans import app, enrichment, models, persist, tuning
from lorewell.plans.models import Data
from lorewell.sources import interactions as I
from lorewell.sources import sinks
from lorewell.sources.embedding_cache import EmbeddingCache, item_digests, leaf_digests, tree_hash
from lorewell.sources.scratch import shared_folder
from lorewell.streaming import profiles as streamed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# ---- SQL that several oracles share
IX = "ix AS (SELECT DISTINCT o_custkey AS u, l_partkey AS i, epoch(o_orderdate)::BIGINT AS t FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
EV = "ix AS (SELECT DISTINCT user_id AS u, json_extract_string(props, '$.k')::BIGINT AS i, epoch_us(ts) / 1e6 AS t FROM events)"
SPLIT = "ranked AS (SELECT *, dense_rank() OVER (PARTITION BY u ORDER BY t) AS dr FROM ix), split AS (SELECT u, i, t, dr / max(dr) OVER (PARTITION BY u) AS r FROM ranked), train AS (SELECT u, i, t FROM split WHERE r < 0.8), valid AS (SELECT u, i, t FROM split WHERE NOT r < 0.8)"
USERS = "users AS (SELECT DISTINCT u FROM ix), all_items AS (SELECT DISTINCT i FROM ix), n AS (SELECT count(*)::DOUBLE AS n FROM users)"
ITEMS = "items AS (SELECT p_partkey AS i, p_name AS Title, p_brand AS Author, p_type AS Subjects FROM part)"
VECS = "nv AS (SELECT count(*) AS n FROM embeddings), vecs AS (SELECT p_partkey AS i, e FROM part JOIN nv ON true JOIN (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda y: y * y)))) AS e FROM embeddings) v ON v.vec_id = p_partkey % nv.n)"


def weights_sql(hl: float, source: str = "train") -> str:
    return f"w AS (SELECT u, i, sum(exp(-ln(2.0) / {float(hl)} * (last - t) / 86400.0)) AS w FROM (SELECT *, max(t) OVER (PARTITION BY u) AS last FROM {source}) GROUP BY u, i), dfs AS (SELECT i, count(*) AS df FROM w GROUP BY i)"


TFIDF = "v AS (SELECT u, w.i, w * (ln((1 + n) / (1 + df)) + 1) AS v FROM w JOIN dfs ON w.i = dfs.i, n), x AS (SELECT u, i, CASE WHEN sqrt(sum(v * v) OVER (PARTITION BY u)) = 0 THEN 0 ELSE v / sqrt(sum(v * v) OVER (PARTITION BY u)) END AS x FROM v)"
COSINE = "c AS (SELECT u, i, CASE WHEN sqrt(sum(x * x) OVER (PARTITION BY i)) = 0 THEN 0 ELSE x / sqrt(sum(x * x) OVER (PARTITION BY i)) END AS c FROM x), s AS (SELECT a.i, b.i AS j, sum(a.c * b.c) AS s FROM c a JOIN c b ON a.u = b.u GROUP BY 1, 2)"
SCORES = "scores AS (SELECT u, j AS i, sum(x * s) AS score FROM x JOIN s ON x.i = s.i GROUP BY 1, 2)"


def dense_top(k: int = 10, name: str = "top", score: str = "coalesce(score, 0)") -> str:
    """Top k over all users and items, absent pairs 0, ranked by the rounded score and id."""
    return f"{name} AS (SELECT u, i, rank::INT AS rank, score FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY score DESC, i) AS rank FROM (SELECT users.u, all_items.i, round({score}, 6) + 0.0 AS score FROM users CROSS JOIN all_items LEFT JOIN scores ON scores.u = users.u AND scores.i = all_items.i)) WHERE rank <= {k})"


def query(sql: str | None = None):
    """Registers a query and its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _data(spark: SparkSession, d: str, source=I.order_interactions, vectors: bool = False) -> Data:
    ix = source(spark, d, by_user=True).persist()  # what follows works on users: one shuffle for all of it
    return Data(loading.train_part(ix).persist(), ix, ix, I.part_items(spark, d), I.item_vectors(spark, d) if vectors else None)


# ---- loading
@query(f"WITH {IX} SELECT u, i, t FROM ix")
def dedup_interactions(spark, d):
    return I.order_interactions(spark, d)


@query(f"WITH {IX} SELECT u, dense_rank() OVER (ORDER BY u) - 1 AS u_idx, i, dense_rank() OVER (ORDER BY i) - 1 AS i_idx, t FROM ix")
def id_map(spark, d):
    return loading.dense_ids(I.order_interactions(spark, d)).select("u", "u_idx", "i", "i_idx", "t")


@query(f"WITH {IX}, {ITEMS} SELECT a.i, coalesce(Title, '') AS Title, coalesce(Author, '') AS Author, coalesce(Subjects, '') AS Subjects FROM (SELECT DISTINCT i FROM ix) a LEFT JOIN items USING (i)")
def restrict_items(spark, d):
    return loading.restrict_items(I.part_items(spark, d), I.order_interactions(spark, d)).select("i", "Title", "Author", "Subjects")


@query(f"WITH {IX}, {SPLIT} SELECT u, i, t, round(r, 9) AS r, r < 0.8 AS is_train FROM split")
def time_split(spark, d):
    return loading.time_split(I.order_interactions(spark, d)).select("u", "i", "t", F.round("r", 9).alias("r"), "is_train")


@query(f"WITH {EV} SELECT u, i, t, round(row_number() OVER (PARTITION BY u ORDER BY t, i) / count(*) OVER (PARTITION BY u), 9) AS r FROM ix")
def rank_pct_first(spark, d):
    return S.first_rank(I.event_interactions(spark, d)).withColumn("r", F.round("r", 9))


@query("SELECT user_id AS u, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS i, epoch_us(ts) AS t_us FROM events")
def soft_cast(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("u"), F.expr("try_cast(get_json_object(props, '$.k') AS bigint)").alias("i"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t_us"))


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/lorewell/{name}-{uuid.uuid4().hex}"


@query(f"WITH {EV} SELECT u, i, t FROM ix")
def interactions_from_csv(spark, d):
    """Interactions through a CSV table that holds each row twice."""
    folder, rows = _folder(spark, "interactions"), I.event_interactions(spark, d)
    rows.unionByName(rows).select("t", F.lit("x").alias("other"), "i", "u").write.option("header", True).csv(folder)
    return I.read_interactions(spark, folder)


@query(f"WITH {ITEMS} SELECT i, Title, Author, Subjects, '' AS Publisher FROM items")
def items_from_csv(spark, d):
    folder = _folder(spark, "items")
    I.part_items(spark, d).select("i", "Title", "Author", "Subjects").write.option("header", True).csv(folder)
    return I.read_items(spark, folder).select("i", *I.TEXT_COLUMNS)


@query(f"WITH {EV} SELECT u, count(*) AS count FROM ix GROUP BY u")
def exported_user_counts(spark, d):
    """One of the exports of the exploration, read back."""
    folder = _folder(spark, "exports")
    sinks.write_eda(I.event_interactions(spark, d), folder)
    return I.read_csv_safely(spark, f"{folder}/user_interaction_counts.csv", "u long, count long")


@query("SELECT p_partkey AS i FROM part WHERE p_partkey % 3 <> 0")
def items_to_enrich(spark, d):
    parts = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("i"), F.when(F.col("p_partkey") % 3 == 0, F.lit("kept")).alias("description"))
    return enrichment.to_enrich(parts).select("i")


# ---- profiles and similarity
@query(f"WITH {IX}, {SPLIT}, {weights_sql(30)} SELECT u, i, round(w, 9) AS w FROM w")
def decay_weight(spark, d):
    return profiles.decayed(loading.train_part(I.order_interactions(spark, d)), 30).withColumn("w", F.round("w", 9))


@query(f"WITH {IX}, {SPLIT}, {USERS}, {weights_sql(30)}, {TFIDF} SELECT u, i, round(x, 9) AS x FROM x")
def user_profile_tfidf(spark, d):
    data = _data(spark, d)
    return profiles.tfidf(profiles.decayed(data.train, 30), data.n_users).withColumn("x", F.round("x", 9))


BM = "bm AS (SELECT u, w.i, w * 2.5 / (w + 1.5 * (0.25 + 0.75 * sum(w) OVER (PARTITION BY u) / ((SELECT sum(w) FROM w) / n))) * ln(1 + (n - df + 0.5) / (df + 0.5)) AS x FROM w JOIN dfs ON w.i = dfs.i, n), x AS (SELECT * FROM bm)"


@query(f"WITH {IX}, {SPLIT}, {USERS}, {weights_sql(30)}, {BM} SELECT u, i, round(x, 6) AS x FROM x")
def bm25_profile(spark, d):
    data = _data(spark, d)
    return profiles.bm25(profiles.decayed(data.train, 30), data.n_users, k1=1.5).withColumn("x", F.round("x", 6))


@query(f"WITH {IX}, {SPLIT}, {USERS}, {weights_sql(250)}, {TFIDF}, {COSINE} SELECT i, j, round(s, 6) + 0.0 AS s FROM s")
def collab_similarity(spark, d):
    data = _data(spark, d)
    return profiles.item_similarity(profiles.tfidf(profiles.decayed(data.train, 250), data.n_users).persist()).withColumn("s", F.round("s", 6) + F.lit(0.0))


@query(f"WITH {IX}, {SPLIT}, {USERS}, {weights_sql(250)}, {TFIDF} SELECT i, round(CASE WHEN max(p) OVER () = 0 THEN 0 ELSE p / max(p) OVER () END, 6) AS pop FROM (SELECT i, sum(x) AS p FROM x GROUP BY i)")
def popularity(spark, d):
    data = _data(spark, d)
    return profiles.popularity(profiles.tfidf(profiles.decayed(data.train, 250), data.n_users)).withColumn("pop", F.round("pop", 6))


TRANS = "trans AS (SELECT i, next_i, count(*) AS n, ln(1 + count(*)) AS score FROM (SELECT i, lead(i) OVER (PARTITION BY u ORDER BY t, i) AS next_i FROM train) WHERE next_i IS NOT NULL GROUP BY i, next_i)"


@query(f"WITH {EV}, {SPLIT}, {TRANS} SELECT i, next_i, n, round(score, 9) AS score FROM trans")
def transitions(spark, d):
    return profiles.transitions(loading.train_part(I.event_interactions(spark, d))).withColumn("score", F.round("score", 9))


@query(f"WITH {EV}, {weights_sql(30, 'ix')} SELECT u, i, round(w, 6) AS w FROM w")
def streamed_profiles(spark, d):
    """The decayed weights of all interactions, from a stream in four micro-batches."""
    return streamed.current_profiles(streamed.replayed(I.event_interactions(spark, d), 30), 30).withColumn("w", F.round("w", 6))


@query(f"WITH {EV}, train AS (SELECT * FROM ix), {TRANS} SELECT i, next_i, n, round(score, 9) AS score FROM trans")
def streamed_transitions(spark, d):
    return streamed.current_transitions(streamed.replayed(I.event_interactions(spark, d), 30)).withColumn("score", F.round("score", 9))


# ---- top k
@query(f"WITH {IX}, {SPLIT}, {USERS}, {weights_sql(250)}, {TFIDF}, {COSINE}, {SCORES}, {dense_top()} SELECT * FROM top")
def topk_collab(spark, d):
    return models.CosineRecommender(250).fit(_data(spark, d)).predict(10)


@query(SQL["topk_collab"])
def topk_from_saved_model(spark, d):
    """As `topk_collab`, from a model that was fitted, saved and loaded."""
    folder = _folder(spark, "model")
    persist.save(models.CosineRecommender(250).fit(_data(spark, d)), folder)
    return persist.load(spark, folder).predict(10)


@query(f"WITH {EV}, {SPLIT}, {USERS}, {weights_sql(30)}, {TFIDF}, {COSINE}, {SCORES}, {dense_top()} SELECT * FROM top")
def topk_collab_events(spark, d):
    """The same by joins and aggregates (the way taken where the item side is too large to send)."""
    data = _data(spark, d, I.event_interactions)
    x = profiles.tfidf(profiles.decayed(data.train, 30), data.n_users)
    scores = scoring.join_scores(x, profiles.item_similarity(x))
    return scoring.padded(scoring.top_k(scores, 10), data.users, data.items, 10)


@query(f"WITH {IX}, {SPLIT}, {USERS}, {weights_sql(30)}, {BM}, {COSINE}, {SCORES}, {dense_top()} SELECT * FROM top")
def topk_bm25(spark, d):
    return models.BM25Recommender(k1=1.5).fit(_data(spark, d)).predict(10)


@query(f"WITH {EV}, {SPLIT}, {USERS}, {weights_sql(1)}, x AS (SELECT u, i, w AS x FROM w), {TRANS}, s AS (SELECT i, next_i AS j, score AS s FROM trans), {SCORES}, {dense_top()} SELECT * FROM top")
def topk_sequential(spark, d):
    return models.SequentialRecommender(1).fit(_data(spark, d, I.event_interactions)).predict(10)


@query(f"WITH {IX}, {SPLIT}, {USERS}, {weights_sql(250)}, {TFIDF}, p AS (SELECT i, sum(x) AS p FROM x GROUP BY i), pop AS (SELECT i, round(p / (SELECT max(p) FROM p), 6) + 0.0 AS score FROM p ORDER BY score DESC, i LIMIT 10) SELECT u, i, (row_number() OVER (PARTITION BY u ORDER BY score DESC, i))::INT AS rank, score FROM users CROSS JOIN pop")
def topk_popular(spark, d):
    return models.PopularityRecommender(250).fit(_data(spark, d)).predict(10)


@query(f"WITH {IX}, {SPLIT}, {USERS}, {weights_sql(30)}, {TFIDF}, {COSINE}, {SCORES}, seen AS (SELECT DISTINCT u, i FROM train), top AS (SELECT u, i, rank::INT AS rank, score FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY score DESC, i) AS rank FROM (SELECT users.u, all_items.i, CASE WHEN seen.i IS NOT NULL THEN '-inf'::DOUBLE ELSE round(coalesce(score, 0), 6) + 0.0 END AS score FROM users CROSS JOIN all_items LEFT JOIN scores ON scores.u = users.u AND scores.i = all_items.i LEFT JOIN seen ON seen.u = users.u AND seen.i = all_items.i)) WHERE rank <= 10) SELECT * FROM top")
def topk_history_filter(spark, d):
    return models.HistoryFilterRecommender(30).fit(_data(spark, d)).predict(10)


@query(f"WITH {IX}, {SPLIT}, {USERS}, common AS (SELECT i FROM train GROUP BY i HAVING count(*) >= 3), low AS (SELECT * FROM train WHERE i IN (SELECT i FROM common)), {weights_sql(30, 'low')}, {TFIDF}, {COSINE}, {SCORES}, {dense_top()} SELECT * FROM top")
def topk_low_interaction(spark, d):
    return models.LowInteractionRecommender(3, 30).fit(_data(spark, d)).predict(10)


@query(f"WITH {IX}, {SPLIT}, {USERS}, {ITEMS}, {weights_sql(30)}, {TFIDF}, {COSINE}, {SCORES}, {dense_top(30)}, a AS (SELECT top.*, coalesce(Author, 'Unknown') AS Author FROM top LEFT JOIN items USING (i)), m AS (SELECT *, Author <> 'Unknown' AND row_number() OVER (PARTITION BY u, Author ORDER BY rank) > 2 AS rejected FROM a) SELECT u, i, nth::INT AS rank, score FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY rejected, rank) AS nth FROM m) WHERE nth <= 10")
def topk_diversified(spark, d):
    return models.DiversifiedRecommender(2, 30).fit(_data(spark, d)).predict(10)


SEMANTIC = "q AS (SELECT u, d, sum(x * e[d]) AS q FROM x JOIN vecs ON x.i = vecs.i, range(1, 65) AS r(d) GROUP BY u, d), scores AS (SELECT u, vecs.i, list_sum(list_transform(list_zip(qs, e), lambda z: z[1] * z[2])) AS score FROM (SELECT u, list(q ORDER BY d) AS qs FROM q GROUP BY u) CROSS JOIN vecs)"


@query(f"WITH {EV}, {SPLIT}, {USERS}, {VECS}, {weights_sql(30)}, {TFIDF}, {SEMANTIC}, {dense_top()} SELECT * FROM top")
def topk_semantic(spark, d):
    model = models.EnsembleRecommender(alpha=0.0, half_lives=(30,), rebuy=0, pop=0, keyword=0, svd=0, sequence=0)
    return model.fit(_data(spark, d, I.event_interactions, vectors=True)).predict(10)


def _profile_sql(name: str, hl: float) -> str:
    """A profile and its cosine and content scores under names of their own."""
    own = f"x AS (SELECT u, i, x FROM {name})"
    return f"{name} AS (WITH {weights_sql(hl)}, {TFIDF} SELECT u, i, x FROM x), {name}_cos AS (WITH {own}, {COSINE}, {SCORES} SELECT u, i, score FROM scores), {name}_dense AS (WITH {own}, {SEMANTIC} SELECT u, i, score FROM scores)"


_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in ("i", "me", "my", "myself", "we", "our", "ours", "the", "a", "an", "and", "of", "in", "on"))
_KEYWORDS = f"known AS (SELECT * FROM items WHERE i IN (SELECT i FROM all_items)), tok AS (SELECT i, unnest(regexp_extract_all(lower(Title || '. ' || Author || '. ' || Subjects), '[a-z0-9_]{{2,}}')) AS term FROM known), tf AS (SELECT i, term, count(*) AS tf FROM tok WHERE term NOT IN ({_STOP}) GROUP BY i, term), dft AS (SELECT term, count(*) AS df FROM tf GROUP BY term HAVING count(*) >= 2), kv AS (SELECT i, term, tf * (ln((1 + (SELECT count(*) FROM known)) / (1 + df)) + 1) AS v FROM tf JOIN dft USING (term)), kw AS (SELECT i, term, v / sqrt(sum(v * v) OVER (PARTITION BY i)) AS k FROM kv), kq AS (SELECT u, term, sum(x * k) AS q FROM b JOIN kw ON b.i = kw.i GROUP BY u, term)"
_HYBRID = " UNION ALL ".join([
    *(f"SELECT u, i, 0.25 * score AS score FROM {name}" for name in ("a_cos", "a_dense", "b_cos", "b_dense")), "SELECT u, i, 0.5 * x FROM b", "SELECT u, i, 0.2 * p / (SELECT max(p) FROM pop) FROM users CROSS JOIN pop",
    "SELECT u, kw.i, 0.15 * q * k FROM kq JOIN kw ON kq.term = kw.term", "SELECT u, next_i, 0.3 * x * trans.score FROM a JOIN trans ON a.i = trans.i",
])


@query()
def topk_log_svd(spark, d):
    return models.LogSVDRecommender(50).fit(_data(spark, d, I.event_interactions)).predict(10)


@query()
def topk_svd(spark, d):
    return models.SVDRecommender(20).fit(_data(spark, d, I.event_interactions)).predict(10)


@query()
def svd_factors(spark, d):
    """Singular values of the binary-sum matrix (the factors themselves have free signs)."""
    s = models.SVDRecommender(20).fit(_data(spark, d, I.event_interactions)).singular
    return spark.createDataFrame([(k + 1, round(float(x), 6)) for k, x in enumerate(s)], "factor int, singular double")


@query()
def topk_ease(spark, d):
    return models.EASERecommender(500.0, 30).fit(_data(spark, d, I.event_interactions)).predict(10)


@query()
def topk_hybrid(spark, d):
    return models.semantic_hybrid().fit(_data(spark, d, I.event_interactions, vectors=True)).predict(10)


@query(f"WITH {EV}, {SPLIT}, {USERS}, {ITEMS}, {VECS}, {_profile_sql('a', 1)}, {_profile_sql('b', 250)}, {TRANS}, {_KEYWORDS}, pop AS (SELECT i, sum(x) AS p FROM b GROUP BY i), scores AS (SELECT u, i, sum(score) AS score FROM ({_HYBRID}) GROUP BY u, i), {dense_top()} SELECT * FROM top")
def topk_hybrid_without_svd(spark, d):
    """The production ensemble but for its latent term, which SQL cannot express."""
    return models.semantic_hybrid(svd=0).fit(_data(spark, d, I.event_interactions, vectors=True)).predict(10)


@query()
def topk_ensemble(spark, d):
    return models.ensemble_hybrid().fit(_data(spark, d, I.event_interactions)).predict(10)


_COUPLED = "SELECT u, i, 0.25 * score AS score FROM a_cos UNION ALL SELECT u, i, 0.25 * score FROM a_dense UNION ALL SELECT u, i, 0.75 * x FROM a UNION ALL SELECT u, i, 0.25 * score FROM b_cos UNION ALL SELECT u, i, 0.25 * score FROM b_dense UNION ALL SELECT u, i, 0.75 * x FROM b UNION ALL SELECT u, i, 0.1 * p / (SELECT max(p) FROM pop) FROM users CROSS JOIN pop"


@query(f"WITH {EV}, {SPLIT}, {USERS}, {VECS}, {_profile_sql('a', 30)}, {_profile_sql('b', 150)}, pop AS (SELECT i, sum(x) AS p FROM b GROUP BY i), scores AS (SELECT u, i, sum(score) AS score FROM ({_COUPLED}) GROUP BY u, i), {dense_top()} SELECT * FROM top")
def topk_coupled_semantic(spark, d):
    return models.coupled_semantic().fit(_data(spark, d, I.event_interactions, vectors=True)).predict(10)


def _enriched(spark: SparkSession, d: str) -> DataFrame:
    """The parts with their enriched columns, in place of a text model's answers."""
    size = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("i"), F.concat(F.lit("size "), "p_size").alias("description"))
    return I.with_columns(I.part_items(spark, d).withColumns({"clean_author": F.col("Author"), "category": F.lower("Subjects")}).join(size, "i"), (*I.TEXT_COLUMNS, *I.ENRICHED_COLUMNS))


def _enriched_data(spark: SparkSession, d: str) -> Data:
    """The interactions with vectors of the enriched text."""
    data, items = _data(spark, d, I.event_interactions), _enriched(spark, d)
    data.vectors = WordVectors.fit(items, T.enriched_soup()).encode(items, T.enriched_soup())
    return data


@query()
def topk_enriched_semantic(spark, d):
    """On vectors of the enriched text."""
    return models.enriched_semantic().fit(_enriched_data(spark, d)).predict(10)


# ---- evaluation and tuning
MAP = "truth AS (SELECT DISTINCT u, i FROM valid), sizes AS (SELECT u, count(*) AS n FROM truth GROUP BY u), hits AS (SELECT top.u, rank, row_number() OVER (PARTITION BY top.u ORDER BY rank) AS h FROM top JOIN truth ON top.u = truth.u AND top.i = truth.i), ap AS (SELECT sizes.u, coalesce(sum(h / rank), 0) / least(any_value(n), 10) AS ap FROM sizes LEFT JOIN hits ON hits.u = sizes.u GROUP BY sizes.u)"


@query(f"WITH {EV}, {SPLIT}, {USERS}, {weights_sql(30)}, {TFIDF}, {COSINE}, {SCORES}, {dense_top()}, {MAP} SELECT round(avg(ap), 6) AS map_at_k, count(*) AS n_users FROM ap")
def map_at_10(spark, d):
    data = _data(spark, d, I.event_interactions)
    predicted = models.CosineRecommender(30).fit(data).predict(10)
    return evaluation.map_at_k(predicted, loading.validation_part(I.event_interactions(spark, d)), 10).withColumn("map_at_k", F.round("map_at_k", 6))


@query()
def grid_search(spark, d):
    data = _data(spark, d, I.event_interactions, vectors=True)
    truth = loading.validation_part(I.event_interactions(spark, d)).persist()
    return tuning.grid_search(data, truth)


@query()
def experiments(spark, d):
    data = _data(spark, d, I.event_interactions, vectors=True)
    truth = loading.validation_part(I.event_interactions(spark, d)).persist()
    return tuning.run_experiments(models.MODELS, data, truth, own={"enriched_semantic": _enriched_data(spark, d)})


# ---- statistics
@query(f"WITH {EV} SELECT u, count(*) AS count FROM ix GROUP BY u")
def user_counts(spark, d):
    return S.value_counts(I.event_interactions(spark, d), "u")


@query(f"WITH {IX} SELECT i, count(*) AS count FROM ix GROUP BY i")
def item_counts(spark, d):
    return S.value_counts(I.order_interactions(spark, d), "i")


@query(f"WITH {IX}, c AS (SELECT i, count(*) AS count FROM ix GROUP BY i) SELECT i, count, row_number() OVER o AS position, round(sum(count) OVER (o ROWS UNBOUNDED PRECEDING) / sum(count) OVER (), 9) AS cum_share, round(row_number() OVER o / count(*) OVER (), 9) AS cdf FROM c WINDOW o AS (ORDER BY count DESC, i)")
def cumulative_share(spark, d):
    return S.cumulative_share(S.value_counts(I.order_interactions(spark, d), "i"), "i").withColumns({"cum_share": F.round("cum_share", 9), "cdf": F.round("cdf", 9)})


@query(f"WITH {IX}, c AS (SELECT i, count(*) AS count FROM ix GROUP BY i), s AS (SELECT row_number() OVER o AS position, sum(count) OVER (o ROWS UNBOUNDED PRECEDING) / sum(count) OVER () AS share, count(*) OVER () AS n FROM c WINDOW o AS (ORDER BY count DESC, i)) SELECT f::DOUBLE AS fraction, round(share, 9) AS share FROM s, (VALUES (0.01), (0.05), (0.1), (0.2)) AS v(f) WHERE position = floor(n * f::DOUBLE)")
def share_landmarks(spark, d):
    shares = S.cumulative_share(S.value_counts(I.order_interactions(spark, d), "i"), "i")
    return S.share_landmarks(shares).withColumn("share", F.round("share", 9))


@query(f"WITH {EV}, a AS (SELECT u, count(*) AS c FROM ix GROUP BY u), b AS (SELECT i, count(*) AS c FROM ix GROUP BY i) SELECT k::INT AS k, round((SELECT avg((c <= k)::INT) FROM a), 9) AS ratio_users, round((SELECT avg((c <= k)::INT) FROM b), 9) AS ratio_items FROM (VALUES (1), (2), (3), (5), (10)) AS v(k)")
def ratio_leq(spark, d):
    ix = I.event_interactions(spark, d)
    users, items = (S.ratio_at_most(S.value_counts(ix, c)).withColumn("ratio", F.round("ratio", 9)) for c in ("u", "i"))
    return users.withColumnRenamed("ratio", "ratio_users").join(items.withColumnRenamed("ratio", "ratio_items"), "k")


_FRAME = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{kind}' AS type, count(*) AS n_rows, count({c}) AS n_filled FROM documents" for c, kind in (("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint")))


@query(_FRAME)
def frame_profile(spark, d):
    return S.frame_profile(spark.read.parquet(f"{d}/documents.parquet"))


_BINS = " UNION ALL ".join(f"SELECT {k}::INT AS ordinal, '{label}' AS label, {lo} AS lo, {'NULL' if hi is None else hi}::BIGINT AS hi" for k, (lo, hi, label) in enumerate(S.BINS, 1))


@query(f"WITH {EV}, c AS (SELECT u, count(*) AS count FROM ix GROUP BY u), b AS ({_BINS}) SELECT ordinal, label, count(c.count) AS n, round(count(c.count) / (SELECT count(*) FROM c), 9) AS share FROM b LEFT JOIN c ON c.count > lo AND (hi IS NULL OR c.count <= hi) GROUP BY ordinal, label")
def bins_users(spark, d):
    return S.binned(S.value_counts(I.event_interactions(spark, d), "u")).withColumn("share", F.round("share", 9))


@query(f"WITH {IX}, c AS (SELECT u, count(*) AS count FROM ix GROUP BY u), e AS (SELECT min(count) AS lo, max(count) AS hi FROM c) SELECT (CASE WHEN hi = lo THEN 1 ELSE least(floor((count - lo) / ((hi - lo) / 50.0)) + 1, 50) END)::INT AS bin, count(*) AS n FROM c, e GROUP BY 1")
def histogram_users(spark, d):
    return S.histogram(S.value_counts(I.order_interactions(spark, d), "u"), 50)


@query(f"WITH {EV}, c AS (SELECT u, i, count(*) AS count FROM ix GROUP BY u, i) SELECT least(count, 10) AS n_clipped, count(*) AS pairs FROM c GROUP BY 1")
def rebuy_distribution(spark, d):
    return S.clipped(S.pair_counts(I.event_interactions(spark, d)), 10)


@query(f"WITH {EV}, c AS (SELECT u, i, count(*) AS count FROM ix GROUP BY u, i) SELECT round(100.0 * avg((count > 1)::INT), 6) AS pct_pairs_rebought, round(100.0 * sum(count - 1) / sum(count), 6) AS pct_rows_rebuy FROM c")
def rebuy_rates(spark, d):
    return S.rebuy_rates(I.event_interactions(spark, d))


@query(f"WITH {EV} SELECT u, i, t, round(g, 6) AS gap_days FROM (SELECT u, i, t, (t - lag(t) OVER (PARTITION BY u, i ORDER BY t)) / 86400.0 AS g FROM ix) WHERE g IS NOT NULL")
def rebuy_gap_days(spark, d):
    return S.rebuy_gaps(I.event_interactions(spark, d)).withColumn("gap_days", F.round("gap_days", 6))


@query(f"WITH {EV} SELECT strftime(make_timestamp((t * 1e6)::BIGINT), '%Y-%m-%d') AS day, count(*) AS count FROM ix GROUP BY 1")
def seasonality_day(spark, d):
    return S.by_day(I.event_interactions(spark, d)).withColumn("day", F.col("day").cast("string"))


@query(f"WITH {IX} SELECT strftime(make_timestamp(t * 1000000), '%Y-%m-01') AS month, count(*) AS count FROM ix GROUP BY 1")
def seasonality_month(spark, d):
    return S.by_month(I.order_interactions(spark, d)).withColumn("month", F.col("month").cast("string"))


_DAYS = " UNION ALL ".join(f"SELECT {k}::INT AS ordinal, '{x}' AS dow" for k, x in enumerate(S.DAYS, 1))


@query(f"WITH {IX}, f AS (SELECT isodow(make_timestamp(t * 1000000)) AS k, count(*) AS count FROM ix GROUP BY 1), days AS ({_DAYS}) SELECT ordinal, dow, count FROM days LEFT JOIN f ON ordinal = k")
def seasonality_dow(spark, d):
    return S.by_weekday(I.order_interactions(spark, d))


@query(f"WITH {EV}, f AS (SELECT hour(make_timestamp((t * 1e6)::BIGINT)) AS hour, count(*) AS count FROM ix GROUP BY 1) SELECT h::INT AS hour, coalesce(count, 0) AS count FROM range(24) AS r(h) LEFT JOIN f ON f.hour = h")
def seasonality_hour(spark, d):
    return S.by_hour(I.event_interactions(spark, d))


@query(f"WITH {EV}, f AS (SELECT isodow(make_timestamp((t * 1e6)::BIGINT)) AS k, hour(make_timestamp((t * 1e6)::BIGINT)) AS h FROM ix), days AS ({_DAYS}) SELECT ordinal, dow, " + ", ".join(f"count(*) FILTER (h = {h}) AS h{h}" for h in range(24)) + " FROM days LEFT JOIN f ON ordinal = k GROUP BY ordinal, dow")
def pivot_dow_hour(spark, d):
    return S.weekday_by_hour(I.event_interactions(spark, d))


@query(f"WITH {EV}, chosen AS (SELECT u FROM (SELECT DISTINCT u FROM ix) ORDER BY md5(u::VARCHAR), u LIMIT 100), own AS (SELECT * FROM ix WHERE u IN (SELECT u FROM chosen)), tops AS (SELECT i FROM own GROUP BY i ORDER BY count(*) DESC, i LIMIT 150) SELECT u, i, count(*) AS count FROM own WHERE i IN (SELECT i FROM tops) GROUP BY u, i")
def sample_matrix(spark, d):
    return S.sample_matrix(I.event_interactions(spark, d))


@query(f"WITH {IX}, c AS (SELECT i, count(*) AS count FROM ix GROUP BY i), r AS (SELECT count, row_number() OVER (ORDER BY count DESC, i) AS rank FROM c) SELECT k::INT AS n, round(sum(count) FILTER (rank <= k) / sum(count), 9) AS coverage FROM r, (VALUES (10), (50), (100), (500), (1000)) AS v(k) GROUP BY k HAVING k <= count(*)")
def topn_coverage(spark, d):
    return S.top_coverage(S.value_counts(I.order_interactions(spark, d), "i"), "i").withColumn("coverage", F.round("coverage", 9))


@query(f"WITH {IX}, c AS (SELECT u, count(*) AS count FROM ix GROUP BY u) SELECT count(*) AS n, round(avg(count), 6) AS mean, round(stddev_samp(count), 6) AS std, min(count) AS min, quantile_cont(count, 0.5) AS p50, quantile_cont(count, 0.75) AS p75, quantile_cont(count, 0.9) AS p90, quantile_cont(count, 0.95) AS p95, quantile_cont(count, 0.99) AS p99, max(count) AS max FROM c")
def describe_user_counts(spark, d):
    return S.describe_counts(S.value_counts(I.order_interactions(spark, d), "u")).withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query("SELECT 'text' AS \"column\", count(*) FILTER (text IS NULL) AS nulls FROM documents UNION ALL SELECT 'lang', count(*) FILTER (lang IS NULL) FROM documents UNION ALL SELECT 'source', count(*) FILTER (source IS NULL) FROM documents UNION ALL SELECT 'doc_id', count(*) FILTER (doc_id IS NULL) FROM documents UNION ALL SELECT 'n_chars', count(*) FILTER (n_chars IS NULL) FROM documents")
def null_counts(spark, d):
    return S.null_counts(spark.read.parquet(f"{d}/documents.parquet"))


@query("SELECT (count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM documents)))::BIGINT AS duplicates FROM documents")
def duplicate_count(spark, d):
    return S.duplicate_count(spark.read.parquet(f"{d}/documents.parquet"))


@query(f"WITH {IX} SELECT count(*) AS n_rows, count(DISTINCT u) AS n_users, count(DISTINCT i) AS n_items, round(count(*) / (count(DISTINCT u) * count(DISTINCT i)), 9) AS density, round(1 - count(*) / (count(DISTINCT u) * count(DISTINCT i)), 9) AS sparsity FROM ix")
def density(spark, d):
    return S.density(I.order_interactions(spark, d)).withColumns({"density": F.round("density", 9), "sparsity": F.round("sparsity", 9)})


@query(f"WITH {IX} SELECT min(t) AS t_min, max(t) AS t_max FROM ix")
def time_coverage(spark, d):
    return S.time_coverage(I.order_interactions(spark, d))


@query(f"WITH {IX}, a AS (SELECT count(*) AS n_rows, count(DISTINCT u) AS n_users, count(DISTINCT i) AS n_items, min(t) AS t_min, max(t) AS t_max FROM ix), b AS (SELECT count(DISTINCT p_partkey) AS n_metadata FROM part) SELECT n_rows, n_users, n_items, round(n_rows / (n_users * n_items), 9) AS density, t_min, t_max, n_metadata, '{{\"n_rows\":' || n_rows || ',\"n_users\":' || n_users || ',\"n_items\":' || n_items || ',\"t_min\":' || t_min || ',\"t_max\":' || t_max || ',\"n_metadata\":' || n_metadata || '}}' AS summary_json FROM a, b")
def summary_json(spark, d):
    return S.summary(I.order_interactions(spark, d), I.part_items(spark, d)).withColumn("density", F.round("density", 9))


@query(f"WITH {EV}, {ITEMS} SELECT count(*) AS n_items, count(items.i) AS n_with_metadata, round(count(items.i) / greatest(count(*), 1), 9) AS coverage FROM (SELECT DISTINCT i FROM ix) a LEFT JOIN items USING (i)")
def metadata_coverage(spark, d):
    return S.metadata_coverage(I.event_interactions(spark, d), I.part_items(spark, d)).withColumn("coverage", F.round("coverage", 9))


@query(f"WITH {IX} SELECT i, u, t FROM ix WHERE i NOT IN (SELECT vec_id FROM embeddings)")
def without_metadata(spark, d):
    vectors = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("i"))
    return S.without_metadata(I.order_interactions(spark, d), vectors)


@query(f"WITH {IX}, {SPLIT} SELECT count(*) AS n_targets, count(w.u) AS n_warm, count(*) - count(w.u) AS n_cold FROM (SELECT DISTINCT c_custkey AS u FROM customer) a LEFT JOIN (SELECT DISTINCT u FROM train) w USING (u)")
def warm_cold(spark, d):
    targets = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("u"))
    return S.warm_cold(targets, loading.train_part(I.order_interactions(spark, d)))


@query(f"WITH {IX}, {SPLIT} SELECT DISTINCT c_custkey AS u FROM customer WHERE c_custkey NOT IN (SELECT u FROM train) ORDER BY u LIMIT 10")
def cold_users(spark, d):
    targets = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("u"))
    return S.cold_users(targets, loading.train_part(I.order_interactions(spark, d)))


@query(f"WITH {IX} SELECT count(DISTINCT u) AS n_users, count(DISTINCT i) AS n_items, count(*) AS n_rows, round(count(*) / count(DISTINCT u), 9) AS rows_per_user FROM ix")
def kpis(spark, d):
    return S.kpis(I.order_interactions(spark, d)).withColumn("rows_per_user", F.round("rows_per_user", 9))


@query(f"WITH {EV}, ki AS (SELECT count(*) AS n FROM (SELECT p_partkey FROM part UNION SELECT i FROM ix)), ku AS (SELECT count(*) AS n FROM (SELECT c_custkey FROM customer UNION SELECT u FROM ix)) SELECT round(100 * (1 - count(*) / (any_value(ku.n) * any_value(ki.n))), 6) AS sparsity_pct, round(100 * count(DISTINCT i) / any_value(ki.n), 6) AS coverage_pct, round(100 * count(DISTINCT u) / any_value(ku.n), 6) AS active_pct FROM ix, ki, ku")
def sparsity_gauges(spark, d):
    users = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("u"))
    found = S.gauges(I.event_interactions(spark, d), I.part_items(spark, d), users)
    return found.select(*[F.round(c, 6).alias(c) for c in found.columns])


_UNITS = " UNION ALL ".join(f"SELECT {m} AS scale, t * {m} AS t FROM ix" for m in (1, 1000, 1_000_000))


@query(f"WITH {IX}, scaled AS ({_UNITS}), top AS (SELECT scale, max(t) AS largest FROM scaled GROUP BY scale) SELECT scale, strftime(make_timestamp((CASE WHEN largest > 1e12 THEN t WHEN largest > 1e10 THEN t * 1000 ELSE t * 1000000 END)::BIGINT), '%Y-%m-%d') AS day, count(*) AS count FROM scaled JOIN top USING (scale) GROUP BY 1, 2")
def epoch_days(spark, d):
    """Times in seconds, milliseconds and microseconds: the unit is told by the largest."""
    ix = I.order_interactions(spark, d)
    parts = [S.days(ix.withColumn("t", F.col("t") * m)).select(F.lit(m).alias("scale"), F.col("_t_dt").cast("string").alias("day"), "count") for m in (1, 1000, 1_000_000)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"WITH {IX}, {ITEMS} SELECT coalesce(Author, 'Inconnu') AS Author, count(*) AS count FROM ix LEFT JOIN items USING (i) GROUP BY 1 ORDER BY count DESC, Author LIMIT 15")
def top_authors(spark, d):
    return S.top_authors(I.order_interactions(spark, d), I.part_items(spark, d))


# ---- application
@query(f"WITH {IX}, {ITEMS}, own AS (SELECT i, t, (row_number() OVER (ORDER BY t DESC, i))::INT AS rank FROM ix WHERE u = 7) SELECT rank, own.i, t, Title, Author FROM own LEFT JOIN items USING (i) WHERE rank <= 10")
def user_history(spark, d):
    return app.user_history(I.order_interactions(spark, d), I.part_items(spark, d), 7)


@query(f"WITH {ITEMS} SELECT i, Title, Author, Subjects FROM items WHERE regexp_matches(lower(Title), 'red.*widget|brand#2') OR regexp_matches(lower(Author), 'red.*widget|brand#2') OR regexp_matches(lower(Subjects), 'red.*widget|brand#2') ORDER BY i LIMIT 20")
def search_items(spark, d):
    return app.search_items(I.part_items(spark, d), "red.*widget|brand#2").select("i", "Title", "Author", "Subjects")


@query(f"WITH {ITEMS} SELECT i, Title, Author, Subjects FROM items WHERE regexp_matches(lower(Title), '^(hot|blue) .*ring$') ORDER BY i LIMIT 20")
def search_titles(spark, d):
    """Titles by pattern; the first 20 are what the page shows."""
    return app.search_items(I.part_items(spark, d), "^(Hot|blue) .*ring$", columns=("Title",)).select("i", "Title", "Author", "Subjects")


@query(f"WITH {IX} SELECT DISTINCT u FROM ix WHERE contains(u::VARCHAR, '12') ORDER BY u LIMIT 100")
def search_users(spark, d):
    return app.search_users(I.order_interactions(spark, d), "12")


@query(f"WITH {ITEMS} SELECT i, Title FROM items ORDER BY i DESC LIMIT 10")
def catalogue_tail(spark, d):
    return app.catalogue_tail(I.part_items(spark, d)).select("i", "Title")


@query(f"WITH {ITEMS} SELECT i, CASE WHEN length(Title) > 8 THEN substring(Title, 1, 8) || '...' ELSE Title END AS short_title, substring(Subjects, 1, 5) || '...' AS short_subjects FROM items")
def display_titles(spark, d):
    return I.part_items(spark, d).select("i", cut(F.col("Title"), 8).alias("short_title"), cut(F.col("Subjects"), 5, always=True).alias("short_subjects"))


_NEAR = "SELECT i, (row_number() OVER (ORDER BY score DESC, i))::INT AS rank, score FROM best"


@query(f"WITH {VECS}, best AS (SELECT b.i, round(list_sum(list_transform(list_zip(a.e, b.e), lambda z: z[1] * z[2])), 6) + 0.0 AS score FROM vecs a, vecs b WHERE a.i = 5 AND b.i <> 5 ORDER BY score DESC, b.i LIMIT 10) {_NEAR}")
def similar_items(spark, d):
    return app.similar_items(I.item_vectors(spark, d), 5)


_QUERY = [round(((k * 37) % 64 - 31.5) / 32, 4) for k in range(64)]


@query(f"WITH {VECS}, q AS (SELECT {_QUERY}::DOUBLE[] AS q), best AS (SELECT i, round(list_sum(list_transform(list_zip(e, q), lambda z: z[1] * z[2])) / sqrt(list_sum(list_transform(q, lambda x: x * x))), 6) + 0.0 AS score FROM vecs, q ORDER BY score DESC, i LIMIT 10) {_NEAR}")
def semantic_search(spark, d):
    return app.nearest(I.item_vectors(spark, d), _QUERY)


def _index(spark: SparkSession, d: str) -> VectorIndex:
    """The items' vectors, indexed anew in the shared folder (an application opens one that is kept)."""
    return VectorIndex.build(I.item_vectors(spark, d), _folder(spark, "vector-index"))


@query(SQL["semantic_search"])
def indexed_search(spark, d):
    """As `semantic_search`, from the stored index."""
    length = sum(x * x for x in _QUERY) ** 0.5
    one = spark.createDataFrame([(0, [x / length for x in _QUERY])], "q_id long, q array<double>")
    return _index(spark, d).search(one)[0].select("i", "rank", "score")


@query(f"WITH {VECS}, pairs AS (SELECT a.i AS q_id, b.i, round(list_sum(list_transform(list_zip(a.e, b.e), lambda z: z[1] * z[2])), 6) + 0.0 AS score FROM vecs a, vecs b WHERE a.i % 100 = 5 AND b.i <> a.i), best AS (SELECT q_id, i, score, (row_number() OVER (PARTITION BY q_id ORDER BY score DESC, i))::INT AS rank FROM pairs) SELECT q_id, i, rank, score FROM best WHERE rank <= 10")
def indexed_similar_items(spark, d):
    """Items most similar to each of a shelf of items (every hundredth), from the stored index."""
    vectors = I.item_vectors(spark, d)
    shelf = vectors.where("i % 100 = 5").select(F.col("i").alias("q_id"), F.col("e").alias("q"), F.col("i").alias("own"))
    return _index(spark, d).search(shelf, without="own")[0]


@query()
def free_text_search(spark, d):
    """Free text for a user without a history, through word vectors learned from the catalogue."""
    items, text = I.part_items(spark, d), T.soup(F.col("Title"), F.col("Author"), F.col("Subjects"))
    return app.search_by_meaning(items, text, "a small red ring, polished brass", model=WordVectors.fit(items, text))


@query(f"WITH {IX}, {SPLIT}, {USERS}, {ITEMS}, {weights_sql(250)}, {TFIDF}, {COSINE}, {SCORES}, {dense_top()}, lists AS (SELECT u, string_agg(i::VARCHAR, ' ' ORDER BY rank) AS own FROM top GROUP BY u), pop AS (SELECT i, count(*) AS c FROM ix GROUP BY i ORDER BY c DESC, i LIMIT 10), fb AS (SELECT string_agg(i::VARCHAR, ' ' ORDER BY c DESC, i) AS fb FROM pop) SELECT c_custkey AS user_id, coalesce(own, fb) AS recommendation FROM customer LEFT JOIN lists ON u = c_custkey, fb")
def submission(spark, d):
    data = _data(spark, d)
    predicted = models.CosineRecommender(250).fit(data).predict(10)
    targets = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("user_id")).withColumn("ordinal", F.col("user_id"))
    return app.submission(predicted, targets, I.order_interactions(spark, d)).select("user_id", "recommendation")


@query(f"WITH {IX} SELECT i, count(*) AS count FROM ix GROUP BY i ORDER BY count DESC, i LIMIT 10")
def popular_items(spark, d):
    return app.popular_items(I.order_interactions(spark, d))


@query(f"WITH {IX}, {SPLIT}, {USERS}, {ITEMS}, {weights_sql(250)}, {TFIDF}, {COSINE}, {SCORES}, {dense_top()} SELECT top.i, Title, Author, rank FROM top LEFT JOIN items USING (i) WHERE u = 7")
def recommendation_list(spark, d):
    """One user's list as it is downloaded; the user is chosen before scoring."""
    data = _data(spark, d)
    one = Data(data.train, data.users.where("u = 7"), data.items, data.metadata)
    one.n_users = data.n_users
    return models.CosineRecommender(250).fit(one).predict(10).join(data.metadata, "i", "left").select("i", "Title", "Author", "rank")


_REASON = " || ".join(["CASE WHEN Author <> '' AND len(list_filter(t, lambda x: contains(x, lower(Author)))) > 0 THEN ' • You have read ' || Author ELSE '' END", *(f"CASE WHEN {' OR '.join(f"contains(lower(Subjects), '{w}')" for w in words)} THEN ' • {label}' ELSE '' END" for words, label in app.GENRES)])


@query(f"WITH {IX}, {SPLIT}, {USERS}, {ITEMS}, {weights_sql(250)}, {TFIDF}, {COSINE}, {SCORES}, {dense_top(20)}, read AS (SELECT DISTINCT i FROM ix WHERE u = 7), titles AS (SELECT coalesce(list(lower(Title)), []) AS t FROM read JOIN items USING (i)), own AS (SELECT top.i, rank, score, Title, Author, Subjects, row_number() OVER (PARTITION BY Author ORDER BY rank) AS nth FROM top JOIN items ON top.i = items.i WHERE u = 7 AND top.i NOT IN (SELECT i FROM read)), best AS (SELECT *, row_number() OVER (ORDER BY rank) AS place, {_REASON} AS why FROM own, titles WHERE nth <= 2) SELECT place::INT AS rank, i, score, Title, Author, CASE WHEN why = '' THEN 'Recommended for you' ELSE substr(why, 4) END AS reason FROM best WHERE place <= 10")
def recommend_user(spark, d):
    data = _data(spark, d)
    one = Data(data.train, data.users.where("u = 7"), data.items, data.metadata)
    one.n_users = data.n_users
    return app.recommend(models.CosineRecommender(250).fit(one).predict(20), I.order_interactions(spark, d), data.metadata, 7)


# ---- text
@query(f"WITH {ITEMS} SELECT i, Title || '. ' || Author || '. ' || Subjects AS soup, Title || ' ' || repeat(Author || ' ', 3) || repeat(Subjects || ' ', 2) AS weighted FROM items")
def text_soups(spark, d):
    return I.part_items(spark, d).select("i", T.soup(F.col("Title"), F.col("Author"), F.col("Subjects")).alias("soup"), T.weighted_soup().alias("weighted"))


@query(f"WITH {ITEMS} SELECT i, 'Titre: ' || Title || '. Auteur: ' || Author || '. Genre: ' || lower(Subjects) || '. Sujets: ' || Subjects || '. Résumé: ' AS soup FROM items")
def enriched_soup(spark, d):
    items = I.with_columns(I.part_items(spark, d).withColumns({"clean_author": F.col("Author"), "category": F.lower("Subjects")}), I.ENRICHED_COLUMNS)
    return items.select("i", T.enriched_soup().alias("soup"))


def _soup() -> Column:
    return T.soup(F.col("Title"), F.col("Author"), F.col("Subjects"))


def _level(n: int) -> str:
    """A level of the tree of hashes over the one below."""
    return f"l{n} AS (SELECT leaf >> 10 AS leaf, md5(string_agg(leaf || ':' || digest, ',' ORDER BY leaf)) AS digest FROM l{n - 1} GROUP BY leaf >> 10)"


@query(f"WITH {ITEMS}, l1 AS (SELECT i >> 10 AS leaf, md5(string_agg(i || ':' || md5(Title || '. ' || Author || '. ' || Subjects), ',' ORDER BY i)) AS digest FROM items GROUP BY i >> 10), {', '.join(_level(n) for n in range(2, 7))} SELECT md5(string_agg(leaf || ':' || digest, ',' ORDER BY leaf)) AS content_hash FROM l6")
def content_hash(spark, d):
    """The root of the tree of hashes over the items' texts."""
    return tree_hash(leaf_digests(item_digests(I.part_items(spark, d), _soup())))


@query(f"WITH {VECS} SELECT i, round(e[1], 9) AS first, round(list_sum(e), 6) + 0.0 AS total, 0::BIGINT AS encoded_again FROM vecs")
def embedding_cache(spark, d):
    """The items' vectors through the cache: filled once, then found unchanged."""
    cache, items = EmbeddingCache(spark, _folder(spark, "cache"), "given"), I.part_items(spark, d)
    fill = lambda some, text: I.item_vectors(spark, d).join(some.select("i"), "i", "left_semi")
    cache.update(items, _soup(), fill)
    again = cache.update(items, _soup(), fill)
    return cache.read().select("i", F.round(F.col("e")[0], 9).alias("first"), (F.round(F.aggregate("e", F.lit(0.0), lambda a, x: a + x), 6) + F.lit(0.0)).alias("total"), F.lit(again).cast("long").alias("encoded_again"))


@query(f"WITH {ITEMS}, tok AS (SELECT i, unnest(regexp_extract_all(lower(Title || '. ' || Author || '. ' || Subjects), '[a-z0-9_]{{2,}}')) AS term FROM items), tf AS (SELECT i, term, count(*) AS tf FROM tok WHERE term NOT IN ({_STOP}) GROUP BY i, term), dft AS (SELECT term, count(*) AS df FROM tf GROUP BY term HAVING count(*) >= 2), v AS (SELECT i, term, tf * (ln((1 + (SELECT count(*) FROM items)) / (1 + df)) + 1) AS v FROM tf JOIN dft USING (term)) SELECT i, term, round(v / sqrt(sum(v * v) OVER (PARTITION BY i)), 6) AS x FROM v")
def keyword_tfidf(spark, d):
    return models.keyword_tfidf(I.part_items(spark, d), T.soup(F.col("Title"), F.col("Author"), F.col("Subjects"))).withColumn("x", F.round("x", 6))


@query(f"WITH {ITEMS} SELECT i, 'ID:' || i || '|T:' || Title || '|A:' || Author AS line FROM items")
def prompt_lines(spark, d):
    return I.part_items(spark, d).select("i", T.prompt_line().alias("line"))


@query("WITH parts AS (SELECT p_partkey AS i, CASE WHEN p_partkey % 3 = 0 THEN 'kept' END AS description, p_brand AS clean_author, NULL::VARCHAR AS category FROM part) SELECT i, CASE WHEN i % 2 = 0 THEN coalesce(description, 'd' || i) ELSE description END AS description, clean_author, CASE WHEN i % 2 = 0 THEN 'c' || (i % 5) END AS category FROM parts")
def enrichment_fill(spark, d):
    items = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("i"), F.when(F.col("p_partkey") % 3 == 0, F.lit("kept")).alias("description"), F.col("p_brand").alias("clean_author"), F.lit(None).cast("string").alias("category"))
    entry = F.concat(F.lit('[{"id":"'), F.col("i").cast("string"), F.lit('","desc":"d'), F.col("i").cast("string"), F.lit('","auth":"x","cat":"c'), (F.col("i") % 5).cast("string"), F.lit('"}]'))
    answer = F.when(F.col("i") % 4 == 0, F.concat(F.lit('{"items":'), entry, F.lit("}"))).otherwise(entry)
    answered = items.where("i % 2 = 0").select(F.col("i").cast("string").alias("batch"), answer.alias("answer"))
    return enrichment.fill(items, enrichment.answers(answered))


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


__all__ = ["QUERIES", "oracle_sql", "latent", "Window"]
