"""Fitted recommenders that are kept: saved to a folder, loaded in another session without fitting, and as pyspark.ml Estimator and Model."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.operators.latent import RAW, Blocks, Ease
from lorewell.operators.scoring import ItemSide, Sparse
from lorewell.plans import models

#: Bytes of an array that are one row of the stored table.
CHUNK = 8 << 20
#: What a fitted model may hold besides numbers, texts, lists, tables and arrays.
KINDS = {
    c.__name__: c
    for c in (
        models.Data, ItemSide, Sparse, models.SvdSide, Ease, Blocks, models.CosineRecommender, models.BM25Recommender, models.HistoryFilterRecommender, models.LowInteractionRecommender,
        models.DiversifiedRecommender, models.SequentialRecommender, models.PopularityRecommender, models.EnsembleRecommender, models.EASERecommender, models.SVDRecommender, models.LogSVDRecommender,
    )
}


class _Packer:
    """A fitted model as a plain description, its tables and its arrays (each once)."""

    def __init__(self):
        self.frames: list[DataFrame] = []
        self.arrays: list[np.ndarray] = []
        self.known: dict[int, dict] = {}
        self.keep: list[object] = []  # so that no id is used twice

    def pack(self, x: object) -> object:
        if x is None or isinstance(x, (bool, int, float, str)):
            return x
        if isinstance(x, np.generic):
            return x.item()
        if id(x) in self.known:
            return self.known[id(x)]
        if isinstance(x, DataFrame):
            self.frames.append(x)
            out = {"frame": len(self.frames) - 1}
        elif isinstance(x, np.ndarray):
            self.arrays.append(x)
            out = {"array": len(self.arrays) - 1}
        elif isinstance(x, (list, tuple)):
            return {"tuple" if isinstance(x, tuple) else "list": [self.pack(y) for y in x]}
        elif isinstance(x, dict):
            return {"dict": [[self.pack(k), self.pack(v)] for k, v in x.items()]}
        elif type(x).__name__ in KINDS:
            return {"kind": type(x).__name__, "state": {k: self.pack(v) for k, v in vars(x).items()}}
        else:
            raise TypeError(f"a {type(x).__name__} cannot be saved")
        self.known[id(x)] = out
        self.keep.append(x)
        return out


def _unpack(x: object, frames: list[DataFrame], arrays: list[np.ndarray]) -> object:
    if not isinstance(x, dict):
        return x
    (name, value), *_ = x.items()
    if name == "frame":
        return frames[value]
    if name == "array":
        return arrays[value]
    if name in ("list", "tuple"):
        return (tuple if name == "tuple" else list)(_unpack(y, frames, arrays) for y in value)
    if name == "dict":
        return {_unpack(k, frames, arrays): _unpack(v, frames, arrays) for k, v in value}
    out = object.__new__(KINDS[value])
    out.__dict__.update({k: _unpack(v, frames, arrays) for k, v in x["state"].items()})
    return out


def _chunks(arrays: list[np.ndarray]) -> Iterator[tuple]:
    for n, a in enumerate(arrays):
        data = np.ascontiguousarray(a).tobytes()
        for k in range(0, max(1, len(data)), CHUNK):
            yield n, k // CHUNK, a.dtype.str, list(a.shape), data[k : k + CHUNK]


def save(model: models.Recommender, folder: str) -> None:
    """Writes a fitted model: a table of each table it holds (equal ones once), one of its arrays, and its description last, so that what is there without it is no model.

    Arrays are what a fit keeps on the driver, so within what may be broadcast."""
    packer = _Packer()
    description = json.dumps(packer.pack(model))
    spark = (packer.frames[0] if packer.frames else model.data.train).sparkSession
    for n, frame in enumerate(packer.frames):
        frame.write.options(**(RAW if ("a", "binary") in frame.dtypes else {})).parquet(f"{folder}/frames/{n}")  # blocks of a matrix: few to a file
    columns = list(zip(*_chunks(packer.arrays), strict=True)) or [[]] * 5
    kinds = (pa.int32(), pa.int32(), pa.string(), pa.list_(pa.int64()), pa.binary())
    table = pa.table({c: pa.array(list(x), k) for c, x, k in zip(("n", "k", "dtype", "shape", "data"), columns, kinds, strict=True)})
    spark.createDataFrame(table).write.parquet(f"{folder}/arrays")
    spark.createDataFrame([(description,)], "description string").coalesce(1).write.parquet(f"{folder}/description")


def load(spark: SparkSession, folder: str) -> models.Recommender:
    """The model as it was saved; its tables are read where they are, nothing is fitted again."""
    description = json.loads(spark.read.parquet(f"{folder}/description").first()["description"])
    found: dict[int, list] = {}
    for r in spark.read.parquet(f"{folder}/arrays").orderBy("n", "k").toLocalIterator():
        found.setdefault(r["n"], []).append(r)
    arrays = [np.frombuffer(b"".join(bytes(r["data"]) for r in rows), rows[0]["dtype"]).reshape(rows[0]["shape"]).copy() for _, rows in sorted(found.items())]
    numbers: set[int] = set()

    def tables(x: object) -> None:
        for y in x.values() if isinstance(x, dict) else x if isinstance(x, list) else ():
            tables(y)
        if isinstance(x, dict) and list(x) == ["frame"]:
            numbers.add(x["frame"])

    tables(description)
    frames = [spark.read.parquet(f"{folder}/frames/{n}") for n in range(max(numbers, default=-1) + 1)]
    return _unpack(description, frames, arrays)


class _Shared(Params):
    name = Param(Params._dummy(), "name", "the model, one of MODELS", typeConverter=TypeConverters.toString)
    k = Param(Params._dummy(), "k", "recommendations for each user", typeConverter=TypeConverters.toInt)


class RankingEstimator(Estimator, _Shared, MLWritable, MLReadable):
    """Fits one of MODELS on interactions (u, i, t); `metadata` and `vectors` are tables and not saved with it."""

    def __init__(self, name: str = "cosine", k: int = 10, metadata: DataFrame | None = None, vectors: DataFrame | None = None):
        super().__init__()
        self.metadata, self.vectors = metadata, vectors
        self._set(name=name, k=k)

    def _fit(self, dataset: DataFrame) -> RankingModel:
        data = models.Data(dataset.select("u", "i", "t"), dataset, dataset, self.metadata, self.vectors)
        return RankingModel(models.MODELS[self.getOrDefault("name")]().fit(data))._set(name=self.getOrDefault("name"), k=self.getOrDefault("k"))

    def write(self) -> MLWriter:
        return DefaultParamsWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return DefaultParamsReader(cls)


class RankingModel(Model, _Shared, MLWritable, MLReadable):
    """A fitted recommender; `transform` gives (u, i, rank, score) of the given users (u), those unknown to it left out."""

    def __init__(self, recommender: models.Recommender | None = None):
        super().__init__()
        self.recommender = recommender

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.recommender.predict(self.getOrDefault("k")).join(dataset.select("u").distinct(), "u", "left_semi")

    def write(self) -> MLWriter:
        return _ModelWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ModelReader()


class _ModelWriter(MLWriter):
    def __init__(self, model: RankingModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        save(self.model.recommender, f"{path}/recommender")
        row = [(self.model.uid, self.model.getOrDefault("name"), self.model.getOrDefault("k"))]
        self.sparkSession.createDataFrame(row, "uid string, name string, k int").coalesce(1).write.parquet(f"{path}/params")


class _ModelReader(MLReader):
    def load(self, path: str) -> RankingModel:
        spark = self.sparkSession
        row = spark.read.parquet(f"{path}/params").select("uid", "name", F.col("k")).first()
        model = RankingModel(load(spark, f"{path}/recommender"))
        model._resetUid(row["uid"])
        return model._set(name=row["name"], k=row["k"])
