"""Metadata enrichment by an external text model: batches, parsing, filling of gaps."""

from __future__ import annotations

import random
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorewell.functions.text import prompt_line
from lorewell.sources.scratch import discard, shared_folder, stored

ANSWER = "array<struct<id:string,desc:string,auth:string,cat:string>>"
ASKED = "batch string, ids array<bigint>, answer string, error string, tries int"
FIELDS = {"description": "desc", "clean_author": "auth", "category": "cat"}


def to_enrich(items: DataFrame) -> DataFrame:
    return items.where("description IS NULL")


def prompt_batches(items: DataFrame, size: int = 25) -> DataFrame:
    """(batch, ids, prompt): the lines of `size` items each, by place within partitions of the id range."""
    ranged = items.repartitionByRange("i").withColumn("p", F.spark_partition_id())
    placed = ranged.withColumn("b", F.floor((F.row_number().over(Window.partitionBy("p").orderBy("i")) - 1) / size))
    lines = placed.groupBy("p", "b").agg(F.array_sort(F.collect_list(F.struct("i", prompt_line().alias("line")))).alias("lines"))
    return lines.select(F.concat_ws("-", "p", "b").alias("batch"), F.transform("lines", lambda x: x["i"]).alias("ids"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("prompt"))


def parse_answer(answer: Column) -> Column:
    """The answer's entries: a list as it is, of an object the value of its first key, else none."""
    listed = F.from_json(answer, ANSWER)
    keyed = F.map_values(F.from_json(answer, f"map<string,{ANSWER}>"))
    found = F.when(F.trim(answer).startswith("["), listed).otherwise(F.try_element_at(keyed, F.lit(1)))
    return F.coalesce(found, F.array().cast(ANSWER))


def answers(answered: DataFrame) -> DataFrame:
    """(i, desc, auth, cat) of (batch, answer); entries whose id is no number are left out, of repeated ids the last counts."""
    rows = answered.select("batch", F.posexplode(parse_answer(F.col("answer"))).alias("n", "x")).select("batch", "n", F.expr("try_cast(x.id AS bigint)").alias("i"), "x.desc", "x.auth", "x.cat").where("i IS NOT NULL")
    return rows.groupBy("i").agg(*[F.max_by(c, F.struct("batch", "n")).alias(c) for c in ("desc", "auth", "cat")])


def fill(items: DataFrame, found: DataFrame) -> DataFrame:
    """Items with gaps filled; what is there already stays."""
    columns = [c for c in items.columns if c not in FIELDS]
    return items.join(found, "i", "left").select(*columns, *[F.coalesce(F.col(c), F.col(a)).alias(c) for c, a in FIELDS.items()])


def called(client: Callable[[str], str], prompt: str, tries: int = 1, pause: float = 1.0, wait: Callable[[float], None] = time.sleep) -> tuple[str | None, str | None, int]:
    """(answer, error, tries made): a failing call is made again after a pause that doubles, with a share of it by chance so that tasks do not call in step."""
    for n in range(1, tries + 1):
        try:
            return client(prompt), None, n
        except Exception as e:
            if n == tries:
                return None, f"{type(e).__name__}: {e}"[:500], n
            wait(pause * 2 ** (n - 1) * (1 + random.random() / 2))
    return None, "no try was allowed", 0


def ask(batches: DataFrame, client: Callable[[str], str], parallel: int = 10, tries: int = 1, pause: float = 1.0) -> DataFrame:
    """(batch, ids, answer, error, tries) by a client that takes a prompt and returns text, `parallel` calls at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            done = [called(client, p, tries, pause) for p in frame["prompt"]]
            yield pd.DataFrame({"batch": frame["batch"], "ids": frame["ids"], "answer": [x[0] for x in done], "error": [x[1] for x in done], "tries": [x[2] for x in done]})

    return batches.select("batch", "ids", "prompt").repartition(parallel).mapInPandas(run, ASKED)


class Ledger:
    """What a text model was asked and has answered, in a folder: a table for each wave of a run."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def rows(self) -> DataFrame:
        """(batch, ids, answer, error, tries, run, wave) of the waves that were written to their end."""
        schema = f"{ASKED}, run string, wave int"
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/run=*/wave=*/_SUCCESS")
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", self.folder).parquet(f"{self.folder}/run=*")

    def answered(self) -> DataFrame:
        """(i): items of batches that have an answer."""
        return self.rows().where("answer IS NOT NULL").select(F.explode("ids").alias("i")).distinct()

    def answers(self) -> DataFrame:
        """(i, desc, auth, cat) of all answers."""
        return answers(self.rows().where("answer IS NOT NULL").select(F.concat_ws("-", "run", "batch").alias("batch"), "answer"))

    def ask_missing(self, items: DataFrame, client: Callable[[str], str], size: int = 25, parallel: int = 10, tries: int = 3, pause: float = 1.0, wave: int = 400) -> int:
        """Asks for the items without a description that no answer covers, `wave` batches at a time, and returns how many batches were asked.

        Each wave is written when it has ended, so a run that is killed loses the wave in
        hand, and the next run asks for what is missing then, failed batches among it."""
        todo = to_enrich(items).join(self.answered(), "i", "left_anti")
        batches = stored(prompt_batches(todo, size), "prompts")  # as they are in this run, whatever is answered meanwhile
        n, run = batches.count(), uuid.uuid4().hex
        waves = -(-n // wave)
        for k in range(waves):
            some = batches.where(F.pmod(F.xxhash64("batch"), F.lit(waves)) == k)
            ask(some, client, parallel, tries, pause).write.parquet(f"{self.folder}/run={run}/wave={k}")
        discard(batches)
        return n


def enrich(items: DataFrame, client: Callable[[str], str], size: int = 25, ledger: str | None = None, **how) -> DataFrame:
    """Asks for all items without description and fills their gaps; a ledger's answers count, and are added to."""
    spark = items.sparkSession
    book = Ledger(spark, ledger or f"{shared_folder(spark)}/lorewell/ledger-{uuid.uuid4().hex}")
    book.ask_missing(items, client, size, **({"tries": 1} | how))
    return fill(items, book.answers())
