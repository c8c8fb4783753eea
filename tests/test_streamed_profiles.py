"""The streamed state equals the batch operators, with late rows and after a restart."""

import numpy as np
import pytest

from lorewell.operators import profiles
from lorewell.streaming import profiles as streamed


def test_state_equals_batch_with_late_rows_and_a_restart(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = list({(int(u), int(i), float(t)) for u, i, t in zip(rng.integers(0, 6, 300), rng.integers(0, 8, 300), rng.integers(0, 50, 300) * 86_400.0 + 1.7e9, strict=True)})
    rows.append((7, 1, 1.7e9))
    order = rng.permutation(len(rows))  # in no order of time at all
    schema = "u long, i long, t double"

    def feed(some, name):
        spark.createDataFrame([rows[k] for k in some], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        assert streamed.start(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint", 10).awaitTermination(120)

    def check(some):
        table = spark.createDataFrame([rows[k] for k in some], schema)
        changes = spark.read.schema(streamed.CHANGES).parquet(f"{tmp_path}/out")
        want = {(r["u"], r["i"]): r["w"] for r in profiles.decayed(table, 10).collect()}
        got = {(r["u"], r["i"]): r["w"] for r in streamed.current_profiles(changes, 10).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want)
        pairs = lambda df: {(r["i"], r["next_i"]): (r["n"], pytest.approx(r["score"])) for r in df.collect()}
        assert pairs(streamed.current_transitions(changes)) == pairs(profiles.transitions(table))

    feed(order[:100], "a")
    check(order[:100])
    feed(order[100:], "b")  # a new query that goes on from the checkpoint
    check(order)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def test_replay_in_batches(spark):
    rows = [(1, k % 3, 1000.0 * k) for k in range(40)] + [(2, 5, 3.0)]
    table = spark.createDataFrame(rows, "u long, i long, t double")
    changes = streamed.replayed(table, 5)
    assert changes.where("u = 1").agg({"seq": "max"}).first()[0] > 1
    want = {(r["u"], r["i"]): r["w"] for r in profiles.decayed(table, 5).collect()}
    assert {(r["u"], r["i"]): pytest.approx(r["w"]) for r in streamed.current_profiles(changes, 5).collect()} == want


def test_state_is_asked_a_few_times_for_a_user_and_batch():
    import pandas as pd

    calls = []

    class State(dict):
        def __getattr__(self, name):
            def call(*args):
                calls.append(name)
                if name in ("get", "exists", "iterator"):
                    return iter(()) if name == "iterator" else None
                return self.__setitem__(*args) if name == "updateValue" else self.get(*args) if name == "getValue" else False

            return call

    class Handle:
        def __getattr__(self, name):
            return lambda *_: State()

    processor = streamed.ProfileProcessor(10)
    processor.init(Handle())
    steps = {}
    for batch in ([(t, t % 7) for t in range(1000, 1500)], [(t, t % 7) for t in range(0, 500)], [(t, t % 7) for t in range(1500, 1600)]):
        calls.clear()
        frame = pd.DataFrame({"u": 3, "t": [float(t) for t, _ in batch], "i": [i for _, i in batch]})
        for out in processor.handleInputRows((0,), iter([frame]), None):
            for r in out[out.kind == "step"].itertuples():
                steps[r.i, r.next_i] = steps.get((r.i, r.next_i), 0) + r.value
        assert len(calls) <= 4
    path = [t % 7 for t in (*range(500), *range(1000, 1600))]
    assert {k: v for k, v in steps.items() if v} == {(a, b): sum((x, y) == (a, b) for x, y in zip(path, path[1:], strict=False)) for a, b in zip(path, path[1:], strict=False)}
