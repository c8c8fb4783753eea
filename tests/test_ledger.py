"""Asking a text model with a ledger: what is answered stays, a killed run goes on, failures are tried again."""

import pytest

from lorewell.plans import enrichment


def items(spark, n=60):
    return spark.createDataFrame([(k, f"T{k}", None, "old" if k % 10 == 0 else None, None, None) for k in range(n)], "i long, Title string, Author string, description string, clean_author string, category string")


def Client(log, stop=0, fail=""):  # noqa: N802
    """A client that answers each line, writes down what it was asked, and stops or fails where it is told to."""
    log = str(log)

    def call(prompt):
        import os

        ids = [line.split("|")[0][3:] for line in prompt.splitlines()]
        if stop and os.path.exists(log) and len(open(log).read().splitlines()) >= stop:
            raise SystemExit("killed")
        with open(log, "a") as f:
            f.write(" ".join(ids) + "\n")
        if fail in ids:
            raise RuntimeError("429")
        return "[" + ",".join(f'{{"id": "{k}", "desc": "d{k}", "auth": "a", "cat": "c"}}' for k in ids) + "]"

    return call


def asked(log):
    return sorted(int(k) for line in log.read_text().splitlines() for k in line.split())


def test_a_killed_run_goes_on(spark, tmp_path):
    log, ledger = tmp_path / "log", enrichment.Ledger(spark, str(tmp_path / "ledger"))
    wanted = [k for k in range(60) if k % 10]
    with pytest.raises(Exception):  # noqa: B017
        ledger.ask_missing(items(spark), Client(log, stop=9), size=4, parallel=2, wave=3)
    done = sorted(r["i"] for r in ledger.answered().collect())
    assert 0 < len(done) < len(wanted)
    log.write_text("")
    ledger.ask_missing(items(spark), Client(log), size=4, parallel=2, wave=3)
    assert asked(log) == sorted(set(wanted) - set(done))
    log.write_text("")
    assert ledger.ask_missing(items(spark), Client(log), size=4) == 0 and asked(log) == []
    got = {r["i"]: r["description"] for r in enrichment.fill(items(spark), ledger.answers()).collect()}
    assert got == {k: f"d{k}" if k % 10 else "old" for k in range(60)}


def test_failed_batches_are_asked_again(spark, tmp_path):
    log, folder = tmp_path / "log", str(tmp_path / "ledger")
    out = enrichment.enrich(items(spark), Client(log, fail="7"), size=1, ledger=folder, tries=2, pause=0.001)
    assert {r["i"] for r in out.where("description IS NULL").collect()} == {7} and asked(log).count(7) == 2 and asked(log).count(8) == 1
    bad = enrichment.Ledger(spark, folder).rows().where("answer IS NULL").collect()
    assert [(r["ids"], r["error"], r["tries"]) for r in bad] == [([7], "RuntimeError: 429", 2)]
    log.write_text("")
    out = enrichment.enrich(items(spark), Client(log), size=1, ledger=folder)
    assert asked(log) == [7] and out.where("description IS NULL").count() == 0


def test_pauses_double():
    waits = []
    answer = enrichment.called(lambda p: 1 / 0, "x", 4, 1.0, waits.append)
    assert answer[0] is None and answer[1].startswith("ZeroDivisionError") and answer[2] == 4
    assert [1 <= w / 2**n < 1.5 for n, w in enumerate(waits)] == [True] * 3
    calls = []
    assert enrichment.called(lambda p: calls.append(p) or ("ok" if len(calls) == 3 else 1 / 0), "x", 5, 0.0, waits.append) == ("ok", None, 3)
