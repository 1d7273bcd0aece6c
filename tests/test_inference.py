"""Replies that outlive the run which asked for them."""

import os
from pathlib import Path

import pytest

from snaplake.operators import enrich
from snaplake.storage import new_path


def calls(folder: Path) -> list[str]:
    return sorted(p.name.split("-")[0] for p in folder.iterdir())


def counting(folder: Path, dies_on: str = "", once: Path | None = None):
    """A model that leaves a file for each call; ``dies_on`` ends its worker until ``once`` is there."""

    def model(text: str) -> str | None:
        if text == dies_on and once and not once.exists():
            once.touch()
            os._exit(1)
        if text == "bad" and not (folder / "bad-seen").exists():
            (folder / "bad-seen").touch()
            raise RuntimeError("busy")
        (folder / f"{text}-{os.urandom(6).hex()}").touch()
        return None if text == "p3" else f"re {text}"

    return model


def test_a_lost_run_is_resumed(spark, tmp_path):
    """What a chunk has committed isn't asked again, however the run ended."""
    log, seen = new_path(spark, "replies"), tmp_path / "calls"
    seen.mkdir()
    rows = spark.createDataFrame([(i, f"p{i}") for i in range(40)], "id long, prompt string")
    model = counting(seen, "p17", tmp_path / "died")
    with pytest.raises(Exception, match="(?i)worker|crash|job aborted|exit"):
        enrich.infer_resumed(rows, "prompt", model, log, chunk=10)
    committed = {r["asked"] for r in spark.read.schema(enrich.LOG).parquet(log).collect()} if os.path.exists(log.removeprefix("file://")) else set()
    before = calls(seen)
    got = enrich.infer_resumed(rows, "prompt", model, log, chunk=10).collect()
    assert sorted((r["id"], r["r"]["result"]) for r in got) == [(i, None if i == 3 else f"re p{i}") for i in range(40)]
    after = calls(seen)
    again = {p for p in after if after.count(p) > 1}
    names = {r["asked"]: r["prompt"] for r in rows.selectExpr("sha2(prompt, 256) AS asked", "prompt").collect()}
    assert not again & {names[a] for a in committed} and len(again) < 20  # at most what the lost chunk had asked
    assert len(before) < 40 and set(after) == {f"p{i}" for i in range(40)}
    assert len(enrich.infer_resumed(rows, "prompt", model, log, chunk=10).collect()) == 40 and calls(seen) == after


def test_cases(spark, tmp_path):
    """Equal prompts are asked once, errors again by the next run, null prompts never; columns keep their names."""
    log, seen = new_path(spark, "replies"), tmp_path / "calls"
    seen.mkdir()
    rows = spark.createDataFrame([("a", "x"), ("b", "x"), ("b", "x"), ("bad", "y"), (None, "z"), ("", "e")], "asked string, run string")
    model = counting(seen)
    say = lambda df: sorted(("-" if r["asked"] is None else r["asked"], r["run"], r["r"]["result"], r["r"]["errorMessage"]) for r in df.collect())
    first = say(enrich.infer_resumed(rows, "asked", model, log))
    assert first == sorted([("a", "x", "re a", None), ("b", "x", "re b", None), ("b", "x", "re b", None), ("bad", "y", None, "busy"), ("-", "z", None, "no prompt"), ("", "e", "re ", None)])
    second = say(enrich.infer_resumed(rows, "asked", model, log))
    assert [r for r in second if r[0] == "bad"] == [("bad", "y", "re bad", None)] and len(second) == 6
    assert [c for c in calls(seen) if c in "ab"].count("b") == 1
    assert enrich.infer_resumed(rows.limit(0), "asked", model, new_path(spark, "none")).count() == 0


def test_a_chunk_reads_its_own_folder(spark, tmp_path):
    """Equal results for any size of chunk."""
    seen = tmp_path / "calls"
    seen.mkdir()
    rows = spark.range(40).selectExpr("id", "concat('q', id % 30) AS prompt")
    got = [sorted((r["id"], r["r"]["result"]) for r in enrich.infer_resumed(rows, "prompt", counting(seen), new_path(spark, "r"), chunk=c).collect()) for c in (7, 1000)]
    assert got[0] == got[1] == [(i, f"re q{i % 30}") for i in range(40)]
    assert len(calls(seen)) == 60
