"""Model enrichment over documents, with a model that is arithmetic."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from snaplake.operators import enrich as e
from snaplake.queries.registry import Source, query, text_dates
from snaplake.storage import new_path

VERSION, MODEL = "v1", "m1"
INSTRUCTION = "Name the requirements of this text; leave out what it does not say.\n\n"
NOW = "d AS (SELECT doc_id AS job_key, text, sha256(text) AS text_hash FROM {documents})"
STORED = "st AS (SELECT job_key, CASE WHEN job_key % 4 = 2 THEN 'old' ELSE text_hash END AS text_hash, CASE WHEN job_key % 12 = 4 THEN 'v0' ELSE 'v1' END AS prompt_version, CASE WHEN job_key % 8 = 1 THEN 'm0' ELSE 'm1' END AS llm_model FROM d WHERE job_key % 4 < 3)"
FAILED = "gu AS (SELECT job_key, text_hash FROM d WHERE job_key % 4 = 3 AND job_key % 5 = 0)"


def _texts(s: Source):
    return s["documents"].select(F.col("doc_id").alias("job_key"), F.col("text").alias("raw_text"), F.sha2("text", 256).alias("text_hash"))


def _candidates(s: Source):
    d, k = _texts(s), F.col("job_key")
    done = d.where(k % 4 < 3).select("job_key", F.when(k % 4 == 2, "old").otherwise(F.col("text_hash")).alias("text_hash"), F.when(k % 12 == 4, "v0").otherwise(VERSION).alias("prompt_version"), F.when(k % 8 == 1, "m0").otherwise(MODEL).alias("llm_model"))
    log = d.where((k % 4 == 3) & (k % 5 < 2)).select("job_key", "text_hash", F.lit(VERSION).alias("prompt_version"), F.lit(MODEL).alias("llm_model"), F.explode(F.sequence(F.lit(1), F.when(k % 5 == 0, 3).otherwise(2))).alias("n"))
    return e.candidates(d, done, e.gave_up(log, VERSION, MODEL), VERSION, MODEL)


@query("extract_candidates", f"WITH {NOW}, {STORED}, {FAILED} SELECT d.job_key, d.text_hash, CASE WHEN st.job_key IS NULL THEN 'new' WHEN st.text_hash <> d.text_hash THEN 'text_changed' WHEN st.prompt_version <> 'v1' THEN 'prompt_changed' ELSE 'model_changed' END AS reason, gu.job_key IS NOT NULL AS given_up FROM d LEFT JOIN st USING (job_key) LEFT JOIN gu ON d.job_key = gu.job_key AND d.text_hash = gu.text_hash WHERE st.job_key IS NULL OR st.text_hash <> d.text_hash OR st.prompt_version <> 'v1' OR st.llm_model <> 'm1'")
def _(s: Source):
    return _candidates(s)


@query("priority_batch", f"WITH {NOW}, {STORED}, {FAILED}, x AS (SELECT d.job_key, CASE WHEN st.job_key IS NULL THEN 'new' WHEN st.text_hash <> d.text_hash THEN 'text_changed' WHEN st.prompt_version <> 'v1' THEN 'prompt_changed' ELSE 'model_changed' END AS reason FROM d LEFT JOIN st USING (job_key) WHERE (st.job_key IS NULL OR st.text_hash <> d.text_hash OR st.prompt_version <> 'v1' OR st.llm_model <> 'm1') AND d.job_key NOT IN (SELECT job_key FROM gu)) SELECT * FROM x ORDER BY reason = 'new' DESC, job_key DESC LIMIT 150")
def _(s: Source):
    return e.batch_of(_candidates(s), 150, F.desc("job_key")).select("job_key", "reason")


def arithmetic_model(text: str) -> str | None:
    """A reply that depends on the number in front of the text: an error, nothing, broken JSON or an answer."""
    k = int(text.split(":", 1)[0])
    if k % 17 == 0:
        raise RuntimeError("model is busy")
    if k % 31 == 0:
        return None
    reply = json.dumps({"title": f"t{k}", "years_min": k % 12, "must_have_skills": ["a", f"s{k % 5}"], "domain": "d"})
    return reply[:20] if k % 23 == 0 else reply


def _prompts(s: Source):
    return _texts(s).select("job_key", "text_hash", F.concat(F.col("job_key").cast("string"), F.lit(":"), e.prompt(INSTRUCTION, "raw_text")).alias("prompt"))


def _replies(s: Source):
    return e.infer(_prompts(s), "prompt", arithmetic_model, "enrichment")


@query("infer_stub", "SELECT doc_id AS job_key, doc_id % 17 <> 0 AND doc_id % 31 <> 0 AS replied, CASE WHEN doc_id % 17 = 0 THEN 'model is busy' END AS error FROM {documents}")
def _(s: Source):
    return _replies(s).select("job_key", F.col("r.result").isNotNull().alias("replied"), F.col("r.errorMessage").alias("error"))


ANSWERS = "an AS (SELECT doc_id AS k, CASE WHEN doc_id % 17 = 0 THEN 'model is busy' WHEN doc_id % 31 = 0 THEN 'empty response' WHEN doc_id % 23 = 0 THEN 'response was not valid JSON' END AS error FROM {documents})"


@query("parse_split", f"WITH {ANSWERS} SELECT k AS job_key, error, CASE WHEN error IS NULL THEN concat('t', k) END AS title, CASE WHEN error IS NULL THEN CAST(k % 12 AS DOUBLE) END AS years_min, CASE WHEN error IS NULL THEN concat('a|s', k % 5) END AS skills FROM an")
def _(s: Source):
    good = F.col("error").isNull()
    rows = e.parsed(_replies(s))
    return rows.select("job_key", "error", F.when(good, F.col("j.title")).alias("title"), F.when(good, F.col("j.years_min")).alias("years_min"), F.when(good, F.array_join("j.must_have_skills", "|")).alias("skills"))


@query("enrich_twice", f"WITH {ANSWERS} SELECT k AS job_key, concat('t', k) AS title, sha256(text) AS text_hash FROM an JOIN {{documents}} ON k = doc_id WHERE error IS NULL")
def _(s: Source):
    answers = e.parsed(_replies(s)).select("job_key", "error", F.col("j.title").alias("title"), "text_hash")
    empty = s.spark.createDataFrame([], "job_key long, title string, text_hash string")
    return e.store(e.store(empty, answers), answers)


@query("enrich_failures", f"WITH {ANSWERS} SELECT k AS job_key, error, 'v1' AS prompt_version FROM an WHERE error IS NOT NULL")
def _(s: Source):
    answers = e.parsed(_replies(s))
    return text_dates(e.failures(answers, VERSION, MODEL, F.current_timestamp()).select("job_key", "error", "prompt_version"))


def _model_of(run: str):
    """A model that says which run asked it, and fails on some prompts in the first."""

    def model(text: str) -> str:
        if run == "first" and int(text.split(":", 1)[0]) % 17 == 0:
            raise RuntimeError("model is busy")
        return run

    return model


@query("infer_resumed", "SELECT doc_id AS job_key, CASE WHEN doc_id % 3 > 0 AND doc_id % 17 > 0 THEN 'first' ELSE 'second' END AS asked_by FROM {documents}")
def _(s: Source):
    """A first run sees two thirds of the rows and fails on some; the second sees all rows, and asks what has no reply."""
    log = new_path(s.spark, "replies")
    rows = _prompts(s)
    e.infer_resumed(rows.where("job_key % 3 > 0"), "prompt", _model_of("first"), log)
    return e.infer_resumed(rows, "prompt", _model_of("second"), log).select("job_key", F.col("r.result").alias("asked_by"))
