"""Model enrichment: once for each version of a record, failures apart from successes."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snaplake.operators.upsert import upsert_all
from snaplake.storage import drop_path, new_path, path_exists, stored

REPLY = "result string, errorMessage string"
# The fields that a model is asked for.
FIELDS = "title STRING, company STRING, location STRING, work_mode STRING, seniority STRING, years_min DOUBLE, must_have_skills ARRAY<STRING>, nice_to_have_skills ARRAY<STRING>, cloud ARRAY<STRING>, domain STRING, summary STRING"
MAX_CHARS, MAX_ATTEMPTS = 12_000, 3
#: Prompts of one chunk, which is what a lost job may ask again, and calls that one task has open at a time.
CHUNK, IN_FLIGHT = 20_000, 8
#: Prompts that a task holds as Python strings at a time; the others of an Arrow batch stay in Arrow's memory.
AT_ONCE = 64
LOG = "asked string, run long, result string, errorMessage string"


def gave_up(errors: DataFrame, version: str, model: str, attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Texts that failed ``attempts`` times with this prompt and model."""
    same = errors.where((F.col("prompt_version") == version) & (F.col("llm_model") == model))
    return same.groupBy("job_key", "text_hash").agg(F.count("*").alias("n")).where(F.col("n") >= attempts).select("job_key", "text_hash")


def candidates(texts: DataFrame, done: DataFrame, failed: DataFrame, version: str, model: str) -> DataFrame:
    """``job_key, text_hash, reason, given_up`` of the records whose fingerprint is new or has changed."""
    now = texts.select("job_key", F.col("text_hash") if "text_hash" in texts.columns else F.sha2("raw_text", 256).alias("text_hash"))
    old = done.select("job_key", F.col("text_hash").alias("old_hash"), "prompt_version", "llm_model", F.lit(True).alias("known"))
    rows = now.join(old, "job_key", "left").join(failed.withColumn("given_up", F.lit(True)), ["job_key", "text_hash"], "left")
    reason = (
        F.when(F.col("known").isNull(), "new")
        .when(~F.col("old_hash").eqNullSafe(F.col("text_hash")), "text_changed")
        .when(~F.col("prompt_version").eqNullSafe(F.lit(version)), "prompt_changed")
        .when(~F.col("llm_model").eqNullSafe(F.lit(model)), "model_changed")
    )
    return rows.select("job_key", "text_hash", reason.alias("reason"), F.coalesce("given_up", F.lit(False)).alias("given_up")).where(F.col("reason").isNotNull())


def batch_of(rows: DataFrame, limit: int, *then: Column) -> DataFrame:
    """The next records to send: new ones first.  A limit is the feature: it bounds the cost of a run."""
    return rows.where("NOT given_up").orderBy(F.desc(F.col("reason") == "new"), *then).limit(limit)


def prompt(instruction: str, text: str | Column, most: int = MAX_CHARS) -> Column:
    return F.concat(F.lit(instruction), F.left(F.col(text) if isinstance(text, str) else text, F.lit(most)))


def fingerprint(prompt_text: str, fields: str = FIELDS, schema: str = "") -> str:
    """A short name for all that shapes a model's answer: pin it in a test, so that a change of any of them changes the version too."""
    return hashlib.sha256("\x00".join((prompt_text, schema, fields)).encode()).hexdigest()[:12]


def infer(rows: DataFrame, column: str, model: Callable[[str], str | None], name: str = "replies") -> DataFrame:
    """``rows`` with ``r``: a reply or an error for each row, asked once.

    The result is a written table, since asking again would cost again and may answer differently.  Only the prompts leave the JVM.
    """

    return stored(rows.select("*", _asking(model, 1)(column).alias("r")), name)


def _asking(model: Callable[[str], str | None], in_flight: int) -> Callable[[str], Column]:
    """A column of replies, for which a task has at most ``in_flight`` calls open."""

    def reply(text: str) -> tuple[str | None, str | None]:
        try:
            return model(text), None
        except Exception as e:  # one bad row must not fail the batch
            return None, str(e) or type(e).__name__

    @F.arrow_udf(REPLY)
    def ask(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        with ThreadPoolExecutor(in_flight) as pool:
            for batch in batches:
                said = [r for i in range(0, len(batch), AT_ONCE) for r in pool.map(reply, batch.slice(i, AT_ONCE).to_pylist())]
                yield pa.StructArray.from_arrays([pa.array([r[k] for r in said], pa.string()) for k in (0, 1)], ["result", "errorMessage"])

    return ask.asNondeterministic()


def infer_resumed(rows: DataFrame, column: str, model: Callable[[str], str | None], log: str, chunk: int = CHUNK, in_flight: int = IN_FLIGHT) -> DataFrame:
    """``rows`` with ``r``, as :func:`infer` gives it, through a log of replies that outlives this run.

    Replies are kept in ``log`` (a path) under their prompt's hash.  What the log has a reply for isn't asked; the rest is asked by chunks of some ``chunk``
    prompts, each of which is one write over all executors.  So a run that dies has lost what its last chunk asked, and the next run goes on from there.

    Cases: equal prompts are asked once; a prompt whose reply was an error is asked again by the next run, and the later reply counts; a reply of None is a
    reply; a null prompt isn't asked and has the error ``no prompt``; ``rows`` keep their repeats and columns, none of which is ``r``; without rows nothing is asked.
    The log serves one prompt version and model: another one has another path.
    """
    spark = rows.sparkSession
    replies = lambda: spark.read.schema(LOG).parquet(log) if path_exists(spark, log) else spark.createDataFrame([], LOG)
    run = (replies().agg(F.max("run")).first()[0] or 0) + 1
    hashes = rows.where(F.col(column).isNotNull()).select(F.sha2(column, 256).alias("asked"))
    known = replies().where("errorMessage IS NULL").select("asked")
    chunks = -(-hashes.distinct().join(known, "asked", "left_anti").count() // chunk)
    if chunks:
        prompts = rows.where(F.col(column).isNotNull()).select(F.sha2(column, 256).alias("asked"), F.col(column).alias("prompt"))
        todo = prompts.join(known, "asked", "left_anti").groupBy("asked").agg(F.any_value("prompt").alias("prompt")).withColumn("chunk", F.pmod(F.xxhash64("asked"), F.lit(chunks)))
        path = new_path(spark, "prompts")
        todo.repartition("chunk").write.option("compression", "zstd").partitionBy("chunk").parquet(path)
        for folder in range(chunks):  # each reads its own folder alone
            some = spark.read.schema("asked string, prompt string, chunk long").parquet(path).where(F.col("chunk") == folder)
            # the calls are the work: they go to all executors
            asked = some.repartition("asked").select("asked", F.lit(run).cast("long").alias("run"), _asking(model, in_flight)("prompt").alias("r"))
            asked.select("asked", "run", "r.*").write.mode("append").parquet(log)
        drop_path(spark, path)
    width = 1 + max(map(len, rows.columns))
    key, said = "k" * width, "s" * width  # longer than any name of the rows
    last = replies().groupBy(F.col("asked").alias(key)).agg(F.max_by(F.struct("result", "errorMessage"), F.struct(F.col("errorMessage").isNull(), "run")).alias(said))
    none = F.struct(F.lit(None).cast("string").alias("result"), F.lit("no prompt").alias("errorMessage"))
    met = rows.withColumn(key, F.sha2(column, 256)).join(last, key, "left")
    return met.select(*rows.columns, F.when(F.col(key).isNull(), none).otherwise(F.col(said)).alias("r"))


def parsed(replies: DataFrame, fields: str = FIELDS) -> DataFrame:
    """``j`` and ``error``: what the model said by the declared fields, and why it can't be used (null: it can).

    Broken JSON parses to a struct of nulls; the corrupt-record field tells it from an answer.
    """
    j = F.from_json("r.result", fields + ", _corrupt_record STRING", {"columnNameOfCorruptRecord": "_corrupt_record"})
    rows = replies.withColumn("j", j)
    error = F.when(F.col("r.errorMessage").isNotNull(), F.col("r.errorMessage")).when(F.col("j").isNull(), "empty response").when(F.col("j._corrupt_record").isNotNull(), "response was not valid JSON")
    return rows.withColumn("error", error)


def store(done: DataFrame, answers: DataFrame) -> DataFrame:
    """The next version of the stored successes; storing the same answers again changes nothing."""
    return upsert_all(done, answers.where("error IS NULL").select(*done.columns), "job_key")


def failures(answers: DataFrame, version: str, model: str, at: Column) -> DataFrame:
    """Rows for the failure log."""
    return answers.where("error IS NOT NULL").select("job_key", "error", at.alias("failed_at"), "text_hash", F.lit(version).alias("prompt_version"), F.lit(model).alias("llm_model"))
