"""A queue of review jobs as relational steps: enqueue once, supersede, claim, finish, retry, reclaim.

State changes are new versions of rows by a single writer per step; ``streaming.jobs`` drives them from a stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: States, attempts before a job fails, characters kept of an error, minutes of a lease.
STATES = ("pending", "running", "done", "failed", "superseded")
MOST_ATTEMPTS = 3
ERROR_LENGTH = 2000
LEASE_MINUTES = 30


def delivery_key(delivery: str, owner: str, repo: str, number: str, sha: str):
    """The delivery's id, or ``owner/repo#n@sha`` where it is null or empty."""
    made = F.concat(F.col(owner), F.lit("/"), F.col(repo), F.lit("#"), F.col(number).cast("string"), F.lit("@"), F.col(sha))
    return F.coalesce(F.nullif(F.col(delivery), F.lit("")), made)


def enqueued(deliveries: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key by order; later ones are duplicates."""
    return deliveries.groupBy(key).agg(F.min_by(F.struct(*deliveries.columns), F.struct(*order)).alias("x")).select("x.*")


def superseded(jobs: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Jobs with ``next_delivery`` and state: a pending job of which the same ``by`` has a later one is superseded."""
    later = F.lead("delivery_id").over(W.partitionBy(*by).orderBy(*order))
    marked = jobs.withColumn("next_delivery", later)
    marked = marked.withColumn("_gone", (F.col("state") == "pending") & F.col("next_delivery").isNotNull())
    by_later = F.when(F.col("_gone"), F.col("next_delivery")).otherwise(F.col("superseded_by"))
    return marked.withColumn("superseded_by", by_later).withColumn("state", F.when(F.col("_gone"), "superseded").otherwise(F.col("state"))).drop("_gone")


def claimed(jobs: DataFrame, now) -> DataFrame:
    """The oldest pending job, as running with one attempt more; no row when none waits."""
    first = jobs.where("state = 'pending'").orderBy("created_at", "id").limit(1)
    return first.withColumn("state", F.lit("running")).withColumn("attempts", F.col("attempts") + 1).withColumn("claimed_at", now)


def finished(jobs: DataFrame, results: DataFrame, now) -> DataFrame:
    """Running jobs with the outcome of ``results(id, result_run, error)``: done with the run, or by ``failed`` rules."""
    after = jobs.where("state = 'running'").join(results, "id")
    ok = F.col("error").isNull()
    again = F.when(F.col("attempts") >= MOST_ATTEMPTS, "failed").otherwise("pending")
    return (
        after.withColumn("state", F.when(ok, "done").otherwise(again))
        .withColumn("run_id", F.when(ok, F.col("result_run")).otherwise(F.col("run_id")))
        .withColumn("last_error", F.when(~ok, F.left("error", F.lit(ERROR_LENGTH))).otherwise(F.col("last_error")))
        .withColumn("finished_at", F.when(F.col("state").isin("done", "failed"), now).otherwise(F.col("finished_at")))
        .drop("result_run", "error")
    )


def reclaimed(jobs: DataFrame, now, minutes: int = LEASE_MINUTES) -> DataFrame:
    """Jobs of which those running since before the lease wait again."""
    stale = (F.col("state") == "running") & (F.col("claimed_at") < now - F.make_dt_interval(mins=F.lit(minutes)))
    return jobs.withColumn("stale", F.coalesce(stale, F.lit(False))).withColumn("state", F.when(F.col("stale"), "pending").otherwise(F.col("state")))


def checked_states(jobs: DataFrame) -> DataFrame:
    """Jobs, or an error naming the first unknown state when the rows are read."""
    known = F.col("state").isin(*STATES)
    return jobs.withColumn("state", F.when(known, F.col("state")).otherwise(F.raise_error(F.concat(F.lit("unknown state: "), F.coalesce("state", F.lit("null"))))))
