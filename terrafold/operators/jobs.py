"""Jobs: idempotent creation, the state machine as a fold over events, retries and review actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: State that each event needs, and state that it leads to.
TRANSITIONS = {
    "start": ("QUEUED", "PROCESSING"),
    "complete": ("PROCESSING", "COMPLETED"),
    "retry": ("PROCESSING", "QUEUED"),
    "fail": ("PROCESSING", "FAILED"),
    "cancel": ("QUEUED", "CANCELLED"),
    "recover": ("FAILED", "QUEUED"),
}
#: Actions on a review task, and job types that can be tried again.
REVIEW_ACTIONS = ("APPROVE", "CORRECT", "REJECT", "REPROCESS", "COMMENT", "ESCALATE")
RETRYABLE = ("DOCUMENT_AI_PROCESS", "DOCUMENT_REVALIDATE", "PARCEL_IMPORT", "BUILDING_VECTORIZE", "IMAGERY_REGISTER")


def create_or_get(existing: DataFrame, requests: DataFrame, key: list[str], order: str) -> DataFrame:
    """Requests to append: the first of each key, unless the key is there already."""
    first = requests.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(order))).filter("_n = 1").drop("_n")
    return first.join(existing.select(*key), key, "left_anti")


def step(state: Column, event: Column) -> Column:
    """The state after an event; the state itself where the event isn't allowed."""
    out = state
    for name, (needs, leads) in TRANSITIONS.items():
        out = F.when((event == name) & (state == needs), leads).otherwise(out)
    return out


def allowed(state: Column, event: Column) -> Column:
    ok = F.lit(False)
    for name, (needs, _) in TRANSITIONS.items():
        ok = ok | ((event == name) & (state == needs))
    return ok


#: Bits of a run's rows, and of the runs that one round of composition takes.
RUN_BITS = 12
STATES = ("QUEUED", "PROCESSING", "COMPLETED", "FAILED", "CANCELLED")


def _outcome(start: Column, status: Column, retry_count: Column, illegal: Column) -> Column:
    return F.struct(start.alias("start"), status.alias("status"), retry_count.alias("retry_count"), illegal.alias("illegal"))


def fold_states(events: DataFrame, key: str, order: list[str], event: str, run_bits: int = RUN_BITS) -> DataFrame:
    """(key, status, retry_count, progress, illegal): each job's events folded in order from QUEUED.

    A key may have any number of events. Where none has more than 2**run_bits (they are counted first), each key is one run, folded
    from QUEUED. Else events are range-partitioned by key and order and numbered, and each run of at most
    2**run_bits is folded from every state that it may start in. Runs are composed in rounds, as many at a time, so no array holds
    more than that, or in the last round one entry for each 2**(3 * run_bits) events and each partition. An event without a name is illegal.
    """

    def fold(acc, e):
        def one(a):
            kind, now = e["_event"], a["status"]
            ok = allowed(now, kind)
            return _outcome(a["start"], step(now, kind), a["retry_count"] + (ok & kind.isin("retry", "recover")).cast("int"), a["illegal"] + (~ok).cast("int"))

        return F.transform(acc, one)

    def outcome(folded: DataFrame) -> DataFrame:
        progress = F.when(F.col("s.status") == "COMPLETED", 100).when(F.col("s.status").isin("PROCESSING", "FAILED"), 1).otherwise(0)
        return folded.select(key, F.element_at("_ends", 1).alias("s")).select(key, "s.status", "s.retry_count", progress.alias("progress"), "s.illegal")

    fresh = F.array(*(_outcome(F.lit(s), F.lit(s), F.lit(0), F.lit(0)) for s in STATES))
    longest = events.groupBy(key).count().agg(F.max("count")).first()[0] or 0
    if longest <= 1 << run_bits:
        listed = events.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, F.coalesce(F.col(event), F.lit("")).alias("_event")))).alias("_listed"))
        return outcome(listed.select(key, F.aggregate("_listed", F.slice(fresh, 1, 1), fold).alias("_ends")))
    parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = events.select(key, *order, F.coalesce(F.col(event), F.lit("")).alias("_event")).repartitionByRange(parts, key, *order).sortWithinPartitions(key, *order, "_event")
    at = rows.select(key, "_event", F.monotonically_increasing_id().alias("_at"))

    def compose(acc, e):
        def one(a):
            then = F.element_at(F.filter(e["_ends"], lambda m: m["start"] == a["status"]), 1)
            return _outcome(a["start"], then["status"], a["retry_count"] + then["retry_count"], a["illegal"] + then["illegal"])

        return F.transform(acc, one)

    def round_(rows: DataFrame, of: str, bits: int | None, merge) -> DataFrame:
        keys = [key] if bits is None else [key, F.shiftright("_at", bits).alias("_run")]
        listed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_at", of))).alias("_listed"))
        return listed.select(key, F.element_at("_listed", 1)["_at"].alias("_at"), F.aggregate("_listed", fresh, merge).alias("_ends"))

    runs = round_(at, "_event", run_bits, fold)
    for k in (2, 3):
        runs = round_(runs, "_ends", min(33, k * run_bits), compose)
    return outcome(round_(runs, "_ends", None, compose))


def active_document_jobs(details: DataFrame, jobs: DataFrame) -> DataFrame:
    """(document_id, job_id, status): each document's newest job that is queued or being processed.

    details: job_id, document_id, created_at; jobs: job_id, status.
    """
    open_ = details.join(jobs.filter(F.col("status").isin("QUEUED", "PROCESSING")).select("job_id", "status"), "job_id")
    return open_.groupBy("document_id").agg(F.max_by(F.struct("job_id", "status"), F.struct("created_at", "job_id")).alias("_j")).select("document_id", "_j.*")


def queue_documents(requests: DataFrame, documents: DataFrame, results: DataFrame, details: DataFrame, jobs: DataFrame) -> DataFrame:
    """Requests (request_id, document_id, reprocess) with outcome, job_id, version and key.

    ACTIVE with the job that runs already; DOCUMENT_NOT_FOUND; NOT_QUEUEABLE for a first run of a document that is neither uploaded nor
    failed; NO_EARLIER_RESULT for another run of one that was never read; EXISTING if a job has the key; else QUEUED. Of a document's
    requests that could be queued the first by request_id is, the others are ACTIVE without a job_id yet. version is one above the newest
    reading's; the key document:<id>:ocr:<version> makes a repeated request find its job. jobs: job_id, status, idempotency_key.
    """
    newest = results.groupBy("document_id").agg(F.max("version").alias("_read"))
    running = active_document_jobs(details, jobs).select("document_id", F.col("job_id").alias("_running"))
    rows = requests.join(documents.select("document_id", F.col("status").alias("_status")), "document_id", "left").join(newest, "document_id", "left").join(running, "document_id", "left")
    rows = rows.withColumn("version", F.coalesce("_read", F.lit(0)) + 1).withColumn("key", F.concat(F.lit("document:"), F.col("document_id").cast("string"), F.lit(":ocr:"), F.col("version").cast("string")))
    rows = rows.join(jobs.select(F.col("idempotency_key").alias("key"), F.col("job_id").alias("_keyed")), "key", "left")
    fresh = ~F.coalesce(F.col("reprocess"), F.lit(False))
    refused = (
        F.when(F.col("_status").isNull(), "DOCUMENT_NOT_FOUND").when(F.col("_running").isNotNull(), "ACTIVE").when(fresh & ~F.col("_status").isin("UPLOADED", "FAILED"), "NOT_QUEUEABLE")
        .when(~fresh & F.col("_read").isNull(), "NO_EARLIER_RESULT").when(F.col("_keyed").isNotNull(), "EXISTING")
    )
    rows = rows.withColumn("_refused", refused)
    first = rows.filter("_refused IS NULL").groupBy("document_id").agg(F.min("request_id").alias("_first"))
    outcome = F.coalesce("_refused", F.when(F.col("_first") == F.col("request_id"), "QUEUED").otherwise("ACTIVE"))
    rows = rows.join(first, "document_id", "left").withColumn("outcome", outcome)
    made = F.col("outcome").isin("QUEUED", "EXISTING")
    job = F.when(F.col("outcome") == "ACTIVE", F.col("_running")).when(F.col("outcome") == "EXISTING", F.col("_keyed"))
    return rows.select("request_id", "document_id", "outcome", job.alias("job_id"), F.when(made, F.col("version")).alias("version"), F.when(made, F.col("key")).alias("key"))


def task_history(logs: DataFrame) -> DataFrame:
    """(task_id, position, action, actor_id, created_at): what was done with each review task, numbered from 1 by time and id."""
    mine = logs.filter("target_type = 'review_task'")
    position = F.row_number().over(Window.partitionBy("target_id").orderBy("created_at", "id"))
    return mine.select(F.col("target_id").alias("task_id"), position.alias("position"), "action", "actor_id", "created_at")


def retryable(jobs: DataFrame) -> DataFrame:
    """Jobs with has_error and retryable flags; error details stay behind."""
    return jobs.withColumn("has_error", F.col("error_json").isNotNull()).withColumn("retryable", (F.col("status") == "FAILED") & F.col("job_type").isin(*RETRYABLE)).drop("error_json")


def review_outcomes(actions: DataFrame) -> DataFrame:
    """Each review action with `refusal` (null if it holds), `status_after` and `resolution`.

    Columns: status, action, reason, correction_reference, reprocess_job_project, project_id, assignee_id, blocking_issue_count.
    """
    from ..functions.text import is_blank

    act = F.upper("action")
    no_reason = is_blank(F.col("reason"))
    refusal = (
        F.when(~act.isin(*REVIEW_ACTIONS), "UNSUPPORTED_ACTION")
        .when(F.col("status") != "OPEN", "ALREADY_RESOLVED")
        .when((act == "APPROVE") & (F.col("blocking_issue_count") > 0), "BLOCKING_ISSUES")
        .when((act != "APPROVE") & no_reason, "REASON_REQUIRED")
        .when((act == "CORRECT") & is_blank(F.col("correction_reference")), "CORRECTION_REQUIRED")
        .when((act == "REPROCESS") & ~F.coalesce(F.col("reprocess_job_project") == F.col("project_id"), F.lit(False)), "JOB_REQUIRED")
        .when((act == "ESCALATE") & F.col("assignee_id").isNull(), "ASSIGNEE_REQUIRED")
    )
    closes = act.isin("APPROVE", "REJECT", "REPROCESS")
    judged = actions.withColumn("refusal", refusal)
    done = F.col("refusal").isNull() & closes
    return judged.withColumn("status_after", F.when(done, "RESOLVED").otherwise(F.col("status"))).withColumn("resolution", F.when(done, act))
