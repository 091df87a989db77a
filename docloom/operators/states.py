"""State machines over small state tables: build leases of an index artifact, and plans of file operations.

Each step maps a table of states to its next version and tells by a column whether it took effect; the caller writes that version.
As in any table without transactions, one writer at a time is the caller's duty (``foreachBatch`` gives it).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What may be executed, and how long leases and retired generations last.
OPERATIONS = ["move", "rename", "create"]
LEASE, RETAINED = "5 minutes", "10 minutes"
LEASE_FIELDS = ("active_build_token", "build_started_at", "lease_expires_at")


def _set(rows: DataFrame, when: Column, **values: Column) -> DataFrame:
    """``rows`` with new values where ``when`` holds, and ``took_effect``. Every value is of the row as it was."""
    types, when = dict(rows.dtypes), F.coalesce(when, F.lit(False))
    kept = [F.when(when, v.cast(types[c])).otherwise(F.col(c)).alias(c) if (v := values.get(c)) is not None else F.col(c) for c in rows.columns if c != "took_effect"]
    return rows.select(*kept, when.alias("took_effect"))


def _released(**more: Column) -> dict[str, Column]:
    return {c: F.lit(None) for c in LEASE_FIELDS} | more


def _of(name: str, token: str) -> Column:
    return (F.col("artifact_name") == name) & (F.col("active_build_token") == token)


def claim(artifacts: DataFrame, name: str, token: str, now: Column, reason: str) -> DataFrame:
    """Take the lease if no one holds it or the holder's has run out."""
    free = F.col("active_build_token").isNull() | F.col("lease_expires_at").isNull() | (F.col("lease_expires_at") < now)
    return _set(
        artifacts, (F.col("artifact_name") == name) & free, active_build_token=F.lit(token), build_started_at=now,
        lease_expires_at=now + F.expr(f"interval {LEASE}"), last_error=F.lit(None), last_reason=F.lit(reason),
    )


def complete(artifacts: DataFrame, name: str, token: str, now: Column, reason: str) -> DataFrame:
    """The holder commits: the next generation is ready and the lease is free."""
    done = _released(status=F.lit("ready"), generation=F.col("generation") + 1, last_error=F.lit(None), last_reason=F.lit(reason), last_built_at=now)
    return _set(artifacts, _of(name, token), **done)


def fail(artifacts: DataFrame, name: str, token: str, status: str, reason: str, error: str) -> DataFrame:
    """The holder gives up. An artifact that has a generation keeps its status: that generation is still readable."""
    return _set(artifacts, _of(name, token), **_released(status=F.when(F.col("generation") > 0, F.col("status")).otherwise(status), last_error=F.lit(error), last_reason=F.lit(reason)))


def expire(artifacts: DataFrame, now: Column, reason: str) -> DataFrame:
    """Leases that have run out are freed; an artifact that never had a generation becomes stale."""
    over = F.col("active_build_token").isNotNull() & (F.col("lease_expires_at") < now)
    return _set(artifacts, over, **_released(status=F.when(F.col("generation") > 0, F.col("status")).otherwise("stale"), last_reason=F.lit(reason)))


def retired(generations: DataFrame, completed: DataFrame, bundles: DataFrame, now: Column) -> DataFrame:
    """Generations after commits: of the artifacts that took effect in ``completed``, the committed generation is retained for
    a while and the new one, of ``bundles`` (artifact_name, bundle_path), is committed."""
    new = completed.where("took_effect").select("artifact_name", "generation").join(bundles, "artifact_name")
    marks = new.select("artifact_name", F.lit(True).alias("marked"))
    was = F.col("marked").isNotNull() & (F.col("state") == "committed")
    old = generations.join(marks, "artifact_name", "left").select(
        "artifact_name", "generation", "bundle_path", F.when(was, "retained").otherwise(F.col("state")).alias("state"),
        F.when(was, now + F.expr(f"interval {RETAINED}")).otherwise(F.col("delete_after")).alias("delete_after"),
    )
    return old.unionByName(new.select("artifact_name", "generation", "bundle_path", F.lit("committed").alias("state"), F.lit(None).cast("timestamp").alias("delete_after")))


def approve(plans: DataFrame, plan_id: str, now: Column) -> DataFrame:
    """Only drafts can be approved."""
    return _set(plans, (F.col("plan_id") == plan_id) & (F.col("status") == "draft"), status=F.lit("approved"), approved_at=now)


def executable() -> Column:
    return F.col("operation_type").isin(OPERATIONS) & (F.col("status") == "approved")


def executed(plans: DataFrame, plan_id: str, now: Column, execute: Callable[[dict], None], actor: str, trace_id: str) -> tuple[DataFrame, DataFrame]:
    """Run an approved plan; returns the plans and the audit row. A plan whose execution raises has failed, and its audit row says
    why. ValueError if there is no such plan or it can't be executed."""
    row = plans.where((F.col("plan_id") == plan_id) & executable()).first()
    if row is None:
        raise ValueError(f"no approved plan {plan_id} to move, rename or create")
    error = None
    try:
        execute(row.asDict())
    except Exception as e:  # whatever the operation raises is the plan's failure
        error = str(e)
    after = _set(plans, F.col("plan_id") == plan_id, status=F.lit("executed" if error is None else "failed"), executed_at=now)
    detail = F.lit("real").alias("execution_mode") if error is None else F.lit(error).alias("exec_error")
    audit = plans.sparkSession.range(1).select(
        F.expr("uuid()").alias("audit_id"), now.alias("timestamp"), F.lit(actor).alias("actor"), F.lit(f"{row.operation_type}_execute").alias("operation"),
        F.lit("plan").alias("target_type"), F.lit(plan_id).alias("target_id"), F.lit("success" if error is None else "failure").alias("result"),
        F.to_json(F.struct(detail)).alias("detail_json"), F.lit(trace_id).alias("trace_id"),
    )
    return after, audit
