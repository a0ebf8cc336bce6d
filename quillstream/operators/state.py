"""State transitions of jobs, runs and problem documents: tables and commands in, new row versions and events out.

A command names a job, an action and who asks.  `transition` applies one command a job by a join, `replay`
all commands of a batch in turn.
Writes are fenced: a command of an owner that no longer holds the lease changes nothing and leaves an
event.  Nothing here looks at the clock; `now` is a column, so a batch can be run again with equal results.

Job columns: job_id, status, phase, attempts, max_attempts, lease_owner, leased_until, last_error,
result_json, output_path, relay_status, relay_result, updated_at.  Command columns: job_id, action, owner,
attempt, message, retryable, status, phase, result_json, output_path, relay_result, lease_seconds (all but
the first two may be null or missing).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .jobs import failed_status, relay_status, within_budget

COMMAND = {
    "owner": "string", "attempt": "int", "message": "string", "retryable": "boolean", "status": "string", "phase": "string", "result_json": "string",
    "output_path": "string", "relay_result": "string", "lease_seconds": "int",
}
#: Actions that end an attempt, with the phase that they leave.
ENDS = {"succeed": "complete", "skip": "skipped", "fail": "failed", "defer": "deferred", "manual_review": "manual_review", "problem_document": "problem_document"}
#: Actions that only the holder of a lease may ask for.
HELD = ("heartbeat", "progress")


class Queue(NamedTuple):
    """What a kind of queue allows: its name in messages, and the statuses that retry and cancel start from."""

    name: str
    retried: tuple[str, ...]
    cancelled: tuple[str, ...]


# The three kinds of queues.
METADATA = Queue("metadata", ("failed_retryable", "failed_final", "skipped", "cancelled"), ("queued", "failed_retryable", "skipped"))
OCR = Queue("OCR", ("failed_retryable", "failed_final", "manual_review", "problem_document", "cancelled"), ("queued", "failed_retryable", "manual_review", "problem_document"))
HTML = Queue("HTML", ("failed_retryable", "failed_final", "cancelled", "needs_chunk_fallback"), ("queued", "failed_retryable", "needs_chunk_fallback"))


def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def later(now: Column, seconds: Column) -> Column:
    """A time so many seconds behind `now`."""
    return now + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def _applied(j: Callable[[str], Column], c: Callable[[str], Column], now: Column, queue: Queue) -> tuple[dict[str, Column], Column, Column]:
    """What a command makes of a job: its new values, the event and the event's message.

    `j` and `c` give the columns of the job and of the command.
    """
    action, is_ = c("action"), lambda *names: F.coalesce(c("action").isin(*names), F.lit(False))
    fenced = c("owner").isNotNull() | is_(*HELD)
    holds = (j("status") == "running") & (j("lease_owner") == F.trim(c("owner"))) & (j("leased_until") >= now) & (c("attempt").isNull() | (j("attempts") == c("attempt")))
    spent = F.coalesce((j("max_attempts") > 0) & (j("attempts") >= j("max_attempts")), F.lit(False))
    done = F.coalesce(
        F.when(is_(*ENDS, *HELD), ~fenced | F.coalesce(holds, F.lit(False)))
        .when(is_("retry"), j("status").isin(*queue.retried) & ~spent).when(is_("reset"), j("status").isin(*queue.retried))
        .when(is_("cancel"), j("status").isin(*queue.cancelled)).otherwise(False),
        F.lit(False),
    )
    ends, again = is_(*ENDS), is_("retry", "reset")
    status = (
        F.when(is_("succeed"), "succeeded").when(is_("skip"), "skipped").when(is_("fail"), failed_status(F.coalesce(c("retryable"), F.lit(False)), j("attempts"), j("max_attempts")))
        .when(is_("defer"), c("status")).when(is_("manual_review", "problem_document"), action).when(again, "queued").when(is_("cancel"), "cancelled").otherwise(j("status"))
    )
    phase = F.when(again, "queued").when(is_("cancel"), "cancelled").when(is_("progress"), c("phase"))
    for name, left in ENDS.items():
        phase = F.when(is_(name), left).otherwise(phase)
    extended = F.when(c("lease_seconds").isNotNull(), later(now, c("lease_seconds"))).otherwise(j("leased_until"))
    relayed = F.when(is_("succeed", "fail"), relay_status(c("relay_result"))).when(is_("skip"), "skipped").when(is_("defer"), "deferred").when(~again, j("relay_status"))
    changes = {
        "status": status, "phase": F.coalesce(phase, j("phase")),
        "attempts": F.when(is_("reset"), F.lit(0)).when(is_("defer"), F.greatest(j("attempts") - 1, F.lit(0))).otherwise(j("attempts")),
        "lease_owner": F.when(is_(*HELD), j("lease_owner")), "leased_until": F.when(is_(*HELD), extended),
        "last_error": F.when(is_("cancel", *HELD), j("last_error")).when(is_("skip", "fail", "defer", "manual_review", "problem_document"), c("message")),
        "result_json": F.when(is_("succeed", "skip", "fail"), c("result_json")).otherwise(j("result_json")),
        "output_path": F.when(is_("succeed"), F.coalesce(c("output_path"), j("output_path"))).otherwise(j("output_path")),
        "relay_status": relayed, "relay_result": F.when(is_("succeed", "fail", "defer"), c("relay_result")).when(~again, j("relay_result")), "updated_at": now,
    }
    stale = F.when(is_(*ENDS), "stale_completion_discarded").when(is_("progress"), "stale_progress_discarded").when(is_("retry") & spent, "retry_rejected_exhausted")
    event = (
        F.when(~done, stale).when(is_("cancel"), "cancelled").when(ends, status).when(is_("retry"), "retry")
        .when(is_("reset"), "retry_generation_reset").when(is_("progress"), "progress")
    )
    discarded = F.concat(F.lit(f"Stale {queue.name} job update was discarded: "), F.coalesce(F.concat(F.trim(c("owner")), F.lit(" does not hold the lease.")), F.lit("no lease.")))
    message = (
        F.when(~done & (ends | is_("progress")), discarded).when(~done, "The attempt budget is exhausted; a reset starts a new generation.").when(is_("retry"), "Returned to queue.")
        .when(is_("reset"), "Started a new retry generation.").when(is_("cancel"), "Cancelled.").otherwise(c("message"))
    )
    return {name: F.when(done, value).otherwise(j(name)) for name, value in changes.items()}, event, message


def _asked(commands: DataFrame, *more: str) -> DataFrame:
    """Commands with all their columns, missing ones as null."""
    return commands.select("job_id", "action", *[(F.col(c) if c in commands.columns else _null(t)).cast(t).alias(c) for c, t in COMMAND.items()], *more)


def transition(jobs: DataFrame, commands: DataFrame, now: Column, queue: Queue = METADATA) -> tuple[DataFrame, DataFrame]:
    """The jobs after one command each, and the events (job_id, event, message, created_at) that they leave.

    Commands on unknown jobs change nothing and leave no event.
    """
    absent = lambda name: F.col(f"j.{name}") if name in jobs.columns else _null(STATE[name])
    values, event, message = _applied(absent, lambda name: F.col(f"c.{name}"), now, queue)
    both = jobs.alias("j").join(_asked(commands).alias("c"), "job_id", "left")
    after = both.select(*[F.col("job_id") if name == "job_id" else values.get(name, F.col(f"j.{name}")).alias(name) for name in jobs.columns])
    events = both.select("job_id", event.alias("event"), message.alias("message"), now.alias("created_at")).filter("event is not null")
    return after, events


STATE = {
    "status": "string", "phase": "string", "attempts": "int", "max_attempts": "int", "lease_owner": "string", "leased_until": "timestamp_ntz", "last_error": "string", "result_json": "string",
    "output_path": "string", "relay_status": "string", "relay_result": "string", "updated_at": "timestamp_ntz",
}


def replay(jobs: DataFrame, commands: DataFrame, now: Column, order: str, queue: Queue = METADATA) -> tuple[DataFrame, DataFrame]:
    """The jobs after all of their commands in turn, and the events: one join, and one fold over each job's commands.

    The commands of a job come together in one row, so a call takes the commands of a batch, not a history.
    """
    fields = [name for name in STATE if name in jobs.columns]
    kinds = {name: jobs.schema[name].dataType.simpleString() if name in fields else kind for name, kind in STATE.items()}
    wanted = _asked(commands, order).groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_at"), "action", *COMMAND))).alias("_commands"))
    both = jobs.join(wanted, "job_id", "left")
    entry = "struct<event:string,message:string>"
    start = F.struct(*[(F.col(name) if name in fields else _null(kinds[name])).alias(name) for name in STATE], F.array().cast(f"array<{entry}>").alias("events"))

    def one(s: Column, c: Column) -> Column:
        values, event, message = _applied(lambda name: s[name], lambda name: c[name], now, queue)
        new = F.when(event.isNotNull(), F.array(F.struct(event.alias("event"), message.alias("message")))).otherwise(F.array().cast(f"array<{entry}>"))
        return F.struct(*[values.get(name, s[name]).cast(kinds[name]).alias(name) for name in STATE], F.concat(s["events"], new).alias("events"))

    folded = both.withColumn("_s", F.when(F.col("_commands").isNotNull(), F.aggregate("_commands", start, one)))
    after = folded.select(*[(F.when(F.col("_s").isNotNull(), F.col(f"_s.{name}")).otherwise(F.col(name)) if name in fields else F.col(name)).alias(name) for name in jobs.columns])
    events = folded.select("job_id", F.posexplode("_s.events").alias("_n", "_e")).select("job_id", "_e.event", "_e.message", now.alias("created_at"))
    return after, events


def lease(jobs: DataFrame, now: Column, owner: str, seconds: int, per: str = "job_type", count: int = 1) -> tuple[DataFrame, DataFrame]:
    """The jobs after recovery, exhaustion and the lease of the oldest `count` of each type, and the events.

    Expired leases return to the queue first; queued jobs without attempts left fail; of the rest the oldest
    are leased, ties by id.
    """
    jobs, recovered = recover_expired(jobs, now)
    spent = (F.col("status") == "queued") & ~within_budget(F.col("attempts"), F.col("max_attempts"))
    order = Window.partitionBy(per, F.col("_open")).orderBy("created_at", "job_id")
    ranked = jobs.withColumn("_spent", spent).withColumn("_open", (F.col("status") == "queued") & ~F.col("_spent"))
    ranked = ranked.withColumn("_taken", F.col("_open") & (F.row_number().over(order) <= count))
    given, owned = F.col("_taken"), F.lit(owner.strip())
    pick = lambda name, if_spent, if_taken: F.when(F.col("_spent"), if_spent).when(given, if_taken).otherwise(F.col(name))
    same = {name: F.col(name) for name in jobs.columns}
    after = ranked.select(
        *[
            {
                **same, "status": pick("status", F.lit("failed_final"), F.lit("running")), "phase": pick("phase", F.lit("failed"), F.lit("leased")), "attempts": F.col("attempts") + given.cast("int"),
                "lease_owner": F.when(given, owned).otherwise(F.col("lease_owner")), "leased_until": F.when(given, later(now, F.lit(seconds))).otherwise(F.col("leased_until")),
                "last_error": pick("last_error", F.coalesce("last_error", F.lit("Attempt budget exhausted before claim.")), _null("string")),
                "relay_status": F.when(~given, F.col("relay_status")), "relay_result": F.when(~given, F.col("relay_result")), "updated_at": F.when(F.col("_spent") | given, now).otherwise(F.col("updated_at")),
            }[name].alias(name)
            for name in jobs.columns
        ]
    )
    event = F.when(F.col("_spent"), "attempts_exhausted").when(given, "leased")
    message = F.when(F.col("_spent"), "Finalized because the attempt budget is exhausted.").otherwise(F.concat(F.lit("Leased by "), owned, F.lit(".")))
    events = ranked.select("job_id", event.alias("event"), message.alias("message"), now.alias("created_at")).filter("event is not null")
    return after, recovered.unionByName(events)


def _recovered(jobs: DataFrame, over: Column, now: Column, reason: str) -> tuple[DataFrame, DataFrame]:
    marked = jobs.withColumn("_over", F.coalesce(over, F.lit(False)))
    put = {"status": F.lit("queued"), "phase": F.lit("recovered"), "lease_owner": _null("string"), "leased_until": _null(jobs.schema["leased_until"].dataType.simpleString()), "last_error": F.lit(reason), "updated_at": now}
    after = marked.select(*[(F.when(F.col("_over"), put[name]).otherwise(F.col(name)) if name in put else F.col(name)).alias(name) for name in jobs.columns])
    events = marked.filter("_over").select("job_id", F.lit("recovered").alias("event"), F.lit(reason).alias("message"), now.alias("created_at"))
    return after, events


def recover_expired(jobs: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Running jobs whose lease is over return to the queue."""
    return _recovered(jobs, (F.col("status") == "running") & (F.col("leased_until") < now), now, "Recovered expired job lease.")


def recover_orphaned(jobs: DataFrame, alive: DataFrame, now: Column, owner: str = "owner") -> tuple[DataFrame, DataFrame]:
    """Running jobs of owners that are not in `alive` return to the queue, whatever their lease says.

    The owners come with a column of their own and are looked up by an anti join; a job that runs without
    an owner is not an orphan.
    """
    dead = jobs.filter((F.col("status") == "running") & F.col("lease_owner").isNotNull()).select(F.col("lease_owner").alias("_dead")).distinct()
    dead = dead.join(alive.select(F.col(owner).alias("_alive")).distinct(), F.col("_dead") == F.col("_alive"), "left_anti")
    marked = jobs.join(dead, (F.col("lease_owner") == F.col("_dead")) & (F.col("status") == "running"), "left")
    after, events = _recovered(marked, F.col("_dead").isNotNull(), now, "Recovered orphaned job lease.")
    return after.drop("_dead"), events


def append_events(log: DataFrame, events: DataFrame, entities: DataFrame, entity: str = "job_id", seq: str = "event_id") -> DataFrame:
    """Numbered new events of entities that exist; numbers go on behind the last of each entity.

    Numbers count within an entity, which a log is read and pruned by; they need no order over all rows.
    """
    known = events.join(entities.select(entity).distinct(), entity, "left_semi")
    last = log.groupBy(entity).agg(F.max(seq).alias("_last"))
    place = F.row_number().over(Window.partitionBy(entity).orderBy("created_at", "event", "message"))
    return known.join(last, entity, "left").withColumn(seq, (F.coalesce("_last", F.lit(0)) + place).cast("long")).drop("_last")


def latest_events(log: DataFrame, run: Column, limit: int = 100, seq: str = "event_id") -> DataFrame:
    """The last events of one run, newest first."""
    return log.filter(run).orderBy(F.col(seq).desc()).limit(min(1000, max(1, limit)))


# --- runs ------------------------------------------------------------------------------------------


def run_changes(runs: DataFrame, commands: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Runs after commands (run_id, action of heartbeat, update, finish or stop, status, phase, message), and events.

    Only a run that is running or stopping and not finished changes; a stop that was asked for already
    leaves no second event.
    """
    wanted = commands.select("run_id", "action", *[(F.col(c) if c in commands.columns else _null("string")).alias(c) for c in ("status", "phase", "message")])
    r, c = (lambda name: F.col(f"r.{name}")), (lambda name: F.col(f"c.{name}"))
    active = r("status").isin("running", "stopping") & r("finished_at").isNull()
    is_ = lambda *names: F.coalesce(c("action").isin(*names), F.lit(False))
    stops = is_("stop") & ((r("status") == "running") | ~r("stop_requested"))
    both = runs.alias("r").join(wanted.alias("c"), "run_id", "left").withColumn("_done", F.coalesce(active & (is_("heartbeat", "update", "finish") | stops), F.lit(False)))
    changes = {
        "status": F.when(is_("update", "finish"), F.coalesce(c("status"), r("status"))).when(is_("stop"), "stopping").otherwise(r("status")),
        "phase": F.when(is_("update", "finish"), F.coalesce(c("phase"), r("phase"))).otherwise(r("phase")), "stop_requested": is_("stop") | r("stop_requested"),
        "finished_at": F.when(is_("finish"), now).otherwise(r("finished_at")), "heartbeat_at": now, "updated_at": now,
    }
    after = both.select(*[F.col(n) if n == "run_id" else (F.when(F.col("_done"), changes[n]).otherwise(r(n)) if n in changes else r(n)).alias(n) for n in runs.columns])
    event = F.when(is_("stop"), "stop_requested").when(is_("finish"), "finished").when(is_("update") & c("message").isNotNull(), "updated")
    events = both.filter("_done").select("run_id", event.alias("event"), F.coalesce(c("message"), event).alias("message"), now.alias("created_at")).filter("event is not null")
    return after, events


# --- watched files and problem documents -----------------------------------------------------------


def unchanged(seen: DataFrame, stored: DataFrame, key: str, signature: Sequence[str] = ("source_size", "source_mtime_ns")) -> DataFrame:
    """`seen` with `unchanged`: whether the stored row of the key has the same signature."""
    old = stored.select(F.col(key), F.lit(True).alias("_known"), *[F.col(s).alias(f"_old_{s}") for s in signature])
    same = F.coalesce(F.col("_known"), F.lit(False))
    for s in signature:
        same = same & F.coalesce(F.col(s) == F.col(f"_old_{s}"), F.lit(False))
    return seen.join(old, key, "left").withColumn("unchanged", same).select(*seen.columns, "unchanged")


def watched(stored: DataFrame, sightings: DataFrame, now: Column) -> DataFrame:
    """Watched files after one sighting each: how often in a row unchanged, first and last seen.

    Files that are not seen stay as they are.
    """
    signature = ("source_size", "source_mtime_ns")
    told = [c for c in stored.columns if c in sightings.columns and c != "source_path"]
    new = sightings.select("source_path", *[F.col(c).alias(f"_new_{c}") for c in told], F.lit(True).alias("_seen"))
    both = stored.join(new, "source_path", "full")
    same = F.lit(True)
    for s in signature:
        same = same & F.coalesce(F.col(s) == F.col(f"_new_{s}"), F.lit(False))
    put = {c: F.col(f"_new_{c}") for c in told}
    put |= {
        "stable_seen_count": F.when(same, F.coalesce("stable_seen_count", F.lit(0)) + 1).otherwise(1), "first_seen_at": F.coalesce("first_seen_at", "updated_at", now),
        "last_seen_at": now, "updated_at": now,
    }
    return both.select(*[(F.when(F.col("_seen"), put[c]).otherwise(F.col(c)) if c in put else F.col(c)).alias(c) for c in stored.columns])


def record_problems(stored: DataFrame, found: DataFrame, now: Column, key: str = "source_path") -> DataFrame:
    """Problem documents after new findings, one a key: first seen stays, and what was resolved is open again."""
    told = [c for c in stored.columns if c in found.columns and c != key]
    new = found.select(key, *[F.col(c).alias(f"_new_{c}") for c in told], F.lit(True).alias("_seen"))
    put = {c: F.col(f"_new_{c}") for c in told}
    put |= {"first_seen_at": F.coalesce("first_seen_at", now), "last_seen_at": now, "resolved_at": _null(stored.schema["resolved_at"].dataType.simpleString())}
    both = stored.join(new, key, "full")
    return both.select(*[(F.when(F.col("_seen"), put[c]).otherwise(F.col(c)) if c in put else F.col(c)).alias(c) for c in stored.columns])


def resolve_problems(stored: DataFrame, resolved: DataFrame, now: Column, key: str = "source_path") -> DataFrame:
    """Problem documents after resolutions (key, reason); what is resolved already stays as it is."""
    both = stored.alias("s").join(resolved.select(key, F.col("reason").alias("_reason"), F.lit(True).alias("_told")).alias("n"), key, "left")
    hit = F.coalesce(F.col("_told"), F.lit(False)) & F.col("resolved_at").isNull()
    put = {"resolved_at": now, "reason": F.col("_reason"), "last_seen_at": now}
    marked = both.withColumn("_hit", hit)
    return marked.select(*[(F.when(F.col("_hit"), put[c]).otherwise(F.col(c)) if c in put else F.col(c)).alias(c) for c in stored.columns])


def open_problems(stored: DataFrame, statuses: Sequence[str] = (), limit: int = 100, key: str = "source_path") -> DataFrame:
    """Open problem documents, the last seen first."""
    open_ = stored.filter(F.col("resolved_at").isNull())
    open_ = open_.filter(F.col("problem_status").isin(*sorted(statuses))) if statuses else open_
    return open_.orderBy(F.col("last_seen_at").desc(), key).limit(limit)


def problem_summary(stored: DataFrame) -> DataFrame:
    """Open problems by status, and their total."""
    counts = stored.filter(F.col("resolved_at").isNull()).rollup("problem_status").agg(F.count(F.lit(1)).alias("n"), F.grouping("problem_status").alias("_all"))
    return counts.select(F.when(F.col("_all") == 1, "total").otherwise(F.col("problem_status")).alias("problem_status"), "n")


# --- maintenance -----------------------------------------------------------------------------------

RETENTION_DAYS, KEEP_PER_ENTITY = 14, 20
#: Seconds until the next maintenance, usually and with a backlog.
INTERVAL, BACKLOG_INTERVAL = 3600, 60


def prune(log: DataFrame, now: Column, entity: str = "job_id", seq: str = "event_id", at: str = "created_at", days: int = RETENTION_DAYS, keep: int = KEEP_PER_ENTITY) -> DataFrame:
    """The log without events older than `days` that are not among the newest `keep` of their entity.

    One pass does what batches would do in turn: their order is by age, and the rule does not depend on it.
    """
    place = F.row_number().over(Window.partitionBy(entity).orderBy(F.col(seq).desc()))
    old = F.col(at) < now - F.make_dt_interval(days=F.lit(max(1, days)))
    return log.withColumn("_n", place).filter(~(old & (F.col("_n") > max(0, keep)))).drop("_n")


def counts_of(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n): rows of each table."""
    parts = [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, t in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def maintenance(cursors: DataFrame, done: DataFrame, now: Column) -> DataFrame:
    """Maintenance cursors after what was done (maintenance_key, payload, has_more)."""
    wait = F.when(F.col("has_more"), F.lit(BACKLOG_INTERVAL)).otherwise(F.lit(INTERVAL))
    new = done.select("maintenance_key", later(now, wait).alias("next_run_at"), "payload", now.alias("updated_at"))
    return cursors.join(new.select("maintenance_key"), "maintenance_key", "left_anti").select(new.columns).unionByName(new)


def due(keys: DataFrame, cursors: DataFrame, now: Column) -> DataFrame:
    """Keys whose maintenance is due: never run, or the time of the next run has come."""
    waiting = cursors.filter(F.col("next_run_at") > now).select("maintenance_key")
    return keys.join(waiting, "maintenance_key", "left_anti")


RESULT_BYTES = 64 * 1024


def result_metrics(jobs: DataFrame, column: str = "result_json") -> DataFrame:
    """Rows, octets, largest and compacted ones of the stored results."""
    size = F.octet_length(column).cast("long")
    return jobs.filter(F.col(column).isNotNull()).agg(
        F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"), F.coalesce(F.max(size), F.lit(0)).cast("long").alias("max_bytes"), F.count_if(is_compacted(F.col(column))).alias("compacted_rows"),
    )


def is_compacted(result: Column) -> Column:
    return F.coalesce(result.startswith('{"_compacted":'), F.lit(False))


def compaction_candidates(jobs: DataFrame, most_bytes: int = RESULT_BYTES, column: str = "result_json") -> DataFrame:
    """Ended jobs whose result is larger than the limit and not compacted yet."""
    return jobs.filter(F.col("status").isin("succeeded", "skipped", "failed_final") & (F.octet_length(column) > most_bytes) & ~is_compacted(F.col(column)))


def compact_results(jobs: DataFrame, compact: Callable[[Column], Column], most_bytes: int = RESULT_BYTES, column: str = "result_json") -> tuple[DataFrame, DataFrame]:
    """Jobs with compacted results, and one row of totals: compacted, blocked, bytes before and behind.

    A result that compaction does not make smaller is blocked, and stays.
    """
    wanted = F.col("status").isin("succeeded", "skipped", "failed_final") & (F.octet_length(column) > most_bytes) & ~is_compacted(F.col(column))
    tried = jobs.withColumn("_new", F.when(wanted, compact(F.col(column))))
    smaller = F.coalesce(F.octet_length("_new") < F.octet_length(column), F.lit(False))
    tried = tried.withColumns({"_wanted": F.coalesce(wanted, F.lit(False)), "_smaller": smaller})
    old, new = (F.octet_length(c).cast("long") for c in (column, "_new"))
    totals = tried.agg(
        F.count_if("_smaller").alias("compacted_rows"), F.count_if(F.col("_wanted") & ~F.col("_smaller")).alias("blocked_rows"),
        F.coalesce(F.sum(F.when(F.col("_smaller"), old)), F.lit(0)).alias("original_bytes"), F.coalesce(F.sum(F.when(F.col("_smaller"), new)), F.lit(0)).alias("stored_bytes"),
    )
    after = tried.select(*[(F.when(F.col("_smaller"), F.col("_new")).otherwise(F.col(c)) if c == column else F.col(c)).alias(c) for c in jobs.columns])
    return after, totals


# --- libraries and their filters -------------------------------------------------------------------


def path_key(path: Column) -> Column:
    """A folder path in the form in which two are compared: forward slashes, no slash at the end, folded case."""
    clean = F.regexp_replace(F.regexp_replace(F.trim(path), r"\\", "/"), "/+", "/")
    return F.lower(F.when(F.length(clean) > 1, F.rtrim(clean, F.lit("/"))).otherwise(clean))


def library_aliases(configs: DataFrame, bindings: DataFrame) -> DataFrame:
    """(library_id, alias): a library under its own id, and under those of the bindings to the same data folder."""
    own = configs.select("library_id", F.col("library_id").alias("alias"))
    bound = bindings.select(path_key(F.col("data_dir")).alias("_dir"), F.col("binding_id").alias("alias"))
    other = configs.select("library_id", path_key(F.col("data_dir")).alias("_dir")).join(bound, "_dir").select("library_id", "alias")
    return own.unionByName(other).filter("alias is not null").distinct()


def allowed_parents(aliases: DataFrame, filters: Column) -> DataFrame:
    """(library_id, parent_key) that a filter map of library alias to parent keys allows, blank keys left out."""
    keys = F.transform(F.coalesce(F.element_at(filters, F.col("alias")), F.array().cast("array<string>")), F.trim)
    return aliases.select("library_id", F.explode(F.filter(keys, lambda k: k != "")).alias("parent_key")).distinct()


def result_window(results: DataFrame, order: Sequence[str], most: int = 1000) -> tuple[DataFrame, DataFrame]:
    """The first results, and one row that tells how many there are and how many were left out."""
    total = results.agg(F.count(F.lit(1)).alias("scanned"))
    return results.orderBy(*order).limit(most), total.select("scanned", F.greatest(F.col("scanned") - most, F.lit(0)).alias("omitted"))
