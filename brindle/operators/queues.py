"""Queues, caches and schedules as questions about a table of records at an explicit instant ``as_of``.

No clock is read: the same table and instant always give the same answer, in batch and in a stream's foreachBatch.
A message has id, and where it matters queue, priority, enqueued_at, visible_at, expires_at, attempt_count,
max_receives and dedup_id. Missing columns count as null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _at(as_of) -> Column:
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")


def _has(df: DataFrame, name: str, kind: str = "timestamp") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


# ---- queues


def with_state(messages: DataFrame, as_of) -> DataFrame:
    """messages with state: expired, dead (received as often as allowed), in_flight, available or delayed, in this order."""
    now = _at(as_of)
    tries = F.coalesce(_has(messages, "attempt_count", "int"), F.lit(0))
    visible = F.coalesce(_has(messages, "visible_at"), now) <= now
    state = (
        F.when(_has(messages, "expires_at") <= now, "expired")
        .when(visible & (tries >= _has(messages, "max_receives", "int")), "dead")
        .when(visible, "available")
        .when(tries > 0, "in_flight")
        .otherwise("delayed")
    )
    return messages.withColumn("state", state)


def state_counts(messages: DataFrame, as_of) -> DataFrame:
    """A row a queue: available, in_flight, delayed, dead, expired and total."""
    counts = [F.count_if(F.col("state") == s).alias(s) for s in ("available", "in_flight", "delayed", "dead", "expired")]
    return with_state(messages, as_of).groupBy("queue").agg(*counts, F.count(F.lit(1)).alias("total"))


def enqueued(messages: DataFrame, as_of, delay_seconds: int = 0) -> DataFrame:
    """New messages, visible after their delay; of those with one dedup_id the first by id stays."""
    out = messages.withColumn("enqueued_at", _at(as_of)).withColumn("attempt_count", F.lit(0))
    out = out.withColumn("visible_at", _at(as_of) + F.make_dt_interval(secs=F.lit(delay_seconds)))
    if "dedup_id" in messages.columns:
        own = F.coalesce(F.col("dedup_id").cast("string"), F.concat(F.lit("\u0000"), F.col("id").cast("string")))
        first = out.groupBy(own.alias("_d")).agg(F.min("id").alias("id")).select("id")
        out = out.join(first, "id", "left_semi")
    return out


def dequeue(messages: DataFrame, as_of, n: int) -> DataFrame:
    """The next n available messages: higher priority first, then longer waiting, then smaller id."""
    ready = with_state(messages, as_of).where(F.col("state") == "available").drop("state")
    first = _has(messages, "priority", "int")
    return ready.orderBy(F.coalesce(first, F.lit(0)).desc(), _has(messages, "enqueued_at").asc_nulls_last(), "id").limit(n)


def after_receive(messages: DataFrame, received: DataFrame, as_of, timeout_seconds: int) -> DataFrame:
    """messages after those in received (id) were handed out: hidden until the timeout, one attempt more."""
    got = received.select("id").withColumn("_got", F.lit(True))
    out = messages.join(got, "id", "left")
    hit = F.coalesce("_got", F.lit(False))
    until = _at(as_of) + F.make_dt_interval(secs=F.lit(timeout_seconds))
    return (
        out.withColumn("visible_at", F.when(hit, until).otherwise(F.col("visible_at")))
        .withColumn("attempt_count", F.col("attempt_count") + F.when(hit, 1).otherwise(0))
        .drop("_got")
    )


def acknowledged(messages: DataFrame, acks: DataFrame) -> DataFrame:
    """messages without those acknowledged by id."""
    return messages.join(acks.select("id"), "id", "left_anti")


def returned(messages: DataFrame, nacks: DataFrame, as_of) -> DataFrame:
    """messages with those in nacks (id) visible at once."""
    back = nacks.select("id").withColumn("_back", F.lit(True))
    now = F.when(F.col("_back"), _at(as_of)).otherwise(F.col("visible_at"))
    return messages.join(back, "id", "left").withColumn("visible_at", now).drop("_back")


def swept(messages: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """(live messages, dead letters): the expired go, the dead are set apart."""
    all_of = with_state(messages, as_of)
    live = all_of.where(~F.col("state").isin("expired", "dead")).drop("state")
    return live, all_of.where(F.col("state") == "dead").drop("state")


def aged_priority(priority: Column, since: Column, as_of, max_wait: str, highest: int = 3) -> Column:
    """The priority, one level higher (up to the highest) for what has waited for max_wait."""
    waited = since <= _at(as_of) - F.expr(f"INTERVAL {max_wait}")
    return F.when(waited, F.least(F.lit(highest), priority + 1)).otherwise(priority)


# ---- caches


def live_entries(entries: DataFrame, as_of) -> DataFrame:
    """Entries (key, written_at, ttl_ms) that haven't run out; those without a ttl never do."""
    end = F.timestamp_millis(F.unix_millis("written_at") + F.col("ttl_ms"))
    return entries.where(F.col("ttl_ms").isNull() | (end > _at(as_of)))


def invalidated(entries: DataFrame, globs: list[str]) -> DataFrame:
    """Entries whose key fits none of the patterns (a plain key is a pattern of itself)."""
    from brindle.functions.scalar import glob_match

    hit = F.lit(False)
    for g in globs:
        hit = hit | glob_match(F.col("key"), g)
    return entries.where(~hit)


def kept_by_bytes(entries: DataFrame, most: int, order: str = "read_at") -> DataFrame:
    """Least-recently-used eviction: the newest entries that together have at most so many bytes.

    Bytes are first summed by instant, so the running sum is over instants, not over all entries.
    """
    per = entries.groupBy(order).agg(F.sum("bytes").alias("_b"))
    total = per.select(order, F.sum("_b").over(W.orderBy(F.col(order).desc())).alias("_total"))
    return entries.join(total.where(F.col("_total") <= most).select(order), order, "left_semi")


def hit_rate(hits: Column, misses: Column) -> Column:
    return F.when(hits + misses > 0, hits / (hits + misses)).otherwise(F.lit(0.0))


# ---- schedules


def due_jobs(jobs: DataFrame, as_of, n: int) -> DataFrame:
    """Pending jobs (id, state, next_run_at) whose time has come, earliest first."""
    return jobs.where((F.col("state") == "pending") & (F.col("next_run_at") <= _at(as_of))).orderBy("next_run_at", "id").limit(n)


def unblocked(jobs: DataFrame) -> DataFrame:
    """Jobs all of whose depends_on are completed; unknown dependencies block."""
    need = jobs.select(F.col("id").alias("_job"), F.explode("depends_on").alias("_on"))
    done = jobs.where(F.col("state") == "completed").select(F.col("id").alias("_on"))
    blocked = need.join(done, "_on", "left_anti").select(F.col("_job").alias("id")).distinct()
    return jobs.join(blocked, "id", "left_anti")


def rescheduled(jobs: DataFrame, as_of) -> DataFrame:
    """jobs with the next_run_at that their cron or interval_ms gives after as_of."""
    from brindle.functions.cron import next_fire

    now = F.unix_millis(_at(as_of))
    by_cron = next_fire(F.col("cron"), now)
    ms = F.coalesce(by_cron, now + F.col("interval_ms")) if "interval_ms" in jobs.columns else by_cron
    return jobs.withColumn("next_run_at", F.timestamp_millis(ms))


def cyclic(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """ids on a cycle or in front of one, of dependencies (id, depends_on): what is left when jobs without open dependencies are taken away, round by round."""
    left = edges.select("id", "depends_on").distinct().persist()
    for _ in range(rounds):
        kept = left.join(left.select(F.col("id").alias("depends_on")).distinct(), "depends_on", "left_semi").select("id", "depends_on").persist()
        if kept.count() == left.count():
            return kept.select("id").distinct()
        left = kept
    raise RuntimeError("the dependency chains are too long")
