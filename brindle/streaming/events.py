"""Event routing, content filters, the durable log, replay and dead letters.

Topics and filters compile to Column expressions, so one plan serves a table and a stream. An event has
event_type (dotted), payload (JSON text) and for the log a time and an id.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- topics


class PatternError(ValueError):
    pass


def topic_regex(pattern: str) -> str:
    """``+`` is one segment, a final ``*`` any number of them, none included; all else itself."""
    parts = pattern.split(".")
    if "" in parts:
        raise PatternError(f"empty segment in {pattern!r}")
    if "*" in parts[:-1]:
        raise PatternError(f"* can only end a pattern: {pattern!r}")
    many = parts[-1] == "*"
    own = [r"[^.]+" if p == "+" else re.escape(p) for p in (parts[:-1] if many else parts)]
    if many and not own:
        return "^.*$"
    return "^" + r"\.".join(own) + (r"(\..*)?" if many else "") + "$"


def topic_matches(topic: Column, pattern: str) -> Column:
    return topic.rlike(topic_regex(pattern))


def routed(events: DataFrame, subscriptions: DataFrame, most: int = 100_000) -> DataFrame:
    """A row for each event and subscription (subscriber, pattern) whose pattern its event_type fits.

    Patterns become regexes once. Event types are few beside events: the types are matched, and the matches
    joined with the events by type. Subscriptions beyond ``most`` are refused, as they are gathered.
    """
    listed = subscriptions.select("subscriber", "pattern").limit(most + 1).collect()
    if len(listed) > most:
        raise ValueError(f"more than {most} subscriptions")
    spark = events.sparkSession
    rows = [(r.subscriber, r.pattern, topic_regex(r.pattern)) for r in listed]
    subs = spark.createDataFrame(rows, "subscriber string, pattern string, _re string")
    types = events.select("event_type").distinct()
    pairs = types.join(F.broadcast(subs), F.expr("event_type RLIKE _re")).drop("_re")
    return events.join(pairs, "event_type")


# ---- content filters


def _parsed(payload: str) -> Column:
    return F.try_parse_json(F.col(payload))


class Filter:
    """A condition on a JSON payload. column() is never null: what isn't there or isn't JSON doesn't match."""

    def _test(self, v: Column) -> Column:
        raise NotImplementedError

    def column(self, payload: str = "payload") -> Column:
        v = _parsed(payload)
        return F.coalesce(v.isNotNull() & self._test(v), F.lit(False))


def _at(v: Column, field: list[str]) -> tuple[Column, Column]:
    """The variant at a path of object keys, and its kind: string, boolean, number or another."""
    x = F.try_variant_get(v, "$" + "".join(f"['{f}']" for f in field), "variant")
    s = F.schema_of_variant(x)
    kind = F.when(s == "STRING", "string").when(s == "BOOLEAN", "boolean").when(s.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*|INT|SMALLINT|TINYINT)$"), "number").otherwise(s)
    return x, kind


def _as(x: Column, kind: str) -> Column:
    return F.try_variant_get(x, "$", kind)


def _same(x: Column, kind: Column, value) -> Column:
    if value is None:
        return kind == "VOID"
    if isinstance(value, bool):
        return (kind == "boolean") & (_as(x, "boolean") == value)
    if isinstance(value, int | float):
        return (kind == "number") & (_as(x, "double") == float(value))
    if isinstance(value, str):
        return (kind == "string") & (_as(x, "string") == value)
    raise TypeError(f"can't compare with {value!r}")


@dataclass(frozen=True)
class Equals(Filter):
    field: list[str]
    value: object

    def _test(self, v: Column) -> Column:
        return F.coalesce(_same(*_at(v, self.field), self.value), F.lit(False))


@dataclass(frozen=True)
class Exists(Filter):
    field: list[str]

    def _test(self, v: Column) -> Column:
        return _at(v, self.field)[0].isNotNull()


@dataclass(frozen=True)
class Matches(Filter):
    """Of strings only; the regex may match anywhere."""

    field: list[str]
    regex: str

    def _test(self, v: Column) -> Column:
        x, kind = _at(v, self.field)
        return F.coalesce((kind == "string") & _as(x, "string").rlike(self.regex), F.lit(False))


@dataclass(frozen=True)
class In(Filter):
    field: list[str]
    values: list

    def _test(self, v: Column) -> Column:
        out = F.lit(False)
        for value in self.values:
            out = out | Equals(self.field, value)._test(v)
        return out


@dataclass(frozen=True)
class Range(Filter):
    """Both bounds included; numbers with numbers, strings with strings."""

    field: list[str]
    low: object
    high: object

    def _test(self, v: Column) -> Column:
        x, kind = _at(v, self.field)
        strings = isinstance(self.low, str), isinstance(self.high, str)
        if strings[0] != strings[1]:
            return F.lit(False)
        is_kind, value = ("string", _as(x, "string")) if strings[0] else ("number", _as(x, "double"))
        return F.coalesce((kind == is_kind) & value.between(self.low, self.high), F.lit(False))


@dataclass(frozen=True)
class Not(Filter):
    inner: Filter

    def _test(self, v: Column) -> Column:
        return ~self.inner._test(v)


@dataclass(frozen=True)
class And(Filter):
    parts: list[Filter]

    def _test(self, v: Column) -> Column:
        out = F.lit(True)
        for p in self.parts:
            out = out & p._test(v)
        return out


@dataclass(frozen=True)
class Or(Filter):
    parts: list[Filter]

    def _test(self, v: Column) -> Column:
        out = F.lit(False)
        for p in self.parts:
            out = out | p._test(v)
        return out


# ---- publishing


def publishable(event_type: str = "event_type", payload: str = "payload", most_bytes: int = 1 << 20) -> Column:
    """Two segments at least, none empty, and a payload within the cap."""
    segments = F.split(F.col(event_type), r"\.", -1)
    fits = (F.size(segments) >= 2) & ~F.array_contains(segments, "") & (F.octet_length(F.coalesce(F.col(payload), F.lit(""))) <= most_bytes)
    return F.coalesce(fits, F.lit(False))


def published(events: DataFrame, most_bytes: int = 1 << 20) -> tuple[DataFrame, DataFrame]:
    """(accepted, dead letters with their reason)."""
    ok = publishable(most_bytes=most_bytes)
    reason = F.when(F.octet_length("payload") > most_bytes, "payload too large").otherwise("bad event type")
    return events.where(ok), events.where(~ok).withColumn("reason", reason)


def unexpired(events: DataFrame, as_of, time: str = "ts", ttl_ms: str = "ttl_ms") -> DataFrame:
    end = F.timestamp_millis(F.unix_millis(time) + F.col(ttl_ms))
    return events.where(F.col(ttl_ms).isNull() | (end > F.lit(as_of).cast("timestamp")))


def newest_dead(dead: DataFrame, most: int, time: str = "ts", key: str = "event_id") -> DataFrame:
    """The bounded dead-letter table: the oldest beyond ``most`` go."""
    return dead.orderBy(F.desc(time), F.desc(key)).limit(most)


# ---- the log


def with_offsets(events: DataFrame, time: str, key: str, first: int = 0) -> DataFrame:
    """events with gapless offsets in the order of time and key.

    Rows are range-partitioned and sorted; each partition's count gives the offset of the next, so no task
    ever sorts all rows. The counts gathered are one for each partition.
    """
    ordered = events.repartitionByRange(F.asc(time), F.asc(key)).sortWithinPartitions(time, key)
    ordered = ordered.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    ordered = ordered.persist()
    counts = {r._p: r.n for r in ordered.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).collect()}
    begin, before = [], first
    for p in sorted(counts):
        begin.append((p, before))
        before += counts[p]
    starts = events.sparkSession.createDataFrame(begin, "_p int, _b long")
    return ordered.join(F.broadcast(starts), "_p").withColumn("offset", F.col("_b") + F.col("_i")).drop("_p", "_i", "_b")


def replay(log: DataFrame, after: int | None = None, until=None, pattern: str | None = None, content: Filter | None = None, time: str = "ts") -> DataFrame:
    """The part of the log behind a cursor, up to an instant, that fits a topic and a content filter, in order."""
    if after is not None:
        log = log.where(F.col("offset") > after)
    if until is not None:
        log = log.where(F.col(time) <= F.lit(until).cast("timestamp"))
    if pattern is not None:
        log = log.where(topic_matches(F.col("event_type"), pattern))
    if content is not None:
        log = log.where(content.column())
    return log.orderBy("offset")


def retained(log: DataFrame, most: int) -> DataFrame:
    """The last ``most`` offsets."""
    last = log.agg(F.max("offset").alias("_m"))
    return log.crossJoin(F.broadcast(last)).where(F.col("offset") > F.col("_m") - most).drop("_m")


# ---- streams


def stream(spark, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """Events as they arrive as Parquet files."""
    r = spark.readStream.schema(schema)
    return (r.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else r).parquet(path)


def once_each(events: DataFrame, keys: list[str], time: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Each idempotency key once while the watermark remembers it."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(events: DataFrame, width: str, time: str = "ts", delay: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Extension: events a type and window; later ones than the delay are left out."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    out = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n")


def deliver(events: DataFrame, checkpoint: str, accept: Callable[[DataFrame], None], refuse: Callable[[DataFrame], None], most_bytes: int = 1 << 20):
    """Starts a query that hands each micro-batch's good and bad events to two sinks; the checkpoint makes it at-least-once."""

    def both(batch: DataFrame, _: int) -> None:
        good, bad = published(batch.persist(), most_bytes)
        accept(good)
        refuse(bad)
        batch.unpersist()

    return events.writeStream.foreachBatch(both).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def allowed_by_bucket(events: DataFrame, key: str, rate: float, burst: float, time: str = "ts", order: str = "event_id") -> DataFrame:
    """Token-bucket limiting: events of each key with allowed, by the tokens that have come in since the key's events before.

    A key's events are handled in order in one task, in Arrow batches that carry the bucket on; keys are spread by hash.
    """
    src = events.withColumn("_s", F.unix_micros(time) / 1e6).repartition(key).sortWithinPartitions(key, time, order)
    kind = T.StructType([*src.schema.fields, T.StructField("allowed", T.BooleanType())])

    def run(frames):
        last, tokens, then = object(), burst, 0.0
        for f in frames:
            out = []
            for k, s in zip(f[key], f["_s"]):
                if k != last:
                    last, tokens, then = k, burst, s
                tokens, then = min(burst, tokens + (s - then) * rate), s
                ok = tokens >= 1
                tokens -= ok
                out.append(ok)
            yield f.assign(allowed=out)

    return src.mapInPandas(run, kind).drop("_s")
