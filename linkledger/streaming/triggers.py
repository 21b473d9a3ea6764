"""Reassessment triggers, their windows, edit bursts and de-duplication on streams."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from linkledger.operators.lifecycle import TRIGGERS, with_trigger_meaning
from linkledger.operators.ordered import ordered, time_chunk

def stream_triggers(versions: DataFrame, out: str, checkpoint: str, attrs: Sequence[str], key: str = "entity", ts: str = "ts",
                    version: str = "version", delay: str = "1 hour", table: Mapping[str, tuple] = TRIGGERS) -> StreamingQuery:
    """Triggers of versions that arrive as a stream, appended below ``out``; :func:`stored_triggers` and :func:`late_versions` read them.

    State is kept per entity: a version is closed, and compared with the one before it, once the watermark (the latest
    time less ``delay``) has passed it. A version that comes late but inside the delay takes its place between its neighbours;
    the result does not depend on how such input is cut or ordered. One that comes after a later version of its entity was
    closed, or has no time, goes to the late versions, with all its values; nothing is dropped. Equal times are ordered by ``version``.

    The state is a table below ``checkpoint``: of each entity the last closed version and the open ones. A batch sorts its own
    rows and that table, however long the history is, and writes the table anew beside that of the batch before; a repeated
    batch so finds the state it found first and overwrites its own folders. An entity's rows of one batch and its open
    versions are one task's work, sorted with spilling.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(key, F.col(ts).cast("timestamp").alias(ts), version, *[F.col(a).cast("string").alias(a) for a in attrs])
        schema = T.StructType([*rows.schema.fields, *STEP.fields])
        steps = lambda n: f"{checkpoint}/steps/{n % 2}"
        known = rows.withColumn("__closed", F.lit(False))
        if batch_id > 0:
            state = spark.read.schema(schema).parquet(steps(batch_id - 1)).where("kept <> 'gone'")
            known = known.unionByName(state.select(*rows.columns, (F.col("kept") == "closed").alias("__closed")))
        _step(known, attrs, key, ts, version, delay).write.mode("overwrite").partitionBy("kept").parquet(steps(batch_id))
        # The step is taken once; its file holds the next state and what is told.
        step = spark.read.schema(schema).parquet(steps(batch_id)).where("changes IS NOT NULL OR late IS NOT NULL")
        named = step.select(key, ts, version, F.explode_outer("changes").alias("c"), "late").select(key, ts, version, "c.*", "late")
        identity = F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in (key, ts, version)], "attribute"), 256)
        found = with_trigger_meaning(named.withColumn("trigger_id", identity), table)
        (found.withColumn("part", F.when(F.col("late").isNull(), "trigger").otherwise("late"))
         .write.mode("overwrite").partitionBy("part").parquet(f"{out}/batch={batch_id}"))

    return versions.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: What a step adds to a version: its changes if it was closed now, its values if it is late, and whether it stays as closed, as open, or is gone.
STEP = T.StructType([
    T.StructField("changes", T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("attribute", "old", "new")]))),
    T.StructField("late", T.ArrayType(T.StringType())), T.StructField("kept", T.StringType())])


def _step(known: DataFrame, attrs: Sequence[str], key: str, ts: str, version: str, delay: str) -> DataFrame:
    """The versions of a batch and of the state before it (the last closed one ``__closed``) with the columns of ``STEP``.

    In order of an entity, versions without time and late ones come first, then the closed one, those due and the open
    ones; so one window gives what is before and after, and no late version stands before one that is due.
    """
    entity = Window.partitionBy(key).orderBy(F.col(ts).asc_nulls_first(), F.col(version).asc_nulls_first(), "__closed")
    whole = entity.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place, closed = F.struct(ts, version), F.col("__closed")
    placed = known.select(
        "*", F.max(F.when(closed, place)).over(whole).alias("__last"), F.lag(F.struct(ts, *attrs)).over(entity).alias("__before"),
        F.lead(ts).over(entity).alias("__next"))
    # Whole milliseconds, like a watermark of Spark.
    passed = known.agg((F.date_trunc("millisecond", F.max(ts)) - F.expr(f"INTERVAL '{delay}'")).alias("passed")).scalar()
    placed = placed.withColumn("__passed", passed)
    late = ~closed & (F.col(ts).isNull() | F.coalesce(place <= F.col("__last"), F.lit(False)))
    due = ~closed & ~late & F.coalesce(F.col(ts) <= F.col("__passed"), F.lit(False))
    last = F.col("__next").isNull() | (F.col("__next") > F.col("__passed"))
    changes = F.array_compact(F.array(*[
        F.when(~F.col(a).eqNullSafe(F.col("__before")[a]), F.struct(F.lit(a).alias("attribute"), F.col("__before")[a].alias("old"), F.col(a).alias("new")))
        for a in attrs]))
    return placed.select(
        key, ts, version, *attrs,
        F.when(due & F.col("__before")[ts].isNotNull() & (F.size(changes) > 0), changes).alias("changes"), F.when(late, F.array(*attrs)).alias("late"),
        F.when((closed | due) & last, "closed").when(closed | due | late, "gone").otherwise("open").alias("kept"))


def stored_schema(versions: DataFrame, key: str = "entity", ts: str = "ts", version: str = "version") -> T.StructType:
    """Columns of the rows that :func:`stream_triggers` writes, to read them as a table or as a stream."""
    text = [T.StructField(c, T.StringType()) for c in ("attribute", "old", "new")]
    more = [T.StructField("late", T.ArrayType(T.StringType())), *[T.StructField(c, T.StringType()) for c in ("trigger_id", "category", "severity", "resulting_state", "action")]]
    return T.StructType([versions.schema[key], T.StructField(ts, T.TimestampType()), versions.schema[version], *text, *more,
                         T.StructField("batch", T.LongType()), T.StructField("part", T.StringType())])


def stored_triggers(spark: SparkSession, out: str, schema: T.StructType) -> DataFrame:
    """All triggers so far."""
    return spark.read.schema(schema).parquet(out).where("part = 'trigger'").drop("late", "batch", "part")


def late_versions(spark: SparkSession, out: str, schema: T.StructType, attrs: Sequence[str], key: str = "entity", ts: str = "ts", version: str = "version") -> DataFrame:
    """Versions that came after a later one of their entity was closed, with the batch that brought them."""
    rows = spark.read.schema(schema).parquet(out).where("part = 'late'")
    return rows.select(key, ts, version, *[F.col("late")[i].alias(a) for i, a in enumerate(attrs)], "batch")


def _event_time(df: DataFrame, ts: str) -> DataFrame:
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def trigger_counts(triggers: DataFrame, window: str, slide: str | None = None, ts: str = "ts", by: str = "category") -> DataFrame:
    """Triggers per category and window; runs on batch and streaming input alike."""
    frame = F.window(ts, window, slide) if slide else F.window(ts, window)
    return triggers.groupBy(frame.alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select("w.start", "w.end", by, "n")


def stream_trigger_counts(triggers: DataFrame, window: str, slide: str | None = None, delay: str = "10 minutes", ts: str = "ts", by: str = "category") -> DataFrame:
    """The same as a stream: windows appear once the watermark has passed them."""
    return trigger_counts(_event_time(triggers, ts).withWatermark(ts, delay), window, slide, ts, by)


def edit_sessions(triggers: DataFrame, gap_seconds: int, key: str = "entity", ts: str = "ts", order: Sequence[str] = (),
                  chunk: Column | None = None) -> DataFrame:
    """Bursts of changes per entity: a change at most ``gap_seconds`` after the previous one belongs to its burst.

    Bursts are numbered with chunked running values, so an entity with very many changes is split over tasks.
    ``end`` is the last change plus the gap.
    """
    chunk = time_chunk(ts) if chunk is None else chunk
    lagged = ordered(triggers.select(key, ts, *[o for o in order if o != ts]), [key], [ts, *order], chunk, lag={"__before": ts})
    wait = F.unix_micros(ts) - F.unix_micros("__before")
    starts = lagged.withColumn("__start", F.when(F.col("__before").isNull() | (wait >= gap_seconds * 1_000_000), 1).otherwise(0))
    numbered = ordered(starts.drop("__before"), [key], [ts, *order], chunk, running_sum={"__burst": "__start"})
    return (numbered.groupBy(key, "__burst").agg(F.min(ts).alias("start"), F.max(ts).alias("__last"), F.count(F.lit(1)).alias("n"))
            .select(key, "start", (F.col("__last") + F.make_dt_interval(secs=F.lit(gap_seconds))).alias("end"), "n"))


def stream_edit_sessions(triggers: DataFrame, gap_seconds: int, delay: str = "10 minutes", key: str = "entity", ts: str = "ts") -> DataFrame:
    """The same as a stream; a burst appears once the watermark has passed its end."""
    timed = _event_time(triggers, ts).withWatermark(ts, delay)
    bursts = timed.groupBy(F.session_window(ts, f"{gap_seconds} seconds").alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return bursts.select(key, "w.start", "w.end", "n")


def stream_first_wins(points: DataFrame, out: str, checkpoint: str, key: Sequence[str] = ("point",), order: Sequence[str] = ("path",)) -> StreamingQuery:
    """Keep the first row per key by ``order`` below ``out``; :func:`current_first` reads it.

    A batch writes its own first rows only, reduced before they are shuffled; the least of all batches wins, whatever
    came first. No row is dropped for being late, and no state is held in memory.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        _first(batch, key, order).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return points.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_first(spark: SparkSession, out: str, key: Sequence[str] = ("point",), order: Sequence[str] = ("path",)) -> DataFrame:
    """First row per key of all batches."""
    return _first(spark.read.parquet(out).drop("batch"), key, order)


def _first(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    ranked = F.struct(*order, *[c for c in rows.columns if c not in order])
    return rows.groupBy(*[F.col(k).alias(f"__{k}") for k in key]).agg(F.min(ranked).alias("r")).select("r.*").select(*rows.columns)


def last_word(spark: SparkSession, schema, ts: str, at: Column) -> DataFrame:
    """One row with nothing but a time: fed to a stream after its end, it moves the watermark past every open window."""
    return spark.range(1).select(*[(at if f.name == ts else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])
