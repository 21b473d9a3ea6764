"""Streaming operators run to completion over the tables, checked against their batch meaning.

Streams read copies of the tables in the shared folder, run with ``availableNow`` and write there; the query
returns what the stream wrote.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from linkledger.operators import lifecycle as L
from linkledger.plans import standins as S
from linkledger.plans.catalog import query
from linkledger.plans.lifecycle_queries import ATTRS, CHANGE_SQL
from linkledger.session import scratch_path
from linkledger.streaming import inventory as V
from linkledger.streaming import triggers as T


SLICES = 3
DELAY = "2 days"


def feed(spark, sf_dir, start, slices=SLICES, late=False) -> None:
    """Let the versions arrive in slices of time; ``start(stream)`` runs the stream on what is new.

    Slices are written by all tasks and each run takes its whole slice, so no slice passes through one task. Of the
    versions of the last day of a slice, one in seven arrives with the next. A row of a far later time follows, which closes
    all that is open. With ``late`` one version in eleven comes after that.
    """
    base = S.written(spark, sf_dir, "versions", lambda: S.versions(spark, sf_dir))
    span = base.agg(F.min(F.unix_micros("ts")).alias("lo"), F.max(F.unix_micros("ts")).alias("hi"))
    width = span.select((F.col("hi") - F.col("lo") + 1) / slices).scalar()
    since = F.unix_micros("ts") - span.select("lo").scalar()
    slice_ = F.floor(since / width)
    held_back = (F.col("version") % 7 == 0) & ((slice_ + 1) * width - since < 86_400_000_000)
    at = F.when(F.lit(late) & (F.col("version") % 11 == 0), slices + 1).otherwise(F.least(slice_ + held_back.cast("int"), F.lit(slices - 1)))
    folder = scratch_path(spark, "version_stream")
    waves = [base.where(at == i) for i in range(slices)] + [T.last_word(spark, base.schema, "ts", F.lit("2999-01-01").cast("timestamp"))]
    for wave in [*waves, *([base.where(at == slices + 1)] if late else [])]:
        wave.write.mode("append").parquet(folder)
        start(spark.readStream.schema(base.schema).parquet(folder))


def drained(spark, sf_dir, operator):
    """What ``operator(stream)`` has written after all slices and the row that closes its windows."""
    out, checkpoint = scratch_path(spark, "stream_out"), scratch_path(spark, "stream_checkpoint")
    feed(spark, sf_dir, lambda stream: appended(operator(stream), out, checkpoint))
    return spark.read.parquet(out)


def appended(stream, out, checkpoint) -> None:
    (stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())


_streams: dict[tuple, str] = {}


def trigger_stream(spark, sf_dir, late=False):
    """Folder and columns of the triggers after all slices, run once per session."""
    name = (spark.sparkContext.applicationId, sf_dir, late)
    if name not in _streams:
        base = scratch_path(spark, "triggers")
        feed(spark, sf_dir, lambda v: T.stream_triggers(v, f"{base}/out", f"{base}/checkpoint", ATTRS, delay=DELAY).awaitTermination(), late=late)
        _streams[name] = f"{base}/out"
    return _streams[name], T.stored_schema(S.versions(spark, sf_dir))


@query("stream_triggers", "WITH " + CHANGE_SQL + " SELECT entity, version, attribute, old, new, category FROM TR")
def stream_triggers(spark, sf_dir):
    stored = T.stored_triggers(spark, *trigger_stream(spark, sf_dir))
    return stored.select("entity", "version", "attribute", "old", "new", "category")


# A version in eleven comes when all others are closed: it is late if its entity has a later one among them.
LATE_SQL = S.VERSION_SQL + """, O AS (SELECT * FROM V WHERE version % 11 <> 0), LO AS (SELECT entity, max(struct_pack(ts := ts, version := version)) AS last FROM O GROUP BY entity),
L AS (SELECT V.* FROM V JOIN LO USING (entity) WHERE V.version % 11 = 0 AND struct_pack(ts := V.ts, version := V.version) < last)"""


@query("stream_late_versions", "WITH " + LATE_SQL + " SELECT entity, version, material, thickness::VARCHAR AS thickness, title::VARCHAR AS title FROM L")
def stream_late_versions(spark, sf_dir):
    late = T.late_versions(spark, *trigger_stream(spark, sf_dir, late=True), ATTRS)
    return late.select("entity", "version", *ATTRS)


@query("stream_triggers_without_late", "WITH " + LATE_SQL + """, A AS (SELECT * FROM V ANTI JOIN L USING (entity, version)), D AS (SELECT entity, version, material, thickness::VARCHAR AS t, title::VARCHAR AS e,
  lag(material) OVER w AS m0, lag(thickness::VARCHAR) OVER w AS t0, lag(title::VARCHAR) OVER w AS e0, row_number() OVER w AS rn FROM A WINDOW w AS (PARTITION BY entity ORDER BY ts, version))
SELECT entity, version, 'material' AS attribute, m0 AS old, material AS new FROM D WHERE rn>1 AND m0 IS DISTINCT FROM material
UNION ALL SELECT entity, version, 'thickness', t0, t FROM D WHERE rn>1 AND t0 IS DISTINCT FROM t UNION ALL SELECT entity, version, 'title', e0, e FROM D WHERE rn>1 AND e0 IS DISTINCT FROM e""")
def stream_triggers_without_late(spark, sf_dir):
    stored = T.stored_triggers(spark, *trigger_stream(spark, sf_dir, late=True))
    return stored.select("entity", "version", "attribute", "old", "new")


def counted(counts):
    return counts.where(F.col("category").isNotNull()).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "category", "n")


@query("stream_trigger_counts", "WITH " + CHANGE_SQL + """, X AS (SELECT category, time_bucket(INTERVAL 1 HOUR, ts) AS s FROM TR)
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, category, count(*)::BIGINT AS n FROM X GROUP BY 1, 2""")
def stream_trigger_counts(spark, sf_dir):
    # A second stream follows the folder of the first; a row of a far later time closes its windows.
    out, schema = trigger_stream(spark, sf_dir)
    base = scratch_path(spark, "trigger_counts")
    last = T.last_word(spark, schema, "ts", F.lit("2999-01-01").cast("timestamp")).drop("batch", "part")
    last.write.parquet(f"{base}/end/batch={1 << 40}/part=trigger")
    for folder in (out, f"{base}/end"):
        stream = spark.readStream.schema(schema).parquet(f"{folder}/*/*").where("late IS NULL")
        appended(T.stream_trigger_counts(stream, "1 hour", delay="0 seconds"), f"{base}/out", f"{base}/checkpoint")
    return counted(spark.read.parquet(f"{base}/out"))


@query("trigger_counts_sliding", "WITH " + CHANGE_SQL + """, X AS (SELECT category, time_bucket(INTERVAL 30 MINUTE, ts) AS s FROM TR), Y AS (SELECT category, s FROM X UNION ALL SELECT category, s - INTERVAL 30 MINUTE FROM X)
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, category, count(*)::BIGINT AS n FROM Y GROUP BY 1, 2""")
def trigger_counts_sliding(spark, sf_dir):
    triggers = L.reassessment_triggers(S.versions(spark, sf_dir), ATTRS)
    return counted(T.trigger_counts(triggers, "1 hour", "30 minutes"))


BURST_SQL = """E AS (SELECT user_id AS entity, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS st, event_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
B AS (SELECT entity, ts, sum(st) OVER (PARTITION BY entity ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS b FROM E),
BU AS (SELECT entity, min(ts) AS s, max(ts) + INTERVAL 6 HOUR AS e, count(*) AS n FROM B GROUP BY entity, b)"""


@query("edit_sessions", "WITH " + BURST_SQL + " SELECT entity, strftime(s, '%Y-%m-%d %H:%M:%S') AS start, strftime(e, '%Y-%m-%d %H:%M:%S') AS \"end\", n::BIGINT AS n FROM BU")
def edit_sessions(spark, sf_dir):
    b = T.edit_sessions(S.versions(spark, sf_dir), 6 * 3600, order=["version"])
    return b.select("entity", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("start", "end")], "n")


@query("stream_edit_sessions", "WITH " + BURST_SQL + """ SELECT entity, strftime(s, '%Y-%m-%d %H:%M:%S') AS start, strftime(e, '%Y-%m-%d %H:%M:%S') AS "end", n::BIGINT AS n FROM BU""")
def stream_edit_sessions(spark, sf_dir):
    b = drained(spark, sf_dir, lambda v: T.stream_edit_sessions(v, 6 * 3600, delay=DELAY)).where(F.col("entity").isNotNull())
    return b.select("entity", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("start", "end")], "n")


@query("stream_dedupe", """
SELECT user_id AS entity, event_type AS material, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, event_id AS version FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1""")
def stream_dedupe(spark, sf_dir):
    base = scratch_path(spark, "first")
    order = ["ts", "version"]
    feed(spark, sf_dir, lambda v: T.stream_first_wins(v, f"{base}/out", f"{base}/checkpoint", ["entity", "material"], order).awaitTermination())
    first = T.current_first(spark, f"{base}/out", ["entity", "material"], order).where(F.col("entity").isNotNull())
    return first.select("entity", "material", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "version")


@query("stream_inventory", """
WITH L AS (SELECT 'nation' || c_nationkey || '.txt' AS name, c_nationkey AS k, c_custkey AS pos, c_name || ' ' || c_mktsegment AS line FROM customer),
A AS (SELECT name, k, string_agg(line, chr(10) ORDER BY pos) || chr(10) AS old, string_agg(upper(line), chr(10) ORDER BY pos) || chr(10) AS changed FROM L GROUP BY name, k),
N AS (SELECT 'segment' || c_mktsegment || '.txt' AS name, string_agg(c_name, chr(10) ORDER BY c_custkey) || chr(10) AS t FROM customer GROUP BY 1),
S AS (SELECT name, CASE k%5 WHEN 0 THEN changed WHEN 1 THEN NULL ELSE old END AS t, CASE k%5 WHEN 0 THEN 'changed' WHEN 1 THEN 'gone' ELSE '' END AS delta FROM A UNION ALL SELECT name, t, 'new' FROM N)
SELECT name, CASE WHEN delta='gone' THEN NULL ELSE strlen(t) END::BIGINT AS bytes, sha256(t) AS sha256, delta FROM S""")
def stream_inventory(spark, sf_dir):
    # Files of customers by nation arrive; then some change in place, some go, and files by segment are added.
    base = scratch_path(spark, "stream_inventory")
    folder, table = f"{base}/in", f"{base}/table"
    c = S.table(spark, sf_dir, "customer")
    named = lambda prefix, key: F.concat(F.lit(prefix), F.col(key).cast("string"), F.lit(".txt")).alias("name")
    line = F.concat_ws(" ", "c_name", "c_mktsegment")
    nations = c.select(named("nation", "c_nationkey"), F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("at"), line.alias("line"))
    S.place_files(spark, nations.drop("k"), folder)
    V.stream_inventory(spark, folder, table, f"{base}/checkpoint", "*.txt").awaitTermination()
    S.place_files(spark, nations.where("k % 5 = 0").select("name", "at", F.upper("line").alias("line")), folder)
    S.place_files(spark, c.select(named("segment", "c_mktsegment"), F.col("c_custkey").alias("at"), F.col("c_name").alias("line")), folder)
    fs, path = S.file_system(spark, folder)
    for k in range(25):
        if k % 5 == 1:
            fs.delete(path(f"{folder}/nation{k}.txt"), False)
    batch = V.refresh_inventory(spark, folder, table, "*.txt")
    now = V.current_inventory(spark, table)
    deltas = V.inventory_deltas(V.current_inventory(spark, table, batch - 1), now)
    rows = now.join(deltas, "path", "left")
    return rows.select("name", F.when(F.col("sha256").isNotNull(), F.col("bytes")).alias("bytes"), "sha256", F.coalesce("delta", F.lit("")).alias("delta"))
