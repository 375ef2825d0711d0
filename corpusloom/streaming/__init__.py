"""Structured Streaming versions of ingest, dedup, request enrichment and counts.

Every stream reuses the batch operators: row-local ones directly on the
stream, set-based ones (interaction checks) inside ``foreachBatch`` on each
micro-batch.  Sinks are idempotent per batch (partition per batch id,
dynamic overwrite), so a replayed batch after executor loss rewrites, not
duplicates, its output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators import clean
from ..operators import interactions as ddi
from ..operators import roles
from ..schema import RECORD_V2
from ..session import cut_lineage
from ..sources import parse_json_tolerant


def _batch_sink(path: str, fmt: str = "parquet"):
    """foreachBatch writer: one partition per batch id, overwritten on replay."""
    def write(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumn("batch_id", F.lit(batch_id).cast("long"))
              .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
              .partitionBy("batch_id").format(fmt).save(path))
    return write


def stream_ingest(spark: SparkSession, landing: str, out: str, checkpoint: str, quarantine: str | None = None,
                  glob: str = "*.json*", available_now: bool = True, max_files: int = 1000) -> StreamingQuery:
    """New landed JSON Lines files -> tolerant parse -> unify -> append.

    Lines that fail both parses go to ``quarantine`` (if given) instead of the
    output.  Top-level keys outside the schema are kept in ``extra`` (key ->
    JSON text).  A batch takes at most ``max_files`` files and is parsed once.
    """
    raw = (spark.readStream.option("pathGlobFilter", glob).option("maxFilesPerTrigger", max_files).text(landing)
           .withColumnRenamed("value", "raw"))
    parsed = parse_json_tolerant(raw, "raw", RECORD_V2)

    def write(batch: DataFrame, batch_id: int) -> None:
        known = F.array(*[F.lit(f.name) for f in RECORD_V2.fields])
        options = {"allowUnquotedControlChars": "true"}
        extra = F.map_filter(F.from_json("_json", "map<string,string>", options), lambda k, v: ~F.array_contains(known, k))
        failed = F.col("parse_status") == "failed"
        rows = batch.select(F.when(failed, F.col("raw")).alias("_failed"), failed.alias("_bad"), F.col("parsed_text").alias("_json"), "parsed.*")
        rows = clean.unify(rows.withColumn("extra", extra), strict_presence=True, raw_col="_json").drop("_json")
        # Read twice below, so kept: one copy of each text, a lost block is parsed again.
        rows = rows.persist()
        _batch_sink(out)(rows.where(~F.col("_bad")).drop("_bad", "_failed"), batch_id)
        if quarantine:
            _batch_sink(quarantine)(rows.where("_bad").select(F.col("_failed").alias("raw")), batch_id)
        rows.unpersist()

    w = parsed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def stream_dedup(stream: DataFrame, key_cols: list[str], ts_col: str, delay: str = "1 hour") -> DataFrame:
    """First-wins exact dedup with state bounded by the watermark.

    Duplicates that arrive more than ``delay`` after the first copy's event time
    pass through (state for that key has been dropped): that is the price of
    bounded state.  ``ts_col`` is cast to TIMESTAMP (a TIMESTAMP_NTZ column
    cannot carry a watermark).
    """
    s = stream.withColumn(ts_col, F.col(ts_col).cast("timestamp"))
    return s.withWatermark(ts_col, delay).dropDuplicatesWithinWatermark(key_cols)


def stateful_first_wins(stream: DataFrame, key_cols: list[str], ts_col: str, order_col: str, window: str = "1 hour", late: str = "1 hour",
                        groups: int = 512) -> DataFrame:
    """Of the copies of a key within ``window`` of the first one, the row of the least order key stays, whichever arrives first.

    Arbitrary state with event-time timers.  A key's first row (by event time) opens an
    episode of length ``window``; all its rows before the end belong to it, and the
    next row opens another.  Rows may come out of order by ``late``: they wait in the state until the watermark
    has passed them, are then taken in the order of their event times, and the winner
    is written once the watermark has passed the end of the episode, when the state goes.
    Later rows than that are dropped by the watermark; a row after the state has gone opens an episode of
    its own.  So the result does not depend on files, batches or the order of arrival.

    Null keys are keys; rows without an event time are dropped; null order keys come last; ties go to the
    earlier event time, then to the lesser row as JSON text.  The state of a key holds one row per event time that waits
    (the least of its order key) and the winner so far.  A call of the stateful function costs far more than a row, so
    keys share their state and timer in ``groups`` groups by hash (more for streams whose waiting rows are very many; the number
    must stay the same for a checkpoint).  Append mode; columns are those of the input.
    """
    spark = stream.sparkSession
    span = spark.sql(f"select cast(interval {window} as interval day to second) x").first()[0]
    span_us = int(span.total_seconds() * 1_000_000)
    schema = stream.schema
    if not isinstance(schema[order_col].dataType, (T.StringType, T.IntegralType, T.FloatType, T.DoubleType)):
        raise ValueError("the order key must be a string or a number")
    order_type = "string" if isinstance(schema[order_col].dataType, T.StringType) else "long" if isinstance(schema[order_col].dataType, T.IntegralType) else "double"
    body = F.to_json(F.struct(*[F.col(c) for c in stream.columns]), {"ignoreNullFields": "false"})
    key = F.to_json(F.struct(*[F.col(c) for c in key_cols]), {"ignoreNullFields": "false"})
    time = F.col(ts_col).cast("timestamp")
    rows = stream.select(time.alias("_time"), key.alias("_key"), F.unix_micros(time).alias("_us"), F.col(order_col).cast(order_type).alias("_order"), body.alias("_row"))
    rows = rows.where("_time is not null").withWatermark("_time", late).withColumn("_group", F.pmod(F.xxhash64("_key"), F.lit(groups)).cast("int"))
    none = {"string": "", "long": 0, "double": 0.0}[order_type]

    def decide(_, batches, state):
        import pandas as pd
        import pyarrow as pa

        # A rank compares as (order key is null, order key, event time, row).  By key: ranks that wait, by event time, and (end, best rank).
        waiting, open_ = {}, {}
        if state.exists:
            for key, end, *rank in zip(*(c.to_pylist() for c in pa.ipc.open_stream(state.get[0]).read_all().columns)):
                rank = tuple(rank)
                if end is None:
                    waiting.setdefault(key, {})[rank[2]] = rank
                else:
                    open_[key] = (end, rank)
        for pdf in batches:
            orders = pdf["_order"].astype(object).where(pdf["_order"].notna(), None).tolist()
            for key, us, order, row in zip(pdf["_key"].tolist(), pdf["_us"].tolist(), orders, pdf["_row"].tolist()):
                rank = (order is None, none if order is None else order, us, row)
                own = waiting.setdefault(key, {})
                if us not in own or rank < own[us]:
                    own[us] = rank
        passed = state.getCurrentWatermarkMs() * 1000
        out, left, at = [], [], None
        for key in waiting.keys() | open_.keys():
            end, best = open_.get(key, (None, None))
            own = waiting.get(key, {})
            for us in sorted(own):
                if us >= passed:
                    left.append((key, None, *own[us]))
                    at = us + 1 if at is None else min(at, us + 1)
                    continue
                if end is not None and us >= end:
                    out.append(best[3])
                    end, best = None, None
                if end is None:
                    end, best = us + span_us, own[us]
                else:
                    best = min(best, own[us])
            if end is not None and end <= passed:
                out.append(best[3])
            elif end is not None:
                left.append((key, end, *best))
                at = end if at is None else min(at, end)
        if not left:
            state.remove()
        else:
            types = (pa.string(), pa.int64(), pa.bool_(), {"string": pa.string(), "long": pa.int64(), "double": pa.float64()}[order_type], pa.int64(), pa.string())
            table = pa.table([pa.array(c, t) for c, t in zip(zip(*left), types)], names=["key", "end", "none", "order", "us", "row"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as writer:
                writer.write_table(table)
            state.update((sink.getvalue().to_pybytes(),))
            # The timer goes off when the next row or the end of an episode is passed.
            state.setTimeoutTimestamp(max(-(-at // 1000), passed // 1000 + 1))
        yield pd.DataFrame({"_row": out}, dtype=object)

    kept = rows.groupBy("_group").applyInPandasWithState(decide, "_row string", "state binary", "append", "EventTimeTimeout")
    return kept.select(F.from_json("_row", schema).alias("r")).select("r.*")


def as_utc_wallclock(c, tz: str):
    """TIMESTAMP whose UTC wall clock equals the given (local / NTZ) wall clock, so that
    UTC-aligned windows follow the calendar days of the data in any session time zone."""
    return F.from_utc_timestamp(F.col(c).cast("timestamp") if isinstance(c, str) else c.cast("timestamp"), tz)


def stream_counts(stream: DataFrame, ts_col: str, by: list[str], window: str = "1 day",
                  delay: str = "1 day") -> DataFrame:
    """Per-window counts with a watermark (update mode emits changed counts per batch).

    Windows follow the wall clock of ``ts_col`` whatever the session time zone;
    ``w.start`` is reported in that same wall clock.
    """
    tz = stream.sparkSession.conf.get("spark.sql.session.timeZone")
    s = stream.withColumn(ts_col, as_utc_wallclock(ts_col, tz)).withWatermark(ts_col, delay)
    agg = s.groupBy(F.window(ts_col, window).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
    return agg.withColumn("w", F.struct(F.to_utc_timestamp(F.col("w.start"), tz).alias("start"),
                                        F.to_utc_timestamp(F.col("w.end"), tz).alias("end")))


def latest_counts(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Final counts from an update-mode sink: the row of the last batch per key."""
    d = spark.read.parquet(path)
    # One aggregate: null keys are groups like others.
    rest = [c for c in d.columns if c not in (*keys, "batch_id")]
    return d.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("r")).select(*keys, "r.*")


def run_counts(spark: SparkSession, stream: DataFrame, ts_col: str, by: list[str], out: str, checkpoint: str,
               window: str = "1 day", delay: str = "1 day") -> StreamingQuery:
    agg = stream_counts(stream, ts_col, by, window, delay)
    flat = agg.select(F.col("w.start").alias("window_start"), *by, "n")
    return (flat.writeStream.outputMode("update").foreachBatch(_batch_sink(out))
                .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def enrich_requests(batch: DataFrame, spark: SparkSession, rules: ddi.Rules) -> DataFrame:
    """W03 per micro-batch: routing flags, disclaimer and interaction findings per request."""
    # Requests are numbered: ids may repeat or be null, and each row keeps its own findings.
    r = cut_lineage(roles.route(batch, spark).withColumn("_request", F.monotonically_increasing_id()))
    items = ddi.explode_baskets(r.select(F.col("_request").alias("qid"), ddi.parse_med_list("drugs").alias("l")),
                                "qid", "l")
    checked = ddi.check_interactions(items, rules, r.select(F.col("_request").alias("basket")))
    checked = checked.withColumnRenamed("basket", "_request")
    out = r.join(checked, "_request", "left")
    ddi_col = F.when(F.col("use_ddi"), F.coalesce("ddi", F.array().cast(T.ArrayType(T.StringType())))) \
        .otherwise(F.array().cast(T.ArrayType(T.StringType())))
    return out.select("query_id", "role", "use_rag", "use_ddi", ddi_col.alias("ddi"),
                      roles.disclaimer("role").alias("disclaimer"))


def stream_requests(spark: SparkSession, requests: DataFrame, out: str, checkpoint: str,
                    rules: ddi.Rules | None = None) -> StreamingQuery:
    """Request stream enriched against static routing and interaction rules."""
    rules = rules or ddi.Rules(spark)

    def write(batch: DataFrame, batch_id: int) -> None:
        _batch_sink(out)(enrich_requests(batch, spark, rules), batch_id)

    return (requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
                    .trigger(availableNow=True).start())
