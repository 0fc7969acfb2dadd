"""Ingest, scoring and history as Structured Streaming jobs.

Every job writes below one folder: its tables and its checkpoints. Sinks inside foreachBatch write one folder per batch
id, so a repeated batch replaces its own output. What is kept from batch to batch is in Spark's state store.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from wattloom.constants import MODEL_REGISTRY, RECENT_PER_HOUSE
from wattloom.operators.history import change, recent_per_house
from wattloom.operators.models import Model, load_model, predict, score_by_model
from wattloom.operators.ordering import HOT_ROWS, previous_in_order
from wattloom.operators.registry import available_models, registry_frame, stored_artifacts
from wattloom.operators.validation import outcome, split_valid, validate_household, validate_vector
from wattloom.runtime import kept
from wattloom.streaming.processors import NewestRows, PreviousBucket

BATCH = "batch_id"

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _keep_state_in_rocksdb(spark: SparkSession) -> None:
    """State off the heap: it grows with the keys inside the watermark."""
    spark.conf.set(_PROVIDER, _ROCKSDB)


def run_available(writer: DataStreamWriter) -> StreamingQuery:
    """Process everything there is and stop."""
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def _write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}")


def _there(spark: SparkSession, path: str, schema) -> str:
    """``path``, with an empty table in it if nobody has written there yet: a stream needs a folder to watch."""
    spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{path}/{BATCH}=none")
    return path


def ingest_writer(
    records: DataFrame, folder: str, record_id: str | None = None, time: str | None = None,
    delay: str = "1 day",
) -> DataStreamWriter:
    """Validate household records into ``folder``/records, partitioned by batch and outcome.

    With ``record_id`` and ``time``, a record id seen again within ``delay`` is dropped; that
    needs a watermark, so records later than the delay are dropped as well. Without them every
    record is kept.
    """
    if record_id and time:
        _keep_state_in_rocksdb(records.sparkSession)
        records = records.withWatermark(time, delay).dropDuplicatesWithinWatermark([record_id])

    def write(batch: DataFrame, batch_id: int) -> None:
        checked = validate_household(batch).withColumn("outcome", outcome())
        checked.write.mode("overwrite").partitionBy("outcome").parquet(
            f"{folder}/records/{BATCH}={batch_id}")

    return records.writeStream.foreachBatch(write).option(
        "checkpointLocation", f"{folder}/checkpoint")


def score_writer(rows: DataFrame, model: Model, folder: str) -> DataStreamWriter:
    """Score arriving rows and append them to ``folder``/log."""
    return (
        predict(rows, model, "predicted_value_kwh").writeStream.format("parquet")
        .outputMode("append")
        .option("path", f"{folder}/log")
        .option("checkpointLocation", f"{folder}/checkpoint")
    )


def score_requests_writer(requests: DataFrame, root: str, folder: str) -> DataStreamWriter:
    """Check arriving requests and score each with the model it names, into ``folder``/scored by outcome.

    The models stored below ``root`` are read anew for every batch, so one that was replaced is used from the next batch on;
    a request that names a model that isn't there is rejected. Accepted and rejected rows are written in one job.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        there = available_models(registry_frame(spark), stored_artifacts(spark, root))
        models = {key: load_model(spark, root, key) for key in sorted(r["model"] for r in there.collect())}
        with kept(batch) as held:
            accepted, rejected = split_valid(validate_vector(held, list(MODEL_REGISTRY)))
            known = F.col("model").isin(list(models))
            missing = accepted.filter(~known).withColumn("reason", F.lit("model not available"))
            refused = rejected.select(*batch.columns, "reason").unionByName(missing.select(*batch.columns, "reason"))
            done = refused.withColumn("prediction", F.lit(None).cast("double"))
            if models:
                scored = score_by_model(accepted.filter(known).select(*batch.columns), models)
                done = done.unionByName(scored.withColumn("reason", F.lit(None).cast("string")))
            done.withColumn("outcome", outcome()).write.mode("overwrite").partitionBy("outcome").parquet(
                f"{folder}/scored/{BATCH}={batch_id}")

    return requests.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint")


def bucket_writer(rows: DataFrame, folder: str, value: str, time: str, row_id: str, delay: str = "1 day",
                  bucket: str = "1 hour") -> DataStreamWriter:
    """Readings by house and bucket of time, in order, into ``folder``/buckets once the watermark has passed.

    So rows may arrive in any order within ``delay``. A hot house is many buckets, which spread over tasks; a bucket
    must be short enough for the readings of one house in it to fit a task. Rows without a time have no place.
    """
    _keep_state_in_rocksdb(rows.sparkSession)
    ordered = F.sort_array(F.collect_list(F.struct(F.col(time).alias("time"), F.col(row_id).alias("row_id"),
                                                   F.col(value).alias("kwh"))))
    buckets = rows.withWatermark(time, delay).groupBy("house_id", F.window(time, bucket)).agg(ordered.alias("readings"))
    return (
        buckets.select("house_id", F.col("window.start").alias("bucket"), F.col("window.end").alias("bucket_end"),
                       "readings", F.element_at("readings", -1)["kwh"].alias("closing_kwh"))
        .writeStream.format("parquet").outputMode("append").option("path", f"{folder}/buckets")
        .option("checkpointLocation", f"{folder}/checkpoint")
    )


def link_writer(spark: SparkSession, folder: str) -> DataStreamWriter:
    """The last value before each bucket of ``bucket_writer``, into ``folder``/links.

    Reads one row per house and bucket, without its readings. Buckets of later batches end later, as the watermark only
    moves on, so the last value of a house is all that its state holds.
    """
    _keep_state_in_rocksdb(spark)
    path = f"{folder}/buckets"
    schema = spark.read.parquet(path).schema
    closed = spark.readStream.schema(schema).parquet(path).select(
        "house_id", F.unix_micros("bucket").alias("bucket"), "closing_kwh")
    house, kwh = schema["house_id"].dataType, schema["closing_kwh"].dataType
    linked = closed.groupBy("house_id").transformWithState(
        PreviousBucket(kwh), f"house_id {house.simpleString()}, bucket long, last_kwh {kwh.simpleString()}",
        "append", "none").withColumn("bucket", F.timestamp_micros("bucket"))
    return (
        linked.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/links")
        .option("checkpointLocation", f"{folder}/checkpoint-links")
    )


def read_deltas(spark: SparkSession, folder: str) -> DataFrame:
    """Each reading of the closed buckets with the previous one of its house: row_id, house_id, time, kwh, last_kwh,
    delta_kwh, direction."""
    readings = F.transform("readings", lambda x, i: F.struct(
        x["row_id"].alias("row_id"), x["time"].alias("time"), x["kwh"].alias("kwh"), (i == 0).alias("opens"),
        F.when(i > 0, F.get(F.col("readings"), i - 1)["kwh"]).alias("within")))
    rows = spark.read.parquet(f"{folder}/buckets").select("house_id", "bucket", F.explode(readings).alias("r"))
    links = spark.read.parquet(f"{folder}/links").select(
        F.col("house_id").alias("_house"), F.col("bucket").alias("_bucket"), F.col("last_kwh").alias("_before"))
    same = F.col("house_id").eqNullSafe(F.col("_house")) & (F.col("bucket") == F.col("_bucket"))
    found = rows.join(links, same, "left").select(
        "r.row_id", "house_id", "r.time", "r.kwh",
        F.when(F.col("r.opens"), F.col("_before")).otherwise(F.col("r.within")).alias("last_kwh"))
    delta, direction = change(F.col("kwh"), F.col("last_kwh"))
    return found.withColumn("delta_kwh", delta).withColumn("direction", direction)


def unlinked_rows(arrived: DataFrame, folder: str, time: str, row_id: str, bucket: str = "1 hour") -> DataFrame:
    """The rows of ``arrived`` (what the stream read, as a table) that are in no bucket, with the reason as ``why``.

    ``late``: the bucket was closed before the row came; ``pending``: the watermark has not passed its bucket yet;
    ``no time``: the row has none.
    """
    buckets = arrived.sparkSession.read.parquet(f"{folder}/buckets")
    placed = buckets.select(F.explode("readings.row_id").alias("_placed"))
    # Buckets close in the order of their ends; one row.
    closed = buckets.agg(F.max("bucket_end")).first()[0]
    end = F.window(time, bucket)["end"]
    why = F.when(end <= F.lit(closed), "late").otherwise("pending")
    timed = arrived.filter(F.col(time).isNotNull()).join(
        placed, F.col(row_id) == F.col("_placed"), "left_anti").withColumn("why", why)
    return timed.unionByName(arrived.filter(F.col(time).isNull()).withColumn("why", F.lit("no time")))


def rest_deltas(arrived: DataFrame, folder: str, value: str, time: str, row_id: str, bucket: str = "1 hour",
                hot_rows: int = HOT_ROWS) -> DataFrame:
    """What ``read_deltas`` gives, for the rows of ``arrived`` that wait for the watermark when the input has ended.

    They follow all closed buckets, so the first one of a house is linked to the last closing value of the house. Rows
    without a time come last, by their id. Late rows, whose buckets had closed, stay with ``unlinked_rows``.
    """
    buckets = arrived.sparkSession.read.parquet(f"{folder}/buckets")
    closed = buckets.agg(F.max("bucket_end")).first()[0]  # one row
    timed = arrived.filter(F.col(time).isNotNull()).withColumn("_end", F.window(time, bucket)["end"])
    waiting = timed if closed is None else timed.filter(F.col("_end") > F.lit(closed))
    rest = waiting.drop("_end").unionByName(arrived.filter(F.col(time).isNull())).select(
        F.col(row_id).alias("row_id"), "house_id", F.col(time).alias("time"), F.col(value).alias("kwh"),
        F.when(F.col(time).isNull(), 2).otherwise(1).alias("_turn"))
    before = buckets.groupBy("house_id").agg(F.max_by("closing_kwh", "bucket").alias("kwh")).withColumn("_turn", F.lit(0))
    rows = rest.unionByName(before, allowMissingColumns=True)
    linked = previous_in_order(rows, "house_id", ["_turn", "time", "row_id"], "kwh", "last_kwh", hot_rows)
    delta, direction = change(F.col("kwh"), F.col("last_kwh"))
    return linked.filter("_turn > 0").withColumn("delta_kwh", delta).withColumn("direction", direction).drop("_turn")


def newest_writer(rows: DataFrame, folder: str, time: str, row_id: str, n: int = RECENT_PER_HOUSE) -> DataStreamWriter:
    """The newest n rows per house of each batch, into ``folder``/newest: what the state of a house needs to see.

    The rank filter runs before the shuffle, so a hot house sends at most n rows per input task.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        _write_batch(recent_per_house(batch, n, time, row_id), f"{folder}/newest", batch_id)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint")


def recent_writer(spark: SparkSession, schema, folder: str, time: str, row_id: str,
                  n: int = RECENT_PER_HOUSE) -> DataStreamWriter:
    """The newest n rows per house over all batches of ``newest_writer``, into ``folder``/recent.

    A batch writes the houses that it changed; ``read_recent`` takes the last state of each. ``schema`` is that of the rows.
    """
    _keep_state_in_rocksdb(spark)
    path = _there(spark, f"{folder}/newest", schema)
    arriving = spark.readStream.schema(schema).parquet(f"{path}/*")
    # Times go through Python and its state as numbers, which no time zone touches.
    timed = [f.name for f in schema if f.dataType == T.TimestampType()]
    numbers = arriving.withColumns({c: F.unix_micros(c) for c in timed})
    house = schema["house_id"].dataType.simpleString()
    states = numbers.groupBy("house_id").transformWithState(
        NewestRows(numbers.schema, time, row_id, n), f"house_id {house}, rows array<{numbers.schema.simpleString()}>",
        "update", "none")
    kept_rows = states.select("house_id", F.transform("rows", lambda x: F.struct(*[
        (F.timestamp_micros(x[c]) if c in timed else x[c]).alias(c) for c in schema.names])).alias("rows"))

    def write(batch: DataFrame, batch_id: int) -> None:
        _write_batch(batch, f"{folder}/recent", batch_id)

    return kept_rows.writeStream.foreachBatch(write).outputMode("update").option(
        "checkpointLocation", f"{folder}/checkpoint-recent")


def read_recent(spark: SparkSession, folder: str) -> DataFrame:
    """The newest rows of every house, as the last batch that changed it left them."""
    states = spark.read.parquet(f"{folder}/recent")
    last = states.groupBy("house_id").agg(F.max_by("rows", F.col(BATCH).cast("long")).alias("rows"))
    return last.select(F.explode("rows").alias("r")).select("r.*")


def daily_usage(rows: DataFrame, name: str, value: str, time: str, delay: str = "1 day") -> DataFrame:
    """kWh per day and appliance; a day is final once the watermark has passed its end."""
    _keep_state_in_rocksdb(rows.sparkSession)
    return (
        rows.withWatermark(time, delay)
        .groupBy(F.window(time, "1 day"), name)
        .agg(F.sum(value).alias("kwh"))
        .select(F.col("window.start").alias("day"), name, "kwh")
    )


def daily_usage_writer(
    rows: DataFrame, folder: str, name: str, value: str, time: str, delay: str = "1 day"
) -> DataStreamWriter:
    return (
        daily_usage(rows, name, value, time, delay).writeStream.format("parquet")
        .outputMode("append")
        .option("path", f"{folder}/daily")
        .option("checkpointLocation", f"{folder}/checkpoint")
    )
