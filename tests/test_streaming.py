import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wattloom import schemas
from wattloom.operators import history, validation
from wattloom.operators import models as ml
from wattloom.operators.linear import LinearModel
from wattloom.operators.trees import Nodes, TreeModel
from wattloom.plans.queries import registered
from wattloom.runtime import scratch_path
from wattloom.sources import tables, views
from wattloom.streaming import jobs

START = datetime(2024, 3, 1)


@pytest.fixture(scope="module")
def pieces(spark, folder):
    """The events in several files, oldest first, so that a stream sees several batches."""
    base = scratch_path(spark, "events")
    events = tables.table(spark, folder, "events")
    for i in range(4):
        part = events.filter(f"event_id between {i * 250} and {i * 250 + 249}")
        part.coalesce(1).write.mode("append").parquet(f"{base}/events.parquet")
    return base


def stream(spark, pieces):
    return tables.event_stream(spark, pieces, files_per_batch=1)


def as_set(df, *names):
    return {tuple(r) for r in df.select(*names).collect()}


def batches(query):
    return sum(1 for p in query.recentProgress if p.numInputRows > 0)


def test_ingest_stream_agrees_with_batch(spark, pieces):
    base = scratch_path(spark, "s")
    done = jobs.run_available(jobs.ingest_writer(views.event_records(stream(spark, pieces)), base))
    assert batches(done) == 4
    events = tables.table(spark, pieces, "events")
    good, bad = validation.split_valid(
        validation.validate_household(views.event_records(events)))
    stored = spark.read.parquet(f"{base}/records")
    assert as_set(stored.filter("outcome = 'accepted'"), "record_id", "date") == as_set(
        good, "record_id", "date")
    assert as_set(stored.filter("outcome = 'rejected'"), "record_id", "reason") == as_set(
        bad, "record_id", "reason")


def test_ingest_stream_drops_repeated_records_if_asked(spark, pieces):
    base = scratch_path(spark, "s")
    twice = stream(spark, pieces).withColumn("event_id", F.expr("event_id - event_id % 2"))
    records = views.event_records(twice)
    jobs.run_available(jobs.ingest_writer(records, base, "record_id", "ts"))
    stored = spark.read.parquet(f"{base}/records").select("record_id")
    assert stored.count() == stored.distinct().count() == 500


READING = "house_id long, event_id long, ts timestamp, kwh double"


def arriving(spark, parts):
    """(stream, all rows): each part is a batch of (house, id, hours after the start, kwh); no hours, no time."""
    base, rows = scratch_path(spark, "in"), []
    for part in parts:
        timed = [(house, i, None if h is None else START + timedelta(hours=h), kwh) for house, i, h, kwh in part]
        spark.createDataFrame(timed, READING).coalesce(1).write.mode("append").parquet(base)
        rows += timed
    stream = spark.readStream.schema(READING).option("maxFilesPerTrigger", 1).parquet(base)
    return stream, spark.createDataFrame(rows, READING)


def deltas(spark, stream, base, **how):
    jobs.run_available(jobs.bucket_writer(stream, base, "kwh", "ts", "event_id", **how))
    jobs.run_available(jobs.link_writer(spark, base))
    return jobs.read_deltas(spark, base)


def random_parts(seed, displaced, parts=4, n=240):
    """Rows in the order of their hour plus up to ``displaced`` hours, cut into batches; houses of unlike sizes."""
    rng = random.Random(seed)
    rows = [(rng.choice([1, 1, 1, 1, 2, 3, None]), i, rng.randrange(96) + rng.choice([0.0, 0.25, 0.5]),
             rng.choice([None, 1.0, 2.5, round(rng.random(), 3)])) for i in range(n)]
    rows.sort(key=lambda r: r[2] + rng.random() * displaced)
    return [rows[k * n // parts:(k + 1) * n // parts] for k in range(parts)]


@pytest.mark.parametrize("displaced", [0, 5])
def test_deltas_follow_event_time_in_any_order_of_arrival(spark, displaced):
    stream, rows = arriving(spark, random_parts(displaced, displaced))
    base = scratch_path(spark, "s")
    found = deltas(spark, stream, base, delay="6 hours", bucket="2 hours")
    expected = history.delta_vs_last(rows, "kwh", "ts", "event_id")
    last = rows.agg(F.max("ts")).first()[0]
    closed = expected.filter(F.window("ts", "2 hours")["end"] <= F.lit(last) - F.expr("interval 6 hours"))
    names = ("event_id", "house_id", "last_kwh", "delta_kwh", "direction")
    wanted = as_set(closed, *names)
    assert len(wanted) > 150
    assert as_set(found.withColumnRenamed("row_id", "event_id"), *names) == wanted
    others = jobs.unlinked_rows(rows, base, "ts", "event_id", "2 hours")
    assert {r["why"] for r in others.collect()} == {"pending"} and others.count() == 240 - len(wanted)


def test_later_rows_go_to_the_side_table(spark):
    parts = [[(7, 1, 0, 1.0), (7, 2, 30, 2.0)], [(7, 3, 31, 3.0)], [(7, 4, 60, 4.0)], [(7, 5, 61, 5.0)],
             [(7, 6, 1, 6.0), (7, 7, None, 7.0)], [(7, 8, 90, 8.0)], [(7, 9, 91, 9.0)]]
    stream, rows = arriving(spark, parts)
    base = scratch_path(spark, "s")
    found = deltas(spark, stream, base, delay="2 hours", bucket="1 hour")
    assert sorted((r.row_id, r.last_kwh) for r in found.collect()) == [
        (1, None), (2, 1.0), (3, 2.0), (4, 3.0), (5, 4.0)]
    side = {r.event_id: r.why for r in jobs.unlinked_rows(rows, base, "ts", "event_id").collect()}
    assert side == {6: "late", 7: "no time", 8: "pending", 9: "pending"}


@pytest.mark.parametrize("hot_rows", [5_000_000, 10])
def test_no_reading_is_left_out_when_the_input_has_ended(spark, hot_rows):
    stream, rows = arriving(spark, [*random_parts(4, 5), [(1, 500, None, 7.0), (9, 501, None, None), (9, 502, None, 2.0)]])
    base = scratch_path(spark, "s")
    found = deltas(spark, stream, base, delay="6 hours", bucket="2 hours")
    rest = jobs.rest_deltas(rows, base, "kwh", "ts", "event_id", "2 hours", hot_rows)
    whole = found.unionByName(rest).withColumnRenamed("row_id", "event_id")
    names = ("event_id", "house_id", "last_kwh", "delta_kwh", "direction")
    timed = rows.withColumn("ts", F.coalesce("ts", F.lit(START + timedelta(days=99))))  # no time: after all others
    assert whole.count() == rows.count() and found.count() < rows.count() - 10
    assert as_set(whole, *names) == as_set(history.delta_vs_last(timed, "kwh", "ts", "event_id"), *names)


def test_delta_query_gives_every_event(spark, folder):
    found = registered()["stream_delta"](spark, folder)
    assert found.count() == tables.table(spark, folder, "events").count()


def test_linking_goes_on_after_a_restart(spark):
    """Buckets are linked after each of two runs over growing input; then a batch that wasn't committed runs again."""
    base, source, parts = scratch_path(spark, "s"), scratch_path(spark, "in"), random_parts(1, 0)
    rows = []
    for part in parts:
        timed = [(house, i, START + timedelta(hours=h), kwh) for house, i, h, kwh in part]
        spark.createDataFrame(timed, READING).coalesce(1).write.mode("append").parquet(source)
        rows += timed
        stream = spark.readStream.schema(READING).parquet(source)
        found = deltas(spark, stream, base, delay="1 hour", bucket="1 hour")
    before = as_set(found, "row_id", "last_kwh", "delta_kwh")
    expected = history.delta_vs_last(spark.createDataFrame(rows, READING), "kwh", "ts", "event_id")
    assert before and before <= as_set(expected, "event_id", "last_kwh", "delta_kwh")
    jvm = spark.sparkContext._jvm
    commits = jvm.org.apache.hadoop.fs.Path(f"{base}/checkpoint-links/commits")
    files = commits.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    last = max(int(f.getPath().getName()) for f in files.listStatus(commits) if f.getPath().getName().isdigit())
    assert files.delete(jvm.org.apache.hadoop.fs.Path(commits, str(last)), False)
    assert as_set(deltas(spark, stream, base, delay="1 hour", bucket="1 hour"), "row_id", "last_kwh", "delta_kwh") == before


def test_recent_stream_agrees_with_batch(spark, pieces):
    base = scratch_path(spark, "s")
    rows = views.reading_columns(stream(spark, pieces))

    def run():
        done = jobs.run_available(jobs.newest_writer(rows, base, "ts", "event_id", n=5))
        jobs.run_available(jobs.recent_writer(spark, rows.schema, base, "ts", "event_id", n=5))
        return done

    assert batches(run()) == 4
    run()  # nothing new
    expected = history.recent_per_house(
        views.reading_columns(tables.table(spark, pieces, "events")), 5, "ts", "event_id")
    assert as_set(jobs.read_recent(spark, base), "event_id", "house_id") == as_set(expected, "event_id", "house_id")
    # A batch that ran but was not committed runs again after a restart and writes its files anew.
    jvm = spark.sparkContext._jvm
    commit = jvm.org.apache.hadoop.fs.Path(f"{base}/checkpoint/commits/3")
    files = commit.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    assert files.delete(commit, False)
    run()
    assert as_set(jobs.read_recent(spark, base), "event_id", "house_id") == as_set(expected, "event_id", "house_id")


def test_recent_rows_in_any_order_of_arrival(spark):
    stream, rows = arriving(spark, [list(p) for p in reversed(random_parts(4, 50))])
    base = scratch_path(spark, "s")
    jobs.run_available(jobs.newest_writer(stream, base, "ts", "event_id", n=3))
    jobs.run_available(jobs.recent_writer(spark, stream.schema, base, "ts", "event_id", n=3))
    expected = history.recent_per_house(rows, 3, "ts", "event_id")
    assert as_set(jobs.read_recent(spark, base), "event_id", "kwh") == as_set(expected, "event_id", "kwh")


def test_requests_are_scored_by_the_models_that_are_there(spark):
    """A model is added and another replaced between two batches."""
    base, root = scratch_path(spark, "s"), scratch_path(spark, "models")
    schema = "house_id long, model string, features array<double>, meta map<string,string>"

    def line(slope):
        return LinearModel([f"f{i}" for i in range(12)], [slope] + [0.0] * 11, 0.0)

    stump = Nodes([0] * 3, [0, -1, -1], [0] * 3, [1.5, 0.0, 0.0], [1, 0, 0], [0.0, 10.0, 20.0], [2, 1, 1], [1.0, 0.0, 0.0])
    forest = TreeModel([f"f{i}" for i in range(12)], 0.0, True, [0], stump)
    full = [2.0] + [0.0] * 11

    def arrive(first):
        rows = [(first, "linear", full, None), (first + 1, "rf", full, None), (first + 2, "other", full, None),
                (first + 3, "linear", full[:3], None), (first + 4, "linear", [None] * 12, None)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
        arriving = spark.readStream.schema(schema).parquet(f"{base}/in")
        jobs.run_available(jobs.score_requests_writer(arriving, root, base))

    ml.save_models({"linear": line(1.0)}, root)
    arrive(0)
    ml.save_models({"linear": line(3.0), "rf": forest}, root)
    arrive(10)
    found = {r.house_id: (r.outcome, r.prediction, r.reason) for r in spark.read.parquet(f"{base}/scored").collect()}
    assert {k: v[:2] for k, v in found.items() if v[0] == "accepted"} == {
        0: ("accepted", 2.0), 10: ("accepted", 6.0), 11: ("accepted", 20.0)}
    assert found[1][2] == found[2][2] == found[12][2] == "model not available"
    assert found[3][2] == "wrong number of features" and found[14][2] == "feature is not a number" and len(found) == 10


def test_daily_stream_emits_closed_days(spark, pieces):
    base = scratch_path(spark, "s")
    rows = views.reading_columns(stream(spark, pieces))
    jobs.run_available(jobs.daily_usage_writer(rows, base, "appliance", "kwh", "ts"))
    daily = spark.read.parquet(f"{base}/daily")
    events = tables.table(spark, pieces, "events")
    last = events.agg(F.max("ts")).first()[0]
    expected = {
        (r["day"], r["event_type"]): r["kwh"] for r in events.groupBy(
            F.date_trunc("day", F.col("ts").cast("timestamp")).alias("day"), "event_type"
        ).agg(F.sum("value").alias("kwh")).collect()
        if (last - r["day"]).total_seconds() >= 2 * 86400}
    found = {(r["day"], r["appliance"]): r["kwh"] for r in daily.collect()}
    assert found.keys() == expected.keys()
    assert all(found[k] == pytest.approx(expected[k]) for k in found)


def test_score_stream_agrees_with_batch(spark, folder):
    base = scratch_path(spark, "s")
    rows = views.training(spark, folder)
    model = ml.fit(rows, "linear")
    rows.repartition(3).write.parquet(f"{base}/requests")
    arriving = spark.readStream.schema(schemas.training_schema("v12")).option(
        "maxFilesPerTrigger", 1).parquet(f"{base}/requests")
    jobs.run_available(jobs.score_writer(arriving, model, base))
    found = {r["house_id"]: r["predicted_value_kwh"]
             for r in spark.read.parquet(f"{base}/log").collect()}
    expected = {r["house_id"]: r["prediction"] for r in ml.predict(rows, model).collect()}
    assert found == pytest.approx(expected)
