import pytest

from pyspark.sql import functions as F

from tablescour.columns import ROW
from tablescour.errors import CleanError
from tablescour.plans.cleaning import CleaningPlan
from tablescour.plans.runs import RunLog
from tablescour.plans.spec import Rule
from tablescour.streaming.clean import clean_stream
from tablescour.streaming.summaries import record_summaries, total_summary

STEPS = [
    {"id": "n", "type": "normalize", "config": {"columns": [
        {"column": "a", "operations": ["trim", "uppercase"]}, {"column": "d", "operations": ["normalize_date"]}]}},
    {"id": "v", "type": "validate", "config": {"rules": [{"column": "d", "rule": "date"}], "drop_invalid_rows": True}},
    {"id": "r", "type": "rename", "config": {"rename": {"a": "name"}}},
]


def test_stream_equals_batch(spark, table, tmp_path):
    df = table(a=[" x", "y ", "z"], d=["01/20/2025", "soon", "Jan 5, 2025"])
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    df.write.parquet(source)
    stream = spark.readStream.schema(df.schema).parquet(source)
    query = (
        clean_stream(stream, STEPS)
        .writeStream.option("checkpointLocation", str(tmp_path / "check"))
        .trigger(availableNow=True)
        .start(sink, format="parquet")
    )
    assert query.awaitTermination(120)
    got = spark.read.parquet(sink).orderBy(ROW).collect()
    assert got == CleaningPlan(STEPS).apply(df).orderBy(ROW).collect()
    assert [tuple(r)[1:] for r in got] == [("X", "2025-01-20"), ("Z", "2025-01-05")]


def test_a_dedupe_needs_an_event_time(table):
    steps = [{"id": "d", "type": "dedupe", "config": {}}]
    with pytest.raises(CleanError):
        clean_stream(table(a=["x"]), steps)


def _write(spark, folder, name, rows):
    schema = "_row bigint, at timestamp, mail string, note string"
    rows = [(r, f"2025-01-01 {at}:00", mail, note) for r, at, mail, note in rows]
    df = spark.createDataFrame(rows, "_row bigint, at string, mail string, note string")
    df.withColumn("at", F.to_timestamp("at")).select("_row", "at", "mail", "note").coalesce(1).write.parquet(f"{folder}/{name}")
    return schema


@pytest.mark.parametrize("keep", ["first", "last"])
def test_dedupe_with_late_and_repeated_events(spark, tmp_path, keep):
    """Rows of a key come out of order and in several micro-batches."""
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    parts = {
        "b1": [(4, "10:04", " X ", "d"), (2, "10:02", "y", "b"), (9, "10:09", None, "n")],
        "b2": [(1, "10:01", "x", "a"), (6, "10:06", "y ", "e"), (10, "10:10", None, "m"), (3, "10:03", "z", "c")],
        "b3": [(5, "10:05", "x", "a"), (2, "10:02", "y", "b"), (99, "23:59", "end", "")],
    }
    for name, rows in parts.items():
        schema = _write(spark, source, name, rows)
    steps = [
        {"id": "n", "type": "normalize", "config": {"columns": [{"column": "mail", "operations": ["trim", "lowercase"]}]}},
        {"id": "d", "type": "dedupe", "config": {"mode": "columns", "columns": ["mail"], "keep": keep}},
        {"id": "r", "type": "rename", "config": {"rename": {"mail": "email"}}},
    ]
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{source}/*")
    query = (
        clean_stream(stream, steps, event_time="at", lateness="2 hours", horizon="1 hour")
        .writeStream.option("checkpointLocation", str(tmp_path / "check"))
        .trigger(availableNow=True)
        .start(sink, format="parquet")
    )
    assert query.awaitTermination(240)
    got = sorted(tuple(r) for r in spark.read.parquet(sink).select(ROW, "email", "note").collect())
    batch = spark.read.schema(schema).parquet(f"{source}/*").drop("at")
    want = sorted(set(tuple(r) for r in CleaningPlan(steps).apply(batch.distinct()).select(ROW, "email", "note").collect()))
    assert got == [r for r in want if r[0] != 99] and len(got) == 4


def test_a_batch_run_again_leaves_one_record(spark, table, tmp_path):
    log = RunLog(spark, str(tmp_path / "runs"))
    rules = [Rule("a", "required"), Rule("a", "string_length", max_length=1)]
    source = str(tmp_path / "in")
    table(a=["x", "", "yy"]).coalesce(1).write.parquet(f"{source}/1")
    table(a=["z", "zz"]).coalesce(1).write.parquet(f"{source}/2")
    record = record_summaries(log, "names", rules)
    stream = spark.readStream.schema("_row bigint, a string").option("maxFilesPerTrigger", 1).parquet(f"{source}/*")
    query = (
        stream.writeStream.foreachBatch(record)
        .option("checkpointLocation", str(tmp_path / "check"))
        .trigger(availableNow=True)
        .start()
    )
    assert query.awaitTermination(240)
    assert log.table().count() == 2
    record(table(a=["x", "", "yy"]), 0)  # the batch again, as after a failure
    assert log.table().count() == 2
    total = total_summary(log, "names")
    assert [(t["rule"], t["total_values"], t["error_count"]) for t in total] == [("required", 4, 1), ("string_length", 4, 2)]
