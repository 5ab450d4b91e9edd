from terrafold.operators.jobs import fold_states
from terrafold.streaming import jobs


def test_stream_ends_where_the_batch_does(spark, tmp_path):
    schema = "job_id long, ts timestamp, event_id long, event string"
    rows = [(1, 1, "start"), (1, 2, "retry"), (2, 3, "start"), (1, 4, "start"), (1, 5, "complete"), (2, 6, "cancel"), (2, 7, "fail"), (2, 8, "recover")]
    events = spark.createDataFrame([(j, e, n) for j, e, n in rows], "job_id long, event_id long, event string").selectExpr("job_id", "timestamp_seconds(event_id) AS ts", "event_id", "event")
    for k in range(2):
        events.filter(f"(event_id > 4) = {bool(k)}".lower()).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = jobs.state_changes(stream).writeStream.outputMode("update").format("memory").queryName("states").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    want = {(r["job_id"], r["status"]) for r in fold_states(events, "job_id", ["event_id"], "event").collect()}
    assert want <= {(r["job_id"], r["status"]) for r in spark.table("states").collect()}


def test_each_key_once(spark, tmp_path):
    df = spark.createDataFrame([("p", "a", 1), ("p", "a", 2), ("p", "b", 3)], "project string, key string, s long").selectExpr("project", "key", "timestamp_seconds(s) AS at")
    df.coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("project string, key string, at timestamp").json(str(tmp_path / "in"))
    q = jobs.create_once(stream, ["project", "key"], "at", "1 hour").writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("once").count() == 2
