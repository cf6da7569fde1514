from datetime import datetime, timedelta

from topolane.operators import ledger
from topolane.streaming import ledger as stream


def test_stream_equals_batch(spark, tmp_path):
    names = ["repository_synced", "edit_observed", "verification_started", "verification_passed", "edit_applied", "unknown", "blocked"]
    rows = [(i, f"u{i % 3}", datetime(2026, 1, 1) + timedelta(minutes=i), names[i % 7]) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, lane string, at timestamp, event string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = stream.lane_states(src, "lane", "at", "id", "event").writeStream.outputMode("update").format("memory").queryName("lanes").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.lane: (r.state, r.applied, r.rejected) for r in spark.table("lanes").collect()}
    want = {r.lane: (r.state, r.applied, r.rejected) for r in ledger.replay(df, ["lane"], "at", "id", "event").collect()}
    assert got == want


def test_ingest_keeps_one_copy(spark, tmp_path):
    schema = "delivery_id bigint, received_at timestamp, source struct<harness:string,session_id:string,event_id:string>"
    t = datetime(2026, 1, 1)
    for i, rows in enumerate([[(1, t, ("a", "s", "e")), (2, t, ("a", "s", "e"))], [(3, t, ("A ", "s", "e")), (4, t, ("a", "s", "f"))]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
        src = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        stream.ingest(src, str(tmp_path / "store"), str(tmp_path / "c")).awaitTermination(120)
    assert sorted(r.delivery_id for r in spark.read.parquet(str(tmp_path / "store")).collect()) == [1, 4]


def test_file_batches(spark, tmp_path):
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "a.rs").write_text("fn a() {}")
    seen = []
    stream.watch(spark, str(tmp_path / "w"), lambda df, _: seen.extend(r.path.rsplit("/", 1)[-1] for r in df.collect()), str(tmp_path / "c")).awaitTermination(120)
    assert seen == ["a.rs"]
