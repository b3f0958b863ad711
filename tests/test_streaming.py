import json

from lodestar.streaming import deltas as D


def write(path, name, rows):
    path.mkdir(exist_ok=True)
    (path / name).write_text("".join(json.dumps(dict(zip(("client", "seq", "action", "uri", "content_hash"), r, strict=True))) + "\n" for r in rows))


def test_live_files_follow_deltas(spark, tmp_path):
    source = tmp_path / "in"
    write(source, "1.json", [("x", 1, "upsert", "a", "1"), ("x", 2, "upsert", "b", "2"), ("y", 3, "delete", "a", None)])
    seen = []
    live = D.LiveFiles(spark, str(tmp_path / "live"), lambda df, n: seen.append((n, df.count())))
    live.start(D.read_deltas(spark, str(source)), str(tmp_path / "cp")).awaitTermination()
    assert [(r["uri"], r["content_hash"]) for r in live.read().collect()] == [("b", "2")]
    write(source, "2.json", [("x", 4, "upsert", "a", "4"), ("x", 1, "upsert", "b", "stale"), ("x", 4, "upsert", "a", "4")])
    live.start(D.read_deltas(spark, str(source), 1), str(tmp_path / "cp")).awaitTermination()
    assert sorted((r["uri"], r["content_hash"]) for r in live.read().collect()) == [("a", "4"), ("b", "2")]
    assert live.notices_for("x").count() == 0  # deletes aren't announced
    assert {(r["source_session"], r["affected_uris"]) for r in live.notices_for("y").collect()} == {("x", "a"), ("x", "a,b")}
    assert seen == [(0, 2), (1, 1)]


def test_each_client_has_its_own_sequence(spark, tmp_path):
    live = D.LiveFiles(spark, str(tmp_path / "live"), buckets=4)
    live.merge(spark.createDataFrame([("A", 500, "upsert", "u", "old"), ("A", 501, "delete", "v", None)], D.CHANGES), 0)
    live.merge(spark.createDataFrame([("B", 3, "upsert", "u", "new"), ("A", 400, "upsert", "v", "late")], D.CHANGES), 1)
    assert [(r["uri"], r["content_hash"]) for r in live.read().collect()] == [("u", "new")]
    for n in range(2, 6):
        live.merge(spark.createDataFrame([("B", n + 2, "upsert", f"w{n}", "x")], D.CHANGES), n)
    live.merge(spark.createDataFrame([("B", 7, "upsert", "w5", "x")], D.CHANGES), 5)  # again
    assert sorted(r["uri"] for r in live.read().collect()) == ["u", "w2", "w3", "w4", "w5"]
    assert len([p for p in (tmp_path / "live" / "manifest").iterdir() if p.name.startswith("batch=")]) == 2


def test_keyed_state_outlives_a_delete(spark, tmp_path):
    source = tmp_path / "in"
    write(source, "1.json", [("A", 500, "upsert", "u", "old"), ("A", 501, "delete", "v", None)])
    state = D.live_state(D.read_deltas(spark, str(source)))
    write(source, "2.json", [("B", 3, "upsert", "u", "new"), ("A", 400, "upsert", "v", "late")])
    q = state.writeStream.format("memory").queryName("two_clients").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["uri"]: (r["action"], r["seq"]) for r in spark.table("two_clients").collect()}
    assert got == {"u": ("upsert", 3), "v": ("delete", 501)}


def test_a_batch_that_runs_twice_changes_nothing(spark, tmp_path):
    live = D.LiveFiles(spark, str(tmp_path / "live"))
    batch = spark.createDataFrame([("x", 1, "upsert", "a", "1")], D.CHANGES)
    live.merge(batch, 0)
    live.merge(batch, 0)
    assert live.read().count() == 1


def test_keyed_state(spark, tmp_path):
    source = tmp_path / "in"
    write(source, "1.json", [("x", 1, "upsert", "a", "1"), ("x", 2, "upsert", "a", "2"), ("x", 3, "delete", "b", None)])
    q = D.live_state(D.read_deltas(spark, str(source))).writeStream.format("memory").queryName("live_state").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["uri"], r["action"], r["seq"]) for r in spark.table("live_state").collect()) == [("a", "upsert", 2), ("b", "delete", 3)]


def test_written_changes_arrive_in_order_from_several_files(spark, monkeypatch):
    """No task writes all changes: files have about CHANGES rows, and later files have later ones."""
    from lodestar.plans import lifecycle

    data = "/root/testdata/sf0.001"
    want = sorted(map(tuple, lifecycle.live_file_state(spark, data).collect()))
    monkeypatch.setattr(lifecycle, "CHANGES", 300)
    path = lifecycle._written_changes(spark, data)
    rows = spark.read.json(path).select("seq", "_metadata.file_modification_time", "_metadata.file_name").toPandas()
    spans = rows.groupby(["file_modification_time", "file_name"])["seq"].agg(["min", "max", "count"]).sort_index()
    assert len(spans) == 4 and spans["count"].max() < 400 and len(rows) == 1000
    assert (spans["min"].to_numpy()[1:] > spans["max"].to_numpy()[:-1]).all()
    assert sorted(map(tuple, lifecycle.live_file_state(spark, data).collect())) == want
