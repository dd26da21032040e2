import json

from pagelode.streaming.changes import changed_pages, delta, payload_deltas, settled


def test_delta_is_unchanged_partial_or_full():
    history, first = delta([], {"a": 1, "_etag": "x"}, None, 4)
    assert first["mode"] == "full"
    history, same = delta(history, {"a": 1}, first["version"], 4)
    assert same["mode"] == "unchanged"
    history, part = delta(history, {"b": 2}, first["version"], 4)
    assert part["mode"] == "partial" and part["fields"] == {"b": 2} and part["dropped"] == ["a"]
    for n in range(6):
        history, _ = delta(history, {"b": n + 10}, None, 4)
    assert len(history) == 4 and delta(history, {"b": 1}, first["version"], 4)[1]["mode"] == "full"


def test_stream_of_payloads_equals_the_batch(spark, tmp_path):
    rows = [(f"k{n % 3}", n, json.dumps({"v": n // 6, "w": n % 3})) for n in range(18)]
    source = tmp_path / "in"
    for part in range(3):
        spark.createDataFrame(rows[part * 6 : part * 6 + 6], "key string, ord long, payload string").coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema("key string, ord long, payload string").option("maxFilesPerTrigger", 1).parquet(str(source))
    q = payload_deltas(stream).writeStream.format("memory").queryName("deltas").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r.key, r.mode, r.fields) for r in spark.sql("select * from deltas").collect())
    want = []
    for key in ("k0", "k1", "k2"):
        history = []
        for k, _, payload in rows:
            if k == key:
                history, sent = delta(history, json.loads(payload), history[-1][0] if history else None, 4)
                want.append((key, sent["mode"], json.dumps(sent["fields"], sort_keys=True)))
    assert got == sorted(want)


def test_settling_and_changed_pages(spark):
    events = spark.sql("select 1L as user_id, timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,x) as ts from values (0), (0.1), (9) t(x)")
    assert sorted(r.events for r in settled(events).collect()) == [1, 2]
    a = spark.createDataFrame([(1, "x"), (2, None)], "page_id long, html string")
    b = spark.createDataFrame([(1, "y"), (2, None), (3, "z")], "page_id long, html string")
    assert sorted(r.page_id for r in changed_pages(a, b).collect()) == [1, 3]
