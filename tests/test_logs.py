"""Logs: flush and rotation under failures, compaction, scans of broken lines; JSON of strangers and YAML."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from folioforge import streaming
from folioforge.functions import safejson
from folioforge.shared import files_under
from folioforge.sources import jsonl, yamlstats

SCHEMA = "id long, pad string"


def feed(spark, tmp_path, begin, end):
    """One file of records for a stream that reads a file a batch."""
    spark.range(begin, end, numPartitions=1).select("id", F.repeat(F.lit("x"), F.lit(50)).alias("pad")).coalesce(1).write.mode("append").json(str(tmp_path / "in"))


def start(spark, tmp_path, checkpoint="checkpoint", **settings):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    return streaming.buffered_log(stream, str(tmp_path / "log"), str(tmp_path / checkpoint), every=None, **settings)


def ids(spark, tmp_path, part="both"):
    return sorted(r.id for r in streaming.read_log(spark, str(tmp_path / "log"), SCHEMA, part).collect())


def test_each_record_stands_once_when_a_batch_dies_before_its_commit(spark, tmp_path, monkeypatch):
    for k in range(4):
        feed(spark, tmp_path, 250 * k, 250 * k + 250)
    whole, died = streaming._commit, []

    def dies(session, path, state):
        if state["batch"] == 2 and not died:
            died.append(state)
            raise RuntimeError("lost")
        whole(session, path, state)

    monkeypatch.setattr(streaming, "_commit", dies)
    with pytest.raises(Exception, match="lost"):
        start(spark, tmp_path, limit=1 << 30).awaitTermination()
    assert ids(spark, tmp_path) == list(range(500))  # what is not committed is not seen
    start(spark, tmp_path, limit=1 << 30).awaitTermination()
    assert died and ids(spark, tmp_path) == list(range(1000))
    sizes = [spark.read.json(str(tmp_path / "log" / n)).count() for n, _ in streaming.log_state(spark, str(tmp_path / "log"))["current"]]
    assert sizes == [100, 100, 50] * 4  # flushes of a hundred


def test_a_batch_that_comes_again_after_its_commit_does_nothing(spark, tmp_path):
    feed(spark, tmp_path, 0, 300)
    start(spark, tmp_path, limit=10_000).awaitTermination()
    before = streaming.log_state(spark, str(tmp_path / "log"))
    for name in (tmp_path / "checkpoint" / "commits").iterdir():
        name.unlink()
    start(spark, tmp_path, limit=10_000).awaitTermination()
    assert streaming.log_state(spark, str(tmp_path / "log")) == before
    feed(spark, tmp_path, 300, 350)
    start(spark, tmp_path, checkpoint="other", limit=1 << 30).awaitTermination()  # a new stream goes on with the log, and reads its files anew
    assert ids(spark, tmp_path, "current")[-50:] == list(range(300, 350)) and streaming.log_state(spark, str(tmp_path / "log"))["n"] > before["n"]


def test_rotation_at_the_limit_keeps_one_old_part(spark, tmp_path):
    state = {"n": 0, "query": None, "batch": -1, "current": [], "old": []}
    state = streaming.rotated(state, [("a", 60), ("b", 40), ("c", 10)], 100)
    assert (state["current"], state["old"]) == ([["c", 10]], [["a", 60], ["b", 40]])
    state = streaming.rotated(state, [("d", 89)], 100)
    assert (state["current"], state["old"]) == ([["c", 10], ["d", 89]], [["a", 60], ["b", 40]])
    for k in range(5):
        feed(spark, tmp_path, 100 * k, 100 * k + 100)
    start(spark, tmp_path, limit=10_000).awaitTermination()  # a flush of 100 has about 7 kB: two flushes a part
    assert ids(spark, tmp_path) == list(range(200, 500)) and ids(spark, tmp_path, "old") == list(range(200, 400))
    left = [f for f, _, _ in files_under(spark, str(tmp_path / "log")) if f.startswith("flushes") and any(n.endswith(".json") for n, _, _ in files_under(spark, f"{tmp_path}/log/{f}"))]
    assert len(left) == 3  # what was rotated out is gone


def test_compaction_keeps_the_replay_and_survives_a_failure(spark, tmp_path, monkeypatch):
    where = str(tmp_path / "ops")
    log = "op string, id string, entry string, timestamp long, line_no long"
    rows = [("add", "a", "1", 1, 1), ("add", "b", "1", 1, 2), ("update", "a", "2", 2, 3), ("delete", "b", None, 3, 4), ("add", "c", None, 3, 5)]
    jsonl.append_operations(spark.createDataFrame(rows, log), where)
    live = lambda: sorted((r.id, r.entry) for r in jsonl.replay(jsonl.read_operations(spark, where)).collect())
    before = live()
    assert before == [("a", "2"), ("c", None)]
    held = jsonl.read_operations(spark, where)
    monkeypatch.setattr(jsonl, "_point", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        jsonl.compact(spark, where, 9)
    monkeypatch.undo()
    assert live() == before and jsonl.read_operations(spark, where).count() == 5
    assert jsonl.compact(spark, where, 9) == 1
    assert live() == before and jsonl.read_operations(spark, where).count() == 2
    assert held.count() == 5  # a reader of the generation before is not disturbed
    jsonl.append_operations(spark.createDataFrame([("delete", "a", None, 10, 1)], log), where)
    assert live() == [("c", None)]


def test_scans_of_broken_lines(spark, tmp_path):
    lines = ['{"id": 1, "pad": "a"}', "{broken", "", '{"id": 2}', "null", "[1]"]
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.json").write_text("\n".join(lines) + "\n")
    path = str(tmp_path / "f")
    assert [r.id for r in jsonl.scan_jsonl(spark, path, SCHEMA).where("id is not null").collect()] == [1, 2]
    with pytest.raises(Exception, match="MALFORMED_RECORD|Malformed"):
        jsonl.scan_jsonl(spark, path, SCHEMA, "fail").collect()
    kept = jsonl.scan_jsonl(spark, path, SCHEMA, "keep")
    good = jsonl.quarantined(kept, str(tmp_path / "bad"))
    assert {r.id for r in good.where("id is not null").collect()} == {1, 2}
    assert "{broken" in {r.value for r in spark.read.text(str(tmp_path / "bad")).collect()}


def test_since_reads_only_its_folders(spark, tmp_path):
    rows = spark.range(10).select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("day"), F.to_json(F.struct(F.concat(F.lit("2024-01-"), F.lpad((F.col("id") + 1).cast("string"), 2, "0"), F.lit("T12:00:00")).alias("timestamp"))).alias("value"))
    rows.write.partitionBy("day").text(str(tmp_path / "log"))
    got = jsonl.since(jsonl.scan_jsonl(spark, str(tmp_path / "log"), "timestamp timestamp"), datetime(2024, 1, 8, 13), day="day")
    assert got.count() == 2
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "GreaterThanOrEqual(timestamp" in plan
    assert jsonl.recent(got, 1, F.desc("timestamp")).count() == 1


def test_json_of_strangers(spark):
    deep = "[" * 400 + '{"__proto__": 1, "x": {"prototype": 2, "y": 3}}' + "]" * 400
    texts = [deep, '{"constructor": {"a": 1}}', '"text"', "null", "NaN", "{", None, '{"k": "constructor", "n": 1.50, "é": "\\u00e9"}', "[" * 200_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string").select("k", safejson.safe_json("text").alias("v"), safejson.has_dangerous_keys("text").alias("d")).orderBy("k").collect()
    assert rows[0].v == "[" * 400 + '{"x":{"y":3}}' + "]" * 400 and rows[0].d is True
    assert [r.v for r in rows[1:]] == ["{}", '"text"', "null", None, None, None, '{"k":"constructor","n":1.5,"é":"é"}', None]
    assert [r.d for r in rows[1:]] == [True, False, False, None, None, None, False, None]
    frame = spark.createDataFrame([("{",)], "text string")
    with pytest.raises(Exception, match="JSON cannot be read in settings"):
        frame.select(safejson.safe_json_strict(F.col("text"), "settings").alias("v")).collect()


def test_yaml_of_statistics(spark, tmp_path):
    text = 'a: 1\nlist:\n  - x: 1\n    y: "q: \\"z\\" # no"\n  -\n    x: 2 # c\n  - [a, "b, c"]\n  - - 1\n    - 2\nempty:\nmap:\n  deep:\n    er: \'it\'\'s\'\n  url: http://a.b/c#d\n---\nlast: ~\n'
    assert list(yamlstats.values(text)) == [
        ("a", "1"), ("list.0.x", "1"), ("list.0.y", 'q: "z" # no'), ("list.1.x", "2"), ("list.2.0", "a"), ("list.2.1", "b, c"), ("list.3.0", "1"), ("list.3.1", "2"),
        ("empty", None), ("map.deep.er", "it's"), ("map.url", "http://a.b/c#d"), ("last", None),
    ]
    for broken in ("plain", "a: |\n  x", "a: &b 1", "a: {x: 1}"):
        with pytest.raises(ValueError):
            list(yamlstats.values(broken))
    (tmp_path / "one-stats.yaml").write_text("total_tasks: 7\nrecent_tasks:\n- id: 1\n")
    (tmp_path / "two-stats.yaml").write_text("agent_name: second\nsuccess_rate: 0.5\n")
    (tmp_path / "bad-stats.yaml").write_text("no key")
    (tmp_path / "other.yaml").write_text("total_tasks: 9")
    got = {r.agent: (r.total_tasks, r.success_rate, r.recent_tasks) for r in yamlstats.agent_stats(yamlstats.scan_stats(spark, str(tmp_path))).collect()}
    assert got == {"one": (7.0, 0.0, 1), "second": (0.0, 0.5, 0)}
