"""Views kept by streams equal the batch queries; folds in pieces; signals of runs."""

import random
import time
import uuid

import pytest
from pyspark.sql import functions as F

from inkmesh.functions import geometry, ids
from inkmesh.operators import browse
from inkmesh.streaming import signals
from inkmesh.streaming import views as live

EVENT = "session string, seq long, kind string, dx double, dy double, wheel double, x double, y double"


def files(spark, rows, schema, path, parts):
    """Rows in ``parts`` files, in turn."""
    n = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * n : (i + 1) * n], schema).coalesce(1).write.mode("append").parquet(str(path))
        time.sleep(0.05)  # files are taken in order of their time
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_live_views_equal_the_batch_queries(spark, tmp_path):
    rng = random.Random(6)
    changes, kept = [], {}
    for seq in range(90):
        i, gone = f"n{rng.randrange(12)}", rng.random() < 0.25
        title, category = f"T{rng.randrange(5)}", rng.choice(["", "k", None, "m"])
        changes.append((seq, i, gone, title, category))
        if gone:
            kept.pop(i, None)
        else:
            kept[i] = (title, category, kept[i][2] if i in kept else seq)
    stream = files(spark, changes, live.CHANGE, tmp_path / "in", 3)
    live.keep_views(stream, str(tmp_path / "deltas"), str(tmp_path / "cp")).awaitTermination()
    found = live.read_deltas(spark, str(tmp_path / "deltas"))
    assert found.select("batch").distinct().count() == 3
    notes = spark.createDataFrame([(i, *r) for i, r in kept.items()], "id string, title string, category string, seq long")
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert rows(live.live_counts(found)) == rows(browse.count_by_category(notes))
    assert rows(live.live_titles(found)) == rows(browse.title_last(notes))
    assert rows(live.held(found)) == rows(notes)
    # more changes go on from the state that is there; an old one does nothing
    spark.createDataFrame([(200, "n0", False, "New", "z"), (5, "n1", False, "Old", "old")], live.CHANGE).write.mode("append").parquet(str(tmp_path / "in"))
    live.keep_views(stream, str(tmp_path / "deltas"), str(tmp_path / "cp")).awaitTermination()
    after = {r["id"]: r["title"] for r in live.held(live.read_deltas(spark, str(tmp_path / "deltas"))).collect()}
    assert after == {i: r[0] for i, r in kept.items()} | {"n0": "New"}


def gestures(n, seed):
    rng = random.Random(seed)
    return [(rng.choice("aab"), seq, rng.choice(["pan", "wheel"]), rng.uniform(-9, 9), rng.uniform(-9, 9), rng.choice([120.0, -120.0, 120.0]), rng.uniform(0, 800), rng.uniform(0, 600)) for seq in range(n)]


def folded(rows):
    out = {}
    for session, _, kind, dx, dy, wheel, x, y in rows:
        z, ox, oy = out.get(session, (1.0, 0.0, 0.0))
        out[session] = (z, ox + dx / z, oy + dy / z) if kind == "pan" else geometry.zoom_step(z, ox, oy, wheel, x, y)
    return out


@pytest.mark.parametrize("width", [1, 7, 4096])
def test_a_fold_in_pieces_equals_one_fold(spark, width):
    rows = gestures(150, width)
    got = {r["session"]: tuple(r)[1:] for r in geometry.view_after(spark.createDataFrame(rows, EVENT), width=width).collect()}
    want = folded(rows)
    assert set(got) == set(want) and all(got[s] == pytest.approx(want[s]) for s in want)


def test_session_views_equal_the_fold(spark, tmp_path):
    rows = gestures(60, 9)
    stream = live.session_views(files(spark, rows, EVENT, tmp_path / "in", 3))
    name = f"views{uuid.uuid4().hex}"
    stream.writeStream.format("memory").queryName(name).outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    last = spark.table(name).groupBy("session").agg(F.max_by(F.struct("zoom", "offset_x", "offset_y"), "seq").alias("v"))
    got = {r["session"]: tuple(r["v"]) for r in last.collect()}
    want = folded(rows)
    assert set(got) == set(want) and all(got[s] == pytest.approx(want[s]) for s in want)


def test_signals_of_runs(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "in"))
    listener = signals.Signals(spark, str(tmp_path / "signals"))
    spark.streams.addListener(listener)

    def broken(batch, number):
        raise RuntimeError("no way")

    try:
        stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
        stream.writeStream.queryName("good").foreachBatch(lambda df, i: df.count()).option("checkpointLocation", str(tmp_path / "a")).trigger(availableNow=True).start().awaitTermination()
        with pytest.raises(Exception, match="no way"):
            stream.writeStream.queryName("bad").foreachBatch(broken).option("checkpointLocation", str(tmp_path / "b")).trigger(availableNow=True).start().awaitTermination()
        want = {("good", "started"), ("good", "progress"), ("good", "finished"), ("bad", "started"), ("bad", "failed")}
        for _ in range(100):
            told = signals.read_signals(spark, str(tmp_path / "signals")).collect() if (tmp_path / "signals").exists() else []
            if want <= {(r["name"], r["signal"]) for r in told}:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert want <= {(r["name"], r["signal"]) for r in told}
    assert [r["rows"] for r in told if r["signal"] == "progress" and r["rows"]] == [5]
    assert ["no way" in r["message"] for r in told if r["signal"] == "failed"] == [True]


def test_ids_are_version_5_and_tell_parts_apart(spark):
    df = spark.createDataFrame([("a", "b"), ("ab", ""), ("a", None), ("a", "b")], "p string, q string")
    got = [r[0] for r in df.select(ids.name_uuid("p", "q")).collect()]
    assert len(set(got)) == 3 and got[0] == got[3] and all(uuid.UUID(g).version == 5 and uuid.UUID(g).variant == uuid.RFC_4122 for g in got)


@pytest.mark.parametrize("whole", [16, 2])
def test_deltas_take_whole_batches_and_repeats(spark, tmp_path, whole, monkeypatch):
    """Late, repeated and negative numbers do nothing, over batches; no Python runs for a note."""
    monkeypatch.setattr(live, "WHOLE", whole)
    assert "Pandas" not in live.deltas(live.steps(spark.createDataFrame([], live.CHANGE), spark.createDataFrame([], live.STATE)))._jdf.queryExecution().toString()
    rng, kept, seen, batches = random.Random(whole), {}, {}, []
    for b in range(5):
        batch = {(seq := rng.randrange(30 * b - 12, 30 * b + 30), i): (seq, i, rng.random() < 0.3, f"T{rng.randrange(5)}", rng.choice([None, "k"])) for _ in range(25) for i in [f"n{rng.randrange(9)}"]}
        batches.append(list(batch.values()))
        for seq, i, gone, title, category in sorted(batches[-1]):
            if seq <= seen.get(i, -1):
                continue
            seen[i] = seq
            if gone:
                kept.pop(i, None)
            else:
                kept[i] = (title, category, kept[i][2] if i in kept else seq)
    n = max(map(len, batches))
    for b, rows in enumerate(batches):
        spark.createDataFrame(rows + rows[-1:] * (n - len(rows)), live.CHANGE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(live.CHANGE).parquet(str(tmp_path / "in"))
        live.keep_views(stream, str(tmp_path / "deltas"), str(tmp_path / "cp")).awaitTermination()
    got = live.held(live.read_deltas(spark, str(tmp_path / "deltas"))).collect()
    assert {r["id"]: (r["title"], r["category"], r["place"]) for r in got} == kept
