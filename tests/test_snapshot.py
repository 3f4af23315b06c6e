"""The store: changes laid over a base, and commits of several writers."""

import datetime as dt
import os
import threading

import pytest
from pyspark.sql import functions as F

from inkmesh.operators import store
from inkmesh.schemas import LINKS, NOTES, SETTINGS
from inkmesh.sources import snapshot
from inkmesh.sources.snapshot import Change, Conflict, Store

T0 = dt.datetime(2024, 1, 1)
NEW = "id string, title string, content string, category string, ts timestamp_ntz, pos int"


def notes(spark, n):
    return spark.range(n).select(
        F.col("id").cast("string").alias("id"), F.concat(F.lit("t"), F.col("id") % 50).alias("title"), F.sha2(F.col("id").cast("string"), 512).alias("content"), F.concat(F.lit("c"), F.col("id") % 4).alias("category"),
        F.lit(T0).alias("created_at"), F.lit(T0).alias("updated_at"), F.col("id").alias("seq"),
    )


def links(spark, n):
    return spark.range(n).select(F.col("id").cast("string").alias("source_note_id"), (F.col("id") * 3 % n).cast("string").alias("target_note_id"))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names)


def test_changes_read_as_a_full_rewrite_and_cost_what_they_change(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    n, e = notes(spark, 3000), links(spark, 3000)
    s.publish(notes=n, note_links=e)
    whole = size(tmp_path / "store")
    renames = spark.createDataFrame([("7", "# Seven", "k", T0), ("8", "##", "k", T0)], "id string, new_title string, category string, ts timestamp_ntz")
    s.rename_notes(renames)
    gone = spark.createDataFrame([("9",), ("nobody",)], "id string")
    s.delete_notes(gone)
    want_notes, want_links = store.delete_notes(store.rename_notes(n, renames), e, gone)
    assert size(tmp_path / "store") - whole < 0.1 * whole
    assert rows(s.read("notes")) == rows(want_notes) and rows(s.read("note_links")) == rows(want_links)
    s.delete_category("c2")
    want_notes, want_links = store.delete_category(want_notes, want_links, "c2")
    for compacted in (False, True):
        if compacted:
            assert s.compact("notes") == 5 and s.compact("note_links") == 6 and s.compact("notes") == 6
        assert rows(s.read("notes")) == rows(want_notes) and rows(s.read("note_links")) == rows(want_links)
    assert rows(s.read("notes", 1)) == rows(n)  # older versions stay


def test_a_key_may_come_and_go(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    new = lambda i, t: spark.createDataFrame([(i, t, None, None, T0, 0)], NEW)
    assert s.read("notes").count() == 0 and s.version() == 0
    s.insert_notes(new("a", "one"))
    s.delete_notes(spark.createDataFrame([("a",)], "id string"))
    assert s.read("notes").count() == 0
    s.insert_notes(new("a", "two"))
    assert [(r["title"], r["seq"]) for r in s.read("notes").collect()] == [("two", 0)]
    with pytest.raises(ValueError):
        s.insert_notes(new("a", "three"))
    with pytest.raises(ValueError):
        s.insert_links(spark.createDataFrame([("a", "a"), ("a", "b")], LINKS))
    v = s.insert_links(spark.createDataFrame([("a", "a"), ("a", "a")], LINKS))
    assert s.insert_links(spark.createDataFrame([("a", "a")], LINKS)) == v == s.version()  # nothing new, no version
    assert rows(s.read("note_links")) == [("a", "a")]
    s.put_settings(spark.createDataFrame([("theme", "dark", 1), ("theme", "light", 2)], "key string, value string, seq int"))
    s.put_settings(spark.createDataFrame([("theme", None, 1)], "key string, value string, seq int"))
    assert rows(s.read("settings")) == [("theme", None)]
    s.publish(settings=spark.createDataFrame([("x", "y")], SETTINGS))
    assert rows(s.read("settings")) == [("x", "y")] and s.read("notes").count() == 1


def test_only_one_writer_gets_a_version(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    got = []
    threads = [threading.Thread(target=lambda i=i: got.append((s._create(f"{s.root}/commits/1.json", f'{{"w": {i}}}'), i))) for i in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    (winner,) = [i for ok, i in got if ok]
    assert s.snapshot().state == {"w": winner} and sorted(os.listdir(tmp_path / "store" / "commits"))[-1] == "1.json"


def test_two_writers_lose_no_update(spark, tmp_path):
    """Both build on one version; the second is built again, and sees the first's rows."""
    s, other = Store(spark, str(tmp_path / "store")), Store(spark, str(tmp_path / "store"))
    s.publish(notes=notes(spark, 20))
    new = lambda i: spark.createDataFrame([(i, "n", None, None, T0, 0)], NEW)
    builds = []

    def slow(now):
        builds.append(now.version)
        if len(builds) == 1:
            other.insert_notes(new("theirs"))  # takes the version that this one is built for
        last = now.read("notes").agg(F.max("seq")).first()[0]
        row = new("ours").select("id", "title", "content", "category", F.col("ts").alias("created_at"), F.col("ts").alias("updated_at"), F.lit(last + 1).cast("long").alias("seq"))
        return {"notes": Change(row.select(*NOTES.fieldNames()))}

    assert s.commit(slow) == 3 and builds == [1, 2]
    assert {r["id"]: r["seq"] for r in s.read("notes").where("seq >= 20").collect()} == {"theirs": 20, "ours": 21}
    with pytest.raises(Conflict):
        s.commit(lambda now: (other.insert_notes(new(f"x{now.version}")), {"notes": Change(deletes=new("ours"))})[1], retries=1)
    assert s.read("notes").where("id = 'ours'").count() == 1


def test_checks_are_made_again(spark, tmp_path):
    """A link whose end another writer deletes meanwhile is refused, and a compaction gives way."""
    s, other = Store(spark, str(tmp_path / "store")), Store(spark, str(tmp_path / "store"))
    s.publish(notes=notes(spark, 5))
    wanted, seen = spark.createDataFrame([("1", "2")], LINKS), []

    def build(now):
        if store.dangling(now.read("notes"), wanted).count():
            raise ValueError("an end is gone")
        if not seen:
            seen.append(other.delete_notes(spark.createDataFrame([("2",)], "id string")))
        return {"note_links": Change(wanted)}

    with pytest.raises(ValueError):
        s.commit(build)
    assert s.read("note_links").count() == 0 and s.version() == 2
    (tmp_path / "store" / "commits" / "9.json.tmp").write_text("a commit that broke off")
    assert s.version() == 2


@pytest.mark.parametrize("most", [0, 200_000])
def test_a_rename_does_not_write_texts_again(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(snapshot, "BROADCAST_KEYS", most)
    s = snapshot.Store(spark, f"file://{tmp_path}/store")
    t0 = dt.datetime(2024, 1, 1)
    s.publish(notes=spark.createDataFrame([(i, f"T{i}", None if i == "c" else f"text {i}", "k", t0, t0, k) for k, i in enumerate("abcd")], NOTES))
    renames = lambda ids: spark.createDataFrame([(i, f"New {i}", "r", t0) for i in ids], "id string, new_title string, category string, ts timestamp_ntz")
    s.rename_notes(renames("abc"))
    change = s.snapshot().state["notes"]["changes"][-1]
    assert spark.read.parquet(f"{s.root}/data/{change['path']}").where("content IS NOT NULL").count() == 0
    s.update_notes(spark.createDataFrame([("a", "A", "other", "u", t0)], "id string, title string, content string, category string, ts timestamp_ntz"))
    s.rename_notes(renames("ad"))
    s.delete_notes(spark.createDataFrame([("b",)], "id string"))
    s.insert_notes(spark.createDataFrame([("b", "B", "anew", "n", t0, 0), ("e", "E", "text e", "n", t0, 1)], "id string, title string, content string, category string, ts timestamp_ntz, pos int"))
    s.rename_notes(renames("e"))
    want = [("a", "New a", "other", "r"), ("b", "B", "anew", "n"), ("c", "New c", None, "r"), ("d", "New d", "text d", "r"), ("e", "New e", "text e", "r")]
    rows = lambda: sorted(tuple(r) for r in s.read("notes").select("id", "title", "content", "category").collect())
    assert rows() == want
    s.compact("notes")
    assert rows() == want and not s.snapshot().state["notes"]["changes"]
