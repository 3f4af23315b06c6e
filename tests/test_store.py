"""Store, graph, ingest and snapshots, against a small model and on the five-note graph."""

import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkmesh.operators import browse, graph, store
from inkmesh.plans import ingest
from inkmesh.schemas import LINKS, NOTES, SETTINGS
from inkmesh.sources import documents
from inkmesh.sources.snapshot import Store
from inkmesh.streaming import debounce

T0 = dt.datetime(2024, 1, 1)


def notes(spark, rows):
    """(id, title, category) rows."""
    return spark.createDataFrame([(i, t, f"# {t}", c, T0, T0, k) for k, (i, t, c) in enumerate(rows)], NOTES)


def five(spark):
    n = notes(spark, [(str(i), f"Note {x}", "") for i, x in enumerate("ABCDE", 1)])
    return n, spark.createDataFrame([("1", "2"), ("1", "3"), ("2", "4"), ("3", "5"), ("4", "5")], LINKS)


def pairs(df):
    return sorted(tuple(r) for r in df.collect())


def test_five_note_graph(spark):
    n, e = five(spark)
    for note, want in (("1", "23"), ("4", "25"), ("5", "34")):
        assert sorted(r[0] for r in graph.neighbors_of(e, note).collect()) == list(want)
    assert pairs(store.delete_notes(n, e, n.where("id = '5'"))[1]) == [("1", "2"), ("1", "3"), ("2", "4")]
    assert not store.unlinked(e, "2", "1") and store.unlink(e, "2", "1").count() == 5
    assert store.unlinked(e, "1", "2") and store.unlink(e, "1", "2").count() == 4
    status = store.link_status(n, e, spark.createDataFrame([("1", "2"), ("2", "1"), ("1", "9")], LINKS))
    assert {r[:2]: r[2] for r in map(tuple, status.collect())} == {("1", "2"): False, ("2", "1"): True, ("1", "9"): False}
    assert [browse.note_count(n, c).first()[0] for c in ("All Notes", "", "x")] == [5, 5, 0]
    assert sorted(r["id"] for r in browse.search(n, "note", "1").collect()) == ["2", "3", "4", "5"]
    assert graph.linked_titles_of(n, e, "1").count() == 2 and graph.strict(e.unionByName(e)).count() == 5


def test_self_link_and_null_category(spark):
    n = notes(spark, [("a", "x", None), ("b", "x", ""), ("c", "y", "k")])
    e = spark.createDataFrame([("a", "a"), ("c", "a")], LINKS)
    assert pairs(graph.both_ways(e)) == [("a", "a"), ("a", "c"), ("c", "a")]
    assert browse.note_count(n, "").first()[0] == 1 and [r[0] for r in browse.categories(n).collect()] == ["k"]
    left, links = store.delete_category(n, e, "k")
    assert left.count() == 2 and pairs(links) == [("a", "a")]
    assert browse.id_by_title(n, "x").first()["id"] == "a" and browse.open_by_title(n, "x").first()["id"] == "b"
    assert browse.open_by_id(n, "a").count() == 0 and browse.open_by_id(n, "b").first()["category"] == ""
    assert browse.chosen_category(n, 1, None) == "k" and browse.chosen_category(n, None, "nope") == "All Notes" and browse.category_exists(n, "k")
    assert [browse.chosen_category(n, i, name) for i, name in ((0, "k"), (2, "k"), (9, None), (None, ""))] == ["All Notes", "k", "All Notes", "All Notes"]
    asked = spark.createDataFrame([("a",), ("zz",), ("a",)], "id string")
    assert sorted(map(tuple, browse.message_titles(n, asked).collect())) == [("a", "x"), ("a", "x"), ("zz", "the selected note")]
    assert browse.search(n, "", None).count() == 3


def test_inserts_are_all_or_nothing(spark):
    n, e = five(spark)
    new = spark.createDataFrame([("6", "F", "f", None, T0, 0), ("7", "G", "g", "c", T0, 1)], "id string, title string, content string, category string, ts timestamp_ntz, pos int")
    after = store.insert_notes(n, new)
    assert [r["seq"] for r in after.orderBy("seq").collect()] == list(range(7))
    for bad in (new.unionByName(new), new.withColumn("id", F.lit("1")).limit(1)):
        with pytest.raises(ValueError):
            store.insert_notes(n, bad)
    assert store.insert_links(n, e, spark.createDataFrame([("1", "2"), ("5", "5"), ("5", "5")], LINKS)).count() == 6
    with pytest.raises(ValueError):
        store.insert_links(n, e, spark.createDataFrame([("5", "1"), ("1", "9")], LINKS))


def test_updates(spark):
    n = notes(spark, [("a", "x", "k"), ("b", "y", "k")])
    patch = spark.createDataFrame([("a", "z", None, T0), ("zz", "q", "q", T0)], "id string, title string, content string, ts timestamp_ntz")
    got = {r["id"]: r for r in store.update_notes(n, patch).collect()}
    assert len(got) == 2 and (got["a"]["title"], got["a"]["content"], got["a"]["category"]) == ("z", None, "") and got["b"]["category"] == "k"
    names = spark.createDataFrame([("a", "# new *t*", "c", T0), ("b", "##", "c", T0), ("q", "x", "c", T0)], "id string, new_title string, category string, ts timestamp_ntz")
    assert {r["id"]: r["title"] for r in store.rename_notes(n, names).collect()} == {"a": "new t", "b": "y"}
    assert {r["id"]: r["ok"] for r in store.rename_status(n, names).collect()} == {"a": True, "b": False, "q": False}
    assert store.save_by_id(n, "new", "# raw_title\nbody", "c", F.lit(T0)).where("id = 'new'").first()["title"] == "# raw_title"
    assert store.save_by_id(n, "a", "\nbody", "c", F.lit(T0)).where("id = 'a'").first()["title"] == "Untitled Note"


def test_settings(spark):
    log = spark.createDataFrame([("a", "1", 1), ("b", "x", 2), ("a", None, 3)], "key string, value string, seq int")
    after = store.settings_after(log)
    assert {r["key"]: r["value"] for r in after.collect()} == {"a": None, "b": "x"}
    assert store.setting(after, "b").first()[0] == "x" and store.setting(after, "c").count() == 0


class Model:
    """What saves do, one after the other."""

    def __init__(self, rows):
        self.rows = {i: {"title": t, "content": f"# {t}", "category": c, "seq": k} for k, (i, t, c) in enumerate(rows)}

    def save(self, note_id, new_id, title, content, category):
        owners = [i for i, r in self.rows.items() if r["title"] == title]
        if owners:
            note_id = min(owners, key=lambda i: self.rows[i]["seq"])
        elif note_id is None:
            note_id = new_id
            self.rows[note_id] = {"seq": max((r["seq"] for r in self.rows.values()), default=-1) + 1}
        if note_id in self.rows:
            self.rows[note_id].update(title=title, content=content, category=category)


SAVE = st.tuples(st.sampled_from([None, None, "a", "b", "c", "zz"]), st.sampled_from(["P", "Q", "R", "##", "S"]), st.sampled_from(["", "k"]))
START = [("a", "P", "k"), ("b", "P", ""), ("c", "Q", "")]


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(SAVE, min_size=1, max_size=10))
def test_saves_equal_the_model(spark, saves):
    n = notes(spark, START)
    model = Model(START)
    rows = []
    for k, (note_id, title, category) in enumerate(saves):
        clean = "Untitled Note" if title == "##" else title
        content = f"{'' if title == '##' else '# '}{title}\nbody {k}"
        model.save(note_id, f"n{k}", clean, content, category)
        rows.append((k, note_id, f"n{k}", content, category, T0))
    log = spark.createDataFrame(rows, "pos int, note_id string, new_id string, content string, category string, ts timestamp_ntz")
    got = {r["id"]: (r["title"], r["content"], r["category"]) for r in store.save_replay(n, log).collect()}
    assert got == {i: (r["title"], r["content"], r["category"]) for i, r in model.rows.items()}
    if all(s[0] is None for s in saves):
        fast = store.save_new(n, log.withColumnRenamed("new_id", "id").drop("note_id"))
        assert {r["id"]: (r["title"], r["content"], r["category"]) for r in fast.collect()} == got


def test_saves_of_many_stores(spark):
    n = notes(spark, START).withColumn("store", F.explode(F.array(F.lit("s"), F.lit("t"))))
    log = spark.createDataFrame([("s", 0, "c", "n0", "# P\nover", "", T0), ("u", 0, None, "n1", "# New", "", T0)], "store string, pos int, note_id string, new_id string, content string, category string, ts timestamp_ntz")
    got = {(r["store"], r["id"]): r["content"] for r in store.save_replay(n, log).collect()}
    assert got["s", "a"] == "# P\nover" and got["s", "c"] == "# Q" and got["t", "a"] == "# P" and got["u", "n1"] == "# New" and len(got) == 7


def test_ingest(spark):
    n = notes(spark, [("o1", "Old", ""), ("o2", "Old", ""), ("o3", "A", "")])
    e = spark.createDataFrame([("o1", "o2")], LINKS)
    reply = '[{"title":"A","connections":["Old","A","nope",""]},{"title":"# X","connections":["# X"]},{"title":"A","content":"c","general_title":null}]'
    replies = spark.createDataFrame([("b", reply), ("bad", "oops")], "batch_id string, reply string")
    after, links, missed = ingest.ingest(n, e, replies, F.concat(F.lit("n"), F.col("pos").cast("string")), F.lit(T0))
    rows = {r["id"]: r for r in after.collect()}
    assert len(rows) == 6 and rows["n1"]["title"] == "# X" and rows["n0"]["content"] == "# A\n\n" and rows["n2"]["category"] is None and rows["n0"]["category"] == "AI Generated"
    assert pairs(links) == [("n0", "n2"), ("n0", "o2"), ("o1", "o2")]
    assert sorted(r["title"] for r in missed.collect()) == ["Untitled Note", "X", "nope"]


def test_generation_is_injected(spark):
    texts = spark.createDataFrame([("p", "some text"), ("q", None), ("r", "")], "path string, text string")
    out = ingest.generate(texts, lambda prompts: [f"[{len(p) > 100}]".lower() for p in prompts])
    assert [(r["batch_id"], r["reply"]) for r in out.collect()] == [("p", "[true]")]

    def broken(prompts):
        raise OSError("no network")

    assert [r["reply"] for r in ingest.generate(texts, broken).collect()] == [None]


def test_snapshots(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    assert s.version() == 0 and s.read("notes").count() == 0
    n, e = five(spark)
    assert s.publish(notes=n, note_links=e) == 1
    left, links = store.delete_notes(s.read("notes"), s.read("note_links"), s.read("notes").where("id = '1'"))
    assert s.publish(notes=left, note_links=links) == 2
    assert (s.read("notes").count(), s.read("note_links").count(), s.read("notes", 1).count()) == (4, 3, 5)
    assert s.publish(settings=spark.createDataFrame([("theme", "dark")], SETTINGS)) == 3 and s.read("notes").count() == 4
    (tmp_path / "store" / "commits" / "_v9").write_text("")  # a commit that broke off
    assert s.version() == 3


def test_documents_and_log(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("eins\fzwei".encode())
    (tmp_path / "b.txt").write_bytes(b"\xff\xfe\xff")
    got = {r["path"][-5:]: r["text"] for r in documents.read_documents(spark, str(tmp_path), glob="*.txt").collect()}
    assert got == {"a.txt": "einszwei", "b.txt": None}
    pages = spark.createDataFrame([("p", 2, "b"), ("p", 1, "a"), ("p", 10, None), ("q", 1, "x")], "path string, page int, text string")
    assert {r["path"]: r["text"] for r in documents.join_pages(pages).collect()} == {"p": "ab", "q": "x"}
    log = spark.createDataFrame([(T0, "hello")], "ts timestamp_ntz, message string")
    documents.append_log(log, str(tmp_path / "log"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "log")).collect()] == ["[2024-01-01T00:00:00.000000] hello"]


def test_debounce_stream_equals_batch(spark, tmp_path):
    rows = [(i, u, T0 + dt.timedelta(minutes=m)) for i, (u, m) in enumerate([(1, 0), (1, 30), (1, 200), (2, 5), (2, 64), (2, 130), (1, 100_000), (2, 100_000)])]
    events = spark.createDataFrame(rows, "event_id int, user_id int, ts timestamp_ntz")
    events.write.parquet(str(tmp_path / "in"))
    want = sorted((r["user_id"], r["event_id"]) for r in debounce.debounce_batch(events).collect())
    stream = debounce.debounce_stream(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("bursts").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r["user_id"], r["event_id"]) for r in spark.table("bursts").collect())
    assert got == [w for w in want if w[1] not in (6, 7)]  # the last bursts are still open


def test_refresh_gets_each_batch(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "in"))
    seen = []
    q = debounce.refresh_views(spark.readStream.schema("id long").parquet(str(tmp_path / "in")), lambda df, i: seen.append(df.count()), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert sum(seen) == 3
