"""As-of joins, dense numbers, components and the replay of saves, against loops."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from inkmesh.operators import asof, ordinals, store
from inkmesh.operators.components import connected
from inkmesh.plans import ingest
from inkmesh.schemas import LINKS, NOTES

T0 = dt.datetime(2024, 1, 1)


@pytest.mark.parametrize("inclusive", [False, True])
@pytest.mark.parametrize(("chunk_rows", "listed"), [(1 << 16, 1 << 14), (10, 1 << 14), (10, 0)])
def test_asof_equals_a_loop(spark, tmp_path, inclusive, chunk_rows, listed, monkeypatch):
    monkeypatch.setattr(asof, "LISTED", listed)
    rng = random.Random(chunk_rows + inclusive)
    key = lambda: "hot" if rng.random() < 0.5 else rng.choice([None, "a", "b"])
    events = list({(k, at): (k, at, f"v{i}") for i in range(80) for k, at in [(key(), rng.randrange(300))]}.values())
    probes = [(i, key(), rng.randrange(300)) for i in range(120)]
    want = {}
    for i, k, at in probes:
        before = [(t, v) for key_, t, v in events if key_ == k and (t < at or inclusive and t == at)]
        want[i] = max(before)[1] if before else None
    p = spark.createDataFrame(probes, "row int, k string, at int")
    e = spark.createDataFrame(events, "k string, at int, v string")
    got = asof.last_before(p, e, ["k"], "at", ["v"], inclusive=inclusive, chunk_rows=chunk_rows, folder=str(tmp_path)).collect()
    assert len(got) == len(probes) and {r["row"]: r["v"] for r in got} == want


def test_numbers_are_dense_over_many_partitions(spark, tmp_path):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), F.lit("x").alias("place")).repartition(5)
    got = ordinals.numbered(rows, ["k"], "place", start=10, ranges=7, folder=str(tmp_path / "a"))
    assert got.where("place = k + 10").count() == 1000 and got.columns == ["k", "place"]
    assert ordinals.numbered(rows.limit(0), ["k"], "place", folder=str(tmp_path / "b")).count() == 0


def test_components_of_a_path_a_star_and_loops(spark, tmp_path):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101 + i) for i in range(30)] + [(7, 7), (500, 500), (300, 200), (200, 300)]
    got = {r["node"]: r["component"] for r in connected(spark.createDataFrame(edges, "a long, b long"), str(tmp_path)).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 131)} | {500: 500, 300: 200, 200: 200}


def model(start, saves):
    rows = {i: {"title": t, "content": "", "seq": k} for k, (i, t) in enumerate(start)}
    for pos, note_id, new_id, title, content in saves:
        owners = [i for i, r in rows.items() if r["title"] == title]
        target = min(owners, key=lambda i: rows[i]["seq"]) if owners else note_id or new_id
        if not owners and note_id is None:
            rows[target] = {"seq": len(start) + pos}
        if target in rows:
            rows[target].update(title=title, content=content)
    return {i: (r["title"], r["content"], r["seq"]) for i, r in rows.items()}


SAVE = "pos int, note_id string, new_id string, content string, category string, ts timestamp_ntz"


def replayed(spark, folder, start, saves):
    notes = spark.createDataFrame([(i, t, "", "", T0, T0, k) for k, (i, t) in enumerate(start)], NOTES)
    log = spark.createDataFrame([(p, i, n, c, "", T0) for p, i, n, _, c in saves], SAVE)
    return {r["id"]: (r["title"], r["content"], r["seq"]) for r in store.save_replay(notes, log, folder).collect()}


@pytest.mark.parametrize("few", [8, 1])
def test_mixed_saves_equal_the_model(spark, tmp_path, few, monkeypatch):
    """Several groups of titles and ids, one hot title, ids made within the log, unknown ids."""
    monkeypatch.setattr(store, "FEW_TITLES", few)
    rng = random.Random(few)
    start = [(f"{g}{k}", f"T{g}{rng.randrange(4)}") for g in "abc" for k in range(6)]
    saves = []
    for pos in range(300):
        g = rng.choice("abc")
        title = "Hot" if rng.random() < 0.3 else f"T{g}{rng.randrange(7)}"
        note_id = rng.choice([None, None, f"{g}{rng.randrange(6)}", f"n{rng.randrange(300)}", "unknown"])
        if title == "Hot":
            note_id = rng.choice([None, note_id]) if pos > 150 else None
        saves.append((pos, note_id, f"n{pos}", title, f"# {title}\nbody {pos}"))
    assert replayed(spark, str(tmp_path), start, saves) == model(start, saves)


def test_a_hot_title_is_thinned(spark, tmp_path):
    log = spark.createDataFrame([(p, None if p != 700 else "a", f"n{p}", "Hot" if p != 700 else "Else", True) for p in range(1000)], "pos int, note_id string, new_id string, title string, sure boolean")
    held = spark.createDataFrame([("Hot", "a"), ("Else", "a")], "title string, note_id string")
    kept = sorted(r["pos"] for r in store._thinned(log, held, [], str(tmp_path)).collect())
    assert kept == [0, 699, 700, 701, 999]


def test_notes_out_of_reach_stay(spark, tmp_path):
    start = [("a", "P"), ("b", "P"), ("c", "Q"), ("d", "R")]
    assert replayed(spark, str(tmp_path / "x"), start, [(0, "d", "n0", "P", "# P\nnew")]) == model(start, [(0, "d", "n0", "P", "# P\nnew")])
    assert replayed(spark, str(tmp_path / "y"), start, []) == model(start, [])
    assert replayed(spark, str(tmp_path / "z"), [], [(5, None, "n", "P", "# P")]) == {"n": ("P", "# P", 5)}
    with pytest.raises(ValueError):
        replayed(spark, str(tmp_path / "w"), start, [(0, None, "a", "New", "# New")])


def test_later_batches_see_earlier_ones(spark, tmp_path):
    notes = spark.createDataFrame([("o1", "Old", "", "", T0, T0, 0), ("o2", "Kept", "", "", T0, T0, 1)], NOTES)
    reply = lambda *notes_: "[" + ",".join(f'{{"title":"{t}","connections":["{c}"]}}' for t, c in notes_) + "]"
    replies = [("x", 2, reply(("C", "A"), ("Old", "Kept"))), ("y", 0, reply(("A", "C"), ("Old", "A"))), ("z", 1, reply(("B", "Old"), ("A", "nope")))]
    df = spark.createDataFrame(replies, "batch_id string, batch_no int, reply string")
    note_id = F.concat(F.col("batch_id"), F.col("pos").cast("string"))
    after, links, missed = ingest.ingest(notes, spark.createDataFrame([], LINKS), df, note_id, F.lit(T0), str(tmp_path))
    assert sorted(map(tuple, links.collect())) == [("x0", "z1"), ("x1", "o2"), ("y1", "y0"), ("z0", "y1")]
    assert sorted((r["batch_id"], r["title"]) for r in missed.collect()) == [("y", "C"), ("z", "nope")]
    assert [(r["id"], r["seq"]) for r in after.orderBy("seq").collect()] == [("o1", 0), ("o2", 1), ("y0", 2), ("y1", 3), ("z0", 4), ("z1", 5), ("x0", 6), ("x1", 7)]
    with pytest.raises(ValueError):
        ingest.ingest(after, links, df, note_id, F.lit(T0), str(tmp_path / "again"))


@pytest.mark.parametrize("window", [7, 64, 1000])
def test_a_component_too_large_for_a_group_goes_through_windows(spark, tmp_path, window, monkeypatch):
    monkeypatch.setattr(store, "GROUP_ROWS", 20)
    monkeypatch.setattr(store, "WINDOW_ROWS", window)
    monkeypatch.setattr(store, "FEW_TITLES", 1)
    largest = []
    replay = store._in_groups

    def watched(notes, saves, keys):
        largest.append(saves.groupBy("component").count().agg(F.max("count")).first()[0] or 0)
        return replay(notes, saves, keys)

    monkeypatch.setattr(store, "_in_groups", watched)
    rng = random.Random(window)
    start = [(f"a{k}", f"T{rng.randrange(4)}") for k in range(6)] + [("b", "B")]
    n = 60 if window == 7 else 200
    saves = [(pos, rng.choice([None, f"a{rng.randrange(6)}", f"a{rng.randrange(6)}", f"n{rng.randrange(n)}", "unknown"]), f"n{pos}", t, f"# {t}\nbody {pos}") for pos in range(n) for t in [f"T{rng.randrange(9)}"]]
    saves += [(n, "b", f"n{n}", "C", "# C\nmoved"), (n + 1, None, f"n{n + 1}", "B", "# B\nnew")]
    assert replayed(spark, str(tmp_path), start, saves) == model(start, saves)
    assert max(largest) <= 20
