"""Places of nodes: ranks, circles, no overlap, and the same drawing however the tables are dealt."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from inkmesh.operators import layout, ordinals

LINKS = "source_note_id string, target_note_id string"


def placed(spark, folder, ids, links, **sizes):
    nodes = spark.createDataFrame([(i, 40.0 + 7 * (len(i) + k % 3), None) for k, i in enumerate(ids)], "id string, w double, h double")
    return {r["id"]: r for r in layout.place_nodes(nodes, spark.createDataFrame(links, LINKS), folder=str(folder), **sizes).collect()}


def apart(rows):
    return all(abs(a["x"] - b["x"]) >= (a["w"] + b["w"]) / 2 or abs(a["y"] - b["y"]) >= (a["h"] + b["h"]) / 2 for a, b in combinations(rows.values(), 2))


def test_the_five_note_graph(spark, tmp_path):
    links = [("1", "2"), ("1", "3"), ("2", "4"), ("3", "5"), ("4", "5"), ("5", "9")]
    got = placed(spark, tmp_path / "a", "12345", links)
    assert {i: r["rank"] for i, r in got.items()} == {"1": 0, "2": 1, "3": 1, "4": 2, "5": 3}
    assert apart(got) and got["1"]["y"] < got["2"]["y"] == got["3"]["y"] < got["5"]["y"]
    again = layout.place_nodes(spark.createDataFrame([(i, 40.0 + 7 * (1 + k % 3), None) for k, i in enumerate("12345")], "id string, w double, h double").repartition(3, "id"), spark.createDataFrame(links[::-1], LINKS).repartition(5), folder=str(tmp_path / "b"))
    assert {r["id"]: tuple(r) for r in again.collect()} == {i: tuple(r) for i, r in got.items()}


def test_circles_share_a_rank(spark, tmp_path):
    """A tail into a circle of three, another circle behind it, a chain, and a node by itself."""
    links = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "b"), ("d", "e"), ("e", "f"), ("f", "e"), ("f", "g"), ("g", "g"), ("x", "y"), ("y", "z"), ("x", "z")]
    got = placed(spark, tmp_path, "abcdefgxyzo", links, sweeps=1)
    assert {i: r["rank"] for i, r in got.items()} == {"a": 0, "b": 1, "c": 1, "d": 1, "e": 2, "f": 2, "g": 3, "x": 0, "y": 1, "z": 2, "o": 0}
    assert apart(got) and len({r["component"] for r in got.values()}) == 3


def test_medians_undo_a_crossing(spark, tmp_path):
    got = placed(spark, tmp_path, ["a", "b", "c", "d"], [("a", "d"), ("b", "c"), ("a", "d")], sweeps=2)
    assert got["a"]["rank"] == got["b"]["rank"] == 0 and apart(got)
    got = placed(spark, tmp_path / "joined", ["a", "b", "c", "d", "e"], [("e", "a"), ("e", "b"), ("a", "d"), ("b", "c")])
    assert (got["a"]["x"] < got["b"]["x"]) == (got["d"]["x"] < got["c"]["x"])


@pytest.mark.parametrize("seed", [1])
def test_circles_equal_a_search(spark, tmp_path, seed):
    rng = random.Random(seed)
    edges = {(rng.randrange(18), rng.randrange(18)) for _ in range(26)}
    reach = {v: {v} for v in range(18)}
    for _ in range(18):
        for a, b in edges:
            for v in reach:
                if a in reach[v]:
                    reach[v].add(b)
    mutual = {v: max(w for w in reach[v] if v in reach[w]) for v in range(18) if any(w != v and v in reach[w] for w in reach[v])}
    got = {r["node"]: r["head"] for r in layout.circles(spark.createDataFrame(sorted(edges), "a long, b long"), str(tmp_path)).collect()}
    assert {v: h for v, h in got.items()} == mutual


def test_no_nodes_and_running_totals(spark, tmp_path):
    assert placed(spark, tmp_path / "a", "", []) == {}
    rows = spark.range(200).select((F.col("id") * 37 % 200).alias("k"), F.lit(2).alias("v")).repartition(4)
    assert ordinals.running(rows, ["k"], "v", "t", ranges=5, folder=str(tmp_path / "b")).where("t <> 2 * (k + 1)").count() == 0


def test_sizes_are_made_once_and_small_ranges_joined(spark, tmp_path):
    made, names = spark.sparkContext.accumulator(0), [f"{k:02}" for k in range(40)]

    @F.udf("double")
    def width(i):
        made.add(1)
        return 10.0 + int(i)

    nodes = spark.createDataFrame([(i,) for i in names], "id string").select("id", width("id").alias("w"))
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "20")
    try:
        got = layout.place_nodes(nodes, spark.createDataFrame([(a, b) for a, b in zip(names, names[1:3], strict=False)], LINKS), folder=str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    assert {r["id"]: r["w"] for r in got} == {i: 10.0 + int(i) for i in names}
    assert made.value == len(names)
    assert spark.read.parquet(f"{tmp_path}/numbers/ranges").select("__range").distinct().count() < 10
