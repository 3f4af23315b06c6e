"""Target encoding against a loop over all pairs of rows."""

from __future__ import annotations

import datetime
import random
import zlib

import pytest
from pyspark.sql import functions as F

from inkmesh.llm import target_encoding as te

IDS = ["row"]


def brute(rows, columns, gap, folds=te.FOLDS):
    """{(row, column): (n, s)}; rows are dicts with row, at, fold, n, s and the columns."""
    out = {}
    for a in rows:
        if a["at"] is None:
            continue
        for c in columns:
            past = [b for b in rows if b["at"] is not None and b["at"] + gap < a["at"] and (b["fold"] or 0) != (a["fold"] or 0) and b[c] == a[c]]
            out[a["row"], c] = (sum(b["n"] for b in past), sum(b["s"] for b in past))
    return out


def made(seed, n, hot=0.4, ticks=60):
    rng = random.Random(seed)
    return [
        {
            "row": i, "at": None if rng.random() < 0.03 else rng.randrange(ticks), "fold": rng.choice([0, 1, 2, 3, 4, None]), "n": rng.randrange(1, 4), "s": rng.randrange(2),
            "item": 1 if rng.random() < hot else rng.choice([None, -1, 2, 3, 4]), "word": rng.choice(["", "a", None]), "all": 0,
        }
        for i in range(n)
    ]


SCHEMA = "row long, at long, fold int, n long, s long, item long, word string, all int"


@pytest.mark.parametrize("gap", [0, 7])
@pytest.mark.parametrize(("chunk_rows", "fan_out"), [(te.CHUNK_ROWS, te.FAN_OUT), (4, 2), (9, 3)])
def test_histories_equal_a_loop(spark, tmp_path, gap, chunk_rows, fan_out, monkeypatch):
    monkeypatch.setattr(te, "LISTED", 2 if gap else 100)  # a list that is joined, and one that is sent
    monkeypatch.setattr(te, "PARTITION_ROWS", 50)
    rows = made(gap + chunk_rows, 160)
    df = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)
    found = te.histories(df, IDS, ["item", "word", "all"], "at", "fold", "n", "s", gap=gap, chunk_rows=chunk_rows, fan_out=fan_out, folder=str(tmp_path)).collect()
    assert len(found) == 3 * sum(r["at"] is not None for r in rows)
    assert {(r["row"], ["item", "word", "all"][r["column"]]): (r["n"], r["s"]) for r in found} == brute(rows, ["item", "word", "all"], gap)


def test_an_instant_is_not_its_own_history(spark, tmp_path):
    rows = [(i, 5, i % 5, 1, 1, 1, "a", 0) for i in range(20)]
    found = te.histories(spark.createDataFrame(rows, SCHEMA), IDS, ["item"], "at", "fold", "n", "s", chunk_rows=3, fan_out=2, folder=str(tmp_path))
    assert {(r["n"], r["s"]) for r in found.collect()} == {(0, 0)}


def test_an_empty_table_gives_no_rows(spark, tmp_path):
    assert te.histories(spark.createDataFrame([], SCHEMA), IDS, ["item"], "at", "fold", "n", "s", folder=str(tmp_path)).count() == 0


def test_rates_are_whole_numbers(spark):
    row = spark.range(1).select(te.rate(F.lit(0), F.lit(0), F.lit(7)).alias("a"), te.rate(F.lit(3), F.lit(2), F.lit(500_000)).alias("b")).first()
    assert (row["a"], row["b"]) == (7, (2_000_000 + 25_000_000) // 53)


def _tables(spark, lines, sales):
    clash = lambda df: df.withColumns({"__time": F.lit(1), "fold": F.lit("x"), "at": F.lit(2), "kind_n": F.lit(3)})
    items = spark.createDataFrame([(1, "tools"), (2, None), (None, "home"), (3, "tools")], "item_id long, kind string")
    vendors = spark.createDataFrame([(7, 4), (8, 4), (9, None)], "vendor_id long, nation_id int")
    clients = spark.createDataFrame([(5, "retail"), (6, None)], "client_id long, segment string")
    return [
        clash(spark.createDataFrame(lines, "sale_id long, item_id long, vendor_id long, flag string")),
        clash(spark.createDataFrame(sales, "sale_id long, client_id long, sold_at timestamp_ntz")),
        items, vendors, clients,
    ]


def test_the_whole_query_equals_a_loop(spark, tmp_path):
    rng = random.Random(3)
    t0 = datetime.datetime(2024, 1, 1)
    sales = [(i, rng.choice([5, 6, None, 44]), None if i % 11 == 0 else t0 + datetime.timedelta(minutes=rng.randrange(25))) for i in range(60)]
    lines = [(rng.choice([*range(62), 9, 9, 9, 9, None]), rng.choice([1, 1, 2, 3, None, 99]), rng.choice([7, 8, 9, 10, None]), rng.choice(["returned", "kept", None])) for _ in range(300)]
    lines += lines[:20]
    got = te.sale_encodings(*_tables(spark, lines, sales), chunk_rows=5, fan_out=3, folder=str(tmp_path)).collect()
    kind, nation, segment = {1: "tools", 3: "tools"}, {7: 4, 8: 4}, {5: "retail"}
    of_sale = {s: (c, at) for s, c, at in sales if at}
    rows = []
    for s, i, v, flag in lines:
        if s in of_sale:
            c, at = of_sale[s]
            i, c = -1 if i is None else i, -1 if c is None else c
            rows.append({"key": (s, i, v), "at": at, "fold": zlib.crc32(str(s).encode()) % 5, "hit": flag == "returned", "item": i, "vendor": v, "client": c, "kind": kind.get(i), "nation": nation.get(v), "segment": segment.get(c), "all": 0})
    want = {}
    for r in rows:
        past = [b for b in rows if b["at"] < r["at"] and b["fold"] != r["fold"]]
        ns = lambda c: (sum(b[c] == r[c] for b in past), sum(b["hit"] for b in past if b[c] == r[c]))  # noqa: B023, E731
        rate = lambda c, p: p if ns(c)[0] < 1 else (1_000_000 * ns(c)[1] + 50 * p) // (ns(c)[0] + 50)  # noqa: B023, E731
        p = rate("all", 500_000)
        own = [b for b in rows if b["key"] == r["key"]]
        want[r["key"]] = (len(own), sum(b["hit"] for b in own), ns("item")[0], rate("item", rate("kind", p)), ns("vendor")[0], rate("vendor", rate("nation", p)), ns("client")[0], rate("client", rate("segment", p)))
    assert len(got) == len(want)
    assert {tuple(r)[:3]: tuple(r)[3:] for r in got} == want


def test_no_lines_or_no_sales_give_no_rows(spark, tmp_path):
    t0 = datetime.datetime(2024, 1, 1)
    assert te.sale_encodings(*_tables(spark, [], [(1, 5, t0)]), folder=str(tmp_path / "a")).count() == 0
    assert te.sale_encodings(*_tables(spark, [(1, 1, 7, "kept")], []), folder=str(tmp_path / "b")).count() == 0


def test_a_repeated_sale_counts_once_at_its_earliest_time(spark, tmp_path):
    t0 = datetime.datetime(2024, 1, 1)
    later = t0 + datetime.timedelta(days=1)
    sales = [(1, 6, later), (1, 5, t0), (2, 5, t0 + datetime.timedelta(hours=1)), (1, 5, t0)]
    rows = te.sale_encodings(*_tables(spark, [(1, 1, 7, "returned"), (2, 1, 7, "kept")], sales), folder=str(tmp_path)).collect()
    assert {r["sale_id"]: (r["n_lines"], r["item_n"], r["client_n"]) for r in rows} == {1: (1, 0, 0), 2: (1, 1, 1) if zlib.crc32(b"1") % 5 != zlib.crc32(b"2") % 5 else (1, 0, 0)}


@pytest.mark.parametrize("gap", [0, 7])
def test_rows_are_in_the_table_once_and_meet_before_they_are_gathered(spark, tmp_path, gap):
    df = spark.createDataFrame([tuple(r.values()) for r in made(5, 40)], SCHEMA)
    found = te.histories(df, IDS, ["item", "word"], "at", "fold", "n", "s", gap=gap, folder=str(tmp_path))
    plan = lambda x: x._jdf.queryExecution().optimizedPlan().toString()
    assert plan(found).count("Generate ") == (3 if gap else 2)  # columns and carried totals; with a gap each row two times
    above = plan(te.gathered(found, IDS, ["item", "word"])).split("Aggregate ")[1]
    assert "RepartitionByExpression" in above.split("Window")[0]
