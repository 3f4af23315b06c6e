"""Text, JSON, Markdown and geometry functions on fixed cases."""

import json
import math

import pytest
from pyspark.sql import functions as F

from inkmesh.functions import geometry as G
from inkmesh.functions import jsonnotes as J
from inkmesh.functions import markdown as M
from inkmesh.functions import text as T

TITLES = [
    ("", "Untitled Note"), ("   ", "Untitled Note"), ("###", ""), ("**", ""), ("# Title", "Title"), ("#NoSpace", "NoSpace"), ("# # X", "# X"),
    ("## **Bold** _it_ `c` ~~s~~", "Bold it c s"), ("snake_case_name", "snakecasename"), ("~", "~"), ("[t](http://u)", "[t](httpu)"), ("![alt](http://u)", "![alt](httpu)"),
    ("[t][r] tail", "tail"), ("[a] x [b][c] y", "y"), ('a/b:c?*|<>"\\', "abc"), ("!\\.(abc\\]) z", "z"), ("\xa0# T\xa0", "T"), ("x\r\nbody", "x"), ("　\x1c a  b \x85", "a  b"), ("one\ntwo", "one"),
]


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[1] for r in df.select("i", f(F.col("v"))).orderBy("i").collect()]


def test_titles(spark):
    assert column(spark, [t for t, _ in TITLES], T.sanitize_title) == [w for _, w in TITLES]
    assert column(spark, ["###", "x"], T.saved_title) == ["Untitled Note", "x"]
    assert column(spark, ["  # a_b \nc", "\n"], T.raw_title) == ["# a_b", "Untitled Note"]


def test_strip_equals_python(spark):
    spaces = [chr(i) for i in range(0x10000) if chr(i).isspace()]
    values = [f"{c}a{c}b{c}" for c in spaces] + ["", " ", "​ a"]
    assert column(spark, values, T.strip) == [v.strip() for v in values]


@pytest.mark.parametrize("query,want", [("", 4), ("NOTE", 2), ("%", 1), ("_", 1), ("zz", 0)])
def test_search_is_literal_and_case_blind(spark, query, want):
    assert sum(column(spark, ["a note", "Note 100%", "snake_x", "b"], lambda c: T.title_contains(c, query))) == want


def test_categories(spark):
    assert column(spark, ["", None, "x"], T.has_category) == [False, False, True]
    assert column(spark, ["All Notes", "x"], T.stored_category) == ["", "x"]
    assert column(spark, [" 　", "x"], T.is_blank) == [True, False]


REPLIES = [
    ('[{"title":"A","connections":["B"]}]', "ok", [("A", "", "AI Generated", ["B"])]),
    ('```json\n[{"title":"A"}]\n```', "ok", [("A", "", "AI Generated", [])]),
    ('```json\n[{"title":"A"}]\n```\n', "empty", []), ("not json", "empty", []), ("[{'title':'A'}]", "empty", []), ('[{"title":"A"},]', "empty", []), ('[{"title":"A"}] x', "empty", []),
    ("[]", "empty", []), (None, "empty", []), ('{"title":"A"}', "error", []), ("[1,2]", "error", []), ("3", "error", []),
    ('[{"title":null}]', "ok", [(None, "", "AI Generated", [])]), ('[{"general_title":null,"content":"c"}]', "ok", [("Untitled Note", "c", None, [])]),
    ('[{"connections":null}]', "error", []), ('[{"connections":[1]}]', "error", []), ('[{"connections":"BC"}]', "ok", [("Untitled Note", "", "AI Generated", ["B", "C"])]),
]


def test_replies(spark):
    replies = spark.createDataFrame([(i, r) for i, (r, _, _) in enumerate(REPLIES)], "batch_id int, reply string")
    assert [r["status"] for r in J.reply_status(replies).orderBy(F.col("batch_id").cast("int")).collect()] == [s for _, s, _ in REPLIES]
    got = [(int(r["batch_id"]), r["title"], r["content"], r["general_title"], r["connections"]) for r in J.generated_notes(replies).collect()]
    assert sorted(got, key=repr) == sorted([(i, *n) for i, (_, _, notes) in enumerate(REPLIES) for n in notes], key=repr)


def test_json_number(spark):
    assert column(spark, [json.dumps({"k": 7}), "{}", '{"k":"x"}', None], lambda c: J.json_number(c, "k")) == [7, None, None, None]


def test_markdown(spark):
    cases = {
        "# A *b*": "<h1>A <em>b</em></h1>", "x **y** `a<b`": "<p>x <strong>y</strong> <code>a&lt;b</code></p>", "- a\n- b": "<ul>\n<li>a</li>\n<li>b</li>\n</ul>", "1. a\n2. b": "<ol>\n<li>a</li>\n<li>b</li>\n</ol>",
        "```\n<x>\n```": "<pre><code>&lt;x&gt;\n</code></pre>", "[t](u) ![i](v)": '<p><a href="u">t</a> <img alt="i" src="v" /></p>', "---": "<hr />", "> q": "<blockquote>\n<p>q</p>\n</blockquote>", "": "", "a ` b": "<p>a ` b</p>",
    }
    assert column(spark, [*cases, None], M.to_html) == [*cases.values(), None]
    assert column(spark, ["x"], lambda c: M.to_html(c, lambda t: f"<{t}>")) == ["<x>"]


def nodes(spark, rows):
    return spark.createDataFrame(rows, "id string, title string, x double, y double, w double, h double, seq long")


def test_view_fit_and_empty(spark):
    v = G.fit_view(nodes(spark, [("a", "a", 0.0, 0.0, 20.0, 10.0, 0), ("b", "b", 100.0, 50.0, 20.0, 10.0, 1)]), 600, 300).first()
    assert (v["min_x"], v["max_x"], v["min_y"], v["max_y"]) == (-10, 110, -5, 55) and v["zoom"] == pytest.approx(4.5)
    assert v["offset_x"] == pytest.approx(10 + (600 / 4.5 - 120) / 2) and v["offset_y"] == pytest.approx(5 + (300 / 4.5 - 60) / 2)
    assert G.fit_view(nodes(spark, []), 600, 300).first()["zoom"] is None
    assert G.fit_view(nodes(spark, [("a", "a", 1.0, 1.0, 0.0, 5.0, 0)]), 600, 300).first()["zoom"] is None


def test_hits_and_arrows(spark):
    n = nodes(spark, [("late", "t", 0.0, 0.0, 10.0, 10.0, 5), ("early", "t", 2.0, 2.0, None, None, 1)])
    assert G.hit_test(n, 1, 1).first()["id"] == "early" and G.hit_test(n, 500, 0).count() == 0
    a = G.arrow_heads(spark.createDataFrame([(0.0, 0.0, 10.0, 0.0)], "x1 double, y1 double, x2 double, y2 double")).first()
    assert a["ax"] == pytest.approx(10 - 8 * math.cos(math.pi / 6)) and a["ay"] == pytest.approx(4) and a["by"] == pytest.approx(-4)


def test_pan_and_zoom_fold(spark):
    events = [("s", 1, "wheel", 0, 0, 1, 100, 50), ("s", 2, "pan", 11, 22, 0, 0, 0), ("s", 3, "wheel", 0, 0, -1, 10, 10), ("t", 1, "pan", 1, 1, 0, 0, 0)] + [("u", i, "wheel", 0, 0, 1, 0, 0) for i in range(60)]
    df = spark.createDataFrame(events, "session string, seq int, kind string, dx int, dy int, wheel int, x int, y int")
    got = {r["session"]: (r["zoom"], r["offset_x"], r["offset_y"]) for r in G.view_after(df).collect()}
    z, ox, oy = G.zoom_step(1.0, 0.0, 0.0, 1, 100, 50)
    ox, oy = ox + 11 / z, oy + 22 / z
    assert got["s"] == pytest.approx(G.zoom_step(z, ox, oy, -1, 10, 10)) and got["t"] == (1, 1, 1) and got["u"][0] == 5.0
    x, y = G.to_screen(F.lit(3.0), F.lit(4.0), F.lit(2.0), F.lit(1.0), F.lit(1.0))
    back = G.to_map(x, y, F.lit(2.0), F.lit(1.0), F.lit(1.0))
    assert tuple(spark.range(1).select(*back).first()) == (3.0, 4.0)


def test_places_are_read_from_text(spark):
    texts = ["1,2", " 1.5 , -2e1,3", "1", "1,", "a,b", "1,2f", "nan,1", ".5,+6.", "", None]
    got = column(spark, texts, G.parse_place)
    assert [None if p is None else (p["x"], p["y"]) for p in got] == [(1.0, 2.0), (1.5, -20.0), None, None, None, None, None, (0.5, 6.0), None, None]


def test_category_names(spark):
    assert column(spark, ["a", " b ", "", " \t", "　", None], T.valid_category) == [True, True, False, False, False, False]
