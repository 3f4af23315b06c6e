"""Geometry of the graph view as native expressions (operators D5, B5, H14-H18, K3-K9)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# They decide results.
FIT_MARGIN = 0.9
ZOOM_IN, ZOOM_OUT, ZOOM_LEAST, ZOOM_MOST = 1.1, 0.9, 0.1, 5.0
ARROW_LENGTH, ARROW_ANGLE = 8.0, math.pi / 6
DEFAULT_WIDTH, DEFAULT_HEIGHT, NODE_PADDING = 100.0, 50.0, 5.0


def rectangles(nodes: DataFrame) -> DataFrame:
    """Adds left, top, width and height of each node (its place is the centre)."""
    w, h = F.coalesce("w", F.lit(DEFAULT_WIDTH)), F.coalesce("h", F.lit(DEFAULT_HEIGHT))
    return nodes.withColumns({"left": F.col("x") - w / 2, "top": F.col("y") - h / 2, "width": w, "height": h})


def bounding_box(nodes: DataFrame) -> DataFrame:
    """One row of min_x, max_x, min_y, max_y; NULLs for no nodes."""
    return nodes.agg(F.min(F.col("x") - F.col("w") / 2).alias("min_x"), F.max(F.col("x") + F.col("w") / 2).alias("max_x"), F.min(F.col("y") - F.col("h") / 2).alias("min_y"), F.max(F.col("y") + F.col("h") / 2).alias("max_y"))


def fit_view(nodes: DataFrame, width: float, height: float) -> DataFrame:
    """Bounding box with the zoom and offsets that centre it; NULL zoom means: leave the view as it is."""
    box = bounding_box(nodes).withColumns({"map_width": F.col("max_x") - F.col("min_x"), "map_height": F.col("max_y") - F.col("min_y")})
    fits = (F.col("map_width") != 0) & (F.col("map_height") != 0)
    zoom = F.when(fits, F.least(F.lit(float(width)) / F.col("map_width"), F.lit(float(height)) / F.col("map_height")) * FIT_MARGIN)
    box = box.withColumn("zoom", zoom)
    return box.withColumns(
        {"offset_x": -F.col("min_x") + (F.lit(float(width)) / F.col("zoom") - F.col("map_width")) / 2, "offset_y": -F.col("min_y") + (F.lit(float(height)) / F.col("zoom") - F.col("map_height")) / 2}
    )


#: Decimal numbers as layout programs write them.
NUMBER = r"\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*"


def parse_place(text: Column) -> Column:
    """Struct of x and y from ``x,y`` (what follows a second comma is ignored); NULL if either is no number."""
    part = lambda i: F.get(F.split(text, ",", -1), F.lit(i))
    number = lambda c: F.when(c.rlike(rf"\A{NUMBER}\z"), F.trim(c).try_cast("double"))
    x, y = number(part(0)), number(part(1))
    return F.when(x.isNotNull() & y.isNotNull(), F.struct(x.alias("x"), y.alias("y")))


def to_map(x: Column, y: Column, zoom: Column, offset_x: Column, offset_y: Column) -> tuple[Column, Column]:
    """Screen to map coordinates."""
    return x / zoom - offset_x, y / zoom - offset_y


def to_screen(x: Column, y: Column, zoom: Column, offset_x: Column, offset_y: Column) -> tuple[Column, Column]:
    return (x + offset_x) * zoom, (y + offset_y) * zoom


def hit_test(nodes: DataFrame, x: float, y: float) -> DataFrame:
    """The earliest node whose rectangle holds the map point; no row if none does."""
    r = rectangles(nodes)
    inside = F.lit(float(x)).between(F.col("left"), F.col("left") + F.col("width")) & F.lit(float(y)).between(F.col("top"), F.col("top") + F.col("height"))
    return r.where(inside).orderBy("seq").limit(1)


def arrow_heads(edges: DataFrame) -> DataFrame:
    """Adds both end points of the arrow head to edges with x1, y1, x2, y2."""
    angle = F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1"))
    out = {}
    for name, turn in (("a", -ARROW_ANGLE), ("b", ARROW_ANGLE)):
        out[f"{name}x"] = F.col("x2") - ARROW_LENGTH * F.cos(angle + turn)
        out[f"{name}y"] = F.col("y2") - ARROW_LENGTH * F.sin(angle + turn)
    return edges.withColumns(out)


def zoom_step(zoom: float, offset_x: float, offset_y: float, wheel: float, x: float, y: float) -> tuple[float, float, float]:
    """One wheel step about the pointer (x, y): zoom and offsets after it."""
    new = max(ZOOM_LEAST, min(zoom * (ZOOM_IN if wheel > 0 else ZOOM_OUT), ZOOM_MOST))
    return new, offset_x + x / new - x / zoom, offset_y + y / new - y / zoom


#: Places of a session's log that are folded as one array.
FOLD_WIDTH = 4096


def view_after(events: DataFrame, zoom: float = 1.0, offset_x: float = 0.0, offset_y: float = 0.0, width: int = FOLD_WIDTH) -> DataFrame:
    """Folds pan and wheel events of each session, in order of seq, into its last view.

    ``events`` has session, seq (a whole number), kind ('pan' or 'wheel'), dx, dy
    (pan), wheel, x, y.  A session's log is folded in pieces of ``width`` places,
    so no session is in one array.  What a piece does to the zoom is a product
    within bounds, and such pieces compose; that gives the zoom at which each
    piece begins, and with that its pieces' moves can be summed in any order
    (results agree with one fold but for rounding).
    """
    wheel_factor = lambda e: F.when(e["wheel"] > 0, ZOOM_IN).otherwise(ZOOM_OUT)
    bounded = lambda z, low, high: F.greatest(low, F.least(z, high))
    least, most = F.lit(ZOOM_LEAST), F.lit(ZOOM_MOST)

    def scaled(f: Column, e: Column) -> Column:
        """z -> bounded(factor * z, low, high), followed by the event."""
        k = wheel_factor(e)
        after = F.struct((f["factor"] * k).alias("factor"), bounded(f["low"] * k, least, most).alias("low"), bounded(f["high"] * k, least, most).alias("high"))
        return F.when(e["kind"] == "pan", f).otherwise(after)

    def step(v: Column, e: Column) -> Column:
        z = bounded(v["z"] * wheel_factor(e), least, most)
        panned = F.struct(v["z"].alias("z"), (v["ox"] + e["dx"] / v["z"]).alias("ox"), (v["oy"] + e["dy"] / v["z"]).alias("oy"))
        zoomed = F.struct(z.alias("z"), (v["ox"] + e["x"] / z - e["x"] / v["z"]).alias("ox"), (v["oy"] + e["y"] / z - e["y"] / v["z"]).alias("oy"))
        return F.when(e["kind"] == "pan", panned).otherwise(zoomed)

    piece = F.floor(F.col("seq") / F.lit(width)).cast("long")
    event = F.struct("seq", "kind", *[F.col(c).cast("double").alias(c) for c in ("dx", "dy", "wheel", "x", "y")])
    logs = events.groupBy("session", piece.alias("piece")).agg(F.array_sort(F.collect_list(event)).alias("log"))
    same = F.struct(F.lit(1.0).alias("factor"), F.lit(0.0).alias("low"), F.lit(float("inf")).alias("high"))
    effects = logs.select("session", "piece", F.aggregate("log", same, scaled).alias("f")).groupBy("session").agg(F.array_sort(F.collect_list(F.struct("piece", "f"))).alias("pieces"))
    begun = F.struct(F.lit(float(zoom)).alias("z"), F.array().cast("array<struct<piece:bigint,z:double>>").alias("starts"))
    along = lambda acc, p: F.struct(bounded(acc["z"] * p["f"]["factor"], p["f"]["low"], p["f"]["high"]).alias("z"), F.concat(acc["starts"], F.array(F.struct(p["piece"].alias("piece"), acc["z"].alias("z")))).alias("starts"))
    starts = effects.select("session", F.explode(F.aggregate("pieces", begun, along, lambda acc: acc["starts"])).alias("s")).select("session", "s.piece", "s.z")
    moved = logs.join(starts, ["session", "piece"]).select("session", "piece", F.aggregate("log", F.struct("z", F.lit(0.0).alias("ox"), F.lit(0.0).alias("oy")), step).alias("v"))
    return moved.groupBy("session").agg(F.max_by("v.z", "piece").alias("zoom"), (F.sum("v.ox") + offset_x).alias("offset_x"), (F.sum("v.oy") + offset_y).alias("offset_y"))


def palette_index(level: Column, colours: int) -> Column:
    return F.pmod(F.coalesce(level, F.lit(0)), F.lit(colours))
