"""As-of join: for each probe, the last event of its key before it.

Events and probes go through one window per key, ordered by place.  A key of
over ``chunk_rows`` rows is cut into about as many chunks as each then has rows
(the root of its number), by place, and each chunk begins with the last event
of the chunks before it; so no window holds a hot key.  The list of such keys
is broadcast up to ``LISTED`` of them, and joined by sort and merge beyond.

Null keys match null keys.  Of events of one place any one counts; places are
meant to be unique within a key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkmesh.sources.scratch import scratch, written

CHUNK_ROWS = 1 << 16
LISTED = 1 << 14


def last_before(probes: DataFrame, events: DataFrame, keys: list[str], at: str, values: list[str], inclusive: bool = False, chunk_rows: int = CHUNK_ROWS, folder: str | None = None) -> DataFrame:
    """``probes`` with the ``values`` of the last of ``events`` whose ``at`` is smaller (or equal, if ``inclusive``); nulls if there is none.

    Both have the columns ``keys`` and ``at`` (a whole number).
    """
    folder = folder or scratch(probes.sparkSession)
    place = F.col(at).cast("long").alias("__at")
    named = [f"__key{i}" for i in range(len(keys))]
    key = [F.col(k).alias(n) for k, n in zip(keys, named, strict=True)]
    row, value = F.struct(*[F.col(f"`{c}`") for c in probes.columns]).alias("__row"), F.struct(*values).alias("__value")
    asked = probes.select(*key, place, F.lit(1 if inclusive else 0).alias("__kind"), row)
    told = events.select(*key, place, F.lit(0 if inclusive else 1).alias("__kind"), value)
    rows = written(asked.unionByName(told, allowMissingColumns=True), folder, "asof_rows")
    large = rows.groupBy(*named).agg(F.count("*").alias("__n"), F.min("__at").alias("__low"), F.max("__at").alias("__high")).where(F.col("__n") > chunk_rows)
    large = written(large, folder, "asof_large")
    listed = large.count()
    if listed:
        sized = large.withColumnsRenamed({n: f"h{n}" for n in named})
        same = F.lit(True)
        for n in named:
            same = same & F.col(n).eqNullSafe(F.col(f"h{n}"))
        joined = rows.join(F.broadcast(sized) if listed <= LISTED else sized.hint("merge"), same, "left")
        chunk = F.floor((F.col("__at") - F.col("__low")) * F.ceil(F.sqrt("__n")) / (F.col("__high") - F.col("__low") + 1))
        rows = joined.select(*named, "__at", "__kind", "__row", "__value", chunk.cast("long").alias("__chunk"))
        earlier = Window.partitionBy(*named).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
        lasts = rows.where("__chunk is not null").groupBy(*named, "__chunk").agg(F.max_by("__value", F.when(F.col("__value").isNotNull(), F.col("__at"))).alias("__value"))
        heads = lasts.select(*named, "__chunk", F.last("__value", ignorenulls=True).over(earlier).alias("__value")).where("__value is not null").withColumn("__kind", F.lit(-1))
        rows = rows.unionByName(heads, allowMissingColumns=True)
    else:
        rows = rows.withColumn("__chunk", F.lit(None).cast("long"))
    # a head has no place, and nulls come first
    so_far = Window.partitionBy(*named, "__chunk").orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = rows.select("__row", F.last("__value", ignorenulls=True).over(so_far).alias("__value")).where("__row is not null")
    return found.select("__row.*", *[F.col("__value")[v].alias(v) for v in values])
