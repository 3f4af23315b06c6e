"""Time-ordered target encoding: what was known of a key before each row.

A row's history is all rows of other folds that lie more than ``gap``
microseconds earlier.  Of the history rows that share the row's value in a
column, ``n`` is their number and ``s`` the number of them with the target.

The rows are put in one table for all columns.  Within a key they are ordered by
time, and one running window holds the sums of the key for each fold over all
earlier instants; a row takes those of the folds that are not its own.  With a
gap, a row is in the table two times: where it asks, and ``gap`` later, where it
is history.  No window holds a whole key: a key's time is
cut into chunks, and each chunk begins with rows that carry the totals of the
chunks before it.  Carried totals are running sums over chunk totals, which are
segmented in the same way, ``fan_out`` chunks at a time, on as many levels as
it takes.

A key of more than ``chunk_rows`` rows gets as many chunks as a quarter of that
goes into its rows: up to 4096 rows of a window are held as they are, more in a
sorter of their own.  The list of such keys is counted: up to ``LISTED`` of them are sent
to all tasks, more are joined by sort and merge.  Chunks have equal lengths and
hold that quarter on average, if a key's rows lie evenly in time; rows of
one instant are in one chunk.

Defined cases: a null key is a key like any other; a null fold counts as fold
0; rows without a time have no history and are in none; repeated rows each
count; an empty table gives no rows.  Columns of any names may be present.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkmesh.llm.common import materialize, shared_dir

FOLDS = 5
#: Rows beyond which a key is cut into chunks of a quarter as many on average, and chunks that one window runs over.
CHUNK_ROWS, FAN_OUT = 1 << 13, 1 << 10
#: Keys with several chunks whose list is sent to all tasks (some 60 bytes each).
LISTED = 1 << 14
#: Rows that a sorted partition holds on average, so that it fits into a task's memory.
PARTITION_ROWS = 1 << 20
#: The contract's smoothing weight, rates in millionths, and the rate of an empty history.
WEIGHT, UNIT, EMPTY_RATE = 50, 1_000_000, 500_000

_KEY = ["__column", "__number", "__word"]


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp, as it stands in the table (no zone is applied to one without)."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def _keys(df: DataFrame, columns: list[str]) -> Column:
    """Array of (number of the column, key): whole numbers stay numbers, all else is text."""
    whole = (T.LongType, T.IntegerType, T.ShortType, T.ByteType)
    out = []
    for i, c in enumerate(columns):
        is_number = isinstance(df.schema[c].dataType, whole)
        out.append(
            F.struct(F.lit(i).alias("__column"), (F.col(f"`{c}`") if is_number else F.lit(None)).cast("long").alias("__number"), (F.lit(None) if is_number else F.col(f"`{c}`")).cast("string").alias("__word"))
        )
    return F.array(*out)


def _sums(folds: int) -> list[str]:
    return [f"__{part}{f}" for f in range(folds) for part in "ns"]


def _carried(totals: DataFrame, chunks: int, fan_out: int, names: list[str]) -> DataFrame:
    """``totals`` (key, chunk, sums) with the sums of all earlier chunks of the key in place of the chunk's own."""
    rows = totals.withColumn("__segment", F.expr(f"__chunk div {int(fan_out)}"))
    if chunks > fan_out:
        above = rows.groupBy(*_KEY, F.col("__segment").alias("__chunk")).agg(*[F.sum(c).alias(c) for c in names])
        heads = _carried(above, -(-chunks // fan_out), fan_out, names).withColumn("__segment", F.col("__chunk")).withColumn("__chunk", F.lit(-1).cast("long"))
        rows = rows.unionByName(heads)
    before = Window.partitionBy(*_KEY, "__segment").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.select(*_KEY, "__chunk", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in names])
    return summed.where("__chunk >= 0")


def histories(
    rows: DataFrame,
    ids: list[str],
    columns: list[str],
    time: str,
    fold: str,
    count: str,
    hits: str,
    gap: int = 0,
    folds: int = FOLDS,
    chunk_rows: int = CHUNK_ROWS,
    fan_out: int = FAN_OUT,
    folder: str | None = None,
) -> DataFrame:
    """(ids, column, n, s) for each row with a time and each column (by its place in ``columns``): the history's ``count`` and ``hits`` of the row's key.

    ``rows`` is read several times, so it should be a written table; ``time``
    is in microseconds, ``fold`` from 0 to ``folds`` - 1, and ``ids`` name a row.
    """
    folder = folder or shared_dir(rows.sparkSession)
    base = rows.where(F.col(time).isNotNull()).select(
        *ids, *[c for c in dict.fromkeys(columns) if c not in ids], F.col(time).cast("long").alias("__time"), F.pmod(F.coalesce(F.col(fold), F.lit(0)), F.lit(folds)).cast("int").alias("__fold"), F.col(count).cast("long").alias("__n"), F.col(hits).cast("long").alias("__s")
    )
    keyed = lambda *wanted: base.select(*wanted, F.explode(_keys(base, columns)).alias("__k")).select(*[c for c in wanted], "__k.*")
    all_rows, first, last = base.agg(F.count("*"), F.coalesce(F.min("__time"), F.lit(0)), F.coalesce(F.max("__time"), F.lit(0))).first()
    span = last + gap - first + 1
    large = keyed().groupBy(*_KEY).agg(F.count("*").alias("__rows")).where(F.col("__rows") > chunk_rows)
    in_chunk = max(1, chunk_rows // 4)
    large = materialize(large.withColumn("__length", F.ceil(F.lit(span) / F.ceil(F.col("__rows") / F.lit(in_chunk)))), folder, "large")
    listed, most = large.agg(F.count("*"), F.coalesce(F.max("__rows"), F.lit(0))).first()
    chunks = -(-most // in_chunk)
    sized = large.select(*[F.col(c).alias(f"h{c}") for c in _KEY], "__length")
    sized = F.broadcast(sized) if listed <= LISTED else sized.hint("merge")

    def chunked(long: DataFrame) -> DataFrame:
        """Adds the chunk, and the length of the key's chunks (null for a key of one); ``long`` has a key and a time."""
        same = [F.col(c).eqNullSafe(F.col(f"h{c}")) for c in _KEY]
        joined = long.join(sized, same[0] & same[1] & same[2], "left")
        chunk = F.coalesce(F.floor((F.col("__time") - F.lit(first)) / F.col("__length")), F.lit(0)).cast("long")
        return joined.withColumn("__chunk", chunk).drop(*[f"h{c}" for c in _KEY])

    names = _sums(folds)
    in_fold = lambda f, c: F.coalesce(F.when(F.col("__fold") == f, F.col(c)), F.lit(0))
    parts = {f"__{part}{f}": in_fold(f, f"__{part}") for f in range(folds) for part in "ns"}
    past = keyed("__time", "__fold", "__n", "__s").withColumn("__time", F.col("__time") + gap)
    if gap:  # chunks in which a key has probes only
        past = past.unionByName(keyed("__time", "__fold").withColumns({"__n": F.lit(0).cast("long"), "__s": F.lit(0).cast("long")}))
    totals = chunked(past).where("__length is not null").groupBy(*_KEY, "__chunk").agg(*[F.sum(e).alias(c) for c, e in parts.items()])
    totals = materialize(totals, folder, "totals")
    heads = materialize(_carried(totals, chunks, fan_out, names), folder, "carried")
    by_fold = F.array(*[F.struct(F.lit(f).alias("__fold"), F.col(f"__n{f}").alias("__n"), F.col(f"__s{f}").alias("__s")) for f in range(folds)])
    nothing = lambda c: F.lit(None).cast(base.schema[c].dataType).alias(c)
    heads = heads.select(*[nothing(c) for c in ids], *_KEY, "__chunk", F.lit(first - 1).cast("long").alias("__time"), F.explode(by_fold).alias("h"), F.lit(False).alias("__asks"))
    heads = heads.select(*ids, *_KEY, "__chunk", "__time", "h.*", "__asks").where("__n > 0")

    table = keyed(*ids, "__time", "__fold", "__n", "__s")
    if gap:
        table = table.withColumn("__asks", F.explode(F.array(F.lit(True), F.lit(False)))).withColumns(
            {c: F.when(F.col("__asks"), F.col(c)) for c in ids} | {c: F.when(~F.col("__asks"), F.col(c)) for c in ("__n", "__s")} | {"__time": F.col("__time") + F.when(F.col("__asks"), 0).otherwise(F.lit(gap))}
        )
    else:
        table = table.withColumn("__asks", F.lit(True))
    # rows are sorted by a hash first: it is compared without a look at the row, which column numbers and null words would not spare
    table = chunked(table).drop("__length").unionByName(heads).withColumn("__mix", F.xxhash64(*_KEY, "__chunk"))
    partitions = (2 if gap else 1) * len(columns) * all_rows // PARTITION_ROWS
    if partitions > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        table = table.repartition(partitions, "__mix")
    # all earlier instants: a head's time is before that of all rows
    running = Window.partitionBy("__mix", *_KEY, "__chunk").orderBy("__time").rangeBetween(Window.unboundedPreceding, -1)
    of_fold = table.select(*ids, "__column", "__asks", "__fold", *[F.sum(F.when(F.col("__fold") == f, F.col(f"__{part}"))).over(running).alias(f"__{part}{f}") for f in range(folds) for part in "ns"])
    others = lambda part: sum((F.when(F.col("__fold") != f, F.coalesce(F.col(f"__{part}{f}"), F.lit(0))).otherwise(0) for f in range(folds)), F.lit(0).cast("long"))
    return of_fold.where("__asks").select(*ids, F.col("__column").alias("column"), others("n").alias("n"), others("s").alias("s"))


def gathered(found: DataFrame, ids: list[str], columns: list[str]) -> DataFrame:
    """One row for the ids with ``<column>_n`` and ``<column>_s`` (0 without a history row)."""
    found = found.repartition(*ids)  # rows of one id meet first: before that, sums would take up more than the rows
    return found.groupBy(*ids).agg(*[F.coalesce(F.max(F.when(F.col("column") == i, F.col(part))), F.lit(0)).alias(f"{c}_{part}") for i, c in enumerate(columns) for part in "ns"])


def rate(n: Column, s: Column, prior: Column, weight: int = WEIGHT) -> Column:
    """Smoothed rate in millionths, in whole numbers; the prior without a history."""
    smoothed = F.call_function("div", s * UNIT + prior * weight, n + weight)
    return F.when(n < 1, prior).otherwise(smoothed).cast("long")


def _attribute(table: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """(key, value) with one row for a key: of several the least value."""
    return table.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias(key)).agg(F.min(value).alias(name))


def sale_encodings(sale_lines: DataFrame, sales: DataFrame, items: DataFrame, vendors: DataFrame, clients: DataFrame, gap: int = 0, folder: str | None = None, **sizes) -> DataFrame:
    """Encodings of each (sale_id, item_id, vendor_id): own counts, and count and rate of the history of item, vendor and client.

    Lines without a sale or ``sold_at`` are dropped; null item and client ids
    are -1; a null vendor id is an id of its own.  Of several sales of one id
    the earliest counts (then the least client).  Rates fall back from the ids
    to kind, nation and segment, and from those to the rate of all history.
    No join broadcasts: tables are joined by sort and merge, whose hot
    partitions Spark splits; lines meet them as sums of equal ones.
    """
    spark = sale_lines.sparkSession
    folder = folder or shared_dir(spark)
    line = ["sale_id", "item_id", "vendor_id"]
    lines = sale_lines.where(F.col("sale_id").isNotNull()).select(
        F.col("sale_id").cast("long").alias("sale_id"), F.coalesce(F.col("item_id").cast("long"), F.lit(-1)).alias("item_id"), F.col("vendor_id").cast("long").alias("vendor_id"), F.coalesce(F.col("flag") == "returned", F.lit(False)).cast("long").alias("returned")
    )
    counted = lambda by: lines.groupBy(*by).agg(F.count("*").alias("n_lines"), F.sum("returned").alias("n_returned"))
    timed = sales.where(F.col("sold_at").isNotNull() & F.col("sale_id").isNotNull())
    timed = timed.select(F.col("sale_id").cast("long").alias("sale_id"), micros(F.col("sold_at")).alias("at"), F.coalesce(F.col("client_id").cast("long"), F.lit(-1)).alias("client_id"))
    # the least (at, client) in two plain sums' worth of state: min and min_by
    once = timed.groupBy("sale_id").agg(F.min("at").alias("at"), F.min_by("client_id", F.struct("at", "client_id")).alias("client_id"))
    once = once.withColumn("fold", F.pmod(F.crc32(F.col("sale_id").cast("string")), F.lit(FOLDS)).cast("int"))
    merged = lambda df, name: materialize(df, folder, name).hint("merge")  # noqa: E731  written, so that what is joined comes from a plain shuffle, which Spark can split
    sold = once.join(counted(["sale_id"]).hint("merge"), "sale_id")
    sold = sold.join(merged(_attribute(clients, "client_id", "segment", "segment"), "segments"), "client_id", "left").withColumn("all", F.lit(0))
    sold = materialize(sold.select("sale_id", "at", "client_id", "fold", "n_lines", "n_returned", "segment", "all"), folder, "sales")
    arguments = dict(time="at", fold="fold", count="n_lines", hits="n_returned", gap=gap, **sizes)
    of_sale = histories(sold, ["sale_id"], ["client_id", "segment", "all"], folder=f"{folder}/of_sales", **arguments)
    known = gathered(of_sale, ["sale_id"], ["client_id", "segment", "all"])
    known = known.withColumn("all_rate", rate(F.col("all_n"), F.col("all_s"), F.lit(EMPTY_RATE)))
    known = known.withColumn("client_rate", rate(F.col("client_id_n"), F.col("client_id_s"), rate(F.col("segment_n"), F.col("segment_s"), F.col("all_rate"))))
    known = sold.select("sale_id", "at", "fold").join(known.select("sale_id", F.col("client_id_n").alias("client_n"), "client_rate", "all_rate").hint("merge"), "sale_id")
    base = counted(line).join(merged(known, "known"), "sale_id")
    base = base.join(merged(_attribute(items, "item_id", "kind", "kind"), "kinds"), "item_id", "left").join(merged(_attribute(vendors, "vendor_id", "nation_id", "nation_id"), "nations"), "vendor_id", "left")
    base = materialize(base.select(*line, "at", "fold", "n_lines", "n_returned", "client_n", "client_rate", "all_rate", "kind", "nation_id"), folder, "lines")
    columns = ["item_id", "vendor_id", "kind", "nation_id"]
    keyed = base.withColumns({"sale": F.col("sale_id"), "item": F.col("item_id"), "vendor": F.col("vendor_id")})
    found = histories(keyed, ["sale", "item", "vendor"], columns, folder=f"{folder}/of_lines", **arguments).withColumnsRenamed({"sale": "sale_id", "item": "item_id", "vendor": "vendor_id"})
    own = ["n_lines", "n_returned", "client_n", "client_rate", "all_rate"]
    nothing = lambda *names: {c: F.lit(None).cast("long") for c in names}
    both = found.withColumns(nothing(*own)).unionByName(base.select(*line, *own).withColumns(nothing("n", "s") | {"column": F.lit(None).cast("int")}))
    wide = both.repartition(*line).groupBy(*line).agg(*[F.max(c).alias(c) for c in own], *[F.max(F.when(F.col("column") == i, F.col(part))).alias(f"{c}_{part}") for i, c in enumerate(columns) for part in "ns"])
    prior = lambda c: rate(F.col(f"{c}_n"), F.col(f"{c}_s"), F.col("all_rate"))
    return wide.select(
        *line, "n_lines", "n_returned",
        F.col("item_id_n").alias("item_n"), rate(F.col("item_id_n"), F.col("item_id_s"), prior("kind")).alias("item_rate"),
        F.col("vendor_id_n").alias("vendor_n"), rate(F.col("vendor_id_n"), F.col("vendor_id_s"), prior("nation_id")).alias("vendor_rate"),
        "client_n", "client_rate",
    )
