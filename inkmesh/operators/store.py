"""Mutations as functions from tables to tables.

Nothing is changed in place: each function returns the tables as they are
afterwards, and ``sources.snapshot`` publishes them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkmesh.functions.text import is_blank, raw_title, saved_title, sanitize_title, stored_category
from inkmesh.operators.asof import last_before
from inkmesh.operators.components import connected
from inkmesh.operators.graph import within
from inkmesh.operators.ordinals import numbered
from inkmesh.schemas import NOTES
from inkmesh.sources.scratch import scratch, written

END = ["source_note_id", "target_note_id"]


def _last_seq(notes: DataFrame) -> DataFrame:
    return notes.agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("__last"))


def _patched(notes: DataFrame, patch: DataFrame, columns: list[str], keys: Iterable[str] = ()) -> DataFrame:
    """Rows of ``notes`` with ``columns`` from ``patch`` where the id (of the same ``keys``) has a row there (a NULL counts as a value)."""
    p = patch.select(*keys, "id", F.lit(True).alias("__hit"), *[F.col(c).alias(f"__{c}") for c in columns])
    joined = notes.join(p, [*keys, "id"], "left")
    return joined.select(*[F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in notes.columns])


# --- settings ---------------------------------------------------------------


def settings_after(log: DataFrame) -> DataFrame:
    """(key, value) after a log of puts (key, value, seq): the last write of each key stays."""
    return log.groupBy("key").agg(F.max_by("value", "seq").alias("value"))


def setting(settings: DataFrame, key: str) -> DataFrame:
    return settings.where(F.col("key") == key).select("value").limit(1)


# --- notes ------------------------------------------------------------------


def clashing_ids(notes: DataFrame, new: DataFrame) -> DataFrame:
    """Ids of ``new`` that exist already or occur twice in it."""
    return new.join(notes.select("id"), "id", "left_semi").select("id").unionByName(new.groupBy("id").count().where("count > 1").select("id")).distinct()


def insert_notes(notes: DataFrame, new: DataFrame) -> DataFrame:
    """Appends rows (id, title, content, category, ts, pos); all or nothing: any id clash raises."""
    if clashing_ids(notes, new).limit(1).count():
        raise ValueError("a note with this id exists")
    last = _last_seq(notes)
    rows = new.join(F.broadcast(last), F.lit(True))
    rows = rows.select("id", "title", "content", "category", F.col("ts").alias("created_at"), F.col("ts").alias("updated_at"), (F.col("__last") + 1 + F.col("pos")).cast("long").alias("seq"))
    return notes.unionByName(rows)


def update_notes(notes: DataFrame, patch: DataFrame) -> DataFrame:
    """Title, content and category of the patched ids; a patch without category resets it to ''; unknown ids do nothing."""
    if "category" not in patch.columns:
        patch = patch.withColumn("category", F.lit(""))
    return _patched(notes, patch.withColumnRenamed("ts", "updated_at"), ["title", "content", "category", "updated_at"])


def retitle(notes: DataFrame, note_id: str, title: str, category: str, ts: Column) -> DataFrame:
    """Unsanitised rename (the store's own, below the service)."""
    hit = F.col("id") == note_id
    return notes.withColumns({"title": F.when(hit, F.lit(title)).otherwise(F.col("title")), "category": F.when(hit, F.lit(category)).otherwise(F.col("category")), "updated_at": F.when(hit, ts).otherwise(F.col("updated_at"))})


def rename_status(notes: DataFrame, renames: DataFrame) -> DataFrame:
    """(id, new_title) to (id, ok, result): the sanitised title, or why it was refused."""
    asked = renames.select("id", sanitize_title(F.col("new_title")).alias("clean"))
    known = asked.join(notes.select("id", F.lit(True).alias("known")), "id", "left")
    return known.select(
        "id",
        ((F.col("clean") != "") & F.col("known").isNotNull()).alias("ok"),
        F.when(F.col("clean") == "", "the title is empty").when(F.col("known").isNull(), "no such note").otherwise(F.col("clean")).alias("result"),
    )


def rename_notes(notes: DataFrame, renames: DataFrame) -> DataFrame:
    """Applies (id, new_title, category, ts): title and category change, content stays, titles may collide."""
    patch = renames.withColumns({"title": sanitize_title(F.col("new_title")), "updated_at": F.col("ts")}).where(F.col("title") != "")
    return _patched(notes, patch, ["title", "category", "updated_at"])


def save_new(notes: DataFrame, saves: DataFrame) -> DataFrame:
    """Replays saves without ids (pos, id, content, category, ts), in order of pos.

    Each title's first save makes the note (unless one of that title exists,
    whose earliest is then overwritten), and the last one leaves its text.
    Such a log is one grouped aggregate; ``id`` is the id a new note would get.
    """
    titled = saves.select(saved_title(F.col("content")).alias("title"), "pos", "id", "content", stored_category(F.col("category")).alias("category"), "ts")
    per_title = titled.groupBy("title").agg(
        F.min_by("id", "pos").alias("new_id"), F.min("pos").alias("first_pos"), F.max_by(F.struct("content", "category"), "pos").alias("last"), F.min_by("ts", "pos").alias("first_ts"), F.max_by("ts", "pos").alias("last_ts")
    )
    existing = notes.groupBy("title").agg(F.min_by("id", "seq").alias("old_id"))
    matched = per_title.join(existing, "title", "left")
    patch = matched.where("old_id is not null").select(F.col("old_id").alias("id"), "title", "last.content", "last.category", F.col("last_ts").alias("updated_at"))
    kept = _patched(notes, patch, ["title", "content", "category", "updated_at"])
    fresh = matched.where("old_id is null").join(F.broadcast(_last_seq(notes)), F.lit(True))
    return kept.unionByName(
        fresh.select(F.col("new_id").alias("id"), "title", "last.content", "last.category", F.col("first_ts").alias("created_at"), F.col("last_ts").alias("updated_at"), (F.col("__last") + 1 + F.col("first_pos")).cast("long").alias("seq"))
    )


#: Titles of one id up to which its saves may part the runs of those titles (see ``_thinned``).
FEW_TITLES = 8
#: Rows of a component that one task replays at once; larger ones go through windows of so many saves.
GROUP_ROWS, WINDOW_ROWS = 1 << 16, 1 << 19
_NEW = 1 << 62


def _thinned(log: DataFrame, held: DataFrame, keys: list[str], folder: str) -> DataFrame:
    """Positions of the saves that a replay needs (store keys, pos).

    ``log`` has the keys, pos, note_id, new_id, title and sure (whether the save
    names no note, or one that was there before); ``held`` has (title, note_id) for
    all titles that a note may ever have.  A title can lose its note only at
    a save that gives one of its notes another title.  Between two such saves
    the title, once it surely has a note, keeps it, so that all later ones but
    the last only write what is overwritten.  Titles of notes that are given more than
    ``FEW_TITLES`` titles are not thinned.
    """
    titles = written(held.distinct(), folder, "held")
    few = titles.groupBy(*keys, "note_id").agg(F.count("*").alias("__titles"))
    many = written(few.where(F.col("__titles") > FEW_TITLES), folder, "many")
    whole = titles.join(many, [*keys, "note_id"], "left_semi").select(*keys, "title").distinct()
    whole = written(whole.withColumn("__whole", F.lit(True)), folder, "whole")
    tied = titles.join(many, [*keys, "note_id"], "left_anti").withColumnRenamed("title", "__other")
    moves = log.where("note_id is not null").join(tied, [*keys, "note_id"]).where("title <> __other").select(*keys, F.col("__other").alias("title"), "pos").distinct()
    moves = written(moves.withColumn("__move", F.col("pos")), folder, "moves")
    runs = written(last_before(log, moves, [*keys, "title"], "pos", ["__move"], folder=folder), folder, "runs")
    ends = runs.groupBy(*keys, "title", F.coalesce("__move", F.lit(-1)).alias("__move")).agg(F.min(F.when(F.col("sure"), F.col("pos"))).alias("__sure"), F.max("pos").alias("__last"))
    ends = written(ends.join(whole, [*keys, "title"], "left"), folder, "ends")
    marked = runs.withColumn("__move", F.coalesce("__move", F.lit(-1))).join(ends, [*keys, "title", "__move"])
    return marked.where(F.col("__whole") | F.col("__sure").isNull() | (F.col("pos") <= F.col("__sure")) | (F.col("pos") == F.col("__last"))).select(*keys, "pos")


def _targets(notes: Iterable[tuple], saves: Iterable[tuple]) -> Iterator[tuple]:
    """(place, target, title, order) of all saves that write, given notes (id, title, order) and saves (place, note or None, fresh id, title, order of a new note)."""
    held: dict = {}
    holders: dict[object, list[tuple]] = {}
    for i, title, order in notes:
        held[i] = title, order
        holders.setdefault(title, []).append((order, i))
    for owners in holders.values():
        heapify(owners)
    for place, note, fresh, title, order in saves:
        owners = holders.setdefault(title, [])
        while owners and held[owners[0][1]][0] != title:  # it has moved away
            heappop(owners)
        if owners:
            order, target = owners[0]
        else:
            if note is None:
                target = fresh
            elif note in held:
                target, order = note, held[note][1]
            else:
                continue
            held[target] = title, order
            heappush(owners, (order, target))
        yield place, target, title, order


def _in_groups(notes: DataFrame, saves: DataFrame, keys: list[str]) -> DataFrame:
    """(store keys, pos, target) of the saves that write, each component in one group."""
    columns = [*keys, "pos", "target"]
    text = {f.name: f.dataType.simpleString() for f in saves.schema}

    def replay(before: pd.DataFrame, log: pd.DataFrame) -> pd.DataFrame:
        log = log.sort_values("pos")
        named = [n if isinstance(n, str) else None for n in log["note_id"]]
        at = log["pos"].tolist()
        found = _targets(zip(before["id"], before["title"], before["seq"], strict=True), zip(at, named, log["new_id"], log["title"], [_NEW + p for p in at], strict=True))
        store = log[keys].iloc[0].tolist() if len(log) else []
        return pd.DataFrame([(*store, r[0], r[1]) for r in found], columns=columns)

    by = [*keys, "component"]
    return notes.groupBy(*by).cogroup(saves.groupBy(*by)).applyInPandas(replay, ", ".join([*[f"`{k}` {text[k]}" for k in keys], f"pos {text['pos']}", "target string"]))


def _in_windows(notes: DataFrame, saves: DataFrame, keys: list[str], folder: str) -> DataFrame:
    """The same for components that no task holds: the log goes by in windows of ``WINDOW_ROWS`` saves.

    Titles and ids are numbers here.  ``state`` is the title of each note at
    the window's begin; a window is replayed in one task with the notes that it names, and for each of
    its titles the earliest other holder, which cannot move in it.  The saves up to the next
    one that meets a title without holder, and so may make or move a note,
    change no title: they need no window, and are joined with the holders.
    """
    spark = saves.sparkSession
    names = notes.select(*keys, "id").unionByName(saves.select(*keys, F.explode(F.array("note_id", "new_id")).alias("id")))
    ids = written(numbered(names.where("id is not null").distinct(), [*keys, "id"], "__i", folder=f"{folder}/ids"), folder, "id_numbers")
    titles = notes.select(*keys, "title").unionByName(saves.select(*keys, "title")).distinct()
    titles = written(numbered(titles, [*keys, "title"], "t", folder=f"{folder}/titles"), folder, "title_numbers")
    number = lambda c, n: ids.select(*keys, F.col("id").alias(c), F.col("__i").alias(n))
    placed = written(numbered(saves, ["pos", *keys], "at", folder=f"{folder}/places"), folder, "placed")
    coded = placed.join(titles, [*keys, "title"]).join(number("note_id", "note"), [*keys, "note_id"], "left").join(number("new_id", "fresh"), [*keys, "new_id"], "left")
    log = written(coded.select("at", F.coalesce("note", F.lit(-1)).alias("note"), F.coalesce("fresh", F.lit(-1)).alias("fresh"), "t").repartitionByRange("at").sortWithinPartitions("at"), folder, "coded")
    state = notes.join(titles, [*keys, "title"]).join(number("id", "i"), [*keys, "id"]).select("i", "t", F.col("seq").alias("o"))
    state = written(state, folder, "state")
    lasts = written(log.groupBy("t").agg(F.max("at").alias("last")), folder, "lasts")
    total, low, parts = log.count(), 0, []

    def kept(df: DataFrame) -> None:
        parts.append(f"{folder}/part{len(parts)}")
        df.write.mode("overwrite").parquet(parts[-1])

    def replay(before: pd.DataFrame, window: pd.DataFrame) -> pd.DataFrame:
        window = window.sort_values("at")
        at = window["at"].tolist()
        named = [None if n < 0 else n for n in window["note"].tolist()]
        found = _targets(zip(*[before[c].tolist() for c in "ito"], strict=True), zip(at, named, window["fresh"].tolist(), window["t"].tolist(), [_NEW + p for p in at], strict=True))
        return pd.DataFrame(list(found), columns=["at", "i", "t", "o"])

    while low < total:
        rest = log.where(F.col("at") >= low)
        free = lasts.where(F.col("last") >= low).join(state, "t", "left_anti").select("t")
        acting = rest.join(free, "t", "left_semi").join(state.select(F.col("i").alias("note"), F.lit(True).alias("known")), "note", "left").where("note < 0 or known")
        stop = acting.agg(F.min("at")).first()[0]
        stop = total if stop is None else stop
        if stop > low:
            kept(rest.where(F.col("at") < stop).join(state.groupBy("t").agg(F.min_by("i", F.struct("o", "i")).alias("i")), "t").select("at", "i"))
        low = stop + WINDOW_ROWS
        if stop < total:
            window = log.where((F.col("at") >= stop) & (F.col("at") < low))
            named = window.where("note >= 0").select(F.col("note").alias("i")).distinct()
            still = state.join(window.select("t").distinct(), "t", "left_semi").join(named, "i", "left_anti").groupBy("t").agg(F.min(F.struct("o", "i")).alias("least"))
            before = state.join(named, "i", "left_semi").select("i", "t", "o").unionByName(still.select("least.i", "t", "least.o"))
            one = lambda df: df.withColumn("one", F.lit(0)).groupBy("one")
            wrote = written(one(before).cogroup(one(window)).applyInPandas(replay, "at long, i long, t long, o long"), folder, f"window{low}")
            kept(wrote.select("at", "i"))
            now = wrote.groupBy("i").agg(F.max_by("t", "at").alias("t"), F.max("o").alias("o"))
            state = written(state.join(now, "i", "left_anti").select("i", "t", "o").unionByName(now), folder, f"state{low}")
    found = spark.read.schema("at long, i long").parquet(*parts)
    return found.join(placed.select(*keys, "pos", "at"), "at").join(ids.withColumnRenamed("__i", "i"), [*keys, "i"]).select(*keys, "pos", F.col("id").alias("target"))


def save_replay(notes: DataFrame, saves: DataFrame, folder: str | None = None) -> DataFrame:
    """Replays saves that may name ids (pos, note_id or NULL, new_id, content, category, ts), in order of ``pos`` (unique).

    A save whose title a note has overwrites the earliest such note and leaves the
    named one alone; else it makes a note, or gives the named one its text and title.
    So whether a save overwrites depends on the titles left by those before it,
    but only through titles and notes that the log ties together: saves, and the
    notes that they can reach, are parted into the connected components of
    titles and ids, and each component is replayed by itself: in one group, or, with
    more than ``GROUP_ROWS`` rows, window by window (``_in_windows``).  A replay sees names
    and places only; texts are joined to what it finds.  Before that, saves
    of which nothing stays and nothing depends are left out (``_thinned``), so that
    a title of very many saves is a few rows.  Notes of which no title or id
    occurs in the log never leave their place; of those that share a title with
    a save but are not named, only the earliest is looked at.

    New notes follow the old ones, in order of their saves (``seq`` with gaps).
    A save that names no known note does nothing; ids of new notes that are taken
    raise.  Give ``store`` columns to replay many stores at once.
    """
    folder = folder or scratch(notes.sparkSession)
    keys = ["store"] if "store" in notes.columns else []
    columns = [*keys, *NOTES.fieldNames()]
    spread = lambda *names: [*keys, *names]
    titled = written(saves.select(*spread("pos", "note_id", "new_id", "content", "ts"), saved_title(F.col("content")).alias("title"), stored_category(F.col("category")).alias("category")), folder, "saves")
    narrow = written(notes.select(*spread("id", "title", "seq")), folder, "notes")
    names = titled.select(*spread("new_id")).where("new_id is not null").withColumnRenamed("new_id", "id")
    fresh_ids = titled.where("note_id is null").select(*spread("new_id")).withColumnRenamed("new_id", "id")
    if fresh_ids.where("id is null").limit(1).count() or names.groupBy(*spread("id")).count().where("count > 1").limit(1).count() or names.join(narrow, spread("id"), "left_semi").limit(1).count():
        raise ValueError("the ids of new notes must be new, and differ")

    known = narrow.select(*spread("id"), F.lit(True).alias("sure")).withColumnRenamed("id", "note_id")
    log = titled.select(*spread("pos", "note_id", "new_id", "title")).join(known, spread("note_id"), "left")
    log = written(log.select(*spread("pos", "note_id", "new_id", "title"), (F.col("note_id").isNull() | F.col("sure").isNotNull()).alias("sure")), folder, "log")
    named = written(log.where("note_id is not null").select(*spread("note_id")).distinct(), folder, "named")
    moving = written(narrow.join(named.withColumnRenamed("note_id", "id"), spread("id"), "left_semi").select(*spread("id", "title", "seq")), folder, "moving")
    held = moving.select(*spread("title", F.col("id").alias("note_id"))).unionByName(log.where("note_id is not null").select(*spread("title", "note_id")))
    made = log.where("note_id is null").select(*spread("title", F.col("new_id").alias("note_id"))).join(named, spread("note_id"), "left_semi")
    kept = written(titled.join(_thinned(log, held.unionByName(made.select(*held.columns)), keys, folder), spread("pos"), "left_semi"), folder, "kept")

    still = narrow.join(kept.select(*spread("title")).distinct(), spread("title"), "left_semi").join(named.withColumnRenamed("note_id", "id"), spread("id"), "left_anti")
    still = still.groupBy(*spread("title")).agg(F.min_by("id", "seq").alias("id"), F.min("seq").alias("seq"))
    reached = written(moving.select(*spread("id", "title", "seq")).unionByName(still.select(*spread("id", "title", "seq"))), folder, "reached")

    # equal hashes of different names only join components, which changes no result
    node = lambda kind, c: F.xxhash64(F.lit(kind), *keys, c)
    of_notes = reached.select(node("title", "title").alias("a"), node("id", "id").alias("b"))
    of_saves = kept.select(node("title", "title").alias("a"), node("id", F.coalesce("note_id", "new_id")).alias("b"))
    component = written(connected(of_notes.unionByName(of_saves).distinct(), f"{folder}/ties"), folder, "components").withColumnRenamed("node", "__node")
    placed = lambda df: df.withColumn("__node", node("title", "title")).join(component, "__node").drop("__node")
    old = written(placed(reached), folder, "old_placed")
    new = written(placed(kept.select(*spread("pos", "note_id", "new_id", "title"))), folder, "kept_placed")
    sizes = old.select("component").unionByName(new.select("component")).groupBy("component").agg(F.count("*").alias("rows"))
    large = written(sizes.where(F.col("rows") > GROUP_ROWS).select("component"), folder, "large")
    part = lambda df, how: df.join(large, "component", how)
    writes = _in_groups(part(old, "left_anti"), part(new, "left_anti"), keys)
    if large.head(1):
        writes = writes.unionByName(_in_windows(part(old, "left_semi").drop("component"), part(new, "left_semi").drop("component"), keys, f"{folder}/windows"))
    writes = written(writes, folder, "writes")

    last = writes.groupBy(*spread("target")).agg(F.max("pos").alias("pos"))
    last = last.join(kept.select(*spread("pos", "title", "content", "category", "ts")), spread("pos")).select(*spread("target", "title", "content", "category", "ts")).withColumnRenamed("target", "id")
    last = written(last, folder, "last")
    made = kept.where("note_id is null").join(writes.withColumnRenamed("target", "new_id"), spread("pos", "new_id"), "left_semi").select(*spread("pos", "new_id", "ts"))
    end = F.coalesce(F.max("seq"), F.lit(-1)).alias("__end")
    ends = narrow.groupBy(*keys).agg(end) if keys else narrow.agg(end)
    made = made.withColumnsRenamed({"new_id": "id", "ts": "created_at"})
    made = made.join(F.broadcast(ends), keys, "left") if keys else made.join(F.broadcast(ends), F.lit(True))
    fresh = made.join(last, spread("id")).select(*spread("id", "title", "content", "category", "created_at"), F.col("ts").alias("updated_at"), (F.coalesce("__end", F.lit(-1)) + 1 + F.col("pos")).cast("long").alias("seq"))
    patch = last.withColumnRenamed("ts", "updated_at")
    return _patched(notes.select(*columns), patch, ["title", "content", "category", "updated_at"], keys).unionByName(fresh.select(*columns))


def save_by_id(notes: DataFrame, note_id: str, content: str, category: str, ts: Column) -> DataFrame:
    """Upsert by id with the raw first line as title (no title lookup)."""
    spark = notes.sparkSession
    row = spark.range(1).select(F.lit(note_id).alias("id"), raw_title(F.lit(content)).alias("title"), F.lit(content).alias("content"), F.lit(category).alias("category"), ts.alias("ts"))
    if notes.where(F.col("id") == note_id).limit(1).count():
        return update_notes(notes, row)
    return insert_notes(notes, row.withColumn("pos", F.lit(0)))


def can_save(content: Column) -> Column:
    return ~is_blank(content)


def delete_notes(notes: DataFrame, links: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Notes without ``ids`` (column id), and links without those that touch them."""
    gone = ids.select("id").distinct()
    left = links.join(gone.select(F.col("id").alias("source_note_id")), "source_note_id", "left_anti").join(gone.select(F.col("id").alias("target_note_id")), "target_note_id", "left_anti")
    return notes.join(gone, "id", "left_anti"), left.select(*END)


def delete_category(notes: DataFrame, links: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Deletes a category's notes and all links that touch them; NULL categories survive."""
    gone = notes.where(F.col("category") == name).select("id")
    return notes.where(~F.col("category").eqNullSafe(F.lit(name))), delete_notes(notes, links, gone)[1]


# --- links ------------------------------------------------------------------


def dangling(notes: DataFrame, new: DataFrame) -> DataFrame:
    """Links of ``new`` with a missing end."""
    ids = notes.select("id")
    return new.select(*END).exceptAll(within(new, ids))


def insert_links(notes: DataFrame, links: DataFrame, new: DataFrame) -> DataFrame:
    """Adds links, ignoring repeats (in ``new`` or existing); any missing end raises and nothing is added."""
    if dangling(notes, new).limit(1).count():
        raise ValueError("a link names a note that does not exist")
    return links.select(*END).unionByName(new.select(*END)).distinct()


def insert_valid_links(notes: DataFrame, links: DataFrame, new: DataFrame) -> DataFrame:
    """As ``insert_links``, but links with a missing end are left out."""
    return links.select(*END).unionByName(within(new, notes.select("id"))).distinct()


def link_status(notes: DataFrame, links: DataFrame, wanted: DataFrame) -> DataFrame:
    """(source, target, added): False for an existing link or a missing end."""
    ids = lambda c: notes.select(F.col("id").alias(c), F.lit(True).alias(f"__{c}"))
    w = wanted.join(links.select(*END, F.lit(True).alias("__old")), END, "left").join(ids("source_note_id"), "source_note_id", "left").join(ids("target_note_id"), "target_note_id", "left")
    return w.select(*END, (F.col("__old").isNull() & F.col("__source_note_id").isNotNull() & F.col("__target_note_id").isNotNull()).alias("added"))


def may_link(source: Column, target: Column) -> Column:
    """The interactive rule: no link to itself (the store itself allows it)."""
    return source != target


def unlink(links: DataFrame, source: str, target: str) -> DataFrame:
    """Removes that direction only; an incoming link shown at a note cannot be removed from there."""
    return links.where(~((F.col("source_note_id") == source) & (F.col("target_note_id") == target)))


def unlinked(links: DataFrame, source: str, target: str) -> bool:
    """Whether ``unlink`` removes anything."""
    return bool(links.where((F.col("source_note_id") == source) & (F.col("target_note_id") == target)).limit(1).count())
