"""Title and text functions as native column expressions (operators H1-H10, B3, B6, B7, B9)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# They decide results.
UNTITLED = "Untitled Note"
ALL_NOTES = "All Notes"
#: White space as Unicode text stripping knows it, one class for Java regular expressions.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: What a title loses, in this order: heading marks, emphasis, code and strike marks,
#: an escaped image form, reference links, characters that file systems refuse.
#: In ``(?d)`` only a line feed ends a line.
TITLE_STEPS = (
    rf"\A#+{SPACE}*",
    r"\*\*|__|\*|_",
    "`",
    "~~",
    r"(?d)!\\[.*?]\(.*?\\\]\)",
    r"(?d)\[.*?\]\[.*?\]",
    r'[<>:"/\\|?*]',
)


def strip(c: Column) -> Column:
    """Both ends cleared of Unicode white space (``trim`` knows spaces only)."""
    return F.regexp_replace(c, rf"\A{SPACE}+|{SPACE}+\z", "")


def first_line(c: Column) -> Column:
    return strip(F.split(c, "\n", 2)[0])


def sanitize_title(content: Column) -> Column:
    """Title of a text: its first line without markup; may be empty (callers decide)."""
    line = first_line(content)
    title = line
    for step in TITLE_STEPS:
        title = F.regexp_replace(title, step, "")
    return F.when(line == "", UNTITLED).otherwise(strip(title))


def saved_title(content: Column) -> Column:
    """As saving does: an empty title becomes the default one."""
    title = sanitize_title(content)
    return F.when(title == "", UNTITLED).otherwise(title)


def raw_title(content: Column) -> Column:
    """First line as it stands, or the default title."""
    line = first_line(content)
    return F.when(line == "", UNTITLED).otherwise(line)


def title_contains(title: Column, query: str) -> Column:
    """Case-blind literal substring; an empty query matches everything."""
    return F.lower(title).contains(query.lower())


def is_blank(c: Column) -> Column:
    return strip(c) == ""


def valid_category(name: Column) -> Column:
    """Whether a category of this name may be made; NULL may not."""
    return F.coalesce(~is_blank(name), F.lit(False))


def has_category(category: Column) -> Column:
    """NULL and '' both mean uncategorised."""
    return category.isNotNull() & (category != "")


def in_category(category: Column, selected: str | None) -> Column:
    """All notes for the sentinel, else exact match."""
    return F.lit(True) if selected in (None, ALL_NOTES) else category == selected


def stored_category(category: Column) -> Column:
    """The sentinel is stored as ''."""
    return F.when(category == ALL_NOTES, "").otherwise(category)


def note_text(title: Column, content: Column) -> Column:
    """A generated note's text; missing parts read as ``None``, as string formatting has it."""
    none = F.lit("None")
    return F.concat(F.lit("# "), F.coalesce(title, none), F.lit("\n\n"), F.coalesce(content, none))
