"""Predicates and edits over Markdown, names, titles and nested recap fields."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

CALL_TYPES = ("sales", "interview", "standup", "planning", "support", "other")


def is_separator(line: Column) -> Column:
    """Three dashes or more and nothing else."""
    return line.rlike(r"^-{3,}$")


def is_heading(line: Column) -> Column:
    return line.rlike(r"^#{1,6}\s")


def is_header(line: Column) -> Column:
    """The head of a transcript turn."""
    return line.startswith("**") & line.contains("]:")


def is_blank_markdown(text: Column) -> Column:
    """Null, or nothing but blank lines and headings."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    return F.forall(lines, lambda line: (F.trim(line) == "") | line.rlike(r"^\s*#{1,6}(\s|$)"))


def is_safe_name(name: Column) -> Column:
    """Without characters that Markdown acts on."""
    return ~name.rlike(r"[*`_\[\]\\]")


def is_uuid(text: Column) -> Column:
    return text.rlike(r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")


def escaped_structure(text: Column) -> Column:
    """Separator and header lines get a backslash before them."""
    return F.array_join(F.transform(F.split(text, "\n"), lambda x: F.when(is_separator(x) | is_header(x), F.concat(F.lit("\\"), x)).otherwise(x)), "\n")


def paragraphs(text: Column) -> Column:
    """Blocks between blank lines, headings left out, blanks dropped."""
    plain = F.regexp_replace(text, r"(?m)^#{1,6}\s.*$", "")
    return F.filter(F.transform(F.split(plain, r"\n\s*\n"), lambda p: F.trim(p)), lambda p: p != "")


def bolded(text: Column, names: list[str]) -> Column:
    """The first occurrence of each name between word borders in bold, longest names first."""
    for name in sorted(set(names), key=lambda n: (-len(n), n)):
        text = F.regexp_replace(text, rf"(?s)^(.*?)(?<![\p{{L}}\p{{N}}*`])({re.escape(name)})(?![\p{{L}}\p{{N}}*`])", "$1**$2**")
    return text


def capitalised(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.expr("''"), F.substring(text, F.lit(2), F.greatest(F.lit(0), F.char_length(text) - 1)))


def title_or(title: Column, started_at: Column, key: Column) -> Column:
    """The trimmed title, else the day of the call, else the start of its key."""
    own = F.trim(F.coalesce(title, F.lit("")))
    return F.when(own != "", own).when(started_at.isNotNull(), F.concat(F.lit("Call · "), F.date_format(started_at, "dd.MM.yyyy"))).otherwise(F.substring(key, 1, 8))


def call_type(text: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return F.when(low.isin(*CALL_TYPES), low).otherwise("other")


def clamped(value: Column, low: float, high: float, otherwise: float) -> Column:
    return F.when(value.isNull() | F.isnan(value), otherwise).otherwise(F.least(F.lit(high), F.greatest(F.lit(low), value)))


def sliding_windows(text: Column, size: int, overlap: int) -> Column:
    """Pieces of size characters, each starting size - overlap after the last; the final one reaches the end."""
    step, n = size - overlap, F.char_length(text)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((n - size) / step).cast("int")))
    return F.transform(starts, lambda i: F.substring(text, i * step + 1, F.lit(size)))


def first_object(text: Column) -> Column:
    """The first balanced {...} of a text, minding strings and escapes; null if there is none."""
    chars = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c, i: F.struct(c.alias("c"), i.alias("i")))
    kind = lambda at, end, depth, text_, escape: F.struct(at.alias("at"), end.alias("end"), depth.alias("depth"), text_.alias("in_text"), escape.alias("escape"))
    start = kind(F.lit(-1), F.lit(-1), F.lit(0), F.lit(False), F.lit(False))

    def step(s, x):
        c, open_ = x["c"], s["at"] >= 0
        opened = F.when((c == "{") & ~open_, x["i"]).otherwise(s["at"])
        depth = s["depth"] + F.when(s["in_text"], 0).when(c == "{", 1).when((c == "}") & open_, -1).otherwise(0)
        closed = open_ & ~s["in_text"] & (c == "}") & (depth == 0)
        in_text = F.when(open_ & (c == '"') & ~s["escape"], ~s["in_text"]).otherwise(s["in_text"])
        moved = kind(opened, F.when(closed, x["i"]).otherwise(F.lit(-1)), depth, in_text, s["in_text"] & (c == "\\") & ~s["escape"])
        return F.when(s["end"] >= 0, s).otherwise(moved)

    found = F.aggregate(chars, start, step)
    return F.when(found["end"] >= 0, F.substring(text, found["at"] + 1, found["end"] - found["at"] + 1))


def pause_total(total_ms: Column, paused_at: Column, now: Column) -> Column:
    """The paused time with a pause that is still on; clocks that run back add nothing."""
    on = F.greatest(F.lit(0), F.unix_millis(now) - F.unix_millis(paused_at))
    return F.coalesce(total_ms, F.lit(0)) + F.coalesce(on, F.lit(0))
