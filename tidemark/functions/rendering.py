"""Titles, ages and files of memories as text, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import first_line, stripped


def age(then: Column, now: Column) -> Column:
    """Whole minutes, hours or days; of a time yet to come the minutes, negative."""
    minutes = F.timestamp_diff("MINUTE", then, now)
    return F.when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m ago"))).when(minutes < 1440, F.concat(F.floor(minutes / 60).cast("string"), F.lit("h ago"))).otherwise(F.concat(F.floor(minutes / 1440).cast("string"), F.lit("d ago")))


def days(then: Column, now: Column) -> Column:
    """Whole days, cut off towards zero, whether less than one or of a time yet to come."""
    return F.concat((F.timestamp_diff("MINUTE", then, now) / 1440).cast("long").cast("string"), F.lit("d ago"))


def cut(text: Column, most: int, mark: str = "...") -> Column:
    """The first line, cut to so many characters."""
    line = first_line(text)
    return F.when(F.char_length(line) > most, F.concat(F.left(line, F.lit(most)), F.lit(mark))).otherwise(line)


def slug(title: Column) -> Column:
    """Lower-case letters, digits and -; blanks become -, all else _; 60 characters at most."""
    return F.left(F.regexp_replace(F.regexp_replace(F.lower(title), " ", "-"), r"[^\p{IsAlphabetic}\p{N}-]", "_"), F.lit(60))


def markdown(title: Column, memory_type: Column, timestamp: Column, tags: Column, importance: Column, content: Column, source: str = "tidemark") -> Column:
    """Front matter and content; importance has one digit, ties go to the even one."""
    head = F.format_string('---\ntitle: "%s"\ntype: %s\ndate: %s\ntags: [%s]\nimportance: %.1f\nsource: %s\n---\n\n', F.translate(title, '"', "'"), memory_type, F.date_format(timestamp, "yyyy-MM-dd"), F.array_join(tags, ", "), F.bround(importance.cast("double"), 1), F.lit(source))
    return F.concat(head, content, F.lit("\n"))


def file_name(timestamp: Column, title: Column) -> Column:
    return F.concat(F.date_format(timestamp, "yyyy-MM-dd"), F.lit("-"), slug(title), F.lit(".md"))


def tags_of(text: Column) -> Column:
    """Comma-separated tags, trimmed, empty ones left out."""
    return F.filter(F.transform(F.split(text, ","), stripped), lambda t: t != "")


def hours(silent: Column) -> Column:
    """Days from 48 hours on, hours from one on, else minutes; what is behind the point is cut off, of negative hours too."""
    whole = lambda x, unit: F.concat(x.cast("long").cast("string"), F.lit(unit))
    return F.when(silent >= 48, whole(silent / 24, "d")).when(silent >= 1, whole(silent, "h")).otherwise(whole(silent * 60, "m"))


def short_title(title: Column) -> Column:
    """Up to 60 characters; longer ones are cut to 57 and marked."""
    return F.when(F.char_length(title) > 60, F.concat(F.left(title, F.lit(57)), F.lit("..."))).otherwise(title)


def importance_bar(importance: Column) -> tuple[Column, Column]:
    """Filled fifths, and the colour."""
    value = importance.cast("double")
    filled = F.size(F.filter(F.array(*(F.lit(i / 5) for i in range(5))), lambda x: x < value))
    return filled, F.when(value >= 0.8, "orange").when(value >= 0.5, "green").otherwise("gray")


def commit_content(message: Column, insertions: Column, deletions: Column, files: Column) -> Column:
    return F.format_string("Git commit: %s (+%d -%d in %d files)", stripped(message), insertions, deletions, files)
