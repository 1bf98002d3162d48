"""Rules that turn events into typed memories, as Column expressions.

An event has ``kind``, ``content`` and, for commits, ``message`` and
``files_changed``. A rule gives a struct (title, memory_type, importance,
tags) or null, which drops the event.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Importance is single precision, and commits and new files below this are dropped.
THRESHOLD = 0.4
#: Prefixes of commit titles that become tags.
COMMIT_TAGS = {"feat": "feature", "fix": "bugfix", "refactor": "refactor", "docs": "docs", "test": "test", "chore": "chore", "perf": "performance", "security": "security", "sec": "security"}
#: Titles of memories whose event has none of its own, and bytes that are kept of a decision.
TITLES = {"UserCorrection": "User correction", "ErrorFixed": "Error fixed", "SessionStart": "Session started", "SessionEnd": "Session ended", "conversation_decision": "Conversation decision"}
DECISION_BYTES = 200
#: Importance of a new file by its extension.
FILE_IMPORTANCE = {"rs": 0.5, "ts": 0.5, "py": 0.5, "toml": 0.4, "json": 0.4, "yaml": 0.4, "md": 0.3}
#: Files whose change is a change of dependencies.
MANIFESTS = ("Cargo.toml", "package.json", "requirements.txt")
#: What corrects an earlier answer, and what announces a decision.
CORRECTIONS = (
    "не так", "не то", "стоп", "stop", "wrong", "нет,", "nope",
    "переделай", "redo", "revert", "откатить", "верни",
    "не делай", "don't", "dont", "не надо",
    "лучше", "better", "instead",
    "я имел в виду", "i meant",
    "это неправильно", "that's wrong", "that is wrong",
    "забудь", "forget", "ignore that",
)
DECISIONS = (
    "давай используем", "let's use", "lets use",
    "выбираем", "we'll go with", "going with",
    "решение:", "decision:", "decided",
    "используем", "будем использовать",
    "архитектура:", "architecture:",
    "стек:", "stack:",
    "переходим на", "switching to", "migrating to",
)


def single(x: float | Column) -> Column:
    """Single precision, in which importance and thresholds are compared."""
    return (x if isinstance(x, Column) else F.lit(x)).cast("float")


#: The white space of Unicode.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def stripped(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.trim(text, F.lit(WHITE))


def first_line(text: Column) -> Column:
    """Up to the first line break, which may be one of two characters."""
    return F.when(text.contains("\n"), F.regexp_replace(F.substring_index(text, "\n", 1), r"\r\z", "")).otherwise(text)


def any_of(text: Column, parts: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(p) for p in parts))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """After the last dot of the file's name; empty without one."""
    name = basename(path)
    return F.when(name.contains("."), F.substring_index(name, ".", -1)).otherwise(F.lit(""))


def scope(title: Column) -> Column:
    """Text between the first pair of parentheses, or null."""
    opened, closed = F.instr(title, "("), F.instr(title, ")")
    return F.when((opened > 0) & (closed > opened + 1), F.substring(title, opened + 1, closed - opened - 1))


def commit_tags(message: Column) -> Column:
    prefix = stripped(F.substring_index(F.substring_index(F.lower(message), ":", 1), "(", 1))
    known = reduce(lambda found, pair: found.when(prefix == pair[0], pair[1]), COMMIT_TAGS.items(), F.when(F.lit(False), ""))
    return F.array_compact(F.array(known, scope(F.lower(message))))


def _memory(title: Column, kind: str | Column, importance: float | Column, tags: Column) -> Column:
    kind = kind if isinstance(kind, Column) else F.lit(kind)
    return F.struct(title.alias("title"), kind.alias("memory_type"), single(importance).alias("importance"), tags.alias("tags"))


def _tags(*names: str) -> Column:
    return F.array(*(F.lit(n) for n in names)) if names else F.array().cast("array<string>")


def commit_memory(message: Column, files_changed: Column, threshold: float = THRESHOLD) -> Column:
    """Typed by what the message says; large commits count more, once they are kept."""
    text = F.lower(message)
    decision = text.startswith("feat") | text.contains("add ") | text.contains("implement")
    fix = text.startswith("fix") | text.contains("bug")
    chore = text.startswith("refactor") | text.startswith("chore")
    docs = text.startswith("docs") | text.startswith("test")
    importance = F.when(decision, single(0.7)).when(fix, single(0.6)).when(chore, single(0.3)).when(docs, single(0.2)).otherwise(single(0.4))
    raised = F.when(files_changed > 10, F.least(importance + single(0.2), single(1.0))).otherwise(importance)
    memory = _memory(stripped(message), F.when(decision, "decision").otherwise("note"), raised, commit_tags(message))
    return F.when(importance >= single(threshold), memory)


def file_memory(path: Column, threshold: float = THRESHOLD) -> Column:
    ext = extension(path)
    importance = reduce(lambda found, e: found.when(ext == e, single(FILE_IMPORTANCE[e])), FILE_IMPORTANCE, F.when(F.lit(False), single(0.0))).otherwise(single(0.2))
    return F.when(importance >= single(threshold), _memory(F.concat(F.lit("New file: "), basename(path)), "note", importance, _tags()))


def classify(kind: Column, content: Column, message: Column, files_changed: Column, threshold: float = THRESHOLD) -> Column:
    """The memory of an event, or null: unknown kinds and modified files are dropped. A commit without a message has its content for one."""
    title = {k: F.lit(t) for k, t in TITLES.items()}
    return (
        F.when(kind == "GitCommit", commit_memory(F.coalesce(message, content), files_changed, threshold))
        .when(kind == "DependencyAdded", _memory(F.concat(F.lit("Dependency change: "), basename(content)), "decision", 0.6, _tags("dependency")))
        .when(kind == "FileCreated", file_memory(content, threshold))
        .when(kind == "FileDeleted", _memory(F.concat(F.lit("Deleted: "), basename(content)), "note", 0.4, _tags()))
        .when(kind == "UserCorrection", _memory(title["UserCorrection"], "feedback", 0.9, _tags("feedback", "correction")))
        .when(kind == "ErrorFixed", _memory(title["ErrorFixed"], "note", 0.6, _tags("bugfix")))
        .when(kind == "SessionStart", _memory(title["SessionStart"], "session_summary", 0.5, _tags("session")))
        .when(kind == "SessionEnd", _memory(title["SessionEnd"], "session_summary", 0.5, _tags("session")))
        .when(kind == "conversation_decision", _memory(title["conversation_decision"], "decision", 0.7, _tags("decision", "conversation")))
    )


def file_event(change: Column, path: Column) -> Column:
    """Kind of a file system change, or null."""
    manifest = reduce(lambda a, b: a | b, (path.endswith(m) for m in MANIFESTS))
    return F.when(change.isin("create", "modify") & manifest, "DependencyAdded").when(change == "create", "FileCreated").when(change == "modify", "FileModified").when(change == "remove", "FileDeleted")


def watched(path: Column, ignore: tuple[str, ...], extensions: tuple[str, ...]) -> Column:
    """Whether a path passes the ignore patterns and the list of extensions.

    ``name/`` and ``name`` ignore paths that contain the name, ``*.ext`` those
    of that extension. Files without an extension pass the list.
    """
    out = F.lit(True)
    for pattern in ignore:
        hit = extension(path) == pattern[2:] if pattern.startswith("*.") else path.contains(pattern.rstrip("/"))
        out = out & ~hit
    return out & ((extension(path) == "") | extension(path).isin(*extensions)) if extensions else out


def is_correction(text: Column) -> Column:
    lower = F.lower(text)
    return (F.octet_length(lower) <= 500) & any_of(lower, CORRECTIONS)


def is_decision(text: Column) -> Column:
    """Asked only of messages that are not corrections."""
    return any_of(F.lower(text), DECISIONS)


def message_kind(text: Column) -> Column:
    return F.when(is_correction(text), "UserCorrection").when(is_decision(text), "conversation_decision")


def decision_content(text: Column) -> Column:
    """The first line, cut to ``DECISION_BYTES`` before a character that would not fit."""
    line = first_line(text)
    raw = line.cast("binary")
    # A byte 10xxxxxx goes on with a character that began before it.
    begins = lambda at: ~F.hex(F.substring(raw, F.lit(at), F.lit(1))).rlike("^[89AB]")
    n = DECISION_BYTES
    cut = F.when(begins(n + 1), n).when(begins(n), n - 1).when(begins(n - 1), n - 2).otherwise(n - 3)
    return F.when(F.octet_length(line) > DECISION_BYTES, F.substring(raw, F.lit(1), cut).cast("string")).otherwise(line)


def message_content(text: Column) -> Column:
    """What is kept of a message: a correction whole, a decision's first line, nothing of others."""
    kind = message_kind(text)
    return F.when(kind == "UserCorrection", text).when(kind == "conversation_decision", decision_content(text))
