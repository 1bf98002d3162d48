"""Memories, commits, files, messages and vectors as views of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MEMORY_TYPES = ("decision", "feedback", "note", "session_summary", "security")
SOURCES = ("FileWatcher", "GitWatcher", "ConversationWatcher", "Manual", "Socket")
#: A table of fewer bytes a core, in fewer files than there are cores, is dealt to all cores, as its row groups may be fewer too; the shuffle is no larger than this for each core.
SMALL = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    rows, cores = spark.read.parquet(path), spark.sparkContext.defaultParallelism
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = folder.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(folder).getLength()
    return rows.repartition(cores) if size < SMALL * cores and len(rows.inputFiles()) < cores else rows


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, ts, user_id, message, files_changed)."""
    kind = F.col("event_type")
    number = lambda n: (F.col("event_id") % n).cast("string")
    message = (
        F.when(kind == "signup", F.concat(F.lit("feat(auth): Add JWT session for user "), F.col("user_id").cast("string")))
        .when(kind == "error", F.concat(F.lit("fix(storage): Resolve SQLite race k"), number(40)))
        .when(kind == "purchase", F.concat(F.lit("perf(billing): Tune Stripe and Redis cache "), number(25)))
        .when(kind == "view", F.lit("docs: update readme"))
        .otherwise(F.concat(F.lit("refactor(ui): move React view "), number(10)))
    )
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", message.alias("message"), (F.col("event_id") % 15).alias("files_changed"))


def file_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, ts, user_id, change, path)."""
    kind = F.col("event_type")
    change = F.when(kind == "signup", "create").when(kind == "error", "remove").otherwise("modify")
    names = F.array(*(F.lit(n) for n in ("main.rs", "app.ts", "notes.md", "Cargo.toml", "logo.png", "LICENSE", "settings.json")))
    folder = F.when(kind == "view", "target/out").otherwise(F.concat(F.lit("src/m"), (F.col("user_id") % 7).cast("string")))
    path = F.concat(folder, F.lit("/"), F.get(names, (F.col("event_id") % 7).cast("int")))
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", change.alias("change"), path.alias("path"))


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, timestamp, title, content, memory_type, tags, source, importance, metadata)."""
    types, sources = (F.array(*(F.lit(t) for t in names)) for names in (MEMORY_TYPES, SOURCES))
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        F.timestamp_add("MINUTE", F.col("doc_id") * 37, start).alias("timestamp"),
        F.left(F.substring_index("text", "\n", 1), F.lit(80)).alias("title"),
        F.col("text").alias("content"),
        F.get(types, (F.col("doc_id") % 5).cast("int")).alias("memory_type"),
        F.array("lang", "source").alias("tags"),
        F.get(sources, (F.col("doc_id") % 5).cast("int")).alias("source"),
        ((F.col("doc_id") * 37 % 100) / 100).cast("float").alias("importance"),
        F.concat(F.lit('{"n_chars":'), F.col("n_chars").cast("string"), F.lit("}")).alias("metadata"),
    )


_KINDS = (("DependencyAdded", "x/Cargo.toml"), ("FileCreated", "src/app.ts"), ("FileDeleted", "docs/a b.md"), ("FileModified", "src/app.ts"), ("UserCorrection", "wrong, redo it"), ("ErrorFixed", "was null"), ("SessionStart", ""), ("SessionEnd", ""), ("conversation_decision", "let's use Redis"), ("GitBranchCreated", "dev"))


def kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, kind, content): every kind of event but commits."""
    each = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(c).alias("content")) for k, c in _KINDS))
    return table(spark, sf_dir, "events").select("event_id", F.get(each, (F.col("event_id") % len(_KINDS)).cast("int")).alias("e")).select("event_id", "e.*")


def user_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, text) of the messages of users."""
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", "text")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding")


#: The same views in DuckDB's SQL.
COMMITS = """commits_v as (select event_id, ts, user_id, case event_type
    when 'signup' then 'feat(auth): Add JWT session for user ' || user_id
    when 'error' then 'fix(storage): Resolve SQLite race k' || (event_id % 40)
    when 'purchase' then 'perf(billing): Tune Stripe and Redis cache ' || (event_id % 25)
    when 'view' then 'docs: update readme'
    else 'refactor(ui): move React view ' || (event_id % 10) end as message, event_id % 15 as files_changed from events)"""
FILES = """files_v as (select event_id, ts, user_id, case event_type when 'signup' then 'create' when 'error' then 'remove' else 'modify' end as change,
    case event_type when 'view' then 'target/out' else 'src/m' || (user_id % 7) end || '/' ||
    (['main.rs', 'app.ts', 'notes.md', 'Cargo.toml', 'logo.png', 'LICENSE', 'settings.json'])[event_id % 7 + 1] as path from events)"""
MEMORIES = """memories_v as (select doc_id as id, timestamp '2024-01-01' + to_minutes(doc_id * 37) as timestamp, left(split_part(text, chr(10), 1), 80) as title,
    text as content, (['decision', 'feedback', 'note', 'session_summary', 'security'])[doc_id % 5 + 1] as memory_type, [lang, source] as tags, (['FileWatcher', 'GitWatcher', 'ConversationWatcher', 'Manual', 'Socket'])[doc_id % 5 + 1] as source, '{"n_chars":' || n_chars || '}' as metadata,
    cast((doc_id * 37 % 100) / 100 as float) as importance from documents)"""
KINDS = """kinds_v as (select event_id, (['DependencyAdded', 'FileCreated', 'FileDeleted', 'FileModified', 'UserCorrection', 'ErrorFixed', 'SessionStart', 'SessionEnd', 'conversation_decision', 'GitBranchCreated'])[event_id % 10 + 1] as kind from events)"""
