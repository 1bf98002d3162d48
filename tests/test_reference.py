"""The engine's own operators: known cases, plain-Python folds, streams against batches, SQL of the same rows."""

import glob
import json
import math
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import embedding, rendering, rules
from tidemark.operators import graph, report, scoring, search, similarity, store
from tidemark.plans import catalogue
from tidemark.shared.scratch import Scratch
from tidemark.sources import messages
from tidemark.streaming import ingest
from tidemark.streaming.jsonl_tail import JsonlTail, Range, TailReader


def one(spark, column, **values):
    """The value of an expression over one row of literals."""
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first()["x"]


# The messages, events, titles and texts of known cases below are given, with their results.
@pytest.mark.parametrize(
    ("message", "files", "want"),
    [
        ("feat(auth): Add JWT token refresh", 3, ("decision", 0.7, ["feature", "auth"])),
        ("fix: Resolve race condition", 1, ("note", 0.6, ["bugfix"])),
        ("docs: Update README", 1, None),
        ("fix: add retry", 1, ("decision", 0.7, ["bugfix"])),
        ("implement it all", 20, ("decision", 0.9, [])),
        ("whatever", 11, ("note", 0.6, [])),
    ],
)
def test_commits(spark, message, files, want):
    got = one(spark, rules.commit_memory(F.col("m"), F.col("n")), m=message, n=files)
    assert (got and (got.memory_type, round(got.importance, 5), got.tags)) == want


@pytest.mark.parametrize(
    ("kind", "content", "want"),
    [
        ("UserCorrection", "Don't use monolith architecture", ("User correction", "feedback", 0.9, ["feedback", "correction"])),
        ("ErrorFixed", "x", ("Error fixed", "note", 0.6, ["bugfix"])),
        ("SessionStart", "", ("Session started", "session_summary", 0.5, ["session"])),
        ("SessionEnd", "", ("Session ended", "session_summary", 0.5, ["session"])),
        ("FileModified", "a.py", None),
        ("FileCreated", "src/a.py", ("New file: a.py", "note", 0.5, [])),
        ("FileCreated", "a.md", None),
        ("FileDeleted", "a/b.md", ("Deleted: b.md", "note", 0.4, [])),
        ("DependencyAdded", "x/Cargo.toml", ("Dependency change: Cargo.toml", "decision", 0.6, ["dependency"])),
        ("conversation_decision", "use redis", ("Conversation decision", "decision", 0.7, ["decision", "conversation"])),
        ("GitBranchCreated", "x", None),
    ],
)
def test_events(spark, kind, content, want):
    got = one(spark, rules.classify(F.col("k"), F.col("c"), F.lit(None).cast("string"), F.lit(0)), k=kind, c=content)
    assert (got and (got.title, got.memory_type, round(got.importance, 5), got.tags)) == want


@pytest.mark.parametrize("text", ["decided: " + "é" * 150, "decided: " + "x" * 191, "decided: " + "x" * 192, "decided: " + "日" * 90, "decided " + "😀" * 70 + "\nmore", "decided\r\nmore", "x😀" + "decided" * 40])
def test_decisions_are_cut_between_characters(spark, text):
    line = text.split("\n")[0].rstrip("\r")
    while len(line.encode()) > 200:
        line = line[:-1]
    assert one(spark, rules.decision_content(F.col("t")), t=text) == line


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("не так, переделай авторизацию", "UserCorrection"),
        ("Stop, that's wrong", "UserCorrection"),
        ("нет, лучше используй PostgreSQL", "UserCorrection"),
        ("Добавь JWT авторизацию", None),
        ("покажи мне код", None),
        ("давай используем PostgreSQL", "conversation_decision"),
        ("Let's use Redis for caching", "conversation_decision"),
        ("Переходим на FastAPI", "conversation_decision"),
        ("что думаешь?", None),
        ("wrong " + "x" * 500, None),
    ],
)
def test_messages(spark, text, want):
    assert one(spark, rules.message_kind(F.col("t")), t=text) == want


def test_message_lines(spark):
    lines = [
        json.dumps({"type": "user", "message": {"role": "user", "content": "не так, переделай"}, "timestamp": "2024-01-01T00:00:00Z"}),
        json.dumps({"type": "user", "message": {"role": "user", "content": "ok"}}),
        json.dumps({"type": "assistant", "message": {"role": "assistant", "content": "a long enough answer"}}),
        json.dumps({"type": "user", "message": {"role": "user", "content": [{"type": "text", "text": "a long enough list"}]}}),
        '{"type": "user", "message": {"content": "broken',
        json.dumps({"type": "user", "message": {"content": "<system-reminder> not a user"}}),
    ]
    got = messages.user_messages(spark.createDataFrame([(x,) for x in lines], "line string")).collect()
    assert [(r.text, r.said_at) for r in got] == [("не так, переделай", "2024-01-01T00:00:00Z")]


def test_paths(spark):
    keep = rules.watched(F.col("p"), ("target/", "*.lock", "node_modules"), ("rs", "py"))
    cases = {"src/a.rs": True, "target/a.rs": False, "x.lock": False, "LICENSE": True, "a.txt": False, "node_modules/a.py": False}
    assert {p: one(spark, keep, p=p) for p in cases} == cases


def plain_embedding(text):
    words = [w for w in "".join(c if c.isalnum() or c in "_-" else " " for c in text.lower()).split() if len(w.encode()) >= 2]
    out = np.zeros(256)
    for token, weight in [(w, 1.0) for w in words] + [(f"{a} {b}", 0.5) for a, b in zip(words, words[1:], strict=False)]:
        for seed in range(4):
            h = (14695981039346656037 + seed * 6364136223846793005) % 2**64
            for byte in token.encode():
                h = (h ^ byte) * 1099511628211 % 2**64
            for shift, sign in ((0, 8), (16, 24)):
                out[(h >> shift) % 256] += (1 - 2 * (h >> sign & 1)) * weight / len(words)
    norm = np.linalg.norm(out)
    return out / norm if norm else out


def test_embeddings(spark):
    texts = ["Add JWT token refresh for authentication", "Add JWT token refresh for auth module", "Fix database migration script for PostgreSQL", "", "été à la plage, été", None]
    rows = embedding.with_embedding(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "text").orderBy("id").collect()
    vectors = [np.array(r.embedding) for r in rows]
    for v, t in zip(vectors, texts, strict=True):
        assert np.allclose(v, plain_embedding(t or ""), atol=1e-6)
    assert vectors[0] @ vectors[1] > 0.7 and vectors[0] @ vectors[2] < 0.5 and not vectors[3].any()
    held = embedding.from_bytes(embedding.with_bytes(spark.createDataFrame([([0.1, -0.5, 3.14, 0.0, -1.0],), (None,), ([],)], "e array<float>"), "e"), "bytes").collect()
    assert [(r.e, r.embedding) for r in held] == [(r.e, r.e) for r in held] and len(held[0].bytes) == 20
    assert embedding.from_bytes(spark.createDataFrame([(held[0].bytes + b"abc",)], "b binary"), "b").first().embedding == held[0].e
    assert one(spark, embedding.cosine(F.col("a"), F.col("b")), a=[1.0, 0.0], b=[0.0, 1.0]) == 0
    assert one(spark, embedding.cosine(F.col("a"), F.col("b")), a=[1.0, 0.0], b=[1.0]) == 0


@pytest.mark.parametrize(
    ("title", "tags", "names", "edge"),
    [
        ("feat(auth): Add JWT token refresh", [], {"auth", "jwt"}, ("jwt", "auth", "added_to")),
        ("Using PostgreSQL with Redis for caching", [], {"postgresql", "redis"}, ("postgresql", "redis", "co_mentioned")),
        ("Some change", ["auth", "security", "feature"], {"auth", "security"}, None),
        ("Fix scoring floor for new topics\n\n- falling through to Note=0.4 redis", [], set(), None),
        ("GardenBook migration", [], {"gardenbook"}, None),
        ("chore(deps): bump version of local branch commit", [], {"deps"}, None),
        ("use mongodb go and next.js, not gonext.js", [], {"mongodb", "next.js"}, ("next.js", "mongodb", "co_mentioned")),
        ("change", ["Redis", "API", "api", "Release", "v=1"], {"redis", "api"}, None),
        ("feat(ui): ui ui polish", [], {"polish"}, ("polish", "ui", "added_to")),
    ],
)
def test_entities(spark, title, tags, names, edge):
    rows = spark.createDataFrame([(title, tags)], "title string, tags array<string>")
    got = graph.extract(rows, graph.Vocabulary(projects=("gardenbook",))).first()
    assert names <= {e.name for e in got.entities} if edge and edge[2] == "added_to" else names == {e.name for e in got.entities}
    assert edge is None or edge in {tuple(e) for e in got.edges}


def test_entity_types(spark):
    """A tag's type goes by how it is written, a module's name must be valid, a null title names nothing."""
    rows = spark.createDataFrame([("redis GardenBook", ["Docker", "docker", "Elsewhere"], "a/src/storage/x.rs"), ("x", ["redis"], "src/lib/y.rs"), (None, None, None)], "title string, tags array<string>, path string")
    got = graph.extract(rows, graph.Vocabulary(projects=("gardenbook",)), "path").collect()
    assert [tuple(e) for e in got[0].entities] == [("redis", "tech"), ("gardenbook", "project"), ("storage", "module"), ("docker", "concept"), ("elsewhere", "concept")]
    assert [tuple(e) for e in got[1].entities] == [("redis", "tech")] and got[2].entities == [] == got[2].edges


def test_modules(spark):
    assert one(spark, graph.module_of(F.col("p")), p="src/storage/mod.rs") == "storage"
    assert one(spark, graph.module_of(F.col("p")), p="src/main.rs") is None
    assert one(spark, graph.scope_of(F.col("p")), p="feat(auth): Add JWT") == "auth"
    assert one(spark, graph.scope_of(F.col("p")), p="fix: Something") is None
    for word, good in {"bar": False, "log": False, "writes": False, "note=0.4": False, "auth": True, "postgresql": True}.items():
        assert one(spark, graph.valid(F.col("w"), graph.Vocabulary()), w=word) == good


def test_edge_weights_follow_calls(spark):
    rng = np.random.default_rng(5)
    calls = [(int(m), [("a", "b", "r")] * int(k)) for m, k in zip(rng.permutation(12), rng.integers(1, 4, 12), strict=True)]
    weights: dict[int, float] = {}
    for number, (m, found) in enumerate(calls):
        for _ in found:
            weights.setdefault(m, 1.0)
            for other in weights:
                if other != m:
                    weights[other] += 0.5
        assert number >= 0
    rows = spark.createDataFrame([(m, i, e) for i, (m, e) in enumerate(calls)], "id long, at long, edges array<struct<source:string,target:string,relation:string>>")
    got = {r.memory_id: r.weight for r in graph.edges(rows, "id", "at", Scratch(spark, "t")).collect()}
    assert got == weights


def test_graph_query(spark):
    rows = [(1, 1, "feat(auth): jwt"), (2, 2, "fix(auth): jwt and redis"), (3, 3, "docs: none")]
    found = graph.extract(spark.createDataFrame(rows, "id long, timestamp long, title string"))
    parts = graph.query("AUTH", graph.entities(found, "id", "timestamp"), graph.edges(found, "id", "timestamp", Scratch(spark, "t")), graph.links(found, "id"), found)
    assert [(r.name, r.mention_count) for r in parts["entity"].collect()] == [("auth", 2)]
    assert [(r.source, r.relation, r.memory_id, r.weight) for r in parts["edges"].collect()] == [("jwt", "added_to", 1, 1.0), ("jwt", "fixed_in", 2, 1.0), ("redis", "fixed_in", 2, 1.0)]
    assert [r.id for r in parts["memories"].collect()] == [2, 1] and [r.name for r in parts["neighbours"].collect()] == ["jwt", "redis"]
    nothing = graph.query("absent", graph.entities(found, "id", "timestamp"), graph.edges(found, "id", "timestamp", Scratch(spark, "t")), graph.links(found, "id"), found)
    assert all(part.count() == 0 for part in nothing.values())


def test_signals_and_text(spark):
    signal = scoring.signal(F.col("k"), F.col("t"))
    for kind, memory, want in [("UserCorrection", "note", 1.0), ("GitCommit", "decision", 0.6), ("FileCreated", "note", 0.4), ("ErrorFixed", "note", 0.8)]:
        assert one(spark, signal, k=kind, t=memory) == want
    assert scoring.W_FREQUENCY + scoring.W_RECENCY + scoring.W_SIGNAL == pytest.approx(1)
    assert one(spark, scoring.combine(F.lit(0.0), F.lit(0.0), F.lit(0.6))) == pytest.approx(0.45)
    assert one(spark, rendering.slug(F.col("t")), t="Add JWT auth") == "add-jwt-auth"
    assert one(spark, rendering.slug(F.col("t")), t="feat(api): implement OAuth") == "feat_api__-implement-oauth"
    text = one(spark, rendering.markdown(F.col("t"), F.lit("decision"), F.lit("2024-01-02").cast("timestamp_ntz"), F.array(F.lit("a")), F.lit(0.75), F.lit("body")), t='A "b"')
    assert text == "---\ntitle: \"A 'b'\"\ntype: decision\ndate: 2024-01-02\ntags: [a]\nimportance: 0.8\nsource: tidemark\n---\n\nbody\n"
    assert one(spark, rendering.tags_of(F.col("t")), t=" a, ,b ") == ["a", "b"]
    assert [one(spark, rendering.hours(F.col("h")), h=h) for h in (50.0, 3.5, 0.5)] == ["2d", "3h", "30m"]


def plain_fold(rows, policy):
    kept, out = [], {}
    for i, time, strength, vector in sorted(rows, key=lambda r: (r[1], r[0])):
        near = [(float(np.float32(v) @ np.float32(vector)), t) for v, t in reversed(kept if policy.history is None else kept[-policy.history :])]
        if near and max(s for s, _ in near) >= policy.dedup:
            out[i] = "deduped"
            continue
        f = min(1, sum(s >= 0.5 for s, _ in near[:100]) / 5)
        r = max((math.exp(-((time - t) // 60) / 60 / 24) for s, t in near[:50] if s >= 0.5), default=0)
        score = 0.3 * f + 0.3 * r + 0.4 * strength
        score = max(score, 0.75 * strength) if f == r == 0 else score
        out[i] = "saved" if min(score, 1) >= 0.4 - 1e-9 else "low_importance"
        if out[i] == "saved":
            kept.append((vector, time))
    return out


def fold_rows(spark, sf):
    rows = catalogue._classified(spark, sf).withColumn("strength", scoring.signal(F.lit("GitCommit"), F.col("memory_type")))
    rows = rows.select(F.col("event_id").alias("id"), (F.col("event_id") % 3).alias("project"), F.col("ts").alias("timestamp"), "strength", "title")
    return embedding.with_embedding(rows, "title").drop("title")


def test_fold(spark, sf):
    rows = fold_rows(spark, sf)
    got = {r.id: r.outcome for r in scoring.fold(rows, "project").collect()}
    want = {}
    for project in range(3):
        own = [(r.id, int(r.timestamp.timestamp()), r.strength, r.embedding) for r in rows.where(F.col("project") == project).collect()]
        want |= plain_fold(own, scoring.BATCH)
    assert got == want and len(set(got.values())) > 1


def test_fold_looks_back_at_all_kept_rows(spark):
    """An exact repeat is found behind 300 other rows, unless the policy forgets them."""
    rng = np.random.default_rng(0)
    vectors = [v / np.linalg.norm(v) for v in rng.normal(size=(300, 64))]
    vectors.append(vectors[0])
    rows = spark.createDataFrame([(i, 0, i, 1.0, v.tolist()) for i, v in enumerate(vectors)], "id long, project long, at long, strength double, embedding array<float>")
    rows = rows.withColumn("timestamp", F.timestamp_micros(F.col("at") * 3_600_000_000).cast("timestamp_ntz")).drop("at")
    outcome = lambda policy: {r.id: r.outcome for r in scoring.fold(rows, "project", policy).collect()}
    assert outcome(scoring.BATCH)[300] == "deduped" and set(list(outcome(scoring.BATCH).values())[:300]) == {"saved"}
    assert outcome(scoring.Policy(history=200))[300] == "saved" and outcome(scoring.Policy(history=301))[300] == "deduped"
    counts = {r.outcome: r.n for r in scoring.outcomes(scoring.fold(rows, "project"), rows.limit(7)).collect()}
    assert counts == {"saved": 300, "deduped": 1, "skipped": 7}


def test_dedup_in_rounds(spark, monkeypatch):
    """Against the greedy pass: chains of neighbours, equal and zero vectors, more rows than a block holds."""
    monkeypatch.setattr(similarity, "PAIR_BLOCK", 20)
    rng = np.random.default_rng(9)
    rows = []
    for key in range(2):
        v = rng.normal(size=8)
        for i in range(60):
            v = rng.normal(size=8) if rng.random() < 0.1 else v + rng.normal(size=8) * 0.25
            rows.append((key * 100 + i, key, int(rng.integers(0, 30)), v.astype(np.float32).tolist()))
        rows += [(key * 100 + 60 + i, key, i, rows[-1 - i][3]) for i in range(5)] + [(key * 100 + 70 + i, key, i, [0.0] * 8) for i in range(2)]
    df = spark.createDataFrame(rows, "id long, project long, at long, embedding array<float>").withColumn("timestamp", F.timestamp_micros(F.col("at") * 1_000_000).cast("timestamp_ntz")).drop("at")
    got = {r.id: r.outcome for r in scoring.keep_first(df, Scratch(spark, "t"), "project").collect()}
    kept, want = {0: [], 1: []}, {}
    for i, key, _, v in sorted(rows, key=lambda r: (r[2], r[0])):
        unit = np.array(v) / (np.linalg.norm(v) or 1)
        near = any(unit @ other >= 0.92 for other in kept[key])
        want[i] = "deduped" if near else "saved"
        kept[key] += [] if near else [unit]
    assert got == want and len(set(want.values())) == 2


def test_policies(spark):
    """Corrections pass as they are, saves keep what scores low, and a save by hand has a signal of its own."""
    rows = spark.createDataFrame([(1, 0, 0.4, [1.0, 0.0]), (2, 0, 0.4, [1.0, 0.0])], "id long, project long, strength double, embedding array<float>")
    rows = rows.withColumn("timestamp", F.lit("2024-01-01").cast("timestamp_ntz"))
    outcome = lambda policy: [r.outcome for r in scoring.fold(rows, "project", policy).orderBy("id").collect()]
    assert outcome(scoring.URGENT) == outcome(scoring.BACKFILL) == ["saved", "saved"]
    assert outcome(scoring.BATCH) == ["low_importance", "low_importance"] and outcome(scoring.SAVE) == ["saved", "deduped"]
    signal = scoring.signal(F.col("k"), F.lit("note"))
    assert one(spark, signal, k=scoring.BY_HAND) == 0.8 and one(spark, signal, k=scoring.BY_TOOL) == 0.4


def test_lanes(spark):
    events = spark.createDataFrame([("UserCorrection", "no"), ("GitCommit", "x"), ("ErrorFixed", "y")], "kind string, content string")
    urgent, other = ingest.lanes(events)
    assert [r.kind for r in urgent.collect()] == ["UserCorrection"] and other.count() == 2


def test_export_and_import(spark, sf, tmp_path):
    """All nine fields survive; rows without a time are kept, and the first row of an id in the file wins."""
    from tidemark.operators import store
    from tidemark.sources import adapters

    rows = adapters.memories(spark, sf).withColumn("id", F.col("id").cast("string"))
    back = store.imported(store.export(rows).withColumn("place", F.lit(0)))
    key = lambda df: sorted((tuple(str(r[c]) for c in store.EXPORTED) for r in df.select(*store.EXPORTED).collect()))
    assert key(back) == key(rows) and back.count() == 200
    lines = ['{"id": "a", "title": "t", "tags": "[\\"x\\"]"}', '{"id": "a", "title": "u", "timestamp": "2024-01-02T00:00:00+00:00"}', '{"id": "b", "content": "c"}', "{}"]
    got = store.import_new(store.imported(spark.createDataFrame([(x, i) for i, x in enumerate(lines)], "json string, place int")), spark.createDataFrame([("c",)], "id string"))
    assert {(r.id, r.title, r.content, r.memory_type, tuple(r.tags), r.source) for r in got.collect()} == {("a", "t", None, "note", ("x",), "manual"), ("b", None, "c", "note", (), "manual"), ("", None, None, "note", (), "manual")}


def test_stored_index_equals_scan(spark, tmp_path):
    rows = spark.createDataFrame([(1, "Café ÜBER snake_case uber cafe", "x"), (2, "cafe latte uber", "y cafe"), (3, "other", "z"), (4, None, "cafe"), (5, "cafe cafe uber cafe uber", "")], "id long, a string, b string")
    search.write_index(rows, "id", ("a", "b"), str(tmp_path / "index"))
    T, M = search.Term, search.Match
    for match in (M(all_of=(T("cafe"),)), M(all_of=(T("cafe uber"),)), M(any_of=(T("lat", prefix=True), T("snake"))), M(all_of=(T("cafe", column="b"),)), M(all_of=(T("uber"),), none_of=(T("latte"),)), M(all_of=(T("cafe ub", prefix=True),), any_of=(T("nothing"), T("uber cafe")))):
        want = [(r.id, round(r.score, 9)) for r in search.search(rows, match, "id", ("a", "b"), 10).collect()]
        got = [(r.id, round(r.score, 9)) for r in search.lookup(spark, str(tmp_path / "index"), match, "id", 10).collect()]
        assert got == want


def test_one_clock(spark):
    from datetime import datetime

    from tidemark.operators.sequences import throttle

    events = spark.createDataFrame([(i, f"2024-01-01 00:00:{s:02d}") for i, s in enumerate((0, 1, 2, 3, 5, 9))], "event_id long, at string").select("event_id", F.to_timestamp_ntz("at").alias("ts"))
    assert [r.event_id for r in throttle(events, None, 2).orderBy("event_id").collect()] == [0, 2, 4, 5]
    assert [r.event_id for r in throttle(events, None, 2, datetime(2024, 1, 1)).orderBy("event_id").collect()] == [2, 4, 5]


def test_report_file(spark, sf, tmp_path):
    from tidemark.operators import report, sinks

    entries = catalogue.context_report(spark, sf)
    report.write(entries, str(tmp_path / "r"))
    text = "".join(open(f).read() for f in glob.glob(str(tmp_path / "r" / "*.txt")))
    assert text == "\n".join(r.text for r in sorted(entries.collect(), key=lambda r: (r.part, r.place))) + "\n"
    assert text.startswith("# Tidemark Context\n\n_Auto-generated: 2024-01-31 00:00 UTC_\n\n## Key Decisions\n\n- **")
    assert "\n\n## User Feedback (DO NOT repeat these mistakes)\n\n- **" in text and "\n\n## Recent Activity\n\n- [" in text and text.endswith("edges_\n\n---\n_Total memories: 200 | Generated by tidemark_\n")
    none = report.context(spark.createDataFrame([], "id long, timestamp timestamp_ntz, title string, content string, memory_type string, tags array<string>, importance float"), spark.createDataFrame([], "name string, entity_type string, mention_count long, neighbours string"), spark.createDataFrame([(0, 0)], "n_entities long, n_edges long"), catalogue._now())
    assert [r.text.strip().split("\n")[0] for r in none.orderBy("part", "place").collect()] == ["# Tidemark Context", "---"]
    assert sinks.project_folder("/base/", "/home/me/x") == "/base/-home-me-x/memory"


def test_stream_equals_batch(spark, sf, tmp_path):
    rows = fold_rows(spark, sf).cache()
    want = {(r.id, r.outcome) for r in scoring.fold(rows, "project").collect()}
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", "ts")
    from tidemark.operators.sequences import throttle

    kept = {r.event_id for r in throttle(events, "user_id", 6 * 3600).collect()}
    cuts = rows.selectExpr("percentile_approx(timestamp, array(0.3, 0.7)) as c").first()["c"]
    for name, table, when in (("rows", rows, "timestamp"), ("events", events, "ts")):
        parts = [F.col(when) <= cuts[0], (F.col(when) > cuts[0]) & (F.col(when) <= cuts[1]), F.col(when) > cuts[1]]
        for i, part in enumerate(parts):
            table.where(part).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
            for f in glob.glob(str(tmp_path / name / "*.parquet")):
                os.utime(f, (1e9 + i, 1e9 + i)) if os.path.getmtime(f) > 2e9 - 1 or os.path.getmtime(f) > 1.1e9 else None
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "rows"))
    ingest.into_table(ingest.stateful_fold(stream, "project"), str(tmp_path / "out"), str(tmp_path / "c1"), every=None).awaitTermination()
    got = {(r.id, r.outcome) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == want
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "events"))
    ingest.into_table(ingest.throttled(stream, "user_id", 6 * 3600), str(tmp_path / "out2"), str(tmp_path / "c2"), every=None).awaitTermination()
    assert {r.event_id for r in spark.read.parquet(str(tmp_path / "out2")).collect()} == kept


def test_tail_of_growing_files(spark, tmp_path):
    spark.dataSource.register(JsonlTail)
    (tmp_path / "in" / "p").mkdir(parents=True)
    file = tmp_path / "in" / "p" / "a.jsonl"
    seen = []
    for number, text in enumerate(['{"n": 1}\n{"n": 2}\n{"n"', ": 3}\n", '{"n": 4}\n']):
        with file.open("a") as f:
            f.write(text)
        rows = spark.readStream.format("jsonl_tail").option("from_start", "true").load(str(tmp_path / "in"))
        query = rows.writeStream.foreachBatch(lambda b, _: seen.append([json.loads(r.line)["n"] for r in b.collect()])).option("checkpointLocation", str(tmp_path / "c")).trigger(once=True).start()
        query.awaitTermination(120)
        query.stop()
        assert number >= 0
    assert [x for b in seen for x in b] == [1, 2, 3, 4]


def _tail(spark, tmp_path, seen, **options):
    """One batch of the tail's stream, by a query that starts anew; options are the source's."""
    rows = spark.readStream.format("jsonl_tail").options(from_start="true", **options).load(str(tmp_path / "in"))
    query = rows.writeStream.foreachBatch(lambda b, _: seen.append([json.loads(r.line)["n"] for r in b.collect()])).option("checkpointLocation", str(tmp_path / "c")).trigger(once=True).start()
    query.awaitTermination(120)
    query.stop()


def test_tail_takes_bounded_batches(spark, tmp_path):
    """A backlog in batches within the bound, a longer line by itself, no line lost or read twice, each batch by a restarted query."""
    spark.dataSource.register(JsonlTail)
    for name in "ab":
        (tmp_path / "in" / name).mkdir(parents=True)
    lines = [json.dumps({"n": n, "pad": "x" * (900 if n == 7 else n % 5)}) for n in range(40)]
    (tmp_path / "in" / "a" / "a.jsonl").write_text("\n".join(lines[:25]) + "\n")
    (tmp_path / "in" / "b" / "b.jsonl").write_text("\n".join(lines[25:]) + "\n" + '{"n": 40')
    seen, most = [], 400
    for _ in range(7):
        _tail(spark, tmp_path, seen, max_bytes=str(most), checkpoint=str(tmp_path / "c"))
    assert sorted(n for b in seen for n in b) == list(range(40)) and len(seen) > 3
    assert all(sum(len(lines[n]) + 1 for n in b) <= most or b == [7] for b in seen) and [7] in seen
    with pytest.raises(Exception, match="checkpoint"):
        _tail(spark, tmp_path, seen, max_bytes="9")


def test_tail_of_shortened_files(spark, tmp_path):
    """A file that was begun anew is read again; a planned range that is gone ends with an error or is left out."""
    spark.dataSource.register(JsonlTail)
    (tmp_path / "in" / "p").mkdir(parents=True)
    file, seen = tmp_path / "in" / "p" / "a.jsonl", []
    for text in ('{"n": 1}\n{"n": 2}\n', '{"n": 3}\n', '{"n": 3}\n{"n": 4}\n{"n": 5}\n'):
        file.write_text(text)
        _tail(spark, tmp_path, seen, checkpoint=str(tmp_path / "c"))
    assert [n for b in seen for n in b] == [1, 2, 3, 4, 5]
    gone = Range(str(file), 10, 500)
    assert [json.loads(line)["n"] for _, line in TailReader(str(tmp_path / "in"), True, strict=False).read(Range(str(file), 9, 500))] == [4, 5]
    with pytest.raises(OSError, match="shorter"):
        list(TailReader(str(tmp_path / "in"), True).read(gone))
    assert list(TailReader(str(tmp_path / "in"), True, strict=False).read(Range(str(file), 400, 500))) == []


def test_search_terms(spark):
    rows = spark.createDataFrame([(1, "Café ÜBER snake_case", "x"), (2, "cafe latte uber", "y cafe"), (3, "other", "z")], "id long, a string, b string")
    ids = lambda m: [r.id for r in search.search(rows, m, "id", ("a", "b"), 10).orderBy("id").collect()]
    assert ids(search.Match(all_of=(search.Term("cafe"),))) == [1, 2]
    assert ids(search.Match(all_of=(search.Term("cafe uber"),))) == [1]
    assert ids(search.Match(any_of=(search.Term("lat", prefix=True), search.Term("snake")))) == [1, 2]
    assert ids(search.Match(all_of=(search.Term("cafe", column="b"),))) == [2]
    assert ids(search.Match(all_of=(search.Term("uber"),), none_of=(search.Term("latte"),))) == [1]
    with pytest.raises(ValueError):
        search.Match()


def test_near_recalls_all(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    x[7] = 0
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in similarity.near(rows, rows.where("vec_id < 20"), "vec_id", k=4).collect():
        got.setdefault(r.query, set()).add(r.id)
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    s = unit @ unit.T
    np.fill_diagonal(s, -2)
    s[:, 7] = -2
    assert 7 not in got and all(got[i] == set(np.argsort(-s[i])[:4].tolist()) for i in range(20) if i != 7)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_sql_gives_the_same_rows(spark, sf, name):
    db = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        db.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    got, want = catalogue.QUERIES[name](spark, sf), db.sql(catalogue.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    clean = lambda v: round(v, 6) if isinstance(v, float) else v
    order = [want.columns.index(c) for c in sorted(want.columns)]
    a = sorted((tuple(clean(r[c]) for c in sorted(got.columns)) for r in got.collect()), key=repr)
    b = sorted((tuple(clean(r[i]) for i in order) for r in want.fetchall()), key=repr)
    assert a == b and (a or name == "corrections")


def test_import_of_bad_times(spark):
    """A line whose time doesn't exist is imported like any other, with no time, and the first line of an id is."""
    lines = [(f'{{"id": "{i}", "timestamp": "{t}", "title": "{p}", "tags": "[]"}}', p) for p, (i, t) in enumerate([("a", "2024-02-29T00:29:00+00:00"), ("a", "1999-02-29T00:29:00+00:00"), ("b", "1999-02-29T00:29:00+00:00"), ("c", "soon"), ("d", "1999-02-28T00:29:00.5Z")])]
    rows = store.imported(spark.createDataFrame(lines, "json string, place long"))
    got = {r.id: (r.title, str(r.timestamp)) for r in store.import_new(rows, spark.createDataFrame([], "id string")).collect()}
    assert got == {"a": ("0", "2024-02-29 00:29:00"), "b": ("2", "None"), "c": ("3", "None"), "d": ("4", "1999-02-28 00:29:00.500000")}


def test_topic_ages(spark):
    """Whole days, of memories younger than a day and of times yet to come too, as the SQL of ``topic_report`` has them."""
    now = F.lit(catalogue.NOW).cast("timestamp_ntz")
    minutes = [0, 59, 61, 1439, 1440, 2879, -1, -1348, -1440, -229046]
    rows = spark.createDataFrame(list(enumerate(minutes)), "id long, m long").select("id", F.timestamp_add("MINUTE", -F.col("m"), now).alias("timestamp"), F.lit("note").alias("memory_type"), F.lit("t").alias("title"), F.lit("c").alias("content"), F.array(F.lit("x")).alias("tags"))
    found = rows.select("id", F.lit(0.5).alias("similarity"), F.lit(0).alias("source"), F.lit(0.5).alias("rank"))
    told = [r[0] for r in duckdb.sql(f"select (m // 1440) || 'd ago' from (select unnest({minutes})::bigint as m, unnest(range({len(minutes)})) as i) order by i").fetchall()]
    assert [r.age for r in report.topic(found, rows, now, rendering.days).orderBy("id").collect()] == told
    assert [r.age for r in report.topic(found, rows, now).orderBy("id").collect()][:3] == ["0m ago", "59m ago", "1h ago"]


def test_files_config_and_listings(spark, sf, tmp_path):
    from tidemark import config
    from tidemark.operators import sinks
    from tidemark.sources import adapters, listing

    rows = adapters.memories(spark, sf)
    files = sinks.vault_files(rows)
    first = listing.listing(spark, f"file://{sf}")
    n = sinks.write_files(files, f"file://{tmp_path}/notes")
    assert n == files.count() == len(os.listdir(tmp_path / "notes")) > 0
    after = listing.listing(spark, str(tmp_path / "notes"))
    assert listing.stored_bytes(spark, str(tmp_path / "notes")) == sum(os.path.getsize(tmp_path / "notes" / f) for f in os.listdir(tmp_path / "notes"))
    found = listing.changes(first, after).groupBy("change").count().collect()
    assert {r["change"]: r["count"] for r in found} == {"create": n, "remove": first.count()}
    assert listing.changes(after, after).count() == 0
    assert listing.doctor(spark, sf, ("documents.parquet", "nothing.parquet")) == {"documents.parquet": True, "nothing.parquet": False}
    (tmp_path / "c.toml").write_text("[retention]\ndays = 7\n[watch]\nignore = ['x/']\n")
    assert config.load(str(tmp_path / "c.toml")).retention == config.Retention(days=7) and config.load().intake.dedup_threshold == 0.92
    (tmp_path / "c.toml").write_text("[retention]\nyears = 7\n")
    with pytest.raises(ValueError):
        config.load(str(tmp_path / "c.toml"))
    own = config.Config(watch=config.Watch(ignore=('a"b', "é"), debounce_ms=7), output=config.Output(vault_files=True))
    config.save(own, str(tmp_path / "c.toml"))
    assert config.load(str(tmp_path / "c.toml")) == own
    (tmp_path / "i.json").write_text(json.dumps([{"id": "a", "title": "t", "tags": '["x"]', "timestamp": "2024-01-01"}, {"id": "a", "title": "u", "tags": "bad", "timestamp": "2024-01-02"}]))
    from tidemark.operators import store

    new = store.import_new(store.with_defaults(listing.read_import(spark, str(tmp_path / "i.json"))), spark.createDataFrame([("b",)], "id string")).collect()
    assert [(r.id, r.title, r.tags, r.memory_type, r.source) for r in new] == [("a", "t", ["x"], "note", "manual")]
