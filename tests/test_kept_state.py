"""Stored tables, indexes and counters against rebuilding, and parallel forms against the plain ones."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import graph, graph_state, scoring, search, sequences, similarity, stored, top_search, vector_index
from tidemark.shared.scratch import Scratch

ROW = "id long, content string, rank int"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_stored_table_keeps_the_last_batch(spark, tmp_path):
    frame = lambda rows: spark.createDataFrame(rows, ROW)
    table = stored.StoredTable(spark, str(tmp_path / "t"), frame([]).schema, "id", 4)
    assert table.read().count() == 0
    first = frame([(1, "a", 1), (1, "b", 2), (2, "c", 1), (None, "n", 1), (3, None, 1)])
    table.upsert(first, 0, ["rank"])
    assert rows_of(table.read()) == sorted([(1, "b", 2), (2, "c", 1), (None, "n", 1), (3, None, 1)], key=str)
    table.upsert(frame([(2, "d", 0), (4, "e", 1), (None, "m", 0)]), 1)
    table.delete(frame([(1, "", 0), (9, "", 0)]), 2)
    want = sorted([(2, "d", 0), (4, "e", 1), (None, "m", 0), (3, None, 1)], key=str)
    assert rows_of(table.read()) == want
    for number, batch in ((0, first), (1, frame([(2, "d", 0), (4, "e", 1), (None, "m", 0)]))):
        table.upsert(batch, number, ["rank"])  # repeated, and late
        assert rows_of(table.read()) == want
    table.upsert(frame([(1, "again", 5)]), 3)
    table.upsert(frame([]), 4)
    assert rows_of(table.find(1, 4, 7)) == [(1, "again", 5), (4, "e", 1)]
    assert [f.name for f in table.schema.fields] == ["id", "content", "rank"]


def test_a_batch_rewrites_its_own_parts_only(spark, tmp_path):
    table = stored.StoredTable(spark, str(tmp_path / "t"), spark.createDataFrame([], ROW).schema, "id", 16)
    table.upsert(spark.range(200).select("id", F.lit("x").alias("content"), F.lit(0).alias("rank")), 0)
    files = lambda: {f: f.stat().st_mtime_ns for f in (tmp_path / "t").rglob("*.parquet")}
    before = files()
    table.upsert(spark.createDataFrame([(7, "y", 1)], ROW), 1)
    gone = {f.parent.name for f in before.keys() - files().keys()}
    assert len(gone) == 1 and len({f.parent.name for f in before}) == 16 and table.find(7).first().content == "y"


def test_live_index_equals_a_rebuilt_one(spark, tmp_path):
    rng = np.random.default_rng(1)
    words = ["cafe", "uber", "latte", "tea", "milk", "Über", "snake"]
    text = lambda: " ".join(rng.choice(words, rng.integers(0, 9)))
    frame = lambda rows: spark.createDataFrame(rows, "id long, a string, b string")
    index = stored.LiveIndex(spark, str(tmp_path / "i"), frame([]).schema, "id", ("a", "b"), 4)
    now = {}
    T, M = search.Term, search.Match
    matches = (M(any_of=(T("cafe"), T("tea"))), M(all_of=(T("cafe uber"),)), M(all_of=(T("lat", prefix=True),), none_of=(T("milk"),)), M(all_of=(T("uber", column="b"),)))

    def check():
        rows = frame([(i, *v) for i, v in now.items()])
        assert rows_of(index.read()) == rows_of(rows)
        for match in matches:
            want = [(r.id, round(r.score, 9)) for r in search.search(rows, match, "id", ("a", "b"), 8).collect()]
            assert [(r.id, round(r.score, 9)) for r in index.search(match, 8).collect()] == want

    for number in range(3):
        batch = {int(i): (text(), text() if i % 4 else None) for i in rng.choice(30, 14, replace=False)}
        index.upsert(frame([(i, *v) for i, v in batch.items()]), 2 * number)
        gone = [int(i) for i in rng.choice(30, 5, replace=False)]
        index.delete(spark.createDataFrame([(i,) for i in gone], "id long"), 2 * number + 1)
        now = {i: v for i, v in (now | batch).items() if i not in gone}
    check()
    index.merge(5)
    assert {f.parent.name for f in (tmp_path / "i" / "postings").rglob("*.parquet")} == {"run=5"}
    index.upsert(frame([(3, "cafe latte", "tea")]), 6)
    now[3] = ("cafe latte", "tea")
    check()


def test_top_search_reads_few_bands(spark, tmp_path):
    """The rows of a search through everything, from a part of the bands."""
    rng = np.random.default_rng(3)
    words = np.array([f"w{i}" for i in range(200)])
    share = 1 / np.arange(1, 201)
    texts = [" ".join(rng.choice(words, rng.integers(0, 120), p=share / share.sum())) for _ in range(1500)]
    rows = spark.createDataFrame([(i, t, "w7 extra" if i % 50 == 0 else None) for i, t in enumerate(texts)], "id long, a string, b string")
    top_search.write_bands(rows, "id", ("a", "b"), str(tmp_path / "i"), 24)
    T, M = search.Term, search.Match
    read = []
    for match in (M(any_of=(T("w3"), T("W40"))), M(all_of=(T("w1"), T("w9"))), M(all_of=(T("w20"),), any_of=(T("w2"), T("w90")), none_of=(T("w1"),)), M(any_of=(T("nothing"), T("extra"))), M(all_of=(T("nothing"),))):
        for n in (1, 10, 2000):
            found = top_search.TopSearch(spark, str(tmp_path / "i"), match, "id", n)
            got = [(r.id, round(r.score, 9)) for r in found.run().collect()]
            assert got == [(r.id, round(r.score, 9)) for r in search.search(rows, match, "id", ("a", "b"), n).collect()]
            if n == 10 and len(got) == n:
                read.append(len(found.read) / len(found.bands()))
    assert min(read) < 0.5
    plan = found.rows.where(F.col("band").isin(1, 2))._jdf.queryExecution().executedPlan().toString()
    assert "In(band, [1,2])" in plan and "term" in plan.split("PushedFilters")[1].split("ReadSchema")[0]
    with pytest.raises(ValueError):
        top_search.TopSearch(spark, str(tmp_path / "i"), M(all_of=(T("two words"),)), "id", 3)


def test_graph_state_repeats_and_interleaves(spark, tmp_path):
    titles = ["feat(auth): Add JWT session", "fix(auth): Resolve Redis race in session", "feat(cache): Redis and JWT and Docker", "docs: nothing", None]
    start = datetime(2024, 1, 1)
    rows = [(i, start + timedelta(minutes=i), titles[i % 5], ["redis"] if i % 3 else None) for i in range(60)]
    found = graph.extract(spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, title string, tags array<string>"))
    state = graph_state.GraphState(spark, str(tmp_path / "g"), "event_id", "ts")
    for number in (0, 1, 1, 2, 0):
        state.add(found.where((F.col("event_id") >= 20 * number) & (F.col("event_id") < 20 * number + 20)), number)
    whole = graph.edges(found, "event_id", "ts", Scratch(spark, "edges"))
    assert rows_of(state.entities()) == rows_of(graph.entities(found, "event_id", "ts"))
    assert rows_of(state.edges()) == rows_of(whole)
    linked = graph.links(found, "event_id").join(found.select(F.col("event_id").alias("memory_id"), F.col("ts").alias("timestamp")), "memory_id")
    graph_state.write_adjacency(str(tmp_path / "a"), state.entities(), whole, linked)
    memories = found.select(F.col("event_id").alias("id"), F.col("ts").alias("timestamp"))
    for name in ("JWT", "redis", "nothing"):
        want = graph.query(name, graph.entities(found, "event_id", "ts"), whole, graph.links(found, "event_id"), memories, 5)
        got = graph_state.query(spark, str(tmp_path / "a"), name, 5)
        for part in ("entity", "edges", "memories", "neighbours"):
            columns = sorted(got[part].columns if part != "neighbours" else ["name", "entity_type", "mention_count"])
            assert [tuple(r) for r in got[part].select(columns).collect()] == [tuple(r) for r in want[part].select(columns).collect()]
    plan = graph_state.neighbours(spark, str(tmp_path / "a"), "jwt")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(name,jwt)" in plan


def vectors(spark, n, d=16, seed=0, groups=12):
    rng = np.random.default_rng(seed)
    centers = rng.normal(0, 1, (groups, d))
    made = centers[rng.integers(0, groups, n)] + rng.normal(0, 0.6, (n, d))
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(made)], "vec_id long, embedding array<float>")


def test_vector_index_recall_and_upkeep(spark, tmp_path):
    rows = vectors(spark, 1500)
    odd = spark.createDataFrame([(2000, None), (2001, [0.0] * 16)], rows.schema)
    index = vector_index.build(rows.where("vec_id < 1200").unionByName(odd), str(tmp_path / "v"))
    assert 1 <= index.probes < len(index.centroids) // 2
    vector_index.append(index, rows.where("vec_id >= 1200"))
    index = vector_index.load(spark, str(tmp_path / "v"))
    asked = rows.where("vec_id % 20 = 0")
    exact = {(r.query, r.id) for r in similarity.near(rows, asked, "vec_id", k=10).collect()}
    found = vector_index.search(index, asked, 10)
    assert len({(r.query, r.id) for r in found.collect()} & exact) >= 0.9 * len(exact)
    one = vector_index.search(index, rows.where("vec_id = 5"), 10)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert f"list#" in plan and "PartitionFilters: [list#" in plan
    # All lists are the exact search.
    every = vector_index.search(index, asked, 10, probes=len(index.centroids))
    assert {(r.query, r.id) for r in every.collect()} == exact
    assert vector_index.search(vector_index.build(rows.where("false"), str(tmp_path / "none")), asked, 3).count() == 0


@pytest.mark.parametrize("k", [4, None])
def test_few_and_many_queries_agree(spark, monkeypatch, k, tmp_path):
    rows = vectors(spark, 300).unionByName(spark.createDataFrame([(1000, [0.0] * 16), (1001, None)], "vec_id long, embedding array<float>"))
    rows = rows.unionByName(rows.where("vec_id < 9").withColumn("vec_id", F.col("vec_id") + 500))  # ties
    asked = rows.where("vec_id % 7 = 0 or vec_id >= 1000")
    index = vector_index.build(rows, str(tmp_path / "v"), lists=9)
    shown = lambda df: sorted((r.query, r.id, round(r.similarity, 6)) for r in df.collect())
    few, listed = shown(similarity.near(rows, asked, "vec_id", k=k, least=0.3)), shown(vector_index.search(index, asked, 4, probes=3))
    monkeypatch.setattr(similarity, "FEW", 0)
    monkeypatch.setattr(similarity, "DATA_BLOCK", 40)
    assert shown(similarity.near(rows, asked, "vec_id", k=k, least=0.3)) == few and few
    assert shown(vector_index.search(index, asked, 4, probes=3)) == listed and listed


def test_blocks_are_not_broadcast(spark, monkeypatch, tmp_path):
    """Many queries meet the data by a merge join, however small the sides look."""
    monkeypatch.setattr(similarity, "FEW", 0)
    rows = vectors(spark, 300)
    index = vector_index.build(rows, str(tmp_path / "v"), lists=9)
    for found in (similarity.near(rows, rows.where("vec_id % 7 = 0"), "vec_id", k=4), vector_index.search(index, rows.where("vec_id % 7 = 0"), 4)):
        found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_pivots_leave_out_blocks_and_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(similarity, "PAIR_BLOCK", 20)
    rng = np.random.default_rng(11)
    centers = rng.normal(0, 1, (10, 24))
    made = centers[rng.integers(0, 10, 500)] + rng.normal(0, 0.1, (500, 24))
    made[::100] = 0
    groups = [None if i % 90 == 0 else "large" if i % 5 else f"g{i % 3}" for i in range(500)]
    rows = spark.createDataFrame([(i, groups[i], [float(x) for x in made[i]]) for i in range(500)] + [(900, "large", None)], "id long, project string, embedding array<float>")
    size = np.linalg.norm(made.astype(np.float32).astype(float), axis=1)
    cosine = (made @ made.T) / np.maximum(np.outer(size, size), 1e-12)
    for least in (0.97, 0.5):
        got = {(r.group, r.a, r.b) for r in similarity.pairs_within(rows, Scratch(spark, "pairs"), "project", "id", least).collect()}
        want = {(groups[a], a, b) for a in range(500) for b in range(a + 1, 500) if groups[a] and groups[a] == groups[b] and cosine[a, b] >= least}
        assert got == want
    numbers = similarity.pair_blocks(rows, Scratch(spark, "pairs"), "project", "id", "embedding").select("group", "cell", "low", "high")
    every, left = (similarity.block_pairs(numbers, least).where("group = 'large'").count() for least in (-1.0, 0.97))
    assert left < 0.5 * every
    none = rows.where("false")
    assert similarity.pairs_within(none, Scratch(spark, "pairs"), "project", "id", 0.9).count() == 0


@pytest.mark.parametrize("policy", [scoring.BATCH, scoring.SAVE, scoring.URGENT, scoring.Policy(0.8, history=5), scoring.Policy(None), scoring.Policy(0.9, score=False, threshold=None)])
def test_fold_in_blocks_equals_the_fold(spark, policy):
    rng = np.random.default_rng(7)
    base = rng.normal(0, 1, (30, 8))
    made = base[rng.integers(0, 30, 400)] + rng.normal(0, 0.25, (400, 8)) * rng.integers(0, 2, (400, 1))
    made = made / np.linalg.norm(made, axis=1, keepdims=True)
    made[::50] = 0
    at = np.sort(rng.integers(0, 60 * 24 * 9, 400))
    start = datetime(2024, 1, 1)
    rows = [(i, None if i % 9 == 0 else "one key" if i % 3 else f"k{i % 4}", start + timedelta(minutes=int(at[i])), float(rng.choice([0.4, 0.6, 1.0])), [float(x) for x in made[i]]) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, user_id string, timestamp timestamp_ntz, strength double, embedding array<float>")
    want = {r.id: (r.user_id, r.outcome, r.score and round(r.score, 9)) for r in scoring.fold(df, "user_id", policy).collect()}
    got = {r.id: (r.user_id, r.outcome, r.score and round(r.score, 9)) for r in scoring.fold_in_blocks(df, "user_id", Scratch(spark, "fold"), policy, 16).collect()}
    assert got == want and len({o for _, o, _ in want.values()}) >= (1 if policy.dedup is None else 2)
    assert scoring.fold_in_blocks(df.where("false"), "user_id", Scratch(spark, "fold")).count() == 0


def test_fold_in_blocks_compares_a_vector_once(spark):
    """However often a vector comes, a row holds a bit for each different one; rows between two of a vector's are seen by the second."""
    rng = np.random.default_rng(3)
    base = rng.normal(0, 1, (40, 16)) + 0.6
    base = base / np.linalg.norm(base, axis=1, keepdims=True)
    start = datetime(2024, 1, 1)
    rows = [(i, "k", start + timedelta(minutes=i * 7), 0.4 if i % 2 else 0.6, [float(x) for x in base[rng.integers(0, min(40, 1 + i // 20))]]) for i in range(1500)]
    df = spark.createDataFrame(rows, "id long, user_id string, timestamp timestamp_ntz, strength double, embedding array<float>")
    for policy in (scoring.BATCH, scoring.Policy(0.95, threshold=0.6, history=7), scoring.Policy(None, threshold=0.5)):
        scratch = Scratch(spark, "fold")
        want = {r.id: (r.outcome, r.score and round(r.score, 9)) for r in scoring.fold(df, "user_id", policy).collect()}
        assert {r.id: (r.outcome, r.score and round(r.score, 9)) for r in scoring.fold_in_blocks(df, "user_id", scratch, policy, 16).collect()} == want
        looks = spark.read.parquet(f"{scratch.path}/looks")
        assert looks.count() <= 40 * 3 and looks.agg(F.max(F.octet_length("similar") + F.octet_length("repeats"))).first()[0] <= 4


def greedy(times, gap, last=None):
    out = []
    for t in sorted(times):
        if last is None or t - last >= gap:
            out.append(t)
            last = t
    return out


@pytest.mark.parametrize(("gap", "start"), [(1, None), (7, None), (60, 3), (500, None), (100_000, None), (60, 10_000)])
def test_one_clock_in_ranges(spark, gap, start):
    rng = np.random.default_rng(gap)
    seconds = np.concatenate([rng.integers(0, 900, 300), np.full(80, 400), rng.integers(5_000, 5_050, 60)])
    zero = datetime(2024, 1, 1)
    rows = [(i, zero + timedelta(seconds=int(s)), f"e{i}") for i, s in enumerate(seconds)] + [(999, None, "no time")]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, name string")
    got = sequences.throttle(events, None, gap, None if start is None else zero + timedelta(seconds=start)).collect()
    assert sorted(int((r.ts - zero).total_seconds()) for r in got) == greedy(seconds.tolist(), gap, start)
    firsts = {s: f"e{i}" for i, s in reversed(list(enumerate(seconds.tolist())))}
    assert all(r.name == firsts[int((r.ts - zero).total_seconds())] for r in got)
    plan = sequences.throttle(events, None, gap)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan.split("BroadcastExchange")[0]
    keyed = events.withColumn("key", F.when(F.col("event_id") % 3 > 0, "k"))
    by_key = sequences.throttle(keyed, "key", gap).collect()
    for k in (None, "k"):
        own = [int(s) for i, s in enumerate(seconds) if (i % 3 > 0) == (k == "k")]
        assert sorted(int((r.ts - zero).total_seconds()) for r in by_key if r.key == k) == greedy(own, gap)


def test_whole_intake(spark, sf, tmp_path):
    """Urgent events pass, a failing sink is noted and holds up nothing, a restarted query adds nothing, a repeated batch replaces itself."""
    from tidemark.functions.embedding import with_embedding
    from tidemark.streaming import intake
    from tidemark.streaming.ingest import classified

    start = datetime(2024, 1, 1)
    texts = ["feat(auth): Add JWT session", "fix(auth): Resolve Redis race", "docs: nothing", "feat(auth): Add JWT session again", "perf(db): Tune Redis cache"]
    rows = [(i, i % 2, start + timedelta(minutes=i), "UserCorrection" if i % 7 == 0 else "GitCommit", texts[i % 5], texts[i % 5], i % 15) for i in range(60)]
    events = spark.createDataFrame(rows, "id long, user_id int, timestamp timestamp_ntz, kind string, content string, message string, files_changed int")
    for low in (0, 30):
        events.where((F.col("id") >= low) & (F.col("id") < low + 30)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = []

    def fails(batch, number):
        raise OSError(f"not number {number}")

    taken = intake.Intake(spark, str(tmp_path / "kept"), "user_id", "int", {"fails": fails, "counts": lambda batch, number: got.append((number, batch.count()))}, 4)
    source = lambda: spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = taken.start(source(), str(tmp_path / "offsets"), every=None)
    query.awaitTermination()
    observed = [p["observedMetrics"]["intake"]["saved"] for p in query.recentProgress if p["numInputRows"]]
    told = classified(events).withColumn("strength", scoring.signal(F.col("kind"), F.col("memory_type")))
    folded = scoring.fold(with_embedding(told.where("kind <> 'UserCorrection'").withColumn("t", F.concat_ws(" ", "title", "content")), "t"), "user_id")
    want = {(r.id, r.outcome) for r in folded.collect()} | {(r[0], "saved") for r in rows if r[3] == "UserCorrection"}
    assert {(r.id, r.outcome) for r in taken.judged().collect()} == want
    saved = {i for i, outcome in want if outcome == "saved"}
    assert {r.id for r in taken.table.read().collect()} == saved and {round(r.importance, 6) for r in taken.table.read().where("kind = 'UserCorrection'").collect()} == {0.9}
    assert sorted(r.batch for r in taken.failures().collect()) == [0, 1] and [n for _, n in sorted(got)] == observed and sum(observed) == len(saved)
    table, counts = rows_of(taken.table.read()), rows_of(taken.graph.entities())
    assert counts == rows_of(graph.entities(graph.extract(taken.table.read()), "id", "timestamp"))
    taken.start(source(), str(tmp_path / "offsets"), every=None).awaitTermination()
    taken.take(spark.createDataFrame(taken.judged().where("id < 30").collect(), taken.schema), 0)
    assert rows_of(taken.table.read()) == table and rows_of(taken.graph.entities()) == counts and len(got) == 3


def test_postings_have_a_row_for_each_term_of_a_row(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a b a", "b"), (2, None, ""), (3, "b", None), (3, "b c", None)], "id long, x string, y string")
    found = search.postings(rows, "id", ("x", "y"))
    got = sorted((r.term, r.id, r.length, r["at"].x, r["at"].y) for r in found.collect())
    assert got == [("a", 1, 4, [0, 2], []), ("b", 1, 4, [1], [0]), ("b", 3, 1, [0], []), ("b", 3, 2, [0], []), ("c", 3, 2, [1], [])]
    # Dealing needs no sample, for which all texts would be split once more.
    assert "rangepartitioning" not in search.dealt(found, "id")._jdf.queryExecution().toString().lower()
    search.write_index(rows, "id", ("x", "y"), str(tmp_path / "i"))
    assert spark.read.parquet(str(tmp_path / "i" / "facts")).first().asDict() == {"n": 4, "mean": 1.75, "keyed": False}
    index = spark.read.parquet(str(tmp_path / "i" / "postings"))
    assert sorted(map(tuple, search.term_frequencies(index, "id").collect())) == [("a", 2, 1), ("b", 4, 2), ("c", 1, 1)]
    # Rows with keys of their own are counted without remembering keys.
    assert "distinct" not in search.term_frequencies(index, "id", True)._jdf.queryExecution().toString().lower()
