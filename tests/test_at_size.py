"""What keeps work in proportion at size: states in cells, packed vectors, one pass of extraction, tables dealt to all cores."""

from datetime import datetime, timedelta
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.functions.embedding import DIM, pack, unpack, with_embedding, with_packed
from tidemark.operators import graph, scoring, sequences, similarity, stored
from tidemark.shared.scratch import Scratch
from tidemark.sources import adapters
from tidemark.streaming import ingest


def test_packed_vectors_come_back(spark):
    rng = np.random.default_rng(5)
    vectors = np.where(rng.random((40, DIM)) < 0.05, rng.normal(size=(40, DIM)), 0).astype(np.float32)
    vectors[3] = 0
    assert np.array_equal(unpack(pack(vectors).to_pylist()), vectors) and pack(vectors[:0]).to_pylist() == []
    rows = spark.createDataFrame([(1, "fix redis cache"), (2, None), (3, "fix redis cache")], "id int, text string")
    plain, packed = with_embedding(rows, "text"), with_embedding(rows, "text", packed=True)
    want = {r.id: bytes(r.embedding) for r in with_packed(plain).collect()}
    got = {r.id: bytes(r.embedding) for r in packed.collect()}
    assert got == want and max(map(len, got.values())) < DIM * 4 / 2


def test_streams_keep_their_keys_in_cells(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(i, None if i % 1500 == 7 else i % 1500, start + timedelta(hours=i // 500)) for i in range(6000)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz")
    for low in (0, 3000):
        events.where((F.col("event_id") >= low) & (F.col("event_id") < low + 3000)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = ingest.into_table(ingest.throttled(stream, "user_id", 5 * 3600), str(tmp_path / "out"), str(tmp_path / "offsets"), every=None)
    query.awaitTermination()
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= ingest.CELLS + 1
    got = sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted(r.event_id for r in sequences.throttle(events, "user_id", 5 * 3600).collect())


def test_edges_extract_each_memory_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def title(i):
        seen.add(1)
        return f"feat(auth): Add JWT session {i % 5}"

    rows = spark.range(200).select(F.col("id").alias("event_id"), F.lit(datetime(2024, 1, 1)).alias("ts"), title("id").alias("title"))
    assert graph.edges(graph.extract(rows), "event_id", "ts", Scratch(spark, "edges")).count() > 0
    assert seen.value == 200


def test_tables_of_little_for_each_core_are_dealt(spark, tmp_path, monkeypatch):
    spark.range(20000).coalesce(1).write.parquet(str(tmp_path / "t.parquet"))
    size = sum(f.stat().st_size for f in (tmp_path / "t.parquet").iterdir())
    monkeypatch.setattr(adapters, "SMALL", size // 2)
    parts = adapters.table(spark, str(tmp_path), "t").rdd.glom().map(len).collect()
    assert len(parts) == spark.sparkContext.defaultParallelism and min(parts) > 0


def test_a_stored_table_is_dealt_once_a_batch(spark, tmp_path):
    rows = spark.range(100).select("id", F.lit("x").alias("content"))
    table = stored.StoredTable(spark, str(tmp_path / "t"), rows.schema, "id", 4)
    kept, keep = [], table.scratch.keep

    def told(df, name):
        kept.append((name.split("-")[0], df._jdf.queryExecution().executedPlan().toString().count("Exchange ")))
        return keep(df, name)

    table.scratch.keep = told
    table.upsert(rows, 0)
    assert [name for name, _ in kept] == ["batch"]  # nothing is overwritten, so nothing is written aside
    table.delete(rows.where("id < 10"), 1)
    assert kept[-1] == ("parts", 1) and table.read().count() == 90


def walk(spark, n, keys=1, dims=16):
    """Rows of keys whose vectors wander, so near-repeats lie near and far; some vectors come again, some are zero."""
    rng = np.random.default_rng(17)
    start, rows, at = datetime(2024, 1, 1), [], rng.normal(size=dims)
    for i in range(n):
        at = rng.normal(size=dims) + 0.5 if rng.random() < 0.05 else at + rng.normal(size=dims) * 0.12
        rows.append((i, f"k{i % keys}", start + timedelta(minutes=i * 7), float(rng.choice([0.4, 0.6, 1.0])), ([0.0] * dims if i % 90 == 0 else rows[int(rng.integers(0, i))][4] if i % 11 == 5 else (at / np.linalg.norm(at)).tolist())))
    return spark.createDataFrame(rows, "id long, project string, timestamp timestamp_ntz, strength double, embedding array<float>")


@pytest.mark.parametrize("policy", [scoring.BATCH, scoring.Policy(0.95, threshold=0.6, history=7), scoring.Policy(None, threshold=0.5)])
def test_rows_of_large_keys_have_looks_only_for_repeats(spark, policy):
    """A key of many blocks: rows bring their vectors and have bits of blocks with near-repeats only, not of every block."""
    rows, scratch = walk(spark, 600), Scratch(spark, "fold")
    told = lambda df: {r.id: (r.outcome, r.score and round(r.score, 6)) for r in df.collect()}
    assert told(scoring.fold_in_blocks(rows, "project", scratch, policy, 8)) == told(scoring.fold(rows, "project", policy))
    looks = spark.read.schema("w long, seen long, similar binary, repeats binary").parquet(f"{scratch.path}/looks")
    assert looks.where((F.octet_length("similar") > 0) | (F.octet_length("repeats") == 0)).isEmpty()
    if policy.dedup is None:
        assert looks.isEmpty()
    else:
        assert 0 < looks.count() < 600 * (600 // 8) / 20


def test_a_fold_in_blocks_embeds_each_row_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("array<float>")
    def embedded(v):
        seen.add(1)
        return v

    scoring.fold_in_blocks(walk(spark, 100).withColumn("embedding", embedded("embedding")), "project", Scratch(spark, "fold")).collect()
    assert seen.value == 100


def test_blocks_are_sent_to_tiles_and_not_to_pairs(spark, monkeypatch):
    """Every pair of blocks is met, and a block is sent once to a tile, not to each other block."""
    numbers = spark.range(40).select(F.lit("g").alias("group"), F.col("id").alias("cell"))
    pairs = numbers.select("group", F.explode(F.sequence(F.lit(0).cast("long"), "cell")).alias("from"), "cell")
    monkeypatch.setattr(similarity, "TILE", 10)
    sent = similarity.in_tiles(pairs, numbers)
    assert sent.count() == 4 * 10 + 6 * 20  # of 4 tiles with one side and 6 with two; 820 pairs

    def block(batch, row):
        return batch.column("cell")[row].as_py()

    def meet(batch, row, x, y, same):
        assert same == (x == y)
        yield pa.RecordBatch.from_arrays([pa.array([x]), pa.array([y])], ["x", "y"])

    met = sorted((r.x, r.y) for r in sent.mapInArrow(similarity.meet_in_tiles(block, meet), "x long, y long").collect())
    assert met == [(x, y) for x in range(40) for y in range(x, 40)]


def test_pairs_in_tiles(spark, monkeypatch):
    """Pairs of blocks that share tiles, found in single precision and told in double: the same as all against all."""
    monkeypatch.setattr(similarity, "TILE", 3)
    monkeypatch.setattr(similarity, "PAIR_BLOCK", 16)
    rows = walk(spark, 400, 2)
    vectors = {r.id: (r.project, np.array(r.embedding)) for r in rows.collect()}
    for least in (0.92, 0.2):
        got = {(r.a, r.b): r.similarity for r in similarity.pairs_within(rows, Scratch(spark, "pairs"), "project", "id", least).collect()}
        unit = {i: (key, v / (np.linalg.norm(v) or 1)) for i, (key, v) in vectors.items()}
        want = {(a, b): float(unit[a][1] @ unit[b][1]) for a in unit for b in unit if a < b and unit[a][0] == unit[b][0] and unit[a][1] @ unit[b][1] >= least}
        assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-12 for p in want) and want


def test_rounds_list_no_pairs(spark, monkeypatch):
    """Groups of near rows are decided in rounds and at last in order; what is written of them follows the rows and not their pairs."""
    monkeypatch.setattr(similarity, "PAIR_BLOCK", 16)
    monkeypatch.setattr(similarity, "TILE", 3)
    monkeypatch.setattr(scoring, "FINISH", 3)
    rows = walk(spark, 600, 2).withColumn("project", F.when(F.col("id") % 50 > 0, F.col("project"))).withColumn("timestamp", F.date_trunc("day", "timestamp").cast("timestamp_ntz"))
    scratch = Scratch(spark, "rounds")
    got = {r.id: r.outcome for r in scoring.keep_first(rows, scratch, "project", 0.8).collect()}
    want, kept = {}, {}
    for r in sorted(rows.collect(), key=lambda r: (r.timestamp, r.id)):
        v, own = np.array(r.embedding), kept.setdefault(r.project, [])
        v = v / (np.linalg.norm(v) or 1)
        want[r.id] = "deduped" if r.project and any(v @ o >= 0.8 for o in own) else "saved"
        own += [v] if want[r.id] == "saved" else []
    # Of equal vectors without a key the first is saved, as before.
    keyed = {r.id for r in rows.where("project is not null").select("id").collect()}
    assert {i: o for i, o in got.items() if i in keyed} == {i: o for i, o in want.items() if i in keyed}
    folders = {f.name: f for f in Path(scratch.path.removeprefix("file://")).iterdir()}
    assert "late1" in folders and "near" not in folders
    told = spark.read.parquet(f"{scratch.path}/late0")
    assert told.agg(F.sum(F.size("places"))).first()[0] < 600


def test_near_places_need_no_cosines_but_doubtful_ones():
    """The same places as by double precision, also for a pair at the threshold itself."""
    rng = np.random.default_rng(1)
    v = rng.normal(size=(6, 32))[rng.integers(0, 6, 300)] + rng.normal(size=(300, 32)) * 0.25
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    cosines = v[:150] @ v[150:].T
    for least in (0.92, float(cosines[3, 4]) - 1e-9, float(cosines[3, 4]) + 1e-9):
        i, j = similarity._near(v[:150], v[150:], least)
        assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(*(x.tolist() for x in np.nonzero(cosines >= least)), strict=True))
