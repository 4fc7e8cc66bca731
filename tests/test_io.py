"""Readers, writers, streams and the registered queries on the smallest tables."""

import glob
import json
import os

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lodeflow.operators import packing, preference
from lodeflow.operators.batches import sized_slices
from lodeflow.operators.tokenizers import ByteTokenizer
from lodeflow.plans import catalog
from lodeflow.schemas import CONVERSATION
from lodeflow.sources import readers, sinks
from lodeflow.streaming import incremental

SMALL = "/root/testdata/sf0.001"


def test_json_texts(spark, tmp_path):
    lines = ['{"text": "a"}', "{bad", '{"text": 5}', '{"other": "x"}', '{"text": "b"}', ""]
    (tmp_path / "x.jsonl").write_text("\n".join(lines))
    for backend in ("json", "lines"):
        got = readers.json_texts(spark, str(tmp_path / "x.jsonl"), backend=backend).orderBy("row_id").collect()
        assert [(r.row_id, r.text) for r in got] == [(0, "a"), (1, "b")]
    with pytest.raises(ValueError):
        readers.json_texts(spark, "x", backend="other")
    assert readers.parse_errors(spark, str(tmp_path / "x.jsonl")).first().asDict() == {"lines": 5, "errors": 1}
    assert readers.file_digests(spark, str(tmp_path / "x.jsonl")).first().length == os.path.getsize(tmp_path / "x.jsonl")


def test_records_lines_shards(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"conversations": [{"role": "user", "content": "x"}]}\nnot json\n')
    assert readers.records(spark, str(tmp_path / "c.jsonl"), CONVERSATION).first().conversations[0].content == "x"
    (tmp_path / "p.txt").write_text(" a \n\n b\n")
    assert [r.line for r in readers.text_lines(spark, str(tmp_path / "p.txt")).collect()] == ["a", "b"]
    for rank in (0, 1):
        (tmp_path / f"samples_rank{rank}.jsonl").write_text(json.dumps({"idx": rank, "text": f"t{rank}"}) + "\n\n")
    assert [(r.idx, r.seq) for r in readers.sample_shards(spark, str(tmp_path)).orderBy("seq").collect()] == [(0, 0), (1, 1)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(0, [1, 2]), (1, [3])], "seq int, ids array<int>")
    rows = sinks.flat_int32(df, "ids", ["seq"]).orderBy("part", "batch").collect()
    assert b"".join(r.data for r in rows) == (1).to_bytes(4, "little") + (2).to_bytes(4, "little") + (3).to_bytes(4, "little")
    assert [r.ids for r in sinks.padded(df, "ids", 3).orderBy("seq").collect()] == [[1, 2, 0], [3, 0, 0]]
    one = sinks.manifest(spark.createDataFrame([(3,)], "tokens long"), {"source": "x", "max_len": 4}).first().value
    assert json.loads(one) == {"source": "x", "max_len": 4, "tokens": 3}
    sinks.write_shards(spark.range(4).withColumnRenamed("id", "idx"), str(tmp_path / "s"), "idx", 2)
    assert spark.read.json(str(tmp_path / "s")).count() == 4
    assert "未通过" in sinks.gate_report({"pass_all": False, "think_trigger_rate": 0, "rep4_mean": 0, "judge_n": 0, "judge_mean": 0.0})
    df.select("seq", F.col("ids").alias("input_ids")).where("seq = 0").write.parquet(str(tmp_path / "packed"))
    assert readers.packed_sequences(spark, str(tmp_path / "packed"), 2).count() == 1
    with pytest.raises(Exception, match="places"):
        readers.packed_sequences(spark, str(tmp_path / "packed"), 3).collect()


def _largest_group(path):
    files = [pq.ParquetFile(f).metadata for f in glob.glob(f"{path}/*.parquet")]
    return max(m.row_group(k).num_rows for m in files for k in range(m.num_row_groups))


def test_dense_pairs_in_bounded_row_groups(spark, tmp_path):
    """A reader decodes a row group's dense rows together, so a group holds few of them; tokens are made by slices."""
    flat = spark.createDataFrame([(k, "p", f"c{k}", "r" * k) for k in range(30)], "id long, prompt string, chosen string, rejected string").coalesce(1)
    sinks.write_pairs(preference.token_pairs(flat, ByteTokenizer()), str(tmp_path / "pairs"), 200_000)
    assert _largest_group(tmp_path / "pairs") * 3 * 200_000 <= 4_000_000
    back = readers.token_pairs(spark, str(tmp_path / "pairs"), 200_000).orderBy("id").collect()
    assert [(r.id, r.prompt_len, ByteTokenizer().decode(r.chosen), ByteTokenizer().decode(r.rejected)) for r in back] == [(k, 1, f"c{k}", "r" * k) for k in range(30)]


def test_packed_vectors_in_bounded_portions(spark, tmp_path):
    """Vectors are put together, written and read by portions that don't grow with the table."""
    n = 8192
    vectors = [F.array_repeat(F.col("id").cast("int"), n).alias(c) for c in ("input_ids", "document_ids", "labels")]
    sinks.write_packed(spark.range(400).coalesce(1).select(F.lit(0).alias("shard"), F.col("id").alias("seq"), *vectors), str(tmp_path / "packed"), n)
    assert _largest_group(tmp_path / "packed") * 3 * n <= 4_000_000
    assert sorted(r.labels[-1] for r in readers.packed_sequences(spark, str(tmp_path / "packed"), n).select("labels").collect()) == list(range(400))
    whole = pa.RecordBatch.from_pydict({"shard": [0] * 300, "seq": list(range(300)), "place": [0] * 300, "doc": list(range(300)), "eos": [True] * 300, "ids": pa.array([[k] * (n - 1) for k in range(300)], pa.list_(pa.int32()))})
    out = list(packing._assembled(n, 7, {"input_ids": -1, "document_ids": -1})(iter([whole])))
    assert max(b.num_rows for b in out) * n <= packing.PORTION
    rows = [(q, x[0], x[-1], len(x)) for b in out for q, x in zip(b.column("seq").to_pylist(), b.column("input_ids").to_pylist())]
    assert rows == [(k, k, 7, n) for k in range(300)]


def test_lane_spills_sorted_runs():
    """A lane takes a batch's texts from sorted runs and holds one of them, not all texts."""
    rows = [((k * 37) % 101, f"{k}" * 9) for k in range(101)]
    for limit in (1, 50, 10**9):
        assert list(incremental._by_id(iter(rows), limit)) == sorted(rows)
    assert list(incremental._by_id(iter([]))) == []


def test_slices_by_all_columns():
    batch = pa.RecordBatch.from_pydict({"a": ["xx", None, "xxxx", "x"], "b": [[1], [1, 2], None, [1] * 9]})
    assert [p.num_rows for p in sized_slices(batch, ["a", "b"], 5)] == [2, 1, 1]
    assert [p.num_rows for p in sized_slices(batch, ["b"], 3)] == [3, 1] and list(sized_slices(batch.slice(4), ["a"])) == []


def test_stream_equals_batch(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([("text number one, long enough to pass",), (f"text number {k}, long enough to pass too",), ("short",)], "text string").coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    stream = spark.readStream.schema("text string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    got = incremental.run_available(incremental.first_seen(incremental.clean_stream(stream)), "t")
    assert got.count() == 4
    seen = []
    incremental.run_available(stream, "b", each_batch=incremental.every(2, lambda df, i: seen.append((i, df.count()))))
    assert [i for i, _ in seen] == [0, 2]


def test_near_new(spark):
    from lodeflow.operators.dedup import sketch_texts

    texts = ["the same long text about packing sequences of tokens", "another thing altogether, nothing in common here", "the same long text about packing sequences of tokens"]
    rows = [(i, s.tolist()) for i, s in enumerate(sketch_texts(texts))]
    stored, new = (spark.createDataFrame(x, "id long, sig array<long>") for x in (rows[:1], rows[1:]))
    assert [r.id for r in incremental.near_new(new, stored).collect()] == [2]


def _rows(frame):
    """Rows by columns in order of name, numbers rounded, in order."""
    plain = lambda v: "NULL" if v is None or v != v else repr(round(float(v), 9)) if isinstance(v, float) else str(v)
    return sorted(tuple(plain(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_registered_query(spark, duck, name):
    got, sql = catalog.queries()[name](spark, SMALL).toPandas(), catalog.oracle_sql().get(name)
    if sql:
        want = duck.sql(sql).df()
        assert sorted(got.columns) == sorted(want.columns) and _rows(got) == _rows(want)


def test_stream_goes_on(spark, tmp_path):
    """A second run with the folder of the first reads only what has come since; packing goes on across batches."""
    tok, folder, texts = ByteTokenizer(), str(tmp_path / "run"), ["abcdefgh", "ij", "k" * 23, "", "lmno"]
    for k, text in enumerate(texts):
        spark.createDataFrame([(k, text)], "row_id long, clean string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("row_id long, clean string").parquet(str(tmp_path / "in"))
        found = incremental.run_available(incremental.packed_stream(stream, tok, 8), "p", output="update", folder=folder)
    last = found.groupBy("seq").agg(F.max_by(F.struct("input_ids", "document_ids"), F.struct("batch", "closed")).alias("v")).orderBy("seq").collect()
    ids = spark.createDataFrame([(k, tok.encode(x)) for k, x in enumerate(texts)], "id long, ids array<int>")
    want = packing.pack(ids, 8, tok.eos_id).orderBy("seq").collect()
    assert [(r.seq, r.v.input_ids, r.v.document_ids) for r in last] == [(r.seq, r.input_ids, r.document_ids) for r in want]
    assert sorted(r.batch for r in found.select("batch").distinct().collect()) == [0, 1, 2, 3, 4]


def test_interval_and_sink(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    counts = incremental.run_available(stream.groupBy((F.col("id") % 2).alias("k")).agg(F.count("*").alias("n")), "c", output="complete", interval="100 milliseconds")
    assert {r.k: r.n for r in counts.collect()} == {0: 3, 1: 2}
    assert incremental.flushed(spark.range(5), ["id"], 2).groupBy("chunk").count().orderBy("chunk").collect()[-1]["count"] == 1


def test_file_digests(spark, tmp_path):
    import hashlib

    (tmp_path / "a.bin").write_bytes(b"x" * 9_000_000)
    (tmp_path / "b.bin").write_bytes(b"y")
    (tmp_path / "c.bin").write_bytes(b"")
    got = readers.file_digests(spark, str(tmp_path / "*.bin"))
    digests = [r.sha256 for r in got.orderBy("path").collect()]
    assert digests == [hashlib.sha256(b"x" * 9_000_000).hexdigest(), hashlib.sha256(b"y").hexdigest()]
    assert readers.ordered_digest(got).first().sha256 == hashlib.sha256("".join(digests).encode()).hexdigest()


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the test tables")
def test_entry(spark):
    assert {r.outcome for r in __spark_entry__.entry(spark).collect()} >= {"kept"}
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_core_does_not_import_llm():
    import pathlib

    root = pathlib.Path(catalog.__file__).parents[1]
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "lodeflow.llm" not in path.read_text(encoding="utf-8")
