"""Sources and sinks as queries: each writes a whole table to the shared folder in the format in question and reads it back."""

from __future__ import annotations

import json
import uuid
from pathlib import Path
from tempfile import TemporaryDirectory

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeflow import schemas
from lodeflow.functions import judge, text
from lodeflow.operators import chat, packing, preference, profile
from lodeflow.operators.tokenizers import ByteTokenizer, FileTokenizer, decode_ids, encode_texts, profile_vocabulary
from lodeflow.plans.config import load_config
from lodeflow.plans.corpus import _LABELS, _PIECES, _SFT_PIECES, _BYTES, _VECTORS, PRETRAIN_LEN, SFT_LEN, _digested, _packed_sft, _tokens
from lodeflow.plans.registry import _SCORED, _STRIP, _TOKENS, _TURNS, _scored, query, t
from lodeflow.session import work_root
from lodeflow.sources import readers, sinks
from lodeflow.streaming import incremental

PAIR_LEN = 8192


def _folder(spark: SparkSession, name: str) -> str:
    return f"{work_root(spark)}/{name}-{uuid.uuid4().hex}"


def _json_corpus(spark: SparkSession, sf_dir: str) -> str:
    """The corpus as JSON lines, with lines among it that aren't JSON or have no string where a text should be."""
    path = _folder(spark, "json-corpus")
    lines = t(spark, sf_dir, "pretrain_t2t").select(F.to_json(F.struct("row_id", "text")).alias("value"))
    r = t(spark, sf_dir, "region")
    bad = r.select(F.concat(F.lit("not json: "), "r_name").alias("value")).unionByName(r.select(F.to_json(F.struct(F.col("r_regionkey").alias("text"))).alias("value")))
    lines.unionByName(bad).write.text(path)
    return path


# ---- sources


@query("SELECT backend, md5(text) AS digest, count(*) AS n FROM pretrain_t2t, (VALUES ('json'), ('lines')) AS b(backend) WHERE text IS NOT NULL GROUP BY ALL")
def json_text_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of a JSON corpus by either backend; lines that aren't records of a text are skipped."""
    path = _json_corpus(spark, sf_dir)
    both = [readers.json_texts(spark, path, backend=b).withColumn("backend", F.lit(b)) for b in ("json", "lines")]
    return both[0].unionByName(both[1]).groupBy("backend", F.md5("text").alias("digest")).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n_rows, count(*) AS ordinals, 0::BIGINT AS least, count(*) - 1 AS most FROM pretrain_t2t WHERE text IS NOT NULL")
def json_text_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with a text are numbered from 0 without a gap; others get no number."""
    rows = readers.json_texts(spark, _json_corpus(spark, sf_dir))
    return rows.agg(F.count("*").alias("n_rows"), F.countDistinct("row_id").alias("ordinals"), F.min("row_id").alias("least"), F.max("row_id").alias("most"))


@query("SELECT md5(text) AS digest, count(*) AS n FROM pretrain_t2t WHERE text IS NOT NULL GROUP BY ALL")
def json_text_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus read as a stream of JSON files."""
    path = _folder(spark, "json-stream")
    sinks.write_lines(t(spark, sf_dir, "pretrain_t2t").select("text"), path)
    return incremental.run_available(readers.streamed_texts(spark, path), "texts").groupBy(F.md5("text").alias("digest")).agg(F.count("*").alias("n"))


@query("""SELECT conv_id, epoch_us(ingested_at) AS at, CAST(len(conversations) AS INT) AS messages, CAST(coalesce(list_sum(list_transform(conversations, lambda m: coalesce(length(m.content), 0))), 0) AS BIGINT) AS chars,
 len(list_filter(conversations, lambda m: m.content IS NULL))::INT AS without_content FROM sft_t2t_mini WHERE conversations IS NOT NULL""")
def nested_json_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested records: an absent key and an empty text stay apart."""
    path = _folder(spark, "nested")
    rows = t(spark, sf_dir, "sft_t2t_mini").select("conv_id", F.unix_micros(F.col("ingested_at").cast("timestamp")).alias("at"), "conversations")
    sinks.write_lines(rows, path)
    schema = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("at", T.LongType()), *schemas.CONVERSATION.fields])
    back = readers.records(spark, path, schema).where("conversations IS NOT NULL")
    return back.select("conv_id", "at", F.size("conversations").alias("messages"), text.content_length(F.col("conversations")).alias("chars"), F.size(F.filter("conversations", lambda m: m["content"].isNull())).alias("without_content"))


_LINES = "WITH l AS (SELECT regexp_split_to_array(text || chr(10), '\\r\\n|\\r|\\n') AS x FROM documents WHERE text IS NOT NULL), u AS (SELECT unnest(x[1 : len(x) - 1]) AS line FROM l)"


def _text_file(spark: SparkSession, sf_dir: str) -> str:
    path = _folder(spark, "lines")
    t(spark, sf_dir, "documents").where("text IS NOT NULL").select("text").write.text(path)
    return path


@query(f"{_LINES}, s AS (SELECT {_STRIP % 'line'} AS line FROM u) SELECT md5(line) AS line, count(*) AS n FROM s WHERE line <> '' GROUP BY ALL")
def text_lines_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of text files, stripped, without blank ones."""
    return readers.text_lines(spark, _text_file(spark, sf_dir)).groupBy(F.md5("line").alias("line")).agg(F.count("*").alias("n"))


@query(f"{_LINES} SELECT count(*) AS lines FROM u")
def text_line_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.line_count(spark, _text_file(spark, sf_dir))


@query("SELECT (SELECT count(*) FROM pretrain_t2t) + 2 * (SELECT count(*) FROM region) AS lines, (SELECT count(*) FROM region) AS errors")
def json_parse_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.parse_errors(spark, _json_corpus(spark, sf_dir))


@query("SELECT row_id FROM pretrain_t2t ORDER BY md5('7:' || row_id), row_id LIMIT 200")
def uniform_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.uniform_sample(t(spark, sf_dir, "pretrain_t2t").select("row_id"), "row_id", 200, seed=7)


@query("SELECT bench, item_id, md5(question) AS question FROM eval_items")
def benchmark_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmarks stored apart under one folder, read by name."""
    base = _folder(spark, "benchmarks")
    items = t(spark, sf_dir, "eval_items")
    names = [r.bench for r in items.select("bench").where("bench IS NOT NULL").distinct().orderBy("bench").collect()]  # names of benchmarks, not rows
    items.write.partitionBy("bench").parquet(base)
    parts = [readers.benchmark(spark, base, f"bench={n}").select(F.lit(n).alias("bench"), "item_id", F.md5("question").alias("question")) for n in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(_SCORED + "SELECT idx, md5(text) AS text, count(*) AS n FROM s GROUP BY ALL")
def sample_shard_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled texts written by shards of four workers and read as one table."""
    path = _folder(spark, "shards")
    sinks.write_shards(_scored(spark, sf_dir).select("idx", "text"), path, "idx", 4)
    return readers.sample_shards(spark, path).groupBy("idx", F.md5("text").alias("text")).agg(F.count("*").alias("n"))


def _count(x: str) -> str:
    """SQL of a text's number of tokens."""
    return _TOKENS.replace("strlen(x", f"strlen({x}").replace("replace(x,", f"replace({x},")


_PAIR = f"""WITH p AS (SELECT pair_id, epoch_us(ingested_at) AS at, {_TURNS % 'chosen[:-2]'} || '<|im_start|>assistant' || chr(10) AS prompt, {_TURNS % 'chosen'} AS chosen, {_TURNS % 'rejected'} AS rejected
 FROM dpo WHERE len(chosen) >= 2 AND len(rejected) >= 2),
k AS (SELECT *, {_count('prompt')} AS pn, {_count('chosen')} AS cn, {_count('rejected')} AS rn FROM p)"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "dpo").withColumn("key", F.struct("pair_id", F.unix_micros(F.col("ingested_at").cast("timestamp")).alias("at")))
    flat = preference.preference_pairs(rows, "key")
    return flat.withColumn("id", F.to_json("id"))


def _stored_pairs(spark: SparkSession, sf_dir: str, max_len: int) -> DataFrame:
    path = _folder(spark, "pairs")
    sinks.write_pairs(preference.token_pairs(_pairs(spark, sf_dir), ByteTokenizer(), max_len), path, max_len)
    return readers.token_pairs(spark, path, max_len)


def _pair_key(df: DataFrame) -> DataFrame:
    key = F.from_json("id", "pair_id BIGINT, at BIGINT")
    return df.withColumn("pair_id", key["pair_id"]).withColumn("at", key["at"])


@query(_PAIR + 'SELECT pair_id, "at", CAST(pn AS INT) AS prompt_len, CAST(cn AS INT) AS chosen_len, CAST(rn AS INT) AS rejected_len, cn <= 1024 AND rn <= 1024 AS fits FROM k')
def pair_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of token-level pairs, and which of them fit."""
    pairs = preference.token_pairs(_pairs(spark, sf_dir), ByteTokenizer())
    short = preference.fitting(pairs, ["chosen", "rejected"], 1024).select("id", F.lit(True).alias("fits"))
    sized = _pair_key(pairs.select("id", "prompt_len", F.size("chosen").alias("chosen_len"), F.size("rejected").alias("rejected_len")).join(short, "id", "left"))
    return sized.select("pair_id", "at", "prompt_len", "chosen_len", "rejected_len", F.coalesce("fits", F.lit(False)).alias("fits")).distinct()


@query(_PAIR + f'SELECT pair_id, "at", CAST(pn AS INT) AS prompt_len, md5(chosen) AS chosen, md5(rejected) AS rejected FROM k WHERE cn <= {PAIR_LEN} AND rn <= {PAIR_LEN}')
def pair_token_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs written as dense rows, read back and decoded."""
    stored, tok = _stored_pairs(spark, sf_dir, PAIR_LEN), ByteTokenizer()
    long = stored.select("id", "prompt_len", F.explode(F.array(*(F.struct(F.lit(c).alias("side"), F.col(c).alias("ids")) for c in ("chosen", "rejected")))).alias("x"))
    texts = decode_ids(long.select(F.to_json(F.struct("id", "prompt_len", "x.side")).alias("id"), "x.ids"), tok, id_type="STRING")
    key = F.from_json("id", "id STRING, prompt_len INT, side STRING")
    rows = texts.select(key.alias("k"), F.md5("text").alias("digest"))
    of = lambda side: F.max(F.when(F.col("k.side") == side, F.col("digest"))).alias(side)
    return _pair_key(rows.groupBy("k.id", "k.prompt_len").agg(of("chosen"), of("rejected"))).select("pair_id", "at", "prompt_len", "chosen", "rejected")


@query(_PAIR + f'SELECT pair_id, "at", md5(prompt) AS prompt FROM k WHERE cn <= {PAIR_LEN} AND rn <= {PAIR_LEN}')
def prompt_slice_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts cut out of dense rows by their length, decoded."""
    path = _folder(spark, "prompts")
    sinks.padded(preference.token_pairs(_pairs(spark, sf_dir), ByteTokenizer(), PAIR_LEN).select("id", "prompt"), "prompt", PAIR_LEN).write.parquet(path)
    cut = readers.prompt_slices(spark.read.parquet(path))
    return _pair_key(decode_ids(cut, ByteTokenizer(), "id", "prompt", "STRING")).select("pair_id", "at", F.md5("text").alias("prompt")).distinct()


@query(_PIECES + f", tok AS (SELECT doc, {_BYTES % 'clean'} AS ids FROM docs), v AS (" + _VECTORS.format(L=PRETRAIN_LEN, more=f", CAST({PRETRAIN_LEN} - sum(size + eos::INT) AS INT) AS padding") + ") SELECT seq, document_ids, padding FROM v")
def packed_pretrain_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed vectors written, read with the check of their length, and handed out as a trainer reads them."""
    path = _folder(spark, "packed")
    sinks.write_packed(packing.pack(_tokens(spark, sf_dir), PRETRAIN_LEN, ByteTokenizer().eos_id), path, PRETRAIN_LEN)
    rows = packing.model_inputs(readers.packed_sequences(spark, path, PRETRAIN_LEN))
    padding = F.size(F.filter("labels", lambda x: x == chat.IGNORED))
    return _digested(rows.withColumn("padding", padding), ["document_ids"]).join(rows.select("shard", "seq", padding.alias("padding")), ["shard", "seq"]).select("seq", "document_ids", "padding")


@query(_SFT_PIECES + ", v AS (" + _VECTORS.format(L=SFT_LEN, more=_LABELS.format(L=SFT_LEN)) + ") SELECT seq, document_ids, labels FROM v")
def packed_sft_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "packed-sft")
    sinks.write_packed(_packed_sft(spark, sf_dir), path, SFT_LEN)
    return _digested(readers.packed_sequences(spark, path, SFT_LEN), ["document_ids", "labels"]).drop("shard")


_SETTINGS = ('{"lr": 0.003, "model": {"layers": 8, "width": 512}, "stage": "base"}', '{"model": {"width": 768, "heads": 6}, "stage": "next"}')


@query(f"""WITH c AS (SELECT json_merge_patch('{_SETTINGS[0]}', '{_SETTINGS[1]}') AS j)
SELECT unnest(['lr', 'model.layers', 'model.width', 'model.heads', 'stage']) AS name, unnest([j->>'$.lr', j->>'$.model.layers', j->>'$.model.width', j->>'$.model.heads', j->>'$.stage']) AS value FROM c""")
def stage_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A configuration that extends another; settings are the driver's own files, not data."""
    with TemporaryDirectory() as d:
        for name, content in zip(("base", "next"), _SETTINGS):
            Path(d, f"{name}.json").write_text(content if name == "base" else json.dumps({"extends": "base.json"} | json.loads(content)), encoding="utf-8")
        found = load_config(Path(d, "next.json"))
    rows = [(f"{k}.{j}" if j else k, str(x)) for k, v in found.items() for j, x in (v.items() if isinstance(v, dict) else [("", v)])]
    return spark.createDataFrame(rows, "name string, value string")


_SPECIAL = list(schemas.SPECIAL_TOKENS.values())


@query(f"SELECT {len(_SPECIAL) + 3}::BIGINT AS vocab_size, 1::BIGINT AS merges, 'BPE' AS model_type, {len(_SPECIAL)}::BIGINT AS added, 'chat_template,eos_token,model_max_length' AS config_keys, '<|endoftext|>' AS eos_token, true AS has_template, 0::BIGINT AS eos_id")
def tokenizer_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tokenizer file with its configuration, profiled and loaded; both are the driver's own files."""
    vocab = {x: i for i, x in enumerate([*_SPECIAL, "a", "b", "ab"])}
    added = [{"id": i, "content": x, "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True} for i, x in enumerate(_SPECIAL)]
    file = {"version": "1.0", "added_tokens": added, "normalizer": None, "pre_tokenizer": None, "post_processor": None, "decoder": None, "model": {"type": "BPE", "vocab": vocab, "merges": ["a b"]}}
    with TemporaryDirectory() as d:
        Path(d, "tokenizer.json").write_text(json.dumps(file), encoding="utf-8")
        Path(d, "tokenizer_config.json").write_text(json.dumps({"eos_token": "<|endoftext|>", "model_max_length": 8192, "chat_template": "{{ messages }}"}), encoding="utf-8")
        found = profile_vocabulary(f"{d}/tokenizer.json")
        eos = FileTokenizer(f"{d}/tokenizer.json").eos_id
    row = (found["vocab_size"], found["merges"], found["model_type"], len(found["added_tokens"]), ",".join(found["config_keys"]), found["special_tokens"]["eos_token"], bool(found["chat_template"]), eos)
    return spark.createDataFrame([row], "vocab_size long, merges long, model_type string, added long, config_keys string, eos_token string, has_template boolean, eos_id long")


@query("""WITH f AS (SELECT string_agg(n_name || chr(10), '' ORDER BY n_nationkey) AS c FROM nation)
SELECT CAST(strlen(c) AS BIGINT) AS length, sha256(c) AS sha256, sha256(sha256(c)) AS whole FROM f""")
def file_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash of a file's bytes, and the hash over all files' hashes in order of their names."""
    path = _folder(spark, "hashed")
    t(spark, sf_dir, "nation").orderBy("n_nationkey").select("n_name").coalesce(1).write.text(path)
    files = readers.file_digests(spark, f"{path}/*.txt")
    return files.select("length", "sha256").crossJoin(F.broadcast(readers.ordered_digest(files).select(F.col("sha256").alias("whole"))))


# ---- sinks


@query("""WITH n AS (SELECT conv_id, epoch_us(ingested_at) AS at, list_transform(conversations, lambda m: coalesce(length(m.content), 0)) AS x FROM sft_t2t_mini WHERE conversations IS NOT NULL)
SELECT conv_id, "at", CAST(len(x) AS INT) AS n, array_to_string(list_concat(x, list_transform(range(greatest(0, 64 - len(x))), lambda i: 0)), ',') AS row FROM n""")
def dense_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays padded to one length, beside their own."""
    path = _folder(spark, "dense")
    rows = t(spark, sf_dir, "sft_t2t_mini").where("conversations IS NOT NULL")
    rows = rows.select("conv_id", F.unix_micros(F.col("ingested_at").cast("timestamp")).alias("at"), F.transform("conversations", lambda m: F.coalesce(F.length(m["content"]), F.lit(0))).alias("x"))
    sinks.padded(rows, "x", 64).write.parquet(path)
    return spark.read.parquet(path).select("conv_id", "at", F.col("x_len").alias("n"), F.array_join("x", ",").alias("row"))


@query("SELECT CAST(sum(strlen(text)) AS BIGINT) AS n, CAST(4 * sum(strlen(text)) AS BIGINT) AS bytes FROM pretrain_t2t WHERE text IS NOT NULL AND text <> ''")
def flat_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token arrays as flat int32 files, counted by number and bytes."""
    rows = t(spark, sf_dir, "pretrain_t2t").where("text IS NOT NULL AND text <> ''")
    path = _folder(spark, "bins")
    sinks.flat_int32(encode_texts(rows, ByteTokenizer(), "row_id", "text"), "ids", ["id"]).write.parquet(path)
    return spark.read.parquet(path).agg(F.sum("n").alias("n"), F.sum(F.octet_length("data")).cast("bigint").alias("bytes"))


@query(_SCORED + "SELECT idx, md5(text) AS text, score, 'score: ' || CAST(score AS INT) AS judge_raw FROM s")
def scored_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored samples written as JSON lines and read back."""
    path = _folder(spark, "scored")
    rows = _scored(spark, sf_dir).withColumn("judge_raw", F.concat(F.lit("score: "), F.col("score").cast("int")))
    sinks.write_lines(rows.select("idx", "text", judge.parse_score(F.col("judge_raw")).alias("score"), "judge_raw"), path)
    return spark.read.schema(schemas.SCORED).json(path).select("idx", F.md5("text").alias("text"), "score", "judge_raw")
