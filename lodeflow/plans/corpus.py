"""The corpus job, near duplicates to packed vectors and manifest, and supervised conversations, with SQL for all of it.

The SQL restates the sketches in integer arithmetic, the neighbours of each bucket by windows, and packing by recursion.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeflow.functions.text import digest
from lodeflow.operators import chat, dedup, evals, packing
from lodeflow.operators.tokenizers import ByteTokenizer, decode_ids, encode_texts
from lodeflow.plans.registry import _GATED, _LIFTED, _MARKS, _STRIP, _TURNS, _WS, query, t
from lodeflow.session import materialize
from lodeflow.sources import sinks

PRETRAIN_LEN, SFT_LEN = 4096, 8192
_LOW = "4294967295::UBIGINT"
_POLY = "0::UBIGINT"
for _k in range(1, dedup.SHINGLE + 1):
    _POLY = f"(({_POLY}) * 1000003::UBIGINT + (unicode(substring(w, {_k}, 1)) + 1)::UBIGINT) & {_LOW}"
_MIXED = f"(xor(h, h >> 16) * 73244475::UBIGINT) & {_LOW}"
#: Sketches of the exact survivors: sig(row_id, k, v).
_SIGNED = _GATED.replace("WITH c AS", "WITH RECURSIVE c AS", 1) + rf"""
, kept AS MATERIALIZED (SELECT row_id, clean FROM o WHERE outcome = 'kept'),
x AS (SELECT row_id, regexp_replace({_STRIP % 'clean'}, '{_WS}+', ' ', 'g') AS t FROM kept),
s AS (SELECT row_id, t, CAST(greatest(1, length(t) - 4) AS BIGINT) AS total FROM x),
w AS (SELECT row_id, substring(t, i, 5) AS w FROM (SELECT row_id, t, unnest(range(1, total + 1, CAST(ceil(total / 4096.0) AS BIGINT))) AS i FROM s)),
h0 AS (SELECT DISTINCT row_id, {_POLY} AS h FROM w), h1 AS (SELECT row_id, {_MIXED} AS h FROM h0), h2 AS (SELECT row_id, {_MIXED} AS h FROM h1),
h3 AS (SELECT row_id, xor(h, h >> 16) AS h FROM h2),
m AS (SELECT k, ((k + 1) * 2654435769 + 40503) % 4294967296 AS a0 FROM range(64) AS r(k)),
mult AS (SELECT k, (CASE WHEN a0 % 2 = 0 THEN a0 + 1 ELSE a0 END)::UBIGINT AS a FROM m),
sig AS MATERIALIZED (SELECT row_id, k, min((h * a) & {_LOW}) AS v FROM h3, mult GROUP BY row_id, k)
"""
#: Rows that the near-duplicate stage drops, dropped(row_id), and what is left, survivors(row_id, clean).
_NEAR = _SIGNED + """
, b AS (SELECT row_id, k % 16 AS band, list(v ORDER BY k) AS key FROM sig GROUP BY ALL),
nb AS (SELECT DISTINCT lag(row_id) OVER (PARTITION BY band, key ORDER BY row_id) AS prev, row_id FROM b),
dropped AS MATERIALIZED (SELECT DISTINCT row_id FROM (SELECT p.prev, p.row_id FROM nb p JOIN sig u ON u.row_id = p.prev JOIN sig v ON v.row_id = p.row_id AND v.k = u.k
   GROUP BY p.prev, p.row_id HAVING count(*) FILTER (WHERE u.v = v.v) >= 52)),
survivors AS MATERIALIZED (SELECT row_id, clean FROM kept WHERE row_id NOT IN (SELECT row_id FROM dropped))
"""


def _packing_sql(max_len: int) -> str:
    """pieces(doc, seq, start, size, eos) of docs(doc, n), by recursion over the documents in order."""
    return f"""
, walk AS (SELECT -1::BIGINT AS doc, 0::BIGINT AS n, 0::BIGINT AS first, 0::BIGINT AS s0, 0::BIGINT AS k, 0::BIGINT AS seq, 0::BIGINT AS used
 UNION ALL SELECT doc, n, first, s0, k, s0 + k, CASE WHEN k > 0 THEN n - first - (k - 1) * {max_len - 1} ELSE u0 + first END + 1
 FROM (SELECT doc, n, s0, u0, first, CAST(ceil((n - first) / {max_len - 1}.0) AS BIGINT) AS k
  FROM (SELECT doc, n, s0, u0, least(n, {max_len} - u0 - 1) AS first
   FROM (SELECT d.doc, d.n, CASE WHEN {max_len} - w.used <= 1 THEN w.seq + 1 ELSE w.seq END AS s0, CASE WHEN {max_len} - w.used <= 1 THEN 0 ELSE w.used END AS u0 FROM walk w JOIN docs d ON d.doc = w.doc + 1)))),
parts AS (SELECT doc, n, first, s0 + j AS seq, CASE WHEN j = 0 THEN 0 ELSE first + (j - 1) * {max_len - 1} END AS start, j = k AS eos, j FROM (SELECT *, unnest(range(k + 1)) AS j FROM walk WHERE doc >= 0)),
pieces AS (SELECT doc, seq, start, eos, CASE WHEN j = 0 THEN first ELSE least({max_len - 1}, n - start) END AS size FROM parts)
"""


_TOKENIZED = _NEAR + ", docs AS MATERIALIZED (SELECT row_number() OVER (ORDER BY row_id) - 1 AS doc, row_id, CAST(strlen(clean) AS BIGINT) AS n, clean FROM survivors)"
_BYTES = "list_transform(regexp_extract_all(hex(encode(%s)), '..'), lambda b: ('0x' || b)::INT + 9)"
_VECTORS = """
SELECT 0::BIGINT AS shard, seq, md5(string_agg(array_to_string(ids[start + 1 : start + size], ',') || CASE WHEN eos THEN ',0' ELSE '' END, ',' ORDER BY doc, start) || repeat(',-1', {L} - CAST(sum(size + eos::INT) AS BIGINT))) AS input_ids,
 md5(string_agg(repeat(',' || doc, size + eos::INT), '' ORDER BY doc, start) || repeat(',-1', {L} - CAST(sum(size + eos::INT) AS BIGINT))) AS document_ids{more}
FROM pieces JOIN tok USING (doc) GROUP BY seq"""


def _digested(packed: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """Vectors by digest; documents with a comma in front."""
    joined = {"document_ids": F.concat(F.lit(","), F.array_join("document_ids", ","))}
    return packed.select(*(keys or ["shard", "seq"]), *(F.md5(joined.get(c, F.array_join(c, ","))).alias(c) for c in columns))


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(dedup.surviving_texts(t(spark, sf_dir, "pretrain_t2t")), ByteTokenizer())


# ---- near duplicates


@query(_NEAR + "SELECT outcome, count(*) AS n_rows, CAST(sum(n) AS BIGINT) AS n_chars FROM (SELECT CASE WHEN row_id IN (SELECT row_id FROM dropped) THEN 'near_dup' ELSE outcome END AS outcome, n FROM o) GROUP BY outcome")
def corpus_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outcomes of the whole job, with the rows that the near-duplicate stage removes."""
    return dedup.outcome_counts(dedup.corpus_outcomes(t(spark, sf_dir, "pretrain_t2t")))


@query(_NEAR + "SELECT row_id FROM dropped")
def near_duplicate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup.surviving_texts(t(spark, sf_dir, "pretrain_t2t"), near=False)
    return dedup.near_duplicate_drops(materialize(dedup.sketches(kept), "sketches")).select(F.col("id").alias("row_id"))


@query(_NEAR + "SELECT row_id, length(clean) AS n_chars FROM survivors")
def corpus_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.surviving_texts(t(spark, sf_dir, "pretrain_t2t")).select(F.col("id").alias("row_id"), F.length("clean").cast("bigint").alias("n_chars"))


@query(_SIGNED + "SELECT row_id, md5(string_agg(v::VARCHAR, ',' ORDER BY k)) AS sketch FROM sig GROUP BY row_id")
def text_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of the exact survivors, written to the shared folder and read back."""
    stored = materialize(dedup.sketches(dedup.surviving_texts(t(spark, sf_dir, "pretrain_t2t"), near=False)), "sketches")
    return stored.select(F.col("id").alias("row_id"), F.md5(F.array_join("sig", ",")).alias("sketch"))


@query(_SIGNED + """
, b AS (SELECT row_id, k % 16 AS band, list(v ORDER BY k) AS key FROM sig GROUP BY ALL),
nb AS (SELECT DISTINCT lag(row_id) OVER (PARTITION BY band, key ORDER BY row_id) AS a, row_id AS b FROM b)
SELECT p.a, p.b, count(*) FILTER (WHERE u.v = v.v) / 64.0::DOUBLE AS similarity FROM nb p JOIN sig u ON u.row_id = p.a JOIN sig v ON v.row_id = p.b AND v.k = u.k GROUP BY p.a, p.b""")
def bucket_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours in a bucket with the similarity of their sketches, above the threshold or not."""
    signed = materialize(dedup.sketches(dedup.surviving_texts(t(spark, sf_dir, "pretrain_t2t"), near=False)), "sketches")
    return dedup.neighbour_similarities(signed).select("a", F.col("id").alias("b"), "similarity")


# ---- tokens, packing, manifest


@query(_TOKENIZED + "SELECT row_id, n AS tokens FROM docs")
def corpus_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of the texts that are packed, without near duplicates."""
    return _tokens(spark, sf_dir).select(F.col("id").alias("row_id"), F.col("n").cast("bigint").alias("tokens"))


_PIECES = _TOKENIZED + _packing_sql(PRETRAIN_LEN)


@query(_PIECES + "SELECT row_id, doc::INT AS doc, seq, start::INT AS start, size::INT AS size, eos FROM pieces JOIN docs USING (doc)")
def packing_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document's pieces go, from lengths alone."""
    lengths = materialize(_tokens(spark, sf_dir).select("id", "n"), "token-lengths")
    return packing.pieces_of(lengths, PRETRAIN_LEN).select(F.col("id").alias("row_id"), "doc", "seq", "start", "size", "eos")


@query(_PIECES + f", tok AS (SELECT doc, {_BYTES % 'clean'} AS ids FROM docs)" + _VECTORS.format(L=PRETRAIN_LEN, more=""))
def packed_pretrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole job: clean, gate, exact and near duplicates, tokenize, pack. Vectors come out by digest."""
    return _digested(packing.pack(_tokens(spark, sf_dir), PRETRAIN_LEN, ByteTokenizer().eos_id), ["input_ids", "document_ids"])


@query(_PIECES + """SELECT count(*) AS n_rows, count(*) FILTER (WHERE outcome = 'kept') AS kept_rows, count(*) FILTER (WHERE outcome = 'too_short') AS too_short, count(*) FILTER (WHERE outcome = 'too_long') AS too_long,
 count(*) FILTER (WHERE outcome = 'exact_dup') AS removed_exact, (SELECT count(*) FROM dropped) AS removed_minhash, (SELECT count(DISTINCT seq) FROM pieces) AS sequences, CAST((SELECT sum(size + eos::INT) FROM pieces) AS BIGINT) AS tokens FROM o""")
def corpus_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All counters of one run; rows removed as near duplicates stay among the kept ones, as in the reference."""
    return _counters(spark, sf_dir)


def _counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, kept = dedup.corpus_stages(t(spark, sf_dir, "pretrain_t2t"))
    lengths = materialize(encode_texts(kept, ByteTokenizer()).select("id", "n"), "token-lengths")
    of = lambda *names: F.count_if(F.col("outcome").isin(*names))
    rows = found.agg(
        F.count("*").alias("n_rows"), of("kept", "near_dup").alias("kept_rows"), of("too_short").alias("too_short"), of("too_long").alias("too_long"),
        of("exact_dup").alias("removed_exact"), of("near_dup").alias("removed_minhash"),
    )
    return rows.crossJoin(F.broadcast(packing.piece_counts(packing.pieces_of(lengths, PRETRAIN_LEN), PRETRAIN_LEN).select("sequences", "tokens")))


@query(_PIECES + """, r AS (SELECT bit_xor(('0x' || substr(sha256(row_id || ':' || text), 1, 15))::BIGINT) AS x FROM pretrain_t2t WHERE text IS NOT NULL)
SELECT to_json(struct_pack(source := 'pretrain_t2t', source_digest := printf('%016x', x), backend := 'parquet', max_len := 4096, dtype := 'int32', tokenizer_vocab := 265, stats := struct_pack(
 n_rows := (SELECT count(*) FROM o), kept_rows := (SELECT count(*) FROM kept), too_short := (SELECT count(*) FROM o WHERE outcome = 'too_short'), too_long := (SELECT count(*) FROM o WHERE outcome = 'too_long'),
 removed_exact := (SELECT count(*) FROM o WHERE outcome = 'exact_dup'), removed_minhash := (SELECT count(*) FROM dropped), sequences := (SELECT count(DISTINCT seq) FROM pieces), tokens := CAST((SELECT sum(size + eos::INT) FROM pieces) AS BIGINT))))::VARCHAR AS value FROM r""")
def packed_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of the whole job. Its counts come from lengths and outcomes; no token vector is made for it."""
    stats = _counters(spark, sf_dir).select(F.struct("*").alias("stats"))
    source = sinks.content_digest(t(spark, sf_dir, "pretrain_t2t"), "row_id", "text")
    facts = {"source": "pretrain_t2t", "source_digest": F.col("source_digest"), "backend": "parquet", "max_len": PRETRAIN_LEN, "dtype": "int32", "tokenizer_vocab": ByteTokenizer().vocab_size}
    return sinks.manifest(stats.crossJoin(F.broadcast(source)), facts, ["stats"])


# ---- supervised conversations

#: A text's tokens: control strings whole, everything else by bytes.
_PARTS = "regexp_extract_all(%s, '" + "|".join(m.replace("|", "\\|") for m in _MARKS) + "|[^<]+|<')"
_IDS = "flatten(list_transform(" + _PARTS + ", lambda p: CASE " + " ".join(f"WHEN p = '{m}' THEN [{i}]" for i, m in enumerate(_MARKS)) + f" ELSE {_BYTES % 'p'} END))"
_TURN = r"(?s)(<\|im_start\|>assistant\n)(.*?)(<\|im_end\|>)"


def _labelled_sql(max_len: int) -> str:
    return rf"""WITH RECURSIVE one AS (SELECT conv_id, arg_min(conversations, ingested_at) AS conversations FROM sft_t2t_mini GROUP BY conv_id),
x AS (SELECT conv_id, {_LIFTED.replace('%s', 'conversations')} || {_TURNS % 'conversations'} AS x FROM one WHERE len(conversations) > 0),
y AS (SELECT conv_id, x, regexp_split_to_array(x, '{_TURN}') AS outer_parts, regexp_extract_all(x, '{_TURN}', 1) AS heads, regexp_extract_all(x, '{_TURN}', 2) AS bodies FROM x),
z AS (SELECT conv_id, unnest(range(1, len(outer_parts) + 1)) AS i, outer_parts, heads, bodies FROM y),
seg AS (SELECT conv_id, i, 0 AS part, outer_parts[i] AS txt FROM z UNION ALL SELECT conv_id, i, 1, heads[i] FROM z WHERE i <= len(bodies) UNION ALL SELECT conv_id, i, 2, bodies[i] FROM z WHERE i <= len(bodies)
 UNION ALL SELECT conv_id, i, 3, '<|im_end|>' FROM z WHERE i <= len(bodies)),
ids AS (SELECT conv_id, i, part, {_IDS % 'txt'} AS ids FROM seg WHERE txt <> ''),
whole AS (SELECT conv_id, flatten(list(ids ORDER BY i, part)) AS ids, flatten(list(CASE WHEN part = 2 THEN ids ELSE list_transform(ids, lambda v: -100) END ORDER BY i, part)) AS labels FROM ids GROUP BY conv_id),
cut AS MATERIALIZED (SELECT conv_id, ids[1 : {max_len}] AS ids, labels[1 : {max_len}] AS labels FROM whole),
docs AS MATERIALIZED (SELECT row_number() OVER (ORDER BY conv_id) - 1 AS doc, conv_id, CAST(len(ids) AS BIGINT) AS n, ids, labels FROM cut WHERE len(list_filter(labels, lambda v: v <> -100)) > 0)"""


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "sft_t2t_mini").groupBy("conv_id").agg(F.min_by("conversations", "ingested_at").alias("conversations"))
    return chat.labelled(chat.sft_texts(rows), ByteTokenizer(), SFT_LEN)


def _packed_sft(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_labelled(spark, sf_dir), SFT_LEN, ByteTokenizer().eos_id, labels_col="labels")


@query(_labelled_sql(SFT_LEN) + "SELECT conv_id, len(ids)::INT AS tokens, len(list_filter(labels, lambda v: v <> -100))::INT AS supervised, md5(array_to_string(labels, ',')) AS labels FROM docs")
def supervised_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _labelled(spark, sf_dir)
    return found.select(F.col("id").alias("conv_id"), F.size("ids").alias("tokens"), F.size(F.filter("labels", lambda x: x != chat.IGNORED)).alias("supervised"), F.md5(F.array_join("labels", ",")).alias("labels"))


_SFT_PIECES = _labelled_sql(SFT_LEN) + _packing_sql(SFT_LEN) + ", tok AS (SELECT doc, ids, labels FROM docs)"
_LABELS = ", md5(string_agg(array_to_string(labels[start + 1 : start + size], ',') || CASE WHEN eos THEN ',-100' ELSE '' END, ',' ORDER BY doc, start) || repeat(',-100', {L} - CAST(sum(size + eos::INT) AS BIGINT))) AS labels"


@query(_SFT_PIECES + _VECTORS.format(L=SFT_LEN, more=_LABELS.format(L=SFT_LEN)))
def packed_sft(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digested(_packed_sft(spark, sf_dir), ["input_ids", "document_ids", "labels"])


@query(_SFT_PIECES + f"SELECT count(DISTINCT seq) AS sequences, count(DISTINCT seq) * {SFT_LEN} AS slots, CAST(sum(size + eos::INT) AS BIGINT) AS tokens FROM pieces")
def packed_sft_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots, padding included, beside real tokens."""
    return packing.packed_counts(_packed_sft(spark, sf_dir))


@query(_SFT_PIECES + f"""
, lab AS (SELECT seq, flatten(list(labels[start + 1 : start + size] || CASE WHEN eos THEN [-100] ELSE [] END ORDER BY doc, start)) AS labels,
 flatten(list(ids[start + 1 : start + size] || CASE WHEN eos THEN [0] ELSE [] END ORDER BY doc, start)) AS ids FROM pieces JOIN tok USING (doc) GROUP BY seq)
SELECT seq, md5(array_to_string(ids[1 : 128], ',') || repeat(',-1', greatest(0, 128 - len(ids)))) AS prefix_ids FROM lab WHERE len(list_filter(labels, lambda v: v <> -100)) >= 160""")
def continuation_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heads of the sequences with enough supervised places to be continued."""
    return evals.continuable(_packed_sft(spark, sf_dir)).select("seq", F.md5(F.array_join("prefix_ids", ",")).alias("prefix_ids"))


@query(_labelled_sql(SFT_LEN) + "SELECT conv_id, md5(x) AS text FROM x")
def decoded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole conversations encoded and decoded again."""
    rows = t(spark, sf_dir, "sft_t2t_mini").groupBy("conv_id").agg(F.min_by("conversations", "ingested_at").alias("conversations"))
    tok = ByteTokenizer()
    back = decode_ids(encode_texts(chat.sft_texts(rows), tok, text_col="text"), tok)
    return back.select(F.col("id").alias("conv_id"), F.md5("text").alias("text"))
