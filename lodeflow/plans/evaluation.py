"""Evaluation reports, prompts, groups joined to prompts and truths, and schedules."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeflow.functions import formulas, text, tools
from lodeflow.operators import chat, evals, preference, profile
from lodeflow.operators.tokenizers import ByteTokenizer, decode_ids, encode_texts
from lodeflow.plans.registry import _ANSWERS, _HEAD, _LIFTED, _NO_LAST, _NORMAL, _RAW, _RULE, _SCORED, _SIDES, _STATS, _STRIP, _TOOLS, _TURNS, _scored, _sides, query, t
from lodeflow.session import work_root
from lodeflow.sources import sinks

STEP, STAMP = 200, "2026-01-01T00:00:00"

# ---- sample evaluation

_REP = """g AS (SELECT kind, pair_id, substring(s, i, 4) AS gram FROM r, unnest(range(1, greatest(length(s) - 2, 1))) AS q(i)),
n AS (SELECT kind, pair_id, gram, count(*) AS n FROM g GROUP BY ALL),
rp AS (SELECT kind, pair_id, CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS DOUBLE) / sum(n) AS rep FROM n GROUP BY ALL)"""
_RECORDS = _SIDES + f""", r AS (SELECT 'thinking_on' AS kind, pair_id, x AS prompt, x AS output, {_STRIP % 'x'} AS s FROM s UNION ALL SELECT 'thinking_off', pair_id, x, y, {_STRIP % 'y'} FROM s),
{_REP},
e AS (SELECT r.kind, r.pair_id, left(prompt, 120) AS prompt, output, length(output) AS n_chars, length(regexp_extract(output, '(?s)<think>(.*?)</think>', 1)) AS think_chars, round_even(coalesce(rep, 0.0), 4)::DOUBLE AS rep4
 FROM r LEFT JOIN rp ON rp.kind = r.kind AND rp.pair_id = r.pair_id)"""
_METRICS = """, per AS (SELECT pair_id, max(n_chars) FILTER (WHERE kind = 'thinking_on') AS a, max(n_chars) FILTER (WHERE kind = 'thinking_off') AS b, count(*) FILTER (WHERE kind = 'thinking_on' AND think_chars > 0) AS t FROM e GROUP BY pair_id),
m AS (SELECT round_even(sum(t) / greatest(count(*), 1)::DOUBLE, 4)::DOUBLE AS think_trigger_rate, round_even(sum(a / greatest(b, 1)::DOUBLE) / greatest(count(*), 1), 4)::DOUBLE AS mean_length_ratio FROM per),
q AS (SELECT round_even(sum(rep4) / greatest(count(*), 1), 4)::DOUBLE AS rep4_mean FROM e)"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _sides(spark, sf_dir)
    on = evals.eval_records(s, F.lit("thinking_on"), F.col("x"), F.col("x"))
    return on.unionByName(evals.eval_records(s, F.lit("thinking_off"), F.col("x"), F.col("y")))


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evals.sample_metrics(_records(spark, sf_dir), "pair_id")


def _gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evals.quality_gate(_metrics(spark, sf_dir), evals.judge_mean(_scored(spark, sf_dir)))


@query(_RECORDS + "SELECT kind, pair_id, md5(prompt) AS prompt, n_chars, think_chars, rep4 FROM e")
def eval_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).select("kind", "pair_id", F.md5("prompt").alias("prompt"), "n_chars", "think_chars", "rep4")


@query(_RECORDS + _METRICS + "SELECT * FROM m, q")
def sample_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, sf_dir)


_JUDGED = _SCORED.split(", b AS (", 1)[1]
_GATE = _RECORDS + _METRICS + f""", b AS ({_JUDGED}, j AS (SELECT avg(score) AS jm, count(*) AS judge_n FROM s1),
gate AS (SELECT think_trigger_rate, mean_length_ratio, rep4_mean, round_even(jm, 2)::DOUBLE AS judge_mean, judge_n, think_trigger_rate >= 0.3 AS pass_think, rep4_mean <= 0.55 AS pass_rep, jm >= 4.0 AS pass_judge FROM m, q, j)
"""
_GATE = _GATE.replace("s AS (SELECT pair_id AS idx", "s1 AS (SELECT pair_id AS idx")


@query(_GATE + "SELECT *, pass_think AND pass_rep AND pass_judge AS pass_all FROM gate")
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gate(spark, sf_dir)


@query(_GATE + """SELECT '# SFT 质量报告' || chr(10) || chr(10) || '- 思考触发率：' || think_trigger_rate || chr(10) || '- rep-4 重复度：' || rep4_mean || chr(10) || '- judge 均分（' || judge_n || ' 条）：' || printf('%.2f', judge_mean) || ' / 10' || chr(10)
 || '- 判定：**' || CASE WHEN pass_think AND pass_rep AND pass_judge THEN '通过' ELSE '未通过' END || '**' || chr(10) AS report FROM gate""")
def gate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate written as JSON, read back, and its report; one row."""
    path = f"{work_root(spark)}/gate-{uuid.uuid4().hex}"
    gate = _gate(spark, sf_dir)
    sinks.write_lines(gate, path)
    stored = spark.read.schema(gate.schema).json(path).first().asDict()
    return spark.createDataFrame([(sinks.gate_report(stored),)], "report string")


@query(_RECORDS + _METRICS + f""", lines AS (SELECT md5('## [' || kind || '] ' || prompt || chr(10) || output || chr(10) || chr(10)) AS line FROM e
 UNION ALL SELECT md5('# 定时抽查 step={STEP}  {STAMP}' || chr(10) || '# think_trigger_rate=' || think_trigger_rate || ' length_ratio=' || mean_length_ratio || ' rep4=' || rep4_mean || ' ppl=None' || chr(10) || chr(10)) FROM m, q)
SELECT line, count(*) AS n FROM lines GROUP BY line""")
def sample_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The readable report on sampled outputs, line by line."""
    records = _records(spark, sf_dir).select(F.xxhash64("kind", "pair_id").alias("place"), "kind", "prompt", "output")
    report = sinks.sample_report(records, _metrics(spark, sf_dir).withColumn("ppl", F.lit(None).cast("double")), STEP, STAMP)
    return report.groupBy(F.md5("line").alias("line")).agg(F.count("*").alias("n"))


@query(_RECORDS + _METRICS + f"SELECT '{STAMP}' AS ts, {STEP} + k AS step, think_trigger_rate, mean_length_ratio, rep4_mean FROM m, q, range(2) AS r(k)")
def metrics_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stamped lines of metrics appended to one log by two runs."""
    path = f"{work_root(spark)}/metrics-{uuid.uuid4().hex}"
    m = _metrics(spark, sf_dir)
    for k in range(2):
        sinks.write_metrics(m, path, STEP + k, STAMP)
    return spark.read.schema("ts string, step long, think_trigger_rate double, mean_length_ratio double, rep4_mean double").json(path)


@query(_RECORDS + "SELECT pair_id, kind, n_chars FROM e WHERE kind = 'thinking_on' ORDER BY pair_id LIMIT 20")
def first_of_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first records of a kind, which a judge is shown; the limit is the operator."""
    return preference.first_of_kind(_records(spark, sf_dir), "thinking_on", "pair_id", 20).select("pair_id", "kind", "n_chars")


@query("SELECT row_id, shard FROM pretrain_t2t WHERE row_id < 1000")
def first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows up to a limit of ordinals; the limit is the operator."""
    return preference.first_rows(t(spark, sf_dir, "pretrain_t2t").select("row_id", "shard"), "row_id", 1000)


# ---- prompts, groups, truths


@query("""SELECT item_id, md5('<|im_start|>user' || chr(10) || question || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || '<think>' || chr(10)) AS thinking,
 md5('<|im_start|>user' || chr(10) || question || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || '<think>' || chr(10) || chr(10) || '</think>' || chr(10) || chr(10)) AS plain FROM eval_items""")
def thinking_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("question")
    return t(spark, sf_dir, "eval_items").select("item_id", F.md5(chat.prompt_text(q, True)).alias("thinking"), F.md5(chat.prompt_text(q, False)).alias("plain"))


@query("""SELECT task_id, md5('<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || '<tool_response>' || chr(10) || array_to_string(gt, chr(10)) || chr(10) || '</tool_response><|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || '<think>' || chr(10)) AS turn
FROM agent_rl WHERE gt IS NOT NULL""")
def tool_response_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "agent_rl").where("gt IS NOT NULL").select("task_id", F.md5(tools.tool_response(F.col("gt"))).alias("turn"))


@query("SELECT task_id, strftime(ingested_at, '%Y-%m-%d %H:%M:%S') AS clock FROM agent_rl")
def clock_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "agent_rl").select("task_id", tools.clock(F.col("ingested_at")).alias("clock"))


@query(_SCORED + f""", k AS (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY score DESC, seq) AS hi, row_number() OVER (PARTITION BY idx ORDER BY score, seq DESC) AS lo FROM s),
p AS (SELECT idx, md5(max(text) FILTER (WHERE hi = 1)) AS chosen, md5(max(text) FILTER (WHERE lo = 1)) AS rejected FROM k GROUP BY idx),
r AS (SELECT prompt_id AS idx, min({_TURNS % ('(' + _NO_LAST + ')')} || {_HEAD}) AS prompt FROM rlaif WHERE conversations IS NOT NULL GROUP BY prompt_id)
SELECT idx, chosen, rejected, md5(prompt) AS prompt FROM p JOIN r USING (idx)""")
def pairs_with_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best and worst samples joined to the token ids of the prompt they answer, decoded."""
    prompts = preference.rlaif_prompts(t(spark, sf_dir, "rlaif")).groupBy("id").agg(F.min("text").alias("text"))
    ids = encode_texts(prompts, ByteTokenizer(), text_col="text").select(F.col("id").alias("idx"), F.col("ids").alias("prompt_ids"), F.col("n").alias("prompt_len"))
    found = preference.pairs_with_prompts(preference.best_and_worst(_scored(spark, sf_dir)), ids)
    texts = decode_ids(found, ByteTokenizer(), "idx", "prompt_ids").select(F.col("id").alias("idx"), F.md5("text").alias("prompt"))
    return found.select("idx", F.md5("chosen").alias("chosen"), F.md5("rejected").alias("rejected")).join(texts, "idx")


_HAS_TOOLS = f"{_STRIP % ('coalesce(' + _TOOLS.replace('%s', 'conversations') + ", '')")} <> '' AND coalesce(json_valid({_TOOLS.replace('%s', 'conversations')}), false)"


@query(f"""WITH a AS (SELECT task_id, gt, {_HAS_TOOLS} AS e FROM agent_rl WHERE conversations IS NOT NULL AND len(gt) > 0),
x AS (SELECT task_id AS idx, gt, e, 0 AS seq, '<think>' || chr(10) || '按步骤推理并计算，得到答案 ' || gt[1] || '。' || chr(10) || '</think>' || chr(10) || chr(10)
  || CASE WHEN e THEN '<tool_call>' || chr(10) || '{{"name": "calculate_math", "arguments": {{"expression": "1+1"}}}}' || chr(10) || '</tool_call>' || chr(10) ELSE '' END || '答案是 ' || gt[1] || '。' AS text FROM a
 UNION ALL SELECT task_id, gt, e, 1, '<think>' || task_id || '</think>' || task_id FROM a),
n AS (SELECT idx, seq, e, text, {_NORMAL % 'text'} AS final, list_filter(list_transform(gt, lambda v: {_NORMAL % 'v'}), lambda v: v <> '') AS gs FROM x)
SELECT idx, seq, round(0.3 * (0.5 + CASE WHEN e AND seq = 0 THEN 0.5 ELSE 0 END) + 0.2 * CASE WHEN e AND seq = 0 THEN 1 ELSE 0 END
 + 0.5 * CASE WHEN len(list_filter(gs, lambda v: coalesce(abs(try_cast(final AS DOUBLE) - try_cast(v AS DOUBLE)) < 1e-6, false) OR contains(final, v) OR contains(v, final))) > 0 THEN 1 ELSE 0 END, 9)::DOUBLE AS reward FROM n""")
def samples_with_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples joined to the truth of their task by index and rewarded; a right answer in the right form gets 1 where a tool is expected."""
    truths = preference.agent_prompts(t(spark, sf_dir, "agent_rl")).select(F.col("id").alias("idx"), "gt", "expect_tool")
    right = truths.select("idx", F.lit(0).alias("seq"), tools.gold_text(F.col("gt"), F.col("expect_tool")).alias("text"))
    other = truths.select("idx", F.lit(1).alias("seq"), F.concat(F.lit("<think>"), F.col("idx").cast("string"), F.lit("</think>"), F.col("idx").cast("string")).alias("text"))
    joined = preference.samples_with_truth(right.unionByName(other), truths).withColumn("calls", tools.tool_calls(F.col("text")))
    reward = tools.composite_reward(F.col("text"), F.col("calls"), F.col("expect_tool"), F.col("gt"))
    return joined.select("idx", "seq", F.round(reward, 9).alias("reward"))


# ---- needle, shapes, profile


@query(f"""WITH c AS (SELECT id, context FROM range(1, 6) AS r(id), (VALUES (4000), (8000), (16000), (32000)) AS v(context)),
f AS (SELECT {text.FILLERS!r} AS fill), h AS (SELECT id, context, fill, list_transform(range(1, CAST(ceil(context / {min(map(len, text.FILLERS))}.0) AS BIGINT) + 1), lambda i: fill[('0x' || left(md5(id || ':' || i), 7))::INT % 7 + 1]) AS chosen FROM c, f),
u AS (SELECT id, context, generate_subscripts(chosen, 1) AS i, unnest(chosen) AS s FROM h),
w AS (SELECT id, context, i, s, coalesce(sum(length(s)) OVER (PARTITION BY id, context ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM u),
k AS (SELECT id, context, string_agg(s, '' ORDER BY i) AS hay FROM w WHERE before < context GROUP BY id, context),
p AS (SELECT id, context, hay, ('0x' || left(md5(id || ':0'), 7))::INT % greatest(1, length(hay) - 20) AS at0 FROM k)
SELECT id, context, md5('{text.NEEDLE_HEAD}' || left(hay, at0) || '{text.NEEDLE}' || substring(hay, CAST(at0 + 1 + {len(text.NEEDLE)} AS BIGINT)) || '{text.NEEDLE_TAIL}') AS prompt, true AS hit FROM p""")
def needle_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.range(1, 6).crossJoin(F.broadcast(spark.createDataFrame([(4000,), (8000,), (16000,), (32000,)], "context int")))
    prompts = rows.withColumn("prompt", text.needle_prompt(F.col("context"), F.col("id")))
    return prompts.select("id", "context", F.md5("prompt").alias("prompt"), text.needle_hit(F.col("prompt")).alias("hit"))


_SHAPE = "json_structure(j)::VARCHAR"
for _a, _b in (('"NULL"', "NoneType"), ('"VARCHAR"', "str"), ('"UBIGINT"', "int"), ('"BIGINT"', "int"), ('"DOUBLE"', "float"), ('"BOOLEAN"', "bool"), ('"', "")):
    _SHAPE = f"replace({_SHAPE}, '{_a}', '{_b}')"
_SHAPES = f"""calls AS (SELECT m.tool_calls AS j FROM (SELECT unnest(conversations) AS m FROM sft_t2t_mini) WHERE m.tool_calls IS NOT NULL AND json_valid(m.tool_calls)),
shapes AS (SELECT {_SHAPE} AS shape, count(*) AS n FROM calls GROUP BY 1)"""


@query(f"WITH {_SHAPES} SELECT shape, n FROM shapes")
def tool_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "sft_t2t_mini").select(F.explode("conversations").alias("m")).where("m.tool_calls IS NOT NULL")
    return profile.shape_counts(rows, F.col("m.tool_calls"))


_PROFILE = f"""WITH {_SHAPES},
ms AS (SELECT unnest(conversations) AS m FROM sft_t2t_mini),
mk AS (SELECT CASE WHEN contains(x, 'tool_call') THEN 'tool_call' WHEN contains(x, 'function_call') THEN 'function_call' WHEN contains(x, '"tools"') THEN '"tools"'
  WHEN contains(x, '"observation"') THEN '"observation"' WHEN contains(x, '"action"') THEN '"action"' END AS marker FROM (SELECT {_RAW} AS x FROM sft_t2t_mini WHERE conversations IS NOT NULL)),
ln AS (SELECT list_sort(list(CAST(coalesce(list_sum(list_transform(conversations, lambda m: coalesce(length(m.content), 0))), 0) AS BIGINT))) AS s FROM sft_t2t_mini WHERE conversations IS NOT NULL),
st AS (SELECT {_STATS} FROM ln),
rs AS (SELECT len(list_filter(coalesce(conversations, []), lambda m: {_STRIP % "coalesce(m.reasoning_content, '')"} <> '')) AS n FROM sft_t2t_mini),
parts AS (SELECT 'count' AS section, 'records' AS name, count(*)::DOUBLE AS value FROM sft_t2t_mini
 UNION ALL SELECT 'key', k, n FROM (SELECT unnest(['conv_id', 'conversations', 'mix', 'created_at', 'ingested_at']) AS k, unnest([count(conv_id), count(conversations), count(mix), count(created_at), count(ingested_at)]) AS n FROM sft_t2t_mini) WHERE n > 0
 UNION ALL SELECT 'role', m.role, count(*) FROM ms WHERE m.role IS NOT NULL GROUP BY m.role
 UNION ALL SELECT 'marker', marker, count(*) FROM mk WHERE marker IS NOT NULL GROUP BY marker
 UNION ALL SELECT 'shape', shape, n FROM shapes
 UNION ALL SELECT 'reasoning', 'messages', sum(n) FROM rs UNION ALL SELECT 'reasoning', 'records', count(*) FILTER (WHERE n > 0) FROM rs
 UNION ALL SELECT 'char_len', name, value FROM (UNPIVOT (SELECT n::DOUBLE AS n, total_chars::DOUBLE AS total_chars, mean_chars, {', '.join(f'{q}::DOUBLE AS {q}' for q in profile.QUANTILES)}, min_chars::DOUBLE AS min_chars, max_chars::DOUBLE AS max_chars FROM st) ON COLUMNS(*) INTO NAME name VALUE value))
"""


def _raw(messages: str = "conversations"):
    field = lambda m, c, head: F.coalesce(F.concat(F.lit(head), m[c]), F.lit(""))
    return F.array_join(F.transform(messages, lambda m: F.concat_ws(" ", F.coalesce(m["content"], F.lit("")), field(m, "tools", '"tools": '), field(m, "tool_calls", '"tool_calls": '))), " ")


@query(_PROFILE + "SELECT section, name, value FROM parts")
def profile_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile of the conversations: keys, roles, reasoning, markers, shapes, lengths."""
    return profile.report_rows(t(spark, sf_dir, "sft_t2t_mini"), _raw())


@query(_PROFILE + "SELECT section, count(*) AS names FROM parts GROUP BY section")
def profile_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as one JSON document, opened again by section."""
    doc = profile.report(profile.report_rows(t(spark, sf_dir, "sft_t2t_mini"), _raw()))
    opened = doc.select(F.explode(F.from_json("value", "map<string, map<string, double>>")).alias("section", "m"))
    return opened.select("section", F.size("m").cast("bigint").alias("names"))


# ---- schedules


@query("SELECT s AS step, round(CASE WHEN s >= 100 THEN 0.1 ELSE 0.1 + 0.45 * (1 + cos(pi() * (s - 40) / 60.0)) END, 12)::DOUBLE AS rate FROM range(40, 121) AS r(s)")
def resumed_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = spark.range(40, 121).withColumnRenamed("id", "step")
    return steps.withColumn("rate", F.round(formulas.cosine_resume_rate(F.col("step"), 40, 100, 1.0, 0.1), 12))


@query("""WITH k AS (SELECT c_custkey AS id, CAST(1000 + c_custkey % 500 AS BIGINT) AS n, CAST(c_custkey % 300 AS BIGINT) AS step FROM customer),
p AS (SELECT id, step, CAST(floor(ceil((n - 200) / 16.0) * 3 / 2) AS BIGINT) AS total FROM k), w AS (SELECT id, step, total, CAST(floor(total * 0.1) AS BIGINT) AS warm FROM p)
SELECT id, round(CASE WHEN step < warm THEN 0.003 * (step + 1) / greatest(1, warm) WHEN step >= total THEN 0.003 * 0.1 ELSE 0.003 * (0.1 + 0.45 * (1 + cos(pi() * (step - warm) / greatest(1, total - warm)))) END, 12)::DOUBLE AS rate FROM w""")
def interrupted_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate at which runs of different sizes stood when they broke off."""
    rows = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 300).cast("bigint").alias("step"), (1000 + F.col("c_custkey") % 500).cast("bigint").alias("n"))
    run = F.struct(F.col("n").alias("sequences"), *(F.lit(v).alias(k) for k, v in {"held_out": 200, "batch": 8, "workers": 2, "accumulate": 2, "epochs": 3, "warmup_share": 0.1, "rate": 0.003, "floor": 0.1}.items()))
    return rows.select("id", F.round(formulas.interrupted_rate(run, F.col("step")), 12).alias("rate"))
