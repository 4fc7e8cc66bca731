"""All registered queries of the core, with the SQL that checks them.

Every query runs over whole tables. Columns are named alike on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeflow.functions import formulas, judge, text, tools
from lodeflow.operators import chat, dedup, evals, preference, profile
from lodeflow.operators.tokenizers import ByteTokenizer, encode_texts
from lodeflow.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# pieces of SQL that several checks share
_WS = r"[\s\x{000B}\x{0085}\p{Z}]"
_STRIP = rf"regexp_replace(%s, '^{_WS}+|{_WS}+$', '', 'g')"
_CLEAN = _STRIP % r"regexp_replace(regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', ' ', 'g'), '[ \t]+', ' ', 'g')"
_GATED = f"""
WITH c AS (SELECT row_id, {_CLEAN} AS clean FROM pretrain_t2t WHERE text IS NOT NULL),
g AS (SELECT row_id, clean, length(clean) AS n, sha256(clean) AS d,
             CASE WHEN length(clean) < 32 THEN 'too_short' WHEN length(clean) > 100000 THEN 'too_long' END AS gate FROM c),
o AS (SELECT row_id, clean, n, d, coalesce(gate, CASE WHEN row_number() OVER (PARTITION BY d, gate ORDER BY row_id) = 1 THEN 'kept' ELSE 'exact_dup' END) AS outcome FROM g)
"""
_ANSWERS = """
WITH both_sides AS (SELECT pair_id, 0 AS side, chosen AS m FROM dpo UNION ALL SELECT pair_id, 1, rejected FROM dpo),
a AS (SELECT DISTINCT pair_id, side, m[1].content AS question, m[2].content AS answer FROM both_sides WHERE len(m) >= 2)
"""


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question and answer of either side of the pairs, each once: (``pair_id``, ``side``, ``question``, ``answer``)."""
    d = t(spark, sf_dir, "dpo")
    sides = d.select("pair_id", F.lit(0).alias("side"), F.col("chosen").alias("m")).unionByName(d.select("pair_id", F.lit(1).alias("side"), F.col("rejected").alias("m")))
    rows = sides.where(F.size("m") >= 2)
    return rows.select("pair_id", "side", F.col("m")[0]["content"].alias("question"), F.col("m")[1]["content"].alias("answer")).distinct()


# ---- cleaning, gates, duplicates


@query(_GATED + "SELECT outcome, count(*) AS n_rows, CAST(sum(n) AS BIGINT) AS n_chars FROM o GROUP BY outcome")
def pipeline_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.outcome_counts(dedup.outcomes(t(spark, sf_dir, "pretrain_t2t")))


@query(_GATED + "SELECT row_id, outcome FROM o")
def row_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.outcomes(t(spark, sf_dir, "pretrain_t2t")).select(F.col("id").alias("row_id"), "outcome")


@query(_GATED + "SELECT row_id, n AS n_chars, md5(clean) AS digest FROM o WHERE outcome = 'kept'")
def exact_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup.surviving_texts(t(spark, sf_dir, "pretrain_t2t"), near=False)
    return kept.select(F.col("id").alias("row_id"), F.length("clean").cast("bigint").alias("n_chars"), F.md5("clean").alias("digest"))


@query(f"SELECT row_id, md5({_CLEAN}) AS digest FROM pretrain_t2t WHERE text IS NOT NULL")
def clean_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "pretrain_t2t").where("text IS NOT NULL")
    return rows.select("row_id", F.md5(text.clean_text(F.col("text"))).alias("digest"))


_COMPACT = f"regexp_replace({_STRIP % 'text'}, '{_WS}+', ' ', 'g')"


@query(f"SELECT doc_id, md5({_COMPACT}) AS digest FROM documents WHERE text IS NOT NULL")
def compact_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.md5(text.compact_space(F.col("text"))).alias("digest"))


@query(f"""
WITH c AS (SELECT doc_id, greatest(1, length({_COMPACT}) - 4) AS total FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CAST(total AS BIGINT) AS total, CAST(ceil(total / 4096.0) AS BIGINT) AS stride, CAST(ceil(total / ceil(total / 4096.0)) AS BIGINT) AS taken FROM c""")
def shingle_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = t(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", text.shingle_plan(F.col("text")).alias("p"))
    return plan.select("doc_id", *(F.col(f"p.{c}").cast("bigint").alias(c) for c in ("total", "stride", "taken")))


@query(f"""
WITH c AS (SELECT doc_id, {_COMPACT} AS x FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, x, greatest(1, length(x) - 4) AS total FROM c),
g AS (SELECT doc_id, unnest(range(1, CAST(total AS BIGINT) + 1, CAST(ceil(total / 4096.0) AS BIGINT))) AS i, x FROM s)
SELECT doc_id, min(md5(substring(x, i, 5))) AS least FROM g GROUP BY doc_id""")
def least_shingle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One min-wise sample of each document by a hash both engines have."""
    rows = t(spark, sf_dir, "documents").where("text IS NOT NULL")
    return rows.select("doc_id", F.array_min(F.transform(text.strided_shingles(F.col("text")), F.md5)).alias("least"))


# ---- profile

_QUANTILES = ", ".join(f"s[1 + least(len(s) - 1, CAST(floor({p} * len(s)) AS BIGINT))] AS {n}" for n, p in profile.QUANTILES.items())
_STATS = f"len(s) AS n, CAST(list_sum(s) AS BIGINT) AS total_chars, CAST(list_sum(s) AS DOUBLE) / len(s) AS mean_chars, {_QUANTILES}, s[1] AS min_chars, s[-1] AS max_chars"


@query(f"WITH h AS (SELECT shard, list_sort(list(length(text))) AS s FROM pretrain_t2t WHERE text IS NOT NULL GROUP BY shard) SELECT shard, {_STATS} FROM h")
def text_length_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.length_stats(t(spark, sf_dir, "pretrain_t2t"), F.length("text"), ["shard"])


@query(f"""
WITH c AS (SELECT list_sum(list_transform(conversations, lambda m: coalesce(length(m.content), 0))) AS v FROM sft_t2t_mini WHERE conversations IS NOT NULL),
h AS (SELECT list_sort(list(CAST(coalesce(v, 0) AS BIGINT))) AS s FROM c) SELECT {_STATS} FROM h""")
def conversation_length_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.conversation_profile(t(spark, sf_dir, "sft_t2t_mini"))


@query("SELECT shard AS key, count(*) AS n FROM pretrain_t2t WHERE shard IS NOT NULL GROUP BY shard ORDER BY n DESC, min(row_id), shard LIMIT 10")
def top_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.top_counts(t(spark, sf_dir, "pretrain_t2t"), F.col("shard"), F.col("row_id"), 10)


@query("""
WITH m AS (SELECT unnest(conversations) AS m FROM sft_t2t_mini)
SELECT m.role AS role, count(*) AS n FROM m WHERE m.role IS NOT NULL GROUP BY m.role""")
def role_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.role_counts(t(spark, sf_dir, "sft_t2t_mini"))


@query(f"""
WITH c AS (SELECT len(list_filter(coalesce(conversations, []), lambda m: {_STRIP % "coalesce(m.reasoning_content, '')"} <> '')) AS n FROM sft_t2t_mini)
SELECT CAST(sum(n) AS BIGINT) AS messages, count(*) FILTER (WHERE n > 0) AS records FROM c""")
def reasoning_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.reasoning_counts(t(spark, sf_dir, "sft_t2t_mini"))


_RAW = "array_to_string(list_transform(conversations, lambda m: coalesce(m.content, '') || ' ' || coalesce('\"tools\": ' || m.tools, '') || ' ' || coalesce('\"tool_calls\": ' || m.tool_calls, '')), ' ')"


@query(f"""
WITH r AS (SELECT {_RAW} AS x FROM sft_t2t_mini WHERE conversations IS NOT NULL),
k AS (SELECT CASE WHEN contains(x, 'tool_call') THEN 'tool_call' WHEN contains(x, 'function_call') THEN 'function_call' WHEN contains(x, '"tools"') THEN '"tools"'
                  WHEN contains(x, '"observation"') THEN '"observation"' WHEN contains(x, '"action"') THEN '"action"' END AS marker FROM r)
SELECT marker, count(*) AS n FROM k WHERE marker IS NOT NULL GROUP BY marker""")
def tool_marker_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "sft_t2t_mini").where("conversations IS NOT NULL")
    field = lambda m, c, head: F.coalesce(F.concat(F.lit(head), m[c]), F.lit(""))
    raw = F.array_join(
        F.transform("conversations", lambda m: F.concat_ws(" ", F.coalesce(m["content"], F.lit("")), field(m, "tools", '"tools": '), field(m, "tool_calls", '"tool_calls": '))), " "
    )
    return profile.marker_counts(rows, raw)


# ---- judging and answers


@query(_ANSWERS + """
, n AS (SELECT pair_id, side, question, answer, coalesce(nullif(regexp_extract(answer, '(?i)["'']?(?:score|评分|分数)["'']?\\s*[:：=]\\s*(-?[0-9]+(?:\\.[0-9]+)?)', 1), ''),
                             regexp_extract_all(answer, '-?[0-9]+(?:\\.[0-9]+)?')[-1]) AS raw FROM a)
SELECT pair_id, side, md5(question) AS q, md5(coalesce(answer, '')) AS a, CASE WHEN raw IS NOT NULL THEN greatest(0.0::DOUBLE, least(10.0::DOUBLE, raw::DOUBLE)) END AS score FROM n""")
def judge_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _answers(spark, sf_dir)
    return a.select("pair_id", "side", F.md5("question").alias("q"), F.md5(F.coalesce("answer", F.lit(""))).alias("a"), judge.parse_score(F.col("answer")).alias("score"))


_RULE = """least(10.0::DOUBLE, CASE WHEN contains(answer, '<think>') AND contains(answer, '</think>') THEN 2.0 ELSE 0.0 END
 + CASE WHEN length(answer) > length(question) * 0.3 THEN 3.0 ELSE 0.0 END + CASE WHEN length(answer) < 3000 THEN 3.0 ELSE 0.0 END
 + CASE WHEN contains(answer, '因此') OR contains(answer, '所以') OR contains(answer, '综上') OR contains(answer, '答案') THEN 2.0 ELSE 0.0 END)::DOUBLE"""


@query(_ANSWERS + f"SELECT pair_id, side, md5(question) AS q, md5(answer) AS a, {_RULE} AS score FROM a WHERE answer IS NOT NULL AND question IS NOT NULL")
def rule_judge_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _answers(spark, sf_dir).where("answer IS NOT NULL AND question IS NOT NULL")
    return a.select("pair_id", "side", F.md5("question").alias("q"), F.md5("answer").alias("a"), judge.RuleJudge().score(F.col("question"), F.col("answer")).alias("score"))


@query(_ANSWERS + f"""
SELECT pair_id, side, md5(replace(replace('{judge.RUBRIC.replace("%s", "{}")}', '{{}}', '%'), '%', '')) || md5({_STRIP % 'question'}) || md5({_STRIP % 'answer'}) AS prompt
FROM a WHERE answer IS NOT NULL AND question IS NOT NULL""")
def judge_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompt's fixed part and both stripped texts, by digests."""
    a = _answers(spark, sf_dir).where("answer IS NOT NULL AND question IS NOT NULL")
    prompt = judge.judge_prompt(F.col("question"), F.col("answer"))
    head, middle, tail = judge.RUBRIC.split("%s")
    q = F.substring(prompt, F.lit(len(head) + 1), F.length(text.strip(F.col("question"))))
    rest = F.substring(prompt, F.lit(len(head + middle) + 1) + F.length(q), F.length(text.strip(F.col("answer"))))
    return a.select("pair_id", "side", F.concat(F.md5(F.lit(head + middle + tail)), F.md5(q), F.md5(rest)).alias("prompt"))


@query(_ANSWERS + f"""
, s AS (SELECT pair_id, side, question, answer, {_STRIP % 'answer'} AS x FROM a WHERE answer IS NOT NULL),
g AS (SELECT pair_id, side, question, answer, substring(x, i, 4) AS gram FROM s, unnest(range(1, greatest(length(x) - 2, 1))) AS r(i)),
c AS (SELECT pair_id, side, question, answer, gram, count(*) AS n FROM g GROUP BY ALL),
k AS (SELECT pair_id, side, question, answer, CAST(sum(n) FILTER (WHERE n > 1) AS DOUBLE) / sum(n) AS rep FROM c GROUP BY ALL)
SELECT pair_id, side, md5(coalesce(question, '')) AS q, md5(answer) AS a, round(coalesce(rep, 0.0), 9) AS rep4 FROM s LEFT JOIN k USING (pair_id, side, question, answer)""")
def repetition_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _answers(spark, sf_dir).where("answer IS NOT NULL")
    return a.select("pair_id", "side", F.md5(F.coalesce("question", F.lit(""))).alias("q"), F.md5("answer").alias("a"), F.round(text.repetition(F.col("answer")), 9).alias("rep4"))


@query("""
WITH c AS (SELECT item_id, question, choices FROM eval_items WHERE choices IS NOT NULL)
SELECT item_id, md5(question || chr(10) || array_to_string(list_transform(choices, lambda x, i: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ', i, 1) || '. ' || x), chr(10)) || chr(10) || '请只回答选项字母（如 A）。') AS prompt FROM c""")
def choice_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = t(spark, sf_dir, "eval_items").where("choices IS NOT NULL")
    return items.select("item_id", F.md5(text.mc_prompt(F.col("question"), F.col("choices"))).alias("prompt"))


@query(_ANSWERS + "SELECT pair_id, side, md5(question) AS q, md5(answer) AS a, nullif(upper(regexp_extract(answer, '(?:^|[^\\p{L}\\p{N}_])([A-Ha-h])(?:[^\\p{L}\\p{N}_]|$)', 1)), '') AS letter FROM a WHERE answer IS NOT NULL")
def choice_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _answers(spark, sf_dir).where("answer IS NOT NULL")
    return a.select("pair_id", "side", F.md5("question").alias("q"), F.md5("answer").alias("a"), text.mc_answer(F.col("answer")).alias("letter"))


@query("SELECT item_id, regexp_extract_all(replace(answer, ',', ''), '-?[0-9]+(?:\\.[0-9]+)?')[-1]::DOUBLE AS number FROM eval_items")
def last_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "eval_items").select("item_id", text.last_number(F.col("answer")).alias("number"))


_NORMAL = rf"regexp_replace(regexp_replace(lower({_STRIP % '%s'}), '[,\s\x{{000B}}\x{{0085}}\p{{Z}}]+', '', 'g'), '^[\[({{]+|[\])}}]+$', '', 'g')"


@query(_ANSWERS + f"SELECT pair_id, side, md5(question) AS q, md5({_NORMAL % 'answer'}) AS normal FROM a WHERE answer IS NOT NULL")
def normalized_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _answers(spark, sf_dir).where("answer IS NOT NULL")
    return a.select("pair_id", "side", F.md5("question").alias("q"), F.md5(text.normalize_answer(F.col("answer"))).alias("normal"))


_LAST_USER = "list_filter(conversations, lambda m: m.role = 'user')[-1].content"


@query(f"""
WITH f AS (SELECT task_id, {_NORMAL % ("coalesce(" + _LAST_USER + ", '')")} AS final, gt FROM agent_rl),
g AS (SELECT task_id, final, list_filter(list_transform(coalesce(gt, []), lambda x: {_NORMAL % 'x'}), lambda x: x <> '') AS gs FROM f)
SELECT task_id, CASE WHEN len(list_filter(gs, lambda x: coalesce(abs(try_cast(final AS DOUBLE) - try_cast(x AS DOUBLE)) < 1e-6, false) OR contains(final, x) OR contains(x, final))) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS matched
FROM g""")
def truth_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = F.filter("conversations", lambda m: m["role"] == "user")
    final = F.coalesce(F.try_element_at(users, F.lit(-1))["content"], F.lit(""))
    return t(spark, sf_dir, "agent_rl").select("task_id", text.truth_match(final, F.col("gt")).alias("matched"))


@query("""
WITH p(prompt, output) AS (VALUES ('请以“总之”开头', '总之，好'), ('请以“总之”开头', '好'), ('以“再见”结尾', '好，再见'), ('包含关键词“Spark”', 'use spark'), ('包含关键词“Spark”', 'no'),
 ('请回答是或否', '是。对'), ('请回答是或否', '也许'), ('随便', 'x'))
SELECT prompt, output, (CASE WHEN regexp_extract(prompt, '以“(.+?)”开头', 1) <> '' THEN starts_with(lower(output), lower(regexp_extract(prompt, '以“(.+?)”开头', 1))) ELSE true END)
 AND (CASE WHEN regexp_extract(prompt, '以“(.+?)”结尾', 1) <> '' THEN ends_with(lower(output), lower(regexp_extract(prompt, '以“(.+?)”结尾', 1))) ELSE true END)
 AND (CASE WHEN regexp_extract(prompt, '包含关键词“(.+?)”', 1) <> '' THEN contains(lower(output), lower(regexp_extract(prompt, '包含关键词“(.+?)”', 1))) ELSE true END)
 AND (CASE WHEN contains(prompt, '回答是或否') THEN regexp_matches(output, '^(是|否)[。.，, ]') ELSE true END) AS ok FROM p""")
def instruction_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("请以“总之”开头", "总之，好"), ("请以“总之”开头", "好"), ("以“再见”结尾", "好，再见"), ("包含关键词“Spark”", "use spark"), ("包含关键词“Spark”", "no"), ("请回答是或否", "是。对"), ("请回答是或否", "也许"), ("随便", "x")]
    p = spark.createDataFrame(rows, "prompt string, output string")
    return p.withColumn("ok", text.follows_instruction(F.col("prompt"), F.col("output")))


# ---- chat, pairs, prompts

_TURN_BODY = f"""CASE WHEN m.role = 'assistant' THEN '<think>' || chr(10) || {_STRIP % "coalesce(m.reasoning_content, '')"} || chr(10) || '</think>' || chr(10) || chr(10) || coalesce(m.content, '')
 || CASE WHEN {_STRIP % "coalesce(m.tool_calls, '')"} <> '' AND json_valid(m.tool_calls) THEN chr(10) || '<tool_call>' || chr(10) || m.tool_calls || chr(10) || '</tool_call>' ELSE '' END
 WHEN m.role = 'tool' THEN '<tool_response>' || chr(10) || coalesce(m.content, '') || chr(10) || '</tool_response>' ELSE coalesce(m.content, '') END"""
_TURNS = f"array_to_string(list_transform(%s, lambda m: '<|im_start|>' || CASE WHEN m.role = 'tool' THEN 'user' ELSE coalesce(m.role, '') END || chr(10) || {_TURN_BODY} || '<|im_end|>' || chr(10)), '')"
_TOOLS = "list_filter(%s, lambda m: m.role = 'system' AND m.tools IS NOT NULL)[-1].tools"
_LIFTED = f"CASE WHEN {_STRIP % ('coalesce(' + _TOOLS + ", '')")} <> '' AND json_valid({_TOOLS}) THEN '<|im_start|>system' || chr(10) || '# Tools' || chr(10) || {_TOOLS} || '<|im_end|>' || chr(10) ELSE '' END"
_NO_LAST = f"CASE WHEN conversations[-1].role = 'assistant' AND {_STRIP % "coalesce(conversations[-1].content, '')"} = '' THEN conversations[:-2] ELSE conversations END"
_HEAD = "'<|im_start|>assistant' || chr(10) || '<think>' || chr(10)"


@query(f"SELECT conv_id, epoch_us(ingested_at) AS at, md5({_LIFTED.replace('%s', 'conversations')} || {_TURNS % 'conversations'}) AS digest FROM sft_t2t_mini WHERE len(conversations) > 0")
def chat_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "sft_t2t_mini").where(F.size("conversations") > 0)
    body = chat.chat_text(F.col("conversations"), chat.lifted_tools(F.col("conversations")))
    return rows.select("conv_id", F.unix_micros(F.col("ingested_at").cast("timestamp")).alias("at"), F.md5(body).alias("digest"))


@query("SELECT CASE WHEN len(conversations) > 0 THEN 'kept' ELSE 'skipped' END AS outcome, count(*) AS n FROM sft_t2t_mini GROUP BY 1")
def conversation_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = F.when(F.size("conversations") > 0, "kept").otherwise("skipped")
    return t(spark, sf_dir, "sft_t2t_mini").groupBy(kept.alias("outcome")).agg(F.count("*").alias("n"))


@query(f"""
WITH p AS (SELECT * FROM dpo WHERE len(chosen) >= 2 AND len(rejected) >= 2)
SELECT pair_id, epoch_us(ingested_at) AS at, md5({_TURNS % 'chosen[:-2]'} || '<|im_start|>assistant' || chr(10)) AS prompt, md5({_TURNS % 'chosen'}) AS chosen, md5({_TURNS % 'rejected'}) AS rejected,
       to_json(chosen[:-2]) = to_json(rejected[:-2]) AS same_prompt FROM p""")
def preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "dpo").withColumn("at", F.unix_micros(F.col("ingested_at").cast("timestamp")))
    key = F.struct("pair_id", "at")
    pairs = preference.preference_pairs(rows.withColumn("key", key), "key")
    return pairs.select("id.pair_id", "id.at", *(F.md5(c).alias(c) for c in ("prompt", "chosen", "rejected")), "same_prompt")


@query(f"""
SELECT prompt_id, epoch_us(ingested_at) AS at, md5({_TURNS % ('(' + _NO_LAST + ')')} || {_HEAD}) AS text,
 md5({_STRIP % "array_to_string(list_transform(conversations[:-2], lambda m: coalesce(m.role, '') || ': ' || coalesce(m.content, '')), chr(10))"}) AS question FROM rlaif WHERE conversations IS NOT NULL""")
def rlaif_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "rlaif").withColumn("key", F.struct("prompt_id", F.unix_micros(F.col("ingested_at").cast("timestamp")).alias("at")))
    return preference.rlaif_prompts(rows, "key").select("id.prompt_id", "id.at", F.md5("text").alias("text"), F.md5("question").alias("question"))


@query(f"""
WITH a AS (SELECT task_id, gt, {_NO_LAST} AS conversations FROM agent_rl WHERE conversations IS NOT NULL AND len(gt) > 0)
SELECT task_id, md5({_LIFTED.replace('%s', 'conversations')} || {_TURNS % 'conversations'} || {_HEAD}) AS text, array_to_string(gt, '|') AS gt,
 {_STRIP % ('coalesce(' + _TOOLS.replace('%s', 'conversations') + ", '')")} <> '' AND coalesce(json_valid({_TOOLS.replace('%s', 'conversations')}), false) AS expect_tool FROM a""")
def agent_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = preference.agent_prompts(t(spark, sf_dir, "agent_rl"))
    return p.select(F.col("id").alias("task_id"), F.md5("text").alias("text"), F.array_join("gt", "|").alias("gt"), "expect_tool")


@query("SELECT count(*) AS prompts, count(*) FILTER (WHERE len(list_filter(conversations, lambda m: m.role = 'system' AND trim(m.tools) <> '' AND json_valid(m.tools))) > 0) AS with_tools FROM agent_rl WHERE conversations IS NOT NULL AND len(gt) > 0")
def agent_prompt_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.agent_prompts(t(spark, sf_dir, "agent_rl")).agg(F.count("*").alias("prompts"), F.count_if("expect_tool").alias("with_tools"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _answers(spark, sf_dir).where("answer IS NOT NULL AND question IS NOT NULL")
    one = a.groupBy("pair_id", "side").agg(F.min(F.struct("question", "answer")).alias("r")).select("pair_id", "side", "r.*")
    return one.select(F.col("pair_id").alias("idx"), F.col("side").cast("bigint").alias("seq"), F.col("answer").alias("text"), judge.RuleJudge().score(F.col("question"), F.col("answer")).alias("score"))


_SCORED = _ANSWERS + f""", b AS (SELECT pair_id, side, min(struct_pack(q := question, a := answer)) AS r FROM a WHERE answer IS NOT NULL AND question IS NOT NULL GROUP BY ALL),
s AS (SELECT pair_id AS idx, side AS seq, answer AS text, {_RULE} AS score FROM (SELECT pair_id, side, r.q AS question, r.a AS answer FROM b))"""


@query(_SCORED + """, k AS (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY score DESC, seq) AS hi, row_number() OVER (PARTITION BY idx ORDER BY score, seq DESC) AS lo FROM s)
SELECT idx, md5(max(text) FILTER (WHERE hi = 1)) AS chosen, md5(max(text) FILTER (WHERE lo = 1)) AS rejected, max(score) AS best, min(score) AS worst, count(*) AS n FROM k GROUP BY idx""")
def best_worst_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = preference.best_and_worst(_scored(spark, sf_dir))
    return found.withColumns({"chosen": F.md5("chosen"), "rejected": F.md5("rejected")})


@query(_SCORED + "SELECT idx, seq, round((score - avg(score) OVER w) / (stddev_samp(score) OVER w + 1e-6), 6) AS advantage FROM s WINDOW w AS (PARTITION BY idx)")
def group_advantages(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scored(spark, sf_dir).withColumnRenamed("score", "reward")
    return preference.advantages(s).select("idx", F.col("seq").cast("int").alias("seq"), F.round("advantage", 6).alias("advantage"))


@query("SELECT d.pair_id AS idx, coalesce(max(r.conversations[1].content), 'prompt_' || d.pair_id) AS question FROM dpo d LEFT JOIN rlaif r ON d.pair_id = r.prompt_id GROUP BY d.pair_id")
def questions_with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = t(spark, sf_dir, "dpo").select(F.col("pair_id").alias("idx")).distinct()
    questions = t(spark, sf_dir, "rlaif").groupBy(F.col("prompt_id").alias("idx")).agg(F.max(F.try_element_at("conversations", F.lit(1))["content"]).alias("question"))
    return preference.with_questions(samples, questions)


@query("SELECT prompt_id, k AS seq, CAST(prompt_id % 2 AS BIGINT) AS rank FROM (SELECT DISTINCT prompt_id FROM rlaif), range(4) AS r(k)")
def sample_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = preference.expanded(t(spark, sf_dir, "rlaif").select("prompt_id").distinct(), 4)
    shares = [preference.worker_share(slots, "prompt_id", r, 2).withColumn("rank", F.lit(r).cast("bigint")) for r in range(2)]
    return shares[0].unionByName(shares[1]).withColumn("seq", F.col("seq").cast("bigint"))


@query("SELECT row_id, row_number() OVER (ORDER BY row_id DESC) <= 200 AS is_val FROM pretrain_t2t")
def validation_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.tail_split(t(spark, sf_dir, "pretrain_t2t").select("row_id"), "row_id", 200)


@query("SELECT mix, conv_id, stamp FROM (SELECT mix, conv_id, epoch_us(ingested_at) AS stamp, row_number() OVER (PARTITION BY mix ORDER BY ingested_at DESC, conv_id DESC) AS r FROM sft_t2t_mini) WHERE r <= 3")
def latest_of_each_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "sft_t2t_mini").select("mix", "conv_id", F.unix_micros(F.col("ingested_at").cast("timestamp")).alias("stamp")).withColumn("order", F.struct("stamp", "conv_id"))
    return preference.keep_last(rows, ["mix"], "order", 3).drop("order")


@query("SELECT mix, max_by(conv_id, ingested_at) AS conv_id, max(epoch_us(ingested_at)) AS at FROM sft_t2t_mini GROUP BY mix")
def latest_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "sft_t2t_mini").withColumn("at", F.unix_micros(F.col("ingested_at").cast("timestamp")))
    return rows.groupBy("mix").agg(F.max_by("conv_id", "at").alias("conv_id"), F.max("at").alias("at"))


@query("SELECT row_id FROM pretrain_t2t ORDER BY row_id LIMIT 50 OFFSET 100")
def offset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "pretrain_t2t").select("row_id").orderBy("row_id").offset(100).limit(50)


# ---- tools and rewards


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "sft_t2t_mini").select("conv_id", F.posexplode("conversations").alias("turn", "m")).where("m.tool_calls LIKE '[%'").distinct()
    each = F.expr("try_cast(try_parse_json(m.tool_calls) AS ARRAY<VARIANT>)")
    return rows.select("conv_id", "turn", F.array_join(F.transform(each, lambda v: F.concat(F.lit("<tool_call>\n"), F.to_json(v), F.lit("\n</tool_call>"))), "\n").alias("text"))


@query("""
WITH m AS (SELECT DISTINCT conv_id, unnest(conversations) AS m, generate_subscripts(conversations, 1) - 1 AS turn FROM sft_t2t_mini),
c AS (SELECT conv_id, turn, unnest(CAST(m.tool_calls AS JSON[])) AS j FROM m WHERE m.tool_calls LIKE '[%' AND json_valid(m.tool_calls)),
e AS (SELECT conv_id, turn, j->>'$.name' AS name, j->>'$.arguments.expression' AS expression FROM c WHERE j->>'$.name' = 'calculate_math')
SELECT conv_id, CAST(turn AS INT) AS turn, name, expression, CAST(split_part(expression, '*', 1) AS BIGINT) * CAST(split_part(expression, '*', 2) AS BIGINT) AS result FROM e""")
def calculated_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _calls(spark, sf_dir).select("conv_id", "turn", F.explode(tools.tool_calls(F.col("text"))).alias("c")).where("c.name = 'calculate_math'")
    return found.select("conv_id", "turn", "c.name", F.get_json_object("c.arguments", "$.expression").alias("expression"), F.get_json_object("c.result", "$.result").cast("bigint").alias("result"))


@query("""
WITH a AS (SELECT task_id, gt, len(list_filter(coalesce(conversations, []), lambda m: m.role = 'system' AND trim(m.tools) <> '')) > 0 AS e FROM agent_rl)
SELECT task_id, round(0.3 * (0.5 + CASE WHEN e THEN 0.5 ELSE 0 END) + 0.2 * CASE WHEN e THEN 1 ELSE 0 END + 0.5 * CASE WHEN len(list_filter(coalesce(gt, []), lambda x: trim(x) <> '')) > 0 THEN 1 ELSE 0 END, 9)::DOUBLE AS reward FROM a""")
def gold_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rewards of right answers in the expected format."""
    rows = t(spark, sf_dir, "agent_rl").withColumn("e", F.coalesce(F.exists("conversations", lambda m: (m["role"] == "system") & (F.trim(m["tools"]) != "")), F.lit(False)))
    rows = rows.withColumn("text", tools.gold_text(F.col("gt"), F.col("e"))).withColumn("calls", tools.tool_calls(F.col("text")))
    return rows.select("task_id", F.round(tools.composite_reward(F.col("text"), F.col("calls"), F.col("e"), F.col("gt")), 9).alias("reward"))


_CASES = [("USD", "CNY", "北京", "你好", 1.5, "km", "m"), ("eur", "usd", "拉萨", "bye", 20.0, "c", "f"), ("CNY", "EUR", "成都", "HELLO", 98.6, "f", "c"), ("GBP", "USD", "广州", "谢谢", 3.0, "h", "km")]


@query("""
SELECT * FROM (VALUES ('USD', '北京', '你好', 7.21::DOUBLE, '晴，26°C', 'hello', 1500.0::DOUBLE), ('eur', '拉萨', 'bye', round(1 / 0.92::DOUBLE, 9), '晴，25°C', NULL, 68.0::DOUBLE),
 ('CNY', '成都', 'HELLO', 0.128::DOUBLE, '阴，22°C', '你好', 37.0::DOUBLE), ('GBP', '广州', '谢谢', NULL, '雷阵雨，30°C', 'thank you', NULL)) AS v(source, city, word, rate, weather, translation, converted)""")
def tool_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(_CASES, "source string, target string, city string, word string, value double, a string, b string")
    c = F.col
    return rows.select(
        "source", "city", "word", F.round(tools.exchange_rate(c("source"), c("target")), 9).alias("rate"), tools.weather(c("city")).alias("weather"),
        tools.translation(c("word")).alias("translation"), F.round(tools.convert(c("value"), c("a"), c("b")), 9).alias("converted"),
    )


# ---- evaluation


@query("""
WITH i AS (SELECT bench, answer, substring('ABCD', CAST(item_id % 4 AS INT) + 1, 1) AS got FROM eval_items WHERE choices IS NOT NULL)
SELECT bench, avg((got = answer)::INT::DOUBLE) AS acc, count(*) AS n FROM i GROUP BY bench""")
def choice_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a generator that answers by the item's number."""
    items = t(spark, sf_dir, "eval_items").where("choices IS NOT NULL")
    said = F.concat(F.lit("答：("), F.substring(F.lit("ABCD"), F.pmod("item_id", F.lit(4)).cast("int") + 1, F.lit(1)), F.lit(")"))
    return evals.accuracy(evals.choice_hits(items, said, F.ascii("answer") - F.lit(ord("A"))), ["bench"])


@query("""
WITH i AS (SELECT regexp_extract_all(replace(answer, ',', ''), '-?[0-9]+(?:\\.[0-9]+)?')[-1]::DOUBLE + item_id % 2 AS got, regexp_extract_all(replace(answer, ',', ''), '-?[0-9]+(?:\\.[0-9]+)?')[-1]::DOUBLE AS gold FROM eval_items WHERE bench = 'gsm8k')
SELECT avg((abs(got - gold) < 1e-6)::INT::DOUBLE) AS acc, count(*) AS n FROM i""")
def number_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = t(spark, sf_dir, "eval_items").where("bench = 'gsm8k'")
    said = F.concat(F.lit("结果是 "), (text.last_number(F.col("answer")) + F.pmod("item_id", F.lit(2))).cast("bigint").cast("string"))
    return evals.accuracy(evals.number_hits(items, said, F.col("answer")), [])


_SIDES = _ANSWERS + """, p AS (SELECT pair_id, min(answer) FILTER (WHERE side = 0) AS x, min(answer) FILTER (WHERE side = 1) AS y FROM a GROUP BY pair_id),
s AS (SELECT pair_id, x, y, regexp_extract(x, '(?s)<think>(.*?)</think>', 1) AS k FROM p WHERE x IS NOT NULL AND y IS NOT NULL)"""


def _sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _answers(spark, sf_dir).groupBy("pair_id")
    p = a.agg(F.min(F.when(F.col("side") == 0, F.col("answer"))).alias("x"), F.min(F.when(F.col("side") == 1, F.col("answer"))).alias("y"))
    return p.where("x IS NOT NULL AND y IS NOT NULL")


@query(_SIDES + """
SELECT count(*) AS n, round(avg((length(k) > 0)::INT::DOUBLE), 9) AS think_trigger_rate, round(sum(length(k)) / greatest(sum(length(x)), 1)::DOUBLE, 9) AS think_share_of_on,
 round(avg((length(x) - length(y)) / greatest(length(y), 1)::DOUBLE), 9) AS mean_length_ratio FROM s""")
def thinking_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evals.thinking_summary(_sides(spark, sf_dir), F.col("x"), F.col("y"))
    return found.select("n", *(F.round(c, 9).alias(c) for c in ("think_trigger_rate", "think_share_of_on", "mean_length_ratio")))


@query(_SCORED + "SELECT avg(score) AS judge_mean, count(*) AS judge_n FROM s")
def judge_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evals.judge_mean(_scored(spark, sf_dir))


@query(_SCORED + "SELECT avg(score / 10) AS mean_reward, avg((score / 10 > 0.9)::INT::DOUBLE) AS gt_hit, count(*) AS n FROM s")
def agent_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evals.agent_summary(_scored(spark, sf_dir).withColumn("reward", F.col("score") / 10))


@query("SELECT round(exp(sum(l_discount * l_quantity) / greatest(sum(l_quantity), 1)), 9) AS ppl FROM lineitem")
def weighted_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evals.loss_perplexity(t(spark, sf_dir, "lineitem"), "l_discount", "l_quantity").select(F.round("ppl", 9).alias("ppl"))


@query("SELECT l_returnflag AS expert, count(*) AS tokens, count(*) / sum(count(*)) OVER ()::DOUBLE AS share FROM lineitem GROUP BY l_returnflag")
def expert_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formulas.load_share(t(spark, sf_dir, "lineitem"), "l_returnflag").withColumnRenamed("l_returnflag", "expert")


@query("""
WITH p AS (SELECT l_orderkey AS g, l_linenumber AS i, l_quantity / sum(l_quantity) OVER (PARTITION BY l_orderkey) AS p FROM lineitem),
b AS (SELECT *, coalesce(sum(p) OVER (PARTITION BY g ORDER BY p DESC, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p)
SELECT g, i, round(p / sum(p) OVER (PARTITION BY g), 6) AS kept_prob FROM b WHERE before <= 0.7000001""")
def nucleus_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    li = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("g"), F.col("l_linenumber").alias("i"), "l_quantity")
    p = li.withColumn("p", F.col("l_quantity") / F.sum("l_quantity").over(Window.partitionBy("g")))
    return formulas.nucleus(p, ["g"], "p", [F.col("i")], 0.7000001).select("g", "i", F.round("kept_prob", 6).alias("kept_prob"))


@query("""
SELECT s AS step, lr, wd, round(CASE WHEN s < 10 THEN lr * (s + 1) / 10 WHEN s >= 100 THEN lr * 0.1 ELSE lr * (0.1 + 0.45 * (1 + cos(pi() * (s - 10) / 90.0))) END, 12) AS rate
FROM range(0, 121) AS r(s), (VALUES (0.001::DOUBLE), (0.003::DOUBLE)) AS a(lr), (VALUES (0.0::DOUBLE), (0.1::DOUBLE)) AS b(wd)""")
def rate_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learning rates of a grid of settings, a product of two literal lists."""
    rates = spark.createDataFrame([(0.001,), (0.003,)], "lr double")
    decays = spark.createDataFrame([(0.0,), (0.1,)], "wd double")
    grid = spark.range(0, 121).withColumnRenamed("id", "step").crossJoin(F.broadcast(rates)).crossJoin(F.broadcast(decays))
    unit = formulas.cosine_rate(F.col("step"), 10, 100, 1.0, 0.1)
    return grid.withColumn("rate", F.round(unit * F.col("lr"), 12))


@query("SELECT date_trunc('hour', ts) AS hour, count(*) AS events, round(sum(value) / greatest(epoch(max(ts)) - epoch(min(ts)), 1), 6) AS per_second FROM events GROUP BY 1")
def throughput_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    span = F.greatest(F.max("at") - F.min("at"), F.lit(1.0))
    return e.groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("events"), F.round(F.sum("value") / span, 6).alias("per_second"))


# ---- tokens and packing


@query(_GATED + "SELECT row_id, strlen(clean) AS tokens FROM o WHERE outcome = 'kept'")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens by the byte tokenizer before near duplicates are dropped; the table's texts hold no control strings."""
    ids = encode_texts(dedup.surviving_texts(t(spark, sf_dir, "pretrain_t2t"), near=False), ByteTokenizer())
    return ids.select(F.col("id").alias("row_id"), F.size("ids").cast("bigint").alias("tokens"))


_MARKS = ["<|endoftext|>", "<|im_start|>", "<|im_end|>", "<think>", "</think>", "<tool_call>", "</tool_call>", "<tool_response>", "</tool_response>"]
_TOKENS = "strlen(x) - (" + " + ".join(f"(strlen(x) - strlen(replace(x, '{m}', ''))) // {len(m)} * {len(m) - 1}" for m in _MARKS) + ")"


@query(f"""
WITH c AS (SELECT conv_id, ingested_at, {_LIFTED.replace('%s', 'conversations')} || {_TURNS % 'conversations'} AS x FROM sft_t2t_mini WHERE len(conversations) > 0)
SELECT conv_id, epoch_us(ingested_at) AS at, CAST({_TOKENS} AS BIGINT) AS tokens, {_TOKENS} <= 1024 AS fits FROM c""")
def chat_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "sft_t2t_mini").withColumn("at", F.unix_micros(F.col("ingested_at").cast("timestamp"))).where(F.size("conversations") > 0)
    texts = chat.sft_texts(rows.withColumn("key", F.xxhash64("conv_id", "at")), "key")
    ids = encode_texts(texts, ByteTokenizer(), text_col="text")
    short = preference.fitting(ids, ["ids"], 1024).select("id", F.lit(True).alias("fits"))
    sized = ids.select("id", F.size("ids").cast("bigint").alias("tokens")).join(short, "id", "left")
    keys = rows.select("conv_id", "at", F.xxhash64("conv_id", "at").alias("id"))
    return keys.join(sized, "id").select("conv_id", "at", "tokens", F.coalesce("fits", F.lit(False)).alias("fits"))


# ---- formulas


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays of the at most seven lines of each order, in order."""
    li = t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_discount", "l_tax", "l_quantity"))).alias("x"))
    cut = lambda c: F.transform("x", lambda r: r[c])
    return li.select("l_orderkey", cut("l_discount").alias("a"), cut("l_tax").alias("b"), F.transform("x", lambda r: r["l_quantity"] > 25).alias("m"))


@query("SELECT l_orderkey, round(ln(1 + exp(-(2 * (avg(l_discount) - avg(l_tax)) - 1.2))), 9) AS loss FROM lineitem GROUP BY l_orderkey")
def preference_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("l_orderkey", F.round(formulas.preference_loss(F.col("a"), F.col("b")), 9).alias("loss"))


@query("""
WITH r AS (SELECT l_orderkey, exp(10 * (l_discount - l_tax)) AS r, l_quantity > 25 AS m FROM lineitem)
SELECT l_orderkey, round(-least(avg(r), avg(greatest(0.8, least(1.28, r)))), 9) AS loss,
 round(0.0::DOUBLE - sum(CASE WHEN m THEN least(r, greatest(0.8, least(1.28, r))) ELSE 0 END), 9) AS token_loss, CAST(count(*) FILTER (WHERE m) AS INT) AS tokens FROM r GROUP BY l_orderkey""")
def clipped_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).withColumns({"a": F.transform("a", lambda x: x * 10), "b": F.transform("b", lambda x: x * 10)})
    one = F.lit(1.0)
    terms = formulas.clipped_token_terms(F.col("b"), F.col("a"), one, F.col("m"))
    return rows.select("l_orderkey", F.round(formulas.clipped_ratio_loss(F.col("b"), F.col("a"), one), 9).alias("loss"), F.round(terms["loss"], 9).alias("token_loss"), terms["tokens"].alias("tokens"))


@query("""
WITH p AS (SELECT l_returnflag AS e, avg(l_discount) AS p, sum(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END) AS n FROM lineitem GROUP BY 1)
SELECT round(3 * sum(p * n / (SELECT sum(n) FROM p)), 9)::DOUBLE AS loss FROM p""")
def balance_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    routed = t(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("expert"), F.col("l_discount").alias("prob"), (F.col("l_quantity") > 25).alias("chosen"))
    return formulas.balance_loss(routed, 3).select(F.round("loss", 9).alias("loss"))


# ---- streams


@query(f"WITH c AS (SELECT sha256({_CLEAN}) AS d, length({_CLEAN}) AS n FROM pretrain_t2t WHERE text IS NOT NULL) SELECT DISTINCT d AS digest FROM c WHERE n BETWEEN 32 AND 100000")
def streamed_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch = t(spark, sf_dir, "pretrain_t2t")
    stream = spark.readStream.schema(batch.schema).parquet(f"{sf_dir}/pretrain_t2t.parquet*").select("text")
    return incremental.run_available(incremental.first_seen(incremental.clean_stream(stream)).select("digest"), "first-seen")


@query("SELECT event_type, date_trunc('hour', ts) AS start, count(*) AS n FROM events GROUP BY ALL")
def streamed_event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch = t(spark, sf_dir, "events")
    stream = spark.readStream.schema(batch.schema).parquet(f"{sf_dir}/events.parquet*").withColumn("at", F.col("ts").cast("timestamp"))
    counts = incremental.windowed_counts(stream, "at", "1 hour", "0 seconds", ["event_type"])
    found = incremental.run_available(counts.select("event_type", F.col("window.start").alias("start"), "n"), "windows", output="complete")
    return found.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n")
