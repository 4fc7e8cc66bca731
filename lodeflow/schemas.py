"""Schemas of the corpora, and names that several modules share."""

from __future__ import annotations

from pyspark.sql import types as T

MESSAGE = T.StructType([T.StructField(n, T.StringType()) for n in ("role", "content", "reasoning_content", "tools", "tool_calls")])
PRETRAIN = T.StructType([T.StructField("text", T.StringType())])
CONVERSATION = T.StructType([T.StructField("conversations", T.ArrayType(MESSAGE))])
PREFERENCE = T.StructType([T.StructField("chosen", T.ArrayType(MESSAGE)), T.StructField("rejected", T.ArrayType(MESSAGE))])
AGENT_TASK = T.StructType([T.StructField("conversations", T.ArrayType(MESSAGE)), T.StructField("gt", T.ArrayType(T.StringType()))])
SAMPLE = T.StructType([T.StructField("idx", T.LongType()), T.StructField("text", T.StringType())])
SCORED = T.StructType([*SAMPLE.fields, T.StructField("score", T.DoubleType()), T.StructField("judge_raw", T.StringType())])
EVAL_RECORD = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("prompt", T.StringType()), T.StructField("output", T.StringType()),
    T.StructField("n_chars", T.IntegerType()), T.StructField("think_chars", T.IntegerType()), T.StructField("rep4", T.DoubleType()),
])

#: Control strings a vocabulary must hold (fixed values).
SPECIAL_TOKENS = {
    "eos": "<|endoftext|>",
    "im_start": "<|im_start|>",
    "im_end": "<|im_end|>",
    "think_start": "<think>",
    "think_end": "</think>",
    "tool_call": "<tool_call>",
    "tool_call_end": "</tool_call>",
    "tool_response": "<tool_response>",
    "tool_response_end": "</tool_response>",
}
