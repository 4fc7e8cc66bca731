"""Conversations: tools, template, supervision labels."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeflow.functions.text import strip
from lodeflow.operators.batches import text_slices
from lodeflow.operators.tokenizers import Tokenizer

THINK_ON, THINK_OFF = "<think>\n", "<think>\n\n</think>\n\n"
IGNORED = -100
_BODY = re.compile(r"<\|im_start\|>assistant\n(.*?)<\|im_end\|>", re.DOTALL)


def lifted_tools(messages: Column) -> Column:
    """Tools of the last system message that has any, if they are JSON, as text; else NULL."""
    named = F.filter(messages, lambda m: (m["role"] == "system") & m["tools"].isNotNull())
    last = F.try_element_at(named, F.lit(-1))["tools"]
    return F.when((strip(last) != "") & F.try_parse_json(last).isNotNull(), last)


def valid_tool_calls(message: Column) -> Column:
    """Tool calls of an assistant message, if they are JSON; else NULL."""
    calls = message["tool_calls"]
    return F.when((message["role"] == "assistant") & (strip(calls) != "") & F.try_parse_json(calls).isNotNull(), calls)


def drop_final_empty_assistant(messages: Column) -> Column:
    """Without the last message if that is an assistant's and blank. A NULL content is blank."""
    last = F.try_element_at(messages, F.lit(-1))
    empty = (last["role"] == "assistant") & (strip(F.coalesce(last["content"], F.lit(""))) == "")
    return F.when(F.coalesce(empty, F.lit(False)), F.slice(messages, F.lit(1), F.size(messages) - 1)).otherwise(messages)


def chat_text(messages: Column, tools: Column | None = None, generation_prompt: bool = False, thinking: bool | None = None) -> Column:
    """All messages between turn marks; an assistant's begins with its thinking, empty if there is none.

    Tools come first in the system turn, tool results stand in user turns, tool calls behind the answer.
    """

    def body(m: Column) -> Column:
        content = F.coalesce(m["content"], F.lit(""))
        thought = strip(F.coalesce(m["reasoning_content"], F.lit("")))
        calls = valid_tool_calls(m)
        answer = F.concat(F.lit("<think>\n"), thought, F.lit("\n</think>\n\n"), content, F.coalesce(F.concat(F.lit("\n<tool_call>\n"), calls, F.lit("\n</tool_call>")), F.lit("")))
        response = F.concat(F.lit("<tool_response>\n"), content, F.lit("\n</tool_response>"))
        return F.when(m["role"] == "assistant", answer).when(m["role"] == "tool", response).otherwise(content)

    def turn(m: Column) -> Column:
        role = F.when(m["role"] == "tool", F.lit("user")).otherwise(F.coalesce(m["role"], F.lit("")))
        return F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), body(m), F.lit("<|im_end|>\n"))

    text = F.array_join(F.transform(messages, turn), "")
    if tools is not None:
        text = F.concat(F.coalesce(F.concat(F.lit("<|im_start|>system\n# Tools\n"), tools, F.lit("<|im_end|>\n")), F.lit("")), text)
    if generation_prompt:
        text = F.concat(text, F.lit("<|im_start|>assistant\n" + ("" if thinking is None else THINK_ON if thinking else THINK_OFF)))
    return text


def prompt_text(user_text: Column, thinking: bool) -> Column:
    """One user turn and the head of the answer."""
    return F.concat(F.lit("<|im_start|>user\n"), user_text, F.lit("<|im_end|>\n<|im_start|>assistant\n" + (THINK_ON if thinking else THINK_OFF)))


def label_tokens(text: str, tokenizer: Tokenizer, max_len: int, include_end: bool = False) -> tuple[list[int], list[int]]:
    """Ids, and labels that are the ids inside assistants' bodies and IGNORED elsewhere; both cut to ``max_len``."""
    ids, offsets = tokenizer.encode_offsets(text)
    ids, offsets = ids[:max_len], offsets[:max_len]
    labels = [IGNORED] * len(ids)
    k = 0
    for found in _BODY.finditer(text):
        lo, hi = found.start(1), found.end() if include_end else found.end(1)
        while k < len(offsets) and offsets[k][0] < lo:
            k += 1
        while k < len(offsets) and offsets[k][1] <= hi:
            labels[k] = ids[k]
            k += 1
    return ids, labels


def labelled(table: DataFrame, tokenizer: Tokenizer, max_len: int, id_col: str = "id", text_col: str = "text", include_end: bool = False) -> DataFrame:
    """(``id``, ``ids``, ``labels``) of chat texts that keep some supervision after the cut."""
    sent = table.sparkSession.sparkContext.broadcast(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.int32())
        for batch in batches:
            for part in text_slices(batch, "text", 1_000_000):
                found = [label_tokens(t or "", sent.value, max_len, include_end) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([i for i, _ in found], kind), pa.array([x for _, x in found], kind)], ["id", "ids", "labels"])

    rows = table.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id BIGINT, ids ARRAY<INT>, labels ARRAY<INT>")
    return rows.where(F.exists("labels", lambda x: x != IGNORED))


def sft_texts(table: DataFrame, id_col: str = "conv_id", messages_col: str = "conversations") -> DataFrame:
    """(``id``, ``text``) of the conversations that have a message."""
    rows = table.where(F.size(messages_col) > 0)
    return rows.select(F.col(id_col).alias("id"), chat_text(F.col(messages_col), lifted_tools(F.col(messages_col))).alias("text"))
