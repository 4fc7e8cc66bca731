"""Scalar text functions as Catalyst columns; nothing here leaves the JVM except ``repetition`` and ``json_shape``.

All patterns are Unicode-aware. NULL in gives NULL out unless a docstring says otherwise.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodeflow.operators.batches import code_points, mix64


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean_text(c: Column) -> Column:
    """Control characters to blanks (tab and line ends stay), runs of blanks and tabs to one blank, stripped."""
    plain = F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", " ")
    return strip(F.regexp_replace(plain, r"[ \t]+", " "))


def compact_space(c: Column) -> Column:
    """Stripped, every run of white space one blank."""
    return F.regexp_replace(strip(c), r"(?U)\s+", " ")


def digest(c: Column) -> Column:
    return F.sha2(c, 256)


def _plan(length: Column, n: int, most: int) -> tuple[Column, Column]:
    total = F.greatest(F.lit(1), length - (n - 1))
    return total, F.ceil(total / F.lit(most)).cast("int")


def shingle_plan(c: Column, n: int = 5, most: int = 4096) -> Column:
    """STRUCT<total, stride, taken>: all n-grams of the compacted text, and how many a strided pass takes."""

    def plan(text: Column) -> Column:
        total, stride = _plan(F.length(text), n, most)
        return F.struct(total.alias("total"), stride.alias("stride"), F.ceil(total / stride).cast("int").alias("taken"))

    return F.transform(F.array(compact_space(c)), plan)[0]


def strided_shingles(c: Column, n: int = 5, most: int = 4096) -> Column:
    """The n-grams at every stride-th place; a shorter text is its only shingle.

    The text is bound by an outer lambda: an expression inside the inner one would be evaluated for each place.
    """

    def cut(text: Column) -> Column:
        total, stride = _plan(F.length(text), n, most)
        return F.transform(F.sequence(F.lit(1), total, stride), lambda i: F.substring(text, i, F.lit(n)))

    return F.transform(F.array(compact_space(c)), cut)[0]


def extract_think(c: Column) -> Column:
    """Body of the first think block, or ''."""
    return F.regexp_extract(c, r"(?s)<think>(.*?)</think>", 1)


def preview(c: Column, n: int = 120) -> Column:
    return F.left(c, F.lit(n))


def _repetition(texts: list[str], n: int) -> np.ndarray:
    """All texts at once: n-grams as hashes of code points, sorted within their text."""
    points, offsets = code_points(texts)
    counts = np.maximum(np.diff(offsets) - n + 1, 0)
    own = np.repeat(np.arange(len(texts)), counts)
    at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(offsets[:-1], counts)
    h = np.zeros(len(at), np.uint64)
    for k in range(n):
        h = mix64(h ^ (points[at + k].astype(np.uint64) + np.uint64(1)))
    order = np.lexsort((h, own))
    own, h = own[order], h[order]
    same = (own[1:] == own[:-1]) & (h[1:] == h[:-1])
    repeated = np.concatenate((same, [False])) | np.concatenate(([False], same)) if len(h) else np.zeros(0, bool)
    return np.bincount(own[repeated], minlength=len(texts)) / np.maximum(counts, 1)


def repetition(c: Column, n: int = 4) -> Column:
    """Share of the places whose n-gram occurs more than once; 0 for texts shorter than n, white space at the ends aside."""

    @F.pandas_udf("double")
    def run(s: pd.Series) -> pd.Series:
        known = s.notna().to_numpy()
        out = np.full(len(s), np.nan)
        if known.any():
            out[known] = _repetition(s[known].tolist(), n)
        return pd.Series(out).where(known, None)

    return run(strip(c))


#: Ending of a multiple-choice prompt (fixed value).
CHOICE_TAIL = "\n请只回答选项字母（如 A）。"


def mc_prompt(question: Column, choices: Column) -> Column:
    lines = F.transform(choices, lambda x, i: F.concat(F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), i + 1, F.lit(1)), F.lit(". "), x))
    return F.concat(question, F.lit("\n"), F.array_join(lines, "\n"), F.lit(CHOICE_TAIL))


def mc_answer(c: Column) -> Column:
    """The first letter A to H that stands alone, in upper case, else NULL."""
    found = F.regexp_extract(c, r"(?U)(?<!\w)([A-Ha-h])(?!\w)", 1)
    return F.upper(F.nullif(found, F.lit("")))


def last_number(c: Column) -> Column:
    """The last number of a text, thousands separators deleted; NULL if there is none."""
    found = F.regexp_extract_all(F.replace(c, F.lit(","), F.lit("")), F.lit(r"(-?\d+(?:\.\d+)?)"), F.lit(1))
    return F.try_element_at(found, F.lit(-1)).try_cast("double")


def normalize_answer(c: Column) -> Column:
    """Stripped, lower case, no commas or white space, no opening brackets in front or closing ones behind."""
    plain = F.regexp_replace(F.lower(strip(c)), r"(?U)[,\s]+", "")
    return F.regexp_replace(plain, r"^[\[({]+|[\])}]+$", "")


_NUMBER = r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+)?$"


def numeric_equal(a: Column, b: Column) -> Column:
    """Both are finite numbers and differ by less than 1e-6."""

    def number(c: Column) -> Column:
        return F.when(c.rlike(_NUMBER), F.replace(c, F.lit("_"), F.lit("")).try_cast("double"))

    return F.coalesce(F.abs(number(a) - number(b)) < 1e-6, F.lit(False))


def truth_match(answer: Column, targets: Column) -> Column:
    """1.0 if a target equals the answer as a number, is in it, or holds it; empty targets don't count, NULL or none: 0.0."""
    final = normalize_answer(answer)

    def hit(t: Column) -> Column:
        target = normalize_answer(t)
        return (target != "") & (numeric_equal(final, target) | F.contains(final, target) | F.contains(target, final))

    return F.coalesce(F.exists(targets, hit).cast("double"), F.lit(0.0))


def follows_instruction(prompt: Column, output: Column) -> Column:
    """Whether the output keeps the rules the prompt names; true if it names none."""
    out = F.lower(strip(output))

    def named(pattern: str) -> Column:
        return F.lower(F.nullif(F.regexp_extract(prompt, pattern, 1), F.lit("")))

    start, end, word = named("以“(.+?)”开头"), named("以“(.+?)”结尾"), named("包含关键词“(.+?)”")
    asks = F.contains(prompt, F.lit("回答“是”或“否”")) | F.contains(prompt, F.lit("回答是或否"))
    return (
        F.coalesce(F.startswith(out, start), F.lit(True))
        & F.coalesce(F.endswith(out, end), F.lit(True))
        & F.coalesce(F.contains(out, word), F.lit(True))
        & (~asks | out.rlike("^(是|否)[。.，, ]"))
    )


#: Marks of tool use, the first of which that occurs is reported (fixed values, in this order).
TOOL_MARKERS = ["tool_call", "function_call", '"tools"', '"observation"', '"action"', "<tool_call>", "«tool_call»"]


def tool_marker(c: Column) -> Column:
    out = F.lit(None).cast("string")
    for marker in reversed(TOOL_MARKERS):
        out = F.when(F.contains(c, F.lit(marker)), F.lit(marker)).otherwise(out)
    return out


def content_length(messages: Column) -> Column:
    """Code points of all contents."""
    return F.aggregate(messages, F.lit(0).cast("bigint"), lambda a, m: a + F.coalesce(F.length(m["content"]), F.lit(0)))


@functools.singledispatch
def _shape(value: object, levels: int) -> str:
    """The name of a scalar's type. Mappings and lists write what their members are, as many levels deep."""
    return type(value).__name__


def _members(values: Iterable, levels: int) -> list[str]:
    return [_shape(v, levels - 1) if levels else "..." for v in values]


@_shape.register
def _(value: dict, levels: int) -> str:
    return "{%s}" % ",".join(map(":".join, zip(value, _members(value.values(), levels))))


@_shape.register
def _(value: list, levels: int) -> str:
    return "[%s]" % "|".join(sorted(set(_members(value, levels))))


def json_shape(c: Column, levels: int = 4) -> Column:
    """The nested types of a JSON text; what lies deeper than ``levels`` is "..."; NULL if it can't be parsed."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        out = []
        for text in s:
            try:
                out.append(None if text is None else _shape(json.loads(text), levels))
            except ValueError:
                out.append(None)
        return pd.Series(out, dtype=object)

    return run(c)


#: Filler sentences and the hidden phrase of the long-context test (fixed values).
FILLERS = [
    "这一年夏天天气格外炎热，街上的行人都步履匆匆。",
    "图书馆里安静得能听见翻书的声音。",
    "远处的山峦在夕阳下呈现出一片金黄。",
    "他每天早上都会去公园慢跑三十分钟。",
    "会议纪要显示，项目将在下个月启动。",
    "火车缓缓驶出站台，窗外是连绵的田野。",
    "实验室的数据表明，实验结果符合预期。",
]
NEEDLE = "秘密口令是 7F3K9Q。"
NEEDLE_KEY = "7F3K9Q"


#: Sentences around the haystack (fixed values).
NEEDLE_HEAD, NEEDLE_TAIL = "下面是上下文，请从中找出隐藏的秘密口令并原样回答。\n上下文：\n", "\n\n问题：秘密口令是什么？"


def _hashed(seed: Column, i: Column) -> Column:
    """28 bits of a digest of two numbers."""
    return F.conv(F.left(F.md5(F.concat(seed.cast("string"), F.lit(":"), i.cast("string"))), F.lit(7)), 16, 10).cast("int")


def needle_prompt(context_len: Column, seed: Column) -> Column:
    """Filler sentences chosen by a hash of the seed until the length is reached, the phrase laid over at a hashed place.

    How many sentences it takes is told by their lengths, so the text is put together once.
    """
    shortest = min(map(len, FILLERS))
    fill = F.array(*(F.lit(x) for x in FILLERS))
    most = F.greatest(F.ceil(context_len / shortest).cast("int"), F.lit(1))

    def built(chosen: Column) -> Column:
        start = F.struct(F.lit(0).alias("chars"), F.lit(0).alias("taken"))
        count = F.aggregate(chosen, start, lambda a, x: F.when(a["chars"] < context_len, F.struct((a["chars"] + F.length(x)).alias("chars"), (a["taken"] + 1).alias("taken"))).otherwise(a))
        hay = F.array_join(F.slice(chosen, F.lit(1), count["taken"]), "")
        at = _hashed(seed, F.lit(0)) % F.greatest(F.lit(1), count["chars"] - 20)
        return F.overlay(hay, F.lit(NEEDLE), at + 1)

    chosen = F.transform(F.sequence(F.lit(1), most), lambda i: F.element_at(fill, _hashed(seed, i) % len(FILLERS) + 1))
    return F.concat(F.lit(NEEDLE_HEAD), F.transform(F.array(chosen), built)[0], F.lit(NEEDLE_TAIL))


def needle_hit(output: Column) -> Column:
    return F.contains(output, F.lit(NEEDLE_KEY))
