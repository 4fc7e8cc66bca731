"""Judging answers: prompt, score parsing, a rule-based judge, and the interface other judges plug into."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodeflow.functions.text import strip

#: The judge's instruction (fixed value).
RUBRIC = """你是一名严格的回答质量裁判。请按以下维度给候选回答打分（0-10 的整数）：

1. 思考质量（4 分）：<think> 内的推理步骤是否合理、完整、无跳跃，结论是否由思考导出；
2. 正确性（3 分）：最终回答是否准确回应了问题，无明显事实错误；
3. 简洁性（3 分）：思考与回答是否与问题难度匹配，不冗长、不空洞。

只输出一个 JSON：{"score": <0-10 的整数>}

问题：
%s

候选回答：
%s
"""
#: Words of a conclusion (fixed values).
CONCLUDES = ["因此", "所以", "综上", "答案"]


#: Labels of a score, and what stands between a label and its number (fixed values).
SCORE_LABELS, SCORE_MARKS = ["score", "评分", "分数"], ":：="


class Judge(Protocol):
    """Gives a column of scores from 0 to 10; a model-backed judge returns a pandas UDF of the same columns."""

    def score(self, question: Column, answer: Column) -> Column: ...


class RuleJudge:
    """Think tags 2, an answer longer than 0.3 of the question 3, shorter than 3,000 characters 3, a conclusion 2."""

    def score(self, question: Column, answer: Column) -> Column:
        tags = F.contains(answer, F.lit("<think>")) & F.contains(answer, F.lit("</think>"))
        concludes = F.lit(False)
        for word in CONCLUDES:
            concludes = concludes | F.contains(answer, F.lit(word))
        points = (
            F.when(tags, 2.0).otherwise(0.0)
            + F.when(F.length(answer) > F.length(question) * 0.3, 3.0).otherwise(0.0)
            + F.when(F.length(answer) < 3000, 3.0).otherwise(0.0)
            + F.when(concludes, 2.0).otherwise(0.0)
        )
        return F.least(points, F.lit(10.0))


def judge_prompt(question: Column, answer: Column) -> Column:
    head, middle, tail = RUBRIC.split("%s")
    return F.concat(F.lit(head), strip(question), F.lit(middle), strip(answer), F.lit(tail))


def parse_score(c: Column) -> Column:
    """The number after a score label, else the last number, kept within 0 and 10; NULL without a number."""
    quote = "[\"']?"
    pattern = f"(?i){quote}(?:{'|'.join(SCORE_LABELS)}){quote}" + rf"\s*[{SCORE_MARKS}]\s*(-?\d+(?:\.\d+)?)"
    labelled = F.regexp_extract(c, pattern, 1)
    numbers = F.regexp_extract_all(c, F.lit(r"(-?\d+(?:\.\d+)?)"), F.lit(1))
    raw = F.coalesce(F.nullif(labelled, F.lit("")), F.try_element_at(numbers, F.lit(-1))).cast("double")
    return F.when(raw.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(10.0), raw)))
