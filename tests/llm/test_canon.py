"""Canonical forms of labelled fields."""

import pytest

from lodeflow.llm.canon import labelled


@pytest.mark.parametrize(
    ("one", "two"),
    [
        ("name: {x}\nage: 3", "age: 3\nname: {x}"),
        ("-" * 45 + '{"name": "x", "age": 3}', "age: 3\nname: x"),
        ('{"a1": {"x": 1, "y": 2}, "b1": 3}', '{"b1": 3, "a1": {"y": 2, "x": 1}}'),
        ('{"a1": {"x": 1, "y": [{"p": 1, "q": null}]}, "b1": 3}', 'b1: 3\na1: {"y": [{"q": null, "p": 1}], "x": 1}'),
        ("{name: x\nage: 3}", "age: 3\nname: x"),
    ],
)
def test_order_and_notation(one, two):
    assert labelled(one) == labelled(two) is not None


def test_order_that_counts():
    assert labelled('{"a1": [1, 2]}') != labelled('{"a1": [2, 1]}')
    assert labelled("user: a\nassistant: b") is None and labelled('{"broken": ') is None and labelled("plain text") is None and labelled('{"a": 1} and more') is None
