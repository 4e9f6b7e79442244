"""Summaries of tool inputs in the order of the document, against the rules over Python's own JSON."""

import json

import pytest

from lorekit.operators.observations import KEY_ORDER, summarize_tool_events


def expected(text):
    try:
        obj = json.loads(text)
    except (TypeError, ValueError):
        return ""
    if not isinstance(obj, dict):
        return obj[:500] if isinstance(obj, str) else None
    parts = []
    for k in KEY_ORDER:
        v = obj.get(k)
        if isinstance(v, str):
            parts.append(f"{k}={v[:120]}")
        elif isinstance(v, (bool, int, float)):
            parts.append(f"{k}={v}")
        elif isinstance(v, list):
            parts.append(f"{k}=[{len(v)} items]")
    parts += [f"{k}={str(v)[:60]}" for k, v in obj.items() if k not in KEY_ORDER and isinstance(v, (str, bool, int, float))]
    return " ".join(parts)[:500]


TEXTS = ['{"zeta": 1, "alpha": "x", "query": "q", "file_path": "f", "mid": true, "command": "ls"}',
         '{"b": "' + "y" * 100 + '", "a": 2, "content": ["p", 1, {}], "o": {"z": 1}, "n": null, "prompt": "' + "p" * 200 + '"}',
         '{"k": 1, "j": 2, "k": "last", "command": "one", "i": 3, "command": "two"}', '{"s": "true", "t": "7", "u": 7, "v": false, "url": 5}',
         "{}", '"a bare string"', "broken {", None, "", '{"é": "ü", "x y": "1"}', '{"d": "' + "w " * 400 + '", "c": 1}']


@pytest.mark.parametrize("text", TEXTS)
def test_document_order(spark, text):
    got = summarize_tool_events(spark.createDataFrame([(text,)], "tool_input string")).first().input_summary
    assert got == expected(text)
