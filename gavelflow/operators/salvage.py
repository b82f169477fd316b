"""Items out of the answers of authoring models: plain Python, called by Arrow functions."""

from __future__ import annotations

import ast
import json
import re

SINGLE = re.compile(r"""\{[^{}]*?["']premise["']\s*:\s*(["'])(?P<p>.*?)\1\s*,\s*["']hypothesis["']\s*:\s*(["'])(?P<h>.*?)\3\s*,\s*["']label["']\s*:\s*(?P<y>[012])[^{}]*?\}""", re.S)


def read_literal(text: str) -> list | None:
    """A JSON text or a Python literal as a list of items: a list itself, or what an object has under samples or data."""
    for read in (json.loads, ast.literal_eval):
        try:
            value = read(text)
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            continue
        value = value.get("samples", value.get("data", [])) if isinstance(value, dict) else value
        if isinstance(value, list):
            return value
    return None


def salvaged(text: str | None) -> list:
    """The items of an answer: read as a whole, else up to the last closed brace, else one by one."""
    text = re.sub(r"^```(?:json)?\s*|\s*```$", "", (text or "").strip())
    marks = sorted((i, a, b) for a, b in ("[]", "{}") if (i := text.find(a)) >= 0 and text.rfind(b) > i)
    whole = read_literal(text[marks[0][0] : text.rfind(marks[0][2]) + 1]) if marks else None
    if whole is not None:
        return whole
    closed = text[: text.rfind("}") + 1]
    for end in ("]}", "]"):
        items = read_literal(closed[closed.find("[") if end == "]" and not closed.startswith("{") else 0 :] + end) if closed else None
        if items:
            return items
    return [{"premise": m["p"], "hypothesis": m["h"], "label": int(m["y"])} for m in SINGLE.finditer(text)]
