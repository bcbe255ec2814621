"""Capture of arguments and results of calls, and what specifications are made of."""

from __future__ import annotations

import datetime
import functools
import inspect
import json
from collections.abc import Callable
from decimal import Decimal


def plain(value: object, depth: int = 6):
    """A value as JSON data: numbers, texts and nulls as they are, collections by element, the rest as text.

    Sets are sorted by text; data frames and arrays give their own lists; whatever raises
    on the way, and everything below ``depth``, becomes the name of its type in brackets.
    """
    kind = type(value)
    if value is None or kind in (bool, int, float, str):
        return value
    if depth == 0:
        return f"<{kind.__qualname__}>"
    try:
        if isinstance(value, dict):
            return {str(k): plain(v, depth - 1) for k, v in value.items()}
        if isinstance(value, (list, tuple)):
            return [plain(v, depth - 1) for v in value]
        if isinstance(value, (set, frozenset)):
            return sorted((plain(v, depth - 1) for v in value), key=str)
        if isinstance(value, (datetime.date, datetime.time)):
            return value.isoformat()
        if isinstance(value, Decimal):
            return float(value)
        if isinstance(value, bytes):
            return value.decode("utf-8", "replace")
        for method in ("tolist", "to_dict"):
            if hasattr(value, method):
                return plain(getattr(value, method)(), depth - 1)
        if hasattr(value, "__dict__"):
            return {k: plain(v, depth - 1) for k, v in vars(value).items()}
        return str(value)
    except Exception:  # noqa: BLE001  any object may be passed
        return f"<{kind.__qualname__}>"


def type_name(value: object) -> str:
    return f"{type(value).__module__}.{type(value).__qualname__}"


class Capture:
    """Wraps functions and keeps one record for each call that returned."""

    def __init__(self) -> None:
        self.records: list[dict] = []

    def wrap(self, fn: Callable) -> Callable:
        sign = inspect.signature(fn)

        @functools.wraps(fn)
        def run(*args, **kwargs):
            bound = sign.bind(*args, **kwargs)
            bound.apply_defaults()
            inputs = {k: plain(v) for k, v in bound.arguments.items()}
            types = {k: type_name(v) for k, v in bound.arguments.items()}
            out = fn(*args, **kwargs)
            self.records.append({"func_name": fn.__name__, "inputs": inputs, "input_types": types, "output": plain(out), "output_type": type_name(out)})
            return out

        return run

    def dump(self) -> str:
        return json.dumps(self.records, ensure_ascii=False)


def merged_types(records: list[dict]) -> dict[str, str]:
    """The types seen of each argument and of ``return``, joined by a bar in order of name."""
    seen: dict[str, set[str]] = {}
    for r in records:
        for k, t in [*r["input_types"].items(), ("return", r["output_type"])]:
            seen.setdefault(k, set()).add(t)
    return {k: " | ".join(sorted(v)) for k, v in seen.items()}
