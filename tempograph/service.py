"""The service surface: named tools over a ``Memory``, for whatever transport carries them."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from tempograph.api import Memory


def tools(memory: Memory) -> dict[str, Callable[..., Any]]:
    """What a client may call, by name; arguments and results are plain values."""

    def rows(frame) -> list[dict]:
        return [r.asDict(recursive=True) for r in frame.collect()]

    return {
        "remember": lambda episodes, facts=None: memory.remember(*_frames(memory, episodes, facts)),
        "recall": lambda query, k=10, namespaces=None, as_of=None: rows(memory.content(query, k, namespaces, as_of)),
        "facts_at": lambda time: rows(memory.facts_at(time)),
        "history": lambda entity: rows(memory.history(entity)),
        "forget": memory.forget,
        "consolidate": memory.dream,
    }


def _frames(memory: Memory, episodes: list[dict], facts: list[dict] | None) -> tuple:
    from tempograph import schema

    made = []
    for name, given in (("episodes", episodes), ("facts", facts)):
        fields = [f for f in schema.TABLES[name] if given and any(f.name in g for g in given)]
        made.append(memory.spark.createDataFrame([tuple(g.get(f.name) for f in fields) for g in given], schema.T.StructType(fields)) if given else None)
    return tuple(made)


def call(memory: Memory, name: str, arguments: dict[str, Any]) -> dict[str, Any]:
    """A tool's result, or what is wrong with the call."""
    tool = tools(memory).get(name)
    if tool is None:
        return {"error": f"no tool {name}"}
    try:
        return {"result": tool(**arguments)}
    except TypeError as error:
        return {"error": str(error)}
