"""Walks over nested JSON to any depth, a document at a time.

Expressions look a fixed number of levels deep, so what depends on all levels is found by
small Arrow-batched functions on the JSON text of a VARIANT (sorted keys, no white
space). They return paths and texts; values are then picked natively by path. Levels are
kept in lists, not in calls. Null and broken texts give null.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from itertools import accumulate, chain
from json.encoder import encode_basestring

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

ARRAYS = "array<struct<path:string,steps:array<string>,n:bigint,keys:array<string>>>"


class Number(str):
    """A number as it is written."""


_DECODER = json.JSONDecoder(parse_int=Number, parse_float=Number, parse_constant=Number)


def _read(text: str):
    return _DECODER.decode(text)


def _text(value) -> str:
    """Compact JSON of a value."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{encode_basestring(k)}:{_text(v)}" for k, v in value.items()) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_text, value)) + "]"
    if isinstance(value, str) and not isinstance(value, Number):
        return encode_basestring(value)
    return _scalar(value) or "null"


def _scalar(value) -> str | None:
    if value is None:
        return None
    return value if isinstance(value, str) else str(value).lower()  # true, false


def _levels(value, depth: int | None, list_items: int | None) -> Iterator[tuple[str, tuple, object]]:
    """(path, steps, container) of every object and list, level by level; the root has
    depth 0."""
    level = [("", (), value)] if isinstance(value, (dict, list)) else []
    while level:
        yield from level
        if depth is not None:
            if depth == 0:
                return
            depth -= 1
        below = []
        for path, steps, node in level:
            if isinstance(node, dict):
                below += [(f"{path}.{k}" if path else k, (*steps, f".{k}"), v) for k, v in node.items() if isinstance(v, (dict, list))]
            else:
                below += [(f"{path}[{i}]", (*steps, f"[{i}"), v) for i, v in enumerate(node[:list_items]) if isinstance(v, (dict, list))]
        level = below


def _steps(place: tuple | None) -> list[str]:
    """Steps from the root; a place is (the place it is in, the key or the number there)."""
    steps = []
    while place is not None:
        place, key = place
        steps.append(f".{key}" if isinstance(key, str) else f"[{key}")
    return steps[::-1]


def _path(steps: list[str]) -> str:
    path = ""
    for s in steps:
        path = f"{path}{s}]" if s[0] == "[" else path + s if path else s[1:]
    return path or "$"


def arrays_in(value, depth: int | None, list_items: int | None, limit: int | None) -> list[tuple]:
    """(path, steps, n, keys) of the arrays of two or more objects that are 60 percent of
    the items or more. Steps and paths are made for these alone."""
    found = []
    level = [(value, None)] if isinstance(value, (dict, list)) else []
    while level:
        below = []
        for node, place in level:
            if isinstance(node, dict):
                below += [(v, (place, k)) for k, v in node.items() if isinstance(v, (dict, list))]
                continue
            objects = [x for x in node if isinstance(x, dict)]
            if len(objects) >= 2 and len(objects) >= len(node) * 0.6:
                found.append((len(objects), set().union(*objects), place))
            inner = node if list_items is None else node[:list_items]
            below += [(v, (place, i)) for i, v in enumerate(inner) if isinstance(v, (dict, list))]
        if depth is not None:
            if depth == 0:
                break
            depth -= 1
        level = below
    if limit == 1 and found:
        best = min((-n, -len(keys)) for n, keys, _ in found)
        found = [a for a in found if (-a[0], -len(a[1])) == best]
    made = [(_path(steps := _steps(place)), steps, n, sorted(keys)) for n, keys, place in found]
    made.sort(key=lambda a: (-a[2], -len(a[3]), a[0]))
    return made[:limit]


def flat(value, depth: int | None, list_items: int | None) -> list[tuple[str, str | None]]:
    """(name, text) of the leaves of an object. A list that begins with an object has its
    items numbered; another list of scalars is its values; other lists are JSON text."""
    found: dict[str, str | None] = {}
    level, at = list(value.items()) if isinstance(value, dict) else [], 0
    while level:
        below = []
        deeper = depth is None or at < depth
        for name, node in level:
            if node is None or isinstance(node, str):
                found[name] = node
            elif isinstance(node, dict) and deeper:
                below += [(f"{name}.{k}", v) for k, v in node.items()]
            elif isinstance(node, list) and node and isinstance(node[0], dict) and deeper:
                for i, item in enumerate(node[:list_items]):
                    if isinstance(item, dict):
                        below += [(f"{name}.{i}.{k}", v) for k, v in item.items()]
                    else:
                        below.append((f"{name}.{i}", item))
            elif isinstance(node, list):
                nested = any(isinstance(x, (dict, list)) for x in node)
                found[name] = None if not node else _text(node) if nested else ", ".join(_scalar(x) or "" for x in node)
            else:
                found[name] = _text(node) if isinstance(node, dict) else _scalar(node)
        level = below
        at += 1
    return list(found.items())


def types_in(value, depth: int | None) -> list[str]:
    """Texts of '@type' (else 'type') of all objects, sorted."""
    found: set[str] = set()
    for _, _, node in _levels(value, depth, None):
        if isinstance(node, dict):
            kind = node.get("@type")
            kind = node.get("type") if kind is None else kind
            kinds = kind if isinstance(kind, list) else [kind]
            found.update(k for k in kinds if isinstance(k, str) and not isinstance(k, Number))
    return sorted(found)


def rows_inside(value, depth: int | None) -> list[str] | None:
    """Steps to the first list of objects below the usual wrapper keys, in their order; an
    object of scalars alone counts after everything inside it."""
    stack: list[tuple] = [(value, [], 0, False)]
    while stack:
        node, steps, at, opened = stack.pop()
        if isinstance(node, list):
            if node and all(isinstance(x, dict) for x in node):
                return steps
        elif isinstance(node, dict):
            if opened or not (inside := [k for k in fixed.WRAPPER_KEYS if node.get(k) is not None]) or depth == at:
                if node and not any(isinstance(x, (dict, list)) for x in node.values()):
                    return steps
                continue
            stack.append((node, steps, at, True))
            stack += [(node[k], [*steps, f".{k}"], at + 1, False) for k in reversed(inside)]
    return None


def _arrow(of: Callable, kind: str, arrow: pa.DataType) -> Callable[[Column], Column]:
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else of(json.loads(t)) for t in texts.to_pylist()], arrow)

    return F.arrow_udf(run, kind)


_STEPS = pa.list_(pa.string())


def _texts(lists) -> pa.ListArray:
    """Lists of texts, built from one flat column."""
    ends = pa.array([0, *accumulate(map(len, lists))], pa.int32())
    return pa.ListArray.from_arrays(ends, pa.array(list(chain.from_iterable(lists)), pa.string()))


def record_arrays(v, depth: int | None = None, list_items: int | None = None, limit: int | None = None) -> Column:
    """ARRAYS of a VARIANT, the most objects first, then the most keys, then by path."""

    def run(texts: pa.Array) -> pa.Array:
        found = [None if t is None else arrays_in(json.loads(t), depth, list_items, limit) for t in texts.to_pylist()]
        paths, steps, counts, keys = zip(*[a for own in found if own for a in own]) if any(found) else ((), (), (), ())
        columns = [pa.array(paths, pa.string()), _texts(steps), pa.array(counts, pa.int64()), _texts(keys)]
        items = pa.StructArray.from_arrays(columns, names=["path", "steps", "n", "keys"])
        ends = pa.array([0, *accumulate(len(own or ()) for own in found)], pa.int32())
        return pa.ListArray.from_arrays(ends, items, mask=pa.array([own is None for own in found], pa.bool_()))

    return F.arrow_udf(run, ARRAYS)(F.to_json(v))


def leaves(v, depth: int | None = None, list_items: int | None = None) -> Column:
    """map<string,string> of all leaves of an object; an empty map for null and anything else."""

    def run(texts: pa.Array) -> pa.Array:
        found = [[] if t is None else flat(_read(t), depth, list_items) for t in texts.to_pylist()]
        ends = pa.array([0, *accumulate(map(len, found))], pa.int32())
        names = pa.array([k for own in found for k, _ in own], pa.string())
        return pa.MapArray.from_arrays(ends, names, pa.array([x for own in found for _, x in own], pa.string()))

    return F.arrow_udf(run, "map<string,string>")(F.to_json(v))


def type_texts(v, depth: int | None = None) -> Column:
    return _arrow(lambda x: types_in(x, depth), "array<string>", _STEPS)(F.to_json(v))


def steps_to_rows(v, depth: int | None = None) -> Column:
    return _arrow(lambda x: rows_inside(x, depth), "array<string>", _STEPS)(F.to_json(v))


def at_steps(v: Column, steps: Column) -> Column:
    """The value at steps, each a key after '.' or a place after '['."""

    def step(node: Column, s: Column) -> Column:
        rest = F.substring(s, 2, 2_147_483_647)
        member = F.try_element_at(F.try_variant_get(node, "$", "map<string,variant>"), rest)
        item = F.get(F.try_variant_get(node, "$", "array<variant>"), rest.try_cast("int"))
        return F.when(F.startswith(s, F.lit(".")), member).otherwise(item)

    return F.aggregate(steps, v, step)
