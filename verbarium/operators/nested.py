"""Flat related tables from deeply nested records (structural-variant tables).

A deterministic bottom-up tree automaton classifies every node of a record: leaves get a state from their type, an
object or list gets one from its fields and the states of its children. The state of a child collection and of its
items names the *structural variant* (``object/encoded``, ``keyed``, ``grouped/object`` ...). Every node is routed to the
typed table of its kind and variant; all keep the supertype keys (record key, entry position, child kind, child
position), which are also the parent links.

Two entry points: :func:`flatten_payloads` for JSON text of unknown shape (Arrow-batched Python, one pass, no shuffle:
Spark's VARIANT forgets the written order of object keys, on which positions depend) and :func:`child_table` for typed
``ARRAY<STRUCT>`` columns (built-in expressions only).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verbarium.plans.runtime import stored

NULL, BLANK, SCALAR, ENCODED, EMPTY, LIST, OBJECT, KEYED, GROUPED, ENTRY, OTHER = (
    "null", "blank", "scalar", "encoded", "empty", "list", "object", "keyed", "grouped", "entry", "other",
)


@dataclass(frozen=True)
class Kind:
    """A kind of child: the field that holds it, its own fields, and the field a bare string or map value fills."""

    name: str
    fields: tuple[str, ...]
    text: str
    key: str | None = None
    alias: dict[str, str] = field(default_factory=dict)
    numbers: tuple[str, ...] = ()


DEFINITIONS = Kind("definitions", ("language", "text"), "text", key="language")
EXAMPLES = Kind(
    "example_sentences", ("target", "contact", "english", "source_url"), "target", alias={"jejueo": "target", "korean": "contact"}
)
REFERENCES = Kind(
    "cross_references",
    ("source_title", "source_url", "source_type", "definition", "notes", "reliability_score"),
    "definition",
    numbers=("reliability_score",),
)
KINDS = (DEFINITIONS, EXAMPLES, REFERENCES)
ENTRY_FIELDS = ("headword_native", "headword_romanized", "pos")

_TEXT_COLUMNS = tuple(dict.fromkeys([*ENTRY_FIELDS, *(f for k in KINDS for f in k.fields if f not in k.numbers)]))
_NUMBER_COLUMNS = tuple(f for k in KINDS for f in k.numbers)


def _refuse(token: str) -> None:
    raise ValueError(token)


_TOKEN = re.compile(r"""[ \t\n\r]*(?:([\[\]{}:,])|("(?:[^"\\\x00-\x1f]|\\.)*")|(true|false|null|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?)(?=[\s,\]}:]|$))""")


def _read_deep(text: str) -> object:
    """The value of a JSON text of any depth: tokens in one pass, open containers on a list instead of the call stack."""
    open_: list[list] = []  # [container, key awaiting its value or None, state]
    done: list = []
    at, end = 0, len(text.rstrip(" \t\n\r"))

    def put(value: object) -> None:
        if not open_:
            done.append(value)
            return
        top = open_[-1]
        if isinstance(top[0], list):
            top[0].append(value)
        else:
            top[0][top[1]] = value
        top[2] = "after"

    while at < end:
        m = _TOKEN.match(text, at)
        if not m or done:
            raise ValueError("not JSON")
        at = m.end()
        mark, quoted, plain = m.groups()
        top = open_[-1] if open_ else None
        state = top[2] if top else "value"
        if mark in ("]", "}"):
            if not top or isinstance(top[0], list) != (mark == "]") or state not in ("after", "first"):
                raise ValueError("not JSON")
            open_.pop()
            put(top[0])
        elif mark == ",":
            if state != "after":
                raise ValueError("not JSON")
            top[2] = "value" if isinstance(top[0], list) else "key"
        elif mark == ":":
            if state != "colon":
                raise ValueError("not JSON")
            top[2] = "value"
        elif quoted and top and isinstance(top[0], dict) and state in ("first", "key"):
            top[1], top[2] = json.loads(quoted), "colon"
        elif state == "value" or state == "first" and isinstance(top[0], list):
            if mark:
                box: object = [] if mark == "[" else {}
                open_.append([box, None, "first"])
            else:
                put(json.loads(quoted or plain))
        else:
            raise ValueError("not JSON")
    if open_ or not done:
        raise ValueError("not JSON")
    return done[0]


def read_json(text: str | None) -> tuple[bool, object]:
    """(readable, value). Truncated, blank and null texts and NaN are unreadable; no depth is."""
    if text is None:
        return False, None
    try:
        return True, json.loads(text, parse_constant=_refuse)
    except RecursionError:
        pass
    except ValueError:
        return False, None
    try:
        return True, _read_deep(text)
    except ValueError:
        return False, None


def write_json(value: object) -> str:
    """The JSON text of a value of any depth."""
    try:
        return json.dumps(value, ensure_ascii=False)
    except RecursionError:
        pass
    out: list[str] = []
    stack: list[tuple[bool, object]] = [(False, value)]  # (already text, piece)
    while stack:
        text, x = stack.pop()
        if text:
            out.append(x)
        elif isinstance(x, (dict, list)):
            parts: list[tuple[bool, object]] = [(True, "{" if isinstance(x, dict) else "[")]
            for i, item in enumerate(x.items() if isinstance(x, dict) else x):
                lead = ", " if i else ""
                if isinstance(x, dict):
                    parts += [(True, f"{lead}{json.dumps(item[0], ensure_ascii=False)}: "), (False, item[1])]
                else:
                    parts += [(True, lead), (False, item)]
            parts.append((True, "}" if isinstance(x, dict) else "]"))
            stack.extend(reversed(parts))
        else:
            out.append(json.dumps(x, ensure_ascii=False))
    return "".join(out)


def has_value(node: object) -> bool:
    """Whether any leaf below ``node`` is a number, a boolean or a text that is not blank."""
    stack = [node]
    while stack:
        x = stack.pop()
        if isinstance(x, dict):
            stack.extend(x.values())
        elif isinstance(x, list):
            stack.extend(x)
        elif isinstance(x, str):
            if x.strip():
                return True
        elif x is not None:
            return True
    return False


class ShapeAutomaton:
    """Bottom-up tree automaton over JSON. ``state(node, kind)`` is the state in the alphabet of ``kind``'s fields.

    All walks keep their own stack, so depth costs memory only; the state of a node is found once a record.
    The variant of a child is the kinds of wrapper above it in the order of their first occurrence and its own state
    (``grouped/list/object``): finitely many, however deep the record, so they can name tables.
    """

    def __init__(self, kinds: tuple[Kind, ...] = KINDS, entry_fields: tuple[str, ...] = ENTRY_FIELDS):
        self.kinds = kinds
        self.entry = frozenset(entry_fields) | {k.name for k in kinds}
        self.known = {k.name: frozenset(k.fields) | set(k.alias) for k in kinds}

    def leaf(self, node: object) -> str | None:
        if node is None:
            return NULL
        if isinstance(node, str):
            s = node.strip()
            return BLANK if not s else ENCODED if s[0] in "[{" and read_json(s)[0] else SCALAR
        return None if isinstance(node, (dict, list)) else SCALAR

    def _shallow(self, node: object, kind: Kind) -> str | None:
        """The state of a node that needs none of its children's, else None."""
        if (s := self.leaf(node)) is not None:
            return s
        if isinstance(node, list):
            return LIST
        if not node:
            return EMPTY
        return None if self.known[kind.name].isdisjoint(node) else OBJECT

    def state(self, node: object, kind: Kind, memo: dict[int, str] | None = None) -> str:
        """State of one value in the place of ``kind``: transitions on the states of its own children, leaves first.
        ``memo`` holds the states of objects already met (by identity)."""
        if (s := self._shallow(node, kind)) is not None:
            return s
        memo = {} if memo is None else memo
        todo = [node]
        while todo:
            x = todo[-1]
            if id(x) in memo:
                todo.pop()
                continue
            below, wait = set(), []
            for v in x.values():
                s = self._shallow(v, kind)
                if s is None:
                    s = memo.get(id(v))
                if s is None:
                    wait.append(v)
                else:
                    below.add(s)
            if wait:
                todo.extend(wait)
                continue
            memo[id(x)] = GROUPED if below & {LIST, OBJECT, GROUPED} else KEYED if kind.key and below <= {SCALAR, BLANK, NULL, ENCODED} else OTHER
            todo.pop()
        return memo[id(node)]

    def children(self, node: object, kind: Kind) -> Iterator[tuple[str, object, str | None]]:
        """(variant, child, key) of each child in ``node`` as written; blank and null ones count too."""
        memo: dict[int, str] = {}
        kept: list[object] = []  # decoded texts stay alive, as states are known by identity
        # (value, wrappers so far, key, whether it stands as a list's item)
        todo: list[tuple[object, tuple[str, ...], str | None, bool]] = [(node, (), None, False)]
        while todo:
            x, above, key, item = todo.pop()
            s = self.state(x, kind, memo)
            wrap = lambda w: above if w in above else (*above, w)  # noqa: B023, E731
            if s == LIST:
                a = wrap(LIST) if item else above
                todo.extend((y, a, key, True) for y in reversed(x))
            elif item:
                yield "/".join((*above, s)), x, key
            elif s == KEYED:
                yield from (("/".join((*above, KEYED)), v, k) for k, v in x.items())
            elif s == GROUPED:
                a = wrap(GROUPED)
                todo.extend((v, a, k, False) for k, v in reversed(x.items()))
            elif s == ENCODED:
                kept.append(read_json(x)[1])
                todo.append((kept[-1], wrap(ENCODED), key, False))
            elif s != NULL:
                yield "/".join((*above, s)), x, key

    def entries(self, node: object) -> list[object] | None:
        """The entry list below any depth of wrappers, or None. A lone entry is a list of one; of an object's fields the first
        that holds entries counts, of a list's items all do."""
        # open nodes: [children still to see, None for an object or the entries found in a list, whether that list is ours]
        open_: list[list] = []
        x = node
        while True:
            if isinstance(x, str) and self.leaf(x) == ENCODED:
                x = read_json(x)[1]
            found: list | None = None
            if isinstance(x, list):
                if any(isinstance(y, dict) and not self.entry.isdisjoint(y) for y in x):
                    found = x
                else:
                    open_.append([iter([y for y in x if isinstance(y, (dict, list))]), [], False])
            elif isinstance(x, dict):
                if not self.entry.isdisjoint(x):
                    found = [x]
                else:
                    open_.append([iter(list(x.values())), None, False])
            # hand the result up until some open node has a child left
            while True:
                if not open_:
                    return found
                top = open_[-1]
                if found:
                    if top[1] is None:
                        open_.pop()
                        continue
                    if not top[1]:
                        top[1] = found
                    elif not top[2]:
                        top[1:] = [[*top[1], *found], True]
                    else:
                        top[1].extend(found)
                    found = None
                nothing = object()
                x = next(top[0], nothing)
                if x is not nothing:
                    break
                open_.pop()
                found = top[1] or None


def _clean(v: object) -> str | None:
    """A text for Arrow: lone surrogates become U+FFFD; nested values keep their JSON form."""
    if v is None:
        return None
    s = v if isinstance(v, str) else write_json(v)
    try:
        s.encode()
        return s
    except UnicodeEncodeError:
        return s.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def _number(v: object) -> float | None:
    try:
        return None if isinstance(v, bool) or v is None else float(v)
    except (TypeError, ValueError):
        return None


def _typed(kind: Kind, child: object, key: str | None) -> dict[str, object]:
    """The columns of ``kind`` for one child of any variant."""
    if not isinstance(child, dict):
        out = {kind.text: child if isinstance(child, str) else None}
        return out | ({kind.key: key} if kind.key and key is not None else {})
    out = {f: child.get(f) for f in kind.fields}
    for a, f in kind.alias.items():
        if out.get(f) is None and a in child:
            out[f] = child[a]
    source = child.get("source")
    if "source_url" in kind.fields and out["source_url"] is None and isinstance(source, dict):
        out["source_url"] = source.get("url")
    return out


NODE_SCHEMA = T.StructType(
    [
        T.StructField("record", T.LongType()),
        T.StructField("entry_pos", T.IntegerType()),
        T.StructField("child", T.StringType()),
        T.StructField("child_pos", T.IntegerType()),
        T.StructField("variant", T.StringType()),
        T.StructField("filled", T.BooleanType()),
    ]
    + [T.StructField(c, T.StringType()) for c in _TEXT_COLUMNS]
    + [T.StructField(c, T.DoubleType()) for c in _NUMBER_COLUMNS]
)
_KEYS = T.StructType(NODE_SCHEMA.fields[:6])


def flatten_payloads(df: DataFrame, key: str, payload: str, typed: bool = True) -> DataFrame:
    """One row per entry and per child found in the JSON text ``payload``.

    ``child`` is ``entries`` for an entry itself, else the kind. ``filled`` tells whether the node holds at least one
    value that is neither null nor blank. ``typed=False`` leaves out the typed columns (fewer bytes from Python).
    Unreadable, blank and null payloads give no row, any depth is read; an entry that is null or no object gives none but keeps its place.
    Repeated rows give repeated results. Only ``key`` and ``payload`` are read, so other columns may have any name.
    """
    schema = NODE_SCHEMA if typed else _KEYS
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        auto = ShapeAutomaton()
        for b in batches:
            rows: list[tuple] = []
            for k, text in zip(b["record"], b["payload"]):
                ok, value = read_json(text)
                found = auto.entries(value) if ok else None
                k = None if pd.isna(k) else int(k)
                for i, e in enumerate(found or []):
                    if not isinstance(e, dict):
                        continue
                    if typed:
                        own = {f: _clean(e.get(f)) for f in ENTRY_FIELDS}
                        rows.append((k, i, "entries", 0, ENTRY, has_value(e), *(own.get(c) for c in _TEXT_COLUMNS), *(None for _ in _NUMBER_COLUMNS)))
                    for kind in KINDS:
                        for p, (variant, c, at) in enumerate(auto.children(e.get(kind.name), kind)):
                            head = (k, i, kind.name, p, variant, has_value(c))
                            if typed:
                                t = _typed(kind, c, at)
                                head += tuple(_clean(t.get(x)) for x in _TEXT_COLUMNS) + tuple(_number(t.get(x)) for x in _NUMBER_COLUMNS)
                            rows.append(head)
            out = pd.DataFrame(rows, columns=names)
            for c in ("record",):
                out[c] = out[c].astype("Int64")
            yield out

    src = df.select(F.col(key).cast("long").alias("record"), F.col(payload).cast("string").alias("payload"))
    return src.mapInPandas(run, schema)


def subtype_columns(kind: Kind, variant: str) -> tuple[str, ...]:
    """The typed columns that a child of this variant can fill."""
    last = variant.rsplit("/", 1)[-1]
    if last == OBJECT:
        return kind.fields
    if last == KEYED:
        return (kind.key, kind.text) if kind.key else (kind.text,)
    return (kind.text,) if last == SCALAR else ()


def subtype_tables(nodes: DataFrame, key: str) -> dict[tuple[str, str], DataFrame]:
    """(kind, variant) -> table of that subtype: the supertype's keys (``key``, ``entry_pos``, ``child_pos``: the parent link) and the
    columns the variant can fill. Nodes are routed by writing them partitioned by kind and variant, so each table is one pruned
    folder; the variants that occur are read from there (finitely many, see :class:`ShapeAutomaton`)."""
    routed = stored(nodes.where("filled or child = 'entries'"), "p7-nodes", ("child", "variant"))
    out = {}
    kinds = {k.name: k for k in KINDS}
    for r in routed.select("child", "variant").distinct().collect():
        rows = routed.where((F.col("child") == r["child"]) & (F.col("variant") == r["variant"]))
        link = [F.col("record").alias(key), "entry_pos"]
        cols = ENTRY_FIELDS if r["child"] == "entries" else ("child_pos", *subtype_columns(kinds[r["child"]], r["variant"]))
        out[r["child"], r["variant"]] = rows.select(*link, *cols)
    return out


def payload_tables(nodes: DataFrame, key: str) -> dict[str, DataFrame]:
    """The supertype tables of :func:`flatten_payloads`: ``entries`` and one per kind with the children that hold a value, each the
    union of its subtype tables with the ``variant``; ``record`` is renamed to ``key``."""
    parts = subtype_tables(nodes, key)
    none = nodes.where("false").select(F.col("record").alias(key), *NODE_SCHEMA.names[1:])
    out = {"entries": parts.get(("entries", ENTRY), none.select(key, "entry_pos", *ENTRY_FIELDS))}
    for kind in KINDS:
        x = none.select(key, "entry_pos", "child_pos", "variant", *kind.fields)
        for (k, v), t in sorted(parts.items()):
            if k == kind.name:
                x = x.unionByName(t.withColumn("variant", F.lit(v)), allowMissingColumns=True)
        out[kind.name] = x
    return out


def _filled(c: Column, t: T.DataType) -> Column:
    if isinstance(t, T.StringType):
        return F.coalesce(F.length(F.trim(c)) > 0, F.lit(False))
    if isinstance(t, T.ArrayType):
        return F.coalesce(F.size(c) > 0, F.lit(False))
    return c.isNotNull()


def child_table(df: DataFrame, keys: list[str], column: str, keep_empty: bool = False) -> DataFrame:
    """Rows of an ``ARRAY<STRUCT>`` (or ``ARRAY<scalar>``) column with parent keys, place and structural variant.

    ``child_pos`` counts from 0, null and blank items counted. ``variant`` lists the fields that hold a value, joined
    by ``+`` (``''``: none; such rows only with ``keep_empty``). A null or empty array gives no row. Fields whose names
    clash with a key get the prefix ``<column>_``.
    """
    item = df.schema[column].dataType.elementType
    x = df.select(*keys, F.posexplode(F.col(column)).alias("child_pos", "__item"))
    if isinstance(item, T.StructType):
        parts = [(f.name, F.col(f"__item.`{f.name}`"), f.dataType) for f in item.fields]
    else:
        parts = [("value", F.col("__item"), item)]
    taken = {*keys, "child_pos", "variant"}
    variant = F.concat_ws("+", *(F.when(_filled(c, t), F.lit(n)) for n, c, t in parts))
    out = x.select(*keys, "child_pos", variant.alias("variant"), *(c.alias(n if n not in taken else f"{column}_{n}") for n, c, t in parts))
    return out if keep_empty else out.where(F.col("variant") != "")
