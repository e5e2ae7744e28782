"""Deeply nested records into flat tables, by adjacency-table shredding.

Every value of a document becomes a node row: node, parent, label, ordinal, kind and scalar. Rules name
which nodes are entities; while shredding each entity also learns its path, and its content, which leaves
out the entities inside. Entity tables come from the node table by bringing entities and the nodes below
them together and pivoting relative paths into columns; parent_links joins each entity to the one it lies in.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from braidframe.operators import jsontext
from braidframe.session import ship, task_count

#: Values, apart from objects and arrays.
SCALARS = ("string", "whole", "fraction", "boolean", "null")
#: Text characters of a batch handed back to Spark at once.
_FLUSH_ROWS = 20_000
#: Nodes up to so many steps below their entity have a relative path; longer ones would grow with the square of the depth.
REACH = 8


@dataclass(frozen=True)
class Entity:
    """``steps`` lead from the root to the entity.

    A step is a key; ``*`` for any key of an object; ``#`` for any array element; ``**`` for any
    number of steps; ``key{}`` for a key whose value must be an object. ``kind`` limits the entity's
    own kind.
    """

    name: str
    steps: tuple[str, ...]
    kind: str | None = None


class _Matcher:
    """Follows all rules at once; sets of open positions are numbered and their moves remembered."""

    def __init__(self, rules: tuple[Entity, ...]) -> None:
        self.rules = rules
        self.known = {s.removesuffix("{}") for r in rules for s in r.steps} - {"*", "#", "**"}
        self.states: list[frozenset[tuple[int, int]]] = []
        self.number: dict[frozenset, int] = {}
        self.moves: dict[tuple[int, str | None, str], tuple[int, int]] = {}
        self.start = self._state({(i, 0) for i in range(len(rules))})

    def _state(self, positions: set[tuple[int, int]]) -> int:
        todo = list(positions)
        while todo:
            i, at = todo.pop()
            steps = self.rules[i].steps
            if at < len(steps) and steps[at] == "**" and (i, at + 1) not in positions:
                positions.add((i, at + 1))
                todo.append((i, at + 1))
        key = frozenset(positions)
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
        return self.number[key]

    def move(self, state: int, label: str | None, kind: str) -> tuple[int, int]:
        """The next state, and the number of the rule that the child meets or -1. label: None for an array element."""
        if label is not None and label not in self.known:
            label = ""  # any other key
        found = self.moves.get((state, label, kind))
        if found is None:
            nxt, hit = set(), -1
            for i, at in self.states[state]:
                rule = self.rules[i]
                if at == len(rule.steps):
                    continue
                step = rule.steps[at]
                if step == "**":
                    to = at
                elif (step == "#" and label is None) or (step == "*" and label is not None) or (step.removesuffix("{}") == label and (not step.endswith("{}") or kind == "object")):
                    to = at + 1
                else:
                    continue
                nxt.add((i, to))
            state_ = self._state(nxt)
            for i, at in sorted(self.states[state_]):
                if at == len(self.rules[i].steps) and self.rules[i].kind in (None, kind) and hit < 0:
                    hit = i
            found = self.moves[(state, label, kind)] = (state_, hit)
        return found


def _own(value, state: int, matcher: _Matcher):
    """A copy of a container in which the entities inside are null."""
    copy: dict | list = {} if type(value) is dict else []
    todo = [(value, state, copy)]
    while todo:
        box, at, into = todo.pop()
        named = type(box) is dict
        for key, child in box.items() if named else enumerate(box):
            k = jsontext.kind(child)
            nxt, met = matcher.move(at, key if named else None, k)
            new = child
            if met >= 0:
                new = None
            elif k == "object" or k == "array":
                new = {} if k == "object" else []
                todo.append((child, nxt, new))
            if named:
                into[key] = new
            else:
                into.append(new)
    return copy


def step_name(key: str) -> str:
    """A key as a step of a relative path: ``~``, ``/`` and ``#`` become ``~0``, ``~1`` and ``~2``."""
    return key.replace("~", "~0").replace("/", "~1").replace("#", "~2")


def _walk(root, matcher: _Matcher, made: set[str]) -> Iterator[tuple]:
    """Node rows in document order: (node, parent, label, ordinal, kind, scalar, entity, path, owner, content, home, rel).

    Of label, scalar, content and rel only those in ``made`` are filled.
    """
    with_label, with_scalar, with_content, with_rel = (c in made for c in ("label", "scalar", "content", "rel"))
    node = 0
    # value, its parent's number, label, ordinal, state, path, path of the nearest entity, rule met, number of that entity, steps from there
    todo = [(root, None, None, 0, matcher.start, "", "", -1, None, None)]
    while todo:
        value, parent, label, ordinal, state, path, owner, hit, home, steps = todo.pop()
        k = jsontext.kind(value)
        box = k == "object" or k == "array"
        scalar = None if box or value is None or not with_scalar else jsontext.clean(value) if k == "string" else str(value).lower() if k == "boolean" else str(value)
        content = jsontext.dump(_own(value, state, matcher)) if with_content and box and hit >= 0 else None
        rel = jsontext.clean("/".join(steps)) if steps and hit < 0 else None
        yield node, parent, None if label is None or not with_label else jsontext.clean(label), ordinal, k, scalar, matcher.rules[hit].name if hit >= 0 else None, jsontext.clean(path) if hit >= 0 else None, jsontext.clean(owner) if hit >= 0 else None, content, home, rel
        if box:
            inner = path if hit >= 0 else owner
            near, base = (node, ()) if hit >= 0 else (home, steps)
            if not with_rel or (base is not None and len(base) >= REACH):
                base = None
            start = f"{path}/" if path else ""
            kids = []
            if k == "object":
                for i, (key, child) in enumerate(value.items()):
                    nxt, met = matcher.move(state, key, jsontext.kind(child))
                    kids.append((child, node, key, i, nxt, start + key, inner, met, near, None if base is None else (*base, step_name(key))))
            else:
                for i, child in enumerate(value):
                    nxt, met = matcher.move(state, None, jsontext.kind(child))
                    kids.append((child, node, None, i, nxt, f"{start}{i}", inner, met, near, None if base is None else (*base, "#")))
            todo.extend(reversed(kids))
        node += 1


_NODE = [
    ("node", pa.int64(), T.LongType()),
    ("parent", pa.int64(), T.LongType()),
    ("label", pa.string(), T.StringType()),
    ("ordinal", pa.int64(), T.LongType()),
    ("kind", pa.string(), T.StringType()),
    ("scalar", pa.string(), T.StringType()),
    ("entity", pa.string(), T.StringType()),
    ("path", pa.string(), T.StringType()),
    ("owner", pa.string(), T.StringType()),
    ("content", pa.string(), T.StringType()),
    ("home", pa.int64(), T.LongType()),
    ("rel", pa.string(), T.StringType()),
]


def shred(df: DataFrame, key: str, text: str, rules: tuple[Entity, ...], *, columns: Sequence[str] | None = None) -> DataFrame:
    """Adjacency table of the JSON texts in ``text``, a row for every value: (key, doc, node, parent, label, ordinal, kind,
    scalar, entity, path, owner, content, home, rel).

    ``doc`` tells texts that differ under one key apart. Repeated (key, text) rows count once; null
    texts and texts that are not valid JSON give no rows; any depth is read. Number scalars keep their
    spelling, null and containers have a null scalar. ``path`` joins keys and positions by ``/``, ``owner``
    is that of the nearest enclosing entity; entities have them.
    ``content`` is the compact JSON of an entity that is an object or array, with null in the place of
    each entity inside, which has a row of its own. ``home`` is the node of the nearest enclosing entity
    and ``rel`` the path from there (``step_name`` of keys, ``#`` for array elements), null for entities
    and beyond ``REACH`` steps. ``columns`` limits what is made (key and doc are
    always there). Other columns of ``df`` are ignored.
    """
    # One exchange, by digest: repeated texts meet and are dropped, and parsing gets its tasks.
    docs = df.where(F.col(text).isNotNull()).select(F.col(key).alias("__key"), F.col(text).alias("__text"), F.sha2(F.col(text), 256).alias("__doc"))
    docs = docs.repartition(task_count(df.sparkSession), "__key", "__doc").distinct()
    key_type = df.schema[key].dataType
    made = [(i, *c) for i, c in enumerate(_NODE) if columns is None or c[0] in columns]
    names = {n for _, n, _, _ in made}
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _Matcher(rules)
        for batch in batches:
            keys, docs_, rows, at = batch.column("__key"), batch.column("__doc"), [], []
            for i, text_ in enumerate(batch.column("__text")):
                try:
                    root = jsontext.read(text_.as_py())
                except ValueError:
                    continue
                for row in _walk(root, matcher, names):
                    rows.append(row)
                    at.append(i)
                    if len(rows) >= _FLUSH_ROWS:
                        yield pack(keys, docs_, rows, at)
                        rows, at = [], []
            if rows:
                yield pack(keys, docs_, rows, at)

    def pack(keys, docs_, rows, at) -> pa.RecordBatch:
        take = pa.array(at, pa.int64())
        return pa.RecordBatch.from_arrays(
            [keys.take(take), docs_.take(take), *(pa.array([r[i] for r in rows], t) for i, _, t, _ in made)],
            names=[key, "doc", *(n for _, n, _, _ in made)],
        )

    schema = T.StructType([T.StructField(key, key_type), T.StructField("doc", T.StringType()), *(T.StructField(n, s) for _, n, _, s in made)])
    return docs.select("__key", "__doc", "__text").mapInArrow(run, schema)


def parent_links(nodes: DataFrame, key: str) -> DataFrame:
    """(key, entity, node_path, parent_path) of every entity, by joining it to the entity it lies in.

    The link is the adjacency table's ``home``; an entity in no other has an empty ``parent_path``. Null
    keys are joined too. Each entity stands once at its own number and once at its parent's, so that the
    node table is made once and exchanged once; what meets at a number is a node and its children.
    """
    place = lambda at, own: F.struct(at.alias("__at"), F.lit(own).alias("__own"))
    both = F.array_compact(F.array(place(F.col("node"), True), F.when(F.col("home").isNotNull(), place(F.col("home"), False))))
    rows = nodes.where(F.col("entity").isNotNull()).select(key, "doc", "home", "entity", F.col("path").alias("node_path"), F.inline(both))
    above = F.max(F.when(F.col("__own"), F.col("node_path"))).over(Window.partitionBy(key, "doc", "__at"))
    linked = rows.withColumn("__above", above).where(~F.col("__own") | F.col("home").isNull())
    return linked.select(key, "entity", "node_path", F.when(F.col("__own"), "").otherwise(F.col("__above")).alias("parent_path"))


def entity_table(nodes: DataFrame, key: str, entity: str, fields: dict[str, str]) -> DataFrame:
    """One row for each node of ``entity``: key, path, parent's path, kind, own scalar, the given fields, and its whole content.

    ``fields`` maps a path below the entity (see ``rel`` of :func:`shred`) to the column's Spark type;
    ``/`` becomes ``_`` in the column's name. A path that ends with ``/#`` gives an array of the elements
    in order. A value of another type than asked for gives null, as does a missing one; what no column
    holds is in ``content``. The entities and the nodes of the fields meet in one exchange on (key, doc,
    node), where paths are pivoted; no other column of the node table travels.
    """
    if far := [f for f in fields if f.count("/") >= REACH]:
        raise ValueError(f"more than {REACH} steps: {far}")
    lists = {f.removesuffix("/#") for f in fields if f.endswith("/#")}
    self_type = "struct<path:string,owner:string,kind:string,scalar:string,label:string,ordinal:bigint,content:string>"
    no_text = F.lit(None).cast("string")
    own = F.when(
        F.col("entity") == entity,
        F.struct(F.col("node").alias("id"), no_text.alias("rel"), F.struct("path", "owner", "kind", "scalar", "label", "ordinal", "content").alias("self"), no_text.alias("kind"), F.col("ordinal").alias("at"), no_text.alias("value")),
    )
    below = F.when(
        F.col("rel").isin(*fields, *lists),
        F.struct(F.col("home").alias("id"), F.col("rel"), F.lit(None).cast(self_type).alias("self"), F.col("kind"), F.col("ordinal").alias("at"), F.col("scalar").alias("value")),
    )

    def column(f: str, t: str) -> Column:
        name = f"f_{f}"
        if not f.endswith("/#"):
            return F.max(F.when(F.col("rel") == f, F.col("value"))).try_cast(t).alias(name)
        there = F.max((F.col("rel") == f.removesuffix("/#")) & (F.col("kind") == "array"))
        elements = F.array_sort(F.collect_list(F.when(F.col("rel") == f, F.struct("at", "value"))))
        return F.when(there, F.transform(elements, lambda x: x["value"].try_cast(t))).alias(name)

    roles = nodes.select(key, "doc", F.inline(F.array_compact(F.array(own, below))))
    grouped = roles.groupBy(key, "doc", "id").agg(F.max("self").alias("self"), *[column(f, t) for f, t in fields.items()])
    return grouped.where(F.col("self").isNotNull()).select(
        key,
        F.col("self.path").alias("node_path"),
        F.col("self.owner").alias("parent_path"),
        F.col("self.label").alias("node_key"),
        F.col("self.ordinal").alias("position"),
        F.col("self.kind").alias("kind"),
        F.col("self.scalar").alias("scalar"),
        *[F.col(f"`f_{f}`").alias(f.removesuffix("/#").replace("/", "_")) for f in fields],
        F.col("self.content").alias("content"),
    ).distinct()
