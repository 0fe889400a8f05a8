"""Deeply nested records into related flat tables (problem 5).

Every object and array is canonicalised and hashed bottom-up, so equal subtrees have equal
identities. The store keeps each distinct subtree once:

``nodes``        ``node, kind``: one row per distinct object or array;
``edges``        ``node, key, ord, child, leaf_type, leaf``: the members of a node. ``child`` is the
                 identity of a nested node, or null for a scalar, which stands in ``leaf``;
``occurrences``  the caller's id columns and ``part, node``: which record holds which root.

Child tables are read off by walking the edges from the distinct roots and joining the result back
to the occurrences, so that a subtree shared by millions of records is flattened once.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lucidra.util import cut, skew_join

#: Identities remembered per task to drop repeats before the shuffle; past this the memory starts anew.
SEEN = 200_000


@dataclass(frozen=True)
class Store:
    """The three tables of a shredded column."""

    nodes: DataFrame
    edges: DataFrame
    occurrences: DataFrame
    id_cols: tuple[str, ...]


def _scalar(v: object) -> tuple[str, str | None]:
    if v is None:
        return "null", None
    if isinstance(v, bool):
        return "bool", "true" if v else "false"
    if isinstance(v, (int, float)):
        return "number", json.dumps(v)
    return "string", str(v)


class _Shredder:
    """Turns parsed JSON into node and edge rows; returns the identity of the root."""

    def __init__(self, embedded: frozenset[str]) -> None:
        self.embedded, self.seen = embedded, set()
        self.rows: list[tuple] = []

    def node(self, v: object) -> str:
        items = sorted(v.items()) if isinstance(v, dict) else [("", x) for x in v]
        kind = "object" if isinstance(v, dict) else "array"
        edges, digest = [], hashlib.blake2b(kind.encode(), digest_size=16)
        for i, (key, x) in enumerate(items, 1):
            if isinstance(x, str) and key in self.embedded and x.lstrip()[:1] in ("{", "["):
                try:
                    x = json.loads(x)
                except ValueError:
                    pass
            child, (t, leaf) = (self.node(x), ("node", None)) if isinstance(x, (dict, list)) else (None, _scalar(x))
            edges.append((key, i, child, t, leaf))
            digest.update(json.dumps([key, child, t, leaf]).encode())
        me = digest.hexdigest()
        if me not in self.seen:
            if len(self.seen) >= SEEN:
                self.seen.clear()
            self.seen.add(me)
            self.rows.append((me, kind, None, None, None, None, None))
            self.rows.extend((me, None, *e) for e in edges)
        return me


def shred(df: DataFrame, id_cols: list[str], part: str, text: str, embedded: tuple[str, ...] = ()) -> Store:
    """Shred the JSON texts of column ``text``; ``part`` names the column that tells several texts of a record apart.

    Text that is null, does not parse or is no object or array has no occurrence. Strings under a key in
    ``embedded`` that hold JSON themselves are opened. Repeated keys of an object: the last one counts.
    Arrays keep their order; ``ord`` counts from 1 (object members: in the order of their keys).
    Too deeply nested text (beyond Python's recursion limit) counts as not parsing.
    """
    ids = df.select(*id_cols, part).schema.simpleString()[len("struct<") : -1].replace(":", " ")
    names = [*id_cols, part]
    keys = frozenset(embedded)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = _Shredder(keys)
        for pdf in batches:
            found = []
            for t in pdf[text]:
                before = len(s.rows)
                try:
                    v = json.loads(t) if isinstance(t, str) else None
                    found.append(s.node(v) if isinstance(v, (dict, list)) else None)
                except (ValueError, RecursionError):
                    del s.rows[before:]
                    s.seen.clear()
                    found.append(None)
            occ = pdf[names].assign(node=found)
            occ = occ[occ["node"].notna()]
            yield occ.assign(kind="occurrence", key=None, ord=None, child=None, leaf_type=None, leaf=None).reset_index(drop=True)
            rows = pd.DataFrame(s.rows, columns=["node", "kind", "key", "ord", "child", "leaf_type", "leaf"])
            s.rows = []
            for c in names:
                rows[c] = None
            yield rows

    schema = f"{ids}, node string, kind string, key string, ord long, child string, leaf_type string, leaf string"
    raw = cut(df.select(*names, text).mapInPandas(work, schema))
    edges = raw.where("kind is null").select("node", "key", "ord", "child", "leaf_type", "leaf").dropDuplicates(["node", "ord"])
    nodes = raw.where("kind in ('object', 'array')").select("node", "kind").distinct()
    return Store(nodes, cut(edges), raw.where("kind = 'occurrence'").select(*names, "node"), tuple(id_cols))


def step(front: DataFrame, edges: DataFrame, at: str, key: str | None, to: str, how: str = "inner") -> DataFrame:
    """Follow the edges called ``key`` (any, if None) from column ``at``.

    Adds ``{to}`` (the child node), ``{to}_key``, ``{to}_ord``, ``{to}_type`` and ``{to}_leaf``.
    """
    e = edges if key is None else edges.where(F.col("key") == key)
    e = e.select(
        F.col("node").alias(at),
        F.col("child").alias(to),
        F.col("key").alias(f"{to}_key"),
        F.col("ord").alias(f"{to}_ord"),
        F.col("leaf_type").alias(f"{to}_type"),
        F.col("leaf").alias(f"{to}_leaf"),
    )
    return front.join(e, at, how)


def members(front: DataFrame, store: Store, at: str, to: str) -> DataFrame:
    """The items of column ``at``, whether it is an array of items or one bare item (which then has ordinal 1)."""
    kinds = store.nodes.select(F.col("node").alias(at), F.col("kind").alias("_kind"))
    typed = front.join(kinds, at)
    many = step(typed.where("_kind = 'array'").drop("_kind"), store.edges, at, None, to)
    one = typed.where("_kind = 'object'").drop("_kind")
    one = one.select(
        "*", F.col(at).alias(to), F.lit("").alias(f"{to}_key"), F.lit(1).cast("long").alias(f"{to}_ord"), F.lit("node").alias(f"{to}_type"), F.lit(None).cast("string").alias(f"{to}_leaf")
    )
    return many.unionByName(one)


def roots(store: Store, part_value: str, part: str = "part") -> DataFrame:
    """The distinct roots of one part."""
    return store.occurrences.where(F.col(part) == part_value).select(F.col("node").alias("root")).distinct()


def attach(children: DataFrame, store: Store, part_value: str, columns: list[str], part: str = "part") -> DataFrame:
    """Give the children of each distinct root to every record that holds it; hot roots do not move their records."""
    per_root = children.groupBy("root").agg(F.collect_list(F.struct(*columns)).alias("_children"))
    held = store.occurrences.where(F.col(part) == part_value).select(*store.id_cols, F.col("node").alias("root"))
    return skew_join(held, per_root, "root").select(*store.id_cols, F.inline("_children"))


def slug(c: Column) -> Column:
    """Lower case with underscores."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s-]+", "_")
