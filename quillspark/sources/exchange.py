"""What a store knows about a document as one JSON text, and back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.sources.store import TABLES

#: What is told together, and the tables that hold it. Nodes of a tree are a flat list in preorder; each names its parent.
KINDS = {"schema": ("categories", "patterns", "candidates"), "graph": ("nodes", "edges"), "tree": ("tree",)}


def _columns(name: str) -> list[str]:
    """The columns of a table but doc_id, with their types."""
    return TABLES[name].split(", ")[1:]


def dump(tables: dict[str, DataFrame], kind: str) -> DataFrame:
    """``doc_id, json`` of every document that has rows of a kind; a table without rows is an empty list. A document's rows meet in one row, as its text does."""

    def listed(name: str) -> DataFrame:
        one = F.struct(*[c.split(" ")[0] for c in _columns(name)])
        return tables[name].groupBy("doc_id").agg(F.sort_array(F.collect_list(one)).alias(name))

    rows = reduce(lambda a, b: a.join(b, "doc_id", "full"), [listed(name) for name in KINDS[kind]])
    empty = lambda name: F.coalesce(name, F.array().cast(rows.schema[name].dataType)).alias(name)
    return rows.select("doc_id", F.to_json(F.struct(*[empty(name) for name in KINDS[kind]]), {"ignoreNullFields": "false"}).alias("json"))


def load(rows: DataFrame, kind: str) -> dict[str, DataFrame]:
    """The tables that dump told; a text that can't be read gives no rows."""
    form = ", ".join(f"{name} array<struct<{', '.join(c.replace(' ', ': ', 1) for c in _columns(name))}>>" for name in KINDS[kind])
    read: Column = F.from_json("json", form)
    return {name: rows.select("doc_id", F.inline(read[name])) for name in KINDS[kind]}
