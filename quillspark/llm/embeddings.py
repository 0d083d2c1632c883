"""Near-duplicate vectors by random hyperplanes.

The signs of a vector against ``bits`` random hyperplanes are its bucket in one table; several tables make
a miss unlikely. Vectors that share a bucket are compared by exact cosine, in double precision. Equal
vectors are one class first, with a count, so copies cost nothing. A pair that shares buckets in several
tables counts in the first of them only, which both sides' keys tell, so counts need no list of pairs.

A bucket of any size is cut into blocks of ``BLOCK`` rows; each pair of blocks is one task's small matrix
product. A task returns counts and, for connectivity, a spanning forest of its links: rows in proportion
to the block and not to its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import Scratch, partitions, table
from quillspark.llm.components import components

BLOCK = 512
#: A linked pair is missed with at most this chance.
MISS = 1e-5
#: Up to so many buckets of more than one block are broadcast.
BROADCAST_BUCKETS = 200_000


def plan(rows: int, cosine: float) -> tuple[int, int]:
    """Bits of a table's key, which follow the number of rows, and the number of tables that the bound on misses needs."""
    bits = min(31, max(6, int(math.log2(max(2, rows))) - 4))
    hit = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(MISS) / math.log(1 - hit))


def _valid(vector: str) -> str:
    return f"{vector} is not null and size({vector}) > 0 and forall({vector}, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists({vector}, x -> x != 0)"


def _hash(bits: int, tables: int, kind: type):
    """Per vector: class (hash of its exact components), the keys of all tables, and the components as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            ids, vectors = batch.column("vec_id"), batch.column("v").to_pylist()
            by_size: dict[int, list[int]] = {}
            for i, v in enumerate(vectors):
                by_size.setdefault(len(v), []).append(i)
            node, keys, raw = [0] * len(vectors), [b""] * len(vectors), [b""] * len(vectors)
            for size, at in by_size.items():
                if size not in planes:
                    planes[size] = np.random.default_rng(size).standard_normal((size, bits * tables))
                x = np.array([vectors[i] for i in at], np.float64) + 0.0
                x /= np.abs(x).max(axis=1, keepdims=True)
                signs = (x @ planes[size] >= 0).reshape(len(at), tables, bits)
                key = (signs @ (1 << np.arange(bits))).astype(np.uint32)
                exact = np.array([vectors[i] for i in at], kind) + kind(0)
                for k, i in enumerate(at):
                    keys[i], raw[i] = key[k].tobytes(), exact[k].tobytes()
                    node[i] = xxhash.xxh3_64_intdigest(raw[i]) - (1 << 63)
            yield pa.RecordBatch.from_arrays([ids, pa.array(node, pa.int64()), pa.array(keys, pa.binary()), pa.array(raw, pa.binary())], names=["vec_id", "node", "keys", "raw"])

    return run


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> list[int]:
    """Numbers of the links that join two groups, taken in order: a spanning forest."""
    up = list(range(n))

    def root(a: int) -> int:
        while up[a] != a:
            up[a] = up[up[a]]
            a = up[a]
        return a

    keep = []
    for k, (a, b) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
            keep.append(k)
    return keep


LINKS = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("links", pa.int64())])


def _block(t: int, a: int, b: int, node: np.ndarray, copies: np.ndarray, block: np.ndarray, key: np.ndarray, x: np.ndarray, cosine: float):
    """Of two blocks of a bucket of table t: (node, node, links found) and (node, node, 0) for a forest of the links."""
    left, right = np.flatnonzero(block == a), np.flatnonzero(block == b)
    i, j = np.nonzero(x[left] @ x[right].T >= cosine)
    i, j = left[i], right[j]
    if a == b:
        i, j = i[i < j], j[i < j]
    if t and len(i):
        first = ~(key[i, :t] == key[j, :t]).any(axis=1)
        i, j = i[first], j[first]
    if not len(i):
        return
    links = np.bincount(i, copies[j], len(node)) + np.bincount(j, copies[i], len(node))
    some = np.flatnonzero(links)
    yield node[some], node[some], links[some].astype(np.int64)
    keep = _forest(i, j, len(node))
    yield node[i[keep]], node[j[keep]], np.zeros(len(keep), np.int64)


def _compare(cosine: float, kind: type):
    """Rows come sorted by (t, key, x, y); a run of equal ones is at most two blocks. Batches hold many runs."""

    def runs(held: pa.Table, whole: bool) -> tuple[int, list[tuple[int, int]]]:
        mark = np.stack([held.column(c).to_numpy() for c in ("t", "bucket", "x", "y")])
        cut = np.flatnonzero(np.concatenate([[True], (mark[:, 1:] != mark[:, :-1]).any(axis=0)]))
        ends = np.append(cut[1:], held.num_rows)
        pairs = list(zip(cut.tolist(), ends.tolist(), strict=True))
        return (held.num_rows, pairs) if whole else (pairs[-1][0], pairs[:-1])

    def work(held: pa.Table, pairs: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
        t, a, b, node, copies, block = (held.column(c).to_numpy() for c in ("t", "x", "y", "node", "copies", "block"))
        raw, keys = held.column("raw").to_pylist(), held.column("keys").to_pylist()
        width = len(keys[0]) // 4 if keys else 0
        key = np.frombuffer(b"".join(keys), np.uint32).reshape(-1, width)
        out = []
        sizes = np.array([len(r) for r in raw])
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            x = np.frombuffer(b"".join(raw[i] for i in at), kind).reshape(len(at), -1).astype(np.float64)
            x = x / np.abs(x).max(axis=1, keepdims=True)
            x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
            own = np.searchsorted(at, np.array(pairs).reshape(-1, 2))
            for lo, hi in own.tolist():
                if hi - lo > 1:
                    r = at[lo:hi]
                    out += _block(int(t[r[0]]), int(a[r[0]]), int(b[r[0]]), node[r], copies[r], block[r], key[r], x[lo:hi], cosine)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], schema=LINKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            rows = pa.Table.from_batches(held)
            if rows.num_rows >= 4 * BLOCK:
                done, pairs = runs(rows, False)
                yield from work(rows.slice(0, done), pairs)
                held = rows.slice(done).to_batches()
        if held:
            rows = pa.Table.from_batches(held)
            if rows.num_rows:
                yield from work(rows, runs(rows, True)[1])

    return run


def near_vectors(vectors: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row for each row: ``vec_id, n_links, component_id, kept``.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, and vectors
    of different lengths never link. Repeated rows are vectors of their own. A row without an id links like
    any other, but gives no component its id. An empty table gives no rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    plain = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    kind = np.float32 if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else np.float64
    bits, tables = plan(plain.count(), cosine)
    hashed = plain.where(_valid("v")).mapInArrow(_hash(bits, tables, kind), "vec_id long, node long, keys binary, raw binary")
    hashed = scratch.save(hashed, "hashed")
    classes = hashed.groupBy("node").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    one = hashed.select("node", "keys", "raw").dropDuplicates(["node"]).join(classes, "node")
    one = scratch.save(one, "classes")

    key = F.expr("substring(keys, t * 4 + 1, 4)")
    rows = one.select("node", "copies", "keys", "raw", F.explode(F.sequence(F.lit(0), F.lit(tables - 1))).alias("t")).withColumn("key", key)
    big = rows.select("t", "key").groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK)
    big = scratch.save(big, "big")
    rows = rows.join(F.broadcast(big) if big.count() <= BROADCAST_BUCKETS else big, ["t", "key"], "left")
    rows = rows.withColumn("blocks", F.ceil(F.coalesce("n", F.lit(1)) / BLOCK).cast("int")).withColumn("block", F.expr("cast(pmod(xxhash64(node), blocks) as int)"))
    # A row of block b goes to the tasks of (min(b, o), max(b, o)) for every block o of its bucket.
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    rows = rows.withColumn("x", F.least("block", "other")).withColumn("y", F.greatest("block", "other"))
    rows = rows.select("t", F.conv(F.hex("key"), 16, 10).cast("long").alias("bucket"), "x", "y", "block", "node", "copies", "keys", "raw")
    order = ("t", "bucket", "x", "y")
    rows = rows.repartition(partitions(spark), *order).sortWithinPartitions(*order)
    found = rows.mapInArrow(_compare(cosine, kind), "u long, v long, links long")
    found = scratch.save(found, "found")

    labels = components(found.where("u != v"), scratch)
    counts = found.where("u = v").groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links"))
    member = one.select("node", "rep", "copies").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    lowest = member.groupBy("label").agg(F.min("rep").alias("component_id"))
    member = member.join(lowest, "label").join(counts, "node", "left")
    member = member.select("node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    rows = hashed.select("vec_id", "node").join(member, "node").select("vec_id", "n_links", "component_id")
    rest = plain.where(f"not coalesce({_valid('v')}, false)").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return rows.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op3_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), 0.95)
