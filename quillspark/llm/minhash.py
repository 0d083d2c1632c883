"""Near-duplicate documents by a MinHash LSH forest.

A document is the set of its distinct word shingles. Equal sets are one class, found by a 128-bit
fingerprint. Each class has a MinHash signature; ``TREES`` sorted orders use different runs of it. In a
sorted order the rows with the longest common prefix stand together, so a row's candidates are its
neighbours: in a thin region a short common prefix is enough to be among the nearest, in a dense region
only those with a longer one are near. The depth thus follows the region by itself.

Candidates come in two passes. The first takes, in each order, the nearest neighbour whose
sketch agrees; chosen pairs are confirmed on the full sets and merged. The second takes only documents
that had a candidate, and looks up to ``REACH`` rows away for neighbours of another component. It notes (document, component) and not pairs: the document is then held
against every member of the component, in blocks, by an index of the block's shingles. A large group of copies is
one component after the first pass, so only its outliers are left, and they miss no member.

No row distance ends the search. The rows of an order that share their first ``RUN_DEPTH`` values are a run. A
run of at most REACH + 1 rows lies within reach; longer ones are held whole in a third step: the rows outside a run's largest
component meet all its rows of other components in pairs of blocks, on the full sets. No range partition splits a run.

The sketch (128 values of 4 bits) only skips pairs five standard deviations below the threshold. For a
pair at similarity 0.8 the chance that no order puts it into one run is (1 - 0.8^4)^20, about 3e-5, in regions
of any density.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import Scratch, bounded_batches, join_unique, mix, pair_hash, partitions, slices, table
from quillspark.llm.components import components
from quillspark.llm.wordhash import column_hashes

TREES, STEP, DEPTH = 20, 6, 8
PERMUTATIONS = 128
#: Neighbours up to this many rows away with MIN_DEPTH equal values are candidates.
REACH, MIN_DEPTH = 32, 3
BLOCK = 200_000
#: Equal first values that make a run, and the rows of a block of a long run.
RUN_DEPTH, RUN_ROWS = 4, 1024
#: Components of up to SMALL members are met as pairs, larger ones in blocks of MEMBERS members and PROBES documents.
SMALL, MEMBERS, PROBES = 8, 256, 1024
#: Up to so many ids (8 bytes each) are broadcast to pick texts; more are joined.
BROADCAST_IDS = 4_000_000

_A = np.random.default_rng(20240501).integers(0, 1 << 32, PERMUTATIONS, np.uint64).astype(np.uint32) | np.uint32(1)
_X = np.random.default_rng(7).integers(0, 1 << 32, PERMUTATIONS, np.uint64).astype(np.uint32)


def shingles(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text; with fewer words than ``width``, one for the whole sequence."""
    flat, n = column_hashes(texts)
    at = np.concatenate([[0], np.cumsum(n)])
    run = flat
    for k in range(1, width):
        run = pair_hash(run[:-1], flat[k:]) if len(run) > 1 else run[:0]
    for i, size in enumerate(n):
        if size >= width:
            yield np.unique(run[at[i] : at[i + 1] - width + 1])
        elif size:
            short = mix(flat[at[i] : at[i] + 1] + np.uint64(size))
            for k in range(1, size):
                short = pair_hash(short, flat[at[i] + k : at[i] + k + 1])
            yield short
        else:
            yield flat[:0]


def signature(values: np.ndarray) -> np.ndarray:
    """The least value of every permutation over a set of shingle hashes."""
    small = (values >> np.uint64(32)).astype(np.uint32)
    least = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(small), 4096):
        least = np.minimum(least, ((small[k : k + 4096, None] ^ _X) * _A).min(axis=0))
    return least


def _node(values: np.ndarray) -> int:
    return int.from_bytes(xxhash.xxh3_64_digest(values.tobytes()), "big", signed=True)


SIGNED = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.int64()), ("keys", pa.binary()), ("sketch", pa.binary())])


def _sign(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                rows: list[tuple] = []
                for doc, text, values in zip(batch.column("doc_id").to_pylist(), batch.column("text_hash").to_pylist(), shingles(batch.column("text"), width), strict=True):
                    if not len(values):
                        rows.append((doc, text, 0, None, None, None))
                        continue
                    low = signature(values)
                    low ^= low >> np.uint32(15)
                    key = np.stack([low[t * STEP : t * STEP + DEPTH] for t in range(TREES)]).astype(">u2")
                    nibble = (low & np.uint32(15)).astype(np.uint8)
                    rows.append((doc, text, len(values), _node(values), key.tobytes(), (nibble[::2] << 4 | nibble[1::2]).tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), SIGNED, strict=True)], schema=SIGNED)

    return run


#: For a byte, how many of its two halves are zero.
_ZEROS = np.array([(b < 16) + (b % 16 == 0) for b in range(256)], np.uint8)


def _least(similarity: float) -> int:
    """Equal sketch values below which a pair is skipped."""
    share = similarity + (1 - similarity) / 16
    return int(PERMUTATIONS * share - 5 * np.sqrt(PERMUTATIONS * share * (1 - share)))


def _neighbours(similarity: float, cross: bool):
    """Candidates of the sorted orders: pairs of nodes, nearest first, as long as one of the two is in no pair yet.

    cross: a node and the label of another component that it is near to, with the larger component as the label.
    """
    least = _least(similarity)
    out = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("m", pa.int32())])

    def pairs(key, node, n, sketch, label, weight) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        rows = len(node)
        same = np.cumprod(key[1:] == key[:-1], axis=1).sum(axis=1)
        left = np.arange(rows - 1)
        depth = same.copy()
        met = np.zeros(rows, bool)
        offset = 1
        while offset <= REACH:
            keep = depth >= MIN_DEPTH
            left, depth = left[keep], depth[keep]
            if not len(left):
                break
            i, j = left, left + offset
            ok = (np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j])) & (node[i] != node[j])
            ok &= (label[i] != label[j]) if cross else ~(met[i] & met[j])
            i, j = i[ok], j[ok]
            for k in range(0, len(i), 65536):
                p, q = i[k : k + 65536], j[k : k + 65536]
                m = _ZEROS[sketch[p] ^ sketch[q]].sum(axis=1, dtype=np.int32)
                good = m >= least
                p, q, m = p[good], q[good], m[good]
                if not cross:
                    met[p] = met[q] = True
                    yield np.minimum(node[p], node[q]), np.maximum(node[p], node[q]), m
                else:
                    back = (weight[p] > weight[q]) | (weight[p] == weight[q]) & (label[p] < label[q])
                    yield np.where(back, node[q], node[p]), np.where(back, label[p], label[q]), m
            offset += 1
            far = left + offset < rows
            left, depth = left[far], depth[far]
            depth = np.minimum(depth, same[left + offset - 1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def emit(tree: pa.Table) -> Iterator[pa.RecordBatch]:
            if tree.num_rows < 2:
                return
            flat = lambda c, kind, w: np.frombuffer(b"".join(tree.column(c).to_pylist()), kind).reshape(-1, w)
            cols = [tree.column(c).to_numpy() for c in ("node", "n_shingles", "label", "weight")]
            found = [x for x in pairs(flat("key", ">u2", DEPTH), cols[0], cols[1], flat("sketch", np.uint8, PERMUTATIONS // 2), cols[2], cols[3]) if len(x[0])]
            if found:
                a, b, m = (np.concatenate(x) for x in zip(*found, strict=True))
                order = np.lexsort((-m, b, a))
                a, b, m = a[order], b[order], m[order]
                new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
                a, b, m = a[new], b[new], m[new]
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(m)], schema=out)

        # Blocks are bounded, whatever a partition holds, and overlap by REACH rows.
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= BLOCK:
                block = pa.Table.from_batches(held)
                yield from _by_tree(block, emit)
                held = block.slice(size - REACH).to_batches()
                size = REACH
        if held:
            yield from _by_tree(pa.Table.from_batches(held), emit)

    return run


def _by_tree(block: pa.Table, emit) -> Iterator[pa.RecordBatch]:
    tree = block.column("tree").to_numpy()
    for t in np.unique(tree):
        lo, hi = np.searchsorted(tree, [t, t + 1])
        yield from emit(block.slice(lo, hi - lo))


def _forest(signed: DataFrame, similarity: float, cross: bool) -> DataFrame:
    """signed: one row for each node, with ``label, weight``. Candidates a, b, each once, with the number of equal sketch values."""
    rows = signed.select("node", "n_shingles", "sketch", "label", "weight", "keys", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    rows = rows.select("tree", F.expr(f"substring(keys, tree * {2 * DEPTH} + 1, {2 * DEPTH})").alias("key"), "node", "n_shingles", "sketch", "label", "weight")
    rows = rows.repartitionByRange(partitions(signed.sparkSession), "tree", F.expr(f"substring(key, 1, {2 * RUN_DEPTH})")).sortWithinPartitions("tree", "key", "node")
    return rows.mapInArrow(_neighbours(similarity, cross), "a long, b long, m int").groupBy("a", "b").agg(F.max("m").alias("m"))


def _sets(width: int):
    out = pa.schema([("node", pa.int64()), ("values", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                got = list(shingles(batch.column("text"), width))
                yield pa.RecordBatch.from_arrays([pa.array([_node(x) if len(x) else None for x in got], pa.int64()), pa.array([x.tobytes() for x in got], pa.binary())], schema=out)

    return run


def _confirm(percent: int):
    out = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs, held, last = [], [], None, None
            for a, b, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "x", "y")), strict=True):
                if a != last:
                    last, held = a, np.frombuffer(x, np.uint64)
                other = np.frombuffer(y, np.uint64)
                both = np.concatenate([held, other])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                if 100 * shared >= percent * (len(both) - shared):
                    us.append(a)
                    vs.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], schema=out)

    return run


def _meet(percent: int):
    def run(probes: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        links: list[tuple[int, int]] = []
        if len(probes) and len(members):
            held = [np.frombuffer(x, np.uint64) for x in members["values"]]
            size, node = np.array([len(x) for x in held]), members["node"].to_numpy()
            values = np.concatenate(held)
            order = np.argsort(values, kind="stable")
            values, owner = values[order], np.repeat(np.arange(len(held)), size)[order]
            for x, raw in zip(probes["x"], probes["values"], strict=True):
                own = np.frombuffer(raw, np.uint64)
                low, high = np.searchsorted(values, own, "left"), np.searchsorted(values, own, "right")
                span = high - low
                at = np.repeat(low - np.concatenate([[0], np.cumsum(span)[:-1]]), span) + np.arange(span.sum())
                shared = np.bincount(owner[at], minlength=len(held))
                linked = np.flatnonzero(100 * shared >= percent * (size + len(own) - shared))
                if len(linked):  # the members are one component already: one link tells all
                    links.append((x, node[linked[0]]))
        return pd.DataFrame(links, columns=["u", "v"]).astype("int64")

    return run


def _runs():
    """For all orders, the hash of the order and a row's first values there. Rows of equal hashes are a run."""
    return F.array(*[F.expr(f"xxhash64({t}, substring(keys, {2 * DEPTH * t + 1}, {2 * RUN_DEPTH}))") for t in range(TREES)])


def _within(percent: int):
    """Links in a pair of blocks of a run, between rows of different components that share no run of an earlier order."""
    least = _least(percent / 100)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        node, n, label, block = (group[c].to_numpy() for c in ("node", "n_shingles", "label", "block"))
        low, high, tree = int(group["low"].iat[0]), int(group["high"].iat[0]), int(group["tree"].iat[0])
        sketch = np.frombuffer(b"".join(group["sketch"]), np.uint8).reshape(len(group), -1)
        before = np.array([r[:tree] for r in group["runs"]], np.int64).reshape(len(group), tree)
        held = [np.frombuffer(x, np.uint64) for x in group["values"]]
        left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
        values = np.concatenate([held[k] for k in right]) if len(right) else np.zeros(0, np.uint64)
        order = np.argsort(values, kind="stable")
        values, owner = values[order], np.repeat(right, n[right])[order]
        links: list[tuple[int, int]] = []
        for x in left:
            other = right[right > x] if low == high else right
            other = other[(label[other] != label[x]) & (100 * np.minimum(n[other], n[x]) >= percent * np.maximum(n[other], n[x]))]
            other = other[_ZEROS[sketch[other] ^ sketch[x]].sum(axis=1, dtype=np.int32) >= least]
            other = other[~(before[other] == before[x]).any(axis=1)]
            if not len(other):
                continue
            start, end = np.searchsorted(values, held[x], "left"), np.searchsorted(values, held[x], "right")
            span = end - start
            at = np.repeat(start - np.concatenate([[0], np.cumsum(span)[:-1]]), span) + np.arange(span.sum())
            shared = np.bincount(owner[at], minlength=len(group))[other]
            links += [(node[x], node[y]) for y in other[100 * shared >= percent * (n[other] + n[x] - shared)]]
        return pd.DataFrame(links, columns=["u", "v"]).astype("int64")

    return run


def _outliers(near: DataFrame, place: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links of documents ``x`` to members of the component ``label``, every member tried."""
    deal = near.groupBy("label").agg(F.max("weight").alias("weight"), F.count(F.lit(1)).alias("n"))
    deal = deal.select("label", F.ceil(F.col("weight") / MEMBERS).cast("int").alias("blocks"), F.ceil(F.col("n") / PROBES).cast("int").alias("salts"))
    spread = lambda c, n: F.expr(f"cast(pmod(xxhash64({c}), {n}) as int)")
    probes = join_unique(near.select("x", "label"), deal, "label").withColumn("salt", spread("x", "salts")).withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)")))
    probes = probes.join(sets.toDF("x", "values"), "x").select("label", "block", "salt", "x", "values")
    members = join_unique(place, deal, "label").withColumn("block", spread("node", "blocks")).withColumn("salt", F.explode(F.expr("sequence(0, salts - 1)")))
    members = members.join(sets.toDF("node", "mine"), "node").select("label", "block", "salt", "node", F.col("mine").alias("values"))
    key = ("label", "block", "salt")
    return probes.groupBy(*key).cogroup(members.groupBy(*key)).applyInPandas(_meet(percent), "u long, v long")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: ``doc_id, n_shingles, component_id, kept``.

    Two documents are linked if 100 * |intersection| >= percent * |union| of their shingle sets. Null and
    empty texts have no shingles and no link; each row is a document of its own, also where an id repeats;
    a row without an id is linked like any other, but gives no component its id: in a component without any id, component_id is
    null and all rows are kept. An empty table gives no rows. Other columns of docs are ignored, whatever their names.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = labelled(plain, width, percent)
    return rows.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def labelled(plain: DataFrame, width: int, percent: int) -> DataFrame:
    """plain: ``doc_id, text``. ``doc_id, text_hash, n_shingles, label, component_id``; rows of one component share a label, null without shingles."""
    spark, similarity = plain.sparkSession, percent / 100
    bounded_batches(spark)
    scratch = Scratch(spark, "minhash")
    hashed = plain.withColumn("text_hash", F.xxhash64("text"))
    signed = scratch.save(hashed.mapInArrow(_sign(width), "doc_id long, text_hash long, n_shingles long, node long, keys binary, sketch binary"), "signed")
    classes = signed.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    classes = scratch.save(classes, "classes")
    named = join_named(signed, classes).dropDuplicates(["node"])
    one = scratch.save(named.select("node", "n_shingles", "keys", "sketch").withColumns({"label": F.col("node"), "weight": F.lit(1).cast("long")}), "one")
    pairs = scratch.save(_forest(one, similarity, cross=False), "pairs")

    touched = scratch.save(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "touched")

    def gather(nodes: DataFrame) -> DataFrame:
        reps = nodes.join(classes, "node").select(F.col("rep").alias("doc_id")).distinct()
        ids = reps.where("doc_id is not null")
        texts = plain.join(F.broadcast(ids) if nodes.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi").select("text")
        if not reps.where("doc_id is null").isEmpty():
            texts = texts.union(plain.where("doc_id is null").select("text"))
        return texts.mapInArrow(_sets(width), "node long, values binary").join(nodes, "node", "left_semi").dropDuplicates(["node"])

    sets = scratch.save(gather(touched), "sets")

    def confirm(chosen: DataFrame) -> DataFrame:
        both = chosen.select("a", "b").join(sets.select(F.col("node").alias("b"), F.col("values").alias("y")), "b")
        both = both.join(sets.select(F.col("node").alias("a"), F.col("values").alias("x")), "a")
        return both.mapInArrow(_confirm(percent), "u long, v long")

    def crossing(some: DataFrame, labels: DataFrame) -> DataFrame:
        la, lb = (labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}")) for c in "ab")
        some = join_unique(join_unique(some, la, "a", "left"), lb, "b", "left")
        return some.withColumn("la", F.coalesce("la", "a")).withColumn("lb", F.coalesce("lb", "b")).where("la != lb")

    # First each document's best candidate and its candidate of least rank; a group of copies falls to few components.
    ends = pairs.select(F.col("a").alias("n"), "a", "b", "m", F.xxhash64("b").alias("h")).union(pairs.select(F.col("b"), "a", "b", "m", F.xxhash64("a")))
    best = ends.groupBy("n").agg(F.max(F.struct("m", "a", "b")).alias("x"), F.min(F.struct("h", "a", "b")).alias("y"))
    first = best.select(F.explode(F.array(*(F.struct(f"{c}.a", f"{c}.b") for c in "xy"))).alias("p")).select("p.*").distinct()
    tested = scratch.save(first, "first")
    links = scratch.save(confirm(tested), "links1")
    labels = components(links, scratch, "cc1")
    # Then the best pair between two components, then whatever still crosses.
    rest = scratch.save(crossing(pairs.join(tested, ["a", "b"], "left_anti"), labels), "rest")
    second = rest.groupBy(F.least("la", "lb"), F.greatest("la", "lb")).agg(F.max(F.struct("m", "a", "b")).alias("x")).select("x.a", "x.b")
    second = scratch.save(second, "second")
    links2 = scratch.save(confirm(second), "links2")
    labels = components(links.union(links2), scratch, "cc2")
    place = scratch.save(touched.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label")), "place")
    weight = scratch.save(place.groupBy("label").agg(F.count(F.lit(1)).alias("weight")), "weight")
    again = one.drop("label", "weight").join(join_unique(place, weight, "label"), "node")
    near = join_unique(_forest(again, similarity, cross=True).select(F.col("a").alias("x"), F.col("b").alias("label")), weight, "label")
    near = scratch.save(near, "near")
    few = near.where(F.col("weight") <= SMALL).join(place, "label").select(F.col("x").alias("a"), F.col("node").alias("b"))
    links3 = scratch.save(confirm(few).union(_outliers(near.where(F.col("weight") > SMALL), place, sets, percent)), "links3")
    links = links.union(links2).union(links3)
    labels = components(links, scratch, "cc3")
    # Last the runs longer than the reach, whole, where they hold more than one component.
    long = one.select(F.explode(_runs()).alias("run")).groupBy("run").count().where(F.col("count") > REACH + 1).select("run")
    long = scratch.save(long, "long")
    if not long.isEmpty():
        rows = join_unique(one.select("node", F.posexplode(_runs()).alias("tree", "run")), long.withColumn("_l", F.lit(1)), "run").drop("_l").join(labels, "node", "left")
        rows = scratch.save(rows.withColumn("label", F.coalesce("label", "node")), "inlong")
        mixed = rows.groupBy("run", "label").agg(F.count(F.lit(1)).alias("n"))
        mixed = mixed.groupBy("run").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("n")).where("top.n < n")
        size = lambda n: F.ceil(n / RUN_ROWS).cast("int")
        mixed = scratch.save(mixed.select("run", F.col("top.label").alias("top"), size(F.col("n") - F.col("top.n")).alias("p"), size(F.col("top.n")).alias("q")), "runs")
        rows = scratch.save(join_unique(rows, mixed, "run"), "mixed")
        fresh = scratch.save(rows.select("node").distinct().join(touched, "node", "left_anti"), "fresh")
        if not fresh.isEmpty():
            sets = sets.union(scratch.save(gather(fresh), "sets2"))
        # Blocks 0 to p - 1 hold the rows outside the largest component and meet each other and the q blocks of that component.
        rows = rows.withColumn("block", F.expr("cast(if(label = top, p + pmod(xxhash64(node), q), pmod(xxhash64(node), p)) as int)"))
        rows = rows.withColumn("other", F.explode(F.expr("sequence(0, if(label = top, p, p + q) - 1)")))
        rows = rows.select("node", "label", "tree", "run", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
        rows = rows.join(one.select("node", "n_shingles", "sketch", _runs().alias("runs")), "node").join(sets, "node")
        links4 = rows.groupBy("run", "low", "high").applyInPandas(_within(percent), "u long, v long")
        links4 = scratch.save(links4, "links4")
        if not links4.isEmpty():
            labels = components(links.union(links4), scratch, "cc4")

    member = classes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    member = scratch.save(member, "member")
    # Only classes of several rows or labels need a look-up; the others are their own component.
    lowest = scratch.save(member.groupBy("label").agg(F.min("rep").alias("component_id"), F.sum("copies").alias("n")).where("n > 1").drop("n"), "lowest")
    found = join_unique(member.select("node", "label"), lowest, "label")
    for name in ("pairs", "sets", "sets2", "rest", "one", "inlong", "mixed", "near"):
        scratch.drop(name)
    rows = signed.select("doc_id", "text_hash", "n_shingles", "node").join(found.withColumn("in", F.lit(True)), "node", "left")
    return rows.select("doc_id", "text_hash", "n_shingles", F.coalesce("label", "node").alias("label"), F.when(F.col("in"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def join_named(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows of signed that carry the id of their class; of classes without any id, all rows."""
    named = signed.join(classes.where("rep is not null").select(F.col("rep").alias("doc_id"), "node"), ["node", "doc_id"], "left_semi")
    return named.unionByName(signed.where("doc_id is null").join(classes.where("rep is null").select("node"), "node", "left_semi"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that are no copies: of each component one row, that of the smallest doc_id (a row without an id only if
    no other is there), and every row without words. All columns of docs are kept as they are.

    Rows count by their own text, so an id that repeats with different texts loses only those that are copies. Of rows that
    repeat both id and text any one stays. An empty table gives no rows.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = Scratch(docs.sparkSession, "keepone").save(labelled(plain, width, percent).where("label is not null").select("label", "doc_id", "text_hash"), "found")
    each = found.groupBy("label", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    best = each.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "text_hash")).alias("b"), F.sum("n").alias("rows")).where("rows > 1")
    best = Scratch(docs.sparkSession, "keepone").save(best.select("label", F.col("b.doc_id").alias("_id"), F.col("b.text_hash").alias("_hash")), "best")
    inside = join_unique(each, best, "label")
    stays = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
    inside = Scratch(docs.sparkSession, "keepone").save(inside.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), stays.alias("_stays"), F.col("n").alias("_n")), "inside")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("_hash"))

    def pick(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        keys = keys.select("_id", "_hash")
        return rows.join(F.broadcast(keys) if keys.count() <= BROADCAST_IDS // 2 else keys, same, how)

    rows = pick(docs, inside.where("not _stays"), "left_anti")
    twins = inside.where("_stays and _n > 1")
    if twins.isEmpty():
        return rows
    one = pick(rows, twins, "left_semi").groupBy("doc_id", "text").agg(F.first(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("_r")).select("_r.*")
    return pick(rows, twins, "left_anti").unionByName(one)


def op1_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)
