"""Language-model scores from a log-frequency Bloom filter.

Every training text is counted once: word and word-pair hashes (64 bits) are counted in each task, and blocks of
(hash, count) go to shards by hash, so no frequent word meets in one place. A shard adds its blocks up and
sets bits for the quantised counts: an n-gram of level j = 1 + floor(log_b count) is entered as (n-gram, 1) to
(n-gram, j), each as ``PROBES`` bits of one 64-bit word. The filter is the shards' words side by side; a count is read back
by probing levels until one is missing. Probabilities are smoothed towards the unigram with ``PRIOR`` pseudo-counts:

    p(w | v) = (c(v w) + PRIOR * p(w)) / (C(v) + PRIOR),   p(w) = (c(w) + 0.1) / (N + 0.1 (V + 1))

c is the least count of a level and C the greatest, so the counts of a word's followers never add up to more than C and the
probabilities after a word to no more than 1, but for errors of the filter. A pair of a word never seen counts 0. The base
score uses exact unigram counts instead, held as sorted hash and count arrays.

Every word and word pair is entered, whatever their number. Filter and exact counts of at most ``SHARED_BYTES`` are broadcast in
parts, and the workers of an executor map one copy of each; larger ones stay in their shards, and the texts' distinct hashes go there
(``shards.look_up``), with the same scores.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import Scratch, Shared, bounded_batches, fold, mix, pair_hash, slices, table
from quillspark.llm.shards import look_up
from quillspark.llm.wordhash import column_hashes

BASE, PRIOR = 1.5, 150.0
BITS_PER_ENTRY, PROBES = 16, 5
#: The most that is broadcast, filter and exact counts together, and the most that the driver holds of it at once (one shard at least).
SHARED_BYTES, PART_BYTES = 1 << 29, 1 << 26
#: Bytes of training text for each shard, and of text for each block of counts that a task sends.
SHARD_TEXT, BLOCK_TEXT = 8 << 20, 12 << 20

BEGIN, END = np.uint64(0xB0B0B0B0B0B0B0B1), np.uint64(0xE0E0E0E0E0E0E0E1)


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a slice: the hashes of all tokens (each text's words and its end), of the tokens before them, and tokens per text."""
    flat, n = column_hashes(texts)
    total = len(flat) + len(n)
    ends = np.cumsum(n + 1) - 1
    token = np.empty(total, np.uint64)
    inner = np.ones(total, bool)
    inner[ends] = False
    token[inner], token[ends] = flat, END
    before = np.empty(total, np.uint64)
    before[1:] = token[:-1]
    before[ends[:-1] + 1] = BEGIN
    before[:1] = BEGIN
    return token, before, n + 1


def _tally(h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and the sum of their counts."""
    order = np.argsort(h, kind="stable")
    h, c = h[order], c[order]
    new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    return h[new], np.add.reduceat(c, new) if len(new) else c


def _count(shard_bits: int):
    """Blocks of counts, of words (kind 1) and of word pairs (kind 2)."""
    schema = pa.schema([("kind", pa.int32()), ("shard", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary())])

    def cells(x: np.ndarray, cut: np.ndarray) -> pa.Array:
        """Stretches of x as binary cells, without a copy."""
        return pa.Array.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer((cut * x.itemsize).astype(np.int32)), pa.py_buffer(x)])

    def block(kind: int, parts: list[np.ndarray]) -> pa.RecordBatch:
        h = np.concatenate(parts)
        parts.clear()
        h.sort()
        new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        c, h = np.diff(np.append(new, len(h))), h[new]
        c = c.astype(np.uint8 if c.max(initial=1) < 256 else np.uint64)
        cut = np.searchsorted(h >> np.uint64(64 - shard_bits), np.arange((1 << shard_bits) + 1, dtype=np.uint64))
        some = np.flatnonzero(np.diff(cut))
        cut = np.append(cut[some], len(h))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(some), kind, np.int32)), pa.array(some.astype(np.int32)), cells(h, cut), cells(c, cut)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {1: [], 2: []}, 0
        for whole in batches:
            for batch in slices(whole, "text"):
                token, before, _ = _tokens(batch.column("text"))
                held[1].append(token)
                held[2].append(pair_hash(before, token))
                size += batch.nbytes
                if size >= BLOCK_TEXT:
                    yield from (block(kind, parts) for kind, parts in held.items())
                    size = 0
        if held[1]:
            yield from (block(kind, parts) for kind, parts in held.items())

    return run


def level(count: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(count) / math.log(BASE) + 1e-9).astype(np.int64)


_LEVELS = np.arange(130, dtype=np.float64)
_LEAST = np.where(_LEVELS > 0, np.ceil(BASE ** (_LEVELS - 1.0) - 1e-9), 0.0)


def least(levels: np.ndarray) -> np.ndarray:
    """The least count of a level; 0 for level 0."""
    return _LEAST[levels]


def greatest(levels: np.ndarray) -> np.ndarray:
    """The greatest count of a level; 0 for level 0."""
    return np.where(levels > 0, _LEAST[np.asarray(levels, np.int64) + 1] - 1, 0.0)


def _key(h: np.ndarray, kind: int) -> np.ndarray:
    """The key of a word (kind 1) or a word pair (kind 2) in the filter."""
    return mix(h ^ np.uint64(kind))


def _entry(key: np.ndarray, level: int, size: np.ndarray | np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """The word of an entry, out of ``size``, and its bits there."""
    h = mix(key + np.uint64(level * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF))
    bits = np.zeros(len(h), np.uint64)
    for k in range(PROBES):
        bits |= np.uint64(1) << (h >> np.uint64(6 * k) & np.uint64(63))
    return ((h >> np.uint64(32)) * size >> np.uint64(32)).astype(np.int64), bits


def _build(group: pd.DataFrame) -> pd.DataFrame:
    """A shard: blocks added up, the filter of its words and word pairs together, and the exact counts of its words."""
    keys, levels, known = [], [], (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    for kind in (1, 2):
        own = group[group["kind"] == kind]
        if len(own):
            cs = [np.frombuffer(c, np.uint8 if len(c) * 8 == len(h) else np.uint64).astype(np.int64) for h, c in zip(own["hashes"], own["counts"], strict=True)]
            h, c = _tally(np.concatenate([np.frombuffer(x, np.uint64) for x in own["hashes"]]), np.concatenate(cs))
            keys.append(_key(h, kind))
            levels.append(level(c).astype(np.uint8))
            known = (h, c) if kind == 1 else known
    key, top = np.concatenate(keys), np.concatenate(levels)
    size = max(1, -(-int(top.sum(dtype=np.int64)) * BITS_PER_ENTRY // 64))
    filled, j = np.zeros(size, np.uint64), 1
    while len(key):
        for at in range(0, len(key), 1 << 18):
            word, bits = _entry(key[at : at + (1 << 18)], j, np.uint64(size))
            np.bitwise_or.at(filled, word, bits)
        j += 1
        key, top = key[top >= j], top[top >= j]
    return pd.DataFrame({"shard": [int(group["shard"].iat[0])], "filter": [filled.tobytes()], "hashes": [known[0].tobytes()], "counts": [known[1].tobytes()], "n": [int(known[1].sum())]})


class Filter:
    """The words of some shards side by side, from the shard ``low`` on, and the exact counts of the words that they know."""

    def __init__(self, shard_bits: int, low: int, start: np.ndarray, size: np.ndarray, data: np.ndarray, hashes: np.ndarray, counts: np.ndarray):
        self.shard_bits, self.low, self.start, self.size, self.data, self.hashes, self.exact = shard_bits, low, start, size, data, hashes, counts

    def levels(self, h: np.ndarray, kind: int) -> np.ndarray:
        """The level of each word (kind 1) or word pair (kind 2), 0 if it isn't in the filter."""
        out = np.zeros(len(h), np.uint8)
        if not len(self.data):
            return out
        shard = (h >> np.uint64(64 - self.shard_bits)).astype(np.int64) - self.low
        key, alive, j = _key(h, kind), np.flatnonzero(self.size[shard] > 0), 1
        key, size, start = key[alive], self.size[shard[alive]].astype(np.uint64), self.start[shard[alive]]
        while len(alive):
            word, bits = _entry(key, j, size)
            hit = self.data[start + word] & bits == bits
            alive, key, size, start = alive[hit], key[hit], size[hit], start[hit]
            out[alive] = j
            j += 1
        return out

    def counts(self, h: np.ndarray) -> np.ndarray:
        """The exact count of each word, 0 if it was never met."""
        if not len(self.hashes):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.exact[at], 0).astype(np.int64)


class Parts:
    """Filters of neighbouring shards that together are the whole."""

    def __init__(self, filters: list[Filter], shard_bits: int):
        self.filters, self.down = filters, np.uint64(64 - shard_bits)
        self.last = np.array([f.low + len(f.size) - 1 for f in filters])

    def _each(self, h: np.ndarray, read) -> np.ndarray:
        part, out = np.searchsorted(self.last, (h >> self.down).astype(np.int64)), np.zeros(len(h), np.int64)
        for k, f in enumerate(self.filters):
            own = np.flatnonzero(part == k)
            out[own] = read(f, h[own])
        return out

    def levels(self, h: np.ndarray, kind: int) -> np.ndarray:
        return self._each(h, lambda f, x: f.levels(x, kind))

    def counts(self, h: np.ndarray) -> np.ndarray:
        return self._each(h, Filter.counts)


def logs(pair: np.ndarray, word: np.ndarray, context: np.ndarray, known: np.ndarray, n: int, v: int) -> np.ndarray:
    """log10 p(word | context). pair, word: least counts of the levels; context: the greatest; known: whether the word was met."""
    p = (word + 0.1) / (n + 0.1 * (v + 1))
    return np.log10((np.where(known, np.minimum(pair, context), 0.0) + PRIOR * p) / (context + PRIOR))


OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
OUT_SQL = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _finish(batch, totals: dict[str, int], size: np.ndarray, opening: np.ndarray, at: np.ndarray, exact: np.ndarray, of_type: np.ndarray, of_pair: np.ndarray) -> dict[str, pa.Array]:
    """The result's columns. at: each token's type; exact, of_type: a type's count and level; of_pair: each token's pair level."""
    doc = np.repeat(np.arange(len(size)), size)
    base = np.log10((exact + 0.1) / (totals["n"] + 0.1 * (totals["v"] + 1)))[at]
    context = np.empty(len(at))
    context[1:] = greatest(of_type)[at[:-1]]
    context[opening] = totals["ends"]
    known = (exact > 0)[at]
    made = logs(least(of_pair), least(of_type)[at], context, known, totals["n"], totals["v"])
    add = lambda x: np.bincount(doc, x, len(size))
    columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(size, pa.int64()), pa.array(add(known).astype(np.int64)), pa.array(add(base)), pa.array(add(made))]
    return dict(zip(OUT.names, columns, strict=True))


def _scores(parts: list[tuple[int, np.ndarray, Shared]], shard_bits: int, totals: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = []
        for low, start, shared in parts:
            held = shared.arrays()
            filters.append(Filter(shard_bits, low, start[:-1], np.diff(start), held["filter"], held["hashes"], held["counts"]))
        model = Parts(filters, shard_bits)
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                token, before, size = _tokens(batch.column("text"))
                types, at = np.unique(token, return_inverse=True)
                pair = model.levels(pair_hash(before, token), 2)
                row = _finish(batch, totals, size, before == BEGIN, at, model.counts(types), model.levels(types, 1), pair)
                yield pa.RecordBatch.from_arrays(list(row.values()), schema=OUT)

    return run


def _asks(batch) -> list[np.ndarray]:
    token, before, _ = _tokens(batch.column("text"))
    return [np.unique(token), np.unique(pair_hash(before, token))]


def _answer(shard_bits: int):
    """Words: exact count * 256 + level. Pairs: level."""

    def answer(known: pa.Table):
        if not known.num_rows:
            return lambda kind, data: np.zeros(len(data) // 8, np.uint8 if kind else np.int64)
        row = {c: known.column(c)[0].as_py() for c in known.column_names}
        data = np.frombuffer(row["filter"], np.uint64)
        model = Filter(shard_bits, row["shard"], np.zeros(1, np.int64), np.array([len(data)]), data, np.frombuffer(row["hashes"], np.uint64), np.frombuffer(row["counts"], np.int64))

        def reply(kind: int, data: bytes) -> np.ndarray:
            h = np.frombuffer(data, np.uint64)
            return model.levels(h, 2) if kind else model.counts(h) << 8 | model.levels(h, 1)

        return reply

    return answer


def _join(totals: dict[str, int]):
    def finish(batch: pa.Table, answers: dict[int, bytes]) -> pa.Table:
        token, before, size = _tokens(batch.column("text"))
        _, at = np.unique(token, return_inverse=True)
        _, pair_at = np.unique(pair_hash(before, token), return_inverse=True)
        told = np.frombuffer(answers[0], np.int64)
        row = _finish(batch, totals, size, before == BEGIN, at, told >> 8, told & 255, np.frombuffer(answers[1], np.uint8)[pair_at])
        return pa.table(list(row.values()), schema=OUT)

    return finish


def _share(built: DataFrame, sizes: dict[int, tuple[int, int]], shard_bits: int, totals: dict[str, int]) -> list[tuple[int, np.ndarray, Shared]]:
    """The shards' arrays, broadcast in parts of neighbouring shards: first shard, where each shard's words begin, arrays."""
    ranges, held, narrow = [], 0, np.uint32 if totals["n"] < 1 << 32 else np.int64
    for s in range(1 << shard_bits):
        f, n = sizes.get(s, (0, 0))
        if not ranges or held + 8 * f + 16 * n > PART_BYTES:
            ranges.append([])
            held = 0
        ranges[-1].append(s)
        held += 8 * f + 16 * n
    parts = []
    for own in ranges:
        start, known = (np.concatenate([[0], np.cumsum([sizes.get(s, (0, 0))[k] for s in own])]).astype(np.int64) for k in (0, 1))
        shared = Shared({"filter": (np.uint64, int(start[-1])), "hashes": (np.uint64, int(known[-1])), "counts": (narrow, int(known[-1]))})
        for r in built.where(F.col("shard").between(own[0], own[-1])).toLocalIterator():
            at = r.shard - own[0]
            shared.array("filter")[start[at] : start[at + 1]] = np.frombuffer(r.filter, np.uint64)
            shared.array("hashes")[known[at] : known[at + 1]] = np.frombuffer(r.hashes, np.uint64)
            shared.array("counts")[known[at] : known[at + 1]] = np.frombuffer(r.counts, np.int64)
        parts.append((own[0], start, shared.send(built.sparkSession)))
    return parts


def lm_scores(docs: DataFrame, held_out: Column) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row of docs.

    Counts come from all rows that aren't held out. Null texts are empty: one token, the end. Rows without an
    id count as held out. Without training rows every count is 0 and every score finite. An empty table gives no rows.
    Repeated rows count each. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "lm")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(True)).alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    train = plain.where("not held_out").select("text")
    size = train.agg(F.count(F.lit(1)).alias("ends"), F.sum(F.octet_length("text")).alias("bytes")).first()
    shard_bits = min(24, max(3, math.ceil(math.log2(max(1, (size.bytes or 0) / SHARD_TEXT)))))
    blocks = train.mapInArrow(_count(shard_bits), "kind int, shard int, hashes binary, counts binary")
    built = blocks.groupBy("shard").applyInPandas(_build, "shard int, filter binary, hashes binary, counts binary, n long")
    built = scratch.save(built, "filter")
    about = built.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.octet_length("hashes") / 8), F.lit(0)).cast("long").alias("v")).first()
    totals = {"n": about.n, "v": about.v, "ends": size.ends}
    sizes = {r.shard: (r.f, r.n) for r in built.select("shard", (F.octet_length("filter") / 8).cast("long").alias("f"), (F.octet_length("hashes") / 8).cast("long").alias("n")).collect()}
    if sum(8 * f + 16 * n for f, n in sizes.values()) <= SHARED_BYTES:
        rows = plain.mapInArrow(_scores(_share(built, sizes, shard_bits, totals), shard_bits, totals), OUT_SQL)
    else:
        rows = look_up(plain, _asks, built.drop("n"), shard_bits, _answer(shard_bits), _join(totals), OUT_SQL, scratch)
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(totals["n"]).cast("long").alias("train_tokens"), "base_score", "score")


def op5_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 10) == 0)
