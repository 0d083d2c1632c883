"""Dropping lines that many documents share.

Each task counts the documents of its distinct lines by a 128-bit hash and sends blocks of (hash, count) to
shards by hash, so that a line of any frequency meets as few partial sums. A shard adds them up and indexes the
frequent lines: a minimal perfect hash, in levels of bits where a key that stands alone at its place stays and the
others go on, numbers its keys; compact arrays hold a fingerprint and a count for each number. Documents probe
these arrays instead of joining their lines. Rare lines aren't in the index: they can't be dropped, and the 64-bit
fingerprint tells them from those that are.

Arrays of at most ``PART_BYTES`` are broadcast, and the workers of an executor map one copy; larger ones stay in their
shards, and the texts' distinct line hashes go there (``shards.look_up``), with the same result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import Scratch, Shared, blobs, bounded_batches, mix, slices, table
from quillspark.llm.shards import look_up

#: The most that is broadcast.
PART_BYTES = 1 << 27
#: Bits for each key of a level, and the level from which the other half of the hash decides.
LOAD, SECOND = 1.6, 12
SHARD_TEXT, BLOCK_LINES = 32 << 20, 1_000_000


def key(line: bytes) -> bytes:
    """Strips U+0020 and U+0009..U+000D at both ends and lower-cases A-Z."""
    return line.strip().lower()


def _hashes(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), ">u8").astype(np.uint64).reshape(-1, 2)


def _add(h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((h[:, 1], h[:, 0]))
    h, c = h[order], c[order]
    new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]).any(axis=1)])) if len(h) else np.zeros(0, np.int64)
    return h[new], np.add.reduceat(c, new) if len(new) else c


def _count(shard_bits: int, least_size: int):
    schema = pa.schema([("shard", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            h, c = _add(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))
            cut = np.searchsorted(h[:, 0] >> np.uint64(64 - shard_bits), np.arange((1 << shard_bits) + 1, dtype=np.uint64))
            some = np.flatnonzero(np.diff(cut))
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([h[cut[s] : cut[s + 1]].tobytes() for s in some], pa.binary()), pa.array([c[cut[s] : cut[s + 1]].tobytes() for s in some], pa.binary())], schema=schema)
            held.clear()

        for whole in batches:
            for batch in slices(whole, "text"):
                found: list[bytes] = []
                for text in blobs(batch.column("text")):
                    found += {k for k in map(key, text.split(b"\n")) if len(k) >= least_size and _long(k, least_size)}
                if found:
                    h = _hashes(found)
                    held.append(_add(h, np.ones(len(h), np.int64)))
                    size += len(held[-1][0])
                if size >= BLOCK_LINES:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    return run


def _long(k: bytes, least: int) -> bool:
    return least <= 1 or len(k.decode("utf-8", "replace")) >= least


def _place(h: np.ndarray, level: int, bits: np.ndarray | int) -> np.ndarray:
    """Positions of 128-bit hashes in a level. Levels from SECOND on go by the second half, so keys that share the first half part there."""
    one = h[:, 0] if level < SECOND else mix(h[:, 1] ^ h[:, 0])
    return mix(one + np.uint64(level * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) % np.asarray(bits).astype(np.uint64)


def perfect_hash(h: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Level sizes in 64-bit words, the levels' words, and each key's number 0..n-1. Keys are distinct 128-bit hashes."""
    sizes, words, where = [], [], np.zeros(len(h), np.int64)
    left, base = np.arange(len(h)), 0
    while len(left):
        n = max(1, math.ceil(len(left) * LOAD / 64))
        place = _place(h[left], len(sizes), n * 64).astype(np.int64)
        alone = np.bincount(place, minlength=n * 64)[place] == 1
        filled = np.zeros(n * 64, bool)
        filled[place[alone]] = True
        words.append(np.packbits(filled, bitorder="little").view(np.uint64))
        where[left[alone]] = base * 64 + place[alone]
        sizes.append(n)
        left, base = left[~alone], base + n
    number = np.empty(len(h), np.int64)
    number[np.argsort(where)] = np.arange(len(h))
    return sizes, np.concatenate(words) if words else np.zeros(0, np.uint64), number


def _build(least: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        h = np.concatenate([np.frombuffer(x, np.uint64) for x in group["hashes"]]).reshape(-1, 2)
        h, c = _add(h, np.concatenate([np.frombuffer(x, np.int64) for x in group["counts"]]))
        distinct = len(h)
        h, c = h[c >= least], c[c >= least]
        sizes, words, number = perfect_hash(h)
        prints, counts = np.empty(len(h), np.uint64), np.empty(len(h), np.uint32)
        prints[number], counts[number] = h[:, 1], np.minimum(c, 0xFFFFFFFF)
        return pd.DataFrame({"shard": [int(group["shard"].iat[0])], "distinct": [distinct], "sizes": [sizes], "words": [words.tobytes()], "prints": [prints.tobytes()], "counts": [counts.tobytes()]})

    return run


class LineIndex:
    """Neighbouring shards side by side, from the shard ``low`` on: level words with running counts, fingerprints and counts.

    Levels are ragged: shard s has the level sizes ``sizes[first[s] : first[s + 1]]``, in words, so nothing is held for a shard
    that has no keys but its place in ``first``.
    """

    def __init__(self, shard_bits: int, low: int, first: np.ndarray, sizes: np.ndarray, words: np.ndarray, rank: np.ndarray, prints: np.ndarray, counts: np.ndarray):
        self.shard_bits, self.low, self.first, self.sizes = shard_bits, low, first, sizes
        self.begin = np.concatenate([[0], np.cumsum(sizes)])
        self.words, self.rank, self.prints, self.counts = words, rank, prints, counts

    @staticmethod
    def of(shard_bits: int, low: int, high: int, rows: list) -> LineIndex:
        """From the rows of the shards low to high, by shard; those without keys may lack."""
        levels, join = np.zeros(high - low + 2, np.int64), lambda name, kind: np.concatenate([*(np.frombuffer(r[name], kind) for r in rows), np.zeros(0, kind)])
        for r in rows:
            levels[r["shard"] - low + 1] = len(r["sizes"])
        words = join("words", np.uint64)
        rank = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
        sizes = np.array([n for r in rows for n in r["sizes"]], np.int64)
        return LineIndex(shard_bits, low, np.cumsum(levels), sizes, words, rank, join("prints", np.uint64), join("counts", np.uint32))

    def probe(self, h: np.ndarray) -> np.ndarray:
        """The number of documents of each hash, 0 for those not indexed."""
        out = np.zeros(len(h), np.int64)
        shard = (h[:, 0] >> np.uint64(64 - self.shard_bits)).astype(np.int64) - self.low
        first, last = self.first[shard], self.first[shard + 1]
        alive, level = np.arange(len(h)), 0
        while True:
            alive = alive[first[alive] + level < last[alive]]
            if not len(alive):
                return out
            row = first[alive] + level
            place = _place(h[alive], level, self.sizes[row] * 64).astype(np.int64)
            word, bit = self.begin[row] + (place >> 6), (place & 63).astype(np.uint64)
            hit = self.words[word] >> bit & np.uint64(1) == 1
            number = self.rank[word[hit]] + np.bitwise_count(self.words[word[hit]] & ((np.uint64(1) << bit[hit]) - np.uint64(1)))
            same = self.prints[number] == h[alive[hit], 1]
            out[alive[hit][same]] = self.counts[number[same]]
            alive, level = alive[~hit], level + 1


def _cut(column: pa.Array, least_size: int) -> tuple[list[list[bytes]], np.ndarray, list[bytes], np.ndarray]:
    """Each text's lines and their number, all keys one after the other, and which are long enough to be dropped."""
    lines = [x.split(b"\n") for x in blobs(column)]
    n = np.fromiter(map(len, lines), np.int64, len(lines))
    keys = [key(x) for part in lines for x in part]
    return lines, n, keys, np.fromiter((len(k) >= least_size and _long(k, least_size) for k in keys), bool, len(keys))


def _less(lines: list[list[bytes]], n: np.ndarray, gone: np.ndarray) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Texts without the lines that go, the number of lines before, and of those dropped."""
    doc = np.repeat(np.arange(len(lines)), n)
    dropped = np.bincount(doc[gone], minlength=len(lines)).astype(np.int64)
    texts, at = [], 0
    for part, some, size in zip(lines, dropped, n, strict=True):
        texts.append(b"\n".join(part if not some else [x for x, g in zip(part, gone[at : at + size], strict=True) if not g]))
        at += size
    return pa.array(texts, pa.binary()).cast(pa.string()), pa.array(n), pa.array(dropped)


def _drop(shared: Shared, shard_bits: int, least: int, least_size: int, kept: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.arrays()
        index = LineIndex(shard_bits, 0, *(held[x] for x in ("first", "sizes", "words", "rank", "prints", "counts")))
        for whole in batches:
            for batch in slices(whole, "text"):
                lines, n, keys, gone = _cut(batch.column("text"), least_size)
                if gone.any():
                    gone[gone] = index.probe(_hashes([k for k, g in zip(keys, gone.tolist(), strict=True) if g])) >= least
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *_less(lines, n, gone)], names=[*kept, "text", "n_lines", "n_dropped"])

    return run


def _distinct(keys: list[bytes], gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the keys that may go, and each one's place there."""
    h = _hashes([k for k, g in zip(keys, gone.tolist(), strict=True) if g])
    both, at = np.unique(np.ascontiguousarray(h[:, [0, 1]].astype(">u8")).view("V16").ravel(), return_inverse=True)
    return np.frombuffer(both.tobytes(), ">u8").astype(np.uint64).reshape(-1, 2), at


def _asks(least_size: int):
    def asks(table: pa.Table) -> list[np.ndarray]:
        _, _, keys, gone = _cut(table.column("text").combine_chunks(), least_size)
        return [_distinct(keys, gone)[0]] if gone.any() else []

    return asks


def _answer(shard_bits: int, least: int):
    def answer(known: pa.Table):
        rows = known.to_pylist()
        low = rows[0]["shard"] if rows else 0
        index = LineIndex.of(shard_bits, low, low, rows) if rows else None
        return lambda _, data: (index.probe(np.frombuffer(data, np.uint64).reshape(-1, 2)) >= least).view(np.uint8) if index else np.zeros(len(data) // 16, np.uint8)

    return answer


def _join(least_size: int, kept: list[str]):
    def finish(table: pa.Table, answers: dict[int, bytes]) -> pa.Table:
        lines, n, keys, gone = _cut(table.column("text").combine_chunks(), least_size)
        if gone.any():
            gone[gone] = np.frombuffer(answers[0], np.uint8)[_distinct(keys, gone)[1]] == 1
        return pa.table([*(table.column(c) for c in kept), *_less(lines, n, gone)], names=[*kept, "text", "n_lines", "n_dropped"])

    return finish


def drop_common_lines(docs: DataFrame, least: int = 10, least_size: int = 1, text_col: str = "text", numbers: bool = True) -> DataFrame:
    """docs with the text less its common lines, and ``n_lines, n_dropped`` appended.

    A line whose key has at least least_size code points and occurs in at least ``least`` rows of docs goes from
    every row; the others stay, joined by newlines. Null texts are one empty line and become empty texts. Repeated rows
    count each. An empty table gives no rows. Columns of docs named n_lines or n_dropped are replaced; the others are kept,
    whatever their names. With numbers=False only the columns of docs come back, those two names among them as they are.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "lines")
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shard_bits = min(24, max(3, math.ceil(math.log2(max(1, size / SHARD_TEXT)))))
    blocks = texts.mapInArrow(_count(shard_bits, least_size), "shard int, hashes binary, counts binary")
    built = blocks.groupBy("shard").applyInPandas(_build(least), "shard int, distinct long, sizes array<int>, words binary, prints binary, counts binary")
    built = scratch.save(built, "index").where("octet_length(prints) > 0")
    weight = built.agg(F.coalesce(F.sum(2 * F.octet_length("words") + F.octet_length("prints") + F.octet_length("counts") + 16 * F.size("sizes")), F.lit(0))).first()[0]

    added = ["n_lines", "n_dropped"] if numbers else []
    others = [c for c in docs.columns if c not in (text_col, *added)]
    kept = [f"c{k}" for k in range(len(others))]
    rows = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(others, kept, strict=True)], F.col(text_col).cast("string").alias("text"))
    schema = rows.withColumns({"n_lines": F.lit(None).cast("long"), "n_dropped": F.lit(None).cast("long")}).schema
    if weight + (8 << shard_bits) <= PART_BYTES:
        index = LineIndex.of(shard_bits, 0, (1 << shard_bits) - 1, sorted(built.select("shard", "sizes", "words", "prints", "counts").toLocalIterator(), key=lambda r: r.shard))
        arrays = {name: getattr(index, name) for name in ("first", "sizes", "words", "rank", "prints", "counts")}
        shared = Shared({name: (x.dtype.type, len(x)) for name, x in arrays.items()})
        for name, x in arrays.items():
            shared.array(name)[:] = x
        rows = rows.mapInArrow(_drop(shared.send(spark), shard_bits, least, least_size, kept), schema)
    else:
        rows = look_up(rows, _asks(least_size), built.select("shard", "sizes", "words", "prints", "counts"), shard_bits, _answer(shard_bits, least), _join(least_size, kept), schema, scratch)
    names = dict(zip(others, kept, strict=True)) | {text_col: "text"} | {c: c for c in added}
    return rows.select(*[F.col(names[c]).alias(c) for c in [*(c for c in docs.columns if c not in added), *added]])


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    rows = drop_common_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), 10, 1)
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP7_SQL = """
with d as (select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
l as (select r, doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as i from d),
k as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
c as (select key from k where key <> '' group by key having count(distinct r) >= 10),
m as (select k.*, c.key is not null as gone from k left join c using (key))
select doc_id, count(*)::bigint as n_lines, (count(*) filter (where gone))::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) as kept_sha256
from m group by r, doc_id
"""
