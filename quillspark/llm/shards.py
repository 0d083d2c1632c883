"""Look-ups in tables too large to broadcast: hashes go to the shard that knows them, answers come back to the rows.

Rows are cut into blocks of bounded text. A block is written once, as Arrow bytes, next to the distinct hashes that
it asks for, by shard. Each shard answers the blocks' hashes, and a block with its answers is one group. Shuffle follows
the input, whatever the size of the table, and no task holds more than one shard and its hashes, or one block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import Scratch, slices

BLOCK_TEXT = 8 << 20
ROW = "block string, shard int, kind int, data binary"
_ROW = pa.schema([("block", pa.string()), ("shard", pa.int32()), ("kind", pa.int32()), ("data", pa.binary())])


def split(hashes: np.ndarray, shard_bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """Hashes sorted by their first column, by the shard of its highest bits; only shards that have some."""
    first = hashes if hashes.ndim == 1 else hashes[:, 0]
    cut = np.searchsorted(first >> np.uint64(64 - shard_bits), np.arange((1 << shard_bits) + 1, dtype=np.uint64))
    for s in np.flatnonzero(np.diff(cut)):
        yield int(s), hashes[cut[s] : cut[s + 1]]


def _cut(asks: Callable, shard_bits: int):
    def block(name: str, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        rows = [(name, -1, -1, sink.getvalue().to_pybytes())]
        for kind, hashes in enumerate(asks(table)):
            rows += [(name, s, kind, some.tobytes()) for s, some in split(hashes, shard_bits)]
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _ROW, strict=True)], schema=_ROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, n = [], 0, 0
        for whole in batches:
            for batch in slices(whole, "text"):
                held.append(batch)
                size += batch.nbytes
                if size >= BLOCK_TEXT:
                    yield block(f"{TaskContext.get().partitionId()}-{n}", held)
                    held, size, n = [], 0, n + 1
        if held:
            yield block(f"{TaskContext.get().partitionId()}-{n}", held)

    return run


def look_up(rows: DataFrame, asks: Callable, shards: DataFrame, shard_bits: int, answer: Callable, finish: Callable, schema: str, scratch: Scratch) -> DataFrame:
    """What ``finish`` makes of each block of rows (with a column ``text``) and the answers to its hashes.

    asks(table): sorted distinct hashes, an array for each kind. answer(rows of a shard): a function of kind and hashes that gives
    an array of as many answers. finish(table, answers): a table of ``schema``; answers are bytes for each kind, in the order of the hashes.
    """
    cut = scratch.save(rows.mapInArrow(_cut(asks, shard_bits), ROW), "blocks")

    def ask(asked: pa.Table, known: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return _ROW.empty_table()
        reply = answer(known)
        data = [reply(kind, x.as_py()).tobytes() for kind, x in zip(asked.column("kind").to_pylist(), asked.column("data"), strict=True)]
        return pa.table([asked.column("block"), asked.column("shard"), asked.column("kind"), pa.array(data, pa.binary())], schema=_ROW)

    def join(block: pa.Table, answers: pa.Table) -> pa.Table:
        table = pa.ipc.open_stream(block.column("data")[0].as_py()).read_all()
        found: dict[int, list] = {}
        for _, kind, data in sorted(zip(answers.column("shard").to_pylist(), answers.column("kind").to_pylist(), answers.column("data").to_pylist(), strict=True)):
            found.setdefault(kind, []).append(data)
        return finish(table, {kind: b"".join(parts) for kind, parts in found.items()})

    asked = cut.where("shard >= 0")
    told = asked.groupBy("shard").cogroup(shards.groupBy(F.col("shard"))).applyInArrow(ask, ROW)
    return cut.where("shard < 0").groupBy("block").cogroup(told.groupBy("block")).applyInArrow(join, schema)
