"""Byte-level BPE encoding and decoding with a sentencepiece model written from a rank file.

The model's pieces are the vocabulary's byte strings with each byte mapped to a printable character; a piece's
score is its negative rank, so that sentencepiece merges the same pair first that the ranks would. Its normaliser is
the identity. Texts are cut into pre-tokens by the vocabulary's pattern and each is encoded on its own; a pre-token
that is a vocabulary entry is that entry. Decoding maps pieces back to bytes.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import bounded_batches, slices, table

#: A task forgets the pre-tokens that it met when there are more of them.
REMEMBERED = 150_000


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where Latin-1 prints it, else one from U+0100 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, more = [""] * 256, 256
    for b in range(256):
        out[b] = chr(b) if b in own else chr(more)
        more += b not in own
    return out


def _field(number: int, payload: bytes | int | float) -> bytes:
    """One protocol-buffer field: bytes, varint or 32-bit float."""
    if isinstance(payload, float):
        return _varint(number << 3 | 5) + np.float32(payload).tobytes()
    if isinstance(payload, int):
        return _varint(number << 3) + _varint(payload)
    return _varint(number << 3 | 2) + _varint(len(payload)) + payload


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_ranks(path: str) -> list[bytes]:
    """The byte strings of a rank file, by rank. The file is read on the driver; ranks must be 0..n-1."""
    with open(path, "rb") as f:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, f)}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError(f"the ranks of {path} have gaps")
    return [ranks[i] for i in range(len(ranks))]


def serialise(tokens: list[bytes]) -> bytes:
    """A sentencepiece ModelProto: a BPE model whose piece numbers are ranks; the unknown piece comes last."""
    chars = byte_characters()
    pieces = [_field(1, "".join(chars[b] for b in t).encode()) + _field(2, float(-i)) + _field(3, 1) for i, t in enumerate(tokens)]
    pieces.append(_field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, len(tokens)) + b"".join(_field(n, (1 << 64) - 1) for n in (41, 42, 43))
    normaliser = _field(1, b"identity") + _field(2, b"") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normaliser)


class _Codes(dict):
    """Numbers of pre-tokens; those met for the first time are listed in ``new``."""

    def __missing__(self, part: str) -> int:
        self[part] = code = self.first + len(self.new)
        self.new.append(part)
        return code


def ragged(pool: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches pool[start : start + size], one after the other."""
    shift = start - np.concatenate([[0], np.cumsum(size)[:-1]]) if len(size) else start
    return pool[np.repeat(shift, size) + np.arange(int(size.sum()))]


class Encoder:
    def __init__(self, tokens: list[bytes], model: bytes, pattern: str):
        self.model = sentencepiece.SentencePieceProcessor()
        self.model.LoadFromSerializedProto(model)
        self.split = regex.compile(pattern).findall
        self.chars = {b: c for b, c in enumerate(byte_characters())}
        self.tokens = tokens
        self.reset()

    def reset(self) -> None:
        """Codes 0..n-1 are the vocabulary's entries, each of one id; further codes are pre-tokens met since."""
        self.codes = _Codes()
        for i, t in enumerate(self.tokens):
            try:
                self.codes[t.decode()] = i
            except UnicodeDecodeError:
                pass  # no text holds these bytes as a pre-token
        n = len(self.tokens)
        self.pool, self.start, self.size = np.arange(n, dtype=np.int32), np.arange(n), np.ones(n, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and each text's number of ids."""
        if len(self.codes) > len(self.tokens) + REMEMBERED:
            self.reset()
        known = self.codes
        known.first, known.new = len(self.size), []
        parts = [self.split(t) for t in texts]
        n = np.fromiter(map(len, parts), np.int64, len(parts))
        codes = np.fromiter(map(known.__getitem__, chain.from_iterable(parts)), np.int64, int(n.sum()))
        if known.new:
            found = self.model.EncodeAsIds([p.encode().decode("latin-1").translate(self.chars) for p in known.new])
            size = np.fromiter(map(len, found), np.int64, len(found))
            self.start = np.concatenate([self.start, len(self.pool) + np.cumsum(size) - size])
            self.size = np.concatenate([self.size, size])
            self.pool = np.concatenate([self.pool, np.fromiter(chain.from_iterable(found), np.int32, int(size.sum()))])
        size = self.size[codes]
        ends = np.concatenate([[0], np.cumsum(size)])
        at = np.concatenate([[0], np.cumsum(n)])
        return ragged(self.pool, self.start[codes], size), ends[at[1:]] - ends[at[:-1]]


class Decoder:
    """The inverse mapping: the model's piece of each id, back to bytes."""

    def __init__(self, model: bytes):
        sp = sentencepiece.SentencePieceProcessor()
        sp.LoadFromSerializedProto(model)
        back = {c: b for b, c in enumerate(byte_characters())}
        pieces = [bytes(back[c] for c in sp.IdToPiece(i)) for i in range(sp.GetPieceSize() - 1)]
        self.pool = np.frombuffer(b"".join(pieces), np.uint8)
        self.size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        self.start = np.cumsum(self.size) - self.size

    def decode(self, ids: np.ndarray, n: np.ndarray) -> pa.Array:
        """The bytes of each row, given all rows' ids one after the other."""
        size = self.size[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        offsets = ends[np.concatenate([[0], np.cumsum(n)])].astype(np.int32)
        data = ragged(self.pool, self.start[ids], size)
        return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _lists(ids: np.ndarray, n: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(ids))


def _encode(model, pattern: str, kept: list[str], back: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = decoder = None
        for whole in batches:
            encoder = encoder or Encoder(*model.value, pattern)
            if back and not decoder:
                decoder = Decoder(model.value[1])
            for batch in slices(whole, "text", 1 << 20):
                ids, n = encoder.encode([t or "" for t in batch.column("text").to_pylist()])
                columns, names = [*(batch.column(c) for c in kept), _lists(ids, n)], [*kept, "ids"]
                if decoder:
                    columns, names = [*columns, decoder.decode(ids, n)], [*names, "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _decode(model, kept: list[str], ids_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = None
        for batch in batches:
            decoder = decoder or Decoder(model.value[1])
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                lists = part.column(ids_col)
                n = np.array([len(x) if x.is_valid else 0 for x in lists], np.int64)
                decoded = decoder.decode(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), n)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), decoded], names=[*kept, "decoded"])

    return run


class Codec:
    """A vocabulary ready to encode and decode DataFrames. The vocabulary's size bounds what is broadcast."""

    def __init__(self, spark, path: str, pattern: str):
        bounded_batches(spark)
        tokens = read_ranks(path)
        self.pattern = pattern
        self.model = spark.sparkContext.broadcast((tokens, serialise(tokens)))

    def encode(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """docs with ``ids`` in place of the text; a null text is empty and has no ids. Each of repeated rows is encoded; an empty table
        gives no rows; texts are worked in slices of 1 MB, one text at least. Columns named ids or decoded are replaced, all others kept."""
        return self._encoded(docs, text_col, False)

    def round_trip(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """docs with ``ids`` and ``decoded`` in place of the text: both ways in one pass over the rows."""
        return self._encoded(docs, text_col, True)

    def _encoded(self, docs: DataFrame, text_col: str, back: bool) -> DataFrame:
        others = [c for c in docs.columns if c not in (text_col, "ids", "decoded")]
        kept = [f"c{k}" for k in range(len(others))]
        held = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(others, kept, strict=True)], F.col(text_col).cast("string").alias("text"))
        more = [F.lit(None).cast("array<int>").alias("ids")] + [F.lit(None).cast("binary").alias("decoded")] * back
        rows = held.mapInArrow(_encode(self.model, self.pattern, kept, back), held.select(*kept, *more).schema)
        return rows.toDF(*others, "ids", *["decoded"] * back)

    def decode(self, docs: DataFrame, ids_col: str = "ids") -> DataFrame:
        """docs with ``decoded``, the bytes of the ids, after its columns; null ids decode to no bytes."""
        kept = [c for c in docs.columns if c != "decoded"]
        schema = docs.select(*kept, F.lit(None).cast("binary").alias("decoded")).schema
        return docs.select(*kept).mapInArrow(_decode(self.model, kept, ids_col), schema)


def default_codec(spark, name: str = "byte_bpe_multi_50k.tiktoken") -> Codec:
    import public_tokenizers

    return Codec(spark, public_tokenizers.path(name), public_tokenizers.PATTERN)


def digest(decoded: DataFrame, *keep: str) -> DataFrame:
    """``n_tokens, ids_sha256, decoded_sha256`` of ids and decoded bytes."""
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decoded.select(*keep, F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_byte_bpe(spark, sf_dir: str) -> DataFrame:
    codec = default_codec(spark)
    return digest(codec.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id")
