"""Token ids packed into rows of a fixed length, best fit decreasing.

Texts become token ids; each document ends with the end id. A document longer than a row is cut into
full rows and a rest, nothing is lost. Pieces of one window of documents go, the longest first,
to the open row that they fill best: a segment tree over remaining capacities finds the least one
that suffices. A window is a bounded number of tokens of one partition, so nothing is shuffled and memory
stays bounded; a lost task is simply run again.

A row holds ``input_ids`` (little-endian, 2 bytes an id if the vocabulary allows, else 4; padded with the
end id), ``cu_seqlens`` (cumulative lengths of its segments), ``position_ids`` (4 bytes each, from
0 again at each segment), and where each segment comes from (doc_ids, offsets). Null and empty texts
have no tokens and no segment; repeated rows are packed each time; rows without id too. The key is a whole number; other columns take no part.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from pagestrata.llm.common import documents, map_batches, pieces

LENGTH, WINDOW = 2_048, 1_000_000


class Capacities:
    """Open rows by remaining capacity; the segment tree counts them, and ``fit`` finds the least capacity that suffices."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.tree = [0] * (2 * self.size)
        self.rows: dict[int, list[int]] = {}

    def add(self, capacity: int, row: int) -> None:
        self.rows.setdefault(capacity, []).append(row)
        self._count(capacity, 1)

    def _count(self, capacity: int, by: int) -> None:
        i = capacity + self.size
        while i:
            self.tree[i] += by
            i >>= 1

    def fit(self, need: int) -> tuple[int, int] | None:
        """Takes out (capacity, row) of the least capacity of at least ``need``."""
        tree, i = self.tree, need + self.size
        while not tree[i]:
            while i & 1:  # a right child: what lies to the right starts above
                i >>= 1
                if i <= 1:
                    return None
            i += 1
        while i < self.size:
            i *= 2
            if not tree[i]:
                i += 1
        capacity = i - self.size
        self._count(capacity, -1)
        return capacity, self.rows[capacity].pop()


def pack(lengths: list[int], length: int) -> list[list[int]]:
    """Rows of piece numbers by best fit decreasing; pieces are at most ``length`` long."""
    open_, rows = Capacities(length), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = open_.fit(lengths[i])
        capacity, row = found or (length, len(rows))
        if not found:
            rows.append([])
        rows[row].append(i)
        if capacity > lengths[i]:
            open_.add(capacity - lengths[i], row)
    return rows


class Tokens:
    """A byte-pair vocabulary from a ranks file."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.end = len(ranks)

    def ids(self, text: str) -> np.ndarray:
        return np.append(self.encoding.encode_to_numpy(text, disallowed_special=()), np.uint32(self.end)).astype(np.uint32)


_LOADED: dict[str, Tokens] = {}


def tokens_of(path: str | None) -> Tokens:
    """One for each worker process and vocabulary; by default byte_bpe_50k.tiktoken where the worker has it."""
    if str(path) not in _LOADED:
        import public_tokenizers

        _LOADED[str(path)] = Tokens(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return _LOADED[str(path)]


SCHEMA = "pack_id long, n_tokens int, input_ids binary, cu_seqlens array<int>, position_ids binary, doc_ids array<long>, offsets array<long>"
_FIELDS = pa.schema([("pack_id", pa.int64()), ("n_tokens", pa.int32()), ("input_ids", pa.binary()), ("cu_seqlens", pa.list_(pa.int32())), ("position_ids", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64()))])


def _rows(found: list[tuple[int, int, np.ndarray]], length: int, end: int, first: int) -> pa.RecordBatch:
    kind = np.uint16 if end < 1 << 16 else np.uint32
    out = []
    for row in pack([len(f[2]) for f in found], length):
        segments = [found[i] for i in row]
        ids = np.full(length, end, kind)
        ends = np.cumsum([len(s[2]) for s in segments])
        ids[: ends[-1]] = np.concatenate([s[2] for s in segments])
        positions = np.arange(length, dtype=np.int32)
        for a in ends[ends < length]:
            positions[a:] = np.arange(length - a, dtype=np.int32)
        out.append((first + len(out), int(ends[-1]), ids.tobytes(), [0, *ends.tolist()], positions.tobytes(), [s[0] for s in segments], [s[1] for s in segments]))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _FIELDS, strict=True)], schema=_FIELDS)


def pack_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, length: int = LENGTH, window: int = WINDOW) -> DataFrame:
    """The packed rows of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokens = tokens_of(vocabulary)
        serial = TaskContext.get().partitionId() << 32
        found: list[tuple[int, int, np.ndarray]] = []
        held = 0
        for batch in batches:
            for part in pieces(batch, text, 4 << 20):
                for doc, body in zip(part.column(key).to_pylist(), part.column(text), strict=True):
                    if not (body := body.as_py()):
                        continue
                    ids = tokens.ids(body)
                    found += [(doc, a, ids[a : a + length]) for a in range(0, len(ids), length)]
                    held += len(ids)
                    if held >= window:
                        out = _rows(found, length, tokens.end, serial)
                        serial += out.num_rows
                        yield from _cut(out)
                        found, held = [], 0
        if found:
            yield from _cut(_rows(found, length, tokens.end, serial))

    return map_batches(docs.select(key, text), run, SCHEMA)


def _cut(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    for a in range(0, batch.num_rows, rows):
        yield batch.slice(a, rows)


def op9_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_tokens(documents(spark, sf_dir))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: the packed rows."""
    return pack_tokens(docs)


QUERIES = {"op9_token_packing": op9_token_packing}
SQL: dict[str, str] = {}
