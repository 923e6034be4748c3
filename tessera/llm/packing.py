"""Operator 5: token ids packed into fixed rows, best fit decreasing, written as matrices.

A text becomes token ids without loss. Documents longer than a row are split into pieces; pieces are
packed, longest first, each into the row with the least free room that still holds it. A segment tree
over free room finds that row in logarithmic time. Packing runs shard by shard as tasks read their
partitions, so ids are never shuffled and a task holds one shard at most.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch

PACKED = "shard string, row int, input_ids array<int>, cu_seqlens array<int>, position_ids array<int>, doc_ids array<long>, pieces array<int>, n_tokens int"

BINARY = (
    "shard string, first_row int, n_rows int, row_size int, id_type string, input_ids binary, position_ids binary, cu_seqlens binary, segments array<int>, doc_ids array<long>, pieces array<int>"
)

#: Rows of a matrix that are one block, and bytes of blocks that are one row group: a task writes and reads a group at a time.
BLOCK_ROWS, GROUP_BYTES = 256, 16 << 20
#: Ids in a row of the matrix.
SIZE = 2048

_LOADED: dict = {}


def encoder(path: str, pattern: str):
    """A byte-level BPE from a file of ranks; special strings in a text are ordinary text."""
    if path not in _LOADED:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[path] = tiktoken.Encoding(path.rsplit("/", 1)[-1], pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


class RoomTree:
    """A segment tree over the capacities 0..size: how many open rows have that much free room.

    ``fit(n)`` finds the least capacity of at least n that some row has.
    """

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, room: int, by: int) -> None:
        at = room + self.leaves
        while at:
            self.count[at] += by
            at >>= 1

    def fit(self, n: int) -> int | None:
        at = n + self.leaves
        if self.count[at]:
            return n
        while at > 1:  # up until a right neighbour has rows, then down its left edge
            if not at & 1 and self.count[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return None


def best_fit_decreasing(lengths: np.ndarray, size: int) -> list[list[int]]:
    """Rows of piece numbers. Ties: the earlier piece first, the latest opened row of the fitting room."""
    tree, open_rows, rows = RoomTree(size), {}, []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        room = tree.fit(n)
        if room is None:
            row, room = len(rows), size
            rows.append([])
        else:
            row = open_rows[room].pop()
            tree.add(room, -1)
        rows[row].append(i)
        left = room - n
        if left:
            open_rows.setdefault(left, []).append(row)
            tree.add(left, 1)
    return rows


def _positions(size: int) -> str:
    return "<u4" if size > 1 << 16 else "<u2"


class Block:
    """Some rows of a shard's matrix: ids and positions (rows x size), each row's segment bounds, and what the segments are."""

    def __init__(self, shard: str, first: int, ids: np.ndarray, positions: np.ndarray, counts: np.ndarray, bounds: np.ndarray, docs: pa.Array, pieces: np.ndarray):
        self.shard, self.first, self.ids, self.positions, self.counts, self.bounds, self.docs, self.pieces = shard, first, ids, positions, counts, bounds, docs, pieces

    def rows(self) -> pa.RecordBatch:
        """As PACKED: a result row for each row of the matrix."""
        n, size = self.ids.shape
        ends, full = np.concatenate([[0], np.cumsum(self.counts)]), np.arange(n + 1) * size
        lists = lambda values, at: pa.ListArray.from_arrays(pa.array(at, pa.int32()), values if isinstance(values, pa.Array) else pa.array(values, pa.int32()))
        columns = {
            "shard": pa.array([self.shard] * n),
            "row": pa.array(np.arange(self.first, self.first + n), pa.int32()),
            "input_ids": lists(self.ids.astype(np.int32).ravel(), full),
            "cu_seqlens": lists(self.bounds, ends + np.arange(n + 1)),
            "position_ids": lists(self.positions.astype(np.int32).ravel(), full),
            "doc_ids": lists(self.docs, ends),
            "pieces": lists(self.pieces, ends),
            "n_tokens": pa.array(self.bounds[np.cumsum(self.counts + 1) - 1], pa.int32()),
        }
        return pa.RecordBatch.from_pydict(columns)

    def binary(self, id_type: str) -> pa.RecordBatch:
        """As BINARY: the matrices as they are in memory, little-endian."""
        n, size = self.ids.shape
        if self.ids.size and int(self.ids.max()) > np.iinfo(id_type).max:
            raise ValueError(f"an id does not fit {id_type}")
        lists = lambda values, kind: pa.array([values], pa.list_(kind))
        columns = {
            "shard": pa.array([self.shard]),
            "first_row": pa.array([self.first], pa.int32()),
            "n_rows": pa.array([n], pa.int32()),
            "row_size": pa.array([size], pa.int32()),
            "id_type": pa.array([id_type]),
            "input_ids": pa.array([self.ids.astype(id_type).tobytes()]),
            "position_ids": pa.array([self.positions.astype(_positions(size)).tobytes()]),
            "cu_seqlens": pa.array([self.bounds.astype("<u4").tobytes()]),
            "segments": lists(self.counts, pa.int32()),
            "doc_ids": pa.ListArray.from_arrays(pa.array([0, len(self.docs)], pa.int32()), self.docs),
            "pieces": lists(self.pieces, pa.int32()),
        }
        return pa.RecordBatch.from_pydict(columns)


def _from_binary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(len(batch)):
            r = {n: batch.column(n)[i] for n in batch.schema.names}
            n, size = r["n_rows"].as_py(), r["row_size"].as_py()
            matrix = lambda name, kind, n=n, size=size, r=r: np.frombuffer(r[name].as_buffer(), kind).reshape(n, size)
            ids, positions = matrix("input_ids", r["id_type"].as_py()), matrix("position_ids", _positions(size))
            counts, pieces = (r[c].values.to_numpy(zero_copy_only=False) for c in ("segments", "pieces"))
            yield Block(r["shard"].as_py(), r["first_row"].as_py(), ids, positions, counts, np.frombuffer(r["cu_seqlens"].as_buffer(), "<u4").astype(np.int32), r["doc_ids"].values, pieces).rows()


def pack_shard(shard: str, pieces: list[tuple[int | None, int, np.ndarray]], size: int, pad: int, rows: int = BLOCK_ROWS) -> Iterator[Block]:
    """The shard's matrix, ``rows`` of it at a time. pieces: document, number of the piece in it, ids."""
    packed = best_fit_decreasing(np.array([len(p[2]) for p in pieces]), size)
    for first in range(0, len(packed), rows):
        part = packed[first : first + rows]
        ids, positions = np.full((len(part), size), pad, np.int64 if pad > 2**31 else np.int32), np.zeros((len(part), size), np.int32)
        bounds, used = [], []
        for at, members in enumerate(part):
            end = 0
            bounds.append(0)
            for i in members:
                x = pieces[i][2]
                ids[at, end : end + len(x)] = x
                positions[at, end : end + len(x)] = np.arange(len(x))
                end += len(x)
                bounds.append(end)
                used.append(pieces[i])
        yield Block(shard, first, ids, positions, np.array([len(m) for m in part]), np.array(bounds, np.int32), pa.array([p[0] for p in used], pa.int64()), np.array([p[1] for p in used], np.int32))


def _packer(path: str, pattern: str, id_col: str, text_col: str, size: int, pad: int, shard_tokens: int, id_type: str | None):
    shape = (lambda b: b.binary(id_type)) if id_type else (lambda b: b.rows())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, held, waiting = TaskContext.get().partitionId(), 0, 0, []
        encode = encoder(path, pattern).encode_to_numpy
        for batch in batches:
            for doc, text in zip(batch.column(id_col).to_pylist(), batch.column(text_col), strict=True):
                text = text.as_py()
                ids = encode(text, disallowed_special=()) if text else ()
                for k in range(0, len(ids), size):
                    waiting.append((doc, k // size, ids[k : k + size]))
                    held += min(size, len(ids) - k)
                    if held >= shard_tokens:
                        yield from map(shape, pack_shard(f"{task}-{made}", waiting, size, pad))
                        made, held, waiting = made + 1, 0, []
        if waiting:
            yield from map(shape, pack_shard(f"{task}-{made}", waiting, size, pad))

    return run


def pack(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = SIZE,
    pad: int = 50256,
    shard_tokens: int = 4_000_000,
    id_type: str | None = None,
) -> DataFrame:
    """One row of the id matrix per result row; with ``id_type`` blocks of raw matrices, as ``write_matrices`` says.

    ``input_ids`` has ``size`` ids, the end padded; ``cu_seqlens`` the segments' bounds from 0 to n_tokens;
    ``position_ids`` count from 0 again in each segment; ``doc_ids`` and ``pieces`` say what each segment
    is. Piece k of a document holds its ids from k * size on, so joining pieces in order gives the text
    back. Null and empty texts have no ids and stand in no row; a null id stays null; repeated rows are
    packed as often as they stand; other columns are left out; an empty table gives no rows. Rows of a shard
    depend on how the input is split over tasks; their content as a whole does not.
    """
    packer = _packer(ranks_path, pattern, id_col, text_col, size, pad, shard_tokens, id_type)
    return docs.select(F.col(id_col).cast("long").alias(id_col), text_col).mapInArrow(packer, BINARY if id_type else PACKED)


def write_matrices(docs: DataFrame, path: str, ranks_path: str, pattern: str, *, id_type: str = "<u4", **options) -> None:
    """Packs ``docs`` and writes the matrices as raw little-endian blocks of 256 rows, one block in a row of Parquet.

    A block holds the ids (``id_type``: <u2 for vocabularies of up to 65,536), the position of every id in its
    segment, each matrix row's cumulative segment lengths from 0 on, and which document and piece each segment is.
    Spark's commit makes the files appear whole or not at all. An empty table gives a table without blocks.
    Row groups hold ``GROUP_BYTES`` of matrices, or one block, so that tasks take no more memory where they write or read more.
    """
    size = options.get("size", SIZE)
    block = BLOCK_ROWS * size * (np.dtype(id_type).itemsize + np.dtype(_positions(size)).itemsize)
    # the writer looks at the sizes after each block: by default after 100, which are hundreds of MB
    bounds = {"parquet.block.row.count.limit": max(1, GROUP_BYTES // block), "parquet.page.row.count.limit": 1, "parquet.page.size.row.check.min": 1, "parquet.block.size.row.check.min": 1}
    pack(docs, ranks_path, pattern, id_type=id_type, **options).write.mode("overwrite").options(**bounds).option("compression", "zstd").parquet(path)


def read_matrices(spark, path: str) -> DataFrame:
    """The rows of written matrices, as ``pack`` gives them."""
    return spark.read.schema(BINARY).parquet(path).mapInArrow(_from_binary, PACKED)


def _tokenizer() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op5_query(spark, sf_dir: str) -> DataFrame:
    """The matrices as written to the shared folder, read back."""
    path = Scratch(spark, "packing").path("matrices")
    write_matrices(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), path, *_tokenizer(), id_type="<u2")
    return read_matrices(spark, path)


def pack_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The matrix rows of all documents, as ``pack`` states: null and empty texts stand in no row, a null id stays null.

    Repeated rows are packed each, other columns are left out, an empty table gives no rows.
    """
    return pack(docs.select("doc_id", "text"), *_tokenizer())
