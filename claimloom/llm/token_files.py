"""Token ids in files of canonical, length-limited Huffman codes.

Code lengths come from the counts of all ids in the whole input (package-merge keeps them
within ``LIMIT`` bits), codes from the lengths alone (canonical order), so the code book
is the list of lengths. A file holds blocks that are decoded on their own:

    file   = magic, code book, block, block, ...
    block  = header, doc ids, null marks, token counts, checkpoint bits, bit stream

A checkpoint gives the bit offset of every ``STRIDE``-th id of a block. Decoding looks up
``LIMIT`` bits in a table for the id and its length, and goes from all checkpoints of a
block at once, so a step is an array operation. The directory (file, position, counts of
each block) is a Parquet table.

Files are written under a name of the attempt and then renamed; the directory names the
files of those tasks that Spark committed, so a lost executor leaves no half file behind
that anything reads.

Defined results: documents are in ascending order of ``doc_id`` (nulls first; equal ids
by token count, then by content); null and empty texts are one end id; repeated rows are
documents of their own; extra columns take no part; no rows give a directory without rows.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch, stored
from .files import filesystem
from .packing import with_end
from .textblocks import binary_array, slices
from .tokens import public_path, tokenizer

MAGIC = b"CLHF\x01\n"
#: Longest code in bits; a table of 2^LIMIT entries decodes.
LIMIT = 20
#: Ids between two checkpoints.
STRIDE = 64
#: Ids of a block, and of a file (one file for each range of documents).
BLOCK_IDS, FILE_IDS = 1 << 20, 1 << 23
_HEAD = struct.Struct("<IQQ")  # documents, ids, bits
DIRECTORY = "part int, block int, file string, position long, size long, n_docs long, n_ids long"


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Bits of each id's code by package-merge; 0 for ids that do not occur."""
    out = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError("more ids than codes of this length")
    used = used[np.argsort(counts[used], kind="stable")]
    weight = counts[used].astype(np.float64)
    level, leaves = weight, [np.ones(len(used), bool)]
    for _ in range(limit - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate((weight, pairs))
        order = np.argsort(both, kind="stable")
        level = both[order]
        leaves.append(order < len(weight))
    take, bits = 2 * len(used) - 2, np.zeros(len(used), np.int64)
    for leaf in reversed(leaves):
        own = int(leaf[:take].sum())
        bits[:own] += 1
        take = 2 * (take - own)
    out[used] = bits
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length and id."""
    codes = np.zeros(len(lengths), np.uint64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    code, last = 0, 0
    sizes = lengths[order].tolist()
    values = []
    for size in sizes:
        code <<= size - last
        values.append(code)
        code, last = code + 1, size
    codes[order] = np.array(values, np.uint64)
    return codes


def write_bits(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, int, np.ndarray]:
    """The bit stream of ids, its bits, and the bit offset of every STRIDE-th id."""
    size = lengths[ids].astype(np.int64)
    end = np.cumsum(size)
    total = int(end[-1]) if len(end) else 0
    at = end - size
    words = np.zeros(total // 64 + 2, np.uint64)
    if total:
        word, room = at >> 6, 64 - (at & 63) - size
        value = codes[ids]
        over = room < 0
        head = np.where(over, value >> np.maximum(-room, 0).astype(np.uint64), value << np.maximum(room, 0).astype(np.uint64))
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        words[word[first]] = np.bitwise_or.reduceat(head, first)
        words[word[over] + 1] |= value[over] << (64 + room[over]).astype(np.uint64)
    return words[: (total + 63) // 64].astype(">u8").tobytes(), total, at[::STRIDE]


class Decoder:
    def __init__(self, lengths: np.ndarray, limit: int = LIMIT):
        self.limit = limit
        codes = canonical_codes(lengths)
        self.id, self.bits = np.zeros(1 << limit, np.uint32), np.zeros(1 << limit, np.uint8)
        order = np.lexsort((np.arange(len(lengths)), lengths))
        order = order[lengths[order] > 0]
        span = (1 << (limit - lengths[order].astype(np.int64))).astype(np.int64)
        filled = int(span.sum())
        self.id[:filled] = np.repeat(order, span)  # canonical codes fill the table from its start
        self.bits[:filled] = np.repeat(lengths[order], span)
        assert not len(order) or int(codes[order[0]]) == 0

    def read(self, stream: bytes, n: int, checkpoints: np.ndarray) -> np.ndarray:
        """n ids; all checkpoints go forward together."""
        words = np.concatenate((np.frombuffer(stream, ">u8").astype(np.uint64), np.zeros(2, np.uint64)))
        out = np.zeros((len(checkpoints), STRIDE), np.uint32)
        at = checkpoints.astype(np.int64).copy()
        left, last = np.uint64(64 - self.limit), len(words) - 2
        for k in range(min(STRIDE, n)):
            if (len(checkpoints) - 1) * STRIDE + k >= n:  # the last run is over
                at = at[: len(checkpoints) - 1]
            word, bit = np.minimum(at >> 6, last), (at & 63).astype(np.uint64)
            # a shift by 64 is split in two, as it is not defined
            seen = (words[word] << bit) | ((words[word + 1] >> np.uint64(1)) >> (np.uint64(63) - bit))
            key = (seen >> left).astype(np.int64)
            out[: len(at), k] = self.id[key]
            at += self.bits[key]
        return out.reshape(-1)[:n]


def pack_block(doc_ids: np.ndarray, null: np.ndarray, n_ids: np.ndarray, ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> bytes:
    stream, bits, marks = write_bits(ids, codes, lengths)
    steps = np.diff(marks, prepend=0).astype("<u2")
    return b"".join((_HEAD.pack(len(doc_ids), len(ids), bits), doc_ids.astype("<i8").tobytes(), null.astype("u1").tobytes(), n_ids.astype("<i8").tobytes(), steps.tobytes(), stream))


def read_block(data: bytes, decoder: Decoder) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Doc ids, null marks, ids of each document, and all ids."""
    n_docs, n, bits = _HEAD.unpack_from(data)
    at = _HEAD.size
    doc_ids = np.frombuffer(data, "<i8", n_docs, at)
    null = np.frombuffer(data, "u1", n_docs, at + 8 * n_docs).astype(bool)
    at += 9 * n_docs
    n_ids = np.frombuffer(data, "<i8", n_docs, at)
    at += 8 * n_docs
    steps = np.frombuffer(data, "<u2", -(-n // STRIDE), at)
    at += 2 * len(steps)
    return doc_ids, null, n_ids, decoder.read(data[at : at + (bits + 63) // 64 * 8], n, np.cumsum(steps, dtype=np.int64))


def _encoded(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Ids of every document as bytes, and for each task a row of (id, count) pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(tokenizer_path)
        wide = np.dtype("<u2") if max(tok.vocab, end_id + 1) <= 1 << 16 else np.dtype("<u4")
        seen = np.zeros(max(tok.vocab, end_id + 1), np.int64)
        names = ["doc_id", "n_ids", "ids", "counts"]
        for batch in batches:
            for s in slices(batch):
                e = tok.encode(s.column(1))
                ids, to = with_end(e.ids, e.offsets, end_id)
                seen += np.bincount(ids, minlength=len(seen))
                packed = binary_array(ids.astype(wide).view(np.uint8), to * wide.itemsize)
                yield pa.RecordBatch.from_arrays([s.column(0), pa.array(np.diff(to)), packed, pa.nulls(s.num_rows, pa.binary())], names)
        tok.done()
        used = np.flatnonzero(seen)
        pairs = np.stack((used, seen[used]), axis=1).astype("<i8").tobytes()
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([0], pa.int64()), pa.nulls(1, pa.binary()), pa.array([pairs], pa.binary())], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_ids long, ids binary, counts binary")


def _counts(encoded: DataFrame) -> np.ndarray:
    """Occurrences of each id in the whole input; as long as the vocabulary at most."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [np.frombuffer(x, "<i8").reshape(-1, 2) for x in batch.column(0).to_pylist()]
            both = np.concatenate(both) if both else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["id", "n"])

    rows = encoded.where("counts is not null").select("counts").mapInArrow(pairs, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(max(rows["id"].to_pylist(), default=0) + 1, np.int64)
    out[np.asarray(rows["id"], np.int64)] = np.asarray(rows["n"], np.int64)
    return out


def write(docs: DataFrame, tokenizer_path: str | None = None, end_id: int = 1, folder: str | None = None) -> DataFrame:
    """Write the files; the directory of their blocks, as a stored table."""
    spark = docs.sparkSession
    folder = folder or scratch(spark, "token-files")
    encoded = stored(_encoded(docs, tokenizer_path or public_path(), end_id), "ids", compression="zstd")
    counts = _counts(encoded)
    lengths = code_lengths(counts)
    codes = canonical_codes(lengths)
    total = int(counts.sum())
    book = zlib.compress(lengths.tobytes())
    wide = spark.sparkContext.broadcast((codes, lengths))  # as long as the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, lengths = wide.value
        part, name, out = TaskContext.get().partitionId(), "", None
        fs, root = filesystem(folder)
        rows: list[tuple] = []
        held: list[tuple] = []
        n_held = 0

        def flush() -> None:
            nonlocal out, name, n_held
            if not held:
                return
            if out is None:
                fs.create_dir(root, recursive=True)
                name = f"{root}/part-{part:06d}-{uuid.uuid4().hex}.huf"
                out = fs.open_output_stream(name + ".tmp")
                out.write(MAGIC + struct.pack("<I", len(book)) + book)
            ids = np.concatenate([x for _, _, x in held])
            doc_ids = np.array([d or 0 for d, _, _ in held], np.int64)
            null = np.array([d is None for d, _, _ in held], bool)
            data = pack_block(doc_ids, null, np.array([n for _, n, _ in held], np.int64), ids, codes, lengths)
            rows.append((part, len(rows), name, out.tell(), len(data), len(held), len(ids)))
            out.write(data)
            held.clear()
            n_held = 0

        for batch in batches:
            for d, n, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                buf = x.as_buffer()
                held.append((d, n, np.frombuffer(buf, "<u2" if buf.size == 2 * n else "<u4")))
                n_held += n
                if n_held >= BLOCK_IDS:
                    flush()
        flush()
        if out is not None:
            out.close()
            fs.move(name + ".tmp", name)
        cols = list(zip(*rows, strict=True)) or [()] * 7
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [f.split()[0] for f in DIRECTORY.split(", ")])

    parts = max(1, -(-total // FILE_IDS))
    order = ["doc_id", "n_ids", F.xxhash64("ids")]
    ranged = encoded.where("ids is not null").select("doc_id", "n_ids", "ids").repartitionByRange(parts, *order)
    return stored(ranged.sortWithinPartitions(*order).mapInArrow(run, DIRECTORY), "directory")


@lru_cache(maxsize=1)
def _decoder(book: bytes) -> Decoder:
    return Decoder(np.frombuffer(zlib.decompress(book), np.uint8))


def read(spark: SparkSession, directory: DataFrame, value: str = "crc") -> DataFrame:
    """Documents from the files: doc_id, start, n_tokens, and ``ids_crc32`` or (value "ids") the ids.

    A block's start is the sum over earlier files and over earlier blocks of its file, so
    no task sees more than one row for each file or the blocks of one file.
    """
    files = directory.groupBy("part").agg(F.sum("n_ids").alias("in_file"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("part", F.coalesce(F.sum("in_file").over(before), F.lit(0)).alias("file_start"))
    within = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = directory.withColumn("block_start", F.coalesce(F.sum("n_ids").over(within), F.lit(0))).join(files, "part")
    blocks = blocks.select("file", "position", "size", (F.col("file_start") + F.col("block_start")).alias("start"))
    n = directory.count()
    tasks = max(1, min(n, max(2 * spark.sparkContext.defaultParallelism, n // 4)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, position, size, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, path = filesystem(file)
                with fs.open_input_file(path) as f:
                    head = f.read_at(len(MAGIC) + 4, 0)
                    if head[: len(MAGIC)] != MAGIC:
                        raise ValueError(f"{file} is no token file")
                    decoder = _decoder(f.read_at(struct.unpack_from("<I", head, len(MAGIC))[0], len(head)))
                    doc_ids, null, n_ids, ids = read_block(f.read_at(size, position), decoder)
                stop = np.cumsum(n_ids)
                if value == "ids":
                    last = binary_array(ids.astype("<u4").view(np.uint8), np.concatenate(([0], stop)) * 4)
                else:
                    view = memoryview(ids.astype("<u4")).cast("B")
                    last = pa.array([zlib.crc32(view[4 * (b - k) : 4 * b]) for b, k in zip(stop.tolist(), n_ids.tolist(), strict=True)], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, mask=null), pa.array(start + stop - n_ids), pa.array(n_ids), last], ["doc_id", "start", "n_tokens", "last"])

    kind = "binary" if value == "ids" else "long"
    out = blocks.repartition(tasks, "file", "position").mapInArrow(run, f"doc_id long, start long, n_tokens long, last {kind}")
    return out.withColumnRenamed("last", "ids" if value == "ids" else "ids_crc32")
