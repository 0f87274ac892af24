"""Benchmark decontamination with a positional inverted index of the training text.

``build_index`` cuts the corpus into segments of about ``SEGMENT_BYTES`` of text. A segment
is one stored row: its documents with the position of their first word, its terms with the
bounds of their posting lists, and the lists themselves (ascending positions as
differences, compressed). Between two documents a position stays free, so no phrase
reaches from one into the next. Documents are never split over segments: nothing is
shuffled by term, and a term or passage that a third of the rows share only lengthens the
lists of each segment.

``Phrases`` are compiled test windows. In a segment those with an absent term drop out at
once; for the rest, the lists are intersected from the rarest term on, each less its
offset in the phrase. Tasks compile the test text into blocks of about ``BLOCK_BYTES`` (a longer item is a
block), each a file in the shared folder. A task takes ``HELD`` segments at a time and holds one block of
phrases at a time against them, so neither memory nor a broadcast grows with the test set.

Words are runs of digits, letters a-z (A-Z lowered) and characters beyond ASCII.

Defined results: a null or empty text has no words and is a row without hits; repeated rows
are reported each; a null ``doc_id`` is kept; items without words match nothing; items
of one id are one item; an item without an id marks words but is not listed; extra
columns take no part; with no items all rows are clean.
"""

from __future__ import annotations

import hashlib
import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch, stored
from .files import filesystem
from .textblocks import flat, ragged, slices

SEGMENT_BYTES = 3 << 20
BLOCK_BYTES = 2 << 20
HELD = 8
#: A table of at most so many bytes may be broadcast.
BROADCAST_BYTES = 32 << 20
INDEX = "docs binary, terms binary, postings binary"
REPORT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, key binary"
MATCHES = "doc_id long, item_id long, start long, length long"

_FOLD = bytearray(range(256))
_FOLD[ord("A") : ord("Z") + 1] = range(ord("a"), ord("z") + 1)
_IS_WORD = bytearray(256)
for _b in (*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)):
    _IS_WORD[_b] = 1


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of all texts in a row, and how many each text has."""
    raw, bounds = flat(texts)
    if not len(raw):
        return pa.array([], pa.large_binary()), np.zeros(len(bounds) - 1, np.int64)
    low = raw.tobytes().translate(bytes(_FOLD))
    inside = np.frombuffer(low.translate(bytes(_IS_WORD)), bool)
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    starts_text = bounds[:-1][np.diff(bounds) > 0]
    begin[starts_text] = inside[starts_text]
    at = np.flatnonzero(begin)
    packed = np.frombuffer(low, np.uint8)[inside]
    count = np.cumsum(inside, dtype=np.int32 if len(raw) < 2**31 else np.int64)
    offsets = np.append(count[at] - 1, len(packed)).astype(np.int64)
    found = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(packed)])
    return found, np.diff(np.searchsorted(at, bounds, side="left"))


def _sealed(**columns: pa.Array) -> bytes:
    batch = pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _opened(data: bytes) -> pa.RecordBatch:
    return next(iter(pa.ipc.open_stream(data)))


def build_index(docs: DataFrame) -> DataFrame:
    """The stored index of all words of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch, step=SEGMENT_BYTES):
                found, n = words_of(s.column(1))
                base = np.cumsum(n + 1) - n - 1
                d = found.dictionary_encode()
                code = np.asarray(d.indices)
                position = np.arange(len(code)) + np.repeat(np.arange(len(n)), n)
                order = np.argsort(code, kind="stable")
                count = np.bincount(code, minlength=len(d.dictionary))
                begin = np.cumsum(count) - count
                listed = position[order]
                steps = np.diff(listed, prepend=0)
                steps[begin] = listed[begin]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([_sealed(doc_id=s.column(0), base=pa.array(base), n=pa.array(n), key=s.column(2))], pa.binary()),
                        pa.array([_sealed(term=d.dictionary, count=pa.array(count))], pa.binary()),
                        pa.array([_sealed(step=pa.array(steps.astype(np.uint32)))], pa.binary()),
                    ],
                    ["docs", "terms", "postings"],
                )

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), text_key(text).alias("key"))
    return stored(rows.mapInArrow(run, INDEX), "postings", **{"parquet.block.size": str(16 << 20), "compression": "none"})


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


class Segment:
    """One row of the index, with the lists of the terms asked for."""

    def __init__(self, docs: bytes, terms: bytes, postings: bytes):
        docs_, terms_ = _opened(docs), _opened(terms)
        self.doc_id, self.key = docs_.column(0), docs_.column(3)
        self.base, self.n = np.asarray(docs_.column(1)), np.asarray(docs_.column(2))
        self.term, self.count = terms_.column(0), np.asarray(terms_.column(1))
        self.begin = np.cumsum(self.count) - self.count
        self._postings, self._steps = postings, None

    def find(self, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """For each term of ``vocabulary`` its place here (-1: absent) and its count."""
        hit = pc.index_in(self.term, value_set=vocabulary)
        here = np.flatnonzero(np.asarray(hit.is_valid()))
        place = np.full(len(vocabulary), -1, np.int64)
        place[np.asarray(hit.drop_null(), np.int64)] = here
        return place, np.where(place >= 0, self.count[place] if len(self.count) else 0, 0)

    def postings(self, place: int) -> np.ndarray:
        if self._steps is None:
            self._steps = np.asarray(_opened(self._postings).column(0))
        a = self.begin[place]
        return np.cumsum(self._steps[a : a + self.count[place]], dtype=np.int64)

    def doc_of(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.base, position, side="right") - 1


def _among(values: np.ndarray, sorted_list: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(sorted_list, values), len(sorted_list) - 1)
    return sorted_list[at] == values


class Phrases:
    """Distinct test windows over a vocabulary, and the items that each belongs to.

    For each length: the windows as rows of term numbers, and the items of window i as
    places ``begin[i]`` to ``begin[i + 1]`` of a list.
    """

    def __init__(self, item_ids: list[int | None], texts: pa.Array, window: int):
        found, n = words_of(texts)
        d = found.dictionary_encode()
        code, begin = np.asarray(d.indices).astype(np.int32), np.cumsum(n) - n
        self.vocabulary = d.dictionary
        self.items = sorted(set(item_ids), key=lambda i: (i is None, i))
        rank = {x: i for i, x in enumerate(self.items)}
        of = np.array([rank[x] for x in item_ids], np.int64)
        length = np.minimum(n, window)
        self.phrases = []
        for size in np.unique(length[length > 0]).tolist():
            mine = np.flatnonzero(length == size)
            count = n[mine] - size + 1
            rows = code[ragged(begin[mine], count)[:, None] + np.arange(size)]
            owner = np.repeat(of[mine], count)
            _, first, which = np.unique(rows.view(np.dtype((np.void, 4 * size))).reshape(-1), return_index=True, return_inverse=True)
            pairs = np.unique(which.reshape(-1).astype(np.int64) * len(self.items) + owner)
            bounds = np.searchsorted(pairs // len(self.items), np.arange(len(first) + 1))
            self.phrases.append((rows[first], bounds, pairs % len(self.items)))

    def _owners(self, bounds: np.ndarray, owner: np.ndarray, row: int) -> list[int | None]:
        return [self.items[i] for i in owner[bounds[row] : bounds[row + 1]].tolist()]

    def search(self, segment: Segment) -> Iterator[tuple[int, list, np.ndarray]]:
        """Length, items and start positions of each window that occurs."""
        place, count = segment.find(self.vocabulary)
        lists: dict[int, np.ndarray] = {}

        def posted(term: int) -> np.ndarray:
            if term not in lists:
                lists[term] = segment.postings(place[term])
            return lists[term]

        for codes, bounds, owner in self.phrases:
            seen = count[codes]
            alive = np.flatnonzero(seen.min(axis=1) > 0)
            order = np.argsort(seen[alive], axis=1, kind="stable")
            for row, by_count in zip(alive.tolist(), order.tolist(), strict=True):
                terms = codes[row]
                starts = posted(int(terms[by_count[0]])) - by_count[0]
                for k in by_count[1:]:
                    starts = starts[_among(starts + k, posted(int(terms[k])))]
                    if not len(starts):
                        break
                if len(starts):
                    yield len(terms), self._owners(bounds, owner, row), starts

    def near(self, segment: Segment, within: int) -> Iterator[tuple[int, list, np.ndarray]]:
        """As ``search``, for runs of ``within`` words that hold all terms in any order.

        A run starts at one of the terms; every such run is given.
        """
        place, count = segment.find(self.vocabulary)
        for codes, bounds, owner in self.phrases:
            for row in np.flatnonzero(count[codes].min(axis=1) > 0).tolist():
                distinct = np.unique(codes[row])
                lists = sorted((segment.postings(place[t]) for t in distinct), key=len)
                starts = np.unique(np.concatenate(lists))
                for own in lists:
                    at = np.searchsorted(own, starts)
                    ok = at < len(own)
                    ok[ok] = own[at[ok]] < starts[ok] + within
                    starts = starts[ok]
                    if not len(starts):
                        break
                if len(starts):
                    doc = segment.doc_of(starts)
                    last = starts.copy()
                    for own in lists:
                        last = np.maximum(last, own[np.searchsorted(own, starts)])
                    starts = starts[last < segment.base[doc] + segment.n[doc]]
                if len(starts):
                    yield within, self._owners(bounds, owner, row), starts


def compiled(items: DataFrame, window: int) -> list[str]:
    """Files of the test windows, a block each."""
    spark = items.sparkSession
    folder = scratch(spark, "phrases")
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        held, n, names = [], 0, []

        def flush() -> None:
            fs.create_dir(root, recursive=True)
            names.append(f"{root}/{uuid.uuid4().hex}.phrases")
            block = pa.Table.from_batches(held).combine_chunks()
            with fs.open_output_stream(names[-1], compression=None) as out:
                out.write(pickle.dumps(Phrases(block["item_id"].to_pylist(), block["text"].combine_chunks(), window), protocol=5))

        for batch in batches:
            for s in slices(batch, step=BLOCK_BYTES):
                held.append(s)
                n += s.nbytes
                if n >= BLOCK_BYTES:
                    flush()
                    held, n = [], 0
        if held:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], ["name"])

    spread = rows.repartition(max(1, size // BLOCK_BYTES), F.xxhash64("item_id", "text"))
    return [r["name"] for r in stored(spread.mapInArrow(run, "name string"), "phrase-files").collect()]  # one for each block


def against(names: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[Segment], Iterator[Phrases]]]:
    """Segments, ``HELD`` at a time, each time with all blocks, one after the other."""
    kept: list[Phrases] = []  # a single block is read once

    def blocks() -> Iterator[Phrases]:
        if kept:
            yield kept[0]
            return
        for name in names:
            fs, path = filesystem(name)
            with fs.open_input_file(path) as f:
                block = pickle.loads(f.read())
            if len(names) == 1:
                kept.append(block)
            yield block

    held: list[Segment] = []
    for batch in batches:
        for row in zip(*batch.columns, strict=True):
            held.append(Segment(*(x.as_py() for x in row)))
            if len(held) == HELD:
                yield held, blocks()
                held = []
    if held:
        yield held, blocks()


def matches(index: DataFrame, items: DataFrame, window: int = 10, within: int | None = None) -> DataFrame:
    """Where the windows of ``items`` occur: doc_id, item_id, start (in words), length.

    With ``within`` a match is a run of so many words that holds all words of the window in
    any order (proximity); its start is one of them.
    """
    names = compiled(items, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for segments, blocks in against(names, batches):
            for block in blocks:
                for seg in segments:
                    for length, owners, starts in block.near(seg, within) if within else block.search(seg):
                        doc = seg.doc_of(starts)
                        for item in owners:
                            yield pa.RecordBatch.from_arrays(
                                [seg.doc_id.take(pa.array(doc)), pa.array([item] * len(doc), pa.int64()), pa.array(starts - seg.base[doc]), pa.array(np.full(len(doc), length, np.int64))],
                                ["doc_id", "item_id", "start", "length"],
                            )

    return index.mapInArrow(run, MATCHES)


def report(index: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """One row for each document: its words, those inside any occurrence, and the items."""
    return _report(index, items, window).drop("key")


def keep_clean(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """The documents that no window of the items occurs in, with all their columns."""
    found = _report(build_index(docs), items, window).where("contaminated").select(F.col("doc_id").alias("found_id"), F.col("key").alias("found_key")).distinct()
    found = stored(found, "contaminated")
    if found.count() * 48 <= BROADCAST_BYTES:  # else a sort-merge join
        found = F.broadcast(found)
    same = (text_key(docs["text"].cast("string")) == found["found_key"]) & docs["doc_id"].cast("long").eqNullSafe(found["found_id"])
    return docs.join(found, same, "left_anti")


def _report(index: DataFrame, items: DataFrame, window: int) -> DataFrame:
    names = compiled(items, window)
    clean = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for segments, blocks in against(names, batches):
            edges = [np.zeros(int(seg.base[-1] + seg.n[-1]) + 2, np.int64) for seg in segments]
            items_of: list[dict[int, set]] = [{} for _ in segments]
            for block in blocks:
                for seg, edge, own in zip(segments, edges, items_of, strict=True):
                    for length, owners, starts in block.search(seg):
                        np.add.at(edge, starts, 1)
                        np.add.at(edge, starts + length, -1)
                        for doc in np.unique(seg.doc_of(starts)).tolist():
                            own.setdefault(doc, set()).update(owners)
            for seg, edge, own in zip(segments, edges, items_of, strict=True):
                upto = np.concatenate(([0], np.cumsum(np.cumsum(edge) > 0)))
                hit = upto[seg.base + seg.n] - upto[seg.base]
                digest, count = [clean] * len(hit), np.zeros(len(hit), np.int64)
                for doc, ids in own.items():
                    named = sorted(str(i) for i in ids if i is not None)
                    digest[doc], count[doc] = hashlib.sha256(",".join(named).encode()).hexdigest(), len(named)
                yield pa.RecordBatch.from_arrays(
                    [seg.doc_id, pa.array(seg.n), pa.array(hit), pa.array(count), pa.array(digest), pa.array(hit > 0), seg.key],
                    [f.split()[0] for f in REPORT.split(", ")],
                )

    return index.mapInArrow(run, REPORT)
