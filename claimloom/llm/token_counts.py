"""Token counts of fields and sections by character offsets.

Each document is encoded whole and once; a token keeps the character span that it stands
for. Sections are character intervals of a document and may overlap (a line lies in a
field). Tokens meet sections in a sorted interval join: two binary searches for each
section over the spans of its document. A token that lies partly outside a section is
allocated by ``rule``:

* ``start``: it counts for the sections that hold its first character;
* ``majority``: for those that hold over half of its characters, or half with the first;
* ``share``: each section gets the fraction of its characters that lies there.

Defined results: null and empty texts have no tokens, and their sections count 0; a null
``doc_id`` is kept; repeated rows are counted each on its own; sections beyond the text
are cut to it; extra columns of the input take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textblocks import flat, slices
from .tokens import public_path, tokenizer

RULES = ("start", "majority", "share")
SCHEMA = "doc_id long, kind string, section int, begin long, end long, n_tokens double, n_crossing long"


def allocate(begin: np.ndarray, end: np.ndarray, low: np.ndarray, high: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section [low, high) and how many of them cross its bounds.

    ``begin`` and ``end`` are sorted; all are positions on one axis.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    if not len(begin):
        return np.zeros(len(low)), np.zeros(len(low), np.int64)
    high = np.maximum(high, low)
    a = np.searchsorted(end, low, side="right")  # the first token that ends behind low
    b = np.searchsorted(begin, high, side="left")  # the first that begins at high or later
    by_start = b - np.searchsorted(begin, low, side="left")
    touched = np.maximum(b - a, 0)
    some = (touched > 0) & (high > low)
    touched = np.where(some, touched, 0)
    first, last = np.clip(a, 0, len(begin) - 1), np.clip(b - 1, 0, len(begin) - 1)
    cut_low = some & (begin[first] < low)
    cut_high = some & (end[last] > high)
    both = cut_low & cut_high & (first == last)
    crossing = cut_low.astype(np.int64) + cut_high - both
    if rule == "start":
        return np.where(high > low, by_start, 0).astype(float), crossing
    inside = (touched - crossing).astype(float)

    def part(i: np.ndarray, on: np.ndarray) -> np.ndarray:
        width = np.maximum(end[i] - begin[i], 1)
        held = np.minimum(end[i], high) - np.maximum(begin[i], low)
        if rule == "share":
            return np.where(on, held / width, 0.0)
        return np.where(on & ((2 * held > width) | ((2 * held == width) & (begin[i] >= low))), 1.0, 0.0)

    return inside + part(first, cut_low) + part(last, cut_high & ~both), crossing


def _line_bounds(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, begin and end (characters on one axis) of each line with its end mark."""
    char = np.cumsum((raw & 0xC0) != 0x80, dtype=np.int64)  # characters up to and with each byte
    at = np.flatnonzero(raw == 10) + 1
    full = np.flatnonzero(np.diff(bounds) > 0)
    starts = np.union1d(bounds[full], at[at < len(raw)]) if len(raw) else np.zeros(0, np.int64)
    doc = full[np.searchsorted(bounds[full], starts, side="right") - 1] if len(full) else starts
    stops = np.append(starts[1:], len(raw)) if len(starts) else starts
    upto = np.concatenate(([0], char))
    return doc, upto[starts], upto[stops]


def token_counts(docs: DataFrame, tokenizer_path: str | None = None, sections: DataFrame | None = None, rule: str = "start", lead_chars: int = 200) -> DataFrame:
    """Tokens of each section.

    ``sections`` (doc_id, kind, section, begin, end): the intervals, end excluded; they
    are gathered by document, so a document's own sections must fit in a row. Without it, the
    sections of a document are its lines (with their line ends), its ``lead`` (the first
    ``lead_chars`` characters) and the ``rest``; empty texts have lead and rest only.
    """
    path = tokenizer_path or public_path()
    given = sections is not None
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if given:
        gathered = sections.groupBy(F.col("doc_id").cast("long").alias("sec_doc")).agg(
            F.sort_array(F.collect_list(F.struct(F.col("kind").cast("string"), F.col("section").cast("int"), F.col("begin").cast("long"), F.col("end").cast("long")))).alias("secs")
        )
        rows = rows.join(gathered, rows.doc_id == gathered.sec_doc, "inner").select("doc_id", "text", "secs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        for batch in batches:
            for s in slices(batch):
                ids = s.column(0)
                e = tok.encode(s.column(1), spans=True)
                raw, bounds = flat(s.column(1))
                n_chars = np.asarray(pc.fill_null(pc.utf8_length(s.column(1)), 0), dtype=np.int64)
                base = np.concatenate(([0], np.cumsum(n_chars)))
                shift = np.repeat(base[:-1], np.diff(e.offsets))
                begin, end = e.begin + shift, e.end + shift
                if given:
                    secs = pc.list_flatten(s.column(2))
                    doc = np.repeat(np.arange(s.num_rows), np.asarray(pc.list_value_length(s.column(2)), np.int64))
                    kind, number = secs.field(0), secs.field(1)
                    low = np.clip(np.asarray(secs.field(2), np.int64), 0, n_chars[doc]) + base[doc]
                    high = np.clip(np.asarray(secs.field(3), np.int64), 0, n_chars[doc]) + base[doc]
                else:
                    every = np.arange(s.num_rows)
                    line_doc, line_low, line_high = _line_bounds(raw, bounds)
                    cut = base[:-1] + np.minimum(lead_chars, n_chars)
                    doc = np.concatenate((every, every, line_doc))
                    low = np.concatenate((base[:-1], cut, line_low))
                    high = np.concatenate((cut, base[1:], line_high))
                    nth = np.arange(len(line_doc)) - np.searchsorted(line_doc, line_doc, side="left")
                    number = pa.array(np.concatenate((np.zeros(s.num_rows), np.ones(s.num_rows), nth)).astype(np.int32))
                    kind = pa.array(["lead", "rest", "line"]).take(pa.array(np.repeat([0, 1, 2], [s.num_rows, s.num_rows, len(line_doc)])))
                count, crossing = allocate(begin, end, low, high, rule)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(doc)), kind, number, pa.array(low - base[doc]), pa.array(high - base[doc]), pa.array(count), pa.array(crossing)],
                    ["doc_id", "kind", "section", "begin", "end", "n_tokens", "n_crossing"],
                )
        tok.done()

    return rows.mapInArrow(run, SCHEMA)
