import pickle
import hashlib
import re
from collections import defaultdict

import pyarrow as pa
import pytest

from claimloom.llm import decontamination as D

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window):
    owners = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            owners[tuple(w[k : k + window])].add(i)
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for phrase, own in owners.items():
            for k in range(len(w) - len(phrase) + 1):
                if tuple(w[k : k + len(phrase)]) == phrase:
                    hit |= set(range(k, k + len(phrase)))
                    found |= own - {None}
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(found), digest, bool(hit)))
    return sorted(out, key=str)


ITEMS = [(1, "quick brown fox"), (1, "lazy DOG, near"), (2, "the quick brown fox jumps"), (None, "river bank"), (3, "..."), (4, None), (5, "word"), (2, "zzz not there at all")]


@pytest.mark.parametrize("window", [1, 2, 3])
def test_odd_rows(spark, odd_docs, window, monkeypatch):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.where("doc_id is null or doc_id <> 5").collect()]
    index = D.build_index(odd_docs.where("doc_id is null or doc_id <> 5"))
    want = brute(docs, ITEMS, window)
    assert sorted((tuple(r) for r in D.report(index, items, window).collect()), key=str) == want
    monkeypatch.setattr(D, "BLOCK_BYTES", 16)  # many blocks
    monkeypatch.setattr(D, "HELD", 1)
    assert sorted((tuple(r) for r in D.report(index, items, window).collect()), key=str) == want


def test_a_block_holds_a_bounded_part_of_the_items(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_BYTES", 4000)
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(100))) for i in range(60)] + [(99, "long " * 5000)]
    names = D.compiled(spark.createDataFrame(rows, "item_id long, text string"), 10)
    blocks = [pickle.loads(open(n.removeprefix("file://"), "rb").read()) for n in names]
    assert len(blocks) > 8
    assert all(len(b.items) <= 12 for b in blocks)
    assert sorted(i for b in blocks for i in b.items) == sorted(i for i, _ in rows)


def test_empty_tables(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.report(D.build_index(odd_docs), none).where("contaminated").count() == 0
    assert D.report(D.build_index(no_docs), none).count() == 0


def test_keep_clean_keeps_columns_and_rows(spark, odd_docs):
    items = spark.createDataFrame([(1, "lazy dog near the old river")], "item_id long, text string")
    got = D.keep_clean(odd_docs, items, window=4)
    assert got.columns == odd_docs.columns
    assert sorted(str(r["doc_id"]) for r in got.collect()) == sorted(["2", "3", "None", "5", "6", "7", "7"])


def test_matches_and_proximity(spark):
    docs = spark.createDataFrame([(1, "a b c x a y b c"), (2, "c b a"), (3, "a a"), (4, "b c")], "doc_id long, text string")
    items = spark.createDataFrame([(9, "a b c")], "item_id long, text string")
    index = D.build_index(docs)
    assert [tuple(r) for r in D.matches(index, items).collect()] == [(1, 9, 0, 3)]
    near = sorted((r["doc_id"], r["start"]) for r in D.matches(index, items, within=4).collect())

    def runs(text):
        w = text.split()
        return [k for k in range(len(w)) if w[k] in "abc" and {"a", "b", "c"} <= set(w[k : k + 4])]

    assert near == sorted((r["doc_id"], k) for r in docs.collect() for k in runs(r["text"]))


def test_words_are_bytewise_the_pattern():
    texts = ["", None, "É9_a-b c", "日本 x", "A" * 50]
    found, n = D.words_of(pa.array(texts))
    assert [w.decode() for w in found.to_pylist()] == [w for t in texts for w in words(t)]
    assert n.tolist() == [len(words(t)) for t in texts]
