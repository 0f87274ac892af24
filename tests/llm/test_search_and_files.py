import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from claimloom.llm import sharding, topk, warc


def brute_topk(rows, queries, k, factor):
    def usable(v):
        return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v)

    out = []
    whole = lambda v: [int(np.floor(factor * float(x))) for x in v]
    asked = {}
    for q, v in queries:
        if usable(v) and q is not None:
            asked[q] = min(asked.get(q, whole(v)), whole(v))
    for q, v in asked.items():
        found = [(-sum(a * b for a, b in zip(v, whole(w), strict=True)), i) for i, w in rows if i is not None and i != q and usable(w) and len(w) == len(v)]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(found)[:k])]
    return sorted(out)


@pytest.mark.parametrize("block", [5, 4096])
def test_topk(spark, block):
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=6).round(1)]) for i in range(120)]
    rows += [(200, None), (201, []), (202, [1.0] * 5), (203, [float("nan")] * 6), (204, [None] + [1.0] * 5), (205, [float("inf")] * 6), (None, [1.0] * 6), (206, [0.0] * 6), (7, [3.0] * 6), (207, [1e6] * 6)]
    rows += [(300 + i, [0.5] * 6) for i in range(30)]  # ties
    df = spark.createDataFrame(rows, "id long, vec array<float>")
    queries = [r for r in rows if r[0] is None or r[0] % 10 == 0 or r[0] in (7, 202)]
    got = topk.search(topk.build(df, 1024, block), spark.createDataFrame(queries, "id long, vec array<float>"), 10, 1024)
    f32 = [(i, v and [x if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    f32q = [(i, v and [x if x is None else float(np.float32(x)) for x in v]) for i, v in queries]
    assert sorted(map(tuple, got.collect())) == brute_topk(f32, f32q, 10, 1024)


def test_topk_with_several_lengths_large_values_and_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BYTES", 100)  # several blocks of queries
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=3 + i % 3).round(2).tolist(), "x", 1.5) for i in range(150)]
    rows += [(200 + i, [float(2**51 + i), 1.0, -float(2**40)], "y", None) for i in range(12)]  # near the end of exact doubles
    df = spark.createDataFrame(rows, "id long, vec array<double>, ids string, score double")
    queries = [(i, v) for i, v, *_ in rows if i % 10 == 0 and i < 200]
    asked = spark.createDataFrame([(i, v, "q") for i, v in queries], "id long, vec array<double>, query_id string")
    got = topk.search(topk.build(df, 1, 40), asked, 4, 1)
    assert sorted(map(tuple, got.collect())) == brute_topk([r[:2] for r in rows], queries, 4, 1)


def test_only_vectors_within_reach_are_read(spark, tmp_path):
    rng = np.random.default_rng(6)
    x = rng.integers(-500, 500, (4000, 16))
    (tmp_path / "f").write_bytes(x.astype("<i8").tobytes())
    held = topk.Exact(f"file://{tmp_path}/f", 0, 4000, 16)
    assert (held.rows(np.array([5, 3999, 7])) == x[[5, 3999, 7]]).all() and len(held.vectors) == 3
    assert (held.rows(np.array([7, 8])) == x[[7, 8]]).all() and len(held.vectors) == 4


def test_scores_beyond_64_bits_are_an_error():
    big = np.full((1, 2), 2**40)
    assert topk._scores(big, np.array([2**20, 5]))[0] == 2**60 + 5 * 2**40
    with pytest.raises(OverflowError):
        topk._scores(big, np.array([2**40, 5]))


def test_topk_of_nothing(spark):
    none = spark.createDataFrame([], "id long, vec array<float>")
    assert topk.search(topk.build(none), none).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(2)
    x, q = rng.integers(-500, 500, (300, 8)), rng.integers(-500, 500, (20, 8))
    low, high = x.min(axis=0).astype(float), x.max(axis=0).astype(float)
    width = np.maximum((high - low) / topk.CELLS, 1e-9)
    cells = np.clip((x - low) // width, 0, topk.CELLS - 1).astype(np.uint8)
    a, b = topk.bounds(q, low, width, cells)
    exact = q @ x.T
    assert (a <= exact).all() and (exact <= b).all()


PAGES = [
    (1, "http://www.Example.com:8080/a?b#c", "x" * 1500), (2, "http://example.com/", "x" * 1500), (3, None, "x" * 1500),
    (4, "https://b.example.org/é y\n", "short"), (5, "not a url", "short"), (6, "http://[bad", None), (7, "http://b.example.org", "é\r\n\r\n" * 400),
    (None, "http://n.example.org/1", "y" * 2000), (None, "http://n.example.org/2", "y" * 2000), (8, "http://n.example.org/3", "z" * 2000), (None, "http://n.example.org/4", "z" * 2000),
    (9, "http://d.example.org/", "d" * 1200), (9, "http://d.example.org/", "d" * 1200), (2, "http://example.com/", "other"),
]


def brute_pages(pages):
    by = defaultdict(list)
    for i, _, h in pages:
        by[h or ""].append(i)
    out = []
    for i, _, h in pages:
        body = (h or "").encode()
        own = by[h or ""]
        top = max((x for x in own if x is not None), default=None)
        revisit = len(body) >= 1000 and len(own) > 1 and top is not None and i != top
        out.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=str)


def test_urls_with_line_ends_and_a_very_long_page(spark):
    rows = [(1, "http://a.org/x\r\nWARC-Type: revisit\r\n\r\n", "body"), (2, "http://a.org/é p", "long " * 600_000), (3, "http://a.org/%20", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    directory = warc.build_index(warc.write(pages))
    got = {r["page_id"]: r for r in warc.read(warc.look_up(directory, pages.select("url")), payloads=True).collect()}
    assert got[1]["url"] == "http://a.org/x%0D%0AWARC-Type:%20revisit%0D%0A%0D%0A" and got[1]["record_type"] == "response"
    assert got[2]["url"] == "http://a.org/%C3%A9%20p" and got[2]["payload"] == b"long " * 600_000
    assert got[3]["url"] == "http://a.org/%20" and got[3]["payload"] == b""


@pytest.mark.parametrize("limit", [0, 32 << 20])
def test_warc_round_trip(spark, monkeypatch, limit):
    monkeypatch.setattr(warc, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 500)
    pages = spark.createDataFrame([(*p, "extra") for p in PAGES], "page_id long, url string, html string, payload string")
    directory = warc.build_index(warc.write(pages), lines=3)
    records = warc.read(warc.captures_of(directory), payloads=True).collect()
    keys = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted((tuple(r[k] for k in keys) for r in records), key=str) == brute_pages(PAGES)
    for r in records:
        if r["record_type"] == "response":
            assert hashlib.sha1(r["payload"]).hexdigest() == r["payload_digest"]
    found = warc.read(warc.look_up(directory, pages.select("url"))).collect()
    assert sorted((tuple(r[k] for k in keys) for r in found), key=str) == brute_pages(PAGES)
    some = spark.createDataFrame([("http://d.example.org/",), ("http://d.example.org/",), ("http://none.org/",), (None,)], "url string")
    assert sorted((r["page_id"] for r in warc.read(warc.look_up(directory, some)).collect()), key=str) == [3, 9, 9]
    for most in (0, 100):
        look = warc.Lookup(spark, directory, most=most)
        assert sorted(r[4] for r in look.records("http://example.com")) == sorted(h for i, _, h, _, _ in brute_pages(PAGES[1:2] + PAGES[13:]))
        assert len(look.records("http://d.example.org/")) == 2 and look.records("http://none.org") == []


def test_warc_of_nothing(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read(warc.look_up(warc.build_index(warc.write(none)), none.select("url"))).count() == 0
    assert warc.read(warc.captures_of(warc.build_index(warc.write(none)))).count() == 0


def test_surt():
    assert warc.surt("http://www.A.b.Com:8080/x?y") == "com,b,a:8080)/x?y"
    assert warc.surt("https://a.org") == "org,a)/" and warc.surt(None) == "" and warc.surt("http://[bad") == ")http://[bad"


@pytest.mark.parametrize("shards", [1, 3, 24])
def test_shards(spark, documents, odd_docs, no_docs, shards):
    for docs in (documents, odd_docs):
        got = sharding.shard(docs, shards).collect()
        want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in docs.collect())
        assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
        slots, where = defaultdict(list), defaultdict(set)
        for r in got:
            slots[r["shard"]].append(r["slot"])
            where[r["text_crc32"], r["size"]].add(r["shard"])
        assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))
        assert all(len(s) == 1 for s in where.values())
    load = Counter()
    for r in sharding.shard(documents, shards).collect():
        load[r["shard"]] += r["size"]
    groups = Counter()
    for r in documents.collect():
        groups[r["text"]] += len(r["text"].encode()) + 8
    assert max(load.values()) <= max(1.05 * sum(load.values()) / shards, max(groups.values()))
    assert sharding.shard(no_docs, shards).count() == 0


def test_fixed_capacity(spark, documents):
    got = Counter()
    for r in sharding.shard(documents, capacity=100_000).collect():
        got[r["shard"]] += r["size"]
    assert max(got.values()) <= 100_000 and len(got) <= 1.1 * sum(got.values()) / 100_000 + 1


def test_a_group_of_a_third_leaves_the_other_shards_even(spark):
    rows = [(i, "same " * 20) for i in range(3600)] + [(3600 + i, f"{i} " + "word " * (5 + i % 60)) for i in range(4000)]
    load, where = Counter(), set()
    for r in sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        load[r["shard"]] += r["size"]
        if r["doc_id"] < 3600:
            where.add(r["shard"])
    (own,) = where
    others = [load[b] for b in range(24) if b != own]
    assert load[own] == 3600 * 108 > sum(load.values()) / 3
    even = sum(others) / 23
    assert 0.9 * even <= min(others) and max(others) <= 1.05 * even


def test_least_capacity_sets_large_items_apart():
    load = Counter()
    for size, b, n in sharding.least_capacity({5000: 1, 900: 1, 1: 220}, 24):
        load[b] += size * n
    assert sorted(load.values()) == [10] * 22 + [900, 5000]
    assert sorted(b for _, b, _ in sharding.least_capacity({9: 1, 5: 1, 2: 1}, 24)) == [0, 1, 2]
    assert sharding.least_capacity({}, 24) == []


def plain_best_fit(sizes, capacity):
    bins, out = [], []
    for s in sorted(sizes, reverse=True):
        fits = [(r, b) for b, r in enumerate(bins) if r >= s]
        if fits:
            b = min(fits)[1]
        else:
            b = len(bins)
            bins.append(capacity)
        bins[b] -= s
        out.append((s, b))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_best_fit_against_a_list(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 60 if seed % 2 else 12, 500).tolist()
    got = [(s, b) for s, b, n in sharding.best_fit_decreasing(dict(Counter(sizes)), 100) for _ in range(n)]
    assert got == plain_best_fit(sizes, 100)
    assert [b for _, b, _ in sharding.best_fit_decreasing({5: 2, 3: 1, 0: 2}, 4)] == [0, 1, 2, 2]


def test_groups_are_packed_as_a_plain_best_fit(spark, documents):
    """The whole assignment: shards' sizes are those of the rule on groups, one by one."""
    groups = Counter()
    for r in documents.collect():
        groups[r["text"]] += len(r["text"].encode()) + 8
    capacity = 3 * max(groups.values())
    want = Counter()
    for s, b in plain_best_fit(groups.values(), capacity):
        want[b] += s
    load = Counter()
    for r in sharding.shard(documents, capacity=capacity).collect():
        load[r["shard"]] += r["size"]
    assert load == want


def test_a_group_above_the_capacity_has_a_shard_of_its_own(spark):
    docs = spark.createDataFrame([(1, "x" * 500), (2, "y"), (3, "z")], "doc_id long, text string")
    got = {r["doc_id"]: r["shard"] for r in sharding.shard(docs, capacity=100).collect()}
    assert got[2] == got[3] != got[1]


def test_rows_of_a_hot_text_and_null_ids(spark):
    rows = [(None, "same")] * 700 + [(7, "same")] * 300 + [(i, f"text {i % 150}") for i in range(500)]
    slots = defaultdict(list)
    for r in sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect():
        slots[r["shard"]].append(r["slot"])
    assert sum(map(len, slots.values())) == 1500 and all(sorted(s) == list(range(len(s))) for s in slots.values())
