import pytest

from claimloom.llm import token_counts as C
from claimloom.llm.tokens import public_path, tokenizer


def brute(offsets, low, high, rule):
    count, crossing = 0.0, 0
    for a, b in offsets:
        held = min(b, high) - max(a, low)
        if rule == "start":
            count += low <= a < high
        elif held > 0 and rule == "share":
            count += held / (b - a)
        elif held > 0 and rule == "majority":
            count += 2 * held > b - a or (2 * held == b - a and a >= low)
        crossing += held > 0 and (a < low or b > high)
    return count, crossing


@pytest.mark.parametrize("rule", C.RULES)
def test_own_sections(spark, documents, odd_docs, no_docs, rule):
    tok = tokenizer(public_path()).tok
    for docs in (documents, odd_docs.where("doc_id is null or doc_id not in (4, 7)")):
        texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
        offsets = {d: tok.encode(t, add_special_tokens=False).offsets for d, t in texts.items()}
        seen = {}
        for r in C.token_counts(docs, rule=rule, lead_chars=33).collect():
            want = brute(offsets[r["doc_id"]], r["begin"], r["end"], rule)
            assert (r["n_tokens"], r["n_crossing"]) == (pytest.approx(want[0]), want[1])
            seen.setdefault((r["doc_id"], r["kind"]), []).append((r["section"], r["begin"], r["end"]))
        for d, t in texts.items():
            assert seen[d, "lead"] == [(0, 0, min(33, len(t)))] and seen[d, "rest"][0][2] == len(t)
            lines = "".join(t[a:b] for _, a, b in sorted(seen.get((d, "line"), [])))
            assert lines == t and len(seen.get((d, "line"), [])) == len(t.split("\n")) - (t == "" or t.endswith("\n"))
    assert C.token_counts(no_docs).count() == 0


@pytest.mark.parametrize("rule", C.RULES)
def test_given_sections(spark, odd_docs, rule):
    text = odd_docs.where("doc_id = 1").first()["text"]
    sections = [(1, "a", 0, 0, 7), (1, "a", 1, 7, 11), (1, "b", 0, 2, 6), (1, "c", 0, 5, 5), (1, "d", 0, 60, 999), (2, "a", 0, 0, 5), (99, "a", 0, 0, 5)]
    given = spark.createDataFrame(sections, "doc_id long, kind string, section int, begin long, end long")
    got = {(r["kind"], r["section"]): r for r in C.token_counts(odd_docs, sections=given, rule=rule).where("doc_id = 1").collect()}
    offsets = tokenizer(public_path()).tok.encode(text, add_special_tokens=False).offsets
    for _, kind, number, low, high in sections[:5]:
        want = brute(offsets, low, min(high, len(text)), rule)
        assert (got[kind, number]["n_tokens"], got[kind, number]["n_crossing"]) == (pytest.approx(want[0]), want[1])


def test_rule_is_checked():
    with pytest.raises(ValueError):
        C.allocate([], [], [], [], "other")
