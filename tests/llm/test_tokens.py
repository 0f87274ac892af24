import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from claimloom.llm.tokens import public_path, tokenizer

ALPHABET = st.text(alphabet=st.sampled_from("abAB éÉß×÷'s.,!|<>\n\t 12½İΣσ日́ \x1c\x85K"), max_size=40)


def same(texts):
    tok = tokenizer(public_path())
    got = tok.encode(pa.array(texts, pa.string()), spans=True)
    want = tok.tok.encode_batch([t or "" for t in texts], add_special_tokens=False)
    for i, w in enumerate(want):
        a, b = got.offsets[i], got.offsets[i + 1]
        assert got.ids[a:b].tolist() == w.ids
        assert list(zip(got.begin[a:b].tolist(), got.end[a:b].tolist(), strict=True)) == w.offsets


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(ALPHABET, st.text(max_size=20)), max_size=6))
def test_words_give_the_ids_and_spans_of_whole_texts(texts):
    same(texts)


def test_odd_texts():
    same(["", None, " ", "<|endoftext|>x", "It's we'LL", "a\r\nb", "é́ x", "word " * 3000])
    same([])


def test_any_other_tokenizer_file_goes_text_by_text():
    tok = tokenizer(public_path("byte_bpe_50k.json"))
    assert not tok.wordwise
    got = tok.encode(pa.array(["Hello  world\n", None, ""]))
    assert got.offsets.tolist()[1:] == [len(tok.tok.encode("Hello  world\n").ids)] * 3
    assert got.ids.dtype == np.uint32


def test_cache_of_bounded_size(monkeypatch):
    from claimloom.llm import tokens

    monkeypatch.setattr(tokens, "CACHE_BYTES", 9000)
    for k in range(5):
        same([" ".join(f"w{chr(97 + i % 26)}x{chr(97 + k)}{i}" for i in range(60))])
