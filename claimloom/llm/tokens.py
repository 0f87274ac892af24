"""Token ids of whole texts by the tokenizers library, once for each distinct word.

A ``tokenizer.json`` whose normaliser acts within words and whose pre-tokeniser never
crosses white space gives a text the ids of its words in order. So the distinct words of
a block of texts go to the library once, in a cache of bounded size that lives as long as
the Python worker, and the ids of the texts are gathered from it by array operations.

``WordTokenizer`` does this for the word-level pattern of ``PATTERN`` below. Runs of
characters between white space which hold anything but ASCII and the letters of ``PLAIN``
are encoded whole by the library's own pipeline. Any other tokenizer file works through
``encode_batch_fast`` on whole texts.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa

from .textblocks import flat, ragged, release

#: The pre-tokeniser's pattern for which words can be told apart bytewise (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Bytes that the cache of words may take; beyond that it starts anew.
CACHE_BYTES = 40 << 20
#: What a word takes beside its own bytes: the object, its entry and number, and its place.
WORD_BYTES = 180

SPACE, LETTER, DIGIT, MARK = range(4)
#: Class of each byte in a plain run; 0x80-0xBF and 0xC3 make up the letters U+00C0-U+00FF.
_CLASS = np.full(256, MARK, np.uint8)
_CLASS[[9, 10, 13, 32]] = SPACE
_CLASS[ord("0") : ord("9") + 1] = DIGIT
_CLASS[ord("A") : ord("Z") + 1] = LETTER
_CLASS[ord("a") : ord("z") + 1] = LETTER
_CLASS[0x80:] = LETTER
#: Bytes that take a run out of the plain ones: apostrophes, control characters, and lead
#: bytes other than 0xC3. Special tokens hold "|".
_ODD = np.zeros(256, bool)
_ODD[:32] = True
_ODD[[9, 10, 13, 32]] = False
_ODD[[ord("'"), ord("|"), 127]] = True
_ODD[0xC0:] = True
_ODD[0xC3] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, extra = {}, 256
    for b in range(256):
        table[b] = chr(b if b in shown else extra)
        extra += b not in shown
    return [table[b] for b in range(256)]


class Encoded:
    """Ids of n texts in a row; ``offsets`` (n + 1) delimit the texts.

    ``begin`` and ``end`` are character spans in each text, where asked for.
    """

    def __init__(self, ids: np.ndarray, offsets: np.ndarray, begin=None, end=None):
        self.ids, self.offsets, self.begin, self.end = ids, offsets, begin, end


class WordTokenizer:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tok = Tokenizer.from_file(path)
        self.vocab = self.tok.get_vocab_size(with_added_tokens=True)
        parts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        kinds = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.wordwise = (
            parts[0].get("pattern", {}).get("Regex") == PATTERN
            and kinds == ["NFC", "Replace", "Lowercase"]
            and not any(spec["model"].get(k) for k in ("dropout", "continuing_subword_prefix"))
        )
        self.suffix = spec["model"].get("end_of_word_suffix") or ""
        self.symbols = byte_symbols()
        #: Bytes of text that each id stands for in a plain word.
        self.width = np.zeros(self.vocab, np.int32)
        for token, i in self.tok.get_vocab(with_added_tokens=False).items():
            self.width[i] = len(token) - (len(self.suffix) if self.suffix and token.endswith(self.suffix) else 0)
        self.forget()

    def forget(self) -> None:
        self.code: dict[bytes, int] = {}
        self.odd: dict[int, tuple[list[int], list[int]]] = {}
        self.held = 0  # bytes, about
        self.n = 0  # token slots in use
        self.starts, self.counts = np.zeros(1024, np.int32), np.zeros(1024, np.int32)
        self.ids = np.zeros(4096, np.uint32)

    def done(self) -> None:
        """To be called at the end of a task: the worker lives on without the words."""
        self.forget()
        release()

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        if n <= len(a):
            return a
        grown = np.zeros(max(n, 2 * len(a)), a.dtype)
        grown[: len(a)] = a
        return grown

    def _new(self, words: list[bytes], odd: bool) -> range:
        """Encode words that the cache lacks; their codes."""
        base = len(self.code)
        if odd:
            found = self.tok.encode_batch([w[1:].decode("utf-8") for w in words], add_special_tokens=False)
            for i, e in enumerate(found):
                self.odd[base + i] = ([x for x, _ in e.offsets], [x for _, x in e.offsets])
            ids = [e.ids for e in found]
        else:  # words of one class of characters in lower case: only the model is left to do
            run, symbols = self.tok.model.tokenize, self.symbols
            texts = [w.decode() if w.isascii() else "".join([symbols[x] for x in w]) for w in words]
            ids = [[t.id for t in run(x)] for x in texts]
        codes = range(base, base + len(words))
        self.code.update(zip(words, codes, strict=True))
        sizes = np.fromiter(map(len, ids), np.int32, len(ids))
        total = int(sizes.sum())
        self.starts, self.counts = self._room(self.starts, base + len(ids)), self._room(self.counts, base + len(ids))
        self.ids = self._room(self.ids, self.n + total)
        self.counts[base : base + len(ids)] = sizes
        self.starts[base : base + len(ids)] = self.n + np.cumsum(sizes) - sizes
        self.ids[self.n : self.n + total] = np.fromiter((x for y in ids for x in y), np.uint32, total)
        self.n += total
        self.held += sum(map(len, words)) + WORD_BYTES * len(words) + (100 if odd else 4) * total
        return codes

    def _learn(self, words: list[bytes], odd: np.ndarray) -> np.ndarray:
        """Codes of distinct words; those not known yet are encoded."""
        if self.held > CACHE_BYTES:
            self.forget()
        for i in np.flatnonzero(odd).tolist():  # as they stand, not in lower case
            words[i] = b"\0" + words[i]
        get = self.code.get
        out = np.array([get(w, -1) for w in words], np.int64)
        for kind in (False, True):
            new = np.flatnonzero((out < 0) & (odd == kind))
            if len(new):
                out[new] = self._new([words[i] for i in new.tolist()], kind)
        return out

    def encode(self, texts: pa.Array, spans: bool = False) -> Encoded:
        """Ids of every whole text; null is as an empty text."""
        if not self.wordwise:
            return self._by_text(texts, spans)
        raw, bounds = flat(texts)
        if not len(raw):
            none = np.zeros(0, np.int64)
            return Encoded(np.zeros(0, np.uint32), np.zeros(len(bounds), np.int64), none, none)
        none = np.zeros(0, np.int32)
        whole = raw.tobytes()  # bytes.translate is several times as fast as a numpy look-up
        cls = np.frombuffer(whole.translate(_CLASS.tobytes()), np.uint8)
        odd = np.frombuffer(bytearray(whole.translate(_ODD.tobytes())), bool)
        after_c3 = np.zeros(len(raw), bool)
        after_c3[1:] = raw[:-1] == 0xC3
        odd |= after_c3 & ((raw == 0x97) | (raw == 0xB7))  # the signs for times and division
        odd |= (raw >= 0x80) & (raw < 0xC0) & ~after_c3
        low = np.frombuffer(bytearray(whole.translate(_LOWER.tobytes())), np.uint8)
        low[after_c3 & (raw >= 0x80) & (raw <= 0x9E)] += 32
        gap = cls == SPACE
        run = np.zeros(len(raw), bool)  # starts a run between white space, or a text
        run[bounds[:-1][np.diff(bounds) > 0]] = True
        run[1:] |= gap[:-1]
        run &= ~gap
        run_at = np.flatnonzero(run)
        if not len(run_at):
            return Encoded(np.zeros(0, np.uint32), np.zeros(len(bounds), np.int64), none, none)
        run_odd = np.logical_or.reduceat(odd, run_at)  # what follows a run up to the next is white space
        word = np.zeros(len(raw), bool)
        word[1:] = (cls[1:] != cls[:-1]) | (cls[1:] == DIGIT)
        in_odd = None
        if run_odd.any():
            in_odd = np.zeros(len(raw), bool)
            in_odd[run_at[0] :] = np.repeat(run_odd, np.diff(np.append(run_at, len(raw))))
            word &= ~in_odd
            np.copyto(low, raw, where=in_odd)
        word |= run
        word &= ~gap
        at = np.flatnonzero(word)
        keep = ~gap
        packed = low[keep]
        size, kind = (np.int32, pa.binary()) if len(packed) < 2**31 else (np.int64, pa.large_binary())
        w_off = np.append(np.cumsum(keep, dtype=size)[at] - 1, len(packed)).astype(size)
        words = pa.Array.from_buffers(kind, len(at), [None, pa.py_buffer(w_off), pa.py_buffer(packed)])
        d = words.dictionary_encode()
        index = np.asarray(d.indices)
        word_odd = np.zeros(len(d.dictionary), bool)
        if in_odd is not None:
            word_odd[index] = in_odd[at]
        # an odd run never equals a plain word: it has a byte that no plain word has
        held, ends = d.dictionary.buffers()[2].to_pybytes(), np.frombuffer(d.dictionary.buffers()[1], size)[: len(d.dictionary) + 1].tolist()
        code = self._learn([held[a:b] for a, b in zip(ends, ends[1:], strict=False)], word_odd)[index]
        counts = self.counts[code]
        ids = self.ids[ragged(self.starts[code], counts)]
        upto = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
        offsets = upto[np.searchsorted(at, bounds, side="left")]
        if not spans:
            return Encoded(ids, offsets)
        stop = np.cumsum(self.width[ids], dtype=np.int64)  # bytes, within each word
        begin = stop - self.width[ids]
        shift = np.repeat(at - np.append(begin, 0)[upto[:-1]], counts)
        begin, stop = begin + shift, stop + shift
        char = np.cumsum((raw & 0xC0) != 0x80, dtype=np.int32)
        if word_odd.any():  # their bytes aren't those of their tokens
            begin, stop = np.minimum(np.maximum(begin, 0), len(raw) - 1), np.clip(stop, 1, len(raw))
        begin, end = char[begin] - 1, char[stop - 1]
        for i in np.flatnonzero(word_odd[index]).tolist():
            b, e = self.odd[int(code[i])]
            base = char[at[i]] - 1
            begin[upto[i] : upto[i + 1]] = base + np.asarray(b, np.int32)
            end[upto[i] : upto[i + 1]] = base + np.asarray(e, np.int32)
        before = np.append(char, 0)[bounds[:-1] - 1] if len(bounds) else none  # characters of earlier texts
        before = np.where(bounds[:-1] > 0, before, 0)
        shift = np.repeat(before, np.diff(offsets))
        return Encoded(ids, offsets, begin - shift, end - shift)

    def _by_text(self, texts: pa.Array, spans: bool) -> Encoded:
        texts = [x or "" for x in texts.to_pylist()]
        batch = self.tok.encode_batch if spans else self.tok.encode_batch_fast
        found = batch(texts, add_special_tokens=False)
        ids = [np.asarray(e.ids, np.uint32) for e in found]
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int64)
        flat_ids = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
        if not spans:
            return Encoded(flat_ids, offsets)
        pairs = np.array([p for e in found for p in e.offsets], np.int64).reshape(-1, 2)
        return Encoded(flat_ids, offsets, pairs[:, 0], pairs[:, 1])


@lru_cache(maxsize=1)
def tokenizer(path: str) -> WordTokenizer:
    """One for each worker and file, with its cache of words."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordTokenizer(path)


def public_path(name: str = "word_bpe_49k.json") -> str:
    """Where a public vocabulary file is on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
