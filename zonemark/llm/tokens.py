"""Tokenising whole texts with a public tokenizer file, fast enough to be run per task.

The tokenizer's pre-tokenizer drops white space and never joins across it, so the ids of a text are
the ids of its white-space separated chunks, one after the other.  Arrow splits a batch and numbers
its distinct chunks; only those are encoded.  Most are letters with perhaps marks after them: the
pre-tokenizer parts the marks from the letters, and a run of letters is one unit that ends with the one
end-of-word token, so many runs are encoded in one call and told apart by those tokens.  A worker keeps
the ids of the letter runs it has seen, up to ``max_known``; then it starts afresh, so memory stays
bounded and the result does not depend on what is kept.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .memory import keeps

_TOKENIZERS = keeps("tokens")
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_JOIN = 200


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def tokenizer_for(path: str) -> "ChunkTokenizer":
    """The worker's own tokenizer for a file, made on first use."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = ChunkTokenizer(path)
    return _TOKENIZERS[path]


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Positions start, start+1, ... for each (start, len), one after the other."""
    ends = np.cumsum(lens)
    if not len(ends) or not ends[-1]:
        return np.empty(0, np.int64)
    return np.repeat(starts - (ends - lens), lens) + np.arange(ends[-1])


def whole(texts: pa.Array) -> pa.Array:
    """A large_string array without nulls that owns all of its buffers: some of Arrow's kernels go
    wrong on slices."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    off = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset) if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2]
    data = data.slice(int(off[0]), int(off[-1] - off[0])) if data else pa.py_buffer(b"")
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(off - off[0]), data)


def _stays_letters(run: str) -> bool:
    """Whether the tokenizer's normaliser leaves nothing but letters."""
    return unicodedata.normalize("NFC", run).lower().isalpha()


#: What a tokenizer file must say for its texts to be taken apart here.
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _splits(raw) -> bool:
    """Whether a tokenizer lower-cases, parts white space, letters, digits and other marks, and ends words."""
    d = json.loads(raw.to_str())
    normal, first = d["normalizer"] or {}, ((d["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
    return (
        [x["type"] for x in normal.get("normalizers", [])] == _NORMALIZERS
        and first.get("pattern") == {"Regex": _SPLIT}
        and d["model"].get("end_of_word_suffix") == "</w>"
        and all(t["content"].startswith("<|") for t in d["added_tokens"])
    )


class ChunkTokenizer:
    """For tokenizers that lower-case and whose pre-tokenizer splits off white space and punctuation; with any
    other file whole texts go to the tokenizer as they are."""

    def __init__(self, path: str, max_known: int = 300_000) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.raw = Tokenizer.from_file(path)
        self.max_known = max_known
        self.whole_texts = not _splits(self.raw)
        vocab = self.raw.get_vocab()
        self.ends_word = np.zeros(max(vocab.values()) + 1, bool)
        self.ends_word[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self._forget()

    def _one(self, text: str) -> list[int]:
        return self.raw.encode(text, add_special_tokens=False).ids

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = np.empty(1 << 20, np.uint32)
        self.used = 0
        self.start = np.empty(1 << 18, np.int64)
        self.len = np.empty(1 << 18, np.int64)

    def _add(self, words: list[str], ids: np.ndarray, lens: np.ndarray) -> None:
        first, n = len(self.known), len(ids)
        while self.used + n > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while first + len(words) > len(self.start):
            self.start = np.concatenate([self.start, np.empty_like(self.start)])
            self.len = np.concatenate([self.len, np.empty_like(self.len)])
        self.flat[self.used : self.used + n] = ids
        ends = np.cumsum(lens)
        self.start[first : first + len(words)] = self.used + ends - lens
        self.len[first : first + len(words)] = lens
        self.known.update(zip(words, range(first, first + len(words))))
        self.used += n

    def _learn_runs(self, runs: list[str]) -> None:
        """Letter runs, many to a call; a call whose word ends do not add up is done one by one."""
        for lo in range(0, len(runs), 100 * _JOIN):
            groups = [runs[k : k + _JOIN] for k in range(lo, min(lo + 100 * _JOIN, len(runs)), _JOIN)]
            for words, e in zip(groups, self.raw.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
                ids = np.array(e.ids, np.uint32)
                ends = np.flatnonzero(self.ends_word[ids]) + 1
                if len(ends) == len(words) and ends[-1] == len(ids):
                    self._add(words, ids, np.diff(ends, prepend=0))
                else:
                    self._learn_others(words)

    def _learn_others(self, chunks: list[str]) -> None:
        for lo in range(0, len(chunks), 20_000):
            part = chunks[lo : lo + 20_000]
            ids = [e.ids for e in self.raw.encode_batch_fast([c.removeprefix(" ") for c in part], add_special_tokens=False)]
            lens = np.fromiter(map(len, ids), np.int64, len(ids))
            self._add(part, np.fromiter((i for x in ids for i in x), np.uint32, int(lens.sum())), lens)

    def _chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many) of each chunk."""
        if len(self.known) > self.max_known:
            self._forget()
        known, tails = self.known, {"": 0}
        at, tail = np.empty(len(chunks), np.int64), np.zeros(len(chunks), np.int64)
        runs: dict[str, None] = {}
        others: dict[str, None] = {}
        late: list[tuple[int, str]] = []
        for k, c in enumerate(chunks):
            s = c.rstrip(_MARKS)
            i = known.get(s)
            if i is None and (not s.isalpha() or not (s.isascii() or _stays_letters(s))):
                s = " " + c  # as a whole; no chunk has a space
                i = known.get(s)
            elif len(s) < len(c):
                tail[k] = tails.setdefault(c[len(s) :], len(tails))
            if i is None:
                (others if s[0] == " " else runs)[s] = None
                late.append((k, s))
            else:
                at[k] = i
        self._learn_runs(list(runs))
        self._learn_others(list(others))
        for k, s in late:
            at[k] = known[s]
        # marks behind a run of letters are one unit of the pre-tokenizer
        tail_ids = [self._one(t) if t else [] for t in tails]
        tail_len = np.array([len(t) for t in tail_ids])
        tail_flat = np.array([i for t in tail_ids for i in t], np.uint32)
        lens, more = self.len[at], tail_len[tail]
        total = lens + more
        out = np.empty(int(total.sum()), np.uint32)
        first = np.cumsum(total) - total
        out[ragged(first, lens)] = self.flat[ragged(self.start[at], lens)]
        out[ragged(first + lens, more)] = tail_flat[ragged((np.cumsum(tail_len) - tail_len)[tail], more)]
        return out, total

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """One uint32 array of ids a text; a null text counts as empty."""
        texts = whole(texts)
        out: list[np.ndarray] = []
        if self.whole_texts:
            for lo in range(0, len(texts), 1000):
                found = self.raw.encode_batch_fast(texts.slice(lo, 1000).to_pylist(), add_special_tokens=False)
                out += [np.array(e.ids, np.uint32) for e in found]
            return out
        size, lo = pc.binary_length(texts).to_numpy(zero_copy_only=False), 0
        while lo < len(texts):
            hi = lo + max(1, int(np.searchsorted(np.cumsum(size[lo:]), 9_000_000, "right")))
            out += self._encode(whole(texts.slice(lo, hi - lo)))
            lo = hi
        return out

    def _encode(self, texts: pa.Array) -> list[np.ndarray]:
        special = pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False)
        lower = pc.ascii_lower(texts)
        if special.any():  # the strings of special tokens are matched before lower-casing
            lower = pc.if_else(pa.array(special), "", lower)
        words = pc.ascii_split_whitespace(lower)
        bounds = words.offsets.to_numpy()
        coded = words.flatten().dictionary_encode()
        ids, lens = self._chunks(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        at, bounds = coded.indices.to_numpy(), bounds - bounds[0]
        del lower, words, coded
        first = np.cumsum(lens) - lens
        out: list[np.ndarray] = []
        lo = 0
        while lo + 1 < len(bounds):  # some texts at a time: laying out takes several numbers an id
            hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + 400_000, "right")) - 1)
            mine = at[bounds[lo] : bounds[hi]]
            n = lens[mine]
            flat = ids[ragged(first[mine], n)]
            ends = np.concatenate([[0], np.cumsum(n)])[bounds[lo : hi + 1] - bounds[lo]]
            out += [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]
            lo = hi
        for k in np.flatnonzero(special):
            out[k] = np.array(self._one(texts[int(k)].as_py()), np.uint32)
        return out
