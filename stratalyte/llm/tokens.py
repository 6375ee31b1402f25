"""Token ids of whole texts with the tokenizers library, encoding each distinct word once.

The vocabulary's pre-tokenizer never joins pieces across white space, so the ids of a text are the ids of its
chunks (the runs between ASCII white space) one after another. Arrow cuts a group of texts into chunks and numbers
the distinct ones; only those are looked up, in a memory of words of bounded size.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import ragged

_MARK = "|"
#: ASCII marks; a run of them at the end of a chunk is one piece to the pre-tokenizer.
_MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())
#: Letters of the Latin blocks, but for the dotted I, whose lower-case form is two characters.
_LATIN = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+$"
_KEPT: dict = {}


def _byte_letters() -> dict[int, int]:
    """Byte-level vocabularies write a byte as its own printable character, and the others, in order, as those from 256."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in shown)}


_BYTES = _byte_letters()


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class ChunkEncoder:
    def __init__(self, path: str, most: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.mark = self._encode(_MARK)[0]
        self.most = most
        self._clear()

    def _encode(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _clear(self) -> None:
        self.base: dict[str, int] = {}
        self.start, self.length, self.n = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), 1
        self.flat, self.used = np.zeros(1 << 18, np.uint32), 0
        self.again = np.zeros(1 << 16, bool)  # entries that have been looked up since

    def forget(self) -> None:
        """Let go of all words (some 100 MB when many are known); the vocabulary stays."""
        self._clear()

    def _prune(self) -> None:
        """Keep the words that have come more than once."""
        kept = {k: v for k, v in self.base.items() if self.again[v]}
        flat, start, length = self.flat, self.start, self.length
        self._clear()
        if len(kept) <= self.most // 2:
            at = np.fromiter(kept.values(), np.int64, len(kept))
            n = length[at]
            self.base = dict(zip(kept, self._append(flat[np.repeat(start[at], n) + ragged(n)], n)))

    def _append(self, new: np.ndarray, n: np.ndarray) -> range:
        """Entries for runs of ids of the lengths n."""
        while self.n + len(n) > len(self.start):
            self.start, self.length, self.again = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length, self.again))
        while self.used + len(new) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.start[self.n : self.n + len(n)] = self.used + np.cumsum(n) - n
        self.length[self.n : self.n + len(n)] = n
        self.flat[self.used : self.used + len(new)] = new
        self.n += len(n)
        self.used += len(new)
        return range(self.n - len(n), self.n)

    def _learn(self, keys: list[str], word: list[bool]) -> None:
        """Lower-case Latin words are one piece to the pre-tokenizer and go to the model as they are. Others go through
        the whole tokenizer together, with a mark between them, or alone if they hold the mark."""
        plain = [k for k, w in zip(keys, word) if w]
        if plain:
            tokenize = self.model.tokenize
            runs = [[t.id for t in tokenize(k if k.isascii() else k.encode().decode("latin-1").translate(_BYTES))] for k in plain]
            n = np.fromiter(map(len, runs), np.int64, len(runs))
            self.base.update(zip(plain, self._append(np.fromiter(chain.from_iterable(runs), np.uint32, int(n.sum())), n)))
        rest = [k for k, w in zip(keys, word) if not w]
        marked = [k for k in rest if _MARK in k or not k]
        joined = [k for k in rest if _MARK not in k and k]
        for lo in range(0, len(joined), 1000):
            part = joined[lo : lo + 1000]
            ids = np.array(self._encode(f" {_MARK} ".join(part) + f" {_MARK}"), np.uint32)
            ends = np.flatnonzero(ids == self.mark)
            self.base.update(zip(part, self._append(ids[ids != self.mark], np.diff(ends, prepend=-1) - 1)))
        for k in marked:
            ids = np.array(self._encode(k) if k else [], np.uint32)
            self.base.update(zip([k], self._append(ids, np.array([len(ids)]))))

    def _entries(self, names: pa.Array) -> np.ndarray:
        """Entries of the strings, which are learnt if they are new."""
        coded = names.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        at = np.fromiter(map(self.base.get, distinct, repeat(0)), np.int64, len(distinct))
        self.again[at] = True
        if (miss := np.flatnonzero(at == 0)).size:
            missing = [distinct[i] for i in miss.tolist()]
            self._learn(missing, pc.match_substring_regex(coded.dictionary.take(pa.array(miss)), _LATIN).to_pylist())
            at[miss] = np.fromiter(map(self.base.__getitem__, missing), np.int64, len(missing))
        return at[coded.indices.to_numpy()]

    def _runs(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Two entries for each chunk. A Latin word goes by its lower-case form, as the vocabulary lower-cases, and
        the marks at its end by themselves (entry 0, of no ids, where there are none); other chunks go whole."""
        body = pc.ascii_rtrim(chunks, _MARKS)
        word = pc.match_substring_regex(body, _LATIN)
        first = self._entries(pc.if_else(word, pc.utf8_lower(body), chunks))
        second = np.zeros(len(chunks), np.int64)
        trimmed = pc.subtract(pc.binary_length(chunks), pc.binary_length(body)).to_numpy()
        if (marked := np.flatnonzero(word.to_numpy(zero_copy_only=False) & (trimmed > 0))).size:
            n, ends = trimmed[marked], np.frombuffer(chunks.buffers()[1], np.int32)[chunks.offset + 1 :][marked]
            text = np.frombuffer(chunks.buffers()[2], np.uint8)[np.repeat(ends - n, n) + ragged(n)]
            offsets = np.append(0, np.cumsum(n)).astype(np.int32)
            second[marked] = self._entries(pa.StringArray.from_buffers(len(n), pa.py_buffer(offsets), pa.py_buffer(text)))
        return first, second

    def _look_up(self, texts: pa.Array, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        if len(self.base) > self.most:
            self._prune()
        split = pc.ascii_split_whitespace(texts)
        offsets = split.offsets.to_numpy()
        coded = split.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        offsets = offsets - offsets[0]
        # Ids of the distinct chunks one after another, then those of all chunks from there.
        runs = self._runs(coded.dictionary)
        n1, n2 = (self.length[at] for at in runs)
        n = n1 + n2
        starts = np.cumsum(n) - n
        table = np.zeros(int(n.sum()), np.uint32)
        for at, own, to in ((runs[0], n1, starts), (runs[1], n2, starts + n1)):
            inner = ragged(own)
            table[np.repeat(to, own) + inner] = self.flat[np.repeat(self.start[at], own) + inner]
        starts, n = starts.astype(np.int32), n.astype(np.int32)
        word = coded.indices.to_numpy()
        if end_id is not None:  # one more entry, at the end of each text
            starts, n, table = np.append(starts, np.int32(len(table))), np.append(n, np.int32(1)), np.append(table, np.uint32(end_id))
            word = np.insert(word, offsets[1:], len(starts) - 1)
            offsets = offsets + np.arange(len(offsets))
        n = n[word]
        before = np.zeros(len(n) + 1, np.int32)
        np.cumsum(n, out=before[1:])
        place = np.repeat(starts[word] - before[:-1], n)
        place += np.arange(before[-1], dtype=np.int32)
        return table.take(place), before[offsets].astype(np.int64)

    def encode_column(self, texts: pa.Array, end_id: int | None = None, group_bytes: int = 12_000_000) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each group of texts of about `group_bytes`: its first row, the ids of its texts one after another, and
        where each begins (with the end of the last)."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + group_bytes, "right")))
            yield lo, *self._look_up(texts.slice(lo, hi - lo), end_id)
            lo = hi

    def encode(self, text: str | None) -> np.ndarray:
        return next(self.encode_column(pa.array([text], pa.string())))[1]


def encoder(path: str) -> ChunkEncoder:
    """One for each Python worker and vocabulary. It stays in the worker through all later steps: see `forget`."""
    if path not in _KEPT:
        _KEPT[path] = ChunkEncoder(path)
    return _KEPT[path]
