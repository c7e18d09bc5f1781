"""Token ids by the tokenizers library, with a bounded memory of pieces already encoded.

A worker keeps one encoder, of bounded bytes, for the tasks of one operator after another (see `common.kept`): the first
task of any other operator frees it, so what operators keep never adds up in a worker.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from .common import kept

DEFAULT_VOCABULARY = "byte_bpe_50k.json"
#: Bytes of pieces that an encoder keeps; where they are full it goes on with those it has met again, which changes speed only.
MAX_BYTES = 96 << 20
#: Pieces that go through the library as one text.
LINES = 32
#: Bytes of text encoded at once.
SLICE_BYTES = 3 << 20
#: Texts in which a blank meets other white space or an end, with long runs of newlines or two at the end, or that
#: hold rarer white space or the marks below.
_UNSAFE = r"  | \n|\n |\A | \z|\n\n\n|\n\n\z|[\x00\x01\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: ASCII punctuation at a piece's end, after a Latin letter or a digit.
_ENDED = re.compile(r"(.*[0-9A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f])([!-/:-@\[-`{-~]+)\Z", re.S).match


def vocabulary_path(name: str = DEFAULT_VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _spread(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All places of the runs of n that begin at starts."""
    ends = np.cumsum(n)
    at = np.arange(int(ends[-1]) if len(ends) else 0)
    at += np.repeat(starts - (ends - n), n)
    return at


class Pieces:
    """Ids of pieces by the pieces' 128-bit hashes, in arrays: an open hash table and the ids, some 60 bytes for each."""

    def __init__(self, max_bytes: int = MAX_BYTES):
        self.max_bytes = max_bytes
        self.clear()

    def clear(self) -> None:
        self._room(1 << 12)
        self.store, self.used = np.zeros(1 << 14, dtype=np.uint32), 0

    def _room(self, slots: int) -> None:
        self.keys, self.checks = np.zeros(slots, np.uint64), np.zeros(slots, np.uint64)
        self.starts, self.sizes, self.count = np.zeros(slots, np.uint32), np.zeros(slots, np.uint32), 0
        self.again = np.zeros(slots, bool)

    @property
    def nbytes(self) -> int:
        return 25 * len(self.keys) + self.store.nbytes

    def renew(self) -> None:
        """Keeps the pieces that were met again since the last time; none where that frees less than half."""
        at = np.flatnonzero(self.again)
        if 2 * len(at) > self.count:
            return self.clear()
        h, sizes = np.stack([self.keys[at], self.checks[at]], axis=1), self.sizes[at]
        flat = self.store[_spread(self.starts[at].astype(np.int64), sizes.astype(np.int64))]
        self.clear()
        self.add(h, flat, sizes)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The slot of each hash (a row of two words), -1 where it isn't known."""
        out = np.full(len(h), -1, dtype=np.int64)
        mask = len(self.keys) - 1
        rest, slot = np.arange(len(h)), (h[:, 0] & np.uint64(mask)).astype(np.int64)
        while len(rest):
            k = self.keys[slot]
            hit = (k == h[rest, 0]) & (self.checks[slot] == h[rest, 1])
            out[rest[hit]] = slot[hit]
            on = ~hit & (k != 0)
            rest, slot = rest[on], slot[on] + 1 & mask
        return out

    def _put(self, h: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
        mask = len(self.keys) - 1
        rest, slot = np.arange(len(h)), (h[:, 0] & np.uint64(mask)).astype(np.int64)
        while len(rest):
            free = self.keys[slot] == 0
            self.starts[slot[free]] = rest[free]  # of several that want a slot the last one written gets it
            won = free & (self.starts[slot] == rest)
            at, i = slot[won], rest[won]
            self.keys[at], self.checks[at], self.starts[at], self.sizes[at] = h[i, 0], h[i, 1], starts[i], sizes[i]
            rest, slot = rest[~won], slot[~won] + 1 & mask
        self.count += len(h)

    def add(self, h: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> None:
        """New pieces, each hash once, with their ids end to end."""
        if 3 * (self.count + len(h)) > 2 * len(self.keys):
            kept = np.flatnonzero(self.keys)
            old, again = (np.stack([self.keys[kept], self.checks[kept]], axis=1), self.starts[kept], self.sizes[kept]), self.again[kept]
            self._room(1 << (3 * (self.count + len(h)) // 2).bit_length())
            self._put(*old)
            self.again[self.find(old[0][again])] = True
        if self.used + len(flat) > len(self.store):
            self.store = np.concatenate([self.store[: self.used], np.zeros(self.used // 2 + 2 * len(flat), np.uint32)])
        self.store[self.used : self.used + len(flat)] = flat
        self._put(h, self.used + np.cumsum(sizes) - sizes, sizes)
        self.used += len(flat)


def _listed(pieces: pa.Array) -> list[str]:
    """Pieces, which hold no blank, as Python's strings: one split of them all, in place of an object of Arrow's for each."""
    one = pa.ListArray.from_arrays(pa.array([0, len(pieces)], pa.int32()), pieces)
    return pc.binary_join(one, pa.scalar(" ", pieces.type))[0].as_py().split(" ") if len(pieces) else []


def _hashed(pieces: Sequence[str]) -> np.ndarray:
    h = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, pieces)), np.uint64).reshape(-1, 2).copy()
    h[:, 0] |= np.uint64(1) << np.uint64(63)  # 0 is an empty slot
    return h


class Encoder:
    """Ids equal to those of tokenizers' encode(text, add_special_tokens=False).

    The vocabulary's pre-tokenizer never joins what stands on both sides of a single blank between two
    characters that aren't white space; the blank goes with what follows. A newline there, or each of two, stands
    alone. So such texts are split at blanks and newlines, and each distinct piece goes through the library once.
    All other texts, and texts that hold a special token's string, go through the library whole.
    """

    def __init__(self, path: str, max_bytes: int = MAX_BYTES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pieces = Pieces(max_bytes)
        self.newline = self._library(["\n"])[0]

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts straight from the library, and each text's number of ids."""
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(ids), dtype=np.uint32), np.fromiter(map(len, ids), np.int64, len(ids))

    def library(self, texts: list[str]) -> list[np.ndarray]:
        flat, n = self._library(texts)
        return np.split(flat, np.cumsum(n)[:-1]) if len(n) else []

    def _lines(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of pieces, which hold no white space but a blank before them, many in a text.

        Each ends with a newline there, which stands alone before a blank and a piece, before a piece and at the end. Where that
        doesn't show in the ids, as of an empty piece or by another vocabulary, each piece is a text.
        """
        if len(self.newline) == 1:
            flat, n = self._library(["\n".join(pieces[i : i + LINES]) + "\n" for i in range(0, len(pieces), LINES)])
            ends = np.flatnonzero(flat == self.newline)
            last = np.minimum(LINES * np.arange(1, len(n) + 1), len(pieces)) - 1
            if all(pieces) and len(ends) == len(pieces) and (ends[last] + 1 == np.cumsum(n)).all():
                return np.delete(flat, ends), np.diff(ends, prepend=-1) - 1
        return self._library(pieces)

    def _places(self, distinct: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each piece begin in the store, and how many they are."""
        known = self.pieces
        if known.nbytes > known.max_bytes:
            known.renew()
        h = _hashed(distinct)
        at = known.find(h)
        known.again[at[at >= 0]] = True
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new = [distinct[i] for i in missing]
            # Punctuation after a letter or digit is a piece of its own, so that words meet with and without it.
            ended = [(i, m[1], "\0" + m[2]) for i, p in zip(missing.tolist(), new, strict=True) if (m := _ENDED(p))]
            if ended:
                whole, stems, marks = zip(*ended, strict=True)
                apart = set(whole)
                self._learn([*{distinct[i] for i in missing.tolist() if i not in apart}.union(stems, marks)])
                parts = [known.find(_hashed(x)) for x in (stems, marks)]
                two = np.stack(parts, axis=1).ravel()
                n = known.sizes[two].astype(np.int64)
                own = np.array(whole)
                # A stem that is learnt just now may itself be one of the wholes.
                fresh = known.find(h[own]) < 0
                keep = np.repeat(fresh, 2)
                known.add(h[own[fresh]], known.store[_spread(known.starts[two[keep]].astype(np.int64), n[keep])], (n[::2] + n[1::2])[fresh])
            else:
                self._learn(new)
            at = known.find(h)
        return known.starts[at].astype(np.int64), known.sizes[at].astype(np.int64)

    def _learn(self, pieces: list[str]) -> None:
        h = _hashed(pieces)
        at = self.pieces.find(h)
        self.pieces.again[at[at >= 0]] = True
        missing = np.flatnonzero(at < 0)
        # NUL marks a piece that has no blank before it: a text's or a line's first; alone it is an empty line. \1 is a newline.
        apart = [i for i in missing.tolist() if pieces[i] in ("\0", "\1")]
        if apart:
            self.pieces.add(h[apart], *self._library(["\n" if pieces[i] == "\1" else "" for i in apart]))
            missing = np.setdiff1d(missing, apart)
        for i in range(0, len(missing), 20_000):
            at = missing[i : i + 20_000]
            part = [pieces[k] for k in at]
            self.pieces.add(h[at], *self._lines([p[1:] if p[0] == "\0" else " " + p for p in part]))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and n + 1 offsets into it. Null and empty texts have none."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        whole = pc.match_substring_regex(texts, _UNSAFE)
        for s in self.special:
            whole = pc.or_(whole, pc.match_substring(texts, s))
        whole = whole.to_numpy(zero_copy_only=False)
        apart = {int(i): None for i in np.flatnonzero(whole)}
        if apart:
            apart = dict(zip(apart, self.library([texts[i].as_py() for i in apart]), strict=True))
            texts = pc.if_else(pa.array(whole), "", texts)
        marked = pc.binary_join_element_wise(pa.scalar("\0", pa.large_string()), texts, pa.scalar("", pa.large_string()))
        lists = pc.split_pattern(pc.replace_substring(marked, "\n", " \1 \0"), " ")
        coded = lists.values.dictionary_encode()
        index = coded.indices.to_numpy()
        starts, n = self._places(_listed(coded.dictionary))
        n = n[index]
        ends = np.cumsum(n)
        ids = self.pieces.store[_spread(starts[index], n)]
        bounds = np.concatenate([[0], ends])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        if not apart:
            return ids, bounds
        parts = [apart[i] if i in apart else ids[bounds[i] : bounds[i + 1]] for i in range(len(texts))]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def encoding(path: str, max_bytes: int = MAX_BYTES) -> Encoder:
    """This worker's encoder."""
    return kept(("encoder", path, max_bytes), lambda: Encoder(path, max_bytes))


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `limit` bytes of text, of one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    begin, size = 0, 0
    for i, n in enumerate(sizes):
        if i > begin and size + n > limit:
            yield batch.slice(begin, i - begin)
            begin, size = i, 0
        size += int(n)
    if begin < batch.num_rows:
        yield batch.slice(begin)
