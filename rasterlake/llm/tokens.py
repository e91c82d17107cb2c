r"""Token ids of whole texts by the ``tokenizers`` library, with repeated pieces encoded once.

The byte-level pre-tokeniser never joins characters across a single space that stands
between two characters that are not white space: a match that starts there takes the
space with it, and a match from before holds no white space to reach past it. So a text
is cut before each such space (where in doubt about a character, it isn't cut), each
distinct piece is encoded once by the library, and the ids are put together. They equal
those of the whole text; a test holds them against it. Pieces of at most ``LONGEST`` bytes are
known again by a 64-bit hash of their bytes under a key that each worker draws at random, so
no text can make two pieces collide; longer ones are encoded each time. A piece of common
characters is split by the pre-tokeniser's published pattern and goes straight to the library's
merge model; any other, and any that holds the string of a special token, goes through the
whole tokeniser, which gives such a string the special token's id.
"""

from __future__ import annotations

import os
import re
import secrets
import struct

import numpy as np
import pyarrow as pa
import regex

from rasterlake.llm import text as tx

#: Slots of a worker's table of known pieces (refilled from empty when over half full),
#: parts of pieces kept as strings, and the longest piece (bytes) that is kept.
SLOT_BITS, KEPT_PARTS, LONGEST = 20, 250_000, 64
#: Pieces hashed together.
_TOGETHER = 1 << 15
SLOTS = 1 << SLOT_BITS
#: ASCII and Latin-1 letters, digits and signs: there all Unicode versions agree on the classes.
_PLAIN = re.compile("[ -~¡-¬®-ÿ\\n]*").fullmatch
_PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
_MULT = np.uint64(0x9E3779B97F4A7C15)


def _byte_letters() -> dict[int, str]:
    """For characters below 256: their UTF-8 bytes as the letters that byte-level vocabularies write."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in set(shown))}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(256)}


_BYTES = _byte_letters()


def cuts(b: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte places where pieces start, and for each text the place of its first piece (one more at the end)."""
    n = len(b)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    low = b <= 32
    lead = (b == 0xE1) | (b == 0xE2) | (b == 0xE3) | (b == 0xEF)
    latin = np.zeros(n, dtype=bool)  # the second byte of U+0085 and U+00A0
    latin[1:] = (b[:-1] == 0xC2) & ((b[1:] == 0x85) | (b[1:] == 0xA0))
    ends = low | latin
    ends[2:] |= lead[:-2]
    begins = low | lead
    begins[:-1] |= latin[1:]
    cut = b == 32
    cut[0] = cut[-1] = False
    cut[1:] &= ~ends[:-1]
    cut[:-1] &= ~begins[1:]
    inner = offsets[(offsets > 0) & (offsets < n)]
    cut[inner - 1] = False  # the last byte of a text
    cut[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    starts = np.flatnonzero(cut)
    return starts, np.searchsorted(starts, offsets)


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tx.lean()

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if any(re.search(r"\s", t) for t in added):
            raise ValueError("an added token with white space could reach across pieces")
        self.added = re.compile("|".join(map(re.escape, added)) or "(?!)").search
        self.added_bytes = re.compile(b"|".join(re.escape(t.encode()) for t in added) or b"(?!)").search
        self.secret = np.frombuffer(secrets.token_bytes(16 * (LONGEST // 4 + 1)), dtype=np.uint64).reshape(2, -1)
        self.parts: dict[str, bytes] = {}
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(SLOTS, dtype=np.uint64)
        self.at = np.zeros(SLOTS, dtype=np.int64)
        self.n = np.zeros(SLOTS, dtype=np.int32)
        self.pool, self.used, self.filled = np.zeros(1 << 18, dtype=np.uint32), 0, 0

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The slot of each hash, or -1."""
        out = np.full(len(h), -1, dtype=np.int64)
        slot = ((h * _MULT) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        left = np.arange(len(h))
        while len(left):
            key = self.keys[slot]
            hit = (key == h[left]) & (key != 0)
            out[left[hit]] = slot[hit]
            on = ~hit & (key != 0)
            left, slot = left[on], (slot[on] + 1) & (SLOTS - 1)
        return out

    def _put(self, h: np.ndarray, at: np.ndarray, n: np.ndarray) -> None:
        """Distinct hashes that aren't there."""
        slot = ((h * _MULT) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        left = np.arange(len(h))
        while len(left):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = h[left[free]]
            own = self.keys[slot] == h[left]
            self.at[slot[own]], self.n[slot[own]] = at[left[own]], n[left[own]]
            left, slot = left[~own], (slot[~own] + 1) & (SLOTS - 1)
        self.filled += len(h)

    def _add(self, ids: bytes) -> None:
        new = np.frombuffer(ids, dtype="<u4")
        while self.used + len(new) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), dtype=np.uint32)])
        self.pool[self.used : self.used + len(new)] = new
        self.used += len(new)

    def _part(self, part: str) -> bytes:
        got = self.parts.get(part)
        if got is None:
            ids = [x.id for x in self.merge(part.translate(_BYTES))]
            got = struct.pack(f"<{len(ids)}I", *ids)
            if len(part) <= LONGEST:
                self.parts[part] = got
        return got

    def _learn(self, pieces: list[str], special: bool) -> list[bytes]:
        """Ids of pieces; ``special``: some of them may hold an added token."""
        if len(self.parts) > KEPT_PARTS:
            self.parts.clear()
        out, part = [], self._part
        for p in pieces:
            if not _PLAIN(p) or special and self.added(p):
                out.append(np.array(self.tokenizer.encode(p, add_special_tokens=False).ids, dtype="<u4").tobytes())
            elif p[:1] == " " and p[1:].isalpha():
                out.append(part(p))
            else:
                out.append(b"".join(map(part, _PARTS(p))))
        return out

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (null: none), one text after the other, and where each text's ids start."""
        b, offsets = tx.raw(column)
        starts, first = cuts(b, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        ends = np.append(starts[1:], len(b))
        h = np.zeros(len(starts), dtype=np.uint64)  # 0: a long piece, that isn't kept
        short = np.flatnonzero(ends - starts <= LONGEST)
        for i in range(0, len(short), _TOGETHER):
            own = short[i : i + _TOGETHER]
            lo, hi = starts[own[0]], ends[own[-1]]
            h[own] = tx.secret_digests(b[lo:hi], starts[own] - lo, ends[own] - lo, self.secret) | np.uint64(1)
        if self.filled > SLOTS // 2:
            self._clear()
        slot = self._find(h)
        at, n = self.at[slot], self.n[slot].astype(np.int64)
        if len(missing := np.flatnonzero(slot < 0)):
            seen, one, back = np.unique(h[missing], return_index=True, return_inverse=True)
            if seen[0] == 0:  # long pieces: each for itself
                giants = missing[h[missing] == 0]
                one, back = np.append(one[1:], np.flatnonzero(h[missing] == 0)), back - 1
                back[h[missing] == 0] = len(seen) - 1 + np.arange(len(giants))
                seen = np.append(seen[1:], np.zeros(len(giants), np.uint64))
            which, data = missing[one], b.tobytes()
            ids = self._learn([data[s:e].decode() for s, e in zip(starts[which].tolist(), ends[which].tolist())], self.added_bytes(data) is not None)
            size = np.array([len(x) // 4 for x in ids], dtype=np.int64)
            kept = seen != 0
            order = np.argsort(~kept, kind="stable")
            place = np.empty(len(ids), dtype=np.int64)
            place[order] = self.used + np.cumsum(size[order]) - size[order]
            self._add(b"".join(ids[i] for i in order))
            at[missing], n[missing] = place[back], size[back]
            room = SLOTS * 3 // 4 - self.filled
            keep = np.flatnonzero(kept)[:room]
            self._put(seen[keep], place[keep], size[keep])
            spare = int(size[~kept].sum())
        else:
            spare = 0
        upto = np.cumsum(n)
        out = self.pool[np.repeat(at - (upto - n), n) + np.arange(upto[-1])]
        self.used -= spare
        return out, np.append(0, upto)[first]


def encoder(path: str) -> Encoder:
    """One for each worker process, until the worker turns to words."""
    if path not in tx.KEPT:
        tx.KEPT[path] = Encoder(path)
    return tx.KEPT[path]
