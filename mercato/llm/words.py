"""Words of texts, found again by number.

A text, as UTF-8 bytes, is cut before white space that ends a word, so a piece is
the white space before a word and the word. Both kinds of vocabulary used here
encode a text piece by piece: nothing of a piece reaches across such a cut.
:class:`Words` gives every piece it has seen a number, with one numpy hash table
and no Python object per piece, and holds what belongs to a number in flat arrays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Longest piece that is remembered: three and a half 64-bit keys and its length.
KEY_BYTES = 31
#: Pieces remembered for each worker process, about 60 bytes each.
MOST_WORDS = 1 << 19
_FIRST = 1 << 14

_BYTES = np.arange(256)
#: Where a piece may begin; not at a carriage return, which pieces of some vocabularies end with.
_CUT = np.isin(_BYTES, [9, 10, 32])
#: Bytes that are never part of a white-space character.
_SOLID = (_BYTES > 32) & (_BYTES < 128)
#: First bytes of a character that is surely no white space (U+0085, U+00A0, U+1680,
#: U+2000 to U+205F and U+3000 begin with the other ones).
_OPENS = (_BYTES > 32) & ~np.isin(_BYTES, [0xC2, 0xE1, 0xE2, 0xE3])


def joined(texts, before: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, where each begins and the last ends). ``texts`` is a
    list of strings or an Arrow column; null is empty. ``before`` is put before
    each text."""
    if isinstance(texts, pa.Array):
        if before or texts.null_count or not pa.types.is_string(texts.type):
            texts = [x.as_buffer() if x.is_valid else b"" for x in texts.cast(pa.large_string()).cast(pa.large_binary())]
        else:
            at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
            if not len(texts) or at[0] == at[-1]:
                return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
            return np.frombuffer(texts.buffers()[2], np.uint8)[at[0] : at[-1]], at - at[0]
    raw = [t.encode() if isinstance(t, str) else t or b"" for t in texts]
    sizes = np.fromiter((len(r) + len(before) for r in raw), np.int64, len(raw))
    whole = b"".join(x for r in raw for x in (before, r)) if before else b"".join(raw)
    return np.frombuffer(whole, np.uint8), np.concatenate([[0], np.cumsum(sizes)])


def pieces(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where the pieces of the texts ``buf[at[i]:at[i + 1]]`` begin, ascending,
    and ``len(buf)`` last. Empty texts have none."""
    if not len(buf):
        return np.zeros(1, np.int64)
    ends = np.zeros(len(buf) + 1, bool)
    ends[at] = True
    p = np.flatnonzero(_CUT[buf[1:]]) + 1  # a first byte begins a piece anyhow
    last, here = buf[p - 1], buf[p]
    after = buf[np.minimum(p + 1, len(buf) - 1)]
    # beside a character outside ASCII, which may be white space, only a single space
    cut = _SOLID[last] | ((last >= 128) & (here == 32) & _OPENS[after] & ~ends[p + 1])
    begin = np.zeros(len(buf) + 1, bool)
    begin[p[cut]] = True
    begin |= ends
    return np.flatnonzero(begin)


class Words:
    """Numbers of pieces, with columns of values for each number.

    ``values[c]`` holds column ``c`` of all numbers, one after the other;
    ``begin[c]`` and ``size[c]`` say where. Pieces that are too long, or come when
    the table is full, get numbers that hold until ``forget``. At the start of a
    batch a full table drops the half it met least often."""

    def __init__(self, dtypes: list, most: int = MOST_WORDS):
        self.most, self.dtypes = most, dtypes
        self.slots = np.full(1 << max(8, (2 * most - 1).bit_length()), -1, np.int32)
        self.shift = np.uint64(65 - len(self.slots).bit_length())
        self.kept = self.n = 0
        self.keys, self.met = np.zeros((_FIRST, 4), np.uint64), np.zeros(_FIRST, np.int64)
        self.values = [np.zeros(_FIRST, d) for d in dtypes]
        self.used = [0 for _ in dtypes]
        self.begin = [np.zeros(_FIRST, np.int64) for _ in dtypes]
        self.size = [np.zeros(_FIRST, np.int32) for _ in dtypes]

    @staticmethod
    def _grown(a: np.ndarray, n: int) -> np.ndarray:
        if n <= len(a):
            return a
        out = np.zeros((max(n, len(a) * 3 // 2), *a.shape[1:]), a.dtype)
        out[: len(a)] = a
        return out

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        h = np.zeros(len(keys), np.uint64)
        for i in range(4):
            h = (h ^ keys[:, i]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return h * np.uint64(0xBF58476D1CE4E5B9)

    def _place(self, numbers: np.ndarray) -> None:
        """Enter ``numbers``, whose keys are new and differ, into the slots."""
        mask = np.uint64(len(self.slots) - 1)
        spot = self._hash(self.keys[numbers]) >> self.shift
        while len(numbers):
            free = self.slots[spot] < 0
            self.slots[spot[free]] = numbers[free]
            left = self.slots[spot] != numbers
            numbers, spot = numbers[left], (spot[left] + np.uint64(1)) & mask

    def _find(self, keys: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        mask = np.uint64(len(self.slots) - 1)
        out = np.full(len(keys), -1, np.int64)
        todo, spot = np.arange(len(keys)), hashes >> self.shift
        while len(todo):
            there = self.slots[spot]
            taken = there >= 0
            todo, spot, there = todo[taken], spot[taken], there[taken]
            same = (self.keys[there] == keys[todo]).all(axis=1)
            out[todo[same]] = there[same]
            todo, spot = todo[~same], (spot[~same] + np.uint64(1)) & mask
        return out

    def _halve(self) -> None:
        keep = np.sort(np.argpartition(-self.met[: self.kept], self.most // 2)[: self.most // 2])
        for c in range(len(self.dtypes)):
            values, size = self.gather(c, keep)
            self.values[c][: len(values)] = values
            self.used[c] = len(values)
            self.begin[c][: len(keep)], self.size[c][: len(keep)] = np.cumsum(size, dtype=np.int64) - size, size
        self.keys[: len(keep)], self.met[: len(keep)] = self.keys[keep], self.met[keep] // 2
        self.kept = self.n = len(keep)
        self.slots[:] = -1
        self._place(np.arange(len(keep)))

    def numbers(self, buf: np.ndarray, begin: np.ndarray, make) -> np.ndarray:
        """The number of each piece ``buf[begin[i]:begin[i + 1]]``.
        ``make(list of pieces as bytes)`` gives for each column of new pieces
        (values one after the other, how many each has)."""
        self.forget()
        if self.kept >= self.most:
            self._halve()
        starts, sizes = begin[:-1], np.diff(begin)
        short = np.flatnonzero(sizes <= KEY_BYTES)
        padded = np.concatenate([buf, np.zeros(32, np.uint8)])
        rows = np.lib.stride_tricks.sliding_window_view(padded, 32)[starts[short]]
        rows = rows * (np.arange(32) < sizes[short][:, None])
        rows[:, KEY_BYTES] = sizes[short]
        keys = np.ascontiguousarray(rows).view("<u8")
        hashes = self._hash(keys)
        out = np.full(len(starts), -1, np.int64)
        found = self._find(keys, hashes)
        out[short] = found
        hit = found[found >= 0]
        self.met[: self.kept] += np.bincount(hit, minlength=self.kept)[: self.kept]
        new = np.flatnonzero(found < 0)
        if len(new):
            _, first, back = np.unique(hashes[new], return_index=True, return_inverse=True)
            if not (keys[new] == keys[new[first[back]]]).all():  # two pieces of one hash
                _, first, back = np.unique(keys[new].view("V32").reshape(-1), return_index=True, return_inverse=True)
            at = new[first]
            self._append(buf, starts[short[at]], sizes[short[at]], make)
            kept = min(len(at), self.most - self.kept)
            count = self.n - len(at)
            self.keys = self._grown(self.keys, count + kept)
            self.met = self._grown(self.met, count + kept)
            self.keys[count : count + kept], self.met[count : count + kept] = keys[at[:kept]], 1
            self.kept += kept
            self._place(np.arange(count, count + kept))
            out[short[new]] = count + back
        long = np.flatnonzero(sizes > KEY_BYTES)
        if len(long):
            seen: dict[bytes, int] = {}
            raw, which = buf.tobytes(), []
            for i, s, n in zip(long.tolist(), starts[long].tolist(), sizes[long].tolist()):
                piece = raw[s : s + n]
                if piece not in seen:
                    seen[piece] = self.n + len(which)
                    which.append(i)
                out[i] = seen[piece]
            self._append(buf, starts[which], sizes[which], make)
        return out

    def _append(self, buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray, make) -> None:
        raw = buf.tobytes()
        made = make([raw[s : s + n] for s, n in zip(starts.tolist(), sizes.tolist())])
        end = self.n + len(starts)
        for c, (values, size) in enumerate(made):
            self.values[c] = self._grown(self.values[c], self.used[c] + len(values))
            self.values[c][self.used[c] : self.used[c] + len(values)] = values
            self.begin[c], self.size[c] = self._grown(self.begin[c], end), self._grown(self.size[c], end)
            size = np.asarray(size, np.int64)
            self.begin[c][self.n : end] = self.used[c] + np.cumsum(size) - size
            self.size[c][self.n : end] = size
            self.used[c] += len(values)
        self.n = end

    def forget(self) -> None:
        """Drop the numbers that are not kept."""
        if self.n > self.kept:
            for c in range(len(self.dtypes)):
                self.used[c] = int(self.begin[c][self.kept])
            self.n = self.kept

    def gather(self, column: int, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values of ``numbers`` one after the other, how many each has)."""
        size = self.size[column][numbers].astype(np.int64)
        ends = np.cumsum(size)
        at = np.repeat(self.begin[column][numbers] - ends + size, size)
        at += np.arange(len(at))
        return self.values[column][at], size
