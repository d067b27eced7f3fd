"""Token ids by a public vocabulary, through the tokenizers library.

The library encodes; this module saves it from encoding the same word again.
Byte-level BPE splits a text before white space that follows a word, so the ids of
a text are those of its pieces (see :mod:`mercato.llm.words`) one after the other.
Pieces are encoded once per worker and looked up afterwards, many at a time. A text
that holds the content of an added token, which the library looks for before it
splits, is encoded whole.
"""

from __future__ import annotations

import functools
import json
import os
import re

import numpy as np

from mercato.llm.words import MOST_WORDS, Words, joined, pieces

#: Text that is encoded in one go.
BATCH_BYTES = 1 << 20
#: Pieces that go through the library in one string.
JOINED_PIECES = 10_000
#: Kinds of bytes whose runs are what the byte-level pattern finds in a word: letters
#: (A-Z, a-z, and in two bytes U+00C0 to U+00FF but for the signs U+00D7 and U+00F7), digits,
#: and ASCII signs but for the apostrophe, which contractions begin with.
_OTHER, _LETTER, _DIGIT, _SIGN, _SPACE = range(5)
_BYTES = np.arange(256)
_KIND = np.select(
    [np.isin(_BYTES | 32, np.arange(97, 123)) & (_BYTES < 128), (_BYTES > 47) & (_BYTES < 58), _BYTES == 32, (_BYTES > 32) & (_BYTES < 127) & (_BYTES != 39)],
    [_LETTER, _DIGIT, _SPACE, _SIGN],
    _OTHER,
).astype(np.uint8)
_LATIN = (_BYTES >= 0x80) & (_BYTES < 0xC0) & ~np.isin(_BYTES, [0x97, 0xB7])  # second bytes, after 0xC3
#: The characters that stand for bytes in byte-level vocabularies: printable ones for themselves.
_CHARS = _BYTES.astype("<u2")
_CHARS[~((_BYTES > 32) & (_BYTES < 127) | (_BYTES > 160) & (_BYTES != 173))] = np.arange(256, 324)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def bpe_tokenizer(path: str):
    """The tokenizer of ``path`` without the library's own word cache, which costs
    more than it saves here."""
    from tokenizers import Tokenizer
    from tokenizers.models import BPE

    found = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    found.model = BPE(vocab=model["vocab"], merges=merges, cache_capacity=0)
    return found


def _kinds(buf: np.ndarray) -> np.ndarray:
    kind = _KIND[buf]
    first = np.flatnonzero(buf[:-1] == 0xC3)
    first = first[_LATIN[buf[first + 1]]]
    kind[first] = kind[first + 1] = _LETTER
    return kind


def plain_words(parts: list[bytes]) -> np.ndarray:
    """Whether each piece is one space and a word of letters, digits and signs alone."""
    buf = np.frombuffer(b"".join([*parts, b"\0"]), np.uint8)  # a byte for empty pieces to begin at
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    begin = np.cumsum(size) - size
    kind = _kinds(buf)
    ok = np.isin(kind, [_LETTER, _DIGIT, _SIGN])
    ok[-1] = True
    ok[begin + size - 1] &= buf[begin + size - 1] != 0xC3  # a character of two bytes lies in one piece
    ok[begin] = kind[begin] == _SPACE
    return np.logical_and.reduceat(ok, begin) & (size > 1)


def cut_words(raw: bytes) -> str:
    """Plain words, joined, in the characters of byte-level vocabularies and cut, at
    each line feed, into the runs that the byte-level pattern finds in them: a run
    of one kind, the first of a word with the space before it."""
    buf = np.frombuffer(raw, np.uint8)
    kind = _kinds(buf)
    space = kind == _SPACE
    cut = space.copy()
    cut[1:] |= (kind[1:] != kind[:-1]) & ~space[:-1]
    out = np.full(len(buf) + int(cut.sum()), 10, "<u2")
    out[np.arange(len(buf)) + np.cumsum(cut)] = _CHARS[buf]
    return out.tobytes().decode("utf-16-le")


class Encoder:
    """Ids of texts as little-endian unsigned bytes, two an id if the vocabulary
    allows it, else four (``dtype``). With ``plain`` the contents of added tokens
    are ordinary text."""

    def __init__(self, path: str, most_words: int = MOST_WORDS, plain: bool = False):
        self.tokenizer = bpe_tokenizer(path)
        self.tokenizer.encode_special_tokens = plain
        vocab = self.tokenizer.get_vocab()  # with the added tokens
        self.added = [] if plain else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.any_added = re.compile(b"|".join(re.escape(t.encode()) for t in self.added)) if self.added else None
        self.dtype = "<u2" if max(vocab.values()) < 1 << 16 else "<u4"
        self.words = Words([self.dtype], most_words)
        spaced = [i for t, i in vocab.items() if t.startswith("Ġ")]
        self.spaced = np.zeros(max(vocab.values()) + 1, bool)  # ids of tokens that begin with a space
        self.spaced[spaced] = True
        self.model = self._model_alone()

    def _model_alone(self):
        """A tokenizer with this one's model that takes words as ``plain_words`` gives
        them, which saves the library its pattern and its own mapping of bytes; None
        for vocabularies that cut words in another way."""
        from tokenizers import Tokenizer, pre_tokenizers

        own = self.tokenizer.pre_tokenizer
        if self.tokenizer.normalizer or not isinstance(own, pre_tokenizers.ByteLevel) or own.add_prefix_space or not own.use_regex:
            return None
        if not all(t.special for t in self.tokenizer.get_added_tokens_decoder().values()):
            return None
        alone = Tokenizer(self.tokenizer.model)
        alone.pre_tokenizer = pre_tokenizers.Split("\n", "removed")
        return alone

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype=self.dtype) for x in found]

    def _spaced(self, part: list[bytes], plain: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, each with one space before it, and how many each has:
        they are joined, and the ids are cut again before each token that begins
        with a space. ``plain``: all of them are plain words."""
        raw = b"".join(part)
        if plain:
            ids = np.array(self.model.encode_batch_fast([cut_words(raw)], add_special_tokens=False)[0].ids, dtype=self.dtype)
        else:
            ids = self.whole([raw.decode(errors="replace")])[0]
        cuts = np.flatnonzero(self.spaced[ids])
        # words of different texts may only together make an added token
        if len(cuts) == len(part) and not (self.any_added and self.any_added.search(raw)):
            return ids, np.diff(np.append(cuts, len(ids)))
        return self._each(part)

    def _each(self, part: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = self.whole([p.decode(errors="replace") for p in part])
        return np.concatenate([np.zeros(0, self.dtype), *found]), np.array([len(x) for x in found], np.int64)

    def pieces_ids(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the pieces one after the other, how many each has)."""
        plain = plain_words(parts) if self.model else np.zeros(len(parts), bool)
        words, rest = np.flatnonzero(plain).tolist(), np.flatnonzero(~plain).tolist()
        single = [i for i in rest if (p := parts[i])[:1] == b" " and p[1:2] > b" " and len(p.split(None, 1)) == 1]
        spaced = set(single)
        other = [i for i in rest if i not in spaced]
        found = [self._spaced([parts[i] for i in those[at : at + JOINED_PIECES]], those is words) for those in (words, single) for at in range(0, len(those), JOINED_PIECES)]
        found.append(self._each([parts[i] for i in other]))
        ids, size = (np.concatenate(x) for x in zip(*found))
        if len(parts) in (len(words), len(single), len(other)):
            return ids, size
        # back to the order of ``parts``
        begin, order = np.cumsum(size) - size, np.argsort(np.array(words + single + other))
        size, begin = size[order], begin[order]
        return ids[np.repeat(begin - np.cumsum(size) + size, size) + np.arange(len(ids))], size

    def _make(self, parts: list[bytes]):
        return [self.pieces_ids(parts)]

    def arrays(self, texts, before: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, how many each has). ``texts`` is
        a list of strings or an Arrow column; null is empty."""
        buf, at = joined(texts, before)
        begin = pieces(buf, at)
        ids, size = self.words.gather(0, self.words.numbers(buf, begin, self._make))
        ends = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(begin, at)]
        if self.any_added and (raw := buf.tobytes()) and (found := [m.start() for m in self.any_added.finditer(raw)]):
            held = np.unique(np.searchsorted(at, found, "right") - 1).tolist()
            split = [ids[a:b] for a, b in zip(ends, ends[1:])]
            for i, x in zip(held, self.whole([raw[at[i] : at[i + 1]].decode(errors="replace") for i in held])):
                split[i] = x
            return np.concatenate(split), np.array([len(x) for x in split], np.int64)
        return ids, np.diff(ends)

    def encode(self, texts, end_id: int | None = None) -> list[bytes]:
        """The ids of each text, with ``end_id`` after them if given."""
        ids, sizes = self.arrays(texts)
        end = b"" if end_id is None else np.array([end_id], self.dtype).tobytes()
        raw, ends = ids.tobytes(), (np.cumsum(sizes) * ids.itemsize).tolist()
        return [raw[a:b] + end for a, b in zip([0, *ends], ends)]


@functools.lru_cache(maxsize=1)
def encoder(path: str, most_words: int = MOST_WORDS) -> Encoder:
    """One encoder for each worker process, on one thread as a task has one core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path, most_words)


def in_batches(ids, texts, most: int = BATCH_BYTES, rows: int = 1 << 16):
    """(ids, texts) of consecutive rows, as slices of both Arrow columns, with about
    ``most`` bytes and at most ``rows`` rows together."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    at, total = 0, 0
    for i, n in enumerate([*sizes, 0]):
        if i == len(sizes) or (total and total + n > most) or i - at == rows:
            if i > at:
                yield ids.slice(at, i - at), texts.slice(at, i - at)
            at, total = i, 0
        total += n
