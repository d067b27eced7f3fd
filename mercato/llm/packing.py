"""Order-preserving packing by dynamic programming.

Documents stay in the order of their rows. Their tokens form one stream, which
is cut into windows of at most ``WINDOW`` tokens at document ends or sentence
ends, so that the padding plus a penalty for every cut inside a document is
least. With ``f(j)`` the least cost of a cut at position ``c[j]``,

    f(j) = penalty(j) + WINDOW_COST + min over c[j] - c[i] <= WINDOW of f(i) + padding

the padding ``WINDOW - (c[j] - c[i])`` splits into a part of ``j`` and a part of
``i``, so the minimum is that of ``f(i) + c[i]`` over a window that only moves
on: a monotone queue gives it in constant time. A window whose length is a power
of two needs no padding; those lengths are looked up beside the queue. Every
window costs a little, so that short ones are no end in themselves.

Where a sentence is longer than a window, cuts inside it are allowed at a higher
penalty. Each task packs its own rows as a stream: batches are solved one after
the other and the last window of each is carried into the next, so memory is
bounded by a batch plus the longest document and nothing is shuffled.

Defined cases: a null text is empty and has the end id only; null and repeated
ids are packed like any others; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import functools
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.llm.tokens import default_vocabulary, encoder, in_batches
from mercato.llm.words import MOST_WORDS

WINDOW = 1024
END_ID = 0
#: Cost of a cut inside a document, in tokens of padding.
SENTENCE_CUT, INNER_CUT = 1, 8
#: Cost of a window, and the shortest power of two that is sought.
WINDOW_COST, LEAST_POWER = 8, 64
#: Least distance of the sentence ends that are considered, on average.
LEAST_STEP = 8
#: Distance of the cuts allowed inside a sentence longer than a window.
INNER_STEP = 64
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@functools.cache
def sentence_end_ids(vocabulary: str, most_words: int = MOST_WORDS) -> np.ndarray:
    """Marks of the ids after which a sentence has ended; once for each worker process."""
    vocab = encoder(vocabulary, most_words).tokenizer.get_vocab()
    marks = np.zeros(max(vocab.values()) + 1, bool)
    marks[[i for t, i in vocab.items() if t[-1] in ".!?Ċ"]] = True  # the last: a line feed
    return marks


def allowed_cuts(ids: np.ndarray, ends: np.ndarray, marks: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Positions where the stream may be cut, 0 first, and their penalties."""
    n = len(ids)
    is_end, allowed, inner = np.zeros(n + 1, bool), np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    is_end[ends] = True
    after = np.flatnonzero(marks[np.minimum(ids, len(marks) - 1)]) + 1
    # of sentence ends that crowd together the last in each stretch of LEAST_STEP ids
    allowed[after[np.append(np.diff(after // LEAST_STEP) > 0, True)] if len(after) else after] = True
    allowed |= is_end
    allowed[0] = True
    cuts = np.flatnonzero(allowed)
    for i in np.flatnonzero(np.diff(cuts) > window):
        inner[cuts[i] + INNER_STEP : cuts[i + 1] : INNER_STEP] = True
    if inner.any():
        cuts = np.flatnonzero(allowed | inner)
    penalty = np.where(is_end[cuts] | (cuts == 0), 0, np.where(inner[cuts], INNER_CUT, SENTENCE_CUT))
    return cuts, penalty


def least_cost_cuts(cuts: list[int], penalty: list[int], window: int = WINDOW) -> list[int]:
    """The cuts of the cheapest windows, from 0 to the last of ``cuts``."""
    n = len(cuts)
    cost, back = [0] * n, [0] * n
    at = {c: i for i, c in enumerate(cuts)}
    powers = [1 << k for k in range(window.bit_length()) if LEAST_POWER <= 1 << k < window]
    queue: deque[int] = deque([0])  # rising index and rising cost + cut
    key = [0] * n
    for j in range(1, n):
        c = cuts[j]
        low = c - window
        while cuts[queue[0]] < low:
            queue.popleft()
        i = queue[0]
        best = key[i] + window - c
        for p in powers:
            k = at.get(c - p)
            if k is not None and cost[k] < best:
                best, i = cost[k], k
        cost[j], back[j] = best + penalty[j] + WINDOW_COST, i
        key[j] = v = cost[j] + c
        while queue and key[queue[-1]] >= v:
            queue.pop()
        queue.append(j)
    path = [n - 1]
    while path[-1]:
        path.append(back[path[-1]])
    return [cuts[i] for i in reversed(path)]


class Packer:
    """Packs one task's documents, batch after batch."""

    def __init__(self, first_sequence: int, marks: np.ndarray, window: int = WINDOW):
        self.sequence, self.marks, self.window = first_sequence, marks, window
        #: What is not yet in a window: (doc_id, ids, start in the document, tokens of the document).
        self.held: list[tuple[int | None, np.ndarray, int, int]] = []

    def add(self, doc_ids: list, coded: list[bytes], last: bool = False, dtype: str = "<u4") -> list[tuple]:
        docs = self.held + [(d, (x := np.frombuffer(c, dtype)), 0, len(x)) for d, c in zip(doc_ids, coded)]
        if not docs:
            return []
        ids = np.concatenate([d[1] for d in docs])
        ends = np.cumsum([len(d[1]) for d in docs])
        cuts, penalty = allowed_cuts(ids, ends, self.marks, self.window)
        chosen = least_cost_cuts(cuts.tolist(), penalty.tolist(), self.window)
        done = chosen if last else chosen[:-1]
        raw, ends = ids.astype("<u4").tobytes(), ends.tolist()
        out, k, begin = [], 0, 0  # document k begins at ``begin``
        for a, b in zip(done, done[1:]):
            at = a
            while at < b:
                if ends[k] <= at:
                    begin, k = ends[k], k + 1
                    continue
                to = min(b, ends[k])
                out.append((docs[k][0], docs[k][2] + at - begin, to - at, zlib.crc32(raw[4 * at : 4 * to]), docs[k][3], self.sequence, at - a))
                at = to
            self.sequence += 1
        upto = done[-1]
        while k < len(docs) and ends[k] <= upto:
            begin, k = ends[k], k + 1
        self.held = [(d[0], d[1][cut:], d[2] + cut, d[3]) for i, d in enumerate(docs[k:]) for cut in [max(0, upto - begin) if i == 0 else 0]]
        return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, window: int = WINDOW, end_id: int = END_ID, most_words: int = MOST_WORDS) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    ``most_words`` bounds what the encoder remembers, at about 100 bytes each."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, marks = encoder(path, most_words), sentence_end_ids(path, most_words)
        packer = Packer(TaskContext.get().partitionId() << 36, marks, window)

        def table(pieces: list[tuple]) -> pa.RecordBatch:
            columns = zip(*pieces) if pieces else [[] for _ in range(7)]
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], [c.split()[0] for c in PIECES.split(", ")])

        for batch in batches:
            for ids, texts in in_batches(batch.column(0), batch.column(1)):
                yield table(packer.add(ids.to_pylist(), enc.encode(texts, end_id), dtype=enc.dtype))
        yield table(packer.add([], [], last=True))

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, PIECES)
