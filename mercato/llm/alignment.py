"""Alignment of two vocabularies' tokens over a corpus, by external spill counting.

Every text, with a space before it, is encoded by a byte-level vocabulary (A) and by
a sentencepiece vocabulary (B). Byte offsets where tokens of both end cut the tokens
into groups; all A-B pairs of a group are linked. The count of a pair is the number
of documents that hold it linked, over the whole corpus, and each document gets the
sum of its links' counts and how many of its links are the best of their A token.

  1. Spill. A task encodes batches of texts. The (pair, document, links) records of a
     batch are sorted and radix-partitioned by the low bits of the A id; each part is
     one run, zstd frames in the shared folder.
  2. Count. Runs of a part are merged ``FAN`` at a time: a heap holds the last pair of
     each run's open frame, all pairs up to the least of them are complete and are
     added up. Merged runs are merged again until a part has one. No merge holds more
     than one frame of each run and what it writes, however common a pair is, and what
     it writes is bounded by the pairs the two vocabularies have.
  3. Contributions. The merged run of a part is in A-major order, so one pass gives the
     highest count of each A id. It is sent to each slice of ``FAN`` runs of the part,
     whose records stream past it; what they add to their documents goes back as one
     array for each run.

Defined cases: texts that are null or empty, and texts whose A or B tokens do not give
their bytes back (those with U+2581, for instance), have no tokens: zeros and an empty
string. Null and repeated ids are documents like any others; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import os
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.llm.shared import save
from mercato.llm.tokens import Encoder, default_vocabulary, in_batches
from mercato.llm.words import Words, joined, pieces

#: Parts of the records, a power of two: the low bits of the A id.
PART_BITS = 6
#: Runs that are merged at once.
FAN = 64
#: Entries of a zstd frame.
FRAME = 1 << 13
#: Text of a batch, so of the runs it makes.
BATCH_BYTES = 2 << 20
MEASURES = ("n_a", "n_b", "n_groups", "n_links")
_SPILL = "run long, part int, heads binary, tails binary, at int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string"


def default_second_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def framed(*columns: np.ndarray) -> bytes:
    """Columns of one length as zstd frames of ``FRAME`` entries each."""
    zip_, out = zstandard.ZstdCompressor(level=1), []
    for i in range(0, len(columns[0]), FRAME):
        frame = zip_.compress(b"".join(c[i : i + FRAME].tobytes() for c in columns))
        out += [np.array([min(FRAME, len(columns[0]) - i), len(frame)], "<u4").tobytes(), frame]
    return b"".join(out)


def frames(blob: bytes, *dtypes: str) -> Iterator[list[np.ndarray]]:
    """The frames of ``framed``, one after the other."""
    unzip, at = zstandard.ZstdDecompressor(), 0
    while at < len(blob):
        n, size = np.frombuffer(blob, "<u4", 2, at).tolist()
        raw, at, column, found = unzip.decompress(blob[at + 8 : at + 8 + size]), at + 8 + size, 0, []
        for d in dtypes:
            found.append(np.frombuffer(raw, d, n, column))
            column += n * np.dtype(d).itemsize
        yield found


def heads(codes: np.ndarray, counts: np.ndarray) -> bytes:
    """A run: ascending pair codes, as steps, and the documents of each."""
    return framed(np.diff(codes, prepend=0).astype("<u8"), counts.astype("<u8"))


def runs_frames(blob: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    last = 0
    for steps, counts in frames(blob, "<u8", "<u8"):
        codes = last + np.cumsum(steps.astype(np.int64))
        last = int(codes[-1])
        yield codes, counts.astype(np.int64)


def merged(runs: list[Iterator[tuple[np.ndarray, np.ndarray]]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The k-way merge of runs: ascending (codes, counts), every code once."""
    heap: list[tuple[int, int]] = []
    open_: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def load(i: int) -> None:
        frame = next(runs[i], None)
        open_.pop(i, None)
        if frame is not None:
            open_[i] = frame
            heapq.heappush(heap, (int(frame[0][-1]), i))

    for i in range(len(runs)):
        load(i)
    while heap:
        least = heap[0][0]  # up to here every run's codes are loaded
        codes, counts = [], []
        for i, (c, n) in open_.items():
            k = int(np.searchsorted(c, least, "right"))
            if k:
                codes.append(c[:k])
                counts.append(n[:k])
                open_[i] = c[k:], n[k:]
        while heap and heap[0][0] == least:
            load(heapq.heappop(heap)[1])
        found = np.concatenate(codes)
        order = np.argsort(found, kind="stable")
        found = found[order]
        first = np.flatnonzero(np.diff(found, prepend=-1))
        yield found[first], np.add.reduceat(np.concatenate(counts)[order], first)


class Aligner:
    """Groups and links of texts, piece by piece, each piece aligned once."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.a = Encoder(a_path, most_words=1, plain=True)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        names = self.a.tokenizer.get_vocab()
        # the bytes that a byte-level vocabulary writes as characters: printable ones
        # as themselves, the others from U+0100 on
        shown = [i for r in ((33, 127), (161, 173), (174, 256)) for i in range(*r)]
        byte = {chr(i): i for i in shown} | {chr(256 + n): i for n, i in enumerate(i for i in range(256) if i not in shown)}
        self.a_bytes = {i: bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t, i in names.items()}
        self.b_bytes = [self._piece(i) for i in range(len(self.b))]
        if any(c in self.b.id_to_piece(i).lstrip("▁") for i in range(len(self.b)) for c in "▁\t\n"):
            raise ValueError("a piece of the second vocabulary reaches across white space")
        self.guard = self.b.encode("x")
        self.b_bits = (len(self.b) - 1).bit_length()
        self.a_bits = max(max(names.values()).bit_length(), PART_BITS)
        self.words = Words([np.uint8, np.int64, np.int64, np.int64])

    def _piece(self, i: int) -> bytes:
        return bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()

    def code(self, a: int, b: int) -> int:
        """A pair's number: the part highest, then in A-major order."""
        part = a & (1 << PART_BITS) - 1
        return (part << self.a_bits - PART_BITS | a >> PART_BITS) << self.b_bits | b

    def aligned(self, piece: bytes, a: list[int], b: list[int]) -> tuple[str, dict[int, int], int]:
        """(groups, each after a semicolon; links of each pair; how many groups)."""
        ends_a = list(accumulate(len(self.a_bytes[i]) for i in a))
        ends_b = list(accumulate(len(self.b_bytes[i]) for i in b))
        if not a or not b or b"".join(self.a_bytes[i] for i in a) != piece or b"".join(self.b_bytes[i] for i in b) != piece:
            return "", {}, -1
        text, links, n, i, j = [], {}, 0, 0, 0
        both = set(ends_a).intersection(ends_b)
        while i < len(a):
            i1, j1 = i, j
            while ends_a[i1] not in both:
                i1 += 1
            while ends_b[j1] not in both:
                j1 += 1
            ga, gb, n = a[i : i1 + 1], b[j : j1 + 1], n + 1
            i, j = i1 + 1, j1 + 1
            text.append(f";{','.join(map(str, ga))}|{','.join(map(str, gb))}")
            if len(ga) == 1 and len(gb) == 1:
                c = self.code(ga[0], gb[0])
                links[c] = links.get(c, 0) + 1
                continue
            times_b = Counter(gb).items()
            for x, m in Counter(ga).items():
                for y, k in times_b:
                    c = self.code(x, y)
                    links[c] = links.get(c, 0) + m * k
        return "".join(text), links, n

    def _make(self, parts: list[bytes]):
        ids, size = self.a.pieces_ids(parts)
        ids, ends = ids.tolist(), np.cumsum(size).tolist()
        found = self.b.encode(["x" + p.decode(errors="replace") for p in parts], num_threads=1)
        texts, codes, times, rows = [], [], [], []
        for p, s, e, b in zip(parts, [0, *ends], ends, found):
            if b[: len(self.guard)] != self.guard:
                raise ValueError("a piece of the second vocabulary reaches across white space")
            b = b[len(self.guard) :]
            text, links, groups = self.aligned(p, ids[s:e], b)
            texts.append(text.encode())
            codes.append(links.keys())
            times.append(links.values())
            rows += [e - s, len(b), groups, sum(links.values()), groups < 0]
        sizes = [len(c) for c in codes]
        flat = [np.fromiter((x for c in v for x in c), np.int64, sum(sizes)) for v in (codes, times)]
        return [(np.frombuffer(b"".join(texts), np.uint8), [len(t) for t in texts]), (flat[0], sizes), (flat[1], sizes), (np.array(rows, np.int64), np.full(len(parts), 5))]

    def batch(self, texts: pa.Array, keep_groups: bool):
        """(measures of each text, its groups or their digest, and the records:
        codes, texts, links, ascending)."""
        buf, at = joined(texts, b" ")
        begin = pieces(buf, at)
        numbers = self.words.numbers(buf, begin, self._make)
        first = np.searchsorted(begin, at)
        rows = np.add.reduceat(self.words.gather(3, numbers)[0].reshape(-1, 5), first[:-1], axis=0)
        good = (rows[:, 4] == 0) & (np.diff(at) > 1)
        rows[~good] = 0
        digests = []
        for i, ok in enumerate(good.tolist()):
            groups = self.words.gather(0, numbers[first[i] : first[i + 1]])[0].tobytes()[1:] if ok else b""
            digests.append(groups.decode() if keep_groups or not ok else hashlib.sha256(groups).hexdigest())
        doc = np.repeat(np.arange(len(good)), np.diff(first))
        which = good[doc]
        pair, times = np.unique(doc[which] << 32 | numbers[which], return_counts=True)
        numbers, doc = pair & 0xFFFFFFFF, pair >> 32
        codes, size = self.words.gather(1, numbers)
        links = self.words.gather(2, numbers)[0] * np.repeat(times, size)
        doc = np.repeat(doc, size)
        order = np.lexsort((doc, codes)) if len(good) >= 1 << 16 or self.a_bits + self.b_bits > 47 else np.argsort(codes << 16 | doc, kind="stable")
        codes, doc, links = codes[order], doc[order], links[order]
        new = np.flatnonzero((np.diff(codes, prepend=-1) != 0) | (np.diff(doc, prepend=-1) != 0))
        return rows[:, :4], digests, codes[new], doc[new], np.add.reduceat(links, new) if len(new) else links


@functools.cache
def aligner(a_path: str, b_path: str) -> Aligner:
    """One for each worker process, on one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Aligner(a_path, b_path)


def _spilled(docs: DataFrame, a_path: str, b_path: str, keep_groups: bool) -> DataFrame:
    names = [c.split()[0] for c in _SPILL.split(", ")]
    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    types = dict(zip(names, (types[c.split()[1]] for c in _SPILL.split(", "))))

    def table(n: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[c], types[c]) if c in columns else pa.nulls(n, types[c]) for c in names], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        al, at = aligner(a_path, b_path), TaskContext.get().partitionId() << 32
        low = al.a_bits - PART_BITS + al.b_bits
        for batch in batches:
            for ids, texts in in_batches(batch.column(0), batch.column(1), BATCH_BYTES):
                rows, groups, codes, doc, links = al.batch(texts, keep_groups)
                yield table(len(ids), run=np.full(len(ids), at), at=np.arange(len(ids), dtype=np.int32), doc_id=ids, groups=groups, **dict(zip(MEASURES, rows.T)))
                cuts = np.searchsorted(codes >> low, np.arange((1 << PART_BITS) + 1))
                for part, (s, e) in enumerate(zip(cuts.tolist(), cuts[1:].tolist())):
                    if s < e:
                        first = np.flatnonzero(np.diff(codes[s:e], prepend=-1))
                        head = heads(codes[s:e][first], np.diff(first, append=e - s))
                        yield table(1, run=[at], part=[part], heads=[head], tails=[framed(doc[s:e].astype("<u2"), links[s:e].astype("<i8"))])
                at += 1

    return docs.mapInArrow(run, _SPILL)


def _merge(runs: DataFrame, name: str) -> DataFrame:
    """One run for each (part, slice)."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        found = list(merged([runs_frames(b.as_py()) for b in group.column("heads")]))
        blob = heads(np.concatenate([c for c, _ in found]), np.concatenate([n for _, n in found]))
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "slice": pa.array([key[1].as_py()], pa.int64()), "heads": pa.array([blob], pa.binary())})

    return save(runs.select("part", "slice", "heads").groupBy("part", "slice").applyInArrow(run, "part int, slice long, heads binary"), name)


def _contributions(runs: DataFrame, counts: DataFrame, slices: int, b_bits: int) -> DataFrame:
    """For each run and part the arrays n_best and count_sum over the run's texts."""
    schema = "run long, size int, sums binary"

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"run": [], "size": [], "sums": []}
        if left.num_rows:
            codes, n = (np.concatenate(x) for x in zip(*runs_frames(right.column("heads")[0].as_py())))
            a = np.flatnonzero(np.diff(codes >> b_bits, prepend=-1))
            best = n == np.repeat(np.maximum.reduceat(n, a), np.diff(a, append=len(n)))
            for at, head, tail in zip(left.column("run").to_pylist(), left.column("heads"), left.column("tails")):
                own, times = (np.concatenate(x) for x in zip(*runs_frames(head.as_py())))
                where = np.repeat(np.searchsorted(codes, own), times)
                doc, links = (np.concatenate(x) for x in zip(*frames(tail.as_py(), "<u2", "<i8")))
                sums = np.zeros((2, int(doc.max()) + 1), np.int64)
                np.add.at(sums[0], doc, links * best[where])
                np.add.at(sums[1], doc, links * n[where])
                out["run"].append(at)
                out["size"].append(sums.shape[1])
                out["sums"].append(zstandard.ZstdCompressor(level=1).compress(sums.astype("<i8").tobytes()))
        return pa.table([pa.array(out["run"], pa.int64()), pa.array(out["size"], pa.int32()), pa.array(out["sums"], pa.binary())], ["run", "size", "sums"])

    spread = counts.select("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))).alias("slice"), "heads")
    return runs.groupBy("part", "slice").cogroup(spread.groupBy("part", "slice")).applyInArrow(run, schema)


def pair_counts(spilled: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(runs with their slice, one merged run for each part, slices)."""
    n = spilled.select("run").distinct().count()
    slices = max(1, -(-n // FAN))
    runs = spilled.filter("part is not null").withColumn("slice", F.pmod(F.xxhash64("run"), F.lit(slices)))
    counts, left = _merge(runs, "counts"), slices
    while left > 1:
        left = -(-left // FAN)
        counts = _merge(counts.withColumn("slice", F.col("slice") % left), "counts")
    return runs, counts, slices


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None, b_path: str | None = None, keep_groups: bool = False) -> DataFrame:
    """Per document doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, and its
    groups as ``a1,a2|b1;a3|b2,b3``: the text with ``keep_groups``, else its SHA-256."""
    a_path, b_path = a_path or default_vocabulary(), b_path or default_second_vocabulary()
    spilled = save(_spilled(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")), a_path, b_path, keep_groups), "spilled")
    runs, counts, slices = pair_counts(spilled)
    added = _contributions(runs, counts, slices, aligner(a_path, b_path).b_bits)
    rows = spilled.filter("part is null").select("run", "at", "doc_id", *MEASURES, "groups")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"

    def total(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        sums = np.zeros((2, left.num_rows), np.int64)
        for size, blob in zip(right.column("size").to_pylist(), right.column("sums")):
            sums[:, :size] += np.frombuffer(zstandard.ZstdDecompressor().decompress(blob.as_py()), "<i8").reshape(2, -1)
        at = left.column("at").to_numpy()
        columns = [left.column("doc_id"), *(left.column(c) for c in MEASURES), pa.array(sums[0][at]), pa.array(sums[1][at]), left.column("groups")]
        return pa.table(columns, [c.split()[0] for c in schema.split(", ")])

    return rows.groupBy("run").cogroup(added.groupBy("run")).applyInArrow(total, schema)
