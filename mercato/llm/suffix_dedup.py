"""Removal of repeated passages with a logarithmic family of suffix arrays.

Every byte covered by a string of ``LENGTH`` bytes that also starts elsewhere is
removed. The index holds suffixes at content-defined places only: each window of
``LENGTH`` bytes is represented by its anchor, the 8-byte gram with the least
hash among its first ``SPAN`` positions. Equal windows have their anchors at the
same offset, so they meet at one pair of indexed suffixes, which agree in at
least ``CORE`` bytes; about one suffix in ``SPAN / 2`` bytes is enough. Suffixes
stand in the order of the fingerprint of those bytes: equal prefixes stand
together, which is all that a scan for long matches needs.

Documents come in batches. A batch's suffix array is built shard by shard,
merge-scanned against every level of the family, and becomes a level itself;
levels of equal size merge, so a suffix is rewritten a logarithmic number of
times. A scan yields the suffixes, old and new, that have found a partner; those of cores
with very many suffixes have one for certain and stay out of the index. The
windows of the matches are then checked exactly: suffixes whose whole context
(all windows of their anchor) agrees with another's are repeated as they are;
the others are borders of repeated passages, for which the text is fetched and
window by window compared. Only documents with borders or removed bytes are
moved; a bitmap of fixed size tells them before any shuffle.

Documents are identified by hash and length of their text: equal texts share
their result, so null and repeated ids need no care. A null text is empty; texts
under ``LENGTH`` bytes are kept whole; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.llm.shared import attach, fewer, keeping, save, work_path

LENGTH, SPAN, GRAM = 400, 256, 8
CORE = LENGTH - SPAN + 1
BATCHES = 4
#: Suffixes of one core above which they do not enter the index: with so many, each has
#: a partner. The cores that are this hot are broadcast, the hottest MOST_HOT at most.
HOT_CORE, MOST_HOT = 4_096, 1_000_000
#: Contexts of one core that are compared in one task (1.3 MB at most).
GROUPED_CONTEXTS = 2_000
#: Text that is indexed in one go.
CHUNK_BYTES = 1 << 19
#: Suffixes that one task of the family merges and writes.
TASK_BYTES = 1 << 25
#: Bits of the broadcast bitmap of documents: 2 MB whatever the input.
BITMAP_BITS = 1 << 23
ENTRY = np.dtype([("core", "<i8"), ("ctx", "<i8"), ("key", "<i8"), ("n", "<i4"), ("s", "<i4"), ("w", "u1"), ("off", "u1")])
SPAN_OF = np.dtype([("key", "<i8"), ("n", "<i4"), ("s", "<i4"), ("e", "<i4")])
SCANNED = "batch long, shard long, size long, suffixes binary"
ROWS = "core long, ctx long, key long, n int, s int, w int, off int"


def _slices(records: Iterator[pa.RecordBatch], rows: int = 1_000) -> Iterator[pa.RecordBatch]:
    """Smaller batches: what a task holds as Python objects at once."""
    for r in records:
        for at in range(0, r.num_rows, rows):
            yield r.slice(at, rows)


def key_of(raw: bytes) -> int:
    """The text's hash as a signed number."""
    return int.from_bytes(xxhash.xxh3_64_digest(raw), "little", signed=True)


def entries(texts: list[bytes]) -> np.ndarray:
    """The indexed suffixes of ``texts``: for each anchor the first window start
    ``s`` it stands for, how many follow (``w``) and its offset from ``s``."""
    texts = [t for t in texts if len(t) >= LENGTH]
    if not texts:
        return np.zeros(0, ENTRY)
    raw = b"".join(texts)
    ends = np.cumsum([len(t) for t in texts])
    starts = ends - [len(t) for t in texts]
    b = np.frombuffer(raw + bytes(GRAM), np.uint8).astype(np.uint64)
    for step in (1, 2, 4):  # big-endian grams of 2, 4, 8 bytes
        b = (b[:-step] << np.uint64(8 * step)) | b[step:]
    b *= np.uint64(0x9E3779B97F4A7C15)
    b ^= b >> np.uint64(29)
    b *= np.uint64(0xBF58476D1CE4E5B9)
    # hash above, position below: the least is the leftmost of the least hashes
    least = (b & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(b), dtype=np.uint64)
    for step in (1 << i for i in range(SPAN.bit_length() - 1)):
        least = np.minimum(least[:-step], least[step:])
    at = np.concatenate([np.arange(s, e - LENGTH + 1) for s, e in zip(starts, ends)])
    anchor = (least[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.append(True, np.diff(anchor) != 0))
    first, anchor = at[new], anchor[new]
    last = at[np.append(new[1:], len(at)) - 1]
    doc = np.searchsorted(ends, first, "right")
    out = np.zeros(len(new), ENTRY)
    keys = np.array([key_of(t) for t in texts], np.int64)
    digest = xxhash.xxh3_64_intdigest
    out["core"] = np.array([digest(raw[a : a + CORE]) for a in anchor.tolist()], np.uint64).view(np.int64)
    out["ctx"] = np.array([digest(raw[f : z + LENGTH], a - f) for f, z, a in zip(first.tolist(), last.tolist(), anchor.tolist())], np.uint64).view(np.int64)
    out["key"], out["n"], out["s"] = keys[doc], (ends - starts)[doc], first - starts[doc]
    out["w"], out["off"] = last - first, anchor - first
    return out


def collapsed(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(``e`` with one suffix for each core and context, the spans of those that were
    there more than once). Equal contexts at different places are repeated whole, so
    their spans are known here; the one that stays stands for them in the index. In a
    run of one byte, or of a few, every position is an anchor: a run leaves a suffix
    for each byte of its period."""
    order = np.lexsort((e["s"], e["n"], e["key"], e["ctx"], e["core"]))
    e = e[order]
    if not len(e):
        return e, np.zeros(0, SPAN_OF)
    ids = e[["core", "ctx", "key", "n", "s"]]
    e = e[np.append(True, ids[1:] != ids[:-1])]  # copies of a text are one text
    new = np.append(True, (np.diff(e["core"]) != 0) | (np.diff(e["ctx"]) != 0))
    many = np.diff(np.append(np.flatnonzero(new), len(e)))
    some = e[np.repeat(many > 1, many)]
    some = some[np.lexsort((some["s"], some["n"], some["key"]))]
    ends = some["s"] + some["w"] + LENGTH
    if len(some):  # runs of spans that touch
        apart = np.append(True, (np.diff(some["key"]) != 0) | (np.diff(some["n"]) != 0))
        # within a text later anchors reach further, so the last end is the greatest
        first = np.flatnonzero(apart | np.append(True, some["s"][1:] > ends[:-1]))
        spans = np.zeros(len(first), SPAN_OF)
        spans["key"], spans["n"], spans["s"] = some["key"][first], some["n"][first], some["s"][first]
        spans["e"] = np.maximum.reduceat(ends, first)
    else:
        spans = np.zeros(0, SPAN_OF)
    return e[new], spans


def _scan(docs: DataFrame, text_col: str, batches: int, shards: int) -> DataFrame:
    """Suffixes of every text, by batch and shard; as batch -1 the spans that are
    known to be repeated from a task's own texts."""

    def run(records: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies within a task are indexed once
        held: list[bytes] = []
        size = 0

        def out() -> pa.RecordBatch:
            e, spans = collapsed(entries(held))
            place = (e["key"].view(np.uint64) % np.uint64(batches)).astype(np.int64) * shards + (e["core"].view(np.uint64) % np.uint64(shards)).astype(np.int64)
            order = np.argsort(place, kind="stable")
            e, place = e[order], place[order]
            cut = np.flatnonzero(np.append(True, np.diff(place) != 0)) if len(e) else np.zeros(0, np.int64)
            blobs = [e[a:b].tobytes() for a, b in zip(cut, np.append(cut[1:], len(e)))]
            batch, shard = [*(place[cut] // shards).tolist(), -1], [*(place[cut] % shards).tolist(), 0]
            blobs.append(spans.tobytes())
            return pa.RecordBatch.from_arrays([pa.array(batch, pa.int64()), pa.array(shard, pa.int64()), pa.array([len(x) for x in blobs], pa.int64()), pa.array(blobs, pa.binary())], ["batch", "shard", "size", "suffixes"])

        for record in records:
            for t in record.column(0):
                raw = (t.as_py() or "").encode("utf-8", "replace")
                if len(raw) < LENGTH or (k := key_of(raw)) in seen:
                    continue
                if len(seen) < 1_000_000:
                    seen.add(k)
                held.append(raw)
                size += len(raw)
                if size >= CHUNK_BYTES:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return docs.select(docs[text_col].cast("string")).mapInArrow(run, SCANNED)


# --- the family ---------------------------------------------------------------------


def _merge_scan(write_level: bool, merged: list[int]):
    """One shard's step: the batch (level -1) against every level; returns hits
    (kind 0) and the new level (kind 1), the union of the batch and ``merged``."""

    def step(key: tuple, table: pa.Table) -> pa.Table:
        parts: dict[int, list[np.ndarray]] = {}
        for level, blob in zip(table.column("level").to_pylist(), table.column("suffixes").to_pylist()):
            parts.setdefault(level, []).append(np.frombuffer(blob, ENTRY))
        arrays = {level: np.concatenate(p) for level, p in parts.items()}
        batch = arrays.pop(-1, np.zeros(0, ENTRY))
        batch = batch[np.lexsort((batch["s"], batch["n"], batch["key"], batch["core"]))]  # the suffix array
        if len(batch):  # copies from different tasks
            ids = batch[["core", "key", "n", "s"]]
            batch = batch[np.append(True, ids[1:] != ids[:-1])]
        same = batch["core"][1:] == batch["core"][:-1]
        hit = np.append(same, False) | np.append(False, same) if len(batch) else np.zeros(0, bool)
        found = []
        for array in arrays.values():
            a, b = np.searchsorted(array["core"], batch["core"]), np.searchsorted(array["core"], batch["core"], "right")
            hit |= b > a
            marks = np.zeros(len(array) + 1, np.int64)
            np.add.at(marks, a[b > a], 1)
            np.add.at(marks, b[b > a], -1)
            found.append(array[np.cumsum(marks[:-1]) > 0])
        found.append(batch[hit])
        rows = [(0, np.concatenate(found).tobytes())]
        if write_level:
            level = np.concatenate([batch, *[arrays[i] for i in merged if i in arrays]])
            rows.append((1, level[np.argsort(level["core"], kind="stable")].tobytes()))
        return pa.table({"kind": pa.array([k for k, _ in rows], pa.int32()), "shard": pa.array([key[0].as_py()] * len(rows), pa.int64()), "suffixes": pa.array([x for _, x in rows], pa.binary())})

    return step


def hot_cores(spark: SparkSession, scanned: str) -> np.ndarray:
    """The cores with over ``HOT_CORE`` suffixes, ascending."""

    def count(records: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in records:
            found = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(b.as_py(), ENTRY)["core"] for b in r.column(0))])
            cores, n = np.unique(found, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cores), pa.array(n, pa.int64())], ["core", "n"])

    rows = spark.read.schema(SCANNED).parquet(scanned).filter("batch >= 0").select("suffixes")
    counts = rows.mapInArrow(count, "core long, n long").groupBy("core").agg(F.sum("n").alias("n"))
    found = counts.filter(F.col("n") > HOT_CORE).orderBy(F.desc("n"), "core").limit(MOST_HOT).select("core").collect()
    return np.sort(np.array([r["core"] for r in found], np.int64))


def _without(cores: np.ndarray):
    """Suffixes whose core is not among ``cores``."""

    def run(records: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in records:
            blobs = []
            for b in r.column(1):
                e = np.frombuffer(b.as_py(), ENTRY)
                blobs.append(e[~np.isin(e["core"], cores)].tobytes())
            yield pa.RecordBatch.from_arrays([r.column(0), pa.array(blobs, pa.binary())], ["shard", "suffixes"])

    return run


def family_hits(spark: SparkSession, scanned: str, batches: int) -> DataFrame:
    """Feed the batches under ``scanned`` into a family of levels, one after the
    other; all suffixes that met a partner, as rows (some more than once)."""
    schema = "shard long, suffixes binary"
    hot = hot_cores(spark, scanned)
    sizes = dict(spark.read.schema(SCANNED).parquet(scanned).filter("batch >= 0").groupBy("batch").agg(F.sum("size")).collect())
    levels: list[tuple[int, DataFrame]] = []  # (batches inside, rows), largest first
    hits: DataFrame | None = None
    held = 0  # bytes in the batch and the levels
    for i in range(batches):
        part = spark.read.schema(SCANNED).parquet(scanned).filter(F.col("batch") == i).select("shard", "suffixes")
        if len(hot):
            part = part.mapInArrow(_without(hot), schema)
        part = part.select(F.lit(-1).alias("level"), "shard", "suffixes")
        merged, size = [], 1  # levels of the size reached so far merge
        while len(levels) > len(merged) and levels[len(levels) - 1 - len(merged)][0] == size:
            merged.append(len(levels) - 1 - len(merged))
            size *= 2
        for k, (_, df) in enumerate(levels):
            part = part.unionByName(df.select(F.lit(k).alias("level"), "shard", "suffixes"))
        last = i == batches - 1
        path = work_path(spark, "family")
        held += sizes.get(i, 0)
        done = part.groupBy("shard").applyInArrow(_merge_scan(not last, merged), f"kind int, {schema}")
        done.coalesce(1 + held // TASK_BYTES).write.parquet(path)
        out = spark.read.schema(f"kind int, {schema}").parquet(path)
        levels = [x for k, x in enumerate(levels) if k not in merged] + [(size, out.filter("kind = 1"))]
        some = out.filter("kind = 0").select("suffixes")
        hits = some if hits is None else hits.unionByName(some)

    def rows(records: Iterator[pa.RecordBatch], cores: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        for r in records:
            for blob in r.column(0):
                e = np.frombuffer(blob.as_py(), ENTRY)
                if cores is not None:
                    e = e[np.isin(e["core"], cores)]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(e[c]).astype(np.int64 if c in ("core", "ctx", "key") else np.int32)) for c in ENTRY.names], list(ENTRY.names))

    found = hits.mapInArrow(rows, ROWS)
    if len(hot):
        of_hot = spark.read.schema(SCANNED).parquet(scanned).filter("batch >= 0").select("suffixes")
        found = found.unionByName(of_hot.mapInArrow(lambda records: rows(records, hot), ROWS))
    return found


def known_spans(spark: SparkSession, scanned: str) -> DataFrame:
    """(key, n, s, e): the spans of ``collapsed``."""

    def rows(records: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in records:
            for blob in r.column(0):
                e = np.frombuffer(blob.as_py(), SPAN_OF)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(e[c]).astype(np.int64 if c == "key" else np.int32)) for c in SPAN_OF.names], list(SPAN_OF.names))

    found = spark.read.schema(SCANNED).parquet(scanned).filter("batch = -1")
    return found.select("suffixes").mapInArrow(rows, "key long, n int, s int, e int")


# --- exact windows and spans --------------------------------------------------------


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, key, n): with the text's hash and its length in bytes."""

    def run(records: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _slices(records):
            raw = [(t.as_py() or "").encode("utf-8", "replace") for t in r.column(1)]
            yield pa.RecordBatch.from_arrays([r.column(0), pa.array(raw, pa.binary()), pa.array([key_of(x) for x in raw], pa.int64()), pa.array([len(x) for x in raw], pa.int32())], ["id", "raw", "key", "n"])

    return docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string")).mapInArrow(run, "id long, raw binary, key long, n int")


def _copies(docs: DataFrame, text_col: str) -> DataFrame:
    """(key, n, m): the texts of ``LENGTH`` bytes and more that ``m`` >= 2 documents have."""

    def run(records: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _slices(records):  # the texts themselves don't go back
            raw = [x for t in r.column(0) if len(x := (t.as_py() or "").encode("utf-8", "replace")) >= LENGTH]
            yield pa.RecordBatch.from_arrays([pa.array([key_of(x) for x in raw], pa.int64()), pa.array([len(x) for x in raw], pa.int32())], ["key", "n"])

    keys = docs.select(docs[text_col].cast("string")).mapInArrow(run, "key long, n int")
    return keys.groupBy("key", "n").agg(F.count(F.lit(1)).alias("m")).filter("m >= 2")


def _marked(keyed: DataFrame, keys: DataFrame) -> DataFrame:
    """``keyed`` with ``hit``: the text is in ``keys``, up to chance hits."""
    at = F.pmod(F.col("key"), F.lit(BITMAP_BITS))
    bitmap = keys.groupBy(F.shiftright(at, 6).alias("__word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(key, 64) as int))")).alias("__mask"))
    joined = keyed.join(F.broadcast(bitmap), F.shiftright(at, 6) == F.col("__word"), "left")
    return joined.withColumn("hit", F.coalesce(F.col("__mask").bitwiseAND(F.expr("shiftleft(1L, cast(pmod(key, 64) as int))")) != 0, F.lit(False))).drop("__word", "__mask")


def _weighed(facts: DataFrame, copies: DataFrame, name: str) -> DataFrame:
    """``facts`` (one row per text), saved, with ``m``, the number of copies of the text."""
    return save(facts.join(copies, ["key", "n"], "left").withColumn("m", F.coalesce("m", F.lit(1))), name)


def _of_texts(keyed: DataFrame, weighed: DataFrame, how: str) -> DataFrame:
    """``weighed`` (one row per text) joined to the documents; a text with very
    many copies is dealt into pieces."""
    return attach(keyed.drop("hit"), weighed, ["key", "n"], "m", ["id"], how)


PIECES = "core long, key long, n int, s int, w int, off int, c long, large boolean, content binary"


def _pieces(records: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text of every border suffix's windows."""
    seen: set[int] = set()  # copies within a task have the same windows
    names = [x.split()[0] for x in PIECES.split(", ")]
    for r in _slices(records):
        rows = []
        for raw, key, n, borders in zip(*(r.column(i).to_pylist() for i in range(4))):
            if key in seen:
                continue
            if len(seen) < 1_000_000:
                seen.add(key)
            rows += [(x["core"], key, n, x["s"], x["w"], x["off"], x["c"], x["k"] > GROUPED_CONTEXTS, raw[x["s"] : x["s"] + x["w"] + LENGTH]) for x in borders]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(list(zip(*rows)) or [[]] * len(kinds), kinds)], names)


def window_hashes(core: int, content: bytes, w: int, off: int) -> list[int]:
    """A number for each window of a border suffix, equal for equal windows."""
    digest = xxhash.xxh3_64_intdigest
    seed = (core ^ 0x5BD1E995) & 0xFFFFFFFFFFFF
    return [digest(content[i : i + LENGTH], seed + off - i) for i in range(w + 1)]


def _resolve(table: pa.Table) -> pa.Table:
    """Runs of repeated windows among the border suffixes of some cores."""
    rows = {x[1:4] + (x[0],): x for x in zip(*(table.column(c).to_pylist() for c in ("core", "key", "n", "s", "w", "off", "c", "content")))}
    rows = list(rows.values())  # copies gave some twice
    hashes = [window_hashes(core, content, w, off) for core, _, _, _, w, off, _, content in rows]
    h = np.array([x for part in hashes for x in part], np.uint64)
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    twice = np.zeros(len(h), bool)
    twice[order] = np.append(same, False) | np.append(False, same) if len(h) else same
    out, at = [], 0
    for (_, key, n, s, w, _, c, _), part in zip(rows, hashes):
        marks = np.concatenate([[0], twice[at : at + len(part)], [0]]).astype(np.int8)
        at += len(part)
        if c == 1:
            edges = np.diff(marks)
            out += [(key, n, s + a, s + b - 1 + LENGTH) for a, b in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist())]
    kinds = [("key", pa.int64()), ("n", pa.int32()), ("s", pa.int32()), ("e", pa.int32())]
    return pa.table({name: pa.array(list(col), kind) for (name, kind), col in zip(kinds, list(zip(*out)) or [[]] * 4)})


def _windows(records: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of the border suffixes as a row: (h, key, n, s, alone)."""
    for r in records:
        for core, key, n, s, w, off, c, content in zip(*(r.column(x).to_pylist() for x in ("core", "key", "n", "s", "w", "off", "c", "content"))):
            h = np.array(window_hashes(core, content, w, off), np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.full(w + 1, key, np.int64)), pa.array(np.full(w + 1, n, np.int32)), pa.array(np.arange(s, s + w + 1, dtype=np.int32)), pa.array(np.full(w + 1, c == 1))], ["h", "key", "n", "s", "alone"])


def _cut(records: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without their spans: id, n_bytes, n_removed, n_spans, kept."""
    for r in _slices(records):
        out = []
        for raw, spans in zip(r.column(1).to_pylist(), r.column(2).to_pylist()):
            runs: list[list[int]] = []
            for a, b in sorted((x["s"], x["e"]) for x in spans or []):
                if runs and a <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], b)
                else:
                    runs.append([a, b])
            kept, at = [], 0
            for a, b in runs:
                kept.append(raw[at:a])
                at = b
            kept.append(raw[at:])
            left = b"".join(kept)
            out.append((len(raw), len(raw) - len(left), len(runs), left))
        cols = list(zip(*out)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([r.column(0), *[pa.array(list(c), pa.int64()) for c in cols[:3]], pa.array(list(cols[3]), pa.binary())], ["id", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES, shards: int | None = None) -> DataFrame:
    """Per document its id, n_bytes, n_removed, n_spans (maximal removed runs)
    and ``kept``, the remaining bytes."""
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = _keyed(docs, id_col, text_col)
    with keeping() as keep:
        spans = _repeated(docs, keyed, text_col, batches, shards, keep)
    marked = _marked(keyed, spans)
    with_spans = _of_texts(marked.filter("hit"), spans, "left").select("id", "raw", "spans")
    # nothing to cut: a second Python worker in the same task would only pass the text on
    none = F.lit(0).cast("long")
    clean = marked.filter(~F.col("hit")).select("id", F.col("n").cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.col("raw").alias("kept"))
    cut = with_spans.mapInArrow(_cut, "id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return clean.unionByName(fewer(cut, shards)).withColumnRenamed("id", id_col)


def _repeated(docs: DataFrame, keyed: DataFrame, text_col: str, batches: int, shards: int, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(key, n, spans, m), saved: the repeated spans of every text that has some."""
    spark = docs.sparkSession
    scanned = work_path(spark, "suffixes")
    # one file a task: a folder for each batch would make five, and a sort of the suffixes before them
    _scan(docs, text_col, batches, shards).write.parquet(scanned)
    hits = keep(family_hits(spark, scanned, batches).dropDuplicates(["key", "n", "s"]))

    copies = keep(_copies(docs, text_col))
    whole = copies.select("key", "n", F.lit(0).alias("s"), F.col("n").alias("e"))
    # equal contexts: every window of the anchor is repeated
    contexts = keep(hits.groupBy("core", "ctx").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("key", "n", "s", "w", "off")).alias("r")))
    inner = attach(hits, contexts.filter("c >= 2").select("core", "ctx", "c"), ["core", "ctx"], "c", ["key", "s"], "inner").select("key", "n", "s", (F.col("s") + F.col("w") + LENGTH).alias("e"))
    # several contexts of one core, some of them alone: borders
    mixed = keep(contexts.groupBy("core").agg(F.count(F.lit(1)).alias("k"), F.min("c").alias("least")).filter("k >= 2 and least = 1").select("core", "k"))
    borders = attach(contexts, mixed, ["core"], "k", ["ctx"], "inner").select("core", "c", "k", "r.*")
    # saved, not kept: the plans that follow name it many times, and so all that it is made of
    borders = _weighed(borders.groupBy("key", "n").agg(F.collect_list(F.struct("core", "s", "w", "off", "c", "k")).alias("borders")), copies, "borders")
    texts = _of_texts(_marked(keyed, borders).filter("hit"), borders, "inner").select("raw", "key", "n", "borders")
    pieces = keep(texts.mapInArrow(_pieces, PIECES))
    outer = pieces.filter("not large").groupBy(F.pmod("core", F.lit(8 * shards))).applyInArrow(_resolve, "key long, n int, s int, e int")
    # cores with very many contexts: their windows are counted as rows, so that no task holds them all
    windows = keep(pieces.filter("large").mapInArrow(_windows, "h long, key long, n int, s int, alone boolean"))
    place = F.struct("key", "n", "s")
    twice = keep(windows.groupBy("h").agg(F.min(place).alias("a"), F.max(place).alias("b"), F.count(F.lit(1)).alias("m")).filter("a != b").select("h", "m"))
    outer = outer.unionByName(attach(windows.filter("alone"), twice, ["h"], "m", ["key", "s"], "inner").select("key", "n", "s", (F.col("s") + LENGTH).alias("e")))

    runs = whole.unionByName(inner).unionByName(outer).unionByName(known_spans(spark, scanned))
    return _weighed(runs.groupBy("key", "n").agg(F.collect_set(F.struct("s", "e")).alias("spans")), copies, "spans")
