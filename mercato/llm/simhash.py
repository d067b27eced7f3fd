"""SimHash near-duplicates, searched with vantage-point trees.

Every text gets a 64-bit fingerprint of its word shingles; texts whose
fingerprints differ in at most ``max_bits`` bits are linked, and linked texts
form components.

The search works on distinct fingerprints. A vantage point splits them by
Hamming distance into near (``d <= radius``) and far; by the triangle bound a
partner of ``x`` can only lie on the other side if ``d(x)`` is within
``max_bits`` of the radius. The upper levels of the tree are fitted on a bounded
sample and deal the fingerprints into shards: each fingerprint has one home
shard and is a query in every shard whose boundary it overlaps. Queries need to
cross one way only (near to far), which finds every pair once. Inside a shard the
tree goes on, down to leaves in which only fingerprints whose distance to the
leaf's vantage point differs by ``max_bits`` at most are compared. The sample
shapes the tree, never the result: all pairs are found at any fit. Shards that are
still over ``SHARD_LIMIT`` are dealt again, each by a tree fitted on a sample of its own
rows, until none is or none can be split, so what a task holds does not grow with the
input.

A leaf's links are reduced to a spanning forest before they leave the task, so a
dense group gives as many rows as members; components follow from
alternating star contraction over those links.

Defined cases: a null or blank text has fingerprint zero and is linked like any
other; fewer words than a shingle: the whole sequence is the only shingle; null
ids are not candidates for ``component_id`` (null if the component has no other);
repeated rows share their component; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.llm.shared import attach, hashed_sample, save

SEED = 42
SHINGLE_WORDS, MAX_BITS = 3, 2
#: Fingerprints the upper tree is fitted on, and the shards it makes at most.
SAMPLE, MAX_SHARDS = 50_000, 4_096
#: Fingerprints a shard aims at, and a leaf inside it.
SHARD_ROWS, LEAF_ROWS = 8_192, 512
#: Fingerprints at home in a shard above which it is dealt again, into 2^FURTHER_LEVELS
#: parts at most, by a tree fitted on about FURTHER_SAMPLE of them.
SHARD_LIMIT, FURTHER_LEVELS, FURTHER_SAMPLE = 32_768, 6, 4_096
#: Bits of the broadcast bitmap that tells linked documents: 2 MB whatever the input.
BITMAP_BITS = 1 << 23


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """Bit i is set if it is set in over half of the shingles' hashes."""
    parts = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z, and \\x20 \\x09-\\x0D
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    n = max(1, len(parts) - words + 1)
    ends = ends[-n:] if len(parts) >= words else ends[-1:]
    hash_of, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, 65_536):  # bounds the memory of very long texts
        hashes = [hash_of(joined[a:b], SEED) for a, b in zip(starts[at : min(n, at + 65_536)].tolist(), ends[at : at + 65_536].tolist())]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for k in range(0, len(bits), 255):  # sums of 255 fit a byte
            total += bits[k : k + 255].sum(axis=0, dtype=np.uint8)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """(id, fp): the fingerprint as a signed 64-bit integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), words) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], ["id", "fp"])

    return docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string")).mapInArrow(run, "id long, fp long")


# --- the tree ---------------------------------------------------------------------


def distance(fps: np.ndarray, point: np.uint64) -> np.ndarray:
    return np.bitwise_count(fps ^ point)


def split_of(fps: np.ndarray) -> tuple[np.uint64, int] | None:
    """A vantage point and a radius that leaves both sides filled."""
    best = None
    for at in {0, len(fps) // 2, len(fps) - 1}:
        d = distance(fps, fps[at])
        radius = int(np.median(d))
        radius = radius if (d > radius).any() else radius - 1
        near = int((d <= radius).sum())
        if 0 < near < len(fps):
            # balance, and few within reach of the boundary
            cost = abs(2 * near - len(fps)) + int((np.abs(d.astype(np.int64) - radius) <= MAX_BITS).sum())
            if best is None or cost < best[0]:
                best = (cost, fps[at], radius)
    return best and best[1:]


def fit(sample: np.ndarray, rows: int, levels: int):
    """Nested (point, radius, near, far) down to leaves, which are None."""
    if levels == 0 or len(sample) <= rows or (split := split_of(sample)) is None:
        return None
    near = distance(sample, split[0]) <= split[1]
    return (*split, fit(sample[near], rows, levels - 1), fit(sample[~near], rows, levels - 1))


def route(fps: np.ndarray, tree, max_bits: int, home: bool = True, shard: int = 1):
    """(shard, fingerprints, whether they are at home there), each once per shard."""
    if not len(fps):
        return
    if tree is None:
        yield shard, fps, home
        return
    point, radius, near, far = tree
    d = distance(fps, point).astype(np.int64)
    yield from route(fps[d <= radius], near, max_bits, home, 2 * shard)
    yield from route(fps[d > radius], far, max_bits, home, 2 * shard + 1)
    # across the boundary: at home only from near to far, a query both ways
    yield from route(fps[(d <= radius) & (d > radius - max_bits)], far, max_bits, False, 2 * shard + 1)
    if not home:
        yield from route(fps[(d > radius) & (d <= radius + max_bits)], near, max_bits, False, 2 * shard)


def close_pairs(home: np.ndarray, queries: np.ndarray, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs within ``max_bits``, of two at home or of a query and one at home."""
    if not len(home) or len(home) + len(queries) < 2:
        return
    split = split_of(home) if len(home) > LEAF_ROWS else None
    if split is None:
        point = home[0]
        dh = distance(home, point)
        home, dh = home[(order := np.argsort(dh, kind="stable"))], dh[order]
        for fps, own in ((home, True), (queries, False)):
            dq = distance(fps, point).astype(np.int64)
            for value in np.unique(dq):
                some = fps[dq == value]
                a, b = np.searchsorted(dh, max(0, value - max_bits)), np.searchsorted(dh, value + max_bits, "right")
                for at in range(0, len(some), 1024):
                    for to in range(a, b, 4096):
                        one, two = some[at : at + 1024], home[to : min(b, to + 4096)]
                        i, j = np.nonzero(np.bitwise_count(one[:, None] ^ two[None, :]) <= max_bits)
                        keep = one[i] < two[j] if own else one[i] != two[j]
                        if keep.any():
                            yield one[i[keep]], two[j[keep]]
        return
    point, radius = split
    dh, dq = distance(home, point).astype(np.int64), distance(queries, point).astype(np.int64)
    near = dh <= radius
    yield from close_pairs(home[near], queries[dq <= radius + max_bits], max_bits)
    crossing = home[near & (dh > radius - max_bits)]
    yield from close_pairs(home[~near], np.concatenate([queries[dq > radius - max_bits], crossing]), max_bits)


def forest(pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> dict[int, int]:
    """Each linked fingerprint with the smallest of its component, as signed."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for a, b in pairs:
        for x, y in zip(a.view(np.int64).tolist(), b.view(np.int64).tolist()):
            x, y = find(x), find(y)
            parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(parent)}


# --- links and components ---------------------------------------------------------


def links(groups: DataFrame, max_bits: int = MAX_BITS, sample: int = SAMPLE) -> DataFrame:
    """Spanning links (a, b), b < a, of the distinct fingerprints in column fp."""
    n = groups.count()
    some = hashed_sample(groups.select("fp"), ["fp"], n, sample)  # bounded by ``sample``
    fitted = np.array([r["fp"] for r in some.collect()], np.int64).view(np.uint64)
    levels = max(0, min(MAX_SHARDS.bit_length() - 1, int(np.ceil(np.log2(max(1, n) / SHARD_ROWS)))))
    tree = fit(fitted, max(64, len(fitted) >> max(levels, 1)) if levels else len(fitted), levels)

    def dealt(frame: DataFrame, trees) -> DataFrame:
        """Rows (shard, fp, home) of the shards that have a tree, dealt by it."""

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                shards, fps, homes = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
                order = np.lexsort((homes, shards))
                shards, fps, homes = shards[order], fps[order].view(np.uint64), homes[order]
                cut = np.flatnonzero(np.append(True, (np.diff(shards) != 0) | (np.diff(homes.astype(np.int8)) != 0))) if len(shards) else []
                for s, e in zip(cut, np.append(cut[1:], len(shards)).astype(int) if len(cut) else []):
                    for shard, part, home in route(fps[s:e], trees[int(shards[s])], max_bits, bool(homes[s]), int(shards[s])):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), shard), pa.int64()), pa.array(part.view(np.int64)), pa.array(np.full(len(part), home))], ["shard", "fp", "home"])

        return frame.mapInArrow(deal, "shard long, fp long, home boolean")

    def own_tree(key: tuple, table: pa.Table) -> pa.Table:
        fps = np.unique(table.column("fp").to_numpy()).view(np.uint64)
        tree = fit(fps, max(64, len(fps) >> FURTHER_LEVELS), FURTHER_LEVELS)
        return pa.table({"shard": [key[0].as_py()], "tree": pa.array([pickle.dumps(tree)], pa.binary())})

    def further(rows: DataFrame) -> DataFrame:
        whole = np.iinfo(np.int64).max
        done: set[int] = set()
        while True:
            sizes = rows.filter("home").groupBy("shard").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > SHARD_LIMIT)
            big = {r["shard"]: r["n"] for r in sizes.collect() if r["shard"] not in done and r["shard"] < whole >> FURTHER_LEVELS + 1}
            if not big:
                return rows
            # one row for each shard over the limit, so the total over the limit at most
            marks = F.broadcast(rows.sparkSession.createDataFrame(list(big.items()), "shard long, n long"))
            some = rows.filter("home").join(marks, "shard").filter(F.pmod(F.xxhash64("fp", "shard"), F.greatest(F.lit(1), F.expr(f"n div {FURTHER_SAMPLE}"))) == 0)
            trees = {r["shard"]: pickle.loads(r["tree"]) for r in some.groupBy("shard").applyInArrow(own_tree, "shard long, tree binary").collect()}
            done |= {x for x in big if trees.get(x) is None}  # all at one distance: the leaves see to them
            trees = {x: t for x, t in trees.items() if t is not None}
            if trees:
                names = F.broadcast(rows.sparkSession.createDataFrame([(x,) for x in trees], "shard long"))
                rows = save(rows.join(names, "shard", "left_anti").unionByName(dealt(rows.join(names, "shard", "left_semi"), trees)), "dealt")

    def search(key: tuple, table: pa.Table) -> pa.Table:
        fps = table.column("fp").to_numpy().view(np.uint64)
        home = table.column("home").to_numpy().astype(bool)
        found = forest(close_pairs(fps[home], np.unique(fps[~home]), max_bits))
        found = [(a, b) for a, b in found.items() if a != b]
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    first = save(dealt(groups.select(F.lit(1).cast("long").alias("shard"), "fp", F.lit(True).alias("home")), {1: tree}), "dealt")
    return further(first).groupBy("shard").applyInArrow(search, "a long, b long")


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, root): for every node of ``edges`` (a, b) the smallest node it
    reaches. Large-star and small-star rounds alternate until the edges are
    stars; each round is a written table, and hot nodes are dealt into pieces."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if large:
            both = both.unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = save(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n")), "least")
        near = attach(both, least.select("u", "m", "n"), ["u"], "n", ["v"], "inner")
        if large:
            out = near.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = near.filter("v != m").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(near.select(F.col("u").alias("a"), F.col("m").alias("b")).filter("a != b"))
        return save(out.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")

    e, before = save(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"), None
    for _ in range(most_rounds):
        # done when no node is both below and above another, and none has two below
        state = e.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("a").alias("d")).first()
        inner = e.select(F.col("b").alias("x")).distinct().join(e.select(F.col("a").alias("x")).distinct(), "x", "left_semi").limit(1).count()
        if state["n"] == state["d"] and not inner:
            break
        e = star(star(e, True), False)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root")))


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """Per document: id, fp (signed), component_id (smallest id reachable)."""
    rows = save(fingerprints(docs, id_col, text_col, words), "fingerprints")
    groups = save(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")), "groups")
    found = components(links(groups, max_bits))
    rooted = groups.join(found, groups["fp"] == found["node"], "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    rooted = save(rooted, "rooted")
    # by root with map-side minima; the join back is of one row per fingerprint
    roots = save(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("m")), "roots")
    labelled = save(attach(rooted, roots, ["root"], "m", ["fp"]).select("fp", "n", "component_id"), "labelled")
    return attach(rows, labelled, ["fp"], "n", ["id"]).select(F.col("id").alias(id_col), "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest
    id (null ids last). A bitmap of the fingerprints in components of two or more is
    broadcast; documents whose bit is not set pass straight through, and only the
    others (a few by chance) are moved with their texts; a component is reduced on the
    map side first, so a large one leaves a row per task."""
    schema = docs.schema

    def fp_of(texts):
        import pandas as pd

        return pd.Series(np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64))

    rows = save(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__row"), docs[id_col].cast("long").alias("__id"), F.pandas_udf(fp_of, "long")(docs[text_col].cast("string")).alias("fp")), "fingerprinted")
    groups = save(rows.groupBy("fp").agg(F.count(F.lit(1)).alias("n")), "groups")
    found = components(links(groups, max_bits))
    rooted = groups.join(found, groups["fp"] == found["node"], "left").select("fp", "n", F.coalesce("root", "fp").alias("root"))
    joint = rooted.groupBy("root").agg(F.sum("n").alias("m")).filter("m >= 2").withColumnRenamed("root", "__root")
    joint = save(rooted.join(joint, rooted["root"] == joint["__root"]).select("fp", "n", "root"), "joint")
    at = F.pmod(F.xxhash64("fp"), F.lit(BITMAP_BITS))
    bit = F.expr(f"shiftleft(1L, cast(pmod(xxhash64(fp), {BITMAP_BITS}) % 64 as int))")
    bitmap = joint.groupBy(F.shiftright(at, 6).alias("__word")).agg(F.bit_or(bit).alias("__mask"))
    hits = rows.join(F.broadcast(bitmap), F.shiftright(at, 6) == F.col("__word"), "left")
    hits = hits.withColumn("__hit", F.coalesce(F.col("__mask").bitwiseAND(bit) != 0, F.lit(False))).drop("__word", "__mask")
    alone = hits.filter(~F.col("__hit")).select("__row")
    marked = attach(hits.filter("__hit").drop("__hit"), joint, ["fp"], "n", ["__id"])
    first = F.coalesce(F.col("__id"), F.lit((1 << 63) - 1))
    single = marked.filter("root is null").select("__row")
    shared = marked.filter("root is not null").groupBy("root").agg(F.min_by("__row", first).alias("__row")).select("__row")
    return alone.unionByName(single).unionByName(shared).select("__row.*").select(*[F.col(f.name) for f in schema])
