"""Bounded groups: hot cores, crowded shards, many labels, crowded slices."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from mercato.llm import langid, sharding, simhash, suffix_dedup


def brute_repeats(texts: list[bytes], length: int = suffix_dedup.LENGTH) -> list[tuple[int, int, bytes]]:
    """(removed bytes, maximal removed runs, what is left) of each text."""
    starts: Counter = Counter()
    for t in texts:
        starts.update(t[i : i + length] for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, np.int64)
        for i in range(len(t) - length + 1):
            if starts[t[i : i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        off = np.cumsum(gone)[: len(t)] > 0
        runs = int((np.diff(np.concatenate([[0], off.astype(int)])) == 1).sum())
        out.append((int(off.sum()), runs, bytes(b for b, o in zip(t, off) if not o)))
    return out


def test_runs_of_a_byte_leave_few_suffixes(spark):
    """200,000 equal bytes in 20 documents of different length, with other text around,
    and runs of a short period."""
    rnd = random.Random(2)
    noise = lambda n: "".join(rnd.choice("abcdefghij klmnop") for _ in range(n))
    texts = [f"{noise(300 + i)}{'A' * (9_000 + 95 * i)}{noise(500)}" for i in range(20)]
    texts += [noise(450) + "xyz" * 700 + noise(30), noise(500), "A" * 500, "A" * 399, "A" * 400]
    raw = [t.encode() for t in texts]
    e = suffix_dedup.entries(raw)
    few, spans = suffix_dedup.collapsed(e)
    assert len(e) > 190_000 and len(few) < 200 * len(texts) and len(spans) < 60  # a run keeps its edges
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(df).collect()}
    for i, (removed, runs, left) in enumerate(brute_repeats(raw)):
        assert (got[i]["n_removed"], got[i]["n_spans"]) == (removed, runs), i
        assert hashlib.sha256(got[i]["kept"]).digest() == hashlib.sha256(left).digest()


def test_hot_cores_stay_out_of_the_index(spark, monkeypatch):
    """A line that every document has, in different company, and one that half of them
    have: few suffixes make a core hot, few contexts are compared in one task."""
    monkeypatch.setattr(suffix_dedup, "HOT_CORE", 20)
    monkeypatch.setattr(suffix_dedup, "GROUPED_CONTEXTS", 15)
    rnd = random.Random(7)
    noise = lambda n: "".join(rnd.choice("abcdefghij klmnop") for _ in range(n))
    line, passage = noise(230), noise(700)
    texts = [f"{noise(rnd.randint(200, 900))}{line}{noise(rnd.randint(200, 900))}{passage if i % 2 else ''}{noise(rnd.randint(0, 300))}" for i in range(90)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(df).collect()}
    for i, (removed, runs, left) in enumerate(brute_repeats([t.encode() for t in texts])):
        assert (got[i]["n_removed"], got[i]["n_spans"]) == (removed, runs) and bytes(got[i]["kept"]) == left, i


def test_tasks_write_one_file_each(spark, monkeypatch):
    """No intermediate table has a folder for each value of a column, which has every
    task write a file and sort its rows for each; no table is saved twice."""
    saved: list[str] = []
    new_path = suffix_dedup.work_path
    monkeypatch.setattr(suffix_dedup, "work_path", lambda s, name: saved.append(new_path(s, name)) or saved[-1])
    keep = suffix_dedup.save
    names: list[str] = []
    monkeypatch.setattr(suffix_dedup, "save", lambda df, name: names.append(name) or keep(df, name))
    rnd = random.Random(11)
    noise = lambda n: "".join(rnd.choice("abcdefghij klmnop") for _ in range(n))
    shared = noise(900)
    texts = [f"{noise(500)}{shared[i:i + 600]}{noise(500)}" for i in range(0, 300, 10)] + [shared, shared, noise(400), "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(df).collect()}
    for i, (removed, runs, left) in enumerate(brute_repeats([(t or "").encode() for t in texts])):
        assert (got[i]["n_removed"], got[i]["n_spans"]) == (removed, runs) and bytes(got[i]["kept"]) == left, i
    assert len(saved) == 1 + suffix_dedup.BATCHES and len(names) == len(set(names))
    for path in saved:
        files = spark.read.parquet(path).inputFiles()
        assert files and not any("=" in f.rsplit("/", 2)[1] for f in files)
    assert len(spark.read.parquet(saved[0]).inputFiles()) <= 3


def test_tables_between_are_kept_without_files(spark, monkeypatch, tmp_path):
    """two tables are saved besides the suffixes and the family, which a task writes
    for each 32 MB only; the others are kept, and released before the result is read.
    Files that change under their path are read anew."""
    names: list[str] = []
    save, saved, new_path = suffix_dedup.save, [], suffix_dedup.work_path
    monkeypatch.setattr(suffix_dedup, "save", lambda df, name: names.append(name) or save(df, name))
    monkeypatch.setattr(suffix_dedup, "work_path", lambda s, name: saved.append(new_path(s, name)) or saved[-1])
    monkeypatch.setattr(suffix_dedup, "GROUPED_CONTEXTS", 15)
    path, held = str(tmp_path / "documents.parquet"), spark.sparkContext._jsc.getPersistentRDDs().size()
    # every task of a shuffle has rows, and none is merged with others
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for seed in (3, 4):
            rnd = random.Random(seed)
            noise = lambda n: "".join(rnd.choice("abcdefghij klmnop") for _ in range(n))
            shared = noise(900)
            texts = [f"{noise(500)}{shared[i:i + 600]}{noise(500)}" for i in range(0, 300, 5)] + [shared, shared, noise(400), "", None]
            spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.mode("overwrite").parquet(path)
            names.clear(), saved.clear()
            found = suffix_dedup.remove_repeats(spark.read.parquet(path), shards=16)
            assert sorted(names) == ["borders", "spans"]
            assert [len(spark.read.parquet(p).inputFiles()) for p in saved[1:]] == [1] * suffix_dedup.BATCHES
            assert spark.sparkContext._jsc.getPersistentRDDs().size() <= held
            got = {r["doc_id"]: r for r in found.collect()}
            for i, (removed, runs, left) in enumerate(brute_repeats([(t or "").encode() for t in texts])):
                assert (got[i]["n_removed"], got[i]["n_spans"]) == (removed, runs) and bytes(got[i]["kept"]) == left, i
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_crowded_shards_are_dealt_again(spark, monkeypatch):
    """Fingerprints in tight groups, and one shard to begin with: dealt further until
    no shard is over the limit, and every pair is found."""
    monkeypatch.setattr(simhash, "SHARD_LIMIT", 40)
    monkeypatch.setattr(simhash, "FURTHER_SAMPLE", 30)
    rnd = random.Random(5)
    centres = [rnd.getrandbits(64) for _ in range(40)]
    fps = {c ^ (1 << rnd.randrange(64)) ^ (rnd.random() < 0.5 and 1 << rnd.randrange(64)) for c in centres for _ in range(15)}
    fps |= {rnd.getrandbits(64) for _ in range(300)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    groups = spark.createDataFrame([(f,) for f in signed], "fp long").repartition(4)
    found = {(r["a"], r["b"]) for r in simhash.links(groups, 2).collect()}
    parent = {f: f for f in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in found:
        assert ((a ^ b) & (1 << 64) - 1).bit_count() or a == b
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {f: find(f) for f in signed}
    parent = {f: f for f in signed}
    for i, a in enumerate(signed):
        for b in signed[:i]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {f: find(f) for f in signed}


def test_only_marked_rows_are_moved(spark):
    """Texts of documents without a partner are in no exchange."""
    rows = [(i, f"text number {i} " + " ".join(str(hash((i, k)) % 997) for k in range(80)), "en") for i in range(200)]
    rows += [(300 + i, rows[0][1], "en") for i in range(30)] + [(None, rows[1][1], "en"), (5, rows[5][1], "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    left = simhash.drop_near_duplicates(docs)
    fps = {r[0]: simhash.fingerprint(r[1]) for r in rows}
    assert left.columns == docs.columns and left.count() == 200
    assert {r["doc_id"] for r in left.collect()} == set(range(200))
    plan = left._jdf.queryExecution().optimizedPlan().toString()
    # one branch of rows whose bit is not set, and no join of rows but of those it is set for
    filters = [line for line in plan.split("\n") if "Filter" in line and "__mask" in line]
    assert any("Filter NOT" in f for f in filters) and any("Filter coalesce" in f for f in filters)
    first = plan[: plan.index("Filter coalesce")].split("+- Filter NOT")[1].split("\n:- ")[0]
    assert first.count("Join LeftOuter") == 1  # the bitmap's


def test_labels_without_number(spark):
    """10,000 labels, all but a few of them junk: bounded models, and rows of a label
    without a model of its own are kept under that label."""
    rnd = random.Random(3)
    word = lambda letters: "".join(rnd.choice(letters) for _ in range(rnd.randint(2, 7)))
    vocab = {"en": [word("abcdehinorst") for _ in range(200)], "xx": [word("жзиклмнопр") for _ in range(200)]}
    rows = [(i, " ".join(rnd.choices(vocab["en"], k=30)), "en", "s1") for i in range(500)]
    rows += [(1_000 + i, " ".join(rnd.choices(vocab["xx"], k=30)), f"j{i}", "s2") for i in range(10_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = langid.fit(docs.select("text", "lang"), 200, most=1)
    assert model.languages == ["en", "mul"] and model.table.nbytes < 1 << 20
    assert langid.fit(docs.select("text", "lang"), 20).table.nbytes < 20 << 20
    got = langid.identify(docs.repartition(4), model, "doc_id", "text", "lang", "source")
    assert got.filter("lang != declared").count() == 0 and got.filter("not kept").count() == 0
    assert langid.drop_unknown(docs, model).count() == len(rows)


def test_hashed_sample(spark):
    """The rows of least hash, the same with and without the filter, nulls included."""
    from mercato.llm.shared import hashed_sample

    df = spark.range(20_000).select(F.when(F.col("id") % 977 == 0, None).otherwise(F.col("id")).alias("id"), F.lit(1).alias("h"))
    want = [r["id"] for r in df.orderBy(F.xxhash64("id"), "id").limit(500).collect()]
    assert [r["id"] for r in hashed_sample(df, ["id"], 20_000, 500).collect()] == want
    assert hashed_sample(df, ["id"], 20_000, 30_000).count() == 20_000 and hashed_sample(df.limit(0), ["id"], 0, 5).count() == 0
