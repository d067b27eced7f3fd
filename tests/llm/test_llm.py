"""Operators on small tables with nulls, repeated rows, ties and clashing names,
against brute force."""

from __future__ import annotations

import hashlib
import random
import zlib

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from mercato.llm import bitsliced, exact_dedup, html_text, langid, mixing, packing, sharding, simhash, suffix_dedup, token_files, tokens
from mercato.llm.shared import work_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, __row string"


def corpus() -> list[tuple]:
    rnd = random.Random(7)
    words = ["".join(rnd.choice("abcdeiorst") for _ in range(rnd.randint(2, 8))) for _ in range(400)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n)) + "."
    passage = text(120)
    rows = [(i, text(rnd.randint(1, 200)), "en", f"s{i % 3}") for i in range(40)]
    rows += [(100 + i, rows[3][1].upper() if i % 2 else rows[3][1], "en", "s0") for i in range(12)]
    rows += [(200 + i, f"{text(60)} {passage} {text(60)}", "fr", "s1") for i in range(8)]
    rows += [(300, None, None, None), (301, "", "en", None), (302, "  \t", "xx", "s9"), (None, text(30), "en", "s0"), (5, rows[5][1], "en", "s2")]
    rows += [(400, "A" * 1500, "en", "s0"), (401, text(4000), "en", "s1")]
    return [(*r, None, 3, "clash") for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def test_exact_dedup(docs, empty):
    got = exact_dedup.exact_dedup(docs, digest_all=True).collect()
    groups: dict = {}
    for r in corpus():
        groups.setdefault(hashlib.sha256(lower(r[1]).encode()).hexdigest(), []).append(r[0])
    assert len(got) == len(corpus())
    for r in got:
        ids = groups[r["full_hash"]]
        assert r["group_size"] == len(ids) and r["keep_id"] == max((i for i in ids if i is not None), default=None)
    assert sum(r["kept"] for r in got) == len(groups)
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_mixing(docs, empty):
    plan = mixing.mix_plan(docs).collect()
    total = sum(r["size"] for r in plan)
    targets = {r["source_size"]: r["target"] for r in plan}
    assert all(0 <= r["copies"] <= 3 for r in plan) and all(t <= 3 * s + 1e-6 for s, t in targets.items())
    per = {}
    for r in mixing.mix_plan(docs).groupBy("source").agg(F.first("target").alias("t")).collect():
        per[r["source"]] = r["t"]
    assert abs(sum(per.values()) - total) < 1e-6 * total
    assert mixing.mix(docs).columns == docs.columns and mixing.mix(docs).count() == sum(r["copies"] for r in plan)
    assert mixing.mix(empty).count() == 0


def check_shards(got, rows, shards):
    """Sizes, checksums, counts, slots, and every source spread over all shards."""
    facts = lambda t: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, *facts(t)) for i, t, _ in rows)
    assert all(r["law"] == "rows" and r["grown_shard"] is None for r in got)
    counts = Counter(r["shard"] for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1 and set(counts) <= set(range(shards))
    for s in counts:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(counts[s]))


def test_sharding(docs, empty):
    rows = [(r[0], r[1], r[3]) for r in corpus()]
    check_shards(sharding.shard(docs, shards=4, rows_per_bucket=5).collect(), rows, 4)
    check_shards(sharding.shard(docs, shards=4).collect(), rows, 4)
    assert sharding.shard(empty).count() == 0


def test_sharding_keeps_the_mixture(spark):
    """Two large sources among 6,000 of one document and 1,000 of two: those of one
    size share their fractions, so one bucket holds thousands of rows."""
    rows = [(i, f"one {i}", f"single{i}") for i in range(6_000)] + [(10_000 + i, f"two {i}", f"pair{i // 2}") for i in range(2_000)]
    rows += [(20_000 + i, f"a {i}", "a") for i in range(3_200)] + [(30_000 + i, f"b {i}", None) for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = sharding.shard(df, shards=8, rows_per_bucket=64).collect()
    check_shards(got, rows, 8)
    assert sorted((r["doc_id"], r["shard"], r["slot"]) for r in got) == sorted((r["doc_id"], r["shard"], r["slot"]) for r in sharding.shard(df.repartition(3), shards=8, rows_per_bucket=64).collect())
    source = {i: s for i, _, s in rows}
    per = Counter((source[r["doc_id"]], r["shard"]) for r in got)
    # the rows between those of a source are as many as the crowded fractions leave
    assert all(sum(per[s, k] for k in range(8)) == n for s, n in (("a", 3_200), (None, 800)))
    crowd = Counter(r["shard"] for r in got if (source[r["doc_id"]] or "").startswith("single"))
    assert len(crowd) >= 4  # a fraction of one half, 6,000 rows wide


def test_simhash(docs, empty):
    got = simhash.simhash_dedup(docs).collect()
    rows = corpus()
    fps = [simhash.fingerprint(r[1]) for r in rows]
    for t, fp in list(zip([r[1] for r in rows], fps))[:45]:
        w = lower(t).split()
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
        assert fp == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    label = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(fps):
            label[i] = min(label[j] for j, b in enumerate(fps) if (a ^ b).bit_count() <= 2)
    want = Counter()
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None]
        want[(r[0], min(ids, default=None))] += 1
    assert Counter((r["doc_id"], r["component_id"]) for r in got) == want
    assert simhash.drop_near_duplicates(docs).count() == len(set(label))
    assert simhash.simhash_dedup(empty).count() == 0


def test_close_pairs_are_all_found():
    rnd = np.random.default_rng(3)
    base = rnd.integers(0, 1 << 63, 300, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, base ^ np.uint64(1 << 40), base[:100] ^ np.uint64(3), base ^ np.uint64(7)]))
    tree = simhash.fit(fps[::3], 40, 6)
    home, queries = {}, {}
    for shard, part, own in simhash.route(fps, tree, 2):
        (home if own else queries).setdefault(shard, []).append(part)
    found = set()
    for shard in home:
        for a, b in simhash.close_pairs(np.concatenate(home[shard]), np.concatenate(queries.get(shard, [np.zeros(0, np.uint64)])), 2):
            found |= {frozenset(p) for p in zip(a.tolist(), b.tolist())}
    i, j = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2, 1))
    assert found == {frozenset(p) for p in zip(fps[i].tolist(), fps[j].tolist())}


@pytest.mark.parametrize("grouped", [50_000, 0])
def test_suffix_dedup(docs, empty, monkeypatch, grouped):
    monkeypatch.setattr(suffix_dedup, "GROUPED_CONTEXTS", grouped)
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix_dedup.remove_repeats(docs, shards=3).collect())
    raws = [(r[0], (r[1] or "").encode()) for r in corpus()]
    seen = Counter(b[i : i + 400] for _, b in raws for i in range(len(b) - 399))
    want = Counter()
    for key, b in raws:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - 399):
            if seen[b[i : i + 400]] > 1:
                gone[i : i + 400] = True
        want[(key, len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), bytes(x for x, g in zip(b, gone) if not g))] += 1
    assert got == want
    if grouped:
        assert suffix_dedup.remove_repeats(empty).count() == 0


def test_token_files(spark, docs, empty):
    path = work_path(spark, "tokens")
    token_files.write_token_files(docs, path)
    got = token_files.read_token_files(spark, path).orderBy("start").collect()
    plain = Tokenizer.from_file(tokens.default_vocabulary())
    want = Counter((r[0], np.array(plain.encode(r[1] or "", add_special_tokens=False).ids + [2], "<u4").tobytes()) for r in corpus())
    assert Counter((r["doc_id"], bytes(r["ids"])) for r in got) == want
    ids = [r["doc_id"] for r in got]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got]).tolist()][:-1]
    path = work_path(spark, "tokens")
    token_files.write_token_files(empty, path)
    assert token_files.read_token_files(spark, path).count() == 0


def test_rank_coding_round_trip():
    ranks = np.random.default_rng(1).integers(0, 1 << 32, 1001, dtype=np.uint64) >> np.random.default_rng(2).integers(0, 32, 1001, dtype=np.uint64)
    assert (token_files.unpack(*token_files.pack(ranks), len(ranks)) == ranks).all() and len(token_files.unpack(b"", b"", 0)) == 0


def test_encoder_equals_the_library():
    """Random texts of every kind of white space, added tokens and scripts, as
    strings and as Arrow columns, with a table that is full all the time."""
    plain = Tokenizer.from_file(tokens.default_vocabulary())
    ids = lambda texts: [np.array(x.ids, "<u2").tobytes() for x in plain.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    enc = tokens.Encoder(tokens.default_vocabulary(), most_words=60)
    odd = ["", " ", "  ", "a ", " a", "a  b", "a\n b", "a\n \nb", "x\u00a0 y", "don't 12 34\t\tq", "<|endoftext|> z", None] + [r[1] for r in corpus()]
    assert enc.encode(odd) == ids(odd) == enc.encode(pa.array(odd))
    rnd = random.Random(3)
    parts = [" ", "  ", "\n", "\t", "\r\n", "\u00a0", "\u3000", "\u2003", "\x1c", "\x0b", "\x0c", "\u0085", "a", "b", "don", "'s", "'re", "1", "23", "\u00e9"]
    parts += ["\u00df", "\u4e2d\u6587", "!", "...", "<|endoftext|>", "<|endo", "ftext|>", "\u2581", "x\u0301", "\U0001f600", "\0", "longword" * 6]
    for n in range(120):
        texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30))) for _ in range(40)]
        assert enc.encode(texts) == ids(texts)
        column = pa.array([*texts, None]).slice(n % 40)
        assert enc.encode(column, 2) == [x + b"\2\0" for x in ids(column.to_pylist())]
    assert enc.words.kept <= 60 and tokens.Encoder(tokens.default_vocabulary()).encode(pa.array([], pa.string())) == []


def test_added_tokens_as_the_plain_library(spark, tmp_path):
    from tokenizers import AddedToken

    end = "<|endoftext|>"
    texts = [f"x{end}y", end, f"{end}{end}", f"a {end} b", f"one{end} two  {end}", f" {end}", "<|endoftext |>", "plain text", "", "x ab", "ab cd", "b c", "a b\u00e9 c"]
    path = tokens.default_vocabulary()
    plain = Tokenizer.from_file(path)
    ids = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids[0] == [87, 50256, 88]
    enc = tokens.Encoder(path)
    assert [np.frombuffer(x, enc.dtype).tolist() for x in enc.encode(texts)] == ids
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = work_path(spark, "tokens")
    token_files.write_token_files(df, out)
    got = token_files.read_token_files(spark, out).orderBy("start").collect()
    assert [np.frombuffer(r["ids"], "<u4").tolist() for r in got] == [[*x, token_files.END_ID] for x in ids]
    assert [r["start"] for r in got] == [0, *np.cumsum([len(x) + 1 for x in ids]).tolist()][:-1]
    assert {r["doc_id"]: r["n"] for r in packing.pack(df).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()} == {i: len(x) + 1 for i, x in enumerate(ids)}
    # an added token beyond two bytes' ids, with a space inside
    plain.add_tokens([f"<extra{i}>" for i in range(15_300)] + [AddedToken("b c", normalized=False)])
    plain.save(str(tmp_path / "more.json"))
    enc = tokens.Encoder(str(tmp_path / "more.json"))
    texts += ["x <extra15299> y", "x b", "y c", "a b c d"]
    assert enc.dtype == "<u4" and [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_plain_words_need_no_pattern():
    """Words of letters, digits and signs get the library's ids without its pattern."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    words = ["plain", "Wörter,", "x1y22..", "(ÀÿØß)", "--#%", "3.14", "a_b", "<|", "endoftext", "Ünïcödé" * 3]
    odd = ["it's", "'", "²½", "a×b", "÷", "ж", "ªº", "Ā", "Â\xa0b", "\U0001f600", "\xad", "x\x7fy", "<|endoftext|>"]
    for plain in (False, True):
        enc = tokens.Encoder(path, plain=plain)
        lib.encode_special_tokens = plain
        through = []
        whole = enc.whole
        enc.whole = lambda texts, whole=whole, through=through: through.extend(t for t in texts if t) or whole(texts)
        for chosen, by_pattern in ((words, False), (odd, True), (words + odd, True), ([], False)):
            parts = [f" {w}".encode() for w in chosen]
            ids, size = enc.pieces_ids(parts)
            want = [lib.encode(p.decode(), add_special_tokens=False).ids for p in parts]
            assert [x.tolist() for x in np.split(ids, np.cumsum(size)[:-1])][: len(want)] == want and size.tolist() == [len(x) for x in want]
            assert bool(through) is by_pattern
            through.clear()
        for first in ("", "  ", "\n", "\r\n", "\t"):
            texts = [first + first.join([a, f" {b}", f"{b}{a}"]) for a in words for b in odd]
            got = [np.frombuffer(x, enc.dtype).tolist() for x in enc.encode(texts)]
            assert got == [x.ids for x in lib.encode_batch(texts, add_special_tokens=False)]
    assert tokens.plain_words([b"", b" a", b"", b"a", b" ", b"  a", b" a b", b" \xc3", b"\xa9", b" \xc3\xa9", b""]).tolist() == [False, True] + [False] * 7 + [True, False]
    assert tokens.plain_words([b" a", b" b"]).tolist() == [True, True] and tokens.plain_words([]).tolist() == []


def test_packing(docs, empty):
    """Every id of every document, encoded by the plain library, in exactly one
    piece; sequences without gaps, of at most 1024 ids, little padded."""
    got = packing.pack(docs).collect()
    plain = Tokenizer.from_file(tokens.default_vocabulary())
    ids = {}
    for i, (key, text, *_) in enumerate(corpus()):
        ids[i] = key, np.array(plain.encode(text or "", add_special_tokens=False).ids + [packing.END_ID], "<u4")
    copies = Counter((key, len(x)) for key, x in ids.values())  # a repeated id has the same text here
    covered = {k: np.zeros(k[1], int) for k in copies}
    held = {(key, len(x)): x for key, x in ids.values()}
    for r in got:
        k, part = (r["doc_id"], r["doc_tokens"]), slice(r["start"], r["start"] + r["length"])
        covered[k][part] += 1
        assert r["length"] > 0 and r["ids_crc32"] == zlib.crc32(held[k][part].tobytes())
    assert all((covered[k] == n).all() for k, n in copies.items())
    at = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at.get(r["sequence_id"], 0)
        at[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(at.values()) <= 1024 and packing.pack(empty).count() == 0
    # the order of a task's rows is the order of its pieces
    one = packing.pack(docs.filter("doc_id is not null").dropDuplicates(["doc_id"]).coalesce(1).sortWithinPartitions("doc_id")).collect()
    assert [(r["doc_id"], r["start"]) for r in sorted(one, key=lambda r: (r["sequence_id"], r["offset"]))] == sorted((r["doc_id"], r["start"]) for r in one)


def test_cuts_cost_the_least():
    rnd = random.Random(5)
    cuts = sorted({0, *(rnd.randint(1, 3000) for _ in range(60))})
    pen = [0] + [rnd.choice([0, 1, 8]) for _ in cuts[1:]]
    powers = {64, 128, 256, 512}
    pad = lambda n: 0 if n in powers else 1024 - n
    best = [0] + [10**9] * (len(cuts) - 1)
    for j in range(1, len(cuts)):
        best[j] = min((best[i] + pad(cuts[j] - cuts[i]) + pen[j] + packing.WINDOW_COST for i in range(j) if cuts[j] - cuts[i] <= 1024), default=10**9)
    path = packing.least_cost_cuts(cuts, pen)
    cost = sum(pad(b - a) + pen[cuts.index(b)] + packing.WINDOW_COST for a, b in zip(path, path[1:]))
    assert cost == best[-1]


def test_top_k(spark):
    rnd = random.Random(2)
    rows = [(i, [rnd.uniform(-1, 1) for _ in range(9)]) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(40)] + [(7, rows[1][1]), (50, None), (100, [None] * 9), (150, [float("nan")] * 9), (None, rows[2][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = bitsliced.top_k(df, df.filter("vec_id % 50 = 0"), block_rows=64, block_queries=4).collect()
    good = [(i, np.floor(np.array(v) * 256).astype(int)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()]
    want = Counter()
    for i, q in good:
        if i % 50 == 0:
            best = sorted((-int(q @ v), j) for j, v in good if j != i)[:5]
            want.update((i, n + 1, j, -s) for n, (s, j) in enumerate(best))
    assert Counter(tuple(r) for r in got) == want


def top(rows, queries, k=5):
    want = Counter()
    for i in queries:
        best = sorted((-sum(a * b for a, b in zip(dict(rows)[i], v)), j) for j, v in rows if j != i)[:k]
        want.update((i, n + 1, j, -s) for n, (s, j) in enumerate(best))
    return want


def test_top_k_of_large_components(spark):
    """Whole numbers over 256 as components, so that the quantised ones are plain; sizes
    from 1 to 2^40 in one block, empty and short vectors."""
    rnd = random.Random(4)
    rows = [(0, (300, 1)), (1, (70_000, 0)), (2, (1, 2)), (3, ()), (4, (-(1 << 30), 5)), (5, (1 << 31, 7)), (50, (-3,)), (100, ())]
    rows += [(200 + i, tuple(rnd.randint(-(1 << rnd.randint(1, 27)), 1 << rnd.randint(1, 27)) for _ in range(3))) for i in range(90)]
    df = spark.createDataFrame([(i, [x / 256 for x in v]) for i, v in rows], "vec_id long, embedding array<double>")
    asked = [i for i, _ in rows if i % 50 == 0]
    got = bitsliced.top_k(df, df.filter("vec_id % 50 = 0"), block_rows=40, block_queries=2).collect()
    assert Counter(tuple(r) for r in got) == top(rows, asked)
    # integers of any size where 64 bits may not do
    huge = [(0, (1 << 35, 3)), (1, (1 << 26, 1)), (2, (-(1 << 26), 9)), (3, (0, 1))]
    df = spark.createDataFrame([(i, [x / 256 for x in v]) for i, v in huge], "vec_id long, embedding array<double>")
    assert Counter(tuple(r) for r in bitsliced.top_k(df, df.filter("vec_id = 0")).collect()) == top(huge, [0])
    for beyond in ([(0, (float(1 << 60),)), (1, (2.0,))], [(0, (float(1 << 30),)), (1, (float(1 << 30),))]):
        df = spark.createDataFrame([(i, list(v)) for i, v in beyond], "vec_id long, embedding array<double>")
        with pytest.raises(Exception, match="beyond a long"):
            bitsliced.top_k(df, df.filter("vec_id = 0")).collect()


def test_top_k_of_little(spark):
    schema = "vec_id long, embedding array<double>, score long, rank string"
    none = spark.createDataFrame([], schema)
    one = spark.createDataFrame([(1, [0.5], 9, "x"), (2, None, 9, "x"), (1, [0.25], 9, "x")], schema)
    assert bitsliced.top_k(none, none).collect() == [] == bitsliced.top_k(one, none).collect() == bitsliced.top_k(none, one).collect()
    assert bitsliced.top_k(one, one).collect() == []  # its own id only
    assert [tuple(r) for r in bitsliced.top_k(one, spark.createDataFrame([(3, [1.0, 4.0], 0, "")], schema)).collect()] == [(3, 1, 1, 32768), (3, 2, 1, 16384)]


def test_html():
    page = """<html><body><header>Site</header><div id="cookie-notice">We use cookies, a lot of them.</div><div class="sidebar"><p>Links, and more, links.</p></div>
    <div class="content"><h1>T &amp; U</h1><p>First, with <b>bold</b>   text, long enough to count as an article.<p>Second, &eacute;t&eacute;, also long enough, with commas.</div>
    <div class="comments"><p>I think, as a reader, that this is good, really.</p></div><footer>c</footer>"""
    assert html_text.main_text(page) == "T & U\nFirst, with bold text, long enough to count as an article.\nSecond, \u00e9t\u00e9, also long enough, with commas."
    assert html_text.main_text(None) == html_text.main_text("") == "" and html_text.main_text("plain") == "plain"


LONG = "A long section, with commas, clauses, and so on, that goes on for a while, as prose does. " * 20
LINKS = '<ul><li><a href="/1">One other page</a></li><li><a href="/2">Two other pages</a></li></ul>'


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("<div class=post><h1>Title</h1><div class=text><p>First, it is a paragraph.</p><p>Second, it is another one.</p></div></div>", ["Title", "First, it is a paragraph.", "Second, it is another one."]),
        (f"<div>{LINKS}<div><p>{LONG}</p><p>{LONG}</p></div><div><p>A short section, but a section.</p></div>{LINKS}</div>", [LONG.strip(), LONG.strip(), "A short section, but a section."]),
        (f"<div><div><p>{LONG}</p></div>Bare <a href=x>text</a> here.<h3>List</h3><ul><li>x</li><li>y</li></ul><table><tr><td>1</td><td>2</td></tr></table><pre>code</pre><p>End.</p></div>", [LONG.strip(), "Bare text here.", "List", "x", "y", "1", "2", "code", "End."]),
        (f"<h1><a href=/>Linked title</a></h1><div><div><p>{LONG}</p></div></div><div><a href=/a>Home</a> | <a href=/b>About us</a></div>", ["Linked title", LONG.strip()]),
        (f"<form id=aspnet><h2>Intro</h2><div>Words, in a form.</div><div><p>{LONG}</p><p>Last.</p></div><input value=x><button>Go</button></form>", ["Intro", "Words, in a form.", LONG.strip(), "Last."]),
        (f"<div><p>{LONG}</p></div><form><p>Write to us, if you like, with your name.</p><label>Name</label></form>", [LONG.strip()]),
    ],
)
def test_html_without_article(body, want):
    page = f"<html><body><nav>{LINKS}</nav>{body}<div class=sidebar><p>Aside, and more, aside.</p></div><footer><p>Foot, of the page.</p></footer></body></html>"
    assert html_text.main_text(page).split("\n") == want


def test_language_id(spark, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs.filter("doc_id % 2 = 0").select("text", "lang"), 200)
    got = langid.identify(docs.filter("doc_id % 2 = 1"), model, "doc_id", "text", "lang", "source")
    assert got.filter("text_lang = declared").count() >= 0.98 * got.count() and got.filter("not kept").count() == 0
    odd = spark.createDataFrame([(1, None, None, None), (2, "\u4e00\u4e8c\u4e09" * 200, None, "s"), (None, "", "en", "s")], "doc_id long, text string, lang string, source string")
    kept = langid.drop_unknown(odd, model)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == {1, None}
    assert langid.identify(empty, model, "doc_id", "text", "lang", "source").count() == 0
    assert langid.fit(empty.select("text", "lang")).languages == []


def test_every_labelled_language_has_a_model(spark):
    rnd = random.Random(11)
    word = lambda letters: "".join(rnd.choice(letters) for _ in range(rnd.randint(2, 7)))
    english = [word("abcdefghijklmnorstuvw") for _ in range(300)]
    rows = [(i, " ".join(rnd.choices(english, k=25)), "en", f"s{i % 5}") for i in range(8_000)]
    greek = [word("\u03b1\u03b2\u03b3\u03b4\u03b5\u03b6\u03b7\u03b8") for _ in range(30)]
    rows += [(10_000 + i, " ".join(rnd.choices(greek, k=60)), "el" if i else "el-GR", "s1") for i in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = langid.fit(docs.select("text", "lang"))
    assert model.languages == ["el", "el-gr", "en"]
    assert langid.drop_unknown(docs, model).count() == len(rows)
    got = langid.identify(docs.filter("doc_id >= 10000"), model, "doc_id", "text", "lang", "source").collect()
    assert {r["doc_id"]: r["lang"] for r in got} == {10_000: "el-gr", 10_001: "el"}
    # more languages than 32, each in a script of its own
    many = []
    for n in range(40):
        words = [word([chr(0x400 + 40 * n + j) for j in range(20)]) for _ in range(20)]
        many += [(100 * n + i, " ".join(rnd.choices(words, k=40)), "x" + "abcdefghij"[n // 10] + "abcdefghij"[n % 10], "s") for i in range(3)]
    docs = spark.createDataFrame(many, "doc_id long, text string, lang string, source string")
    model = langid.fit(docs.filter("doc_id % 100 < 2").select("text", "lang"))
    assert len(model.languages) == 40
    got = langid.identify(docs, model, "doc_id", "text", "lang", "source").collect()
    assert {(r["doc_id"], r["lang"], r["kept"]) for r in got} == {(i, lang, True) for i, _, lang, _ in many}


def test_pipeline(spark, docs):
    import corpus_pipeline

    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, None)
        assert at.columns == docs.columns, name
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
