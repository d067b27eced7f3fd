"""Token alignment against brute force over whole texts."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import sentencepiece
from tokenizers import Tokenizer

from mercato.llm import alignment
from mercato.llm.queries import QUERIES
from mercato.llm.tokens import default_vocabulary

SCHEMA = "doc_id long, text string, run string, part string, at string, heads string"


def texts() -> list[str | None]:
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abcdeéßñ'-ж中") for _ in range(rnd.randint(1, 9))) for _ in range(60)]
    odd = [None, "", " ", "  ", "\n", "a  b\tc\n\nd ", "x  y", "▁x", "a ▁ b", "<s> </s> <unk> <0x41> <|endoftext|>", "é ① ﬁne", "\0", "longword" * 60, "!" * 300, "a" * 4000]
    odd += [" lead", "\nlead", "trail ", "trail\n", "don't 12 3", "\U0001f600 \U0001f600", "x" + " " * 40 + "y", "a;\r\nb {\r\n\r\n} \r", "\r", "x\r y"]
    return odd + [rnd.choice([" ", " ", "\n", "  "]).join(rnd.choices(words, k=rnd.randint(1, 60))) for _ in range(150)] + ["same text, same text"] * 5


def brute(rows: list[str | None]) -> list[tuple]:
    a = Tokenizer.from_file(default_vocabulary())
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=alignment.default_second_vocabulary())
    shown = [i for i in range(256) if 33 <= i < 127 or 161 <= i < 173 or 174 <= i]
    byte = {chr(i): i for i in shown} | {chr(256 + n): i for n, i in enumerate(i for i in range(256) if i not in shown)}
    per, count = [], Counter()
    for text in rows:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a = [bytes(byte[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not text or not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            per.append(None)
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]), np.cumsum([len(x) for x in bytes_b])
        groups, i, j = [], 0, 0
        for end in sorted(set(ends_a.tolist()) & set(ends_b.tolist())):
            i1, j1 = int(np.searchsorted(ends_a, end)) + 1, int(np.searchsorted(ends_b, end)) + 1
            groups.append((ids_a[i:i1], ids_b[j:j1]))
            i, j = i1, j1
        links = Counter((x, y) for ga, gb in groups for x in ga for y in gb)
        count.update(links.keys())
        per.append((ids_a, ids_b, groups, links))
    top: dict[int, int] = {}
    for (x, _), n in count.items():
        top[x] = max(top.get(x, 0), n)
    out = []
    for p in per:
        if p is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        ids_a, ids_b, groups, links = p
        text = ";".join(f"{','.join(map(str, ga))}|{','.join(map(str, gb))}" for ga, gb in groups)
        best = sum(n for (x, y), n in links.items() if count[x, y] == top[x])
        out.append((len(ids_a), len(ids_b), len(groups), sum(links.values()), best, sum(n * count[k] for k, n in links.items()), text))
    return out


def test_alignment(spark, monkeypatch):
    """Nulls, empty and long texts, texts whose bytes do not come back, copies, and
    columns named like the operator's own; small batches, so many runs are merged in
    more than one round."""
    monkeypatch.setattr(alignment, "FAN", 3)
    rows = texts()
    # repeated and null ids are documents like any others
    df = spark.createDataFrame([(None if i == 30 else min(i, 160), t, "x", "y", "z", "h") for i, t in enumerate(rows)], SCHEMA).repartition(20)
    want = brute(rows)
    got = alignment.align(df, keep_groups=True).collect()
    fixed = Counter((None if i == 30 else min(i, 160), *w) for i, w in enumerate(want))
    assert Counter(tuple(r) for r in got) == fixed
    assert sum(w[0] == 0 for w in want) == 4 and sum(w[3] > w[1] for w in want) > 50
    digest = alignment.align(df).collect()
    assert Counter((r["doc_id"], r["groups"]) for r in digest) == Counter((k[0], hashlib.sha256(k[-1].encode()).hexdigest() if k[-1] else "") for k in fixed.elements())
    assert alignment.align(df.limit(0)).count() == 0
    nothing = alignment.align(df.filter("text is null")).collect()
    assert [tuple(r) for r in nothing] == [(0, 0, 0, 0, 0, 0, 0, "")]


def test_batches_do_not_matter():
    rows = texts()
    al = alignment.Aligner(default_vocabulary(), alignment.default_second_vocabulary())
    whole = al.batch(pa.array(rows, pa.string()), True)
    one = [al.batch(pa.array([t], pa.string()), True) for t in rows]
    assert (whole[0] == np.concatenate([x[0] for x in one])).all() and whole[1] == [x[1][0] for x in one]
    want = sorted((int(c), i, int(n)) for i, x in enumerate(one) for c, n in zip(x[2], x[4]))
    assert list(zip(*(x.tolist() for x in whole[2:]))) == want


def test_merged_runs(monkeypatch):
    """The heap merge against a counter, with frames far shorter than the runs."""
    monkeypatch.setattr(alignment, "FRAME", 7)
    rnd = random.Random(1)
    runs = [Counter({rnd.randrange(200): rnd.randint(1, 9) for _ in range(rnd.randint(0, 90))}) for _ in range(12)] + [Counter({5: 1})] * 3
    blobs = [alignment.heads(np.array(sorted(r), np.int64), np.array([r[c] for c in sorted(r)], np.int64)) for r in runs]
    found = [(int(c), int(n)) for codes, counts in alignment.merged([alignment.runs_frames(b) for b in blobs]) for c, n in zip(codes, counts)]
    assert found == sorted(sum(runs, Counter()).items())
    assert list(alignment.merged([])) == []


def test_query(spark):
    found = QUERIES["op11_spill_alignment"](spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want = {r["doc_id"]: w for r, w in zip(docs, brute([r["text"] for r in docs]))}
    rows = found.collect()
    assert len(rows) == len(docs)
    for r in rows:
        w = want[r["doc_id"]]
        assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"]) == w[:6]
        assert r["groups_sha256"] == (hashlib.sha256(w[6].encode()).hexdigest() if w[6] else "")
