"""Toxicity: folding, the lexicon against naive matching, learned exceptions, and
accuracy on held-out labels."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from mercato.llm import toxicity
from mercato.llm.queries import QUERIES


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (None, " "),
        ("", " "),
        (" \t?! ", " "),
        ("You IDIOT!!", " you idiot "),
        ("1d10t 1D1OT ıdíöt", " idiot idiot idiot "),
        ("іdіоt ｉｄｉｏｔ 𝐢𝐝𝐢𝐨𝐭", " idiot idiot idiot "),
        ("id​i­ot ﻿idiot", " idiot idiot "),
        ("$tupid stup!d p@thetic lo$er l0s3r!!", " tupid stupid pathetic ioser ioser "),
        ("idiot,idiot;idiot—idiot。idiot", " idiot idiot idiot idiot idiot "),
        ("Straße 中文 привет", " strasse 中文 "),
    ],
)
def test_fold(text, want):
    got = toxicity.fold(text)
    assert got == want or (want.endswith("中文 ") and got.startswith(want))


def naive(lexicon: toxicity.Lexicon, text: str | None) -> float:
    """The weight, word by word, without an automaton."""
    words = toxicity.fold(text).split()
    spans = [toxicity.fold(p).split() for p in lexicon.exceptions]
    off = set()
    for span in spans:
        for i in range(len(words) - len(span) + 1):
            if words[i : i + len(span)] == span:
                off.update(range(i, i + len(span)))
    total = 0.0
    for i, w in enumerate(words):
        if i not in off:
            total += max([v for p, v in lexicon.entries.items() if (p == f" {w} " if p.endswith(" ") else w.startswith(p[1:]))], default=0.0)
    return total


def table(spark):
    rnd = random.Random(6)
    plain = ["".join(rnd.choice("abcdenorstu") for _ in range(rnd.randint(3, 9))) for _ in range(300)]
    rows, labels = [], []
    for i in range(600):
        words = rnd.choices(plain, k=rnd.randint(5, 120))
        toxic = i % 4 == 0
        if toxic:
            for _ in range(rnd.randint(1, 4)):
                words.insert(rnd.randrange(len(words)), rnd.choice(["nasty", "nastier", "dolt", "D0LT!", "sewer"]))
        elif i % 40 == 1:  # harmless in this company
            words += ["sewer", "pipe"]
        rows.append((i, " ".join(words), "x", 1))
        labels.append((i, 1 if toxic else 0, "y"))
    rows += [(700, None, "x", 1), (701, "", None, None), (None, "a dolt", "x", 1), (702, "word " * 30_000 + "dolt", "x", 1), (703, "dolt", "x", 1), (703, "dolt", "x", 1)]
    labels += [(700, 0, "y"), (700, None, "y"), (None, 1, "y"), (701, 0, None), (2, 0, "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, word string, toxic int"), spark.createDataFrame(labels, "doc_id long, toxic int, text string")


def test_scores(spark):
    docs, labels = table(spark)
    lexicon = toxicity.fit(docs, labels)
    assert " doit " in lexicon.entries and any(p.startswith(" nast") for p in lexicon.entries)
    assert "sewer pipe" in lexicon.exceptions and "trash can" in lexicon.exceptions
    got = toxicity.score(docs, lexicon).collect()
    texts = docs.collect()
    assert len(got) == len(texts) and toxicity.score(docs, lexicon).columns == ["doc_id", "score", "words", "weight"]
    by_id: dict = {}
    for r in got:
        by_id.setdefault(r["doc_id"], []).append(r)
    for r in texts:
        weight, words = naive(lexicon, r["text"]), len(toxicity.fold(r["text"]).split())
        found = by_id[r["doc_id"]][0]
        assert found["words"] == words and found["weight"] == pytest.approx(weight)
        a, b, c = lexicon.curve
        logit = a + b * math.log1p(weight) + c * math.sqrt(100 * weight / (words + toxicity.LENGTH_FLOOR))
        assert found["score"] == pytest.approx(1 / (1 + math.exp(-logit)))
    wrong = [i for i in range(600) if (by_id[i][0]["score"] >= 0.5) != (i % 4 == 0)]
    assert len(wrong) <= 12  # the shortest hit in the longest texts
    assert len(by_id[703]) == 2 and by_id[700][0]["score"] < 0.5 > by_id[701][0]["score"]
    # two hits of one weight count, and no order of batches matters
    assert sorted(tuple(r) for r in toxicity.score(docs.filter("doc_id < 100").repartition(7), lexicon).collect()) == sorted(tuple(r) for r in got if r["doc_id"] is not None and r["doc_id"] < 100)


def test_without_labels(spark):
    docs, labels = table(spark)
    for some, score in ((labels.limit(0), 0), (labels.filter("toxic = 0"), 0), (labels.filter("toxic = 1"), 1)):
        lexicon = toxicity.fit(docs, some)
        assert not lexicon.entries and {round(r["score"], 6) for r in toxicity.score(docs.limit(5), lexicon).collect()} == {score}
    lexicon = toxicity.fit(docs, labels, exceptions=())
    assert toxicity.score(docs.limit(0), lexicon).count() == 0
    assert toxicity.fit(docs.limit(0), labels).entries == {}


def test_query(spark):
    """Labels that were held out are foretold."""
    got = QUERIES["op12_toxicity"](spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == 10_000
    found = got.filter("held_out").join(labels, "doc_id").groupBy("toxic", "predicted").agg(F.count("*").alias("n")).collect()
    n = {(r["toxic"], r["predicted"]): r["n"] for r in found}
    assert n[1, 1] >= 0.9 * (n[1, 1] + n[1, 0]) and n[0, 0] >= 0.98 * (n[0, 0] + n[0, 1])
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in got.collect())
