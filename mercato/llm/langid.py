"""Language identification by Bayesian evidence fusion.

For every row three kinds of evidence are multiplied: the likelihood of the
whole text under byte-trigram models, the likelihood of the declared markup
language given the true one, and a prior of the row's host. The host prior is
smoothed hierarchically: hosts towards the prior of their address suffix,
suffixes towards the prior of the whole table. Priors and declaration
likelihoods are grouped sums of the text-only posteriors of all rows.

An ``unknown`` class with a uniform trigram distribution competes with the
languages; rows it wins are rejected. Every labelled language has a text model,
fitted on a bounded sample of its own rows (``SAMPLE_ROWS``), whatever its share of the
table. A model has ``MOST_LANGUAGES`` languages, those with the most rows; the texts of
all further labels make up one class of their own, ``mul``, with a text model and priors
like any other. Rows that it wins are kept, and what they declare is their language.
Everything else covers all rows.

Defined cases: a null or letterless text gives no text evidence, so declaration
and host decide and the row is kept; a null or unheard-of declaration counts as a value of its own;
a declaration with a region names the labelled language of that name, else the one before the region;
a label ``und`` is no language; a text with two labels counts for both;
a null host is a host of its own; ties go to the earlier language by code point;
repeated rows are scored alike; without labelled rows every row is ``unknown``
and kept; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mercato.llm.shared import attach, save

UNKNOWN, SEVERAL = "und", "mul"
#: Languages that have a text model of their own (17 MB for 64).
MOST_LANGUAGES = 64
#: Distinct texts of each language that its text model is fitted on, at most.
SAMPLE_ROWS = 1_500
BUCKETS = 1 << 16
#: Trigrams of a text that are looked up in one go.
LOOKED_UP = 1 << 14
#: Overlapping trigrams are not independent: their evidence is divided by this.
OVERLAP = 3.0
#: Weight, in rows, of the smoothing towards the next level; prior of ``unknown``.
SMOOTHING, UNKNOWN_PRIOR = 20.0, 1e-4
#: Up to so many hosts their priors are broadcast.
BROADCAST_HOSTS = 10_000

#: Letters in lower case, other ASCII as a space, the rest as it is.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
MARKUP = re.compile(rb"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>")


def trigrams(text: str | None, markup: bool = False) -> np.ndarray:
    """Hashed byte trigrams of the whole text, those without a letter left out."""
    raw = (text or "").encode("utf-8", "replace")
    if markup:
        raw = html.unescape(MARKUP.sub(b" ", raw).decode("utf-8", "replace")).encode("utf-8", "replace")
    b = np.frombuffer(b" " + raw.translate(FOLD) + b" ", np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.uint32)
    grams = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
    grams = grams[(b[1:-1] != 32) | ((b[:-2] != 32) & (b[2:] != 32))]
    return (grams * np.uint32(2654435761)) >> np.uint32(16)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # (BUCKETS, languages + 1): log-likelihoods, the last of ``unknown``


def sampled(rows: DataFrame, sample_rows: int) -> DataFrame:
    """(text, lang): of each language the distinct texts of least hash."""
    hashed = rows.withColumn("h", F.xxhash64("text"))
    # only hashes are ranked, and of each language about twice the sample
    marks = save(hashed.select("lang", "h").distinct(), "hashes")
    sizes = marks.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    # signed order: the share of hashes below one is its distance from the least long
    share = F.col("h") / F.lit(2.0**64) + 0.5
    few = marks.join(F.broadcast(sizes), "lang").filter(share * F.col("n") <= 2 * sample_rows + 50)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    chosen = few.withColumn("rank", rank).filter(F.col("rank") <= sample_rows).select("lang", "h")
    return hashed.join(F.broadcast(chosen), ["lang", "h"]).dropDuplicates(["lang", "h"]).select("text", "lang")


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, most: int = MOST_LANGUAGES) -> Model:
    """Trigram models from rows (text, lang): for each language a sample by hash
    of the text, and for the labels beyond ``most`` one together."""
    rows = labelled.select(F.col("text").cast("string").alias("text"), F.lower(F.trim("lang")).alias("lang")).filter(f"text is not null and lang is not null and lang not in ('', '{UNKNOWN}')")

    per = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    own = [r["lang"] for r in per.orderBy(F.desc("n"), "lang").limit(most + 1).collect()]
    if len(own) > most:
        rows = rows.withColumn("lang", F.when(F.col("lang").isin(own[:most]), F.col("lang")).otherwise(SEVERAL))

    def count(batches):
        for pdf in batches:
            for lang, texts in pdf.groupby("lang")["text"]:
                found = np.zeros(BUCKETS, np.int64)
                for text in texts:
                    found += np.bincount(trigrams(text), minlength=BUCKETS)
                # a language stays one even if its texts have no trigram
                at = np.union1d(np.flatnonzero(found), [0])
                yield pd.DataFrame({"lang": lang, "bucket": at, "n": found[at]})

    # one row per language and bucket
    counts = sampled(rows, sample_rows).mapInPandas(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counts["lang"].unique())
    table = np.full((BUCKETS, len(languages) + 1), -np.log(BUCKETS), np.float32)
    for lang, part in counts.groupby("lang"):
        c = np.full(BUCKETS, 0.05)
        c[part["bucket"].to_numpy(np.int64)] += part["n"].to_numpy(np.float64)
        table[:, languages.index(lang)] = np.log(c / c.sum())
    return Model(languages, table)


def text_evidence(model: Model, markup: bool = False):
    """A column function: tempered log-likelihoods of the text by class."""
    table = model.table

    def evidence(t: str | None) -> np.ndarray:
        grams = trigrams(t, markup)
        total = np.zeros(table.shape[1])
        for at in range(0, len(grams), LOOKED_UP):
            total += table[grams[at : at + LOOKED_UP]].sum(axis=0, dtype=np.float64)
        return total / OVERLAP

    @F.pandas_udf("array<double>")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([evidence(t) for t in texts])

    return score


def _numbers(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _posterior(scores: Column) -> Column:
    best = F.array_max(scores)
    exps = F.transform(scores, lambda x: F.exp(x - best))
    total = F.aggregate(exps, F.lit(0.0), lambda a, x: a + x)
    return F.transform(exps, lambda x: x / total)


def with_evidence(rows: DataFrame, model: Model, text: str, declared: str, host: str, markup: bool = False) -> DataFrame:
    """``rows`` with host, suffix, number of the declared language and evidence."""
    said = F.lower(F.trim(F.coalesce(F.col(declared).cast("string"), F.lit(""))))
    short = F.regexp_extract(said, "^[a-z]+", 0)
    k = len(model.languages)
    number = F.when(short == "", F.lit(k + 1)).otherwise(F.lit(k))
    if model.languages:
        names = F.array(*[F.lit(x) for x in model.languages])
        at = [F.nullif(F.array_position(names, x), F.lit(0)) - 1 for x in (said, short)]
        number = F.coalesce(*at, number).cast("int")
    return rows.select(
        "*",
        F.lower(F.coalesce(F.col(host).cast("string"), F.lit(""))).alias("__host"),
        F.regexp_extract(F.lower(F.coalesce(F.col(host).cast("string"), F.lit(""))), r"([^.]*)$", 1).alias("__suffix"),
        number.alias("__said"),
        text_evidence(model, markup)(F.col(text).cast("string")).alias("__text"),
    )


def priors(evidence: DataFrame, model: Model) -> tuple[DataFrame, np.ndarray]:
    """(host, n, log prior by class) and log P(declared | class)."""
    k = len(model.languages) + 1
    # "unknown" starts out as rare for the text-only posteriors too
    start = [np.log((1 - UNKNOWN_PRIOR) / max(1, k - 1))] * (k - 1) + [np.log(UNKNOWN_PRIOR)]
    soft = evidence.select("__host", "__suffix", "__said", _posterior(F.zip_with("__text", _numbers(start), lambda x, p: x + p)).alias("r"))
    cells = save(soft.groupBy("__host", "__suffix", "__said").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("r")[i]).alias(f"c{i}") for i in range(k)]), "language-sums")
    sums = [F.sum(f"c{i}").alias(f"c{i}") for i in range(k)]
    # a row for each language and two
    said = cells.groupBy("__said").agg(*sums).collect()
    confusion = np.full((k + 1, k), 0.5)
    for r in said:
        confusion[r["__said"]] += [r[f"c{i}"] or 0.0 for i in range(k)]
    whole = confusion.sum(axis=0)
    overall = whole / whole.sum()
    hosts = cells.groupBy("__host", "__suffix").agg(F.sum("n").alias("n"), *sums)
    suffixes = save(hosts.groupBy("__suffix").agg(F.count(F.lit(1)).alias("w"), F.sum("n").alias("sn"), *[F.sum(f"c{i}").alias(f"s{i}") for i in range(k)]), "suffixes")
    joined = attach(hosts, suffixes, ["__suffix"], "w", ["__host"])
    prior = []
    for i in range(k):
        of_suffix = (F.col(f"s{i}") + SMOOTHING * float(overall[i])) / (F.col("sn") + SMOOTHING)
        prior.append(F.log((F.col(f"c{i}") + SMOOTHING * of_suffix) / (F.col("n") + SMOOTHING)))
    table = save(joined.select("__host", "n", F.array(*prior).alias("__prior")), "host-priors")
    return table, np.log(confusion / confusion.sum(axis=0))


def fused(evidence: DataFrame, model: Model, hosts: DataFrame, declared: np.ndarray, spread_by: list[str]) -> DataFrame:
    """``evidence`` with ``__lang``, its probability ``__p`` and the text's own choice."""
    if hosts.count() <= BROADCAST_HOSTS:
        h = hosts.select(F.col("__host").alias("__h"), "__prior")
        rows = evidence.join(F.broadcast(h), evidence["__host"] == h["__h"], "left").drop("__h")
    else:
        rows = attach(evidence, hosts, ["__host"], "n", spread_by).drop("n")
    names = F.array(*[F.lit(x) for x in [*model.languages, UNKNOWN]])
    by_declared = evidence.sparkSession.createDataFrame([(i, row.tolist()) for i, row in enumerate(declared)], "__number int, __declared array<double>")
    rows = rows.join(F.broadcast(by_declared), F.col("__said") == F.col("__number"), "left")
    total = F.zip_with(F.zip_with("__text", "__prior", lambda x, p: x + p), "__declared", lambda x, p: x + p)
    # a text without letters is no evidence against the languages
    silent = (F.array_max("__text") == 0) & (F.array_min("__text") == 0)
    known = F.slice(total, 1, len(model.languages))
    total = F.when(silent & F.lit(bool(model.languages)), F.concat(known, F.array(F.lit(float("-inf"))))).otherwise(total)
    rows = rows.withColumn("__post", _posterior(total))
    pick = lambda c: F.get(names, (F.array_position(c, F.array_max(c)) - 1).cast("int"))
    return rows.select("*", pick(F.col("__post")).alias("__lang"), F.array_max("__post").alias("__p"), pick(F.col("__text")).alias("__text_lang"))


def _named(lang: Column, declared: Column) -> Column:
    """The language of a row: what it declares where its class is that of several."""
    said = F.nullif(F.lower(F.trim(declared.cast("string"))), F.lit(""))
    return F.when(lang == SEVERAL, F.coalesce(said, lang)).otherwise(lang)


def identify(rows: DataFrame, model: Model, id_col: str, text: str, declared: str, host: str, markup: bool = False) -> DataFrame:
    """Per row id, host, declared, lang (``und`` if rejected), probability,
    the language by text alone, and kept."""
    slim = rows.select(F.col(id_col).alias("__id"), F.col(text).alias("__t"), F.col(declared).alias("__d"), F.col(host).alias("__a"))
    evidence = save(with_evidence(slim, model, "__t", "__d", "__a", markup).drop("__t"), "evidence")
    hosts, said = priors(evidence, model)
    found = fused(evidence, model, hosts, said, ["__id"])
    return found.select(
        F.col("__id").alias(id_col),
        F.col("__a").alias("host"),
        F.col("__d").alias("declared"),
        _named(F.col("__lang"), F.col("__d")).alias("lang"),
        F.round("__p", 6).alias("probability"),
        F.col("__text_lang").alias("text_lang"),
        (F.lit(not model.languages) | (F.col("__lang") != UNKNOWN)).alias("kept"),
    )


def drop_unknown(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", declared_col: str = "lang", host_col: str = "source") -> DataFrame:
    """``docs`` without the rows that the unknown class wins."""
    if not model.languages:
        return docs
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__row"), docs[id_col].alias("__id"), docs[text_col].alias("__t"), docs[declared_col].alias("__d"), docs[host_col].alias("__a"))
    evidence = with_evidence(rows, model, "__t", "__d", "__a").drop("__t")
    hosts, said = priors(evidence, model)
    return fused(evidence, model, hosts, said, ["__id"]).filter(F.col("__lang") != UNKNOWN).select("__row.*")
