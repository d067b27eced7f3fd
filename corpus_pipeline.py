"""Corpus pipeline: language ID, exact dedup, SimHash near-dedup, source mixing,
packing, each over everything its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mercato.llm.exact_dedup import drop_exact_duplicates
from mercato.llm.langid import drop_unknown, fit
from mercato.llm.mixing import mix
from mercato.llm.packing import pack
from mercato.llm.shared import read_table, save, shipped
from mercato.llm.simhash import drop_near_duplicates


#: Words the encoder remembers for each worker, which the stages before share: 13 MB.
REMEMBERED_WORDS = 1 << 17


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_unknown(docs, fit(docs.select("text", "lang")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_exact_duplicates(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, most_words=REMEMBERED_WORDS)


STAGES = [(f.__name__, shipped(f)) for f in (language_id, exact_dedup, simhash_dedup, source_mixing, packing)]

#: Trained models, fingerprints and token ids are beyond SQL; the tests compare
#: each stage with a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
