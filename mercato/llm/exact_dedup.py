"""Exact duplicates by progressive refinement: length, prefix hash, full hash.

Texts are equal when identical after lower-casing A-Z; a null text is empty.
One narrow scan groups documents by (length, prefix hash), and nothing but
those two numbers is shuffled. The groups of two or more are written into a
bitmap of fixed size, which is broadcast; a second scan hashes the full content
of the documents whose bit is set and of no others. A document whose bit is set
by chance costs one hash and then finds no partner, so the result is exact at
any fill of the bitmap. Only hashes travel: texts are never shuffled to find
duplicates.

Defined cases: an empty table gives an empty result; null ids count as smaller
than any id; of rows that agree in id and text, one stays; other columns are
ignored (``exact_dedup``) or carried (``drop_exact_duplicates``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercato.llm.shared import attach, save

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PREFIX_CHARS = 128
#: Bits of the broadcast bitmap: 2^17 words of 64 bits, 2 MB whatever the input.
BITMAP_BITS = 1 << 23


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)


def _sketched(docs: DataFrame, text_col: str, carried: list[Column]) -> DataFrame:
    """``carried``, the normalised text, its length and its prefix hash."""
    texts = docs.select(*carried, normalised(docs[text_col]).alias("__norm"))
    return texts.select("*", F.octet_length("__norm").alias("__len"), F.xxhash64(F.substring("__norm", 1, PREFIX_CHARS)).alias("__prefix"))


def _marked(sketched: DataFrame, bits: int) -> DataFrame:
    """Adds ``__hit``: the document's (length, prefix) group has a second member,
    up to chance hits of the bitmap."""
    at = F.pmod(F.xxhash64("__len", "__prefix"), F.lit(bits))
    word, bit = F.shiftright(at, 6), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(__len, __prefix), {bits}) % 64 as int))")
    pairs = sketched.groupBy("__len", "__prefix").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
    bitmap = pairs.groupBy(word.alias("__word")).agg(F.bit_or(bit).alias("__mask"))
    placed = sketched.withColumn("__at", word)
    joined = placed.join(F.broadcast(bitmap), placed["__at"] == bitmap["__word"], "left")
    return joined.withColumn("__hit", F.coalesce(F.col("__mask").bitwiseAND(bit) != 0, F.lit(False))).drop("__word", "__mask", "__at")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITMAP_BITS, digest_all: bool = False) -> DataFrame:
    """One row per document: ``id_col``, ``keep_id`` (largest id of its equal
    texts), ``group_size``, ``kept`` and ``full_hash`` (SHA-256 of the
    normalised text; null where no second document shares length and prefix,
    unless ``digest_all`` asks for every document's)."""
    marked = _marked(_sketched(docs, text_col, [docs[id_col].alias("__id")]), bits)
    sha = F.sha2("__norm", 256)
    full = sha if digest_all else F.when(F.col("__hit"), sha)
    # the tag tells repeated rows apart; written, so it is the same for all who read it
    rows = save(marked.select("__id", F.monotonically_increasing_id().alias("__tag"), "__hit", full.alias("full_hash")), "hashes")
    order = F.struct(F.coalesce(F.col("__id"), F.lit(-(1 << 63)).cast("long")), F.col("__tag"))
    groups = save(
        rows.filter("__hit").groupBy(F.col("full_hash").alias("__key")).agg(F.max_by(F.struct("__id", "__tag"), order).alias("__keep"), F.count(F.lit(1)).alias("__n")).filter("__n >= 2"),
        "groups",
    )
    alone = F.concat(F.lit("#"), F.col("__tag").cast("string"))
    keyed = rows.withColumn("__key", F.when(F.col("__hit"), F.col("full_hash")).otherwise(alone))
    found = attach(keyed, groups, ["__key"], "__n", ["__tag"])
    return found.select(
        F.col("__id").alias(id_col),
        F.when(F.col("__n").isNull(), F.col("__id")).otherwise(F.col("__keep.__id")).alias("keep_id"),
        F.coalesce("__n", F.lit(1).cast("long")).alias("group_size"),
        (F.col("__n").isNull() | (F.col("__keep.__tag") == F.col("__tag"))).alias("kept"),
        "full_hash",
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITMAP_BITS) -> DataFrame:
    """``docs`` without the duplicates: of equal texts the row with the largest
    id stays. Documents without a partner pass straight through; the others are
    reduced per full hash, on the map side first, so a text with very many
    copies leaves one row per task."""
    marked = _marked(_sketched(docs, text_col, [F.struct(*[docs[c] for c in docs.columns]).alias("__row"), docs[id_col].alias("__id")]), bits)
    single = marked.filter(~F.col("__hit")).select("__row")
    best = F.coalesce(F.col("__id"), F.lit(-(1 << 63)).cast("long"))
    shared = marked.filter("__hit").groupBy(F.sha2("__norm", 256).alias("__key")).agg(F.max_by("__row", best).alias("__row")).select("__row")
    return single.unionByName(shared).select("__row.*")
