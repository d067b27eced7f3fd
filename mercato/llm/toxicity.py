"""Toxicity by a weighted lexicon, learned from labels and matched by Aho-Corasick.

Texts are folded first: lower case, accents and zero-width characters off, homoglyphs
of other scripts and digits that stand for letters replaced (``1`` may be an i or an l,
so l becomes i as well), everything else a space. A lexicon entry is a whole word or
the beginning of one, so that inflected forms count; its weight is the lower bound of
its log odds, from the document counts of labelled texts. One automaton holds all
entries and the exception phrases; a hit inside an exception does not count. Exceptions
are given or learned: pairs of words around a hit that clean texts have more often than
toxic ones. The hits' weight, and that weight normalised by the text's length, give a
probability by a logistic curve fitted to the labels.

The text is read in three passes: words of labelled texts, hits in them, and the score
of all. The labels that take part, at most ``LABELLED_ROWS`` by hash, and the lexicon, at
most ``MOST_ENTRIES``, are bounded, so they are broadcast; word counts, priors and
scores cover all rows of both.

Defined cases: null texts are empty; a text without a hit, the empty one too, gets the
curve's value at zero weight; null ids have no label; labels of one id that differ count
as toxic; null labels are left out; with labels of only one kind or none there is no
lexicon and the score is the share of toxic labels (0 without any); repeated rows are
scored each; other columns are ignored.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercato.llm.shared import hashed_sample, save
from mercato.llm.tokens import in_batches

LABELLED_ROWS = 1_000_000
MOST_ENTRIES = 50_000
#: Rows of the sample the curve is fitted to, for each label.
CURVE_ROWS = 20_000
#: Letters of the beginnings that are counted.
SHORTEST, LONGEST = 4, 10
#: Standard errors below the log odds, and what must be left of them.
SURE, LEAST_ODDS = 3.0, 0.5
#: Standard errors above the log odds of a phrase that must still be harmless.
SURE_HARMLESS = 1.0
#: Words that a text's length is taken to have besides its own.
LENGTH_FLOOR = 50
#: Phrases in which a hit is harmless, whatever the labels say.
EXCEPTIONS = ("trash can", "trash cans", "trash bin", "trash bag", "trash bags", "clown fish", "class clown", "circus clown", "idiot proof", "stupid simple", "pond scum")

# Look-alikes of Latin letters, and digits and signs written for letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "і": "i", "ї": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ӏ": "i", "ո": "n", "ս": "u", "օ": "o", "ց": "g",
    "α": "a", "β": "b", "γ": "y", "ε": "e", "η": "n", "ι": "i", "κ": "k", "μ": "u", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "ς": "s", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "ɑ": "a", "ɡ": "g", "ı": "i", "ɩ": "i", "ʟ": "l", "ɴ": "n", "ʀ": "r", "ʏ": "y", "ø": "o", "đ": "d", "ħ": "h", "ł": "l", "ß": "ss", "æ": "ae", "œ": "oe",
}
DIGITS = {"0": "o", "1": "i", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g"}
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "i", "+": "t", "€": "e", "£": "l", "¡": "i"}


@functools.cache
def _folds() -> dict[int, str | None]:
    """What each character becomes, by rule: compatibility forms and accented letters
    their base letters, zero-width characters and combining marks nothing, other
    signs a space. Letters of other scripts stay."""
    out: dict[int, str | None] = {}
    for i in [*range(0x80, 0x2500), *range(0x2E00, 0x3040), *range(0xFE00, 0x10000), *range(0x1D400, 0x1D800)]:
        c = chr(i)
        kind, base = unicodedata.category(c), "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).lower()
        if kind in ("Mn", "Me", "Cf"):
            out[i] = None
        elif base and all(x in HOMOGLYPHS or x.isascii() and x.isalnum() for x in base):
            out[i] = "".join(HOMOGLYPHS.get(x, x) for x in base)
        elif kind[0] in "PSZC":
            out[i] = " "
    out |= {i: " " for i in range(0x80) if not chr(i).isalnum()}
    out |= {ord(k): v for k, v in (HOMOGLYPHS | DIGITS).items()}
    # a letter that stands for two is one letter everywhere
    return {k: v and "".join(DIGITS.get(c, c) for c in v).replace("l", "i") for k, v in out.items()} | {ord("l"): "i"}


_SIGN = re.compile("(?<=[^\\W_])[" + re.escape("".join(SIGNS)) + "]+(?=[^\\W_])")
_SIGNS = str.maketrans(SIGNS)


def fold(text: str | None) -> str:
    """The folded words of ``text``, one space before, between and after them; one
    space if there are none."""
    text = (text or "").lower()
    if any(s in text for s in SIGNS):  # only inside a word
        text = _SIGN.sub(lambda m: m[0].translate(_SIGNS), text)
    return " ".join(["", *text.translate(_folds()).split(), ""])


@dataclass
class Lexicon:
    """``entries``: folded patterns with a space before, and one after whole words."""

    entries: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    curve: tuple[float, ...] = (0.0, 0.0, 0.0)

    @functools.cached_property
    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        values = {p: (len(p), w, 0) for p, w in self.entries.items()}
        for phrase in self.exceptions:
            p = fold(phrase)
            if p.strip():
                values[p] = (len(p), values.get(p, (0, 0.0, 0))[1], len(p))
        for p, v in values.items():
            found.add_word(p, v)
        if values:
            found.make_automaton()
        return found if values else None

    def __getstate__(self):
        return {"entries": self.entries, "exceptions": self.exceptions, "curve": self.curve}

    def hits(self, folded: str) -> dict[int, float]:
        """The best weight at each word's place, without those inside an exception."""
        best: dict[int, float] = {}
        excepted: list[tuple[int, int]] = []
        for end, (size, weight, phrase) in self.automaton.iter(folded) if self.automaton else ():
            at = end - size + 1
            if phrase:
                excepted.append((at, end))
            elif weight > best.get(at, 0.0):
                best[at] = weight
        for a, b in excepted:
            for at in [x for x in best if a <= x < b]:
                del best[at]
        return best

    def score(self, weight: float, words: int) -> float:
        return float(1 / (1 + np.exp(-np.dot(self.curve, features(weight, words)))))


def features(weight, words):
    """Constant, weight of the hits, and that weight normalised by length."""
    return np.array([np.ones_like(np.asarray(weight, float)), np.log1p(weight), np.sqrt(100 * np.asarray(weight, float) / (np.asarray(words, float) + LENGTH_FLOOR))])


def _map(frame: DataFrame, make, schema: str) -> DataFrame:
    """``make(values, texts)`` of a batch gives the columns of ``schema``; ``frame``
    has two columns, the texts last, and a batch about a megabyte of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for values, texts in in_batches(batch.column(0), batch.column(1), rows=4096):
                columns = make(values.to_pylist(), texts.to_pylist())
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return frame.mapInArrow(run, schema)


def word_counts(labelled: DataFrame) -> DataFrame:
    """(word, toxic, n): documents of ``labelled`` (toxic, text) with each folded word."""

    def make(toxic, texts):
        found: tuple[Counter, Counter] = Counter(), Counter()
        for text, t in zip(texts, toxic):
            found[t].update(set(fold(text).split()))
        words = [*found[0], *found[1]]
        counts = [*found[0].values(), *found[1].values()]
        return {"word": pa.array(words, pa.string()), "toxic": pa.array([0] * len(found[0]) + [1] * len(found[1]), pa.int32()), "n": pa.array(counts, pa.int64())}

    return _map(labelled, make, "word string, toxic int, n long").groupBy("word", "toxic").agg(F.sum("n").alias("n"))


def lexicon_entries(labelled: DataFrame, toxic: int, clean: int) -> dict[str, float]:
    """Patterns and weights from (toxic, text) rows, ``toxic`` and ``clean`` in number."""
    words = word_counts(labelled).withColumn("size", F.length("word"))
    # a word of the shortest length has no shorter beginning
    begins = F.when(F.col("size") > SHORTEST, F.transform(F.sequence(F.lit(SHORTEST), F.least(F.col("size") - 1, F.lit(LONGEST))), lambda k: F.concat(F.lit(" "), F.substring(F.col("word"), F.lit(1), k))))
    whole = F.when(F.col("size") > 2, F.array(F.concat(F.lit(" "), F.col("word"), F.lit(" "))))
    empty = F.array().cast("array<string>")
    each = words.select(F.explode(F.concat(F.coalesce(begins, empty), F.coalesce(whole, empty))).alias("pattern"), "toxic", "n")
    sums = each.groupBy("pattern").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("c"))
    weight = bound(F.col("t"), F.col("c"), toxic, clean, -SURE)
    kept = sums.filter(F.col("t") > 0).withColumn("weight", weight).filter(F.col("weight") > LEAST_ODDS)
    kept = kept.orderBy(F.desc("weight"), F.desc("t"), "pattern").limit(MOST_ENTRIES)
    return {r["pattern"]: r["weight"] for r in kept.select("pattern", "weight").collect()}


def bound(t: Column, c: Column, toxic: int, clean: int, errors: float) -> Column:
    """The log odds of toxic against clean, so many standard errors above."""
    odds = F.log((t + 0.5) / (toxic + 1)) - F.log((c + 0.5) / (clean + 1))
    return odds + errors * F.sqrt(1 / (t + 0.5) + 1 / (c + 0.5))


def _hit_table(labelled: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(toxic, words, hits with the pairs of words around them) of labelled rows."""
    schema = "toxic int, words long, hits array<struct<weight:double,before:string,after:string>>"
    kind = pa.list_(pa.struct([("weight", pa.float64()), ("before", pa.string()), ("after", pa.string())]))

    def make(toxic, texts):
        rows, words = [], []
        for text in texts:
            folded = fold(text)
            words.append(folded.count(" ") - 1)
            row = []
            for at, w in lexicon.hits(folded).items():
                end = folded.index(" ", at + 1)
                start = folded.rfind(" ", 0, at)
                after = folded.find(" ", end + 1)
                row.append({"weight": w, "before": folded[start + 1 : end] if start >= 0 else None, "after": folded[at + 1 : after] if after >= 0 else None})
            rows.append(row)
        return {"toxic": pa.array(toxic, pa.int32()), "words": pa.array(words, pa.int64()), "hits": pa.array(rows, kind)}

    return _map(labelled, make, schema)


def fitted_curve(weight: np.ndarray, words: np.ndarray, toxic: np.ndarray, shares: np.ndarray) -> tuple[float, ...]:
    """Logistic regression by Newton's method; rows weigh ``shares``."""
    x = features(weight, words)
    beta = np.zeros(len(x))
    ridge = np.diag([1e-6, 1e-3, 1e-3]) * shares.sum()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(beta @ x, -30, 30)))
        step = np.linalg.solve((x * (shares * p * (1 - p))) @ x.T + ridge, x @ (shares * (toxic - p)) - ridge @ beta)
        beta += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(b) for b in beta)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", exceptions: tuple[str, ...] = EXCEPTIONS, rows: int = LABELLED_ROWS) -> Lexicon:
    """The lexicon, its exceptions and curve, from the labelled ``docs``."""
    marks = labels.select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("toxic")).filter("id is not null and toxic is not null")
    marks = marks.groupBy("id").agg(F.max(F.when(F.col("toxic") != 0, 1).otherwise(0)).alias("toxic"))
    marks = save(marks, "labels")
    marks = save(hashed_sample(marks, ["id"], marks.count(), rows), "labels")
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    labelled = texts.join(F.broadcast(marks), "id").select("toxic", "text")  # at most ``rows``
    found = {r["toxic"]: r["n"] for r in texts.select("id").join(F.broadcast(marks), "id").groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = found.get(1, 0), found.get(0, 0)
    if not toxic or not clean:
        return Lexicon(curve=(30.0 if toxic else -30.0, 0.0, 0.0))
    lexicon = Lexicon(lexicon_entries(labelled, toxic, clean), tuple(exceptions))
    hits = save(_hit_table(labelled, lexicon).withColumn("key", F.monotonically_increasing_id()), "hits")
    pairs = hits.select("toxic", F.explode("hits").alias("h")).select("toxic", F.explode(F.array("h.before", "h.after")).alias("phrase")).filter("phrase is not null")
    sums = pairs.groupBy("phrase").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    harmless = sums.filter(bound(F.col("t"), F.col("c"), toxic, clean, SURE_HARMLESS) < 0)
    learned = [r["phrase"] for r in harmless.orderBy(F.desc("c"), "phrase").limit(MOST_ENTRIES).select("phrase").collect()]
    lexicon.exceptions += tuple(learned)
    counted = F.filter("hits", lambda h: ~(F.coalesce(h["before"].isin(learned), F.lit(False)) | F.coalesce(h["after"].isin(learned), F.lit(False)))) if learned else F.col("hits")
    weight = F.aggregate(counted, F.lit(0.0), lambda total, h: total + h["weight"])
    sample = hits.select("toxic", "words", weight.alias("weight"), "key")
    part = [hashed_sample(sample.filter(F.col("toxic") == t), ["key"], n, CURVE_ROWS).select("weight", "words", "toxic").toPandas() for t, n in ((0, clean), (1, toxic))]
    shares = np.concatenate([np.full(len(p), n / max(1, len(p))) for p, n in zip(part, (clean, toxic))])
    lexicon.curve = fitted_curve(*(np.concatenate([p[c].to_numpy(float) for p in part]) for c in ("weight", "words", "toxic")), shares)
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: the id, score (0 to 1), words, and the weight of its hits."""
    model = docs.sparkSession.sparkContext.broadcast(lexicon)  # bounded by MOST_ENTRIES
    name = docs.select(id_col).schema[0].dataType

    def make(ids, texts):
        lex = model.value
        folded = [fold(t) for t in texts]
        weights = [sum(lex.hits(f).values()) for f in folded]
        words = [f.count(" ") - 1 for f in folded]
        scores = [lex.score(w, n) for w, n in zip(weights, words)]
        return {"id": pa.array(ids, pa.int64()), "score": pa.array(scores, pa.float64()), "words": pa.array(words, pa.int64()), "weight": pa.array(weights, pa.float64())}

    found = _map(docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string")), make, "id long, score double, words long, weight double")
    return found.select(F.col("id").cast(name).alias(id_col), "score", "words", "weight")
