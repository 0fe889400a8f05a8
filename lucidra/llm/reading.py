"""Reading level of each document (problem 10).

For each language the words of all documents are ranked by frequency. The coverage rank of a document
is the size of the smallest vocabulary, in that order, that covers a fixed share of its words. Coverage
ranks at several shares and the complexity of the sentences are calibrated in SQL on the labelled documents
by an ordinal logistic fit: sums for its Newton steps are aggregates, the scores are column arithmetic.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lucidra.llm.language import FUNCTION_WORDS
from lucidra.util import cut

SHARES = (0.5, 0.7, 0.8, 0.9, 0.95)
BANDS = (1, 2, 3, 4)
#: Words that make up this share of all words of a language join by broadcast, at most its inverse in number.
FREQUENT = 2e-4
#: Documents whose word counts a Python worker holds at a time.
PIECE = 500
#: Least share of a text's parts that must be words for it to count as prose.
PROSE = 0.5

_MARKUP = re.compile(r"<[^<>]*>|\*\*|__|^#+\s|^\s*[-*•]\s+|^\s*\d+[.)]\s", re.MULTILINE)
_SENTENCE = re.compile(r"(?<=[.!?…])\s+|\n+")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_APOSTROPHE = re.compile("['’]")
_WORDY = re.compile(r"(?<!\S)[\"'“”«»(\[¿¡]*[^\W\d_]+(?:['’-][^\W\d_]+)*[\"'“”«».,;:!?…)\]]*(?!\S)")
COMPLEXITY = ("mean_sentence", "longest_sentence", "median_sentence", "word_length", "long_words", "longest_words", "commas", "function_words", "semicolons", "variety")


def describe(text: str | None) -> dict | None:
    """Language, words with counts and sentence complexity of one text; null for blank and non-prose texts."""
    if not text or not text.strip():
        return None
    bare = _MARKUP.sub("\n", text)
    parts = len(bare.split())
    if not parts or len(_WORDY.findall(bare)) < PROSE * parts:
        return None
    sentences = [s for s in (_WORD.findall(x) for x in _SENTENCE.split(bare.lower())) if s]
    if not sentences:
        return None
    counts = Counter(w for s in sentences for w in s)
    plain: Counter = Counter()
    for w, n in counts.items():
        for x in _APOSTROPHE.split(w):
            plain[x] += n
    known = {lang: sum(plain[w] for w in words) for lang, words in FUNCTION_WORDS.items()}
    lang = max(known, key=known.get)
    lengths = np.array([len(s) for s in sentences])
    n = np.fromiter(counts.values(), dtype=np.int64, count=len(counts))
    sizes = np.fromiter(map(len, counts), dtype=np.int64, count=len(counts))
    n_words = int(n.sum())
    return {
        "lang": lang,
        "words": counts,
        "n_words": n_words,
        "mean_sentence": float(np.log(lengths.mean())),
        "longest_sentence": float(np.log(lengths.max())),
        "median_sentence": float(np.log(np.median(lengths))),
        "word_length": float((sizes * n).sum() / n_words),
        "long_words": float(n[sizes >= 9].sum() / n_words),
        "longest_words": float(n[sizes >= 13].sum() / n_words),
        "commas": bare.count(",") / len(sentences),
        "function_words": sum(counts[w] for w in FUNCTION_WORDS[lang] if w in counts) / n_words,
        "semicolons": bare.count(";") / len(sentences),
        "variety": len(counts) / n_words**0.5 / 10,
    }


def described(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id, lang, n_words``, the complexity columns, ``words`` and their counts ``ns`` of the prose documents; whole texts."""
    kind = df.select(doc_id).schema[0].dataType.simpleString()
    numbers = ", ".join(f"{c} double" for c in COMPLEXITY)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), PIECE):
                pdf, rows = batch.iloc[lo : lo + PIECE], []
                for i, t in zip(pdf["doc_id"], pdf["text"]):
                    d = describe(t if isinstance(t, str) else None)
                    if d:
                        rows.append((i, d["lang"], d["n_words"], *[d[c] for c in COMPLEXITY], list(d["words"]), list(d["words"].values())))
                yield pd.DataFrame(rows, columns=["doc_id", "lang", "n_words", *COMPLEXITY, "words", "ns"])

    return df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInPandas(
        work, f"doc_id {kind}, lang string, n_words long, {numbers}, words array<string>, ns array<long>"
    )


def word_ranks(each: DataFrame) -> DataFrame:
    """``key, n, rank``: words of each language with their frequency rank; equally frequent words share the last of their ranks.

    Ranks come from the histogram of frequencies, so the vocabulary is never sorted in one task.
    """
    counts = cut(each.groupBy("lang", "key").agg(F.sum("n").alias("n")))
    levels = counts.groupBy("lang", "n").agg(F.count(F.lit(1)).alias("m"))
    upto = F.sum("m").over(W.partitionBy("lang").orderBy(F.desc("n")).rowsBetween(W.unboundedPreceding, 0))
    return counts.join(levels.withColumn("rank", upto).drop("m"), ["lang", "n"]).select("key", "n", "rank")


def coverage_ranks(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the logarithm of the coverage rank at each of ``SHARES``."""
    each = docs.select("doc_id", "lang", F.inline(F.arrays_zip(F.col("words").alias("word"), F.col("ns").alias("n")))).withColumn("key", F.concat_ws(":", "lang", "word"))
    ranks = cut(word_ranks(each.select("lang", "key", "n")))
    total = ranks.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") >= F.lit(max(2.0, FREQUENT * total))
    met = each.select("doc_id", "key", F.col("n").alias("m")).join(F.broadcast(ranks.where(often).select("key", F.col("rank").alias("known"))), "key", "left")
    rare = met.where("known is null").drop("known").join(ranks.where(~often).select("key", "rank"), "key")
    ranked = met.where("known is not null").withColumnRenamed("known", "rank").unionByName(rare)
    by_rank = ranked.groupBy("doc_id", "rank").agg(F.sum("m").alias("m"))
    through = F.sum("m").over(W.partitionBy("doc_id").orderBy("rank").rowsBetween(W.unboundedPreceding, 0))
    words = F.sum("m").over(W.partitionBy("doc_id"))
    seen = by_rank.select("doc_id", "rank", through.alias("through"), words.alias("words"))
    return seen.groupBy("doc_id").agg(*[F.log(F.min(F.when(F.col("through") >= F.lit(s) * F.col("words"), F.col("rank")))).alias(f"rank_{i}") for i, s in enumerate(SHARES)])


@dataclass(frozen=True)
class BandModel:
    """Centre and spread of the features and the weights (features + bias) of "the band is above b", for all bands but the last."""

    names: tuple[str, ...]
    centre: np.ndarray
    spread: np.ndarray
    weights: np.ndarray

    def design(self) -> Column:
        """The standardised features and a constant, as an array."""
        return F.array(*[(F.col(c) - float(m)) / float(s) for c, m, s in zip(self.names, self.centre, self.spread)], F.lit(1.0))

    def above(self, design: Column) -> list[Column]:
        """How likely the band is above each of ``BANDS`` but the last."""
        out = []
        for w in self.weights:
            terms = F.zip_with(design, F.array(*[F.lit(float(v)) for v in w]), lambda x, y: x * y)
            z = F.aggregate(terms, F.lit(0.0), lambda t, x: t + x)
            out.append(1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z)))))
        return out

    def band(self) -> Column:
        """The likeliest band, as a column of the features; ties go to the lower band."""
        rest = F.lit(1.0)
        scores = []
        for b, above in zip(BANDS, [*self.above(self.design()), F.lit(0.0)]):
            scores.append(F.struct((rest - F.least(rest, above)).alias("p"), F.lit(-b).alias("b")))
            rest = F.least(rest, above)
        return -F.array_max(F.array(*scores))["b"]


def fit_bands(marked: DataFrame, names: tuple[str, ...], l2: float = 0.3, rounds: int = 6) -> BandModel | None:
    """The calibration: an ordinal logistic fit by Newton steps whose sums are SQL aggregates over ``marked``.

    ``marked``: the features and ``share``, the shares of the raters for each of ``BANDS``. The driver solves systems as
    large as there are features; the labelled documents stay where they are. None without labels.
    """
    stats = marked.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m_{c}") for c in names], *[F.stddev_pop(c).alias(f"s_{c}") for c in names]).first()
    if not stats.n:
        return None
    size, k = len(names) + 1, len(BANDS) - 1
    model = BandModel(names, np.array([stats[f"m_{c}"] for c in names]), np.array([stats[f"s_{c}"] for c in names]) + 1e-9, np.zeros((k, size)))
    wanted = F.transform(F.sequence(F.lit(2), F.lit(k + 1)), lambda b: F.aggregate(F.slice("share", b, F.lit(k + 1)), F.lit(0.0), lambda t, x: t + x))
    rows = cut(marked.select(model.design().alias("z"), wanted.alias("wanted")))
    for _ in range(rounds):
        each = rows.select("z", F.posexplode(F.arrays_zip("wanted", F.array(*model.above(F.col("z"))).alias("p"))).alias("b", "x")).select("z", "b", F.col("x.wanted").alias("y"), F.col("x.p").alias("p"))
        slope = F.transform("z", lambda v: v * (F.col("p") - F.col("y")))
        curve = F.flatten(F.transform("z", lambda v, i: F.transform(F.slice("z", i + 1, F.lit(size)), lambda u: v * u * F.col("p") * (1 - F.col("p")))))
        sums = each.select("b", F.posexplode(F.concat(slope, curve)).alias("i", "v")).groupBy("b", "i").agg(F.sum("v").alias("v")).collect()
        slopes, curves, half = np.zeros((k, size)), np.zeros((k, size, size)), np.triu_indices(size)
        for r in sums:
            if r.i < size:
                slopes[r.b, r.i] = r.v
            else:
                u, v = half[0][r.i - size], half[1][r.i - size]
                curves[r.b, u, v] = curves[r.b, v, u] = r.v
        moves = [np.linalg.solve(c + l2 * np.eye(size), s + l2 * w) for c, s, w in zip(curves, slopes, model.weights)]
        model = BandModel(names, model.centre, model.spread, model.weights - np.array(moves))
        if max(np.abs(m).max() for m in moves) < 1e-3:
            break
    return model


def reading_features(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """All features of the prose documents, one row each."""
    docs = cut(described(df, doc_id, text))
    langs = [F.when(F.col("lang") == x, 1.0).otherwise(0.0).alias(f"is_{x}") for x in ("en", "de", "fr")]
    return docs.drop("words", "ns").join(coverage_ranks(docs), "doc_id").select("*", *langs)


def reading_bands(df: DataFrame, doc_id: str, text: str, labels: DataFrame) -> DataFrame:
    """``doc_id, band`` of every prose document.

    ``labels`` holds ``doc_id, band`` and may have several raters; their shares are the targets. Labels of absent
    or non-prose documents are left out. Null, blank and non-prose texts have no band; without usable
    labels there is nothing to calibrate on and the result is empty.
    """
    table = cut(reading_features(df, doc_id, text))
    names = (*[f"rank_{i}" for i in range(len(SHARES))], *COMPLEXITY, "is_en", "is_de", "is_fr")
    said = labels.where(F.col("band").isin(list(BANDS))).select("doc_id", F.col("band").alias("label"))
    counts = table.join(said, "doc_id").groupBy("doc_id", *names).agg(*[F.count_if(F.col("label") == b).alias(f"_b{b}") for b in BANDS])
    raters = sum((F.col(f"_b{b}") for b in BANDS), F.lit(0))
    model = fit_bands(cut(counts.withColumn("share", F.array(*[F.col(f"_b{b}") / raters for b in BANDS]))), names)
    if model is None:
        return table.select("doc_id", F.lit(None).cast("int").alias("band")).limit(0)
    return table.select("doc_id", model.band().cast("int").alias("band"))
