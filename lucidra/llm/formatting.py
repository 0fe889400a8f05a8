"""Duplicates hidden by formatting differences (problem 4).

Two records are equal when question and set of answers agree after blanks, invisible characters,
letter case, punctuation, Unicode form and width are set aside. Words, accents, decimal points and
minus signs of numbers count.

Progressive refinement: a cheap key (letters left after stripping, as a length and a histogram) is
computed inside the JVM for all records; only records that share it with another one get the
costlier exact key, a digest of the canonical text.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lucidra.util import counted_hot, cut, skew_join

_DASHES = "-‐‑‒–−"
_TOKEN = re.compile(
    rf"(?P<number>(?:(?<![^\W_])[{_DASHES}](?=\d))?\d+(?:\.\d+)*)|(?P<word>[^\W\d_]+|[^\w\s])|(?P<rest>[\s_]+)", re.UNICODE
)


def canonical(text: str | None) -> str:
    """The text without what formatting may change, run together; a minus counts right before a number that follows no letter or digit."""
    if not text:
        return ""
    t = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    t = "".join(ch for ch in t if unicodedata.category(ch) not in ("Cf", "Cn", "Co", "Cs"))
    out: list[str] = []
    for m in _TOKEN.finditer(t):
        if m["number"]:
            out.append(re.sub(f"[{_DASHES}]", "-", m["number"]))
        elif m["word"]:
            out.append("".join(ch for ch in m["word"] if unicodedata.category(ch)[0] not in "PZC"))
    return "".join(out)


def record_key(question: str | None, answers: object) -> str:
    """Digest of the canonical question and the set of canonical answers; blank answers do not count."""
    said = sorted({c for a in (answers if answers is not None else ()) if (c := canonical(a))})
    return hashlib.blake2b("\x1e".join([canonical(question), *said]).encode(), digest_size=16).hexdigest()


def _letters(text: str) -> str:
    """Base letters and digits of a text without accents: coarser than :func:`canonical`."""
    t = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", text).casefold())
    return "".join(ch for ch in t.casefold() if ch.isalnum())


@lru_cache(maxsize=1)
def _tables() -> tuple[str, str, str]:
    """(from, to, unsafe): a translation to base letters for the characters of the basic plane where one
    character becomes one or none, and a regular expression class of the characters where that is not so.
    """
    moved, gone, unsafe = [], [], []
    for cp in range(1, 0x10000):
        if 0xD800 <= cp <= 0xDFFF:
            unsafe.append(cp)
            continue
        ch = chr(cp)
        base = _letters(ch)
        composing = unicodedata.category(ch)[0] == "L" and unicodedata.normalize("NFC", "가").startswith(ch)
        if len(base) > 1 or composing or 0x1100 <= cp <= 0x11FF:
            unsafe.append(cp)
        elif not base:
            gone.append(ch)
        elif base != ch:
            moved.append((ch, base))
    ranges, start = [], None
    for a, b in zip([None, *unsafe], [*unsafe, None]):
        if a is None or b is None or b != a + 1:
            if start is not None:
                ranges.append(f"\\u{start:04x}-\\u{a:04x}")
            start = b
    return "".join(a for a, _ in moved) + "".join(gone), "".join(b for _, b in moved), "[" + "".join(ranges) + "\\x{10000}-\\x{10ffff}]"


def _cheap(c: Column) -> Column:
    """Hash of the length and letter histogram of a text, inside the JVM; null for an empty one."""
    src, dst, _ = _tables()
    bare = F.translate(c, src, dst)
    return F.when(F.length(bare) > 0, F.xxhash64(F.length(bare), F.array_join(F.array_sort(F.split(bare, "")), "")))


def _cheap_pandas(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: "".join(sorted(_letters(t or ""))))


def _cheap_key(df: DataFrame, question: str, answers: str) -> DataFrame:
    """Adds ``_inv``: equal for equal records, mostly different for others."""
    unsafe = _tables()[2]

    def combine(q: Column, said: Column) -> Column:
        return F.xxhash64(q, F.array_sort(F.array_distinct(F.filter(said, lambda a: a.isNotNull()))))

    needs = F.coalesce(F.concat_ws(" ", F.col(question), F.array_join(answers, " ")).rlike(unsafe), F.lit(False))
    plain = df.where(~needs).withColumn("_inv", combine(_cheap(F.col(question)), F.transform(answers, _cheap)))

    @F.pandas_udf("string")
    def letters(t: pd.Series) -> pd.Series:
        return _cheap_pandas(t)

    @F.pandas_udf("array<string>")
    def letters_each(t: pd.Series) -> pd.Series:
        return t.map(lambda xs: None if xs is None else ["".join(sorted(_letters(x or ""))) for x in xs])

    def hashed(c: Column) -> Column:
        return F.when(F.length(c) > 0, F.xxhash64(F.length(c), c))

    rest = df.where(needs).withColumn("_q", letters(question)).withColumn("_a", letters_each(answers))
    rest = rest.withColumn("_inv", combine(hashed(F.col("_q")), F.transform("_a", hashed))).drop("_q", "_a")
    return plain.unionByName(rest)


def _exact(question: str, answers: str) -> Column:
    @F.pandas_udf("string")
    def exact(q: pd.Series, a: pd.Series) -> pd.Series:
        return pd.Series([record_key(x, y) for x, y in zip(q, a)])

    return exact(question, answers)


def formatting_classes(df: DataFrame, row_id: str, question: str, answers: str) -> DataFrame:
    """``row_id, first_row_id, copies`` of every record that has a copy up to formatting.

    Null question counts as empty, null answers as none; rows repeated under one row id count as one
    copy each. Hot classes are counted by partial aggregates and joined back by broadcast of their one
    result row, so no class is gathered in one task.
    """
    base = df.select(F.col(row_id).alias("row_id"), F.col(question).alias("_question"), F.col(answers).alias("_answers"))
    cheap = _cheap_key(base, "_question", "_answers")
    counts = cut(cheap.groupBy("_inv").agg(F.count(F.lit(1)).alias("n")))
    some = skew_join(cheap, counts.where("n > 1").select("_inv"), "_inv", "left_semi", hot=counted_hot(counts, "_inv", "n"))

    keyed = cut(some.select("row_id", _exact("_question", "_answers").alias("_key")))
    classes = cut(keyed.groupBy("_key").agg(F.min("row_id").alias("first_row_id"), F.count(F.lit(1)).alias("copies")))
    hot = counted_hot(classes, "_key", "copies")
    return skew_join(keyed, classes.where("copies > 1"), "_key", hot=hot).select("row_id", "first_row_id", "copies")


def collapse(df: DataFrame, row_id: str, question: str, answers: str) -> DataFrame:
    """The first record of every class with its number of ``copies`` (1 for records that stand alone).

    One row for each class, also where the same row stands there several times under one row id. A column called
    copies of the input is replaced. Rows whose row id is null are compared among themselves like all others.
    """
    members = formatting_classes(df, row_id, question, answers)
    later = members.where(~F.col("row_id").eqNullSafe(F.col("first_row_id"))).select(F.col("row_id").alias("_later")).distinct()
    firsts = members.where(F.col("row_id").eqNullSafe(F.col("first_row_id"))).select(F.col("row_id").alias("_first"), F.col("copies").alias("_copies")).distinct()
    kept = df.drop("copies")
    kept = kept.join(later, F.col(row_id).eqNullSafe(F.col("_later")), "left_anti").join(firsts, F.col(row_id).eqNullSafe(F.col("_first")), "left")
    alone = kept.where("_copies is null").withColumn("copies", F.lit(1).cast("long"))
    first = kept.where("_copies is not null").withColumn("_key", _exact(question, answers)).dropDuplicates([row_id, "_key"]).withColumn("copies", F.col("_copies"))
    return alone.unionByName(first.drop("_key")).drop("_first", "_copies")
