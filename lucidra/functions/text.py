"""Text functions: answer normalisation, matching, hashes and small parsers.

Spark has neither NFKC nor case folding, so texts outside ASCII go through Arrow UDFs; each function also
has a ``*_ascii`` column form that stays in the JVM for columns known to be ASCII.
"""

from __future__ import annotations

import ast
import hashlib
import json
import re
import unicodedata
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ARTICLE = re.compile(r"\b(?:a|an|the)\b")


def normalize_text(text: object) -> str:
    """Compatibility form, case folded, punctuation and the English articles dropped, blanks collapsed."""
    folded = unicodedata.normalize("NFKC", str(text)).casefold()
    spaced = folded.translate({ord(c): " " for c in set(folded) if unicodedata.category(c)[0] == "P"})
    return " ".join(_ARTICLE.sub(" ", spaced).split())


def identity_text(text: object) -> str:
    """Compatibility form, case folded, blanks collapsed; punctuation stays."""
    return " ".join(unicodedata.normalize("NFKC", str(text)).casefold().split())


def f1(prediction: str, references: list[str]) -> float:
    """Best token overlap F1 of a prediction over its references; 0 without overlap."""
    said = Counter(normalize_text(prediction).split())
    scores = [0.0]
    for ref in references:
        want = Counter(normalize_text(ref).split())
        both = (said & want).total()
        if both:
            scores.append(2 * both / (said.total() + want.total()))
    return max(scores)


@F.pandas_udf(T.StringType())
def normalize_answer(texts: pd.Series) -> pd.Series:
    """Arrow UDF of :func:`normalize_text`; null stays null."""
    return texts.map(lambda t: None if t is None else normalize_text(t))


@F.pandas_udf(T.DoubleType())
def token_f1(prediction: pd.Series, references: pd.Series) -> pd.Series:
    """Arrow UDF of :func:`f1`; null where either side is null."""
    return pd.Series([None if p is None or r is None else f1(p, [x for x in r if x is not None]) for p, r in zip(prediction, references)], dtype="float64")


@F.pandas_udf(T.BooleanType())
def exact_match(prediction: pd.Series, references: pd.Series) -> pd.Series:
    """Whether the normalised prediction equals a normalised reference; null where either side is null or no reference is given."""

    def one(p: object, refs: object) -> bool | None:
        if p is None or refs is None or len(refs) == 0:
            return None
        want = normalize_text(p)
        return any(normalize_text(r) == want for r in refs if r is not None)

    return pd.Series([one(p, r) for p, r in zip(prediction, references)], dtype="boolean")


@F.pandas_udf(T.StringType())
def question_hash(texts: pd.Series) -> pd.Series:
    """SHA-256 of the question in compatibility form, case folded, blanks collapsed."""
    return texts.map(lambda t: None if t is None else hashlib.sha256(identity_text(t).encode()).hexdigest())


@F.pandas_udf(T.ArrayType(T.StringType()))
def unique_strings(values: pd.Series) -> pd.Series:
    """Stripped nonblank values, the first of each spelling up to letter case."""

    def one(xs: object) -> list[str] | None:
        if xs is None:
            return None
        seen: dict[str, str] = {}
        for x in xs:
            if x is not None and str(x).strip():
                seen.setdefault(str(x).strip().casefold(), str(x).strip())
        return list(seen.values())

    return values.map(one)


def parse_list(text: str) -> list[str]:
    """A JSON list, else a Python list, else the text itself as the only item; blank gives nothing."""
    t = text.strip()
    if not t:
        return []
    for read in (json.loads, ast.literal_eval):
        try:
            v = read(t)
        except (ValueError, SyntaxError, RecursionError, MemoryError):
            continue
        if isinstance(v, (list, tuple)):
            return [str(x) for x in v]
    return [t]


@F.pandas_udf(T.ArrayType(T.StringType()))
def parse_sequence(texts: pd.Series) -> pd.Series:
    """Arrow UDF of :func:`parse_list`."""
    return texts.map(lambda t: None if t is None else parse_list(t))


def fill_placeholders(question: str, answers: list[str], position: int) -> str:
    """``#k`` standing alone replaced by the answer of step k of a chain; ``#0`` and forward references raise, numbers beyond the chain stay."""

    def put(m: re.Match) -> str:
        k = int(m[1])
        if k > len(answers):
            return m[0]
        if k < 1 or k >= position:
            raise ValueError(f"step {position} refers to step {k}")
        return answers[k - 1]

    return re.sub(r"(?<!\w)#(\d+)\b", put, question)


@F.pandas_udf(T.StringType())
def resolve_placeholders(question: pd.Series, answers: pd.Series, position: pd.Series) -> pd.Series:
    """Arrow UDF of :func:`fill_placeholders`."""
    return pd.Series([None if q is None else fill_placeholders(q, list(a if a is not None else []), int(p)) for q, a, p in zip(question, answers, position)])


def canonical_json(value: object) -> str:
    """JSON with sorted keys and no blanks; NaN and infinities are refused."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


@F.pandas_udf(T.StringType())
def canonical_hash(texts: pd.Series) -> pd.Series:
    """SHA-256 of the canonical form of JSON texts; null where a text does not parse."""

    def one(t: object) -> str | None:
        try:
            return None if t is None else hashlib.sha256(canonical_json(json.loads(t)).encode()).hexdigest()
        except ValueError:
            return None

    return texts.map(one)


def is_ascii(c: Column) -> Column:
    """Whether a text has only ASCII characters."""
    return c.rlike(r"^[\x00-\x7F]*$")


def normalize_ascii(c: Column) -> Column:
    """:func:`normalize_text` for ASCII texts, inside the JVM."""
    bare = F.regexp_replace(F.lower(c), r"[!-#%-*,-/:;?@\[-\]_{}]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"\b(?:a|an|the)\b", " "), r"\s+", " "))


def question_hash_ascii(c: Column) -> Column:
    """:func:`question_hash` for ASCII texts, inside the JVM."""
    return F.sha2(F.trim(F.regexp_replace(F.lower(c), r"\s+", " ")), 256)


def token_f1_ascii(prediction: Column, reference: Column) -> Column:
    """:func:`f1` of one ASCII reference, inside the JVM: multiset overlap by counting each distinct token on both sides."""
    p, r = F.split(normalize_ascii(prediction), " "), F.split(normalize_ascii(reference), " ")
    p, r = F.filter(p, lambda x: x != ""), F.filter(r, lambda x: x != "")
    many = lambda xs, t: F.size(F.filter(xs, lambda x: x == t))
    both = F.aggregate(F.array_intersect(p, r), F.lit(0), lambda acc, t: acc + F.least(many(p, t), many(r, t)))
    return F.when(both > 0, F.lit(2.0) * both / (F.size(p) + F.size(r))).otherwise(F.lit(0.0))


def normalized(c: Column) -> Column:
    """:func:`normalize_text` of any text: in the JVM for ASCII, in Arrow for the rest."""
    return F.when(is_ascii(c), normalize_ascii(c)).otherwise(normalize_answer(F.when(~is_ascii(c), c)))


def is_abstention(c: Column) -> Column:
    """Whether an ASCII answer says to abstain."""
    return normalize_ascii(c) == "abstain"


def estimated_tokens(c: Column) -> Column:
    """A quarter of the characters, rounded up, at least 1."""
    return F.greatest(F.lit(1), F.floor((F.length(c) + 3) / 4).cast("int"))
