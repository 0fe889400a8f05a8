"""Same or near-same records across splits (problem 1).

Two questions are near-same when they ask for the same fact in nearly the same wording. The verdict on
a pair follows from the two texts and from which words are names, and nothing else (:func:`same_question`):

* at least ``CONTAINMENT`` of the shorter text's words stand in the longer one, up to one-letter slips;
* both hold the same numbers, and no word that negates or gives a direction is exchanged;
* all names of one of the two stand in the other one, up to a slip in either (or neither holds a name).

A word is a name unless it is mostly written small inside sentences, counted over the rows that use both
cases, or mostly follows an article of a language that writes all nouns large; words without such evidence
(scripts without case, words seen in capitals only) count as names. These are shares of a word's own
occurrences: how many other texts there are plays no part.

Equal texts are one class. Evaluation and training texts meet on hashes of unordered word n-grams: a name
of one text, the rarest, with all numbers of the text. Words are looked up with their variants, which are
found once for all texts with the same numbers. The rule above makes this complete: of a near-same
pair one text has all its names, so also its rarest one, in the other. A text without names is looked up
by so many of its words that one must be shared at the containment asked for. N-grams with more than
``HOT`` pairs are extended by a further word in the same manner, and what is still too frequent is
compared in blocks. The constants decide how pairs are found, never which.

Contiguous five-word shingles at 0.8, the default elsewhere, cannot give the result asked for here:
one slip in the middle of a 17-word question already breaks five of its 13 shingles.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lucidra.util import counted_hot, cut, drop_cut, hot_keys, skew_join

#: Least share of the shorter text's words that must stand in the longer one, in tenths.
CONTAINMENT = 8
#: Candidate pairs of one n-gram beyond which it is extended, and then compared in blocks.
HOT = 100_000
#: Rows on one side of a block, and of one text, that meet in one task.
BLOCK = 1_000
#: Share of all words from which on a word counts as frequent; at most its inverse, 10,000 rows, is broadcast.
FREQUENT = 1e-4
#: Words looked up whose remainders a task holds at once.
CHUNK = 20_000
#: Least length of words between which two slips are accepted; words beyond the longest length have no slips at all.
TWO_SLIPS_FROM, SLIPS_UP_TO = 6, 32

# Words that give the direction asked, by language; two texts that differ in one of them differ in what they ask.
DIRECTIONS = frozenset(
    # English
    "first last earliest latest initial final oldest newest youngest older newer younger old new before after until since "
    "longest shortest longer shorter long short tallest lowest highest higher lower high low largest smallest biggest larger smaller large small big "
    "most least more fewest fewer less maximum minimum max min greatest best worst northern southern eastern western north south east west "
    "upper left right inner outer top bottom opening closing opened closed open close start end beginning began begin ended "
    "won lost win lose bought sold buy sell over under above below inside outside with without "
    "spring summer autumn fall winter morning evening day night male female father mother son daughter brother sister "
    "increase decrease rise rose fell early late previous next preceding following prior subsequent predecessor successor succeeded preceded "
    # German
    "erste ersten erster erstes letzte letzten letzter letztes zuerst zuletzt anfangs alteste altesten altester jungste jungsten neueste neuesten "
    "bevor nachdem vor nach vorher nachher seit bis grosste grossten kleinste kleinsten hochste hochsten niedrigste niedrigsten langste kurzeste "
    "meisten wenigsten nordliche sudliche ostliche westliche fruheste spateste fruher spater ohne mit oben unten "
    # French
    "premier premiere premiers premieres dernier derniere derniers dernieres avant apres depuis plus moins ancienne ancien anciens anciennes "
    "recente recent recents recentes nouvelle nouveau haute haut basse bas grande grand petite petit longue court courte nord sud ouest "
    "sans debut fin "
    # Spanish
    "primer primera primero primeras primeros ultima ultimo ultimas ultimos antes despues desde hasta mas menos antigua antiguo antiguas antiguos "
    "moderna moderno modernas reciente nueva nuevo alta alto baja bajo mayor menor larga corta norte sur oeste sin inicio".split()
)

# Words that turn a question round when only one of two texts has them.
NEGATIONS = frozenset("not never no nicht nie niemals kein keine keinen jamais nunca".split())

#: What ends a part of a text: the first word after it is written large for that reason alone.
_ENDS = re.compile(r"[.!?:;–—\"“„«»()¿¡>*]|(?<=\s)-(?=\s)|\n")
#: Parts of up to so many words that go on small ("Quick one -", "Answer briefly.") open with an ordinary word, not a name.
LEAD = 4
#: Share of a word's large occurrences after an article from which on it is a noun and no name.
NOUN = 0.8
# Articles before which a language that writes all nouns large shows a noun to be no name.
ARTICLES = frozenset("der die das den dem des ein eine einen einem einer eines im am zum zur beim vom ins".split())


def cased_words(text: str | None) -> tuple[list[str], str]:
    """Words in lower case without accents, punctuation and invisible characters, and for each how it was written.

    ``U`` large and ``l`` small inside a part of a text that uses both, ``A`` large after an article, ``-`` where nothing follows from it.
    """
    if not text:
        return [], ""
    t = text
    if not t.isascii():
        t = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", t))
        t = "".join(ch for ch in t if unicodedata.category(ch) not in ("Mn", "Me", "Cf"))
    found, marks, before = [], [], ""
    for part in _ENDS.split(t.replace("_", " ")):
        said = re.findall(r"\w+", part)
        for i, w in enumerate(said):
            low = w.casefold()
            if i == 0:
                lead = 1 < len(said) <= LEAD and w[0].isupper() and all(x[0].islower() for x in said[1:])
                marks.append("l" if lead or w[0].islower() else "-")
            elif w[0].isupper() and not w[1:].isupper():
                marks.append("A" if before in ARTICLES else "U")
            else:
                marks.append("l" if w[0].islower() else "-")
            found.append(low)
            before = low
    if not {"U", "A"} & set(marks) or "l" not in marks:
        marks = ["-"] * len(marks)
    return found, "".join(marks)


def words(text: str | None) -> list[str]:
    """The words of :func:`cased_words`."""
    return cased_words(text)[0]


def slip(a: str, b: str) -> bool:
    """Whether one letter changed, added, left out or two neighbours swapped turn ``a`` into ``b``; numbers have no slips."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < 2 or max(len(a), len(b)) > SLIPS_UP_TO or any(ch.isdigit() for ch in a + b):
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    if len(a) == len(b):
        return x[1:] == y[1:] or (len(x) > 1 and x[0] == y[1] and x[1] == y[0] and x[2:] == y[2:])
    return x[1:] == y if len(a) > len(b) else x == y[1:]


def two_slips(a: str, b: str) -> bool:
    """Whether a slip in each of two copies of one longer word can explain the difference."""
    if min(len(a), len(b)) < TWO_SLIPS_FROM or max(len(a), len(b)) > SLIPS_UP_TO or abs(len(a) - len(b)) > 2 or any(ch.isdigit() for ch in a + b):
        return False
    near = {a[:i] + a[i + 1 :] for i in range(len(a))} | {a[:i] + a[i + 1] + a[i] + a[i + 2 :] for i in range(len(a) - 1)}
    if any(slip(x, b) for x in near):
        return True
    return len(a) == len(b) and sum(x != y for x, y in zip(a, b)) <= 2


def left_out(word: str, twice: bool = True) -> set[str]:
    """The word and what is left of it without one letter, or (``twice``) two if it is long: words within so many slips share one of these."""
    got = {word}
    if len(word) < 2 or len(word) > SLIPS_UP_TO or any(ch.isdigit() for ch in word):
        return got
    got |= {word[:i] + word[i + 1 :] for i in range(len(word))}
    if twice and len(word) >= TWO_SLIPS_FROM:
        got |= {x[:i] + x[i + 1 :] for x in got - {word} for i in range(len(x))}
    return got


def _matched(left_a: list[str], left_b: list[str], alike) -> list[tuple[str, str]]:
    """Pairs of words of the two lists that are ``alike``, each used once; found by common remainders."""
    by_form: dict[str, list[int]] = defaultdict(list)
    for j, y in enumerate(left_b):
        for f in left_out(y):
            by_form[f].append(j)
    used, out = set(), []
    for x in left_a:
        for j in sorted({j for f in left_out(x) for j in by_form.get(f, ())} - used):
            if alike(x, left_b[j]):
                used.add(j)
                out.append((x, left_b[j]))
                break
    return out


def same_question(a: list[str], b: list[str], names_a: set[str], names_b: set[str]) -> bool:
    """The rule of the module text for one pair of word lists; ``names_*`` are the names among their words."""
    ca, cb = Counter(a), Counter(b)
    left_a, left_b = ca - cb, cb - ca
    shared, least = len(a) - left_a.total(), -(-CONTAINMENT * min(len(a), len(b)) // 10)
    if shared + min(left_a.total(), left_b.total()) < least:
        return False
    slips = _matched(list(left_a.elements()), list(left_b.elements()), lambda x, y: slip(x, y) and not (x in DIRECTIONS and y in DIRECTIONS))
    left_a -= Counter(x for x, _ in slips)
    left_b -= Counter(y for _, y in slips)
    if any(ch.isdigit() for w in (*left_a, *left_b) for ch in w):
        return False
    if not NEGATIONS.isdisjoint(left_a) or not NEGATIONS.isdisjoint(left_b):
        return False
    if not DIRECTIONS.isdisjoint(left_a) and not DIRECTIONS.isdisjoint(left_b):
        return False
    twice = _matched([w for w in left_a.elements() if w in names_a], [w for w in left_b.elements() if w in names_b], two_slips)
    left_a -= Counter(x for x, _ in twice)
    left_b -= Counter(y for _, y in twice)
    if names_a or names_b:
        if not (names_a and names_a.isdisjoint(left_a)) and not (names_b and names_b.isdisjoint(left_b)):
            return False
    return shared + len(slips) + len(twice) >= least


def begun_at(word: str, d: int, twice: bool = True) -> set[str]:
    """Those of :func:`left_out` that begin with the letter ``d`` of the word; all of them together for ``d`` 0, 1 and 2."""
    most = 0 if len(word) < 2 or len(word) > SLIPS_UP_TO or any(ch.isdigit() for ch in word) else 2 if twice and len(word) >= TWO_SLIPS_FROM else 1
    if d > most:
        return set()
    first, rest = word[d], word[d + 1 :]
    got = {rest}
    for _ in range(most - d):
        got |= {x[:i] + x[i + 1 :] for x in got for i in range(len(x))}
    return {first + x for x in got}


def _saved(df: DataFrame) -> DataFrame:
    """:func:`cut` whose shuffle files go as soon as the table is written, instead of when the driver happens to collect its garbage."""
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name, None)
    conf.set(name, "true")
    try:
        return cut(df)
    finally:
        conf.set(name, before) if before else conf.unset(name)


def _read(df: DataFrame, row_id: str, text: str, side: str) -> DataFrame:
    """``row_id, side, text_id, bare, marks`` of the rows of both sides; texts without words ask for nothing."""

    @F.pandas_udf("bare string, marks string")
    def bare(t: pd.Series) -> pd.DataFrame:
        got = [cased_words(x) for x in t]
        return pd.DataFrame({"bare": [" ".join(w) for w, _ in got], "marks": [m for _, m in got]})

    rows = df.where(F.col(side).isin("train", "eval")).select(F.col(row_id).alias("row_id"), F.col(side).alias("side"), bare(text).alias("x")).select("row_id", "side", "x.*")
    return _saved(rows.where("bare != ''").withColumn("text_id", F.unhex(F.md5("bare"))))


def _numbers(words_col: Column) -> Column:
    """Hash of the words with digits; two texts with other such words are never near-same."""
    return F.xxhash64(F.array_sort(F.filter(words_col, lambda w: w.rlike(r"\p{Nd}"))))


def _texts(rows: DataFrame) -> DataFrame:
    """One row for each different text: ``id, text_id, train, eval, bare, numbers``."""
    texts = rows.groupBy("text_id").agg(F.first("bare").alias("bare"), F.bool_or(F.col("side") == "train").alias("train"), F.bool_or(F.col("side") == "eval").alias("eval"))
    return _saved(texts.select(F.monotonically_increasing_id().alias("id"), "text_id", "train", "eval", "bare", _numbers(F.split("bare", " ")).alias("numbers")))


def _names(rows: DataFrame) -> DataFrame:
    """``word, name, n`` of all words, see the module text."""
    zipped = F.explode(F.arrays_zip(F.split("bare", " ").alias("w"), F.split("marks", "").alias("m")))
    each = rows.select(zipped.alias("x")).select(F.col("x.w").alias("word"), F.col("x.m").alias("m")).where("word is not null")
    counts = each.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("m").isin("U", "A")).alias("large"), F.count_if(F.col("m") == "A").alias("article"), F.count_if(F.col("m") == "l").alias("small"))
    large = (F.col("large") > F.col("small")) | (F.col("small") == 0)
    noun = (F.col("large") > 0) & (F.col("article") >= NOUN * F.col("large"))
    return _saved(counts.select("word", (large & ~noun).alias("name"), "n"))


def _described(texts: DataFrame, names: DataFrame) -> DataFrame:
    """``id, train, eval, numbers, bare, words, names, prefix, spare`` of the texts.

    ``names`` and ``prefix`` begin with the rarest word, of equally rare ones with the longest, which has the fewest
    variants; ``prefix`` holds two words more than may be missing (``spare``) when a text is contained in another one.
    """
    least = max(2, int(FREQUENT * (names.agg(F.sum("n")).first()[0] or 0)))
    frequent = F.broadcast(names.where(F.col("n") >= least))
    each = texts.select("id", F.explode(F.array_distinct(F.split("bare", " "))).alias("word"))
    found = each.join(frequent, "word").unionByName(each.join(frequent.select("word"), "word", "left_anti").join(names.where(F.col("n") < least), "word"))
    ranked = found.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", (-F.length("word")).alias("l"), "word", "name"))).alias("r"))
    words = F.split("bare", " ")
    spare = F.floor(F.size(words) * F.lit(10 - CONTAINMENT) / 10).cast("int")
    return _saved(texts.join(ranked, "id").select("id", "train", "eval", "numbers", "bare", F.filter("r", lambda x: x["name"])["word"].alias("names"), F.slice(F.col("r")["word"], F.lit(1), spare + 2).alias("prefix"))).select(
        "id", "train", "eval", "numbers", "bare", words.alias("words"), "names", "prefix", spare.alias("spare")
    )


def _gram(word: Column) -> Column:
    """Key of the n-gram of a word with all numbers of its text."""
    return F.xxhash64(word, F.col("numbers"))


def _meeting_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``numbers, word, other, named``: words that are looked up and others, or themselves, with a common remainder.

    The rows come sorted by (numbers, letter). Of each such group ``CHUNK`` words looked up are held with their remainders
    at once, and all words of the group go past them.
    """

    def group(numbers: int, rows: list[tuple]) -> Iterator[tuple]:
        looking = [r for r in rows if r[3]]
        for at in range(0, len(looking), CHUNK):
            by_form: dict[str, list[tuple]] = {}
            for r in looking[at : at + CHUNK]:
                for f in begun_at(r[1], r[0], r[2]):
                    by_form.setdefault(f, []).append(r)
            for d, other, named, _, holds in rows:
                for word, looks in {(r[1], r[3]) for f in begun_at(other, d, named) for r in by_form.get(f, ())}:
                    if (looks & 1 and holds & 2) or (looks & 2 and holds & 1):
                        yield numbers, word, other, named

    def groups() -> Iterator[tuple]:
        last, rows = None, []
        for t in batches:
            for numbers, letter, *r in zip(*(t[c].tolist() for c in ("numbers", "letter", "d", "word", "named", "looks", "holds"))):
                if (numbers, letter) != last:
                    if rows:
                        yield from group(last[0], rows)
                    last, rows = (numbers, letter), []
                rows.append(tuple(r))
        if rows:
            yield from group(last[0], rows)

    got = groups()
    while part := list(itertools.islice(got, 50_000)):
        yield pd.DataFrame(part, columns=["numbers", "word", "other", "named"])


def _variants(texts: DataFrame, looks: Column) -> DataFrame:
    """``gram, near, plain``: the n-grams with the words ``looks`` of a text, and which n-grams of texts of the other side may be variants.

    A variant has the same numbers and a word that shares a remainder; those of ``plain`` are no names. A word is sent
    to the first letters that its remainders may have, three at most, and remainders are made and compared there, so
    they are never shuffled.
    """
    side = F.when(F.col("train"), 1).otherwise(0) + F.when(F.col("eval"), 2).otherwise(0)
    one = lambda w: F.struct(w.alias("word"), F.array_contains("names", w).alias("named"), F.coalesce(F.array_contains(looks, w), F.lit(False)).alias("look"))
    each = texts.select("numbers", side.alias("side"), F.explode(F.transform(F.array_distinct("words"), one)).alias("x")).select("numbers", "side", "x.*")
    terms = each.groupBy("numbers", "word", "named").agg(F.bit_or(F.when(F.col("look"), F.col("side")).otherwise(0)).alias("looks"), F.bit_or("side").alias("holds"))
    last = F.when(F.col("word").rlike(r"\p{Nd}") | (F.length("word") < 2) | (F.length("word") > SLIPS_UP_TO), 0).when(F.col("named") & (F.length("word") >= TWO_SLIPS_FROM), 2).otherwise(1)
    sent = terms.withColumn("d", F.explode(F.sequence(F.lit(0), last))).select("numbers", F.expr("substring(word, d + 1, 1)").alias("letter"), "d", "word", "named", "looks", "holds")
    met = sent.repartition("numbers", "letter").sortWithinPartitions("numbers", "letter").mapInPandas(_meeting_words, "numbers long, word string, other string, named boolean")
    key = _gram(F.col("other"))
    return _saved(met.groupBy(_gram(F.col("word")).alias("gram")).agg(F.collect_set(key).alias("near"), F.collect_set(F.when(~F.col("named"), key)).alias("plain")))


def _looked_up(probes: DataFrame, variants: DataFrame) -> DataFrame:
    """``probes`` with one row for each variant of their n-gram ``gram``, as ``key``."""
    counts = _saved(probes.groupBy("gram").agg(F.count(F.lit(1)).alias("n")))
    hot = counted_hot(counts, "gram", "n")
    drop_cut(counts)
    return skew_join(probes, variants.select("gram", "near"), "gram", hot=hot).withColumn("key", F.explode("near")).drop("near", "gram")


def _holding(texts: DataFrame, variants: DataFrame, *cols: str) -> DataFrame:
    """``cols, key`` of the n-grams of the texts' names and of those other words that are a variant of a word looked up."""
    plain = _saved(variants.select(F.explode("plain").alias("key")).distinct())
    of = lambda ws: texts.select(*cols, F.explode(F.transform(ws, _gram)).alias("key"))
    return of(F.array_distinct("names")).unionByName(of(F.array_except("words", "names")).join(plain, "key", "left_semi").select(*cols, "key"))


def _meet(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``a, b`` of a training and an evaluation text with a common ``key``; the keys with more than ``HOT`` pairs, which are left to the caller).

    If ``left`` has a ``second`` name, only those pairs leave the join in which it may stand in the ``bare`` words of the right text.
    """
    second = "second" in left.columns
    l, r = _saved(left), right if second else _saved(right)  # noqa: E741
    tally = lambda t, p: t.groupBy("key").agg(F.count_if("train").alias(f"{p}t"), F.count_if("eval").alias(f"{p}e"))
    counts = tally(l, "l").join(tally(r, "r"), "key").withColumn("n", F.col("lt") * F.col("re") + F.col("le") * F.col("rt")).where("n > 0")
    counts = _saved(counts.select("key", "n"))
    usable = counts.where(F.col("n") <= HOT).select("key")
    x = l.join(usable, "key", "left_semi").select("key", F.col("id").alias("x"), F.col("train").alias("xt"), F.col("eval").alias("xe"), *["second"] * second)
    r = r.repartition("key") if second else r  # texts are split into words behind the shuffle, where they are short
    y = r.join(usable, "key", "left_semi").select("key", F.col("id").alias("y"), F.col("train").alias("yt"), F.col("eval").alias("ye"), *[F.split("bare", " ").alias("words")] * second)
    met = x.join(y, "key").where("x != y and ((xt and ye) or (xe and yt))")
    if second:
        met = met.where(F.col("second").isNull() | _fits(F.col("second"), F.col("words")))
    out = _saved(_directed(met)), _saved(counts.where(F.col("n") > HOT).select("key"))
    for t in (l, r, counts):
        if t is not right:
            drop_cut(t)
    return out


def _directed(met: DataFrame) -> DataFrame:
    first = F.when(F.expr("xt and ye"), F.struct(F.col("x").alias("a"), F.col("y").alias("b")))
    second = F.when(F.expr("xe and yt"), F.struct(F.col("y").alias("a"), F.col("x").alias("b")))
    return met.select(F.explode(F.array_compact(F.array(first, second))).alias("p")).select("p.a", "p.b").distinct()


def _block_pairs(left: DataFrame, right: DataFrame, texts: DataFrame, hot: DataFrame) -> DataFrame:
    """Near-same ``a, b`` with a common ``key`` of ``hot``: all its pairs are compared, in blocks of ``BLOCK`` by ``BLOCK`` texts, and only the near-same ones leave the block."""
    l, r = (_saved(t.join(hot, "key", "left_semi").select("key", "id").distinct()) for t in (left, right))
    sizes = l.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("nl")).join(r.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("nr")), "key")
    sizes = _saved(sizes)
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    wide = texts.select("id", "train", "eval", "words", "names")
    cols = ["key", "i", "j", "id", "train", "eval", "words", "names"]
    ls = l.join(sizes, "key").withColumn("i", own("nl")).withColumn("j", every("nr")).join(wide, "id").select([F.col(c).alias(c) for c in cols])
    rs = r.join(sizes, "key").withColumn("j", own("nr")).withColumn("i", every("nl")).join(wide, "id").select([F.col(c).alias(c) for c in cols])

    def compare(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        rows = lambda t: [(k, tr, ev, list(w), set(n)) for k, tr, ev, w, n in zip(t["id"], t["train"], t["eval"], t["words"], t["names"])]
        out, others = [], rows(y)
        for p, p_train, p_eval, pw, pn in rows(x):
            for q, q_train, q_eval, qw, qn in others:
                if p != q and ((p_train and q_eval) or (p_eval and q_train)) and same_question(pw, qw, pn, qn):
                    out += ([(p, q)] if p_train and q_eval else []) + ([(q, p)] if p_eval and q_train else [])
        return pd.DataFrame(out, columns=["a", "b"])

    return ls.groupBy("key", "i", "j").cogroup(rs.groupBy("key", "i", "j")).applyInPandas(compare, "a long, b long")


def _fits(name: Column, said: Column) -> Column:
    """Whether a name may stand among the words of a text: one of them is within as many edits as slips can make."""
    near = lambda w: F.when(F.length(name) < TWO_SLIPS_FROM, F.levenshtein(name, w, 2) >= 0).otherwise(F.levenshtein(name, w, 4) >= 0)
    return F.array_contains(said, name) | F.exists(said, lambda w: (F.abs(F.length(name) - F.length(w)) <= 2) & near(w))


def _held(names: Column, said: Column) -> Column:
    """Whether all names may stand in another text."""
    return (F.size(names) > 0) & F.forall(names, lambda n: _fits(n, said))


def _checked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The near-same ones of candidate pairs; most others fall to :func:`_held` inside the JVM."""
    one = lambda p: texts.select(F.col("id").alias(p), F.array_join("words", " ").alias(f"said_{p}"), F.array_join("names", " ").alias(f"named_{p}"))
    both = skew_join(pairs, one("a"), "a")
    both = skew_join(both, one("b"), "b", hot=hot_keys(pairs, "b"))

    @F.pandas_udf("boolean")
    def check(wa: pd.Series, wb: pd.Series, na: pd.Series, nb: pd.Series) -> pd.Series:
        return pd.Series([same_question(p.split(" "), q.split(" "), set(r.split()), set(s.split())) for p, q, r, s in zip(wa, wb, na, nb)], dtype=bool)

    split = lambda c: F.filter(F.split(c, " "), lambda w: w != "").alias(c)
    may = lambda x: ((F.size(x["named_a"]) == 0) & (F.size(x["named_b"]) == 0)) | _held(x["named_a"], x["said_b"]) | _held(x["named_b"], x["said_a"])
    texts_of = F.array(F.struct(*[split(c) for c in ("said_a", "said_b", "named_a", "named_b")]))  # one element, so that each text is split once and not for each of its words
    return both.where(F.exists(texts_of, may)).where(check("said_a", "said_b", "named_a", "named_b")).select("a", "b")


def near_same(texts: DataFrame) -> DataFrame:
    """``a, b``: every near-same pair of a training and a different evaluation text, by ``id``; see the module text for why none is lost."""
    who = ["id", "train", "eval"]
    named, bare = texts.where(F.size("names") > 0), texts.where(F.size("names") == 0)
    rarest = F.slice("names", 1, 1)
    some = F.slice("prefix", F.lit(1), F.col("spare") + 1)
    variants = _variants(texts, F.when(F.size("names") > 0, rarest).otherwise(some))
    grams = lambda ws: F.explode(F.transform(ws, _gram)).alias("gram")

    left, right = _looked_up(named.select(*who, F.try_element_at("names", F.lit(2)).alias("second"), grams(rarest)), variants).select(*who, "second", "key"), _holding(texts, variants, *who, "bare")
    pairs, hot = _meet(left, right)
    bare_left, bare_right = _looked_up(bare.select(*who, grams(some)), variants).select(*who, "key"), _holding(bare, variants, *who)
    more, hot_bare = _meet(bare_left, bare_right)
    pairs, sure = pairs.unionByName(more), []

    if not hot_bare.isEmpty():
        sure.append(_block_pairs(bare_left, bare_right, texts, hot_bare))
    if not hot.isEmpty():
        # the shorter text of a pair looks for one of its prefix words in the longer one, which may be on either side of the n-gram
        firsts = _looked_up(named.select("id", _gram(F.element_at("names", 1)).alias("own"), grams(rarest)), variants)
        seconds = _holding(texts, variants, "id").withColumn("own", F.col("key"))
        x, y = (_saved(t.join(hot, "key", "left_semi").select("id", "own", F.col("key").alias("first"))) for t in (firsts, seconds))
        among = texts.join(x.select("id").unionByName(y.select("id")).distinct(), "id", "left_semi")
        variants = _variants(among, F.col("prefix"))
        prefix = F.transform("prefix", _gram)
        others = F.slice(F.filter(prefix, lambda g: g != F.col("own")), F.lit(1), F.col("spare") + 1)  # the n-gram itself would be as frequent again
        enough = F.explode(F.when(F.size(others) > F.col("spare"), others).otherwise(prefix)).alias("gram")
        longer = F.xxhash64("first", "key").alias("key")
        for p, q in ((x, y), (y, x)):
            looks = _looked_up(texts.join(p, "id").select(*who, "first", enough), variants).select(*who, longer)
            holds = _holding(texts.join(q.select("id", "first"), "id"), variants, *who, "first").select(*who, longer)
            more, rest = _meet(looks, holds)
            pairs = pairs.unionByName(more)
            if not rest.isEmpty():
                sure.append(_block_pairs(looks, holds, texts, rest))
    out = _checked(_saved(pairs.distinct()), texts)
    for block in sure:
        out = out.unionByName(block)
    return out.distinct()


def overlapping_texts(df: DataFrame, row_id: str, text: str, side: str) -> tuple[DataFrame, DataFrame]:
    """(links, members): near-same pairs of texts as ``a`` (training), ``b`` (evaluation), and ``row_id, side, text_id`` of the rows.

    ``side`` is ``train`` or ``eval``; other and null values are in neither. Equal texts are one class; a class with
    rows on both sides overlaps with itself and appears as the pair (a, a). Null, empty and wordless texts take no
    part, repeated rows count, other columns do not matter, and an empty table gives no links.
    """
    rows = _read(df, row_id, text, side)
    texts = _texts(rows)
    names = _names(rows)
    near = _saved(near_same(_described(texts, names)))
    of = lambda p: texts.select(F.col("id").alias(f"{p}_id"), F.col("text_id").alias(p))
    links = near.select(F.col("a").alias("a_id"), F.col("b").alias("b_id")).join(of("a"), "a_id").join(of("b"), "b_id").select("a", "b")
    own = texts.where("train and eval").select(F.col("text_id").alias("a"), F.col("text_id").alias("b"))
    return _saved(links.unionByName(own)), rows.select("row_id", "side", "text_id")


def overlap_classes(links: DataFrame, members: DataFrame) -> DataFrame:
    """``row_id, side, class_id, links``: the class of each row and with how many classes of the other side it overlaps."""
    n = links.select(F.lit("train").alias("side"), F.col("a").alias("text_id")).unionByName(links.select(F.lit("eval").alias("side"), F.col("b").alias("text_id")))
    n = n.groupBy("side", "text_id").agg(F.count(F.lit(1)).alias("links")).withColumn("key", F.concat_ws(":", "side", F.hex("text_id"))).select("key", "links")
    rows = members.withColumn("key", F.concat_ws(":", "side", F.hex("text_id")))
    return skew_join(rows, n, "key", "left").select("row_id", "side", F.lower(F.hex("text_id")).alias("class_id"), F.coalesce("links", F.lit(0).cast("long")).alias("links"))


def overlapping_rows(df: DataFrame, row_id: str, text: str, side: str) -> DataFrame:
    """``train_id, eval_id``: every pair of rows of overlapping texts.

    The rows of a text are split into parts of about ``BLOCK`` rows and a link into one for each pair of parts, so a
    text that holds a large share of all rows is spread over as many tasks as its pairs need.
    """
    links, members = overlapping_texts(df, row_id, text, side)
    sizes = cut(members.groupBy("text_id").agg(F.count_if(F.col("side") == "train").alias("t"), F.count_if(F.col("side") == "eval").alias("e")))
    parts = sizes.select("text_id", F.ceil(F.col("t") / BLOCK).cast("int").alias("pt"), F.ceil(F.col("e") / BLOCK).cast("int").alias("pe"))
    linked = links.join(parts.select(F.col("text_id").alias("a"), "pt"), "a").join(parts.select(F.col("text_id").alias("b"), "pe"), "b")
    linked = linked.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("pt") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("pe") - 1))).select("a", "b", "i", "j")
    hot = counted_hot(sizes.withColumn("n", F.col("t") + F.col("e")), "text_id", "n")
    placed = skew_join(members, parts, "text_id", hot=hot)
    part = lambda n: F.pmod(F.xxhash64("row_id"), F.col(n)).cast("int")
    trains = placed.where("side = 'train'").select(F.col("text_id").alias("a"), part("pt").alias("i"), F.col("row_id").alias("train_id"))
    evals = placed.where("side = 'eval'").select(F.col("text_id").alias("b"), part("pe").alias("j"), F.col("row_id").alias("eval_id"))
    return linked.join(trains, ["a", "i"]).join(evals, ["b", "j"]).select("train_id", "eval_id")
