"""Splits that keep related records together (problem 2).

Linked records form components (see :mod:`lucidra.operators.components`), and components are placed by
grouped iterative stratification over their label vectors: the label with the fewest outstanding records
first, its components into the split that needs that label most. Components so large that they matter one
by one are placed one by one; the many others are placed a whole label vector at a time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lucidra.llm.packing import PART_ROWS, PARTS, ranked_within
from lucidra.operators.components import connected_components
from lucidra.util import counted_hot, cut, skew_join

# Words that stand for no value.
PLACEHOLDERS = ["n/a", "na", "none", "not applicable", "tbd", "todo", "unknown"]
LINK_FIELDS = ("entity_id", "chain_id", "source_fact_id")


def _named(field: str) -> Callable[[Column], Column]:
    return lambda v: F.struct(F.lit(field).alias("field"), F.lower(F.regexp_replace(v, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")).alias("v"))


def link_tokens(df: DataFrame, row_id: str, metadata: str, fields: tuple[str, ...] = LINK_FIELDS) -> DataFrame:
    """``row, token``: one row for each value of each field; lists give one for each element.

    Values compare trimmed and in lower case; blanks and placeholder words give no token, and neither
    does metadata that is null or does not parse.
    """
    parts = []
    for f in fields:
        raw = F.get_json_object(F.col(metadata), f"$.{f}")
        many = F.when(F.ltrim(raw).startswith("["), F.coalesce(F.from_json(raw, "array<string>"), F.array(raw))).otherwise(F.array(raw))
        parts.append(F.transform(many, _named(f)))
    values = df.select(F.col(row_id).alias("row"), F.explode(F.flatten(F.array(*parts))).alias("x")).select("row", "x.*")
    values = values.where(F.col("v").isNotNull() & (F.col("v") != "") & ~F.col("v").isin(PLACEHOLDERS))
    return values.select("row", F.concat_ws(":", "field", "v").alias("token"))


def linked_groups(df: DataFrame, row_id: str, metadata: str, fields: tuple[str, ...] = LINK_FIELDS) -> DataFrame:
    """``row, component`` of the rows that share a value in one field with another row, directly or not."""
    return connected_components(link_tokens(df, row_id, metadata, fields), "row", "token")


#: A component is placed on its own if it holds this share of the records of one of its labels, or more; at most its inverse for each label.
LARGE = 0.001


def label_vectors(df: DataFrame, row_id: str, labels: list[str], groups: DataFrame) -> DataFrame:
    """``component, label, m``: how many records of each label a component has; records without links are their own component.

    A record has one label for each column of ``labels`` (null is a label too).
    """
    named = F.explode(F.array(*[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("<null>"))) for c in labels]))
    rows = df.select(F.col(row_id).alias("row"), *labels).join(groups, "row", "left")
    return rows.select(F.coalesce("component", "row").alias("component"), named.alias("label")).groupBy("component", "label").agg(F.count(F.lit(1)).alias("m"))


def _take(need: dict[str, dict[str, float]], vector: dict[str, float], split: str) -> None:
    for label, m in vector.items():
        need[label][split] -= m


def place_singly(components: list[tuple], need: dict[str, dict[str, float]], names: list[str]) -> list[tuple]:
    """(component, split) of each (component, {label: m}), largest first within its label: the label with the fewest
    outstanding records first, each of its components into the split that needs the label most. ``need`` is used up."""
    waiting, left, out = dict(components), {}, []
    for vector in waiting.values():
        for label, m in vector.items():
            left[label] = left.get(label, 0) + m
    while waiting:
        label = min((x for x in left if left[x] > 0), key=lambda x: (left[x], x))
        mine = sorted((c for c, v in waiting.items() if label in v), key=lambda c: (-waiting[c][label], c))
        for c in mine:
            vector = waiting.pop(c)
            best = max(names, key=lambda s: (need[label][s], sum(need[x][s] for x in vector), s))
            _take(need, vector, best)
            for x, m in vector.items():
                left[x] -= m
            out.append((c, best))
    return out


def shares_by_label(held: dict[str, dict[str, float]], need: dict[str, dict[str, float]], names: list[str]) -> dict[str, list[float]]:
    """In what shares the components of each first label go to the splits: labels with the fewest records first, by what is then still needed.

    ``held[first][label]``: records of a label in all components whose first label is ``first``.
    """
    out = {}
    for first in sorted(held, key=lambda x: (sum(h.get(x, 0) for h in held.values()), x)):
        wants = [max(need[first][s], 0.0) for s in names]
        total = sum(wants)
        out[first] = [w / total for w in wants] if total else [1 / len(names)] * len(names)
        for s, share in zip(names, out[first]):
            _take(need, {label: m * share for label, m in held[first].items()}, s)
    return out


def stratified_assignment(vectors: DataFrame, fractions: dict[str, float]) -> DataFrame:
    """``component, split`` for ``component, label, m``; fractions by split name, scaled to sum to 1.

    Components with a share of ``LARGE`` of one of their labels are placed one by one on the driver. All others are
    grouped by their whole label vector; the members of a vector are dealt to the splits in the shares that its rarest
    label still needs, by their rank and the golden ratio, which keeps every stretch of ranks near those shares. The
    number of jobs does not depend on the number of labels; the driver sees sums for pairs of labels.
    Whole components are placed, so a split can miss its share by about one large component. The result
    depends on the set of rows only. Empty input gives no row.
    """
    if not fractions or min(fractions.values()) < 0 or sum(fractions.values()) <= 0:
        raise ValueError("fractions must be non-negative and not all zero")
    scale, names = sum(fractions.values()), sorted(fractions)
    vectors = cut(vectors)
    kind = vectors.schema["component"].dataType.simpleString()
    totals = {r.label: int(r.m) for r in vectors.groupBy("label").agg(F.sum("m").alias("m")).collect()}
    if not totals:
        return vectors.select("component", F.lit("").alias("split")).limit(0)
    spark = vectors.sparkSession
    known = F.broadcast(spark.createDataFrame(sorted(totals.items()), "label string, total long"))
    each = vectors.join(known, "label").withColumn("large", F.col("m") >= F.lit(LARGE) * F.col("total"))
    vector = F.array_sort(F.collect_list(F.struct("total", "label", "m")))
    whole = cut(each.groupBy("component").agg(vector.alias("v"), F.bool_or("large").alias("large")))

    need = {x: {s: n * fractions[s] / scale for s in names} for x, n in totals.items()}
    large = [(r.component, {x.label: int(x.m) for x in r.v}) for r in whole.where("large").select("component", "v").collect()]
    single = spark.createDataFrame(place_singly(large, need, names), f"component {kind}, split string")

    small = whole.where("not large").select("component", F.col("v")[0]["label"].alias("first"), "v", F.xxhash64("v").alias("sig"))
    sums = small.select("first", F.inline("v")).groupBy("first", "label").agg(F.sum("m").alias("m")).collect()
    held: dict[str, dict[str, float]] = {}
    for r in sums:
        held.setdefault(r.first, {})[r.label] = float(r.m)
    if not held:
        return single
    shares = shares_by_label(held, need, names)
    upto = [(x, [sum(shares[x][: i + 1]) for i in range(len(names) - 1)]) for x in sorted(shares)]
    bounds = F.broadcast(spark.createDataFrame(upto, "first string, upto array<double>"))
    sized = cut(small.select("component", "first", "sig").withColumn("o", F.struct(F.xxhash64("component").alias("h"), "component")))
    most = sized.groupBy("sig").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    ranked = ranked_within(sized, ["sig"], "o", max(PARTS, most // PART_ROWS)).join(bounds, "first")
    start = F.pmod(F.col("sig"), F.lit(1 << 20)) / float(1 << 20)
    spot = F.pmod(start + F.col("rank") * F.lit((5**0.5 - 1) / 2), F.lit(1.0))
    index = F.size(F.filter("upto", lambda u: u <= spot)) + 1
    return single.unionByName(ranked.select("component", F.element_at(F.array(*[F.lit(s) for s in names]), index).alias("split")))


def assign(df: DataFrame, row_id: str, metadata: str, labels: list[str], fractions: dict[str, float]) -> DataFrame:
    """``row_id, component, split`` of every record.

    Null or broken metadata links nothing; rows repeated under one id share their component and stay repeated;
    extra columns do not matter. The rows of a giant component stay where they are.
    """
    groups = cut(linked_groups(df, row_id, metadata))
    placed = cut(stratified_assignment(label_vectors(df, row_id, labels, groups), fractions))
    rows = df.select(F.col(row_id).alias("row")).join(groups, "row", "left").withColumn("component", F.coalesce("component", "row"))
    sizes = cut(groups.groupBy("component").agg(F.count(F.lit(1)).alias("n")))
    return skew_join(rows, placed, "component", hot=counted_hot(sizes, "component", "n")).select(F.col("row").alias("row_id"), "component", "split")
