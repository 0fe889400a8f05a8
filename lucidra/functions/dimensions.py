"""The seven workload dimensions R1-R7: names, levels and the rules that turn raw values into levels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Codes, slugs and ordered levels of the dimensions.
DIMENSIONS = {
    "R1": ("knowledge_frequency", ["head", "middle", "tail"]),
    "R2": ("precision_requirement", ["coarse", "medium", "fine"]),
    "R3": ("knowledge_recency", ["pre_cutoff", "post_0_3_months", "post_4_12_months", "post_13_plus_months"]),
    "R4": ("query_ambiguity", ["unambiguous", "two_way", "three_plus"]),
    "R5": ("synthesis_depth", ["one_hop", "two_hop", "three_hop", "four_plus_hop"]),
    "R6": ("domain_specificity", ["general", "specialized", "expert"]),
    "R7": ("confidence_threshold", ["tau_0_50", "tau_0_70", "tau_0_90", "tau_0_95", "tau_0_99"]),
}
# The policy grid.
POLICY_GRID = [0.50, 0.70, 0.90, 0.95, 0.99]
DAYS_PER_MONTH = 365.2425 / 12


def _name(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s-]+", "_")


def dimension_code(c: Column) -> Column:
    """R1..R7 for a code or a slug in any letter case; null for other names."""
    name, out = _name(c), F.lit(None).cast("string")
    for code, (slug, _) in DIMENSIONS.items():
        out = F.when(name.isin(code.lower(), slug), code).otherwise(out)
    return out


def level_slug(c: Column) -> Column:
    """Level names: trimmed, lower case, blanks and hyphens as underscores."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[ -]", "_")


def r1_level(freq: Column, tail_max: float, middle_max: float) -> Column:
    """tail up to ``tail_max``, middle up to ``middle_max``, else head; null for null or negative values."""
    if not tail_max < middle_max:
        raise ValueError("tail_max must be below middle_max")
    return F.when(freq < 0, None).when(freq <= tail_max, "tail").when(freq <= middle_max, "middle").when(freq.isNotNull(), "head")


def months_after(event: Column, cutoff: Column) -> Column:
    """Months of average length from the cutoff date to the event date."""
    return F.datediff(event, cutoff) / F.lit(DAYS_PER_MONTH)


def r3_level(months: Column) -> Column:
    """Recency band of a signed number of months after the cutoff."""
    return (
        F.when(months <= 0, "pre_cutoff").when(months <= 3, "post_0_3_months").when(months <= 12, "post_4_12_months").when(months.isNotNull(), "post_13_plus_months")
    )


def r4_level(n: Column) -> Column:
    """Ambiguity level of a number of interpretations (null below 1)."""
    return F.when(n == 1, "unambiguous").when(n == 2, "two_way").when(n >= 3, "three_plus")


def r5_level(n: Column) -> Column:
    """Depth level of a number of hops (null below 1)."""
    return F.when(n == 1, "one_hop").when(n == 2, "two_hop").when(n == 3, "three_hop").when(n >= 4, "four_plus_hop")


def r6_level(x: Column, general_max: float = 0.33, specialized_max: float = 0.66) -> Column:
    """Specificity level of a number in [0, 1]; null outside."""
    if not 0 <= general_max < specialized_max <= 1:
        raise ValueError("cut points must rise within [0, 1]")
    return F.when((x < 0) | (x > 1), None).when(x <= general_max, "general").when(x <= specialized_max, "specialized").when(x.isNotNull(), "expert")


def r7_level(t: Column, tolerance: float = 1e-12) -> Column:
    """Name of the grid threshold that ``t`` equals within ``tolerance``; null for other values."""
    out = F.lit(None).cast("string")
    for value, level in zip(POLICY_GRID, DIMENSIONS["R7"][1]):
        out = F.when(F.abs(t - F.lit(value)) <= tolerance, level).otherwise(out)
    return out


def nearest_r7(t: Column) -> Column:
    """Name of the grid threshold nearest to ``t`` (ties: the lower one); null if ``t`` is null or NaN."""
    pairs = F.array(*[F.struct(F.abs(t - F.lit(v)).alias("d"), F.lit(level).alias("level")) for v, level in zip(POLICY_GRID, DIMENSIONS["R7"][1])])
    return F.when(t.isNotNull() & ~F.isnan(t), F.array_min(pairs)["level"])


def crossed_group(parts: dict[str, Column]) -> Column:
    """``R1=tail|R5=two_hop`` in the caller's order; null if a part is null."""
    return F.concat(*[x for i, (k, c) in enumerate(parts.items()) for x in ([F.lit("|")] if i else []) + [F.lit(f"{k}="), c.cast("string")]])


def level_consistent(code: str, raw: Column, level: Column, **cuts: float) -> Column:
    """Whether the given level is the one its raw value implies, where the dimension defines that; else level validity."""
    rules = {"R1": r1_level, "R3": r3_level, "R4": r4_level, "R5": r5_level, "R6": r6_level, "R7": r7_level}
    if code in rules and (cuts or code in ("R3", "R4", "R5", "R7")):
        return rules[code](raw, **cuts).eqNullSafe(level)
    return level.isin(DIMENSIONS[code][1])
