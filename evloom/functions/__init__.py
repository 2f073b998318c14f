"""Column functions that several operators share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The floors of the High, Medium and Low levels.
HIGH, MEDIUM, LOW = 0.80, 0.50, 0.20
# Name prefixes of read-only audit records.
READ_ONLY = ["Describe", "List", "Get", "Lookup", "Head", "Check", "Batch", "Search"]


def row_count() -> Column:
    return F.count(F.lit(1))


def level_for_score(score: Column) -> Column:
    return F.when(score >= HIGH, "High").when(score >= MEDIUM, "Medium").when(score >= LOW, "Low").otherwise("Unknown")


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def risk_tier(status: Column, criticality: Column) -> Column:
    """critical to low from protection and criticality; an unknown status is medium."""
    bare, partial = status == "unprotected", status == "partial"
    ladder = F.when(bare & (criticality >= 7), "critical").when(bare & (criticality >= 4) | partial & (criticality >= 7), "high")
    return ladder.when(status == "protected", "low").otherwise("medium")


def grade(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 75, "B").when(score >= 60, "C").when(score >= 40, "D").otherwise("F")


def freshness(age_hours: Column, required: Column) -> Column:
    """100 within the window, falling to 0 at twice of it; never verified (null): 0; nothing required: 100."""
    late = 100.0 * (2 - age_hours / required)
    return F.when(required <= 0, 100.0).when(age_hours.isNull(), 0.0).when(age_hours <= required, 100.0).otherwise(F.greatest(F.lit(0.0), late))


def read_only(name: Column) -> Column:
    return name.rlike("^(" + "|".join(READ_ONLY) + ")")


def valid_id(x: Column) -> Column:
    """Not empty, at most 256 bytes, without slashes, NUL or '..'."""
    return (F.octet_length(x) > 0) & (F.octet_length(x) <= 256) & ~x.rlike("[/\\\\\\x00]") & ~F.contains(x, F.lit(".."))


def same_typed(a_tag: Column, a: Column, b_tag: Column, b: Column) -> Column:
    """Equality of tagged values: an Int never equals a Float."""
    return a_tag.eqNullSafe(b_tag) & a.eqNullSafe(b)


def as_number(i: Column, d: Column) -> Column:
    """A tagged value as a float: floats, and ints widened."""
    return F.coalesce(d, i.cast("double"))


def hour_outside(hour: Column, start: int, end: int) -> Column:
    """Whether an hour lies outside [start, end], which may wrap midnight."""
    return ~hour.between(start, end) if start <= end else (hour > end) & (hour < start)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def event_filter(tree: dict) -> Column:
    """A condition on events from a filter tree, such as {"and": [{"kind": "Signal"}, {"not": {"node": "user:1"}}]}.

    Leaves: any, node, node_type (matches creations only), kind, signal. Branches: and, or, not."""
    ((op, arg),) = tree.items()
    match op:
        case "any":
            return F.lit(True)
        case "node":
            return F.coalesce(F.col("node_id") == arg, F.lit(False))
        case "node_type":
            return (F.col("kind") == "NodeCreated") & F.startswith("node_id", F.lit(f"{arg}:"))
        case "kind":
            return F.col("kind") == arg
        case "signal":
            return (F.col("kind") == "Signal") & (F.col("event_type") == arg)
        case "and":
            return all_of([event_filter(x) for x in arg])
        case "or":
            return any_of([event_filter(x) for x in arg])
        case "not":
            return ~event_filter(arg)
    raise ValueError(f"unknown filter: {op}")


def property_predicate(tree: dict) -> Column:
    """A condition on a row's columns: exists, equals, greater, less (name and value), all, any (lists of conditions)."""
    ((op, arg),) = tree.items()
    match op:
        case "exists":
            return F.col(arg).isNotNull()
        case "equals":
            return F.coalesce(F.col(arg[0]) == F.lit(arg[1]), F.lit(False))
        case "greater":
            return F.coalesce(F.col(arg[0]) > arg[1], F.lit(False))
        case "less":
            return F.coalesce(F.col(arg[0]) < arg[1], F.lit(False))
        case "all":
            return all_of([property_predicate(x) for x in arg])
        case "any":
            return any_of([property_predicate(x) for x in arg])
    raise ValueError(f"unknown predicate: {op}")
