"""Source filters of rules and the scope of a search under them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ascii_lower

PREFIX = "source:"
MAX_FILTERS = 100
UUID_RE = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def _bare(value: Column) -> Column:
    """A filter without blanks, prefix and the other spellings of a UUID (no hyphens, braces, urn)."""
    text = ascii_lower(F.regexp_replace(F.regexp_replace(value, r"(?U)^\s+|\s+$", ""), f"^{PREFIX}", ""))
    text = F.regexp_replace(text, r"^urn:uuid:|^\{(?=.*\}$)|(?<=^\{.{36})\}$", "")
    return F.regexp_replace(text, r"^([0-9a-f]{8})([0-9a-f]{4})([0-9a-f]{4})([0-9a-f]{4})([0-9a-f]{12})$", "$1-$2-$3-$4-$5")


def filter_ids(filters: Column) -> Column:
    """Sorted distinct source ids of a filter list; null if a filter is malformed or there are too many."""
    ids = F.transform(filters, _bare)
    good = F.forall(ids, lambda x: F.coalesce(x.rlike(UUID_RE), F.lit(False))) & (F.size(filters) <= MAX_FILTERS)
    return F.when(good, F.array_sort(F.array_distinct(ids)))


def filter_error(filters: Column) -> Column:
    """Why a filter list is refused, null if it is not. The offending value is not repeated."""
    return F.when(F.size(filters) > MAX_FILTERS, "too_many_rule_filters").when(
        filter_ids(filters).isNull(), "invalid_rule_filter"
    )


def normalize_filters(filters: Column) -> Column:
    return F.transform(filter_ids(filters), lambda x: F.concat(F.lit(PREFIX), x))


def admits(filters: Column, source_id: Column) -> Column:
    """Whether a rule with these normalised filters sees a source: no filter sees all."""
    return (F.size(filters) == 0) | F.array_contains(filters, F.concat(F.lit(PREFIX), source_id))


def constrain(rule_ids: Column, requested: Column) -> Column:
    """Sources that a search under a rule reads; null if it asks for one outside the rule's.

    Without rule sources the request stands, without a request the rule's do.
    """
    clean = lambda c: F.array_sort(F.array_distinct(c))
    return (
        F.when(F.size(rule_ids) == 0, clean(requested))
        .when(F.size(requested) == 0, clean(rule_ids))
        .when(F.size(F.array_except(requested, rule_ids)) == 0, clean(requested))
    )
