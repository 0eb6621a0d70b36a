"""Label columns: canonical spelling, grouping, ordering."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings of event types and the canonical label of each.
ALIASES = {"tild": "tilda", "tilda": "tilda", "half_mnt": "half-mnt", "half-mnt": "half-mnt", "dfm_stack_dense_stack": "dfm-stack", "dfm_stack": "dfm-stack", "dfm-stack": "dfm-stack"}


def mapped(label: Column, mapping: Mapping[str, str]) -> Column:
    """mapping[label], or the label itself where the mapping has none."""
    if not mapping:
        return label
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.coalesce(F.try_element_at(table, label), label)


def cleaned(label: Column) -> Column:
    """Text without white space around it, in lower case."""
    return F.lower(F.trim(label.cast("string")))


def canonical(label: Column, aliases: Mapping[str, str] = ALIASES, null_as: str | None = None) -> Column:
    """The canonical label; null_as is what a missing label counts as (none: it stays null)."""
    out = mapped(cleaned(label), aliases)
    return out if null_as is None else F.coalesce(out, F.lit(null_as))


def grouped(label: Column, groups: Mapping[str, str]) -> Column:
    """Labels merged into groups; labels outside of any stay."""
    return mapped(label, groups)


def effective_order(order: Iterable[str], groups: Mapping[str, str]) -> list[str]:
    """The order of groups that an order of labels induces: at the first member, once."""
    return list(dict.fromkeys(groups.get(x, x) for x in order))


def location(channel: Column, places: Mapping[int, str]) -> Column:
    """The place of a channel; null where unknown."""
    table = F.create_map(*[F.lit(x) for pair in places.items() for x in pair])
    return F.try_element_at(table, channel.cast("int"))


def channel_of(place: Column, places: Mapping[int, str]) -> Column:
    """The channel of a place as a nullable long."""
    table = F.create_map(*[F.lit(x) for k, v in places.items() for x in (v, k)])
    return F.try_element_at(table, place).cast("long")
