"""What an event counts for."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.schemas import EVENT_WEIGHTS


def event_weight(event_type: Column, weight: Column) -> Column:
    """A positive stored weight, else the type's, else 1."""
    table = F.create_map(*map(F.lit, chain(*EVENT_WEIGHTS.items())))
    return F.when(weight > 0, weight).otherwise(F.coalesce(F.try_element_at(table, event_type), F.lit(1.0)))


def recency_decay(timestamp: Column, reference: Column, halflife_days: float) -> Column:
    """Half as much for every halflife of age; the future counts as now."""
    age = (F.unix_micros(reference) - F.unix_micros(timestamp)) / 86400e6
    return F.pow(F.lit(0.5), F.greatest(age, F.lit(0.0)) / max(halflife_days, 1e-6))
