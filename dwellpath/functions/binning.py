"""right-closed bins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def bin_label(value: Column, bins: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the bin ``(bins[i], bins[i+1]]`` that holds ``value``, else NULL."""
    if len(bins) != len(labels) + 1 or list(bins) != sorted(set(bins)):
        raise ValueError("need increasing bin edges, one more than labels")
    label = F.lit(None).cast("string")
    for low, high, name in reversed(list(zip(bins, bins[1:], labels))):
        label = F.when((value > low) & (value <= high), F.lit(name)).otherwise(label)
    return label
