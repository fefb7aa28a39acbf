"""Labels of brain regions: hemisphere by first letter, region by the rest."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def side_of(label: Column) -> Column:
    return F.when(label.startswith("l"), "left").when(label.startswith("r"), "right").otherwise("none")


def base_code(label: Column) -> Column:
    """The label without its hemisphere's letter."""
    return F.when(label.startswith("l") | label.startswith("r"), F.substring(label, 2, 1_000)).otherwise(label)
