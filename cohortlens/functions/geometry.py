"""Distances between internal points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def planar_distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Euclidean distance in coordinate units (degrees for latitude / longitude)."""
    dx, dy = x1 - x2, y1 - y2
    return F.sqrt(dx * dx + dy * dy)
