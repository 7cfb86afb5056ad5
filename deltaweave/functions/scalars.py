"""Column expressions and small helpers used across the engine."""

from __future__ import annotations

import os

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Open end of a version's lifetime.
OPEN = 9223372036854775807
#: Degree classes of the staircase counters. Fixed values.
STAIRS = (2, 3, 4, 5, 6, 8, 12, 16)


def canonical(u: Column, v: Column, directed: bool) -> tuple[Column, Column]:
    """The two ends under which an edge is identified."""
    return (u, v) if directed else (F.least(u, v), F.greatest(u, v))


def edge_hash(u: Column, v: Column) -> Column:
    """Summand of a snapshot's fingerprint; stays far from overflow and has an exact SQL twin."""
    return (u % 1000003 * 1000003 + v % 1000003) % 2147483647


def stair_class(degree: Column) -> Column:
    """Number of thresholds that a degree reaches."""
    return sum((F.when(degree >= t, 1).otherwise(0) for t in STAIRS), F.lit(0))


def visible(theta: Column, ins: Column, del_: Column) -> Column:
    return (ins <= theta) & (theta < del_)


def alive_within(lo: Column, hi: Column, ins: Column, del_: Column) -> Column:
    """Alive at some time of [lo, hi]."""
    return (ins <= hi) & (del_ > lo)


def dir_name(path: str) -> str:
    return os.path.basename(os.path.dirname(os.path.abspath(path)))


def base_name(path: str) -> str:
    return os.path.basename(path)


def short_path(path: str) -> str:
    """The last folder and the file."""
    return "/".join(os.path.normpath(path).split(os.sep)[-2:])


def dataset_name(graph_path: str, name: str | None = None) -> str:
    return name or dir_name(graph_path)
