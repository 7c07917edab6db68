"""Run variants of one query, check that all give the first one's rows, and record times."""

from __future__ import annotations

import csv
import io
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.stats import data_properties


def fingerprint(df: DataFrame) -> tuple:
    """Row count and an order-free sum of row hashes; columns by name. One aggregate, nothing collected."""
    columns = [F.col(f"`{c}`") for c in sorted(df.columns)]
    row = df.select(F.xxhash64(*columns).alias("h")).agg(F.count("*"), F.sum(F.col("h").cast("decimal(38,0)"))).first()
    return tuple(sorted(df.columns)), row[0], row[1]


def equal(a: DataFrame, b: DataFrame) -> bool:
    """Same columns and same rows with the same counts, in any order; exact."""
    if sorted(a.columns) != sorted(b.columns):
        return False
    b = b.select(*a.columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


@dataclass
class Monitor:
    """Times and properties by name."""

    rows: list[dict] = field(default_factory=list)

    def interval(self, name: str, work: Callable[[], object]) -> object:
        began = time.perf_counter()
        result = work()
        self.rows.append({"name": name, "kind": "interval_us", "value": int((time.perf_counter() - began) * 1e6)})
        return result

    def add(self, name: str, value: bool | int | float) -> None:
        self.rows.append({"name": name, "kind": type(value).__name__, "value": value})

    def column(self, name: str, column: DataFrame) -> None:
        """The properties of a column's data, one row each."""
        found = data_properties(column)
        for key in ("count", "least", "greatest", "sorted_ascending", "distinct", "unique"):
            self.add(f"{name}.{key}", getattr(found, key))
        for width, n in sorted(found.histogram.items()):
            self.add(f"{name}.bits_{width}", n)

    def text(self) -> str:
        return "\n".join(f"{r['name']}: {r['value']} ({r['kind']})" for r in self.rows)

    def csv(self) -> str:
        out = io.StringIO()
        writer = csv.DictWriter(out, ["name", "kind", "value"])
        writer.writeheader()
        writer.writerows(self.rows)
        return out.getvalue()


#: What ``run_variants`` says of a variant.
GOOD, NOT_CHECKED, BAD = 1, 0, -1


def run_variants(variants: dict[str, Callable[[], DataFrame]], monitor: Monitor | None = None, check: bool = True) -> dict[str, int]:
    """{name: GOOD, BAD or NOT_CHECKED}; the first variant is the reference of the others."""
    monitor = monitor or Monitor()
    results: dict[str, int] = {}
    expected = None
    for name, variant in variants.items():
        found = monitor.interval(name, lambda v=variant: fingerprint(v()))
        expected = expected or found
        results[name] = NOT_CHECKED if not check else GOOD if found == expected else BAD
    return results
