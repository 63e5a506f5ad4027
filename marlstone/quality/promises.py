"""Promises about a table: metrics in one aggregation, thresholds, verdicts, and what they block."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METRICS = (
    "rowCount", "rowCountChange", "nullValues", "missingValues", "invalidValues", "duplicateValues",
    "itemCount", "itemCountChange", "emptyItems", "invalidFormats", "invalidSizes", "duplicateItems", "lostItems", "notEmptied",
)
# Comparators, each with the number of bounds it takes.
COMPARATORS = {
    "mustBe": 1, "mustNotBe": 1, "mustBeGreaterThan": 1, "mustBeGreaterOrEqualTo": 1, "mustBeLessThan": 1,
    "mustBeLessOrEqualTo": 1, "mustBeBetween": 2, "mustNotBeBetween": 2,
}


@dataclass(frozen=True)
class Promise:
    """metric of a column (or columns, for duplicates) compared with bounds, as a count or a percentage
    of rows. args: valid values, a closed range, a pattern, missing markers, formats, or sizes."""

    metric: str
    comparator: str
    bounds: tuple
    columns: tuple[str, ...] = ()
    unit: str = "count"
    severity: str = "error"
    values: tuple = ()
    between: tuple | None = None
    pattern: str | None = None

    def __post_init__(self):
        if self.metric not in METRICS or self.comparator not in COMPARATORS:
            raise ValueError(f"unknown metric or comparator: {self.metric} {self.comparator}")
        if len(self.bounds) != COMPARATORS[self.comparator]:
            raise ValueError(f"{self.comparator} takes {COMPARATORS[self.comparator]} bounds")
        if self.unit not in ("count", "percent") or self.severity not in ("error", "warning"):
            raise ValueError("unit is count or percent, severity error or warning")


@dataclass(frozen=True)
class Verdict:
    promise: Promise
    value: object
    outcome: str  # pass, fail, unknown


def holds(comparator: str, value, bounds) -> bool:
    a = bounds[0]
    match comparator:
        case "mustBe":
            return value == a
        case "mustNotBe":
            return value != a
        case "mustBeGreaterThan":
            return value > a
        case "mustBeGreaterOrEqualTo":
            return value >= a
        case "mustBeLessThan":
            return value < a
        case "mustBeLessOrEqualTo":
            return value <= a
        case "mustBeBetween":
            return a <= value <= bounds[1]
        case "mustNotBeBetween":
            return not a <= value <= bounds[1]
    raise ValueError(comparator)


def _bad(p: Promise, schema) -> F.Column:
    """Whether a row counts against the promise."""
    c = F.col(f"`{p.columns[0]}`")
    if p.metric == "nullValues":
        return c.isNull()
    if p.metric == "missingValues":
        return c.isNull() | c.cast("string").isin(*[str(v) for v in p.values])
    ok = F.lit(True)
    if p.values:  # equal as text or as numbers
        numbers = [Decimal(str(v)) for v in p.values if str(v).lstrip("-").replace(".", "", 1).isdigit()]
        ok = c.cast("string").isin(*[str(v) for v in p.values])
        if numbers:
            ok = ok | F.coalesce(c.try_cast("decimal(38,10)").isin(*numbers), F.lit(False))
    if p.between:
        ok = ok & (c >= F.lit(p.between[0])) & (c <= F.lit(p.between[1]))
    if p.pattern:
        ok = ok & c.cast("string").rlike(f"^(?:{p.pattern})$")
    return c.isNotNull() & ~F.coalesce(ok, F.lit(False))


def measure(df: DataFrame, promises: list[Promise], before: dict[str, int] | None = None) -> dict[Promise, object]:
    """All metrics of a table by one pass, and one more for each set of columns with duplicates.
    before: rowCount (and itemCount) of the last published version."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, p in enumerate(promises):
        if p.metric in ("nullValues", "missingValues", "invalidValues"):
            aggs.append(F.count_if(_bad(p, df.schema)).alias(f"m{i}"))
        elif p.metric == "emptyItems":
            aggs.append(F.count_if(F.coalesce(F.col("size"), F.lit(0)) == 0).alias(f"m{i}"))
        elif p.metric == "invalidFormats":
            aggs.append(F.count_if(~F.lower(F.coalesce("format", F.lit(""))).isin(*[str(v).lower() for v in p.values])).alias(f"m{i}"))
        elif p.metric == "invalidSizes":
            aggs.append(F.count_if(~F.coalesce(F.col("size").between(*p.between), F.lit(False))).alias(f"m{i}"))
    row = df.agg(*aggs).first()
    out: dict[Promise, object] = {}
    for i, p in enumerate(promises):
        match p.metric:
            case "rowCount" | "itemCount":
                value = row["n"]
            case "rowCountChange" | "itemCountChange":
                old = (before or {}).get(p.metric.removesuffix("Change"))
                value = None if old is None else row["n"] - old if p.unit == "count" else Decimal(100 * (row["n"] - old)) / old if old else None
            case "notEmptied":
                old = (before or {}).get("rowCount")
                value = 0 if row["n"] or not old else old
            case "lostItems":
                value = max(0, before["itemCount"] - row["n"]) if before and "itemCount" in before else None
            case "duplicateValues" | "duplicateItems":
                cols = list(p.columns or ("digest",))
                full = df.filter(" and ".join(f"`{c}` is not null" for c in cols))
                groups = full.groupBy(*cols).agg(F.count(F.lit(1)).alias("__k")).agg(F.sum(F.col("__k") - 1)).first()[0]
                value = groups or 0
            case _:
                value = row[f"m{i}"]
        if p.unit == "percent" and not p.metric.endswith("Change") and value is not None:
            value = Decimal(100 * value) / row["n"] if row["n"] else Decimal(0)
        out[p] = value
    return out


#: Holds for every table: one that had rows must not come out empty.
NOT_EMPTIED = Promise("notEmptied", "mustBe", (0,))


def judge(df: DataFrame, promises: list[Promise], before: dict[str, int] | None = None) -> tuple[list[Verdict], bool]:
    """Verdicts, and whether the version may be published: no promise of severity error fails."""
    every = [*promises, NOT_EMPTIED]
    values = measure(df, every, before)
    verdicts = [Verdict(p, values[p], "unknown" if values[p] is None else "pass" if holds(p.comparator, values[p], p.bounds) else "fail") for p in every]
    return verdicts, not any(v.outcome == "fail" and v.promise.severity == "error" for v in verdicts)
