"""When to refresh, whether a cache may be used, how costly a query is, and how failure spreads."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

#: A view is due at this share of its freshness; a failed refresh waits longer each time; one that
#: is running is left alone for so long.
DUE_SHARE = (8, 10)
FIRST_WAIT_S, MOST_WAIT_S = 60, 6 * 3600
RUNNING_S = 75 * 60


@dataclass(frozen=True)
class Freshness:
    promised_s: int
    refreshed_at_s: int | None
    running_since_s: int | None = None
    failures: int = 0
    failed_at_s: int | None = None


def due(f: Freshness, now_s: int) -> tuple[bool, str]:
    if f.running_since_s is not None and now_s - f.running_since_s < RUNNING_S:
        return False, "running"
    if f.failures and f.failed_at_s is not None:
        wait = min(MOST_WAIT_S, FIRST_WAIT_S << min(f.failures - 1, 20))
        if now_s - f.failed_at_s < wait:
            return False, f"waits {wait} s after {f.failures} failures"
    if f.refreshed_at_s is None:
        return True, "never refreshed"
    age = now_s - f.refreshed_at_s
    return (age * DUE_SHARE[1] >= f.promised_s * DUE_SHARE[0]), f"{age} s old of {f.promised_s}"


@dataclass(frozen=True)
class Cached:
    rule: str
    topology: str
    complete: bool
    mark: int


def cache_verdict(c: Cached | None, rule: str, topology: str, least_mark: int) -> str:
    """hit, or why not, the gravest reason first."""
    if c is None:
        return "absent"
    if c.rule != rule:
        return "other_rule"
    if c.topology != topology:
        return "other_topology"
    if not c.complete:
        return "incomplete"
    return "stale" if c.mark < least_mark else "hit"


#: Bounds of the classes: light up to these bytes and rows, enormous above this memory.
LIGHT_BYTES, LIGHT_ROWS, GREAT_BYTES = 500_000_000, 50_000_000, 150_000_000_000
# Aggregates that hold all of a group's values at once.
HOLDING = ("mode", "histogram", "approx_quantile", "percentile", "collect_list", "collect_set", "median", "listagg", "string_agg", "array_agg")


@dataclass(frozen=True)
class Admission:
    klass: str  # L, G or E
    bytes: int
    rows: int | None
    holding: tuple[str, ...]


def admit(df: DataFrame) -> Admission:
    """A class by the optimizer's estimates: light, great, or extreme."""
    plan = df._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    size, rows = 0, 0
    for i in range(leaves.size()):
        stats = leaves.apply(i).stats()
        size += int(str(stats.sizeInBytes()))
        count = stats.rowCount()
        rows = rows + int(str(count.get())) if rows is not None and count.isDefined() else None
    text = plan.toString().lower()
    holding = tuple(sorted({h for h in HOLDING if f"{h}(" in text}))
    if size > GREAT_BYTES:
        klass = "E"
    elif size > LIGHT_BYTES or (rows or 0) > LIGHT_ROWS or (holding and size > LIGHT_BYTES // 10):
        klass = "G"
    else:
        klass = "L"
    return Admission(klass, size, rows, holding)


def path_is_safe(path: str) -> bool:
    """No step up, plain or percent-encoded any number of times."""
    from urllib.parse import unquote

    for _ in range(10):
        if ".." in path.replace("\\", "/").split("/"):
            return False
        decoded = unquote(path)
        if decoded == path:
            return True
        path = decoded
    return False


def health(edges: list[tuple[str, str]], own: dict[str, str]) -> dict[str, str]:
    """own: ok, warning or failed. What depends on a failed node is degraded, on any way down."""
    below: dict[str, set[str]] = {}
    for source, target in edges:
        below.setdefault(source, set()).add(target)
    out = dict(own)
    queue = [n for n, s in own.items() if s == "failed"]
    seen = set(queue)
    while queue:
        for t in below.get(queue.pop(), ()):
            if t not in seen:
                seen.add(t)
                if out.get(t, "ok") != "failed":
                    out[t] = "degraded"
                queue.append(t)
    return out
