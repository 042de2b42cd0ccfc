"""Reading executed plans."""

from __future__ import annotations

from collections.abc import Iterator


def nodes(frame) -> Iterator:
    """Nodes of the executed plan, subqueries included, a reused part only once."""
    frame.collect()
    yield from _walk(frame._jdf.queryExecution().executedPlan(), set())


def scans(frame, *columns: str) -> int:
    """Number of file scans that read all of the given columns."""
    found = 0
    for node in nodes(frame):
        if node.nodeName().startswith("Scan parquet"):
            found += set(columns) <= set(node.requiredSchema().fieldNames())
    return found


def scanned_tables(frame) -> dict[str, int]:
    """Number of scans of each stored table."""
    found: dict[str, int] = {}
    for node in nodes(frame):
        if node.nodeName().startswith("Scan parquet"):
            table = node.relation().location().rootPaths().head().getName()
            found[table] = found.get(table, 0) + 1
    return found


def final_text(frame) -> str:
    """The executed plan without the plans it started from."""
    return "\n".join(node.simpleString(200) for node in nodes(frame))


def _walk(node, seen):
    """Each node once. A reused part leads to its original, which may lie in a subquery the walk does not reach."""
    name = node.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        yield from _walk(node.executedPlan(), seen)
        return
    if name in ("ReusedExchangeExec", "ReusedSubqueryExec"):
        yield from _walk(node.child(), seen)
        return
    if name.endswith("QueryStageExec"):  # their ids start anew in every subquery
        yield from _walk(node.plan(), seen)
        return
    if node.id() in seen:
        return
    seen.add(node.id())
    yield node
    children = node.children()
    for position in range(children.size()):
        yield from _walk(children.apply(position), seen)
    subqueries = node.subqueries()
    for position in range(subqueries.size()):
        yield from _walk(subqueries.apply(position), seen)
