"""Decompositions as GML text and as rows of a plan table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from .hypergraph import Decomposition, Node

PLAN = "decomp_id int, node_id int, parent_id int, bag string, cover string"


def numbered(root: Node) -> list[tuple[int, int | None, Node]]:
    out: list[tuple[int, int | None, Node]] = []

    def walk(node: Node, parent: int | None) -> None:
        own = len(out)
        out.append((own, parent, node))
        for c in node.children:
            walk(c, own)

    walk(root, None)
    return out


def to_gml(d: Decomposition) -> str:
    quote = lambda xs: ", ".join(xs).replace('"', "'")
    lines = ["graph [", "  directed 0"]
    rows = numbered(d.root)
    for i, _, node in rows:
        lines.append(f'  node [ id {i} label "{{{quote(node.cover)}}} {{{quote(sorted(node.bag))}}}" ]')
    lines += [f"  edge [ source {p} target {i} ]" for i, p, _ in rows if p is not None]
    return "\n".join([*lines, "]", ""])


def plan_rows(trees: Iterable[Decomposition]) -> list[tuple]:
    return [(k, i, -1 if p is None else p, ",".join(sorted(n.bag)), ",".join(sorted(n.cover))) for k, d in enumerate(trees) for i, p, n in numbered(d.root)]


def plan_table(spark: SparkSession, trees: Iterable[Decomposition]) -> DataFrame:
    """A row for each node: decomp_id, node_id (parents first), parent_id (-1 at the root), bag, cover."""
    return spark.createDataFrame(plan_rows(trees), PLAN)
