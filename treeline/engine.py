"""From a query and its tables to answers."""

from __future__ import annotations

import dataclasses
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from .functions.stats import Statistics, collect_all
from .operators.relation import check_names
from .operators.yannakakis import Tree, Yannakakis
from .plans.cost import Evaluator
from .plans.hypergraph import Decomposition, Hypergraph, Node
from .plans.shrink import shrink as shrunk
from .sources.tables import stored
from .streaming import stream

#: Relative error of distinct counts that plans are chosen by.
ROUGHLY = 0.05


def statistics(tables: Mapping[str, DataFrame], approximate: float | None = None) -> dict[str, Statistics]:
    """One aggregation for each table, all in one job, and a row for each on the driver."""
    return collect_all(tables, approximate) if tables else {}


def check(graph: Hypergraph, tables: Mapping[str, DataFrame]) -> None:
    for e, variables in graph.edges.items():
        if e not in tables:
            raise KeyError(f"no table for {e}")
        check_names(tables[e].columns)
        if set(tables[e].columns) != set(variables):
            raise ValueError(f"{e} has columns {tables[e].columns}, not {list(variables)}")


def homes(root: Node, graph: Hypergraph) -> dict[int, set[str]]:
    """For each node (by id()) the atoms that count there: each atom in the first node that has it in its cover and within its bag."""
    out: dict[int, set[str]] = {}
    placed: set[str] = set()
    for n in root.nodes():
        own = {e for e in n.cover if graph.sets[e] <= n.bag and e not in placed}
        placed |= own
        out[id(n)] = own
    return out


def execution_tree(d: Decomposition, tables: Mapping[str, DataFrame]) -> Tree:
    """A node's relations: atoms at home there as they are, so that each atom's multiplicities count once in all; other atoms of
    the cover as distinct rows of what they share with the bag."""
    d = d.complete()
    home = homes(d.root, d.graph)

    def make(node: Node, name: str) -> Tree:
        parts = []
        for e in node.cover:
            if e in home[id(node)]:
                parts.append(tables[e].select(*d.graph.edges[e]))
            elif keep := [v for v in d.graph.edges[e] if v in node.bag]:
                parts.append(tables[e].select(*keep).distinct())
        return Tree(tuple(parts), tuple(make(c, f"{name}.{i}") for i, c in enumerate(node.children)), name)

    return make(d.root, "0")


@dataclasses.dataclass
class Query:
    """A conjunctive query over tables whose columns are named by its variables."""

    graph: Hypergraph
    tables: Mapping[str, DataFrame]
    width: int = 2
    mode: str = "best"
    shrink: str | None = None
    seconds: float | None = None
    complete: bool = False
    evaluator: Evaluator | None = None

    def __post_init__(self) -> None:
        if isinstance(self.graph, str):
            self.graph = Hypergraph.parse(self.graph)
        check(self.graph, self.tables)

    def costs(self) -> Evaluator:
        if self.evaluator is None:
            self.evaluator = Evaluator(statistics(self.tables, ROUGHLY))
        return self.evaluator

    def plan(self) -> Decomposition:
        found = next(stream(self.graph, self.width, self.mode, None if self.mode == "enum" else self.costs(), self.seconds, self.complete), None)
        if found is None:
            raise ValueError(f"no decomposition of width {self.width} was found")
        return shrunk(found, self.shrink) if self.shrink else found

    def evaluation(self, d: Decomposition | None = None, reduce: str = "none", store: bool = False) -> Yannakakis:
        keep = stored(next(iter(self.tables.values())).sparkSession) if store else None
        return Yannakakis(execution_tree(d or self.plan(), self.tables), reduce, keep)

    def answers(self, semantics: str = "bag", reduce: str = "none", columns: Sequence[str] | None = None, plan: Decomposition | None = None, store: bool = False) -> DataFrame:
        """bag: as often as a flat natural join has them; set: once. store: each reduction pass writes its nodes to the shared folder
        (spark.checkpoint.dir) now, rather than leave plans that repeat the passes below them."""
        if semantics not in ("bag", "set"):
            raise ValueError(f"semantics must be bag or set, not {semantics}")
        out = self.evaluation(plan, reduce, store).all_answers(columns)
        return out.distinct() if semantics == "set" else out

    def satisfiable(self) -> bool:
        return self.evaluation().bool_answer()
