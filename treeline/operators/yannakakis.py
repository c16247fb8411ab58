"""Yannakakis' algorithm over a tree of relations.

Every phase gives a new tree of lazy DataFrames, so nothing runs before the caller's action, and Catalyst sees the whole plan.
A pass refers to what the pass before made, so lazy plans repeat the work below each node; keep= (a function that stores a
DataFrame and gives it back as stored) makes every node's rows once in each pass, and ends where a node is empty.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .relation import common, join_all, natural_join, semijoin


@dataclasses.dataclass(frozen=True)
class Tree:
    """A node's relations, or their join once it is computed, and its children."""

    relations: tuple[DataFrame, ...]
    children: tuple[Tree, ...] = ()
    name: str = ""

    @property
    def joined(self) -> DataFrame:
        if len(self.relations) != 1:
            raise ValueError("the node's relations aren't joined yet")
        return self.relations[0]

    def nodes(self) -> Iterator[Tree]:
        """Parents first, left to right."""
        yield self
        for c in self.children:
            yield from c.nodes()

    def map(self, change: Callable[[DataFrame], DataFrame]) -> Tree:
        return Tree(tuple(map(change, self.relations)), tuple(c.map(change) for c in self.children), self.name)

    def named(self) -> dict[str, DataFrame]:
        return {n.name: n.joined for n in self.nodes()}


def tree(name: str, relations: DataFrame | Sequence[DataFrame], *children: Tree) -> Tree:
    own = (relations,) if isinstance(relations, DataFrame) else tuple(relations)
    return Tree(own, children, name)


def compute_nodes(root: Tree) -> Tree:
    """Each node's relations joined."""
    return Tree((join_all(root.relations),), tuple(map(compute_nodes, root.children)), root.name)


Keep = Callable[[DataFrame], DataFrame]


def _lazy(df: DataFrame) -> DataFrame:
    return df


def reduce_up(root: Tree, keep: Keep = _lazy) -> Tree:
    """Children first: each parent semijoined with its reduced children."""
    children = tuple(reduce_up(c, keep) for c in root.children)
    own = root.joined
    for c in children:
        own = semijoin(own, c.joined)
    return Tree((keep(own),), children, root.name)


def reduce_down(root: Tree, keep: Keep = _lazy) -> Tree:
    """Parents first, after reduce_up: each child semijoined with its reduced parent."""
    children = tuple(reduce_down(Tree((keep(semijoin(c.joined, root.joined)),), c.children, c.name), keep) for c in root.children)
    return Tree(root.relations, children, root.name)


def join_up(root: Tree) -> DataFrame:
    """Each subtree's answers joined into its parent's."""
    own = root.joined
    for c in root.children:
        own = natural_join(own, join_up(c))
    return own


def apart(root: Tree) -> Iterator[Tree]:
    """Nodes that share no attribute with their parent: their emptiness doesn't show in a semijoin."""
    for c in root.children:
        if not common(root.joined, c.joined):
            yield c
        yield from apart(c)


class Yannakakis:
    """reduce: "none", "up" or "full". Semijoin passes pay off where they filter much; without them the joins alone give
    the same answers."""

    def __init__(self, root: Tree, reduce: str = "full", keep: Keep | None = None) -> None:
        if reduce not in ("none", "up", "full"):
            raise ValueError(f"reduce must be none, up or full, not {reduce}")
        self.root, self.mode, self.keep = compute_nodes(root), reduce, keep

    def reduced(self) -> Tree:
        return reduce_up(self.root, self.keep or _lazy)

    def fully_reduced(self) -> Tree:
        up = self.reduced()
        if self.keep and up.joined.isEmpty():  # nothing is left to reduce below an empty root
            return up
        return reduce_down(up, self.keep or _lazy)

    def bool_answer(self) -> bool:
        """Whether there is an answer: one job for the reduced root, and one for each node that shares nothing with its parent."""
        reduced = self.reduced()
        return not reduced.joined.isEmpty() and not any(n.joined.isEmpty() for n in apart(reduced))

    def satisfiable(self) -> DataFrame:
        """The same as one row (satisfiable boolean), in one lazy plan."""
        reduced = self.reduced()
        parts = [reduced, *apart(reduced)]
        counts = [p.joined.limit(1).agg((F.count(F.lit(1)) > 0).alias(f"s{i}")) for i, p in enumerate(parts)]
        out = counts[0]
        for c in counts[1:]:
            out = out.crossJoin(c)  # of single rows
        whole = F.lit(True)
        for i in range(len(parts)):
            whole = whole & F.col(f"s{i}")
        return out.select(whole.alias("satisfiable"))

    def all_answers(self, columns: Sequence[str] | None = None) -> DataFrame:
        """All answers, columns sorted by name unless given; no rows where there is none."""
        root = {"none": lambda: self.root, "up": self.reduced, "full": self.fully_reduced}[self.mode]()
        if self.keep and self.mode != "none" and root.joined.isEmpty():  # the joins' columns, of no rows, and none of the joins
            spark = root.joined.sparkSession
            root = root.map(lambda df: spark.createDataFrame([], df.schema))
        out = join_up(root)
        return out.select(*(columns or sorted(out.columns)))
