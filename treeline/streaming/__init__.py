"""Streams of plans. Data streams are no part of what this engine answers; a search gives its plans one by one, as they are found."""

from __future__ import annotations

from collections.abc import Iterator

from ..plans.cost import Evaluator, best, branch_and_bound
from ..plans.decompose import decompositions
from ..plans.hypergraph import Decomposition, Hypergraph

MODES = ("enum", "best", "bnb")


def stream(graph: Hypergraph, k: int, mode: str = "enum", evaluator: Evaluator | None = None, seconds: float | None = None, complete: bool = False, root_single_edge: bool = False) -> Iterator[Decomposition]:
    """enum: all trees as found; best and bnb: the cheapest, if there is one."""
    if mode not in MODES:
        raise ValueError(f"no search is called {mode}; there are {' and '.join(MODES)}")
    if mode == "enum":
        yield from decompositions(graph, k, seconds=seconds, complete=complete, root_single_edge=root_single_edge)
        return
    if evaluator is None:
        raise ValueError(f"mode {mode} needs statistics")
    if mode == "best":
        found = best(decompositions(graph, k, seconds=seconds, complete=complete, root_single_edge=root_single_edge), evaluator)
    else:
        found = branch_and_bound(graph, k, evaluator, seconds, root_single_edge, complete)
    if found is not None:
        yield found
