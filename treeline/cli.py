"""python -m treeline.cli -graph FILE -width K ...: searches decompositions and prints them."""

from __future__ import annotations

import argparse
import time
from collections.abc import Sequence
from pathlib import Path

from .plans.cost import Evaluator
from .plans.export import to_gml
from .plans.hypergraph import Hypergraph
from .plans.shrink import MODES as SHRINKS
from .plans.shrink import shrink
from .sources.csv_files import load_database, load_statistics
from .streaming import MODES, stream


def arguments(argv: Sequence[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="treeline", description="Decompositions of a hypergraph")
    parser.add_argument("-graph", required=True, help="hypergraph file: edge(v1,v2,...), ... with a period at the end")
    parser.add_argument("-width", required=True, type=int, help="width to search for, at least 1")
    parser.add_argument("-mode", default="enum", choices=MODES)
    parser.add_argument("-gml", default="", help="write decomposition i to <gml>_<i>.gml")
    parser.add_argument("-enum", type=int, default=0, help="decompositions to put out (default: all)")
    parser.add_argument("-complete", action="store_true", help="force each edge into some cover")
    parser.add_argument("-shrink", default="", choices=("", *SHRINKS))
    parser.add_argument("-evaldb", default="", help="database file that costs come from")
    parser.add_argument("-evaljoin", default="", help="statistics file that costs come from")
    parser.add_argument("-timeout", type=int, default=0, help="milliseconds")
    args = parser.parse_args(argv)
    if args.width < 1:
        parser.error("width must be at least 1")
    if args.evaldb and args.evaljoin:
        parser.error("costs come from a database or from statistics, not from both")
    if args.mode != "enum" and not (args.evaldb or args.evaljoin):
        parser.error(f"-mode {args.mode} compares costs: give -evaldb or -evaljoin")
    return args


def evaluator(args: argparse.Namespace, graph: Hypergraph) -> Evaluator | None:
    if not (args.evaldb or args.evaljoin):
        return None
    from pyspark.sql import SparkSession

    from .functions.stats import collect

    spark = SparkSession.builder.getOrCreate()
    if args.evaljoin:
        return Evaluator(*load_statistics(spark, args.evaljoin, graph))
    tables = load_database(spark, args.evaldb)
    if unknown := sorted(set(tables) - set(graph.edges)):
        raise ValueError(f"tables that the hypergraph lacks: {', '.join(unknown)}")
    return Evaluator({e: collect(df, histograms=True) for e, df in tables.items()})


def main(argv: Sequence[str] | None = None) -> int:
    args = arguments(argv)
    graph = Hypergraph.parse(Path(args.graph).read_text())
    costs = evaluator(args, graph)
    print("Starting search...")
    names = {"enum": "EnumDetK", "best": "BestDetK", "bnb": "BnbDetK"}
    spent, made = [], 0
    began = time.monotonic()
    for d in stream(graph, args.width, args.mode, costs, args.timeout / 1000 if args.timeout else None, args.complete):
        spent.append(time.monotonic() - began)
        if args.shrink:
            d = shrink(d, args.shrink)
        if problems := d.problems():
            raise RuntimeError(f"wrong decomposition: {'; '.join(problems)}")
        print(f"Used algorithm: {names[args.mode]}\nResult {made} (ran with K = {args.width})\n{d}\nTime: {1000 * sum(spent):.0f} ms\n\nWidth: {d.width()}")
        if costs:
            print("Cost:", round(costs.cost(d)))
        print("Correct: True\n")
        if args.gml:
            Path(f"{args.gml}_{made}.gml").write_text(to_gml(d))
        made += 1
        if made == args.enum:
            break
        began = time.monotonic()
    print(f"Search ended in {1000 * sum(spent):.0f} ms.\n{made} decompositions were found.")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
