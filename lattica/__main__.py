"""``python -m lattica FOLDER [--query TEXT | --ask SENTENCE] [--save FOLDER]``: build a graph and query it."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from lattica.api import build, create_engine, create_store


def main() -> None:
    parser = argparse.ArgumentParser(prog="lattica", description="Build a graph from source files and query it.")
    parser.add_argument("folder")
    parser.add_argument("--query", help="SPARQL text")
    parser.add_argument("--ask", help="a sentence")
    parser.add_argument("--save", help="folder for a snapshot")
    args = parser.parse_args()
    spark = SparkSession.builder.appName("lattica").getOrCreate()
    graph = build(spark, args.folder)
    print(json.dumps(graph.statistics, indent=2))
    engine = create_engine(graph)
    result = engine.sparql(args.query) if args.query else engine.ask_sentence(args.ask) if args.ask else None
    if result is not None:
        if not result.success:
            raise SystemExit(result.error)
        if result.df is not None:
            result.df.show(50, truncate=False)
    if args.save:
        store = create_store(spark, args.save)
        store.add(graph.triples)
        print(store.save())


if __name__ == "__main__":
    main()
