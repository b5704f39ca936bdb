"""Graph patterns: nodes with properties, edges between them, and filters."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions import terms
from lattica.functions.terms import CODE, RDF_TYPE
from lattica.graph import Graph
from lattica.plans import algebra as A
from lattica.plans.compiler import Compiler


@dataclass
class GraphPattern:
    """``nodes`` are property maps (``type`` is the class), ``edges`` have source_index, target_index and relationship."""

    nodes: list[dict] = field(default_factory=list)
    edges: list[dict] = field(default_factory=list)
    filters: dict[str, str] = field(default_factory=dict)


def algebra_of(pattern: GraphPattern) -> A.Select:
    """The pattern as a query over ``?node0``, ``?node1`` ...; a filter with ``*`` is a wildcard, else equality."""
    group = A.Group()

    def code(local: str) -> A.Term:
        return A.Term(f"<{CODE}{local}>")

    for k, node in enumerate(pattern.nodes):
        var = A.Var(f"node{k}")
        for name, value in node.items():
            if name == "type":
                group.parts.append(A.Triple(var, A.Term(RDF_TYPE), code(value)))
            else:
                group.parts.append(A.Triple(var, code(name), A.Term(terms.literal(value))))
    for edge in pattern.edges:
        ends = [A.Var(f"node{edge.get(name, default)}") for name, default in (("source_index", 0), ("target_index", 1))]
        group.parts.append(A.Triple(ends[0], code(edge.get("relationship", "related")), ends[1]))
    for name, value in pattern.filters.items():
        var = A.Var(name.lstrip("?"))
        if "*" in value:
            text = "^" + ".*".join(map(re.escape, value.split("*"))) + "$"
            group.parts.append(A.Filter(A.Call("REGEX", (A.Call("STR", (var,)), A.Term(f'"{text}"'), A.Term('"i"')))))
        else:
            group.parts.append(A.Filter(A.Call("=", (A.Call("STR", (var,)), A.Term(f'"{value}"')))))
    return A.Select("select", group, star=True)


def match(graph: Graph, pattern: GraphPattern) -> DataFrame:
    return Compiler(graph).run(algebra_of(pattern))


def match_property_graph(vertices: DataFrame, edges: DataFrame, pattern: GraphPattern) -> DataFrame:
    """Vertices that satisfy the first node's constraints and have, over each of its edges, a neighbour that satisfies its own.

    A neighbour's own edges are constraints of it in turn, so the edges must
    form a tree.  Of the neighbours over an edge of the first node one is shown,
    the smallest by id, as ``target_<type>`` (or the relationship's name).
    """
    ends = [(edge.get("source_index", 0), edge.get("target_index", 1)) for edge in pattern.edges]

    def constraints(k: int) -> dict:
        return pattern.nodes[k] if k < len(pattern.nodes) else {}

    def fitting(k: int, over: int | None, above: frozenset[int], shown: bool) -> DataFrame:
        """Vertices that can stand for node ``k``, which edge ``over`` leads to."""
        found = vertices
        for name, value in constraints(k).items():
            own = F.col(name) if name in vertices.columns else F.col("attrs")[name]
            found = found.where(own == F.lit(value) if name == "line_number" else own == F.lit(str(value)))
        for e, edge in enumerate(pattern.edges):
            if e == over or k not in ends[e]:
                continue
            forth = ends[e][0] == k
            far = ends[e][1] if forth else ends[e][0]
            if far in above or far == k:
                raise ValueError("the edges of the pattern form a cycle")
            kind = edge.get("relationship", "related")
            near, other = ("src", "dst") if forth else ("dst", "src")
            reached = edges.where((F.col("relationship") == kind) | (F.col("type") == kind)).select(F.col(near).alias("id"), F.col(other).alias("far"))
            if constraints(far) or any(far in pair for n, pair in enumerate(ends) if n != e):
                reached = reached.join(fitting(far, e, above | {k}, False).select(F.col("id").alias("far")), "far", "left_semi")
            if not shown:
                found = found.join(reached, "id", "left_semi")
                continue
            name = f"target_{constraints(far).get('type') or kind}"
            name = name if name not in found.columns else f"{name}_{e}"
            found = found.join(reached.groupBy("id").agg(F.min("far").alias(name)), "id")
        return found

    return fitting(0, None, frozenset(), True)
