"""Compilation of the algebra to DataFrame plans.

Every variable is one column of term strings.  Basic patterns are ordered
greedily (most constants first, then what is connected to bound variables), so
no order of writing gives a cartesian product; patterns with one subject over
one table collapse to one scan.  Joins on variables that are surely bound are
plain equi-joins; where OPTIONAL or UNION may leave a shared variable unbound,
compatibility is spelled out.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.functions import terms
from lattica.functions.staging import stage
from lattica.functions.terms import XSD
from lattica.graph import Fixed, Graph, Key, apart
from lattica.graph import Value as FromColumn
from lattica.operators import paths
from lattica.plans import algebra as A
from lattica.plans.parser import QueryError, parse


def column_of(var: str) -> str:
    """The column of a variable; Spark's names ignore case, variables don't."""
    upper = sum(1 << k for k, c in enumerate(var) if c.isupper())
    name = "".join(c if c.isalnum() or c == "_" else f"${ord(c):x}" for c in var)
    return f"v_{name.lower()}" + (f"__{upper:x}" if upper else "")


def native_of(var: str) -> str:
    """The column that holds a variable's plain value beside its term."""
    return "n" + column_of(var)


@dataclass
class Solutions:
    """Rows of bindings; ``bound`` tells which variables have a value in every row.

    A variable read from a typed column keeps that column too (``native``, by
    kind), so that filters and arithmetic work on it and reach the scan.  One
    read from a key column keeps the key (kind ``key:`` and the IRIs' prefix):
    joins of two such variables compare keys, and patterns about it leave out
    tables whose keys have another prefix.
    """

    df: DataFrame
    bound: dict[str, bool] = field(default_factory=dict)
    native: dict[str, str] = field(default_factory=dict)

    def col(self, var: str) -> Column:
        return self.df[column_of(var)]

    def plain(self, var: str) -> Column:
        return self.df[native_of(var)]

    def value(self, var: str) -> Value:
        if var in self.native and not self.native[var].startswith("key:"):
            return Value(self.plain(var), self.native[var], self.col(var))
        return Value(self.col(var) if var in self.bound else F.lit(None).cast("string"), "term")

    def columns(self, without: set[str] = frozenset()) -> list[Column]:
        return [self.col(v) for v in self.bound if v not in without] + [self.plain(v) for v in self.native if v not in without]


@dataclass
class Value:
    """A compiled expression: kind is term, int, num, str, bool or time."""

    col: Column
    kind: str
    made: Column | None = None

    def term(self) -> Column:
        if self.made is not None:
            return self.made
        if self.kind == "term":
            return self.col
        local = {"int": "integer", "num": "double", "str": "string", "bool": "boolean", "time": "dateTime"}[self.kind]
        return terms.typed_term(self.col, local)

    def text(self) -> Column:
        return terms.lexical(self.col) if self.kind == "term" else self.col.cast("string")

    def number(self) -> Column:
        return terms.numeric(self.col) if self.kind == "term" else self.col if self.kind in ("int", "num") else F.lit(None).cast("double")

    def truth(self) -> Column:
        if self.kind == "bool":
            return self.col
        if self.kind == "term":
            return terms.boolean(self.col)
        return F.length(self.col) > 0 if self.kind == "str" else self.col != 0

    def time(self) -> Column:
        return self.col if self.kind == "time" else self.text().try_cast("timestamp")


def variables(x: object) -> set[str]:
    """The variables that an expression or group mentions."""
    if isinstance(x, A.Var):
        return {x.name}
    if isinstance(x, A.Call):
        return set().union(*map(variables, x.args)) if x.args else set()
    if isinstance(x, A.Aggregate):
        return variables(x.arg) if x.arg is not None else set()
    if isinstance(x, A.Exists):
        return variables(x.group)
    if isinstance(x, A.Group):
        return set().union(*map(variables, x.parts)) if x.parts else set()
    if isinstance(x, A.Triple):
        return variables(x.s) | variables(x.p) | variables(x.o)
    if isinstance(x, (A.Filter, A.Bind)):
        return variables(x.expr) | (variables(x.var) if isinstance(x, A.Bind) else set())
    if isinstance(x, (A.Optional_, A.Minus)):
        return variables(x.group)
    if isinstance(x, A.Union):
        return set().union(*map(variables, x.groups))
    if isinstance(x, A.Values):
        return {v.name for v in x.vars}
    return set()


class Compiler:
    def __init__(self, graph: Graph):
        self.graph = graph
        self.spark = graph.spark
        self._names = 0

    # Query forms.
    def run(self, q: A.Select) -> DataFrame:
        """The answer: decoded columns for SELECT and ASK, triples for the other forms."""
        if q.form == "ask":
            # One row is enough to tell.
            found = self.select(q).df.limit(1).agg(F.count(F.lit(1)).alias("n"))
            return found.select((F.col("n") > 0).cast("string").alias("result"))
        if q.form == "construct":
            return self._construct(q)
        if q.form == "describe":
            return self._describe(q)
        found, names = self.select(q), self._names_of(q)
        return found.df.select(*[terms.lexical(found.col(v)).alias(v) if v in found.bound else F.lit(None).cast("string").alias(v) for v in names])

    def _names_of(self, q: A.Select) -> list[str]:
        if q.star:
            return sorted(v for v in self._visible(q.where) if not v.startswith(" "))
        return [v.name for v, _ in q.items]

    def _visible(self, group: A.Group) -> set[str]:
        out: set[str] = set()
        for part in group.parts:
            if isinstance(part, A.SubSelect):
                out |= set(self._names_of(part.query))
            elif isinstance(part, A.Group):
                out |= self._visible(part)
            elif isinstance(part, A.Union):
                out |= set().union(*map(self._visible, part.groups))
            elif isinstance(part, A.Optional_):
                out |= self._visible(part.group)
            elif isinstance(part, A.Bind):
                out.add(part.var.name)
            elif not isinstance(part, (A.Filter, A.Minus)):
                out |= variables(part)
        return out

    def _construct(self, q: A.Select) -> DataFrame:
        found = self.select(q)
        out = []
        for t in q.template:
            columns = []
            for node, name in ((t.s, "s"), (t.p, "p"), (t.o, "o")):
                if isinstance(node, A.Term):
                    columns.append(F.lit(node.text).alias(name))
                elif node.name.startswith(" ") and node.name not in found.bound:
                    # A blank node of the template is a new one in every solution.
                    key = F.sha2(F.concat_ws("|", F.lit(node.name), *[found.col(v) for v in sorted(found.bound)]), 256)
                    columns.append(F.concat(F.lit("_:c"), F.substring(key, 1, 24)).alias(name))
                else:
                    columns.append(found.col(node.name).alias(name))
            out.append(found.df.select(*columns))
        if not out:
            return self.graph.scan().limit(0)
        triples = reduce(DataFrame.unionByName, out).where("s is not null and p is not null and o is not null")
        return triples.where("s not like '\"%' and p like '<%'").distinct()

    def _describe(self, q: A.Select) -> DataFrame:
        out = [self.graph.scan(s=t.text) for t in q.targets if isinstance(t, A.Term)]
        names = [t.name for t in q.targets if isinstance(t, A.Var)]
        if names:
            found = self.select(q)
            wanted = reduce(DataFrame.union, [found.df.select(found.col(v).alias("s")) for v in names]).distinct()
            out.append(self.graph.scan().join(wanted, "s", "left_semi"))
        return reduce(DataFrame.unionByName, out).distinct() if out else self.graph.scan().limit(0)

    def select(self, q: A.Select) -> Solutions:
        """The solutions of a query with its modifiers, before decoding."""
        found = self.group(q.where)
        grouped = bool(q.group_by) or any(_aggregates(e) for _, e in q.items if e is not None) or any(map(_aggregates, q.having))
        order = list(q.order_by)
        if grouped:
            found, items, order = self._grouped(q, found)
        else:
            items = q.items
        for var, expr in items:
            if expr is not None:
                found = self._extend(found, var.name, expr)
        def ordered(found: Solutions) -> Solutions:
            keys = [terms.sort_key(self.value(e, found).term()) for e, _ in order]
            return Solutions(found.df.orderBy(*[k.desc() if down else k.asc() for k, (_, down) in zip(keys, order, strict=True)]), found.bound, found.native)

        if order and not q.distinct:
            found = ordered(found)
        if q.form == "select":
            names = [v for v in self._names_of(q)]
            have = [v for v in dict.fromkeys(names) if v in found.bound]
            native = {} if q.distinct else {v: k for v, k in found.native.items() if v in have}
            found = Solutions(found.df.select(*[found.col(v) for v in have], *[found.plain(v) for v in native]), {v: found.bound[v] for v in have}, native)
            if q.distinct:
                found = Solutions(found.df.distinct(), found.bound)
                found = ordered(found) if order else found
        if q.offset:
            found = Solutions(found.df.offset(q.offset), found.bound, found.native)
        if q.limit is not None:
            found = Solutions(found.df.limit(q.limit), found.bound, found.native)
        return found

    def _grouped(self, q: A.Select, found: Solutions) -> tuple[Solutions, list, list]:
        keys: list[str] = []
        alias: dict[object, A.Var] = {}
        for expr, var in q.group_by:
            if isinstance(expr, A.Var):
                if expr.name in found.bound:
                    keys.append(expr.name)
                continue
            var = var or A.Var(f" g{len(keys)}")
            found = self._extend(found, var.name, expr)
            alias[expr] = var
            keys.append(var.name)
        made: dict[A.Aggregate, A.Var] = {}

        def lift(e: object) -> object:
            if isinstance(e, A.Aggregate):
                return made.setdefault(e, A.Var(f" a{len(made)}"))
            if e in alias:
                return alias[e]
            return A.Call(e.name, tuple(map(lift, e.args))) if isinstance(e, A.Call) else e

        defined = {v: e for v, e in q.items if e is not None}
        items = [(v, lift(e) if e is not None else None) for v, e in q.items]
        having = [lift(_substitute(e, defined)) for e in q.having]
        order = [(lift(_substitute(e, defined)), down) for e, down in q.order_by]
        columns = [self._aggregate(a, found).alias(column_of(v.name)) for a, v in made.items()]
        df = found.df.groupBy(*[found.col(k) for k in keys]).agg(*columns) if columns else found.df.select(*[found.col(k) for k in keys]).distinct()
        out = Solutions(df, {k: found.bound[k] for k in keys} | {v.name: a.name == "COUNT" for a, v in made.items()})
        for e in having:
            out = Solutions(out.df.where(self.value(e, out).truth()), out.bound, out.native)
        return out, items, order

    def _aggregate(self, a: A.Aggregate, found: Solutions) -> Column:
        """An aggregate's value as a term."""
        if a.name == "COUNT":
            if a.arg is None:
                every = [found.col(v) for v in sorted(found.bound)]
                n = F.count_distinct(F.struct(*every)) if a.distinct and every else F.count(F.lit(1))
            else:
                term = self.value(a.arg, found).term()
                n = F.count_distinct(term) if a.distinct else F.count(term)
            return terms.typed_term(n.cast("long"), "integer")
        value = self.value(a.arg, found)
        if a.name in ("SUM", "AVG"):
            number = value.number().cast("double")
            total = (F.sum_distinct(number) if a.distinct else F.sum(number)) if a.name == "SUM" else F.avg(number) if not a.distinct else F.sum_distinct(number) / F.count_distinct(number)
            total = F.coalesce(total, F.lit(0.0))
            whole = F.coalesce(F.bool_and(terms.suffix(value.term()) == f"^^<{XSD}integer>"), F.lit(True)) if a.name == "SUM" else F.lit(False)
            return F.when(whole, terms.typed_term(total.cast("long"), "integer")).otherwise(terms.typed_term(total, "double"))
        if a.name in ("MIN", "MAX"):
            pick = F.min if a.name == "MIN" else F.max
            term = value.term()
            return pick(F.when(term.isNotNull(), terms.sort_key(term)))["text"]
        if a.name == "SAMPLE":
            return F.min(value.term())
        texts = F.collect_set(value.text()) if a.distinct else F.collect_list(value.text())
        return terms.text_term(F.array_join(F.array_sort(texts), a.separator))

    def _extend(self, found: Solutions, var: str, expr: object) -> Solutions:
        value = self.value(expr, found)
        df, native = found.df.withColumn(column_of(var), value.term()), {v: k for v, k in found.native.items() if v != var}
        if value.kind in ("int", "num", "str"):
            df, native = df.withColumn(native_of(var), value.col), native | {var: value.kind}
        return Solutions(df, found.bound | {var: isinstance(expr, A.Term) or (isinstance(expr, A.Var) and found.bound.get(expr.name, False))}, native)

    # Graph patterns.
    def group(self, group: A.Group) -> Solutions:
        out: Solutions | None = None
        filters: list[object] = []
        pending: list[A.Triple] = []

        def flush() -> None:
            nonlocal out, pending
            if pending:
                out = self.basic(pending, out)
                pending = []

        for part in group.parts:
            if isinstance(part, A.Triple):
                pending.append(part)
                continue
            if isinstance(part, A.Filter):
                filters.append(part.expr)
                continue
            flush()
            here = out if out is not None else self.unit()
            if isinstance(part, A.Group):
                out = self.join(out, self.group(part))
            elif isinstance(part, A.SubSelect):
                out = self.join(out, self.select(part.query))
            elif isinstance(part, A.Union):
                out = self.join(out, self.union([self.group(g) for g in part.groups]))
            elif isinstance(part, A.Values):
                out = self.join(out, self.values(part))
            elif isinstance(part, A.Bind):
                out = self._extend(here, part.var.name, part.expr)
            elif isinstance(part, A.Minus):
                out = self.minus(here, self.group(part.group))
            elif isinstance(part, A.Optional_):
                own = [p.expr for p in part.group.parts if isinstance(p, A.Filter)]
                rest = A.Group([p for p in part.group.parts if not isinstance(p, A.Filter)])
                out = self.optional(here, self.group(rest), own)
        flush()
        out = out if out is not None else self.unit()
        for expr in filters:
            out = self.filter(out, expr)
        return out

    def unit(self) -> Solutions:
        """One solution without bindings."""
        return Solutions(self.spark.range(1).select(F.lit(1).alias("unit")), {})

    def filter(self, found: Solutions, expr: object) -> Solutions:
        if isinstance(expr, A.Call) and expr.name == "AND":
            return self.filter(self.filter(found, expr.args[0]), expr.args[1])
        if isinstance(expr, A.Exists):
            # Filters inside may speak of outer variables, so they join the condition.
            own = [p.expr for p in expr.group.parts if isinstance(p, A.Filter)]
            inner = self.group(A.Group([p for p in expr.group.parts if not isinstance(p, A.Filter)]))
            right, pairs = self._apart(found, inner)
            return Solutions(self._met(found, right, pairs, "left_anti" if expr.negated else "left_semi", own), found.bound, found.native)
        nested = _exists_in(expr)
        if nested:
            marked, names = found, {}
            for k, e in enumerate(nested):
                marked, names[id(e)] = self._marked(marked, e, f" e{k}")
            kept = self.filter(marked, _replaced(expr, names))
            return Solutions(kept.df.select(*[kept.df[c] for c in found.df.columns]), found.bound, found.native)
        return Solutions(found.df.where(self.value(expr, found).truth()), found.bound, found.native)

    def _marked(self, found: Solutions, e: A.Exists, name: str) -> tuple[Solutions, A.Var]:
        """``found`` with a variable that tells whether the group of ``e`` has a compatible solution."""
        inner = self.group(e.group)
        shared = [v for v in inner.bound if v in found.bound]
        if not shared or not all(inner.bound[v] and found.bound[v] for v in shared):
            raise QueryError("EXISTS within an expression needs variables that are surely bound on both sides")
        keys = inner.df.select(*[inner.col(v) for v in shared]).distinct().withColumn("hit", F.lit(True))
        df = found.df.join(keys, [column_of(v) for v in shared], "left")
        hit = F.coalesce(F.col("hit"), F.lit(False)) != F.lit(e.negated)
        df = df.withColumn(column_of(name), terms.typed_term(hit, "boolean")).drop("hit")
        return Solutions(df, found.bound | {name: True}, found.native), A.Var(name)

    def _apart(self, left: Solutions, right: Solutions) -> tuple[Solutions, dict[str, str]]:
        """``right`` with shared variables renamed, and the new name of each."""
        self._names += 1
        pairs = {v: f" r{self._names}{v}" for v in right.bound if v in left.bound}
        native = {v: k for v, k in right.native.items() if v not in pairs}
        columns = [right.col(v).alias(column_of(pairs.get(v, v))) for v in right.bound] + [right.plain(v) for v in native]
        return Solutions(right.df.select(*columns) if columns else right.df, {pairs.get(v, v): sure for v, sure in right.bound.items()}, native), pairs

    def _condition(self, left: Solutions, right: Solutions, pairs: dict[str, str], filters: list | None = None, renamed: dict[str, str] | None = None, own: set[str] | None = None) -> Column:
        """Compatibility of two solutions, and filters over both.

        ``renamed`` are the shared variables where ``pairs`` lacks some; ``own``,
        where known, are those that the left rows bind, so that a filter on the
        others reads the right side alone and reaches its scan.
        """
        out = F.lit(True)
        for v, w in pairs.items():
            a, b = left.col(v), right.col(w)
            same = a == b
            if not left.bound[v]:
                same = same | a.isNull()
            if not right.bound[w]:
                same = same | b.isNull()
            out = out & same
        if filters:
            shared = renamed or pairs
            names = {v: left.value(v) for v in left.bound} | {v: right.value(v) for v in right.bound if v not in shared.values()}
            # What the left side leaves unbound is bound by the right one.
            def either(v: str, w: str) -> Column:
                if own is None:
                    return F.coalesce(left.col(v), right.col(w))
                return left.col(v) if v in own else right.col(w)

            names |= {v: Value(either(v, w), "term") for v, w in shared.items() if not left.bound[v]}
            for expr in filters:
                out = out & F.coalesce(self.value(expr, names).truth(), F.lit(False))
        return out

    def _sides(self, side: Solutions, names: list[str]) -> list[tuple[set[str], DataFrame]]:
        """The rows of a side by which of the variables that may be unbound are: (bound ones, rows)."""
        out = [({v for v in names if side.bound[v]}, side.df)]
        for v in names:
            if not side.bound[v]:
                out = [part for bound, df in out for part in ((bound | {v}, df.where(side.col(v).isNotNull())), (bound, df.where(side.col(v).isNull())))]
        return out

    def _met(self, left: Solutions, right: Solutions, pairs: dict[str, str], how: str, filters: list | None = None, sharing: bool = False) -> DataFrame:
        """Compatible solutions of two sides (``how`` is inner, left, left_semi or left_anti).

        With a variable that both sides surely bind, it is the key and the rest
        a condition.  Without one, rows are split by what they bind, so every
        pair of parts has its own keys and no pair of rows is looked at that
        shares none, unless the parts share no variable.  ``sharing`` leaves
        such parts out.
        """
        if not pairs or any(left.bound[v] and right.bound[w] for v, w in pairs.items()):
            return left.df.join(right.df, self._condition(left, right, pairs, filters), how)
        rights = self._sides(right, list(pairs.values()))
        out = []
        for own, df in self._sides(left, list(pairs)):
            if not own and how in ("inner", "left") and not sharing:
                # Every row meets all of the other side: dealt, so that a small table is not multiplied in one task.
                df = df.repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), *[df[c] for c in df.columns])
            rest = df
            for other, more in rights:
                keys = {v: w for v, w in pairs.items() if v in own and w in other}
                if sharing and not keys:
                    continue
                test = reduce(Column.__and__, [left.col(v) == right.col(w) for v, w in keys.items()], F.lit(True))
                if filters:
                    test = test & self._condition(left, right, {}, filters, pairs, own)
                if how == "inner":
                    out.append(df.join(more, test))
                elif how == "left" and len(rights) == 1:
                    out.append(df.join(more, test, "left"))
                elif how == "left":
                    out.append(df.join(more, test))
                elif how == "left_semi":
                    out.append(rest.join(more, test, "left_semi"))
                if how != "inner":
                    rest = rest.join(more, test, "left_anti")
            if how == "left_anti":
                out.append(rest)
            elif how == "left" and len(rights) > 1:
                out.append(rest.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in right.df.schema]))
        return reduce(DataFrame.union, out)

    def join(self, left: Solutions | None, right: Solutions) -> Solutions:
        if left is None:
            return right
        shared = [v for v in right.bound if v in left.bound]
        if all(left.bound[v] and right.bound[v] for v in shared):
            by_key = {v for v in shared if left.native.get(v, "").startswith("key:") and left.native[v] == right.native.get(v)}
            on = [native_of(v) if v in by_key else column_of(v) for v in shared]
            more = {v: k for v, k in right.native.items() if v not in left.native}
            left_df = left.df.select(*left.columns())
            right_df = right.df.select(*[right.plain(v) if v in by_key else right.col(v) for v in right.bound], *[right.plain(v) for v in more])
            # Only a query without a shared variable multiplies its parts, as it asks to.
            df = left_df.join(right_df, on) if on else left_df.crossJoin(right_df)
            return Solutions(df, left.bound | {v: right.bound[v] for v in right.bound if v not in left.bound}, left.native | more)
        apart, pairs = self._apart(left, right)
        return self._merged(left, apart, pairs, self._met(left, apart, pairs, "inner"), optional=False)

    def optional(self, left: Solutions, right: Solutions, filters: list) -> Solutions:
        apart, pairs = self._apart(left, right)
        return self._merged(left, apart, pairs, self._met(left, apart, pairs, "left", filters), optional=True)

    def _merged(self, left: Solutions, right: Solutions, pairs: dict[str, str], df: DataFrame, optional: bool) -> Solutions:
        columns = [F.coalesce(left.col(v), right.col(pairs[v])).alias(column_of(v)) if v in pairs and not left.bound[v] else left.col(v) for v in left.bound]
        new = [v for v in right.bound if v not in pairs.values()]
        bound = {v: sure or (v in pairs and right.bound[pairs[v]] and not optional) for v, sure in left.bound.items()}
        bound |= {v: right.bound[v] and not optional for v in new}
        columns += [right.col(v) for v in new]
        native = {v: k for v, k in left.native.items() if v not in pairs or left.bound[v]} | right.native
        columns += [(right if v in right.native else left).plain(v) for v in native]
        return Solutions(df.select(*columns) if columns else df, bound, native)

    def minus(self, left: Solutions, right: Solutions) -> Solutions:
        """Solutions without a compatible one on the right that shares a bound variable."""
        apart, pairs = self._apart(left, right)
        if not pairs:
            return left
        return Solutions(self._met(left, apart, pairs, "left_anti", sharing=True), left.bound, left.native)

    def union(self, parts: list[Solutions]) -> Solutions:
        names = list(dict.fromkeys(v for p in parts for v in p.bound))
        frames = [p.df.select(*[p.col(v) if v in p.bound else F.lit(None).cast("string").alias(column_of(v)) for v in names]) for p in parts]
        return Solutions(reduce(DataFrame.unionByName, frames), {v: all(p.bound.get(v, False) for p in parts) for v in names})

    def values(self, part: A.Values) -> Solutions:
        schema = ", ".join(f"`{column_of(v.name)}` string" for v in part.vars)
        df = self.spark.createDataFrame([tuple(row) for row in part.rows], schema)
        return Solutions(df, {v.name: all(row[k] is not None for row in part.rows) for k, v in enumerate(part.vars)})

    # Basic graph patterns.
    def basic(self, patterns: list[A.Triple], found: Solutions | None) -> Solutions:
        """Join triple patterns in a greedy order, onto ``found`` where given."""
        left = list(patterns)
        known = set(found.bound) if found else set()
        keys = {v: k for v, k in found.native.items() if k.startswith("key:")} if found else {}
        while left:
            def cost(t: A.Triple) -> tuple:
                ends = [x for x in (t.s, t.o) if isinstance(x, A.Term)]
                linked = bool(known & variables(t)) or not known
                return (not linked, isinstance(t.p, A.Repeat), not isinstance(t.p, A.Term), -len(ends))

            best = min(left, key=cost)
            star, table = self._star_of(best, left, keys)
            left = [t for t in left if t is not best and t not in star]
            among = None
            ends = [x.name for x in (best.s, best.o) if isinstance(x, A.Var)]
            if found and isinstance(best.p, A.Repeat) and not best.p.single and len(ends) == 2 and all(found.bound.get(v) for v in ends):
                # Both ends are known: only their pairs are asked of the path.  Written once, as they are read twice.
                found = Solutions(stage(self.spark, found.df.select(*found.columns()), "path-ends"), found.bound, found.native)
                among = found.df.select(found.col(ends[0]).alias("src"), found.col(ends[1]).alias("dst"))
            one = self._star(star, table, keys) if star else self.triple(best, keys, among)
            found = self.join(found, one)
            known |= set(one.bound)
            keys |= {v: k for v, k in one.native.items() if k.startswith("key:")}
        return found

    def _sources(self, t: A.Triple, keys: dict[str, str]) -> list:
        """Where a pattern's triples can come from: by its predicate, by a constant object that is fixed, and by the known keys of its ends."""
        def fits(m) -> bool:
            if isinstance(t.o, A.Term) and isinstance(m.object, Fixed) and m.object.text != t.o.text:
                return False
            ends = ((t.s, m.subject), (t.o, m.object))
            return not any(isinstance(node, A.Var) and node.name in keys and apart(Key(keys[node.name][4:], ""), made) for node, made in ends)

        return [m for m in self.graph.sources(t.p.text) if fits(m)]

    def _star_of(self, best: A.Triple, left: list[A.Triple], keys: dict[str, str]) -> tuple[list[A.Triple], tuple | None]:
        """The patterns of ``best``'s subject, itself among them, that one table holds with one value a subject.

        A pattern that has one source only, such as a type, tells the table;
        another pattern belongs to it when no other source has such subjects.
        """
        if self.graph.loose:
            return [], None
        own = [t for t in left if t.s == best.s and isinstance(t.p, A.Term)]
        for t in own:
            sources = self._sources(t, keys)
            if len(sources) == 1 and sources[0].single:
                table = sources[0].table, sources[0].subject
                star = [u for u in own if [(m.table, m.subject, m.single) for m in self._sources(u, keys) if not apart(m.subject, table[1])] == [(*table, True)]]
                if best in star:
                    return star, table
        if isinstance(best.p, A.Term) and len(sources := self._sources(best, keys)) == 1:
            return [best], (sources[0].table, sources[0].subject)
        return [], None

    def _star(self, star: list[A.Triple], table: tuple, keys: dict[str, str]) -> Solutions:
        """Patterns over one subject and table as one scan; several values of a subject are taken once each."""
        df = self.graph.tables[table[0]]
        makers: list[tuple[object, object]] = [(star[0].s, table[1])]
        for t in star:
            source = next(m for m in self._sources(t, keys) if (m.table, m.subject) == table)
            makers.append((t.o, source.object))
            if not source.single:
                df = df.select(*dict.fromkeys(made.column for _, made in makers if not isinstance(made, Fixed))).distinct()
        conditions: list[Column] = []
        made: dict[str, Column] = {}
        native: dict[str, tuple[str, Column]] = {}
        for node, maker in makers:
            if not isinstance(maker, Fixed):
                conditions.append(df[maker.column].isNotNull())
            if isinstance(node, A.Term):
                conditions.append(maker.matches(df, node.text))
            elif node.name in made:
                conditions.append(made[node.name] == maker.term(df))
            else:
                made[node.name] = maker.term(df)
                kind = {"integer": "int", "double": "num", "string": "str"}.get(maker.kind) if isinstance(maker, FromColumn) else None
                if isinstance(maker, Key) and isinstance(df.schema[maker.column].dataType, T.IntegralType):
                    native[node.name] = f"key:{maker.prefix}", df[maker.column].cast("long")
                elif kind:
                    native[node.name] = kind, df[maker.column].cast("long") if kind == "int" else df[maker.column]
        df = df.where(reduce(Column.__and__, conditions)) if conditions else df
        columns = [c.alias(column_of(v)) for v, c in made.items()] + [c.alias(native_of(v)) for v, (_, c) in native.items()]
        return Solutions(df.select(*columns), dict.fromkeys(made, True), {v: k for v, (k, _) in native.items()})

    def triple(self, t: A.Triple, keys: dict[str, str] | None = None, among: DataFrame | None = None) -> Solutions:
        if isinstance(t.p, (A.Term, A.Var)):
            sources = self._sources(t, keys or {}) if isinstance(t.p, A.Term) else None
            rows = self.graph.scan(*[x.text if isinstance(x, A.Term) else None for x in (t.s, t.p, t.o)], sources=sources)
            ends = [(t.s, "s"), (t.p, "p"), (t.o, "o")]
        else:
            s, o = (x.text if isinstance(x, A.Term) else None for x in (t.s, t.o))
            rows = self._repeat(t.p, s, o, among) if isinstance(t.p, A.Repeat) else self.path(t.p, s, o)
            ends = [(t.s, "s"), (t.o, "o")]
        made: dict[str, str] = {}
        for node, column in ends:
            if isinstance(node, A.Var):
                if node.name in made:
                    rows = rows.where(F.col(made[node.name]) == F.col(column))
                else:
                    made[node.name] = column
        return Solutions(rows.select(*[F.col(c).alias(column_of(v)) for v, c in made.items()]), dict.fromkeys(made, True))

    def path(self, path: object, s: str | None = None, o: str | None = None) -> DataFrame:
        """(s, o) pairs of a property path with constant ends where given."""
        if isinstance(path, A.Term):
            return self.graph.scan(s=s, p=path.text, o=o).select("s", "o")
        if isinstance(path, A.Inverse):
            return self.path(path.path, o, s).select(F.col("o").alias("s"), F.col("s").alias("o"))
        if isinstance(path, A.Sequence):
            first = self.path(path.first, s, None).select("s", F.col("o").alias("mid"))
            return first.join(self.path(path.rest, None, o).select(F.col("s").alias("mid"), "o"), "mid").select("s", "o")
        if isinstance(path, A.Either):
            return self.path(path.left, s, o).unionByName(self.path(path.right, s, o))
        if isinstance(path, A.NotIn):
            out = []
            if path.forward or not path.backward:
                out.append(self.graph.scan(s=s, o=o).where(~F.col("p").isin(list(path.forward))).select("s", "o"))
            if path.backward:
                out.append(self.graph.scan(s=o, o=s).where(~F.col("p").isin(list(path.backward))).select(F.col("o").alias("s"), F.col("s").alias("o")))
            return reduce(DataFrame.unionByName, out)
        if isinstance(path, A.Repeat):
            return self._repeat(path, s, o)
        raise QueryError(f"unsupported path {path!r}")

    def _repeat(self, path: A.Repeat, s: str | None, o: str | None, among: DataFrame | None = None) -> DataFrame:
        """(s, o) pairs of a repeated path; of one or more steps, at least those ``among`` the pairs asked (src, dst)."""
        if path.single:
            pairs = self.path(path.path, s, o)
        else:
            edges = self.path(path.path).select(F.col("s").alias("src"), F.col("o").alias("dst"))
            pairs = paths.closure(edges, start=s, end=o, among=among).select(F.col("src").alias("s"), F.col("dst").alias("o"))
        if path.least == 0:
            if s is not None or o is not None:
                ends = [x for x in {s, o} if x is not None]
                same = self.spark.createDataFrame([(x, x) for x in ends], "s string, o string")
            else:
                rows = self.graph.scan()
                same = rows.select(F.col("s").alias("n")).union(rows.select("o")).distinct().select(F.col("n").alias("s"), F.col("n").alias("o"))
            pairs = pairs.unionByName(same)
            if s is not None:
                pairs = pairs.where(F.col("s") == F.lit(s))
            if o is not None:
                pairs = pairs.where(F.col("o") == F.lit(o))
        return pairs.distinct()

    # Expressions.
    def value(self, e: object, scope: Solutions | dict[str, Value]) -> Value:
        if isinstance(e, A.Var):
            if isinstance(scope, dict):
                return scope[e.name] if e.name in scope else Value(F.lit(None).cast("string"), "term")
            return scope.value(e.name)
        if isinstance(e, A.Term):
            return _constant(e.text)
        if isinstance(e, A.Call):
            return self._call(e, scope)
        if isinstance(e, A.Exists):
            raise QueryError("EXISTS is supported as a filter of its own or joined to others by &&")
        raise QueryError(f"unexpected expression {e!r}")

    def _call(self, e: A.Call, scope: Solutions | dict[str, Value]) -> Value:
        name = e.name
        if name.startswith(f"<{XSD}"):
            return _cast(name[len(XSD) + 1 : -1], self.value(e.args[0], scope))
        args = [self.value(a, scope) for a in e.args]
        made = _FUNCTIONS.get(name)
        if not made:
            raise QueryError(f"unknown function {name}")
        return made(*args)


def _constant(term: str) -> Value:
    """A constant as a plain value where it has one."""
    text, _, kind, lang = terms.parts(term)
    if kind == XSD + "integer":
        return Value(F.lit(int(text)), "int", F.lit(term))
    if kind in (XSD + "decimal", XSD + "double"):
        return Value(F.lit(float(text)), "num", F.lit(term))
    if kind == XSD + "boolean":
        return Value(F.lit(text in ("true", "1")), "bool", F.lit(term))
    if kind == XSD + "string":
        return Value(F.lit(text), "str", F.lit(term))
    return Value(F.lit(term), "term")


def _aggregates(e: object) -> bool:
    return isinstance(e, A.Aggregate) or (isinstance(e, A.Call) and any(map(_aggregates, e.args)))


def _exists_in(e: object) -> list[A.Exists]:
    """The EXISTS parts of an expression."""
    if isinstance(e, A.Exists):
        return [e]
    return [x for a in e.args for x in _exists_in(a)] if isinstance(e, A.Call) else []


def _replaced(e: object, names: dict[int, A.Var]) -> object:
    """``e`` with EXISTS parts replaced by the variables that hold their answers."""
    if isinstance(e, A.Exists):
        return names[id(e)]
    return A.Call(e.name, tuple(_replaced(a, names) for a in e.args)) if isinstance(e, A.Call) else e


def _substitute(e: object, defined: dict[A.Var, object]) -> object:
    """``e`` with SELECT's names replaced by what they stand for."""
    if isinstance(e, A.Var):
        return defined.get(e, e)
    return A.Call(e.name, tuple(_substitute(a, defined) for a in e.args)) if isinstance(e, A.Call) else e


def _cast(local: str, v: Value) -> Value:
    if local in ("integer", "int", "long"):
        return Value(F.coalesce(v.number().cast("long"), v.text().try_cast("long")), "int")
    if local in ("double", "float", "decimal"):
        return Value(F.coalesce(v.number().cast("double"), v.text().try_cast("double")), "num")
    if local == "boolean":
        return Value(F.coalesce(F.when(v.text().isin("true", "1"), True).when(v.text().isin("false", "0"), False), v.truth()), "bool")
    if local == "dateTime":
        return Value(v.time(), "time")
    return Value(v.text(), "str")


def _equal(a: Value, b: Value) -> Column:
    if a.kind == b.kind and a.kind in ("str", "bool", "time"):
        return a.col == b.col
    if {a.kind, b.kind} <= {"str", "int", "num"} and "str" in (a.kind, b.kind):
        return F.lit(False)
    if {a.kind, b.kind} <= {"int", "num"}:
        return a.col == b.col
    if "bool" in (a.kind, b.kind):
        return a.truth() == b.truth()
    x, y = a.number(), b.number()
    return F.when(x.isNotNull() & y.isNotNull(), x == y).otherwise(a.term() == b.term())


def _compare(op: str):
    def out(a: Value, b: Value) -> Value:
        x, y = a.number(), b.number()
        by = {"<": Column.__lt__, "<=": Column.__le__, ">": Column.__gt__, ">=": Column.__ge__}[op]
        if {a.kind, b.kind} <= {"int", "num"}:
            return Value(by(a.col, b.col), "bool")
        if a.kind == b.kind == "str":
            return Value(by(a.col, b.col), "bool")
        texts = F.when(x.isNull() & y.isNull(), by(a.text(), b.text()))
        return Value(F.when(x.isNotNull() & y.isNotNull(), by(x, y)).otherwise(texts), "bool")

    return out


def _whole(v: Value) -> Column:
    """Whether a value is an integer."""
    return terms.suffix(v.col) == f"^^<{XSD}integer>" if v.kind == "term" else F.lit(v.kind == "int")


def _typed(number: Column, whole: Column) -> Value:
    """A number as an integer term where ``whole``, else as a double."""
    return Value(F.when(whole, terms.typed_term(number.cast("long"), "integer")).otherwise(terms.typed_term(number.cast("double"), "double")), "term")


def _arithmetic(op):
    def out(a: Value, b: Value) -> Value:
        if a.kind == b.kind == "int":
            return Value(op(a.col, b.col), "int")
        if "term" not in (a.kind, b.kind):
            return Value(op(a.number(), b.number()).cast("double"), "num")
        return _typed(op(a.number(), b.number()), _whole(a) & _whole(b))

    return out


def _text(f, kind: str = "str"):
    """A function of texts."""
    return lambda *args: Value(f(*[a.text() for a in args]), kind)


def _date(f):
    return lambda a: Value(f(a.time()), "int")


def _seconds(a: Value) -> Value:
    """Seconds with their fraction."""
    whole = F.second(a.time())
    parts = F.extract(F.lit("SECOND"), a.time()).cast("double")
    return _typed(parts, parts == whole)


def _timezone(a: Value) -> Value:
    """The offset as a duration; an error without one."""
    zone = F.regexp_extract(a.text(), r"(Z|[+-]\d\d:\d\d)$", 1)
    hours, minutes = F.substring(zone, 2, 2).cast("int"), F.substring(zone, 5, 2).cast("int")
    size = F.concat(F.when(hours > 0, F.concat(hours.cast("string"), F.lit("H"))).otherwise(F.lit("")), F.when(minutes > 0, F.concat(minutes.cast("string"), F.lit("M"))).otherwise(F.lit("")))
    sign = F.when(zone.startswith("-") & (F.length(size) > 0), F.lit("-PT")).otherwise(F.lit("PT"))
    text = F.when(zone == "Z", F.lit("PT0S")).when(F.length(zone) > 0, F.concat(sign, F.when(F.length(size) > 0, size).otherwise(F.lit("0S"))))
    return Value(terms.typed_term(text, "dayTimeDuration"), "term")


def _tagged(a: Value, text: Column) -> Value:
    """``text`` with the language of ``a``, where it has one."""
    if a.kind != "term":
        return Value(text, "str")
    end = terms.suffix(a.term())
    return Value(F.concat(terms.text_term(text), F.when(end.startswith("@"), end).otherwise(F.lit(""))), "term")


def _regex(text: Value, pattern: Value, flags: Value | None = None) -> Value:
    p = pattern.text()
    if flags is not None:
        p = F.when(F.length(flags.text()) > 0, F.concat(F.lit("(?"), flags.text(), F.lit(")"), p)).otherwise(p)
    return Value(F.regexp(text.text(), p), "bool")


def _replace(text: Value, pattern: Value, by: Value, flags: Value | None = None) -> Value:
    p = pattern.text()
    if flags is not None:
        p = F.concat(F.lit("(?"), flags.text(), F.lit(")"), p)
    return _tagged(text, F.regexp_replace(text.text(), p, by.text()))


def _before(a: Value, b: Value) -> Value:
    at = F.instr(a.text(), b.text())
    found = _tagged(a, F.substring(a.text(), F.lit(1), at - 1))
    return Value(F.when(at > 0, found.term()).otherwise(F.lit('""')), "term") if found.kind == "term" else Value(F.when(at > 0, found.col).otherwise(F.lit("")), "str")


def _after(a: Value, b: Value) -> Value:
    at = F.instr(a.text(), b.text())
    found = _tagged(a, F.when(F.length(b.text()) == 0, a.text()).otherwise(F.substring(a.text(), at + F.length(b.text()), F.length(a.text()))))
    hit = (at > 0) | (F.length(b.text()) == 0)
    return Value(F.when(hit, found.term()).otherwise(F.lit('""')), "term") if found.kind == "term" else Value(F.when(hit, found.col).otherwise(F.lit("")), "str")


def _if(test: Value, yes: Value, no: Value) -> Value:
    if yes.kind == no.kind:
        return Value(F.when(test.truth(), yes.col).when(~test.truth(), no.col), yes.kind)
    return Value(F.when(test.truth(), yes.term()).when(~test.truth(), no.term()), "term")


def _starts(prefix: str):
    return lambda a: Value(a.term().startswith(prefix), "bool")


_FUNCTIONS = {
    "OR": lambda a, b: Value(a.truth() | b.truth(), "bool"),
    "AND": lambda a, b: Value(a.truth() & b.truth(), "bool"),
    "NOT": lambda a: Value(~a.truth(), "bool"),
    "=": lambda a, b: Value(_equal(a, b), "bool"),
    "!=": lambda a, b: Value(~_equal(a, b), "bool"),
    **{op: _compare(op) for op in ("<", "<=", ">", ">=")},
    "IN": lambda a, *rest: Value(reduce(Column.__or__, [_equal(a, b) for b in rest], F.lit(False)), "bool"),
    "+": _arithmetic(lambda x, y: x + y),
    "-": _arithmetic(lambda x, y: x - y),
    "*": _arithmetic(lambda x, y: x * y),
    "/": lambda a, b: Value(a.number() / F.nullif(b.number().cast("double"), F.lit(0.0)), "num"),
    "NEG": lambda a: Value(-a.col, a.kind) if a.kind in ("int", "num") else _typed(-a.number(), _whole(a)),
    "BOUND": lambda a: Value(a.col.isNotNull(), "bool"),
    "COALESCE": lambda *args: Value(F.coalesce(*[a.term() for a in args]), "term"),
    "IF": _if,
    "SAMETERM": lambda a, b: Value(a.term() == b.term(), "bool"),
    "ISIRI": _starts("<"),
    "ISURI": _starts("<"),
    "ISBLANK": _starts("_:"),
    "ISLITERAL": _starts('"'),
    "ISNUMERIC": lambda a: Value(a.number().isNotNull(), "bool"),
    "STR": lambda a: Value(a.text(), "str"),
    "LANG": lambda a: Value(terms.lang(a.term()), "str"),
    "DATATYPE": lambda a: Value(terms.iri_term(terms.datatype(a.term())), "term"),
    "LANGMATCHES": lambda a, b: Value(F.when(b.text() == "*", F.length(a.text()) > 0).otherwise((F.lower(a.text()) == F.lower(b.text())) | F.startswith(F.lower(a.text()), F.concat(F.lower(b.text()), F.lit("-")))), "bool"),
    "STRLEN": _text(F.length, "int"),
    "SUBSTR": lambda a, at, n=None: _tagged(a, F.substring(a.text(), at.number().cast("int"), n.number().cast("int") if n else F.length(a.text()))),
    "UCASE": lambda a: _tagged(a, F.upper(a.text())),
    "LCASE": lambda a: _tagged(a, F.lower(a.text())),
    "CONTAINS": _text(F.contains, "bool"),
    "STRSTARTS": _text(F.startswith, "bool"),
    "STRENDS": _text(F.endswith, "bool"),
    "STRBEFORE": _before,
    "STRAFTER": _after,
    "CONCAT": _text(lambda *a: F.concat(*a)),
    "REGEX": _regex,
    "REPLACE": _replace,
    "ENCODE_FOR_URI": _text(lambda a: F.replace(F.replace(F.url_encode(a), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A"))),
    "ABS": lambda a: Value(F.abs(a.col), a.kind) if a.kind in ("int", "num") else _typed(F.abs(a.number()), _whole(a)),
    "CEIL": lambda a: Value(F.ceil(a.number()).cast("long"), "int"),
    "FLOOR": lambda a: Value(F.floor(a.number()).cast("long"), "int"),
    "ROUND": lambda a: Value(F.floor(a.number() + 0.5).cast("long"), "int"),
    "RAND": lambda: Value(F.rand(), "num"),
    "NOW": lambda: Value(F.current_timestamp(), "time"),
    "YEAR": _date(F.year),
    "MONTH": _date(F.month),
    "DAY": _date(F.dayofmonth),
    "HOURS": _date(F.hour),
    "MINUTES": _date(F.minute),
    "SECONDS": _seconds,
    "TZ": lambda a: Value(F.regexp_extract(a.text(), r"(Z|[+-]\d\d:\d\d)$", 1), "str"),
    "TIMEZONE": _timezone,
    "MD5": _text(lambda a: F.md5(a)),
    "SHA1": _text(lambda a: F.sha1(a)),
    "SHA256": _text(lambda a: F.sha2(a, 256)),
    "SHA384": _text(lambda a: F.sha2(a, 384)),
    "SHA512": _text(lambda a: F.sha2(a, 512)),
    "IRI": lambda a: Value(terms.iri_term(a.text()), "term"),
    "URI": lambda a: Value(terms.iri_term(a.text()), "term"),
    "BNODE": lambda a=None: Value(F.concat(F.lit("_:n"), F.sha1(a.text()) if a else F.replace(F.uuid(), F.lit("-"), F.lit(""))), "term"),
    "STRDT": lambda a, b: Value(F.concat(F.lit('"'), a.text(), F.lit('"^^'), b.term()), "term"),
    "STRLANG": lambda a, b: Value(F.concat(F.lit('"'), a.text(), F.lit('"@'), F.lower(b.text())), "term"),
    "UUID": lambda: Value(F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">")), "term"),
    "STRUUID": lambda: Value(F.uuid(), "str"),
}


def sparql(graph: Graph, text: str, prefixes: dict[str, str] | None = None) -> DataFrame:
    """The answer of a query, as lexical forms; triples (s, p, o) for CONSTRUCT and DESCRIBE."""
    return Compiler(graph).run(parse(text, prefixes))
