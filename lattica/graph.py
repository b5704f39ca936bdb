"""The graph: where the triples of each predicate come from.

A predicate is registered as (DataFrame, subject, object), so a pattern with a
constant predicate reads a narrow projection of one table and filters reach
its scan; only a variable predicate unions all of them.  A table's rows can
also be registered with their keys (:class:`Key`): a constant subject then
becomes a filter on the key column, and patterns that share a subject read the
table once.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.functions import terms
from lattica.functions.terms import RDF_TYPE

TRIPLES = T.StructType([T.StructField(c, T.StringType(), False) for c in ("s", "p", "o")])


@dataclass(frozen=True)
class Key:
    """A term made of a fixed prefix and the text of a key column."""

    prefix: str
    column: str

    def term(self, df: DataFrame) -> Column:
        return F.concat(F.lit(f"<{self.prefix}"), df[self.column].cast("string"), F.lit(">"))

    def matches(self, df: DataFrame, term: str) -> Column:
        """Rows whose key makes this term; a filter on the bare column, so that it reaches the scan."""
        text = term[len(self.prefix) + 1 : -1]
        if not term.startswith(f"<{self.prefix}") or not term.endswith(">"):
            return F.lit(False)
        if isinstance(df.schema[self.column].dataType, T.IntegralType):
            return df[self.column] == F.lit(int(text)) if text.lstrip("-").isdigit() else F.lit(False)
        return df[self.column] == F.lit(text)


@dataclass(frozen=True)
class Value:
    """A literal made of a column; ``kind`` is the local name of its XML Schema datatype."""

    column: str
    kind: str

    def term(self, df: DataFrame) -> Column:
        return terms.typed_term(df[self.column], self.kind)

    def matches(self, df: DataFrame, term: str) -> Column:
        text, _, datatype, _ = terms.parts(term)
        if datatype != terms.XSD + self.kind:
            return F.lit(False)
        return df[self.column] == F.lit(text).cast(df.schema[self.column].dataType)


@dataclass(frozen=True)
class Fixed:
    """The same term for every row."""

    text: str

    def term(self, df: DataFrame) -> Column:
        return F.lit(self.text)

    def matches(self, df: DataFrame, term: str) -> Column:
        return F.lit(term == self.text)


@dataclass(frozen=True)
class Stored:
    """A column that holds terms already."""

    column: str

    def term(self, df: DataFrame) -> Column:
        return df[self.column]

    def matches(self, df: DataFrame, term: str) -> Column:
        return df[self.column] == F.lit(term)


Maker = Key | Value | Fixed | Stored


def apart(a: Maker, b: Maker) -> bool:
    """Whether two makers surely make different terms: keys whose prefixes are no beginnings of each other."""
    return isinstance(a, Key) and isinstance(b, Key) and not a.prefix.startswith(b.prefix) and not b.prefix.startswith(a.prefix)


@dataclass(frozen=True)
class Mapping:
    """One predicate's triples in one table; ``single`` says that a subject has one value at most."""

    table: str
    predicate: str
    subject: Maker
    object: Maker
    single: bool = False


@dataclass
class Graph:
    spark: SparkSession
    tables: dict[str, DataFrame] = field(default_factory=dict)
    mappings: list[Mapping] = field(default_factory=list)
    #: Tables of (s, p, o) whose predicates are known only from their rows.
    loose: list[DataFrame] = field(default_factory=list)
    version: int = 0

    @classmethod
    def of(cls, triples: DataFrame) -> Graph:
        """A graph over a table of (s, p, o) terms, as a set."""
        graph = cls(triples.sparkSession)
        graph.add(triples)
        return graph

    def add(self, triples: DataFrame) -> None:
        self.loose.append(triples.select("s", "p", "o"))
        self.version += 1

    def register(self, table: str, df: DataFrame, subject: Maker, values: dict[str, Maker], single: bool = True) -> None:
        """Register a table's columns as predicates of one subject."""
        self.tables[table] = df
        self.mappings += [Mapping(table, predicate, subject, made, single) for predicate, made in values.items()]
        self.version += 1

    def sources(self, predicate: str | None) -> list[Mapping]:
        return [m for m in self.mappings if predicate is None or m.predicate == predicate]

    def rows(self, mapping: Mapping) -> DataFrame:
        """The table's rows that have this triple: SQL nulls make none."""
        df = self.tables[mapping.table]
        for made in (mapping.subject, mapping.object):
            if not isinstance(made, Fixed):
                df = df.where(df[made.column].isNotNull())
        return df

    def scan(self, s: str | None = None, p: str | None = None, o: str | None = None, sources: list[Mapping] | None = None) -> DataFrame:
        """Triples (s, p, o) that have the given terms, of all mappings or of some ``sources``."""
        out = []
        for mapping in self.sources(p) if sources is None else sources:
            df = self.rows(mapping)
            if s is not None:
                df = df.where(mapping.subject.matches(df, s))
            if o is not None:
                df = df.where(mapping.object.matches(df, o))
            if not mapping.single:
                df = df.select(*dict.fromkeys(m.column for m in (mapping.subject, mapping.object) if not isinstance(m, Fixed))).distinct()
            out.append(df.select(mapping.subject.term(df).alias("s"), F.lit(mapping.predicate).alias("p"), mapping.object.term(df).alias("o")))
        for df in self.loose:
            for column, term in (("s", s), ("p", p), ("o", o)):
                if term is not None:
                    df = df.where(F.col(column) == F.lit(term))
            out.append(df)
        if not out:
            return self.spark.createDataFrame([], TRIPLES)
        union = reduce(DataFrame.unionByName, out)
        return union if len(out) == 1 and not self.loose else union.distinct() if self.loose and len(out) > 1 else union

    def triples(self) -> DataFrame:
        return self.scan()

    def edges(self, predicate: str) -> DataFrame:
        """(src, dst) of one predicate."""
        return self.scan(p=predicate).select(F.col("s").alias("src"), F.col("o").alias("dst"))

    def types(self) -> DataFrame:
        """How many subjects each type has; the label is what follows the last slash or hash."""
        counts = self.scan(p=RDF_TYPE).groupBy("o").agg(F.count(F.lit(1)).alias("n"))
        return counts.select(F.regexp_extract("o", r"([^/#]*)>$", 1).alias("label"), terms.lexical(F.col("o")).alias("type"), "n")
