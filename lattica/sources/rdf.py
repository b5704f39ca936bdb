"""RDF files to and from triples (s, p, o)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import terms
from lattica.functions.staging import ship
from lattica.functions.terms import OWL, RDF, RDF_TYPE, RDFS, XSD
from lattica.graph import TRIPLES
from lattica.plans.parser import unescape

FORMATS = {"ttl": "turtle", "turtle": "turtle", "n3": "turtle", "nt": "nt", "ntriples": "nt", "rdf": "xml", "xml": "xml", "owl": "turtle", "jsonld": "json-ld"}


def format_of(path: str) -> str:
    """The format by suffix; Turtle for any other."""
    return FORMATS.get(path.rsplit(".", 1)[-1].lower(), "turtle")


_NT = r'^\s*(<[^>]*>|_:\S+)\s+(<[^>]*>)\s+(<[^>]*>|_:\S+|"[^"\\]*+(?:\\.[^"\\]*+)*+"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?)\s*\.\s*(?:#.*)?$'


def _unescaped(term: Column) -> Column:
    """A literal as the canonical term: common escapes undone, xsd:string left out."""
    text = term
    for mark, real in (("\\\\", "\x00"), ("\\n", "\n"), ("\\t", "\t"), ("\\r", "\r"), ('\\"', '"'), ("\x00", "\\")):
        text = F.replace(text, F.lit(mark), F.lit(real))
    return F.when(term.startswith('"'), F.regexp_replace(text, re.escape(f"^^<{XSD}string>") + "$", "")).otherwise(term)


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """Triples of N-Triples files, line by line on the JVM; ``\\u`` escapes are undone only where one stands.

    Lines that are no triple are left out; :func:`unread_ntriples` lists them.
    """
    lines = spark.read.text(path).where(F.col("value").rlike(_NT))
    parts = [F.regexp_extract("value", _NT, k) for k in (1, 2, 3)]
    found = lines.select(parts[0].alias("s"), parts[1].alias("p"), _unescaped(parts[2]).alias("o"))
    coded = found.where(F.col("o").rlike(r"\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}"))
    ship(spark)

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(o=[re.sub(r"\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})", lambda m: chr(int(m[1] or m[2], 16)), o) for o in frame["o"]])

    plain = found.where(~F.col("o").rlike(r"\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}"))
    return plain.unionByName(coded.mapInPandas(decode, "s string, p string, o string")).distinct()


def unread_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """(value) of the lines of N-Triples files that are neither a triple nor blank nor a comment."""
    return spark.read.text(path).where(~F.col("value").rlike(_NT) & ~F.col("value").rlike(r"^\s*(?:#.*)?$"))


def escaped(term: Column) -> Column:
    """A term as N-Triples writes it."""
    text = terms.lexical(term)
    for real, mark in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(real), F.lit(mark))
    return F.when(term.startswith('"'), F.concat(F.lit('"'), text, F.lit('"'), terms.suffix(term))).otherwise(term)


def ntriples(triples: DataFrame) -> DataFrame:
    return triples.select(F.concat_ws(" ", "s", "p", escaped(F.col("o")), F.lit(".")).alias("value"))


def turtle(triples: DataFrame) -> DataFrame:
    """One block of Turtle for each subject, in order."""
    pair = F.concat(F.lit("    "), F.when(F.col("p") == RDF_TYPE, F.lit("a")).otherwise(F.col("p")), F.lit(" "), escaped(F.col("o")))
    blocks = triples.groupBy("s").agg(F.array_join(F.array_sort(F.collect_list(pair)), " ;\n").alias("body"))
    return blocks.orderBy("s").select(F.concat("s", F.lit("\n"), "body", F.lit(" .\n")).alias("value"))


_TURTLE = re.compile(
    r"""(?P<skip>\s+|\#[^\n]*)|(?P<iri><[^<>"{}|^`\\\x00-\x20]*>)
  |(?P<text>\"\"\"(?:[^\\]|\\.)*?\"\"\"|'''(?:[^\\]|\\.)*?'''|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
  |(?P<at>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<number>[+-]?(?:\d+\.\d+|\.\d+|\d+)(?:[eE][+-]?\d+)?)
  |(?P<blank>_:[A-Za-z0-9_](?:[\w.-]*[\w-])?)|(?P<name>(?:[^\W\d_][\w.-]*)?:(?:[\w:%\\](?:[\w.:%\\/-]*[\w:%/-])?)?)
  |(?P<word>[A-Za-z]+)|(?P<op>\^\^|[.;,\[\]()])""",
    re.VERBOSE | re.DOTALL,
)


def parse_turtle(text: str, label: str = "") -> list[tuple[str, str, str]]:
    """Triples of a Turtle document; ``label`` keeps blank nodes of different files apart."""
    prefixes = {"rdf": RDF, "rdfs": RDFS, "xsd": XSD, "owl": OWL}
    base, out, fresh, at = "", [], 0, 0
    tokens: list[tuple[str, str]] = []
    while at < len(text):
        m = _TURTLE.match(text, at)
        if not m:
            raise ValueError(f"can't read Turtle at {text[at : at + 30]!r}")
        if m.lastgroup != "skip":
            tokens.append((m.lastgroup, m[0]))
        at = m.end()
    tokens.append(("end", ""))
    k = 0

    def take() -> tuple[str, str]:
        nonlocal k
        k += 1
        return tokens[k - 1]

    def new_blank() -> str:
        nonlocal fresh
        fresh += 1
        return f"_:{label}n{fresh}"

    def resolve(ref: str) -> str:
        return f"<{ref if ':' in ref.split('/', 1)[0] else base + ref}>"

    def node() -> str:
        kind, tok = take()
        if kind == "iri":
            return resolve(tok[1:-1])
        if kind == "name":
            prefix, _, local = tok.partition(":")
            return f"<{prefixes[prefix]}{local.replace(chr(92), '')}>"
        if kind == "blank":
            return f"_:{label}{tok[2:]}"
        if kind == "number":
            return f'"{tok}"^^<{XSD}{"double" if "e" in tok.lower() else "decimal" if "." in tok else "integer"}>'
        if kind == "word" and tok in ("true", "false"):
            return f'"{tok}"^^<{XSD}boolean>'
        if kind == "word" and tok == "a":
            return RDF_TYPE
        if kind == "text":
            value = unescape(tok[3:-3] if tok[:3] in ('"""', "'''") else tok[1:-1])
            if tokens[k][0] == "at":
                return f'"{value}"{take()[1].lower()}'
            if tokens[k][1] == "^^":
                take()
                datatype = node()
                return f'"{value}"' if datatype == f"<{XSD}string>" else f'"{value}"^^{datatype}'
            return f'"{value}"'
        if tok == "[":
            own = new_blank()
            if tokens[k][1] != "]":
                properties(own)
            take()
            return own
        if tok == "(":
            items = []
            while tokens[k][1] != ")":
                items.append(node())
            take()
            rest = f"<{RDF}nil>"
            for item in reversed(items):
                own = new_blank()
                out.append((own, f"<{RDF}first>", item))
                out.append((own, f"<{RDF}rest>", rest))
                rest = own
            return rest
        raise ValueError(f"unexpected {tok!r} in Turtle")

    def properties(subject: str) -> None:
        while True:
            predicate = node()
            while True:
                out.append((subject, predicate, node()))
                if tokens[k][1] != ",":
                    break
                take()
            if tokens[k][1] != ";":
                return
            while tokens[k][1] == ";":
                take()
            if tokens[k][1] in (".", "]") or tokens[k][0] == "end":
                return

    while tokens[k][0] != "end":
        kind, tok = tokens[k]
        if tok.lower() in ("@prefix", "prefix"):
            take()
            name = take()[1]
            prefixes[name[:-1]] = resolve(take()[1][1:-1])[1:-1]
        elif tok.lower() in ("@base", "base"):
            take()
            base = take()[1][1:-1]
        else:
            subject = node()
            if tokens[k][1] != ".":
                properties(subject)
        if tokens[k][1] == ".":
            take()
    return out


def parse_xml(text: str, label: str = "") -> list[tuple[str, str, str]]:
    """Triples of an RDF/XML document without collections or reification."""
    import xml.etree.ElementTree as ET

    out: list[tuple[str, str, str]] = []
    fresh = [0]

    def blank() -> str:
        fresh[0] += 1
        return f"_:{label}x{fresh[0]}"

    def name(tag: str) -> str:
        return f"<{tag[1:].replace('}', '')}>"

    def describe(el) -> str:
        about, own_id, node_id = (el.get(f"{{{RDF}}}{k}") for k in ("about", "ID", "nodeID"))
        subject = f"<{about}>" if about is not None else f"<#{own_id}>" if own_id else f"_:{label}{node_id}" if node_id else blank()
        if el.tag != f"{{{RDF}}}Description":
            out.append((subject, RDF_TYPE, name(el.tag)))
        for key, value in el.attrib.items():
            if not key.startswith((f"{{{RDF}}}", "{http://www.w3.org/XML/")):
                out.append((subject, name(key), f'"{value}"'))
        for child in el:
            resource, node, kind = (child.get(f"{{{RDF}}}{k}") for k in ("resource", "nodeID", "datatype"))
            lang = child.get("{http://www.w3.org/XML/1998/namespace}lang")
            if resource is not None:
                value = f"<{resource}>"
            elif node:
                value = f"_:{label}{node}"
            elif len(child):
                value = describe(child[0])
            else:
                value = terms.literal(child.text or "", kind, lang)
            out.append((subject, name(child.tag), value))
        return subject

    for el in ET.fromstring(text):
        describe(el)
    return out


def read(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Triples of RDF files; N-Triples by lines, other formats a document at a time."""
    kind = kind or format_of(path)
    if kind == "nt":
        return read_ntriples(spark, path)
    ship(spark)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for frame in frames:
            for name, value in zip(frame["name"], frame["value"], strict=True):
                label = hashlib.sha1(name.encode()).hexdigest()[:8]
                rows = parse_xml(value, label) if kind == "xml" else parse_turtle(value, label)
                yield pd.DataFrame(rows, columns=["s", "p", "o"])

    documents = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("name"), "value")
    return documents.mapInPandas(run, TRIPLES).distinct()


def rdf_xml(triples: DataFrame) -> DataFrame:
    """One rdf:Description for each subject."""
    def safe(c: Column) -> Column:
        for real, mark in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            c = F.replace(c, F.lit(real), F.lit(mark))
        return c

    o, p = F.col("o"), terms.lexical(F.col("p"))
    space, local = F.regexp_extract(p, r"^(.*[/#])[^/#]*$", 1), F.regexp_extract(p, r"([^/#]*)$", 1)
    kind, lang = terms.datatype(o), terms.lang(o)
    attribute = F.when(o.startswith("<"), F.concat(F.lit(' rdf:resource="'), safe(terms.lexical(o)), F.lit('"'))).when(o.startswith("_:"), F.concat(F.lit(' rdf:nodeID="'), terms.lexical(o), F.lit('"'))).when(F.length(lang) > 0, F.concat(F.lit(' xml:lang="'), lang, F.lit('"'))).when(kind != XSD + "string", F.concat(F.lit(' rdf:datatype="'), kind, F.lit('"'))).otherwise(F.lit(""))
    body = F.when(o.startswith('"'), safe(terms.lexical(o))).otherwise(F.lit(""))
    line = F.concat(F.lit("    <n:"), local, F.lit(' xmlns:n="'), safe(space), F.lit('"'), attribute, F.lit(">"), body, F.lit("</n:"), local, F.lit(">"))
    about = F.when(F.col("s").startswith("<"), F.concat(F.lit('rdf:about="'), safe(terms.lexical(F.col("s"))), F.lit('"'))).otherwise(F.concat(F.lit('rdf:nodeID="'), terms.lexical(F.col("s")), F.lit('"')))
    blocks = triples.groupBy("s").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("body"))
    return blocks.orderBy("s").select(F.concat(F.lit("  <rdf:Description "), about, F.lit(">\n"), "body", F.lit("\n  </rdf:Description>")).alias("value"))


def json_ld(triples: DataFrame) -> DataFrame:
    """One expanded JSON-LD object for each subject."""
    o = F.col("o")
    value = F.when(o.startswith('"'), F.to_json(F.struct(terms.lexical(o).alias("@value"), F.when(F.length(terms.lang(o)) > 0, terms.lang(o)).alias("@language"), F.when((terms.datatype(o) != XSD + "string") & (F.length(terms.lang(o)) == 0), terms.datatype(o)).alias("@type")))).otherwise(F.to_json(F.struct(F.when(o.startswith("<"), terms.lexical(o)).otherwise(o).alias("@id"))))
    each = triples.groupBy("s", "p").agg(F.array_join(F.array_sort(F.collect_list(value)), ",").alias("values"))
    line = F.concat(F.to_json(F.array(terms.lexical(F.col("p")))), F.lit(":["), "values", F.lit("]"))
    line = F.regexp_replace(line, r'^\["(.*?)"\]:', '"$1":')
    blocks = each.groupBy("s").agg(F.array_join(F.array_sort(F.collect_list(line)), ",").alias("body"))
    name = F.when(F.col("s").startswith("<"), terms.lexical(F.col("s"))).otherwise(F.col("s"))
    return blocks.orderBy("s").select(F.concat(F.lit('{"@id":"'), name, F.lit('",'), "body", F.lit("}")).alias("value"))


WRITERS = {"nt": ntriples, "turtle": turtle, "xml": rdf_xml, "json-ld": json_ld}


def serialise(triples: DataFrame, kind: str = "turtle") -> Iterator[str]:
    """The document's lines, read from the cluster a partition at a time."""
    if kind not in WRITERS:
        raise ValueError(f"unknown format {kind!r}")
    if kind == "xml":
        yield f'<rdf:RDF xmlns:rdf="{RDF}">'
    if kind == "json-ld":
        yield "["
    first = True
    for row in WRITERS[kind](triples).toLocalIterator():
        yield row[0] if kind != "json-ld" or first else "," + row[0]
        first = False
    if kind == "xml":
        yield "</rdf:RDF>"
    if kind == "json-ld":
        yield "]"


def write(triples: DataFrame, path: str, kind: str = "nt", one_part: bool = True) -> None:
    """Write part files of a line format (nt, turtle), or one document of another.

    A document is a single sorted part; without ``one_part`` it is sorted parts
    that make the document one after another, for graphs that one task can't write.
    """
    if kind in ("nt", "turtle"):
        WRITERS[kind](triples).write.mode("overwrite").text(path)
        return
    head, tail = (f'<rdf:RDF xmlns:rdf="{RDF}">', "</rdf:RDF>") if kind == "xml" else ("[", "{}]")
    ends = triples.sparkSession.createDataFrame([(0, head), (9, tail)], "place int, value string")
    body = WRITERS[kind](triples).select(F.lit(1).alias("place"), "value" if kind == "xml" else F.concat("value", F.lit(",")).alias("value"))
    lines = ends.unionByName(body).orderBy("place", "value")
    (lines.coalesce(1) if one_part else lines).select("value").write.mode("overwrite").text(path)
