"""Code entities from JavaScript and TypeScript text.

One pass blanks strings, templates, comments and regular expressions (keeping
their length), so that brackets match; declarations are then found by pattern
and their bodies by bracket matching.  A file is one row in and its entities
are rows out, so extraction is a single ``mapInPandas`` without a shuffle.
Names are resolved afterwards by joins: within the file first, the last
definition winning, then through imports.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.staging import ship
from lattica.model import BASE, ENTITY, entity_uri

_NAME = r"[A-Za-z_$][\w$]*"
_FUNCTION = re.compile(rf"(?:^|(?<=[;{{}}]))[ \t]*(?P<export>export\s+(?P<default>default\s+)?)?(?P<async>async\s+)?function\s*(?P<star>\*)?\s*(?P<name>{_NAME})?\s*(?:<[^>()]*>)?\s*\(", re.MULTILINE)
_ARROW = re.compile(rf"^[ \t]*(?P<export>export\s+(?P<default>default\s+)?)?(?:(?:const|let|var)\s+(?P<name>{_NAME})\s*(?::[^=\n]+)?=\s*)?(?P<async>async\s+)?(?:\((?P<params>[^()]*(?:\([^()]*\)[^()]*)*)\)|(?P<one>{_NAME}))\s*(?::\s*[^=\n{{]+)?=>", re.MULTILINE)
_CLASS = re.compile(rf"(?:^|(?<=[;{{}}]))[ \t]*(?P<export>export\s+(?P<default>default\s+)?)?(?P<abstract>abstract\s+)?class\s+(?P<name>{_NAME})\s*(?:<(?P<types>[^>{{]*)>)?\s*(?:extends\s+(?P<extends>[\w$.]+)(?:<[^{{]*?>)?)?\s*(?:implements\s+(?P<implements>[^{{]+?))?\s*\{{", re.MULTILINE)
_INTERFACE = re.compile(rf"(?:^|(?<=[;{{}}]))[ \t]*(?P<export>export\s+(?P<default>default\s+)?)?(?P<word>interface|type)\s+(?P<name>{_NAME})\s*(?:<(?P<types>[^>{{=]*)>)?\s*(?:extends\s+(?P<extends>[^{{]+?))?\s*[{{=]", re.MULTILINE)
_VARIABLE = re.compile(rf"(?:^|(?<=[;{{}}]))[ \t]*(?P<export>export\s+)?(?P<word>const|let|var)\s+(?P<name>{_NAME})\s*(?::\s*(?P<type>[^=;\n]+?))?\s*(?:=(?!>)\s*(?P<init>[^\n;]*))?", re.MULTILINE)
_METHOD = re.compile(rf"(?:^|(?<=[;{{}}]))[ \t]*(?P<words>(?:(?:public|private|protected|static|async|readonly|abstract|override|get|set)\s+)*)(?P<star>\*\s*)?(?P<name>#?{_NAME})\s*(?:<[^>()]*>)?\s*\(", re.MULTILINE)
_PROPERTY = re.compile(rf"^[ \t]*(?P<words>(?:(?:public|private|protected|static|readonly|declare|abstract)\s+)*)(?P<name>#?{_NAME})\s*[?!]?\s*(?::\s*(?P<type>[^=;\n]+?))?\s*(?:=\s*(?P<init>[^\n;]*))?;?[ \t]*$", re.MULTILINE)
_IMPORT = re.compile(r"""^[ \t]*import\s+(?P<type>type\s+)?(?:(?P<what>[\w$*{}\s,]+?)\s+from\s+)?['"](?P<path>[^'"\n]+)['"]""", re.MULTILINE)
_REQUIRE = re.compile(r"""\b(?:const|let|var)\s+(?P<what>[\w$]+|\{[^}]*\})\s*=\s*require\(\s*['"](?P<path>[^'"\n]+)['"]\s*\)""")
_EXPORT = re.compile(r"""^[ \t]*export\s+(?:(?P<list>\{[^}]*\})(?:\s*from\s*['"](?P<path>[^'"\n]+)['"])?|(?P<all>\*)(?:\s+as\s+(?P<as>[\w$]+))?\s+from\s*['"](?P<allpath>[^'"\n]+)['"]|default\s+(?P<default>[\w$]+)\s*;?[ \t]*$)""", re.MULTILINE)
_CALL = re.compile(r"(?<![\w$.])(?P<new>new\s+)?(?P<callee>(?:[A-Za-z_$][\w$]*\s*\??\.\s*)*[A-Za-z_$][\w$]*)\s*\(")
#: Words that a bracket follows without a call.
NOT_CALLS = frozenset("if for while switch catch return function typeof new await super import with do else throw delete void in of yield async constructor".split())
_QUOTED = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`|(?<=[=(,:\[!&|?{};])(?P<gap>\s*)/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*", re.DOTALL)
_LEADING = re.compile(r"(?:\b(?:export|default|async|public|private|protected|static|abstract|readonly|function|class|interface|type|const|let|var|get|set)\b\s*\*?\s*)+$")
_OPEN = {"(": ")", "{": "}", "[": "]"}


def blanked(text: str) -> str:
    """The text with quoted parts and comments as spaces; line breaks stay."""
    return _QUOTED.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def closing(code: str, at: int) -> int:
    """The place of the bracket that closes the one at ``at``; the end of the text if none does."""
    stack = []
    for k in range(at, len(code)):
        c = code[k]
        if c in _OPEN:
            stack.append(_OPEN[c])
        elif c in ")}]":
            while stack and stack[-1] != c:
                stack.pop()
            if stack:
                stack.pop()
            if not stack:
                return k
    return len(code)


def split_top(text: str, by: str = ",") -> list[str]:
    """Parts of ``text`` between separators outside brackets."""
    out, depth, start = [], 0, 0
    code = blanked(text)
    for k, c in enumerate(code):
        depth += (c in "({[<") - (c in ")}]" or (c == ">" and k and code[k - 1] != "="))
        if c == by and depth <= 0:
            out.append(text[start:k])
            start = k + 1
    return [part.strip() for part in [*out, text[start:]] if part.strip()]


def parameters(text: str) -> list[dict]:
    """Names, defaults and types of a parameter list."""
    out = []
    for part in split_top(text):
        rest = part.startswith("...")
        part = re.sub(r"^(?:(?:public|private|protected|readonly)\s+)+", "", part.removeprefix("..."))
        head, _, default = part.partition("=")
        if head.strip().startswith(("{", "[")):
            end = closing(head, 0) if head.strip() else 0
            head, kind = head[: end + 1], head[end + 1 :].lstrip(" :")
            name = ", ".join(n.strip().split(":")[0].strip() for n in head.strip()[1:-1].split(",") if n.strip())
        else:
            name, _, kind = head.partition(":")
        optional = name.strip().endswith("?") or bool(default.strip())
        if name.strip(" ?"):
            out.append({"name": name.strip(" ?"), "default_value": default.strip() or None, "is_rest": rest, "is_optional": optional, "type_name": kind.strip() or None})
    return out


def short_hash(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()[:16]


class _File:
    """Entities of one file, in the order of the text."""

    def __init__(self, path: str, text: str):
        self.path, self.text, self.code = path, text, blanked(text)
        self.line_starts = [0, *(m.end() for m in re.finditer("\n", text))]
        self.rows: list[dict] = []
        #: Bodies of functions, methods and classes: (start, end, row).
        self.scopes: list[tuple[int, int, dict]] = []
        stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
        kind = "esm" if re.search(r"^[ \t]*(?:import|export)\b", self.code, re.MULTILINE) else "commonjs"
        self.module = self.add("module", stem, 0, len(text), module_type=kind)

    def place(self, at: int) -> tuple[int, int]:
        from bisect import bisect_right

        line = bisect_right(self.line_starts, at)
        return line, at - self.line_starts[line - 1]

    def add(self, kind: str, name: str, at: int, end: int, **more) -> dict:
        line, column = self.place(at)
        end_line, end_column = self.place(max(at, end - 1))
        row = {"kind": kind, "name": name, "uri": entity_uri(self.path, kind, name, line), "file_path": self.path, "line_number": line, "column_number": column}
        row |= {"end_line": end_line, "end_column": end_column + 1, "body_hash": short_hash(self.text[at:end]), "docstring": self.docstring(at), "at": at} | more
        self.rows.append(row)
        return row

    def docstring(self, at: int) -> str | None:
        """A /** comment */ that ends just before."""
        before = self.text[max(0, at - 4000) : at].rstrip()
        before = _LEADING.sub("", before).rstrip()
        if before.endswith("*/") and (start := before.rfind("/**")) >= 0 and "*/" not in before[start:-2]:
            return re.sub(r"(?m)^\s*\*? ?", "", before[start + 3 : -2]).strip() or None
        return None

    def flags(self, m: re.Match) -> dict:
        return {"is_exported": bool(m["export"]), "is_default_export": bool(m["default"]) if "default" in m.groupdict() else False}

    def inside(self, at: int, kinds: tuple[str, ...]) -> dict | None:
        """The innermost scope of these kinds around a place."""
        found = [(start, row) for start, end, row in self.scopes if start <= at < end and row["kind"] in kinds]
        return max(found, key=lambda x: x[0])[1] if found else None

    def body(self, at: int) -> tuple[int, int]:
        """Start and end of the block that follows the parameter list opened at ``at``."""
        shut = closing(self.code, at)
        k = shut + 1
        while k < len(self.code) and self.code[k] not in "{;\n":
            k += 1
        while k < len(self.code) and self.code[k].isspace():
            k += 1
        return (k, closing(self.code, k) + 1) if k < len(self.code) and self.code[k] == "{" else (shut + 1, shut + 1)

    def scan(self) -> list[dict]:
        self.classes()
        self.functions()
        self.arrows()
        for m in _INTERFACE.finditer(self.code):
            end = closing(self.code, m.end() - 1) + 1 if self.code[m.end() - 1] == "{" else self.line_end(m.end())
            self.add("interface", m["name"], m.start("name"), end, implements=_names(m["extends"]), type_parameters=_names(m["types"]), **self.flags(m))
        self.variables()
        self.imports_and_exports()
        self.scoped()
        self.calls()
        order = {id(r): k for k, r in enumerate(sorted(self.rows, key=lambda r: (r["at"], r["kind"] != "module")))}
        for row in self.rows:
            row["ordinal"] = order[id(row)]
        return sorted(self.rows, key=lambda r: r["ordinal"])

    def line_end(self, at: int) -> int:
        end = self.code.find("\n", at)
        return len(self.code) if end < 0 else end

    def classes(self) -> None:
        for m in _CLASS.finditer(self.code):
            end = closing(self.code, m.end() - 1) + 1
            row = self.add("class", m["name"], m.start("name"), end, extends_class=m["extends"], implements=_names(m["implements"]), type_parameters=_names(m["types"]), is_abstract=bool(m["abstract"]), **self.flags(m))
            self.scopes.append((m.end() - 1, end, row))
            self.members(row, m.end(), end - 1)

    def members(self, owner: dict, start: int, end: int) -> None:
        at = start
        while at < end:
            m = _METHOD.search(self.code, at, end)
            if not m:
                self.properties(owner, at, end)
                return
            self.properties(owner, at, m.start())
            opened = m.end() - 1
            first, last = self.body(opened)
            words, name = m["words"].split(), m["name"]
            if name in NOT_CALLS and name != "constructor" or (last == first and "abstract" not in words):
                at = m.end()
                continue
            row = self.add("method", name, m.start("name"), last, parent_uri=owner["uri"], parameters=parameters(self.text[opened + 1 : closing(self.code, opened)]), is_async="async" in words, is_generator=bool(m["star"]), is_static="static" in words, is_private="private" in words or name.startswith("#"), is_protected="protected" in words, is_constructor=name == "constructor", is_getter="get" in words, is_setter="set" in words, is_abstract="abstract" in words, is_arrow_function=False, is_exported=False, is_default_export=False, scope=owner["name"])
            self.scopes.append((first, last, row))
            self.parameter_rows(row, opened)
            at = max(last, m.end())

    def properties(self, owner: dict, start: int, end: int) -> None:
        at = start
        while at < end and (m := _PROPERTY.search(self.code, at, end)):
            words, name = m["words"].split(), m["name"]
            stop = max(m.end(), m.start() + 1)
            if m["type"] or m["init"] is not None or words or self.code[m.start() : m.end()].strip().endswith(";"):
                if name not in NOT_CALLS:
                    if m["init"] and m["init"].rstrip().endswith(("{", "[", "(")):
                        stop = closing(self.code, m.start("init") + len(m["init"].rstrip()) - 1) + 1
                    self.add("property", name, m.start("name"), stop, parent_uri=owner["uri"], type_name=m["type"], init=self.text[m.start("init") : m.end("init")].strip() or None if m["init"] is not None else None, is_static="static" in words, is_private="private" in words or name.startswith("#"), is_protected="protected" in words, is_readonly="readonly" in words, scope=owner["name"])
            at = stop

    def parameter_rows(self, owner: dict, opened: int) -> None:
        for p in owner["parameters"]:
            found = re.compile(rf"(?<![\w$]){re.escape(p['name'].split(',')[0])}(?![\w$])").search(self.code, opened)
            at = found.start() if found else opened
            self.add("parameter", p["name"], at, at + len(p["name"]), parent_uri=owner["uri"], parameters=[p], init=p["default_value"], type_name=p["type_name"], docstring=None)

    def functions(self) -> None:
        for m in _FUNCTION.finditer(self.code):
            first, last = self.body(m.end() - 1)
            name = m["name"] or "default"
            row = self.add("function", name, m.start("name") if m["name"] else m.start() + len(m[0]) - len(m[0].lstrip()), last, parameters=parameters(self.text[m.end() : closing(self.code, m.end() - 1)]), is_async=bool(m["async"]), is_generator=bool(m["star"]), is_arrow_function=False, **self.flags(m))
            self.scopes.append((first, last, row))
            self.parameter_rows(row, m.end() - 1)

    def arrows(self) -> None:
        for m in _ARROW.finditer(self.code):
            if not m["name"] and not m["default"]:
                continue
            k = m.end()
            while k < len(self.code) and self.code[k].isspace():
                k += 1
            last = closing(self.code, k) + 1 if k < len(self.code) and self.code[k] in _OPEN else self.line_end(k)
            at = m.start("name") if m["name"] else m.start()
            group = "params" if m["params"] is not None else "one"
            row = self.add("function", m["name"] or "<arrow_function>", at, last, parameters=parameters(self.text[m.start(group) : m.end(group)]), is_async=bool(m["async"]), is_generator=False, is_arrow_function=True, **self.flags(m))
            self.scopes.append((k, last, row))
            self.parameter_rows(row, m.start(group))

    def variables(self) -> None:
        functions = {row["at"] for row in self.rows if row["kind"] == "function"}
        for m in _VARIABLE.finditer(self.code):
            if m.start("name") not in functions:
                init = self.text[m.start("init") : m.end("init")].strip() if m["init"] is not None else None
                self.add("variable", m["name"], m.start("name"), m.end(), declared=m["word"], type_name=m["type"], init=init or None, is_exported=bool(m["export"]))

    def imports_and_exports(self) -> None:
        for pattern in (_IMPORT, _REQUIRE):
            for m in pattern.finditer(self.text):
                if self.code[m.start() : m.start() + len(m[0])].strip()[:5] not in ("impor", "const", "let {", "var {") and not self.code[m.start() :].lstrip().startswith(("import", "const", "let", "var")):
                    continue
                what = (m["what"] or "").strip()
                named = re.search(r"\{([^}]*)\}", what)
                symbols = [re.split(r"\s+as\s+|\s*:\s*", s.strip())[0].removeprefix("type ") for s in named[1].split(",") if s.strip()] if named else []
                alias = re.search(r"\*\s+as\s+([\w$]+)", what)
                default = re.match(r"[\w$]+", what)
                kind = "side_effect" if not what else "namespace" if alias else "named" if named and not default else "default"
                if default:
                    symbols = [default[0], *symbols]
                stem = m["path"].rsplit("/", 1)[-1].rsplit(".", 1)[0] or m["path"]
                typed = bool("type" in m.groupdict() and m["type"])
                self.add("import", f"import_{stem}", m.start() + len(m[0]) - len(m[0].lstrip()), m.end(), module_path=m["path"], imported_symbols=symbols, import_type=kind, alias=alias[1] if alias else None, is_type_only=typed, docstring=None)
        named = {r["name"]: r for r in self.rows if r["kind"] in ("function", "class", "variable", "interface")}
        for m in _EXPORT.finditer(self.text):
            at = m.start() + len(m[0]) - len(m[0].lstrip())
            if not self.code[at:].startswith("export"):
                continue
            for part in split_top(m["list"][1:-1]) if m["list"] else [m["default"] or "*"]:
                source, _, alias = re.sub(r"\s+as\s+", "\0", part).partition("\0")
                path = m["path"] or m["allpath"]
                kind = "default" if m["default"] else "all" if m["all"] else "named"
                self.add("export", source[:50], at, m.end(), export_type=kind, alias=alias or m["as"] or None, is_re_export=bool(path), source_module=path, docstring=None)
                if not path and source in named:
                    named[source]["is_exported"] = True
                    named[source]["is_default_export"] = kind == "default"

    def scoped(self) -> None:
        for row in self.rows:
            if row["kind"] in ("function", "variable", "class", "interface"):
                owner = self.inside(row["at"], ("function", "method")) or self.inside(row["at"], ("class",))
                row["scope"] = owner["name"] if owner and owner is not row else "global"

    def calls(self) -> None:
        declared = {row["at"] for row in self.rows if row["kind"] in ("function", "method")}
        for m in _CALL.finditer(self.code):
            callee = re.sub(r"\s+|\?", "", m["callee"])
            if callee in NOT_CALLS or m.start("callee") in declared or re.search(r"function\s*\*?\s*$", self.code[: m.start()][-20:]):
                continue
            owner = self.inside(m.start(), ("function", "method"))
            args = split_top(self.text[m.end() : closing(self.code, m.end() - 1)])
            self.add("call", callee, m.start("callee"), m.end(), callee_name=callee, caller_uri=(owner or self.inside(m.start(), ("class",)) or self.module)["uri"], arguments=args, is_method_call="." in callee, docstring=None, body_hash=None)
            if owner:
                owner.setdefault("calls", []).append(callee)
        variables = {r["name"] for r in self.rows if r["kind"] == "variable"}
        for start, end, row in self.scopes:
            if row["kind"] in ("function", "method"):
                words = re.findall(_NAME, self.code[start:end])
                row["accesses"] = sorted(variables & set(words))


def _names(text: str | None) -> list[str]:
    return [re.split(r"[<\s]", part)[0] for part in split_top(text or "")]


def extract_file(path: str, text: str) -> list[dict]:
    """Entities of one file, in order, as rows of ``ENTITY``."""
    names = ENTITY.fieldNames()
    return [{c: row.get(c) for c in names} for row in _File(path, text).scan()]


def extract(files: DataFrame, parser: Callable[[str, str], list[dict]] = extract_file) -> DataFrame:
    """Entities of files (path, content); content is bytes or text.

    Another ``parser`` (path, text) may stand in, such as one over a syntax
    tree; its rows have the fields of ``ENTITY``.
    """
    ship(files.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                if content is None:
                    continue
                text = content if isinstance(content, str) else bytes(content).decode("utf-8", "replace")
                rows = parser(path, text)
                yield pd.DataFrame({c: pd.Series([r[c] for r in rows], dtype=object) for c in ENTITY.fieldNames()})

    return files.select("path", "content").mapInPandas(run, ENTITY)


def resolved_calls(entities: DataFrame) -> DataFrame:
    """(src, dst) call edges between functions and methods.

    A method of a variable made by ``new`` is one of that class.  Any other
    name is looked up in its own file, where the last definition wins, then
    among what the file imports; a method call matches by its last part.
    """
    defs = entities.where("kind in ('function', 'method')").select("file_path", "name", "uri", "ordinal")
    last = F.row_number().over(Window.partitionBy("file_path", "name").orderBy(F.desc("ordinal")))
    defs = defs.withColumn("rank", last).where("rank = 1").select("file_path", "name", F.col("uri").alias("dst"))
    calls = entities.where("kind in ('function', 'method') and calls is not null").select(F.col("uri").alias("src"), "file_path", F.explode("calls").alias("callee")).distinct()
    calls = calls.withColumn("name", F.substring_index("callee", ".", -1)).withColumn("symbol", F.substring_index("callee", ".", 1))
    imported = module_imports(entities).select("file_path", F.col("target").alias("to"), F.explode("imported_symbols").alias("symbol"))

    made = entities.where("kind = 'variable'").select("file_path", F.col("name").alias("symbol"), F.regexp_extract("init", r"^new\s+([A-Za-z_$][A-Za-z0-9_$]*)", 1).alias("class")).where("class <> ''").distinct()
    homes = entities.where("kind = 'class'").select("file_path", F.col("name").alias("class"), F.col("file_path").alias("to"))
    homes = homes.unionByName(imported.select("file_path", F.col("symbol").alias("class"), "to")).distinct()
    classes = entities.where("kind = 'class'").select(F.col("file_path").alias("to"), F.col("name").alias("class"), F.col("uri").alias("owner"))
    methods = entities.where("kind = 'method'").select(F.col("parent_uri").alias("owner"), "name", F.col("uri").alias("dst"))
    on_instance = calls.where("callee like '%.%'").join(made, ["file_path", "symbol"]).join(homes, ["file_path", "class"]).join(classes, ["to", "class"]).join(methods, ["owner", "name"])
    on_instance = on_instance.select("src", "callee", "dst").distinct()

    rest = calls.join(on_instance.select("src", "callee").distinct(), ["src", "callee"], "left_anti")
    local = rest.join(defs, ["file_path", "name"]).select("src", "callee", "dst")
    # An import brings the function itself, or an object whose method is called.
    far = rest.join(imported, ["file_path", "symbol"]).join(defs.withColumnRenamed("file_path", "to"), ["to", "name"])
    far = far.join(local.select("src", "callee").distinct(), ["src", "callee"], "left_anti").select("src", "callee", "dst")
    return on_instance.unionByName(local).unionByName(far).select("src", "dst").distinct()


def module_imports(entities: DataFrame) -> DataFrame:
    """Imports whose path leads to a known file: (file_path, target, imported_symbols).

    Candidates for a path are the file itself, then each extension, then an
    index file of the folder; the first that exists wins.
    """
    modules = entities.where("kind = 'module'").select(F.col("file_path").alias("target"))
    imports = entities.where("kind = 'import' and module_path like '.%'").select("file_path", "module_path", "imported_symbols")
    ends = ["", *(f".{e}" for e in ("ts", "tsx", "js", "jsx", "mjs", "cjs")), *(f"/index.{e}" for e in ("ts", "tsx", "js", "jsx"))]
    joined = F.concat(F.regexp_replace("file_path", r"[^/]*$", ""), F.col("module_path"))
    tried = imports.withColumn("base", normal_path(joined))
    tried = tried.select("*", F.posexplode(F.transform(F.array(*map(F.lit, ends)), lambda e: F.concat(F.col("base"), e))).alias("rank", "target"))
    found = tried.join(modules, "target")
    return found.groupBy("file_path", "module_path").agg(F.min_by(F.struct("target", "imported_symbols"), "rank").alias("x")).select("file_path", "x.target", "x.imported_symbols")


def normal_path(path: Column) -> Column:
    """A path without ``.`` and ``..`` steps, by folding over its parts."""
    parts = F.filter(F.split(path, "/"), lambda p: p != ".")

    def step(done: Column, part: Column) -> Column:
        back = (part == "..") & (F.size(done) > 0)
        return F.when(back, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(part)))

    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def uri_of(file_path: Column, kind: str, name: Column, line: Column) -> Column:
    """The identity of an entity as a column."""
    if kind == "module":
        return F.concat(F.lit(BASE), file_path, F.lit("#module"))
    return F.concat(F.lit(BASE), file_path, F.lit(f"#{kind}_"), F.regexp_replace(name, "[^A-Za-z0-9_]+", "_"), F.lit("_"), line.cast("string"))
