"""Whole small projects: what is found in them and how it is linked."""

import collections

import pytest

from lattica import pipeline
from lattica.engine import QueryEngine
from lattica.operators.extract import extract_file


def kinds(path, text):
    return collections.Counter(r["kind"] for r in extract_file(path, text))


def test_five_functions():
    text = "function plus(x, y) { return x + y; }\nfunction minus(x, y) { return x - y; }\nfunction times(x, y) { return x * y; }\nfunction over(x, y) { return y ? x / y : 0; }\nfunction work(op, x, y) {\n  switch (op) {\n    case '+': return plus(x, y);\n    case '-': return minus(x, y);\n    case '*': return times(x, y);\n    default: return over(x, y);\n  }\n}\n"
    found = kinds("sums.js", text)
    assert (found["module"], found["function"], found["parameter"]) == (1, 5, 11)
    work = next(r for r in extract_file("sums.js", text) if r["name"] == "work" and r["kind"] == "function")
    assert work["calls"] == ["plus", "minus", "times", "over"]


def test_component_page_and_async():
    page = "import Head from '../components/Head';\nimport { load } from '../lib/remote';\n\nexport default function Home({ posts }) {\n  return (<div><Head title=\"it's\" />{posts.map(p => <p key={p.id}>{p.title}</p>)}</div>);\n}\n\nexport async function getStaticProps() {\n  const posts = await load(10);\n  return { props: { posts } };\n}\n"
    rows = {(r["kind"], r["name"]): r for r in extract_file("pages/index.jsx", page)}
    assert rows["function", "Home"]["is_default_export"] and rows["function", "getStaticProps"]["is_async"]
    assert rows["function", "getStaticProps"]["calls"] == ["load"]
    assert [r["module_path"] for k, r in rows.items() if k[0] == "import"] == ["../components/Head", "../lib/remote"]


@pytest.mark.parametrize(
    ("text", "kind", "path", "symbols"),
    [
        ("import a from 'm'", "default", "m", ["a"]),
        ("import * as a from 'm'", "namespace", "m", []),
        ("import a, { b as c } from \"m\"", "default", "m", ["a", "b"]),
        ("import 'm'", "side_effect", "m", []),
        ("import type { T } from './t'", "named", "./t", ["T"]),
        ("const { a, b } = require('m')", "named", "m", ["a", "b"]),
    ],
)
def test_imports(text, kind, path, symbols):
    row = next(r for r in extract_file("x.ts", text) if r["kind"] == "import")
    assert (row["import_type"], row["module_path"], row["imported_symbols"]) == (kind, path, symbols)


def test_code_in_strings_and_comments_is_no_code():
    text = "// function a() {}\n/* class B {} */\nconst s = 'function c() {}';\nconst t = `class D { m() {} }`;\nconst r = /function e\\(\\) \\{/;\nfunction real() { return \"call(me)\"; }\n"
    found = kinds("x.js", text)
    assert found["function"] == 1 and found["class"] == 0 and found["call"] == 0


LAYERS = {
    "db.js": "export async function findUser(id) { return id; }\nexport async function insertUser(u) { return u; }\n",
    "service.js": "import { findUser, insertUser } from './db';\nexport class Users {\n  async one(id) { return findUser(id); }\n  async add(u) { return insertUser(u); }\n}\n",
    "web.js": "import { Users } from './service';\nconst users = new Users();\nexport function handle(req) { return users.one(req.id); }\nfunction spare(a, b, c, d, e) { return a; }\n",
}


@pytest.fixture(scope="module")
def engine(spark):
    files = spark.createDataFrame(list(LAYERS.items()), "path string, content string")
    return QueryEngine(pipeline.from_files(spark, files.selectExpr("path", "encode(content, 'UTF-8') AS content")).graph)


def names(result, key):
    return sorted(r[key] for r in result.rows())


def test_layers(engine):
    assert names(engine.ask_sentence("Find functions that perform database operations"), "functionName") == ["add", "one"]
    assert names(engine.ask_sentence("Find functions with many parameters"), "functionName") == ["spare"]
    assert "spare" in names(engine.ask_sentence("Find unused functions"), "functionName")
    assert names(engine.ask_sentence("functions calling findUser"), "callerName") == ["one"]
    module = "http://codebase.local/db.js#module"
    assert names(engine.template("functions_in_module", module=module), "functionName") == ["findUser", "insertUser"]
    assert names(engine.template("variables_accessed_by_function", function="http://codebase.local/web.js#function_handle_3"), "varName") == ["users"]
    chain = engine.sparql("SELECT ?n WHERE { ?h code:hasName \"handle\" . ?h code:calls+ ?f . ?f code:hasName ?n }")
    assert names(chain, "n") == ["findUser", "one"]
