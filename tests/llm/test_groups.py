"""Operators over the whole corpus, and the pipeline, against brute force."""

import collections
import pathlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lattica.llm import components, decontaminate, jaccard, langid, linededup, mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


class Union:
    def __init__(self, n):
        self.up = list(range(n))

    def root(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def similar(sets, percent):
    """Components of sets by Jaccard similarity, from an inverted index of all values."""
    union, first, index = Union(len(sets)), {}, collections.defaultdict(list)
    for k, own in enumerate(sets):
        if not own:
            continue
        if own in first:
            union.join(k, first[own])
            continue
        first[own] = k
        common = collections.Counter()
        for value in own:
            common.update(index[value])
            index[value].append(k)
        for other, n in common.items():
            if 100 * n >= percent * (len(own) + len(sets[other]) - n):
                union.join(k, other)
    return union


def shingles(text, width):
    w = WORD.findall(low(text or ""))
    return frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()


def brute_lines(rows):
    """Removed line numbers of each row, by all pairs of lines."""
    lines, width = [], linededup.SHINGLE
    for at, (doc_id, text) in sorted(enumerate(rows), key=lambda x: (x[1][0] is None, x[1][0] or 0)):
        number = 0
        for line in (text or "").split("\n"):
            line = line.strip(" \t\n\x0b\x0c\r").lower()
            if line:
                lines.append((at, number, frozenset(line[k : k + width] for k in range(max(1, len(line) - width + 1)))))
                number += 1
    union = similar([s for _, _, s in lines], 80)
    gone, seen = collections.defaultdict(list), set()
    for k, (at, number, _) in enumerate(lines):
        root = union.root(k)
        if root in seen:
            gone[at].append(number)
        seen.add(root)
    return gone, collections.Counter(at for at, _, _ in lines)


@pytest.fixture(scope="module")
def small(spark, data):
    """Some documents of the smallest table, and cases made for the operators."""
    docs = spark.read.parquet(f"{data}/documents.parquet").where("n_chars < 6000")
    base = " ".join(f"w{k}" for k in range(100))
    made = [(9001, base), (9002, base), (9003, base.replace("w50", "zz")), (9004, base + " tail end"), (9005, None), (9006, ""), (9007, " \n"), (9008, "a b"), (9009, "A b"), (9010, "one line\nother line\none  line"), (9011, base.replace("w1 ", "q ")), (9011, base), (9012, "x" * 60_000)]
    more = spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in made], SCHEMA)
    return docs.unionByName(more.select(*docs.columns))


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_join_against_all_pairs(small, width, percent):
    rows = [(r["doc_id"], r["text"]) for r in small.where("doc_id <> 9011").collect()]
    sets = [shingles(t, width) for _, t in rows]
    union = similar(sets, percent)
    least = {}
    for k, (doc_id, _) in enumerate(rows):
        least[union.root(k)] = min(doc_id, least.get(union.root(k), doc_id))
    want = {rows[k][0]: (len(sets[k]), least[union.root(k)] if sets[k] else rows[k][0]) for k in range(len(rows))}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(small.where("doc_id <> 9011"), width=width, percent=percent).collect()}
    assert got == want


def test_join_defined_cases(spark, small):
    extra = small.withColumn("node", F.lit("x")).withColumn("tiles", F.lit(1)).withColumn("text_hash", F.lit("y"))
    rows = jaccard.join(extra).where("doc_id >= 9000").collect()
    found = collections.defaultdict(list)
    for r in rows:
        found[r["doc_id"]].append((r["n_shingles"], r["component_id"]))
    assert found[9005] == [(0, 9005)] and found[9006] == [(0, 9006)] and found[9008] == [(1, 9008)] and found[9009] == [(1, 9008)]
    assert sorted(c for _, c in found[9011]) == [9001, 9001] and len(rows) == 13
    nulls = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (5, "a b c d"), (None, None)], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in jaccard.join(nulls).collect()) == [(0, 0), (0, 5), (0, 5), (5, 5)]
    assert jaccard.join(nulls.limit(0)).count() == 0


def test_keep_one(spark):
    base = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(2, base, "x"), (1, base + " more", "x"), (3, "alone", "x"), (3, "alone", "x"), (None, "none", "x"), (4, None, "x")], "doc_id long, text string, found_id string")
    assert sorted((r["doc_id"] or 0) for r in jaccard.keep_one(docs).collect()) == [0, 1, 3, 4]
    other = " ".join(f"v{k}" for k in range(60))
    docs = spark.createDataFrame([(1, base), (1, other), (None, base + " more"), (None, other + " more"), (None, "alone"), (None, None), (None, "")], "doc_id long, text string")
    # Different texts under one id stay; copies without an id go, and so does none that is alone.
    assert sorted(map(str, (tuple(r) for r in jaccard.keep_one(docs).collect()))) == sorted(map(str, [(1, base), (1, other), (None, "alone"), (None, None), (None, "")]))


def test_tiles_of_similar_sets_meet():
    """Sets that differ as much as allowed share a tile, whatever their sizes."""
    import numpy as np

    rng = np.random.default_rng(0)
    for percent in (80, 90):
        for n in [*range(1, 60), 100, 333, 1000]:
            for _ in range(6):
                a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
                drop = int(rng.integers(0, len(a) * (100 - percent) // 100 + 1))
                b = rng.permutation(a)[drop:]
                grow = (len(b) * 100 - percent * len(a)) // percent
                b = np.unique(np.concatenate([b, rng.integers(0, 2**63, max(0, grow)).astype(np.uint64)]))
                common = len(np.intersect1d(a, b))
                if 100 * common >= percent * (len(a) + len(b) - common):
                    assert set(jaccard.tile_keys(a, percent).tolist()) & set(jaccard.tile_keys(b, percent).tolist()), (percent, n)


@pytest.mark.parametrize("seen", [64, 5])
def test_large_groups_in_blocks(spark, monkeypatch, seen):
    """A group beyond one block gives the same components as all pairs, its tiles dealt from the start too."""
    import random

    monkeypatch.setattr(components, "SHARE", 64 // seen)
    monkeypatch.setattr(components, "SEEN", seen)

    rng = random.Random(1)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(400):
        words = list(base)
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(40)}"
        rows.append((k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    union = similar([shingles(t, 3) for _, t in rows], 90)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.join(docs).collect()}
    assert got == {k: union.root(k) for k in range(400)}


def test_components_of_long_chains(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (103, 101), (7, 7)]
    got = {r["node"]: r["root"] for r in components.components(spark, spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert got == dict.fromkeys(range(41), 0) | dict.fromkeys((100, 101, 103), 100)


def test_lines_against_all_pairs(small):
    rows = [(r["doc_id"], r["text"]) for r in small.where("doc_id <> 9011").collect()]
    gone, count = brute_lines(rows)
    want = {doc_id: (count[k], ",".join(map(str, gone[k]))) for k, (doc_id, _) in enumerate(rows)}
    got = {r["doc_id"]: (r["n_lines"], r["removed"]) for r in linededup.dedup(small.where("doc_id <> 9011")).collect()}
    assert got == want


@pytest.mark.parametrize(("least", "most", "recall"), [(16, 40, 0.97), (41, 80, 0.98), (81, 300, 0.98)])
def test_recall_of_lines_by_length(spark, least, most, recall):
    """Pairs of generated lines with a similarity of 0.8 to 0.9: how many become one component."""
    import random
    import string

    rng, rows, pairs = random.Random(least), [], 0
    while pairs < 1500:
        line = "".join(rng.choice(string.ascii_lowercase + " ") for _ in range(rng.randint(least, most))).strip()
        other = list(line)
        for _ in range(rng.randint(1, max(1, len(line) // 40))):
            other[rng.randrange(len(other))] = rng.choice(string.ascii_lowercase)
        other = "".join(other).strip()
        a, b = ({x[k : k + 4] for k in range(max(1, len(x) - 3))} for x in (line, other))
        if a != b and 0.8 <= len(a & b) / len(a | b) <= 0.9:
            rows += [(2 * pairs, line), (2 * pairs + 1, other)]
            pairs += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    gone = sum(r["n_kept"] == 0 for r in linededup.dedup(docs).collect())
    print("recall", least, most, gone / pairs)
    assert gone / pairs >= recall


def test_many_lines_in_one_bucket(spark, monkeypatch):
    """A family beyond a bucket's bound is dealt in blocks, and one that is long from the start never lies in one task."""
    import random

    rng = random.Random(3)
    base = "a family of lines that differ in few characters, as forms of one template do, number "
    rows = [(k, f"{base}{rng.randrange(10**5):05d}") for k in range(700)] + [(1000 + k, f"line {k} of {rng.random()} its own {rng.random()}") for k in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {r["doc_id"]: r["n_kept"] for r in linededup.dedup(docs).collect()}
    assert sum(want.values()) == 51
    monkeypatch.setattr(linededup, "_BUCKET", 30)
    assert {r["doc_id"]: r["n_kept"] for r in linededup.dedup(docs).collect()} == want
    monkeypatch.setattr(components, "SHARE", 2)
    monkeypatch.setattr(components, "SEEN", 20)
    assert {r["doc_id"]: r["n_kept"] for r in linededup.dedup(docs).collect()} == want


def test_long_tiles_are_found(spark, monkeypatch):
    monkeypatch.setattr(components, "SHARE", 1)
    monkeypatch.setattr(components, "MOST_LONG", 2)
    tiles = spark.createDataFrame([(key, node) for key, n in ((1, 500), (2, 200), (3, 100), (4, 3)) for node in range(n)], "key long, node long")
    assert {r["key"] for r in components.long_tiles(spark, tiles, "t").collect()} == {1, 2}
    assert components.long_tiles(spark, tiles.where("key = 4"), "t") is None


def test_lines_defined_cases(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "a line here\n\nA LINE here", "x"), (4, "a line here", "x"), (5, "own words only", "x"), (5, "own words only", "x"), (None, "a line here\nkept by null id", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, removed string")
    got = [tuple(r) for r in linededup.apply(docs).collect()]
    assert sorted(got, key=str) == sorted([(1, None, "x"), (2, "", "x"), (3, "a line here\n", "x"), (5, "own words only", "x"), (5, "own words only", "x"), (None, "kept by null id", "x")], key=str)
    assert linededup.dedup(docs.limit(0)).count() == 0 and linededup.apply(docs.limit(0)).count() == 0


def expected_mix(docs):
    con = duckdb.connect()
    con.register("docs", docs)
    return con.execute(mixing.ORACLE_SQL.replace("{documents}", "docs")).fetchdf()


def test_mix_against_sql(spark, small):
    want = expected_mix(small.toPandas())
    got = mixing.mix(small, keep=["doc_id"]).toPandas()
    key = ["doc_id", "size", "source_size", "target", "copies", "taken"]
    assert sorted(map(tuple, got[key].round(6).values.tolist())) == sorted(map(tuple, want[key].round(6).values.tolist()))
    again = mixing.mix(small, keep=["doc_id"]).toPandas()
    assert sorted(map(tuple, got[key].values.tolist())) == sorted(map(tuple, again[key].values.tolist()))


def test_mix_properties(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = mixing.mix(docs.withColumn("size", F.lit("x")).withColumn("rank", F.lit(1)), keep=["doc_id", "source"]).collect()
    by = collections.defaultdict(list)
    for r in rows:
        assert r["taken"] <= 2 * r["size"]
        by[r["source"]].append(r)
    total = sum(own[0]["source_size"] for own in by.values())
    assert abs(sum(own[0]["target"] for own in by.values()) - 1.5 * total) < 1
    for own in by.values():
        assert own[0]["target"] <= 2 * own[0]["source_size"] + 1e-6
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own)


def test_targets_share_the_excess(spark):
    sizes = spark.createDataFrame([(False, "a", 10), (False, "b", 1000), (False, "c", 1000), (True, "", 0)], "no_source boolean, source string, source_size long")
    got = {(r["no_source"], r["source"]): r["target"] for r in mixing.targets(sizes).collect()}
    # Weights 3, 1, 2, 3: the first stops at 20, the last at 0, and the third at twice its size.
    assert got[False, "a"] == 20 and got[True, ""] == 0 and got[False, "c"] == pytest.approx(1996.6667, abs=1e-3) and got[False, "b"] == pytest.approx(998.3333, abs=1e-3)


def test_mix_defined_cases(spark):
    rows = [(1, None, None), (2, "", "a"), (3, "w " * 50, "a"), (3, "w " * 50, "a"), (None, "x y", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs, keep=["doc_id"]).collect()
    assert len(got) == 5 and {r["size"] for r in got if r["doc_id"] == 1} == {0}
    assert mixing.mix(docs.limit(0), keep=["doc_id"]).count() == 0
    assert mixing.emit(docs).columns == docs.columns


def test_emitted_copies_are_the_mixtures(spark, small, monkeypatch):
    """Rows come as often as the mixture takes them, repeated rows together."""
    monkeypatch.setattr(mixing, "_CHUNK", 2)
    docs = small.unionByName(small.where("doc_id % 7 = 1")).unionByName(small.where("doc_id % 7 = 1")).withColumn("copy", F.lit("x")).withColumn("extra", F.create_map(F.lit("a"), F.lit(1)))
    want = collections.Counter()
    for r in mixing.mix(docs, keep=["doc_id"]).collect():
        want[r["doc_id"]] += r["copies"]
    got = collections.Counter(r["doc_id"] for r in mixing.emit(docs).collect())
    assert got == +want and mixing.emit(docs).columns == docs.columns


def brute_pipeline(spark, data):
    """The pipeline's rows by plain forms of its stages; languages by the trained model, row by row."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    named = {r["doc_id"]: r for r in langid.identify(docs, langid.train(docs)).collect()}
    rows = [r.asDict() for r in docs.collect() if named[r["doc_id"]]["lang_pred"] != "und" and named[r["doc_id"]]["score"] >= corpus_pipeline.LEAST_SCORE]
    gone, count = brute_lines([(r["doc_id"], r["text"]) for r in rows])
    for k, r in enumerate(rows):
        r["text"] = linededup.without(r["text"], gone[k]) if gone[k] else r["text"]
    rows = [r for k, r in enumerate(rows) if not (count[k] and len(gone[k]) == count[k])]
    rows.sort(key=lambda r: r["doc_id"])
    union = similar([shingles(r["text"], 5) for r in rows], 80)
    rows = [r for k, r in enumerate(rows) if union.root(k) == k]
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = set()
    for (text,) in duckdb.sql(f"select text from '{data}/benchmark.parquet'").fetchall():
        w = word.findall(low(text))
        windows |= {tuple(w[s : s + 13]) for s in range(len(w) - 12)}
    clean = []
    for r in rows:
        w = word.findall(low(r["text"]))
        hit = [0] * len(w)
        for s in range(len(w) - 12):
            if tuple(w[s : s + 13]) in windows:
                hit[s : s + 13] = [1] * 13
        if not (any(hit) and 20 * sum(hit) >= len(w)):
            clean.append(r)
    import pandas as pd

    mixed = expected_mix(pd.DataFrame(clean))
    texts = {r["doc_id"]: r["text"] for r in clean}
    return sorted((i, texts[i]) for i, n in zip(mixed["doc_id"], mixed["copies"]) for _ in range(int(n)))


def test_pipeline_against_brute_force(spark, data):
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    got = corpus_pipeline.run(spark, data)
    assert got.columns == spark.read.parquet(f"{data}/documents.parquet").columns
    assert sorted((r["doc_id"], r["text"]) for r in got.collect()) == brute_pipeline(spark, data)


def test_language_stage_rejects(spark):
    """Texts in no language, in none that is wanted, and those that could be in two."""
    import random

    rng = random.Random(1)
    words = {"aa": ["alpha", "amber", "arrow", "anchor"], "zz": ["zonk", "zulu", "zest", "zirkon"]}
    rows = [(k, " ".join(rng.choice(words[lang]) for _ in range(20)), lang, "s", 1) for k in range(200) for lang in [("aa", "zz")[k % 2]]]
    rows += [(1001, "12345 !!", "aa", "s", 1), (1002, None, "aa", "s", 1), (1003, "alpha zonk " * 30 + "amber zulu " * 30, None, "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = langid.train(docs)
    score = {r["doc_id"]: r["score"] for r in langid.identify(docs, model).collect()}
    left = {r["doc_id"] for r in corpus_pipeline.language(spark, docs, "").collect()}
    assert left == {k for k, s in score.items() if s >= corpus_pipeline.LEAST_SCORE and k not in (1001, 1002)} and set(range(200)) <= left
    only = langid.identify(docs, model, keep=docs.columns, wanted=("aa",)).collect()
    assert {r["lang"] for r in only if r["doc_id"] < 200} == {"aa"}
    assert langid.identify(docs, model, keep=docs.columns, least_score=1.01).count() == 0


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None), (None, None, None, None, None), (1, "", None, "a", 0), (2, "x" * 300_000, "en", None, 1), (3, "some words here", "en", "a", 1), (3, "some words here", "en", "a", 1), (4, " " * 300_000 + "z", "de", "b", 1)]])
def test_pipeline_of_odd_tables(spark, data, tmp_path, rows):
    extra = spark.createDataFrame(rows, SCHEMA).withColumns({name: F.lit("x") for name in ("copies", "copy", "removed", "text_hash", "first_row", "text_key", "same")})
    extra.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{data}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path))
    assert found.columns == extra.columns and {r["doc_id"] for r in found.collect()} <= {2, 3, 4}


def test_stages_keep_columns(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(30)
    for name, step in corpus_pipeline.STAGES:
        path = str(pathlib.Path(tmp_path, name))
        step(spark, docs, data).write.parquet(path)
        again = spark.read.parquet(path)
        assert again.schema == docs.schema
        docs = again
    assert decontaminate.scan(docs.limit(0), spark.read.parquet(f"{data}/benchmark.parquet"), ["doc_id"]).count() == 0


def test_queries_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert {f"op{k}_" for k in range(1, 11)} == {m[0] for n in names if (m := re.match(r"op\d+_", n))} and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_forest_stops_once_all_rows_are_connected(monkeypatch):
    """F1 (op4): a block that is one family costs a pass from its first row, not a look from every row."""
    import numpy as np

    from lattica.llm import components

    class Counted:
        looks = 0

        def __getattr__(self, name):
            return getattr(np, name)

        def arange(self, *args):
            self.looks += 1
            return np.arange(*args)

    counted = Counted()
    monkeypatch.setattr(components, "np", counted)
    maps, sizes = np.full((60, 1), 255, np.uint64), np.full(60, 8)
    found = components.forest(maps, sizes, np.zeros(60, int), False, 80)
    assert sorted(b for _, b in found) == list(range(1, 60)) and {a for a, _ in found} == {0} and counted.looks <= 3


def test_signatures_are_filled_in_few_turns(monkeypatch):
    """F1 (op4): an empty bin looks at each other bin once, in the order of the plain sequence."""
    import numpy as np

    from lattica.llm import textscan

    mix, calls, bins = textscan.mix, [], linededup.BANDS * linededup.ROWS
    rng = np.random.default_rng(7)
    sets = [np.unique(rng.integers(0, 1 << 48, n).astype(np.uint64)) for n in [*range(1, 12)] * 3 + [40, 200, 900]]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    linededup.signatures(sets[0], bounds[:2])
    monkeypatch.setattr(textscan, "mix", lambda *a: calls.append(1) or mix(*a))
    got = linededup.signatures(np.concatenate(sets), bounds)
    assert len(calls) < bins
    for values, row in zip(sets, got.tolist(), strict=True):
        own = {}
        for v in values.tolist():
            own.setdefault((v >> 16) * bins >> 32, v)
        for spot in range(bins):
            source, attempt = spot, 0
            while source not in own:
                attempt += 1
                source = int(mix(np.array([spot], np.uint64), attempt)[0]) % bins
            assert row[spot] == own[source]


def test_pieces_hold_buckets_whole():
    """F1 (op4): rows reach their buckets packed, every row once, and those of the longest buckets stay out."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(5)
    records = rng.integers(-(1 << 63), (1 << 63) - 1, (500, linededup._RECORD))
    records[:, 1] = rng.integers(1, 1 << 31, 500)
    records[:, 4:] = rng.choice(rng.integers(-(1 << 63), (1 << 63) - 1, 900), (500, linededup.BANDS))
    column = pa.array([b"", *(r.tobytes() for r in records), records[:7].tobytes()], pa.binary())
    assert (linededup._records(column.slice(1, 500)) == records).all() and not len(linededup._records(column.slice(0, 1)))
    without = np.unique(records[:3, 4:])
    want = {(key, *r[[0, 1, 2, 3]].tolist()) for r in records for key in set(r[4:].tolist()) - set(without.tolist())}
    alone = {key for key, n in collections.Counter(key for key, *_ in want).items() if n == 1}
    batch = linededup._in_pieces(linededup._records(column), 8, without)
    got, seen = set(), collections.Counter()
    for rows in batch.column(1):
        met = linededup._met([np.frombuffer(rows.as_buffer(), np.uint32).reshape(-1, linededup._ROW)])
        assert [*map(tuple, met[:2].T.tolist())] == sorted(map(tuple, met[:2].T.tolist()))
        got |= set(map(tuple, met.T.tolist()))
        seen.update(set(met[0].tolist()))
    assert 1 < batch.num_rows <= 8 and {r for r in got if r[0] not in alone} == {r for r in want if r[0] not in alone} and set(seen.values()) == {1}
