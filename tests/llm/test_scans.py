"""Operators that look at one text at a time, against plain forms of their rules."""

import collections
import hashlib
import math
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lattica.llm import decontaminate, jaccard, langid, linededup, mixing, pii, quality, rules, secrets, tokens
from lattica.llm.common import slices

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t", "en", "a", 3), (4, "word", "en", None, 4), (4, "word", "en", None, 4), (None, "no id here", "en", "a", 10), (6, "x" * 200_000 + " y", "de", "b", 200_002), (7, "é" * 70, "fr", "b", 70), (8, "1 2 3", "en", "b", 5)]


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


@pytest.fixture(scope="module")
def texts(data):
    found = [t for (t,) in duckdb.sql(f"select text from '{data}/documents.parquet' order by doc_id").fetchall()]
    rng = random.Random(5)
    alphabet = "AKIA09abcdef.@+- ():=\"'pPswordtokn_ey%é\n#*|$ aab"
    return found + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(3000)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


def chunks(texts, size=1 << 16):
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    yield from slices(batch, "text", size)


def test_slices_cover_all_rows():
    got = [(a, b) for a, b, _, _ in chunks(["ab", None, "", "c" * 100, "d"], 10)]
    assert got[0][0] == 0 and got[-1][1] == 5 and all(x[1] == y[0] for x, y in zip(got, got[1:]))


WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contamination(docs, items):
    """(n_words, n_hit, n_items, items_sha256, contaminated) of each text, by all windows of all items."""
    windows = collections.defaultdict(set)
    for item, text in items:
        w = WORDS.findall(low(text or ""))
        k = min(13, len(w))
        for s in range(len(w) - k + 1 if k else 0):
            windows[tuple(w[s : s + k])].add(item)
    for text in docs:
        w = WORDS.findall(low(text or ""))
        mark, found = [0] * len(w), set()
        for size in {len(x) for x in windows}:
            for s in range(len(w) - size + 1):
                if own := windows.get(tuple(w[s : s + size])):
                    mark[s : s + size] = [1] * size
                    found |= own
        names = sorted(found - {None})
        yield len(w), sum(mark), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), sum(mark) > 0 and 20 * sum(mark) >= len(w)


@pytest.mark.parametrize("few", [100_000, 0])
def test_decontamination_against_windows(spark, data, texts, monkeypatch, few):
    """Fingerprints broadcast, and joined by shuffling."""
    monkeypatch.setattr(decontaminate, "FEW", few)
    known = [(str(i), t) for i, t in duckdb.sql(f"select item_id, text from '{data}/benchmark.parquet'").fetchall()]
    items = [*known, ("s", "a a a"), ("t", "kleine wörter"), ("u", ""), ("v", None), ("s", "a b c d e f g h i j k l m"), (None, "only words of nobody"), ("w", " ".join(["one two"] * 20)), ("x", known[0][1])]
    more = ["a a a a b", "Zwei KLEINE Wörter x", known[0][1], "x " + known[1][1] + " y", None, "a b c d e f g h i j k l m n", "b c d e f g h i j k l m n", "here are only words of nobody", "one two " * 300, "x " * 150_000 + known[2][1]]
    own = [*texts, *more]
    docs = spark.createDataFrame([(k, t, "n") for k, t in enumerate(own)], "doc_id long, text string, n_hit string").repartition(5)
    got = {r["doc_id"]: tuple(r)[1:] for r in decontaminate.scan(docs, spark.createDataFrame(items, "item_id string, text string"), ["doc_id"]).collect()}
    want = dict(enumerate(contamination(own, items)))
    assert got == want and any(x[4] for x in want.values())
    kept = decontaminate.clean(docs, spark.createDataFrame(items, "item_id string, text string"))
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {k for k, x in want.items() if not x[4]}


def test_decontamination_defined_cases(spark, data):
    docs, items = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/benchmark.parquet")
    assert not any(r["n_hit"] for r in decontaminate.scan(docs, items.limit(0), ["doc_id"]).collect())
    assert decontaminate.scan(docs.limit(0), items, ["doc_id"]).count() == 0
    clash = docs.withColumn("n_hit", F.lit("x")).withColumn("text_key", F.lit("x")).withColumn("found", F.lit(1)).withColumn("rid", F.lit(1))
    found = decontaminate.scan(clash, items, ["doc_id", "n_hit", "rid"])
    assert found.columns == ["doc_id", "rid", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"] and found.count() == docs.count()
    assert decontaminate.clean(clash, items).columns == clash.columns


def test_tokens_are_the_librarys(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(3)
    alphabet = "aaabtsredlmvo'''  \n\t\r.,;!?12é日ßÉ٣ 　\x85İ😀Ⅳ²"
    every = texts + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(5000)]
    every += ["a" * 5000, " " * 1000, "x<|endoftext|>y <|endoftext|>", "don't we'll I've 'sa ''s 're 'v", "\n's", "'s't'rex", None]
    path = public_tokenizers.path("byte_bpe_50k.json")
    want = [len(e.ids) for e in Tokenizer.from_file(path).encode_batch([t or "" for t in every], add_special_tokens=False)]
    for limit in (1 << 20, 100):
        counter, got = tokens.Counter(path, known_limit=limit), []
        for _, _, raw, offsets in chunks(every):
            got += counter.count(raw, offsets).tolist()
        assert got == want


def test_secret_base_spans(texts):
    for text in texts:
        want = [("assign", m.start(), m.end()) for m in re.finditer(r"""((?a:(?i:password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
        want += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        want += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        assert secrets.find(text)[0] == sorted(want, key=lambda s: (s[1], secrets.KINDS.index(s[0])))


def least_cost(value, words=secrets.KNOWN):
    """The price of the cheapest segmentation, over all segments."""
    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    plain, best = low.translate(secrets._LEET), [0.0]
    for end in range(1, len(value) + 1):
        prices = []
        for start in range(end):
            own, n = value[start:end], end - start
            price = [secrets.CHARACTER * n]
            if n >= 3 and all(pair in secrets._NEXT for pair in zip(low[start:end], low[start + 1 : end])):
                price.append(secrets.WALK + math.log10(n))
            if n >= 3 and len(set(own)) == 1:
                price.append(secrets.REPEAT + math.log10(n))
            price += [secrets.DATE] * bool(secrets._DATE.fullmatch(own)) + [secrets.YEAR] * bool(secrets._YEAR.fullmatch(own))
            if (rank := words.rank.get(plain[start:end])) is not None:
                price.append(math.log10(rank + 1) + secrets.CHANGED * (own != plain[start:end]))
            prices.append(best[start] + min(price))
        best.append(min(prices))
    return best[-1]


def test_guess_costs():
    cost = secrets.guess_cost
    assert cost("password") < cost("p4ssword") < cost("xK9#mQ2$vL")
    assert cost("aaaaaaaaaaaa") < 4 and cost("qwertyuiop") < 4 and cost("19900101") < 6 and cost("") == 0
    rng = random.Random(7)
    parts = [*secrets.COMMON[:50], "qwerty", "rewq", "aaa", "1111", "1990", "19900101", "01/02/2003", "P4ss", "ababab", "edcvfr", "qazwsx", "é", "İ"]
    for _ in range(3000):
        value = "".join(rng.choice(parts) if rng.random() < 0.5 else "".join(rng.choice("ab1qwe90P$") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(0, 6)))
        assert cost(value) == pytest.approx(least_cost(value)), value
    own = secrets.Words(["zebrafish", "Quokka", "ab", "zebrafish"])
    assert own.rank == {"zebrafish": 1, "quokka": 2} and cost("zebrafishQuokka", own) == pytest.approx(least_cost("zebrafishQuokka", own))
    found = [(k, t[a:b]) for t in ("pwd: Tr0ub4dor&3xYz!", "passphrase is 'correct horse battery staple'", "the secret is something nice", "login: password1", "pwd: qwkzjvhxptlmrd", "passphrase: summerewq") for k, a, b in secrets.find(t)[1]]
    assert found == [("guess", "Tr0ub4dor&3xYz"), ("guess", "correct horse battery staple"), ("guess", "qwkzjvhxptlmrd")]


def test_words_are_ranked_by_documents(spark):
    rows = [("zebrafish swim zebrafish",), ("Zebrafish, they swim.",), ('key="quokkaquokka" x1longword longword2 tiny abc',), (None,), ("",)]
    ranked = secrets.ranked_words(spark.createDataFrame(rows, "text string"), most=3)[len(secrets.COMMON) :]
    assert ranked == ["swim", "zebrafish", "they"]
    assert secrets.ranked_words(spark.createDataFrame(rows, "text string").limit(0)) == secrets.COMMON


LONG = {
    "spaces": " " * 1_000_000,
    "letters": "a" * 1_000_000,
    "digits": "1" * 1_000_000,
    "at": "@" * 1_000_000,
    "brackets": "[ " * 500_000,
    "dots": "a." * 500_000,
    "words": "x dot y " * 100_000 + "a" * 200_000,
    "gap": "a" + " " * 500_000 + "at b" + " " * 500_000 + "dot",
    "numbers": "one " * 250_000,
    "pluses": "+1 " * 330_000,
    "mails": "a@b.co " * 140_000,
    "hidden mails": "a at b dot com " * 60_000,
    "glyphs": "\uff41" * 300_000,
    "addresses": "1.2.3.4 " * 120_000,
    "names": "token_" * 160_000,
    "values": "password: a" * 90_000,
    "keys": "key = " * 160_000,
    "secrets": "pwd: xK9#mQ2$vLzz " * 50_000,
    "walk": 'pwd: "' + "ab" * 500_000 + '"',
    "hex": "0123456789abcdef " * 60_000,
}


@pytest.mark.parametrize("name", LONG)
def test_a_megabyte_of_anything_is_fast(name):
    import time

    for scan in (pii.find, secrets.find):
        began = time.process_time()
        scan(LONG[name])
        assert time.process_time() - began < 6, scan


def test_added_spans_keep_apart():
    """Spans that the transducers add, against all pairs of spans."""
    rng = random.Random(8)
    parts = ["a@b.com", "jane at firma dot it", "j.doe [at] mail [dot] com", "one two three four five six seven eight nine zero one two", "+49 30 1234567", "10.0.0.1", "4111 1111 1111 1111", "ｊohn＠exаmple.com", "plus four nine three zero one two three four five", "x", ".", " dot "]
    for _ in range(400):
        text = " ".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        base, spans = pii.find(text)
        assert base == sorted(pii.plain(text), key=lambda s: (pii.KINDS.index(s[0]), s[1])) and set(base) <= set(spans) and len(set(spans)) == len(spans)
        for kind in pii.KINDS:
            own = [(a, b) for k, a, b in spans if k == kind]
            assert all(x[1] <= y[0] for x, y in zip(own, own[1:])), (text, own)
        assert all(0 <= a < b <= len(text) for _, a, b in spans)


def test_pii_base_spans(texts):
    rng = random.Random(4)
    more = ["".join(rng.choice("0123.- +()@a") for _ in range(rng.randint(0, 40))) for _ in range(5000)] + ["4111 1111 1111 1111", "256.1.1.1.2.3.4", "1" * 5000 + ".1.1.1"]
    for text in texts + more:
        want = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
        want += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
            digits = re.sub("[^0-9]", "", m[0])
            if 16 <= len(digits) <= 19 and sum(sum(divmod(int(x) * (1 + k % 2), 10)) for k, x in enumerate(digits[::-1])) % 10 == 0:
                want.append(("card", m.start(), m.end()))
        want += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
        base, spans = pii.find(text)
        assert base == want and set(base) <= set(spans)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("mail john dot doe at mail dot example dot com now", ("email", "john dot doe at mail dot example dot com")),
        ("j.doe [at] mail [dot] com", ("email", "j.doe [at] mail [dot] com")),
        ("call plus one five five five one two three four five six seven", ("phone", "plus one five five five one two three four five six seven")),
        ("write ｊohn＠exаmple.com", ("email", "ｊohn＠exаmple.com")),
        ("jo​hn@exa​mple.com", ("email", "jo​hn@exa​mple.com")),
    ],
)
def test_disguises_are_undone(text, want):
    found = [(k, text[a:b]) for k, a, b in pii.find(text)[1]]
    assert want in found


@pytest.mark.parametrize("text", ["look at the dot over there", "été à Paris", "one two", "at at dot dot"])
def test_plain_words_are_no_disguise(text):
    assert pii.find(text)[1] == []


def test_rule_counts(texts):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    at = 0
    for first, last, raw, offsets in chunks(texts):
        found = rules.Lines(raw, offsets)
        got = list(zip(np.diff(found.word_bounds), found.word_chars, found.repeated_lines(), found.repeated_words()))
        for k in range(last - first):
            text = texts[at]
            w = word.findall(text)
            grams = collections.Counter(zip(w, w[1:], w[2:]))
            hit = [0] * len(w)
            for i, gram in enumerate(zip(w, w[1:], w[2:])):
                if grams[gram] > 1:
                    hit[i : i + 3] = [1] * 3
            seen, repeats = set(), 0
            for line in text.split("\n"):
                if word.search(line):
                    repeats += line in seen
                    seen.add(line)
            assert tuple(got[k]) == (len(w), sum(map(len, w)), repeats, sum(hit))
            at += 1


def test_viterbi_is_the_best_of_all_labellings():
    import itertools

    rng = np.random.default_rng(0)
    field = rules.Field(rng.normal(size=(rules.N_FEATURES, 2)), rng.normal(size=(2, 2)))
    for n in (1, 2, 6):
        x = rng.normal(size=(n, rules.N_FEATURES))

        def score(y):
            return sum(x[t] @ field.weights[:, s] for t, s in enumerate(y)) + sum(field.moves[a, b] for a, b in zip(y, y[1:]))

        best = max(itertools.product((0, 1), repeat=n), key=score)
        assert tuple(field.decode(x)) == best


def test_field_learns_a_rule():
    rng = np.random.default_rng(1)
    chains = []
    for _ in range(60):
        x = rng.normal(size=(12, rules.N_FEATURES))
        chains.append((x, (x[:, 3] > 0).astype(np.int64)))
    field = rules.Field.trained(chains)
    right = np.mean([np.mean(field.decode(x) == y) for x, y in chains])
    assert right > 0.95
    assert rules.Field.trained([]).decode(np.ones((3, rules.N_FEATURES))).tolist() == [0, 0, 0]


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.identify(docs, langid.train(docs)).join(docs.select("doc_id", "lang"), "doc_id").where(langid.held_out("doc_id", 4, 2)).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in found) / len(found) > 0.97 and all(0 <= r["score"] <= 1 for r in found)


def test_unrelated_languages_and_none():
    assert langid._FAMILY["en"] == langid._FAMILY["de"] != langid._FAMILY["fr"] == langid._FAMILY["es"]
    x = langid.features(np.frombuffer(b"abcabc", dtype=np.uint8), np.array([0, 3, 6, 6]))
    assert np.allclose(x[0], x[1]) and not x[2].any()


def area(found):
    """The area under the curve of (score, quality) rows."""
    ranked = sorted(found)
    good = sum(q for _, q in ranked)
    return (sum(k + 1 for k, (_, q) in enumerate(ranked) if q) - good * (good + 1) / 2) / (good * (len(ranked) - good))


def test_quality_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    found = quality.score(docs, quality.train(docs, labels)).join(labels, "doc_id").where(langid.held_out("doc_id", 5, 0)).collect()
    assert area([(r["score"], r["quality"]) for r in found]) > 0.985


def test_kept_on_held_out_rows(spark):
    """The field learns from other rows than those it is held against."""
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    field = rules.train(docs, labels, where=~langid.held_out("doc_id", 5, 0))
    found = rules.apply(docs, field).join(labels, "doc_id").where(langid.held_out("doc_id", 5, 0)).where("not base_failed").collect()
    right = sum(r["kept"] == (r["quality"] == 1) for r in found) / len(found)
    print("kept", right, area([(r["content_share"], r["quality"]) for r in found]), len(found))
    assert right > 0.9


def test_marginals_are_sums_over_all_labellings():
    import itertools

    rng = np.random.default_rng(2)
    lengths = (1, 4, 2, 7)
    scores, moves = [rng.normal(size=(n, 2)) * 3 for n in lengths], rng.normal(size=(2, 2)) * 2
    first = np.repeat(np.cumsum([0, *lengths[:-1]]), lengths)
    node, pair = rules.marginals(np.concatenate(scores), moves, first, np.flatnonzero(first < np.arange(len(first))))
    want_node, want_pair = [], np.zeros((2, 2))
    for score in scores:
        n = len(score)
        each = {y: math.exp(sum(score[t, s] for t, s in enumerate(y)) + sum(moves[a, b] for a, b in zip(y, y[1:]))) for y in itertools.product((0, 1), repeat=n)}
        total = sum(each.values())
        want_node += [[sum(p for y, p in each.items() if y[t] == s) / total for s in (0, 1)] for t in range(n)]
        for y, p in each.items():
            for a, b in zip(y, y[1:]):
                want_pair[a, b] += p / total
    assert np.allclose(node, want_node) and np.allclose(pair, want_pair)


#: Names of the operators' own columns, as extra columns of the input.
CLASHES = "score n_words kept spans label picked_id picked_label own_id own_text own_lang rank id node tiles key n low high text_hash removed emptied copies same size taken hash_1 hash_2 one two found rid text_key keep_id keep_hash n_hit held_out predicted lang_pred".split()


def test_defined_cases(spark, odd, data):
    """Nulls, empty and long texts, repeated rows and clashing columns in, one row each out."""
    clash = odd.withColumns({name: F.lit("x") for name in CLASHES})
    labels = spark.read.parquet(f"{data}/labels.parquet").withColumns({name: F.lit("x") for name in ("label", "text", "own_rows", "picked_id")})
    labels = labels.unionByName(labels.where("doc_id in (3, 4)")).unionByName(labels.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    items = spark.read.parquet(f"{data}/benchmark.parquet")
    made = {
        "tokens": tokens.count_tokens(clash, "byte_bpe_50k.json"),
        "secrets": secrets.scan(clash, words=secrets.ranked_words(clash)),
        "pii": pii.scan(clash),
        "rules": rules.apply(clash, rules.train(clash, labels)),
        "language": langid.identify(clash, langid.train(clash)),
        "quality": quality.score(clash, quality.train(clash, labels)),
        "benchmark": decontaminate.scan(clash, items, ["doc_id"]),
        "mix": mixing.mix(clash, ["doc_id"]),
        "jaccard": jaccard.join(clash),
        "lines": linededup.dedup(clash),
    }
    for name, df in made.items():
        rows = df.collect()
        assert collections.Counter(r["doc_id"] for r in rows) == collections.Counter(r[0] for r in ODD), name
        assert df.columns == list(dict.fromkeys(df.columns)), name
    by_id = {r["doc_id"]: r for r in made["tokens"].collect()}
    assert (by_id[1]["n_bytes"], by_id[1]["n_tokens"]) == (0, 0) and by_id[7]["n_bytes"] == 140
    by_id = {r["doc_id"]: r for r in made["language"].collect()}
    assert [by_id[k]["lang_pred"] for k in (1, 2, 3, 8)] == ["und"] * 4 and by_id[1]["score"] == 0
    by_id = {r["doc_id"]: r for r in made["benchmark"].collect()}
    assert by_id[1]["n_words"] == 0 and by_id[1]["items_sha256"] == hashlib.sha256(b"").hexdigest()
    by_id = {r["doc_id"]: r for r in made["rules"].collect()}
    assert by_id[1]["base_failed"] and not by_id[1]["kept"]


def test_filters_keep_columns(spark, odd, data):
    """Stages that return documents: any further columns, repeated rows and nulls, and empty tables."""
    clash = odd.withColumns({name: F.lit("x") for name in CLASHES})
    items = spark.read.parquet(f"{data}/benchmark.parquet")
    steps = {
        "lines": linededup.apply,
        "near copies": jaccard.keep_one,
        "benchmark": lambda docs: decontaminate.clean(docs, items),
        "mixture": mixing.emit,
        "language": lambda docs: langid.identify(docs, langid.train(docs), keep=docs.columns),
    }
    for name, step in steps.items():
        made = step(clash)
        assert made.columns == clash.columns and made.count() > 0, name
        assert {r["copies"] for r in made.collect()} == {"x"}, name
        assert step(clash.limit(0)).count() == 0, name


def test_samples_are_bounded(spark):
    docs = spark.createDataFrame([(k % 3, f"text {k}", f"l{k}") for k in range(300)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k % 3, k % 2, 1) for k in range(60)], "doc_id long, quality int, label int")
    assert len(rules.sample(docs, labels, "quality", 2)) == 4
    assert len(langid.train(docs, rows=2, languages=5).langs) <= 5


def test_empty_tables(spark, odd, data):
    none = odd.limit(0)
    labels = spark.read.parquet(f"{data}/labels.parquet")
    assert tokens.count_tokens(none, "byte_bpe_50k.json").count() == 0
    assert secrets.scan(none).count() == pii.scan(none).count() == 0
    assert langid.train(none) is None and langid.identify(none, None).count() == 0
    assert {r["lang_pred"] for r in langid.identify(odd, None).collect()} == {"und"}
    assert quality.train(none, labels.limit(0)) is None
    assert {r["score"] for r in quality.score(odd, None).collect()} == {0.5}
    assert rules.apply(none, rules.train(none, labels.limit(0))).count() == 0
