"""Cases that the corpus operators once left out."""

import __spark_entry__
import duckdb
from test_groups import similar

from lattica.llm import pii, secrets


def near_lines(texts, width=4, percent=80):
    """Removed line numbers of each text, by all pairs of lines."""
    lines = []
    for at, text in enumerate(texts):
        own = [x for line in (text or "").split("\n") if (x := line.strip(" \t\n\x0b\x0c\r").lower())]
        lines += [(at, k, frozenset(x[j : j + width] for j in range(max(1, len(x) - width + 1)))) for k, x in enumerate(own)]
    union, seen, gone = similar([s for _, _, s in lines], percent), set(), [[] for _ in texts]
    for k, (at, number, _) in enumerate(lines):
        root = union.root(k)
        if root in seen:
            gone[at].append(number)
        seen.add(root)
    return gone


def test_lines_with_one_edit(spark, data, tmp_path):
    """Short lines that differ in little, and the lines of the smallest table, against all pairs."""
    texts = [t for (t,) in duckdb.sql(f"select text from '{data}/documents.parquet' where n_chars < 6000 order by doc_id").fetchall()]
    texts += ["Copyright 2019 by the authors of this small program.", "copyright 2020 by the authors of this small program.", "quite another line of about the same length as those"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = __spark_entry__.queries()["op4_line_dedup"](spark, str(tmp_path)).collect()
    assert {r["doc_id"]: r["removed"] for r in rows} == {k: ",".join(map(str, gone)) for k, gone in enumerate(near_lines(texts))}
    assert near_lines(texts)[-3:] == [[], [0], []]


def test_secrets_under_longer_names():
    """Credential words inside identifiers, which have no word boundary around them."""
    secret = "x@7!kQz#9Lm$2vB"
    for name in ("DB_PASSWORD", "db_password", "dbPassword", "client_secret", "AWS_SECRET_ACCESS_KEY", "PGPASSWORD", "spring.datasource.password", "password_prod", "tokenValue", "api key", "APIKey2", "login"):
        for text in (f'{name}="{secret}"', f"{name}: '{secret}'", f"  {name} = {secret}\n", f"note: {name}={secret}"):
            assert [(kind, text[a:b]) for kind, a, b in secrets.find(text)[1]] == [("guess", secret)], text
    key = "AWS_SECRET_ACCESS_KEY=wJalrXUtnFEMI/K7MDENG/bPxRfiCYzQ9"
    assert [key[a:b] for _, a, b in secrets.find(key)[1]] == [key.split("=")[1]]
    for text in (f'author: "{secret}"', f'tokenizer = "{secret}"', f'compass: "{secret}"', f"login.example.com:8080/{secret}", "token_" * 200_000):
        assert secrets.find(text)[1] == [], text[:40]


def test_secrets_found_before_are_found(data):
    """What the pattern with word boundaries found stays, over the smallest table."""
    import re

    words = r"pass(?:word|wd|phrase|code)?|pwd|secret|token|(?:api|access|private|secret)[ _-]?key|auth(?:orization)?|bearer|credentials?|login"
    old = re.compile(rf"""\b(?:{words})\b["']?[ \t]*(?:[:=]>?|->|\bis\b)[ \t]*(?:"([^"\n]+)"|'([^'\n]+)'|([^\s"'<>,;]+))""", re.IGNORECASE | re.ASCII)
    for (text,) in duckdb.sql(f"select text from '{data}/documents.parquet' where text is not null").fetchall():
        assert {m.end() for m in old.finditer(text)} <= {m.end() for m, _ in secrets.values(text)}


def test_mail_addresses_in_words():
    """An "at" before a plain domain, and the domains of countries."""
    for mail in ("jane at example.com", "jane dot doe at firma dot it", "jane.doe at mail.firma.online", *(f"j dot a dot doe at firma dot {end}" for end in "us in at be dk fi no me nz online com".split())):
        text = f"write, {mail} now"
        assert ("email", text.index(mail), text.index(mail) + len(mail)) in pii.find(text)[1], mail
    for text in ("he was at home. In the end", "meet at 10.am", "look at the dot over there", "jane at example.nowhere", "a at " * 50_000, "a dot " * 50_000 + "b at c", "x" * 300_000):
        assert pii.find(text)[1] == [], text[:40]
