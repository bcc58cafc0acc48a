import hashlib
import re

from pyspark.sql import functions as F

from judgespark.llm import secrets
from llm.helpers import DOCS, docs, sample_texts

BASE = {
    "assign": (re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), 2, 8),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 32),
}


def brute_base(text):
    out = []
    for order, (name, (pattern, group, least)) in enumerate(BASE.items()):
        out += [(m.start(), order, m.end(), name) for m in pattern.finditer(text or "") if len(m[group]) >= least]
    return sorted(out)


def brute_all(text, reach):
    found = []
    for order, k in enumerate(secrets.KINDS):
        for m in re.finditer(k.pattern, text or ""):
            if len(m[k.group]) >= k.least:
                found.append((m.start(), order, m.end(), k))
    out = []
    for s, o, e, k in found:
        meets = any(
            k2.role != k.role and "secret" in (k.role, k2.role) and s2 <= e + reach and e2 >= s - reach
            for s2, _, e2, k2 in found
        )
        if not k.weak or meets:
            out.append((s, o, e))
    return sorted(out)


def brute_links(text, reach):
    found = []
    for order, k in enumerate(secrets.KINDS):
        found += [(m.start(), order, m.end(), k) for m in re.finditer(k.pattern, text or "") if len(m[k.group]) >= k.least]
    out = []
    for s, o, e, k in found:
        parts = [
            (max(s2 - e, s - e2, 0), s2, o2, e2)
            for s2, o2, e2, k2 in found
            if k2.role != k.role and "secret" in (k.role, k2.role) and s2 <= e + reach and e2 >= s - reach
        ]
        if k.weak and parts:
            out.append((s, o, e, *min(parts)[1:]))
    return sorted(out)


def check(spark, texts):
    rows = secrets.scan(docs(spark, texts)).collect()
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in rows}
    linked = {r.doc_id: [tuple(s) for s in r.links] for r in rows}
    for i, t in (texts.items() if isinstance(texts, dict) else enumerate(texts)):
        assert linked[i] == brute_links(t, secrets.REACH), t
    texts = dict(enumerate(texts)) if isinstance(texts, list) else texts
    for i, t in texts.items():
        assert got[i] == brute_all(t, secrets.REACH), t
        assert [s for s in got[i] if s[1] < 3] == [s[:3] for s in brute_base(t)], t
    return got


def test_edges(spark):
    key = "AKIA" + "Z9" * 8
    got = check(
        spark,
        [
            None, "", "token=abcdefg", 'API_KEY: "abcdefgh"', "secret=token: abcdefghijk", f"é {key}x{key}",
            "AKIA" * 3, "a" * 31 + " " + "b" * 32, "password==" + "x" * 9, "tokentoken =  'q.q.q.q.q'" * 3,
            "user: bob pwd: hunter2", "user: bob " + "x " * 200 + "pwd: hunter2", "pwd: hunter2 and http://h.example/a",
            "ſecret=abcdefghij toKen=abcdefghij", f"{key} {'Q' * 44}",
        ],
    )
    assert got[10] and not got[11] and len(got[12]) == 2


def test_sample(spark):
    check(spark, sample_texts())


def test_many_matches_in_one_text(spark):
    check(spark, ["token=abcdefgh1 " * 5000 + "user: bob"])


def test_links_name_the_nearest_part(spark):
    text = "user: bob pwd: hunter2 and http://h.example/a"
    out = secrets.scan(docs(spark, [text, None])).orderBy("doc_id").select(secrets.link_listing(F.col("links")).alias("x"))
    assert [r.x for r in out.collect()] == [
        "login:0:9>short:10:22,short:10:22>login:0:9,endpoint:27:45>short:10:22", ""
    ]


def test_repeated_rows_empty_table_and_clashing_columns(spark):
    rows = [(1, "token=abcdefgh", None, None, None)] * 2 + [(None, "token=abcdefgh", None, None, None)]
    df = spark.createDataFrame(rows, DOCS).withColumn("spans", F.lit(1)).withColumn("kind", F.lit(1))
    assert [len(r.spans) for r in secrets.scan(df).collect()] == [1, 1, 1]
    assert secrets.scan(spark.createDataFrame([], DOCS)).count() == 0


def test_listing(spark):
    text = "token=abcdefgh " + "0" * 32
    out = secrets.scan(docs(spark, [text])).select(secrets.listing(F.col("spans")).alias("x")).collect()[0].x
    assert out == "assign:0:14,hex:15:47"
    assert hashlib.sha256(out.encode()).hexdigest() == secrets.scan(docs(spark, [text])).select(
        F.sha2(secrets.listing(secrets.sure(F.col("spans"))), 256).alias("x")
    ).collect()[0].x
