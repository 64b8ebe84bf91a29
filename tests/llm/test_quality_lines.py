import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from check import rows_of
from proofgrid.llm import line_dedup, quality_rules, queries
from proofgrid.llm.oracles import QUALITY_SQL

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_same_rows_as_sql(spark, sf, duck, name):
    df = queries.QUERIES[name](spark, sf)
    cur = duck.execute(queries.ORACLES[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(cols, cur.fetchall())


def measures(text):
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    grams = Counter(zip(w, w[1:], w[2:]))
    cover = {p for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover)


def test_measures_on_odd_rows(spark, odd):
    got = quality_rules.verdicts(odd).collect()
    want = [(r["doc_id"], *measures(r["text"])) for r in odd.collect()]
    assert sorted([(r["doc_id"], *(r[m] for m in quality_rules.MEASURES)) for r in got], key=str) == sorted(want, key=str)
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
    assert quality_rules.verdicts(odd.limit(0)).count() == 0
    assert quality_rules.kept_documents(odd).columns == odd.columns


def test_a_bad_host_takes_its_documents_along(spark):
    good = " ".join(f"word{i}" for i in range(80))
    rows = [(i, "x", "bad") for i in range(300)] + [(1000, good, "bad"), (1001, good, "new")]
    rows += [(2000 + i, good if i % 10 else "x", f"host{i % 7}") for i in range(700)] + [(5000, good, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    kept = {r["doc_id"] for r in quality_rules.verdicts(docs).filter("kept").collect()}
    assert 1000 not in kept and {1001, 5000} <= kept and len(kept) == 632
    assert {r["doc_id"] for r in quality_rules.kept_documents(docs).collect()} == kept


def rejected_hosts(rows, rules=quality_rules.Rules()):
    """Brute force over (host, text): counts, moments, posterior bound."""
    counts = defaultdict(lambda: [0, 0])
    for host, text in rows:
        n, chars, symbols, dups, repeated = measures(text)
        fails = n < rules.min_words or 100 * repeated > rules.max_repeat_percent * n or 100 * symbols > rules.max_symbol_percent * chars
        fails = fails or rules.words_per_dup_line * dups > n or not rules.min_word_chars * n <= chars <= rules.max_word_chars * n
        if host is not None:
            counts[host][0] += 1
            counts[host][1] += fails
    rates = [(f / n, n) for n, f in counts.values() if n >= 2]
    a = b = 1.0
    if rates:
        mean = min(max(sum(r for r, _ in rates) / len(rates), 1e-6), 1 - 1e-6)
        spread = max(sum(r * r for r, _ in rates) / len(rates) - (sum(r for r, _ in rates) / len(rates)) ** 2 - sum(r * (1 - r) / (n - 1) for r, n in rates) / len(rates), 1e-9)
        strength = min(max(mean * (1 - mean) / spread - 1, 1e-3), rules.max_strength)
        a, b = mean * strength, (1 - mean) * strength
    bound = {}
    for host, (n, f) in counts.items():
        m = (f + a) / (n + a + b)
        bound[host] = m - rules.deviations * (m * (1 - m) / (n + a + b + 1)) ** 0.5
    return {h for h, x in bound.items() if x > max(rules.max_host_rate, a / (a + b))}


def host_table(spark):
    good = " ".join(f"word{i}" for i in range(80))
    kinds = {"short": "x", "symbols": good + " #$%&" * 30, "dups": "\n".join(["some words in a line"] * 20 + [good]), "long": " ".join(f"averyveryverylongword{i}" for i in range(80))}
    rows = [(i, good if i // 60 % 10 else "x", f"host{i % 60}") for i in range(3000)]                          # many hosts, a tenth fails
    for k, (name, (n, failing)) in enumerate({"b70": (400, 70), "b80": (150, 80), "b88": (1000, 88), "b90": (120, 90), "small": (4, 100), "half": (400, 45)}.items()):
        rows += [(10_000 * (k + 1) + i, list(kinds.values())[i % 4] if i % 100 < failing else good, name) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string")


def test_hosts_that_fail_mostly_among_many_good_ones(spark):
    docs = host_table(spark)
    rows = docs.collect()
    bad = rejected_hosts([(r["source"], r["text"]) for r in rows])
    assert bad == {"b70", "b80", "b88", "b90"}
    out = quality_rules.verdicts(docs)
    assert {r["source"] for r in out.filter("NOT base_failed AND NOT kept").collect()} == bad
    kept = {r["doc_id"] for r in out.filter("kept").collect()}
    assert kept == {r["doc_id"] for r in out.filter(~F.col("base_failed") & ~F.col("source").isin(*bad)).collect()}
    assert {r["doc_id"] for r in quality_rules.kept_documents(docs).collect()} == kept


def test_bad_hosts_in_sql(spark, tmp_path):
    import duckdb

    docs = host_table(spark)
    docs.write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    want = {(i, bool(k)) for i, k in con.execute(f"SELECT doc_id, kept FROM ({QUALITY_SQL})").fetchall()}
    assert {(r["doc_id"], r["kept"]) for r in quality_rules.verdicts(docs).collect()} == want


def without_lines(docs, least=10):
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    head = {}
    for i, t in docs:
        if i is not None:
            for x in (t or "").split("\n"):
                head[key(x)] = min(i, head.get(key(x), i))
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        keep = [x for x in lines if i is None or len(key(x)) < least or head[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return out


@pytest.mark.parametrize("cells", [1, 3, 256])
def test_lines_of_odd_rows(spark, odd, cells):
    found = line_dedup.with_bitmaps(odd, cells=cells)
    assert "n_words" in found.columns and "_text" in found.columns
    got = [(r[0], r[1], r[2], r[3]) for r in found.select("doc_id", "n_lines", "n_dropped", line_dedup.kept_text(found["text"], found["keep_runs"])).collect()]
    assert sorted(got, key=str) == sorted(without_lines([(r["doc_id"], r["text"]) for r in odd.collect()]), key=str)
    assert line_dedup.with_bitmaps(odd.limit(0)).count() == 0


def test_a_line_of_every_document(spark):
    rows = [(i, f"own line number {i}\nThe line that every document has\nown end {i} of text") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.deduplicated(docs, cells=8).collect()}
    assert got == {i: t for i, _, _, t in without_lines(rows)}
    assert hashlib.sha256(got[0].encode()).hexdigest() == hashlib.sha256(rows[0][1].encode()).hexdigest()


def test_clashing_columns(spark):
    rows = [(1, "a line of some length", 9, 8, "r", "d"), (2, "a line of some length\nx", 9, 8, "r", "d")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_lines int, n_dropped int, _row string, doc string")
    got = sorted(map(tuple, line_dedup.deduplicated(docs).collect()))
    assert got == [(1, "a line of some length", 9, 8, "r", "d"), (2, "x", 9, 8, "r", "d")]
    assert sorted((r["doc_id"], r["n_lines"], r["n_dropped"]) for r in line_dedup.with_bitmaps(docs).collect()) == [(1, 1, 0), (2, 2, 1)]
    assert quality_rules.kept_documents(docs.withColumn("source", docs["doc"])).columns == [*docs.columns, "source"]
