import hashlib
import re
from collections import Counter
from fractions import Fraction

import duckdb
from pyspark.sql import functions as F

from ledgerloom.llm import exact_dedup, mixing, url_filter, license_scan

DDL = "doc_id long, text string, source string"
ROWS = [(1, "a b", "s"), (2, "ab", "s"), (3, "a  b", "t"), (4, None, None), (5, "", "t"), (6, "c" * 50_000, "t"), (7, "c" * 50_000, "u"), (8, "d", "u"), (8, "d", "u"), (None, "e", "u"), (-9, " \t\n\v\f\r", "u")]


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, DDL).withColumns({"n": F.lit(1), "size": F.lit(2), "digest": F.lit("x"), "key": F.lit(0)})


def brute(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    out = []
    for i, t, _ in rows:
        group = [(-len(x or ""), k is None, k or 0, k) for k, x, _ in rows if norm(x) == norm(t)]
        keep = min(group)[3]
        out.append((i, keep, len(group), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=str)


def test_exact_dedup(spark):
    got = exact_dedup.exact_dedup(frame(spark), all_digests=True)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(ROWS)
    lazy = exact_dedup.exact_dedup(frame(spark))
    assert sorted((tuple(r)[:4] for r in lazy.collect()), key=str) == [r[:4] for r in brute(ROWS)]
    for digests in (True, False):
        assert exact_dedup.exact_dedup(frame(spark, ROWS[:0]), all_digests=digests).count() == 0


def test_exact_dedup_ids_of_any_type(spark):
    rows = [("b", "x y"), ("a", "xy"), ("c", "x  y"), ("d", "x  y"), (None, "x  y"), ("e", None)]
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id string, text string"), all_digests=True)
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in got.collect()} == {"a": ("c", 5, False), "b": ("c", 5, False), "c": ("c", 5, True), "d": ("c", 5, False), None: ("c", 5, False), "e": ("e", 1, True)}
    edge = [(-(1 << 63), "same"), (5, "same")]
    assert {r.keep_id for r in exact_dedup.exact_dedup(spark.createDataFrame(edge, "doc_id long, text string")).collect()} == {-(1 << 63)}


def test_water_fill():
    assert mixing.water_fill([10, 10], [1, 2], 20, 3) == [Fraction(20, 3), Fraction(40, 3)]
    assert mixing.water_fill([1, 100], [2, 1], 101, 3) == [3, 98]
    assert mixing.water_fill([0, 5], [1, 1], 5, 3) == [0, 5] and mixing.water_fill([], [], 0, 3) == []


def test_mixing(spark):
    rows = [(i, "w " * (i % 7), f"s{i % 4}" if i % 5 else None) for i in range(200)] + [(500, "x " * 3000, "tiny"), (501, None, "none"), (7, "w " * 3, "s3")]
    got = mixing.mix(frame(spark, rows)).collect()
    assert len(got) == len(rows) and sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(frame(spark, rows)).collect()), key=str)
    for s in {r.source for r in got}:
        part = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in part) - part[0].target) <= 0.5 and all(0 <= r.taken <= 3 * r.size for r in part)
        assert sum(r.size for r in part) == part[0].source_size and part[0].target <= 3 * part[0].source_size
    total = sum(r.size for r in got)
    assert abs(sum({r.source: r.target for r in got}.values()) - total) < 1e-6
    assert mixing.mix(frame(spark, rows[:0])).count() == 0
    again = mixing.repeated(frame(spark, rows[:50]), mixing.mix(frame(spark, rows[:50])))
    assert again.columns == frame(spark, rows).columns and again.count() > 0


def test_repeated_null_and_shared_ids(spark):
    """Every row comes as often as its own share of the mix says, also with a null id or one that others have."""
    rows = [(None, "n " * 40, "s"), (None, "m " * 30, "s"), (None, "o " * 50, None), (1, "a " * 60, "s"), (1, "b " * 20, "t"), (1, "c " * 20, "t"), (1, "c " * 20, "t"), (2, "", "t"), (None, None, "t"), (3, "e " * 10, "t")]
    docs = frame(spark, rows)
    for budget in (None, 100, 1000):
        mixed = mixing.mix(docs, budget=budget)
        want = Counter()
        for r in mixed.collect():
            if r.size:
                want[r.doc_id, r.source, r.size] += int(r.taken / r.size + 0.5)
        out = mixing.repeated(docs, mixed)
        assert out.columns == docs.columns
        times = Counter((r.doc_id, r.text, r.source) for r in out.collect())
        got = Counter()
        for (i, t, source), n in times.items():
            got[i, source, len(t.split())] += n
        assert got == +want
    assert times == {row: 3 * n for row, n in Counter(rows).items() if row[1]}  # 1000 words are above all caps


def test_url_filter(spark):
    changes = [("bad.example", 10, "add"), ("bad.example", 20, "remove"), ("bad.example", 30, "add"), ("ok.example/x/y", 5, "add"), ("both.example", 5, "remove"), ("both.example", 5, "add"), (None, 1, "add"), ("bad.example", 12, "add"), ("z.example", 3, "?")]
    urls = ["http://www.bad.example/a", "https://sub.bad.example:80/q?x", "http://bad.example", "http://ok.example/x/y/z", "http://ok.example/x/yy", "http://user@both.example./", None, "no url", "http://notbad.example/", "http://ok.example/x/y/#f"]
    days = [9, 10, 19, 20, 29, 30, 500, None]
    rows = [(i * 10 + j, u, d) for i, u in enumerate(urls) for j, d in enumerate(days)] * 2
    caps = spark.createDataFrame(rows, "page_id long, url string, fetch_day int").withColumns({"entry": F.lit("q"), "host": F.lit("q"), "span": F.lit("q"), "w": F.lit(1)})
    got = url_filter.evaluate(caps, spark.createDataFrame(changes, "entry string, day int, action string")).collect()
    assert len(got) == len(rows)
    bad = lambda d: d is not None and (10 <= d < 20 or d >= 30)
    for r in got:
        i, d = r.page_id // 10, r.fetch_day
        want = "bad.example" if i in (0, 1, 2) and bad(d) else "ok.example/x/y" if i in (3, 9) and d is not None and d >= 5 else "both.example" if i == 5 and d is not None else None
        assert (r.entry, r.blocked) == (want, want is not None), r
    empty = spark.createDataFrame([], "entry string, day int, action string")
    assert url_filter.evaluate(caps, empty).where("blocked").count() == 0 and url_filter.evaluate(caps.limit(0), empty).count() == 0


def test_license_scan(spark):
    texts = ["x\nReleased under the MIT License.\ny", "LICENSED under the Apache-License, version 2.0", "Licensed under CC BY NC 4", None, "", "word", "license", "Released under the license of MIT things here", "the\nMIT License released\nunder the MIT license",
             "z " * 20000 + "\nThis work is licensed under the GNU General Public License, version 3.\n" + "q " * 20000, "Licensed under the Apache License, Version 2.0.\n" * 3]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(0, texts[0], "s"), (None, texts[1], "s")]
    docs = frame(spark, rows)
    got = {(r.doc_id, r.line, r.license): round(r.score, 9) for r in license_scan.scan(docs).collect()}
    want = {}
    for i, t, _ in rows:
        lines = (t or "").split("\n")
        for k, x in [*enumerate(lines), *([(-1, " ".join(lines))] if len(lines) > 1 else [])]:
            g = set(license_scan.bigrams_of(x))
            for name, template in license_scan.TEMPLATES:
                b = set(license_scan.bigrams_of(template))
                dice = 2 * len(g & b) / (len(g) + len(b))
                if 100 * dice >= 80:
                    want[i, k, name] = max(want.get((i, k, name), 0), round(dice, 9))
    assert got == want
    assert license_scan.per_document(docs, license_scan.scan(docs)).count() == len(rows)
    assert license_scan.scan(docs.limit(0)).count() == 0


def test_drawn_list_matches_sql(spark, tmp_path):
    from ledgerloom.llm import queries

    urls = [(1, "http://a.b.example/x"), (2, "https://www.c.example"), (3, None), (3, None), (4, "broken")]
    spark.createDataFrame(urls, "page_id long, url string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    got = queries.op1_url_filters(spark, str(tmp_path))
    want = con.execute(url_filter.ORACLE)
    names = [c[0] for c in want.description]
    assert sorted(map(str, (tuple(r[n] for n in names) for r in got.collect()))) == sorted(map(str, want.fetchall()))
