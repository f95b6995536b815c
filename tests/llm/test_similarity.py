import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import ann, components, ngram_join, substring_dedup, toxicity

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed=1, n=60):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdé") for _ in range(draw.randint(1, 5)))
    passage = [word() for _ in range(70)]
    rows = []
    for i in range(n):
        ws = [word() for _ in range(draw.choice([0, 1, 3, 4, 5, 6, 80, 200]))]
        if i % 3 == 0:
            ws = ws[:40] + passage + ws[40:]
        if rows and i % 4 == 1:
            ws = draw.choice(rows)[1].split()
            for _ in range(draw.choice([0, 0, 1, 2, 4])):
                if ws:
                    ws[draw.randrange(len(ws))] = word()
        rows.append((i * 2, draw.choice([" ", "\n", "  "]).join(ws)))
    loop = ["go", "on"] * 100
    return rows + [(900, None), (901, ""), (902, " ".join(loop)), (903, " ".join(loop[:120])), (904, rows[0][1].upper()), (2, rows[1][1]), (None, rows[3][1]), (905, "w" * 20_000 + " " + " ".join(passage))]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("q") for c in ("class", "node", "label", "key", "start", "rid", "n_words")})


def brute_components(rows, n=5, percent=80):
    sets = []
    for _, t in rows:
        ws = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(ws[k : k + n]) for k in range(len(ws) - n + 1)} if len(ws) >= n else {tuple(ws)} if ws else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            same_id = rows[i][0] is not None and rows[i][0] == rows[j][0]
            if same_id or (both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both)):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)]


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_components(spark, seed):
    rows = corpus(seed)
    got = ngram_join.jaccard_components(frame(spark, rows)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute_components(rows)))


def test_jaccard_small_cells(spark, monkeypatch):
    """Cells of two classes make the joining across cells do the work."""
    monkeypatch.setattr(ngram_join, "CELL", 2)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(base[:i] + ["x"] * (i % 2) + base[i:])) for i in range(30)] + [(99, " ".join(base[:60]))]
    got = ngram_join.jaccard_components(frame(spark, rows)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute_components(rows)))


@pytest.mark.parametrize("kinds", [1, 40])
def test_jaccard_large_group(spark, kinds):
    """Thousands of near copies, all of one text or of some that are just not linked, in cells of 512."""
    draw = random.Random(kinds)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(2600):
        ws = base[:66] + [f"k{i % kinds}x{j}" for j in range(34)] if kinds > 1 else list(base)
        ws[draw.randrange(100)] = f"e{i}"
        rows.append((i, " ".join(ws)))
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(frame(spark, rows)).collect()}
    assert got == {i: i % kinds for i in range(2600)}


def test_jaccard_limit_holds_back_links(spark, monkeypatch):
    """Kinds whose points may all link, while one text links two of them: rounds go on until that pair is listed."""
    monkeypatch.setattr(ngram_join, "CELL", 3)
    monkeypatch.setattr(ngram_join, "MORE_PAIRS", 2)
    shared, own = [f"w{i}" for i in range(1280)], [[f"k{k}x{i}" for i in range(220)] for k in range(4)]
    texts = [shared[: 30 * i] + [f"e{k}x{i}"] + shared[30 * i + 1 :] + own[k] for k in range(4) for i in range(8)]
    rows = [(i, " ".join(ws)) for i, ws in enumerate(texts)] + [(50, " ".join(shared + own[0][:110] + own[1][:110]))]
    got = ngram_join.jaccard_components(frame(spark, rows)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute_components(rows)))
    assert {r.component_id for r in got} == {0, 16, 24}


def test_jaccard_empty(spark):
    assert ngram_join.jaccard_components(frame(spark, [])).count() == 0
    assert [tuple(r) for r in ngram_join.jaccard_components(frame(spark, [(1, None)])).select("n_shingles", "component_id").collect()] == [(0, 1)]


def test_count_tree():
    draw = np.random.default_rng(3)
    sizes = draw.integers(1, 60, 300)
    vectors = np.stack([np.bincount(draw.integers(0, 16, s), minlength=ngram_join.GROUPS) for s in sizes])
    tree = ngram_join.CountTree(vectors, sizes)
    for k in range(300):
        v, n = tree.points[k], tree.sizes[k]
        want = [j for j in range(k + 1, 300) if 180 * np.minimum(v, tree.points[j]).sum() >= 80 * (n + tree.sizes[j])]
        assert sorted(tree.after(k, 80).tolist()) == want


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (7, 7), (None, 1), (9, 8), (8, 4)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.node: r.label for r in components.labels(spark.createDataFrame(edges, "a long, b long"), "a", "b", "node", "label").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 8: 4, 9: 4} | {i: 100 for i in range(100, 141)}


def test_deep_nodes():
    """Order, shared words and nodes are those of sorting all suffixes."""
    draw = np.random.default_rng(5)
    texts = [draw.integers(0, 3, n).astype(np.uint64) for n in (0, 1, 9, 30, 30, 64)] + [np.tile(np.array([1, 2], np.uint64), 20)]
    h, begin = np.concatenate(texts), np.cumsum([0, *map(len, texts)])
    for window in (1, 4, 7):
        order, shared, node = substring_dedup.deep_nodes(h, begin, window)
        suffix = {int(begin[i]) + k: t[k:].tolist() for i, t in enumerate(texts) for k in range(len(t) - window + 1)}
        common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert sorted(order) == sorted(suffix)
        most = 1 << int(np.ceil(np.log2(window))) if window > 1 else 1
        for i, (a, b) in enumerate(zip(order, order[1:])):
            assert min(shared[i + 1], most) == min(common(suffix[a], suffix[b]), most)
        tops = {}
        for p, n in zip(order, node):
            tops.setdefault(tuple(suffix[p][:window]), set()).add(n)
        assert all(len(x) == 1 for x in tops.values()) and len(set.union(*tops.values())) == len(tops)


@pytest.mark.parametrize("group_words", [1 << 16, 400, 1])
def test_substring_dedup(spark, group_words):
    rows = corpus(5)
    first, found = {}, [(d, WORDS.findall(t or "")) for d, t in rows]
    for d, ws in found:
        for p in range(len(ws) - 49) if d is not None else ():
            k = tuple(ws[p : p + 50])
            first[k] = min(d, first.get(k, d))
    want = []
    for d, ws in found:
        gone = {q for p in range(len(ws) - 49) if d is not None and first[tuple(ws[p : p + 50])] < d for q in range(p, p + 50)}
        want.append((d, len(ws), len(gone), hashlib.sha256(" ".join(w for q, w in enumerate(ws) if q not in gone).encode()).hexdigest()))
    got = substring_dedup.substring_dedup(frame(spark, rows), group_words=group_words)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want)) and sum(w[2] for w in want) > 500
    assert substring_dedup.substring_dedup(frame(spark, rows[:0])).count() == 0
    kept = substring_dedup.substring_dedup(frame(spark, rows), with_text=True).collect()
    assert all(hashlib.sha256(r.text.encode()).hexdigest() == r.kept_sha256 for r in kept)


def test_ann(spark):
    draw = np.random.default_rng(8)
    centres = draw.normal(size=(6, 24))
    x = centres[draw.integers(0, 6, 900)] + 0.7 * draw.normal(size=(900, 24))
    x *= draw.uniform(0.5, 2, (900, 1))
    x[300:420] = x[0]
    rows = [(i, v.astype(float).tolist()) for i, v in enumerate(x)]
    bad = [(1000, None), (1020, [0.0] * 24), (1040, [float("nan")] + [1.0] * 23), (1060, [None] + [1.0] * 23), (1080, [1.0]), (None, x[1].tolist()), (1100, [])]
    df = spark.createDataFrame(rows + bad + rows[:1], "vec_id long, embedding array<float>").withColumns({"node": F.lit(1), "u": F.lit(1), "start": F.lit(1)})
    got = ann.nearest(df, lambda i: i % 20 == 0, 20).collect()
    y, hit = x.astype(np.float32).astype(float), 0
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    assert sorted(by) == list(range(0, 900, 20))
    for q, rs in by.items():
        s = y @ y[q]
        order = [i for i in np.lexsort((np.arange(900), -s)) if i != q][:20]
        rs.sort(key=lambda r: r.rank)
        assert [r.rank for r in rs] == list(range(1, 21)) and all(abs(r.score - s[r.vec_id]) < 1e-9 for r in rs)
        assert [r.vec_id for r in rs] == [i for _, i in sorted((-r.score, r.vec_id) for r in rs)]
        hit += len(set(order) & {r.vec_id for r in rs})
    assert hit / (20 * len(by)) >= 0.95
    few = ann.nearest(df.where("vec_id in (0, 1, 2)"), lambda i: i % 20 == 0, 20).collect()
    assert len(few) == 2
    assert ann.nearest(df.limit(0), lambda i: i % 20 == 0, 20).count() == 0


@pytest.mark.parametrize("kind", ["float", "double"])
def test_ann_graph_is_small_and_every_vector_filed(spark, monkeypatch, kind):
    draw = np.random.default_rng(9)
    x = draw.normal(size=(6000, 32)).astype(np.float32)
    x[1000:2500] = x[7] + 0.01 * draw.normal(size=(1500, 32))  # near copies: a file of several shards
    built = []
    build = ann.build
    monkeypatch.setattr(ann, "build", lambda points: built.append(points.count()) or build(points))
    monkeypatch.setattr(ann, "SHARD_BYTES", 400 * x.shape[1] * (4 if kind == "float" else 8), raising=False)
    monkeypatch.setattr(ann, "CACHED", 5000, raising=False)
    rows = [(i, v.astype(float).tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(3)
    got = {}
    for r in ann.nearest(df, lambda i: i % 20 == 0, 20).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert built and built[0] <= 2 * 4 * 6000**0.5  # a vertex each would take rounds of joins over all vectors
    assert sorted(got) == list(range(0, 6000, 20)) and all(len(v) == 20 for v in got.values())
    y, hit = x.astype(float), 0
    for q, found in got.items():
        s = y @ y[q]
        s[q] = -np.inf
        hit += len(found & set(np.argsort(-s, kind="stable")[:20].tolist()))
    assert hit / (20 * len(got)) >= 0.95


def test_ann_walk_reaches_every_vertex():
    sims = np.random.default_rng(3).normal(size=(5, 300)).astype(np.float32) / 9
    alone = np.repeat(np.arange(300, dtype=np.int32)[:, None], 4, axis=1)  # a graph without edges
    for settled in (1, 60, 299, 300):
        assert all(len(set(w)) == settled for w in ann.walk(sims, alone, settled).tolist())


def test_toxicity(spark):
    draw = random.Random(2)
    word = lambda: "".join(draw.choice("etaoinshr") for _ in range(draw.randint(2, 7)))
    vocabulary = [word() for _ in range(3000)]
    rows, labels = [], []
    for i in range(900):
        ws = [draw.choice(vocabulary) for _ in range(60)]
        toxic = i % 6 == 0
        if toxic:
            for w in draw.sample(["dumbkopf", "vilewretch", "muckball", "pigface", "gutterbrain"], 3):
                ws.insert(draw.randrange(len(ws)), w)
        rows.append((i, " ".join(ws)))
        labels.append((i, int(toxic)))
    df = frame(spark, rows + [(5000, None), (5001, ""), (5002, "vilewretch " + "calm " * 30_000)])
    lab = spark.createDataFrame(labels + [(1, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(df, lab)
    got = toxicity.score(df, model).withColumn("held", toxicity.is_held_out(F.col("doc_id"))).collect()
    truth = dict(labels)
    held = [(r.score >= 0.3, truth[r.doc_id]) for r in got if r.held and r.doc_id in truth]
    assert sum(p == bool(t) for p, t in held) / len(held) > 0.97 and all(0 <= r.score <= 1 for r in got)
    assert all(r.score < 0.3 for r in got if r.doc_id in (5000, 5001))
    assert toxicity.without_toxic(df, model, 0.3).columns == df.columns
    assert toxicity.train(df, lab) == model
    none = toxicity.train(df, lab.limit(0))
    assert toxicity.score(df, none).where("score >= 0.3").count() == 0 and toxicity.score(df.limit(0), model).count() == 0


def test_toxicity_counts_every_window():
    """Features are those of compressing every window of the whole text by itself, one call each."""
    ordinary = toxicity.content(10_000, Counter({w.encode(): 3 for w in "hello shell hellish shelling calm day".split()}))
    s = toxicity.Scorer(toxicity.Model(ordinary, b" hell  vilewretch  dumbkopf ", (0.0,) * (1 + 2 * len(toxicity.LEVELS))))
    texts = ["hell", "calm day", "", "go to hell\nhello\tHELL vilewretched ééé " * 30, "shell", " \n", "calm " * 4000 + "dumbkopf", "x" * 300_000 + " vilewretch"]
    for t, row in zip(texts, s.features(texts), strict=True):
        low = f" {t.lower()} ".encode()
        spans = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", low)]
        windows = [low[spans[i][0] - 1 : spans[min(i + toxicity.WINDOW, len(spans)) - 1][1] + 1] for i in range(0, len(spans), toxicity.WINDOW)]
        savings = [len(s.plain.compress(w)) - len(s.both.compress(w)) for w in windows]
        counts = [sum(x >= level for x in savings) for level in toxicity.LEVELS]
        assert np.allclose(row, [1, *np.log1p(counts), *(100 * c / max(len(spans), 50) for c in counts)])
    assert s.features(["calm " * 4000 + "dumbkopf"])[0][1] > 0
