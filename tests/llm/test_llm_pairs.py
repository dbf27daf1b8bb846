"""Near duplicates, nearest neighbours and the pipeline, against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from maskloom.llm import near_dups, nearest
from maskloom.llm.queries import REGISTRY

SMALL = "/root/testdata/sf0.001"
MIDDLE = "/root/testdata/sf0.01"


def sets_of(texts, size):
    out = []
    for text in texts:
        words = (text or "").encode().lower().split()
        out.append({tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set())
    return out


def groups(keys, texts, size, percent):
    """Number of shingles and the smallest key reachable, comparing every pair of texts that share a shingle."""
    sets = sets_of(texts, size)
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = {}
    for i, own in enumerate(sets):
        shared = {}
        for s in own:
            for j in holders.setdefault(s, []):
                shared[j] = shared.get(j, 0) + 1
            holders[s].append(i)
        for j, n in shared.items():
            if 100 * n >= percent * (len(own) + len(sets[j]) - n):
                parent[find(i)] = find(j)
    least = {}
    for i, key in enumerate(keys):
        least[find(i)] = min(least.get(find(i), key), key)
    return {key: (len(s), least[find(i)]) for i, (key, s) in enumerate(zip(keys, sets))}


def test_near_duplicates_query(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet").orderBy("doc_id").collect()
    want = groups([d["doc_id"] for d in docs], [d["text"] for d in docs], 3, 85)
    rows = REGISTRY["op9_near_duplicates"](spark, MIDDLE).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)


def test_hot_group_of_near_copies(spark):
    """Copies of one text with more and more changes: some link only through others, some with none."""
    rng = random.Random(4)
    base = [f"w{rng.randrange(10_000)}" for _ in range(120)]
    texts = [" ".join(base)] * 40
    for i in range(260):
        words = list(base)
        for _ in range(rng.randrange(1, 9)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10_000)}"
        texts.append(" ".join(words))
    texts += [" ".join(f"v{rng.randrange(9999)}" for _ in range(80)) for _ in range(50)]
    keys = rng.sample(range(10_000), len(texts))
    df = spark.createDataFrame(list(zip(keys, texts)), "id long, text string")
    got = near_dups.near_duplicates(df, "id", "text", size=3, percent=85)
    want = groups(keys, texts, 3, 85)
    assert {r["id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == want
    kept = near_dups.one_of_each(got, "id").collect()
    assert sorted(r["id"] for r in kept) == sorted({c for _, c in want.values()})


def test_chain_is_one_component(spark):
    words = [f"t{i}" for i in range(400)]
    texts = [" ".join(words[i * 2 : i * 2 + 60]) for i in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = near_dups.near_duplicates(df, "id", "text", size=3, percent=85)
    assert {r["component_id"] for r in got.collect()} == {0}


def test_near_duplicates_defined_cases(spark):
    long = "long text " * 40_000
    rows = [
        (None, "a b c d", 1),
        (None, "a b c d", 2),
        (4, "A B  C\nD", 3),
        (3, "a b c d", 4),
        (7, None, 5),
        (8, "", 6),
        (9, " \t", 7),
        (10, "one", 8),
        (11, "ONE", 9),
        (12, "É x", 10),
        (13, "é x", 11),
        (14, long, 12),
        (15, long, 13),
        (3, "a b c d", 14),
        (3, "other words are here", 15),
    ]
    df = spark.createDataFrame(rows, "id long, text string, node int")
    got = near_dups.near_duplicates(df, "id", "text", size=3, percent=85, keep=["text", "node"]).collect()
    assert len(got) == len(rows)
    told = [(r["id"], r["component_id"]) for r in got]
    for pair in [(4, 3), (7, 7), (8, 8), (9, 9), (10, 10), (11, 10), (12, 12), (13, 13), (15, 14)]:
        assert pair in told
    assert told.count((None, None)) == 2 and told.count((3, 3)) == 3
    assert near_dups.near_duplicates(df.limit(0), "id", "text").count() == 0
    kept = near_dups.one_of_each(near_dups.near_duplicates(df, "id", "text", 3, 85, ["text"]), "id").collect()
    assert sorted((r["id"] or 0) for r in kept) == [0, 0, 3, 3, 7, 8, 9, 10, 12, 13, 14]


def test_components_by_stars(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(0, i) for i in range(400, 700)]
    edges += [(1000 + i, 1001 + i) for i in range(60)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame([(a, b) for a, b in edges], "a long, b long")
    got = {r["node"]: r["root"] for r in near_dups.components(df).collect()}
    alone = {x for a, b in edges if a == b for x in [a]}
    assert {k: v for k, v in got.items()} == {x: find(x) for x in parent if x in got}
    assert set(parent) - set(got) <= alone


# Nearest neighbours


def test_hilbert_order_visits_neighbours():
    for bits, dims in ((3, 2), (2, 3), (2, 4)):
        side = 2**bits
        grid = np.stack(np.meshgrid(*[np.arange(side)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
        keys = nearest.hilbert_keys(grid.astype(float), bits)
        order = np.argsort(keys)
        assert sorted(keys.tolist()) == list(range(side**dims))
        assert (np.abs(np.diff(grid[order], axis=0)).sum(axis=1) == 1).all()


def brute(rows, k, queries):
    table = [(i, np.asarray(v, float)) for i, v in rows]
    ids = np.array([i for i, _ in table])
    x = np.stack([v for _, v in table])
    out = {}
    for q in queries:
        at = int(np.flatnonzero(ids == q)[0])
        score = x @ x[at]
        order = [j for j in np.lexsort((ids, -np.round(score, 9))) if ids[j] != q][:k]
        out[q] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def test_neighbours_query_recall(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{MIDDLE}/embeddings.parquet").collect()]
    want = brute(rows, 20, [i for i, _ in rows if i % 20 == 0])
    got = {}
    for r in REGISTRY["op8_nearest_neighbours"](spark, MIDDLE).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(want)
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21))
        hits += len({f[1] for f in found} & {v for v, _ in want[q]})
    assert hits >= 0.9 * 20 * len(want)


def test_neighbours_of_bounded_windows(spark):
    """Clustered vectors and narrow windows: most neighbours are still found."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(60, 24))
    x = centres[rng.integers(0, 60, 6000)] + 0.25 * rng.normal(size=(6000, 24))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = nearest.nearest(df, "id", "v", F.col("id") % 60 == 0, 10, window=300).collect()
    want = brute(rows, 10, range(0, 6000, 60))
    hits = sum(r["vec_id"] in {v for v, _ in want[r["query_id"]]} for r in got)
    assert len(got) == 1000 and hits >= 900


def neighbour_recall(spark, x, k=10, window=None):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    step = len(x) // 100
    got = nearest.nearest(df, "id", "v", F.col("id") % step == 0, k, window=window).collect()
    asked = range(0, len(x), step)
    want = brute(list(enumerate(x)), k, asked)
    assert len(got) == k * len(asked)
    return sum(r["vec_id"] in {v for v, _ in want[r["query_id"]]} for r in got) / len(got)


def test_neighbours_with_one_outlier(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(60, 24))
    x = centres[rng.integers(0, 60, 6000)] + 0.25 * rng.normal(size=(6000, 24))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[17] *= 1000
    assert neighbour_recall(spark, x, window=300) >= 0.9
    # its square is beyond the range of doubles
    x[17] *= 1e170
    assert neighbour_recall(spark, x, window=300) >= 0.9


def test_neighbours_with_mixed_norms(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(6000, 24)) * np.exp(rng.normal(size=6000))[:, None]
    assert neighbour_recall(spark, x, window=300) >= 0.9


def test_neighbours_defined_cases(spark):
    one = [1.0, 0.0, 0.0]
    rows = [
        *[(i, one) for i in range(200)],
        (300, [0.5, 0.5, 0.0]),
        (301, [2.0, -0.0, 0.0]),
        (302, [2.0, 0.0, 0.0]),
        (303, [0.0, 0.0, 0.0]),
        (304, None),
        (305, [1.0, None, 0.0]),
        (306, [float("nan"), 0.0, 0.0]),
        (307, [float("inf"), 0.0, 0.0]),
        (308, [1.0, 0.0]),
        (309, []),
        (None, one),
    ]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    got = {}
    for r in nearest.nearest(df, "id", "v", F.col("id") % 20 == 0, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    for q in range(0, 200, 20):
        assert got[q] == [301, 302, *[i for i in range(4) if i != q][:3]]
    assert got[300] == [301, 302, 0, 1, 2]
    assert set(got) == {*range(0, 200, 20), 300}
    few = df.where("id >= 300")
    assert nearest.nearest(few, "id", "v", F.col("id") == 300, 5).count() == 2
    assert nearest.nearest(df.limit(0), "id", "v", F.lit(True), 5).count() == 0


# Pipeline


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{MIDDLE}/labels.parquet").collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "language_id", "near_dedup", "packing"]
    table = docs
    for name, stage in corpus_pipeline.STAGES:
        before, table = table, stage(spark, table, MIDDLE).cache()
        ids = {r["doc_id"] for r in table.select("doc_id").collect()}
        if name != "packing":
            assert table.columns == docs.columns
            assert table.count() == len(ids)
        was = {r["doc_id"]: r for r in before.collect()}
        if name == "toxicity":
            gone = set(was) - ids
            assert gone and sum(toxic.get(d, 1) == 0 for d in gone) <= 4
            # some 30 toxic documents to learn from: words that only one or two of them hold are not learnt
            assert sum(toxic.get(d) == 1 for d in ids) <= 20
        if name == "language_id":
            assert len(ids) >= 0.99 * len(was)
        if name == "near_dedup":
            keys = sorted(was)
            want = groups(keys, [was[k]["text"] for k in keys], 5, 80)
            assert ids == {c for _, c in want.values()}
        if name == "packing":
            assert ids == set(was)


def test_pipeline_defined_cases(spark, tmp_path):
    text = "the of and to in is that it was for " * 8
    rows = [
        (1, text, "en", "s", 1),
        (1, text, "en", "s", 1),
        (2, text.upper(), "en", "s", 1),
        (3, None, None, None, None),
        (None, "the cat and the dog of the house", "en", "s", 1),
        (4, "123 456", "en", "s", 1),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"] or 0) for r in got) == [0, 1]
    empty = f"{tmp_path}/empty"
    docs.limit(0).write.parquet(f"{empty}/documents.parquet")
    labels.limit(0).write.parquet(f"{empty}/labels.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0


@pytest.mark.parametrize("name", ["op1", "op2", "op3", "op4", "op5", "op6", "op7", "op8", "op9", "op10"])
def test_queries_on_empty_tables(spark, tmp_path, name):
    for table in ("documents", "labels", "embeddings"):
        spark.read.parquet(f"{SMALL}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    full = next(q for q in REGISTRY if q.startswith(name + "_"))
    assert REGISTRY[full](spark, str(tmp_path)).count() == 0
