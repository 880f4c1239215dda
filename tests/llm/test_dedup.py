import random

import numpy as np
import pytest
import xxhash

from understory.llm import common, embedding_dedup, simhash

VECS = "vec_id long, embedding array<float>, label int, id int, n int"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp int, key int"


def classes(n, links):
    root = list(range(n))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(k) for k in range(n)]


# ---------------------------------------------------------------- components and blocks


@pytest.mark.parametrize("seed", range(3))
def test_components_equal_brute_force(spark, seed):
    r = random.Random(seed)
    n = 300
    links = [(r.randrange(n), r.randrange(n)) for _ in range(200)] + [(k, k + 1) for k in range(250, 290)] + [(5, 5)]
    got = {x.node: x.root for x in common.components(spark.createDataFrame(links, "u long, v long")).collect()}
    want = classes(n, links)
    touched = {a for a, b in links if a != b} | {b for a, b in links if a != b}
    assert got == {k: want[k] for k in touched}


def test_components_of_nothing(spark):
    assert common.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_every_two_rows_of_a_bucket_meet_once(spark):
    df = spark.createDataFrame([(1, k, 50) for k in range(50)] + [(2, 1, 1)], "key long, id long, n long")
    dealt = common.block_pairs(df, "key", "n", "id", block=8).collect()
    met = {}
    for r in dealt:
        met.setdefault((r.key, r._i, r._j), []).append((r.id, r._b))
    pairs = [tuple(sorted((a, b))) for (_, i, j), rows in met.items() for k, (a, x) in enumerate(rows) for b, y in rows[k + 1 :] if (x == y == i == j) or (i != j and x != y)]
    assert len(pairs) == len(set(pairs)) == 50 * 49 // 2
    assert max(map(len, met.values())) < 40


@pytest.mark.parametrize("keys", [[3] * 500 + [None] * 3, list(range(300))])
def test_range_dealing_covers_all_rows(spark, keys):
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    dealt, edges = common.range_dealt(df, "k", 6, per_part=4)
    rows = dealt.collect()
    assert len(rows) == len(keys)
    for part, lo, hi, _ in edges:
        own = [r.k for r in rows if r._part == part and r.k is not None]
        assert not own or (min(own), max(own)) == (lo, hi)
    spans = [(lo, hi) for _, lo, hi, _ in edges if lo is not None]
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


# ---------------------------------------------------------------- embeddings


def brute_vectors(rows):
    x = []
    for _, e, label in rows:
        ok = e is not None and label is not None and len(e) and all(v is not None and np.isfinite(v) for v in e) and any(e)
        x.append(np.array(e, float) / np.linalg.norm(np.array(e, float)) if ok else None)
    links = [(a, b) for a in range(len(rows)) for b in range(a + 1, len(rows)) if x[a] is not None and x[b] is not None and rows[a][2] == rows[b][2] and len(x[a]) == len(x[b]) and x[a] @ x[b] >= 0.93]
    root = classes(len(rows), links)
    return {rows[k][0]: (sum(k in p for p in links), rows[root[k]][0]) for k in range(len(rows))}


@pytest.mark.parametrize("block", [2048, 16])
def test_links_equal_brute_force(spark, monkeypatch, block):
    r = np.random.default_rng(1)
    rows, k = [], 0
    for c in range(25):
        centre = r.standard_normal(32)
        for _ in range(r.integers(1, 9)):
            rows.append((k, (centre + r.standard_normal(32) * 0.08).astype(np.float32).tolist(), int(c % 3)))
            k += 1
    hot = r.standard_normal(32)
    for _ in range(60):
        rows.append((k, (hot + r.standard_normal(32) * 0.1).astype(np.float32).tolist(), 0))
        k += 1
    for _ in range(30):
        rows.append((k, hot.astype(np.float32).tolist(), 0))
        k += 1
    bad = [None, [], [0.0] * 32, [float("nan")] + [1.0] * 31, [float("inf")] * 32, [None] + [1.0] * 31]
    rows += [(k + j, e, 0) for j, e in enumerate(bad)] + [(k + 10, rows[0][1], None), (k + 11, [1.0, 2.0], 0), (k + 12, [2.0, 4.0], 0), (k + 13, [3e38] * 32, 1), (k + 14, [1e-38] * 32, 1)]
    monkeypatch.setattr(common, "BLOCK", block)
    monkeypatch.setattr(embedding_dedup, "block_pairs", lambda df, b, n, i: common.block_pairs(df, b, n, i, block))
    df = spark.createDataFrame([(*x, 1, 2) for x in rows], VECS)
    got = {x.vec_id: (x.n_links, x.component_id) for x in embedding_dedup.near_vectors(df).collect()}
    assert got == brute_vectors(rows)
    assert all(x.kept == (x.vec_id == x.component_id) for x in embedding_dedup.near_vectors(df).collect())


def test_rows_of_one_id_are_vectors_of_their_own(spark):
    e = np.eye(8)
    near = lambda k: (e[k] + 0.1 * e[7]).tolist()
    rows = [(1, e[1].tolist(), 0), (1, e[2].tolist(), 0), (2, near(1), 0), (3, near(2), 0), (9, e[3].tolist(), 0), (9, e[3].tolist(), 0), (8, near(3), 0)]
    got = sorted((x.vec_id, x.n_links, x.component_id) for x in embedding_dedup.near_vectors(spark.createDataFrame([(*x, 1, 2) for x in rows], VECS)).collect())
    assert got == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (8, 2, 8), (9, 2, 8), (9, 2, 8)]


def test_recall_of_the_whole_operator_near_the_threshold(spark):
    """Planted pairs of cosine 0.93 to 0.95 among unlike vectors, against all pairs."""
    r = np.random.default_rng(14)
    a = r.standard_normal((700, 32))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = r.standard_normal((700, 32))
    b -= (a * b).sum(axis=1)[:, None] * a
    b /= np.linalg.norm(b, axis=1)[:, None]
    c = r.uniform(0.931, 0.95, 700)[:, None]
    x = np.concatenate([a, c * a + np.sqrt(1 - c * c) * b]).astype(np.float32)
    got = embedding_dedup.near_vectors(spark.createDataFrame([(k, v.tolist(), 0, 1, 2) for k, v in enumerate(x)], VECS)).collect()
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    want = int((y @ y.T >= 0.93).sum()) - len(y)
    assert want >= 1400 and 0.985 * want <= sum(g.n_links for g in got) <= want


def test_recall_near_the_threshold():
    r = np.random.default_rng(4)
    a = r.standard_normal((4000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = r.standard_normal((4000, 64))
    b -= (a * b).sum(axis=1)[:, None] * a
    b /= np.linalg.norm(b, axis=1)[:, None]
    for c, least in ((0.93, 0.985), (0.965, 0.999)):
        near = c * a + np.sqrt(1 - c * c) * b
        hit = (embedding_dedup.table_keys(a) == embedding_dedup.table_keys(near)).any(axis=1)
        assert hit.mean() >= least


def test_no_vectors(spark):
    df = spark.createDataFrame([], VECS)
    assert embedding_dedup.near_vectors(df).count() == 0
    got = embedding_dedup.near_vectors(spark.createDataFrame([(None, [1.0, 0.0], 1, 1, 1), (4, [1.0, 0.0], 1, 1, 1), (9, [1.0, 0.0], 1, 1, 1)], VECS)).collect()
    assert sorted((x.vec_id or 0, x.n_links, x.component_id, x.kept) for x in got if x.vec_id) == [(4, 1, 4, True), (9, 1, 4, False)]


# ---------------------------------------------------------------- SimHash


def brute_fingerprint(text):
    import re

    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    s = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def documents():
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdeÉßZ") for _ in range(r.randint(1, 6)))
    out = []
    for _ in range(60):
        base = [word() for _ in range(r.randint(3, 150))]
        out.append(" ".join(base))
        for _ in range(r.randrange(4)):
            copy = list(base)
            copy[r.randrange(len(copy))] = word()
            out.append("\n".join(copy) if r.random() < 0.5 else "  ".join(copy).upper())
    return out + out[:20] + ["", None, " \n\t", "one", "one two", "ONE TWO", "a\x0bb\x0cc\xa0d", "w " * 40_000]


def test_fingerprints_equal_brute_force(monkeypatch):
    monkeypatch.setattr(simhash, "RUN", 37)
    for t in documents()[:-1]:
        assert simhash.fingerprint(t) == brute_fingerprint(t)


def test_spark_hash_is_the_same(spark):
    from pyspark.sql import functions as F

    t = ["alpha beta gamma", "é ß x", "one"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in t], "t string").select(F.xxhash64("t")).collect()]
    assert [g % (1 << 64) for g in got] == [xxhash.xxh64_intdigest(x.encode(), 42) for x in t]


def test_groups_equal_brute_force(spark):
    texts = documents()
    ids = [1000 - k for k in range(len(texts))]
    df = spark.createDataFrame([(i, t, "en", "s", 0, 1, 2) for i, t in zip(ids, texts)], DOCS)
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(df).collect()}
    fps = [simhash.fingerprint(t) for t in texts]
    root = classes(len(texts), [(a, b) for a in range(len(fps)) for b in range(a + 1, len(fps)) if (fps[a] ^ fps[b]).bit_count() <= 3])
    least = {}
    for i, c in zip(ids, root):
        least[c] = min(least.get(c, i), i)
    assert got == {i: (f, least[c]) for i, f, c in zip(ids, fps, root)}


@pytest.mark.parametrize("block", [2048, 8])
def test_all_near_fingerprints_are_linked(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "block_pairs", lambda df, b, n, i: common.block_pairs(df, b, n, i, block))
    r = random.Random(8)
    fps = [r.getrandbits(64) for _ in range(150)]
    for f in list(fps):
        for k in range(4):
            fps.append(f ^ sum(1 << b for b in r.sample(range(64), k)))
    hot = r.getrandbits(64)
    fps = sorted(set(fps + [hot ^ 1 << r.randrange(64) ^ 1 << r.randrange(64) for _ in range(80)]))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash.near_links(spark.createDataFrame([(s,) for s in signed], "fp long")).collect()
    at = {s: k for k, s in enumerate(signed)}
    got = classes(len(fps), [(at[x.u], at[x.v]) for x in links])
    assert got == classes(len(fps), [(a, b) for a in range(len(fps)) for b in range(a + 1, len(fps)) if (fps[a] ^ fps[b]).bit_count() <= 3])


@pytest.mark.parametrize("columns", [["fp", "node"], ["fp"]])
def test_no_exploded_keys_are_broadcast(spark, columns):
    """The planner sees 24 keys a fingerprint as one, so a table far below the broadcast threshold must not be sent whole."""
    named = common.stored(spark.range(2000).selectExpr("xxhash64(id) fp", "id node"), "named")
    plan = simhash.near_links(named.select(columns))._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def broadcasts(spark, run):
    """Plans with a broadcast among those that ``run`` executes, and its result."""
    bus, store = spark.sparkContext._jsc.sc().listenerBus(), spark._jsparkSession.sharedState().statusStore()
    bus.waitUntilEmpty(30_000)
    before = {store.executionsList().apply(k).executionId() for k in range(store.executionsList().size())}
    out = run()
    bus.waitUntilEmpty(30_000)
    all_ = store.executionsList()
    plans = [all_.apply(k).physicalPlanDescription() for k in range(all_.size()) if all_.apply(k).executionId() not in before]
    assert any("SortMergeJoin" in p for p in plans)
    return [p for p in plans if "Broadcast" in p], out


def test_many_links_are_not_broadcast(spark):
    """Far below the planner's threshold in packed bytes, but a round joins several such tables, which the driver would all hold."""
    n = 100_000
    edges = common.stored(spark.range(n).selectExpr("id - id % 10 u", "id v").where("u <> v"), "edges")
    sent, wrong = broadcasts(spark, lambda: common.components(edges).where("root <> node - node % 10").count())
    assert sent == [] and wrong == 0


@pytest.mark.parametrize("again", [0, 1])
def test_many_fingerprints_are_not_broadcast(spark, again):
    """Documents go to their classes by sort and merge, with ids as names of classes and, where an id repeats, without."""
    n = 70_000
    docs = spark.range(n).selectExpr("id doc_id", "cast(id as string) text").unionByName(spark.range(again).selectExpr("id doc_id", "'again' text"))
    sent, got = broadcasts(spark, lambda: simhash.near_duplicates(docs).agg({"*": "count", "component_id": "max"}).first())
    assert [p for p in sent if "fp#" in p] == [] and got["count(1)"] == n + again  # the few links themselves may be sent


def test_chains_drop_only_far_pairs():
    r = np.random.default_rng(2)
    a = r.integers(0, 1 << 63, 2000, dtype=np.uint64)
    b = a.copy()
    for k in range(2000):
        for bit in r.choice(64, r.integers(0, 6), replace=False):
            b[k] ^= np.uint64(1) << np.uint64(bit)
    near = np.bitwise_count(a ^ b) <= 3
    kept = np.zeros(2000, bool)
    for first in range(simhash.SEGMENTS):
        k = simhash.chain_pairs(a, b, first)
        assert near[k].all()
        kept[k] = True
    assert (kept == near).all()


def test_one_of_each_keeps_one(spark):
    rows = [(3, "a b c d e"), (1, "a b c d e"), (1, "a b c d e"), (7, "quite another text here"), (None, "zz yy xx ww"), (None, "zz yy xx ww"), (None, "a b c d e"), (9, None), (8, "")]
    df = spark.createDataFrame([(i, t, "en", "s", 0, 1, 2) for i, t in rows], DOCS)
    got = simhash.one_of_each(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id or 0, r.text) for r in got.collect()) == [(0, "zz yy xx ww"), (1, "a b c d e"), (7, "quite another text here"), (8, "")]
    assert simhash.one_of_each(df.limit(0)).count() == 0
