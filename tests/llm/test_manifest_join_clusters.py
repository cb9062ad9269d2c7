"""Merkle manifest, n-gram Jaccard join and centroid clustering against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidepanel.llm import heap_kmeans, jaccard_join, merkle

from .conftest import FOLDER


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- manifest --------------------------------------------------------------------

def brute_manifest(rows, arity, altered=lambda r: r):
    """rows (doc_id, source, lang, n_chars, text) -> sorted digests of each row."""
    def leaf(r):
        return h("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in r))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([h("".join(out[-1][i:i + arity])) for i in range(0, len(out[-1]), arity)])
        return out

    def path(tree, i):
        for level in tree[:-1]:
            a = i // arity * arity
            yield i - a, level[a:i] + level[i + 1:a + arity]
            i //= arity
    groups = {}
    for r in rows:
        groups.setdefault("" if r[2] is None else "+" + r[2], []).append(r)
    for g in groups.values():
        g.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {g: levels([leaf(r) for r in rs]) for g, rs in groups.items()}
    names = sorted(groups, key=str.encode)
    over = levels([trees[g][-1][0] for g in names]) if names else None
    out = []
    for k, g in enumerate(names):
        for i, r in enumerate(groups[g]):
            steps = [*path(trees[g], i), *path(over, k)]
            top = leaf(altered(r))
            for slot, others in steps:
                top = h("".join([*others[:slot], top, *others[slot:]]))
            out.append((str(r[0]), leaf(r), trees[g][-1][0], over[-1][0], h("".join("".join(o) for _, o in steps)), top, top == over[-1][0]))
    return sorted(out)


def digests(df):
    return sorted((str(r.id), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in df.collect())


def one_more(r):
    hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
    return (*r[:3], r[3] + 1, r[4]) if hit else r


def test_manifest_query(spark, rows):
    got = entry.queries()["op11_merkle_manifest"](spark, FOLDER).withColumnRenamed("doc_id", "id")
    want = brute_manifest(rows("documents", "doc_id, source, lang, n_chars, text"), 2, one_more)
    assert digests(got) == want and 0 < sum(not w[-1] for w in want) < len(want)


@pytest.mark.parametrize("arity, block", [(2, 4), (2, 4096), (3, 9), (5, 30)])
def test_manifest_odd_rows(spark, odd, monkeypatch, arity, block):
    """NULLs, repeated rows, clashing names, several strides and ranges, a lone leaf."""
    monkeypatch.setattr(merkle, "BLOCK", block)
    monkeypatch.setattr(merkle, "LEAVES_PER_RANGE", 4)
    more = spark.createDataFrame([(100, "alone", "fr", "s", 2**63 - 1), (101, "", "", "", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    df = odd.unionByName(more, allowMissingColumns=True).withColumn("gk", F.lit("x")).withColumn("h", F.lit(1)).withColumn("path", F.lit(2))
    data = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in df.collect()]
    assert digests(merkle.manifest(df, arity=arity)) == brute_manifest(data, arity)
    if block == 4:
        got = merkle.manifest(df, arity=arity, claims={"text": F.concat(F.coalesce("text", F.lit("")), F.lit("!"))}).collect()
        assert len(got) == len(data) and not any(r.verified for r in got)


def test_manifest_of_few_rows(spark, odd):
    assert merkle.manifest(odd.limit(0)).count() == 0
    one = merkle.manifest(odd.filter("doc_id = 5")).collect()
    assert len(one) == 1 and one[0].leaf == one[0].subroot == one[0].root == one[0].folded_root and one[0].proof_sha256 == h("")
    long = spark.createDataFrame([(1, "é" * 3_000_000, "en", None, 3_000_000), (2, "b", "en", None, 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert digests(merkle.manifest(long)) == brute_manifest([(r.doc_id, None, "en", r.n_chars, r.text) for r in long.collect()], 2)


# --- Jaccard join ----------------------------------------------------------------

def brute_links(docs, size, p, q):
    """[(id, text)] -> sorted (id, set size, component), by all pairs."""
    sets = []
    for _, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append(frozenset(tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset())
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and q * len(a & sets[j]) >= p * len(a | sets[j]):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    members = {}
    for i in range(len(docs)):
        members.setdefault(find(i), []).append(docs[i][0])
    name = {c: min((x for x in m if x is not None), default=None) for c, m in members.items()}
    return sorted((str(d[0]), len(sets[i]), str(name[find(i)])) for i, d in enumerate(docs))


def answer(df):
    return sorted((str(r.id), r.n_shingles, str(r.component)) for r in df.collect())


def near_copies(rng, families, copies, words=(4, 400)):
    """Families of texts with more and more words replaced, cut off or added."""
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    out = []
    for _ in range(families):
        base = [word() for _ in range(rng.randint(*words))]
        for c in range(copies):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 30))):
                w[rng.randrange(len(w))] = word()
            w = w[:len(w) - rng.randint(0, len(w) // 12)] + [word() for _ in range(rng.randint(0, len(w) // 20))]
            out.append(" ".join(w))
    return out


def test_jaccard_query(spark, rows):
    got = entry.queries()["op12_jaccard_join"](spark, FOLDER).withColumnRenamed("doc_id", "id").withColumnRenamed("component_id", "component")
    assert answer(got) == brute_links(rows("documents", "doc_id, text"), 3, 9, 10)


@pytest.mark.parametrize("limit, size, similarity", [(200_000, 3, (9, 10)), (600, 3, (9, 10)), (300, 5, (4, 5)), (2000, 1, (1, 2))])
def test_jaccard_against_all_pairs(spark, monkeypatch, limit, size, similarity):
    """Small limits cut the groups of near copies and the queries that meet them."""
    monkeypatch.setattr(jaccard_join, "LIMIT", limit)
    rng = random.Random(limit + size)
    texts = near_copies(rng, 12, 12)
    common = " ".join(f"notice{i}" for i in range(60))
    texts += [f"{common} {t[:60]}" for t in texts[:40]]
    docs = [(1000 - i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    want = brute_links(docs, size, *similarity)
    assert answer(jaccard_join.linked(df, size=size, similarity=similarity)) == want
    assert len({w[2] for w in want}) < len(want) * 0.8  # there are links to be found


def test_jaccard_first_round_moves_no_tokens(spark, tmp_path):
    """The queries of the first round are rows of the sets; nothing is joined or dealt for them."""
    rows = [(1, 7, 7, 2, b"a"), (2, 8, 7, 2, b"b"), (3, 9, 9, 2, b"c"), (4, 8, 7, 2, b"d")]
    spark.createDataFrame(rows, "node long, g long, first long, n long, tokens binary").write.parquet(str(tmp_path / "sets"))
    asked = jaccard_join.to_first(spark.read.parquet(str(tmp_path / "sets")))
    assert sorted((r.node, r.g) for r in asked.collect()) == [(2, 7), (4, 7)]
    plan = asked._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_jaccard_odd_rows(spark, odd):
    long = " ".join(f"w{i % 5000}x{i // 7}" for i in range(400_000))
    more = [(50, long, None), (51, long + " tail", None), (None, "no id at all, five words more", None), (None, "one TWO three four five", None), (7, "other text of an id that is taken", None)]
    df = odd.unionByName(spark.createDataFrame(more, "doc_id long, text string, source string"), allowMissingColumns=True)
    df = df.withColumn("n", F.lit(1)).withColumn("component", F.lit("c")).withColumn("g", F.lit(3)).withColumn("parts", F.lit(None).cast("binary"))
    data = [(r.doc_id, r.text) for r in df.collect()]
    assert answer(jaccard_join.linked(df, size=3, similarity=(9, 10))) == brute_links(data, 3, 9, 10)
    assert jaccard_join.linked(df.limit(0)).count() == 0


def test_parts_never_miss():
    """Sets at or above the threshold share a part, whatever their sizes."""
    rng = np.random.default_rng(4)
    for p, q in ((9, 10), (4, 5), (1, 2)):
        for n in (*range(1, 40), 90, 300, 700):
            for _ in range(6):
                a = np.unique(rng.integers(0, 2**64, n, np.uint64))
                common = -(-p * len(a) // q)
                extra = (q * common) // p - len(a)  # the most that the threshold allows
                b = np.unique(np.r_[rng.choice(a, common, False), rng.integers(0, 2**64, max(0, extra), np.uint64)])
                both = len(np.intersect1d(a, b))
                if both != len(a) or len(a) != len(b):
                    if q * both >= p * (len(a) + len(b) - both):
                        assert len(np.intersect1d(jaccard_join.part_keys(a, p, q), jaccard_join.part_keys(b, p, q))), (n, p, q)


# --- clustering ------------------------------------------------------------------

def brute_clusters(data, dim, scale, k, rounds):
    """[(id, vector)] -> sorted (id, cluster, distance, inertia of cluster, inertia, digest of centroid)."""
    most = heap_kmeans.LARGEST
    kept = [(i, [max(-most, min(most, int(np.floor(scale * float(x))))) for x in v]) for i, v in data
            if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, h(f"2:{r[0]}"), r[1]))
    centroids = [v for _, v in order[:k]]
    for r in range(rounds + 1):
        near = [min((sum((x - y) ** 2 for x, y in zip(v, c)), j) for j, c in enumerate(centroids)) for _, v in kept]
        if r < rounds:
            for j in range(len(centroids)):
                mine = [v for (_, v), (_, c) in zip(kept, near) if c == j]
                if mine:
                    centroids[j] = [sum(x) // len(mine) for x in zip(*mine)]
    inertia = {j: sum(d for d, c in near if c == j) for j in range(len(centroids))}
    return sorted((str(i), c, d, inertia[c], sum(inertia.values()), h(",".join(map(str, centroids[c])))) for (i, _), (d, c) in zip(kept, near))


def found(df):
    return sorted((str(r.id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


def test_clustering_query(spark, rows):
    got = entry.queries()["op13_centroid_clustering"](spark, FOLDER).withColumnRenamed("vec_id", "id")
    assert found(got) == brute_clusters(rows("embeddings", "vec_id, embedding"), 64, 256, 40, 5)


def test_clustering_odd_rows(spark, monkeypatch):
    """Ties, copies, NULLs, wrong lengths, large values, clashing names, several cells."""
    monkeypatch.setattr(heap_kmeans, "CELL", 16)
    monkeypatch.setattr(heap_kmeans, "CELLS_PER_BUCKET", 2)
    rng = random.Random(5)
    data = [(i, [rng.choice((-1.0, 0.0, 0.25, 1.0)) for _ in range(3)]) for i in range(200)]
    data += [(i, v) for i, v in data[:30]] + [(None, [0.5, 0.5, 0.5]), (None, [-3.0, 0.5, 0.5]), (300, None), (301, []), (302, [1.0, 2.0]), (303, [1.0, None, 2.0]),
                                             (304, [float("nan"), 0.0, 0.0]), (305, [float("inf"), 0.0, 0.0]), (306, [1e30, -1e30, 0.0]), (307, [1e5, 0.0, -0.001])]
    df = spark.createDataFrame([(i, v, i, "x") for i, v in data], "vec_id long, embedding array<double>, cluster long, cell string").repartition(5)
    for k, rounds in ((7, 5), (1, 2), (500, 1)):
        assert found(heap_kmeans.clustered(df, dim=3, clusters=k, rounds=rounds)) == brute_clusters(data, 3, 256, k, rounds)
    assert heap_kmeans.clustered(df.limit(0), dim=3).count() == 0


def test_bounds_spare_rescans():
    """Far clusters: after the first round hardly a vector is looked at again, and none wrongly kept."""
    rng = np.random.default_rng(1)
    centers = rng.integers(-4000, 4000, (10, 8))
    m = (centers[rng.integers(0, 10, 2000)] + rng.integers(-100, 100, (2000, 8))).astype("<i4")
    c, drift, state = centers + rng.integers(-60, 60, centers.shape), np.zeros(10), (None, None)
    scanned = []
    for _ in range(4):
        assigned, heaps, _, n = heap_kmeans.advance(len(m), m, *state, c, drift)
        assert (np.frombuffer(assigned, "<i4") == heap_kmeans.nearest(m, c)[0]).all()
        scanned.append(n)
        mine = np.frombuffer(assigned, "<i4")
        new = np.array([m[mine == j].sum(0, dtype=np.int64) // max(1, (mine == j).sum()) if (mine == j).any() else c[j] for j in range(10)])
        step, others = heap_kmeans._moved(c, new)
        drift, c, state = (drift + step + others) * (1 + 1e-12), new, (assigned, heaps)
    assert scanned[0] == 2000 and sum(scanned[1:]) < 200
