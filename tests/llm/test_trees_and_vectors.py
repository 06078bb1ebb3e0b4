"""Merkle manifests, exact clustering and fingerprints of documents, against plain programs."""

import random
import re
import zlib
from hashlib import sha256
from math import floor

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from linkloom.llm import merkle
from linkloom.llm.kmeans import Clustering, assign, clustered, clusters, distances, nearest
from linkloom.llm.merkle import Merkle, manifest
from linkloom.llm.simhash import Covering, anchors, by_midpoints, fingerprinted, links, simhash_groups

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# Merkle manifest


def _h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def _leaf(doc_id, text, lang, source, n_chars):
    return _h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def _tree(leaves, arity):
    """The root, and of each leaf the siblings before and after it and its ancestors."""
    ways, level, at = [[] for _ in leaves], leaves, list(range(len(leaves)))
    while len(level) > 1:
        for k, i in enumerate(at):
            run = level[i // arity * arity :][:arity]
            ways[k].append(("".join(run[: i % arity]), "".join(run[i % arity + 1 :])))
        level = [_h(*level[i : i + arity]) for i in range(0, len(level), arity)]
        at = [i // arity for i in at]
    return level[0], ways


def _manifest(rows, arity):
    first = lambda v: (v is not None, v if v is not None else 0)
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    own = {}
    for s in sources:
        mine = sorted(((first(r[0]), _leaf(*r), r) for r in rows if r[3] == s), key=lambda x: x[:2])
        own[s] = (mine, *_tree([m[1] for m in mine], arity))
    root, ways = _tree([own[s][1] for s in sources], arity)
    out = []
    for s, above in zip(sources, ways):
        mine, subroot, below = own[s]
        for (_, leaf, r), way in zip(mine, below):
            low = None if r[1] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1])
            tampered = zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 5 == 0
            folded = _leaf(r[0], low, *r[2:]) if tampered else leaf
            for left, right in way + above:
                folded = _h(left, folded, right)
            out.append((r[0], leaf, subroot, root, _h(*[a + b for a, b in way + above]), folded, folded == root))
    return sorted(out, key=str)


def _told(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def _documents(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = rng.choice(["hot"] * 6 + [None, "", "é", "z", "hot2"] + [f"s{rng.randrange(40)}"] * 3)
        rows.append((i if i % 17 else 3, rng.choice([None, "", "Ab c", f"Text {i}", "lower only"]), rng.choice([None, "en", "de"]), source, rng.choice([None, i])))
    return rows + rows[:5] + [(None, "Null Id", None, "hot", None), (None, "x", None, None, 1)]


@pytest.mark.parametrize("arity,per_part,merged", [(16, 100_000, 16), (2, 9, 2), (3, 25, 4), (16, 40, 3)])
def test_manifest_is_that_of_a_plain_program_however_it_is_cut(spark, arity, per_part, merged):
    rows = _documents(400, arity)
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    assert _told(manifest(df, Merkle(arity=arity, leaves_per_part=per_part, merged_parts=merged))) == _manifest(rows, arity)


def test_manifests_of_one_leaf_one_source_and_none(spark):
    for rows in ([(7, "A", "en", "s", 1)], [(i, f"T{i}", "en", None, 1) for i in range(50)], [(i, None, None, f"s{i}", None) for i in range(300)]):
        df = spark.createDataFrame(rows, DOCS)
        assert _told(manifest(df, Merkle(leaves_per_part=10, merged_parts=2))) == _manifest(rows, 16)
    assert manifest(spark.createDataFrame([], DOCS)).collect() == []


def test_merging_fragments_is_associative():
    rng = random.Random(5)
    hashes = [_h(str(i)).encode() for i in range(333)]
    cuts = [0, 10, 11, 140, 200, 333]
    parts = [list(merkle.Run(merkle.DOCUMENTS, 0, 333, a, b"".join(hashes[a:b]), 16).unresolved()) for a, b in zip(cuts, cuts[1:])]
    for _ in range(5):
        rng.shuffle(parts)
        left = []
        for p in parts:
            left, _ = merkle.merge(left + p, 1, 16)
        pair, _ = merkle.merge(parts[0] + parts[1], 1, 16)
        rest, _ = merkle.merge(parts[2] + parts[3] + parts[4], 1, 16)
        assert left == merkle.merge(pair + rest, 1, 16)[0] == [(merkle.SOURCES, 0, 1, 0, 0, _tree([h.decode() for h in hashes], 16)[0].encode())]
        assert max(len(p) for p in parts) <= 2 * 15 * 3


def test_a_manifest_ignores_further_columns_and_finds_what_was_changed(spark):
    df = spark.createDataFrame([(i, f"Big {i}", "en", "s", i) for i in range(60)], DOCS)
    more = df.selectExpr("*", "1 as part", "2 as place", "3 as leaf", "4 as siblings")
    assert _told(manifest(more)) == _told(manifest(df))
    changed = {r.doc_id for r in manifest(df).where("not verified").collect()}
    assert changed == {i for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 0}


# Clustering


def _plain_clusters(rows, k=8, rounds=10):
    v = [(i, [floor(1024 * float(x)) for x in e]) for i, e in rows if e is not None and len(e) == 64 and all(x is not None and np.isfinite(x) for x in e)]
    start = sorted(v, key=lambda r: sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest())[:k]
    centroids = [list(e) for _, e in start]
    near = lambda e: min(range(len(centroids)), key=lambda j: (sum((a - b) ** 2 for a, b in zip(e, centroids[j])), j))
    for _ in range(rounds):
        own = [near(e) for _, e in v]
        for j in range(len(centroids)):
            mine = [e for (_, e), o in zip(v, own) if o == j]
            if mine:
                centroids[j] = [sum(c) // len(mine) for c in zip(*mine)]
    own = [near(e) for _, e in v]
    d = [sum((a - b) ** 2 for a, b in zip(e, centroids[o])) for (_, e), o in zip(v, own)]
    each = [sum(x for x, o in zip(d, own) if o == j) for j in range(len(centroids))]
    name = [sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, o, x, each[o], sum(d), name[o]) for (i, _), o, x in zip(v, own, d)), key=str)


VECTORS = "vec_id long, embedding array<float>"


def _vectors(n, seed, spread=1.0, groups=8):
    rng = np.random.default_rng(seed)
    middle = rng.normal(0, 1, (groups, 64))
    return [(i, (middle[i % groups] + rng.normal(0, spread, 64)).astype(np.float32).tolist()) for i in range(n)]


@pytest.mark.parametrize("spread,groups", [(0.1, 8), (1.0, 8), (1.0, 3), (0.02, 20)])
def test_clusters_are_those_of_plain_rounds(spark, spread, groups):
    rows = _vectors(400, groups, spread, groups)
    assert _told(clustered(spark.createDataFrame(rows, VECTORS).repartition(3))) == _plain_clusters(rows)


def test_clusters_with_vectors_that_do_not_count_repeats_and_ties(spark):
    rows = _vectors(40, 1)
    rows += [(1000, None), (1001, [1.0] * 63), (1002, [1.0] * 63 + [None]), (1003, [1.0] * 63 + [float("nan")]), (1004, [float("inf")] * 64), (1005, [])]
    rows += [(2000 + i, [float(i % 2)] * 64) for i in range(30)] + [(None, [0.5] * 64)] + rows[:7]
    df = spark.createDataFrame(rows, VECTORS)
    assert _told(clustered(df.selectExpr("*", "1 as cluster", "2 as v", "3 as distance"))) == _plain_clusters(rows)
    one = [(5, [0.25] * 64)]
    assert _told(clustered(spark.createDataFrame(one, VECTORS))) == _plain_clusters(one)
    same = [(i, [0.25] * 64) for i in range(20)]
    assert _told(clustered(spark.createDataFrame(same, VECTORS))) == _plain_clusters(same)
    assert clustered(spark.createDataFrame([], VECTORS)).collect() == []


def test_bounds_spare_vectors_and_snapshots_are_few(spark):
    rows = _vectors(600, 3, 0.3)
    _, _, log = clusters(spark.createDataFrame(rows, VECTORS), Clustering())
    assert len(log) == 10 and log[0]["snapshot"] and sum(r["snapshot"] for r in log) < 6
    assert sum(r["rescanned"] for r in log) < 0.5 * 10 * 600 and all(r["vectors"] == 600 for r in log)


def test_assignment_is_exact_from_any_older_bounds():
    rng = np.random.default_rng(9)
    for scale in (3, 1000, 1 << 24):
        x = rng.integers(-scale, scale, (500, 64)).astype(np.int32)
        old = rng.integers(-scale, scale, (8, 64))
        order, bounds = nearest(x, old, 3)
        for step in (0, 1, scale // 10, scale):
            new = old + rng.integers(-step - 1, step + 1, old.shape)
            new[7] = new[2]  # ties go to the lesser number
            best, _, _ = assign(x, order, bounds, new, np.sqrt(((new - old) ** 2).sum(1).astype(float)))
            exact = np.array([[sum((int(a) - int(b)) ** 2 for a, b in zip(v, c)) for c in new] for v in x[:40]])
            assert (distances(x[:40], new) == exact).all() and (best[:40] == exact.argmin(1)).all()
            assert (best == distances(x, new).argmin(1)).all()


def test_a_component_too_large_for_exact_distances_is_an_error(spark):
    with pytest.raises(Exception, match="need not fit a long"):
        clustered(spark.createDataFrame([(1, [1e9] * 64)], VECTORS)).collect()


# Fingerprints


def _fingerprint(text, n=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    h = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def _groups(prints):
    """The least id that links lead to, by all pairs."""
    ids = list(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if bin(prints[a] ^ prints[b]).count("1") <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def _texts():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choices(words, k=rng.choice([1, 2, 3, 5, 40, 400]))) for _ in range(120)]
    for t in texts[:40]:  # near copies
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    return texts + [None, "", " \t\n", "one", "ONE", "two  words", "a\x0bb\x0cc\rd", "É é ß", "ab cd x y", texts[3], texts[3].upper(), "x " * 50_000]


def test_fingerprints_and_groups_are_those_of_a_plain_program(spark):
    texts = _texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = {i: _fingerprint(t) for i, t in enumerate(texts)}
    assert {r.doc_id: r.fp & (1 << 64) - 1 for r in fingerprinted(df).collect()} == want
    groups = _groups(want)
    for c in (Covering(), Covering(direct_members=1), Covering(anchor_members=1), Covering(anchor_members=1, broadcast_anchors=0)):
        got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_groups(df, c).collect()}
        assert got == {i: (f"{want[i]:016x}", groups[i]) for i in want}


def test_all_links_of_crowded_fingerprints_are_found(spark):
    rng = np.random.default_rng(2)
    centre = rng.integers(0, 1 << 63, 4, dtype=np.int64)
    fp = {int(c) for c in centre}
    while len(fp) < 500:  # every one within a few bits of others, in any half
        fp.add(int(rng.choice(list(fp))) ^ (1 << int(rng.integers(0, 63))) ^ (1 << int(rng.integers(0, 63))))
    fp = sorted(fp)
    a = np.array(fp)
    want = _groups({x: x & (1 << 64) - 1 for x in fp})
    df = spark.createDataFrame([(x,) for x in fp], "fp long").repartition(5)
    for c in (Covering(), Covering(direct_members=3), Covering(anchor_members=20)):
        root = {x: x for x in fp}
        for r in links(df, c).collect():
            x, y = r.a, r.b
            while root[x] != x:
                x = root[x]
            while root[y] != y:
                y = root[y]
            root[max(x, y)] = min(x, y)

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        assert {x: find(x) for x in fp} == want
    at, of = anchors(a)
    homes = {}
    for anchor, k in zip(at.tolist(), of.tolist()):
        homes.setdefault(anchor, set()).add(k)
    near = [(i, j) for i in range(200) for j in range(i) if bin((fp[i] ^ fp[j]) & (1 << 64) - 1).count("1") <= 2]
    assert near and all(any(i in s and j in s for s in homes.values()) for i, j in near[:300]) and len(at) <= 32 * len(fp)


def test_midpoints_join_exactly_what_is_within_two_bits():
    rng = np.random.default_rng(3)
    fp = np.unique((rng.integers(0, 1 << 8, 300, dtype=np.uint64) << np.uint64(50)) | np.uint64(5))
    x, y = by_midpoints(fp)
    assert (np.bitwise_count(fp[x] ^ fp[y]) <= 2).all()
    pairs = {(i, j) for i in range(len(fp)) for j in range(len(fp)) if i < j and int(fp[i] ^ fp[j]).bit_count() <= 2}
    reach = {i: i for i in range(len(fp))}
    for i, j in zip(x.tolist(), y.tolist()):
        a, b = reach[i], reach[j]
        reach = {k: min(a, b) if v in (a, b) else v for k, v in reach.items()}
    assert all(reach[i] == reach[j] for i, j in pairs)


def test_null_ids_repeats_empty_tables_and_further_columns(spark):
    schema = "doc_id long, text string"
    rows = [(None, "a b c d"), (None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (None, "quite another text of words"), (9, None), (8, "")]
    df = spark.createDataFrame(rows, schema).selectExpr("*", "1 as fp", "2 as anchor", "3 as vertex", "4 as root")
    got = sorted(((r.doc_id, r.component_id) for r in simhash_groups(df).collect()), key=str)
    assert got == sorted([(None, 4), (None, 4), (4, 4), (4, 4), (None, None), (9, 8), (8, 8)], key=str)
    assert simhash_groups(spark.createDataFrame([], schema)).collect() == []
