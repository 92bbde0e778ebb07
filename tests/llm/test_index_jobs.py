import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerscope.llm import bitmin, merkle, search
from ledgerscope.llm.common import dealt_join
from tests.llm.test_corpus_jobs import edited, prose


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


# ---------------------------------------------------------------- b-bit MinHash


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t or ""))
        sets.append(frozenset(tuple(w[i:i + 2]) for i in range(max(1, len(w) - 1))) if w else frozenset())
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    least = collections.defaultdict(list)
    for r, (d, _) in zip(root, rows, strict=True):
        least[r].append(d)
    return {d: (len(s), min(least[r])) for (d, _), s, r in zip(rows, sets, root, strict=True)}


def near_rows(rng):
    rows = []
    for g in range(6):
        text = prose(90, rng)
        for i in range(12):
            rows.append((100 * g + i, text))
            text = edited(text, int(rng.integers(1, 6)), rng)  # a chain: its ends are not linked themselves
    rows += [(1000 + i, prose(int(rng.integers(1, 40)), rng)) for i in range(40)]
    return rows + [(2000, "One two"), (2001, "one  TWO"), (2002, "solo"), (2003, "SOLO"), (2004, ""), (2005, " "), (2006, None), (2007, "ÉTÉ lui"), (2008, "été lui")]


@pytest.mark.parametrize("rounds, size", [(2, 500), (0, 7), (1, 3)])
def test_bbit_components_against_brute_force(documents, monkeypatch, rounds, size):
    monkeypatch.setattr(bitmin, "STAR_ROUNDS", rounds)
    monkeypatch.setattr(bitmin, "SLICE", size)  # groups are dealt into several slices and blocks
    rows = near_rows(np.random.default_rng(5))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in bitmin.near_duplicates(documents(*rows)).collect()}
    assert got == brute_components(rows)


def test_sets_of_strangers_do_not_move(documents, monkeypatch):
    rng = np.random.default_rng(8)
    base = " ".join(f"{w}{i}" for i, w in enumerate(prose(200, rng).split()))
    rows = [(i, edited(base, 25, rng)) for i in range(30)]  # they share bands, at a similarity of about 0.4
    moved, met = [], []
    real_stars, real_buckets = bitmin.check_stars, bitmin.open_buckets
    monkeypatch.setattr(bitmin, "check_stars", lambda pairs, sets, *a: moved.append(sets.count()) or real_stars(pairs, sets, *a))
    monkeypatch.setattr(bitmin, "open_buckets", lambda *a: (out := real_buckets(*a), met.append(out.count()))[0])
    got = {r.doc_id: r.component_id for r in bitmin.near_duplicates(documents(*rows)).collect()}
    assert got == {d: c for d, (_, c) in brute_components(rows).items()}
    assert met[0] > 20 and sum(moved) == 0


def test_bbit_estimate(monkeypatch):
    signer = bitmin.BitSigner(*bitmin.bands_for())
    rng = np.random.default_rng(1)
    errors = []
    for share in (0.0, 0.3, 0.6, 0.8, 0.95):
        for _ in range(30):
            n = 400
            both = round(2 * n * share / (1 + share))
            a = rng.integers(0, 1 << 63, 2 * n - both, dtype=np.uint64)
            one, two = (signer.unpacked([signer.sign(np.sort(x))[1]]) for x in (a[:n], a[n - both:]))
            errors.append(signer.similarity(signer.equal_places(one[0], two))[0] - both / (2 * n - both))
    assert abs(np.mean(errors)) < 0.02 and np.max(np.abs(errors)) < 0.2
    assert 0.55 < signer.least_estimate(0.8) < 0.75
    assert len(signer.sign(a)[1]) == bitmin.BITS * -(-signer.size // 8)


def test_bbit_odd_rows(odd):
    got = sorted(((r.doc_id or -1, r.n_shingles, r.component_id, r.kept) for r in bitmin.near_duplicates(odd.withColumn("kept", F.lit(1))).collect()), key=str)
    by = collections.defaultdict(list)
    for d, *rest in got:
        by[d].append(tuple(rest))
    assert by[1] == by[1] and by[1][0] == (0, 1, True) and by[2][0] == (0, 2, True) and by[3][0] == (0, 3, True)
    assert by[4] == [(2, 4, True)] * 2 and by[-1] == [(2, None, True)] and by[5] == [(1, 5, True)]
    assert by[6][0][1:] == (6, True) and by[7][0][1:] == (6, False)
    assert bitmin.near_duplicates(odd.limit(0)).count() == 0


def test_hot_keys_are_dealt(spark, monkeypatch):
    from ledgerscope.llm import common

    monkeypatch.setattr(common, "is_small", lambda df, *a: False)
    left = spark.range(5000).select(F.when(F.col("id") < 3000, 7).when(F.col("id") < 4000, F.col("id")).alias("k"), "id")
    right = spark.range(3500).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left"):
        got, want = dealt_join(left, right, "k", how), left.join(right, "k", how)
        assert sorted(got.collect(), key=str) == sorted(want.select(*got.columns).collect(), key=str) and got.columns == want.columns


# ---------------------------------------------------------------- ranked search


def brute_ranked(docs, items, top=10):
    find = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+").findall
    words = [(d, collections.Counter(find(lower(t or "")))) for d, t in docs]
    total, n_docs = sum(sum(c.values()) for _, c in words), sum(1 for _, c in words if c)
    df = collections.Counter(t for _, c in words for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in words:
            n = sum(c.values())
            score = 0
            for t in find(lower(text or "")):
                if t in c:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * (10**9 * c[t] // (1000 * c[t] + 8 * (25 + 75 * n * n_docs // total)))
            if score > 0:
                scored.append((-score, math.inf if d is None else d))
        out += [(item, k + 1, None if d == math.inf else d, -s) for k, (s, d) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


def result(found):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in found.collect()), key=str)


@pytest.fixture
def corpus():
    rng = np.random.default_rng(8)
    docs = [(i, f"{prose(int(rng.integers(5, 120)), rng)} Ähre{i % 9} x{i % 50} {'rare ' * (i % 11 == 0) * int(rng.integers(1, 30))}") for i in range(300)]
    items = [(f"i{k}", f"{prose(12, rng)} x{k} Ähre{k % 9} rare") for k in range(20)] + [("none", "nothing has this"), ("one", "x3"), ("blank", " .,"), ("null", None), ("twice", "x4 X4 x4 rare")]
    return docs, items


def test_ranked_against_brute_force(spark, documents, corpus, monkeypatch):
    docs, items = corpus
    table = spark.createDataFrame(items, "item_id string, text string")
    want = brute_ranked(docs, items)
    assert result(search.ranked(documents(*docs), table)) == want
    monkeypatch.setattr(search, "QUERY_TERMS", 60)  # several blocks of queries, several broadcasts
    monkeypatch.setattr(search, "BLOCKS_AT_ONCE", 2)
    monkeypatch.setattr(search, "COLUMNS", 8)
    assert result(search.ranked(documents(*docs), table)) == want


def test_bounds_hold_and_exclude(spark, documents, corpus):
    docs, _ = corpus
    rows = documents(*docs).select(F.col("doc_id").cast("string").alias("_key"), F.col("text").alias("_text"))
    words = {str(d): collections.Counter(t.decode() for t in search.terms_of(x)) for d, x in docs}
    n_docs, total = len(docs), sum(sum(c.values()) for c in words.values())
    q = search.Queries(["a"] * 3 + ["b"], ["rare", "x4", "ähre2", "x7"], [500, 900, 700, 800], [1, 2, 1, 1], [1] * 4)
    asked = {"a": [("rare", 500), ("x4", 1800), ("ähre2", 700)], "b": [("x7", 800)]}
    exact_sum = bound_sum = out = 0
    for block in search.index_of(rows).collect():
        bounds = q.bounds(block.width, block.columns, np.array(block.lengths), bytes(block.bits), n_docs, total)
        for item, line in zip(q.items, bounds, strict=True):
            for key, bound in zip(block["keys"], line, strict=False):
                c = words[key]
                m = 25 + 75 * sum(c.values()) * n_docs // total
                score = sum(w * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, w in asked[item] if t in c)
                assert bound >= score
                exact_sum, bound_sum, out = exact_sum + score, bound_sum + bound, out + (bound == 0)
    assert bound_sum < 1.5 * exact_sum and out > 300  # close, and most documents without the term are provably out


def test_ranked_odd_rows(spark, odd, documents):
    docs = odd.unionByName(documents((8, "Alpha!"), (8, "Alpha!"), (None, "alpha alpha")))
    items = spark.createDataFrame([(1, "ALPHA beta"), (1, "ALPHA beta"), (1, "three"), (None, "id")], "item_id long, text string").withColumn("score", F.lit("clash"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute_ranked(rows, [(1, "ALPHA beta"), (1, "three"), (None, "id")])
    assert result(search.ranked(docs.withColumn("rank", F.lit(0)), items)) == want
    assert search.ranked(docs.limit(0), items).count() == 0 and search.ranked(docs, items.limit(0)).count() == 0


# ---------------------------------------------------------------- Merkle manifest


def brute_manifest(rows, width=16):
    def h(*parts):
        return hashlib.sha256("".join(parts).encode()).hexdigest()

    def leaf(row, change=False):
        d, t, lang, source, n = row
        t = lower(t) if change and t is not None else t
        return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (d, source, lang, n, t)))

    def tree(nodes):
        """root, log of (level, node) in completion order, and per node (siblings, way of (slot, run))"""
        ways, own, log = [[] for _ in nodes], list(range(len(nodes))), []
        while len(nodes) > 1:
            runs = [nodes[k:k + width] for k in range(0, len(nodes), width)]
            for w, x in zip(ways, own, strict=True):
                w.append((x % width, runs[x // width]))
            own, nodes = [x // width for x in own], [h(*r) for r in runs]
        return nodes[0], ways

    by = collections.defaultdict(list)
    for r in rows:
        by[r[3]].append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = tree([leaf(r) for r in by[s]])
    root, tops = tree([trees[s][0] for s in order])
    out = []
    for s, top in zip(order, tops, strict=True):
        for r, way in zip(by[s], trees[s][1], strict=True):
            way = way + top
            touched = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            x = leaf(r, touched)
            for slot, run in way:
                x = h(*run[:slot], x, *run[slot + 1:])
            proof = h(*(n for slot, run in way for k, n in enumerate(run) if k != slot))
            out.append((r[0], leaf(r), trees[s][0], root, proof, x, x == root))
    return sorted(out, key=str)


def manifest_of(docs):
    changed = {"text": F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")}
    touched = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return sorted((tuple(r) for r in merkle.manifest(docs, changed, touched).collect()), key=str)


def test_positions_are_the_postorder():
    for width in (2, 16):
        for n in list(range(1, 40)) + [255, 256, 257, 300, 4096, 4097]:
            nodes, want = [(0, i) for i in range(n)], []
            levels = merkle.height(n, width)

            def visit(level, node):
                if level:
                    for c in range(node * width, min((node + 1) * width, merkle.nodes_at(level - 1, n, width))):
                        visit(level - 1, c)
                want.append((level, node))

            visit(levels, 0)
            places = {merkle.position(level, node, n, width): (level, node) for level in range(levels + 1) for node in range(merkle.nodes_at(level, n, width))}
            assert [places[p] for p in range(len(places))] == want and len(nodes) == n


@pytest.mark.parametrize("levels", [3, 1])
def test_manifest_against_brute_force(spark, odd, documents, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "SEGMENT", 16**levels)  # with 1: builders of one run, several layers
    rows = [(i, f"Text {i} É", "en", "big") for i in range(600)] + [(i, "Two", None, f"s{i % 40:02d}") for i in range(80)] + [(3, "x", "en", None), (9, None, "de", "big")]
    docs = odd.unionByName(documents(*rows))
    want = brute_manifest([(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in docs.collect()])
    got = manifest_of(docs.withColumn("leaf", F.lit("clash")).withColumn("number", F.lit(1)))
    assert got == want and {g[-1] for g in got} == {True, False} and len({g[3] for g in got}) == 1


@pytest.mark.parametrize("levels", [3, 1])
def test_append_log(spark, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "SEGMENT", 16**levels)
    sizes = {"a": 1, "b": 16, "c": 300, "d": 17}
    leaves = spark.createDataFrame([(g, i, f"{g}{i:063d}", str(i), None) for g, n in sizes.items() for i in range(n)], "grp string, at int, node string, id string, other string")
    numbers = merkle.numbered(leaves, "grp", ["at"]).drop("at")
    found = collections.defaultdict(dict)
    for r in merkle.log_rows(merkle.layers_of(numbers)).collect():
        assert r.position not in found[r.grp]
        found[r.grp][r.position] = r.hash
    for g, n in sizes.items():
        want = merkle.log_of([f"{g}{i:063d}" for i in range(n)], merkle.height(n))
        assert [found[g][p] for p in range(len(want))] == want and len(found[g]) == len(want)


def test_manifest_of_few_rows(documents):
    assert manifest_of(documents((1, "a")).limit(0)) == []
    (one,) = manifest_of(documents((1, "Only")))
    assert one[1] == one[2] == one[3] and one[4] == hashlib.sha256(b"").hexdigest()
    assert manifest_of(documents((1, "a"), (1, "a"), (2, "B", None, None))) == brute_manifest([(1, "a", "en", "a", 1)] * 2 + [(2, "B", None, None, 1)])
