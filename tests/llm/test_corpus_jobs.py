import collections
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from ledgerscope.llm import decontam, graph, jaccard, line_dedup, mixing, warc
from ledgerscope.llm.common import words_of

RNG = np.random.default_rng(7)
VOCABULARY = [f"{a}{b}" for a in "ka lo mi tu ser vin".split() for b in "ran pol dek sim tor".split()]


def prose(n, rng=RNG):
    return " ".join(rng.choice(VOCABULARY, n))


def edited(text, changes, rng=RNG):
    words = text.split()
    for i in rng.choice(len(words), changes, replace=False):
        words[i] = f"new{rng.integers(10**6)}"
    return " ".join(words)


def brute_links(rows):
    by = collections.defaultdict(list)
    for d, t in rows:
        if t is not None:
            by[t].append(d)
    texts = list(by)
    sets = []
    for t in texts:
        w = words_of(t)
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root, links = list(range(len(texts))), collections.Counter()
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= 0.8 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    least = {r: min(d for i in range(len(texts)) if root[i] == r for d in by[texts[i]]) for r in set(root)}
    return {d: (least[root[i]], links[i], len(by[t])) for i, t in enumerate(texts) for d in by[t]}


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 1), (9, 8), (8, 7), (5, 5), (2, 1)] + [(100, 100 + i) for i in range(1, 60)] + [(300 + i, 301 + i) for i in range(40)]
    got = dict(graph.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {n: got[n] for n in (1, 2, 3, 7, 8, 9)} == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7} and 5 not in got
    assert all(got[100 + i] == 100 for i in range(60)) and all(got[300 + i] == 300 for i in range(41))
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def united(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for x, y in edges:
        x, y = find(x), find(y)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(root)}


@pytest.mark.parametrize("small", [True, False])
def test_components_of_random_edges_and_chains(spark, monkeypatch, small):
    monkeypatch.setattr(graph, "is_small", lambda df: small)
    rng = np.random.default_rng(17)
    chain = rng.permutation(40).tolist()
    edges = [(100 + x, 200 + y) for x, y in rng.integers(0, 60, (50, 2)).tolist()] + list(zip(chain, chain[1:], strict=False)) + [(300, 300 + k) for k in range(1, 30)]
    assert dict(graph.components(spark.createDataFrame(edges, "a long, b long")).collect()) == united(edges)


def test_components_take_few_jobs(spark):
    edges = [(k * 100, k * 100 + i) for k in range(5) for i in range(1, 60)]
    table = spark.createDataFrame(edges, "a long, b long")
    spark.sparkContext.setJobGroup("few-jobs", "components")
    try:
        assert dict(graph.components(table).collect()) == united(edges)
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few-jobs")) <= 14  # 24 with joins
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        spark.sparkContext.setLocalProperty("spark.job.description", None)


def test_bands_reach_the_recall():
    bands, rows = jaccard.bands_for()
    assert 1 - (1 - jaccard.THRESHOLD**rows) ** bands >= jaccard.RECALL and bands * rows <= jaccard.MOST_HASHES


def test_jaccard_against_brute_force(documents, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_TEXTS", 7)  # so that one group is dealt into several blocks
    base = prose(120)
    rows = [(i, edited(base, int(RNG.integers(0, 7)))) for i in range(60)]
    rows += [(100 + i, base) for i in range(5)] + [(200 + i, prose(int(RNG.integers(1, 60)))) for i in range(60)]
    rows += [(300, "one two three"), (301, "one  two three"), (302, "one two four"), (303, ""), (304, ""), (305, " ")]
    want = brute_links(rows)
    got = {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in jaccard.jaccard_join(documents(*rows)).collect()}
    assert got == want and max(v[1] for v in got.values()) > 8


def test_jaccard_counts_links_once_beside_empty_blocks(documents, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_WORDS", 150)  # three blocks for two texts: at least one is empty
    rng = np.random.default_rng(3)
    rows = []
    for i in range(20):
        base = prose(200, rng)
        rows += [(2 * i, base), (2 * i + 1, edited(base, 1, rng))]
    got = {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in jaccard.jaccard_join(documents(*rows)).collect()}
    assert got == brute_links(rows) and {v[1] for v in got.values()} == {1}


def test_jaccard_odd_rows(odd):
    got = jaccard.jaccard_join(odd.withColumn("class_id", F.lit("clash"))).collect()
    assert len(got) == 9
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append((r.class_id, r.n_links, r.n_copies))
    assert by[1] == [(1, 0, 1)] and by[4] == [(4, 0, 2)] * 2 and by[6] == [(6, 0, 2)] and by[7] == [(6, 0, 2)] and by[None] == [(None, 0, 1)]
    kept = [r.doc_id for r in jaccard.one_of_each(odd).collect()]
    assert sorted(map(str, kept)) == sorted(map(str, [1, 2, 3, 4, None, 5, 6]))
    assert jaccard.jaccard_join(odd.limit(0)).count() == 0


def test_line_dedup(documents, odd):
    long, lines = prose(60), [prose(12) for _ in range(40)]
    block = "\n".join(lines[:12])
    rows = [(1, f"{prose(9)}\n{long}\n{prose(5)}"), (2, f"{long}\n{prose(7)}\n{long}"), (3, f"start {prose(4)}\n{block}\n{prose(6)}"),
            (4, f"{prose(5)}\nother {prose(3)}\n{block}"), (5, "\n".join(lines[20:30])), (6, prose(200)), (7, "short\nline"), (8, "short\nline")]
    got = {r.doc_id: r for r in line_dedup.line_dedup(documents(*rows)).collect()}
    text = dict(rows)
    assert got[1].text == text[1] and got[1].n_removed == 0
    assert long not in got[2].text and got[2].n_removed == 2 and len(got[2].text.split()) == 7
    assert got[3].text == text[3] and 0 < got[4].n_removed <= 12
    assert all(x in text[4].split("\n") for x in got[4].text.split("\n"))
    assert all(got[i].text == text[i] for i in (5, 6, 7, 8))
    out = line_dedup.line_dedup(odd.withColumn("n_removed", F.lit("clash"))).collect()
    assert len(out) == 9 and {r.doc_id: r.text for r in out}[1] is None and sum(r.n_removed for r in out) == 1
    assert line_dedup.line_dedup(odd.limit(0)).count() == 0


def test_chunks_cover_all_lines_and_resist_shifts():
    lines = [prose(int(RNG.integers(1, 70))) for _ in range(80)]
    chunks = list(line_dedup.chunks_of("\n".join(lines)))
    assert [x for lo, hi, _ in chunks for x in lines[lo:hi]] == lines
    moved = ["an inserted line", *lines]
    later = {tuple(moved[lo:hi]) for lo, hi, _ in line_dedup.chunks_of("\n".join(moved))}
    assert sum(tuple(lines[lo:hi]) in later for lo, hi, _ in chunks) >= len(chunks) - 4


@pytest.mark.parametrize("n_lines, n_words", [(2, 26), (3, 20), (4, 15), (6, 10), (12, 5), (20, 3)])
def test_line_dedup_removes_whole_passages_of_short_lines(documents, n_lines, n_words):
    rng = np.random.default_rng(n_lines)
    rows, want = [], {}
    for i in range(30):
        passage = [f"p{i}x{j} {prose(n_words - 1, rng)}" for j in range(n_lines)]
        for d in (2 * i, 2 * i + 1):
            around = [[f"a{d}x{k}x{j} {prose(int(rng.integers(0, 9)), rng)}" for j in range(int(rng.integers(0, 7)))] for k in (0, 1)]
            rows.append((d, "\n".join([*around[0], *passage, *around[1]])))
            want[d] = (rows[-1][1], 0) if d % 2 == 0 else ("\n".join(around[0] + around[1]), n_lines)
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.line_dedup(documents(*rows)).collect()}
    assert got == want


def covered(rows, least=line_dedup.LONG_WORDS):
    """Lines of each text that lie in a run of lines, of least words, that an earlier text or place has, or in such a chunk."""
    seen, out, chunks = set(), {}, set()
    for d, t in rows:
        lines, gone = t.split("\n"), set()
        for hi in range(1, len(lines) + 1):
            for lo in range(hi):
                run = tuple(lines[lo:hi])
                if len(words_of(" ".join(run))) >= least:
                    if run in seen:
                        gone |= set(range(lo, hi))
        for lo, hi, removable in line_dedup.chunks_of(t):
            if removable and tuple(lines[lo:hi]) in chunks:
                gone |= set(range(lo, hi))
            elif removable:
                chunks.add(tuple(lines[lo:hi]))
        for hi in range(1, len(lines) + 1):
            seen |= {tuple(lines[lo:hi]) for lo in range(hi)}
        out[d] = "\n".join(x for i, x in enumerate(lines) if i not in gone), len(gone)
    return out


def test_line_dedup_against_brute_force(documents):
    rng = np.random.default_rng(5)
    pool = [[prose(int(rng.integers(1, 40)), rng) for _ in range(int(rng.integers(1, 9)))] for _ in range(12)]
    rows = []
    for d in range(60):
        lines = []
        for p in rng.choice(len(pool), 3, replace=False):
            cut = int(rng.integers(0, len(pool[p])))
            lines += [f"own{d}x{p} {prose(int(rng.integers(0, 60)), rng)}", *pool[p][cut:]]
        rows.append((d, "\n".join(lines)))
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.line_dedup(documents(*rows)).collect()}
    assert got == covered(rows) and sum(n > 0 for _, n in got.values()) > 20


def test_line_dedup_removes_repeated_chunks_of_few_words(documents):
    """Passages of 16 to 48 words: what lies between content-defined boundaries inside the passage goes, nothing else."""
    rng = np.random.default_rng(12)
    rows, passages = [], {}
    for i in range(40):
        passages[i] = [f"q{i}x{j} {prose(5, rng)}" for j in range(8)]
        for d in (2 * i, 2 * i + 1):
            rows.append((d, "\n".join([f"a{d} {prose(6, rng)}", *passages[i], f"z{d} {prose(6, rng)}"])))
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.line_dedup(documents(*rows)).collect()}
    assert got == covered(rows)
    found = [got[2 * i + 1][1] for i in range(40)]
    assert all(got[2 * i][1] == 0 for i in range(40)) and sum(n > 0 for n in found) >= 20
    assert all(f"a{d} " in got[d][0] and f"z{d} " in got[d][0] for d, _ in rows)


def test_line_dedup_keeps_the_first_place_of_a_run_that_overlaps_itself(documents):
    line = prose(10)
    rows = [(1, "\n".join([line] * 40)), (2, f"x\n{line}\n{line}"), (3, f"y\n\n{chr(10).join([line, ''] * 5)}z")]
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.line_dedup(documents(*rows)).collect()}
    assert got == {1: ("\n".join([line] * 5), 35), 2: (rows[1][1], 0), 3: (rows[2][1], 0)}


def brute_contamination(docs, items):
    out = {}
    windows = [(i, tuple(w[k:k + 13])) for i, t in items for w in [decontam.terms_of(t)] for k in range(max(1, len(w) - 12) if w else 0)]
    for d, t in docs:
        w, hit, seen = decontam.terms_of(t), set(), set()
        for i, g in windows:
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k:k + len(g)]) == g:
                    hit |= set(range(k, k + len(g)))
                    seen.add(str(i))
        out[d] = (len(w), len(hit), sorted(seen))
    return out


def test_contamination_against_brute_force(spark, documents, monkeypatch):
    monkeypatch.setattr(decontam, "SEGMENT_WORDS", 90)  # texts over several segments, and several texts a segment
    items = [(i, prose(n)) for i, n in enumerate((5, 13, 30, 1, 60, 17))] + [(6, None), (7, "  "), (8, "ÉTÉ Élan vital")]
    docs = [(i, prose(int(RNG.integers(0, 260)))) for i in range(30)]
    docs += [(100 + i, f"{prose(80 + i)}. {t.upper()}! {prose(3)}") for i, t in items if t] + [(200, None), (201, ""), (202, "été Élan Vital")]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.items) for r in decontam.contamination(documents(*docs), table).collect()}
    assert got == brute_contamination(docs, items) and sum(v[1] > 0 for v in got.values()) > 5


def test_contamination_odd_rows(spark, odd):
    items = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    got = decontam.contamination(odd.withColumn("item_id", F.lit(1)), items).collect()
    assert len(got) == 9 and [r.contaminated for r in got if r.doc_id == 4] == [True, True] and sum(r.n_hit for r in got) == 6
    assert not any(r.contaminated for r in decontam.contamination(odd, items.limit(0)).collect())
    assert decontam.contamination(odd.limit(0), items).count() == 0


def test_proximity(spark, documents):
    docs = documents((1, "red blue x green"), (2, "green red y y y blue"), (3, "red blue"), (4, "x green"))
    items = spark.createDataFrame([(1, "blue green red")], "item_id long, text string")
    found = decontam.occurrences(decontam.build_index(docs), items, span=4)
    rows = {r.id: r for r in decontam.rows_of(decontam.build_index(docs)).collect()}
    assert found.count() >= 1 and len(rows) == 4 and found.filter("hi - lo = 4").count() == found.count()
    assert found.select("id").distinct().count() == 1


def filled(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (i % 3) + 1 for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        scale = (total - sum(3 * sizes[s] for s in full)) / max(1, sum(weight[s] for s in sizes if s not in full))
        more = {s for s in sizes if s not in full and weight[s] * scale > 3 * sizes[s]}
        if not more:
            return {s: 3.0 * sizes[s] if s in full else weight[s] * scale for s in sizes}
        full |= more


def test_mixing(documents, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 20)
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 150)
    rows = [(i, prose(int(RNG.integers(0, 60))), "en", ["hot", "b", "c", None, "tiny"][0 if i % 3 == 0 else i % 4 + 1 if i % 50 == 0 else i % 3 + 1]) for i in range(600)]
    docs = documents(*rows)
    got = mixing.mix(docs).toPandas()
    sizes = collections.Counter()
    for _, t, _, s in rows:
        sizes[s] += len(words_of(t))
    want = filled(dict(sizes))
    got["s"] = got["source"].where(got["source"].notna(), "null")
    for s, part in got.groupby("s"):
        name = None if s == "null" else s
        assert part["target"].iloc[0] == pytest.approx(want[name]) and part["source_size"].iloc[0] == sizes[name]
        assert abs(part["taken"].sum() - want[name]) <= 10
    assert (got["taken"] <= 3 * got["size"]).all() and (got["taken"] == got["size"] * got["copies"]).all()
    assert (got["places"].map(len) == got["copies"]).all()
    shards = collections.Counter()
    for p, n in zip(got["places"], got["size"], strict=True):
        for x in p:
            shards[x["shard"]] += n
    assert len(shards) == mixing.SHARDS and max(shards.values()) < 1.6 * min(shards.values())
    again = mixing.mix(docs.repartition(7)).toPandas().set_index("doc_id")
    assert (again.loc[got["doc_id"], "taken"].to_numpy() == got["taken"].to_numpy()).all()
    out = mixing.shards_of(docs, mixing.mix(docs))
    assert out.count() == got["copies"].sum()


def test_splitting_tree_is_exact():
    quota = np.array([5, 0, 137, 22, 1])
    dealt = mixing.deal(quota, 6, np.random.default_rng(1))
    assert (dealt.sum(0) == quota).all() and dealt.sum(1).max() - dealt.sum(1).min() <= 2


def test_the_tree_splits_the_quotas_of_all_sources(spark, monkeypatch):
    seen = []
    draw = mixing.split
    monkeypatch.setattr(mixing, "split", lambda quota, totals, rng: seen.append(len(quota)) or draw(quota, totals, rng))
    totals = mixing.even(170, 6)
    assert totals.sum() == 170 and totals.max() - totals.min() <= 1
    held = mixing.split(np.array([40, 0, 100, 30]), totals, np.random.default_rng(3))
    assert (held.sum(1) == totals).all() and (held.sum(0) == [40, 0, 100, 30]).all() and seen[0] == 4
    # shares of a source in a shard are those of draws without replacement
    rng, first = np.random.default_rng(8), []
    for _ in range(2000):
        first.append(draw(np.array([60, 40]), mixing.even(100, 4), rng)[1, 0])
    assert abs(np.mean(first) - 15) < 0.2 and abs(np.var(first) - 25 * 0.6 * 0.4 * 75 / 99) < 0.5
    quotas = [(None, 7), ("a", 50), ("b", 0), *[(f"s{i}", i) for i in range(30)]]
    for most in (1000, 8):  # one group, and several
        monkeypatch.setattr(mixing, "GROUP_SOURCES", most)
        df = spark.createDataFrame(quotas, "source string, blocks long").repartition(4)
        runs = mixing.plan(df, 6).collect()
        assert sorted(map(tuple, runs), key=str) == sorted(map(tuple, mixing.plan(df.repartition(2), 6).collect()), key=str)
        for source, blocks in quotas:
            own = sorted((r["first"], r["blocks"]) for r in runs if r["source"] == source)
            assert sum(n for _, n in own) == blocks and [f for f, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))]
        per = collections.Counter()
        for r in runs:
            per[r["shard"]] += r["blocks"]
        assert len(per) == 6 and max(per.values()) - min(per.values()) <= 1


def test_mixing_odd_rows(odd):
    got = mixing.mix(odd.withColumn("size", F.lit("clash"))).collect()
    assert len(got) == 9 and sum(r.taken for r in got) > 0 and all(r.taken == 0 for r in got if r.size == 0)
    assert mixing.mix(odd.limit(0)).count() == 0


def test_warc_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "CHUNK", 700)
    big, odd_text = "é<p>\r\n\r\n" * 900, "WARC/1.1\r\n\r\n" * 100
    rows = [(1, "u", big), (2, "u\r\nX: y", big), (3, None, "x"), (4, "u", "x"), (5, "u", None), (6, "u", ""), (7, "u", odd_text), (None, "n", big), (8, "u", "y" * 999), (9, "u", "y" * 999), (9, "u", big)]
    pages = spark.createDataFrame(rows, T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType())]))
    got = warc.round_trip(pages.withColumn("digest", F.lit("clash")).repartition(3)).collect()
    assert len(got) == len(rows)
    have = collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got)
    want = collections.Counter()
    for i, _, h in rows:
        data = (h or "").encode()
        kind = ("revisit", 9) if h == big and i != 9 else ("response", None)
        want[(i, len(data), hashlib.sha1(data).hexdigest(), *kind)] += 1
    assert have == want
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_stages(spark, documents, tmp_path):
    item, passage, text = prose(40), prose(70), prose(150)
    rows = [(i, prose(80) + (f"\n{passage}" if i % 9 == 0 else "")) for i in range(60)]
    rows += [(100, text), (101, text), (102, edited(text, 3)), (103, item + " " + prose(50)), (104, None), (105, "")]
    docs = documents(*rows)
    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        assert stage(spark, docs.limit(0), folder).count() == 0
        docs = out
    left = {r.doc_id: r.text for r in docs.collect()}
    assert sum(passage in (t or "") for t in left.values()) == 1
    assert 100 in left and 101 not in left and 103 not in left and set(range(60)) <= set(left)
    final = corpus_pipeline.run(spark, folder).toPandas()
    assert set(final["doc_id"]) == set(left) and (final["taken"] <= 3 * final["size"]).all()
