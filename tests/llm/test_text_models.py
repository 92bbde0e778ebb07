import ctypes
import re
import tracemalloc
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerscope.llm import common, language, pii, quality, secret_scan, toxicity


def windows(texts, labels):
    rows = []
    for i, (t, y) in enumerate(zip(texts, labels, strict=True)):
        w = t.lower().split()
        rows += [(str(i), y, " ".join(w[s:s + toxicity.WINDOW])) for s in toxicity.window_starts(len(w))]
    return pd.DataFrame(rows, columns=["turn", "label", "window"])


def toy(n, seed):
    rng, texts, labels = np.random.default_rng(seed), [], []
    stems, clean = ["grumk", "vexil"], [a + b for a in "ba do mi lu".split() for b in "ner tal sof rin".split()]
    for i in range(n):
        words = rng.choice(clean, int(rng.integers(5, 130))).tolist()
        if i % 3 == 0:
            words[int(rng.integers(len(words)))] = stems[i % 2] + str(rng.choice(clean))
        texts.append(" ".join(words))
        labels.append(int(i % 3 == 0))
    return texts, labels


def test_windows_cover_every_word_and_overlap():
    for n in (1, 47, 48, 49, 84, 500):
        starts = toxicity.window_starts(n)
        assert set().union(*[range(s, min(n, s + toxicity.WINDOW)) for s in starts]) == set(range(n))
        assert all(b - a <= toxicity.STRIDE for a, b in zip(starts, starts[1:]))


def test_gradients():
    net = toxicity.Network(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    coded = toxicity.encode(["abc", "de", "stupid", "x"])
    index, mask = toxicity.stacked([np.array([0, 1, 2]), np.array([3, 2]), np.array([1])])
    mask, y = mask.astype(float), np.array([1, 0, 1.0])

    def loss():
        p = toxicity.sigmoid(net.forward(net.gates(net.inputs(coded))[index], mask))
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).sum()

    keep = {}
    logit = net.forward(net.gates(net.inputs(coded))[index], mask, keep)
    grad, dx = net.backward(toxicity.sigmoid(logit) - y, mask, keep)
    for name in (*grad, "bin"):
        at = (0,) * (net.p[name].ndim - 1) + (min(3, net.p[name].shape[-1] - 1),)
        was, ends = net.p[name][at], []
        for step in (1e-5, -1e-5):
            net.p[name][at] = was + step
            ends.append(loss())
        net.p[name][at] = was
        have = dx.sum((0, 1))[at] if name == "bin" else grad[name][at]
        assert (ends[0] - ends[1]) / 2e-5 == pytest.approx(have, rel=1e-4, abs=1e-8)


def test_network_finds_unseen_forms():
    texts, labels = toy(240, 1)
    net = toxicity.fit(windows(texts, labels))
    new, truth = toy(120, 2)
    said = toxicity.Scorer(net).score(new) >= toxicity.THRESHOLD
    assert (said == np.array(truth, bool)).mean() > 0.95


def test_toxicity_odd_rows(spark, odd):
    labels = spark.createDataFrame([(4, 1, 1), (6, 1, 0), (9, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(odd.withColumn("score", F.lit("clash")), labels, F.lit(True)).collect()
    assert len(got) == 9 and all(0 <= r.score <= 1 for r in got)
    assert all(r.score == 0 for r in got if not (r.text or "").split())
    assert len({r.score for r in got if r.doc_id == 4}) == 1
    none = toxicity.toxicity(odd, labels.limit(0), F.lit(True)).collect()
    assert {r.score for r in none} == {0.0}
    assert toxicity.toxicity(odd.limit(0), labels, F.lit(True)).count() == 0


def test_long_toxic_texts_train(spark, documents, monkeypatch):
    rng = np.random.default_rng(8)
    clean = [a + b for a in "ba do mi lu".split() for b in "ner tal sof rin".split()]
    rows = []
    for i in range(60):
        words = rng.choice(clean, 600).tolist()
        if i % 2:
            words[int(rng.integers(600))] = "grumk" + str(rng.choice(clean))
        rows.append((i, " ".join(words)))
    rows += [(100 + i, " ") for i in range(60)]
    labels = spark.createDataFrame([(i, 1, i % 2 if i < 100 else 1) for i, _ in rows] + [(200 + i, 1, 1) for i in range(60)], "doc_id long, quality int, toxic int")
    monkeypatch.setattr(toxicity, "SAMPLE_TOXIC", 30)  # labels without words or without a text use up none of it
    sample = toxicity.sample_windows(documents(*rows), labels, F.lit(True)).toPandas()
    toxic = sample[sample["label"] == 1].groupby("turn")["window"]
    assert len(toxic) == 30 and set(toxic.size()) == {len(toxicity.window_starts(600))}
    assert toxic.apply(lambda w: w.str.contains("grumk").any()).all()
    for most, texts in ((50, 2), (10, 1)):
        monkeypatch.setattr(toxicity, "SAMPLE_TOXIC_WINDOWS", most)
        sample = toxicity.sample_windows(documents(*rows), labels, F.lit(True)).toPandas()
        sizes = sample[sample["label"] == 1].groupby("turn").size()
        assert len(sizes) == texts and sizes.sum() <= most
    assert toxicity.toxic_room({("a", 1): 9, ("b", 1): 3, ("c", 2): 5}, 8) == {("b", 1): 3, ("c", 2): 5}


def test_many_rows_of_one_id_leave_room_for_the_others(spark, documents, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_TOXIC", 3)
    monkeypatch.setattr(toxicity, "SAMPLE_CLEAN", 4)
    rows = [(1, f"clean text number {i}") for i in range(300)] + [(1, "the same")] * 50 + [(10 + i, f"foul text {i}") for i in range(5)] + [(20 + i, f"other {i}") for i in range(5)]
    labels = spark.createDataFrame([(1, 1, 0)] + [(10 + i, 1, 1) for i in range(5)] + [(20 + i, 1, 0) for i in range(5)], "doc_id long, quality int, toxic int")
    sample = toxicity.sample_windows(documents(*rows), labels, F.lit(True)).toPandas()
    assert sorted(sample["label"]) == [0] * 4 + [1] * 3 and sample["turn"].nunique() == 7


def test_no_language_without_a_letter_and_no_least_share(spark, documents):
    en, fr = "the house and the garden with that thing", "la maison et le jardin avec cette chose"
    rows = [(i, (en if i % 2 else fr) + f" {i}", "en" if i % 2 else "fr") for i in range(40)]
    learned = language.fit(language.counts_of(documents(*rows), F.lit(True)))
    rare = " ".join([en] * 400 + [fr] * 4)  # one in a hundred words, but far above the penalty
    asked = documents((1, "½ ② 12"), (2, "①"), (3, "٣ __ 7"), (4, "½ house ②"), (5, rare))
    got = {r.doc_id: r for r in language.predict(asked, *learned).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4)] == ["und", "und", "und", "en"] and got[1].score == 0
    assert set(got[5].mixture) == {"en", "fr"} and 0.003 < got[5].mixture["fr"] < 0.03


def test_sets_left_out_by_the_bound_cannot_win(documents):
    """The same choice as fitting every set."""
    rng = np.random.default_rng(3)
    names = ["a", "b", "c"]
    words = [[f"{x}{y}{x}" for y in "klmnop"] for x in ("ar", "be", "co")]
    rows = [(i, " ".join(rng.choice(words[i % 3], 30)), names[i % 3]) for i in range(60)]
    texts = [[*rng.choice(words[0], 40), *rng.choice(words[i % 3], i % 20 + 1), *rng.choice(words[2], i % 7 + 1)] for i in range(80)]
    table = np.log(np.full((language.BINS, 3), 0.5) + sum(np.stack([np.bincount(language.grams(w)[0].ravel(), minlength=language.BINS) * (k == j) for j in range(3)], 1) * 20 for k, w in enumerate(words)))
    reader = language.Reader(names, (table - np.log(np.exp(table).sum(0))).astype(np.float32))
    _, _, mixed = reader.infer(texts)
    for text, found in zip(texts, mixed, strict=True):
        like = np.exp(reader.look_up(text)).T
        n = np.array([len(text)])
        full, _ = language.mixture(like, np.array([0]), n, np.ones((3, 1)), language.FIRST_ROUNDS)
        rank = np.argsort(np.argsort(-full, axis=0, kind="stable"), axis=0, kind="stable")
        values = []
        for k in (1, 2, 3):
            share, ll = language.mixture(like, np.array([0]), n, rank < k, 0 if k == 1 else language.ROUNDS)
            values.append((ll[0] - language.PENALTY * k * np.log(len(text) + 1) / 2, share))
            if k > 1 and values[-1][0] <= values[-2][0]:
                values.pop()
                break
        want = values[-1][1][:, 0]
        assert found == pytest.approx({names[j]: float(want[j]) for j in np.flatnonzero(want > 0)}, abs=1e-4)
    assert len({len(m) for m in mixed}) > 1 and rows


def test_language_mixture(spark, documents, odd):
    en, fr = "the house and the garden with that thing", "la maison et le jardin avec cette chose"
    rows = [(i, (en if i % 2 else fr) + f" {i}", "en" if i % 2 else "fr") for i in range(40)]
    learned = language.fit(language.counts_of(documents(*rows), F.lit(True)))
    assert learned[0] == ["en", "fr"]
    asked = documents((1, en), (2, fr), (3, " ".join([en] * 8 + [fr] * 8)), (4, "12 34 !"))
    got = {r.doc_id: r for r in language.predict(asked.withColumn("score", F.lit(1)), *learned).collect()}
    assert (got[1].lang_pred, got[2].lang_pred, got[4].lang_pred) == ("en", "fr", "und") and got[4].score == 0
    assert set(got[3].mixture) == {"en", "fr"} and abs(got[3].mixture["en"] - 0.5) < 0.1 and set(got[1].mixture) == {"en"}
    out = language.identify(odd, F.lit(True)).collect()
    assert len(out) == 9 and all(r.lang_pred == "und" for r in out if not (r.text or "").strip())
    assert {r.lang_pred for r in language.identify(odd, F.lit(False)).collect()} == {"und"}


def test_exact_binomial_bound(spark):
    from math import comb
    rows = [(k, n) for n in (1, 7, 60, 400) for k in range(0, n + 1, max(1, n // 7))]
    got = spark.createDataFrame(rows, "k long, n long").withColumn("p", quality.at_most(F.col("k"), F.col("n"), 0.05)).collect()
    for r in got:
        true = 1.0 if r.k >= r.n * 0.05 else sum(comb(r.n, i) * 0.05**i * 0.95 ** (r.n - i) for i in range(r.k + 1))
        assert r.p == pytest.approx(true, rel=1e-9)


def test_quality_figures_and_thresholds(spark, documents, odd):
    text = "a b c a b c d\nx y\nx y\n\n  \nx y #!"
    r = quality.figures(documents((1, text))).first()
    assert (r.n_words, r.n_repeat_words, r.n_dup_lines, r.n_symbols, r.word_chars, r.n_shouts) == (14, 12, 1, 1, 15, 1)
    good = [(i, " ".join(f"w{i}q{j}" for j in range(60))) for i in range(1500)]
    bad = [(2000 + i, " ".join(f"w{i}q{j}##" for j in range(60))) for i in range(100)]
    labels = spark.createDataFrame([(d, int(d < 2000), 0) for d, _ in good + bad] + [(None, 1, 0), (9999, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality.verdicts(documents(*good, *bad), labels).collect()
    assert all(x.kept == (x.doc_id < 2000) for x in got)
    few = quality.verdicts(documents(*good[:90], *bad), labels).collect()  # too few good texts to certify a cutoff
    assert all(x.kept for x in few)
    out = quality.verdicts(odd.withColumn("kept", F.lit(1)), labels).collect()
    assert len(out) == 9 and not any(x.kept for x in out if not (x.n_words or 0) >= 50)


def test_personal_data(documents, odd):
    text = "mail a@b@c.de x@y, +1 (555) 123-4567 4111 1111-1111 1111 1.2.3.4.5.6.7.8 300.1.1.1 007.1.1.1 +12 Mr. John Smith call 555-123-4567"
    r = pii.personal_data(documents((1, text))).first()
    spans = [(s.kind, text[s.start:s.stop]) for s in r.base]
    # the phone pattern runs on to the last address and the card pattern from 123 to 1: both have too many digits, and there are no retries
    assert spans == [("email", "b@c.de"), ("ip", "1.2.3.4"), ("ip", "5.6.7.8"), ("ip", "007.1.1.1")]
    apart = "card 4111 1111-1111 1111, no card 4111 1111 1111 1112; phone +1 (555) 123-4567x +12"
    r2 = pii.personal_data(documents((1, apart))).first()
    assert [(s.kind, apart[s.start:s.stop]) for s in r2.base] == [("card", "4111 1111-1111 1111"), ("phone", "+1 (555) 123-4567")]
    assert {(s.kind, s.start) for s in r.base} <= {(s.kind, s.start) for s in r.spans}
    assert pii.personal_data(odd.withColumn("spans", F.lit(0))).count() == 9
    assert pii.personal_data(odd.limit(0)).count() == 0


def test_the_span_sample_keeps_the_weight_of_each_kind(spark, documents):
    def kind_of(i):
        return "email" if i % 10 else "name" if i % 20 else "ssn"

    rows = [(kind_of(i), [i % 3 - 1] * 5, [float(i % 40), 1.0], i % 7 + 1) for i in range(400)]
    distinct = spark.createDataFrame(rows, "kind string, votes array<int>, features array<double>, n long").groupBy("kind", "votes", "features").agg(F.sum("n").alias("n"))
    every, few = pii.sample(distinct), pii.sample(distinct.repartition(5), 40)
    assert (every["weight"] == every["n"]).all() and len(every) == distinct.count()
    assert few.groupby("kind").size().max() == 4 and set(few["kind"]) == {"email", "name", "ssn"}
    assert few.groupby("kind")["weight"].sum().to_dict() == pytest.approx(every.groupby("kind")["weight"].sum().to_dict())
    # repeated rows change weights only: a weighted fit is the fit of the repeated rows
    x, y, n = np.array(every["features"].tolist()) / 40, (every["n"] % 2).to_numpy(float), every["n"].to_numpy()
    assert pii.train(x, y, n.astype(float)) == pytest.approx(pii.train(np.repeat(x, n, 0), np.repeat(y, n)), abs=1e-9)


def test_spans_follow_one_rule_on_both_sides_of_the_bound(spark, documents, monkeypatch):
    texts = [f"write to a{i}@b{i % 9}.de or call 555-{100 + i % 800}-{1000 + i % 9000}, ssn 123-{10 + i % 80}-{2000 + i % 999}, invoice 555-{200 + i % 300}-{3000 + i}" for i in range(400)]
    docs = documents(*enumerate(texts))
    whole = {r["doc_id"]: r["spans"] for r in pii.personal_data(docs).collect()}
    monkeypatch.setattr(pii.sample, "__defaults__", (len(pii.KINDS) * 20,))
    bounded = {r["doc_id"]: r["spans"] for r in pii.personal_data(docs).collect()}
    same = sum(whole[i] == bounded[i] for i in whole)
    assert same >= 0.99 * len(texts)


def test_reliabilities_recover_labelers():
    rng = np.random.default_rng(4)
    y = rng.random(20_000) < 0.3
    votes = np.stack([np.where(rng.random(len(y)) < acc, np.where(y, 1, -1), np.where(y, -1, 1)) for acc in (0.95, 0.8, 0.6)], 1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    prior, table, _ = pii.reliabilities(patterns, counts.astype(float), 500)
    assert abs(prior - 0.3) < 0.05 and abs(table[1, 0, 2] - 0.95) < 0.05 and abs(table[0, 2, 0] - 0.6) < 0.05


def test_secrets(documents, odd):
    rows = [(i, f'see token = "{i:04x}9c0e8b7ae2ab9d45a086a540fd4a1" in the text') for i in range(30)]
    rows += [(100 + i, f"write to user{i}.name@mail{i}.example.com about the garden") for i in range(30)]
    got = secret_scan.secrets(documents(*rows)).collect()
    assert {r.doc_id for r in got if r.is_secret} == set(range(30)) and len(got) == 60
    assert secret_scan.secrets(odd.withColumn("candidate", F.lit(1))).count() == 0
    assert secret_scan.secrets(odd.limit(0)).count() == 0


def test_the_toxicity_fit_holds_the_words_of_one_window_at_a_time():
    texts = pd.Series([" ".join(f"word{(i * 31 + k) % 211}" for k in range(48)) for i in range(4000)])
    tracemalloc.start()
    coded, windows = toxicity.coded_windows(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(windows) == 4000 and len(coded[0]) == len(coded[2]) == 211
    assert peak < 4_000_000  # of the words of all windows it would be over 10 MB


def test_gates_of_all_words_are_made_in_place():
    coded = toxicity.encode([f"w{i}" for i in range(30_000)])
    network = toxicity.Network()
    tracemalloc.start()
    gates = network.all_gates(coded, 1000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.array_equal(gates[12_000:13_000], network.all_gates(toxicity.encode([f"w{i}" for i in range(12_000, 13_000)])))
    assert peak < 1.5 * gates.nbytes


@pytest.mark.skipif(not hasattr(ctypes.CDLL(None), "malloc_trim"), reason="C library without malloc_trim")
def test_a_finished_partition_gives_its_heap_back():
    resident = lambda: int(re.search(r"VmRSS:\s+(\d+)", Path("/proc/self/status").read_text())[1]) / 1024
    pins = []

    def run(batches):
        for _ in batches:
            held = [np.ones(2500) for _ in range(10_000)]  # 200 MB in small pieces, below one that stays
            pins.append(np.ones(2500))
            yield len(held)

    before = resident()
    assert list(common.released(run)(iter([1]))) == [10_000]
    assert resident() - before < 60
