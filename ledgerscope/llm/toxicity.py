"""Toxicity: a bidirectional gated recurrent network with attention pooling over word and character inputs, in numpy.

A text is lower-cased and cut into overlapping windows of WINDOW words, STRIDE apart, so that the last window ends at the
last word; every window is scored and the largest window probability is the score of the text. A word enters as an
embedding of its hash joined with the mean embedding of its hashed character 3- and 4-grams, so unseen forms of a known
stem are recognised.

Labels belong to whole texts, so training alternates: windows of clean texts are negative, of each toxic text the window
the network finds most suspicious is positive (in the first round all those of texts of up to SAMPLE_WINDOWS or, without such texts, so many of each), against clean windows drawn at random
and those the network mistakes. Toxic texts train on all their windows, as a sample of them may be clean; where those of the drawn texts come
to over SAMPLE_TOXIC_WINDOWS, the texts of fewest windows train (of the shortest, where even that one is too long, so many windows drawn by hash).

Defined results: a null or empty text, or one of white space only, scores 0. Repeated rows score alike. Null labels and
labels without a text teach nothing; with no usable label of one kind every text scores the share of toxic labels (0
without labels). Other columns pass through; an input column named like a result column gives way to the result.
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerscope.llm.common import WORD, released, settle, word_count, words_of

WINDOW, STRIDE = 48, 36
WORD_ROWS, GRAM_ROWS = 1 << 14, 1 << 15
WORD_DIM, GRAM_DIM, HIDDEN, ATTENTION = 8, 16, 8, 8
#: Bounds of the labelled sample the classifier is fitted on: texts of each label, and windows of one clean text, by hash.
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_WINDOWS = 1500, 3000, 8
#: Bound of the windows of all toxic texts together: as many as clean texts can have.
SAMPLE_TOXIC_WINDOWS = SAMPLE_CLEAN * SAMPLE_WINDOWS
EPOCHS, BATCH, RATE, SEED = 5, 128, 0.01, 11
#: Embeddings learn SPEED times as fast; of DROP of the words of a batch only the characters are seen.
SPEED, DROP = 1, 0.6
#: Small samples are gone through more often, until the network has been changed so many times.
LEAST_STEPS = 400
#: Share of the clean windows that each round takes at random, beside those with a probability above HARD.
CLEAN_SHARE, HARD = 0.15, 0.02
THRESHOLD = 0.3
CACHED_WORDS = 80_000
#: Windows that one pass of the network takes.
BLOCK = 1024


def window_starts(n: int) -> list[int]:
    """Starts of the overlapping windows that cover n words."""
    if n <= WINDOW:
        return [0] if n else []
    starts = list(range(0, n - WINDOW, STRIDE))
    return [*starts, n - WINDOW]


def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word rows, flat gram rows and the offset of each word's grams. A word has the 3- and 4-grams of ^word$."""
    rows = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.int64, len(words)) % WORD_ROWS
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    code = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = np.repeat(np.cumsum(lengths), lengths)
    at = np.arange(len(code))
    padded = np.concatenate([code, np.zeros(3, np.uint64)])
    three = (padded[:-3] * np.uint64(0x9E3779B1) + padded[1:-2] * np.uint64(0x85EBCA77) + padded[2:-1] * np.uint64(0xC2B2AE3D))
    four = three * np.uint64(0x27D4EB2F) + padded[3:] * np.uint64(0x165667B1)
    mix = lambda h: ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)) % np.uint64(GRAM_ROWS)
    grams = np.stack([mix(three), mix(four)], 1).astype(np.int64)
    valid = np.stack([at + 3 <= ends, at + 4 <= ends], 1)
    owner = np.repeat(np.repeat(np.arange(len(words)), lengths), 2).reshape(-1, 2)[valid]
    return rows, grams[valid], np.searchsorted(owner, np.arange(len(words)))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Parameters p and the passes over windows. Windows are (steps, n) arrays of rows into a table of distinct words."""

    def __init__(self, seed: int = SEED) -> None:
        rng, d, h = np.random.default_rng(seed), WORD_DIM + GRAM_DIM, HIDDEN
        f = lambda scale, *shape: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.p = {
            "words": f(0.01, WORD_ROWS, WORD_DIM), "grams": f(0.02, GRAM_ROWS, GRAM_DIM), "win": f(0.3, d, 6 * h), "bin": f(0, 6 * h),
            "uf": f(0.3, h, 3 * h), "ub": f(0.3, h, 3 * h), "wa": f(0.3, 2 * h, ATTENTION), "ba": f(0, ATTENTION),
            "va": f(0.3, ATTENTION), "wo": f(0.3, 2 * h), "bo": f(0, 1),
        }

    def inputs(self, coded: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        """One input vector per word."""
        rows, grams, offsets = coded
        counts = np.diff(np.append(offsets, len(grams))).astype(np.float32)
        means = np.add.reduceat(self.p["grams"][grams], offsets, axis=0) / counts[:, None]
        return np.concatenate([self.p["words"][rows], means], 1)

    def gates(self, x: np.ndarray) -> np.ndarray:
        return x @ self.p["win"] + self.p["bin"]

    def all_gates(self, coded: tuple[np.ndarray, np.ndarray, np.ndarray], at_once: int = 10_000) -> np.ndarray:
        """Gate inputs of all words, some at a time: the n-grams of a word take far more room than its gates."""
        rows, grams, offsets = coded
        ends = np.append(offsets, len(grams))
        out = np.empty((len(rows), 6 * HIDDEN), self.p["bin"].dtype)
        for lo in range(0, len(rows), at_once):
            hi = min(len(rows), lo + at_once)
            out[lo:hi] = self.gates(self.inputs((rows[lo:hi], grams[ends[lo] : ends[hi]], offsets[lo:hi] - ends[lo])))
        return out

    @staticmethod
    def _run(x: np.ndarray, u: np.ndarray, mask: np.ndarray, back: bool, keep: list | None) -> np.ndarray:
        steps, n, h = x.shape[0], x.shape[1], u.shape[0]
        state, out = np.zeros((n, h), x.dtype), np.empty((steps, n, h), x.dtype)
        for t in range(steps - 1, -1, -1) if back else range(steps):
            a = state @ u
            zr = 0.5 + 0.5 * np.tanh(0.5 * (x[t, :, : 2 * h] + a[:, : 2 * h]))
            z, r = zr[:, :h], zr[:, h:]
            new = np.tanh(x[t, :, 2 * h :] + r * a[:, 2 * h :])
            nxt = new + z * (state - new)
            nxt = state + mask[t][:, None] * (nxt - state)
            if keep is not None:
                keep.append((t, state, a[:, 2 * h :], z, r, new))
            out[t] = state = nxt
        return out

    def forward(self, g: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logit per window. g: gate inputs (steps, n, 6 h); mask: 1 where there is a word."""
        p, h = self.p, HIDDEN
        kf, kb = ([], []) if keep is not None else (None, None)
        states = np.concatenate([self._run(g[:, :, : 3 * h], p["uf"], mask, False, kf), self._run(g[:, :, 3 * h :], p["ub"], mask, True, kb)], 2)
        hidden = np.tanh(states @ p["wa"] + p["ba"])
        e = hidden @ p["va"] + (mask - 1) * 1e4
        e = np.exp(e - e.max(0))
        weight = e / e.sum(0)
        pooled = np.einsum("tn,tnh->nh", weight, states)
        if keep is not None:
            keep |= {"kf": kf, "kb": kb, "states": states, "hidden": hidden, "weight": weight, "pooled": pooled}
        return pooled @ p["wo"] + p["bo"]

    def backward(self, dlogit: np.ndarray, mask: np.ndarray, k: dict) -> tuple[dict, np.ndarray]:
        """Gradients of the dense parameters, and of the gate inputs."""
        p, h, g = self.p, HIDDEN, {}
        g["wo"], g["bo"] = k["pooled"].T @ dlogit, dlogit.sum(keepdims=True)
        dpool = dlogit[:, None] * p["wo"]
        dweight = np.einsum("nh,tnh->tn", dpool, k["states"])
        dstates = k["weight"][:, :, None] * dpool
        de = k["weight"] * (dweight - (k["weight"] * dweight).sum(0))
        g["va"] = np.einsum("tn,tna->a", de, k["hidden"])
        dhid = de[:, :, None] * p["va"] * (1 - k["hidden"] ** 2)
        g["wa"], g["ba"] = np.einsum("tnh,tna->ha", k["states"], dhid), dhid.sum((0, 1))
        dstates = dstates + dhid @ p["wa"].T
        dx = np.empty((*mask.shape, 6 * h), dstates.dtype)
        for name, kept, lo in (("uf", k["kf"], 0), ("ub", k["kb"], h)):
            u, du, carry = p[name], np.zeros_like(p[name]), np.zeros((mask.shape[1], h), dstates.dtype)
            for t, prev, q, z, r, new in reversed(kept):
                d = dstates[t, :, lo : lo + h] + carry
                m = mask[t][:, None]
                dn = d * m
                dnew = dn * (1 - z) * (1 - new**2)
                dq = dnew * r
                da = np.concatenate([dn * (prev - new) * z * (1 - z), dnew * q * r * (1 - r), dq], 1)
                carry = d * (1 - m) + dn * z + da @ u.T
                du += prev.T @ da
                da[:, 2 * h :] = dnew
                dx[t, :, 3 * lo : 3 * lo + 3 * h] = da
            g[name] = du
        return g, dx

    def train(self, coded: tuple, windows: list[np.ndarray], label: np.ndarray, text: np.ndarray) -> Network:
        """windows: rows into the coded words; label and text (its number): of each window."""
        rng, p = np.random.default_rng(SEED), self.p
        m1, m2, step = {k: 0.0 for k in p}, {k: 0.0 for k in p}, 0
        rows, grams, offsets = coded
        counts = np.diff(np.append(offsets, len(grams)))
        share = max(CLEAN_SHARE, min(1.0, 3000 / max(1, (label == 0).sum())))
        epoch = 0
        while epoch < EPOCHS or step < LEAST_STEPS:
            drawn = pd.Series(rng.random(len(label))).groupby(text).rank().to_numpy() <= SAMPLE_WINDOWS
            short = np.bincount(text)[text] <= SAMPLE_WINDOWS
            drawn = short if (short & (label == 1)).any() else drawn
            use = np.flatnonzero((label == 0) & (rng.random(len(label)) < share) | (label == 1) & drawn)
            if epoch:
                score = self.scores(coded, windows)
                best = pd.Series(score).groupby(text).transform("max").to_numpy()
                use = np.flatnonzero(np.where(label == 1, score == best, (score > HARD) | (rng.random(len(label)) < share)))
            epoch += 1
            rng.shuffle(use)
            for lo in range(0, len(use), BATCH):
                batch = use[lo : lo + BATCH]
                index, mask = stacked([windows[i] for i in batch])
                own, inverse = np.unique(index, return_inverse=True)
                inverse = inverse.reshape(index.shape)
                flat = ragged(offsets[own], counts[own])
                local = (rows[own], grams[flat], np.concatenate([[0], np.cumsum(counts[own])[:-1]]))
                x = self.inputs(local)
                gone = rng.random(len(x)) < DROP
                x[gone, :WORD_DIM] = 0
                keep: dict = {}
                logit = self.forward(self.gates(x)[inverse], mask, keep)
                y = label[batch].astype(np.float32)
                weight = np.where(y > 0, 2.0, 1.0).astype(np.float32)
                grad, dg = self.backward((sigmoid(logit) - y) * weight / len(batch), mask, keep)
                _, dgate = summed(inverse.ravel(), dg.reshape(-1, dg.shape[2]))
                grad["win"], grad["bin"] = x.T @ dgate, dgate.sum(0)
                dx = dgate @ p["win"].T
                dx[gone, :WORD_DIM] = 0
                step += 1
                for k, v in grad.items():
                    m1[k] = 0.9 * m1[k] + 0.1 * v
                    m2[k] = 0.99 * m2[k] + 0.01 * v * v
                    p[k] -= RATE * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-7)
                self._sparse("words", rows[own], dx[:, :WORD_DIM], m2)
                self._sparse("grams", grams[flat], np.repeat(dx[:, WORD_DIM:] / counts[own][:, None], counts[own], 0), m2)
        return self

    def _sparse(self, name: str, at: np.ndarray, grad: np.ndarray, seen: dict) -> None:
        """Adagrad on the rows that took part."""
        if isinstance(seen[name], float):
            seen[name] = np.full(len(self.p[name]), 1e-8, np.float32)
        own, total = summed(at, grad.astype(np.float32))
        seen[name][own] += (total**2).mean(1)
        self.p[name][own] -= SPEED * RATE * total / np.sqrt(seen[name][own])[:, None]

    def scores(self, coded: tuple, windows: list[np.ndarray]) -> np.ndarray:
        g, out = self.all_gates(coded), []
        for lo in range(0, len(windows), 1024):
            index, mask = stacked(windows[lo : lo + 1024])
            out.append(sigmoid(self.forward(g[index], mask)))
        return np.concatenate(out) if out else np.zeros(0)


def summed(at: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in order, and the sum of their values."""
    order = np.argsort(at, kind="stable")
    ordered = at[order]
    starts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    return ordered[starts], np.add.reduceat(values[order], starts, axis=0)


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run, one after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def stacked(windows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(steps, n) rows and mask."""
    longest = max(map(len, windows))
    index, mask = np.zeros((longest, len(windows)), np.int64), np.zeros((longest, len(windows)), np.float32)
    for i, w in enumerate(windows):
        index[: len(w), i], mask[: len(w), i] = w, 1
    return index, mask


class Scorer:
    """Scores texts with the gate inputs of words it has met kept, up to a bound."""

    def __init__(self, network: Network) -> None:
        self.network, self.known, self.size = network, {}, 0
        self.gates = np.empty((4096, 6 * HIDDEN), np.float32)

    def _look_up(self, words: list[str]) -> np.ndarray:
        """Rows of the words in self.gates; the kept words start anew when a text could overflow them."""
        fresh = list(set(words).difference(self.known))
        if fresh:
            if len(self.known) + len(fresh) > CACHED_WORDS:
                self.known, self.size, fresh = {}, 0, list(set(words))
            while self.size + len(fresh) > len(self.gates):
                self.gates = np.concatenate([self.gates, np.empty((max(len(self.gates), 4096), 6 * HIDDEN), np.float32)])
            for lo in range(0, len(fresh), 10_000):
                part = fresh[lo : lo + 10_000]
                self.gates[self.size : self.size + len(part)] = self.network.gates(self.network.inputs(encode(part)))
                self.known.update(zip(part, range(self.size, self.size + len(part)), strict=True))
                self.size += len(part)
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def _flush(self, blocks: list[np.ndarray], owners: list[int], best: np.ndarray) -> None:
        mask = np.ones((WINDOW, sum(len(b) for b in blocks)), np.float32)
        at = 0
        for b in blocks:
            mask[b.shape[1] :, at : at + len(b)] = 0
            at += len(b)
        index = np.concatenate([np.pad(b, ((0, 0), (0, WINDOW - b.shape[1]))) for b in blocks]).T
        logits = self.network.forward(self.gates[index], mask)
        np.maximum.at(best, np.repeat(owners, [len(b) for b in blocks]), sigmoid(logits))

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Largest window probability of each text, taken a bounded number of windows at a time."""
        best = np.zeros(len(texts))
        blocks: list[np.ndarray] = []
        owners: list[int] = []
        held = 0
        for i, text in enumerate(texts):
            words = words_of((text or "").lower())
            starts = np.array(window_starts(len(words)), np.int64)
            for lo in range(0, len(starts), BLOCK):
                part = starts[lo : lo + BLOCK]
                if self.size + WINDOW * len(part) > CACHED_WORDS and blocks:  # kept rows may move
                    self._flush(blocks, owners, best)
                    blocks, owners, held = [], [], 0
                rows = self._look_up(words[part[0] : part[-1] + WINDOW])
                blocks.append(rows[(part - part[0])[:, None] + np.arange(min(WINDOW, len(rows)))])
                owners.append(i)
                held += len(part)
                if held >= BLOCK:
                    self._flush(blocks, owners, best)
                    blocks, owners, held = [], [], 0
        if blocks:
            self._flush(blocks, owners, best)
        return best


def toxic_room(sizes: dict[tuple[str, int], int], most: int) -> dict[tuple[str, int], int]:
    """How many windows each toxic text trains on: all, fewest windows first, up to most in total; of one text at least some."""
    room, left = {}, most
    for k in sorted(sizes, key=lambda k: (sizes[k], k)):
        if sizes[k] > left:
            return room or {k: most}
        room[k] = sizes[k]
        left -= sizes[k]
    return room


def sample_windows(docs: DataFrame, labels: DataFrame, learn: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(turn, label, window): windows of the labelled sample. Bounded by the SAMPLE_ parameters whatever the input."""
    one = (
        labels.filter(learn & F.col("toxic").isin(0, 1) & F.col(key).isNotNull())
        .groupBy(key).agg(F.max("toxic").cast("int").alias("_label"))
        .withColumn("_turn", F.md5(F.col(key).cast("string")))
    )
    # labels whose text has no word would use up the quota
    usable = docs.filter(F.col(text).rlike(WORD)).select(key)
    one = settle(one.join(usable, key, "left_semi"))
    ids = one.filter("_label = 1").orderBy("_turn").limit(SAMPLE_TOXIC).unionByName(
        one.filter("_label = 0").orderBy("_turn").limit(SAMPLE_CLEAN)
    )

    @released
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for turn, label, h, t in zip(b["_turn"], b["_label"], b["_hash"], b["_text"], strict=True):
                words = words_of((t or "").lower())
                starts = window_starts(len(words))
                rng = np.random.default_rng(int(turn[:12], 16))
                most = room.get((turn, h), 0) if label else SAMPLE_WINDOWS
                if len(starts) > most:
                    starts = sorted(rng.choice(starts, most, replace=False).tolist())
                out += [(turn, label, " ".join(words[s : s + WINDOW])) for s in starts]
            yield pd.DataFrame(out, columns=["turn", "label", "window"])

    # ids: at most SAMPLE_TOXIC + SAMPLE_CLEAN rows
    texts = docs.select(key, F.col(text).alias("_text")).filter(F.col("_text").rlike(WORD)).join(F.broadcast(ids), key)
    # of an id with several texts the one with the smallest hash, whichever rows repeat
    texts = texts.groupBy("_turn", "_label").agg(F.min(F.struct(F.xxhash64("_text").alias("_hash"), "_text")).alias("t"))
    texts = settle(texts.select("_turn", "_label", "t._hash", "t._text"))
    long = texts.filter("_label = 1").select("_turn", "_hash", word_count("_text").alias("n")).collect()  # a row per id of the sample
    room = toxic_room({(r["_turn"], r["_hash"]): len(window_starts(r["n"])) for r in long}, SAMPLE_TOXIC_WINDOWS)
    return texts.mapInPandas(cut, "turn string, label int, window string")


def fit_in_task(sample: DataFrame) -> Network | float:
    """fit, in one task: the sample has a bound, and the driver keeps its memory. Only the parameters come back."""

    @released
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        rows = pd.concat(parts).sort_values(["turn", "window"], ignore_index=True) if parts else pd.DataFrame({"label": []})
        parts.clear()
        model = fit(rows)
        data = io.BytesIO()
        if isinstance(model, Network):
            np.savez(data, **model.p)
        yield pd.DataFrame({"share": [0.0 if data.tell() else float(model)], "parameters": [data.getvalue()]})

    row = sample.repartition(1).mapInPandas(run, "share double, parameters binary").first()
    if not row or not row["parameters"]:
        return row["share"] if row else 0.0
    network = Network()
    with np.load(io.BytesIO(bytes(row["parameters"]))) as stored:
        network.p = {k: stored[k] for k in stored.files}
    return network


def fit(sample: pd.DataFrame) -> Network | float:
    """The trained network, or the share of toxic windows where only one kind of label is there."""
    if sample.empty or sample["label"].nunique() < 2:
        return float(sample["label"].mean()) if len(sample) else 0.0
    coded, windows = coded_windows(sample["window"])
    return Network().train(coded, windows, sample["label"].to_numpy(), pd.factorize(sample["turn"])[0])


def coded_windows(texts: pd.Series) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], list[np.ndarray]]:
    """The coded distinct words, in order of appearance, and each window's rows. A window's words are held one window at a time."""
    vocabulary: dict[str, int] = {}
    windows = []
    for text in texts:
        words = text.split(" ")
        windows.append(np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in words), np.int32, len(words)))
    names = list(vocabulary)
    del vocabulary
    parts, shift = [], 0
    for lo in range(0, len(names), 10_000):
        rows, grams, offsets = encode(names[lo : lo + 10_000])
        parts.append((rows.astype(np.int32), grams.astype(np.int32), offsets + shift))
        shift += len(grams)
    return tuple(np.concatenate([p[k] for p in parts]) for k in range(3)), windows


def score_texts(docs: DataFrame, model: Network | float, text: str = "text") -> DataFrame:
    """docs with the columns score and predicted."""
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    @released
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(shared.value) if isinstance(shared.value, Network) else None
        for b in batches:
            if scorer is None:
                yield pd.Series([shared.value if t and words_of(t) else 0.0 for t in b], dtype="float64")
            else:
                yield pd.Series(scorer.score(b.tolist()), dtype="float64")

    scored = docs.select(*kept).withColumn("score", score(F.col(text)))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame, learn: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Train on labels where learn holds, then score every text."""
    return score_texts(docs, fit_in_task(sample_windows(docs, labels, learn, key, text)), text)
