"""Language identification by multilingual mixtures.

Learning counts hashed character n-grams (1 to 4 letters, with word edges) of every labelled text, per language. A word then has
one log-likelihood per language, the sum over its n-grams. For each text, expectation-maximisation estimates the
proportions of the languages; sets of 1, 2, ... languages, taken in the order of these proportions, are refitted and the set with the
largest log-likelihood minus PENALTY * log(words) / 2 per language is kept. The prediction is the largest proportion of that set.

Defined results: lang_pred is `und`, score 0 and the mixture empty for a null text, one without a letter, and where no language
was learned. Equal proportions go to the smaller name. Repeated rows are predicted alike. More than MAX_LANGUAGES
label values raise an error. Other columns pass through; an input column named like a result gives way.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS, SMOOTH = 1 << 16, 0.5
FIRST_ROUNDS, ROUNDS, PENALTY, SHARPNESS = 5, 12, 4.0, 0.25
KEPT_WORDS = 300_000
MAX_LANGUAGES = 256
#: Characters of the texts worked on at once.
BLOCK_CHARS = 1 << 20
_words = re.compile(r"[^\W\d_]+").findall
_MULTIPLY = np.uint32(0x9E3779B1)


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bins of the n-grams that end at each character of ' word ' (4 a character), and the first character of each word."""
    code = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    back = np.concatenate([np.full(3, 32, np.uint32), code])
    n, h, out = len(code), np.zeros(len(code), np.uint32), np.empty((len(code), 4), np.int64)
    for k in range(4):
        h = (h ^ back[3 - k : 3 - k + n]) * _MULTIPLY
        h ^= h >> np.uint32(15)
        out[:, k] = (h + np.uint32(k * 0x85EBCA6B & 0xFFFFFFFF)) * _MULTIPLY >> np.uint32(16)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    return out[1:], np.concatenate([[0], np.cumsum(lengths)[:-1]])


def blocks(texts: list[list[str]]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about BLOCK_CHARS characters; a longer text is a range of its own."""
    lo = size = 0
    for i, words in enumerate(texts):
        size += sum(map(len, words))
        if size > BLOCK_CHARS:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def pieces(words: list[str]) -> Iterator[list[str]]:
    for lo in range(0, len(words), 100_000):
        yield words[lo : lo + 100_000]


def counts_of(docs: DataFrame, learn: Column, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, counts): n-gram counts of all texts that teach, summed per task and then per language."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for name, part in b.groupby("_lang"):
                own = total.setdefault(name, np.zeros(BINS))
                words: list[str] = []
                for t in part["_text"]:
                    words += _words(t.lower())
                    if len(words) > 100_000:
                        for p in pieces(words):
                            own += np.bincount(grams(p)[0].ravel(), minlength=BINS)
                        words = []
                if words:
                    own += np.bincount(grams(words)[0].ravel(), minlength=BINS)
            if len(total) > MAX_LANGUAGES:
                raise ValueError(f"more than {MAX_LANGUAGES} values of {lang}")
        if total:
            yield pd.DataFrame({"lang": list(total), "counts": list(total.values())})

    rows = docs.filter(learn & F.col(lang).isNotNull() & F.col(text).isNotNull())
    parts = rows.select(F.col(lang).alias("_lang"), F.col(text).alias("_text")).mapInPandas(count, "lang string, counts array<double>")
    cells = parts.select("lang", F.posexplode("counts").alias("bin", "n")).filter("n > 0")
    return cells.groupBy("lang", "bin").agg(F.sum("n").alias("n"))


def fit(counts: DataFrame) -> tuple[list[str], np.ndarray]:
    """Names in order, and the (BINS, languages) log-likelihoods of n-grams; at most MAX_LANGUAGES columns."""
    names = sorted(r[0] for r in counts.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    table = np.full((BINS, len(names)), SMOOTH)
    column = {n: i for i, n in enumerate(names)}
    got = counts.toPandas()
    table[got["bin"].to_numpy(np.int64), got["lang"].map(column).to_numpy(np.int64)] += got["n"].to_numpy()
    return names, np.log(table / table.sum(0)).astype(np.float32)


def mixture(like: np.ndarray, starts: np.ndarray, counts: np.ndarray, allowed: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (languages, texts) and log-likelihood of each text. like: (languages, words), the largest of a word 1; allowed: as proportions."""
    share = (allowed / allowed.sum(0)).astype(like.dtype)
    for _ in range(rounds):
        resp = like * np.repeat(share, counts, axis=1)
        resp /= resp.sum(0) + np.float32(1e-30)
        share = np.add.reduceat(resp, starts, axis=1) / counts.astype(np.float32)
    fit = (like * np.repeat(share, counts, axis=1)).sum(0)
    return share, np.add.reduceat(np.log(fit + np.float32(1e-30)).astype(np.float64), starts)


class Reader:
    """Log-likelihood rows of words, kept for words met before, up to a bound."""

    def __init__(self, names: list[str], table: np.ndarray) -> None:
        self.names, self.table, self.known, self.size = names, table, {}, 0
        self.rows = np.empty((8192, len(names)), np.float32)

    def look_up(self, words: list[str]) -> np.ndarray:
        """Log-likelihoods of at most 100,000 words."""
        fresh = list(set(words).difference(self.known))
        if fresh:
            if len(self.known) + len(fresh) > KEPT_WORDS:
                self.known, self.size, fresh = {}, 0, list(set(words))
            while self.size + len(fresh) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
            bins, first = grams(fresh)
            scores = sum(np.take(self.table, bins[:, k], axis=0) for k in range(bins.shape[1]))
            rows = np.add.reduceat(scores, first, axis=0) * SHARPNESS
            self.rows[self.size : self.size + len(fresh)] = rows - rows.max(1, keepdims=True)
            self.known.update(zip(fresh, range(self.size, self.size + len(fresh)), strict=True))
            self.size += len(fresh)
        return self.rows[np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))]

    def infer(self, texts: list[list[str]]) -> tuple[list[str], np.ndarray, list[dict]]:
        """Prediction, score and mixture of texts given as words; all have a word."""
        like = np.exp(np.concatenate([self.look_up(part) for part in pieces([w for words in texts for w in words])]).T.copy())
        counts = np.fromiter(map(len, texts), np.int64, len(texts))
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        full, _ = mixture(like, starts, counts, np.ones((len(self.names), len(texts))), FIRST_ROUNDS)
        rank = np.argsort(np.argsort(-full, axis=0, kind="stable"), axis=0, kind="stable")
        order = np.argsort(-full, axis=0, kind="stable")
        best_share, best = np.zeros_like(full), np.full(len(texts), -np.inf)
        alive, most = np.arange(len(texts)), None
        for k in range(1, len(self.names) + 1):
            # no mixture of the first k languages is likelier than each word in its likeliest one: sets that cannot win are left out unfitted
            flat = np.arange(counts[alive].sum()) + np.repeat(starts[alive] - np.cumsum(counts[alive]) + counts[alive], counts[alive])
            added = like[np.repeat(order[k - 1, alive], counts[alive]), flat]
            most = added if most is None else np.maximum(most, added)
            begin = np.concatenate([[0], np.cumsum(counts[alive])[:-1]])
            bound = np.add.reduceat(np.log(most + np.float32(1e-30)).astype(np.float64), begin) + 1e-6 * counts[alive]
            hope = bound - PENALTY * k * np.log(counts[alive] + 1) / 2 > best[alive]
            most, alive = most[np.repeat(hope, counts[alive])], alive[hope]
            if not len(alive):
                break
            begin = np.concatenate([[0], np.cumsum(counts[alive])[:-1]])
            flat = np.arange(counts[alive].sum()) + np.repeat(starts[alive] - begin, counts[alive])
            own = like if len(alive) == len(texts) else like[:, flat]
            share, ll = mixture(own, begin, counts[alive], rank[:, alive] < k, 0 if k == 1 else ROUNDS)
            value = ll - PENALTY * k * np.log(counts[alive] + 1) / 2
            better = value > best[alive]
            best[alive[better]], best_share[:, alive[better]] = value[better], share[:, better]
            most, alive = most[np.repeat(better, counts[alive])], alive[better]
            if not len(alive):
                break
        top = best_share.argmax(0)
        mixed = [{self.names[j]: float(s[j]) for j in np.flatnonzero(s > 0)} for s in best_share.T]
        return [self.names[j] for j in top], np.clip(best_share[top, np.arange(len(top))], 0, 1), mixed


def predict(docs: DataFrame, names: list[str], table: np.ndarray, text: str = "text") -> DataFrame:
    """docs with lang_pred, score and mixture (language to proportion)."""
    shared = docs.sparkSession.sparkContext.broadcast((names, table))

    @F.pandas_udf("lang_pred string, score double, mixture map<string,double>")
    def one(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names, table = shared.value
        reader = Reader(names, table)
        for b in batches:
            words = [_words((t or "").lower()) for t in b]
            pred, score, mixed = ["und"] * len(b), np.zeros(len(b)), [{} for _ in range(len(b))]
            have = [i for i, w in enumerate(words) if names and any(c.isalpha() for x in w for c in x)]
            for lo, hi in blocks([words[i] for i in have]):
                part = have[lo:hi]
                p, s, m = reader.infer([words[i] for i in part])
                score[part] = s
                for i, x, y in zip(part, p, m, strict=True):
                    pred[i], mixed[i] = x, y
            yield pd.DataFrame({"lang_pred": pred, "score": score, "mixture": mixed})

    result = ("lang_pred", "score", "mixture")
    kept = [c for c in docs.columns if c not in result]
    out = docs.select(*kept).withColumn("_p", one(F.col(text)))
    return out.select(*kept, *[F.col(f"_p.{c}").alias(c) for c in result])


def identify(docs: DataFrame, learn: Column, lang: str = "lang", text: str = "text") -> DataFrame:
    """Learn from the rows where learn holds, then predict every text."""
    return predict(docs, *fit(counts_of(docs, learn, lang, text)), text)
