"""N-gram Jaccard join of a table with itself by MinHash banding.

The n-grams of a text are its runs of N words (fewer words: the one run of all). Texts that are equal are one node. Each node has
bands * rows MinHash values; band and row counts are chosen so that a pair at the threshold shares a band with the
target recall. The shuffle on band hashes links every member of a bucket with its smallest node - never all pairs -, and the
connected components of these candidates are the groups inside which pairs are verified on the full n-gram sets.

A group is dealt into blocks bounded in texts and words; a task gets one pair of blocks, finds intersections through the n-grams that
texts share, and returns one row per text: how many links it has there and its smallest linked node. So the rows that move
grow with the texts, not with the pairs, and no link is lost. Linked nodes' components are the classes.

Defined results: null texts stand alone; empty texts, and those of white space only, are equal to their exact copies alone and have no n-grams;
repeated rows are copies; class ids are the smallest non-null id of the class; n_links counts different texts that link, so exact copies do not add
links; n_copies counts rows of the same text. Only the id and text columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.llm.common import released, row_key, settle, small_or_shuffled, words_of
from ledgerscope.llm.graph import components

N, THRESHOLD, RECALL, MOST_HASHES, SEED = 5, 0.8, 1 - 1e-6, 256, 23
BLOCK_TEXTS, BLOCK_WORDS = 400, 400_000


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most selective rows per band whose bands still reach the recall at the threshold within most hashes."""
    best = (most, 1)
    for rows in range(1, most + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)) if threshold < 1 else 1
        if bands * rows > most:
            break
        best = (bands, rows)
    return best


def ngrams(text: str | None, n: int = N) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-grams."""
    words = words_of(text or "")
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    if len(h) < n:
        return np.array([xxhash.xxh64_intdigest(h.tobytes())], np.uint64)
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k]
    return np.unique((out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9))


class Signer:
    def __init__(self, bands: int, rows: int, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.a = rng.integers(1, 1 << 63, bands * rows, dtype=np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)[:, None] * np.uint64(2)
        self.c = rng.integers(1, 1 << 63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def bands_of(self, grams: np.ndarray) -> np.ndarray:
        """One hash per band of a non-empty set."""
        low = np.full(len(self.a), np.uint64(0xFFFFFFFFFFFFFFFF))
        for lo in range(0, len(grams), 512):
            np.minimum(low, (grams[None, lo : lo + 512] * self.a + self.b).min(1), out=low)
        h = (low.reshape(self.bands, self.rows) * self.c).sum(1, dtype=np.uint64) + np.arange(self.bands, dtype=np.uint64)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return (h ^ (h >> np.uint64(32))).view(np.int64)


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def links_within(sets: list[np.ndarray], side: np.ndarray, threshold: float, across: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links of each set and its smallest linked position, over pairs of one side (all 0) or across sides 0 and 1, of which one can be empty."""
    m = len(sets)
    sizes = np.fromiter(map(len, sets), np.int64, m)
    _, gram = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(m), sizes)
    order = np.argsort(gram, kind="stable")
    texts, counts = owner[order], np.bincount(gram)
    first = np.cumsum(counts) - counts
    ends = np.cumsum(sizes)
    links, root = np.zeros(m, np.int64), np.arange(m)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x in np.flatnonzero(side == 0):
        g = gram[ends[x] - sizes[x] : ends[x]]
        both = np.bincount(texts[ragged(first[g], counts[g])], minlength=m)
        both[: x + 1] *= 0 if not across else 1
        if across:
            both[side == 0] = 0
        hit = np.flatnonzero(both >= threshold * (sizes[x] + sizes - both) - 1e-9)
        hit = hit[both[hit] > 0]
        links[x] += len(hit)
        links[hit] += 1
        for y in hit:
            a, b = find(x), find(y)
            root[max(a, b)] = min(a, b)
    return links, np.array([find(x) for x in range(m)])


def nodes_of(rows: DataFrame, signer: Signer) -> DataFrame:
    """One row per distinct text: node, text_hash, speaker (a row's key), least (smallest id), n_copies, n_words, bands."""

    @released
    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, None] = {}
        for b in batches:
            out = []
            for h, k, t in zip(b["text_hash"], b["_key"], b["_text"], strict=True):
                if h in seen:
                    continue
                if len(seen) > 100_000:
                    seen.clear()
                seen[h] = None
                grams = ngrams(t)
                out.append((h, k, len(grams), signer.bands_of(grams) if len(grams) else None))
            yield pd.DataFrame(out, columns=["text_hash", "speaker", "n_grams", "bands"])

    signed = rows.select("text_hash", "_key", "_text").mapInPandas(sign, "text_hash string, speaker string, n_grams bigint, bands array<bigint>")
    one = signed.groupBy("text_hash").agg(F.min(F.struct("speaker", "n_grams", "bands")).alias("s")).select("text_hash", "s.*")
    counts = rows.groupBy("text_hash").agg(F.min("_id").alias("least"), F.count(F.lit(1)).alias("n_copies"))
    return settle(one.join(counts, "text_hash").withColumn("node", F.monotonically_increasing_id()))


def candidates(nodes: DataFrame) -> DataFrame:
    """(node, root): the candidate group of every node that shares a band."""
    bands = nodes.filter("bands is not null").select("node", F.explode("bands").alias("band"))
    heads = bands.groupBy("band").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return components(bands.join(heads, "band").select("node", "head").filter("node != head"), "node", "head")


def jaccard_join(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per row of docs: _key, the id, class_id, n_links (different texts of similarity >= threshold) and n_copies."""
    signer = Signer(*bands_for(threshold, recall))
    rows = docs.select(F.col(key).alias("_id"), row_key(key, text).alias("_key"), F.md5(F.col(text)).alias("text_hash"), F.col(text).alias("_text"))
    filled = rows.filter("_text is not null")
    nodes = nodes_of(filled, signer)
    group = settle(candidates(nodes).join(nodes.select("node", "speaker", "n_grams"), "node"))
    deal = group.groupBy("root").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_TEXTS), F.ceil(F.sum("n_grams") / BLOCK_WORDS)).cast("int").alias("blocks")
    )
    dealt = settle(group.join(deal, "root").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int")).drop("n_grams"))
    speakers = small_or_shuffled(dealt.withColumnRenamed("speaker", "_key"))

    @released
    def to_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["grams"] = [ngrams(t).tobytes() for t in b.pop("_text")]
            yield b[["node", "root", "block", "blocks", "grams"]]

    spoken = filled.select("_key", "_text").join(speakers, "_key").select("node", "root", "block", "blocks", "_text")
    sets = spoken.mapInPandas(to_sets, "node bigint, root bigint, block int, blocks int, grams binary")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    paired = sets.withColumn("other", other).select(
        "root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "grams"
    )

    @released
    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, {}

        def done() -> pd.DataFrame:
            nodes = np.array(sorted(held), np.int64)
            side = np.array([int(held[n][0] != at[1]) for n in nodes])
            links, root = links_within([held[n][1] for n in nodes], side, threshold, at[1] != at[2])
            some = links > 0
            return pd.DataFrame({"node": nodes[some], "links": links[some], "linked": nodes[root[some]]})

        for b in batches:
            for root, i, j, block, node, grams in zip(b["root"], b["i"], b["j"], b["block"], b["node"], b["grams"], strict=True):
                if (root, i, j) != at:
                    if len(held) > 1:
                        yield done()
                    at, held = (root, i, j), {}
                held[node] = (block, np.frombuffer(grams, np.uint64))  # repeated rows are one
        if len(held) > 1:
            yield done()

    tasks = paired.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")
    found = settle(tasks.mapInPandas(verify, "node bigint, links bigint, linked bigint"))
    links = found.groupBy("node").agg(F.sum("links").alias("n_links"))
    classes = components(found, "node", "linked")
    known = nodes.select("node", "text_hash", "least", "n_copies").join(links, "node", "left").join(classes, "node", "left")
    known = settle(known.withColumn("class", F.coalesce("root", "node")).drop("root"))
    least = known.groupBy("class").agg(F.min("least").alias("class_id"))
    known = known.join(least, "class").select("text_hash", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies", F.col("class"))
    out = rows.select("_id", "_key", "text_hash").join(known, "text_hash", "left")
    alone = F.col("text_hash").isNull()
    return out.select(
        "_key", F.col("_id").alias(key), F.when(alone, F.col("_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"), F.col("class"),
    )


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each class: the one with the smallest id (then key); null texts stay."""
    joined = settle(jaccard_join(docs, key, text))
    keepers = joined.filter("class is not null").groupBy("class").agg(F.min(F.struct(F.col(key).isNull(), F.col(key), F.col("_key"))).alias("m"), F.count(F.lit(1)).alias("n"))
    keepers = settle(keepers.select(F.col("m._key").alias("_kept")))
    own = docs.withColumn("_own", row_key(key, text))
    kept = own.join(keepers, F.col("_own") == F.col("_kept"), "left_semi").unionByName(own.filter(F.col(text).isNull()))
    repeated = joined.filter("class is not null").groupBy("_key").count().filter("count > 1").limit(1).count()
    if repeated:  # the same row, several times: any one of them
        whole = kept.filter(F.col(text).isNotNull()).dropDuplicates(["_own"])
        kept = whole.unionByName(kept.filter(F.col(text).isNull()))
    return kept.drop("_own")
