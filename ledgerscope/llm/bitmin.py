"""Near-duplicate components by b-bit MinHash over two-word shingles.

A text's set is its distinct N-word shingles, words being lower-cased in A-Z only. Each different set is one node. A node gets MinHash minima;
their bands give candidates, and of every minimum only the low BITS bits are kept, packed as BITS planes of one bit per minimum. Two
planes' differing bits are counted by bit counts; the share of equal places, corrected for chance collisions, estimates the similarity.
Pairs whose estimate is too low for a pair at the threshold (at the error MISS) are out; all others are held against each other on their full sets.
Signatures go first: the sets of nodes that no estimate allows are not moved.

Pairs of a bucket are never listed. Classes grow in rounds:

1. Stars, STAR_ROUNDS times: every node with a bucket of several classes is checked with one node of another class in such a bucket. Nodes that meet at the
   same head are dealt into slices of SLICE, each with a copy of the head, so that a group of any size is spread. Afterwards a group of near copies is one class.
2. The rest: buckets that still hold several classes tie those classes into groups. The nodes of a group are dealt into blocks of SLICE nodes, large classes
   into blocks of their own; every two blocks meet in one task, but for blocks of one class. A task joins what is linked and returns
   a row per joined node. So a group of copies beside a few strangers costs its own size, not its square, and no link is lost.

The recall of a pair at the threshold is bands_for's (1 - 1e-6), less MISS.

Defined results: texts without words and null texts have an empty set and are linked with nothing, not even with each other; a text of one word has that word as its set;
repeated rows share a set; component_id is the smallest non-null id of the component (null if it has none); kept is true where the id equals it, two nulls too. Only id and
text are read. An empty table gives no rows. Very long texts are one set like others.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.llm.common import bound_batches, dealt_join, released, settle, small_or_shuffled
from ledgerscope.llm.graph import components
from ledgerscope.llm.jaccard import Signer, bands_for

N, THRESHOLD, RECALL = 2, 0.8, 1 - 1e-6
BITS, MISS, SEED = 4, 1e-7, 41
STAR_ROUNDS, SLICE = 2, 500


def shingles(text: str | None, n: int = N) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    if len(h) < n:
        return np.array([xxhash.xxh64_intdigest(h.tobytes())], np.uint64) if len(h) else h
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k]
    return np.unique((out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9))


class BitSigner(Signer):
    """Bands over the minima, and the low bits of the minima in planes."""

    def __init__(self, bands: int, rows: int, bits: int = BITS, seed: int = SEED) -> None:
        super().__init__(bands, rows, seed)
        self.bits, self.size = bits, bands * rows

    def sign(self, grams: np.ndarray) -> tuple[np.ndarray, bytes]:
        low = np.full(self.size, np.uint64(0xFFFFFFFFFFFFFFFF))
        for lo in range(0, len(grams), 512):
            np.minimum(low, (grams[None, lo : lo + 512] * self.a + self.b).min(1), out=low)
        h = (low.reshape(self.bands, self.rows) * self.c).sum(1, dtype=np.uint64) + np.arange(self.bands, dtype=np.uint64)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        low = (low ^ (low >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        low = low ^ (low >> np.uint64(29))
        planes = [np.packbits(((low >> np.uint64(p)) & np.uint64(1)).astype(bool)) for p in range(self.bits)]
        return (h ^ (h >> np.uint64(32))).view(np.int64), np.concatenate(planes).tobytes()

    def unpacked(self, signatures: list[bytes]) -> np.ndarray:
        """(signatures, planes, bytes)"""
        return np.frombuffer(b"".join(signatures), np.uint8).reshape(len(signatures), self.bits, -1)

    def equal_places(self, one: np.ndarray, many: np.ndarray) -> np.ndarray:
        """In how many places all low bits of one signature equal those of each of many."""
        differ = np.bitwise_or.reduce(many ^ one, axis=1)
        return self.size - np.bitwise_count(differ).sum(1, dtype=np.int64)

    def similarity(self, equal: np.ndarray) -> np.ndarray:
        """Estimate of the similarity: equal places less those that are equal by chance, 2**-bits of the others."""
        chance = 2.0**-self.bits
        return np.clip((equal / self.size - chance) / (1 - chance), 0, 1)

    def least_estimate(self, threshold: float, miss: float = MISS) -> float:
        """The largest estimate that a pair at the threshold stays below with probability miss at most."""
        p = threshold + (1 - threshold) * 2.0**-self.bits
        below = 0.0
        for k in range(self.size + 1):
            log = math.lgamma(self.size + 1) - math.lgamma(k + 1) - math.lgamma(self.size - k + 1) + k * math.log(p) + (self.size - k) * math.log1p(-p)
            below += math.exp(log)
            if below > miss:
                return float(self.similarity(np.array([k]))[0])
        return 0.0


def linked(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    """Whether two sorted sets reach the threshold, in whole numbers of hundredths."""
    if min(len(a), len(b)) < threshold * max(len(a), len(b)) - 1e-9:
        return False
    long, short = (a, b) if len(a) >= len(b) else (b, a)
    at = np.minimum(np.searchsorted(long, short), len(long) - 1)
    both = int((long[at] == short).sum())
    return 100 * both >= round(100 * threshold) * (len(a) + len(b) - both)


def signed_sets(docs: DataFrame, signer: BitSigner) -> DataFrame:
    """(text_hash, set_hash, n_shingles, bands, signature) of every different text of docs (text_hash, _text)."""

    @released
    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[str] = set()
        for b in batches:
            out = []
            for h, t in zip(b["text_hash"], b["_text"], strict=True):
                if h in seen:
                    continue
                if len(seen) > 100_000:
                    seen.clear()
                seen.add(h)
                grams = shingles(t)
                if len(grams):
                    out.append((h, xxhash.xxh128_hexdigest(grams.tobytes()), len(grams), *signer.sign(grams)))
                else:
                    out.append((h, None, 0, None, None))
            yield pd.DataFrame(out, columns=["text_hash", "set_hash", "n_shingles", "bands", "signature"])

    return docs.mapInPandas(sign, "text_hash string, set_hash string, n_shingles bigint, bands array<bigint>, signature binary")


SET = "node bigint, signature binary, grams binary"


def sets_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, signature, grams) of the given nodes (text_hash, node, signature); each is read from one of its texts."""

    @released
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for b in batches:
            out = []
            for node, s, t in zip(b["node"], b["signature"], b["_text"], strict=True):
                if node in seen:
                    continue
                if len(seen) > 100_000:
                    seen.clear()
                seen.add(node)
                out.append((node, s, shingles(t).tobytes()))
            yield pd.DataFrame(out, columns=["node", "signature", "grams"])

    spoken = dealt_join(docs, nodes, "text_hash").select("node", "signature", "_text")
    return settle(spoken.mapInPandas(read, SET).dropDuplicates(["node"]))


def close_pairs(pairs: DataFrame, signatures: DataFrame, signer: BitSigner, threshold: float) -> DataFrame:
    """Those pairs (node, head) whose estimate allows the threshold, by the signatures (node, signature) alone: no set moves for the others."""
    both = dealt_join(pairs, signatures, "node")
    both = dealt_join(both, signatures.select(F.col("node").alias("head"), F.col("signature").alias("other")), "head")
    least = signer.least_estimate(threshold)

    @released
    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                equal = signer.equal_places(signer.unpacked(list(b["other"])), signer.unpacked(list(b["signature"])))
                yield b.loc[signer.similarity(equal) >= least, ["node", "head"]]

    return settle(both.select("node", "head", "signature", "other").mapInPandas(keep, "node bigint, head bigint"))


def check_stars(pairs: DataFrame, sets: DataFrame, signer: BitSigner, threshold: float) -> DataFrame:
    """(node, head) of those pairs (node, head) that are linked. Nodes of one head are dealt into slices, each with the head's set."""
    slices = pairs.groupBy("head").agg(F.ceil(F.count(F.lit(1)) / SLICE).cast("int").alias("slices"))
    mine = dealt_join(pairs, slices, "head").withColumn("slice", F.pmod(F.xxhash64("node"), "slices").cast("int"))
    mine = mine.join(sets, "node").select("head", "slice", F.lit(1).alias("turn"), "node", "signature", "grams")
    heads = slices.join(sets.withColumnRenamed("node", "head"), "head").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    heads = heads.select("head", "slice", F.lit(0).alias("turn"), F.col("head").alias("node"), "signature", "grams")
    least = signer.least_estimate(threshold)

    @released
    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = bits = grams = None
        for b in batches:
            planes = signer.unpacked(list(b["signature"]))
            out = []
            for k, (head, turn, node, raw) in enumerate(zip(b["head"], b["turn"], b["node"], b["grams"], strict=True)):
                if turn == 0:
                    at, bits, grams = head, planes[k].copy(), np.frombuffer(raw, np.uint64)
                    continue
                near = signer.similarity(signer.equal_places(bits, planes[k : k + 1]))[0] >= least
                if near and linked(grams, np.frombuffer(raw, np.uint64), threshold):
                    out.append((node, at))
            yield pd.DataFrame(out, columns=["node", "head"], dtype="int64")

    met = mine.unionByName(heads).repartition("head", "slice").sortWithinPartitions("head", "slice", "turn")
    return settle(met.mapInPandas(check, "node bigint, head bigint"))


def classes_of(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, class) for all nodes; links are rows (node, head)."""
    roots = components(links, "node", "head")
    return settle(nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("class")))


def open_buckets(buckets: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """(band, node, class, low, high): rows of buckets (band, node) with several classes; low and high are the buckets' end nodes by class.

    At first every node is its own class.
    """
    if classes is None:
        ends = buckets.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count(F.lit(1)).alias("_n"))
        ends = settle(ends.filter("low < high"))
        own = dealt_join(buckets, ends.drop("_n"), "band", counts=ends.select("band", "_n"))
        place = [F.struct(F.col(e).alias("class"), F.col(e).alias("node")).alias(e) for e in ("low", "high")]
        return settle(own.select("band", "node", F.col("node").alias("class"), *place))
    own = settle(buckets.join(classes, "node"))
    place = F.struct("class", "node")
    ends = own.groupBy("band").agg(F.min(place).alias("low"), F.max(place).alias("high"), F.count(F.lit(1)).alias("_n"))
    ends = settle(ends.filter("low.class < high.class"))
    return settle(dealt_join(own, ends.drop("_n"), "band", counts=ends.select("band", "_n")))


def check_rest(left: DataFrame, signatures: DataFrame, sets: DataFrame, signer: BitSigner, threshold: float) -> DataFrame:
    """(node, head): links that join what buckets of several classes hold; left has (band, node, class, low).

    Blocks meet twice: by signatures, which leaves the nodes with a partner of another class that the estimate allows, then by the sets of these.
    """
    near = left.select(F.col("class").alias("a"), F.col("low.class").alias("b")).filter("a != b").distinct()
    groups = components(near).withColumnsRenamed({"node": "class", "root": "grp"})
    nodes = dealt_join(left.select("node", "class").distinct(), groups, "class")
    sizes = nodes.groupBy("grp", "class").agg(F.count(F.lit(1)).alias("size"))
    # large classes fill blocks of their own, small ones share: a class is never cut between mixed blocks
    mixed = sizes.filter(f"size <= {SLICE}").groupBy("grp").agg(F.sum("size").alias("rest"))
    plan = sizes.join(mixed, "grp", "left").withColumn("parts", F.ceil(F.when(F.col("size") > SLICE, F.col("size")).otherwise(F.col("rest")) / SLICE).cast("int"))
    plan = plan.select("class", "grp", F.when(F.col("size") > SLICE, F.col("class")).alias("owner"), "parts")
    block = F.concat_ws("/", F.coalesce(F.col("owner"), F.lit(-1)), F.pmod(F.when(F.col("owner").isNull(), F.xxhash64("class")).otherwise(F.xxhash64("node")), "parts"))
    dealt = settle(dealt_join(nodes.drop("grp"), plan, "class").select("grp", "node", "class", "owner", block.alias("block")))
    blocks = settle(dealt.select("grp", "block", "owner").distinct())
    other = blocks.select(F.col("grp").alias("g"), F.col("block").alias("other"), F.col("owner").alias("o"))
    meet = blocks.join(other, (F.col("grp") == F.col("g")) & (F.col("block") <= F.col("other")) & F.coalesce(F.col("owner") != F.col("o"), F.lit(True)))
    meet = meet.select("grp", F.col("block").alias("i"), F.col("other").alias("j"))
    calls = meet.select("grp", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    rows = settle(dealt.join(calls, ["grp", "block"]).select("grp", "i", "j", "block", "node", "class"))
    least = signer.least_estimate(threshold)

    def close(held: list[tuple]) -> list[tuple[int]]:
        side, cls = np.array([h[0] for h in held]), np.array([h[2] for h in held])
        planes, found = signer.unpacked([h[3] for h in held]), np.zeros(len(held), bool)
        for x in range(len(held)):
            later = np.arange(x + 1, len(held))
            later = later[(cls[later] != cls[x]) & ((side[later] != side[x]) if side.any() else True)]
            later = later[signer.similarity(signer.equal_places(planes[x], planes[later])) >= least]
            found[later] = True
            found[x] |= len(later) > 0
        return [(held[k][1],) for k in np.flatnonzero(found)]

    def joined(held: list[tuple]) -> list[tuple[int, int]]:
        side = np.array([h[0] for h in held])
        planes, grams = signer.unpacked([h[3] for h in held]), [np.frombuffer(h[4], np.uint64) for h in held]
        root: dict[int, int] = {}

        def find(c: int) -> int:
            while root.setdefault(c, c) != c:
                c = root[c]
            return c

        out = []
        for x in range(len(held)):
            later = np.arange(x + 1, len(held))
            if side.any():
                later = later[side[later] != side[x]]
            estimate = signer.similarity(signer.equal_places(planes[x], planes[later]))
            for y in later[estimate >= least].tolist():
                a, b = find(held[x][2]), find(held[y][2])
                if a != b and linked(grams[x], grams[y], threshold):
                    root[max(a, b)] = min(a, b)
                    out.append((held[x][1], held[y][1]))
        return out

    def each_call(rows: DataFrame, run: Callable[[list[tuple]], list[tuple]], columns: list[str]) -> DataFrame:
        @released
        def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            at, held = None, []
            for b in batches:
                for grp, i, j, own, *of_node in b.itertuples(index=False, name=None):
                    if (grp, i, j) != at:
                        if len(held) > 1:
                            yield pd.DataFrame(run(held), columns=columns, dtype="int64")
                        at, held = (grp, i, j), []
                    held.append((int(own != i), *of_node))
            if len(held) > 1:
                yield pd.DataFrame(run(held), columns=columns, dtype="int64")

        tasks = rows.repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j", "node")
        return tasks.mapInPandas(check, ", ".join(f"{c} bigint" for c in columns))

    signed = dealt_join(rows, signatures, "node").select(*rows.columns, "signature")
    live = small_or_shuffled(settle(each_call(signed, close, ["node"]).distinct()))
    whole = rows.join(live, "node", "left_semi").join(sets.join(live, "node", "left_semi"), "node")
    return settle(each_call(whole.select(*rows.columns, "signature", "grams"), joined, ["node", "head"]))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """A row per row of docs: the id, n_shingles, component_id, kept."""
    bound_batches(docs.sparkSession)
    signer = BitSigner(*bands_for(threshold, recall))
    rows = docs.select(F.col(key).alias("_id"), F.md5(F.col(text)).alias("text_hash"), F.col(text).alias("_text"))
    filled = rows.filter("_text is not null").select("text_hash", "_text")
    signed = settle(signed_sets(filled, signer))
    texts = signed.groupBy("text_hash").agg(F.min("set_hash").alias("set_hash"), F.min("n_shingles").alias("n_shingles"))
    one = signed.filter("set_hash is not null").groupBy("set_hash").agg(F.min(F.struct("text_hash", "bands", "signature")).alias("s"))
    nodes = settle(one.select("set_hash", "s.*").withColumn("node", F.monotonically_increasing_id()))
    left = open_buckets(nodes.select("node", F.explode("bands").alias("band")))
    wanted = settle(left.select("node").distinct())
    signatures = settle(nodes.select("text_hash", "node", "signature").join(wanted, "node", "left_semi"))
    sets, signatures = sets_of(filled, signatures), signatures.select("node", "signature")
    links, classes = None, wanted.withColumn("class", F.col("node"))
    for turn in range(STAR_ROUNDS + 1):
        if left.isEmpty():
            break
        if turn < STAR_ROUNDS:
            head = F.when(F.col("class") == F.col("low.class"), F.col("high.node")).otherwise(F.col("low.node"))
            near = close_pairs(settle(left.groupBy("node").agg(F.min(head).alias("head"))), signatures, signer, threshold)
            met = near.select("node").unionByName(near.select(F.col("head").alias("node"))).distinct()
            found = check_stars(near, sets.join(small_or_shuffled(settle(met)), "node", "left_semi"), signer, threshold)
        else:
            found = check_rest(left, signatures, sets, signer, threshold)
        links = found if links is None else links.unionByName(found)
        classes = classes_of(wanted, links)
        if turn < STAR_ROUNDS:
            left = open_buckets(left.select("band", "node"), classes)
    by_text = texts.join(nodes.select("set_hash", "node").join(classes, "node", "left"), "set_hash", "left")
    by_text = settle(by_text.select("text_hash", "n_shingles", F.coalesce("class", "node").alias("class")))
    numbered = dealt_join(rows.select("_id", "text_hash"), by_text, "text_hash", "left")
    numbered = settle(numbered.select("_id", F.coalesce("n_shingles", F.lit(0)).alias("n_shingles"), "class"))
    least = numbered.filter("class is not null").groupBy("class").agg(F.min("_id").alias("_least"))
    out = dealt_join(numbered, least, "class", "left")
    component = F.when(F.col("class").isNull(), F.col("_id")).otherwise(F.col("_least"))
    return out.select(F.col("_id").alias(key), F.col("n_shingles").cast("long").alias("n_shingles"), component.alias("component_id"), F.col("_id").eqNullSafe(component).alias("kept"))
