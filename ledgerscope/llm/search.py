"""Ranked lexical search over bit-sliced Bloom signatures of documents.

1. One pass over the texts gives every document its signature: a Bloom filter of its terms, and of (term, level) where the term occurs
   STEP ** level times or more. Documents of one partition and one size class (their number of entries, to the next power of 2) are put side by side in
   blocks: a block has WIDE bits per entry as rows and the documents as columns, one bit each, so a row is a bitmap over documents.
2. Document frequencies of the query terms, the number of documents and of terms are counted over all rows.
3. For every query term the rows of its hashes are met (bitwise and): documents that may have it, and by the levels how often at most. Presence
   is overestimated, never missed. Weighted with the term's weight and the document's exact length this gives each document an upper
   bound of its score, the sum over the slices.
4. The documents with the SEEDS highest bounds of each query are scored exactly; the query's least score to reach is the TOP-th best of them, or 1.
5. Every document whose bound reaches that is scored exactly from its text. Only documents that provably cannot enter the result are left out.

Queries are dealt into blocks of about QUERY_TERMS terms by a hash of their key; blocks meet the index inside Spark, nothing of either is
collected. Rescoring joins (document, query) pairs with term counts: it grows with the pairs that are not excluded. A very long document has a block
with few columns, and its width follows its terms, so that it is told apart as well as a short one.

Defined results: null texts and texts without a term are never found and do not count; queries without a term, or whose terms no document has, give no rows; equal query
rows are one query, rows of one item id with different texts are queries of their own; repeated documents each take a rank; null doc ids come last
among equal scores. Only id and text columns are read. Empty tables give no rows.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope.llm.common import bound_batches, dealt_join, released, row_key, settle

TOP, SEEDS = 10, 20
#: Signature: bits per entry, hashes per entry, levels of term counts and their step; columns and bytes of a block at most.
WIDE, HASHES, COUNT_LEVELS, STEP, COLUMNS, BLOCK_BYTES = 16, 3, 4, 2, 1024, 1 << 20
#: Terms of a block of queries (a query is held whole), and blocks that are broadcast at once.
QUERY_TERMS, BLOCKS_AT_ONCE = 10_000, 32
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Weight of a term: floor(SCALE * ln(...)).
SCALE = 1000

_KEEP = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """The terms in UTF-8: digits, letters (A-Z lower-cased) and all characters beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_KEEP).split()


LEVEL_STEP = 0x9E3779B97F4A7C15


def term_hashes(terms) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, terms), np.uint64)


def at_level(hashes: np.ndarray, level: int) -> np.ndarray:
    """Entries of terms that occur STEP ** level times or more."""
    return hashes + np.uint64(level * LEVEL_STEP % (1 << 64))


def rows_of(hashes: np.ndarray, width: int) -> np.ndarray:
    """(entries, HASHES) row numbers in a signature of width rows, a power of 2."""
    h = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    step = (h >> np.uint64(32)) | np.uint64(1)
    k = np.arange(HASHES, dtype=np.uint64)
    return ((h[:, None] + k * step[:, None]) & np.uint64(width - 1)).astype(np.int64)


def width_for(entries: int) -> int:
    return max(64, 1 << (WIDE * max(entries, 1) - 1).bit_length())


INDEX = "width int, columns int, keys array<string>, lengths array<bigint>, bits binary"


def index_of(rows: DataFrame) -> DataFrame:
    """The blocks of bit slices over rows (_key, _text)."""

    @released
    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: dict[int, list] = defaultdict(list)

        def done(width: int) -> tuple:
            docs = waiting.pop(width)
            n = -(-len(docs) // 8) * 8
            bits = np.zeros((width, n), bool)
            for column, (_, _, at) in enumerate(docs):
                bits[at, column] = True
            return width, n, [d[0] for d in docs], [d[1] for d in docs], np.packbits(bits, axis=1).tobytes()

        for b in batches:
            out = []
            for key, text in zip(b["_key"], b["_text"], strict=True):
                terms = terms_of(text)
                if not terms:
                    continue
                counts = Counter(terms)
                hashes, tf = term_hashes(counts), np.fromiter(counts.values(), np.int64)
                entries = np.concatenate([at_level(hashes[tf >= STEP**level], level) for level in range(COUNT_LEVELS)])
                width = width_for(len(entries))
                at = rows_of(entries, width).ravel()
                waiting[width].append((key, len(terms), at.astype(np.int32) if width < 1 << 31 else at))
                if len(waiting[width]) >= max(8, min(COLUMNS, 8 * BLOCK_BYTES // width)):
                    out.append(done(width))
            if out:
                yield pd.DataFrame(out, columns=["width", "columns", "keys", "lengths", "bits"])
        for width in list(waiting):
            yield pd.DataFrame([done(width)], columns=["width", "columns", "keys", "lengths", "bits"])

    return rows.mapInPandas(build, INDEX)


class Queries:
    """A block of queries as arrays: the terms with weights, and for each query the numbers of its terms and how often it has them."""

    def __init__(self, items: list[str], terms: list[str], weights: list[int], often: list[int], least: list[int]) -> None:
        numbers: dict[str, int] = {}
        at = np.array([numbers.setdefault(t, len(numbers)) for t in terms])
        self.weights = np.zeros(len(numbers))
        self.weights[at] = weights
        starts = [k for k in range(len(items)) if k == 0 or items[k] != items[k - 1]]
        self.items, self.least = [items[k] for k in starts], [least[k] for k in starts]
        self.of = np.split(at, starts[1:])
        self.often = np.split(np.asarray(often, np.float64), starts[1:])
        self.hashes = term_hashes(t.encode("utf-8", "surrogatepass") for t in numbers)

    def bounds(self, width: int, columns: int, lengths: np.ndarray, bits: bytes, n_docs: int, n_terms: int) -> np.ndarray:
        """(queries, documents) upper bounds of the scores."""
        slices = np.frombuffer(bits, np.uint8).reshape(width, columns // 8)
        at = [rows_of(at_level(self.hashes, level), width) for level in range(COUNT_LEVELS)]
        lengths = np.concatenate([lengths, np.ones(columns - len(lengths), np.int64)])
        m = np.array([25 + 75 * n * n_docs // n_terms for n in lengths.tolist()], np.float64)
        out = np.zeros((len(self.items), columns))
        step = max(8, (1 << 20) // max(len(self.weights), 1) // 8 * 8)  # documents at once
        for lo in range(0, columns, step):
            hi = min(lo + step, columns)
            part = np.zeros((len(self.weights), hi - lo))
            alive = None
            for level in range(COUNT_LEVELS):
                own = np.bitwise_and.reduce(slices[at[level], lo // 8 : -(-hi // 8)], axis=1)
                alive = own if alive is None else alive & own
                if not alive.any():
                    break
                tf = float(STEP ** (level + 1) - 1) if level + 1 < COUNT_LEVELS else lengths[lo:hi].astype(np.float64)
                share = np.broadcast_to(1e9 * tf / (1000 * tf + 8 * m[lo:hi]), part.shape)
                np.copyto(part, share, where=np.unpackbits(alive, axis=1)[:, : hi - lo].astype(bool))
            part *= self.weights[:, None]
            for k, (of, often) in enumerate(zip(self.of, self.often, strict=True)):
                out[k, lo:hi] = often @ part[of]
        # the exact score rounds down; rounding of this sum is far below one part in 10 ** 9
        return out * (1 + 1e-9)


def pairs_of(index: DataFrame, queries: DataFrame, n_blocks: int, n_docs: int, n_terms: int, best: int | None) -> DataFrame:
    """(_item, _key, bound): the best bounds of each query in every partition of the index, or all that reach the query's least score."""

    @released
    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parsed: dict[int, Queries] = {}
        top: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for block, items, terms, weights, often, least, width, columns, keys, lengths, bits in b.itertuples(index=False, name=None):
                if block not in parsed:
                    parsed = {block: Queries(list(items), list(terms), list(weights), list(often), list(least))}
                q = parsed[block]
                bounds = q.bounds(width, columns, np.asarray(lengths, np.int64), bits, n_docs, n_terms)[:, : len(keys)]
                keys = np.asarray(keys, object)
                found = []
                for item, low, row in zip(q.items, q.least, bounds, strict=True):
                    hit = np.flatnonzero(row >= low)
                    if best is None:
                        found += [(item, keys[d], row[d]) for d in hit]
                    elif len(hit):
                        names, values = keys[hit], row[hit]
                        if item in top:
                            names, values = np.concatenate([top[item][0], names]), np.concatenate([top[item][1], values])
                        first = np.argsort(-values, kind="stable")[:best]
                        top[item] = names[first], values[first]
                if found:
                    yield pd.DataFrame(found, columns=["_item", "_key", "bound"])
        for item, (names, values) in top.items():
            yield pd.DataFrame({"_item": item, "_key": names, "bound": values})

    out = None
    for lo in range(0, n_blocks, BLOCKS_AT_ONCE):
        hi = min(lo + BLOCKS_AT_ONCE, n_blocks)
        some = F.broadcast(queries.filter(F.col("block").between(lo, hi - 1)))
        met = index.withColumn("block", F.explode(F.sequence(F.lit(lo), F.lit(hi - 1)))).join(some, "block")
        own = met.select("block", "items", "terms", "weights", "often", "least", "width", "columns", "keys", "lengths", "bits")
        own = own.mapInPandas(meet, "_item string, _key string, bound double")
        out = own if out is None else out.unionByName(own)
    return out


def document_frequencies(rows: DataFrame) -> DataFrame:
    """(term, df) over rows (_text), counted in parts before the shuffle."""

    @released
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()

        def done() -> pd.DataFrame:
            out = pd.DataFrame({"term": [t.decode("utf-8", "surrogatepass") for t in held], "df": list(held.values())})
            held.clear()
            return out

        for b in batches:
            for text in b["_text"]:
                held.update(set(terms_of(text)))
                if len(held) > 200_000:
                    yield done()
        if held:
            yield done()

    return rows.select("_text").mapInPandas(count, "term string, df bigint").groupBy("term").agg(F.sum("df").alias("df"))


def exact_scores(rows: DataFrame, pairs: DataFrame, queries: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """(_item, _key, _id, copies, score) of pairs (_item, _key); queries has (_item, its)."""
    wanted = settle(pairs.select("_key").distinct())

    @released
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[str] = set()
        for b in batches:
            for key, id_, text in zip(b["_key"], b["_id"], b["_text"], strict=True):
                terms = terms_of(text)
                out = [(key, id_, len(terms), None, 1)]
                if key not in seen:
                    seen.add(key)
                    out += [(key, id_, len(terms), t.decode("utf-8", "surrogatepass"), n) for t, n in Counter(terms).items()]
                yield pd.DataFrame(out, columns=["_key", "_id", "n", "term", "tf"])
            if len(seen) > 100_000:
                seen.clear()

    kind = rows.schema["_id"].dataType
    spoken = dealt_join(rows, wanted, "_key").select("_key", F.col("_id").cast("string").alias("_id"), "_text")
    counts = settle(spoken.mapInPandas(count, "_key string, _id string, n bigint, term string, tf bigint"))
    docs = counts.filter("term is null").groupBy("_key").agg(F.min("_id").cast(kind).alias("_id"), F.min("n").alias("n"), F.sum("tf").alias("copies"))
    terms = counts.filter("term is not null").dropDuplicates(["_key", "term"]).select("_key", "term", "tf")
    asked = dealt_join(pairs.select("_item", "_key"), queries, "_item").select("_item", "_key", F.explode("its").alias("t"))
    asked = asked.select("_item", "_key", "t.term", "t.w", "t.c")
    met = asked.join(terms, ["_key", "term"]).join(docs, "_key")
    share = F.expr(f"(1000000000 * tf) div (1000 * tf + 8 * (25 + (75 * n * {n_docs}) div {n_terms}))")
    scores = met.groupBy("_item", "_key").agg(F.min("_id").alias("_id"), F.min("copies").alias("copies"), F.sum(F.col("w") * F.col("c") * share).alias("score"))
    return settle(scores.filter("score > 0"))


def best_of(scores: DataFrame, top: int, order: list) -> DataFrame:
    """The first rows of each query with rank; repeated documents count each."""
    each = scores.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.least(F.col("copies"), F.lit(top)).cast("int"))))
    return each.withColumn("rank", F.row_number().over(Window.partitionBy("_item").orderBy(*order))).filter(F.col("rank") <= top)


def ranked(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", top: int = TOP) -> DataFrame:
    """The best documents of each query row: item id, rank, doc id, score."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("_id"), row_key(key, text).alias("_key"), F.col(text).alias("_text")).filter("_text is not null")
    index = settle(index_of(rows.select("_key", "_text")))
    size = index.agg(F.sum(F.size("keys").cast("long")).alias("d"), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("t")).first()
    n_docs, n_terms = size["d"] or 0, size["t"] or 1
    weight = F.floor(SCALE * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    words = F.regexp_extract_all(F.translate(F.col("_text"), ascii_uppercase, ascii_lowercase), F.lit(TERM), F.lit(0))
    asked = benchmark.select(F.col(item).alias("_item_id"), row_key(item, item_text).alias("_item"), F.col(item_text).alias("_text")).filter("_text is not null")
    asked = asked.dropDuplicates(["_item"]).select("_item", "_item_id", F.explode(words).alias("term"))
    asked = settle(asked.groupBy("_item", "term").agg(F.first("_item_id").alias("_item_id"), F.count(F.lit(1)).alias("c")))
    weights = document_frequencies(rows).join(asked.select("term").distinct(), "term", "left_semi").select("term", weight.alias("w"))
    its = dealt_join(asked, settle(weights), "term").filter("w > 0")
    its = its.groupBy("_item").agg(F.first("_item_id").alias("_item_id"), F.array_sort(F.collect_list(F.struct("term", "w", "c"))).alias("its"))
    its = settle(its)
    n_blocks = max(1, -(-(its.agg(F.sum(F.size("its"))).first()[0] or 0) // QUERY_TERMS))

    def blocks(least: DataFrame) -> DataFrame:
        own = least.select(F.pmod(F.xxhash64("_item"), F.lit(n_blocks)).cast("int").alias("block"), "_item", "least", F.explode("its").alias("t"))
        held = own.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("_item", "t.term", "t.w", "t.c", "least"))).alias("e"))
        return settle(held.select("block", F.col("e._item").alias("items"), F.col("e.term").alias("terms"), F.col("e.w").alias("weights"), F.col("e.c").alias("often"), F.col("e.least").alias("least")))

    plain = its.select("_item", "its")
    seeds = pairs_of(index, blocks(plain.withColumn("least", F.lit(1).cast("long"))), n_blocks, n_docs, n_terms, SEEDS)
    seeds = seeds.withColumn("r", F.row_number().over(Window.partitionBy("_item").orderBy(F.desc("bound"), "_key"))).filter(f"r <= {SEEDS}")
    first = exact_scores(rows, settle(seeds.select("_item", "_key").distinct()), plain, n_docs, n_terms)
    least = best_of(first, top, [F.desc("score")]).filter(F.col("rank") == top).select("_item", F.col("score").alias("least"))
    least = plain.join(least, "_item", "left").select("_item", "its", F.coalesce("least", F.lit(1)).alias("least"))
    pairs = settle(pairs_of(index, blocks(least), n_blocks, n_docs, n_terms, None).select("_item", "_key").distinct())
    scores = exact_scores(rows, pairs, plain, n_docs, n_terms)
    out = best_of(scores, top, [F.desc("score"), F.col("_id").asc_nulls_last(), F.col("_key"), F.col("_copy")])
    out = out.join(its.select("_item", "_item_id"), "_item")
    return out.select(F.col("_item_id").alias(item), F.col("rank").cast("int").alias("rank"), F.col("_id").alias(key), "score")
