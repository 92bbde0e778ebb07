"""Benchmark decontamination with a distributed positional inverted index.

`build_index` cuts the texts into segments of about SEGMENT_WORDS words. A segment row holds its texts, its terms and, per term,
the sorted token positions (postings, delta-coded). Texts of a segment stand at least GAP positions apart, so that a phrase never
crosses them; a text longer than a segment goes into several, which overlap by GAP words. The index is written once and
answers any test set. `occurrences` looks up test windows: the rarest term of a window in that segment gives
candidate starts, the other terms, next rarest first, thin them out at their offsets. `near` gives proximity matches: places
where all terms of a phrase stand within a span. The test set is taken in blocks of at most BLOCK_WORDS words, so what is sent to
the tasks has a bound whatever its size.

Defined results: null and empty texts have no words, no hits and are clean; items without words have no windows;
items with null ids are the item "null"; repeated rows each get a row; an empty test set leaves all clean. Only
the id and text columns are read, so other columns of either table cannot clash.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.llm.common import released, settle

WINDOW, SEGMENT_WORDS, BLOCK_WORDS = 13, 400_000, 2_000_000
#: Distance between texts of a segment and overlap of the parts of a long text; no phrase may be longer.
GAP = 64
TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_find = re.compile(TERM).findall
_lower = str.maketrans({c: c + 32 for c in range(65, 91)})


def terms_of(text: str | None) -> list[str]:
    """Words with A-Z (alone) in lower case."""
    if not text:
        return []
    return _find(text.lower() if text.isascii() else text.translate(_lower))


def pack(values: np.ndarray) -> bytes:
    """int32 values, byte plane by byte plane, compressed."""
    return zstandard.compress(values.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpack(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data, n * 4), np.uint8)
    return planes.reshape(4, -1).T.copy().view("<i4").ravel()


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per segment, in the shared folder."""
    kind = docs.schema[key].dataType.simpleString()
    schema = (
        f"segment string, ids array<string>, keys array<{kind}>, offsets array<bigint>, starts array<bigint>, "
        "lengths array<bigint>, terms array<string>, counts array<int>, postings binary"
    )

    @released
    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name = uuid.uuid4().hex
        ids, keys, offsets, starts, lengths, words, at = [], [], [], [], [], [], 0

        def segment() -> pd.DataFrame:
            gaps = np.repeat(np.array(starts, np.int64) - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
            codes, terms = pd.factorize(np.array(words, dtype=object)) if words else (np.zeros(0, np.int64), [])
            order = np.argsort(codes.astype(np.int32), kind="stable")
            position = order + gaps[order]
            counts = np.bincount(codes, minlength=len(terms))
            first = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64) if len(terms) else np.zeros(0, np.int64)
            delta = np.diff(position, prepend=0)
            delta[first] = position[first]
            return pd.DataFrame({
                "segment": [name], "ids": [ids], "keys": [keys], "offsets": [offsets], "starts": [starts], "lengths": [lengths],
                "terms": [list(terms)], "counts": [counts.astype(np.int32)], "postings": [pack(delta)],
            })

        for b in batches:
            for k, t in zip(b["_key"].astype(object).where(b["_key"].notna(), None), b["_text"], strict=True):
                own, lo, owner = terms_of(t), 0, None
                while True:
                    part = own[max(0, lo - GAP) : lo + SEGMENT_WORDS]
                    owner = owner or f"{name}:{len(ids)}"
                    ids.append(owner)
                    keys.append(k)
                    offsets.append(max(0, lo - GAP))
                    starts.append(at)
                    lengths.append(len(part))
                    words += part
                    at += len(part) + GAP
                    lo += SEGMENT_WORDS
                    if len(words) >= SEGMENT_WORDS or len(ids) >= 50_000:
                        yield segment()
                        name = uuid.uuid4().hex
                        ids, keys, offsets, starts, lengths, words, at = [], [], [], [], [], [], 0
                    if lo >= len(own):
                        break
        if ids:
            yield segment()

    return settle(docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInPandas(build, schema))


def rows_of(index: DataFrame) -> DataFrame:
    """(id, key, n_words) of each indexed row."""
    part = index.select(F.explode(F.arrays_zip("ids", "keys", "offsets", "lengths")).alias("r"))
    one = F.col("r.offsets") == 0
    whole = part.filter(one & (F.col("r.lengths") < SEGMENT_WORDS))
    short = whole.select(F.col("r.ids").alias("id"), F.col("r.keys").alias("key"), F.col("r.lengths").alias("n_words"))
    long = part.filter(~one | (F.col("r.lengths") >= SEGMENT_WORDS)).select(
        F.col("r.ids").alias("id"), F.col("r.keys").alias("key"), (F.col("r.offsets") + F.col("r.lengths")).alias("end")
    )
    return short.unionByName(long.groupBy("id").agg(F.first("key").alias("key"), F.max("end").alias("n_words")))


class Segment:
    """Postings of one segment row."""

    def __init__(self, row: dict) -> None:
        self.counts = np.asarray(row["counts"], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        self.delta = unpack(row["postings"], int(self.first[-1]))
        self.number = {t: i for i, t in enumerate(row["terms"])}
        self.starts, self.lengths = np.asarray(row["starts"], np.int64), np.asarray(row["lengths"], np.int64)
        self.offsets, self.ids = np.asarray(row["offsets"], np.int64), row["ids"]
        self.lists: dict[int, np.ndarray] = {}

    def postings(self, term: int) -> np.ndarray:
        if term not in self.lists:
            self.lists[term] = np.cumsum(self.delta[self.first[term] : self.first[term + 1]].astype(np.int64))
        return self.lists[term]

    def phrase(self, terms: np.ndarray) -> np.ndarray:
        """Positions where the terms stand one after another."""
        order = np.argsort(self.counts[terms], kind="stable")
        found = self.postings(terms[order[0]]) - order[0]
        for o in order[1:]:
            if not len(found):
                break
            have = self.postings(terms[o])
            at = np.searchsorted(have, found + o)
            found = found[have[np.minimum(at, len(have) - 1)] == found + o]
        return found

    def near(self, terms: np.ndarray, span: int) -> np.ndarray:
        """First positions of places where all terms stand within span words, in any order, inside one text."""
        order = np.argsort(self.counts[terms], kind="stable")
        rare = self.postings(terms[order[0]])
        text = np.searchsorted(self.starts, rare, side="right") - 1
        out = []
        for shift in range(span):
            lo = np.maximum(rare - shift, self.starts[text])
            good = np.ones(len(rare), bool)
            for o in order[1:]:
                have = self.postings(terms[o])
                at = np.searchsorted(have, lo)
                good &= (at < len(have)) & (have[np.minimum(at, len(have) - 1)] < np.minimum(lo + span, self.starts[text] + self.lengths[text]))
            out.append(lo[good])
        return np.unique(np.concatenate(out))

    def place(self, at: int) -> tuple[str, int]:
        """Row id and word number of a position."""
        t = int(np.searchsorted(self.starts, at, side="right")) - 1
        return self.ids[t], int(at - self.starts[t] + self.offsets[t])


def windows_of(items: list[tuple[str, str | None]], size: int = WINDOW) -> tuple[list[str], np.ndarray, list[list[str]]]:
    """Distinct terms, distinct windows as term numbers (padded with -1), and the items of each window."""
    number: dict[str, int] = {}
    seen: dict[tuple, set[str]] = {}
    for item, text in items:
        row = [number.setdefault(w, len(number)) for w in terms_of(text)]
        for i in range(max(1, len(row) - size + 1) if row else 0):
            seen.setdefault(tuple(row[i : i + size]), set()).add(item)
    out = np.full((len(seen), size), -1, np.int64)
    for i, w in enumerate(seen):
        out[i, : len(w)] = w
    return list(number), out, [sorted(s) for s in seen.values()]


def blocks_of(items: DataFrame, key: str, text: str) -> Iterator[list[tuple[str, str | None]]]:
    """The test set in blocks of about BLOCK_WORDS words."""
    one = items.select(F.coalesce(F.col(key).cast("string"), F.lit("null")).alias("k"), F.col(text).alias("t"))
    words = one.agg(F.sum(F.length("t"))).first()[0] or 0
    n = max(1, -(-words // (5 * BLOCK_WORDS)))
    for b in range(n):
        yield [(r[0], r[1]) for r in one.filter(F.pmod(F.xxhash64("k"), F.lit(n)) == b).collect()]


def occurrences(index: DataFrame, items: DataFrame, key: str = "item_id", text: str = "text", size: int = WINDOW, span: int | None = None) -> DataFrame:
    """(id, lo, hi, items): words lo to hi - 1 of a row match a window of these items; with span, by proximity."""
    if size > GAP or (span or 0) > GAP:
        raise ValueError(f"windows and spans are limited to {GAP} words")
    spark, out = index.sparkSession, None
    for block in blocks_of(items, key, text):
        shared = spark.sparkContext.broadcast(windows_of(block, size))

        @released
        def search(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            terms, windows, owners = shared.value
            for b in batches:
                for row in b.to_dict("records"):
                    s, found = Segment(row), []
                    local = np.array([*(s.number.get(t, -2) for t in terms), -1], np.int64)[windows]
                    for i in np.flatnonzero((local != -2).all(1)):
                        own = local[i][local[i] >= 0]
                        for at in s.phrase(own) if span is None else s.near(np.unique(own), span):
                            id_, lo = s.place(at)
                            found.append((id_, lo, lo + (len(own) if span is None else span), owners[i]))
                    yield pd.DataFrame(found, columns=["id", "lo", "hi", "items"])

        part = index.select("ids", "offsets", "starts", "lengths", "terms", "counts", "postings").mapInPandas(
            search, "id string, lo bigint, hi bigint, items array<string>"
        )
        out = part if out is None else out.unionByName(part)
    return out


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, n_hit, n_items, items, contaminated of each row: words inside any occurrence of a window are hit."""
    index = build_index(docs, key, text)
    found = occurrences(index, items)

    @F.pandas_udf("bigint")
    def covered(spans: pd.Series) -> pd.Series:
        def one(rows: list) -> int:
            total, end = 0, -1
            for lo, hi in sorted((r["lo"], r["hi"]) for r in rows):
                total += max(0, hi - max(lo, end))
                end = max(end, hi)
            return total
        return spans.map(one)

    # the distinct spans of one row, bounded by its words
    hits = found.groupBy("id").agg(
        F.collect_set(F.struct("lo", "hi")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")
    ).select("id", covered("spans").alias("n_hit"), "items")
    rows = rows_of(index).join(hits, "id", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    items_ = F.coalesce("items", F.array().cast("array<string>"))
    return rows.select(
        F.col("key").alias(key), "n_words", n_hit.alias("n_hit"), F.size(items_).cast("long").alias("n_items"), items_.alias("items"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )
