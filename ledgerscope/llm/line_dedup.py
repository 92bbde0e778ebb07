"""Line dedup: removal of globally repeated multi-line chunks, and of all repeated runs of whole lines of LONG_WORDS words or more.

A text is cut at \\n. A rolling hash over the hashes of the last ROLL lines chooses where a chunk ends, so boundaries move with the lines;
chunks of several lines and LEAST_WORDS words or more are candidates. Chunks alone miss parts of passages, whose ends lie between boundaries:
therefore from every line that has words the shortest run of LONG_WORDS words that begins there, and the shortest that ends
there, are hashed: the borders of these runs depend on their own content alone. Any passage of whole lines with that many words is
covered by such runs inside it (each of its lines begins one, ends one, or lies in the first or the last), so all of a repeated passage is
found, whatever stands around it and however its words are dealt over its lines. Only lines without a word at its ends may stay.

1. One pass over the texts gives (hash, row, lines) per chunk and run; those of hashes that occur more than once are kept. Of equal
   runs the one in the smallest id, then the earliest, stays; the others go. They are never paired with each other.
2. In each text, runs to go that follow one another here and in the text that stays are joined to maximal runs.
3. These and the lines that stay for them are fetched, and a run goes only if its text equals theirs: the comparison of bytes.
4. The texts are put together without the removed lines.

Groups are grouped minima (map-side combined) and equi-joins that can be split, but rows of one run meet in
one task of a join unless adaptive execution splits it there.

Defined results: null texts stay null, empty ones empty; a text all of whose lines are removed becomes empty and its row
stays; repeated rows count as one text (each keeps the same lines), yet a run that repeats within one text is removed there, but for the
lines it shares with its first place; null ids come last. Other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.llm.common import released, row_key, settle, small_or_shuffled, words_of

ROLL, DIVISOR, LONG_WORDS, LEAST_WORDS = 2, 2, 50, 16
#: Lines of a chunk at most, so that a run without a boundary is cut too.
MOST_LINES = 16


def chunks_of(text: str) -> Iterator[tuple[int, int, bool]]:
    """(first line, line after the last, removable) of each content-defined chunk, in order, covering every line."""
    lines = text.split("\n")
    first = words = rolling = 0
    for i, line in enumerate(lines):
        n = len(words_of(line))
        if n >= LONG_WORDS:
            if i > first:
                yield first, i, i - first > 1 and words >= LEAST_WORDS
            yield i, i + 1, True
            first, words, rolling = i + 1, 0, 0
            continue
        words += n
        rolling = ((rolling << 32) | (xxhash.xxh32_intdigest(line.encode("utf-8", "surrogatepass")))) & ((1 << 32 * ROLL) - 1)
        ends = i - first + 1 >= 2 and xxhash.xxh32_intdigest(rolling.to_bytes(4 * ROLL, "little")) % DIVISOR == 0
        if ends or i - first + 1 == MOST_LINES:
            yield first, i + 1, i - first > 0 and words >= LEAST_WORDS
            first, words = i + 1, 0
    if first < len(lines):
        yield first, len(lines), len(lines) - first > 1 and words >= LEAST_WORDS


def runs_of(text: str) -> list[tuple[int, int]]:
    """(first line, line after the last) of the shortest runs of LONG_WORDS words that begin or end at each line with words."""
    counts = np.fromiter((len(words_of(line)) for line in text.split("\n")), np.int64)
    own = np.flatnonzero(counts)
    after = np.cumsum(counts[own])
    if not len(own) or after[-1] < LONG_WORDS:
        return []
    before = after - counts[own]
    ends = np.searchsorted(after, before + LONG_WORDS)
    begin = ends < len(own)
    starts = np.searchsorted(before, after - LONG_WORDS, side="right") - 1
    end = starts >= 0
    found = set(zip(own[begin].tolist(), (own[ends[begin]] + 1).tolist(), strict=True))
    return sorted(found.union(zip(own[starts[end]].tolist(), (own[end] + 1).tolist(), strict=True)))


def candidates_of(text: str) -> list[tuple[int, int]]:
    """The removable chunks and the shortest runs of LONG_WORDS words."""
    return sorted({(lo, hi) for lo, hi, removable in chunks_of(text) if removable}.union(runs_of(text)))


def hashed(rows: DataFrame) -> DataFrame:
    """(hash, _key, _id, lo, hi) of the chunks and runs of rows (_key, _id, _text)."""

    @released
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, id_, text in zip(b["_key"], b["_id"], b["_text"], strict=True):
                spans = candidates_of(text)
                if not spans:
                    continue
                lines = [line.encode("utf-8", "surrogatepass") for line in text.split("\n")]
                at = np.cumsum([0, *(len(line) + 1 for line in lines)]).tolist()
                whole = b"\n".join(lines)
                out += [(xxhash.xxh64_intdigest(whole[at[lo] : at[hi] - 1]) - (1 << 63), key, id_, lo, hi) for lo, hi in spans]
            yield pd.DataFrame(out, columns=["hash", "_key", "_id", "lo", "hi"])

    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInPandas(run, f"hash bigint, _key string, _id {kind}, lo int, hi int")


def joined_runs(key: str, spans: Iterator[tuple[int, int, str, int]]) -> list[tuple[int, int, str, int]]:
    """Maximal runs (lo, hi, source, first line there) that share no line, from those of one text in order of lo and hi."""
    out: list[tuple[int, int, str, int]] = []
    done = 0
    for lo, hi, source, there in spans:
        shift = there - lo
        lo = max(lo, done, hi + shift if source == key else 0)  # lines of the place that stays do not go
        if lo >= hi:
            continue
        if out and (out[-1][1], out[-1][2], out[-1][3] - out[-1][0]) == (lo, source, shift):
            out[-1] = (out[-1][0], hi, *out[-1][2:])
        else:
            out.append((lo, hi, source, lo + shift))
        done = hi
    return out


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(_key, numbers): first line and line after the last, in turn, of the runs to remove from each text."""
    rows = docs.filter(F.col(text).isNotNull()).select(row_key(key, text).alias("_key"), F.col(key).alias("_id"), F.col(text).alias("_text"))
    found = settle(hashed(rows))
    some = settle(found.groupBy("hash").count().filter("count > 1").select("hash"))
    again = settle(found.join(small_or_shuffled(some), "hash"))
    place = F.struct(F.col("_id").isNull().alias("last"), F.col("_id").alias("id"), F.col("_key").alias("k"), F.col("lo").alias("n"))
    kept = settle(again.groupBy("hash").agg(F.min(place).alias("kept")))
    # repeated rows: one of them speaks for all
    gone = again.join(small_or_shuffled(kept), "hash").filter((F.col("kept.k") != F.col("_key")) | (F.col("kept.n") != F.col("lo")))
    spans = F.array_sort(F.collect_set(F.struct("lo", "hi", F.col("kept.k").alias("source"), F.col("kept.n").alias("there"))))
    gone = gone.groupBy("_key").agg(spans.alias("s")).select("_key", "s.lo", "s.hi", "s.source", "s.there")

    @released
    def join_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, *parts in zip(b["_key"], b["lo"], b["hi"], b["source"], b["there"], strict=True):
                joined = joined_runs(k, zip(*parts, strict=True))
                if joined:
                    out.append((k, *map(list, zip(*joined, strict=True))))
            yield pd.DataFrame(out, columns=["_key", "lo", "hi", "source", "there"])

    runs = settle(gone.mapInPandas(join_runs, "_key string, lo array<int>, hi array<int>, source array<string>, there array<int>"))

    @released
    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, t, *parts in zip(b["_key"], b["_text"], b["lo"], b["hi"], b["source"], b["there"], strict=True):
                lines = t.split("\n")
                out += [(k, lo, hi, source, there, "\n".join(lines[lo:hi])) for lo, hi, source, there in zip(*parts, strict=True)]
            yield pd.DataFrame(out, columns=["_key", "lo", "hi", "source", "there", "run"])

    own = rows.select("_key", "_text").join(small_or_shuffled(runs), "_key")
    own = settle(own.mapInPandas(fetch, "_key string, lo int, hi int, source string, there int, run string"))
    wanted = own.select("source", "there", (F.col("hi") - F.col("lo")).alias("n")).distinct()
    wanted = settle(wanted.groupBy("source").agg(F.collect_list("there").alias("there"), F.collect_list("n").alias("n")))

    @released
    def fetch_sources(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, t, *parts in zip(b["source"], b["_text"], b["there"], b["n"], strict=True):
                lines = t.split("\n")
                out += [(k, there, "\n".join(lines[there : there + n])) for there, n in zip(*parts, strict=True)]
            yield pd.DataFrame(out, columns=["source", "there", "run"])

    stays = rows.select(F.col("_key").alias("source"), "_text").join(small_or_shuffled(wanted), "source")
    stays = settle(stays.mapInPandas(fetch_sources, "source string, there int, run string"))
    same = own.join(stays, ["source", "there", "run"], "left_semi")
    return settle(same.groupBy("_key").agg(F.flatten(F.collect_set(F.array("lo", "hi"))).alias("numbers")))


def line_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the repeated runs taken out of the text, and n_removed, the number of lines removed."""
    numbers = small_or_shuffled(repeats(docs, key, text)).withColumnsRenamed({"_key": "_gone_key", "numbers": "_gone"})
    kept = [c for c in docs.columns if c != "n_removed"]
    joined = docs.select(*kept).join(numbers, row_key(key, text) == F.col("_gone_key"), "left")

    @F.pandas_udf("text string, n_removed bigint")
    def strip(texts: pd.Series, gone: pd.Series) -> pd.DataFrame:
        out = []
        for t, g in zip(texts, gone, strict=True):
            if t is None or g is None or not len(g):
                out.append((t, 0))
                continue
            lines = t.split("\n")
            stays = np.ones(len(lines), bool)
            for lo, hi in zip(g[::2], g[1::2], strict=True):
                stays[lo:hi] = False
            rest = [lines[i] for i in np.flatnonzero(stays)]
            out.append(("\n".join(rest), len(lines) - len(rest)))
        return pd.DataFrame(out, columns=["text", "n_removed"])

    joined = joined.withColumn("_s", strip(F.col(text), F.col("_gone")))
    return joined.select(*[F.col("_s.text").alias(c) if c == text else F.col(c) for c in kept], F.col("_s.n_removed").alias("n_removed"))
