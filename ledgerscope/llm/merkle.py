"""Merkle manifest of a table: 16-ary hash trees per source as postorder append logs, one root over all, and inclusion proofs.

A row is a leaf: the sha256 (lowercase hex, also where it is hashed again) of its fields, each `-` if null, else its UTF-8 byte count, `:`
and the value. The leaves of a source ascend by id; while several nodes remain, every WIDTH consecutive ones become their hash.
What remains is the source's subroot; the subroots, ordered by source (null first, bytewise), become the root the same way.

The log of a tree has its nodes in the order in which they are complete: a node stands behind all that lies below it. So the place of any node
follows from subtree sizes alone (`position`), and siblings are read from the log by arithmetic, without pointers or levels stored beside them.

1. Leaves are dealt into ranges of (source, id) and written; counts per range give each its number in its source.
2. A builder takes SEGMENT = WIDTH ** LEVELS numbers of one source, aligned to that size, whatever the source's size: no source is one
   task's work. It writes its part of the log as one row. What is left of the parts is the next layer, a SEGMENT times smaller,
   built alike; the subroots are one more tree.
3. From the root down each part reads the runs on the way of each of its nodes and hands them to the part below; the lowest parts give
   every row its proof and fold a leaf back to the root.

Defined results: null ids come first, rows of one id and source are ordered by leaf; repeated rows are leaves of their own with equal hashes (each
proof is one of its place); empty and very long texts are hashed whole; an empty table gives no rows; other columns are not read. A source
of one row has its leaf as subroot, one source alone has its subroot as root, and a row with no siblings at all proves with the hash of nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import count

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope.llm.common import bound_batches, released, settle

WIDTH, LEVELS = 16, 3
SEGMENT = WIDTH**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def hashed(parts: list[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def height(n: int, width: int = WIDTH) -> int:
    """Levels above n leaves."""
    return next(h for h in count() if width**h >= n)


def nodes_at(level: int, n: int, width: int = WIDTH) -> int:
    return -(-n // width**level)


def position(level: int, node: int, n: int, width: int = WIDTH) -> int:
    """Place, from 0, of a level's node in the log of a tree of n leaves.

    Its last leaf is e; the log has e leaves before that one, one finished node for each full subtree of those, and then the way up from e.
    """
    e = min((node + 1) * width**level, n) - 1
    place, below = e + level, e // width
    while below:
        place += below
        below //= width
    return place


def log_of(leaves: list[str], levels: int, width: int = WIDTH) -> list[str]:
    """The leaves and the nodes of the levels above them, in completion order; the last run of a level may be short."""
    log: list[str] = []
    runs: list[list[str]] = [[] for _ in range(levels + 1)]

    def put(level: int, node: str) -> None:
        log.append(node)
        runs[level].append(node)

    for leaf in leaves:
        put(0, leaf)
        level = 0
        while level < levels and len(runs[level]) == width:
            node, runs[level] = hashed(runs[level]), []
            level += 1
            put(level, node)
    for level in range(levels):
        if runs[level]:
            node, runs[level] = hashed(runs[level]), []
            put(level + 1, node)
    return log


class Segment:
    """A builder's part of a log, read by position."""

    def __init__(self, log: str, n: int, levels: int) -> None:
        self.log, self.n, self.levels = log, n, levels
        self.runs: dict[tuple[int, int], str] = {}

    def run(self, level: int, parent: int) -> str:
        """The hashes below a node, next to each other."""
        if (level, parent) not in self.runs:
            last = min((parent + 1) * WIDTH, nodes_at(level, self.n))
            places = (position(level, c, self.n) for c in range(parent * WIDTH, last))
            self.runs[level, parent] = "".join(self.log[64 * p : 64 * p + 64] for p in places)
        return self.runs[level, parent]

    def way(self, leaf: int) -> tuple[list[int], list[str]]:
        """(place in its run, the run) of the leaf and of each node above it."""
        nodes = [leaf // WIDTH**level for level in range(self.levels)]
        return [x % WIDTH for x in nodes], [self.run(level, x // WIDTH) for level, x in enumerate(nodes)]


def without(run: str, slot: int) -> str:
    return run[: 64 * slot] + run[64 * slot + 64 :]


def proof_hash(slots: list[int], runs: list[str]) -> str:
    return hashed([without(r, s) for s, r in zip(slots, runs, strict=True)])


def folded(leaf: str, slots: list[int], runs: list[str]) -> str:
    """The root that the leaf and its siblings make."""
    for s, r in zip(slots, runs, strict=True):
        leaf = hashed([r[: 64 * s], leaf, r[64 * s + 64 :]])
    return leaf


def leaf_hash(columns: dict[str, Column]) -> Column:
    parts = []
    for c in columns.values():
        value = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with number (from 0, in the group by order) and n (the group's rows). One shuffle; a range of rows is a task, not a group."""
    spread = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(group, *order, "_tie")
    spread = settle(spread.sortWithinPartitions(group, *order, "_tie").drop("_tie").withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    parts = spread.groupBy(F.col(group).alias("_g"), part.alias("_p")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_g").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row per range and group
    offsets = parts.select("_g", "_p", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy("_g")).alias("n"))
    joined = spread.join(offsets, F.col(group).eqNullSafe(F.col("_g")) & (part == F.col("_p")))
    return joined.select(*rows.columns, (F.col("_before") + F.col("_at") - F.col("_first")).alias("number"), "n")


LAYER = "grp string, segment bigint, n bigint, levels int, ids array<string>, others array<string>, leaves int, log string, top string"


def layer_of(nodes: DataFrame) -> DataFrame:
    """The parts of the logs over nodes (grp, number, n, node, id, other), a row per builder; top is what its part comes to."""

    @released
    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, []

        def done() -> pd.DataFrame:
            grp, segment, n = at
            levels = min(LEVELS, height(n))
            log = log_of([h[0] for h in held], levels)
            row = (grp, segment, n, levels, [h[1] for h in held], [h[2] for h in held], len(held), "".join(log), log[-1])
            return pd.DataFrame([row], columns=["grp", "segment", "n", "levels", "ids", "others", "leaves", "log", "top"])

        for b in batches:
            for grp, segment, n, node, id_, other in zip(b["grp"], b["segment"], b["n"], b["node"], b["id"], b["other"], strict=True):
                if (grp, segment, n) != at:
                    if held:
                        yield done()
                    at, held = (grp, segment, n), []
                held.append((node, id_, other))
        if held:
            yield done()

    dealt = nodes.withColumn("segment", F.expr(f"number div {SEGMENT}")).repartition("grp", "segment").sortWithinPartitions("grp", "segment", "number")
    return settle(dealt.select("grp", "segment", "n", "node", "id", "other").mapInPandas(build, LAYER))


NOTHING = ["CAST(NULL AS string) AS id", "CAST(NULL AS string) AS other"]


def layers_of(nodes: DataFrame) -> list[DataFrame]:
    """Layer after layer until every group has come to one node."""
    layers = [layer_of(nodes)]
    while True:
        more = layers[-1].filter(f"n > {SEGMENT}")
        if more.isEmpty():
            return layers
        up = more.select("grp", F.col("segment").alias("number"), F.expr(f"(n + {SEGMENT - 1}) div {SEGMENT}").alias("n"), F.col("top").alias("node"), *map(F.expr, NOTHING))
        layers.append(layer_of(up))


def tops(layers: list[DataFrame]) -> DataFrame:
    """(grp, top): the one node each group has come to."""
    out = None
    for layer in layers:
        own = layer.filter(f"n <= {SEGMENT}").select("grp", "top")
        out = own if out is None else out.unionByName(own)
    return out


def log_reader(base: int):
    """Reads the nodes of parts whose own lowest level is `base` of the whole tree; above 0 that level is the top of the layer below."""

    @released
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for grp, segment, total, up, leaves, log in b.itertuples(index=False, name=None):
                found = []
                for level in range(0 if base == 0 else 1, up + 1):
                    for x in range(nodes_at(level, leaves)):
                        p, whole = position(level, x, leaves), segment * WIDTH ** (LEVELS - level) + x
                        found.append((grp, position(base + level, whole, total), base + level, whole, log[64 * p : 64 * p + 64]))
                yield pd.DataFrame(found, columns=["grp", "position", "level", "node", "hash"])

    return rows


def log_rows(layers: list[DataFrame]) -> DataFrame:
    """(grp, position, level, node, hash): the append logs of all groups; positions count from 0 without gaps."""
    out = None
    for k, layer in enumerate(layers):
        total = layers[0].groupBy(F.col("grp").alias("_g")).agg(F.sum("leaves").alias("total"))
        joined = layer.join(total, F.col("grp").eqNullSafe(F.col("_g"))).select("grp", "segment", "total", "levels", "leaves", "log")
        own = joined.mapInPandas(log_reader(k * LEVELS), "grp string, position bigint, level int, node bigint, hash string")
        out = own if out is None else out.unionByName(own)
    return out


WAYS = "grp string, segment bigint, slots array<int>, runs array<string>, subroot string, root string"


def ways_down(layer: DataFrame, above: DataFrame) -> DataFrame:
    """(grp, segment, slots, runs, subroot, root) for the parts below a layer: their way to the root through it."""

    @released
    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for grp, segment, levels, leaves, log, slots, runs, subroot, root in b.itertuples(index=False, name=None):
                part, found = Segment(log, leaves, levels), []
                for x in range(leaves):
                    s, r = part.way(x)
                    found.append((grp, segment * SEGMENT + x, [*s, *slots], [*r, *runs], subroot, root))
                    if len(found) == 256:
                        yield pd.DataFrame(found, columns=["grp", "segment", "slots", "runs", "subroot", "root"])
                        found = []
                if found:
                    yield pd.DataFrame(found, columns=["grp", "segment", "slots", "runs", "subroot", "root"])

    return with_ways(layer, above, "grp", "segment", "levels", "leaves", "log").mapInPandas(walk, WAYS)


def with_ways(layer: DataFrame, above: DataFrame, *columns: str) -> DataFrame:
    way = above.select(F.col("grp").alias("_g"), F.col("segment").alias("_s"), "slots", "runs", "subroot", "root")
    joined = layer.join(way, F.col("grp").eqNullSafe(F.col("_g")) & (F.col("segment") == F.col("_s")))
    return joined.select(*columns, "slots", "runs", "subroot", "root")


def manifest(docs: DataFrame, tampered: dict[str, Column] | None = None, touched: Column | None = None, fields: tuple[str, ...] = FIELDS,
             key: str = "doc_id", group: str = "source") -> DataFrame:
    """A row per row of docs: the key, leaf, subroot, root, proof_sha256 (of its siblings up to the root, left to right), folded_root, verified.

    folded_root starts from the row's leaf, or, where touched holds, from the leaf with the tampered columns, and takes the untampered siblings.
    """
    bound_batches(docs.sparkSession)
    whole = {f: F.col(f) for f in fields}
    other = F.when(F.lit(False) if touched is None else touched, leaf_hash(whole | (tampered or {})))
    leaves = settle(docs.select(F.col(group).cast("string").alias("grp"), F.col(key).alias("id"), leaf_hash(whole).alias("node"), other.alias("other")))
    numbers = numbered(leaves, "grp", ["id", "node"]).withColumn("id", F.col("id").cast("string"))
    layers = layers_of(numbers)

    subroots = settle(tops(layers))
    one = settle(numbered(subroots.select(F.lit("").alias("all"), F.col("grp").alias("source"), "top"), "all", ["source"]))
    over = layers_of(one.select(F.col("all").alias("grp"), "number", "n", F.col("top").alias("node"), *map(F.expr, NOTHING)))
    none = F.array().cast("array<int>"), F.array().cast("array<string>")
    ways = tops(over).select("grp", F.lit(0).cast("long").alias("segment"), none[0].alias("slots"), none[1].alias("runs"), F.lit("").alias("subroot"), F.col("top").alias("root"))
    for layer in reversed(over):
        ways = ways_down(layer, ways)
    of_source = one.select("number", F.col("source").alias("grp"), "top").join(ways.select(F.col("segment").alias("number"), "slots", "runs", "root"), "number")
    of_source = settle(of_source.select("grp", F.lit(0).cast("long").alias("segment"), "slots", "runs", F.col("top").alias("subroot"), "root"))

    ways = None
    for k in range(len(layers) - 1, -1, -1):
        ends = layers[k].filter(f"n <= {SEGMENT}").select(F.col("grp").alias("_e"))
        own = of_source.join(ends, F.col("grp").eqNullSafe(F.col("_e")), "left_semi")
        ways = own if ways is None else settle(ways_down(layers[k + 1], ways)).unionByName(own)

    @released
    def prove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for levels, leaves, log, ids, others, slots, runs, subroot, root in b.itertuples(index=False, name=None):
                part, found = Segment(log, leaves, levels), []
                tail = [without(r, s) for s, r in zip(slots, runs, strict=True)]
                for x in range(leaves):
                    p, (s, r) = position(0, x, leaves), part.way(x)
                    leaf = log[64 * p : 64 * p + 64]
                    proof = hashed([*(without(r_, s_) for s_, r_ in zip(s, r, strict=True)), *tail])
                    again = folded(others[x] or leaf, [*s, *slots], [*r, *runs])
                    found.append((ids[x], leaf, subroot, root, proof, again, again == root))
                yield pd.DataFrame(found, columns=["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    laid = with_ways(layers[0], ways, "levels", "leaves", "log", "ids", "others")
    proved = laid.mapInPandas(prove, "id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    return proved.withColumn("id", F.col("id").cast(docs.schema[key].dataType)).withColumnRenamed("id", key)
