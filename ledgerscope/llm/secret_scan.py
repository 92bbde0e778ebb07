"""Secret scan: candidate strings judged by a random forest, in DataFrame and Spark ML functions only.

A candidate is a run of at least LEAST key characters with a letter and a digit. One pass over the texts finds them with the words
around; another counts all words of the corpus, from which come the probabilities of character transitions and the dictionary. Each
candidate has: length, shares of digits, capitals and distinct characters, changes of character class, mean log-probability of its
character transitions, the share of it that dictionary words cover, signs of a path, address or domain, and whether neighbouring words
speak of keys, digests or assignments. A random forest fitted on labelled findings removes the false positives.

Findings are labelled by the caller, or by `known`: published key formats and assignments to secret names are true, addresses, paths, times,
versions and digests named as such are false, all else unlabelled. The forest never sees these formats as such. At most
SAMPLE_FINDINGS labelled findings train it, drawn by hash.

Defined results: null and empty texts have no candidates; repeated rows have equal findings; with labelled findings of one kind only
every candidate scores the share of true ones (0.5 without any). Only the id and text columns are read.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerscope.llm.common import SPACE, settle, small_or_shuffled

LEAST, SAMPLE_FINDINGS, TREES, DEPTH, SEED, ACCEPT = 12, 20_000, 24, 6, 5, 0.5
#: Occurrences from which on a word is in the dictionary.
DICTIONARY = 5
_RUN = r"[A-Za-z0-9+/_.@~-]"
_ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789"
KEY_WORDS = "password|passwd|pwd|secret|token|api_?key|apikey|access_?key|private_?key|auth|bearer|credential"
DIGEST_WORDS = "commit|sha1|sha256|md5|checksum|digest|etag|revision|version|isbn|uuid"
FORMATS = r"^(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9_-]{20,}|AIza[A-Za-z0-9_-]{35})$"
FALSE_FORMATS = (
    r"^([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+|(https?:)?//.*|([A-Za-z0-9_.-]*/)+[A-Za-z0-9_.-]+\.[a-z]{1,5}|[0-9T:.Z+-]+"
    r"|v?[0-9]+(\.[0-9]+)+.*|[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}|[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.(com|net|org)(:[0-9]+)?)$"
)
FEATURES = (
    "length", "digits", "capitals", "distinct", "changes", "transition", "coverage", "path", "at", "dots", "key_near", "digest_near", "assigned",
)


def words_of(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), f"{SPACE}+")


def candidates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, word_number, candidate, before, after): word_number counts the words of the text from 0."""
    w = F.filter(words_of(text), lambda x: x != "")
    at = lambda ws: F.filter(F.sequence(F.lit(0), F.size(ws) - 1), lambda i: (
        (F.length(F.get(ws, i)) >= LEAST) & F.get(ws, i).rlike(_RUN + "{%d,}" % LEAST) & F.get(ws, i).rlike("[0-9]") & F.get(ws, i).rlike("[A-Za-z]")))
    with_words = lambda ws: F.transform(at(ws), lambda i: F.struct(
        i.alias("word_number"), F.get(ws, i).alias("word"), F.concat_ws(" ", F.get(ws, i - 3), F.get(ws, i - 2), F.get(ws, i - 1)).alias("left"),
        F.coalesce(F.get(ws, i + 1), F.lit("")).alias("after")))
    some = F.transform(F.array(w), lambda ws: F.when(F.size(ws) > 0, with_words(ws)))
    rows = docs.select(F.col(key), F.explode(F.get(some, F.lit(0))).alias("c")).select(key, "c.*")
    runs = F.filter(F.regexp_extract_all("word", F.lit(f"({_RUN}{{{LEAST},}})")), lambda r: r.rlike("[0-9]") & r.rlike("[A-Za-z]"))
    rows = rows.withColumn("candidate", F.explode(runs))
    # what stands before the candidate inside its word counts as neighbour too
    before = F.lower(F.concat_ws(" ", "left", F.expr("substring_index(word, candidate, 1)")))
    rows = rows.withColumn("before", before).drop("left", "word")
    return rows.withColumn("candidate", F.regexp_replace("candidate", r"[.:]+$", "")).filter(F.length("candidate") >= LEAST)


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) over all texts: letters only, in lower case."""
    parts = docs.select(F.explode(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}]+")).alias("word"))
    return parts.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter("word != ''")


def transitions(counts: DataFrame) -> DataFrame:
    """(pair, logp): log-probability of the second character after the first; letters and digits, at most 36^2 rows."""
    pairs = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring(F.col("word"), i, F.lit(2)))
    rows = counts.filter(F.length("word") >= 2).select("n", F.explode(pairs).alias("pair"))
    sums = rows.filter(F.col("pair").rlike("^[a-z0-9]{2}$")).groupBy("pair").agg(F.sum("n").alias("n"))
    first = sums.groupBy(F.substring("pair", 1, 1).alias("first")).agg(F.sum("n").alias("total"))
    joined = sums.join(F.broadcast(first), F.substring("pair", 1, 1) == F.col("first"))  # at most 36 rows
    return joined.select("pair", F.log((F.col("n") + 0.5) / (F.col("total") + 0.5 * len(_ALPHABET))).alias("logp"))


def featured(found: DataFrame, counts: DataFrame) -> DataFrame:
    """found with FEATURES; found is a written table."""
    one = settle(found.select("candidate").distinct())
    lower = F.lower("candidate")
    pairs = F.transform(F.sequence(F.lit(1), F.length("candidate") - 1), lambda i: F.substring(lower, i, F.lit(2)))
    moves = one.select("candidate", F.explode(pairs).alias("pair")).filter(F.col("pair").rlike("^[a-z0-9]{2}$"))
    moves = moves.join(F.broadcast(transitions(counts)), "pair", "left")  # at most 36^2 rows
    moves = moves.groupBy("candidate").agg(F.avg(F.coalesce("logp", F.lit(-8.0))).alias("transition"))
    pieces = one.select("candidate", F.explode(F.regexp_extract_all(lower, F.lit(r"([a-z]{3,})"))).alias("word"))
    asked = small_or_shuffled(settle(pieces.select("word").distinct()))
    known = counts.filter(F.col("n") >= DICTIONARY).join(asked, "word", "left_semi").select("word")
    covered = pieces.join(small_or_shuffled(settle(known)), "word").groupBy("candidate").agg(F.sum(F.length("word")).alias("covered"))
    c, n = F.col("candidate"), F.length("candidate")
    share = lambda characters: 1 - F.length(F.regexp_replace(c, characters, "")) / n
    form = {
        "length": F.least(n, F.lit(200)), "digits": share("[0-9]"), "capitals": share("[A-Z]"), "distinct": F.size(F.array_distinct(F.split(c, ""))) / n,
        "changes": F.regexp_count(c, F.lit("(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])")) / n,
        "path": F.regexp_count(c, F.lit("/")), "at": c.contains("@").cast("int"), "dots": F.regexp_count(c, F.lit(r"\.")),
        "coverage": F.coalesce(F.col("covered"), F.lit(0)) / n, "transition": F.coalesce(F.col("transition"), F.lit(-8.0)),
    }
    one = one.join(moves, "candidate", "left").join(covered, "candidate", "left").select("candidate", *[v.cast("double").alias(k) for k, v in form.items()])
    near = {
        "key_near": F.col("before").rlike(f"({KEY_WORDS})"), "digest_near": F.col("before").rlike(rf"\b({DIGEST_WORDS})\b"),
        "assigned": F.col("before").rlike(r"[=:]\s*[\"']?\s*$"),
    }
    return found.join(one, "candidate").select("*", *[v.cast("double").alias(k) for k, v in near.items()])


def known(found: DataFrame) -> Column:
    """1.0 and 0.0 for findings of a sure kind, else null."""
    c, named = F.col("candidate"), (F.col("key_near") == 1) & (F.col("assigned") == 1)
    return F.when(c.rlike(FORMATS) | named & ~c.rlike(FALSE_FORMATS), 1.0).when(c.rlike(FALSE_FORMATS) | (F.col("digest_near") == 1), 0.0)


def secrets(docs: DataFrame, labels: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, word_number, candidate, score, is_secret per candidate. labels: (candidate, label 0/1) of findings; else `known` labels them."""
    found = settle(candidates(docs, key, text))
    counts = settle(word_counts(docs, text))
    rows = featured(found, counts)
    if labels is None:
        rows = rows.withColumn("label", known(rows))
    else:
        judged = labels.groupBy("candidate").agg(F.min("label").cast("double").alias("label"))
        rows = rows.join(judged, "candidate", "left")
    rows = settle(rows)
    # bounded: SAMPLE_FINDINGS rows in a fixed order; half of each kind where there are as many
    turn = F.xxhash64("candidate", "before", "after")
    half = [rows.filter(F.col("label") == v).withColumn("_turn", turn).orderBy("_turn", key, "word_number").limit(SAMPLE_FINDINGS // 2) for v in (0.0, 1.0)]
    sample = settle(half[0].unionByName(half[1]).select("label", *FEATURES))
    kinds = dict(sample.groupBy("label").count().collect())
    if len(kinds) < 2:
        scored = rows.withColumn("score", F.lit(next(iter(kinds)) if kinds else 0.5))
    else:
        assemble = VectorAssembler(inputCols=list(FEATURES), outputCol="_features")
        forest = RandomForestClassifier(
            featuresCol="_features", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED, probabilityCol="_p", rawPredictionCol="_r", predictionCol="_d"
        ).fit(assemble.transform(sample).coalesce(1).sortWithinPartitions("label", *FEATURES))
        scored = forest.transform(assemble.transform(rows)).withColumn("score", vector_to_array("_p")[1])
    return scored.select(key, "word_number", "candidate", "score", (F.col("score") >= ACCEPT).alias("is_secret"))
