"""The registered queries of this subpackage and, where SQL can express them, the same results in SQL."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerscope.llm import bitmin, decontam, jaccard, language, line_dedup, merkle, mixing, pii, quality, search, secret_scan, toxicity, warc
from ledgerscope.llm.common import is_remainder, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.toxicity(docs, table(spark, sf_dir, "labels"), ~is_remainder("doc_id", 4, 2))
    return scored.select("doc_id", is_remainder("doc_id", 4, 2).alias("held_out"), "score", "predicted")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = quality.verdicts(docs, table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                      F.concat_ws(",", "failed_rules").alias("failed_rules"))


_RULES_SQL = ", ".join(f"('{rule}', {count}, {base})" for rule, (count, base) in quality.RULES.items())
OP2_SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(lang, 'none') AS stratum, coalesce(text, '') AS text FROM documents),
p AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM p, LATERAL (SELECT unnest(generate_series(1, len(w) - 2)) AS i)),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g), LATERAL (SELECT unnest([0, 1, 2]) AS k)
      WHERE c > 1 GROUP BY doc_id),
f AS (SELECT p.doc_id, stratum, len(w) AS n_words, length(list_aggregate(w, 'string_agg', '')) AS word_chars,
             len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
             len(l) AS n_lines, len(regexp_extract_all(text, '[A-Z]')) AS n_capitals, len(regexp_extract_all(text, '[!?]')) AS n_shouts
      FROM p LEFT JOIN r ON p.doc_id = r.doc_id),
b AS (SELECT *, n_words < {quality.LEAST_WORDS} OR 100 * n_repeat_words > {quality.MOST_REPEATED} * n_words AS base_failed FROM f),
q AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IN (0, 1) GROUP BY doc_id),
long AS (SELECT b.doc_id, stratum, base_failed, u.rule, u.num, u.den FROM b, LATERAL (VALUES {_RULES_SQL}) AS u(rule, num, den)),
cuts AS (SELECT unnest({list(quality.CUTS)}) AS cut),
n AS (SELECT stratum, count(*) FILTER (quality = 1) AS n FROM b JOIN q USING (doc_id) WHERE NOT base_failed GROUP BY stratum),
c AS (SELECT stratum, rule, cut, count(*) FILTER (quality = 1 AND 10000 * num > cut * den) AS good, count(*) FILTER (quality = 0 AND 10000 * num > cut * den) AS bad
      FROM long JOIN q USING (doc_id), cuts WHERE NOT base_failed GROUP BY ALL),
s AS (SELECT c.*, n.n > 0 AND good < n.n * {quality.RISK / len(quality.RULES)} AND
             list_sum(list_transform(generate_series(0, good), lambda i: exp(lgamma(n.n + 1) - lgamma(i + 1) - lgamma(n.n - i + 1)
                + i * ln({quality.RISK / len(quality.RULES)}) + (n.n - i) * ln(1 - {quality.RISK / len(quality.RULES)}))))
             <= {quality.ERROR / len(quality.RULES)} / (SELECT count(*) FROM n) AS safe FROM c JOIN n USING (stratum)),
e AS (SELECT *, coalesce(max(cut) FILTER (NOT safe) OVER (PARTITION BY stratum, rule), 0) AS stop FROM s),
best AS (SELECT stratum, rule, arg_max(cut, (bad - good) * 100000 + cut) AS cut FROM e WHERE cut > stop AND bad > good GROUP BY stratum, rule),
v AS (SELECT doc_id, string_agg(rule, ',' ORDER BY list_position({list(quality.RULES)}, rule)) AS failed
      FROM long JOIN best USING (stratum, rule) WHERE 10000 * num > cut * den GROUP BY doc_id)
SELECT b.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND failed IS NULL AS kept, coalesce(failed, '') AS failed_rules
FROM b LEFT JOIN v USING (doc_id)
"""


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = language.identify(docs, ~is_remainder("doc_id", 5, 0))
    mixed = F.concat_ws(",", F.array_sort(F.map_keys("mixture")))
    return out.select("doc_id", is_remainder("doc_id", 5, 0).alias("held_out"), "lang_pred", "score", mixed.alias("languages"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.concat_ws(",", "items"), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secrets(table(spark, sf_dir, "documents"))


def _joined(spans: str):
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(table(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in pii.BASE]
    return found.select("doc_id", *counts, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    shards = F.transform("places", lambda p: p["shard"])
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.concat_ws(",", shards).alias("shards"))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_copies")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


OP9_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
m AS (SELECT n, d, max(page_id) AS top FROM p WHERE n >= 1000 GROUP BY n, d)
SELECT page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
       CASE WHEN top IS NULL OR top = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN top <> page_id THEN top END AS refers_to
FROM p LEFT JOIN m ON p.n = m.n AND p.d = m.d
"""

OP10_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS g
       FROM b, LATERAL (SELECT unnest(generate_series(1, greatest(1, len(w) - 12))) AS i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM iw),
dg AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM dw, sizes, LATERAL (SELECT unnest(generate_series(1, len(w) - n + 1)) AS i)),
m AS (SELECT doc_id, dg.n, i, item FROM dg JOIN iw ON dg.n = iw.n AND dg.g = iw.g),
h AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM m, LATERAL (SELECT unnest(generate_series(0, n - 1)) AS k) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""

def op11_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitmin.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


_LOWER = f"translate(text, '{ascii_uppercase}', '{ascii_lowercase}')"
OP11_SQL = rf"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(coalesce({_LOWER}, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 1 THEN w ELSE list_sort(list_distinct(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]))) END AS g FROM t),
k AS (SELECT g, min(doc_id) AS least FROM s WHERE len(g) > 0 GROUP BY g),
n AS (SELECT row_number() OVER (ORDER BY least) AS node, g, least, len(g) AS size FROM k),
x AS (SELECT node, size, unnest(g) AS gram FROM n),
e AS (SELECT a.node AS a, b.node AS b FROM x AS a JOIN x AS b ON a.gram = b.gram AND a.node < b.node GROUP BY a.node, b.node, a.size, b.size
      HAVING 100 * count(*) >= 80 * (a.size + b.size - count(*))),
pairs AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT a AS node, b AS other FROM pairs UNION SELECT reach.node, pairs.b FROM reach JOIN pairs ON pairs.a = reach.other),
c AS (SELECT node, min(least) AS least FROM (SELECT node, least FROM n UNION ALL SELECT reach.node, n.least FROM reach JOIN n ON n.node = reach.other) GROUP BY node)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, coalesce(c.least, s.doc_id) AS component_id, s.doc_id IS NOT DISTINCT FROM coalesce(c.least, s.doc_id) AS kept
FROM s LEFT JOIN n ON s.g = n.g AND len(s.g) > 0 LEFT JOIN c ON c.node = n.node
"""


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("item_id", "rank", "doc_id", "score")


OP12_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce({_LOWER}, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT DISTINCT item_id, text FROM benchmark),
i AS (SELECT row_number() OVER () AS q, item_id, regexp_extract_all(coalesce({_LOWER}, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM b),
g AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d WHERE len(w) > 0),
tf AS (SELECT r, doc_id, len(w) AS n, term, count(*) AS tf FROM d, LATERAL (SELECT unnest(w) AS term) GROUP BY ALL),
qt AS (SELECT q, item_id, term, count(*) AS c FROM i, LATERAL (SELECT unnest(w) AS term) GROUP BY ALL),
df AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, g GROUP BY term, n_docs),
s AS (SELECT q, item_id, r, doc_id, CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms)))) AS BIGINT) AS score
      FROM qt JOIN tf USING (term) JOIN df USING (term), g GROUP BY ALL),
o AS (SELECT item_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id, r) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM o WHERE rank <= 10
"""


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    lowered = F.translate("text", ascii_uppercase, ascii_lowercase)
    docs = table(spark, sf_dir, "documents")
    return merkle.manifest(docs, {"text": lowered}, is_remainder("doc_id", 5, 0))


def _merkle_sql(levels: int = 7) -> str:
    """Level by level in SQL, enough for WIDTH ** levels rows in a source; a group that has come to one node passes it on."""
    field = lambda c: f"coalesce(concat(strlen(CAST({c} AS VARCHAR)), ':', {c}), '-')"
    leaf = lambda text: "sha256(concat(" + ", ".join([*map(field, merkle.FIELDS[:-1]), field(text)]) + "))"
    codes = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))"
    bits = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))"
    crc = f"xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda c, b: {bits}))"
    parts = [f"""t0 AS (SELECT row_number() OVER () AS id, doc_id, source, {leaf('text')} AS leaf,
      CASE WHEN {crc} % 5 = 0 THEN {leaf(_LOWER)} ELSE {leaf('text')} END AS changed FROM documents),
d0 AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, '' AS proof, leaf AS own, changed AS fold FROM t0)"""]

    def climb(k: int, group: str, start: str) -> None:
        """nodes of level k of the tree in start, then the rows carried one level up"""
        parts.append(f"n{k} AS (SELECT DISTINCT {group} AS g, pos, own FROM {start})")
        parts.append(f"r{k} AS (SELECT g, pos // {merkle.WIDTH} AS up, list(own ORDER BY pos) AS run, sum(count(*)) OVER (PARTITION BY g) AS n FROM n{k} GROUP BY g, pos // {merkle.WIDTH})")
        joined = "concat(array_to_string(run[:pos % 16], ''), {}, array_to_string(run[pos % 16 + 2:], ''))".replace("16", str(merkle.WIDTH))
        parts.append(f"""d{k + 1} AS (SELECT id, doc_id, source, leaf, changed, subroot, pos // {merkle.WIDTH} AS pos,
      CASE WHEN n = 1 THEN proof ELSE concat(proof, {joined.format("''")}) END AS proof,
      CASE WHEN n = 1 THEN own ELSE sha256(array_to_string(run, '')) END AS own,
      CASE WHEN n = 1 THEN fold ELSE sha256({joined.format('fold')}) END AS fold
      FROM {start} AS d JOIN r{k} AS r ON {group} IS NOT DISTINCT FROM r.g AND d.pos // {merkle.WIDTH} = r.up)""")

    start = "(SELECT *, '' AS subroot FROM d0)"
    for k in range(levels):
        climb(k, "source", start)
        start = f"d{k + 1}"
    parts.append(f"d90 AS (SELECT * REPLACE (own AS subroot, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS pos) FROM {start})")
    start = "d90"
    for k in range(91, 91 + levels):
        climb(k, "0", start)
        start = f"d{k + 1}"
    return "WITH " + ",\n".join(parts) + f"""
SELECT doc_id, leaf, subroot, own AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = own AS verified FROM {start}"""


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_quality": op2_quality,
    "op3_language": op3_language,
    "op4_secrets": op4_secrets,
    "op5_pii": op5_pii,
    "op6_mixing": op6_mixing,
    "op7_jaccard": op7_jaccard,
    "op8_line_dedup": op8_line_dedup,
    "op9_warc": op9_warc,
    "op10_decontamination": op10_decontamination,
    "op11_bbit_minhash": op11_bbit_minhash,
    "op12_search": op12_search,
    "op13_merkle": op13_merkle,
}
ORACLES = {"op2_quality": OP2_SQL, "op9_warc": OP9_SQL, "op10_decontamination": OP10_SQL,
           "op11_bbit_minhash": OP11_SQL, "op12_search": OP12_SQL, "op13_merkle": _merkle_sql()}
