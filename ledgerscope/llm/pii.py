"""Personal data by weak supervision.

Base spans (email, ip, card, phone) come from fixed patterns and always stay. Looser patterns give candidates beside them: national
phone numbers, short cards, IBANs, social security numbers, spelled-out addresses and titled names. Labelers vote on every
span, base or candidate: strictness of the pattern (regex), check digits, gazetteers, words before it (context), and personal
data nearby; each says yes, no or nothing. Expectation-maximisation over the counts of vote patterns - all spans of all texts, at most
3^5 patterns - estimates how often each labeler is right. The posteriors train the span classifier, a logistic regression on the span's
form, and it decides on the candidates. It learns from distinct spans (equal votes and form) with their counts as weights; of a kind with
more than its share of SAMPLE_SPANS, those of the smallest hashes stand for all of the kind, with its whole weight.

Defined results: null and empty texts have no spans; repeated rows have equal spans; without candidates nothing is trained. Offsets
are code points, ends exclusive. Only the id and text columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.llm.common import settle

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "address", "iban", "name", "short_card", "ssn", "national_phone")
#: Bound of the distinct spans that train the classifier, in equal shares for the kinds.
SAMPLE_SPANS = 20_000
ACCEPT, ROUNDS = 0.5, 50
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a failing start inside a run of digits would fail from its first digit too, so only first digits are tried
_ip = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_loose = {
    "national_phone": re.compile(r"(?<![0-9+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"),
    "ssn": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
}
_spelled = re.compile(r"(?i)(?<![a-z0-9])[a-z0-9._-]{2,64} ?[\[(]at[\])] ?[a-z0-9-]{2,64}(?: ?[\[(]dot[\])] ?[a-z]{2,24})+")
_titled = re.compile(r"(?:Mr|Mrs|Ms|Dr|Herr|Frau|Monsieur|Madame|Señora?)\.? [A-ZÀ-Þ][a-zß-ÿ]+(?: [A-ZÀ-Þ][a-zß-ÿ]+)?")
_title = re.compile(r"Mr|Ms|Dr|Herr|Frau|Mons|Mada|Seño")
_digit = re.compile(r"[0-9]")
#: Gazetteers: common first names, and country codes of IBANs.
NAMES = frozenset("james mary john anna maria peter michael thomas paul laura jean pierre marie claire luis carlos ana jose hans karl julia sara david".split())
COUNTRIES = frozenset("AT BE CH DE DK ES FI FR GB IE IT LU NL NO PL PT SE".split())
HINTS = frozenset("call phone tel telephone mobile fax contact mail email write card visa iban account ssn name telefon anruf karte konto appel carte compte llamar tarjeta cuenta correo".split())
DOUBTS = frozenset("order version isbn issn invoice item part ticket page figure table chapter bestellung rechnung commande facture pedido factura".split())


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def emails(t: str) -> list[tuple[int, int]]:
    """Left-most matches of local@domain, found from each @ to both sides in linear time."""
    out, end, at = [], 0, t.find("@")
    while at >= 0:
        lo = at
        while lo > end and t[lo - 1] in _LOCAL:
            lo -= 1
        if lo < at and (m := _domain.match(t, at + 1)):
            out.append((lo, m.end()))
            end = m.end()
        at = t.find("@", at + 1)
    return out


def base_spans(t: str) -> list[tuple[str, int, int]]:
    """The base spans by kind as listed, then start."""
    out = [("email", *s) for s in emails(t)] if "@" in t else []
    if not _digit.search(t):
        return out
    for m in _ip.finditer(t):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _card.finditer(t):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in t:
        out += [("phone", *m.span()) for m in _phone.finditer(t) if 8 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return out


def candidate_spans(t: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Looser spans that overlap no base span nor an earlier candidate."""
    found = []
    if _digit.search(t):
        for kind, pattern in _loose.items():
            found += [(kind, *m.span()) for m in pattern.finditer(t)]
        for m in _card.finditer(t):
            if 13 <= m.end() - m.start() <= 20 and 13 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append(("short_card", *m.span()))
    if "at" in t and ("[" in t or "(" in t):
        found += [("address", *m.span()) for m in _spelled.finditer(t)]
    if _title.search(t):
        found += [("name", *m.span()) for m in _titled.finditer(t)]
    taken, out, k = sorted((lo, hi) for _, lo, hi in base), [], 0
    end = 0
    for kind, lo, hi in sorted(found, key=lambda s: (s[1], -s[2])):
        while k < len(taken) and taken[k][1] <= lo:
            k += 1
        if lo >= end and not (k < len(taken) and taken[k][0] < hi):
            out.append((kind, lo, hi))
            end = hi
    return out


def votes_of(t: str, kind: str, lo: int, hi: int, near: bool) -> list[int]:
    """Of the labelers: 1 personal, -1 not, 0 nothing said."""
    span = t[lo:hi]
    digits = "".join(c for c in span if c in "0123456789")
    before = re.findall(r"[^\W\d_]+", t[max(0, lo - 48) : lo].lower())[-5:]
    regex = {"email": 1, "ip": 1, "card": 1, "phone": 1, "iban": 1, "address": 1, "ssn": 1, "short_card": -1}.get(kind, 0)
    check = 0
    if kind in ("card", "short_card"):
        check = 1 if luhn(digits) else -1
    elif kind == "iban":
        s = span.replace(" ", "")
        check = 1 if int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1 else -1
    elif kind == "ssn":
        check = -1 if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000" else 1
    gazetteer = 0
    if kind == "name":
        gazetteer = 1 if any(w.lower() in NAMES for w in span.split()[1:]) else 0
    elif kind == "iban":
        gazetteer = 1 if span[:2] in COUNTRIES else -1
    context = 1 if any(w in HINTS for w in before) else -1 if any(w in DOUBTS for w in before) else 0
    return [regex, check, gazetteer, context, 1 if near else 0]


def features_of(t: str, kind: str, lo: int, hi: int) -> list[float]:
    """The form of a span, and nothing that a labeler computes beyond it."""
    span = t[lo:hi]
    n = len(span)
    return [
        1.0, *(float(kind == k) for k in KINDS), min(n, 64) / 32, sum(c.isdigit() for c in span) / n, sum(c.isupper() for c in span) / n,
        sum(not c.isalnum() for c in span) / n, len(set(span)) / n, float(lo > 0 and t[lo - 1].isalnum()), float(hi < len(t) and t[hi].isalnum()),
    ]


WIDTH = len(features_of("a", "name", 0, 1))


def scanned(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, spans): all spans of each row with kind, start, stop, base, votes and features. One pass over the texts, written."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for t in b["_text"]:
                t = t or ""
                base = base_spans(t)
                extra = candidate_spans(t, base)
                starts = np.array(sorted(s[1] for s in base))
                rows = []
                for is_base, kind, lo, hi in [(True, *s) for s in base] + [(False, *s) for s in extra]:
                    near = int(np.searchsorted(starts, hi + 80) - np.searchsorted(starts, lo - 120)) > int(is_base)
                    rows.append({"kind": kind, "start": lo, "stop": hi, "base": is_base, "votes": votes_of(t, kind, lo, hi, near), "features": features_of(t, kind, lo, hi)})
                out.append(rows)
            yield pd.DataFrame({"id": b["_id"], "spans": out})

    kind = docs.schema[key].dataType.simpleString()
    span = "struct<kind:string,start:bigint,stop:bigint,base:boolean,votes:array<int>,features:array<double>>"
    return settle(docs.select(F.col(key).alias("_id"), F.col(text).alias("_text")).mapInPandas(run, f"id {kind}, spans array<{span}>"))


def reliabilities(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> tuple[float, np.ndarray, np.ndarray]:
    """EM over distinct vote patterns: share of personal spans, P(vote | class) as (class, labeler, vote + 1), posterior per pattern."""
    post = np.clip(0.5 + 0.2 * patterns.sum(1), 0.05, 0.95)
    for _ in range(rounds):
        prior = (counts @ post + 1) / (counts.sum() + 2)
        table = np.empty((2, patterns.shape[1], 3))
        for c, w in enumerate((counts * (1 - post), counts * post)):
            for v in range(3):
                table[c, :, v] = (w @ (patterns == v - 1) + 0.5) / (w.sum() + 1.5)
        rows = np.arange(patterns.shape[1])
        log = [np.log(table[c, rows, patterns + 1]).sum(1) + np.log(p) for c, p in ((0, 1 - prior), (1, prior))]
        post = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
    return prior, table, post


def train(features: np.ndarray, target: np.ndarray, weight: np.ndarray | None = None, rounds: int = 300) -> np.ndarray:
    """Logistic regression on soft targets, with a small ridge."""
    w = np.zeros(features.shape[1])
    share = np.full(len(target), 1 / len(target)) if weight is None else weight / weight.sum()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-features @ w))
        hess = (features * (p * (1 - p) * share)[:, None]).T @ features + 1e-3 * np.eye(len(w))
        step = np.linalg.solve(hess, features.T @ ((p - target) * share) + 1e-3 * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def sample(distinct: DataFrame, most: int = SAMPLE_SPANS) -> pd.DataFrame:
    """distinct: (kind, votes, features, n). At most most // len(KINDS) rows of each kind, by hash, with the weight of the whole kind."""
    turn, picked = F.xxhash64("votes", "features"), None
    for k in KINDS:
        one = distinct.filter(F.col("kind") == k).orderBy(turn, "votes", "features").limit(most // len(KINDS))
        picked = one if picked is None else picked.unionAll(one)
    rows = picked.toPandas()
    whole = dict(distinct.groupBy("kind").agg(F.sum("n")).collect())  # a row per kind
    rows["weight"] = rows["n"] * rows["kind"].map(whole) / rows.groupby("kind")["n"].transform("sum")
    rows["k"] = rows["votes"].map(tuple)
    return rows.assign(f=rows["features"].map(tuple)).sort_values(["kind", "k", "f"], ignore_index=True)


def fit(found: DataFrame) -> np.ndarray | None:
    """Weights of the span classifier, from the votes on all spans."""
    distinct = settle(found.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.votes", "s.features").agg(F.count(F.lit(1)).alias("n")))
    seen = distinct.groupBy("votes").agg(F.sum("n").alias("n")).toPandas()  # at most 3^5 rows
    if seen.empty:
        return None
    seen = seen.assign(k=seen["votes"].map(tuple)).sort_values("k")
    _, _, post = reliabilities(np.array(seen["k"].tolist()), seen["n"].to_numpy(float))
    belief = dict(zip(seen["k"], post, strict=True))
    taught = sample(distinct)
    return train(np.array(taught["features"].tolist()), taught["k"].map(belief).to_numpy(), taught["weight"].to_numpy(float))


def personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, base and spans of each row: arrays of (kind, start, stop), by kind as in KINDS, then start."""
    found = scanned(docs, key, text)
    weights = fit(found)

    def pick(spans: pd.Series, base_only: bool) -> pd.Series:
        def one(rows: list) -> list[dict]:
            kept = [r for r in rows if r["base"] or not base_only and 1 / (1 + np.exp(-np.dot(r["features"], weights))) >= ACCEPT]
            kept.sort(key=lambda r: (KINDS.index(r["kind"]), r["start"]))
            return [{"kind": r["kind"], "start": r["start"], "stop": r["stop"]} for r in kept]
        return spans.map(one)

    kind = "array<struct<kind:string,start:bigint,stop:bigint>>"
    base = F.pandas_udf(lambda s: pick(s, True), kind)
    every = F.pandas_udf(lambda s: pick(s, False), kind)
    return found.select(F.col("id").alias(key), base("spans").alias("base"), every("spans").alias("spans"))
