"""Personal data by weak supervision.

Patterns propose candidate spans. Labelers vote on each candidate: its form (checksums,
ranges, alphabets), a gazetteer of nearby words, the marks around it, its mix of characters,
and words that speak against it. Expectation-maximisation over the counts of vote patterns
estimates how reliable each labeler is, and its posteriors train a naive Bayes classifier on
votes, kind, length and digit share, which decides the candidates. Spans that the base rules
fix always stay, and the classifier adds secrets and identity numbers; what the rule of a base
kind rejects (a checksum that fails, a part over 255) is not added. Everything on the documents is built-in functions; the driver sees one row
for each combination of votes and feature buckets, some thousands at most.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.runtime import materialize

# Candidate patterns by kind. Possessive repeats and the anchor at the start of
# a run or at the last match's end find the same leftmost matches in linear time. Runs of fewer
# than 13 digits are no card under any rule and are not listed.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9_/+@.-])(?=[A-Za-z_/+-]*+[0-9])(?=[0-9_/+-]*+[A-Za-z])[A-Za-z0-9_/+-]{16,}+(?![@.][A-Za-z0-9])",
    "id": r"(?<![0-9+.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9.-])",
}
BASE = ("email", "ip", "card", "phone")
KINDS = tuple(PATTERNS)
#: A character that every match of a kind contains, to skip other texts.
NEEDED = {"email": "@", "phone": "+", "ip": ".", "id": "-"}
OCTET = r"(?=[0-9])0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]?)?"
# The gazetteer of words before a candidate, and words that speak against it.
NEARBY = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write to|reach)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|addr|client|from)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|payment)\b",
    "phone": r"(?i)\b(?:phone|tel|call|mobile|cell|fax|whatsapp)\b",
    "secret": r"(?i)(?:\b|_)(?:token|key|secret|password|passwd|pwd|bearer|auth|credential|apikey)s?\b",
    "id": r"(?i)\b(?:ssn|social security|tax id|national id)\b",
}
AGAINST = r"(?i)\b(?:version|release|commit|revision|checksum|sha-?1|sha-?256|md5|isbn|build|chapter|section|page)\b"
CONTEXT = 32
#: Elements of an array that are summed one by one; longer arrays are summed block by block.
BLOCK = 256
#: Code points of a text's chunks, from which the parts between spans are taken.
CHUNK = 1_024
LABELERS = ("form", "gazetteer", "marks", "mix", "against")
ROUNDS = 40


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]+", "")


def luhn(value: Column) -> Column:
    """Whether the digits of a card number pass the Luhn check."""
    digits = F.transform(F.filter(F.split(F.reverse(_digits(value)), ""), lambda c: c != ""), lambda c: c.cast("int"))
    doubled = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    """Whether a match passes the rule of its kind."""
    n = F.char_length(_digits(value))
    if kind == "ip":
        return value.rlike("^" + r"\.".join([OCTET] * 4) + "$")
    if kind == "card":
        return F.when(n.between(13, 19), luhn(value)).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    if kind == "secret":
        return value.rlike(r"^(?:[0-9a-f]{32,}|[0-9A-F]{32,}|[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12})$") | (value.rlike("[a-z]") & value.rlike("[A-Z]") & (n >= 3) & (F.char_length(value) >= 20))
    if kind == "id":
        return ~value.rlike(r"^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


def votes(kind: str, value: Column, before: Column, after: Column) -> dict[str, Column]:
    """The labelers' votes on a candidate: 1 for personal data, -1 against, 0 none."""
    length = F.char_length(value)
    share = F.char_length(_digits(value)) / length
    quoted = before.rlike("[\"'`]$") & after.rlike("^[\"'`]")
    given = {
        "form": F.when(valid(kind, value), 1).otherwise(-1),
        "gazetteer": F.when(before.rlike(NEARBY[kind]), 1).otherwise(0),
        "marks": F.when(before.rlike(r"[=:]\s*[\"'`]?$") | quoted, 1).when(before.rlike(r"[A-Za-z0-9/_.-]$") | after.rlike("^[A-Za-z0-9/_]"), -1).otherwise(0),
        "mix": F.when(share.between(0.15, 0.9), 1).otherwise(-1) if kind == "secret" else F.when(length.between(7, 64), 1).otherwise(-1),
        "against": F.when(before.rlike(AGAINST), -1).otherwise(0),
    }
    return {n: c.cast("int") for n, c in given.items()}


def _listed(kind: str, hits: Column, gaps: Column) -> Column:
    """Structs (gap, own, valid, votes, length and digit buckets) of a pattern's matches in order.

    hits are the matches and gaps the texts around them, one more.
    """
    rows = F.arrays_zip(hits.alias("hit"), gaps.alias("gap"), F.slice(gaps, 2, F.greatest(F.size(hits), F.lit(0))).alias("next"))

    def one(row: Column) -> Column:
        hit, gap = row["hit"], row["gap"]
        before, after = F.right(gap, F.lit(CONTEXT)), F.left(row["next"], F.lit(2))
        share = F.floor(4 * F.char_length(_digits(hit)) / F.char_length(hit)).cast("int")
        said = [c.alias(n) for n, c in votes(kind, hit, before, after).items()]
        own = F.char_length(hit)
        return F.struct(F.char_length(gap).alias("gap"), own.alias("own"), valid(kind, hit).alias("valid"), *said, F.least(F.floor(own / 8), F.lit(8)).cast("int").alias("length"), share.alias("digits"))

    return F.transform(F.slice(rows, 1, F.size(hits)), one)


def _blocks(values: Column, step: Callable[[Column, Column], Column], start: int = 0) -> Column:
    """Running results of step over an array of integers, anew for each BLOCK of it.

    values must be a column of the table, as it is read for each block.
    An array that grows in an aggregate is copied at each step, so arrays of any length take
    time in proportion only when blocks are short.
    """
    none = F.array().cast("array<int>")
    grow = lambda a, x: F.array_append(a, step(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(start)), x))
    cut = lambda b: F.aggregate(F.slice(values, b * BLOCK + 1, F.lit(BLOCK)), none, grow)
    last = F.floor((F.size(values) - 1) / BLOCK).cast("int")
    return F.when(F.size(values) > 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), cut)).otherwise(F.array().cast("array<array<int>>"))


def _before(blocks: Column, step: Callable[[Column, Column], Column], start: int = 0) -> Column:
    """The running result before each block."""
    grow = lambda a, b: F.array_append(a, step(F.element_at(a, F.lit(-1)), F.element_at(b, F.lit(-1))))
    return F.aggregate(blocks, F.array(F.lit(start)), grow)


def _joined(blocks: Column, before: Column, step: Callable[[Column, Column], Column]) -> Column:
    """Running results over the whole array."""
    zipped = F.arrays_zip(blocks.alias("b"), F.slice(before, F.lit(1), F.size(blocks)).alias("o"))
    return F.flatten(F.transform(zipped, lambda z: F.transform(z["b"], lambda x: step(z["o"], x))))


def _placed(kind: str, listed: Column, ends: Column) -> Column:
    """Structs (kind, start, end, valid, votes, length, digits) of the listed matches."""
    keep = ["valid", *LABELERS, "length", "digits"]

    def one(row: Column) -> Column:
        s, end = row["s"], row["end"]
        return F.struct(F.lit(kind).alias("kind"), (end - s["own"]).alias("start"), end.alias("end"), *(s[n].alias(n) for n in keep))

    return F.transform(F.arrays_zip(listed.alias("s"), ends.alias("end")), one)


def propose(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with a column candidates: all kinds' candidates, kinds in order, then by start.

    Matches, gaps and running ends are columns of their own, so that each is computed once a
    row; time is in proportion to the text and its candidates.
    """
    kept = docs.columns
    none = F.array().cast("array<string>")
    add = lambda a, x: a + x
    rows = docs.select(*kept, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_body"))
    body, hits = F.col("_body"), {}
    for kind, pattern in PATTERNS.items():
        found = F.regexp_extract_all(body, F.lit(pattern), F.lit(0))
        hits[f"_hits_{kind}"] = F.when(body.contains(NEEDED[kind]), found).otherwise(none) if kind in NEEDED else found
    rows = rows.withColumns(hits)
    rows = rows.withColumns({f"_gaps_{k}": F.when(F.size(f"_hits_{k}") > 0, F.split(body, p, -1)).otherwise(none) for k, p in PATTERNS.items()})
    rows = rows.withColumns({f"_listed_{k}": _listed(k, F.col(f"_hits_{k}"), F.col(f"_gaps_{k}")) for k in KINDS})
    rows = rows.withColumns({f"_lengths_{k}": F.transform(f"_listed_{k}", lambda s: s["gap"] + s["own"]) for k in KINDS})
    rows = rows.withColumns({f"_blocks_{k}": _blocks(F.col(f"_lengths_{k}"), add) for k in KINDS})
    rows = rows.withColumns({f"_before_{k}": _before(F.col(f"_blocks_{k}"), add) for k in KINDS})
    ends = {k: _joined(F.col(f"_blocks_{k}"), F.col(f"_before_{k}"), add) for k in KINDS}
    return rows.select(*kept, F.concat(*(_placed(k, F.col(f"_listed_{k}"), ends[k]) for k in KINDS)).alias("candidates"))


def _log_odds(weights: dict[Any, list[float]], totals: list[float], values: int) -> dict[Any, float]:
    return {k: math.log((w[1] + 1) / (totals[1] + values)) - math.log((w[0] + 1) / (totals[0] + values)) for k, w in weights.items()}


def estimate(patterns: list[tuple[dict[str, Any], int]]) -> tuple[dict[str, dict[int, tuple[float, float]]], float, list[float]]:
    """EM over vote patterns and their counts: P(vote | not personal, personal) of each labeler, the prior, and posteriors."""
    posterior = [min(0.95, max(0.05, 0.5 + sum(p[n] for n in LABELERS) / (2 * len(LABELERS)))) for p, _ in patterns]
    rates: dict[str, dict[int, tuple[float, float]]] = {}
    prior = 0.5
    for _ in range(ROUNDS):
        total = [sum(c * (1 - q) for (_, c), q in zip(patterns, posterior)), sum(c * q for (_, c), q in zip(patterns, posterior))]
        prior = (total[1] + 1) / (sum(total) + 2)
        for name in LABELERS:
            seen = {v: [1.0, 1.0] for v in (-1, 0, 1)}
            for (p, c), q in zip(patterns, posterior):
                seen[p[name]][0] += c * (1 - q)
                seen[p[name]][1] += c * q
            rates[name] = {v: (w[0] / (total[0] + 3), w[1] / (total[1] + 3)) for v, w in seen.items()}
        odds = [math.log(prior / (1 - prior)) + sum(math.log(rates[n][p[n]][1] / rates[n][p[n]][0]) for n in LABELERS) for p, _ in patterns]
        posterior = [1 / (1 + math.exp(-max(-30.0, min(30.0, o)))) for o in odds]
    return rates, prior, posterior


def train(proposed: DataFrame) -> dict[str, dict[Any, float]]:
    """Log-odds of the naive Bayes classifier for each feature value, trained on EM posteriors.

    The counts are of all candidates of all documents.
    """
    names = ["kind", *LABELERS, "length", "digits"]
    listed = proposed.select(F.explode("candidates").alias("c")).select(*(F.col(f"c.{n}").alias(n) for n in names))
    patterns = [(r.asDict(), r["n"]) for r in listed.groupBy(*names).agg(F.count("*").alias("n")).orderBy(*names).collect()]
    _, prior, posterior = estimate(patterns)
    totals = [1.0 + sum(n * (1 - q) for (_, n), q in zip(patterns, posterior)), 1.0 + sum(n * q for (_, n), q in zip(patterns, posterior))]
    model: dict[str, dict[Any, float]] = {"": {"": math.log(prior / (1 - prior))}}
    for name in names:
        weights: dict[Any, list[float]] = defaultdict(lambda: [0.0, 0.0])
        for (p, n), q in zip(patterns, posterior):
            weights[p[name]][0] += n * (1 - q)
            weights[p[name]][1] += n * q
        model[name] = _log_odds(weights, totals, len(weights))
    return model


def personal(candidate: Column, model: dict[str, dict[Any, float]]) -> Column:
    """Whether a candidate is personal data: by the base rules, else by the classifier."""
    score = F.lit(model[""][""])
    for name, odds in model.items():
        if name and odds:
            table = F.create_map(*(F.lit(x) for pair in sorted(odds.items(), key=str) for x in pair))
            score = score + F.coalesce(F.try_element_at(table, candidate[name]), F.lit(0.0))
    return F.when(candidate["kind"].isin(*BASE), candidate["valid"]).otherwise(score > 0)


def find(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, spans) of every document: structs (kind, start, end) in code points, end exclusive.

    Spans are by kind in the order of KINDS, then by start. Null and empty texts have none;
    rows with null or repeated ids are judged each; other columns are not read; an empty table
    gives an empty result.
    """
    proposed = materialize(propose(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")), "text").drop("text"))
    model = train(proposed)
    return proposed.select("doc_id", F.filter("candidates", lambda c: personal(c, model)).alias("spans"))


def digests(docs: DataFrame) -> DataFrame:
    """Counts of each base kind and of all spans, a digest of the base spans, and all spans as a string."""

    def name(s: Column) -> Column:
        return F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))

    found = find(docs)
    joined = lambda spans: F.array_join(F.transform(spans, name), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    counts = [(F.size("spans") - F.size(F.array_remove(F.col("spans")["kind"], k))).cast("long").alias(f"n_{k}") for k in BASE]
    counts.append(F.size("spans").cast("long").alias("n_spans"))
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """The documents with each span's text replaced by its kind, as [EMAIL]; columns as given.

    Overlapping spans are replaced together under the first one's kind. A null text stays null.
    """
    model = train(materialize(propose(docs.select(F.col(text).alias("text")), "text").drop("text")))
    proposed = propose(docs, text)
    chosen = F.transform(F.filter("candidates", lambda c: personal(c, model)), lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind")))
    rows = proposed.select(*docs.columns, F.sort_array(chosen).alias("_spans"))
    further = lambda a, b: F.greatest(a, b)
    rows = rows.withColumn("_stops", F.col("_spans")["end"])
    rows = rows.withColumn("_blocks", _blocks(F.col("_stops"), further))
    rows = rows.withColumn("_before", _before(F.col("_blocks"), further))
    rows = rows.withColumn("_ends", F.concat(F.array(F.lit(0)), _joined(F.col("_blocks"), F.col("_before"), further)))
    rows = rows.withColumn("_chunks", F.when(F.size("_spans") > 0, F.regexp_extract_all(F.col(text), F.lit("(?s).{1,%d}" % CHUNK), F.lit(0))))

    def part(start: Column, end: Column) -> Column:
        first, last = F.floor(start / CHUNK).cast("int"), F.floor(end / CHUNK).cast("int")
        near = F.array_join(F.slice("_chunks", first + 1, last - first + 1), "")
        return F.substr(near, start - first * CHUNK + 1, end - start)

    # _ends has how far the spans before each one reach; a span that starts before that is inside.
    zipped = F.arrays_zip(F.col("_spans").alias("s"), F.slice("_ends", 1, F.size("_spans")).alias("at"))
    fresh = F.filter(zipped, lambda z: z["s"]["start"] >= z["at"])
    parts = F.transform(fresh, lambda z: F.concat(part(z["at"], z["s"]["start"]), F.lit("["), F.upper(z["s"]["kind"]), F.lit("]")))
    reach = F.element_at("_ends", F.lit(-1))
    done = F.concat(F.array_join(parts, ""), part(reach, F.char_length(F.col(text))))
    rows = rows.withColumn("_text", F.when(F.size("_spans") > 0, done).otherwise(F.col(text)))
    new = {text: F.col("_text")} | ({n_chars: F.char_length("_text").cast(docs.schema[n_chars].dataType)} if n_chars in docs.columns else {})
    return rows.select(*(new.get(c, F.col(c)).alias(c) for c in docs.columns))
