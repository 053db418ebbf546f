"""Secrets in texts: fixed patterns, and strings that look random to character Markov models.

Two models of character pairs, one of random strings and one of ordinary identifiers, are trained from
what the fixed patterns label in all documents; a string is a secret when the first explains it so much better
than the second. Only DataFrame functions are used; places are code points, ends exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sealed

#: Kind, pattern, group that must have a least length, and that length.
KINDS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]{24,}", 0, 24),  # runs are whole either way; shorter ones would only be dropped
)
MARKOV = "markov"
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
LEAST_RATIO, LEAST_PER_PAIR = 12.0, 0.6  # in nats: of the whole string, and of its mean pair
_SPAN = "array<struct<start:int,place:int,end:int,kind:string>>"


def _spans(text: Column, kind: str, place: int, pattern: str, group: int, least: int) -> Column:
    """Spans of the pattern's matches, leftmost and non-overlapping: the parts between them give their places."""
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("part"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("found"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.coalesce(F.length(x["match"]), F.lit(0))
        span = F.struct(begin.alias("start"), F.lit(place).alias("place"), end.alias("end"), F.lit(kind).alias("kind"))
        return F.struct(end.alias("at"), F.when(F.length(x["part"]) >= least, F.concat(acc["found"], F.array(span))).otherwise(acc["found"]).alias("found"))

    return F.when(text.rlike(pattern), F.aggregate(zipped, start, step)["found"]).otherwise(F.array().cast(_SPAN))


def _pairs(chars: Column) -> Column:
    n = F.size(chars) - 1
    return F.when(n > 0, F.zip_with(F.slice(chars, 1, n), F.slice(chars, 2, n), lambda a, b: F.concat(a, b)))


def train(docs: DataFrame, prior: float = 0.5) -> list[float]:
    """Log-likelihood ratio of each character pair, from all documents.

    What the fixed patterns find is labelled random; words of ten letters, hyphens and underscores or more are labelled
    ordinary. At most one row per pair and label is collected. Without samples of both labels every ratio is 0.
    """
    text = F.coalesce("text", F.lit(""))
    values = [F.regexp_extract_all(text, F.lit(p), F.lit(g)) for _, p, g, _ in KINDS]
    secret = F.concat(*(F.filter(v, lambda x, n=n: F.length(x) >= n) for v, (_, _, _, n) in zip(values, KINDS, strict=True)))
    plain = F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z0-9+/_=-])[A-Za-z][A-Za-z_-]{9,}(?![A-Za-z0-9+/_=-])"), F.lit(0))
    labelled = docs.select(F.explode(F.array(F.struct(F.lit(1).alias("label"), secret.alias("found")), F.struct(F.lit(0).alias("label"), plain.alias("found")))).alias("x"))
    strings = labelled.select("x.label", F.explode("x.found").alias("s"))
    counted = strings.select("label", F.explode(_pairs(F.split("s", ""))).alias("pair")).groupBy("label", "pair").count()
    n = len(ALPHABET)
    place = {c: i for i, c in enumerate(ALPHABET)}
    tables = [[[prior] * n for _ in range(n)] for _ in range(2)]
    seen = [0, 0]
    for r in counted.where(F.col("pair").rlike(f"^[{ALPHABET[:-1]}-]{{2}}$")).collect():
        tables[r["label"]][place[r["pair"][0]]][place[r["pair"][1]]] += r["count"]
        seen[r["label"]] += r["count"]
    if not all(seen):
        return [0.0] * (n * n)
    return [math.log(tables[1][a][b] / sum(tables[1][a])) - math.log(tables[0][a][b] / sum(tables[0][a])) for a in range(n) for b in range(n)]


def _ratio(string: Column, ratios: list[float]) -> Column:
    """Sum of the pairs' log-likelihood ratios of a string over ALPHABET."""
    codes = F.lit([ALPHABET.find(chr(c)) for c in range(128)])
    table, n = F.lit(ratios), len(ALPHABET)
    code = F.transform(F.split(string, ""), lambda c: F.element_at(codes, F.ascii(c) + 1))
    # the array of codes is bound to a name by a one-element transform, else each step would make it again
    return F.transform(F.array(code), lambda c: F.aggregate(F.zip_with(F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c) - 1), lambda a, b: F.element_at(table, a * n + b + 1)), F.lit(0.0), lambda s, x: s + x))[0]


def scan(docs: DataFrame, ratios: list[float]) -> DataFrame:
    """Adds base_spans and all_spans, arrays of (start, place, end, kind) in order of start, then kind.

    The models add strings of CANDIDATE that touch no span of the fixed patterns. Null texts have no
    spans; other columns and repeated rows stay, columns of these names are replaced.
    """
    kept = [c for c in docs.columns if c not in ("base_spans", "all_spans")]
    text = F.col("_text")
    df = docs.select(*kept, F.coalesce("text", F.lit("")).alias("_text")).withColumn("base_spans", F.sort_array(F.concat(*(_spans(text, k, i, p, g, n) for i, (k, p, g, n) in enumerate(KINDS)))))
    df = df.withColumn("_candidates", _spans(text, MARKOV, len(KINDS), CANDIDATE, 0, 20))

    def random_looking(s: Column) -> Column:
        ratio = _ratio(F.substring(text, s["start"] + 1, s["end"] - s["start"]), ratios)
        clear = ~F.exists("base_spans", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
        return clear & F.transform(F.array(ratio), lambda r: (r >= LEAST_RATIO) & (r >= LEAST_PER_PAIR * (s["end"] - s["start"] - 1)))[0]

    more = F.when(F.size("_candidates") > 0, F.filter("_candidates", random_looking)).otherwise(F.array().cast(_SPAN))
    return df.withColumn("all_spans", F.sort_array(F.concat("base_spans", more))).select(*kept, sealed("base_spans", "all_spans")).select(*kept, "_made.*")


def listed(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with every span, overlapping ones joined, replaced by `mark`."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, s: Column) -> Column:
        lead = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        fresh = s["start"] >= acc["at"]
        parts = F.when(fresh, F.concat(acc["parts"], F.array(lead, F.lit(mark)))).otherwise(acc["parts"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), parts.alias("parts"))

    return F.aggregate(spans, start, step, lambda a: F.concat(F.array_join(a["parts"], ""), F.substring(text, a["at"] + 1, F.length(text))))
