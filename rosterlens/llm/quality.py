"""Quality rules: counts of a text, and its divergence from its language's usual characters and common words.

A text's shares of character classes and of its language's commonest words are compared with those of
all texts of that language by Jensen-Shannon distance. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from .common import WORD, sealed

COMMON = 40
#: Character classes, in the order in which they are taken out of a text; what is left is the last class.
CLASSES = (("lower", "[a-z]+"), ("white", r"[\x20\x09-\x0D]+"), ("upper", "[A-Z]+"), ("digit", "[0-9]+"), ("mark", r"[.,;:!?'\"()-]+"), ("symbol", "[#*$%&|<>]+"))
WHITE = " \t\n\x0b\x0c\r"
#: Distances (square roots of divergences in bits, 0 to 1) above which a text is rejected, and the words it must have to be judged.
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE, LEAST_CHARS, LEAST_WORDS = 0.30, 0.45, 200, 80


def _replaced_each(text: Column, characters: str, by: str) -> Column:
    """`text` with each of the characters replaced; plain replacements cost far less than a pattern."""
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(by))
    return text


def _class_counts(df: DataFrame) -> DataFrame:
    """Adds `classes`, the number of characters of each class; each step reads only what the one before has left.
    White space goes first, so that the next pattern meets runs of many words."""
    df = df.withColumn("_r", _replaced_each(F.col("_text"), WHITE, ""))
    rest, counts = "_r", {"white": F.length("_text") - F.length("_r")}
    for k, (name, pattern) in enumerate(CLASSES):
        if name != "white":
            df = df.withColumn(f"_r{k}", F.regexp_replace(rest, pattern, ""))
            counts[name] = F.length(rest) - F.length(f"_r{k}")
            rest = f"_r{k}"
    return df.withColumn("classes", F.array(*(counts[name] for name, _ in CLASSES), F.length(rest))).drop("_r", *(f"_r{k}" for k in range(len(CLASSES))))


def _words(text: Column) -> Column:
    """The words by WORD."""
    return F.array_remove(F.split(_replaced_each(text, WHITE[1:], " "), " ", -1), "")


def references(docs: DataFrame, common: int = COMMON) -> dict[str, tuple[list[float], list[tuple[str, float]]]]:
    """Per language, from all its texts: share of each character class, and its `common` commonest words with their shares.

    Collects one row per language and its `common` words; texts or languages that are null teach nothing.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", F.col("text").alias("_text"))
    classes = {r["lang"]: [float(r[f"c{k}"]) for k in range(len(CLASSES) + 1)] for r in _class_counts(known).groupBy("lang").agg(
        *(F.sum(F.col("classes")[k]).alias(f"c{k}") for k in range(len(CLASSES) + 1))).collect()}
    counts = checkpointed(known.select("lang", F.explode(_words(F.lower("_text"))).alias("w")).groupBy("lang", "w").count())
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("count").alias("n")).collect()}
    # one sorted list of at most `common` a task and language, then of those
    best = counts.selectExpr("lang", "w", "count", "row_number() over (partition by lang order by count desc, w) as place").where(F.col("place") <= common).collect()
    words: dict[str, list[tuple[str, float]]] = {}
    for r in sorted(best, key=lambda r: (r["lang"], r["place"])):
        words.setdefault(r["lang"], []).append((r["w"], r["count"] / totals[r["lang"]]))
    return {name: ([c / sum(n) for c in n], words.get(name, [])) for name, n in classes.items() if sum(n)}


def _part(p: Column, q: Column) -> Column:
    """One outcome's part of the Jensen-Shannon divergence of shares p and q, in bits."""
    mid = (p + q) / 2
    return F.when(p > 0, p / 2 * F.log2(p / mid)).otherwise(0.0) + F.when(q > 0, q / 2 * F.log2(q / mid)).otherwise(0.0)


_PLACE_BITS = 22


def _repeat_words(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words: words in three-word windows that the text holds twice or more.

    A first sort of plain numbers, the upper bits of a window's 64-bit hash above its place, finds the
    windows that may repeat; they alone are then compared by their whole hashes. Every array is a column
    of its own, so that no step computes another's again for each element. Most texts have no window twice, and
    are done when their hashes are counted.
    """
    df = df.withColumn("_n", F.greatest(F.size("_words") - 2, F.lit(0)))
    df = df.withColumn("_windows", F.transform(F.slice("_words", F.lit(1), F.col("_n")), lambda w, i: F.xxhash64(w, F.col("_words")[i + 1], F.col("_words")[i + 2])))
    df = df.withColumn("_n", F.when(F.size(F.array_distinct("_windows")) < F.col("_n"), F.col("_n")))
    low = (1 << _PLACE_BITS) - 1
    df = df.withColumn("_packed", F.when(F.col("_n") <= low, F.sort_array(F.transform("_windows", lambda h, i: F.shiftleft(h, _PLACE_BITS).bitwiseOR(i.cast("long"))))))
    same = lambda x, at: F.shiftright(x, _PLACE_BITS) == F.shiftright(F.get(F.col("_packed"), at), _PLACE_BITS)
    df = df.withColumn("_maybe", F.filter("_packed", lambda x, i: F.coalesce(same(x, i + 1), F.lit(False)) | F.coalesce(same(x, i - 1), F.lit(False))))
    # a text of more words than places have bits for is compared by whole hashes alone
    places = F.when(F.col("_n") <= low, F.transform("_maybe", lambda x: x.bitwiseAND(F.lit(low).cast("long")).cast("int"))).when(F.col("_n") > low, F.sequence(F.lit(0), F.col("_n") - 1))
    df = df.withColumn("_sorted", F.sort_array(F.transform(places, lambda i: F.struct(F.col("_windows")[i].alias("h"), i.alias("i")))))
    whole = lambda x, at: F.coalesce(x["h"] == F.get(F.col("_sorted"), at)["h"], F.lit(False))
    df = df.withColumn("_places", F.sort_array(F.transform(F.filter("_sorted", lambda x, i: whole(x, i + 1) | whole(x, i - 1)), lambda x: x["i"])))
    covered = F.aggregate("_places", F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")), lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")))["n"]
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_n", "_windows", "_packed", "_maybe", "_sorted", "_places")


def measured(docs: DataFrame, refs: dict) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, char_distance, word_distance and kept.

    A null text has no words and fails; texts shorter than LEAST_CHARS characters or LEAST_WORDS words are
    not judged by that distance, nor are texts whose language is null or has no reference. Other columns
    and repeated rows stay; columns of these names are replaced.
    """
    added = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", "kept")
    kept = [c for c in docs.columns if c not in added]
    df = _class_counts(docs.select(*kept, F.coalesce("text", F.lit("")).alias("_text"))).withColumn("_words", _words(F.col("_text")))
    df = df.withColumn("_lines", F.filter(F.split("_text", "\n", -1), lambda x: x.rlike(WORD))).withColumn("n_words", F.size("_words").cast("long"))
    df = df.withColumns({
        "word_chars": (F.length("_text") - F.col("classes")[1]).cast("long"), "n_symbols": F.col("classes")[5].cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")}).drop("_lines")
    df = _repeat_words(df).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    if not refs:
        return df.withColumns({"char_distance": F.lit(None).cast("double"), "word_distance": F.lit(None).cast("double"), "kept": ~F.col("base_failed")}).select(*kept, sealed(*added)).select(*kept, "_made.*")
    chars = F.create_map(*(x for name, (shares, _) in refs.items() for x in (F.lit(name), F.array(*map(F.lit, shares)))))
    words = F.create_map(*(x for name, (_, best) in refs.items() for x in (F.lit(name), F.array(*(F.struct(F.lit(f" {w} ").alias("w"), F.lit(q).alias("q")) for w, q in best)))))
    every = sorted({w for _, best in refs.values() for w, _ in best})
    df = df.withColumn("_total", F.length("_text").cast("double"))
    total = F.col("_total")
    # common words, written small, with a capital or in capitals, in one string, each between spaces of its own:
    # a count is a difference of lengths
    written = sorted({form for w in every for form in (w, w[:1].upper() + w[1:], w.upper())})
    common = F.filter("_words", lambda w: w.isin(written)) if every else F.array().cast("array<string>")
    df = df.withColumns({"_chars": chars[F.col("lang")], "_ref": words[F.col("lang")], "_common": F.lower(F.concat(F.lit(" "), F.array_join(common, "  "), F.lit(" ")))})
    length = F.octet_length("_common")
    # shares in a column of their own: within one expression a lambda would count a word anew wherever its share is named
    df = df.withColumn("_shares", F.when(F.col("n_words") >= LEAST_WORDS, F.transform("_ref", lambda r: (length - F.octet_length(F.replace(F.col("_common"), r["w"], F.lit("")))) / F.octet_length(r["w"]) / F.col("n_words"))))
    zero = F.lit(0.0)
    summed = lambda values: F.aggregate(values, zero, lambda a, x: a + x)
    df = df.withColumn("_others", F.greatest(1 - summed(F.col("_shares")), zero))
    divergence = summed(F.zip_with("_shares", "_ref", lambda p, r: _part(p, r["q"]))) + _part(F.col("_others"), F.greatest(1 - summed(F.transform("_ref", lambda r: r["q"])), zero))
    df = df.withColumns({
        "char_distance": F.when((total >= LEAST_CHARS) & F.col("_chars").isNotNull(), F.sqrt(F.greatest(zero, F.aggregate(F.zip_with("classes", "_chars", lambda n, q: _part(n / total, q)), zero, lambda a, x: a + x)))),
        "word_distance": F.when((F.col("n_words") >= LEAST_WORDS) & F.col("_ref").isNotNull(), F.sqrt(F.greatest(zero, divergence)))})
    verdict = ~F.col("base_failed") & (F.coalesce("char_distance", zero) <= MAX_CHAR_DISTANCE) & (F.coalesce("word_distance", zero) <= MAX_WORD_DISTANCE)
    return df.withColumn("kept", verdict).select(*kept, sealed(*added)).select(*kept, "_made.*")
