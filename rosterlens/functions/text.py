"""Text folding, token rules and similarity."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters that do not decompose into a plain letter and a mark.
SPECIAL_LETTERS = {
    "ø": "o", "đ": "d", "ł": "l", "ß": "ss", "æ": "ae", "œ": "oe", "ð": "d", "þ": "th", "ı": "i",
}
# Words left out of club names.
CLUB_STOP_WORDS = [
    "fc", "cf", "afc", "ac", "sc", "as", "us", "ss", "ssc", "ud", "cd", "sd", "rc", "rcd", "sv",
    "fk", "calcio", "spa", "sad", "club", "de",
]
# Position-name rules in the order tried; each is (group, test, text).
POSITION_RULES = [
    ("GK", "equals", "Goalkeeper"),
    ("CB", "contains", "Center Back"),
    ("FB", "contains", "Back"),
    ("MID", "contains", "Defensive Midfield"),
    ("MID", "contains", "Center Midfield"),
    ("WIDE", "contains", "Wing"),
    ("WIDE", "contains", "Attacking Midfield"),
    ("WIDE", "equals", "Left Midfield"),
    ("WIDE", "equals", "Right Midfield"),
    ("FWD", "contains", "Forward"),
    ("FWD", "contains", "Striker"),
]
# Groups of the second provider's position names.
POSITION_GROUPS = {
    "Goalkeeper": "GK", "Centre-Back": "CB", "Left-Back": "FB", "Right-Back": "FB",
    "Defensive Midfield": "MID", "Central Midfield": "MID", "Attacking Midfield": "WIDE",
    "Left Midfield": "WIDE", "Right Midfield": "WIDE", "Left Winger": "WIDE",
    "Right Winger": "WIDE", "Second Striker": "FWD", "Centre-Forward": "FWD",
}


_MARKS = re.compile("[" + "".join(chr(c) for c in range(0x300, 0x20000) if unicodedata.combining(chr(c))) + "]+")


_LETTERS = str.maketrans(SPECIAL_LETTERS)


@F.pandas_udf(T.StringType())
def _decompose(s: pd.Series) -> pd.Series:
    """Special letters written plainly, then compatibility decomposition without combining marks; null stays null."""
    return s.map(lambda x: _MARKS.sub("", unicodedata.normalize("NFKD", x.translate(_LETTERS))), na_action="ignore")


def fold(text: Column) -> Column:
    """Lower-case ASCII words separated by single spaces; null becomes empty.

    Rows in plain ASCII stay in the JVM; of the others each is sent to Python once.
    """
    low = F.lower(text)
    t = F.coalesce(_decompose(F.when(text.rlike("[^\\x00-\\x7F]"), low)), low)
    return F.coalesce(F.trim(F.regexp_replace(t, "[^a-z0-9]+", " ")), F.lit(""))


def words(folded: Column) -> Column:
    return F.filter(F.split(folded, " "), lambda w: w != "")


def fold_club(text: Column, stop: Sequence[str] = tuple(CLUB_STOP_WORDS)) -> Column:
    kept = F.filter(words(fold(text)), lambda w: ~w.isin(*stop))
    return F.array_join(kept, " ")


def tokens_contained(name: Column, others: Sequence[Column], least: int = 1) -> Column:
    """Whether every token of a folded name is among the tokens of the other folded names."""
    own = F.array_distinct(words(name))
    pool = words(F.concat_ws(" ", *others))
    return (F.size(own) >= least) & (F.size(F.array_except(own, pool)) == 0)


def position_group(name: Column) -> Column:
    out = None
    for group, test, text in POSITION_RULES:
        hit = (name == text) if test == "equals" else name.contains(text)
        out = F.when(hit, group) if out is None else out.when(hit, group)
    return out


def mapped_position(name: Column) -> Column:
    """The second provider's group, null for a name outside its list."""
    return F.element_at(F.create_map(*[F.lit(x) for p in POSITION_GROUPS.items() for x in p]), name)


def edit_similarity(a: Column, b: Column) -> Column:
    """1 less the edits from one text to the other over the longer length, 0 when either is empty."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when((a != "") & (b != ""), 1 - F.levenshtein(a, b) / longer).otherwise(F.lit(0.0))


def grams(text: Column, size: int = 2) -> Column:
    """The runs of `size` characters of a text, the second of two equal ones told from the first, and so on."""
    at = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - size + 1)).otherwise(F.array().cast("array<int>"))
    runs = F.transform(at, lambda i: F.substring(text, i, size))
    return F.transform(runs, lambda g, i: F.concat(g, F.size(F.filter(F.slice(runs, F.lit(1), i), lambda x: x == g)).cast("string")))


@F.pandas_udf(T.StringType())
def unescape(s: pd.Series) -> pd.Series:
    """Literal backslash-u escapes in a name become their characters."""
    pattern = re.compile(r"\\u([0-9a-fA-F]{4})")

    def one(x):
        joined = pattern.sub(lambda m: chr(int(m.group(1), 16)), x)
        return joined.encode("utf-16", "surrogatepass").decode("utf-16", "replace")

    return s.map(one, na_action="ignore")


def search(rows: DataFrame, text: str, names: Sequence[str], label: str, limit: int = 10) -> DataFrame:
    """Rows one of whose names holds the text after folding both, in alphabetical order."""
    wanted = fold(F.lit(text))
    hit = F.lit(False)
    for n in names:
        hit = hit | F.contains(fold(F.col(n)), wanted)
    return rows.filter((wanted != "") & hit).orderBy(fold(F.col(label)), label).limit(limit)
