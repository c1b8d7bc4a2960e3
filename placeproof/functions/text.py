"""Text column functions.  Everything is a JVM expression except the optional NFKC fold."""
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placeproof import policy

# Abbreviation patterns, applied in this order after lower-casing.
ABBREVIATIONS = [
    (r"\brd\b", "road"), (r"\bst\b", "street"), (r"\bngr\b", "nagar"), (r"\bblk\b", "block"),
    (r"\bh\.?\s?no\.?\b", "house"), (r"\bno\.\b", "number"), (r"\bgal\b", "gali"),
    (r"\bopp\.?\b", "opposite"), (r"\bnr\b", "near"), (r"\bflr\b", "floor"),
    (r"\bsoc\b", "society"), (r"\bapt\b", "apartment"), (r"\bxtn\b", "extension"),
    (r"\bext\b", "extension"),
]
# Kept characters, token classes, numeric slots of streets and houses.
KEEP = r"[^0-9a-z\x{0900}-\x{097F}\x{0C80}-\x{0CFF}]+"
TOKEN = r"[0-9A-Za-z\x{0C80}-\x{0CFF}]+"
TOKEN_WITH_DEVANAGARI = r"[0-9A-Za-z\x{0900}-\x{097F}\x{0C80}-\x{0CFF}]+"
STREET_SLOT = r"(?i)\b(\d{1,4})\s*(?:st|nd|rd|th)?\s*(cross|main|block|gali|lane|ward|sector)\b"
HOUSE_SLOT = r"(?i)\b(?:no\.?|number|h\.?\s?no\.?|house|plot|door|d\.?no|flat)\s*\.?\s*(\d{1,4})"


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode compatibility fold; the one place Python is needed for text."""
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def norm_text(text: Column, fold: bool = False) -> Column:
    """Canonical normal form.  Set `fold` for sources that are not already NFKC."""
    out = F.lower(nfkc(text) if fold else text)
    for pattern, word in ABBREVIATIONS:
        out = F.regexp_replace(out, pattern, word)
    return F.trim(F.regexp_replace(out, KEEP, " "))


def norm_raw(text: Column) -> Column:
    """Ring B1: lower-case only."""
    return F.lower(text)


def norm_scope(text: Column) -> Column:
    """Audit normal form: drops a trailing pin tail, keeps Latin and Indic blocks."""
    out = F.regexp_replace(F.lower(text), r"\s*-\s*\d{6}\s*$", "")
    return F.trim(F.regexp_replace(out, r"[^0-9a-z\x{0900}-\x{0D7F}]+", " "))


def tokens(norm: Column, devanagari: bool = False) -> Column:
    """Tokens of a normal form.  Devanagari is skipped by default, as the published rule does."""
    return F.regexp_extract_all(norm, F.lit(TOKEN_WITH_DEVANAGARI if devanagari else TOKEN),
                                F.lit(0))


def pin_in_text(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"\b(\d{6})\b", 1), F.lit(""))


_RELATION = (r"((?: \S+){0,3}?) (" + "|".join(policy.RELATION_WORDS)
             + r")(?= |$)((?: \S+){0,3})")


def relation_window(toks: Column) -> Column:
    """First relation phrase: struct(rel, before[<=3], after[<=3]); null without one.

    One bounded, lazy pattern over the joined tokens: the leftmost match with the fewest leading
    tokens is the first phrase, and the alternation order is the vocabulary order.
    """
    line = F.concat(F.lit(" "), F.array_join(toks, " "))

    def part(i):
        return F.regexp_extract(line, _RELATION, i)

    def words(i):
        return F.regexp_extract_all(part(i), F.lit(r"\S+"), F.lit(0))

    return F.when(part(2) != "", F.struct(part(2).alias("rel"), words(1).alias("before"),
                                          words(3).alias("after")))


def raw_relation_window(text: Column, width: int = 3) -> Column:
    """Ring B1: the first vocabulary entry occurring anywhere in the lower-cased text."""
    low = F.lower(text)
    rel = F.coalesce(*[F.when(F.contains(low, F.lit(w)), F.lit(w)) for w in policy.RELATION_WORDS])
    pos = F.instr(low, rel)
    before = F.regexp_extract_all(F.substring(low, F.lit(1), pos - 1), F.lit(TOKEN), F.lit(0))
    after = F.regexp_extract_all(F.substring(low, pos + F.length(rel), F.length(low)),
                                 F.lit(TOKEN), F.lit(0))
    return F.when(rel.isNotNull(), F.struct(
        rel.alias("rel"), F.slice(F.reverse(F.slice(F.reverse(before), 1, width)), 1, width)
        .alias("before"), F.slice(after, 1, width).alias("after")))


def edit_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0)).otherwise(
        1.0 - F.levenshtein(a, b) / longest)


def set_jaccard(a: Column, b: Column) -> Column:
    inter = F.size(F.array_intersect(a, b))
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(inter / union)


def char_ngrams(s: Column, n: int = 3) -> Column:
    """Distinct character n-grams with spaces removed (empty when too short)."""
    return flat_ngrams(F.replace(s, F.lit(" "), F.lit("")), n)


def flat_ngrams(flat: Column, n: int = 3) -> Column:
    """Distinct character n-grams of a text without spaces (empty when too short)."""
    return F.when(F.length(flat) < n, F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(flat) - (n - 1)),
                                     lambda i: F.substring(flat, i, F.lit(n)))))


def padded_ngrams(s: Column, n: int = 4) -> Column:
    """n-grams (with repeats) of `^text$`, spaces written as underscores."""
    flat = F.concat(F.lit("^"), F.replace(s, F.lit(" "), F.lit("_")), F.lit("$"))
    return F.when(F.length(flat) < n, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.length(flat) - (n - 1)),
                    lambda i: F.substring(flat, i, F.lit(n))))


def numeric_slots(text: Column) -> Column:
    """Slots such as `cross12` and `house7`."""
    return F.concat(
        F.transform(
            F.arrays_zip(F.regexp_extract_all(text, F.lit(STREET_SLOT), F.lit(2)).alias("w"),
                         F.regexp_extract_all(text, F.lit(STREET_SLOT), F.lit(1)).alias("n")),
            lambda s: F.concat(F.lower(s["w"]), s["n"])),
        F.transform(F.regexp_extract_all(text, F.lit(HOUSE_SLOT), F.lit(1)),
                    lambda n: F.concat(F.lit("house"), n)))


def script_class(text: Column) -> Column:
    return (F.when(text.rlike(r"[\x{0C80}-\x{0CFF}]"), "kannada")
            .when(text.rlike(r"[\x{0900}-\x{097F}]"), "devanagari").otherwise("latin"))
