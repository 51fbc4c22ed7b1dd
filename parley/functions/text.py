"""Text functions over columns."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fold_ascii(text: Column) -> Column:
    """Lower case of A-Z alone, as embedded databases compare."""
    return F.translate(text, UPPER, LOWER)


def contains_ascii(text: Column, query: str) -> Column:
    """Substring search that ignores the case of A-Z; metacharacters have no meaning."""
    return fold_ascii(text).contains(query.translate(str.maketrans(UPPER, LOWER)))


def squeezed(text: Column) -> Column:
    """Lower case, one blank between words, none around."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _unmarked() -> tuple[str, str]:
    """Lower-case Latin letters with marks and the letters they stand on, then the combining marks, which stand on none."""
    codes = [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]
    letters = [(c, unicodedata.normalize("NFD", c)[0]) for c in map(chr, codes) if c == c.lower()]
    letters = [(c, base) for c, base in letters if c != base and base.isascii() and base.isalpha()]
    return "".join(c for c, _ in letters) + "".join(map(chr, range(0x300, 0x370))), "".join(b for _, b in letters)


MARKED, UNMARKED = _unmarked()


def folded(text: Column) -> Column:
    """Lower case without the marks of Latin letters and without combining marks; letters of other scripts (й, ё) stay."""
    low = F.lower(text)
    return F.when(low.rlike(r"[^\x00-\x7F]"), F.translate(low, MARKED, UNMARKED)).otherwise(low)


def folded_words(text: Column) -> Column:
    """The words under which a text is found: folded runs of letters and digits."""
    return F.filter(F.split(folded(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def token_estimate(text: Column) -> Column:
    """A quarter of the UTF-8 bytes, rounded down."""
    return F.floor(F.octet_length(text) / 4).cast("long")


def similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer length; 1 for two empty texts."""
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct words; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def shortened(text: Column, limit: int) -> Column:
    """At most limit characters, the last of a longer text being an ellipsis after trimmed text."""
    return F.when(F.char_length(text) <= limit, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, limit - 1)), F.lit("…")))


def initials(name: Column) -> Column:
    """First letters of the first two words in upper case, a dot if there are none."""
    parts = F.filter(F.split(F.trim(name), r"\s+"), lambda w: w != "")
    made = F.array_join(F.transform(F.slice(parts, 1, 2), lambda w: F.upper(F.substring(w, 1, 1))), "")
    return F.when(made == "", "·").otherwise(made)


def stable_hash(text: Column) -> Column:
    """h = 31 h + code over the characters, in 32 bits; its absolute value modulo 1000."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    wrap = lambda h: F.pmod(h + (1 << 31), F.lit(1 << 32)) - (1 << 31)
    return F.abs(F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: wrap(h * 31 + c))) % 1000


def bounded_bytes(text: Column, limit: int) -> Column:
    """The longest prefix of at most limit UTF-8 bytes that ends between characters."""
    sizes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.octet_length(c))
    state = F.aggregate(
        sizes,
        F.struct(F.lit(0).alias("bytes"), F.lit(0).alias("chars"), F.lit(True).alias("open")),
        lambda s, n: F.when(s["open"] & (s["bytes"] + n <= limit), F.struct((s["bytes"] + n).alias("bytes"), (s["chars"] + 1).alias("chars"), F.lit(True).alias("open"))).otherwise(F.struct(s["bytes"].alias("bytes"), s["chars"].alias("chars"), F.lit(False).alias("open"))),
    )
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.substring(text, F.lit(1), state["chars"]))


def neutral_markers(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<<<"), F.lit("‹‹‹")), F.lit(">>>"), F.lit("›››"))


def without_list_marker(text: Column) -> Column:
    """Trimmed text without leading list markers; null if nothing is left."""
    rest = F.trim(F.regexp_replace(F.trim(text), r"^[-–—•*]+\s*", ""))
    return F.when(rest != "", rest)


def one_of(value: Column, cases: list[tuple[str, str]], otherwise: str) -> Column:
    """The label of the first needle that value contains."""
    return reduce(lambda out, case: F.when(value.contains(case[0]), case[1]).otherwise(out), reversed(cases), F.lit(otherwise))
