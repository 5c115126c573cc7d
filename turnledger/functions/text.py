"""Text columns: Unicode trim, NFKC, tokens, token estimates, regex summaries."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The whitespace set stripped by a Unicode-aware trim.
_WS = r"[\t\n\x0B\f\r\p{Zs}\x{2028}\x{2029}\x{FEFF}]"
_TRIM = f"^{_WS}+|{_WS}+$"

# Every character in this class is its own NFKC form and none of them combines with
# a neighbour, so text made only of them is left alone. Other text goes to Python.
_ASCII = r"\x{0000}-\x{007F}"
_STABLE_LETTERS = (
    r"\x{00C0}-\x{0131}\x{0134}-\x{013E}\x{0141}-\x{0148}\x{014A}-\x{017E}"  # Latin letters
    r"\x{0400}-\x{0482}\x{048A}-\x{04FF}"  # Cyrillic
    r"\x{2013}\x{2014}\x{2018}\x{2019}\x{201C}\x{201D}"  # dashes, quotes
    r"\x{3001}\x{3002}\x{300A}-\x{3011}"  # CJK punctuation
    r"\x{3041}-\x{3096}\x{30A1}-\x{30FA}"  # kana
    r"\x{4E00}-\x{9FFF}"  # unified ideographs
    r"\x{AC00}-\x{D7A3}"  # Hangul syllables
)
NFKC_STABLE = _ASCII + _STABLE_LETTERS
# The same class negated; ASCII is ruled out first, before the many ranges are tried.
_UNSTABLE = f"[[^{_ASCII}]&&[^{_STABLE_LETTERS}]]"


def trim_ws(col: Column) -> Column:
    return F.regexp_replace(col, _TRIM, "")


def non_blank(col: Column) -> Column:
    """The trimmed text, or null when nothing is left."""
    return F.nullif(trim_ws(col), F.lit(""))


@F.pandas_udf(StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


def nfkc(col: Column) -> Column:
    """NFKC form. Only text outside the stable class crosses into Python."""
    unstable = F.when(col.rlike(_UNSTABLE), col)
    return F.coalesce(_nfkc(unstable), col)


def tokenize(col: Column, normalize: bool = True) -> Column:
    """Search tokens: words, and for runs of Han characters single and double characters."""
    text = F.lower(nfkc(col) if normalize else col)
    runs = F.regexp_extract_all(text, F.lit(r"\p{IsHan}+|[\p{L}\p{N}]+"), 0)

    def expand(run: Column) -> Column:
        chars = F.regexp_extract_all(run, F.lit(r"\p{IsHan}"), 0)
        pairs = F.when(
            F.size(chars) > 1,
            F.zip_with(
                F.slice(chars, 1, F.size(chars) - 1),
                F.slice(chars, 2, F.size(chars) - 1),
                lambda a, b: F.concat(a, b),
            ),
        ).otherwise(F.array().cast("array<string>"))
        return F.when(run.rlike(r"^\p{IsHan}"), F.concat(chars, pairs)).otherwise(F.array(run))

    # Without Han characters the words are the runs, and no script is looked up at every place.
    words = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+"), 0)
    return F.when(text.rlike(r"\p{IsHan}"), F.flatten(F.transform(runs, expand))).otherwise(words)


def cjk_count(col: Column) -> Column:
    """Code points of the scripts that cost one token each."""
    return F.length(
        F.regexp_replace(col, r"[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]", "")
    )


def tokens_from_counts(cjk: Column, other: Column) -> Column:
    """Token estimate of a text given its two character counts."""
    return F.when((cjk + other) == 0, F.lit(0)).otherwise(
        F.greatest(F.lit(1), cjk + F.ceil(other / F.lit(4)).cast("int"))
    )


def estimate_tokens(col: Column) -> Column:
    cjk = cjk_count(col)
    return F.when(col.isNull(), F.lit(0)).otherwise(tokens_from_counts(cjk, F.length(col) - cjk))


def usable_pattern(pattern: str) -> int | None:
    """Number of groups in a pattern, or None when it is blank or does not compile.

    The dialect is that of the engine that will run it.
    """
    if not pattern.strip():
        return None
    jvm = SparkSession.active()._jvm
    try:
        return jvm.java.util.regex.Pattern.compile("(?ms)" + pattern).matcher("").groupCount()
    except IllegalArgumentException:
        return None


def regex_summary(content: Column, pattern: str) -> Column:
    """First non-blank group of the first match, else the whole match; null if none."""
    groups = usable_pattern(pattern)
    if groups is None:
        return F.lit(None).cast("string")
    flagged = "(?ms)" + pattern
    parts = [F.regexp_extract(content, flagged, g) for g in range(1, groups + 1)]
    whole = F.regexp_extract(content, flagged, 0)
    return F.when(content.rlike(flagged), F.coalesce(*[non_blank(p) for p in [*parts, whole]]))
