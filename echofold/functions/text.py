"""Normalisation and fuzzy comparison of titles, artists and file names."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Patterns of the noise in names. Classes are spelled out, as Java's \w is ASCII only.
NOT_WORD = r"[^\p{L}\p{N}_\s]"
FEATURING = r"(?iud)\s+(feat\.?|ft\.?|featuring)\s+.*$"
TRACK_PREFIX = r"^\d{1,3}[\s.\-_]+"
TRAILING_COPY = r"(?i)[\s_\-]+(\(\d+\)|\[\d+\]|copy|duplicate|\d+)$"
SUFFIX = r"^(.+)\.[^.]+$"
BLANK_ENDS = r"^\s+|\s+$"


def strip(s: Column) -> Column:
    """Without white space of any kind at both ends (trim() takes only spaces)."""
    return F.regexp_replace(s, BLANK_ENDS, "")


def normalize(s: Column) -> Column:
    """Lower case, without punctuation, white space collapsed; null becomes ''."""
    kept = F.regexp_replace(F.lower(F.coalesce(s, F.lit(""))), NOT_WORD, "")
    return strip(F.regexp_replace(kept, r"\s+", " "))


def normalize_artist(s: Column) -> Column:
    """As normalize(), without a guest credit ("feat. X") at the end."""
    return normalize(F.regexp_replace(F.coalesce(s, F.lit("")), FEATURING, ""))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def normalize_stem(path: Column) -> Column:
    """File name without suffix, track number and one copy mark, lower case; null becomes ''."""
    stem = F.regexp_replace(file_name(F.coalesce(path, F.lit(""))), SUFFIX, "$1")
    bare = F.regexp_replace(F.regexp_replace(stem, TRACK_PREFIX, ""), TRAILING_COPY, "")
    return strip(F.lower(bare))


def tag_key(title: Column, artist: Column) -> Column:
    """'title artist', normalised; null if either is blank."""
    t, a = normalize(title), normalize_artist(artist)
    return F.when((t != "") & (a != ""), F.concat_ws(" ", t, a))


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel: one machine step per character of ``b``."""
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & masks.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def token_sort_ratio_py(a: str, b: str) -> float:
    """100 x the normalised insertion/deletion similarity of the sorted tokens; two empty texts give 100."""
    x, y = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
    total = len(x) + len(y)
    return 100.0 if not total else 200.0 * lcs_length(x, y) / total


@F.pandas_udf(DoubleType())
def token_sort_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """token_sort_ratio_py over Arrow batches; null if either side is null."""
    return pd.Series([None if x is None or y is None else token_sort_ratio_py(x, y) for x, y in zip(a, b)], dtype="float64")


def identity_score(path_a: Column, key_a: Column, path_b: Column, key_b: Column) -> Column:
    """0 to 100: the better of the file-name and, where both exist, the tag-key ratio."""
    return F.greatest(token_sort_ratio(normalize_stem(path_a), normalize_stem(path_b)), token_sort_ratio(key_a, key_b))


def format_size(n: Column) -> Column:
    return F.when(n >= 1 << 20, F.format_string("%.1f MB", n / float(1 << 20))).otherwise(F.format_string("%.0f KB", n / 1024.0))


def format_duration(seconds: Column) -> Column:
    """m:ss, truncated; null counts as 0."""
    s = F.floor(F.coalesce(seconds, F.lit(0.0))).cast("bigint")
    return F.concat(F.floor(s / 60).cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))
