"""Relations and constants of the engine."""

from __future__ import annotations

from pyspark.sql import types as T

# The matching parameters whose results must be reproducible.
MIN_SHARED_TERMS = 20  # absolute floor of shared terms of a candidate pair
MIN_SHARED_FRACTION = 0.10  # containment floor against the smaller term set
TERM_DF_CAP = 2000  # terms in more items than this do not count as shared
SIMILARITY_THRESHOLD = 0.85  # accepted similarity of two fingerprints
MAX_OFFSET = 20  # frames searched in either direction
CONFIDENT_DELTA_S = 5.0  # largest duration difference of a "high" group
MTIME_TOLERANCE_S = 1.0  # a cached row is fresh below this difference
TAG_AGREEMENT = 0.5  # tag score from which tags are said to agree
MIN_SIZE_KB = 100  # smallest file that a scan keeps by default
AUDIO_SUFFIXES = ("aac", "flac", "m4a", "mp3", "ogg", "opus")

TAGS = T.StructType([T.StructField(n, T.StringType()) for n in ("title", "artist", "album", "tracknumber")])

ITEM = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("duration", T.DoubleType()),
        T.StructField("bitrate", T.IntegerType()),
        T.StructField("tags", TAGS),
        T.StructField("fingerprint", T.ArrayType(T.IntegerType())),
        T.StructField("scan_ord", T.LongType()),
    ]
)

CACHE = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("mtime", T.DoubleType()),
        T.StructField("duration", T.DoubleType()),
        T.StructField("fingerprint", T.ArrayType(T.IntegerType())),
    ]
)

REPORT = T.StructType(
    [
        T.StructField("tier", T.StringType()),
        T.StructField("confidence", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("tag_score", T.DoubleType()),
        T.StructField("files", T.ArrayType(T.StringType())),
        T.StructField("keep", T.StringType()),
    ]
)
