import itertools
import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from echofold.llm import names

FILES = "path string, tags struct<title:string,artist:string>"
ARTISTS = [
    ["Andrew Brodralewell", "andrew brodralewell", "Brodralewell, Andrew", "Andy Brodralewell", "A. Brodralewell", "Andrew_Brodralewell", "Andrew  Brodralewéll", "Dr. Andrew Brodralewell", "Andrew K. Brodralewell", "Andrew Brodralewrll", "Brodralewell Andrew"],
    ["Florence Brodralewell", "Flo Brodralewell", "Brodralewell, F."],
    ["Elizabeth Quazapiph", "Betty Kwazapif", "Lizabeth Quazapiph"],
    ["The Kesubrilm Orchestra", "Kesubrilm Orch.", "Orchestra Kesubrilm", "KESUBRILM ORCHESTRA", "Kesubrlim Orchestra"],
    ["Kesubrilm Brothers", "Kesubrilm Bros", "The Kesubrilm Bros."],
    ["Zozelulow Sound System", "Zozelulow Soundsystem", "Zozelulow Snd. System"],
    ["Quipibusten Quartet", "The Quipibusten 4tet"],
    ["Kekedritz Quartet", "The Kekedrits 4tet"],
    ["Gerald Thateralm"],
    ["Jeremiah Thateralm"],
    ["Jerry Thateralm"],  # may be either
    ["!!!"],
]


@pytest.mark.parametrize(
    "name,want",
    [
        ("Skufiziwell, Nicholas", ("person", "nicholas")), ("Mr Ulrich Kopigumar", ("person", "ulrich")), ("B Quogudroshwa", ("person", "b")), ("Kafathuwell Andrew", ("person", "andrew")),
        ("Imoegn Medasirby", ("person", "imogen")), ("The Mothodogart Chamber Choir", ("band", "chamber+choir")), ("Rekenoph Chamber Chr.", ("band", "chamber+choir")), ("Theskulolm Ensemble, The", ("band", "ensemble")),
    ],
)
def test_parse(name, want):
    kind, _, given = names.parse(name)
    assert (kind, given) == want


def test_parse_of_odd_names():
    assert names.parse("!!!") is None and names.parse("") is None
    assert names.parse("Madonna") == ("person", names.sound("madonna"), "")
    assert names.parse("X" * 5000)[0] == "person"


def test_near():
    assert [names.near(a, b) for a, b in (("ab", "ba"), ("abc", "abc"), ("abc", "abd"), ("abcd", "badc"), ("a", "abcd"), ("kitten", "sitting"))] == [1, 0, 1, 2, 3, 3]


def test_long_names():
    a, b = "abcdefghij" * 3000, "abcdefghij" * 2999 + "abcdefghiq"
    assert names.near(a, b) == 1 and names.near(a, b[::-1]) == 3
    keys = names.block_keys("person", [a], ["ann"])
    assert sum(map(len, keys)) < 2 * len(a) and keys & names.block_keys("person", [b], ["ann"])


def osa(a, b):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


@settings(max_examples=500, deadline=None)
@given(st.text("abc", max_size=9), st.text("abc", max_size=9))
def test_near_is_the_edit_distance(a, b):
    assert names.near(a, b) == min(3, osa(a, b))


def test_variants(spark):
    rows = [(f"/library/s1/{x}/Album/t.mp3", ("t", None)) for v in ARTISTS for x in v if "/" not in x]
    rows += [(None, None), ("/short", (None, "  ")), ("/library/s/Various Artists/x/y", (None, "Gerald Thateralm")), ("/library/s/Unknown Artist/x/y", (None, "Various Artists"))] + rows[:4]
    got = [tuple(r) for r in names.variants(spark.createDataFrame(rows, FILES)).collect()]
    want = {tuple(sorted(p)) for v in ARTISTS for p in itertools.combinations(v, 2)}
    assert len(got) == len(set(got)) and set(got) == want


def test_one_file_tells(spark):
    """A spelling too far from any other is linked by a file that bears both."""
    rows = [("/l/s/Henrietta Quazapiph/A/t", (None, "Hetty Qiazspif")), ("/l/s/Robert Finezendel/A/t", (None, "Someone Else"))]
    assert [tuple(r) for r in names.variants(spark.createDataFrame(rows, FILES)).collect()] == [("Henrietta Quazapiph", "Hetty Qiazspif")]


def test_nothing(spark):
    assert names.variants(spark.createDataFrame([], FILES)).count() == 0


UNLISTED = [
    ["Laura Bianchi", "Bianchi Laura", "Bianchi, Laura", "L. Bianchi", "laura bianchi"],
    ["Wei Wong", "Wong Wei"],
    ["Laura Moretti"],
    ["Bianchi, Marco", "Marco Bianchi"],
    ["Quist Ensemble", "Quist Ens.", "Quist Ensem ble"],
]


def test_unlisted_names(spark):
    """Which word is the surname of names that no list has is told by the other names."""
    rows = [(f"/library/s1/{x}/Album/t.mp3", ("t", None)) for v in UNLISTED for x in v]
    got = {tuple(r) for r in names.variants(spark.createDataFrame(rows, FILES)).collect()}
    assert got == {tuple(sorted(p)) for v in UNLISTED for p in itertools.combinations(v, 2)}


def test_artists(spark):
    rows = [(f"/library/s1/{x}/Album/t.mp3", ("t", None)) for v in ARTISTS for x in v if "/" not in x] * 2
    got = {r["name"]: r["artist"] for r in names.artists(spark.createDataFrame(rows, FILES)).collect()}
    assert got == {x: min(v) for v in ARTISTS for x in v}


@settings(max_examples=200, deadline=None)
@given(st.text("ab", min_size=44, max_size=140), st.lists(st.tuples(st.integers(0, 139), st.integers(0, 3)), max_size=2))
def test_long_codes_meet(code, changes):
    """Any two edits leave a common key, whatever the length."""
    other = code
    for at, kind in changes:
        at %= len(other) - 1
        other = {0: other[:at] + other[at + 1 :], 1: other[:at] + "c" + other[at:], 2: other[:at] + "c" + other[at + 1 :], 3: other[:at] + other[at + 1] + other[at] + other[at + 2 :]}[kind]
    if len(code) >= 52 or len(changes) < 2:
        assert names.block_keys("person", [code], []) & names.block_keys("person", [other], [])


def test_large_block():
    """A surname of very many given names takes time in proportion to them."""
    rng = random.Random(5)
    givens = ["".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(9)) for _ in range(4000)]
    profiles = [(i, ["smith"], [g]) for i, g in enumerate(givens)] + [(9000 + i, ["smyth"], [g]) for i, g in enumerate(givens)]
    began = time.time()
    links = names.resolve("person", profiles)
    assert sorted((a % 9000, b % 9000) for a, b in links) == [(i, i) for i in range(4000)] and time.time() - began < 30
