"""Spellings of one person or band, linked by merging what matches and matching what was merged again."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from echofold.functions.text import lcs_length, strip
from echofold.llm import hash_to_min
from echofold.llm.given import FULL, may_be
from echofold.operators.shared import cut

# What is written before names, and the words that bands call themselves by, with their short forms.
TITLES = frozenset("mr mrs ms miss mx dr doctor prof professor sir dame lord lady dj mc rev hon st".split())
BAND_WORDS = {
    "brothers": ("bros", "bro", "brothers"), "sisters": ("sis", "sisters"), "chamber": ("ch", "chamb", "chmbr", "chamber"), "choir": ("chr", "choir", "chorus"),
    "philharmonic": ("phil", "philh", "philharmonic"), "society": ("soc", "society"), "ensemble": ("ens", "ensemble"), "orchestra": ("orch", "orchestra"),
    "quartet": ("qrt", "qt", "qtet", "4tet", "quart", "quartet"), "quintet": ("qnt", "5tet", "quintet"), "trio": ("trio",), "duo": ("duo",), "sound": ("snd", "sound"), "system": ("sys", "syst", "system"),
    "soundsystem": ("soundsystem",), "band": ("band",), "collective": ("coll", "collective"), "project": ("proj", "project"), "group": ("grp", "group"), "symphony": ("symph", "symphony"),
    "singers": ("singers",), "players": ("players",), "big": ("big",), "string": ("str", "string"), "sextet": ("sxt", "6tet", "sextet"), "septet": ("7tet", "septet"), "octet": ("8tet", "octet"),
    "sinfonia": ("sinf", "sinfonia"), "sinfonietta": ("sinfonietta",), "consort": ("consort",), "camerata": ("camerata",), "allstars": ("allstars",), "crew": ("crew",), "experience": ("exp", "experience"), "family": ("fam", "family"),
}
#: Band words that are written as one or as two.
AS_ONE = {("sound", "system"): "soundsystem"}
WORD_OF = {form: word for word, forms in BAND_WORDS.items() for form in forms}
NOT_ARTISTS = ("Various Artists", "Unknown Artist")
# Letters that sound alike, longest first.
SOUNDS = (("qu", "kv"), ("ph", "f"), ("th", "t"), ("ck", "k"), ("sch", "s"), ("sh", "s"), ("x", "ks"), ("q", "k"), ("c", "k"), ("z", "s"), ("y", "i"), ("w", "v"), ("dt", "t"))
#: Codes of more letters meet by pieces instead of by what is left without one letter: six to twelve of PIECE letters or of twice, four times ... as many.  Two edits leave two pieces whole.
LONG, PIECE = 48, 8
#: How much more often the words of a name must stand the other way round elsewhere for it to be turned.
TURNED = 3
#: Least similarity of the nearest words of two names that were written on one file.
SAME_FILE = 0.5


def fold(s: str) -> str:
    """Lower case without accents; underscores and dots end words."""
    s = unicodedata.normalize("NFKD", s.replace("_", " ").replace(".", ". "))
    return "".join(c for c in s if not unicodedata.combining(c)).lower()


def sound(word: str) -> str:
    """A word as it sounds: spellings that are heard alike have one code."""
    for a, b in SOUNDS:
        word = word.replace(a, b)
    return re.sub(r"(.)\1+", r"\1", word)


def near(a: str, b: str) -> int:
    """Edits between two words, a swap of neighbours being one; 3 if there are more than two.  Only a band of five is computed."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > 2:
        return 3
    older: dict[int, int] = {}
    old: dict[int, int] = {}
    row = {j: j for j in range(min(2, len(b)) + 1)}
    for i, x in enumerate(a, 1):
        older, old, row = old, row, {0: i} if i <= 2 else {}
        for j in range(max(1, i - 2), min(len(b), i + 2) + 1):
            d = min(old.get(j, 3) + 1, row.get(j - 1, 3) + 1, old.get(j - 1, 3) + (x != b[j - 1]))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == b[j - 1]:
                d = min(d, older.get(j - 2, 3) + 1)
            row[j] = min(d, 3)
        if min(row.values()) > 2 and min(old.values(), default=3) > 2:
            return 3
    return row.get(len(b), 3)


@lru_cache(1 << 14)
def known_given(word: str) -> str:
    """The known given name or short form that a word is, perhaps with one slip; '' if none."""
    if word in FULL:
        return word
    if len(word) < 4:
        return ""
    return min((g for g in FULL if len(g) >= 4 and near(g, word) == 1), key=lambda g: (-len(g), g), default="")


@lru_cache(1 << 14)
def band_word(word: str) -> str:
    """The band word that a word is or shortens, perhaps with one slip; '' if none."""
    w = word.rstrip(".")
    if w in WORD_OF:
        return WORD_OF[w]
    if len(w) < 5:
        return ""
    return next((x for x in BAND_WORDS if len(x) >= 5 and near(x, w) == 1), "")


def _words(name: str) -> tuple[list[str], bool]:
    """(words in lower case without 'the', those that are parts of one band word joined, whether 'the' was there)."""
    words = [t.rstrip(".") for t in re.findall(r"[^\W_]+\.?", fold(name))]
    bare = [w for w in words if w != "the"] or words
    out: list[str] = []
    for w in bare:
        # A band word that a blank fell into.
        if out and out[-1] + w in WORD_OF and not (out[-1] in WORD_OF and w in WORD_OF):
            out[-1] += w
        else:
            out.append(w)
    return out, "the" in words


def parse(name: str, turned: bool = False) -> tuple[str, str, str] | None:
    """(kind, code, given) of a spelling: ('band', code of its own name, its band words) or ('person', code of the surname, given name or initial).

    The order of parts does not matter, nor do titles, articles, middle
    initials, case, accents and layout.  Of two words that no list has the
    first is the given name, or the last if ``turned``.  None if there are no
    letters.
    """
    comma = "," in name
    words, the = _words(name)
    if not words:
        return None
    types = [(w, band_word(w)) for w in words]
    own = [w for w, t in types if not t]
    if own and len(own) < len(words) and (len(own) == 1 or the or not any(known_given(w) for w in own)):
        kinds = {t for _, t in types if t}
        for pair, one in AS_ONE.items():
            if kinds >= set(pair):
                kinds = kinds - set(pair) | {one}
        return "band", sound("".join(own)), "+".join(sorted(kinds))
    words = [w for w in words if w not in TITLES] or words
    if len(words) == 1:
        return "person", sound(words[0]), ""
    initials = [w for w in words if len(w) == 1]
    long = [w for w in words if len(w) > 1]
    if not long:
        return "person", sound("".join(words)), ""
    if len(long) == 1:
        return "person", sound(long[0]), initials[0]
    firsts = [(i, known_given(w)) for i, w in enumerate(long) if known_given(w)]
    if comma and len(long) == 2:
        at = 1
    elif len(firsts) == 1:
        at = firsts[0][0]
    elif len(firsts) > 1:
        exact = [i for i, _ in firsts if long[i] in FULL]
        at = exact[0] if exact else firsts[0][0]
    else:
        at = len(long) - 1 if turned else 0
    given = known_given(long[at]) or long[at]
    return "person", sound("".join(w for i, w in enumerate(long) if i != at)), given


def unlisted(name: str) -> tuple[str, str, bool] | None:
    """(given, surname, whether that order is sure) of a person's name of two words that no list has; sure if a comma tells."""
    words, _ = _words(name)
    long = [w for w in words if w not in TITLES and len(w) > 1]
    if len(long) != 2 or any(known_given(w) or band_word(w) for w in long):
        return None
    return (long[1], long[0], True) if "," in name else (long[0], long[1], False)


def block_keys(kind: str, codes: list[str], givens: list[str]) -> set[str]:
    """Where a profile looks for its like: its codes with any one letter left out, and both ends of a code
    under the band kind or a given name that is one person's (in such a block a short form of several names would see only one of them).
    Long codes look by pieces, each where it stands and up to two letters beside that."""
    out = set()
    for c in codes:
        out.add(f"{kind[0]}{c}")
        if 4 <= len(c) <= LONG + 2:
            out.update(f"{kind[0]}{c[:i]}{c[i + 1:]}" for i in range(len(c)))
        if len(c) >= LONG - 2:
            for size in {PIECE << max(0, (n // LONG).bit_length() - 1) for n in (len(c) - 2, len(c) + 2)}:  # of codes two letters shorter or longer too
                pieces = ((at, c[max(0, at + s) : at + s + size]) for at in range(0, len(c) - size + 1, size) for s in range(-2, 3))
                out.update(f"{kind[0]}#{size}|{at}|{hashlib.blake2b(x.encode(), digest_size=8).hexdigest()}" for at, x in pieces if len(x) == size)
        if len(c) > 4:
            for g in givens:
                if kind == "band":
                    out.update((f"b<{g}|{c[:5]}", f"b>{g}|{c[-5:]}"))
                elif len(g) > 1 and len(FULL.get(g, {g})) == 1:
                    (full,) = FULL.get(g, {g})
                    out.update((f"p<{full}|{c[:5]}", f"p>{full}|{c[-5:]}"))
    return out


def distance(a: list[str], b: list[str]) -> int:
    return min(near(x, y) for x in a for y in b)


def slack(a: list[str], b: list[str]) -> int:
    """Edits that two codes may differ by: none if short, one, or two in a long one."""
    n = min(len(x) for x in a + b)
    return 0 if n < 4 else 1 if n < 8 else 2


def persons(givens: list[str]) -> frozenset[str]:
    """The full given names that all forms of a profile may stand for; if no one name fits all, any of theirs."""
    sets = [FULL.get(g, frozenset({g})) for g in givens if len(g) > 1]
    both = frozenset.intersection(*sets) if sets else frozenset()
    return both or frozenset().union(*sets)


def given_agree(a: list[str], b: list[str]) -> bool:
    """Whether the given names of two profiles may be one person's."""
    x, y = persons(a), persons(b)
    return bool(x & y) or any(g not in FULL and h not in FULL and near(g, h) <= 1 for g in x for h in y)


def initial_agrees(initials: list[str], other: list[str]) -> bool:
    return any(may_be(i, g) for i in initials for g in other if g)


class _Groups:
    """The merged groups of a block, found by what a given name, an initial or band words may agree in."""

    def __init__(self) -> None:
        self.codes: dict[int, list[str]] = {}
        self.givens: dict[int, list[str]] = {}
        self.first: dict[int, int] = {}
        self.index: dict[str, set[int]] = {}

    @staticmethod
    def tokens(kind: str, givens: list[str]) -> set[str]:
        """Names whose givens agree share one: a full name, or a name that no list has without one of its letters."""
        if kind == "band":
            return set(givens)
        out = set(persons(givens))
        for g in [g for g in out if g not in FULL]:
            out.update(g[:i] + g[i + 1 :] for i in range(len(g)))
        return out

    def put(self, number: int, kind: str, pid: int, codes: list[str], givens: list[str]) -> None:
        self.first.setdefault(number, pid)
        self.codes[number], self.givens[number] = sorted({*self.codes.get(number, ()), *codes}), sorted({*self.givens.get(number, ()), *givens})
        own = self.givens[number]
        initials = {f"^{x[0]}" for g in own if g for x in (FULL.get(g, frozenset()) | {g})}
        for t in self.tokens(kind, own) | initials:
            self.index.setdefault(t, set()).add(number)

    def drop(self, number: int) -> tuple[list[str], list[str]]:
        return self.codes.pop(number), self.givens.pop(number)

    def near(self, tokens: set[str]) -> list[int]:
        return sorted({g for t in tokens for g in self.index.get(t, ()) if g in self.codes})


def resolve(kind: str, profiles: list[tuple[int, list[str], list[str]]]) -> list[tuple[int, int]]:
    """(pid, pid) links in one block, each record compared with the merged groups of agreeing given names so far, never with all others.

    Profiles whose given name is one person's come first, then those of short
    forms with several meanings, then those of initials, so that the less
    telling only meet whole persons.  One joins all groups that fit if these
    agree among themselves, else the only one at the smallest distance; if
    there are several, it is left for a richer round.
    """
    links, groups = [], _Groups()
    whole = lambda p: kind == "band" or any(len(g) > 1 for g in p[2])
    agree = (lambda x, y: bool(set(x) & set(y))) if kind == "band" else given_agree
    for number, (pid, codes, givens) in enumerate(sorted(filter(whole, profiles), key=lambda p: (kind != "band" and len(persons(p[2])), p[0]))):
        hits = [g for g in groups.near(groups.tokens(kind, givens)) if distance(codes, groups.codes[g]) <= slack(codes, groups.codes[g]) and agree(givens, groups.givens[g])]
        if kind == "person" and any(not given_agree(groups.givens[g], groups.givens[hits[0]]) for g in hits):
            least = min(distance(codes, groups.codes[g]) for g in hits)
            hits = [g for g in hits if distance(codes, groups.codes[g]) == least]
            if len(hits) > 1:
                continue
        links += [(groups.first[g], pid) for g in hits]
        for g in hits[1:]:
            more = groups.drop(g)
            codes, givens = [*codes, *more[0]], [*givens, *more[1]]
        groups.put(hits[0] if hits else number, kind, pid, codes, givens)
    bare = _Groups()
    for number, (pid, codes, givens) in enumerate(p for p in profiles if not whole(p)):
        close = lambda g, of: distance(codes, of.codes[g]) <= min(1, slack(codes, of.codes[g]))  # noqa: B023, E731
        fits = [(distance(codes, groups.codes[g]), g) for g in groups.near({f"^{x}" for x in givens}) if initial_agrees(givens, groups.givens[g]) and close(g, groups)]
        least = min((d for d, _ in fits), default=9)
        fits = [g for d, g in fits if d == least]
        if len(fits) == 1:
            links.append((groups.first[fits[0]], pid))
        if fits:
            continue
        same = [g for g in bare.near({f"^{x}" for x in givens}) if set(bare.givens[g]) & set(givens) and close(g, bare)]
        if same:
            links.append((bare.first[same[0]], pid))
        else:
            bare.put(number, kind, pid, codes, givens)
    return links


def turned(names: DataFrame) -> DataFrame:
    """(name, turned): whether a name of two unlisted words has its surname first, as the other names tell.

    Every name counts its words as given name and surname, in the order that
    it has.  A name is turned if its words stand the other way round TURNED
    times as often, or at all more often, or as often and in the order of the
    alphabet, where the reversed name occurs too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(n, *p) for n in b.column(0).to_pylist() if (p := unlisted(n))]
            types = (pa.string(), pa.string(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], t) for i, t in enumerate(types)], names=["name", "x", "y", "sure"])

    two = cut(names.select("name").mapInArrow(run, "name string, x string, y string, sure boolean"))
    words = two.select(F.explode(F.array(F.struct(F.col("x").alias("word"), F.lit(1).alias("g")), F.struct(F.col("y").alias("word"), F.lit(0).alias("g")))).alias("w")).select("w.*")
    n = words.groupBy("word").agg(F.sum("g").alias("given"), F.sum(1 - F.col("g")).alias("last"))
    n = cut(n)
    side = lambda c: n.select(F.col("word").alias(c), F.col("given").alias(f"given_{c}"), F.col("last").alias(f"last_{c}"))
    both = two.where(~F.col("sure")).join(side("x"), "x").join(side("y"), "y")
    back = two.select(F.col("x").alias("y"), F.col("y").alias("x"), F.lit(True).alias("back")).distinct()
    both = both.join(back, ["x", "y"], "left")
    written, other = F.col("given_x") + F.col("last_y"), F.col("given_y") + F.col("last_x")
    known = F.col("back").isNotNull() & ((other > written) | ((other == written) & (F.col("x") > F.col("y"))))
    return both.select("name", (known | (other >= TURNED * written)).alias("turned")).where("turned")


def _parsed(spellings: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(n, *p) for n, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if (p := parse(n, bool(t)))]
            yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], pa.string()) for i in range(4)], names=["name", "kind", "code", "given"])

    both = spellings.select("name").join(turned(spellings), "name", "left")
    return both.select("name", "turned").mapInArrow(run, "name string, kind string, code string, given string")


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(k, *r) for r in zip(*(b.column(i).to_pylist() for i in range(4))) for k in block_keys(r[1], r[2], r[3])]
        types = (pa.string(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["key", "pid", "kind", "codes", "givens"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ordered by key -> links of each block."""
    key, held, links = None, [], []

    def close() -> None:
        if len(held) > 1:
            links.extend(resolve(held[0][1], sorted((r[0], r[2], r[3]) for r in held)))

    for b in batches:
        for k, *r in zip(*(b.column(i).to_pylist() for i in range(5))):
            if k != key:
                close()
                key, held = k, []
            held.append(r)
        if len(links) > 10_000:
            yield _linked(links)
            links = []
    close()
    yield _linked(links)


def _linked(links: list[tuple[int, int]]) -> pa.RecordBatch:
    links = sorted(set(links))
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], names=["a", "b"])


@F.arrow_udf(BooleanType())
def alike(a: pa.Array, b: pa.Array) -> pa.Array:
    """Whether some words of two names are as near as names of one file must be."""

    def one(x: str, y: str) -> bool:
        p, q = (sorted(re.findall(r"[^\W\d_]+", fold(s)), key=len)[-2:] for s in (x, y))
        return any(2 * lcs_length(u, v) >= 2 * SAME_FILE * max(len(u), len(v)) for u in p for v in q if min(len(u), len(v)) > 2)

    return pa.array([one(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())])


def spellings_of(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(names (name), together (a, b)): all spellings in artist folders and tags, and those that stand on one file."""
    folder = F.when(F.size(F.split("path", "/")) > 4, F.element_at(F.split("path", "/"), 4))
    both = files.select(folder.alias("a"), strip(F.col("tags.artist")).alias("b"))
    named = lambda c: c.isNotNull() & (c != "") & ~c.isin(*NOT_ARTISTS)
    names = both.select(F.explode(F.array("a", "b")).alias("name")).where(named(F.col("name"))).distinct()
    return names, both.where(named(F.col("a")) & named(F.col("b")) & (F.col("a") != F.col("b"))).distinct()


def same_artist(names: DataFrame, together: DataFrame | None = None) -> DataFrame:
    """(name, artist): each spelling with an identifier of its artist.

    A profile starts as all spellings with one kind, code and given name; it
    holds its codes, given names and initials.  Each round puts profiles into
    blocks, merges in every block what matches, unites links that meet into
    groups, and lets the merged profiles, now with the codes and names of all
    their members, look again, until a round merges nothing; as a round that
    merges leaves fewer profiles, that comes.  Blocks and
    groups are streams of rows; no block's pairs are listed.  A block holds
    profiles, not rows: the different given names of one surname, or what one
    band calls itself.  Names without a letter have no row.
    """
    parsed = cut(_parsed(names))
    first = parsed.select("kind", "code", "given").distinct().withColumn("pid", F.monotonically_increasing_id())
    first = cut(first)
    owner = parsed.join(first, ["kind", "code", "given"]).select("name", "pid")
    profiles = first.select("pid", "kind", F.array("code").alias("codes"), F.when(F.col("given") == "", F.array().cast("array<string>")).otherwise(F.array("given")).alias("givens"))
    of = first.select("pid", F.col("pid").alias("group"))  # profile of the first round -> its merged profile
    extra = None
    if together is not None:
        good = together.where(alike("a", "b"))
        x = good.join(owner.select(F.col("name").alias("a"), F.col("pid").alias("x")), "a").join(owner.select(F.col("name").alias("b"), F.col("pid").alias("y")), "b")
        extra = x.where(F.col("x") != F.col("y")).select(F.col("x").alias("a"), F.col("y").alias("b"))
    while True:
        links = profiles.select("pid", "kind", "codes", "givens").mapInArrow(_keys, "key string, pid bigint, kind string, codes array<string>, givens array<string>")
        links = links.repartition("key").sortWithinPartitions("key").mapInArrow(_blocks, "a bigint, b bigint")
        if extra is not None:
            links, extra = links.unionByName(extra), None
        merged = cut(hash_to_min.groups(links).select(F.col("path").alias("pid"), F.col("group_path").alias("to")))
        if merged.isEmpty():
            break
        flat = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
        profiles = profiles.join(merged, "pid", "left").groupBy(F.coalesce("to", "pid").alias("pid")).agg(F.min("kind").alias("kind"), flat("codes").alias("codes"), flat("givens").alias("givens"))
        profiles = cut(profiles)
        of = cut(of.join(merged.select(F.col("pid").alias("group"), "to"), "group", "left").select("pid", F.coalesce("to", "group").alias("group")))
    return owner.join(of, "pid").select("name", F.col("group").alias("artist"))


def artists(files: DataFrame) -> DataFrame:
    """(name, artist): every spelling, once, with the least spelling of its artist; one row for each, however many there are of one artist.  Names without a letter are artists of their own."""
    names, together = spellings_of(files)
    of = cut(same_artist(names, together))
    of = of.join(of.groupBy("artist").agg(F.min("name").alias("least")), "artist").select("name", "least")
    return names.join(of, "name", "left").select("name", F.coalesce("least", "name").alias("artist"))


def variants(files: DataFrame) -> DataFrame:
    """(name_a, name_b), name_a < name_b: all pairs of different spellings of one artist."""
    of = cut(artists(files))
    return of.select(F.col("name").alias("name_a"), "artist").join(of.select(F.col("name").alias("name_b"), "artist"), "artist").where(F.col("name_a") < F.col("name_b")).select("name_a", "name_b")
