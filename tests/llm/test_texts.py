"""Encoding, held-out passages and personal information."""

import base64
import os
import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from echofold.llm import leak, pii, tokens

needs_vocabulary = pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="no vocabulary files")
DOCS = "doc_id bigint, text string, speaker string"


@pytest.fixture(scope="module")
def encoder():
    t = tokens.load()
    return tokens.Encoder(t, tokens.PerfectHash(t))


@pytest.fixture(scope="module")
def reference_encoding():
    import tiktoken

    with open(tokens.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})


@needs_vocabulary
@settings(max_examples=200, deadline=None)
@given(st.text(max_size=200))
def test_encode_any_text(encoder, reference_encoding, text):
    assert encoder.encode(text) == reference_encoding.encode_ordinary(text)


@needs_vocabulary
def test_encode_odd_texts(encoder, reference_encoding):
    for t in ["", " ", "\r\n\t ", "<|endoftext|>", "a" * 20000, " x　", "\U0001f600" * 99, "don't  we'll", "ﬁ́", "\x00￾", " " * 3000 + "y", "0123456789" * 50]:
        assert encoder.encode(t) == reference_encoding.encode_ordinary(t)
        assert b"".join(encoder.tokens[i] for i in encoder.encode(t)).decode() == t
    assert encoder.encode(None) == []


@needs_vocabulary
def test_encode_table(spark, reference_encoding):
    rows = [(1, "Hello  world", "x"), (2, None, None), (3, "", None), (4, "é" * 9, "y"), (4, "é" * 9, "y"), (None, "a", None)]
    df = spark.createDataFrame(rows, DOCS).withColumn("ids", F.lit(1))
    got = sorted(((r["doc_id"] or 0, r["ids"]) for r in tokens.encode(df).collect()))
    assert got == sorted((d or 0, reference_encoding.encode_ordinary(t or "")) for d, t, _ in rows)
    assert tokens.encode(df.limit(0)).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.sets(st.binary(max_size=6), min_size=1, max_size=300))
def test_perfect_hash(keys):
    keys = sorted(keys)
    h = tokens.PerfectHash(keys)
    assert sorted(h.slots.tolist()) == list(range(len(keys))) and all(h.slot(k) == i for i, k in enumerate(keys))


RNG = random.Random(11)
VOCAB = ["".join(RNG.choice("abcdefghilmnoprstuvz") for _ in range(RNG.randrange(2, 10))) for _ in range(700)]
ITEM = [RNG.choice(VOCAB) for _ in range(90)]
FILL = lambda n: " ".join(RNG.choice(VOCAB) for _ in range(n))


def altered(words, at):
    out = list(words)
    for i in at:
        out[i] = "qqqqq"
    return out


def hidden(words):
    """A passage as it stands in a messy document."""
    w = list(words)
    w[5] = w[5][:1] + "-\r\n" + w[5][1:] if len(w[5]) > 1 else w[5]
    w[8] = w[8].upper() + ","
    w[12] += " (Hear, hear!)"
    w[16] += "\n[Official Record, col. 9]\n"
    w[20] += " — Several Members: Shame! —"
    w[22] += "   <Prolonged noise>"
    return " ".join(w)


def test_leaks(spark):
    texts = {
        1: FILL(60) + " " + " ".join(ITEM[20:50]) + " " + FILL(60),
        2: FILL(9) + " " + hidden(ITEM[40:72]) + ". " + FILL(3),
        3: FILL(40) + " " + " ".join(altered(ITEM[10:40], (7, 15, 23))) + " " + FILL(40),
        4: " ".join(ITEM),
        10: FILL(60) + " " + " ".join(ITEM[20:46]) + " " + FILL(60),
        11: " ".join(altered(ITEM[10:40], (3, 8, 13, 18, 23, 28))),
        12: FILL(400), 13: "", 14: None, 15: " \r\n", 16: " ".join(reversed(ITEM)),
        17: FILL(20000) + " " + " ".join(ITEM[:31]),
    }
    docs = spark.createDataFrame([(i, t, "s") for i, t in texts.items()] + [(4, texts[4], "s")], DOCS).withColumn("item_id", F.lit(0))
    items = spark.createDataFrame([(7, " ".join(ITEM)), (8, "too short"), (9, None), (6, FILL(80))], "item_id bigint, text string")
    got = [tuple(r) for r in leak.leaks(docs, items).collect()]
    assert sorted(got) == [(1, 7), (2, 7), (3, 7), (4, 7), (17, 7)]
    assert leak.leaks(docs.limit(0), items).count() == leak.leaks(docs, items.limit(0)).count() == 0


def test_several_passes(spark, monkeypatch):
    monkeypatch.setattr(leak, "PASS_LETTERS", 10)
    docs = spark.createDataFrame([(1, " ".join(ITEM), None)], DOCS)
    items = spark.createDataFrame([(i, " ".join(ITEM[i:])) for i in range(3)], "item_id bigint, text string")
    assert leak.leaks(docs, items).count() == 3


@settings(max_examples=100, deadline=None)
@given(st.text("abc", max_size=300))
def test_wu_manber(run):
    p = leak.Passages([(1, "abca bcaa bbcc abccba aabb ccabc abc bcabca ca"), (2, "cabb acab cabba cba cbc abcb ac b a")], at_least=7, altered=0.0)
    want = sorted((i, x) for x in p.seeds for i in range(len(run)) if run.startswith(x, i))
    assert sorted(p.hits(run)) == want
    assert p.hits("xy" + "".join(p.words[1]) + run)[0][0] == 2


def edits(item, doc):
    """The least cost of any ``item`` words i to j in ``doc`` by plain dynamic programming: rows i -> {j: cost}; replaced words may be at the ends, missing ones not."""
    out = {}
    for i in range(len(item)):
        row = [(0, True)] * (len(doc) + 1)  # (cost, whether the last word stands or is replaced)
        cost = [0] * (len(doc) + 1)
        for j in range(i, len(item)):
            new, ends = [10**6] * (len(doc) + 1), [10**6] * (len(doc) + 1)
            for d in range(1, len(doc) + 1):
                ends[d] = cost[d - 1] + (item[j] != doc[d - 1])
            for d in range(len(doc) + 1):
                gone = cost[d] + 1 if j > i else 10**6
                new[d] = min(ends[d], gone, new[d - 1] + 1 if d else 10**6)
            out[i, j + 1] = min(ends)
            cost = new
    return out


@pytest.mark.parametrize("seed", range(12))
def test_passages_by_brute_force(seed):
    """The search finds exactly what plain dynamic programming finds, in texts of few different words too."""
    rng = random.Random(seed)
    vocab = [w + x for w in "abcdefgh" for x in ("", "x", "yz", "long")][: 8 + 4 * (seed % 4)]
    item = [rng.choice(vocab) for _ in range(26)]
    p = leak.Passages([(1, " ".join(item))], at_least=10, altered=0.2)
    found = wrong = 0
    for _ in range(60):
        i = rng.randrange(0, 14)
        doc = list(item[i : i + rng.randrange(9, 16)])
        for _ in range(rng.randrange(4)):
            at, kind = rng.randrange(len(doc)), rng.randrange(3)
            doc[at : at + (kind != 1)] = [] if kind == 2 else [rng.choice(vocab)]
        doc = [rng.choice(vocab) for _ in range(rng.randrange(3, 6))] + doc + [rng.choice(vocab) for _ in range(rng.randrange(3, 6))]
        want = any(c <= 0.2 * (b - a) + 1e-9 for (a, b), c in edits(item, doc).items() if b - a >= 10)
        got = bool(p.search(" ".join(doc)))
        found += want
        wrong += want != got
    assert not wrong and 5 < found < 60


@pytest.mark.parametrize("letters", [(2, 9), (2, 5)])
def test_recall_of_altered_passages(letters):
    """Thirty words with three altered at any places, the ends included: none is lost."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghiklmnoprstuw") for _ in range(rng.randrange(*letters)))
    items = {k: [word() for _ in range(80)] for k in range(40)}
    p = leak.Passages([(k, " ".join(w)) for k, w in items.items()])
    for n in range(400):
        k = rng.randrange(40)
        i = rng.randrange(51)
        passage = altered(items[k][i : i + 30], rng.sample(range(30), 3) if n % 4 else [0, 29, rng.randrange(1, 29)])
        text = " ".join([word() for _ in range(40)] + passage + [word() for _ in range(40)])
        assert p.search(text) == [k]


def test_long_asides():
    """An interruption of any length may stand in a passage, and a passage in brackets of any length."""
    p = leak.Passages([(1, " ".join(ITEM))])
    long = FILL(60)
    assert p.search(" ".join(ITEM[:20]) + f" ({long}) " + " ".join(ITEM[20:40])) == [1]
    assert p.search(f"{long} (" + " ".join(ITEM[:31]) + f") {long}") == [1]
    short = ["a", "of", "to", "in", "it", "is", "be", "as", "at", "so"]
    words = [RNG.choice(short) for _ in range(45)]
    assert leak.Passages([(1, " ".join(words))]).search("x (" + " ".join(words[5:36]) + ") y") == [1]


PIECES = [
    ("email", "ann.lee+x@mail.example.org"), ("email", "lee22 @ mail.example.org"), ("email", "lee[at]post[dot]example"), ("email", "a.b (at) home (dot) example (dot) com"), ("email", "X_Y@BRIEF.EXAMPLE.NET"),
    ("phone", "+999 59 555 3880"), ("phone", "+999(0)93/5550189"), ("phone", "00999-23-5554069"), ("phone", "(051) 555-0133"), ("phone", "056.555.0150"), ("phone", "0465550166"), ("phone", "555 0148 ext. 43"), ("phone", "five five five, zero one eight eight"),
    ("id_number", "QX 319681 B"), ("id_number", "qx019101d"), ("id_number", "ZZ05 2164 8767 8923"), ("id_number", "930627+0580"), ("id_number", "600303 2438"), ("id_number", "76.297.637-8"), ("id_number", "94.642.129-K"), ("id_number", "P71706320"),
    ("address", "170 Fitin Quay, Vimendel"), ("address", "Amber Cottage, Lezimar Lane, Bireck"), ("address", "231 Drubusten Ln, Lakugart B3 4XA"), ("address", "PO Box 212, Padirby"), ("address", "Flat 33, 166A Thofen Terrace, Lethawell"), ("address", "39 Quedatz St., Motrulm A5 8XA"),
    ("address", "Pabomarweg 186 b, 69134 Vibowell"), ("address", "141 ter, impasse Keskemar, 55982 Faneph"),
    ("name", "Larry Brodustan"), ("name", "SUQUIRD, Nicholas"), ("name", "T. Zovord"), ("name", "Penny Dutran-Rodrasten"), ("name", "William S. Ranendil"),
]
ROLL = pii.Roll(["Elizabeth Fefastenow", "Andrew Kuvissow", "Jeremiah Megavikant"], ["Civic Lantern"])


@pytest.mark.parametrize("kind,value", PIECES)
def test_found(kind, value):
    for text in (f"We spoke of it ({value}) then.", f"It was {value}, said the clerk.", f"Ask for {value}"):
        assert [(k, v, text[a:b]) for k, v, a, b in pii.find(text, ROLL)] == [(kind, value, value)]


@pytest.mark.parametrize(
    "text",
    [
        "Andrew Kuvissow (Independents): Thank you.", "Betty Fefastenow spoke.", "A. Kuvissow and KUVISSOW, Andrew agreed.", "Andrew Kuvisow agreed.", "I thank the honourable Member Jane Doe.", "Oliver Strange (New Orchard): Order.",
        "The total stands at 555 156 328 crowns, see table 2.", "Paragraph 6.2.4-1 sets out the exceptions.", "The vote on the Trunelow Street Act took 82 minutes.", "of the C. Lantern and (C. Alliance): Order.", "reference QX/69, of 2030-07-17", "216000 complaints, 5,721,000 crowns", "Bill No. 2038/676", "", "   ",
    ],
)
def test_not_meant(text):
    assert pii.find(text, ROLL, "Oliver Strange") == []


def test_cue_and_speaker():
    assert [x[1] for x in pii.find("The file of Quirin Halvard, identity number", ROLL)] == ["Quirin Halvard"]
    assert pii.find("Harold Lister thinks so.", ROLL, "LISTER, Harold") == []
    assert pii.find(None, ROLL) == []
    assert len(pii.find("x " * 100_000 + "lee@mail.example.org", ROLL)) == 1


@pytest.mark.parametrize("unit", ["a", "A", "1", "%", "a.", "1 ", "A-", "Ab ", "(", "555 ", "five ", "A. ", " ", "-\n", "—"])
def test_very_long_texts(unit):
    text = unit * (400_000 // len(unit))
    began = time.time()
    pii.find(text, ROLL)
    leak.Passages([(1, " ".join(ITEM))]).search(text)
    assert time.time() - began < 20


@pytest.mark.parametrize("kind,value", PIECES)
def test_surrogate_form(kind, value):
    new = pii.surrogate(kind, value, "k")
    assert new != value and new == pii.surrogate(kind, value, "k") and new != pii.surrogate(kind, value, "other")
    if kind != "phone" or any(c.isdigit() for c in value):
        shape = lambda s: [("9" if c.isdigit() else c) for c in s if not c.isalpha()]
        assert shape(new) == shape(value)
    assert [k for k, *_ in pii.find(f"It was {new}, then.", pii.Roll([]))] == [kind]


def test_surrogates_of_one_person_agree():
    a, b, c = (pii.surrogate("name", v, "k") for v in ("SUQUIRD, Nicholas", "Nick Suquird", "Nicholas Suquird"))
    surname = c.split()[1]
    assert a == f"{surname.upper()}, {c.split()[0]}" and b == c
    assert pii.GENDER[c.split()[0].lower()] == "m"


def test_replaced(spark, monkeypatch):
    rows = [(1, "Write to lee@mail.example.org or call 0465550166.", None), (2, "Nothing here.", None), (3, None, None), (4, "lee@mail.example.org, lee@mail.example.org", "x"), (5, "", None)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"kind": F.lit(1), "value": F.lit(2), "spans": F.lit(3)})
    members = spark.createDataFrame([(None, None), ("Andrew Kuvissow", "New Lantern")], "full_name string, party string")
    found = pii.detect(docs, members)
    chosen = pii.surrogates(found, "k")
    new = {r["doc_id"]: r["text"] for r in pii.replaced(docs, found, chosen).collect()}
    mail = pii.surrogate("email", "lee@mail.example.org", "k")
    assert new == {1: f"Write to {mail} or call {pii.surrogate('phone', '0465550166', 'k')}.", 2: "Nothing here.", 3: None, 4: f"{mail}, {mail}", 5: ""}
    assert pii.surrogates(pii.detect(docs.limit(0), members), "k").count() == 0


def test_collisions_are_resolved(spark):
    """Few digits leave few surrogates, so some collide at first."""
    found = spark.createDataFrame([(i, "id_number", f"{i:02}", 0, 2) for i in range(40)], pii.SPAN)
    got = pii.surrogates(found, "k").collect()
    assert len({r["surrogate"] for r in got}) == 40 and not {r["surrogate"] for r in got} & {f"{i:02}" for i in range(40)}
    assert max(r["attempt"] for r in got) > 0


NO_ROLL = pii.Roll([])


@pytest.mark.parametrize(
    "text,want",
    [
        ("Contact Emma Wilson.", [("name", "Emma Wilson")]), ("Please ask for Björn Ødegaard today.", [("name", "Björn Ødegaard")]), ("Dr. Zoltán Kovács and Wei Chen agreed.", [("name", "Zoltán Kovács"), ("name", "Wei Chen")]),
        ("Amara Okafor and Mr Peter Stone", [("name", "Amara Okafor"), ("name", "Peter Stone")]), ("Frau Ilse Wagner und Jürgen Maier", [("name", "Ilse Wagner"), ("name", "Jürgen Maier")]),
        ("call me at 555-1234", [("phone", "555-1234")]), ("Ring 020 7946 0958 now", [("phone", "020 7946 0958")]), ("phone: (212) 555-0199", [("phone", "(212) 555-0199")]),
        ("SSN 123-45-6789", [("id_number", "123-45-6789")]), ("Passport 123456789", [("id_number", "123456789")]), ("passport no. C1234567", [("id_number", "C1234567")]), ("card 4111 1111 1111 1111", [("id_number", "4111 1111 1111 1111")]),
        ("1600 Pennsylvania Avenue, Washington DC 20500", [("address", "1600 Pennsylvania Avenue, Washington DC 20500")]), ("at 12 Elm Street, Cedar Falls, IA 50613-1234.", [("address", "12 Elm Street, Cedar Falls, IA 50613-1234")]),
        ("card 4111 1111 1111 1112", []), ("The vote of 555-1234 members", []), ("Mr Deputy Speaker, Madam President", []), ("Frau Präsidentin Meyer", []), ("It cost 123456789 crowns", []), ("Dear Prime Minister", []),
    ],
)
def test_found_by_form_and_context(text, want):
    """Persons, numbers and addresses that no list has."""
    assert [(k, v) for k, v, _, _ in pii.find(text, NO_ROLL)] == want


def test_surrogates_of_unlisted_names_agree():
    full, comma, initial = (pii.surrogate("name", v, "k") for v in ("Zoltán Kovács", "Kovács, Zoltán", "Z. Kovács"))
    given, surname = full.split()
    assert comma == f"{surname}, {given}" and initial == f"{given[0]}. {surname}" and not set(pii.fold(surname)) == set("kovacs")
    full, short, initial = (pii.surrogate("name", v, "k") for v in ("John Smith", "J. R. Smith", "Smith, J."))
    assert short.split()[0] == f"{full[0]}." and initial == f"{full.split()[1]}, {full[0]}." and short.split()[2] == full.split()[1] and " R. " not in short
    greek, russian, chinese = (pii.surrogate("name", v, "k") for v in ("Γιώργος Παπαδόπουλος", "Иван Петров", "王 小明"))
    assert {pii.script(x) for x in greek.split()} == {"GREEK"} and {pii.script(x) for x in russian.split()} == {"CYRILLIC"} and {pii.script(x) for x in chinese.split()} == {"CJK"}
    assert pii.canonical("name", "Kovács, Zoltán") == pii.canonical("name", "Zoltan Kovacs")


def test_pseudonyms(spark):
    docs = spark.createDataFrame([(1, "Dr Zoltán Kovács wrote; Z. Kovács rang.", None), (2, "Kovács, Zoltán", None), (3, None, None)], DOCS).withColumn("surrogate", F.lit(1))
    got = {(r["doc_id"], r["value"]): r["surrogate"] for r in pii.pseudonyms(docs, spark.createDataFrame([], "full_name string, party string"), "k").collect()}
    assert got == {(1, v): pii.surrogate("name", v, "k") for v in ("Zoltán Kovács", "Z. Kovács")}
