"""Personal information in free text: found, and replaced by keyed surrogates of the same form."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect, insort
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echofold.functions.text import lcs_length
from echofold.llm.given import FULL, GENDER, SHORT_FORMS, may_be
from echofold.llm.tokens import spread
from echofold.operators.shared import cut

UP, LOW = "A-ZÀ-ÖØ-Þ", "a-zß-öø-ÿ"
CAP = rf"[{UP}][{LOW}]+(?:[-’'][{UP}][{LOW}]+)*"
# Words that end the name of a street, and how letters are addressed.
STREET = r"(?:Street|St|Lane|Ln|Road|Rd|Quay|Row|Close|Cl|Terrace|Ter|Hill|Avenue|Ave|Drive|Dr|Way|Court|Ct|Square|Sq|Crescent|Cres|Place|Pl|Gardens|Gdns|Walk|Grove|Mews|Park|Parade|Rise|Green|Yard)\b\.?"
STREET_DE = r"(?:stra(?:ß|ss)e|str\.|weg|gasse|allee|platz|ring|damm|ufer|steig|pfad|hof|chaussee)"
STREET_FR = r"(?:rue|avenue|impasse|boulevard|place|chemin|allée|quai|route|cours|square|passage|ruelle|sentier|villa)"
BUILDING = r"(?:Cottage|House|Lodge|Farm|Hall|Villa|Manor|Mill)"
POSTCODE = r"(?:\s[A-Z]{1,2}\d{1,2}[A-Z]?\s\d[A-Z]{2}\b)?"
TOWN = rf"{CAP}{POSTCODE}"
DIGIT_WORD = r"(?:zero|oh|one|two|three|four|five|six|seven|eight|nine)"
EXTENSION = r"(?:,?\s(?:ext\.?|extension|x|Durchwahl|poste)\s?\d{1,5})?"
AT, DOT = r"(?:\s?@\s?|\s?[\[({]\s?(?:at|AT|ät)\s?[\])}]\s?)", r"(?:\.|\s?[\[({]\s?(?:dot|DOT|punkt|point)\s?[\])}]\s?)"

STATE_ZIP = r"(?:,?\s[A-Z]{2}\s\d{5}(?:-\d{4})?)"

# What a text must have for a pattern to be tried, each cheap to see.
NEEDS = {
    "at": lambda t: "@" in t or bool(_BRACKETED_AT.search(t)),
    "digit": lambda t: bool(_DIGIT.search(t)),
    "six digits": lambda t: bool(_SIX.search(t)),
    "box": lambda t: "Box" in t,
    "building": lambda t: any(x in t for x in ("Cottage,", "House,", "Lodge,", "Farm,", "Hall,", "Villa,", "Manor,", "Mill,")),
    "german street": lambda t: any(x in t for x in ("str", "weg", "gasse", "allee", "platz", "ring", "damm", "ufer", "steig", "pfad", "hof", "chaussee")) and bool(_FOUR.search(t)),
    "french street": lambda t: bool(_FOUR.search(t)) and any(x in t for x in STREET_FR[3:-1].split("|")),
    "digit word": lambda t: bool(_TWO_DIGIT_WORDS.search(t.lower())),
}
_BRACKETED_AT = re.compile(r"[\[({]\s?(?:at|AT|ät)\s?[\])}]")
# Six digits with nothing but layout, or a letter or two, between them.
_DIGIT, _FOUR, _SIX = re.compile(r"\d"), re.compile(r"\d{4}"), re.compile(r"\d(?:[\s./()+-]{0,3}\d){5}")
_TWO_DIGIT_WORDS = re.compile(rf"\b{DIGIT_WORD}[\s,-]+{DIGIT_WORD}\b")

PATTERNS: list[tuple[str, str, re.Pattern[str]]] = [
    ("email", "at", re.compile(rf"(?<![\w.%+-])[\w%+-]+(?:\.[\w%+-]+)*{AT}[\w-]+(?:{DOT}[\w-]+)+")),
    ("address", "digit", re.compile(rf"(?=\d)(?<!\w)\d{{1,5}}\s(?:{CAP}\s){{1,3}}{STREET},\s(?:{CAP}\s?){{1,3}}{STATE_ZIP}")),
    ("address", "digit", re.compile(rf"(?=[F\d])(?<!\w)(?:Flat\s\d+[A-Za-z]?,\s)?\d{{1,4}}[A-Za-z]?,?\s(?:{CAP}\s){{1,3}}{STREET},\s{TOWN}")),
    ("address", "building", re.compile(rf"(?<!\w)(?:{CAP}\s){{1,2}}{BUILDING},\s(?:{CAP}\s){{1,3}}{STREET},\s{TOWN}")),
    ("address", "box", re.compile(rf"(?<!\w)P\.?\s?O\.?\sBox\s\d+,\s{TOWN}")),
    ("address", "german street", re.compile(rf"(?<!\w)[{UP}][{LOW}]+{STREET_DE}\s\d+(?:\s?[a-z]\b)?,\s\d{{4,5}}\s{CAP}")),
    ("address", "french street", re.compile(rf"(?=\d)(?<!\w)\d{{1,4}}(?:\s?(?:bis|ter|quater|[A-D]))?,?\s{STREET_FR}\s(?:d(?:e|u|es|e la)\s)?{CAP},\s\d{{5}}\s{CAP}")),
    ("id_number", "six digits", re.compile(r"(?=[A-Z])(?<![\w/])[A-Z]{2}\d{2}(?:\s?\d{4}){3,7}(?:\s?\d{1,3})?(?![\w/])")),
    ("id_number", "six digits", re.compile(r"(?<![\w/])(?:[A-Z]{2}\s?(?:\d{6}|\d{2}\s\d{2}\s\d{2})\s?[A-Z]|[a-z]{2}\s?\d{6}\s?[a-z])(?![\w/])")),
    ("id_number", "six digits", re.compile(r"(?=[A-Z])(?<![\w/])[A-Z]\d{8}(?![\w/])")),
    ("id_number", "six digits", re.compile(r"(?=\d)(?<![\w.])\d{1,2}\.\d{3}\.\d{3}-[\dKk](?![\w])")),
    ("id_number", "six digits", re.compile(r"(?=\d)(?<![\w/-])\d{3}-\d{2}-\d{4}(?![\w/-])")),
    ("id_number", "six digits", re.compile(r"(?=\d)(?<![\w.,+/-])(?<!\d\s)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])[-+/\s]\d{4}(?![\w/]|[.,]\d)(?!\s\d)")),
    ("card", "six digits", re.compile(r"(?=\d)(?<![\w/+.,-])(?<!\d\s)\d{4}([ -]?)\d{4}\1\d{4}\1\d{1,7}(?![\w/-])(?!\s\d)")),
    ("phone", "six digits", re.compile(rf"(?=[+0])(?<![\w+])(?:\+|00)\d{{1,3}}(?:\s?\(0\))?(?:[\s./-]?\d{{2,7}}){{2,6}}\b{EXTENSION}")),
    ("phone", "six digits", re.compile(rf"(?=[(0])(?<![\w.,/-])(?:\(0\d{{1,4}}\)\s?|0\d{{1,4}}[\s./-])\d{{3,4}}[\s./-]?\d{{4}}\b{EXTENSION}")),
    ("phone", "six digits", re.compile(rf"(?=\d)(?<![\w.,/-])0\d{{9,10}}\b{EXTENSION}")),
    ("phone", "six digits", re.compile(r"(?=\d)(?<![\w.,/-])(?<!\d\s)\d{3}[\s-]\d{4},?\s(?:ext\.?|extension|x)\s?\d{1,5}\b")),
    ("phone", "digit word", re.compile(rf"(?<!\w){DIGIT_WORD}(?:[\s,-]+{DIGIT_WORD}){{6,14}}(?!\w)", re.I)),
]
#: Numbers that only the words before them tell: a short phone number, and a number of an identity paper or account.
SHORT_PHONE = re.compile(r"(?<![\w.,/-])(?<!\d\s)(?:\(?\d{3}\)?[\s.-])?\d{3}[\s.-]?\d{4}\b(?!\s\d)")
PHONE_CUE = re.compile(r"(?:\b(?:tel|telephone|phone|mobile|cell|fax|call|ring|rang|rung|reach|reached|dial|number|telefon|nummer|rufen|numéro|téléphone|appeler)\b|tel\.)[^\d\n]{0,24}$", re.I)
PAPER = re.compile(r"(?<![\w.,/+-])[A-Z]{0,2}\d{6,12}(?![\w/-])")
PAPER_CUE = re.compile(r"\b(?:passport|identity card|national insurance|social security|ssn|licen[cs]e|account|iban|tax id|taxpayer|ausweis|pass|konto|passeport|compte)(?:\s(?:no|nr|number|id|nummer|numéro)\b\.?)?[\s:#]{1,3}$", re.I)


def luhn(digits: str) -> bool:
    """The check sum of card numbers."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


GIVEN = "(?:" + "|".join(sorted({f for full, (_, short) in SHORT_FORMS.items() for f in (full, *short)}, key=lambda x: (-len(x), x))) + ")"
SURNAME = rf"(?:(?:[OD]['’]|Mc|Mac|von\s|van\s|de\s)?[{UP}][{LOW}]{{2,}}(?:-[{UP}][{LOW}]+)*)"
CAPITALS = rf"[{UP}]{{3,}}(?:-[{UP}]{{2,}})*"
MIDDLE = r"(?:\s[A-Z]\.){0,3}"
NAME = re.compile(rf"(?=[{UP}vd])(?<![\w'’-])(?:(?P<g1>{GIVEN}){MIDDLE}\s(?P<s1>{SURNAME}|{CAPITALS})|(?P<s2>{CAPITALS}|{SURNAME}),\s(?P<g2>{GIVEN}|[A-Z]\.){MIDDLE}|(?P<g3>[A-Z])\.{MIDDLE}\s(?P<s3>{SURNAME}|{CAPITALS}))(?![\w-]|\s(?:{STREET}|{BUILDING}|Foundation|Trust|Prize|Award|Library|School|Hospital|Institute|Act|Bill|Report|Committee|Alliance|Group|Union|Bench)\b)")
# Titles and other words that stand before a name whichever it is, and the offices that are written like one.
TITLED = re.compile(r"(?=[A-Zacdgmsw])(?:\b(?:Mr|Mrs|Ms|Miss|Mx|Dr|Prof|Herrn?|Frau|Mme|Mlle|Madame|Monsieur)\.?|\b[Cc]ontact|\b[Aa]sk for|\b[Ww]rite to|\b[Ss]igned:?|\b[Aa]ttn:?|\b[Dd]ear|\b[Ss]incerely,|\b[Mm]y name is|\bAnsprechpartner(?:in)?:?|\bKontakt:?|\bgez\.|\b[Ss]igné:?)\s(?=[A-ZÀ-Þ])")
OFFICES = frozenset("speaker president chair chairman chairwoman chairperson minister secretary deputy madam madame commissioner member members leader prime first vice acting honourable state foreign house committee council commission parliament government ministry clerk order president präsident präsidentin vizepräsident vizepräsidentin ministerin staatssekretär kanzler kanzlerin abgeordnete abgeordneter kollege kollegin vorsitzende vorsitzender président présidente ministre secrétaire député députée".split())
AND = r"\s(?:and|und|et|&)\s(?:(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herrn?|Frau|Mme|Mlle)\.?\s)?"
# Words after which a person is named, for given names that no list has.
CUE = re.compile(r"(?:Applicant:|[Nn]amed?:?|\bfile of|\bcase of|lodged by|letter from|signs as|signed by|said of|of mine,|neighbour|gallery,|patient|claimant|Antrag von|\bFall|[Ss]chrieb|Akte von|lettre de|dossier de|m['’]écrit)\s(?:(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|M|Mme|Dame|Sir)\.?\s)?(?=[A-ZÀ-Þ])")
NOT_AFTER = rf"(?![\w-]|\s(?:{STREET}|{BUILDING}|Foundation|Trust|Prize|Award|Library|School|Hospital|Institute|Act|Bill|Report|Committee|Alliance|Group|Union|Bench)\b)"
ANY = re.compile(rf"(?P<g1>{CAP}){MIDDLE}\s(?P<s1>{SURNAME})(?![\w-])|(?P<s2>{CAPITALS}),\s(?P<g2>{CAP}){MIDDLE}(?![\w-])")
JOINED = re.compile(rf"{AND}(?P<g1>{CAP}){MIDDLE}\s(?P<s1>{SURNAME}){NOT_AFTER}")
JOINED_BEFORE = re.compile(rf"(?<![\w'’.-])(?<!\w\s)(?P<g1>{CAP}){MIDDLE}\s(?P<s1>{SURNAME}){AND}$")
#: What each alternative of CUE has.
CUE_WORDS = ("Applicant:", "amed", "file of", "case of", "lodged by", "letter from", "signs as", "signed by", "said of", "of mine,", "neighbour", "gallery,", "patient", "claimant", "Antrag von", "Fall", "chrieb", "Akte von", "lettre de", "dossier de", "écrit")
#: A name that opens a turn: it stands first in its line or sentence, perhaps with a party in brackets, before a colon.
OPENS = re.compile(r"(?:^|[\n\r]|[.!?)\]>—:…“”\"]\s)\s*(?:\W*(?:Mr|Mrs|Ms|Dr|Prof|Sir|Dame|Lord|Lady|Herr|Frau|M|Mme)\.?\s)?$")
TURN = re.compile(r"\s*(?:[(\[][^()\[\]\n]{0,60}[)\]])?\s*:")
MEMBER = re.compile(r"(?:[Hh]onou?rable|[Hh]on\.|[Mm]ember|[Mm]inister|[Cc]olleague|Abgeordneten?r?|député(?:e|s)?|ministre|Kollegen?|Kollegin)\s(?:(?:Member|friend|Mr|Mrs|Ms|Dr|Prof)\.?\s)*$")
IN_BRACKETS = re.compile(r"[(\[]\s*$")


def fold(s: str) -> str:
    """Lower case, without accents that typing adds or loses."""
    return "".join(c for c in unicodedata.normalize("NFKD", s.lower()) if not unicodedata.combining(c) and c.isalnum())


_OFFICES = frozenset(map(fold, OFFICES))


class Roll:
    """Members, told from private persons under any spelling of their names."""

    def __init__(self, full_names: Iterable[str], parties: Iterable[str] = ()) -> None:
        self.party_words = {fold(w) for p in parties for w in p.split()}
        self.by_letter: dict[str, list[tuple[str, str]]] = {}
        self.exact: dict[str, list[str]] = {}
        for full in full_names:
            parts = full.split()
            if len(parts) >= 2:
                given, surname = fold(parts[0]), fold(parts[-1])
                self.exact.setdefault(surname, []).append(given)
                self.by_letter.setdefault(surname[0], []).append((surname, given))

    def has(self, given: str, surname: str) -> bool:
        """A member's surname, exactly or with a slip of the keyboard, and a given name, short form or initial that agrees."""
        g, s = fold(given), fold(surname)
        if not g or not s:
            return False
        if any(may_be(g, m) for m in self.exact.get(s, ())):
            return True
        return any(abs(len(m) - len(s)) <= 1 and 2 * lcs_length(s, m) >= len(s) + len(m) - 2 and may_be(g, x) for m, x in self.by_letter.get(s[0], ()))


def find(text: str | None, roll: Roll, speaker: str | None = None) -> list[tuple[str, str, int, int]]:
    """(kind, value, start, end) of each piece, in order and without overlap; of overlapping ones the earlier pattern's."""
    if not text:
        return []
    taken: list[tuple[int, int]] = []  # ordered, without overlap
    out = []

    def free(a: int, b: int) -> bool:
        i = bisect(taken, (a, b))
        return (i == 0 or taken[i - 1][1] <= a) and (i == len(taken) or b <= taken[i][0])

    def add(kind: str, a: int, b: int) -> None:
        insort(taken, (a, b))
        out.append((kind, text[a:b], a, b))

    has: dict[str, bool] = {}
    for kind, need, pattern in PATTERNS:
        if need not in has:
            has[need] = NEEDS[need](text)
        if not has[need]:
            continue
        for m in pattern.finditer(text):
            if free(*m.span()):
                if kind != "card":
                    add(kind, *m.span())
                elif 13 <= len(digits := re.sub(r"\D", "", m.group())) <= 19 and luhn(digits):
                    add("id_number", *m.span())
    if has["six digits"]:
        for kind, pattern, before in (("id_number", PAPER, PAPER_CUE), ("phone", SHORT_PHONE, PHONE_CUE)):
            for m in pattern.finditer(text):
                if free(*m.span()) and before.search(text[max(0, m.start() - 60) : m.start()]):
                    add(kind, *m.span())
    said_by = fold(speaker or "")
    firsts = {w[0] for w in map(fold, re.split(r"[\s,._]+", speaker or "")) if w}

    def private(m) -> bool:  # noqa: ANN001
        given, surname = next(m[g] for g in ("g1", "g2", "g3") if m[g]).rstrip("."), next(m[s] for s in ("s1", "s2", "s3") if m[s])
        return not roll.has(given, surname) and not (said_by and fold(surname) in said_by and fold(given)[:1] in firsts)

    pos = 0
    while m := NAME.search(text, pos):
        a, b = m.span()
        pos = b
        before = text[max(0, a - 40) : a]
        if not free(a, b):
            pos = a + 1
        elif m["g3"] and (fold(m["s3"]) in roll.party_words or IN_BRACKETS.search(before) and re.match(r"[)\]]\s*:", text[b : b + 9])):
            pass  # an abbreviated party
        elif m["s2"] and not m["s2"].isupper() and fold(m["s2"]) in FULL:
            pos = a + len(m["s2"])  # two persons in a row
        elif not MEMBER.search(before) and not (TURN.match(text, b) and OPENS.search(before)) and private(m):
            add("name", a, b)
    for cue in CUE.finditer(text) if any(x in text for x in CUE_WORDS) else ():
        m = ANY.match(text, cue.end())
        if m and free(*m.span()) and fold(m["g1"] or m["g2"]) not in FULL and private(_Named(m)):
            add("name", *m.span())

    def person(m: re.Match[str] | None, a: int, b: int) -> bool:
        """Whether two capitalised words that no list has are a person's name and no office, party, member, speaker or opener of a turn."""
        if not m or not free(a, b) or m.group("g1") is None:
            return False
        g, f = fold(m["g1"]), fold(m["s1"])
        return g not in FULL and not {g, f} & (_OFFICES | roll.party_words) and not TURN.match(text, b) and not MEMBER.search(text[max(0, a - 40) : a]) and private(_Named(m))

    for cue in TITLED.finditer(text):
        m = ANY.match(text, cue.end())
        if m and person(m, *m.span()) and re.match(NOT_AFTER, text[m.end() :]):
            add("name", *m.span())
    # Whoever is named beside a person is one too.
    queue = [(a, b) for kind, _, a, b in out if kind == "name"]
    while queue:
        a, b = queue.pop()
        for m in (JOINED.match(text, b), JOINED_BEFORE.search(text, max(0, a - 80), a)):
            if m and person(m, m.start("g1"), m.end("s1")):
                add("name", m.start("g1"), m.end("s1"))
                queue.append((m.start("g1"), m.end("s1")))
    return sorted(out, key=lambda x: x[2])


class _Named:
    """The groups of ANY, read as those of NAME."""

    def __init__(self, m: re.Match[str]) -> None:
        self.m = m

    def __getitem__(self, group: str) -> str | None:
        return None if group in ("g3", "s3") else self.m[group]


SPAN = "doc_id bigint, kind string, value string, start int, stop int"


def detect(docs: DataFrame, members: DataFrame) -> DataFrame:
    """(doc_id, kind, value, start, stop) of every piece of personal information in whole texts.

    ``members`` (full_name, party) is the roll of those who are not meant, a table
    of a fixed size, sent to each executor.  Null, empty and blank texts hold
    nothing.
    """
    names = [r["full_name"] for r in members.select("full_name").dropna().toLocalIterator()]
    parties = [r["party"] for r in members.select("party").dropna().distinct().toLocalIterator()]
    shared = docs.sparkSession.sparkContext.broadcast((names, parties))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll = Roll(*shared.value)
        for b in batches:
            rows = [(d, *x) for d, t, s in zip(*(b.column(i).to_pylist() for i in range(3))) for x in find(t, roll, s)]
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32()))], names=["doc_id", "kind", "value", "start", "stop"])

    return spread(docs.where(F.length("text") > 0), "doc_id", "text", "speaker").mapInArrow(run, SPAN)


def name_parts(value: str) -> list[tuple[str, int, int]]:
    """(part, start, stop) of a name as written, part being 'given', 'initial', 'surname' or 'middle' (a further initial).

    Listed given names are known by themselves.  Of other names the words
    before a comma are the surname, else the last word is, and a single
    letter with or without a dot is an initial.
    """
    if m := NAME.fullmatch(value):
        kinds = {"s": "surname", "g": "given"}
        parts = [(kinds[g[0]], *m.span(g)) for g in ("g1", "s1", "g2", "s2", "g3", "s3") if m[g]]
        return _with_middle(value, [("initial" if p == "given" and len(value[x:y].rstrip(".")) == 1 else p, x, y) for p, x, y in parts])
    words = [(m.group(), m.start(), m.end()) for m in re.finditer(r"[^\W\d_]+(?:[-’'][^\W\d_]+)*\.?", value)]
    if not words:
        return []
    comma = value.find(",")
    last = max((k for k, w in enumerate(words) if comma < 0 or w[1] < comma), default=len(words) - 1)
    given = next((k for k, w in enumerate(words) if k != last and (comma < 0 or w[1] > comma)), None)
    out = [("surname", *words[last][1:])]
    if given is not None:
        one = len(words[given][0].rstrip(".")) == 1 and script(words[given][0]) in ("LATIN", *_SCRIPTS)
        out.append(("initial" if one else "given", *words[given][1:]))
    return _with_middle(value, out)


def _with_middle(value: str, parts: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    middle = [("middle", *m.span()) for m in re.finditer(r"(?<![\w’'-])[^\W\d_](?=\.)", value)]
    return sorted([*parts, *(x for x in middle if not any(a <= x[1] < b for _, a, b in parts))], key=lambda x: x[1])


def canonical(kind: str, value: str) -> str:
    """What all forms of one entity share: letters and digits without layout; of a name, surname and given name in that order."""
    if kind == "name":
        parts = {p: fold(value[x:y]) for p, x, y in name_parts(value)}
        if "surname" in parts and {"given", "initial"} & parts.keys():
            given = parts.get("given") or parts["initial"]
            return f"{parts['surname']}|{min(FULL.get(given, {given}))}"
    if kind == "email":
        value = re.sub(DOT, ".", re.sub(AT, "@", value))
        return "".join(value.lower().split())
    return re.sub(r"[\W_]+", "", value.lower())


def _stream(key: str, *parts: object) -> Iterator[int]:
    """Keyed bytes without end: the same key and parts always give the same."""
    i = 0
    while True:
        yield from hashlib.blake2b("\x1f".join(map(str, (*parts, i))).encode(), key=key.encode()[:64], digest_size=64).digest()
        i += 1


_ONSET, _VOWEL, _CODA = ("b", "d", "f", "g", "k", "l", "m", "n", "p", "r", "s", "t", "v", "w", "z"), "aeiou", ("", "l", "m", "n", "r", "s", "t")


# Letters of other scripts from which names are made in the same way; of scripts without such letters signs are exchanged one by one.
_SCRIPTS = {
    "CYRILLIC": (tuple("бвгдзклмнпрст"), "аеиоу", ("", "в", "к", "л", "н", "р", "с")),
    "GREEK": (tuple("βγδζκλμνπρστ"), "αειου", ("", "ν", "ρ", "σ")),
}


def script(word: str) -> str:
    """The script of a word's first letter, as Unicode names it."""
    return next((unicodedata.name(c, "LATIN").split()[0] for c in word if c.isalpha()), "LATIN")


def _word(bytes_: Iterator[int], like: str, initial: str = "") -> str:
    """A pronounceable word in the case, script and about the length of ``like``, perhaps with a given first letter."""
    of = script(like)
    if of not in ("LATIN", *_SCRIPTS):
        return "".join(chr(ord(c) - ord(c) % 64 + next(bytes_) % 64) if c.isalpha() else c for c in like)
    onset, vowel, coda = _SCRIPTS.get(of, (_ONSET, _VOWEL, _CODA))
    out = initial.lower()
    if out and out not in vowel:
        out += vowel[next(bytes_) % len(vowel)] + coda[next(bytes_) % len(coda)]
    while len(out) < max(3, len(like) - 1):
        out += onset[next(bytes_) % len(onset)] + vowel[next(bytes_) % len(vowel)] + coda[next(bytes_) % len(coda)]
    return out.upper() if like.isupper() and len(like) > 1 else out.capitalize() if like[:1].isupper() else out


def _given(key: str, surname: str, old: str) -> str:
    """The given name that stands for another one of a family: its first letter is that which stands for the old first letter, so that initials agree; of the same gender where that is known."""
    full = min(FULL.get(fold(old), {fold(old)}))
    if script(old) == "LATIN" and GENDER.get(fold(old)):
        letter = _initial(key, surname, full[:1])
        pool = sorted(n for n, (g, _) in SHORT_FORMS.items() if g == GENDER[fold(old)] and n[0] == letter and n.lower() != full)
        if pool:
            return pool[next(_stream(key, "g", full)) % len(pool)]
    stream = _stream(key, "g", full)
    return _word(stream, old, _initial(key, surname, fold(old)[:1]) if script(old) == "LATIN" else "")


def _initial(key: str, surname: str, old: str) -> str:
    """The letter that stands for the initial of a given name in a family, one with which given names of either gender begin."""
    letters = sorted({n[0] for n, (g, _) in SHORT_FORMS.items() if g == "f"} & {n[0] for n, (g, _) in SHORT_FORMS.items() if g == "m"})
    return letters[next(_stream(key, "i", surname, old.upper())) % len(letters)]


def surrogate(kind: str, value: str, key: str, attempt: int = 0) -> str:
    """A replacement of the same kind and form: digits for digits, letters for letters, a name of the same gender and script.

    Parts of a name are replaced by themselves, so that all forms of one name
    stay forms of one other name, initials included, and relatives keep a
    common surname.  Names that no list has are taken apart by their form.
    ``attempt`` gives another choice if this one collides.
    """
    if kind == "name" and (parts := name_parts(value)):
        out, shift = value, 0
        surname = next((fold(value[x:y]) for p, x, y in parts if p == "surname"), "")
        for part, a, b in parts:
            old = value[a:b]
            if part == "surname":
                new = "-".join(_word(_stream(key, "s", fold(x), attempt), x) for x in old.split("-"))
            elif part in ("initial", "middle"):
                new = _initial(key, surname, old[0]) + old[1:]
            else:
                new = _given(key, surname, old)
                new = new.upper() if old.isupper() and len(old) > 1 else new
            out = out[: a + shift] + new + out[b + shift :]
            shift += len(new) - len(old)
        return out
    if kind == "phone" and not any(c.isdigit() for c in value):
        said, bytes_ = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"), _stream(key, kind, canonical(kind, value), attempt)
        return re.sub(DIGIT_WORD, lambda _: said[next(bytes_) % 10], value, flags=re.I)
    bytes_ = _stream(key, kind, canonical(kind, value), attempt)
    out = ""
    if kind == "phone":
        # What makes it a number stays: +, leading zeros, a zero in brackets, the word for an extension.
        m = re.match(r"(?:\+|00|0|\(0)?", value)
        out, i = m.group(), m.end()
        for j in range(i, len(value)):
            c = value[j]
            out += c if not c.isdigit() or value[j - 1 : j + 2] == "(0)" else str(1 + next(bytes_) % 9)
        return out
    if m := re.fullmatch(r"(\d{6})([-+/\s])(\d{4})", value):
        return f"{next(bytes_) % 100:02}{1 + next(bytes_) % 12:02}{1 + next(bytes_) % 28:02}{m[2]}{next(bytes_) % 100:02}{next(bytes_) % 100:02}" if kind == "id_number" else value
    if m := re.fullmatch(r"([\d.]+-)[Kk]", value):
        return re.sub(r"\d", lambda _: str(next(bytes_) % 10), m[1]) + value[-1]
    if kind in ("email", "address"):
        keep = rf"^(?:at|dot|AT|DOT|example|com|net|org|test|PO|Box|Flat|bis|ter|quater|{STREET_FR}|d|de|du|des|la|{BUILDING}|{STREET[:-3]})$"
        for part in re.findall(r"[^\W\d_]+|\d|.", value, re.S):
            if part.isdigit():
                out += str(next(bytes_) % 10) if out[-1:].isdigit() else str(1 + next(bytes_) % 9)
            elif not part.isalpha() or re.match(keep, part):
                out += part
            elif len(part) == 1:
                out += chr((65 if part.isupper() else 97) + next(bytes_) % 26) if part.isupper() or kind == "email" else part
            elif kind == "address" and (m := re.fullmatch(rf"(.+?)({STREET_DE})", part)):
                out += _word(bytes_, m[1]) + m[2]
            elif kind == "address" and part.isupper():
                out += "".join(chr(65 + next(bytes_) % 26) for _ in part)
            else:
                out += _word(bytes_, part)
        return out
    for c in value:
        out += str(next(bytes_) % 10) if c.isdigit() else (chr((65 if c.isupper() else 97) + next(bytes_) % 26) if c.isascii() and c.isalpha() else c)
    return out


def surrogates(found: DataFrame, key: str, max_rounds: int = 20) -> DataFrame:
    """(kind, value, entity, attempt, surrogate) of each different value; different entities get different surrogates.

    One keyed choice per value.  A surrogate that stands for two entities,
    or is itself a value of the texts, is refused for all but the least
    entity, which are given their next choice, until none collides.  The
    check is by hash of (kind, surrogate): a table of values, never of rows.
    """

    @F.arrow_udf("string")
    def entity(kind: pa.Array, value: pa.Array) -> pa.Array:
        return pa.array([canonical(k, v) for k, v in zip(kind.to_pylist(), value.to_pylist())], pa.string())

    @F.arrow_udf("string")
    def choose(kind: pa.Array, value: pa.Array, attempt: pa.Array) -> pa.Array:
        return pa.array([surrogate(k, v, key, n) for k, v, n in zip(kind.to_pylist(), value.to_pylist(), attempt.to_pylist())], pa.string())

    values = found.select("kind", "value").distinct().withColumn("entity", entity("kind", "value"))
    state = cut(values.withColumn("attempt", F.lit(0)).withColumn("surrogate", choose("kind", "value", F.col("attempt"))))
    for _ in range(max_rounds):
        taken = state.select("kind", F.col("value").alias("surrogate"), F.lit("").alias("entity")).unionByName(state.select("kind", "surrogate", "entity"))
        least = taken.groupBy("kind", "surrogate").agg(F.min("entity").alias("first"), F.max("entity").alias("last")).where(F.col("first") != F.col("last"))
        bad = cut(state.join(least, ["kind", "surrogate"]).where(F.col("entity") != F.col("first")).select("kind", "entity").distinct())
        if bad.isEmpty():
            return state
        again = state.join(bad, ["kind", "entity"]).withColumn("attempt", F.col("attempt") + 1).drop("surrogate")
        again = again.withColumn("surrogate", choose("kind", "value", "attempt"))
        state = cut(state.join(bad, ["kind", "entity"], "left_anti").unionByName(again, allowMissingColumns=True).select("kind", "value", "entity", "attempt", "surrogate"))
    raise RuntimeError("surrogates keep colliding")


def pseudonyms(docs: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """(doc_id, kind, value, start, stop, surrogate) of every piece in whole texts, with what is to stand in its place.

    The whole operator: detection, keyed surrogates of the same form, and
    their check for collisions over all texts.
    """
    found = cut(detect(docs, members))
    return found.join(surrogates(found, key).select("kind", "value", "surrogate").hint("merge"), ["kind", "value"]).select("doc_id", "kind", "value", "start", "stop", "surrogate")


def replaced(docs: DataFrame, found: DataFrame, chosen: DataFrame) -> DataFrame:
    """(doc_id, text): each text with its pieces replaced; texts without any are left as they are, null included."""
    spans = found.join(chosen.select("kind", "value", "surrogate"), ["kind", "value"])
    spans = spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "stop", "surrogate"))).alias("spans"))

    @F.arrow_udf("string")
    def put(text: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for t, s in zip(text.to_pylist(), spans.to_pylist()):
            at, parts = 0, []
            for x in s or ():
                parts += [t[at : x["start"]], x["surrogate"]]
                at = x["stop"]
            out.append(None if t is None else "".join(parts) + t[at:])
        return pa.array(out, pa.string())

    both = docs.select("doc_id", "text").join(spans, "doc_id", "left")
    return both.select("doc_id", put("text", "spans").alias("text"))
