"""Given names with the short forms people use for them."""

from __future__ import annotations

# Given names, their gender and common short forms.
SHORT_FORMS: dict[str, tuple[str, tuple[str, ...]]] = {
    "Albert": ("m", ("Al",)),
    "Alexander": ("m", ("Alex", "Xander")),
    "Alfred": ("m", ("Alf", "Alfie")),
    "Alice": ("f", ()),
    "Amanda": ("f", ("Mandy",)),
    "Andrew": ("m", ("Andy", "Drew")),
    "Angela": ("f", ("Angie",)),
    "Anna": ("f", ("Annie",)),
    "Anthony": ("m", ("Tony", "Ant")),
    "Barbara": ("f", ("Barb", "Babs")),
    "Beatrix": ("f", ("Bea", "Trix", "Trixie")),
    "Benjamin": ("m", ("Ben", "Benny")),
    "Bernard": ("m", ("Bernie",)),
    "Caroline": ("f", ("Carrie", "Caro")),
    "Charles": ("m", ("Charlie", "Chuck")),
    "Charlotte": ("f", ("Lottie",)),
    "Christine": ("f", ("Chrissie",)),
    "Christopher": ("m", ("Chris", "Kit", "Topher")),
    "Claire": ("f", ()),
    "Clementine": ("f", ("Clem", "Clemmie")),
    "Cynthia": ("f", ("Cindy",)),
    "Daniel": ("m", ("Dan", "Danny")),
    "David": ("m", ("Dave", "Davy")),
    "Deborah": ("f", ("Deb", "Debbie", "Debs")),
    "Donald": ("m", ("Don", "Donnie")),
    "Dorothy": ("f", ("Dot", "Dottie")),
    "Douglas": ("m", ("Doug",)),
    "Edward": ("m", ("Ed", "Eddie", "Ted", "Teddy", "Ned")),
    "Eleanor": ("f", ("Ellie", "Nora")),
    "Elizabeth": ("f", ("Liz", "Lizzie", "Beth", "Betty", "Eliza", "Libby", "Bess")),
    "Emily": ("f", ("Emmy",)),
    "Emma": ("f", ()),
    "Eugene": ("m", ("Gene",)),
    "Florence": ("f", ("Flo", "Florrie", "Flossie")),
    "Frances": ("f", ("Fran",)),
    "Francis": ("m", ("Frank",)),
    "Frederick": ("m", ("Fred", "Freddie", "Freddy")),
    "Friedrich": ("m", ("Fritz",)),
    "Gabriel": ("m", ("Gabe",)),
    "Geoffrey": ("m", ("Geoff",)),
    "George": ("m", ("Georgie",)),
    "Gerald": ("m", ("Gerry", "Jerry")),
    "Gregory": ("m", ("Greg",)),
    "Hannah": ("f", ()),
    "Harold": ("m", ("Harry", "Hal")),
    "Harriet": ("f", ("Hattie",)),
    "Heinrich": ("m", ("Heinz",)),
    "Helen": ("f", ()),
    "Henrietta": ("f", ("Hetty", "Hettie", "Etta", "Henny")),
    "Henry": ("m", ("Hank",)),
    "Imogen": ("f", ("Immy", "Immie", "Imo")),
    "Isabel": ("f", ("Izzy", "Bella")),
    "Jacob": ("m", ("Jake",)),
    "Jacqueline": ("f", ("Jackie",)),
    "James": ("m", ("Jim", "Jimmy", "Jamie")),
    "Janet": ("f", ("Jan",)),
    "Jean": ("m", ()),
    "Jennifer": ("f", ("Jen", "Jenny")),
    "Jeremiah": ("m", ("Jerry", "Jem", "Jeremy")),
    "Jessica": ("f", ("Jess",)),
    "Johann": ("m", ("Hans",)),
    "John": ("m", ("Jack", "Johnny")),
    "Jonathan": ("m", ("Jon", "Jonny")),
    "Joseph": ("m", ("Joe", "Joey")),
    "Josephine": ("f", ("Jo", "Josie", "Josey")),
    "Joshua": ("m", ("Josh",)),
    "Judith": ("f", ("Judy",)),
    "Julia": ("f", ("Julie",)),
    "Katherine": ("f", ("Kate", "Katie", "Kathy", "Kath", "Kitty", "Kat")),
    "Kenneth": ("m", ("Ken", "Kenny")),
    "Laura": ("f", ()),
    "Lawrence": ("m", ("Larry", "Laurie", "Lawrie")),
    "Leonard": ("m", ("Leo", "Len", "Lenny")),
    "Linda": ("f", ()),
    "Louis": ("m", ("Lou",)),
    "Lucy": ("f", ()),
    "Madeleine": ("f", ("Maddie",)),
    "Margaret": ("f", ("Maggie", "Meg", "Peggy", "Peg", "Madge", "Marge", "Daisy")),
    "Maria": ("f", ()),
    "Marie": ("f", ()),
    "Martin": ("m", ("Marty",)),
    "Mary": ("f", ("Molly", "Polly")),
    "Matthew": ("m", ("Matt", "Matty")),
    "Maximilian": ("m", ("Max",)),
    "Michael": ("m", ("Mike", "Mick", "Mickey", "Micky")),
    "Nathaniel": ("m", ("Nate",)),
    "Nicholas": ("m", ("Nick", "Nicky", "Nico")),
    "Octavia": ("f", ("Tavy", "Tavi", "Tavia")),
    "Oliver": ("m", ("Ollie", "Olly", "Noll")),
    "Pamela": ("f", ("Pam",)),
    "Patricia": ("f", ("Pat", "Patty", "Tricia", "Trish", "Patsy")),
    "Paul": ("m", ()),
    "Penelope": ("f", ("Penny", "Nell")),
    "Peter": ("m", ("Pete",)),
    "Philip": ("m", ("Phil", "Pip")),
    "Pierre": ("m", ()),
    "Rachel": ("f", ()),
    "Raymond": ("m", ("Ray",)),
    "Rebecca": ("f", ("Becky", "Becca")),
    "Richard": ("m", ("Dick", "Rick", "Ricky", "Richie")),
    "Robert": ("m", ("Bob", "Bobby", "Rob", "Robbie", "Bert")),
    "Ronald": ("m", ("Ron", "Ronnie")),
    "Rosalind": ("f", ("Ros", "Roz", "Rosie", "Lindy")),
    "Russell": ("m", ("Russ",)),
    "Samuel": ("m", ("Sam", "Sammy")),
    "Sarah": ("f", ("Sally", "Sadie")),
    "Sebastian": ("m", ("Seb",)),
    "Simon": ("m", ()),
    "Sophia": ("f", ("Sophie",)),
    "Stanley": ("m", ("Stan",)),
    "Stephen": ("m", ("Steve", "Stevie")),
    "Susannah": ("f", ("Sue", "Susie", "Suzy", "Sukie")),
    "Terence": ("m", ("Terry",)),
    "Teresa": ("f", ("Tess",)),
    "Theodora": ("f", ("Thea", "Dora", "Theo", "Teddie")),
    "Thomas": ("m", ("Tom", "Tommy")),
    "Timothy": ("m", ("Tim", "Timmy")),
    "Ulrich": ("m", ("Uli", "Ulli", "Rick")),
    "Valentina": ("f", ("Val", "Tina", "Vally")),
    "Victoria": ("f", ("Vicky", "Tori")),
    "Vincent": ("m", ("Vince",)),
    "Virginia": ("f", ("Ginny",)),
    "Walter": ("m", ("Walt", "Wally")),
    "William": ("m", ("Will", "Bill", "Billy", "Willy", "Liam", "Willie")),
    "Wolfgang": ("m", ("Wolf",)),
    "Yolanda": ("f", ("Yola", "Landa", "Yoli", "Yo")),
    "Zachary": ("m", ("Zach", "Zack", "Zak")),
}

#: Any form in lower case -> the full names it may stand for, itself included.
FULL: dict[str, frozenset[str]] = {}
for _full, (_, _short) in SHORT_FORMS.items():
    for _form in (_full, *_short):
        FULL[_form.lower()] = FULL.get(_form.lower(), frozenset()) | {_full.lower()}

GENDER = {form.lower(): gender for full, (gender, short) in SHORT_FORMS.items() for form in (full, *short)}


def may_be(a: str, b: str) -> bool:
    """Whether two given names, short forms or initials, in lower case, may be one person's."""
    if len(a) == 1 or len(b) == 1:
        others = (FULL.get(b, frozenset()) | {b}) if len(a) == 1 else (FULL.get(a, frozenset()) | {a})
        one = a if len(a) == 1 else b
        return any(x[0] == one for x in others)
    return a == b or bool((FULL.get(a, frozenset()) | {a}) & (FULL.get(b, frozenset()) | {b}))
