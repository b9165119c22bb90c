"""Personal data: entities are found and get keyed surrogates of the same type, gender, script and format.

Kinds: e-mail addresses, telephone, card and social security numbers, IBANs, IP addresses, and persons
as given names and surnames. Persons are found after a title; then the text's other words with a capital (in
scripts without capitals: any words) that are one of these names are mentions too. A given name's gender is
that of the titles it has anywhere in the corpus, none if they differ, so it isn't part of what names an
entity. A mention has a canonical form: digits without separators and in ASCII, addresses and names in lower
case. The surrogate is drawn from a keyed digest of kind, canonical form and attempt, so mentions of one
entity agree wherever and however they are written; it is then written in the mention's format: its
separators, digits of its script, its case. Cards are numbers that pass the Luhn test, and get surrogates
that do, IBANs have and get valid check digits, private IP addresses private ones, numbers keep their
country code; given names keep gender, names and addresses their script. Names of Latin, Cyrillic, Greek,
Arabic and Hebrew script are built of parts; those of any other script, of that script's letters.

Collision checks: all distinct entities of the corpus are a table. An entity whose surrogate another
entity (with a smaller canonical form) has, or that is itself an entity of the corpus, goes to its next
attempt, until none is left. Later attempts draw from larger spaces: names and addresses get longer, numbers
get further digits, IP addresses come from wider networks of their class; so a free one is found however
many entities there are (after MAX_ATTEMPTS attempts, which only more entities than IPv4 addresses can
need, ValueError). Only entities past attempt 0 need to be told to the texts. Up to MAX_BROADCAST of them
are broadcast; beyond, they reach their texts by a join over digests of the texts.

Defined results: null text stays null, and has no entity; repeated rows get equal results; an empty table
gives an empty result; entities that overlap count once, by start and then by the order of KINDS; input
columns with the name of an output give way to it.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, discard, materialise

KINDS = ("email", "iban", "card", "ssn", "ip", "phone", "person")
MAX_BROADCAST = 100_000
#: Attempts of one entity; spaces grow with every EASE of them.
MAX_ATTEMPTS, EASE = 400, 4
#: Titles by gender.
TITLES = {
    "m": ["Mr", "Mister", "Sir", "Herr", "Monsieur", "Señor", "Signor", "господин", "Господин", "κύριος", "Κύριος", "السيد", "מר"],
    "f": ["Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Señora", "Señorita", "Signora", "госпожа", "Госпожа", "κυρία", "Κυρία", "السيدة", "גברת"],
    "n": ["Mx", "Dr", "Prof", "الدكتور"],
}
#: Parts of names by script; endings of given names by gender, of surnames.
PARTS = {
    "latin": ("al be co da el fi ga ha jo ka le ma no or pe ra sa ti vi wen".split(), {"m": "an ert in o us".split(), "f": "a elle ia ine ora".split(), "n": "y is en".split()}, "berg dale er ford ley man sen stein ton well".split()),
    "cyrillic": ("ал бо ва ге да ев жи за ка ли ма ни ол па ро са ти фе".split(), {"m": "ий ан слав ор".split(), "f": "а ия ина ена".split(), "n": "я и".split()}, "енко ский ин ов ук".split()),
    "arabic": ("با جا دا را سا فا لا ما نا بي مي كر حم عل".split(), {"m": "د ر ن س".split(), "f": "ة اء".split(), "n": "ي".split()}, "اني اوي ري دين".split()),
    "hebrew": ("בא גל דן הר זי לב מי נו עד רו שי תמ".split(), {"m": "אל ון ר".split(), "f": "ית ה".split(), "n": "י".split()}, "מן ברג סון לוי".split()),
    "greek": ("αλ βα γε δη ελ θε κα λε μα νι ορ πε ρο σα τι φι".split(), {"m": "ος ης ας".split(), "f": "α η ια".split(), "n": "ι ω".split()}, "άκης ίδης όπουλος άς".split()),
}
_GENDER = {t: g for g, ts in TITLES.items() for t in ts}
_NAME = r"[^\W\d_]+(?:[-'’][^\W\d_]+)*"
_SEP = r"[ \u00a0./()\u2011-]"
#: Country codes of one and two digits; the others have three.
_CODE = re.compile(r"[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{1,3}")
PATTERNS = {
    "email": re.compile(r"(?<![\w.+%-])[\w.+%-]*\w@\w[\w-]*(?:\.\w[\w-]*)+"),
    "iban": re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"),
    "card": re.compile(r"(?<![\w.+-])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7})(?!\w)"),
    "ssn": re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    "ip": re.compile(r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\w)"),
    "phone": re.compile(
        r"(?<![\w+.-])(?:"
        rf"\+1(?:{_SEP}{{0,2}}\d){{10}}"  # +1 and ten digits
        rf"|\+(?:\d{_SEP}{{0,3}}){{7,14}}\d"  # + and 8 to 15 digits
        r"|(?=(?:[ .-]?\d){9,11}(?![ .-]?\d))0\d{1,4}([ .-])\d{2,4}(?:\1\d{2,4}){1,4}"  # groups of two to four after a 0
        r"|(?:(?:\+|00)\d{1,3}[ .-]?|1[ .-])?(?:\(\d{2,5}\)[ .-]?|\d{2,5}[ .-])\d{3,4}[ .-]?\d{3,4}"
        r"|(?:[2-9]\d\d[2-9]\d{6}|0[1-9]\d{8,9})(?![.-]\d)"  # without separators
        r")(?!\w)"
    ),
    "person": re.compile(r"(?<!\w)(" + "|".join(sorted(_GENDER, key=len, reverse=True)) + rf")\.? ((?=[^\W\d_])(?:{_NAME})(?: {_NAME}){{0,2}})"),
}
_WORD = re.compile(rf"(?<!\w){_NAME}(?!\w)")
_LETTERS = re.compile(r"[^\W\d_]+")
_DIGIT = re.compile(r"\d")


#: The country whose numbers are written without a country code, unless given.
REGION = "1"
#: Words before ten bare digits, or four numbers with dots, that are no telephone number, or no address.
NO_PHONE = {"order", "invoice", "ticket", "item", "isbn", "ref", "reference", "serial", "sku", "id"}
NO_ADDRESS = {"version", "release", "build", "section", "chapter", "v"}
_BEFORE = re.compile(r"([^\W\d_]+)[.:#]?[ #]{0,2}$")


def phone_form(text: str, region: str = REGION) -> tuple[str, str, str]:
    """A number's country code (empty where nothing tells it), the digits before the national number as written, and the national number without trunk 0."""
    digits = _digits(text)
    abroad = 0 if text[0] == "+" else 2 if digits.startswith("00") else None
    if abroad is not None:
        code = _CODE.match(digits[abroad:])[0] if len(digits) > abroad else ""
        rest = digits[abroad + len(code) :]
        trunk = rest[:1] if "(0)" in text and rest.startswith("0") else ""
        return code, digits[:abroad] + code + trunk, rest[len(trunk) :]
    if digits.startswith("0"):
        return "" if region in ("1", "7") else region, "0", digits[1:]
    if region == "1" and len(digits) in (10, 11) and (len(digits) == 10 or digits[0] == "1"):
        return "1", digits[:-10], digits[-10:]
    return "", "", digits


def _word_before(text: str, at: int) -> str:
    m = _BEFORE.search(text, max(0, at - 24), at)
    return m[1].lower() if m else ""


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _iban_rest(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def _digits(text: str) -> str:
    return "".join(str(unicodedata.digit(c)) for c in text if c.isdecimal())


#: What this process knows of characters: scripts, and letters by script. (Plain dictionaries, as they travel with the functions.)
_SCRIPTS: dict[str, str] = {}
_LETTERS_OF: dict[str, str] = {}


def _script_of(c: str) -> str:
    s = _SCRIPTS.get(c)
    if s is None:
        s = _SCRIPTS[c] = unicodedata.name(c, "latin").split(" ")[0].split("-")[0].lower()
    return s


def _script(text: str) -> str:
    """The script of a text's first letter outside Latin, as in the letter's Unicode name; else latin."""
    return next((s for c in text if c.isalpha() and (s := _script_of(c)) != "latin"), "latin")


def _letters_of(script: str) -> str:
    """Letters that surrogates of a script are made of: the small ones, or those without case, of its basic range."""
    if script == "latin":
        return "abcdefghijklmnopqrstuvwxyz"
    if script in _LETTERS_OF:
        return _LETTERS_OF[script]
    every = [c for c in map(chr, range(0x80, 0xD7A4)) if c.isalpha() and c == c.lower() and _script_of(c) == script and unicodedata.normalize("NFKC", c) == c]
    cased = [c for c in every if c != c.upper()]
    _LETTERS_OF[script] = "".join(cased or every) or "abcdefghijklmnopqrstuvwxyz"
    return _LETTERS_OF[script]


def _named(word: str) -> bool:
    """Whether a word can be a name: with a capital, or in a script without."""
    return word[0].isupper() or word[0].lower() == word[0].upper()


def _unowned(word: str) -> str:
    return word[:-2] if word[-2:] in ("'s", "’s") else word


def _persons(text: str) -> list[tuple[int, int, list[tuple[int, int, str, str]]]]:
    """Persons as (start, end, parts): names behind titles, then these names wherever else they stand with a capital."""
    titled = []
    for m in PATTERNS["person"].finditer(text):
        names = []
        for n in re.finditer(_NAME, m[2]):  # names go on as long as words have a capital; two words where there are none
            if not _named(n[0]) or len(names) == 2 and not n[0][0].isupper():
                break
            word = _unowned(n[0])
            names.append((n.start() + m.start(2), n.start() + m.start(2) + len(word), word))
            if word != n[0]:
                break
        if names:
            titled.append((_GENDER[m[1]], names))
    if not titled:
        return []
    surnames = {names[-1][2].lower() for _, names in titled if len(names) > 1}
    given: dict[str, set] = {}
    for gender, names in titled:
        for *_, n in names[:-1]:
            given.setdefault(n.lower(), set()).add(gender)
    for gender, names in titled:
        n = names[0][2].lower()
        if len(names) == 1 and n in given and n not in surnames:
            given[n].add(gender)
        elif len(names) == 1:
            surnames.add(n)

    def part(a: int, b: int, n: str, last: bool) -> tuple[int, int, str, str]:
        canon, script = n.lower(), _script(n)
        if canon in surnames and (last or canon not in given):
            return a, b, f"surname--{script}", canon
        known = given[canon] - {"n"}
        return a, b, f"given-{known.pop() if len(known) == 1 else 'n'}-{script}", canon

    out = [(names[0][0], names[-1][1], [part(*n, k == len(names) - 1) for k, n in enumerate(names)]) for _, names in titled]
    taken = {n[0] for _, names in titled for n in names}
    others: list[list] = []  # runs of names that only a space parts
    for m in _WORD.finditer(text):
        whole = _unowned(m[0])
        words = [(m.start(), whole)] if whole.lower() in given or whole.lower() in surnames else [(m.start() + w.start(), w[0]) for w in _LETTERS.finditer(m[0])]
        for a, n in words:
            if a in taken or not _named(n) or n.lower() not in given and n.lower() not in surnames:
                continue
            if others and text[others[-1][-1][1] : a] == " ":
                others[-1].append((a, a + len(n), n))
            else:
                others.append([(a, a + len(n), n)])
    return out + [(run[0][0], run[-1][1], [part(*n, k == len(run) - 1) for k, n in enumerate(run)]) for run in others]


def find(text: str, region: str = REGION) -> list[tuple[int, int, str, list[tuple[int, int, str, str]]]]:
    """Entities as (start, end, kind, parts); a part is (start, end, entity kind, canonical form)."""
    found = []

    def add(kind: str, start: int, end: int, parts: list) -> None:
        found.append((start, KINDS.index(kind), end, kind, parts))

    if "@" in text:
        for m in PATTERNS["email"].finditer(text):
            add("email", *m.span(), [(*m.span(), "email", m[0].lower())])
    if _DIGIT.search(text):
        for m in PATTERNS["iban"].finditer(text):
            plain = m[0].replace(" ", "")
            if plain.isascii() and 15 <= len(plain) <= 34 and _iban_rest(plain) == 1:
                add("iban", *m.span(), [(*m.span(), "iban", plain)])
        for kind in ("card", "ssn", "phone"):
            for m in PATTERNS[kind].finditer(text):
                canon = _digits(m[0])
                if kind == "phone":
                    if not 7 <= len(canon) <= 15:
                        continue
                    if m[0].isdecimal() and _word_before(text, m.start()) in NO_PHONE:
                        continue
                    code, _, rest = phone_form(m[0], region)
                    canon = f"+{code}:{rest}" if code else f":{rest}"
                if kind != "card" or 13 <= len(canon) <= 19 and luhn(canon):
                    add(kind, *m.span(), [(*m.span(), kind, canon)])
        if "." in text:
            for m in PATTERNS["ip"].finditer(text):
                octets = [int(_digits(o)) for o in m[0].split(".")]
                if max(octets) < 256 and _word_before(text, m.start()) not in NO_ADDRESS:
                    add("ip", *m.span(), [(*m.span(), "ip", ".".join(map(str, octets)))])
    for start, end, parts in _persons(text):
        add("person", start, end, parts)
    out, at = [], 0
    for start, _, end, kind, parts in sorted(found, key=lambda f: f[:3]):
        if start >= at:
            out.append((start, end, kind, parts))
            at = end
    return out


class Drawn:
    """Numbers drawn one after another from a keyed digest."""

    def __init__(self, key: bytes, what: str):
        self.key, self.what, self.block, self.held = key, what.encode(), 0, b""

    def below(self, n: int) -> int:
        if len(self.held) < 8:
            self.held = hashlib.blake2b(self.what + self.block.to_bytes(4, "big"), key=self.key).digest()
            self.block += 1
        x, self.held = int.from_bytes(self.held[:8], "big"), self.held[8:]
        return x % n

    def digits(self, n: int) -> str:
        return "".join(str(self.below(10)) for _ in range(n))


def _like(text: str, draw: Drawn, more: int = 0) -> str:
    """Letters of the same script for letters, digits for digits, and so many more letters."""
    out = []
    for c in text:
        if c.isdecimal():
            out.append(chr(ord(c) - unicodedata.digit(c) + draw.below(10)))
        elif c.isalpha():
            letters = _letters_of(_script_of(c))
            out.append(letters[draw.below(len(letters))])
        else:
            out.append(c)
    letters = _letters_of(_script(text))
    return "".join(out) + "".join(letters[draw.below(len(letters))] for _ in range(more))


#: Networks by class, the private ones from narrow to wide.
PRIVATE = ("192.168.0.0/16", "172.16.0.0/12", "10.0.0.0/8")
OTHER_CLASSES = ("127.0.0.0/8", "169.254.0.0/16")


def _address(canon: str, draw: Drawn, attempt: int) -> str:
    """An address of the same class; of ever wider private networks, and at last any."""
    old = ipaddress.ip_address(canon)
    own = next((n for n in (*PRIVATE, *OTHER_CLASSES) if old in ipaddress.ip_network(n)), None)
    if own is not None:
        ladder = [own, *[n for n in PRIVATE if n != own and (own not in PRIVATE or PRIVATE.index(n) > PRIVATE.index(own))], "10.0.0.0/8", "240.0.0.0/4", "0.0.0.0/0"]
        net = ipaddress.ip_network(ladder[min(attempt // (4 * EASE), len(ladder) - 1)])
        return str(net[draw.below(net.num_addresses)])
    while True:
        new = ipaddress.ip_address(draw.below(1 << 32))
        if new.is_global or draw.block > 64:
            return str(new)


def surrogate(key: bytes, kind: str, canon: str, attempt: int = 0) -> str:
    """The canonical form of an entity's surrogate."""
    draw = Drawn(key, f"{kind}|{canon}|{attempt}")
    more = attempt // EASE
    if kind == "email":
        local, _, domain = canon.rpartition("@")
        host, _, top = domain.rpartition(".")
        return f"{_like(local, draw, more)}@{_like(host, Drawn(key, f'domain|{domain}'))}.{top}"
    if kind == "phone":
        code, _, rest = canon.partition(":")
        new = f"{2 + draw.below(8)}{draw.digits(len(rest) - 1 + more)}"
        if code == "+1" and len(rest) == 10:  # the fourth digit can't be 0 or 1
            new = f"{new[:3]}{2 + draw.below(8)}{new[4:]}"
        return f"{code}:{new}"
    if kind == "card":
        body = canon[0] + draw.digits(len(canon) - 2 + more)
        return next(body + c for c in "0123456789" if luhn(body + c))
    if kind == "ssn":
        return f"{1 + draw.below(665):03d}{1 + draw.below(99):02d}{1 + draw.below(9999):04d}{draw.digits(more)}"
    if kind == "iban":
        body = "".join(str(draw.below(10)) if c.isdigit() else chr(65 + draw.below(26)) for c in canon[4:]) + draw.digits(more)
        return f"{canon[:2]}{98 - _iban_rest(canon[:2] + '00' + body):02d}{body}"
    if kind == "ip":
        return _address(canon, draw, attempt)
    what, gender, script = kind.split("-")
    if script not in PARTS:
        return _like(canon, draw, more)
    parts, given, surnames = PARTS[script]
    ends = given[gender] if what == "given" else surnames
    return "".join(parts[draw.below(len(parts))] for _ in range(2 + draw.below(2) + more)) + ends[draw.below(len(ends))]


def formatted(kind: str, mention: str, new: str, region: str = REGION) -> str:
    """A surrogate's canonical form, written as the mention is: a telephone number with the country code or trunk 0 that the mention has, an address with its leading zeros."""
    if kind in ("card", "ssn", "phone", "iban"):
        signs = iter(phone_form(mention, region)[1] + new.partition(":")[2] if kind == "phone" else new)
        out = "".join(c if not c.isalnum() else (lambda d: chr(ord(c) - unicodedata.digit(c) + int(d)) if c.isdecimal() and d.isdigit() else d)(next(signs)) for c in mention)
        return out + "".join(signs)  # of a surrogate that is longer than its entity
    if kind == "ip":
        zero = next((ord(c) - unicodedata.digit(c) for c in mention if c.isdecimal()), 48)
        new = ".".join(n.zfill(len(m)) if _digits(m)[:1] == "0" else n for n, m in zip(new.split("."), mention.split(".")))
        return "".join(chr(zero + int(c)) if c.isdigit() else c for c in new)
    if mention.isupper() and len(mention) > 1:
        return new.upper()
    if kind == "email":
        return "".join(n.upper() if m.isupper() and len(n.upper()) == 1 else n for m, n in zip(mention, new)) if len(mention) == len(new) else new
    return new[:1].upper() + new[1:]


def replace(text: str, key: bytes, attempts: dict, kinds: dict | None = None, region: str = REGION) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with surrogates, and its entities (start, end, kind); kinds: of entities (kind, canon) that have another kind in the corpus than in their text."""
    out, at, found = [], 0, find(text, region)
    for start, end, kind, parts in found:
        for a, b, entity, canon in parts:
            entity = (kinds or {}).get((entity, canon), entity)
            out += [text[at:a], formatted(entity.split("-")[0], text[a:b], surrogate(key, entity, canon, attempts.get((entity, canon), 0)), region)]
            at = b
    return "".join(out) + text[at:], [f[:3] for f in found]


def entities(docs: DataFrame, extra: list[str] = (), region: str = REGION) -> DataFrame:
    """Distinct rows (extra columns, kind, canon) of all texts."""
    extra = list(extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = set()
            for i, text in enumerate(b.column(0).to_pylist()):
                if text:
                    own = tuple(b.column(1 + k)[i].as_py() for k in range(len(extra)))
                    rows |= {(*own, kind, canon) for *_, parts in find(text, region) for _, _, kind, canon in parts}
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*sorted(rows))], [*extra, "kind", "canon"])

    return docs.select("text", *extra).mapInArrow(run, ", ".join(f"{c} string" for c in (*extra, "kind", "canon"))).distinct()


def _drawn(rows: DataFrame, key: bytes) -> DataFrame:
    """Rows (kind, canon, attempt) with their surrogates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = [surrogate(key, *r) for r in zip(*(b.column(i).to_pylist() for i in range(3)))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(new, pa.string())], ["kind", "canon", "attempt", "surrogate"])

    return rows.select("kind", "canon", "attempt").mapInArrow(run, "kind string, canon string, attempt int, surrogate string")


def _family(kind: str) -> Column:
    """A kind without the gender, which is no part of an entity's name."""
    return F.regexp_replace(kind, "^given-.-", "given--")


def resolved(found: DataFrame) -> DataFrame:
    """Rows (kind, canon, as_kind) of rows (kind, canon) of texts: as_kind has the gender over all texts, n where they differ."""
    per = found.withColumn("family", _family("kind")).groupBy("family", "canon").agg(F.collect_set(F.nullif(F.regexp_extract("kind", "^given-(.)-", 1), F.lit("n"))).alias("g"), F.collect_set("kind").alias("kinds"))
    one = F.when(F.size("g") == 1, F.col("g")[0]).otherwise("n")
    as_kind = F.when(F.col("family").startswith("given--"), F.concat(F.lit("given-"), one, F.substr("family", F.lit(7)))).otherwise(F.col("family"))
    return per.select(F.explode("kinds").alias("kind"), "canon", as_kind.alias("as_kind"))


def assign(found: DataFrame, key: bytes) -> DataFrame:
    """Rows (kind, canon, attempt, surrogate) for all distinct entities: surrogates are distinct, and none is an entity."""
    found = materialise(found.select("kind", "canon").distinct(), "pii-entities", few=True)
    now = materialise(_drawn(found.withColumn("attempt", F.lit(0)), key), "pii-surrogates", few=True)
    for _ in range(MAX_ATTEMPTS):
        drawn = now.withColumn("family", _family("kind"))
        first = drawn.groupBy("family", "surrogate").agg(F.min("canon").alias("holder"), F.count("*").alias("n")).where("n > 1").select("family", "surrogate", "holder")
        shared = drawn.join(first, ["family", "surrogate"]).where("canon <> holder").select("kind", "canon")
        real = drawn.join(found.select(_family("kind").alias("family"), F.col("canon").alias("surrogate")), ["family", "surrogate"], "left_semi").select("kind", "canon")
        bad = materialise(shared.unionByName(real).distinct(), "pii-collisions", few=True)
        if bad.isEmpty():
            discard(bad, found)
            return now
        again = _drawn(now.join(bad, ["kind", "canon"], "left_semi").withColumn("attempt", F.col("attempt") + 1), key)
        new = materialise(now.join(bad, ["kind", "canon"], "left_anti").unionByName(again), "pii-surrogates", few=True)
        discard(now, bad)
        now = new
    raise ValueError(f"entities without a free surrogate after {MAX_ATTEMPTS} attempts")


def _told(later) -> tuple[dict, dict]:
    """Attempts and kinds of replace()."""
    return {(x["as_kind"], x["canon"]): x["attempt"] for x in later}, {(x["kind"], x["canon"]): x["as_kind"] for x in later}


def pseudonymise(docs: DataFrame, key: bytes, max_broadcast: int = MAX_BROADCAST, region: str = REGION) -> DataFrame:
    """docs' columns with surrogates in the text, the number of entities of each kind (n_<kind>), and the entities' places in the input text.

    region: the country code of telephone numbers that are written without one.
    """
    bounded_batches(docs.sparkSession)
    found = materialise(resolved(entities(docs, region=region)), "pii-found", few=True)
    drawn = assign(found.select(F.col("as_kind").alias("kind"), "canon"), key).select(F.col("kind").alias("as_kind"), "canon", "attempt")
    later = materialise(found.join(drawn, ["as_kind", "canon"]).where("attempt > 0 OR kind <> as_kind").select("kind", "canon", "as_kind", "attempt"), "pii-later", few=True)
    outputs = ["text", *[f"n_{k}" for k in KINDS], "entities"]
    given = [c for c in docs.columns if c.lower() not in outputs]
    df = docs.select(*[F.col(f"`{c}`") for c in given], "text")
    few = later.count() <= max_broadcast
    if few:
        shared = docs.sparkSession.sparkContext.broadcast(_told(later.collect()))
    else:
        keyed = docs.select("text", F.sha2("text", 256).alias("__hx_text"))
        own = entities(keyed, ["__hx_text"], region).join(later, ["kind", "canon"])
        own = own.groupBy("__hx_text").agg(F.collect_list(F.struct("kind", "canon", "as_kind", "attempt")).alias("__hx_later"))  # of one text
        df = df.withColumn("__hx_text", F.sha2("text", 256)).join(own, "__hx_text", "left").drop("__hx_text")
    width = len(given)
    schema = df.select(*[F.col(f"`{c}`") for c in given]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                b = batch.slice(at, 512)
                texts, counts, places = [], {k: [] for k in KINDS}, []
                for i, text in enumerate(b.column(width).to_pylist()):
                    told = shared.value if few else _told(b.column(width + 1)[i].as_py() or ())
                    new, found = replace(text, key, *told, region) if text is not None else (None, [])
                    texts.append(new)
                    for k in KINDS:
                        counts[k].append(sum(f[2] == k for f in found))
                    places.append(",".join(f"{k}:{s}:{e}" for s, e, k in found))
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(width)), pa.array(texts, pa.string()), *(pa.array(counts[k], pa.int64()) for k in KINDS), pa.array(places, pa.string())], [*given, *outputs])

    fields = [f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema] + ["text string", *[f"n_{k} long" for k in KINDS], "entities string"]
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]).mapInArrow(run, ", ".join(fields))  # given names may have dots
