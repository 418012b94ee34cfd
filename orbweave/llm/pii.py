"""Operator 1: personal data is replaced by keyed surrogates, with DataFrame functions only.

Detection: e-mail addresses, IBANs, payment cards (13 to 19 digits from 2 to 6 on, with a valid check digit, also within a longer run of groups of digits), US social security
numbers, phone numbers, IPv4 addresses, access keys, passwords and tokens after their name, and persons: the whole run of capitalised words after a title or an introduction
("my name is"), and a known given name with what follows it up to the surname. Initials and particles stay.

A surrogate depends on the key, the type and the canonical form of what it replaces (an address in lower case, a phone number's national digits, a card's
digits, a name's word in lower case), so every mention of one entity, in any document and spelling, gets the same surrogate. It keeps the type's format:
digits stay digits, letters keep script and case, separators and top-level domain stay, octets stay octets of their width, cards keep the issuer digit and a valid check digit, IBANs get valid check digits, hexadecimal stays
hexadecimal, known given names stay in their gender and script, other names in their script, case and feminine ending.

Places are found once: a text with entities is written as its gaps and matches; entities, collisions and replacements come from that table. No pattern holds an
open repetition of a group, and no step compares all matches of a text with each other, so time and stack stay bounded on texts of any length.

Collision check: the distinct entities of the whole table are counted by surrogate. An entity whose surrogate belongs to another one already, or is a real entity of the table, draws
again, until all differ. Later draws come from a wider space (more name parts, longer values, octets of any width, at last more digits with every draw), so that some are always
free. Only entities that drew again are joined back to the texts; that table is broadcast if it is small, else joined by row. Known given names move by a keyed cyclic shift of their
list, which can't collide.

The key is stretched to a subkey; numbers are drawn by HMAC-SHA256, and the subkey's pads travel as columns of a one-row table, so that no plan shows them.

Defined cases: a null or empty text stays as it is, with no spans; every row is replaced on its own, whatever its id; texts without personal data are unchanged; a secret's value without
a letter or digit (a line to fill in) is no entity; a value in a script without an alphabet here gets Latin letters; repeated rows stay; an empty table gives an empty result; all other columns are kept as
they are, whatever their names.
"""

from __future__ import annotations

import hashlib
import hmac
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import discard, free_names, written

# Common given names by script and gender, titles, parts of invented surnames.
GIVEN = {
    ("latin", "f"): "Alice Anna Carmen Caroline Catherine Charlotte Claire Elena Elisabeth Emily Emma Francesca Hannah Helen Ingrid Isabel Jennifer Jessica Julia Karen Laura Linda Lucia Margaret Maria Marie Martha Nicole Olivia Patricia Rachel Rebecca Sandra Sarah Sofia Sophie Susan Teresa Victoria".split(),
    ("latin", "m"): "Alexander Andrew Anthony Antonio Carlos Charles Christopher Daniel David Edward Fernando Francisco Frank Frederick George Hans Henry Jacob James Javier John Joseph Juan Julian Klaus Louis Luis Mark Martin Matthew Michael Miguel Nicholas Patrick Paul Peter Philip Pierre Richard Robert Stephen Thomas William".split(),
    ("cyrillic", "f"): "Анна Вера Галина Дарья Екатерина Елена Ирина Мария Надежда Наталья Ольга Светлана Татьяна Юлия".split(),
    ("cyrillic", "m"): "Алексей Андрей Борис Виктор Владимир Дмитрий Иван Михаил Николай Олег Павел Пётр Сергей Юрий".split(),
}
TITLES = ["Mrs", "Miss", "Mr", "Ms", "Mister", "Dr", "Doctor", "Prof", "Professor", "Sir", "Madam", "Herrn", "Herr", "Frau", "Mme", "Mlle", "Madame", "Monsieur", "Srta", "Sra", "Sr", "Señorita", "Señora", "Señor", "г-жа", "г-н", "госпожа", "господин"]
INTRODUCTIONS = ["my name is", "je m'appelle", "ich heiße", "me llamo", "меня зовут"]
PARTICLES = "af al bin da de del della den der di do dos du el la le van ver von zu".split()
# The length of an IBAN by country, from the public registry.
IBAN_LENGTH_OF = {c: int(n) for n, cs in (row.split(": ") for row in """15: NO
16: BE
18: DK FI FO GL NL SD
19: MK SI
20: AT BA EE KZ LT LU MN XK
21: CH HR LI LV
22: BG BH CR DE GB GE IE ME RS VA
23: AE GI IL IQ OM SO TL
24: AD CZ ES MD PK RO SA SE SK TN VG
25: LY PT ST
26: IS TR
27: BI DJ FR GR IT MC MR SM
28: AL AZ BY CY DO GT HU LB NI PL SV
29: BR EG PS QA UA
30: JO KW MU YE
31: MT SC
32: LC
33: RU""".splitlines()) for c in cs.split()}
SURNAME_PARTS = {
    "latin": ("Al Ash Bar Ben Bran Car Cor Dal Den Dor El Fal Far Gar Gil Hal Har Hol Ken Kir Lan Len Mal Mar Mor Nor Oak Par Pen Quin Rad Ren Ros Sel Shel Tal Tor Val Ver Wal Wen Win".split(), "a e i o ar er in on el en".split(), "bury by dale den field ford ham land ley man mond more ner ridge rick sen son stead ster ton ville ward well wick win wood worth".split()),
    "cyrillic": ("Бел Бор Вол Гор Гром Дем Ерш Жар Зар Кал Кор Лес Мак Мор Ник Орл Пет Раз Сав Сор Тар Угр Фад Хар Чер Шар".split(), "а е и о ан ен ин он ар ер".split(), "в ев ов ин".split()),
}
ALPHABETS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"]

# Repetitions are of single classes, possessive, or bounded: Java's matcher recurses for an open repetition of a group.
EMAIL = r"(?<![\p{L}\p{N}_%+-])(?<![\p{L}\p{N}_%+-]\.)[\p{L}\p{N}_%+-][\p{L}\p{N}._%+-]{0,255}+@(?:[\p{L}\p{N}][\p{L}\p{N}-]{0,62}\.){1,12}\p{L}{2,63}"
_NAMED_SECRET = r"(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)[\"']?\s{0,3}[:=]\s{0,3}[\"']?"
SECRET = _NAMED_SECRET + r"[A-Za-z0-9+/_.~\u0001\u0003\u0004-]{8,}+={0,2}"
KEY = r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{30,}+|sk-[A-Za-z0-9]{20,}+)(?![A-Za-z0-9])"
SSN = r"(?<![\p{L}\p{N}.-])(?!000|666|9[0-9]{2})[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![\p{L}\p{N}]|[.-][0-9])"
PHONE = r"(?<![\p{L}\p{N}.+-])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}|(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[.-])[2-9][0-9]{2}[ .-][0-9]{4})(?![\p{L}\p{N}]|[.-][0-9])"
OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IP = rf"(?<![\p{{L}}\p{{N}}.]){OCTET}(?:\.{OCTET}){{3}}(?![\p{{L}}\p{{N}}]|\.[0-9])"
WORD = r"\p{Lu}\p{L}++(?:[-'’]\p{L}++){0,3}+"
_GIVEN = "(?:" + "|".join(n for names in GIVEN.values() for n in names) + r")(?![\p{L}'’-])"
_TITLE = "(?:(?:" + "|".join(TITLES) + r")(?!\p{L})\.?|(?i:" + "|".join(INTRODUCTIONS) + "))"
_PARTICLE = "(?:" + "|".join(PARTICLES) + ")"
PERSON = rf"(?<![\p{{L}}\p{{N}}])(?:{_TITLE}(?: {_TITLE})? (?:(?:\p{{Lu}}\.|{_PARTICLE}|{WORD}) ){{0,4}}{WORD}|(?=\p{{Lu}}){_GIVEN} (?:(?:\p{{Lu}}\.|{_PARTICLE}|{_GIVEN}) ){{0,3}}{WORD})"
# Marks in a text whose own \u0001 are followed by \u0002: a verified number opens and closes, an entity has a cut on both sides.
MARK, ESCAPED, OPEN, CLOSE, CUT, BODY, NEXT = "\u0001", "\u0001\u0002", "\u0001\u0003", "\u0001\u0004", "\u0001\u0005", "\u0001\u0006", "\u0001\u0007"
ENTITY = "|".join([f"{OPEN}[^\u0001]*+{CLOSE}", SECRET, EMAIL, KEY, SSN, PHONE, IP, PERSON])
#: Numbers with a check digit. Where a group of digits (or a country) begins, the longest stretch that they may take is looked at.
LONG_NUMBER = r"[0-9](?:[ -]?[0-9]){12}|[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2}"
_CARD_START, _CARD_END = r"(?<![\p{L}\p{N}.+_%@]|(?<![0-9])-)", r"(?![\p{L}\p{N}@_%]|\.[0-9])"
_CARD_WINDOW = rf"{_CARD_START}(?=([2-6][0-9]{{2,18}}+(?:[ -][0-9]{{1,18}}+){{0,5}}+.{{0,2}}))"
_IBAN_WINDOW = r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{1,4}+){3,9}+)(.?))"
NUMBER_START = f"(?s){_CARD_WINDOW}|{_IBAN_WINDOW}"
CARD_DIGITS, IBAN_LENGTHS = range(13, 20), range(15, 35)
#: A mark before a valid number tells its kind and count of digits (and letters).
_card_mark = lambda n: MARK + chr(0xE000 + n)
_iban_mark = lambda n: MARK + chr(0xE100 + n)
_INNER = r"(?:\u0001.)?"
VALID_NUMBER = "|".join([rf"{_card_mark(n)}([0-9](?:[ -]?{_INNER}[0-9]){{{n - 1}}})" for n in CARD_DIGITS] + [rf"{_iban_mark(n)}([A-Z](?: ?{_INNER}[A-Z0-9]){{{n - 1}}})" for n in IBAN_LENGTHS])
#: Cheap test that any text with an entity passes.
MAYBE = rf"[0-9@]|[:=]|AKIA|ASIA|gh[pousr]_|sk-|(?<!\p{{L}})(?=[\p{{Lu}}г])(?:{_TITLE}|{_GIVEN}) \p{{L}}|(?i:{'|'.join(INTRODUCTIONS)}) "


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once and written once in the plan."""
    return F.transform(F.array(value), lambda x: body(x))[0]


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _chars(text: Column) -> Column:
    return F.when(F.length(text) > 0, F.split(text, "")).otherwise(F.array().cast("array<string>"))


def _luhn_sum(digits: Column) -> Column:
    """Sum of the check-digit rule over up to 19 digits without their last, as if a check digit followed."""
    even = F.lpad(digits, 20, "0")
    doubled = F.translate(F.regexp_replace(even, ".(.)", "$1"), "0123456789", "0246813579")
    return F.aggregate(F.split(F.concat(doubled, F.regexp_replace(even, "(.).", "$1")), ""), F.lit(0), lambda a, d: a + d.cast("int"))


def _luhn(digits: Column) -> Column:
    """Whether the last digit is right."""
    body = F.substring(digits, F.lit(1), F.length(digits) - 1)
    return (_luhn_sum(body) + F.substring(digits, F.length(digits), F.lit(1)).cast("int")) % 10 == 0


def _mod97(text: Column) -> Column:
    """The number that up to 36 letters (A = 10 ... Z = 35) and digits spell, modulo 97, nine digits at a time."""
    spelled = F.lpad(F.array_join(F.transform(F.split(text, ""), lambda c: F.conv(c, 36, 10)), ""), 72, "0")
    return _let(spelled, lambda n: F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(0).cast("long"), lambda a, i: (a * 1_000_000_000 + F.substring(n, i * 9 + 1, F.lit(9)).cast("long")) % 97)).cast("int")


def _type_of(m: Column) -> Column:
    """Type of a match (with the marks of verified numbers); null if it is no entity. A person is typed here as a whole."""
    whole = lambda pattern: m.rlike(f"^(?:{pattern})$")
    blank = F.regexp_replace(m, "^" + _NAMED_SECRET, "").rlike("^[^A-Za-z0-9]*$")
    return (F.when(m.startswith(OPEN), F.when(m.rlike(f"^{OPEN}[0-9]"), "card").otherwise("iban")).when(whole(SECRET), F.when(~blank, "secret")).when(whole(EMAIL), "email").when(whole(KEY), "key")
            .when(whole(SSN), "ssn").when(whole(IP), "ip").when(whole(PHONE), F.when(F.length(_digits(m)).between(8, 15), "phone")).when(whole(PERSON), "person"))


def _value_of(m: Column, kind: Column) -> Column:
    """The part of a match that is replaced."""
    return F.when(kind == "secret", F.regexp_replace(m, "^" + _NAMED_SECRET, "")).otherwise(m)


def _national(m: Column) -> Column:
    """Digits of a phone number; those of a country other than +1 stand before a hyphen."""
    digits = _digits(m)
    country = F.regexp_extract(m, r"^\+([0-9]{1,3})[ .(-]", 1)
    rest = F.substring(digits, F.length(country) + 1, F.length(digits))
    return F.when(country.isin("", "1"), rest).otherwise(F.concat(country, F.lit("-"), rest))


def _canonical(m: Column, kind: Column) -> Column:
    value = _value_of(m, kind)
    return (F.when(kind.isin("email", "person", "given"), F.lower(value)).when(kind == "phone", _national(m)).when(kind.isin("card", "ssn"), _digits(m))
            .when(kind == "iban", F.regexp_replace(m, " ", "")).otherwise(value))


#: Draws that keep the exact shape; each one after them widens the space once more. Draws after LAST_SHAPED add a digit each.
SAME_SHAPE_DRAWS, LAST_SHAPED = 4, 24
MOST_PARTS = 20


class Key(NamedTuple):
    """Inner and outer pad of a subkey, as binary columns."""

    inner: Column
    outer: Column


def subkey(key: str) -> bytes:
    return hmac.new(key.encode(), b"surrogates of personal data", hashlib.sha256).digest()


def key_table(spark: SparkSession, key: str, inner: str = "inner", outer: str = "outer") -> DataFrame:
    """One row with the pads: a local table, whose values plans don't print."""
    block = subkey(key).ljust(64, b"\0")
    pads = [bytes(b ^ x for b in block).hex() for x in (0x36, 0x5C)]
    return spark.sql(f"SELECT * FROM VALUES (X'{pads[0]}', X'{pads[1]}') AS pads({inner}, {outer})")


def _hmac(key: Key, *parts: Column) -> Column:
    """Hexadecimal HMAC-SHA256 of the parts."""
    message = F.concat_ws("\u0001", *parts).cast("binary")
    return F.sha2(F.concat(key.outer, F.unhex(F.sha2(F.concat(key.inner, message), 256))), 256)


def _wider(attempt: Column) -> Column:
    return F.greatest(F.lit(0), attempt - (SAME_SHAPE_DRAWS - 1))


def _stream(key: Key, salt: Column, text: Column, attempt: Column) -> Column:
    """array<string> of keyed hexadecimal blocks; 16 numbers of 16 bits in each, for every character of the text (repeated in later draws), 16 parts and more."""
    blocks = F.sequence(F.lit(0), F.floor(F.length(text) * (_wider(attempt) + 1) / 16).cast("int") + 1)
    return F.transform(blocks, lambda b: _hmac(key, salt, text, attempt.cast("string"), b.cast("string")))


def _draw(stream: Column, i: Column) -> Column:
    """The i-th keyed number, 0 to 65535."""
    return F.conv(F.substring(F.element_at(stream, (F.floor(i / 16) + 1).cast("int")), ((i % 16) * 4 + 1).cast("int"), F.lit(4)), 16, 10).cast("int")


def _pick(alphabet: str, n: Column) -> Column:
    return F.substring(F.lit(alphabet), n % len(alphabet) + 1, F.lit(1))


def _same_shape(text: Column, stream: Column, alphabets: list[str] = ALPHABETS) -> Column:
    """Each character by one of its own alphabet; others stay, but a text of others only gets Latin letters."""

    def one(c: Column, r: Column) -> Column:
        out = F.when(F.lit(False), c)
        for a in alphabets:
            out = out.when(F.instr(F.lit(a), c) > 0, _pick(a, r))
        return out.otherwise(c)

    none = ~text.rlike("[" + "".join(alphabets) + "]")
    return F.array_join(F.transform(_chars(text), lambda c, i: _let(_draw(stream, i), lambda r: F.when(none & (c != "."), _pick(ALPHABETS[1], r)).otherwise(one(c, r)))), "")


def _surname(canonical: Column, stream: Column, shaped: Column, attempt: Column) -> Column:
    more = F.least(attempt, F.lit(MOST_PARTS))

    def build(script: str) -> Column:
        parts = [F.array(*map(F.lit, p)) for p in SURNAME_PARTS[script]]
        part = lambda k, i: F.element_at(parts[k], _draw(stream, i) % len(SURNAME_PARTS[script][k]) + 1)
        # A redrawn name has one more middle part for each draw.
        middle = F.when(more > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(more, F.lit(1))), lambda i: part(1, i + 2)), "")).otherwise("")
        return F.concat(part(0, F.lit(0)), part(1, F.lit(1)), middle, part(2, F.lit(2)))

    latin, cyrillic = F.lower(build("latin")), F.lower(build("cyrillic"))
    ending = lambda pattern, letter: F.when(canonical.rlike(pattern), letter).otherwise("")
    known = F.when(canonical.rlike(r"\p{IsCyrillic}"), F.concat(cyrillic, ending("[ая]$", "а"))).when(canonical.rlike(r"^[\p{IsLatin}'’-]+$"), F.concat(latin, ending("a$", "a")))
    return F.coalesce(known, shaped)


def surrogate(kind: Column, canonical: Column, attempt: Column, key: Key) -> Column:
    """Canonical form of the surrogate of an entity."""
    full = F.when(kind.isin("secret", "person"), F.repeat(canonical, _wider(attempt) + 1)).otherwise(canonical)
    return _let(_stream(key, kind, canonical, attempt), lambda stream: _let(_same_shape(full, stream), lambda shaped: _new(kind, canonical, attempt, stream, shaped, key)))


def _new(kind: Column, canonical: Column, attempt: Column, stream: Column, shaped: Column, key: Key) -> Column:
    wider = _wider(attempt)
    domain = F.regexp_extract(canonical, "@(.*)$", 1)
    labels = F.regexp_extract(domain, r"^(.*)\.[^.]*$", 1)
    email = F.concat(_same_shape(F.repeat(F.regexp_extract(canonical, "^([^@]*)@", 1), wider + 1), stream), F.lit("@"), _same_shape(labels, _stream(key, F.lit("domain"), domain, F.lit(0))), F.regexp_extract(domain, r"(\.[^.]*)$", 1))
    n = F.length(canonical)
    # North American numbering: area and exchange begin with 2 to 9; the fictional exchange 555 stays.
    lead = lambda i: _pick("23456789", _draw(stream, F.lit(i)))
    nanp = F.concat(lead(0), F.substring(shaped, 2, 2), F.when((F.substring(canonical, 4, 3) == "555") & (wider == 0), F.lit("555")).otherwise(F.concat(lead(3), F.substring(shaped, 5, 2))), F.substring(shaped, 7, 4))
    abroad = F.regexp_extract(canonical, "^([0-9]+-)", 1)
    rest = F.substring(shaped, F.length(abroad) + 1, n)
    phone = F.when(n == 10, nanp).otherwise(F.concat(abroad, lead(0), F.substring(rest, F.lit(2), n), F.substring(_digits(F.element_at(stream, -1)), F.lit(1), wider)))
    card = _let(F.concat(F.substring(canonical, 1, 1), F.substring(shaped, F.lit(2), n - 2)), lambda body: F.concat(body, ((10 - _luhn_sum(body) % 10) % 10).cast("string")))
    first = F.element_at(F.split(canonical, r"\."), 1)

    def octet(o: Column, i: Column) -> Column:
        r = _draw(stream, i)
        three = F.when(i == 0, 128 + r % 64).otherwise(100 + r % 155)
        return F.when(wider > 0, 1 + r % F.when(i == 0, 223).otherwise(254)).when(F.length(o) == 1, 1 + r % 9).when(F.length(o) == 2, 11 + r % 89).otherwise(three).cast("string")

    ip = F.array_join(F.transform(F.split(canonical, r"\."), lambda o, i: F.when((i == 0) & first.isin("10", "127") & (wider <= SAME_SHAPE_DRAWS), o).otherwise(octet(o, i))), ".")
    bban = F.substring(shaped, F.lit(5), n)
    check = 98 - _mod97(F.concat(bban, F.substring(canonical, 1, 2), F.lit("00")))
    iban = F.concat(F.substring(canonical, 1, 2), F.lpad(check.cast("string"), 2, "0"), bban)
    # At last, digits are added, one more with each draw.
    beyond = F.greatest(F.lit(0), attempt - LAST_SHAPED)
    more = F.substring(_digits(_hmac(key, kind, canonical, attempt.cast("string"), F.lit("more"))), F.lit(1), beyond)
    ssn = F.concat(_pick("12345", _draw(stream, F.lit(0))), _pick("123456789", _draw(stream, F.lit(1))), F.substring(shaped, 3, 1), _pick("123456789", _draw(stream, F.lit(3))), F.substring(shaped, 5, 4), _pick("123456789", _draw(stream, F.lit(8))))
    secret = F.when(canonical.rlike("^[0-9a-f]+$"), F.array_join(F.transform(_chars(canonical), lambda c, i: _pick("0123456789abcdef", _draw(stream, i))), "")).otherwise(shaped)
    front = F.regexp_extract(canonical, "^(AKIA|ASIA|gh[pousr]_|sk-)", 1)
    api_key = F.concat(front, F.substring(shaped, F.length(front) + 1, n))
    fixed = F.when(kind == "card", card).when(kind == "iban", iban).when(kind == "ssn", ssn).when(kind == "key", api_key).when(kind == "phone", phone)
    return (F.when(kind.isin("card", "iban", "ssn", "key", "phone"), F.concat(fixed, more)).when(kind == "email", email).when(kind == "ip", F.concat(ip, F.when(beyond > 0, F.concat(F.lit("."), more)).otherwise("")))
            .when(kind == "secret", secret).otherwise(_surname(canonical, stream, shaped, attempt)))


def _refill(m: Column, digits: Column, old: Column) -> Column:
    """The match with its last ``old`` digits, or characters of an IBAN, replaced in order; separators and what comes before stay, digits beyond them follow."""
    flat = _chars(m)
    at = lambda i: F.size(F.filter(F.slice(flat, 1, i + 1), lambda c: c.rlike("[0-9A-Z]")))
    skip = F.length(F.regexp_replace(m, "[^0-9A-Z]", "")) - old
    return F.concat(F.array_join(F.transform(flat, lambda c, i: F.when(c.rlike("[0-9A-Z]") & (at(i) > skip), F.substring(digits, at(i) - skip, F.lit(1))).otherwise(c)), ""), F.substring(digits, old + 1, F.length(digits)))


def _cased(like: Column, name: Column) -> Column:
    return F.when(like == F.upper(like), F.upper(name)).otherwise(F.concat(F.upper(F.substring(name, 1, 1)), F.substring(name, F.lit(2), F.length(name))))


def _given(canonical: Column, key: str) -> Column:
    """A known given name moved along the list of its gender and script by a keyed step."""
    new = F.when(F.lit(False), canonical)
    for (script, gender), names in GIVEN.items():
        step = int.from_bytes(hmac.new(subkey(key), f"{script} {gender}".encode(), hashlib.sha256).digest()[:4], "big") % (len(names) - 1) + 1
        lower = [n.lower() for n in names]
        listed, place = F.array(*map(F.lit, lower)), F.array_position(F.array(*map(F.lit, lower)), canonical).cast("int")
        new = new.when(place > 0, F.element_at(listed, (place - 1 + step) % len(names) + 1))
    return new


def rendered(m: Column, kind: Column, canonical: Column, new: Column) -> Column:
    """The match in its own format, with the surrogate's canonical form in place."""
    value = _value_of(m, kind)
    national = lambda c: F.regexp_replace(c, "^[0-9]+-", "")
    email = F.when(value == F.upper(value), F.upper(new)).otherwise(new)
    return (F.when(kind == "email", email).when(kind.isin("phone", "card", "ssn", "iban"), _refill(m, national(new), F.length(national(canonical))))
            .when(kind == "secret", F.concat(F.regexp_extract(m, f"^({_NAMED_SECRET})", 1), new)).when(kind.isin("person", "given"), _cased(value, new)).otherwise(new))


def _numbers_marked(text: Column) -> Column:
    """The text with its valid cards and IBANs between marks: the leftmost ones, each as long as it can be."""
    def card(w: Column) -> Column:
        def valid(n: int) -> Column:
            return _let(F.regexp_extract(w, rf"^([0-9](?:[ -]?[0-9]){{{n - 1}}}){_CARD_END}", 1), lambda c: F.when((c != "") & _luhn(_digits(c)), F.lit(_card_mark(n))))

        return F.coalesce(*[valid(n) for n in reversed(CARD_DIGITS)], F.lit(""))

    def iban(w: Column) -> Column:
        """w: body, NEXT, and the character after it."""
        n = F.element_at(F.create_map(*[F.lit(x) for c, n in IBAN_LENGTH_OF.items() for x in (c, n)]), F.substring(w, 1, 2))
        # The country's length must end at the end of a word.
        found = _let(n, lambda n: F.regexp_substr(F.replace(w, F.lit(NEXT), F.lit("")), F.concat(F.lit("^[A-Z](?: ?[A-Z0-9]){"), n - 1, F.lit("}(?![A-Za-z0-9])"))))
        right = lambda c: F.length(c).between(IBAN_LENGTHS[0], IBAN_LENGTHS[-1]) & (_mod97(F.concat(F.substring(c, F.lit(5), F.length(c)), F.substring(c, 1, 4))) == 1)
        marks = F.array(*[F.lit(_iban_mark(n)) for n in IBAN_LENGTHS])
        return F.when(n.isNotNull(), _let(F.replace(found, F.lit(" "), F.lit("")), lambda c: F.when(F.coalesce(right(c), F.lit(False)), F.get(marks, F.length(c) - IBAN_LENGTHS[0])).otherwise(""))).otherwise("")

    def judged(piece: Column) -> Column:
        mark = lambda w: F.when(w.rlike("^[0-9]"), _let(F.replace(w, F.lit(NEXT), F.lit("")), card)).otherwise(iban(w))
        return _let(F.substring_index(piece, BODY, 1), lambda w: F.concat(mark(w), F.substring(piece, F.length(w) + len(BODY) + 1, F.length(piece))))

    pieces = F.split(F.regexp_replace(text, NUMBER_START, f"{CUT}$1$2{NEXT}$3{BODY}"), CUT, -1)
    joined = F.array_join(F.transform(pieces, lambda piece, i: F.when(i == 0, piece).otherwise(judged(piece))), "")
    groups = "".join(f"${i + 1}" for i in range(len(CARD_DIGITS) + len(IBAN_LENGTHS)))
    chosen = F.regexp_replace(joined, VALID_NUMBER, f"{OPEN}{groups}{CLOSE}")
    return F.regexp_replace(chosen, "\u0001[-]", "")


def _plain(text: Column) -> Column:
    """Without marks, as it was."""
    return F.replace(F.regexp_replace(text, "\u0001[^\u0002]", ""), F.lit(ESCAPED), F.lit(MARK))


FOUND = "array<struct<gap: string, m: string, kind: string, canonical: string>>"


def _cut(text: Column) -> Column:
    """array<string>: gaps and matches by turns, still marked."""
    marked = F.replace(text, F.lit(MARK), F.lit(ESCAPED))
    marked = F.when(marked.rlike(LONG_NUMBER), _numbers_marked(marked)).otherwise(marked)
    return F.split(F.regexp_replace(marked, ENTITY, f"{CUT}$0{CUT}"), CUT, -1)


def _found(pieces: Column) -> Column:
    """FOUND in order, from _cut's pieces: what stands before each entity, and the entity. Matches that are no entity are among them, with a null kind."""
    pairs = F.transform(F.sequence(F.lit(0), (F.size(pieces) / 2).cast("int") - 1), lambda i: F.struct(pieces[i * 2].alias("gap"), pieces[i * 2 + 1].alias("m")))
    typed = F.transform(pairs, lambda p: F.struct(_plain(p["gap"]).alias("gap"), _plain(p["m"]).alias("m"), _type_of(p["m"]).alias("kind")))

    def words(p: Column) -> Column:
        """A person's words, each with what stands before it."""
        front = F.regexp_extract(p["m"], rf"^((?:{_TITLE} )*+)", 1)
        names = F.split(F.substring(p["m"], F.length(front) + 1, F.length(p["m"])), " ")
        kind = lambda w, i: F.when(~w.rlike(f"^{WORD}$"), F.lit(None).cast("string")).when(((i < F.size(names) - 1) | (F.size(names) == 1)) & w.rlike(f"^{_GIVEN}$"), "given").otherwise("person")
        return F.transform(names, lambda w, i: F.struct(F.when(i == 0, F.concat(p["gap"], front)).otherwise(F.lit(" ")).alias("gap"), w.alias("m"), kind(w, i).alias("kind")))

    each = F.flatten(F.transform(typed, lambda p: F.when(p["kind"] == "person", words(p)).otherwise(F.array(p))))
    return F.transform(each, lambda x: F.struct(x["gap"].alias("gap"), x["m"].alias("m"), x["kind"].alias("kind"), _canonical(x["m"], x["kind"]).alias("canonical")))


def settle(entities: DataFrame, key: str) -> DataFrame:
    """(kind, canonical, attempt) of the entities that had to draw again, so that surrogates are distinct and none is an entity.

    Every draw has a chance to be free and later ones come from ever wider spaces, so the loop ends.
    """
    pads = key_table(entities.sparkSession, key)
    drawn = surrogate(F.col("kind"), F.col("canonical"), F.col("attempt"), Key(F.col("inner"), F.col("outer"))).alias("new")
    with_new = lambda df: df.join(F.broadcast(pads)).select("kind", "canonical", "attempt", drawn)  # noqa: E731  one row
    now = written(with_new(entities.select("kind", "canonical", F.lit(0).alias("attempt"))), "pii-entities")
    while True:
        holder = now.groupBy("kind", "new").agg(F.min(F.struct("attempt", "canonical")).alias("first"), F.count("*").alias("n"))
        clash = holder.where("n > 1").select("kind", "new", "first")
        real = now.select("kind", F.col("canonical").alias("new"), F.lit(True).alias("real"))
        judged = now.join(clash, ["kind", "new"], "left").join(real, ["kind", "new"], "left")
        again = F.coalesce("real", F.lit(False)) | (F.col("first").isNotNull() & (F.col("first.canonical") != F.col("canonical")))
        losers = written(judged.where(again).select("kind", "canonical", "attempt"), "pii-again")
        if not losers.head(1):
            discard(losers)
            break
        moved = with_new(losers.withColumn("attempt", F.col("attempt") + 1))
        step = written(now.join(losers, ["kind", "canonical"], "left_anti").select("kind", "canonical", "attempt", "new").unionByName(moved), "pii-entities")
        discard(now)
        discard(losers)
        now = step
    out = written(now.where("attempt > 0").select("kind", "canonical", "attempt"), "pii-attempts")
    discard(now)
    return out


#: Spans are placed so many at a time, as an aggregation copies what it has gathered.
PLACED_AT_A_TIME = 256


def _spans(found: Column) -> Column:
    """array<struct<kind, begin, length>> of the entities among the matches."""
    width = lambda x: F.length(x["gap"]) + F.length(x["m"])
    total = lambda block: F.aggregate(block, F.lit(0), lambda a, x: a + width(x))
    begins = lambda blocks: F.aggregate(F.transform(blocks, total), F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
    kind = lambda x: F.when(x["kind"] == "given", "person").otherwise(x["kind"])
    span = lambda s, x: F.struct(kind(x).alias("kind"), (s["at"] + F.length(x["gap"])).alias("begin"), F.length(x["m"]).alias("length"))
    step = lambda s, x: F.struct((s["at"] + width(x)).alias("at"), F.when(x["kind"].isNull(), s["spans"]).otherwise(F.concat(s["spans"], F.array(span(s, x)))).alias("spans"))
    none = F.expr("CAST(array() AS array<struct<kind: string, begin: int, length: int>>)")
    place = lambda block, at: F.aggregate(block, F.struct(at.alias("at"), none.alias("spans")), step)["spans"]
    cut = F.transform(F.sequence(F.lit(0), ((F.size(found) - 1) / PLACED_AT_A_TIME).cast("int")), lambda k: F.slice(found, k * PLACED_AT_A_TIME + 1, F.lit(PLACED_AT_A_TIME)))
    return _let(cut, lambda blocks: F.flatten(F.zip_with(blocks, F.slice(begins(blocks), F.lit(1), F.size(blocks)), place)))


def replace_pii(docs: DataFrame, key: str, text_col: str = "text", spans_col: str = "pii_spans", small: int = 2_000) -> DataFrame:
    """docs with surrogates in the text column, and a column array<struct<kind, begin, length>> of the replaced places (code points of the old text).

    A person's name gives one span for each of its words. Where docs has a column of that name, the last column is called by it with underscores before.
    """
    spans_col = free_names(docs.columns, spans_col)[0]
    text = F.col(text_col)
    row, pieces, found, tag, inner, outer = free_names(docs.columns + [spans_col], "row", "pieces", "found", "attempts", "inner", "outer")
    empty = F.expr(f"CAST(array() AS {FOUND})")
    cut = docs.withColumn(pieces, F.when(text.rlike(MAYBE), _cut(text)))
    has = F.size(pieces) > 1
    cut = cut.withColumns({found: F.when(has, _found(F.col(pieces))).otherwise(empty), text_col: F.when(has, _plain(F.element_at(pieces, -1))).otherwise(text), row: F.monotonically_increasing_id()})
    # A text with matches is held by them: its column keeps what follows the last match.
    held = written(cut.drop(pieces), "pii-found")
    replaced = lambda x: x["kind"].isNotNull()
    entity = lambda x: F.struct(x["kind"].alias("kind"), x["canonical"].alias("canonical"))
    named = F.explode(F.array_distinct(F.transform(F.filter(found, lambda x: replaced(x) & (x["kind"] != "given")), entity))).alias("e")
    # A row's canonical forms are distinct before they are counted, and partial aggregation combines them where they are read.
    again = settle(held.where(F.size(found) > 0).select(named).select("e.kind", "e.canonical").distinct(), key)
    n_again = again.count()
    attempts = F.expr("CAST(map() AS map<string,int>)")
    work = held.join(F.broadcast(key_table(docs.sparkSession, key, inner, outer)))  # one row
    if n_again:
        name = F.concat_ws("\u0001", "kind", "canonical")
        as_map = F.map_from_entries(F.collect_list(F.struct(name.alias("k"), F.col("attempt")))).alias(tag)
        if n_again <= small:
            # Bounded: at most ``small`` entities, held once in every task.
            work = work.join(F.broadcast(again.agg(as_map)))
        else:
            hits = held.where(F.size(found) > 0).select(F.col(row).alias("r"), named).select("r", "e.*").join(again, ["kind", "canonical"])
            work = work.join(hits.groupBy("r").agg(as_map).withColumnRenamed("r", row), row, "left")
        attempts = F.col(tag)
    attempt = lambda x: F.coalesce(F.element_at(attempts, F.concat_ws("\u0001", x["kind"], x["canonical"])), F.lit(0))
    keyed = Key(F.col(inner), F.col(outer))
    new = lambda x: F.when(x["kind"] == "given", _cased(x["m"], _given(x["canonical"], key))).otherwise(_let(surrogate(x["kind"], x["canonical"], attempt(x), keyed), lambda s: rendered(x["m"], x["kind"], x["canonical"], s)))
    joined = F.concat(F.array_join(F.flatten(F.transform(found, lambda x: F.array(x["gap"], F.when(replaced(x), new(x)).otherwise(x["m"])))), ""), text)
    spans = F.when(F.size(found) > 0, _spans(F.col(found))).otherwise(F.expr("CAST(array() AS array<struct<kind: string, begin: int, length: int>>)"))
    out = work.withColumn(spans_col, spans).withColumn(text_col, F.when(F.size(found) > 0, joined).otherwise(text))
    return out.select(*docs.columns, spans_col)


#: Session setting that holds the key, and what stands for it where the setting is absent (examples and tests).
KEY_SETTING, EXAMPLE_KEY = "spark.orbweave.pii.key", "orbweave-example-key"


def key_of(spark: SparkSession) -> str:
    return spark.conf.get(KEY_SETTING, EXAMPLE_KEY)


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = replace_pii(docs, key_of(spark))
    return out.select("doc_id", "text", F.size("pii_spans").cast("long").alias("n_replaced"), F.transform("pii_spans", lambda s: s["kind"]).alias("kinds"))
