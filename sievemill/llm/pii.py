"""PII surrogates (operator 2).

Entities are found by patterns and each gets a surrogate of its own kind: a keyed
permutation of all values of its format. Format means separators, script, case,
vowel or consonant of names, digit or letter elsewhere, and what makes the kind
valid (check digits, country prefix, first octet). A permutation needs no table:
equal values get equal surrogates everywhere (coreference), different ones stay
different (distinctness). The collision checks are part of it: a permutation value
outside the format, or one that the kind's table of known names holds, is walked on
along its cycle until it is free, which keeps it one-to-one. The map is a one-step
rotation seen through the permutation, so no value of a format with two members or
more keeps itself. `audit` checks distinctness over a whole table.

Persons are names after a title or with a listed given name, and every other mention
of such a name in the same text. Each word of a name has its surrogate, so a family name
alone agrees with the full name. Given names in the lists go to listed names of the same
gender and script (a keyed rotation of the list); other names keep their last letter,
which often marks gender, and every letter's script, case and kind. Titles and particles
(de, von) stay, so a surrogate after Mrs stays a woman's.

Defined cases: null text stays null with no entity; empty text stays; repeated rows
and rows of one doc_id get equal results for equal texts; where kinds overlap the one
listed first in PATTERNS wins; very long texts are searched whole, in time that grows
with their length (of more than four titles in a row the last four count); an empty table
gives no rows; other columns are kept as they are (a column named n_entities or entities is
replaced).
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .common import lean, table, text_bytes, workers_import

KEY = b"sievemill demonstration key"  # a secret in production

# Given names by script and gender, none of them a common word; titles
FEMALE = tuple(
    "Alice Amelia Ana Andrea Anna Beatriz Birgit Camila Camille Carla Carmen Caroline Charlotte Chiara Claudia Clara Daniela Deborah Elena Elisabeth Elizabeth Emily Emma Eva Francesca Franziska Gabriela Hanna Hannah Heike "
    "Helena Ines Ingrid Isabella Jana Jennifer Jessica Julia Karin Katharina Laura Lena Linda Lucia Manon Margaret Maria Marie Marta Martina Monika Nathalie Nicole Olivia Patricia Paula Sabine Sandra Sarah Silvia Sofia Sophie Stefanie Susan Susanne Teresa Ursula Valentina".split()
)
MALE = tuple(
    "Alejandro Alexander Andreas Antoine Antonio Bernd Brian Carlos Christian Daniel David Diego Dieter Edward Eric Felix Fernando Francesco Georg George Giovanni Guillaume Hans Heinrich Henri Hugo Jakob James Javier Jean John Jonas Jorge "
    "Joseph Juan Julien Jürgen Kevin Klaus Lars Leon Lorenzo Louis Luca Lukas Luis Manuel Marco Mateo Matthias Michael Miguel Nicolas Olivier Pablo Paul Pedro Peter Philippe Pierre Raphael Richard Robert Santiago Sebastian Stefan Thomas Tobias William Wolfgang".split()
)
CYRILLIC_FEMALE = ("Анна", "Мария", "Елена", "Ольга", "Наталья", "Ирина", "Татьяна", "Екатерина", "Светлана", "Юлия")
CYRILLIC_MALE = ("Александр", "Сергей", "Дмитрий", "Андрей", "Алексей", "Иван", "Михаил", "Николай", "Владимир", "Павел")
GREEK_FEMALE = ("Μαρία", "Ελένη", "Αικατερίνη", "Σοφία", "Άννα", "Γεωργία")
GREEK_MALE = ("Γεώργιος", "Δημήτριος", "Κωνσταντίνος", "Ιωάννης", "Νικόλαος", "Χρήστος")
GIVEN = (FEMALE, MALE, CYRILLIC_FEMALE, CYRILLIC_MALE, GREEK_FEMALE, GREEK_MALE)
LISTED = frozenset(x for names in GIVEN for x in names)
TITLES = (
    *("Mr", "Mrs", "Ms", "Miss", "Mx", "Dr", "Prof", "Doctor", "Professor", "Sir", "Dame", "Lord", "Lady", "Rev", "Reverend", "Judge", "Justice", "Senator", "Captain", "Capt", "Col", "Lt", "Sgt"),
    *("Herr", "Herrn", "Frau", "Fräulein", "Doktor"),
    *("Monsieur", "Madame", "Mademoiselle", "Mme", "Mlle", "Maître", "Docteur", "Professeur"),
    *("Г-н", "Г-жа", "Господин", "Госпожа", "Κύριος", "Κυρία"),
    *("Señor", "Señora", "Señorita", "Sr", "Sra", "Srta", "Don", "Doña", "Doctora", "Dra", "Profesor", "Profesora", "Licenciado", "Licenciada"),
)
# Words that begin sentences: no part of a name where they follow one
OTHER = (
    *("The", "This", "That", "These", "Those", "And", "But", "Or", "He", "She", "It", "They", "We", "You", "In", "On", "At", "Is", "Was", "If", "When", "Then", "For", "As", "So", "Who", "His", "Her"),
    *("Der", "Die", "Das", "Und", "Aber", "Oder", "Er", "Sie", "Es", "Wir", "Ich", "Ist", "War", "Wenn", "Ein", "Eine", "Im", "Am"),
    *("Le", "La", "Les", "Un", "Une", "Et", "Mais", "Ou", "Il", "Elle", "Ils", "Elles", "Nous", "Vous", "Je", "Dans", "Ce", "Cette"),
    *("El", "Los", "Las", "Una", "Y", "Pero", "O", "Ella", "Ellos", "Nosotros", "Yo", "En", "Es", "Este", "Esta"),
)

# Names: a capital first, hyphens and apostrophes inside (not the 's of a genitive), initials; particles between them stay
CAPITAL = "[" + "".join(chr(c) for c in range(0x41, 0x530) if chr(c).isupper()) + "]"
NAME = rf"{CAPITAL}[^\W\d_]*(?:-[^\W\d_]+|['’](?!s\b)[^\W\d_]+)*"
NO_NAME = rf"(?!(?:{'|'.join({*TITLES, *OTHER})})(?![\w'’-]))"
GAP = r"[ \u00a0]{1,2}"
MORE = rf"(?:(?:{GAP}(?:de|del|della|di|da|do|dos|du|la|las|los|le|van|von|der|den|ter|zu|zur|bin|al|y)){{0,3}}{GAP}(?:{NO_NAME}{NAME}(?!\.{CAPITAL})|{CAPITAL}\.))"
PARTS = re.compile(NAME)
PATTERNS = {
    "email": re.compile(r"(?<![\w.+-])[\w.+-]*\w@(?:[\w-]+\.)+[A-Za-z]{2,}(?![\w-])"),
    "key": re.compile(r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])"),
    "secret": re.compile(r"(?i:\b(?:token|secret|password|passwd|api_?key)\b[\"']?\s*[:=]\s*[\"']?)([A-Za-z0-9_\-]{8,})"),
    "iban": re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"),
    "ip": re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)"),
    "ssn": re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    "card": re.compile(r"(?<![\d.-])\d(?:[ -]?\d){12,}"),  # a run of digit groups: cards() finds the cards in it
    "phone": re.compile(
        r"(?<![\w.+])(?:"
        r"\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}(?!\d)"  # with a country prefix
        r"|(?:\+ ?[1-9]\d{0,14}|00[1-9]\d{0,12})(?:(?:[ .-]?\(|\)[ .-]?|[ .\-/])\d{1,8}){0,7}(?!\d)"
        r")|(?<![\w+])(?<!\d[.,:/-])(?:"
        r"(?:1[ .-]?)?\([2-9]\d{2}\)[ .-]?\d{3}[ .-]?\d{4}"  # with an area code in parentheses
        r"|\(0\d{1,5}\)[ .\-/]?\d{2,8}(?:[ .\-/]\d{2,8}){0,3}|\(\d{2,3}\)[ .-]?\d{3,5}[ .-]\d{3,4}"
        r"|(?:1[ .-])?[2-9]\d{2}[ .-]\d{3}[ .-]\d{4}|1?[2-9]\d{9}"  # 3-3-4
        r"|[6-9]\d{2}(?:([ .-])\d{2}\1\d{2}\1\d{2}|([ -])\d{3}\2\d{3})|9\d[ -]\d{3}[ -]\d{2}[ -]\d{2}"  # nine digits
        r"|0[1-9]\d{0,4}[ .\-/]\d{5,8}(?:[ -]\d{1,4})?|0[1-9]\d{0,4}(?:[ .\-/]\d{2,4}){2,4}|0[1-9]\d{7,10}"  # with a trunk zero
        r")(?![\w]|[,:/-]\d)"
    ),
    "person": re.compile(
        rf"\b(?={CAPITAL})(?:(?:(?:(?:{'|'.join(TITLES)})\b\.?|M\.){GAP}){{1,4}}((?:{CAPITAL}\.{GAP}?)*(?:(?:de|del|la|van|von|der|den|zu|di|da|du){GAP}){{0,3}}{NO_NAME}{NAME}{MORE}{{0,2}})"
        rf"|((?:{'|'.join(sorted(LISTED, key=len, reverse=True))})(?![\w'’]){MORE}{{1,2}}))"
    ),
}
DIGITS = ("key", "secret", "iban", "ip", "ssn", "card", "phone")

DATE = re.compile(r"(?<!\d)(?:(?:1[5-9]|20)\d\d([ ./-])(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])([ ./-])(?:0?[1-9]|[12]\d|3[01])\2(?:1[5-9]|20)\d\d)(?!\d)")
YEARS = re.compile(r"(?:(?:1[5-9]|20)\d\d(?:[ -]|$))+")
CARD_GROUPS = re.compile(r"\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}(?:\1\d{1,3})?|\d{4}([ -])\d{6}\2\d{4,5}")  # as cards are written

VOWELS, UPPER_VOWELS = "aeiou", "AEIOU"
CONSONANTS, UPPER_CONSONANTS = "bcdfghjklmnpqrstvwxyz", "BCDFGHJKLMNPQRSTVWXYZ"
LATIN_MARKED, UPPER_LATIN_MARKED = "àáâäèéêëíîïóôöùúûü", "ÀÁÂÄÈÉÊËÍÎÏÓÔÖÙÚÛÜ"
LETTERS = "abcdefghijklmnopqrstuvwxyz"
CYRILLIC, GREEK = "абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω"
NAME_CLASSES = (VOWELS, UPPER_VOWELS, CONSONANTS, UPPER_CONSONANTS, LATIN_MARKED, UPPER_LATIN_MARKED, CYRILLIC, CYRILLIC.upper(), GREEK, GREEK.upper())


def rest(first: int, end: int, is_case) -> str:
    """The letters of a range and case that are in no class so far."""
    return "".join(c for c in map(chr, range(first, end)) if c.isalpha() and is_case(c) and not any(c in k for k in NAME_CLASSES))


#: all other Latin (with Extended A and B), Greek and Cyrillic letters: the scripts that CAPITAL takes
NAME_CLASSES += tuple(rest(a, b, case) for a, b in ((0xAA, 0x250), (0x370, 0x400), (0x400, 0x530)) for case in (str.islower, str.isupper))
CODE_CLASSES = ("0123456789", LETTERS, LETTERS.upper())


def permute(x: int, n: int, key: bytes, back: bool = False) -> int:
    """A keyed permutation of 0..n-1: a Feistel network on the next even number of bits, walked on until it falls below n."""
    half = max(1, -(-max(n - 1, 1).bit_length() // 2))
    mask = (1 << half) - 1
    while True:
        a, b = x >> half, x & mask
        for r in range(7, -1, -1) if back else range(8):
            f = lambda v: int.from_bytes(hashlib.blake2b(v.to_bytes((half + 7) // 8, "big") + bytes([r]), key=key, digest_size=max(8, (half + 7) // 8)).digest(), "big") & mask  # noqa: B023, E731
            a, b = (b ^ f(a), a) if back else (b, a ^ f(b))
        x = a << half | b
        if x < n:
            return x


def rotate(x: int, n: int, key: bytes) -> int:
    return permute((permute(x, n, key) + 1) % n, n, key, back=True) if n > 1 else x


def swap(text: str, classes: tuple[str, ...], key: bytes, keep=lambda i: False, first: str = "") -> str:
    """The surrogate of text among all texts with the same class at each place; characters of no class stay. first: a class of its own where the first class member stands; a member outside it stays there and the place counts as the next one, so the map stays one-to-one."""
    own, place = [], 0
    for i, c in enumerate(text):
        k = None if keep(i) else next((k for k in classes if c in k), None)
        if k and first and place < 2:
            k = first if c in first else None if place == 0 else "".join(x for x in k if x not in first)
            place += 1 if k is None else 2
        own.append(k)
    radix = [len(k) for k in own if k]
    if not radix:
        return text
    x = 0
    for c, k in zip(text, own, strict=True):
        if k:
            x = x * len(k) + k.index(c)
    shape = "".join("." if k is None else str(len(k)) for k in own) + "".join(c for c, k in zip(text, own, strict=True) if not k)
    x, out = rotate(x, prod(radix), hashlib.blake2b(shape.encode(), key=key[:64]).digest()), []
    for k in reversed(own):
        if k:
            x, d = divmod(x, len(k))
            out.append(k[d])
        else:
            out.append("")
    return "".join(o or c for o, c in zip(reversed(out), text, strict=True))


def luhn(digits: str) -> int:
    """The check digit that goes after digits."""
    total = sum(int(c) if i % 2 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(digits)))
    return -total % 10


def surrogate(kind: str, value: str, key: bytes) -> str:
    key = hashlib.blake2b(kind.encode(), key=key[:64]).digest()
    if kind == "email":
        local, domain = value.split("@")
        host, _, top = domain.rpartition(".")
        return f"{swap(local, CODE_CLASSES, key)}@{swap(host, CODE_CLASSES, key)}.{top}"
    if kind == "key":
        return value[:4] + swap(value[4:], CODE_CLASSES, key)
    if kind == "secret":
        hexes = "0123456789abcdef"
        return swap(value, (hexes,) if all(c in hexes for c in value) else CODE_CLASSES, key)
    if kind == "ip":
        a = [int(x) for x in value.split(".")]
        low, high = (1, 223) if 1 <= a[0] <= 223 else (224, 255) if a[0] else (0, 0)
        x = ((a[0] - low) << 24) + (a[1] << 16) + (a[2] << 8) + a[3]
        x = rotate(x, (high - low + 1) << 24, key)
        return f"{(x >> 24) + low}.{x >> 16 & 255}.{x >> 8 & 255}.{x & 255}"
    if kind == "card":
        digits = re.sub(r"\D", "", value)
        apart = (int(digits[-1]) - luhn(digits[:-1])) % 10
        new = swap(digits[:-1], CODE_CLASSES, key, keep=lambda i: i == 0)
        new += str((luhn(new) + apart) % 10)
        at = iter(new)
        return "".join(next(at) if c.isdigit() else c for c in value)
    if kind == "iban":
        return value[:2] + iban_check(value, swap(value[4:], CODE_CLASSES, key)) + swap(value[4:], CODE_CLASSES, key)
    if kind == "phone":
        lead = re.match(r"\+ ?\d{1,3}(?=[ .(/-])|00[1-9]\d{0,2}(?=[ .(/-])|\(?00?(?=[1-9])|9(?=\d[ -]\d{3}[ -]\d{2}[ -]\d{2}$)", value)
        start = lead.end() if lead else 0
        head = value[:start].strip("(")
        first = "123456789" if head in ("0", "00") else "" if head == "9" else "6789" if not head and sum(c.isdigit() for c in value) == 9 else "23456789"
        new = iter(swap("".join(c for c in value[start:] if c.isdigit()), CODE_CLASSES, key, first=first))  # digits alone: the same number in other groups gets the same ones
        return value[:start] + "".join(next(new) if c.isdigit() else c for c in value[start:])
    if kind == "person":
        return PARTS.sub(lambda m: "-".join(name(x, key) for x in m[0].split("-")), value)
    return swap(value, CODE_CLASSES, key)


def iban_check(value: str, rest: str) -> str:
    """Check digits for rest, as far from the right ones as those of value are."""
    number = lambda bban: int("".join(str(int(c, 36)) for c in re.sub(" ", "", bban).upper() + value[:2] + "00"))
    right = lambda bban: 98 - number(bban) % 97
    return f"{(int(value[2:4]) - right(value[4:]) + right(rest)) % 100:02d}"


def name(text: str, key: bytes) -> str:
    for names in GIVEN:
        if text in names:
            return names[rotate(names.index(text), len(names), key)]
    last = len(text) - 1
    out = text
    for _ in range(1000):  # a listed name is taken: walk on
        out = swap(out, NAME_CLASSES, key, keep=lambda i: i == last and last > 1)
        if out not in LISTED:
            break
    return out


def cards(run: str) -> list[tuple[int, int]]:
    """Card numbers in a run of digit groups, apart from each other: 13 to 19 digits of whole groups that pass Luhn, or 15 or 16 digits. Those grouped as cards are go first, then the ones that pass Luhn, then the leftmost and longest; part of a run in other groups counts only if these have three digits on average (without Luhn, four each), as lists of small numbers are no cards."""
    groups = [m.span() for m in re.finditer(r"\d+", run)]
    found = []
    for i in range(len(groups)):
        n = 0
        for j in range(i, len(groups)):
            n += groups[j][1] - groups[j][0]
            if n > 19:
                break
            if n < 13:
                continue
            if j - i >= 5 and n < 3 * (j - i + 1) and j - i + 1 < len(groups):
                continue  # many small groups: neither grouped as cards are nor wide
            part = run[groups[i][0] : groups[j][1]]
            digits = re.sub(r"\D", "", part)
            valid, usual = luhn(digits[:-1]) == int(digits[-1]), CARD_GROUPS.fullmatch(part) is not None
            wide = n >= 3 * (j - i + 1) if valid else all(b - a > 3 for a, b in groups[i : j + 1])
            if not valid and YEARS.fullmatch(part):
                continue
            if (valid or n in (15, 16)) and (usual or wide or j - i + 1 == len(groups)):
                found.append((not usual, not valid, i, -j))
    taken, out = [False] * len(groups), []
    for _, _, i, j in sorted(found):
        if not any(taken[i : 1 - j]):
            taken[i : 1 - j] = [True] * (1 - j - i)
            out.append((groups[i][0], groups[-j][1]))
    return out


def phone(value: str) -> int:
    """The length of the phone number that value begins with, 0 if none: 9 to 15 digits (8 after a +), no date."""
    while value:
        n = sum(c.isdigit() for c in value)
        if n <= 15:
            return len(value) if n >= (8 if value[0] == "+" else 9) and (value[0] == "+" or not DATE.search(value)) else 0
        value = re.sub(r"[ .()/-]*\d+$", "", value)
    return 0


def find(text: str) -> list[tuple[int, int, str]]:
    """Entities as (start, end, kind), apart from each other; earlier kinds in PATTERNS win."""
    out: list[tuple[int, int, str]] = []  # ascending, so that what is free is found by bisection
    digit = any(c in text for c in "0123456789")
    for kind, pattern in PATTERNS.items():
        if (kind == "email" and "@" not in text) or (kind == "key" and "AKIA" not in text) or (kind in DIGITS and kind not in ("key", "secret") and not digit):
            continue
        for m in pattern.finditer(text):
            at = m.start()
            if kind == "card":
                spans = [(at + a, at + b) for a, b in cards(m[0]) if a or text[at - 1 : at] != "+" or sum(c.isdigit() for c in m[0][:b]) > 15]
            elif kind == "phone":
                spans = [(at, at + n)] if (n := phone(m[0])) else []
            else:
                spans = [m.span(m.lastindex or 0)]
            for s, e in spans:
                k = bisect_left(out, (s, e))
                if (k == 0 or out[k - 1][1] <= s) and (k == len(out) or out[k][0] >= e):
                    out.insert(k, (s, e, kind))
    people = [text[s:e] for s, e, kind in out if kind == "person"]
    if people:  # other mentions of their names
        known = sorted({x for p in people for x in PARTS.findall(p) if len(x) > 1 and x not in OTHER}, key=lambda x: (-len(x), x))
        if known:
            either = "|".join(map(re.escape, known))
            mention = re.compile(rf"(?<!\w)(?:{either})(?!\w)(?:(?:{GAP}{CAPITAL}\.)?{GAP}(?:{either})(?!\w))*")
            taken, i = sorted(out), 0
            for m in mention.finditer(text):
                s, e = m.span()
                while i < len(taken) and taken[i][1] <= s:
                    i += 1
                if i == len(taken) or taken[i][0] >= e:
                    out.append((s, e, "person"))
    return sorted(out)


def replace(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """docs with surrogates in text, and n_entities and entities (kind, start, end in the new text, surrogate)."""
    workers_import(docs.sparkSession)
    docs = docs.drop("n_entities", "entities")
    names = docs.columns
    t = names.index("text")
    entity = StructType([StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("surrogate", StringType())])
    schema = StructType([*(StructField(f.name, StringType()) if f.name == "text" else f for f in docs.schema), StructField("n_entities", LongType()), StructField("entities", ArrayType(entity))])

    def run(batches):
        for batch in batches:
            a, offsets = text_bytes(batch.column(t))
            mark = np.concatenate(([0], np.cumsum(((a >= 48) & (a <= 57)) | (a == 64))))
            maybe = mark[offsets[1:]] > mark[offsets[:-1]]
            texts, counts, found = batch.column(t).to_pylist(), [], []
            for i, text in enumerate(texts):
                own = []
                if text and (maybe[i] or "AKIA" in text or PATTERNS["person"].search(text) or PATTERNS["secret"].search(text)):
                    parts, end, shift = [], 0, 0
                    for s, e, kind in find(text):
                        new = surrogate(kind, text[s:e], key)
                        parts += [text[end:s], new]
                        own.append({"kind": kind, "start": s + shift, "end": s + shift + len(new), "surrogate": new})
                        shift += len(new) - (e - s)
                        end = e
                    if own:
                        texts[i] = "".join([*parts, text[end:]])
                counts.append(len(own))
                found.append(own)
            cols = list(batch.columns)
            cols[t] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*cols, pa.array(counts, pa.int64()), pa.array(found, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("surrogate", pa.string())])))], names=[*names, "n_entities", "entities"])

    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(lean(run), schema)


def audit(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """Collisions over the whole table: rows (kind, surrogate, n_values) where one surrogate stands for several values. There should be none."""
    workers_import(docs.sparkSession)

    def run(batches):
        for batch in batches:
            rows = [(k, t[s:e], surrogate(k, t[s:e], key)) for t in batch.column(0).to_pylist() if t for s, e, k in find(t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], names=["kind", "value", "surrogate"])

    pairs = docs.select(F.col("text").cast("string")).mapInArrow(lean(run), "kind string, value string, surrogate string").distinct()
    return pairs.groupBy("kind", "surrogate").agg(F.count(F.lit(1)).alias("n_values")).where("n_values > 1")


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace(table(spark, sf_dir, "documents").select("doc_id", "text"))
