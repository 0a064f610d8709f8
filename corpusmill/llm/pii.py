"""Personal information inside free text."""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from datetime import date
from itertools import chain

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.io import Stages, texts

# Spellings of addresses, telephone numbers, identity numbers and street addresses.
FULL_WIDTH = {0xFF01 + i: 0x21 + i for i in range(94)} | {0x3000: 0x20}
WIDE = re.compile("[\uff01-\uff5e\u3000]")
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
_DOT = r"(?:\.| ?[\[(](?i:dot)[\])] ?| (?i:dot) )"
_LOCAL = r"(?<![A-Za-z0-9._%+/-])[A-Za-z0-9][A-Za-z0-9._%+-]*"
EMAIL = re.compile(
    rf"{_LOCAL}(?:@| ?[\[(](?i:at)[\])] ?){_LABEL}(?:{_DOT}{_LABEL})*?{_DOT}[A-Za-z]{{2,24}}(?![A-Za-z0-9-]|{_DOT}[A-Za-z0-9])"
    rf"|{_LOCAL} (?i:at) {_LABEL}(?: (?i:dot) {_LABEL})* (?i:dot) [A-Za-z]{{2,24}}(?![A-Za-z0-9-]| (?i:dot) )"
)
PHONE = re.compile(
    r"(?<![A-Za-z0-9_.+/#-])(?:\+?1[ .-]\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}|\+1\d{10}|\(\d{3}\) ?\d{3}[ .-]\d{4}"
    r"|\d{3}([.-])\d{3}\1\d{4}|\+(?!1)\d{1,3}[ .-]?(?:\(0\) ?)?\d(?:[ .-]?\d){6,11}|0\d{2,4}/\d{3,8}(?:-\d{1,4})?"
    r"|0\d{2} \d{4} \d{4}|0\d(?: \d\d){4}|0\d{2,3}[ -]\d{4}[ -]?\d{4}|\(0\d{2,3}\) ?\d{4} ?\d{4}|1[3-9]\d[ -]\d{4}[ -]\d{4})"
    r"(?!\d|[.-]\d|[A-Za-z_])"
)
# Where these patterns may begin is looked up in an outline of the text first, see STARTS and ``_hits``.
SOCIAL = re.compile(r"\d(?<![A-Za-z0-9_.,+/#-]\d)\d{2}([ -])\d{2}\1\d{4}(?![A-Za-z0-9_]|[.,-]\d)")
RESIDENT = re.compile(r"\d(?<![A-Za-z0-9]\d)\d{16}[\dXx](?![A-Za-z0-9])")
PASSPORT = re.compile(r"[A-Z](?<![A-Za-z0-9_/.-][A-Z])(?:[A-Z]?\d{7,8}|\d[A-Z]{2}\d{5})(?![A-Za-z0-9_/-])")
_S = r"(?:[ \t]+|[ \t]*\r?\n[ \t]*)"
_STREET = "Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Court|Ct|Boulevard|Blvd|Way|Place|Pl|Square|Sq|Terrace|Close|Row"
_CITY = r"[A-ZÄÖÜ][A-Za-zäöüß]+(?:-[A-Z][A-Za-z]+)*"
_TAIL = rf"(?:,?{_S}[A-Z]{{2}}{_S}\d{{5}}|,?{_S}[A-Z]{{1,2}}\d{{1,2}}[A-Z]?{_S}\d[A-Z]{{2}}|,?{_S}\d{{4,5}})(?![A-Za-z0-9])"
ADDRESS = re.compile(
    rf"(?<![A-Za-z0-9_./-])\d{{1,5}}[A-Za-z]?{_S}(?:[A-Z][A-Za-z'’-]*{_S}){{1,3}}(?i:{_STREET})\b\.?"
    rf"(?:,?{_S}(?i:apt|apartment|unit|suite|flat|room)\.?{_S}[A-Za-z0-9-]+)?,?{_S}{_CITY}(?:{_S}[A-Z][A-Za-z]+)??(?:{_TAIL}|\b)"
    rf"|(?<![A-Za-z0-9_])[A-ZÄÖÜ][A-Za-zäöüß]+(?i:allee|weg|ring|straße|strasse|str\.|gasse|platz|damm|ufer|chaussee)"
    rf"{_S}\d{{1,4}}[a-z]?,?{_S}\d{{5}}{_S}{_CITY}"
)
HAN_ADDRESS = re.compile(
    r"([㐀-鿿]{2,9}市)[㐀-鿿]{1,6}[区县][㐀-鿿]{1,8}?(?:路|街|大道|巷|弄|道|胡同) ?\d+ ?号"
    r"(?: ?\d+ ?(?:号楼|栋|单元|室|楼|层|座|幢))*"
)
_W = r"(?:[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+|[A-ZÀ-ÖØ-Þ]{2,})(?:[-'’][A-ZÀ-ÖØ-Þ][A-Za-zÀ-ÖØ-öø-ÿ]+)*"
NAME = re.compile(rf"(?<![\w/.@-])(?=(({_W})((?: [A-ZÀ-ÖØ-Þ]\.)*)(,?) ({_W})(?![\w@])))")
HAN_SEED = re.compile(r"[:：] ?([㐀-鿿]{2,4})[ \t]*\r?\n")
WIDE_SEED = re.compile(r"[:：][ \u3000]?[㐀-鿿]{2,4}[ \t\u3000]*\r?\n")  # the same where spaces may be full-width
HAN_CITY = re.compile(r"(?<![㐀-鿿])([㐀-鿿]{2,5}市)[㐀-鿿]{1,6}[区县][㐀-鿿]{1,8}?(?:路|街|大道|巷|弄|道|胡同) ?\d+ ?号")
NEAR = re.compile(r"\w+|[^\w\s]|\n")
BEFORE, AFTER = re.compile(r"([^\W\d_]+)[^\w\n|]*\Z"), re.compile(r"[^\w\n|]*([^\W\d_]+)")

HAN_RUN, HAN_TWO = re.compile(r"[㐀-鿿]{2,}"), re.compile(r"[㐀-鿿]{2}")
BEFORE_CITY = re.compile(r"([㐀-鿿]{2,9}市)\Z")

# Loose forms of identifiers, of which only those come out that stand where known ones stand.
LOOSE = {
    "email": re.compile(r"(?<![\w.@/+-])[A-Za-z0-9][\w.+-]{0,63} ?(?:@|[\[(](?i:at)[\])]) ?[A-Za-z0-9][\w.-]{0,250}[A-Za-z0-9](?![\w@-])"),
    "phone": re.compile(r"(?<![\w.+-])[+(]?\d(?:[ ()./-]{0,2}\d){6,14}(?![\w-]|\.\d)"),
    "id_number": re.compile(r"(?<![\w/.-])(?=(?:[A-Z -]{0,5}\d){5})[A-Z0-9]{2,18}(?:[ -][A-Z0-9]{2,8}){0,3}(?![\w/-]|\.\d)"),
    "address": re.compile(r"\d(?<![\w./-]\d)\d{0,4}[A-Za-z]? (?:[A-Z][\w'’-]*,? ){1,5}[A-Z][\w'’-]+(?:,? [A-Z]{2})? ?\d{4,5}(?!\w)"),
}
#: A text's outline has a byte for each character: 0 for digits, A and a for ASCII letters, E and e for those of Latin-1, a space
#: for what ``_S`` takes, ' for ’, ? for what else is beyond Latin-1 and the character itself for others.
OUTLINE = bytes(
    ord("0") if chr(c).isdecimal() else 32 if chr(c) in " \t\r\n" else c if not chr(c).isalpha()
    else ord("aAeE"[2 * (c > 127) + chr(c).isupper()]) for c in range(256)
)
#: Digits that an outline does not show.
ODD_DIGIT = re.compile(r"[^\D0-9]")
_MANY = rb"(?=(?:[ ()./-]{0,2}0){%d})"
_STREET_NO = rb"0{0,4}[aA]? +A[aA'-]* +[aA?]"
#: By pattern, parts of outlines one of which it needs, and what an outline has where it may begin. Each of those begins
#: with one byte, which is found fast, and takes no more, as places may overlap.
STARTS = {
    RESIDENT: ((b"0" * 17,), (rb"0(?<![aA0]0)(?=0{16})",)),
    PASSPORT: ((b"A0000000", b"A0AA00000"), (rb"A(?<![aA0_/.-]A)(?=A?0{7}|0AA0{5})",)),
    SOCIAL: ((b"000-00-0000", b"000 00 0000"), (rb"0(?<![aA0_.,+/#-]0)(?=00[ -]00[ -]0000)",)),
    ADDRESS: (
        (b"0 ", b"0a ", b"0A "),
        (rb"0(?<![aA0_./-]0)(?=%b)" % _STREET_NO, *(b"%b(?<![aA0_]%b)" % (c, c) + rb"(?=[aAeE]+(?:\?[aAeE]*){0,3}\.? +0{1,4}a?,? +00000 )" for c in (b"A", b"E"))),
    ),
    PHONE: ((b"00",), tuple(b"%b(?<![aA0_.+/#-]%b)" % (c, c) + _MANY % 5 for c in (b"0", rb"\+", rb"\("))),
    NAME: ((b" A", b" E"), tuple(b"%b(?<![aAeE0_/.@-]%b)" % (c, c) + rb"(?=[aAeE'-]+(?: [AE]\.)*,? [AE])" for c in (b"A", b"E"))),
    LOOSE["phone"]: ((b"0",), tuple(b"%b(?<![aA0_.+-]%b)" % (c, c) + _MANY % 6 for c in (b"0", rb"\+", rb"\("))),
    LOOSE["id_number"]: ((b"0",), (rb"0(?<![aA0_/.-]0)(?=[A0])(?=(?:[A -]{0,5}0){4})", rb"A(?<![aA0_/.-]A)(?=[A0])(?=[A -]{0,4}0(?:[A -]{0,5}0){4})")),
    LOOSE["address"]: ((b"0 A", b"0a A", b"0A A"), (rb"0(?<![aA0_./-]0)(?=0{0,4}[aA]? A)",)),
}
STARTS = {p: (needs, [re.compile(x) for x in places]) for p, (needs, places) in STARTS.items()}
#: Characters before a name by which copies of a text are told.
AROUND = 80
#: Scores are taken by turns until none moves by more.
SETTLED, MOST_ROUNDS = 0.01, 50
#: What an identifier of a known form, and one of a loose form, is trusted before any context is known.
KNOWN_FORM, LOOSE_FORM = 0.97, 0.1
#: Rows of spans by text up to which they are broadcast to the texts, not joined by shuffles.
BROADCAST_TEXTS = 100_000
#: What a side without a known pattern says of a Chinese name whose other side has one: less than any pattern that counts.
EDGE = 0.2
PLACEHOLDERS = {"email": "<EMAIL>", "phone": "<PHONE>", "id_number": "<ID_NUMBER>", "address": "<ADDRESS>", "name": "<NAME>"}
PARTS = "record_table string, record_id string, part string, text string"
SPANS = (
    "record_table string, record_id string, part string, text_key bigint, kind string, value string, start int, stop int, "
    "given string, family string, left string, right string, seed boolean, base double, city string, around bigint"
)
KEYS = ["record_table", "record_id", "part", "text_key"]


def _walk(value, path: str = "") -> Iterator[tuple[str, str]]:
    if isinstance(value, dict):
        for k, v in value.items():
            yield from _walk(v, f"{path}/{k}")
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from _walk(v, f"{path}/{i}")
    elif isinstance(value, str):
        yield path, value


STRING = re.compile(r'"((?:[^"\\]|\\.)*)("|\\?\Z)\s*(:?)', re.S)


def _readable(doc: str) -> Iterator[tuple[str, str]]:
    """The text values of a document that does not parse: all its strings but keys, the last one up to where it is cut."""
    for n, m in enumerate(STRING.finditer(doc)):
        if not m[3]:
            raw = m[1] if m[2] == '"' else re.sub(r"\\u[0-9a-fA-F]{0,3}\Z", "", m[1])
            try:
                yield f"#{n}", json.loads(f'"{raw}"', strict=False)
            except ValueError:  # an escape that is none
                yield f"#{n}", raw


def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(record_id, JSON text) -> its text values; of a broken document those before the damage, or whatever strings it holds."""
    decoder = json.JSONDecoder()
    for batch in batches:
        rows = []
        for key, doc in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            try:
                found = _walk(decoder.raw_decode(doc.lstrip())[0])
            except (ValueError, RecursionError):
                found = _readable(doc)
            rows += [("entries", key, path, text) for path, text in found]
        cols = list(zip(*rows)) or [[]] * 4
        names = ["record_table", "record_id", "part", "text"]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=names)


def _chinese(c: str) -> Column:
    """Whether a text holds a Chinese character. One of ASCII only is as long in bytes as in characters, which is told sooner."""
    return (F.octet_length(c) > F.char_length(c)) & F.col(c).rlike(r"[\x{3400}-\x{9FFF}]")


def text_parts(spark: SparkSession, d: str, chinese: bool = False) -> DataFrame:
    """Every text that may hold personal information: record_table, record_id, part, text. Of documents, only those that may hold
    Chinese where CHINESE."""
    units = texts(spark, d, "graded_units").select(F.lit("graded_units"), "id", F.lit("body"), "body")
    findings = texts(spark, d, "findings").select(F.lit("findings"), F.col("finding_id").cast("string"), F.lit("value"), "value")
    docs = texts(spark, d, "entries").where("doc is not null").select("entry_id", "doc")
    if chinese:
        docs = docs.where(_chinese("doc") | (F.contains("doc", F.lit("\\u")) & F.col("doc").rlike(r"\\u[3-9]")))
    docs = docs.mapInArrow(_values, PARTS)
    names = ["record_table", "record_id", "part", "text"]
    parts = units.toDF(*names).union(findings.toDF(*names)).union(docs)
    return parts.where("text is not null and text != ''")


def resident_number(x: str) -> bool:
    """Whether 18 characters hold a date of birth and end with their check digit."""
    try:
        date(int(x[6:10]), int(x[10:12]), int(x[12:14]))
    except ValueError:
        return False
    weights = [pow(2, 17 - i, 11) for i in range(17)]
    total = sum(int(c) * w for c, w in zip(x, weights)) % 11
    return 1900 <= int(x[6:10]) <= 2100 and x[17].upper() == "10X98765432"[total]


class Spans:
    """Spans that do not overlap, in order of their places."""

    def __init__(self):
        self.starts: list[int] = []
        self.found: list[tuple[int, int, str]] = []

    def free(self, a: int, b: int) -> bool:
        i = bisect_left(self.starts, b)
        return not i or self.found[i - 1][1] <= a

    def add(self, kind: str, a: int, b: int) -> None:
        if self.free(a, b):
            i = bisect_left(self.starts, a)
            self.starts.insert(i, a)
            self.found.insert(i, (a, b, kind))


def _plain(text: str) -> str:
    """The text with usual characters in place of full-width ones."""
    if not text.isascii():
        for c in {*WIDE.findall(text)}:
            text = text.replace(c, chr(FULL_WIDTH[ord(c)]))
    return text


def _outline(text: str) -> bytes | None:
    """The text's OUTLINE; none where it would not show all digits."""
    if not text.isascii() and ODD_DIGIT.search(text):
        return None
    return text.replace("’", "'").encode("latin-1", "replace").translate(OUTLINE)


def _hits(pattern: re.Pattern, text: str, outline: bytes | None = None) -> Iterator[re.Match]:
    """The matches that ``finditer`` gives, tried where the text's outline has the pattern's STARTS only."""
    if pattern not in STARTS or (outline is None and (outline := _outline(text)) is None):
        return pattern.finditer(text)
    needs, places = STARTS[pattern]
    for x in needs:
        if x in outline:
            break
    else:
        return iter(())
    found = [m.start() for x in places for m in x.finditer(outline)]
    return _tried(pattern, text, sorted(found)) if found else iter(())


def _tried(pattern: re.Pattern, text: str, places: list[int]) -> Iterator[re.Match]:
    done = 0
    for i in places:
        if i >= done and (m := pattern.match(text, i)):
            yield m
            done = m.end()


def _numbered(outline: bytes | None) -> bool:
    """Whether a text with that outline holds a digit, which every form but email addresses and names needs."""
    return outline is None or b"0" in outline


def _written(text: str) -> bool:
    """Whether a text holds anything that every spelling of an email address needs."""
    low = text.lower()
    return "@" in low or "at)" in low or "at]" in low or " dot " in low


def shaped(text: str, outline: bytes | None = None) -> Spans:
    """Spans of a known form, in order of precedence; none overlaps an earlier one. A Chinese address begins with the last
    three characters of its city at most, see ``personal_spans``."""
    spans, outline = Spans(), outline or _outline(text)
    for m in EMAIL.finditer(text) if _written(text) else ():
        spans.add("email", *m.span())
    if not _numbered(outline):
        return spans
    for m in _hits(RESIDENT, text, outline):
        if resident_number(m.group()):
            spans.add("id_number", *m.span())
    for m in _hits(PASSPORT, text, outline):
        spans.add("id_number", *m.span())
    for m in _hits(ADDRESS, text, outline):
        spans.add("address", *m.span())
    for m in HAN_ADDRESS.finditer(text) if "市" in text else ():
        spans.add("address", max(m.start(), m.end(1) - 3), m.end())
    for m in _hits(PHONE, text, outline):
        spans.add("phone", *m.span())
    for m in _hits(SOCIAL, text, outline):
        spans.add("id_number", *m.span())
    return spans


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chinese names that stand after a colon with an address on the next line, and cities with nothing Chinese before."""
    for batch in batches:
        rows = []
        for text in batch.column(0).to_pylist():
            placed = "市" in text and "号" in text
            if not placed and not WIDE_SEED.search(text):
                continue
            plain = _plain(text)
            for m in HAN_SEED.finditer(plain):
                end = plain.find("\n", m.end())
                if EMAIL.search(plain, m.end(), end if end >= 0 else len(plain)):
                    rows.append(("name", m.group(1)))
            if placed:
                rows += [("city", m.group(1)) for m in HAN_CITY.finditer(plain)]
        cols = list(zip(*rows)) or [[], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["kind", "value"])


def _places(text: str, a: int, b: int, starts: set[str], stops: set[str], family: set[str], given: set[str]) -> list[tuple[int, int]]:
    """2 to 4 characters of the Chinese run from A to B that may be a name: of seeded characters, or in a context.

    A context begins at the run's start or after a word of STARTS and ends at its end or before a word of
    STOPS. Where such a word has no fitting other side, every length beside it is a candidate.
    """
    found = set()
    for i in range(a, b - 1):
        if text[i] in family and text[i + 1] in given:
            found.add((i, i + 2))
            for j in range(i + 3, min(i + 4, b) + 1):
                if text[j - 1] not in given:
                    break
                found.add((i, j))
    begin = [i for i in range(a, b - 1) if i == a or i - a >= 2 and text[i - 2 : i] in starts]
    end = [j for j in range(a + 2, b + 1) if j == b or b - j >= 2 and text[j : j + 2] in stops]
    found.update((i, j) for i in begin for j in end if 2 <= j - i <= 4)
    left, right = {i for i, _ in found}, {j for _, j in found}
    found.update((i, j) for i in begin if i > a and i not in left for j in range(i + 2, min(i + 4, b) + 1))
    found.update((i, j) for j in end if j < b and j not in right for i in range(max(a, j - 4), j - 1))
    return sorted(found)


def _marks(family: set[str], given: set[str], words: set[str]) -> re.Pattern:
    """What a Chinese run longer than a name must hold for any candidate: the beginning of a seeded name, or a context's word."""
    either = lambda x: "".join(sorted(x))
    return re.compile("|".join([f"[{either(family)}][{either(given)}]", *map(re.escape, sorted(words))]))


def _beside(model):
    """The two Chinese characters before and after each name of seeded characters, where such stand there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, given = model.value
        seeded = re.compile(f"[{''.join(sorted(family))}](?=([{''.join(sorted(given))}]{{1,3}}))")
        for batch in batches:
            rows = []
            for text in batch.column(0).to_pylist():
                for m in seeded.finditer(text):
                    i = m.start()
                    before = HAN_TWO.match(text, i - 2, i) if i > 1 else None
                    for j in range(i + 2, m.end(1) + 1):
                        if before:
                            rows.append(("L", before[0], text[i:j]))
                        if after := HAN_TWO.match(text, j):
                            rows.append(("R", after[0], text[i:j]))
            cols = list(zip(*rows)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["side", "word", "value"])

    return run


def _near_han(left: str, right: str) -> tuple[str, str]:
    """Contexts of a Chinese name: words are not set apart there, so that two characters stand for a word beside it, three before a mark."""
    han = lambda x: "㐀" <= x <= "鿿"
    if left and han(left[-1]):
        left = left[-2:] if len(left) > 1 and han(left[-2]) else left[-1]
    elif " " in left and han(left.split(" ")[0][-1]):
        word, mark = left.split(" ")
        left = f"{word[-3:]} {mark}"
    if right and han(right[0]):
        right = right[:2] if len(right) > 1 and han(right[1]) else right[0]
    elif " " in right and han(right.split(" ")[1][0]):
        mark, word = right.split(" ")
        right = f"{mark} {word[:2]}"
    return left, right


def hash_of(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def _token_start(text: str, stop: int) -> int:
    """Where the token of NEAR that ends at STOP begins, within 40 characters; STOP where none ends there."""
    i = stop - 1
    if text[i].isalnum() or text[i] == "_":
        least = max(0, stop - 40)
        while i > least and (text[i - 1].isalnum() or text[i - 1] == "_"):
            i -= 1
        return i
    return stop if text[i].isspace() and text[i] != "\n" else i


def _scan(model):
    def context(text: str, a: int, b: int, at: dict[int, str], ends: dict[int, str]) -> tuple[str, str, bool]:
        """Two tokens on either side; a found address or number is one token."""
        left, right, seed = [], [], False
        i = a
        while len(left) < 2:
            j = i
            while j > 0 and text[j - 1] in " \t":
                j -= 1
            if j in ends:
                left.append(f"<{ends[j]}>")
                break
            if j == 0:
                left.append("^")
                break
            i = _token_start(text, j)
            if i == j:
                break
            if i == j - 40:  # longer than that
                left.append("<long>")
                break
            left.append(text[i:j].lower())
        i = b
        while len(right) < 3:
            while i < len(text) and text[i] in " \t\r":
                i += 1
            if i in at:
                right.append(f"<{at[i]}>")
                seed = at[i] == "email" and (len(right) == 1 or right[0] in "<|([\n")
                break
            m = NEAR.match(text, i)
            if not m:
                right.append("$")
                break
            right.append(m.group().lower())
            i = m.end()
        return " ".join(left[::-1]), " ".join(right[:2]), seed

    def shouted(text: str, a: int, b: int) -> bool:
        """Whether capitals belong to a sentence in capitals."""
        if not text[a:b].isupper():
            return False
        beside = (BEFORE.search(text, max(0, a - 30), a), AFTER.match(text, b, b + 30))
        return any(m and len(m[1]) > 1 and m[1].isupper() for m in beside)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, given, sizes, starts, stops = model.value
        marked = family and _marks(family, given, starts | stops)

        def base(name: str) -> float:
            """Of a Chinese name: by characters that seeds have in the same place, and by the share of seeds as long."""
            known, rest = name[0] in family, sum(c in given for c in name[1:]) / (len(name) - 1)
            usual = sizes.get(len(name), 0.0)
            return 0.05 + 0.4 * usual if known and rest == 1 else 0.02 + 0.1 * known + 0.1 * rest + 0.03 * usual

        for batch in batches:
            rows = []
            columns = (batch.column(i).to_pylist() for i in range(5))
            for table, key, part, text, text_key in zip(*columns):
                plain = _plain(text)
                outline = _outline(plain)
                spans = shaped(plain, outline)
                head = (table, key, part, text_key)
                at, ends = {a: k for a, _, k in spans.found}, {b: k for _, b, k in spans.found}
                for a, b, kind in spans.found:
                    left, right, _ = context(plain, a, b, at, ends)
                    city = None
                    if kind == "address" and (m := BEFORE_CITY.search(plain, max(0, a - 6), min(b, a + 3))):
                        city = m[1]
                    rows.append((*head, kind, text[a:b], a, b, None, None, left, right, True, None, city, None))
                written, numbered = _written(plain), _numbered(outline)
                for kind, pattern in LOOSE.items():
                    for m in _hits(pattern, plain, outline) if (written if kind == "email" else numbered) else ():
                        a, b = m.span()
                        if spans.free(a, b):
                            left, right, _ = context(plain, a, b, at, ends)
                            if any(c.isalpha() for c in left):
                                rows.append((*head, kind, text[a:b], a, b, None, None, left, right, False, None, None, None))
                names = [
                    (m.start(1), m.end(1), *((m[5], m[2]) if m[4] else (m[2], m[5]))) for m in _hits(NAME, plain, outline)
                ]
                for m in HAN_RUN.finditer(plain) if family and not plain.isascii() else ():
                    a, b = m.span()
                    if marked.search(plain, a, b):
                        names += [(i, j, plain[i:j], "") for i, j in _places(plain, a, b, starts, stops, family, given)]
                    elif b - a <= 4:  # all that ``_places`` gives of a run without a mark
                        names.append((a, b, m[0], ""))
                for a, b, first, last in names:
                    if not spans.free(a, b) or (last and shouted(plain, a, b)):
                        continue
                    left, right, seed = context(plain, a, b, at, ends)
                    if not last:
                        left, right = _near_han(left, right)
                    rows.append((*head, "name", text[a:b], a, b, first.casefold(), last.casefold(), left, right, seed, None if last else base(first), None, hash_of(plain[max(0, a - AROUND) : a])))
            cols = list(zip(*rows)) or [[]] * 16
            kinds = [pa.string()] * 3 + [pa.int64()] + [pa.string()] * 2 + [pa.int32()] * 2 + [pa.string()] * 4 + [pa.bool_(), pa.float64(), pa.string(), pa.int64()]
            names = [c.split()[0] for c in SPANS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)

    return run


def _edges(candidates: DataFrame, *instance: str) -> DataFrame:
    """Of candidates the patterns they stand in: the words before, and those after. Punctuation alone says nothing."""
    sides = F.array(F.concat(F.lit("L "), "left"), F.concat(F.lit("R "), "right"))
    return candidates.select(*instance, F.explode(sides).alias("pattern")).where(r"pattern rlike '[ <][\\p{L}\\p{N}]'").distinct()


def _settled(instances: DataFrame, step, stages: Stages) -> DataFrame:
    """Scores of instances by turns with those of patterns, until none moves by more than SETTLED."""
    scores = instances.withColumn("score", F.col("prior")).withColumn("pattern", F.lit(None).cast("string"))
    for _ in range(MOST_ROUNDS):
        new = stages.keep(step(scores.drop("pattern")).withColumn("moved", F.abs(F.col("score") - F.col("before"))).drop("before"))
        scores = new.drop("moved")
        if (new.agg(F.max("moved")).first()[0] or 0.0) <= SETTLED:
            return scores
    return scores


def value_scores(candidates: DataFrame, stages: Stages) -> DataFrame:
    """(kind, value, score, pattern) of email addresses, telephone and identity numbers and street addresses.

    Values of a known form are the seeds: the words before them are the patterns of their kind. By turns, a pattern is
    worth the mean score of the distinct values that stand in it, and a value gains from its best pattern;
    one of a loose form comes out where it stands in patterns of known ones only.
    """
    instance = ["kind", "value"]
    edges = _edges(candidates.withColumn("right", F.lit("")), *instance, "seed")  # what stands after says little of a number
    induced = edges.where("seed").select("kind", "pattern").distinct()
    edges = stages.keep(edges.join(induced, ["kind", "pattern"], "left_semi").select(*instance, "pattern"))
    single = candidates.groupBy(*instance).agg(F.max("seed").alias("seed"))
    prior = F.when(F.col("seed"), F.lit(KNOWN_FORM)).otherwise(F.lit(LOOSE_FORM))
    loose = edges.select(*instance).distinct().withColumn("met", F.lit(True))  # others keep what they have
    instances = stages.keep(single.join(loose, instance, "left").where("seed or met").select(*instance, prior.alias("prior")))

    def step(scores: DataFrame) -> DataFrame:
        worth = (
            edges.join(scores, instance).groupBy("kind", "pattern").agg((F.sum("score") / (F.count("*") + 2)).alias("worth")).where("worth >= 0.6")
        )
        best = edges.join(worth, ["kind", "pattern"]).groupBy(*instance).agg(F.max("worth").alias("gain"), F.max_by("pattern", F.struct("worth", "pattern")).alias("pattern"))
        score = 1 - (1 - F.col("prior")) * (1 - 0.8 * F.coalesce("gain", F.lit(0.0)))
        return scores.withColumnRenamed("score", "before").join(best, instance, "left").select(*instance, "prior", "before", score.alias("score"), "pattern")

    return _settled(instances, step, stages).select(*instance, "score", "pattern")


def name_scores(candidates: DataFrame, stages: Stages) -> DataFrame:
    """(given, family, score, pattern) of candidates, by turns with the contexts they stand in.

    Seeds are names that lead to an email address most times they stand anywhere. A seeded part of a name lends trust by the number of
    different partners it has among seeds. Then, by turns, a pattern (the words before, or after) is worth
    the mean trust of its distinct instances, and an instance gains from its best pattern. A name of
    unknown parts that comes again and again in different texts after one or two different words only (a
    team, a role) gains nothing; where most of its occurrences have the same text before them, they are
    copies and say no such thing.
    A Chinese name has no parts: its characters and length lend it a little trust (``base``), and one of
    unseen characters gains from the words before and after together, which also mark its ends.
    """
    instance = ["given", "family"]
    edges = stages.keep(_edges(candidates, *instance))
    before = F.substring_index("left", " ", -1)
    single = candidates.groupBy(*instance).agg(
        F.countDistinct("around").alias("n"),
        F.count("*").alias("all"),
        (F.count_if("seed") * 2 >= F.count("*")).alias("seed"),
        F.max("base").alias("base"),
        F.countDistinct(F.when(before.rlike(r"^<?[\p{L}\p{N}]"), before)).alias("places"),
    )
    seeds = single.where("seed").select(*instance)
    trust = lambda n: n / (n + 1)
    by_given = seeds.groupBy("given").agg(trust(F.countDistinct("family")).alias("tg"))
    by_family = seeds.where("family != ''").groupBy("family").agg(trust(F.countDistinct("given")).alias("tf"))
    prior = F.when(F.col("seed"), F.lit(0.99)).otherwise(
        F.when(F.col("family") == "", F.col("base")).otherwise(
            1 - (1 - 0.9 * F.coalesce("tg", F.lit(0.0))) * (1 - 0.4 * F.coalesce("tf", F.lit(0.0)))
        )
    )
    instances = stages.keep(
        single.join(by_given, "given", "left")
        .join(by_family, "family", "left")
        .select(*instance, prior.alias("prior"), ((F.col("n") < 4) | (F.col("n") < 0.5 * F.col("all")) | (F.col("places") > 2)).alias("open"))
    )
    # an unseen Chinese candidate speaks for a pattern by its score, but hardly against it as long as it may be a name
    unseen = (F.col("family") == "") & (F.col("prior") < 0.3)
    counts = F.when(unseen & F.col("open"), F.greatest(F.col("score"), F.lit(0.2))).otherwise(1.0)
    side = lambda x: F.coalesce(F.max(F.when(F.col("pattern").startswith(x), F.col("worth"))), F.lit(EDGE))

    def step(scores: DataFrame) -> DataFrame:
        worth = (
            edges.join(scores, instance)
            .groupBy("pattern")
            .agg((F.sum("score") / (F.sum(counts) + 2)).alias("worth"))
            .where("worth >= 0.1")
        )
        best = (
            edges.join(worth, "pattern").groupBy(*instance)
            .agg(F.max("worth").alias("best"), (1 - (1 - side("L ")) * (1 - side("R "))).alias("both"), F.max_by("pattern", F.struct("worth", "pattern")).alias("pattern"))
        )
        least = F.when(F.col("family") == "", F.col("both")).otherwise(F.col("best"))
        gain = F.when(F.col("prior") >= 0.3, least).when(F.col("open") & (least >= F.when(unseen, 0.6).otherwise(0.7)), least)
        score = 1 - (1 - F.col("prior")) * (1 - 0.8 * F.coalesce(gain, F.lit(0.0)))
        joined = scores.withColumnRenamed("score", "before").join(best, instance, "left")
        return joined.select(*instance, "prior", "open", "before", score.alias("score"), "pattern")

    return _settled(instances, step, stages).select(*instance, "score", "pattern")


def _with_cities(addresses: DataFrame, cities: DataFrame) -> DataFrame:
    """Chinese addresses, moved to the start of the longest learned city that their run of characters ends with."""
    ends = F.expr("transform(sequence(1, length(city) - 2), i -> substring(city, i))")
    named = addresses.where("city is not null").select("city").distinct().select("city", F.explode(ends).alias("name"))
    known = named.join(cities, "name", "left_semi").groupBy("city").agg(F.max(F.length("name")).alias("keep"))
    return addresses.join(known, "city", "left")


def personal_spans(parts: DataFrame, least: float = 0.5, hidden: float = 0.0, chinese: DataFrame | None = None) -> DataFrame:
    """Personal information in texts (record_table, record_id, part, text): one row a span.

    Result: record_table, record_id, part, text_key (a value of the text), kind, value (as it stands),
    start, stop, score, pattern (the best context it stands in, null where none is worth anything).

    All kinds are bootstrapped. Of email addresses (also spelled out), telephone, social security, resident
    and passport numbers and street addresses the known forms are seeds (resident numbers by date and check
    digit too; a full-width spelling counts as the usual one); loose forms come out where they stand in
    their patterns, see ``value_scores``. A Chinese address begins with a city learned where nothing Chinese
    stands before it, else with three characters. Names: see ``name_scores``; Chinese candidates are 2 to 4
    characters in a context, or of the characters of seeded names: see ``_places``. Of overlapping spans the
    better one stays. ``hidden`` is a share of the values of known form that are taken as loose, to measure
    how many are found by their contexts. ``chinese``: those of the texts that may hold Chinese (all that do, whatever others), where
    they are had for less than by going through all.

    Two passes over the texts and two more over Chinese ones; candidates are scored by joins. Null and empty texts give
    nothing. Repeated rows give their spans once.
    """
    spark = parts.sparkSession
    parts = parts.where("text is not null")
    chinese = (parts if chinese is None else chinese).where(_chinese("text")).select("text")
    stages = Stages(spark, "pii")
    sc = spark.sparkContext
    found = stages.keep(
        chinese.mapInArrow(_seeds, "kind string, value string")
        .groupBy("kind", "value").agg(F.count("*").alias("n"))
    )
    seeded = found.where("kind = 'name'")
    chars = lambda c: {r[0] for r in c.distinct().collect()}  # noqa: E731  # no more than the script has
    family = chars(seeded.select(F.substring("value", 1, 1)))
    given = chars(seeded.select(F.explode(F.split(F.expr("substring(value, 2)"), "")).alias("c")).where("c != ''"))
    sizes = dict(seeded.groupBy(F.length("value")).count().collect())
    sizes = {n: c / sum(sizes.values()) for n, c in sizes.items()}
    beside = (
        chinese.mapInArrow(_beside(sc.broadcast((family, given))), "side string, word string, value string")
        .groupBy("side", "word").agg(F.countDistinct("value").alias("names")).where("names > 1").select("side", "word").collect()
        if family else []
    )
    starts, stops = ({w for s, w in beside if s == side} for side in "LR")
    model = sc.broadcast((family, given, sizes, starts, stops))

    scan = parts.select("record_table", "record_id", "part", "text", F.xxhash64("text").alias("text_key")).mapInArrow(_scan(model), SPANS)
    spans = stages.keep(scan.distinct())
    columns = [*KEYS, "kind", "value", "start", "stop", "score", "pattern"]

    values = spans.where("kind != 'name'")
    if hidden:
        kept = F.pmod(F.xxhash64("value"), F.lit(1000)) >= int(1000 * hidden)
        values = values.withColumn("seed", F.col("seed") & kept)
    scored = values.join(value_scores(values, stages).where(F.col("score") >= least), ["kind", "value"])
    seen = found.where("kind = 'city'").select(F.col("value").alias("name"))
    tails = F.expr("transform(sequence(2, length(name) - 2), i -> substring(name, i))")
    longer = seen.where("length(name) > 3").select("name", F.explode(tails).alias("tail")).join(seen.select(F.col("name").alias("tail")), "tail", "left_semi")
    cities = seen.join(longer.select("name").distinct(), "name", "left_anti")  # of 'at X city' and 'X city' the latter
    scored = _with_cities(scored, cities).withColumn("before", F.coalesce(F.col("keep") - F.least(F.lit(3), F.length("city")), F.lit(0)))
    scored = scored.withColumn("value", F.when(F.col("before") > 0, F.concat(F.expr("substring(city, length(city) - keep + 1, before)"), "value")).when(F.col("before") < 0, F.expr("substring(value, 1 - before)")).otherwise(F.col("value")))
    scored = scored.withColumn("start", F.col("start") - F.col("before"))

    names = spans.where("kind = 'name'")
    scores = name_scores(names, stages).where(F.col("score") >= least)
    w = Window.partitionBy(*KEYS).orderBy("start", "stop")
    beside = lambda f, c: f(c).over(w)
    # Chinese candidates are up to 4 long, so that those that overlap begin within 3 characters of each other
    around = Window.partitionBy(*KEYS).orderBy("start").rangeBetween(-3, 3)
    rank = F.struct(F.round("score", 9).alias("score"), (F.col("stop") - F.col("start")).alias("long"), (-F.col("start")).alias("first"), "start", "stop")
    likely = names.join(scores, ["given", "family"])
    chinese = (
        likely.where("family = ''").withColumn("rank", rank)
        .withColumn("others", F.collect_list("rank").over(around))
        .where("not exists(others, x -> x.start < stop and start < x.stop and x > rank)")
        .drop("rank", "others")
    )
    # what has a known form stays, whatever stands across it
    sure = F.when(F.col("seed") & (F.col("kind") != "name"), F.col("score") + 1).otherwise(F.col("score"))
    every = likely.where("family != ''").unionByName(chinese).select(*columns, "seed").unionByName(scored.select(*columns, "seed"))
    better = (
        every.withColumn("sure", sure)
        .withColumn("prev", F.struct(beside(F.lag, "stop").alias("stop"), beside(F.lag, "sure").alias("sure")))
        .withColumn("next", F.struct(beside(F.lead, "start").alias("start"), beside(F.lead, "sure").alias("sure")))
        .where("not coalesce(prev.stop > start and prev.sure >= sure, false)")
        .where("not coalesce(next.start < stop and next.sure > sure, false)")
    )
    return better.select(columns)


def redacted(parts: DataFrame, spans: DataFrame) -> DataFrame:
    """The texts that hold spans, with a placeholder in place of each, and nothing else altered: PARTS' columns.

    Repeated rows come out each. Spans are gathered by text and sent to the texts while they are of at most
    BROADCAST_TEXTS texts; beyond that both are shuffled.
    """
    marks = F.create_map(*[F.lit(x) for x in chain.from_iterable(PLACEHOLDERS.items())])
    row = F.struct("start", "stop", marks[F.col("kind")].alias("mark"))
    lists = Stages(parts.sparkSession, "redacted").keep(spans.groupBy(*KEYS).agg(F.array_sort(F.collect_list(row)).alias("spans")))
    state = "struct<text: string, done: int>"
    from_ = F.struct(F.lit("").alias("text"), F.lit(0).alias("done")).cast(state)

    def put(s, x):
        kept = F.substring("text", s["done"] + 1, x["start"] - s["done"])
        return F.struct(F.concat(s["text"], kept, x["mark"]).alias("text"), x["stop"].alias("done")).cast(state)

    rest = lambda s: F.concat(s["text"], F.substring("text", s["done"] + 1, F.length("text")))
    sent = F.broadcast(lists) if lists.count() <= BROADCAST_TEXTS else lists
    keyed = parts.withColumn("text_key", F.xxhash64("text"))
    hold = keyed.join(sent, on=[keyed[k].eqNullSafe(sent[k]) if k == "record_id" else keyed[k] == sent[k] for k in KEYS])
    return hold.select(*[keyed[c] for c in ("record_table", "record_id", "part")], F.aggregate("spans", from_, put, rest).alias("text"))
