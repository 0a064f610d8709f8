"""Tokens, sizes, pieces and references as column expressions; all of it runs inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lexemes are identifiers joined by . / + : - or runs of Han characters; borders of words within a chunk.
LEXEME = r"(?i)[a-z0-9_]+(?:[./+:-][a-z0-9_]+)*|[\x{3400}-\x{9fff}]+"
BORDER = r"(?<=[a-z0-9])(?=[A-Z][a-z])|(?<=[A-Z])(?=[A-Z][a-z])|(?<=[a-z])(?=[A-Z0-9])"
HAN = r"^[\x{3400}-\x{9fff}]"


def lexemes(text: Column | str) -> Column:
    """array<string> of the lexemes as spelled, in order; an empty text has none, null gives null."""
    return F.regexp_extract_all(text, F.lit(LEXEME), F.lit(0))


def bigrams(run: Column) -> Column:
    """Overlapping pairs of a run of Han characters; a single character stays."""
    return F.when(F.length(run) == 1, F.array(run)).otherwise(
        F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, F.lit(2)))
    )


def identifier_parts(raw: Column) -> Column:
    """Further spellings under which a lexeme is found: its joined parts, their words, and words within words.

    In order, each once, longer than one character and other than the lexeme itself. One pass by regular
    expressions: borders between words are written as spaces first (at ``_``, before a capital that begins a
    word, between capitals and a word, before digits that lead letters), so that parts, chunks and words come
    out of one split each.
    """
    plain = F.filter(F.split(raw, "[-./:+]"), lambda p: p.rlike(r"^\D\w*$"))
    return F.filter(
        F.array_distinct(F.flatten(F.transform(plain, _spellings))), lambda w: (F.length(w) > 1) & (w != F.lower(raw))
    )


def _spellings(part: Column) -> Column:
    """A part, then each of its chunks followed by the chunk's words."""
    chunks = F.transform(F.split(part, "_+"), lambda c: F.concat(F.array(c), F.split(F.regexp_replace(c, BORDER, " "), " ")))
    return F.transform(F.concat(F.array(part), F.flatten(chunks)), lambda w: F.lower(w))


def terms(text: Column | str, parts: bool = True) -> Column:
    """array<string> of index terms in order: lower-case lexemes, each followed by its parts, and Han bigrams."""

    def expand(raw: Column) -> Column:
        word = F.array(F.lower(raw))
        plain = F.concat(word, identifier_parts(raw)) if parts else word
        simple = raw.rlike("^[a-z]*[0-9]*$")  # has no parts; most lexemes are such
        return F.when(simple, F.array(raw)).when(raw.rlike(HAN), bigrams(raw)).otherwise(plain)

    return F.flatten(F.transform(lexemes(text), expand))


def token_estimate(text: Column | str) -> Column:
    """A quarter of the UTF-8 bytes, rounded up: an estimate, not a tokenizer's count."""
    return F.ceil(F.octet_length(text) / 4)


def byte_excerpt(text: Column | str, tokens: int) -> Column:
    """The first ``4 * tokens`` bytes without a character cut in two at their end."""
    wide = F.substring(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"), 1, 4 * tokens)
    cut = F.regexp_replace(wide, r"(?:[\xC0-\xFF]|[\xE0-\xFF][\x80-\xBF]|[\xF0-\xFF][\x80-\xBF]{2})\z", "")
    return F.decode(F.encode(cut, "ISO-8859-1"), "UTF-8")


def lossless_pieces(text: Column | str, limit: int, boundary: str = "\n\n") -> Column:
    """Pieces of at most ``limit`` bytes that make up the text: cut after the last ``boundary`` past half of the limit,
    or else after the last whole character."""
    wide = F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")
    end = boundary.replace("\n", r"\n")
    pattern = (
        rf"(?s).{{1,{limit}}}\z|.{{{limit // 2},{limit}}}(?<={end})|.{{1,{limit}}}(?![\x80-\xBF])"
    )
    pieces = F.regexp_extract_all(wide, F.lit(pattern), F.lit(0))
    return F.transform(pieces, lambda p: F.decode(F.encode(p, "ISO-8859-1"), "UTF-8"))


def term_window(text: Column | str, word: Column | str, before: int = 120, size: int = 1200) -> Column:
    """``size`` characters from ``before`` characters ahead of the word's first place on, with an ellipsis where cut."""
    text = F.col(text) if isinstance(text, str) else text
    start = F.greatest(F.instr(F.lower(text), word) - before, F.lit(1))
    return F.concat(F.when(start > 1, "…").otherwise(""), F.substring(text, start, F.lit(size)))


def normal_trigger(text: Column | str) -> Column:
    """Runs of a-z and 0-9 in lower case, joined by spaces."""
    return F.array_join(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), " ")


def share_of(text: Column | str) -> Column:
    """A confidence in 0..1 out of '85%', '85' or '0.85'; null where it is none."""
    bare = F.trim(text)
    number = F.regexp_extract(bare, r"^([0-9]+(?:\.[0-9]+)?)\s*%?$", 1).try_cast("double")
    value = F.when(bare.endswith("%") | (number > 1), number / 100).otherwise(number)
    return F.when(value.between(0, 1), value)


def locator(text: Column | str) -> Column:
    """struct<repo, revision, path> of ``repo@revision[:path]``; empty strings where there is none."""
    pattern = r"^([^@\s]+)@([0-9a-f]+)(?::(.+))?$"
    return F.struct(*[F.regexp_extract(text, pattern, i + 1).alias(n) for i, n in enumerate(("repo", "revision", "path"))])


def delay(attempts: Column | str, base: float, cap: float) -> Column:
    """Exponential back-off: ``base`` doubled for each attempt after the first, at most ``cap``."""
    attempts = F.col(attempts) if isinstance(attempts, str) else attempts
    return F.least(F.lit(cap), F.lit(base) * F.pow(F.lit(2.0), F.least(attempts - 1, F.lit(20))))
