"""Splitting oversized items at natural boundaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.clean import clean_id

LIMIT, OVERLAP = 16_384, 512
LIST_IDS, LIST_BYTES = 8, 65_536

# Ends of paragraphs, lines and sentences, as UTF-8 bytes read one character a byte.
PARAGRAPH = r"(?<=\n[ \t\r]{0,8}\n)"
LINE = r"(?<=[\n\r])(?!\n)"
SENTENCE = r"(?:(?<=[.!?][ \t\n])|(?<=\xE3\x80\x82)|(?<=\xEF\xBC[\x81\x9F\x9B]))"
SPACE = r"(?<=[ \t])"
WHOLE_CHARACTER = r"(?![\x80-\xBF])"


def cut_pattern(most: int) -> str:
    """Alternatives by strength: the rest if it fits, then each kind of end past the half, then anywhere, then a character."""
    half = max(1, most // 2)
    ends = (PARAGRAPH, LINE, SENTENCE)
    choices = [rf".{{1,{most}}}\z"]
    choices += [rf".{{{half},{most}}}{end}" for end in ends]
    choices += [rf".{{1,{most}}}{end}" for end in (*ends, SPACE, WHOLE_CHARACTER)]
    return "(?s)" + "|".join(choices)


def text_pieces(text: Column | str, limit: int = LIMIT, overlap: int = OVERLAP) -> Column:
    """array<struct<start, overlap, piece>> of a text, in order; ``start`` is the byte at which the new part begins.

    The text's UTF-8 bytes are read as one character each, so that quantifiers count bytes. A bounded
    regex consumes up to ``limit - overlap`` bytes a time; each piece but the first is led by up to
    ``overlap`` bytes before its start, from a whole character on. A text within the limit is one piece,
    an empty text one empty piece; null gives null.
    """
    if not 0 <= overlap <= limit - 4:
        raise ValueError("a piece must hold its overlap and one more character")
    wide = F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")
    fits = F.octet_length(text) <= limit
    cores = F.when(fits, F.array(wide)).otherwise(
        F.regexp_extract_all(wide, F.lit(cut_pattern(limit - overlap)), F.lit(0))
    )
    state = "struct<done: array<struct<start: int, overlap: int, piece: string>>, start: int, tail: string>"

    def add(s: Column, core: Column) -> Column:
        lead = F.regexp_replace(s["tail"], r"^[\x80-\xBF]+", "")
        whole = F.decode(F.encode(F.concat(lead, core), "ISO-8859-1"), "UTF-8")
        done = F.concat(s["done"], F.array(F.struct(s["start"].alias("start"), F.length(lead).alias("overlap"), whole.alias("piece"))))
        tail = F.right(F.concat(s["tail"], core), F.lit(overlap)) if overlap else F.lit("")
        return F.struct(done.alias("done"), (s["start"] + F.length(core)).alias("start"), tail.alias("tail")).cast(state)

    none = F.struct(F.array().cast("array<struct<start: int, overlap: int, piece: string>>"), F.lit(0), F.lit("")).cast(state)
    return F.aggregate(cores, none, add, lambda s: s["done"])


def split_texts(items: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """One row a piece: key, pos (from 0), pieces, start, overlap, piece. No shuffle, all inside the JVM.

    Null texts give no rows; repeated rows are split each.
    """
    cut = items.where(F.col(text).isNotNull()).select(F.col(key), text_pieces(text, limit, overlap).alias("cut"))
    return cut.select(key, F.size("cut").alias("pieces"), F.posexplode("cut").alias("pos", "p")).select(
        key, "pos", "pieces", "p.start", "p.overlap", "p.piece"
    )


def valid_units(units: DataFrame, *columns: str) -> DataFrame:
    """Of each id the row with the highest revision (ties: the greater values); null ids are ignored."""
    return (
        units.select(clean_id("id").alias("id"), F.struct("revision", *columns).alias("row"))
        .where("id is not null")
        .groupBy("id")
        .agg(F.max("row").alias("row"))
        .select("id", *[F.col("row")[c].alias(c) for c in columns])
    )


def oversized_units(units: DataFrame, limit: int = LIMIT) -> DataFrame:
    """id, body of valid units; only bodies over the limit are moved, any other row as its revision alone."""
    long = F.when(F.octet_length("body") > limit, F.col("body"))
    return valid_units(units.withColumn("body", long), "body").where("body is not null")


def split_lists(
    attempts: DataFrame, blocks: DataFrame, most_ids: int = LIST_IDS, most_bytes: int = LIST_BYTES
) -> DataFrame:
    """attempt_id, ids, sublists (array<array<string>>) of each attempt's list of block ids (JSON text).

    A sublist takes ids in order while it has at most ``most_ids`` of them and their blocks' n_bytes add
    up to at most ``most_bytes``; the next begins with its last id, unless these two alone are too
    large. A repeated id in a sublist adds its bytes once; an id without a block row and null n_bytes
    add nothing; of a block's rows the largest n_bytes counts. Null, empty or broken lists give no row,
    null elements are left out, repeated rows count once.
    """
    lists = (
        attempts.select("attempt_id", F.from_json("block_ids", "array<string>").alias("ids"))
        .where("size(ids) > 0")
        .distinct()
    )
    sizes = blocks.groupBy("block_id").agg(F.coalesce(F.max("n_bytes"), F.lit(0)).alias("n_bytes"))
    rows = lists.select("attempt_id", F.xxhash64("ids").alias("list"), F.posexplode("ids").alias("pos", "block_id"))
    sized = rows.where("block_id is not null").join(sizes, "block_id", "left")
    row = F.struct("pos", "block_id", F.coalesce("n_bytes", F.lit(0)).alias("n"))
    gathered = sized.groupBy("attempt_id", "list").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    state = "struct<done: array<array<string>>, cur: array<string>, bytes: bigint, last: bigint>"
    empty = F.struct(
        F.array().cast("array<array<string>>").alias("done"),
        F.array().cast("array<string>").alias("cur"),
        F.lit(0).cast("bigint").alias("bytes"),
        F.lit(0).cast("bigint").alias("last"),
    )

    def take(s: Column, x: Column) -> Column:
        bytes_ = s["bytes"] + F.when(F.array_contains(s["cur"], x["block_id"]), 0).otherwise(x["n"])
        fits = (F.size(s["cur"]) < most_ids) & ((bytes_ <= most_bytes) | (F.size(s["cur"]) == 0))
        both = s["last"] + x["n"] <= most_bytes
        tail = F.slice(s["cur"], -1, 1)
        more = F.struct(s["done"], F.concat(s["cur"], F.array(x["block_id"])), bytes_, x["n"])
        new = F.struct(
            F.concat(s["done"], F.array(s["cur"])),
            F.when(both & (most_ids > 1), F.concat(tail, F.array(x["block_id"]))).otherwise(F.array(x["block_id"])),
            F.when(both & (most_ids > 1), s["last"] + x["n"]).otherwise(x["n"]),
            x["n"],
        )
        return F.when(fits, more.cast(state)).otherwise(new.cast(state))

    folded = F.aggregate("rows", empty, take, lambda s: F.concat(s["done"], F.array(s["cur"])))
    return gathered.select("attempt_id", F.size("rows").alias("ids"), folded.alias("sublists"))
