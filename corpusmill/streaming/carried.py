"""Pages of a text that arrive one after another, with state carried between them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# What opens and closes a fenced block.
FENCE = "```"
OUT = "doc_id bigint, page int, n_chars int, inside int"
STATE = "open boolean, page int, ticks int"


def pages(documents: DataFrame, size: int = 2000) -> DataFrame:
    """doc_id, page, text: a document's characters in pages of ``size``; null and empty texts have none."""
    count = F.ceil(F.length("text") / size).cast("int")
    rows = documents.where("text != ''").select("doc_id", "text", F.explode(F.sequence(F.lit(0), count - 1)).alias("page"))
    return rows.select("doc_id", "page", F.substring("text", F.col("page") * size + 1, F.lit(size)).alias("text"))


def scan_carried(text: str, inside: bool, ticks: int) -> tuple[int, bool, int]:
    """``scan_page`` of a page after one that ends with TICKS backticks that may begin a fence, and its own such backticks.

    Backticks at a page's end count as its text at first; where the next page makes them a fence, it counts as many less.
    """
    parts = ("`" * ticks + text).split(FENCE)
    fenced = sum(len(p) for i, p in enumerate(parts) if (i % 2 == 1) != inside) - (ticks if inside else 0)
    return fenced, inside ^ (len(parts) % 2 == 0), len(parts[-1]) - len(parts[-1].rstrip("`"))


def scan_page(text: str, inside: bool) -> tuple[int, bool]:
    """Characters of fenced blocks on a page that begins inside of one or not (fences not counted), and how it ends."""
    return scan_carried(text, inside, 0)[:2]


def _follow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    open_, done, ticks = state.get if state.exists else (False, -1, 0)
    rows = []
    for page, text in sorted(r for f in frames for r in zip(f["page"].tolist(), f["text"].tolist())):
        if page > done:  # a page that comes again was counted
            fenced, open_, ticks = scan_carried(text, open_, ticks)
            rows.append((key[0], page, len(text), fenced))
            done = page
    state.update((open_, done, ticks))
    yield pd.DataFrame(rows, columns=["doc_id", "page", "n_chars", "inside"])


def fenced_characters(pages_: DataFrame) -> DataFrame:
    """doc_id, page, n_chars, inside of a stream of pages: what stands in fenced blocks, which may span pages.

    The state of a document is whether a block is open, the last page counted (a page that comes again
    is dropped) and the backticks at its end, for a fence that a page border cuts in two. Pages of a
    document must arrive in order, those of a micro-batch in any.
    """
    return pages_.groupBy("doc_id").applyInPandasWithState(_follow, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
