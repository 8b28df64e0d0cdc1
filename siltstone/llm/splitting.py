"""Oversized texts cut at natural boundaries by balanced targets."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.text import TOKEN, token_count
from siltstone.plans.ranks import running_total

_SENTENCE_END = re.compile(r"[.!?…。！？][\"'”’»)\]]*$")
_CLAUSE_END = re.compile(r"[,;:)\]}|][\"'”’»]*$")
#: Strength of a cut: a blank line, a sentence that ends with its line, a sentence, a line, a clause, a word.
PARAGRAPH, SENTENCE_LINE, SENTENCE, LINE, CLAUSE, PLAIN = 5, 4, 3, 2, 1, 0


def strength(before: str, gap: str) -> int:
    """How natural a cut is between the token ``before`` and the white space ``gap`` after it."""
    lines = gap.replace("\r\n", "\n").replace("\r", "\n").count("\n")
    if lines > 1:
        return PARAGRAPH
    if _SENTENCE_END.search(before):
        return SENTENCE_LINE if lines else SENTENCE
    if lines:
        return LINE
    return CLAUSE if _CLAUSE_END.search(before) else PLAIN


def cut_ends(strengths: list[int], n: int, limit: int, overlap: int) -> list[int]:
    """Ends (token numbers, the last is ``n``) of the fewest pieces that keep the limit.

    Piece i covers tokens ends[i-1]-overlap .. ends[i]. Targets are spaced equally and each is
    moved to the strongest boundary near it, nearest first; if a limit then fails, one more piece
    is tried. ``strengths[i]`` belongs to the cut before token i.
    """
    if n <= limit:
        return [n]
    step = limit - overlap
    count = -(-(n - overlap) // step)
    while True:
        ends, last = [], 0
        for i in range(count - 1):
            start = max(0, last - overlap)
            high = min(start + limit, n - 1)
            low = max(last + 1, n - (count - 1 - i) * step, overlap + 1)
            if low > high:
                break
            target = min(max(overlap + round((n - overlap) * (i + 1) / count), low), high)
            slack = max(1, (n // count) // 4)
            near = range(max(low, target - slack), min(high, target + slack) + 1)
            last = max(near, key=lambda e: (strengths[e], -abs(e - target), -e))
            ends.append(last)
        else:
            if n - max(0, last - overlap) <= limit:
                return [*ends, n]
        count += 1


def pieces(text: str, limit: int, overlap: int) -> Iterator[tuple[int, int, int, int]]:
    """(first token, end token, first character, end character) of each piece of ``text``."""
    spans = [m.span() for m in TOKEN.finditer(text)]
    n = len(spans)
    if n == 0:
        return
    if n <= limit:
        yield 0, n, 0, len(text)
        return
    cuts = [PLAIN] * (n + 1)
    for i in range(1, n):
        a, b = spans[i - 1]
        cuts[i] = strength(text[max(a, b - 12) : b], text[b : spans[i][0]])
    start = 0
    for end in cut_ends(cuts, n, limit, overlap):
        yield start, end, spans[start][0], spans[end - 1][1]
        start = max(0, end - overlap)


def split_oversized(chunks: DataFrame, limit: int = 256, overlap: int = 24) -> DataFrame:
    """Pieces of every row of ``chunks`` (id, content) whose content has more than ``limit`` tokens.

    Columns: id, piece (from 0), pieces, first_token, tokens, char_start, char_end, content. A row
    that was delivered again gives its pieces once. Null, empty and blank contents and contents
    within the limit give no row; a text without any natural boundary is cut between tokens; one
    token is never cut, whatever its length. Only ``id`` and ``content`` are read, so other columns
    may have any names.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be smaller than limit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list] = {c: [] for c in ("id", "piece", "pieces", "first_token", "tokens", "char_start", "char_end", "content")}
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = list(pieces(text, limit, overlap))
                if len(own) > 1:
                    for k, (a, b, x, y) in enumerate(own):
                        for name, value in zip(rows, (key, k, len(own), a, b - a, x, y, text[x:y]), strict=True):
                            rows[name].append(value)
            yield pa.RecordBatch.from_arrays([pa.array(rows[n], t) for n, t in zip(rows, (pa.string(), *[pa.int32()] * 6, pa.string()), strict=True)], names=list(rows))

    # n tokens need n-1 separators: the length alone excludes most rows before any pattern runs.
    long = chunks.select("id", "content").where((F.length("content") > 2 * limit) & (token_count(F.col("content")) > limit))
    out = long.mapInArrow(run, "id string, piece int, pieces int, first_token int, tokens int, char_start int, char_end int, content string")
    return out.dropDuplicates(["id", "piece"])


def renumbered(chunks: DataFrame, limit: int = 256, overlap: int = 24) -> DataFrame:
    """All chunks as pieces within the limit, with new chunk_index values in the order of the text.

    ``chunks`` has id, document_id, chunk_index, content. Columns: id, document_id, chunk_index
    (from 0 in each document), piece, tokens, char_start, char_end. Chunks within the limit, also
    empty ones, are one piece. The running count is summed over index buckets, so a document with
    a third of all rows is no single task. A null chunk_index counts as 0, ties go by id.
    """
    split = split_oversized(chunks, limit, overlap).drop("content", "first_token")
    once = chunks.groupBy("id").agg(F.min("document_id").alias("document_id"), F.min("chunk_index").alias("_old"), F.min(F.length("content")).alias("_chars"), F.min(token_count(F.col("content"))).alias("_tokens"))
    counts = split.where("piece = 0").select(F.col("id").alias("_id"), "pieces")
    sized = once.join(counts, once["id"] == counts["_id"], "left").withColumn("_pieces", F.coalesce("pieces", F.lit(1)))
    placed = running_total(sized.select("id", "document_id", "_old", "_chars", "_tokens", "_pieces"), "document_id", "_old", "id", F.col("_pieces"), "_start")
    split = split.withColumnRenamed("id", "_sid")
    whole = placed.join(split, placed["id"] == split["_sid"], "left")
    return whole.select(
        "id", "document_id", (F.col("_start") + F.coalesce("piece", F.lit(0))).cast("int").alias("chunk_index"), F.coalesce("piece", F.lit(0)).alias("piece"),
        F.coalesce("tokens", "_tokens").cast("int").alias("tokens"), F.coalesce("char_start", F.lit(0)).alias("char_start"), F.coalesce("char_end", "_chars").alias("char_end"),
    )
