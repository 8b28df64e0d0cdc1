"""Texts cut off on their way into the store: prefix self-join, then the way a text ends.

A text that is a strict prefix of a longer text shows where it was cut. Hashes of the first ``LEAD``
characters leave only texts that begin like another one, and sorting these by value finds the longer
copies: the distinct value after a text in this order starts with it if any value does. Shorter texts
are met by the hashes of their beginnings. Most cut texts have no longer copy, so the end of each text
is read as well: an unfinished sentence, item or row, a mark of shortening, or a last word that is
only the beginning of known words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm import structure
from siltstone.llm.text import TOKEN, words
from siltstone.plans.cut import written

#: Of shorter texts only a cut inside a word counts: being the beginning of another text says nothing else about labels.
LEAST_PREFIX = 32
#: Texts are met by their first characters; shorter ones by the hashes of all beginnings of longer texts.
LEAD = LEAST_PREFIX
#: Beginnings that recur (8 bytes each) are broadcast up to this number; more are joined by a shuffle.
LEADS = 1_000_000
#: Characters by which texts are spread over tasks in their order.
ORDERED = 512
OVERLAP = 24
#: A last word is cut if words that continue it are so many times as frequent as the word itself.
CONTINUED = 10

_TRIM = " \t\r\n\v\f ​‌‍⁠﻿  "
_MARK = re.compile(r"[  ]*(?:\[(?:\.{3,}|…)\]|\((?:\.{3,}|…)\)|\.{3,}|…|\[(?:truncated|shortened|cut)\]|\((?:continued|truncated|more)\)|(?<=\s)(?:read more|continue reading))$", re.I)
_CLOSED = re.compile(r"(?:[.!?][\"'”’»“)\]*_]*(?:\s*\([^()\n]*\))?|\[\d+\]|(?:^|[\s(])[^\W\d][^().!?\n]{0,60}, \d{1,4}\))(?:\s*\[\d+\])*$")
#: The beginning of an escape, an entity or a tag: cut in the middle of a character or mark-up.
_PARTIAL = re.compile(r"(?:\\(?:u[0-9a-fA-F]{0,3}|x[0-9a-fA-F]?)?|&(?:#?\w{1,6})?|</?(?:[a-z]{1,6}\d?)?)$")
#: What a text must end with to match ``_MARK``: tells most texts without a search of them.
_MARK_ENDS = ("...", "…", "...]", "…]", "...)", "…)", "truncated]", "shortened]", "cut]", "continued)", "truncated)", "more)", "read more", "continue reading")
_PARTIAL_MOST = 12  # characters that ``_PARTIAL`` can match
_HEADING = re.compile(r"={2,}[^=\n]+={2,}$|#{1,6} [^\n]+$")
_FIELDS = (("||", " || "), ("|", "|"), ("\t", "\t"), ("</td>", "</td>"), ('": ', '": '), (",", ","), ("  ", None))
_PAIRS = (" – ", " - ", ": ")
_NEEDS_MORE = structure.SENTENCE_WORDS | frozenset("of near and et y und von de von".split())
_ADDRESS = re.compile(r"https?://|www\.|\.(?:com|org|example)\b|0x[0-9a-f]+|[=;{}]\w+[=;]")
_GARBLED = re.compile(r"[A-Za-z]\d+[A-Za-z]|[A-Za-z0-9][+/=][A-Za-z0-9]")

KINDS = ("empty", "label", "prose", "item", "row", "unsorted", "junk")


def stripped(text: str) -> tuple[str, bool]:
    """(text without white space, marks of shortening and a broken character at its end, whether it had such a mark)."""
    core = text.rstrip(_TRIM)
    marked = False
    if core.endswith("�") and core.count("�") <= 2:
        core, marked = core.rstrip("�").rstrip(_TRIM), True
    elif (m := _PARTIAL.search(core, max(0, len(core) - _PARTIAL_MOST))) and "\\" not in core[: m.start()] and core.count("<") + core.count("&") <= 3:
        core, marked = core[: m.start()], True
    if core[-16:].lower().endswith(_MARK_ENDS) and (m := _MARK.search(core)):
        if m.start() > 0:
            core, marked = core[: m.start()].rstrip(_TRIM), True
    return core, marked


def _fields(line: str, delimiter: str, by: str | None) -> int:
    return len(re.split(r" {2,}|\t", line.strip())) if by is None else line.count(by)


def _row_open(lines: list[str]) -> bool | None:
    """Whether the last row is unfinished; None if the lines are no rows."""
    if len(lines) < 3:
        return None
    before, last = lines[:-1], lines[-1]
    if last.strip() in ("|}", "|-", "{|"):
        return False
    rows = [x for x in before if x.strip() not in ("{|", "|-", "|}")]
    if len(rows) < 2:
        return None
    for delimiter, by in _FIELDS:
        counts = Counter(_fields(x, delimiter, by) for x in rows)
        usual, how_often = counts.most_common(1)[0]
        if usual < (2 if by is None else 1) or how_often < 0.7 * len(rows):
            continue
        if delimiter == "," and any(", " in x for x in rows[:3]):
            continue
        if _fields(last, delimiter, by) < usual:
            return True
        ends = Counter(x.rstrip()[-1:] for x in rows)
        end, same = ends.most_common(1)[0]
        if not end.isalnum() and same >= 0.8 * len(rows) and last.rstrip()[-1:] != end:
            # The last record of a list needs no comma.
            return not (end == "," and last.rstrip()[-1:] in "}])")
        return last.endswith(("|", ",")) and end.isalnum()
    return None


def _item_open(lines: list[str], item: str) -> bool:
    """Whether ``item``, the last one without its marker, is visibly unfinished beside the others."""
    others = [structure.MARKER.sub("", x, count=1).strip() for x in lines[:-1]]
    others = [x for x in others if x]
    if not item:
        return True
    if item.count("(") > item.count(")") or item.count("[") > item.count("]"):
        return True
    last = item.split()[-1].strip(structure.STRIP).lower()
    if last in _NEEDS_MORE and item[-1].isalnum():
        return True
    if item[-1] in ",-–/(&":
        return not sum(x[-1] == item[-1] for x in others) > 0.5 * max(1, len(others))
    if len(others) >= 3:
        ends = Counter(x[-1] for x in others)
        end, same = ends.most_common(1)[0]
        if end in ";.,|>}" and same >= 0.8 * len(others) and item[-1].isalnum():
            return True
        for pair in _PAIRS:
            if sum(pair in x for x in others) >= 0.8 * len(others) and pair not in item:
                return True
        if all(len(x.split()) > 1 for x in others) and len(item.split()) == 1:
            return True
    tail = re.search(r"\d+$", item)
    if tail:
        sizes = [len(m.group(1)) for x in others if (m := re.search(r"(\d+)\)?[.;,]?$", x))]
        inner = [len(x) for x in re.findall(r"\d+", " ".join(others))] if not sizes else sizes
        if len(inner) >= 2 and min(inner) >= 4 and len(tail.group()) < min(inner):
            return True
    return False


def ending(text: str, odd: float) -> tuple[str, bool, bool, bool, str]:
    """(kind, marked, closed, open, last word) of the end of ``text``; ``odd``: its share of odd symbols.

    closed: it ends as a sentence does. open: its last item or row is visibly unfinished. The last
    word is given where it reaches the end of an item or row.
    """
    core, marked = stripped(text)
    if not core:
        return "empty", False, True, False, ""
    if odd > 0.05:
        return "junk", False, True, False, ""
    lines = [x for x in core.splitlines() if x and not x.isspace()]
    last = lines[-1]
    parts = core.split()
    n = len(parts)
    own = words(parts[-1])
    word = own[-1] if own and core[-1].isalpha() else ""
    # All ends but the longest lie in the last characters.
    closed = (_CLOSED.search(core, max(0, len(core) - 200)) or _CLOSED.search(core)) is not None
    item_marker = structure.MARKER.match(last)
    marks = sum(structure.MARKER.match(x) is not None for x in lines)
    bare = [p for x in lines for p in structure.MARKER.sub("", x, count=1).split()] or parts
    flags = structure.sentence_flags(bare)
    running = structure.running_share(flags)
    if item_marker and marks >= 2 or item_marker and running < 0.5 and len(lines) > 1:
        item = last[item_marker.end() :].strip()
        listed = [x for x in lines if structure.MARKER.match(x)]
        tail = sum(structure.sentence_flags(item.split()))
        if len(item.split()) >= 8 and tail >= 0.2 * len(item.split()):
            return "prose", marked, closed, False, word  # an item that is a sentence
        return "item", marked, closed, not closed and _item_open(listed, item), word
    if re.fullmatch(r"[ \t]*(?:[-*•–]|\d{1,3}[.)]|\(?[A-Za-z]\)?)", last) and marks >= 2:
        return "item", marked, False, True, ""
    few = n < 10 and len(lines) < 3
    if running >= 0.5 and not (few and not closed and (n < 4 or sum(flags) < 2)):
        if _HEADING.search(last):
            closed = True
        elif not closed and len(lines) > 1 and _CLOSED.search(lines[-2].rstrip(_TRIM)):
            label = last.split()
            if len(label) <= 6 and label[0][0].isupper() and not any(structure.sentence_flags(label)) and not last[-1] in ",;":
                closed = len(label) > 1 and "\n\n" in core[-len(last) - 3 :]
        return "prose", marked, closed, False, word
    if few:
        return "label", marked, True, False, word
    address = sum(_ADDRESS.search(x) is not None for x in lines)
    if address >= 0.5 * len(lines):
        return "junk", marked, True, False, ""
    row = _row_open(lines)
    if row is not None:
        return "row", marked, closed, row, word
    letters = sum(map(str.isalpha, core)) / max(1, len(core) - sum(map(str.isspace, core)))
    if len(lines) >= 3 and letters > 0.6 and n / len(lines) <= 8:
        return "item", marked, closed, not closed and _item_open(lines, last.strip()), word
    if letters > 0.6 and core.count(", ") >= 0.1 * n and ": " in core[:80]:
        items = core.split(": ", 1)[1].split(", ")
        return "item", marked, closed, not closed and _item_open(items, items[-1].strip()), word
    if running > 0.2 and closed:
        return "prose", marked, True, False, word
    # Encoded data: most tokens mix letters with digits or signs.
    if sum(_GARBLED.search(x) is not None for x in parts) > 0.5 * n:
        return "junk", marked, True, False, ""
    return "unsorted", marked, closed, False, word


def _hash(value: str) -> int:
    h = xxhash.xxh3_64_intdigest(value.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def readings(chunks: DataFrame) -> DataFrame:
    """One pass over all texts: a row per text as its end is read, and rows (w, n) that count words.

    Of a text: kind, marked, closed, open, word, and hashes of the core, of its first ``LEAD`` characters
    (null where it has fewer) and of the outer tokens. Words are counted per task, without each text's last.
    """
    names = ["id", "document_id", "chunk_index", "kind", "marked", "closed", "open", "word", "core", "lead", "tail", "head", "w", "n"]
    kinds_ = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def counted() -> pa.RecordBatch:
            cols = [pa.nulls(len(counts), k) for k in kinds_[:-2]] + [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())]
            counts.clear()
            return pa.RecordBatch.from_arrays(cols, names=names)

        for batch in batches:
            texts = [t or "" for t in batch.column(3).to_pylist()]
            kinds = structure.char_classes(texts)
            rows = []
            for text, k in zip(texts, kinds, strict=True):
                solid = max(1, int(k.sum() - k[structure.SPACE]))
                own = ending(text, float(k[structure.ODD]) / solid)
                tokens = TOKEN.findall(text)
                tail = _hash(" ".join(tokens[-OVERLAP:])) if len(tokens) >= OVERLAP else None
                head = _hash(" ".join(tokens[:OVERLAP])) if len(tokens) >= OVERLAP else None
                core = stripped(text)[0]
                rows.append((*own, _hash(core), _hash(core[:LEAD]) if len(core) >= LEAD else None, tail, head))
                if text:
                    counts.update(words(text)[:-1])
            cols = list(zip(*rows, strict=True)) or [[]] * 9
            n = len(rows)
            yield pa.RecordBatch.from_arrays([*[batch.column(j) for j in range(3)], *[pa.array(c, t) for c, t in zip(cols, kinds_[3:-2], strict=True)], pa.nulls(n, pa.string()), pa.nulls(n, pa.int64())], names=names)
            if len(counts) > 300_000:
                yield counted()
        yield counted()

    schema = "id string, document_id string, chunk_index int, kind string, marked boolean, closed boolean, open boolean, word string, core bigint, lead bigint, tail bigint, head bigint, w string, n bigint"
    return chunks.select("id", "document_id", "chunk_index", "content").mapInArrow(run, schema)


def _listed(hashes: DataFrame) -> np.ndarray | None:
    """The hashes, if they are few enough to go to every task."""
    if hashes.count() > LEADS:
        return None
    return hashes.toArrow().column(0).to_numpy()


def continuations(chunks: DataFrame, ends: DataFrame) -> DataFrame:
    """(core, next): for each core text that is a strict prefix of another, what follows in that one.

    ``ends`` are the text rows of ``readings``. Only texts whose first ``LEAD`` characters another text
    has too leave the scan. Equal ones are merged, all are sorted by value over all tasks, and each is
    compared with its successor. The last text of a task is compared with the first of the next task.
    A core of fewer than ``LEAD`` characters counts where a longer one goes on within its last word.
    """
    spark = chunks.sparkSession
    cores = ends.where("kind <> 'empty'").select("core", "lead").distinct()
    common = cores.where("lead is not null").groupBy("lead").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("lead")
    small = cores.where("lead is null").select("core").distinct()
    shared = spark.sparkContext.broadcast((_listed(common), _listed(small)))

    def begun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leads, shorts = (None if v is None else set(v.tolist()) for v in shared.value)
        for batch in batches:
            rows = []
            for text in batch.column(0).to_pylist():
                if not text:
                    continue
                lead = _hash(text[:LEAD])
                if len(text) >= LEAD and (leads is None or lead in leads):
                    core = stripped(text)[0]
                    if len(core) >= LEAD:
                        rows.append((_hash(core), lead, core, None))
                for k in range(1, min(LEAD, len(text))):
                    if text[k - 1].isalnum() and text[k].isalnum():
                        h = _hash(text[:k])
                        if (shorts is None or h in shorts) and k < len(stripped(text)[0]):
                            rows.append((h, None, None, text[k : k + 24]))
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["core", "lead", "text", "next"])

    def successors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        names = ["core", "next", "task", "edge", "text"]
        kinds = (pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string())
        held: tuple[int, str] | None = None
        for batch in batches:
            rows = []
            for core, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held is None:
                    rows.append((core, None, task, "first", text))
                elif text.startswith(held[1]) and (len(held[1]) >= LEAST_PREFIX or (held[1][-1] + text[len(held[1])]).isalnum()):
                    rows.append((held[0], text[len(held[1]) : len(held[1]) + 24], task, None, None))
                held = core, text
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [[]] * 5, kinds, strict=True)], names=names)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip((held[0], None, task, "last", held[1]), kinds, strict=True)], names=names)

    started = written(chunks.select("content").mapInArrow(begun, "core bigint, lead bigint, text string, next string"), "begun")
    long = started.where("text is not null")
    if shared.value[0] is None:
        long = long.join(common, "lead", "left_semi")
    short = started.where("text is null").select("core", "next")
    if shared.value[1] is None:
        short = short.join(small, "core", "left_semi")
    distinct = long.groupBy("core").agg(F.first("text").alias("text"))
    # Byte order, in which every extension of a text follows it before any other text. The spread looks at the first characters only.
    ordered = distinct.repartitionByRange(F.substring("text", 1, ORDERED)).sortWithinPartitions("text")
    found = written(ordered.mapInArrow(successors, "core bigint, next string, task int, edge string, text string"), "successors")
    inside = found.where(F.col("edge").isNull()).select("core", "next")
    # Tasks without rows lie between: the one before is the last that had any. One row per task.
    before = F.lag("task").over(Window.orderBy("task"))
    first = found.where("edge = 'first'").select(before.alias("at"), F.col("text").alias("first"))
    last = found.where("edge = 'last'").select("core", F.col("task").alias("at"), F.col("text").alias("held"))
    across = last.join(first, "at").where(F.startswith(F.col("first"), F.col("held")))
    across = across.select("core", "held", F.substring(F.col("first"), F.length("held") + 1, F.lit(24)).alias("next"))
    whole = (F.length("held") >= LEAST_PREFIX) | (F.col("held").rlike(r"[\p{L}\p{N}]$") & F.col("next").rlike(r"^[\p{L}\p{N}]"))
    return inside.unionByName(across.where(whole).drop("held")).unionByName(short)


def cut_words(last: DataFrame, counts: DataFrame) -> DataFrame:
    """(word): the words of ``last`` that are only the beginning of known words."""
    asked = last.select("word").distinct()
    begun = counts.select("n", F.col("w"), F.explode(F.sequence(F.lit(1), F.length("w"))).alias("k"))
    # Of the beginnings of all words only those that are asked for leave the scan of the counts, if these are few.
    few = asked.count() <= LEADS
    begun = begun.select(F.substring(F.col("w"), F.lit(1), F.col("k")).alias("word"), F.when(F.col("k") == F.length("w"), F.col("n")).otherwise(0).alias("whole"), F.when(F.col("k") < F.length("w"), F.col("n")).otherwise(0).alias("more"))
    known = begun.join(F.broadcast(asked) if few else asked, "word", "left_semi").groupBy("word").agg(F.sum("whole").alias("whole"), F.sum("more").alias("more"))
    return known.where((F.col("more") > 0) & (F.col("more") >= CONTINUED * F.col("whole"))).select("word")


def _inside(next_: Column, word: Column, kind: Column, closed: Column) -> Column:
    """Whether what follows in the longer copy shows a cut inside a word, sentence, item or row."""
    in_word = (word != "") & next_.rlike(r"^[\p{L}\p{N}]")
    in_line = kind.isin("item", "row", "unsorted") & ~next_.rlike(r"^[ \t]*[;.,|)\]}>\"']*(?:</\w+>)*[ \t]*(?:[\r\n]|$)")
    return in_word | (~closed & (in_line | (kind == "prose")))


def truncated(chunks: DataFrame) -> DataFrame:
    """One row per id of ``chunks`` (id, document_id, chunk_index, content): kind, evidence, truncated.

    evidence: ``mark``, ``longer copy``, ``sentence``, ``item``, ``word`` or null. A text whose last
    ``OVERLAP`` tokens are the first of the next chunk of its document goes on there and is not
    truncated, unless marked. Null, empty and blank texts are not truncated, labels and junk (odd
    symbols, links, encoded data) only if marked or, for labels, cut inside a word that a longer copy completes; text
    that is of no known kind is read as lines are. A
    complete text that happens to have the length of a field limit is not either. Rows delivered
    again give one row. A document of any size is joined by (document_id, chunk_index).
    """
    read = written(readings(chunks), "readings")
    ends = written(read.where("w is null").drop("w", "n").dropDuplicates(["id"]), "endings")
    counts = read.where("w is not null").groupBy("w").agg(F.sum("n").alias("n"))
    after = ends.select(F.col("document_id").alias("_d"), (F.col("chunk_index") - 1).alias("_i"), F.col("head").alias("_head")).where("_head is not null").groupBy("_d", "_i", "_head").agg(F.lit(True).alias("goes_on"))
    on = (ends["document_id"] == after["_d"]) & (ends["chunk_index"] == after["_i"]) & (ends["tail"] == after["_head"])
    joined = ends.join(after, on, "left").drop("_d", "_i", "_head")
    joined = joined.join(continuations(chunks, ends).groupBy("core").agg(F.min("next").alias("next")), "core", "left")
    asked = ends.where("kind in ('item', 'row', 'unsorted') and not open and not closed and word != ''").select("word")
    cut = cut_words(asked, counts).withColumn("cut", F.lit(True))
    joined = joined.join(cut, "word", "left")
    longer = F.col("next").isNotNull()
    inside = _inside(F.col("next"), F.col("word"), F.col("kind"), F.col("closed"))
    free = F.coalesce("goes_on", F.lit(False)) == F.lit(False)
    lines = F.col("kind").isin("item", "row", "unsorted")
    evidence = (
        F.when(F.col("kind") == "empty", None)
        .when(F.col("marked"), "mark")
        .when(~free, None)
        .when(longer & inside, "longer copy")
        .when(F.col("kind").isin("label", "junk"), None)
        .when((F.col("kind") == "prose") & ~F.col("closed"), "sentence")
        .when(lines & longer, None)
        .when(lines & F.col("open"), "item")
        .when(lines & ~F.col("closed") & F.col("cut"), "word")
    )
    return joined.select("id", "document_id", "kind", evidence.alias("evidence")).withColumn("truncated", F.col("evidence").isNotNull())


def rates(found: DataFrame, documents: DataFrame) -> DataFrame:
    """(source, chunks, truncated, rate) of ``truncated`` rows by the source in their document's metadata.

    Sources are trimmed and lower-cased; documents delivered again count once; chunks without a
    document, or whose document names no source, count under a null source.
    """
    source = F.nullif(F.lower(F.trim(F.get_json_object("metadata", "$.source"))), F.lit(""))
    named = documents.select(F.col("id").alias("document_id"), source.alias("source")).groupBy("document_id").agg(F.min("source").alias("source"))
    totals = found.join(named, "document_id", "left").groupBy("source").agg(F.count(F.lit(1)).alias("chunks"), F.count_if("truncated").alias("truncated"))
    return totals.withColumn("rate", F.round(F.col("truncated") / F.col("chunks"), 6))
