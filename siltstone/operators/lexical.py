"""Lexical search: web-style queries, weighted words, term-frequency, BM25 and cover-density ranks.

The queries are a stated set and travel in blocks; the collection streams past each block once. A
row keeps only the words that are asked for, with their places and fields, so text is never
shuffled. Scores of all queries are made per Arrow batch in arrays, and only the best ``k`` rows of
a query leave a task: a frequent word costs time where its rows are, not a shuffle of its postings.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.plans.cut import written

WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2}  # fixed values: title, section, content

#: Words that a query does not ask for: the English list of PostgreSQL's text search, from which "websearch" takes its own.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them "
    "their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing "
    "a an the and but if or because as until while of at by for with about against between into through during before after above below to "
    "from up down in out on off over under again further then once here there when where why how all any both each few more most other some "
    "such no nor not only own same so than too very s t can will just don should now"
).split()

#: Queries of one block, and (query, document) scores that are made at once.
BLOCK, PAIRS = 8192, 2_000_000
_WORD = re.compile("[a-z0-9]+")
_STOP = frozenset(STOP_WORDS)


def stem(word: str) -> str:
    """Plural endings removed (the S-stemmer): ponies, pony; mills, mill; glass stays."""
    if len(word) > 3 and word.endswith("ies") and word[-4] not in "ea":
        return word[:-3] + "y"
    return word[:-1] if len(word) > 2 and word[-1] == "s" and word[-2] not in "us" else word


def forms(root: str) -> list[str]:
    """The words with this stem: a query brings them all, so texts need no stemming."""
    every = (root, root + "s", root[:-1] + "ies" if root.endswith("y") else root)
    return [w for w in dict.fromkeys(every) if stem(w) == root]


@dataclass
class Choice:
    """Words that must all occur, phrases (place, stem) that must stand, and what must not."""

    need: list[str] = field(default_factory=list)
    phrases: list[list[tuple[int, str]]] = field(default_factory=list)
    no: list[str] = field(default_factory=list)
    no_phrases: list[list[tuple[int, str]]] = field(default_factory=list)


def plain_query(text: str | None) -> list[Choice]:
    """All words but ``STOP_WORDS``, stemmed."""
    need = dict.fromkeys(stem(w) for w in _WORD.findall((text or "").lower()) if w not in _STOP)
    return [Choice(list(need))] if need else []


def web_query(text: str | None) -> list[Choice]:
    """Web-style query as alternatives: words are required; "..." is a phrase; -x excludes; ``or`` parts alternatives.

    ``or`` binds less than the blank: ``a b or c`` is (a and b) or c. Stop words ask for nothing but keep
    their places in a phrase. An alternative that only excludes, and an empty query, match nothing.
    """
    out = [Choice()]
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', text or ""):
        if word.lower() == "or" and not minus:
            out.append(Choice())
            continue
        terms = [(i, stem(w)) for i, w in enumerate(_WORD.findall((phrase or word).lower())) if w not in _STOP]
        own = out[-1]
        if minus:
            if len(terms) == 1:
                own.no.append(terms[0][1])
            elif terms:
                own.no_phrases.append(terms)
        else:
            own.need += [t for _, t in terms if t not in own.need]
            if len(terms) > 1:
                own.phrases.append(terms)
    return [c for c in out if c.need]


class Block:
    """Queries of a block: their alternatives, and the words they ask for as numbers."""

    def __init__(self, rows: list[tuple], parse):
        self.ids: list = []
        self.owner: list[int] = []
        self.choices: list[Choice] = []
        for key, text in rows:
            own = parse(text)
            self.owner += [len(self.ids)] * len(own)
            self.choices += own
            self.ids.append(key)
        stems = dict.fromkeys(w for c in self.choices for w in (*c.need, *c.no, *(t for p in c.phrases + c.no_phrases for _, t in p)))
        self.number = {w: i for i, w in enumerate(stems)}
        self.form = {f: i for w, i in self.number.items() for f in forms(w)}
        pairs = sorted((self.number[w], a) for a, c in enumerate(self.choices) for w in c.need)
        self.by_word = np.array([a for _, a in pairs], np.int64)
        self.start = np.searchsorted(np.array([w for w, _ in pairs], np.int64), np.arange(len(stems) + 1))
        self.need = np.array([len(c.need) for c in self.choices], np.int64)


def blocks(queries: DataFrame, query_key: str, text: str, parse) -> Iterator[Block]:
    rows: list[tuple] = []
    for r in queries.select(query_key, text).dropDuplicates([query_key]).orderBy(query_key).toLocalIterator():
        rows.append((r[0], r[1]))
        if len(rows) == BLOCK:
            yield Block(rows, parse)
            rows = []
    if rows:
        yield Block(rows, parse)


def asked_words(docs: DataFrame, key: str, fields: dict[str, str], block: Block) -> DataFrame:
    """(key, size, lex, pos, weight): the number of words of each row, and of the words asked for their numbers, places and fields.

    All fields (column -> weight letter) share one position space. Repeated keys give one row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(block.form)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value.get
        for batch in batches:
            sizes, counts, lex, pos, weight = [], [], [], [], []
            for texts in zip(*[c.to_pylist() for c in batch.columns[1:]], strict=True):
                done = before = 0
                for letter, text in enumerate(texts):
                    if text:
                        own = [get(w) for w in _WORD.findall(text.lower())]
                        at = [i for i, n in enumerate(own, done + 1) if n is not None]
                        pos += at
                        lex += [n for n in own if n is not None]
                        weight += [letter] * len(at)
                        before += len(at)
                        done += len(own)
                sizes.append(done)
                counts.append(before)
            ends = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(v, pa.int32())) for v in (lex, pos, weight)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), *lists], names=[key, "size", "lex", "pos", "weight"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.where(F.col(key).isNotNull()).select(key, *fields).mapInArrow(run, f"{key} {kind}, size int, lex array<int>, pos array<int>, weight array<int>").dropDuplicates([key])


def _stands(phrase: list[tuple[int, int]], at: dict[int, set[int]]) -> bool:
    first, word = phrase[0]
    return any(all(p - first + i in at.get(w, ()) for i, w in phrase) for p in at.get(word, ()))


def _density(hits: list[tuple[int, int, float]], need: int) -> float:
    """Each shortest stretch that holds all words adds the harmonic mean of the weights over 1 + the other words in it."""
    last: dict[int, tuple[int, float]] = {}
    total, seen = 0.0, -1
    for pos, word, weight in hits:
        last[word] = pos, weight
        if len(last) == need:
            start = min(p for p, _ in last.values())
            if start > seen:
                seen = start
                total += need / sum(1 / w for _, w in last.values()) / (1 + max(0, pos - start + 1 - need))
    return total


class Best:
    """The best ``k`` (score, then key) of each query so far."""

    def __init__(self, k: int):
        self.k, self.held, self.rows = k, [], 0

    def add(self, query: np.ndarray, score: np.ndarray, key: np.ndarray) -> None:
        self.held.append((query, score, key))
        self.rows += len(query)
        if self.rows > 2_000_000:
            self.shrink()

    def shrink(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.held:
            return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        query, score, key = (np.concatenate([h[c] for h in self.held]) for c in range(3))
        order = np.lexsort((key, -score, query))
        query, score, key = query[order], score[order], key[order]
        new = np.concatenate([[True], np.diff(query) != 0]) if len(query) else np.zeros(0, bool)
        first = np.nonzero(new)[0]
        place = np.arange(len(query)) - np.repeat(first, np.diff(np.concatenate([first, [len(query)]])))
        keep = place < self.k
        self.held = [(query[keep], score[keep], key[keep])]
        self.rows = int(keep.sum())
        return self.held[0]


def _scored(asked: DataFrame, key: str, query_key: str, query_kind: str, block: Block, k: int, cover: bool, weights: np.ndarray, bm25: tuple | None) -> DataFrame:
    """(query_key, key, score): per task the best ``k`` of each query of the block."""
    shared = asked.sparkSession.sparkContext.broadcast((block, bm25))
    kind = asked.schema[key].dataType.simpleString()
    arrow = pa.schema([(query_key, _arrow(query_kind)), (key, _arrow(kind)), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, stats = shared.value
        owner, words = np.array(b.owner, np.int64), len(b.number)
        best = Best(k)
        ready = [(c.need, [[(i, b.number[w]) for i, w in p] for p in c.phrases], [b.number[w] for w in c.no], [[(i, b.number[w]) for i, w in p] for p in c.no_phrases]) for c in b.choices]
        strict = [bool(p or n or q) for _, p, n, q in ready]

        def satisfied(a: int, hits: list[tuple[int, int, float]]) -> bool:
            at: dict[int, set[int]] = {}
            for p, w, _ in hits:
                at.setdefault(w, set()).add(p)
            _, phrases, no, no_phrases = ready[a]
            return all(_stands(p, at) for p in phrases) and not any(w in at for w in no) and not any(_stands(p, at) for p in no_phrases)

        for batch in batches:
            if not batch.num_rows or not words:
                continue
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            keys = keys if keys.dtype.kind in "iu" else np.array(keys, dtype=str)
            size = batch.column(1).to_numpy().astype(np.float64)
            count = np.diff(batch.column(2).offsets.to_numpy())
            lex, pos, field_ = (batch.column(c).flatten().to_numpy() for c in (2, 3, 4))
            end = np.cumsum(count)
            doc = np.repeat(np.arange(len(keys)), count)
            value, at = np.unique(doc * words + lex, return_inverse=True)
            d, w = value // words, value % words
            tf = np.bincount(at, minlength=len(value))
            if stats is None:
                v = np.bincount(at, weights[field_], minlength=len(value))
            else:
                idf, average, k1, part = stats
                v = idf[w] * tf * (k1 + 1) / (tf + k1 * (1 - part + part * size[d] / average))
            spread = b.start[w + 1] - b.start[w]
            total = np.cumsum(spread)
            edges = [0]
            while edges[-1] < len(d):
                x = edges[-1]
                y = max(x + 1, int(np.searchsorted(total, (total[x - 1] if x else 0) + PAIRS, "right")))
                while y < len(d) and d[y] == d[y - 1]:
                    y += 1  # a row's words stay together
                edges.append(y)
            for x, y in zip(edges[:-1], edges[1:], strict=True):
                own = spread[x:y]
                row = np.repeat(np.arange(x, y), own)
                if not len(row):
                    continue
                choice = b.by_word[np.arange(len(row)) - np.repeat(np.cumsum(own) - own, own) + b.start[w[row]]]
                pair, to = np.unique(choice * len(keys) + d[row], return_inverse=True)
                a, n = pair // len(keys), pair % len(keys)
                score = np.bincount(to, v[row], minlength=len(pair))
                if stats is None:
                    full = np.bincount(to, minlength=len(pair)) == b.need[a]
                    a, n, score = a[full], n[full], score[full]
                    checked = range(len(a)) if cover else np.nonzero(np.array(strict)[a])[0].tolist() if len(a) else []
                    keep = np.ones(len(a), bool)
                    for i in checked:
                        s = slice(end[n[i]] - count[n[i]], end[n[i]])
                        hits = list(zip(pos[s].tolist(), lex[s].tolist(), weights[field_[s]].tolist(), strict=True))
                        if strict[a[i]]:
                            keep[i] = satisfied(int(a[i]), hits)
                        if cover and keep[i]:
                            wanted = {b.number[q] for q in ready[a[i]][0]}
                            score[i] = _density([h for h in hits if h[1] in wanted], len(wanted))
                    a, n, score = a[keep], n[keep], score[keep]
                # A row that meets several alternatives of a query counts with its best.
                pair, to = np.unique(owner[a] * len(keys) + n, return_inverse=True)
                top = np.full(len(pair), -np.inf)
                np.maximum.at(top, to, score)
                best.add(pair // len(keys), np.floor(top * 1e6 + 0.5) / 1e6, keys[pair % len(keys)])
        query, score, key_ = best.shrink()
        yield pa.RecordBatch.from_pydict({query_key: [b.ids[q] for q in query.tolist()], key: key_.tolist(), "score": score}, schema=arrow)

    return asked.mapInArrow(run, f"{query_key} {query_kind}, {key} {kind}, score double")


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


def search(docs: DataFrame, key: str, fields: dict[str, str], queries: DataFrame, query_key: str, how: str = "match", web: bool = False, text: str = "query", k: int = 20, strategy: str | None = None, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_key, key, score, rank): the best ``k`` rows of ``docs`` for each query.

    ``how``: ``match`` (all words; the weights of their occurrences summed), ``cover`` (all words; cover
    density) or ``bm25`` (any word). ``web`` reads web-style queries (see ``web_query``); phrases and
    exclusions count for ``match`` and ``cover``. ``strategy`` keeps rows whose metadata names it, and
    only then reads metadata. Ties go by key. Rows without a key are left out, rows delivered again under one key are one row; null and
    empty texts have no words; queries without words give no row; an empty table gives no rows.
    """
    if strategy is not None:
        docs = docs.where(F.get_json_object("metadata", "$.chunk_strategy") == strategy)
    spark, kind = docs.sparkSession, queries.schema[query_key].dataType.simpleString()
    weights = np.array([WEIGHTS[c] for c in fields.values()])
    parts = None
    for block in blocks(queries, query_key, text, web_query if web else plain_query):
        asked = asked_words(docs, key, fields, block)
        stats = None
        if how == "bm25":
            asked = written(asked, "asked")
            rows, average = asked.agg(F.count(F.lit(1)), F.coalesce(F.nullif(F.avg("size"), F.lit(0.0)), F.lit(1.0))).first()
            df = np.zeros(len(block.number))
            for w, n in asked.select(F.explode(F.array_distinct("lex")).alias("w")).groupBy("w").count().toLocalIterator():
                df[w] = n  # one row per word that the block asks for
            stats = (np.log(1 + (rows - df + 0.5) / (df + 0.5)), average, k1, b)
        part = _scored(asked, key, query_key, kind, block, k, how == "cover", weights, stats)
        parts = part if parts is None else parts.unionByName(part)
    if parts is None:
        parts = spark.createDataFrame([], f"{query_key} {kind}, {key} {docs.schema[key].dataType.simpleString()}, score double")
    return top(parts.where("score > 0"), query_key, key, k)


def top(hits: DataFrame, query_key: str, key: str, k: int) -> DataFrame:
    """Rank from 1 by score, ties by key, first ``k``."""
    w = Window.partitionBy(query_key).orderBy(F.col("score").desc(), F.col(key))
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search_fields(chunks: DataFrame, stored_first: bool = True) -> DataFrame:
    """``chunks`` with title, section_path and search_text derived from metadata (JSON text).

    ``stored_first`` keeps stored values and fills gaps; otherwise metadata wins (the two rules of
    maintenance on write and of backfill).
    """
    meta = lambda *names: [F.get_json_object("metadata", f"$.{n}") for n in names]
    title, path = meta("article_title", "title"), meta("section_path", "section_title")
    pick = lambda stored, found: F.coalesce(stored, *found) if stored_first else F.coalesce(*found, stored)
    out = chunks.withColumns({"title": pick(F.col("title"), title), "section_path": pick(F.col("section_path"), path)})
    return out.withColumn("search_text", F.concat_ws("\n", "title", "section_path", "content"))

