"""Evaluation passages inside a corpus: template windows, slot check, exact confirmation."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from siltstone.llm.text import WORD, words

#: Words that name a unit (fixed values).
UNITS = frozenset("percent cent cents euro euros dollar dollars pound pounds km kilometre kilometres kilometer kilometers mile miles metre metres meter meters second seconds minute minutes hour hours day days week weeks month months year years million billion thousand star stars jahre jahren tage kilometern prozent ans jours kilomètres años días kilómetros".split())
NUMBER, UNIT, NAME, FIRST = 1, 2, 3, 4
_BASE = np.uint64(0x9E3779B97F4A7C15)


class Templates:
    """The windows of all evaluation passages with numbers, names and units as typed placeholders.

    A word that no passage has in lower case is a name there. In a document every word outside
    this lexicon is a possible name: it can only stand in a slot. Case in the document is thus
    of no account.
    """

    def __init__(self, items: list[tuple[int, str]], window: int):
        self.window = window
        self.items = [(k, words(t)) for k, t in items if t]
        lower = {w for _, t in items if t for w in WORD.findall(t) if w == w.lower() and not w[0].isdigit()}
        self.code = {w: UNIT for w in UNITS} | {w: FIRST + i for i, w in enumerate(sorted(w for w in lower if w not in UNITS and not any(map(str.isdigit, w))))}
        self.at: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for i, (_, own) in enumerate(self.items):
            for p, h in enumerate(self.hashes(np.array(self.codes(own), np.uint64)).tolist()):
                self.at[h].append((i, p))
        self.known = np.array(sorted(self.at), np.uint64)

    def code_of(self, word: str) -> int:
        c = self.code.get(word)
        return c if c else NUMBER if any(map(str.isdigit, word)) else NAME

    def codes(self, own: list[str]) -> list[int]:
        return [self.code_of(w) for w in own]

    def hashes(self, codes: np.ndarray) -> np.ndarray:
        n = len(codes) - self.window + 1
        out = np.zeros(max(n, 0), np.uint64)
        for j in range(self.window if n > 0 else 0):
            out *= _BASE
            out += codes[j : n + j] + np.uint64(17)
        return out

    def slots_agree(self, own: list[str], other: list[str]) -> bool:
        """Same template filled consistently: equal slots have equal fillings, both ways, by type."""
        there, back = {}, {}
        return all(there.setdefault(a, b) == b and back.setdefault(b, a) == a for a, b in zip(own, other, strict=True) if self.code_of(a) < FIRST)


def find_leaks(docs: DataFrame, items: list[tuple[int, str]], key: str = "doc_id", text: str = "text", window: int = 12, most_windows: int = 5_000_000) -> DataFrame:
    """Documents that hold a window of an evaluation passage, whole, in part or with changed slots.

    Columns: key, item_id, kind (``exact``: ``window`` or more consecutive words are equal;
    ``slots``: the template is equal and its slots are filled consistently with other values),
    windows, first_word, longest (words in the longest run of exact windows, 0 for ``slots``).
    ``items`` (item_id, passage) is the evaluation set, which is fixed and small: more than
    ``most_windows`` windows are refused. All documents and whole texts are read, and nothing is
    shuffled. Null, empty and short texts and passages give no row; a document given twice is
    reported twice; equal passages under several item ids are all reported. A window may occur
    any number of times.
    """
    templates = Templates(items, window)
    if sum(map(len, templates.at.values())) > most_windows:
        raise ValueError("the evaluation set is larger than the bound for a broadcast")
    shared = docs.sparkSession.sparkContext.broadcast(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t: Templates = shared.value
        cache = dict(t.code)
        get, window = cache.get, t.window
        for batch in batches:
            found: dict[tuple[int, int, str], list[int]] = defaultdict(list)
            owns: list[list[str]] = [words(x) if x else [] for x in batch.column(1).to_pylist()]
            if len(cache) > 500_000:
                cache.clear()
                cache.update(t.code)
            flat: list[int] = []
            for own in owns:
                flat += [get(w) or cache.setdefault(w, t.code_of(w)) for w in own]
            starts = np.concatenate([[0], np.cumsum([len(o) for o in owns])])
            h = t.hashes(np.array(flat, np.uint64))
            if len(h) and len(t.known):
                at = np.minimum(np.searchsorted(t.known, h), len(t.known) - 1)
                for p in np.nonzero(t.known[at] == h)[0].tolist():
                    d = int(np.searchsorted(starts, p, "right")) - 1
                    q = p - int(starts[d])
                    mine = owns[d][q : q + window]
                    if len(mine) < window:
                        continue  # the window reaches into the next document
                    for i, e in t.at[int(h[p])]:
                        theirs = t.items[i][1][e : e + window]
                        if mine == theirs:
                            found[d, i, "exact"].append(q)
                        elif t.slots_agree(theirs, mine):
                            found[d, i, "slots"].append(q)
            rows = []
            for (d, i, kind), at in found.items():
                at = sorted(set(at))
                longest = run_length = 0
                for k, q in enumerate(at):
                    run_length = run_length + 1 if k and q == at[k - 1] + 1 else 1
                    longest = max(longest, run_length)
                rows.append((d, t.items[i][0], kind, len(at), at[0], longest + window - 1 if kind == "exact" else 0))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), *[pa.array(c, pa.int32()) for c in cols[3:]]],
                names=[key, "item_id", "kind", "windows", "first_word", "longest"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, item_id bigint, kind string, windows int, first_word int, longest int")
