"""Licence scan: matching statistics against a suffix automaton of templates, chained into template spans.

Templates (licence texts, notices, short references) and the phrases that name a
licence are turned into words (A-Z lower-cased, words
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``) and put into one generalised suffix
automaton.  A file streams through it: at every word the automaton holds the
longest run of words ending there that some template has.  Then

* wherever such a run ends with a whole phrase or template, that is a place;
* runs of ``LONG`` words or more that grow no further are matches.  Matches that
  follow each other both in the file and in a template, with at most ``GAP``
  words between them on either side, are chained so that the chain covers the
  most words of the template.  A chain is a span of the template if it covers
  ``SHARE`` percent of its words.

A short reference (``SHORT`` words or fewer) only counts whole.  A place is
looked at against the templates it matches longest, so a licence whose sentences
occur in a longer matched one is not reported beside it.

Only stretches of a file can match in which every ``LONG`` words (or the words of
a shorter item) occur in an item; the automaton is walked there and nowhere else,
with the same result.  Files are read row by row, without a shuffle; each worker
builds the automaton from the templates, which travel with the task and may have
``MAX_WORDS`` words in all.

Words are compared by 64-bit hashes.  Defined results: a null text is empty; a
text without words has no places; repeated rows each get their row; a very long
text is read whole, in memory proportional to it; of chains that begin at one
place the one that covers most counts, then the shortest; an empty table gives an
empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import ALNUM, LOWER, pieces, sequence_hash, word_hashes, words
from .common import map_arrow, table
from .licence_texts import PHRASES, TEMPLATES

LONG, GAP, SHORT, SHARE = 4, 40, 16, 60
MAX_WORDS = 200_000

_PLACE = pa.struct([("label", pa.string()), ("first", pa.int64()), ("words", pa.int64())])
_SPAN = pa.struct([("label", pa.string()), ("first", pa.int64()), ("words", pa.int64()), ("covered", pa.int64()), ("size", pa.int64())])
_OUT = "doc_id bigint, n_words bigint, places array<struct<label:string,first:bigint,words:bigint>>, spans array<struct<label:string,first:bigint,words:bigint,covered:bigint,size:bigint>>"


def _hashes(texts: Sequence[str]) -> list[np.ndarray]:
    out = []
    for i, j, raw, offsets in pieces(pa.array(texts, pa.string())):
        data = LOWER[raw]
        row, start, end = words(data, offsets, ALNUM)
        out += np.split(word_hashes(data, start, end), np.searchsorted(row, np.arange(1, j - i)))
    return out


class TemplateIndex:
    """Phrases and templates as one suffix automaton that knows where in them each of its runs stands."""

    def __init__(self, phrases: Sequence[tuple[str, str]], templates: Sequence[tuple[str, str]]):
        items = [(label, True, h) for (_, label), h in zip(phrases, _hashes([p for p, _ in phrases]))]
        items += [(label, False, h) for (label, _), h in zip(templates, _hashes([t for _, t in templates]))]
        items = [x for x in items if len(x[2])]
        if sum(len(h) for *_, h in items) > MAX_WORDS:
            raise ValueError(f"templates of more than {MAX_WORDS} words in all")
        self.labels = [label for label, _, _ in items]
        self.is_phrase = [p for _, p, _ in items]
        self.sizes = [len(h) for *_, h in items]
        # places where an item of few words stands must be found by the words of that item alone
        self.seeds = {LONG: np.unique(np.concatenate([sequence_hash(h, LONG) for *_, h in items]))}
        for size in {n for n in self.sizes if n < LONG}:
            self.seeds[size] = np.unique(np.concatenate([sequence_hash(h, size) for *_, h in items if len(h) == size]))
        self.sieves = {}
        for size, seeds in self.seeds.items():
            self.sieves[size] = np.zeros(1 << 20, dtype=bool)
            self.sieves[size][seeds >> np.uint64(44)] = True
        self.words = np.unique(np.concatenate([h for *_, h in items]))
        self.moves: list[dict[int, int]] = [{}]
        self.shorter, self.longest = [-1], [0]
        ends = []
        for t, (_, _, h) in enumerate(items):
            at = 0
            for j, c in enumerate(np.searchsorted(self.words, h).tolist(), 1):
                at = self._append(at, c)
                ends.append((at, t, j))
        self._locate(ends)

    def _append(self, at: int, c: int) -> int:
        """The state of ``at``'s longest run and word ``c``, made if it is new."""
        known = self.moves[at].get(c)
        if known is not None:
            return self._exact(at, known, c)
        new = self._new(self.longest[at] + 1, {})
        while at >= 0 and c not in self.moves[at]:
            self.moves[at][c] = new
            at = self.shorter[at]
        self.shorter[new] = 0 if at < 0 else self._exact(at, self.moves[at][c], c)
        return new

    def _new(self, size: int, moves: dict[int, int]) -> int:
        self.moves.append(moves)
        self.shorter.append(0)
        self.longest.append(size)
        return len(self.moves) - 1

    def _exact(self, at: int, to: int, c: int) -> int:
        """The state whose longest run is ``at``'s and ``c``; split off ``to`` if that has longer runs."""
        if self.longest[to] == self.longest[at] + 1:
            return to
        part = self._new(self.longest[at] + 1, self.moves[to].copy())
        self.shorter[part], self.shorter[to] = self.shorter[to], part
        while at >= 0 and self.moves[at].get(c) == to:
            self.moves[at][c] = part
            at = self.shorter[at]
        return part

    def _locate(self, ends: list[tuple[int, int, int]]) -> None:
        """Number the states so that those with longer runs of the same end are side by side; note items' ends."""
        below: list[list[int]] = [[] for _ in self.moves]
        for s, up in enumerate(self.shorter[1:], 1):
            below[up].append(s)
        self.enter, self.leave = [0] * len(self.moves), [0] * len(self.moves)
        own: list[list[tuple[int, int]]] = [[] for _ in self.moves]
        for s, t, j in ends:
            own[s].append((t, j))
        self.places: list[tuple[int, int]] = []
        todo = [(0, False)]
        while todo:
            s, done = todo.pop()
            if done:
                self.leave[s] = len(self.places)
                continue
            self.enter[s] = len(self.places)
            self.places += own[s]
            todo.append((s, True))
            todo += [(x, False) for x in below[s]]
        self.whole: dict[int, list[tuple[int, int]]] = {}
        for s in sorted(range(1, len(self.moves)), key=self.longest.__getitem__):
            found = [(j, t) for t, j in own[s] if j == self.sizes[t]] + self.whole.get(self.shorter[s], [])
            if found:
                self.whole[s] = found

    def ends(self, state: int) -> list[tuple[int, int]]:
        """(item, words up to the end) of everywhere that the state's runs stand."""
        return self.places[self.enter[state] : self.leave[state]]

    def stretches(self, h: np.ndarray, row: np.ndarray) -> Iterator[tuple[int, int]]:
        """Runs of words that can hold a place or match, each within one row."""
        edge = np.zeros(len(h) + 1, dtype=np.int64)
        for size, seeds in self.seeds.items():
            g = sequence_hash(h, size)
            at = np.flatnonzero(self.sieves[size][g >> np.uint64(44)])
            if len(at) and len(seeds):
                at = at[row[at] == row[at + size - 1]]
                at = at[seeds[np.minimum(np.searchsorted(seeds, g[at]), len(seeds) - 1)] == g[at]]
                edge[at] += 1
                np.subtract.at(edge, at + size, 1)
        inside = np.cumsum(edge[:-1]) > 0
        cut = np.flatnonzero(inside[1:] & inside[:-1] & (row[1:] != row[:-1])) + 1
        step = np.diff(np.r_[False, inside, False].astype(np.int8))
        first = np.union1d(np.flatnonzero(step == 1), cut)
        last = np.union1d(np.flatnonzero(step == -1), cut)
        yield from zip(first.tolist(), last.tolist(), strict=True)

    def stream(self, ids: list[int], first: int, places: list, matches: list) -> None:
        """Places (item, first word) and matches (first word, words, state) of a stretch that begins at ``first``."""
        state = size = 0
        for i, c in enumerate(ids, first):
            before, held = state, size
            while state and c not in self.moves[state]:
                state = self.shorter[state]
                size = self.longest[state]
            if c in self.moves[state]:
                state = self.moves[state][c]
                size += 1
            if size <= held and held >= LONG:
                matches.append((i - held, held, before))
            for n, t in self.whole.get(state, ()):
                if n <= size:
                    places.append((t, i + 1 - n))
        if size >= LONG:
            matches.append((first + len(ids) - size, size, state))

    def chain(self, matches: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
        """(template, first word, words, covered) of the best chain from each first word, in the order of the file."""
        recent: dict[int, list[tuple[int, int, int, int]]] = {}  # (end in file, end in template, covered, first word)
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for at, n, state in matches:
            for t, j in self.ends(state):
                if self.is_phrase[t] or self.sizes[t] <= SHORT:
                    continue
                near = recent[t] = [p for p in recent.get(t, ()) if p[0] >= at - GAP]
                covered, begin = n, at
                for end, reached, had, start in near:
                    twice = max(0, end - at, reached - (j - n))
                    if twice < n and j - n + twice - reached <= GAP and at + twice - end <= GAP:
                        covered, begin = max((covered, begin), (had + n - twice, start), key=lambda x: (x[0], -x[1]))
                near.append((at + n, j, covered, begin))
                had = best.get((t, begin))
                if had is None or had[0] < covered:
                    best[t, begin] = (covered, at + n)
        return [(t, begin, end - begin, covered) for (t, begin), (covered, end) in sorted(best.items(), key=lambda x: (x[0][1], x[0][0]))]


_built: dict[tuple, TemplateIndex] = {}


def _index(phrases, templates) -> TemplateIndex:
    """One index per Python worker; the last one is kept."""
    if (phrases, templates) not in _built:
        _built.clear()
        _built[phrases, templates] = TemplateIndex(phrases, templates)
    return _built[phrases, templates]


def _scan(phrases: tuple, templates: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(phrases, templates)
        for batch in batches:
            n_words = np.zeros(batch.num_rows, dtype=np.int64)
            places: list[list] = [[] for _ in range(batch.num_rows)]
            matches: list[list] = [[] for _ in range(batch.num_rows)]
            for i, j, raw, offsets in pieces(batch.column("text")):
                data = LOWER[raw]
                row, start, end = words(data, offsets, ALNUM)
                if not len(row):
                    continue
                bounds = np.searchsorted(row, np.arange(j - i + 1))
                n_words[i:j] = np.diff(bounds)
                h = word_hashes(data, start, end)
                for a, b in index.stretches(h, row):
                    r = int(row[a])
                    index.stream(np.searchsorted(index.words, h[a:b]).tolist(), a - int(bounds[r]), places[i + r], matches[i + r])
            spans = [index.chain(m) for m in matches]
            yield pa.record_batch(
                [
                    batch.column("doc_id"),
                    pa.array(n_words),
                    pa.array([[(index.labels[t], at, index.sizes[t]) for t, at in p if index.is_phrase[t]] for p in places], pa.list_(_PLACE)),
                    pa.array([_spans(index, p, s) for p, s in zip(places, spans, strict=True)], pa.list_(_SPAN)),
                ],
                names=["doc_id", "n_words", "places", "spans"],
            )

    return run


def _spans(index: TemplateIndex, places: list, chains: list) -> list[tuple]:
    """(label, first word, words, covered words, words of the template) of whole templates and of chains."""
    whole = [(index.labels[t], at, index.sizes[t], index.sizes[t], index.sizes[t]) for t, at in places if not index.is_phrase[t]]
    known = {(label, at) for label, at, *_ in whole}
    chained = [(index.labels[t], at, n, covered, index.sizes[t]) for t, at, n, covered in chains]
    return sorted([*whole, *(x for x in chained if x[:2] not in known)], key=lambda x: (x[1], x[0], -x[3]))


def scan_licences(docs: DataFrame, phrases: Sequence[tuple[str, str]] = PHRASES, templates: Sequence[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """One row per document: doc_id, n_words, places (label, first, words) and spans.

    ``spans`` holds whole templates and all chains, as (label, first word, words, covered words,
    words of the template); :func:`is_licence` says which of them count.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(texts, _scan(tuple(map(tuple, phrases)), tuple(map(tuple, templates))), _OUT)


def is_licence(span, share: int = SHARE):
    return 100 * span["covered"] >= share * span["size"]


def op12_licence_templates(spark, sf_dir: str) -> DataFrame:
    """``score`` is the largest covered share of a template; a named licence without more has at least 0.5."""
    d = scan_licences(table(spark, sf_dir, "documents"))
    own = F.transform(F.filter("spans", is_licence), lambda x: x["label"])
    share = F.coalesce(F.array_max(F.transform("spans", lambda x: x["covered"] / x["size"])), F.lit(0.0))
    return d.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places.first").alias("first_word"),
        F.array_max("places.first").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("places.label")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("places.label", own)), ",").alias("labels"),
        F.greatest(share, F.when(F.size("places") > 0, 0.5).otherwise(0.0)).alias("score"),
    )
