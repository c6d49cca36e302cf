"""Benchmark decontamination with a generalised suffix automaton of test items.

Items are normalised to words (A-Z lower-cased, words
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``) and joined into one suffix automaton
over words.  Documents are streamed through it; the automaton tracks the longest
suffix of the words read so far that occurs in an item.  A match of ``window``
words or more hits those words; an item of fewer words is hit when it occurs
whole.  Spans are removed when a document's matches pass the length limit, and
the document is contaminated when its hit words pass the coverage limit.

The documents are read once per block of items, row by row, without a shuffle.
Items are cut into pieces that overlap by a window, and pieces into blocks of
about ``BLOCK_WORDS`` words; a block passes the driver and is broadcast.  With
several blocks each is a pass of its own: it writes the hits of the texts that it
meets, then its broadcast is destroyed and the next block is collected, so a task
holds one automaton and the driver one block, however many items there are.  The
hits, a row per hit text, are merged and joined back by the text's digest.

To keep the walk off words that cannot match, it runs only over stretches where
each run of ``SEED`` words (fewer if an item is shorter) occurs in some item;
matches long enough to count lie inside such stretches whole.

Words are compared by 64-bit hashes.

Defined results: null texts have no words; an item without words has no window;
a null item id is written as an empty string; repeated documents each get their
row; an empty benchmark hits nothing; empty documents give an empty result;
other input columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytetext import ALNUM, LOWER, pieces, sequence_hash, word_hashes, words
from .common import map_arrow, named, stage, table

WINDOW, SEED = 13, 4
#: A document is contaminated if COVERAGE * hit words >= words.
COVERAGE = 20
#: Words of items in one automaton, and in one piece of an item.
BLOCK_WORDS, PIECE_WORDS = 200_000, 20_000

_PIECES = pa.schema([("item_id", pa.string()), ("n", pa.int64()), ("hashes", pa.list_(pa.int64()))])


def _cut_items(window: int, piece_words: int):
    """Item texts to pieces of word hashes that hold every window of the item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for i, j, raw, offsets in pieces(batch.column(1)):
                data = LOWER[raw]
                row, start, end = words(data, offsets, ALNUM)
                h = word_hashes(data, start, end).view(np.int64)
                bounds = np.searchsorted(row, np.arange(j - i + 1))
                for r in range(j - i):
                    a, b = int(bounds[r]), int(bounds[r + 1])
                    for at in range(a, b if b - a < window else b - window + 1, piece_words):
                        part = h[at : min(b, at + piece_words + window - 1)]
                        yield pa.record_batch([[ids[i + r] or ""], [len(part)], [part.tolist()]], schema=_PIECES)

    return run


class Automaton:
    """A generalised suffix automaton over word ids, with the items of each long enough match."""

    def __init__(self, items: list[tuple[str, np.ndarray]], window: int):
        self.window = window
        self.vocabulary = np.unique(np.concatenate([h for _, h in items]))
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(name, np.searchsorted(self.vocabulary, h).tolist()) for name, h in items]
        for _, ids in coded:
            last = 0
            for c in ids:
                last = self._extend(last, c)
        self.owners: dict[int, set[str]] = {}
        whole: dict[int, list[tuple[int, str]]] = {}
        for name, ids in coded:
            self._own(name, ids, whole)
        self.whole = {v: found for v in range(len(self.link)) if (found := self._suffixes(v, whole))} if whole else {}
        short = min(len(ids) for _, ids in coded)
        self.seed = min(SEED, short)
        self.seeds = np.unique(np.concatenate([sequence_hash(h.view(np.uint64), self.seed) for _, h in items]))
        self.sieve = np.zeros(1 << 20, dtype=bool)
        self.sieve[self.seeds >> np.uint64(44)] = True

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._split(last, q, c)
        new = self._state(length[last] + 1, {})
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p == -1:
            link[new] = 0
        else:
            q = nxt[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, q, c)
        return new

    def _state(self, length: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.link.append(0)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        """A state for the strings of ``q`` that are no longer than those reached from ``p``."""
        new = self._state(self.length[p] + 1, dict(self.next[q]))
        self.link[new] = self.link[q]
        self.link[q] = new
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def _own(self, name: str, ids: list[int], whole: dict) -> None:
        """Note the item at the states of its windows, or of its whole text if that is shorter."""
        v = 0
        for c in ids:
            v = self.next[v][c]
            u = self.window_state(v, self.window)
            if u:
                self.owners.setdefault(u, set()).add(name)
        if 0 < len(ids) < self.window:
            whole.setdefault(self.window_state(v, len(ids)), []).append((len(ids), name))

    def window_state(self, v: int, size: int) -> int:
        """The state of the last ``size`` words of state ``v``'s longest string; 0 if that is shorter."""
        if self.length[v] < size:
            return 0
        while self.length[self.link[v]] >= size:
            v = self.link[v]
        return v

    def _suffixes(self, v: int, whole: dict) -> list[tuple[int, str]]:
        found = []
        while v > 0:
            found += whole.get(v, [])
            v = self.link[v]
        return found

    def walk(self, ids: list[int], first: int, ranges: list[tuple[int, int]], names: set[str]) -> None:
        """Stream word ids; add hit ranges (counted from ``first``) and the items hit."""
        v, size = 0, 0
        nxt, link, length, w = self.next, self.link, self.length, self.window
        for i, c in enumerate(ids, first + 1):
            while v and c not in nxt[v]:
                v = link[v]
                size = length[v]
            if c in nxt[v]:
                v = nxt[v][c]
                size += 1
            if size >= w:
                ranges.append((i - w, i))
                u = v
                while length[link[u]] >= w:
                    u = link[u]
                names |= self.owners[u]
            for m, name in self.whole.get(v, ()):
                if m <= size:
                    ranges.append((i - m, i))
                    names.add(name)

    def search(self, h: np.ndarray, row: np.ndarray) -> Iterator[tuple[int, list[tuple[int, int]], set[str]]]:
        """(row, hit word ranges, items) of each stretch of ``h`` that may hold a match."""
        g = sequence_hash(h, self.seed)
        at = np.flatnonzero(self.sieve[g >> np.uint64(44)])
        at = at[row[at] == row[at + self.seed - 1]]
        near = np.minimum(np.searchsorted(self.seeds, g[at]), len(self.seeds) - 1)
        at = at[self.seeds[near] == g[at]]
        if not len(at):
            return
        cut = np.flatnonzero((np.diff(at) > 1) | (np.diff(row[at]) > 0)) + 1
        for a, b in zip(at[np.r_[0, cut]], at[np.r_[cut, len(at)] - 1] + self.seed, strict=True):
            ranges: list[tuple[int, int]] = []
            names: set[str] = set()
            self.walk(np.searchsorted(self.vocabulary, h[a:b].view(np.int64)).tolist(), int(a), ranges, names)
            if ranges:
                yield int(row[a]), ranges, names


_built: dict[str, Automaton] = {}


def _automaton(key: str, items, window: int) -> Automaton:
    """One automaton per Python worker; the last block's is kept."""
    if key not in _built:
        _built.clear()
        _built[key] = Automaton([(n, np.asarray(h, dtype=np.int64)) for n, h in items.value], window)
    return _built[key]


def _merge(ranges: list) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(map(tuple, ranges)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_HITS = "array<struct<a:bigint,b:bigint>>"
_SPAN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("words", pa.int64())]))
_HIT_TYPE = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def _scan(texts, auto) -> Iterator[tuple]:
    """Per piece of texts: its first and last row, offsets, words, and the matches {row: (runs of words, items)}."""
    for i, j, raw, offsets in pieces(texts):
        data = LOWER[raw]
        row, start, end = words(data, offsets, ALNUM)
        bounds = np.searchsorted(row, np.arange(j - i + 1))
        found: dict[int, tuple[list, set]] = {}
        if auto is not None and len(start) >= auto.seed:
            for r, ranges, names in auto.search(word_hashes(data, start, end), row):
                base = int(bounds[r])
                runs, ids = found.setdefault(i + int(r), ([], set()))
                runs += [(int(a) - base, int(b) - base) for a, b in ranges]
                ids.update(names)
        yield i, j, offsets, start, end, bounds, found


def _runs(hits) -> list[tuple[int, int]]:
    return [(x["a"], x["b"]) for x in hits or ()]


def _block_hits(items, key: str, window: int):
    """(text_key, word_hits, items) of the texts that one block of items hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = _automaton(key, items, window)
        for batch in batches:
            out = {}
            for *_, found in _scan(batch.column("text"), auto):
                out |= found
            rows = sorted(out)
            yield pa.record_batch(
                [
                    batch.column("text_key").take(pa.array(rows, pa.int64())),
                    pa.array([[{"a": a, "b": b} for a, b in _merge(out[r][0])] for r in rows], _HIT_TYPE),
                    pa.array([sorted(out[r][1]) for r in rows], pa.list_(pa.string())),
                ],
                names=["text_key", "word_hits", "items"],
            )

    return run


def _match(items, key: str, window: int):
    """Add n_words, n_hit, items and spans: the block's own matches and those found before (word_hits, items)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = _automaton(key, items, window) if items is not None else None
        for batch in batches:
            n_words = np.zeros(batch.num_rows, dtype=np.int64)
            n_hit = np.zeros(batch.num_rows, dtype=np.int64)
            hits = [_runs(x) for x in batch.column("word_hits").to_pylist()]
            names = [x or [] for x in batch.column("items").to_pylist()]
            spans: list = [[]] * batch.num_rows
            for i, j, offsets, start, end, bounds, found in _scan(batch.column("text"), auto):
                n_words[i:j] = np.diff(bounds)
                for r, (runs, ids) in found.items():
                    hits[r] = hits[r] + runs
                    names[r] = sorted({*names[r], *ids})
                for r in range(i, j):
                    if hits[r]:
                        runs = _merge(hits[r])
                        n_hit[r] = sum(b - a for a, b in runs)
                        base, o = int(bounds[r - i]), int(offsets[r - i])
                        spans[r] = [(int(start[base + a]) - o, int(end[base + b - 1]) - o, b - a) for a, b in runs]
            added = {
                "n_words": pa.array(n_words),
                "n_hit": pa.array(n_hit),
                "items": pa.array(names, pa.list_(pa.string())),
                "spans": pa.array([[{"start": s, "end": e, "words": n} for s, e, n in x] for x in spans], _SPAN_TYPE),
            }
            yield pa.record_batch([*(batch.column(c) for c in ("doc_id", "text", "row")), *added.values()], names=["doc_id", "text", "row", *added])

    return run


def _collected(block: DataFrame, window: int):
    """One block of items, broadcast, and its digest."""
    rows = sorted((r["item_id"], r["hashes"]) for r in block.collect())
    if not rows:
        return None, ""
    digest = hashlib.sha256(repr((window, rows)).encode()).hexdigest()
    return block.sparkSession.sparkContext.broadcast([(n, np.asarray(h, dtype=np.int64)) for n, h in rows]), digest


def _staged_hits(docs: DataFrame, keyed: DataFrame, n_blocks: int, window: int) -> DataFrame:
    """(text_key, word_hits, items) over all blocks: one pass a block, its hits written before the next is collected."""
    texts = docs.select(F.sha2("text", 256).alias("text_key"), "text")
    parts = []
    for b in range(n_blocks):
        shared, digest = _collected(keyed.filter(F.col("block") == b), window)
        if shared is None:
            continue
        hits = map_arrow(texts, _block_hits(shared, digest, window), f"text_key string, word_hits {_HITS}, items array<string>")
        parts.append(stage(hits.dropDuplicates(["text_key"]), "decontam-hits"))
        shared.destroy()
    every = reduce(DataFrame.unionByName, parts)
    # one row a block and text, so a group holds no more than the runs of one text
    return every.groupBy("text_key").agg(
        F.flatten(F.collect_list("word_hits")).alias("word_hits"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")
    )


def match_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, piece_words: int = PIECE_WORDS) -> DataFrame:
    """doc_id, text, row (the other columns), n_words, n_hit, items, spans (byte ranges of maximal hit runs, and their words)."""
    cut = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    cut = map_arrow(cut, _cut_items(window, min(piece_words, block_words)), "item_id string, n bigint, hashes array<bigint>").distinct()
    cut = stage(cut, "decontam-items")
    total = cut.agg(F.sum("n")).first()[0] or 0
    n_blocks = max(1, -(-2 * total // block_words)) if total > block_words else 1
    out = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.struct(*named(docs, "text")).alias("row"),
    )
    shared, digest = None, ""
    if n_blocks == 1:
        shared, digest = _collected(cut, window)
        out = out.withColumns({"word_hits": F.array().cast(_HITS), "items": F.array().cast("array<string>")})
    else:
        keyed = cut.withColumn("block", F.pmod(F.xxhash64("item_id", "hashes"), F.lit(n_blocks)))
        hits = stage(_staged_hits(out, keyed, n_blocks, window), "decontam-all-hits")
        out = out.withColumn("text_key", F.sha2("text", 256)).join(hits, "text_key", "left").drop("text_key")
    added = "n_words bigint, n_hit bigint, items array<string>, spans array<struct<start:bigint,end:bigint,words:bigint>>"
    schema = T.StructType([*(out.schema[c] for c in ("doc_id", "text", "row")), *T.StructType.fromDDL(added).fields])
    return map_arrow(out, _match(shared, digest, window), schema)


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, coverage: int = COVERAGE, longest: int = WINDOW, length: str | None = None) -> DataFrame:
    """The documents within the coverage limit, with all their columns; hit runs of ``longest`` words or more are cut.

    ``length`` names a column of code points, which is counted anew where a text is cut.
    """
    clean = match_documents(docs, benchmark).filter(~is_contaminated(coverage))
    cut = F.exists("spans", lambda s: s["words"] >= longest)
    clean = clean.select("row", _without(longest).alias("text"), cut.alias("cut"))

    def column(c: str) -> Column:
        if c == "text":
            return F.col("text")
        if c == length:
            return F.when(F.col("cut"), F.length("text")).otherwise(F.col("row")[c]).cast(docs.schema[c].dataType)
        return F.col("row")[c]

    return clean.select(*[column(c).alias(c) for c in docs.columns])


def is_contaminated(coverage: int = COVERAGE):
    return (F.col("n_hit") > 0) & (coverage * F.col("n_hit") >= F.col("n_words"))


def _without(longest: int) -> Column:
    """``text`` without the byte ranges ``spans`` of ``longest`` words or more."""
    raw, long = F.encode("text", "UTF-8"), F.filter("spans", lambda s: s["words"] >= longest)
    start = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(long, i - 1)["end"]).cast("int")
    end = lambda i: F.coalesce(F.get(long, i)["start"], F.octet_length("text")).cast("int")
    pieces_ = F.transform(F.sequence(F.lit(0), F.size(long)), lambda i: F.decode(F.substring(raw, start(i) + 1, end(i) - start(i)), "UTF-8"))
    return F.when(F.size(long) > 0, F.array_join(pieces_, "")).otherwise(F.col("text"))


def remove_spans(matched: DataFrame, longest: int = WINDOW, coverage: int = COVERAGE) -> DataFrame:
    """Texts without the hit runs of ``longest`` words or more; contaminated documents go whole."""
    return matched.filter(~is_contaminated(coverage)).select("doc_id", _without(longest).alias("text"))


def op8_suffix_automaton_decontamination(spark, sf_dir: str) -> DataFrame:
    m = match_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return m.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        is_contaminated().alias("contaminated"),
    )


ORACLE = {
    "op8_suffix_automaton_decontamination": rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), win AS (
  SELECT DISTINCT item, least(len(w), {WINDOW}) AS size, array_to_string(w[i:i + least(len(w), {WINDOW}) - 1], ' ') AS s
  FROM b, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS u(i) WHERE len(w) > 0
), sizes AS (SELECT DISTINCT size FROM win
), grams AS (
  SELECT rid, size, i, array_to_string(w[i:i + size - 1], ' ') AS s FROM d, sizes, unnest(range(1, len(w) - size + 2)) AS u(i)
), hit AS (SELECT rid, i, win.size, item FROM grams JOIN win USING (size, s)
), n AS (SELECT rid, count(DISTINCT i + o) AS n_hit FROM hit, unnest(range(0, size)) AS u(o) GROUP BY rid
), it AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND {COVERAGE} * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN it USING (rid)
"""
}
