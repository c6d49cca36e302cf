"""Phrase collocations, counted by double-array tries over the words of the texts.

Texts are lower-cased (A-Z), split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and
those into words ``[^\\x20\\x09]+``; a phrase never crosses a piece.  All counts
are per language (null: ``und``).

1. First of words, then of pairs every task counts the 64-bit hashes, of pairs only those
   whose words may be frequent, and sends them in slices of the hash range; a slice adds
   its counts up and marks the frequent ones in its part of a bitmap of 2^``BITMAP`` bits,
   the one thing that is broadcast.  A bit that two phrases share only lets one more
   candidate through, so every phrase that is frequent is a candidate (Apriori).
2. In a third pass every task adds up its words, pairs and triples that the bitmaps let
   pass (triples by their two pairs) and deals them with their counts to slices, words and
   pairs by their hash, triples with their first pair, so that a common first word has
   pairs in every slice.  A row has the words it needs once, and the phrases as places of them.
3. A slice drops what cannot reach ``LEAST`` by the sums of a small table of hashes and builds
   the others into double-array tries of about half of ``PHRASES`` phrases: a word is two
   symbols of ``DIGIT`` bits, the next state of s at c is base[s] + c, if check there is s.
   The states of all dealt phrases are advanced at once, symbol by symbol, and the counts
   of all tasks are summed by state.  A slice has about ``TOGETHER`` tries.  Candidates under
   ``LEAST`` end here.

The texts are read three times, however many candidates there are: more of them mean more
slices, not more memory.  Scores are
integers computed from decimals of 38 digits, exact for counts below 10^15.
A language's best rows are cut from the best of ``SALTS`` parts of it, so that no
task sorts a whole language.

Words are compared by 64-bit hashes, phrases by their words.  Defined results:
null texts and texts without words count nothing; repeated rows count each time;
a text of any length is read whole, in memory proportional to it; ties in score
are ordered by count and phrase, so there are none left; an empty table gives an
empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .bytetext import LOWER, mix, pieces, sequence_hash, word_hashes, words
from .common import map_arrow, stage, table

LEAST, LONGEST, TOP = 10, 3, 2000
#: A phrase goes if a longer one that holds it has this share (percent) of its occurrences.
INSIDE = 50
BITMAP = 27
#: Phrases of a trie at most (about), and tries of a slice.
PHRASES, TOGETHER = 1 << 18, 8
DIGIT = 12
#: States with so many children at most are given room many at a time.
FEW = 6
SALTS = 16
#: Phrases that leave a task as one batch.
CUT = 1 << 15
#: Hashes or words that a task holds before it adds them up, and distinct hashes before it sends them.
HELD = 1 << 21

#: Bytes that end a piece, and bytes of words.
ENDS = np.zeros(256, dtype=bool)
ENDS[[*map(ord, ".,;:!?"), *range(0x0A, 0x0E)]] = True
WORD = ~ENDS
WORD[[0x20, 0x09]] = False


def _salts(langs: pa.Array) -> np.ndarray:
    """A 64-bit number for the language of each row."""
    d = langs.dictionary_encode()
    of = [int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in d.dictionary.to_pylist()]
    return np.array(of, dtype=np.uint64)[d.indices.to_numpy(zero_copy_only=False)]


def _tokens(batch: pa.RecordBatch, text: str = "text") -> Iterator[tuple]:
    """(bytes, rows, starts, ends, hashes, joined) of the words of runs of rows; joined: the next word is in the same piece."""
    salts = _salts(batch.column("lang"))
    for i, _, raw, offsets in pieces(batch.column(text)):
        data = LOWER[raw]
        row, start, end = words(data, offsets, WORD)
        if not len(row):
            continue
        h = mix(word_hashes(data, start, end) ^ salts[row + i])
        cuts = np.cumsum(ENDS[data], dtype=np.int64)
        joined = np.zeros(len(row), dtype=bool)
        joined[:-1] = (row[1:] == row[:-1]) & (cuts[start[1:]] == cuts[end[:-1] - 1])
        yield data, row + i, start, end, h, joined


class Bitmap:
    """Membership of 64-bit hashes by their first bits."""

    def __init__(self, packed: np.ndarray):
        self.packed = packed
        self.shift = np.uint64(64 - int(len(packed) * 8 - 1).bit_length())

    def has(self, h: np.ndarray) -> np.ndarray:
        at = h >> self.shift
        return (self.packed[at >> np.uint64(3)] << (at & np.uint64(7)).astype(np.uint8) & 0x80) > 0


def _frequent(h: np.ndarray, joined: np.ndarray, words: Bitmap) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the words that may be frequent, and whether the next word is one too, in the same piece."""
    alive = words.has(h)
    pair = joined & alive
    pair[:-1] &= alive[1:]
    at = np.flatnonzero(alive)
    return at, pair[at]


def _edges(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.r_[True, x[1:] != x[:-1]][: len(x)])


def _merge(hashes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes in order and their summed counts (255 stands for more)."""
    h = np.concatenate(hashes)
    order = np.argsort(h)
    h = h[order]
    first = _edges(h)
    n = np.concatenate(counts)[order].astype(np.int64)
    n = np.add.reduceat(n, first) if len(h) else n
    return h[first], np.minimum(n, 255).astype(np.uint8)


_COUNTED = "slice int, hashes binary, counts binary, seen bigint"


def _count_hashes(shared: list, slice_bits: int):
    """Texts to (slice, hashes, counts, seen) of the words, or with a bitmap of the pairs of words that it lets pass.

    A row of a slice tells in ``seen`` how many words or pairs stand behind it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = [Bitmap(b.value) for b in shared]
        known = (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint8))
        counted, held, size = known, [], 0

        def add():
            h = np.sort(np.concatenate([known[0], *held]))
            first = _edges(h)
            fresh = h[first], np.minimum(np.diff(np.r_[first, len(h)]), 255).astype(np.uint8)
            return _merge(*zip(counted, fresh)) if len(counted[0]) else fresh

        def send():
            h, n = counted
            edges = np.searchsorted(h >> np.uint64(64 - slice_bits), np.arange((1 << slice_bits) + 1))
            full = np.flatnonzero(np.diff(edges))
            blobs = [pa.array([x[edges[s] : edges[s + 1]].tobytes() for s in full], pa.binary()) for x in counted]
            seen = [int(n[edges[s] : edges[s + 1]].sum()) for s in full]
            return pa.record_batch([pa.array(full, pa.int32()), *blobs, pa.array(seen, pa.int64())], names=["slice", "hashes", "counts", "seen"])

        for batch in batches:
            for _, _, _, _, h, joined in _tokens(batch):
                if maps:
                    at, pair = _frequent(h, joined, maps[0])
                    h = sequence_hash(h[at], 2)[pair[:-1]]
                held.append(h)
                size += len(h)
                if size > HELD:
                    counted, held, size = add(), [], 0
                    if len(counted[0]) > HELD:
                        yield send()
                        counted = known
        counted = add()
        yield send()

    return run


def _mark(least: int, slice_bits: int, bitmap: int):
    """Counted hashes, sorted by slice, to the slice's part of the bitmap of frequent ones."""
    width = bitmap - slice_bits

    def bits(s: int, held: list, seen: int) -> pa.RecordBatch:
        h, n = _merge(*held)
        part = np.zeros(1 << width, dtype=bool)
        part[((h[n >= least] >> np.uint64(64 - bitmap)) & np.uint64((1 << width) - 1)).astype(np.int64)] = True
        return pa.record_batch([pa.array([s], pa.int32()), pa.array([np.packbits(part).tobytes()], pa.binary()), pa.array([seen], pa.int64())], names=["slice", "bits", "seen"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, size, seen = None, [], 0, 0
        for batch in batches:
            for s, hashes, counts, m in zip(*(batch.column(c) for c in ("slice", "hashes", "counts", "seen"))):
                if s.as_py() != current:
                    if held:
                        yield bits(current, held, seen)
                    current, held, size, seen = s.as_py(), [[], []], 0, 0
                for x, blob, kind in zip(held, (hashes, counts), (np.uint64, np.uint8)):
                    x.append(np.frombuffer(blob.as_buffer(), dtype=kind))
                seen += m.as_py()
                size += len(held[0][-1])
                if size > 2 * HELD:
                    held, size = [[x] for x in _merge(*held)], 0
        if held:
            yield bits(current, held, seen)

    return run


def _bitmap(texts: DataFrame, shared: list, least: int, bitmap: int) -> tuple[np.ndarray, int]:
    """The packed bitmap of frequent words, or with their bitmap of frequent pairs, and how many words or pairs were seen (about)."""
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slice_bits = min(max(8, (tasks - 1).bit_length()), bitmap - 3)
    counted = map_arrow(texts, _count_hashes(shared, slice_bits), _COUNTED)
    marked = map_arrow(counted.repartition("slice").sortWithinPartitions("slice"), _mark(least, slice_bits, bitmap), "slice int, bits binary, seen bigint")
    out, seen = np.zeros(1 << (bitmap - 3), dtype=np.uint8), 0
    width = 1 << (bitmap - slice_bits - 3)
    for r in marked.collect():  # of the bitmap's size; an iterator would run the tasks one by one
        out[r["slice"] * width : (r["slice"] + 1) * width] = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
        seen += r["seen"]
    return out, seen


def _gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of runs of ``size`` from ``start``, one run after the other."""
    return data[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]


def _phrase_texts(data: np.ndarray, start: np.ndarray, size: np.ndarray, word: np.ndarray) -> pa.Array:
    """The phrases of the words in each row of ``word``, joined by a space.  ``data`` begins with a space."""
    rows, k = word.shape
    begin = np.zeros((rows, 2 * k - 1), dtype=np.int64)
    length = np.ones((rows, 2 * k - 1), dtype=np.int64)
    begin[:, ::2], length[:, ::2] = start[word], size[word]
    out = _gather(data, begin.ravel(), length.ravel())
    offsets = np.r_[0, np.cumsum(length.sum(axis=1))].astype(np.int64)
    return pa.LargeStringArray.from_buffers(rows, pa.py_buffer(offsets), pa.py_buffer(out)).cast(pa.string())


def _distinct(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys in order, a position of each, the place of every key among them, counts) of keys below 2^bits."""
    keys = keys.view(np.uint64)
    room = len(keys).bit_length()
    drop = np.uint64(max(0, bits + room - 64))
    order = keys >> drop << np.uint64(room)
    order |= np.arange(len(keys), dtype=np.uint64)
    order.sort()
    order &= np.uint64((1 << room) - 1)
    found = keys[order]
    if drop and (found[1:] < found[:-1]).any():  # keys that differ in their last bits only
        order = np.argsort(keys)
        found = keys[order]
    first = _edges(found)
    n = np.diff(np.r_[first, len(keys)])
    place = np.empty(len(keys), dtype=np.int32)
    place[order] = np.repeat(np.arange(len(first), dtype=np.int32), n)
    return found[first], order[first].astype(np.int64), place, n


def _blob(x: np.ndarray) -> bytes:
    """Numbers that are not negative, in as few bytes each as the largest needs (told by the first byte)."""
    top = int(x.max()) if len(x) else 0
    kind = next(t for t in (np.uint8, np.uint16, np.uint32) if top <= np.iinfo(t).max)
    return bytes([np.dtype(kind).itemsize]) + x.astype(kind).tobytes()


def _numbers(blob: pa.Buffer) -> np.ndarray:
    return np.frombuffer(blob, dtype=f"u{memoryview(blob)[0]}", offset=1).astype(np.int32)


#: ``langs`` and ``words``: a dictionary (:func:`_deal`); ``n``: a language's words, in rows of their own.
_DEALT = "slice int, langs array<string>, words array<binary>, phrases array<binary>, n bigint"


def _dealt(slices: list, langs: list, words: list, phrases: list, n: list) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.list_(pa.string()), pa.list_(pa.binary()), pa.list_(pa.binary()), pa.int64())
    return pa.record_batch([pa.array(x, t) for x, t in zip((slices, langs, words, phrases, n), kinds)], names=["slice", "langs", "words", "phrases", "n"])


def _deal(shared: list, slices: int):
    """Texts to their phrases that may be frequent, with counts, in rows for the slice of each word or pair; triples go with their first pair.

    A row has a dictionary: languages, the language of each word, sizes and bytes.  Phrases are
    places in it: words and counts; left, right and counts of pairs; pair, third word and counts of triples.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_map, pairs_map = (Bitmap(b.value) for b in shared)
        kind = np.uint16 if slices <= 1 << 16 else np.int64  # numpy sorts 16 bits by radix
        slice_of = lambda h: ((h >> np.uint64(32)) * np.uint64(slices) >> np.uint64(32)).astype(kind)
        codes: dict[str, int] = {}
        total = np.zeros(0, dtype=np.int64)
        held: list[tuple] = []
        size = at_byte = 0

        def send() -> Iterator[pa.RecordBatch]:
            columns = [list(x) for x in zip(*held)]
            held.clear()
            data, h, lang, start, length, pair = (np.concatenate(columns.pop(0)) for _ in range(6))
            names = list(codes)
            found, first, word, uses = _distinct(h, 64)
            wide = np.int64(max(1, len(found)))
            at = np.flatnonzero(pair)
            keys, _, place, n2 = _distinct(word[at] * wide + word[at + 1], 2 * int(wide).bit_length())
            left, right = keys.astype(np.int64) // wide, keys.astype(np.int64) % wide
            pairs = np.full(len(h), -1, dtype=np.int32)
            pairs[at] = place
            at = np.flatnonzero(pair[:-1] & pair[1:])
            third = np.sort(pairs[at] * wide + word[at + 2])
            del h, pair, word, at, place, pairs
            cut = _edges(third)
            n3 = np.diff(np.r_[cut, len(third)])
            inner, third = third[cut] // wide, third[cut] % wide
            # in the order of their slices
            of1, of2 = slice_of(found), slice_of(sequence_hash(np.c_[found[left], found[right]].ravel(), 2)[::2])
            order1, order2, order3 = (np.argsort(x, kind="stable") for x in (of1, of2, of2[inner]))
            renamed = np.empty(len(order2), dtype=np.int64)
            renamed[order2] = np.arange(len(order2))
            left, right, n2, inner, third, n3 = left[order2], right[order2], n2[order2], renamed[inner[order3]], third[order3], n3[order3]
            ends = [np.searchsorted(x[o], np.arange(slices + 1)) for x, o in ((of1, order1), (of2, order2))]
            ends.append(np.searchsorted(inner, ends[1]))
            lang, start, length = lang[first], start[first], length[first]
            rows: list[tuple] = []
            for s in np.flatnonzero(np.diff(ends[0]) + np.diff(ends[1])).tolist():
                one, two, three = (slice(e[s], e[s + 1]) for e in ends)
                own = order1[one]
                used, code = np.unique(np.concatenate([own, left[two], right[two], third[three]]), return_inverse=True)
                edges = np.cumsum([len(own), two.stop - two.start, two.stop - two.start])
                a, b, c, d = np.split(code, edges)
                spoken, lang_code = np.unique(lang[used], return_inverse=True)
                dictionary = [_blob(lang_code), _blob(length[used]), _gather(data, start[used], length[used]).tobytes()]
                phrases = [_blob(x) for x in (a, uses[own], b, c, n2[two], inner[three] - two.start, d, n3[three])]
                rows.append((s, [names[x] for x in spoken], dictionary, phrases, None))
                if len(rows) == 256:
                    yield _dealt(*map(list, zip(*rows)))
                    rows = []
            if rows:
                yield _dealt(*map(list, zip(*rows)))

        for batch in batches:
            langs = batch.column("lang").dictionary_encode()
            of = np.array([codes.setdefault(x, len(codes)) for x in langs.dictionary.to_pylist()], dtype=np.int64)[langs.indices.to_numpy(zero_copy_only=False)]
            for data, row, start, end, h, joined in _tokens(batch):
                some = np.bincount(of[row], minlength=len(codes))
                some[: len(total)] += total
                total = some
                at, pair = _frequent(h, joined, words_map)
                if not len(at):
                    continue
                h = h[at]
                pair[-1] = False
                pair[:-1] &= pairs_map.has(sequence_hash(h, 2))
                held.append((data, h, of[row[at]].astype(np.int32), start[at] + at_byte, (end - start)[at].astype(np.int32), pair))
                size += len(at)
                at_byte += len(data)
                if size > HELD:
                    yield from send()
                    size = at_byte = 0
        if held:
            yield from send()
        for lang, n in zip(codes, total.tolist()):
            yield _dealt([zlib.crc32(lang.encode()) % slices], [[lang]], [None], [None], [n])

    return run


class DoubleArray:
    """A double-array trie over sequences of symbols below 2^DIGIT."""

    def __init__(self, symbols: np.ndarray):
        """``symbols``: one row per sequence, -1 after its end.  ``node``: the state of each sequence."""
        self.base = np.zeros(1 << DIGIT, dtype=np.int32)
        self.check = np.full(1 << DIGIT, -1, dtype=np.int32)
        self.check[0] = 0
        rng = np.random.default_rng(1)
        ids, slot = np.zeros(len(symbols), dtype=np.int64), np.zeros(1, dtype=np.int64)
        self.node = np.zeros(len(symbols), dtype=np.int64)
        for d in range(symbols.shape[1]):
            rows = np.flatnonzero(symbols[:, d] >= 0)
            if not len(rows):
                break
            children, ids[rows] = np.unique((ids[rows] << DIGIT) + symbols[rows, d], return_inverse=True)
            slot = self._place(slot[children >> DIGIT], children & ((1 << DIGIT) - 1), rng)
            self.node[rows] = slot[ids[rows]]

    def _grow(self, size: int) -> None:
        more = size - len(self.check)
        if more > 0:
            self.base = np.concatenate([self.base, np.zeros(more, dtype=np.int32)])
            self.check = np.concatenate([self.check, np.full(more, -1, dtype=np.int32)])

    def _place(self, parent: np.ndarray, symbol: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """Find room for the children of each parent (side by side, ascending); returns their states."""
        first = np.flatnonzero(np.r_[True, parent[1:] != parent[:-1]])
        count = np.diff(np.r_[first, len(parent)])
        used = int((self.check >= 0).sum())
        self._grow(2 * (used + len(parent)) + (2 << DIGIT))
        state = np.empty(len(parent), dtype=np.int64)
        for many in (np.flatnonzero(count > FEW), np.flatnonzero((count > 1) & (count <= FEW))):
            if len(many) and count[many[0]] <= FEW:
                many = self._place_few(many, first, count, symbol, parent, state, rng)
            for g in many[np.argsort(-count[many], kind="stable")].tolist():
                a, b = first[g], first[g] + count[g]
                c = symbol[a:b]
                base = self._room(c, rng)
                state[a:b] = base + c
                self.check[state[a:b]] = parent[a]
                self.base[parent[a]] = base
        single = first[count == 1]
        state[single] = np.flatnonzero(self.check < 0)[: len(single)]
        self.check[state[single]] = parent[single]
        self.base[parent[single]] = state[single] - symbol[single]
        return state

    def _place_few(self, groups: np.ndarray, first: np.ndarray, count: np.ndarray, symbol: np.ndarray, parent: np.ndarray, state: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """Bases at random for many groups of few children together; returns those that found no room."""
        owner = np.full(len(self.check), -1, dtype=np.int64)
        for _ in range(32):
            if not len(groups):
                break
            some = np.cumsum(count[groups]) - count[groups]
            child = np.repeat(first[groups] - some, count[groups]) + np.arange(int(count[groups].sum()))
            base = rng.integers(1, len(self.check) - (1 << DIGIT), len(groups)) - symbol[first[groups]]
            to = np.repeat(base, count[groups]) + symbol[child]
            group = np.repeat(np.arange(len(groups)), count[groups])
            free = np.logical_and.reduceat(self.check[to] < 0, some)
            owner[to[free[group]]] = group[free[group]]
            won = free & np.logical_and.reduceat(owner[to] == group, some)
            on = won[group]
            owner[to] = -1
            self.check[to[on]] = parent[child[on]]
            state[child[on]] = to[on]
            self.base[parent[first[groups[won]]]] = base[won]
            groups = groups[~won]
        return groups

    def _room(self, c: np.ndarray, rng: np.random.Generator) -> int:
        """A base at which the states of symbols ``c`` are free; tried at random, else behind the end."""
        span = int(c[-1] - c[0]) + 1
        for tries in (8, 64, 256):
            at = rng.integers(1, len(self.check) - span + 1, tries)
            ok = (self.check[at[:, None] + (c - c[0])] < 0).all(axis=1)
            if ok.any():
                return int(at[np.argmax(ok)] - c[0])
        at = len(self.check)
        self._grow(at + span)
        return int(at - c[0])

    @staticmethod
    def step(base: np.ndarray, check: np.ndarray, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The next state of each, -1 where there is none."""
        to = base[state] + symbol
        out = (to < 0) | (to >= len(check))
        to[out] = 0
        return np.where(~out & (check[to] == state) & (to > 0), to, -1)


def _words_on(trie: DoubleArray, state: np.ndarray, code: np.ndarray) -> np.ndarray:
    """The states a word later, through its two symbols; -1 where there is none."""
    for shift in (DIGIT, 0):
        to = DoubleArray.step(trie.base, trie.check, np.maximum(state, 0), code >> shift & ((1 << DIGIT) - 1))
        state = np.where(state < 0, -1, to)
    return state


def _trie_counts(sequences: np.ndarray, phrases: list[np.ndarray]) -> np.ndarray:
    """How often each of ``sequences`` (rows of word numbers, -1 after their end) is among ``phrases``, counted by a trie.

    ``phrases``: words and counts; left, right and counts of pairs; pair, third word and counts of triples.
    """
    a, n1, left, right, n2, inner, third, n3 = phrases
    # common words get small codes, so that their symbols meet in few states
    uses = np.bincount(sequences[sequences >= 0])
    rank = np.empty(len(uses), dtype=np.int64)
    rank[np.argsort(-uses, kind="stable")] = np.arange(len(uses))
    code = np.where(sequences >= 0, rank[sequences], -1)
    symbols = np.where(code < 0, -1, np.stack([code >> DIGIT, code & ((1 << DIGIT) - 1)])).transpose(1, 2, 0).reshape(len(code), -1)
    trie = DoubleArray(symbols)
    root = lambda x: np.zeros(len(x), dtype=np.int64)
    single = _words_on(trie, root(a), rank[a])
    double = _words_on(trie, _words_on(trie, root(left), rank[left]), rank[right])
    triple = _words_on(trie, double[inner], rank[third])
    counts = np.zeros(len(trie.check), dtype=np.int64)
    for state, n in ((single, n1), (double, n2), (triple, n3)):
        counts += np.bincount(state[state >= 0], n[state >= 0], len(counts)).astype(np.int64)
    return counts[trie.node]


def _sieved(keys: np.ndarray, n: np.ndarray, least: int) -> np.ndarray:
    """Which keys may reach ``least``: sums of the counts that share a hash of 22 bits."""
    at = (mix(keys.astype(np.uint64)) >> np.uint64(42)).astype(np.int64)
    return np.bincount(at, n, 1 << 22)[at] >= least


class _Slice:
    """The dealt rows of one slice, and the words of languages."""

    def __init__(self) -> None:
        self.totals: dict[str, int] = {}
        self.langs: dict[str, int] = {}
        self.words: list[tuple] = []
        self.phrases: list[tuple] = []
        self.size = self.pairs = self.bytes = self.entries = 0
        self.room = 4 * HELD

    def add(self, langs: list[str], words: list[pa.Buffer], phrases: list[pa.Buffer]) -> None:
        salts = _salts(pa.array(langs, pa.string()))
        lang, size = _numbers(words[0]), _numbers(words[1])
        data = np.frombuffer(words[2], dtype=np.uint8)
        start = np.cumsum(size, dtype=np.int64) - size
        h = mix(word_hashes(data, start, start + size) ^ salts[lang])
        of = np.array([self.langs.setdefault(x, len(self.langs)) for x in langs], dtype=np.int32)
        a, n1, left, right, n2, inner, third, n3 = map(_numbers, phrases)
        self._hold((h, of[lang], start + self.bytes, size, data), (a + self.size, n1, left + self.size, right + self.size, n2, inner + self.pairs, third + self.size, n3))
        if self.entries > self.room:
            self.fold()

    def _hold(self, words: tuple, phrases: tuple) -> None:
        self.words.append(words)
        self.phrases.append(phrases)
        self.size += len(words[0])
        self.bytes += len(words[4])
        self.pairs += len(phrases[4])
        self.entries += len(words[0]) + len(phrases[4]) + len(phrases[7])

    def _taken(self) -> tuple[tuple, tuple]:
        """All that is held, with each word once; nothing is held any more."""
        columns = [list(x) for x in (*zip(*self.words), *zip(*self.phrases))]
        self.words, self.phrases = [], []
        self.size = self.pairs = self.bytes = self.entries = 0
        h, lang, start, size, data, a, n1, left, right, n2, inner, third, n3 = (np.concatenate(columns.pop(0)) for _ in range(13))
        h, first, place, _ = _distinct(h, 64)
        return (h, lang[first], start[first], size[first], data), (place[a], n1, place[left], place[right], n2, inner, place[third], n3)

    def fold(self) -> None:
        """Add equal phrases up, so that a common pair does not fill memory with each task's rows of it."""
        (h, lang, start, size, data), (a, n1, left, right, n2, inner, third, n3) = self._taken()
        wide = np.int64(len(h))
        bits = 2 * int(wide).bit_length()
        added = lambda place, n: np.bincount(place, n).astype(np.int64)
        a, _, place, _ = _distinct(a.astype(np.int64), bits)
        n1 = added(place, n1)
        pairs, _, of, _ = _distinct(left * wide + right, bits)
        n2 = added(of, n2)
        triples, _, place, _ = _distinct(of[inner] * wide + third, bits + 32)
        n3 = added(place, n3)
        a, pairs, triples = (x.astype(np.int64) for x in (a, pairs, triples))
        self._hold((h, lang, np.cumsum(size, dtype=np.int64) - size, size, _gather(data, start, size)), (a.astype(np.int32), n1, *(x.astype(np.int32) for x in (pairs // wide, pairs % wide)), n2, *(x.astype(np.int32) for x in (triples // wide, triples % wide)), n3))
        self.room = max(self.room, 2 * self.entries)

    def counted(self, least: int, block: int) -> Iterator[pa.RecordBatch]:
        """(lang, phrase, n_words, f, pair) of the frequent words and phrases; n_words 0: the words of the language.

        ``pair``: the count of a triple's first pair; of a pair, that of the most frequent triple which begins with it.
        """
        for lang, n in self.totals.items():
            yield _named(pa.array([lang], pa.string()), pa.nulls(1, pa.string()), 0, np.array([n]))
        if not self.words:
            return
        (h, lang, start, size, data), (a, n1, left, right, n2, inner, third, n3) = self._taken()
        wide = np.int64(len(h))
        # phrases that may be frequent
        on = _sieved(a, n1, least)
        a, n1 = a[on], n1[on]
        keys = left * wide + right
        on = _sieved(keys, n2, least)
        pairs, _, of, _ = _distinct(keys[on], 2 * int(wide).bit_length())
        pairs = pairs.astype(np.int64)
        place = np.full(len(keys), -1, dtype=np.int32)
        place[on] = of
        left, right, n2 = left[on], right[on], n2[on]
        renamed = np.cumsum(on, dtype=np.int32) - 1
        on = place[inner] >= 0
        inner, third, n3 = inner[on], third[on], n3[on]
        keys = place[inner] * wide + third
        on = _sieved(keys, n3, least)
        inner, third, n3 = renamed[inner[on]], third[on], n3[on]
        triples = np.unique(keys[on])
        words = np.unique(a)
        sequences = np.full((len(words) + len(pairs) + len(triples), LONGEST), -1, dtype=np.int64)
        sequences[: len(words), 0] = words
        sequences[len(words) :, 0] = np.r_[pairs // wide, pairs[triples // wide] // wide]
        sequences[len(words) :, 1] = np.r_[pairs % wide, pairs[triples // wide] % wide]
        sequences[len(words) + len(pairs) :, 2] = triples % wide
        # tries of about half a block at most: words by themselves, triples with their pair
        tries = max(1, -(-2 * len(sequences) // block))
        by = lambda x: (mix(x.astype(np.uint64)) % np.uint64(tries)).astype(np.int64)
        trie_of = np.r_[by(words), by(pairs), by(pairs[triples // wide])]
        of1, of2 = by(a), by(left * wide + right)
        of3 = of2[inner]
        f = np.zeros(len(sequences), dtype=np.int64)
        local = np.full(wide, -1, dtype=np.int64)
        for t in range(tries):
            some = np.flatnonzero(trie_of == t)
            if not len(some):
                continue
            one, two, three = of1 == t, of2 == t, of3 == t
            rows = sequences[some]
            numbers = np.unique(rows[rows >= 0])
            local[numbers] = np.arange(len(numbers))
            phrases = (local[a[one]], n1[one], local[left[two]], local[right[two]], n2[two], (np.cumsum(two) - 1)[inner[three]], local[third[three]], n3[three])
            f[some] = _trie_counts(np.where(rows >= 0, local[rows], -1), phrases)
        frequent = f >= least
        f1, f2, f3 = np.split(f, [len(words), len(words) + len(pairs)])
        longer = np.zeros(len(pairs), dtype=np.int64)
        held = triples[f3 >= least] // wide
        if len(held):
            longer[held[_edges(held)]] = np.maximum.reduceat(f3[f3 >= least], _edges(held))
        # a space before the words' bytes joins them
        data, start = np.r_[np.uint8(0x20), data], start + 1
        names = pa.array(list(self.langs), pa.string())
        at = 0
        for k, n, known in ((1, f1, None), (2, f2, longer), (3, f3, f2[triples // wide])):
            rows = np.flatnonzero(frequent[at : at + len(n)])
            for some in np.split(rows, range(CUT, len(rows), CUT)):
                if len(some):
                    word = sequences[at + some, :k]
                    known_of = None if known is None else known[some]
                    yield _named(names.take(pa.array(lang[word[:, 0]])), _phrase_texts(data, start, size, word), k, n[some], known_of)
            at += len(n)


_NAMED = "lang string, phrase string, n_words int, f bigint, pair bigint"


def _named(langs: pa.Array, phrases: pa.Array, k: int, f: np.ndarray, pair: np.ndarray | None = None) -> pa.RecordBatch:
    known = pa.nulls(len(f), pa.int64()) if pair is None else pa.array(pair, mask=pair == 0)
    return pa.record_batch([langs, phrases, pa.array(np.full(len(f), k, dtype=np.int32)), pa.array(f), known], names=["lang", "phrase", "n_words", "f", "pair"])


def _count_slices(least: int, block: int):
    """Dealt rows, sorted by slice, to what :meth:`_Slice.counted` gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, _Slice()
        for batch in batches:
            for s, langs, words, phrases, n in zip(*(batch.column(c) for c in ("slice", "langs", "words", "phrases", "n"))):
                if s.as_py() != current:
                    yield from held.counted(least, block)
                    current, held = s.as_py(), _Slice()
                langs = langs.as_py()
                if n.as_py() is None:
                    held.add(langs, *([x.as_buffer() for x in c.values] for c in (words, phrases)))
                else:
                    held.totals[langs[0]] = held.totals.get(langs[0], 0) + n.as_py()
        yield from held.counted(least, block)

    return run


def phrase_counts(docs: DataFrame, least: int = LEAST, bitmap: int = BITMAP, block: int = PHRASES, together: int = TOGETHER) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, n_words, f, pair) of every word and phrase of 2 or 3 words with f >= ``least`` (see :meth:`_Slice.counted`), and (lang, n)."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    shared: list = []
    for _ in range(2):
        frequent, seen = _bitmap(texts, shared, least, bitmap)
        shared.append(sc.broadcast(frequent))
    slices = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-seen // (block * together)))
    dealt = map_arrow(texts, _deal(shared, slices), _DEALT).repartition("slice").sortWithinPartitions("slice")
    named = stage(map_arrow(dealt, _count_slices(least, block), _NAMED), "colloc-named")
    for b in shared:
        b.destroy()
    return named.filter("n_words > 0"), named.filter("n_words = 0").select("lang", F.col("f").alias("n"))


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, inside: int = INSIDE, salts: int = SALTS, **kw) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases by their weakest cut."""
    counts, totals = phrase_counts(docs, least, **kw)
    phrase = lambda k: counts.filter(f"n_words = {k}").withColumnRenamed("f", "a")

    def look_up(rows: DataFrame, text: str, k: int, name: str) -> DataFrame:
        """``rows`` with the count of the ``k`` words ``text``; sorted by a hash, which is quicker than by texts."""
        known = counts.filter(f"n_words = {k}").select(F.xxhash64("lang", "phrase").alias("key"), "lang", F.col("phrase").alias("of"), F.col("f").alias(name))
        return rows.withColumns({"of": F.expr(text), "key": F.xxhash64("lang", F.expr(text))}).join(known, ["key", "lang", "of"]).drop("key", "of")

    rest = "substring_index(phrase, ' ', -2)"
    triples = look_up(phrase(3), rest, 2, "r1")
    # pairs inside of a longer phrase: known of triples that begin with the pair, joined of those that end with it
    ends = phrase(3).select("lang", F.expr(rest).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    ends = ends.select(F.xxhash64("lang", "phrase").alias("key"), "lang", "phrase", "longer")
    alone = lambda c: F.coalesce(100 * F.col(c) < inside * F.col("a"), F.lit(True))
    pairs = phrase(2).filter(alone("pair")).withColumn("key", F.xxhash64("lang", "phrase"))
    pairs = pairs.join(ends, ["key", "lang", "phrase"], "left").filter(alone("longer")).drop("key", "longer").withColumn("r1", F.lit(None).cast("long"))
    both = look_up(pairs.unionByName(triples), "substring_index(phrase, ' ', 1)", 1, "l1")
    both = look_up(both, "substring_index(phrase, ' ', -1)", 1, "last")
    wide = lambda c: f"cast({c} as decimal(15, 0))"
    score = lambda l, r: f"cast(cast(1000000 as decimal(7, 0)) * {wide('a')} * {wide('a')} as decimal(38, 0)) div cast({wide(l)} * {wide(r)} as decimal(38, 0))"  # noqa: E731, E741
    cut = lambda k, l, r: f"named_struct('score', {score(l, r)}, 'k', {k}, 'l', {l}, 'r', {r})"  # noqa: E731, E741
    both = both.withColumn("cut", F.expr(f"if(n_words = 2, {cut(1, 'l1', 'last')}, least({cut(1, 'l1', 'r1')}, {cut(2, 'pair', 'last')}))"))
    kept = both.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    best = (F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    part = W.partitionBy("lang", "salt").orderBy(*best)
    kept = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts))).withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= top)
    kept = kept.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*best)).cast("long")).filter(F.col("rank") <= top)
    return kept.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_trie_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = {
    "op11_trie_collocations": rf"""
WITH p AS (
  SELECT row_number() OVER () AS piece, lang,
         regexp_extract_all(s, '[^\x20\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang,
               unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS s
        FROM documents)
), totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang
), f AS (
  SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase, count(*) AS f
  FROM p, unnest([1, 2, 3]) AS t(size), unnest(range(1, len(w) - size + 2)) AS u(i) GROUP BY ALL
), c AS (SELECT * FROM f WHERE size > 1 AND f >= {LEAST}
), cuts AS (
  SELECT c.lang, c.phrase, c.f AS a, k, x.f AS l, y.f AS r, (1000000::HUGEINT * c.f * c.f) // (x.f::HUGEINT * y.f) AS score
  FROM (SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, size)) AS k FROM c) c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(w[:k], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(w[k + 1:], ' ')
), best AS (
  SELECT lang, phrase, a, l, r, score FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inner_pairs AS (
  SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, f
  FROM (SELECT *, string_split(phrase, ' ') AS w FROM c WHERE size = 3)
), kept AS (
  SELECT * FROM best b WHERE NOT EXISTS (
    SELECT 1 FROM inner_pairs i WHERE i.lang = b.lang AND i.phrase = b.phrase AND 100 * i.f >= {INSIDE} * b.a)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= {TOP}
"""
}
