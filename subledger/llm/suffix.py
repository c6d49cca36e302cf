"""Removal of repeated byte strings by a range-partitioned sparse suffix array.

Every byte that lies in a string of ``LENGTH`` bytes that also starts anywhere
else is removed.  Sorting all suffixes of the corpus would ship every byte as a
row.  Two sorts of far fewer suffixes give the same answer:

1. Each window of ``LENGTH`` bytes has one anchor, the start of its
   ``LENGTH / 2``-byte gram of least hash.  Equal windows have equal anchors, so
   suffixes that start at anchors (about one in 50 bytes) suffice to find where
   repeats can be.  Consecutive windows with one anchor form a segment of text.
   The first sort takes segments by (token of the anchor's gram, token of the
   segment).  Equal neighbours are segments repeated as a whole; a gram that
   occurs once cannot be in a repeat; other segments of a shared gram, in which
   a repeat may begin or end, go on.
2. The second sort takes every suffix that starts in those segments, cut to
   ``LENGTH`` bytes and held as two tokens (hashes of its halves).  Equal
   neighbours are repeats.

Both sorts work alike: Spark samples splitters and range-partitions the suffixes
by leading tokens (equal suffixes may be split further by place, so a string that
a third of all documents share is no hot key); each bucket is sorted locally by
multikey quicksort (order by the first token, then recursively inside runs of
equal tokens); buckets compare their first and last suffixes with those of other
buckets, two rows per bucket.

Tokens are 64-bit hashes; a repeat needs two equal ones (128 bits).

Defined results: null and empty texts have no bytes; documents under ``LENGTH``
bytes are kept whole; repeated rows count as documents that repeat each other;
an empty table gives an empty result; other input columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import mix, pieces, powers, prefix_hash
from .common import drop_staged, map_arrow, stage, table

LENGTH = 200
#: Bytes of text per bucket of the first sort, and suffixes per bucket of the second.
BUCKET_BYTES, BUCKET_ROWS = 24_000_000, 1_000_000

_SEGMENTS = "t0 bigint, t1 bigint, doc_id bigint, th bigint, s0 int, s1 int"
_FOUND = "doc_id bigint, th bigint, s0 int, s1 int, whole boolean"
_WINDOWS = "t0 bigint, t1 bigint, doc_id bigint, th bigint, s int"
_REPEATS = "t0 bigint, t1 bigint, n bigint, doc_id bigint, th bigint, s int"


def _gram_tokens(prefix: np.ndarray, size: int) -> np.ndarray:
    """Token of the ``size`` bytes from each position."""
    n = max(0, len(prefix) - size)
    return mix((prefix[size:] - prefix[:n]) * powers(len(prefix))[1][:n])


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    n = len(values) - width + 1
    pad = -len(values) % width
    v = np.concatenate([values, np.full(pad, np.iinfo(np.uint64).max)]).reshape(-1, width)
    ahead = np.minimum.accumulate(v, axis=1).ravel()
    back = np.minimum.accumulate(v[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def segments(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(row, first window, last window, gram token, segment token), positions inside ``data``."""
    half = length // 2
    none = np.zeros(0, dtype=np.int64)
    if len(data) < length:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    prefix = prefix_hash(data)
    grams = _gram_tokens(prefix, half)
    place = np.arange(len(grams), dtype=np.uint64)
    bits = np.uint64(max(1, int(len(grams)).bit_length()))
    # high bits of the gram's token, then its place: the leftmost of equal grams wins
    low = (np.uint64(1) << bits) - np.uint64(1)
    anchor = (_least((grams & ~low) | place, length - half + 1) & low).astype(np.int64)
    starts = np.arange(len(anchor))
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(anchor)]
    fits = starts + length <= offsets[1:][row]
    starts, row, anchor = starts[fits], row[fits], anchor[fits]
    if not len(starts):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    cut = np.flatnonzero((np.diff(anchor) != 0) | (np.diff(row) != 0)) + 1
    first, last = starts[np.r_[0, cut]], starts[np.r_[cut, len(starts)] - 1]
    begin, end = first, last + length
    whole = (prefix[end] - prefix[begin]) * powers(len(prefix))[1][begin] + (end - begin).astype(np.uint64)
    return row[np.r_[0, cut]], first, last, grams[anchor[np.r_[0, cut]]], mix(whole)


def _segment_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, th = batch.column(0), batch.column(1)
            for i, _, data, offsets in pieces(batch.column(2)):
                row, first, last, gram, whole = segments(data, offsets, length)
                if len(row):
                    at = pa.array(i + row)
                    yield pa.record_batch(
                        [
                            pa.array(gram.view(np.int64)),
                            pa.array(whole.view(np.int64)),
                            ids.take(at),
                            th.take(at),
                            pa.array((first - offsets[row]).astype(np.int32)),
                            pa.array((last - offsets[row]).astype(np.int32)),
                        ],
                        names=["t0", "t1", "doc_id", "th", "s0", "s1"],
                    )

    return run


def multikey_order(keys: list[np.ndarray]) -> np.ndarray:
    """Order of rows by their tokens: by the first, then inside each run of equal ones by the next."""
    order = np.argsort(keys[0], kind="stable")
    if len(keys) > 1 and len(order):
        k = keys[0][order]
        same = np.r_[False, k[1:] == k[:-1]]
        tied = same | np.r_[same[1:], False]
        at = np.flatnonzero(tied)
        if len(at):
            # runs keep their places: number them, and order the tied rows by (run, next tokens)
            run = np.cumsum(~same)[at]
            inner = multikey_order([x[order[at]] for x in keys[1:]])
            order[at] = order[at][inner][np.argsort(run[inner], kind="stable")]
    return order


def _bucket(batches: Iterator[pa.RecordBatch]) -> tuple[pa.Table | None, list[np.ndarray]]:
    """A whole bucket in the order of its suffixes, with its two token columns."""
    got = list(batches)
    if not sum(b.num_rows for b in got):
        return None, []
    t = pa.Table.from_batches(got).combine_chunks()
    keys = [t.column(c).to_numpy() for c in ("t0", "t1")]
    order = multikey_order(keys)
    return t.take(pa.array(order)), [k[order] for k in keys]


def _runs(k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first row of each run of equal values, run of each row)."""
    new = np.r_[True, k[1:] != k[:-1]]
    return np.flatnonzero(new), np.cumsum(new) - 1


def _first_sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments repeated whole, and one of each other segment whose gram is shared or at a bucket's edge."""
    t, keys = _bucket(batches)
    if t is None:
        return
    k0, k1 = keys
    at0, run0 = _runs(k0)
    new = np.r_[True, (k0[1:] != k0[:-1]) | (k1[1:] != k1[:-1])]
    at1, run1 = np.flatnonzero(new), np.cumsum(new) - 1
    n1 = np.diff(np.r_[at1, len(k0)])
    kinds = np.bincount(run0[at1], minlength=len(at0))
    # the first and last gram may go on in the next bucket: their segments are settled by the second sort
    kinds[[0, -1]] = 2
    whole = n1[run1] > 1
    open_ = new & (kinds[run0] > 1)
    for mask, flag in ((whole, True), (open_, False)):
        rows = t.filter(pa.array(mask)).select(["doc_id", "th", "s0", "s1"])
        rows = rows.append_column("whole", pa.array(np.full(rows.num_rows, flag)))
        yield from rows.to_batches(max_chunksize=100_000)


def _second_sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated suffixes (n = 0: settled here), and the bucket's first and last with their number."""
    t, keys = _bucket(batches)
    if t is None:
        return
    k0, k1 = keys
    new = np.r_[True, (k0[1:] != k0[:-1]) | (k1[1:] != k1[:-1])]
    at, run = np.flatnonzero(new), np.cumsum(new) - 1
    n = np.diff(np.r_[at, len(k0)])
    rows = t.filter(pa.array(n[run] > 1)).append_column("n", pa.array(np.zeros(int((n[run] > 1).sum()), dtype=np.int64)))
    edge = np.unique(at[[0, -1]])
    edges = t.take(pa.array(edge)).append_column("n", pa.array(n[run[edge]].astype(np.int64)))
    for part in (rows, edges):
        yield from part.select(["t0", "t1", "n", "doc_id", "th", "s"]).to_batches(max_chunksize=100_000)


def _windows(length: int):
    """Suffixes of open segments as two tokens; columns: doc_id, th, text, segments."""
    half = length // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            for i, j, data, offsets in pieces(batch.column(2)):
                prefix = prefix_hash(data)
                tokens = _gram_tokens(prefix, half)
                rows, starts = [], []
                for r in range(i, j):
                    part = lists[r].values
                    if part is None or not len(part):
                        continue
                    open_ = ~part.field("whole").to_numpy(zero_copy_only=False)
                    s0, s1 = (part.field(c).to_numpy()[open_].astype(np.int64) for c in ("s0", "s1"))
                    if len(s0):
                        size = s1 - s0 + 1
                        s = np.repeat(s0 - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
                        rows.append(np.full(len(s), r))
                        starts.append(s + offsets[r - i])
                if rows:
                    at, s = pa.array(np.concatenate(rows)), np.concatenate(starts)
                    local = s - offsets[np.concatenate(rows) - i]
                    yield pa.record_batch(
                        [
                            pa.array(tokens[s].view(np.int64)),
                            pa.array(tokens[s + half].view(np.int64)),
                            batch.column(0).take(at),
                            batch.column(1).take(at),
                            pa.array(local.astype(np.int32)),
                        ],
                        names=["t0", "t1", "doc_id", "th", "s"],
                    )

    return run


_CUT = "doc_id bigint, th bigint, n_removed bigint, n_spans bigint, kept string, kept_sha256 string"


def _remove(length: int, with_text: bool):
    """Cut the repeated ranges; columns: doc_id, th, text, segments, starts of repeated suffixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, j, data, offsets in pieces(batch.column(2)):
                for r in range(i, j):
                    raw = data[offsets[r - i] : offsets[r - i + 1]]
                    edge = np.zeros(len(raw) + 1, dtype=np.int32)
                    part = batch.column(3)[r].values
                    if part is not None and len(part):
                        whole = part.field("whole").to_numpy(zero_copy_only=False)
                        np.add.at(edge, part.field("s0").to_numpy()[whole], 1)
                        np.add.at(edge, part.field("s1").to_numpy()[whole] + length, -1)
                    part = batch.column(4)[r].values
                    if part is not None and len(part):
                        s = part.to_numpy()
                        np.add.at(edge, s, 1)
                        np.add.at(edge, s + length, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    kept = raw[~gone].tobytes()
                    spans = int(np.count_nonzero(gone & ~np.r_[False, gone[:-1]])) if len(gone) else 0
                    # a cut may split a code point, so kept text is shown with replacement characters
                    out.append((int(gone.sum()), spans, kept.decode(errors="replace") if with_text else None, hashlib.sha256(kept).hexdigest()))
            n, spans, text, sha = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(spans, pa.int64()), pa.array(text, pa.string()), pa.array(sha, pa.string())],
                names=["doc_id", "th", "n_removed", "n_spans", "kept", "kept_sha256"],
            )

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and the kept text)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("th", F.xxhash64("text"))
    d = d.select("doc_id", "th", "text")
    slim = stage(d.select("doc_id", "th", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha")), "suffix-docs")
    total = slim.agg(F.sum("n_bytes")).first()[0] or 0

    place = F.xxhash64("doc_id", "s0")
    anchored = map_arrow(d, _segment_rows(length), _SEGMENTS)
    anchored = anchored.repartitionByRange(max(8, total // BUCKET_BYTES), F.col("t0"), F.col("t1"), place)
    found = stage(map_arrow(anchored, _first_sort, _FOUND), "suffix-found")
    per = found.groupBy("doc_id", "th").agg(F.collect_list(F.struct("s0", "s1", "whole")).alias("segments"))
    per = per.withColumnRenamed("doc_id", "_d").withColumnRenamed("th", "_t")
    here = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t"))
    touched = stage(d.join(per.hint("shuffle_hash"), here).select("doc_id", "th", "text", "segments"), "suffix-touched")

    n = found.filter("not whole").agg(F.sum(F.col("s1") - F.col("s0") + 1)).first()[0] or 0
    suffixes = map_arrow(touched, _windows(length), _WINDOWS)
    suffixes = suffixes.repartitionByRange(max(8, n // BUCKET_ROWS), F.col("t0"), F.col("t1"), F.xxhash64("doc_id", "s"))
    sorted_ = stage(map_arrow(suffixes, _second_sort, _REPEATS), "suffix-repeats")
    # edges: at most two rows a bucket
    edges = sorted_.filter("n > 0")
    met = edges.groupBy("t0", "t1").agg(F.sum("n").alias("all")).filter("all > 1")
    repeats = sorted_.filter("n = 0").select("doc_id", "th", "s").unionByName(edges.join(met, ["t0", "t1"]).select("doc_id", "th", "s"))
    starts = repeats.groupBy("doc_id", "th").agg(F.collect_set("s").alias("starts"))
    starts = starts.withColumnRenamed("doc_id", "_d").withColumnRenamed("th", "_t")
    both = touched.join(starts.hint("shuffle_hash"), here, "left").select("doc_id", "th", "text", "segments", "starts")
    cut = stage(map_arrow(both, _remove(length, with_text), _CUT), "suffix-cut")
    drop_staged(touched)
    cut = cut.filter("n_removed > 0").dropDuplicates(["doc_id", "th"]).withColumnRenamed("doc_id", "_d").withColumnRenamed("th", "_t")
    out = slim.join(cut, here, "left").select(
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"),
        *(["kept"] if with_text else []),
    )
    return out


def op7_sparse_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
