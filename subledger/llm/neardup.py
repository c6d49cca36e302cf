"""Near-duplicate documents by bottom-k sketches.

1. One hash function maps every 5-word shingle to a 64-bit value.  A document's
   sketch is its ``k`` smallest distinct values.  Documents of equal shingle sets
   collapse into one node first (a partial aggregation on the set's digest), so
   a group of thousands of copies costs one sketch.
2. Inverted lists of retained values generate overlaps.  Two documents at the
   threshold share at least ``need`` of their ``k`` values but for a chance under
   1e-7, so it is enough to list, per document, its ``k - need + 1`` values that
   are rarest over the corpus: sharing ``need`` values, they must meet in one of
   those.  A value held by one document has no list but uses up a place, so most
   documents without a near copy enter no list, and a passage that very many
   documents share is listed only for documents that consist of little else.
3. Lists are split by size class (a linked pair shares one).  Each is compared with
   a hub: (hub, member) pairs are linear in the list.  The union sketch estimates
   the similarity of a pair; pairs that may reach the threshold are verified by
   exact Jaccard on the full sets, and links merge components.
4. Members of one hub that are still in different components are described by
   their difference D from the hub's set.  |A xor B| = |D(A) xor D(B)|, so a linked
   pair whose members are not both linked to the hub must share a known number of
   elements of D.  Lists of the rarest elements of D, cut by that number and by
   position, hold such pairs.  The bound splits into one number a row (``over``:
   the element's place less the member's share of the allowed difference): a
   linked pair that first meets in a list has a sum of at most 0 there.  A row
   that not even the list's least row can meet leaves the list before any join,
   so a group of variants of one text, each with more edits of its own than a
   link allows, has empty lists, whatever its size.  The rows left meet the
   list's least row first, and the last round compares every pair across
   components that the bound allows, so no link between components is lost.
   Members of one component are never compared.

Set elements are 64-bit hashes of shingles; the verification compares them as
whole sets.

Defined results: null and empty texts have no shingles and are linked with
nothing; rows of one id are one node; a null id is linked with nothing and kept;
an empty table gives an empty result; other input columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytetext import mix, shingle_sets
from .common import drop_staged, map_arrow, stage, table
from .components import components

K, WIDTH, PERCENT = 64, 5, 85
#: Chance that a pair at the threshold shares fewer retained values than the search asks for.
MISS = 1e-7
HUB_ROUNDS = 1

_SKETCH = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("set_key", pa.binary()), ("sketch", pa.list_(pa.int64()))])
_SETS = pa.schema([("node", pa.int64()), ("items", pa.list_(pa.int64()))])


def _sketches(width: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ns, keys, sketches = [], [], []
            for s in shingle_sets(batch.column(1), width):
                u = s.view(np.uint64)
                # an order-free 128-bit digest of the set
                ends = np.array([mix(u).sum(dtype=np.uint64), mix(u ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)])
                ns.append(len(s))
                keys.append(ends.tobytes() + len(s).to_bytes(6, "big"))
                sketches.append(s[:k])
            flat = np.concatenate(sketches) if sketches else np.zeros(0, dtype=np.int64)
            offsets = np.cumsum([0, *map(len, sketches)]).astype(np.int32)
            yield pa.record_batch(
                [batch.column(0), pa.array(ns, pa.int64()), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                schema=_SKETCH,
            )

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = list(shingle_sets(part.column(1), width))
                offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                yield pa.record_batch([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets)))], schema=_SETS)

    return run


def _sql(schema: pa.Schema) -> str:
    kind = {"int64": "bigint", "binary": "binary", "list<item: int64>": "array<bigint>"}
    return ", ".join(f"{f.name} {kind[str(f.type)]}" for f in schema)


def sure_share(k: int, percent: int) -> float:
    """Share of a sketch that two documents at the threshold have in common but for a chance under ``MISS``.

    The number in common among ``k`` values is binomial with the similarity as its rate.
    """
    t, below, at = percent / 100, 0.0, 0
    while at < k:
        below += math.comb(k, at) * t**at * (1 - t) ** (k - at)
        if below >= MISS:
            break
        at += 1
    return at / k


def _need(m: Column, sure: float) -> Column:
    return F.greatest(F.lit(1), F.floor(m * F.lit(sure)).cast("int"))


def _lists(nodes: DataFrame, sure: float) -> DataFrame:
    """(value, node, n): for each node the rarest values of its sketch that must hold a shared one."""
    postings = nodes.select("node", "n", F.size("sketch").alias("m"), F.explode("sketch").alias("value"))
    shared = postings.groupBy("value").agg(F.count("*").alias("df")).filter("df > 1")
    mine = postings.join(shared, "value").groupBy("node", "n", "m").agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("s"))
    # values of one document come first in the order and use up places
    places = F.col("m") - _need(F.col("m"), sure) + 1 - (F.col("m") - F.size("s"))
    listed = F.slice("s", F.lit(1), F.greatest(F.lit(0), places))
    return mine.select("node", "n", F.explode(listed).alias("s")).select(F.col("s.value").alias("value"), "node", "n")


class _Verifier:
    """Verifies pairs, each once, and keeps the components of all links found."""

    def __init__(self, nodes: DataFrame, sets: DataFrame, k: int, sure: float, percent: int):
        self.nodes, self.sets, self.k, self.sure, self.percent = nodes, sets, k, sure, percent
        self.links = self.checked = None
        self.components = nodes.sparkSession.createDataFrame([], "node bigint, component bigint")

    def add(self, pairs: DataFrame) -> DataFrame:
        """(node, component) of the nodes linked so far, after verifying ``pairs`` (a, b)."""
        pairs = pairs.distinct()
        if self.checked is not None:
            pairs = pairs.join(self.checked, ["a", "b"], "left_anti")
        pairs = stage(pairs, "neardup-pairs")
        if pairs.isEmpty():
            return self.components
        self.checked = pairs if self.checked is None else self.checked.unionByName(pairs)
        found = stage(self._linked(pairs), "neardup-links")
        self.links = found if self.links is None else self.links.unionByName(found)
        self.components = stage(components(self.links), "neardup-components")
        return self.components

    def _linked(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose exact similarity reaches the threshold."""
        side = lambda df, c, x, y: df.select(F.col("node").alias(x), F.col(c).alias(y))
        est = pairs.join(side(self.nodes, "sketch", "a", "sa"), "a").join(side(self.nodes, "sketch", "b", "sb"), "b")
        union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, self.k)
        common = F.size(F.array_intersect(union, F.array_intersect("sa", "sb")))
        # no aggregation follows the joins in their stage, so a hub with very many pairs can be split
        est = est.filter(common >= F.size(union) * F.lit(self.sure)).select("a", "b")
        full = est.join(side(self.sets, "items", "a", "xa"), "a").join(side(self.sets, "items", "b", "xb"), "b")
        inter = F.size(F.array_intersect("xa", "xb"))
        return full.filter(100 * inter >= self.percent * (F.size("xa") + F.size("xb") - inter)).select("a", "b")


def _classes(n: Column, percent: int) -> Column:
    """The two size classes of a set: sizes within the threshold's ratio share one."""
    k = F.floor(F.ln(n) / F.lit(-math.log((percent - 0.5) / 100))).cast("int")
    return F.array(k, k + 1)


def _close(n1: str, n2: str, percent: int) -> Column:
    """Sizes between which the threshold can be met at all."""
    return 100 * F.least(n1, n2) >= percent * F.greatest(n1, n2)


def link_documents(docs: DataFrame, k: int = K, width: int = WIDTH, percent: int = PERCENT, rounds: int = HUB_ROUNDS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    sure = sure_share(k, percent)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketched = stage(map_arrow(text, _sketches(width, k), _sql(_SKETCH)), "neardup-sketches")
    real = sketched.filter("n > 0 and doc_id is not null")
    groups = stage(real.groupBy("set_key").agg(F.min("doc_id").alias("node")), "neardup-groups")
    # one document of each group of equal sets carries the sketch
    g = groups.select(F.col("set_key").alias("_k"), "node")
    first = real.join(g, (F.col("doc_id") == F.col("node")) & (F.col("set_key") == F.col("_k")))
    nodes = stage(first.select("node", "n", "sketch").dropDuplicates(["node", "sketch"]), "neardup-nodes")
    lists = stage(_lists(nodes, sure), "neardup-lists")
    lists = lists.join(lists.groupBy("value").agg(F.count("*").alias("c")).filter("c > 1").drop("c"), "value", "left_semi")

    wanted = stage(lists.select("node").distinct(), "neardup-wanted")
    cand = text.join(wanted.hint("shuffle_hash"), F.col("doc_id") == F.col("node"), "left_semi")
    sets = stage(map_arrow(cand, _sets(width), _sql(_SETS)).dropDuplicates(["node", "items"]), "neardup-sets")
    slim = stage(nodes.join(wanted, "node", "left_semi"), "neardup-listed")

    verify = _Verifier(slim, sets, k, sure, percent)
    classed = lists.withColumn("class", F.explode(_classes(F.col("n"), percent)))
    hubs = classed.groupBy("value", "class").agg(F.min(F.struct(F.xxhash64("node").alias("o"), F.col("node").alias("hub"), F.col("n").alias("hub_n"))).alias("h"))
    members = classed.join(hubs, ["value", "class"]).select("h.hub", "h.hub_n", "node", "n").filter("hub <> node").distinct()
    members = stage(members, "neardup-members")
    near = members.filter(_close("n", "hub_n", percent))
    comp = verify.add(near.select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")))

    listed = stage(_difference_lists(members, sets, comp, percent), "neardup-differences")
    for r in range(rounds + 1):
        now = _labelled(listed, comp)
        per = now.groupBy("hub", "value").agg(
            F.min(F.struct("over", F.xxhash64("node").alias("o"), *_MEMBER)).alias("x"), F.min("comp").alias("lo"), F.max("comp").alias("hi")
        )
        open_ = stage(now.join(per.filter("lo <> hi"), ["hub", "value"]).select("hub", "value", *_MEMBER, "over", "x"), "neardup-open")
        if open_.isEmpty():
            break
        if r < rounds:
            pairs = open_.filter(_may_link("x.", "", percent)).select("node", F.col("x.node").alias("other"))
        else:
            pairs = _across(open_, percent)
        comp = verify.add(pairs.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")))
        drop_staged(open_)
    out = _labelled(sketched.join(groups, "set_key", "left"), comp)
    component = F.when(F.col("n") > 0, F.col("comp")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def _labelled(rows: DataFrame, comp: DataFrame) -> DataFrame:
    return rows.join(comp, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")


#: What a difference list holds of a member: its set's size, its difference's size, the element's place in it, its component.
_MEMBER = ("node", "n", "d", "at", "comp")


def _difference_lists(members: DataFrame, sets: DataFrame, comp: DataFrame, percent: int) -> DataFrame:
    """(hub, value, node, n, d, at, over): the rarest elements in which members of a hub differ from it.

    Only hubs whose members are in several components are looked at.  Elements
    that one member has alone come first in the order; they need no list but
    count as places.
    """
    m = _labelled(members, comp)
    open_ = m.groupBy("hub").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("hub")
    m = m.join(open_, "hub").select("hub", "node", "n")
    own = sets.select("node", F.col("items").alias("x"))
    base = sets.select(F.col("node").alias("hub"), F.col("items").alias("y"))
    diff = m.join(own, "node").join(base, "hub").select("hub", "node", "n", F.concat(F.array_except("x", "y"), F.array_except("y", "x")).alias("diff"))
    diff = stage(diff.withColumn("d", F.size("diff")), "neardup-diff")
    rows = diff.select("hub", "node", "n", "d", F.explode("diff").alias("value"))
    shared = rows.groupBy("hub", "value").agg(F.count("*").alias("df")).filter("df > 1")
    mine = rows.join(shared, ["hub", "value"]).groupBy("hub", "node", "n", "d").agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("s"))
    # a linked pair shares at least d - (100 - percent) / percent * n elements of D
    places = F.least(F.col("d"), F.floor(F.col("n") * F.lit((100 - percent) / percent + 1e-9)).cast("int") + 1)
    alone = F.col("d") - F.size("s")
    listed = mine.withColumn("alone", alone).select("hub", "node", "n", "d", "alone", F.posexplode(F.slice("s", F.lit(1), F.greatest(F.lit(0), places - alone))))
    listed = listed.select("hub", F.col("col.value").alias("value"), "node", "n", "d", (F.col("alone") + F.col("pos")).alias("at"))
    listed = listed.withColumn("over", F.col("at") - F.col("n") * F.lit(_allowed(percent)))
    # rows that not even the least one of their list can meet; a list is joined with one row of its own
    least = listed.groupBy("hub", "value").agg(F.min("over").alias("least")).filter("least <= 1e-6")
    return listed.join(least, ["hub", "value"]).filter("over + least <= 1e-6").drop("least")


def _allowed(percent: int) -> float:
    """Elements in which two linked sets may differ, as a share of the sum of their sizes."""
    return (100 - percent) / (100 + percent)


def _may_link(x: str, y: str, percent: int) -> Column:
    """Whether two members of different components can be linked, if this is the first element that they share."""
    nx, ny, dx, dy = F.col(f"{x}n"), F.col(f"{y}n"), F.col(f"{x}d"), F.col(f"{y}d")
    common = (dx + dy - (nx + ny) * F.lit(_allowed(percent))) / 2
    left = F.least(dx - F.col(f"{x}at"), dy - F.col(f"{y}at"))
    return (F.col(f"{x}comp") != F.col(f"{y}comp")) & _close(f"{x}n", f"{y}n", percent) & (left >= common - F.lit(1e-6))


def _across(open_: DataFrame, percent: int) -> DataFrame:
    """All pairs of one list that may be linked: members outside the list's largest component, against all.

    ``over`` of one of the two is at most 0, so members above meet only those that are not.
    """
    size = open_.groupBy("hub", "value", "comp").agg(F.count("*").alias("c"))
    main = size.groupBy("hub", "value").agg(F.max(F.struct("c", "comp"))["comp"].alias("main"))
    few = open_.join(main, ["hub", "value"]).filter("comp <> main")
    low = F.col("over") <= F.lit(1e-6)

    def met(a: DataFrame, b: DataFrame) -> DataFrame:
        pairs = a.select("hub", "value", F.struct(*_MEMBER).alias("x")).join(b.select("hub", "value", *_MEMBER), ["hub", "value"])
        return pairs.filter(_may_link("x.", "", percent)).select("node", F.col("x.node").alias("other"))

    return met(few.filter(low), open_).unionByName(met(few.filter(~low), open_.filter(low)))


def op1_bottomk_neardup(spark, sf_dir: str) -> DataFrame:
    return link_documents(table(spark, sf_dir, "documents"))
