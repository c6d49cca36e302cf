"""Merkle manifest of a table, with one inclusion proof per row.

A leaf is the SHA-256 of a row's fields.  Leaves of a group (a language) ascend
by key; every two consecutive nodes, or a last single one, become the SHA-256 of
their hex digests until one is left, the group's root.  Group roots, ordered by
group, form a tree of the same kind above them.

Leaves are range-partitioned by (group, key) and cut into parts of at most
``PART`` leaves that lie side by side in the tree.  Each part is then proven as
an octopus multiproof:

1. A part folds its leaves into the largest subtrees that lie inside it and
   writes their roots.  Subtrees across parts are folded from those, ``BITS``
   levels a round, in groups of neighbours (:func:`_fold`).  These are all
   nodes that any part can lack.
2. From its first and last position alone a part knows which siblings its
   leaves' paths lack that its own leaves do not give, at most two a level
   (:func:`_lacking`).  One join fetches those of all parts.
3. The part derives the shared interior once and cuts every leaf's proof from
   it (:func:`_expand`).

No step holds more than a part, or the 2^BITS nodes of one round, in a task;
a group may hold any share of the rows.  The window that numbers the parts of a
group has one row per part.

Defined results: a null field is hashed as ``-``; null keys and null groups sort
first and are leaves like others; rows with equal keys ascend by leaf digest, so
repeated rows have equal digests and each its own position; a text of any
length is hashed whole, in one row; an empty table has no leaves, no root and an
empty result; columns other than the named fields are ignored, whatever their
names.  A null key is never tampered with by the query.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .common import map_arrow, stage, table

#: Leaves of a part, and levels folded in one round.
PART, BITS = 1 << 16, 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPERED_EVERY = 7
#: Rows of one output batch of proofs.
ROWS = 4096

_NODE = pa.schema([("grp", pa.string()), ("level", pa.int32()), ("idx", pa.int64()), ("hash", pa.string()), ("n", pa.int64())])
_NODE_SQL = "grp string, level int, idx bigint, hash string, n bigint"
_STEP = pa.struct([("left", pa.bool_()), ("hash", pa.string())])
PROOF_SQL = "array<struct<left:boolean,hash:string>>"


def field_digest(*fields: Column) -> Column:
    """SHA-256 (hex) of the fields, each ``-`` or its byte count, a colon and its text."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t), F.lit(":"), t)) for t in texts]), 256)


def _hash(*nodes: str) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def _parents(level: list[str]) -> list[str]:
    """Parents of a run of nodes that begins at an even position and ends with a pair or the tree's last node."""
    return [_hash(*level[i : i + 2]) for i in range(0, len(level), 2)]


def _number(per_part: int):
    """Add ``part`` and the position within (part, group) to rows sorted by group and key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen, group, at = TaskContext.get().partitionId(), 0, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            grp = batch.column("grp")
            rows = np.arange(seen, seen + batch.num_rows)
            new = rows % per_part == 0
            new[1:] |= pc.not_equal(grp.slice(1), grp.slice(0, len(grp) - 1)).to_numpy(zero_copy_only=False)
            new[0] |= grp[0].as_py() != group
            first = np.maximum.accumulate(np.where(new, rows, at))
            yield pa.record_batch([*batch.columns, pa.array((task << 32) + rows // per_part), pa.array(rows - first)], names=[*batch.schema.names, "part", "local"])
            seen, group, at = seen + batch.num_rows, grp[-1].as_py(), int(first[-1])

    return run


def _runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """The consecutive rows of equal keys, as one table each."""
    held: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, dtype=bool)
        for k in keys:
            c = batch.column(k)
            new[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
        edges = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            name = tuple(batch.column(k)[a].as_py() for k in keys)
            if held and name != current:
                yield pa.Table.from_batches(held)
                held = []
            current = name
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _cover(bits: int):
    """Roots of the largest subtrees, up to level ``bits``, inside each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, ("part", "grp")):
            grp, n, lo = (rows.column(c)[0].as_py() for c in ("grp", "n", "first"))
            nodes, out, level, count = rows.column("hash").slice(1).to_pylist(), [], 0, n
            while nodes:
                if level == bits or count == 1:
                    out += [(level, lo + i, h) for i, h in enumerate(nodes)]
                    break
                if lo % 2:
                    out.append((level, lo, nodes.pop(0)))
                    lo += 1
                if (lo + len(nodes)) % 2 and lo + len(nodes) < count:
                    out.append((level, lo + len(nodes) - 1, nodes.pop()))
                nodes, lo, level, count = _parents(nodes), lo // 2, level + 1, (count + 1) // 2
            yield _node_batch(grp, n, out)

    return run


def _node_batch(grp: str, n: int, nodes: list[tuple[int, int, str]]) -> pa.RecordBatch:
    levels, at, hashes = zip(*nodes) if nodes else ((), (), ())
    m = len(nodes)
    return pa.record_batch([pa.array([grp] * m, pa.string()), pa.array(levels, pa.int32()), pa.array(at, pa.int64()), pa.array(hashes, pa.string()), pa.array([n] * m, pa.int64())], schema=_NODE)


def _fold(base: int, bits: int):
    """Fold the nodes of each subtree of ``bits`` levels above ``base``; returns the nodes it adds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, ("grp", "chunk")):
            grp, n = rows.column("grp")[0].as_py(), rows.column("n")[0].as_py()
            given: dict[int, dict[int, str]] = {}
            for level, i, h in zip(*(rows.column(c).to_pylist() for c in ("level", "idx", "hash"))):
                given.setdefault(level, {})[i] = h
            out, nodes = [], {}
            for level in range(base, base + bits):
                nodes |= given.get(level, {})
                if ((n - 1) >> level) == 0:
                    break
                pairs: dict[int, list[str]] = {}
                for i in sorted(nodes):
                    pairs.setdefault(i >> 1, []).append(nodes[i])
                nodes = {i: _hash(*p) for i, p in pairs.items()}
                out += [(level + 1, i, h) for i, h in nodes.items()]
            yield _node_batch(grp, n, out)

    return run


def _lacking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(group, part, level, idx) of the siblings that a part's paths need and its leaves do not give."""
    for batch in batches:
        out: list[tuple] = []
        for grp, part, lo, size, n in zip(*(batch.column(c).to_pylist() for c in ("grp", "part", "first", "size", "n"))):
            hi, level, count = lo + size, 0, n
            while count > 1:
                if lo % 2:
                    out.append((grp, part, level, lo - 1))
                if hi % 2 and hi < count:
                    out.append((grp, part, level, hi))
                lo, hi, level, count = lo // 2, (hi + 1) // 2, level + 1, (count + 1) // 2
        cols = zip(*out) if out else ((), (), (), ())
        yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int32(), pa.int64()))], names=["grp", "part", "level", "idx"])


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Proofs of every leaf of a part from its leaves and the nodes fetched for it (in its first row)."""
    for rows in _runs(batches, ("part", "grp")):
        head = rows.slice(0, 1).to_pylist()[0]
        fetched = {(x["level"], x["idx"]): x["hash"] for x in head["fetched"] or []}
        rows = rows.slice(1)
        lo, count = head["first"], head["n"]
        level: list[str] = rows.column("hash").to_pylist()
        pool: list[str] = []
        levels: list[tuple[int, int, int]] = []  # (first node held, its place in the pool, nodes of the level)
        while count > 1:
            if lo % 2:
                level.insert(0, fetched[len(levels), lo - 1])
                lo -= 1
            if (lo + len(level)) % 2 and lo + len(level) < count:
                level.append(fetched[len(levels), lo + len(level)])
            levels.append((lo, len(pool), count))
            pool += level
            level, lo, count = _parents(level), lo // 2, (count + 1) // 2
        above = head["above"] or []
        top = len(pool)
        nodes = pa.array([*pool, *(x["hash"] for x in above)], pa.string())
        at = head["first"] + np.arange(rows.num_rows)
        for a in range(0, rows.num_rows, ROWS):
            pos = at[a : a + ROWS]
            place = np.empty((len(pos), len(levels) + len(above)), dtype=np.int64)
            left = np.zeros(place.shape, dtype=bool)
            for k, (first, start, size) in enumerate(levels):
                node = pos >> k
                place[:, k] = np.where(node ^ 1 < size, start + (node ^ 1) - first, -1)
                left[:, k] = node & 1
            for k, x in enumerate(above):
                place[:, len(levels) + k] = top + k
                left[:, len(levels) + k] = x["left"]
            flat = place.ravel()
            steps = pa.StructArray.from_arrays([pa.array(left.ravel()), nodes.take(pa.array(flat, mask=flat < 0))], fields=list(_STEP))
            proofs = pa.ListArray.from_arrays(pa.array(np.arange(len(pos) + 1) * place.shape[1], pa.int32()), steps)
            same = lambda v: pa.array([v] * len(pos), pa.string())
            part = rows.slice(a, len(pos)).combine_chunks()
            row = part.column("row").chunk(0)
            yield pa.record_batch([row, part.column("hash").chunk(0), pa.array(pos), same(level[0]), same(head["root"] or level[0]), proofs], names=["row", "leaf", "position", "subroot", "root", "proof"])


def _by_part(heads: DataFrame, leaves: DataFrame) -> DataFrame:
    """Rows of each (part, group) side by side: its head, then its leaves in order."""
    both = heads.unionByName(leaves, allowMissingColumns=True)
    return both.repartition("part").sortWithinPartitions("part", "grp", F.col("local").asc_nulls_first())


def prove(leaves: DataFrame, order: list[str], above: Callable[[DataFrame], DataFrame] | None = None, per_part: int = PART, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """(proofs, group roots) of ``leaves``: columns grp (never null), hash, row (a struct) and ``order``.

    Proofs: row, leaf, position, subroot, root, proof, where a proof's steps lead from the leaf to the
    root; a step without hash is a node that is alone.  Group roots: grp, hash.  ``above`` makes
    (grp, root, above) from them: the steps from a group root upwards.
    """
    spark = leaves.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slim = leaves.select("grp", "hash", "row", *[c for c in order if c != "hash"])
    ranged = slim.repartitionByRange(tasks, "grp", *order).sortWithinPartitions("grp", *order)
    numbered = T.StructType([*slim.schema.fields, T.StructField("part", T.LongType()), T.StructField("local", T.LongType())])
    rows = stage(map_arrow(ranged, _number(per_part), numbered), "merkle-leaves").select("part", "grp", "local", "hash", "row")
    whole = W.partitionBy("grp")
    sizes = rows.groupBy("grp", "part").agg(F.count(F.lit(1)).alias("size"))
    before = F.coalesce(F.sum("size").over(whole.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = stage(sizes.select("*", before.alias("first"), F.sum("size").over(whole).alias("n")), "merkle-parts")

    heads = parts.select("part", "grp", "first", "n")
    nodes = stage(map_arrow(_by_part(heads, rows.drop("row")).select("part", "grp", "first", "n", "hash"), _cover(bits), _NODE_SQL), "merkle-nodes")
    last, base, given = (parts.agg(F.max("n")).first()[0] or 1) - 1, 0, nodes
    while last >> base:
        chunk = F.expr(f"shiftright(idx, {base + bits} - level)").alias("chunk")
        near = given.select("grp", chunk, "level", "idx", "hash", "n").repartition("grp", "chunk").sortWithinPartitions("grp", "chunk")
        nodes = nodes.unionByName(stage(map_arrow(near, _fold(base, bits), _NODE_SQL), "merkle-nodes"))
        base += bits
        given = nodes.filter(F.col("level") == base)

    roots = nodes.filter(F.expr("idx = 0 AND shiftright(n - 1, level) = 0 AND (level = 0 OR shiftright(n - 1, level - 1) > 0)")).select("grp", "hash")
    lacking = map_arrow(parts, _lacking, "grp string, part bigint, level int, idx bigint")
    fetched = lacking.join(nodes.drop("n"), ["grp", "level", "idx"]).groupBy("grp", "part").agg(F.collect_list(F.struct("level", "idx", "hash")).alias("fetched"))
    heads = heads.join(fetched, ["grp", "part"], "left")
    if above is None:
        heads = heads.withColumns({"root": F.lit(None).cast("string"), "above": F.lit(None).cast(PROOF_SQL)})
    else:
        heads = heads.join(above(roots), "grp", "left")
    heads = stage(heads, "merkle-heads")
    schema = T.StructType([T.StructField("row", slim.schema["row"].dataType), *T._parse_datatype_string(f"leaf string, position bigint, subroot string, root string, proof {PROOF_SQL}").fields])
    both = _by_part(heads, rows).select("part", "grp", "first", "n", "fetched", "root", "above", "hash", "row")
    return map_arrow(both, _expand, schema), roots


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "lang", key: str = "doc_id", extra: dict[str, Column] | None = None, per_part: int = PART, bits: int = BITS) -> DataFrame:
    """One row per document: row (its key and the ``extra`` columns), leaf, position, subroot, root, proof."""
    leaves = docs.select(
        # null first, then by bytes
        F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit("")).alias("grp"),
        F.struct(F.col(f"`{key}`").alias("key"), *[c.alias(name) for name, c in (extra or {}).items()]).alias("row"),
        field_digest(*[F.col(f"`{f}`") for f in fields]).alias("hash"),
    )
    # the number makes repeated rows divisible; which of them comes first cannot show
    leaves = stage(leaves, "merkle-digests").select("*", F.col("row.key").alias("key"), F.monotonically_increasing_id().alias("n"))

    def upper(roots: DataFrame) -> DataFrame:
        one = roots.select(F.lit("").alias("grp"), "hash", F.struct("grp").alias("row"), F.col("grp").alias("key"))
        proofs, _ = prove(one, ["key"], None, per_part, bits)
        return proofs.select(F.col("row.grp").alias("grp"), "root", F.col("proof").alias("above"))

    return prove(leaves, ["key", "hash", "n"], upper, per_part, bits)[0]


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""

    def step(node: Column, x: Column) -> Column:
        pair = F.when(x["left"], F.concat(x["hash"], node)).otherwise(F.concat(node, x["hash"]))
        return F.sha2(F.coalesce(pair, node), 256)

    return F.aggregate(proof, leaf, step)


def op13_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED_EVERY == 0
    fields = [F.col(f) + 1 if f == "n_chars" else F.col(f) for f in FIELDS]
    m = manifest(docs, extra={"tampered": F.when(changed, field_digest(*fields))})
    m = m.select(
        F.col("row.key").alias("doc_id"),
        "leaf",
        "subroot",
        "root",
        F.sha2(F.array_join(F.col("proof.hash"), ""), 256).alias("proof_sha256"),
        folded(F.coalesce("row.tampered", "leaf"), F.col("proof")).alias("folded_root"),
    )
    return m.select("*", (F.col("folded_root") == F.col("root")).alias("verified"))


ORACLE = {
    "op13_merkle_manifest": rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, n_chars,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS a,
         coalesce(strlen(text) || ':' || text, '-') AS b,
         -- CRC-32 of the decimal digits, bit by bit
         xor(list_reduce(
           list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
           lambda s, c: list_reduce(list_prepend(xor(s, c), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))
         ), 4294967295::BIGINT) % {TAMPERED_EVERY} = 0 AS changed
  FROM documents
), l AS (
  SELECT doc_id, lang, sha256(a || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || b) AS leaf,
         CASE WHEN changed THEN sha256(a || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || b) END AS other
  FROM d
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM l
), tree AS (
  SELECT lang, 0 AS level, list(leaf ORDER BY pos) AS nodes FROM placed GROUP BY lang
  UNION ALL
  SELECT lang, level + 1, list_transform(range(1, len(nodes) + 1, 2), lambda i: sha256(nodes[i] || coalesce(nodes[i + 1], ''))) FROM tree WHERE len(nodes) > 1
), subroots AS (
  SELECT lang, nodes[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos FROM tree WHERE len(nodes) = 1
), top AS (
  SELECT 0 AS level, list(subroot ORDER BY pos) AS nodes FROM subroots
  UNION ALL
  SELECT level + 1, list_transform(range(1, len(nodes) + 1, 2), lambda i: sha256(nodes[i] || coalesce(nodes[i + 1], ''))) FROM top WHERE len(nodes) > 1
), up AS (
  SELECT s.lang, list({{'left': (s.pos >> level) & 1 = 1, 'hash': coalesce(nodes[xor(s.pos >> level, 1) + 1], '')}} ORDER BY level) FILTER (len(nodes) > 1) AS steps
  FROM subroots s, top GROUP BY s.lang
), proofs AS (
  SELECT p.doc_id, p.lang, p.leaf, p.other, p.pos,
         list({{'left': (p.pos >> level) & 1 = 1, 'hash': coalesce(nodes[xor(p.pos >> level, 1) + 1], '')}} ORDER BY level) FILTER (len(nodes) > 1) AS steps
  FROM placed p JOIN tree ON tree.lang IS NOT DISTINCT FROM p.lang GROUP BY ALL
), folded AS (
  SELECT p.doc_id, p.leaf, s.subroot, (SELECT nodes[1] FROM top WHERE len(nodes) = 1) AS root,
         list_concat(coalesce(p.steps, []), coalesce(up.steps, [])) AS path,
         list_reduce(list_prepend({{'left': false, 'hash': coalesce(p.other, p.leaf)}}, path),
           lambda x, y: {{'left': false, 'hash': sha256(CASE WHEN y['left'] THEN y['hash'] || x['hash'] ELSE x['hash'] || y['hash'] END)}})['hash'] AS folded_root
  FROM proofs p JOIN subroots s ON s.lang IS NOT DISTINCT FROM p.lang JOIN up ON up.lang IS NOT DISTINCT FROM p.lang
)
SELECT doc_id, leaf, subroot, root, sha256(list_reduce(list_prepend('', list_transform(path, lambda x: x['hash'])), lambda x, y: x || y)) AS proof_sha256,
       folded_root, folded_root = root AS verified
FROM folded
"""
}
