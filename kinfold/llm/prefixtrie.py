"""The trie of all conversation prefixes, by van Emde Boas recursion.

Sequences of turns are cut at half depth, and again at half of each half. ``named`` goes down: at
every level each entry (a sequence within a tree of the forest, with the number of sequences that
it stands for) whose upper half is complete names its cut prefix, by the name of the tree's root
and the signature of the half. The upper trie is built from one entry for each cut prefix, which
carries the count of all, and from the sequences that end before the cut; the lower forests have
the named prefixes as roots and go on with every longer sequence. All trees of a level, upper and
lower, are one job, so log2(depth) jobs name all nodes, and rows halve where sequences share what
lies above a cut. ``_signatures`` are those of aligned blocks of 1, 2, 4, ... turns, each from two.

Totals are grafted upward along the same cuts. ``_totals`` first sums each subtree down to the next
cut of its level, level by level upward; then, from the coarsest cut on, it adds the finished totals
of the lower forests to the cut prefixes above them. Each node is moved once per power of two that
divides its depth, so all of it is linear in nodes.

Names and signatures are 128-bit hashes. Edge cases. Rows without conversation id take no part; a
null role or text is empty; turns are in the order of their number, null first, and turns of equal
number in the order of their content's hash; repeated rows are turns of their own. A table without
conversations has no nodes. A conversation may hold any part of the rows: positions come from a
range sort, not from a group. Other columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import stage

#: Conversations to a base, and turns that are taken from it: crc32 of the id modulo this.
FAMILY, SHARED = 5, 9

#: Name of the root.
ROOT = bytes(16)


def _hash(*parts: Column) -> Column:
    return F.unhex(F.md5(F.concat(*parts)))


def _numbered(turns: DataFrame) -> DataFrame:
    """conv, pos (from 1), sign, bytes. Rows are ranged and sorted over all partitions, so that a long conversation
    may go over several; what stands in partitions before is added, one row for each partition at most."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, last, held = TaskContext.get().partitionId(), None, 0
        for pdf in frames:
            conv = pdf["conv"].to_numpy()
            begins = np.flatnonzero(np.append(True, conv[1:] != conv[:-1]))
            at = np.arange(len(conv)) - np.repeat(begins, np.diff(np.append(begins, len(conv))))
            if len(conv) and conv[0] == last:
                at[: begins[1] if len(begins) > 1 else len(conv)] += held
            if len(conv):
                last, held = conv[-1], int(at[-1]) + 1
            yield pd.DataFrame({"conv": conv, "at": at, "sign": pdf["sign"], "bytes": pdf["bytes"], "part": part})

    order = ["conv", "turn", "sign"]
    local = turns.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(count, "conv long, at long, sign binary, bytes long, part int")
    local = stage(local, "turns")
    runs = local.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumn("before", before).filter("before > 0").select("conv", "part", "before")  # conversations that go on: one a partition
    return local.join(F.broadcast(runs), ["conv", "part"], "left").select("conv", (F.col("at") + 1 + F.coalesce("before", F.lit(0))).alias("pos"), "sign", "bytes")


def rebuilt(turns: DataFrame, family: int = FAMILY, shared: int = SHARED) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv, len) and their turns (conv, depth, sign, bytes), each after the first turns of its base."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    sign = _hash(F.octet_length(role).cast("string").cast("binary"), F.lit(b":"), role.cast("binary"), text.cast("binary"))
    rows = turns.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv"), "turn", sign.alias("sign"), F.octet_length(text).cast("long").alias("bytes"))
    own = stage(_numbered(rows), "numbered")
    lengths = own.groupBy("conv").agg(F.max("pos").alias("n"))
    taken = F.crc32(F.col("conv").cast("string").cast("binary")) % shared
    convs = lengths.withColumn("h", taken).withColumn("base", F.col("conv") - F.col("conv") % family)
    bases = lengths.filter(F.col("conv") % family == 0).select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    convs = convs.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0))))
    convs = stage(convs.select("conv", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len")), "convs")
    heads = own.filter((F.col("conv") % family == 0) & (F.col("pos") < shared)).withColumnRenamed("conv", "base")
    heads = convs.filter("taken > 0").join(heads, "base").filter("pos <= taken").select("conv", F.col("pos").alias("depth"), "sign", "bytes")
    tails = own.join(convs, "conv").filter("pos > h").select("conv", (F.col("pos") - F.col("h") + F.col("taken")).alias("depth"), "sign", "bytes")
    return convs.select("conv", "len"), stage(heads.unionByName(tails), "rebuilt")


def _signatures(turns: DataFrame, levels: int) -> list[DataFrame]:
    """Of each level j: conv, block, sign of the whole blocks of 2^j turns."""
    out = [turns.select("conv", (F.col("depth") - 1).alias("block"), "sign")]
    for _ in range(1, levels):
        half = lambda odd: F.max(F.when(F.col("block") % 2 == odd, F.col("sign")))
        pairs = out[-1].groupBy("conv", F.shiftright("block", 1).alias("block_")).agg(half(0).alias("a"), half(1).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
        out.append(stage(pairs.select("conv", F.col("block_").alias("block"), _hash(F.col("a"), F.col("b")).alias("sign")), "signatures"))
    return out


def named(convs: DataFrame, turns: DataFrame, levels: int) -> DataFrame:
    """conv, depth, name, weight, len: for each node the entries that met at it. The node's smallest conversation is
    among them, there and at the depths that ``_nodes`` looks up."""
    signatures = _signatures(turns, levels)
    entries, cuts = convs.filter("len > 0").select(F.lit(ROOT).alias("root"), "conv", F.lit(0).cast("long").alias("tree"), "len", F.lit(1).cast("long").alias("weight")), []
    for j in reversed(range(levels)):
        half = 1 << j
        signs = signatures[j].filter("block % 2 = 0").select("conv", F.shiftright("block", 1).alias("tree"), "sign")
        met = entries.join(signs, ["conv", "tree"], "left").withColumn("depth", F.col("tree") * (2 * half) + half)
        met = stage(met.withColumn("name", F.when(F.col("sign").isNotNull(), _hash(F.col("root"), F.col("sign")))).drop("sign"), "cuts")
        cut = met.filter("name IS NOT NULL")
        cuts.append(cut.select("conv", "depth", "name", "weight", "len"))
        above = cut.groupBy("root", "name").agg(F.min("conv").alias("conv"), F.min("tree").alias("tree"), F.min("depth").alias("len"), F.sum("weight").alias("weight")).drop("name")
        above = above.unionByName(met.filter("name IS NULL").select(*above.columns)).withColumn("tree", F.col("tree") * 2)
        below = cut.filter("len > depth").select(F.col("name").alias("root"), "conv", (F.col("tree") * 2 + 1).alias("tree"), "len", "weight")
        entries = above.unionByName(below).filter(F.col("len") > F.col("tree") * half)
    return reduce(DataFrame.unionByName, cuts) if cuts else turns.limit(0).select("conv", "depth", F.col("sign").alias("name"), F.lit(0).cast("long").alias("weight"), F.lit(0).cast("long").alias("len"))


def _nodes(convs: DataFrame, turns: DataFrame, cuts: DataFrame, levels: int) -> DataFrame:
    """name, depth, conv (smallest member), n_convs, bytes, ups (ancestors 1, 2, 4, ... above, as long as that divides the depth)."""
    met = cuts.groupBy("name").agg(F.min("depth").alias("depth"), F.min("conv").alias("conv"), F.sum("weight").alias("n_convs"))
    met = stage(met.join(turns.select("conv", "depth", "bytes"), ["conv", "depth"]), "nodes")
    steps = met.select("name", "conv", "depth", F.explode(F.expr(f"filter(sequence(0, {max(0, levels - 1)}), j -> depth % shiftleft(1L, j) = 0)")).alias("j"))
    steps = steps.withColumn("depth", F.expr("depth - shiftleft(1L, j)"))
    above = steps.join(cuts.select("conv", "depth", F.col("name").alias("up")), ["conv", "depth"], "left").withColumn("up", F.coalesce("up", F.lit(ROOT)))
    ups = above.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "up"))), lambda x: x["up"]).alias("ups"))  # log2(depth) of them
    root = convs.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv").alias("conv")).filter("n_convs > 0")
    root = root.select(F.lit(ROOT).alias("name"), F.lit(0).cast("long").alias("depth"), "conv", "n_convs", F.lit(0).cast("long").alias("bytes"), F.array().cast("array<binary>").alias("ups"))
    nodes = met.join(ups, "name").select(*root.columns).unionByName(root)
    children = nodes.filter("depth > 0").groupBy(F.get("ups", F.lit(0)).alias("name")).agg(F.count(F.lit(1)).alias("n_children"))
    return stage(nodes.join(children, "name", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "nodes")


def _totals(nodes: DataFrame, levels: int) -> DataFrame:
    """name, n_leaves, saved: over each node's subtree."""
    at = lambda j: F.get("ups", F.lit(j))
    sums = [F.sum("n_leaves").alias("l"), F.sum("saved").alias("s")]
    add = lambda df, more: df.join(more, "name", "left").select("name", "depth", "ups", *((F.col(c) + F.coalesce(d, F.lit(0).cast("long"))).alias(c) for c, d in (("n_leaves", "l"), ("saved", "s"))))
    one = (F.col("n_children") == 0).cast("long")
    sub = [nodes.select("name", "depth", "ups", one.alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))]
    for j in range(levels):  # down to the next cut of this level
        odd = F.col("depth") % (2 << j) != 0
        lower = sub[j].filter(odd).groupBy(at(j).alias("name")).agg(*sums)
        sub.append(stage(add(sub[j].filter(~odd), lower), "subtrees"))
    whole = sub[levels]
    for j in reversed(range(levels)):  # down to the leaves: finished totals go to the cut prefixes above them
        grafts = whole.filter("depth > 0").groupBy(at(j).alias("name")).agg(*sums)
        whole = stage(whole.unionByName(add(sub[j].filter(F.col("depth") % (2 << j) != 0), grafts)), "totals")
    return whole.select("name", "n_leaves", "saved")


def _ends(ends: DataFrame) -> DataFrame:
    """name, ends_sha256: of each node's conversations in ascending order. Lists are joined piece by piece where the
    sorted rows lie, and the pieces of a node are hashed as they pass, so no list is ever held whole."""

    def pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            name, conv = pdf["name"].to_numpy(), pdf["conv"].to_numpy()
            begins = np.flatnonzero(np.append(True, name[1:] != name[:-1])) if len(name) else np.empty(0, int)
            stops = np.append(begins[1:], len(name)).astype(int)
            yield pd.DataFrame({"name": name[begins], "first": conv[begins], "piece": [",".join(map(str, conv[a:b])) for a, b in zip(begins, stops, strict=True)]})

    def digest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, None
        for pdf in frames:
            done = []
            for name, piece in zip(pdf["name"], pdf["piece"], strict=True):
                if name == last:
                    state.update(b"," + piece.encode())
                    continue
                if state is not None:
                    done.append((last, state.hexdigest()))
                last, state = name, hashlib.sha256(piece.encode())
            yield pd.DataFrame(done, columns=["name", "ends_sha256"])
        if state is not None:
            yield pd.DataFrame([(last, state.hexdigest())], columns=["name", "ends_sha256"])

    parts = ends.repartitionByRange("name", "conv").sortWithinPartitions("name", "conv").mapInPandas(pieces, "name binary, first long, piece string")
    return parts.repartition("name").sortWithinPartitions("name", "first").mapInPandas(digest, "name binary, ends_sha256 string")


def prefix_trie(turns: DataFrame, family: int = FAMILY, shared: int = SHARED) -> DataFrame:
    """One row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    ``family``: 1 and ``shared``: 1 leave conversations as they are."""
    convs, rows = rebuilt(turns, family, shared)
    longest = convs.agg(F.max("len")).first()[0] or 0
    levels = int(longest).bit_length()
    cuts = named(convs, rows, levels)
    nodes = _nodes(convs, rows, cuts, levels)
    totals = _totals(nodes, levels)
    ends = cuts.filter("len = depth").select("name", "conv").unionByName(convs.filter("len = 0").select(F.lit(ROOT).alias("name"), "conv"))
    parents = nodes.select(F.col("name").alias("_up"), F.col("conv").alias("parent_conv_id"))
    out = nodes.withColumn("_up", F.when(F.col("depth") > 0, F.get("ups", F.lit(0)))).join(parents, "_up", "left").join(totals, "name").join(_ends(ends), "name", "left")
    return out.select(
        F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


def query(conversations: DataFrame) -> DataFrame:
    return prefix_trie(conversations)


_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda v, i: xor(v >> 1, (v & 1) * 3988292384 + i))))"""

SQL = f"""
WITH turns AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
sizes AS (SELECT conv_id AS c, count(*) AS n, any_value({_CRC}) % {SHARED} AS h FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
convs AS (SELECT a.c, a.h, least(a.h, coalesce(b.n, 0)) AS taken FROM sizes a LEFT JOIN sizes b ON b.c = a.c - a.c % {FAMILY}),
seqs AS (
  SELECT convs.c, list({{'role': t.role, 'text': t.text}} ORDER BY t.own, t.pos) FILTER (t.pos IS NOT NULL) AS path FROM convs LEFT JOIN (
    SELECT convs.c, 0 AS own, pos, role, text FROM convs JOIN turns ON turns.c = convs.c - convs.c % {FAMILY} AND pos <= h
    UNION ALL SELECT convs.c, 1, pos, role, text FROM convs JOIN turns ON turns.c = convs.c AND pos > h) t ON t.c = convs.c GROUP BY convs.c),
prefixes AS (SELECT c, coalesce(len(path), 0) AS len, d, CASE WHEN d > 0 THEN path[1:d] ELSE [] END AS p FROM seqs, unnest(range(0, coalesce(len(path), 0) + 1)) AS u(d)),
nodes AS (
  SELECT p, d, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CASE WHEN len = d THEN CAST(c AS VARCHAR) END, ',' ORDER BY c), '')) AS ends_sha256
  FROM prefixes GROUP BY p, d),
children AS (SELECT p[1:d - 1] AS p, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1),
full_ AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children, CASE WHEN d > 0 THEN (n_convs - 1) * strlen(p[d].text) ELSE 0 END AS saved FROM nodes LEFT JOIN children USING (p)),
totals AS (
  SELECT CASE WHEN e > 0 THEN p[1:e] ELSE [] END AS p, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens
  FROM full_, unnest(range(0, d + 1)) AS u(e) GROUP BY 1)
SELECT f.conv_id, f.d AS depth, up.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, f.ends_sha256
FROM full_ f JOIN totals USING (p) LEFT JOIN nodes up ON f.d > 0 AND up.d = f.d - 1 AND up.p = f.p[1:f.d - 1]
"""
