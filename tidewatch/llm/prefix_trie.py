"""A trie of conversations by their first turns, with figures of each node's subtree.

A node is known by a sum of hashes of (place, turn) over its turns, 128 bits, so
prefixes of a conversation are running sums, made chunk by chunk whatever its length.

Subtrees are rolled up by centroid decomposition. Nodes of one smallest member lie
on one path downwards, so paths are the vertices of the parent-edge forest, and a
vertex weighs as many conversations as end on it: the weight of a subtree is the
member count of its top. In each round the centroid of every component is found,
the deepest vertex of more than half of its weight; the vertices of more than half
are just those from the centroid up to the top, and get what lies below the
centroid. The parts below it become components, what is left stays one. Components
weigh half as much after each round; those of at most ``LOCAL`` are finished within
a task, by the same rounds over arrays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD_RE, materialise

#: Conversations of each run of this many ids begin with turns of the run's first one.
RUN = 20
#: Of each conversation so many turns at most come from there, one less than this.
BORROWED = 4
#: Places of a conversation that one task sums up.
CHUNK = 4096
#: Weight of a component that a task finishes.
LOCAL = 256
#: Rows of whole components that a task holds at once.
LOCAL_ROWS = 50_000
#: Ids that are joined to one piece of a list.
IDS = 8192
SUMS = ["s0", "s1", "s2", "s3"]
ROOT = "root"


def running(rows: DataFrame, group: str, order: str, values: list[str], backwards: bool = False, chunk: int = CHUNK) -> DataFrame:
    """``rows`` with each of ``values`` summed from the group's first row to the row itself, or from the last one backwards.

    A group is summed in chunks of ``order``; only the chunks' totals meet in one place.
    """
    rows = rows.withColumn("chunk", F.expr(f"`{order}` div {chunk}"))
    way = (lambda c: F.col(c).desc()) if backwards else (lambda c: F.col(c).asc())
    before = Window.partitionBy(group).orderBy(way("chunk")).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(group, "chunk").agg(*(F.sum(v).alias(v) for v in values))
    totals = totals.select(group, "chunk", *(F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"_{v}") for v in values))
    upto = Window.partitionBy(group, "chunk").orderBy(way(order)).rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.join(totals, [group, "chunk"])
    return summed.withColumns({v: F.sum(v).over(upto) + F.col(f"_{v}") for v in values}).drop("chunk", *(f"_{v}" for v in values))


def borrowed(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first one of its run."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % BORROWED).cast("long")


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, turn_hash, words) of each turn, pos from 0 by turn, null first, and at ties by the hash of role and text.

    Rows are sorted over all partitions, so a conversation may lie in many of them;
    equal rows may too, as their number in the input is the last key.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    turns = conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"),
        F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256).alias("turn_hash"),
        F.regexp_count(text, F.lit(WORD_RE)).cast("long").alias("words"), F.monotonically_increasing_id().alias("row"),
    ).where(F.col("conv_id").isNotNull())
    keys = [F.col("conv_id").asc(), F.col("turn").asc_nulls_first(), F.col("turn_hash").asc(), F.col("row").asc()]
    placed = turns.repartitionByRange(*keys).sortWithinPartitions(*keys).select(
        "conv_id", "turn_hash", "words", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("number")
    )
    placed = materialise(placed, "trie-turns")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = placed.groupBy("conv_id", "part").agg(F.min("number").alias("first"), F.count("*").alias("n"))
    pieces = pieces.select("conv_id", "part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return placed.join(pieces, ["conv_id", "part"]).select("conv_id", (F.col("offset") + F.col("number") - F.col("first")).alias("pos"), "turn_hash", "words")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos, turn_hash, words) of the rebuilt conversations, and (conv_id, length) of all of them, turnless ones too.

    ``turns`` are ordered ones. A conversation begins with turns of the first one of its run.
    """
    run = F.col("conv_id") - F.col("conv_id") % RUN
    first = turns.where((F.col("pos") < BORROWED - 1) & (F.col("conv_id") == run)).withColumnRenamed("conv_id", "run")
    lengths = turns.groupBy("conv_id").agg(F.count("*").alias("own")).select("conv_id", "own", run.alias("run"), borrowed(F.col("conv_id")).alias("h"))
    had = first.groupBy("run").agg(F.count("*").alias("had"))
    lengths = lengths.join(had, "run", "left").select("conv_id", "run", "h", "own", F.least("h", F.coalesce("had", F.lit(0))).alias("taken"))
    lengths = materialise(lengths, "trie-lengths")
    taken = lengths.join(first, "run").where("pos < h").select("conv_id", "pos", "turn_hash", "words")
    # How many turns are taken is known to each own turn: at most three numbers, one a run's length.
    short = lengths.where("taken < h").select("conv_id", (F.col("h") - F.col("taken")).alias("less"))
    own = turns.where(F.col("pos") >= borrowed(F.col("conv_id"))).join(short, "conv_id", "left").select(
        "conv_id", (F.col("pos") - F.coalesce("less", F.lit(0))).alias("pos"), "turn_hash", "words"
    )
    return taken.unionByName(own), lengths.select("conv_id", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length"))


def _node(depth: Column, sums: list[Column]) -> Column:
    return F.when(depth == 0, F.lit(ROOT)).otherwise(F.md5(F.concat_ws(",", depth.cast("string"), *(s.cast("string") for s in sums)).cast("binary")))


def memberships(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """(conv_id, depth, node, parent, words, ends): every conversation in each of its nodes, ``ends`` where it has no more turns."""
    bits = F.md5(F.concat_ws(":", F.col("pos").cast("string"), "turn_hash").cast("binary"))
    part = lambda i: F.conv(F.substring(bits, 8 * i + 1, 8), 16, 10).cast("long")
    hashed = materialise(turns.select("conv_id", "pos", "words", *(part(i).alias(s) for i, s in enumerate(SUMS)), *(part(i).alias(f"own{i}") for i in range(4))), "trie-hashed")
    summed = running(hashed, "conv_id", "pos", SUMS)
    depth = F.col("pos") + 1
    inner = summed.select(
        "conv_id", depth.alias("depth"), _node(depth, [F.col(s) for s in SUMS]).alias("node"),
        _node(F.col("pos"), [F.col(s) - F.col(f"own{i}") for i, s in enumerate(SUMS)]).alias("parent"), "words",
    )
    root = lengths.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(ROOT).alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(0).cast("long").alias("words"))
    last = lengths.select("conv_id", F.col("length").alias("depth"), F.lit(True).alias("ends"))
    return inner.unionByName(root).join(last, ["conv_id", "depth"], "left").withColumn("ends", F.coalesce("ends", F.lit(False)))


def _list_batches(most: int):
    """(node, first, ids): sorted ids of a node joined by commas, ``most`` at most in a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, held = None, []

        def row() -> pa.RecordBatch:
            return pa.record_batch([pa.array([node]), pa.array([held[0]], pa.int64()), pa.array([",".join(map(str, held))])], names=["node", "first", "ids"])

        for batch in batches:
            rows: list = []
            for key, conv_id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held and (key != node or len(held) == most):
                    rows.append(row())
                    held = []
                node = key
                held.append(conv_id)
            if rows:
                yield from pa.Table.from_batches(rows).combine_chunks().to_batches()
        if held:
            yield row()

    return run


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, ends_sha256) from rows sorted by node and first id; a list is hashed as it comes."""
    node, state = None, None
    for batch in batches:
        nodes, digests = [], []
        for key, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if key != node:
                if node is not None:
                    nodes.append(node)
                    digests.append(state.hexdigest())
                node, state = key, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield pa.record_batch([pa.array(nodes, pa.string()), pa.array(digests, pa.string())], names=["node", "ends_sha256"])
    if node is not None:
        yield pa.record_batch([pa.array([node]), pa.array([state.hexdigest()])], names=["node", "ends_sha256"])


def end_digests(members: DataFrame, most: int = IDS) -> DataFrame:
    """(node, ends_sha256): the digest of the ids that end in a node, ascending, joined by commas.

    Ids are joined range by range first, so that a node with very many comes to its hash in few rows.
    """
    ends = members.where("ends").select("node", "conv_id")
    lists = ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(_list_batches(most), "node string, first long, ids string")
    dealt = lists.repartition("node").sortWithinPartitions("node", "first")
    return dealt.select("node", "ids").mapInArrow(_digest_batches, "node string, ends_sha256 string")


def decomposed(parent: np.ndarray, weight: np.ndarray, values: list[np.ndarray]) -> list[np.ndarray]:
    """The sums of ``values`` over each vertex' subtree, by centroid decomposition of all trees at once.

    ``parent`` is the place of each vertex' parent, -1 for a tree's top; ``weight`` that of its subtree, falling downwards.
    """
    n = len(parent)
    weight = weight.copy()
    out = [np.zeros(n, np.int64) for _ in values]
    alive = np.arange(n)
    top = np.where(parent < 0, alive, parent)
    while not np.array_equal(top, top[top]):
        top = top[top]
    while len(alive):
        heavy = alive[2 * weight[alive] > weight[top[alive]]]
        # The lightest of the heavy vertices of a component is its centroid.
        order = heavy[np.lexsort((weight[heavy], top[heavy]))]
        first = np.concatenate([[True], top[order][1:] != top[order][:-1]])
        centroid = np.full(n, -1)
        centroid[top[order[first]]] = order[first]
        own = centroid[top[alive]]
        # New components: those of the centroid's children, and what stays around the old top.
        new = np.arange(n)
        up = parent[alive]
        stays = (up >= 0) & (up != own) & (alive != own) & (alive != top[alive])
        new[alive[stays]] = up[stays]
        while not np.array_equal(new, new[new]):
            new = new[new]
        below = (parent[new[alive]] == own) | (alive == own)
        path_end = centroid[top[heavy]]
        for value, total in zip(values, out, strict=True):
            sums = np.zeros(n, np.int64)
            np.add.at(sums, own[below], value[alive[below]])
            total[heavy] += sums[path_end]
        shrunk = heavy[heavy != path_end]
        weight[shrunk] -= weight[centroid[top[shrunk]]]
        alive = alive[alive != own]
        top = new
    return out


def _local_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(v, saved, leaves) of whole components that come one after the other."""
    held: list[np.ndarray] = []
    size = 0

    def settled(rows: np.ndarray) -> pa.RecordBatch:
        comp, v, parent, weight, saved, leaves = rows.T
        order = np.argsort(v)
        place = order[np.minimum(np.searchsorted(v[order], parent), len(v) - 1)]
        inside = (v[place] == parent) & (comp[place] == comp)
        sums = decomposed(np.where(inside, place, -1), weight, [saved, leaves])
        return pa.record_batch([pa.array(v), *map(pa.array, sums)], names=["v", "saved", "leaves"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1))
        size += batch.num_rows
        if size < LOCAL_ROWS:
            continue
        rows = np.concatenate(held)
        cut = int(np.argmax(rows[:, 0] == rows[-1, 0]))
        if cut:
            yield settled(rows[:cut])
        held, size = [rows[cut:]], len(rows) - cut
    if size:
        yield settled(np.concatenate(held))


def _split(big: DataFrame, above: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One round over components: (v, saved, leaves) that vertices gain, and the vertices of the components that come of it."""
    info = big.groupBy("comp").agg(F.max("weight").alias("total"))
    info = (
        big.join(info, "comp").where(2 * F.col("weight") > F.col("total")).groupBy("comp", "total")
        .agg(F.min_by(F.struct("v", "weight"), "weight").alias("z")).select("comp", "total", F.col("z.v").alias("z"), F.col("z.weight").alias("zw"))
    )
    rows = big.join(materialise(info, "trie-centroids"), "comp")
    kids = rows.where(F.col("parent") == F.col("z")).select(F.col("v").alias("u"), "comp")
    moved = above.join(kids, "u").select("v", "comp", "u")
    rows = materialise(rows.join(moved, ["v", "comp"], "left"), "trie-split")
    gained = rows.where("u IS NOT NULL OR v = z").groupBy("comp").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    heavy = 2 * F.col("weight") > F.col("total")
    gains = rows.where(heavy).select("v", "comp").join(gained, "comp").select("v", "saved", "leaves")
    left = rows.where("v <> z").select(
        F.coalesce("u", "comp").alias("comp"), "v", "parent", (F.col("weight") - F.when(heavy, F.col("zw")).otherwise(0)).alias("weight"), "saved", "leaves"
    )
    return materialise(gains, "trie-gains"), materialise(left, "trie-left")


def rolled_up(vertices: DataFrame, above: DataFrame, local: int = LOCAL) -> DataFrame:
    """(v, saved, leaves): the sums over the subtree of each vertex.

    ``vertices`` has v, parent (null for the top), weight (of its subtree), saved, leaves;
    ``above`` each v with every u on its way to the top, itself included. Rounds
    are as many as halvings of the heaviest component's weight down to ``local``.
    """
    columns = ["comp", "v", "parent", "weight", "saved", "leaves"]
    top = vertices.where("parent IS NULL").select(F.col("v").alias("comp"))
    # One tree, one top: a row.
    state = materialise(vertices.join(F.broadcast(top)).select(*columns), "trie-vertices")
    gains, small = [], []
    while True:
        heavy = state.groupBy("comp").agg(F.max("weight").alias("total")).where(F.col("total") > local).select("comp")
        heavy = materialise(heavy, "trie-heavy")
        small.append(state.join(heavy, "comp", "left_anti").select(*columns))
        if heavy.isEmpty():
            break
        gain, state = _split(state.join(heavy, "comp", "left_semi").select(*columns), above)
        gains.append(gain)
    rest = reduce(DataFrame.unionByName, small)
    rest = rest.withColumn("parent", F.coalesce("parent", F.lit(np.iinfo(np.int64).min))).repartition("comp").sortWithinPartitions("comp")
    parts = [*gains, rest.select(*columns).mapInArrow(_local_batches, "v long, saved long, leaves long")]
    return reduce(DataFrame.unionByName, parts).groupBy("v").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))


def prefix_trie(conversations: DataFrame, local: int = LOCAL, chunk: int = CHUNK, ids: int = IDS) -> DataFrame:
    """A row a node of the trie of rebuilt conversations; see ``op11_prefix_trie`` for the columns.

    A null conv_id is no conversation, so such rows are left out; null roles and texts count
    as empty; turns of one number stand in the order of the hash of role and text,
    repeated rows are turns of their own. An empty table has no nodes. Other columns are not read.
    """
    turns = materialise(ordered_turns(conversations), "trie-ordered")
    built, lengths = rebuilt(turns)
    members = materialise(memberships(built, lengths), "trie-members")
    nodes = members.groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent").alias("parent"), F.first("words").alias("words"), F.count("*").alias("n_convs")
    )
    nodes = materialise(nodes, "trie-nodes")
    kids = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(kids, "node", "left").select(
        "*", F.coalesce("n_children", F.lit(0)).alias("children"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"),
        F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("leaves"),
    ).drop("n_children", "words")
    nodes = materialise(nodes, "trie-counted")

    # Paths: the nodes of one smallest member, from the top down.
    paths = nodes.groupBy("conv_id").agg(
        F.min_by(F.struct("node", "parent", "n_convs", "depth"), "depth").alias("top"), F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves")
    ).select(F.col("conv_id").alias("v"), F.col("top.node").alias("top"), F.col("top.parent").alias("parent_node"), F.col("top.n_convs").alias("weight"), F.col("top.depth").alias("depth"), "saved", "leaves")
    parents = nodes.select(F.col("node").alias("parent_node"), F.col("conv_id").alias("parent"))
    paths = materialise(paths.join(parents, "parent_node", "left"), "trie-paths")
    above = members.join(paths.select("v"), F.col("conv_id") == F.col("v"), "left_semi").join(paths.select(F.col("v").alias("u"), F.col("top").alias("node")), "node")
    above = materialise(above.select(F.col("conv_id").alias("v"), "u"), "trie-above")
    totals = materialise(rolled_up(paths, above, local), "trie-totals")

    # A node's subtree: its path from there on, and the paths that hang from it.
    hung = paths.where("parent_node IS NOT NULL").select("v", F.col("parent_node").alias("node")).join(totals, "v").groupBy("node").agg(
        F.sum("saved").alias("hung_saved"), F.sum("leaves").alias("hung_leaves")
    )
    parent_of_top = paths.select(F.col("top").alias("node"), F.col("parent").alias("parent_conv_id"), F.lit(True).alias("is_top"))
    whole = nodes.join(hung, "node", "left").join(parent_of_top, "node", "left").select(
        "node", "conv_id", "depth", F.when(F.col("is_top"), F.col("parent_conv_id")).otherwise(F.col("conv_id")).alias("parent_conv_id"), "n_convs", F.col("children").alias("n_children"),
        (F.col("leaves") + F.coalesce("hung_leaves", F.lit(0))).alias("n_leaves"), (F.col("saved") + F.coalesce("hung_saved", F.lit(0))).alias("saved_tokens"),
    )
    whole = running(materialise(whole, "trie-whole"), "conv_id", "depth", ["n_leaves", "saved_tokens"], backwards=True, chunk=chunk)
    none = hashlib.sha256(b"").hexdigest()
    return whole.join(end_digests(members, ids), "node", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256")
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every prefix of the rebuilt conversations with its members and the figures of its subtree.

    Rows without conv_id are left out, null roles and texts are empty, null turns come
    first, equal turns stand by their hash, repeated rows stay; no rows give no nodes.
    """
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLE = f"""
WITH turn AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) - 1 AS pos, digest, words FROM (
    SELECT conv_id, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
           len(regexp_extract_all(coalesce(text, ''), '{WORD_RE}')) AS words FROM conversations WHERE conv_id IS NOT NULL)),
own AS (SELECT conv_id, list({{'d': digest, 'w': words}} ORDER BY pos) AS l FROM turn GROUP BY conv_id),
step AS (SELECT conv_id, l, flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: [ascii(x), -1, -1, -1, -1, -1, -1, -1, -1])) AS s FROM own),
crc AS (
  SELECT conv_id, l, xor(list_reduce(list_prepend(4294967295::BIGINT, s::BIGINT[]), lambda a, x:
    CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384::BIGINT) ELSE a // 2 END), 4294967295::BIGINT) % {BORROWED} AS h FROM step),
whole AS (SELECT c.conv_id, coalesce(b.l[1:c.h], []) || c.l[c.h + 1:] AS l FROM crc c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % {RUN}),
member AS (SELECT conv_id, d, l[1:d] AS k, len(l) AS n, CASE WHEN d > 0 THEN l[d].w ELSE 0 END AS w FROM (SELECT conv_id, l, unnest(range(0, len(l) + 1)) AS d FROM whole)),
node AS (
  SELECT k, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(w) AS saved,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = d), '')) AS ends_sha256 FROM member GROUP BY k, d),
kid AS (SELECT k[1:depth - 1] AS k, count(*) AS n FROM node WHERE depth > 0 GROUP BY 1),
counted AS (SELECT node.*, coalesce(kid.n, 0) AS n_children FROM node LEFT JOIN kid ON node.k = kid.k),
below AS (
  SELECT k[1:a] AS k, sum(saved) AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves
  FROM (SELECT k, saved, n_children, unnest(range(0, depth + 1)) AS a FROM counted) GROUP BY 1)
SELECT c.conv_id, c.depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, b.n_leaves, CAST(b.saved_tokens AS BIGINT) AS saved_tokens, c.ends_sha256
FROM counted c JOIN below b ON c.k = b.k LEFT JOIN node p ON c.depth > 0 AND p.k = c.k[1:c.depth - 1]
"""
