"""N-gram Jaccard join over a token-group matrix.

Documents whose shingle sets have ``100 * intersection >= 80 * union`` are
linked; the result is each document's connected component. The sets are those of
:mod:`shingles` (five words). How the links are found, with none lost:

1. Equal sets are one node (a 64-bit hash of the set).
2. Tokens are put in one order, rare ones first. Sets that are linked share a
   token among the first ``n - ceil(0.8 n) + 1`` of each (prefix filter); a token
   known to be in one set only leads to no link. So a set whose prefix has such
   tokens alone is done. First the tokens in the lowest ``COUNTED`` of the hash
   range are counted over all documents; then all tokens of the sets that are
   left, over these. The counts go to all tasks as sketches of bounded size; an
   order that knows less gives the same links.
3. The list of a token holds the nodes with the token in their prefix. Its leader
   is the node with the longest prefix for its size, so one that lacks few of the
   tokens its likes share. The nodes that share most lists with one leader are
   families, cut into parts of ``QUERIES`` that the leader belongs to as well. A
   part is a task, in which all its sets are held against each other.
4. Where a list still holds several components, its nodes are put on shelves, the
   groups of the token-group matrix: by the longest such list that a node is in and
   by size, in parts of about ``SHELF`` tokens. The matrix stores each shelf's union
   of tokens (``jaccard-unions``). Shelves that share an open list, can have linked
   sizes and hold several components are a pair.
5. The sets of a pair's first shelf are bounded by their overlap with the stored
   union of the second: a set with fewer than 80 % of its tokens there is linked
   with none of its members. The second shelf is opened, that is, its members'
   sets are read, only where some set qualifies, and only for those that do.
6. In a task a shelf is cut into groups of ``GROUP`` sets, which are bounded and
   opened in the same way by their own unions.

Lists of one component only are settled by step 3, so large groups of copies
never give all pairs; of a group that step 3 leaves in many components, pairs of
shelves are made, never pairs of nodes.

Defined results:
- null and empty texts, and texts without words: no shingles, linked with
  nothing, ``component_id`` is the own id;
- equal texts are linked; rows that share an id are each linked by their text;
- a null id takes part, but never names a component that has another id;
- an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, map_batches, map_text, materialize, scratch, slices, small
from .components import connected_components
from .shingles import set_hash, shingle_sets

PERCENT = 80
#: Sets of a group, and nodes that a part of a family holds beside its leader.
GROUP, QUERIES = 64, 256
#: Tokens of a shelf, as planned, and of a group that takes no more sets.
SHELF = 1 << 17
#: Columns of the union that a product of matrices takes at once.
COLUMNS = 1 << 13
#: Share of the hash range whose tokens are counted first.
COUNTED = 0.3
#: Numbers of sets from which on a token moves back in the order.
STEPS = (2, 16, 128)
#: Most bits of a sieve that keeps rows out of a shuffle, a power of two. A full sieve lets all rows pass.
SIEVE = 1 << 28


def counted(tokens: np.ndarray) -> np.ndarray:
    """Whether tokens lie in the part of the hash range that is counted."""
    return tokens < np.uint64(int(COUNTED * 2**64))


def prefix(found: np.ndarray, sieves: list[Sieve], known: int) -> np.ndarray:
    """The tokens of which a linked set must hold one, without those in one set only.

    The first ``known`` tokens are counted: ``sieves`` hold those that are in as
    many sets as ``STEPS`` says. A token that is not counted comes behind the
    counted ones of few sets. Equal places go by hash.
    """
    n = found.size
    if not n:
        return found
    k = n - (PERCENT * n + 99) // 100 + 1
    level = np.full(n, 2 * len(STEPS) - 1)
    level[:known] = 0
    for i, sieve in enumerate(sieves):
        level[:known][sieve.has(found[:known])] = 2 * i + 2 if i else 1
    if known < n:
        level[known:] = 2
        level[:known][level[:known] > 1] += 1
    single = int(np.count_nonzero(level == 0))
    if single >= k:
        return found[:0]
    order = np.argsort(level, kind="stable")
    return found[order[single:k]]


def _nodes(documents: DataFrame) -> DataFrame:
    """Rows of ``id``, ``n`` and ``node``."""

    def start():
        def work(texts: list) -> list[pa.Array]:
            sets = shingle_sets(texts)
            return [pa.array([s.size for s in sets], pa.int64()), pa.array([set_hash(s) for s in sets], pa.int64())]

        return work

    return map_text(documents, ["id"], "text", "n long, node long", start)


class Sieve:
    """A bounded set sketch of 64-bit keys that never forgets a key (two bits for each).

    It has eight bits or more for a key, as far as ``SIEVE`` allows.
    """

    def __init__(self, words: np.ndarray):
        self.words = words

    @staticmethod
    def of(keys: DataFrame, col: str, count: int) -> Sieve:
        size = min(SIEVE, 1 << max(16, (8 * count - 1).bit_length()))
        places = [F.pmod(F.col(col), F.lit(size)), F.pmod(F.shiftrightunsigned(F.col(col), 32), F.lit(size))]
        bits = F.explode(F.array(*places)).alias("bit")
        words = (
            keys.select(bits)
            .groupBy(F.shiftright("bit", 6).alias("word"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits"))
        )
        table = words.toArrow()
        out = np.zeros(size // 64, np.uint64)
        out[table.column("word").to_numpy()] = table.column("bits").to_numpy().view(np.uint64)
        return Sieve(out)

    def has(self, keys: np.ndarray) -> np.ndarray:
        keys = keys.view(np.uint64)
        found = np.ones(keys.size, bool)
        last = np.uint64(self.words.size * 64 - 1)
        for bit in (keys & last, keys >> np.uint64(32) & last):
            found &= (self.words[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1)) > 0
        return found


def _counts(nodes: np.ndarray, tokens: np.ndarray) -> pa.RecordBatch:
    """The tokens of some sets, each once, with the least and the largest node and the number of sets."""
    order = np.argsort(tokens, kind="stable")
    tokens, nodes = tokens[order], nodes[order]
    begins = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])) if tokens.size else np.zeros(0, np.int64)
    ends = np.append(begins[1:], tokens.size) if tokens.size else begins
    least = np.minimum.reduceat(nodes, begins) if tokens.size else nodes
    most = np.maximum.reduceat(nodes, begins) if tokens.size else nodes
    columns = [tokens[begins].view(np.int64), least, most, (ends - begins).astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "first", "last", "n"])


_COUNTS = "token long, first long, last long, n int"


def _low_counts(texts: DataFrame) -> DataFrame:
    """``token``, ``first``, ``last`` and ``n`` of the tokens in the lowest part of the hash range, pre-aggregated by batch."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 0, 4 << 20):
                sets = [s for s in shingle_sets(part.column(0).to_pylist()) if s.size]
                kept = [s[: np.count_nonzero(counted(s))] for s in sets]
                nodes = np.repeat(np.array([set_hash(s) for s in sets], np.int64), [s.size for s in kept])
                yield _counts(nodes, np.concatenate([*kept, np.zeros(0, np.uint64)]))

    return map_batches(texts.select("text"), run, _COUNTS)


def _sieves(tokens: DataFrame, name: str) -> list[Sieve]:
    """Sieves of the tokens that are in several nodes, by ``STEPS``.

    The counts come pre-aggregated by batch, and few tokens are in several
    batches of a task: so they are shuffled as they are, by token.
    """
    spans = tokens.repartition("token").groupBy("token")
    spans = spans.agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"))
    counts = materialize(spans.where("first < last").select("token", "n"), name)
    sizes = counts.agg(*[F.count_if(F.col("n") >= step) for step in STEPS]).first()
    sieves = [Sieve.of(counts.where(F.col("n") >= step), "token", size) for step, size in zip(STEPS, sizes)]
    discard(counts)
    return sieves


def _left_over(documents: DataFrame, sieves) -> DataFrame:
    """``node`` and ``tokens`` (the sorted set, 8 bytes each) of the documents whose prefix holds a token that may be shared."""

    def run(batches):
        known = sieves.value
        for batch in batches:
            for part in slices(batch, 0, 2 << 20):
                sets = shingle_sets(part.column(0).to_pylist())
                chosen = [s for s in sets if prefix(s, known, np.count_nonzero(counted(s))).size]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([set_hash(s) for s in chosen], pa.int64()),
                        pa.array([s.tobytes() for s in chosen], pa.binary()),
                    ],
                    names=["node", "tokens"],
                )

    return map_batches(documents.select("text"), run, "node long, tokens binary")


def _sets_of(part: pa.RecordBatch, index: int) -> list[np.ndarray]:
    """The sets in a column of ``tokens``."""
    return [np.frombuffer(x.as_py(), np.uint64) for x in part.column(index)]


def _all_counts(sets: DataFrame) -> DataFrame:
    """``token``, ``first``, ``last`` and ``n`` of all tokens of stored sets, pre-aggregated by batch."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1, 4 << 20):
                found = _sets_of(part, 1)
                nodes = np.repeat(part.column(0).to_numpy(), [s.size for s in found])
                yield _counts(nodes, np.concatenate([*found, np.zeros(0, np.uint64)]))

    return map_batches(sets.select("node", "tokens"), run, _COUNTS)


def _postings(sets: DataFrame, sieves) -> DataFrame:
    """``token``, ``node``, the set's size ``n`` and its ``rank`` as a leader, for the prefixes of sets of which all tokens are counted.

    A set that lacks few of the tokens its likes share has a long prefix of
    tokens in several sets, so it ranks by that prefix against its size.
    """

    def run(batches):
        known = sieves.value
        for batch in batches:
            for part in slices(batch, 1, 2 << 20):
                whole = _sets_of(part, 1)
                found = [prefix(s, known, s.size) for s in whole]
                sizes = [f.size for f in found]
                columns = [
                    np.concatenate([*found, np.zeros(0, np.uint64)]).view(np.int64),
                    np.repeat(part.column(0).to_numpy(), sizes),
                    np.repeat(np.array([s.size for s in whole], np.int64), sizes),
                    np.repeat(np.array([1000 * f.size // s.size for f, s in zip(found, whole)], np.int64), sizes),
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "node", "n", "rank"])

    return map_batches(sets.select("node", "tokens"), run, "token long, node long, n long, rank long")


def qualifying(union: np.ndarray, queries: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The queries whose overlap with a sorted union reaches the bound; each token's place in it, and whether it is there."""
    sizes = np.array([q.size for q in queries])
    joined = np.concatenate(queries)
    at = np.minimum(np.searchsorted(union, joined), union.size - 1)
    met = union[at] == joined
    overlap = np.add.reduceat(met, np.cumsum(sizes) - sizes, dtype=np.int64)
    return np.flatnonzero(100 * overlap >= PERCENT * sizes), at, met


class Group:
    """Up to ``GROUP`` similar sets: the row of the matrix (the union of their tokens), and its members."""

    def __init__(self):
        self.nodes: list[int] = []
        self.labels: list[int] = []
        self.sets: list[np.ndarray] = []
        self.size = 0
        self._union = None

    def add(self, node: int, label: int, found: np.ndarray) -> None:
        self.nodes.append(node)
        self.labels.append(label)
        self.sets.append(found)
        self.size += found.size
        self._union = None

    @property
    def full(self) -> bool:
        return len(self.nodes) >= GROUP or self.size >= SHELF

    @property
    def union(self) -> np.ndarray:
        if self._union is None:
            self._union = np.unique(np.concatenate(self.sets))
        return self._union

    def common(self, queries: list[np.ndarray]) -> tuple[list[int], np.ndarray]:
        """The queries that qualify by their overlap with the union, and their intersections with each member."""
        union = self.union
        sizes = np.array([q.size for q in queries])
        open_, at, met = qualifying(union, queries)
        out = np.zeros((open_.size, len(self.sets)), np.int64)
        if not open_.size:
            return [], out
        row = np.full(len(queries), -1)
        row[open_] = np.arange(open_.size)
        row = np.repeat(row, sizes)
        held = met & (row >= 0)
        # Only the union's tokens that a qualifying query holds make columns.
        columns = np.unique(at[held])
        q_row, q_col = row[held], np.searchsorted(columns, at[held])
        tokens = union[columns]
        m_row = np.repeat(np.arange(len(self.sets)), [s.size for s in self.sets])
        m_tokens = np.concatenate(self.sets)
        m_col = np.minimum(np.searchsorted(tokens, m_tokens), tokens.size - 1)
        same = tokens[m_col] == m_tokens
        m_row, m_col = m_row[same], m_col[same]
        for first in range(0, tokens.size, COLUMNS):
            wide = min(COLUMNS, tokens.size - first)
            a, b = np.zeros((open_.size, wide), np.float32), np.zeros((len(self.sets), wide), np.float32)
            q, m = (q_col >= first) & (q_col < first + wide), (m_col >= first) & (m_col < first + wide)
            a[q_row[q], q_col[q] - first] = 1
            b[m_row[m], m_col[m] - first] = 1
            out += (a @ b.T).astype(np.int64)
        return open_.tolist(), out


class Block:
    """Sets in groups, against which queries are held; links join labels, so what is linked already is not compared."""

    def __init__(self):
        self.groups: list[Group] = []
        self.parent: dict[int, int] = {}

    def top(self, x: int) -> int:
        parent = self.parent
        while x in parent:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    def add(self, node: int, label: int, found: np.ndarray) -> None:
        if not self.groups or self.groups[-1].full:
            self.groups.append(Group())
        self.groups[-1].add(node, label, found)

    def links(self, asking: Group) -> list[tuple[int, int]]:
        """Links of the group's sets with members of qualifying groups, one for each two labels that they join."""
        found = []
        for group in self.groups:
            tops = {self.top(label) for label in group.labels}
            asks = [i for i, label in enumerate(asking.labels) if len(tops) > 1 or self.top(label) not in tops]
            if not asks:
                continue
            chosen, common = group.common([asking.sets[i] for i in asks])
            sizes = np.array([s.size for s in group.sets])
            for i, row in zip((asks[c] for c in chosen), common):
                for m in np.flatnonzero(100 * row >= PERCENT * (asking.sets[i].size + sizes - row)).tolist():
                    mine, other = self.top(asking.labels[i]), self.top(group.labels[m])
                    if mine != other:
                        self.parent[mine] = other
                        found.append((asking.nodes[i], group.nodes[m]))
        return found


def _open(rows: DataFrame) -> DataFrame:
    """Links ``a``, ``b`` within each task ``x``, ``y``: rows of ``role`` 0 are held in groups, those of ``role`` 1 ask them.

    Where ``x`` is ``y``, all rows are held and ask. A task gives one link for
    each two labels that it joins, so fewer links than rows.
    """
    dealt = rows.select("x", "y", "role", "label", "node", "tokens").repartition("x", "y")
    dealt = dealt.sortWithinPartitions("x", "y", "role", "label")

    def run(batches):
        now, block, asking = None, Block(), Group()

        def flush():
            nonlocal asking
            if now and now[0] == now[1]:
                block.groups.append(asking)
            found = block.links(asking) if asking.nodes else []
            asking = Group()
            return pa.RecordBatch.from_arrays(
                [pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"]
            )

        for batch in batches:
            for part in slices(batch, 5, 2 << 20):
                x, y, role, label, node = (part.column(i).to_pylist() for i in range(5))
                for i, found in enumerate(_sets_of(part, 5)):
                    if (x[i], y[i]) != now:
                        if asking.nodes:
                            yield flush()
                        now, block = (x[i], y[i]), Block()
                    if role[i] == 0 and x[i] != y[i]:
                        block.add(node[i], label[i], found)
                        continue
                    asking.add(node[i], label[i], found)
                    if asking.full:
                        yield flush()
        if asking.nodes:
            yield flush()

    return map_batches(dealt, run, "a long, b long")


def _unions(members: DataFrame) -> DataFrame:
    """``shelf`` and ``union`` (sorted, 8 bytes a token) of the sets on each shelf."""
    dealt = members.select("shelf", "tokens").repartition("shelf").sortWithinPartitions("shelf")

    def run(batches):
        now, held, size = None, [], 0

        def row():
            union = np.unique(np.concatenate(held))
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([union.tobytes()], pa.binary())], names=["shelf", "union"])

        for batch in batches:
            for part in slices(batch, 1, 2 << 20):
                for shelf, found in zip(part.column(0).to_pylist(), _sets_of(part, 1)):
                    if shelf != now and held:
                        yield row()
                        held, size = [], 0
                    now = shelf
                    held.append(found)
                    size += found.size
                    if size > 2 * SHELF and len(held) > 1:
                        held = [np.unique(np.concatenate(held))]
                        size = 0
        if held:
            yield row()

    return map_batches(dealt, run, "shelf long, union binary")


def _qualified(rows: DataFrame) -> DataFrame:
    """``x``, ``y`` and ``node`` of the sets (``role`` 1) that the union (``role`` 0) of the pair ``x``, ``y`` lets pass."""
    dealt = rows.select("x", "y", "role", "node", "tokens").repartition("x", "y").sortWithinPartitions("x", "y", "role")

    def run(batches):
        now, union = None, None
        for batch in batches:
            for part in slices(batch, 4, 2 << 20):
                x, y, role, node = (part.column(i).to_pylist() for i in range(4))
                found = _sets_of(part, 4)
                kept, start = [], 0
                while start < len(x):
                    if role[start] == 0:
                        now, union = (x[start], y[start]), found[start]
                        start += 1
                        continue
                    stop = start
                    while stop < len(x) and role[stop] and (x[stop], y[stop]) == now:
                        stop += 1
                    kept += [start + i for i in qualifying(union, found[start:stop])[0].tolist()]
                    start = stop
                yield pa.RecordBatch.from_arrays(
                    [pa.array([c[i] for i in kept], pa.int64()) for c in (x, y, node)], names=["x", "y", "node"]
                )

    return map_batches(dealt, run, "x long, y long, node long")


def components(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_shingles`` and ``component_id`` for each row."""
    spark = documents.sparkSession
    docs = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    nodes = materialize(_nodes(docs), "jaccard-nodes")
    order = spark.sparkContext.broadcast(_sieves(_low_counts(docs), "jaccard-counts"))
    sets = materialize(_left_over(docs, order).dropDuplicates(["node"]), "jaccard-sets")
    order.destroy()
    order = spark.sparkContext.broadcast(_sieves(_all_counts(sets), "jaccard-counts"))
    postings = materialize(_postings(sets, order), "jaccard-postings")
    order.destroy()
    spans = postings.groupBy("token").agg(
        F.min("node").alias("first"), F.max("node").alias("last"), F.max(F.struct("rank", "node")).alias("leader")
    )
    shared = spans.where("first < last").select("token", "leader")
    lists = materialize(postings.join(shared, "token").select("token", "node", "n", "leader"), "jaccard-lists")
    discard(postings)
    with scratch():
        edges = materialize(_families(lists, sets), "jaccard-families", keep=True)
    labels = connected_components(edges, name="jaccard-first")
    with scratch():
        more = materialize(_residual(lists, labels, sets), "jaccard-rest", keep=True)
    discard(lists)
    if not more.isEmpty():
        discard(labels)
        labels = connected_components(edges.union(more), name="jaccard-all")
    for table in (sets, edges, more):
        discard(table)
    classes = nodes.where("n > 0").groupBy("node").agg(F.min("id").alias("least"))
    named = classes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    names = named.groupBy("label").agg(F.min("least").alias("component_id"))
    of_node = named.join(names, "label").select("node", "component_id")
    out = nodes.join(of_node, "node", "left").select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
    )
    out = materialize(out, "jaccard-components")
    discard(nodes)
    discard(labels)
    return out


def _families(lists: DataFrame, sets: DataFrame) -> DataFrame:
    """Links within the parts of families: the nodes that share most lists with one leader, and the leader."""
    stars = (
        lists.where("node <> leader.node")
        .groupBy("node", "leader")
        .agg(F.count("*").alias("n"))
        .groupBy("node")
        .agg(F.max(F.struct("n", "leader")).alias("best"))
        .select("node", F.col("best.leader.node").alias("x"))
    )
    stars = materialize(stars, "jaccard-leaders")
    many = stars.groupBy("x").agg(F.ceil(F.count("*") / QUERIES).alias("parts"))
    asks = stars.join(many, "x").select("x", F.pmod(F.xxhash64("node"), F.col("parts")).alias("part"), "node")
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    held = many.select("x", parts.alias("part"), F.col("x").alias("node"))
    group = F.xxhash64("x", "part")
    dealt = asks.unionByName(held).select(group.alias("x"), group.alias("y"), F.lit(1).alias("role"), "node")
    dealt = materialize(dealt, "jaccard-asks")
    return _open(sets.join(small(dealt), "node").withColumn("label", F.col("node")))


def _residual(lists: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between components, over the lists that hold several."""
    held = lists.select("token", "node", "n").join(labels, "node", "left")
    held = held.withColumn("label", F.coalesce("label", "node"))
    several = held.groupBy("token").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("m"))
    entries = materialize(held.join(several.where("x < y").select("token", "m"), "token"), "jaccard-open")
    # Similar nodes: of one longest list, and of sizes that can be linked.
    homes = entries.groupBy("node", "label", "n").agg(F.max(F.struct("m", "token"))["token"].alias("key"))
    homes = homes.withColumn("size", F.floor(F.log("n") / F.log(F.lit(100 / PERCENT))))
    weights = homes.groupBy("key", "size").agg(F.ceil(F.sum("n") / SHELF).alias("parts"))
    shelf = F.xxhash64("key", "size", F.pmod(F.xxhash64("node"), F.col("parts")))
    placed = materialize(homes.join(weights, ["key", "size"]).select("node", "label", shelf.alias("shelf")), "jaccard-shelves")
    met = entries.join(placed.select("node", "shelf"), "node").groupBy("token", "shelf")
    met = met.agg(
        F.min("n").alias("low"), F.max("n").alias("high"), F.min("label").alias("first"), F.max("label").alias("last")
    )
    met = materialize(met, "jaccard-met")
    discard(entries)
    several = "a.shelf <= b.shelf and least(a.first, b.first) < greatest(a.last, b.last)"
    close = f"100 * a.high >= {PERCENT} * b.low and 100 * b.high >= {PERCENT} * a.low"
    pairs = met.alias("a").join(met.alias("b"), F.expr(f"a.token = b.token and {several} and {close}"))
    pairs = pairs.select(F.col("a.shelf").alias("x"), F.col("b.shelf").alias("y")).distinct()
    pairs = materialize(pairs, "jaccard-pairs")
    discard(met)
    members = materialize(sets.join(placed, "node").select("shelf", "node", "label", "tokens"), "jaccard-members")
    apart = pairs.where("x <> y")
    matrix = materialize(_unions(members.join(apart.select(F.col("y").alias("shelf")).distinct(), "shelf", "left_semi")), "jaccard-unions")
    null = F.lit(None).cast("long")
    unions = apart.join(matrix, apart.y == matrix.shelf).select("x", "y", F.lit(0).alias("role"), null.alias("node"), F.col("union").alias("tokens"))
    asking = apart.join(members, apart.x == members.shelf).select("x", "y", F.lit(1).alias("role"), "node", "tokens")
    passed = materialize(_qualified(unions.unionByName(asking)), "jaccard-passed")
    opened = passed.select("x", "y").distinct()
    sides = [
        pairs.where("x = y").join(members, F.col("x") == members.shelf).withColumn("role", F.lit(1)),
        opened.join(members, F.col("y") == members.shelf).withColumn("role", F.lit(0)),
        passed.withColumnRenamed("node", "__node")
        .join(members, (F.col("x") == members.shelf) & (F.col("__node") == members.node))
        .withColumn("role", F.lit(1)),
    ]
    columns = ["x", "y", "role", "label", "node", "tokens"]
    return _open(sides[0].select(*columns).unionByName(sides[1].select(*columns)).unionByName(sides[2].select(*columns)))


def op8_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    """Contract query: the component of every whole document."""
    return components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP8_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
    lambda x: x <> '') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM words, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS r(i) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM shingles AS a JOIN shingles AS b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM common JOIN sizes AS a ON a.doc_id = x JOIN sizes AS b ON b.doc_id = y
  WHERE 100 * c >= 80 * (a.n + b.n - c)),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.y FROM reach AS r JOIN links AS l ON l.x = r.other)
SELECT doc_id, coalesce(max(n), 0) AS n_shingles, min(other) AS component_id
FROM reach LEFT JOIN sizes USING (doc_id) GROUP BY doc_id
"""
