"""A prefix trie of conversations: ternary search trees over dictionary-encoded turns, one a range shard, and a merge of their borders.

Turns are encoded by a dictionary of the distinct (role, text), a saved table. Encoded conversations are sorted by their ids and
then conv_id, and dealt into ranges of about SHARD conversations, so copies of a conversation, however many, spread over shards.
In a shard, distinct sequences go into a ternary search tree, the median first, then the medians of either half. Without
recursion, a walk lists the nodes and a pass back accumulates members, leaves and savings.

Only prefixes of a shard's first and last sequence can stand in another shard too. These border nodes, two paths a shard, leave
with what their other descendants add up to, and one task merges them as a stream in the order of the shards: it keeps the path
that is open, and a node is done when the path leaves it. So it holds one path however many shards there are. It also hashes the members
of a border node as they pass. Nodes below a border node get their parent's conv_id by a join with the merged nodes.

Defined results: turns are ordered by turn, null first, ties by a digest of role and text; a null role or text is empty; rows without
conv_id take no part; repeated rows are turns of their own; an empty table has no node. Only conv_id, turn, role and text are
read. The ids of one conversation, some 30 bytes a turn, are gathered in one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.components import save
from quarrylight.llm.frames import released

SHARD = 32_768
INSIDE, BELOW, BORDER = 0, 1, 2
_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, key string, parent_key string"
_BORDER = "shard long, place long, turn_id long, turn_bytes long, ends string"
_EMPTY = hashlib.sha256().hexdigest()


def encode(turns: DataFrame) -> DataFrame:
    """(conv_id, ids, sizes): the dictionary ids of a conversation's turns in order, and the UTF-8 bytes of their texts."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    code = F.unhex(F.md5(F.concat(F.length(word("role")).cast("string"), F.lit(":"), word("role"), word("text")).cast("binary")))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), code.alias("code"), F.octet_length(word("text")).cast("long").alias("size")).where("conv_id IS NOT NULL")
    words = save(rows.groupBy("code").agg(F.min("size").alias("size")).withColumn("id", F.monotonically_increasing_id()))
    coded = rows.drop("size").join(words.hint("merge"), "code")
    seq = F.sort_array(F.collect_list(F.struct("turn", "code", "id", "size")))
    return coded.groupBy("conv_id").agg(seq.alias("s")).select("conv_id", F.col("s.id").alias("ids"), F.col("s.size").alias("sizes"))


def rebuilt(coded: DataFrame, group: int = 5, most: int = 9) -> DataFrame:
    """Conversations that begin as their group's first one does: its first h turns, then the own ones after h, with h = crc32(conv_id) % most.

    A group is ``group`` ids long and brought together in a row.
    """
    first = F.col("conv_id") - F.pmod("conv_id", F.lit(group))
    rows = coded.withColumn("first", first).groupBy("first").agg(F.collect_list(F.struct("conv_id", "ids", "sizes")).alias("all"))
    lead = F.get(F.filter("all", lambda x: x["conv_id"] == F.col("first")), F.lit(0))
    each = rows.select(lead.alias("lead"), F.explode("all").alias("own"))
    h = (F.crc32(F.col("own.conv_id").cast("string").cast("binary")) % most).cast("int")
    none = F.array().cast("array<bigint>")
    joined = lambda c: F.concat(F.slice(F.coalesce(F.col("lead")[c], none), 1, h), F.slice(F.col("own")[c], h + 1, F.size(F.col("own")[c])))
    return each.select("own.conv_id", joined("ids").alias("ids"), joined("sizes").alias("sizes"))


class Trie:
    """A ternary search tree over id sequences. Node 0 is the textless root; a node's eq is the root of the tree of its children."""

    def __init__(self) -> None:
        self.split, self.lo, self.eq, self.hi = [0], [-1], [-1], [-1]
        self.size, self.members, self.least = [0], [0], [None]
        self.ends: dict[int, str] = {}

    def _new(self, turn: int, size: int) -> int:
        for field, value in ((self.split, turn), (self.lo, -1), (self.eq, -1), (self.hi, -1), (self.size, size), (self.members, 0), (self.least, None)):
            field.append(value)
        return len(self.split) - 1

    def insert(self, ids: list[int], sizes: list[int]) -> list[int]:
        """The nodes of a sequence, from the root on; those that were missing are made."""
        path = [0]
        for turn, size in zip(ids, sizes, strict=True):
            if (t := self.eq[path[-1]]) < 0:
                t = self.eq[path[-1]] = self._new(turn, size)
            while self.split[t] != turn:
                side = self.lo if turn < self.split[t] else self.hi
                if side[t] < 0:
                    side[t] = self._new(turn, size)
                t = side[t]
            path.append(t)
        return path

    def walk(self) -> tuple[list[int], list[int], list[int]]:
        """(nodes, the parent of each, the depth of each): parents before children, siblings by turn id."""
        order, parent, depth = [0], [-1] * len(self.split), [0] * len(self.split)
        stack: list[tuple[int, int]] = []

        def push(t: int, above: int) -> None:
            while t >= 0:
                stack.append((t, above))
                t = self.lo[t]

        push(self.eq[0], 0)
        while stack:
            t, above = stack.pop()
            order.append(t)
            parent[t], depth[t] = above, depth[above] + 1
            push(self.hi[t], above)
            push(self.eq[t], t)
        return order, parent, depth


def medians(n: int) -> Iterator[int]:
    """0 to n-1, the middle one first, then the middles of either half."""
    stack = [(0, n)]
    while stack:
        a, b = stack.pop()
        if a < b:
            yield (m := (a + b) // 2)
            stack += [(m + 1, b), (a, m)]


def shard_nodes(sequences: list[tuple[list[int], list[int], list[int]]], shard: int) -> Iterator[dict]:
    """The nodes of the sorted (ids, sizes, conv_ids) of one shard; border nodes in the order of their paths."""
    trie, border = Trie(), set()
    for k in medians(len(sequences)):
        ids, sizes, convs = sequences[k]
        path = trie.insert(ids, sizes)
        trie.members[path[-1]], trie.least[path[-1]], trie.ends[path[-1]] = len(convs), convs[0], ",".join(map(str, convs))
        if k in (0, len(sequences) - 1):
            border.update(path)
    order, parent, depth = trie.walk()
    n = len(order)
    children, leaves, saved = [0] * n, [0] * n, [0] * n
    for t in reversed(order):
        if t not in border:
            leaves[t] += not children[t]
            saved[t] += (trie.members[t] - 1) * trie.size[t]
        if (above := parent[t]) >= 0:
            trie.members[above] += trie.members[t]
            trie.least[above] = trie.least[t] if trie.least[above] is None else min(trie.least[above], trie.least[t])
            if t not in border:
                children[above] += 1
                leaves[above] += leaves[t]
                saved[above] += saved[t]
    chain = {}
    for place, t in enumerate(order):
        above = parent[t]
        row = {"conv_id": trie.least[t], "depth": depth[t], "n_convs": trie.members[t], "n_children": children[t], "n_leaves": leaves[t], "saved_tokens": saved[t]}
        if t in border:
            chain[t] = chain[above].copy() if above >= 0 else hashlib.md5(usedforsecurity=False)
            chain[t].update(b"%d," % trie.split[t] if above >= 0 else b"")
            yield row | {"kind": BORDER, "key": chain[t].hexdigest(), "parent_key": chain[above].hexdigest() if above >= 0 else None, "shard": shard, "place": place, "turn_id": trie.split[t], "turn_bytes": trie.size[t], "ends": trie.ends.get(t)}
        else:
            ends = hashlib.sha256(trie.ends[t].encode()).hexdigest() if t in trie.ends else _EMPTY
            own = {"kind": BELOW, "parent_key": chain[above].hexdigest()} if above in border else {"kind": INSIDE, "parent_conv_id": trie.least[above]}
            yield row | own | {"ends_sha256": ends}


def merge_border(rows: Iterator[dict]) -> Iterator[dict]:
    """The border nodes of all shards, in order of shard and place, merged where their paths are the same."""
    open_: list[dict] = []

    def close(depth: int) -> Iterator[dict]:
        while len(open_) > depth:
            x = open_.pop()
            x["n_leaves"] += not x["n_children"]
            x["saved_tokens"] += (x["n_convs"] - 1) * x["turn_bytes"]
            x["ends_sha256"] = x.pop("hash").hexdigest()
            if open_:
                for c, v in (("n_children", 1), ("n_leaves", x["n_leaves"]), ("saved_tokens", x["saved_tokens"])):
                    open_[-1][c] += v
            yield x

    for row in rows:
        d = row["depth"]
        if d < len(open_) and open_[d]["turn_id"] == row["turn_id"]:
            node = open_[d]
            for c in ("n_convs", "n_children", "n_leaves", "saved_tokens"):
                node[c] += row[c]
            node["conv_id"] = min(node["conv_id"], row["conv_id"])
        else:
            yield from close(d)
            node = row | {"hash": hashlib.sha256(), "started": False}
            open_.append(node)
        if row["ends"] is not None:
            node["hash"].update(("," if node["started"] else "").encode() + row["ends"].encode())
            node["started"] = True
    yield from close(0)


def _batches(rows: Iterator[dict], schema: pa.Schema, most: int = 4096) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    yield pa.RecordBatch.from_pylist(held, schema)


def _schema(text: str) -> pa.Schema:
    return pa.schema([(c.split()[0], pa.int64() if c.split()[1] == "long" else pa.string()) for c in text.split(", ")])


def trie(coded: DataFrame, shard: int = SHARD) -> DataFrame:
    """A row for each distinct prefix of the (conv_id, ids, sizes), the empty one included.

    conv_id: the smallest member; parent_conv_id: the parent's; n_convs: members; n_children, n_leaves, saved_tokens: of the subtree;
    ends_sha256: of the members that end there, ascending, comma-joined.
    """
    coded = save(coded)
    shards = max(1, -(-coded.count() // shard))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[list[int], list[int], list[int]]] = []
        for batch in batches:
            for ids, sizes, conv in zip(*[batch.column(c).to_pylist() for c in ("ids", "sizes", "conv_id")], strict=True):
                if found and found[-1][0] == ids:
                    found[-1][2].append(conv)
                else:
                    found.append((ids, sizes, [conv]))
        if found:
            yield from _batches(shard_nodes(found, TaskContext.get().partitionId()), _schema(f"kind long, {_NODE}, {_BORDER}"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(merge_border(row for batch in batches for row in batch.to_pylist()), _schema(_NODE))

    dealt = coded.repartitionByRange(shards, "ids", "conv_id").sortWithinPartitions("ids", "conv_id").select("conv_id", "ids", "sizes")
    nodes = save(dealt.mapInArrow(released(build), f"kind long, {_NODE}, {_BORDER}"))
    # two paths a shard: one task merges them as a stream
    border = save(nodes.where(F.col("kind") == BORDER).repartition(1).sortWithinPartitions("shard", "place").mapInArrow(released(merge), _NODE))
    columns = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
    below = nodes.where(F.col("kind") == BELOW).select(border.columns).unionByName(border).drop("parent_conv_id")
    parents = border.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    named = below.join(parents.hint("merge"), "parent_key", "left")
    return nodes.where(F.col("kind") == INSIDE).select(*columns).unionByName(named.select(*columns))
