"""Prefix trie of conversations, by adaptive radix trees over fixed-width turn ids.

A turn's id is the 16 bytes of an MD5 over its role and text; a conversation's key is its turns' ids one after
another, so keys compare byte by byte, big end first. Equal keys become one row with the number of conversations
and the smallest id. The distinct keys are dealt by range into parts of a bounded number of bytes, and every part
builds an adaptive radix tree: inner nodes of 4, 16, 48 or 256 places, grown as they fill, with compressed paths.
Only byte depths that are whole turns emit a trie node; those inside a compressed path emit theirs too.

A node's keys are a run in key order, so only nodes on a part's first or last path can go on in another part.
What is kept of these can be added up: a part knows the last key before it and the first key after it, so of every
node exactly one part, the first, counts the node itself as a child or towards its text; members, leaves and
weighted text lengths add anyway. A node of several parts is one grouped sum over a few rows for each part, and no
step follows the depth or the size of a group: a first turn that a third of all conversations share is spread over
as many parts as its keys fill, and copies of one conversation are one key.

The ids of the conversations that end at a node are joined in blocks of ``ID_BLOCK`` ids each; where a node has
several, one pass over its blocks in order hashes them, a batch at a time.

Edge cases: rows without ``conv_id`` take no part; null roles and texts count as empty; null turns come first;
turns of one number are ordered by their id, repeated ones all count; a conversation without turns is a member of
the root alone; an empty table has no root and no rows; other columns are left out. One conversation's key (16
bytes a turn), never its texts, has to fit in a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, query, stored, table

WIDTH = 16
PART_BYTES = 8 << 20
LEAST_PART = 1 << 16
ID_BLOCK = 4096
NO_IDS = hashlib.sha256(b"").hexdigest()

# ---------------------------------------------------------------- the tree


class Node:
    """``prefix``: the compressed path to this node, after the byte that leads to it. ``value``: the number of the
    key that ends here. Up to 16 children are found by their byte in ``keys``, up to 48 through an index of 256
    places, more in a table of 256."""

    __slots__ = ("keys", "kids", "places", "prefix", "value")

    def __init__(self, prefix: bytes, value: int | None = None):
        self.prefix, self.value = prefix, value
        self.places, self.keys, self.kids = 0, b"", ()

    def find(self, byte: int) -> Node | None:
        if self.places <= 16:
            at = self.keys.find(byte) if self.keys else -1
            return self.kids[at] if at >= 0 else None
        if self.places == 48:
            at = self.keys[byte]
            return self.kids[at - 1] if at else None
        return self.kids[byte]

    def put(self, byte: int, kid: Node) -> None:
        """Set the child for ``byte``, in a larger layout if this one is full."""
        if self.places <= 16:
            if not self.places:
                self.places, self.keys, self.kids = 4, bytearray(), []
            at = self.keys.find(byte)
            if at >= 0:
                self.kids[at] = kid
                return
            if len(self.kids) < self.places or self.places == 4:
                self.places = 4 if len(self.kids) < 4 else 16
                at = sum(b < byte for b in self.keys)
                self.keys.insert(at, byte)
                self.kids.insert(at, kid)
                return
            index = bytearray(256)
            for n, b in enumerate(self.keys):
                index[b] = n + 1
            self.places, self.keys = 48, index
        if self.places == 48:
            at = self.keys[byte]
            if at:
                self.kids[at - 1] = kid
                return
            if len(self.kids) < 48:
                self.kids.append(kid)
                self.keys[byte] = len(self.kids)
                return
            wide = [None] * 256
            for b in range(256):
                if self.keys[b]:
                    wide[b] = self.kids[self.keys[b] - 1]
            self.places, self.keys, self.kids = 256, b"", wide
        self.kids[byte] = kid

    def children(self) -> Iterator[Node]:
        """In the order of their bytes."""
        if self.places <= 16:
            yield from self.kids
        elif self.places == 48:
            yield from (self.kids[at - 1] for at in self.keys if at)
        else:
            yield from (kid for kid in self.kids if kid is not None)


def shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while low + 1 < high:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def insert(root: Node, key: bytes, value: int) -> None:
    node, above, byte, at = root, None, 0, 0
    while True:
        path = node.prefix
        n = shared(path, key[at: at + len(path)])
        if n < len(path):
            fork = Node(path[:n])
            node.prefix = path[n + 1:]
            fork.put(path[n], node)
            if at + n == len(key):
                fork.value = value
            else:
                fork.put(key[at + n], Node(key[at + n + 1:], value))
            above.put(byte, fork)
            return
        at += n
        if at == len(key):
            node.value = value
            return
        above, byte = node, key[at]
        node = node.find(byte)
        if node is None:
            above.put(byte, Node(key[at + 1:], value))
            return
        at += 1


def tree(keys: list[bytes]) -> Node:
    """The tree of distinct keys; the root's own path stays empty."""
    root = Node(b"")
    for value, key in enumerate(keys):
        insert(root, key, value)
    return root


# ---------------------------------------------------------------- nodes of one part

NODE = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()),
                  ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()),
                  ("turn_id", pa.binary()), ("node", pa.binary()), ("parent", pa.binary())])
NODE_SQL = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
            "ends_sha256 string, turn_id binary, node binary, parent binary")


def path_ids(key: bytes, depth: int) -> list[bytes]:
    """Ids of the nodes on a key's path, down to ``depth``."""
    h, out = hashlib.md5(), [hashlib.md5().digest()]
    for d in range(depth):
        h.update(key[d * WIDTH: (d + 1) * WIDTH])
        out.append(h.copy().digest())
    return out


def nodes(keys: list[bytes], convs: list[int], least: list[int], chars: list, ends: list[str],
          before: bytes | None, after: bytes | None) -> list[tuple]:
    """Rows like ``NODE`` for a part's distinct keys in order. ``before``, ``after``: the neighbours' last and first
    key. ``node`` is set where another part may have the node too, ``parent`` where this holds for its parent."""
    left = -1 if before is None else shared(before, keys[0]) // WIDTH
    right = -1 if after is None else shared(after, keys[-1]) // WIDTH
    on_left = path_ids(keys[0], left)
    on_right = path_ids(keys[-1], right)
    last = len(keys) - 1
    grows_on = after is not None and after.startswith(keys[-1])
    rows: list[list] = []
    # A frame: node, bytes down to it from the root, those down to its parent, children left, members, smallest
    # member, leaves, saved, children that this part counts, rows that wait for their parent, first and last key.
    root = tree(keys)
    stack = [[root, 0, -1, root.children(), 0, None, 0, 0, 0, [], None, None]]
    while stack:
        frame = stack[-1]
        kid = next(frame[3], None)
        if frame[10] is None and frame[0].value is not None:
            at = frame[0].value
            frame[4], frame[5], frame[10], frame[11] = convs[at], least[at], at, at
        if kid is not None:
            stack.append([kid, frame[1] + 1 + len(kid.prefix), frame[1], kid.children(), 0, None, 0, 0, 0, [], None, None])
            continue
        stack.pop()
        node, down, up, _, n, low, leaves, saved, owned, waiting, first, end = frame
        if not node.places and not (node.value == last and grows_on):
            leaves += 1
        value = node.value
        for d in range(down // WIDTH, up // WIDTH if up >= 0 else -1, -1):
            shared_left = first == 0 and d <= left
            border = on_left[d] if shared_left else on_right[d] if end == last and d <= right else None
            own = not shared_left
            size = chars[first][d - 1] if d else 0
            saved += n * size - (size if own else 0)
            row = [low, d, None, n, owned, leaves, saved, ends[value] if value is not None and d * WIDTH == down else None,
                   keys[first][(d - 1) * WIDTH: d * WIDTH] if d else b"", border, None]
            for w in waiting:
                if border is None:
                    w[2] = low
                else:
                    w[10] = border
            rows.append(row)
            waiting, owned = [row], int(own)
        if stack:
            top = stack[-1]
            top[4] += n
            top[5] = low if top[5] is None else min(top[5], low)
            top[6] += leaves
            top[7] += saved
            top[8] += owned
            top[9] = waiting if not top[9] else top[9] + waiting if len(top[9]) < 16 else _extended(top[9], waiting)
            top[10] = first if top[10] is None else top[10]
            top[11] = end
    return rows


def _extended(a: list, b: list) -> list:
    a.extend(b)
    return a


def _part(rows: pa.Table) -> pa.Table:
    held = {c: rows.column(c).to_pylist() for c in ("key", "n", "least", "chars", "ends")}
    order = sorted(range(rows.num_rows), key=held["key"].__getitem__)
    keys, n, least, chars, ends = ([held[c][i] for i in order] for c in ("key", "n", "least", "chars", "ends"))
    out = nodes(keys, n, least, chars, ends, rows.column("before")[0].as_py(), rows.column("after")[0].as_py())
    return pa.Table.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(NODE)], schema=NODE)


# ---------------------------------------------------------------- Spark


def turn_id() -> Column:
    """16 bytes for a turn's role and text."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    return F.unhex(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)))


def ordered_turns(turns: DataFrame) -> DataFrame:
    """``(conv_id, turns)``: each conversation's turns in order, as ``(turn, id, chars)``."""
    rows = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct("turn", turn_id().alias("id"), F.char_length(F.coalesce("text", F.lit(""))).alias("chars")).alias("t"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def id_hashes(members: DataFrame) -> DataFrame:
    """``(kid, n, least, ends)`` for ``(kid, conv_id)``: members, the smallest, and the hash of all ids in order."""
    blocks = members.groupBy("kid", F.floor(F.col("conv_id") / ID_BLOCK).alias("block")).agg(
        F.sort_array(F.collect_list("conv_id")).alias("ids"))
    blocks = stored(blocks.select("kid", "block", F.size("ids").alias("n"), F.col("ids")[0].alias("least"),
                                  F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids")), "ids")
    whole = blocks.groupBy("kid").agg(F.sum("n").cast("long").alias("n"), F.min("least").alias("least"), F.count("*").alias("blocks"),
                                      F.max(F.sha2("ids", 256)).alias("ends"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kid, h = None, None
        for batch in batches:
            out: list[tuple[bytes, str]] = []
            for k, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k != kid:
                    if kid is not None:
                        out.append((kid, h.hexdigest()))
                    kid, h = k, hashlib.sha256(ids.encode())
                else:
                    h.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.binary(), pa.string()))], ["kid", "ends"])
        if kid is not None:
            yield pa.RecordBatch.from_arrays([pa.array([kid], pa.binary()), pa.array([h.hexdigest()])], ["kid", "ends"])

    several = blocks.join(whole.where("blocks > 1").select("kid"), "kid").repartition("kid").sortWithinPartitions("kid", "block")
    several = several.select("kid", "ids").mapInArrow(hashed, "kid binary, ends string")
    return whole.join(several.withColumnRenamed("ends", "all"), "kid", "left").select("kid", "n", "least", F.coalesce("all", "ends").alias("ends"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie's nodes, from ``(conv_id, turns)`` with ``turns`` an array of structs with ``id`` (16 bytes) and
    ``chars``. Adds ``turn_id``, the id of the node's last turn (empty for the root), by which texts can be joined."""
    spark = conversations.sparkSession
    key = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["id"])), ""))
    convs = conversations.select("conv_id", key.alias("key"), F.transform("turns", lambda t: t["chars"]).alias("chars"))
    convs = stored(convs.withColumn("kid", F.unhex(F.md5("key"))), "keys")
    hashes = id_hashes(convs.select("kid", "conv_id"))
    distinct = convs.select("kid", "key", "chars").dropDuplicates(["kid"])
    rows = stored(distinct.join(hashes, "kid").drop("kid"), "distinct-keys")
    size = rows.agg(F.sum(F.octet_length("key") + 100)).first()[0] or 0
    parts = max(-(-size // PART_BYTES), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // LEAST_PART)), 1)
    ranged = stored(rows.repartitionByRange(parts, "key").withColumn("part", F.spark_partition_id()), "ranged-keys")
    in_order = Window.orderBy("part")  # one row for each part
    edges = ranged.groupBy("part").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    edges = edges.select("part", F.lag("high").over(in_order).alias("before"), F.lead("low").over(in_order).alias("after"))
    found = stored(ranged.join(edges, "part").groupBy("part").applyInArrow(_part, NODE_SQL), "nodes")
    dropped(convs)
    dropped(rows)
    sums = [F.sum(c).cast("long").alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    border = stored(found.where("node IS NOT NULL").groupBy("node", "parent", "depth", "turn_id").agg(
        F.min("conv_id").alias("conv_id"), F.max("ends_sha256").alias("ends_sha256"), *sums), "border")
    above = border.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
               F.coalesce("ends_sha256", F.lit(NO_IDS)).alias("ends_sha256"), "turn_id"]
    inner = found.where("node IS NULL")
    out = inner.where("parent IS NULL").select(*columns)
    out = out.unionByName(inner.where("parent IS NOT NULL").drop("parent_conv_id").join(above, "parent").select(*columns))
    return out.unionByName(border.where("depth > 0").join(above, "parent").select(*columns)).unionByName(
        border.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")).select(*columns))


def with_texts(nodes_: DataFrame, turns: DataFrame) -> DataFrame:
    """Nodes with the role and text of their last turn; the root's are null."""
    of = turns.select(turn_id().alias("turn_id"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return nodes_.join(of.dropDuplicates(["turn_id"]), "turn_id", "left")


def rebuilt(turns: DataFrame) -> DataFrame:
    """``(conv_id, turns)``: conversation c begins with the first h turns of c - c % 100, h = crc32(c) % 6, in place
    of its own first h."""
    own = stored(ordered_turns(turns), "turns")
    heads = own.where("conv_id % 100 = 0").select(F.col("conv_id").alias("base"), F.slice("turns", 1, 5).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).cast("int")
    rows = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % 100).join(heads, "base", "left").withColumn("h", h)
    head = F.expr("slice(coalesce(head, slice(turns, 1, 0)), 1, h)")
    return rows.select("conv_id", F.concat(head, F.expr("slice(turns, h + 1, greatest(size(turns), 1))")).alias("turns"))


ORACLE = """
WITH t AS (
  SELECT conv_id, list(md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) ORDER BY turn NULLS FIRST,
      md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS ids,
    list(length(coalesce(text, '')) ORDER BY turn NULLS FIRST,
      md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS chars
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
bits AS (SELECT conv_id, ids, chars, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(
    string_split(conv_id::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS crc FROM t),
h AS (SELECT conv_id, ids, chars, xor(crc, 4294967295) % 6 AS h FROM bits),
r AS (SELECT h.conv_id, list_concat(coalesce(b.ids[1:h.h], []), h.ids[h.h + 1:]) AS ids,
    list_concat(coalesce(b.chars[1:h.h], []), h.chars[h.h + 1:]) AS chars
  FROM h LEFT JOIN t b ON b.conv_id = h.conv_id - h.conv_id % 100),
p AS (SELECT conv_id, d, array_to_string(ids[1:d], ',') AS path, CASE WHEN d = 0 THEN NULL ELSE array_to_string(ids[1:d - 1], ',') END AS up,
    CASE WHEN d = 0 THEN 0 ELSE chars[d] END AS c, len(ids) = d AS ends
  FROM (SELECT *, unnest(generate_series(0, len(ids))) AS d FROM r)),
n AS (SELECT path, up, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(c) AS c,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends FROM p GROUP BY path, up, d),
k AS (SELECT up, count(*) AS kids FROM n GROUP BY up),
m AS (SELECT n.*, coalesce(k.kids, 0) AS kids FROM n LEFT JOIN k ON k.up = n.path),
s AS (SELECT a.path, sum((b.kids = 0)::INT) AS leaves, sum((b.n_convs - 1) * b.c) AS saved
  FROM m a JOIN m b ON a.d = 0 OR b.path = a.path OR starts_with(b.path, a.path || ',') GROUP BY a.path)
SELECT m.conv_id, m.d AS depth, u.conv_id AS parent_conv_id, m.n_convs, m.kids AS n_children, s.leaves::BIGINT AS n_leaves,
  s.saved::BIGINT AS saved_tokens, m.ends AS ends_sha256
FROM m JOIN s USING (path) LEFT JOIN m u ON u.path = m.up AND m.d > 0
"""


@query("op11_prefix_trie", ORACLE)
def op11_prefix_trie(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return prefix_trie(rebuilt(turns)).drop("turn_id")
