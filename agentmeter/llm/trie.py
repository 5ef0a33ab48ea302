"""Prefix trie of conversations by union-find over the LCP edges of sorted neighbours.

Every distinct sequence of a conversation's first d turns is a node. Conversations are cut into
blocks of `block` turns, so that no row grows with a conversation; blocks that start at the same
node make a subtrie. Distinct blocks are sorted over all partitions, and within a partition
neighbours are joined in descending order of their longest common prefix (LCP): a merge of two
components makes a branching node, or widens one of the same depth. The turns between branching
nodes are the unary nodes of the trie.

A partition's forest is contracted to what others can change: nodes that its first or last block
shares with the partition before or after, and those where subtries meet. Their counts add up in
one Spark aggregate by node; all other nodes are whole at once. Sums over subtrees add up
the same way: a node counts its words once, where it begins. Subtries below others hand their sums
up by pointer doubling, so that a conversation of many blocks takes logarithmically many steps.

A turn is a 128-bit prefix of the SHA-256 of its role and text; a prefix is the exclusive or of
two 64-bit hashes of each turn with its place. Positions of turns come from range partitions that are
numbered on their own and shifted, so that a conversation with a third of all turns is no one task.

Defined results: rows without conv_id belong to no conversation; a null role or text is empty;
turns null come first; equal turns go in the order of their SHA-256, repeated rows after one
another; a conversation whose turns all give way to an absent or shorter base may have none and
ends at the root; an empty table gives no node; other columns are not carried.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, forget, repeated, saved

#: Bytes of a turn in a block.
TURN = 16
NOTHING = hashlib.sha256(b"").hexdigest()


def numbered(turns: DataFrame) -> DataFrame:
    """conv, pos (from 0), token, words of every turn, and h, b, depth of its conversation; convs besides.

    h: how many own turns give way; b: how many of the base conversation stand in their place.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    token = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * TURN)
    rows = turns.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), "turn", token.alias("token"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    rows = rows.groupBy("conv", "turn", "token").agg(F.count("*").alias("times"), F.max("words").alias("words"))
    parts = saved(rows.repartitionByRange("conv", "turn", "token").withColumn("part", F.spark_partition_id()))
    counts = saved(parts.groupBy("conv", "part").agg(F.sum("times").alias("held")))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    convs = counts.groupBy("conv").agg(F.sum("held").alias("turns")).withColumn("h", F.crc32(F.col("conv").cast("string").cast("binary")) % 4)
    bases = convs.select(F.col("conv").alias("base"), F.col("turns").alias("base_turns"))
    convs = convs.withColumn("base", F.col("conv") - F.col("conv") % 20).join(bases, "base", "left")
    convs = convs.withColumn("b", F.least("h", F.coalesce("base_turns", F.lit(0))))
    convs = saved(convs.select("conv", "base", "h", "b", (F.col("b") + F.greatest(F.col("turns") - F.col("h"), F.lit(0))).alias("depth")))
    shift = counts.withColumn("before", F.coalesce(F.sum("held").over(before(Window.partitionBy("conv").orderBy("part"))), F.lit(0))).join(convs, "conv")
    within = F.coalesce(F.sum("times").over(before(Window.partitionBy("part", "conv").orderBy("turn", "token"))), F.lit(0))
    placed = parts.withColumn("within", within).join(shift.drop("held", "base"), ["conv", "part"])
    placed = repeated(placed, "times").withColumn("pos", F.col("before") + F.col("within") + F.col("_copy"))
    out = saved(placed.select("conv", "pos", "token", "words", "h", "b", "depth"))
    forget(parts, counts)
    out.convs = convs
    return out


def blocks(turns: DataFrame, block: int) -> DataFrame:
    """conv, k, tokens, words, x1, x2, going of every rebuilt conversation's blocks; going: it goes on after this one.

    x1, x2: the exclusive or of the block's turns' hashes.
    """
    placed = numbered(turns)
    convs = placed.convs
    tails = placed.filter("pos >= h").select("conv", (F.col("pos") - F.col("h") + F.col("b")).alias("pos"), "token", "words", "depth")
    heads = placed.filter("pos < 3 and conv % 20 = 0").select(F.col("conv").alias("base"), "pos", "token", "words")
    taken = convs.select("conv", "base", "b", "depth").join(heads, "base").filter("pos < b").select("conv", "pos", "token", "words", "depth")
    x = [F.xxhash64(F.lit(i), "pos", "token").alias(f"x{i}") for i in (1, 2)]
    rebuilt = tails.unionByName(taken).withColumn("k", F.floor(F.col("pos") / block)).select("*", *x)
    own = rebuilt.groupBy("conv", "k").agg(F.sort_array(F.collect_list(F.struct("pos", "token", "words"))).alias("t"), F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"), F.max("depth").alias("depth"))
    tokens = F.unhex(F.array_join(F.col("t.token"), ""))
    some = own.select("conv", "k", tokens.alias("tokens"), F.col("t.words").alias("words"), "x1", "x2", (F.col("depth") > (F.col("k") + 1) * block).alias("going"))
    zero = F.lit(0).cast("long")
    none = convs.filter("depth = 0").select("conv", zero.alias("k"), F.lit(b"").alias("tokens"), F.array().cast("array<long>").alias("words"), zero.alias("x1"), zero.alias("x2"), F.lit(False).alias("going"))
    out = saved(some.unionByName(none))
    out.layers = -(-(convs.agg(F.max("depth")).first()[0] or 0) // block)
    forget(placed, convs)
    return out


def shared(a: bytes, b: bytes) -> int:
    """How many turns two blocks share at their begin."""
    low, high = 0, min(len(a), len(b)) // TURN
    while low < high:
        mid = (low + high + 1) // 2
        if a[: mid * TURN] == b[: mid * TURN]:
            low = mid
        else:
            high = mid - 1
    return low


class Forest:
    """The trie of sorted distinct sequences: nodes with depth, first and last sequence, kids, and the sequence that ends there."""

    def __init__(self, keys: list[bytes]):
        n = len(keys)
        self.depth = [len(x) // TURN for x in keys]
        self.first, self.last = list(range(n)), list(range(n))
        self.kids: list[list[int]] = [[] for _ in range(n)]
        self.row: list[int | None] = list(range(n))
        lcp = [shared(keys[i], keys[i + 1]) for i in range(n - 1)]
        above, top = list(range(n)), list(range(n))

        def find(i: int) -> int:
            while above[i] != i:
                above[i] = above[above[i]]
                i = above[i]
            return i

        for i in sorted(range(n - 1), key=lambda i: -lcp[i]):
            x, y = find(i), find(i + 1)
            above[y] = x
            top[x] = self._joined(top[x], top[y], lcp[i])
        self.top = top[find(0)]

    def _joined(self, a: int, b: int, d: int) -> int:
        """The node at depth d over two neighbouring components, a before b."""
        if self.depth[a] == d and self.depth[b] == d:
            self.kids[a] += self.kids[b]
            self.last[a] = self.last[b]
            return a
        if self.depth[a] == d:
            self.kids[a].append(b)
            self.last[a] = self.last[b]
            return a
        if self.depth[b] == d:
            self.kids[b].append(a)
            self.first[b] = self.first[a]
            return b
        self.depth.append(d)
        self.first.append(self.first[a])
        self.last.append(self.last[b])
        self.kids.append([a, b])
        self.row.append(None)
        return len(self.depth) - 1

    def upwards(self) -> list[tuple[int, int | None]]:
        """(node, its parent), kids before their parents."""
        out, todo = [], [(self.top, None)]
        while todo:
            out.append(todo.pop())
            todo += [(c, out[-1][0]) for c in self.kids[out[-1][0]]]
        return out[::-1]


#: What a partition says of a node. keyed: others may add to it. id: its key; p: its parent's, where that is
#: keyed. a, b: sums of members x words and of words in its subtree; ta, tb, tl: those of a whole subtrie, at its
#: top; e: the key of the conversations that end there.
NODE = (
    "pid long, keyed boolean, depth long, id1 long, id2 long, p1 long, p2 long, conv long, parent_conv long, n long, kids long, "
    "leaves long, a long, b long, tl long, ta long, tb long, e1 long, e2 long"
)
_NAMES = [x.split()[0] for x in NODE.split(", ")]


def grown(pid: int, k: int, root: tuple[int, int], run: list, left: int, right: int, block: int) -> Iterator[tuple]:
    """The nodes of one partition's part of a subtrie.

    run: sorted (tokens, words, n, conv, going, e1, e2, below_leaves, below_saved). left, right: the
    turns that its first and last block share with the partition before and after, -1 if not of this subtrie.
    """
    keys = [r[0] for r in run]
    f, end, base = Forest(keys), len(run) - 1, k * block
    size = len(f.depth)
    n, conv, leaves, a, b = [0] * size, [0] * size, [0] * size, [0] * size, [0] * size
    opened = lambda v, d: d <= left and f.first[v] == 0
    keyed = lambda v, d: d in (0, block) or opened(v, d) or (d <= right and f.last[v] == end)

    def key(v: int, d: int) -> tuple[int, int]:
        if d == 0:
            return root
        if d == block:
            return run[f.row[v]][5:7]
        return struct.unpack(">qq", hashlib.blake2b(struct.pack(">qqq", k, *root) + keys[f.first[v]][: d * TURN], digest_size=16).digest())

    # a[v], b[v]: of what lies under v, then of v's own turns down from its parent too
    for v, up in f.upwards():
        row, kids = f.row[v], f.kids[v]
        n[v], leaves[v], a[v], b[v] = (sum(x[c] for c in kids) for x in (n, leaves, a, b))
        held = [conv[c] for c in kids]
        ends = (None, None)
        if row is not None:
            _, _, own, first, going, e1, e2, below_leaves, below_saved = run[row]
            n[v] += own
            held.append(first)
            leaves[v] += below_leaves + (not kids and not going and not (row == end and right == f.depth[v]))
            a[v] += below_saved
            ends = (e1, e2) if own > going else ends
        conv[v] = min(held)
        words, above = run[f.first[v]][1], f.depth[up] if up is not None else -1
        for d in range(f.depth[v], above, -1):
            kids_here = sum(not opened(c, d + 1) for c in kids) if d == f.depth[v] else int(not opened(v, d + 1))
            e = ends if d == f.depth[v] else (None, None)
            if d == 0 and k:  # the node itself belongs to the subtrie above
                yield (pid, True, base, *root, None, None, None, None, 0, kids_here, 0, 0, 0, leaves[v], a[v], b[v], None, None)
                continue
            if d:
                a[v] += n[v] * words[d - 1]
                b[v] += 0 if opened(v, d) else words[d - 1]
            at = v if d - 1 > above or up is None else up  # the compressed node of the parent
            own_key = key(v, d) if keyed(v, d) else (None, None)
            parent = key(at, d - 1) if d and keyed(at, d - 1) else (None, None)
            whole_parent = at if d and parent[0] is None else None
            yield (pid, own_key[0] is not None, base + d, *own_key, *parent, conv[v], whole_parent, n[v], kids_here, leaves[v], a[v], b[v], 0, 0, 0, *e)
    # parents that are whole get their smallest member below, once it is known
    yield ("conv", conv)


def contracted(ordered: DataFrame, bounds: DataFrame, block: int) -> DataFrame:
    """NODE rows of every partition's forest."""

    def forest(key: tuple, rows: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        pid, out, near = int(key[0]), [], near.iloc[0]
        rows = rows.sort_values(["k", "r1", "r2", "tokens"])
        runs = [(at, list(own[["tokens", "words", "n", "conv", "going", "e1", "e2", "below_leaves", "below_saved"]].itertuples(index=False, name=None))) for at, own in rows.groupby(["k", "r1", "r2"], sort=True)]

        def meets(side: str, at: tuple, tokens: bytes) -> int:
            if pd.isna(near[f"{side}_k"]) or tuple(int(near[f"{side}_{c}"]) for c in ("k", "r1", "r2")) != tuple(map(int, at)):
                return -1
            return shared(bytes(near[f"{side}_tokens"]), tokens)

        for i, (at, run) in enumerate(runs):
            run = [(bytes(r[0]), [int(x) for x in r[1]], *map(int, r[2:])) for r in run]
            left = meets("prev", at, run[0][0]) if i == 0 else -1
            right = meets("next", at, run[-1][0]) if i == len(runs) - 1 else -1
            own = list(grown(pid, int(at[0]), (int(at[1]), int(at[2])), run, left, right, block))
            conv = own.pop()[1]
            out += [r if r[8] is None else (*r[:8], conv[r[8]], *r[9:]) for r in own]
        frame = pd.DataFrame(out, columns=_NAMES, dtype=object)  # not as floats, which do not hold 64 bits
        return frame.astype({c: "boolean" if c == "keyed" else "Int64" for c in _NAMES})

    return ordered.groupBy("pid").cogroup(bounds.groupBy("pid")).applyInPandas(forest, NODE)


def below(nodes: DataFrame, distinct: DataFrame, layers: int) -> DataFrame:
    """k, r1, r2, leaves, saved of each subtrie below another, with all that hangs below it; by pointer doubling."""
    top = nodes.filter("keyed and (tl <> 0 or ta <> 0)").groupBy("depth", "id1", "id2").agg(F.sum("tl").alias("leaves"), (F.sum("ta") - F.sum("tb")).alias("saved"))
    up = distinct.filter("going > 0").select((F.col("k") + 1).alias("k"), F.col("e1").alias("r1"), F.col("e2").alias("r2"), F.struct("k", F.col("r1").alias("r1"), F.col("r2").alias("r2")).alias("jump"))
    own = top.select(F.col("depth").alias("d"), F.col("id1").alias("r1"), F.col("id2").alias("r2"), "leaves", "saved")
    subs = saved(up.join(own.drop("d"), ["r1", "r2"], "left").select(F.struct("k", "r1", "r2").alias("s"), F.when(F.col("jump.k") > 0, F.col("jump")).alias("jump"), F.coalesce("leaves", F.lit(0)).alias("leaves"), F.coalesce("saved", F.lit(0)).alias("saved")))
    reach = 1
    while reach < layers:
        more = subs.filter("jump is not null").groupBy("jump").agg(F.sum("leaves").alias("l"), F.sum("saved").alias("v")).withColumnRenamed("jump", "s")
        far = subs.select(F.col("s").alias("jump"), F.col("jump").alias("far"))
        next_ = subs.filter("jump is not null").join(far, "jump").select("s", F.col("far").alias("jump"), "leaves", "saved").unionByName(subs.filter("jump is null"))
        new = saved(next_.join(more, "s", "left").select("s", "jump", (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("v", F.lit(0))).alias("saved")))
        forget(subs)
        subs, reach = new, 2 * reach
    out = subs.select("s.*", F.col("leaves").alias("below_leaves"), F.col("saved").alias("below_saved"))
    out._saved_at = subs._saved_at
    return out


def digests(ends: DataFrame) -> DataFrame:
    """e1, e2, depth, ends_sha256: of the ids of the conversations that end at a node, ascending, in one string.

    Ids are joined in groups of at most 4096 neighbours; the hash takes these one after the other.
    """
    near = ends.groupBy("depth", "e1", "e2", F.shiftright("conv", 12).alias("lot")).agg(F.array_join(F.sort_array(F.collect_list("conv")).cast("array<string>"), ",").alias("ids"))

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, now = None, None
        for batch in batches:
            out = []
            for depth, e1, e2, ids in batch[["depth", "e1", "e2", "ids"]].itertuples(index=False, name=None):
                if at != (depth, e1, e2):
                    if at is not None:
                        out.append((*at, now.hexdigest()))
                    at, now = (depth, e1, e2), hashlib.sha256(ids.encode())
                else:
                    now.update(b"," + ids.encode())
            yield pd.DataFrame(out, columns=["depth", "e1", "e2", "ends_sha256"])
        if at is not None:
            yield pd.DataFrame([(*at, now.hexdigest())], columns=["depth", "e1", "e2", "ends_sha256"])

    dealt = near.repartition("depth", "e1", "e2").sortWithinPartitions("depth", "e1", "e2", "lot")
    return dealt.mapInPandas(hashed, "depth long, e1 long, e2 long, ends_sha256 string")


def prefix_trie(turns: DataFrame, block: int = 128, part_rows: int = 4096, part_turns: int = 100_000) -> DataFrame:
    """A row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns: conv_id, turn, role, text. A partition of the sorted blocks holds about part_rows blocks and part_turns turns.
    """
    own = blocks(turns, block)
    none = F.lit(0).cast("long")
    if own.layers > 1:
        before = Window.partitionBy("conv").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
        placed = own.select("*", *[F.coalesce(F.bit_xor(f"x{i}").over(before), none).alias(f"r{i}") for i in (1, 2)])
    else:
        placed = own.select("*", none.alias("r1"), none.alias("r2"))
    placed = placed.select("*", F.col("r1").bitwiseXOR(F.col("x1")).alias("e1"), F.col("r2").bitwiseXOR(F.col("x2")).alias("e2"))
    depth = F.col("k") * block + F.size("words")
    ends = saved(digests(placed.filter("not going").select(depth.alias("depth"), "e1", "e2", "conv")))
    rows = placed.groupBy("k", "r1", "r2", "tokens").agg(
        F.count("*").alias("n"), F.min("conv").alias("conv"), F.count_if("going").alias("going"), F.first("words").alias("words"), F.first("e1").alias("e1"), F.first("e2").alias("e2")
    )
    distinct = saved(rows)
    forget(own)
    n, held = distinct.agg(F.count("*"), F.sum(F.size("words"))).first()
    parts = max(1, -(-n // part_rows), -(-(held or 0) // part_turns))
    ordered = saved(distinct.repartitionByRange(parts, "k", "r1", "r2", "tokens").withColumn("pid", F.spark_partition_id().cast("long")))
    edge = ordered.groupBy("pid").agg(*[f(F.struct("k", "r1", "r2", "tokens")).alias(c) for c, f in (("lo", F.min), ("hi", F.max))])
    line = Window.orderBy("pid")  # a row per partition of the sorted blocks
    prev, after = F.lag("hi").over(line), F.lead("lo").over(line)
    edge = edge.select("pid", prev.alias("prev"), after.alias("next"))
    bounds = saved(edge.select("pid", *[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in ("prev", "next") for c in ("k", "r1", "r2", "tokens")]))
    nodes = saved(contracted(ordered.withColumns({"below_leaves": none, "below_saved": none}), bounds, block))
    if own.layers > 1:
        under = below(nodes, distinct, own.layers)
        keyed = ordered.withColumns({"up": F.when(F.col("going") > 0, F.struct((F.col("k") + 1).alias("k"), F.col("e1").alias("r1"), F.col("e2").alias("r2")))})
        under = under.select(F.struct("k", "r1", "r2").alias("up"), "below_leaves", "below_saved")
        with_below = keyed.filter("going > 0").join(under, "up", "left").drop("up").fillna(0, ["below_leaves", "below_saved"])
        again = with_below.unionByName(ordered.filter("going = 0").withColumns({"below_leaves": none, "below_saved": none}))
        first, nodes = nodes, saved(contracted(again, bounds, block))
        forget(first, under)
    merged = nodes.filter("keyed").groupBy("depth", "id1", "id2").agg(
        F.min("conv").alias("conv"), *[F.sum(c).alias(c) for c in ("n", "kids", "leaves")], (F.sum("a") - F.sum("b")).alias("saved"), *[F.min(c).alias(c) for c in ("parent_conv", "p1", "p2", "e1", "e2")]
    )
    merged = saved(merged)
    forget(distinct, ordered, bounds)
    up = merged.select((F.col("depth") + 1).alias("depth"), F.col("id1").alias("p1"), F.col("id2").alias("p2"), F.col("conv").alias("up_conv"))
    whole = nodes.filter("not keyed").withColumn("saved", F.col("a") - F.col("b"))
    # a partition asks once for a parent, so that a node with very many children is no hot key
    asked = whole.filter("p1 is not null").select("pid", "depth", "p1", "p2").distinct().join(up, ["depth", "p1", "p2"])
    cols = ["conv", "depth", "parent_conv", "n", "kids", "leaves", "saved", "e1", "e2"]
    found = lambda df: df.drop("parent_conv").withColumnRenamed("up_conv", "parent_conv").select(*cols)
    every = (
        whole.filter("p1 is null").select(*cols)
        .unionByName(found(whole.filter("p1 is not null").join(asked, ["pid", "depth", "p1", "p2"])))
        .unionByName(merged.filter("p1 is null").select(*cols))
        .unionByName(found(merged.filter("p1 is not null").join(up, ["depth", "p1", "p2"])))
    )
    ended = every.filter("e1 is not null").join(ends, ["depth", "e1", "e2"]).select(*cols, "ends_sha256")
    out = ended.unionByName(every.filter("e1 is null").select(*cols, F.lit(NOTHING).alias("ends_sha256")))
    return out.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), "ends_sha256",
    )
