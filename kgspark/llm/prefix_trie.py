"""Prefix trie of conversations: leaf-peeling message passing over paths of the trie.

Texts do not move: each turn becomes a digest and a length. A node is a
distinct prefix, known by an order-aware 128-bit hash of its turns that running XORs give, so
no conversation has to fit into one task. Each node belongs to the path of its
longest member (ties: the smallest id), which cuts the trie into paths that
start below their parent's path and end at a leaf. Peeling works on paths: a path holds the number of
child paths that have not reported; one that waits for none sends its subtree's totals to
the node it hangs from. Inside a path the totals are running sums. So a round
finishes a whole level of paths, and a conversation of many turns takes as few rounds as a short one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from kgspark.operators.hot import join_one, running
from kgspark.session import Scratch, materialise

#: Conversations whose ids stand in one row when the ends of a node are hashed: bounded, whatever a node's number of ends.
CHUNK = 4096
ITEM = ("item", "chars")


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, item (SHA-256 of role and text), chars (code points of the text); null roles and texts are empty, rows without conv_id go."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    item = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    return conversations.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), item.alias("item"), F.char_length(text).cast("bigint").alias("chars"))


def numbered(s: Scratch, rows: DataFrame) -> DataFrame:
    """turns() with pos from 1: by turn, nulls first, then by item (so ties and repeated rows have one order)."""
    return running(s, rows.withColumn("kg_one", F.lit(1).cast("bigint")), "conv_id", ["turn", "item"], {"pos": ("kg_one", F.sum)}, "numbered").drop("turn", "kg_one")


def shared_turns(conv_id: Column) -> Column:
    """How many first turns a conversation takes from its group's first one: CRC-32 of its decimal id modulo 6."""
    return F.crc32(conv_id.cast("string").cast("binary")) % 6


def rebuilt(own: DataFrame, group: int = 100, most: int = 5) -> DataFrame:
    """Conversations in numbered() form, with their first turns replaced by those of conversation c - c % group: conv_id, pos, item, chars.

    Each conversation also has a row of pos 0 without item, the root. One whose group has no first conversation, or a shorter one, has less
    in front; one left without turns has its root only.
    """
    head = own.where(F.col("conv_id") % group == 0).where(F.col("pos") <= most)
    ids = own.select("conv_id").distinct()
    base, h = (F.col("conv_id") - F.col("conv_id") % group).alias("base"), shared_turns(F.col("conv_id"))
    sizes = head.groupBy(F.col("conv_id").alias("base")).agg(F.count("*").alias("kg_first"))
    root = ids.select("conv_id", F.lit(0).cast("bigint").alias("pos"), F.lit(None).cast("string").alias("item"), F.lit(0).cast("bigint").alias("chars"))
    front = ids.withColumn("base", base).withColumn("h", h).join(head.select(F.col("conv_id").alias("base"), "pos", *ITEM), "base").where(F.col("pos") <= F.col("h")).select("conv_id", "pos", *ITEM)
    rest = join_one(own.where(F.col("pos") > h).withColumn("base", base), sizes, ["base"])
    rest = rest.withColumn("pos", F.col("pos") - h + F.least(h, F.coalesce("kg_first", F.lit(0)))).select("conv_id", "pos", *ITEM)
    return root.unionByName(front).unionByName(rest)


def prefixes(s: Scratch, rows: DataFrame) -> DataFrame:
    """rows (conv_id, pos, item, chars) with a, b: the prefix hash up to each row; before_a, before_b: the one of the prefix before it; turns: the conversation's length."""
    mark = lambda *c: F.when(F.col("pos") == 0, F.lit(0).cast("bigint")).otherwise(F.xxhash64(*c))
    marked = rows.withColumns({"kg_a": mark("pos", "item"), "kg_b": mark("item", "pos", F.lit("b")), "kg_turn": F.when(F.col("pos") > 0, 1).otherwise(0).cast("bigint")})
    got = running(s, marked, "conv_id", ["pos"], {"a": ("kg_a", F.bit_xor), "b": ("kg_b", F.bit_xor)}, "prefixes", {"turns": "kg_turn"})
    return got.withColumns({"before_a": F.col("a").bitwiseXOR(F.col("kg_a")), "before_b": F.col("b").bitwiseXOR(F.col("kg_b"))}).drop("kg_a", "kg_b", "kg_turn", "item")


def nodes(rows: DataFrame) -> DataFrame:
    """Nodes of prefixes() rows: key (depth, a, b), the prefix before, members, smallest member, path and its last depth.

    path is the longest member, the smallest of these. Members of one prefix that is long or empty are summed up before they move.
    """
    longest = F.max(F.struct(F.col("turns"), (-F.col("conv_id")).alias("least")))
    got = rows.groupBy(F.col("pos").alias("depth"), "a", "b").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("before_a").alias("before_a"), F.min("before_b").alias("before_b"), F.max("chars").alias("chars"), longest.alias("kg_long")
    )
    return got.select("depth", "a", "b", "before_a", "before_b", "conv_id", "n_convs", ((F.col("n_convs") - 1) * F.col("chars")).alias("own"), (-F.col("kg_long.least")).alias("path"), F.col("kg_long.turns").alias("last"))


def ends(rows: DataFrame) -> DataFrame:
    """depth, a, b, ends_sha256 of the nodes at which conversations end: SHA-256 of their ids, ascending, joined by commas.

    Ids are put together by ranges of CHUNK ids; a task then hashes a node's ranges in order as they stream by, holding one at a time.
    """
    last = rows.where(F.col("pos") == F.col("turns")).select(F.col("pos").alias("depth"), "a", "b", "conv_id")
    width = F.floor(F.col("conv_id") / F.lit(CHUNK)).cast("bigint")
    ids = last.groupBy("depth", "a", "b", width.alias("chunk")).agg(F.array_join(F.array_sort(F.collect_set("conv_id")), ",").alias("ids"))
    dealt = ids.repartition("depth", "a", "b").sortWithinPartitions("depth", "a", "b", "chunk")
    return dealt.mapInArrow(_hashed, "depth long, a long, b long, ends_sha256 string")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a run of equal keys: the keys and the SHA-256 of its texts joined by commas."""
    key, digest = None, None
    names = ["depth", "a", "b", "ends_sha256"]
    for batch in batches:
        done: list[tuple] = []
        columns = [batch.column(k).to_pylist() for k in range(3)]
        for k, at in enumerate(zip(*columns)):
            text = batch.column(4)[k].as_py().encode()
            if at == key:
                digest.update(b"," + text)
            else:
                if key is not None:
                    done.append((*key, digest.hexdigest()))
                key, digest = at, hashlib.sha256(text)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), [pa.int64()] * 3 + [pa.string()])], names)
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*key, digest.hexdigest()), [pa.int64()] * 3 + [pa.string()])], names)


def peeled(s: Scratch, paths: DataFrame) -> DataFrame:
    """Totals of each path's subtree: paths (path, up, own, leaves) with up the path they hang from, null for the root's, to (path, saved, n_leaves).

    Every round, the paths that wait for no child send their totals up; messages to one path are summed up on the way. Rows of paths that have sent are
    written and leave the next rounds.
    """
    waits = paths.where("up is not null").groupBy(F.col("up").alias("path")).agg(F.count("*").alias("kg_n"))
    left = paths.join(waits, "path", "left").select("path", "up", F.col("own").alias("saved"), F.col("leaves").alias("n_leaves"), F.coalesce("kg_n", F.lit(0)).alias("waits"))
    left = s.write(left, "waiting")
    done = None
    while True:
        ready = left.where("waits = 0")
        sent = ready.select("path", "saved", "n_leaves")
        done = sent if done is None else done.unionByName(sent)
        still = left.where("waits > 0")
        if still.isEmpty():
            return done
        mail = ready.groupBy(F.col("up").alias("path")).agg(F.count("*").alias("kg_n"), F.sum("saved").alias("kg_saved"), F.sum("n_leaves").alias("kg_leaves"))
        plus = lambda c, m: (F.col(c) + F.coalesce(m, F.lit(0))).alias(c)
        left = s.write(still.join(mail, "path", "left").select("path", "up", plus("saved", "kg_saved"), plus("n_leaves", "kg_leaves"), (F.col("waits") - F.coalesce("kg_n", F.lit(0))).alias("waits")), "waiting")


def trie(rows: DataFrame) -> DataFrame:
    """The trie's nodes: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    rows: conversations in rebuilt() form: conv_id, pos (0 for the root, then 1 and on without gaps), item, chars; no nulls but the root's item.
    Equal conversations end at one node. An empty table gives no nodes. saved_tokens counts code points.
    """
    spark = rows.sparkSession
    with Scratch(spark, "trie") as s:
        at = s.write(prefixes(s, rows), "rows")
        key = ["depth", "a", "b"]
        all_nodes = s.write(nodes(at).join(ends(at), key, "left"), "nodes")
        tops = all_nodes.groupBy("path").agg(F.min_by(F.struct("depth", "before_a", "before_b"), "depth").alias("t"), F.sum("own").alias("own"))
        tops = tops.select("path", "own", (F.col("t.depth") - 1).alias("depth"), F.when(F.col("t.depth") > 0, F.col("t.before_a")).alias("a"), F.col("t.before_b").alias("b"))
        above = all_nodes.select(*key, F.col("path").alias("up"), F.col("conv_id").alias("up_conv"))
        paths = s.write(join_one(tops, above, key).select("path", "own", F.col("depth").alias("up_depth"), "up", "up_conv"), "paths")
        totals = peeled(s, paths.select("path", "up", "own", F.lit(1).cast("bigint").alias("leaves")))
        hung = paths.where("up is not null").join(totals, "path").groupBy(F.col("up").alias("path"), F.col("up_depth").alias("depth"))
        hung = hung.agg(F.count("*").alias("kg_n"), F.sum("saved").alias("kg_saved"), F.sum("n_leaves").alias("kg_leaves"))
        own = all_nodes.join(hung, ["path", "depth"], "left")
        count = lambda c: F.coalesce(c, F.lit(0))
        leaf = F.col("depth") == F.col("last")
        own = own.select(
            "path", (-F.col("depth")).alias("up_from_end"), "depth", "conv_id", "n_convs", "ends_sha256", (count("kg_n") + F.when(leaf, 0).otherwise(1)).alias("n_children"),
            (count("kg_leaves") + F.when(leaf, 1).otherwise(0)).alias("kg_l"), (F.col("own") + count("kg_saved")).alias("kg_s"),
        )
        got = running(s, own, "path", ["up_from_end"], {"n_leaves": ("kg_l", F.sum), "saved_tokens": ("kg_s", F.sum)}, "totals")
        inside = all_nodes.select("path", (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
        across = paths.where("up is not null").select("path", (F.col("up_depth") + 1).alias("depth"), F.col("up_conv").alias("parent_conv_id"))
        got = got.join(inside.unionByName(across), ["path", "depth"], "left")
        none = hashlib.sha256(b"").hexdigest()
        return materialise(got.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256")), "trie-nodes")


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """trie() of conversations (conv_id, turn, role, text; other columns are ignored), each rebuilt with the first turns of its group's first one.

    Turns are ordered by turn, nulls first; ties by the digest of role and text. Repeated rows count as turns. Null roles and texts are
    empty, rows without conv_id belong to no conversation. The result is a written table of the caller's.
    """
    with Scratch(conversations.sparkSession, "conversations") as s:
        own = s.write(numbered(s, turns(conversations)), "own")
        return trie(s.write(rebuilt(own), "rebuilt"))
