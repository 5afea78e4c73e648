"""The prefix trie of conversations, without building it: each node belongs to its smallest member.

A node of the trie is a sequence of first turns, and its members are the
conversations that start with it.  The smallest member owns the node.  If a
conversation is the smallest at some depth, it is so at every greater depth of
its path, so what it owns is a suffix of its path, and one number per
conversation, the depth from which it owns, says it all.  A subtree's nodes are
owned by members of its top, each once.  Sums over a subtree are then sums over
the members of its top: occurrences of tokens at and below it, less the owned
ones; flags of owned leaves; flags of owned children.  So one group-by of the
prefixes gives them, with map-side combination, and nothing walks the tree.

A prefix is known by its depth and by the exclusive or of 120 bits of SHA-256
for each of its turns with their places, which is a running aggregate and so is
made in two levels, inside blocks of a path and over the blocks: neither a long
conversation nor the root, which has every conversation, is one task's.  Windows
run along blocks of paths; a window over the members of a prefix would put all
conversations into one task, so the smallest member is an aggregate.  The join
of the tops of suffixes with their parents may have hot keys (all
conversations may hang on the root): adaptive execution splits them.

Null conv_id is no conversation.  Null role and text are empty.  Null turns come
first; equal turns are in the order of role and of the SHA-256 of role and text,
so repeated rows are repeated turns and interchangeable.  An empty table has no
nodes.  Other columns are not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, crc_of_id

#: Turns of a path that are summed up together.
BLOCK = 1024
#: Conversations whose ids are joined into one piece of text: the ids of a range of 512.
PIECE_BITS = 9
#: op13: the conversations of a hundred may start with turns of the first of them, up to five.
FAMILY, HEADS = 100, 6


def _half(hexed: Column, first: int) -> Column:
    """Fifteen hexadecimal digits as a number."""
    return F.conv(F.substring(hexed, first, 15), 16, 10).cast("long")


def ranked_turns(conversations: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(turns, chunks): conv_id, pid, rank, content, chars of every turn, and conv_id, pid, before, n of every chunk of a conversation.

    Rows are cut into ranges of conversation and turn, so the ranks of a
    conversation come from its places in each range and the sizes of the ranges.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    content = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    lean = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), content.alias("content"), F.length(text).cast("long").alias("chars"))
    lean = scratch.save(lean)  # the sample of the ranges reads it as well
    placed = scratch.save(lean.repartitionByRange("conv_id", "turn", "role", "content").withColumn("pid", F.spark_partition_id()))
    scratch.drop(lean)
    sizes = placed.groupBy("conv_id", "pid").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    chunks = scratch.save(sizes.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))))
    inside = Window.partitionBy("conv_id", "pid").orderBy("turn", "role", "content")
    turns = placed.withColumn("at", F.row_number().over(inside)).join(chunks.select("conv_id", "pid", "before"), ["conv_id", "pid"])
    return turns.select("conv_id", "pid", (F.col("before") + F.col("at")).alias("rank"), "content", "chars"), chunks


def as_they_are(conversations: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(steps, lengths) of conversations: conv_id, depth, content, chars; and conv_id, length."""
    turns, chunks = ranked_turns(conversations, scratch)
    return turns.select("conv_id", F.col("rank").alias("depth"), "content", "chars"), chunks.groupBy("conv_id").agg(F.sum("n").alias("length"))


def with_family_heads(conversations: DataFrame, scratch: Scratch, family: int = FAMILY, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """(steps, lengths) of rebuilt conversations: the first h turns of conversation c - c % family, then those of c after its first h.

    h is the unsigned crc32 of c's decimal digits modulo ``heads``.  All
    conversations are rebuilt, those that are left without turns too.
    """
    turns, chunks = ranked_turns(conversations, scratch)
    turns = scratch.save(turns)
    own = chunks.groupBy("conv_id").agg(F.sum("n").alias("n"))
    info = own.withColumn("h", crc_of_id("conv_id") % heads).withColumn("first", F.col("conv_id") - F.col("conv_id") % family)
    sizes = own.select(F.col("conv_id").alias("first"), F.col("n").alias("n_first"))
    info = info.join(sizes, "first", "left").withColumn("keep", F.least("h", F.coalesce("n_first", F.lit(0))))
    info = scratch.save(info.select("conv_id", "first", "h", "keep", (F.col("keep") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")))
    of_chunk = chunks.select("conv_id", "pid").join(info.select("conv_id", "h", "keep"), "conv_id")
    rest = turns.join(of_chunk, ["conv_id", "pid"]).where("rank > h").select("conv_id", (F.col("rank") - F.col("h") + F.col("keep")).alias("depth"), "content", "chars")
    # at most family * 2 conversations share a head, each of fewer than ``heads`` turns
    head = turns.where(F.col("rank") < heads).select(F.col("conv_id").alias("first"), F.col("rank").alias("depth"), "content", "chars")
    begin = info.select("conv_id", "first", "keep").join(head, "first").where("depth <= keep").select("conv_id", "depth", "content", "chars")
    return begin.unionByName(rest), info.select("conv_id", "length")


def _paths(steps: DataFrame, lengths: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(paths, blocks).

    paths: conv_id, block, depth, the prefix (ka, kb), its parent (pa, pb),
    before and upto (tokens above, and with, this turn), length; depth 0 included.
    blocks: conv_id, block, length, total.
    """
    place = F.sha2(F.concat(F.col("depth").cast("string"), F.lit(":"), F.col("content")), 256)
    zero = F.lit(0).cast("long")
    tagged = steps.select("conv_id", "depth", "chars", place.alias("_h")).select("conv_id", "depth", "chars", _half(F.col("_h"), 1).alias("a"), _half(F.col("_h"), 16).alias("b"))
    root = lengths.select("conv_id", zero.alias("depth"), zero.alias("chars"), zero.alias("a"), zero.alias("b"))
    tagged = scratch.save(tagged.unionByName(root).withColumn("block", F.floor(F.col("depth") / BLOCK)))
    sums = tagged.groupBy("conv_id", "block").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"), F.sum("chars").alias("c"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = {f"o{c}": F.coalesce(f(c).over(earlier), zero) for c, f in (("a", F.bit_xor), ("b", F.bit_xor), ("c", F.sum))}
    blocks = sums.withColumns(offsets).withColumn("total", F.sum("c").over(Window.partitionBy("conv_id"))).drop("a", "b", "c")
    blocks = scratch.save(blocks.join(lengths, "conv_id"))
    here = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    run = tagged.withColumn("ra", F.bit_xor("a").over(here)).withColumn("rb", F.bit_xor("b").over(here)).withColumn("rc", F.sum("chars").over(here))
    rows = run.join(blocks.drop("total"), ["conv_id", "block"])
    ka, kb, upto = F.col("oa").bitwiseXOR(F.col("ra")), F.col("ob").bitwiseXOR(F.col("rb")), F.col("oc") + F.col("rc")
    rows = rows.select("conv_id", "block", "depth", ka.alias("ka"), kb.alias("kb"), ka.bitwiseXOR(F.col("a")).alias("pa"), kb.bitwiseXOR(F.col("b")).alias("pb"), (upto - F.col("chars")).alias("before"), upto.alias("upto"), "length")
    return scratch.save(rows), blocks.select("conv_id", "block", "length", "total")


def ends_digests(ends: DataFrame) -> DataFrame:
    """depth, ka, kb, ends_sha256 from rows (depth, ka, kb, conv_id): SHA-256 of the ids, ascending, joined by commas.

    Ids of a range are joined where they are, so a prefix that very many
    conversations end with reaches its task as few, bounded pieces, in order,
    and is hashed as they pass.
    """
    node = ["depth", "ka", "kb"]
    pieces = ends.withColumn("part", F.shiftright("conv_id", PIECE_BITS)).groupBy(*node, "part").agg(F.array_join(F.array_sort(F.collect_list("conv_id")), ",").alias("ids"))
    pieces = pieces.repartition(*node).sortWithinPartitions(*node, "part").select(*node, "ids")

    def run(batches):
        at, digest = None, None
        for batch in batches:
            done = []
            for *key, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if key != at:
                    if at is not None:
                        done.append((*at, digest.hexdigest()))
                    at, digest = key, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=[*node, "ends_sha256"])
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (*at, digest.hexdigest())], names=[*node, "ends_sha256"])

    return pieces.mapInArrow(run, "depth long, ka long, kb long, ends_sha256 string")


def prefix_trie(steps: DataFrame, lengths: DataFrame, scratch: Scratch) -> DataFrame:
    """The nodes of the trie: conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    steps: conv_id, depth from 1 without gaps, content, chars (tokens of the turn);
    lengths: conv_id, length of all conversations.
    """
    node = ["depth", "ka", "kb"]
    paths, blocks = _paths(steps, lengths, scratch)
    first = paths.groupBy(*node).agg(F.min(F.struct("conv_id", "before")).alias("m"), F.max("length").alias("longest"))
    # what a conversation owns: from which depth, the tokens above that, and whether its end is a leaf
    own = first.groupBy(F.col("m.conv_id").alias("conv_id")).agg(F.min(F.struct("depth", F.col("m.before").alias("above"))).alias("top"), F.max(F.col("longest") == F.col("depth")).alias("leaf"))
    of_block = blocks.join(own, "conv_id", "left").select(
        "conv_id", "block", F.coalesce("top.depth", F.col("length") + 1).alias("owned"), F.coalesce("top.above", "total").alias("above"), F.coalesce("leaf", F.lit(False)).alias("leaf")
    )
    marked = paths.join(of_block, ["conv_id", "block"])
    saved = F.when(F.col("depth") < F.col("owned"), F.col("above") - F.col("before")).otherwise(0)
    child = (F.col("depth") + 1 >= F.col("owned")) & (F.col("depth") < F.col("length"))
    nodes = marked.groupBy(*node).agg(
        F.min(F.struct("conv_id", "owned")).alias("m"), F.max("pa").alias("pa"), F.max("pb").alias("pb"), F.count("*").alias("n_convs"),
        F.count_if(child).alias("n_children"), F.count_if("leaf").alias("n_leaves"), F.sum(saved).alias("saved_tokens"),
    )
    nodes = scratch.save(nodes.withColumn("conv_id", F.col("m.conv_id")).withColumn("owned", F.col("m.owned")).drop("m"))
    # a parent has the same owner, but where the owned suffix begins
    tops = nodes.where("depth = owned and depth > 0").select("depth", "ka", "kb", "pa", "pb")
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("ka").alias("pa"), F.col("kb").alias("pb"), F.col("conv_id").alias("parent"))
    up = tops.join(above, ["depth", "pa", "pb"]).select(*node, "parent")
    ends = ends_digests(paths.where("depth = length").select(*node, "conv_id"))
    out = nodes.join(up, node, "left").join(ends, node, "left")
    parent = F.when(F.col("depth") > F.col("owned"), F.col("conv_id")).otherwise(F.col("parent"))
    return out.select("conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


def op13_report(conversations: DataFrame) -> DataFrame:
    scratch = Scratch(conversations.sparkSession)
    return prefix_trie(*with_family_heads(conversations, scratch), scratch)


_CRC = """tab AS (SELECT [list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) FOR i IN range(256)] AS t)"""

ORACLE = f"""
WITH {_CRC},
ids AS (SELECT conv_id, conv_id - conv_id % {FAMILY} AS first,
  xor(list_reduce([ord(x) FOR x IN string_split(conv_id::VARCHAR, '')], lambda c, b: xor(t[1 + (xor(c, b) & 255)], c >> 8), 4294967295), 4294967295) % {HEADS} AS h
  FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL), tab),
own AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(strlen(role) || ':' || role || text)) AS k
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations)),
built AS (SELECT i.conv_id, 0 AS part, k, role, text FROM ids i JOIN own o ON o.conv_id = i.first AND k <= h
  UNION ALL SELECT i.conv_id, 1, k, role, text FROM ids i JOIN own o ON o.conv_id = i.conv_id AND k > h),
seq AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, k) AS depth, role, text FROM built),
paths AS (SELECT conv_id, 0 AS depth, '' AS prefix, 0 AS chars FROM ids
  UNION ALL SELECT conv_id, depth, sha256(string_agg(len(role) || ':' || len(text) || ':' || role || text, '') OVER (PARTITION BY conv_id ORDER BY depth)), len(text) FROM seq),
nodes AS (SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n, any_value(chars) AS chars FROM paths GROUP BY prefix, depth),
up AS (SELECT n.prefix, n.depth, p.prefix AS above FROM nodes n JOIN paths p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1),
kids AS (SELECT above, depth - 1 AS depth, count(*) AS n FROM up GROUP BY ALL),
sub AS (SELECT p.prefix, p.depth, count(*) FILTER (k.n IS NULL) AS leaves, sum((n.n - 1) * n.chars)::BIGINT AS saved
  FROM nodes n JOIN paths p ON p.conv_id = n.conv_id AND p.depth <= n.depth LEFT JOIN kids k ON k.above = n.prefix AND k.depth = n.depth GROUP BY ALL),
ends AS (SELECT prefix, depth, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS list
  FROM (SELECT *, max(depth) OVER (PARTITION BY conv_id) AS last FROM paths) WHERE depth = last GROUP BY ALL)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(k.n, 0) AS n_children, s.leaves AS n_leaves, s.saved AS saved_tokens, sha256(coalesce(e.list, '')) AS ends_sha256
FROM nodes n JOIN sub s ON s.prefix = n.prefix AND s.depth = n.depth
LEFT JOIN up u ON u.prefix = n.prefix AND u.depth = n.depth LEFT JOIN nodes p ON p.prefix = u.above AND p.depth = u.depth - 1
LEFT JOIN kids k ON k.above = n.prefix AND k.depth = n.depth LEFT JOIN ends e ON e.prefix = n.prefix AND e.depth = n.depth
"""
