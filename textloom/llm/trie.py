"""Prefix trie of conversations (operator 11).

Turns are coded by a dictionary, so a conversation is a sequence of numbers.
Equal sequences are counted once. What is left is partitioned by most
significant digit first: a bucket's common prefix is skipped, its sequences go
to the bucket of their next turn, and buckets that are still large are taken up
again. Small ones are finished by multikey quicksort in one task, which emits a
node for every run of equal turns. Sums over subtrees then go up the few nodes
that were split. Sequences are compared in segments of growing length, so that
very long conversations don't have to fit into a row; what no other
conversation shares is a chain and is emitted turn by turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import positions
from .storage import Scratch, staged

#: Turns of a bucket that one task finishes.
LOCAL_TURNS = 1 << 14
#: Turns of the first segment; each later one has sixteen times as many, up to the last.
FIRST_SEGMENT, LAST_SEGMENT = 256, 1 << 16
#: Members whose ids are joined to one row before they are hashed in order.
IDS_A_ROW = 512
#: A word is a run of what isn't a space, a tab or a line, page or carriage break.
WORD = r"[^\x20\x09-\x0D]+"

_NODE = "depth long, last long, conv_id long, parent_conv_id long, n long, children long, leaves long, saved long, ended long, end_conv long, key binary"
_LOCAL = f"part binary, {_NODE}"


# --- rebuilt conversations ------------------------------------------------------------


def coded_turns(conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, position, n, id, words): each conversation's turns in order, their dictionary number and their words.

    Ordered by turn, null first; of equal turns by digest. A null role or text
    is empty; rows without a conv_id belong to no conversation. Texts don't travel.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    rows = scratch.staged(rows, "turn-digests")
    dictionary = scratch.staged(rows.groupBy("digest").agg(F.first("words").alias("words")).withColumn("id", F.monotonically_increasing_id()), "dictionary")
    placed = positions(rows.drop("words"), "conv_id", ["turn", "digest"], scratch)
    return scratch.staged(placed.join(dictionary, "digest").select("conv_id", "position", "n", "id", "words"), "coded-turns")


def rebuilt(turns: DataFrame, scratch: Scratch, every: int = 20, shared: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, length) and their turns (conv_id, place, id, words), with the first ones taken from another.

    Conversation c starts with the first crc32(c) % shared turns of the
    conversation c - c % every, as many of them as there are, and goes on with
    its own turns after as many.
    """
    own = F.col("conv_id")
    h = F.crc32(own.cast("string")) % shared
    first = turns.where((F.col("position") < shared - 1) & (own % every == 0)).groupBy(own.alias("base"))
    heads = first.agg(F.array_sort(F.collect_list(F.struct("position", "id", "words"))).alias("head"))
    plan = turns.where("position = 0").select("conv_id", "n", h.alias("h"), (own - own % every).alias("base")).join(heads, "base", "left")
    taken = F.when(F.col("head").isNull(), F.array().cast("array<struct<position: long, id: long, words: long>>")).otherwise(F.slice("head", 1, F.col("h").cast("int")))
    plan = plan.select("conv_id", "n", "h", taken.alias("taken")).withColumn("k", F.size("taken").cast("long"))
    plan = scratch.staged(plan, "plan")
    after = turns.where(F.col("position") >= h).join(plan.select("conv_id", "h", "k"), "conv_id").select("conv_id", (F.col("k") + F.col("position") - F.col("h")).alias("place"), "id", "words")
    before = plan.select("conv_id", F.inline("taken")).select("conv_id", F.col("position").alias("place"), "id", "words")
    lengths = plan.select("conv_id", (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))
    return lengths, scratch.staged(after.unionByName(before), "rebuilt-turns")


# --- within a task --------------------------------------------------------------------


def multikey_nodes(rows: list[dict], depth: int, conv: int | None) -> tuple[list[list], tuple[int, int, int]]:
    """Nodes below the node at `depth` that all rows' sequences pass, and its own sums: children, leaves, saved.

    Rows have distinct `ids` longer than `depth`, with `words`, n, conv, ended,
    end_conv, key and what lies below their end (below_children and so on). A
    node is [depth, last, conv_id, parent_conv_id, n, children, leaves, saved,
    ended, end_conv, key]; one whose subtree is a chain of a single
    conversation stands for all its nodes up to the depth `last`.
    """
    nodes: list[list] = []
    parents: list[int] = []
    stack = [(rows, depth, -1)]
    while stack:
        part, d, parent = stack.pop()
        pivot = sorted(part[i]["ids"][d] for i in (0, len(part) // 2, -1))[1]
        less, same, more = [], [], []
        for row in part:
            turn = row["ids"][d]
            (less if turn < pivot else more if turn > pivot else same).append(row)
        stack += [(side, d, parent) for side in (less, more) if side]
        up = conv if parent < 0 else nodes[parent][2]
        parents.append(parent)
        row = same[0]
        if len(same) == 1 and row["n"] == 1:
            nodes.append([d + 1, len(row["ids"]), row["conv"], up, 1, row["below_children"], row["below_leaves"], 0, row["ended"], row["end_conv"], row["key"]])
            continue
        n = sum(r["n"] for r in same)
        node = [d + 1, d + 1, min(r["conv"] for r in same), up, n, 0, 0, (n - 1) * row["words"][d], 0, None, None]
        rest = [r for r in same if len(r["ids"]) > d + 1]
        if len(rest) < len(same):
            end = next(r for r in same if len(r["ids"]) == d + 1)
            node[5:8] = end["below_children"], end["below_leaves"], node[7] + end["below_saved"]
            node[8:] = end["ended"], end["end_conv"], end["key"]
        nodes.append(node)
        if rest:
            stack.append((rest, d + 1, len(nodes) - 1))
    sums = [0, 0, 0]
    for node, parent in zip(reversed(nodes), reversed(parents), strict=True):
        node[6] = max(node[6], 1)
        above = sums if parent < 0 else nodes[parent][5:8]
        above = [above[0] + 1, above[1] + node[6], above[2] + node[7]]
        if parent < 0:
            sums = above
        else:
            nodes[parent][5:8] = above
    return nodes, tuple(sums)


def _finished(base: int):
    """Arrow function over a group of local rows; the part's own sums come as a row without depth."""

    def one(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        nodes, sums = multikey_nodes(rows, rows[0]["bottom"], rows[0]["up"])
        out = [[None, None, None, None, None, *sums, 0, None, None], *([base + n[0], base + n[1], *n[2:]] for n in nodes)]
        columns = list(zip(*out, strict=True))
        types = [pa.int64()] * 10 + [pa.binary()]
        names = [c.split()[0] for c in _NODE.split(", ")]
        return pa.table([pa.array([rows[0]["part"]] * len(out), pa.binary()), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["part", *names])

    return one


# --- most significant digit first -----------------------------------------------------


def _child(part, digit):
    return F.unhex(F.sha2(F.concat(F.hex(part), F.lit("/"), digit.cast("string")), 256))


def _built(distinct: DataFrame, base: int, local_turns: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Nodes of the tries below all buckets of a round, and each bucket's sums (part, children, leaves, saved).

    `distinct` has the sequences: key, part (the bucket), up (its smallest
    member), ids, words, n, conv, ended, end_conv, below_*. Nodes of depth 0 are left
    out; they were emitted by the round before.
    """
    weight = F.size("ids") + 1
    levels: list[tuple[DataFrame, DataFrame]] = []
    nodes: list[DataFrame] = []
    open_rows = distinct.withColumn("top", F.lit(0).cast("long")).withColumn("parent", F.lit(None).cast("binary"))
    while True:
        parts = open_rows.groupBy("part").agg(
            F.first("parent").alias("parent"), F.first("top").alias("top"), F.first("up").alias("up"), F.sum("n").alias("n"), F.min("conv").alias("conv"), F.sum(weight).alias("weight"),
            F.count("*").alias("rows"), F.min(F.struct("ids", "words")).alias("lo"), F.max("ids").alias("hi"),
        )
        differ = F.array_position(F.zip_with("lo.ids", "hi", lambda a, b: a.eqNullSafe(b)), False) - 1
        bottom = F.when((F.col("weight") > local_turns) & (F.col("rows") > 1), differ).otherwise(F.col("top"))
        parts = parts.withColumn("bottom", bottom.cast("long")).withColumn("chain", F.expr("slice(lo.words, 1, cast(bottom as int))")).drop("lo", "hi", "rows")
        parts = parts.withColumn("down", F.when(F.col("bottom") > F.col("top"), F.col("conv")).otherwise(F.col("up")))  # the bottom node's smallest member
        parts = scratch.staged(parts, "parts")
        met = open_rows.drop("top", "up", "parent").join(parts.select("part", "bottom", F.col("down").alias("up"), F.ceil(F.col("weight") / local_turns).alias("groups")), "part")
        met = met.withColumn("digit", F.get("ids", F.col("bottom").cast("int")))
        large = met.where("digit IS NOT NULL").groupBy("part", "digit").agg(F.sum(weight).alias("w"), F.count("*").alias("c")).where((F.col("w") > local_turns) & (F.col("c") > 1))
        large = scratch.staged(large.select("part", "digit", _child(F.col("part"), F.col("digit")).alias("child")), "large-children")
        met = scratch.staged(met.join(large, ["part", "digit"], "left"), "digits")
        small = met.where("child IS NULL AND digit IS NOT NULL").withColumn("group", F.pmod(F.xxhash64("digit"), F.col("groups")))
        nodes.append(scratch.staged(small.drop("child", "digit", "groups").groupBy("part", "group").applyInArrow(_finished(base), _LOCAL), "local-nodes"))
        stubs = met.where("digit IS NULL").select("part", "below_children", "below_leaves", "below_saved", "ended", "end_conv", "key")
        levels.append((parts, stubs))
        if large.isEmpty():
            break
        conv = F.col("conv")
        open_rows = met.where("child IS NOT NULL").withColumn("top", F.col("bottom") + 1).withColumn("parent", F.col("part")).withColumn("part", F.col("child"))
        firsts = open_rows.groupBy("part").agg(F.min(conv).alias("_up"))  # a child's node has its sequences for members
        open_rows = open_rows.join(firsts, "part").withColumn("up", F.col("_up")).drop("_up", "child", "digit", "groups", "bottom")
        open_rows = scratch.staged(open_rows, "open-rows")
    raised: DataFrame | None = None  # what the parts of the level below add to their parents
    split: list[DataFrame] = []
    for (parts, stubs), done in zip(reversed(levels), reversed(nodes), strict=True):
        sums = done.where("depth IS NULL").select("part", "children", "leaves", "saved")
        sums = sums.unionByName(stubs.select("part", F.col("below_children").alias("children"), F.col("below_leaves").alias("leaves"), F.col("below_saved").alias("saved")))
        if raised is not None:
            sums = sums.unionByName(raised)
        sums = sums.groupBy("part").agg(*(F.sum(c).alias(c) for c in ("children", "leaves", "saved")))
        rows = parts.join(sums, "part", "left").join(stubs.select("part", "ended", "end_conv", "key"), "part", "left")
        rows = rows.withColumn("leaves", F.greatest("leaves", F.lit(1))).fillna(0, ["children", "saved", "ended"])
        # node j of the chain saves what lies below it and the words of the turns from its own on
        tail = F.expr("transform(sequence(0, cast(bottom as int)), j -> saved + (n - 1) * aggregate(slice(chain, greatest(j, 1), greatest(cast(bottom as int) - greatest(j, 1) + 1, 0)), 0L, (a, w) -> a + w))")
        rows = scratch.staged(rows.withColumn("tail", tail), "split-parts")
        split.append(rows)
        raised = rows.where("parent IS NOT NULL").select(F.col("parent").alias("part"), F.lit(1).cast("long").alias("children"), "leaves", F.get("tail", F.col("top").cast("int")).alias("saved"))
    found = [d.where("depth IS NOT NULL").drop("part") for d in nodes]
    downs = None
    for (parts, _), rows in zip(levels, reversed(split), strict=True):
        up = rows.withColumn("_mother", F.lit(None).cast("long")) if downs is None else rows.join(downs, "parent", "left")
        each = up.withColumn("j", F.explode(F.expr("CASE WHEN bottom >= greatest(top, 1) THEN sequence(greatest(top, 1L), bottom) ELSE array() END")))
        at_bottom = F.col("j") == F.col("bottom")
        mother = F.when(F.col("j") > F.col("top"), F.when((F.col("j") == 1) & (F.col("top") == 0), F.col("up")).otherwise(F.col("conv"))).otherwise(F.col("_mother"))
        found.append(each.select(
            (F.col("j") + base).alias("depth"), (F.col("j") + base).alias("last"), F.col("conv").alias("conv_id"), mother.alias("parent_conv_id"), "n", F.when(at_bottom, F.col("children")).otherwise(1).alias("children"), "leaves",
            F.get("tail", F.col("j").cast("int")).alias("saved"), F.when(at_bottom, F.col("ended")).otherwise(0).cast("long").alias("ended"), F.when(at_bottom, F.col("end_conv")).alias("end_conv"), F.when(at_bottom, F.col("key")).alias("key"),
        ))
        downs = parts.select(F.col("part").alias("parent"), F.col("down").alias("_mother"))
    buckets = split[-1].select("part", F.when(F.col("bottom") > 0, 1).otherwise(F.col("children")).cast("long").alias("children"), "leaves", F.get("tail", F.lit(0)).alias("saved"), F.when(F.col("bottom") == 0, F.col("ended")).otherwise(0).cast("long").alias("ended"), F.when(F.col("bottom") == 0, F.col("end_conv")).alias("end_conv"), F.when(F.col("bottom") == 0, F.col("key")).alias("key"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out, buckets


def _ends(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, ends_sha256) from (key, conv_id): SHA-256 of each key's ids, ascending and joined by commas.

    The ids of a large group are put in order by ranges and joined to rows of
    IDS_A_ROW first; the digest then reads those rows one after another.
    """
    placed = positions(rows, "key", ["conv_id"], scratch)
    chunks = placed.withColumn("chunk", F.expr(f"position div {IDS_A_ROW}")).groupBy("key", "chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out = []
            for k, ids in zip(batch["key"].to_pylist(), batch["ids"].to_pylist(), strict=True):
                if k == key:
                    state.update(b",")
                else:
                    if key is not None:
                        out.append((key, state.hexdigest()))
                    key, state = k, hashlib.sha256()
                state.update(ids.encode())
            yield pa.record_batch([pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.string())], ["key", "ends_sha256"])
        if key is not None:
            yield pa.record_batch([pa.array([key], pa.binary()), pa.array([state.hexdigest()], pa.string())], ["key", "ends_sha256"])

    ordered = chunks.repartition("key").sortWithinPartitions("key", "chunk").select("key", "ids")
    return scratch.staged(ordered.mapInArrow(hashed, "key binary, ends_sha256 string"), "ends")


def trie(conversations: DataFrame, local_turns: int = LOCAL_TURNS, first_segment: int = FIRST_SEGMENT, last_segment: int = LAST_SEGMENT) -> DataFrame:
    """The nodes of the prefix trie of rebuilt conversations (see `rebuilt`).

    Per node: conv_id (its smallest member), depth, parent_conv_id, n_convs
    (members, which start with its turns), n_children, n_leaves, saved_tokens
    (over its subtree, (n_convs - 1) times the words of a node's last text) and
    ends_sha256 (of the members that end there). Null roles and texts are
    empty; rows without conv_id are left out; repeated rows are turns each, and
    of equal turn numbers the order is that of digests; texts of any length are
    only hashed and counted; other columns aren't read. An empty table has no
    nodes, not even a root.
    """
    spark = conversations.sparkSession
    with Scratch(spark) as scratch:
        lengths, turns = rebuilt(coded_turns(conversations, scratch), scratch)
        total = lengths.agg(F.count("*").alias("n"), F.min("conv_id").alias("conv")).first()
        root = F.unhex(F.lit("00"))
        entry = lengths.select("conv_id", "length", root.alias("part"), F.lit(total["conv"]).cast("long").alias("up"))
        rounds: list[tuple[DataFrame, int]] = []
        ended: list[DataFrame] = []
        tails: list[DataFrame] = []
        start, width = 0, first_segment
        while True:
            stop = start + width
            segments = turns.where(F.col("place").between(start, stop - 1)).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", "id", "words"))).alias("_s"))
            rows = entry.join(segments, "conv_id", "left" if start == 0 else "inner")
            ids, words = (F.coalesce(F.col(f"_s.{c}"), F.array().cast("array<long>")) for c in ("id", "words"))
            rows = rows.select("conv_id", "length", "part", "up", ids.alias("ids"), words.alias("words"), (F.col("length") <= stop).alias("ends"))
            key = F.unhex(F.sha2(F.concat(F.hex("part"), F.lit(":"), F.array_join(F.transform("ids", lambda x: x.cast("string")), ",")), 256))
            rows = scratch.staged(rows.withColumn("key", key), "segments")
            distinct = rows.groupBy("key").agg(F.first("part").alias("part"), F.first("up").alias("up"), F.first("ids").alias("ids"), F.first("words").alias("words"), F.count("*").alias("n"), F.min("conv_id").alias("conv"), F.count_if("ends").alias("ended"), F.min(F.when(F.col("ends"), F.col("conv_id"))).alias("end_conv"))
            distinct = scratch.staged(distinct, "sequences")
            rounds.append((distinct, start))
            together = distinct.where("ended > 1").select("key")
            if not together.isEmpty():
                ended.append(rows.where("ends").select("key", "conv_id").join(together, "key", "left_semi"))
            tails.append(distinct.where("n = 1 AND ended = 0").select(F.col("conv").alias("conv_id"), F.lit(stop).cast("long").alias("since")))
            going = distinct.where("n > 1 AND ended < n").select("key", F.col("conv").alias("_up"))
            if going.isEmpty():
                break
            entry = rows.where("NOT ends").select("conv_id", "length", "key").join(going, "key").select("conv_id", "length", F.col("key").alias("part"), F.col("_up").alias("up"))
            entry = scratch.staged(entry, "entry")
            start, width = stop, min(16 * width, last_segment)
        nodes: list[DataFrame] = []
        below: DataFrame | None = None
        for distinct, base in reversed(rounds):
            alone = F.when(F.expr("n = 1 AND ended = 0"), 1).otherwise(0).cast("long")
            rows = distinct.withColumns({"below_children": alone, "below_leaves": alone, "below_saved": F.lit(0).cast("long")})
            if below is not None:
                more = below.select(F.col("part").alias("key"), F.col("children").alias("_c"), F.col("leaves").alias("_l"), F.col("saved").alias("_s"))
                rows = rows.join(more, "key", "left").withColumns({f"below_{k}": F.col(f"below_{k}") + F.coalesce(f"_{k[0]}", F.lit(0)) for k in ("children", "leaves", "saved")}).drop("_c", "_l", "_s")
            found, below = _built(rows, base, local_turns, scratch)
            nodes.append(found)
        top = below.select(
            F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("last"), F.lit(total["conv"]).cast("long").alias("conv_id"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(total["n"]).cast("long").alias("n"),
            "children", "leaves", "saved", "ended", "end_conv", "key",
        )
        long = tails[0]
        for more in tails[1:]:
            long = long.unionByName(more)
        rest = turns.join(long, "conv_id").where("place >= since").join(lengths, "conv_id")
        at_end, own = F.col("place") + 1 == F.col("length"), F.col("conv_id")
        rest = rest.select((F.col("place") + 1).alias("depth"), (F.col("place") + 1).alias("last"), "conv_id", own.alias("parent_conv_id"), F.lit(1).cast("long").alias("n"), F.when(at_end, 0).otherwise(1).cast("long").alias("children"), F.lit(1).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"), at_end.cast("long").alias("ended"), F.when(at_end, own).alias("end_conv"), F.lit(None).cast("binary").alias("key"))
        all_nodes = top.unionByName(rest)
        for more in nodes:
            all_nodes = all_nodes.unionByName(more)
        each = all_nodes.withColumn("_d", F.explode(F.sequence("depth", "last")))
        final, inner = F.col("_d") == F.col("last"), F.col("_d") > F.col("depth")
        each = each.select(
            "conv_id", F.col("_d").alias("depth"), F.when(inner, own).otherwise(F.col("parent_conv_id")).alias("parent_conv_id"), F.col("n").alias("n_convs"), F.when(final, F.col("children")).otherwise(1).cast("long").alias("n_children"),
            F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.when(final, F.col("ended")).otherwise(0).alias("_ended"), "end_conv", "key",
        )
        single = F.sha2(F.when(F.col("_ended") == 1, F.col("end_conv").cast("string")).otherwise(""), 256)
        names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
        out = each.where("_ended < 2").withColumn("ends_sha256", single).select(*names)
        if ended:
            members = ended[0]
            for more in ended[1:]:
                members = members.unionByName(more)
            ends = _ends(scratch.staged(members, "ended-together"), scratch)
            out = out.unionByName(each.where("_ended > 1").join(ends, "key").select(*names))
        return staged(out, "trie")
