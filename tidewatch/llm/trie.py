"""The prefix trie of conversations, with shared prefixes found by count-min screening.

A node is a distinct sequence of first turns (role, text); its members are the conversations that start
with it. Every prefix has a digest: the sum, over its turns, of hashes of (content, depth), so all
prefixes of a conversation come from running sums, and the digest of the parent by subtraction. The
content is a SHA-256, and a digest has 128 bits.

All digests are counted in a count-min sketch. A count of one in any of its rows proves that no other
conversation has the prefix: the node has one member, one leaf, nothing saved and nothing below but the
rest of this conversation, so it is emitted where it is. Only prefixes that may be shared are shuffled,
to be grouped exactly. What the sketch gets wrong is a singleton grouped needlessly, never a result.

The sketch is built per task as packed cell numbers, merged by ranges of cells, and comes to the driver
as one bit a cell (two or more). It has at least four cells a prefix and row, up to `MAX_WIDTH` cells a
row: 16 MB at most. Beyond some 17 million prefixes a cell is shared by more of them and more singletons
are grouped exactly; that costs time, and no result depends on it.

Sums over subtrees need no walk through the levels. A node's own contribution (a leaf, tokens saved) is
put on its smallest member, at its depth; suffix sums over each conversation's depths, added up over the
members of a node, give the sum over its subtree.

Hot keys: a node that most conversations share (the root always is one) is counted map-side; its rows
meet only as partial sums; children look their parent up by `join_counted`. A long conversation is
ranked and summed by digits beyond `window_limit` turns. The ids that end at a node are joined in
blocks of 65,536 and hashed as a stream, so that the text of all ids is never in one place.

Defined cases: rows without conv_id belong to no conversation and are left out; null role or text is
empty; turns are ordered by turn (null first), then role, then text, so equal rows may stand in any
order; other columns, whatever their names, are not looked at; an empty table gives no rows (not even
a root).
"""
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Window, functions as F

from tidewatch.llm.shared import join_counted, mix, text_of, written
from tidewatch.plans.ranking import WINDOW_LIMIT, largest_group, rank_within, running_totals

SHARED_TURNS = 6                # `spliced`: a head has fewer turns than this
FAMILY = 100                    # and comes from the first conversation of so many ids
SKETCH_ROWS = 2
MIN_WIDTH, MAX_WIDTH = 1 << 16, 1 << 26
SLICE = 1 << 16                 # cells that are merged in one row
HELD = 1 << 20                  # prefixes whose cells a task holds
KEY = ["depth", "p", "q"]
UP = ["up_depth", "up_p", "up_q"]
EMPTY = hashlib.sha256(b"").hexdigest()
_LOW = (1 << 32) - 1


# ---------------------------------------------------------------- turns and prefixes

def turns_of(conversations, window_limit=WINDOW_LIMIT):
    """conv_id, place (from 1), content (binary digest of role and text) and chars of every turn."""
    rows = conversations.where("conv_id IS NOT NULL").select(
        "conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"))
    placed = rank_within(rows, ["conv_id"], [F.shiftright("turn", 16), F.col("turn").bitwiseAND(65535)],
                         [F.col("turn").asc_nulls_first(), "role", "text"], "place", window_limit)
    content = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    return placed.select("conv_id", "place", F.unhex(content).alias("content"),
                         F.length("text").cast("long").alias("chars"))


def spliced(turns):
    """Turns of the conversations rebuilt on the heads of their families: conversation c starts with
    the first h turns of the conversation c - c % 100, h = crc32(decimal c) % 6, and goes on with its
    own turns after its first h. Also a row of place 0 without content for each."""
    ids = turns.select("conv_id").distinct()
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED_TURNS
    own = turns.where(F.col("place") > h)
    first = turns.where((F.col("conv_id") % FAMILY == 0) & (F.col("place") < SHARED_TURNS)).select(
        F.col("conv_id").alias("family"), "place", "content", "chars")
    # at most five rows for each of at most 199 ids a family
    heads = (ids.withColumns({"family": F.col("conv_id") - F.col("conv_id") % FAMILY, "h": h})
             .join(first, "family").where(F.col("place") <= F.col("h")).select(*turns.columns))
    return own.unionByName(heads).unionByName(roots(ids))


def roots(ids):
    return ids.select("conv_id", F.lit(0).cast("long").alias("place"), F.lit(None).cast("binary").alias("content"),
                      F.lit(0).cast("long").alias("chars"))


def prefixes(turns, window_limit=WINDOW_LIMIT):
    """A row per conversation and depth (0 included): key of the prefix and of its parent, chars of its
    last turn, and whether the conversation ends there. `turns` has one row of place 0 for each."""
    lanes = ["s0", "s1", "s2", "s3"]
    big = largest_group(turns, ["conv_id"]) > window_limit
    if big:
        cells = turns.withColumn("one", F.lit(1).cast("long"))
        digits = [F.shiftright("place", 16), F.shiftright("place", 8)]
        ranked = running_totals(cells, ["conv_id"], digits, ["one"], [F.col("place")]).select(
            *turns.columns, F.col("before_one").alias("depth"),
            (F.col("before_one") + 1 == F.col("total_one")).alias("last"))
    else:
        window = Window.partitionBy("conv_id").orderBy("place")
        ranked = turns.withColumns({"depth": F.row_number().over(window).cast("long") - 1,
                                    "last": F.lead("place").over(window).isNull()})
    x = [F.when(F.col("content").isNotNull(), F.xxhash64("content", "depth", F.lit(seed))).otherwise(F.lit(0))
         for seed in (1, 2)]
    ranked = ranked.withColumns({"x": x[0], "y": x[1]}).withColumns({
        "s0": F.col("x").bitwiseAND(_LOW), "s1": F.shiftrightunsigned("x", 32),
        "s2": F.col("y").bitwiseAND(_LOW), "s3": F.shiftrightunsigned("y", 32)})
    if big:
        summed = running_totals(ranked.drop("x", "y"), ["conv_id"], [F.shiftright("depth", 16), F.shiftright("depth", 8)],
                                lanes, [F.col("depth")])
        above = {k: F.col(f"before_{k}") for k in lanes}
    else:
        summed = ranked.withColumns({f"_{k}": F.sum(k).over(window) for k in lanes})
        above = {k: F.col(f"_{k}") - F.col(k) for k in lanes}

    def packed(sums):
        return [F.shiftleft(sums[a].bitwiseAND(_LOW), 32).bitwiseOR(sums[b].bitwiseAND(_LOW))
                for a, b in (("s0", "s1"), ("s2", "s3"))]
    (p, q), (up_p, up_q) = packed({k: above[k] + F.col(k) for k in lanes}), packed(above)
    return summed.select("conv_id", "depth", p.alias("p"), q.alias("q"), (F.col("depth") - 1).alias("up_depth"),
                         up_p.alias("up_p"), up_q.alias("up_q"), "chars", "last")


# ---------------------------------------------------------------- the count-min sketch

def cells_of(p, q, width):
    """The cell of each digest in every row of the sketch: one array a row, numbered through."""
    p, q = p.astype(np.uint64), q.astype(np.uint64)
    return [(mix(p * np.uint64(2 * r + 1) + mix(q + np.uint64(r))) % np.uint64(width)).astype(np.int64) + r * width
            for r in range(SKETCH_ROWS)]


def sketch(rows, width):
    """Bits of the cells that hold two prefixes or more, as one array of bytes."""
    def count(batches):
        def slices(parts):
            cells, n = np.unique(np.concatenate(parts), return_counts=True)
            edges = np.flatnonzero(np.diff(cells // SLICE, prepend=-1))
            for start, end in zip(edges, [*edges[1:], len(cells)]):
                low = (cells[start:end] % SLICE).astype(np.uint16)
                yield cells[start] // SLICE, low.tobytes(), low[n[start:end] > 1].tobytes()

        def batch_of(parts):
            rows_ = list(slices(parts))
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows_), (pa.int32(), pa.binary(), pa.binary()))],
                ["slice", "seen", "twice"])

        parts, held = [], 0
        for batch in batches:
            p, q = (np.asarray(batch.column(c)) for c in ("p", "q"))
            parts += cells_of(p, q, width)
            held += len(p)
            if held > HELD:
                yield batch_of(parts)
                parts, held = [], 0
        if held:
            yield batch_of(parts)

    def merge(key, table):
        total = np.zeros(SLICE, np.uint8)
        for column in ("seen", "twice"):
            for value in table.column(column).to_pylist():
                at = np.frombuffer(value, np.uint16)     # each cell once in a value
                total[at] = np.minimum(total[at] + 1, 2)
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()),
                         "bits": pa.array([np.packbits(total > 1, bitorder="little").tobytes()], pa.binary())})

    partial = rows.select("p", "q").mapInArrow(count, "slice int, seen binary, twice binary")
    merged = partial.groupBy("slice").applyInArrow(merge, "slice int, bits binary").collect()
    bits = np.zeros(-(-SKETCH_ROWS * width // SLICE) * SLICE // 8, np.uint8)
    for row in merged:                           # at most MAX_WIDTH * SKETCH_ROWS / 8 bytes in all
        bits[row.slice * SLICE // 8:(row.slice + 1) * SLICE // 8] = np.frombuffer(row.bits, np.uint8)
    return bits


def screened(rows, max_width=MAX_WIDTH):
    """`rows` (of `prefixes`) with `alone` and `up_alone`: the sketch proves that no other conversation
    has the prefix, or its parent. The root never counts as alone."""
    real = rows.where("depth > 0")
    width = MIN_WIDTH
    while width < min(max_width, 4 * real.count()):
        width *= 2
    held = rows.sparkSession.sparkContext.broadcast(sketch(real, width))

    def screen(batches):
        bits = held.value

        def alone(p, q, depth):
            found = np.zeros(len(p), bool)
            for cell in cells_of(p, q, width):
                found |= bits[cell >> 3] >> (cell & 7).astype(np.uint8) & 1 == 0
            return found & (depth > 0)

        for batch in batches:
            c = {k: np.asarray(batch.column(k)) for k in ("p", "q", "up_p", "up_q", "depth")}
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(alone(c["p"], c["q"], c["depth"])),
                 pa.array(alone(c["up_p"], c["up_q"], c["depth"] - 1))],
                [*batch.schema.names, "alone", "up_alone"])

    return rows.mapInArrow(screen, ", ".join(f"{n} {t}" for n, t in rows.dtypes) + ", alone boolean, up_alone boolean")


# ---------------------------------------------------------------- the trie

def ends_digests(rows):
    """SHA-256 of the ascending conv_ids of each key of `rows` (KEY and conv_id), joined by commas."""
    def digest(batches):
        key, state = None, None

        def batch_of(done):
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*done), (pa.int64(), pa.int64(), pa.int64(), pa.string()))],
                [*KEY, "ends_sha256"])

        for batch in batches:
            done = []
            for *this, ids in zip(*(batch.column(c).to_pylist() for c in (*KEY, "ids"))):
                if this != key:
                    if state:
                        done.append((*key, state.hexdigest()))
                    key, state = this, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if done:
                yield batch_of(done)
        if state:
            yield batch_of([(*key, state.hexdigest())])

    blocks = rows.groupBy(*KEY, F.shiftright("conv_id", 16).alias("block")).agg(
        F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    return (blocks.repartition("p", "q").sortWithinPartitions("p", "q", "depth", "block")
            .mapInArrow(digest, "depth long, p long, q long, ends_sha256 string"))


def suffix_sums(rows, measures, window_limit):
    """Sums of `measures` over the rows of the same conversation that are at least as deep."""
    if largest_group(rows, ["conv_id"]) > window_limit:
        digits = [F.shiftright("depth", 16), F.shiftright("depth", 8)]
        summed = running_totals(rows, ["conv_id"], digits, measures, [F.col("depth")])
        return summed.withColumns({m: F.col(f"total_{m}") - F.col(f"before_{m}") for m in measures})
    deeper = Window.partitionBy("conv_id").orderBy(F.col("depth").desc())
    return rows.withColumns({f"_{m}": F.sum(m).over(deeper) for m in measures}).drop(*measures).withColumnsRenamed(
        {f"_{m}": m for m in measures})


def trie(turns, window_limit=WINDOW_LIMIT, max_width=MAX_WIDTH):
    """A row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256. `turns` as `turns_of` and `roots`, or `spliced`, give them."""
    found = written(prefixes(turns, window_limit), "prefixes")
    rows = screened(found, max_width)
    alone = rows.where("alone")
    shared = written(rows.where("NOT alone"), "shared-prefixes")

    nodes = written(shared.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("chars").alias("chars"),
        F.sum(F.col("last").cast("long")).alias("n_ends"), F.max("up_alone").alias("up_alone"),
        *[F.max(c).alias(c) for c in UP]), "shared-nodes")

    # Every node is a child of one node; the children of a prefix proven alone need no counting.
    edge = alone.where("NOT up_alone").select("conv_id", *KEY, *UP, "last")
    up = [F.col(c).alias(k) for c, k in zip(UP, KEY)]
    children = nodes.where("depth > 0 AND NOT up_alone").select(*up).unionByName(edge.select(*up)).groupBy(
        *KEY).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = written(nodes.join(children, KEY, "left").fillna(0, ["n_children"]), "counted-nodes")

    own = nodes.select("conv_id", "depth", (F.col("n_ends") == F.col("n_convs")).cast("long").alias("n_leaves"),
                       ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"))
    ends_alone = alone.where("last").select("conv_id", *KEY, F.lit(1).cast("long").alias("n_leaves"),
                                            F.lit(0).cast("long").alias("saved_tokens"), F.lit(False).alias("counted"))
    placed = (shared.select("conv_id", *KEY).join(own, ["conv_id", "depth"], "left")
              .fillna(0, ["n_leaves", "saved_tokens"]).withColumn("counted", F.lit(True)).unionByName(ends_alone))
    below = suffix_sums(written(placed, "contributions"), ["n_leaves", "saved_tokens"], window_limit)
    totals = below.where("counted").groupBy(*KEY).agg(
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))

    ends = ends_digests(shared.where("last").select("conv_id", *KEY))
    grouped = nodes.join(totals, KEY).join(ends, KEY, "left").select(
        "conv_id", "depth", *UP, "up_alone", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))

    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    lonely = alone.select(
        "conv_id", "depth", *UP, "up_alone", one.alias("n_convs"),
        F.when(F.col("last"), zero).otherwise(one).alias("n_children"), one.alias("n_leaves"), zero.alias("saved_tokens"),
        F.when(F.col("last"), F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(F.lit(EMPTY)).alias("ends_sha256"))
    # The parent of what hangs below a prefix proven alone is in the same conversation.
    inner = lonely.where("up_alone").unionByName(grouped.where("up_alone OR depth = 0")).withColumn(
        "parent_conv_id", F.when(F.col("depth") > 0, F.col("conv_id")))
    outer = lonely.where("NOT up_alone").unionByName(grouped.where("NOT up_alone AND depth > 0"))
    parents = nodes.where("n_children > 0").select(
        *[F.col(k).alias(c) for c, k in zip(UP, KEY)], F.col("conv_id").alias("parent_conv_id"),
        F.col("n_children").alias("_children"))
    outer = join_counted(outer, parents, UP, "_children", ["conv_id", "depth"])
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return inner.select(*columns).unionByName(outer.select(*columns))


def prefix_trie(conversations):
    """The trie of conversations as they are."""
    turns = turns_of(conversations)
    return trie(turns.unionByName(roots(turns.select("conv_id").distinct())))


def family_trie(conversations):
    """The trie of conversations rebuilt on the heads of their families (`spliced`)."""
    return trie(spliced(written(turns_of(conversations), "turns")))
