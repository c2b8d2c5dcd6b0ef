"""Connected components and linking within groups, for graphs and groups of any size."""
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidewatch.llm.shared import join_counted, release_memory, written

TASKS_A_BLOCK = 4            # tasks for each block's worth of weight


def components(edges, most_rounds=60):
    """(node, label) for the nodes of `edges` (a, b): label is the smallest node of the component.

    Large-star and small-star steps on tables in the shared folder: the edges never grow, a hub is
    reduced to its smallest neighbour map-side, and after a number of rounds that grows with the
    logarithm of the component's size every node points at its label. The smallest neighbours are a
    table of their own, so that joins to them read plain shuffles, which Spark can split at a hub.
    Rows with nulls and loops are ignored; repeated edges count once.
    """
    a, b = F.col("a"), F.col("b")
    edges = edges.where((a != b) & a.isNotNull() & b.isNotNull()).select(
        F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    mark = None
    for _ in range(most_rounds):
        # Edges point down, so a node without edges of its own is its neighbours' smallest.
        lowest = written(edges.groupBy("a").agg(F.min("b").alias("low")), "lowest")
        large = edges.join(lowest.select(a.alias("b"), "low"), "b", "left").select(
            "a", F.coalesce("low", "b").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(lowest, "a").where("b > low").select(
            b.alias("a"), F.col("low").alias("b")).union(lowest.toDF("a", "b")).distinct()
        edges = written(small, "components")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(a.alias("node"), b.alias("label")).union(
        edges.select(b.alias("node"), b.alias("label")).distinct())


def forest(n, linked):
    """Pairs (root, member) that join what `linked(u, candidates)` joins, among 0..n-1.

    Breadth first: each member is compared once with what nothing has reached yet, so a group in
    which everything is alike costs about one comparison a member."""
    left, roots, members = np.arange(n), [], []
    while len(left) > 1:
        root, left = left[0], left[1:]
        queue = [root]
        while queue and len(left):
            near = linked(queue.pop(), left)
            got = left[near]
            if len(got):
                left = left[~near]
                queue.extend(got)
                roots += [root] * len(got)
                members += got.tolist()
    return np.array(roots, int), np.array(members, int)


def link_within(rows, make_linker, payload, block_weight):
    """Edges (a, b) that join, within each group, all ids that a chain of links of the group joins.

    `rows`: group, id (binary), weight (long) and the columns `payload`. `make_linker(pdf)` gives
    `linked(u, candidates) -> booleans` over the rows of a frame. Groups of more than `block_weight`
    are dealt into blocks by hash, linked block by block, and then every member outside the group's
    largest part so far is compared with all blocks, in pairs of blocks: tasks stay bounded, and no
    link between two parts is lost.
    """
    columns = ["group", "id", "weight", *payload]
    # Sizes first, as a table of their own: rows of large groups meet theirs by broadcast and go
    # straight to their block, and the number of tasks follows from the counted weight.
    sizes = written(rows.groupBy("group").agg(
        F.sum("weight").alias("total"), F.count(F.lit(1)).alias("n")).where("n > 1").select(
            "group", "n", "total", F.ceil(F.col("total") / block_weight).cast("int").alias("blocks")), "group-sizes")
    total = sizes.agg(F.sum("total")).first()[0] or 0
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total * TASKS_A_BLOCK // block_weight))
    block = F.when(F.col("blocks") == 1, 0).otherwise(
        F.pmod(F.xxhash64("id", "group"), F.col("blocks"))).cast("int")
    dealt = join_counted(rows.select(*columns), sizes.drop("total"), ["group"], "n", ["id"]).where(
        "blocks IS NOT NULL").drop("n").withColumn("block", block)

    def inside(pdf):
        # In order of the ids each star is around its smallest, so that no hub has smaller neighbours.
        pdf = pdf.drop_duplicates("id").sort_values("id", ignore_index=True)
        roots, members = forest(len(pdf), make_linker(pdf))
        ids = pdf["id"].to_numpy()
        if len(pdf) > 500:
            release_memory()
        return pd.DataFrame({"a": ids[roots], "b": ids[members]}, columns=["a", "b"])

    first = written(dealt.repartition(tasks, "group", "block").groupBy("group", "block").applyInPandas(
        inside, "a binary, b binary"), "links")
    large = sizes.where("blocks > 1")
    if large.isEmpty():
        return first

    labels = components(first)
    hot = written(dealt.where("blocks > 1").join(labels, F.col("id") == F.col("node"), "left").select(
        *columns, "blocks", "block", F.coalesce("label", "id").alias("part")), "large-groups")
    parts = hot.groupBy("group", "part").agg(F.sum("weight").alias("w"))
    main = parts.groupBy("group").agg(F.max_by("part", F.struct("w", "part")).alias("main"))
    marked = hot.join(main, "group")
    rest = marked.where("part != main").drop("main")
    shares = rest.groupBy("group").agg(
        F.ceil(F.sum("weight") / block_weight).cast("int").alias("shares"))
    rest = rest.join(shares, "group").withColumn("share", F.pmod(F.xxhash64("group", "id"), F.col("shares")).cast("int"))
    left = rest.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    right = hot.join(shares, "group").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))

    def across(few, many):
        few, many = few.drop_duplicates("id"), many.drop_duplicates("id")
        if few.empty or many.empty:
            return pd.DataFrame({"a": [], "b": []})
        both = pd.concat([few, many], ignore_index=True)
        linked, found = make_linker(both), []
        part, ids = pd.factorize(both["part"])[0], both["id"].to_numpy()
        for u in range(len(few)):
            others = np.arange(len(few), len(both))
            others = others[part[others] != part[u]]
            near = others[linked(u, others)] if len(others) else others
            _, one_each = np.unique(part[near], return_index=True)
            found += [(ids[u], ids[v]) for v in near[one_each]]
        return pd.DataFrame(found, columns=["a", "b"])

    keys = ["group", "block", "share"]
    wanted = [*keys, "id", "part", *payload]
    left, right = (side.select(*wanted).toDF(*wanted).groupBy(*keys) for side in (left, right))
    second = left.cogroup(right).applyInPandas(across, "a binary, b binary")
    return first.union(written(second, "links-across"))
