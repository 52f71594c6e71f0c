"""The property graph: edges (src, dst, rel_type, weight, ...) and what is asked of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from boscograph.session import cut_table as cut  # a checkpoint keeps what was inferred of its columns, which grows from round to round


def both_ways(edges: DataFrame, *keep: str) -> DataFrame:
    """Each edge from either end: name, other, keep..., so that one scan serves undirected questions."""
    cols = [F.col(k) for k in keep]
    pair = F.array(F.struct(F.col("src").alias("name"), F.col("dst").alias("other"), *cols), F.struct(F.col("dst").alias("name"), F.col("src").alias("other"), *cols))
    return edges.select(F.explode(pair).alias("x")).select("x.*")


def simple_pairs(edges: DataFrame) -> DataFrame:
    """Undirected pairs a < b of different nodes with n, the number of edges, and w, the sum of their weights."""
    e = edges.where("src <> dst")
    return e.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count("*").alias("n"), F.sum("weight").alias("w"))


def nodes_of(edges: DataFrame) -> DataFrame:
    return both_ways(edges).select("name").where("name is not null").distinct()


def undirected_degree(edges: DataFrame, least: int = 1) -> DataFrame:
    """name, degree (edges, a self-loop once per end) and n_neighbours (different others)."""
    d = both_ways(edges).groupBy("name").agg(F.count("*").alias("degree"), F.count_distinct(F.when(F.col("other") != F.col("name"), F.col("other"))).alias("n_neighbours"))
    return d.where(F.col("degree") >= least)


def stats(edges: DataFrame) -> DataFrame:
    """Node and edge counts and the four notions of density and mean degree; null where they aren't defined."""
    e = edges.agg(F.count("*").alias("edges"), F.count_distinct("rel_type").alias("edge_types"))
    n = nodes_of(edges).agg(F.count("*").alias("nodes"))
    p = simple_pairs(edges).agg(F.count("*").alias("pairs"))
    j = e.crossJoin(n).crossJoin(p)  # three single rows
    N, E, P = F.col("nodes"), F.col("edges"), F.col("pairs")
    return j.select("nodes", "edges", "pairs", "edge_types", F.when(N > 1, F.round(E / (N * (N - 1)), 4)).alias("density"), F.when(N > 1, F.round(2 * P / (N * (N - 1)), 4)).alias("simple_density"), F.when(N > 0, F.round(2 * E / N, 2)).alias("avg_degree"), F.when(N > 0, F.round(E / N, 2)).alias("edges_per_node"))


def induced(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Edges both of whose ends are in names.name."""
    n = names.select("name")
    return edges.join(n.withColumnRenamed("name", "src"), "src", "left_semi").join(n.withColumnRenamed("name", "dst"), "dst", "left_semi")


def reachable(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """name, dist of all nodes within hops steps of seeds.name, edges taken either way.

    Only the newest frontier is joined with the edges, from which the nodes already found are removed; a hub is reached once.
    """
    around = both_ways(edges).where("name <> other")
    found = cut(seeds.select("name").distinct().withColumn("dist", F.lit(0)))
    edge = found
    for step in range(1, hops + 1):
        new = edge.select("name").join(around, "name").select(F.col("other").alias("name")).distinct().join(found, "name", "left_anti").withColumn("dist", F.lit(step))
        edge = cut(new)
        if edge.isEmpty():
            break
        found = found.unionByName(edge)
    return found


def neighbourhood(edges: DataFrame, seeds: DataFrame, hops: int) -> tuple[DataFrame, DataFrame]:
    """Nodes within hops, and the edges on paths of that length: those with an end nearer than hops."""
    found = reachable(edges, seeds, hops)
    inner = found.where(F.col("dist") < hops).select("name")
    near = [inner.select(F.col("name").alias(end), F.lit(True).alias(f"_{end}")) for end in ("src", "dst")]
    on = edges.join(near[0], "src", "left").join(near[1], "dst", "left").where("_src or _dst").drop("_src", "_dst")
    return found, on


def shortest_path(edges: DataFrame, source: str, target: str, most: int = 5) -> DataFrame:
    """The shortest undirected path from source to target within most steps: step, name; the smallest in name order among equals, no row if there is none.

    Breadth first; each new node keeps the path to it that is smallest, as an array (there are most + 1 names in it at most).
    """
    spark = edges.sparkSession
    around = both_ways(edges).where("name <> other").select("name", "other").distinct()
    paths = spark.createDataFrame([(source, [source])], "name string, path array<string>")
    seen = paths.select("name")
    hit = paths.where(F.col("name") == target)
    for _ in range(most):
        if not hit.isEmpty() or paths.isEmpty():
            break
        new = paths.join(around, "name").select(F.col("other").alias("name"), F.concat("path", F.array("other")).alias("path")).join(seen, "name", "left_anti")
        paths = cut(new.groupBy("name").agg(F.min("path").alias("path")))
        seen = seen.unionByName(paths.select("name"))
        hit = paths.where(F.col("name") == target)
    return hit.select(F.posexplode("path").alias("step", "name"))


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """name, component (its smallest name) of every node of nodes.name and of the edges; lone nodes are their own component.

    Smallest labels go along the edges, with pointer jumping after each step; links are carried over to the labels, so that they shrink.
    """
    own = simple_pairs(edges).select("a", "b")
    label = cut(nodes.select("name").unionByName(nodes_of(edges)).distinct().withColumn("component", F.col("name")))
    links = cut(own)
    while not links.isEmpty():
        low = links.groupBy("b").agg(F.min("a").alias("p")).select(F.col("b").alias("v"), "p")
        low = cut(low)
        while True:
            up = low.select(F.col("v").alias("p"), F.col("p").alias("q"))
            nxt = cut(low.join(up, "p", "left").select("v", F.coalesce("q", "p").alias("p"), F.col("q").isNotNull().alias("m")))
            low = nxt.select("v", "p")
            if nxt.where("m").isEmpty():
                break
        label = cut(label.join(low.withColumnRenamed("v", "component"), "component", "left").select("name", F.coalesce("p", "component").alias("component")))
        for end in ("a", "b"):
            links = links.join(low.withColumnRenamed("v", end), end, "left").withColumn(end, F.coalesce("p", end)).drop("p")
        links = cut(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return label


def label_propagation(edges: DataFrame, nodes: DataFrame, rounds: int = 500) -> DataFrame:
    """name, community: every node takes the most frequent label of its neighbours and itself, the smallest of ties, until none changes.

    A round moves one half of the nodes, chosen by hash anew for every two rounds, so that neighbours don't swap for ever. An error if labels
    still change after `rounds` such pairs.
    """
    pairs = cut(simple_pairs(edges).select("a", "b"))
    around = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("name"), F.col("b").alias("other")), F.struct(F.col("b").alias("name"), F.col("a").alias("other")))).alias("x")).select("x.*")
    label = cut(nodes.select("name").unionByName(nodes_of(edges)).distinct().withColumn("community", F.col("name")))
    for r in range(rounds):
        changed = False
        for half in range(2):
            turn = F.pmod(F.xxhash64("name", F.lit(r)), F.lit(2)) == half
            votes = around.where(turn).join(label.withColumnRenamed("name", "other"), "other").select("name", "community").unionByName(label)
            best = votes.groupBy("name", "community").agg(F.count("*").alias("n")).groupBy("name").agg(F.min_by("community", F.struct(-F.col("n"), "community")).alias("community"))
            moved = best.join(label.withColumnRenamed("community", "was"), "name").select("name", "community", (F.col("community") != F.col("was")).alias("m"))
            moved = cut(moved)
            label = moved.select("name", "community")
            changed |= not moved.where("m").isEmpty()
        if not changed:
            return label
    raise RuntimeError(f"labels still change after {rounds} rounds")


def louvain(edges: DataFrame, nodes: DataFrame, levels: int = 100, rounds: int = 500, resolution: float = 1.0, tolerance: float = 1e-6) -> DataFrame:
    """name, community (a member's name) by greedy modularity on undirected weighted pairs; lone nodes stay alone.

    A round moves the nodes of one half (chosen by hash, in turns, so that neighbours don't swap for ever) to the neighbouring community of the
    largest gain, the smallest of ties. A level settles when no node moves in two rounds, or when four times two rounds don't raise the best modularity
    so far by `tolerance`; the communities of that best become the nodes of the next. Where a level ends so without a gain over the one before,
    moves that disturb one another are to blame: it goes on with those that have no larger one at either of their communities, whose gains add up.
    It ends with a level that gains less than `tolerance`; an error if a level takes over `rounds` rounds, or if over `levels` levels are needed.
    """
    everyone = cut(nodes.select("name").unionByName(nodes_of(edges)).distinct())
    pairs = cut(simple_pairs(edges).select("a", "b", F.col("w").cast("double").alias("w")).where("w > 0"))
    m2 = 2 * (pairs.agg(F.sum("w")).first()[0] or 0.0)
    belongs = everyone.withColumn("c", F.col("name"))
    if not m2:
        return belongs.withColumnRenamed("c", "community")
    loops = None  # inner weight of merged nodes only adds to their strength
    quality = None  # modularity of what `belongs` says
    for _ in range(levels):
        around = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("u"), "w"), F.struct(F.col("b").alias("v"), F.col("a").alias("u"), "w"))).alias("x")).select("x.*")
        own = around.groupBy("v").agg(F.sum("w").alias("k"))
        strength = cut(own if loops is None else own.unionByName(loops.select("v", "k")).groupBy("v").agg(F.sum("k").alias("k")))
        label = cut(strength.select("v", "k", F.col("v").alias("c")))
        start = _quality(around, label, loops, m2, resolution)
        quality = start if quality is None else quality
        best_label, top, idle, changed, strict = label, start, 0, False, False
        for r in range(rounds):
            tot = label.groupBy("c").agg(F.sum("k").alias("tot"))
            turn = label if strict else label.where(F.pmod(F.xxhash64("v", F.lit(r // 2)), F.lit(2)) == r % 2)
            links = around.join(label.select(F.col("v").alias("u"), "c"), "u").groupBy("v", "c").agg(F.sum("w").alias("in_w"))
            options = turn.select("v", "k", F.col("c").alias("old")).join(links, "v").join(tot, "c")
            rest = F.col("tot") - F.when(F.col("c") == F.col("old"), F.col("k")).otherwise(0.0)
            gain = F.round(F.col("in_w") - resolution * F.col("k") * rest / m2, 9)
            best = options.groupBy("v").agg(F.min_by("c", F.struct(-gain, "c")).alias("to"), F.max(gain).alias("g"), F.max(F.when(F.col("c") == F.col("old"), gain)).alias("stay"))
            alone = -resolution * F.col("k") * (F.col("tot") - F.col("k")) / m2
            more = F.col("g") - F.coalesce("stay", F.round(alone, 9))
            moved = label.join(best, "v", "left").join(tot, "c").select("v", "k", F.when((more > 1e-9) & (F.col("g") > 0), F.col("to")).otherwise(F.col("c")).alias("n"), "c", more.alias("more"))
            if strict:
                moved = cut(moved)
                touched = moved.where("n <> c").select("v", "more", F.explode(F.array("c", "n")).alias("at"))
                first = touched.groupBy("at").agg(F.max(F.struct("more", "v")).alias("f")).groupBy(F.col("f.v").alias("v")).agg((F.count("*") == 2).alias("goes"))
                moved = moved.join(first, "v", "left").withColumn("n", F.when(F.col("goes"), F.col("n")).otherwise(F.col("c")))
            moved = cut(moved.select("v", "k", F.col("n").alias("c"), (F.col("n") != F.col("c")).alias("m")))
            label = moved.select("v", "k", "c")
            changed |= not moved.where("m").isEmpty()
            if r % 2 == 0 and not strict:
                continue
            if not changed:
                break
            changed, now = False, _quality(around, label, loops, m2, resolution)
            gained = now > top + tolerance
            idle = 0 if gained else idle + 1
            if now > top:
                best_label, top = label, now
            if strict and not gained:
                break
            if idle == 4:
                if top > quality + tolerance:
                    break
                label, strict = best_label, True
        else:
            raise RuntimeError(f"communities still gain after {rounds} rounds")
        if top <= quality + tolerance:
            return belongs.withColumnRenamed("c", "community")
        label, quality = best_label, top
        belongs = cut(belongs.join(label.select(F.col("v").alias("c"), F.col("c").alias("n")), "c", "left").select("name", F.coalesce("n", "c").alias("c")))
        at = label.select("v", "c")
        merged = pairs.join(at.select(F.col("v").alias("a"), F.col("c").alias("x")), "a").join(at.select(F.col("v").alias("b"), F.col("c").alias("y")), "b")
        inner = merged.where("x = y").groupBy(F.col("x").alias("v")).agg((2 * F.sum("w")).alias("k"))
        old = None if loops is None else loops.join(at, "v").groupBy(F.col("c").alias("v")).agg(F.sum("k").alias("k"))
        loops = cut(inner if old is None else inner.unionByName(old).groupBy("v").agg(F.sum("k").alias("k")))
        pairs = cut(merged.where("x <> y").groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum("w").alias("w")))
    raise RuntimeError(f"communities still gain after {levels} levels")


def leiden(edges: DataFrame, nodes: DataFrame, resolution: float = 1.0) -> DataFrame:
    """name, community by louvain(), refined: a community whose members don't hang together by links inside it is parted into the components that do, which can only raise modularity. The name is a member's."""
    found = cut(louvain(edges, nodes, resolution=resolution))
    at = found.select("name", "community")
    pairs = simple_pairs(edges).join(at.select(F.col("name").alias("a"), F.col("community").alias("x")), "a").join(at.select(F.col("name").alias("b"), F.col("community").alias("y")), "b")
    inside = pairs.where("x = y").select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("w").alias("weight"))
    return components(inside, found.select("name")).select("name", F.col("component").alias("community"))


def _quality(around: DataFrame, label: DataFrame, loops: DataFrame | None, m2: float, resolution: float) -> float:
    """Modularity of label (v, k, c); loops (v, k) is twice the weight inside of each v."""
    ends = label.select("v", "c"), label.select(F.col("v").alias("u"), F.col("c").alias("d"))
    inner = around.join(ends[0], "v").join(ends[1], "u").where("c = d").agg(F.sum("w")).first()[0] or 0.0
    inner += (loops.agg(F.sum("k")).first()[0] or 0.0) if loops is not None else 0.0
    square = label.groupBy("c").agg(F.sum("k").alias("t")).agg(F.sum(F.col("t") * F.col("t"))).first()[0]
    return inner / m2 - resolution * square / m2 / m2


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """modularity of labels (name, community) on the undirected weighted pairs; one row."""
    pairs = simple_pairs(edges).select("a", "b", "w")
    lab = labels.select("name", "community")
    j = pairs.join(lab.select(F.col("name").alias("a"), F.col("community").alias("x")), "a").join(lab.select(F.col("name").alias("b"), F.col("community").alias("y")), "b")
    total = j.agg(F.sum("w").alias("m"), F.sum(F.when(F.col("x") == F.col("y"), F.col("w")).otherwise(0)).alias("i"))
    vol = j.select(F.explode(F.array(F.struct(F.col("x").alias("c"), "w"), F.struct(F.col("y").alias("c"), "w"))).alias("z")).select("z.*").groupBy("c").agg(F.sum("w").alias("v")).agg(F.sum(F.col("v") * F.col("v")).alias("q"))
    return total.crossJoin(vol).select((F.col("i") / F.col("m") - F.col("q") / (4 * F.col("m") * F.col("m"))).alias("modularity"))


def clustering(edges: DataFrame) -> DataFrame:
    """name, degree (neighbours), triangles and the local clustering coefficient of every node with an edge to another.

    Pairs are directed from the end with fewer neighbours to the other, which bounds the pairs laid out at a hub by the square root of the edges.
    """
    pairs = cut(simple_pairs(edges).select("a", "b"))
    deg = pairs.select(F.explode(F.array("a", "b")).alias("name")).groupBy("name").agg(F.count("*").alias("degree"))
    da, db = deg.select(F.col("name").alias("a"), F.col("degree").alias("da")), deg.select(F.col("name").alias("b"), F.col("degree").alias("db"))
    j = pairs.join(da, "a").join(db, "b")
    lower = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    arcs = cut(j.select(F.when(lower, F.col("a")).otherwise(F.col("b")).alias("s"), F.when(lower, F.col("b")).otherwise(F.col("a")).alias("t")))
    wedge = arcs.select("s", F.col("t").alias("x")).join(arcs.select("s", F.col("t").alias("y")), "s").where("x < y")
    closed = wedge.join(pairs.select(F.col("a").alias("x"), F.col("b").alias("y")), ["x", "y"])
    per = closed.select(F.explode(F.array("s", "x", "y")).alias("name")).groupBy("name").agg(F.count("*").alias("triangles"))
    d = deg.join(per, "name", "left").withColumn("triangles", F.coalesce("triangles", F.lit(0)))
    return d.select("name", "degree", "triangles", F.when(F.col("degree") > 1, 2 * F.col("triangles") / (F.col("degree") * (F.col("degree") - 1))).otherwise(F.lit(0.0)).alias("clustering"))


def ranked(df: DataFrame, by: str, limit: int, name: str = "name") -> DataFrame:
    """The first rows by a column, largest first, names deciding ties."""
    return df.orderBy(F.desc_nulls_last(by), name).limit(limit)


def page(nodes: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """A page of nodes (name, type, total_degree): type Other last, then by degree and name."""
    return nodes.orderBy(F.when(F.col("type") == "Other", 1).otherwise(0), F.desc("total_degree"), "name").offset(offset).limit(limit)


def top_per_group(df: DataFrame, group: str, order: list, n: int) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col("_r") <= n).drop("_r")
