"""Splits that keep related records together (problem 2).

Links between entities are contracted round by round as Borůvka did: every component takes its
smallest outgoing edge, the chosen edges join the persisted spanning forest, and the components
they connect become one. The roots of the forest are then stratified by size band and dealt
systematically to the splits.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill.functions.ids import named_speakers, regular_speaker
from voxmill.operators.ordering import hashed_rank
from voxmill.runtime import Workspace

#: Rows that the table of splits may have.
MAX_SPLITS = 1000


@dataclass
class Forest:
    """``roots``: (node, root) of every node; ``edges``: the spanning forest's edges (a, b)."""

    roots: DataFrame
    edges: DataFrame


def spanning_forest(nodes: DataFrame, links: DataFrame, ws: Workspace) -> Forest:
    """Borůvka contraction of ``links`` (a, b) over ``nodes`` (node).

    Links of unknown or null ends are left out. Edge weights are hashes of the ends, so all differ and chosen
    edges make no cycle but the pair of components that choose each other; of these the smaller
    becomes the root. Chosen parents are followed to their roots by pointer doubling. Parallel
    edges are reduced to the lightest after each round, by an aggregation that starts where the
    rows lie, so a hub entity costs no more than its distinct neighbours. The number of components
    that have an outgoing edge at least halves each round.
    """
    known = nodes.select("node").filter(F.col("node").isNotNull()).distinct()
    ends = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()
    ends = ends.join(known.withColumnRenamed("node", "a"), "a", "left_semi").join(known.withColumnRenamed("node", "b"), "b", "left_semi")
    weight = F.struct(F.xxhash64("a", "b").alias("w"), "a", "b")
    # u and v are the components at the ends, e the lightest original edge between them.
    live = ws.save(ends.select(F.col("a").alias("u"), F.col("b").alias("v"), weight.alias("e")), "live")
    roots = known.select("node", F.col("node").alias("root"))
    forest: list[DataFrame] = []
    while live.head(1):
        both = live.select("u", "v", "e").unionByName(live.select(F.col("v").alias("u"), F.col("u").alias("v"), "e"))
        pick = both.groupBy("u").agg(F.min(F.struct("e", "v")).alias("m")).select("u", F.col("m.v").alias("p"), F.col("m.e").alias("e"))
        pick = ws.save(pick, "pick")
        forest.append(pick.select("e.a", "e.b"))
        back = pick.select(F.col("u").alias("p"), F.col("p").alias("pp"))
        # A mutual pair: the smaller end is the root.
        up = pick.join(back, "p", "left").select("u", F.when((F.col("pp") == F.col("u")) & (F.col("u") < F.col("p")), F.col("u")).otherwise(F.col("p")).alias("p"))
        up = ws.save(up, "up")
        while True:
            above = up.select(F.col("u").alias("p"), F.col("p").alias("g"))
            up2 = ws.save(up.join(above, "p").select("u", "p", "g"), "up")
            moved = up2.filter("p <> g").head(1)
            up = up2.select("u", F.col("g").alias("p"))
            if not moved:
                break
        roots = ws.save(roots.join(up.select(F.col("u").alias("root"), "p"), "root", "left").select("node", F.coalesce("p", "root").alias("root")), "roots")
        next_live = live.join(up.select("u", F.col("p").alias("pu")), "u", "left").join(up.select(F.col("u").alias("v"), F.col("p").alias("pv")), "v", "left")
        next_live = next_live.select(F.coalesce("pu", "u").alias("u"), F.coalesce("pv", "v").alias("v"), "e").filter("u <> v")
        next_live = next_live.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.min("e").alias("e"))
        done, live = live, ws.save(next_live, "live")
        ws.drop(done)
    spark = nodes.sparkSession
    edges = spark.createDataFrame([], links.select("a", "b").schema)
    for f in forest:
        edges = edges.unionByName(f)
    return Forest(roots, ws.save(edges.distinct(), "forest"))


def star_links(groups: DataFrame, group: str, member: str) -> DataFrame:
    """Links (a, b) that connect all members of each group to its smallest member.

    As many links as members, never all pairs. The smallest member is found by an aggregation that
    starts where the rows lie; the join back is on the group, whose copies are reduced first.
    """
    g = groups.select(group, member).filter(F.col(group).isNotNull() & F.col(member).isNotNull()).distinct()
    hub = g.groupBy(group).agg(F.min(member).alias("a"), F.count("*").alias("_n")).filter("_n > 1").select(group, "a")
    return g.join(hub, group).filter(F.col(member) != F.col("a")).select("a", F.col(member).alias("b"))


def _only_known(labels: DataFrame, known: DataFrame, col: str) -> DataFrame:
    return labels.join(known.select(F.col("node").alias(col)), col, "left_semi")


def speaker_forest(spark: SparkSession, sf_dir: str, ws: Workspace) -> Forest:
    t = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("speakers", "turns", "mixed")}
    nodes = t["speakers"].select(F.col("speaker_id").alias("node"))
    talk = t["turns"].select("conv", regular_speaker(F.col("speaker")).alias("s"))
    talk = star_links(_only_known(talk, nodes, "s"), "conv", "s")
    # A segment's set of names is its own group, so equal sets are reduced before they are exploded.
    named = t["mixed"].select(named_speakers(F.col("speaker_id")).alias("n")).filter(F.size("n") > 1).distinct()
    named = named.select(F.array_join("n", " ").alias("g"), F.explode("n").alias("s"))
    segment = star_links(_only_known(named, nodes, "s"), "g", "s")
    same = t["speakers"].select(F.col("speaker_id").alias("a"), regular_speaker(F.col("same_as")).alias("b")).filter("b is not null")
    return spanning_forest(nodes, talk.unionByName(segment).unionByName(same), ws)


def deal(sizes: DataFrame, targets: list[tuple[str, float]], rows: int, seed: int = 5) -> DataFrame:
    """(root, split) from ``sizes`` (root, size): roots dealt to splits, stratified by size band.

    A band holds the roots of sizes 2^k .. 2^(k+1)-1. Only the bands' totals (at most 64 rows) reach
    the driver: from the largest band down, each split is owed its share of all rows so far, less
    what it has; the band's roots are apportioned to what is owed. Inside a band the roots lie in
    hashed order, and consecutive ranks are dealt to the splits in turn. Shares need not add up to
    one; null and negative shares count as zero.
    """
    weights = [max(0.0, float(s or 0.0)) for _, s in targets]
    total = sum(weights) or 1.0
    banded = sizes.withColumn("band", F.floor(F.log2(F.greatest(F.col("size"), F.lit(1)).cast("double"))).cast("int"))
    bands = sorted(banded.groupBy("band").agg(F.count("*").alias("n"), F.sum("size").alias("rows")).collect(), reverse=True)
    have, seen, cuts = [0.0] * len(targets), 0.0, []
    for b in bands:
        seen += b["rows"]
        mean = b["rows"] / b["n"]
        owed = [max(0.0, w / total * seen - h) / mean for w, h in zip(weights, have)]
        scale = b["n"] / (sum(owed) or 1.0)
        exact = [o * scale for o in owed]
        give = [int(x) for x in exact]
        for i in sorted(range(len(exact)), key=lambda i: give[i] - exact[i])[: b["n"] - sum(give)]:
            give[i] += 1
        give[give.index(max(give))] += b["n"] - sum(give)
        at = 0
        for i, (name, _) in enumerate(targets):
            have[i] += give[i] * mean
            if give[i]:
                cuts.append((b["band"], at, at + give[i], name))
            at += give[i]
    spark = sizes.sparkSession
    cut = F.broadcast(spark.createDataFrame(cuts, "cut_band int, lo long, hi long, split string"))  # at most 64 x MAX_SPLITS rows
    ranked = hashed_rank(banded, ["band"], F.xxhash64(F.lit(seed), "root"), ["root"], rows)
    return ranked.join(cut, (F.col("band") == F.col("cut_band")) & (F.col("rank") > F.col("lo")) & (F.col("rank") <= F.col("hi"))).select("root", "split")


def assign_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(table_name, row_id, split) for every row of utterances, turns and mixed.

    An utterance follows its speaker's root, a mixed segment that of its known speakers, and a turn
    that of its conversation. A label that names nobody known, and a conversation without a known
    speaker, are roots of their own; so is each row that has neither. Every row comes out once.
    """
    ws = Workspace(spark, "splits")
    forest = speaker_forest(spark, sf_dir, ws)
    known = forest.roots
    turns = spark.read.parquet(f"{sf_dir}/turns.parquet").select(F.col("turn_id").alias("row_id"), "conv", regular_speaker(F.col("speaker")).alias("node"))
    mixed = spark.read.parquet(f"{sf_dir}/mixed.parquet").select(F.col("mixed_id").alias("row_id"), named_speakers(F.col("speaker_id")).alias("names"))
    utt = spark.read.parquet(f"{sf_dir}/utterances.parquet").select("row_id", regular_speaker(F.col("speaker")).alias("node"))
    own = lambda name: F.concat_ws(" ", F.lit("row"), F.lit(name), F.col("row_id").cast("string"))
    label = F.concat(F.lit("label "), F.col("node"))

    # A hot speaker's rows join a side with one row per speaker; AQE splits their partition.
    u = utt.join(known, "node", "left").select("row_id", F.coalesce("root", label, own("utterances")).alias("root"))
    of_conv = turns.select("conv", "node").filter("conv is not null").distinct().join(known, "node").groupBy("conv").agg(F.min("root").alias("conv_root"))
    t = turns.join(of_conv, "conv", "left").join(known, "node", "left")
    t = t.select("row_id", F.coalesce("conv_root", F.concat(F.lit("conv "), F.col("conv")), F.col("root"), label, own("turns")).alias("root"))
    of_names = mixed.filter(F.size("names") > 0).select("names").distinct().withColumn("node", F.explode("names")).join(known, "node").groupBy("names").agg(F.min("root").alias("root"))
    m = mixed.join(of_names, "names", "left")
    m = m.select("row_id", F.coalesce("root", F.concat(F.lit("label "), F.get("names", F.lit(0))), own("mixed")).alias("root"))
    parts = [d.select(F.lit(n).alias("table_name"), "row_id", "root") for n, d in (("utterances", u), ("turns", t), ("mixed", m))]
    placed = parts[0].unionByName(parts[1]).unionByName(parts[2])
    placed = ws.save(placed, "placed")
    sizes = ws.save(placed.groupBy("root").agg(F.count("*").alias("size")), "sizes")
    split = spark.read.parquet(f"{sf_dir}/split_targets.parquet").limit(MAX_SPLITS + 1).collect()
    if len(split) > MAX_SPLITS:
        raise ValueError(f"more than {MAX_SPLITS} splits")
    dealt = deal(sizes, [(s["split_name"], s["share"]) for s in split], sizes.count())
    return placed.join(dealt, "root").select("table_name", "row_id", "split")


def classes(forest: Forest) -> DataFrame:
    """One row per node: speaker_id, class_id (the smallest node under its root) and n_members."""
    m = forest.roots
    own = m.groupBy("root").agg(F.min("node").alias("class_id"), F.count("*").alias("n_members"))
    return m.join(own, "root").select(F.col("node").alias("speaker_id"), "class_id", "n_members")


def same_split_pairs(forest: Forest) -> DataFrame:
    """All pairs of nodes under one root, smaller first: the form in which the links' closure is asked for."""
    m = forest.roots
    linked = m.groupBy("root").agg(F.count("*").alias("_n")).filter("_n > 1").select("root")
    m = m.join(linked, "root", "left_semi")
    a, b = m.select("root", F.col("node").alias("speaker_a")), m.select("root", F.col("node").alias("speaker_b"))
    return a.join(b, "root").filter("speaker_a < speaker_b").select("speaker_a", "speaker_b")


def speaker_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(speaker_forest(spark, sf_dir, Workspace(spark, "splits")))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_split_pairs(speaker_forest(spark, sf_dir, Workspace(spark, "splits")))


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and share of each split, by table and overall."""
    n = assign_splits(spark, sf_dir).groupBy("split", "table_name").agg(F.count("*").alias("n_rows"))
    return n.groupBy("split").agg(F.sum("n_rows").alias("n_rows"), *[F.sum(F.when(F.col("table_name") == t, F.col("n_rows")).otherwise(0)).alias(f"n_{t}") for t in ("utterances", "turns", "mixed")])

