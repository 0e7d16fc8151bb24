"""Lineage operators over edges (parent, child, ord) and cells (cell_id, ...). Cell ids are t * 10000 + number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxelith.operators.graph import fixpoint_roots
from voxelith.schemas import FRAME


def frame(cell: Column) -> Column:
    return F.expr(f"{_name(cell)} div {FRAME}") if isinstance(cell, str) else F.floor(cell / FRAME).cast("int")


def _name(c) -> str:
    return c


def decode(cells: DataFrame) -> DataFrame:
    return cells.select("cell_id", F.expr(f"CAST(cell_id div {FRAME} AS INT)").alias("t"), (F.col("cell_id") % FRAME).cast("int").alias("nu"))


def encode(t: Column, nu: Column) -> Column:
    return t.cast("long") * FRAME + nu


def time_named(pattern: Column, t: Column) -> Column:
    """$TIME becomes the last three digits of t, padded."""
    return F.replace(pattern, F.lit("$TIME"), F.right(F.concat(F.lit("00"), t.cast("string")), F.lit(3)))


def before(edges: DataFrame, t: int) -> DataFrame:
    """The tree as loaded up to time t: mothers before t."""
    return edges.where(F.expr(f"parent div {FRAME}") < t)


def leaves(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("child").alias("cell_id")).join(edges.select(F.col("parent").alias("cell_id")), "cell_id", "left_anti")


def roots(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("parent").alias("cell_id")).distinct().join(edges.select(F.col("child").alias("cell_id")), "cell_id", "left_anti")


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("parent").agg(F.count("*").cast("int").alias("n_children"), F.array_sort(F.collect_list(F.struct("ord", "child"))).alias("_c")).select("parent", "n_children", F.transform("_c", lambda c: c["child"]).alias("children"))


def sisters(edges: DataFrame) -> DataFrame:
    """Ordered pairs of daughters of one mother (out-degree is 2 at most)."""
    a = edges.select("parent", F.col("child").alias("cell_id"))
    return a.join(edges.select("parent", F.col("child").alias("sister")), "parent").where("cell_id <> sister").select("cell_id", "sister")


def chains(edges: DataFrame, cells: DataFrame) -> DataFrame:
    """cell_id, chain_id (first cell of its undivided chain), place. Chains are followed by pointer doubling, so the number of rounds is the logarithm of the longest."""
    single = edges.withColumn("_n", F.count("*").over(W.partitionBy("parent"))).where("_n = 1").select(F.col("child").alias("cell_id"), F.col("parent").alias("up"))
    nodes = cells.select("cell_id").join(single, "cell_id", "left").select("cell_id", F.coalesce("up", "cell_id").alias("up"), F.col("up").isNotNull().cast("int").alias("place"))
    return fixpoint_roots(nodes, "cell_id", "up", "place").withColumnRenamed("up", "chain_id")


def chain_volumes(edges: DataFrame, cells: DataFrame, compat: bool = True) -> DataFrame:
    """Volume series along chains: with ``compat`` the first value comes twice and the last one is left out."""
    c = chains(edges, cells).join(cells.select("cell_id", "volume"), "cell_id")
    w = W.partitionBy("chain_id").orderBy("place")
    series = F.coalesce(F.lag("volume").over(w), F.col("volume")) if compat else F.col("volume")
    return c.select("chain_id", "place", "cell_id", series.cast("long").alias("series"), F.count("*").over(W.partitionBy("chain_id")).cast("int").alias("length"))


def sister_correlation(edges: DataFrame, cells: DataFrame, compat: bool = True) -> DataFrame:
    """Pearson correlation of the volume series of the chains that begin with two sisters, over their common length but one."""
    s = chain_volumes(edges, cells, compat).select("chain_id", "place", "series", "length")
    pairs = sisters(edges).where("cell_id < sister")
    a = pairs.join(s.withColumnRenamed("chain_id", "cell_id"), "cell_id")
    b = s.select(F.col("chain_id").alias("sister"), "place", F.col("series").alias("series2"), F.col("length").alias("length2"))
    both = a.join(b, ["sister", "place"]).where(F.col("place") < F.least("length", "length2") - 1)
    return both.groupBy("cell_id", "sister").agg(F.count("*").cast("int").alias("n"), F.round(F.try_divide(F.covar_samp("series", "series2"), F.stddev_samp("series") * F.stddev_samp("series2")), 6).alias("r"))


def branches_to_delete(edges: DataFrame, cells: DataFrame, threshold: int, last_time: int, short: int = 25, pearson: float = 0.9) -> DataFrame:
    """Branches (chains of leaves that end early or small) that are short or anticorrelated with their sister, largest first id first."""
    c = chain_volumes(edges, cells, True)
    ends = c.where(F.col("place") == F.col("length") - 1).select("chain_id", F.col("cell_id").alias("leaf"), "length")
    small = ends.join(leaves(edges), ends["leaf"] == F.col("cell_id"), "left_semi").join(cells.select(F.col("cell_id").alias("leaf"), "t", "volume"), "leaf").where((F.col("t") < last_time) | (F.col("volume") < threshold))
    cor = sister_correlation(edges, cells)
    cor = cor.select(F.col("cell_id").alias("chain_id"), "r").union(cor.select("sister", "r"))
    return small.join(cor, "chain_id", "left").where((F.col("length") < short) | (F.col("r") < -pearson)).select("chain_id", "leaf", "length", "r")


def fuse_targets(pairs: DataFrame) -> DataFrame:
    """Final target of chained fusions (give, get)."""
    every = pairs.select(F.col("give").alias("cell_id"), F.col("get").alias("up"))
    ends = pairs.select(F.col("get").alias("cell_id")).distinct().join(every.select("cell_id"), "cell_id", "left_anti").withColumn("up", F.col("cell_id"))
    nodes = every.union(ends).withColumn("place", (F.col("cell_id") != F.col("up")).cast("int"))
    return fixpoint_roots(nodes, "cell_id", "up", "place").where("place > 0").select(F.col("cell_id").alias("give"), F.col("up").alias("get"), F.col("place").cast("int").alias("steps"))


def apply_fusion(cells: DataFrame, edges: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New cells with summed volumes, and new edges with both ends renamed and merged."""
    final = fuse_targets(pairs).select("give", "get")
    renamed = cells.join(final, cells["cell_id"] == final["give"], "left").withColumn("cell_id", F.coalesce("get", "cell_id"))
    volumes = renamed.groupBy("cell_id").agg(F.sum("volume").alias("volume"))
    p, c = final.toDF("parent", "_p"), final.toDF("child", "_c")
    moved = edges.join(p, "parent", "left").join(c, "child", "left").select(F.coalesce("_p", "parent").alias("parent"), F.coalesce("_c", "child").alias("child")).distinct()
    return volumes, moved.withColumn("ord", F.row_number().over(W.partitionBy("parent").orderBy("child")))


def volume_audit(edges: DataFrame, cells: DataFrame, bigger: float = 0.1, lower: float = -0.1, look: float = -0.5) -> DataFrame:
    """ratio = 1 - mother / sum of daughters for every mother, and its class."""
    v = cells.select("cell_id", "volume")
    sums = edges.join(v.withColumnRenamed("cell_id", "child"), "child").groupBy("parent").agg(F.sum("volume").alias("daughters"))
    ratio = 1 - F.col("volume") / F.col("daughters")
    return sums.join(v.withColumnRenamed("cell_id", "parent"), "parent").select("parent", "volume", "daughters", F.round(ratio, 6).alias("ratio"), F.when(ratio > bigger, "bigger").when(ratio < look, "to_look_at").when(ratio < lower, "lower").otherwise("conserved").alias("verdict"))


def choose_h(sweep: DataFrame, thau: int = 25) -> DataFrame:
    """Per cell the h to use from a sweep (cell, h, n): two seeds if #(n=2) * #(n>=2) reaches thau, else one, two, three seeds, else none."""
    first = lambda k: F.max(F.when(F.col("n") == k, F.col("h")))  # noqa: E731  the sweep goes down, so the first h is the largest
    g = sweep.groupBy("cell").agg((F.count_if(F.col("n") == 2) * F.count_if(F.col("n") >= 2)).alias("score"), first(1).alias("h1"), first(2).alias("h2"), first(3).alias("h3"))
    two = (F.col("score") >= thau) & F.col("h2").isNotNull()
    n = F.when(two, 2).when(F.col("h1").isNotNull(), 1).when(F.col("h2").isNotNull(), 2).when(F.col("h3").isNotNull(), 3).otherwise(0)
    return g.select("cell", "score", n.alias("seeds"), F.when(two, F.col("h2")).otherwise(F.coalesce("h1", "h2", "h3", F.lit(0))).alias("h"))


# --- names and fates ---------------------------------------------------------------

#: Coarse fates, by the names (without side) of the cells that found them, and their colours.
FATES = {
    "Endoderm": (["a7.0001", "a7.0002", "a7.0005", "b7.0001", "b7.0002", "b9.0034"], 7),
    "germ line": (["b7.0006"], 3),
    "Epidermis": (["a7.0011", "a7.0012", "a7.0014", "a7.0015", "a7.0016", "b8.0020", "b8.0018", "b7.0011", "b7.0012", "b7.0013", "b7.0014", "b7.0015", "b7.0016"], 2),
    "Mesoderm": (["a7.0003", "a7.0006", "a7.0007", "b7.0003", "b7.0005", "b7.0004", "b7.0008", "a9.0031", "b9.0033", "b7.0007"], 6),
    "Nervous system": (["a7.0004", "a7.0009", "a7.0010", "a7.0013", "a8.0015", "a9.0032", "b8.0019"], 5),
}
#: Fine fates, as above.
FINE_FATES = {
    "Anterior Endoderm": (["a7.0001", "a7.0002", "a7.0005"], 1),
    "Posterior Endoderm": (["b7.0001", "b7.0002", "b9.0034"], 2),
    "germ line": (["b7.0006"], 3),
    "Mesoderm 1 Notochord": (["a7.0003", "a7.0007"], 4),
    "Mesoderm 2 Notochord": (["b8.0006"], 5),
    "Mesoderm Trunk Lateral Cell": (["a7.0006"], 6),
    "Mesoderm Trunk ventral Cell": (["b7.0005"], 7),
    "Mesoderm First Muscle": (["b7.0004", "b7.0008"], 8),
    "Mesoderm Second Muscle": (["a9.0031", "b9.0033"], 9),
    "Mesoderm Mesenchyme": (["b7.0007", "b8.0005"], 10),
    "Posterior ventral Neural Plate": (["a7.0004"], 11),
    "Anterior + Dorsal Neural Plate": (["a7.0009", "a7.0010", "b8.0019"], 12),
    "Lateral Neural Plate": (["a7.0013", "a8.0015", "a9.0032"], 13),
    "Trunk Epidermis": (["a7.0011", "a7.0012", "a7.0014", "a7.0015", "a7.0016"], 14),
    "Midline Tail Epidermis": (["b8.0020", "b8.0018", "b9.0041", "b8.0027", "b9.0056", "b9.0062", "b9.0064"], 15),
    "Mediolateral Tail Epidermis": (["b8.0024", "b9.0045", "b9.0042", "b9.0043", "b9.0049", "b9.0055", "b9.0061", "b9.0063"], 16),
    "Lateral Tail Epidermis": (["b9.0044", "b8.0026", "b9.0050", "b9.0046", "b8.0029", "b8.0030"], 17),
}


def pad_name(name: Column) -> Column:
    """a7.12* becomes a7.012*: the number is the last three digits of 00 and what it was."""
    parts = F.split(name, r"\.")
    return F.transform(F.array(F.regexp_replace(F.get(parts, F.lit(1)), ".$", "")), lambda n: F.concat(F.get(parts, F.lit(0)), F.lit("."), F.right(F.concat(F.lit("00"), n), F.lit(3)), F.right(name, F.lit(1))))[0]


def times_named(pattern: Column, first: str, t1: Column, second: str, t2: Column) -> Column:
    """A file name with two placeholders replaced by times of three digits."""
    digits = lambda t: F.right(F.concat(F.lit("00"), t.cast("string")), F.lit(3))
    return F.replace(F.replace(pattern, F.lit(first), digits(t1)), F.lit(second), digits(t2))


def daughter_name(mother: Column, j: Column) -> Column:
    """Name of the j-th daughter, j = 1 nearest the pole: generation + 1, number 2 n - 2 + j."""
    gen, num = F.regexp_extract(mother, r"^[a-z]([0-9]+)\.", 1).cast("int"), F.regexp_extract(mother, r"\.([0-9]+)", 1).cast("int")
    return F.concat(F.substring(mother, 1, 1), (gen + 1).cast("string"), F.lit("."), F.lpad((2 * num - 2 + j).cast("string"), 4, "0"), F.regexp_extract(mother, r"([*_]?)$", 1))


def propagate(edges: DataFrame, start: DataFrame, step, column: str, seed_only: bool = True) -> DataFrame:
    """Level by level down the tree: ``step(joined)`` gives a daughter's value from its mother's. start: (cell_id, value)."""
    from voxelith.operators.graph import cut

    done = cut(start.select("cell_id", column))
    front = done
    counted = cut(edges.withColumn("n", F.count("*").over(W.partitionBy("parent"))))
    while not front.isEmpty():
        front = cut(counted.join(front.withColumnRenamed("cell_id", "parent"), "parent").select(F.col("child").alias("cell_id"), step().alias(column)).join(done, "cell_id", "left_anti"))
        done = cut(done.unionByName(front))
    return done


def name_propagation(edges: DataFrame, start: DataFrame, order: DataFrame) -> DataFrame:
    """Names through time. start: (cell_id, name); order: (child, rank), rank 1 for the daughter nearest the pole."""
    ranked = edges.join(order, "child", "left").withColumn("rank", F.coalesce("rank", "ord"))
    return propagate(ranked, start, lambda: F.when(F.col("n") > 1, daughter_name(F.col("name"), F.col("rank"))).otherwise(F.col("name")), "name")


def fate_table(spark, fates: dict = FATES) -> DataFrame:
    return spark.createDataFrame([(n, f) for f, (names, _) in fates.items() for n in names], "short string, fate string")


def fate_map(edges: DataFrame, names: DataFrame, fates: dict = FATES) -> DataFrame:
    """Fate of each cell: its mother's, if she has one, else that of its own name. names: (cell_id, name) of all named cells."""
    short = F.replace(F.expr("left(name, greatest(length(name) - 1, 0))"), F.lit(" "), F.lit(""))
    own = names.withColumn("short", short).join(F.broadcast(fate_table(names.sparkSession, fates)), "short").select("cell_id", F.col("fate").alias("own"))
    every = edges.select(F.col("parent").alias("cell_id")).union(names.select("cell_id")).distinct()
    start = every.join(edges.select(F.col("child").alias("cell_id")), "cell_id", "left_anti").join(own, "cell_id", "left").withColumnRenamed("own", "fate")
    below = edges.join(own.withColumnRenamed("cell_id", "child"), "child", "left")
    return propagate(below, start, lambda: F.coalesce("fate", "own"), "fate").where("fate IS NOT NULL")


def tlp_rows(edges: DataFrame, cells: DataFrame) -> DataFrame:
    """Lines of a Tulip graph: nodes, edges, and the id property, in order."""
    node = cells.select(F.lit(1).alias("part"), "cell_id", F.lit(0).cast("long").alias("other"), F.format_string("(nodes %d)", F.col("cell_id")).alias("line"))
    edge = edges.select(F.lit(2).alias("part"), F.col("parent").alias("cell_id"), F.col("child").alias("other"), F.format_string("(edge %d %d)", F.col("parent"), F.col("child")).alias("line"))
    prop = cells.select(F.lit(3).alias("part"), "cell_id", F.lit(0).cast("long").alias("other"), F.format_string('(node %d "%d")', F.col("cell_id"), F.col("cell_id")).alias("line"))
    return node.unionByName(edge).unionByName(prop)
