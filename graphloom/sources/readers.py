"""Graph files: text formats as distributed scans, binary ones by their file's layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.sources import binary


class FormatError(ValueError):
    """A file that is not what its format asks for."""


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim(F.regexp_replace("value", r"\s+", " ")).alias("line"))


def _numbered(spark: SparkSession, path: str, keep: Column | None = None) -> DataFrame:
    """``n, line``: the lines (those that ``keep``) with their number among them, for formats in which it matters.

    Lines are counted by block of a file, the blocks' counts are summed up in order, and a line's number is its
    block's sum and its place there.  Rows stay in the JVM and are not shuffled but for the table of blocks.
    """
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    rows = rows.withColumn("line", F.trim(F.regexp_replace("value", r"\s+", " ")))
    if keep is not None:
        rows = rows.where(keep)
    # a block is read by one task from its first line to its last, so places follow on each other
    rows = rows.select("file", "block", "line", F.monotonically_increasing_id().alias("place"))
    blocks = rows.groupBy("file", "block").agg(F.count(F.lit(1)).alias("lines"), F.min("place").alias("first"))
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    base = blocks.select(F.col("file").alias("_f"), F.col("block").alias("_b"), "first", F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("base"))
    met = rows.join(base, (F.col("file") == F.col("_f")) & (F.col("block") == F.col("_b")))
    return met.select((F.col("base") + F.col("place") - F.col("first")).alias("n"), "line")


def _whole(column: Column) -> Column:
    """A weight as a whole number; fractions are cut towards zero."""
    return F.when(column.cast("double") < 0, F.ceil(column.cast("double"))).otherwise(F.floor(column.cast("double"))).cast("long")


def _edge_rows(lines: DataFrame, first: int, weighted: bool) -> DataFrame:
    parts = F.split("line", " ")
    weight = _whole(F.get(parts, F.lit(first + 2))) if weighted else F.lit(1).cast("long")
    return lines.select(F.get(parts, F.lit(first)).cast("long").alias("src"), F.get(parts, F.lit(first + 1)).cast("long").alias("dst"), weight.alias("weight"))


def read_edge_list(spark: SparkSession, path: str, weighted: bool = False) -> DataFrame:
    """``u v [w]`` a line; further columns are ignored."""
    return _edge_rows(_lines(spark, path).where("line <> ''"), 0, weighted)


def read_dimacs(spark: SparkSession, path: str, one_based: bool = False) -> DataFrame:
    """Lines ``a u v w``; ids are taken as they are unless ``one_based``."""
    rows = _edge_rows(_lines(spark, path).where(F.col("line").startswith("a ")), 1, True)
    return rows.select((F.col("src") - int(one_based)).alias("src"), (F.col("dst") - int(one_based)).alias("dst"), "weight")


def read_metis(spark: SparkSession, path: str) -> DataFrame:
    """A line of neighbours for each vertex, counted from 1; format 1 has a weight after each neighbour."""
    # lines that are no comments: the header, then one for each vertex
    lines = _numbered(spark, path, ~F.ltrim(F.col("value")).startswith("%"))
    first = lines.where("n = 0").head()
    if first is None:
        raise FormatError("no header line")
    header = first["line"].split()
    kind = int(header[2]) if len(header) > 2 else 0
    if kind not in (0, 1, 100):
        raise FormatError(f"unknown METIS format {kind}")
    step = 2 if kind == 1 else 1
    body = lines.where("n > 0 and line <> ''").select((F.col("n") - 1).alias("src"), F.split("line", " ").alias("parts"))
    spread = body.select("src", F.posexplode("parts").alias("i", "value"), "parts").where(F.col("i") % step == 0)
    weight = _whole(F.get("parts", F.col("i") + 1)) if step == 2 else F.lit(1).cast("long")
    return spread.select("src", (F.col("value").cast("long") - 1).alias("dst"), weight.alias("weight"))


def read_matrix_market(spark: SparkSession, path: str) -> DataFrame:
    """Square coordinate matrices of real, integer or pattern entries, counted from 1; symmetric ones are mirrored."""
    banner = _numbered(spark, path, F.trim("value") != "").where("n = 0").head()
    words = banner["line"].lower().split() if banner else []
    if len(words) != 5 or words[:2] != ["%%matrixmarket", "matrix"]:
        raise FormatError("no Matrix Market banner")
    layout, kind, symmetry = words[2:]
    if layout != "coordinate" or kind not in ("pattern", "real", "double", "integer") or symmetry not in ("general", "symmetric", "skew-symmetric"):
        raise FormatError(f"unsupported matrix: {' '.join(words[2:])}")
    entries = _numbered(spark, path, (F.trim("value") != "") & ~F.ltrim(F.col("value")).startswith("%"))
    size = entries.where("n = 0").head()["line"].split()
    if size[0] != size[1]:
        raise FormatError("the matrix is not square")
    rows = _edge_rows(entries.where("n > 0"), 0, kind != "pattern")
    rows = rows.select((F.col("src") - 1).alias("src"), (F.col("dst") - 1).alias("dst"), "weight")
    if symmetry == "symmetric":
        rows = rows.unionByName(rows.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    return rows


def read_adjacency(spark: SparkSession, path: str) -> DataFrame:
    """One number a line: a header word, n, m, n offsets, m targets and, with ``Weighted``, m weights."""
    lines = _numbered(spark, path, F.trim("value") != "")
    head = [r["line"] for r in lines.where("n < 3").orderBy("n").collect()]
    if len(head) < 3 or head[0] not in ("AdjacencyGraph", "WeightedAdjacencyGraph"):
        raise FormatError("no adjacency header")
    n, m = int(head[1]), int(head[2])
    # the cast is guarded too, for it may be evaluated before the filter
    values = lines.where("n >= 3").select((F.col("n") - 3).alias("i"), F.when(F.col("n") >= 3, F.col("line").cast("long")).alias("v"))
    offsets = values.where(F.col("i") < n).select(F.col("i").alias("src"), F.col("v").alias("begin"))
    ends = offsets.select((F.col("src") - 1).alias("src"), F.col("begin").alias("end"))
    ranges = offsets.join(ends, "src", "left").select("src", "begin", F.coalesce("end", F.lit(m)).alias("end")).where("end > begin")
    arcs = ranges.select("src", F.explode(F.sequence("begin", F.col("end") - 1)).alias("at"))
    targets = values.where((F.col("i") >= n) & (F.col("i") < n + m)).select((F.col("i") - n).alias("at"), F.col("v").alias("dst"))
    rows = arcs.join(targets, "at")
    if head[0].startswith("Weighted"):
        weights = values.where(F.col("i") >= n + m).select((F.col("i") - n - m).alias("at"), F.col("v").alias("weight"))
        return rows.join(weights, "at").select("src", "dst", "weight")
    return rows.select("src", "dst", F.lit(1).cast("long").alias("weight"))


def largest_node(edges: DataFrame) -> DataFrame:
    """``max_src, max_dst`` of an edge table."""
    return edges.agg(F.max("src").alias("max_src"), F.max("dst").alias("max_dst"))


def suffix(path: str) -> str:
    name = path.rstrip("/").rpartition("/")[2]
    if "." not in name:
        raise FormatError(f"{path} has no suffix that tells its format")
    return name.rpartition(".")[2]


def about(spark: SparkSession, path: str) -> int:
    """About how many arcs a text or geo file, or folder of files, holds, by its length."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return sum(fs.getContentSummary(found.getPath()).getLength() for found in fs.globStatus(target) or ()) // 10


def read_graph(spark: SparkSession, path: str, format: str | None = None, mirror: bool = False, **options) -> Graph:
    """Dispatch by ``format`` or suffix: el, wel, gr, graph, mtx, adj, config (binary adjacency), bin (geo), sg, wsg, parquet.

    A ``.config`` file has its targets and offsets beside it, in ``.adj`` and ``.idx`` files of the same name.
    """
    kind = format or suffix(path)
    if kind == "config":
        stem = path.removesuffix(".config")
        arcs = binary.file_size(f"{stem}.adj") // binary.adjacency_cell(options.get("weighted", False)).itemsize
        return Graph.from_tables(binary.read_binary_adjacency(spark, path, f"{stem}.adj", f"{stem}.idx", **options), weight="weight", mirror=mirror, rows=arcs)
    if kind in ("sg", "wsg"):
        return binary.read_serialized(spark, path, kind == "wsg")
    if kind == "parquet":
        df = spark.read.parquet(path)
        return Graph.from_tables(df, weight="weight" if "weight" in df.columns else None, mirror=mirror, rows=df.count())
    readers = {
        "el": lambda: read_edge_list(spark, path), "wel": lambda: read_edge_list(spark, path, True), "gr": lambda: read_dimacs(spark, path, **options), "graph": lambda: read_metis(spark, path),
        "mtx": lambda: read_matrix_market(spark, path), "adj": lambda: read_adjacency(spark, path), "bin": lambda: binary.read_geo(spark, path)[0],
    }
    if kind not in readers:
        raise FormatError(f"unknown format {kind}")
    return Graph.from_tables(readers[kind](), weight="weight", mirror=mirror, rows=about(spark, path))
