"""Kernels over run logs and synthetic graphs: what a run printed as rows, speed-ups against a baseline, growth of cliques, fill of lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What a log calls its phases, and what the analysis does.
PHASES = {"chunked list building": "chunked list building", "trie building": "GHT building", "trie intersection": "GHT intersection"}


def log_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """(file, pos, line) of text files, numbered within each file."""
    whole = spark.read.text(list(paths), wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return whole.select("file", F.posexplode(F.split("value", "\r?\n")).alias("pos", "line"))


def _with_run(lines: DataFrame) -> DataFrame:
    """Every line with the ``Query: name`` and ``Using: n threads`` above it, and the number of such queries so far."""
    line = F.trim("line")
    own = Window.partitionBy("file").orderBy("pos")
    is_query = line.startswith("Query")
    named = F.when(is_query, F.regexp_extract(line, r"^Query.*: ?([^:]*)$", 1))
    threads = F.when(line.startswith("Using:"), F.regexp_extract(line, r"^Using: *(\d+)", 1).cast("int"))
    return lines.select(
        "file", "pos", line.alias("line"), F.last(named, True).over(own).alias("query"), F.last(threads, True).over(own).alias("threads"),
        F.sum(is_query.cast("int")).over(own).alias("run"), F.lead(line, 1).over(own).alias("next"), F.lead(line, 2).over(own).alias("after"),
    )


def _behind_colon(line: str) -> Column:
    return F.regexp_extract(F.col(line), r":\s*(.*?)\s*$", 1)


def plan_statistics(lines: DataFrame) -> DataFrame:
    """(query, threads, n_nodes, atoms, attributes): the last plan block of each query in a log."""
    numbers = lambda c: F.transform(F.split(_behind_colon(c), r"\s+"), lambda x: x.cast("int"))
    blocks = _with_run(lines).filter(F.col("line").startswith("Num Nodes"))
    last = blocks.groupBy("file", "run").agg(F.max_by(F.struct("query", "threads", "line", "next", "after"), "pos").alias("b")).select("b.*")
    return last.select("query", "threads", _behind_colon("line").cast("int").alias("n_nodes"), numbers("next").alias("atoms"), numbers("after").alias("attributes"))


def trie_heights(lines: DataFrame) -> DataFrame:
    """(query, threads, n_tuples, height) of every trie that a log tells of."""
    pairs = _with_run(lines).filter(F.col("line").startswith("Num Tuples") & F.col("next").startswith("Trie Height"))
    return pairs.select("query", "threads", _behind_colon("line").cast("long").alias("n_tuples"), _behind_colon("next").cast("int").alias("height"))


def phase_times(lines: DataFrame) -> DataFrame:
    """(query, threads, operation, ms): seconds of the known phases, added up."""
    named = F.create_map(*[F.lit(x) for pair in PHASES.items() for x in pair])
    rows = _with_run(lines).select("query", "threads", named[F.split("line", ",")[0]].alias("operation"), (F.split("line", ",")[1].try_cast("double") * 1000).alias("ms"))
    return rows.filter("operation IS NOT NULL").groupBy("query", "threads", "operation").agg(F.sum("ms").alias("ms"))


def speedups(times: DataFrame, baseline: int = 1) -> DataFrame:
    """(query, threads, operation, ms, speedup), ``total`` over all phases included; ``baseline`` threads of the same query and operation over the time per thread."""
    wide = times.groupBy("query", "threads").pivot("operation", list(PHASES.values())).agg(F.sum("ms"))
    total = sum((F.col(f"`{p}`") for p in PHASES.values()), F.lit(0.0))
    names = [*PHASES.values(), "total"]
    long = wide.withColumn("total", total).unpivot(["query", "threads"], [F.col(f"`{n}`") for n in names], "operation", "ms").filter("ms IS NOT NULL")
    base = long.filter(F.col("threads") == baseline).groupBy("query", "operation").agg(F.min("ms").alias("base"))
    return long.join(base, ["query", "operation"], "left").select("query", "threads", "operation", "ms", (F.col("base") / (F.col("ms") / F.col("threads"))).alias("speedup"))


def compared(first: DataFrame, second: DataFrame, names: tuple[str, str] = ("default", "smart")) -> DataFrame:
    """Two runs' times side by side: (query, operation, ms_<first>, ms_<second>)."""
    one, two = (df.select("query", "operation", F.col("ms").alias(f"ms_{n}")) for df, n in zip((first, second), names, strict=True))
    return one.join(two, ["query", "operation"])


def clique_growth(spark: SparkSession, least: int = 3, most: int = 99) -> DataFrame:
    """(n, n_edges, squared, n_paths): directed edges of the n-clique, the pairs that a binary join may make of them, and its walks of two edges."""
    sizes = spark.range(least, most + 1).select(F.col("id").alias("n"))
    ends = sizes.select("n", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("src")).select("n", "src", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("dst"))
    edges = ends.filter("src != dst")
    come, go = edges.groupBy("n", F.col("dst").alias("v")).agg(F.count("*").alias("a")), edges.groupBy("n", F.col("src").alias("v")).agg(F.count("*").alias("b"))
    walks = come.join(go, ["n", "v"]).groupBy("n").agg(F.sum("a").alias("n_edges"), F.sum(F.col("a") * F.col("b")).alias("n_paths"))
    return walks.select("n", "n_edges", (F.col("n_edges") * F.col("n_edges")).alias("squared"), "n_paths")


def list_fill(spark: SparkSession, sizes: tuple[int, ...] = (1_000_000, 5_000_000, 10_000_000), most_bits: int = 7) -> DataFrame:
    """(size, n_lists, mean_entries): mean length of the lists when ``size`` entries are dealt to powers of two of them."""
    rows = spark.createDataFrame([(n,) for n in sizes], "size long")
    rows = rows.select("size", F.explode(F.sequence(F.lit(0), F.lit(most_bits))).alias("p")).select("size", F.pow(F.lit(2), F.col("p")).cast("long").alias("n_lists"))
    return rows.select("size", "n_lists", (F.col("size") / F.col("n_lists")).alias("mean_entries"))
