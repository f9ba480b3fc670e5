"""The catalog of analyses as tables: what each reads and makes, orders, lineage, drift, freshness and tiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.sources.checkpoints import cut

# fixed values: analysis, what it reads, what it makes
ANALYSES = (
    ("detect", (), ("detections",)),
    ("stitch", ("detections",), ("subjects",)),
    ("attribute", ("detections", "subjects"), ("roles",)),
    ("phase", ("detections",), ("phases",)),
    ("tubelets", ("detections", "subjects", "roles", "phases"), ("tubelets",)),
    ("features", ("tubelets",), ("features",)),
    ("landmarks", ("tubelets",), ("landmarks",)),
    ("parse", ("tubelets", "landmarks"), ("parse",)),
    ("headpose", ("tubelets",), ("headpose",)),
    ("emotion", ("features",), ("emotion_frame",)),
    ("scene", (), ("scene",)),
    ("gates", ("tubelets", "features", "landmarks", "parse", "headpose"), ("gate_trace",)),
    ("likeness", ("tubelets", "features", "landmarks", "gate_trace"), ("likeness",)),
    ("recipe", ("likeness",), ("recipe",)),
    ("portrait", ("gate_trace", "emotion_frame"), ("portrait",)),
    ("highlight", ("tubelets", "features", "scene", "gate_trace"), ("highlight",)),
)
# fixed values: where an artifact belongs
TIERS = {"likeness": "product", "recipe": "product", "portrait": "product", "highlight": "product", "gate_trace": "substrate", "tubelets": "substrate", "features": "substrate", "landmarks": "substrate", "detections": "substrate", "provenance": "ops", "run": "ops", "cards": "surface"}


def catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, list(r), list(m)) for n, r, m in ANALYSES], "analysis string, reads array<string>, makes array<string>")


def edges(analyses: DataFrame) -> DataFrame:
    """upstream, analysis, artifact: who reads what from whom."""
    made = analyses.select(F.col("analysis").alias("upstream"), F.explode("makes").alias("artifact"))
    return analyses.select("analysis", F.explode("reads").alias("artifact")).join(made, "artifact").select("upstream", "analysis", "artifact")


def unresolved_reads(analyses: DataFrame) -> DataFrame:
    made = analyses.select(F.explode("makes").alias("artifact"))
    return analyses.select("analysis", F.explode("reads").alias("artifact")).join(made, "artifact", "left_anti")


def levels(analyses: DataFrame) -> DataFrame:
    """analysis, level: 0 for those that read nothing made here, else one more than the greatest level read from. A cycle raises."""
    links = cut(edges(analyses).select("upstream", "analysis").distinct())
    out = analyses.select("analysis", F.lit(0).alias("level"))
    for _ in range(analyses.count() + 1):
        above = links.join(out.withColumnRenamed("analysis", "upstream"), "upstream").groupBy("analysis").agg((F.max("level") + 1).alias("next"))
        after = cut(out.join(above, "analysis", "left").select("analysis", F.coalesce("next", F.lit(0)).alias("level"), (F.coalesce("next", F.lit(0)) != F.col("level")).alias("moved")))
        out = after.drop("moved")
        if after.where("moved").isEmpty():
            return out
    raise ValueError("the analyses form a cycle")


def closure(spark: SparkSession, analyses: DataFrame, wanted: list[str]) -> DataFrame:
    """analysis, role: all that the wanted artifacts need; input, intermediate or final."""
    made = analyses.select("analysis", F.explode("makes").alias("artifact")).where(F.col("artifact").isin(wanted))
    need = "WITH RECURSIVE need(analysis) AS (SELECT analysis FROM {made} UNION ALL SELECT e.upstream FROM need n JOIN {links} e ON e.analysis = n.analysis) SELECT DISTINCT analysis FROM need"
    found = spark.sql(need, made=made, links=edges(analyses))
    final = made.select("analysis", F.lit(True).alias("final")).distinct()
    reads = analyses.select("analysis", (F.size("reads") == 0).alias("source"))
    out = found.join(final, "analysis", "left").join(reads, "analysis")
    return out.select("analysis", F.when(F.col("final"), "final").when(F.col("source"), "input").otherwise("intermediate").alias("role"))


def drift(declared: DataFrame, present: DataFrame, name: str) -> DataFrame:
    """name, problem: declared but absent, or present but undeclared."""
    both = declared.select(name).distinct().withColumn("__d", F.lit(True)).join(present.select(name).distinct().withColumn("__p", F.lit(True)), name, "full")
    return both.where("__d is null or __p is null").select(name, F.when(F.col("__d").isNull(), "undeclared").otherwise("absent").alias("problem"))


def stale(artifacts: DataFrame, links: DataFrame) -> DataFrame:
    """artifact, stale: absent (no time), older than the code, or older than something it is made from. artifacts: artifact, made_at, code_at."""
    upstream = links.join(artifacts.select(F.col("artifact").alias("upstream"), F.col("made_at").alias("__up")), "upstream").groupBy("artifact").agg(F.max("__up").alias("__up"))
    out = artifacts.join(upstream, "artifact", "left")
    old = F.col("made_at").isNull() | (F.col("made_at") < F.col("code_at")) | (F.col("made_at") < F.col("__up"))
    return out.select("artifact", F.coalesce(old, F.lit(False)).alias("stale"))


def tiered(artifacts: DataFrame, name: str) -> DataFrame:
    known = F.create_map(*[F.lit(x) for pair in TIERS.items() for x in pair])
    return artifacts.withColumn("tier", F.coalesce(known[F.regexp_replace(name, r"\.[a-z0-9.]+$", "")], F.lit("unclassified")))


def intact(flags: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """keys, ok: no flag is false; those not expected (NULL) do not count."""
    return flags.groupBy(*keys).agg(F.every(F.coalesce(flag, F.lit(True))).alias("ok"))


def outcomes(runs: DataFrame, keys: list[str], stage: str, state: str, order: str) -> DataFrame:
    """keys, state, n, stages: stages by outcome, in the order they ran."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(order, stage))), lambda x: x[stage])
    return runs.groupBy(*keys, state).agg(F.count("*").alias("n"), listed.alias("stages"))


def numbered(analyses: DataFrame) -> DataFrame:
    """A running order: by level, then by name.

    Rows are sorted over tasks by ranges; each then stands at its number within its task and after the rows of all tasks before, of which one count each is looked at together.
    """
    at = F.monotonically_increasing_id()  # the task's number above 33 bits of the row's
    ranged = levels(analyses).repartitionByRange("level", "analysis").sortWithinPartitions("level", "analysis")
    ranged = cut(ranged.withColumns({"__task": F.shiftright(at, 33), "__row": at.bitwiseAND(F.lit((1 << 33) - 1))}))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = ranged.groupBy("__task").agg(F.count("*").alias("__n")).select("__task", before.alias("__before"))
    return ranged.join(counts, "__task").select("analysis", "level", (F.col("__before") + F.col("__row") + 1).cast("int").alias("place"))
