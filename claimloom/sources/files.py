"""Sources and sinks of the graph's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.relational import latest

CLAIM = T.StructType([T.StructField("claim_id", T.LongType()), T.StructField("content", T.StringType()), T.StructField("truth_value", T.DoubleType()), T.StructField("review_status", T.StringType()), T.StructField("properties", T.StringType())])


def read_staged(spark: SparkSession, path: str, schema: T.StructType = CLAIM, status: str = "approved") -> DataFrame:
    """Staged JSON records of a review status; what does not parse is left out."""
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])).option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.where(F.col("_bad").isNull() & (F.col("review_status") == status)).drop("_bad")


def structure(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, level, ordinal, begin, end, content): sections (at markdown headings) and paragraphs with their spans.

    Spans are characters of the text, so content is always what the text says there.
    """
    lines = F.split(F.col(text_col), "\n", -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin:int,line:string>>").alias("rows"))
    placed = F.aggregate(lines, start, lambda a, x: F.struct((a["at"] + F.length(x) + 1).alias("at"), F.concat(a["rows"], F.array(F.struct(a["at"].alias("begin"), x.alias("line")))).alias("rows")))
    rows = docs.where(F.col(text_col).isNotNull()).select(id_col, F.posexplode(placed["rows"]).alias("ordinal", "r"))
    level = F.when(F.col("r.line").rlike("^#{1,6} "), "section").otherwise("paragraph")
    out = rows.select(id_col, level.alias("level"), "ordinal", F.col("r.begin").alias("begin"), (F.col("r.begin") + F.length("r.line")).alias("end"), F.col("r.line").alias("content"))
    return out.where("content <> ''")


def valid(df: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that pass every check, and the others with the names of what they fail."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in checks.items()]))
    marked = df.withColumn("_failed", failed)
    return marked.where(F.size("_failed") == 0).drop("_failed"), marked.where(F.size("_failed") > 0).withColumnRenamed("_failed", "failed")


def append(df: DataFrame, path: str, *, partition_by: tuple[str, ...] = ()) -> None:
    """Append a batch as Parquet; Spark's committer makes it visible whole or not at all."""
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def upsert(table: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """The table after a batch: a key's batch row replaces its row."""
    both = table.withColumn("_v", F.lit(0)).unionByName(batch.withColumn("_v", F.lit(1)), allowMissingColumns=True)
    return latest(both, keys, [F.desc("_v")]).drop("_v")


def prov_records(claims: DataFrame, edges: DataFrame, masses: DataFrame) -> DataFrame:
    """(kind, id, record): provenance as PROV-O JSON-LD nodes, one a row: claims as entities with what
    they derive from, agents with what is attributed to them, and each attribution."""
    origin = edges.groupBy(F.col("source_id").alias("claim_id")).agg(F.array_sort(F.collect_set("target_id")).alias("from"))
    ref = lambda kind, c: F.concat(F.lit(f"urn:{kind}:"), c.cast("string"))
    entity = claims.join(origin, "claim_id", "left").select(
        F.lit("entity").alias("kind"), F.col("claim_id").alias("id"),
        F.to_json(F.struct(ref("claim", F.col("claim_id")).alias("@id"), F.lit("prov:Entity").alias("@type"), F.col("content").alias("prov:value"), F.transform("from", lambda x: ref("claim", x)).alias("prov:wasDerivedFrom"))).alias("record"),
    )
    agent = masses.select("agent_id").distinct().select(F.lit("agent").alias("kind"), F.col("agent_id").alias("id"), F.to_json(F.struct(ref("agent", F.col("agent_id")).alias("@id"), F.lit("prov:Agent").alias("@type"))).alias("record"))
    given = masses.select("claim_id", "agent_id").distinct().select(
        F.lit("attribution").alias("kind"), F.col("claim_id").alias("id"),
        F.to_json(F.struct(F.lit("prov:Attribution").alias("@type"), ref("claim", F.col("claim_id")).alias("prov:entity"), ref("agent", F.col("agent_id")).alias("prov:agent"))).alias("record"),
    )
    return entity.unionByName(agent).unionByName(given)
