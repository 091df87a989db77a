"""The tables that the registered queries work on, built from the given ones, and the same as SQL."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

NOW = "2024-04-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names, deleted when the driver's JVM ends. A folder of the machine's
    own, only for a local master, where none is named."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="docloom-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        return f"file://{own}/{name}"
    path = f"{root.rstrip('/')}/docloom-{name}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    d = table(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    kind = F.element_at(F.array(*map(F.lit, ("txt", "md", "docx", "pdf"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return d.select(
        "doc_id", "text", F.col("lang").alias("category"), F.array("source").alias("tags"), kind.alias("file_type"),
        F.when(F.col("toxic") == 1, "sensitive").when(F.col("quality") == 0, "public").otherwise("internal").alias("sensitivity"),
        F.expr("timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, cast(doc_id % 90 as int))").alias("modified_at"),
        F.concat(F.lit("/corpus/"), "source").alias("directory"), F.col("source").alias("relative_directory"),
        F.concat(F.lit("/corpus/"), "source", F.lit("/"), "doc_id", F.lit("."), kind).alias("path"),
        F.concat(F.lit("corpus/"), "source", F.lit("/"), "doc_id", F.lit("."), kind).alias("display_path"),
        F.lit("/corpus").alias("source_root"), (F.col("doc_id") % 50 == 49).alias("is_deleted"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chunk for each line that isn't blank; offsets are in code points. A line's start is a running sum over its own
    document's lines, so the work is in proportion to the text."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("chunk_index", "text"))
    before = W.partitionBy("doc_id").orderBy("chunk_index").rowsBetween(W.unboundedPreceding, -1)
    rows = d.withColumn("char_start", F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)).cast("int"))
    return rows.where(F.trim("text") != "").select("doc_id", "chunk_index", "text", "char_start", (F.col("char_start") + F.length("text")).alias("char_end"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")


def chunk_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, chunk_index, embedding): vectors 2d and 2d + 1 are those of document d's first two chunks, as far as it has them."""
    c = chunks(spark, sf_dir).select("doc_id", "chunk_index")
    c = c.withColumn("k", F.row_number().over(W.partitionBy("doc_id").orderBy("chunk_index")) - 1).where("k < 2")
    return table(spark, sf_dir, "embeddings").join(c, F.col("vec_id") == F.col("doc_id") * 2 + F.col("k")).select("doc_id", "chunk_index", "embedding")


def probe(spark: SparkSession, sf_dir: str, vec_id: int) -> list[float]:
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).first().embedding


SQL_DOCS = """docs as (
  select d.doc_id, d.text, d.lang as category, [d.source] as tags, ['txt', 'md', 'docx', 'pdf'][(d.doc_id % 4 + 1)::int] as file_type,
         case when l.toxic = 1 then 'sensitive' when l.quality = 0 then 'public' else 'internal' end as sensitivity,
         timestamp '2024-01-01' + to_days((d.doc_id % 90)::int) as modified_at, '/corpus/' || d.source as directory, d.source as relative_directory,
         '/corpus/' || d.source || '/' || d.doc_id || '.' || ['txt', 'md', 'docx', 'pdf'][(d.doc_id % 4 + 1)::int] as path,
         'corpus/' || d.source || '/' || d.doc_id || '.' || ['txt', 'md', 'docx', 'pdf'][(d.doc_id % 4 + 1)::int] as display_path,
         '/corpus' as source_root, d.doc_id % 50 = 49 as is_deleted
  from documents d left join labels l on d.doc_id = l.doc_id)"""
SQL_CHUNKS = """raw_lines as (
  select doc_id, unnest(range(len(string_split(text, chr(10)))))::int as chunk_index, unnest(string_split(text, chr(10))) as text from documents),
placed as (
  select *, coalesce(sum(length(text) + 1) over (partition by doc_id order by chunk_index rows between unbounded preceding and 1 preceding), 0)::int as char_start from raw_lines),
chunks as (select doc_id, chunk_index, text, char_start, char_start + length(text)::int as char_end from placed where trim(text, ' ') <> '')"""
SQL_CHUNK_VECTORS = """chunk_vectors as (
  select c.doc_id, c.chunk_index, e.embedding
  from embeddings e join (select doc_id, chunk_index, row_number() over (partition by doc_id order by chunk_index) - 1 as k from chunks) c on e.vec_id = c.doc_id * 2 + c.k and c.k < 2)"""
