"""Reading and writing the logical tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns that a token table must have, and may have.
REQUIRED = ("cell_id", "X", "X_connect_comp", "X_rna_type", "X_deviation_bin", "X_exp")
#: Fixed value: rows of a row group of a token table.
ROW_GROUP = 1024
OPTIONAL = ("slice", "region", "cell_label", "split", "density_token", "specie_token", "assay_token")


def read_csv_map(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header (symbols, homologs, markers); the schema is given, so nothing is inferred."""
    return spark.read.csv(path, header=True, schema=schema)


def read_gene_mean(means: DataFrame, assay: str, metacell: bool = False) -> DataFrame:
    """(gene_id, mean) of an assay; stereo and snrna share one table, of cells or of metacells (column
    `metacell`); other assays have one of cells alone; an unknown assay is an error."""
    known = {"merfish": "MERFISH", "xenium": "XENIUM", "starmap": "STARMAP", "slideseqv2": "SLIDESEQV2", "stereo": "STEREO", "snrna": "STEREO"}
    if assay.lower() not in known:
        raise ValueError(f"unknown assay {assay}")
    own = means.where(F.col("assay") == known[assay.lower()])
    if "metacell" in means.columns:
        own = own.where(F.col("metacell") == (metacell and known[assay.lower()] == "STEREO"))
    return own.select("gene_id", "mean")


def write_tokens(tokens: DataFrame, path: str, mode: str = "errorifexists", partition: str | None = None) -> None:
    """A token table, in row groups of at most 1,024 rows."""
    writer = tokens.write.mode(mode).option("parquet.block.row.count.limit", ROW_GROUP)
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def read_tokens(spark: SparkSession, *paths: str) -> DataFrame:
    """A token table, or several; a missing column is an error, optional ones come as they are there."""
    df = spark.read.parquet(*paths)
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise ValueError(f"the token table lacks {', '.join(missing)}")
    return df.select(*REQUIRED, *[c for c in OPTIONAL if c in df.columns])


def write_model_input(rows: DataFrame, path: str, batch: int, mode: str = "errorifexists") -> DataFrame:
    """Model input clustered by batch_id: ranges of batches in a file, sorted, in row groups of `batch` rows, so a
    batch of that size is a row group by itself. Returns the manifest, written beside as `_manifest` (which readers
    of the table pass over): batch_id, file, row_group, first_row and n of each batch."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows.repartitionByRange(n, "batch_id").sortWithinPartitions("batch_id", "cell_id").write.mode(mode).option("parquet.block.row.count.limit", batch).parquet(path)
    back = rows.sparkSession.read.schema(rows.select("batch_id").schema).parquet(path).select("batch_id", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    manifest = back.groupBy("batch_id", "file").agg(F.floor(F.min("row") / batch).cast("int").alias("row_group"), F.min("row").alias("first_row"), F.count(F.lit(1)).alias("n"))
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{path}/_manifest")
    return read_manifest(rows.sparkSession, path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/_manifest")


def read_batch(spark: SparkSession, path: str, batch_id: int) -> DataFrame:
    """One batch of a model input: its file alone is opened, and of that, by the statistics, its row groups."""
    files = [f"{path}/{r.file}" for r in read_manifest(spark, path).where(F.col("batch_id") == batch_id).select("file").collect()]
    if not files:
        raise ValueError(f"no batch {batch_id} in {path}")
    return spark.read.parquet(*files).where(F.col("batch_id") == batch_id)


def write_vec(vectors: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Vectors with an id and what is known of them; a table without id or embedding is an error."""
    missing = {"embedding"} - set(vectors.columns) or ({"vec_id", "cell_id"} if not {"vec_id", "cell_id"} & set(vectors.columns) else set())
    if missing:
        raise ValueError(f"vectors lack {', '.join(sorted(missing))}")
    vectors.write.mode(mode).parquet(path)


def read_many(spark: SparkSession, *paths: str) -> DataFrame:
    """Tables one after another, with the file each row came from."""
    return spark.read.parquet(*paths).withColumn("file", F.col("_metadata.file_name"))


def read_json_meta(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(batch_id, dataset_id, platform, batch_size) and (dataset_id, gene) of a JSON file
    {"batches": [...], "datasets": [{"id", "gene_list"}]}."""
    schema = "batches array<struct<batch_id:long,dataset_id:long,platform:string,batch_size:long>>, datasets array<struct<id:long,gene_list:array<string>>>"
    whole = spark.read.json(path, schema=schema, multiLine=True)
    batches = whole.select(F.explode("batches").alias("b")).select("b.*")
    genes = whole.select(F.explode("datasets").alias("d")).select(F.col("d.id").alias("dataset_id"), F.explode("d.gene_list").alias("gene"))
    return batches, genes


def write_report(report: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A table of one row for each label, as one CSV file."""
    report.coalesce(1).write.mode(mode).csv(path, header=True)
