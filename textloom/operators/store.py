"""A vector store as Parquet, partitioned by user and model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from textloom.operators.code import repository
from textloom.session import checkpointed

KEYS = ("user_id", "model_id")


def keyed(chunks: DataFrame) -> DataFrame:
    """Rows with the store's keys filled in: a null or empty user or model is ``default``."""
    return chunks.withColumns({k: F.coalesce(F.nullif(F.col(k).cast("string"), F.lit("")), F.lit("default")) for k in KEYS})


def add(chunks: DataFrame, path: str) -> None:
    """Append the chunks that have a vector; rows of one key are brought together so a partition gets few files."""
    rows = keyed(chunks.where(F.col("vector").isNotNull()))
    # the salt splits a key that holds a large share of all rows over eight tasks
    rows.repartition(*[F.col(k) for k in KEYS], F.pmod(F.xxhash64("chunk_id"), F.lit(8))).write.mode("append").partitionBy(*KEYS).parquet(path)


def read(spark: SparkSession, path: str, user_id: str | None = None, model_id: str | None = None) -> DataFrame:
    """The store, or one user's or model's partitions of it; keys are text also where they look like numbers or dates."""
    found = spark.read.parquet(path).schema
    fields = [T.StructField(f.name, T.StringType() if f.name in KEYS else f.dataType) for f in found]
    rows = spark.read.schema(T.StructType(fields)).parquet(path)
    for key, value in zip(KEYS, (user_id, model_id)):
        if value is not None:
            rows = rows.where(F.col(key) == value)
    return rows


def delete_documents(spark: SparkSession, path: str, documents: DataFrame) -> int:
    """Delete the chunks of the documents (user_id, model_id, document_id); only partitions that hold some are rewritten.

    Gives the number of chunks deleted, 0 if none matched.
    """
    keys = [*KEYS, "document_id"]
    doomed = keyed(documents).select(*keys).distinct()
    stored = read(spark, path)
    # the folder of a key is where its files lie, as its name there may be escaped
    folder = F.regexp_replace("_metadata.file_path", "/[^/]*$", "")
    touched = checkpointed(spark, stored.select(*keys, folder.alias("folder")).join(doomed, keys, "left_semi").select(*KEYS, "folder").distinct())
    if not touched.limit(1).count():
        return 0
    before = checkpointed(spark, stored.join(touched, list(KEYS), "left_semi"))
    kept = before.join(doomed, keys, "left_anti")
    emptied = touched.join(kept.select(*KEYS).distinct(), list(KEYS), "left_anti")
    deleted = before.count() - kept.count()
    kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*KEYS).parquet(path)
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for row in emptied.toLocalIterator():  # partitions, one name at a time
        fs.delete(fs_path(spark._jvm.java.net.URI(row.folder)), True)
    return deleted


def drop_store(spark: SparkSession, path: str, confirm: bool = False) -> None:
    """Delete the whole store; needs ``confirm``."""
    if not confirm:
        raise ValueError("pass confirm=True to delete the store")
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration()).delete(fs_path(path), True)


def stats(store: DataFrame) -> DataFrame:
    """Chunks and documents of each key."""
    return store.groupBy(*KEYS).agg(F.count("*").alias("chunks"), F.countDistinct("document_id").alias("documents"))


def export_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def knowledge_records(rows: DataFrame) -> DataFrame:
    """(name, markdown): one Markdown record for each row of title, content, url and date."""
    slug = F.substring(F.regexp_replace(F.regexp_replace(F.lower("title"), r"[^\p{L}\p{N}]+", "-"), r"^-+|-+$", ""), 1, 60)
    body = F.concat_ws("\n\n", F.concat(F.lit("# "), "title"), F.col("content"), F.concat(F.lit("Source: "), "url"), F.concat(F.lit("Date: "), F.date_format("date", "yyyy-MM-dd")))
    return rows.select(slug.alias("name"), body.alias("markdown"))


def element_records(elements: DataFrame, files: DataFrame) -> DataFrame:
    """(element_id, name, markdown, code_md5): one Markdown record for each element, with figures of its file; names hold no signs but _ and -."""
    known = files.select("file_path", F.col("line_count").alias("file_lines"), F.size(F.coalesce("imports", F.array().cast("array<string>"))).alias("file_imports"))
    rows = elements.join(known, "file_path", "left")
    documented = F.coalesce(F.trim("docstring"), F.lit("")) != ""
    body = F.concat_ws(
        "\n", F.concat(F.lit("# "), "type", F.lit(" `"), "name", F.lit("`")), F.concat(F.lit("File: "), "file_path", F.lit(" ("), F.coalesce("language", F.lit("unknown")), F.lit(")")),
        F.concat(F.lit("Lines: "), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string")), F.concat(F.lit("Complexity: "), F.col("complexity").cast("string")),
        F.when(documented, F.concat(F.lit("\n"), "docstring", F.lit("\n"))).otherwise("No documentation."), F.when(F.size("parameters") > 0, F.concat(F.lit("Parameters: "), F.array_join("parameters", ", "))),
        F.concat(F.lit("Returns: "), "return_type"), F.concat(F.lit("```\n"), "content", F.lit("\n```")),
        F.concat(F.lit("Its file has "), F.col("file_lines").cast("string"), F.lit(" lines and "), F.col("file_imports").cast("string"), F.lit(" imports.")),
    )
    name = F.regexp_replace(F.concat_ws("_", F.regexp_replace("file_path", "/", "_"), F.regexp_replace(F.lower("name"), "[^a-z0-9_-]", "_"), F.lower("type")), "_+", "_")
    return rows.select("element_id", name.alias("name"), body.alias("markdown"), F.md5("content").alias("code_md5"))


def repository_records(files: DataFrame, packages: int = 10) -> DataFrame:
    """(repo, markdown): totals, the three languages with most files and two key files of each, and the first packages by name."""
    named = files.withColumn("repo", repository(F.col("file_path")))
    totals = named.groupBy("repo").agg(F.count("*").alias("files"), F.sum("line_count").alias("lines"), F.avg((F.col("documentation").isNotNull()).cast("int")).alias("documented"))
    counted = named.where("language is not null").groupBy("repo", "language").agg(F.count("*").alias("n"))
    top = counted.withColumn("place", F.row_number().over(Window.partitionBy("repo").orderBy(F.col("n").desc(), "language"))).where("place <= 3")
    keys = named.select("repo", "language", "file_path", "line_count", F.coalesce("complexity_score", F.lit(0.0)).alias("hard"))
    best = Window.partitionBy("repo", "language").orderBy(F.col("hard").desc(), F.col("line_count").desc_nulls_last(), "file_path")
    keys = keys.withColumn("nth", F.row_number().over(best)).where("nth <= 2").groupBy("repo", "language").agg(F.array_sort(F.collect_list(F.struct("nth", "file_path"))).alias("keys"))
    line = F.concat(F.lit("## "), "language", F.lit(" ("), F.col("n").cast("string"), F.lit(" files)\n"), F.array_join(F.transform("keys", lambda k: F.concat(F.lit("- "), k["file_path"])), "\n"))
    spoken = top.join(keys, ["repo", "language"]).groupBy("repo").agg(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("languages"))
    used = named.select("repo", F.explode("imports").alias("package")).where("package is not null").distinct()
    first = used.withColumn("nth", F.row_number().over(Window.partitionBy("repo").orderBy("package"))).where(F.col("nth") <= packages)
    used = first.groupBy("repo").agg(F.array_join(F.array_sort(F.collect_list("package")), ", ").alias("packages"))
    figures = F.concat(F.lit("Files: "), F.col("files").cast("string"), F.lit(", lines: "), F.coalesce(F.col("lines").cast("string"), F.lit("0")), F.lit(", documented: "), F.round(100 * F.col("documented")).cast("int").cast("string"), F.lit(" %"))
    body = F.concat_ws("\n\n", F.concat(F.lit("# "), "repo"), figures, F.array_join(F.transform("languages", lambda x: x["line"]), "\n\n"), F.concat(F.lit("Packages: "), "packages"))
    return totals.join(spoken, "repo", "left").join(used, "repo", "left").select("repo", body.alias("markdown"))
