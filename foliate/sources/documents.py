"""Reading recognised documents from JSON and writing chunks.

A document is one JSON object a file: ``id, text, source, added, created, metadata,
attributes``; its pages come as [start, end, page] triples. Files are found by a
pattern, filtered by size before they are opened, and read in parallel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliate.operators import tree

SCHEMA = """id string, text string, source string, added string, created string,
metadata struct<`Source-File`:string,`pdf-total-pages`:bigint,`total-input-tokens`:bigint,`total-output-tokens`:bigint,`total-fallback-pages`:bigint>,
attributes struct<pdf_page_numbers:array<array<bigint>>,primary_language:array<string>,is_rotation_valid:array<boolean>,rotation_correction:array<bigint>,is_table:array<boolean>,is_diagram:array<boolean>>,
_corrupt_record string"""


def read_documents(spark: SparkSession, path: str | list[str], least_bytes: int = 0, most_bytes: int | None = None) -> DataFrame:
    """Documents below ``path`` (a folder, pattern or list of files): ``doc_id`` is the file's stem, broken files have ``error`` set."""
    rows = spark.read.schema(SCHEMA).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    size = F.col("_metadata.file_size")
    rows = rows.where((size >= least_bytes) & (size < most_bytes if most_bytes is not None else F.lit(True)))
    pages = F.transform(F.coalesce("attributes.pdf_page_numbers", F.array().cast("array<array<bigint>>")), lambda p: F.struct(p[0].alias("start"), p[1].alias("end"), p[2].alias("page")))
    return rows.select(
        F.regexp_extract("_metadata.file_name", r"(.*)\.json$", 1).alias("doc_id"),
        F.coalesce("id", F.lit("unknown")).alias("id"),
        F.coalesce("text", F.lit("")).alias("text"),
        "source",
        F.coalesce("metadata.pdf-total-pages", F.lit(1)).alias("n_pages"),
        pages.alias("pages"),
        F.col("_corrupt_record").isNotNull().alias("error"),
    )


def read_items(spark: SparkSession, path: str, most: int = 10) -> DataFrame:
    """Files that hold an object with ``text`` or a list of such objects, of which the first ``most`` are joined by blank lines."""
    raw = spark.read.text(path, wholetext=True).select(F.regexp_extract("_metadata.file_name", r"(.*)\.json$", 1).alias("doc_id"), "value")
    items = F.from_json("value", "array<struct<text:string>>")  # a single object is read as a list of one
    return raw.select("doc_id", F.array_join(F.transform(F.slice(items, 1, most), lambda x: x["text"]), "\n\n").alias("text"))


def first_folder(spark: SparkSession, folders: list[str]) -> str | None:
    """The first of some folders that exists, on any file system that Spark reads."""
    conf = spark._jsc.hadoopConfiguration()
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        if path.getFileSystem(conf).exists(path):
            return folder
    return None


def read_first(spark: SparkSession, folders: list[str], most: int = 3, below: bool = False) -> DataFrame | None:
    """The ``most`` first documents by name of the first folder that exists, or of the folders one level ``below`` it; None if there is none. Only these files are read."""
    folder = first_folder(spark, folders)
    if folder is None:
        return None
    found = sorted(file_names(spark, f"{folder}/*/*.json" if below else f"{folder}/*.json"))[:most]
    return read_documents(spark, [path for _, path in found]) if found else None


def file_names(spark: SparkSession, pattern: str) -> list[tuple[str, str]]:
    """Stem and path of each file that a pattern meets; no file is opened."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    return [(f.getPath().getName().removesuffix(".json"), f.getPath().toString()) for f in found]


def write_results(rows: DataFrame, path: str) -> None:
    """Results (statistics, sections, comparisons) as JSON lines, vectors as lists, null fields kept; text stays as it is."""
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def page_table(docs: DataFrame) -> DataFrame:
    """``doc_id, start, end, page``: a row for each page."""
    return docs.select("doc_id", F.explode("pages").alias("p")).select("doc_id", "p.*")


def write_chunks(chunks: DataFrame, path: str, level: str | None = "level") -> None:
    """Chunks as JSON lines ``{id, text, metadata}``, in a folder for each level."""
    rest = [c for c in chunks.columns if c not in ("chunk_id", "text", level)]
    keep = [level] if level and level in chunks.columns else []
    out = chunks.select(*keep, F.col("chunk_id").alias("id"), "text", F.struct(*rest).alias("metadata"))
    writer = out.write.mode("overwrite").option("ignoreNullFields", False)
    (writer.partitionBy(*keep) if keep else writer).json(path)


def read_chunks(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path)


def write_tree(nodes: DataFrame, path: str) -> None:
    """A tree of chunks in three views: ``complete`` (a nested line for each volume), ``level1`` and so on (a line for each node with its counts)."""
    write_results(tree.nested(nodes), f"{path}/complete")
    for level in (1, 2, 3):
        write_results(nodes.where(F.col("level") == level), f"{path}/level{level}")


def read_result_items(spark: SparkSession, path: str, at: str, fields: dict[str, str], whole: bool = True) -> DataFrame:
    """Elements of the list at a JSON path in result files whose shape may differ: ``file, item, <fields>, rest, error``.

    ``fields`` gives the type of each field by its JSON path below an element (``{"$.name": "string"}``); columns are named by the last
    step. A field that is missing or of another type is null; ``rest`` is the element as a variant. A file that is no JSON has one row with
    ``error``; a file without the list has none. ``whole``: a file is one object, else a line is.
    """
    raw = spark.read.text(path, wholetext=whole).select(F.col("_metadata.file_name").alias("file"), "value").where("trim(value) <> ''")
    parsed = raw.select("file", F.try_parse_json("value").alias("v"))
    items = F.coalesce(F.try_variant_get("v", at, "array<variant>"), F.when(F.col("v").isNull(), F.array(F.lit(None).cast("variant"))))
    rows = parsed.select("file", F.col("v").isNull().alias("error"), F.posexplode(items).alias("item", "rest"))
    got = [F.try_variant_get("rest", p, t).alias(p.rpartition(".")[2]) for p, t in fields.items()]
    return rows.select("file", "item", *got, "rest", "error")


def result_shape(spark: SparkSession, path: str, whole: bool = True) -> DataFrame:
    """``shape``: one schema that holds all files below a path."""
    raw = spark.read.text(path, wholetext=whole)
    return raw.agg(F.schema_of_variant_agg(F.try_parse_json("value")).alias("shape"))
