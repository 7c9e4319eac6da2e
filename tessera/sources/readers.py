"""Readers and writers of the formats the pipeline exchanges."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as px

#: Suffixes of image files.
IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "tif", "tiff", "bmp")
#: Folders that hold no images of the collection.
EXCLUDED_FOLDERS = ("br35h-mask-rcnn", "pred")


def image_files(spark: SparkSession, root: str, excluded: Sequence[str] = EXCLUDED_FOLDERS, content: bool = True) -> DataFrame:
    """(path, bytes, parent, class, split, sha256) of image files below ``root``; content is read only for the digest."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    kept = raw.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*IMAGE_SUFFIXES) & ~px.has_folder(F.col("path"), *excluded))
    cols = ["path", F.col("length").alias("bytes"), px.parent(F.col("path")).alias("parent"), px.class_of(F.col("path")).alias("class"), px.split_of(F.col("path")).alias("split")]
    return kept.select(*cols, *([F.sha2("content", 256).alias("sha256")] if content else []))


def union_sources(spark: SparkSession, roots: Mapping[str, str], **options) -> DataFrame:
    """The image files of several roots with their source; a root that does not exist is left out."""
    out = None
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for source, root in sorted(roots.items()):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        if path.getFileSystem(conf).exists(path):
            part = image_files(spark, root, **options).withColumn("source", F.lit(source))
            out = part if out is None else out.unionByName(part)
    if out is None:
        raise FileNotFoundError(f"none of {sorted(roots.values())}")
    return out


def json_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, doc): whole files parsed as JSON values; what cannot be parsed is NULL."""
    raw = spark.read.format("binaryFile").load(path)
    return raw.select("path", F.try_parse_json(F.col("content").cast("string")).alias("doc"))


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """(doc): one JSON value per line; what cannot be parsed is NULL."""
    return spark.read.text(path).select(F.try_parse_json("value").alias("doc"))


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object per row, NULL fields included."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def count_lines(spark: SparkSession, path: str) -> DataFrame:
    """(n): lines of all text files below a folder."""
    return spark.read.option("recursiveFileLookup", "true").text(path).agg(F.count(F.lit(1)).alias("n"))


def optional(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame | None:
    """The data at a path, None where there is none."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.format(form).load(path) if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where) else None


class Missing(LookupError):
    """An artefact that is not there."""


class Artefacts:
    """Artefacts by name, each read once; asking for one that is not there raises :class:`Missing`."""

    def __init__(self, spark: SparkSession, root: str, form: str = "parquet"):
        self._spark, self._root, self._form = spark, root.rstrip("/"), form
        self._held: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._held:
            found = optional(self._spark, f"{self._root}/{name}", self._form)
            if found is None:
                raise Missing(name)
            self._held[name] = found
        return self._held[name]


def verified(files: DataFrame, expected: Mapping[str, str]) -> DataFrame:
    """(name, md5, ok): files (path, content) against the MD5 each name should have; unknown names have NULL."""
    name = F.substring_index("path", "/", -1)
    known = F.create_map(*[F.lit(x) for kv in expected.items() for x in kv]) if expected else F.create_map().cast("map<string,string>")
    return files.select(name.alias("name"), F.md5("content").alias("md5")).withColumn("ok", F.col("md5") == F.lower(F.try_element_at(known, F.col("name"))))


_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _paragraphs(data: bytes) -> str | None:
    """Text of a word-processor document, a line per paragraph; None if it cannot be read."""
    import io
    import zipfile
    from xml.etree import ElementTree

    try:
        with zipfile.ZipFile(io.BytesIO(data)) as held, held.open("word/document.xml") as body:
            lines, parts = [], []
            for _, e in ElementTree.iterparse(body, events=("end",)):
                name = e.tag.removeprefix(_WORD)
                if name == "t":
                    parts.append(e.text or "")
                elif name == "p":
                    lines.append("".join(parts))
                    parts = []
                    e.clear()
            return "\n".join(lines)
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return None


def docx_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of word-processor files: runs joined, paragraphs on lines of their own; NULL if unreadable."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "text": [_paragraphs(data) for data in b["content"]]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, "path string, text string")


def csv_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV artefact with a fixed schema; empty text is NULL."""
    return spark.read.schema(schema).option("header", "true").option("multiLine", "true").option("escape", '"').option("emptyValue", "").option("nullValue", "").csv(path)


def write(df: DataFrame, path: str, form: str = "parquet", overwrite: bool = True, dry_run: bool = False) -> DataFrame:
    """Write unless it is a dry run; without ``overwrite`` an existing target is an error."""
    if not dry_run:
        # an escape that is no backslash keeps quotes and line ends of texts as they are
        options = {"header": "true", "escape": '"', "emptyValue": ""} if form == "csv" else {}
        df.write.mode("overwrite" if overwrite else "error").format(form).options(**options).save(path)
    return df
