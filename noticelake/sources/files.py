"""File sources and sinks: sniffed binaries, blocks of marked-up text, corrections, exports, blobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def sniff(files: DataFrame) -> DataFrame:
    """``kind`` of binary content by its first bytes: pdf, docx, html, text, unknown; and its hash."""
    head = F.hex(F.substring("content", 1, 8))
    text = F.try_to_binary(F.lit("00"), F.lit("hex"))
    start = F.lower(F.decode(F.substring("content", 1, 512), "ISO-8859-1"))
    kind = (
        F.when(head.startswith("25504446"), "pdf").when(head.startswith("504B0304"), "docx")
        .when(start.rlike(r"^\s*(<!doctype html|<html|<head|<body)"), "html").when((F.length("content") > 0) & ~F.contains("content", text), "text").otherwise("unknown")
    )
    return files.withColumns({"kind": kind, "sha256": F.sha2("content", 256)})


def read_binaries(spark: SparkSession, path: str) -> DataFrame:
    return sniff(spark.read.format("binaryFile").load(path))


def read_corrections(spark: SparkSession, path: str, key: str, allowed: dict[str, list[str]]) -> DataFrame:
    """CSV corrections with ``problem``: empty key, repeated key, a value that isn't allowed; null if good."""
    raw = spark.read.csv(path, header=True, enforceSchema=False)
    return check_corrections(raw, key, allowed)


def check_corrections(raw: DataFrame, key: str, allowed: dict[str, list[str]]) -> DataFrame:
    copies = F.count("*").over(Window.partitionBy(key))
    problem = F.when(F.coalesce(F.trim(key), F.lit("")) == "", "empty key").when(copies > 1, "repeated key")
    for column, values in allowed.items():
        problem = problem.when(~F.coalesce(F.col(column).isin(values), F.lit(False)), f"unknown {column}")
    return raw.withColumn("problem", problem)


def write_csv(df: DataFrame, path: str, squash: list[str] = ()) -> None:
    """Header and rows; white space of the named text columns becomes single spaces."""
    flat = df.withColumns({c: F.trim(F.regexp_replace(c, r"\s+", " ")) for c in squash}) if squash else df
    flat.write.mode("overwrite").csv(path, header=True, escape='"', quote='"')


def blob_name(content: str = "content", suffix: str = "bin"):
    """Content-addressed name: two digits of the hash as folder."""
    h = F.sha2(content, 256)
    return F.concat(F.substring(h, 1, 2), F.lit("/"), h, F.lit(f".{suffix}"))


def write_blobs(df: DataFrame, folder: str, content: str = "content", suffix: str = "bin") -> DataFrame:
    """Each distinct content once in a shared file system, under its hash; name and size are returned."""

    def write(it):
        import pandas as pd
        from pyarrow import fs

        where, place = fs.FileSystem.from_uri(folder)
        for pdf in it:
            for name, data in zip(pdf["name"], pdf["content"], strict=True):
                where.create_dir(f"{place}/{name.split('/')[0]}", recursive=True)
                if where.get_file_info(f"{place}/{name}").size != len(data):
                    with where.open_output_stream(f"{place}/{name}") as out:
                        out.write(data)
            yield pd.DataFrame({"name": pdf["name"], "size": pdf["content"].map(len)})

    named = df.select(blob_name(content, suffix).alias("name"), F.col(content).alias("content")).dropDuplicates(["name"])
    return named.mapInPandas(write, "name string, size long")


def intake(files: DataFrame, suffixes: tuple[str, ...], most: int) -> DataFrame:
    """Uploads (path, content) with ``refusal`` and ``sha256``: bad suffix, empty, too large, or already seen.

    A content is seen once a file that passes the other tests has it: of those the first path stays, and a
    refused copy hides none.
    """
    own = (
        F.when(~F.lower("path").rlike(r"\.(" + "|".join(suffixes) + ")$"), "suffix").when(F.length("content") == 0, "empty")
        .when(F.length("content") > most, "size")
    )
    judged = files.withColumns({"refusal": own, "sha256": F.sha2("content", 256)})
    first = judged.where("refusal IS NULL").groupBy("sha256").agg(F.min("path").alias("__first"))
    repeated = F.when(F.col("__first") != F.col("path"), "repeated")
    return judged.join(first, "sha256", "left").select(*files.columns, F.coalesce("refusal", repeated).alias("refusal"), "sha256")


def parse_documents(files: DataFrame) -> DataFrame:
    """Sniffed binaries (path, content) as text: path, kind, text, page_count, has_text_layer.

    DOCX by its document part, HTML and plain text decoded; a PDF has its pages counted, but its text
    needs a parser that isn't here, so the text is empty and has_text_layer null.
    """
    from ..functions.text import canonical_text

    def parse(it):
        import io
        import re
        import zipfile

        import pandas as pd

        for pdf in it:
            out = []
            for path, kind, data in zip(pdf["path"], pdf["kind"], pdf["content"], strict=True):
                text, pages, layer = "", None, None
                try:
                    if kind == "docx":
                        xml = zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml").decode("utf-8", "replace")
                        text, layer = canonical_text(re.sub(r"</w:p>", "<br>", xml)), True
                    elif kind == "html":
                        text, layer = canonical_text(data.decode("utf-8", "replace")), True
                    elif kind == "text":
                        text, layer = data.decode("utf-8", "replace"), True
                    elif kind == "pdf":
                        pages = len(re.findall(rb"/Type\s*/Page\b", data))
                except (zipfile.BadZipFile, KeyError):
                    kind = "unknown"
                out.append((path, kind, text, pages, layer))
            yield pd.DataFrame(out, columns=["path", "kind", "text", "page_count", "has_text_layer"])

    return files.select("path", "kind", "content").mapInPandas(parse, "path string, kind string, text string, page_count int, has_text_layer boolean")
