"""Entries of ZIP archives and parts of web pages as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.sources import files

ENTRY = "archive string, entry string, size long, packed long, sha256 string, status string, content binary"


def zip_entries(spark: SparkSession, folder: str, most_bytes: int = 64 << 20, most_ratio: int = 200, keep: bool = False) -> DataFrame:
    """Entries of the archives of a folder, one row each; an archive is read in the task that has it.

    status: ok; too_large or ratio (an entry beyond the bounds is not unpacked);
    encrypted; unsafe (a path that leaves its root); damaged (also a whole archive,
    whose entry is null).  keep: with the content.
    """

    def one(name: str, data: bytes):
        import hashlib
        import io
        import zipfile

        try:
            z = zipfile.ZipFile(io.BytesIO(data))
        except zipfile.BadZipFile:
            yield name, None, None, None, None, "damaged", None
            return
        for e in z.infolist():
            if e.is_dir():
                continue
            status, digest, raw = "ok", None, None
            if e.flag_bits & 1:
                status = "encrypted"
            elif e.filename.startswith(("/", "\\")) or ".." in e.filename.replace("\\", "/").split("/"):
                status = "unsafe"
            elif e.file_size > most_bytes:
                status = "too_large"
            elif e.file_size > most_ratio * max(e.compress_size, 1):
                status = "ratio"
            else:
                try:
                    raw = z.read(e)
                    digest = hashlib.sha256(raw).hexdigest()
                except (zipfile.BadZipFile, NotImplementedError, OSError, ValueError):
                    status = "damaged"
            yield name, e.filename, e.file_size, e.compress_size, digest, status, raw if keep else None

    def batches(frames):
        import pandas as pd

        for frame in frames:
            for name, data in zip(frame["path"], frame["content"], strict=True):
                rows = list(one(name, data))
                if rows:
                    yield pd.DataFrame(rows, columns=["archive", "entry", "size", "packed", "sha256", "status", "content"]).astype({"size": "Int64", "packed": "Int64"})

    found = files(spark, folder).where(F.rlike("path", F.lit(r"\.(zip|apk|ipa|jar|msix)$"))).select("path", "content")
    return found.mapInPandas(batches, ENTRY)


def page_scripts(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, ordinal, src, inline_length, sha256: the scripts of a page in order."""
    every = F.regexp_extract_all(html, F.lit(r"(?is)<script\b[^>]*>.*?</script>"), F.lit(0))
    tag = pages.select(key, F.posexplode(every).alias("ordinal", "tag"))
    body = F.regexp_replace(F.regexp_replace("tag", r"(?is)^<script\b[^>]*>", ""), r"(?i)</script>$", "")
    src = F.regexp_extract("tag", r"(?i)^<script\b[^>]*\bsrc\s*=\s*[\"']?([^\"'\s>]+)", 1)
    return tag.select(key, "ordinal", F.nullif(src, F.lit("")).alias("src"), F.length(body).alias("inline_length"), F.sha2(body, 256).alias("sha256"))


def page_links(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, ordinal, href: the links of a page in order."""
    return pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(r"(?i)<a\b[^>]*?\bhref\s*=\s*[\"']([^\"']*)"), F.lit(1))).alias("ordinal", "href"))
