"""Certificate files: PEM bundles and single DER files as one row a certificate."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cipherlake import dims
from cipherlake.functions import der

#: Endings of certificate files, in any case.
ENDINGS = ["pem", "crt", "cer", "der"]
FIELDS = ["subject", "issuer", "serial", "not_before", "not_after", "algorithm", "key_size", "signature"]
BLOCK = r"(?s)-----BEGIN CERTIFICATE-----(.*?)-----END CERTIFICATE-----"


def walk(spark: SparkSession, root: str, max_files: int | None = None) -> DataFrame:
    """(path, content) of the certificate files below root, or of root itself; folders that no scan enters are left out, other endings are not read.

    max_files is the scan's own limit, off by default: the first in path order, chosen before any content is read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    files = files.where(F.lower("path").rlike(r"\.(" + "|".join(ENDINGS) + ")$"))
    files = files.where(~F.col("path").rlike("/(" + "|".join(d.replace(".", "\\.") for d in dims.SKIP_DIRS) + ")/"))
    if max_files is not None:
        files = files.join(files.select("path").orderBy("path").limit(max_files), "path", "left_semi")
    return files.select("path", "content")


def split(files: DataFrame) -> DataFrame:
    """(path, place, der) for files (path, content): each certificate block of a PEM file, counted from 1, or the whole of any other file at place 1.

    Blocks that are not base64 are passed over but counted; null and empty contents give no row.
    """
    text = F.decode("content", "ISO-8859-1")
    blocks = F.transform(F.regexp_extract_all(text, F.lit(BLOCK), F.lit(1)), lambda b: F.try_to_binary(F.regexp_replace(b, r"\s", ""), F.lit("base64")))
    each = F.when(F.contains(text, F.lit("-----BEGIN CERTIFICATE-----")), blocks).otherwise(F.array("content"))
    out = files.select("path", F.posexplode(each).alias("at", "der"))
    return out.where("length(der) > 0").select("path", (F.col("at") + 1).cast("long").alias("place"), "der")


def read(certificates: DataFrame) -> DataFrame:
    """(path, place, subject, issuer, serial, not_before, not_after, algorithm, key_size, signature) of certificates (path, place, der).

    What is not a certificate gives no row. Serials are hexadecimal, times ISO 8601 in UTC.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, rows = [], []
            for i, data in enumerate(batch.column("der")):
                try:
                    rows.append(der.certificate(data.as_py()))
                except (ValueError, IndexError):
                    continue
                kept.append(i)
            head = batch.select(["path", "place"]).take(pa.array(kept, pa.int64()))
            columns = [pa.array([r[f] for r in rows], pa.int64() if f == "key_size" else pa.string()) for f in FIELDS]
            yield pa.RecordBatch.from_arrays([*head.columns, *columns], names=["path", "place", *FIELDS])

    kinds = ", ".join(f"{f} {'long' if f == 'key_size' else 'string'}" for f in FIELDS)
    return certificates.select("path", "place", "der").mapInArrow(run, f"path string, place long, {kinds}")
