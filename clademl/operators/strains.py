"""Strain curation and accession handling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import accession_triplets, archive_file_url, archive_url, last_segment

CURATION_RENAMES = {"confirmed": "probiotic", "genome": "ncbi_genome", "target_raw": "target"}


def curate(df: DataFrame, renames: dict | None = None) -> DataFrame:
    """Rename the sheet's flag columns, lower-case them, keep the last path segment of the FTP path."""
    d = df.withColumnsRenamed(renames or CURATION_RENAMES)
    return d.withColumns({"probiotic": F.lower("probiotic"), "ncbi_genome": F.lower("ncbi_genome"),
                          "target": F.lower("target"), "refseq_ftp": last_segment("refseq_ftp")})


def select_strains(curated: DataFrame, flag: str = "yes") -> DataFrame:
    """Strains with the given probiotic flag and a genome."""
    return curated.filter((F.col("probiotic") == flag) & (F.col("ncbi_genome") == "yes"))


def accession_of(df: DataFrame, path_col: str = "refseq_ftp", out: str = "accession") -> DataFrame:
    """C4."""
    return df.withColumn(out, last_segment(path_col))


def archive_paths(df: DataFrame, acc_col: str = "accession") -> DataFrame:
    """Triplet folder, folder URL and file URL of each accession (NULL when malformed)."""
    return df.withColumns({"triplets": accession_triplets(acc_col), "folder_url": archive_url(acc_col),
                           "file_url": archive_file_url(acc_col)})
