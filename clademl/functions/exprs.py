"""Column-expression helpers (all JVM-side, inside whole-stage codegen)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def order_key(seed: int | str, *parts: str | Column) -> Column:
    """Deterministic order key ``md5(concat_ws('|', seed, parts...))`` (hex text).

    The same expression in DuckDB is ``md5(concat_ws('|', 'seed', CAST(x AS VARCHAR), ...))``,
    so every sampling / fold decision is reproducible across engines and runs.
    """
    pieces = [F.lit(str(seed))] + [col_(p).cast("string") for p in parts]
    return F.md5(F.concat_ws("|", *pieces))


def hex_to_long(hex_col: Column, digits: int = 8) -> Column:
    """First ``digits`` hex digits of a hex string as a non-negative long."""
    return F.conv(F.substring(hex_col, 1, digits), 16, 10).cast("long")


def safe_div(num: Column, den: Column) -> Column:
    """Division returning NULL for a zero denominator (ANSI mode would raise)."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def case_map(c: str | Column, mapping: Mapping, default=None) -> Column:
    """``case_when`` of exact values (P10)."""
    c = col_(c)
    expr = None
    for k, v in mapping.items():
        expr = F.when(c == F.lit(k), F.lit(v)) if expr is None else expr.when(c == F.lit(k), F.lit(v))
    if expr is None:
        return F.lit(default)
    return expr.otherwise(F.lit(default))


def tidy_round(c: str | Column, dp: int = 2, tol: float = 1.49e-8) -> Column:
    """Keep (near-)integers as they are, round the rest to ``dp`` places."""
    c = col_(c).cast("double")
    return F.when(F.abs(c - F.round(c, 0)) < F.lit(tol), c).otherwise(F.round(c, dp))


def round_text(c: str | Column, dp: int = 3) -> Column:
    """A number as text with exactly ``dp`` places, ties away from zero (P16); NULL stays NULL."""
    c = col_(c).cast("double")
    return F.when(c.isNotNull(), F.format_string(f"%.{int(dp)}f", c))


def argmax_class(prob_cols: Mapping[str, str | Column]) -> Column:
    """Name of the class with the largest probability; ties -> first listed level."""
    items = list(prob_cols.items())
    best = F.greatest(*[col_(c) for _, c in items]) if len(items) > 1 else col_(items[0][1])
    expr = None
    for name, c in items:
        cond = col_(c) == best
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr


def threshold_class(prob_neg: str | Column, negative: str, positive: str, t: float = 0.5) -> Column:
    """``p(negative) >= t -> negative else positive``."""
    p = col_(prob_neg)
    return F.when(p.isNull(), F.lit(None).cast("string")).when(p >= F.lit(t), F.lit(negative)).otherwise(F.lit(positive))


def decimal_comma(c: str | Column) -> Column:
    """Decimal-comma text -> double, invalid -> NULL."""
    return _try_double(F.regexp_replace(col_(c), ",", "."))


def _try_double(c: Column) -> Column:
    return c.try_cast("double")


def to_decimal_comma(c: str | Column) -> Column:
    """Double -> text with a decimal comma."""
    return F.regexp_replace(col_(c).cast("string"), r"\.", ",")


# Public genome archive layout used for accession downloads.
ARCHIVE_BASE = "https://ftp.ncbi.nlm.nih.gov/genomes/all/GCF/"
ARCHIVE_FILE_SUFFIX = "_genomic.gbff.gz"


def accession_triplets(acc: str | Column) -> Column:
    """Digits after ``GCF_`` (up to the first dot) cut into 3-digit groups joined by ``/``; NULL if absent."""
    digits = F.regexp_extract(col_(acc), r"GCF_(\d+)\.", 1)
    return F.when(digits == "", F.lit(None).cast("string")).otherwise(
        F.regexp_replace(digits, r"(\d{3})(?=\d)", "$1/"))


def archive_url(acc: str | Column) -> Column:
    """Folder URL of an accession in the archive, NULL for a malformed accession."""
    a = col_(acc)
    return F.concat(F.lit(ARCHIVE_BASE), accession_triplets(a), F.lit("/"), a, F.lit("/"))


def archive_file_url(acc: str | Column) -> Column:
    a = col_(acc)
    return F.concat(archive_url(a), a, F.lit(ARCHIVE_FILE_SUFFIX))


def last_segment(c: str | Column) -> Column:
    """Last ``/``-separated path segment."""
    return F.regexp_replace(col_(c), r"^.*/", "")
