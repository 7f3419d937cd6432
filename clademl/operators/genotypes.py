"""Genotype tables in long form.

Rows are genotype calls ``(fid, iid, chrom, pos, variant_id, a1, a2, dosage)``
with ``dosage`` = copies of ``a1`` (0/1/2) or NULL for a failed call. Per-variant
statistics are one grouped aggregate; filters are semi joins on the kept
variants; the kinship matrix is a blocked distributed matrix product.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .quality import drop_samples

# Plink filter thresholds of the genotype chain.
MAF_MIN = 0.01
GENO_MAX = 0.01
HWE_MIN = 1e-6
AUTOSOMES = (1, 22)
ACGT = ["A", "C", "G", "T"]

SAMPLE = ["fid", "iid"]
VARIANT = ["chrom", "pos", "variant_id"]  # ids alone repeat ('.')


def remove_controls(g: DataFrame, ids: Sequence[str], col: str = "iid") -> DataFrame:
    """N1."""
    return drop_samples(g, col, ids)


def autosomes(g: DataFrame, lo: int = AUTOSOMES[0], hi: int = AUTOSOMES[1]) -> DataFrame:
    """Chromosome codes 1-22 only."""
    return g.filter(F.col("chrom").between(lo, hi))


def snps_only(g: DataFrame) -> DataFrame:
    """Biallelic single-letter A/C/G/T alleles."""
    return g.filter(F.col("a1").isin(ACGT) & F.col("a2").isin(ACGT))


def variant_stats(g: DataFrame) -> DataFrame:
    """Per variant in one aggregate: calls, missing rate, a1 frequency, MAF and genotype counts."""
    d = F.col("dosage")
    s = g.groupBy(*VARIANT).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(d.isNull()).alias("n_missing"),
        F.avg(d.cast("double")).alias("mean_dosage"),
        F.count_if(d == 0).alias("n0"), F.count_if(d == 1).alias("n1"), F.count_if(d == 2).alias("n2"))
    p = F.col("mean_dosage") / 2
    return s.select(*VARIANT, "n", "n_missing", (F.col("n_missing") / F.col("n")).alias("miss"),
                    p.alias("p"), F.least(p, 1 - p).alias("maf"), "n0", "n1", "n2")


def _by_variant(g: DataFrame, table: DataFrame, how: str) -> DataFrame:
    """Join ``table`` on the variant, NULL positions being equal; ``g``'s key columns stay."""
    t = table.withColumnsRenamed({c: f"__{c}" for c in VARIANT})
    on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in VARIANT]
    return g.join(t, on, how).drop(*[f"__{c}" for c in VARIANT])


def _keep(g: DataFrame, keep: DataFrame) -> DataFrame:
    return _by_variant(g, keep.select(*VARIANT), "left_semi")


def geno_filter(g: DataFrame, max_missing: float = GENO_MAX) -> DataFrame:
    """Keep variants with missing rate <= max_missing."""
    return _keep(g, variant_stats(g).filter(F.col("miss") <= max_missing))


def maf_filter(g: DataFrame, min_maf: float = MAF_MIN) -> DataFrame:
    """Keep variants with minor-allele frequency >= min_maf. A call sees its variant's mean through a window, so that the calls are
    shuffled once, and not again by an imputation that follows."""
    freq = F.avg(F.col("dosage").cast("double")).over(Window.partitionBy(*VARIANT)) / 2
    return g.withColumn("__p", freq).filter(F.least(F.col("__p"), 1 - F.col("__p")) >= min_maf).drop("__p")


def hwe_exact(n_het: int, n_hom1: int, n_hom2: int) -> float:
    """Exact Hardy-Weinberg test p-value (Wigginton, Cutler & Abecasis 2005).

    Share of the heterozygote counts at most as likely as the one seen, given the allele
    counts; log ratios of neighbouring counts are added up in one numpy pass.
    """
    n_het, n_hom1, n_hom2 = int(n_het), int(n_hom1), int(n_hom2)
    n = n_het + n_hom1 + n_hom2
    if n == 0:
        return 1.0
    rare = 2 * min(n_hom1, n_hom2) + n_het
    het = np.arange(rare % 2, rare + 1, 2, dtype=np.float64)
    hom_r, hom_c = (rare - het) / 2, n - het - (rare - het) / 2
    step = np.log(4.0 * hom_r[:-1] * hom_c[:-1]) - np.log((het[:-1] + 1) * (het[:-1] + 2))
    logp = np.concatenate(([0.0], np.cumsum(step)))
    p = np.exp(logp - logp.max())
    seen = logp[n_het // 2]
    return float(min(1.0, p[logp <= seen + 1e-9].sum() / p.sum()))


def _hwe_batch(it):
    for pdf in it:
        pdf = pdf.copy()
        pdf["p_hwe"] = [hwe_exact(h, a, b) for h, a, b in zip(pdf["n1"], pdf["n0"], pdf["n2"])]
        yield pdf


def hwe_pvalues(stats: DataFrame) -> DataFrame:
    """P-values per variant. The test depends only on the genotype-count triple,
    so it runs once per *distinct* triple (``mapInPandas``) and is joined back."""
    triples = stats.select("n0", "n1", "n2").distinct()
    pv = triples.mapInPandas(_hwe_batch, "n0 long, n1 long, n2 long, p_hwe double")
    return stats.join(pv, ["n0", "n1", "n2"])


def hwe_filter(g: DataFrame, min_p: float = HWE_MIN) -> DataFrame:
    """Keep variants whose exact HWE p-value >= min_p."""
    return _keep(g, hwe_pvalues(variant_stats(g)).filter(F.col("p_hwe") >= min_p))


def qc_filter(g: DataFrame, max_missing: float = GENO_MAX, min_maf: float = MAF_MIN, min_hwe: float = HWE_MIN) -> DataFrame:
    """N4-N6 from one aggregate over the (sample-filtered) table, as the single plink call does."""
    s = hwe_pvalues(variant_stats(g))
    keep = s.filter((F.col("miss") <= max_missing) & (F.col("maf") >= min_maf) & (F.col("p_hwe") >= min_hwe))
    return _keep(g, keep)


def bp_space(g: DataFrame, d: int = 1, block_bp: int = 1_000_000) -> DataFrame:
    """Thin variants closer than ``d`` bp.

    d = 1: one variant per (chrom, pos), the lowest variant id (a plain aggregate).
    d > 1: greedy from the start of each chromosome -- keep a site, drop every site
    closer than ``d`` to the last kept one (:func:`greedy_sites`); the kept variants then
    filter the calls with a semi join. Sites without a position are dropped for d > 1.
    """
    first = g.groupBy("chrom", "pos").agg(F.min("variant_id").alias("variant_id")).select(*VARIANT)
    return _keep(g, first if d <= 1 else greedy_sites(first, d, block_bp))


def greedy_sites(sites: DataFrame, d: int, block_bp: int = 1_000_000) -> DataFrame:
    """The greedy choice over distinct ``(chrom, pos, variant_id)`` sites as a scan over blocks of positions.

    A block of ``max(block_bp, d)`` positions is entered at one of the sites in its first ``d`` positions, or at the first one after
    them: no more than ``d + 1`` ways, whatever happened before. One pass follows each way through its block to the
    place where it enters a later one; doubling those steps (``log2`` of the number of blocks joins of small
    tables) gives the ways that start at a chromosome's first site; a last pass keeps each block's sites from the way
    that enters it. No task holds more than one block's sites.
    """
    from ..session import cut_lineage, stored

    size = max(int(block_bp), int(d))
    group = F.when(F.col("chrom").isNull(), "").otherwise(F.concat(F.lit("c"), F.col("chrom").cast("string")))
    placed = stored(sites.filter(F.col("pos").isNotNull()).select(group.alias("c"), F.floor(F.col("pos") / size).alias("b"), *VARIANT), "sites")
    head = F.col("pos") < F.col("b") * size + d
    ends = placed.groupBy("c", "b").agg(F.min("pos").alias("first"), F.min(F.when(~head, F.col("pos"))).alias("past"))
    w = Window.partitionBy("c").orderBy("b")  # one row per block
    ends = ends.withColumns({"nb": F.lead("b").over(w), "nfirst": F.lead("first").over(w), "npast": F.lead("past").over(w), "nnfirst": F.lead("first", 2).over(w)})
    # where a way goes that finds no site among the next block's first d positions
    beyond = F.when(F.col("nb") == F.col("b") + 1, F.coalesce("npast", "nnfirst")).otherwise(F.col("nfirst"))
    ends = cut_lineage(ends.select("c", "b", "first", beyond.alias("beyond")))
    rows = placed.select("c", "b", "pos", F.lit(True).alias("own"))
    rows = rows.unionByName(placed.filter(head).select("c", (F.col("b") - 1).alias("b"), "pos", F.lit(False).alias("own")))
    rows = rows.join(ends.select("c", "b", "beyond"), ["c", "b"])

    def ways(pdf: pd.DataFrame) -> pd.DataFrame:
        own, ahead = (np.sort(pdf.loc[pdf["own"] == x, "pos"].to_numpy(np.int64)) for x in (True, False))
        c, b, far = pdf["c"].iloc[0], int(pdf["b"].iloc[0]), pdf["beyond"].iloc[0]
        last = np.arange(len(own))  # the last site kept from each on, by one backward pass
        after = np.searchsorted(own, own + d)
        for i in range(len(own) - 1, -1, -1):
            if after[i] < len(own):
                last[i] = last[after[i]]
        into = own[: int(np.searchsorted(own, b * size + d)) + 1]
        need = own[last[: len(into)]] + d
        at = np.searchsorted(ahead, need)
        to = [int(ahead[k]) if k < len(ahead) else None if pd.isna(far) else int(far) for k in at]
        return pd.DataFrame({"c": c, "src": into, "dst": pd.array(to, dtype="Int64")})

    jump = cut_lineage(rows.groupBy("c", "b").applyInPandas(ways, "c string, src long, dst long").filter("dst is not null"))
    seen = cut_lineage(ends.groupBy("c").agg(F.min("first").alias("src")))
    while not jump.isEmpty():
        step = seen.join(jump, ["c", "src"]).select("c", F.col("dst").alias("src"))
        seen = cut_lineage(seen.unionByName(step).distinct())
        onward = jump.select("c", F.col("src").alias("dst"), F.col("dst").alias("end"))
        jump = cut_lineage(jump.join(onward, ["c", "dst"]).select("c", "src", F.col("end").alias("dst")))
    entered = seen.select("c", F.floor(F.col("src") / size).alias("b"), F.col("src").alias("enter"))

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos", ignore_index=True)
        pos, at, out = pdf["pos"].to_numpy(np.int64), 0, []
        at = int(np.searchsorted(pos, int(pdf["enter"].iloc[0])))
        while at < len(pos):
            out.append(at)
            at = int(np.searchsorted(pos, pos[at] + d))
        return pdf.loc[out, VARIANT]

    return placed.join(entered, ["c", "b"]).groupBy("c", "b").applyInPandas(keep, sites.select(*VARIANT).schema)


def impute_dosage(g: DataFrame, how: str = "mean") -> DataFrame:
    """Fill failed calls with the variant's rounded mean dosage (``mean``) or its mode (``mode``)."""
    if how == "mean":
        fill = F.round(F.avg("dosage").over(Window.partitionBy(*VARIANT))).cast("int")
        return g.withColumn("__fill", fill).withColumn("dosage", F.coalesce("dosage", "__fill")).drop("__fill")
    if how == "mode":
        c = g.filter(F.col("dosage").isNotNull()).groupBy(*VARIANT, "dosage").agg(F.count(F.lit(1)).alias("__c"))
        st = c.groupBy(*VARIANT).agg(F.max_by("dosage", F.struct("__c", -F.col("dosage"))).alias("__fill"))
    else:
        raise ValueError(how)
    return _by_variant(g, st, "left").withColumn("dosage", F.coalesce("dosage", "__fill")).drop("__fill")


def index_keys(df: DataFrame, keys: Sequence[str], out: str, seed: int = 0) -> DataFrame:
    """Dense 0-based index of the distinct ``keys``.

    Distinct keys are checkpointed to the reliable folder first (so every later use,
    even after an executor loss, sees the same numbering), then numbered by
    per-partition offsets: one tiny count per partition, no global sort.
    """
    from ..session import cut_lineage
    from ..sources.tables import with_file_order

    k = cut_lineage(df.select(*keys).distinct())
    return cut_lineage(with_file_order(k, out))


def whole_groups(batches: Iterator[pd.DataFrame], by: Sequence[str]) -> Iterator[pd.DataFrame]:
    """Rows that come sorted by ``by``, in frames that hold all rows of each of their groups."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        keys = [pdf[c].to_numpy() for c in by]
        if held and any(held[-1][c].iloc[-1] != k[0] for c, k in zip(by, keys)):
            yield pd.concat(held, ignore_index=True)
            held = []
        at = len(pdf) - int(np.logical_and.reduce([k == k[-1] for k in keys]).sum())
        if at:
            yield pd.concat([*held, pdf.iloc[:at]], ignore_index=True)
            held = []
        held.append(pdf.iloc[at:])
    if held:
        yield pd.concat(held, ignore_index=True)


def group_bounds(pdf: pd.DataFrame, by: Sequence[str]) -> np.ndarray:
    """First row of every run of equal ``by``, and the number of rows."""
    new = np.logical_or.reduce([np.diff(pdf[c].to_numpy()) != 0 for c in by])
    return np.concatenate(([0], np.flatnonzero(new) + 1, [len(pdf)]))


#: Products of two calls that are worked out at a time, and up to which a task goes through them one by one.
PRODUCTS, TASK_PRODUCTS = 1 << 20, 200_000_000
#: Cells of a dense product that take as long as one product of two calls.
DENSE_CELLS = 170
#: Samples up to which their names are sent to every task.
NAMES = 500_000


class _PairSums:
    """Sums of one pair of sample blocks: ``g`` of ``z_i z_j`` and ``m`` of the calls at the same variant."""

    def __init__(self, variants: int, samples: int):
        self.nv, self.ns = variants, samples
        self.g, self.m = np.zeros(samples * samples), np.zeros(samples * samples, np.int64)
        self.at: list[np.ndarray] = []
        self.z: list[np.ndarray] = []
        self.held = 0

    def add(self, left: tuple[np.ndarray, np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
        """``left`` and ``right`` are the variants (sorted), samples and standardised values of two blocks' calls."""
        (rl, cl, zl), (rr, cr, zr) = left, right
        first = np.searchsorted(rr, np.arange(self.nv + 1))
        many = np.diff(first)[rl]
        ends = np.cumsum(many)
        total = int(ends[-1]) if len(ends) else 0
        if total * DENSE_CELLS > self.nv * self.ns * self.ns:
            (zl, ol), (zr, orr) = self._dense(*left), self._dense(*right)
            self.g += (zl.T @ zr).ravel()
            self.m += (ol.T @ orr).ravel().astype(np.int64)  # counts of a block are exact in single precision
            return
        cuts = np.searchsorted(ends, np.arange(PRODUCTS, total, PRODUCTS), side="right").tolist()
        for a, b in zip([0, *cuts], [*cuts, len(rl)]):
            n = many[a:b]
            size = int(n.sum())
            if not size:
                continue
            other = np.arange(size) - np.repeat(np.cumsum(n) - n - first[rl[a:b]], n)
            self.at.append(np.repeat(cl[a:b].astype(np.int64) * self.ns, n) + cr[other])
            self.z.append(np.repeat(zl[a:b], n) * zr[other])
            self.held += size
            if self.held >= PRODUCTS:
                self._flush()

    def _dense(self, r: np.ndarray, c: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, shape = r.astype(np.int64) * self.ns + c, (self.nv, self.ns)
        return np.bincount(at, z, self.nv * self.ns).reshape(shape), np.bincount(at, minlength=self.nv * self.ns).reshape(shape).astype(np.float32)

    def _flush(self) -> None:
        if self.held:
            at = np.concatenate(self.at)
            self.g += np.bincount(at, np.concatenate(self.z), len(self.g))
            self.m += np.bincount(at, minlength=len(self.m))
            self.at, self.z, self.held = [], [], 0

    def total(self) -> np.ndarray:
        self._flush()
        return self.g.reshape(self.ns, self.ns)

    def cells(self, bi: int, bj: int) -> Iterator[pd.DataFrame]:
        self._flush()
        some = np.flatnonzero(self.m)
        for k in range(0, len(some), 100_000):
            at = some[k : k + 100_000]
            yield pd.DataFrame({"i": bi * self.ns + at // self.ns, "j": bj * self.ns + at % self.ns, "gs": self.g[at], "m": self.m[at]})


def kinship(g: DataFrame, min_maf: float = MAF_MIN, variant_block: int = 1024, sample_block: int = 1024) -> DataFrame:
    """Genomic relationship matrix ``(fid_i, iid_i, fid_j, iid_j, g, m)``.

    ``z = (x - 2p) / sqrt(2p(1-p))`` per call (variants with MAF >= min_maf),
    ``g_ij = sum_k z_ik z_jk / m_ij`` with ``m_ij`` the variants observed in both (a call that occurs twice counts twice).

    A blocked Gram product ``Z^T Z`` / ``O^T O``: calls become (variant block x sample block) rows of five bytes a call and a
    frequency per variant, and each row goes to the pairs of sample blocks it takes part in. A task reads its pairs in order, keeps
    the sums of one pair at a time and tells the cells of samples that have a variant in common; blocks with few calls are multiplied
    call by call, full ones as matrices. Where few pairs have much to add up, a pair's variants are dealt over tasks,
    and the cells' partial sums are added. Rows never pair with rows.
    """
    from ..session import cut_lineage
    from ..sources.tables import with_file_order

    st = variant_stats(g).filter(F.col("maf") >= min_maf).select(*VARIANT, "p", (F.col("n") - F.col("n_missing")).cast("double").alias("calls"))
    vi = cut_lineage(with_file_order(cut_lineage(st), "vi"))
    seen = g.filter(F.col("dosage").isNotNull())
    si = index_keys(seen, SAMPLE, "si")
    n_samples = si.count()  # both are stored index tables
    size = vi.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("calls") * F.col("calls")).alias("products")).first()
    BV, BS = max(1, min(int(variant_block), size["n"])), max(1, min(int(sample_block), n_samples))
    n_blocks, variant_blocks = max(1, -(-n_samples // BS)), max(1, -(-size["n"] // BV))
    n_pairs = n_blocks * (n_blocks + 1) // 2
    parts = int(g.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = int(min(variant_blocks, max(1, 2 * parts // n_pairs), max(1, (size["products"] or 0) // (n_pairs * TASK_PRODUCTS))))
    kind = np.uint16 if max(BV, BS) <= 1 << 16 else np.int32
    calls = _by_variant(seen, vi, "inner").join(F.broadcast(si) if n_samples <= NAMES else si, SAMPLE).select(
        F.floor(F.col("vi") / BV).alias("vb"), F.floor(F.col("si") / BS).alias("sb"),
        (F.col("vi") % BV).cast("int").alias("r"), (F.col("si") % BS).cast("int").alias("c"), F.col("dosage").cast("byte").alias("d"), "p")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_groups(batches, ["vb", "sb"]):
            at = group_bounds(pdf, ["vb", "sb"])
            r, c, d, p = pdf["r"].to_numpy(kind), pdf["c"].to_numpy(kind), pdf["d"].to_numpy(np.int8), pdf["p"].to_numpy(np.float64)
            rows = []
            for a, b in zip(at[:-1], at[1:]):
                own = np.flatnonzero(np.diff(r[a:b].astype(np.int64), prepend=-1))
                rows.append((r[a:b].tobytes(), c[a:b].tobytes(), d[a:b].tobytes(), p[a:b][own].tobytes()))
            keys = pdf.iloc[at[:-1]][["vb", "sb"]].reset_index(drop=True)
            for k in range(0, len(rows), 256):
                yield pd.concat([keys.iloc[k : k + 256].reset_index(drop=True), pd.DataFrame(rows[k : k + 256], columns=["r", "c", "d", "p"])], axis=1)

    blocks = calls.repartition("vb").sortWithinPartitions("vb", "sb", "r", "c").mapInPandas(pack, "vb long, sb long, r binary, c binary, d binary, p binary")
    dealt = blocks.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long")))).select(
        F.least("sb", "o").alias("bi"), F.greatest("sb", "o").alias("bj"), (F.col("vb") % shares).alias("share"), "vb", "sb", "r", "c", "d", "p")
    dealt = dealt.repartition(parts, "bi", "bj", "share").sortWithinPartitions("bi", "bj", "share", "vb", "sb")

    def calls_of(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        r, c, d, p = np.frombuffer(row.r, kind), np.frombuffer(row.c, kind), np.frombuffer(row.d, np.int8), np.frombuffer(row.p)
        p = p[np.cumsum(np.diff(r.astype(np.int64), prepend=r[0]) != 0)]
        sd = np.sqrt(2 * p * (1 - p))
        return r, c, (d - 2 * p) / np.where(sd > 0, sd, 1)

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, sums, left = None, None, None
        for pdf in batches:
            for row in pdf.itertuples():
                if at != (row.bi, row.bj, row.share):
                    if at is not None:
                        yield from sums.cells(*at[:2])
                    at, sums, left = (row.bi, row.bj, row.share), _PairSums(BV, BS), None
                if row.sb == row.bi:  # comes before the other block's row of this variant block
                    left = row.vb, calls_of(row)
                if row.sb == row.bj and left is not None and left[0] == row.vb:
                    sums.add(left[1], left[1] if row.bi == row.bj else calls_of(row))
        if at is not None:
            yield from sums.cells(*at[:2])

    ent = dealt.mapInPandas(multiply, "i long, j long, gs double, m long")
    if shares > 1:
        ent = ent.groupBy("i", "j").agg(F.sum("gs").alias("gs"), F.sum("m").alias("m"))
    # diagonal block pairs already hold both triangles; off-diagonal ones are mirrored
    here, there = F.struct(F.col("i").alias("i"), F.col("j").alias("j")), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))
    both = ent.select(F.explode(F.when(F.floor(F.col("i") / BS) == F.floor(F.col("j") / BS), F.array(here)).otherwise(F.array(here, there))).alias("at"), "gs", "m")
    pairs_out = both.select("at.i", "at.j", (F.col("gs") / F.col("m")).alias("g"), "m")
    si_i = si.select(F.col("si").alias("i"), F.col("fid").alias("fid_i"), F.col("iid").alias("iid_i"))
    si_j = si.select(F.col("si").alias("j"), F.col("fid").alias("fid_j"), F.col("iid").alias("iid_j"))
    if n_samples <= NAMES:
        si_i, si_j = F.broadcast(si_i), F.broadcast(si_j)
    return pairs_out.join(si_i, "i").join(si_j, "j").select("fid_i", "iid_i", "fid_j", "iid_j", "g", "m")


def dosage_vectors(g: DataFrame, variants: DataFrame | None = None) -> DataFrame:
    """One sparse dosage vector per sample over the dense variant index (NULL calls left out).

    Returns ``(fid, iid, features)``; the variant index is ``index_keys`` of the variants. Calls of a sample at one
    variant that occur more than once (ids that repeat) add up.
    """
    from pyspark.ml.linalg import SparseVector, VectorUDT

    vi = variants if variants is not None else index_keys(g, VARIANT, "vi")
    nv = vi.count()
    calls = _by_variant(g.filter(F.col("dosage").isNotNull()), vi, "inner")
    # by sample first: the sums of a call's repeats and the lists come from the same shuffle
    cells = calls.select(*SAMPLE, "vi", "dosage").repartition(*SAMPLE).groupBy(*SAMPLE, "vi").agg(F.sum(F.col("dosage").cast("double")).alias("dosage"))
    per = cells.groupBy(*SAMPLE).agg(F.sort_array(F.collect_list(F.struct("vi", "dosage"))).alias("e"))

    @F.udf(VectorUDT())
    def to_vec(at, values):  # one call per sample row
        return SparseVector(nv, at, values)

    return per.select(*SAMPLE, to_vec(F.transform("e", lambda x: x["vi"].cast("int")), F.col("e.dosage")).alias("features"))
