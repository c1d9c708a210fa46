"""Negative binomial dispersions by likelihood, and the Wald test on them (Love, Huber and Anders, 2014), for carriers of an alteration against all others.

Means are those of the normalised counts by group, no fitted count is below LEAST. A gene's dispersion maximises the likelihood less the Cox-Reid term; a trend
a1 / mean + a0 over all genes of the alteration is the centre of a log-normal prior, with which it is estimated again, unless it lies far above the trend. Fold changes and
their errors come from iterated weighted fits. What a count adds to a likelihood is a function of the count plus the count times a function of its sample's size factor, and what a
sample adds whatever its counts is a function of its size factor only. So a gene needs, for each alteration, how often each count occurs and the sums of counts and of samples by
size factor, in bins of 1/FINE of its logarithm: sums that Spark makes, whose number does not grow with the samples.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cohort import design, ragged
from .voom import lowess

#: Genes of a task; bins of the size factors of a group whose samples are all at hand.
GENES, BINS = 4, 128
#: Bins of size factors, and of counts from LARGE on, that a factor of e spans.
FINE, FINE_COUNTS, LARGE = 256, 4096, 1 << 14
LEAST = 0.5
#: The range of dispersions: the largest is this or the number of samples.
SMALLEST, LARGEST = 1e-8, 10.0
_HALF_NORMAL = 0.6744897501960817


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after eight steps up."""
    y, u = x + 8, x * (x + 7)
    v = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - v * (1 / 360 - v * (1 / 1260 - v / 1680))) / y - np.log(u * (u + 6) * (u + 10) * (u + 12))


class Group:
    """Samples of one group with the cells of some genes, or of one gene in the groups of some alterations: how often counts occur, counts by size factor, and bins of all size factors."""

    def __init__(self, gene: np.ndarray, count: np.ndarray, size: np.ndarray, sizes: np.ndarray, genes: int):
        bins = np.array_split(np.sort(sizes), min(BINS, len(sizes)))
        self.bin_size, self.bin_n = np.array([[b.mean() for b in bins]]), np.array([[len(b) for b in bins]])
        self._set((gene, count, np.ones(len(count))), (gene, size, count), np.bincount(gene, count / size, minlength=genes), float(len(sizes)))

    @classmethod
    def of_sums(cls, times: np.ndarray, counts: np.ndarray, marks: np.ndarray, marks_size: np.ndarray, samples: np.ndarray, samples_size: np.ndarray, total: np.ndarray) -> Group:
        """A row for each alteration: by count how often it occurs and its sum, by size factor the sums of counts and of counts times it, and of samples and their size factors; sums of normalised counts."""
        own = cls.__new__(cls)
        own.bin_n, own.bin_size = samples, np.where(samples > 0, samples_size / np.maximum(samples, 1), 1.0)
        (r, c), (q, d) = np.nonzero(times), np.nonzero(marks)
        own._set((r, counts[r, c] / times[r, c], times[r, c]), (q, marks_size[q, d] / marks[q, d], marks[q, d]), total, samples.sum(axis=1))
        return own

    def _set(self, often: tuple, spread: tuple, total: np.ndarray, n) -> None:
        self.often, self.spread, self.total, self.n, self.genes = often, spread, total, n, len(total)
        self.mean, self.cells = total / n, np.bincount(often[0], often[2], minlength=self.genes)

    def over_counts(self, f, *by_gene: np.ndarray) -> np.ndarray:
        """Per gene the sum of f(count, ...) over the cells that exist."""
        gene, count, times = self.often
        return np.bincount(gene, times * f(count, *(v[gene] for v in by_gene)), minlength=self.genes)

    def over_marks(self, f, *by_gene: np.ndarray) -> np.ndarray:
        """Per gene the sum of count * f(size, ...) over the cells that exist."""
        gene, size, count = self.spread
        return np.bincount(gene, count * f(size, *(v[gene] for v in by_gene)), minlength=self.genes)

    def over_samples(self, f, *by_gene: np.ndarray) -> np.ndarray:
        """Per gene the sum of f(size, ...) over all samples, whatever their counts."""
        return (f(self.bin_size, *(v[:, None] for v in by_gene)) * self.bin_n).sum(axis=1)


def _largest(groups: list[Group]) -> float:
    return math.log(max(LARGEST, np.max(sum(g.n for g in groups))))


def _mu(size: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.maximum(size * q, LEAST)


def _weight(size: np.ndarray, q: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    m = _mu(size, q)
    return m / (1 + alpha * m)


def profile(groups: list[Group], log_alpha: np.ndarray) -> np.ndarray:
    """Per gene the log-likelihood of its dispersion, but for a constant, with the Cox-Reid term. What a sample adds beyond a count of 0 is its cell's."""
    alpha, out = np.exp(log_alpha), 0.0

    def mark(s, q, a):
        m = a * _mu(s, q)
        return np.log(m / (1 + m))

    for g in groups:
        out = out + g.over_counts(lambda k, r: log_gamma(k + r), 1 / alpha) + g.over_marks(mark, g.mean, alpha) - g.cells * log_gamma(1 / alpha)
        out = out - g.over_samples(lambda s, q, a: np.log1p(a * _mu(s, q)), g.mean, alpha) / alpha - 0.5 * np.log(g.over_samples(_weight, g.mean, alpha))
    return out


def maximised(value, low: float, high: float, genes: int, coarse: int = 12, steps: int = 9) -> np.ndarray:
    """Per gene the argument between low and high at which value(arguments) is largest: the best of a coarse grid, golden sections around it, and the top of a parabola."""
    grid = np.linspace(low, high, coarse)
    best = np.stack([value(np.full(genes, x)) for x in grid]).argmax(axis=0)
    a, b = grid[np.maximum(best - 1, 0)], grid[np.minimum(best + 1, coarse - 1)]
    ratio = (math.sqrt(5) - 1) / 2
    x, y = b - ratio * (b - a), a + ratio * (b - a)
    fx, fy = value(x), value(y)
    for _ in range(steps):
        left = fx >= fy
        a, b = np.where(left, a, x), np.where(left, y, b)
        new = np.where(left, b - ratio * (b - a), a + ratio * (b - a))
        f = value(new)
        x, y, fx, fy = np.where(left, new, y), np.where(left, x, new), np.where(left, f, fy), np.where(left, fx, f)
    mid, half = (a + b) / 2, (b - a) / 2
    fa, fm, fb = value(a), value(mid), value(b)
    bend = fa - 2 * fm + fb
    with np.errstate(divide="ignore", invalid="ignore"):
        top = np.where(bend < 0, half * (fa - fb) / (2 * bend), np.where(fa > fb, -half, half))
    return mid + np.clip(top, -half, half)


def gene_wise(groups: list[Group]) -> np.ndarray:
    return np.exp(maximised(lambda x: profile(groups, x), math.log(SMALLEST), _largest(groups), groups[0].genes))


def towards(groups: list[Group], trend: np.ndarray, variance: float | np.ndarray) -> np.ndarray:
    """Dispersions of largest posterior density under a log-normal prior around the trend."""
    centre = np.log(trend)
    return np.exp(maximised(lambda x: profile(groups, x) - (x - centre) ** 2 / (2 * variance), math.log(SMALLEST), _largest(groups), groups[0].genes))


def fold_changes(groups: list[Group], alpha: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Natural logarithm of the ratio of the first group's mean to the second's, and its standard error, by iterated weighted least squares."""
    level, information = [], []
    for g in groups:
        q = np.maximum(g.mean, LEAST / 10)
        for _ in range(rounds):
            # the working value is log(mu / size) + (count - mu) / mu: a count adds count / (1 + alpha mu) to its weighted sum
            zero = g.over_samples(lambda s, m, a: _weight(s, m, a) * (np.log(_mu(s, m) / s) - 1), q, alpha)
            own = g.over_marks(lambda s, m, a: 1 / (1 + a * _mu(s, m)), q, alpha)
            new = np.exp(np.clip((zero + own) / g.over_samples(_weight, q, alpha), -30, 30))
            moved, q = np.abs(np.log(new / q)).max(initial=0.0), new
            if moved < 1e-8:
                break
        level.append(np.log(q))
        information.append(g.over_samples(_weight, q, alpha))
    return level[0] - level[1], np.sqrt(1 / information[0] + 1 / information[1])


def trend_of(mean: np.ndarray, alpha: np.ndarray) -> tuple[float, float]:
    """(a0, a1) of the trend a0 + a1 / mean by a gamma model, without the genes that it fits badly; if that fails, a level line."""
    used = alpha > 100 * SMALLEST
    level = (float(np.sort(alpha[used])[int(0.001 * used.sum()) : used.sum() - int(0.001 * used.sum())].mean()) if used.any() else SMALLEST, 0.0)
    x, y, old = 1 / np.maximum(mean[used], 1e-300), alpha[used], np.array([0.1, 1.0])
    for _ in range(100):
        ratio = y / (old[0] + old[1] * x)
        keep = (ratio > 1e-4) & (ratio < 15)
        if keep.sum() < 3:
            return level
        new, a = old, np.stack([np.ones(keep.sum()), x[keep]], axis=1)
        for _ in range(50):
            w = 1 / (a @ new) ** 2
            try:
                step = np.linalg.solve((a * w[:, None]).T @ a, a.T @ (w * y[keep]))
            except np.linalg.LinAlgError:
                return level
            step = np.maximum(step, 1e-12)
            done, new = np.abs(np.log(step / new)).max() < 1e-8, step
            if done:
                break
        if (np.log(new / old) ** 2).sum() < 1e-6:
            return float(new[0]), float(new[1])
        old = new
    return level


def priors(rows: pd.DataFrame) -> pd.DataFrame:
    """Of an alteration's genes (alt, mean, alpha, df): the trend, the prior's variance, and the limit above which a dispersion is left as it is."""
    from .differential import trigamma

    mean, alpha = rows["mean"].to_numpy(), rows["alpha"].to_numpy()
    a0, a1 = trend_of(mean, alpha)
    used = alpha >= 100 * SMALLEST
    left = np.log(alpha[used]) - np.log(a0 + a1 / mean[used])
    spread = (np.median(np.abs(left - np.median(left))) / _HALF_NORMAL) ** 2 if used.any() else 0.0
    return pd.DataFrame({"alt": rows["alt"][:1], "a0": a0, "a1": a1, "variance": max(spread - trigamma(float(rows["df"].iloc[0]) / 2), 0.25), "far": 2 * math.sqrt(spread)})


def filtered(rows: pd.DataFrame, alpha: float = 0.05) -> pd.DataFrame:
    """rows of one alteration with padj: Benjamini-Hochberg among the genes above the mean that gives most rejections, as a smooth curve over 50 shares of genes says."""

    def adjusted(p: np.ndarray) -> np.ndarray:
        order = np.argsort(p)
        back = np.minimum.accumulate((p[order] * len(p) / np.arange(1, len(p) + 1))[::-1])[::-1]
        out = np.empty(len(p))
        out[order] = np.minimum(back, 1)
        return out

    mean, p = rows["mean"].to_numpy(), rows["pvalue"].to_numpy()
    low = float((mean == 0).mean())
    share = np.linspace(low, 0.95 if low < 0.95 else 1.0, 50)
    cuts = np.quantile(mean, share)
    counts = np.array([(adjusted(p[mean >= c]) < alpha).sum() if (mean >= c).any() else 0 for c in cuts])
    at = 0
    if counts.max() > 10:
        x, y = lowess(share, counts.astype(float), 0.2, delta=0)
        fit = np.interp(share, x, y)
        left = counts[counts > 0] - fit[counts > 0]
        at = int(np.argmax(counts > fit.max() - math.sqrt((left**2).mean())))
    keep = mean >= cuts[at]
    out = np.full(len(p), np.nan)
    out[keep] = adjusted(p[keep])
    return rows.assign(padj=pd.Series(out, index=rows.index).astype(object).where(keep, None))


_SUMS = "gene string, code array<long>, times array<double>, counts array<double>, bin array<long>, marks array<double>, marks_size array<double>, total array<double>"
_FIRST = _SUMS + ", mean double, alpha array<double>"
_LAST = "alt string, gene string, mean double, alpha double, lfc double, se double"


def _code(count: np.ndarray) -> np.ndarray:
    """Counts as they are, the large ones in bins of a FINE_COUNTS-th of their logarithm."""
    large = np.floor(np.log(np.maximum(count, LARGE) / LARGE) * FINE_COUNTS).astype(np.int64)
    return np.where(count < LARGE, count.astype(np.int64), LARGE + large)


def _gene_sums(p: int, low: int, bins: int):
    """The sums of every gene of rows (gene, count, size, bin, cols) that come gene by gene: for each alteration over its carriers, last over all samples. The entries that are 0 are left out."""
    names = [k.split()[0] for k in _SUMS.split(", ")]

    def packed(gene: str, times: np.ndarray, counts: np.ndarray, marks: np.ndarray, marks_size: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
        at, on = np.flatnonzero(times), np.flatnonzero(marks)
        lists = (at // times.shape[1] * (1 << 32) + at % times.shape[1], times.ravel()[at], counts.ravel()[at], on, marks.ravel()[on], marks_size.ravel()[on], total)
        return pa.RecordBatch.from_arrays([pa.array([gene]), *(pa.ListArray.from_arrays([0, len(v)], pa.array(v)) for v in lists)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gene, sums = None, None
        for rows in batches:
            found = rows["gene"].to_numpy(zero_copy_only=False)
            count, size, place = (rows[c].to_numpy(zero_copy_only=False) for c in ("count", "size", "bin"))
            code, place, cols = _code(count), place - low, rows["cols"].flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            first = rows["cols"].offsets.to_numpy() - rows["cols"].offsets[0].as_py()
            for at in (starts := [0, *(np.flatnonzero(found[1:] != found[:-1]) + 1), len(found)])[:-1]:
                to = starts[starts.index(at) + 1]
                if found[at] != gene:
                    if sums:
                        yield packed(gene, *sums)
                    gene, sums = found[at], [np.zeros((p + 1, 0)), np.zeros((p + 1, 0)), np.zeros((p + 1, bins)), np.zeros((p + 1, bins)), np.zeros(p + 1)]
                more = int(code[at:to].max()) + 1 - sums[0].shape[1]
                if more > 0:
                    sums[:2] = [np.pad(v, ((0, 0), (0, more))) for v in sums[:2]]
                size_ = np.diff(first[at : to + 1])
                own = np.concatenate([np.repeat(np.arange(at, to), size_), np.arange(at, to)])
                col = np.concatenate([cols[ragged(first[at:to], size_)], np.full(to - at, p)])
                k, s = count[own].astype(float), size[own]
                for v, where, value in zip(sums, (code, code, place, place, None), (np.ones(len(k)), k, k, k * s, k / s), strict=True):
                    np.add.at(v.reshape(-1), col if where is None else col * v.shape[1] + where[own], value)
        if sums:
            yield packed(gene, *sums)

    return run


def _groups(row: dict, enough: np.ndarray, p: int, samples: np.ndarray, samples_size: np.ndarray) -> list[Group]:
    """Carriers and all others, of the alterations in `enough`."""
    (who, code), bins = np.divmod(row["code"], 1 << 32), samples.shape[1]
    kinds, code = np.unique(code, return_inverse=True)
    sums = [np.zeros((p + 1, len(kinds))), np.zeros((p + 1, len(kinds))), np.zeros((p + 1, bins)), np.zeros((p + 1, bins)), samples, samples_size, row["total"]]
    for v, k in zip(sums, ("times", "counts"), strict=False):
        v[who, code] = row[k]
    for v, k in zip(sums[2:], ("marks", "marks_size"), strict=False):
        v.reshape(-1)[row["bin"]] = row[k]
    return [Group.of_sums(*(v[enough] for v in sums)), Group.of_sums(*(v[-1] - v[enough] for v in sums))]


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, dict]]:
    for rows in batches:
        for i in range(rows.num_rows):
            own = rows.slice(i, 1)
            yield own, {c: own[c].flatten().to_numpy(zero_copy_only=False) if pa.types.is_list(own.schema.field(c).type) else own[c][0].as_py() for c in own.schema.names}


def dispersions(alts: DataFrame, rna: DataFrame, sizes: DataFrame, enough: list[str]) -> DataFrame:
    """(alt, gene, mean, alpha, lfc, se) of the alterations in `enough`: final dispersions, natural log fold changes and their errors. sizes: (sample, size_factor)."""
    from .support import _stored

    spark = rna.sparkSession
    binned = sizes.select("sample", F.col("size_factor").cast("double").alias("size"), F.floor(F.ln("size_factor") * FINE).cast("int").alias("bin"))
    rows, names = design(alts, sizes.select("sample"))
    chosen = [i for i, f in enumerate(names) if f in set(enough)]
    both = [F.count("*").cast("double").alias("n"), F.sum("size").alias("s")]
    whole = binned.groupBy("bin").agg(*both).collect()  # a row for each bin of size factors
    if not chosen or not whole:
        return spark.createDataFrame([], _LAST)
    carriers = rows.select("sample", F.explode("cols").alias("col")).join(binned, "sample").groupBy("col", "bin").agg(*both).collect()  # and for each alteration
    p, low, n_all = len(names), min(r["bin"] for r in whole), sum(r["n"] for r in whole)
    bins = max(r["bin"] for r in whole) - low + 1
    samples, samples_size = np.zeros((p + 1, bins)), np.zeros((p + 1, bins))
    for col, r in [*((p, r) for r in whole), *((r["col"], r) for r in carriers)]:
        samples[col, r["bin"] - low], samples_size[col, r["bin"] - low] = r["n"], r["s"]
    genes = rna.where("count > 0").select("gene").distinct().count()
    tasks, index = max(1, -(-genes // GENES)), np.array(chosen)
    cells = rna.where("count > 0").select("sample", "gene", F.col("count").cast("long").alias("count")).join(rows.join(binned, "sample"), "sample").select("gene", "count", "size", "bin", "cols")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, row in _each(_gene_sums(p, low, bins)(batches)):
            alpha = gene_wise(_groups(row, index, p, samples, samples_size))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array([row["total"][-1] / n_all]), pa.ListArray.from_arrays([0, len(alpha)], pa.array(alpha))], names=[*own.schema.names, "mean", "alpha"])

    found = _stored(cells.repartition(tasks, "gene").sortWithinPartitions("gene").mapInArrow(first, _FIRST))
    numbered = F.broadcast(spark.createDataFrame([(i, names[c]) for i, c in enumerate(chosen)], "pos int, alt string"))  # a row per alteration
    of_alt = found.select("gene", "mean", F.posexplode("alpha").alias("pos", "alpha")).join(numbered, "pos").select("alt", "gene", "mean", "alpha", F.lit(float(n_all - 2)).alias("df"))
    by_alt = {r["alt"]: (r["a0"], r["a1"], r["variance"], r["far"]) for r in of_alt.groupBy("alt").applyInPandas(priors, "alt string, a0 double, a1 double, variance double, far double").collect()}  # a row per alteration
    told = [names[c] for c in chosen]
    a0, a1, variance, far = np.array([by_alt.get(a, (1.0, 0.0, 1.0, 1.0)) for a in told]).T

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, row in _each(batches):
            groups, trend = _groups(row, index, p, samples, samples_size), a0 + a1 / row["mean"]
            alpha = np.where(np.log(row["alpha"]) > np.log(trend) + far, row["alpha"], towards(groups, trend, variance))
            change, error = fold_changes(groups, alpha)
            yield pa.RecordBatch.from_pandas(pd.DataFrame({"alt": told, "gene": row["gene"], "mean": row["mean"], "alpha": alpha, "lfc": change, "se": error}), preserve_index=False)

    return found.repartition(tasks, "gene").mapInArrow(last, _LAST)
