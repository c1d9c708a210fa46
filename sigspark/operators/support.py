"""Linear support vector regression of expression on alterations, for many genes at once, until the duality gap is small.

The loss is c * max(0, |y - x w| - epsilon) with |w|^2 / 2, the intercept a coefficient like the others. It is solved by alternating directions: each block of samples
keeps its residuals z and scaled multipliers u; what the blocks send is x'x and x'(y + z - u), whose sums over the blocks give all of them the next w. The
multipliers, cut to the dual's box, are a dual solution: primal and dual values are sums over the blocks too, so their
difference, which bounds the distance to the optimum, is known exactly. A cohort of one block needs no exchange and is solved where it lies.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import dropped, folder
from .cohort import WEIGHT, Cohort, alike, bits, design, every, gene_blocks, packed_cohort, together

#: Genes that are fitted side by side, and genes times samples, of which a task holds a few dense tables.
GENES, CELLS = 8, 8_000_000
#: The largest cohort that is solved where it lies, one gene of which is what a task holds at least; samples in a block of larger ones.
SAMPLES, BLOCK = 8_000_000, 100_000
#: Samples that a step takes at a time; numbers of a design that is kept dense.
ROWS, DENSE = 512, 4_000_000
#: The largest duality gap of a gene, as a share of its primal value.
GAP = 1e-4
#: Iterations between looks at the gap; the most iterations of one block alone, and of several blocks, each of which is a Spark job.
LOOK, ITERATIONS, ROUNDS = 10, 5000, 400
RELAX = 1.7
_FIT = "part int, genes int, names array<string>, w array<double>, gap double"
_BLOCK = "part int, genes int, block int, names array<string>, first array<int>, cols array<int>, on array<int>, at array<int>, y array<double>"
_STATE = _BLOCK + ", z array<double>, u array<double>, gram array<double>, right array<double>, loss array<double>, dual array<double>, back array<double>"


class Block:
    """Samples of one block with their targets, z and u; cols are lists of alterations or packed bits. times: how many samples a row stands for.

    x is made dense for ROWS samples at a time, from bits, so that what a step makes stays in the cache; it stays dense where it has no more than DENSE numbers.
    """

    def __init__(self, cols, p: int, y: np.ndarray, c: float, epsilon: float, z: np.ndarray | None = None, u: np.ndarray | None = None, times: np.ndarray | None = None):
        self.bits, self.p = cols if isinstance(cols, np.ndarray) else bits(cols, p), p
        self.y, self.c, self.epsilon = y, c, epsilon
        self.z, self.u = (-y if z is None else z), (np.zeros_like(y) if u is None else u)
        self.times = np.ones((len(y), 1)) if times is None else times[:, None].astype(float)
        self.kept = [self._piece(i) for i in range(0, len(y), ROWS)] if y.shape[0] * (p + 1) <= DENSE else None

    def _piece(self, i: int) -> tuple[slice, np.ndarray]:
        s = slice(i, i + ROWS)
        x = np.ones((len(self.bits[s]), self.p + 1))
        x[:, :-1] = np.unpackbits(self.bits[s], axis=1, count=self.p)
        return s, x

    def pieces(self) -> Iterable[tuple[slice, np.ndarray]]:
        return self.kept if self.kept is not None else map(self._piece, range(0, len(self.y), ROWS))

    def gram(self) -> np.ndarray:
        return sum((x.T @ (x * self.times[s]) for s, x in self.pieces()), np.zeros((self.p + 1, self.p + 1)))

    def _right(self, s: slice, x: np.ndarray) -> np.ndarray:
        return x.T @ (self.times[s] * (self.y[s] + self.z[s] - self.u[s]))

    def right(self) -> np.ndarray:
        return sum((self._right(s, x) for s, x in self.pieces()), np.zeros((self.p + 1, self.y.shape[1])))

    def step(self, w: np.ndarray) -> np.ndarray:
        """The penalty is c, so multipliers have the range of -1 to 1 and residuals shrink by at most 1. Returns what `right` then is."""
        right = np.zeros_like(w)
        for s, x in self.pieces():
            v = RELAX * (x @ w - self.y[s]) + (1 - RELAX) * self.z[s] + self.u[s]
            over = v - np.clip(v, -self.epsilon, self.epsilon)
            self.z[s] = v - np.clip(over, -1, 1)
            self.u[s] = v - self.z[s]
            right += self._right(s, x)
        return right

    def values(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per gene: this block's parts of the primal loss and of the dual value, and x'beta, of whose sum the dual takes half the square off."""
        loss, dual, back = np.zeros(w.shape[1]), np.zeros(w.shape[1]), np.zeros_like(w)
        for s, x in self.pieces():
            beta = -self.c * np.clip(self.u[s], -1, 1)
            loss += self.c * (self.times[s] * np.maximum(np.abs(x @ w - self.y[s]) - self.epsilon, 0)).sum(axis=0)
            beta *= self.times[s]
            dual += (self.y[s] * beta).sum(axis=0) - self.epsilon * np.abs(beta).sum(axis=0)
            back += x.T @ beta
        return loss, dual, back

    def without(self, done: np.ndarray) -> None:
        self.y, self.z, self.u = (np.ascontiguousarray(v[:, ~done]) for v in (self.y, self.z, self.u))


def relative_gap(w: np.ndarray, loss: np.ndarray, dual: np.ndarray, back: np.ndarray) -> np.ndarray:
    primal = 0.5 * (w * w).sum(axis=0) + loss
    return (primal - dual + 0.5 * (back * back).sum(axis=0)) / np.maximum(primal, 1e-12)


def solver(gram: np.ndarray, c: float) -> np.ndarray:
    return np.linalg.inv(gram + np.eye(len(gram)) / c)


def alone(block: Block, iterations: int = ITERATIONS, gap: float = GAP) -> tuple[np.ndarray, np.ndarray]:
    """w ((alterations + 1) x genes) and the gaps, where the samples are one block. A gene whose gap is small is done."""
    inverse, todo = solver(block.gram(), block.c), np.arange(block.y.shape[1])
    out, gaps, right = np.zeros((block.p + 1, len(todo))), np.zeros(len(todo)), block.right()
    for turn in range(iterations + 1):
        w = inverse @ right
        if turn % LOOK == 0 or turn == iterations:
            at = relative_gap(w, *block.values(w))
            done = (at <= gap) | (turn == iterations)
            out[:, todo[done]], gaps[todo[done]] = w[:, done], at[done]
            if done.all():
                break
            if done.any():
                block.without(done)
                todo, w = todo[~done], w[:, ~done]
        right = block.step(w)
    return out, gaps


def _laid_out(own: pd.DataFrame, cells: pd.DataFrame) -> tuple[list[str], list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    own = own.sort_values("sample", ignore_index=True)
    names = sorted(own["names"].iloc[0])
    on, at = pd.Index(own["sample"]).get_indexer(cells["sample"]), pd.Index(names).get_indexer(cells["gene"])
    return names, [np.asarray(j, dtype=np.int64) for j in own["cols"]], on, at, cells["u"].to_numpy(dtype=float)


def _dense(shape: tuple[int, int], on: np.ndarray, at: np.ndarray, v: np.ndarray) -> np.ndarray:
    y = np.zeros(shape)
    y[on, at] = v
    return y


def _alone(p: int, k: int, c: float, epsilon: float):
    """All parts of a cohort for a block of genes, one after the other; samples that are equal in alterations and expression are a row."""

    def fit(own: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        rows = {f.split()[0]: [] for f in _FIT.split(", ")}
        if len(own) and len(cells):
            cohort, names = Cohort(own, p, k), sorted(cells["gene"].unique())
            y = _dense((len(names), len(cohort.x)), pd.Index(names).get_indexer(cells["gene"]), cells["place"].to_numpy(), cells["u"].to_numpy(dtype=float))
            first, kind = alike(cohort.x, *y)
            x, y = cohort.x[first], y[:, first]
            for part in range(k):
                times = np.bincount(kind[cohort.members(part)], minlength=len(first))
                here = np.flatnonzero(times)
                if len(here):
                    w, gaps = alone(Block(x[here], p, np.ascontiguousarray(y[:, here].T), c, epsilon, times=times[here]))
                    for f, v in zip(rows, (part, own["genes"].iloc[0], names, w.ravel(), float(gaps.max(initial=0.0))), strict=True):
                        rows[f].append(v)
        return pd.DataFrame({f: pd.Series(v, dtype=object if f in ("names", "w") else None) for f, v in rows.items()})

    return fit


def _packed(own: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
    if own.empty:
        return pd.DataFrame({k.split()[0]: [] for k in _BLOCK.split(", ")})
    names, cols, on, at, v = _laid_out(own, cells)
    row = {"part": own["part"].iloc[0], "genes": own["genes"].iloc[0], "block": own["block"].iloc[0], "names": names, "first": np.cumsum([0, *map(len, cols)]), "cols": np.concatenate([np.zeros(0, dtype=np.int64), *cols]), "on": on, "at": at, "y": v}
    return pd.DataFrame({k: [x] for k, x in row.items()})


def _turn(p: int, c: float, epsilon: float):
    """A block's part of a round: with w its step and values, at first only what gives the first w."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for i in range(rows.num_rows):
                has = lambda k, rows=rows: k in rows.schema.names
                get = lambda k, rows=rows, i=i: rows[k][i].values.to_numpy(zero_copy_only=False)
                first, g = get("first"), len(rows["names"][i].values)
                shape = (len(first) - 1, g)
                old = [get(k).reshape(shape).copy() for k in ("z", "u")] if has("w") else [None, None]
                block = Block(np.split(get("cols"), first[1:-1]), p, _dense(shape, get("on"), get("at"), get("y")), c, epsilon, *old)
                w = get("w").reshape(p + 1, g) if has("w") else np.zeros((p + 1, g))
                right = block.step(w) if has("w") else block.right()
                new = dict(zip(("loss", "dual", "back"), block.values(w), strict=True)) | {"z": block.z, "u": block.u, "gram": block.gram(), "right": right}
                names = [k.split()[0] for k in _STATE.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays([0, new[k].size], pa.array(new[k].ravel(), pa.float64())) if k in new else rows[k].slice(i, 1) for k in names], names=names)

    return run


def _gathered(c: float):
    """The next w from all blocks of a part, and the gap of the one that they stepped with."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        names = rows["names"].iloc[0]
        total = {k: np.sum(np.stack(rows[k].to_list()), axis=0) for k in ("gram", "right", "loss", "dual", "back")}
        size = int(round(len(total["gram"]) ** 0.5))
        w, gap = solver(total["gram"].reshape(size, size), c) @ total["right"].reshape(size, -1), 1.0
        if "w" in rows:
            gap = float(relative_gap(rows["w"].iloc[0].reshape(size, -1), total["loss"], total["dual"], total["back"].reshape(size, -1)).max(initial=0.0))
        return pd.DataFrame({"part": rows["part"][:1], "genes": rows["genes"][:1], "names": [names], "w": [w.ravel()], "gap": [gap]})

    return run


def _stored(df: DataFrame) -> DataFrame:
    """Rows are large: a group of rows is closed by its size, not only after a hundred."""
    path = f"{folder(df.sparkSession)}/state"
    df.write.option("parquet.block.size", str(16 << 20)).option("parquet.block.size.row.check.min", "1").option("parquet.page.size.row.check.min", "1").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def support_vectors(alts: DataFrame, cells: DataFrame, samples: DataFrame, parts: DataFrame, c: float = 1.0, epsilon: float = 0.1) -> tuple[DataFrame, list[str]]:
    """(part, genes, names, w, gap): coefficients of every part's regression, (alterations + 1) x genes row by row, and their largest relative duality gap; and the alterations' names."""
    count = samples.select("sample").distinct().count()
    if count <= SAMPLES:
        both, names, k = packed_cohort(alts, cells, samples, parts, lambda n: max(1, min(GENES, CELLS // max(1, n))))
        return both.applyInPandas(_alone(len(names), k, c, epsilon), _FIT), names
    rows, names = design(alts, samples, parts)
    own = samples.select("sample").distinct()
    blocks = -(-count // min(SAMPLES, BLOCK))
    used, n_genes = gene_blocks(cells.join(own, "sample", "left_semi"), max(1, min(GENES, CELLS // -(-count // blocks))))
    block = F.pmod(F.xxhash64("sample"), F.lit(blocks)).cast("int").alias("block")
    listed = used.groupBy("genes").agg(F.array_sort(F.collect_set("gene")).alias("names"))  # GENES or so
    fits, every_gene = None, every(n_genes)
    with _row_by_row(own.sparkSession):
        for part in sorted(r["part"] for r in parts.select("part").distinct().collect()):  # one after the other: their states are what the disk holds
            mine = parts.where(F.col("part") == part).select(F.col("sample").alias("member")).distinct()
            of = F.lit(part).alias("part")
            left = rows.where(F.array_contains("parts", part)).select("sample", "cols", block, of).withColumn("genes", every_gene).join(listed, "genes")
            right = used.select("genes", "sample", "gene", "u", block, of).join(mine, F.col("sample") == F.col("member")).drop("member")
            fit = _rounds(together(left, right, n_genes * blocks, "part", "genes", "block"), len(names), c, epsilon)
            fits = fit if fits is None else fits.unionByName(fit)
    return fits if fits is not None else own.sparkSession.createDataFrame([], _FIT), names


@contextmanager
def _row_by_row(spark: SparkSession) -> Iterator[None]:
    """A block is a row of megabytes: a worker takes one at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "1")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _rounds(both, p: int, c: float, epsilon: float) -> DataFrame:
    """A part's rounds; of the states there are two on disk at a time. w has some numbers a gene and alteration, so it is broadcast and the blocks stay where they lie."""
    state = _stored(both.applyInPandas(_packed, _BLOCK).mapInArrow(_turn(p, c, epsilon), _STATE))
    spark, sums, gap = state.sparkSession, ("part", "genes", "names", "gram", "right", "loss", "dual", "back"), None
    w = _stored(state.select(*sums).groupBy("part", "genes").applyInPandas(_gathered(c), _FIT))
    for turn in range(ROUNDS):
        known = F.broadcast(w.select("part", "genes", "w"))  # p numbers a gene
        after = _stored(state.join(known, ["part", "genes"]).mapInArrow(_turn(p, c, epsilon), _STATE))
        _drop(state)
        state = after
        made = _stored(state.select(*sums).join(known, ["part", "genes"]).groupBy("part", "genes").applyInPandas(_gathered(c), _FIT))
        if turn % LOOK == 0:
            spark._jvm.System.gc()  # Spark frees the rounds' shuffle files when the driver collects its garbage
            if (made.agg(F.max("gap")).first()[0] or 0.0) <= GAP:
                gap = made.select("part", "genes", "gap")
                break
        _drop(w)
        w = made
    _drop(state)
    return w if gap is None else w.drop("gap").join(gap, ["part", "genes"])


def _drop(df: DataFrame) -> None:
    dropped(df.sparkSession, df.stored_at)


def svr_stability(alts: DataFrame, cells: DataFrame, samples: DataFrame, c: float = 1.0, epsilon: float = 0.1, n: int = 20, share: float = 0.5, rule: str = "mean+sd", seed: int = 44) -> DataFrame:
    """(gene, alt, weight): share of the n subsamples in whose regression the alteration's coefficient passes the rule."""
    from .linear import halves, score_mask

    fits, names = support_vectors(alts, cells, samples, halves(samples, n, share, seed), c, epsilon)

    def chosen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for genes, w in zip(rows["names"], rows["w"], strict=True):
                scores = np.abs(np.asarray(w).reshape(len(names) + 1, -1)[:-1])
                at, gene = np.nonzero(np.stack([score_mask(s, rule) for s in scores.T], axis=1)) if len(names) else ([], [])
                yield pd.DataFrame({"gene": pd.Series([genes[i] for i in gene], dtype=object), "alt": pd.Series([names[i] for i in at], dtype=object)})

    return fits.mapInPandas(chosen, "gene string, alt string").groupBy("gene", "alt").agg((F.count("*") / F.lit(float(n))).alias("weight")).select(*(x.split()[0] for x in WEIGHT.split(", ")))
