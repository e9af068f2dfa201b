"""Geometry of vectors and matrices whose coordinates or rows are spread over a table. Tasks send sums of products, which
add up; only those, bounded by the number of columns, come together for a decomposition."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import with_quantiles


def finite(value: Column) -> Column:
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), F.raise_error(F.lit("not finite")).cast("double")).otherwise(value)


def coefficient_of_variation(value: Column | str) -> Column:
    return F.try_divide(F.stddev_pop(value), F.nullif(F.avg(value), F.lit(0.0)))


def grouped_geometry(df: DataFrame, keys: list[str], vectors: list[str], pairs: list[tuple[str, str]]) -> DataFrame:
    """One row a coordinate, one column a vector. Norms and exact zeros of each vector, products and cosines of pairs
    (null beside a zero norm); what isn't finite is an error. Nulls are no coordinates."""
    x = {v: finite(F.col(v)) for v in vectors}
    out: list[Column] = []
    for v, c in x.items():
        out += [F.sqrt(F.sum(c * c)).alias(f"{v}_l2"), F.sqrt(F.avg(c * c)).alias(f"{v}_rms"), F.max(F.abs(c)).alias(f"{v}_linf"), F.avg((c == 0).cast("double")).alias(f"{v}_zero_fraction")]
    for a, b in pairs:
        dot = F.sum(x[a] * x[b])
        norms = F.sqrt(F.sum(x[a] * x[a])) * F.sqrt(F.sum(x[b] * x[b]))
        out += [dot.alias(f"{a}_{b}_dot"), F.try_divide(dot, F.nullif(norms, F.lit(0.0))).alias(f"{a}_{b}_cosine")]
    return df.groupBy(*keys).agg(*out)


def scoped_changes(df: DataFrame, checkpoint: str, operator: str, before: str, after: str, delta: str) -> DataFrame:
    """Each matrix counts in the scope `global` and in that of its operator: root-sum-square norms, guarded ratios and
    quartiles of the relative change."""
    norm = lambda c: F.sqrt(F.sum(F.col(c) * F.col(c)))
    ratio = F.col(delta) / F.nullif(F.col(before), F.lit(0))
    scoped = df.withColumn("scope", F.explode(F.array(F.lit("global"), F.concat(F.lit("operator/"), operator)))).withColumn("__ratio", ratio)
    g = with_quantiles(scoped, [checkpoint, "scope"], "__ratio", {"q1": 0.25, "q2": 0.5, "q3": 0.75}, F.count("*").alias("matrices"), norm(before).alias("before"), norm(after).alias("after"), norm(delta).alias("delta"))
    share = lambda n: F.coalesce(F.try_divide(n, F.nullif(F.col("before"), F.lit(0.0))), F.lit(0.0))
    return g.select(
        checkpoint, "scope", "matrices", "before", "after", "delta", share(F.col("after") - F.col("before")).alias("norm_change"), share(F.col("delta")).alias("relative_change"),
        F.col("q2").alias("median_change"), (F.col("q3") - F.col("q1")).alias("iqr_change"),
    )


def summed_products(df: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """(key, i, j, total): the sum over all rows of left[i] * right[j]. A task adds up before it sends; it holds one such
    sum for each of its keys."""

    def add(frames):
        held: dict = {}
        for f in frames:
            for k, rows in f.groupby(key):
                a, b = (np.stack(rows[c].to_numpy()).astype(float) for c in (left, right))
                if not (np.isfinite(a).all() and np.isfinite(b).all()):
                    raise ValueError("not finite")
                held[k] = held.get(k, 0.0) + a.T @ b
        for k, m in held.items():
            i, j = np.indices(m.shape)
            yield pd.DataFrame({key: k, "i": i.ravel(), "j": j.ravel(), "total": m.ravel()})

    kind = dict(df.dtypes)[key]
    sums = df.filter(F.col(key).isNotNull()).select(key, F.col(left).alias(left), *([right] if right != left else [])).mapInPandas(add, f"{key} {kind}, i int, j int, total double")
    return sums.groupBy(key, "i", "j").agg(F.sum("total").alias("total"))


def _square(group: pd.DataFrame) -> np.ndarray:
    m = np.zeros((group["i"].max() + 1, group["j"].max() + 1))
    m[group["i"], group["j"]] = group["total"]
    return m


#: What `described` says of a spectrum; s95 is the singular value that 95 % don't exceed.
SPECTRUM = """rank_99 int, rank_99_censored boolean, spectral_norm double, stable_rank double, entropy double, captured_share double,
regularized_s95_to_s5 double, singular_value_log_spread double, orthogonality_error double, residual double, method string"""


def described(values: np.ndarray, energy: float, method: str, fourth: float | None = None, dimension: int = 0, residual: float | None = None, eps: float = 1e-6) -> dict:
    """Of squared singular values, all or the largest: the rank that holds 99 % of the energy (one more than there are values, and
    censored, if they don't), spectral norm, stable rank, entropy (what isn't captured counts as one part), the share that
    is captured, how far the values spread, and how far the matrix is from orthogonal, given the sum of fourth powers."""
    held = np.sort(np.maximum(values, 0.0))[::-1]
    total, sums = max(energy, 0.0), np.cumsum(held)
    singular = np.sqrt(held)
    top = float(singular[0]) if len(held) else 0.0
    reached = np.flatnonzero(sums >= 0.99 * total * (1 - 1e-12)) if total > 0 else np.array([])
    shares = np.append(held, max(total - float(held.sum()), 0.0)) / total if total > 0 else np.array([])
    shares = shares[shares > 1e-15]
    s5, s95 = np.quantile(singular, [0.05, 0.95]) if len(held) else (0.0, 0.0)
    off = None if fourth is None else (max(fourth - 2 * total + dimension, 0.0) / max(dimension, 1)) ** 0.5
    return {
        "rank_99": 0 if total == 0 else int(reached[0]) + 1 if len(reached) else len(held) + 1, "rank_99_censored": bool(total > 0 and not len(reached)),
        "spectral_norm": top, "stable_rank": total / top**2 if top else None, "entropy": float(-(shares * np.log(shares)).sum()), "captured_share": min(1.0, float(held.sum()) / total) if total else None,
        "regularized_s95_to_s5": float(s95 / max(s5, eps * s95)) if s95 else None, "singular_value_log_spread": float(np.log(top / max(float(singular[-1]), eps * top))) if top else None,
        "orthogonality_error": off, "residual": residual, "method": method,
    }


def products_with(df: DataFrame, key: str, row: str, blocks: dict) -> dict:
    """For each matrix A, given as rows, A'A times its block of columns. A task adds up before it sends, a row for each column of A, and
    what comes to the driver is as large as the blocks."""
    sent = df.sparkSession.sparkContext.broadcast(blocks)
    width = next(iter(blocks.values())).shape[1] if blocks else 0

    def add(frames):
        held: dict = {}
        for f in frames:
            for k, rows in f.groupby(key):
                for at in range(0, len(rows), 1024):
                    a = np.stack(rows[row].iloc[at : at + 1024].to_numpy()).astype(float)
                    held[k] = held.get(k, 0.0) + a.T @ (a @ sent.value[k])
        for k, m in held.items():
            yield pd.DataFrame({key: k, "i": np.arange(len(m)), "v": list(m)})

    kind = dict(df.dtypes)[key]
    sums = df.select(key, row).mapInPandas(add, f"{key} {kind}, i int, v array<double>").groupBy(key, "i").agg(*[F.sum(F.col("v")[j]).alias(f"c{j}") for j in range(width)])
    out = {k: np.zeros_like(b) for k, b in blocks.items()}
    got = sums.toPandas()
    for k, rows in got.groupby(key):
        out[k][rows["i"].to_numpy()] = rows[[f"c{j}" for j in range(width)]].to_numpy()
    sent.unpersist()
    return out


def leading_spectra(df: DataFrame, key: str, row: str, shapes: dict, rank: int, seed: int, rounds: int = 8, within: float = 1e-6, probes: int = 8) -> dict:
    """By matrix the leading squared singular values, their largest residual beside the first, and an estimate of the sum of the fourth powers of all.

    Block subspace iteration: a block of `rank` columns is multiplied by A'A once a round, until all residuals are under `within` or
    `rounds` are over. One more product with `probes` random signs estimates the fourth powers."""
    rng, found = np.random.default_rng(seed), {}
    blocks = {k: np.linalg.qr(rng.choice([-1.0, 1.0], size=(n, max(1, min(rank, m, n)))))[0] for k, (m, n) in shapes.items()}
    width = max((b.shape[1] for b in blocks.values()), default=0)
    pad = lambda b: np.hstack([b, np.zeros((len(b), width - b.shape[1]))])
    left = dict(blocks)
    for _ in range(rounds):
        images = products_with(df.filter(F.col(key).isin(*left)), key, row, {k: pad(b) for k, b in left.items()})
        for k in list(left):
            b, image = left[k], images[k][:, : left[k].shape[1]]
            values, turn = np.linalg.eigh(b.T @ image)
            off = np.linalg.norm(image @ turn - b @ turn * values, axis=0).max() / max(values.max(), 1e-300)
            found[k] = (values, float(off))
            left[k] = np.linalg.qr(image)[0]
            if off <= within:
                del left[k]
        if not left:
            break
    signs = {k: rng.choice([-1.0, 1.0], size=(n, probes)) for k, (_, n) in shapes.items()}
    fourth = products_with(df, key, row, signs)
    return {k: (*found[k], float((fourth[k] ** 2).sum() / probes)) for k in shapes}


def matrix_diagnostics(df: DataFrame, key: str, row: str, method: str = "exact", rank: int = 32, seed: int = 0) -> DataFrame:
    """Of matrices given as rows: variation of row and column norms, and the spectrum as `described` says.

    "exact" decomposes the square of the columns, which one task holds for each matrix; "blocks" finds the `rank` leading values by
    `leading_spectra`, for any width of which `rank` columns fit on the driver; "sketch" projects rows on `rank` random
    signs, in one job. Rows without a key or with values that aren't finite are left out or an error."""
    known = df.filter(F.col(key).isNotNull()).select(key, F.transform(row, finite).alias(row))
    kind = dict(df.dtypes)[key]
    energy = F.aggregate(row, F.lit(0.0), lambda s, v: s + v * v)
    norms = known.groupBy(key).agg(F.count("*").alias("rows"), F.max(F.size(row)).alias("columns"), coefficient_of_variation(F.sqrt(energy)).alias("row_norm_cv"), F.sum(energy).alias("__energy"))
    across = known.select(key, F.posexplode(row).alias("c", "v")).groupBy(key, "c").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("n"))
    norms = norms.join(across.groupBy(key).agg(coefficient_of_variation("n").alias("column_norm_cv")), key)
    fields = ["__energy", "rows", "columns"]

    if method == "exact":

        def decompose(group: pd.DataFrame) -> pd.DataFrame:
            m, rows, columns = _square(group), int(group["rows"].iloc[0]), int(group["columns"].iloc[0])
            values = np.sort(np.linalg.eigvalsh(m))[::-1][: min(rows, columns)]
            return pd.DataFrame([{key: group[key].iloc[0]} | described(values, float(np.trace(m)), "exact", float((m**2).sum()), min(rows, columns), 0.0)])

        found = summed_products(known, key, row, row).join(norms.select(key, *fields), key).groupBy(key).applyInPandas(decompose, f"{key} {kind}, {SPECTRUM}")
    elif method == "blocks":
        sizes = {r[key]: r for r in norms.select(key, *fields).collect()}  # one row a matrix
        spectra = leading_spectra(known, key, row, {k: (r["rows"], r["columns"]) for k, r in sizes.items()}, rank, seed)
        rows = [{key: k} | described(values, sizes[k]["__energy"], "blocks", fourth, min(sizes[k]["rows"], sizes[k]["columns"]), off) for k, (values, off, fourth) in spectra.items()]
        names = [c.split()[0] for c in SPECTRUM.split(",")]
        found = df.sparkSession.createDataFrame([tuple(r[c] for c in [key, *names]) for r in rows], f"{key} {kind}, {SPECTRUM}")
    else:
        wide = known.select(F.max(F.size(row)).alias("n")).first()["n"] or 0

        @F.pandas_udf("array<double>")
        def projected(rows: pd.Series) -> pd.Series:
            signs = np.random.default_rng(seed).choice([-1.0, 1.0], size=(wide, rank))
            return pd.Series([np.asarray(r, dtype=float) @ signs[: len(r)] for r in rows])

        both = known.select(key, row, projected(row).alias("__p")).withColumn("__row", F.concat(F.col("__p"), F.col(row)))

        def sketch(group: pd.DataFrame) -> pd.DataFrame:
            m = _square(group)
            gram, cross = m[:, :rank], m[:, rank:]  # S'S and S'A, of which Q'A = R^-T S'A for S = QR
            w, v = np.linalg.eigh(gram)
            keep = w > max(w.max(), 0.0) * 1e-12
            part = (v[:, keep] / np.sqrt(w[keep])).T @ cross
            return pd.DataFrame([{key: group[key].iloc[0]} | described(np.linalg.svd(part, compute_uv=False) ** 2, float(group["__energy"].iloc[0]), "sketch")])

        found = summed_products(both, key, "__p", "__row").join(norms.select(key, *fields), key).groupBy(key).applyInPandas(sketch, f"{key} {kind}, {SPECTRUM}")
    return norms.drop("__energy").join(found, key)


def principal_angles(df: DataFrame, key: str, reference: str, trained: str) -> DataFrame:
    """Angles in degrees between the spaces that two sets of columns span, given row by row; columns needn't be orthonormal, and those
    that depend on others count for nothing. Tasks send sums of products of all columns; a space of no dimension gives nulls."""
    kind = dict(df.dtypes)[key]
    both = df.select(key, F.size(reference).alias("__n"), F.concat(reference, trained).alias("__row"))
    widths = both.groupBy(key).agg(F.max("__n").alias("__n"))

    def root(m: np.ndarray) -> np.ndarray:
        """Turns columns with products `m` into orthonormal ones."""
        w, v = np.linalg.eigh(m)
        keep = w > max(w.max(initial=0.0), 0.0) * 1e-12
        return v[:, keep] / np.sqrt(w[keep])

    def angles(group: pd.DataFrame) -> pd.DataFrame:
        m, n = _square(group), int(group["__n"].iloc[0])
        cosines = np.linalg.svd(root(m[:n, :n]).T @ m[:n, n:] @ root(m[n:, n:]), compute_uv=False)
        a = np.degrees(np.arccos(np.clip(cosines, 0.0, 1.0)))
        sin = np.sin(np.radians(a))
        told = (a.mean(), np.median(a), np.quantile(a, 0.95), a.max(), (sin**2).mean() ** 0.5) if len(a) else (None,) * 5
        return pd.DataFrame([(group[key].iloc[0], *told)], columns=[key, "mean_deg", "median_deg", "p95_deg", "max_deg", "rms_sin"])

    sums = summed_products(both, key, "__row", "__row").join(widths, key)
    return sums.groupBy(key).applyInPandas(angles, f"{key} {kind}, mean_deg double, median_deg double, p95_deg double, max_deg double, rms_sin double")
