"""Risk, regression and resampling operators on aligned returns (slug, month, r_p, r_b, y, y_b, factors, rf)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.kept import kept

MODELS = {"CAPM": ["mkt_rf"], "FF3": ["mkt_rf", "smb", "hml"], "Carhart4": ["mkt_rf", "smb", "hml", "mom"], "FF5": ["mkt_rf", "smb", "hml", "rmw", "cma"]}
PER_YEAR = 12
Z05, Z95 = -1.6448536269514722, 1.959963984540054


# ---- small numerics of a group


def normal_p(t: float) -> float:
    return math.erfc(abs(t) / math.sqrt(2))


def student_p(t: float, df: int) -> float:
    """Two-sided tail of Student's t by the continued fraction of the incomplete beta function."""
    x, a, b = df / (df + t * t), df / 2, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(max(x, 1e-300)) + b * math.log(max(1 - x, 1e-300)))
    if x > (a + 1) / (a + b + 2):
        return 1 - front * _fraction(1 - x, b, a) / b
    return front * _fraction(x, a, b) / a


def _fraction(x: float, a: float, b: float) -> float:
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or 1e-300)
            c = 1 + num / c or 1e-300
            h *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return h


def ols(x: np.ndarray, y: np.ndarray, lag: int | None = None):
    """Coefficients, their standard errors (Newey-West with Bartlett weights where lag is given), residuals."""
    inv = np.linalg.pinv(x.T @ x)
    beta = inv @ (x.T @ y)
    u = y - x @ beta
    if lag is None:
        cov = inv * float(u @ u) / max(len(y) - x.shape[1], 1)
    else:
        g = x * u[:, None]
        s = g.T @ g
        for k in range(1, lag + 1):
            w = (1 - k / (lag + 1)) * (g[k:].T @ g[:-k])
            s += w + w.T
        cov = inv @ s @ inv
    return beta, np.sqrt(np.maximum(np.diag(cov), 0)), u, cov


def hac_lag(n: int) -> int:
    return int(0.75 * n ** (1 / 3))


def _values(*x) -> list[float | None]:
    return [None if v is None or not math.isfinite(v) else float(v) for v in x]


# ---- statistics by group


def risk_metrics(aligned: DataFrame, *key: str, per_year: int = PER_YEAR) -> DataFrame:
    """The measures of each key's returns against its benchmark, a column each; one aggregation, one window for drawdown."""
    c = F.col
    n, years = F.count("*"), F.count("*") / F.lit(float(per_year))
    act, root = c("r_p") - c("r_b"), float(np.sqrt(per_year))
    ann = lambda r: F.when(F.product(1 + r) > 0, F.pow(F.product(1 + r), 1 / years) - 1)
    sharpe = lambda y: F.try_divide(F.avg(y), F.stddev_samp(y)) * root
    down = lambda y: F.sqrt(F.avg(F.pow(F.least(y, F.lit(0.0)), F.lit(2))))

    def capture(on):
        k = F.count_if(on)
        g = lambda r: F.when(k > 0, F.pow(F.product(F.when(on, 1 + r).otherwise(1.0)), 1 / k.cast("double")) - 1)
        return F.try_divide(g(c("r_p")), g(c("r_b")))

    base = aligned.where("r_p is not null and r_b is not null and rf is not null").groupBy(*key).agg(
        n.alias("periods"), ann(c("r_p")).alias("ann_p"), ann(c("r_b")).alias("ann_b"), (F.stddev_samp("r_p") * root).alias("vol_p"), (F.stddev_samp("r_b") * root).alias("vol_b"),
        sharpe(c("y")).alias("sharpe_p"), sharpe(c("y_b")).alias("sharpe_b"), F.try_divide(F.avg("y"), down(c("y"))).alias("s_p"), F.try_divide(F.avg("y_b"), down(c("y_b"))).alias("s_b"),
        (F.stddev_samp(act) * root).alias("tracking_error"), (F.try_divide(F.avg(act), F.stddev_samp(act)) * root).alias("information_ratio"),
        F.try_divide(F.covar_samp("y", "y_b"), F.var_samp("y_b")).alias("beta"), F.corr("r_p", "r_b").alias("correlation"), capture(c("r_b") > 0).alias("up_capture"), capture(c("r_b") <= 0).alias("down_capture"),
        (F.var_samp("r_p") * per_year).alias("variance_p"), (F.var_samp("r_b") * per_year).alias("variance_b"), F.min("r_p").alias("worst_p"), F.min("r_b").alias("worst_b"),
    )
    base = base.withColumns({"sortino_p": c("s_p") * root, "sortino_b": c("s_b") * root}).drop("s_p", "s_b")
    dd = drawdowns(aligned, "r_p", *key).groupBy(*key).agg(F.min("drawdown").alias("max_drawdown_p"))
    db = drawdowns(aligned, "r_b", *key).groupBy(*key).agg(F.min("drawdown").alias("max_drawdown_b"))
    out = base.join(dd, list(key)).join(db, list(key))
    return out.withColumns({f"calmar_{s}": F.when(c(f"max_drawdown_{s}") < 0, c(f"ann_{s}") / F.abs(c(f"max_drawdown_{s}"))) for s in "pb"})


def drawdowns(series: DataFrame, value: str, *key: str) -> DataFrame:
    """Index and fall from its highest so far, by month."""
    up = Window.partitionBy(*key).orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    index = F.exp(F.sum(F.log1p(F.greatest(F.coalesce(value, F.lit(0.0)), F.lit(-0.9999)))).over(up))
    return series.withColumn("index", index).withColumn("peak", F.max("index").over(up)).withColumn("drawdown", F.col("index") / F.col("peak") - 1)


def drawdown_episode(series: DataFrame, value: str, *key: str) -> DataFrame:
    """Depth, peak, trough and recovery of each key's deepest fall."""
    d = drawdowns(series, value, *key)
    low = d.groupBy(*key).agg(F.min_by(F.struct("month", "drawdown", "peak"), F.struct("drawdown", "month")).alias("x")).select(*key, F.col("x.month").alias("trough"), F.col("x.drawdown").alias("depth"), F.col("x.peak").alias("high"))
    both = d.join(low, list(key))
    return both.groupBy(*key, "trough", "depth").agg(
        F.max(F.when((F.col("month") <= F.col("trough")) & (F.col("drawdown") == 0), F.col("month"))).alias("peak"),
        F.min(F.when((F.col("month") > F.col("trough")) & (F.col("index") >= F.col("high")), F.col("month"))).alias("recovery"),
    )


def tail_risk(aligned: DataFrame, *key: str, q: float = 0.05) -> DataFrame:
    """Historical and parametric value at risk and expected shortfall, of three values or more."""
    cut = aligned.groupBy(*key).agg(F.count("r_p").alias("n"), F.percentile("r_p", F.lit(q)).alias("var_hist"), (F.avg("r_p") + Z05 * F.stddev_samp("r_p")).alias("var_param"))
    tail = aligned.join(cut.select(*key, "var_hist"), list(key)).groupBy(*key).agg(F.avg(F.when(F.col("r_p") <= F.col("var_hist"), F.col("r_p"))).alias("shortfall"))
    out = cut.join(tail, list(key))
    return out.select(*key, "n", *[F.when(F.col("n") >= 3, F.col(x)).alias(x) for x in ("var_hist", "var_param", "shortfall")])


def risk_by_year(aligned: DataFrame, *key: str, trailing: int = 36) -> DataFrame:
    """Each calendar year's return and risk, and the deviation over the trailing months at its end."""
    back = Window.partitionBy(*key).orderBy("month").rowsBetween(-trailing + 1, 0)
    rows = aligned.withColumn("year", F.year("month")).withColumn("n_back", F.count("r_p").over(back)).withColumn("sd_back", F.stddev_samp("r_p").over(back)).withColumn("var_back", F.percentile("r_p", F.lit(0.05)).over(back))
    last = lambda c: F.max_by(F.when(F.col("n_back") >= max(3, trailing // 2), F.col(c)), "month")
    many = lambda c: F.when(F.count("*") >= 3, c)
    return rows.groupBy(*key, "year").agg(
        F.count("*").alias("n"), (F.product(1 + F.col("r_p")) - 1).alias("return_p"), (F.product(1 + F.col("r_b")) - 1).alias("return_b"), many(F.stddev_samp("r_p") * math.sqrt(12)).alias("vol_p"),
        many(F.percentile("r_p", F.lit(0.05))).alias("var95_p"), many(F.min("r_p")).alias("worst_p"), (last("sd_back") * math.sqrt(12)).alias("trailing_vol_p"), last("var_back").alias("trailing_var95_p"),
    )


def risk_return_points(aligned: DataFrame) -> DataFrame:
    """Annualised return and volatility of every manager, its benchmark and the risk-free rate."""
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("r")) for k, c in (("account", "r_p"), ("benchmark", "r_b"), ("rf", "rf"))]))
    long = aligned.select("slug", kinds.alias("x")).select("slug", "x.kind", "x.r")
    total = F.product(1 + F.col("r"))
    return long.groupBy("slug", "kind").agg(F.count("*").alias("n"), F.when(total > 0, F.pow(total, 12.0 / F.count("*")) - 1).alias("ret"), (F.stddev_samp("r") * math.sqrt(12)).alias("vol")).where("n >= 3")


def rolling_excess(aligned: DataFrame, months: int) -> DataFrame:
    """Compounded excess over the benchmark in a full window."""
    back = Window.partitionBy("slug").orderBy("month").rowsBetween(-months + 1, 0)
    g = lambda c: F.product(1 + F.col(c)).over(back)
    return aligned.withColumn("n", F.count("*").over(back)).withColumn("excess", g("r_p") - g("r_b")).where(F.col("n") == months).select("slug", "month", "excess")


def rolling_capm(aligned: DataFrame, months: int) -> DataFrame:
    """Alpha, beta, t and interval over a full window, in closed form."""
    w = Window.partitionBy("slug").orderBy("month").rowsBetween(-months + 1, 0)
    s = lambda f: f("y", "y_b").over(w)
    rows = aligned.select("slug", "month", F.count("*").over(w).alias("n"), s(F.regr_slope).alias("beta"), s(F.regr_intercept).alias("alpha"), s(F.regr_sxx).alias("sxx"), s(F.regr_syy).alias("syy"), F.avg("y_b").over(w).alias("mx")).where(F.col("n") == months)
    rss = F.greatest(F.col("syy") - F.col("beta") * F.col("beta") * F.col("sxx"), F.lit(0.0))
    se = F.sqrt(rss / (months - 2) * (1 / F.lit(float(months)) + F.col("mx") * F.col("mx") / F.col("sxx")))
    return rows.withColumn("se", se).select("slug", "month", "alpha", "beta", F.try_divide("alpha", "se").alias("t"), (F.col("alpha") - Z95 * F.col("se")).alias("low"), (F.col("alpha") + Z95 * F.col("se")).alias("high"))


REGRESSION = "model string, n int, alpha double, se double, t double, p double, r2 double, adj_r2 double, resid_sd double, betas array<double>"


def factor_regressions(aligned: DataFrame, models: dict[str, list[str]] | None = None, grid: str = "M") -> DataFrame:
    """Every model for every manager; Newey-West errors and normal tails on months, plain ones and Student's on years.

    A manager's rows are months of one record: a group of bounded size.
    """
    models = models or MODELS

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, out = pdf.sort_values("month"), []
        y = pdf["y"].to_numpy(float)
        for name, factors in models.items():
            x = np.column_stack([np.ones(len(pdf)), pdf[factors].to_numpy(float)])
            n, k = x.shape
            if n <= k + 1:
                continue
            beta, se, u, _ = ols(x, y, hac_lag(n) if grid == "M" else None)
            rss, tss = float(u @ u), float(((y - y.mean()) ** 2).sum())
            t = beta[0] / se[0] if se[0] > 0 else math.nan
            r2 = 1 - rss / tss if tss > 0 else math.nan
            p = math.nan if math.isnan(t) else normal_p(t) if grid == "M" else student_p(t, n - k)
            out.append((int(pdf["slug"].iloc[0]), name, n, *_values(beta[0], se[0], t, p, r2, 1 - (1 - r2) * (n - 1) / (n - k), math.sqrt(rss / (n - k))), beta[1:].tolist()))
        return pd.DataFrame(out, columns=["slug", "model", "n", "alpha", "se", "t", "p", "r2", "adj_r2", "resid_sd", "betas"])

    return aligned.groupBy("slug").applyInPandas(run, f"slug long, {REGRESSION}")


def capm(aligned: DataFrame) -> DataFrame:
    """Beta, alpha and fit of each manager in closed form, and the mean return as rate, market share and rest."""
    rows = aligned.groupBy("slug").agg(F.count("*").alias("n"), F.regr_slope("y", "y_b").alias("beta"), F.regr_intercept("y", "y_b").alias("alpha"), F.regr_r2("y", "y_b").alias("r2"), F.avg("rf").alias("rf"), F.avg("y_b").alias("mkt"), F.avg("r_p").alias("mean"))
    return rows.withColumn("from_market", F.col("beta") * F.col("mkt")).withColumn("rest", F.col("mean") - F.col("rf") - F.col("from_market"))


def timing_tests(aligned: DataFrame) -> DataFrame:
    """Treynor-Mazuy (market squared) and Henriksson-Merton (market above nothing) terms with Newey-West t."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, out = pdf.sort_values("month"), []
        y, m = pdf["y"].to_numpy(float), pdf["mkt_rf"].to_numpy(float)
        for name, z in (("treynor_mazuy", m * m), ("henriksson_merton", np.maximum(m, 0))):
            if len(y) > 4:
                beta, se, *_ = ols(np.column_stack([np.ones(len(y)), m, z]), y, hac_lag(len(y)))
                out.append((int(pdf["slug"].iloc[0]), name, len(y), *_values(beta[2], beta[2] / se[2] if se[2] > 0 else math.nan)))
        return pd.DataFrame(out, columns=["slug", "test", "n", "gamma", "t"])

    return aligned.groupBy("slug").applyInPandas(run, "slug long, test string, n int, gamma double, t double")


def subperiods(aligned: DataFrame, split: str) -> DataFrame:
    """FF3 alpha before and after a date, and its change tested by interaction; half-sample alphas with lag 3."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("month")
        x = np.column_stack([np.ones(len(pdf)), pdf[MODELS["FF3"]].to_numpy(float)])
        y, late = pdf["y"].to_numpy(float), (pd.to_datetime(pdf["month"]) >= pd.Timestamp(split)).to_numpy(float)
        row = [None] * 5
        if late.sum() > 5 and len(y) - late.sum() > 5:
            beta, se, *_ = ols(np.column_stack([x, x * late[:, None]]), y, hac_lag(len(y)))
            row = _values(beta[0], beta[0] + beta[4], beta[4], se[4], beta[4] / se[4] if se[4] > 0 else math.nan)
        half = len(y) // 2
        halves = [_values(*(lambda r: (r[0][0], r[0][0] / r[1][0] if r[1][0] > 0 else math.nan))(ols(x[s], y[s], 3))) if half > 5 else [None, None] for s in (slice(0, half), slice(half, None))]
        return pd.DataFrame([(int(pdf["slug"].iloc[0]), *row, *halves[0], *halves[1])], columns=["slug", "before", "after", "change", "se", "t", "alpha1", "t1", "alpha2", "t2"])

    return aligned.groupBy("slug").applyInPandas(run, "slug long, before double, after double, change double, se double, t double, alpha1 double, t1 double, alpha2 double, t2 double")


def rolling_ff3(aligned: DataFrame, months: int = 36, drift: float = 0.30) -> DataFrame:
    """Alpha t over each trailing window, loadings, and whether a loading has moved since the window before it."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("month").reset_index(drop=True)
        x = np.column_stack([np.ones(len(pdf)), pdf[MODELS["FF3"]].to_numpy(float)])
        y, out, loads = pdf["y"].to_numpy(float), [], {}
        for e in range(months, len(pdf) + 1):
            beta, se, *_ = ols(x[e - months : e], y[e - months : e])
            loads[e] = beta[1:]
            moved = e - months in loads and bool(np.abs(beta[1:] - loads[e - months]).max() >= drift)
            out.append((int(pdf["slug"].iloc[0]), pdf["month"][e - 1], *_values(beta[0] / se[0] if se[0] > 0 else math.nan, *beta[1:]), moved))
        return pd.DataFrame(out, columns=["slug", "month", "t_alpha", "b_mkt", "b_smb", "b_hml", "drift"])

    return aligned.groupBy("slug").applyInPandas(run, "slug long, month date, t_alpha double, b_mkt double, b_smb double, b_hml double, drift boolean")


def residuals(aligned: DataFrame, least: int = 60) -> DataFrame:
    """FF3 residuals of every manager with enough months: (slug, month, u, alpha)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("month")
        x = np.column_stack([np.ones(len(pdf)), pdf[MODELS["FF3"]].to_numpy(float)])
        beta, se, u, _ = ols(x, pdf["y"].to_numpy(float), hac_lag(len(pdf)))
        return pd.DataFrame({"slug": pdf["slug"], "month": pdf["month"], "u": u, "alpha": beta[0], "se": se[0]})

    long = aligned.withColumn("n", F.count("*").over(Window.partitionBy("slug"))).where(F.col("n") >= least)
    return long.groupBy("slug").applyInPandas(run, "slug long, month date, u double, alpha double, se double")


#: Managers of a block of pairs at most, about; blocks where fewer would do, so that tasks are enough; partitions that block pairs are dealt into at most; pairs of a batch.
PAIR_BLOCK, PAIR_BLOCKS, PAIR_PARTS, PAIR_ROWS = 8000, 12, 4096, 400_000


def pair_blocks(records: int) -> int:
    """Blocks for so many records: each record is dealt once for each block, so they are few and large."""
    return max(1, math.ceil(records / PAIR_BLOCK), min(PAIR_BLOCKS, math.ceil(records / 1000)))


def record_pairs(series: DataFrame, value: str, least: int = 1, diagonal: bool = False, block: int | None = None, wanted: tuple[str, ...] = ("n", "covar", "corr"), both_orders: bool = False) -> DataFrame:
    """(a, b, n, covar, corr) of each two managers a < b with so many common months; diagonal: of each with itself, too.

    Managers are dealt into blocks by a hash, and each two blocks meet in a task, where sums over common months are
    products of matrices: only results leave it, and no row of a pair and month is ever made. Records are worked out
    once and kept; what is dealt is a record for each block. n counts common months; covar and corr are over those where
    both have a value (a NaN is none), null where they aren't defined. A manager has one row for a month. Only the
    wanted figures are worked out; both_orders: (b, a), too.
    """
    own = F.sort_array(F.collect_list(F.struct("month", F.col(value).cast("double").alias("v"))))  # a record is bounded by the calendar
    made = series.where("slug is not null and month is not null").groupBy("slug").agg(own.alias("m"))
    records = kept(made.select("slug", F.transform("m.month", F.unix_date).alias("at"), F.col("m.v").alias("v")))
    count = records.count()
    blocks = max(1, math.ceil(count / block)) if block else pair_blocks(count)
    dealt = records.withColumn("block", F.pmod(F.xxhash64("slug", F.lit(5)), F.lit(blocks)).cast("int"))
    keyed = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(F.least("block", "with").alias("lo"), F.greatest("block", "with").alias("hi"), "block", "slug", "at", "v")
    dtype = series.schema["slug"].dataType.simpleString()
    moments = "covar" in wanted or "corr" in wanted

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(pdfs), ignore_index=True).sort_values("slug", ignore_index=True)  # two blocks
        lo, same = pdf["lo"].iloc[0], pdf["lo"].iloc[0] == pdf["hi"].iloc[0]
        days = np.unique(np.concatenate(pdf["at"].to_list()))
        there, x = np.zeros((len(pdf), len(days))), np.full((len(pdf), len(days)), np.nan)
        row = np.repeat(np.arange(len(pdf)), pdf["at"].map(len))
        at = np.searchsorted(days, np.concatenate(pdf["at"].to_list()))
        there[row, at], x[row, at] = 1.0, np.concatenate(pdf["v"].to_list()).astype(float)
        ok = np.isfinite(x) | np.isinf(x)
        mid = np.array([np.median(r[k]) if k.any() else 0.0 for r, k in zip(x, ok, strict=True)])
        x, ok, names = np.where(ok, x - mid[:, None], 0.0), ok.astype(float), pdf["slug"].to_numpy()
        left = np.flatnonzero(pdf["block"] == lo)
        right = left if same else np.flatnonzero(pdf["block"] != lo)
        full = bool((ok == there).all())  # a value in each of a record's months
        zn, zok, z, zz = (np.ascontiguousarray(m[right].T) for m in (there, ok, x, x**2))
        step = max(1, PAIR_ROWS // max(1, len(right)))
        with np.errstate(divide="ignore", invalid="ignore"):
            for i in (left[k : k + step] for k in range(0, len(left), step)):
                n = there[i] @ zn
                use = n >= least
                if same:
                    use &= (i[:, None] <= right) if diagonal else (i[:, None] < right)
                p, q = np.nonzero(use)
                out = {"a": names[i[p]], "b": names[right[q]]}
                if moments:
                    both = n if full else ok[i] @ zok
                    sx, sz, sxz = x[i] @ zok, ok[i] @ z, x[i] @ z
                    cross = sxz - sx * sz / both
                if "n" in wanted:
                    out["n"] = n[p, q].astype(np.int64)
                if "covar" in wanted:
                    out["covar"] = np.where(both > 1, cross / (both - 1), np.nan)[p, q]
                if "corr" in wanted:
                    sxx, szz = (x[i] ** 2) @ zok, ok[i] @ zz
                    vx, vz = sxx - sx * sx / both, szz - sz * sz / both
                    corr = cross / np.sqrt(np.maximum(vx, 0) * np.maximum(vz, 0))
                    for j, k in np.argwhere(use & (both > 1) & ((vx <= 1e-12 * sxx) | (vz <= 1e-12 * szz))):  # all but constant over the common months
                        m = (ok[i[j]] > 0) & (ok[right[k]] > 0)
                        a, b = x[i[j], m], x[right[k], m]
                        corr[j, k] = math.nan if np.ptp(a) == 0 or np.ptp(b) == 0 else np.corrcoef(a, b)[0, 1]
                    corr = corr[p, q]
                    out["corr"] = np.where(np.isfinite(corr), corr, np.nan)
                yield pd.DataFrame(out)
                if both_orders:
                    other = i[p] != right[q]
                    yield pd.DataFrame({c: out[{"a": "b", "b": "a"}.get(c, c)][other] for c in out})

    parts = min(PAIR_PARTS, 8 * (blocks * (blocks + 1) // 2))  # so many that two large groups seldom share one
    types = {"a": dtype, "b": dtype, "n": "long", "covar": "double", "corr": "double"}
    columns = ["a", "b", *[c for c in ("n", "covar", "corr") if c in wanted]]
    pairs = keyed.repartition(parts, "lo", "hi").groupBy("lo", "hi").applyInPandas(run, ", ".join(f"{c} {types[c]}" for c in columns))
    return pairs if both_orders else pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), *columns[2:])


def pair_correlations(series: DataFrame, value: str = "u", least: int = 24, shrink: float = 0.5) -> DataFrame:
    """Correlation of each pair of managers over their common months, shrunk by half."""
    return record_pairs(series, value, least, wanted=("n", "corr")).select("a", "b", "n", "corr", (F.col("corr") * (1 - shrink)).alias("shrunk"))


def shrink_alphas(alphas: DataFrame, tau: float | None = None) -> DataFrame:
    """Alphas pulled to their mean; the spread of true alphas is tau, or what is left of the spread after the errors'."""
    total = alphas.agg(F.avg("alpha").alias("mu"), F.greatest(F.var_samp("alpha") - F.avg(F.col("se") * F.col("se")), F.lit(0.0)).alias("tau2"))
    if tau is not None:
        total = total.withColumn("tau2", F.lit(tau * tau))
    both = alphas.crossJoin(F.broadcast(total))  # one row
    return both.withColumn("shrunk", F.col("mu") + F.try_divide(F.col("tau2"), F.col("tau2") + F.col("se") * F.col("se")) * (F.col("alpha") - F.col("mu")))


def hac_mean(series: DataFrame, value: str, lag: int = 3) -> DataFrame:
    """Mean of a date series and its Newey-West t, from lag products; the rows are dates."""
    w = Window.orderBy("month")
    mean = series.agg(F.avg(value).alias("m"), F.count(value).alias("n"))
    u = series.where(F.col(value).isNotNull()).crossJoin(F.broadcast(mean)).select("month", "m", "n", (F.col(value) - F.col("m")).alias("u"))
    lagged = u.select("m", "n", "u", *[F.lag("u", k).over(w).alias(f"l{k}") for k in range(1, lag + 1)])
    s = F.sum(F.col("u") * F.col("u")) + sum((2 * (1 - k / (lag + 1)) * F.coalesce(F.sum(F.col("u") * F.col(f"l{k}")), F.lit(0.0)) for k in range(1, lag + 1)), F.lit(0.0))
    return lagged.groupBy("m", "n").agg(s.alias("s")).select(F.col("m").alias("mean"), "n", F.try_divide(F.col("m"), F.sqrt("s") / F.col("n")).alias("t"))


def average_rank(value: str, *key: str) -> Column:
    """Rank with ties at their mean."""
    return F.rank().over(Window.partitionBy(*key).orderBy(value)) + (F.count("*").over(Window.partitionBy(*key, value)) - 1) / 2


def information_coefficients(panel: DataFrame, signal: str, target: str, *key: str, least: int = 10) -> DataFrame:
    """Spearman correlation by date, ties at their mean rank."""
    ok = panel.where(F.col(signal).isNotNull() & F.col(target).isNotNull())
    ranked = ok.withColumn("rs", average_rank(signal, *key)).withColumn("rt", average_rank(target, *key))
    return ranked.groupBy(*key).agg(F.count("*").alias("n"), F.corr("rs", "rt").alias("ic")).where(F.col("n") >= least)


def ic_summary(ics: DataFrame, *key: str) -> DataFrame:
    return ics.groupBy(*key).agg(F.count("ic").alias("months"), F.avg("ic").alias("mean"), F.try_divide(F.avg("ic"), F.stddev_samp("ic") / F.sqrt(F.count("ic"))).alias("t"), F.avg((F.col("ic") > 0).cast("double")).alias("positive"))


def decile(rank: Column, n: Column, bins: int = 10) -> Column:
    """The tenth of a rank among n, as quantile cuts at equal steps give it."""
    return F.greatest(F.lit(1), F.ceil((rank - 1) * bins / (n - 1))).cast("int")


def decile_returns(panel: DataFrame, signal: str, target: str, bins: int = 10) -> DataFrame:
    """Mean target of each tenth by month; a month's ties stand by ticker."""
    ok = panel.where(F.col(signal).isNotNull() & F.col(target).isNotNull())
    own = Window.partitionBy("month")
    placed = ok.withColumn("n", F.count("*").over(own)).withColumn("k", F.row_number().over(own.orderBy(signal, "ticker"))).where("n > 10")
    return placed.groupBy("month", decile(F.col("k"), F.col("n"), bins).alias("decile")).agg(F.avg(target).alias("mean"), F.count("*").alias("n"))


def auc(scored: DataFrame, label: str, score: str, *key: str) -> DataFrame:
    """Area under the curve by the rank formula, exact with ties; null with one class."""
    rows = scored.where(F.col(label).isNotNull() & F.col(score).isNotNull()).withColumn("rk", average_rank(score, *key) if key else average_rank(score))
    pos, neg = F.sum(F.col(label).cast("double")), F.sum(1 - F.col(label).cast("double"))
    return rows.groupBy(*key).agg(F.count("*").alias("n"), F.try_divide(F.sum(F.col("rk") * F.col(label)) - pos * (pos + 1) / 2, pos * neg).alias("auc"))


def auc_pooled(scored: DataFrame, label: str, score: str, ranges: int = 256) -> DataFrame:
    """R24 over a whole table: exact with ties, and no task sees all rows.

    Numbers of both classes by distinct score first; then sums of what is below, by ranges of scores and within them.
    """
    rows = scored.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    by = rows.groupBy(F.col(score).cast("double").alias("s")).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.sum(1 - F.col(label).cast("long")).alias("neg"))
    edges = sorted(set(by.approxQuantile("s", [i / ranges for i in range(1, max(ranges, 2))], 0.001))) or [0.0]
    placed = Bucketizer(splits=[-math.inf, *edges, math.inf], inputCol="s", outputCol="range").transform(by)
    sums = placed.groupBy("range").agg(F.sum("neg").alias("own"))  # as many rows as ranges
    below = sums.select("range", F.coalesce(F.sum("own").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("below"))
    inner = F.coalesce(F.sum("neg").over(Window.partitionBy("range").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wins = placed.withColumn("inner", inner).join(F.broadcast(below), "range").select("pos", "neg", (F.col("pos") * (F.col("below") + F.col("inner") + F.col("neg") / 2)).alias("wins"))
    return wins.agg(F.coalesce(F.sum(F.col("pos") + F.col("neg")), F.lit(0)).alias("n"), F.try_divide(F.sum("wins"), F.sum("pos") * F.sum("neg")).alias("auc"))


def brier(scored: DataFrame, label: str, p: str) -> DataFrame:
    """Brier score and skill against the base rate."""
    rate = scored.agg(F.avg(F.col(label).cast("double")).alias("rate"))
    return scored.crossJoin(F.broadcast(rate)).agg(F.count("*").alias("n"), F.avg(F.pow(F.col(p) - F.col(label), F.lit(2))).alias("brier"), F.avg(F.pow(F.col("rate") - F.col(label), F.lit(2))).alias("base")).withColumn("skill", 1 - F.try_divide("brier", "base"))


def _resampled(aligned: DataFrame, work, fields: str, seed: int) -> DataFrame:
    """A row for each manager from work(y, y_b, rng) over the months of its record, in order.

    A record is bounded by the calendar, and so is what a task holds. The draws of a manager depend on its name and the
    seed alone.
    """
    months = aligned.groupBy("slug").agg(F.sort_array(F.collect_list(F.struct("month", "y", "y_b"))).alias("m"))
    records = months.select("slug", F.xxhash64(F.lit(seed), F.col("slug").cast("string")).alias("key"), F.col("m.y").alias("y"), F.col("m.y_b").alias("y_b"))
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches):
        for b in batches:
            out = [work(np.asarray(y, float), np.asarray(x, float), np.random.default_rng(key & (1 << 63) - 1)) for y, x, key in zip(b["y"], b["y_b"], b["key"], strict=True)]
            yield pd.concat([b["slug"].reset_index(drop=True), pd.DataFrame(out, columns=names)], axis=1)

    return records.mapInPandas(run, f"slug {aligned.schema['slug'].dataType.simpleString()}, {fields}")


def _alphas(y: np.ndarray, x: np.ndarray, less: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Intercept and its t of each row's regression of y on x; NaN where x doesn't vary or three months lack. The t is that of y - less."""
    n = y.shape[-1]
    xm, ym = x.mean(axis=-1, keepdims=True), y.mean(axis=-1, keepdims=True)
    sxx, sxy, syy = ((x - xm) ** 2).sum(axis=-1), ((x - xm) * (y - ym)).sum(axis=-1), ((y - ym) ** 2).sum(axis=-1)
    with np.errstate(divide="ignore", invalid="ignore"):
        alpha = ym[..., 0] - sxy / sxx * xm[..., 0]
        rss = np.maximum(syy - sxy**2 / sxx, 0)
        return alpha, (alpha - less) / np.sqrt(rss / (n - 2) * (1 / n + xm[..., 0] ** 2 / sxx)) if n > 2 else np.full(y.shape[:-1], np.nan)


def bootstrap(aligned: DataFrame, replicates: int = 1500, seed: int = 7) -> DataFrame:
    """For each manager the observed CAPM t of alpha, its place among resamples of a null without alpha, and a pairs interval.

    The null keeps the record without its alpha; months are drawn with replacement. The interval (alpha_low, alpha_high,
    95 %, by month) comes from the same draws of the months as they are.
    """

    def work(y, x, rng):
        alpha, seen = _alphas(y, x)
        i = rng.integers(0, len(y), (replicates, len(y)))
        pairs, t = _alphas(y[i], x[i], alpha)  # the record without its alpha differs in the intercept alone
        t, pairs = t[np.isfinite(t)], pairs[np.isfinite(pairs)]
        if not np.isfinite(seen) or not len(t):
            return None, len(y), None, None, None, None, None, None
        return (float(seen), len(y), float((t >= seen).mean()), float((np.abs(t) >= abs(seen)).mean()), *map(float, np.quantile(t, [0.025, 0.975])), *map(float, np.quantile(pairs, [0.025, 0.975])))

    fields = "t_observed double, n long, p_one_sided double, p_two_sided double, t_low double, t_high double, alpha_low double, alpha_high double"
    return _resampled(aligned, work, fields, seed)


def null_cohort(aligned: DataFrame, managers: int = 3000, seed: int = 9) -> DataFrame:
    """Where each record's mean excess falls among no-skill managers of the same beta and residuals."""

    def work(y, x, rng):
        alpha, _ = _alphas(y, x)
        if not np.isfinite(alpha):
            return float(y.mean()), None, None
        beta = float((y.mean() - alpha) / x.mean()) if abs(x.mean()) > 1e-12 else float(np.cov(x, y)[0, 1] / x.var(ddof=1))
        fair = beta * x
        luck = fair.mean() + (y - alpha - fair)[rng.integers(0, len(y), (managers, len(y)))].mean(axis=1)
        return float(y.mean()), float((luck < y.mean()).mean()), float(np.quantile(luck, 0.95))

    return _resampled(aligned, work, "actual double, percentile double, luck95 double", seed)


def skill(metrics: DataFrame, fits: DataFrame) -> DataFrame:
    """Sharpe, Treynor, M2, Jensen, appraisal ratio and t by manager, from A17's and R01's rows."""
    c = F.col
    one = fits.where("model = 'CAPM'").select("slug", c("alpha").alias("a1"), c("resid_sd").alias("s1"), F.element_at("betas", 1).alias("b1"))
    head = fits.where("model = 'FF3'").select("slug", c("alpha").alias("a3"), c("resid_sd").alias("s3"), "t", "p")
    j = metrics.join(one, "slug").join(head, "slug")
    return j.select("slug", "sharpe_p", "sharpe_b", F.try_divide(c("sharpe_p") * c("vol_p"), c("b1")).alias("treynor"), (c("sharpe_p") * c("vol_b")).alias("m2_excess"), (12 * c("a1")).alias("jensen"), (12 * c("a3")).alias("ff3_alpha"), "information_ratio",
                    (F.try_divide("a1", "s1") * math.sqrt(12)).alias("appraisal_capm"), (F.try_divide("a3", "s3") * math.sqrt(12)).alias("appraisal_ff3"), "t", "p")


def scores(metrics: DataFrame, tails: DataFrame, fits: DataFrame, positive: DataFrame) -> DataFrame:
    """The two scores of 0 to 100 and their parts; parts that are missing leave the others' weights."""
    c = F.col
    lim = lambda x: F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(0.0)), F.lit(100.0)))
    j = metrics.join(fits.where("model = 'FF3'").select("slug", "t"), "slug").join(tails, "slug").join(positive, "slug", "left")
    part = lambda a, b: lim(100 * (1.5 - F.try_divide(F.abs(c(a)), F.abs(c(b)))))
    down = [lim(100 * (1.5 - c("down_capture"))), part("max_drawdown_p", "max_drawdown_b"), part("es_p", "es_b")]
    j = j.withColumns({"alpha_score": lim(50 + 1000 * (c("ann_p") - c("ann_b"))), "skill": lim(50 + 25 * c("t")), "risk_adjusted": lim(50 + 100 * (c("sharpe_p") - c("sharpe_b"))), "consistency": lim(100 * c("share_positive"))})
    from ..functions.columns import mean_of

    j = j.withColumn("downside", mean_of(down))
    weights = {"skill": 0.30, "risk_adjusted": 0.25, "downside": 0.25, "consistency": 0.20}
    total = sum((F.coalesce(c(k) * w, F.lit(0.0)) for k, w in weights.items()), F.lit(0.0))
    there = sum((F.when(c(k).isNotNull(), w).otherwise(0.0) for k, w in weights.items()), F.lit(0.0))
    return j.select("slug", "alpha_score", F.try_divide(total, there).alias("wealth_score"), *weights)


def verdict(t: Column, p_boot: Column, cohort: Column) -> Column:
    """The fixed rule on t, resampled p and place among luck; missing parts don't speak."""
    strong = (t >= 2) & F.coalesce(p_boot <= 0.05, F.lit(True)) & F.coalesce(cohort >= 0.95, F.lit(True))
    return F.when(t.isNull(), "unknown").when(strong, "evidence of skill").when(t >= 1, "suggestive").when(t <= -2, "evidence against").otherwise("indistinguishable from luck")


def table_diff(a: DataFrame, b: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """For each column, rows missing on one side, differing null patterns, and the largest difference."""
    x = a.select(*key, F.lit(True).alias("in_a"), *[F.col(c).cast("double").alias(f"{c}_a") for c in columns])
    y = b.select(*key, F.lit(True).alias("in_b"), *[F.col(c).cast("double").alias(f"{c}_b") for c in columns])
    both = x.join(y, key, "full_outer")
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}_a").alias("a"), F.col(f"{c}_b").alias("b")) for c in columns]))
    long = both.select("in_a", "in_b", cells.alias("x"))
    return long.groupBy("x.column").agg(F.count_if(F.col("in_a").isNull() | F.col("in_b").isNull()).alias("unmatched"), F.count_if(F.col("in_a") & F.col("in_b") & (F.col("x.a").isNull() != F.col("x.b").isNull())).alias("null_differs"), F.max(F.abs(F.col("x.a") - F.col("x.b"))).alias("max_diff"))
