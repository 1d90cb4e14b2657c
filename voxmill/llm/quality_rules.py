"""Quality rules by robust multivariate outliers: minimum-covariance-determinant estimates for each language and source. Built-in functions only.

A document's statistics become the vector of FEATURES. For each pair of language and source the estimate is sought from five starts (medians and absolute deviations of
the group and of its language, all rows, two halves). A concentration step takes the `core` share of rows nearest to a fit and fits their mean and
covariance, which lowers the determinant; after two steps from each start the one of least determinant goes on until no determinant falls any more. Last, the rows within the
97.5 % quantile are fitted. One step is one map-side combined aggregation over (group, start, distance bin); the bin in which the core ends counts with the share
that makes up the core, so exactly the wanted number of rows counts, ties alike, and what may differ from sorted rows lies within one bin. Vectors are held as
integers, so sums are exact and a run gives the same result for any partitioning.

Every fit is that of its rows and of `prior` more rows with the medians and deviations of the language, which in turn count `prior` rows of all languages. So a
group of one row has an estimate like one of millions, and no size changes the rule. Variances have floors, which stand for what is no fault in any
group (most have no symbols at all, so that a plain determinant would be zero).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import flagged, hidden, keep_if, written
from .text_stats import STATS, with_text_stats

#: Names of the vector's parts and the least standard deviation of each.
FEATURES = {"length": 0.5, "word_size": 0.12, "symbols": 0.12, "repeats": 0.35, "dup_lines": 0.35}
_UNIT = 1000  # a feature is held in thousandths
_P = len(FEATURES)
#: Bins of the binary logarithm of a squared distance: 1.1 % of it each.
_BINS = 64
#: Parts into which the rows of a group are dealt where its fits are not broadcast.
_SALTS = 8
#: Starts of the search: the group's medians, the language's, all rows, and either half of the rows by hash.
MEDIANS, PRIOR, ALL, HALVES = 0, 1, 2, (3, 4)
#: Names of a fit's parts: means and the lower triangle of a matrix.
_M = [f"m{i}" for i in range(_P)]
_S = [f"s{i}_{j}" for i in range(_P) for j in range(i + 1)]
_W = [f"w{i}_{j}" for i in range(_P) for j in range(i + 1)]


def chi2_cdf(x: float, k: int) -> float:
    """Chi-square distribution function by the series of the lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    s, h = k / 2, x / 2
    term = total = 1 / s
    for i in range(1, 2000):
        term *= h / (s + i)
        total += term
    return min(1.0, total * math.exp(-h + s * math.log(h) - math.lgamma(s)))


def chi2_quantile(q: float, k: int) -> float:
    lo, hi = 0.0, 400.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, k) < q else (lo, mid)
    return hi


def _vector(p: str = "") -> list[str]:
    """The transformed statistics in thousandths, as SQL; p: prefix of the columns of statistics."""
    n, size = f"greatest({p}n_words, 1)", f"greatest({p}word_chars, 1)"
    parts = (f"ln({n})", f"ln({size} / {n})", f"log1p(20 * {p}n_symbols / {size})", f"log1p(10 * {p}n_repeat_words / {n})", f"log1p(40 * {p}n_dup_lines / {n})")
    return [f"cast(round({x} * {_UNIT}) as bigint)" for x in parts]


def base_failed(p: str = "") -> Column:
    """The base rules: under 50 words, or more than half of the words in repeated windows."""
    return (F.col(p + "n_words") < 50) | (100 * F.col(p + "n_repeat_words") > 50 * F.col(p + "n_words"))


def _gid(lang: Column, source: Column) -> Column:
    return F.xxhash64(lang.isNull(), lang, source.isNull(), source)


def _medians(v: DataFrame) -> DataFrame:
    """(level: gid, lid or all; key, rows, m, v): medians and squared scaled absolute deviations of each group, of each language and of all rows.

    They come from one exact histogram of hundredths, whose size depends on the range of values alone.
    """
    bins = F.posexplode(F.array(*(F.round(F.col(f"z{i}") / 10).cast("int") for i in range(_P)))).alias("k", "x")
    hist = written(v.select("gid", "lid", bins).groupBy("gid", "lid", "k", "x").agg(F.count("*").alias("n")), "hist")
    levels = hist.select("k", "x", "n", F.explode(F.create_map(F.lit("gid"), "gid", F.lit("lid"), "lid", F.lit("all"), F.lit(0).cast("long"))).alias("level", "key"))
    levels = levels.groupBy("level", "key", "k", "x").agg(F.sum("n").alias("n"))
    by = ["level", "key", "k"]
    mid = levels.groupBy(*by).agg(F.percentile("x", F.lit(0.5), F.col("n")).alias("mid"), F.sum("n").alias("rows"))
    dev = levels.join(mid, by).groupBy(*by).agg(F.percentile(F.abs(F.col("x") - F.col("mid")), F.lit(0.5), F.col("n")).alias("mad"))
    both = mid.join(dev, by)
    wide = both.groupBy("level", "key").agg(F.max("rows").alias("rows"), F.expr(f"array({', '.join(f'max(case when k = {i} then mid / 100 end)' for i in range(_P))}) as m"), F.expr(f"array({', '.join(f'max(case when k = {i} then pow(mad * 0.014826D, 2) end)' for i in range(_P))}) as v"))
    return written(wide, "medians")


def _priors(medians: DataFrame, pairs: DataFrame, prior: int) -> DataFrame:
    """(gid, size, m, v, pm, pv): the medians and deviations of each group of pairs (gid, lid), and those of its prior."""
    level = lambda name, *cols: medians.filter(F.col("level") == name).select(*cols)
    whole = level("all", "m", "v").first() or {"m": [], "v": []}
    shrunk = lambda c: F.zip_with(c, F.array(*map(F.lit, whole[c])), lambda x, y: (F.col("rows") * x + prior * y) / (F.col("rows") + prior))
    langs = level("lid", F.col("key").alias("lid"), shrunk("m").alias("pm"), shrunk("v").alias("pv"))
    own = level("gid", F.col("key").alias("gid"), F.col("rows").alias("size"), "m", "v")
    return written(own.join(pairs, "gid").join(langs, "lid").select("gid", "size", "m", "v", "pm", "pv"), "priors")


def _fitted(raw: DataFrame, priors: DataFrame, prior: int) -> DataFrame:
    """(gid, start, size, logdet, m.., w..): the fits of raw (gid, start, n, m.., s..) together with the priors, and the inverses of their covariances (sums of w.. are quadratic forms).

    A covariance is inverted by sweeping its pivots one after the other, as one small expression over arrays, whatever the number of features.
    """
    floors = list(FEATURES.values())

    # expressions as text, which is told to the JVM at once
    def cov(i: int, j: int) -> str:
        own = f"n * s{max(i, j)}_{min(i, j)}" + (f" + {prior} * pv[{i}]" if i == j else "")
        return f"({own} + n * {prior} / (n + {prior}) * (m{i} - pm[{i}]) * (m{j} - pm[{j}])) / (n + {prior})" + (f" + {floors[i] ** 2}D" if i == j else "")

    means = [f"(n * m{i} + {prior} * pm[{i}]) / (n + {prior}) as m{i}" for i in range(_P)]
    df = raw.join(priors.select("gid", "size", "pm", "pv"), "gid").selectExpr("gid", "start", "size", *means, f"array({', '.join(cov(i, j) for i in range(_P) for j in range(_P))}) as cov")
    kind = "struct<a:array<double>,logdet:double>"

    def sweep(acc: Column, k: Column) -> Column:
        pivot = F.get(acc["a"], k * (_P + 1))

        def swept(x: Column, e: Column) -> Column:
            i, j = F.floor(e / _P).cast("int"), e % _P
            up, left = F.get(acc["a"], i * _P + k), F.get(acc["a"], k * _P + j)
            return F.when((i == k) & (j == k), -1 / pivot).when((i == k) | (j == k), x / pivot).otherwise(x - up * left / pivot)

        return F.struct(F.transform(acc["a"], swept).alias("a"), (acc["logdet"] + F.log(pivot)).alias("logdet")).cast(kind)

    df = df.withColumn("swept", F.aggregate(F.sequence(F.lit(0), F.lit(_P - 1)), F.struct("cov", F.lit(0.0)).cast(kind), sweep))
    # off the diagonal a part counts twice
    return df.selectExpr("gid", "start", "size", "swept.logdet as logdet", *_M, *(f"swept.a[{i * _P + j}] * {-1 if i == j else -2} as w{i}_{j}" for i in range(_P) for j in range(i + 1)))


def _distance(z: list[str], fit: str = "") -> str:
    """Squared Mahalanobis distance of the vector z, as SQL; fit: prefix of the parts m.. and w.. of a fit."""
    gap = [f"({z[i]} / {_UNIT}D - {fit}m{i})" for i in range(_P)]
    return "greatest(0D, " + " + ".join(f"{fit}w{i}_{j} * {gap[i]} * {gap[j]}" for i in range(_P) for j in range(i + 1)) + ")"


_SUMS = [f"a{i}" for i in range(_P)] + [f"b{i}_{j}" for i in range(_P) for j in range(i + 1)]


def _sums() -> list[Column]:
    parts = [*(f"z{i}" for i in range(_P)), *(f"z{i} * z{j}" for i in range(_P) for j in range(i + 1))]
    return [F.expr(f"{x} as {k}") for k, x in [("n", "count(*)"), *((k, f"sum({x})") for k, x in zip(_SUMS, parts, strict=True))]]


def _moments(sums: DataFrame, scale: float) -> DataFrame:
    """(gid, start, n, m.., s..) of sums (gid, start, n, a.., b..); scale makes up for rows that were left out."""
    cov = [f"(b{i}_{j} / n - a{i} / n * (a{j} / n)) / {_UNIT**2} * {scale}D as s{i}_{j}" for i in range(_P) for j in range(i + 1)]
    return sums.selectExpr("gid", "start", "cast(n as double) as n", *(f"a{i} / n / {_UNIT} as m{i}" for i in range(_P)), *cov)


def _scale(share: float) -> float:
    """What makes the covariance of the share of nearest rows that of a normal distribution."""
    return share / chi2_cdf(chi2_quantile(share, _P), _P + 2)


def _starts(v: DataFrame, priors: DataFrame) -> DataFrame:
    """(gid, start, n, m.., s..) of the five starts."""
    flat = lambda start, m, s: priors.selectExpr("gid", f"{start} as start", "cast(size as double) as n", *(f"{m}[{i}] as m{i}" for i in range(_P)), *(f"{s}[{i}] as s{i}_{j}" if i == j else f"0D as s{i}_{j}" for i in range(_P) for j in range(i + 1)))
    half = F.pmod(F.xxhash64(*(f"z{i}" for i in range(_P))), F.lit(2)).cast("int")
    halves = written(v.groupBy("gid", (half + HALVES[0]).alias("start")).agg(*_sums()), "halves")
    every = halves.groupBy("gid").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in _SUMS)).withColumn("start", F.lit(ALL))
    return flat(MEDIANS, "m", "v").unionByName(flat(PRIOR, "pm", "pv")).unionByName(_moments(halves.unionByName(every), 1.0))


def _near(v: DataFrame, fit: DataFrame) -> DataFrame:
    """v with each fit of its group and the squared distance d."""
    dealt = fit.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    return v.join(dealt, ["gid", "salt"]).withColumn("d", F.expr(_distance([f"z{i}" for i in range(_P)])))


def _concentrated(v: DataFrame, fit: DataFrame, core: float) -> DataFrame:
    """Sums of the core share of rows nearest to each fit."""
    bin_ = F.floor(F.log2(F.greatest("d", F.lit(1e-6))) * _BINS).cast("int").alias("bin")
    binned = _near(v, fit).groupBy("gid", "start", "size", bin_).agg(*_sums())
    before = F.sum("n").over(W.partitionBy("gid", "start").orderBy("bin")) - F.col("n")
    part = (F.ceil(F.col("size") * core) - before) / F.col("n")
    used = binned.withColumn("part", F.least(F.lit(1.0), part)).filter("part > 0")
    # whole bins are added up exactly, in whichever order they come
    whole = lambda c: F.expr(f"coalesce(cast(sum(case when part = 1 then cast({c} as decimal(38, 0)) end) as double), 0D) + coalesce(max(case when part < 1 then {c} * part end), 0D) as {c}")
    return used.groupBy("gid", "start").agg(*map(whole, ("n", *_SUMS)))


def fit_mcd(stats: DataFrame, core: float = 0.75, prior: int = 50, rounds: int = 20) -> DataFrame:
    """The fits (gid, m.., w..) of all groups of stats (lang, source, STATS; rows that fail the base rules are left out), written to the shared folder.

    Concentration ends when no group's log determinant falls by 0.001, or after `rounds` steps, each keeping the least determinant that a group has met. No rows give no fits.
    """
    z = [f"z{i}" for i in range(_P)]
    rows = stats.filter(~base_failed()).select(_gid(F.col("lang"), F.col("source")).alias("gid"), F.xxhash64(F.col("lang").isNull(), "lang").alias("lid"), *(F.expr(x).alias(k) for k, x in zip(z, _vector(), strict=True)))
    v = written(rows.withColumn("salt", F.pmod(F.xxhash64(*z), F.lit(_SALTS)).cast("int")), "vectors")
    medians = _medians(v)
    priors = _priors(medians, v.select("gid", "lid").distinct(), prior)
    step = lambda fit: _fitted(_moments(_concentrated(v, fit, core), _scale(core)), priors, prior)
    fits = written(_fitted(_starts(v, priors), priors, prior), "fit")
    for _ in range(2):
        fits = written(step(fits), "fit")
    names = [c for c in fits.columns if c != "gid"]
    best = written(fits.groupBy("gid").agg(F.min_by(F.struct(*names), F.struct("logdet", "start")).alias("f")).select("gid", "f.*"), "best")
    for _ in range(rounds):
        now = step(best).select("gid", F.struct(*names).alias("now"))
        both = now.join(best.select("gid", F.struct(*names).alias("old")), "gid")
        lower = F.when(F.col("now.logdet") < F.col("old.logdet"), F.col("now")).otherwise(F.col("old"))
        best = written(both.select("gid", lower.alias("f"), (F.col("old.logdet") - F.col("now.logdet")).alias("fell")).select("gid", "f.*", "fell"), "best")
        if best.filter("fell >= 0.001").isEmpty():
            break
    inside = _near(v, best.drop("fell")).filter(F.col("d") <= chi2_quantile(0.975, _P)).groupBy("gid", "start").agg(*_sums())
    # a group none of whose rows is inside keeps its prior alone
    empty = priors.select("gid", F.lit(0).alias("start"), F.lit(0.0).alias("n"), *(F.expr(f"pm[{i}] as m{i}") for i in range(_P)), *(F.expr(f"0D as {c}") for c in _S)).join(inside, "gid", "left_anti")
    return written(_fitted(_moments(inside, _scale(0.975)).unionByName(empty), priors, prior).select("gid", *_M, *_W), "fit")


def judge(df: DataFrame, fits: DataFrame, prefix: str = "", tail: float = 1e-9, verdict: str = "kept", failed: str = "base_failed") -> DataFrame:
    """df (lang, source and prefixed STATS) with base_failed and kept. A row whose group has no fit has failed the base rules."""
    gid, salt, fit = hidden(df, "gid", "salt", "fit")
    # while the fits are small they are broadcast; else a group's rows are dealt by salt
    table = fits.select(F.col("gid").alias(gid), F.struct(*_M, *_W).alias(fit), F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias(salt))
    keyed = df.withColumns({gid: _gid(F.col("lang"), F.col("source")), salt: F.pmod(F.xxhash64(*(F.col(prefix + c) for c in STATS)), F.lit(_SALTS)).cast("int")})
    inside = F.coalesce(F.expr(_distance(_vector(prefix), f"{fit}.")) <= chi2_quantile(1 - tail, _P), F.lit(True))
    return keyed.join(table, [gid, salt], "left").withColumns({failed: base_failed(prefix), verdict: ~base_failed(prefix) & inside}).drop(gid, salt, fit)


def quality_table(docs: DataFrame, tail: float = 1e-9, **fit) -> DataFrame:
    """One row per row of docs (doc_id, text, lang, source; others are ignored): doc_id, STATS, base_failed, kept.

    A null or empty text has no words and fails. Null languages and sources are groups of their own; repeated rows count each time; equal vectors have one
    verdict. No rows give an empty table.
    """
    stats = written(with_text_stats(docs.select("doc_id", "text", "lang", "source")).select("doc_id", "lang", "source", *STATS), "stats")
    return judge(stats, fit_mcd(stats, **fit), tail=tail).select("doc_id", *STATS, "base_failed", "kept")


def keep_good(docs: DataFrame, tail: float = 1e-9, **fit) -> DataFrame:
    """The rows of docs that pass, with all their columns, whatever they are called; cases as in quality_table().

    No text is shuffled or written: rows whose text hash a bitmap of the rejected rows' hashes doesn't hold are kept at once, and only the others are measured again.
    """
    stats = written(with_text_stats(docs.select("text", "lang", "source")).select(F.xxhash64("text").alias("th"), "lang", "source", *STATS), "stats")
    fits = fit_mcd(stats, **fit)
    out = written(judge(stats, fits, tail=tail).filter("not kept").select("th").distinct(), "rejected")
    p, th, flag, verdict, failed = hidden(docs, "stat", "th", "flag", "kept", "failed")
    marked = flagged(docs.withColumn(th, F.xxhash64("text")), th, out, "th", flag)
    judged = judge(with_text_stats(marked.filter(flag), prefix=p), fits, prefix=p, tail=tail, verdict=verdict, failed=failed)
    return marked.filter(~F.col(flag)).select(*docs.columns).unionByName(keep_if(judged, F.col(verdict)).select(*docs.columns))
