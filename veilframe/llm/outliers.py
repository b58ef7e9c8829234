"""Quality rules: text statistics and robust multivariate outliers per language and source.

Statistics are computed within the row. The outlier rule estimates location and
scatter per group by the minimum covariance determinant: from three starts at the
median, concentration steps keep the half of a group that lies nearest and take mean
and covariance anew, for as long as the determinant falls; the least one counts, and
the rows near it are fitted again, twice (the usual reweighting takes off a bias once). A
step serves all starts by two aggregations whose results are one row per group and
start; distances are triangular solves written as column expressions. DataFrame
functions only.

Defined results: null or blank text has no words and fails the base rule; null
language or source is a value of its own; groups under ``min_rows`` are pooled by
language, then all together; a statistic that is constant in a group gets a least
scale instead of a singular matrix; repeated rows count as often as they occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import let
from ..functions.bounded import broadcast_if_small
from .common import BLANK, WORD, staged

SYMBOLS = "[#*$%&|<>]"  # fixed value
SHORT = 1 << 16  # words; positions of such texts fit beside 48 hash bits
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
MIN_ROWS, REWEIGHTS = 50, 2
# Chi-square with five degrees of freedom, median, 97.5 % and 99.9 % point.
CHI_MEDIAN, REWEIGHT, CUTOFF = 4.351, 12.833, 20.515
# Least standard deviation per transformed statistic, in its own logarithmic unit.
FLOORS = (0.25, 0.10, 0.50, 0.50, 0.75)
X = [f"x{i}" for i in range(len(FLOORS))]
P = len(X)
LEAST_FALL = 1e-6  # a fall of the logarithm of the determinant
# A fit: its group and start, mean, lower triangle of the factor, logarithm of the determinant.
FIT = ["g", "start", *[f"m{i}" for i in range(P)], *[f"l{i}{j}" for j in range(P) for i in range(j, P)], "logdet"]
BINS_PER_OCTAVE, LOW_BIN, HIGH_BIN = 64, -1280, 2560


def _repeated(words: Column) -> Column:
    """Words inside a 3-word window that occurs twice or more in the text.

    Windows are sorted by hash with their position beside it; windows with an equal
    neighbour are repeated, and the words they cover are counted along the text.
    """
    n = F.size(words)

    def covered(places: Column) -> Column:
        steps = F.transform(places, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(places, i + 1) - p, F.lit(3))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def hashed(i: Column) -> Column:
        return F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))

    at = F.sequence(F.lit(0), n - 3)
    mask = SHORT - 1

    def short(keys: Column) -> Column:
        def twin(x: Column, j: Column) -> Column:
            other = F.get(keys, j)
            return F.coalesce(F.shiftright(x, 16) == F.shiftright(other, 16), F.lit(False))

        hits = F.filter(keys, lambda x, i: twin(x, i + 1) | ((i > 0) & twin(x, F.greatest(i - 1, F.lit(0)))))
        return let(F.sort_array(F.transform(hits, lambda x: x.bitwiseAND(F.lit(mask).cast("long")))), covered)

    def long(keys: Column) -> Column:
        def twin(x: Column, j: Column) -> Column:
            return F.coalesce(x["h"] == F.get(keys, j)["h"], F.lit(False))

        hits = F.filter(keys, lambda x, i: twin(x, i + 1) | ((i > 0) & twin(x, F.greatest(i - 1, F.lit(0)))))
        return let(F.sort_array(F.transform(hits, lambda x: x["i"].cast("long"))), covered)

    packed = F.transform(at, lambda i: hashed(i).bitwiseAND(F.lit(~mask)).bitwiseOR(i.cast("long")))
    paired = F.transform(at, lambda i: F.struct(hashed(i).alias("h"), i.alias("i")))
    return (
        F.when(n < 3, F.lit(0).cast("long"))
        .when(n < SHORT, let(F.sort_array(packed), short))
        .otherwise(let(F.array_sort(paired), long))
    )


def statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, lang, source`` and the base statistics of each whole text."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD))
    counts = let(
        F.regexp_extract_all(t, F.lit(WORD), F.lit(0)),
        lambda ws: F.struct(F.size(ws).cast("long").alias("words"), _repeated(ws).alias("repeats")),
    )
    measured = docs.select(
        F.col(key).alias("doc_id"),
        "lang",
        "source",
        counts.alias("_c"),
        (F.length(t) - F.regexp_count(t, F.lit(BLANK))).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        let(lines, lambda ls: F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
    )
    return measured.select(
        "doc_id",
        "lang",
        "source",
        F.col("_c.words").alias("n_words"),
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        F.col("_c.repeats").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    n = F.col("n_words")
    return (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * n)


def _transformed() -> list[Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return [
        F.log1p("n_words"),
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n),
        F.log1p(100 * F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))),
        F.log1p("n_dup_lines"),
        F.log1p(100 * F.col("n_repeat_words") / n),
    ]


def _grouped(rows: DataFrame, min_rows: int) -> DataFrame:
    """Adds ``g``: language and source, or a pool where those are too few."""
    by_source = rows.groupBy("lang", "source").agg(F.count("*").alias("_n"))
    many = F.col("_n") >= min_rows
    by_lang = Window.partitionBy("lang")
    left = F.sum(F.when(~many, F.col("_n")).otherwise(0)).over(by_lang)
    named = F.struct(
        F.when(many, 0).when(left >= min_rows, 1).otherwise(2).alias("level"),
        F.when(many | (left >= min_rows), F.col("lang")).alias("lang"),
        F.when(many, F.col("source")).alias("source"),
    )
    names = by_source.select(
        F.col("lang").alias("_l"), F.col("source").alias("_s"), F.to_json(named, {"ignoreNullFields": "false"}).alias("g")
    )
    same = F.col("lang").eqNullSafe(F.col("_l")) & F.col("source").eqNullSafe(F.col("_s"))
    return rows.join(broadcast_if_small(names), same).drop("_l", "_s")


def _cholesky(s: dict[tuple[int, int], Column]) -> list[tuple[str, Column]]:
    """Named columns of the factor, each over those before it."""
    out = []
    for j in range(P):
        for i in range(j, P):
            rest = s[i, j]
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            value = F.sqrt(F.greatest(rest, F.lit(FLOORS[j] ** 2 * 0.01))) if i == j else rest / F.col(f"l{j}{j}")
            out.append((f"l{i}{j}", value))
    return out


def _factored(found: DataFrame) -> DataFrame:
    """Cholesky factor and ``logdet`` of the covariances ``s``; no variance is under the square of its least scale."""
    pairs = [(i, j) for i in range(P) for j in range(i + 1)]
    cov = {(i, j): F.greatest(f"s{i}{j}", F.lit(FLOORS[i] ** 2)) if i == j else F.col(f"s{i}{j}") for i, j in pairs}
    for name, value in _cholesky(cov):
        found = found.withColumn(name, value)
    logdet = sum((F.log(F.col(f"l{i}{i}")) for i in range(1, P)), F.log("l00"))
    return found.withColumn("logdet", 2 * logdet).select(*FIT)


def _fitted(rows: DataFrame) -> DataFrame:
    """Fit per group and start: mean and factor of the covariance."""
    sums = [F.avg(x).alias(f"m{i}") for i, x in enumerate(X)]
    sums += [F.covar_pop(X[i], X[j]).alias(f"s{i}{j}") for i in range(P) for j in range(i + 1)]
    return _factored(rows.groupBy("g", "start").agg(*sums))


def _distances(rows: DataFrame, fits: DataFrame) -> DataFrame:
    """Squared Mahalanobis distance ``d`` to each fit of a row's group: forward substitution with the factor."""
    out = rows.select("doc_id", "g", *X).join(broadcast_if_small(fits), "g")
    for i in range(P):
        rest = F.col(X[i]) - F.col(f"m{i}")
        for k in range(i):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"y{k}")
        out = out.withColumn(f"y{i}", rest / F.col(f"l{i}{i}"))
    total = sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(1, P)), F.col("y0") * F.col("y0"))
    return out.select("doc_id", "g", "start", *X, total.alias("d"))


def _bin(d: Column) -> Column:
    octave = F.log2(F.greatest(d, F.lit(1e-12))) * BINS_PER_OCTAVE
    return F.greatest(F.least(F.floor(octave), F.lit(HIGH_BIN)), F.lit(LOW_BIN)).cast("int")


def _quantile(measured: DataFrame, wanted: Column) -> DataFrame:
    """Per group and start the first distance bin that reaches ``wanted`` of its ``_e`` rows."""
    name = ["g", "start"]
    counts = measured.groupBy(*name, _bin(F.col("d")).alias("bin")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*name).orderBy("bin"))
    every = F.sum("n").over(Window.partitionBy(*name))
    reached = counts.withColumn("_u", upto).withColumn("_e", every).where(F.col("_u") >= wanted)
    return reached.groupBy(*name).agg(F.min("bin").alias("q"))


def _starts(rows: DataFrame) -> DataFrame:
    """Three fits per group around the medians, with the MAD as scale: no correlation, that of
    bounded values (hyperbolic tangents), and that of directions (spatial signs)."""
    medians = rows.groupBy("g").agg(*[F.percentile_approx(x, 0.5, 1000).alias(f"m{i}") for i, x in enumerate(X)])
    off = rows.join(broadcast_if_small(medians), "g").groupBy("g").agg(
        *[F.percentile_approx(F.abs(F.col(x) - F.col(f"m{i}")), 0.5, 1000).alias(f"a{i}") for i, x in enumerate(X)]
    )
    scale = [F.greatest(1.4826 * F.col(f"a{i}"), F.lit(FLOORS[i])).alias(f"a{i}") for i in range(P)]
    scales = staged(medians.join(off, "g").select("g", *[f"m{i}" for i in range(P)], *scale))
    z = [(F.col(x) - F.col(f"m{i}")) / F.col(f"a{i}") for i, x in enumerate(X)]
    placed = rows.join(broadcast_if_small(scales), "g").select("g", *[v.alias(f"z{i}") for i, v in enumerate(z)])
    length = F.greatest(sum((F.col(f"z{i}") ** 2 for i in range(1, P)), F.col("z0") ** 2), F.lit(1e-12))
    pairs = [(i, j) for i in range(P) for j in range(i + 1)]
    products = [F.avg(F.tanh(f"z{i}") * F.tanh(f"z{j}")).alias(f"t{i}{j}") for i, j in pairs]
    products += [F.avg(F.col(f"z{i}") * F.col(f"z{j}") / length).alias(f"u{i}{j}") for i, j in pairs]
    found = scales.join(placed.groupBy("g").agg(*products), "g")

    def covariance(kind: str, i: int, j: int) -> Column:
        if i == j:
            return F.col(f"a{i}") ** 2
        both = F.sqrt(F.col(f"{kind}{i}{i}") * F.col(f"{kind}{j}{j}"))
        return F.when(both > 0, F.col(f"{kind}{i}{j}") / both).otherwise(0.0) * F.col(f"a{i}") * F.col(f"a{j}") if kind else F.lit(0.0)

    means = [f"m{i}" for i in range(P)]
    kinds = [
        found.select("g", F.lit(n).alias("start"), *means, *[covariance(kind, i, j).alias(f"s{i}{j}") for i, j in pairs])
        for n, kind in enumerate(("", "t", "u"))
    ]
    return _factored(staged(kinds[0].unionByName(kinds[1]).unionByName(kinds[2]))).withColumn("logdet", F.lit(float("inf")))


def robust_distances(rows: DataFrame) -> DataFrame:
    """``doc_id, g, d`` by the fit of least determinant over half of a group, reweighted.

    Every start takes concentration steps for as long as its determinant falls. The rows
    that the best fit puts within the 97.5 % point give a new mean and covariance, twice.
    """
    half = F.floor((F.col("_e") + P + 1) / 2)
    fits = staged(_starts(rows))
    tried = None
    while not fits.isEmpty():
        measured = _distances(rows, fits)
        near = staged(_quantile(measured, F.least(half, F.col("_e"))))
        core = measured.join(broadcast_if_small(near), ["g", "start"]).where(_bin(F.col("d")) <= F.col("q"))
        before = fits.select("g", "start", F.col("logdet").alias("before"))
        made = staged(_fitted(core))  # here, so that no filter is pushed into the factor's expressions
        fell = made.join(broadcast_if_small(before), ["g", "start"]).where(F.col("logdet") < F.col("before") - LEAST_FALL)
        fits = staged(fell.select(*FIT))
        tried = fits if tried is None else tried.unionByName(fits)
    if tried is None:
        return rows.select("doc_id", "g", F.lit(0.0).alias("d"))
    best = tried.groupBy("g").agg(F.min_by(F.struct(*FIT[1:]), F.struct("logdet", "start")).alias("best"))
    measured = _scaled(_distances(rows, staged(best.select("g", "best.*"))))
    for _ in range(REWEIGHTS):
        measured = _scaled(_distances(rows, staged(_fitted(measured.where(F.col("d") <= REWEIGHT)))))
    return measured.select("doc_id", "g", "d")


def _scaled(measured: DataFrame) -> DataFrame:
    """Distances by which no group's median is above that of the chi-square law."""
    middle = staged(_quantile(measured, 0.5 * F.col("_e")))
    scale = F.pow(F.lit(2.0), (F.col("q") + 0.5) / BINS_PER_OCTAVE) / CHI_MEDIAN
    scaled = measured.join(broadcast_if_small(middle), ["g", "start"])
    return scaled.withColumn("d", F.col("d") / F.greatest(scale, F.lit(1.0)))


def reject_outliers(
    docs: DataFrame, key: str = "doc_id", text: str = "text", cutoff: float = CUTOFF, min_rows: int = MIN_ROWS
) -> DataFrame:
    """Statistics of every document with ``base_failed``, ``distance`` and ``kept``.

    Rows that fail the base rule take no part in the estimates and have no distance.
    """
    measured = statistics(docs, key, text).withColumn("base_failed", base_failed())
    table = staged(measured.withColumn("_row", F.monotonically_increasing_id()))
    wanted = table.where(~F.col("base_failed")).select(
        F.col("_row").alias("doc_id"), "lang", "source", *[x.alias(n) for x, n in zip(_transformed(), X, strict=True)]
    )
    scored = robust_distances(staged(_grouped(wanted, min_rows)))
    far = scored.select(F.col("doc_id").alias("_row"), F.col("d").alias("distance"))
    out = table.join(far, "_row", "left").drop("_row")
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(True)))
