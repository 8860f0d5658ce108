"""Quality rules: fixed base rules, then robust multivariate outliers (native).

Every document gives counts (words, characters, symbols, repeated lines and
3-word windows).  Documents that pass the base rules give a transformed vector:

* mean word length, shrunk towards 5 by 50 words of prior weight,
* ln(1 + symbols per word),
* ln(1 + 10 · repeated lines per word),
* share of words inside repeated 3-word windows
(the last three shrunk towards 0 by ``PRIOR`` words: one event weighs less in a short text).

Per (lang, source) the minimum covariance determinant is searched from ``STARTS``
fixed starts (coordinate medians, distances in differently weighted units):
concentration steps refit mean and covariance on the share ``SUPPORT`` of documents with
the smallest distances, all starts and groups in one aggregate, until no determinant
falls any more; the start with the smallest determinant is the group's estimate.  The
covariance is scaled for consistency.  Most groups have statistics that are constant
in their core (no symbols at all), so a pivot of the covariance (the variance a
statistic has besides the ones before it) is at least the square of a small floor,
which only keeps the matrix invertible: ``PART`` of the corpus's spread (quartiles)
of the statistic, or half an event (symbol, repeated line, shortest repeat) in a
document of median length, whichever is more.  A document is rejected if its squared
Mahalanobis distance exceeds ``CUTOFF`` (chi-square, 4 degrees, 0.9999) and the outer
fence of the corpus's own distances (third quartile plus ``FENCE`` quartile ranges,
of logarithms): statistics that count rare events are far from normal, and by
chi-square alone one repeated notice would reject a good document.
Groups below ``LEAST`` documents use the estimate of their language, languages below
it that of the corpus; a corpus below it uses the start.  Estimates of languages or
the corpus are made only where some group needs them.

All of it is DataFrame expressions: a step is one partial aggregate per group
and a small join; vectors are fixed-point integers, so sums do not depend on
the partitioning.  A hot source is one row after the map-side aggregate, and estimates
are sent to the rows where they are counted to be at most ``FEW`` (else joined), so no
row is dealt out by its group.

Defined results: a null text has no words and fails the base rules; null lang
or source is a group of its own; null ids and repeated rows are judged like any
other row; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.llm.common import read_table
from kerbside.session import discard, materialize

#: Fixed-point units per 1.0 of a vector element.
SCALE = 1000
#: Units of the start's distances; spreads of a corpus that is too small for an estimate.
START = (0.3, 0.04, 0.12, 0.12)
#: Part of the corpus's spread that is the least spread of a group.
PART = 0.1
SUPPORT = 0.75
#: Consistency factor of a covariance from the central 75 % in 4 dimensions.
CONSISTENCY = 1.486
CUTOFF = 23.51
#: Quartile ranges of log(1 + distance) above the third quartile.
FENCE = 2.5
#: Words without events that a document's shares are counted with.
PRIOR = 100
#: Weights of the units in the starts' distances.
STARTS = ((1.0, 1.0, 1.0, 1.0), (0.25, 1.0, 1.0, 1.0), (1.0, 1.0, 0.25, 0.25), (4.0, 1.0, 1.0, 0.25))
#: A determinant has fallen if it is lower by more than this part; steps end after MOST at the latest.
FALL, MOST = 1e-6, 25
LEAST = 30
#: Estimates that are broadcast (some hundred bytes each).
FEW = 100_000

_P = len(START)
_STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def with_statistics(docs: DataFrame, text: Column) -> DataFrame:
    """``docs`` plus the counts and ``base_failed``; helper columns start with ``__q``."""
    space = "[\\x20\\x09-\\x0D]+"
    d = docs.withColumn("__qt", F.coalesce(text, F.lit("")))
    d = d.withColumn("__qw", F.expr(f"transform(filter(split(__qt, '{space}'), w -> w != ''), w -> xxhash64(w))".replace("\\", "\\\\")))
    d = d.withColumn("__qn", F.size("__qw"))
    lines = F.filter(F.split("__qt", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    d = d.withColumn("__ql", lines)
    d = d.withColumn("__qh", F.expr("CASE WHEN __qn < 4 THEN cast(array() as array<bigint>) ELSE "
                                    "transform(sequence(0, __qn - 3), i -> xxhash64(__qw[i], __qw[i + 1], __qw[i + 2])) END"))
    # if a window occurs twice: windows sorted by hash with their position, so that equal ones are neighbours
    d = d.withColumn("__qs", F.expr(
        "CASE WHEN size(array_distinct(__qh)) = size(__qh) THEN cast(array() as array<struct<h: bigint, i: int>>) "
        "ELSE sort_array(transform(__qh, (h, i) -> struct(h AS h, i AS i))) END"))
    d = d.withColumn("__qp", F.expr(
        "sort_array(transform(filter(__qs, (z, k) -> (k > 0 AND z.h = __qs[k - 1].h) OR (k + 1 < size(__qs) AND z.h = __qs[k + 1].h)), z -> z.i))"))
    repeat = F.expr("aggregate(__qp, struct(0 AS c, -3 AS last), (a, p) -> struct(a.c + least(3, p - a.last) AS c, p AS last), a -> a.c)")
    d = d.withColumns({
        "n_words": F.col("__qn").cast("long"),
        "word_chars": (F.length("__qt") - F.length(F.regexp_replace("__qt", "[^\\x20\\x09-\\x0D]+", ""))).cast("long"),
        "n_symbols": F.length(F.regexp_replace("__qt", "[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": (F.size("__ql") - F.size(F.array_distinct("__ql"))).cast("long"),
        "n_repeat_words": repeat.cast("long"),
    })
    return d.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).drop(
        "__qt", "__qw", "__qn", "__ql", "__qh", "__qs", "__qp")


def _vector() -> list[Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    m = n + PRIOR
    raw = [(F.col("word_chars") + 250) / (n + 50), F.log1p(F.col("n_symbols") / m), F.log1p(10 * F.col("n_dup_lines") / m), F.col("n_repeat_words") / m]
    return [F.round(c * SCALE).cast("long") for c in raw]


def _distance(x: list[Column], mean: list[Column], chol: list[list[Column]]) -> Column:
    """Squared Mahalanobis distance by forward substitution."""
    y: list[Column] = []
    for i in range(_P):
        r = x[i] - mean[i]
        for j in range(i):
            r = r - chol[i][j] * y[j]
        y.append(r / chol[i][i])
    return sum((v * v for v in y[1:]), y[0] * y[0])


def floors(vectors: DataFrame) -> list[float]:
    """Least spread of each vector element, in fixed point: four numbers for the corpus."""
    quartiles = [F.percentile(f"x_{i}", F.array(F.lit(0.25), F.lit(0.75))) for i in range(_P)]
    words, *spans = vectors.agg(F.percentile("words", F.lit(0.5)), *quartiles).first()
    if words is None:
        return [c * SCALE for c in START]
    # a word's length is no count; the shortest repeat of three words has four
    event = [1 / (words + 50), math.log1p(1 / (words + PRIOR)), math.log1p(10 / (words + PRIOR)), 4 / (words + PRIOR)]
    return [max(PART * (high - low) / 1.349, 0.5 * e * SCALE) for (low, high), e in zip(spans, event)]


def _cholesky(cov: list[list[Column]], frame: DataFrame, least: list[float]) -> DataFrame:
    """Add the factor's elements ``l_i_j`` (each a column of its own, so later ones refer to it)."""
    for i in range(_P):
        for j in range(i + 1):
            s = cov[i][j]
            for k in range(j):
                s = s - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            frame = frame.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(s, F.lit(least[i] ** 2))) if i == j else s / F.col(f"l_{j}_{j}"))
    return frame


def _keys(level: int) -> list[Column]:
    """(level, lang, source) of a row's group at level 0 (lang, source), 1 (lang), 2 (corpus)."""
    lang = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("")) if level < 2 else F.lit("*")
    source = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")) if level < 1 else F.lit("*")
    return [F.lit(level).alias("level"), lang.alias("kl"), source.alias("ks")]


_KEY = ["level", "kl", "ks"]
_MEAN = [f"m_{i}" for i in range(_P)]
_CHOL = [f"l_{i}_{j}" for i in range(_P) for j in range(i + 1)]


def _sent(est: DataFrame, count: int) -> DataFrame:
    return F.broadcast(est) if count <= FEW else est


def _levels(vectors: DataFrame) -> list[int]:
    """Levels that some group needs: its own, or the next one up where it is small."""
    sizes = materialize(vectors.groupBy(*_keys(0)).agg(F.count("*").alias("n")), "mcd_sizes")
    small = sizes.filter(F.col("n") < LEAST).count()
    langs = sizes.groupBy("kl").agg(F.sum("n").alias("n")).filter(F.col("n") < LEAST).count()
    discard(sizes)
    return [0] + [1] * (small > 0) + [2] * (langs > 0)


def estimate(vectors: DataFrame) -> DataFrame:
    """``vectors(lang, source, words, x_0 …)`` → one row per group: key, n, mean, factor."""
    least = floors(vectors)
    levels = F.explode(F.array(*[F.struct(*_keys(k)) for k in _levels(vectors)]))
    rows = vectors.select(levels.alias("k"), *[f"x_{i}" for i in range(_P)]).select("k.*", *[f"x_{i}" for i in range(_P)])
    x = [F.col(f"x_{i}") for i in range(_P)]
    # the factor of start s: its units on the diagonal
    start = rows.groupBy(*_KEY).agg(F.count("*").alias("n"), *[F.percentile(f"x_{i}", F.lit(0.5)).alias(f"m_{i}") for i in range(_P)])
    units = F.explode(F.array(*[F.struct(F.lit(s).alias("start"), *[F.lit(w[i] * START[i] * SCALE).alias(f"l_{i}_{i}") for i in range(_P)]) for s, w in enumerate(STARTS)]))
    est = start.withColumn("u", units).select("*", "u.*").withColumns({f"l_{i}_{j}": F.lit(0.0) for i in range(_P) for j in range(i)})
    est = materialize(est.select(*_KEY, "start", "n", *_MEAN, *_CHOL, F.lit(float("inf")).alias("det"), F.lit(True).alias("falls")), "mcd")
    count = est.count()
    for _ in range(MOST):
        moving = est.filter(F.col("falls") & (F.col("n") >= LEAST))
        if moving.isEmpty():
            break
        near = rows.join(_sent(moving, count), _KEY)
        d = _distance(x, [F.col(c) for c in _MEAN], [[F.col(f"l_{i}_{j}") for j in range(i + 1)] for i in range(_P)])
        # logarithms of distances in fixed point: the quantile needs one counter per distinct value, of which there are few
        near = near.select(*_KEY, "start", "n", *[f"x_{i}" for i in range(_P)], F.round(F.log1p(d) * 1024).cast("long").alias("d"))
        limit = materialize(near.groupBy(*_KEY, "start").agg(F.percentile("d", F.lit(SUPPORT)).alias("limit")), "mcd_limits")
        inner = near.join(_sent(limit, count), [*_KEY, "start"]).filter(F.col("d") <= F.col("limit"))
        sums = inner.groupBy(*_KEY, "start").agg(
            F.first("n").alias("n"), F.count("*").alias("h"), *[F.sum(x[i]).alias(f"s_{i}") for i in range(_P)],
            *[F.sum(x[i] * x[j]).alias(f"q_{i}_{j}") for i in range(_P) for j in range(i + 1)])
        sums = sums.withColumns({f"m_{i}": F.col(f"s_{i}") / F.col("h") for i in range(_P)})
        cov = [[(F.col(f"q_{i}_{j}") / F.col("h") - F.col(f"m_{i}") * F.col(f"m_{j}")) * CONSISTENCY for j in range(i + 1)] for i in range(_P)]
        det = F.lit(1.0)
        for i in range(_P):
            det = det * F.col(f"l_{i}_{i}") * F.col(f"l_{i}_{i}")
        fitted = _cholesky(cov, sums, least).select(*_KEY, "start", "n", *_MEAN, *_CHOL, det.alias("det"))
        old = est.select(*_KEY, "start", F.struct(*_MEAN, *_CHOL, "det").alias("old"))
        # a step that does not lower the determinant is not taken, and ends its start
        less = F.col("det") < F.col("old.det") * (1 - FALL)
        taken = fitted.join(_sent(old, count), [*_KEY, "start"]).select(
            *_KEY, "start", "n", *[F.when(less, F.col(c)).otherwise(F.col(f"old.{c}")).alias(c) for c in [*_MEAN, *_CHOL, "det"]], less.alias("falls"))
        rest = est.filter(~(F.col("falls") & (F.col("n") >= LEAST))).withColumn("falls", F.lit(False))
        before, est = est, materialize(taken.unionByName(rest.select(*taken.columns)), "mcd")
        discard(before, limit)
    # a group that is too small keeps its first start; it is only used when the whole corpus is
    best = F.min_by(F.struct(*_MEAN, *_CHOL), F.struct("det", "start"))
    return est.groupBy(*_KEY).agg(F.first("n").alias("n"), best.alias("b")).select(*_KEY, "n", "b.*")


def judge(stats: DataFrame, est: DataFrame) -> DataFrame:
    """``stats`` (lang, source, counts, base_failed) plus ``distance`` and ``kept``."""
    cols = [F.col(c) for c in stats.columns]
    rows = stats
    est = materialize(est, "mcd")
    count = est.count()
    for level in range(3):
        own = est.filter(F.col("level") == level).select(
            F.col("kl").alias(f"__kl{level}"), F.col("ks").alias(f"__ks{level}"),
            F.when((F.col("n") >= LEAST) | F.lit(level == 2), F.struct(*_MEAN, *_CHOL)).alias(f"__e{level}"))
        _, kl, ks = _keys(level)
        rows = rows.join(_sent(own, count), (kl == F.col(f"__kl{level}")) & (ks == F.col(f"__ks{level}")), "left")
    rows = rows.withColumn("__e", F.coalesce("__e0", "__e1", "__e2"))
    d = _distance(_vector(), [F.col(f"__e.{c}") for c in _MEAN], [[F.col(f"__e.l_{i}_{j}") for j in range(i + 1)] for i in range(_P)])
    judged = rows.select(*cols, F.when(~F.col("base_failed"), d).alias("distance"))
    cut = cutoff(judged)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("distance") <= cut))


def cutoff(judged: DataFrame) -> float:
    """The larger of CUTOFF and the outer fence of the distances: two numbers of the corpus."""
    log = F.round(F.log1p("distance") * 1024).cast("long")
    got = judged.filter("distance IS NOT NULL").agg(F.percentile(log, F.array(F.lit(0.25), F.lit(0.75)))).first()[0]
    if got is None:
        return CUTOFF
    low, high = (v / 1024 for v in got)
    return max(CUTOFF, math.expm1(high + FENCE * (high - low)))


def _vectors(stats: DataFrame) -> DataFrame:
    return stats.filter(~F.col("base_failed")).select("lang", "source", F.col("n_words").alias("words"), *[c.alias(f"x_{i}") for i, c in enumerate(_vector())])


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                  source_col: str = "source") -> DataFrame:
    """One row per document: id, counts, base_failed, distance, kept."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"))
    stats = materialize(with_statistics(own, F.col("text")).drop("text"), "rule_stats")
    return judge(stats, estimate(_vectors(stats))).select(F.col("id").alias(id_col), *_STATS, "base_failed", "distance", "kept")


def keep_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, lang, source, any further columns) that
    the rules keep, columns unchanged."""
    verdicts = quality_rules(docs.withColumn("doc_id", F.xxhash64("doc_id", "text", "lang", "source", F.concat(F.col("lang").isNull().cast("string"), F.col("source").isNull().cast("string")))))
    good = verdicts.filter("kept").select(F.col("doc_id").alias("__row")).distinct()
    key = F.xxhash64("doc_id", "text", "lang", "source", F.concat(F.col("lang").isNull().cast("string"), F.col("source").isNull().cast("string")))
    return docs.withColumn("__row", key).join(good, "__row", "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read_table(spark, sf_dir, "documents"))
