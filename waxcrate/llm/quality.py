"""Quality rules: robust multivariate outliers, by minimum-covariance-determinant estimates for each language and source.

Every text gives counts, and from them a vector of transformed rates. For each (lang, source) three estimates start at the medians:
with the median absolute deviations alone, with the covariance of the rows' directions (spatial signs), and with that of their
squashed values (tanh). Concentration steps take the mean and covariance of the share of rows that are nearest so far, which never
raises the determinant. After two steps the start with the least determinant goes on until its own falls no more; a last step
reweights with all rows inside the 97.5 % bound. The share's bound is exact in groups of any size: by an approximate one, determinants
of large groups rise and fall in turn, and the steps never end. Rates that hardly vary in a group (no symbols anywhere, say) would make its
covariance singular, so each rate has a least standard deviation, added to the diagonal. A row is rejected when its squared
Mahalanobis distance is over the chi-square bound. A group too small for an estimate of its own is judged by that of all rows of its
language, and where those are too few as well, by that of all rows. All of it is DataFrame expressions and grouped sums over all
rows: a group of any size is pre-aggregated, and only one row of estimates a group and start moves.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, let, written

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Rates of the vector, with the least standard deviation of each.
RATES = {"length": 0.06, "symbols": 0.25, "capitals": 0.15, "marks": 0.25, "lines": 0.3, "repeats": 0.25}
P = len(RATES)
#: Share of rows in a concentration step, steps of all starts, rows that an estimate needs, and the level of rejection.
SHARE, FIRST_STEPS, LEAST_ROWS, LEVEL = 0.75, 2, 30, 0.99999
#: Logarithm by which the determinant of a group must fall for another step.
LEAST_FALL = 1e-6
#: Accuracy of approximate percentiles, whose rank is off by a share of 1 / ACCURACY at most; up to so many rows they are exact.
ACCURACY = 10_000
_BLANK = r"[\x20\x09-\x0D]"


def chi_square_cdf(x: float, p: int) -> float:
    """For an even p."""
    term, total = 1.0, 1.0
    for k in range(1, p // 2):
        term *= x / 2 / k
        total += term
    return 1 - math.exp(-x / 2) * total


def chi_square_quantile(level: float, p: int) -> float:
    lo, hi = 0.0, 500.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square_cdf(mid, p) < level else (lo, mid)
    return hi


def consistency(share: float, p: int) -> float:
    """Makes the covariance of the nearest share of normal rows that of all of them."""
    return share / chi_square_cdf(chi_square_quantile(share, p), p + 2)


def _repeat_words(words: Column) -> Column:
    """Words inside any run of eight words that the text holds twice or more."""

    def joined(a: Column, skip: int) -> Column:
        n = F.size(a) - skip
        return F.when(n > 0, F.zip_with(F.slice(a, 1, n), F.slice(a, skip + 1, n), lambda x, y: F.xxhash64(x, y))).otherwise(F.array().cast("array<bigint>"))

    def covered(runs: Column) -> Column:
        placed = F.sort_array(F.transform(runs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        again = lambda s: F.array_sort(F.filter(F.transform(s, lambda x, k: F.when((x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]), x["i"])), lambda i: i.isNotNull()))
        return let(placed, lambda s: let(again(s), lambda p: F.aggregate(F.transform(p, lambda i, k: F.coalesce(F.least(F.get(p, k + 1) - i, F.lit(8)), F.lit(8))), F.lit(0), lambda a, x: a + x)))

    eights = let(F.transform(words, lambda w: F.xxhash64(w)), lambda one: let(joined(one, 1), lambda two: let(joined(two, 2), lambda four: joined(four, 4))))
    return let(eights, lambda e: F.when(F.size(F.array_distinct(e)) == F.size(e), F.lit(0)).otherwise(covered(e)))


def statistics(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """The columns keep of docs with the columns q_* : the counts of each whole text, and its vector. A null text counts as one without words."""
    body = F.coalesce(F.col(text), F.lit(""))
    bare = F.btrim(body, F.lit(" \t\n\x0b\x0c\r"))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, _BLANK + "+"))
    of_words = let(words, lambda w: F.struct(F.size(w).alias("n_words"), F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x)).alias("word_chars"), _repeat_words(w).alias("n_repeat_words")))
    of_lines = let(F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
    counted = docs.withColumns({"q_w": of_words, "q_l": of_lines, "q_n_symbols": F.regexp_count(body, F.lit(r"[#*$%&|<>]")), "q_capitals": F.regexp_count(body, F.lit(r"\p{Lu}")), "q_marks": F.regexp_count(body, F.lit(r"[!?]"))})
    n = {k: F.col(f"q_w.{k}" if k in ("n_words", "word_chars", "n_repeat_words") else f"q_l.{k}" if k in ("n_lines", "n_dup_lines") else f"q_{k}").cast("long") for k in (*COUNTS, "n_lines", "capitals", "marks")}
    words20 = n["n_words"] + 20
    vector = {
        "length": F.log((n["word_chars"] + 100) / words20),
        "symbols": F.log1p(20 * n["n_symbols"] / words20),
        "capitals": F.log1p(10 * n["capitals"] / (n["word_chars"] + 100)),
        "marks": F.log1p(20 * n["marks"] / words20),
        "lines": F.log1p(10 * n["n_dup_lines"] / (n["n_lines"] + 5)),
        "repeats": F.log1p(10 * n["n_repeat_words"] / words20),
    }
    failed = (n["n_words"] < 20) | (100 * n["n_repeat_words"] > 30 * n["n_words"])
    return counted.select(*[F.col(f"`{c}`") for c in keep], *[n[k].alias(f"q_{k}") for k in COUNTS], failed.alias("q_base_failed"), *[v.alias(f"q_x{i}") for i, v in enumerate(vector.values())])


def _precision(moments: DataFrame, keys: list[str], factor: float) -> DataFrame:
    """Means m* and the inverse p* of factor times the covariance c*, with the least deviations on its diagonal; det, the logarithm of its determinant."""
    floors = list(RATES.values())
    t = moments.withColumns({f"c{i}{j}": F.col(f"c{i}{j}") * factor + (floors[i] ** 2 if i == j else 0.0) for i in range(P) for j in range(i + 1)})
    for j in range(P):  # Cholesky: c = l l'
        done = lambda i, j=j: reduce(add, [F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)], F.lit(0.0))
        t = t.withColumn(f"l{j}{j}", F.sqrt(F.col(f"c{j}{j}") - done(j)))
        t = t.withColumns({f"l{i}{j}": (F.col(f"c{i}{j}") - done(i)) / F.col(f"l{j}{j}") for i in range(j + 1, P)})
    for j in range(P):  # k = inverse of l
        t = t.withColumn(f"k{j}{j}", 1 / F.col(f"l{j}{j}"))
        for i in range(j + 1, P):
            t = t.withColumn(f"k{i}{j}", -reduce(add, [F.col(f"l{i}{k}") * F.col(f"k{k}{j}") for k in range(j, i)]) / F.col(f"l{i}{i}"))
    precision = {f"p{i}{j}": reduce(add, [F.col(f"k{k}{i}") * F.col(f"k{k}{j}") for k in range(i, P)]) for i in range(P) for j in range(i + 1)}
    det = 2 * reduce(add, [F.log(f"l{j}{j}") for j in range(P)])
    return t.select(*keys, *[f"m{i}" for i in range(P)], *[v.alias(k) for k, v in precision.items()], det.alias("det"))


def _distance() -> Column:
    dx = [F.col(f"q_x{i}") - F.col(f"m{i}") for i in range(P)]
    return reduce(add, [(1 if i == j else 2) * F.col(f"p{i}{j}") * dx[i] * dx[j] for i in range(P) for j in range(i + 1)])


_KEYS = ["q_k0", "q_k1"]
#: Stands for any value of a key; keys of rows begin with + or -.
_ANY = "*"
#: Groups up to which a table of estimates is broadcast (350 bytes each, so 7 MB); above, parts of each group that are joined apart.
BROADCAST_GROUPS, SALTS = 20_000, 64


def _with_groups(rows: DataFrame, groups: DataFrame, small: bool, how: str = "inner", keys: list[str] = _KEYS) -> DataFrame:
    """rows with the row, or rows, of their group. A group may hold any share of the rows, so it isn't gathered: groups go to the rows."""
    if small:
        return rows.join(F.broadcast(groups), keys, how)
    salted = rows.withColumn("q_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    return salted.join(groups.withColumn("q_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), [*keys, "q_salt"], how).drop("q_salt")


_STARTS = [*_KEYS, "start"]


def _moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    sums = [F.avg(f"q_x{i}").alias(f"m{i}") for i in range(P)]
    return rows.groupBy(*keys).agg(*sums, *[F.covar_pop(f"q_x{i}", f"q_x{j}").alias(f"c{i}{j}") for i in range(P) for j in range(i + 1)])


def _starts(rows: DataFrame, small: bool) -> DataFrame:
    """Three first estimates of each group, all at its medians."""
    floors = list(RATES.values())
    medians = [F.percentile_approx(f"q_x{i}", 0.5, ACCURACY).alias(f"m{i}") for i in range(P)]
    centre = written(rows.groupBy(*_KEYS).agg(*medians), "mcd-centre")
    apart = _with_groups(rows, centre, small)
    spread = apart.groupBy(*_KEYS).agg(*[F.percentile_approx(F.abs(F.col(f"q_x{i}") - F.col(f"m{i}")), 0.5, ACCURACY).alias(f"s{i}") for i in range(P)])
    scaled = spread.select(*_KEYS, *[F.greatest(1.4826 * F.col(f"s{i}"), F.lit(floors[i])).alias(f"s{i}") for i in range(P)], *[(1.4826 * F.col(f"s{i}")).alias(f"w{i}") for i in range(P)])
    scale = written(scaled.join(centre, _KEYS), "mcd-scale")
    z = _with_groups(rows, scale, small).select(*_KEYS, *[((F.col(f"q_x{i}") - F.col(f"m{i}")) / F.col(f"s{i}")).alias(f"z{i}") for i in range(P)])
    z = z.withColumn("zz", reduce(add, [F.col(f"z{i}") * F.col(f"z{i}") for i in range(P)]))
    pairs = [(i, j) for i in range(P) for j in range(i + 1)]
    sums = z.groupBy(*_KEYS).agg(
        *[F.avg(F.when(F.col("zz") > 0, F.col(f"z{i}") * F.col(f"z{j}") / F.col("zz")).otherwise(0.0)).alias(f"a{i}{j}") for i, j in pairs],
        *[F.covar_pop(F.tanh(f"z{i}"), F.tanh(f"z{j}")).alias(f"b{i}{j}") for i, j in pairs],
    )
    t = sums.join(scale, _KEYS)
    kinds = (
        lambda i, j: F.col(f"w{i}") ** 2 if i == j else F.lit(0.0),
        lambda i, j: P * F.col(f"a{i}{j}") * F.col(f"s{i}") * F.col(f"s{j}"),
        lambda i, j: F.col(f"b{i}{j}") * F.col(f"s{i}") * F.col(f"s{j}"),
    )
    each = [F.struct(F.lit(k).alias("start"), *[kind(i, j).alias(f"c{i}{j}") for i, j in pairs]) for k, kind in enumerate(kinds)]
    every = t.select(*_KEYS, *[f"m{i}" for i in range(P)], F.explode(F.array(*each)).alias("x")).select(*_KEYS, *[f"m{i}" for i in range(P)], "x.*")
    found = written(_precision(every, _STARTS, 1.0), "mcd-start")
    discard(centre, scale)
    return found


def _concentrated(rows: DataFrame, found: DataFrame, small: bool) -> DataFrame:
    """The estimates from the share of rows that are nearest by found, for each start."""
    far = _with_groups(rows, found, small).withColumn("d", _distance())
    bound, band = _bounds(far, small)
    near = _with_groups(far, bound, small, keys=_STARTS).where("d <= bound")
    after = written(_precision(_moments(near, _STARTS), _STARTS, consistency(SHARE, P)), "mcd-step")
    discard(band)
    return after


def _bounds(far: DataFrame, small: bool) -> tuple[DataFrame, DataFrame]:
    """The distance d up to which the share of each start's rows lies (bound), exactly: that of row ceil(SHARE * n); and a table it reads.

    Up to ACCURACY rows the percentile is that. In larger groups it gives a band around it, 8 / ACCURACY of the rows wide (more only by
    equal distances, which are counted once): those in it and the number below it tell the rank.
    """
    shares = F.array(*[F.lit(SHARE + x / ACCURACY) for x in (-4, 0, 4)])
    band = written(far.groupBy(*_STARTS).agg(F.count("d").alias("n"), F.percentile_approx("d", shares, ACCURACY).alias("q")), "mcd-band")
    exact, large = band.where(F.col("n") <= ACCURACY).select(*_STARTS, F.col("q")[1].alias("bound")), band.where(F.col("n") > ACCURACY)
    if large.isEmpty():
        return exact, band
    upper = _with_groups(far, large, small, keys=_STARTS).where(F.col("d") <= F.col("q")[2])
    counts = upper.groupBy(*_STARTS, F.when(F.col("d") >= F.col("q")[0], F.col("d")).alias("bound")).agg(F.count("*").alias("rows"), F.first("n").alias("n"))
    upto = F.sum("rows").over(Window.partitionBy(*_STARTS).orderBy(F.col("bound").asc_nulls_first()))
    reached = counts.withColumn("upto", upto).where(F.col("upto") >= F.ceil(SHARE * F.col("n")))
    return exact.unionByName(reached.groupBy(*_STARTS).agg(F.min("bound").alias("bound"))), band


def pools(stats: DataFrame) -> DataFrame:
    """q_k0, q_k1 of each group with judge, the pool that it is judged by, and joined, the pools that its rows are part of.

    A pool is a struct of q_k0, q_k1: a group with enough rows, a language (q_k1 is _ANY), or all rows (both are); the smallest with
    enough rows judges a group, none does where even all rows are too few. Only pools that judge a group have rows.
    """
    groups = stats.groupBy(*_KEYS).agg(F.count_if(~F.col("q_base_failed")).alias("n"))
    groups = written(groups, "mcd-groups")
    langs = groups.groupBy("q_k0").agg(F.sum("n").alias("of_lang"), (F.min("n") < LEAST_ROWS).alias("lang_judges"))
    every = langs.agg(F.coalesce(F.sum("of_lang"), F.lit(0)).alias("of_all"), F.coalesce(F.max(F.col("of_lang") < LEAST_ROWS), F.lit(False)).alias("all_judge")).first()
    pool = lambda a, b: F.struct(a.alias("q_k0"), b.alias("q_k1"))
    own, lang, whole = pool(F.col("q_k0"), F.col("q_k1")), pool(F.col("q_k0"), F.lit(_ANY)), pool(F.lit(_ANY), F.lit(_ANY))
    enough = {n: F.col(n) >= LEAST_ROWS for n in ("n", "of_lang", "of_all")}
    joined = F.array(F.when(enough["n"], own), F.when(enough["of_lang"] & F.col("lang_judges"), lang), F.when(enough["of_all"] & F.col("all_judge"), whole))
    judge = F.when(enough["n"], own).when(enough["of_lang"], lang).when(enough["of_all"], whole)
    totals = {"of_all": F.lit(every["of_all"]), "all_judge": F.lit(every["all_judge"])}
    return groups.join(langs, "q_k0").withColumns(totals).select(*_KEYS, judge.alias("judge"), F.array_compact(joined).alias("joined"))


def estimates(stats: DataFrame) -> tuple[DataFrame, bool]:
    """Means and precision for each group of q_k0, q_k1 (no nulls), its own or a pool's, and whether they are few enough to broadcast.

    Each step is a small table in the shared folder; so are the rows' vectors, once for each pool that they are part of.
    """
    placed = written(pools(stats), "mcd-pools")
    small = placed.count() <= BROADCAST_GROUPS
    passed = stats.where(~F.col("q_base_failed")).select(*_KEYS, *[f"q_x{i}" for i in range(P)])
    apart = _with_groups(passed, placed.select(*_KEYS, "joined"), small).withColumn("pool", F.explode("joined"))
    rows = written(apart.select("pool.*", *[f"q_x{i}" for i in range(P)]), "mcd-rows")
    found = _starts(rows, small)
    for _ in range(FIRST_STEPS):
        found, old = _concentrated(rows, found, small), found
        discard(old)
    best = found.groupBy(*_KEYS).agg(F.min_by(F.struct(*[c for c in found.columns if c not in _KEYS]), F.struct("det", "start")).alias("x"))
    found, old = written(best.select(*_KEYS, "x.*", F.lit(True).alias("on")), "mcd-found"), found
    discard(old)
    while not (on := found.where("on").drop("on")).isEmpty():  # a group whose determinant falls no more has ended, and others go on without it
        after = _concentrated(rows, on, small)
        fell = after.select(*_STARTS, F.struct(*[c for c in after.columns if c not in _STARTS]).alias("x"))
        both = found.join(fell, _STARTS, "left").withColumn("on", F.coalesce(F.col("x.det") < F.col("det") - LEAST_FALL, F.lit(False)))
        found, old = written(both.select(*_STARTS, *[F.when(F.col("on"), F.col(f"x.{c}")).otherwise(F.col(c)).alias(c) for c in after.columns if c not in _STARTS], "on"), "mcd-found"), found
        discard(after, old)
    inside = _with_groups(rows, found.drop("on"), small).where(_distance() <= chi_square_quantile(0.975, P))
    found, old = written(_precision(_moments(inside, _KEYS), _KEYS, consistency(0.975, P)), "mcd-final"), found
    judged = placed.select(*[F.col(k).alias(f"own_{k}") for k in _KEYS], "judge.*").where(F.col("q_k0").isNotNull())
    own = written(_with_groups(judged, found, small).drop(*_KEYS).withColumnsRenamed({f"own_{k}": k for k in _KEYS}), "mcd-groups-final")
    discard(old, found, rows, placed)
    return own, small


def quality(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", level: float = LEVEL, keep: list[str] | None = None) -> DataFrame:
    """The columns keep of docs (None: all) with q_n_words, q_word_chars, q_n_symbols, q_n_dup_lines, q_n_repeat_words, q_base_failed, q_kept, q_distance.

    Null languages and sources are groups of their own. A group with fewer than LEAST_ROWS rows that pass the base rules is judged
    by the estimate of its language's rows, or of all rows if those are too few. If all rows together are too few, there is no
    estimate: none that passes is rejected, and distances are null. Empty and null texts fail the base rules. Repeated rows count each
    time. Columns of docs come back as they were; names that begin with q_ are replaced.
    """
    keep = [c for c in keep or docs.columns if not c.startswith("q_")]
    groups = {k: F.concat(F.when(F.col(c).isNull(), "-").otherwise("+"), F.coalesce(F.col(c).cast("string"), F.lit(""))) for k, c in zip(_KEYS, (lang, source), strict=True)}
    stats = written(statistics(docs.withColumns(groups), text, [*keep, *_KEYS]), "quality")
    judged = _with_groups(stats, *estimates(stats), "left").withColumn("q_distance", _distance())
    kept = ~F.col("q_base_failed") & F.coalesce(F.col("q_distance") <= chi_square_quantile(level, P), F.lit(True))
    return judged.select(*[F.col(f"`{c}`") for c in keep], *[f"q_{k}" for k in COUNTS], "q_base_failed", kept.alias("q_kept"), "q_distance")
