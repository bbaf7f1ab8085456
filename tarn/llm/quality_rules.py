"""Quality rules: base rules, then robust multivariate outliers.

Every document has a vector of transformed statistics. For each language and source a
minimum-covariance-determinant estimate is sought: from several starts, the share ``HELD`` of the
rows that lie closest gives the next centre and covariance, until the determinant falls no more; the
smallest determinant wins. A covariance is mixed with that of the wider estimate (of the language, and
that of all rows) as if ``PRIOR`` rows of it had been seen, which no step can make worse, and for the
verdict the centre is too. So a group of any size has its own estimate, and a small one leans on its
language's. Documents beyond a quantile of the chi-square distribution are rejected by their
Mahalanobis distance.

Each step is one aggregation: roots of distances are counted in cells of fixed width with the sums of
their rows, and the nearest cells that make up the share are added up. Statistics are whole multiples of
1 / ``GRID`` and sums are those of whole numbers, so the outcome does not hang on partitions or order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.llm.common import WHITE, lean, modest, table, written
from tarn.llm.jaccard_join import _Hashes, mixed

SYMBOLS = "#*$%&|<>"
#: The statistics of a vector and the least spread each is given, so that constant ones do not make a covariance singular.
FLOORS = {"word_length": 0.06, "symbols": 0.5, "dup_lines": 0.12, "repeats": 0.12, "capitals": 0.04}
P = len(FLOORS)
#: Share of a group that an estimate rests on; probability of rejecting a sound document.
HELD, REJECTED = 0.75, 1e-7
#: Rows that the wider estimate counts for; steps of a statistic, and of those of the first medians; cells of a distance of 1.
PRIOR, GRID, COARSE, CELLS = 100, 1024, 8, 64
#: Steps of every start before the best of them goes on; the least fall of the log determinant that counts.
TRIALS, FALL = 2, 1e-4
#: Estimates that are broadcast to the rows (under 1 KB each); copies that more of them are dealt out in.
FEW, COPIES = 8192, 32
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def chi2_cdf(x: float, k: int) -> float:
    """The chi-square distribution, by the series of the incomplete gamma function."""
    a, z = k / 2, x / 2
    if z <= 0:
        return 0.0
    term = total = 1 / a
    for n in range(1, 1000):
        term *= z / (a + n)
        total += term
        if term < total * 1e-16:
            break
    return total * math.exp(-z + a * math.log(z) - math.lgamma(a))


def chi2_quantile(p: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < p else (low, mid)
    return (low + high) / 2


def repeated_words(words: list[bytes], hashes: dict) -> int:
    """Words that stand in a 3-word window which the text holds twice or more."""
    if len(words) < 4:
        return 0
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    k = np.uint64(0x9E3779B97F4A7C15)
    windows = mixed(mixed(mixed(w[:-2]) * k + w[1:-1]) * k + w[2:])
    _, inverse, counts = np.unique(windows, return_inverse=True, return_counts=True)
    again = counts[inverse] > 1
    covered = np.zeros(len(w), bool)
    for i in range(3):
        covered[i : i + len(again)] |= again
    return int(covered.sum())


def measures(text: str | None, hashes: dict) -> tuple[list[int], list[float]]:
    """The base counts and the transformed vector of one text."""
    text = text or ""
    raw = text.encode("utf-8", "replace")
    words = raw.split()  # bytes: ASCII white space only
    n = len(words)
    chars = len(text) - sum(map(text.count, WHITE))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(WHITE)]
    dup = len(lines) - len(set(lines))
    repeats = repeated_words(words, hashes)
    letters = np.frombuffer(raw, np.uint8)
    upper = int(((letters >= 65) & (letters <= 90)).sum())
    of = max(n, 1)
    vector = [math.log(max(chars, 1) / of), math.log1p(100 * symbols / of), dup / max(len(lines), 1), repeats / of, upper / max(chars, 1)]
    return [n, chars, symbols, dup, repeats], vector


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows without the text, with the base counts, ``base_failed`` and ``_x``, the vector in steps of 1 / GRID."""
    rest = [f for f in docs.schema.fields if f.name != text_col and f.name not in (*BASE, "base_failed", "_x")]
    schema = T.StructType([*rest, *(T.StructField(c, T.LongType(), False) for c in BASE), T.StructField("_x", T.ArrayType(T.LongType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            both = [measures(t, hashes) for t in batch.column(text_col).to_pylist()]
            counts = np.array([c for c, _ in both], np.int64).reshape(len(both), len(BASE))
            vectors = pa.array([[round(GRID * x) for x in v] for _, v in both], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in rest), *(pa.array(counts[:, i]) for i in range(len(BASE))), vectors], schema.names)

    out = modest(docs.select(*[F.col(f"`{f.name}`") for f in rest], text_col)).mapInArrow(lean(run), schema)
    return out.withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))


_PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
_FLOOR = np.diag(np.array(list(FLOORS.values())) ** 2)
_ESTIMATE = "_g string, start int, mu array<double>, inv array<double>, cov array<double>, logdet double, h double"


def consistency(alpha: float = HELD) -> float:
    """What makes the covariance of the closest share of normal rows that of all."""
    return alpha / chi2_cdf(chi2_quantile(alpha, P), P + 2)


def settled(n: float, s: np.ndarray, ss: np.ndarray, target: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, float]:
    """Centre, covariance (with floors, mixed with ``target``) and its log determinant from count, sums and sums of products."""
    mu = s / n
    cov = consistency() * (ss / n - np.outer(mu, mu)) + _FLOOR
    if target is not None:
        own = n / (n + PRIOR)
        cov = own * cov + (1 - own) * target
    return mu, cov, float(np.linalg.slogdet(cov)[1])


def _square(flat) -> np.ndarray:
    out = np.zeros((P, P))
    out[np.triu_indices(P)] = flat
    return np.triu(out) + np.triu(out, 1).T


def _settle(sums: DataFrame) -> DataFrame:
    """(_g, start, h, s, ss, target) to estimates; one small row a group and start."""

    def run(batches):
        for batch in batches:
            rows = []
            for g, start, h, s, ss, target in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                mu, cov, logdet = settled(h, np.array(s) / GRID, _square(ss) / GRID**2, None if target is None else np.array(target).reshape(P, P))
                rows.append((g, start, mu.tolist(), np.linalg.inv(cov).ravel().tolist(), cov.ravel().tolist(), logdet, h))
            listed = pa.list_(pa.float64())
            kinds = [pa.string(), pa.int32(), listed, listed, listed, pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["_g", "start", "mu", "inv", "cov", "logdet", "h"])

    return sums.select("_g", "start", "h", "s", "ss", "target").mapInArrow(lean(run), _ESTIMATE)


def _x(i: int) -> str:
    return f"_x[{i}]"


def squared(mu: str = "mu") -> Column:
    """The squared distance of ``_x`` under ``mu`` and ``inv``, added up in one order."""
    total = F.lit(0.0)
    for i in range(P):
        inner = F.lit(0.0)
        for j in range(P):
            inner = inner + F.expr(f"(_x[{j}] / {float(GRID)}D - {mu}[{j}]) * inv[{i * P + j}]")
        total = total + F.expr(f"_x[{i}] / {float(GRID)}D - {mu}[{i}]") * inner
    return F.greatest(F.lit(0.0), total)


def _beside(rows: DataFrame, params: DataFrame, how: str = "inner") -> DataFrame:
    """The rows with the columns of their group's estimates.

    Up to ``FEW`` estimates, as counted, are broadcast. More are dealt out in copies, so that the rows of a
    group are spread over as many tasks.
    """
    if params.limit(FEW + 1).count() <= FEW:
        return rows.join(F.broadcast(params), "_g", how)
    copies = params.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
    return rows.withColumn("_copy", F.pmod(F.xxhash64("_x"), F.lit(COPIES)).cast("int")).join(copies, ["_g", "_copy"], how).drop("_copy")


def _sums() -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), *[F.sum(F.expr(_x(i))).alias(f"s{i}") for i in range(P)], *[F.sum(F.expr(f"{_x(i)} * {_x(j)}")).alias(f"s{i}_{j}") for i, j in _PAIRS]]


_SUMMED = [f"s{i}" for i in range(P)] + [f"s{i}_{j}" for i, j in _PAIRS]


def _packed(df: DataFrame) -> DataFrame:
    return df.withColumn("s", F.array(*[F.col(f"s{i}").cast("double") for i in range(P)])).withColumn("ss", F.array(*[F.col(f"s{i}_{j}").cast("double") for i, j in _PAIRS]))


def _closest(rows: DataFrame, params: DataFrame) -> DataFrame:
    """(_g, start, h, s, ss): sums over the closest share of each group's rows under each of its estimates.

    Rows of the cell in which the share is reached weigh alike, so that together they make it up.
    """
    cell = F.floor(F.sqrt(F.sqrt(squared())) * CELLS).alias("cell")
    cells = _beside(rows, params.select("_g", "start", "mu", "inv")).select("_g", "start", "_x", cell).groupBy("_g", "start", "cell").agg(*_sums())
    w = W.partitionBy("_g", "start").orderBy("cell").rowsBetween(W.unboundedPreceding, W.currentRow)
    reach = cells.withColumn("up", F.sum("n").over(w)).withColumn("all", F.sum("n").over(W.partitionBy("_g", "start")))
    h = F.floor((F.col("all") * int(HELD * 100) + 99) / 100)
    part = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (h - (F.col("up") - F.col("n"))) / F.col("n")))
    inside = reach.withColumn("part", part).where("part > 0")
    # whole cells as whole numbers; the one last cell by its part
    whole = [F.sum(F.when(F.col("part") >= 1, F.col(c)).otherwise(0)) + F.coalesce(F.max(F.when(F.col("part") < 1, F.col(c) * F.col("part"))), F.lit(0.0)) for c in _SUMMED]
    return _packed(inside.groupBy("_g", "start").agg(F.max(h).cast("double").alias("h"), *[x.alias(c) for x, c in zip(whole, _SUMMED, strict=True)]))


def _starts(rows: DataFrame, wider: DataFrame | None) -> DataFrame:
    """First estimates of each group: 0 mean and covariance of all its rows, 1 medians and quartiles, 2 the wider estimate."""
    target = F.lit(None).cast("array<double>").alias("target")
    every = _packed(rows.groupBy("_g").agg(*_sums())).select("_g", F.lit(0).alias("start"), F.col("n").cast("double").alias("h"), "s", "ss", target)
    coarse = F.transform("_x", lambda v: F.floor(v / COARSE) * COARSE)
    values = rows.select("_g", F.posexplode(coarse).alias("i", "v")).groupBy("_g", "i", "v").agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy("_g", "i").orderBy("v").rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = values.withColumn("up", F.sum("n").over(w)).withColumn("all", F.sum("n").over(W.partitionBy("_g", "i")))
    cut = [F.min(F.when(F.col("up") * 4 >= F.col("all") * q, F.col("v"))).alias(f"q{q}") for q in (1, 2, 3)]
    quarter = ranked.groupBy("_g", "i").agg(*cut).groupBy("_g").agg(F.sort_array(F.collect_list(F.struct("i", "q1", "q2", "q3"))).alias("q"))
    floors = list(FLOORS.values())
    spread = [F.expr(f"1.0D / (power((q[{i}].q3 - q[{i}].q1) / ({GRID}D * 1.349D), 2) + {floors[i] ** 2}D)") for i in range(P)]
    middle = quarter.select(
        "_g", F.lit(1).alias("start"), F.array(*[F.expr(f"q[{i}].q2 / {GRID}D") for i in range(P)]).alias("mu"), F.array(*[spread[i] if i == j else F.lit(0.0) for i in range(P) for j in range(P)]).alias("inv")
    )
    out = _settle(every).select("_g", "start", "mu", "inv").unionByName(middle)
    if wider is not None:
        out = out.unionByName(wider.select("_g", F.lit(2).alias("start"), "mu", "inv"))
    return written(out, "mcd-starts")


def estimates(rows: DataFrame, wider: DataFrame | None = None) -> DataFrame:
    """(_g, mu, inv, cov, h, logdet) of the smallest determinant found, for each group of the rows (_g, _x).

    ``wider`` has (_g, mu, inv, cov) of the wider estimate that a group's covariance is mixed with.
    """

    def step(params: DataFrame) -> DataFrame:
        sums = _closest(rows, params)
        sums = sums.join(wider.select("_g", F.col("cov").alias("target")), "_g", "left") if wider is not None else sums.withColumn("target", F.lit(None).cast("array<double>"))
        return written(_settle(sums), "mcd")

    now = _starts(rows, wider)
    for _ in range(TRIALS):
        now = step(now)
    # ties go to the lesser number of the start
    best = written(now.groupBy("_g").agg(F.min(F.struct("logdet", "start", "mu", "inv", "cov", "h")).alias("b")).select("_g", "b.*", F.lit(True).alias("moving")), "mcd")
    while not best.where("moving").isEmpty():
        after = step(best.where("moving").select("_g", "start", "mu", "inv")).select("_g", *[F.col(c).alias(f"n_{c}") for c in ("logdet", "mu", "inv", "cov", "h")])
        both = best.join(after, "_g", "left")
        falls = F.coalesce(F.col("n_logdet") < F.col("logdet") - FALL, F.lit(False))
        best = written(both.select("_g", "start", *[F.when(falls, F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) for c in ("logdet", "mu", "inv", "cov", "h")], falls.alias("moving")), "mcd")
    return best.drop("moving", "start")


def widened(rows: DataFrame, found: DataFrame, wider: DataFrame | None) -> DataFrame:
    """(_g, mu, inv, cov) to judge by: centres mixed with the wider one's, covariances wide enough for half of the rows.

    The median distance from a group's own centre shows how much wider than normal its rows are spread.
    """
    cell = F.floor(F.sqrt(F.sqrt(squared())) * CELLS).alias("cell")
    cells = _beside(rows, found.select("_g", "mu", "inv")).select("_g", cell).groupBy("_g", "cell").agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy("_g").orderBy("cell").rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = cells.withColumn("up", F.sum("n").over(w)).withColumn("all", F.sum("n").over(W.partitionBy("_g")))
    middle = ranked.where("up * 2 >= all").groupBy("_g").agg(F.min("cell").alias("mid"))
    scale = F.greatest(F.lit(1.0), F.pow((F.col("mid") + 0.5) / CELLS, F.lit(4)) / chi2_quantile(0.5, P))
    out = found.join(middle, "_g").withColumn("scale", scale)
    mu = F.col("mu")
    if wider is not None:
        out = out.join(wider.select("_g", F.col("mu").alias("to")), "_g")
        mu = F.transform("mu", lambda x, i: x * F.col("h") / (F.col("h") + PRIOR) + F.get("to", i) * PRIOR / (F.col("h") + PRIOR))
    return written(out.select("_g", mu.alias("mu"), F.transform("inv", lambda x: x / F.col("scale")).alias("inv"), F.transform("cov", lambda x: x * F.col("scale")).alias("cov")), "mcd-widened")


def judged(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows without the text, with the base counts, ``base_failed``, ``distance`` and ``kept``.

    A row is kept if it passes the base rules and lies within the bound of its language and source,
    whose estimate leans on that of its language, and that on that of all rows, the more the fewer rows
    it rests on. Estimates rest on all rows that pass the base rules. Null language or source counts as
    empty. Null, empty and word-free texts fail the base rules; rows that fail have no distance.
    Repeated rows count each; other columns are kept, but those of the added names are replaced. An
    empty table gives an empty table.
    """
    docs = docs.drop("distance", "kept")
    lang, source = F.coalesce(F.col(lang_col), F.lit("")), F.coalesce(F.col(source_col), F.lit(""))
    key = F.to_json(F.struct(lang.alias("l"), source.alias("s")))
    rows = written(measured(docs, text_col).withColumns({"_l": F.to_json(F.struct(lang.alias("l"))), "_g": key}), "measured")
    sound = rows.where("not base_failed").select("_g", "_l", "_x")
    # all rows and the languages
    pool = sound.select(F.explode(F.array(F.lit(""), "_l")).alias("_g"), "_x")
    coarse = estimates(pool)
    top = widened(pool.where("_g = ''"), coarse.where("_g = ''"), None)
    wide = coarse.where("_g <> ''").select("_g", "h", "mu", "cov").crossJoin(F.broadcast(top.select(F.col("mu").alias("to"), F.col("cov").alias("above"))))
    languages = widened(pool, _leaning(wide), wide.select("_g", F.col("to").alias("mu")))
    # the languages and sources
    groups = written(sound.select("_g", "_l").distinct(), "groups")
    wider = written(groups.join(languages.withColumnRenamed("_g", "_l"), "_l").drop("_l"), "mcd-wider")
    own = sound.drop("_l")
    final = widened(own, estimates(own, wider), wider)
    judge = _beside(rows, final.select("_g", "mu", "inv"), "left").withColumn("distance", F.when(~F.col("base_failed"), F.sqrt(squared())))
    bound = math.sqrt(chi2_quantile(1 - REJECTED, P))
    return judge.drop("_g", "_l", "_x", "mu", "inv").withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= bound, F.lit(False)))


def _leaning(wide: DataFrame) -> DataFrame:
    """Estimates (_g, h, mu, cov, above) with the covariance mixed with the one above; one small row a language."""

    def run(batches):
        for batch in batches:
            rows = []
            for g, h, mu, cov, above in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                own = h / (h + PRIOR)
                both = own * np.array(cov) + (1 - own) * np.array(above)
                rows.append((g, 0, mu, np.linalg.inv(both.reshape(P, P)).ravel().tolist(), both.tolist(), 0.0, h))
            listed = pa.list_(pa.float64())
            kinds = [pa.string(), pa.int32(), listed, listed, listed, pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["_g", "start", "mu", "inv", "cov", "logdet", "h"])

    return written(wide.select("_g", "h", "mu", "cov", "above").mapInArrow(lean(run), _ESTIMATE), "mcd-languages")


def query(spark, sf_dir: str) -> DataFrame:
    """op6_quality_rules."""
    out = judged(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return out.select("doc_id", *BASE, "base_failed", "kept", "distance")
