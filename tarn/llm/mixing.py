"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed by cell of source, language and topic. The cells' weights are raked in turn to the
target share of every source, language and topic, until all marginal shares stand within a tolerance of
their targets. A document is then taken with a probability in proportion to its cell's weight over its
cell's tokens, so that the expected tokens of the sample stand in the raked proportions. Draws are a
hash of the id.

The sample's size is a stated number of tokens, or as large as it can be with no probability above 1.
Where one tiny cell would so leave less than a stated share of the documents, that share sets the
size instead: probabilities are raised alike, and what is over 1 goes to the other cells.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tarn.llm.common import WHITE, table, text_of, written

#: A value's target share goes as its share of the corpus to this power: rare values are raised.
POWER = 0.7
#: Sweeps over the three dimensions at most; the gap between a marginal share and its target at which they end.
SWEEPS, TOLERANCE = 12, 1e-12
#: Share of the documents that a sample is expected to hold at least.
LEAST_SHARE = 0.25
DIMS = ("source", "lang", "topic")
#: Words from which a text is of medium length, and long.
MEDIUM, LONG = 128, 1024


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[^{WHITE}]+")).cast("long")


def length_topic(words: Column) -> Column:
    """Length band: the topic of tables that name none."""
    return F.when(words < MEDIUM, "short").when(words < LONG, "medium").otherwise("long")


def draw(id_col: Column) -> Column:
    """A number from 0 up to 1 that depends on the id alone."""
    digits = F.substring(F.md5(F.coalesce(id_col.cast("string"), F.lit(""))), 1, 13)
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(16**13))


def raked(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, power: float = POWER, sweeps: int = SWEEPS, tolerance: float = TOLERANCE) -> DataFrame:
    """Cells (source, lang, topic, tokens) with ``weight``, raked to the targets.

    ``targets`` gives a dimension's values their target weights, in any unit; values that it does not
    name have none and get no weight, and what it names but no cell has is left out of the shares. A
    dimension without targets goes as ``power`` of its values' shares of the corpus. Each step is a
    window over one dimension's values; weights sum to 1 after each. Cells are far fewer than documents,
    but need not fit anywhere. Targets that contradict each other end at the last sweep. Other columns are kept.
    """
    targets = targets or {}
    if unknown := set(targets) - set(DIMS):
        raise ValueError(f"no dimension {sorted(unknown)}")
    total = cells.agg(F.sum("tokens").alias("s")).first()["s"] or 1
    out = cells.withColumn("weight", F.col("tokens") / F.lit(float(total)))
    for d in DIMS:
        shares = out.groupBy(d).agg(F.pow(F.sum("tokens") / F.lit(float(total)), F.lit(power)).alias("p"))
        if d in targets:
            given = F.create_map(*[F.lit(x) for k, v in targets[d].items() for x in (k, float(v))])
            shares = shares.select(d, F.coalesce(F.try_element_at(given, F.col(d)), F.lit(0.0)).alias("p"))
        scale = shares.agg(F.sum("p").alias("s")).first()["s"] or 1.0
        out = out.join(shares.select(d, (F.col("p") / F.lit(scale)).alias(f"to_{d}")), d)
    for _ in range(sweeps):
        for d in DIMS:
            have = F.sum("weight").over(W.partitionBy(d))
            out = out.withColumn("weight", F.when(have > 0, F.col("weight") * F.col(f"to_{d}") / have).otherwise(F.lit(0.0)))
        gaps = [F.abs(F.sum("weight").over(W.partitionBy(d)) - F.col(f"to_{d}")) for d in DIMS]
        out = written(out.withColumn("gap", F.greatest(*gaps)), "raked")
        widest = out.agg(F.max("gap").alias("g")).first()["g"]
        out = out.drop("gap")
        if widest is None or widest <= tolerance:
            break
    return out.drop(*[f"to_{d}" for d in DIMS])


def unit(cells: DataFrame, least: float = LEAST_SHARE, budget: float | None = None) -> float:
    """The weight per token that is drawn with probability 1; cells (docs, tokens, weight) above it are taken whole.

    With a ``budget`` that many tokens are expected, or all where there are fewer. Without, it is the
    largest of any cell, unless fewer than ``least`` of the documents are then expected. Each round
    takes the cells above the unit whole and spreads the rest; they only grow in number.
    """
    rate, size = F.col("weight") / F.col("tokens"), "docs" if budget is None else "tokens"
    first = cells.agg(F.max(rate).alias("most"), F.sum(size).alias("n"), F.sum(F.col(size) * rate).alias("drawn")).first()
    if not first["n"] or not first["most"]:
        return 1.0
    at, wanted, whole = first["most"], least * first["n"] if budget is None else min(budget, first["n"]), 0
    if budget is None and first["drawn"] / at >= wanted or not wanted:
        return at if wanted else math.inf
    at = first["drawn"] / wanted
    while True:
        over = rate >= F.lit(at)
        row = cells.agg(F.count(F.when(over, 1)).alias("k"), F.sum(F.when(over, F.col(size)).otherwise(0)).alias("n"), F.sum(F.when(over, 0.0).otherwise(F.col(size) * rate)).alias("drawn")).first()
        if row["k"] <= whole or row["n"] >= wanted or not row["drawn"]:
            return at
        whole, at = row["k"], row["drawn"] / (wanted - row["n"])


def mixed(
    docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", topic: Column | None = None, targets: dict[str, dict[str, float]] | None = None, budget: float | None = None
) -> DataFrame:
    """The documents with n_tokens, topic, weight (of their cell), probability and kept.

    ``targets`` are target weights by dimension (source, lang, topic) and value, ``budget`` the tokens
    that the sample is expected to hold; see ``raked`` and ``unit`` for what stands in without them.
    ``topic`` is an expression over the documents; without it the length band stands in. Null source,
    language or topic counts as an empty one; an empty text weighs as one token, so that it can be
    drawn. Repeated rows weigh each; rows of one id are drawn together. Input columns of the added
    names are replaced. An empty table gives an empty table.
    """
    words = n_words(text_of(docs, text_col))
    named = {"_source": F.coalesce(F.col("source"), F.lit("")), "_lang": F.coalesce(F.col("lang"), F.lit(""))}
    base = docs.withColumns(named | {"n_tokens": words})
    base = base.withColumn("topic", F.coalesce(topic, F.lit("")) if topic is not None else length_topic(F.col("n_tokens")))
    cells = base.groupBy(F.col("_source").alias("source"), F.col("_lang").alias("lang"), "topic").agg(F.sum(F.greatest("n_tokens", F.lit(1))).alias("tokens"), F.count(F.lit(1)).alias("docs"))
    fitted = raked(written(cells, "cells"), targets)
    probability = F.least(F.lit(1.0), F.col("weight") / F.col("tokens") / F.lit(unit(fitted, budget=budget)))
    keyed = written(fitted.select(F.col("source").alias("_source"), F.col("lang").alias("_lang"), "topic", "weight", probability.alias("probability")), "mix")
    out = base.drop("weight", "probability", "kept").join(keyed, ["_source", "_lang", "topic"]).drop("_source", "_lang")
    return out.withColumn("kept", draw(F.col(id_col)) < F.col("probability"))


def query(spark, sf_dir: str) -> DataFrame:
    """op2_source_mixing."""
    out = mixed(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"))
    return out.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("weight", 9).alias("weight"), F.round("probability", 9).alias("probability"), "kept")


def sql(documents: str = "documents") -> str:
    """DuckDB SQL for the query's rows over a table of documents."""
    steps, last = [], "start"
    for s in range(SWEEPS):
        for d in DIMS:
            steps.append(f"s{s}_{d} AS (SELECT * REPLACE (weight * to_{d} / sum(weight) OVER (PARTITION BY {d}) AS weight) FROM {last})")
            last = f"s{s}_{d}"
    shares = ",\n".join(f"share_{d} AS (SELECT {d}, pow(sum(tokens) / (SELECT s FROM total), {POWER}) AS p FROM cells GROUP BY {d})" for d in DIMS)
    joins = " ".join(f"JOIN share_{d} USING ({d})" for d in DIMS)
    targets = ", ".join(f"share_{d}.p / (SELECT sum(p) FROM share_{d}) AS to_{d}" for d in DIMS)
    return f"""
WITH counted AS (
    SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
           len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens
    FROM {documents}),
placed AS (SELECT *, CASE WHEN n_tokens < {MEDIUM} THEN 'short' WHEN n_tokens < {LONG} THEN 'medium' ELSE 'long' END AS topic FROM counted),
cells AS (SELECT source, lang, topic, sum(greatest(n_tokens, 1))::DOUBLE AS tokens FROM placed GROUP BY ALL),
total AS (SELECT sum(tokens) AS s FROM cells),
{shares},
start AS (SELECT cells.*, tokens / (SELECT s FROM total) AS weight, {targets} FROM cells {joins}),
{",".join(steps)},
most AS (SELECT max(weight / tokens) AS m FROM {last}),
drawn AS (
    SELECT doc_id, p.source, p.lang, p.topic, p.n_tokens, weight, weight / tokens / (SELECT m FROM most) AS probability,
           ('0x' || substr(md5(doc_id::VARCHAR), 1, 13))::BIGINT / {float(16**13)} AS u
    FROM placed p JOIN {last} USING (source, lang, topic))
SELECT doc_id, source, lang, topic, n_tokens::BIGINT AS n_tokens, round(weight, 9) AS weight, round(probability, 9) AS probability, u < probability AS kept
FROM drawn
"""


SQL = sql()
