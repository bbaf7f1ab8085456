"""Line dedup: drop lines that many documents share.

Lines are exploded as 128-bit hashes of their normalised keys (never as text) with their positions,
documents are counted per hash, hashes over the threshold go back to the documents that hold them, and
each text is put together again from the lines at the remaining positions, in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import LOWER, UPPER, WHITE, lower_ascii, table, text_of, written


def line_key(line: Column) -> Column:
    """A line without white space at either end, A-Z lower-cased."""
    return lower_ascii(F.btrim(line, F.lit(WHITE)))


def _hash(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key).alias("_a"), F.xxhash64(F.lit(1), key).alias("_b")


def drop_common_lines(docs: DataFrame, min_docs: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without lines whose key stands in at least ``min_docs`` documents.

    Returns the input's columns with the text replaced, plus ``n_lines`` (before dropping) and
    ``n_dropped``, both long; input columns of those two names are replaced.

    Null or empty text is one empty line. Empty keys are never dropped. Rows of one id are one document
    and count once; of rows without id, those of equal text are. Every row is kept. An empty table gives
    an empty table. Work grows with a text's lines, however many of them are dropped.
    """
    text = text_of(docs, text_col)
    lines = F.split(text, "\n", -1)
    # a row by its id and its text, so that positions of rows that repeat an id do not mix
    who = [F.col(id_col).alias("_id"), F.xxhash64(text).alias("_t")]
    each = docs.select(*who, F.posexplode(F.transform(lines, line_key)).alias("_p", "_k")).where(F.col("_k") != "")
    hashed = each.select("_id", "_t", "_p", *_hash(F.col("_k")))
    # dealt by line and document: the distinct documents of a line need no further shuffle, and a line of many is spread
    owner = F.when(F.col("_id").isNull(), F.col("_t")).alias("_n")
    dealt = hashed.withColumn("_n", owner).repartition("_a", "_b", "_id", "_n")
    held = written(dealt.groupBy("_a", "_b", "_id", "_n", "_t").agg(F.collect_list("_p").alias("_ps")), "lines")
    counted = held.select("_a", "_b", "_id", "_n").distinct().groupBy("_a", "_b").agg(F.count(F.lit(1)).alias("_c"))
    common = written(counted.where(F.col("_c") >= min_docs).drop("_c"), "common-lines")  # so that the join reads two plain shuffles, of which a hot line's can be split
    drops = held.drop("_n").join(common, ["_a", "_b"]).groupBy("_id", "_t").agg(F.flatten(F.collect_list("_ps")).alias("_drop"))

    rest = [c for c in docs.columns if c not in (text_col, "n_lines", "n_dropped")]
    base = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)], lines.alias("_lines"), F.col(id_col).alias("_key"), F.xxhash64(text).alias("_hash"))
    both = base.join(drops, F.col("_key").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_t")), "left")
    n = F.size("_lines")
    left = F.array_except(F.sequence(F.lit(0), n - 1), "_drop")  # by a hash set, in order
    kept = F.when(F.col("_drop").isNull(), F.col("_lines")).otherwise(F.transform(left, lambda i: F.get("_lines", i)))
    out = both.withColumn("_kept", kept)
    return out.select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(rest)],
        F.array_join("_kept", "\n").alias(text_col),
        n.cast("long").alias("n_lines"),
        (n - F.size("_kept")).cast("long").alias("n_dropped"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op3_line_dedup."""
    out = drop_common_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = f"""
WITH lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
    FROM documents),
keyed AS (
    SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key
    FROM lines),
common AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(c.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
FROM keyed k LEFT JOIN common c ON k.key = c.key
GROUP BY doc_id
"""
