"""Full-text search ranked by BM25 over exploded terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable


def terms(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda x: x != "")


def bm25(docs: DataFrame, key: str, text: str, query: str, top: int = 100, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, score) of the ``top`` documents for ``query``, best first, ties by key.

    Only the query's terms are exploded, so what is shuffled is their postings; lengths and document counts cover all
    documents. Null texts have no terms. An empty query finds nothing.
    """
    asked = sorted({w for w in query.lower().split() if w})
    if not asked:
        return docs.select(key, F.lit(0.0).alias("score")).limit(0)
    # a text is cut into terms once; what is kept of it are its length and the query's terms
    told = F.transform(F.array(terms(F.col(text))), lambda t: F.struct(F.size(t).alias("len"), F.filter(t, lambda x: x.isin(asked)).alias("met")))[0]
    sized = durable(docs.where(F.col(text).isNotNull()).select(F.col(key).alias("__key"), told.alias("__t")).select("__key", F.col("__t.len").alias("__len"), F.col("__t.met").alias("__met")))
    n, mean = sized.agg(F.count(F.lit(1)), F.coalesce(F.avg("__len"), F.lit(1.0))).first()
    hits = sized.select(F.col("__key").alias(key), "__len", F.explode("__met").alias("__w")).groupBy(key, "__len", "__w").agg(F.count(F.lit(1)).alias("__tf"))
    df = hits.groupBy("__w").agg(F.count(F.lit(1)).alias("__df"))  # a row per query term
    idf = F.log(1 + (F.lit(n) - F.col("__df") + 0.5) / (F.col("__df") + 0.5))
    part = idf * F.col("__tf") * (k1 + 1) / (F.col("__tf") + k1 * (1 - b + b * F.col("__len") / F.lit(mean)))
    return hits.join(F.broadcast(df), "__w").groupBy(key).agg(F.round(F.sum(part), 6).alias("score")).orderBy(F.desc("score"), key).limit(top)
