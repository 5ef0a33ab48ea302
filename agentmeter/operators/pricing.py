"""Requests priced by the catalog, in decimals, so that sums do not depend on their order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as X
from ..functions import rates

#: The six priced kinds: column of tokens, rate.
KINDS = (("input", "input_tokens", "r_in"), ("output", "output_tokens", "r_out"), ("cw5", "cw5_tokens", "r_cw5"), ("cw1", "cw1_tokens", "r_cw1"), ("read", "cache_read", "r_read"))


def price(calls: DataFrame) -> DataFrame:
    """calls plus model_key, cw5_tokens, cw1_tokens, tier, unpriced, context and total tokens, and m_<kind>, m_total: millionths of USD.

    A model that the catalog lacks costs nothing and is unpriced, unless it is synthetic. The
    place of inference multiplies the token kinds, not searches. The catalog is a few dozen rows.
    """
    five, one = X.write_split(F.col("cw_total"), F.col("cw_hour"))
    c = calls.withColumn("model_key", X.model_key(F.col("model"))).withColumn("cw5_tokens", five).withColumn("cw1_tokens", one)
    dim = F.broadcast(rates.catalog(calls.sparkSession))
    c = c.join(dim, ["model_key", "fast"], "left")
    geo = X.geo_factor(F.col("geo"))
    zero = F.lit(0).cast("decimal(28,5)")
    parts = {f"m_{kind}": F.coalesce((F.col(n).cast("decimal(14,0)") * F.col(r) * geo).cast("decimal(28,5)"), zero) for kind, n, r in KINDS}
    parts["m_search"] = F.coalesce((F.col("searches").cast("decimal(14,0)") * F.col("r_search") * F.lit(1000000).cast("decimal(7,0)")).cast("decimal(28,5)"), zero)
    c = c.withColumns(parts)
    total = sum((F.col(p) for p in list(parts)[1:]), F.col(list(parts)[0]))
    c = c.withColumn("m_total", total.cast("decimal(28,5)"))
    c = c.withColumn("tier", F.coalesce("tier", F.when(X.is_synthetic(F.col("model")), "synthetic").otherwise("unknown"))).withColumn("unpriced", F.col("tier") == "unknown")
    c = c.withColumn("context_tokens", F.col("input_tokens") + F.col("cw5_tokens") + F.col("cw1_tokens") + F.col("cache_read"))
    return c.withColumn("total_tokens", F.col("context_tokens") + F.col("output_tokens")).drop("r_out", "r_cw5", "r_cw1", "r_search")


def usd(column: str):
    """The sum of millionths as USD."""
    return F.sum(column).cast("double") / 1e6
