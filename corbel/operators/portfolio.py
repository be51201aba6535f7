"""Verified events mapped to holdings and watched instruments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tiers of a match with their weights: fixed values.
TIERS = (("exact_instrument", "symbol", 1.0), ("base_asset", "base_asset", 0.98), ("rtoken_underlying", "underlying_symbol", 0.9))


def identifier(text: Column) -> Column:
    """Trimmed upper case without a leading dollar sign; null unless it is an identifier."""
    name = F.regexp_replace(F.upper(F.trim(text)), "^\\$", "")
    return F.when(name.rlike("^[A-Z0-9][A-Z0-9._:/-]{0,63}$"), name)


def band(confidence: Column) -> Column:
    return F.when(confidence >= 0.85, "high").when(confidence >= 0.65, "medium").otherwise("low")


def matches(symbols: DataFrame, instruments: DataFrame) -> DataFrame:
    """Different ``symbols(name)``, as ``identifier`` writes them, with the instruments of their first tier that has any: symbol, base asset, underlying; in
    the latter two those quoted in USDT are preferred. An instrument meets three names at most, so there are no more rows than that, however many references share a name."""
    tiers = None
    for k, (basis, key, weight) in enumerate(TIERS):
        rows = symbols.join(instruments.withColumn("name", F.col(key)), "name")
        rows = rows.select("name", "instrument_id", F.col("symbol").alias("instrument"), "base_asset", "underlying_symbol", F.lit(k).alias("tier"), F.lit(basis).alias("basis"), F.lit(weight).alias("weight"), F.when(F.lit(k) == 0, 0).when(F.col("quote_asset") == "USDT", 0).otherwise(1).alias("other_quote"))
        tiers = rows if tiers is None else tiers.unionByName(rows)
    best = tiers.groupBy("name").agg(F.min(F.struct("tier", "other_quote")).alias("best"))
    return tiers.join(best, "name").where("tier = best.tier and other_quote = best.other_quote").drop("best", "other_quote", "tier")


def impacts(references: DataFrame, instruments: DataFrame, holdings: DataFrame, watchlist: DataFrame) -> DataFrame:
    """One row per touched instrument: relationship (a holding of the base asset, else a watched symbol, base or underlying), confidence rounded
    to four places, band and basis. Of several, a holding replaces what is watched and the highest confidence wins, the first on ties; among watched the last."""
    held = holdings.select(F.upper("asset").alias("base_asset")).distinct().withColumn("held", F.lit(True))
    watched = watchlist.select(F.upper("instrument").alias("w")).distinct()
    named = references.select("ref", "confidence", identifier(F.col("symbol")).alias("name")).where("name is not null")
    m = matches(named.select("name").distinct(), instruments).join(held, "base_asset", "left")
    for i, key in enumerate(("instrument", "base_asset", "underlying_symbol")):
        m = m.join(watched.select(F.col("w").alias(key), F.lit(True).alias(f"w{i}")), key, "left")
    m = m.withColumn("relationship", F.when(F.col("held"), "holding").when(F.coalesce("w0", F.lit(False)) | F.coalesce("w1", F.lit(False)) | F.coalesce("w2", F.lit(False)), "watchlist")).where("relationship is not null")
    # of the references of a name only two can win: the first of the highest confidence, which depends on the tier's weight, and the last
    rounded = lambda w: F.floor(F.col("confidence") * w * 10_000 + 0.5) / 10_000
    top = [F.min(F.struct((-rounded(w)).alias("order"), F.col("ref").alias("ref"), rounded(w).alias("confidence"))).alias(f"top_{basis}") for basis, _, w in TIERS]
    last = F.min(F.struct((-F.col("ref")).alias("order"), "ref", "confidence")).alias("last")
    m = m.join(named.groupBy("name").agg(*top, last), "name")
    holding = F.col("relationship") == "holding"
    chosen = F.coalesce(*(F.when(F.col("basis") == basis, F.col(f"top_{basis}")) for basis, _, _ in TIERS))
    m = m.withColumn("mapping_confidence", F.when(holding, chosen["confidence"]).otherwise(F.floor(F.col("last.confidence") * F.col("weight") * 10_000 + 0.5) / 10_000))
    order = (F.when(holding, 0).otherwise(1).alias("o0"), F.when(holding, -F.col("mapping_confidence")).alias("o1"), F.when(holding, chosen["ref"]).otherwise(-F.col("last.ref")).alias("o2"), "instrument_id")
    best = m.groupBy("instrument").agg(F.min(F.struct(*order, "relationship", "mapping_confidence", "basis")).alias("x")).select("instrument", "x.*")
    return best.select("instrument", "relationship", "mapping_confidence", band(F.col("mapping_confidence")).alias("confidence_band"), F.col("basis").alias("mapping_basis"))
