"""Where exposed hosts live, judged from the owner's name."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions import patterns as P
from vitrine.functions.texts import strip


def network_profile_col(org: Column) -> Column:
    """Category and provider of one (stripped) owner name."""
    low = F.lower(org)

    def place(category: str, provider: Column) -> Column:
        return F.struct(F.lit(category).alias("category"), provider.alias("provider"))

    result = F.when(F.coalesce(org, F.lit("")) == "", place("unknown", F.lit("Unknown")))
    for pattern, category, provider in P.PROVIDERS:
        result = result.when(low.rlike(pattern), place(category, F.lit(provider)))
    for category, pattern in P.NETWORK_KEYWORDS:
        result = result.when(low.rlike(pattern), place(category, org))
    return result.otherwise(place("business", org))


def network_profile(df: DataFrame, org: str = "org") -> DataFrame:
    """Adds ``category`` and ``provider``."""
    stripped = df.withColumn("_org", strip(F.col(org)))
    return stripped.withColumn("_place", network_profile_col(F.col("_org"))).select(
        *df.columns, "_place.*"
    )


def profile_breakdown(df: DataFrame, org: str = "org") -> DataFrame:
    """Row counts by category and by provider (``kind, name, n``).

    Owners repeat a great deal, so rows are counted per name first and the
    patterns run once per distinct name.
    """
    per_org = df.groupBy(F.col(org).alias("org")).agg(F.count(F.lit(1)).alias("n"))
    kinds = F.explode(
        F.array(
            F.struct(F.lit("category").alias("kind"), F.col("category").alias("name")),
            F.struct(F.lit("provider").alias("kind"), F.col("provider").alias("name")),
        )
    )
    return (
        network_profile(per_org)
        .select(kinds.alias("k"), "n")
        .groupBy("k.kind", "k.name")
        .agg(F.sum("n").alias("n"))
    )
