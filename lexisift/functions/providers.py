"""Hooks for models that are not part of the engine: annotators, entailment scorers, embedders. Without a provider columns are null."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def annotated(df: DataFrame, inputs: list[str], outputs: dict[str, str], provider: Callable[[pd.DataFrame], pd.DataFrame] | None) -> DataFrame:
    """df with the outputs (name: type) of a provider that maps a frame of inputs to a frame of outputs, batch by batch."""
    if provider is None:
        return df.withColumns({n: F.lit(None).cast(t) for n, t in outputs.items()})
    spec = df.withColumns({n: F.lit(None).cast(t) for n, t in outputs.items()}).schema

    def run(batches):
        for b in batches:
            got = provider(b[inputs])
            yield b.assign(**{n: got[n].to_numpy() for n in outputs})

    return df.mapInPandas(run, spec)


def claim_recall(claims: DataFrame, keys: list[str], labels: str = "labels", reference: str = "reference") -> DataFrame:
    """(keys, n_claims, n_entailed, claim_recall): share of a response's claims that the reference entails.

    claims: one row per claim with labels, an array of (label, score) from an entailment scorer. A claim is entailed if its best label
    is ENTAILMENT in any case, the first on ties; a claim without labels is not. Null where the reference is null, blank or [EMPTY]."""
    best = F.aggregate(labels, F.struct(F.lit("").alias("label"), F.lit(float("-inf")).alias("score")), lambda a, x: F.when(x["score"] > a["score"], F.struct(x["label"].alias("label"), x["score"].cast("double").alias("score"))).otherwise(a))["label"]
    usable = ~F.coalesce(F.trim(reference).isin("", "[EMPTY]"), F.lit(True))
    out = claims.withColumn("_e", F.upper(best) == "ENTAILMENT").withColumn("_u", usable).groupBy(*keys).agg(F.count("*").alias("n_claims"), F.count_if("_e").alias("n_entailed"), F.min("_u").alias("_u"))
    return out.withColumn("claim_recall", F.when(F.col("_u"), F.round(F.col("n_entailed") / F.col("n_claims"), 4))).drop("_u")
