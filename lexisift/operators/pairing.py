"""Paired evaluation of challengers against a baseline method."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import CHALLENGERS, finite, log10_safe
from .stats import null_safe, wilcoxon, with_percentiles

CELL = ["domain", "model"]


def aligned(df: DataFrame, value: str, methods=("nlq", *CHALLENGERS), log: bool = False) -> DataFrame:
    """One row per (domain, model, query_id) with the median of each method's values in a column named after it.

    Medians come first, then the optional logarithm, so values that are not positive drop out of later comparisons. One grouped
    conditional aggregation instead of a join per challenger; a method without a finite value is null."""
    x = finite(F.col(value))
    med = [F.median(F.when(F.col("method") == m, x)).alias(m) for m in methods]
    out = df.groupBy(*CELL, "query_id").agg(*med)
    return out.withColumns({m: log10_safe(F.col(m)) for m in methods}) if log else out


def _rate(wins: Column, n: Column) -> Column:
    return F.round(F.try_divide(100.0 * wins, n), 1)


def win_rates(pairs: DataFrame, eps: float = 0.0) -> DataFrame:
    """(domain, model, n_*, wr_*, best, best_rate, runner_up, delta_best, sp_bold): win rate of each challenger over pairs with both values.

    Ties for the best go to the first challenger in order. A cell without pairs has a null rate."""
    aggs = []
    for c in CHALLENGERS:
        both = F.col(c).isNotNull() & F.col("nlq").isNotNull()
        aggs += [F.count_if(both).alias(f"n_{c}"), F.count_if(both & (F.col(c) - F.col("nlq") > eps)).alias(f"_w_{c}")]
    out = pairs.groupBy(*CELL).agg(*aggs)
    out = out.select(*CELL, *[F.col(f"n_{c}") for c in CHALLENGERS], *[_rate(F.col(f"_w_{c}"), F.col(f"n_{c}")).alias(f"wr_{c}") for c in CHALLENGERS])
    rates = F.filter(F.array(*[F.struct((-F.col(f"wr_{c}")).alias("r"), F.lit(i).alias("i"), F.lit(c).alias("c")) for i, c in enumerate(CHALLENGERS)]), lambda s: s["r"].isNotNull())
    ranked = F.array_sort(rates)
    out = out.withColumn("_s", ranked)
    first, second = F.try_element_at("_s", F.lit(1)), F.try_element_at("_s", F.lit(2))
    return out.withColumns(
        {
            "best": first["c"],
            "best_rate": -first["r"],
            "runner_up": second["c"],
            "delta_best": F.round(second["r"] - first["r"], 1),
            "sp_bold": F.coalesce((F.col("wr_sparql") > F.col("wr_nlq_cot")) & (F.col("wr_sparql") > F.col("wr_sparql_cot")), F.lit(False)),
        }
    ).drop("_s")


def win_regions(pairs: DataFrame) -> DataFrame:
    """(model, sparql, nlq_cot, sparql_cot, n): sizes of the disjoint regions of the challengers' winning ids, pooled over domains.

    An id wins for a challenger if it does in any domain; ids that no challenger wins are left out."""
    won = [F.coalesce(F.max((F.col(c) > F.col("nlq")).cast("int")), F.lit(0)).alias(c) for c in CHALLENGERS]
    flags = pairs.groupBy("model", "query_id").agg(*won)
    return flags.filter(sum((F.col(c) for c in CHALLENGERS), F.lit(0)) > 0).groupBy("model", *CHALLENGERS).agg(F.count("*").alias("n"))


def delta_on_wins(long: DataFrame, baseline: str = "nlq") -> DataFrame:
    """Change of claim recall where the challenger's recall beats the baseline's: one row per (method, model, domain).

    long: model, domain, method, query_id, recall, claim_recall; repeated keys multiply as in a join. n_total counts pairs with
    both recalls; means are over winning pairs with both claim recalls; rounded to 2 and 4 places."""
    f = long.select(*CELL, "method", "query_id", finite(F.col("recall")).alias("r"), finite(F.col("claim_recall")).alias("c"))
    base = f.filter(F.col("method") == baseline).select(*CELL, "query_id", F.col("r").alias("br"), F.col("c").alias("bc"))
    j = f.filter(F.col("method").isin(*CHALLENGERS)).join(base, [*CELL, "query_id"])
    both = F.col("r").isNotNull() & F.col("br").isNotNull()
    win = both & (F.col("r") > F.col("br"))
    ok = win & F.col("c").isNotNull() & F.col("bc").isNotNull()
    out = j.groupBy("method", *CELL).agg(
        F.count_if(both).alias("n_total"),
        F.count_if(win).alias("win_count"),
        F.count_if(ok).alias("n_claims"),
        F.avg(F.when(ok, F.col("c"))).alias("ch_cr"),
        F.avg(F.when(ok, F.col("bc"))).alias("nlq_cr"),
        F.avg(F.when(ok, F.col("c") - F.col("bc"))).alias("delta_cr"),
        F.avg(F.when(win, F.col("r") - F.col("br"))).alias("delta_recall"),
    )
    out = out.withColumn("recall_win_rate", F.round(F.try_divide(100.0 * F.col("win_count"), F.col("n_total")), 2))
    out = out.withColumns({c: F.round(F.col(c), 4) for c in ("ch_cr", "nlq_cr", "delta_cr", "delta_recall")})
    return out.withColumn("co_directional", F.coalesce(F.col("delta_cr") > 0, F.lit(False)))


def challenger_summary(cells: DataFrame) -> DataFrame:
    """(method, mean_win_rate, mean_delta_cr, n_codir, n_cells, pct_codir): means of the rounded cells of delta_on_wins."""
    return cells.groupBy("method").agg(
        F.round(F.round(F.avg("recall_win_rate"), 8), 2).alias("mean_win_rate"),
        F.round(F.round(F.avg("delta_cr"), 8), 4).alias("mean_delta_cr"),
        F.count_if("co_directional").alias("n_codir"),
        F.count("*").alias("n_cells"),
        F.round(100.0 * F.count_if("co_directional") / F.count("*"), 1).alias("pct_codir"),
    )


def primary_pivot(cells: DataFrame) -> DataFrame:
    """(model, domain, win rate and delta of each challenger, sparql less nlq_cot): one row per cell, explicit pivot values."""
    p = cells.groupBy("model", "domain").pivot("method", list(CHALLENGERS)).agg(F.first("recall_win_rate").alias("win_rate"), F.first("delta_cr").alias("delta_cr"))
    return p.withColumn("delta_sparql_nlq_cot", F.round(F.col("sparql_delta_cr") - F.col("nlq_cot_delta_cr"), 4))


def box_stats(long: DataFrame, value: str, keys=("method",), baseline_once: tuple[str, ...] | None = None, baseline: str = "nlq") -> DataFrame:
    """Five-number summary per group, and whether a logarithmic scale fits (largest over smallest positive value above 20).

    baseline_once: keys of which the baseline's rows count once, the smallest value, as one baseline is repeated for each challenger."""
    x = long.withColumn("_v", finite(F.col(value)))
    if baseline_once:
        own = x.filter(F.col("method") == baseline)
        names = list(dict.fromkeys([*baseline_once, *keys]))
        x = x.filter(F.col("method") != baseline).select(*names, "_v").unionByName(own.groupBy(*names).agg(F.min("_v").alias("_v")))
    out = x.groupBy(*keys).agg(F.count("_v").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"), F.min(F.when(F.col("_v") > 0, F.col("_v"))).alias("_p"))
    out = with_percentiles(out, x, list(keys), ["_v"], {"q1": 0.25, "mid": 0.5, "q3": 0.75}).withColumnsRenamed({f"_v_{c}": c for c in ("q1", "mid", "q3")})
    return out.withColumn("log_scale", F.coalesce(F.col("high") / F.col("_p") > 20, F.lit(False))).select(*keys, "n", "low", "q1", "mid", "q3", "high", "log_scale")


def with_tests(rates: DataFrame, pairs: DataFrame, least: int = 5, most_exact: int = 25) -> DataFrame:
    """The table of win_rates with p_* per challenger: the signed-rank test of challenger against baseline, null below so many differences; exact
    for groups up to most_exact without ties or zeros."""
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("method"), F.round(F.col(c) - F.col("nlq"), 12).alias("d")) for c in CHALLENGERS]))
    w = wilcoxon(pairs.select(*CELL, rows.alias("r")).select(*CELL, "r.*"), [*CELL, "method"], "d", least=least, most_exact=most_exact)
    p = w.groupBy(*CELL).agg(*[F.max(F.when(F.col("method") == c, F.col("p"))).alias(f"p_{c}") for c in CHALLENGERS])
    return null_safe(rates, p, CELL, "left")


def rate_footer(cells: DataFrame) -> DataFrame:
    """(domain, one mean win rate per challenger, adv_1, adv_2): means over models of the recall win rates of delta_on_wins, and of the leads of
    sparql over the two others in the models that have both."""
    wide = cells.groupBy(*CELL).agg(*[F.max(F.when(F.col("method") == c, F.col("recall_win_rate"))).alias(c) for c in CHALLENGERS])
    sp, one, two = CHALLENGERS
    return wide.groupBy("domain").agg(*[F.round(F.avg(c), 4).alias(c) for c in CHALLENGERS], F.round(F.avg(F.col(sp) - F.col(one)), 4).alias("adv_1"), F.round(F.avg(F.col(sp) - F.col(two)), 4).alias("adv_2"))


def best_over_domains(rates: DataFrame) -> DataFrame:
    """(model, best, delta_best, p_min): of several domains the first by name that has a best challenger, and the smallest p of any."""
    p = F.least(*[F.col(f"p_{c}") for c in CHALLENGERS])
    first = F.when(F.col("best").isNotNull(), F.col("domain"))
    return rates.groupBy("model").agg(F.min_by("best", first).alias("best"), F.min_by("delta_best", first).alias("delta_best"), F.min(p).alias("p_min"))


def domain_means(cells: DataFrame, domains: list[str]) -> DataFrame:
    """(method, one mean win rate per domain), the columns that a challenger summary has beside its overall means."""
    return cells.groupBy("method").agg(*[F.round(F.round(F.avg(F.when(F.col("domain") == d, F.col("recall_win_rate"))), 8), 2).alias(d) for d in domains])
