"""Budgets, selection, sampling and retrieval metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.columns import entry_budget

RESERVED = ("root_summary", "album_summary")


def budgeted(units: DataFrame, most: int = 20) -> DataFrame:
    """Units with budget and kept: reserved kinds always, then companions by importance and coverage while the root's budget lasts.

    A root's sums come from one aggregation that is joined back; only companions are
    ranked, within their root.
    """
    reserved = F.col("kind").isin(*RESERVED)
    per = units.groupBy("root_id").agg(F.sum("source_count").alias("_n"), F.count_if(reserved).alias("_r")).withColumn("budget", entry_budget("_n", most))
    w = Window.partitionBy("root_id", reserved).orderBy(F.desc(F.coalesce("importance", F.lit(0.0))), F.desc(F.coalesce("coverage", F.lit(0.0))), "summary_id")
    ranked = units.join(per, "root_id").withColumn("_rank", F.row_number().over(w))
    return ranked.withColumn("kept", reserved | (F.col("_rank") <= F.greatest(F.lit(0), F.col("budget") - F.col("_r")))).drop("_n", "_r", "_rank")


def rollup_dropped(selected: DataFrame, most_titles: int = 25) -> DataFrame:
    """One row per root for the units that its budget dropped."""
    first = F.struct(-F.coalesce("importance", F.lit(0.0)), -F.coalesce("coverage", F.lit(0.0)), F.col("summary_id"))
    lost = selected.where("NOT kept")
    titles = lost.select("root_id", "title").distinct()
    w = Window.partitionBy("root_id").orderBy("title")
    listed = titles.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most_titles).groupBy("root_id").agg(F.array_sort(F.collect_list("title")).alias("titles"))
    sums = lost.groupBy("root_id").agg(F.sum("source_count").alias("source_count"), F.min_by("scope_id", first).alias("scope_id"))
    return sums.join(listed, "root_id").select(F.concat(F.lit("neg_"), "root_id").alias("summary_id"), "root_id", "scope_id", "titles", "source_count", F.lit(0.05).alias("importance"))


def metrics(ranked: DataFrame, judged: DataFrame, ks: tuple[int, ...] = (5, 20), ndcg: int = 10) -> DataFrame:
    """Per query of (query, item, rank) against (query, item): recall at each k, MRR, nDCG."""
    total = judged.groupBy("query").agg(F.count(F.lit(1)).alias("n_rel"))
    hit = ranked.join(judged.select("query", "item").withColumn("rel", F.lit(1)), ["query", "item"], "left")
    rel = F.col("rel") == 1
    per = hit.groupBy("query").agg(
        *(F.count_if(rel & (F.col("rank") <= k)).alias(f"h{k}") for k in ks),
        F.min(F.when(rel, F.col("rank"))).alias("first"),
        F.sum(F.when(rel & (F.col("rank") <= ndcg), 1.0 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_rel"), F.lit(ndcg)).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    both = total.join(per, "query", "left")
    return both.select("query", *(F.round(F.coalesce(F.col(f"h{k}"), F.lit(0)) / F.col("n_rel"), 4).alias(f"recall_at_{k}") for k in ks), F.round(F.coalesce(F.coalesce("dcg", F.lit(0.0)) / ideal, F.lit(0.0)), 4).alias("ndcg_at_10"), F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 4).alias("mrr"))
