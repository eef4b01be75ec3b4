"""Classification, regression, coverage and fold metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import ranked as ranked_rows


def ratio(a: Column, b: Column) -> Column:
    """Sum over sum; null where the denominator is 0."""
    return F.sum(a) / F.nullif(F.sum(b), F.lit(0))


def dataset_rates(df: DataFrame, parts: dict[str, tuple[str, str]], by: list[str] | None = None) -> DataFrame:
    """Rates as sums of seconds over sums of seconds, never means of ratios: name to (numerator, denominator)."""
    return df.groupBy(*(by or [])).agg(*(ratio(F.col(a), F.col(b)).alias(n) for n, (a, b) in parts.items()))


#: Reasons in the order of their precedence.
REASONS = ("silent_audio", "out_of_audio_bounds", "overlap_or_nonmonotonic", "non_positive_duration")


def invalid_reason(flags: str) -> Column:
    """The first reason by precedence; ``other`` if none is known."""
    return F.coalesce(*(F.when(F.array_contains(flags, r), F.lit(r)) for r in REASONS), F.lit("other"))


def reason_counts(words: DataFrame, flags: str = "flags") -> DataFrame:
    """Counts by flag (a word may count for several) and by first reason (each invalid word counts once)."""
    every = words.select(F.explode(flags).alias("reason")).groupBy("reason").agg(F.count("*").alias("n")).select(F.lit("any").alias("kind"), "reason", "n")
    first = words.where(F.size(flags) > 0).select(invalid_reason(flags).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
    return every.unionByName(first.select(F.lit("first").alias("kind"), "reason", "n"))


def confusion(df: DataFrame, by: list[str], y: str = "y", p: str = "p") -> DataFrame:
    return df.groupBy(*by, y, p).agg(F.count("*").alias("n"))


def classification_metrics(df: DataFrame, by: list[str], labels: list[int] | None = None, y: str = "y", p: str = "p") -> DataFrame:
    """Accuracy and macro F1 by group.

    F1 without any true or predicted case is 0.  The mean is over ``labels``, or over the labels present in either column.
    """
    cells = confusion(df, by, y, p)
    per = cells.select(*by, F.explode(F.array_distinct(F.array(y, p))).alias("c"), y, p, "n").groupBy(*by, "c").agg(
        F.sum(F.when((F.col(y) == F.col("c")) & (F.col(p) == F.col("c")), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col(y) == F.col("c"), F.col("n")).otherwise(0)).alias("actual"),
        F.sum(F.when(F.col(p) == F.col("c"), F.col("n")).otherwise(0)).alias("told"),
    )
    f1 = per.withColumn("f1", F.when(F.col("actual") + F.col("told") > 0, 2.0 * F.col("tp") / (F.col("actual") + F.col("told"))).otherwise(0.0))
    over = F.lit(float(len(labels))) if labels else F.count("*").cast("double")
    f1 = f1.where(F.col("c").isin(labels)) if labels else f1
    macro = f1.groupBy(*by).agg((F.sum("f1") / over).alias("macro_f1"))
    total = cells.groupBy(*by).agg((F.sum(F.when(F.col(y) == F.col(p), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"), F.sum("n").alias("n"))
    return total.join(macro, by) if by else total.join(F.broadcast(macro))


def pearson(a: str, b: str, least: float = 1e-8) -> Column:
    """Correlation; 0 where either side is (nearly) constant."""
    sd = F.stddev_pop(a) * F.stddev_pop(b)
    return F.when((F.stddev_pop(a) <= least) | (F.stddev_pop(b) <= least), 0.0).otherwise(F.coalesce(F.try_divide(F.covar_pop(a, b), sd), F.lit(0.0)))


def regression_metrics(df: DataFrame, by: list[str], r: str = "r", p: str = "pred") -> DataFrame:
    return df.groupBy(*by).agg(F.avg(F.abs(F.col(p) - F.col(r))).alias("mae"), pearson(r, p).alias("pearson"))


def coherent(cls: str, reg: str) -> Column:
    """The intensity made to agree with its class: 0 neutral, below or above 0 otherwise; classes 0, 1, 2 are negative to positive."""
    return F.when(F.col(cls) == 1, 0.0).when(F.col(cls) == 0, F.least(F.col(reg), F.lit(-1e-6))).otherwise(F.greatest(F.col(reg), F.lit(1e-6)))


def per_class_error(df: DataFrame, by: list[str], y: str = "y", p: str = "p", r: str = "r", pred: str = "pred") -> DataFrame:
    """Number, recall and mean absolute error of each actual class."""
    return df.groupBy(*by, y).agg(F.count("*").alias("n"), F.avg(F.when(F.col(y) == F.col(p), 1.0).otherwise(0.0)).alias("recall"), F.avg(F.abs(F.col(pred) - F.col(r))).alias("mae"))


def loss_report(df: DataFrame, by: list[str], prob: str, r: str, pred: str, weights: tuple[float, float] = (1.0, 0.5)) -> DataFrame:
    """Cross entropy of the true class's probability, Huber loss (delta 1), and their weighted sum."""
    d = F.abs(F.col(pred) - F.col(r))
    ce, huber = F.avg(-F.log(F.col(prob))), F.avg(F.when(d <= 1, d * d / 2).otherwise(d - 0.5))
    return df.groupBy(*by).agg(ce.alias("cross_entropy"), huber.alias("huber"), (weights[0] * ce + weights[1] * huber).alias("loss"))


def scenario_means(rows: DataFrame, by: list[str], values: tuple[str, ...] = ("accuracy", "macro_f1", "mae")) -> DataFrame:
    """Plain means of the metrics over scenarios: by kind, or by modality and rate as a curve."""
    return rows.groupBy(*by).agg(*(F.avg(v).alias(v) for v in values), F.count("*").alias("scenarios"))


def robust_versus_baseline(rows: DataFrame, complete: str = "complete", value: str = "macro_f1", kind: str = "kind", model: str = "model") -> DataFrame:
    """For each model the metric on whole input, its mean over the masked scenarios, and what masking costs."""
    masked, whole = F.avg(F.when(F.col(kind) != complete, F.col(value))), F.avg(F.when(F.col(kind) == complete, F.col(value)))
    return rows.groupBy(model).agg(whole.alias("complete"), masked.alias("masked"), (whole - masked).alias("lost"))


def auxiliary_loss(df: DataFrame, by: list[str], parts: list[tuple[str, str]]) -> DataFrame:
    """``aux``: the sum over modalities of the mean cross entropy where the modality is there; ``parts``: (probability of the true class, mask)."""
    each = (F.coalesce(F.avg(F.when(F.col(mask), -F.log(F.col(prob)))), F.lit(0.0)) for prob, mask in parts)
    return df.groupBy(*by).agg(reduce(lambda x, y: x + y, each).alias("aux"))


def fold_mean_sd(df: DataFrame, by: list[str], value: str) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))


def group_folds(df: DataFrame, group: str, label: str, k: int, seed: int = 0) -> DataFrame:
    """``(group, fold)``: groups whole in one fold, dealt in a snake by how unevenly their labels fall, then size and hash.

    Ranks come from ranges of groups, so that no task sorts all of them.
    """
    counts = df.groupBy(group, label).agg(F.count("*").alias("n"))
    spread = counts.groupBy(group).agg(F.round(F.stddev_pop("n"), 9).alias("spread"), F.sum("n").alias("size")).withColumn("hash_", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(group))))
    rank = F.col("rank_") - 1
    dealt = ranked_rows(spread, [F.desc("spread"), F.desc("size"), F.asc("hash_"), F.asc(group)], "rank_")
    return dealt.select(group, F.when(F.floor(rank / k) % 2 == 0, rank % k).otherwise(k - 1 - rank % k).cast("int").alias("fold"))


def fold_overlap(folds: DataFrame, group: str) -> DataFrame:
    """``(fold, groups, shared)``: how many groups each fold has, and how many of them other folds have too."""
    several = folds.groupBy(group).agg(F.count_distinct("fold").alias("folds_"))
    return folds.join(several, group).groupBy("fold").agg(F.count_distinct(group).alias("groups"), F.count_if(F.col("folds_") > 1).cast("int").alias("shared"))


def fold_profile(df: DataFrame, folds: DataFrame, group: str, label: str) -> DataFrame:
    """Rows, groups and rows of each class by fold."""
    both = df.join(folds, group)
    return both.groupBy("fold").agg(F.count("*").alias("n"), F.count_distinct(group).alias("groups"), *(F.count_if(F.col(label) == c).alias(f"class_{c}") for c in (0, 1, 2)))


def majority_baseline(df: DataFrame, fold: str = "fold", label: str = "label") -> DataFrame:
    """For each fold the most frequent class of the other folds, the least one on a tie."""
    own = df.groupBy(fold, label).agg(F.count("*").alias("own_"))
    total = own.groupBy(label).agg(F.sum("own_").alias("all_"))
    # All classes for each fold; both tables have a row for each fold or class.
    table = own.select(fold).distinct().join(own.groupBy().agg(F.collect_set(label).alias("classes_"))).select(fold, F.explode("classes_").alias(label))
    others = table.join(total, label).join(own, [fold, label], "left").withColumn("n", F.col("all_") - F.coalesce("own_", F.lit(0))).where("n > 0")
    return others.groupBy(fold).agg(F.max_by(label, F.struct("n", -F.col(label))).alias("majority"))


def availability(positions: DataFrame, mask: str, kind: str = "kind", valid: str = "time_valid") -> DataFrame:
    """Share of positions with an observation, share of words with a valid time (of words alone), and the number of gaps."""
    word = F.col(kind) == "word"
    return positions.agg((F.count_if(mask) / F.count("*")).alias("available"), (F.count_if(word & F.col(valid)) / F.count_if(word)).alias("words"), F.count_if(~word).alias("gaps"))


def sample_summary(positions: DataFrame, by: list[str], least: float = 0.6, kind: str = "kind", valid: str = "time_valid") -> DataFrame:
    """Positions, words, share of words with a valid time, and why the sample is suspect (joined by ``;``)."""
    word = F.col(kind) == "word"
    ratio = F.count_if(word & F.col(valid)) / F.greatest(F.count_if(word), F.lit(1))
    return positions.groupBy(*by).agg(F.count("*").alias("positions"), F.count_if(word).alias("words"), ratio.alias("valid_ratio"), F.concat_ws(";", F.when(ratio < least, "low_valid_alignment")).alias("reasons"))


def status_counts(records: DataFrame, flags: list[str], status: str = "status") -> DataFrame:
    """Records by status, and of these how many have each flag."""
    return records.groupBy(status).agg(F.count("*").alias("n"), *(F.count_if(F.col(f)).alias(f) for f in flags))


def missing_positions(seq: DataFrame, by: list[str], valid: Column, masks: dict[str, str]) -> DataFrame:
    """For each modality the valid positions where it isn't observed, and whether it is observed at all (``has_``)."""
    return seq.groupBy(*by).agg(*(F.count_if(valid & ~F.col(m)).alias(name) for name, m in masks.items()), *(F.bool_or(m).alias(f"has_{name}") for name, m in masks.items()))


def ranked(candidates: DataFrame) -> DataFrame:
    """The best candidate: accuracy, then macro F1, both falling, then mean absolute error, then name."""
    return candidates.orderBy(F.desc("accuracy"), F.desc("macro_f1"), "mae", "subset").limit(1)


def union_all(parts: list[DataFrame]) -> DataFrame:
    """Rows of all parts; missing columns are null."""
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
