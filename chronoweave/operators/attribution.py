"""Masked scoring: gap scenarios, exact Shapley values, occlusion windows and ensembles.

A scorer is any function from a DataFrame to the same rows with ``logits`` (array) and ``reg`` (double) besides: column expressions, an
MLlib model's ``transform``, or a function over Arrow batches (``batch_scorer``).  It reads ``t``, ``a`` and ``v``, each modality's mean
features over the positions that are kept (arrays; zeros where none is), and must keep all other columns.

Features of a sequence are numbers or arrays, and are summed once for each sample; what a coalition, window or scenario hides is
subtracted from these sums, so features are never copied for a variant.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MODALITIES = ("t", "a", "v")
Scorer = Callable[[DataFrame], DataFrame]
#: Logits of a class are bias + coefficients of the three means + coefficient of the product of text and audio.
COEFFICIENTS = {
    "first": ((0.1, 1.0, -0.5, 0.3, 0.7), (0.0, -0.4, 0.8, 0.2, -0.6), (-0.1, 0.5, 0.1, -0.9, 0.4)),
    "second": ((0.0, 0.6, 0.4, -0.2, 0.1), (0.2, -0.7, 0.3, 0.5, 0.2), (-0.2, 0.2, -0.6, 0.4, -0.3)),
    "third": ((-0.1, 0.3, -0.9, 0.6, 0.5), (0.1, 0.9, 0.2, -0.3, 0.4), (0.0, -0.8, 0.5, 0.1, -0.2)),
}


def linear_scorer(name: str = "first") -> Scorer:
    """Three logits and a bounded intensity from the averages of the three mean vectors, as column expressions."""

    def score(df: DataFrame) -> DataFrame:
        m = {c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x) / F.size(c) for c in MODALITIES}
        logits = [F.lit(c[0]) + c[1] * m["t"] + c[2] * m["a"] + c[3] * m["v"] + c[4] * m["t"] * m["a"] for c in COEFFICIENTS[name]]
        reg = F.tanh(0.5 * m["t"] - 0.25 * m["a"] + 0.4 * m["v"] + 0.3 * m["t"] * m["a"])
        return df.withColumns({"logits": F.array(*logits), "reg": reg})

    return score


def batch_scorer(score: Callable[[list, list, list], tuple[Iterable, Iterable]]) -> Scorer:
    """A scorer from a Python function of three lists of vectors to the rows' logits and intensities; batches go through Arrow."""

    def run(df: DataFrame) -> DataFrame:
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

        def each(batches):
            for b in batches:
                logits, reg = score(*(b.column(c).to_pylist() for c in MODALITIES))
                yield pa.RecordBatch.from_arrays(
                    [*b.columns, pa.array([list(map(float, x)) for x in logits], type=pa.list_(pa.float64())), pa.array(map(float, reg), type=pa.float64())], names=[*b.schema.names, "logits", "reg"]
                )

        return df.mapInArrow(each, f"{kinds}, logits array<double>, reg double")

    return run


def _is_array(df: DataFrame, c: str) -> bool:
    return df.schema[c].dataType.typeName() == "array"


def _total(x: Column, on: Column, is_array: bool) -> Column:
    """Sum of a feature column where ``on``, as an array; summed in parts before any shuffle."""
    if not is_array:
        return F.array(F.coalesce(F.sum(F.when(on, x.cast("double"))), F.lit(0.0)))
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    return vector_to_array(Summarizer.sum(array_to_vector(F.transform(x, lambda z: F.when(on, z.cast("double")).otherwise(0.0)))))


def _mean(total: Column, n: Column) -> Column:
    """Zeros where nothing is kept."""
    return F.transform(total, lambda s: F.when(n > 0, s / n).otherwise(0.0))


def _less(total: Column, hidden: Column) -> Column:
    return F.zip_with(total, hidden, lambda x, y: x - F.coalesce(y, F.lit(0.0)))


def masked_sums(seq: DataFrame, by: list[str], keep: dict[str, Column] | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """``(by, carry, sum_*, n_*)``: each modality's sum of features and number of positions, where its mask and ``keep`` are on."""
    keep = keep or {}
    on = {m: F.col(f"m{m}") & keep.get(m, F.lit(True)) for m in MODALITIES}
    return seq.groupBy(*by).agg(
        *(F.first(c).alias(c) for c in carry), *(_total(F.col(m), on[m], _is_array(seq, m)).alias(f"sum_{m}") for m in MODALITIES), *(F.count_if(on[m]).alias(f"n_{m}") for m in MODALITIES)
    )


def masked_means(seq: DataFrame, by: list[str], keep: dict[str, Column] | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """``(by, carry, t, a, v)``, as scorers read them."""
    return masked_sums(seq, by, keep, carry).select(*by, *carry, *(_mean(F.col(f"sum_{m}"), F.col(f"n_{m}")).alias(m) for m in MODALITIES))


def score_sequences(seq: DataFrame, by: list[str], scorer: Scorer, keep: dict[str, Column] | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """``(by, carry, logits, reg)`` of each sequence, its modalities masked by ``keep`` besides their own masks."""
    return scorer(masked_means(seq, by, keep, carry)).select(*by, *carry, "logits", "reg")


def argmax(values: Column) -> Column:
    """Index of the greatest of an array, the first on a tie."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def first_argmax(cols: list[Column]) -> Column:
    """The same of columns."""
    return argmax(F.array(*cols))


def shapley(seq: DataFrame, by: list[str], scorer: Scorer = linear_scorer()) -> DataFrame:
    """Exact contributions of the three modalities to the target logit and to the intensity, over all eight coalitions.

    A coalition is a row of mean vectors with zeros for who isn't in it; all are scored in one pass.
    """
    means = masked_means(seq, by).withColumn("bits_", F.explode(F.sequence(F.lit(0), F.lit(7))))
    outside = lambda i: F.col("bits_").bitwiseAND(F.lit(1 << i)) == 0
    scored = scorer(means.withColumns({m: F.when(outside(i), F.transform(m, lambda x: F.lit(0.0))).otherwise(F.col(m)) for i, m in enumerate(MODALITIES)}))
    out = scored.groupBy(*by).agg(*(F.max(F.when(F.col("bits_") == b, F.struct("logits", "reg"))).alias(f"v{b}") for b in range(8)))
    out = out.withColumn("target", argmax(F.col("v7.logits")))
    out = out.select(*by, "target", *(F.get(F.col(f"v{b}.logits"), F.col("target")).alias(f"c{b}") for b in range(8)), *(F.col(f"v{b}.reg").alias(f"r{b}") for b in range(8)))
    weight = {0: 2.0 / 6, 1: 1.0 / 6, 2: 2.0 / 6}  # n! (2 - n)! / 3!
    for i, m in enumerate(MODALITIES):
        for kind, to in (("c", "class"), ("r", "reg")):
            terms = [weight[bin(b).count("1")] * (F.col(f"{kind}{b | 1 << i}") - F.col(f"{kind}{b}")) for b in range(8) if not b & (1 << i)]
            out = out.withColumn(f"{to}_{m}", sum(terms[1:], terms[0]))
    signed, size = F.array(*(F.col(f"class_{m}") for m in MODALITIES)), F.array(*(F.abs(F.col(f"class_{m}")) for m in MODALITIES))
    total = F.greatest(F.aggregate(size, F.lit(0.0), lambda s, x: s + x), F.lit(1e-8))
    for m in MODALITIES:
        out = out.withColumn(f"share_{m}", F.abs(F.col(f"class_{m}")) / total)
    main = F.when(F.array_max(signed) > 0, argmax(signed)).otherwise(argmax(size))
    return out.withColumn("main", F.get(F.array(*map(F.lit, MODALITIES)), main)).withColumn("base", F.col("c0")).withColumn("full", F.col("c7")).drop(*(f"{k}{b}" for k in "cr" for b in range(8)))


def occlusion_windows(seq: DataFrame, by: list[str], scorer: Scorer = linear_scorer(), width: int = 3) -> DataFrame:
    """Windows of each modality from its first to its last observed position, and what hiding one changes.

    A window must hold an observed position.
    """
    is_array = any(_is_array(seq, m) for m in MODALITIES)
    as_array = {m: F.transform(m, lambda x: x.cast("double")) if _is_array(seq, m) else F.array(F.col(m).cast("double")) if is_array else F.col(m).cast("double") for m in MODALITIES}
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("modality"), as_array[m].alias("x"), F.col(f"m{m}").alias("on")) for m in MODALITIES))).alias("z")
    long = seq.select(*by, "pos", each).select(*by, "pos", "z.*").where("on")
    bounds = long.groupBy(*by, "modality").agg(F.min("pos").alias("lo"), (F.max("pos") + 1).alias("hi"))
    starts = bounds.withColumn("start", F.explode(F.sequence(F.col("lo"), F.col("hi") - 1))).withColumn("end", F.least(F.col("start") + width, F.col("hi"))).drop("lo", "hi")
    # A position lies in the windows that begin at it or up to width - 1 before it.
    near = long.withColumn("start", F.explode(F.sequence(F.col("pos") - (width - 1), F.col("pos"))))
    hidden = near.groupBy(*by, "modality", "start").agg(_total(F.col("x"), F.lit(True), is_array).alias("hx_"), F.count("*").alias("hn_"))
    cut = starts.join(hidden, [*by, "modality", "start"])  # inner: windows without an observed position go
    sums = masked_sums(seq, by)
    whole = scorer(sums.select(*by, *(_mean(F.col(f"sum_{m}"), F.col(f"n_{m}")).alias(m) for m in MODALITIES))).select(*by, F.col("logits").alias("full_"), F.col("reg").alias("full_reg_"))
    rows = cut.join(sums, by)
    own = lambda m: F.col("modality") == m
    rest = {m: F.when(own(m), _mean(_less(F.col(f"sum_{m}"), F.col("hx_")), F.col(f"n_{m}") - F.col("hn_"))).otherwise(_mean(F.col(f"sum_{m}"), F.col(f"n_{m}"))) for m in MODALITIES}
    less = scorer(rows.select(*by, "modality", "start", "end", *(c.alias(m) for m, c in rest.items())))
    out = less.select(*by, "modality", "start", "end", "logits", "reg").join(whole, by).withColumn("target", argmax(F.col("full_")))
    return out.select(
        *by, "modality", "start", "end", "target", (F.get("full_", F.col("target")) - F.get("logits", F.col("target"))).alias("drop"), (F.col("full_reg_") - F.col("reg")).alias("reg_change")
    )


def greedy_nonoverlap(windows: DataFrame, by: list[str], k: int = 3, score: str = "drop") -> DataFrame:
    """Up to ``k`` windows of each group, greedily by falling score (the earlier start on a tie), disjoint from those taken."""
    item = F.struct((-F.col(score)).alias("minus"), F.col("start"), F.col("end"))
    sorted_ = F.array_sort(F.collect_list(item))
    empty = F.array().cast("array<struct<minus:double,start:int,end:int>>")
    fold = F.aggregate(
        sorted_, empty, lambda got, x: F.when((F.size(got) < k) & F.forall(got, lambda y: (x["end"] <= y["start"]) | (y["end"] <= x["start"])), F.concat(got, F.array(x))).otherwise(got)
    )
    return windows.groupBy(*by).agg(fold.alias("w_")).select(*by, F.posexplode("w_").alias("rank", "w_")).select(*by, "rank", "w_.start", "w_.end", (-F.col("w_.minus")).alias(score))


#: 1 complete, 27 single and 4 joint gap scenarios (kind, modalities, rate, place).
SCENARIOS = (
    [("complete", "", 0.0, "none")]
    + [("single", m, r, w) for m in MODALITIES for r in (0.1, 0.3, 0.5) for w in ("start", "middle", "end")]
    + [("joint", m, 0.3, "middle") for m in ("ta", "tv", "av", "tav")]
)


def scenario_gaps(seq: DataFrame, by: list[str], scenarios=SCENARIOS) -> DataFrame:
    """``seq`` with ``gaps``: the scenarios (by number) that take modalities from a position, and which.

    A scenario's gap is a run of the list of valid positions, max(1, half-even round(n * rate)) long.  Rows aren't copied.
    """
    w = Window.partitionBy(*by)
    ranked = seq.withColumn("i_", F.when(F.col("valid"), F.count_if("valid").over(w.orderBy("pos")) - 1)).withColumn("n_", F.count_if("valid").over(w))
    i, n, gaps = F.col("i_"), F.col("n_"), []
    for sid, (_, modality, rate, place) in enumerate(scenarios):
        if rate > 0:
            length = F.greatest(F.lit(1), F.bround(n * F.lit(rate), 0).cast("int"))
            start = F.lit(0) if place == "start" else F.floor((n - length) / 2) if place == "middle" else n - length
            gaps.append(F.when((i >= start) & (i < start + length), F.struct(F.lit(sid).alias("sid"), *(F.lit(m in modality).alias(m) for m in MODALITIES))))
    return ranked.withColumn("gaps", F.array_compact(F.array(*gaps))).drop("i_", "n_")


def _scenario(scenarios) -> dict[str, Column]:
    """A scenario's columns by its number."""
    table = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(m).alias("modality"), F.lit(float(r)).alias("rate"), F.lit(p).alias("place")) for k, m, r, p in scenarios))
    return {c: F.get(table, F.col("sid"))[c] for c in ("kind", "modality", "rate", "place")}


def scenario_counts(seq: DataFrame, by: list[str], scenarios=SCENARIOS) -> DataFrame:
    """``(kind, modality, rate, place, by, t, a, v, at)``: positions left to each modality in each scenario, and the sum of text's."""
    gone = scenario_gaps(seq, by, scenarios).select(*by, "pos", *(f"m{m}" for m in MODALITIES), F.explode("gaps").alias("g_"))
    lost = {m: F.col(f"m{m}") & F.col(f"g_.{m}") for m in MODALITIES}
    gone = gone.groupBy(*by, F.col("g_.sid").alias("sid")).agg(*(F.count_if(c).alias(f"h{m}_") for m, c in lost.items()), F.sum(F.when(lost["t"], F.col("pos")).otherwise(0)).alias("hat_"))
    whole = seq.groupBy(*by).agg(*(F.count_if(f"m{m}").alias(f"n{m}_") for m in MODALITIES), F.sum(F.when(F.col("mt"), F.col("pos")).otherwise(0)).alias("nat_"))
    out = whole.withColumn("sid", F.explode(F.sequence(F.lit(0), F.lit(len(scenarios) - 1)))).join(gone, [*by, "sid"], "left")
    left = lambda n, h: F.col(n) - F.coalesce(h, F.lit(0))
    return out.select(*(c.alias(k) for k, c in _scenario(scenarios).items()), *by, *(left(f"n{m}_", f"h{m}_").alias(m) for m in MODALITIES), left("nat_", "hat_").alias("at"))


def score_scenarios(seq: DataFrame, by: list[str], scorer: Scorer, carry: tuple[str, ...] = (), scenarios=SCENARIOS) -> DataFrame:
    """``(kind, modality, rate, place, by, carry, logits, reg)`` of each sequence in each scenario.

    Only what a scenario hides is summed for it, and taken from the sequence's sums.
    """
    gone = scenario_gaps(seq, by, scenarios).select(*by, *MODALITIES, *(f"m{m}" for m in MODALITIES), F.explode("gaps").alias("g_"))
    lost = {m: F.col(f"m{m}") & F.col(f"g_.{m}") for m in MODALITIES}
    hidden = gone.groupBy(*by, F.col("g_.sid").alias("sid")).agg(
        *(_total(F.col(m), lost[m], _is_array(seq, m)).alias(f"hx_{m}") for m in MODALITIES), *(F.count_if(lost[m]).alias(f"hn_{m}") for m in MODALITIES)
    )
    rows = masked_sums(seq, by, carry=carry).withColumn("sid", F.explode(F.sequence(F.lit(0), F.lit(len(scenarios) - 1)))).join(hidden, [*by, "sid"], "left")
    left = lambda m: F.when(F.col(f"hx_{m}").isNull(), F.col(f"sum_{m}")).otherwise(_less(F.col(f"sum_{m}"), F.col(f"hx_{m}")))
    means = rows.select(*(c.alias(k) for k, c in _scenario(scenarios).items()), *by, *carry, *(_mean(left(m), F.col(f"n_{m}") - F.coalesce(f"hn_{m}", F.lit(0))).alias(m) for m in MODALITIES))
    return scorer(means).drop(*MODALITIES)


def seeded_uniform(seed: int, name: str, by: list[str]) -> Column:
    """A number in [0, 1) that only the seed, the name and the entity decide, the same in any engine with MD5."""
    key = F.concat_ws("|", F.lit(str(seed)), F.lit(name), *(F.col(c).cast("string") for c in by))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def random_gap_masks(seq: DataFrame, by: list[str], seed: int, rule: str = "span") -> DataFrame:
    """Seeded gaps, the same on any partitioning.

    ``span``: 20 % untouched, else 1 to 3 modalities lose one block of 10-60 % of the positional span between the first and the last
    valid position.  ``text``: 15-50 % of the list of observed text positions.  ``list``: 20 % untouched, else each of audio and vision,
    by chance, loses 10-50 % of the list of its observed positions.
    """
    u = lambda name: seeded_uniform(seed, name, by)
    w = Window.partitionBy(*by)
    if rule == "span":
        lo, hi = F.min(F.when(F.col("valid"), F.col("pos"))).over(w), F.max(F.when(F.col("valid"), F.col("pos"))).over(w) + 1
        length = F.greatest(F.lit(1), F.bround((hi - lo) * (0.1 + 0.5 * u("rate")), 0))
        start = lo + F.floor(u("start") * F.greatest(F.lit(1), hi - lo - length + 1))
        n = F.get(F.array(*map(F.lit, (1, 1, 1, 2, 2, 3))), F.floor(u("n") * 6).cast("int"))
        rank = {m: sum((F.when(u(o) < u(m), 1).otherwise(0) for o in MODALITIES if o != m), F.lit(0)) for m in MODALITIES}
        gone = (u("touch") >= 0.2) & (F.col("pos") >= start) & (F.col("pos") < start + length)
        out = seq
        new = {m: F.col(f"m{m}") & ~F.coalesce(gone & (rank[m] < n), F.lit(False)) for m in MODALITIES}
    else:
        which, low, high = (("t",), 0.15, 0.5) if rule == "text" else (("a", "v"), 0.1, 0.5)
        pick = {"t": F.lit(True), "a": (u("modes") < 0.3) | ((u("modes") >= 0.6) & (u("modes") < 0.9)), "v": (u("modes") >= 0.3) & (u("modes") < 0.9)}
        new, out = {}, seq
        for m in which:
            i, n = F.count_if(f"m{m}").over(w.orderBy("pos")) - 1, F.count_if(f"m{m}").over(w)
            length = F.greatest(F.lit(1), F.bround(n * (low + (high - low) * u(f"rate{m}")), 0))
            start = F.floor(u(f"start{m}") * (n - length + 1))
            touched = (n >= 2) & pick[m] & (F.lit(True) if rule == "text" else u("touch") >= 0.2)
            new[m] = F.col(f"m{m}") & ~(touched & F.col(f"m{m}") & (i >= start) & (i < start + length))
    return out.select(*[new[c[1:]].alias(c) if c in {f"m{m}" for m in new} else F.col(c) for c in seq.columns])


def ensemble_mean(preds: DataFrame, by: list[str]) -> DataFrame:
    """Equal-weight mean of logits and intensity over the stacked rows of several models."""
    return preds.groupBy(*by).agg(*(F.avg(c).alias(c) for c in ("logit0", "logit1", "logit2", "reg")))


def ensemble_candidates(preds: DataFrame, subsets: DataFrame, by: list[str]) -> DataFrame:
    """Every subset's mean prediction, in one job: ``subsets`` is a small table (subset, model)."""
    return ensemble_mean(preds.join(F.broadcast(subsets), "model"), ["subset", *by])
