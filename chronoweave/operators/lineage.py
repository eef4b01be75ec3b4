"""Lineage of staged work: a stage's signature is a digest of its own settings, the sample's content and all that it was made from."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_order(upstream: dict[str, tuple[str, ...]]) -> list[str]:
    """The stages, each after those that it needs; a circle or an unknown stage is an error."""
    done: list[str] = []
    left = dict(upstream)
    while left:
        ready = [s for s, needs in left.items() if all(n in done for n in needs)]
        if not ready:
            raise ValueError(f"stages that wait for each other or for unknown ones: {sorted(left)}")
        done += ready
        left = {s: needs for s, needs in left.items() if s not in ready}
    return done


def _signature(stage: str, settings: str, content: Column, needs: list[tuple[str, Column, Column]]) -> Column:
    """Digest over the stage, its settings and code (``settings``), the content, and signature and output of each upstream stage."""
    parts = [F.lit(stage), F.lit(settings), content.cast("string")]
    for name, signature, output in sorted(needs, key=lambda x: x[0]):
        parts += [F.lit(name), signature, output]
    return F.sha2(F.to_json(F.array(*(F.coalesce(p, F.lit("")) for p in parts))), 256)


def stage_states(samples: DataFrame, records: DataFrame, key: str, content: str, upstream: dict[str, tuple[str, ...]], settings: dict[str, str]) -> DataFrame:
    """``(key, stage, signature, pending)`` for each sample and stage.

    ``records`` (key, stage, signature, output, actual) tell what was done: the signature then, the digest of what came out, and the digest
    of what lies there now; of several for a sample and stage the greatest counts.  A stage is pending if one that it needs is, if there is
    no record, if its signature is another by now, or if its output was changed or lost.  Signatures follow the recorded outputs, so a
    changed digest makes just its own stage and what descends from it pending.
    """
    last = records.groupBy(key, "stage").agg(F.max(F.struct("signature", "output", "actual")).alias("r_"))
    held = last.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("stage", "r_"))).alias("records_"))  # as many as there are stages
    both = samples.select(key, F.col(content).alias("content_")).join(held, key, "left")
    record = {s: F.try_element_at("records_", F.lit(s)) for s in upstream}
    for s in in_order(upstream):
        needs = [(n, F.col(f"signature_{n}"), record[n]["output"]) for n in upstream[s]]
        both = both.withColumn(f"signature_{s}", _signature(s, settings[s], F.col("content_"), needs))
        kept = record[s]["signature"].eqNullSafe(F.col(f"signature_{s}")) & record[s]["output"].eqNullSafe(record[s]["actual"]) & record[s]["output"].isNotNull()
        both = both.withColumn(f"ok_{s}", reduce(lambda x, y: x & y, (F.col(f"ok_{n}") for n in upstream[s]), F.coalesce(kept, F.lit(False))))
    rows = F.array(*(F.struct(F.lit(s).alias("stage"), F.col(f"signature_{s}").alias("signature"), (~F.col(f"ok_{s}")).alias("pending")) for s in upstream))
    return both.select(key, F.inline(rows))
