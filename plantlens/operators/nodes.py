"""Classification of why-nodes: kind, blame, and when to stop digging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantlens.functions.text import fold, found_markers
from plantlens.functions.vocab import (
    BLAME_MARKERS,
    CONDITION_MARKERS,
    DEPTH,
    FOLD_CLASSIFIER,
    FOLLOW_UP_QUESTION,
    NODE_LABELS,
    ROOT_MARKERS,
    STOP_REASONS,
    SYMPTOM_MARKERS,
)


def analyze_nodes(nodes: DataFrame, answer: str = "reponse", level: str = "niveau") -> DataFrame:
    """Add kind, confidence, blame, stop decision and markers to every node (pure projection)."""
    folded = nodes.withColumn("_t", fold(answer, FOLD_CLASSIFIER)).withColumns(
        {
            "_root": found_markers(F.col("_t"), ROOT_MARKERS),
            "_cond": found_markers(F.col("_t"), CONDITION_MARKERS),
            "_symp": found_markers(F.col("_t"), SYMPTOM_MARKERS),
            "_blame": found_markers(F.col("_t"), BLAME_MARKERS),
        }
    )

    def any_of(c: str) -> Column:
        return F.size(c) > 0

    shallow = F.col(level) <= 2
    kind = (
        F.when(any_of("_root"), "cause_racine").when(any_of("_cond"), "condition")
        .when(any_of("_symp") & shallow, "symptome").otherwise("cause_directe")
    )
    confidence = (
        F.when(any_of("_root"), F.least(F.lit(1.0), 0.7 + 0.1 * F.size("_root")))
        .when(any_of("_cond") | (any_of("_symp") & shallow), 0.6).otherwise(0.55)
    )
    markers = (
        F.when(any_of("_root"), F.col("_root")).when(any_of("_cond"), F.col("_cond"))
        .when(any_of("_symp") & shallow, F.col("_symp")).otherwise(F.array().cast("array<string>"))
    )
    graded = folded.withColumns({"_kind": kind, "confidence": confidence, "_markers": markers})
    is_blame = any_of("_blame")
    deep = (F.col(level) >= DEPTH) & (F.col("_kind") == "cause_directe")
    final = F.when(is_blame, "cause_directe").otherwise(F.col("_kind"))
    labels = F.create_map(*[F.lit(x) for kv in NODE_LABELS.items() for x in kv])
    reason = (
        F.when(is_blame, STOP_REASONS["blame"]).when(F.col("_kind") == "cause_racine", STOP_REASONS["root"])
        .when(deep, STOP_REASONS["deep"]).otherwise(STOP_REASONS["go_on"])
    )
    return graded.select(
        *nodes.columns,
        final.alias("type"),
        F.element_at(labels, final).alias("type_label"),
        "confidence",
        (~is_blame & (F.col("_kind") == "cause_racine")).alias("is_root"),
        is_blame.alias("is_blame"),
        (~is_blame & ((F.col("_kind") == "cause_racine") | deep)).alias("should_stop"),
        F.when(is_blame, FOLLOW_UP_QUESTION).alias("relance_question"),
        reason.alias("raison_arret"),
        F.concat("_markers", "_blame").alias("markers"),
    )
