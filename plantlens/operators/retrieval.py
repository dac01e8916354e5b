"""Text engine: TF-IDF over past cases, cause suggestions for new ones."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantlens.functions.text import case_text, grams, pairs_of
from plantlens.operators.matching import best_matches
from plantlens.session import dealt_by_text, join_small, materialize, named

MAX_FEATURES = 5000
DIGIT_BITS = 12
MIN_HISTORY = 3


def with_terms(cases: DataFrame, text: str) -> DataFrame:
    """Add ``terms``: words and neighbouring word pairs of the text."""
    return cases.withColumn("_w", grams(text)).withColumn("terms", F.concat("_w", pairs_of("_w"))).drop("_w")


def vocabulary(cases: DataFrame, text: str, max_features: int | None = MAX_FEATURES) -> DataFrame:
    """Most frequent terms with corpus count, document count and idf: ``term, tf, df, idf``.

    Both counts come from one explode: every occurrence counts for ``tf``, every distinct term
    of a document for ``df``.  They are summed map-side, so frequent terms meet no hot reducer; rows are dealt by all their simple
    columns, so that a task sums up the terms of a bounded amount of text and copies of a text do not meet.
    Ties in frequency go to the smaller term; ``max_features=None`` keeps every term.
    """
    simple = [named(f.name) for f in cases.schema.fields if f.dataType.typeName() not in ("map", "variant", "array", "struct")]
    worded = with_terms(dealt_by_text(cases, [text], F.xxhash64(*simple)).select(text), text)
    marks = F.concat(
        F.transform("terms", lambda t: F.struct(t.alias("t"), F.lit(1).alias("n"), F.lit(0).alias("d"))),
        F.transform(F.array_distinct("terms"), lambda t: F.struct(t.alias("t"), F.lit(0).alias("n"), F.lit(1).alias("d"))),
    )
    totals = (
        worded.select(F.explode(marks).alias("_m"))
        .groupBy(F.col("_m.t").alias("term"))
        .agg(F.sum("_m.n").alias("tf"), F.sum("_m.d").alias("df"))
    )
    if max_features is not None:
        totals = most_frequent(totals, max_features)
    n = cases.agg(F.count(F.lit(1))).first()[0]
    return totals.withColumn("idf", F.log((F.lit(1.0 + n)) / (1 + F.col("df"))) + 1.0)


def most_frequent(totals: DataFrame, wanted: int) -> DataFrame:
    """The ``wanted`` terms of largest ``tf`` (ties: the smaller term), without sorting the table.

    The tf of the last term is found digit by digit, from histograms of at most ``1 << DIGIT_BITS`` counts; only the terms with
    exactly that tf are put in order.
    """
    totals = materialize(totals)
    least, rest, among = 0, wanted, totals  # terms beyond ``least`` in its leading digits are in; ``rest`` are still wanted
    largest = totals.agg(F.max("tf")).first()[0] or 0
    for shift in range(largest.bit_length() // DIGIT_BITS * DIGIT_BITS, -1, -DIGIT_BITS):
        digit = F.shiftright("tf", shift).bitwiseAND((1 << DIGIT_BITS) - 1)
        counts = {r["digit"]: r["count"] for r in among.groupBy(digit.alias("digit")).count().collect()}
        for d in sorted(counts, reverse=True):
            if counts[d] >= rest:
                break
            rest -= counts[d]
        else:
            return totals  # fewer terms than wanted
        least += d << shift
        among = among.where(digit == d)
    tied = among.orderBy("term").limit(rest)
    return totals.where(F.col("tf") > least).unionByName(tied)


@dataclass
class TextEngine:
    """Fitted text engine; ``suggest`` serves a whole batch of new cases.  The vocabulary stays a table."""

    history: DataFrame | None
    idf: DataFrame | None
    size: int

    @classmethod
    def fit(cls, cases: DataFrame, text: str = "text", min_history: int = MIN_HISTORY, max_features: int | None = MAX_FEATURES) -> "TextEngine":
        """``cases``: ``id, text, defect_type, validated_branch, validated_root_cause, created_at``."""
        size = cases.agg(F.count(F.lit(1))).first()[0]
        if size < min_history:
            return cls(None, None, size)
        return cls(cases, materialize(vocabulary(cases, text, max_features).select("term", "idf")), size)

    @property
    def is_trained(self) -> bool:
        return self.history is not None

    def suggest(self, queries: DataFrame, top_k: int = 5, text: str = "text") -> DataFrame:
        """Best distinct (branch, cause) per query, by the most similar validated case.

        Returns ``query_id, rank, branch, cause, confidence, source_case_id, explanation``.
        """
        validated = self.history.where(
            (F.coalesce("validated_root_cause", F.lit("")) != "") & (F.coalesce("validated_branch", F.lit("")) != "")
        )
        label = F.to_json(F.struct(F.col("validated_branch").alias("b"), F.col("validated_root_cause").alias("c")))
        left = with_terms(dealt_by_text(validated, [text], "id"), text).select(F.col("id").cast("long").alias("source_case_id"), "terms", label.alias("_cause"))
        right = with_terms(dealt_by_text(queries, [text], "id"), text).select(F.col("id").cast("long").alias("query_id"), "terms")
        found = best_matches(right, left, top_k, "query_id", "source_case_id", "_cause", self.idf)
        about = self.history.select(F.col("id").cast("long").alias("source_case_id"), "defect_type", "created_at")
        found = found.select(
            "query_id", "rank", F.from_json("_cause", "b string, c string").alias("_c"),
            F.col("score").alias("confidence"), "source_case_id",
        )
        return join_small(about, found, ["source_case_id"]).select(
            "query_id", "rank", F.col("_c.b").alias("branch"), F.col("_c.c").alias("cause"), "confidence",
            "source_case_id",
            F.concat(
                F.lit("Cas similaire (defect: "), F.coalesce("defect_type", F.lit("")), F.lit(") resolu le "),
                F.substring(F.coalesce(F.col("created_at").cast("string"), F.lit("")), 1, 10),
            ).alias("explanation"),
        )


def rca_text(cases: DataFrame) -> DataFrame:
    """Add ``text`` to stored root-cause cases."""
    return cases.withColumn("text", case_text("defect_type", "context", "parameters", "causes_5m"))
