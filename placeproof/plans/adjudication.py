"""Reviewer decisions as observations of the log."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeproof import policy
from placeproof.plans import evidence


def canonical(word: Column) -> Column:
    """The decision that a reviewer's word stands for, null for an unknown word; case and outer blanks do not count."""
    table = F.create_map(*[F.lit(x) for pair in policy.DECISION_ALIASES.items() for x in pair])
    return F.try_element_at(table, F.lower(F.trim(word)))


def split_decisions(reviews: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused) of reviews (review_id, address_id, actor, word, observed_at).

    Refused, with the first reason that holds: an unknown word (null too), no actor, no address, no instant.  A review id that is
    repeated counts once; of rows that differ under one id the earliest stays, then the smallest word.
    """
    r = reviews.withColumn("decision", canonical(F.col("word")))
    why = (F.when(F.col("decision").isNull(), "unknown_decision").when(F.col("actor").isNull(), "no_actor")
           .when(F.col("address_id").isNull(), "no_address").when(F.col("observed_at").isNull(), "no_instant"))
    r = r.withColumn("reason", why)
    rest = [c for c in r.columns if c != "review_id"]
    kept = (r.filter("reason is null").groupBy("review_id").agg(F.min_by(F.struct(*rest), F.struct("observed_at", "word", "address_id", "actor")).alias("m"))
            .select("review_id", "m.*").drop("reason"))
    return kept, r.filter("reason is not null")


def observations(accepted: DataFrame) -> DataFrame:
    """Scored evidence rows of kind `adjudication`: no position, no dwell, no media; the outcome is the decision's."""
    def told(column: Column, table: dict[str, str]) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), column)
    outcome = told(F.col("decision"), policy.DECISION_OUTCOME)
    polarity = F.when(outcome.isin(policy.NEGATIVE_OUTCOMES), "negative").when(outcome.isin(policy.AMBIGUOUS_OUTCOMES), "ambiguous").otherwise("positive")
    empty = [F.lit(None).cast(t).alias(c) for c, t in (("x", "double"), ("y", "double"), ("dwell_s", "long"), ("gps_accuracy_m", "double"),
                                                        ("trail_agreement_m", "double"), ("media", "string"), ("media_dup", "boolean"))]
    rows = accepted.select(F.col("review_id").alias("observation_id"), "address_id", F.col("actor").alias("agent_id"), "decision", "observed_at",
                           F.lit("adjudication").alias("kind"), outcome.alias("outcome"), polarity.alias("polarity"), *empty)
    return evidence.score_columns(rows).drop("media_dup")
