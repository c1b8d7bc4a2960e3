"""Reviewer decisions, road keys and hierarchy checks against hand-made rows."""
import datetime

from pyspark.sql import functions as F

from placeproof.catalog.studies import road_key
from placeproof.plans import adjudication
from placeproof.functions.text import norm_text

AT = datetime.datetime(2024, 1, 5, 6, 0)
REVIEW = "review_id long, address_id long, actor string, word string, observed_at timestamp"


def reviews(spark, rows):
    return spark.createDataFrame(rows, REVIEW)


def test_words_stand_for_three_decisions(spark):
    words = ["confirm", " Confirmed", "LOCATION_CONFIRMED", "deny", "denied", "not_true", "moved_confirmed", "inconclusive", "unresolved", "maybe", "", None]
    got = spark.createDataFrame([(w,) for w in words], "w string").select(adjudication.canonical(F.col("w")).alias("d"))
    assert [r.d for r in got.collect()] == ["confirm"] * 3 + ["deny"] * 4 + ["inconclusive"] * 2 + [None] * 3


def test_refused_and_repeated_reviews(spark):
    later = AT + datetime.timedelta(hours=1)
    rows = [(1, 7, "R1", "confirm", AT), (1, 7, "R1", "deny", later), (1, 7, "R1", "confirm", AT), (2, 7, None, "deny", AT), (3, None, "R1", "deny", AT),
            (4, 7, "R1", "perhaps", AT), (5, 7, "R1", "deny", None), (6, 8, "R2", "unresolved", AT)]
    kept, refused = adjudication.split_decisions(reviews(spark, rows))
    assert sorted((r.review_id, r.decision) for r in kept.collect()) == [(1, "confirm"), (6, "inconclusive")]
    assert sorted((r.review_id, r.reason) for r in refused.collect()) == [(2, "no_actor"), (3, "no_address"), (4, "unknown_decision"), (5, "no_instant")]


def test_decisions_become_observations(spark):
    rows = [(1, 7, "R1", "confirm", AT), (2, 7, "R1", "deny", AT), (3, 7, "R1", "inconclusive", AT)]
    got = {r.observation_id: r for r in adjudication.observations(adjudication.split_decisions(reviews(spark, rows))[0]).collect()}
    assert [(got[i].outcome, got[i].polarity, got[i].kind) for i in (1, 2, 3)] == [
        ("met_family", "positive", "adjudication"), ("no_such_person", "negative", "adjudication"), ("locked_premises", "ambiguous", "adjudication")]
    assert [got[i].weight for i in (1, 2, 3)] == [0.612, 0.0, 0.34425]      # no accuracy, no media, in business hours
    assert got[1].x is None and "media_dup" not in got[1].asDict()
    empty = adjudication.split_decisions(reviews(spark, []))
    assert adjudication.observations(empty[0]).count() == 0 and empty[1].count() == 0


def test_road_keys(spark):
    texts = ["Gali No 4, Main Bazaar", "gali 12", "12 Rd 7", "5th Cross Rd", "2nd cross gali 3", "plain", "", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(road_key(norm_text(F.col("t"))).alias("k"))
    assert [r.k for r in got.collect()] == ["gali 4", "gali 12", "road 7", "cross 5", "gali 3", None, None, None]
