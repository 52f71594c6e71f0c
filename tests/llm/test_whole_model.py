"""The language model of scans.repair holds all n-grams seen twice, however many there are."""

from boscograph.llm import scans


def test_no_ngram_is_dropped_for_their_number(spark, monkeypatch):
    monkeypatch.setattr(scans, "MOST_NGRAMS", 5, raising=False)  # the limit there was
    common = "the pine beetle carries small worms from one tree to other trees in spring"
    texts = [(i, common + (" near the forest edge" if i < 20 else "")) for i in range(60)] + [(60, common + " near the f0rest edge")]
    got = {r.k: r for r in scans.repair(spark.createDataFrame(texts, "k long, t string"), "k", "t").collect()}
    assert [(d.line_no, d.kind) for d in got[60].damage] == [(1, "misread")] and got[60].repaired.endswith("forest edge")
    assert not any(got[i].damage for i in range(60))
