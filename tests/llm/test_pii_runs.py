"""Cards among other digits."""

from veridelta.llm import pii

CARD = "4111111111111111"


def test_cards_inside_runs(spark):
    spaced = "4111 1111 1111 1111"
    texts = [CARD, spaced, f"pay {CARD} 123 now", f"2 {spaced}", f"1234567 {spaced}.", f"{CARD} {CARD}", f"{CARD} 555-123-4567", "4111 1111 1111 1112 99"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["text"], r["n_replaced"]) for r in pii.pseudonymise(df, "a test key").collect()}
    new, new_spaced = got[0][0], got[1][0]
    assert new != CARD and new_spaced.replace(" ", "") == new
    assert got[2] == (f"pay {new} 123 now", 1)
    assert got[3] == (f"2 {new_spaced}", 1) and got[4] == (f"1234567 {new_spaced}.", 1)
    assert got[5] == (f"{new} {new}", 2)
    assert got[6][1] == 2 and got[6][0].startswith(new + " ") and "555-123-4567" not in got[6][0]
    assert got[7] == (texts[7], 0)
