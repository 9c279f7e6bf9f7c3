"""Quality rules in tables too small for cutoffs of their own: the least ones hold, so one row more or less changes nothing."""

from askwell.llm.quality_rules import quality_rules


def test_an_odd_text_is_rejected_in_a_table_of_any_size(spark):
    plain = "some words that make up a text of an ordinary kind and length " * 1
    odd = " ".join(f"w{i} #" for i in range(60))
    for n in (0, 1, 98, 99, 150):
        rows = [(i, " ".join(f"{w}{i}x{j}" for j in range(6) for w in plain.split()), "en", "a") for i in range(n)] + [(1000, odd, "en", "a")]
        got = {r["doc_id"]: (r["kept"], r["rule"]) for r in quality_rules(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()}
        assert got[1000] == (False, "symbols"), n
        assert all(kept for i, (kept, _) in got.items() if i != 1000), n
