"""Labels passed on to near copies of residue that the trusted patterns just miss."""

from pyspark.sql import functions as F

from cinderloom.llm.residue import residue_documents, trusted_residue, weak_residue

MISSED = {
    "<TITLE>": "<TITLE 1>", "[CAPTION]": "[CAPTION 2]", "XXXX": "XXX", "TBD": "tbd", "TODO: add names": "todo names", "{% title %}": "{% title|upper %}", "{{ title }}": "{{ title or name }}", "[[title]]": "[[the title]]",
    "asdf qwer zxcv": "asdf qwer", "Text will follow.": "Text here will soon follow.", "Your session has expired.": "The session has expired.", "The player for this video failed to load.": "The player failed to load.",
    "Your browser has scripting turned off.": "Your browser seems to have scripting off.", "Active content is required.": "Some active content was required.", "Hier steht später der Text.": "Hier steht bald der Text.", "aaaa bbbb aaaaa": "aaaa bbbb",
    "FÃ¼r {{ name }}": "FÃ¼r {{ name of it }}",
}


def test_loose_signs(spark):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(MISSED.items())], "i int, a string, b string")
    for r in df.select("a", "b", *[f(F.col(c)).alias(n + c) for n, f in (("t", trusted_residue), ("w", weak_residue)) for c in "ab"]).collect():
        assert (r.ta, r.wa, r.tb, r.wb) == (True, True, False, True), r
    clean = spark.createDataFrame([("The cook stirs the soup and says: sit down. <video> <answer>B</answer>",), (None,), ("",)], "a string")
    assert [r[0] for r in clean.select(weak_residue(F.col("a"))).collect()] == [False] * 3


def test_near_copies_of_residue(spark):
    body = " ".join(f"the cook moves pan number {w} over" for w in "ab cd ef gh ij kl mn op qr st uv wx yz ba dc fe hg ji lk nm".split())
    pairs = [(10 * i + k, f"{i * 'very '}{body[i * 3:]} {t}") for i, pair in enumerate(list(MISSED.items())[:6]) for k, t in enumerate(pair)]
    clean = [(900, body + " with care.")]
    got = {r.doc_id for r in residue_documents(spark.createDataFrame(pairs + clean, "doc_id long, text string")).collect()}
    assert got == {i for i, _ in pairs}
