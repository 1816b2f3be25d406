"""Candidate search against brute force, split partitions, and residue that the patterns must know."""

import random

from pyspark.sql import functions as F

from cinderloom.llm.residue import fingerprints, near_duplicates, neighbours, partitioned_tables, residue_documents, text_classes, trusted_residue

RESIDUE = [
    '{"error": {"code": 1, "message": "rate limit reached"}}', "GATEWAY TIMEOUT WHILE CONTACTING THE MEDIA HOST (CODE 61406).", "Oops! We couldn't find that page.", "Sorry, this video has been removed by the uploader.",
    "This content is no longer available in your region.", "Dear ____, thank you for your order of ____ .", "Your text here. Click to edit this heading.", "Turn JavaScript on before you go on.", "[INSERT " + "A VERY LONG NAME OF A SLOT " * 6 + "HERE]",
]
CLEAN = [
    'The reply {"error": "none"} is fine, says the log.', "The cook fills in ____ and sits down.", 'She quotes "' + "404 not found. Lorem ipsum dolor sit amet. " * 9 + '" aloud.', "The gateway timeout is explained on the board.", "",
]


def test_patterns(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(RESIDUE + CLEAN + [None])], "doc_id long, text string")
    got = [r[0] for r in df.orderBy("doc_id").select(trusted_residue(F.col("text"))).collect()]
    assert got == [True] * len(RESIDUE) + [False] * (len(CLEAN) + 1)


def corpus(n=260):
    rng = random.Random(9)
    words = ["w" + "".join(rng.choices("bcdfgklmnprst", k=4)) for _ in range(400)]
    docs = []
    for i in range(n):
        base = [rng.choice(words) for _ in range(rng.choice([3, 30, 90, 200]))]
        docs.append(base)
        for _ in range(rng.randrange(3)):
            copy = list(base)
            for _ in range(rng.randrange(0, max(1, len(base) // 40) + 1)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            docs.append(copy)
    return [(i, " ".join(d).capitalize() + rng.choice([".", "!", " ;"])) for i, d in enumerate(docs)]


def brute(rows):
    def shingles(t):
        w = t.lower().rstrip(".!; ").split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))

    sets = {}
    for _, t in rows:
        sets.setdefault(t.lower().rstrip(".!; "), shingles(t))
    keys = sorted(sets)
    return {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}


def test_recall_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    ids = {r.id: r.text.lower().rstrip(".!; ") for r in fingerprints(df).join(df, "doc_id").select("id", "text").collect()}
    got = {tuple(sorted((ids[r.a], ids[r.b]))) for r in near_duplicates(df).collect()}
    want = brute(rows)
    assert got <= want and len(got) >= 0.97 * len(want) and len(want) > 80


def test_crowded_partitions_lose_nothing(spark):
    df = spark.createDataFrame(corpus(120), "doc_id long, text string")
    classes = text_classes(fingerprints(df))
    pairs = [{tuple(r) for r in neighbours(classes, partitioned_tables(classes, hot)).collect()} for hot in (1000, 1)]
    assert pairs[1] <= pairs[0] and len(pairs[1]) >= 0.97 * len(pairs[0]) > 0


def test_labels_pass_by_the_residues_own_words(spark):
    body = " ".join(f"the cook moves pan {w} over" for w in "ab cd ef gh ij kl mn op qr st uv wx yz ba dc fe hg ji lk nm".split())
    texts = {
        1: f"{body} and waits. Please enable JavaScript to see the rest of it", 2: f"{body} and waits. Please enable Java Skript to see the rest of it", 3: f"very {body} and waits. Please enable Java Skript to see the rest",
        4: f"{body} and waits for the soup to boil on the stove once more", 5: "Please enable the light.", 6: None,
    }
    df = spark.createDataFrame([(k, t, "x") for k, t in texts.items()] + [(1, texts[1], "again")], "doc_id long, text string, id string")
    assert sorted(r.doc_id for r in residue_documents(df).collect()) == [1, 2, 3]
