"""Tables with the cases that every operator must bear: nulls, empty and long texts, repeats, clashing column names."""

import random

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, component_id long, fp long, score double, shard int"
ALPHABET = ["the", "and", "River", "stone", "über", "señor", "a@b.co", "42", "日本", "|", "x"]


def hard_docs(spark, rows=(), seed=1):
    rng = random.Random(seed)
    made = [(k, " ".join(rng.choice(ALPHABET) for _ in range(rng.randrange(0, 40))), "en", "s", None) for k in range(30)]
    made += [(3, made[3][1], "en", "s", 1), (3, made[3][1], "en", "s", 1), (None, None, None, None, None), (None, "no id", "en", None, 5), (90, None, "fr", "s", None)]
    made += [(91, "", "en", "s", 0), (92, " \t\n", "en", "s", 3), (93, "word " * 30_000, "en", "s", 150_000), (94, "z" * 20_000, None, "s", 20_000)]
    made += list(rows)
    return spark.createDataFrame([(*r, 7, 8, 9, 0.5, 1) for r in made], DOCS).repartition(3)


def no_docs(spark):
    return spark.createDataFrame([], DOCS)
