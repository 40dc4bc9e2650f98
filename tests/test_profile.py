import re

from pyspark.sql import functions as F

from textloom.functions import profile

TEXTS = {
    "Call Ann Lee at 555-123-4567, 12 main st, a@b.org, 4532-1111-2222-3333": (5, False, False),
    "naïve words only": (0, True, False),
    "wait... what": (0, False, True),
    "plain words only": (0, False, False),
}


def test_features_of_all_kinds(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    f = profile.features(F.col("text"))
    rows = rows.select("text", *[c.alias(n) for n, c in f.items()])
    c = F.col
    rows = rows.withColumn("score", profile.complexity(c("text_length"), c("density"), c("multilingual"), c("complex_formatting"), c("sentence_count")))
    rows = rows.withColumn("strategy", profile.strategy(F.lit("general"), F.lit("unknown"), c("text_length"), c("density"), c("multilingual"), c("complex_formatting"), c("score")))
    for r in rows.collect():
        found, multilingual, formatting = TEXTS[r["text"]]
        assert (r["n_found"], r["multilingual"], r["complex_formatting"]) == (found, multilingual, formatting)
        assert found == sum(len(re.findall(p, r["text"])) for p in profile.FOUND)
        dense = found / len(r["text"].split())
        assert abs(r["score"] - (0.2 * (dense > 0.1) + 0.1 * (dense > 0.3) + 0.15 * multilingual + 0.1 * formatting)) < 1e-9
        assert r["strategy"] == ("high_recall" if dense > 0.3 or multilingual or formatting else "balanced")
