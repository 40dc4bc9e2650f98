from pyspark.sql import functions as F

from textloom.functions import profile, spans


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "text string").select(column.alias("x")).first()["x"]


def test_offsets_and_merge(spark):
    text = "Mail a.b@c.de or \U0001f600 4532-1111-2222-3333 now"
    found = one(spark, text, spans.merge_longest(spans.find_all(F.col("text"))))
    assert [(s["entity_type"], s["entity_value"]) for s in found] == [("EMAIL", "a.b@c.de"), ("CREDIT_CARD", "4532-1111-2222-3333")]
    assert all(text[s["start"] : s["stop"]] == s["entity_value"] for s in found)


def test_mask_and_recover(spark):
    text = "x@y.org, z@y.org, 10.0.0.1"
    marked = spans.placeholders(spans.merge_longest(spans.find_all(F.col("text"))))
    assert one(spark, text, spans.splice(F.col("text"), marked)) == "${EMAIL_002}, ${EMAIL_001}, ${IP_ADDRESS_001}"
    assert one(spark, text, spans.recover(spans.splice(F.col("text"), marked), marked)) == text


def test_luhn(spark):
    good, bad = ("4532015112830366", "4111-1111-1111-1111", "378282246310005"), ("1234567890123456", "4532111111111111")
    assert all(one(spark, x, spans.luhn(F.col("text"))) for x in good) and not any(one(spark, x, spans.luhn(F.col("text"))) for x in bad)


def test_hash_mask(spark):
    masked = spans.hash_mask(F.col("text"), "EMAIL", F.array(F.lit("john.doe@example.com")))
    assert one(spark, "Contact john.doe@example.com.", masked) == "Contact EMAIL[HASH:836f82db99121b34]."


def test_special_ratio(spark):
    assert abs(one(spark, "Hello, world!  How are you?   ", profile.special_ratio(F.col("text"))) - 11 / 30) < 1e-12


def test_think_block(spark):
    from textloom.plans.rewrite import rewrite_think

    assert one(spark, "x<think>a\n b</think>y", rewrite_think(F.col("text"))) == "x> DeepThink: a\n> by"
    assert one(spark, "no block", rewrite_think(F.col("text"))) == "no block"


def test_all_patterns(spark, tmp_path):
    import re

    from textloom.plans import catalog

    text = "Ann Lee, 12 Main Street, card 4532********3333 or 4532 1111 2222 3333, (555) 123-4567, 123-45-6789, http://a.org/x on 2024-01-31, P.O. Box 7, 10.0.0.1"
    expected, seen = [], set()
    for kind, pattern in spans.ALL:
        for m in re.finditer(pattern, text, re.ASCII):
            if m.span() not in seen:
                seen.add(m.span())
                expected.append((kind, *m.span(), m.group()))
    spark.createDataFrame([(1, text, "en", "a")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [(r["entity_type"], r["start"], r["stop"], r["entity_value"]) for r in catalog.QUERIES["pii_span_offsets"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(expected) and {k for k, *_ in got} == {k for k, _ in spans.ALL} - {"EMAIL"}
    assert ("CREDIT_CARD", "4532********3333") in {(k, v) for k, _, _, v in got} and ("ADDRESS", "12 Main Street") in {(k, v) for k, _, _, v in got}
    counts = {r["entity_type"]: r["n"] for r in catalog.QUERIES["pii_type_counts"](spark, str(tmp_path)).collect()}
    assert sum(counts.values()) == len(expected)
    assert sum(r["n"] for r in catalog.QUERIES["error_grouping_sets"](spark, str(tmp_path)).collect()) == 3 * len(expected)
    assert max(r["n"] for r in catalog.QUERIES["pii_rollup"](spark, str(tmp_path)).collect()) == len(expected)
    masked = catalog.QUERIES["pii_mask_placeholder"](spark, str(tmp_path)).first()["masked"]
    assert "3333" not in masked and "12" not in masked


def test_preference_merge(spark):
    from textloom.plans.measures import merge_preferred

    def plain(found, prefer):
        kept = []
        for s in sorted(found, key=lambda x: (x[1], -x[3], x[2], x[0])):
            for i, k in enumerate(kept):
                shared, shorter = min(s[2], k[2]) - max(s[1], k[1]), min(s[2] - s[1], k[2] - k[1])
                if shared > 0 and shorter > 0 and shared / shorter > 0.5:
                    surer, longer = s[3] > k[3], s[2] - s[1] > k[2] - k[1]
                    if surer if s[1:3] == k[1:3] or prefer != "longer" else longer:
                        kept[i] = s
                    break
            else:
                kept.append(s)
        return kept

    import random

    dice = random.Random(4)
    cases = [[(dice.choice("AB"), a, a + dice.randint(1, 9), dice.choice([0.3, 0.6, 0.9])) for a in (dice.randint(0, 20) for _ in range(dice.randint(0, 8)))] for _ in range(60)]
    rows = spark.createDataFrame([(k, c) for k, c in enumerate(cases)], "id int, s array<struct<entity_type:string,start:int,stop:int,confidence:double>>")
    for prefer in ("longer", "higher_confidence"):
        got = {r["id"]: [tuple(x) for x in r["m"]] for r in rows.select("id", merge_preferred(F.col("s"), prefer).alias("m")).collect()}
        assert got == {k: plain(c, prefer) for k, c in enumerate(cases)}


def test_words_go_on_in_other_scripts(spark, tmp_path):
    import re

    import duckdb

    from textloom.plans import catalog

    texts = ["Thshea Stteä zu", "Äb Cd, Ef Gh.", "Ann Lee—Bo Day", "中Ab Cd 10.0.0.1é", "naïve 123-45-6789"]
    rows = spark.createDataFrame([(k, t, "en", "a") for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    expected = {(k, *m.span()) for k, t in enumerate(texts) for _, p in spans.ALL for m in re.finditer(p, t)}
    assert {(r["doc_id"], r["start"], r["stop"]) for r in catalog.QUERIES["pii_span_offsets"](spark, str(tmp_path)).collect()} == expected
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert {(a, b, c) for a, b, c in db.execute(f"select doc_id, start, stop from ({catalog.SQL['pii_span_offsets']})").fetchall()} == expected


def test_rewritten_in_every_way(spark):
    text = "é a@b.org, 10.0.0.1"
    found = spans.merge_longest(spans.find_all(F.lit(text)))
    shown = {n: one(spark, text, spans.rewritten(F.col("text"), found, x)) for n, x in spans.REDACTIONS.items()}
    assert shown == {"tagged": "é <pii:email>a@b.org</pii:email>, <pii:ip_address>10.0.0.1</pii:ip_address>", "redacted": "é <PII:email/>, <PII:ip_address/>", "replaced": "é <EMAIL>, <IP_ADDRESS>"}
    assert one(spark, text, spans.rewritten(F.col("text"), F.slice(found, 1, 0), spans.REDACTIONS["replaced"])) == text
    assert one(spark, "", spans.rewritten(F.col("text"), spans.merge_longest(spans.find_all(F.col("text"))), spans.REDACTIONS["replaced"])) == ""
