"""Small cases of every operator: nulls, empty and long texts, ties, repeated rows, clashing columns, empty tables."""

import collections
import itertools
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom.llm import binary, brown, chat, mixing, neighbours, packing, perplexity, rules, setjoin, urls
from textloom.llm.curves import hilbert_keys
from textloom.llm.encoding import Encoder
from textloom.llm.words import Words, shingles

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, sig long, n long, row long"
LONG = " ".join(f"w{k % 997}x{k}" for k in range(30_000))
NEAR = [f"t{k}" for k in range(60)]


@pytest.fixture(scope="module")
def rows():
    near = NEAR.copy()
    near[30] = "other"
    texts = [None, "", "   \n", "One two", "one  two", " ".join(NEAR), " ".join(near).upper(), " ".join(NEAR), LONG, "a b c d e f", "x<|endoftext|> y\n\n z é "]
    out = [(k, t, "en" if k % 2 else None, None if k == 3 else "ab"[k % 2], 1, 2, 3) for k, t in enumerate(texts)]
    return [*out, out[5], (None, "null id here", "en", "a", 1, 2, 3)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def test_words_and_shingles():
    w = Words(pa.array(["Aa  b\x0bc", None, "", " d"]))
    assert w.counts.tolist() == [3, 0, 0, 1]
    h = w.hashes()
    assert len(set(h.tolist())) == 4 and Words(pa.array(["x aa"])).hashes()[1] == h[0]
    sets = list(shingles(h, w.first))
    assert [len(s) for s in sets] == [1, 0, 0, 1]


def test_hilbert_neighbours():
    cells = np.array(list(itertools.product(range(8), repeat=3)))
    order = cells[np.argsort(hilbert_keys(cells, 3))]
    assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoding_is_exact(rows, name):
    encoder = Encoder(public_tokenizers.path(name))
    texts = [t for _, t, *_ in rows] + ["\u00a0x\u00a0\n\ny", "\n\nword  two\t\tthree \n", "\U0001f389 a", "Σας ΣΑΣ"]
    bounds, ids = encoder.encode(pa.array(texts))
    whole = encoder.whole([t or "" for t in texts])
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == whole


def test_blocks_round_trip():
    rng = np.random.default_rng(0)
    for ids in (rng.integers(0, 50_000, 5000), np.zeros(3), np.array([2**32 - 1, 0, 7]), np.full(2000, 2**31)):
        ids = ids.astype(np.uint32)
        back = binary.from_file(binary.to_file(np.array([4]), np.array([True]), np.array([len(ids)]), ids))
        assert back[3].tolist() == ids.tolist() and back[0].tolist() == [4]


def test_token_output(spark, docs, rows):
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = sorted(map(tuple, binary.token_output(docs, path, 0, with_ids=True).collect()), key=lambda r: r[1])
    encoder, start = Encoder(path), 0
    for r, (doc_id, text) in zip(got, sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0)), strict=True):
        ids = encoder.whole([text or ""])[0] + [0]
        assert (r[0], r[1], r[2], r[4]) == (doc_id, start, len(ids), ids)
        assert r[3] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert binary.token_output(docs.limit(0), path).count() == 0


def test_packing(docs, rows):
    path = public_tokenizers.path("word_bpe_49k.json")
    got = packing.pack_documents(docs, path).toPandas()
    assert got.groupby("sequence_id").length.sum().max() <= 2048
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g.offset == g.length.cumsum() - g.length).all()
    expected = collections.Counter()
    for doc_id, ids in zip([r[0] for r in rows], Encoder(path).whole([r[1] or "" for r in rows]), strict=True):
        expected[doc_id if doc_id is not None else -1] += len(ids) + 1
    assert got.fillna({"doc_id": -1}).groupby("doc_id").length.sum().to_dict() == expected
    assert packing.pack_documents(docs.limit(0), path).count() == 0


def test_mixing(docs):
    got = mixing.mix_sources(docs).toPandas()
    assert len(got) == 13 and (got.taken <= 2 * got["size"]).all()
    per = got.groupby("source_size").agg({"taken": "sum", "target": "max"})
    assert ((per.taken - per.target).abs() <= 1).all()
    assert mixing.mix_sources(docs.limit(0)).count() == 0
    assert mixing.mixed_documents(docs).columns == docs.columns


def test_url_rules(spark):
    texts = ["http://WWW.Example.com/en/x?q", "https://example.com/en/", "x://a.net/fr", "x://a.net/fr/1#z", "nothing", None, "http://", "x://notexample.com/en/", "x://b.org/es/"]
    pages = spark.createDataFrame([(k, t, "h") for k, t in enumerate([*texts, texts[0]])], "page_id long, url string, host string")
    table = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/fr/", "block"), ("org", "/", "allow"), ("org", "/e", "block"), ("org", "/ez", "allow"), ("b.org", "/es/x", "allow")]
    got = {r["page_id"]: tuple(r)[1:] for r in urls.judge_urls(pages, spark.createDataFrame(table, "host string, path string, verdict string")).collect()}
    assert got[0] == got[9] == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert got[1][2:] == ("example.com/en/", "block") and got[2] == ("a.net", "/fr", None, "allow") and got[3][2:] == ("net/fr/", "block")
    assert got[4] == got[5] == ("", "", None, "allow") and got[7][2:] == ("com/", "allow") and got[8][2:] == ("org/e", "block")


def test_chat_folds_events(spark):
    log = [(1, 0, 0, "message", "user", "hi </s>"), (1, 1, 1, "message", "assistant", "wro"), (1, 1, 2, "delta", None, "ng"), (1, 1, 3, "regenerate", None, None), (1, 1, 4, "delta", None, "right␛"), (1, 2, 5, "message", "user", "gone"), (1, 2, 6, "delete", None, None), (1, 0, 7, "edit", None, "hello [INST]"), (None, 0, 0, "message", None, None)]
    out = chat.format_chats(spark.createDataFrame(log, "conv_id long, turn long, seq long, kind string, role string, text string")).collect()
    texts = {r["conv_id"]: "".join(x["formatted"] for x in out if x["conv_id"] == r["conv_id"]) for r in out}
    assert [(a, b) for a, b, *_ in chat.parse(texts[1])] == [("user", "hello [INST]"), ("assistant", "right␛")]
    assert [(a, b) for a, b, *_ in chat.parse(texts[None])] == [("", "")]
    for text in ("␛", "[[INST]", "<<s>␛␛n", "␛n<|im_end|>\n<|im_start|>", ""):
        assert chat.unescape(chat.escape(text)) == text and not any(c in chat.escape(text) for c in chat.CONTROL)


def test_rules(docs, rows):
    got = {r["doc_id"]: r for r in rules.judge_quality(docs, rules.DecisionList()).collect()}
    for doc_id, text, *_ in rows:
        words = WORD.findall(text or "")
        grams = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        seen = collections.Counter(grams)
        covered = {p for k, g in enumerate(grams) if seen[g] > 1 for p in range(k, k + 5)}
        assert (got[doc_id]["n_words"], got[doc_id]["word_chars"], got[doc_id]["n_repeat_words"]) == (len(words), sum(map(len, words)), len(covered))
    x = np.random.default_rng(0).random((600, len(rules.FEATURES)))
    x[:, [0, 4]] = np.where(x[:, [0, 4]] > 0.6, x[:, [0, 4]] + 1, x[:, [0, 4]])  # classes lie apart
    found = rules.cover(x, (x[:, 0] > 1) & (x[:, 4] <= 1))
    assert found.rules and {c.feature for c in found.rules[0]} == {"symbols_per_word", "upper_share"}


def test_rules_find_junk_rarer_than_a_percentile():
    rng = np.random.default_rng(4)
    x = rng.random((6000, len(rules.FEATURES)))
    bad = np.zeros(6000, bool)
    bad[rng.choice(6000, 40, replace=False)] = True
    x[bad, 5] = 2 + rng.random(40) / 10
    x[np.flatnonzero(bad)[0], 5] = 1000.0  # one far value must not hide the others
    found = rules.cover(x, bad).rules
    assert len(found) == 1 and [c.feature for c in found[0]] == ["exclaim_per_word"]
    assert found[0][0].above and 1 <= found[0][0].threshold < 2


def test_judged_columns_against_plain_counts(spark):
    """All columns of the contract, with and without a rule that fits."""
    texts = [None, "", "a # b\n\nx\nx\n \nx", "A! " * 12, " ".join(f"w{k}" for k in range(40)), "$$ " + " ".join(f"v{k}" for k in range(40))]
    docs = spark.createDataFrame([(k, t, 9, True) for k, t in enumerate(texts)] + [(None, texts[4], 9, True)], "doc_id long, text string, n_words long, kept boolean")
    decisions = rules.DecisionList(((rules.Condition("symbols_per_word", True, 0.01),),))
    got = {r["doc_id"]: r for r in rules.judge_quality(docs, decisions).collect()}
    for k, text in [*enumerate(texts), (None, texts[4])]:
        words = WORD.findall(text or "")
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        grams = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        repeated = {p for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for p in range(i, i + 5)}
        symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
        failed = len(words) < 10 or 100 * len(repeated) > 20 * len(words)
        own = (len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(repeated), failed, not failed and not symbols > 0.01 * len(words))
        assert tuple(got[k][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")) == own
    assert rules.judge_quality(docs.limit(0), decisions).count() == 0
    kept = rules.kept_by_rules(docs, decisions)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["4", "None"]


def test_classifier(spark, docs):
    labels = spark.createDataFrame([(5, 1, 0), (8, 1, 0), (9, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in perplexity.classify(docs, labels).collect()}
    assert got[5]["kept"] and not got[0]["kept"] and got[0]["perplexity"] is None
    assert perplexity.kept_by_perplexity(docs, labels).columns == docs.columns
    assert perplexity.classify(docs, labels.limit(0)).where("kept").count() > 5
    table = perplexity.table_of(perplexity.gathered(perplexity.kneser_ney(perplexity.count_ngrams(docs))))
    sums = (10.0 ** table.reshape(-1, perplexity.SYMBOLS)).sum(1)
    assert np.abs(sums - 1).max() < 1e-3


def jaccard(rows):
    sets = []
    for _, text, *_ in rows:
        w = WORD.findall((text or "").lower())
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            parent[root(i)] = root(j)
    least = collections.defaultdict(list)
    for k, r in enumerate(rows):
        least[root(k)].append(r[0])
    name = {k: min((x for x in v if x is not None), default=None) for k, v in least.items()}
    return sorted((str(r[0]), len(sets[k]), str(name[root(k)])) for k, r in enumerate(rows))


def test_set_join(spark, docs, rows):
    got = sorted((str(r[0]), r[1], str(r[2])) for r in setjoin.jaccard_components(docs).collect())
    assert got == jaccard(rows)
    assert setjoin.jaccard_components(docs.limit(0)).count() == 0
    assert sorted(str(r["doc_id"]) for r in setjoin.one_of_each(docs).collect()) == sorted({str(r[2]) for r in [(*x,) for x in got]})


def test_set_join_of_drifting_copies(spark):
    rng = np.random.default_rng(3)
    out, base = [], [f"b{k}" for k in range(120)]
    for k in range(60):
        own = base.copy()
        for p in rng.choice(120, rng.integers(0, 9), replace=False):
            own[p] = f"e{rng.integers(10**9)}"
        out.append((k, " ".join(own), None, None, 0, 0, 0))
    got = sorted((str(r[0]), r[1], str(r[2])) for r in setjoin.jaccard_components(spark.createDataFrame(out, DOCS)).collect())
    assert got == jaccard(out)


def test_lm_scores(docs, rows):
    got = brown.score_documents(docs).toPandas()
    tokens = [WORD.findall((r[1] or "").lower()) + [""] for r in rows]
    held = [zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 5 == 1 for r in rows]
    c = collections.Counter(t for own, out in zip(tokens, held, strict=True) if not out for t in own)
    n, v = sum(c.values()), len(c)
    expected = sorted((-1 if r[0] is None else r[0], len(t), sum(c[x] > 0 for x in t), sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t)) for r, t in zip(rows, tokens, strict=True))
    found = sorted((-1 if r.doc_id != r.doc_id else int(r.doc_id), r.n_tokens, r.n_known, r.base_score) for r in got.itertuples())
    assert [x[:3] for x in found] == [x[:3] for x in expected] and (got.train_tokens == n).all()
    assert np.allclose([x[3] for x in found], [x[3] for x in expected]) and (got.score < 0).all()
    assert brown.score_documents(docs.limit(0)).count() == 0


def test_search(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 3)) @ rng.normal(size=(3, 8))
    vectors = [(k, [float(c) for c in v], 0.0) for k, v in enumerate(x)] + [(900, None, 0.0), (901, [0.0] * 8, 0.0), (902, [float("nan")] * 8, 0.0), (903, [1.0], 0.0), (904, [None] * 8, 0.0), (0, [float(c) for c in x[0]], 0.0)]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, score double")
    got = neighbours.search(table, F.col("id") % 100 == 0).orderBy("query_id", "rank").collect()
    for q in (0, 100, 200):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        assert [r["vec_id"] for r in got if r["query_id"] == q] == np.argsort(d, kind="stable")[:10].tolist()
    assert neighbours.search(table.limit(0), F.col("id") % 100 == 0).count() == 0


def test_lm_classes_of_rarer_words(spark):
    """A rarer word's class comes from its neighbours, whatever its ending."""
    rng = np.random.default_rng(1)
    kinds = [[f"{a}{k}" for k in range(6)] for a in "xyz"]
    texts = [" ".join(rng.choice(kinds[k % 3]) for k in range(30)) for _ in range(300)]  # x, y and z in turn
    texts += [f"x{k % 6} ra{k}q z{k % 6} x{k % 6} y{k % 6} rb{k}q x{k % 6}" for k in range(40)]
    training = spark.createDataFrame([(t,) for t in texts], "text string")
    words = sorted(w for kind in kinds for w in kind)
    keys = {w: int(h) for w, h in zip(words, Words(pa.array([" ".join(words)])).hashes().view(np.int64), strict=True)}
    core = np.sort(np.array(list(keys.values())))
    member, g = brown.exchange(len(core) + 2, *brown.item_bigrams(training, core), classes=brown.CLASSES)
    rare = {r["key"]: r for r in brown.rarer_words(training, core, member, g).collect()}
    assert len(rare) == 80 and all(r["c"] == 1 for r in rare.values())
    of = {w: rare[int(Words(pa.array([w])).hashes().view(np.int64)[0])]["class"] for k in range(40) for w in (f"ra{k}q", f"rb{k}q")}
    own = [{int(member[np.searchsorted(core, keys[w])]) for w in kind} for kind in kinds]
    assert all(of[f"ra{k}q"] in own[1] and of[f"rb{k}q"] in own[2] for k in range(40))


def test_set_join_and_mix_by_row(spark):
    """Rows without an id, or whose id stands on another text too, are documents of their own."""
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(20)) for x in "abcd")
    rows = [(None, a), (None, b), (None, c), (1, c), (2, c), (2, d), (3, d), (None, ""), (None, " ")]
    docs = spark.createDataFrame([(k, t, "en", "a", 0, 0, 0) for k, t in rows], DOCS)
    got = sorted((str(r["doc_id"]), r["text"]) for r in setjoin.one_of_each(docs).collect())
    assert got == sorted([("None", a), ("None", b), ("1", c), ("2", d), ("None", ""), ("None", " ")])
    mixed = mixing.mixed_documents(docs, weights=(1,), share=2.0, max_epochs=2.0)
    assert sorted((str(r["doc_id"]), r["text"]) for r in mixed.collect()) == sorted(2 * [(str(k), t) for k, t in rows if t.strip()])
    short = spark.createDataFrame([(None, "one", "en", "a", 0, 0, 0), (None, "two three four", "en", "a", 0, 0, 0)], DOCS)
    words = [w for r in mixing.mixed_documents(short, weights=(1,), share=1.5).collect() for w in r["text"].split()]
    assert len(words) == 6


def near_copies(n, least, most, words=80):
    rng = np.random.default_rng(11)
    out, base = [], [f"b{k}" for k in range(words)]
    for k in range(n):
        own = base.copy()
        for p in rng.choice(words, rng.integers(least, most + 1), replace=False):
            own[p] = f"e{rng.integers(10**9)}"
        out.append((k, " ".join(own), None, None, 0, 0, 0))
    return out


@pytest.mark.parametrize("edits", [(0, 2), (1, 3)])
def test_set_join_work_grows_with_a_group(spark, monkeypatch, edits):
    """A group of near copies, with or without the text they come from: right, and compared in proportion to its size."""
    compared = []
    own = setjoin.compare

    def counted(pairs, texts):
        compared[-1] += pairs.count()
        return own(pairs, texts)

    monkeypatch.setattr(setjoin, "compare", counted)
    for n in (150, 600):
        rows = near_copies(n, *edits)
        compared.append(0)
        got = sorted((str(r[0]), r[1], str(r[2])) for r in setjoin.jaccard_components(spark.createDataFrame(rows, DOCS)).collect())
        if n == 150:
            assert got == jaccard(rows)
    assert compared[0] <= 3 * 150 and compared[1] <= 3 * 600


def test_set_join_of_null_and_repeated_ids(spark):
    """Texts are found by row: ids that are null or stand on many texts join nothing twice."""
    texts = [" ".join(f"{x}{k}" for k in range(30)) for x in range(100)]
    edited = [t.rsplit(" ", 1)[0] + " end" for t in texts]
    rows = [(key, t, None, None, 0, 0, 0) for key in (None, 7) for t in texts + edited] + [(None, texts[0], None, None, 0, 0, 0)] * 3
    docs = spark.createDataFrame(rows, DOCS)
    got = sorted((str(r[0]), r[1], str(r[2])) for r in setjoin.jaccard_components(docs).collect())
    assert got == jaccard(rows)
    plain = docs.select("doc_id", "text")
    nodes = setjoin.signatures(plain).groupBy("sig", "doc_id", "xh").agg(F.count(F.lit(1)).alias("rows"))
    nodes = nodes.groupBy("sig").agg(F.min(F.struct("doc_id", "xh", "rows")).alias("x")).select("sig", "x.*")
    found, drop = setjoin.texts_of(nodes.select("sig"), plain, nodes)
    assert found.count() == 200 and found.select("sig").distinct().count() == 200
    drop()
    kept = setjoin.one_of_each(docs).collect()
    assert len(kept) == 100 and {r["doc_id"] for r in kept} == {7}


def test_set_join_matches_sql(spark):
    import duckdb

    from textloom.llm import queries

    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    expected = sorted(db.execute(queries.ORACLE_SQL["op9_ngram_jaccard_join"]).fetchall())
    names = [d[0] for d in db.execute(queries.ORACLE_SQL["op9_ngram_jaccard_join"]).description]
    assert sorted(map(tuple, queries.QUERIES["op9_ngram_jaccard_join"](spark, sf).select(*names).collect())) == expected


def test_classifier_against_plain_kneser_ney(spark):
    """Perplexities and thresholds against a plain interpolated modified Kneser-Ney model."""
    texts = ["The cat sat, and the dog ran.", "A dog sat on the mat 12 times.", "the mat and the cat ran on", "Zq#x 99 !!"]
    rows = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(0, 1, 0), (1, 1, 0), (2, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    symbol = perplexity._SYMBOL
    padded = [[0] * 3 + [int(symbol[b]) for b in t.encode()] for t in texts]
    counts = {4: collections.Counter(tuple(s[k - 3 : k + 1]) for s in padded[:3] for k in range(3, len(s)))}
    for k in (3, 2, 1):
        counts[k] = collections.Counter(g[1:] for g in counts[k + 1])

    def discounts(c):
        n = [sum(v == k for v in c.values()) for k in (1, 2, 3, 4)]
        if not all(n[:3]):
            return 0.5, 0.75, 0.9
        y = n[0] / (n[0] + 2 * n[1])
        return tuple(min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), k - 0.05) for k in (1, 2, 3))

    def p(gram):
        if not gram:
            return 1 / 64
        c = counts[len(gram)]
        d = discounts(c)
        heirs = {g: v for g, v in c.items() if g[:-1] == gram[:-1]}
        if not heirs:
            return p(gram[1:])
        total, taken = sum(heirs.values()), sum(d[min(v, 3) - 1] for v in heirs.values())
        v = heirs.get(gram, 0)
        return ((v - d[min(v, 3) - 1]) / total if v else 0) + taken / total * p(gram[1:])

    def logs(s):
        return [math.log10(p(tuple(s[k - 3 : k + 1]))) for k in range(3, len(s))]

    own = [logs(s) for s in padded]
    mean = sum(map(sum, own[:3])) / sum(map(len, own[:3]))
    expected = [10 ** (-(sum(x) + perplexity.PRIOR * mean) / (len(x) + perplexity.PRIOR)) for x in own]
    got = sorted(perplexity.classify(rows, labels).collect(), key=lambda r: r["doc_id"])
    assert np.allclose([r["perplexity"] for r in got], expected, rtol=1e-4)
    limit = max(expected[:3]) * perplexity.SLACK
    assert np.allclose([r["threshold"] for r in got], limit, rtol=1e-4) and [r["kept"] for r in got] == [x <= limit for x in expected]
    assert [r["doc_id"] for r in perplexity.kept_by_perplexity(rows, labels).orderBy("doc_id").collect()] == [k for k, x in enumerate(expected) if x <= limit]


def test_exact_quantiles(spark):
    rng = np.random.default_rng(2)
    rows = [("a", float(x)) for x in np.round(rng.lognormal(1, 1, 500), 2)] + [(None, 3.0)] * 7 + [("b", 2.5)]
    got = {r["lang"]: r["value"] for r in perplexity.exact_quantile(spark.createDataFrame(rows, "lang string, value double"), 0.95).collect()}
    assert got == {k: sorted(v for x, v in rows if x == k)[math.ceil(0.95 * sum(x == k for x, _ in rows)) - 1] for k in ("a", None, "b")}


def test_pieces_hold_the_tokenizer_s_ids(docs, rows):
    """Each id lies in exactly one piece, with its checksum; sequences are full but for one a partition."""
    path = public_tokenizers.path("word_bpe_49k.json")
    got = packing.pack_documents(docs, path, length=64).toPandas()
    left = collections.Counter()
    for r, ids in zip(rows, Encoder(path).whole([r[1] or "" for r in rows]), strict=True):
        left[(r[0] if r[0] is not None else -1, *ids, 1)] += 1
    pieces = collections.defaultdict(list)
    for r in got.fillna({"doc_id": -1}).itertuples():
        pieces[(r.doc_id, r.doc_tokens)].append(r)
    for (doc_id, n), own in pieces.items():
        wanted = [k for k in left if k[0] == doc_id and len(k) - 1 == n for _ in range(left[k])]
        assert sum(r.length for r in own) == n * len(wanted)
        for r in own:
            assert any(zlib.crc32(np.array(k[1 + r.start : 1 + r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for k in wanted)
        starts = collections.Counter(p for r in own for p in range(r.start, r.start + r.length))
        assert len(starts) == n and set(starts.values()) == {len(wanted)}
    sizes = got.groupby("sequence_id").length.sum()
    assert (sizes < 64).sum() <= 4


def test_classifier_counts_all_trusted_texts(spark, monkeypatch):
    """However many are trusted, all of them are counted."""
    counted, real = [], perplexity.count_ngrams
    monkeypatch.setattr(perplexity, "count_ngrams", lambda docs: (counted.append(docs.count()), real(docs))[1])
    docs = spark.range(12_500).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    perplexity.train(docs, docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))).release()
    assert counted == [12_500]


@pytest.mark.parametrize("sent", [perplexity.SENT, 2])
def test_trusted_texts_are_counted_where_they_stand(spark, monkeypatch, sent):
    """Ids too many for Spark's own broadcast move no text; more than ``SENT`` give the same rows by a join."""
    monkeypatch.setattr(perplexity, "SENT", sent)
    docs = spark.createDataFrame([(k, f"text {k}") for k in (-5, 0, 3, 3, 4, 1 << 40, None)], "doc_id long, text string")
    known = spark.createDataFrame([(k,) for k in (1 << 40, 3, -5, 99)], "doc_id long")
    key = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(key, -1)
    try:
        rows, free = perplexity.of_trusted(docs, known)
        assert ("Exchange" in rows._jdf.queryExecution().executedPlan().toString()) == (sent == 2)
        assert sorted(r["doc_id"] for r in rows.collect()) == [-5, 3, 3, 1 << 40]
        free()
        none, free = perplexity.of_trusted(docs, known.limit(0))
        assert none.count() == 0
        free()
    finally:
        spark.conf.unset(key)
