"""Alignment of two tokenizers against a plain version with the libraries' own encoders."""

import collections
import hashlib
import itertools

import public_tokenizers
import pyarrow as pa
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from textloom.llm import align

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "Plain words, and numbers 12345.", None, "", " ", "\n", "a▁b", "line\r\n\r\nx;\r\n", "<|endoftext|> <s> </s> <unk> <0x0A>", "\n\nword  two\t\tthree \n",
    "①ﬁ 中文字符 🎉 x 　y Stteä é", "a" * 3000, "=-" * 3000 + "    " * 50, "tab\t x\x0b\x0cy \x00z", " lead  and trail  ", " ".join(f"w{k % 97}x{k}" for k in range(4000)),
]


def byte_table():
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in kept]
    return {chr(b): b for b in kept} | {chr(256 + n): b for n, b in enumerate(rest)}


def plain(rows):
    a, b, table = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B), byte_table()
    a.encode_special_tokens = True
    docs, count = [], collections.Counter()
    for doc_id, text in rows:
        x, y = [], []
        if text:
            x = [(i, bytes(table[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
            y = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
            if any(b"".join(t for _, t in s) != (" " + text).encode() for s in (x, y)):
                x, y = [], []
        of = [[k for k, (_, t) in enumerate(s) for _ in t] for s in (x, y)]  # each byte's token
        links = [(x[p][0], y[q][0]) for (p, q), _ in itertools.groupby(zip(*of, strict=True))]
        ends = [set(itertools.accumulate(len(t) for _, t in s)) for s in (x, y)]
        groups, at = [], [0, 0]
        done = [list(itertools.accumulate(len(t) for _, t in s)) for s in (x, y)]
        for end in sorted(ends[0] & ends[1]):
            to = [d.index(end) + 1 for d in done]
            groups.append("|".join(",".join(str(i) for i, _ in s[p:q]) for s, p, q in zip((x, y), at, to, strict=True)))
            at = to
        count.update(links)
        docs.append((doc_id, len(x), len(y), groups, links))
    best = collections.Counter()
    for (_, j), n in count.items():
        best[j] = max(best[j], n)
    out = [(str(d), n, m, len(g), len(k), sum(count[p] == best[p[1]] for p in k), sum(count[p] for p in k), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for d, n, m, g, k in docs]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    return [*enumerate(TEXTS), (13, TEXTS[13]), (None, "null id"), (None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, [2], "x") for r in rows], "doc_id long, text string, row long, a array<int>, pair string")


def got(df):
    return sorted((str(r[0]), *r[1:]) for r in df.collect())


def test_align(docs, rows):
    out = align.align(docs, A, B)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert got(out) == plain(rows)
    assert align.align(docs.limit(0), A, B).count() == 0


def test_counts_too_many_to_send(docs, rows, monkeypatch):
    monkeypatch.setattr(align, "SENT", 10)
    assert got(align.align(docs, A, B)) == plain(rows)


def test_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert got(align.align(docs, A, B)) == plain([tuple(r) for r in docs.collect()])


def test_pieces_encode_like_the_model():
    own, model = align.Pieces(B), SentencePieceProcessor(model_file=B)
    texts = [t for t in TEXTS if t]
    for _ in range(2):
        bounds, ids = own.encode(pa.array([" " + t for t in texts]))
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == model.encode(texts)


def test_texts_are_lined_up_a_row_each(docs, rows):
    """Every text is one row with its groups and links, and no token passes an interpreted function of Spark's."""
    lined = align.alignments(docs, A, B, 100_000)
    plan = lined.select(align._digest(lined["groups"]), "pairs")._jdf.queryExecution().executedPlan().toString()
    assert "lambdafunction" not in plan and "zip_with" not in plan
    own = lined.collect()
    assert len(own) == len(rows) and sum(r["n_groups"] > 0 for r in own) > 10
    for r in own:
        groups = [[x.split(",") for x in g.split("|")] for g in ",".join(map(str, r["groups"])).replace(",-1,", "|").split(",-2,")] if r["groups"] else []
        assert len(groups) == r["n_groups"] and len(r["pairs"]) == r["n_a"] + r["n_b"] - r["n_groups"]
        assert [sum(len(g[k]) for g in groups) for k in (0, 1)] == [r["n_a"], r["n_b"]]
        for k in (0, 1):
            ids = {int(i) for g in groups for i in g[k]}
            assert {divmod(p, 100_000)[k] for p in r["pairs"]} == ids  # every token has a link
