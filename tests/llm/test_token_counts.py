"""Token counts against the sentencepiece library."""

import random

import public_tokenizers
import pytest
import sentencepiece

from gristmill.llm import queries, token_counts

MODEL = "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(MODEL))


def test_equals_the_library_on_odd_texts(library):
    r = random.Random(3)
    signs = [*"abcdefghij ▁ \n.,é日本語́😀Ab12 ", "the", "th e", "  ", "<s>", "<0x0A>", "\0", " "]
    texts = ["", " ", "   ", "a  b", "▁", " ▁▁ a", "<s> </s><unk><0x0A>", "ﬁ", "a" * 3000, "x" + " " * 33 + "y", "日本語のテキスト" * 50]
    texts += ["".join(r.choice(signs) for _ in range(r.randrange(1, 70))) for _ in range(4000)]
    count = token_counts.Counter(MODEL).count
    assert [count(t) for t in texts] == [len(x) for x in library.encode(texts)]


def test_memories_that_fill_change_nothing(library, monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED", 3)
    texts = ["one two three four five six " * 3, "six five four three", "un deux trois quatre"]
    count = token_counts.Counter(MODEL).count
    assert [count(t) for t in texts] == [len(x) for x in library.encode(texts)]


def test_rows(spark, library):
    long = " ".join(f"word{i % 977} naïve" for i in range(60_000))
    rows = [(1, "a b"), (1, "a b"), (None, "x"), (2, None), (3, ""), (4, long), (5, "é" * 10)]
    docs = spark.createDataFrame([(*x, "c", 1) for x in rows], "doc_id long, text string, n_tokens string, n_bytes int")
    got = sorted(map(str, token_counts.count_tokens(docs).collect()))
    want = []
    for i, t in rows:
        n = len(library.encode(t or ""))
        want.append(f"Row(doc_id={i}, n_bytes={len((t or '').encode())}, n_tokens={n}, over_limit={n > 4096})")
    assert got == sorted(want)
    assert token_counts.count_tokens(docs.limit(0)).count() == 0


def test_refuses_other_models():
    with pytest.raises(Exception):
        token_counts.Counter("byte_bpe_50k.json")


def test_query_counts_every_document(spark, sf_dir, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op12_token_counts(spark, sf_dir).collect()}
    ids = sorted(docs)
    want = dict(zip(ids, map(len, library.encode([docs[i] for i in ids])), strict=True))
    assert got == {i: (len(docs[i].encode()), want[i], want[i] > 4096) for i in ids}
