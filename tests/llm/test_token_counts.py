import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from foliate.llm.token_counts import CHUNK, Counter, count_tokens, proven, units

PATH = public_tokenizers.path("byte_bpe_50k.json")
WORDS = ["the", "of,", "Éèau", "x\n\ny", "12345", "  ", "\t", "<|endoftext|>", "don't", "!!###", "a b", "\x1c", "日本語", " "]


def whole(t):
    return len(Tokenizer.from_file(PATH).encode(t, add_special_tokens=False).ids)


@pytest.mark.parametrize("seed", range(6))
def test_huge_and_units_match_whole_encoding(seed):
    rng = random.Random(seed)
    text = " ".join(rng.choice(WORDS) for _ in range(1500))
    assert "".join(units(text)) == text
    tok = Tokenizer.from_file(PATH)
    want = len(tok.encode(text, add_special_tokens=False).ids)
    assert Counter(tok).many([text, text])[1] == want
    n, chunks = Counter(tok, chunk=300, overlap=10).huge(text)
    assert n == want and chunks > 5


def test_no_stable_boundary_widens_to_the_end():
    tok = Tokenizer.from_file(PATH)
    text = "abcdé" * 400 + "\n" * 300 + "z" * 900
    assert Counter(tok, chunk=200, overlap=20).huge(text)[0] == len(tok.encode(text).ids)


def test_rows(spark):
    rows = [(1, None, 5), (2, "", 5), (3, "the <|endoftext|> of", 5), (3, "the <|endoftext|> of", 5), (4, "ab " * 40000, 5)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, n_tokens int")
    got = sorted(map(tuple, count_tokens(docs, PATH).select("doc_id", "n_bytes", "n_tokens").collect()))
    assert got == sorted((i, len((t or "").encode()), whole(t or "")) for i, t, _ in rows)
    assert count_tokens(docs.limit(0), PATH).count() == 0


def test_unspaced_text_is_linear():
    tok = Tokenizer.from_file(PATH)
    rng = random.Random(3)
    line = lambda: "".join(chr(rng.randrange(0x4E00, 0x4F00)) for _ in range(40))
    seen = []

    class Counted(Counter):
        def encode(self, text):
            seen.append(len(text))
            return super().encode(text)

    for sep in ("\n", "，", "7"):
        text = sep.join(line() for _ in range(4000))
        seen.clear()
        assert Counted(tok).huge(text)[0] == len(tok.encode(text).ids)
        assert sum(seen) < 1.3 * len(text)
    for text in ("ab" * 60_000, "\n" * 60_000 + "x", " " * 50_000 + "'s" * 9_000, "é" * 30_000 + " word" * 9_000):
        seen.clear()
        assert Counted(tok).huge(text)[0] == len(tok.encode(text).ids)
        assert sum(seen) < 12 * len(text)


def test_proven_boundaries_split_every_text_exactly():
    tok = Tokenizer.from_file(PATH)
    rng = random.Random(5)
    parts = ["a", "É", "z1", "²", "½", "'s", "'", "’", "\n", " ", "\t", "\x85", "\u3000", "\x1c", "!", "<|endoftext|>", "<|", "|>", "日", "٣", "😀", "\u0301", "\u1e9e", "\ua7d1", "_", "\u200d"]
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(14))
        ids = tok.encode(text, add_special_tokens=False).ids
        for i in range(1, len(text)):
            if proven(text, i):
                assert ids == tok.encode(text[:i], add_special_tokens=False).ids + tok.encode(text[i:], add_special_tokens=False).ids, (text, i)


def test_the_table_s_long_documents_are_spliced(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"]: r for r in count_tokens(docs, PATH).collect()}
    tok = Tokenizer.from_file(PATH)
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = tok.encode_batch_fast([t for _, t in texts], add_special_tokens=False)
    assert [got[i]["n_tokens"] for i, _ in texts] == [len(e) for e in want]
    assert sum(r["n_chunks"] > 1 for r in got.values()) == sum(len(t) > CHUNK for _, t in texts) > 3
