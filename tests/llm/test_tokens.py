"""Token counts and byte-level BPE against the libraries on whole texts; round trips."""

import hashlib
import random
import struct

import pytest
from pyspark.sql import functions as F

from haetae.llm import bpe, queries, token_count
from haetae.llm.common import read_table

P = pytest.importorskip("public_tokenizers")


def odd_texts(n=1500):
    rnd = random.Random(3)
    pool = [chr(rnd.randrange(0x20000)) for _ in range(3000)]
    pool = [c for c in pool if not 0xD800 <= ord(c) <= 0xDFFF] + list(" \n\t\r▁'sabcABC123.,!?  \n\n  é한;)}") * 60
    fixed = ["", " ", "  ", "\n", " \n", "\n ", "a ", " a", "<s> </s> <unk> <0x0A>", "<|endoftext|>", "a\x00b", "x" * 3000, " " * 70, "\n" * 40, "\U00019003's \U0001fbff't"]
    return fixed + ["".join(rnd.choices(pool, k=rnd.randrange(60))) for _ in range(n)]


@pytest.fixture(scope="module")
def ranks():
    return bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def tiktoken_encode(ranks):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def test_counts_equal_the_library():
    import sentencepiece

    with open(P.path("piece_bpe_32k.model"), "rb") as file:
        model = file.read()
    independent, whole = token_count.prove(model)
    assert independent and len(whole) > 10_000
    library, counts = sentencepiece.SentencePieceProcessor(model_proto=model), token_count.Counts(model, whole)
    for text in odd_texts():
        assert counts.of(text) == len(library.encode(text)), repr(text)


def test_memory_of_counts_is_bounded(monkeypatch):
    monkeypatch.setattr(token_count, "REMEMBERED", 50)
    with open(P.path("piece_bpe_32k.model"), "rb") as file:
        model = file.read()
    counts = token_count.Counts(model, token_count.prove(model)[1])
    n = counts.of(" ".join(f"zq{i}x" for i in range(500)))
    assert n == len(counts.processor.encode(" ".join(f"zq{i}x" for i in range(500)))) and len(counts) <= len(counts.whole) + 52


def test_query_4(spark, small, edge):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text or "" for r in read_table(spark, small, "documents").collect()}
    rows = queries.op4_token_count(spark, small).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n = len(library.encode(texts[r.doc_id]))
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(texts[r.doc_id].encode()), n > 4096)
    made = token_count.count_tokens(edge, P.path("piece_bpe_32k.model"))
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in made.collect())
    assert got == sorted((r.doc_id or 0, len((r.text or "").encode()), len(library.encode(r.text or ""))) for r in edge.collect())
    assert token_count.count_tokens(edge.limit(0), P.path("piece_bpe_32k.model")).collect() == []


def test_ids_equal_tiktoken(ranks, tiktoken_encode):
    codec = bpe.Codec(bpe.tokenizer_json(ranks, P.PATTERN), P.PATTERN)
    texts = odd_texts()
    for text, packed, made in zip(texts, codec.encode_packed(texts), codec.encode(texts)):
        ids = tiktoken_encode(text)
        assert list(struct.unpack(f"<{len(packed) // 4}I", packed)) == ids == made.ids, repr(text)
        assert codec.decode_bytes(ids) == text.encode() and "".join(codec.decode_stream(ids)) == text


def test_both_engines_split_alike():
    """Every character below U+10000 between letters, digits, spaces and signs, under two patterns."""
    import re

    import regex

    wide = r"[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]|\s+(?!\S)|\s+"
    chars = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000]
    for pattern in (P.PATTERN, wide):
        one, other = regex.compile(pattern), re.compile(bpe.plain_pattern(pattern))
        for c in chars:
            text = f"a{c}b {c}1 {c}  {c}.{c}'{c}s"
            assert one.findall(text) == other.findall(text), hex(ord(c))
    for other in (r"\p{Lu}+", r"(?i:'s)", r"a++", r"a+?", r"(a)", r"[[a]]", r"[]\p{L}]", r"[^]a]", r"\bx", r"[a\S]", "[a--b]", "\\"):
        assert bpe.plain_pattern(other) is None, other


def test_remembered_matches_are_bounded(ranks, tiktoken_encode, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 20)
    codec = bpe.Codec(bpe.tokenizer_json(ranks, P.PATTERN), P.PATTERN)
    for i in range(60):
        text = f"the common words and zq{i}x \U0001f600"
        assert codec.encode_packed([text]) == [struct.pack(f"<{len(ids)}I", *ids) for ids in [tiktoken_encode(text)]]
        assert codec.decode_packed(codec.encode_packed([text])[0]) == text.encode()
        assert len(codec.packed) <= 40 and len(codec.older) <= 40
    assert " common" in codec.packed or " common" in codec.older


def test_split_characters(ranks):
    codec = bpe.Codec(bpe.tokenizer_json(ranks, P.PATTERN), P.PATTERN)
    ids = codec.encode(["한😀"])[0].ids
    shown = codec.decode_stream(ids)
    assert len(ids) > 2 and "".join(shown) == "한😀" and "" in shown
    assert codec.decode_stream(ids[:-1])[-1].endswith("\ufffd")


def test_query_7(spark, small, edge, tiktoken_encode):
    texts = {r.doc_id: r.text or "" for r in read_table(spark, small, "documents").collect()}
    rows = queries.op7_byte_bpe(spark, small).collect()
    assert len(rows) == len(texts)

    def expected(text):
        ids = tiktoken_encode(text)
        return len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest()

    for r in rows:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == expected(texts[r.doc_id])
    got = sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(edge, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect())
    assert got == sorted((r.doc_id or 0, *expected(r.text or "")) for r in edge.collect())


def test_encode_decode_frames(spark, edge):
    path = P.path("byte_bpe_50k.tiktoken")
    made = bpe.encode(edge, path, P.PATTERN)
    texts = sorted((r.doc_id or 0, r.text or "") for r in edge.collect())
    assert sorted((r.doc_id or 0, r.text) for r in bpe.decode(made, path, P.PATTERN).collect()) == texts
    row = bpe.encode(spark.createDataFrame([(1, "a 한b")], "doc_id long, text string"), path, P.PATTERN).first()
    covered = [("a 한b"[a:b], a, b) for a, b in zip(row.begins, row.ends)]
    assert len(row.ids) == len(row.begins) == len(row.ends) and covered[0] == ("a", 0, 1) and covered[-1] == ("b", 3, 4)
    assert any(a == 2 or b == 3 for _, a, b in covered)
    nulls = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert bpe.decode(nulls, path, P.PATTERN).collect() == [(1, "")]


def test_any_rank_file(spark):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    df = spark.createDataFrame([(1, "Grüße, 世界!")], "doc_id long, text string")
    assert bpe.decode(bpe.encode(df, path, P.PATTERN), path, P.PATTERN).first().text == "Grüße, 世界!"
    assert bpe.digests(df.withColumn("n_tokens", F.lit(0)), path, P.PATTERN).count() == 1
