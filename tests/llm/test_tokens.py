import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.tokens import Encoder, count_tokens, decode_ids, encode_texts, read_ranks, serialise

TEXTS = ["", None, " ", "Hello world", "<|endoftext|> and <unk>", "it's  we'll\n\n\tDON'T", "ünï ☃ 😀 日本語 ‍", "a" * 20000, "x y " * 5000, "\x00\x01", "▁under", "1234567890 12:30"]


def reference(text):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t.encode(text, add_special_tokens=False).ids if text else []


def test_equals_the_published_tokenizer(spark, vocabularies):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)] * 2, "doc_id bigint, text string, ids int")
    ids = encode_texts(df)
    got = [(r.doc_id, list(r.ids)) for r in ids.collect()]
    assert sorted(got) == sorted([(i, reference(t)) for i, t in enumerate(TEXTS)] * 2)
    assert {r.doc_id: r.n_tokens for r in count_tokens(df).collect()} == {i: len(x) for i, x in got}
    assert {r.doc_id: r.text for r in decode_ids(ids).collect()} == {i: t or "" for i, t in enumerate(TEXTS)}
    assert encode_texts(df.limit(0)).count() == 0


def test_unknown_ids(spark, vocabularies):
    df = spark.createDataFrame([(1, [99999]), (2, None), (3, [])], "doc_id bigint, ids array<int>")
    assert {r.doc_id: r.text for r in decode_ids(df).collect()} == {1: None, 2: None, 3: ""}


def test_random_texts(vocabularies):
    encoder = Encoder(serialise(read_ranks()))
    tokens = read_ranks()

    @settings(max_examples=300, deadline=None)
    @given(st.text(max_size=60))
    def check(text):
        text = text.encode("utf-8", "ignore").decode()
        ids = encoder.encode(text)
        assert ids == reference_fast(text) and b"".join(tokens[i] for i in ids).decode() == text

    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    reference_fast = lambda x: t.encode(x, add_special_tokens=False).ids
    check()


def test_forgetting_changes_nothing(vocabularies, monkeypatch):
    from tidemark.llm import tokens as T

    monkeypatch.setattr(T, "REMEMBERED", 6)
    encoder = Encoder(serialise(read_ranks()))
    rng = random.Random(1)
    for _ in range(5):
        text = " ".join(rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) for _ in range(60))
        assert encoder.encode(text) == reference(text)
