"""A vocabulary above the look-up size is joined only for its rarer words; user tokenizers get pieces of a batch."""

from nearline.operators import tokenize as K


def test_only_rare_words_are_joined(spark, monkeypatch):
    monkeypatch.setattr(K, "ID_RANGE", 4)
    docs = spark.createDataFrame([(1, "aa bb aa cc aa"), (2, None), (1, "rare1 aa rare2 bb"), (None, "bb rare2"), (3, ""), (4, "aa zz")], "id long, text string")
    vocab = K.fit_vocab(docs.where("text <> 'aa zz'"))
    want = sorted(map(repr, K.tokenize(docs, vocab).collect()))
    seen, real = [], K.with_row_key
    monkeypatch.setattr(K, "with_row_key", lambda df: seen.append(real(df)) or seen[-1])
    for size in (0, 120, 140):
        assert sorted(map(repr, K.tokenize(docs, vocab, lookup_bytes=size).collect())) == want
    words = sorted(w for r in seen[-1].select("_nl_missing").collect() for w in r[0])
    assert 0 < len(words) < 8 and "aa" not in words  # of 14 words


def test_user_tokenizer_gets_pieces(spark, monkeypatch):
    monkeypatch.setattr(K, "ENCODE_BYTES", 40)

    class Sizes:
        def encode(self, texts):
            assert len(texts) == 1 or sum(map(len, texts)) <= 40
            return [[len(t), len(texts)] for t in texts]

    most = K.ENCODE_BYTES
    texts = ["x" * n for n in (5, 100, 0, 20, 20, 1)]
    import pyarrow as pa
    assert list(K._pieces(pa.array([*texts, None]), most)) == [(0, 1), (1, 1), (2, 3), (5, 2)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1)
    got = {r["id"]: r["input_ids"][0] for r in K.tokenize_with(df, Sizes).collect()}
    assert got == {i: len(t) for i, t in enumerate(texts)}
