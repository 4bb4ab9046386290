"""The fast encoding against one without special tokens."""

import base64
import random

import pyarrow as pa
import tiktoken

from logloom.llm import alignment, tokens


def test_no_special_token_is_found_and_none_is_searched_at_every_byte():
    words = tokens.vocabulary()
    with open(words.ranks, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    plain = tiktoken.Encoding("plain", pat_str=tokens.SPLIT, mergeable_ranks=ranks, special_tokens={})
    encoding = tokens.byte_ranks(words.ranks)
    never = "".join(encoding.special_tokens_set)
    assert never  # the pattern of no special tokens is empty and matches everywhere
    for text in ("a word  and\n two", f"x{never}y {never} {never[:1]}", "漢字 😀\x00 it's 1234", never):
        ids = encoding.encode_to_numpy(text, allowed_special=set(), disallowed_special=())
        assert ids.tolist() == plain.encode_ordinary(text) and tokens.Encoder(words).ids(text).tolist() == ids.tolist()
        assert encoding.decode_bytes(ids.tolist()) == text.encode()
    a, _ = alignment.Both(alignment.public_files()).encode(never + " b")
    assert a.tolist() in ([], plain.encode_ordinary(f" {never} b"))


def test_many_texts_have_the_ids_of_each():
    draw, words = random.Random(7), tokens.vocabulary()
    parts = [" ", " ", " ", "  ", "\n", "\n\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", "\u2003", "\u3000", "the", "b'", "'ll", "Zé", "漢", "12", "!!", "\x00", "😀"]
    texts = ["", None, " ", "  ", "   ", "a \n", "\n a", "a\n ", "\n\nfoo\n\nbar baz", "x <|endoftext|> y", tokens.NEVER, f"a {tokens.NEVER} b"]
    texts += ["".join(draw.choices(parts, k=draw.choice((1, 2, 3, 5, 9, 30)))) for _ in range(5000)]
    for vocabulary, some in ((words, texts), (tokens.Vocabulary(words.path, None, words.special), texts[:200])):
        encoder, column = tokens.Encoder(vocabulary), pa.array(some, pa.string())
        wanted = [encoder.ids(t).tolist() for t in some]
        assert [ids.tolist() for ids in encoder.lists(column)] == wanted
        assert encoder.counts(column).tolist() == [len(w) for w in wanted]
        assert [ids.tolist() for ids in encoder.lists(column.slice(5, 90))] == wanted[5:95]
        assert not len(encoder.counts(column[:0])) and not list(encoder.lists(column[:0]))


def test_a_word_of_many_texts_is_encoded_once(spark, tmp_path, monkeypatch):
    from logloom.llm import training_order

    read = tokens.byte_ranks

    class Counting:
        def __init__(self, encoding):
            self.encoding = encoding

        def __getattr__(self, name):
            return getattr(self.encoding, name)

        def encode_to_numpy(self, text, **options):
            given.append(len(text))
            return self.encoding.encode_to_numpy(text, **options)

    given = []
    monkeypatch.setattr(tokens, "byte_ranks", lambda *at: Counting(read(*at)))
    texts = [" ".join(f"word{(i * j) % 50}" for j in range(1, 200)) for i in range(100)]
    encoder = tokens.Encoder(tokens.vocabulary())
    counts = encoder.counts(pa.array(texts))
    assert sum(given) < 0.05 * sum(map(len, texts))
    monkeypatch.undo()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    order = training_order.write_order(docs, str(tmp_path / "o"), length=32, per_shard=10)
    held = {r["doc_id"]: r["n"] for r in order.index.groupBy("doc_id").agg({"n_ids": "sum"}).withColumnRenamed("sum(n_ids)", "n").collect()}
    assert held == dict(enumerate(counts.tolist()))
