"""Long, repetitive and unsegmented words encode like the tokenizer library, in bounded time and memory."""

import random

import pytest

from strandline.llm import bpe
from strandline.llm.queries import vocabulary_path

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def drawn(seed, alphabet, n):
    rng = random.Random(seed)
    return "".join(rng.choice(alphabet) for _ in range(n))


CASES = {
    "50,000 letters": lambda: drawn(1, LETTERS, 50_000),
    "base 64": lambda: drawn(2, LETTERS + LETTERS.upper() + "0123456789+/", 40_000),
    "bases": lambda: drawn(3, "ACGT", 60_000),
    "words of 150 letters": lambda: " ".join(drawn(i, LETTERS, 150) for i in range(4_000)),
    "40,000 words of 150 letters": lambda: " ".join(drawn(i, LETTERS, 150) for i in range(40_000)),
    "Han characters": lambda: drawn(4, "".join(map(chr, range(0x4E00, 0x9FA5))), 200_000),
    "one letter": lambda: "a" * 70_001,
    "dashes and spaces": lambda: "-" * 30_001 + " " * 20_003 + "=" * 10_007,
    **{f"period {n}": lambda n=n: drawn(n, "abc", n) * (9_000 // n) for n in (2, 3, 4, 5, 7, 11, 13, 31, 97)},
    "a period that changes": lambda: "abcde" * 1_000 + "abcdef" * 1_000 + "bc" * 2_000,
    "thousands of lengths": lambda: " ".join("the" * k for k in range(120)),
}


@pytest.mark.parametrize("name", CASES)
def test_long_words_encode_like_the_library(name):
    import public_tokenizers
    import tiktoken

    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(vocabulary_path()), special_tokens={})
    tok = bpe.worker_tokenizer(vocabulary_path(), public_tokenizers.PATTERN)
    text = CASES[name]()
    [(decimal, decoded)] = tok.documents([text])
    assert decimal == " ".join(map(str, reference.encode_ordinary(text))) and decoded == text.encode()
    tok.forget()


def test_random_words_of_few_letters_splice_like_the_library():
    import public_tokenizers
    import tiktoken

    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(vocabulary_path()), special_tokens={})
    tok = bpe.worker_tokenizer(vocabulary_path(), public_tokenizers.PATTERN)
    rng = random.Random(9)
    texts = ["".join(rng.choice(LETTERS[: rng.randrange(1, 9)]) * rng.randrange(1, 40) for _ in range(rng.randrange(1, 60))) for _ in range(300)]
    for t, (decimal, _) in zip(texts, tok.documents(texts)):
        assert [int(x) for x in decimal.split()] == reference.encode_ordinary(t)


def test_a_table_too_large_to_decode_at_once_is_halved():
    import duckdb

    import public_tokenizers

    tok = bpe.worker_tokenizer(vocabulary_path(), public_tokenizers.PATTERN)

    class Small:
        """The database, out of memory for more than 30 words."""

        def __init__(self, db):
            self.db = db

        def sql(self, text):
            if "string_agg" in text and self.db.sql(f"SELECT count(*) FROM {text.split('FROM ')[1].split()[0]}").fetchall()[0][0] > 30:
                raise duckdb.OutOfMemoryException("too much")
            return self.db.sql(text)

        def __getattr__(self, name):
            return getattr(self.db, name)

    whole, tok._db = tok._db, Small(tok._db)
    try:
        lists = [[i, i + 1] for i in range(200)]
        halved = tok.decode_lists(lists)
    finally:
        tok._db = whole
    assert halved == tok.decode_lists(lists)
