import hashlib
import random
import sys

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from kinfold.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def model():
    with open(PATH, "rb") as file:
        return bpe.PrefixTokenizer(file.read())


def texts():
    rng = random.Random(7)
    pools = ["abcdefghij ", "ab", "aeiou thequickbrown", " \n\t", "0123456789", "!?'.,s t re ll", "éüñß日本😀", "  \x1c\x1f\x85\r\x0b", "ABCxyz_-=/"]
    out = ["", " ", "  ", "a", "it's we'll I'M 'S", "<|endoftext|>", "a<|endoftext|> <|endoftext|>b<|endoftext", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa", " " * 50 + "x", "\n\n x \n y  z\t", "x" * 3000]
    for _ in range(400):
        out.append("".join(rng.choice(rng.choice(pools)) for _ in range(rng.randrange(60))))
    return out


def test_ids_and_round_trip_equal_the_library(model):
    reference = Tokenizer.from_file(PATH)
    for text in texts():
        packed, raw = model.encode(text)
        ids = [int.from_bytes(packed[i : i + 4], sys.byteorder) for i in range(0, len(packed), 4)]
        assert ids == reference.encode(text, add_special_tokens=False).ids, repr(text)
        assert raw.decode() == reference.decode(ids, skip_special_tokens=False), repr(text)


def test_documents(spark):
    rows = [(i, t, "x") for i, t in enumerate(texts())] + [(None, None, "x"), (0, "", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    found = bpe.digest(bpe.encode_documents(docs, PATH)).collect()
    assert len(found) == len(rows)
    reference = Tokenizer.from_file(PATH)
    want = sorted(
        (str(i), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
        for i, t, _ in rows
        for ids in [reference.encode(t or "", add_special_tokens=False).ids]
    )
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in found) == want


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode_documents(docs, PATH).collect() == []


def test_long_pieces_are_not_remembered():
    with open(PATH, "rb") as file:
        model = bpe.PrefixTokenizer(file.read())
    reference = Tokenizer.from_file(PATH)
    rng = random.Random(3)
    text = "start " + " ".join("".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(500)) + "。" + "x1" * 200 for _ in range(30))
    packed, raw = model.encode(text)
    assert [int.from_bytes(packed[i : i + 4], sys.byteorder) for i in range(0, len(packed), 4)] == reference.encode(text, add_special_tokens=False).ids
    assert raw.decode() == text
    assert max(map(len, [*model.pieces, *model.words])) <= bpe.LONGEST
