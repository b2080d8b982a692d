"""Batches of texts encoded together, against the tokenizers library text by text."""

import array
import random

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from cueloom.llm import token_files
from cueloom.llm.token_files import PieceEncoder


@pytest.fixture(scope="module")
def definition():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        return file.read()


def test_batches_as_the_library(definition, monkeypatch):
    """White space of all kinds at all places, special tokens, nulls and slices; the cut into parts does not matter."""
    rng = random.Random(4)
    some = [*"ab  \n\t'sd\xe9中1_,.　́\x1c\x85٣ſ", "ll", "<|endoftext|>", "\r\n", "word", " 've"]
    texts = [None, "", " ", "  ", "\n", " \n", "a ", "a\n", "<|endoftext|>"]
    texts += ["".join(rng.choice(some) for _ in range(rng.randint(0, 30))) for _ in range(2000)]
    library = Tokenizer.from_str(definition)
    library.no_truncation()
    library.no_padding()
    want = [array.array("I", library.encode(t or "", add_special_tokens=False).ids).tobytes() for t in texts]
    encoder, column = PieceEncoder(definition), pa.array(texts, pa.string())
    assert list(encoder.encode_all(column)) == want
    assert list(encoder.encode_all(column.slice(7, 90))) == want[7:97]
    assert list(encoder.encode_all(column.slice(0, 0))) == []
    monkeypatch.setattr(token_files, "TOGETHER", 100)
    assert list(PieceEncoder(definition).encode_all(column)) == want


def test_repeated_words_are_parted_once(definition):
    """The splitting pattern reads each distinct run of a batch once, not every text."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(50)]
    texts = [" ".join(rng.choice(words) for _ in range(100)) for _ in range(200)]
    encoder, read = PieceEncoder(definition), []
    parted = encoder.quick
    encoder.quick = lambda text: read.append(len(text)) or parted(text)
    assert list(encoder.encode_all(pa.array(texts))) == [PieceEncoder(definition).encode(t) for t in texts[:1]] + [encoder.encode(t) for t in texts[1:]]
    assert sum(read[: len(read) - len(texts) + 1]) < 2000
