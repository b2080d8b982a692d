"""Details of single operators: the chain's marginals, chat escapes, edit bounds, components, accuracy."""

import itertools
import random
import struct

import brute
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cueloom.llm import bpe, chat, components, jaccard, lines, token_files, toxicity, winnow
from cueloom.llm.query_chat import TRAP


def test_marginals_equal_enumeration():
    field = toxicity.Field()
    field.bias, field.step = -0.7, np.array([[0.2, -0.4], [0.1, 0.9]])
    field.word = {b"a": 2.0, b"b": -1.0, b"c": 0.3}
    words = [b"a", b"c", b"b", b"a", b"x", b"c"]
    logits = [field.bias + field.word.get(w, 0.0) for w in words]
    mass = np.zeros(len(words))
    total = 0.0
    for states in itertools.product((0, 1), repeat=len(words)):
        weight = np.exp(
            sum(z for z, s in zip(logits, states, strict=True) if s)
            + sum(field.step[a, b] for a, b in zip(states, states[1:], strict=False))
        )
        total += weight
        mass += weight * np.array(states)
    assert np.allclose(field.marginals(words), mass / total)


def test_held_out_accuracy(spark):
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = entry.queries()["op6_toxic_spans"](spark, sf).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r.predicted for r in rows if not r.toxic) == 0
    assert sum(r.predicted for r in rows if r.toxic) >= 0.7 * sum(r.toxic for r in rows)


def test_chat_round_trip(spark):
    texts = [TRAP, r"a <\| b <\\|im_end|> <|", "", None, "<", "|x", "\n\n", "%0A\\%25"]
    roles = ["system", "user", "assistant", "user", "assistant", "we%0Aird\n<|role", None, "user"]
    rows = [(7, k, r, t, "clash") for k, (r, t) in enumerate(zip(roles, texts, strict=True))]
    rows += [(None, 0, "user", "q", "c"), (None, None, "user", "first", "c"), (8, 0, "assistant", "a", "c"), (8, 0, "assistant", "a", "c")]
    table = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string, formatted string")
    made = chat.format_chat(table).withColumns({
        "turns": chat.read_turns(F.col("formatted")), "loss": chat.read_loss(F.col("formatted"), F.col("loss_spans")),
    })
    got = {r.conv_id: r for r in made.collect()}
    assert [(t.role, t.text) for t in got[7].turns] == [(r or "", t or "") for r, t in zip(roles, texts, strict=True)]
    assert got[7].loss == [texts[2], texts[4]]
    assert not got[7].valid and got[7].first_bad == 5 and got[7].state == "invalid"
    assert [t.text for t in got[None].turns] == ["first", "q"] and got[None].first_bad == 1
    assert len(got[8].turns) == 2 and got[8].first_bad == 0
    parts = chat.segments(table).filter("conv_id = 7").orderBy("segment").collect()
    assert "".join(p.text for p in parts) == got[7].formatted and len(parts) == 24
    assert chat.format_chat(table.limit(0)).count() == 0


def test_half_and_variant_keys_cover_every_edit():
    rng = random.Random(3)

    def half(words):
        return lines.half_keys([b"%d" % w for w in words.tolist()])

    for _ in range(300):
        own = np.array([rng.getrandbits(64) for _ in range(rng.randint(8, 20))], np.uint64)
        at = rng.randrange(len(own))
        new = np.uint64(rng.getrandbits(64))
        for other in (
            np.concatenate([own[:at], [new], own[at + 1 :]]).astype(np.uint64), np.delete(own, at),
            np.insert(own, at, new), np.append(own, new),
        ):
            assert lines.within_one_edit(own, other) and brute.one_edit(own.tolist(), other.tolist())
            assert set(half(own)) & set(half(other))
            assert set(lines.variant_keys(own).tolist()) & set(lines.variant_keys(other).tolist())


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(k, k + 1) for k in range(0, 60)] + [(100 + rng.randrange(40), 100 + rng.randrange(40)) for _ in range(30)]
    edges += [(500, 501 + k) for k in range(50)] + [(5, 5)]
    root = {n: n for e in edges for n in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    frame = spark.createDataFrame([*edges, (3, None)], "a bigint, b bigint")
    got = {r.node: r.root for r in components.components(frame).collect()}
    assert got == {n: find(n) for n in root if find(n) != n}


def test_jaccard_with_tiny_chunks(spark, monkeypatch):
    """Groups far larger than a chunk, chains of near copies, and copies."""
    monkeypatch.setattr(jaccard, "CHUNK", 4)
    monkeypatch.setattr(jaccard, "PART", 60)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(60)]
    rows, own = [], list(base)
    for k in range(40):
        if k % 3 == 0:
            own = list(own)
            own[rng.randrange(60)] = word()
        rows.append((k, " ".join(own)))
    for k in range(40, 80):
        mine = list(base)
        for _ in range(rng.randint(0, 3)):
            mine[rng.randrange(60)] = word()
        rows.append((k, " ".join(mine[: rng.randint(45, 60)])))
    shared = [word() for _ in range(30)]
    rows += [(k, " ".join([*shared, *[word() for _ in range(rng.randint(1, 14))]])) for k in range(80, 120)]
    want = [(d, n, c) for (d, _), (n, c, _) in zip(rows, brute.components(rows), strict=True)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = jaccard.jaccard_components(table).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_ids_of_every_letter_and_number_equal_the_library():
    """Also of characters newer than this Python: one text around each of them."""
    import unicodedata

    characters = [c for c in map(chr, range(0x32000)) if unicodedata.category(c) in ("Cn", "Nl", "No", "Nd") and not 0x2FE0 < ord(c) < 0x2FF0]
    characters += [chr(c) for c in range(0x0, 0x32000, 41) if not 0xD800 <= c <= 0xDFFF]
    for name, encode in (
        ("word_bpe_49k.json", bpe.load(public_tokenizers.path("word_bpe_49k.json")).encode),
        ("byte_bpe_50k.json", token_files.PieceEncoder(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()).encode),
    ):
        library = Tokenizer.from_file(public_tokenizers.path(name))
        for c in characters:
            text = f"a{c}b 1{c}2 {c}! {c}"
            ids = encode(text)
            assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == library.encode(text, add_special_tokens=False).ids, hex(ord(c))


def test_winnowing_is_linear_in_repeated_words():
    """100,000 equal words against an item of as many, and periods of other lengths."""
    import time

    import numpy as np

    began = time.time()
    index = winnow.Index([("a", [b"x"] * 100_000), ("b", [b"x", b"y", b"z"] * 500), ("c", [b"x"] * 9)], 8, 13)
    spans = index.spans(index.number([b"x"] * 100_000))
    assert sorted(spans) == [(0, 0, 100_000), (2, 0, 100_000)]
    words = [b"q"] * 20 + [b"z", b"x", b"y"] * 3000 + [b"q"] + [b"x"] * 12
    assert sorted(index.spans(index.number(words))) == [(1, 20, 9020), (2, 9021, 9033)]
    assert time.time() - began < 20
    assert len(index.spans(np.empty(0, np.uint64))) == 0


def test_quality_survives_filters(spark):
    from cueloom.llm import quality

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    made = quality.score_quality(docs, docs.filter("doc_id < 40"), buckets=512)
    rows = made.collect()
    for condition in ("kept", "NOT base_failed", "score > 0", "n_repeat_words > 3 AND NOT kept"):
        assert made.filter(condition).count() == spark.createDataFrame(rows, made.schema).filter(condition).count()
    assert made.groupBy("kept").count().count() <= 2
