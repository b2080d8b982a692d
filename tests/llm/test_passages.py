"""Repeated passages against brute force, where a shortcut once lost links or words."""

import random

import brute
import numpy as np

from cueloom.llm import jaccard, paragraphs
from cueloom.llm.components import components


def line(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))


def edited(text, *places):
    own = text.split(" ")
    for k in places:
        own[k] = f"changed{k}"
    return " ".join(own)


def starts(text):
    """First words of a text's content cuts."""
    return paragraphs.content_cuts(paragraphs.word_hashes(text.encode().split())).tolist()


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)


def groups(roots):
    out = {}
    for node, root in roots.items():
        out.setdefault(root, set()).add(node)
    return {frozenset(g) for g in out.values() if len(g) > 1}


def test_links_across_chunks(spark, monkeypatch):
    """One block of 40 sets in chunks of 4: chains of sets, each linked with its neighbours only."""
    monkeypatch.setattr(jaccard, "CHUNK", 4)
    monkeypatch.setattr(jaccard, "PART", 60)
    sets = {100 * c + k: set(range(1000 * c + 2 * k, 1000 * c + 2 * k + 20)) for c in range(4) for k in range(10)}
    rows = [(s, 1, bytearray(np.array(sorted(own), np.uint64).tobytes())) for s, own in sets.items()]
    table = spark.createDataFrame(rows, "sid long, block long, tokens binary")
    found = components(jaccard.all_links(table, 3, 4)).collect()
    want = {frozenset(100 * c + k for k in range(10)) for c in range(4)}
    assert groups({r.node: r.root for r in found} | {r.root: r.root for r in found}) == want


def test_passages_in_small_chunks(spark, monkeypatch):
    """The result does not depend on the size of a chunk."""
    rng = random.Random(3)
    base = line(rng, 24)
    texts = [edited(base, *rng.sample([0, 1, 22, 23], rng.randint(0, 2))) + " " + line(rng, 30) for _ in range(40)]
    docs = frame(spark, texts)
    whole = {tuple(map(str, r)) for r in paragraphs.repeated_passages(docs).collect()}
    monkeypatch.setattr(jaccard, "CHUNK", 4)
    monkeypatch.setattr(jaccard, "PART", 60)
    assert {tuple(map(str, r)) for r in paragraphs.repeated_passages(docs).collect()} == whole


def removed(row):
    return {k for s in row.spans for k in range(s["first"], s["last"])}


def test_near_repeat_inside_one_text(spark):
    """A passage again in the same text, with a word at the edge of its paragraphs changed."""
    rng = random.Random(5)
    texts = []
    for _ in range(30):
        base = line(rng, 300)
        at = int(starts(base)[3])
        own = base.split(" ")
        copy = [*own[at : at + 23], "changed"]
        texts.append(" ".join([*own, *line(rng, 40).split(" "), *copy, *line(rng, 40).split(" ")]))
    hit = [r for r in paragraphs.repeated_passages(frame(spark, texts)).collect() if r.spans]
    want = [r for r in texts if any(340 == a for a in starts(r))]
    assert len(want) > 10 and len(hit) >= len(want)


def test_spoken_keys_lose_no_pair():
    """Each pair of paragraphs that share a key and do not overlap is found through the keys sent."""
    rng = random.Random(6)
    for _ in range(20):
        at = np.array(sorted(rng.sample(range(0, 200), 25)))
        keys = np.array([[rng.randint(1, 9), rng.randint(10, 19)] for _ in at], np.uint64)
        sent, held = paragraphs._spoken(at, keys)
        speakers = {k: {k} for k in range(len(at))}
        for own, speaker in held:
            assert 0 <= at[own] - at[speaker] < paragraphs.WIDTH
            speakers[own].add(speaker)
        holders = {}
        for k, key in enumerate(keys.ravel()):
            if sent[k]:
                holders.setdefault(int(key), set()).add(k // 2)
        for a in range(len(at)):
            for b in range(a):
                if at[a] - at[b] >= paragraphs.WIDTH:
                    for key in {int(k) for k in keys[a]} & {int(k) for k in keys[b]}:
                        x, y = holders[key] & speakers[a], holders[key] & speakers[b]
                        assert x and y and len(x | y) > 1


def test_natural_paragraphs_with_interior_edits(spark):
    """Lines and blocks with words changed anywhere, against the Jaccard similarity of all pairs."""
    rng = random.Random(8)
    texts = []
    for k in range(60):
        base = line(rng, rng.randint(45, 90))
        changed = edited(base, *rng.sample(range(3, len(base.split(" ")) - 3), rng.choice([1, 1, 2])))
        mark = "\n\n" if k % 2 else "\n"
        texts += [line(rng, 40) + mark + base, line(rng, 45) + mark + changed]
    rows = {r.doc_id: r for r in paragraphs.repeated_passages(frame(spark, texts)).collect()}
    near = [k for k in range(0, len(texts), 2) if alike(texts[k].split("\n")[-1], texts[k + 1].split("\n")[-1])]
    assert len(near) > 20
    found = [k for k in near if set(range(45, 45 + len(texts[k + 1].split("\n")[-1].split(" ")))) <= removed(rows[k + 1])]
    assert len(found) >= len(near) - 1 and rows[near[0]].spans == []
    far = [k for k in range(0, len(texts), 2) if k not in near]
    assert all(not set(range(45)) & removed(rows[k + 1]) for k in far)


def alike(a, b):
    x, y = brute.shingle_set(a), brute.shingle_set(b)
    return 4 * len(x & y) >= 3 * len(x | y)


def test_short_blocks(spark):
    """Blocks and texts of fewer words than a cut."""
    texts = ["one two three four five six seven", "head line\n\nOne two three four five six seven", "ab cd", "ab cd", "ef gh\n\nij"]
    got = {r.doc_id: sorted(removed(r)) for r in paragraphs.repeated_passages(frame(spark, texts)).collect()}
    assert got == {0: [], 1: [2, 3, 4, 5, 6, 7, 8], 2: [], 3: [0, 1], 4: []}


def test_whole_common_run_is_removed(spark):
    """A repeated passage inside other words goes to its last word, a copied text whole."""
    rng = random.Random(9)
    passages = [line(rng, rng.randint(51, 140)) for _ in range(25)]
    pads = [line(rng, rng.randint(20, 60)) for _ in range(25)]
    texts = [f"{line(rng, 30)} {p} {line(rng, 30)}" for p in passages]
    texts += [f"{pad} {p} {line(rng, 30)}" for pad, p in zip(pads, passages, strict=True)]
    copies = [line(rng, n) for n in (5, 23, 24, 60, 300)]
    texts += [*copies, *copies]
    rows = {r.doc_id: r for r in paragraphs.repeated_passages(frame(spark, texts)).collect()}
    for k, (pad, p) in enumerate(zip(pads, passages, strict=True)):
        first = len(pad.split(" "))
        assert rows[k].spans == []
        (span,) = rows[25 + k].spans
        # A similar cut may reach two words beyond the passage.
        assert first - 2 <= span["first"] <= first and 0 <= span["last"] - first - len(p.split(" ")) <= 2
    for k, c in enumerate(copies):
        assert rows[50 + k].spans == [] and [tuple(s) for s in rows[55 + k].spans] == [(0, len(c.split(" ")))]
