"""A small table with every awkward case, under column names that clash with the operators' own."""

from __future__ import annotations

import random

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, own string, spans string, "
    "n_words int, ids string, shard string, tokens string, digest string, sid string, at int, line string, name string"
)


def texts() -> list[str | None]:
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdeéßñ") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base, passage, common = line(80), line(60), line(12)
    edited = base.split(" ")
    edited[40] = "other"
    out: list[str | None] = [
        None, "", " \t\n\x0b\x0c\r ", "one", "one two three four", "ONE two Three four", base, base, base.upper().lower(),
        " ".join(edited), base + " tail", "head " + base, base + "\n" + common, line(40) + " " + passage + " " + line(30),
        line(20) + " " + passage + "\n" + line(9), passage, common + "\n" + common + "\n\n" + line(10), "word " * 300,
        line(9) + "\n" + line(9), "<|endoftext|> a <|startoftext|>", "İΣ ς  ﬁ Å 日本語 🙂 ² ٣ Ⅷ",
        "#*$%&|<> " * 30, line(5000), "x" * 3000, line(30) + "\r\n" + line(30),
    ]
    near = line(14).split(" ")
    out.append("\n".join([" ".join(near), " ".join([*near[:5], "changed", *near[6:]]), " ".join(near[:-1]), " ".join(near[1:])]))
    out += [line(rng.randint(20, 120)) + "\n" + common for _ in range(12)]
    return out


def rows() -> list[tuple[int | None, str | None]]:
    made = list(enumerate(texts()))
    made += [made[6], made[6], made[0], (3, "one"), (None, "a null id with a few words of its own here"), (None, None), (None, made[6][1])]
    return made


def frame(spark, pairs):
    extra = ("x", "s", 5, 0.5, "o", "p", 1, "i", "h", "t", "d", "q", 2, "l", "n")
    return spark.createDataFrame([(d, t, None if d == 4 else extra[0], None if d == 5 else extra[1], *extra[2:]) for d, t in pairs], SCHEMA)
