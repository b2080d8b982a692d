"""Blocks of paragraphs that are compared with each other."""

import random

from pyspark.sql import functions as F
from test_passages import edited, frame, line

from cueloom.llm import paragraphs
from cueloom.llm.components import components
from cueloom.llm.jaccard import all_links


def test_no_two_blocks_of_the_same_paragraphs(spark):
    """Near copies share several bands; one block of them is kept, and still links them."""
    rng = random.Random(12)
    texts = []
    for _ in range(8):
        base = line(rng, 80)
        texts += [base, edited(base, 40)]
    docs = frame(spark, texts)
    rows = [(k, paragraphs._digest(t), paragraphs.paragraphs(t).names.tolist()) for k, t in enumerate(texts)]
    wanted = spark.createDataFrame(rows, "doc_id long, digest long, names array<long>")
    blocks = paragraphs._blocks(docs, wanted).cache()
    members = [tuple(r.own) for r in blocks.groupBy("block").agg(F.sort_array(F.collect_set("sid")).alias("own")).collect()]
    assert members and len(members) == len(set(members)) and all(len(m) > 1 for m in members)
    found = components(all_links(blocks, 3, 4)).collect()
    roots = {r.node: r.root for r in found} | {r.root: r.root for r in found}
    whole = [int(paragraphs.paragraphs(t).names[-1]) for t in texts]
    assert [roots[a] for a in whole[::2]] == [roots[b] for b in whole[1::2]] and len({roots[a] for a in whole}) == 8
