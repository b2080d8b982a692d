"""The pipeline against plain versions of its stages, and the awkward table through every stage."""

import struct

import brute
import public_tokenizers
import tables
from tokenizers import Tokenizer

import corpus_pipeline
from cueloom.llm.query_toxicity import fitted
from cueloom.llm.winnow import fold_words

SF = "/root/testdata/sf0.001"


def test_run_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    field = fitted(spark, SF)
    kept = [(r.doc_id, r.text) for r in docs if field.score(field.marginals(fold_words(r.text))) < 0.7]
    kept = [(d, text) for (d, _), (text, n, gone) in zip(kept, brute.dedup_lines(kept), strict=True) if n == 0 or gone < n]
    found = brute.components(kept)
    kept = [row for row, (n, c, _) in zip(kept, found, strict=True) if n == 0 or c == row[0]]
    clean = []
    for d, t in kept:
        n, hit, _ = brute.contamination(t, items)
        if not (hit and 20 * len(hit) >= n):
            clean.append((d, t))
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for d, t in clean:
        ids = library.encode(t, add_special_tokens=False).ids
        want[d] = (len(ids), brute.sha(struct.pack(f"<{len(ids)}I", *ids)), brute.sha(library.decode(ids, skip_special_tokens=False)))
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want


def test_awkward_rows_pass(spark):
    docs = tables.frame(spark, tables.rows())
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, SF)
        if name != "bpe":
            assert made.columns == docs.columns
            assert made.schema.simpleString() == docs.schema.simpleString()
        assert 0 < made.count() <= docs.count()
        assert stage(spark, docs.limit(0), SF).count() == 0
