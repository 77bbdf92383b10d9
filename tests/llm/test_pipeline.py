import re
import struct

import corpus_pipeline
import public_tokenizers
from sardabir.llm import bpe, decontaminate, neardup, pii, quality, queries
from sardabir.llm.labelled import fold
from test_neardup import brute

SMALL = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, columns = {r["doc_id"] for r in docs.select("doc_id").collect()}, docs.columns
        docs = stage(spark, docs, SMALL).persist()
        after = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert docs.columns == columns and after <= before
        if name == "near_dedup":
            assert neardup.near_duplicates(docs).where("NOT kept").count() == 0
        if name == "decontamination":
            assert decontaminate.contaminated(docs, spark.read.parquet(f"{SMALL}/benchmark.parquet")).count() == 0
        if name == "pii":
            assert after == before and not docs.where("contains(text, '@mail')").where("contains(text, 'example.com')").count()
    assert pii.find_entities("") == []


def test_run_equals_plain_loops(spark):
    docs, items = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    model = quality.fit(docs, spark.read.parquet(f"{SMALL}/labels.parquet"), fold("doc_id", 3) != 1)
    rows = [(r["doc_id"], r["text"], r["n_chars"]) for r in docs.collect()]
    rows = [r for r in rows if model.scores([r[1] or ""], [r[2]])[0] >= 0.5]
    rows = [r for r, least in zip(rows, brute([r[:2] for r in rows], 80)) if r[0] == least]

    def words(text):
        return [w for w in re.split("[\x20\x09-\x0d]+", (text or "").lower()) if w]

    def contained(item, text):
        w, had = words(item), words(text)
        n = min(5, len(w))
        grams = {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if w else set()
        found = grams & {tuple(had[i:i + n]) for i in range(len(had) - n + 1)}
        return bool(grams) and len(found) * 10 >= len(grams) * 8

    wanted = [r["text"] for r in items.collect()]
    rows = [r for r in rows if not any(contained(item, r[1]) for item in wanted)]
    enc = bpe.encoding(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    want = {}
    for key, text, _ in rows:
        ids = enc.encode_ordinary(pii.pseudonymize(text or "", queries.PII_KEY)[0])
        want[key] = len(ids), struct.pack(f"<{len(ids)}I", *ids)
    got = corpus_pipeline.run(spark, SMALL).collect()
    assert {r["doc_id"]: (r["n_tokens"], bytes(r["ids"])) for r in got} == want and len(got) == len(want) > 50 and all(r["whole"] for r in got)
