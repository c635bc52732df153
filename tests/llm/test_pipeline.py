"""The pipeline: each stage on its predecessor's rows, held against the operators' brute-force versions."""

import zlib
from collections import Counter

import corpus_pipeline as pipeline
from conftest import SF
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siftspark.llm import packing


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [docs]
    for name, stage in pipeline.STAGES[:-1]:
        path = f"{tmp_path}/{name.replace(' ', '_')}"
        stage(spark, kept[-1], SF).write.parquet(path)
        kept.append(spark.read.parquet(path))
        assert kept[-1].columns == docs.columns
    ids = [Counter(r["doc_id"] for r in k.select("doc_id").collect()) for k in kept]
    assert set(ids[0]) >= set(ids[1]) >= set(ids[2]) >= set(ids[3]) >= set(ids[4])
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in ids[2] for i in good) >= 0.97 * len(good) and not [i for i, q in labels.items() if q == 0 and i in ids[2]]
    texts = {r["doc_id"]: r["text"] for r in kept[2].collect()}
    found = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in found}
    order = sorted(found)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(order):
        for b in order[k + 1 :]:
            if len(found[a] & found[b]) >= 0.8 * len(found[a] | found[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert set(ids[3]) == {find(i) for i in found}
    assert max(ids[4].values()) <= 3
    pieces = pipeline.STAGES[-1][1](spark, kept[4], SF).collect()
    plain = Tokenizer.from_file(packing.default_tokenizer())
    tokens = {r["doc_id"]: [*plain.encode(r["text"] or "", add_special_tokens=False).ids, packing.END] for r in kept[4].collect()}
    assert sum(p["length"] for p in pieces) == sum(len(tokens[i]) * n for i, n in ids[4].items())
    for p in pieces:
        own = tokens[p["doc_id"]][p["start"] : p["start"] + p["length"]]
        assert p["ids_crc32"] == zlib.crc32(b"".join(t.to_bytes(4, "little") for t in own))


def test_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, score double"
    long = " ".join(f"w{i % 997} and" for i in range(20_000))
    odd = spark.createDataFrame([(1, "A line of words.", "en", "a", 1, "r", 0.0), (1, "A line of words.", "en", "a", 1, "r", 0.0), (2, None, None, None, None, None, None), (None, "", "en", "a", 0, "r", 0.0), (3, long, "en", None, 1, "r", 0.0)], schema)
    for frame in (odd, odd.limit(0)):
        for _, stage in pipeline.STAGES[:-1]:
            out = stage(spark, frame, SF)
            assert out.columns == frame.columns
            assert out.count() <= 3 * frame.count()
        pipeline.STAGES[-1][1](spark, frame, SF).agg(F.sum("length")).collect()
