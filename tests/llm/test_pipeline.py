"""The stages of the pipeline against plain Python on a small table."""

import random

import base64
import numpy as np
import public_tokenizers
import tiktoken


def test_stages(spark, tmp_path):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["language ID", "SimHash near-dedup", "PII", "mixing sources to target weights", "byte-level BPE encoding and decoding"]
    random.seed(4)
    en, de = "the old house near a river where many children play every day".split(), "das alte haus am fluss wo viele kinder jeden tag spielen gehen".split()
    rows = [(k, " ".join(random.choice((en, de)[k % 2]) for _ in range(40)), ("en", "de")[k % 2], f"s{0 if k % 3 else 1}") for k in range(120)]
    rows += [(200 + k, rows[k][1], rows[k][2], "s2") for k in range(10)] + [(300, None, "en", "s0"), (301, "123 456", "en", "s0"), (302, "the old house and bob@mail.example.com near a river", "en", None)]
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    docs, sizes = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, function in p.STAGES[:-1]:
        docs = function(spark, docs, str(tmp_path))
        assert docs.columns == df.columns
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        sizes.append(docs.select("doc_id").distinct().count())
    assert sizes == [131, 121, 121, 121]
    assert "<EMAIL>" in docs.where("doc_id = 302").first()["text"]
    final = p.run(spark, str(tmp_path)).collect()
    assert len(final) == docs.count()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(np.frombuffer(r["ids"], "<u4").tolist() == enc.encode_ordinary(texts[r["doc_id"]]) for r in final)
