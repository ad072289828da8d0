"""The pipeline on a small table: each stage against a plain version of its decision."""

import hashlib
import re

import duckdb
import pandas as pd
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from storyloom.llm import bpe_chunks, poisson_mix

DATA = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    frames = [docs.toPandas()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert docs.columns == list(corpus_pipeline.COLUMNS)
        frames.append(docs.toPandas())
    start, good, unique, clean, mix, out = frames
    labels = pd.read_parquet(f"{DATA}/labels.parquet").set_index("doc_id")["quality"]
    kept = set(good["doc_id"])
    agree = [(d in kept) == bool(labels[d]) for d in start["doc_id"] if d in labels.index]
    assert sum(agree) / len(agree) > 0.95 and set(map(tuple, good.itertuples(index=False))) <= set(map(tuple, start.itertuples(index=False)))

    rows = good.sort_values("doc_id")
    fps = [plain_fingerprint(t) for t in rows["text"]]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 4 and root[a] != root[b]:
                x, y = min(root[a], root[b]), max(root[a], root[b])
                root = [x if r == y else r for r in root]
    assert sorted(unique["doc_id"]) == sorted({rows["doc_id"].iloc[r] for r in root})

    assert sorted(clean["doc_id"]) == sorted(unique["doc_id"]) and (clean["n_chars"] == clean["text"].str.len()).all()
    seen, before = set(), unique.set_index("doc_id")["text"]
    for d, t in sorted(zip(clean["doc_id"], clean["text"])):
        words = t.split()
        windows = {" ".join(words[i : i + 50]) for i in range(len(words) - 49)}
        assert not windows & seen and len(t) <= len(before[d])
        seen |= windows

    con = duckdb.connect()
    con.register("documents", clean)
    want = con.sql(poisson_mix.OP2_SQL).df()
    assert sorted(want["doc_id"]) == sorted(mix["doc_id"])

    t = Tokenizer.from_file(bpe_chunks.vocabulary("byte_bpe_50k.json"))
    ids = [t.encode(x, add_special_tokens=False).ids for x in mix["text"]]
    assert sorted(zip(mix["doc_id"], map(len, ids), (hashlib.sha256(",".join(map(str, i)).encode()).hexdigest() for i in ids))) == sorted(zip(out["doc_id"], out["n_tokens"], out["ids_sha256"]))


def test_run(spark, tmp_path):
    """run() has the rows that its stages give one after the other."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
    rows = lambda df: sorted(map(tuple, df.collect()))
    got = corpus_pipeline.run(spark, DATA)
    assert got.columns == docs.columns and rows(got) == rows(docs) and docs.count() > 50


def test_awkward_rows_and_empty_tables(spark, docs, nothing, tmp_path):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for name, table in (("some", docs), ("none", nothing)):
        folder = tmp_path / name
        table.write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        kept = spark.read.parquet(f"{folder}/documents.parquet")
        for k, (stage_name, stage) in enumerate(corpus_pipeline.STAGES):
            before = kept
            stage(spark, kept, f"file://{folder}").write.parquet(f"{folder}/{k}")
            kept = spark.read.parquet(f"{folder}/{k}")
            if k < 4:
                assert kept.columns == list(corpus_pipeline.COLUMNS)
            if name == "some" and stage_name in ("quality", "repeated_passages", "tokens"):
                assert kept.count() == before.count()  # without labels nothing is rejected
        assert (kept.count() > 5) == (name == "some")
        assert corpus_pipeline.run(spark, f"file://{folder}").count() == kept.count()
