import corpus_pipeline
from tracelake.llm import decontam, simhash


def test_stages_take_effect(spark, tmp_path):
    import random

    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghijkl") for _ in range(5)) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    item = text(40)
    docs = [(k, text(120), "en" if k % 2 else "de", "s", 1) for k in range(30)]
    docs += [(100, docs[3][1], "en", "s", 1), (101, docs[4][1] + "  ", "de", "s", 1), (102, "12 34", "en", "s", 1), (103, None, None, None, None), (104, text(50) + " " + item + " " + text(30), "en", "s", 1), (3, docs[3][1], "de", "s", 1)]
    near = docs[6][1].split()
    fp = simhash.fingerprint(" ".join(near))
    for k in range(len(near)):  # a near copy within three bits
        other = " ".join(near[:k] + ["zz"] + near[k + 1 :])
        if 0 < (simhash.fingerprint(other) ^ fp).bit_count() <= 3:
            docs.append((105, other, "en", "s", 1))
            break
    shape = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, shape).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    frame, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, str(tmp_path))
        frame.write.parquet(f"{tmp_path}/{name}")
        frame = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = [r.doc_id for r in frame.collect()]
    assert 102 not in kept["language_id"] and 103 not in kept["language_id"] and 104 in kept["language_id"]
    assert kept["exact_dedup"].count(3) == 1 and 100 not in kept["exact_dedup"] and 4 not in kept["exact_dedup"] and 101 in kept["exact_dedup"]
    assert 6 in kept["simhash_near_dedup"] and 105 not in kept["simhash_near_dedup"]
    assert 104 not in kept["benchmark_decontamination"]
    assert sorted(kept["byte_level_bpe"]) == sorted(kept["benchmark_decontamination"])
    assert set(kept["byte_level_bpe"]) == {*range(30), 101} - {4}
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted(kept["byte_level_bpe"])
    assert decontam.SIMILARITY == 0.8
