"""The pipeline on small tables: stages take effect, and clean documents stay."""

import random

import corpus_pipeline


def test_stages(spark, tmp_path):
    rng = random.Random(5)
    word = lambda: rng.choice([f"w{i}x{i * 7 % 89}" for i in range(500)])
    text = lambda n: " ".join(word() for _ in range(n))
    item = text(30)
    clean = [(i, text(60), "en", "s", 1) for i in range(60)]
    line = "a line that many of the documents share word for word"
    rows = clean + [(100, clean[0][1], "en", "s", 1), (101, clean[1][1] + " more", "en", "s", 1), (102, f"{text(20)} {item} {text(20)}", "en", "s", 1)]
    rows += [(110 + i, f"{line}\n{text(50)}", "en", "s", 1) for i in range(4)] + [(120, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = docs
    for name in ("toxicity", "line_dedup", "simhash_dedup", "decontaminate"):
        kept = stages[name](spark, kept, folder)
        assert kept.columns == docs.columns
        kept.write.parquet(f"{folder}/{name}")
        kept = spark.read.parquet(f"{folder}/{name}")
    ids = {r.doc_id for r in kept.collect()}
    assert ids == {*range(60), 110, 111, 112, 113, 120}
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert texts[113].startswith(line) and not texts[110].startswith(line)
    pieces = stages["packing"](spark, kept, folder).collect()
    assert {r.doc_id for r in pieces} == ids


def test_decontaminate_leaves_documents_of_the_same_id(spark, tmp_path):
    item = " ".join(f"i{i}" for i in range(30))
    clean = [(None, "a clean text without an id"), (5, "a clean text under id five"), (None, None)]
    docs = spark.createDataFrame([*clean, (None, f"before {item} after"), (5, f"in five {item} too")], "doc_id long, text string")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = corpus_pipeline.decontaminate(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and {tuple(r) for r in kept.collect()} == set(clean)


def test_columns_with_the_operators_names_come_back(spark):
    docs = spark.createDataFrame([(1, "a\nb", 3, "x", 9, 7), (2, None, 0, "y", 8, 6)], "doc_id long, text string, n_chars long, n_lines string, r0 int, score int")
    rows = sorted(map(tuple, corpus_pipeline.line_dedup(spark, docs, "").collect()))
    assert rows == [(1, "a\nb", 3, "x", 9, 7), (2, "", 0, "y", 8, 6)]
