from pyspark.sql import functions as F

import corpus_pipeline
from codelattice.llm import bpe
from tests.llm import test_decontaminate, test_line_dedup, test_simhash
from tests.llm.helpers import SF, clashing, docs, edge_docs


def test_stages_against_brute_force(spark):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    rows = [(i, t) for i, t in rows if any(c.isalpha() for c in t)]
    kept = {i: v for i, v in test_line_dedup.brute(rows).items() if v[2] < v[1]}
    ids = sorted(kept)
    root = test_simhash.brute_components([test_simhash.brute_fingerprint(kept[i][0]) for i in ids])
    ids = [i for place, i in enumerate(ids) if root[place] == place]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    texts = [kept[i][0] for i in ids]
    leaked = {d for d, _ in test_decontaminate.brute(texts, items)}
    left = [i for place, i in enumerate(ids, 1) if place not in leaked]
    table = bpe.PrefixTable(*bpe.vocabulary(bpe.model_path()))
    found = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, SF).collect()}
    assert found == {i: table.encode(kept[i][0])[0] for i in left}


def test_stages_keep_the_columns_and_stand_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs.limit(0), SF)
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), SF).count() == 0


def test_stages_on_nulls_repeats_long_texts_and_other_columns(spark):
    frame = clashing(edge_docs(spark), "score", "fp", "component_id", "item_id", "row", "spans").drop("n_chars").withColumn("n_chars", F.char_length("text"))
    ids = lambda f: sorted((r.doc_id for r in f.collect()), key=str)
    stages = dict(corpus_pipeline.STAGES)
    told = stages["language_id"](spark, frame, SF)
    assert ids(told) == [1, 1, 5, 6, 7, None] and told.columns == frame.columns
    lines = stages["line_dedup"](spark, told, SF)
    assert ids(lines) == [1, 1, 5, 6, 7, None] and lines.columns == frame.columns
    alone = stages["near_dedup"](spark, frame, SF)
    assert ids(alone) == [1, 1, 2, 5, 6, 7, None] and alone.columns == frame.columns  # 2, 3 and 4 have no words
    clean = stages["decontamination"](spark, alone, SF)
    assert ids(clean) == ids(alone) and clean.columns == frame.columns
    assert [r.n_tokens for r in stages["subword_codec"](spark, clean.filter("doc_id = 2"), SF).collect()] == [0]


def test_lines_that_go_are_counted(spark):
    shared = "a line that two documents hold"
    frame = docs(spark, [f"first\n{shared}", f"{shared}\nsecond", shared])
    left = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.dedup_lines(spark, frame, SF).collect()}
    assert left == {1: (f"first\n{shared}", 36), 2: ("second", 6)}


def test_run_leaves_only_its_result_behind(spark):
    import glob

    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    before = set(glob.glob(f"{folder}/stored-*/*.parquet"))
    out = corpus_pipeline.run(spark, SF)
    left = {f.rsplit("/", 1)[-1] for f in set(glob.glob(f"{folder}/stored-*/*.parquet")) - before}
    assert {f.rsplit("/", 1)[-1] for f in out.inputFiles()} == left
