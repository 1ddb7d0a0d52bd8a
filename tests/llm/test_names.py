"""Stages on tables with columns whose names the operators might use, and without n_chars."""

import corpus_pipeline

SF = "/root/testdata/sf0.001"
NAMES = ["__n", "__was", "__id", "__kept", "kept", "n", "tile", "cluster", "class_id", "n_words", "failed_bits", "spans", "a_ids"]


def test_clashing_names(spark):
    text = "some plain words of a text that is long enough to be kept by all of the rules we have"
    rows = spark.createDataFrame([(i, text + f" number {i} " * (i % 3), "en", "s", *["x"] * len(NAMES)) for i in range(6)], "doc_id long, text string, lang string, source string, " + ", ".join(f"`{n}` string" for n in NAMES))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, SF)
        assert out.columns == rows.columns, name
        assert {tuple(r)[4:] for r in out.collect()} <= {("x",) * len(NAMES)}, name
