"""Small tables with every odd case: nulls in any column, empty, blank and long texts, ties, repeated rows, clashing names."""

LONG = " ".join(f"word{i % 977} of{i % 31}" for i in range(30_000))
PROSE = "The quick brown fox jumps over the lazy dog near the old river bank while seven small birds sing above."

ROWS = [
    (1, PROSE, "en", "src1", 5),
    (2, PROSE, "en", "src1", 5),
    (2, PROSE, "en", "src1", 5),
    (3, None, "en", "src1", None),
    (4, "", None, "src2", 0),
    (5, " \n\t ", "en", None, 4),
    (6, "one", "en", "src2", 3),
    (7, LONG, "de", "src2", 9),
    (None, PROSE, "en", "src1", 5),
    (None, None, None, None, None),
    (8, "same line\nmy own words here\nsame line", "en", "src3", 1),
    (9, "same line\nother words there", "en", "src3", 1),
    (10, "same line\nthird set of words", "en", "src3", 1),
    (11, "ÉTÉ Σίσυφος 🎉 naïve İstanbul", "fr", "src2", 1),
]
# names that the operators use inside, as further columns
CLASHING = ["_id", "id", "key", "hits", "items", "component", "__score", "_text", "_site", "__text", "shard", "n_shingles"]


def documents(spark, rows=ROWS):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.selectExpr("*", *[f"'x' AS `{c}`" for c in CLASHING])


def stage_tables(spark, folder):
    """A folder with the tables that the pipeline's stages read besides the documents."""
    labels = [(i, i % 2, 0) for i in range(1, 12)] + [(None, 1, 0), (3, None, None), (1, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    items = [(1, "third set of words"), (2, None), (3, ""), (None, "other"), (4, "?!")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder
