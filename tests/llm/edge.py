"""A small table with every awkward case, under the columns of documents and clashing ones."""

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
BASE = " ".join(f"word{i} the of" for i in range(60))
LONG = " ".join(f"w{i % 5000}x{i}" for i in range(60_000)) + ' token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"'
ROWS = [
    (1, BASE, "en", "a", 5),
    (2, BASE, "en", "a", 5),  # a copy
    (2, BASE, "en", "a", 5),  # a repeated row
    (3, BASE + " tail", "en", None, 5),  # a near copy
    (4, None, None, None, None),
    (5, "", "en", "b", 0),
    (6, " \t\n ", "fr", "b", 4),
    (7, "one two", "fr", "b", 7),
    (8, "ONE Two", "fr", "c", 7),  # equal after lower case
    (9, LONG, "de", "c", 1),
    (None, "null id text here", "de", "c", 1),
    (None, "null id text here", None, None, None),
    (2**60 + 1, "Ünïcödé 𝒳𝒴 wörds été", "fr", "𝒳", 3),
]
CLASHES = (
    "n size start stop row token hi lo place component first host path rule verdict listed key m "
    "failed spans ids licenses digest stretch line found hash hashes template page score rank vector "
    "dim slice block queue width pieces"
).split()


def documents(spark, rows=ROWS):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit(c) for c in CLASHES})
