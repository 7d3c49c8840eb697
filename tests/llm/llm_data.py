"""Small inputs shared by the tests of this folder."""

ODD = [
    "",
    " ",
    "  \n\n a",
    "it's we'll they've I'd 's",
    "a b　c d\x1ce\x85f",
    "x" * 2500,
    "日本語のテキスト 中文 עברית",
    "1234567 ½²١",
    "🙂🙃 ‍!!! ###\t\t%%%",
    "The end.\n",
    "\x00 zero \x00",
]


def documents(spark, texts):
    """A documents table with ids 0, 1, 2, ..."""
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)


def rows_by_id(frame):
    rows = frame.collect()
    found = {r.doc_id: r for r in rows}
    assert len(found) == len(rows)
    return found
