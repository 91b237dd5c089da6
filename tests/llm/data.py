"""Awkward documents: nulls everywhere, empty and long texts, ties, repeats, clashing names."""

LONG = " ".join(f"Wort{i % 977} größer" for i in range(30_000))
WHITE = " a  b\n\n\tc \r\n  d▁e ▁▁ f "
SMALL = [
    (1, "Alpha beta gamma delta epsilon zeta", "en"), (2, None, None), (None, "lone text here", "en"),
    (3, "", "de"), (4, "ALPHA beta gamma delta epsilon zeta", "en"), (4, "other text of four", "en"),
    (5, WHITE, "fr"), (6, LONG, "de"), (7, LONG, None), (1, "Alpha beta gamma delta epsilon zeta", "en"),
    (8, "日本語 текст 12345 !!! 🙂", "en"), (9, "   ", None), (10, "\n\n", "en"), (None, None, None)]


def small(spark):
    """doc_id, text, lang and columns whose names operators use inside."""
    rows = [(*r, i, "x", 1.5, True) for i, r in enumerate(SMALL)]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, row long, `key` string, n double, kept boolean")


def none(spark):
    return small(spark).limit(0)
