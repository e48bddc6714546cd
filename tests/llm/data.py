"""Hand-made tables with nulls, empty and long texts, ties, repeats and clashing columns."""

from __future__ import annotations

DOCS = "doc_id long, text string, n_words string, score string, hits string, kept_text string"
LONG = "one two three four five six seven eight nine ten eleven twelve thirteen"
LINE = "This line is shared by many documents, and it is long enough."


def odd_documents(spark):
    """Nulls in every column, empty and white texts, repeats, shared ids, a text of 40,000 words."""
    rows = [
        (1, LONG + " fourteen"), (2, LONG.upper() + " FOURTEEN"), (3, LONG + " Fourteen "), (4, ""), (5, " \t\n "), (6, None),
        (None, LONG + " fourteen"), (None, None), (7, "solo"), (8, "solo"), (8, "solo"), (9, "éèß ÄÖ 漢字 \U0001F600 x<|im_end|>"),
        (10, " ".join(f"w{k % 977}" for k in range(40_000))), (11, "a" * 50_000),
        *[(20 + k, f"  {LINE} \nown {k}\n{LINE.upper()}") for k in range(6)], (30, "\n\n"), (31, "\r\n x \x0b"),
    ]
    return spark.createDataFrame([(i, t, "w", "s", None, "k") for i, t in rows], DOCS)


def no_documents(spark):
    return spark.createDataFrame([], DOCS)
