"""Documents with what is unusual: nulls, blanks, long texts, repeated rows, ties, further columns."""


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, part int, label string, bits binary, copies int, quality_score double, size string"

PROSE = "the quick brown fox jumps over the lazy dog while many small birds sing in the old green trees near water and stones "


def odd_rows():
    texts = [None, "", " \n\t", "word", PROSE * 3, PROSE * 3, "É" * 50 + " été naïve", PROSE * 2000, "!!! ??? ###", "same same same same same same same same same same same same same same"]
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 2}" if i % 4 else None, None, "k", i, None, b"x", 3, 0.5, "big") for i, t in enumerate(texts)]
    return [*rows, rows[4], rows[4], (None, PROSE * 3, None, None, 1, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None, None)]


def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def none(spark):
    return spark.createDataFrame([], SCHEMA)
