import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.operators import split


def units(spark, *texts):
    return split.as_units(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def test_headers(spark):
    text = "before\n# A\none\n## B\n```\n# no heading\n```\n#### C\ntwo\n## D\n# E"
    got = split.split_headers(units(spark, text, "", None)).orderBy("doc_id", "seq").collect()
    assert [r.context_path for r in got if r.doc_id == 0] == [None, "A", "A > B", "A > B > C", "A > D", "E"]
    assert got[2].content == "## B\n```\n# no heading\n```"
    bare = split.split_headers(units(spark, text), include_header=False).orderBy("seq").collect()
    assert [r.content for r in bare] == ["before", "one", "```\n# no heading\n```", "two"]


def test_chain_is_consistent(spark):
    c = split.chain(split.split_sentences(units(spark, "One. Two! Three? Four。 Five", "x"))).orderBy("doc_id", "seq").collect()
    assert [r.content for r in c] == ["One.", "Two!", "Three?", "Four。", "Five", "x"]
    for a, b in zip(c, c[1:], strict=False):
        assert (b.prev_unit_id == a.unit_id and a.next_unit_id == b.unit_id) == (a.doc_id == b.doc_id)
    assert c[0].prev_unit_id is None and c[-1].next_unit_id is None


def test_chunks(spark):
    text = " ".join(map(str, range(25)))
    got = [r.content.split() for r in split.chunk_tokens(units(spark, text), 10, 3).orderBy("seq").collect()]
    assert got == [list(map(str, range(a, min(25, a + 10)))) for a in (0, 7, 14, 21)][: len(got)] and got[-1][-1] == "24" and len(got) == 4
    assert split.chunk_tokens(units(spark, "", None, "  ")).count() == 0


def test_greedy():
    assert split.greedy([3, 4, 5, 2, 9, 1], 8) == [0, 0, 1, 1, 2, 3]


words = st.lists(st.sampled_from(["a", "bb.", "ccc!", "d"]), min_size=1, max_size=30).map(" ".join)


@settings(max_examples=60, deadline=None)
@given(st.lists(words, min_size=1, max_size=6), st.integers(2, 20))
def test_text_loses_only_separators(paragraphs, most):
    text = "\n\n".join(paragraphs)
    got = split.split_text(text, most)
    assert "".join(" ".join(got).split()) == "".join(text.split())
    assert all(split.words(x) <= most for x in got)


def test_tables_stay_whole_and_rows_occur_once():
    rows = "".join(f"| {i} | v{i} |\n" for i in range(100))
    text = "intro text\n\n| a | b |\n| --- | --- |\n" + rows + "\nend."
    whole = split.split_text(text, 50)
    assert sum("| 0 |" in x and "| 99 |" in x for x in whole) == 1
    parts = split.split_tables(text, 100)
    assert re.findall(r"\| (\d+) \|", "\n".join(parts)) == [str(i) for i in range(100)]
    tables = [p for p in parts if "---" in p]
    assert len(tables) > 1 and all(p.startswith("| a | b |\n| --- | --- |") and split.words(p) <= 100 for p in tables)


def test_html_tables():
    t = '<table border="1"><tr><th>h</th></tr>' + "".join(f"<tr><td>c{i} w w w</td></tr>" for i in range(50)) + "</table>"
    parts = split.split_tables("x\n" + t, 100)
    assert len(parts) > 2 and all(p.startswith('<table border="1"><thead><tr><th>h</th></tr></thead>') for p in parts[1:])
    assert re.findall(r"c(\d+) ", "".join(parts)) == [str(i) for i in range(50)]


def test_merge(spark):
    rng = random.Random(3)
    pieces = [" ".join("w" * rng.randint(1, 9)) for _ in range(40)]
    u = spark.createDataFrame([(1, i, p, f"p{i}") for i, p in enumerate(pieces)], "doc_id long, seq int, content string, context_path string")
    got = split.merge_small(u, 12).orderBy("seq").collect()
    groups = split.greedy([split.words(p) for p in pieces], 12)
    assert [r.content for r in got] == ["\n\n".join(p for p, g in zip(pieces, groups, strict=True) if g == k) for k in range(groups[-1] + 1)]
    assert got[0].context_path == "p0"
