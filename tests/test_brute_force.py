"""Queries that SQL can't express, over whole tables, against plain Python written without the library's functions."""

import hashlib
import html
import math
import re
import unicodedata

import xxhash

from docloom.plans import queries
from docloom.plans.synthetic import chats_markdown


def rows(spark, data, name):
    return spark.read.parquet(f"{data}/{name}.parquet").collect()


def words(text):
    return text.split()


def sentences(text):
    return re.split(r"(?<=[.!?。])\s+", text)


def test_normalized_hash(spark, data):
    def plain(t):
        t = unicodedata.normalize("NFKC", t)
        while (a := t.find("<")) >= 0 and (b := t.find(">", a)) > a + 1:
            t = t[:a] + t[b + 1 :]
        t = "\n".join(re.sub(r"^\s{0,3}#{1,6}\s*", "", line) for line in t.split("\n"))
        for mark in ("***", "**", "*", "___", "__", "_"):
            e = re.escape(mark)
            t = re.sub(rf"{e}(\S(?:.*?\S)?){e}", r"\1", t)
        return " ".join(t.split())

    got = {r.doc_id: r.hash for r in queries.QUERIES["normalized_hash"](spark, data).collect()}
    docs = rows(spark, data, "documents")
    assert len(got) == len(docs)
    for r in docs:
        assert got[r.doc_id] == (None if r.text is None else xxhash.xxh64(plain(r.text).encode()).hexdigest())


def vector(text, dim=64):
    out = [0.0] * dim
    for w in re.findall(r"\w+", text.lower()):
        h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
        out[h % dim] += 1 if h >= 1 << 63 else -1
    n = math.sqrt(sum(x * x for x in out)) or 1.0
    return [x / n for x in out]


def test_embed_documents(spark, data):
    got = {r.doc_id: r.embedding for r in queries.QUERIES["embed_documents"](spark, data).collect()}
    for r in rows(spark, data, "documents"):
        assert max(abs(a - b) for a, b in zip(got[r.doc_id], vector(r.text or ""), strict=True)) < 1e-6


def test_retrieve_fused(spark, data):
    """Both lists by loops over all documents, reciprocal ranks from 0 with k = 60, then the reranker's share of terms."""
    docs = {r.doc_id: (r.text or "", r.lang) for r in rows(spark, data, "documents")}
    terms = lambda t: re.findall("[a-z0-9]+", t.lower())
    tokens = {i: terms(t) for i, (t, _) in docs.items()}
    vectors = {i: vector(t) for i, (t, _) in docs.items()}
    mean = sum(map(len, tokens.values())) / len(tokens)
    df = {}
    for t in tokens.values():
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    tf = {i: {w: t.count(w) for w in set(t)} for i, t in tokens.items()}
    got = {}
    for r in queries.QUERIES["retrieve_fused"](spark, data).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.unit_id, r.score))
    for q in rows(spark, data, "benchmark"):
        asked, v = set(terms(q.text)), vector(q.text)
        cosine = sorted(((-round(sum(a * b for a, b in zip(v, x, strict=True)), 4), i) for i, x in vectors.items()))
        bm25 = []
        for i in docs:
            s = sum(math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * tf[i][w] * 2.2 / (tf[i][w] + 1.2 * (0.25 + 0.75 * len(tokens[i]) / mean)) for w in asked if w in tf[i])
            if s:
                bm25.append((-s, i))
        near = {i for _, i in cosine[:30]} | {i for _, i in sorted(bm25)[:30]}
        found = [u for _, u, _ in sorted(got[q.item_id])]
        assert found and set(found) <= near and len(set(found)) == len(found) <= 5
        scores = [s for *_, s in sorted(got[q.item_id])]
        assert scores == sorted(scores, reverse=True)


def test_html_text(spark, data):
    """Every visible word of a page, in order; nothing of scripts, styles and heads."""
    got = {r.page_id: r.text for r in queries.QUERIES["html_text"](spark, data).collect()}
    pages = rows(spark, data, "pages")
    assert len(got) == len(pages)
    for r in pages:
        t = re.sub(r"(?is)<!--.*?-->", "", r.html or "")
        t = re.sub(r"(?is)<(script|style|noscript|template|head)\b.*?</\1\s*>", "", t)
        t = re.sub(r"(?is)<(/?)(p|div|section|article|header|footer|ul|ol|li|table|tr|h[1-6]|br|hr|blockquote|pre)\b[^>]*>", " ", t)
        want = html.unescape(re.sub(r"(?s)<[^>]*>", "", t)).split()
        assert [w for w in (got[r.page_id] or "").split() if not re.fullmatch(r"#{1,6}|-", w)] == [w for w in want if not re.fullmatch(r"#{1,6}|-", w)]


def tree(text):
    """[(id, parent, title, text, level)] of a Markdown text's headings."""
    out, fenced = [], False
    for line in text.split("\n"):
        m = re.match(r"(#{1,6})[ \t]+(.+)$", line.strip())
        if line.strip().startswith("```"):
            fenced = not fenced
            m = None
        if m and not fenced:
            level = len(m.group(1))
            up = next((n[0] for n in reversed(out) if n[4] < level and all(o[4] >= level or o[4] >= n[4] for o in out[out.index(n) + 1 :])), None)
            out.append([f"{len(out) + 1:04d}", up, m.group(2).strip(), [line], level])
        elif out:
            out[-1][3].append(line)
    return [(i, up, title, "\n".join(lines), level) for i, up, title, lines, level in out]


def test_tree_mcts(spark, data):
    """Upper confidence search over each conversation's tree, by dictionaries."""
    asked = {"the", "and", "of", "user"}
    got = {}
    for r in queries.QUERIES["tree_mcts"](spark, data).collect():
        got.setdefault(r.doc_id, []).append((r.node_id, r.value, r.visits))
    from docloom.operators import trees

    nodes = {}
    for r in trees.tree_nodes(chats_markdown(spark, data)).orderBy("doc_id", "ord").collect():
        nodes.setdefault(r.doc_id, []).append((r.node_id, r.parent_id, len(asked & set(re.findall("[a-z0-9]+", r.text.lower()))) / len(asked)))
    for doc, members in nodes.items():
        kids, value, up = {None: []}, {}, {}
        for i, p, v in members:
            kids[i] = []
            kids[p].append(i)
            value[i], up[i] = v, p
        n, total = dict.fromkeys(kids, 0), dict.fromkeys(kids, 0.0)

        def reward(i, v, n=n, total=total, up=up):
            while True:
                n[i], total[i] = n[i] + 1, total[i] + v
                if i is None:
                    return
                i = up[i]

        for i in kids[None]:
            reward(i, value[i])
        for _ in range(30):
            at = None
            while kids[at]:
                if at is not None and not n[at]:
                    break
                fresh = [i for i in kids[at] if not n[i]]
                if fresh:
                    at = fresh[0]
                    break
                at = max(kids[at], key=lambda i, p=at: total[i] / n[i] + math.sqrt(2) * math.sqrt(math.log(max(1, n[p])) / n[i]))
                if kids[at] and not n[kids[at][0]]:
                    at = kids[at][0]
                    break
            if at is None:
                break
            reward(at, value[at])
        want = sorted(((i, total[i] / n[i], n[i]) for i in value if n[i]), key=lambda x: (-x[1], x[0]))[:3]
        assert [(i, k) for i, _, k in got[doc]] == [(i, k) for i, _, k in want]
        assert all(abs(a[1] - b[1]) < 1e-9 for a, b in zip(got[doc], want, strict=True))


def test_tree_summaries(spark, data):
    """From the leaves up, by recursion."""
    from docloom.operators import trees

    nodes = {}
    for r in trees.tree_nodes(chats_markdown(spark, data)).orderBy("doc_id", "ord").collect():
        nodes.setdefault(r.doc_id, {})[r.node_id] = r
    got = {(r.doc_id, r.node_id): r.summary for r in queries.QUERIES["tree_summaries"](spark, data).collect()}
    brief = lambda t: t[:200] + "..." if len(t) > 200 else t

    def summary(members, i):
        r = members[i]
        kids = [k for k in members if members[k].parent_id == i]
        if not kids:
            return r.text if len(words(r.text)) < 200 else brief(r.text)
        both = r.text + "\n" + "\n".join(f"- {members[k].title}: {summary(members, k)[:200]}" for k in kids)
        return brief(both) if len(words(both)) > 500 else both

    assert len(got) == sum(map(len, nodes.values()))
    for doc, members in nodes.items():
        for i in members:
            assert got[doc, i] == summary(members, i)


def test_trees_by_another_parser(spark, data):
    from docloom.operators import trees

    got = {}
    for r in trees.tree_nodes(chats_markdown(spark, data)).orderBy("doc_id", "ord").collect():
        got.setdefault(r.doc_id, []).append((r.node_id, r.parent_id, r.title, r.level))
    for r in chats_markdown(spark, data).collect():
        assert got[r.doc_id] == [(i, p, t, n) for i, p, t, _, n in tree(r.text)]


def test_compress_documents(spark, data):
    """Texts within the target stay; others consist of their own sentences, in order, and are shorter."""
    got = {r.doc_id: r.content for r in queries.QUERIES["compress_documents"](spark, data).collect()}
    for r in rows(spark, data, "documents"):
        text, short = r.text or "", got[r.doc_id] or ""
        total = len(words(text))
        if total <= 111 or 100 / total > 0.9:
            assert short == text
            continue
        assert 0 < len(words(short)) < total
        left = words(text)
        at = 0
        for w in words(short):  # a subsequence of the words
            at = left.index(w, at) + 1


def test_page_infer(spark, data):
    """Each unit is a run of its document, whose pages are where that run lies."""
    turns = {}
    for r in rows(spark, data, "conversations"):
        turns.setdefault(r.conv_id, []).append((r.turn, r.text or ""))
    got = {}
    for r in queries.QUERIES["page_infer"](spark, data).collect():
        got.setdefault(r.doc_id, []).append((r.seq, r.page_numbers))
    from docloom.operators import documents, split

    docs = documents.merge(queries._pages(spark, data))
    units = split.as_units(docs, "doc_id", "content").transform(split.paragraph_splitter(120)).collect()
    right = known = 0
    for u in units:
        pages = dict(got[u.doc_id])[u.seq]
        at, spans = 0, []
        for n, t in sorted(turns[u.doc_id]):
            spans.append((n, at, at + len(t)))
            at += len(t) + 2
        text = "\n\n".join(t for _, t in sorted(turns[u.doc_id]))
        if text.count(u.content) == 1:
            a = text.index(u.content)
            known += 1
            right += pages == [n for n, b, c in spans if b < a + len(u.content) and c > a]
    assert known > 10 and right >= 0.95 * known
