import random

import numpy as np
import pytest
from cases import none, odd, odd_rows

from docloom.llm import chat, packing, sharding


def chats(spark, rows):
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, turns string, messages int")


def test_chat_cases(spark):
    rows = [(1, 2, "user", "c"), (1, 0, "user", "a"), (1, 1, "user", None), (1, 3, None, "<|im_end|>"), (1, None, "system", "s"), (None, 0, "user", "x"), (2, 0, "a", "t"), (2, 0, "a", "t"), (2, 0, "A", "u")]
    got = {r.conv_id: r for r in chat.format_chats(chats(spark, [(*r, "z", 1) for r in rows])).collect()}
    assert got[1].text == "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\na\n\n\n\nc<|im_end|>\n<|im_start|>unknown\n< |im_end|><|im_end|>\n"
    assert (got[1].n_turns, got[1].n_messages) == (5, 3)
    assert got[None].n_turns == 1
    assert got[2].text == "<|im_start|>A\nu<|im_end|>\n<|im_start|>a\nt\n\nt<|im_end|>\n"
    assert chat.format_chats(chats(spark, [])).count() == 0


def test_long_chat(spark):
    rows = [(1, i, "user" if i // 3 % 2 else "assistant", "w" * 200, "", 0) for i in range(3000)]
    r = chat.format_chats(chats(spark, rows)).first()
    assert r.n_messages == 1000 and r.text.count("<|im_start|>") == 1000


def test_shards(spark):
    got = sharding.shard_documents(odd(spark), 4).collect()
    sizes = [len((r[1] or "").encode()) for r in odd_rows()]
    assert sorted(r.n_bytes for r in got) == sorted(sizes)
    at, total = 0, sum(sizes)
    for r in sorted(got, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.n_bytes, r.start_byte)):
        assert r.start_byte == at and r.shard_id == min(3, at * 4 // total)
        at += r.n_bytes
    assert sharding.shard_documents(none(spark)).count() == 0
    with pytest.raises(ValueError):
        sharding.shard_documents(none(spark), 0)


def test_packs_hold_every_word_once(spark):
    window = 256
    got = packing.pack_documents(odd(spark), window, 32).collect()
    pieces = [(p.doc_id, p.start, p.length) for r in got for p in r.pieces]
    want = []
    for doc_id, text, *_ in odd_rows():
        n = len((text or "").split())
        want += [(doc_id, a, min(window, n - a)) for a in range(0, n, window)]
    assert sorted(pieces, key=repr) == sorted(want, key=repr)
    for r in got:
        assert r.n_tokens == sum(p.length for p in r.pieces) <= window and r.n_pieces == len(r.pieces) and r.doc_ids == [p.doc_id for p in r.pieces]
    assert sorted(r.pack_id for r in got) == list(range(len(got)))
    assert packing.pack_documents(none(spark)).count() == 0


def test_many_parts_give_the_same_packs(spark):
    """Lengths and numbers of packs don't depend on how finely pieces are ranked."""
    shape = lambda per_part: sorted(sorted(p.length for p in r.pieces) for r in packing.pack_documents(odd(spark), 256, 32, per_part=per_part).collect())
    rough = lambda packs: sorted(sorted(-(-n // 8) for n in p) for p in packs)
    assert rough(shape(200_000)) == rough(shape(2))


def fewest(lengths, window):
    """The least number of packs, by trying every choice."""
    best = [len(lengths)]

    def place(i, room):
        if len(room) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(room)
            return
        seen = set()
        for k, r in enumerate(room):
            if r >= lengths[i] and r not in seen:
                seen.add(r)
                place(i + 1, [*room[:k], r - lengths[i], *room[k + 1 :]])
        place(i + 1, [*room, window - lengths[i]])

    lengths = sorted(lengths, reverse=True)
    place(0, [])
    return best[0]


def test_plan_against_the_fewest_packs():
    """Brute force over small sets of pieces: never fewer packs than possible, seldom one more, and on the whole within 5 %."""
    rng = random.Random(5)
    ours = best = 0
    for _ in range(150):
        lengths = [rng.randint(1, 16) for _ in range(rng.randint(1, 11))]
        n = sum(times for times, _ in packing.pack_plan({k: lengths.count(k) for k in set(lengths)}, 16))
        least = fewest(lengths, 16)
        assert least <= n <= least + 1
        ours, best = ours + n, best + least
    assert ours <= 1.05 * best


def test_nnls_is_optimal():
    rng = np.random.default_rng(2)
    for _ in range(20):
        a, b = rng.random((12, 20)), rng.random(12)
        x = packing.nnls(a, b)
        g = a.T @ (b - a @ x)
        assert (x >= 0).all() and (g < 1e-6).all() and abs(g @ x) < 1e-6


def test_plan_uses_the_histogram_up():
    rng = random.Random(1)
    for _ in range(10):
        hist = {rng.randint(1, 32): rng.randint(1, 500) for _ in range(12)}
        used = dict.fromkeys(hist, 0)
        packs = 0
        for n, inside in packing.pack_plan(hist, 32):
            assert n > 0 and sum(k * v for k, v in inside.items()) <= 32
            packs += n
            for k, v in inside.items():
                used[k] += n * v
        assert used == hist
        assert packs <= 1.25 * sum(k * v for k, v in hist.items()) / 32 + sum(k > 16 for k in hist for _ in range(hist[k])) * 0.5 + 5
