import numpy as np

from quarrylens.llm import common


def test_span_hashes_do_not_depend_on_place_or_block(monkeypatch):
    text = b" ".join(f"w{i % 997}".encode() for i in range(200_000))
    raw = np.frombuffer(text, np.uint8)
    gaps = np.flatnonzero(raw == 32)
    starts, ends = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(raw)]])
    got = common.span_hashes(raw, starts, ends)
    back = common.span_hashes(raw, starts[::-1].copy(), ends[::-1].copy())[::-1]
    assert (got == back).all()
    assert len(np.unique(got)) == 997 and (got[:997] == got[997 : 2 * 997]).all()


def test_words_are_split_at_ascii_white_space_only():
    joined, starts, ends, counts = common.words_of([" a\tb c\x0bd ".encode(), b"", b"\n", "é".encode()])
    assert [joined[s:e].decode() for s, e in zip(starts, ends)] == ["a", "b c", "d", "é"] and counts.tolist() == [3, 0, 0, 1]
