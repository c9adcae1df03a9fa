import numpy as np

from inkstone.llm import textkernel


def test_words_of_rows():
    texts = [b"", b"one two", b"", b"three", b" \n", b"FOUR  five ", b""]
    data, starts = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    begin, end, rows = textkernel.word_bounds(data, starts)
    assert [(int(r), bytes(data[b:e])) for b, e, r in zip(begin, end, rows)] == [(r, w) for r, t in enumerate(texts) for w in t.split()]
    assert (textkernel.translated(data, textkernel.LOWER) == textkernel.LOWER[data]).all()
    assert (textkernel.translated(data, textkernel.SPACE) == textkernel.SPACE[data]).all()


def test_hashes_do_not_depend_on_the_bytes_at_a_time(monkeypatch):
    rng = np.random.default_rng(6)
    words = [bytes(rng.integers(97, 123, n, dtype=np.uint8)) for n in (*rng.integers(1, 12, 20_000), 100_000, 3)]
    data = np.frombuffer(b" ".join(words), np.uint8)
    begin, end, _ = textkernel.word_bounds(data, np.array([0, len(data)]))
    found = []
    for size in (64, textkernel.HASH_BYTES, len(data)):
        monkeypatch.setattr(textkernel, "HASH_BYTES", size)
        found.append(textkernel.word_hashes(data, begin, end))
    assert (found[0] == found[1]).all() and (found[1] == found[2]).all()
    assert len(np.unique(found[0])) == len(set(words))
