"""Skip-gram word vectors with negative sampling, trained in shares of the texts on the executors.

No word list and no vectors lie on the driver but a hash and a count of each word; a task
holds the vectors of the words of its own share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Words of negative samples for each pair; samples that a step's words share; centers of a block.
NEGATIVES, SHARED, BLOCK = 5, 64, 32
#: Tokens of a step: the first ones are short, later ones a part of what came before, so that small collections are trained too.
FIRST, PART, STEP = 256, 16, 4096
#: Rate of the first steps, and squares of gradients that count as seen before.
RATE, SEEN = 0.05, 1.0
_ODD = np.uint64(0x9E3779B97F4A7C15)


def start(hashes: np.ndarray, dimensions: int, seed: int) -> np.ndarray:
    """First vectors of words, the same wherever a word occurs: numbers that follow from its hash, so that shares agree on their axes."""
    with np.errstate(over="ignore"):
        x = hashes.astype(np.int64).view(np.uint64)[:, None] + _ODD * np.arange(1 + seed, 1 + seed + dimensions, dtype=np.uint64)[None, :]
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (((x ^ (x >> np.uint64(31))) >> np.uint64(40)).astype(np.float32) / np.float32(1 << 24) - np.float32(0.5)) / np.float32(np.sqrt(dimensions))


class Trainer:
    """Vectors of the words of one share; ``feed`` takes its documents in order, ``vectors`` ends.

    hashes, counts: all words, by hash.  Words are given by their place there.  The windows of a
    block of centers are one product of matrices, of which the band within the windows counts.
    Steps are Adagrad's with one sum of squares a word.
    """

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, dimensions: int, window: int, seed: int, share: int):
        self.hashes, self.dimensions, self.window, self.seed = hashes, dimensions, window, seed
        self.random = np.random.default_rng([seed, share])
        noise = np.cumsum(counts.astype(np.float64) ** 0.75)
        self.noise = noise / noise[-1]
        self.own, self.n = np.full(len(hashes), -1, np.int32), 0
        self.words = np.empty(0, np.int64)
        self.into, self.out = (np.empty((0, dimensions), np.float32) for _ in range(2))
        self.into_seen, self.out_seen, self.counts = np.empty(0, np.float32), np.empty(0, np.float32), np.empty(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.size, self.documents, self.done = 0, 0, 0
        blank = np.full(window, -1, np.int64)
        self.before = (blank, blank)
        band = np.abs(np.arange(BLOCK + 2 * window)[None, :] - window - np.arange(BLOCK)[:, None])
        self.band = np.where(band == 0, window + 1, band)

    def known(self, places: np.ndarray) -> np.ndarray:
        """Rows of words in this share's tables; new ones get one."""
        new = np.unique(places[self.own[places] < 0])
        if len(new):
            if self.n + len(new) > len(self.words):
                more = max(len(new), len(self.words) // 2, 1024)
                grown = lambda a: np.concatenate([a, np.zeros((more, *a.shape[1:]), a.dtype)])
                self.words, self.into, self.out, self.counts, self.into_seen, self.out_seen = map(grown, (self.words, self.into, self.out, self.counts, self.into_seen, self.out_seen))
            rows = slice(self.n, self.n + len(new))
            self.own[new] = np.arange(self.n, self.n + len(new))
            self.words[rows], self.into[rows] = new, start(self.hashes[new], self.dimensions, self.seed)
            self.into_seen[rows] = self.out_seen[rows] = SEEN
            self.n += len(new)
        return self.own[places]

    def feed(self, places: np.ndarray, lengths: np.ndarray) -> None:
        """places: words of documents, one after the other; lengths: of the documents."""
        self.waiting.append((places, np.repeat(np.arange(self.documents, self.documents + len(lengths)), lengths)))
        self.documents += len(lengths)
        self.size += len(places)
        if self.size >= STEP:
            self._steps(False)

    def _steps(self, last: bool) -> None:
        words, documents = (np.concatenate([self.before[k], *(x[k] for x in self.waiting)]) for k in (0, 1))
        if last:
            blank = np.full(self.window, -1, np.int64)
            words, documents = np.concatenate([words, blank]), np.concatenate([documents, blank])
        at, w = self.window, self.window
        while (left := len(words) - w - at) >= (step := min(STEP, max(FIRST, self.done // PART))) or (last and left > 0):
            end = at + min(left, step)
            self._step(words[at - w : end + w], documents[at - w : end + w])
            self.done += end - at
            at = end
        self.before, self.waiting, self.size = (words[at - w :], documents[at - w :]), [], len(words) - at

    def _step(self, words: np.ndarray, documents: np.ndarray) -> None:
        """words, documents: of the centers and of a window on both sides."""
        w, size, d = self.window, len(words) - 2 * self.window, self.dimensions
        blocks = -(-size // BLOCK)
        rows = np.zeros(blocks * BLOCK + 2 * w, np.int64)
        found = np.full(len(rows), -1, np.int64)
        found[: len(words)] = documents
        real = words >= 0
        rows[: len(words)][real] = self.known(words[real])
        centers = rows[w : w + blocks * BLOCK]
        reach = self.random.integers(1, w + 1, blocks * BLOCK)
        reach[found[w : w + blocks * BLOCK] < 0] = 0
        reach[size:] = 0
        others = self.known(np.minimum(np.searchsorted(self.noise, self.random.random(SHARED), side="right"), len(self.noise) - 1))

        u = self.into[centers].reshape(blocks, BLOCK, d)
        around = self.out[rows]
        windows = lambda a: np.lib.stride_tricks.sliding_window_view(a, BLOCK + 2 * w, axis=0)[::BLOCK]
        v = np.ascontiguousarray(np.moveaxis(windows(around), 2, 1))
        pair = (self.band[None] <= reach.reshape(blocks, BLOCK, 1)) & (found[w : w + blocks * BLOCK].reshape(blocks, BLOCK, 1) == windows(found)[:, None, :])
        pull = np.where(pair, 1 / (1 + np.exp(np.minimum(u @ v.transpose(0, 2, 1), 60))), np.float32(0))
        gu = (pull @ v).reshape(-1, d)
        gv = pull.transpose(0, 2, 1) @ u
        given = np.zeros_like(around)
        given[: blocks * BLOCK] += gv[:, :BLOCK].reshape(-1, d)
        tail = given[BLOCK : BLOCK * (blocks + 1)]
        if len(tail) == blocks * BLOCK:
            tail.reshape(blocks, BLOCK, d)[:, : 2 * w] += gv[:, BLOCK:]
        else:
            for k in range(blocks):
                given[(k + 1) * BLOCK : (k + 1) * BLOCK + 2 * w] += gv[k, BLOCK:]

        u, noise = u.reshape(-1, d), self.out[others]
        share = (pair.sum(axis=2).reshape(-1) * (NEGATIVES / SHARED)).astype(np.float32)
        push = share[:, None] / (1 + np.exp(np.minimum(-(u @ noise.T), 60)))
        gu -= push @ noise
        self._add(self.into, self.into_seen, centers[:size], gu[:size])
        self._add(self.out, self.out_seen, np.concatenate([rows, others]), np.concatenate([given, -(push.T @ u)]))
        np.add.at(self.counts, centers[:size], 1)

    @staticmethod
    def _add(table: np.ndarray, seen: np.ndarray, rows: np.ndarray, by: np.ndarray) -> None:
        order = np.argsort(rows)
        sorted_ = rows[order]
        starts = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
        total, own = np.add.reduceat(by[order], starts, axis=0), sorted_[starts]
        seen[own] += np.einsum("ij,ij->i", total, total) / table.shape[1]
        table[own] += total * (np.float32(RATE) / np.sqrt(seen[own]))[:, None]

    def vectors(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(hash, vector, occurrences) of the share's words, some at a time."""
        if self.size:
            self._steps(True)
        said = np.flatnonzero(self.counts[: self.n])
        for k in range(0, len(said), 8192):
            rows = said[k : k + 8192]
            yield self.hashes[self.words[rows]], self.into[rows], self.counts[rows]
