"""Token ids of whole texts with a public BPE vocabulary, word by word from a store."""
import functools
import itertools
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np

from aerofield.llm.common import word_blocks

# Marks of ASCII but the apostrophe, which has rules of its own; and Latin letters.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_LATIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
_SENTENCE = re.compile(r"[.!?][\"')\]]*$")
GROUP_BYTES, GROUP_WORDS = 1 << 20, 1 << 15


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions of many stretches, one after the other."""
    after = np.cumsum(sizes, dtype=np.int64)
    return np.repeat(starts - (after - sizes), sizes) + np.arange(after[-1] if len(after) else 0)


class Stretches:
    """Id sequences by number, in one growing array."""

    def __init__(self):
        self.n, self.used = 0, 0
        self.ids = np.zeros(1 << 16, "<u4")
        self.start, self.size, self.ends = (np.zeros(1 << 14, k) for k in (np.int64, np.int64, bool))

    def add(self, ids: np.ndarray, sizes: np.ndarray, ends: np.ndarray) -> range:
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.n + len(sizes) > len(self.size):
            self.start, self.size, self.ends = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size, self.ends))
        at = slice(self.n, self.n + len(sizes))
        self.ids[self.used:self.used + len(ids)] = ids
        self.start[at] = self.used + np.cumsum(sizes) - sizes
        self.size[at], self.ends[at] = sizes, ends
        self.used += len(ids)
        self.n += len(sizes)
        return range(at.start, at.stop)

    def get(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = self.size[at]
        return self.ids[_spread(self.start[at], size)], size


class Words:
    """Ids of words cut at ASCII white space, which the vocabulary drops.

    A run of Latin letters and the marks after it are units of the vocabulary's splitter,
    so the ids of such a word are those of its two units; any other word is a unit.
    Every unit is encoded by the library once and kept.  Stores are emptied when full,
    which changes no result."""

    def __init__(self, path: str, most: int = 300_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.most, self.coder = most, Tokenizer.from_file(path)
        vocab = self.coder.get_vocab()
        self.closes = np.zeros(max(vocab.values()) + 1, bool)
        self.closes[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self._empty_units()
        self._empty_words()

    def _empty_units(self):
        self.units, self.parts = {"": 0}, Stretches()
        self.parts.add(np.zeros(0, "<u4"), np.zeros(1, np.int64), np.zeros(1, bool))

    def _empty_words(self):
        self.known: dict[bytes, int] = {}
        self.words = Stretches()

    def _encode_runs(self, runs: list[str]):
        """Runs of letters many to a call: just the last id of each closes a word."""
        packs = [runs[i:i + 512] for i in range(0, len(runs), 512)]
        for pack, got in zip(packs, self.coder.encode_batch_fast([" ".join(p) for p in packs], add_special_tokens=False)):
            ids = np.array(got.ids, "<u4")
            cuts = np.flatnonzero(self.closes[ids]) + 1
            if len(cuts) == len(pack):
                self.units.update(zip(pack, self.parts.add(ids, np.diff(cuts, prepend=0), np.zeros(len(pack), bool))))
            else:
                self._encode_each(pack)

    def _encode_each(self, texts: list[str]):
        got = [g.ids for g in self.coder.encode_batch_fast(texts, add_special_tokens=False)]
        flat = np.fromiter(itertools.chain.from_iterable(got), "<u4")
        ends = np.array([_SENTENCE.search(t) is not None for t in texts], bool)
        self.units.update(zip(texts, self.parts.add(flat, np.array([len(g) for g in got], np.int64), ends)))

    def _learn(self, new: list[bytes]):
        if len(self.units) > 2 * self.most:
            self._empty_units()
        first, second, runs, others = [], [], {}, {}
        units = self.units
        for w in new:
            text = w.decode("utf-8", "replace")
            run = text.rstrip(MARKS)
            if run.isalpha() and (run.isascii() or _LATIN.fullmatch(run)):
                marks, run = text[len(run):], run.lower()
                if run not in units:
                    runs[run] = None
                if marks not in units:
                    others[marks] = None
            else:
                run, marks = text, ""
                if text not in units:
                    others[text] = None
            first.append(run)
            second.append(marks)
        if runs:
            self._encode_runs(list(runs))
        if others:
            self._encode_each([o for o in others if o not in units])
        pairs = np.empty((len(new), 2), np.int64)
        pairs[:, 0] = list(map(units.__getitem__, first))
        pairs[:, 1] = list(map(units.__getitem__, second))
        ids, sizes = self.parts.get(pairs.reshape(-1))
        ends = self.parts.ends[pairs].any(axis=1)
        self.known.update(zip(new, self.words.add(ids, sizes.reshape(-1, 2).sum(axis=1), ends)))

    def group(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the words in turn, ids after each word, and which words end a sentence."""
        at = np.fromiter(map(self.known.get, words, itertools.repeat(-1)), np.int64, len(words))
        lost = np.flatnonzero(at < 0)
        if len(lost):
            if len(self.known) > self.most:
                self._empty_words()
                lost = np.arange(len(words))
            self._learn(list(dict.fromkeys(map(words.__getitem__, lost.tolist()))))
            at[lost] = list(map(self.known.__getitem__, map(words.__getitem__, lost.tolist())))
        ids, size = self.words.get(at)
        return ids, np.cumsum(size), self.words.ends[at]

    def texts(self, texts: Iterable[bytes | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray, bool]]:
        """(number of the text, ids, id counts after each sentence, whether the text is
        done).  Short texts are looked up together, a long one comes in blocks."""
        words, bounds, first = [], [0], 0

        def told():
            ids, after, ends = self.group(words)
            stops = np.concatenate([[0], after])[bounds]
            hits = np.flatnonzero(ends)
            cuts = np.searchsorted(hits, bounds)
            for k, (a, b) in enumerate(zip(stops[:-1], stops[1:])):
                yield first + k, ids[a:b], after[hits[cuts[k]:cuts[k + 1]]] - a, True

        n = 0
        for data in texts:
            data = data or b""
            if len(data) > GROUP_BYTES:
                yield from told()
                for block in word_blocks(data, lower=False):
                    ids, after, ends = self.group(block)
                    yield n, ids, after[ends], False
                yield n, np.zeros(0, "<u4"), np.zeros(0, np.int64), True
                words, bounds, first = [], [0], n + 1
            else:
                words += data.split()
                bounds.append(len(words))
                if len(words) > GROUP_WORDS:
                    yield from told()
                    words, bounds, first = [], [0], n + 1
            n += 1
        yield from told()


@functools.cache
def store(path: str) -> Words:
    """One store for each Python worker and vocabulary."""
    return Words(path)
