"""Token ids of whole texts, word by word.

The word tokenizer drops white space and never lets a token cross it, so a text's ids are
its words' ids in order. Only words not seen before by this worker are tokenized; the rest
is array look-ups, and no step handles a text larger than a chunk at once.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from . import _common as C

#: The vocabulary file of the contract, and the ids that may end a document.
WORD_TOKENIZER = "word_bpe_49k.json"
#: Words a worker remembers before it starts afresh (a chunk with more holds all of its own); words tokenized at once.
REMEMBERED, RUN = 2 << 20, 512

_MARK, _PLAIN = np.zeros(256, bool), np.zeros(256, bool)
_MARK[list(b".,!?;:*$%&#")] = True
_PLAIN[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")] = True


class WordIds:
    """ids(data, offs): all rows' ids one after the other, and the row offsets.

    A word is looked up without its last marks ('erea,' is 'erea' and ','), which are
    tokens of their own whenever they follow an ASCII letter or digit, and in lower case, as
    the tokenizer would put it (but for texts with the start of a special token). Words are
    looked up by hash and compared byte by byte; one that shares the hash of another is
    remembered by its spelling.
    """

    def __init__(self, name: str, plain_specials: bool = False):
        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for w, i in self.tokenizer.get_vocab().items() if w.endswith("</w>")]] = True
        self.tokenizer.encode_special_tokens = plain_specials
        self._forget()

    def _forget(self) -> None:
        self.hashes = np.zeros(0, np.uint64)  # sorted
        self.slot = np.zeros(0, np.int64)
        self.at = np.zeros(1, np.int64)  # of each slot in flat
        self.flat = np.zeros(0, np.uint32)
        self.spelled_at = np.zeros(1, np.int64)  # of each slot in spelled
        self.spelled = np.zeros(0, np.uint8)
        self.twins: dict[bytes, int] = {}  # slots of words whose hash another word has

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, and how many each has."""
        # A word of letters alone is one pre-token, and its last id alone ends a word: such words go in runs.
        plain = np.fromiter((w.isalpha() and w.lower().isalpha() for w in words), bool, len(words))
        sizes = np.zeros(len(words), np.int64)
        parts: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(words)
        where = np.flatnonzero(plain)
        for k in range(0, len(where), RUN):
            run = where[k : k + RUN]
            ids = np.array(self.tokenizer.encode(" ".join([words[i] for i in run]), add_special_tokens=False).ids, np.uint32)
            stop = np.flatnonzero(self.ends[ids]) + 1
            assert len(stop) == len(run) and stop[-1] == len(ids)
            for i, part in zip(run.tolist(), np.split(ids, stop[:-1]), strict=True):
                parts[i] = part
        for i in np.flatnonzero(~plain).tolist():
            parts[i] = np.array(self.tokenizer.encode(words[i], add_special_tokens=False).ids, np.uint32)
        sizes[:] = [len(x) for x in parts]
        return np.concatenate(parts), sizes

    def _add(self, words: list[bytes]) -> np.ndarray:
        """New slots for words."""
        ids, sizes = self._encode([w.decode("utf-8", "replace") for w in words])
        slots = len(self.at) - 1 + np.arange(len(sizes))
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(sizes)])
        self.flat = np.concatenate([self.flat, ids])
        self.spelled_at = np.concatenate([self.spelled_at, self.spelled_at[-1] + np.cumsum([len(w) for w in words])])
        self.spelled = np.concatenate([self.spelled, np.frombuffer(b"".join(words), np.uint8)])
        return slots

    def _learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        slots = self._add(words)
        where = np.searchsorted(self.hashes, hashes)
        self.slot = np.insert(self.slot, where, slots)
        self.hashes = np.insert(self.hashes, where, hashes)

    def _checked(self, slot: np.ndarray, data: np.ndarray, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """slot, with those of words that are spelled differently put right."""
        odd = np.flatnonzero(~C.same_words(data, starts, ends, self.spelled, self.spelled_at[slot], self.spelled_at[slot + 1]))
        if len(odd):
            words = [raw[a:b] for a, b in zip(starts[odd].tolist(), ends[odd].tolist(), strict=True)]
            new = [w for w in dict.fromkeys(words) if w not in self.twins]
            if new:
                self.twins |= zip(new, self._add(new).tolist(), strict=True)
            slot[odd] = [self.twins[w] for w in words]
        return slot

    def _find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        i = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return self.slot[i], self.hashes[i] == hashes

    def _units(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Spans of what is looked up, and each row's first: words, cut before their last marks."""
        starts, ends, first = C.word_spans(data, offs)
        stem = ends.copy()
        for _ in range(3):
            stem -= (stem - 1 > starts) & _MARK[data[stem - 1]]
        cut = (stem < ends) & _PLAIN[data[stem - 1]]
        n = 1 + cut
        end = np.cumsum(n)
        a, b = np.repeat(starts, n), np.repeat(ends, n)
        marks = end[cut] - 1
        a[marks], b[marks - 1] = stem[cut], stem[cut]
        return a, b, np.r_[0, end][first]

    def ids(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if b"<|" not in (raw := data.tobytes()):
            data = np.where((data >= 0x41) & (data <= 0x5A), data + np.uint8(32), data)
            raw = data.tobytes()
        starts, ends, first = self._units(data, offs)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
        distinct, one, back = np.unique(C.word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        slot, known = self._find(distinct)
        if not known.all():
            if len(self.at) - 1 + np.count_nonzero(~known) > REMEMBERED:  # afresh: this chunk's words, however many, and no others
                self._forget()
                known[:] = False
            new = one[~known]
            self._learn(distinct[~known], [raw[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)])
            slot, _ = self._find(distinct)
        slot = self._checked(slot[back], data, raw, starts, ends)
        size = self.at[slot + 1] - self.at[slot]
        end = np.cumsum(size)
        # Position in flat of every id: its word's place plus the offset in the word.
        where = np.repeat(self.at[slot] - (end - size), size) + np.arange(int(end[-1]))
        return self.flat[where], np.r_[0, end][first]


@cache
def word_ids(name: str = WORD_TOKENIZER, plain_specials: bool = False) -> WordIds:
    """One for each worker."""
    return WordIds(name, plain_specials)
