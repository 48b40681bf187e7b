"""Token ids of whole texts by a public tokenizer file, with a bounded memory of words already encoded.

The byte-level tokenizer cuts a text at every single space or line break that
stands between two characters that are no white space, and never joins pieces
across such a place. So a text without other white space around these is
encoded word by word, each distinct word once; every other text goes to the
library whole.
"""

from __future__ import annotations

import json
import os
import re
import string
from operator import attrgetter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

DEFAULT = "byte_bpe_50k.json"
#: Words that a worker remembers; beyond that it keeps the short ones, which recur most.
MEMORY_WORDS = 800_000
SHORT = 8
LONGEST_KEPT = 64

_WHITE = r"[\s\x1c-\x1f\x85\u180e\u200b\ufeff]"
_ODD = re.compile(rf"[ \n]{_WHITE}|{_WHITE}[ \n]|^{_WHITE}|{_WHITE}\Z")
_RARE_WHITE = re.compile(r"[^\S \n]|[\x1c-\x1f\x85\u180e\u200b\ufeff]")
#: A word of letters, assigned for long, for which the library's pattern and Python agree.
_LETTERS = re.compile(r"\n?(?:[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0391-\u03a1\u03a3-\u03ce\u0410-\u044f\u0401\u0451\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5]+)").fullmatch
_PAIRS = ("  ", " \n", "\n ", "\n\n")


_id = attrgetter("id")
#: The letter by which a byte-level tokenizer writes each byte.
_BYTES = {b: chr(c) for b, c in zip([b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)], range(256, 324), strict=True)}


def _bytes(word: str) -> str:
    """The byte-level letters of a word."""
    return word if word.isascii() else word.encode().decode("latin-1").translate(_BYTES)


def _odd(text: str) -> bool:
    """Whether white space stands beside white space or at an end."""
    if text[0] in " \n" or text[-1] in " \n" or any(p in text for p in _PAIRS):
        return True
    return bool(_RARE_WHITE.search(text) and _ODD.search(text))


def _odd_words(words: list[str]) -> bool:
    """As _odd, for words that may begin with a line break: whether one is empty or has white space at an end."""
    line = " ".join(words).replace(" \n", " ").removeprefix("\n")
    return not line or _odd(line)


class Numbers(dict):
    """word -> number; a word that is asked for and has none gets the next one and is listed in fresh."""

    def __init__(self) -> None:
        self.next = 0
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        n = self[word] = self.next
        self.next = n + 1
        self.fresh.append(word)
        return n

    def take_back(self, n: int) -> None:
        """Forgets the fresh words but for the first n."""
        for word in self.fresh[n:]:
            del self[word]
        self.next -= len(self.fresh) - n
        del self.fresh[n:]


class Encoder:
    """ids(texts) gives the ids of each text as little-endian unsigned 32-bit bytes.

    The ids of a word of number n are flat[starts[n] : starts[n] + lengths[n]]."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = added
        parts = json.loads(self.tokenizer.to_str())
        self.byte_level = parts["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} and not parts["normalizer"]
        self.model = self.tokenizer.model if parts["model"]["type"] == "BPE" else None
        line = self._whole("\n")
        self.line, self.line_id = line, int(np.frombuffer(line, "<u4")[0])
        self.forget()

    def forget(self) -> None:
        self.known, self.marks = Numbers(), {}
        self.starts, self.lengths, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _words(self, words: list[str]) -> list[bytes]:
        """Encodes words of one line each by one call, with line breaks between them."""
        ids = np.array(self.tokenizer.encode_batch_fast(["\n".join(words)], add_special_tokens=False)[0].ids, "<u4")
        cuts = np.flatnonzero(ids == self.line_id)
        if len(cuts) != len(words) - 1:
            return [self._whole(w) for w in words]
        ends = [*(cuts * 4).tolist(), len(ids) * 4]
        starts = [0, *((cuts + 1) * 4).tolist()]
        raw = ids.tobytes()
        return [raw[i:j] for i, j in zip(starts, ends, strict=True)]

    def _store(self, numbers: list[int], lengths: np.ndarray, flat: np.ndarray) -> None:
        """The ids of words, one after another."""
        self.starts[numbers] = len(self.flat) + np.cumsum(lengths) - lengths
        self.lengths[numbers] = lengths
        self.flat = np.concatenate([self.flat, flat])

    def _store_raw(self, numbers: list[int], raws: list[bytes]) -> None:
        self._store(numbers, np.fromiter(map(len, raws), np.int64, len(raws)) // 4, np.frombuffer(b"".join(raws), "<u4"))

    def _gather(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of words of these numbers, one after another."""
        parts = [self.flat[:0]]
        for at in range(0, len(numbers), 1 << 19):
            some = numbers[at : at + (1 << 19)]
            lengths = self.lengths[some]
            ends = np.cumsum(lengths)
            parts.append(self.flat[np.repeat(self.starts[some] - ends + lengths, lengths) + np.arange(ends[-1])])
        return np.concatenate(parts)

    def _learn(self) -> None:
        """Punctuation after a letter is a piece of its own, so a word is encoded once for all the marks that follow it.

        Letters alone, with or without a space before them, are one piece, which the library's merges take as it is."""
        known, fresh = self.known, self.known.fresh
        if not fresh:
            return
        first = known.next - len(fresh)
        tailed, bases, tails = [], [], []
        letters: list[int] = []
        others: tuple[list[int], list[int]] = [], []
        for i, w in enumerate(fresh):  # which grows by words without their marks
            if not w[-1].isalpha():
                base = w.rstrip(string.punctuation)
                if base and base != w and base[-1].isalpha():
                    tailed.append(i)
                    bases.append(known[base])
                    tails.append(w[len(base) :])
                    continue
            if _LETTERS(w) and self.model:
                letters.append(i)
            else:
                others[w[0] == "\n"].append(i)
        marks = list(set(tails).difference(self.marks))
        mark_numbers = list(range(known.next, known.next + len(marks)))
        known.next += len(marks)
        self.marks.update(zip(marks, mark_numbers, strict=True))
        more = np.zeros(known.next - len(self.starts), np.int64)
        self.starts, self.lengths = np.concatenate([self.starts, more]), np.concatenate([self.lengths, more])
        if marks:
            self._store_raw(mark_numbers, self._words(marks))
        if letters:
            tokenize, ids, ends = self.model.tokenize, [], [0]
            for i in letters:
                w = fresh[i]
                if w[0] == "\n":
                    ids.append(self.line_id)
                    ids.extend(map(_id, tokenize(_bytes(w[1:]))))
                else:
                    ids.extend(map(_id, tokenize("\u0120" + _bytes(w))))
                ends.append(len(ids))
            self._store([first + i for i in letters], np.diff(ends), np.array(ids, "<u4"))
        for line_start, places in enumerate(others):
            for at in range(0, len(places), 20_000):
                part = places[at : at + 20_000]
                raws = self._words([fresh[i][1:] if line_start else " " + fresh[i] for i in part])
                self._store_raw([first + i for i in part], [self.line + raw for raw in raws] if line_start else raws)
        if tailed:
            both = np.c_[bases, [self.marks[t] for t in tails]]
            self._store([first + i for i in tailed], self.lengths[both].sum(1), self._gather(both.ravel()))

    def _shrink(self) -> None:
        """Keeps the short words, if these are not too many."""
        kept = [(w, n) for w, n in self.known.items() if len(w) <= SHORT]
        numbers = np.array([n for _, n in kept], np.int64)
        lengths, flat = self.lengths[numbers], self._gather(numbers)
        self.forget()
        if len(kept) <= MEMORY_WORDS // 2:
            self.known.update((w, i) for i, (w, _) in enumerate(kept))
            self.known.next = len(kept)
            self.starts, self.lengths, self.flat = np.cumsum(lengths) - lengths, lengths, flat

    def ids(self, texts: list[str]) -> list[bytes]:
        if self.known.next > MEMORY_WORDS or len(self.flat) > 16 * MEMORY_WORDS:
            self._shrink()
        known, fresh = self.known, self.known.fresh
        ask = known.__getitem__
        numbers: list[np.ndarray] = [np.zeros(0, np.int64)]
        by_word = []
        for text in texts:
            by_word.append(False)
            if not self.byte_level or not text or any(t in text for t in self.special):
                continue
            words = text.replace("\n", " \n").split(" ")
            words[0] = "\n" + words[0]
            before = len(fresh)
            found = np.fromiter(map(ask, words), np.int64, len(words))
            if len(fresh) > before and _odd_words(fresh[before:]):
                known.take_back(before)
                continue
            numbers.append(found)
            by_word[-1] = True
        self._learn()
        skip = len(self.line)
        every = np.concatenate(numbers)
        ends = np.r_[0, np.cumsum(self.lengths[every])][np.cumsum([len(x) for x in numbers])] * 4
        raw = self._gather(every).tobytes()
        cuts = iter(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))
        out = []
        for text, words in zip(texts, by_word, strict=True):
            if words:
                i, j = next(cuts)
                out.append(raw[i + skip : j])
            else:
                out.append(self._whole(text) if text else b"")
        for w in fresh:
            if len(w) > LONGEST_KEPT:
                del known[w]
        fresh.clear()
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str | None = None) -> Encoder:
    """One per Python worker and file."""
    path = path or public_tokenizers.path(DEFAULT)
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def forget() -> None:
    """Drops the words that this worker's encoders remember; they are encoded again when they are met again."""
    for coder in _encoders.values():
        coder.forget()


def batched(texts: list[str | None], most_chars: int = 4_000_000) -> list[tuple[int, int]]:
    """Runs of rows with about most_chars characters each."""
    runs, at, size = [], 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most_chars:
            runs.append((at, i + 1))
            at, size = i + 1, 0
    if at < len(texts):
        runs.append((at, len(texts)))
    return runs
