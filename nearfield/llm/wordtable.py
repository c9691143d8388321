"""A table of distinct words in each task: every distinct word is encoded once by the
tokenizers library, and its ids are joined back by position.

Ids are kept as packed little-endian bytes of one width, so joining a text's words back is
one ``bytes.join``. A table holds about ``most`` words; then the older half goes (memory stays bounded; a word is encoded again, with the same ids).
"""

from __future__ import annotations

import os
import re
from itertools import compress, count, islice, repeat
from operator import not_

import numpy as np

WORDS = 300_000
TOGETHER = 256  # words that are encoded as one text
#: Unicode white space outside ASCII
WIDE_SPACE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_LOADED: dict[str, object] = {}
_TABLES: dict[tuple[str, str], WordTable] = {}


def tokenizer(path: str):
    """The tokenizer of a file, without truncation and padding; loaded once a process."""
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _LOADED[path] = t
    return _LOADED[path]


def id_type(size: int) -> np.dtype:
    """The narrowest little-endian unsigned type for ids under ``size``."""
    return np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")


class WordTable:
    """``before`` stands before each word when it is encoded."""

    def __init__(self, path: str, before: str = "", most: int = WORDS):
        self.before, self.most = before, most
        self.t = tokenizer(path)
        self.type = id_type(self.t.get_vocab_size(with_added_tokens=True))
        self.ids: dict[bytes, bytes] = {}
        #: the id-to-piece table, for decoding
        table = {i: p for p, i in self.t.get_vocab(with_added_tokens=True).items()}
        self.piece = [table.get(i, "") for i in range(max(table) + 1)]
        #: the pieces that begin with a space, in byte-level BPE's spelling
        self.leads = np.array([p.startswith("\u0120") for p in self.piece])

    def _add_together(self, words: list[bytes]) -> list[bytes]:
        """Encode words as texts of many: a space begins a pre-token, so a word's ids begin where a piece begins with a space.
        Returns the words that are left: those beside whose ends a space could join other white space, and texts that
        have not one such piece a word."""
        plain, left = [], []
        for w in words:
            (plain if w and not (9 <= w[0] <= 13 or 9 <= w[-1] <= 13) else left).append(w)
        for k in range(0, len(plain), 4096):
            parts = [plain[a : a + TOGETHER] for a in range(k, min(k + 4096, len(plain)), TOGETHER)]
            for part, e in zip(parts, self.t.encode_batch_fast([" " + b" ".join(p).decode("utf-8", "replace") for p in parts], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, self.type)
                at = np.flatnonzero(self.leads[ids])
                if len(at) != len(part) or at[0] != 0:
                    left += part
                    continue
                packed, at = ids.tobytes(), [*(at * self.type.itemsize).tolist(), len(ids) * self.type.itemsize]
                self.ids.update(zip(part, map(packed.__getitem__, map(slice, at, at[1:])), strict=True))
        return left

    def add(self, words: list[bytes]) -> None:
        kind = self.type
        if self.before == " ":
            words = self._add_together(words)
        for k in range(0, len(words), 4096):
            part = words[k : k + 4096]
            for w, e in zip(part, self.t.encode_batch_fast([self.before + w.decode("utf-8", "replace") for w in part], add_special_tokens=False), strict=True):
                self.ids[w] = np.array(e.ids, kind).tobytes()

    def join(self, words: list[bytes]) -> bytes:
        """The ids of the words, in their order, packed."""
        return b"".join(self.each(words))

    def join_all(self, lists: list[list[bytes]]) -> list[bytes]:
        """The ids of each list of words, packed; what is missing is encoded at once, for all lists."""
        found, missing = [], set()
        for words in lists:
            got = list(map(self.ids.get, words, repeat(b"")))
            missing.update(compress(words, map(not_, got)))
            found.append(got)
        if missing:
            self.each(list(missing))
            for words, got in zip(lists, found, strict=True):
                for i in compress(count(), map(not_, got)):
                    got[i] = self.ids[words[i]]
        return list(map(b"".join, found))

    def each(self, words: list[bytes]) -> list[bytes]:
        """The packed ids of each word."""
        got = self.ids
        if missing := set(words).difference(got):
            if len(got) > self.most:
                for w in list(islice(got, len(got) // 2)):
                    del got[w]
                missing = set(words).difference(got)
            self.add(list(missing))
        return list(map(got.__getitem__, words))

    def decode(self, packed: bytes) -> str:
        """Pieces joined by spaces, as a tokenizer without decoder does: a join of ids with the id-to-piece table."""
        return " ".join(map(self.piece.__getitem__, np.frombuffer(packed, self.type).tolist()))


def word_table(path: str, before: str = "", most: int = WORDS) -> WordTable:
    """A table that this process keeps from task to task."""
    if (path, before) not in _TABLES:
        _TABLES[path, before] = WordTable(path, before, most)
    return _TABLES[path, before]


#: a run of white space and the word after it, or the white space at the end
LED = re.compile(rb"[\x09-\x0d\x20]*[^\x09-\x0d\x20]+|[\x09-\x0d\x20]+\Z")


def led(data: bytes) -> list[bytes]:
    """Words with the white space before them: where white space begins, a pre-token of byte-level BPE begins."""
    return LED.findall(data)



#: a space amid other white space, or after it at the end: such runs are not cut at each space
AMID = re.compile(rb"[\x09-\x0d] (?:[\x09-\x0d]|\Z)")


def single_spaced(data: bytes) -> bool:
    """Whether every space begins a pre-token of byte-level BPE."""
    return b"  " not in data and not AMID.search(data)
