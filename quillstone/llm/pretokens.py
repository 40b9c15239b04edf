"""Pre-tokens of a word-level BPE file, found without the library's overhead.

The library normalises (NFC, white space, lower case), splits by a pattern and
then merges inside each piece, so the ids of a text are the ids of its pieces,
one after the other.  For texts up to U+012F (no combining marks, one-to-one
lower case) the split is done by one compiled pattern; any other text is split
by the library's own normaliser and pre-tokeniser.  Either way a text becomes
pre-tokens, and only distinct pre-tokens are merged to ids.  Special strings are
cut out first, as the library does.
"""

from __future__ import annotations

import os
import re
import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa

from . import common

_LIMIT = 0x130
_SPACE = {0x20, 0x85, 0xA0, *range(9, 14)}


def _kind(cp: int) -> str:
    return "s" if cp in _SPACE else unicodedata.category(chr(cp))[0]


def _class(kinds: str) -> str:
    return "".join(rf"\u{cp:04x}" for cp in range(_LIMIT) if _kind(cp) in kinds)


_OTHER = "".join(rf"\u{cp:04x}" for cp in range(_LIMIT) if _kind(cp) not in "sLN")
#: The contractions of the public word-level pattern.
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
FAST = re.compile(f"{CONTRACTIONS}|[{_class('L')}]+|[{_class('N')}]|[{_OTHER}]+")
BEYOND = re.compile(r"[^\u0000-į]")


class Pieces:
    """Splits texts to pre-tokens and turns pre-tokens to ids; lives in one worker."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.plain = Tokenizer.from_file(path)
        self.plain.encode_special_tokens = True
        for t in (self.whole, self.plain):
            t.no_truncation()
            t.no_padding()
        self.specials = {t.content: i for i, t in self.whole.get_added_tokens_decoder().items() if t.special}
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.narrow = self.whole.get_vocab_size(True) <= 65536
        vocabulary, mark = self.plain.get_vocab(True), getattr(self.plain.model, "end_of_word_suffix", None)
        self.is_end = np.zeros(max(vocabulary.values()) + 1, bool)
        if mark:
            self.is_end[[i for t, i in vocabulary.items() if t.endswith(mark)]] = True
        self.kind = np.dtype("<u2" if self.narrow else "<u4")

    def _cut(self, text: str) -> list[str]:
        """Pre-tokens of a text without special strings."""
        if text.isascii() or not BEYOND.search(text):
            return FAST.findall(text.lower())
        normal = self.plain.normalizer.normalize_str(text)
        return [normal[a:b] for _, (a, b) in self.plain.pre_tokenizer.pre_tokenize_str(normal)]

    def split(self, text: str) -> tuple[list[str], list[tuple[int, int]]]:
        """(pre-tokens, [(place among them, special id)])."""
        if self.special_pattern is None or not any(s in text for s in self.specials):
            return self._cut(text), []
        found: list[str] = []
        marks = []
        for part in self.special_pattern.split(text):
            if part in self.specials:
                marks.append((len(found), self.specials[part]))
            else:
                found += self._cut(part)
        return found, marks

    def _settled(self, text: str) -> bool:
        """Whether the normaliser, which pre-tokens have passed, would leave a text as it is."""
        return text.isascii() or self.plain.normalizer.normalize_str(text) == text

    def _alone(self, word: str) -> list[int]:
        """Ids of one pre-token, which the normaliser must not change again (lower case may leave letters that compose)."""
        if self._settled(word):
            return self.plain.encode(word, add_special_tokens=False).ids
        return [t.id for mapped, _ in self.plain.pre_tokenizer.pre_tokenize_str(word) for t in self.plain.model.tokenize(mapped)]

    def encode_new(self, words: list[str], chunk: int = 4096) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens, one after the other, and how many each has.

        Where the vocabulary marks the ends of words, many pre-tokens go to the
        library as one text and the ids are parted at the marks.
        """
        ids, sizes = [], []
        for lo in range(0, len(words), chunk):
            part = words[lo : lo + chunk]
            text = " ".join(part)
            settled = self._settled(text)
            got = np.array(self.plain.encode_batch_fast([text], add_special_tokens=False)[0].ids if settled else [], np.int64)
            last = np.flatnonzero(self.is_end[got])
            if len(last) == len(part):
                sizes.append(np.diff(last, prepend=-1))
            else:
                each = [e.ids for e in self.plain.encode_batch_fast(part, add_special_tokens=False)] if settled else list(map(self._alone, part))
                sizes.append(np.fromiter(map(len, each), np.int64, len(each)))
                got = np.fromiter(chain.from_iterable(each), np.int64, int(sizes[-1].sum()))
            ids.append(got)
        return np.concatenate(ids), np.concatenate(sizes)

    def count_new(self, tokens: list[str]) -> list[int]:
        """Pieces in each pre-token."""
        return self.encode_new(tokens)[1].tolist()

    def _known(self, words: list[str], keep: int) -> list[bytes]:
        """Ids of pre-tokens.  Those used of late are remembered, up to twice ``keep``, from call to call."""
        young, old = self.known, self.older
        if len(young) > keep:
            old = self.older = young
            young = self.known = {}
        need = set(words) - young.keys()
        for t in need & old.keys():
            young[t] = old[t]
        if new := list(need - old.keys()):
            ids, sizes = self.encode_new(new)
            raw = ids.astype(self.kind).tobytes()
            edge = (np.cumsum(sizes) * self.kind.itemsize).tolist()
            young.update(zip(new, (raw[a:b] for a, b in zip([0, *edge], edge, strict=False)), strict=True))
        return list(map(young.__getitem__, words))

    def ids_of(self, texts: list[str], end: int | None = None, keep: int = 300_000) -> list[bytes]:
        """Ids of each text as bytes, 2 little-endian bytes an id (4 for large vocabularies), ``end`` after each.

        Equal pre-tokens of a call are looked up once; ids are gathered as arrays.
        """
        found = [self.split(t) for t in texts]
        flat: list[str] = []
        lengths = np.zeros(len(texts), np.int64)
        for i, got in enumerate(found):
            if not got[1]:
                flat += got[0]
                lengths[i] = len(got[0])
        coded = pa.array(flat, pa.string()).dictionary_encode()
        parts = self._known(coded.dictionary.to_pylist(), keep)
        size = np.fromiter(map(len, parts), np.int64, len(parts)) // self.kind.itemsize
        raw = np.frombuffer(b"".join(parts), self.kind)
        code = coded.indices.to_numpy()
        n = size[code]
        ends = np.cumsum(n)
        place = np.repeat((np.cumsum(size) - size)[code] - (ends - n), n)
        place += np.arange(len(place))
        ids = raw[place]
        edge = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(lengths)))].tolist()
        tail = b"" if end is None else np.array([end], self.kind).tobytes()
        return [self._apart(got, keep) + tail if got[1] else ids[edge[i] : edge[i + 1]].tobytes() + tail for i, got in enumerate(found)]

    def _apart(self, got: tuple[list[str], list[tuple[int, int]]], keep: int) -> bytes:
        """Ids of a text with special strings."""
        parts = self._known(got[0], keep)
        for place, special in reversed(got[1]):
            parts.insert(place, np.array([special], self.kind).tobytes())
        return b"".join(parts)

    def ids(self, text: str) -> bytes:
        return self.ids_of([text])[0]


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    """One splitter per file and worker, with what it remembers from task to task."""
    return Pieces(path)


common.REMEMBERED["pieces"] = pieces.cache_clear
