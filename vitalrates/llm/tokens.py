"""Token ids of whole texts by the tokenizers library, each distinct piece of
text encoded once.

The two supported files split a text into pieces that are encoded one by one,
so a text's ids are its pieces' ids in a row. The pieces of a batch are found
by character classes over its UTF-8 bytes and numbered by their distinct
strings; only strings not met before go through the library. Classes come from
the Unicode tables, for the characters whose class, lower case and composition
no version disputes (every script's letters, dashes, quotes, emoji). No piece
reaches over white space, so where a word holds another character, that word
alone is one piece, which the library splits further. Only a text with the
string of a special token is handed to the library whole.

Defined cases: a null text is empty and has no ids; a very long text is worked
off like any other, alone in its batch; a very long piece is encoded but makes
the memory of pieces start anew once ``CACHE_CHARS`` are held.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE, LETTER, NUMBER, OTHER, STRANGE = range(5)
#: white space of the patterns (fixed values); no other character is
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: classes are kept for the first two planes; all later characters are STRANGE
PLANES = 0x20000
#: pieces kept in a worker's memory, about 250 bytes each, and their characters; beyond either the half used most often stays
CACHE, CACHE_CHARS = 450_000, 64 << 20


def _utf8(cp: int) -> int:
    return 1 + (cp >= 0x80) + (cp >= 0x800) + (cp >= 0x10000)


@lru_cache
def classes(words: bool) -> tuple[np.ndarray, np.ndarray]:
    """Class and lower case of each character. A letter or number must have
    been one in the oldest Unicode tables at hand; what is neither now nor then
    is OTHER in any version. ``words``: texts are composed and lower-cased
    first, so a character that takes part in composition, or whose lower case
    is not one character of as many bytes, is STRANGE."""
    kind, low = np.full(PLANES + 1, STRANGE, np.uint8), np.arange(PLANES + 1, dtype=np.int64)
    kinds = {"L": LETTER, "N": NUMBER, "P": OTHER, "S": OTHER, "M": OTHER}
    old = unicodedata.ucd_3_2_0
    for cp in range(PLANES):
        c = chr(cp)
        now, then = unicodedata.category(c), old.category(c)
        k = OTHER if now == "Cf" else kinds.get(now[0], STRANGE)
        if k == OTHER and then[0] in "LNZ" or k in (LETTER, NUMBER) and kinds.get(then[0]) != k:
            k = STRANGE
        kind[cp] = k
    for c in BLANKS:
        kind[ord(c)] = SPACE
    if words:
        second = {int(d.split()[1], 16) for d in map(unicodedata.decomposition, map(chr, range(PLANES)))
                  if d and d[0] != "<" and " " in d}
        jamo = {*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)}
        for cp in np.flatnonzero((kind != STRANGE) & (kind != SPACE)).tolist():
            c, lower = chr(cp), chr(cp).lower()
            if (cp in second or cp in jamo or unicodedata.combining(c) or unicodedata.normalize("NFC", c) != c
                    or len(lower) != 1 or _utf8(ord(lower)) != _utf8(cp)):
                kind[cp] = STRANGE
            else:
                low[cp] = ord(lower)
    return kind, low


def split(data: np.ndarray, at: np.ndarray, words: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """Cut texts (``data[at[i]:at[i + 1]]``, UTF-8) into pieces.

    ``words``: lower case, white space dropped, digits one by one; else white
    space is kept and one blank goes with the run after it. Gives the bytes of
    all pieces in a row, their bounds, pieces per text, and which pieces hold
    strange characters (None: none does): such a piece is a whole run between
    white space, in its own case."""
    n = len(data)
    class_of, lower_of = classes(words)
    kind = class_of[data & 127]
    tail = (data & 0xC0) == 0x80
    lead = np.flatnonzero(data >= 0xC2)
    by_size = []
    if len(lead):
        b = data[lead]
        for size, own, bits in ((2, lead[b < 0xE0], 0x1F), (3, lead[(b >= 0xE0) & (b < 0xF0)], 0x0F), (4, lead[b >= 0xF0], 0x07)):
            if len(own):
                cp = (data[own] & bits).astype(np.int64)
                for j in range(1, size):
                    cp = cp << 6 | (data[own + j] & 0x3F)
                cp = np.minimum(cp, PLANES)
                for j in range(size):
                    kind[own + j] = class_of[cp]
                by_size.append((size, own, cp))
    first = np.zeros(n + 1, bool)
    first[at] = True
    raw = data
    if words:
        data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
        for size, own, cp in by_size:
            low = lower_of[cp]
            new = np.flatnonzero(low != cp)
            for j in range(size - 1, 0, -1):
                data[own[new] + j] = 0x80 | (low[new] >> 6 * (size - 1 - j) & 0x3F)
            data[own[new]] = (0xF00 >> size & 0xFF) | low[new] >> 6 * (size - 1)
    cut = first.copy()
    cut[1:n] |= kind[1:] != kind[:-1]
    if words:
        cut[:n] |= (kind == NUMBER) & ~tail
    else:
        end = np.flatnonzero((kind[1:] != SPACE) & (kind[:-1] == SPACE) & ~first[1:n]) + 1
        last = end - 1
        for _ in range(2):
            last = last - tail[last]
        cut[last] = True
        cut[end[data[end - 1] == 32]] = False
    quote = np.flatnonzero((data == 39) & cut[:n])
    quote = quote[(quote + 1 < n)]
    quote = quote[(kind[quote + 1] == LETTER) & ~first[quote + 1]]
    if len(quote):
        a = data[quote + 1]
        one = quote[np.isin(a, np.frombuffer(b"stmd", np.uint8))]
        far = quote[quote + 2 < n]
        far = far[~first[far + 2]]
        pair = data[far + 1].astype(np.int64) << 8 | data[far + 2]
        two = far[np.isin(pair, [int.from_bytes(x, "big") for x in (b"re", b"ve", b"ll")])]
        cut[one + 1] = cut[two + 1] = False
        cut[one + 2] = cut[two + 3] = True
    odd = np.flatnonzero(kind == STRANGE)
    inside = None
    if len(odd):
        solid = kind != SPACE
        begin = solid & first[:n]
        begin[1:] |= solid[1:] & ~solid[:-1]
        run = np.cumsum(begin)
        bad = np.zeros(int(run[-1]) + 1, bool)
        bad[run[odd]] = True
        inside = bad[run] & solid
        cut[:n] &= ~inside | begin
        data = np.where(inside, raw, data)
    cut[n] = True
    start = np.flatnonzero(cut)
    strange = None
    if inside is not None:
        before = np.concatenate([[0], np.cumsum(inside)])
        strange = np.diff(before[start]) > 0
    if words:
        keep = kind[start[:-1]] != SPACE
        size = np.diff(start)[keep]
        count = np.searchsorted(start[:-1][keep], at)
        return data[kind != SPACE], np.concatenate([[0], np.cumsum(size)]), np.diff(count), None if strange is None else strange[keep]
    return data, start, np.diff(np.searchsorted(start[:-1], at)), strange


class PieceEncoder:
    """Texts to ids, as the library encodes them with
    ``add_special_tokens=False`` and neither truncation nor padding."""

    def __init__(self, path: str, cache: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.ends = None
        if mark := spec["model"].get("end_of_word_suffix"):
            self.ends = np.zeros(self.tok.get_vocab_size(), bool)
            self.ends[[i for t, i in spec["model"]["vocab"].items() if t.endswith(mark)]] = True
        self.words = self.ends is not None
        added = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        self.mark = os.path.commonprefix(added) if added else ""
        self.limit = cache
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.start, self.size = np.zeros(1024, np.int64), np.zeros(1024, np.int32)
        self.flat, self.used = np.zeros(4096, np.uint32), 0
        self.hits = np.zeros(1024, np.int32)
        self.chars = 0

    def thin(self) -> None:
        """Forget the less used half; later texts mostly hold the other one."""
        words = list(self.number)
        keep = np.argsort(self.hits[:len(words)], kind="stable")[len(words) - self.limit // 2:]
        size, hits = self.size[keep], self.hits[keep] // 2
        end = np.cumsum(size, dtype=np.int64)
        at = np.repeat(self.start[keep] - (end - size), size) + np.arange(int(end[-1]) if len(end) else 0)
        self.flat, self.used = self.flat[at], len(at)
        self.start, self.size, self.hits = end - size, size, hits
        self.number = {words[i]: j for j, i in enumerate(keep.tolist())}
        self.chars = sum(map(len, self.number))
        if self.chars > CACHE_CHARS // 2:
            self.forget()

    def batch(self, pieces: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(pieces, add_special_tokens=False)]

    def learn(self, pieces: list[str], strange: list[bool]) -> list[np.ndarray]:
        """Ids of pieces not met before. Where the last token of a word is
        marked as such, many words go through the library as one text."""
        if not self.words:
            return self.batch(pieces)
        if any(strange):
            ids = {True: iter(self.batch([p for p, o in zip(pieces, strange) if o])),
                   False: iter(self.learn(own := [p for p, o in zip(pieces, strange) if not o], [False] * len(own)))}
            return [next(ids[o]) for o in strange]
        out = []
        for i in range(0, len(pieces), 256):
            own = pieces[i:i + 256]
            ids = np.array(self.tok.encode(" ".join(own), add_special_tokens=False).ids, np.uint32)
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) == len(own):
                out += [ids[a:b] for a, b in zip([0, *cut.tolist()], cut.tolist())]
            else:
                out += [self.whole(p) for p in own]
        return out

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, np.uint32)

    def _add(self, pieces: list[str], strange: list[bool]) -> None:
        for i in range(0, len(pieces), 20_000):
            own = pieces[i:i + 20_000]
            ids = self.learn(own, strange[i:i + 20_000])
            k, size = len(self.number), np.fromiter(map(len, ids), np.int32, len(ids))
            total = int(size.sum())
            if k + len(own) > len(self.size):
                more = len(own) + len(self.size) // 2
                self.start, self.size, self.hits = (np.concatenate([x, np.zeros(more, x.dtype)]) for x in (self.start, self.size, self.hits))
            if self.used + total > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros(total + len(self.flat) // 2, np.uint32)])
            self.size[k:k + len(own)] = size
            self.start[k:k + len(own)] = self.used + np.cumsum(size) - size
            self.flat[self.used:self.used + total] = np.concatenate(ids)
            self.used += total
            self.number.update(zip(own, range(k, k + len(own)), strict=True))
            self.chars += sum(map(len, own))

    def pieces(self, texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pieces and their places, which of the distinct ones hold
        strange characters, pieces per text, texts with a special token's string."""
        at = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[at[0]:at[-1]] if raw is not None else np.zeros(0, np.uint8)
        at = at - at[0]
        odd = np.zeros(len(texts), bool)
        if len(data) == 0:
            return pa.array([], pa.string()).dictionary_encode(), np.zeros(0, bool), np.zeros(len(texts), np.int64), odd
        data, bound, count, strange = split(data, at, self.words)
        own = pa.Array.from_buffers(pa.binary(), len(bound) - 1, [None, pa.py_buffer(bound.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
        if self.mark:
            for i in np.flatnonzero(np.asarray(pc.fill_null(pc.match_substring(texts, self.mark), False))).tolist():
                odd[i] = bool(self.special.search(texts[i].as_py()))
        if odd.any():
            keep = ~np.repeat(odd, count)
            own = own.filter(pa.array(keep))
            strange = None if strange is None else strange[keep]
            count = np.where(odd, 0, count)
        own = own.view(pa.string()).dictionary_encode()
        rough = np.zeros(len(own.dictionary), bool)
        if strange is not None:
            rough[np.asarray(own.indices)[strange]] = True
        return own, rough, count, odd

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the bounds of each text's ids."""
        texts = pc.fill_null(texts, "")
        own, rough, count, odd = self.pieces(texts)
        if len(self.number) > self.limit or self.chars > CACHE_CHARS:
            self.thin()
        strings = own.dictionary.to_numpy(zero_copy_only=False).tolist()
        index = list(map(self.number.get, strings))
        if None in index:
            new = [j for j, i in enumerate(index) if i is None]
            self._add([strings[j] for j in new], rough[new].tolist())
            index = list(map(self.number.get, strings))
        index = np.array(index, np.int64)
        self.hits[index] += 1
        k = index[np.asarray(own.indices)] if len(own) else np.zeros(0, np.int64)
        size = self.size[k]
        end = np.cumsum(size, dtype=np.int64)
        total = int(end[-1]) if len(end) else 0
        ids = self.flat[np.repeat(self.start[k] - (end - size), size) + np.arange(total)]
        bound = np.concatenate([[0], end])[np.concatenate([[0], np.cumsum(count)])]
        if not odd.any():
            return ids, bound
        parts = [self.whole(texts[i].as_py()) if odd[i] else ids[bound[i]:bound[i + 1]] for i in range(len(texts))]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        ids, bound = self.encode(pa.array(texts, pa.string()))
        return [ids[a:b].astype("<u4").tobytes() for a, b in zip(bound, bound[1:])]


_LOADED: dict[tuple, PieceEncoder] = {}


def encoder(path: str, make: type[PieceEncoder] = PieceEncoder, cache: int = CACHE) -> PieceEncoder:
    """One encoder per worker process; its memory of pieces serves later tasks."""
    if (path, make, cache) not in _LOADED:
        _LOADED[path, make, cache] = make(path, cache=cache)
    return _LOADED[path, make, cache]
