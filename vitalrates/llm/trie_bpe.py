"""BPE encoding and decoding by a prefix-sharing trie.

The last token of the encoding of a prefix decides it all: the encoding of a
word's first n bytes is that of its first n - k bytes followed by one token of
k bytes, and exactly one k gives a token that may stand after the last token
there (a pair may stand together when merging the bytes of both from scratch
gives back the two). So the distinct pieces of a batch of texts form a trie
that is walked depth first; each node keeps the last token of its prefix, and
shared prefixes are worked out once. Sorted pieces are that trie in preorder:
the common prefix with the piece before is the part of the path that stays.

Defined cases: null text is empty; an empty text has no ids; the strings of
special tokens are their ids, as in the library; repeated rows are encoded one
by one; a very long text is walked like any other, alone in its batch; input
columns named as the new ones give way. Ids decode through their bytes, invalid UTF-8 as U+FFFD.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalrates.llm.common import ROW, fields, map_texts, unpack, whole_row
from vitalrates.llm.tokens import PieceEncoder, encoder

#: remembered answers to "may these two tokens stand together", about 150 bytes each; forgotten beyond
FITS = 500_000


def byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary:
    printable Latin-1 bytes stand for themselves, the others follow from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class TrieEncoder(PieceEncoder):
    """Encodes pieces by the trie; decodes ids through their bytes."""

    def __init__(self, path: str, **kw):
        super().__init__(path, **kw)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        chars = byte_characters()
        raw = {t: bytes(chars[c] for c in t) for t in spec["model"]["vocab"]}
        self.ids = {raw[t]: i for t, i in spec["model"]["vocab"].items()}
        self.bytes = {i: b for b, i in self.ids.items()}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[tuple[int, int], int] = {}
        for r, (a, b) in enumerate(pairs):
            k = self.ids[raw[a]], self.ids[raw[b]]
            self.rank[k], self.made[k] = r, self.ids[raw[a] + raw[b]]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes |= {i: t.encode() for t, i in self.added.items()}
        self.longest = sorted({len(b) for b in self.ids}, reverse=True)
        self.packed = {i: int(i).to_bytes(4, "little") for i in self.bytes}
        self.fits: dict[int, bool] = {}

    def merged(self, data: bytes) -> list[int]:
        """Merge the bytes pair by pair, lowest rank first, leftmost first."""
        out = [self.ids[data[i:i + 1]] for i in range(len(data))]
        while len(out) > 1:
            r, i = min((self.rank.get(p, 1 << 30), i) for i, p in enumerate(zip(out, out[1:])))
            if r == 1 << 30:
                break
            out[i:i + 2] = [self.made[out[i], out[i + 1]]]
        return out

    def follows(self, a: int, b: int) -> bool:
        """May token b stand right after token a (-1: at the start)?"""
        key = (a + 1) << 32 | b
        if key not in self.fits:
            alone = [b] if a < 0 else [a, b]
            self.fits[key] = self.merged(b"".join(self.bytes[t] for t in alone)) == alone
        return self.fits[key]

    def walk(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of sorted distinct words: a depth-first walk of their trie."""
        ids, fits, follows, packed = self.ids, self.fits, self.follows, self.packed
        last, start = [-1], [0]    # per depth: last token of the prefix, depth where that token starts
        before, out = b"", {}
        for w in words:
            same, most = 0, min(len(w), len(before))
            while same < most and w[same] == before[same]:
                same += 1
            del last[same + 1:], start[same + 1:]
            for depth in range(same + 1, len(w) + 1):
                for k in self.longest:
                    if k > depth:
                        continue
                    t = ids.get(w[depth - k:depth])
                    if t is not None:
                        a = last[depth - k]
                        ok = fits.get((a + 1) << 32 | t)
                        if ok is None:
                            ok = follows(a, t)
                        if ok:
                            last.append(t)
                            start.append(depth - k)
                            break
                else:
                    raise ValueError(f"no token ends the prefix {w[:depth]!r}")
            depth, own = len(w), []
            while depth:
                own.append(packed[last[depth]])
                depth = start[depth]
            out[w] = b"".join(reversed(own))
            before = w
        return out

    def cut(self, text: str) -> list[bytes]:
        return [text[a:b].encode() for _, (a, b) in self.tok.pre_tokenizer.pre_tokenize_str(text)]

    def learn(self, pieces: list[str], strange: list[bool]) -> list[np.ndarray]:
        """One walk for all: pieces with strange characters are split further
        by the library's own splitter and join the same trie."""
        if len(self.fits) > FITS:
            self.fits.clear()
        parts = [self.cut(p) if o else [p.encode()] for p, o in zip(pieces, strange, strict=True)]
        done = self.walk(sorted({x for own in parts for x in own}))
        return [np.frombuffer(b"".join([done[x] for x in own]), "<u4") for own in parts]

    def whole(self, text: str) -> np.ndarray:
        """Texts with the string of a special token: those are cut out first."""
        out, at = [], 0
        for m in [*self.special.finditer(text), None] if self.special else [None]:
            part = text[at:m.start() if m else len(text)]
            if part:
                out.append(self.encode(pa.array([part], pa.string()))[0].astype("<u4").tobytes())
            if m:
                out.append(self.packed[self.added[m[0]]])
                at = m.end()
        return np.frombuffer(b"".join(out), "<u4")

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def encoded(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns, ``ids`` (binary, little-endian unsigned 32-bit) and
    ``decoded`` (string) of every row; input columns of these names give way."""
    def factory():
        enc = encoder(path, TrieEncoder)

        def work(texts):
            ids = enc(texts)
            return ids, [enc.decode(i) for i in ids]
        return work

    keep = [c for c in (docs.columns if keep is None else keep) if c not in (text, "ids", "decoded")]
    row = whole_row(docs.select(*[F.col(f"`{c}`") for c in keep])) if keep else F.lit(0).alias(ROW)
    out = map_texts(docs, F.col(f"`{text}`"), [row], fields("ids binary, decoded string"), factory)
    return out.select(*unpack(docs, keep), "ids", "decoded")


def bpe_roundtrip(docs: DataFrame, path: str) -> DataFrame:
    """Query view: digests of ids and decoded text per document."""
    def factory():
        enc = encoder(path, TrieEncoder)

        def work(texts):
            ids = enc(texts)
            return ([len(i) // 4 for i in ids], [hashlib.sha256(i).hexdigest() for i in ids],
                    [hashlib.sha256(enc.decode(i).encode()).hexdigest() for i in ids])
        return work

    return map_texts(docs, F.col("text"), [F.col("doc_id")],
                     fields("n_tokens long, ids_sha256 string, decoded_sha256 string"), factory, 8 << 20)
