"""Byte-level BPE encoding and decoding with a segment tree over adjacent pair ranks.

For a piece of n symbols, leaf i of the tree holds (rank of the pair of symbols i and next(i), i). The root is
the minimum: the leftmost pair of the lowest rank. A merge changes at most three leaves, each updated in O(log n),
so a piece of n bytes takes O(n log n) whatever its length. Short pieces
share arrays, a row each, and are merged together. Ids travel as little-endian unsigned 32-bit bytes.

Cases: a null text is empty and has no ids; special tokens in a text become their id, as the library does with
the file's settings; unpaired surrogates cannot occur in Parquet strings; ids outside the vocabulary raise.
"""

from __future__ import annotations

import json
from array import array

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

CACHE = 200_000
"""Pieces that a task remembers; the cache starts anew when it is full."""
LONGEST_CACHED = 64
"""Bytes, counted as four a character; longer pieces have a tree of their own."""

# Fixed by the tokenizer file's format: how a byte-level pre-tokenizer splits a text.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte: itself where Latin-1 prints it, else the next code from 256 on."""
    out, free = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(free))
            free += 1
    return out


class Vocabulary:
    """Merges and tokens of a tokenizer file: plain data that pickles, some megabytes whatever the corpus."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids = spec["model"]["vocab"]
        self.byte_ids = [ids[c] for c in byte_alphabet()]
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault(ids[a] << 32 | ids[b], (rank, ids[a + b]))
        back = {c: b for b, c in enumerate(byte_alphabet())}
        self.bytes_of = {i: bytes(back[c] for c in token) for token, i in ids.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        for content, i in self.special.items():
            self.bytes_of[i] = content.encode()


def merge(symbols: list[int], merges: dict[int, tuple[int, int]]) -> list[int]:
    """Applies merges to symbols until none is left."""
    n = len(symbols)
    if n < 2:
        return symbols
    none = 1 << 62
    size = 1 << (n - 2).bit_length() if n > 2 else 1
    tree = [none] * (2 * size)
    get = merges.get
    for i in range(n - 1):
        m = get(symbols[i] << 32 | symbols[i + 1])
        if m:
            tree[size + i] = m[0] << 32 | i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(i: int, value: int) -> None:
        k = size + i
        if tree[k] == value:
            return
        tree[k] = value
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            low = a if a < b else b
            if tree[k] == low:
                return
            tree[k] = low
            k >>= 1

    while (root := tree[1]) < none:
        i = root & 0xFFFFFFFF
        j = after[i]
        symbols[i] = get(symbols[i] << 32 | symbols[j])[1]
        k = after[j]
        after[i] = k
        if j < n - 1:
            put(j, none)
        symbols[j] = -1
        if k < n:
            before[k] = i
            m = get(symbols[i] << 32 | symbols[k])
            put(i, m[0] << 32 | i if m else none)
        else:
            put(i, none)
        h = before[i]
        if h >= 0:
            m = get(symbols[h] << 32 | symbols[i])
            put(h, m[0] << 32 | h if m else none)
    return [s for s in symbols if s >= 0]


class Forest:
    """Segment trees of many short pieces at once, one row of an array per piece: each step merges at every root."""

    NONE = 1 << 62

    def __init__(self, vocabulary: Vocabulary):
        keys = np.array(sorted(vocabulary.merges), dtype=np.int64)
        self.keys = np.append(keys, self.NONE)
        self.ranks = np.array([vocabulary.merges[k][0] for k in keys.tolist()] + [-1], dtype=np.int64)
        self.merged = np.zeros(len(keys) + 1, dtype=np.int64)
        self.merged[self.ranks[:-1]] = [vocabulary.merges[k][1] for k in keys.tolist()]
        self.byte_ids = np.array(vocabulary.byte_ids, dtype=np.int64)

    def leaves(self, left: np.ndarray, right: np.ndarray, place: np.ndarray, ok: np.ndarray) -> np.ndarray:
        """(rank, place) of pairs as one number, NONE where they don't merge."""
        pair = left << 32 | right
        at = np.searchsorted(self.keys, pair)
        hit = ok & (self.keys[at] == pair)
        return np.where(hit, self.ranks[at] << 8 | place, self.NONE)

    def __call__(self, pieces: list[bytes]) -> list[bytes]:
        """Ids, as bytes, of each piece of at most 65 bytes."""
        out = [b""] * len(pieces)
        length = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        low = 0
        for size in (1, 4, 8, 16, 32, 64):
            at = np.flatnonzero((length > low) & (length <= size + 1))
            low = size + 1
            for k in range(0, len(at), 8192):
                part = at[k : k + 8192]
                for i, ids in zip(part.tolist(), self.rows([pieces[i] for i in part.tolist()], length[part], size), strict=True):
                    out[i] = ids
        return out

    def rows(self, pieces: list[bytes], n: np.ndarray, size: int) -> list[bytes]:
        w, wide, depth = len(pieces), size + 1, size.bit_length() - 1
        symbol = self.byte_ids[np.frombuffer(b"".join(p.ljust(wide, b"\0") for p in pieces), dtype=np.uint8)].reshape(w, wide)
        place = np.arange(wide)
        symbol[place[None, :] >= n[:, None]] = -1
        tree = np.full((w, 2 * size), self.NONE, dtype=np.int64)
        tree[:, size:] = self.leaves(symbol[:, :-1], symbol[:, 1:], place[None, :-1], symbol[:, 1:] >= 0)
        s = size
        while s > 1:
            tree[:, s // 2 : s] = np.minimum(tree[:, s : 2 * s : 2], tree[:, s + 1 : 2 * s : 2])
            s //= 2
        after, before = np.tile(place + 1, (w, 1)).ravel(), np.tile(place - 1, (w, 1)).ravel()
        flat, nodes = symbol.ravel(), tree.ravel()

        def put(rows: np.ndarray, leaf: np.ndarray, value) -> None:
            base = rows * (2 * size)
            k = size + leaf
            nodes[base + k] = value
            for _ in range(depth):
                k >>= 1
                nodes[base + k] = np.minimum(nodes[base + 2 * k], nodes[base + 2 * k + 1])

        active = np.arange(w)
        while len(active):
            root = nodes[active * (2 * size) + 1]
            more = root < self.NONE
            active, root = active[more], root[more]
            if not len(active):
                break
            base, i = active * wide, root & 255
            new = self.merged[root >> 8]
            j = after[base + i]
            k = np.where(j < wide, after[np.minimum(base + j, len(after) - 1)], wide)
            flat[base + i], flat[base + j], after[base + i] = new, -1, k
            right = k < n[active]
            before[(base + k)[right]] = i[right]
            put(active, i, self.leaves(new, np.where(right, flat[np.minimum(base + k, len(flat) - 1)], 0), i, right))
            inner = j < size
            put(active[inner], j[inner], self.NONE)
            h = before[base + i]
            left = h >= 0
            put(active[left], h[left], self.leaves(flat[(base + h)[left]], new[left], h[left], left[left]))
        kept = symbol >= 0
        ends = np.cumsum(kept.sum(1)) * 4
        ids = symbol[kept].astype("<u4").tobytes()
        return [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.forest = Forest(vocabulary)
        self.find = regex.compile(PATTERN).findall
        self.split = regex.compile("(" + "|".join(map(regex.escape, vocabulary.special)) + ")").split if vocabulary.special else lambda t: [t]
        self.cache: dict[str, bytes] = {}

    def learn(self, pieces: set[str]) -> dict[str, bytes]:
        """Ids of pieces that the cache lacks. Long ones are merged alone and not kept."""
        if len(self.cache) > CACHE:
            self.cache.clear()
        short = [p for p in pieces if len(p) <= LONGEST_CACHED // 4]
        self.cache.update(zip(short, self.forest([p.encode() for p in short]), strict=True))
        return {p: array("I", merge([self.v.byte_ids[b] for b in p.encode()], self.v.merges)).tobytes() for p in pieces if len(p) > LONGEST_CACHED // 4}

    def plain(self, texts: list[str]) -> list[bytes]:
        found = [self.find(t) for t in texts]
        new: set[str] = set()
        for pieces in found:
            new.update(pieces)
        if len(self.cache) > CACHE:
            self.cache.clear()
        long = self.learn(new.difference(self.cache))
        get = self.cache.get
        return [b"".join([get(p) or long[p] for p in pieces]) for pieces in found]

    def many(self, texts: list[str]) -> list[bytes]:
        special = self.v.special
        if not any(s in t for t in texts for s in special):
            return self.plain(texts)
        parts = [[x for x in self.split(t) if x] for t in texts]
        words = iter(self.plain([x for p in parts for x in p if x not in special]))
        return [b"".join(array("I", [special[x]]).tobytes() if x in special else next(words) for x in p) for p in parts]

    def __call__(self, text: str) -> bytes:
        return self.many([text])[0]


def decode_bytes(ids: bytes, vocabulary: Vocabulary) -> str:
    return b"".join(map(vocabulary.bytes_of.__getitem__, array("I", ids))).decode("utf-8", "replace")


def encode(df: DataFrame, vocabulary: Vocabulary, text: str = "text", out: str = "ids", keep: list[str] | None = None) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    def make():
        enc = Encoder(shared.value)
        return lambda texts: [enc.many([t or "" for t in texts])]

    return common.scan(df, keep or [c for c in df.columns if c != out], [text], [T.StructField(out, T.BinaryType())], make)


def decode(df: DataFrame, vocabulary: Vocabulary, ids: str = "ids", out: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    def make():
        v = shared.value
        return lambda rows: [[decode_bytes(x or b"", v) for x in rows]]

    return common.scan(df, keep or [c for c in df.columns if c != out], [ids], [T.StructField(out, T.StringType())], make)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    v = Vocabulary(path or tokenizer_path())
    both = decode(encode(docs, v, keep=["doc_id"]), v, keep=["doc_id", "ids"])
    return both.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(common.table(spark, sf_dir, "documents"))
