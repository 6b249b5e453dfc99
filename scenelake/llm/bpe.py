"""Byte-level BPE encoding and decoding.

A text is cut by the tokenizer's pattern and each piece is encoded alone. A
segment tree over the byte positions of a piece stores the leftmost minimum
rank of the pairs of live neighbours; its root is the next merge. A merge
changes three leaves (the merged pair, the pair to its left, the pair that went
away), and each change climbs the tree once.

Pieces of up to ``SHORT`` bytes run side by side: one tree is one row of a
matrix, and a step merges once in every row. Longer pieces have a tree each, so
the work stays n log n for a text that is a single long piece.

Defined results:
- null text is encoded as the empty text: no ids, and decodes to no bytes;
- repeated rows are encoded each for itself, an empty table gives no rows;
- further columns are not read, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import beside, in_small_batches, map_batches, map_text

SHORT = 64
#: Pieces whose ids a worker remembers.
REMEMBERED = 400_000
#: Bytes of text whose new pieces are encoded together.
SLICE = 2 << 20
_NONE = np.int64(1) << 62

# White_Space, and letters and numbers, of the first 256 code points.
_SPACE = "\t-\r \x85\xa0  -     　"
_LETTER_1 = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
_NUMBER_1 = "0-9\xb2\xb3\xb9\xbc-\xbe"
_SPACE_1 = "\t-\r \x85\xa0"


def explicit(pattern: str, space: str, letter: str | None = None, number: str | None = None) -> str:
    """The pattern with its classes spelt out, as the engines differ on them."""
    for name, inside in ((r"\p{L}", letter), (r"\p{N}", number), (r"\s", space), (r"\S", None)):
        out, depth, i = [], 0, 0
        while i < len(pattern):
            if pattern.startswith(name, i) and (inside is not None or name == r"\S"):
                out.append(f"[^{space}]" if name == r"\S" else inside if depth else f"[{inside}]")
                i += len(name)
                continue
            if pattern[i] == "\\":
                out.append(pattern[i : i + 2])
                i += 2
                continue
            depth += {"[": 1, "]": -1}.get(pattern[i], 0)
            out.append(pattern[i])
            i += 1
        pattern = "".join(out)
    return pattern


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class ByteBPE:
    """Encoder and decoder for one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.ints = list(range(len(self.tokens)))
        self.digits = [str(i) for i in self.ints]
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        keys = np.array(sorted(pairs), np.int64)
        self.keys = np.append(keys, np.iinfo(np.int64).max)
        self.values = np.append(np.array([pairs[k] for k in keys.tolist()], np.int64), _NONE)
        self.split_any = regex.compile(explicit(pattern, _SPACE)).findall
        self.split_latin = re.compile(explicit(pattern, _SPACE_1, _LETTER_1, _NUMBER_1)).findall
        self.known: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def pieces(self, text: str) -> list[str]:
        """The matches of the pattern."""
        if text.isascii() or max(text) < "Ā":
            return self.split_latin(text)
        return self.split_any(text)

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.values[at], _NONE)

    def _rank_of(self, key: int) -> int:
        at = int(self.keys.searchsorted(key))
        return int(self.values[at]) if self.keys[at] == key else 1 << 62

    def encode_long(self, piece: bytes) -> tuple[int, ...]:
        """One piece, with a tree of its own."""
        n = len(piece)
        size = 1 << max(0, (n - 1).bit_length())
        ids = self.of_byte[np.frombuffer(piece, np.uint8)]
        tree = [(1 << 62, 0)] * (2 * size)
        first = self._pair_ranks(ids[:-1], ids[1:]).tolist()
        ids = ids.tolist()
        tree[size : size + n - 1] = [(r, i) for i, r in enumerate(first)]
        for node in range(size - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        none = 1 << 62

        def put(at: int, rank: int) -> None:
            node = size + at
            tree[node] = (rank, at)
            node >>= 1
            while node:
                a, b = tree[2 * node], tree[2 * node + 1]
                best = a if a <= b else b
                if tree[node] == best:
                    break
                tree[node] = best
                node >>= 1

        while n > 1:
            rank, at = tree[1]
            if rank == none:
                break
            gone = after[at]
            beyond = after[gone]
            ids[at] = rank
            ids[gone] = -1
            after[at] = beyond
            put(gone, none)
            if beyond < n:
                before[beyond] = at
                put(at, self._rank_of(rank << 32 | ids[beyond]))
            else:
                put(at, none)
            left = before[at]
            if left >= 0:
                put(left, self._rank_of(ids[left] << 32 | rank))
        return tuple(i for i in ids if i >= 0)

    def encode_short(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Many pieces of 2 to ``SHORT`` bytes, a row of trees for each width."""
        out: list = [None] * len(pieces)
        widths: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            widths.setdefault(1 << (len(piece) - 1).bit_length(), []).append(i)
        for width, places in widths.items():
            rows = np.frombuffer(b"".join(pieces[i].ljust(width, b"\0") for i in places), np.uint8)
            lengths = np.array([len(pieces[i]) for i in places])
            for i, ids in zip(places, self._encode_rows(rows.reshape(-1, width), lengths)):
                out[i] = ids
        return out

    def _encode_rows(self, rows: np.ndarray, lengths: np.ndarray) -> list[tuple[int, ...]]:
        n, width = rows.shape
        ids = self.of_byte[rows]
        ids[np.arange(width) >= lengths[:, None]] = -1
        # A leaf holds rank * width + position, so the minimum is the leftmost one.
        tree = np.full((n, 2 * width), _NONE, np.int64)
        pair = self._pair_ranks(ids[:, :-1], ids[:, 1:])
        pair[(ids[:, 1:] < 0)] = _NONE
        tree[:, width : 2 * width - 1] = np.where(pair < _NONE, pair * width + np.arange(width - 1), _NONE)
        node = width
        while node > 1:
            tree[:, node // 2 : node] = np.minimum(tree[:, node : 2 * node : 2], tree[:, node + 1 : 2 * node : 2])
            node //= 2
        after = np.tile(np.arange(1, width + 2), (n, 1))
        before = np.tile(np.arange(-1, width), (n, 1))
        live = np.arange(n)

        def put(row: np.ndarray, at: np.ndarray, rank: np.ndarray) -> None:
            node = at + width
            tree[row, node] = np.where(rank < _NONE, rank * width + at, _NONE)
            node = node >> 1
            while node[0]:
                tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])
                node = node >> 1

        while True:
            root = tree[live, 1]
            more = root < _NONE
            live, root = live[more], root[more]
            if not live.size:
                break
            at, rank = root % width, root // width
            gone = after[live, at]
            beyond = after[live, gone]
            ids[live, at] = rank
            ids[live, gone] = -1
            after[live, at] = beyond
            put(live, gone, np.full(live.size, _NONE))
            inside = beyond < lengths[live]
            right = ids[live, np.minimum(beyond, width - 1)]
            before[live[inside], beyond[inside]] = at[inside]
            put(live, at, np.where(inside, self._pair_ranks(rank, np.where(inside, right, 0)), _NONE))
            left = before[live, at]
            has = left >= 0
            if has.any():
                row, left = live[has], left[has]
                put(row, left, self._pair_ranks(ids[row, left], rank[has]))
        return [tuple(self.ints[x] for x in row if x >= 0) for row in ids.tolist()]

    def learn(self, pieces: set[str]) -> None:
        """Encode the pieces that are not remembered.

        What is remembered has two generations: when the young one is half of
        all, it becomes the old one, from which pieces in use are taken over.
        """
        if len(self.known) > REMEMBERED // 2:
            self.old, self.known = self.known, {}
        known, old = self.known, self.old
        short, names = [], []
        for piece in pieces:
            if piece in known:
                continue
            if piece in old:
                known[piece] = old[piece]
                continue
            raw = piece.encode()
            rank = self.ranks.get(raw)
            if rank is not None:
                known[piece] = (self.ints[rank],)
            elif len(raw) > SHORT:
                known[piece] = self.encode_long(raw)
            else:
                short.append(raw)
                names.append(piece)
        known.update(zip(names, self.encode_short(short)))

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        """The ids of each text."""
        cut = [self.pieces(text) if text else [] for text in texts]
        self.learn(set(chain.from_iterable(cut)))
        known = self.known.__getitem__
        return [list(chain.from_iterable(map(known, pieces))) for pieces in cut]

    def decode(self, ids) -> bytes:
        """The bytes of ids."""
        return b"".join(map(self.tokens.__getitem__, ids))


_loaded: dict = {}


def tokenizer(path: str, pattern: str) -> ByteBPE:
    """The tokenizer of a vocabulary file, kept while a worker lives."""
    if _loaded.get("key") != (path, pattern):
        _loaded.update(key=(path, pattern), bpe=ByteBPE(load_ranks(path), pattern))
    return _loaded["bpe"]


def public_vocabulary(name: str = "byte_bpe_50k.tiktoken") -> tuple[str, str]:
    """Path and pattern of an installed public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def encode(
    documents: DataFrame, keep: list[str], text_col: str = "text", path: str | None = None, pattern: str | None = None
) -> DataFrame:
    """``keep`` columns and ``token_ids`` (array of int), a row for each input row.

    ``path`` names the vocabulary on every executor; by default the public one.
    """
    path, pattern = (path, pattern) if path else public_vocabulary()

    def start():
        bpe = tokenizer(path, pattern)

        def work(texts: list) -> list[pa.Array]:
            return [pa.array(bpe.encode_batch(texts), pa.list_(pa.int32()))]

        return work

    return map_text(documents, keep, text_col, "token_ids array<int>", start, SLICE)


def decode(
    tokens: DataFrame, keep: list[str], ids_col: str = "token_ids", path: str | None = None, pattern: str | None = None
) -> DataFrame:
    """``keep`` columns and ``decoded`` (binary); null ids decode to no bytes."""
    path, pattern = (path, pattern) if path else public_vocabulary()
    names = [f"__k{i}" for i in range(len(keep))]
    narrow = tokens.select(*[F.col(c).alias(n) for c, n in zip(keep, names)], F.col(ids_col).alias("__ids"))
    schema = type(narrow.schema)(narrow.schema.fields[:-1]).add("decoded", "binary")

    def run(batches):
        bpe = tokenizer(path, pattern)
        for batch in batches:
            texts = [bpe.decode(ids or ()) for ids in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(texts, pa.binary())], names=schema.names
            )

    return in_small_batches(map_batches(narrow, run, schema)).toDF(*keep, *beside(keep, ["decoded"]))


def round_trip(
    documents: DataFrame,
    keep: list[str],
    text_col: str = "text",
    path: str | None = None,
    pattern: str | None = None,
    with_ids: bool = False,
) -> DataFrame:
    """``keep`` columns, ``n_tokens``, the digests of the ids and of the bytes they decode to, and ``token_ids`` if asked."""
    path, pattern = (path, pattern) if path else public_vocabulary()

    def start():
        bpe = tokenizer(path, pattern)

        def work(texts: list) -> list[pa.Array]:
            n, ids_sha, decoded_sha = [], [], []
            encoded = bpe.encode_batch(texts)
            for ids in encoded:
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(" ".join(map(bpe.digits.__getitem__, ids)).encode()).hexdigest())
                decoded_sha.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            out = [pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())]
            return [*out, pa.array(encoded, pa.list_(pa.int32()))] if with_ids else out

        return work

    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * with_ids
    return map_text(documents, keep, text_col, schema, start, SLICE)


def op2_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Contract query: encode and decode every whole document."""
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])
