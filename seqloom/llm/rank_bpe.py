"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Of a pre-token, each adjacent pair of parts that is a token is put in the bucket of its merge rank: a list of positions in
a linked list of parts. Two levels of bitmaps say which buckets have entries (a bit for each rank, a bit for each word of
64 ranks), so find-first-set gives the next rank to merge. Entries whose parts have changed since are skipped
when they come up. A pre-token of n bytes needs at most 2n entries, so very long pre-tokens take no quadratic time.

A merge never adds to its own bucket, so a bucket is taken out whole and read from left to right, unless one of its merges brings
up a lower rank: then the rest of it goes back.

The new pre-tokens of a batch of texts share one queue, with separators between them that no pair reaches over: each pre-token's merges
come up in the same order as in a queue of its own. A bucket of many positions is merged at once in numpy, with the pairs that come up
looked up in a table of pairs; a small one, or one by which a lower rank would come up, is merged position by position.

Texts are cut before single spaces, pieces of text that recur are encoded once in each worker and kept in a bounded table. Null texts
count as empty and have no tokens. Encoding has no special tokens. Decoding gives back bytes; ids that are not in the
ranks raise.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import bounded_batches, free_name, in_slices, table, without

RANKS_FILE = "byte_bpe_multi_50k.tiktoken"
#: Pieces of text, and pre-tokens, that a worker remembers.
PIECES, PRE_TOKENS = 200_000, 400_000
#: Longer ones, in characters, are not remembered.
LONG = 64
#: Buckets of so many positions are merged at once.
MANY = 64
#: Ids decoded at a time.
SLICE = 1 << 18
#: No rank; the id of what stands between pre-tokens; a pair that no tokens make.
NONE, SEPARATOR = 2**31 - 1, 2**31 - 1
_NO_PAIR = np.uint64(2**64 - 1)


class PairRanks:
    """Rank of the token that two adjacent tokens make, looked up for arrays of pairs: open addressing in numpy."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        rank_of = ranks.get
        pairs = {}
        for token, rank in ranks.items():
            for cut_at in range(1, len(token)):
                left, right = rank_of(token[:cut_at]), rank_of(token[cut_at:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        keys, values = np.array(list(pairs), np.uint64), np.array(list(pairs.values()), np.int32)
        bits = max(4, (4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.uint64((1 << bits) - 1)
        self.keys, self.values = np.full(1 << bits, _NO_PAIR, np.uint64), np.full(1 << bits, NONE, np.int32)
        at, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = todo[self.keys[at[todo]] == _NO_PAIR]
            self.keys[at[free]] = keys[free]  # of several for one slot the last stays
            got = todo[self.keys[at[todo]] == keys[todo]]
            self.values[at[got]] = values[got]
            todo = todo[self.keys[at[todo]] != keys[todo]]
            at[todo] = (at[todo] + np.uint64(1)) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        at = self._slot(keys)
        there, out = self.keys[at], self.values[at]
        todo = np.flatnonzero((there != keys) & (there != _NO_PAIR))
        while len(todo):
            at[todo] = (at[todo] + np.uint64(1)) & self.mask
            there = self.keys[at[todo]]
            out[todo] = self.values[at[todo]]
            todo = todo[(there != keys[todo]) & (there != _NO_PAIR)]
        return out


class Bpe:
    """Encoder and decoder for a table of ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.packed = {t: i.to_bytes(4, "little") for t, i in ranks.items()}
        self.split = regex.compile(pattern).findall
        self.pair_rank = PairRanks(ranks)
        self.byte_id = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        self.byte_pair = np.full((256, 256), NONE, np.int32)
        for token, rank in ranks.items():
            if len(token) == 2:
                self.byte_pair[token[0], token[1]] = rank
        size = 1 + max(ranks.values())
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.begin = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.seen: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each of the pre-tokens, which share one queue: no pair reaches over the separator between two of them."""
        rank_of, pair_rank = self.ranks.get, self.pair_rank
        data = b"\0" + b"\0".join(pieces) + b"\0"
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        gaps = np.concatenate(([0], np.cumsum(sizes + 1)))
        raw = np.frombuffer(data, np.uint8)
        n = len(raw)
        # arrays that Python reads by element and numpy by slices: a part's id, where it ends, where the one before it begins, and
        # the rank of the pair that it begins; parts merged away have rank -1
        ids, after, before, pair = (array("i", bytes(4 * n)) for _ in range(4))
        v_ids, v_after, v_before, v_pair = (np.frombuffer(x, np.int32) for x in (ids, after, before, pair))
        v_ids[:] = self.byte_id[raw]
        v_ids[gaps] = SEPARATOR
        if (v_ids < 0).any():
            raise KeyError("a byte that the ranks do not have")
        v_after[:] = np.arange(1, n + 1)
        v_before[:] = np.arange(-1, n - 1)
        v_pair[:-1] = self.byte_pair[raw[:-1], raw[1:]]
        v_pair[-1] = NONE
        v_pair[gaps] = NONE
        v_pair[gaps[1:] - 1] = NONE
        # buckets: at first runs of one array, then lists of positions
        order = np.flatnonzero(v_pair != NONE)
        order = order[np.argsort(v_pair[order], kind="stable")].astype(np.int32)
        found, starts = np.unique(v_pair[order], return_index=True)
        first = dict(zip(found.tolist(), zip(starts.tolist(), np.append(starts, len(order))[1:].tolist(), strict=True), strict=True))
        buckets: dict[int, list[int]] = {}
        words: dict[int, int] = {}  # a bit for each rank that has a bucket
        top = 0  # a bit for each word that has a bit
        for rank in first:
            words[rank >> 6] = words.get(rank >> 6, 0) | 1 << (rank & 63)
        for w in words:
            top |= 1 << w
        while top:
            w = (top & -top).bit_length() - 1
            word = words[w]
            bit = word & -word
            now = (w << 6) + bit.bit_length() - 1
            words[w] = word ^ bit
            if word == bit:
                top ^= 1 << w
            bucket = buckets.pop(now, [])
            a, z = first.pop(now, (0, 0))
            new: list[tuple[int, int]] | zip = []
            if z - a + len(bucket) >= MANY:
                at = np.concatenate((order[a:z], np.array(bucket, np.int32))) if bucket else order[a:z]
                at = at[v_pair[at] == now]  # the others are stale
                if bucket:
                    at = np.unique(at)
                if len(at):
                    done = self._merge_all(at, now, v_ids, v_after, v_before, v_pair)
                    if done is not None:
                        new, bucket = done, []
                    else:
                        bucket = at.tolist()
            elif z > a:
                bucket = [*order[a:z].tolist(), *bucket]
            if bucket:
                if len(bucket) > 1:
                    bucket.sort()
                new, left = [], 0
                for nth, i in enumerate(bucket):
                    if pair[i] != now:
                        continue  # stale
                    j = after[i]
                    k = after[j]
                    p = before[i]
                    ids[i], after[i], before[k], pair[j] = now, k, i, -1
                    rank = rank_of(data[i : after[k]]) if ids[k] != SEPARATOR else None
                    least = now
                    if rank is None:
                        pair[i] = NONE
                    else:
                        pair[i] = rank
                        new.append((rank, i))
                        if rank < least:
                            least = rank
                    rank = rank_of(data[p:k]) if ids[p] != SEPARATOR else None
                    if rank is None:
                        pair[p] = NONE
                    else:
                        pair[p] = rank
                        new.append((rank, p))
                        if rank < least:
                            least = rank
                    if least < now:  # a lower rank has come up: it goes before the rest of this bucket
                        new += [(now, q) for q in bucket[nth + 1 :]]
                        break
            for rank, i in new:
                if rank in buckets:
                    buckets[rank].append(i)
                else:
                    buckets[rank] = [i]
                    v = rank >> 6
                    words[v] = words.get(v, 0) | 1 << (rank & 63)
                    top |= 1 << v
        alive = np.flatnonzero((v_pair >= 0) & (v_ids != SEPARATOR))
        packed = v_ids[alive].astype("<u4").tobytes()
        ends = (4 * np.searchsorted(alive, gaps)).tolist()
        return [packed[a:z] for a, z in zip(ends, ends[1:], strict=False)]

    def _merge_all(self, at: np.ndarray, now: int, ids: np.ndarray, after: np.ndarray, before: np.ndarray, pair: np.ndarray):
        """Merge the pairs of rank now at all of these ascending positions; the new (rank, position). None, with nothing done, if a lower rank would come up."""
        chained = np.concatenate(([False], after[at[:-1]] == at[1:]))
        if chained.any():  # of pairs that share parts the first goes, then the third: from left to right
            place = np.arange(len(at))
            at = at[(place - np.maximum.accumulate(np.where(chained, 0, place))) % 2 == 0]
        j = after[at]
        k, p = after[j], before[at]
        beside = np.flatnonzero(p[1:] == j[:-1]) + 1  # the part before it is merged as well
        left = ids[p]
        left[beside], p[beside] = now, at[beside - 1]
        own = np.full(len(at), now, np.int32)
        ranks = self.pair_rank(np.concatenate((own, left)), np.concatenate((ids[k], own)))
        if ranks.min() < now:
            return None
        right, left = ranks[: len(at)], ranks[len(at) :]
        right[beside - 1] = left[beside]
        ids[at], after[at], before[k], pair[j] = now, k, at, -1
        pair[p] = left
        pair[at] = right
        left[beside] = NONE
        ranks, places = np.concatenate((right, left)), np.concatenate((at, p))
        some = ranks != NONE
        return zip(ranks[some].tolist(), places[some].tolist(), strict=True)

    def _learn(self, pieces: set[str]) -> None:
        """Put the ids of pieces in seen."""
        known, split, packed = self.known, self.split, self.packed
        parts = {p: split(p) for p in pieces}
        new, raw = [], []
        for t in {t for ts in parts.values() for t in ts}:
            if t not in known:
                b = t.encode()
                if b in packed:
                    known[t] = packed[b]
                else:
                    new.append(t)
                    raw.append(b)
        if new:
            known.update(zip(new, self.merge(raw), strict=True))
        join, seen = b"".join, self.seen
        for p, ts in parts.items():
            seen[p] = known[ts[0]] if len(ts) == 1 else join([known[t] for t in ts])
        for t in new:
            if len(t) > LONG:
                del known[t]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cuts = [cut(t) for t in texts]
        pieces = set().union(*cuts)
        if len(self.seen) >= PIECES:  # what these texts have recurs
            self.seen = {p: self.seen[p] for p in pieces & self.seen.keys()}
        if len(self.known) >= PRE_TOKENS:
            self.known = {}
        new = pieces.difference(self.seen)
        if new:
            self._learn(new)
        join, of = b"".join, self.seen.__getitem__
        out = [join(map(of, c)) for c in cuts]
        for p in new:
            if len(p) > LONG:
                del self.seen[p]
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> bytes:
        out = []
        all_ids = np.frombuffer(ids, "<u4")
        if len(all_ids) and (all_ids.max() >= len(self.length) or not self.length[all_ids].all()):
            raise KeyError("an id that the ranks do not have")
        for a in range(0, len(all_ids), SLICE):
            part = all_ids[a : a + SLICE]
            length = self.length[part]
            ends = np.cumsum(length)
            out.append(self.bytes[np.repeat(self.begin[part] - (ends - length), length) + np.arange(ends[-1])].tobytes())
        return b"".join(out)


_CHUNK = re.compile(r"\s*\S+|\s+")
#: White space by any of the definitions in use; the first six are the usual ones.
_GAPS = " \n\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_MARK = "\ue000"


def cut(text: str) -> list[str]:
    """Pieces of a text whose pre-tokens are the text's: cut where white space follows something else.

    No pre-token has white space after another character, and what stands after such a place has no
    bearing on the pre-tokens before it.
    """
    if not text:
        return []
    gaps = _GAPS[:10] if text.isascii() else _GAPS
    if _MARK in text or any(g + " " in text or g + "\n" in text for g in gaps):
        return _CHUNK.findall(text)
    return text.replace(" ", _MARK + " ").replace("\n", _MARK + "\n").lstrip(_MARK).split(_MARK)


@lru_cache(maxsize=2)
def bpe(path: str) -> Bpe:
    import public_tokenizers

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return Bpe(ranks, public_tokenizers.PATTERN)


def ranks_path(name: str = RANKS_FILE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_documents(df: DataFrame, text_col: str = "text", ids_col: str = "token_ids", ranks: str | None = None, decoded_col: str | None = None) -> DataFrame:
    """df with the ids of each whole text as binary: little-endian unsigned 32-bit integers. ranks: a file's path on every machine.

    With decoded_col, also the bytes that these ids stand for, by the same pass over the rows.
    """
    bounded_batches(df.sparkSession)
    path = ranks or ranks_path()
    added = [ids_col, *([decoded_col] if decoded_col else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = bpe(path)
        for b in batches:
            ids = [i for part in in_slices(b.column(b.num_columns - 1)) for i in of.encode_all(part.to_pylist())]
            out = [pa.array(ids, pa.binary()), *([pa.array([of.decode(i) for i in ids], pa.binary())] if decoded_col else [])]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *out], [*b.schema.names[:-1], *added])

    kept = without(df, *added)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias(free_name(kept.columns, "text_to_encode"))
    schema = StructType([*kept.schema.fields, *[StructField(name, BinaryType()) for name in added]])
    return df.select(*[F.col(f"`{c}`") for c in kept.columns], text).mapInArrow(run, schema)


def decode_documents(df: DataFrame, ids_col: str = "token_ids", out_col: str = "decoded", ranks: str | None = None) -> DataFrame:
    """df with the bytes that the ids stand for."""
    bounded_batches(df.sparkSession)
    path = ranks or ranks_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = bpe(path).decode
        for b in batches:
            out = pa.array([decode(i or b"") for i in b.column(b.num_columns - 1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], out], [*b.schema.names[:-1], out_col])

    kept = without(df, out_col)
    ids = F.col(f"`{ids_col}`").alias(free_name(kept.columns, "ids_to_decode"))
    return df.select(*[F.col(f"`{c}`") for c in kept.columns], ids).mapInArrow(run, StructType([*kept.schema.fields, StructField(out_col, BinaryType())]))


def digests(df: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of df(doc_id, token_ids, decoded)."""
    return df.select("doc_id", F.floor(F.length("token_ids") / 4).cast("long").alias("n_tokens"), F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("token_ids"))
    return digests(encode_documents(texts, "token_ids", decoded_col="decoded"))
