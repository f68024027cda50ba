"""Token ids as files of fixed-width packed bits.

File: MAGIC; blocks of BLOCK ids, each id in the fewest bits that hold the vocabulary and each block on a byte boundary; then a footer
of block offsets (u64), document ids (i64), flags of null ids (u8) and document starts (u64, one more than documents);
then a trailer of fixed size (bits, block size, counts, footer's place and crc32). A block unpacks at once in numpy, and a
document is read by seeking to the blocks that hold it.

Documents are dealt out by ranges of their ids and sorted within them; each partition encodes its texts and streams one file,
which gets its name only when it is complete, so a task that runs again leaves the same file. Files hold ids in ascending
order of document id, and file numbers ascend too. Null ids come first. Rows that repeat an id are ordered by a hash of their text, so that
a frequent id is dealt out over files too. Null and empty texts have only the end id. An empty table writes files without documents, or none.

With a tokenizer whose rules are those of NORMALIZER and PRE_TOKENIZER, texts are cut at spaces and line breaks, which it drops, and a batch's
different pieces into words, put in lower case, and marks after them; a worker encodes each word once. With any other, whole texts are encoded.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from codecs import charmap_decode
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, delete, materialize, shared_path, table

TOKENIZER_FILE = "word_bpe_49k.json"
END_ID = 2
BLOCK = 8192
#: A file has so many documents while there are few, or about so many bytes of text; there are at most MAX_FILES of them, which then grow.
DOCS_A_FILE, BYTES_A_FILE, MAX_FILES = 8192, 1 << 28, 20_000
#: The rules of the tokenizer file by which a text may be cut at white space.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
MAGIC = b"SEQLTOK1"
TRAILER = struct.Struct("<IIQQQQI")  # bits, block, documents, ids, blocks, footer's place, footer's crc32
#: Words, marks and other pieces that a worker remembers.
PIECES = 800_000
#: Longer ones, in characters, are not remembered.
LONG = 64
#: Runs of ids that are gathered at once.
SLICE = 1 << 20


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    wide = np.unpackbits(ids.astype("<u4").view(np.uint8), bitorder="little").reshape(-1, 32)
    return np.packbits(wide[:, :bits], bitorder="little").tobytes()


def unpack(data: bytes, count: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count).astype("<u4")
    wide = np.zeros((count, 32), np.uint8)
    wide[:, :bits] = np.unpackbits(np.frombuffer(data, np.uint8), count=count * bits, bitorder="little").reshape(count, bits)
    return np.packbits(wide, axis=1, bitorder="little").view("<u4")[:, 0]


class Writer:
    """Streams documents' ids to one file; holds a block and the documents' starts."""

    def __init__(self, out, vocabulary: int, block: int = BLOCK) -> None:
        self.out, self.block = out, block
        self.bits = max(1, int(vocabulary - 1).bit_length())
        self.held: list[np.ndarray] = []
        self.n_held = self.total = 0
        self.at, self.offsets = len(MAGIC), []
        self.docs: list[int] = []
        self.nulls: list[int] = []
        self.starts = [0]
        out.write(MAGIC)

    def _flush(self, everything: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.empty(0, "<u4")
        end = len(ids) if everything else len(ids) - len(ids) % self.block
        for a in range(0, end, self.block):
            data = pack(ids[a : min(a + self.block, end)], self.bits)
            self.offsets.append(self.at)
            self.out.write(data)
            self.at += len(data)
        self.held, self.n_held = [ids[end:]], len(ids) - end

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.held.append(ids)
        self.n_held += len(ids)
        self.total += len(ids)
        self.starts.append(self.total)
        if self.n_held >= 16 * self.block:
            self._flush(False)

    def close(self) -> None:
        self._flush(True)
        footer = np.array(self.offsets, "<u8").tobytes() + np.array(self.docs, "<i8").tobytes() + np.array(self.nulls, np.uint8).tobytes() + np.array(self.starts, "<u8").tobytes()
        self.out.write(footer)
        self.out.write(TRAILER.pack(self.bits, self.block, len(self.docs), self.total, len(self.offsets), self.at, zlib.crc32(footer)))
        self.out.close()


class Reader:
    """Random access to one file's documents."""

    def __init__(self, source) -> None:
        self.f = source
        size = source.size()
        source.seek(0)
        if size < len(MAGIC) + TRAILER.size or source.read(len(MAGIC)) != MAGIC:
            raise ValueError("not a file of packed ids")
        source.seek(size - TRAILER.size)
        self.bits, self.block, n, self.total, blocks, at, crc = TRAILER.unpack(source.read(TRAILER.size))
        source.seek(at)
        footer = source.read(size - TRAILER.size - at)
        if zlib.crc32(footer) != crc or len(footer) != 8 * blocks + 9 * n + 8 * (n + 1):
            raise ValueError("damaged footer")
        self.offsets = np.frombuffer(footer, "<u8", blocks)
        self.docs = np.frombuffer(footer, "<i8", n, 8 * blocks)
        self.nulls = np.frombuffer(footer, np.uint8, n, 8 * blocks + 8 * n).astype(bool)
        self.starts = np.frombuffer(footer, "<u8", n + 1, 8 * blocks + 9 * n).astype(np.int64)
        self._last: tuple[int, np.ndarray] = (-1, np.empty(0, "<u4"))

    def _block(self, k: int) -> np.ndarray:
        if self._last[0] != k:
            count = min(self.block, self.total - k * self.block)
            self.f.seek(int(self.offsets[k]))
            self._last = (k, unpack(self.f.read((count * self.bits + 7) // 8), count, self.bits))
        return self._last[1]

    def ids(self, start: int, end: int) -> np.ndarray:
        parts = [self._block(k)[max(0, start - k * self.block) : end - k * self.block] for k in range(start // self.block, -(-end // self.block))]
        return np.concatenate(parts) if parts else np.empty(0, "<u4")

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


#: Letters whose lower case is as long and of this class too, and marks of which any number after a word is one pre-token.
_LETTERS = "".join(c for c in map(chr, range(256)) if c.isalpha() and c not in "ªºµ")
_MARKS = ".,;:!?*#$%&"
_WORD = re.compile("[a-zß-öø-ÿ]+")
_KEPT = {*range(33, 127), *range(161, 173), *range(174, 256)}
#: The character of each byte in the tokenizer's vocabulary; the space stays, as it stands between words here.
_BYTES = "".join(chr(b) if b in _KEPT or b == 32 else chr(256 + sum(x not in _KEPT for x in range(b))) for b in range(256))


def gather(pool: np.ndarray, bounds: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs `which` of a pool of runs with these bounds, one after the other, and their own bounds."""
    out = np.zeros(len(which) + 1, np.int64)
    np.cumsum(np.diff(bounds)[which], out=out[1:])
    got = np.empty(out[-1], pool.dtype)
    for a in range(0, len(which), SLICE):
        to = out[a : a + SLICE + 1]
        at = np.repeat(bounds[which[a : a + SLICE]] - to[:-1], np.diff(to))
        at += np.arange(to[0], to[-1])
        got[to[0] : to[-1]] = pool[at]
    return got, out


class PieceEncoder:
    """The tokenizers library's ids of whole texts, where its rules allow a piece between spaces at a time."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        self.by_piece = rules.get("normalizer") == NORMALIZER and rules.get("pre_tokenizer") == PRE_TOKENIZER and all(t["content"].startswith("<|") and not {" ", "\n"} & set(t["content"]) for t in rules.get("added_tokens", []))
        self.vocabulary = 1 + max(END_ID, *self.tokenizer.get_vocab().values())
        self.vocabulary = max(self.vocabulary, self.tokenizer.get_vocab_size())
        self.kind = "<u2" if self.vocabulary <= 1 << 16 else "<u4"
        self.ends_word = np.zeros(self.vocabulary, bool)
        self.of_words = Tokenizer(self.tokenizer.model)  # for words that the rules leave as they are, in the vocabulary's characters
        self.of_words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        suffix = rules["model"].get("end_of_word_suffix") or ""
        self.by_piece = self.by_piece and bool(suffix)
        self.ends_word[[i for t, i in self.tokenizer.get_vocab().items() if suffix and t.endswith(suffix)]] = True
        #: Numbers of words in lower case, marks, and pieces of any other form; number k has ids[bounds[k]:bounds[k + 1]].
        self.number: dict[str, int] = {"": 0}
        self.ids, self.bounds = np.empty(0, self.kind), np.zeros(2, np.int64)

    def _add(self, keys: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        self.number.update(zip(keys, range(len(self.bounds) - 1, len(self.bounds) - 1 + len(keys)), strict=True))
        self.bounds = np.concatenate((self.bounds, len(self.ids) + ends))
        self.ids = np.concatenate((self.ids, ids.astype(self.kind)))

    def _learn(self, new: list[str]) -> None:
        """Words are encoded as one text: each is one pre-token, whose last token has the end-of-word mark."""
        if words := list(filter(_WORD.fullmatch, new)):
            text = charmap_decode(" ".join(words).encode(), "strict", _BYTES)[0]
            ids = np.array(self.of_words.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) != len(words):
                raise ValueError("the tokenizer does not end each word once")
            self._add(words, ids, ends)
        if others := list(set(new).difference(words)):
            lists = [e.ids for e in self.tokenizer.encode_batch_fast(others, add_special_tokens=False)]
            self._add(others, np.fromiter(chain.from_iterable(lists), np.int32), np.cumsum([len(x) for x in lists]))

    def _forget(self, keys: list[str]) -> None:
        """Keep what these have."""
        keys = ["", *(k for k in keys if k and k in self.number)]
        self.ids, self.bounds = gather(self.ids, self.bounds, np.array([self.number[k] for k in keys]))
        self.number = {k: i for i, k in enumerate(keys)}

    def encode(self, texts: list[str] | pa.Array) -> Iterator[np.ndarray]:
        if not self.by_piece:
            for e in self.tokenizer.encode_batch_fast(texts if isinstance(texts, list) else texts.to_pylist(), add_special_tokens=False):
                yield np.array(e.ids, self.kind)
            return
        column = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        if column.nbytes > 1 << 29:
            column = column.cast(pa.large_string())
        cuts = pc.split_pattern(pc.replace_substring(column, "\n", " "), " ")
        pieces = cuts.flatten().dictionary_encode()
        whole = pieces.dictionary
        words, marks = pc.utf8_rtrim(whole, _MARKS), pc.utf8_ltrim(whole, _LETTERS)
        plain = pc.equal(pc.add(pc.binary_length(words), pc.binary_length(marks)), pc.binary_length(whole))  # letters, then marks
        keys = pa.concat_arrays([pc.if_else(plain, pc.utf8_lower(words), whole), pc.if_else(plain, marks, pa.scalar("", whole.type))]).dictionary_encode()
        n = len(keys.dictionary)
        names = pc.binary_join(pa.LargeListArray.from_arrays([0, n], keys.dictionary), pa.scalar(" ", whole.type))[0].as_py().split(" ")[:n]  # faster than to_pylist
        if len(self.number) >= PIECES or len(self.ids) >= 16 * PIECES:  # what these texts have recurs
            self._forget(names)
        new = [k for k in names if k not in self.number]
        if new:
            self._learn(new)
        of = np.fromiter(map(self.number.__getitem__, names), np.int64, n)[keys.indices.to_numpy()]
        ids, bounds = gather(self.ids, self.bounds, of.reshape(2, -1).T.ravel())  # of each different piece: its word's, its marks'
        ids, bounds = gather(ids, bounds[::2], pieces.indices.to_numpy())
        bounds = bounds[cuts.offsets.to_numpy()].tolist()
        for a, z in pairwise(bounds):
            yield ids[a:z]
        for k in new:
            if len(k) > LONG:
                del self.number[k]


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def tokenizer_path(name: str = TOKENIZER_FILE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


MANIFEST = "shard long, path string, n_docs long, n_ids long, bits int"


def write_token_files(df: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = END_ID, docs_a_file: int = DOCS_A_FILE, bytes_a_file: int = BYTES_A_FILE) -> DataFrame:
    """Encode whole texts and write files under folder, a URI that executors share. Returns the files' manifest, written too."""
    bounded_batches(df.sparkSession)
    path = tokenizer or tokenizer_path()
    n = df.count()
    files = -(-n // docs_a_file)
    parallel = 4 * df.sparkSession.sparkContext.defaultParallelism
    if files > parallel:
        size = int(str(df.select(F.col(f"`{text_col}`"))._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        files = min(files, max(parallel, -(-size // bytes_a_file)), MAX_FILES)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("hash"))
    rows = rows.repartitionByRange(max(1, files), "id", "hash").sortWithinPartitions("id", "hash", "text").select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(folder)
        store.create_dir(top, recursive=True)
        shard = TaskContext.get().partitionId()
        name, temporary = f"{top}/{shard:08d}.tok", f"{top}/_{shard:08d}-{uuid.uuid4().hex}"
        enc = encoder(path)
        end = np.array([end_id], enc.kind)
        try:
            out = Writer(store.open_output_stream(temporary), enc.vocabulary)
            for b in batches:
                for doc_id, ids in zip(b.column(0).to_pylist(), enc.encode(b.column(1)), strict=True):
                    out.add(doc_id, np.concatenate((ids, end)))
            out.close()
        except BaseException:
            if store.get_file_info(temporary).type == fs.FileType.File:
                store.delete_file(temporary)
            raise
        try:
            store.move(temporary, name)
        except OSError:  # another attempt at this task has put the same file there
            if store.get_file_info(name).type != fs.FileType.File:
                raise
            store.delete_file(temporary)
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((shard, pa.int64()), (f"{folder}/{shard:08d}.tok", pa.string()), (len(out.docs), pa.int64()), (out.total, pa.int64()), (out.bits, pa.int32()))], names=["shard", "path", "n_docs", "n_ids", "bits"])

    manifest = materialize(rows.mapInArrow(run, MANIFEST), "tokens-manifest")
    delete(df.sparkSession, f"{folder}/_*")  # of attempts that were lost with their executor
    return manifest


def read_token_files(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, shard) for each document, read from the files."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.where("n_docs > 0").select("shard", "path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long").alias("base"))
    n = max(1, manifest.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, path, base in zip(*(c.to_pylist() for c in b.columns), strict=True):
                store, name = fs.FileSystem.from_uri(path)
                with store.open_input_file(name) as f:
                    r = Reader(f)
                    for a in range(0, len(r.docs), 4096):
                        z = min(a + 4096, len(r.docs))
                        crc = [zlib.crc32(r.document(k).astype("<u4").tobytes()) for k in range(a, z)]
                        yield pa.RecordBatch.from_arrays([pa.array(r.docs[a:z], mask=r.nulls[a:z]), pa.array(base + r.starts[a:z]), pa.array(np.diff(r.starts[a : z + 1])), pa.array(crc, pa.int64()), pa.array(np.full(z - a, shard, np.int64))], names=["doc_id", "start", "n_tokens", "ids_crc32", "shard"])

    return files.repartition(n, "shard").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, shard long")


def query(spark, sf_dir: str) -> DataFrame:
    manifest = write_token_files(table(spark, sf_dir, "documents"), shared_path(spark, "tokens"))
    return read_token_files(manifest).drop("shard")
