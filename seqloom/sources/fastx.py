"""FASTA and FASTQ: scans, streams and writers.

`read_fasta_split` and `stream_fasta` split files by Spark's text reader, as every record begins at a delimiter, so one large plain file is read
by many tasks. FASTQ has no such delimiter: `read_fastx` reads its lines twice, first to learn how many lines of a record each split begins with.
Other files that `read_fastx` and `stream_fastx` meet go through binary files, one task a file, parsed as a stream of lines.
"""

from __future__ import annotations

import gzip
import io
import re
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.nucleotide import name_suffix_trimmed
from ..session import bounded_batches

RECORD = "name string, comment string, seq string, qual string"


def _named(h: str) -> tuple[str, str | None]:
    """(name, comment) of a record's first line."""
    name, _, comment = h[1:].strip().partition(" ")
    if "\t" in name:
        name, _, comment = h[1:].strip().partition("\t")
    return name, comment.strip() or None


def parse_records(lines: Iterator[str], strict: bool = False) -> Iterator[tuple[str, str | None, str, str | None]]:
    """Records of FASTA or FASTQ text, told by the first character.

    Carriage returns and blank lines are dropped. strict: FASTQ records without `+` or with lengths that differ are dropped. Anything before
    the first record is an error.
    """
    it = (x.rstrip("\r\n") for x in lines)
    head = next((x for x in it if x), None)
    if head is None:
        return
    if head[0] not in ">@":
        raise ValueError("neither FASTA nor FASTQ")

    if head[0] == ">":
        parts: list[str] = []
        for x in it:
            if x[:1] == ">":
                yield (*_named(head), "".join(parts).translate(str.maketrans("Uu", "Tt")), None)
                head, parts = x, []
            else:
                parts.append("".join(x.split()))
        yield (*_named(head), "".join(parts).translate(str.maketrans("Uu", "Tt")), None)
        return
    while head is not None:
        if head[:1] == "@":
            seq, plus, qual = (next(it, "") for _ in range(3))
            if not strict or (plus[:1] == "+" and len(seq) == len(qual)):
                yield (*_named(head), seq.translate(str.maketrans("Uu", "Tt")), qual or None)
        head = next(it, None)


def _text_of(content: bytes) -> Iterator[str]:
    raw = io.BytesIO(content)
    return io.TextIOWrapper(gzip.GzipFile(fileobj=raw) if content[:2] == b"\x1f\x8b" else raw, encoding="latin-1")


def _parse_files(strict: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows):
            cols = [pa.array(c, pa.string()) for c in list(zip(*rows, strict=True))[:4]]
            return pa.RecordBatch.from_arrays([*cols, pa.array([r[4] for r in rows], pa.int64()), pa.array([r[5] for r in rows], pa.string())], names=["name", "comment", "seq", "qual", "ordinal", "file"])

        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows = []
                for n, r in enumerate(parse_records(_text_of(content.as_py()), strict)):
                    rows.append((*r, n, path))
                    if len(rows) == 1000:
                        yield out(rows)
                        rows = []
                if rows:
                    yield out(rows)

    return run


Split = tuple[str, int, int]


def _records_in(at: np.ndarray, p: int) -> tuple[np.ndarray, int]:
    """(places where records begin, lines read of the one that is open at the end) of lines; at: which begin with @; p: lines read of the record that is open before them.

    A record is a line that begins with @ and the next three; other lines before one are passed over, as parse_records does.
    """
    i, n, found = (4 - p) % 4, len(at), []
    while i < n:
        if not at[i]:
            i += int(at[i:].argmax())
            if not at[i]:
                return (np.concatenate(found) if found else np.zeros(0, int)), 0
        run = at[i::4]
        k = int(run.argmin())
        k = len(run) if run[k] else k
        found.append(i + 4 * np.arange(k))
        i += 4 * k
    return (np.concatenate(found) if found else np.zeros(0, int)), (4 - (i - n)) % 4


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Split, pa.Array, np.ndarray, np.ndarray]]:
    """(split, its next lines, their first bytes or 0, their lengths) of rows (file, start, size, line), which come in order."""
    for b in batches:
        file, start = b.column(0).dictionary_encode().indices.to_numpy(), b.column(1).to_numpy()
        cuts = [0, *(np.flatnonzero((file[1:] != file[:-1]) | (start[1:] != start[:-1])) + 1).tolist(), b.num_rows]
        for a, z in zip(cuts, cuts[1:], strict=False):
            if a < z:
                lines = b.column(3).slice(a, z - a)
                offsets = np.frombuffer(lines.buffers()[1], np.int64 if pa.types.is_large_binary(lines.type) else np.int32)[lines.offset : lines.offset + z - a + 1]
                content = np.frombuffer(lines.buffers()[2] or b"", np.uint8)
                size = np.diff(offsets)
                first = np.zeros(z - a, np.uint8)
                first[size > 0] = content[offsets[:-1][size > 0]]
                yield (b.column(0)[a].as_py(), b.column(1)[a].as_py(), b.column(2)[a].as_py()), lines, first, size


def _valid(lines: list[tuple[int, int]]) -> bool:
    """Whether four lines (first byte, length) have the plus sign and as many qualities as bases."""
    return len(lines) == 4 and lines[2][0] == 43 and lines[1][1] == lines[3][1]


SURVEY = "file string, start long, size long, kind int, heads array<binary>, walks array<struct<records: long, open: int, own: boolean, rest: array<struct<byte: int, length: int>>>>"


def _survey(strict: bool):
    """A row for each split: the first byte of its first line that is not empty, its first three lines, and what comes of it after 0 to 3 lines of an open record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "start", "size", "kind", "heads", "walks"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.binary()), pa.list_(pa.struct([("records", pa.int64()), ("open", pa.int32()), ("own", pa.bool_()), ("rest", pa.list_(pa.struct([("byte", pa.int32()), ("length", pa.int32())])))]))]

        def row(key: Split) -> pa.RecordBatch:
            said = [{"records": n, "open": p, "own": own, "rest": [{"byte": b, "length": k} for b, k in rest]} for n, p, own, rest in walks]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*key, kind, heads, said), kinds, strict=True)], names=names)

        now = None
        for key, lines, first, size in _by_split(batches):
            if key != now:
                if now:
                    yield row(now)
                now, kind, heads, walks = key, 0, [], [[0, p, False, []] for p in range(4)]
            heads += lines.slice(0, 3 - len(heads)).to_pylist()
            kind = kind or int(first[np.flatnonzero(first)[:1]].sum())
            at = first == 64
            for w in walks:
                before = w[1]
                starts, w[1] = _records_in(at, before)
                if not strict:
                    w[0] += len(starts)
                elif w[2] and before:
                    w[3] += list(zip(first[: 4 - before].tolist(), size[: 4 - before].tolist(), strict=True))
                    w[0] += _valid(w[3])
                if strict:
                    whole = starts[starts + 4 <= len(at)]
                    w[0] += int(((first[whole + 2] == 43) & (size[whole + 1] == size[whole + 3])).sum())
                if len(starts):
                    w[2], w[3] = w[1] > 0, list(zip(first[starts[-1] :].tolist(), size[starts[-1] :].tolist(), strict=True)) if w[1] else []
        if now:
            yield row(now)

    return run


def _settle(splits: list, strict: bool) -> dict[Split, tuple[int, int, list[bytes]]]:
    """{split: (lines that belong to the record before, number of its first record, lines that its last record has in later splits)} of a file's splits in order."""
    out, p, number, owner, rest = {}, 0, 0, None, []
    for x in splits:
        key = (x["file"], x["start"], x["size"])
        walk = x["walks"][p]
        if p:
            lines = [bytes(v) for v in x["heads"][: 4 - p]]
            out[owner][2].extend(lines)
            rest = rest + [(v[0] if v else 0, len(v)) for v in lines]
            number += strict and _valid(rest)
        out[key] = ((4 - p) % 4, number, [])
        number += walk["records"]
        p = walk["open"]
        if p and walk["own"]:
            owner, rest = key, [(r["byte"], r["length"]) for r in walk["rest"]]
    return out


def _parse_splits(known: dict[Split, tuple[int, int, list[bytes]]], paths: dict[str, str], strict: bool):
    uracil = bytes.maketrans(b"Uu", b"Tt")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(lines: list[bytes], starts: np.ndarray) -> pa.RecordBatch | None:
            nonlocal number
            rows = []
            for i in starts.tolist():
                head, seq, plus, qual = (lines[i : i + 4] + [b""] * 3)[:4]
                if not strict or (plus[:1] == b"+" and len(seq) == len(qual)):
                    rows.append((*_named(head.decode("latin-1")), seq.translate(uracil).decode("latin-1"), qual.decode("latin-1") or None))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 4
            numbers = pa.array(np.arange(number, number + len(rows)), pa.int64())
            number += len(rows)
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns), numbers, pa.repeat(pa.scalar(paths[now[0]]), len(rows))], names=["name", "comment", "seq", "qual", "ordinal", "file"])

        now, left, number = None, [], 0
        for key, lines, _, _ in _by_split(batches):
            if key != now:
                if left:
                    yield out(left + known[now][2], np.array([0]))
                now, left = key, []
                skip, number, _ = known[key]
            rest = left + lines.to_pylist()
            gone = min(skip, len(rest))
            rest, skip = rest[gone:], skip - gone
            starts, opened = _records_in(np.array([x[:1] == b"@" for x in rest], bool), 0)
            left = rest[starts[-1] :] if opened else []
            if len(starts) > bool(opened):
                yield out(rest, starts[: len(starts) - bool(opened)])
        if left:
            yield out(left + known[now][2], np.array([0]))

    return run


FILE_RECORD = f"{RECORD}, ordinal long, file string"


def read_fastx(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """(name, comment, seq, qual, ordinal, file) of FASTA or FASTQ files, plain or gzip by their first bytes.

    FASTQ files, plain or named .gz, are read line by line, plain ones by many tasks; one job looks at all files first, and of each split the first
    lines and a few numbers come to the driver. Others are a row each on the way to their parser, of 2 GB at most.
    """
    bounded_batches(spark)
    binary = spark.read.format("binaryFile")
    lines = lambda where: spark.read.text(where).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_block_length").alias("size"), F.col("value").cast("binary").alias("line"))
    found: dict[str, list] = {}
    for r in sorted(lines(path).mapInArrow(_survey(strict), SURVEY).collect(), key=lambda r: r["start"]):
        found.setdefault(r["file"], []).append(r)
    fastq = [f for f, splits in found.items() if next((x["kind"] for x in splits if x["kind"]), 0) == 64]
    if not fastq:
        return binary.load(path).select("path", "content").mapInArrow(_parse_files(strict), FILE_RECORD)
    names = {r["path"].replace(":///", ":/"): r["path"] for r in binary.load(path).select("path").collect()}
    named = {f: names[unquote(f).replace(":///", ":/")] for f in found}
    known = {k: v for f in fastq for k, v in _settle(found[f], strict).items()}
    literal = lambda files: [re.sub(r"([\\\[\]{}*?])", r"\\\1", named[f]) for f in files]
    others = [f for f in found if f not in fastq]
    rows = lines(literal(fastq) if others else path).mapInArrow(_parse_splits(known, named, strict), FILE_RECORD)
    return rows.unionByName(binary.load(literal(others)).select("path", "content").mapInArrow(_parse_files(strict), FILE_RECORD)) if others else rows


def read_fasta_split(spark: SparkSession, path: str) -> DataFrame:
    """(name, comment, seq) of plain FASTA files, split among tasks at records."""
    return _fasta_records(spark.read.option("lineSep", "\n>").text(path))


def _fasta_records(texts: DataFrame) -> DataFrame:
    """(name, comment, seq) of texts(value) cut before each record."""
    records = texts.select(F.regexp_replace("value", "^>", "").alias("r")).where("r <> ''")
    head = F.substring_index("r", "\n", 1)
    seq = F.translate(F.regexp_replace(F.substring(F.col("r"), F.length(head) + 1, F.length("r")), r"\s+", ""), "Uu", "Tt")
    return records.select(F.regexp_extract(head, r"^(\S*)", 1).alias("name"), F.nullif(F.trim(F.regexp_extract(head, r"^\S*\s+(.*)$", 1)), F.lit("")).alias("comment"), seq.alias("seq"))


def stream_fasta(spark: SparkSession, folder: str, files_a_trigger: int = 16) -> DataFrame:
    """A stream of the records (name, comment, seq) of the FASTA files, plain or named .gz, that arrive in a folder; plain ones are split among tasks at records."""
    return _fasta_records(spark.readStream.option("maxFilesPerTrigger", files_a_trigger).option("lineSep", "\n>").text(folder))


def stream_fastx(spark: SparkSession, folder: str, files_a_trigger: int = 16) -> DataFrame:
    """A stream of the records of the files that arrive in a folder, FASTA or FASTQ, plain or gzip by their first bytes. A file is a row of 2 GB at most until it is parsed."""
    files = spark.readStream.format("binaryFile").option("maxFilesPerTrigger", files_a_trigger).schema("path string, modificationTime timestamp, length long, content binary").load(folder).select("path", "content")
    return files.mapInArrow(_parse_files(False), FILE_RECORD)


def write_fasta(df: DataFrame, path: str) -> None:
    """One record a row of df(name, seq[, comment])."""
    comment = F.when(F.col("comment").isNotNull(), F.concat(F.lit(" "), F.col("comment"))).otherwise("") if "comment" in df.columns else F.lit("")
    df.select(F.concat(F.lit(">"), "name", comment, F.lit("\n"), "seq")).write.text(path)


def write_fastq(df: DataFrame, path: str) -> None:
    df.select(F.concat(F.lit("@"), "name", F.lit("\n"), "seq", F.lit("\n+\n"), F.coalesce("qual", F.expr("repeat('I', length(seq))")))).write.text(path)


def load_targets(records: DataFrame) -> DataFrame:
    """Records as targets: sequences in upper case, those without a name dropped."""
    return records.withColumn("seq", F.upper("seq")).where("name <> ''")


def pair_files(first: DataFrame, second: DataFrame) -> DataFrame:
    """(frag, name, seq1, seq2, same_name) of the records of two files in lock-step; what the longer one has more is dropped. Names compare without a mate's suffix."""
    a = first.select(F.col("ordinal").alias("frag"), name_suffix_trimmed(F.col("name")).alias("name"), F.col("seq").alias("seq1"))
    b = second.select(F.col("ordinal").alias("frag"), name_suffix_trimmed(F.col("name")).alias("__name"), F.col("seq").alias("seq2"))
    return a.join(b, "frag").select("frag", "name", "seq1", "seq2", (F.col("name") == F.col("__name")).alias("same_name"))


def pair_interleaved(records: DataFrame) -> DataFrame:
    """(frag, name, seq1, seq2) of interleaved records; an odd last one is dropped."""
    side = records.withColumn("frag", F.floor(F.col("ordinal") / 2)).withColumn("side", F.col("ordinal") % 2).withColumn("name", name_suffix_trimmed(F.col("name")))
    a, b = (side.where(F.col("side") == k) for k in (0, 1))
    return a.select("file", "frag", "name", F.col("seq").alias("seq1")).join(b.select("file", "frag", F.col("seq").alias("seq2")), ["file", "frag"])
