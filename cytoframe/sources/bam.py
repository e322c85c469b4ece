"""BAM as a source and sink of Spark: blocks of a file are dealt to tasks by byte range, records are decoded in plain Python.

A blocked file is a chain of compressed blocks, each with its own size in its header. A task looks for the first block at or after the start of its range and for the first
record that begins in it, and takes all records that begin in blocks of its range; the last one may end beyond it. A record's start inside a block isn't marked: a place is taken for one if a chain of
plausible records begins there. Files are opened by path, so they must lie where all executors see them. A file that is one plain gzip stream is one task's.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

OPS, BASES = "MIDNSHP=X", "=ACMGRSVTWYHKDBN"
PAIRS = [a + b for a in BASES for b in BASES]
TURN = str.maketrans("ACGT", "TGCA")
#: Bytes of a split, of a block's content when writing, and the largest block.
SPLIT, CONTENT, BLOCK = 64 << 20, 65280, 1 << 16
#: Records that must follow each other for a place to count as a record's start.
CHAIN = 4
#: Rows of a batch.
ROWS = 10_000
#: Formats of numbers in tags.
NUMBERS = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}
SCHEMA = "qname string, flag int, chrom string, pos long, strand string, cigar string, seq string, tags map<string,string>"
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def block_size(head: bytes) -> int | None:
    """Size of the block that begins so; None if no block of a chain does."""
    if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04":
        return None
    (extra,) = struct.unpack_from("<H", head, 10)
    at = 12
    while at + 4 <= min(12 + extra, len(head)):
        (n,) = struct.unpack_from("<H", head, at + 2)
        if head[at : at + 2] == b"BC" and n == 2:
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + n
    return None


class Blocks:
    """Inflated content of a file from a block on: ``data``, grown block by block, and for each block its place in the file and in ``data``."""

    def __init__(self, file, start: int):
        self.file, self.next, self.data, self.starts = file, start, bytearray(), []

    def more(self) -> bool:
        self.file.seek(self.next)
        head = self.file.read(BLOCK)
        size = block_size(head)
        if size is None or len(head) < size:
            return False
        content = zlib.decompress(head[:size], 31)
        self.starts.append((self.next, len(self.data)))
        self.data += content
        self.next += size
        return True

    def need(self, upto: int) -> bool:
        while len(self.data) < upto:
            if not self.more():
                return False
        return True

    def block_of(self, at: int) -> int:
        """Place in the file of the block that holds a place of ``data``."""
        found = self.starts[0][0]
        for place, begin in self.starts:
            if begin > at:
                break
            found = place
        return found

    def forget(self, at: int) -> None:
        """Drop what lies before a place of ``data``, which becomes place 0."""
        del self.data[:at]
        self.starts = [(p, b - at) for p, b in self.starts]
        while len(self.starts) > 1 and self.starts[1][1] <= 0:
            self.starts.pop(0)


def header(b: Blocks) -> tuple[list[str], int]:
    """Names of references, and the place after the header."""
    if not b.need(12) or b.data[:4] != b"BAM\1":
        raise ValueError("not a BAM file")
    at = 8 + struct.unpack_from("<i", b.data, 4)[0]
    b.need(at + 4)
    (n,) = struct.unpack_from("<i", b.data, at)
    at += 4
    names = []
    for _ in range(n):
        b.need(at + 4)
        (size,) = struct.unpack_from("<i", b.data, at)
        b.need(at + 8 + size)
        names.append(b.data[at + 4 : at + 3 + size].decode())
        at += 8 + size
    return names, at


def plausible(b: Blocks, at: int, references: int) -> int | None:
    """The end of a record that may begin at a place, or None."""
    if not b.need(at + 36):
        return None
    size, tid, pos, name, _, _, ops, _, length, mate, mate_pos, _ = struct.unpack_from("<iiiBBHHHiiii", b.data, at)
    least = 32 + name + 4 * ops + (length + 1) // 2 + length
    if not (-1 <= tid < references and -1 <= mate < references and pos >= -1 and mate_pos >= -1 and name > 1 and length >= 0 and least <= size < 1 << 26):
        return None
    b.need(at + 36 + name)
    text = b.data[at + 36 : at + 36 + name]
    return at + 4 + size if len(text) == name and text[-1] == 0 and all(33 <= c <= 126 for c in text[:-1]) else None


def first_record(b: Blocks, references: int) -> int | None:
    """Place of the first record that begins in what ``b`` holds, by a chain of plausible ones."""
    at = 0
    while at < len(b.data) or b.more():
        end, found = at, 0
        while found < CHAIN:
            upto = plausible(b, end, references)
            if upto is None:
                break
            found, end = found + 1, upto
            if not b.need(end + 4):  # the file ends with this record
                found = CHAIN if len(b.data) == end else found
                break
        if found == CHAIN:
            return at
        at += 1
    return None


def tag_text(data: bytearray, at: int, end: int) -> dict[str, str]:
    """Tags as text, as they are written in SAM; arrays without their kind."""
    out = {}
    while at + 3 <= end:
        name, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        if kind in "ZH":
            stop = data.index(0, at)
            out[name], at = data[at:stop].decode(errors="replace"), stop + 1
        elif kind == "A":
            out[name], at = chr(data[at]), at + 1
        elif kind == "B":
            sub = NUMBERS[chr(data[at])]
            (n,) = struct.unpack_from("<i", data, at + 1)
            out[name] = ",".join(map(str, struct.unpack_from(f"<{n}{sub}", data, at + 5)))
            at += 5 + n * struct.calcsize(sub)
        else:
            sub = NUMBERS[kind]
            out[name], at = str(struct.unpack_from(f"<{sub}", data, at)[0]), at + struct.calcsize(sub)
    return out


def record(data: bytearray, at: int, names: list[str]) -> tuple | None:
    """A mapped record as a row; minus reads in reading direction."""
    size, tid, pos, name_size, _, _, n_ops, flag, length = struct.unpack_from("<iiiBBHHHi", data, at)
    if tid < 0:
        return None
    p = at + 36
    name = data[p : p + name_size - 1].decode()
    p += name_size
    ops = struct.unpack_from(f"<{n_ops}I", data, p)
    p += 4 * n_ops
    half = (length + 1) // 2
    seq = "".join(map(PAIRS.__getitem__, data[p : p + half]))[:length]
    minus = bool(flag & 16)
    tags = tag_text(data, p + half + length, at + 4 + size)
    return name, flag, names[tid], pos, "-" if minus else "+", "".join(f"{o >> 4}{OPS[o & 15]}" for o in ops), seq[::-1].translate(TURN) if minus else seq, tags


@dataclass
class Part(InputPartition):
    path: str
    start: int
    stop: int
    names: list[str]
    after: int  # place after the header in the first part's content, else -1

    def __init__(self, path: str, start: int, stop: int, names: list[str], after: int):
        super().__init__((path, start))
        self.path, self.start, self.stop, self.names, self.after = path, start, stop, names, after


def rows_of(part: Part) -> Iterator[tuple]:
    """Records that begin in blocks of a part's range."""
    with open(part.path, "rb") as f:
        if part.stop < 0:
            yield from whole(f)
            return
        place = part.start
        if part.after < 0:
            f.seek(place)
            window = f.read(2 * BLOCK)
            at = window.find(b"\x1f\x8b\x08\x04")
            while at >= 0:
                size = block_size(window[at : at + 64])
                f.seek(place + at + (size or 0))
                if size and (not (follows := f.read(64)) or block_size(follows)):
                    break
                at = window.find(b"\x1f\x8b\x08\x04", at + 1)
            if at < 0 or place + at >= part.stop:
                return
            place += at
        b = Blocks(f, place)
        if not b.more():
            return
        at = part.after if part.after >= 0 else first_record(b, len(part.names))
        while at is not None and b.need(at + 4):
            if b.block_of(at) >= part.stop:
                return
            (size,) = struct.unpack_from("<i", b.data, at)
            if not b.need(at + 4 + size):
                raise ValueError(f"{part.path}: cut off")
            row = record(b.data, at, part.names)
            if row:
                yield row
            at += 4 + size
            if at > 1 << 20:
                b.forget(at)
                at = 0


def whole(f) -> Iterator[tuple]:
    """Records of a file that isn't blocked."""
    f.seek(0)
    z, data = zlib.decompressobj(31), bytearray()
    while chunk := f.read(1 << 20):
        while chunk:
            data += z.decompress(chunk)
            chunk = z.unused_data
            if z.eof:
                z = zlib.decompressobj(31)
    b = Blocks(f, 0)
    b.data, b.starts, b.next = data, [(0, 0)], 1 << 62
    names, at = header(b)
    while at < len(data):
        row = record(data, at, names)
        if row:
            yield row
        at += 4 + struct.unpack_from("<i", data, at)[0]


def paths_of(path: str) -> list[str]:
    path = path.removeprefix("file://")
    if os.path.isdir(path):
        return sorted(os.path.join(path, x) for x in os.listdir(path) if x.endswith(".bam"))
    return [path]


class Reader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def partitions(self) -> list[Part]:
        out = []
        for path in paths_of(self.path):
            with open(path, "rb") as f:
                if block_size(f.read(64)) is None:
                    out.append(Part(path, 0, -1, [], -1))
                    continue
                names, after = header(Blocks(f, 0))
            size = os.path.getsize(path)
            out += [Part(path, s, min(size, s + self.split), names, -1 if s else after) for s in range(0, max(size, 1), self.split)]
        return out

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string())]
        names = [c.split(" ")[0] for c in SCHEMA.split(", ")]
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            columns[-1] = [list(t.items()) for t in columns[-1]]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for row in rows_of(partition):
            rows.append(row)
            if len(rows) == ROWS:
                yield batch()
                rows.clear()
        if rows:
            yield batch()


def packed(name: str, flag: int, tid: int, pos: int, cigar: list[tuple[int, str]], seq: str) -> bytes:
    """One record, its sequence as stored on the plus strand."""
    codes = [max(0, BASES.find(c)) for c in seq] + [0] * (len(seq) % 2)
    bases = bytes(codes[i] << 4 | codes[i + 1] for i in range(0, len(codes), 2))
    body = struct.pack("<iiBBHHHiiii", tid, pos, len(name) + 1, 255, 0, len(cigar), flag, len(seq), -1, -1, 0)
    body += name.encode() + b"\0" + b"".join(struct.pack("<I", n << 4 | OPS.index(op)) for n, op in cigar) + bases + b"\xff" * len(seq)
    return struct.pack("<i", len(body)) + body


def head(references: list[tuple[str, int]], text: str = "") -> bytes:
    out = [b"BAM\1", struct.pack("<i", len(text)), text.encode(), struct.pack("<i", len(references))]
    for name, size in references:
        out.append(struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", size))
    return b"".join(out)


def block(content: bytes) -> bytes:
    z = zlib.compressobj(wbits=-15)
    body = z.compress(content) + z.flush()
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\6\0BC\2\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(content), len(content))


class BlockedFile:
    """A chain of blocks; no record that fits a block is cut by a border."""

    def __init__(self, file):
        self.file, self.held = file, bytearray()

    def add(self, piece: bytes) -> None:
        if len(self.held) + len(piece) > CONTENT:
            self.flush()
        self.held += piece
        while len(self.held) > CONTENT:
            self.file.write(block(bytes(self.held[:CONTENT])))
            del self.held[:CONTENT]

    def flush(self) -> None:
        if self.held:
            self.file.write(block(bytes(self.held)))
            self.held.clear()

    def close(self) -> None:
        self.flush()
        self.file.write(END)
        self.file.close()


def encode(references: list[tuple[str, int]], reads: list[tuple[str, int, int, int, list[tuple[int, str]], str]]) -> bytes:
    """A BAM file in one gzip stream, of reads (name, flag, reference, pos, cigar, plus-strand sequence), for fixtures."""
    z = zlib.compressobj(wbits=31)
    return z.compress(head(references) + b"".join(packed(*r) for r in reads)) + z.flush()


@dataclass
class Done(WriterCommitMessage):
    path: str


class Writer(DataSourceArrowWriter):
    """A file for each partition, under a name that holds the task's attempt until the job commits."""

    def __init__(self, path: str, references: list[tuple[str, int]], program: str):
        self.path, self.references, self.program = path.removeprefix("file://"), references, program

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Done:
        from pyspark import TaskContext

        from cytoframe.sources.cigar import parts

        context = TaskContext.get()
        os.makedirs(self.path, exist_ok=True)
        path = f"{self.path}/part-{context.partitionId():05d}.{context.taskAttemptId()}.tmp"
        index = {name: i for i, (name, _) in enumerate(self.references)}
        lines = ["@HD\tVN:1.6", *(f"@SQ\tSN:{n}\tLN:{s}" for n, s in self.references), f"@PG\tID:{self.program}\tPN:{self.program}"]
        out = BlockedFile(open(path, "wb"))
        out.add(head(self.references, "\n".join(lines) + "\n"))
        for batch in iterator:
            for r in batch.to_pylist():
                minus = r["strand"] == "-"
                seq = r["seq"][::-1].translate(TURN) if minus else r["seq"]
                out.add(packed(r["qname"], 16 if minus else 0, index[r["chrom"]], r["pos"], parts(r["cigar"]), seq))
        out.close()
        return Done(path)

    def commit(self, messages: list[Done | None]) -> None:
        for m in messages:
            if m:
                os.replace(m.path, m.path.rsplit(".", 2)[0] + ".bam")

    def abort(self, messages: list[Done | None]) -> None:
        for m in messages:
            if m and os.path.exists(m.path):
                os.remove(m.path)


class Bam(DataSource):
    """``spark.read.format("bam").load(path)``; writing needs the option ``references``, name and size of each chromosome as ``chr1:1000,chr2:900``."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], int(self.options.get("split", SPLIT)))

    def writer(self, schema, overwrite: bool) -> Writer:
        references = [(x.rpartition(":")[0], int(x.rpartition(":")[2])) for x in self.options["references"].split(",")]
        return Writer(self.options["path"], references, self.options.get("program", "cytoframe"))
