"""The `fasta` data source: records of plain and blocked-gzip FASTA files, and FASTA output.

Reading. A partition is a range of a file's bytes as they are stored; files are neither walked nor read before tasks
run. A partition owns the records whose header follows a line end in its range (the first one also a header at the
start); it drops what comes before its first line end and reads past its end to finish its last record. Lines are found
and checked a few megabytes at a time in numpy. Options: withSequence (also read the sequence), splitBytes.

Writing (header, sequence; append or overwrite). Each task writes one file, wrapped to 60, named by its number, so that
a range-partitioned, sorted frame gives files in order. Options: compression (none or bgzf), wrap.

input_ordinal is the header's offset in its file. Paths are local or URIs; tasks open them, so all executors must reach
them.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..schemas import RECORDS, RECORDS_WITH_SEQUENCE
from . import bgzf, files

SPLIT, WRAP = 64 << 20, 60
#: Records, or bytes of headers and sequences, in a batch.
BATCH_ROWS, BATCH_BYTES = 1 << 16, 1 << 22
#: Bytes of output that a writing task holds.
PUT_BYTES = 1 << 20
_ID = re.compile(rb"[^ \t\n\f\r]*")


class FastaError(ValueError):
    pass


def parse_header(line: bytes) -> tuple[str, str]:
    """ID and whole header of a header line, its '>' and line end dropped."""
    body = line[1:]
    body = body.removesuffix(b"\n")
    body = body.removesuffix(b"\r")
    id_ = _ID.match(body)[0]
    if not id_:
        raise FastaError("a header has no ID")
    if b"\r" in body or b"\n" in body:
        raise FastaError("a header has a line end inside")
    try:
        return id_.decode(), body.decode()
    except UnicodeDecodeError as e:
        raise FastaError("a header isn't UTF-8") from e


@dataclass
class Records:
    """Columns of consecutive records."""

    start: np.ndarray
    id: list[str]
    header: list[str]
    first: np.ndarray
    length: np.ndarray
    bases: np.ndarray
    width: np.ndarray
    sequence: list[bytes] | None


class Scanner:
    """Records from chunks of bytes. All lines of a chunk are looked at together; a record or line that a chunk leaves
    open is carried as a few numbers: of the lines so far only the first, the last and the sum matter."""

    def __init__(self, keep: bool, at_start: bool):
        self.keep, self.at_start = keep, at_start
        # the line that isn't ended: its offset, bytes so far, the last byte, and its text if it is a header
        self.line_offset, self.line_width, self.line_end, self.line_header = -1, 0, -1, None
        # the record that isn't ended: its header, and its lines as (offset, width, bases)
        self.header: tuple[int, bytes] | None = None
        self.lines: list[tuple[int, int, int]] = []
        self.more = 0  # bases of the lines left out of self.lines
        self.parts: list[bytes] = []

    def feed(self, chunk: bgzf.Chunk, last: bool = False) -> Records | None:
        """The records that the chunk ends; last: the file, or the part to read, ends here."""
        data, places, offsets = chunk
        a = np.frombuffer(data, np.uint8)
        ends = np.flatnonzero(a == 10)
        begins = np.concatenate([[0], ends + 1])
        widths = np.diff(begins)
        bases = widths - 1 - ((ends > 0) & (a[np.maximum(ends - 1, 0)] == 13))
        heads = a[np.minimum(begins, max(len(a) - 1, 0))] == 62 if len(a) else np.zeros(1, bool)
        seg = np.searchsorted(places, begins, "right") - 1
        starts = offsets[seg] + (begins - places[seg]) if len(places) else begins.copy()
        open_ = self.line_width > 0
        if open_:  # the first line goes on
            heads[0] = self.line_header is not None
            starts[0] = self.line_offset
            if len(ends):
                bases[0] += self.line_width - (ends[0] == 0 and self.line_end == 13)
                widths[0] += self.line_width
        self._no_space(data, a, ends, begins, heads, open_)
        n = len(ends)
        texts: dict[int, bytes] = {}
        if open_ and self.line_header is not None and n:
            texts[0] = self.line_header + data[: begins[1]]
        # what is left is a line without an end
        rest = len(a) - int(begins[n])
        if rest or (open_ and not n):
            if not (open_ and not n):
                self.line_offset, self.line_width, self.line_header = int(starts[n]), 0, b"" if heads[n] else None
            self.line_width += rest
            if rest:
                self.line_end = int(a[-1])
                if self.line_header is not None:
                    self.line_header += data[begins[n] :]
        else:
            self.line_width, self.line_header, self.line_end = 0, None, -1
        starts, heads = starts[:n], heads[:n]
        if last and self.line_width:
            starts, heads = np.append(starts, self.line_offset), np.append(heads, self.line_header is not None)
            widths, bases = np.append(widths, self.line_width), np.append(bases, self.line_width - (self.line_end == 13))
            if self.line_header is not None:
                texts[n] = self.line_header
            self.line_width, self.line_header = 0, None
        return self._records(starts, widths, bases, heads, texts, data, begins, last)

    def _no_space(self, data: bytes, a: np.ndarray, ends: np.ndarray, begins: np.ndarray, heads: np.ndarray, open_: bool) -> None:
        """No white space inside sequence lines."""
        if open_ and self.line_header is None and self.line_end == 13 and len(a) and a[0] != 10:
            self._wrong_space()
        for code in (b" ", b"\t", b"\f", b"\r"):
            if data.find(code) < 0:
                continue
            hits = np.flatnonzero(a == code[0])
            if code == b"\r":  # but the one before a line end, or at the end of what was read
                hits = hits[(hits + 1 < len(a)) & (a[np.minimum(hits + 1, len(a) - 1)] != 10)]
            line = np.searchsorted(ends, hits)
            if not self.at_start and self.header is None:  # lines before the first header belong to another part
                first = int(np.argmax(heads)) if heads.any() else len(heads)
                hits, line = hits[line >= first], line[line >= first]
            if len(hits) and not heads[line].all():
                self._wrong_space()

    @staticmethod
    def _wrong_space():
        raise FastaError("white space in a sequence line")

    def _records(self, starts, widths, bases, heads, texts, data, begins, last) -> Records | None:
        shift = 0  # place of the chunk's first line among all
        if self.header is not None:  # the open record's lines come first again
            shift = 1 + len(self.lines)
            starts = np.concatenate([[self.header[0]], [x[0] for x in self.lines], starts]).astype(np.int64)
            widths = np.concatenate([[0], [x[1] for x in self.lines], widths]).astype(np.int64)
            bases = np.concatenate([[0], [x[2] for x in self.lines], bases]).astype(np.int64)
            heads = np.concatenate([[True], np.zeros(len(self.lines), bool), heads])
        at = np.flatnonzero(heads)
        first = int(at[0]) if len(at) else len(heads)
        if first:
            if self.at_start:
                raise FastaError("content before the first header")
            starts, widths, bases, heads, at, shift = starts[first:], widths[first:], bases[first:], heads[first:], at - first, shift - first
        if not len(at):
            return None
        self.at_start = False
        n = len(at) if last else len(at) - 1  # ended records
        stops = np.append(at[1:], len(heads))

        def header(k: int) -> bytes:
            i = int(at[k]) - shift
            return self.header[1] if i < 0 else texts[i] if i in texts else data[begins[i] : begins[i + 1]]

        found = [parse_header(header(k)) for k in range(n)]
        sequence = ~heads
        if (bases[sequence] <= 0).any():
            raise FastaError("an empty sequence line")
        if (stops[:n] == at[:n] + 1).any():
            raise FastaError("a record has no sequence")
        one = np.minimum(at + 1, len(heads) - 1)
        own = np.cumsum(heads) - 1
        odd = sequence & ((widths != widths[one][own]) | (bases != bases[one][own]))
        odd[stops - 1] = False  # the last line, or the last so far
        if odd.any():
            raise FastaError("a line before the last differs from the first")
        if (bases[stops[:n] - 1] > bases[one[:n]]).any():
            raise FastaError("the last line is longer than the first")
        sums = np.concatenate([[0], np.cumsum(np.where(sequence, bases, 0))])
        lengths = sums[stops] - sums[at]
        again = int(at[0]) < shift  # whether the first record is the open one
        if again:
            lengths[0] += self.more

        bodies: list[bytes] = []
        if self.keep:
            tail = len(data) if self.line_header is None else int(begins[-1])
            lows = [0 if i < 0 else int(begins[i + 1]) if i + 1 < len(begins) else len(data) for i in (at - shift).tolist()]
            highs = [int(begins[j]) for j in (stops[:-1] - shift).tolist()] + [tail]
            bodies = [data[low:high].translate(None, b"\r\n") for low, high in zip(lows, highs, strict=True)]
            if again and n:
                bodies[0] = b"".join([*self.parts, bodies[0]])
        out = Records(starts[at[:n]], [f[0] for f in found], [f[1] for f in found], starts[one[:n]], lengths[:n], bases[one[:n]], widths[one[:n]], bodies[:n]) if n else None
        if last:
            self.header, self.lines, self.more, self.parts = None, [], 0, []
            return out
        k, stop = len(at) - 1, len(heads)
        if again and not n:
            self.parts += bodies
        else:
            self.header, self.parts = (int(starts[at[k]]), header(k)), bodies[k:]
        i = int(at[k]) + 1
        kept = sorted({i, stop - 1}) if stop > i else []
        self.more = int(lengths[k]) - int(sum(bases[x] for x in kept))
        self.lines = [(int(starts[x]), int(widths[x]), int(bases[x])) for x in kept]
        return out


def scan(file: bgzf.PlainFile | bgzf.BgzfFile, low: int, high: int, keep: bool) -> Iterator[Records]:
    """Records whose header follows a line end in the stored bytes low to high (or begins the file)."""
    low, high = file.starting(low), file.starting(high) if high < file.size else file.size
    scanner = Scanner(keep, low == 0)
    skip, before, owned = low > 0, b"\n", False
    for data, places, offsets in file.chunks(low, high):
        if skip:
            end = data.find(b"\n")
            if end < 0:
                continue
            skip, cut = False, end + 1
            seg = max(0, int(np.searchsorted(places, cut, "right")) - 1)
            places, offsets = np.concatenate([[0], places[seg + 1 :] - cut]), np.concatenate([[offsets[seg] + cut - places[seg]], offsets[seg + 1 :]])
            before, data, owned = b"\n", data[cut:], True
            if not data:
                continue
        if found := scanner.feed((data, places, offsets)):
            yield found
        before, owned = data[-1:], True
    if not owned:  # an empty range, or one inside a line
        return
    # past the range: a header right behind a line end in it is still its own; the next one ends the last record
    first = True
    for data, places, offsets in file.chunks(high, file.size):
        stop, at = -1, 0
        if before == b"\n" and data[:1] == b">":
            if first:
                at = 1
            else:
                stop = 0
        if stop < 0:
            found_at = data.find(b"\n>", max(at - 1, 0))
            stop = found_at + 1 if found_at >= 0 else -1
        if stop >= 0:
            data = data[:stop]
        if data and (found := scanner.feed((data, places, offsets))):
            yield found
        if stop >= 0:
            break
        first, before = False, data[-1:]
    if found := scanner.feed((b"", np.zeros(0, np.int64), np.zeros(0, np.int64)), True):
        yield found


class Range(InputPartition):
    def __init__(self, path: str, file_format: str, low: int, high: int):
        super().__init__(None)
        self.path, self.file_format, self.low, self.high = path, file_format, low, high


class FastaReader(DataSourceReader):
    def __init__(self, paths: list[str], keep: bool, split: int):
        self.paths, self.keep, self.split = paths, keep, split

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path in self.paths:
            kind, size = bgzf.BgzfFile.file_format if bgzf.is_gzip(path) else bgzf.PlainFile.file_format, files.length(path)
            out += [Range(path, kind, low, min(low + self.split, size)) for low in range(0, size, self.split)]
        return out or [Range("", "", 0, 0)]

    def read(self, part: Range):
        if not part.path:
            return
        names = [c.split()[0] for c in (RECORDS_WITH_SEQUENCE if self.keep else RECORDS).split(", ")]
        for r in scan(bgzf.open_file(part.path, part.file_format), part.low, part.high, self.keep):
            held = np.cumsum(np.array([len(h) for h in r.header], np.int64) + (r.length if self.keep else 0))
            low = 0
            while low < len(r.id):
                high = max(low + 1, min(low + BATCH_ROWS, int(np.searchsorted(held, (held[low - 1] if low else 0) + BATCH_BYTES))))
                s = slice(low, high)
                n = len(r.id[s])
                columns = [pa.array([part.path] * n, pa.string()), pa.array([part.file_format] * n, pa.string()), pa.array(r.start[s]), pa.array(r.id[s], pa.string()), pa.array(r.header[s], pa.string()), pa.array(r.first[s]), pa.array(r.length[s]), pa.array(r.bases[s]), pa.array(r.width[s])]
                if self.keep:
                    columns.append(pa.array(r.sequence[s], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names)
                low = high


class Written(WriterCommitMessage):
    def __init__(self, name: str, records: int):
        self.name, self.records = name, records


def record_bytes(header: str, sequence: bytes, wrap: int = WRAP) -> bytes:
    """One record as it is written: any bytes, in lines."""
    lines = b"".join(sequence[i : i + wrap] + b"\n" for i in range(0, len(sequence), wrap))
    return b">" + header.encode() + b"\n" + lines


class FastaWriter(DataSourceArrowWriter):
    """Tasks write files under other names; committing gives them theirs, so that lost tasks leave nothing behind."""

    def __init__(self, path: str, overwrite: bool, blocked: bool, wrap: int):
        self.path, self.overwrite, self.blocked, self.wrap = path.rstrip("/"), overwrite, blocked, wrap
        self.job = uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        context = TaskContext.get()
        name = f"part-{context.partitionId():05d}-{self.job}.fa" + ".gz" * self.blocked
        temporary = f"{self.path}/_{self.job}/{context.taskAttemptId()}-{name}"
        records, held = 0, bytearray()
        with files.create(temporary) as f:
            for batch in batches:
                header, sequence = (batch.column(batch.schema.get_field_index(c)) for c in ("header", "sequence"))
                for h, s in zip(header, sequence, strict=True):
                    held += record_bytes(h.as_py() or "", s.as_py() or b"", self.wrap)
                    records += 1
                    if len(held) >= PUT_BYTES:
                        self._put(f, held, False)
                batch = header = sequence = None  # they go before the next batch is read
            self._put(f, held, True)
        pa.default_memory_pool().release_unused()
        return Written(temporary, records)

    def _put(self, f, held: bytearray, last: bool) -> None:
        if not self.blocked:
            f.write(held)
            held.clear()
            return
        size = 60_000
        n = len(held) if last else len(held) // size * size
        for i in range(0, n, size):
            f.write(bgzf.block(bytes(held[i : min(i + size, n)])))
        del held[:n]
        if last:
            f.write(bgzf.EOF_BLOCK)

    def commit(self, messages: list) -> None:
        old = files.listed(self.path) if self.overwrite and files.exists(self.path) else []
        for m in messages:
            if m is not None and m.records:
                files.move(m.name, f"{self.path}/{m.name.rsplit('/', 1)[1].split('-', 1)[1]}")
        for path in old:
            files.remove(path)
        files.remove(f"{self.path}/_{self.job}")

    def abort(self, messages: list) -> None:
        files.remove(f"{self.path}/_{self.job}")


class FastaSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fasta"

    def _keep(self) -> bool:
        return str(self.options.get("withSequence", "false")).lower() == "true"

    def schema(self) -> str:
        return RECORDS_WITH_SEQUENCE if self._keep() else RECORDS

    def reader(self, schema) -> FastaReader:
        split = int(self.options.get("splitBytes", SPLIT))
        if split <= 0:
            raise FastaError("splitBytes must be over 0")
        return FastaReader(files.listed(self.options.get("path") or ""), self._keep(), split)

    def writer(self, schema, overwrite: bool) -> FastaWriter:
        kind = str(self.options.get("compression", "none")).lower()
        if kind not in ("none", "bgzf"):
            raise FastaError(f"compression {kind!r} is neither none nor bgzf")
        if not {"header", "sequence"} <= {f.name for f in schema.fields}:
            raise FastaError("FASTA output needs the columns header and sequence")
        return FastaWriter(self.options.get("path") or "", overwrite, kind == "bgzf", int(self.options.get("wrap", WRAP)))
