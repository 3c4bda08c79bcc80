"""BAM as a Spark data source, in Python: ``spark.read.format("bam").load(path)`` after ``register(spark)``.

The index (``.csi`` or ``.bai``) gives places at which records begin; a partition runs from one to another, ``SPLIT`` compressed bytes on,
so a contig is as many tasks as its size asks for. Tests of ref, tid, pos, flag and mapq are evaluated in the scan: contigs are left
out, ranges of positions become ranges of the file by the index, and rows that fail are not decoded. They come with the option
``tests`` (a JSON list of column, comparison, value; ``scan`` takes them), or from the query's filters with the option ``pushdown``, which
only a DataFrame that serves a single query may have (see ``PushingReader``). The option ``references`` (a JSON list) names contigs, ``columns`` (a JSON list) the columns to decode, ``tags`` (a JSON list) the tags of the column of that name (all, if not given), ``raw`` (true or false) adds each
record's bytes. The columns ``n`` and ``ords`` (only by ``columns``) stand for records that agree in all others and lie near each other, which are one row with their number
and their places, so what follows works once for all of them; rows go by their first place. With ``buckets`` (how far soft clips reach) a partition holds all records of its clip-corrected positions, so duplicates are
found inside partitions; ``spans`` (small, large) leaves out those of the other kind. Records leave a task in Arrow batches. ``ord`` is the virtual file offset: its order is file order.

Writing: ``save`` makes one file with its index. Tags are the map ``tags``, or a column for each, named ``NH:C`` (name and type), which costs a
fraction on the way to Python; so does a CIGAR as text. With ``source`` the records of that file at the rows' places are written with the tags that are columns. Tasks write parts of compressed blocks in a staging folder, each with its index
entries; tasks copy the parts to their places in the whole file (``stores.join``), the driver writes header and index, and both
appear under their names at the end. Paths are local or have a scheme that Arrow's file systems know.
"""

from __future__ import annotations

import io
import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import batched

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from readtally.functions.reads import READS
from readtally.sources import bam_encode, bam_index, bgzf, stores
from readtally.sources.bam_records import ALIKE, BASES, CIGAR_OPS, SIZES, TYPES, alike, cigar_codes, decode, heads, pieces, reference_length, starts

#: Compressed bytes of a partition, about, and uncompressed bytes that are decoded at once.
SPLIT, WINDOW = 4 << 20, 4 << 20
#: Usual sizes of a span beyond which it is large.
LARGE = 16
#: Bytes of records that are edited at once.
EDIT = 16 << 20
#: Compressed bytes that a task skips, rather than reads, to the next record that it looks for.
GAP = 4 << 20
#: Positions of a span that holds whole buckets, at least, as a multiple of how far these reach.
WIDE = 4
#: Records of a batch that is written from rows.
BATCH = 4096


def header(path: str) -> tuple[str, list[tuple[str, int]]]:
    """Header text, and names and lengths of the contigs."""
    text, refs = _header(path)
    return text.rstrip(b"\0").decode(), refs


def header_bytes(path: str) -> bytes:
    """Header text as it stands in the file."""
    return _header(path)[0]


def _header(path: str) -> tuple[bytes, list[tuple[str, int]]]:
    source, held = bgzf.contents(path), bytearray()

    def read(n: int) -> bytes:
        while len(held) < n:
            held.extend(next(source, b"") or b"")
            if not held:
                break
        out = bytes(held[:n])
        del held[:n]
        return out

    if read(4) != b"BAM\1":
        raise ValueError(f"{path} is not a BAM file")
    text = read(struct.unpack("<i", read(4))[0])
    refs = []
    for _ in range(struct.unpack("<i", read(4))[0]):
        name = read(struct.unpack("<i", read(4))[0])[:-1].decode()
        refs.append((name, struct.unpack("<i", read(4))[0]))
    return text, refs


def index(path: str) -> bam_index.Index:
    return bam_index.read(path)


def contigs_with_reads(path: str) -> list[str]:
    """Contigs with mapped reads, in the header's order."""
    refs, found = header(path)[1], index(path)
    return [name for tid, (name, _) in enumerate(refs) if tid < len(found.contigs) and found.has_mapped(tid)]


@dataclass
class _Span(InputPartition):
    """Records of a contig that begin in [begin, end); no end: up to the contig's last."""

    tid: int
    begin: int
    end: int | None
    first: bool = True  # of its contig


#: Comparisons that the scan evaluates on the numbers.
_COMPARE = {"=": np.equal, ">": np.greater, ">=": np.greater_equal, "<": np.less, "<=": np.less_equal, "in": np.isin}
_FILTERS = {ds.EqualTo: "=", ds.EqualNullSafe: "=", ds.GreaterThan: ">", ds.GreaterThanOrEqual: ">=", ds.LessThan: "<", ds.LessThanOrEqual: "<=", ds.In: "in"}
_NUMBERS = ("tid", "pos", "flag", "mapq")


class BamReader(DataSourceReader):
    def __init__(self, options, names: list[str]) -> None:
        self.path, self.names = options["path"], names
        self.plain = [c for c in names if c not in ("n", "ords")]
        if len(self.plain) < len(names) and (other := sorted(set(self.plain) - set(ALIKE))):
            raise ValueError(f"records are not told alike by {other[0]}")
        self.only = set(json.loads(options["references"])) if "references" in options else None
        self.tags = json.loads(options["tags"]) if "tags" in options else None
        self.split = int(options.get("split", SPLIT))
        self.reach = int(options["buckets"]) if "buckets" in options else None
        self.clipped, self.spans = options.get("clipped", "true") == "true", options.get("spans", "all")
        self.tests: list[tuple[str, str, object]] = []  # column, comparison, value
        for column, op, value in json.loads(options.get("tests", "[]")):
            if not self.takes(column, op, value):
                raise ValueError(f"the scan does not know the test {column} {op} {value}")

    def takes(self, column: str, op: str, value) -> bool:
        """Whether the scan evaluates this test; if so, it does from now on."""
        values = list(value) if op == "in" else [value]
        if column == "ref" and op in ("=", "in") and all(isinstance(v, str) for v in values):
            self._keep(set(values))
            return True
        if column in _NUMBERS and op in _COMPARE and all(isinstance(v, int) for v in values):
            self.tests.append((column, op, values if op == "in" else value))
            return True
        return False

    def _keep(self, names: set[str]) -> None:
        self.only = names if self.only is None else self.only & names

    def _bounds(self) -> tuple[int, int]:
        """The range of positions, half-open, that the tests leave."""
        low, high = 0, 1 << 62
        for column, op, value in self.tests:
            if column == "pos":
                least, most = (min(value, default=0), max(value, default=-1)) if op == "in" else (value, value)
                if op in ("=", "in", ">", ">="):
                    low = max(low, least + (op == ">"))
                if op in ("=", "in", "<", "<="):
                    high = min(high, most + (op != "<"))
        return low, high

    def partitions(self):
        refs, found = header(self.path)[1], index(self.path)
        (low, high), out = self._bounds(), []
        for tid, (name, _) in enumerate(refs[: len(found.contigs)]):
            if self.only is not None and name not in self.only or not found.contigs[tid].chunks:
                continue
            begins = found.begins(tid)
            whole = (low, high) == (0, 1 << 62)
            for begin, end in [(begins[0], None)] if whole else found.ranges(tid, low, high):
                cuts, at = [begin], _position(self.path, begin) if self.reach else 0
                for b in begins:
                    if b > begin and (end is None or b < end) and (b >> 16) - (cuts[-1] >> 16) >= self.split:
                        # a span reads ``reach`` positions beyond its end, which are few beside its own
                        if self.reach and (place := _position(self.path, b)) < at + WIDE * self.reach:
                            continue
                        at = place if self.reach else 0
                        cuts.append(b)
                spans = [_Span(tid, a, b, a == cuts[0]) for a, b in zip(cuts, [*cuts[1:], end], strict=True)]
                last = max(e for c in found.contigs[tid].chunks.values() for _, e in c)
                large = [(((s.end or last) >> 16) - (s.begin >> 16)) > LARGE * self.split for s in spans]
                out += [s for s, x in zip(spans, large, strict=True) if self.spans == "all" or x == (self.spans == "large")]
        return out or [_Span(-1, 0, 0)]

    def _buckets(self, data: np.ndarray, at: np.ndarray, end: np.ndarray, head: np.ndarray) -> np.ndarray:
        """Positions before leading soft clips (longer ones count as ``reach``), or plain positions."""
        pos = head["pos"].astype(np.int64)
        if not self.clipped or not self.reach:
            return pos
        n_seq = head["l_seq"].astype(np.int64)
        tags = at + 32 + head["l_name"] + 4 * head["n_cigar"].astype(np.int64) + (n_seq + 1) // 2 + n_seq
        codes, bounds, _ = cigar_codes(data, at, head, None, (tags, end))
        codes = np.append(codes, [0, 0]).astype(np.int64)
        n, first, second = np.diff(bounds), codes[bounds[:-1]], codes[bounds[:-1] + 1]
        hard = (n > 1) & (first & 15 == CIGAR_OPS.index("H")) & (second & 15 == CIGAR_OPS.index("S"))
        clip = np.where((n > 0) & (first & 15 == CIGAR_OPS.index("S")), first >> 4, np.where(hard, second >> 4, 0))
        return pos - np.minimum(clip, self.reach)

    def read(self, partition: _Span) -> Iterator[pa.RecordBatch]:
        if partition.tid < 0:
            return
        refs = pa.array([n for n, _ in header(self.path)[1]], pa.string())
        high, low, most = self._bounds()[1], None, None
        if self.reach is not None:
            # whole buckets: those behind the position of the span's first record, up to that of the next span's first, whose
            # records begin up to ``reach`` behind it
            low = None if partition.first else _position(self.path, partition.begin)
            most = None if partition.end is None else _position(self.path, partition.end)
            high = high if most is None else min(high, most + self.reach + 1)
        for window in bgzf.windows(self.path, partition.begin, WINDOW):
            at, used = starts(window.data)
            if len(at):
                data = np.frombuffer(bytes(window.data), np.uint8)
                offsets, head = window.offsets(at), heads(data, at + 4)
                inside = (head["tid"] == partition.tid) & (head["pos"] < high)
                if partition.end is not None and self.reach is None:
                    inside &= offsets < partition.end
                # records are sorted, so those behind the first that is outside are outside, too
                n = len(at) if inside.all() else int(np.argmin(inside))
                keep = np.ones(n, bool)
                for column, op, value in self.tests:
                    keep &= _COMPARE[op](head[column][:n].astype(np.int64), value)
                ends = np.append(at[1:], used)
                if low is not None or most is not None:
                    buckets = self._buckets(data, at[:n] + 4, ends[:n], head[:n])
                    keep &= (buckets > (-1 << 62 if low is None else low)) & (buckets <= (1 << 62 if most is None else most))
                own = np.flatnonzero(keep)
                if len(own):
                    yield self._batch(data, at[own] + 4, ends[own], head[own], offsets[own], refs)
                if n < len(at):
                    return
            window.drop(used)


    def _batch(self, data: np.ndarray, at: np.ndarray, end: np.ndarray, head: np.ndarray, offsets: np.ndarray, refs: pa.Array) -> pa.RecordBatch:
        if self.plain == self.names:
            return decode(data, at, end, head, offsets, self.names, refs, self.tags)
        first, order, bounds = alike(data, at, end, head, self.plain, self.tags)
        # only these are decoded, apart from the others, of which there may be many
        size = (end - at)[first]
        some = np.frombuffer(pieces(data, at[first], size).buffers()[2], np.uint8)
        place = np.cumsum(size)
        one = decode(some, place - size, place, head[first], offsets[first], self.plain, refs, self.tags)
        made = {c: one.column(c) for c in self.plain} | {"n": pa.array(np.diff(bounds)), "ords": pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(offsets[order]))}
        return pa.RecordBatch.from_arrays([made[c] for c in self.names], names=self.names)


def _position(path: str, offset: int) -> int:
    """The position of the record at a virtual offset."""
    for window in bgzf.windows(path, offset, 1):
        at, _ = starts(window.data)
        if len(at):
            return int(heads(np.frombuffer(bytes(window.data), np.uint8), at[:1] + 4)["pos"][0])
    raise ValueError(f"{path} has no record where its index says")


def has_large_spans(path: str, references: list[str], **options) -> bool:
    """Whether a span of the scan (with its options) is larger than ``LARGE`` times a usual one (a very deep locus)."""
    return BamReader({"path": path, "references": json.dumps(references), **options, "spans": "large"}, []).partitions()[0].tid >= 0


class PushingReader(BamReader):
    """Takes filters of the query, too. Spark 4.1 keeps a reader's filters for later queries on the same DataFrame, so one that is loaded
    with the option ``pushdown`` must serve a single query."""

    def pushFilters(self, filters):
        for f in filters:
            column, op = ".".join(f.attribute) if hasattr(f, "attribute") else "", _FILTERS.get(type(f))
            # a placed record has all of the scan's own columns
            if not (op and self.takes(column, op, f.value) or type(f) is ds.IsNotNull and column in ("ref", *_NUMBERS)):
                yield f


class BamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        full = READS + (", raw binary" if self.options.get("raw", "true") == "true" else "")
        if "columns" not in self.options:
            return full
        kinds = dict(x.strip().split(" ", 1) for x in _top_level(full + ", n long, ords array<long>"))
        return ", ".join(f"{c} {kinds[c]}" for c in json.loads(self.options["columns"]))

    def reader(self, schema) -> BamReader:
        kind = PushingReader if self.options.get("pushdown", "false") == "true" else BamReader
        return kind(self.options, schema.names)

    def writer(self, schema, overwrite: bool) -> BamWriter:
        return BamWriter(self.options)


def _top_level(schema: str) -> list[str]:
    """The columns of a schema, split at commas outside brackets."""
    out, depth = [""], 0
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def register(spark: SparkSession) -> None:
    """Makes the format known and lets filters reach it."""
    spark.dataSource.register(BamSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def scan(spark: SparkSession, path: str, tests: list[tuple] = (), columns: list[str] | None = None, **options) -> DataFrame:
    """Records that pass all tests (column, comparison, value), such as ("pos", ">=", 5000) or ("ref", "in", ["chr1"])."""
    register(spark)
    reader = spark.read.format("bam").option("tests", json.dumps(list(tests))).options(**options)
    return (reader.option("columns", json.dumps(columns)) if columns else reader).load(path)


def contigs(spark: SparkSession, path: str) -> DataFrame:
    return spark.createDataFrame([(i, n, size) for i, (n, size) in enumerate(header(path)[1])], "tid int, name string, length long")


def _encoded_tag(key: str, kind: str, value: str) -> bytes:
    out = key.encode() + kind.encode()
    if kind in SIZES:
        return out + struct.pack(SIZES[kind], float(value) if kind == "f" else int(value))
    if kind == "A":
        return out + value.encode()
    if kind == "B":
        sub, *values = value.split(",")
        return out + sub.encode() + struct.pack("<i", len(values)) + b"".join(struct.pack(SIZES[sub], float(v) if sub == "f" else int(v)) for v in values)
    return out + value.encode() + b"\0"


def _raw_tags(raw: bytes) -> tuple[int, list[tuple[str, bytes]]]:
    """Where the tags of a record begin, and each tag's name and bytes, in order."""
    l_name, n_cigar, l_seq = raw[8], *struct.unpack_from("<H", raw, 12), *struct.unpack_from("<i", raw, 16)
    at = start = 32 + l_name + 4 * n_cigar + (l_seq + 1) // 2 + l_seq
    out = []
    while at < len(raw):
        begin, kind = at, chr(raw[at + 2])
        at += 3
        if kind in SIZES:
            at += struct.calcsize(SIZES[kind])
        elif kind == "A":
            at += 1
        elif kind in "ZH":
            at = raw.index(b"\0", at) + 1
        elif kind == "B":
            at += 5 + struct.unpack_from("<i", raw, at + 1)[0] * struct.calcsize(SIZES[chr(raw[at])])
        else:
            raise ValueError(f"unknown tag type {kind}")
        out.append((raw[begin : begin + 2].decode(), raw[begin:at]))
    return start, out


#: Tags that the annotation sets or removes, with their types, and those of which an old value stays where there is no new one.
EDITED = {"XF": "C", "XQ": "Z", "XR": "Z", "XP": "i", "CB": "Z", "CR": "Z"}
LEFT = ("CR",)


def edit(raw: bytes, tags: dict[str, tuple[str, str]]) -> bytes:
    """The record with its tags ``EDITED`` as in ``tags``, at the end; all other bytes as they are."""
    start, old = _raw_tags(raw)
    # a barcode that the row did not change keeps its bytes and place
    same = {k for k, b in old if k in tags and _encoded_tag(k, *tags[k]) == b}
    kept = [b for k, b in old if k not in EDITED or k in same]
    return raw[:start] + b"".join(kept) + b"".join(_encoded_tag(k, *tags[k]) for k in EDITED if k in tags and k not in same)


def encode(row: dict) -> bytes:
    """The record of a row; a row that has its raw record keeps all of it but the edited tags."""
    if row.get("raw") is not None:
        return edit(bytes(row["raw"]), row["tags"] or {})
    name, cigar, seq, tags = row["qname"].encode() + b"\0", row["cigar"] or [], row["seq"] or "", dict(row["tags"] or {})
    span = sum(n for op, n in cigar if op in "MDN=X") or 1
    start = max(row["pos"], 0)
    bin_of = int(bam_index.bins(np.array([start]), np.array([start + span]))[0]) & 0xFFFF
    if len(cigar) > 0xFFFF:  # more than the field counts
        tags["CG"] = ("B", ",".join(["I", *(str(n << 4 | CIGAR_OPS.index(op)) for op, n in cigar)]))
        cigar = [("S", len(seq)), ("N", span)]
    out = struct.pack("<iiBBHHHiiii", row["tid"], row["pos"], len(name), row["mapq"], bin_of, len(cigar), row["flag"], len(seq), -1, -1, 0) + name
    out += b"".join(struct.pack("<I", n << 4 | CIGAR_OPS.index(op)) for op, n in cigar)
    code = [BASES.index(c) for c in seq] + [0] * (len(seq) % 2)
    out += bytes(a << 4 | b for a, b in zip(code[::2], code[1::2], strict=True)) + b"\xff" * len(seq)
    return out + b"".join(_encoded_tag(key, kind, value) for key, (kind, value) in sorted(tags.items()))


class _Places:
    """Records of a file at given places, read once from the first place to the last."""

    def __init__(self, path: str) -> None:
        self.path, self.source, self.window = path, None, None

    def _next(self, used: int = 0) -> None:
        if self.window is not None:
            self.window.drop(used)
        self.window = next(self.source, None)
        if self.window is None or not self.window.place:
            raise ValueError(f"{self.path} has no record where one was read")
        self.data = np.frombuffer(bytes(self.window.data), np.uint8)

    def find(self, places: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, slice]]:
        """Bytes, bounds of records in them, and which of the places (in order) these are."""
        i = 0
        while i < len(places):
            if self.window is None or not 0 <= (int(places[i]) >> 16) - self.window.place[0] <= GAP:
                self.source, self.window = bgzf.windows(self.path, int(places[i]), WINDOW), None
                self._next()
            k = i + int(np.searchsorted(places[i:] >> 16, self.window.place[-1], side="right"))
            at = self.window.at(places[i:k])
            sized = at[: np.searchsorted(at, len(self.data) - 4, side="right")]
            end = sized + 4 + np.ascontiguousarray(self.data[sized[:, None] + np.arange(4)]).view("<i4").reshape(-1)
            # records that are here as a whole; the last may go on in the next stretch
            n = int(np.searchsorted(end, len(self.data), side="right"))
            if (end[:n] - at[:n] < 36).any() or n and (end[: n - 1] > at[1:n]).any():
                raise ValueError(f"{self.path} has no record where one was read")
            if n:
                yield self.data, at[:n] + 4, end[:n], slice(i, i + n)
                i += n
            if i < len(places):
                self._next(int(at[n]) if n < len(at) else len(self.data))


def _annotated(source: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Array]:
    """Records of ``source`` with tags that are columns of the rows, which have the place ``ord`` of a record each, or places ``ords`` of several and
    go by their first place, so records before the last row's first place are complete. A tag without a value is removed, but for those ``LEFT``."""
    found, held, places, row = _Places(source), [], np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        names = [c for c in (f"{k}:{t}" for k, t in EDITED.items()) if c in batch.schema.names]
        new = [bam_encode.tag_column(c, batch.column(c), _encoded_tag) for c in names]
        several = "ords" in batch.schema.names
        lists = batch.column("ords") if several else None
        own = lists.flatten().to_numpy() if several else batch.column("ord").to_numpy()
        of = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy()) if several else np.arange(batch.num_rows)
        if len(places):
            of, new = of + len(held[0]) if held else of, [pa.concat_arrays([a, b]) for a, b in zip(held, new, strict=True)]
        places, row = np.append(places, own), np.append(row, of)
        order = np.argsort(places, kind="stable")
        places, row = places[order], row[order]
        n = int(np.searchsorted(places, lists[-1].values.to_numpy().min())) if several else len(places)
        yield from _edits(found, places[:n], row[:n], names, new)
        places, (kept, row) = places[n:], np.unique(row[n:], return_inverse=True)
        held = [x.take(pa.array(kept)) for x in new]
    if len(places):
        yield from _edits(found, places, row, names, held)


def _edits(found: _Places, places: np.ndarray, row: np.ndarray, names: list[str], new: list[pa.Array]) -> Iterator[pa.Array]:
    size = sum(pc.binary_length(x).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for x in new)
    for data, begin, end, some in found.find(places):
        own, i = row[some], 0
        total = np.cumsum(size[own] + end - begin)
        while i < len(own):
            k = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + EDIT, side="right")))
            yield bam_encode.edited(data, begin[i:k], end[i:k], own[i:k], names, new, LEFT)
            i = k


def _write_records(f, batches: Iterator[pa.Array], depth: int, block: int = bgzf.BLOCK) -> dict[str, np.ndarray]:
    """Writes batches of records as blocks; their index entries, with virtual offsets in ``f``."""
    found, buffer, written = bam_index.Builder(depth=depth), bytearray(), 0

    def flush() -> None:
        nonlocal written
        while buffer:
            data = bgzf.block(bytes(buffer[: bgzf.BLOCK]))
            f.write(data)
            written += len(data)
            del buffer[: bgzf.BLOCK]

    for records in batches:
        if not len(records):
            continue
        size = pc.binary_length(records).to_numpy(zero_copy_only=False).astype("<i4")
        whole = pc.binary_join_element_wise(bam_encode.fixed(size.view(np.uint8).reshape(-1, 4)), records, pa.scalar(b"", pa.binary()))
        data, bounds = bam_encode.flat(whole)
        begin, end, raw, i = np.empty(len(size), np.int64), np.empty(len(size), np.int64), data.tobytes(), 0
        while i < len(size):
            k = int(np.searchsorted(bounds, bounds[i] + block - len(buffer), side="right")) - 1  # those before fit in the block
            if k <= i:
                if buffer:
                    flush()
                    continue
                k = i + 1
            inside = len(buffer) + bounds[i : k + 1] - bounds[i]
            begin[i:k], end[i:k] = written << 16 | inside[:-1], written << 16 | inside[1:]
            buffer += raw[bounds[i] : bounds[k]]
            if len(buffer) > bgzf.BLOCK:  # a record longer than a block
                begin[i] = written << 16
                flush()
                end[i] = written << 16
            i = k
        at, stop = bounds[:-1] + 4, bounds[1:]
        head = heads(data, at)
        n_seq = head["l_seq"].astype(np.int64)
        tags = at + 32 + head["l_name"] + 4 * head["n_cigar"].astype(np.int64) + (n_seq + 1) // 2 + n_seq
        codes, ops, _ = cigar_codes(data, at, head, None, (tags, stop))
        pos = head["pos"].astype(np.int64)
        found.add(head["tid"].astype(np.int64), pos, pos + np.maximum(reference_length(codes, ops), 1), head["flag"], begin, end)
    flush()
    return found.arrays()


def _head_blocks(refs: list[tuple[str, int]], text: bytes) -> bytes:
    data = b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(refs))
    for name, size in refs:
        data += struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", size)
    return bgzf.compressed(data)


def write(path: str, refs: list[tuple[str, int]], rows, block: int = bgzf.BLOCK, text: bytes = b"", csi: bool = False) -> None:
    """Writes sorted rows (dicts in the reads schema) as one BAM file with its index, as they come, in one process."""
    depth = bam_index.levels(max((n for _, n in refs), default=0))
    with open(path, "wb") as f:
        head = _head_blocks(refs, text)
        f.write(head)
        found = _write_records(f, (pa.array([encode(r) for r in some], pa.binary()) for some in batched(rows, BATCH)), depth, block)
        f.write(bgzf.EOF_BLOCK)
    csi = csi or depth > bam_index.DEPTH
    with open(path + (".csi" if csi else ".bai"), "wb") as f:
        f.write(bam_index.encoded(bam_index.joined([(len(head), found)]), len(refs), depth, csi))


@dataclass
class _Part(WriterCommitMessage):
    number: int
    path: str
    size: int


class BamWriter(DataSourceArrowWriter):
    """Writes parts of a BAM file, without header, in the folder ``path``, each with its index entries beside it; ``parts.json`` lists
    those of finished tasks in order. Options: depth, levels of the index; source, the file whose records are written."""

    def __init__(self, options) -> None:
        self.path, self.depth, self.source = options["path"], int(options.get("depth", bam_index.DEPTH)), options.get("source")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Part:
        number = TaskContext.get().partitionId()
        path = f"{self.path}/part-{number:06d}-{uuid.uuid4().hex}"  # of its own for each attempt

        stores.make_folder(self.path)
        with stores.open_output(path) as f:
            made = _annotated(self.source, iterator) if self.source else (bam_encode.records(b, EDITED, encode, _encoded_tag) for b in iterator)
            found = _write_records(f, made, self.depth)
            size = f.tell()
        entries = io.BytesIO()
        np.savez(entries, **found)
        with stores.open_output(path + ".index") as f:
            f.write(entries.getvalue())
        return _Part(number, path, size)

    def commit(self, messages: list) -> None:
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.number)
        stores.make_folder(self.path)
        with stores.open_output(f"{self.path}/parts.json") as f:
            f.write(json.dumps([[m.path, m.size] for m in parts]).encode())


def save(rows: DataFrame, path: str, text: bytes, refs: list[tuple[str, int]], order: tuple[str, ...] = ("tid", "ord"), source: str | None = None) -> None:
    """Writes rows of the reads schema as one BAM file in the given order (none: as they come, partition by partition), with its index; with
    ``source`` the records of that file at the rows' places, with their tags. Nothing is left of a run that fails."""
    depth, stage = bam_index.levels(max((n for _, n in refs), default=0)), f"{path}.staging-{uuid.uuid4().hex}"
    csi = depth > bam_index.DEPTH
    try:
        if order:
            rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
        rows.write.format("bam").options(depth=depth, **({"source": source} if source else {})).mode("append").save(stage)
        with stores.open_input(f"{stage}/parts.json") as f:
            parts = json.loads(f.read())
        head, at, entries = _head_blocks(refs, text), 0, []
        at = len(head)
        for part, size in parts:
            with stores.open_input(part + ".index") as f:
                entries.append((at, dict(np.load(io.BytesIO(f.read())))))
            at += size
        stores.join(rows.sparkSession, f"{stage}/whole", head, parts, bgzf.EOF_BLOCK)
        with stores.open_output(f"{stage}/index") as f:
            f.write(bam_index.encoded(bam_index.joined(entries), len(refs), depth, csi))
        stores.move(f"{stage}/whole", path)
        stores.move(f"{stage}/index", path + (".csi" if csi else ".bai"))
    finally:
        stores.remove_folder(stage)
