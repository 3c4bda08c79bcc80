"""Alignment records of a stretch of bytes as Arrow columns. All records of the stretch are decoded at once with numpy, and only
the columns that are asked for."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa

# Fixed values of the SAM format: operation letters, base letters, bytes of a value by type letter.
CIGAR_OPS = "MIDNSHP=X"
BASES = "=ACMGRSVTWYHKDBN"
SIZES = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I", "f": "<f"}
HEAD = np.dtype(
    [("tid", "<i4"), ("pos", "<i4"), ("l_name", "u1"), ("mapq", "u1"), ("bin", "<u2"), ("n_cigar", "<u2"), ("flag", "<u2"), ("l_seq", "<i4"), ("next_tid", "<i4"), ("next_pos", "<i4"), ("tlen", "<i4")]
)
TYPES = {
    "ord": pa.int64(), "qname": pa.string(), "flag": pa.int32(), "tid": pa.int32(), "ref": pa.string(), "pos": pa.int32(), "mapq": pa.int32(),
    "cigar": pa.list_(pa.struct([("op", pa.string()), ("len", pa.int32())])), "seq": pa.string(),
    "tags": pa.map_(pa.string(), pa.struct([("t", pa.string()), ("v", pa.string())])), "raw": pa.binary(), "n": pa.int64(), "ords": pa.list_(pa.int64()),
}
_WIDTH = np.zeros(256, np.int64)
for _k, _f in SIZES.items():
    _WIDTH[ord(_k)] = np.dtype(_f).itemsize
_WIDTH[ord("A")] = 1
_SIZE = struct.Struct("<i")
_LETTERS = np.frombuffer(BASES.encode(), np.uint8)
_OPS = np.frombuffer(CIGAR_OPS.encode() + b"???????", np.uint8)


def starts(data: bytearray, at: int = 0) -> tuple[np.ndarray, int]:
    """Places of the whole records (of their size fields), and the place behind the last."""
    out, n, size = [], len(data), _SIZE.unpack_from
    while at + 4 <= n:
        end = at + 4 + size(data, at)[0]
        if end > n:
            break
        if end < at + 36:
            raise ValueError("a record is too short")
        out.append(at)
        at = end
    return np.array(out, np.int64), at


def heads(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The fixed fields of the records that begin (their fields, not their sizes) at ``at``."""
    return np.ascontiguousarray(data[at[:, None] + np.arange(HEAD.itemsize)]).view(HEAD).reshape(-1)


def _gather(data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of ``data`` one after another, and their bounds."""
    bounds = np.append(0, np.cumsum(length))
    return data[np.repeat(begin - bounds[:-1], length) + np.arange(bounds[-1])], bounds


def pieces(data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> pa.Array:
    """Pieces of ``data`` as binary values. Pieces in order that share no byte are copied whole, others byte by byte."""
    if not len(begin):
        return pa.array([], pa.binary())
    edges = np.empty(2 * len(begin), np.int64)
    edges[::2], edges[1::2] = begin, begin + length
    if edges[-1] >= 1 << 31 or (np.diff(edges) < 0).any():
        return _strings(*_gather(data, begin, length), pa.binary())
    # the stretches between them are values, too, and left out
    all_ = pa.BinaryArray.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(data)])
    return all_.take(pa.array(np.arange(0, len(edges), 2)))


def by_row(row: np.ndarray, values: pa.Array, n: int) -> pa.Array:
    """The binary values (``row``: their rows, in order; no nulls) of each of ``n`` rows one after another."""
    if not len(values):
        return pa.array([b""] * n, pa.binary())
    bounds = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1]
    return pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(bounds[np.searchsorted(row, np.arange(n + 1))]), values.buffers()[2]])


def _strings(raw: np.ndarray, bounds: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    if bounds[-1] >= 1 << 31:
        raise ValueError("a batch of records is too large")
    out = pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw)))
    return out.view(kind) if kind is not None else out


def _letters(codes: np.ndarray) -> pa.Array:
    return _strings(codes.astype(np.uint8), np.arange(len(codes) + 1))


class Tags:
    """All tags of the records: rows (sorted), keys, types, and places of the values."""

    def __init__(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> None:
        self.data, self.n = data, len(begin)
        at, live, parts, zeros = begin.copy(), np.flatnonzero(begin < end), [], None
        while len(live):
            place = at[live]
            kind, value = data[place + 2], place + 3
            length, behind = _WIDTH[kind].copy(), np.zeros(len(live), np.int64)
            text = (kind == ord("Z")) | (kind == ord("H"))
            if text.any():
                zeros = np.flatnonzero(data == 0) if zeros is None else zeros
                length[text] = zeros[np.searchsorted(zeros, value[text])] - value[text]
                behind[text] = 1
            lists = np.flatnonzero(kind == ord("B"))
            if len(lists):
                count = np.ascontiguousarray(data[value[lists][:, None] + np.arange(1, 5)]).view("<i4").reshape(-1)
                length[lists] = 5 + count * _WIDTH[data[value[lists]]]
            if (wrong := np.flatnonzero((length == 0) & ~text)).size:
                raise ValueError(f"unknown tag type {chr(kind[wrong[0]])}")
            parts.append((live, place, kind, value, length))
            at[live] = value + length + behind
            live = live[at[live] < end[live]]
        columns = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.empty(0, np.int64)] * 5
        order = np.argsort(columns[0], kind="stable")
        self.row, self.place, self.kind, self.value, self.length = (c[order] for c in columns)

    def sizes(self) -> np.ndarray:
        """Bytes of each tag: name, type, value and the zero behind a text."""
        return self.length + 3 + np.isin(self.kind, [ord("Z"), ord("H")]) if len(self.row) else np.empty(0, np.int64)

    def where(self, key: str) -> np.ndarray:
        return np.flatnonzero((self.data[self.place] == ord(key[0])) & (self.data[self.place + 1] == ord(key[1]))) if len(self.place) else np.empty(0, np.int64)

    def values(self, own: np.ndarray) -> pa.Array:
        """Values of some tags as text."""
        parts, order = [pa.array([], pa.string())], [np.empty(0, np.int64)]
        for letter in np.unique(self.kind[own]):
            at = np.flatnonzero(self.kind[own] == letter)
            place, length, name = self.value[own[at]], self.length[own[at]], chr(letter)
            if name in "ZHA":
                parts.append(pieces(self.data, place, length).view(pa.string()))
            elif name == "B":
                parts.append(pa.array([_list_text(self.data[p : p + n].tobytes()) for p, n in zip(place, length, strict=True)], pa.string()))
            else:
                numbers = np.ascontiguousarray(self.data[place[:, None] + np.arange(_WIDTH[letter])]).view(SIZES[name]).reshape(-1)
                parts.append(pa.array([str(float(x)) for x in numbers], pa.string()) if name == "f" else pa.array(numbers.astype(np.int64)).cast(pa.string()))
            order.append(at)
        at = np.concatenate(order)
        back = np.empty(len(at), np.int64)
        back[at] = np.arange(len(at))
        return pa.concat_arrays(parts).take(pa.array(back))

    def column(self, without: np.ndarray | None = None) -> pa.Array:
        """A map of each record's tags. ``without``: tags that are left out."""
        own = np.arange(len(self.row))
        own = np.delete(own, without) if without is not None and len(without) else own
        keys = pieces(self.data, self.place[own], np.full(len(own), 2)).view(pa.string())
        each = pa.StructArray.from_arrays([_letters(self.kind[own]), self.values(own)], names=["t", "v"])
        bounds = np.append(0, np.cumsum(np.bincount(self.row[own], minlength=self.n))).astype(np.int32)
        return pa.MapArray.from_arrays(pa.array(bounds), keys, each)


def _list_text(raw: bytes) -> str:
    sub = chr(raw[0])
    values = np.frombuffer(raw, SIZES[sub], offset=5).tolist()
    return ",".join([sub, *map(str, values)])


def cigar_codes(data: np.ndarray, at: np.ndarray, head: np.ndarray, tags: Tags | None, tag_bounds: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Operations as numbers (length and letter), their bounds, and the tags that held those of records with more than 65,535: such
    a record has two operations, of which the first clips the whole sequence, and a tag CG with the real ones."""
    n = head["n_cigar"].astype(np.int64)
    raw, bounds = _gather(data, at + HEAD.itemsize + head["l_name"], 4 * n)
    codes, bounds = np.ascontiguousarray(raw).view("<u4"), bounds // 4
    first, second = codes[bounds[:-1][n == 2]], codes[bounds[:-1][n == 2] + 1]
    odd = np.flatnonzero(n == 2)[(first & 15 == 4) & (first >> 4 == head["l_seq"][n == 2]) & (second & 15 == 3)]
    if not len(odd):
        return codes, bounds, odd
    tags = tags or Tags(data, *tag_bounds)
    real = tags.where("CG")
    real = real[np.isin(tags.row[real], odd) & (tags.kind[real] == ord("B"))]
    by_row = {int(tags.row[i]): np.frombuffer(data[tags.value[i] + 5 : tags.value[i] + tags.length[i]].tobytes(), "<u4") for i in real}
    pieces = [by_row.get(i, codes[bounds[i] : bounds[i + 1]]) for i in range(len(n))]
    return np.concatenate(pieces), np.append(0, np.cumsum([len(p) for p in pieces])), real


def reference_length(codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Bases of the contig that each record covers."""
    covers = np.isin(codes & 15, [CIGAR_OPS.index(c) for c in "MDN=X"])
    total = np.append(0, np.cumsum(np.where(covers, codes >> 4, 0).astype(np.int64)))
    return total[bounds[1:]] - total[bounds[:-1]]


def _named(tags: Tags, names: list[str]) -> np.ndarray:
    out = np.zeros(len(tags.row), bool)
    for name in names:
        out[tags.where(name)] = True
    return out


#: Columns in which records may be told alike.
ALIKE = ("flag", "tid", "ref", "pos", "mapq", "cigar", "tags")


def alike(data: np.ndarray, at: np.ndarray, end: np.ndarray, head: np.ndarray, names: list[str], only: list[str] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Records of a stretch by kind, which are those whose bytes agree in the columns ``names``: the first record of each kind, in order, all
    records, kind by kind, each in order, and the bounds of the kinds among them. Columns and arguments as in ``decode``."""
    bounds = at + HEAD.itemsize + head["l_name"] + 4 * head["n_cigar"].astype(np.int64)
    n_seq = head["l_seq"].astype(np.int64)
    bounds = (bounds + (n_seq + 1) // 2 + n_seq, end)
    numbers = [head["tid" if c == "ref" else c].astype(np.int64) for c in names if c in ("flag", "tid", "ref", "pos", "mapq")]
    values = []
    if "cigar" in names or "tags" in names:
        tags = Tags(data, *bounds) if "tags" in names and only is not None else None
        if len(cigar_codes(data, at, head, tags, bounds)[2]):  # CIGARs among the tags
            numbers.append(np.arange(len(at)))
        if "cigar" in names:
            values.append(pieces(data, at + HEAD.itemsize + head["l_name"], 4 * head["n_cigar"].astype(np.int64)))
        if tags is not None:
            own = np.flatnonzero(_named(tags, only))
            values.append(by_row(tags.row[own], pieces(data, tags.place[own], tags.sizes()[own]), len(at)))
        elif "tags" in names:
            values.append(pieces(data, bounds[0], end - bounds[0]))
    key = np.zeros(len(at), np.int64)
    for code in [*numbers, *(v.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64) for v in values)]:
        code = code - code.min()
        if int(key.max()) + 1 > (1 << 62) // (int(code.max()) + 1):
            key = np.unique(key, return_inverse=True)[1]
        key = key * (int(code.max()) + 1) + code
    _, first, kind, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    by_first = np.argsort(first)
    place = np.empty(len(first), np.int64)
    place[by_first] = np.arange(len(first))
    return first[by_first], np.argsort(place[kind], kind="stable"), np.append(0, np.cumsum(n[by_first]))


def decode(data: np.ndarray, at: np.ndarray, end: np.ndarray, head: np.ndarray, offsets: np.ndarray, names: list[str], refs: pa.Array, only: list[str] | None = None) -> pa.RecordBatch:
    """A batch of the columns ``names``. ``at``, ``end``: the records' bytes without their sizes; ``offsets``: their places in the file;
    ``only``: the tags of the column ``tags``, if not all."""
    made: dict[str, pa.Array] = {}
    n_name, n_seq = head["l_name"].astype(np.int64), head["l_seq"].astype(np.int64)
    seq_at = at + HEAD.itemsize + n_name + 4 * head["n_cigar"].astype(np.int64)
    packed = (n_seq + 1) // 2
    bounds = (seq_at + packed + n_seq, end)
    tags = Tags(data, *bounds) if "tags" in names else None
    moved = None
    if "cigar" in names or "tags" in names:
        codes, ops, moved = cigar_codes(data, at, head, tags, bounds)
        each = pa.StructArray.from_arrays([_letters(_OPS[codes & 15]), pa.array((codes >> 4).astype(np.int32))], names=["op", "len"])
        made["cigar"] = pa.ListArray.from_arrays(pa.array(ops.astype(np.int32)), each)
    if "tags" in names:
        if only is not None:
            moved = np.union1d(moved, np.flatnonzero(~_named(tags, only))).astype(np.int64)
        made["tags"] = tags.column(moved)
    if "qname" in names:
        made["qname"] = pieces(data, at + HEAD.itemsize, n_name - 1).view(pa.string())
    if "seq" in names:
        total = np.append(0, np.cumsum(n_seq))
        place = np.arange(total[-1]) - np.repeat(total[:-1], n_seq)
        pair = data[np.repeat(seq_at, n_seq) + (place >> 1)]
        made["seq"] = _strings(_LETTERS[np.where(place & 1, pair & 15, pair >> 4)], total)
    if "raw" in names:
        made["raw"] = pieces(data, at, end - at)
    if "ref" in names:
        made["ref"] = refs.take(pa.array(head["tid"], mask=head["tid"] < 0))
    made["ord"] = pa.array(offsets)
    for c in ("flag", "tid", "pos", "mapq"):
        made[c] = pa.array(head[c].astype(np.int32))
    return pa.RecordBatch.from_arrays([made[c].cast(TYPES[c]) if made[c].type != TYPES[c] else made[c] for c in names], names=names)
