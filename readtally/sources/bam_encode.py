"""Alignment records of an Arrow batch as bytes, all records at once with numpy and Arrow: the counterpart of ``bam_records.decode``."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from readtally.sources import bam_index
from readtally.sources.bam_records import BASES, CIGAR_OPS, HEAD, SIZES, TYPES, Tags, by_row, heads, pieces

_INTEGERS = {k: np.dtype(f) for k, f in SIZES.items() if k != "f"}


def _codes(letters: str) -> np.ndarray:
    out = np.full(256, 255, np.uint8)
    out[np.frombuffer(letters.encode(), np.uint8)] = np.arange(len(letters))
    return out


_BASE, _OP = _codes(BASES), _codes(CIGAR_OPS)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a column of text or binary values one after another, and their bounds; nulls are empty."""
    column = column.cast(pa.binary()).fill_null(b"")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.empty(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def _binary(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    if bounds[-1] >= 1 << 31:
        raise ValueError("a batch of records is too large")
    return pa.BinaryArray.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def fixed(rows: np.ndarray) -> pa.Array:
    """Rows of equally many bytes."""
    return _binary(rows.reshape(-1), np.arange(len(rows) + 1, dtype=np.int64) * rows.shape[1])


def _joined(*parts: pa.Array) -> pa.Array:
    return pc.binary_join_element_wise(*parts, pa.scalar(b"", pa.binary()))


def _bounds(lists: pa.Array) -> np.ndarray:
    return np.append(0, np.cumsum(pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))).astype(np.int64)


def _lookup(table: np.ndarray, data: np.ndarray, what: str) -> np.ndarray:
    out = table[data]
    if (out == 255).any():
        raise ValueError(f"{chr(data[np.argmax(out == 255)])} is no {what}")
    return out


def _payloads(kind: str, values: pa.Array, encoded: Callable[[str, str, str], bytes]) -> pa.Array:
    """Bytes of the values of tags of one type."""
    if kind in _INTEGERS:
        wide, small = values.cast(pa.int64()).to_numpy(zero_copy_only=False), _INTEGERS[kind]
        if len(wide) and (wide.min() < np.iinfo(small).min or wide.max() > np.iinfo(small).max):
            raise ValueError(f"a value of type {kind} is out of range")
        return fixed(wide.astype(small).view(np.uint8).reshape(len(wide), small.itemsize))
    if kind == "A":
        return values.cast(pa.binary())
    if kind in "fB":
        return pa.array([encoded("XX", kind, v)[3:] for v in values.to_pylist()], pa.binary())
    return _joined(values.cast(pa.binary()), pa.scalar(b"\0", pa.binary()))


def _tags(column: pa.Array, encoded: Callable[[str, str, str], bytes]) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Row, name and bytes of each tag, in the map's order."""
    at = column.offsets.to_numpy().astype(np.int64) if len(column) else np.zeros(1, np.int64)
    row = np.repeat(np.arange(len(column)), np.diff(at))
    key, value = (x.slice(int(at[0]), len(row)) for x in (column.keys, column.items))
    kinds, values = value.field(0), value.field(1)
    code = kinds.dictionary_encode()
    index, parts, order = code.indices.to_numpy(zero_copy_only=False), [pa.array([], pa.binary())], [np.empty(0, np.int64)]
    for i, kind in enumerate(code.dictionary.to_pylist()):
        at = np.flatnonzero(index == i)
        parts.append(_payloads(kind, values.take(pa.array(at)), encoded))
        order.append(at)
    back = np.empty(len(row), np.int64)
    back[np.concatenate(order)] = np.arange(len(row))
    payload = pa.concat_arrays(parts).take(pa.array(back))
    return row, key, _joined(key.cast(pa.binary()), kinds.cast(pa.binary()), payload)


def _is_tag(column: str) -> bool:
    """Whether a column holds the values of one tag: ``NH:C`` those of NH, of type C."""
    return len(column) == 4 and column[2] == ":"


def _tag_columns(batch: dict[str, pa.Array], encoded: Callable[[str, str, str], bytes]) -> list[pa.Array]:
    """Bytes of the tags that are columns, by name; a row without a value has none."""
    return [tag_column(name, batch[name], encoded).fill_null(b"") for name in sorted(filter(_is_tag, batch))]


def tag_column(name: str, values: pa.Array, encoded: Callable[[str, str, str], bytes]) -> pa.Array:
    """Bytes of the tag of each row, null without a value. ``name`` as in ``_is_tag``."""
    made = _joined(pa.scalar((name[:2] + name[3:]).encode(), pa.binary()), _payloads(name[3], values.drop_null(), encoded))
    if values.null_count:
        there = values.is_valid().to_numpy(zero_copy_only=False)
        made = made.take(pa.array(np.cumsum(there) - 1, mask=~there))
    return made


def _by_row(row: np.ndarray, pieces: pa.Array, n: int) -> pa.Array:
    """The pieces (rows in order) of each row one after another."""
    data, bounds = flat(pieces)
    return _binary(data, bounds[np.searchsorted(row, np.arange(n + 1))])


def _new(batch: dict[str, pa.Array], encoded) -> pa.Array:
    n = len(batch["pos"])
    number = lambda c: batch[c].to_numpy(zero_copy_only=False).astype(np.int64)
    for c in ("tid", "pos", "flag", "mapq", "qname"):
        if batch[c].null_count:
            raise ValueError(f"a record without {c}")
    name = _joined(batch["qname"].cast(pa.binary()), pa.scalar(b"\0", pa.binary()))
    ops = _bounds(batch["cigar"])
    each = batch["cigar"].flatten()
    letters = _lookup(_OP, flat(each.field(0))[0], "operation of a CIGAR")
    codes = each.field(1).to_numpy(zero_copy_only=False).astype(np.int64) << 4 | letters
    covers = np.append(0, np.cumsum(np.where(np.isin(letters, [CIGAR_OPS.index(c) for c in "MDN=X"]), codes >> 4, 0)))
    span = np.maximum(covers[ops[1:]] - covers[ops[:-1]], 1)
    start = np.maximum(number("pos"), 0)
    seq, at = flat(batch["seq"])
    size, half = np.diff(at), (np.diff(at) + 1) // 2
    place = np.append(0, np.cumsum(half))
    padded = np.zeros(2 * place[-1], np.uint8)
    padded[np.arange(len(seq)) + np.repeat(2 * place[:-1] - at[:-1], size)] = _lookup(_BASE, seq, "base")
    head = np.zeros(n, HEAD)
    for field, value in (
        ("tid", number("tid")), ("pos", number("pos")), ("l_name", pc.binary_length(name).to_numpy(zero_copy_only=False)), ("mapq", number("mapq")), ("bin", bam_index.bins(start, start + span) & 0xFFFF),
        ("n_cigar", np.diff(ops)), ("flag", number("flag")), ("l_seq", size), ("next_tid", np.full(n, -1)), ("next_pos", np.full(n, -1)),
    ):
        most = np.iinfo(HEAD[field])
        if n and (value.min() < most.min or value.max() > most.max):
            raise ValueError(f"{field} is out of range")
        head[field] = value
    if "tags" in batch:
        row, key, tags = _tags(batch["tags"], encoded)
        names = flat(key)[0].reshape(-1, 2).astype(np.int64) if len(key) else np.empty((0, 2), np.int64)
        order = np.lexsort((names[:, 1], names[:, 0], row))
        tagged = [_by_row(row[order], tags.take(pa.array(order)), n)]
    else:
        tagged = _tag_columns(batch, encoded)
    return _joined(
        fixed(head.view(np.uint8).reshape(n, HEAD.itemsize)), name, _binary(codes.astype("<u4").view(np.uint8), 4 * ops), _binary(padded[::2] << 4 | padded[1::2], place),
        _binary(np.full(at[-1], 255, np.uint8), at), *tagged,
    )


def _edited(batch: dict[str, pa.Array], names: tuple[str, ...], encoded) -> pa.Array:
    """Raw records with the tags ``names`` as in the column tags, at the end, in this order; unchanged ones keep their place."""
    n = len(batch["raw"])
    data, bounds = flat(batch["raw"])
    head = np.ascontiguousarray(data[bounds[:-1, None] + np.arange(HEAD.itemsize)]).view(HEAD).reshape(-1)
    n_seq = head["l_seq"].astype(np.int64)
    begin = bounds[:-1] + HEAD.itemsize + head["l_name"] + 4 * head["n_cigar"].astype(np.int64) + (n_seq + 1) // 2 + n_seq
    old = Tags(data, begin, bounds[1:])
    wanted = {name: i for i, name in enumerate(names)}
    rank = np.full(1 << 16, -1, np.int64)
    for name, i in wanted.items():
        rank[name.encode()[0] << 8 | name.encode()[1]] = i
    old_rank = rank[data[old.place].astype(np.int64) << 8 | data[old.place + 1]] if len(old.row) else np.empty(0, np.int64)
    # a tag with its name, type and value, and the zero behind a text
    old_size = old.length + 3 + np.isin(old.kind, [ord("Z"), ord("H")]) if len(old.row) else np.empty(0, np.int64)
    row, key, made = _tags(batch["tags"], encoded)
    code = key.dictionary_encode()
    new_rank = np.array([wanted.get(k, -1) for k in code.dictionary.to_pylist()] + [-1], np.int64)[code.indices.to_numpy(zero_copy_only=False)]
    use = np.flatnonzero(new_rank >= 0)
    use = use[np.lexsort((new_rank[use], row[use]))]
    row, made, at_new = row[use], made.take(pa.array(use)), row[use] * len(names) + new_rank[use]
    mine = np.flatnonzero(old_rank >= 0)
    at_old = old.row[mine] * len(names) + old_rank[mine]
    found = np.searchsorted(at_new, at_old)
    met = np.flatnonzero((found < len(at_new)) & (at_new[np.minimum(found, max(len(at_new) - 1, 0))] == at_old)) if len(at_new) else np.empty(0, np.int64)
    pieces = _binary(*_cut(data, old.place[mine[met]], old_size[mine[met]]))
    same = pc.equal(pieces, made.take(pa.array(found[met]))).to_numpy(zero_copy_only=False).astype(bool)
    stay = old_rank < 0
    stay[mine[met[same]]] = True
    fresh = np.ones(len(row), bool)
    fresh[found[met[same]]] = False
    kept = _by_row(old.row[stay], _binary(*_cut(data, old.place[stay], old_size[stay])), n)
    added = _by_row(row[fresh], made.filter(pa.array(fresh)), n)
    return _joined(_binary(*_cut(data, bounds[:-1], begin - bounds[:-1])), kept, added)


def edited(data: np.ndarray, at: np.ndarray, end: np.ndarray, row: np.ndarray, names: list[str], new: list[pa.Array], left: tuple[str, ...]) -> pa.Array:
    """Records (their bytes from ``at`` to ``end``) with the tags ``names`` (name and type, as in ``_is_tag``) as in ``new``, one column of bytes for each, of
    which ``row`` gives the record's place; at the end and in this order, but unchanged ones keep their place. A tag without new bytes is
    removed, but for those that are ``left``."""
    head, n, of = heads(data, at), len(at), pa.array(row)
    n_seq = head["l_seq"].astype(np.int64)
    begin = at + HEAD.itemsize + head["l_name"] + 4 * head["n_cigar"].astype(np.int64) + (n_seq + 1) // 2 + n_seq
    old = Tags(data, begin, end)
    size, stay, same = old.sizes(), np.ones(len(old.row), bool), {}
    for i, name in enumerate(names):
        own = old.where(name[:2])
        if not len(own):
            continue
        made = new[i].take(pa.array(row[old.row[own]]))
        equal = pc.equal(pieces(data, old.place[own], size[own]), made).fill_null(name[:2] in left).to_numpy(zero_copy_only=False)
        stay[own] = equal
        if equal.any():
            same[i] = np.zeros(n, bool)
            same[i][old.row[own[equal]]] = True
    whole = [x.fill_null(b"") for x in new]
    if same:
        whole = [x.take(of) for x in whole]
        for i, mask in same.items():
            whole[i] = pc.if_else(pa.array(mask), pa.scalar(b"", pa.binary()), whole[i])
        added = _joined(*whole)
    else:
        added = _joined(*whole).take(of)
    kept = by_row(old.row[stay], pieces(data, old.place[stay], size[stay]), n)
    return _joined(pieces(data, at, begin - at), kept, added)


def _cut(data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    bounds = np.append(0, np.cumsum(length)).astype(np.int64)
    return data[np.repeat(begin - bounds[:-1], length) + np.arange(bounds[-1])], bounds


def _parsed(text: str | None) -> list[dict]:
    if text and not re.fullmatch(r"([0-9]+[MIDNSHP=X])+", text):
        raise ValueError(f"{text} is no CIGAR")
    return [{"op": op, "len": int(n)} for n, op in re.findall(r"([0-9]+)(.)", text or "")]


def _cigars(column: pa.Array) -> pa.Array:
    """CIGARs as text, of which each kind is parsed once, as lists."""
    code = column.dictionary_encode()
    known = pa.array([*map(_parsed, code.dictionary.to_pylist()), []], TYPES["cigar"])
    return known.take(code.indices.fill_null(len(known) - 1))


def records(batch: pa.RecordBatch, edited: tuple[str, ...], one: Callable[[dict], bytes], encoded: Callable[[str, str, str], bytes]) -> pa.Array:
    """The batch's records. ``edited``: the tags that are set in records with bytes of their own; ``one`` encodes a record alone, for CIGARs
    with more operations than the field counts; ``encoded`` a tag. CIGARs are lists or text."""
    if "cigar" in batch.schema.names and pa.types.is_string(batch.schema.field("cigar").type):
        batch = batch.set_column(batch.schema.get_field_index("cigar"), "cigar", _cigars(batch.column("cigar")))
    columns = {c: batch.column(c) for c in batch.schema.names}
    if "tags" in columns and any(map(_is_tag, columns)):
        raise ValueError("tags are a map or columns, not both")
    raw = columns.get("raw")
    if raw is not None and any(map(_is_tag, columns)):
        raise ValueError("records with bytes of their own have their tags in a map")
    if raw is not None and not raw.null_count:
        return _edited(columns, edited, encoded)
    long = "cigar" in columns and batch.num_rows and (pc.max(pc.list_value_length(columns["cigar"])).as_py() or 0) > 0xFFFF
    if long or raw is not None and raw.null_count < len(raw):  # long CIGARs, or records of both kinds
        return pa.array([one(row) for row in rows(batch)], pa.binary())
    return _new(columns, encoded)


def rows(batch: pa.RecordBatch):
    for row in batch.to_pylist():
        row["cigar"] = [(x["op"], x["len"]) for x in row.get("cigar") or []]
        row["tags"] = {k: (v["t"], v["v"]) for k, v in row.get("tags") or []} | {c[:2]: (c[3], row[c]) for c in row if _is_tag(c) and row[c] is not None}
        yield row
