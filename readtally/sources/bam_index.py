"""Indexes of BAM files (``.bai`` and ``.csi``): reading, the records that may begin in a range, and writing from parts.

Bins halve the contig eight-fold per level: ``depth`` levels, the narrowest bins 2 ** ``min_shift`` bases wide (14 and 5 in ``.bai``, which
ends at 2 ** 29 bases). The bin after the last holds no records but a contig's extent and its mapped and unmapped reads.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

from readtally.sources import bgzf, stores

MIN_SHIFT, DEPTH = 14, 5
#: Compressed bytes of a piece of a bin, about, in an index that is written.
CHUNK = 1 << 20


def n_bins(depth: int) -> int:
    return ((1 << (3 * depth + 3)) - 1) // 7


def bins(start: np.ndarray, end: np.ndarray, min_shift: int = MIN_SHIFT, depth: int = DEPTH) -> np.ndarray:
    """The smallest bin that holds each [start, end)."""
    out, last = np.zeros(len(start), np.int64), np.maximum(end - 1, start)
    for level in range(1, depth + 1):
        shift = min_shift + 3 * (depth - level)
        inside = start >> shift == last >> shift
        out = np.where(inside, ((1 << 3 * level) - 1) // 7 + (start >> shift), out)
    return out


@dataclass
class Contig:
    chunks: dict[int, list[tuple[int, int]]] = field(default_factory=dict)  # by bin
    least: dict[int, int] = field(default_factory=dict)  # by window (bai) or bin (csi): no record there begins before
    mapped: int | None = None  # None where the index does not tell
    unmapped: int | None = None


@dataclass
class Index:
    contigs: list[Contig]
    min_shift: int = MIN_SHIFT
    depth: int = DEPTH
    by_bin: bool = False  # ``least`` is by bin

    def begins(self, tid: int) -> list[int]:
        """Virtual offsets at which records begin, in order."""
        return sorted({b for c in self.contigs[tid].chunks.values() for b, _ in c})

    def has_mapped(self, tid: int) -> bool:
        """Whether the contig has mapped reads; where the index does not count them, whether it has records."""
        c = self.contigs[tid]
        return bool(c.chunks) and (c.mapped is None or c.mapped > 0)

    def ranges(self, tid: int, start: int, end: int) -> list[tuple[int, int]]:
        """Merged ranges of virtual offsets that hold all records that begin in [start, end)."""
        c, found = self.contigs[tid], []
        start, end = max(start, 0), min(end, 1 << self.min_shift + 3 * self.depth)
        if start >= end:
            return []
        from_, until = self._least(c, start), 1 << 62
        for number, chunks in c.chunks.items():
            level = next(k for k in range(self.depth + 1) if number < n_bins(k))
            shift = self.min_shift + 3 * (self.depth - level)
            at = number - ((1 << 3 * level) - 1) // 7
            if start >> shift <= at <= end - 1 >> shift:
                found += [(max(b, from_), e) for b, e in chunks if e > from_]
            elif at << shift >= end:  # records of this bin begin behind the range, and so do all that follow them
                until = min(until, chunks[0][0])
        found = [(b, min(e, until)) for b, e in found if b < until]
        out: list[list[int]] = []
        for b, e in sorted(found):
            if out and b <= out[-1][1]:
                out[-1][1] = max(out[-1][1], e)
            else:
                out.append([b, e])
        return [(b, e) for b, e in out]

    def _least(self, c: Contig, start: int) -> int:
        if not self.by_bin:
            return c.least.get(min(start >> self.min_shift, len(c.least) - 1), 0)
        for level in range(self.depth, -1, -1):
            number = ((1 << 3 * level) - 1) // 7 + (start >> self.min_shift + 3 * (self.depth - level))
            if number in c.least:
                return c.least[number]
        return 0


def read(path: str) -> Index:
    """The index beside a BAM file: ``.csi`` or ``.bai``."""
    short = path.removesuffix(".bam")
    found = next((p for p in (path + ".csi", short + ".csi", path + ".bai", short + ".bai") if stores.is_file(p)), None)
    if found is None:
        raise FileNotFoundError(f"no index for {path}, please create an index")
    if found.endswith(".csi"):
        return _read_csi(b"".join(bgzf.contents(found)))
    with stores.open_input(found) as f:
        return _read_bai(f.read())


def _chunks(data: bytes, at: int, n: int) -> list[tuple[int, int]]:
    flat = struct.unpack_from(f"<{2 * n}Q", data, at)
    return list(zip(flat[::2], flat[1::2], strict=True))


def _add(contig: Contig, number: int, chunks: list[tuple[int, int]], depth: int) -> None:
    if number == n_bins(depth) + 1:
        contig.mapped, contig.unmapped = chunks[1]
    else:
        contig.chunks[number] = chunks


def _read_bai(data: bytes) -> Index:
    if data[:4] != b"BAI\1":
        raise ValueError("not a BAI index")
    out, at = Index([]), 8
    for _ in range(struct.unpack_from("<i", data, 4)[0]):
        contig = Contig()
        count = struct.unpack_from("<i", data, at)[0]
        at += 4
        for _ in range(count):
            number, n = struct.unpack_from("<Ii", data, at)
            _add(contig, number, _chunks(data, at + 8, n), DEPTH)
            at += 8 + 16 * n
        n = struct.unpack_from("<i", data, at)[0]
        contig.least = dict(enumerate(struct.unpack_from(f"<{n}Q", data, at + 4)))
        at += 4 + 8 * n
        out.contigs.append(contig)
    return out


def _read_csi(data: bytes) -> Index:
    if data[:4] != b"CSI\1":
        raise ValueError("not a CSI index")
    min_shift, depth, extra = struct.unpack_from("<iii", data, 4)
    out, at = Index([], min_shift, depth, True), 16 + extra
    n_contigs = struct.unpack_from("<i", data, at)[0]
    at += 4
    for _ in range(n_contigs):
        contig = Contig()
        count = struct.unpack_from("<i", data, at)[0]
        at += 4
        for _ in range(count):
            number, least, n = struct.unpack_from("<IQi", data, at)
            _add(contig, number, _chunks(data, at + 16, n), depth)
            if number in contig.chunks:
                contig.least[number] = least
            at += 16 + 16 * n
        out.contigs.append(contig)
    return out


class Builder:
    """Index entries of records in file order, as numpy arrays: runs of one bin, first records of windows, counts."""

    def __init__(self, min_shift: int = MIN_SHIFT, depth: int = DEPTH) -> None:
        self.min_shift, self.depth = min_shift, depth
        self.runs: list[np.ndarray] = []  # tid, bin, begin, end
        self.least: list[np.ndarray] = []  # tid, window, begin
        self.counts: dict[int, list[int]] = {}  # tid: begin, end, mapped, unmapped
        self.unplaced = 0

    def add(self, tid: np.ndarray, start: np.ndarray, end: np.ndarray, flag: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> None:
        self.unplaced += int((tid < 0).sum())
        own = tid >= 0
        tid, start, end, flag, begin, stop = (x[own] for x in (tid, np.maximum(start, 0), end, flag, begin, stop))
        if not len(tid):
            return
        number = bins(start, end, self.min_shift, self.depth)
        first = np.flatnonzero(np.diff(tid, prepend=-2) | np.diff(number, prepend=-1))
        last = np.append(first[1:], len(tid)) - 1
        self.runs.append(np.stack([tid[first], number[first], begin[first], stop[last]], 1))
        low, high = start >> self.min_shift, np.maximum(end - 1, start) >> self.min_shift
        n = high - low + 1
        row = np.repeat(np.arange(len(tid)), n)
        window = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + low[row]
        _, seen = np.unique(tid[row] << 32 | window, return_index=True)
        self.least.append(np.stack([tid[row[seen]], window[seen], begin[row[seen]]], 1))
        for t in np.unique(tid):
            at = np.flatnonzero(tid == t)
            lost = int((flag[at] & 4 != 0).sum())
            c = self.counts.setdefault(int(t), [int(begin[at[0]]), 0, 0, 0])
            c[1], c[2], c[3] = int(stop[at[-1]]), c[2] + len(at) - lost, c[3] + lost

    def arrays(self) -> dict[str, np.ndarray]:
        """What the index of a part needs: merged runs, first records, counts."""
        counts = np.array([[t, *c] for t, c in sorted(self.counts.items())], np.int64).reshape(-1, 5)
        return {"runs": merged(_table(self.runs, 4)), "least": first_of(_table(self.least, 3)), "counts": counts, "unplaced": np.array(self.unplaced)}


def _table(pieces: list[np.ndarray], width: int) -> np.ndarray:
    return np.concatenate(pieces).astype(np.int64) if pieces else np.empty((0, width), np.int64)


def merged(runs: np.ndarray) -> np.ndarray:
    """Runs of a bin are one where the next begins in the block in which the one before ends, but begin anew about every ``CHUNK`` bytes, so
    that a deep locus can be read in pieces. Pieces of one run touch."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    if not len(runs):
        return runs
    apart = (np.diff(runs[:, :2], axis=0) != 0).any(1) | (runs[1:, 2] >> 16 > runs[:-1, 3] >> 16)
    cut = np.diff((runs[:, 2] >> 16) // CHUNK) != 0
    first = np.append(0, np.flatnonzero(apart | cut) + 1)
    end = np.maximum.reduceat(runs[:, 3], first)
    end[:-1] = np.where(apart[first[1:] - 1], end[:-1], runs[first[1:], 2])
    return np.concatenate([runs[first, :3], end[:, None]], 1)


def first_of(least: np.ndarray) -> np.ndarray:
    """The smallest offset of each window."""
    least = least[np.lexsort((least[:, 2], least[:, 1], least[:, 0]))]
    return least[np.append(True, (np.diff(least[:, :2], axis=0) != 0).any(1))] if len(least) else least


def joined(parts: list[tuple[int, dict[str, np.ndarray]]]) -> dict[str, np.ndarray]:
    """The index entries of a file from those of its parts and their offsets in it."""
    runs, least, counts, unplaced = [], [], [], 0
    for offset, p in parts:
        by = offset << 16
        runs.append(p["runs"] + [0, 0, by, by])
        least.append(p["least"] + [0, 0, by])
        counts.append(p["counts"] + [0, by, by, 0, 0])
        unplaced += int(p["unplaced"])
    total: dict[int, list[int]] = {}
    for t, b, e, m, u in _table(counts, 5).tolist():
        c = total.setdefault(t, [b, e, 0, 0])
        c[0], c[1], c[2], c[3] = min(c[0], b), max(c[1], e), c[2] + m, c[3] + u
    every = np.array([[t, *c] for t, c in sorted(total.items())], np.int64).reshape(-1, 5)
    return {"runs": merged(_table(runs, 4)), "least": first_of(_table(least, 3)), "counts": every, "unplaced": np.array(unplaced)}


def levels(longest: int) -> int:
    """The depth that a contig's length asks for."""
    depth = DEPTH
    while longest > 1 << MIN_SHIFT + 3 * depth:
        depth += 1
    return depth


def encoded(parts: dict[str, np.ndarray], n_contigs: int, depth: int = DEPTH, csi: bool = False) -> bytes:
    """The bytes of a ``.bai``, or of a ``.csi``."""
    out = [b"CSI\1" + struct.pack("<iiii", MIN_SHIFT, depth, 0, n_contigs)] if csi else [b"BAI\1" + struct.pack("<i", n_contigs)]
    counts = {int(c[0]): c[1:] for c in parts["counts"]}
    for tid in range(n_contigs):
        runs, least = (parts[k][parts[k][:, 0] == tid] for k in ("runs", "least"))
        linear = _filled(least)
        numbers, first = np.unique(runs[:, 1], return_index=True)
        out.append(struct.pack("<i", len(numbers) + (tid in counts)))
        for number, own in zip(numbers.tolist(), np.split(runs[:, 2:], first[1:]) if len(runs) else [], strict=True):
            loffset = struct.pack("<Q", _least_of(number, linear, depth)) if csi else b""
            out.append(struct.pack("<I", number) + loffset + struct.pack("<i", len(own)) + own.astype("<u8").tobytes())
        if tid in counts:
            out.append(struct.pack("<I", n_bins(depth) + 1) + (struct.pack("<Q", 0) if csi else b"") + struct.pack("<iQQQQ", 2, *counts[tid].tolist()))
        if not csi:
            out.append(struct.pack("<i", len(linear)) + linear.astype("<u8").tobytes())
    out.append(struct.pack("<Q", int(parts["unplaced"])))
    data = b"".join(out)
    return bgzf.compressed(data) + bgzf.EOF_BLOCK if csi else data


def _filled(least: np.ndarray) -> np.ndarray:
    """Offsets by window; a window without records has that of the next one with some."""
    out = np.full(int(least[-1, 1]) + 1 if len(least) else 0, np.iinfo(np.int64).max, np.int64)
    out[least[:, 1]] = least[:, 2]
    return np.minimum.accumulate(out[::-1])[::-1]


def _least_of(number: int, linear: np.ndarray, depth: int) -> int:
    """The offset of the first window of a bin."""
    level = next(k for k in range(depth + 1) if number < n_bins(k))
    window = number - ((1 << 3 * level) - 1) // 7 << 3 * (depth - level)
    return int(linear[window]) if window < len(linear) else 0
