"""Record filters: each gives a column that is true where the read is removed. A keep action of the flag filters removes nothing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readtally.functions import reads as R

BEFORE = ("multimapper", "non_primary", "read1", "read2", "spliced")
AFTER = ("n_in_umi", "polyx_umi", "polya_umi")
_FLAGS = {"non_primary": 256, "read1": 64, "read2": 128}


def removes(mode: str, action: str) -> Column:
    if mode in _FLAGS:
        return (F.col("flag").bitwiseAND(_FLAGS[mode]) != 0) if action == "remove" else F.lit(False)
    umi = F.col("umi")
    hit = {
        "multimapper": lambda: R.hits_number() > 1,
        "spliced": lambda: F.exists(F.slice("cigar", 2, F.greatest(F.size("cigar"), F.lit(1))), lambda x: x["op"] == "N"),
        "n_in_umi": lambda: F.contains(umi, F.lit("N")),
        "polyx_umi": lambda: (umi != "") & umi.rlike(r"^(.)\1*$"),
        "polya_umi": lambda: umi.rlike("^A*$"),
    }[mode]()
    wrong = hit if action == "remove" else ~hit
    # without a UMI the filters on it keep the read; an empty one has no repeated letter and is kept too
    none = umi.isNull() | ((umi == "") if mode == "polyx_umi" else F.lit(False)) if mode in AFTER else F.lit(False)
    return ~none & wrong


def any_removes(filters: list[dict], modes: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(removes(f["mode"], f["action"]), F.lit(False)) for f in filters if f["mode"] in modes], F.lit(False))


def references(names: list[str], filters: list[dict], known: list[str]) -> list[str]:
    """The contigs that the reference filters leave, so that the scan reads no others."""
    for f in filters:
        if f["mode"] == "reference":
            if missing := sorted(set(f["references"]) - set(known)):
                raise ValueError(f"Reference {missing[0]} not found in the header")
            names = [n for n in names if (n in f["references"]) == (f["action"] == "keep")]
    return names


def by_reference(reads: DataFrame, filters: list[dict]) -> DataFrame:
    """Reference filters as a plain predicate on ref: the reads appear in no counter."""
    for f in filters:
        if f["mode"] != "reference":
            continue
        if not f["references"]:
            raise ValueError("Reference filter requires at least one reference to filter on.")
        named = F.col("ref").isin(*f["references"])
        reads = reads.where(named if f["action"] == "keep" else ~named)
    return reads
