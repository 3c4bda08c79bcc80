"""Column functions on alignment records. Schema: ord, qname, flag, tid, ref, pos, mapq, cigar array<struct<op,len>>, seq,
tags map<string, struct<t,v>> (t: the type letter, v: the value as text)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

READS = (
    "ord long, qname string, flag int, tid int, ref string, pos int, mapq int, cigar array<struct<op:string,len:int>>, seq string, "
    "tags map<string,struct<t:string,v:string>>"
)
_UNSIGNED = ("C", "S", "I")


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def parse_cigar(text: Column) -> Column:
    """``20M100N30M`` as array of (op, len)."""
    pattern = F.lit(r"(\d+)([MIDNSHP=X])")
    n, op = F.regexp_extract_all(text, pattern, 1), F.regexp_extract_all(text, pattern, 2)
    return F.zip_with(op, n, lambda o, k: F.struct(o.alias("op"), k.cast("int").alias("len")))


def tag(name: str, tags: str = "tags") -> Column:
    return F.try_element_at(F.col(tags), F.lit(name))


def hits_number(tags: str = "tags") -> Column:
    """NH, 1 if absent; a tag that is no unsigned integer aborts."""
    t = tag("NH", tags)
    wrong = F.raise_error(F.lit("NH tag is not an unsigned integer")).cast("long")
    return F.when(t.isNull(), 1).when(t["t"].isin(*_UNSIGNED), t["v"].cast("long")).otherwise(wrong)


def blocks(cigar: Column, pos: Column) -> Column:
    """Aligned blocks (s, e), half-open: one for each run of M, = or X; D and N move on, I does not."""
    empty = F.array().cast("array<struct<s:int,e:int>>")
    start = F.struct(pos.cast("int").alias("p"), empty.alias("b"))

    def step(a: Column, x: Column) -> Column:
        end = (a["p"] + x["len"]).cast("int")
        block = F.array(F.struct(a["p"].alias("s"), end.alias("e")))
        return F.when(x["op"].isin("M", "=", "X"), F.struct(end.alias("p"), F.concat(a["b"], block).alias("b"))).when(x["op"].isin("D", "N"), F.struct(end.alias("p"), a["b"].alias("b"))).otherwise(a)

    return F.aggregate(cigar, start, step, lambda a: a["b"])


def introns(cigar: Column, pos: Column) -> Column:
    """Gaps (s, e) of N operations."""
    empty = F.array().cast("array<struct<s:int,e:int>>")

    def step(a: Column, x: Column) -> Column:
        end = (a["p"] + x["len"]).cast("int")
        gap = F.array(F.struct(a["p"].alias("s"), end.alias("e")))
        return F.when(x["op"] == "N", F.struct(end.alias("p"), F.concat(a["b"], gap).alias("b"))).when(x["op"].isin("M", "=", "X", "D"), F.struct(end.alias("p"), a["b"].alias("b"))).otherwise(a)

    return F.aggregate(cigar, F.struct(pos.cast("int").alias("p"), empty.alias("b")), step, lambda a: a["b"])


def total_length(intervals: Column) -> Column:
    return F.aggregate(intervals, F.lit(0), lambda a, x: a + x["e"] - x["s"])


def merged_length(intervals: Column) -> Column:
    """Length of the union of intervals with s >= 0."""
    start = F.struct(F.lit(-1).alias("e"), F.lit(0).alias("n"))
    step = lambda a, x: F.struct(F.greatest(a["e"], x["e"]).alias("e"), (a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(a["e"], x["s"]))).alias("n"))
    return F.aggregate(F.array_sort(intervals), start, step, lambda a: a["n"])


def leading_clip(cigar: Column) -> Column:
    """Soft clip at the start, also after a hard clip; in reference orientation for both strands."""
    first, second = F.try_element_at(cigar, F.lit(1)), F.try_element_at(cigar, F.lit(2))
    return F.when(first["op"] == "S", first["len"]).when((first["op"] == "H") & (second["op"] == "S"), second["len"]).otherwise(0)


def corrected_position(cigar: Column, pos: Column, max_skip: int = 150) -> Column:
    """Start before soft clipping; may be negative. A longer clip than ``max_skip`` aborts."""
    clip = leading_clip(cigar)
    return F.when(clip > max_skip, F.raise_error(F.lit(f"clip longer than max_skip_length {max_skip}")).cast("int")).otherwise(pos - clip)


def is_reverse(flag: Column) -> Column:
    return flag.bitwiseAND(16) != 0


def side(direction: str, reverse: Column, strand: Column) -> Column:
    """``correct`` or ``reverse``: how a read's strand fits a region's under the direction."""
    if direction == "ignore":
        return F.lit("correct")
    same = reverse == (strand == "-")
    return F.when(strand.isin("+", "-") & (same if direction == "reverse" else ~same), "reverse").otherwise("correct")


def extractor(how: dict) -> Column:
    """UMI or barcode of a read, null if there is none."""
    mode = how["mode"]
    if mode == "regex_name":
        pattern = how["regex"]
        miss = F.raise_error(F.concat(F.lit("regex does not match read name "), F.col("qname"))).cast("string")
        if how.get("groups", 1) == 0:
            return F.when(F.col("qname").rlike(pattern), F.lit(None).cast("string")).otherwise(miss)
        found = F.regexp_extract("qname", pattern, 1)
        # an unset group gives no value, an empty one an empty value: behind the match, a reference back to an unset group fails, and
        # else a character beside it is taken (a name has one)
        n, beside = how.get("groups", 1), rf"(?:{pattern})(?:\1(?:(?=([\s\S]))|(?<=([\s\S]))))?"
        is_set = (found != "") | (F.regexp_extract("qname", beside, n + 1) != "") | (F.regexp_extract("qname", beside, n + 2) != "")
        return F.when(F.col("qname").rlike(pattern), F.when(is_set, found)).otherwise(miss)
    if mode == "search_in_name":
        at = F.instr("qname", how["search"])
        found = F.substring(F.col("qname"), at + len(how["search"]) + int(how.get("skip", 0)), F.lit(int(how["len"])))
        return F.when((at > 0) & (F.length(found) == int(how["len"])), found)
    if mode == "read_region":
        start, stop = int(how["start"]), int(how["stop"])
        short = F.raise_error(F.lit("read region is beyond the end of the read")).cast("string")
        return F.when(F.length("seq") >= stop, F.substring("seq", start + 1, stop - start)).otherwise(short)
    t = tag(how["tag"])
    wrong = F.raise_error(F.lit(f"tag {how['tag']} is missing or no string")).cast("string")
    return F.when(t["t"] == "Z", t["v"]).otherwise(wrong)


def with_tag(tags: Column, name: str, kind: str, value: Column) -> Column:
    """Replaces a tag, or removes it where the value is null."""
    rest = F.map_filter(tags, lambda k, v: k != name)
    return F.when(value.isNull(), rest).otherwise(F.map_concat(rest, F.create_map(F.lit(name), F.struct(F.lit(kind).alias("t"), value.cast("string").alias("v")))))


def hamming(a: Column, b: Column) -> Column:
    """Number of unequal characters; null for unequal lengths."""
    unequal = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int"))
    return F.when(F.length(a) == F.length(b), F.aggregate(unequal, F.lit(0), lambda p, q: p + q))


def packed_letters(word: Column) -> Column:
    """A word of up to 16 letters of ACGTN as one number, 4 bits a letter; null for others."""
    return F.when(word.rlike("^[ACGTN]{1,16}$"), F.conv(F.translate(word, "ACGTN", "12345"), 16, 10).cast("long"))


def packed_hamming(a: Column, b: Column) -> Column:
    """Number of unequal letters of two packed words of one length."""
    unequal = a.bitwiseXOR(b)
    some = unequal.bitwiseOR(F.shiftright(unequal, 1)).bitwiseOR(F.shiftright(unequal, 2))  # codes have three bits
    return F.bit_count(some.bitwiseAND(F.lit(0x1111111111111111))).cast("int")
