"""Line dedup by content-defined chunks of lines, with DataFrame functions only.

A text is cut into lines: at newlines, behind sentences, and, since a passage may lie within one sentence, at about three of
four other word places, chosen by the letters on either side. Put together the lines give the text; in scripts without blanks
each character is a line. Every line has a hash, and a hash that rolls over ``ROLL`` successive line hashes (a cyclic polynomial)
chooses the chunks: one begins where the rolling hash is negative and lowest among ``REACH`` places on either side. Both rules look at
the surroundings only, so the same passage is cut the same way whatever stands before and after it. A chunk has three lines
at least and five on average, about six words; of random passages of 51 words all but two in 1,000 hold ``MIN_WORDS``
words between the first and the last boundary of their own, of 60 words practically all.

Chunks are counted by hash over all documents. Those whose hash repeats are grouped by their bytes (a byte comparison of
all of them; different chunks of one hash are told apart), and all occurrences but the first (by doc_id, text hash, position) are repeats. Counting and
comparing are hash aggregations with map-side partial results, so a very common chunk is not gathered. Successive repeats in a
document form a run, and runs of ``MIN_WORDS`` words and ``MIN_CHARS`` characters go: short phrases that texts share by chance stay.

Edge cases: null stays null; texts of fewer words than ``MIN_WORDS`` are not touched; a document whose rows
repeat exactly is one document; two documents of equal text leave the first whole and the second empty; documents without
an id come after the others, in the order of their text hashes. Repetitions inside a document are removed too. A passage keeps its
head and tail, where chunks straddle its edges. Columns that clash with the operator's own are kept. An empty table gives an empty
table. A very long text is an array in one row, its work linear in its words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readtally.llm.fingerprints import let
from readtally.llm.shared import discard, packed, put, small, stored, unpacked, with_row_key

MIN_CHARS = 20
MIN_WORDS = 20
#: Rolling hashes on either side that a chunk's first one is compared with, and line hashes that one covers.
REACH, ROLL = 2, 2
#: Letters and digits of odd codes, and all beyond ASCII: a word place with one on its left or right ends a line.
_ODD = r"acegikmoqsuwyACEGIKMOQSUWY13579\x{80}-\x{10FFFF}"
_ENDS = rf"(?<=[ \n])(?=[^ \n])(?:(?=[{_ODD}])|(?<=[{_ODD}.!?][ \n])|(?<=\n))"
#: Thai to Myanmar, Khmer, Chinese and Japanese (with full-width signs): no blanks between words.
_RANGES = r"฀-໿က-႟ក-៿⺀-鿿豈-﫿＀-￯\x{20000}-\x{3FFFF}"
_UNSPACED = f"[{_RANGES}]"
#: One range around all of these, which is looked for first because that is quicker.
_FAR = r"[฀-\x{3FFFF}]"
#: Bits of the table of repeated hashes for each of them, and the rows (64 bits each) that it has at least and at most.
BITS, LEAST_ROWS, MOST_ROWS = 16, 1 << 10, 1 << 20
#: Stands before each chunk but the first while a text is cut; texts that hold it have it escaped meanwhile.
_MARK, _ESCAPE = "\x01", "\x02"


def _unspaced(text: Column) -> Column:
    return (F.octet_length(text) > F.length(text)) & F.rlike(text, F.lit(_FAR)) & F.rlike(text, F.lit(_UNSPACED))


def lines(text: Column) -> Column:
    """Lines with the blanks and newlines behind them; a character of an unspaced script is a line. Whether a place
    divides lines depends on the characters beside it only, not on the rest of the text."""
    return F.when(_unspaced(text), F.split(text, f"{_ENDS}|(?<={_UNSPACED})(?=[^ \\n])")).otherwise(F.split(text, _ENDS))


def n_words(text: Column) -> Column:
    """Number of words that are not only blanks; each character of a text with unspaced script counts."""
    return F.when(_unspaced(text), F.length(text)).otherwise(F.size(F.array_remove(F.split(F.replace(text, F.lit("\n"), F.lit(" ")), " "), "")))


def _rotated(h: Column) -> Column:
    """The bits moved up by one, the highest to the bottom."""
    return F.shiftleft(h, 1).bitwiseOR(F.shiftrightunsigned(h, 63))


def cut(text: Column) -> Column:
    """The text's chunks in order, as an array of strings."""

    def lowest(r: Column, i: Column) -> Column:
        here = F.get(r, i)
        # nearly all such minima are negative, and a sign is read faster than neighbours are compared
        out = (here < 0) & (here < F.get(r, i - 1)) & (here <= F.get(r, i + 1))
        for k in range(2, REACH + 1):
            out = out & (here < F.get(r, i - k)) & (here <= F.get(r, i + k))
        return out  # null near the ends, where no chunk begins

    def rolling(h: Column) -> Column:
        """A hash of each ``ROLL`` successive line hashes, from the left; null where fewer are left."""
        out = h
        for k in range(1, ROLL):
            out = F.zip_with(out, F.slice(h, F.lit(1 + k), F.size(h)), lambda a, b: _rotated(a).bitwiseXOR(b))
        return out

    def chunks(w: Column) -> Column:
        hashes = F.transform(w, lambda x: F.xxhash64(x))
        marked = let(let(hashes, rolling), lambda r: F.transform(w, lambda x, i: F.when(lowest(r, i), F.concat(F.lit(_MARK), x)).otherwise(x)))
        return F.split(F.array_join(marked, ""), _MARK)

    held = F.contains(text, F.lit(_MARK)) | F.contains(text, F.lit(_ESCAPE))
    safe = F.replace(F.replace(text, F.lit(_ESCAPE), F.lit(_ESCAPE + "b")), F.lit(_MARK), F.lit(_ESCAPE + "a"))
    undo = lambda c: F.replace(F.replace(c, F.lit(_ESCAPE + "a"), F.lit(_MARK)), F.lit(_ESCAPE + "b"), F.lit(_ESCAPE))
    return F.when(held, F.transform(let(lines(safe), chunks), undo)).when(text.isNotNull(), let(lines(text), chunks))


def _runs(places: Column, min_chars: int) -> Column:
    """Runs of successive chunks as longs (first number in the upper 32 bits, last in the lower), from the sorted places
    (see ``_place``), if they are long enough."""

    def number(p: Column, i: Column) -> Column:
        return F.shiftright(F.get(p, i), 16)

    def long_enough(p: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(p) - 1)
        first = F.filter(at, lambda i: (i == 0) | (number(p, i - 1) != number(p, i) - 1))
        last = F.filter(at, lambda i: (i == F.size(p) - 1) | (number(p, i + 1) != number(p, i) + 1))
        total = lambda x, field: F.aggregate(F.slice(p, x["a"] + 1, x["b"] - x["a"] + 1), F.lit(0).cast("long"), lambda t, y: t + field(y))
        n, s = (lambda y: F.shiftright(y, 8).bitwiseAND(F.lit(255))), (lambda y: y.bitwiseAND(F.lit(255)))
        runs = F.filter(F.zip_with(first, last, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda x: (total(x, n) >= MIN_WORDS) & (total(x, s) >= min_chars))
        return F.transform(runs, lambda x: F.shiftleft(number(p, x["a"]), 32).bitwiseOR(number(p, x["b"]).cast("long")))

    return let(places, long_enough)


def _first(run: Column) -> Column:
    return F.shiftright(run, 32).cast("int")


def _last(run: Column) -> Column:
    return run.bitwiseAND(F.lit((1 << 32) - 1)).cast("int")


def _rows_for(n: int) -> int:
    """Rows of the bit table for ``n`` hashes: a power of two of about ``BITS`` bits a hash, within bounds."""
    return min(max(1 << (n * BITS // 64).bit_length(), LEAST_ROWS), MOST_ROWS)


def _marked(cells: DataFrame, often: DataFrame) -> DataFrame:
    """The cells whose hash is in ``often``, and some others: a hash is one bit of the table, so that the texts of chunks that occur
    once are not shuffled. The table grows with the repeated hashes, up to a bound; beyond it more cells pass, and are compared."""
    rows = _rows_for(often.count())
    place, bit = F.pmod(F.shiftright("h", 6), F.lit(rows)), F.pmod("h", F.lit(64)).cast("int")
    marks = often.groupBy(place.alias("_place")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("_bits"))
    out = cells.join(F.broadcast(marks), place == F.col("_place"))
    return out.where(F.call_function("shiftright", F.col("_bits"), bit).bitwiseAND(F.lit(1).cast("long")) == 1).drop("_place", "_bits")


def _order() -> Column:
    """One number that orders documents by doc_id d (none: last) and text hash t (61 of its bits). A number, since aggregates of
    structs and strings sort their rows."""
    doc = F.coalesce(F.col("d").cast("decimal(20,0)"), F.lit(str(1 << 63)).cast("decimal(20,0)"))
    return doc * F.lit(1 << 61).cast("decimal(19,0)") + F.shiftrightunsigned("t", 3)


def _place() -> Column:
    """A chunk's number in its text, with its words and characters (up to 255 each, which is all that ``_runs`` asks for) in the
    lower bits: places in order are numbers in order."""
    least = lambda c: F.least(c, F.lit(255)).cast("long")
    return F.shiftleft(F.col("no").cast("long"), 16).bitwiseOR(F.shiftleft(least(n_words(F.col("chunk"))), 8)).bitwiseOR(least(F.length("chunk")))


def _repeats(places: Column) -> Column:
    """Places whose chunk came before: all of a chunk whose first document is another, all but the lowest of one whose first is this
    (these have the chunk's hash h and its number c among chunks of that hash)."""
    own = F.sort_array(F.filter(places, lambda p: p["h"].isNotNull()))
    later = let(own, lambda o: F.filter(o, lambda p, i: (i > 0) & (F.get(o, i - 1)["h"] == p["h"]) & (F.get(o, i - 1)["c"] == p["c"])))
    both = F.concat(F.filter(places, lambda p: p["h"].isNull()), later)
    return F.sort_array(F.transform(both, lambda p: p["place"]))


def repeated(whole: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Stored table (_d, _t, gone) from a stored one (_k, _cut): for each document that loses chunks, its key and the runs of these."""
    whole = whole.select(F.col("_k.d").alias("d"), F.col("_k.h").alias("t"), "_cut")
    counts = whole.select(F.explode("_cut").alias("chunk")).groupBy(F.xxhash64("chunk").alias("h")).agg(F.count("*").alias("k"))
    often = stored(counts.where("k > 1").select("h"), "repeated-hashes")
    cells = whole.select("d", "t", F.posexplode("_cut").alias("no", "chunk")).withColumn("h", F.xxhash64("chunk"))
    cells = stored(_marked(cells, often).select("d", "t", _place().alias("place"), "h", "chunk"), "repeated-places", "zstd")
    # grouping by the chunk itself compares the bytes
    texts = cells.groupBy("h", "chunk").agg(F.count("*").alias("k"), F.min(_order()).alias("first"))
    groups = texts.groupBy("h").agg(F.count("*").alias("texts"), F.sum("k").alias("k"), F.min("first").alias("first"))
    groups = stored(groups.where("k > 1"), "repeated-chunks")
    # shuffled at any size: the table holds every repeated chunk and outgrows a broadcast early
    narrow = cells.select("d", "t", "place", "h")
    places = narrow.join(groups.where("texts = 1").select("h", "first").hint("merge"), "h").withColumn("c", F.lit(0).cast("long"))
    shared = groups.where("texts > 1").select("h")
    if not shared.isEmpty():
        # different chunks of one hash: each is a group of its own, met by its bytes
        own = cells.join(shared, "h", "left_semi")
        each = own.groupBy("h", "chunk").agg(F.count("*").alias("k"), F.min(_order()).alias("first")).where("k > 1").drop("k")
        places = places.unionByName(own.join(each, ["h", "chunk"]).select(*narrow.columns, "first", F.xxhash64(F.lit(1), "chunk").alias("c")))
    place = F.struct(F.when(_order() == F.col("first"), F.col("h")).alias("h"), "c", "place")
    gone = places.groupBy(F.col("d").alias("_d"), F.col("t").alias("_t")).agg(F.collect_set(place).alias("p"))
    # a generated row is made once; a plain column would be made again wherever it is named
    gone = gone.select("_d", "_t", F.inline(F.array(F.struct(_repeats(F.col("p")).alias("p"))))).where(F.size("p") > 0)
    gone = stored(gone.select("_d", "_t", _runs(F.col("p"), min_chars).alias("gone")).where(F.size("gone") > 0), "gone-chunks")
    discard(often, cells, groups)
    return gone


def _between(chunks: Column, gone: Column, inside: bool) -> Column:
    """The chunks inside the runs ``gone``, or those outside, in order; the work is linear in both."""
    if inside:
        return F.flatten(F.transform(gone, lambda g: F.slice(chunks, _first(g) + 1, _last(g) - _first(g) + 1)))
    after = lambda i: F.when(i == 0, 0).otherwise(_last(F.get(gone, i - 1)) + 1)
    until = lambda i: F.when(i == F.size(gone), F.size(chunks)).otherwise(_first(F.get(gone, i)))
    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(gone)), lambda i: F.slice(chunks, after(i) + 1, until(i) - after(i))))


def without_repeats(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """All rows of ``docs``; text lacks the repeated chunks. Adds _removed (characters taken out) and _n_removed (chunks)."""
    # texts are cut once and kept as chunks from here on
    whole = stored(put(with_row_key(packed(docs)), _cut=cut(F.col("text"))).drop("text"), "line-chunks", "zstd")
    gone = repeated(whole, min_chars)
    out = whole.join(small(gone, array="gone"), F.col("_k.d").eqNullSafe(F.col("_d")) & (F.col("_k.h") == F.col("_t")), "left")
    some, chunks = F.col("gone").isNotNull(), F.col("_cut")
    kept = F.when(some, _between(chunks, F.col("gone"), False)).otherwise(chunks)
    lost = F.when(some, F.length(F.array_join(_between(chunks, F.col("gone"), True), ""))).otherwise(0)
    total = F.when(some, F.aggregate("gone", F.lit(0), lambda t, g: t + _last(g) - _first(g) + 1)).otherwise(0)
    out = out.select("*", F.inline(F.array(F.struct(F.array_join(kept, "").alias("_new"), lost.alias("_lost"), total.alias("_n")))))
    out = put(out, _removed=F.col("_lost"), _n_removed=F.col("_n"), text=F.col("_new"))
    return unpacked(out, docs.columns, "_removed", "_n_removed")


def op6(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = without_repeats(docs)
    return out.select("doc_id", F.length("text").cast("long").alias("kept_chars"), F.col("_removed").cast("long").alias("removed_chars"), F.col("_n_removed").cast("long").alias("removed_chunks"), F.sha2("text", 256).alias("text_sha256"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose repeated chunks and n_chars follows; a document of which nothing is left goes."""
    out = without_repeats(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.where("_removed = 0 or length(trim(text)) > 0").select(docs.columns)
