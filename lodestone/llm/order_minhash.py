"""Order MinHash fingerprints, with DataFrame functions only.

A text's k-mers are its shingles of `k` words (fewer words: the whole sequence), each numbered by
how often it has occurred before, so repetitions count. Every numbered k-mer has a place on a
circle of hashes. Tuple j of the signature is made of the `picked` k-mers that come first after
the j-th of `tuples` equally spaced points, which are the minimal ones under the order that starts
there; they are put back into the order of the text and hashed together. So a shared tuple needs
the same k-mers in the same order, and the share of equal tuples falls with the edit distance,
which a plain MinHash of the set would not see for moved passages.

One sort of a text's hashes serves all points: neighbouring tuples may share k-mers, which leaves
the expected share of equal tuples as it is under independent orders and makes it vary little more
(a test compares both). Repeated k-mers are numbered by a sort and runs, without pairs; nothing
leaves the text's row. Only the next document's text is moved, by one shuffle in blocks of
neighbouring ids, whose bounds come from a sample.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from .common import ROW_KEY, materialize, stable, with_row_key

#: Words of a k-mer, tuples of a signature (a power of two), k-mers of a tuple.
K, TUPLES, PICKED = 5, 64, 2
#: Documents and bytes of a block that is sorted together, about, blocks at most, and rows of the
#: sample for each bound between blocks. All that is gathered or seen by one task is bounded by these.
BLOCK_ROWS, BLOCK_BYTES, MOST_BLOCKS, SAMPLE = 2_048, 32 << 20, 20_000, 20
#: Low bits of a packed long that hold a k-mer's position.
_AT = 24
_POSITION, _PLACE = (1 << _AT) - 1, (1 << 63) - (1 << _AT)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def _kmers(words: Column, k: int) -> Column:
    def shingles(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - k), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)]))

    return _let(words, lambda w: F.when(F.size(w) >= k, _let(F.transform(w, lambda x: F.xxhash64(x)), shingles)).when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<long>")))


def _numbered(kmers: Column) -> Column:
    """Sorted places on the circle, with the position in the low bits, of occurrence-numbered k-mers."""
    place = lambda kmer, number, at: F.xxhash64(F.shiftright(kmer, _AT), number).bitwiseAND(F.lit(_PLACE)).bitwiseOR(at)

    def repeated(s: Column) -> Column:
        kmer = lambda i: F.shiftright(F.get(s, i), _AT)
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (kmer(i) != kmer(i - 1)))
        runs = lambda b: F.transform(b, lambda x, j: F.sequence(F.lit(0), F.coalesce(F.get(b, j + 1), F.size(s)) - x - 1))
        return _let(F.flatten(_let(starts, runs)), lambda number: F.transform(s, lambda x, i: place(x, F.get(number, i), x.bitwiseAND(F.lit(_POSITION)))))

    packed = lambda h: F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(F.lit(~_POSITION)).bitwiseOR(i.cast("long"))))
    once = lambda h: F.transform(h, lambda x, i: place(x, F.lit(0), i.cast("long")))
    return _let(kmers, lambda h: F.sort_array(F.when(F.size(F.array_distinct(h)) == F.size(h), once(h)).otherwise(_let(packed(h), repeated))))


def signature(text: Column, k: int = K, tuples: int = TUPLES, picked: int = PICKED) -> Column:
    """Array of `tuples` ints; a text without words has the same one as any other."""
    arc = 63 - int(math.log2(tuples))
    of = lambda x: F.shiftright(x, arc)

    def first(q: Column) -> Column:
        """The first `picked` of each arc: all that can come first after any point."""
        return F.filter(q, lambda x, i: (i < picked) | (of(x) != of(F.get(q, i - picked))))

    def tuple_after(e: Column, arcs: Column, j: Column) -> Column:
        at = F.array_position(arcs, j)
        start = F.when(at > 0, at.cast("int") - 1).otherwise(F.size(F.filter(arcs, lambda b: b < j)))
        chosen = F.transform(F.sequence(F.lit(0), F.least(F.lit(picked), F.size(e)) - 1), lambda i: F.get(e, (start + i) % F.size(e)))
        swapped = F.transform(chosen, lambda x: F.shiftleft(x.bitwiseAND(F.lit(_POSITION)), 63 - _AT).bitwiseOR(F.shiftright(x, _AT)))
        in_order = F.transform(F.sort_array(swapped), lambda x: x.bitwiseAND(F.lit((1 << (63 - _AT)) - 1)))
        return F.xxhash64(in_order).bitwiseAND(F.lit(0xFFFFFFFF))

    points = F.array(*[F.lit(j).cast("long") for j in range(tuples)])
    tuples_of = lambda e: _let(F.transform(e, of), lambda arcs: F.transform(points, lambda j: tuple_after(e, arcs, j)))
    empty = F.transform(points, lambda j: F.lit(0).cast("long"))
    full = _let(_let(_numbered(_kmers(_words(text), k)), first), lambda e: F.when(F.size(e) > 0, tuples_of(e)).otherwise(empty))
    return full


def fingerprint(sig: Column) -> Column:
    return F.lower(F.array_join(F.transform(sig, lambda x: F.lpad(F.hex(x), 8, "0")), ""))


def likeness(a: Column, b: Column, tuples: int = TUPLES) -> Column:
    """Share of equal tuples."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x) / F.lit(float(tuples))


def _bounds(order: DataFrame, blocks: int, count: int) -> list:
    """At most blocks - 1 rows, sorted, that cut the rows of `order` (structs `at`) into blocks of about one size.

    They come from a sample of SAMPLE rows a block, chosen by hash.
    """
    share = min(1.0, SAMPLE * blocks / max(1, count))
    sample = order.where(F.shiftrightunsigned(F.xxhash64("at"), 2) < F.lit(int(share * (1 << 62)))).select("at")
    number = F.row_number().over(Window.partitionBy().orderBy("at"))  # of the sample only
    picked = sample.withColumn("n", number).withColumn("all", F.count("*").over(Window.partitionBy()))
    edge = F.floor(F.col("n") * blocks / F.col("all"))
    picked = picked.withColumn("edge", edge).groupBy("edge").agg(F.min("at").alias("at"))
    return [tuple(r[0]) for r in picked.where("edge > 0").select("at").distinct().orderBy("at").collect()]


def _block(at: Column, bounds: Column, n: int) -> Column:
    """How many of the `n` sorted `bounds` aren't above `at`, by halving."""
    start = F.struct(F.lit(0).alias("lo"), F.lit(n).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        middle = ((s["lo"] + s["hi"]) / 2).cast("int")
        above = F.get(bounds, middle) > at
        return F.when(s["lo"] >= s["hi"], s).otherwise(F.struct(F.when(above, s["lo"]).otherwise(middle + 1).alias("lo"), F.when(above, middle).otherwise(s["hi"]).alias("hi")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(n.bit_length())), start, halve, lambda s: s["lo"])


def with_next(docs: DataFrame, order: list[str], carried: list[str], blocks: int | None = None) -> DataFrame:
    """`docs` with next_<c> for each carried column: that of the next row in `order`, after the last the first.

    `order` are columns without nulls that tell all rows apart. Rows are dealt to blocks of
    neighbours by one shuffle; the first row of each block also goes to the block before, behind
    its last row. What is gathered is a bounded number of bounds.
    """
    at = F.struct(*order)
    size = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    blocks = blocks or max(1, min(MOST_BLOCKS, math.ceil(max(size[0] / BLOCK_ROWS, (size[1] or 0) / BLOCK_BYTES))))
    kind = ArrayType(docs.select(*order).schema)
    found = _bounds(docs.select(at.alias("at")), blocks, size[0])
    # one string in the plan, not a list of literals
    bounds = F.from_json(F.lit(json.dumps([dict(zip(order, b)) for b in found])), kind)
    block = _block(F.col("_order"), bounds, len(found)) if found else F.lit(0)
    rows = docs.withColumn("_order", at).withColumn("_block", block)
    # a row per block: the first of each block, and the block that ends before it
    heads = materialize(rows.groupBy("_block").agg(F.min("_order").alias("_head")), "block-heads")
    every = Window.partitionBy()
    heads = heads.select("_head", F.coalesce(F.lag("_block").over(every.orderBy("_block")), F.max("_block").over(every)).alias("_before"))
    rows = rows.join(F.broadcast(heads), rows["_order"] == heads["_head"], "left")
    place = lambda b, copy: F.struct(b.alias("block"), F.lit(copy).alias("copy"))
    places = F.when(F.col("_before").isNull(), F.array(place(F.col("_block"), 0))).otherwise(F.array(place(F.col("_block"), 0), place(F.col("_before"), 1)))
    rows = rows.select(*docs.columns, F.explode(places).alias("_at")).select(*docs.columns, F.col("_at.block").alias("_block"), F.col("_at.copy").alias("_copy"))
    in_block = Window.partitionBy("_block").orderBy("_copy", *order)
    rows = rows.select(*docs.columns, "_copy", *[F.lead(c).over(in_block).alias(f"next_{c}") for c in carried])
    return rows.where("_copy = 0").drop("_copy")


def fingerprints(docs: DataFrame, k: int = K, tuples: int = TUPLES, picked: int = PICKED) -> DataFrame:
    """doc_id, text (null: empty), n_chars and sig of each row of `docs` (doc_id, text)."""
    return _signed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), k, tuples, picked)


def _signed(rows: DataFrame, k: int, tuples: int, picked: int) -> DataFrame:
    rows = rows.withColumn("text", F.coalesce("text", F.lit("")))
    return rows.select("*", F.char_length("text").cast("long").alias("n_chars"), signature(F.col("text"), k, tuples, picked).alias("sig"))


def edit_report(docs: DataFrame, k: int = K, tuples: int = TUPLES, picked: int = PICKED) -> DataFrame:
    """One row per row of `docs`: its fingerprint, that of its edited text, and their likenesses.

    The edited text has the last half of the code points replaced by the start of the next
    document. Null and empty texts have the fingerprint of a text without words; a null doc_id
    comes first; rows that repeat a doc_id are ordered by their texts' hashes, then by their places. Texts of more than
    2^24 words count positions modulo that. Other columns are ignored; an empty table gives no rows.
    Bounds of blocks are found before this returns.
    """
    rows = with_row_key(stable(docs), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumns({"_null": F.col("doc_id").isNotNull(), "_id": F.coalesce("doc_id", F.lit(0)), "_hash": F.xxhash64("text")})
    rows = with_next(_signed(rows, k, tuples, picked), ["_null", "_id", "_hash", *ROW_KEY], ["text", "sig"])
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.select("doc_id", "n_chars", "sig", "next_sig", edited.alias("edited"))
    rows = rows.select("doc_id", "n_chars", "sig", "next_sig", F.sha2(F.col("edited"), 256).alias("edited_sha256"), signature(F.col("edited"), k, tuples, picked).alias("edited_sig"))
    return rows.select("doc_id", "n_chars", "edited_sha256", fingerprint(F.col("sig")).alias("fingerprint"), fingerprint(F.col("edited_sig")).alias("edited_fingerprint"), likeness(F.col("sig"), F.col("edited_sig"), tuples).alias("near_edited"), likeness(F.col("sig"), F.col("next_sig"), tuples).alias("near_next"))
