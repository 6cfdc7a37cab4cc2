"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text.

The model's units are UTF-8 bytes and its order is 5, so an n-gram is an exact integer key, and a
text of any language has whole contexts. Trusted text is that of documents labelled good and not
toxic; counts cover all of it, but for a tenth-wise share held out to set thresholds.

Counts are Spark tables sharded by n-gram. All n-grams of the corpus get their probability by
joins with the counts of their own and lower orders, from the unigrams up. Scoring cuts each
task's texts into blocks of so many bytes, compressed; a block asks for each of its n-grams once,
by a join, and adds up the logarithms that come back per document. So what moves is about half
a text and far fewer n-grams than positions, and blocks are as large as each other whatever the
ids and sizes of the documents. A document's excess is what it needs in bits a byte
above the median of its language's held-out trusted documents, times the root of its length: bits
a byte of clean texts spread by one over that root, so one quantile of the excess serves texts of
every length. A document is rejected if its excess is above that quantile.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW_KEY, few, materialize, stable, with_row_key, without_rows

ORDER = 5
#: Bytes of text of a block, about (a longer text is a block of its own), and partitions at most
#: that blocks are dealt to.
BLOCK_BYTES, MOST_PARTITIONS = 32 << 20, 50_000
#: Bytes whose n-grams are counted together, and those whose n-grams are looked up together: each takes up to
#: some sixty bytes of a worker's memory. N-grams that are gathered before they are merged.
CHUNK, LOOKUP, GATHERED = 1 << 20, 256 << 10, 1 << 20
#: Of ten trusted documents so many train; the others set thresholds.
TRAIN_TENTHS = 8
#: Share of a language's held-out trusted documents that its threshold lets pass. Languages with
#: fewer held-out documents than LEAST_DOCS use the threshold of all.
QUANTILE, LEAST_DOCS = 0.995, 50


def _keys(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """N-gram ending at each byte of each piece after its first ORDER - 1, and the piece it is of."""
    pad = ORDER - 1
    raw = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    sizes = np.array([len(p) for p in pieces], dtype=np.int64)
    # pairs, then fours, then the whole: small numbers as long as they will do
    two = raw[1:] | raw[:-1].astype(np.uint16) << 8
    four = two[2:] | two[:-2].astype(np.uint32) << 16
    keys = four[1:] | raw[:-4].astype(np.int64) << 32
    real = np.ones(len(raw), dtype=bool)
    starts = np.cumsum(sizes) - sizes
    for i in range(pad):
        real[starts + i] = False
    return keys[real[pad:]], np.repeat(np.arange(len(pieces)), sizes - pad)


def _distinct(keys: np.ndarray) -> np.ndarray:
    ordered = np.sort(keys)
    return ordered[np.concatenate(([True], ordered[1:] != ordered[:-1]))] if len(ordered) else ordered


def _chunks(texts: Iterable[bytes], most: int) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Runs of about `most` bytes of pieces, and the text that each is of.

    A piece begins with the ORDER - 1 bytes before it, NULs at the start of a text; long texts are
    in several.
    """
    pad, size = ORDER - 1, 0
    owners: list[int] = []
    pieces: list[bytes] = []
    for i, text in enumerate(texts):
        whole = b"\0" * pad + text
        for at in range(0, len(text), most):
            owners.append(i)
            pieces.append(whole[at : at + most + pad])
            size += len(pieces[-1])
            if size >= most:
                yield np.array(owners), pieces
                owners, pieces, size = [], [], 0
    if pieces:
        yield np.array(owners), pieces


def gram_counts(texts: DataFrame) -> DataFrame:
    """(gram, n): the n-grams of all `texts` (text, trusted), with their occurrences in trusted ones.

    They are summed per chunk before they move. Without a column `trusted` all texts are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            marks = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for mark in (True, False):
                texts = b.column(0).filter(pa.array(marks == mark))
                for _, some in _chunks(((t.as_py() or "").encode() for t in texts), CHUNK):
                    grams, n = np.unique(_keys(some)[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(n * mark)], names=["gram", "n"])

    mark = F.col("trusted") if "trusted" in texts.columns else F.lit(True)
    rows = texts.select(F.col("text").cast("string").alias("text"), F.coalesce(mark, F.lit(False)).alias("trusted"))
    return rows.mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


class Model:
    """Counts of every order as tables (gram, n), the statistics of their contexts, and discounts.

    Orders below the highest count the different grams that end in theirs, as Kneser-Ney has it.
    """

    def __init__(self, grams: DataFrame):
        """`grams` may have n-grams of no occurrence, which count nowhere but can be asked for."""
        self.grams = materialize(grams, "lm-grams")
        self.counts = {ORDER: self.grams.where("n > 0")}
        for k in range(ORDER - 1, 0, -1):
            low = self.counts[k + 1].groupBy(F.col("gram").bitwiseAND(F.lit((1 << (8 * k)) - 1)).alias("gram")).agg(F.count("*").alias("n"))
            self.counts[k] = materialize(low, f"lm-{k}")
        self.discounts = {k: self._discounts(t) for k, t in self.counts.items()}
        self.contexts = {k: self._contexts(t) for k, t in self.counts.items()}

    @staticmethod
    def _discounts(table: DataFrame) -> tuple[float, float, float]:
        t = table.agg(*[F.count_if(F.col("n") == i) for i in (1, 2, 3, 4)]).first()
        if not all(t):
            return 0.5, 0.75, 0.9
        y = t[0] / (t[0] + 2 * t[1])
        found = (1 - 2 * y * t[1] / t[0], 2 - 3 * y * t[2] / t[1], 3 - 4 * y * t[3] / t[2])
        return tuple(min(max(d, 0.05), i - 0.05) for i, d in enumerate(found, start=1))

    @staticmethod
    def _contexts(table: DataFrame) -> DataFrame:
        one = [F.count_if(F.col("n") == i).alias(f"n{i}") for i in (1, 2)]
        return table.groupBy(F.shiftright("gram", 8).alias("context")).agg(F.sum("n").alias("total"), *one, F.count_if(F.col("n") >= 3).alias("n3"))

    def probabilities(self, asked: DataFrame) -> DataFrame:
        """(gram, p) for the n-grams of `asked` (gram, distinct)."""
        lower = {ORDER: asked}
        for k in range(ORDER - 1, 0, -1):
            lower[k] = lower[k + 1].select(F.col("gram").bitwiseAND(F.lit((1 << (8 * k)) - 1)).alias("gram")).distinct()
        below = None
        for k in range(1, ORDER + 1):
            d = self.discounts[k]
            rows = lower[k].join(self.counts[k], "gram", "left").withColumn("context", F.shiftright("gram", 8))
            rows = rows.join(self.contexts[k], "context", "left").withColumn("suffix", F.col("gram").bitwiseAND(F.lit((1 << (8 * (k - 1))) - 1)))
            if below is not None:
                rows = rows.join(below.withColumnsRenamed({"gram": "suffix", "p": "q"}), "suffix")
            else:
                rows = rows.withColumn("q", F.lit(1 / 256))
            n = F.coalesce("n", F.lit(0))
            taken = F.when(n >= 3, d[2]).when(n == 2, d[1]).when(n == 1, d[0]).otherwise(0.0)
            left = d[0] * F.col("n1") + d[1] * F.col("n2") + d[2] * F.col("n3")
            p = F.when(F.col("total").isNull(), F.col("q")).otherwise((n - taken + left * F.col("q")) / F.col("total"))
            below = rows.select("gram", p.alias("p"))
        return below


_OWN = ("doc_id", *ROW_KEY, "lang")


def _blocks(docs: DataFrame) -> DataFrame:
    """Rows (block, doc_id, ROW_KEY, lang, sizes, texts), each a compressed run of documents of one task.

    A block's number is that of its task and its own there, so a task that is run again makes the
    same blocks.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    kinds = pa.schema([("block", pa.int64()), *((c, pa.list_(pa.string() if c == "lang" else pa.int64())) for c in _OWN), ("sizes", pa.list_(pa.int64())), ("texts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=5)
        number, held, sizes, stream, parts = TaskContext.get().partitionId() << 32, [[] for _ in _OWN], [], squeeze.compressobj(), []

        def done() -> pa.RecordBatch:
            nonlocal number, held, sizes, stream, parts
            columns = [[number], *([c] for c in held), [sizes], [b"".join([*parts, stream.flush()])]]
            number, held, sizes, stream, parts = number + 1, [[] for _ in _OWN], [], squeeze.compressobj(), []
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds)], schema=kinds)

        size = 0
        for b in batches:
            own = [b.column(i).to_pylist() for i in range(len(_OWN))]
            for i, text in enumerate(b.column(len(_OWN))):
                raw = (text.as_py() or "").encode()
                if sizes and size + len(raw) > BLOCK_BYTES:
                    yield done()
                    size = 0
                for c, values in zip(held, own):
                    c.append(values[i])
                sizes.append(len(raw))
                parts.append(stream.compress(raw))  # a block's texts are never held as a whole
                size += len(raw)
        if sizes:
            yield done()

    ddl = "block long, doc_id array<long>, " + ", ".join(f"{c} array<long>" for c in ROW_KEY) + ", lang array<string>, sizes array<long>, texts binary"
    parts = min(MOST_PARTITIONS, max(1, 2 * math.ceil(size / BLOCK_BYTES)))
    packed = docs.select(*_OWN, "text").mapInArrow(run, ddl)
    return packed.repartition(parts, "block").sortWithinPartitions("block")


def _texts(blob: bytes, sizes) -> list[memoryview]:
    import zstandard

    total = int(sum(sizes))
    raw = memoryview(zstandard.ZstdDecompressor().decompress(blob, max_output_size=max(total, 1)))
    ends = np.cumsum(sizes).tolist()
    return [raw[e - n : e] for e, n in zip(ends, sizes)]


def _distinct_of(texts: list) -> np.ndarray:
    """The different n-grams of `texts`."""
    held, more = np.zeros(0, dtype=np.int64), []
    for _, some in _chunks(texts, LOOKUP):
        more.append(_distinct(_keys(some)[0]))
        if sum(map(len, more)) > GATHERED:
            held, more = _distinct(np.concatenate((held, *more))), []
    return _distinct(np.concatenate((held, *more)))


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, gram): the different n-grams of each block."""
    for b in batches:
        at = b.schema.get_field_index("sizes")
        for i in range(b.num_rows):
            held = _distinct_of(_texts(b.column(at + 1)[i].as_py(), b.column(at)[i].as_py()))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(held), b.column(0)[i].as_py(), dtype=np.int64)), pa.array(held)], names=["block", "gram"])


def _score(_, docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    """Sum of the log2 probabilities of each document of a block."""
    grams = pd.Index(answers["gram"].to_numpy())
    logs = np.log2(np.maximum(answers["p"].to_numpy(), 1e-12))
    out = []
    for row in docs.itertuples(index=False):
        bits = np.zeros(len(row.sizes))
        for owners, some in _chunks(_texts(row.texts, row.sizes), LOOKUP):
            keys, piece = _keys(some)
            if len(keys):
                bits += np.bincount(owners[piece], weights=logs[grams.get_indexer(keys)], minlength=len(bits))
        held = dict(zip(docs.columns, row))
        ids = {c: pd.array(list(held[c]), dtype="Int64") for c in _OWN[:-1]}
        out.append(pd.DataFrame({**ids, "lang": list(held["lang"]), "n_bytes": np.asarray(row.sizes, dtype=np.int64), "bits": -bits}))
    return pd.concat(out)


def train(docs: DataFrame, labels: DataFrame) -> tuple[Model, DataFrame]:
    """The model, and the trusted ids (doc_id, held_out)."""
    good = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    good = good.where("quality > 0 and toxic = 0").select("doc_id", (F.pmod(F.xxhash64("doc_id"), F.lit(10)) >= TRAIN_TENTHS).alias("held_out"))
    good = materialize(good, "lm-trusted")
    ids = good.where("not held_out").select("doc_id", F.lit(True).alias("trusted"))
    marked = docs.join(few(ids), "doc_id", "left")
    return Model(gram_counts(marked.select("text", "trusted"))), good


def perplexities(docs: DataFrame, model: Model, grams: DataFrame | None = None) -> DataFrame:
    """doc_id, ROW_KEY (null if `docs` has none), lang, n_bytes, perplexity (per byte; null of an empty text) of each row.

    `grams` (gram, distinct) are all n-grams of the texts; they are gathered if not given.
    """
    if grams is None:
        grams = gram_counts(docs)
    known = materialize(model.probabilities(grams.select("gram")), "lm-p")
    for c in ROW_KEY:
        docs = docs if c in docs.columns else docs.withColumn(c, F.lit(None).cast("long"))
    packed = _blocks(docs)
    answers = packed.mapInArrow(_asked, "block long, gram long").join(known.hint("shuffle_hash"), "gram").select("block", "gram", "p")
    longs = ", ".join(f"{c} long" for c in _OWN[:-1])
    scored = packed.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(_score, f"{longs}, lang string, n_bytes long, bits double")
    return scored.select(*_OWN, "n_bytes", F.when(F.col("n_bytes") > 0, F.pow(F.lit(2.0), F.col("bits") / F.col("n_bytes"))).alias("perplexity"))


def _judged(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """What `classify` returns of each row of a stable frame, with its ROW_KEY."""
    rows = with_row_key(docs, F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    model, good = train(rows, labels)
    scores = materialize(perplexities(rows, model, model.grams), "lm-scores")
    held = scores.join(good.where("held_out").select("doc_id"), "doc_id", "left_semi").where("perplexity is not null")
    held = materialize(held.select("lang", "n_bytes", F.log2("perplexity").alias("bits")), "lm-held")
    middle, at = F.percentile_approx("bits", F.lit(0.5), F.lit(10_000)), F.percentile_approx("excess", F.lit(quantile), F.lit(10_000))
    excess = (F.col("bits") - F.col("middle")) * F.sqrt("n_bytes")
    every = held.agg(middle.alias("middle")).first()[0]
    most = held.withColumn("middle", F.lit(every).cast("double")).withColumn("excess", excess).agg(at).first()[0]
    middles = held.groupBy("lang").agg(middle.alias("middle"), F.count("*").alias("n")).where(F.col("n") >= LEAST_DOCS).select(F.col("lang").alias("_lang"), "middle")
    own = held.join(F.broadcast(middles), F.col("lang").eqNullSafe(F.col("_lang"))).withColumn("excess", excess)
    own = materialize(own.groupBy("_lang").agg(F.first("middle").alias("middle"), at.alias("most")), "lm-limits")
    found = scores.join(F.broadcast(own), F.col("lang").eqNullSafe(F.col("_lang")), "left")
    one = lambda c, default: F.coalesce(F.col(c), F.lit(default).cast("double"))
    limit = F.when(F.col("n_bytes") > 0, one("middle", every) + one("most", most) / F.sqrt("n_bytes"))
    kept = F.col("perplexity").isNotNull() & F.coalesce(F.log2("perplexity") <= limit + 1e-12, F.lit(True))
    return found.select("doc_id", *ROW_KEY, "lang", "n_bytes", "perplexity", F.pow(F.lit(2.0), limit).alias("threshold"), kept.alias("kept"))


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """One row per row of `docs` (doc_id, lang, text): lang, n_bytes, perplexity, threshold, kept.

    Null and empty texts have no perplexity and are rejected. A null language is one of its own;
    null doc_ids are scored like others. Without trusted text every byte is as likely as any
    other, there are no thresholds, and all texts that aren't empty are kept. Repeated rows are
    scored each; other columns are ignored; an empty table gives no rows. The model is trained and
    the texts are scored before this returns.
    """
    return _judged(stable(docs), labels, quantile).drop(*ROW_KEY)


def accepted(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that `classify` keeps, each judged by its own text, with all their columns."""
    docs = stable(docs)
    return without_rows(docs, _judged(docs, labels, **options).where("not kept"), "lm-rejected")
