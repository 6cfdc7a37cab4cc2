"""Registered queries over the driver's tables, and their DuckDB counterparts.

Documents stand for files and `benchmark` texts for questions. Queries with vectors use the hash
that SQL can compute too. SQL has not the hash of `exact_embedding`, which a test holds against a
plain version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions import udfs
from ..operators import documents as d
from ..operators import citations, fulltext, ranked, rerank, shards, vectors
from ..session import scratch_folder
from ..sources import cascade
from ..sources.web import result_links
from ..streaming.ingest import DOCUMENTS as STREAMED
from ..streaming.ingest import stream_index
from .engine import Corpus, hybrid
from .store import stored


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one of fewer splits than there are cores, which is a small one, is dealt to all of them."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set."""
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))


def _stored(spark: SparkSession, sf_dir: str, name: str, make) -> DataFrame:
    """A table of the index over `documents`, made once and read by all queries."""
    return stored(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), name, make)


def _normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text and content_hash of every document; written before any filter, which would repeat the work."""
    rows = _table(spark, sf_dir, "documents").select("doc_id", t.normalize_text(F.coalesce("text", F.lit(""))).alias("text"))
    return _stored(spark, sf_dir, "normal", lambda: rows.withColumn("content_hash", t.content_hash(F.col("text"))))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.mark_duplicates(_normal(spark, sf_dir).where("text <> ''"), "doc_id", "doc_id")


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make() -> DataFrame:
        docs = _documents(spark, sf_dir).where("duplicate_of is null").withColumnRenamed("doc_id", "doc_no")
        rows = d.chunk_documents(docs.repartition(spark.sparkContext.defaultParallelism), "doc_no", normal=True).withColumn("doc_id", d.doc_id(F.col("doc_no")))
        return d.chunk_ids(rows).select(shards.chunk_no(F.col("doc_no"), F.col("chunk_index")).alias("chunk_no"), "chunk_id", "doc_id", "chunk_index", "text")

    return _stored(spark, sf_dir, "chunks", make)


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with their chunks' places, so that no join of all chunks has to find these."""
    return _stored(spark, sf_dir, "vectors", lambda: vectors.embed(shards.placed(_chunks(spark, sf_dir)), "native", "chunk_no", also=("shard", "place")))


def _index_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir, "index_rows", lambda: fulltext.index_rows(_chunks(spark, sf_dir)))


def _postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted by token, so a lookup of tokens reads few row groups."""
    return _stored(spark, sf_dir, "postings", lambda: fulltext.postings(_index_rows(spark, sf_dir)).sort("token"))


def _lists(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of posting lists."""
    chunks = _chunks(spark, sf_dir)
    make = {"vectors": lambda: shards.vectors(_vectors(spark, sf_dir)), "rows": lambda: shards.rows(shards.sizes(shards.placed(chunks))), "tokens": lambda: shards.tokens(shards.placed(chunks)), "runs": lambda: shards.runs(shards.placed(chunks))}
    return _stored(spark, sf_dir, f"shard-{name}", make[name])


#: The tables that retrieval reads.
INDEX = ("vectors", *(f"shard_{name}" for name in shards.TABLES))


def index_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return _vectors(spark, sf_dir) if name == "vectors" else _lists(spark, sf_dir, name.removeprefix("shard_"))


def content_hash_dedup(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", "content_hash", "duplicate_of")


def ingest_counters(spark, sf_dir):
    return d.ingest_counters(_documents(spark, sf_dir), _chunks(spark, sf_dir), _normal(spark, sf_dir).where("text = ''"))


def sources_report(spark, sf_dir):
    docs = _documents(spark, sf_dir).select(d.doc_id(F.col("doc_id")).alias("doc_id"), F.concat(F.lit("raw/"), F.col("doc_id").cast("string")).alias("file_path"), "content_hash", F.col("duplicate_of").cast("string").alias("duplicate_of"))
    return d.sources_report(docs, _chunks(spark, sf_dir))


def duplicate_files(spark, sf_dir):
    docs = _documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("file_path"), F.col("duplicate_of").cast("string").alias("duplicate_of"))
    return d.duplicate_files(docs)


def normalize_text(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", t.normalize_text(F.col("text")).alias("text"))


def chunk_documents(spark, sf_dir):
    return _chunks(spark, sf_dir).drop("chunk_no")


def embedding_terms_tf(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.explode(t.embedding_terms(F.col("text"))).alias("term"))
    return rows.groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def hash_embedding(spark, sf_dir):
    rows = _vectors(spark, sf_dir).withColumn("chunk_id", shards.chunk_id_of(F.col("chunk_no")))
    return rows.select("chunk_id", F.explode("embedding").alias("b")).select("chunk_id", "b.idx", "b.w")


def exact_embedding(spark, sf_dir):
    rows = vectors.embed(_chunks(spark, sf_dir), "exact")
    return rows.select("chunk_id", F.explode("embedding").alias("b")).select("chunk_id", "b.idx", "b.w")


def candidate_terms(spark, sf_dir):
    rows = _questions(spark, sf_dir).select("qid", udfs.candidate_terms("question").alias("terms")).select("qid", F.posexplode_outer("terms").alias("pos", "term"))
    return rows.where("term is not null").select("qid", (F.col("pos") + 1).cast("long").alias("pos"), "term")


def fts_index(spark, sf_dir):
    return _postings(spark, sf_dir)


def _named(found: DataFrame) -> DataFrame:
    """Ids in place of the numbers of chunks."""
    return found.withColumn("chunk_id", shards.chunk_id_of(F.col("chunk_no"))).drop("chunk_no")


def semantic_topk(spark, sf_dir):
    found = ranked.semantic_topk(_questions(spark, sf_dir), _lists(spark, sf_dir, "rows"), _lists(spark, sf_dir, "vectors"), mode="native")
    return _named(found).withColumn("semantic_score", F.round("semantic_score", 6))


def keyword_topk(spark, sf_dir):
    return _named(ranked.keyword_topk(_questions(spark, sf_dir), _lists(spark, sf_dir, "rows"), _lists(spark, sf_dir, "runs"), _chunks(spark, sf_dir)))


def keyword_index_topk(spark, sf_dir):
    """The same by posting lists alone, as few questions are answered."""
    return _named(ranked.keyword_topk(_questions(spark, sf_dir), _lists(spark, sf_dir, "rows"), _lists(spark, sf_dir, "runs"), _chunks(spark, sf_dir), scan_terms=1 << 40))


def bm25_topk(spark, sf_dir):
    found = ranked.bm25_topk(_questions(spark, sf_dir), _lists(spark, sf_dir, "rows"), _lists(spark, sf_dir, "tokens"))
    return _named(found).withColumn("fts_rank", F.round("fts_rank", 6))


def _hybrid(spark, sf_dir):
    corpus = Corpus(_chunks(spark, sf_dir), _vectors(spark, sf_dir), {name: _lists(spark, sf_dir, name) for name in shards.TABLES}, mode="native")
    return hybrid(corpus, _questions(spark, sf_dir))


_RANKED = ("qid", "chunk_id", "semantic_score", "keyword_score", "fts_score", "rerank_score", "rank")


def hybrid_rerank(spark, sf_dir):
    return _named(_hybrid(spark, sf_dir)).select(*_RANKED)


def evidence_gate(spark, sf_dir):
    return _named(rerank.gate(_hybrid(spark, sf_dir))).select("qid", "chunk_id", "rerank_score", "rank")


def sentence_citations(spark, sf_dir):
    """The best sentences of each source that passes the gates."""
    asked = _questions(spark, sf_dir).withColumn("terms", udfs.candidate_terms("question"))
    rows = rerank.gate(_hybrid(spark, sf_dir)).join(_chunks(spark, sf_dir), "chunk_no").join(asked, "qid")
    return citations.with_citation(rows).select("qid", "rank", "chunk_id", "citation")


def answer_struct(spark, sf_dir):
    """One answer per question, with or without evidence."""
    rows = sentence_citations(spark, sf_dir).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "citation"))).alias("s"))
    asked = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"))
    rows = asked.join(rows, "qid", "left").withColumn("citations", F.coalesce("s.citation", F.array().cast("array<string>")))
    kind = F.when(F.size("citations") > 0, "knowledge_base").otherwise("none")
    return citations.with_answer(rows).select("qid", "answer", kind.alias("source_type"), F.size("citations").alias("n_sources"), (kind == "none").alias("need_web_search"))


def split_sentences(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(t.split_sentences(udfs.unescape("text"))).alias("pos", "sentence"))
    return rows


def human_text_clean(spark, sf_dir):
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", t.human_text(udfs.unescape("text")).alias("text"))


def html_links_extract(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", F.size(result_links("html")).alias("n_results"))


def url_unwrap(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", t.unwrap_redirect(F.col("url")).alias("redirect"), t.unwrap_bing(F.col("url")).alias("bing"))


#: Letters that stand for CJK characters in texts made from documents, which have none themselves.
_LETTERS, _CHARACTERS = "aeinr", "光合作用水"


def cjk_terms(spark, sf_dir):
    """Embedding terms, with their counts, of documents in which some letters are CJK characters."""
    text = F.translate("text", _LETTERS, _CHARACTERS)
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.explode_outer(t.embedding_terms(text)).alias("term")).where("term is not null")
    return rows.groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def _redirect(url):
    return F.concat(F.lit("//duckduckgo.com/l/?uddg="), F.url_encode(url), F.lit("&rut=1"))


def unwrapped_links(spark, sf_dir):
    """Targets of redirect links of both kinds, made from the pages' addresses; each fifth is of neither."""
    coded = F.concat(F.lit("https://www.bing.com/ck/a?p=1&u=a1"), F.translate(F.base64(F.col("url").cast("binary")), "+/=", "-_"), F.lit("&ntb=1"))
    plain = F.col("page_id") % 5 == 0
    rows = _table(spark, sf_dir, "pages").select("page_id", F.when(plain, F.col("url")).otherwise(_redirect(F.col("url"))).alias("a"), F.when(plain, F.col("url")).otherwise(coded).alias("b"))
    return rows.select("page_id", t.unwrap_redirect(F.col("a")).alias("redirect"), t.unwrap_bing(F.col("b")).alias("bing"))


def result_pages(spark, sf_dir):
    """Titles, targets and snippets of result pages made from the pages; each third has a result without a snippet."""
    number = F.col("page_id").cast("string")
    title = F.concat(F.lit('<div><a class="x result__a" href="'), _redirect(F.col("url")), F.lit('">Page  <b>'), number, F.lit("</b> &amp; more</a>"))
    snippet = F.when(F.col("page_id") % 3 == 0, "").otherwise(F.concat(F.lit('<div class="result__snippet">Words  of <i>'), number, F.lit("</i></div>")))
    rows = _table(spark, sf_dir, "pages").select("page_id", F.explode_outer(result_links(F.concat(title, snippet, F.lit("</div>")))).alias("r")).where("r is not null")
    return rows.select("page_id", "r.title", "r.url", "r.snippet")


def web_cascade(spark, sf_dir):
    """Web answers of all questions, from recorded pages: one of four questions is known to each provider and one to none."""
    asked = _questions(spark, sf_dir)
    turn, number = F.pmod("qid", F.lit(4)), F.col("qid").cast("string")
    link = F.concat(F.lit("http://known/"), number)
    known = F.to_json(F.array(F.array(number), F.array(F.concat(F.lit("Title "), number)), F.array(F.concat(F.lit("said of "), number)), F.array(link)))
    page = F.concat(F.lit('<a class="result__a" href="'), _redirect(link), F.lit('">Title '), number, F.lit('</a><p class="result__snippet">said of '), number, F.lit("</p>"))
    listing = F.concat(F.lit("1. ## [Title "), number, F.lit("]("), link, F.lit(")\nsaid of "), number)
    pages = cascade.addresses(asked).select(F.when(turn == 0, F.col("titles0")).when(turn == 1, F.col("result_page")).when(turn == 2, F.col("listing")).alias("url"), F.when(turn == 0, known).when(turn == 1, page).otherwise(listing).alias("body"))
    found = cascade.search(asked, cascade.recorded(pages.where("url is not null")))
    return found.select("qid", "provider", "answer", F.get("sources.url", F.lit(0)).alias("url"))


def streamed_documents(spark, sf_dir):
    """Documents as the stream keeps them; a table that comes as one batch has the first copies by doc_id."""
    out = scratch_folder(spark, "stream")
    stream_index(spark, f"{sf_dir}/documents.parque[t]", out).awaitTermination()
    return spark.read.schema(STREAMED).parquet(f"{out}/documents").select("doc_id", "content_hash", "duplicate_of")


_QUERIES = (
    content_hash_dedup, ingest_counters, sources_report, duplicate_files, normalize_text, chunk_documents, embedding_terms_tf, hash_embedding, exact_embedding, candidate_terms, fts_index,
    semantic_topk, keyword_topk, keyword_index_topk, bm25_topk, hybrid_rerank, evidence_gate, sentence_citations, answer_struct, split_sentences, human_text_clean, html_links_extract, url_unwrap, cjk_terms, unwrapped_links, result_pages,
    web_cascade, streamed_documents,
)


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


# The tables have no CJK text and no empty lines inside texts: the SQL below leaves out what only
# those need. Each part names the ones it builds on.
_SQL = {
    "norm": (
        "",
        r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n|\r', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS text FROM documents""",
    ),
    "docs": ("norm", r"""SELECT *, CASE WHEN first <> doc_id THEN first END AS duplicate_of FROM (SELECT *, min(doc_id) OVER (PARTITION BY content_hash) AS first FROM (SELECT *, sha256(lower(regexp_replace(text, '\s+', '', 'g'))) AS content_hash FROM norm WHERE text <> ''))"""),
    "walk": (
        "docs",
        r"""SELECT doc_id, text, 0 AS start, CASE WHEN length(text) <= 900 THEN length(text) WHEN up - 1 > 450 THEN up ELSE 900 END AS len FROM (SELECT *, length(regexp_extract(substr(text, 1, 900), '(?s)^.*[\n。.]')) AS up FROM docs WHERE duplicate_of IS NULL)
        UNION ALL
        SELECT doc_id, text, start, CASE WHEN up - 1 > 450 THEN up ELSE length(win) END AS len FROM (SELECT *, length(regexp_extract(win, '(?s)^.*[\n。.]')) AS up FROM (SELECT doc_id, text, start + len - 120 AS start, substr(text, start + len - 119, 900) AS win FROM walk WHERE start + len < length(text)))""",
    ),
    "chunks": ("walk", r"""SELECT printf('doc_%04d_%04d', doc_id, n) AS chunk_id, printf('doc_%04d', doc_id) AS doc_id, n::INTEGER AS chunk_index, text FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start) AS n, text FROM (SELECT doc_id, start, regexp_replace(substr(text, start + 1, len), '^\s+|\s+$', '', 'g') AS text FROM walk) WHERE text <> '')"""),
    "hashed": (
        "chunks",
        r"""SELECT id, v % 384 AS idx, CASE WHEN (v >> 8) & 1 = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END * (1.0::DOUBLE + least(length(term), 8) / 8.0::DOUBLE) AS s
        FROM (SELECT id, term, CAST('0x' || substr(md5(term), 1, 15) AS BIGINT) AS v FROM (SELECT chunk_id AS id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]{2,}')) AS term FROM chunks UNION ALL SELECT 'q' || item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]{2,}')) FROM benchmark))""",
    ),
    "vecs": ("hashed", r"""SELECT id, idx, w FROM (SELECT id, idx, round(s / sqrt(sum(s * s) OVER (PARTITION BY id)), 6) AS w FROM (SELECT id, idx, sum(s) AS s FROM hashed GROUP BY id, idx)) WHERE abs(w) > 1e-9"""),
    "dots": ("vecs", r"""SELECT substr(a.id, 2)::BIGINT AS qid, b.id AS chunk_id, round(sum(a.w * b.w), 12) AS semantic_score FROM vecs a JOIN vecs b ON a.idx = b.idx AND a.id LIKE 'q%' AND b.id NOT LIKE 'q%' GROUP BY 1, 2"""),
    "semantic": ("dots", r"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY semantic_score DESC, split_part(chunk_id, '_', 2)::BIGINT, split_part(chunk_id, '_', 3)::BIGINT) AS pos FROM dots WHERE semantic_score > 0) WHERE pos <= 25"""),
    "plain": ("", r"""SELECT item_id AS qid, regexp_replace(regexp_replace(text, '[\pL\pN_]*[\x{80}-\x{10FFFF}][\pL\pN_\x{80}-\x{10FFFF}]*', '#', 'g'), '\b[0-9_][A-Za-z0-9_]*', '#', 'g') AS text FROM benchmark"""),
    "terms": (
        "plain",
        r"""SELECT qid, pos, term FROM (SELECT qid, term, row_number() OVER (PARTITION BY qid ORDER BY length(term) DESC, term DESC) AS pos FROM (
        SELECT qid, term, row_number() OVER (PARTITION BY qid, lower(term) ORDER BY length(term) DESC, term DESC) AS first FROM (
        SELECT qid, unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_]*(?:\s+[A-Za-z][A-Za-z0-9_]*)+')) AS term FROM plain
        UNION ALL SELECT qid, lower(term) FROM (SELECT qid, unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_]*')) AS term FROM plain) WHERE length(term) >= 2)) WHERE first = 1) WHERE pos <= 32""",
    ),
    "scores": ("chunks terms", r"""SELECT qid, chunk_id, sum(CASE WHEN length(term) >= 4 THEN 3 ELSE 1 END)::INTEGER AS term_score FROM chunks JOIN terms ON contains(lower(text), lower(term)) GROUP BY 1, 2"""),
    "keyword": ("scores", r"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY term_score DESC, split_part(chunk_id, '_', 2)::BIGINT, split_part(chunk_id, '_', 3)::BIGINT) AS pos FROM scores) WHERE pos <= 15"""),
    "tokens": ("chunks", r"""SELECT chunk_id, regexp_extract_all(strip_accents(lower(text)), '[\pL\pN]+') AS parts FROM chunks"""),
    "rows": ("tokens", r"""SELECT chunk_id, 2 * len(parts) AS n_tokens, ' ' || array_to_string(parts, '  ') || ' ' AS tokens FROM tokens"""),
    "phrases": ("terms", r"""SELECT qid, pos AS term_no, ' ' || array_to_string(regexp_extract_all(strip_accents(lower(term)), '[\pL\pN]+'), '  ') || ' ' AS phrase FROM terms WHERE pos <= 16"""),
    "freq": ("rows phrases", r"""SELECT qid, term_no, chunk_id, n_tokens, 2 * (length(tokens) - length(replace(tokens, phrase, ''))) / length(phrase) AS f FROM rows JOIN phrases ON contains(tokens, phrase)"""),
    "weights": ("freq", r"""SELECT qid, term_no, CASE WHEN v <= 0 THEN 1e-6::DOUBLE ELSE v END AS idf FROM (SELECT qid, term_no, ln(((SELECT count(*) FROM rows)::DOUBLE - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS v FROM freq GROUP BY 1, 2)"""),
    "ranks": ("weights", r"""SELECT qid, chunk_id, -sum(idf * f * 2.2::DOUBLE / (f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n_tokens / (SELECT avg(n_tokens) FROM rows)))) AS fts_rank FROM freq JOIN weights USING (qid, term_no) GROUP BY 1, 2"""),
    "fts": ("ranks", r"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(fts_rank, 9), split_part(chunk_id, '_', 2)::BIGINT, split_part(chunk_id, '_', 3)::BIGINT) AS pos FROM ranks) WHERE pos <= 25"""),
    "merged": (
        "fts semantic keyword",
        r"""SELECT qid, chunk_id, max(fts_rank) AS fts_rank, min(arrival) AS arrival FROM (SELECT qid, chunk_id, fts_rank, pos AS arrival FROM fts UNION ALL SELECT qid, chunk_id, NULL, pos + 1000000 FROM semantic UNION ALL SELECT qid, chunk_id, NULL, pos + 2000000 FROM keyword) GROUP BY 1, 2""",
    ),
    "fused": (
        "merged",
        r"""SELECT *, round(0.48::DOUBLE * sem + 0.34::DOUBLE * kw + 0.18::DOUBLE * fs, 6) AS rerank_score FROM (SELECT qid, chunk_id, arrival, greatest(0.0::DOUBLE, coalesce(semantic_score, 0.0::DOUBLE)) AS sem, coalesce(term_score, 0) / greatest(1, max(coalesce(term_score, 0)) OVER (PARTITION BY qid))::DOUBLE AS kw, coalesce(1.0::DOUBLE / (1.0::DOUBLE + abs(fts_rank)), 0.0::DOUBLE) AS fs
        FROM merged LEFT JOIN dots USING (qid, chunk_id) LEFT JOIN scores USING (qid, chunk_id))""",
    ),
    "ranked": ("fused", r"""SELECT * FROM (SELECT qid, chunk_id, round(sem, 6) AS semantic_score, round(kw, 6) AS keyword_score, round(fs, 6) AS fts_score, rerank_score, row_number() OVER (PARTITION BY qid ORDER BY rerank_score DESC, arrival)::INTEGER AS rank FROM fused WHERE rerank_score > 0) WHERE rank <= 5"""),
}


def _with(uses: str, select: str) -> str:
    """`select` after the parts it uses, each once and after those it builds on."""
    order: list[str] = []

    def need(name: str) -> None:
        for other in _SQL[name][0].split():
            need(other)
        if name not in order:
            order.append(name)

    for name in uses.split():
        need(name)
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({_SQL[n][1]})" for n in order) + "\n" + select


def _markdown(x: str) -> str:
    for pattern, put in ((r"\[([^\]]+)\]\([^)]+\)", r"\1"), (r"(?m)^[ \t]*#{1,6}[ \t]*", ""), (r"(?m)^[ \t]*[-*+]\s+", ""), (r"(?m)^[ \t]*\d+[.)]\s+", ""), (r"[*_`~]+", "")):
        x = f"regexp_replace({x}, '{pattern}', '{put}', 'g')"
    return x


def _human(x: str) -> str:
    return f"trim(regexp_replace({_markdown(x)}, '\\s+', ' ', 'g'), ' -#' || chr(9) || chr(10) || chr(13))"


def _sentences(key: str, table: str) -> str:
    """Sentences of a table's texts. SQL has no look-behind: a control character is put after each
    end and split at. The tables have no character references, which SQL can't decode."""
    parts = r"string_split(regexp_replace(regexp_replace(regexp_replace(marked, '([。！？!?；;])\s*', '\1' || chr(1), 'g'), '\.\s+', '.' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1))"
    cut = f"SELECT {key}, unnest({parts}) AS part, generate_subscripts({parts}, 1) AS k FROM (SELECT {key}, {_markdown('text')} AS marked FROM {table})"
    return f"""SELECT {key}, (row_number() OVER (PARTITION BY {key} ORDER BY k) - 1)::INTEGER AS pos, sentence FROM (SELECT {key}, k, {_human('part')} AS sentence FROM ({cut}))
WHERE sentence <> '' AND sentence NOT IN ('摘要', '关键机制', '可回答的问题', '工作表 sheet1') AND NOT regexp_matches(sentence, '[?？]$') AND NOT regexp_matches(sentence, '^(什么|哪些|哪个|如何|怎么|为什么)')"""


_SQL["gated"] = ("ranked", "SELECT qid, chunk_id, rerank_score, rank FROM (SELECT *, max(rerank_score) OVER (PARTITION BY qid) AS best FROM ranked) WHERE best >= 0.16 AND rerank_score >= greatest(0.16::DOUBLE, 0.75::DOUBLE * best)")
_SQL["sources"] = ("gated chunks", "SELECT qid, rank, chunk_id, text FROM gated JOIN chunks USING (chunk_id)")
_SQL["sentences"] = ("sources", _sentences("qid, chunk_id", "sources"))
_SQL["rated"] = (
    "sentences terms",
    """SELECT qid, chunk_id, pos, sentence, before, points, max(points) OVER (PARTITION BY qid, chunk_id) AS best FROM (
    SELECT qid, chunk_id, s.pos AS pos, any_value(sentence) AS sentence, any_value(before) AS before, coalesce(sum(CASE WHEN contains(lower(sentence), lower(term)) THEN CASE WHEN length(term) >= 4 THEN 3 ELSE 1 END END), 0) AS points
    FROM (SELECT *, lag(sentence) OVER (PARTITION BY qid, chunk_id ORDER BY pos) AS before FROM sentences) s LEFT JOIN terms USING (qid) GROUP BY 1, 2, 3)""",
)
_SQL["picked"] = ("rated", "SELECT *, row_number() OVER (PARTITION BY qid, chunk_id ORDER BY points DESC, pos) AS place FROM rated WHERE best > 0 AND points >= greatest(1, best - 1)")
_SQL["quotes"] = (
    "picked",
    "SELECT qid, chunk_id, string_agg(CASE WHEN starts_with(sentence, 'They ') AND before IS NOT NULL THEN rtrim(before, '。！？!?；;,.， ') || '。 ' ELSE '' END || rtrim(sentence, '。！？!?；;,.， ') || '。', ' ' ORDER BY place) AS quote FROM picked WHERE place <= 2 GROUP BY 1, 2",
)
_SQL["cited"] = (
    "sources quotes",
    f"SELECT qid, rank, chunk_id, CASE WHEN length(line) > 360 THEN rtrim(substr(line, 1, 359)) || '…' ELSE line END AS citation FROM (SELECT qid, rank, chunk_id, {_human('coalesce(quote, text)')} AS line FROM sources LEFT JOIN quotes USING (qid, chunk_id))",
)
_SQL["answers"] = (
    "cited",
    f"""SELECT item_id AS qid, {_human("CASE WHEN len(c) > 0 THEN '根据本地知识库，' || array_to_string([rtrim(x, '。！？!?；;,.， ') for x in c[:3] if x <> ''], '；') || '。' ELSE '本地知识库没有找到足够依据。' END")} AS answer, CASE WHEN len(c) > 0 THEN 'knowledge_base' ELSE 'none' END AS source_type, len(c)::INTEGER AS n_sources, len(c) = 0 AS need_web_search
    FROM (SELECT item_id, coalesce(c, []) AS c FROM benchmark LEFT JOIN (SELECT qid AS item_id, list(citation ORDER BY rank) AS c FROM cited GROUP BY 1) USING (item_id))""",
)

def oracle_sql() -> dict[str, str]:
    return {
        "content_hash_dedup": _with("docs", "SELECT doc_id, content_hash, duplicate_of FROM docs"),
        "ingest_counters": _with("docs chunks", "SELECT (SELECT count(*) FROM docs) AS documents, (SELECT count(*) FROM docs WHERE duplicate_of IS NULL) AS indexed_documents, (SELECT count(*) FROM chunks) AS chunks, (SELECT count(*) FROM norm WHERE coalesce(text, '') = '') AS skipped, (SELECT count(duplicate_of) FROM docs) AS duplicates"),
        "sources_report": _with("docs chunks", "SELECT printf('doc_%04d', d.doc_id) AS doc_id, 'raw/' || d.doc_id AS file_path, content_hash, duplicate_of::VARCHAR AS duplicate_of, count(c.chunk_id) AS chunk_count FROM docs d LEFT JOIN chunks c ON c.doc_id = printf('doc_%04d', d.doc_id) GROUP BY ALL"),
        "duplicate_files": _with("docs", "SELECT doc_id::VARCHAR AS file_path, duplicate_of::VARCHAR AS duplicate_of FROM docs WHERE duplicate_of IS NOT NULL"),
        "normalize_text": _with("norm", "SELECT doc_id, text FROM norm"),
        "chunk_documents": _with("chunks", "SELECT chunk_id, doc_id, chunk_index, text FROM chunks"),
        "embedding_terms_tf": "SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]{2,}')) AS term FROM documents) GROUP BY 1, 2",
        "hash_embedding": _with("vecs", "SELECT id AS chunk_id, idx::INTEGER AS idx, w FROM vecs WHERE id NOT LIKE 'q%'"),
        "candidate_terms": _with("terms", "SELECT qid, pos, term FROM terms"),
        "fts_index": _with("tokens", "SELECT chunk_id, token, 2 * count(*) AS tf FROM (SELECT chunk_id, unnest(parts) AS token FROM tokens) GROUP BY 1, 2"),
        "semantic_topk": _with("semantic", "SELECT qid, chunk_id, round(semantic_score, 6) AS semantic_score, pos::INTEGER AS pos FROM semantic"),
        "keyword_topk": _with("keyword", "SELECT qid, chunk_id, term_score, pos::INTEGER AS pos FROM keyword"),
        "keyword_index_topk": _with("keyword", "SELECT qid, chunk_id, term_score, pos::INTEGER AS pos FROM keyword"),
        "bm25_topk": _with("fts", "SELECT qid, chunk_id, round(fts_rank, 6) AS fts_rank, pos::INTEGER AS pos FROM fts"),
        "hybrid_rerank": _with("ranked", "SELECT qid, chunk_id, semantic_score, keyword_score, fts_score, rerank_score, rank FROM ranked"),
        "evidence_gate": _with("gated", "SELECT qid, chunk_id, rerank_score, rank FROM gated"),
        "sentence_citations": _with("cited", "SELECT qid, rank, chunk_id, citation FROM cited"),
        "answer_struct": _with("answers", "SELECT qid, answer, source_type, n_sources, need_web_search FROM answers"),
        "human_text_clean": f"SELECT conv_id, turn, {_human('text')} AS text FROM conversations",
        "split_sentences": _sentences("doc_id", "documents"),
        "cjk_terms": f"""SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(list_concat(regexp_extract_all(lower(text), '[a-z0-9_]{{2,}}'), flatten([flatten([[substr(run, i, n) for i in range(1, length(run) - n + 2)] for n in [2, 3, 4]]) for run in regexp_extract_all(text, '[一-鿿]+')]))) AS term FROM (SELECT doc_id, translate(text, '{_LETTERS}', '{_CHARACTERS}') AS text FROM documents)) GROUP BY 1, 2""",
        "unwrapped_links": "SELECT page_id, url AS redirect, url AS bing FROM pages",
        "result_pages": "SELECT page_id, 'Page ' || page_id || ' & more' AS title, url, 'Words of ' || page_id AS snippet FROM pages WHERE page_id % 3 <> 0",
        "html_links_extract": "SELECT page_id, CASE WHEN html LIKE '%result__a%' THEN 1 ELSE 0 END AS n_results FROM pages",
        "web_cascade": """SELECT qid, provider, CASE WHEN provider IS NULL THEN '联网搜索失败：unreachable' ELSE '本地知识库没有找到足够依据，联网搜索到：said of ' || qid || '。' END AS answer, CASE WHEN provider IS NOT NULL THEN 'http://known/' || qid END AS url
        FROM (SELECT item_id AS qid, CASE item_id % 4 WHEN 0 THEN 'encyclopedia' WHEN 1 THEN 'result page' WHEN 2 THEN 'listing' END AS provider FROM benchmark)""",
        "streamed_documents": _with("docs", "SELECT doc_id, content_hash, duplicate_of FROM docs"),
        "url_unwrap": "SELECT page_id, url AS redirect, url AS bing FROM pages",
    }
