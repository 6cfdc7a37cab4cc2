"""One query for each corpus operator, with production parameters, and SQL where it can express it.

Other columns of the tables, whatever their names, are ignored by all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import langid, license_scan, merkle, mixing, ngram_lm, order_minhash, packing, quality_rules, simhash_bk, site_template, token_count, wand, warc
from .common import read_table


def op1_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null html is an empty payload; of equal payloads the largest page_id is the response (null the smallest); repeated rows have a record each; an empty table gives no rows."""
    return warc.round_trip(read_table(spark, sf_dir, "pages"), payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts count nothing; null ids and repeated rows are kept; an empty table gives no rows."""
    return token_count.count_tokens(read_table(spark, sf_dir, "documents"))


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null doc_id comes first; ties are ordered by text hash and place; an empty table gives no rows."""
    return order_minhash.edit_report(read_table(spark, sf_dir, "documents"))


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null html gives an empty text; a null url is a host of its own; repeated rows are kept; an empty table gives no rows."""
    return site_template.main_text(read_table(spark, sf_dir, "pages"))


def op5_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts are just the end id; repeated rows are packed each; an empty table gives no rows."""
    return packing.pack_documents(read_table(spark, sf_dir, "documents"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that are null or have no letter are `und` with score 0; repeated rows are kept; an empty table gives no rows."""
    return langid.predict_languages(read_table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts fail the base rule; repeated rows are judged each; an empty table gives no rows."""
    return quality_rules.judge(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op8_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts have fingerprint zero; a null doc_id counts as the largest; an empty table gives no rows."""
    return simhash_bk.near_duplicates(read_table(spark, sf_dir, "documents"))


def op9_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts have size 0; a null source is the last; repeated rows are mixed each; an empty table gives no rows."""
    return mixing.mixed_order(read_table(spark, sf_dir, "documents"))


def op10_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts are rejected; a null language is one of its own; repeated rows are scored each; an empty table gives no rows."""
    return ngram_lm.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null doc_id is a source's first leaf and is never tampered with; rows that share an id are ordered by leaf; repeated rows are leaves each; a text is hashed whole in its task; an empty table gives no rows."""
    return merkle.verify(merkle.manifest(read_table(spark, sf_dir, "documents")))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts have no words; null ids and repeated rows are kept; a notice counts wherever it stands in a text of any length; an empty table gives no rows."""
    return license_scan.scan(read_table(spark, sf_dir, "documents"))


def op13_wand_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts don't count as documents and find nothing as items; of equal scores a null doc_id is the last; repeated rows are documents each; a text is counted whole; an empty table gives no rows."""
    return wand.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


OP9_SQL = """
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
         CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS place
  FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank, sum(source_size) OVER () AS all_words FROM per),
weighed AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, 2.0::DOUBLE * source_size AS cap FROM ranked),
levels AS (
  SELECT *, (1.5::DOUBLE * all_words - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
         / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
targets AS (
  SELECT source, source_size, CASE rank % 3 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE -0.5::DOUBLE END AS a,
         round(least(cap, weight * (SELECT level FROM levels WHERE level <= cap / weight ORDER BY cap / weight, rank LIMIT 1)), 6) AS target FROM levels),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.a,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.place, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS whole
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
mixed AS (SELECT *, whole + CASE WHEN size > 0 AND start + size / 2.0::DOUBLE <= target - whole * source_size THEN 1 ELSE 0 END AS copies FROM placed),
due AS (SELECT *, least(1.0::DOUBLE, (start + size / 2.0::DOUBLE) / greatest(target, 1.0::DOUBLE)) AS u FROM mixed)
SELECT doc_id, size::BIGINT AS size, source_size, target, (copies * size)::BIGINT AS taken,
       CASE WHEN copies = 0 THEN 2.0::DOUBLE WHEN a = 0 THEN u ELSE (sqrt((1 - a) * (1 - a) + 4 * a * u) - (1 - a)) / (2 * a) END AS position
FROM due
"""


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _field(column: str) -> str:
    return f"coalesce(strlen({column}::VARCHAR) || ':' || {column}::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(_field(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"


#: CRC-32 of a text of digits, bit by bit.
_CRC = "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, [ord(c)::BIGINT for c in string_split({}, '')]), lambda r, b : list_reduce([xor(r, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i : xor(x >> 1, 3988292384 * (x & 1)))))"


def _merkle_sql(heights: int = 5, crown: int = 3) -> str:
    """Trees of up to 16 ** heights leaves a source and 16 ** crown sources, level by level, each level a window."""
    numbered = f"""SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS k0 FROM (
  SELECT doc_id, source, {_leaf('text')} AS leaf, CASE WHEN {_CRC.format('doc_id::VARCHAR')} % 5 = 0 THEN {_leaf(f"translate(text, '{_UPPER}', '{_LOWER}')")} ELSE {_leaf('text')} END AS tampered FROM documents)"""
    parts = [f"leaves AS ({numbered})", "n0 AS (SELECT source, k0 AS k, leaf AS node FROM leaves)"]

    def levels(name: str, group: str, count: int) -> None:
        """name1, ...: nodes of each level; name0r, ...: what stands left and right of each node of a level in its run."""
        over = f"PARTITION BY {group}" if group else ""
        key = f"{group}, " if group else ""
        for i in range(count):
            run = f"PARTITION BY {key}k // 16 ORDER BY k"
            parts.append(
                f"{name}{i}r AS (SELECT *, CASE WHEN many = 1 THEN NULL ELSE coalesce(string_agg(node, '') OVER ({run} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') END AS l, "
                f"CASE WHEN many = 1 THEN NULL ELSE coalesce(string_agg(node, '') OVER ({run} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') END AS r FROM (SELECT *, count(*) OVER ({over}) AS many FROM {name}{i}))"
            )
            parts.append(f"{name}{i + 1} AS (SELECT {key}k // 16 AS k, CASE WHEN max(many) = 1 THEN any_value(node) ELSE sha256(string_agg(node, '' ORDER BY k)) END AS node FROM {name}{i}r GROUP BY {key}k // 16)")

    levels("n", "source", heights)
    parts.append(f"m0 AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS k, node FROM n{heights})")
    levels("m", "", crown)
    columns = [f"n{i}r.{side} AS n{i}{side}" for i in range(heights) for side in "lr"] + [f"m{i}r.{side} AS m{i}{side}" for i in range(crown) for side in "lr"]
    joins = " ".join(f"JOIN n{i}r ON n{i}r.source IS NOT DISTINCT FROM d.source AND n{i}r.k = d.k0 // {16**i}" for i in range(heights))
    joins += " JOIN m0 ON m0.source IS NOT DISTINCT FROM d.source " + " ".join(f"JOIN m{i}r ON m{i}r.k = m0.k // {16**i}" for i in range(crown))
    parts.append(f"paths AS (SELECT d.*, m0.node AS subroot, (SELECT node FROM m{crown}) AS root, {', '.join(columns)} FROM leaves d {joins})")
    steps = [f"n{i}" for i in range(heights)] + [f"m{i}" for i in range(crown)]
    proof = "sha256(" + " || ".join(f"coalesce({x}l || {x}r, '')" for x in steps) + ")"
    source, node = "paths", "tampered"
    for x in steps:
        parts.append(f"f{x} AS (SELECT *, CASE WHEN {x}l IS NULL THEN {node} ELSE sha256({x}l || {node} || {x}r) END AS up{x} FROM {source})")
        source, node = f"f{x}", f"up{x}"
    return "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, leaf, subroot, root, {proof} AS proof_sha256, {node} AS folded_root, {node} = root AS verified FROM {source}"


def _license_sql() -> str:
    """Whole templates, word for word: the tables have no notice that differs from its template in a few words."""
    rows = ", ".join(f"({i}, '{label}', {str(exact).lower()}, ' {'  '.join(words)} ', {len(words)})" for i, label, exact, words, *_ in license_scan.templates())
    return f"""WITH words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
known(template, label, exact, wanted, size) AS (VALUES {rows}),
texts AS (SELECT doc_id, w, ' ' || array_to_string(w, '  ') || ' ' AS text FROM words),
cuts AS (SELECT template, label, exact, string_split(text, wanted) AS parts, doc_id, size FROM texts JOIN known ON contains(text, wanted)),
places AS (SELECT doc_id, label, exact, len(regexp_extract_all(array_to_string(parts[:i], ' '), '[^ ]+')) + (i - 1) * size AS place FROM (SELECT *, unnest(range(1, len(parts))) AS i FROM cuts)),
per AS (SELECT doc_id, count(*) FILTER (WHERE exact) AS n_base, min(place) FILTER (WHERE exact) AS first_word, max(place) FILTER (WHERE exact) AS last_word,
  array_to_string(list_sort(list_distinct(list(label) FILTER (WHERE exact))), ',') AS base_labels, array_to_string(list_sort(list_distinct(list(label))), ',') AS labels FROM places GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CASE WHEN labels IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS score
FROM words LEFT JOIN per USING (doc_id)"""


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
OP13_SQL = f"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_TERM}')) AS term FROM documents),
counts AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY 1, 2),
sizes AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM counts GROUP BY 1),
corpus AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM sizes),
weights AS (SELECT term, floor(1000 * ln((2 * max(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM counts, corpus GROUP BY 1),
asked AS (
  SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_TERM}')) AS term FROM benchmark) GROUP BY 1, 2),
lengths AS (SELECT doc_id, 100 - 75 + ((75 * n * docs) // terms) AS m FROM sizes, corpus),
scores AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM asked JOIN counts USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id) GROUP BY 1, 2),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_warc_round_trip, op2_token_counts, op3_order_minhash, op4_main_text, op5_vector_packing, op6_language, op7_quality_rules, op8_simhash_components, op9_curriculum_mix, op10_kneser_ney, op11_merkle_manifest, op12_license_scan, op13_wand_search)}


def oracle_sql() -> dict[str, str]:
    return {"op9_curriculum_mix": OP9_SQL, "op11_merkle_manifest": _merkle_sql(), "op12_license_scan": _license_sql(), "op13_wand_search": OP13_SQL}
