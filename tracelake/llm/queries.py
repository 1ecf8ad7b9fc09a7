"""The registered queries of the corpus operators, with production parameters, and SQL for those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, decontam, exact_dedup, html_text, lang_id, line_dedup, pii, quality, simhash, spelling, substrings, url_filter
from .common import remainder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rank_file() -> tuple[str, str]:
    """Path of the rank file and the pattern that goes with it."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", remainder("doc_id", 5) == 0)
    model = lang_id.fit(docs.where(~F.col("held_out")))
    return lang_id.identify(docs, model, carry=("held_out",)).select("doc_id", "held_out", "lang_pred", "score")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.remove_boilerplate(_table(spark, sf_dir, "documents"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(_table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", remainder("doc_id", 4) == 2)
    labels = _table(spark, sf_dir, "labels").where(remainder("doc_id", 4) != 2)
    model = quality.fit(docs.where(~F.col("held_out")), labels)
    return quality.score(docs, model, carry=("held_out",)).select("doc_id", "held_out", "score", "predicted")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def _of_kind(kind: str):
    return lambda span: span["kind"] == kind


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE))

    def count(test, name):
        return F.size(F.filter("spans", test)).cast("long").alias(name)

    counts = [count(_of_kind(k), f"n_{k}") for k in (*pii.BASE, "iban")]
    likely = count(lambda s: s["score"] >= 70, "n_likely")
    return found.select("doc_id", *counts, likely, F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


def bpe_digests(docs: DataFrame) -> DataFrame:
    path, pattern = rank_file()
    return bpe.bpe_encode(docs, path, pattern, decoded=True).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), bpe.ids_digest("ids").alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(_table(spark, sf_dir, "documents"))


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(_table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: Rules of hosts with their subdomains, and of paths: (host, path, verdict).
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment.align_tokens(_table(spark, sf_dir, "documents"), *map(public_tokenizers.path, ("byte_bpe_50k.json", "piece_bpe_32k.model")))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(_table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


OP4_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS sha, length(coalesce(text, '')) AS n FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY sha) AS group_size, doc_id = first_value(doc_id) OVER w AS kept, sha AS text_sha256
FROM d WINDOW w AS (PARTITION BY sha ORDER BY n DESC, doc_id)
"""

OP2_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, source, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d),
boilerplate AS (SELECT trim(line) AS line FROM l WHERE trim(line) <> '' GROUP BY 1 HAVING count(DISTINCT source) >= 10),
marked AS (SELECT r, i, l.line, b.line IS NOT NULL AS gone FROM l LEFT JOIN boilerplate b ON trim(l.line) = b.line),
joined AS (SELECT r, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed FROM marked GROUP BY r)
SELECT doc_id, text, n_lines, n_removed FROM d JOIN joined USING (r)
"""

_PII_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, replace(replace(coalesce(text, ''), chr(57344), chr(57346)), chr(57345), chr(57346)) AS text FROM documents),
patterns(rank, kind, pattern) AS (VALUES
  (1, 'email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+'),
  (2, 'ip', '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'),
  (3, 'card', '[0-9]([\x20-]?[0-9])+'),
  (4, 'phone', '\+[0-9][\x20().0-9-]+[0-9]'),
  (5, 'iban', '(^|[^A-Za-z0-9])([A-Z]{2}[0-9]{2}(\x20?[A-Z0-9]){11,30})')),
marked AS (SELECT r, text, rank, kind, string_split(regexp_replace(text, pattern, CASE kind WHEN 'iban' THEN '\1' || chr(57344) || '\2' || chr(57345) ELSE chr(57344) || '\0' || chr(57345) END, 'g'), chr(57344)) AS parts
  FROM d CROSS JOIN patterns),
part AS (SELECT r, text, rank, kind, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM marked WHERE len(parts) > 1),
spot AS (SELECT r, text, rank, kind, i, split_part(part, chr(57345), 1) AS m, split_part(part, chr(57345), 2) AS after,
  sum(length(part) - CASE WHEN i > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY r, rank ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS start FROM part),
span AS (SELECT r, text, rank, kind, start, start + length(m) AS stop, m, after, regexp_replace(m, '[^0-9]', '', 'g') AS digits FROM spot WHERE i > 1),
valid AS (SELECT * FROM span WHERE CASE kind
  WHEN 'email' THEN true
  WHEN 'ip' THEN len(list_filter(string_split(m, '.'), lambda x: length(regexp_replace(x, '^0+', '')) > 3 OR coalesce(try_cast(x AS INTEGER), 999) > 255)) = 0
  WHEN 'card' THEN length(digits) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(digits) + 1), lambda k: CASE WHEN k % 2 = 1 THEN substr(reverse(digits), k, 1)::INTEGER WHEN substr(reverse(digits), k, 1)::INTEGER > 4 THEN 2 * substr(reverse(digits), k, 1)::INTEGER - 9 ELSE 2 * substr(reverse(digits), k, 1)::INTEGER END)) % 10 = 0
  WHEN 'phone' THEN length(digits) BETWEEN 9 AND 15
  ELSE NOT regexp_matches(after, '^[A-Za-z0-9]') AND list_reduce(list_prepend(0, list_transform(string_split(substr(replace(m, ' ', ''), 5) || substr(replace(m, ' ', ''), 1, 4), ''), lambda c: CASE WHEN ascii(c) < 65 THEN ascii(c) - 48 ELSE ascii(c) - 55 END)), lambda a, v: (CASE WHEN v < 10 THEN a * 10 + v ELSE a * 100 + v END) % 97) = 1
  END),
scored AS (SELECT r, rank, kind, start, stop, CASE WHEN kind IN ('card', 'iban') THEN 80 ELSE 50 END + CASE WHEN regexp_matches(lower(substr(text, greatest(start - 40, 0)::BIGINT + 1, least(start, 40)::BIGINT)), '(^|[^a-z])(e-?mail|mail|contact|write|card|visa|mastercard|credit|phone|tel|call|mobile|fax|iban|account|bank|ip|server|host|address)([^a-z]|$)') THEN 20 ELSE 0 END AS score FROM valid),
found AS (SELECT r, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone, count(*) FILTER (kind = 'iban') AS n_iban, count(*) FILTER (score >= 70) AS n_likely,
  string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY rank, start) FILTER (kind <> 'iban') AS base, string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY rank, start) AS spans FROM scored GROUP BY r)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, coalesce(n_iban, 0) AS n_iban, coalesce(n_likely, 0) AS n_likely, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN found USING (r)
"""

OP13_SQL = r"""
WITH RECURSIVE run AS (SELECT coalesce(doc_id::VARCHAR, '') AS d, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{00C0}-\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r FROM documents),
each AS (SELECT d, r, count(*) AS n, hex(d || ':' || r) AS x FROM run WHERE length(r) >= 6 GROUP BY ALL),
hashed AS (SELECT r, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(x) // 2), lambda k: ('0x' || substr(x, 2 * k + 1, 2))::BIGINT)),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda s, z: CASE WHEN s % 2 = 1 THEN xor(3988292384, s // 2) ELSE s // 2 END))) AS h FROM each),
word AS MATERIALIZED (SELECT CASE WHEN h % 199 = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word, sum(n)::BIGINT AS n FROM hashed GROUP BY 1 HAVING length(word) >= 6 AND sum(n) >= 5),
place AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS k FROM word),
hole AS (SELECT word, n, k, substr(word, 1, k - 1) AS a, substr(word, k + 1) AS b FROM place),
short AS (SELECT DISTINCT word, n, a || b AS near FROM hole),
pair AS (SELECT x.word, x.n, y.word AS near, y.n AS m FROM hole x JOIN hole y ON x.k = y.k AND x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION ALL SELECT s.word, s.n, w.word, w.n FROM short s JOIN word w ON s.near = w.word
  UNION ALL SELECT w.word, w.n, s.word, s.n FROM short s JOIN word w ON s.near = w.word),
best AS (SELECT word, n, count(*) AS n_near, max(m) AS m, arg_min(near, (-m, near)) AS near FROM pair GROUP BY ALL),
form AS (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.m >= 5 * w.n THEN b.near END AS form, CASE WHEN b.m >= 5 * w.n THEN b.m END AS form_n FROM word w LEFT JOIN best b USING (word)),
way AS (SELECT word, word AS here, 0 AS step FROM form UNION ALL SELECT y.word, f.form, step + 1 FROM way y JOIN form f ON f.word = y.here WHERE f.form IS NOT NULL),
root AS (SELECT word, arg_max(here, step) AS root FROM way GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM form JOIN root USING (word)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lang_id": op1_lang_id,
    "op2_line_dedup": op2_line_dedup,
    "op3_html_text": op3_html_text,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_simhash": op5_simhash,
    "op6_quality": op6_quality,
    "op7_decontamination": op7_decontamination,
    "op8_pii": op8_pii,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_substrings": op10_substrings,
    "op11_url_filter": op11_url_filter,
    "op12_alignment": op12_alignment,
    "op13_spelling_variants": op13_spelling_variants,
}

SQL: dict[str, str] = {"op2_line_dedup": OP2_SQL, "op4_exact_dedup": OP4_SQL, "op8_pii": _PII_SQL, "op13_spelling_variants": OP13_SQL}
