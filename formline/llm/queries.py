"""Queries of the training-data operators over the whole test tables, with SQL where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from formline.llm import decontam, line_dedup, ngram_join, packing, periodic, pii, quality, secrets, sp_codec, token_counts
from formline.llm import toxicity, vector_codes, warc
from formline.session import run_dir, staged

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return keep


def table(spark, sf: str, name: str):
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op3_warc", """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h, n) AS top FROM d)
SELECT page_id, n::BIGINT AS payload_bytes, h AS payload_digest,
  CASE WHEN n >= 1000 AND top <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND top <> page_id THEN top END AS refers_to
FROM m""")
def op3_warc(spark, sf):
    return warc.round_trip(table(spark, sf, "pages"))


PIECES = "piece_bpe_32k.model"


@query("op6_token_counts")
def op6_token_counts(spark, sf):
    return token_counts.count_tokens(
        table(spark, sf, "documents"), public_tokenizers.path(PIECES), keep=["doc_id"])


@query("op7_quality_rules")
def op7_quality_rules(spark, sf):
    docs = table(spark, sf, "documents")
    rules = quality.learn(docs, table(spark, sf, "labels"))
    return quality.judge(docs.select("doc_id", "text"), rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op4_line_dedup", r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
ln AS (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS i FROM d WHERE text <> ''),
w AS (SELECT doc_id, line, i, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM ln),
c AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM w),
pairs AS (SELECT a.doc_id, a.i AS b, z.i AS e FROM c a JOIN c z
  ON a.doc_id = z.doc_id AND a.i <= z.i AND z.upto - a.upto + a.n >= 50),
runs AS (SELECT doc_id, b, min(e) AS e FROM pairs GROUP BY doc_id, b
  UNION SELECT doc_id, max(b) AS b, e FROM pairs GROUP BY doc_id, e),
seqs AS (SELECT r.doc_id, r.b, r.e, array_to_string(list_slice(d.l, r.b, r.e), chr(10)) AS s
  FROM runs r JOIN d ON r.doc_id = d.doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id, b) AS k,
  first_value(doc_id) OVER (PARTITION BY s ORDER BY doc_id, b) AS d1,
  first_value(b) OVER (PARTITION BY s ORDER BY doc_id, b) AS b1 FROM seqs),
gone AS (SELECT DISTINCT ln.doc_id, ln.i FROM ln JOIN ranked r
  ON ln.doc_id = r.doc_id AND r.k > 1 AND ln.i <= r.e
  AND ln.i >= CASE WHEN r.d1 = r.doc_id THEN greatest(r.b, r.b1 + r.e - r.b + 1) ELSE r.b END),
kept AS (SELECT ln.doc_id, string_agg(ln.line, chr(10) ORDER BY ln.i) AS t, count(*) AS n FROM ln
  LEFT JOIN gone g ON ln.doc_id = g.doc_id AND ln.i = g.i WHERE g.i IS NULL GROUP BY ln.doc_id)
SELECT d.doc_id, CASE WHEN d.text <> '' THEN coalesce(kept.t, '') ELSE d.text END AS text,
  CASE WHEN d.text <> '' THEN len(d.l) - coalesce(kept.n, 0) ELSE 0 END::BIGINT AS n_deleted
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id""")
def op4_line_dedup(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return line_dedup.dedup(docs, deleted="n_deleted")


@query("op10_ngram_jaccard_join")
def op10_ngram_jaccard_join(spark, sf):
    return ngram_join.components(table(spark, sf, "documents"))


@query("op2_sentencepiece")
def op2_sentencepiece(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return sp_codec.encode(docs, public_tokenizers.path(PIECES)).drop("text")


def digest_columns(spans: str, base: tuple[str, ...]) -> list:
    """n_<kind> of the base kinds, base_sha256 of the base spans, and all spans; ``spans`` is in the order to join."""
    def joined(only=None):
        some = F.filter(spans, lambda s: s["kind"].isin(*only)) if only else F.col(spans)
        return F.array_join(F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["begin"], s["end"])), ",")
    counts = [F.expr(f"cast(size(filter(`{spans}`, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in base]
    return [*counts, F.sha2(joined(base), 256).alias("base_sha256"), joined().alias("spans")]


@query("op8_pii")
def op8_pii(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return pii.find(docs).select("doc_id", *digest_columns("pii", pii.BASE))


@query("op5_secrets")
def op5_secrets(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return secrets.find(docs).select("doc_id", *digest_columns("secrets", secrets.BASE))


@query("op1_decontamination")
def op1_decontamination(spark, sf):
    return decontam.contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op9_toxicity")
def op9_toxicity(spark, sf):
    return toxicity.predict(table(spark, sf, "documents"), table(spark, sf, "labels"))


BYTES = "byte_bpe_50k.json"


@query("op11_packing")
def op11_packing(spark, sf):
    pieces = packing.pack(table(spark, sf, "documents"), public_tokenizers.path(BYTES), keep=["doc_id"])
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def with_periods(docs):
    """Every tenth text by the hash of its id with its tail made periodic, the others as they are.

    No lambda reads the words one by one, so each text is split a fixed number of times."""
    hashed = docs.select("doc_id", "text", F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")).alias("h"))
    words = "filter(split(text, '[\\\\x20\\\\x09-\\\\x0D]+'), w -> w <> '')"
    chosen = hashed.withColumn("words", F.expr(f"case when h % 10 = 0 then {words} end")).withColumn("n", F.size("words"))
    sized = chosen.withColumn("a", F.expr("cast(case when n > 0 then (h div 10) % n end as int)")).withColumn(
        "p", F.expr("cast(1 + (n - a) div (3 + (h div 10) % 8) as int)"))
    tail = "slice(flatten(array_repeat(slice(words, a + 1, p), cast((n - a + p - 1) div p as int))), 1, n - a)"
    return sized.select("doc_id", F.expr(
        f"case when n > 0 then array_join(concat(slice(words, 1, a), {tail}), ' ') else text end").alias("text"))


@query("op12_periodic_runs")
def op12_periodic_runs(spark, sf):
    found = periodic.find_runs(with_periods(table(spark, sf, "documents")))
    best = found.withColumn("best", periodic.strongest("runs"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def coded_sql(base: str, entries: str) -> str:
    """Nearest entry of every part."""
    return f"""(SELECT vec_id, part, e, x, d FROM (SELECT b.vec_id, b.part, c.e, b.x,
      list_sum(list_transform(range(1, len(b.x) + 1), lambda i: (b.x[i] - c.c[i]) * (b.x[i] - c.c[i]))) AS d
      FROM {base} b JOIN {entries} c ON b.part = c.part) QUALIFY row_number() OVER (PARTITION BY vec_id, part ORDER BY d, e) = 1)"""


def moved_sql(coded: str, entries: str) -> str:
    """Entries after one round."""
    return f"""(SELECT o.part, o.e, coalesce(m.c, o.c) AS c FROM {entries} o LEFT JOIN (SELECT part, e, list(v ORDER BY i) AS c FROM
      (SELECT part, e, i, CAST(floor(sum(x[i])::DOUBLE / count(*)) AS BIGINT) AS v FROM {coded}, (SELECT unnest(range(1, 5)) AS i)
       GROUP BY ALL) GROUP BY ALL) m ON o.part = m.part AND o.e = m.e)"""


@query("op13_vector_codes", f"""
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT vec_id, part, v[part * 4 + 1 : part * 4 + 4] AS x FROM k, (SELECT unnest(range(16)) AS part)),
first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM k ORDER BY vec_id LIMIT 64),
c0 AS (SELECT part, e, x AS c FROM parts JOIN first USING (vec_id)),
a1 AS {coded_sql("parts", "c0")}, c1 AS {moved_sql("a1", "c0")},
a2 AS {coded_sql("parts", "c1")}, c2 AS {moved_sql("a2", "c1")},
a3 AS {coded_sql("parts", "c2")},
coded AS (SELECT vec_id, string_agg(lpad(format('{{:x}}', e), 2, '0'), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error
  FROM a3 GROUP BY vec_id),
books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, e)) AS s FROM c2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, s AS codebooks_sha256
FROM coded JOIN k USING (vec_id), books""")
def op13_vector_codes(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding", "label")
    books = vector_codes.train(rows)
    coded = staged(vector_codes.encode(rows, books), f"{run_dir(spark, 'vector-codes')}/coded")
    summed = vector_codes.with_total(coded, "label", "error", "label_error")
    return summed.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
