"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from rillflow.llm.decontaminate import benchmark_matches
from rillflow.llm.divergence import source_divergence
from rillflow.llm.exact_dedup import exact_duplicates
from rillflow.llm.html_text import fit_weights, main_text
from rillflow.llm.line_dedup import remove_repeated_lines
from rillflow.llm.mixing import poisson_mix, target_rates
from rillflow.llm.near_dedup import near_duplicates
from rillflow.llm.quality import fit_quality, quality_scores
from rillflow.llm.secrets import find_secrets, learn_identifiers
from rillflow.llm.sharding import shard_documents
from rillflow.llm.substring_dedup import remove_copies
from rillflow.llm.toxicity import fit_toxicity, toxicity_scores
from rillflow.llm.whitening import whitened_components

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return keep


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
LETTERS = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '')"


@query(
    "op5_exact_dedup",
    f"""
WITH t AS (SELECT doc_id, {LOWER} AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       coalesce(doc_id = max(doc_id) OVER same, false) AS kept, sha256(norm) AS text_sha256
FROM t WINDOW same AS (PARTITION BY norm)""",
)
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return exact_duplicates(table(spark, sf, "documents"))


@query(
    "op3_poisson_mix",
    """
WITH counts AS (SELECT source, count(*)::DOUBLE AS n FROM documents GROUP BY source),
totals AS (SELECT sum(n) AS documents, sum(pow(n, 0.5)) AS weights FROM counts),
rates AS (SELECT source, pow(n, 0.5) / weights * documents / n AS rate FROM counts, totals),
steps AS (SELECT source, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 30)::INT + 1)) AS k FROM rates),
probabilities AS (SELECT source, k, exp(k * ln(rate) - rate - sum(CASE WHEN k > 0 THEN ln(k) ELSE 0 END)
                  OVER (PARTITION BY source ORDER BY k)) AS p FROM steps),
cumulative AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS cdf FROM probabilities),
drawn AS (SELECT *, (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT + 0.5) / 4503599627370496.0 AS u FROM documents),
counted AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, count(*) FILTER (c.cdf < u) AS n
            FROM drawn d JOIN cumulative c ON d.source IS NOT DISTINCT FROM c.source GROUP BY ALL)
SELECT doc_id, text, lang, source, n_chars, copy::INT AS copy, md5('mix:' || doc_id || ':' || copy) AS shuffle_key
FROM counted, LATERAL unnest(range(1, n + 1)) AS r(copy)""",
)
def op3(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return poisson_mix(docs, target_rates(docs))


@query(
    "op10_decontaminate",
    rf"""
WITH docs AS (SELECT doc_id, {LETTERS} AS words FROM documents WHERE doc_id IS NOT NULL),
items AS (SELECT item_id, {LETTERS} AS words FROM benchmark WHERE item_id IS NOT NULL),
item_sizes AS (SELECT item_id, words, len(words) AS n, least(len(words), 5) AS k FROM items WHERE len(words) > 0),
item_shingles AS (SELECT item_id, n, k, unnest(range(0, n - k + 1)) AS pos, words FROM item_sizes),
item_keys AS (SELECT item_id, n, k, pos, array_to_string(words[pos + 1 : pos + k], ' ') AS shingle FROM item_shingles),
doc_keys AS (SELECT doc_id, k, pos, len(words) AS words, array_to_string(words[pos + 1 : pos + k], ' ') AS shingle
             FROM (SELECT doc_id, words, k, unnest(range(0, len(words) - k + 1)) AS pos
                   FROM docs, (SELECT DISTINCT k FROM item_sizes) WHERE len(words) >= k)),
pairs AS (SELECT DISTINCT doc_id, i.item_id, i.n, i.k FROM doc_keys d JOIN item_keys i ON d.shingle = i.shingle AND d.k = i.k),
doc_bags AS (SELECT doc_id, k, list(shingle ORDER BY pos) AS shingles FROM doc_keys GROUP BY doc_id, k),
bags AS (SELECT doc_id, p.item_id, start, shingles[start + 1 : start + n - k + 1] AS bag
         FROM (SELECT doc_id, item_id, n, k, shingles, unnest(range(0, greatest(len(shingles) + k - 1 - n, 0) + 1)) AS start
               FROM pairs JOIN doc_bags USING (doc_id, k)) p),
item_bags AS (SELECT item_id, list(shingle) AS item_bag FROM item_keys GROUP BY item_id),
sums AS (SELECT doc_id, item_id, start, len(bag) + len(item_bag) AS total,
                list_sum(list_transform(list_distinct(bag), lambda x: least(len(list_filter(bag, lambda y: y = x)),
                                                                          len(list_filter(item_bag, lambda y: y = x)))))::BIGINT AS common
         FROM bags JOIN item_bags USING (item_id)),
near AS (SELECT doc_id, item_id, start, common / (total - common) AS similarity FROM sums
         WHERE 100 * common >= 75 * (total - common))
SELECT doc_id, item_id, arg_max(start, (similarity, -start))::INT AS start, max(similarity) AS similarity
FROM near GROUP BY doc_id, item_id""",
)
def op10(spark: SparkSession, sf: str) -> DataFrame:
    return benchmark_matches(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op4_near_dedup")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates(table(spark, sf, "documents"))


@query(
    "op8_substring_dedup",
    r"""
WITH t AS (SELECT row_number() OVER () AS row, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
windows AS (SELECT row, doc_id, s, array_to_string(words[s + 1 : s + 13], ' ') AS seq
            FROM (SELECT row, doc_id, words, unnest(range(0, len(words) - 12)) AS s FROM t WHERE len(words) >= 13)),
firsts AS (SELECT row, doc_id, s, min(doc_id) OVER (PARTITION BY seq) AS least FROM windows),
gone AS (SELECT DISTINCT row, unnest(range(s, s + 13)) AS i FROM firsts WHERE least < doc_id),
lists AS (SELECT row, list(i) AS gone FROM gone GROUP BY row),
kept AS (SELECT doc_id, len(words) AS n_words, coalesce(len(gone), 0) AS n_removed,
                list_filter(words, lambda w, i: gone IS NULL OR NOT list_contains(gone, i - 1)) AS words
         FROM t LEFT JOIN lists USING (row))
SELECT doc_id, n_words, n_removed, sha256(coalesce(array_to_string(words, ' '), '')) AS kept_sha256 FROM kept""",
)
def op8(spark: SparkSession, sf: str) -> DataFrame:
    return remove_copies(table(spark, sf, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query(
    "op1_line_dedup",
    r"""
WITH t AS (SELECT *, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (SELECT doc_id, i - 1 AS i, trim(regexp_replace(lines[i], '[\x09-\x0D]', ' ', 'g')) AS line
          FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM t)),
filled AS (SELECT *, len(string_split_regex(line, '\x20+')) AS words, count(*) OVER (PARTITION BY doc_id) AS n
           FROM lines WHERE line <> ''),
pairs AS (SELECT doc_id, i, lead(i) OVER w AS j, line, lead(line) OVER w AS next
          FROM filled WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
places AS (SELECT doc_id, i, j, min((doc_id, i)) OVER (PARTITION BY line, next) AS first FROM pairs WHERE j IS NOT NULL),
alone AS (SELECT doc_id, i, min((doc_id, i)) OVER (PARTITION BY line) AS first FROM filled WHERE words >= 13 OR n = 1),
gone AS (SELECT doc_id, unnest([i, j]) AS i FROM places WHERE (doc_id, i) > first
         UNION ALL SELECT doc_id, i FROM alone WHERE (doc_id, i) > first),
lists AS (SELECT doc_id, list(DISTINCT i) AS gone FROM gone GROUP BY doc_id),
kept AS (SELECT t.*, gone, array_to_string(list_filter(lines, lambda s, i: NOT list_contains(gone, i - 1)), chr(10)) AS rest
         FROM t LEFT JOIN lists USING (doc_id))
SELECT doc_id, CASE WHEN gone IS NULL THEN text ELSE coalesce(rest, '') END AS text, lang, source,
       CASE WHEN gone IS NULL THEN n_chars ELSE length(coalesce(rest, '')) END AS n_chars,
       coalesce(len(gone), 0)::INT AS n_removed_lines
FROM kept""",
)
def op1(spark: SparkSession, sf: str) -> DataFrame:
    return remove_repeated_lines(table(spark, sf, "documents"))


@query("op2_toxicity")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return toxicity_scores(docs, fit_toxicity(docs, table(spark, sf, "labels")))


@query("op6_quality")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return quality_scores(docs, fit_quality(docs, table(spark, sf, "labels")))


@query("op7_html_text")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    return main_text(pages, fit_weights(pages))


@query("op9_secrets")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return find_secrets(docs, learn_identifiers(docs))


@query(
    "op11_jump_shards",
    r"""
WITH RECURSIVE docs AS (SELECT doc_id, encode(coalesce(text, '')) AS bytes, md5(coalesce(doc_id::VARCHAR, '')) AS digest FROM documents),
keys AS (SELECT DISTINCT digest, ('0x' || substr(digest, 1, 16))::UBIGINT::HUGEINT AS state FROM docs),
walk AS (SELECT digest, 0::BIGINT AS spot, (state * 2862933555777941757 + 1) % 18446744073709551616 AS state FROM keys
         UNION ALL
         SELECT digest, floor((spot + 1) * (2147483648.0 / ((state >> 33) + 1)::DOUBLE))::BIGINT,
                (state * 2862933555777941757 + 1) % 18446744073709551616
         FROM walk WHERE floor((spot + 1) * (2147483648.0 / ((state >> 33) + 1)::DOUBLE)) < 25),
places AS (SELECT digest, (max(spot) FILTER (spot < 24))::INT AS shard, max(spot)::INT AS grown_shard FROM walk GROUP BY digest),
polynomial AS (SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i:
                      xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END), b)) AS steps),
sums AS (SELECT doc_id, digest, octet_length(bytes)::BIGINT + 8 AS size,
                xor(list_reduce(list_transform(regexp_extract_all(hex(bytes), '..'), lambda x: ('0x' || x)::BIGINT),
                                lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS text_crc32
         FROM docs, polynomial)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY substr(digest, 1, 16), doc_id, text_crc32, size) - 1 AS slot, grown_shard
FROM sums JOIN places USING (digest)""",
)
def op11(spark: SparkSession, sf: str) -> DataFrame:
    return shard_documents(table(spark, sf, "documents"))


@query(
    "op12_source_divergence",
    rf"""
WITH docs AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                     regexp_extract_all({LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
words AS (SELECT id, lang, source, unnest(words) AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
cells AS (SELECT g.lang, g.source, k.term FROM groups g JOIN kept k USING (lang)),
counted AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
counts AS (SELECT lang, source, term, coalesce(n, 0)::HUGEINT AS n FROM cells LEFT JOIN counted USING (lang, source, term)),
shares AS (SELECT lang, source, term, n, 1 + (1000000000 * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v) AS p
           FROM counts JOIN sizes USING (lang)),
whole AS (SELECT lang, term, 1 + (1000000000 * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * v) AS q
          FROM (SELECT lang, term, sum(n)::HUGEINT AS n FROM counts GROUP BY ALL) JOIN sizes USING (lang)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
         FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
          FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value
          FROM shares JOIN whole USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
           FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50""",
)
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return source_divergence(table(spark, sf, "documents"))


@query("op13_whitening")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return whitened_components(table(spark, sf, "embeddings"))


@query("pipeline")
def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf)
