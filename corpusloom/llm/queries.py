"""The queries that apply each operator to its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import ann, audit, bytebpe, centroids, common, hamming, licenses, packing, pieces, simhash, substring, tokenids, toxicity, unigram

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
BYTE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def document_files(docs: DataFrame) -> DataFrame:
    """Documents as files ``source/lang/thousand/id``; one that opens with a notice is a licence file there."""
    first = F.coalesce(F.element_at(F.split("text", "\n"), 1), F.lit(""))
    name = F.when(first.rlike(licenses.TRIGGER), F.concat(F.lit("LICENSE."), F.col("doc_id"))).otherwise(F.col("doc_id").cast("string"))
    return docs.select("doc_id", F.concat_ws("/", "source", "lang", F.expr("doc_id div 1000").cast("string"), name).alias("path"), "text")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence of every document, its own or its directory's."""
    scanned = licenses.license_scan(document_files(table(spark, sf_dir, "documents")))
    number = lambda c: F.regexp_extract(c, "([0-9]+)$", 1).cast("long")
    return scanned.select(number("path").alias("doc_id"), "licence", "score", "origin", number("origin_path").alias("origin_doc_id"))


_TEMPLATE_ROWS = ", ".join("({}, '{}', '{}')".format(k, name, text.replace("'", "''")) for k, (name, text) in enumerate(licenses.KNOWN))
_TRIGGER_SQL = licenses.TRIGGER
_WINDOWS = " UNION ALL ".join(
    f"SELECT doc_id, no, array_to_string(w[n + 1:n + {size}], ' ') AS x FROM (SELECT doc_id, no, w, unnest(range(0, len(w), {size // 5})) AS n FROM long)"
    for size in licenses.WINDOWS
)
_VERSION = f"CASE WHEN regexp_matches(word, '[0-9]') THEN {licenses.VERSION} ELSE 1.0 END"
OP1_SQL = f"""
WITH lines AS (
    SELECT doc_id, source || '/' || lang || '/' || CAST(doc_id // 1000 AS VARCHAR) AS dir, string_split(text, chr(10)) AS l FROM documents
),
flat AS (SELECT doc_id, text, l, regexp_matches(l[1], '{_TRIGGER_SQL}') AS file FROM lines JOIN documents USING (doc_id)),
blocks AS (
    SELECT doc_id, regexp_split_to_array(regexp_replace(chr(10) || text, '{licenses.MARKED}', '\\1\n\\2', 'g'), '{licenses.BREAK}') AS b
    FROM flat WHERE regexp_matches(text, '{_TRIGGER_SQL}')
),
told_lines AS (
    SELECT doc_id, no, l[no] AS x FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS no FROM flat) WHERE regexp_matches(l[no], '{_TRIGGER_SQL}')
),
long AS (
    SELECT doc_id, no, w FROM (SELECT doc_id, no, string_split(trim(regexp_replace(x, '\\s+', ' ', 'g')), ' ') AS w FROM told_lines) WHERE len(w) > {licenses.LONG}
),
pieces AS (
    SELECT doc_id, {licenses.LINE} AS kind, no, x, true AS tag FROM told_lines
    UNION ALL
    SELECT doc_id, {licenses.LINE}, no, x, false FROM ({_WINDOWS}) WHERE regexp_matches(x, '{_TRIGGER_SQL}')
    UNION ALL
    SELECT doc_id, {licenses.BLOCK}, no, b[no], false FROM (SELECT doc_id, b, unnest(range(1, len(b) + 1)) AS no FROM blocks)
    WHERE regexp_matches(b[no], '{_TRIGGER_SQL}') AND regexp_matches(b[no], '{licenses.LINES}')
    UNION ALL
    SELECT doc_id, {licenses.WHOLE}, 0, text, false FROM flat WHERE file
),
told AS (
    SELECT doc_id, kind, no, CASE WHEN tag AND regexp_extract(x, '{licenses.SPDX}', 1) <> ''
        THEN 'spdx' || lower(regexp_replace(regexp_extract(x, '{licenses.SPDX}', 1), '[^A-Za-z0-9]', '', 'g'))
        ELSE trim(regexp_replace(x, '\\s+', ' ', 'g')) END AS notice
    FROM pieces
),
templates(template, licence, body) AS (VALUES {_TEMPLATE_ROWS}),
notices AS (SELECT DISTINCT notice FROM told),
words AS (
    SELECT notice, word, count(*) AS tf
    FROM (SELECT notice, unnest(regexp_extract_all(lower(notice), '{licenses.WORD}')) AS word FROM notices) GROUP BY ALL
),
shape AS (
    SELECT template, licence, word, count(*) AS tf
    FROM (SELECT template, licence, unnest(regexp_extract_all(lower(body), '{licenses.WORD}')) AS word FROM templates) GROUP BY ALL
),
idf AS (SELECT word, ln({1.0 + len(licenses.KNOWN)} / (1 + count(*))) + 1 AS idf FROM shape GROUP BY word),
nw AS (SELECT notice, word, (ln(tf) + 1) * coalesce(idf, ln({1.0 + len(licenses.KNOWN)}) + 1) * {_VERSION} AS w FROM words LEFT JOIN idf USING (word)),
tw AS (SELECT template, licence, word, (ln(tf) + 1) * idf * {_VERSION} AS w FROM shape JOIN idf USING (word)),
nn AS (SELECT notice, sqrt(sum(w * w)) AS norm FROM nw GROUP BY notice),
tn AS (SELECT template, sqrt(sum(w * w)) AS norm FROM tw GROUP BY template),
scored AS (
    SELECT notice, template, licence, round(dot / nn.norm / tn.norm, 6) AS score
    FROM (SELECT notice, template, licence, sum(nw.w * tw.w) AS dot FROM nw JOIN tw USING (word) GROUP BY ALL)
    JOIN nn USING (notice) JOIN tn USING (template)
),
each AS (
    SELECT notice, template, licence, score FROM scored WHERE score >= {licenses.THRESHOLD} - {licenses.MARGIN}
    QUALIFY row_number() OVER (PARTITION BY notice, licence ORDER BY score DESC, template) = 1
),
best AS (
    SELECT notice, template, licence, score FROM (
        SELECT *, row_number() OVER o AS place, coalesce(score - lead(score) OVER o, 1) AS ahead FROM each WINDOW o AS (PARTITION BY notice ORDER BY score DESC, licence)
    ) WHERE place = 1 AND score >= {licenses.THRESHOLD} AND round(ahead, 6) >= {licenses.MARGIN}
),
hits AS (
    SELECT doc_id, licence, score, no, kind, file AND template >= {len(licenses.TEMPLATES)} AND kind <> {licenses.WHOLE} AS titled
    FROM told JOIN best USING (notice) JOIN flat USING (doc_id)
),
own AS (
    SELECT doc_id, licence, score FROM hits QUALIFY row_number() OVER (
        PARTITION BY doc_id ORDER BY CASE WHEN titled THEN {licenses.TITLE} ELSE kind END, CASE WHEN titled THEN no ELSE -1 END, score DESC, no, licence) = 1
),
given AS (
    SELECT dir, licence, score, doc_id FROM own JOIN lines USING (doc_id) WHERE regexp_matches(l[1], '{_TRIGGER_SQL}')
    QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, CAST(doc_id AS VARCHAR)) = 1
)
SELECT d.doc_id, coalesce(o.licence, g.licence) AS licence, coalesce(o.score, g.score) AS score,
       CASE WHEN o.doc_id IS NOT NULL THEN 'own' WHEN g.doc_id IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
       coalesce(o.doc_id, g.doc_id) AS origin_doc_id
FROM lines d LEFT JOIN own o USING (doc_id) LEFT JOIN given g ON d.dir = g.dir
"""


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth."""
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram pieces of every document."""
    return unigram.unigram_counts(table(spark, sf_dir, "documents"), PIECE_MODEL)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sequence of the written training order, read back from its shard."""
    path = common.scratch_path(spark, "training-order")
    docs = table(spark, sf_dir, "documents")
    if tokenids.write_training_order(docs, PIECE_MODEL, path):
        return tokenids.read_training_order(spark, path)
    return spark.createDataFrame([], "slot long, doc_id long, seq int, n int, ids_sha256 string")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A place in a training sequence for every document; a text's tokens and one that ends it."""
    docs = table(spark, sf_dir, "documents")
    count = pieces.token_counter(docs, PIECE_MODEL)
    lengths = packing.measured(docs, count("text") + 1)
    return packing.best_fit_packing(lengths, lengths["n_tokens"])


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded."""
    return pieces.encoded(table(spark, sf_dir, "documents"), PIECE_MODEL)


def op9_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest sign codes of every hundredth vector."""
    return hamming.nearest_codes(hamming.sign_codes(table(spark, sf_dir, "embeddings")), F.col("id") % 100 == 0)


OP9_SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS bits FROM embeddings
),
pairs AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
           CAST(list_sum(list_transform(range(1, 65), lambda i: CASE WHEN q.bits[i] <> c.bits[i] THEN 1 ELSE 0 END)) AS INTEGER) AS distance
    FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, distance FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM pairs
) WHERE rank <= 10
"""


def op10_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of documents that repeat an earlier passage."""
    return substring.repeated_passages(table(spark, sf_dir, "documents"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector of 64 components in one of 16 clusters."""
    rows = centroids.quantised(table(spark, sf_dir, "embeddings"))
    found = centroids.clustered(rows, centroids.least_hashes(rows, 16), rounds=3)
    told = F.concat_ws(",", F.col("centroid").cast("array<string>"))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(told.cast("binary"), 256).alias("centroid_sha256"))


def _op11_sql(rounds: int = 3) -> str:
    steps = [
        """v AS MATERIALIZED (
    SELECT row_number() OVER () AS no, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)""",
        """c0 AS MATERIALIZED (
    SELECT CAST(row_number() OVER (ORDER BY h, q) - 1 AS INTEGER) AS c, q FROM (
        SELECT sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, q FROM v ORDER BY h, q LIMIT 16)
)""",
    ]
    for k in range(rounds + 1):
        steps.append(f"""a{k} AS MATERIALIZED (
    SELECT v.no, v.vec_id, v.q, c, CAST(list_sum(list_transform(range(1, 65), lambda i: (v.q[i] - t.q[i]) * (v.q[i] - t.q[i]))) AS BIGINT) AS d
    FROM v, c{k} t QUALIFY row_number() OVER (PARTITION BY v.no ORDER BY d, c) = 1
)""")
        if k < rounds:
            steps.append(f"""c{k + 1} AS MATERIALIZED (
    SELECT t.c, coalesce(m.q, t.q) AS q FROM c{k} t LEFT JOIN (
        SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS q
        FROM (SELECT c, i, CAST(sum(q[i]) AS BIGINT) AS s, count(*) AS n FROM (SELECT c, q, unnest(range(1, 65)) AS i FROM a{k}) GROUP BY c, i) GROUP BY c
    ) m USING (c)
)""")
    return f"""
WITH {", ".join(steps)}
SELECT vec_id, a.c AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(t.q, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} t ON a.c = t.c
"""


OP11_SQL = _op11_sql()


def op12_byte_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded by byte-level merges and decoded again."""
    found = bytebpe.encoded(table(spark, sf_dir, "documents"), BYTE_RANKS, public_tokenizers.PATTERN)
    return found.select(
        "doc_id", F.expr("CAST(octet_length(ids) div 4 AS BIGINT)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters of documents remove by language, step by step in every order."""
    return audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP13_SQL = """
WITH d AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
),
first AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t),
marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS q, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS x FROM labels GROUP BY doc_id),
flags AS (
    SELECT part, coalesce(q, 0) AS q, coalesce(x, 0) AS x,
           (CASE WHEN len(w) < 200 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END)
           || (CASE WHEN 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * len(t) THEN 'C' ELSE '' END)
           || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN d.doc_id > first THEN 'E' ELSE '' END) AS fails
    FROM d JOIN first USING (t) LEFT JOIN marks USING (doc_id)
),
cells AS (SELECT part, q, x, fails, count(*) AS n FROM flags GROUP BY ALL),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (
    SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM letter a, letter b, letter c, letter d, letter e
    WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5
),
steps AS (SELECT filter_order, CAST(unnest(range(1, 6)) AS INTEGER) AS step FROM orders),
walked AS (
    SELECT part, filter_order, step, filter_order[step] AS l, contains(fails, filter_order[step]) AS own,
           step > 1 AND len(fails) > 0 AND regexp_matches(fails, '[' || CASE WHEN step > 1 THEN filter_order[1:step - 1] ELSE '-' END || ']') AS gone, q, x, fails, n
    FROM cells, steps
),
summed AS (
    SELECT part, filter_order, step, any_value(l) AS l, sum(CASE WHEN NOT own AND NOT gone THEN n ELSE 0 END) AS kept,
           sum(CASE WHEN own AND NOT gone THEN n ELSE 0 END) AS removed, sum(CASE WHEN own AND gone THEN n ELSE 0 END) AS redundant,
           sum(CASE WHEN fails = l THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN own AND NOT gone AND q = 1 THEN n ELSE 0 END) AS good_lost,
           sum(CASE WHEN own AND NOT gone AND x = 1 THEN n ELSE 0 END) AS toxic_lost
    FROM walked GROUP BY part, filter_order, step
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, l) AS BIGINT) AS shapley
FROM summed
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_license_scan, op2_simhash, op3_nearest, op4_token_counts, op5_toxicity, op6_token_ids, op7_packing, op8_pieces,
        op9_hamming, op10_substring, op11_centroids, op12_byte_pieces, op13_filter_audit,
    )
}
ORACLES: dict[str, str] = {"op1_license_scan": OP1_SQL, "op9_hamming": OP9_SQL, "op11_centroids": OP11_SQL, "op13_filter_audit": OP13_SQL}
