"""The operators' queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignment import align_tokenizers
from .decontaminate import benchmark_overlap
from .dialogue import rotate
from .exact import exact_duplicates
from .html_text import main_text
from .jaccard import jaccard_classes
from .language_model import score_documents
from .lines import line_classes
from .mixing import mix_sources
from .packing import pack_documents
from .pii import pseudonymise
from .spelling import observed_words, spelling_variants
from .toxicity import toxicity


_SESSION_KEY = secrets.token_hex(32)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deployment sets its secret in ``spark.recordrank.pii.key``; without one, a random key is made that lasts as long as this process."""
    key = spark.sparkContext.getConf().get("spark.recordrank.pii.key") or _SESSION_KEY
    return pseudonymise(_table(spark, sf_dir, "documents"), key)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rotate(_table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("mask", lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), ",")
    return out.withColumn("mask", spans)


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(_table(spark, sf_dir, "documents"))


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_classes(_table(spark, sf_dir, "documents"), threshold=4, least=5)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_overlap(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("items", "spans")


def op10_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_table(spark, sf_dir, "documents"))


def op11_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(_table(spark, sf_dir, "pages"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(_table(spark, sf_dir, "documents"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(observed_words(_table(spark, sf_dir, "documents")).where("n >= 5"))


QUERIES = {f.__name__: f for f in (op1_mixing, op2_pii, op3_toxicity, op4_perspectives, op5_jaccard, op6_language_model, op7_lines, op8_packing, op9_decontamination, op10_exact, op11_html, op12_alignment, op13_spelling)}

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES = {
    "op4_perspectives": """
        WITH t AS (SELECT conv_id, turn, coalesce(replace(replace(replace(replace(replace(role, '%', '%25'), '|', '%7C'), '>', '%3E'), chr(13), '%0D'), chr(10), '%0A'), '%unknown') AS role,
                coalesce(regexp_replace(text, '<(\\\\*)\\|', '<\\1\\\\|', 'g'), '') AS body FROM conversations),
        k AS (SELECT conv_id, turn, role, body, conv_id IS NULL AS alone, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS id FROM t),
        p AS (SELECT DISTINCT conv_id, id, role AS speaker FROM k),
        n AS (SELECT *, coalesce(sum(length(role) + length(body) + 24) OVER (PARTITION BY conv_id, id ORDER BY turn NULLS FIRST, role, body ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT // 1048576 AS part FROM k),
        e AS (SELECT n.conv_id, n.id, p.speaker, part, turn, role, body, role = speaker AS mine,
                CASE WHEN role = speaker THEN '<|assistant|>' || chr(10) ELSE '<|user name=' || role || '|>' || chr(10) END AS head FROM n JOIN p ON n.conv_id IS NOT DISTINCT FROM p.conv_id AND n.id IS NOT DISTINCT FROM p.id),
        l AS (SELECT *, length(head) + length(body) + length('<|end|>') + 1 AS size FROM e),
        o AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY conv_id, id, speaker ORDER BY turn NULLS FIRST, role, body ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS whole_at,
                coalesce(sum(size) OVER (PARTITION BY conv_id, id, speaker, part ORDER BY turn NULLS FIRST, role, body ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begin_at FROM l)
        SELECT conv_id, speaker, part, min(whole_at) AS "begin", count(*) AS n_turns,
            string_agg(head || body || '<|end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role, body) AS rendered,
            coalesce(string_agg((begin_at + length(head))::BIGINT::VARCHAR || '-' || (begin_at + size - 1)::BIGINT::VARCHAR, ',' ORDER BY turn NULLS FIRST, role, body) FILTER (WHERE mine), '') AS mask
        FROM o GROUP BY conv_id, id, speaker, part""",
    "op5_jaccard": f"""
        WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all({_LOW}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
        s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w),
        n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS MATERIALIZED (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
        e AS MATERIALIZED (SELECT x, y FROM l UNION SELECT y, x FROM l),
        r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.y FROM r JOIN e ON e.x = r.b)
        SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.m, w.doc_id) AS component_id
        FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN (SELECT a, min(b) AS m FROM r GROUP BY a) c ON c.a = w.doc_id""",
    "op9_decontamination": f"""
        WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all({_LOW}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
        b AS (SELECT item_id, regexp_extract_all({_LOW}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark),
        i AS MATERIALIZED (SELECT DISTINCT item_id, least(len(ws), 10) AS k, array_to_string(ws[p:p + 9], ' ') AS g
                FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS p FROM b WHERE len(ws) > 0)),
        k AS (SELECT DISTINCT k FROM i),
        o AS MATERIALIZED (SELECT doc_id, p, k, array_to_string(ws[p:p + k - 1], ' ') AS g FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS p FROM d, k)),
        h AS MATERIALIZED (SELECT doc_id, p, k, item_id FROM o JOIN i USING (g, k)),
        c AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM h) GROUP BY doc_id),
        t AS (SELECT doc_id, count(*) AS n, sha256(string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS s FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
        SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(t.n, 0) AS n_items, coalesce(s, sha256('')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
        FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op10_exact": f"""
        SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
            doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM (SELECT doc_id, {_LOW} AS t FROM documents)""",
    # crc32 bit by bit; beyond U+007F, letters of runs have two bytes, the first of which is 195
    "op13_spelling": """
        WITH RECURSIVE r AS (SELECT doc_id, run, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\\x{C0}-\\x{FF}]+')) AS run FROM documents)
                WHERE length(run) >= 6 GROUP BY ALL),
        b AS (SELECT run, k, flatten(list_transform(flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [195, unicode(c) - 64] END)),
                lambda x: list_transform(range(8), lambda i: (x >> i) & 1))) AS bits FROM r),
        h AS (SELECT run, k, xor(list_reduce(list_prepend(4294967295::BIGINT, bits), lambda c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1))), 4294967295::BIGINT) AS h FROM b),
        w AS (SELECT CASE WHEN h % 199 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, k FROM h),
        v AS MATERIALIZED (SELECT word, sum(k)::BIGINT AS n FROM w WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
        d AS MATERIALIZED (SELECT word, p, word[1:p - 1] || word[p + 1:] AS cut FROM (SELECT word, unnest(range(1, length(word) + 1)) AS p FROM v)),
        i AS MATERIALIZED (SELECT d.word AS a, v.word AS b FROM d JOIN v ON v.word = d.cut),
        q AS MATERIALIZED (SELECT x.word AS a, y.word AS b FROM d x JOIN d y ON x.cut = y.cut AND x.p = y.p AND x.word <> y.word UNION SELECT a, b FROM i UNION SELECT b, a FROM i),
        m AS (SELECT a, count(*) AS n_near, arg_min(struct_pack(w := b, n := v.n), struct_pack(k := -v.n, w := b)) AS top FROM q JOIN v ON v.word = q.b GROUP BY a),
        f AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN top.n >= 5 * n THEN top.w END AS form, CASE WHEN top.n >= 5 * n THEN top.n END AS form_n FROM v LEFT JOIN m ON m.a = v.word),
        c AS (SELECT word, word AS root, 0 AS depth FROM f UNION ALL SELECT c.word, f.form, depth + 1 FROM c JOIN f ON f.word = c.root WHERE f.form IS NOT NULL)
        SELECT f.word, f.form, (SELECT arg_max(root, depth) FROM c WHERE c.word = f.word) AS root, f.n, f.n_near, f.form_n FROM f""",
}
