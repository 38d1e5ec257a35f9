"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.llm import bpe, chunk_dedup, decontaminate, exact_dedup, filter_audit, langid, preference, secret_scan, simhash, suffix_dedup, toxicity, vafile, warc
from scholia.llm.common import crc_mod, shared_dir, table

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two snapshots through one ledger: the half of the documents that was known first, then all of them, with the ledger
    stored and opened again in between."""
    docs, path = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"
    secret_scan.store(*secret_scan.scan(docs.where(crc_mod("doc_id", 2) == 0)), path)
    history, ledger = secret_scan.reopen(spark, path)
    findings, _ = secret_scan.scan(docs, ledger, history)
    found = secret_scan.findings_by_path(docs, findings)
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("spans", 256).alias("base_sha256"), "spans")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = chunk_dedup.deduplicate(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_shared", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_dedup.deduplicate(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", (crc_mod("doc_id", toxicity.FOLDS) == 0).alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_documents(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_dedup.exact_groups(table(spark, sf_dir, "documents"), keep="largest")
    return groups.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.train(docs)).select(
        "doc_id", (crc_mod("doc_id", langid.FOLDS) == langid.HELD_OUT).alias("held_out"), "lang_pred", "score"
    )


def op9_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = preference.preference_pairs(table(spark, sf_dir, "conversations"))
    return preference.format_pairs(pairs, ("conv_id", "kind", "other_id"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.round_trip(table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = vafile.cluster(table(spark, sf_dir, "embeddings"))
    text = F.array_join(F.transform("centroid", lambda x: x.cast("string")), ",")
    return told.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(text, 256).alias("centroid_sha256"))


QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_simhash": op6_simhash,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_language_id": op8_language_id,
    "op9_preference_format": op9_preference_format,
    "op10_decontamination": op10_decontamination,
    "op11_warc": op11_warc,
    "op12_filter_audit": op12_filter_audit,
    "op13_centroids": op13_centroids,
}

_RULE = """
  SELECT doc_id, '{kind}' AS kind, {no} AS kind_no, i, ms[i] AS m, cs[i] AS c,
         list_sum(list_transform(gs[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) AS s
  FROM (SELECT doc_id, regexp_extract_all(t, '{p}') AS ms, regexp_extract_all(t, '{p}', {group}) AS cs,
               regexp_split_to_array(t, '{p}') AS gs FROM d WHERE regexp_matches(t, '{p}')), range(1, len(ms) + 1) AS r(i)
  WHERE length(cs[i]) >= {least}"""



def _centroid_sql(rounds: int = vafile.ROUNDS, clusters: int = vafile.CLUSTERS) -> str:
    """The rounds of the clustering, written out one after the other."""
    out = f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
e AS MATERIALIZED (SELECT i, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM v),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS k, v AS c FROM (SELECT sha256('3:' || vec_id) AS h, v FROM v ORDER BY h, v LIMIT {clusters}))"""
    for r in range(rounds + 1):
        out += f""",
a{r} AS MATERIALIZED (SELECT i, min(struct_pack(d, k)) AS b FROM (SELECT i, k, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v, c{r}) GROUP BY i)"""
        if r < rounds:
            out += f""",
s{r} AS (SELECT b.k AS k, j, sum(x)::BIGINT AS s, count(*) AS n FROM a{r} JOIN e USING (i) GROUP BY 1, 2),
m{r} AS (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY j) AS c FROM s{r} GROUP BY k),
c{r + 1} AS MATERIALIZED (SELECT k, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (k))"""
    return out + f"""
SELECT vec_id, b.k::INTEGER AS cluster, b.d AS distance, sum(b.d) OVER (PARTITION BY b.k)::BIGINT AS cluster_inertia, sum(b.d) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256 FROM v JOIN a{rounds} USING (i) JOIN c{rounds} ON c{rounds}.k = b.k"""


ORACLE_SQL = {
    "op1_secret_scan": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS (""" + "\n  UNION ALL".join(
        _RULE.format(kind=r.kind, no=k, p=r.pattern.replace("'", "''"), group=r.group, least=r.min_length)
        for k, r in enumerate(secret_scan.RULES)
    ) + """),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS b,
             count(*) FILTER (kind = 'hex') AS h,
             string_agg(kind || ':' || s::BIGINT || ':' || (s + length(m))::BIGINT, ',' ORDER BY s, kind_no) AS spans
      FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(h, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)""",
    "op7_exact_dedup": """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op10_decontamination": r"""
WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
iw AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
win AS (SELECT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS s
        FROM iw, range(1, greatest(len(w) - 12, 1) + 1) AS r(i) WHERE len(w) > 0),
ns AS (SELECT DISTINCT n FROM win),
pos AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM dw, ns, range(1, len(w) - n + 2) AS r(i)),
occ AS (SELECT pos.doc_id, pos.i, pos.n, item_id FROM pos JOIN win ON pos.n = win.n AND pos.s = win.s),
hit AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM occ, range(0, n) AS r(k) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM occ GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)""",
    "op9_preference_format": """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i FROM t),
a AS (SELECT conv_id, i, text, row_number() OVER (PARTITION BY conv_id ORDER BY i) AS k, count(*) OVER (PARTITION BY conv_id) AS m FROM n WHERE role = 'assistant'),
c AS (SELECT conv_id, count(*) AS size, max(role) FILTER (i = 1) || chr(10) || max(text) FILTER (i = 1) AS f FROM n GROUP BY conv_id),
m AS (SELECT c.*, coalesce(x.m, 0) AS m FROM c LEFT JOIN (SELECT DISTINCT conv_id, m FROM a) x USING (conv_id)),
p1 AS (SELECT conv_id, CASE WHEN m > 1 THEN 'reply' WHEN m = 1 THEN 'single_reply' ELSE 'no_reply' END AS kind, conv_id AS other_id,
  CASE WHEN m > 1 THEN 2 + ('0x' || substr(md5(conv_id::VARCHAR), 1, 4))::INTEGER % (m - 1) END AS cut FROM m),
b AS (SELECT *, count(*) OVER (PARTITION BY f) AS g FROM c),
d AS (SELECT *, lead(conv_id) OVER w AS next_id, lead(size) OVER w AS next_size FROM b WHERE g > 1
  WINDOW w AS (PARTITION BY f, ('0x' || substr(md5(conv_id::VARCHAR), 1, 7))::INTEGER % ceil(g / 256)::INTEGER ORDER BY md5(conv_id::VARCHAR))),
p AS (SELECT * FROM p1 UNION ALL SELECT CASE WHEN next_size > size THEN next_id ELSE conv_id END, 'neighbour', CASE WHEN next_size > size THEN conv_id ELSE next_id END, NULL FROM d WHERE next_id IS NOT NULL),
x AS (SELECT p.conv_id, kind, other_id, i, role, text FROM p JOIN n USING (conv_id)),
y AS (SELECT p.conv_id, kind, other_id, n.i, role, CASE WHEN a.k >= cut THEN b.text ELSE n.text END AS text FROM p JOIN n ON n.conv_id = p.other_id
  LEFT JOIN a ON a.conv_id = n.conv_id AND a.i = n.i LEFT JOIN a b ON b.conv_id = a.conv_id AND b.k = a.k - 1),
z AS (SELECT coalesce(x.conv_id, y.conv_id) AS conv_id, coalesce(x.kind, y.kind) AS kind, coalesce(x.other_id, y.other_id) AS other_id, coalesce(x.i, y.i) AS i,
  x.role IS NOT DISTINCT FROM y.role AND x.text IS NOT DISTINCT FROM y.text AS same FROM x FULL JOIN y ON x.conv_id = y.conv_id AND x.kind = y.kind AND x.other_id = y.other_id AND x.i = y.i),
s AS (SELECT conv_id, kind, other_id, coalesce(min(i) FILTER (NOT same) - 1, max(i))::INTEGER AS n_shared FROM z GROUP BY ALL),
r AS (SELECT *, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS line FROM (SELECT 'x' AS side, * FROM x UNION ALL SELECT 'y', * FROM y) u JOIN s USING (conv_id, kind, other_id)),
o AS (SELECT *, coalesce(sum(length(line)) OVER (PARTITION BY conv_id, kind, other_id, side, i > n_shared ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM r),
q AS (SELECT conv_id, kind, other_id, n_shared, string_agg(line, '' ORDER BY i) FILTER (side = 'x' AND i <= n_shared) AS prompt,
  string_agg(line, '' ORDER BY i) FILTER (side = 'x' AND i > n_shared) AS chosen, string_agg(line, '' ORDER BY i) FILTER (side = 'y' AND i > n_shared) AS rejected,
  string_agg((pos + 14) || ':' || (pos + length(line)), ',' ORDER BY i) FILTER (side = 'x' AND i > n_shared AND role = 'assistant') AS cm,
  string_agg((pos + 14) || ':' || (pos + length(line)), ',' ORDER BY i) FILTER (side = 'y' AND i > n_shared AND role = 'assistant') AS rm FROM o GROUP BY ALL)
SELECT conv_id, kind, other_id, n_shared, coalesce(prompt, '') AS prompt, coalesce(chosen, '') AS chosen, coalesce(rejected, '') AS rejected,
  coalesce(cm, '') AS chosen_mask, coalesce(rm, '') AS rejected_mask FROM q""",
    "op11_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
k AS (SELECT *, octet_length(b) AS n, CASE WHEN octet_length(b) >= 1000 THEN max(page_id) OVER (PARTITION BY b) ELSE page_id END AS keep FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, sha1(b) AS payload_digest, CASE WHEN keep = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN keep <> page_id THEN keep END AS refers_to FROM k""",
    "op12_filter_audit": r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
f AS (SELECT doc_id, part, len(w) < 50 AS a, 100 * len(list_distinct(w)) < 65 * len(w) AS b, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS c,
  regexp_matches(t, '[#$%&*|]') AS d, first < doc_id AS e FROM w),
g AS (SELECT f.*, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic FROM f LEFT JOIN labels USING (doc_id)),
l AS (SELECT doc_id, unnest(['A', 'B', 'C', 'D', 'E']) AS letter, unnest([a, b, c, d, e]) AS fails FROM f),
v AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT v1.x || v2.x || v3.x || v4.x || v5.x AS filter_order FROM v v1, v v2, v v3, v v4, v v5
  WHERE len(list_distinct([v1.x, v2.x, v3.x, v4.x, v5.x])) = 5),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS letter FROM o, range(1, 6) AS r(step)),
m AS (SELECT part, CASE WHEN a THEN 'A' ELSE '' END || CASE WHEN b THEN 'B' ELSE '' END || CASE WHEN c THEN 'C' ELSE '' END || CASE WHEN d THEN 'D' ELSE '' END || CASE WHEN e THEN 'E' ELSE '' END AS failed,
  count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM g GROUP BY 1, 2),
x AS (SELECT part, filter_order, step, letter, n, good, toxic, contains(failed, letter) AS fails, failed = letter AS only_here,
  failed <> '' AND len(list_filter(range(1, step), lambda k: contains(failed, substr(filter_order, k, 1)))) > 0 AS gone FROM m, s),
y AS (SELECT part, filter_order, step, letter, coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (fails AND NOT gone), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (fails AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (only_here), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (fails AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (fails AND NOT gone), 0)::BIGINT AS toxic_lost FROM x GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM y""",
    "op13_centroids": _centroid_sql(),
}
