"""One registered query per operator, with production parameters, over whole tables."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import functions as F

from precis.llm import chat, conversation_repair, filter_audit, html_main, jaccard_rtree, langid, maxscore, merkle, mih, mixing, packing, suffix_dedup, urlfilter
from precis.llm.common import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


@register
def op1_suffix_array_dedup(spark, sf_dir):
    """All documents without the bytes covered by a 400-byte string that also starts elsewhere."""
    return suffix_dedup.dedup_digests(table(spark, sf_dir, "documents"), length=400)


@register
def op2_mixing_to_weights(spark, sf_dir):
    """Posterior domains of all documents and the rates that mix them to the target weights."""
    return mixing.rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register
def op3_html_extraction(spark, sf_dir):
    """The main text of every page."""
    return html_main.extract(table(spark, sf_dir, "pages"))


@register
def op4_document_fingerprints(spark, sf_dir):
    """Merkle fingerprints of every text and of its edited text, and their likeness."""
    return merkle.edited_fingerprints(table(spark, sf_dir, "documents"))


@register
def op5_approximate_nearest_neighbours(spark, sf_dir):
    """The 20 nearest rows found for every row whose id is divisible by 20."""
    return mih.search(table(spark, sf_dir, "embeddings"), k=20, every=20)


@register
def op6_ngram_jaccard_join(spark, sf_dir):
    """Components of all documents whose 4-word shingle sets have a Jaccard similarity of 0.85 or more."""
    return jaccard_rtree.ngram_components(table(spark, sf_dir, "documents"), k=4, percent=85)


@register
def op7_best_fit_packing(spark, sf_dir):
    """All documents as token pieces of at most 2048 ids, packed into sequences."""
    return packing.pack(table(spark, sf_dir, "documents"))


@register
def op8_language_id(spark, sf_dir):
    """The language of every document, by models learned from the documents outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs)
    return langid.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)).alias("held_out"),
        "lang_pred", "score", "ce", "rejected")


@register
def op9_chat_formatting(spark, sf_dir):
    """All conversations, and one whose texts look like control strings, formatted and read back."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], c.schema)
    return chat.digests(c.unionByName(own))


#: (verdict, host, path)
URL_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


@register
def op10_url_filters(spark, sf_dir):
    """The verdict on every page's URL."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.judge(pages, urlfilter.rule_table(spark, URL_RULES)).select("page_id", "host", "path", "rule", "verdict")


_RULES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)
ORACLES["op10_url_filters"] = f"""
WITH p AS (SELECT row_number() OVER () AS k, page_id,
       translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
       coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r(verdict, host, path) AS (VALUES {_RULES}),
h AS (SELECT p.k, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
      FROM p JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY p.k)
SELECT p.page_id, p.host, p.path, h.rule, coalesce(h.verdict, 'allow') AS verdict FROM p LEFT JOIN h USING (k)"""


@register
def op11_conversation_repair(spark, sf_dir):
    """All conversations, damaged, and the cheapest edits that repair them."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return conversation_repair.digests(conversation_repair.repairs(conversation_repair.damaged(c)))


#: Rows after damage by number (b), the edits over one row from any state (w), and the best way to each state, row by row (p).
#: States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant.
ORACLES["op11_conversation_repair"] = r"""
WITH RECURSIVE
x AS MATERIALIZED (SELECT list(list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) ORDER BY n) AS t
      FROM range(256) AS r(n)),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
h AS (SELECT k.*, xor(list_reduce(list_transform(string_split(key, ''), lambda c: CAST(ascii(c) AS BIGINT)),
                      lambda c, b: xor(c >> 8, x.t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 20 AS kind FROM k, x),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
             CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
      FROM (SELECT *, unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) FROM h WHERE kind <> 0)),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again
      FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d)),
b AS MATERIALIZED (SELECT conv_id, turn, role, text, i, left(role, 1) AS c,
        CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN again THEN 'duplicate'
             WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault FROM n),
j AS (SELECT q, m, repeat('I', m) AS ins, CASE WHEN m = 0 THEN q WHEN m = 1 THEN CASE WHEN q = 2 THEN 3 ELSE 2 END
                                               WHEN q = 2 THEN 2 ELSE 3 END AS at,
             CASE WHEN m = 0 THEN [] WHEN m = 1 THEN CASE WHEN q = 2 THEN ['assistant:'] ELSE ['user:'] END
                  WHEN q = 2 THEN ['assistant:', 'user:'] ELSE ['user:', 'assistant:'] END AS lines
      FROM range(4) AS s(q), range(3) AS t(m)),
w AS MATERIALIZED (SELECT b.conv_id, b.i, j.q, e.edit, j.ins || e.edit AS edits,
        CASE WHEN e.edit = 'D' THEN j.at WHEN e.edit = 'K' AND b.c = 's' THEN 1 WHEN j.at = 2 THEN 3 ELSE 2 END AS q2,
        3 * j.m + CASE e.edit WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END + CASE WHEN e.edit <> 'D' AND b.fault = 'truncated' THEN 3 ELSE 0 END AS price,
        list_concat(j.lines, CASE e.edit WHEN 'D' THEN [] WHEN 'K' THEN [b.role || ':' || b.text]
                             ELSE [CASE WHEN j.at = 2 THEN 'assistant:' ELSE 'user:' END || b.text] END) AS lines
      FROM b, j, (VALUES ('D'), ('K'), ('R')) AS e(edit)
      WHERE e.edit = 'D' OR (b.fault NOT IN ('blank', 'duplicate') AND (e.edit = 'R' OR
            (b.c = 's' AND j.at = 0) OR (b.c = 'u' AND j.at <> 2) OR (b.c = 'a' AND j.at = 2)))),
p AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS q, 0 AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS lines FROM (SELECT DISTINCT conv_id FROM conversations)
      UNION ALL
      SELECT conv_id, i, q, cost, audit, lines FROM (
        SELECT w.conv_id, w.i, w.q2 AS q, p.cost + w.price AS cost, p.audit || w.edits AS audit, list_concat(p.lines, w.lines) AS lines
        FROM p JOIN w ON w.conv_id IS NOT DISTINCT FROM p.conv_id AND w.i = p.i + 1 AND w.q = p.q)
      QUALIFY row_number() OVER (PARTITION BY conv_id, q ORDER BY cost, audit) = 1),
z AS (SELECT p.conv_id, p.cost + 3 * j.m AS cost, p.audit || j.ins AS audit, list_concat(p.lines, j.lines) AS lines
      FROM p JOIN (SELECT conv_id, max(i) AS i FROM p GROUP BY conv_id) l ON l.conv_id IS NOT DISTINCT FROM p.conv_id AND l.i = p.i
      JOIN j ON j.q = p.q AND j.at IN (0, 3)
      QUALIFY row_number() OVER (PARTITION BY p.conv_id ORDER BY p.cost + 3 * j.m, p.audit || j.ins) = 1),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
             count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
             count(*) FILTER (before IS NOT NULL AND before || c NOT IN ('su', 'ua', 'au')) AS illegal
      FROM (SELECT *, lag(c) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM b) GROUP BY conv_id)
SELECT z.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, CAST(z.cost AS BIGINT) AS cost, z.audit, sha256(array_to_string(z.lines, chr(10))) AS repaired_sha256
FROM z LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM z.conv_id"""


@register
def op12_filter_interaction_audit(spark, sf_dir):
    """Five filters over all documents: what each removes in every order, by language."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLES["op12_filter_interaction_audit"] = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
b AS (SELECT doc_id, part, CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
             + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 4 ELSE 0 END
             + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN least < doc_id THEN 16 ELSE 0 END AS bits FROM w),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, bits, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM b LEFT JOIN l USING (doc_id) GROUP BY part, bits),
f(f, own) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.own, b.own, c.own, d.own, e.own] AS owns FROM f a, f b, f c, f d, f e
      WHERE a.own + b.own + c.own + d.own + e.own = 31 AND len(list_distinct([a.own, b.own, c.own, d.own, e.own])) = 5),
s AS (SELECT filter_order, step, owns[step] AS own, coalesce(list_sum(owns[1:step - 1]), 0)::INTEGER AS before FROM o, range(1, 6) AS r(step)),
a AS (SELECT part, filter_order, step, own, sum(CASE WHEN bits & (before + own) = 0 THEN n ELSE 0 END) AS kept,
             sum(CASE WHEN bits & own <> 0 AND bits & before = 0 THEN n ELSE 0 END) AS removed,
             sum(CASE WHEN bits & own <> 0 AND bits & before <> 0 THEN n ELSE 0 END) AS redundant,
             sum(CASE WHEN bits = own THEN n ELSE 0 END) AS unique_fails,
             sum(CASE WHEN bits & own <> 0 AND bits & before = 0 THEN good ELSE 0 END) AS good_lost,
             sum(CASE WHEN bits & own <> 0 AND bits & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
      FROM c, s GROUP BY part, filter_order, step, own)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM a"""


@register
def op13_exact_topk_search(spark, sf_dir):
    """The 10 rows with the largest integer inner products for every row whose id is divisible by 100."""
    return maxscore.search(table(spark, sf_dir, "embeddings"), k=10, every=100)


ORACLES["op13_exact_topk_search"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(1024 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, least(len(q.x), len(c.x)) + 1), lambda i: q.x[i] * c.x[i])) AS score
      FROM v q, v c WHERE q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM r WHERE rank <= 10"""


@register
def pipeline(spark, sf_dir):
    """The stages of corpus_pipeline over all documents."""
    return corpus_pipeline.run(spark, sf_dir)


if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
