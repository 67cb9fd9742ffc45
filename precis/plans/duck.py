"""SQL-text building blocks for the DuckDB oracles.

RE2 has no look-behind and its ``\\s`` lacks \\x0b, so the classes are spelled
out; lambdas use DuckDB's ``lambda x: ...`` form.  Used only to write the
oracle strings returned by ``oracle_sql()``.
"""

from __future__ import annotations

WS = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def clean(x: str) -> str:
    s = f"coalesce(CAST({x} AS VARCHAR), '')"
    s = f"regexp_replace({s}, {q('http[^' + WS + ']+')}, '', 'g')"
    s = f"regexp_replace({s}, {q(r'[^\p{L}\p{N}_' + WS + r".,!?']")}, '', 'g')"
    s = f"regexp_replace({s}, {q('[' + WS + ']+')}, ' ', 'g')"
    return f"trim({s}, ' ')"


def trim_ws(x: str) -> str:
    return f"regexp_replace({x}, {q('^[' + WS + ']+|[' + WS + ']+$')}, '', 'g')"


def sentences(x: str) -> str:
    marked = f"regexp_replace(coalesce({x}, ''), {q('([.!?])[' + WS + ']+')}, '\\1' || chr(1), 'g')"
    return (f"list_filter(list_transform(string_split({marked}, chr(1)), lambda s: {trim_ws('s')}), "
            f"lambda s: s <> '')")


def rtokens(x: str) -> str:
    return (f"list_filter(string_split(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9]+', ' ', 'g'), ' '), "
            f"lambda t: t <> '')")


def ngrams(t: str, n: int) -> str:
    if n == 1:
        return t
    return (f"CASE WHEN len({t}) >= {n} THEN list_transform(range(1, len({t}) - {n - 2}), "
            f"lambda i: array_to_string({t}[i:i + {n - 1}], ' ')) ELSE []::VARCHAR[] END")


def overlap(a: str, b: str) -> str:
    """Clipped overlap of two lists (quadratic; fine for oracle sizes)."""
    return (f"coalesce(list_sum(list_transform(list_distinct({a}), lambda g: "
            f"least(len(list_filter({a}, lambda x: x = g)), len(list_filter({b}, lambda y: y = g))))), 0)")


def lcs(a: str, b: str) -> str:
    inner = (f"list_reduce(range(1, len({b}) + 1), lambda acc, j: list_append(acc, "
             f"CASE WHEN {b}[j] = x THEN prev[j] + 1 ELSE greatest(prev[j + 1], acc[len(acc)]) END), [0])")
    init = f"list_transform(range(0, len({b}) + 1), lambda k: 0)"
    return f"list_reduce({a}, lambda prev, x: {inner}, {init})[len({b}) + 1]"


def prf(hits: str, nc: str, nr: str, prefix: str, digits: int = 6) -> str:
    p = f"(({hits}) / greatest({nc}, 1))"
    r = f"(({hits}) / greatest({nr}, 1))"
    f = f"(CASE WHEN {p} + {r} > 0 THEN 2 * {p} * {r} / ({p} + {r}) ELSE 0.0 END)"
    return (f"round({p}, {digits}) AS {prefix}_p, round({r}, {digits}) AS {prefix}_r, "
            f"round({f}, {digits}) AS {prefix}_f")


def articles_cte() -> str:
    return ("articles AS (SELECT CAST(doc_id AS VARCHAR) AS id, coalesce(text, '') AS source, "
            "split_part(coalesce(text, ''), chr(10), 1) AS target, lang FROM documents)")


def dialogues_cte() -> str:
    return ("dialogues AS (SELECT CAST(conv_id AS VARCHAR) AS id, "
            "string_agg(role || ': ' || coalesce(text, ''), chr(10) ORDER BY turn) AS source, "
            "coalesce(split_part(arg_max(text, turn) FILTER (WHERE role = 'assistant'), chr(10), 1), '') AS target "
            "FROM conversations GROUP BY conv_id)")


def wtok(x: str) -> str:
    """``str.split()`` tokens."""
    return f"list_filter(regexp_split_to_array(coalesce({x}, ''), {q('[' + WS + ']+')}), lambda t: t <> '')"


def zeros(n: int, v: int = 0) -> str:
    return f"list_transform(range({n}), lambda i: {v})"


def shuffle_key(x: str, seed: int = 42) -> str:
    return f"('0x' || substr(md5(CAST({x} AS VARCHAR) || ':{seed}'), 1, 8))::BIGINT"


def three_way(pos: str = "pos", n: str = "n") -> str:
    return (f"CASE WHEN {pos} < ceil(ceil({n} * 0.2::DOUBLE) * 0.5::DOUBLE) THEN 'test' "
            f"WHEN {pos} < ceil({n} * 0.2::DOUBLE) THEN 'validation' ELSE 'train' END")


def split_dialogues_ctes() -> str:
    """dialogues -> cleaned (c) -> split (sp: id, source, target, split)."""
    return f"""{dialogues_cte()},
c AS (SELECT id, {clean('source')} AS source, {clean('target')} AS target FROM dialogues),
sp AS (SELECT id, source, target, {three_way()} AS split FROM (
  SELECT *, row_number() OVER (ORDER BY h, id) - 1 AS pos, count(*) OVER () AS n
  FROM (SELECT *, {shuffle_key('id')} AS h FROM c)))"""


def vocab_ctes(max_size: int = 20000) -> str:
    """train rows of sp -> word counts -> vocab(token, token_id, freq)."""
    return f"""texts AS (SELECT 0 AS part, id AS row_key, source AS text FROM sp WHERE split = 'train'
  UNION ALL SELECT 1 AS part, id AS row_key, target AS text FROM sp WHERE split = 'train'),
toks AS (SELECT part, row_key, unnest(t) AS token, generate_subscripts(t, 1) - 1 AS pos
  FROM (SELECT part, row_key, {wtok('text')} AS t FROM texts)),
wc AS (SELECT token, count(*) AS freq, min({{'part': part, 'row_key': row_key, 'pos': pos}}) AS first
  FROM toks GROUP BY token),
top AS (SELECT * FROM wc ORDER BY freq DESC, first ASC LIMIT {max_size}),
vocab AS (SELECT token, CAST(row_number() OVER (ORDER BY freq DESC, first ASC) + 3 AS INTEGER) AS token_id, freq
  FROM top WHERE token NOT IN ('<PAD>', '<SOS>', '<EOS>', '<UNK>')
  UNION ALL SELECT * FROM (VALUES ('<PAD>', 0, 0::BIGINT), ('<SOS>', 1, 0::BIGINT), ('<EOS>', 2, 0::BIGINT),
                                  ('<UNK>', 3, 0::BIGINT)) v(token, token_id, freq))"""


def ids_ctes(src_cut: int | None, tgt_cut: int | None) -> str:
    """sp + vocab -> ids(id, split, si, ti): word ids (UNK 3), cut at the limits."""
    cond = []
    cond.append(f"(part = 0{' AND pos < ' + str(src_cut) if src_cut is not None else ''})")
    cond.append(f"(part = 1{' AND pos < ' + str(tgt_cut) if tgt_cut is not None else ''})")
    return f"""ex AS (SELECT * FROM (SELECT id, part, unnest(t) AS tok, generate_subscripts(t, 1) - 1 AS pos
  FROM (SELECT id, 0 AS part, {wtok('source')} AS t FROM sp UNION ALL SELECT id, 1 AS part, {wtok('target')} AS t FROM sp))
  WHERE {' OR '.join(cond)}),
lk AS (SELECT id, list(coalesce(v.token_id, 3) ORDER BY pos) FILTER (WHERE part = 0) AS si,
              list(coalesce(v.token_id, 3) ORDER BY pos) FILTER (WHERE part = 1) AS ti
  FROM ex LEFT JOIN vocab v ON ex.tok = v.token GROUP BY id),
ids AS (SELECT sp.id, sp.split, coalesce(lk.si, []::INTEGER[]) AS si, coalesce(lk.ti, []::INTEGER[]) AS ti
  FROM sp LEFT JOIN lk ON sp.id = lk.id)"""


def sents_ctes() -> str:
    """articles -> sl(id, lang, target, sl list) -> s(id, sent_pos, sentence)."""
    return f"""sl AS (SELECT id, lang, target, source, {sentences(clean('source'))} AS sl FROM articles),
s AS (SELECT id, unnest(sl) AS sentence, generate_subscripts(sl, 1) - 1 AS sent_pos FROM sl)"""


def freq_ctes(n: int = 3) -> str:
    """s -> fsum(id, summary): frequency summarizer."""
    return f"""ft AS (SELECT id, sent_pos, unnest({rtokens('sentence')}) AS token FROM s),
fwc AS (SELECT id, token, count(*) AS wc FROM ft GROUP BY id, token),
fdl AS (SELECT id, count(*) AS dl FROM ft GROUP BY id),
fsc AS (SELECT ft.id, ft.sent_pos, sum(fwc.wc) AS s, count(*) AS len FROM ft JOIN fwc ON ft.id = fwc.id AND ft.token = fwc.token
        GROUP BY ft.id, ft.sent_pos),
fsc2 AS (SELECT fsc.id, fsc.sent_pos, fsc.s / (fsc.len * fdl.dl) AS score FROM fsc JOIN fdl ON fsc.id = fdl.id),
ftop AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, sent_pos) AS rk FROM fsc2) WHERE rk <= {n}),
fsum AS (SELECT ftop.id, string_agg(s.sentence, ' ' ORDER BY ftop.sent_pos) AS summary
         FROM ftop JOIN s ON ftop.id = s.id AND ftop.sent_pos = s.sent_pos GROUP BY ftop.id)"""


def textrank_ctes(n: int = 3, rounds: int = 20, damping: float = 0.85) -> str:
    """s -> tsum(id, summary): PageRank over shared-word counts through the sentence-word incidence, round by round."""
    out = [f"""ti AS MATERIALIZED (SELECT DISTINCT id, sent_pos, token FROM (SELECT id, sent_pos, unnest({rtokens('sentence')}) AS token FROM s)),
tw AS (SELECT id, token, count(*) AS d FROM ti GROUP BY id, token),
t0 AS MATERIALIZED (SELECT ti.id, ti.sent_pos, sum(d - 1) AS deg, count(*) AS nw, 1.0::DOUBLE AS s FROM ti JOIN tw ON ti.id = tw.id AND ti.token = tw.token
       GROUP BY ti.id, ti.sent_pos)"""]
    for k in range(1, rounds + 1):
        out.append(f"""q{k} AS MATERIALIZED (SELECT id, sent_pos, deg, nw, CASE WHEN deg > 0 THEN s / deg ELSE 0.0 END AS q FROM t{k - 1}),
m{k} AS (SELECT ti.id, ti.token, sum(q) AS m FROM ti JOIN q{k} AS q ON ti.id = q.id AND ti.sent_pos = q.sent_pos GROUP BY ti.id, ti.token),
v{k} AS (SELECT ti.id, ti.sent_pos, sum(m) AS m FROM ti JOIN m{k} AS m ON ti.id = m.id AND ti.token = m.token GROUP BY ti.id, ti.sent_pos),
t{k} AS MATERIALIZED (SELECT q.id, q.sent_pos, deg, nw, {1 - damping!r} + {damping!r} * (m - q * nw) AS s
       FROM q{k} AS q JOIN v{k} AS v ON q.id = v.id AND q.sent_pos = v.sent_pos)""")
    out.append(f"""tr AS (SELECT id, sent_pos, row_number() OVER (PARTITION BY id ORDER BY round(s, 9) DESC, sent_pos) AS rk FROM t{rounds}),
tsum AS (SELECT tr.id, string_agg(s.sentence, ' ' ORDER BY tr.sent_pos) AS summary
         FROM tr JOIN s ON tr.id = s.id AND tr.sent_pos = s.sent_pos WHERE rk <= {n} GROUP BY tr.id)""")
    return ",\n".join(out)


def systems_ctes() -> str:
    """articles -> sys(id, lang, target, source, system, summary, status) for lead1, lead3, frequency, python_first_sentence."""
    return f"""{sents_ctes()}, {freq_ctes()},
sys0 AS (
  SELECT id, lang, target, source, 'lead1' AS system, array_to_string(sl[1:1], ' ') AS summary, 'ok' AS st FROM sl
  UNION ALL SELECT id, lang, target, source, 'lead3', array_to_string(sl[1:3], ' '), 'ok' FROM sl
  UNION ALL SELECT sl.id, lang, target, source, 'frequency', coalesce(fsum.summary, ''), 'ok' FROM sl LEFT JOIN fsum ON sl.id = fsum.id
  UNION ALL SELECT id, lang, target, source, 'python_first_sentence',
     CASE WHEN regexp_matches(source, '[.!?]') THEN regexp_extract(source, '^[^.!?]*[.!?]') ELSE '' END,
     CASE WHEN regexp_matches(source, '[.!?]') THEN 'ok' ELSE 'Error' END FROM sl),
sys AS (SELECT id, lang, target, source, system, summary,
  CASE WHEN st = 'ok' AND coalesce(length(summary), 0) = 0 THEN 'Missing' ELSE st END AS status FROM sys0)"""


def hits_cte(name: str, src: str, keys: str, a: str, b: str) -> str:
    """Relational clipped overlap of list columns a, b of {src} per key:
    {name}(keys..., hits) — rows only for keys with at least one gram."""
    return f"""{name}_u AS (SELECT {keys}, 0 AS side, unnest({a}) AS g FROM {src}
  UNION ALL SELECT {keys}, 1 AS side, unnest({b}) AS g FROM {src}),
{name} AS (SELECT {keys}, sum(least(ca, cb)) AS hits FROM (
  SELECT {keys}, g, count(*) FILTER (WHERE side = 0) AS ca, count(*) FILTER (WHERE side = 1) AS cb
  FROM {name}_u GROUP BY {keys}, g) GROUP BY {keys})"""


def rouge_row_ctes(src: str = "sys", longest: bool = False) -> str:
    """{src}(id, system, lang, summary, target) -> sc(id, system, lang, rouge1/rouge2 p r f, f1_raw), with rougeL too
    if ``longest`` (equal texts are their own longest common subsequence)."""
    hl = f"CASE WHEN ct = rt THEN len(ct) ELSE {lcs('ct', 'rt')} END AS hl," if longest else ""
    pl = f"{prf('hl', 'len(ct)', 'len(rt)', 'rougeL')}," if longest else ""
    return f"""tk AS (SELECT *, {rtokens('summary')} AS ct, {rtokens('target')} AS rt FROM {src}),
tk2 AS (SELECT id, system, lang, ct, rt, {ngrams('ct', 2)} AS c2, {ngrams('rt', 2)} AS r2 FROM tk),
{hits_cte('h1t', 'tk2', 'id, system', 'ct', 'rt')},
{hits_cte('h2t', 'tk2', 'id, system', 'c2', 'r2')},
hh AS (SELECT tk2.*, {hl} coalesce(h1t.hits, 0) AS h1, coalesce(h2t.hits, 0) AS h2 FROM tk2
  LEFT JOIN h1t ON tk2.id = h1t.id AND tk2.system = h1t.system
  LEFT JOIN h2t ON tk2.id = h2t.id AND tk2.system = h2t.system),
sc AS (SELECT id, system, lang, {prf('h1', 'len(ct)', 'len(rt)', 'rouge1')}, {prf('h2', 'len(c2)', 'len(r2)', 'rouge2')}, {pl}
       ({prf_f('h1', 'len(ct)', 'len(rt)')}) AS f1_raw FROM hh)"""


def prf_f(hits: str, nc: str, nr: str) -> str:
    p = f"(({hits}) / greatest({nc}, 1))"
    r = f"(({hits}) / greatest({nr}, 1))"
    return f"CASE WHEN {p} + {r} > 0 THEN 2 * {p} * {r} / ({p} + {r}) ELSE 0.0 END"


def lm_ctes(k: float = 1.0) -> str:
    """ids (full) -> V, lm(ctx, token, count, logp), ctx2(ctx, unseen_logp, mean_nll), am(ctx, next)."""
    return f"""V AS (SELECT count(*) AS v FROM vocab),
seqs AS (SELECT id, list_concat([1], si, [2]) AS seq FROM ids WHERE split = 'train'),
pairs AS (SELECT CAST(unnest(seq[1:len(seq) - 1]) AS VARCHAR) AS ctx, unnest(seq[2:len(seq)]) AS token FROM seqs),
cnt AS (SELECT ctx, token, count(*) AS count FROM pairs GROUP BY ctx, token),
lm AS (SELECT ctx, token, count, ln((count + {k}::DOUBLE) / (sum(count) OVER (PARTITION BY ctx) + {k}::DOUBLE * v)) AS logp
       FROM cnt, V),
ctxt AS (SELECT ctx, sum(count) AS total, count(*) AS n_seen, sum(logp) AS sum_logp FROM lm GROUP BY ctx),
ctx2 AS (SELECT ctx, ln({k}::DOUBLE / (total + {k}::DOUBLE * v)) AS unseen_logp,
         -(sum_logp + (v - n_seen) * ln({k}::DOUBLE / (total + {k}::DOUBLE * v))) / v AS mean_nll FROM ctxt, V),
am AS (SELECT ctx, first(token ORDER BY count DESC, token ASC) AS next FROM lm GROUP BY ctx)"""


def backoff_ctes(discount: float = 0.75, k: float = 1.0) -> str:
    """ids (full), vocab -> l1(w, p, lp) over the whole vocabulary, l2(v, w, p, lp), l3(u, v, w, p, lp) of seen successors,
    b2(v, t, wt, bow), b3(u, v, t, wt, bow): the order-3 back-off model."""
    return f"""V AS (SELECT count(*) AS n FROM vocab),
seqs AS (SELECT id, list_concat([1], si, [2]) AS seq FROM ids WHERE split = 'train'),
tri AS (SELECT CASE WHEN i > 1 THEN seq[i - 1] END AS u, seq[i] AS v, seq[i + 1] AS w
        FROM (SELECT seq, unnest(range(1, len(seq))) AS i FROM seqs)),
g3 AS MATERIALIZED (SELECT u, v, w, count(*) AS c FROM tri GROUP BY ALL),
g2 AS MATERIALIZED (SELECT v, w, CAST(sum(c) AS BIGINT) AS c FROM g3 GROUP BY ALL),
g1 AS (SELECT w, CAST(sum(c) AS BIGINT) AS c FROM g2 GROUP BY w),
a1 AS (SELECT token_id AS w, (coalesce(g1.c, 0) + {k}::DOUBLE) / ((SELECT CAST(sum(c) AS BIGINT) FROM g1) + {k}::DOUBLE * n) AS p
       FROM vocab LEFT JOIN g1 ON g1.w = token_id, V),
l1 AS MATERIALIZED (SELECT w, p, round(ln(p), 9) AS lp FROM a1),
b2 AS MATERIALIZED (SELECT v, t, wt, round(ln(wt), 9) AS bow FROM (SELECT v, CAST(sum(c) AS BIGINT) AS t, {discount}::DOUBLE * count(*) / CAST(sum(c) AS BIGINT) AS wt
       FROM g2 GROUP BY v)),
l2 AS MATERIALIZED (SELECT v, w, p, round(ln(p), 9) AS lp FROM (SELECT g2.v, g2.w, (g2.c - {discount}::DOUBLE) / t + wt * l1.p AS p
       FROM g2 JOIN b2 ON g2.v = b2.v JOIN l1 ON g2.w = l1.w)),
h3 AS (SELECT * FROM g3 WHERE u IS NOT NULL),
b3 AS MATERIALIZED (SELECT u, v, t, wt, round(ln(wt), 9) AS bow FROM (SELECT u, v, CAST(sum(c) AS BIGINT) AS t, {discount}::DOUBLE * count(*) / CAST(sum(c) AS BIGINT) AS wt
       FROM h3 GROUP BY u, v)),
l3 AS MATERIALIZED (SELECT u, v, w, p, round(ln(p), 9) AS lp FROM (SELECT h3.u, h3.v, h3.w, (h3.c - {discount}::DOUBLE) / t + wt * l2.p AS p
       FROM h3 JOIN b3 ON h3.u = b3.u AND h3.v = b3.v JOIN l2 ON h3.v = l2.v AND h3.w = l2.w))"""


def beam_ctes(beam: int, steps: int) -> str:
    """st(id, prompt) and the back-off model -> bs(id, step, beam, score, gen, done); every live beam meets the whole vocabulary."""
    lp = "coalesce(l3.lp, coalesce(b3.bow, 0) + coalesce(l2.lp, coalesce(b2.bow, 0) + l1.lp))"
    return f"""bs AS (
  SELECT id, 0 AS step, 0 AS beam, 0.0::DOUBLE AS score, CASE WHEN len(prompt) > 1 THEN prompt[len(prompt) - 1] END AS u,
         prompt[len(prompt)] AS v, []::INTEGER[] AS gen, false AS done FROM st
  UNION ALL
  SELECT id, step, beam, score, u, v, gen, done FROM (
    SELECT id, step, CAST(row_number() OVER (PARTITION BY id ORDER BY score DESC, parent, rank) - 1 AS INTEGER) AS beam, score, u, v, gen, done
    FROM (SELECT id, step + 1 AS step, parent, CASE WHEN w IS NULL THEN -1 ELSE rank END AS rank, score + coalesce(lp, 0) AS score,
                 CASE WHEN w IS NULL THEN u ELSE v END AS u, coalesce(w, v) AS v, CASE WHEN w IS NULL THEN gen ELSE list_append(gen, w) END AS gen,
                 w IS NULL OR w = 2 AS done
          FROM (SELECT b.id, b.step, b.beam AS parent, b.score, b.u, b.v, b.gen, l1.w, {lp} AS lp,
                       row_number() OVER (PARTITION BY b.id, b.beam ORDER BY {lp} DESC, l1.w) AS rank
                FROM bs b LEFT JOIN l1 ON NOT b.done LEFT JOIN b2 ON b2.v = b.v LEFT JOIN l2 ON l2.v = b.v AND l2.w = l1.w
                LEFT JOIN b3 ON b3.u = b.u AND b3.v = b.v LEFT JOIN l3 ON l3.u = b.u AND l3.v = b.v AND l3.w = l1.w WHERE b.step < {steps})
          WHERE rank <= {beam})) WHERE beam < {beam})"""


def char_grams(x: str) -> str:
    words = (f"list_filter(string_split(regexp_replace(lower(coalesce({x}, '')), '[^\\p{{L}}]+', ' ', 'g'), ' '), "
             f"lambda w: w <> '')")
    return (f"flatten(list_transform({words}, lambda w: flatten(list_transform(range(1, 4), lambda n: "
            f"list_transform(range(1, length('_' || w || '_') - n + 2), lambda i: substring('_' || w || '_', i, n))))))")


def doc_split_cte() -> str:
    """documents with their exact 80/10/10 split: dsplit(id, lang, text, split)."""
    return f"""dsplit AS (SELECT id, lang, text, {three_way()} AS split FROM (
  SELECT *, row_number() OVER (ORDER BY h, id) - 1 AS pos, count(*) OVER () AS n FROM (
    SELECT CAST(doc_id AS VARCHAR) AS id, lang, text, {shuffle_key('CAST(doc_id AS VARCHAR)')} AS h FROM documents)))"""


def lang_ctes(top: int = 300) -> str:
    return f"""lg AS (SELECT lang, unnest({char_grams('text')}) AS gram FROM dsplit WHERE split = 'train'),
lc AS (SELECT lang, gram, count(*) AS cnt FROM lg GROUP BY lang, gram),
prof AS (SELECT lang, gram, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY cnt DESC, gram) AS rank FROM lc) WHERE rank <= {top}),
dg AS (SELECT id, unnest({char_grams('text')}) AS gram FROM dsplit),
dcn AS (SELECT id, gram, count(*) AS cnt FROM dg GROUP BY id, gram),
dp AS (SELECT id, gram, rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY cnt DESC, gram) AS rank FROM dcn)
  WHERE rank <= {top}),
nd AS (SELECT id, count(*) AS n FROM dp GROUP BY id),
mm AS (SELECT dp.id, prof.lang, sum(abs(dp.rank - prof.rank)) AS s, count(*) AS matched
  FROM dp JOIN prof ON dp.gram = prof.gram GROUP BY dp.id, prof.lang),
dist AS (SELECT mm.id, lang, s + {top} * (n - matched) AS dist FROM mm JOIN nd ON mm.id = nd.id),
best AS (SELECT id, first(lang ORDER BY dist, lang) AS detected FROM dist GROUP BY id),
det AS (SELECT d.id, d.lang, coalesce(best.detected, 'en') AS detected FROM dsplit d LEFT JOIN best ON d.id = best.id)"""


def epoch_ctes(epochs: int = 5) -> str:
    """ids + vocab -> tr/va pairs with epoch/batch -> log(epoch, train_loss, val_loss)."""
    return f"""V AS (SELECT count(*) AS v FROM vocab),
rows_ AS (SELECT id, split, list_concat([1], si, [2]) AS seq, {shuffle_key('id')} AS h,
          ({shuffle_key('id', 7)} * {epochs}) // 4294967296 + 1 AS shard FROM ids),
trr AS (SELECT id, seq, shard, (row_number() OVER (PARTITION BY shard ORDER BY h, id) - 1) // 8 AS batch
        FROM rows_ WHERE split = 'train'),
var AS (SELECT id, seq, (row_number() OVER (ORDER BY h, id) - 1) // 8 AS batch FROM rows_ WHERE split = 'validation'),
tp AS (SELECT shard, batch, CAST(unnest(seq[1:len(seq) - 1]) AS VARCHAR) AS ctx, unnest(seq[2:len(seq)]) AS token FROM trr),
vp AS (SELECT batch, CAST(unnest(seq[1:len(seq) - 1]) AS VARCHAR) AS ctx, unnest(seq[2:len(seq)]) AS token FROM var),
sc AS (SELECT shard, ctx, token, count(*) AS c FROM tp GROUP BY ALL),
ce AS (SELECT e AS epoch, ctx, token, sum(c) AS c FROM (SELECT unnest(range(shard, {epochs} + 1)) AS e, ctx, token, c FROM sc)
       GROUP BY ALL),
te AS (SELECT epoch, ctx, sum(c) AS t FROM ce GROUP BY ALL),
trl AS (SELECT tp.shard AS epoch, tp.batch, -ln((coalesce(ce.c, 0) + 1.0) / (coalesce(te.t, 0) + v)) AS loss
        FROM tp LEFT JOIN ce ON ce.epoch = tp.shard AND ce.ctx = tp.ctx AND ce.token = tp.token
        LEFT JOIN te ON te.epoch = tp.shard AND te.ctx = tp.ctx, V),
vpe AS (SELECT unnest(range(1, {epochs} + 1)) AS epoch, batch, ctx, token FROM vp),
val AS (SELECT vpe.epoch, vpe.batch, -ln((coalesce(ce.c, 0) + 1.0) / (coalesce(te.t, 0) + v)) AS loss
        FROM vpe LEFT JOIN ce ON ce.epoch = vpe.epoch AND ce.ctx = vpe.ctx AND ce.token = vpe.token
        LEFT JOIN te ON te.epoch = vpe.epoch AND te.ctx = vpe.ctx, V),
trm AS (SELECT epoch, avg(b) AS train_loss FROM (SELECT epoch, batch, avg(loss) AS b FROM trl GROUP BY ALL) GROUP BY epoch),
vam AS (SELECT epoch, avg(b) AS val_loss FROM (SELECT epoch, batch, avg(loss) AS b FROM val GROUP BY ALL) GROUP BY epoch),
elog AS (SELECT trm.epoch, train_loss, val_loss FROM trm JOIN vam ON trm.epoch = vam.epoch)"""
