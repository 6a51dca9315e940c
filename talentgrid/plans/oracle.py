"""DuckDB SQL twins of the registered queries (independent formulation, brute force)."""

from __future__ import annotations

from talentgrid.plans import bindings as B
from talentgrid.plans.sqlgen import q, values, vocab_values, skill_values, html_text_sql  # noqa: F401

ORACLE: dict[str, str] = {}


def _fallback_scores_sql(vocab) -> str:
    return f"""
WITH v AS (SELECT * FROM {vocab_values(vocab)}),
d AS (SELECT doc_id, lower(text) AS t FROM documents),
h AS (SELECT d.doc_id, v.domain_ord,
             (length(d.t) - length(replace(d.t, v.kw, ''))) // length(v.kw) AS occ
      FROM d JOIN v ON contains(d.t, v.kw)),
u AS (SELECT doc_id, domain_ord,
             sum(CASE WHEN occ > 1 THEN 2 * least(occ, 3) ELSE 1 END) AS units
      FROM h GROUP BY doc_id, domain_ord),
dd AS (SELECT DISTINCT domain, domain_ord FROM v),
s AS (SELECT d.doc_id, dd.domain, dd.domain_ord,
             least(1.0::DOUBLE, 0.5::DOUBLE + coalesce(u.units, 0) * 0.025::DOUBLE) AS score
      FROM d CROSS JOIN dd LEFT JOIN u ON u.doc_id = d.doc_id AND u.domain_ord = dd.domain_ord)
"""


ORACLE["domain_scores_fallback"] = _fallback_scores_sql(B.LANG_VOCAB) + """
SELECT doc_id, domain, round(score, 6) AS score FROM s
"""

ORACLE["main_domain"] = _fallback_scores_sql(B.LANG_VOCAB) + """
SELECT doc_id, main_domain, round(main_score, 6) AS main_score FROM (
  SELECT doc_id, domain AS main_domain, score AS main_score,
         row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, domain_ord) AS rn
  FROM s) WHERE rn = 1
"""


# ------------------------------------------------------------------ shared CTE builders
def d1_cte(name: str, src: str, id_col: str, text_expr: str, vocab) -> str:
    """CTEs computing fallback scores of ``src``; yields ``{name}`` with
    (id, main_domain, main_score)."""
    return f"""
{name}_v AS (SELECT * FROM {vocab_values(vocab)}),
{name}_d AS (SELECT {id_col} AS id, {text_expr} AS t FROM {src}),
{name}_h AS (SELECT d.id, v.domain_ord, (length(d.t) - length(replace(d.t, v.kw, ''))) // length(v.kw) AS occ
             FROM {name}_d d JOIN {name}_v v ON contains(d.t, v.kw)),
{name}_u AS (SELECT id, domain_ord, sum(CASE WHEN occ > 1 THEN 2 * least(occ, 3) ELSE 1 END) AS units
             FROM {name}_h GROUP BY id, domain_ord),
{name}_dd AS (SELECT DISTINCT domain, domain_ord FROM {name}_v),
{name}_s AS (SELECT d.id, dd.domain, dd.domain_ord,
                    least(1.0::DOUBLE, 0.5::DOUBLE + coalesce(u.units, 0) * 0.025::DOUBLE) AS score
             FROM {name}_d d CROSS JOIN {name}_dd dd
             LEFT JOIN {name}_u u ON u.id = d.id AND u.domain_ord = dd.domain_ord),
{name} AS (SELECT id, domain AS main_domain, score AS main_score FROM (
             SELECT id, domain, score, row_number() OVER (PARTITION BY id ORDER BY score DESC, domain_ord) AS rn
             FROM {name}_s) WHERE rn = 1)"""


def skills_cte(name: str, src: str, id_col: str, text_expr: str, skills, limit: int | None = 10) -> str:
    """``{name}`` = (id, skill, skill_ord, kw, rn) for the first ``limit`` contained skills."""
    lim = f"WHERE rn <= {limit}" if limit else ""
    return f"""
{name}_v AS (SELECT * FROM {skill_values(skills)}),
{name}_all AS (SELECT s.{id_col} AS id, v.skill, v.skill_ord, v.kw,
                      row_number() OVER (PARTITION BY s.{id_col} ORDER BY v.skill_ord) AS rn
               FROM {src} s JOIN {name}_v v ON contains({text_expr}, v.kw)),
{name} AS (SELECT * FROM {name}_all {lim})"""


def cv_offer_ctes(open_: bool = False) -> str:
    """cv(cv_id, domain, n), cvsk(cv_id, skill, kw, pos), off(offer_id, domain, raw_score, text, title_lower);
    ``open_``: the CVs of the binding ``open_cvs``."""
    own = """
        UNION ALL SELECT doc_id, w, w, (SELECT count(*) FROM cvsk0 WHERE cvsk0.id = doc_id)
        FROM (SELECT doc_id, regexp_extract(lower(text), '[a-z]{6,}') AS w FROM documents) WHERE w <> ''"""
    who = "CASE d.doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'elsewhere' ELSE d.lang END" if open_ else "d.main_domain"
    return f"""WITH
{d1_cte('cvd1', 'documents', 'doc_id', 'lower(text)', B.LANG_VOCAB)},
{skills_cte('cvsk0', 'documents', 'doc_id', 'lower(s.text)', B.TEST_SKILLS)},
cvsk AS (SELECT id AS cv_id, skill, kw, rn - 1 AS pos FROM cvsk0 {own if open_ else ''}),
cv AS (SELECT d.{'doc_id' if open_ else 'id'} AS cv_id, {who} AS domain,
              (SELECT count(*) FROM cvsk WHERE cvsk.cv_id = d.{'doc_id' if open_ else 'id'}) AS n
       FROM {'documents' if open_ else 'cvd1'} d),
pg AS (SELECT page_id AS offer_id,
              regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title,
              {html_text_sql('html')} AS description FROM pages),
pgt AS (SELECT offer_id, lower(title) AS title_lower, lower(concat_ws(' ', title, description)) AS text FROM pg),
{d1_cte('od1', 'pgt', 'offer_id', 'text', B.LANG_VOCAB)},
off AS (SELECT p.offer_id, o.main_domain AS domain, o.main_score AS raw_score, p.text, p.title_lower
        FROM pgt p JOIN od1 o ON o.id = p.offer_id),
hits AS (SELECT k.cv_id, o.offer_id, count(*) AS h FROM cvsk k JOIN off o ON contains(o.text, k.kw)
         GROUP BY k.cv_id, o.offer_id),
pairs AS (SELECT c.cv_id, c.domain AS cv_domain, c.n, o.offer_id, o.domain AS o_domain, o.raw_score,
                 coalesce(hits.h, 0) AS h
          FROM cv c CROSS JOIN off o LEFT JOIN hits ON hits.cv_id = c.cv_id AND hits.offer_id = o.offer_id)"""


ORACLE["extract_skills"] = f"""WITH
{skills_cte('sk', 'documents', 'doc_id', 'lower(s.text)', B.TEST_SKILLS)}
SELECT d.doc_id, coalesce(string_agg(sk.skill, ',' ORDER BY sk.skill_ord), '') AS skills,
       count(sk.skill)::BIGINT AS n_skills
FROM documents d LEFT JOIN sk ON sk.id = d.doc_id GROUP BY d.doc_id
"""

ORACLE["extract_titles"] = f"""WITH
{skills_cte('tt', 'documents', 'doc_id', 'lower(s.text)', B.TEST_TITLES, None)},
agg AS (SELECT d.doc_id, string_agg(tt.skill, ',' ORDER BY tt.skill_ord) AS all_t,
               count(tt.skill) AS n FROM documents d LEFT JOIN tt ON tt.id = d.doc_id GROUP BY d.doc_id),
top3 AS (SELECT d.doc_id, string_agg(tt.skill, ',' ORDER BY tt.skill_ord) AS t3
         FROM documents d JOIN tt ON tt.id = d.doc_id WHERE tt.rn <= 3 GROUP BY d.doc_id)
SELECT agg.doc_id,
       CASE WHEN agg.n = 0 THEN {q(','.join(B.TEST_DEFAULT_TITLES))} ELSE top3.t3 END AS job_titles,
       CASE WHEN agg.n = 0 THEN {q(B.TEST_DEFAULT_TITLES[0])} ELSE split_part(agg.all_t, ',', 1) END AS best_title
FROM agg LEFT JOIN top3 USING (doc_id)
"""

ORACLE["skill_frequency"] = f"""WITH
{skills_cte('sk', 'documents', 'doc_id', 'lower(s.text)', B.TEST_SKILLS, None)}
SELECT skill, count(*)::BIGINT AS n_docs FROM sk GROUP BY skill
"""

ORACLE["match_rules_topk"] = cv_offer_ctes() + """,
sc AS (SELECT cv_id, offer_id, h, o_domain = cv_domain AS domain_match,
              least(1.0::DOUBLE, (0.1::DOUBLE + CASE WHEN o_domain = cv_domain THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END)
                    + CASE WHEN n > 0 THEN least(0.6::DOUBLE, (h / n) * 0.6::DOUBLE) ELSE 0.0::DOUBLE END) AS score
       FROM pairs),
rk AS (SELECT *, row_number() OVER (PARTITION BY cv_id ORDER BY score DESC, offer_id) AS rank
       FROM sc WHERE score >= 0.3)
SELECT cv_id, rank::BIGINT AS rank, offer_id, round(score, 6) AS score, h::BIGINT AS matched_skills, domain_match
FROM rk WHERE rank <= 5
"""

ORACLE["match_bonus_topk"] = cv_offer_ctes() + """,
sc AS (SELECT cv_id, offer_id, raw_score, h,
              least(0.3::DOUBLE, h * 0.05::DOUBLE) AS skills_bonus,
              (raw_score + CASE WHEN o_domain = cv_domain THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END)
                + least(0.3::DOUBLE, h * 0.05::DOUBLE) AS score
       FROM pairs),
rk AS (SELECT *, row_number() OVER (PARTITION BY cv_id ORDER BY score DESC, offer_id) AS rank FROM sc)
SELECT cv_id, rank::BIGINT AS rank, offer_id, round(raw_score, 6) AS raw_score, round(skills_bonus, 6) AS skills_bonus,
       h::BIGINT AS matched_skills, round(score, 6) AS score
FROM rk WHERE rank <= 5
"""


def _weights_values() -> str:
    rows = [(d, kw.lower(), int(round(w * 100))) for d, kws in B.LANG_WEIGHTS.items() for kw, w in kws.items()]
    return values(rows, ["domain", "kw", "u"])


ORACLE["match_weighted_topk"] = cv_offer_ctes() + f""",
wv AS (SELECT * FROM {_weights_values()}),
ku AS (SELECT o.offer_id, wv.domain, least(30, sum(wv.u)) AS kw_u FROM off o JOIN wv ON contains(o.text, wv.kw)
       GROUP BY o.offer_id, wv.domain),
lastpos AS (SELECT cv_id, kw, max(pos) AS lp FROM cvsk GROUP BY cv_id, kw),
su AS (SELECT k.cv_id, o.offer_id, count(*) AS h,
              sum(CASE WHEN l.lp < 3 THEN 15 ELSE 10 END + CASE WHEN contains(o.title_lower, k.kw) THEN 5 ELSE 0 END) AS s_u
       FROM cvsk k JOIN lastpos l ON l.cv_id = k.cv_id AND l.kw = k.kw
       JOIN off o ON contains(o.text, k.kw) GROUP BY k.cv_id, o.offer_id),
sc AS (SELECT p.cv_id, p.offer_id, coalesce(su.h, 0) AS h, coalesce(ku.kw_u, 0) AS kw_u,
              least(100, 20 + least(50, coalesce(su.s_u, 0)) + coalesce(ku.kw_u, 0)) / 100.0::DOUBLE AS score
       FROM pairs p LEFT JOIN su ON su.cv_id = p.cv_id AND su.offer_id = p.offer_id
       LEFT JOIN ku ON ku.offer_id = p.offer_id AND ku.domain = p.cv_domain),
rk AS (SELECT *, row_number() OVER (PARTITION BY cv_id ORDER BY score DESC, offer_id) AS rank FROM sc)
SELECT cv_id, rank::BIGINT AS rank, offer_id, round(score, 6) AS score, h::BIGINT AS matched_skills,
       kw_u::BIGINT AS domain_units
FROM rk WHERE rank <= 5
"""


_OPEN_SCORE = {
    "match_rules_open": ("""least(1.0::DOUBLE, (0.1::DOUBLE + CASE WHEN o_domain = cv_domain THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END)
                    + CASE WHEN n > 0 THEN least(0.6::DOUBLE, (h / n) * 0.6::DOUBLE) ELSE 0.0::DOUBLE END)""",
                         "coalesce(o_domain = cv_domain, false) AS domain_match, round(score, 6) AS score"),
    "match_bonus_open": ("""(raw_score + CASE WHEN o_domain = cv_domain THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END)
                + least(0.3::DOUBLE, h * 0.05::DOUBLE)""",
                         "round(raw_score, 6) AS raw_score, round(least(0.3::DOUBLE, h * 0.05::DOUBLE), 6) AS skills_bonus, round(score, 6) AS score")}
for _name, (_score, _cols) in _OPEN_SCORE.items():
    ORACLE[_name] = cv_offer_ctes(True) + f""",
sc AS (SELECT *, {_score} AS score FROM pairs),
rk AS (SELECT *, row_number() OVER (PARTITION BY cv_id ORDER BY score DESC, offer_id) AS rank FROM sc)
SELECT cv_id, rank::BIGINT AS rank, offer_id, h::BIGINT AS matched_skills, {_cols} FROM rk WHERE rank <= 5
"""

_KW_ORD = values([(d, kw, i) for d, kws in B.LANG_WEIGHTS.items() for i, kw in enumerate(kws)], ["domain", "kw", "ord"])
ORACLE["match_weighted_open"] = ORACLE["match_weighted_topk"].replace(cv_offer_ctes(), cv_offer_ctes(True)).replace(
    "SELECT cv_id, rank::BIGINT", f"""SELECT rk.cv_id, rk.rank::BIGINT""").replace("offer_id, round(score", "rk.offer_id, round(score").replace(
    "kw_u::BIGINT AS domain_units\nFROM rk WHERE rank <= 5", f"""kw_u::BIGINT AS domain_units,
       coalesce((SELECT string_agg((SELECT f.skill FROM cvsk f WHERE f.cv_id = k.cv_id AND f.kw = k.kw ORDER BY f.pos LIMIT 1), ',' ORDER BY k.pos)
        FROM cvsk k WHERE k.cv_id = rk.cv_id AND contains(o.text, k.kw)), '') AS skill_matches,
       coalesce((SELECT string_agg(w.kw, ',' ORDER BY w.ord) FROM (SELECT * FROM {_KW_ORD}) w WHERE w.domain = c.domain AND contains(o.text, w.kw)), '') AS domain_matches
FROM rk JOIN off o USING (offer_id) JOIN cv c ON c.cv_id = rk.cv_id WHERE rank <= 5""")


ORACLE["batch_match"] = """WITH top AS (SELECT cv_id, string_agg(rank::VARCHAR || ':' || offer_id::VARCHAR || ':' || printf('%.4f', score), ',' ORDER BY rank) AS results
    FROM (""" + ORACLE["match_rules_topk"] + """) GROUP BY cv_id), x AS (SELECT 1),""" + cv_offer_ctes().replace("WITH", "", 1) + """
SELECT c.cv_id::VARCHAR AS cv_id, CASE WHEN c.cv_id % 97 NOT IN (0, 2) THEN c.domain END AS main_domain,
    CASE WHEN c.cv_id % 97 NOT IN (0, 2) THEN coalesce((SELECT string_agg(k.skill, ',' ORDER BY k.pos) FROM cvsk k WHERE k.cv_id = c.cv_id), '') ELSE '' END AS skills,
    CASE WHEN c.cv_id % 97 NOT IN (0, 2) THEN coalesce(t.results, '') ELSE '' END AS results,
    CASE c.cv_id % 97 WHEN 0 THEN 'ValueError: no text extractor for pdf files' WHEN 2 THEN 'ValueError: empty text' END AS error
FROM cv c LEFT JOIN top t USING (cv_id) WHERE c.cv_id % 97 <> 1
"""


def _basic_oracle() -> str:
    return f"""WITH
v AS (SELECT * FROM {vocab_values(B.BASIC_VOCAB)}),
sv AS (SELECT * FROM {skill_values(B.TEST_SKILLS)}),
sdom AS (SELECT DISTINCT sv.skill, sv.kw, v.domain, v.domain_ord FROM sv JOIN v ON contains(sv.kw, v.kw)),
d AS (SELECT doc_id, lower(text) AS t FROM documents),
kh AS (SELECT d.doc_id, v.domain, count(*) AS c FROM d JOIN v ON contains(d.t, v.kw) GROUP BY 1, 2),
sh AS (SELECT d.doc_id, sdom.domain, count(*) AS c FROM d JOIN sdom ON contains(d.t, sdom.kw) GROUP BY 1, 2),
dd AS (SELECT DISTINCT domain FROM v),
s AS (SELECT d.doc_id, dd.domain, coalesce(kh.c, 0) + 0.5::DOUBLE * coalesce(sh.c, 0) AS score
      FROM d CROSS JOIN dd LEFT JOIN kh ON kh.doc_id = d.doc_id AND kh.domain = dd.domain
      LEFT JOIN sh ON sh.doc_id = d.doc_id AND sh.domain = dd.domain)
SELECT doc_id, domain, round(score::DOUBLE, 6) AS score FROM s WHERE score > 0
"""


ORACLE["domain_scores_basic"] = _basic_oracle()


def _ext_oracle() -> str:
    from talentgrid import vocab as VV
    rows = []
    defaults = VV.DEFAULT_SKILLS_EXTENDED
    for di, (dom, kws) in enumerate(B.EXT_VOCAB.items()):
        kl = {k.lower() for k in kws}
        for sname in list(dict.fromkeys(B.TEST_SKILLS + defaults)):
            u = (2 if B.EXT_SKILL_DOMAIN.get(sname) == dom else 0) + (1 if sname.lower() in kl else 0)
            if u:
                rows.append((sname, dom, u))
    bonus = values(rows, ["skill", "domain", "u"]) if rows else "(SELECT NULL AS skill, NULL AS domain, 0 AS u) t"
    dflt = values([(s,) for s in defaults], ["skill"])
    return f"""WITH
v AS (SELECT * FROM {vocab_values(B.EXT_VOCAB)}),
vl AS (SELECT domain, count(*) AS len FROM v GROUP BY domain),
sv AS (SELECT * FROM {skill_values(B.TEST_SKILLS)}),
bu AS (SELECT * FROM {bonus}),
df AS (SELECT * FROM {dflt}),
d AS (SELECT doc_id, lower(text) AS t FROM documents),
found AS (SELECT d.doc_id, sv.skill FROM d JOIN sv ON contains(d.t, sv.kw)),
nf AS (SELECT d.doc_id, count(found.skill) AS n FROM d LEFT JOIN found USING (doc_id) GROUP BY d.doc_id),
sk AS (SELECT doc_id, skill FROM found
       UNION ALL SELECT nf.doc_id, df.skill FROM nf CROSS JOIN df WHERE nf.n = 0),
b AS (SELECT sk.doc_id, bu.domain, sum(bu.u) AS u FROM sk JOIN bu ON bu.skill = sk.skill GROUP BY 1, 2),
kh AS (SELECT d.doc_id, v.domain, count(*) AS c FROM d JOIN v ON contains(d.t, v.kw) GROUP BY 1, 2),
s AS (SELECT d.doc_id, vl.domain,
             least(1.0::DOUBLE, least(0.5::DOUBLE, 0.1::DOUBLE + (coalesce(kh.c, 0) / vl.len::DOUBLE) * 0.4::DOUBLE)
                   + coalesce(b.u, 0) * 0.05::DOUBLE) AS score
      FROM d CROSS JOIN vl LEFT JOIN kh ON kh.doc_id = d.doc_id AND kh.domain = vl.domain
      LEFT JOIN b ON b.doc_id = d.doc_id AND b.domain = vl.domain)
SELECT doc_id, domain, round(score, 6) AS score FROM s
"""


ORACLE["domain_scores_extended"] = _ext_oracle()

ORACLE["guess_domain"] = f"""WITH
v AS (SELECT * FROM {vocab_values(B.LANG_VOCAB)}),
pg AS (SELECT page_id AS offer_id,
              lower(concat_ws(' ', regexp_extract(html, '(?is)<title>(.*?)</title>', 1), {html_text_sql('html')})) AS t
       FROM pages),
h AS (SELECT pg.offer_id, v.domain, v.domain_ord,
             sum((length(pg.t) - length(replace(pg.t, v.kw, ''))) // length(v.kw)) AS occ
      FROM pg JOIN v ON contains(pg.t, v.kw) GROUP BY 1, 2, 3),
dd AS (SELECT DISTINCT domain, domain_ord FROM v),
s AS (SELECT pg.offer_id, dd.domain, dd.domain_ord, coalesce(h.occ, 0) AS occ
      FROM pg CROSS JOIN dd LEFT JOIN h ON h.offer_id = pg.offer_id AND h.domain = dd.domain),
b AS (SELECT *, row_number() OVER (PARTITION BY offer_id ORDER BY occ DESC, domain_ord) AS rn FROM s)
SELECT offer_id, CASE WHEN occ > 0 THEN domain END AS guessed_domain, occ::BIGINT AS occurrences FROM b WHERE rn = 1
"""

ORACLE["classify_confidence"] = f"""WITH
v AS (SELECT * FROM {vocab_values(B.BASIC_VOCAB)}),
d AS (SELECT doc_id, lower(text) AS t FROM documents),
h AS (SELECT d.doc_id, v.domain, v.domain_ord, count(*) AS n FROM d JOIN v ON contains(d.t, v.kw) GROUP BY 1, 2, 3),
dd AS (SELECT DISTINCT domain, domain_ord FROM v),
s AS (SELECT d.doc_id, dd.domain, dd.domain_ord, coalesce(h.n, 0) AS n
      FROM d CROSS JOIN dd LEFT JOIN h ON h.doc_id = d.doc_id AND h.domain = dd.domain),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, domain_ord) AS rn FROM s)
SELECT doc_id, CASE WHEN n = 0 THEN 'en' ELSE domain END AS classification,
       round(CASE WHEN n = 0 THEN 0.5::DOUBLE ELSE least(1.0::DOUBLE, n / 5.0::DOUBLE) END, 6) AS confidence
FROM b WHERE rn = 1
"""


def _competence_oracle() -> str:
    rows, tots = [], []
    for d, cs in B.LANG_COMPETENCES.items():
        for c, kws in cs.items():
            tots.append((d, c, len(kws)))
            for k in kws:
                rows.append((d, c, k.lower()))
    return f"""WITH
cv AS (SELECT * FROM {values(rows, ['domain', 'competence', 'kw'])}),
ct AS (SELECT * FROM {values(tots, ['domain', 'competence', 'n_total'])}),
d AS (SELECT doc_id, lower(text) AS t FROM documents),
h AS (SELECT d.doc_id, cv.domain, cv.competence, count(*) AS n FROM d JOIN cv ON contains(d.t, cv.kw) GROUP BY 1, 2, 3)
SELECT d.doc_id, ct.domain, ct.competence, coalesce(h.n, 0)::BIGINT AS n_found, ct.n_total::BIGINT AS n_total,
       round(coalesce(h.n, 0) / ct.n_total::DOUBLE, 6) AS level
FROM d CROSS JOIN ct LEFT JOIN h ON h.doc_id = d.doc_id AND h.domain = ct.domain AND h.competence = ct.competence
"""


ORACLE["competence_coverage"] = _competence_oracle()


# ------------------------------------------------------------------ embeddings
def _emb_ctes() -> str:
    rel = [(a, b) for a, bs in B.EMB_RELATED.items() for b in bs]
    return f"""WITH
e AS (SELECT vec_id, embedding::DOUBLE[] AS v, 'L' || label::VARCHAR AS dom FROM embeddings),
rel AS (SELECT * FROM {values(rel, ['a', 'b'])}),
p AS (SELECT q.vec_id AS qid, i.vec_id AS iid, list_cosine_similarity(q.v, i.v) AS cos,
             CASE WHEN q.dom = i.dom THEN 1.0::DOUBLE WHEN r.a IS NOT NULL THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS dsim
      FROM e q JOIN e i ON q.vec_id <> i.vec_id LEFT JOIN rel r ON r.a = q.dom AND r.b = i.dom)"""


ORACLE["match_embedding_topk"] = _emb_ctes() + """,
s AS (SELECT *, 0.7::DOUBLE * cos + 0.3::DOUBLE * dsim AS score FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, iid) AS rank FROM s)
SELECT qid AS cv_id, rank::BIGINT AS rank, iid AS offer_id, round(cos, 6) AS cosine, round(dsim, 6) AS domain_sim,
       round(score, 6) AS score FROM r WHERE rank <= 3
"""

ORACLE["vector_search_domain"] = _emb_ctes() + """,
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY cos DESC, iid) AS rank FROM p),
t AS (SELECT *, max(CASE WHEN dsim = 1.0 THEN 1 ELSE 0 END) OVER (PARTITION BY qid) AS any_m FROM r WHERE rank <= 5)
SELECT qid AS query_id, rank::BIGINT AS rank, iid AS item_id, round(cos, 6) AS cosine
FROM t WHERE dsim = 1.0 OR any_m = 0
"""

_CENTROIDS = """
comp AS (SELECT label, pos, avg(x) AS m FROM (
           SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings)
         GROUP BY label, pos),
cen AS (SELECT label, list(m ORDER BY pos) AS c FROM comp GROUP BY label)"""

ORACLE["similarity_matrix"] = f"""WITH {_CENTROIDS}
SELECT a.label::BIGINT AS label_a, b.label::BIGINT AS label_b, round(list_cosine_similarity(a.c, b.c), 6) AS cosine
FROM cen a CROSS JOIN cen b
"""

ORACLE["composite_embedding"] = f"""WITH {_CENTROIDS},
mix AS (SELECT e.vec_id, list_transform(list_zip(e.embedding::DOUBLE[], cen.c), lambda z: z[1] * 0.7 + z[2] * 0.3) AS m
        FROM embeddings e JOIN cen ON cen.label = e.label),
nm AS (SELECT vec_id, m, sqrt(list_sum(list_transform(m, lambda x: x * x))) AS n FROM mix),
cm AS (SELECT vec_id, CASE WHEN n = 0 THEN m ELSE list_transform(m, lambda x: x / n) END AS c FROM nm)
SELECT vec_id, round(c[1], 6) AS c0, round(list_sum(c), 6) AS csum,
       round(sqrt(list_sum(list_transform(c, lambda x: x * x))), 6) AS cnorm FROM cm
"""


# ------------------------------------------------------------------ ids / dedup / merge
ORACLE["offer_ids"] = f"""
WITH pg AS (SELECT page_id AS offer_id, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title,
                   regexp_extract(url, '://([^/]+)', 1) AS company,
                   regexp_extract(url, '/(en|fr|de|es)/', 1) AS location,
                   {html_text_sql('html')} AS description FROM pages)
SELECT offer_id, md5(concat_ws('|', nullif(title, ''), nullif(company, ''), nullif(location, ''),
                               nullif(substring(description, 1, 100), ''))) AS offer_key FROM pg
"""

ORACLE["dedup_examples"] = """
WITH ex AS (SELECT doc_id, 'Analyse ce texte (' || lang || ').' AS instruction,
                   CASE WHEN length(text) > 2000 THEN substring(text, 1, 1997) || '...' ELSE text END AS input
            FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY instruction, substring(input, 1, 100) ORDER BY doc_id) AS rn FROM ex)
SELECT doc_id, length(input)::BIGINT AS input_len FROM r WHERE rn = 1
"""


def _greedy_sql(rounds: int = 12) -> str:
    parts = ["""WITH s0 AS (SELECT doc_id AS o, md5(lower(text)) AS k1,
                 split_part(text, chr(10), 1) AS title, source AS company, 0 AS st FROM documents)"""]
    for i in range(1, rounds + 1):
        p = f"s{i-1}"
        parts.append(f""",
a{i} AS (SELECT k1, min(CASE WHEN st <> 2 THEN o END) AS a1, min(CASE WHEN st = 1 THEN o END) AS p1 FROM {p} GROUP BY k1),
b{i} AS (SELECT title, company, min(CASE WHEN st <> 2 THEN o END) AS a2, min(CASE WHEN st = 1 THEN o END) AS p2
         FROM {p} GROUP BY title, company),
s{i} AS (SELECT x.o, x.k1, x.title, x.company,
                CASE WHEN x.st <> 0 THEN x.st
                     WHEN a.p1 < x.o OR b.p2 < x.o THEN 2
                     WHEN a.a1 = x.o AND b.a2 = x.o THEN 1 ELSE 0 END AS st
         FROM {p} x JOIN a{i} a ON a.k1 = x.k1
         JOIN b{i} b ON b.title IS NOT DISTINCT FROM x.title AND b.company IS NOT DISTINCT FROM x.company)""")
    parts.append(f"""
SELECT o AS doc_id, CASE WHEN st = 1 THEN TRUE WHEN st = 2 THEN FALSE END AS kept FROM s{rounds}""")
    return "".join(parts)


ORACLE["dedup_offers"] = _greedy_sql()


def _sub(name: str) -> str:
    return "(" + ORACLE[name].strip() + ")"


ORACLE["hybrid_merge"] = f"""
WITH v AS (SELECT cv_id, offer_id, score, 0 AS side, rank FROM {_sub('match_bonus_topk')}),
s AS (SELECT cv_id, offer_id, score, 1 AS side, rank FROM {_sub('match_rules_topk')}),
u AS (SELECT * FROM v UNION ALL
      SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.cv_id = s.cv_id AND v.offer_id = s.offer_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY cv_id ORDER BY score DESC, side, rank) AS rk FROM u)
SELECT cv_id, rk::BIGINT AS rank, offer_id, score, CASE WHEN side = 0 THEN 'vector' ELSE 'scraped' END AS source
FROM r WHERE rk <= 5
"""


# ------------------------------------------------------------------ evaluation
def _truth_ctes() -> str:
    rx = [(s, s.lower(), f"(^|[^a-z]){s.lower()}([^a-z]|$)") for s in B.TEST_SKILLS]
    return f"""
trx AS (SELECT * FROM {values(rx, ['skill', 'kw', 'rx'])}),
tr AS (SELECT d.doc_id AS cv_id, trx.skill FROM documents d JOIN trx ON regexp_matches(lower(d.text), trx.rx)),
truth AS (SELECT doc_id AS cv_id, lang AS true_domain FROM documents),
pt AS (SELECT c.cv_id, t.true_domain, c.domain AS pred_domain FROM cv c JOIN truth t USING (cv_id))"""


ORACLE["accuracy"] = cv_offer_ctes() + "," + _truth_ctes() + """
SELECT round(coalesce(avg(CASE WHEN true_domain = pred_domain THEN 1.0 ELSE 0.0 END)::DOUBLE, 0.0), 6) AS accuracy,
       count(*)::BIGINT AS samples
FROM pt WHERE true_domain <> '' AND pred_domain <> ''
"""

ORACLE["confusion"] = cv_offer_ctes() + "," + _truth_ctes() + f""",
lab AS (SELECT * FROM {values([(x,) for x in B.LANGS], ['l'])}),
c AS (SELECT true_domain, pred_domain, count(*) AS n FROM pt GROUP BY 1, 2)
SELECT a.l AS true_label, b.l AS pred_label, coalesce(c.n, 0)::BIGINT AS n
FROM lab a CROSS JOIN lab b LEFT JOIN c ON c.true_domain = a.l AND c.pred_domain = b.l
"""

_PRF_ROWS = """,
ts AS (SELECT cv_id, lower(skill) AS s FROM tr GROUP BY 1, 2),
ps AS (SELECT cv_id, lower(skill) AS s FROM cvsk GROUP BY 1, 2),
nt AS (SELECT cv_id, count(*) AS nt FROM ts GROUP BY 1),
np AS (SELECT cv_id, count(*) AS np FROM ps GROUP BY 1),
ni AS (SELECT ts.cv_id, count(*) AS ni FROM ts JOIN ps ON ps.cv_id = ts.cv_id AND ps.s = ts.s GROUP BY 1),
pr AS (SELECT nt.cv_id, coalesce(ni.ni, 0) / np.np AS p, coalesce(ni.ni, 0) / nt.nt AS r
       FROM nt JOIN np USING (cv_id) LEFT JOIN ni USING (cv_id)),
prf AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * (p * r) / (p + r) ELSE 0.0 END AS f FROM pr),
m AS (SELECT coalesce(avg(p), 0.0) AS precision, coalesce(avg(r), 0.0) AS recall, coalesce(avg(f), 0.0) AS f1,
             count(*) AS samples FROM prf)"""

ORACLE["skills_prf"] = cv_offer_ctes() + "," + _truth_ctes() + _PRF_ROWS + """
SELECT round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END, 6)
         AS f1_of_means, samples::BIGINT AS samples FROM m
"""

ORACLE["weighted_prf"] = cv_offer_ctes() + "," + _truth_ctes() + """,
c AS (SELECT true_domain AS t, pred_domain AS p, count(*) AS n FROM pt GROUP BY 1, 2),
labs AS (SELECT t AS label FROM c UNION SELECT p FROM c),
per AS (SELECT l.label,
               coalesce((SELECT sum(n) FROM c WHERE c.t = l.label), 0) AS support,
               coalesce((SELECT sum(n) FROM c WHERE c.p = l.label), 0) AS predicted,
               coalesce((SELECT sum(n) FROM c WHERE c.t = l.label AND c.p = l.label), 0) AS tp FROM labs l),
per2 AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS prec,
                   CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS rec FROM per),
per3 AS (SELECT *, CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0.0 END AS f1 FROM per2)
SELECT round(sum(tp) / sum(support), 6) AS accuracy, round(sum(prec * support) / sum(support), 6) AS precision,
       round(sum(rec * support) / sum(support), 6) AS recall, round(sum(f1 * support) / sum(support), 6) AS f1,
       sum(support)::BIGINT AS samples FROM per3
"""

ORACLE["matching_quality"] = f"""
WITH res AS (SELECT cv_id, offer_id FROM {_sub('match_rules_topk')}),
x AS (SELECT 1)""" + "," + cv_offer_ctes().replace("WITH", "", 1) + "," + _truth_ctes() + """,
tsk AS (SELECT cv_id, lower(skill) AS s FROM tr GROUP BY 1, 2),
ntk AS (SELECT cv_id, count(*) AS n FROM tsk GROUP BY 1),
rows_ AS (SELECT r.cv_id, r.offer_id, o.domain AS offer_domain, o.text AS offer_text, t.true_domain, n.n
          FROM res r JOIN off o USING (offer_id) JOIN truth t USING (cv_id) JOIN ntk n USING (cv_id)
          WHERE t.true_domain <> ''),
share AS (SELECT r.cv_id, r.offer_id, (SELECT count(*) FROM tsk WHERE tsk.cv_id = r.cv_id AND contains(r.offer_text, tsk.s)) / r.n AS sh,
                 CASE WHEN r.offer_domain = r.true_domain THEN 1.0 ELSE 0.0 END AS dm FROM rows_ r)
SELECT round(coalesce(avg(dm)::DOUBLE, 0.0), 6) AS domain_match_rate, round(coalesce(avg(sh), 0.0), 6) AS skills_match_rate,
       count(*)::BIGINT AS samples FROM share
"""

ORACLE["retrieval_prf"] = f"""
WITH m AS (SELECT DISTINCT cv_id, offer_id FROM {_sub('match_rules_topk')}),
r AS (SELECT DISTINCT cv_id, offer_id FROM {_sub('match_weighted_topk')}),
nm AS (SELECT cv_id, count(*) AS n_m FROM m GROUP BY 1),
nr AS (SELECT cv_id, count(*) AS n_r FROM r GROUP BY 1),
h AS (SELECT m.cv_id, count(*) AS n_h FROM m JOIN r USING (cv_id, offer_id) GROUP BY 1),
x AS (SELECT coalesce(nm.cv_id, nr.cv_id) AS cv_id, coalesce(n_m, 0) AS n_m, coalesce(n_r, 0) AS n_r
      FROM nm FULL JOIN nr USING (cv_id)),
y AS (SELECT x.cv_id, CASE WHEN n_m > 0 THEN coalesce(n_h, 0) / n_m ELSE 0.0 END AS p,
             CASE WHEN n_r > 0 THEN coalesce(n_h, 0) / n_r ELSE 0.0 END AS rc FROM x LEFT JOIN h USING (cv_id))
SELECT cv_id, round(p, 6) AS precision, round(rc, 6) AS recall,
       round(CASE WHEN p + rc > 0 THEN 2 * p * rc / (p + rc) ELSE 0.0 END, 6) AS f1 FROM y
"""

ORACLE["expected_vs_detected"] = cv_offer_ctes() + "," + _truth_ctes() + _PRF_ROWS + """,
e AS (SELECT t.cv_id, (SELECT count(DISTINCT lower(skill)) FROM tr WHERE tr.cv_id = t.cv_id) AS expected FROM truth t)
SELECT e.cv_id, expected::BIGINT AS expected, floor(expected * m.recall)::BIGINT AS detected FROM e CROSS JOIN m
"""


# ------------------------------------------------------------------ feedback
_FB = """fe AS (SELECT event_id, user_id, ts, event_type AS cv_domain, least(1.0::DOUBLE, value / 100.0::DOUBLE) AS system_score,
              CAST(json_extract_string(props, '$.k') AS BIGINT) % 7 AS user_rating, user_id % 6 AS overall_rating,
              CASE WHEN event_type <> 'error' THEN 'offer_' || event_id::VARCHAR END AS job_id FROM events),
vr AS (SELECT event_id, cv_domain, system_score, user_rating, coalesce(job_id, 'job_' || event_id::VARCHAR) AS job_id
       FROM fe WHERE user_rating BETWEEN 1 AND 5)"""

ORACLE["valid_ratings"] = f"""WITH {_FB}
SELECT event_id, job_id, user_rating::BIGINT AS user_rating FROM vr
"""

ORACLE["feedback_stats"] = f"""WITH {_FB},
se AS (SELECT user_id, cv_domain, any_value(overall_rating) AS overall_rating FROM fe GROUP BY 1, 2),
s AS (SELECT cv_domain, GROUPING(cv_domain) AS g, count(*) AS sessions,
             avg(CASE WHEN overall_rating > 0 THEN overall_rating END) AS avg_overall
      FROM se GROUP BY GROUPING SETS ((cv_domain), ())),
r AS (SELECT cv_domain, GROUPING(cv_domain) AS g, avg(abs(1.0::DOUBLE + system_score * 4.0::DOUBLE - user_rating)) AS d,
             count(*) AS n FROM vr WHERE user_rating > 0 GROUP BY GROUPING SETS ((cv_domain), ()))
SELECT CASE WHEN s.g = 1 THEN '__all__' ELSE s.cv_domain END AS domain, s.sessions::BIGINT AS sessions,
       round(s.avg_overall, 6) AS avg_overall, coalesce(r.n, 0)::BIGINT AS n_ratings,
       round(greatest(0.0::DOUBLE, 1.0::DOUBLE - r.d / 4.0::DOUBLE) * 100.0::DOUBLE, 6) AS agreement_pct
FROM s LEFT JOIN r ON r.g = s.g AND r.cv_domain IS NOT DISTINCT FROM s.cv_domain
"""

ORACLE["feedback_sessions"] = """
SELECT user_id, event_type AS cv_domain, md5(event_type || '||' || CAST(min(ts) AS VARCHAR)) AS session_id,
       count(*)::BIGINT AS n_ratings FROM events GROUP BY user_id, event_type
"""

ORACLE["feedback_upsert"] = """
WITH u AS (SELECT user_id, event_id, event_type, ts, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS src FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, src DESC) AS rn FROM u)
SELECT user_id, event_id, event_type FROM r WHERE rn = 1
"""


# ------------------------------------------------------------------ training data
def _examples_cte() -> str:
    cm = values(list(B.TEST_CATEGORY_MAP.items()), ["k", "v"])
    return f"""
{skills_cte('tsk', 'documents', 'doc_id', 'lower(s.text)', B.TEST_SKILLS, None)},
tsk3 AS (SELECT id, string_agg(skill, ', ' ORDER BY skill_ord) AS skills FROM tsk GROUP BY id),
cm AS (SELECT * FROM {cm}),
rows_ AS (SELECT d.doc_id AS ord, d.text, d.lang AS category,
                 CASE WHEN n_chars > 2000 THEN 'resume_' ELSE 'jobs_' END || d.source || '.csv' AS source, t.skills
          FROM documents d LEFT JOIN tsk3 t ON t.id = d.doc_id),
r2 AS (SELECT r.*, coalesce(cm.v, 'autre') AS domain, coalesce(r.skills, 'Non spécifié') AS sk,
              contains(lower(source), 'resume') OR contains(lower(source), 'cv') AS is_cv
       FROM rows_ r LEFT JOIN cm ON cm.k = regexp_replace(r.category, '^\\s+|\\s+$', '', 'g')
       WHERE r.text IS NOT NULL AND length(regexp_replace(r.text, '^\\s+|\\s+$', '', 'g')) > 10),
ex AS (SELECT ord, text AS input, domain,
              CASE WHEN is_cv THEN 'Analyse ce CV pour un poste dans le domaine ' || replace(domain, '_', ' ') || '.'
                   ELSE 'Analyse cette offre d''emploi dans le domaine ' || replace(domain, '_', ' ') || '.' END AS instruction,
              CASE WHEN is_cv THEN 'Compétences identifiées : ' || sk || '. Ce profil est adapté pour des postes en '
                                   || replace(domain, '_', ' ') || '.'
                   ELSE 'Compétences requises : ' || sk || '. Cette offre est classée dans le domaine '
                        || replace(domain, '_', ' ') || '.' END AS output
       FROM r2)"""


ORACLE["training_examples"] = "WITH " + _examples_cte() + f""",
li AS (SELECT * FROM {values([(d, i) for i, d in enumerate(B.TEST_TRAIN_DOMAINS)], ['d', 'i'])})
SELECT ord AS doc_id, instruction, output, domain, coalesce(li.i, 0)::BIGINT AS label FROM ex LEFT JOIN li ON li.d = ex.domain
"""


def _expand_sql(prefixed: bool) -> str:
    from talentgrid import vocab as VV
    dl = ", ".join(q(d) for d in B.TEST_TRAIN_DOMAINS)
    flt = "" if prefixed else f"WHERE domain IN ({dl})"
    cvt = "[" + ", ".join(q(t) for t in VV.CV_TEMPLATES) + "]"
    jbt = "[" + ", ".join(q(t) for t in VV.JOB_TEMPLATES) + "]"
    is_cv = " OR ".join(f"contains(lower(instruction), {q(t)})" for t in VV.CV_INSTRUCTION_TERMS)
    if prefixed:
        instr = "'Pour le domaine ' || replace(domain, '_', ' ') || ': ' || instruction"
    else:
        instr = (f"replace((CASE WHEN {is_cv} THEN {cvt} ELSE {jbt} END)[(i % 5) + 1], '{{domain}}', "
                 "replace(domain, '_', ' '))")
    return "WITH " + _examples_cte() + f""",
x AS (SELECT * FROM ex {flt}),
c AS (SELECT domain, count(*) AS c FROM x GROUP BY domain),
b AS (SELECT x.*, c.c, row_number() OVER (PARTITION BY x.domain ORDER BY ord) - 1 AS j
      FROM x JOIN c USING (domain) WHERE c.c < {B.QUOTA}),
v AS (SELECT b.*, unnest(range(j, {B.QUOTA} - c, c)) AS i FROM b WHERE j < {B.QUOTA} - c)
SELECT ord AS doc_id, -1::BIGINT AS variant, domain, instruction FROM x
UNION ALL
SELECT ord AS doc_id, i::BIGINT AS variant, domain, {instr} AS instruction FROM v
"""


ORACLE["expand_examples"] = _expand_sql(False)
ORACLE["expand_examples_prefixed"] = _expand_sql(True)

ORACLE["render_prompts"] = "WITH " + _examples_cte() + """
SELECT ord AS doc_id,
       md5(CASE WHEN instruction <> '' AND input <> '' AND output <> ''
                THEN '<s>[INST] ' || instruction || chr(10) || input || ' [/INST] ' || output || ' </s>'
                ELSE '<s>[INST]  [/INST]  </s>' END) AS prompt_md5,
       length(CASE WHEN instruction <> '' AND input <> '' AND output <> ''
                THEN '<s>[INST] ' || instruction || chr(10) || input || ' [/INST] ' || output || ' </s>'
                ELSE '<s>[INST]  [/INST]  </s>' END)::BIGINT AS prompt_len
FROM ex
"""

ORACLE["stratified_split"] = "WITH " + _examples_cte() + """,
h AS (SELECT ord, domain, md5(ord::VARCHAR || '|42') AS hh FROM ex),
n AS (SELECT domain, count(*) AS n FROM h GROUP BY domain),
r AS (SELECT h.*, row_number() OVER (PARTITION BY h.domain ORDER BY hh) AS rk, n.n FROM h JOIN n USING (domain))
SELECT ord AS doc_id, domain, CASE WHEN rk <= floor(0.2 * n + 0.5) THEN 'eval' ELSE 'train' END AS split FROM r
"""


ORACLE["stored_upserts"] = f"""
WITH e AS (SELECT user_id::VARCHAR AS user_id, event_id, event_type, ts,
  ('0x' || substr(md5(user_id::VARCHAR), 1, 7))::INT % {B.STORED_BUCKETS} AS b FROM events WHERE user_id IS NOT NULL),
t AS (SELECT DISTINCT b FROM e WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 30 MINUTE),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM e)
SELECT user_id, event_id, event_type, b IN (SELECT b FROM t) AS rewritten FROM r WHERE rn = 1
"""

ORACLE["training_sources"] = r"""
SELECT CASE WHEN lang = 'en' THEN 'resumes' ELSE 'offers' END AS kind,
       md5(regexp_replace(text, '\r\n?', chr(10), 'g')) AS text_md5, lang AS category,
       CASE WHEN lang = 'en' THEN NULL ELSE source END AS skills
FROM documents WHERE text IS NOT NULL AND text <> ''
UNION ALL SELECT 'pages', md5(html), url, 'a, ' || page_id::VARCHAR FROM pages
"""


# ------------------------------------------------------------------ intents / html / scalar text
def _intent_sql() -> str:
    parts = []
    for name, kws in B.TEST_INTENTS:
        cond = " OR ".join(f"contains(lower(text), {q(k.lower())})" for k in kws)
        parts.append((name, cond))
    flags = ", ".join(f"max(CASE WHEN {c} THEN 1 ELSE 0 END) AS f{i}" for i, (_, c) in enumerate(parts))
    case = " ".join(f"WHEN f{i} = 1 THEN {q(n)}" for i, (n, _) in enumerate(parts))
    return f"""
WITH u AS (SELECT conv_id, {flags} FROM conversations WHERE role = 'user' GROUP BY conv_id),
c AS (SELECT DISTINCT conv_id FROM conversations)
SELECT c.conv_id, CASE {case} ELSE 'general' END AS intent FROM c LEFT JOIN u USING (conv_id)
"""


ORACLE["message_intent"] = _intent_sql()


def _intent_joined_sql() -> str:
    case = " ".join(f"WHEN {' OR '.join(f'contains(t, {q(k.lower())})' for k in kws)} THEN {q(n)}"
                    for n, kws in B.TEST_SPACED_INTENTS)
    return f"""
WITH c AS (SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN lower(coalesce(text, '')) || ' ' END, ''
  ORDER BY turn, lower(coalesce(text, ''))) AS t FROM conversations GROUP BY conv_id)
SELECT conv_id, CASE {case} ELSE 'general' END AS intent FROM c
"""


ORACLE["message_intent_spaced"] = _intent_joined_sql()

ORACLE["html_to_text"] = f"""
SELECT page_id, length({html_text_sql('html')})::BIGINT AS text_len, md5({html_text_sql('html')}) AS text_md5 FROM pages
"""


def _decoded(x: str) -> str:
    """With the references that the driver's pages hold; ``&amp;`` last, so nothing is decoded twice."""
    for ent, ch in [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"),
                    ("&middot;", "·"), ("&amp;", "&")]:
        x = f"replace({x}, {q(ent)}, {q(ch)})"
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def _page_text_sql(col: str) -> str:
    blocks = "'(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->'"
    return _decoded(f"regexp_replace(regexp_replace({col}, {blocks}, ' ', 'g'), '<[^>]*>', ' ', 'g')")


ORACLE["html_page_text"] = f"""
SELECT page_id, md5({_page_text_sql('html')}) AS text_md5, {_decoded("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")} AS title,
  {_decoded("array_to_string(regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<a href=[^>]*>([^<]*)</a>', 1), ' ')")} AS menu
FROM pages
"""


def _salary_sql(col: str) -> str:
    from talentgrid import vocab as VV
    from talentgrid.functions.text import portable_regex, WS
    outs = []
    for p in VV.SALARY_PATTERNS:
        rx = "(?i)" + portable_regex(p)
        ex = f"regexp_replace(regexp_extract({col}, {q(rx)}, 1), {q('^' + WS + '+|' + WS + '+$')}, '', 'g')"
        outs.append(f"CASE WHEN regexp_matches({col}, {q(rx)}) THEN {ex} END")
    return "coalesce(" + ", ".join(outs) + ")"


ORACLE["salary"] = f"SELECT doc_id, {_salary_sql('text')} AS salary FROM documents"


def _location_sql(loc: str, cc: str) -> str:
    from talentgrid import vocab as VV
    from talentgrid.functions.text import WS
    cleaned = f"translate(regexp_replace({loc}, {q('^' + WS + '+|' + WS + '+$')}, '', 'g'), '– ', '- ')"
    if cc not in VV.CITIES_BY_COUNTRY:
        return cleaned
    whens = " ".join(f"WHEN contains(lower({cleaned}), {q(c.lower())}) THEN {q(c)}" for c in VV.CITIES_BY_COUNTRY[cc])
    return f"CASE {whens} ELSE {q(VV.COUNTRY_NAMES[cc])} END"


ORACLE["location"] = f"""
WITH x AS (SELECT c_custkey, '  ' || n_name || ' ' || chr(8211) || ' ' || c_name || chr(160) || 'Paris' || chr(160) AS loc
           FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT c_custkey, {_location_sql('loc', 'fr')} AS loc_fr, {_location_sql('loc', 'ma')} AS loc_ma,
       {_location_sql('loc', 'us')} AS loc_other FROM x
"""

_SQ_MAP = values([("en", "engineer OR developer"), ("fr", "ingénieur OR développeur"),
                  ("de", "Ingenieur OR Entwickler")], ["d", "tq"])


def _search_query_sql() -> str:
    return cv_offer_ctes() + f""",
tq AS (SELECT * FROM {_SQ_MAP}),
s3 AS (SELECT cv_id, string_agg('"' || skill || '"', ' ' ORDER BY pos) AS sp FROM cvsk WHERE pos < 3 GROUP BY cv_id),
qq AS (SELECT c.cv_id, concat_ws(' ', CASE WHEN tq.tq IS NOT NULL AND tq.tq <> '' THEN '(' || tq.tq || ')' END, s3.sp) AS q0
       FROM cv c LEFT JOIN tq ON tq.d = c.domain LEFT JOIN s3 ON s3.cv_id = c.cv_id),
qs AS (SELECT cv_id, CASE WHEN q0 = '' THEN 'developer OR engineer' ELSE q0 END AS query FROM qq)"""


ORACLE["search_query"] = _search_query_sql() + "\nSELECT cv_id, query FROM qs\n"

ORACLE["search_url"] = _search_query_sql() + """
SELECT cv_id, 'https://jobs.example.org/search?q=' || replace(url_encode(query), '%2F', '/') || '&l='
              || replace(url_encode('Paris / Lyon'), '%2F', '/') || '&cc=fr' AS url FROM qs
"""

ORACLE["truncate"] = """
SELECT doc_id, md5(CASE WHEN length(text) > 200 THEN substring(text, 1, 200) || '...' ELSE text END) AS t200_md5,
       length(CASE WHEN length(text) > 2000 THEN substring(text, 1, 1997) || '...' ELSE text END)::BIGINT AS t2000_len
FROM documents
"""


# ------------------------------------------------------------------ filters / limits / counters
ORACLE["offer_filters"] = """
SELECT doc_id FROM documents WHERE lang = 'fr' AND source = 'src3'
  AND (contains(lower(split_part(text, chr(10), 1)), 'pour') OR contains(lower(text), 'pour'))
"""

ORACLE["search_backfill"] = """
SELECT p_partkey, hit FROM (
  SELECT p_partkey, contains(lower(coalesce(p_name, '')), 'green') OR contains(lower(coalesce(p_type, '')), 'green') AS hit
  FROM part) ORDER BY hit DESC, p_partkey LIMIT 100
"""

ORACLE["limit_then_sort"] = """
WITH c AS (SELECT * FROM orders ORDER BY o_orderkey LIMIT 500)
SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey)::BIGINT AS pos FROM c
"""

ORACLE["overfetch"] = """
WITH c AS (SELECT * FROM orders ORDER BY o_orderkey LIMIT 100)
SELECT o_orderkey, o_totalprice FROM c WHERE o_totalprice >= 100000.0 ORDER BY o_totalprice DESC, o_orderkey LIMIT 50
"""

ORACLE["split_by_source"] = """
SELECT CASE WHEN coalesce(source, '') = 'src0' THEN 'src0' ELSE 'other' END AS side, count(*)::BIGINT AS n
FROM documents GROUP BY 1
"""

ORACLE["ingest_counters"] = """
WITH x AS (SELECT regexp_matches(html, '(?is)<title>.+?</title>') AS ok FROM pages)
SELECT sum(CASE WHEN ok THEN 1 ELSE 0 END)::BIGINT AS success_count, sum(CASE WHEN ok THEN 0 ELSE 1 END)::BIGINT AS failed_count,
       count(*)::BIGINT AS total_count,
       round(coalesce(sum(CASE WHEN ok THEN 1 ELSE 0 END) * 100.0::DOUBLE / count(*), 0.0), 6) AS success_rate FROM x
"""

ORACLE["domain_counts"] = "SELECT lang AS domain, count(*)::BIGINT AS n FROM documents GROUP BY lang"

ORACLE["score_bands"] = f"""
SELECT CASE WHEN score >= 0.7 THEN 'high' WHEN score >= 0.5 THEN 'medium' WHEN score < 0.3 THEN 'low' ELSE 'neutral' END
       AS band, count(*)::BIGINT AS n FROM {_sub('match_rules_topk')} GROUP BY 1
"""


def _terms_sql(src: str, id_col: str, text_expr: str, n: int, name: str) -> str:
    stop = ", ".join(q(w) for w in B.KEY_STOP)
    return f"""
{name}_tok AS (SELECT {id_col} AS id, unnest(regexp_split_to_array(lower({text_expr}), '[^\\p{{L}}]+')) AS term FROM {src}),
{name}_tf AS (SELECT id, term, count(*) AS tf FROM {name}_tok WHERE length(term) >= 3 AND term NOT IN ({stop}) GROUP BY 1, 2),
{name}_df AS (SELECT term, count(*) AS df FROM {name}_tf GROUP BY term),
{name}_n AS (SELECT count(*) AS n FROM {src}),
{name}_s AS (SELECT t.id, t.term, t.tf, t.tf * ln(n.n / d.df) AS tfidf FROM {name}_tf t JOIN {name}_df d USING (term)
             CROSS JOIN {name}_n n),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY tfidf DESC, term) AS term_rank
                          FROM {name}_s) WHERE term_rank <= {n})"""


ORACLE["key_terms"] = "WITH " + _terms_sql("documents", "doc_id", "text", 5, "kt") + """
SELECT id AS doc_id, term, tf::BIGINT AS tf, round(tfidf, 6) AS tfidf, term_rank::BIGINT AS term_rank FROM kt
"""

ORACLE["keyword_overlap"] = f"""
WITH pairs AS (SELECT DISTINCT cv_id, offer_id FROM {_sub('match_rules_topk')}),
pg AS (SELECT page_id AS offer_id, {html_text_sql('html')} AS description FROM pages),
""" + _terms_sql("documents", "doc_id", "text", 10, "ct").lstrip() + "," + _terms_sql("pg", "offer_id", "description", 10, "jt") + """,
nj AS (SELECT id, count(*) AS n_job FROM jt GROUP BY id),
inter AS (SELECT p.cv_id, p.offer_id, count(*) AS n_common FROM pairs p JOIN ct ON ct.id = p.cv_id
          JOIN jt ON jt.id = p.offer_id AND jt.term = ct.term GROUP BY 1, 2)
SELECT p.cv_id, p.offer_id, coalesce(i.n_common, 0)::BIGINT AS n_common,
       CASE WHEN nj.n_job > 0 THEN floor((coalesce(i.n_common, 0) / nj.n_job) * 100)::BIGINT END AS overlap_pct
FROM pairs p LEFT JOIN nj ON nj.id = p.offer_id LEFT JOIN inter i ON i.cv_id = p.cv_id AND i.offer_id = p.offer_id
"""


# ------------------------------------------------------------------ streaming (batch equivalents)
ORACLE["stream_dedup"] = "SELECT DISTINCT user_id, event_type FROM events"

ORACLE["stream_window_counts"] = """
SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*)::BIGINT AS n
FROM events GROUP BY 1, 2
"""

ORACLE["stream_feedback"] = """
SELECT user_id, event_id, event_type FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS rn FROM events) WHERE rn = 1
"""

ORACLE["stream_feedback_stats"] = f"""WITH {_FB},
last AS (SELECT *, event_id % 6 AS overall FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM fe) WHERE rn = 1),
x AS (SELECT cv_domain, GROUPING(cv_domain) AS g, count(*) AS sessions, avg(CASE WHEN overall > 0 THEN overall END) AS o,
             count(*) FILTER (user_rating > 0) AS n, avg(abs(1.0::DOUBLE + system_score * 4.0::DOUBLE - user_rating)) FILTER (user_rating > 0) AS d
      FROM last GROUP BY GROUPING SETS ((cv_domain), ()))
SELECT CASE WHEN g = 1 THEN '__all__' ELSE cv_domain END AS domain, sessions::BIGINT AS sessions, round(o, 6) AS avg_overall, n::BIGINT AS n_ratings,
       round(greatest(0.0::DOUBLE, 1.0::DOUBLE - d / 4.0::DOUBLE) * 100.0::DOUBLE, 6) AS agreement_pct FROM x
"""

ORACLE["retention"] = """
SELECT CASE WHEN ts >= TIMESTAMP '2024-02-01 00:00:00' - INTERVAL 7 DAY THEN 'keep'
            WHEN ts >= TIMESTAMP '2024-02-01 00:00:00' - INTERVAL 30 DAY THEN 'archive' ELSE 'expire' END AS action,
       count(*)::BIGINT AS n FROM events GROUP BY 1
"""


# ------------------------------------------------------------------ per-CV summaries
ORACLE["best_match_per_cv"] = f"""
WITH m AS (SELECT cv_id, offer_id, score FROM {_sub('match_rules_topk')} WHERE rank = 1)""" + "," + \
    cv_offer_ctes().replace("WITH", "", 1) + """
SELECT c.cv_id, c.domain AS cv_domain, m.offer_id, coalesce(m.score, 0.0) AS score,
       coalesce(o.domain = c.domain, FALSE) AS domain_match
FROM cv c LEFT JOIN m ON m.cv_id = c.cv_id LEFT JOIN off o ON o.offer_id = m.offer_id
"""

ORACLE["domain_offers_topk"] = cv_offer_ctes() + """,
r AS (SELECT offer_id, domain, raw_score, row_number() OVER (PARTITION BY domain ORDER BY raw_score DESC, offer_id) AS rank
      FROM off)
SELECT c.cv_id, r.rank::BIGINT AS rank, r.offer_id, round(r.raw_score, 6) AS score
FROM cv c JOIN r ON r.domain = c.domain WHERE r.rank <= 5
"""

ORACLE["domain_map"] = _fallback_scores_sql(B.LANG_VOCAB) + """,
r AS (SELECT doc_id, domain, domain_ord, round(score, 6) AS score FROM s)
SELECT doc_id, string_agg(domain || ':' || printf('%.6f', score), ',' ORDER BY domain_ord) AS scores,
       arg_min(domain, (-score, domain_ord)) AS top_domain
FROM r GROUP BY doc_id
"""


ORACLE["offer_format"] = f"""
WITH pg AS (SELECT page_id AS offer_id, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title,
                   regexp_extract(url, '://([^/]+)', 1) AS company,
                   regexp_extract(url, '/(en|fr|de|es)/', 1) AS location,
                   {html_text_sql('html')} AS description FROM pages),
c AS (SELECT *, coalesce(title, '') || ' - ' || coalesce(company, '') || chr(10) || chr(10) || coalesce(description, '')
                AS content FROM pg)
SELECT offer_id, 'informatique_reseaux' AS domain, 'France' AS country, 'indeed' AS source, md5(content) AS content_md5,
       length(CASE WHEN length(content) > 200 THEN substring(content, 1, 200) || '...' ELSE content END)::BIGINT
         AS description_len,
       CASE WHEN contains(coalesce(location, ''), 'fr') THEN location ELSE 'fr, France' END AS relocated,
       'Informatique & Réseaux' AS domain_label
FROM c
"""


ORACLE["category_map"] = f"""
WITH cm AS (SELECT * FROM {values(list(B.TEST_CATEGORY_MAP.items()), ['k', 'v'])}),
li AS (SELECT * FROM {values([(d, i) for i, d in enumerate(['anglais', 'francais', 'allemand', 'other'])], ['d', 'i'])}),
x AS (SELECT d.doc_id, d.lang AS category,
             CASE WHEN coalesce(cm.v, 'autre') = 'autre' THEN 'other' ELSE coalesce(cm.v, 'autre') END AS domain
      FROM documents d LEFT JOIN cm ON cm.k = regexp_replace(d.lang, '^\\s+|\\s+$', '', 'g'))
SELECT x.doc_id, x.category, x.domain, coalesce(li.i, 0)::BIGINT AS label FROM x LEFT JOIN li ON li.d = x.domain
"""
