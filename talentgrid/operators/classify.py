"""Keyword classifiers: per-document domain scores and the winning domain.

All of them look the lower-cased text up once in an automaton of the whole vocabulary
(:mod:`talentgrid.operators.patterns`) and add up per domain what it found, row by row: nothing is
joined or shuffled, the work does not grow with the number of keywords, and rows that share an id
stay apart. Scores come out as fixed columns because the domain list is known at plan time; a
domain without a hit has its base score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentgrid import vocab as V
from talentgrid.operators.patterns import find_terms, sum_terms


def _spark(df: DataFrame):
    return df.sparkSession


def keyword_hits(docs: DataFrame, vocab, id_col: str = "doc_id", text_col: str = "text",
                 how: str = "left", carry: list[str] | None = None, lowered: bool = False) -> DataFrame:
    """(id, domain, domain_ord, keyword, kw_ord, occ) for every vocabulary keyword the
    text contains (case-insensitive substring). ``how="left"`` keeps documents with no
    hit as one row with null keyword columns. ``lowered``: the text is already lower-case.
    A vocabulary table may have any size: its keywords are looked up in bounded automata, and
    the hits found are joined with its rows."""
    from talentgrid.session import materialize
    vdf = vocab if isinstance(vocab, DataFrame) else V.vocab_frame(_spark(docs), vocab)
    terms = materialize(vdf.select(F.col("kw").alias("term")).distinct().withColumn("no", F.monotonically_increasing_id()))
    text = F.col(text_col) if lowered else F.lower(F.col(text_col))
    carry = carry or []
    found = find_terms(docs.select(F.col(id_col), text.alias("_t"), *carry), "_t", terms, "_h").drop("_t")
    hits = found.select(id_col, *carry, (F.inline_outer if how == "left" else F.inline)("_h"))
    words = vdf.join(terms, F.col("kw") == F.col("term")).select("no", "domain", "domain_ord", "keyword", "kw_ord", "weight")
    return hits.join(words, "no", "left").select(id_col, "domain", "domain_ord", "keyword", "kw_ord", F.col("n").alias("occ"), "weight", *carry)


def _sums(docs: DataFrame, entries: list, n: int, value, id_col: str, text: Column, prefix: str,
          carry: list[str] | None = None) -> DataFrame:
    """(id, ``prefix``0.., carry): per row the sums of ``value(times, weight)`` over the entries
    (keyword, domain ordinal, weight) in the text."""
    rows = docs.select(F.col(id_col), text.alias("_t"), *(carry or []))
    out = sum_terms(rows, "_t", [(k.lower(), d, w) for k, d, w in entries], n, value, "_sums")
    return out.select(id_col, *[F.get("_sums", F.lit(i)).alias(f"{prefix}{i}") for i in range(n)], *(carry or []))


def _entries(vocab: dict) -> list:
    return [(k, i, None) for i, kws in enumerate(vocab.values()) for k in kws]


def _present(times, weight):
    return 1


def _times(times, weight):
    return times


def _weight(times, weight):
    return weight


def _domains(vocab) -> list[str]:
    return list(vocab.keys())


def argmax_domain(scores: list[Column], domains: list[str]) -> tuple[Column, Column]:
    """(domain, score) of the highest score; ties go to the first domain in order."""
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    pick = F.coalesce(*[F.when(s == best, F.lit(d)) for s, d in zip(scores, domains)])
    return pick, best


def long_scores(wide: DataFrame, id_col: str, domains: list[str], score_cols: list[str],
                score_name: str = "score") -> DataFrame:
    """Wide per-domain columns → rows ``(id, domain, domain_ord, score)`` (narrow explode)."""
    arr = F.array(*[F.struct(F.lit(d).alias("domain"), F.lit(i).alias("domain_ord"),
                             F.col(c).alias(score_name))
                    for i, (d, c) in enumerate(zip(domains, score_cols))])
    return wide.select(id_col, F.inline(arr))


# --------------------------------------------------------------------------- D1
def fallback_units(times, weight) -> int:
    """Keyword contribution in units of 0.025: 1 for a single occurrence, else
    2·min(times, 3). Integer units keep the sums exact in every engine."""
    return 1 if times == 1 else 2 * min(times, 3)


def domain_scores_fallback(docs: DataFrame, vocab=None, id_col: str = "doc_id",
                           text_col: str = "text", carry: list[str] | None = None,
                           lowered: bool = False) -> DataFrame:
    """Fallback CV analysis: per domain 0.5 + Σ over present keywords (0.025 for one
    occurrence, else 0.05·min(occ, 3)), capped at 1.0. Returns one row per document
    with ``score_<i>`` columns, ``main_domain`` and ``main_score``."""
    vocab = V.FALLBACK_KEYWORDS if vocab is None else vocab
    domains = _domains(vocab)
    carry = carry or []
    text = F.col(text_col) if lowered else F.lower(F.col(text_col))
    wide = _sums(docs, _entries(vocab), len(domains), fallback_units, id_col, text, "_u", carry)
    scores = [F.least(F.lit(1.0), F.lit(0.5) + F.col(f"_u{i}") * F.lit(0.025)) for i in range(len(domains))]
    main, best = argmax_domain(scores, domains)
    return wide.select(id_col, *[s.alias(f"score_{i}") for i, s in enumerate(scores)],
                       main.alias("main_domain"), best.alias("main_score"), *carry)


def analyze_documents(docs: DataFrame, vocab=None, skills: list[str] | None = None,
                      id_col: str = "doc_id", text_col: str = "text", skill_limit: int = 10,
                      carry: list[str] | None = None) -> DataFrame:
    """Fallback analysis in one pass: domain scores, main domain and the first
    ``skill_limit`` vocabulary skills."""
    from talentgrid.operators.skills import extract_skills
    skills = V.TECHNICAL_SKILLS if skills is None else skills
    # lower-case the (possibly long) text once for both vocabulary passes
    d = docs.select(id_col, F.lower(F.col(text_col)).alias("_low"), *(carry or []))
    d = extract_skills(d, skills, "_low", skill_limit, lowered=True)
    return domain_scores_fallback(d, vocab, id_col, "_low", carry=["skills"] + (carry or []), lowered=True)


def domain_scores_fallback_long(docs: DataFrame, vocab=None, id_col: str = "doc_id",
                                text_col: str = "text") -> DataFrame:
    vocab = V.FALLBACK_KEYWORDS if vocab is None else vocab
    domains = _domains(vocab)
    wide = domain_scores_fallback(docs, vocab, id_col, text_col)
    return long_scores(wide, id_col, domains, [f"score_{i}" for i in range(len(domains))])


# --------------------------------------------------------------------------- D2
def _basic_terms(vocab: dict, skills: list[str]) -> dict:
    """Term table of the basic analyser: each domain keyword weighs 1; each skill weighs
    0.5 for every domain one of whose keywords it contains (both vocabularies are
    literals, so this cross-vocabulary test runs at plan time)."""
    terms = {}
    for d, kws in vocab.items():
        rows = [(k, 1.0) for k in kws]
        for s in skills:
            if any(k.lower() in s.lower() for k in kws):
                rows.append((s, 0.5))
        terms[d] = rows
    return terms


def weighted_term_scores(docs: DataFrame, terms: dict, id_col: str = "doc_id",
                         text_col: str = "text", extra_text: list[str] | None = None) -> DataFrame:
    """Σ weight of the terms each document contains, one ``score_<i>`` column per domain.
    ``terms`` maps domain → [(term, weight), ...]."""
    entries = [(t, i, float(w)) for i, ts in enumerate(terms.values()) for t, w in ts]
    text = F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in [text_col] + (extra_text or [])])
    return _sums(docs, entries, len(terms), _weight, id_col, F.lower(text), "score_")


def domain_scores_basic(docs: DataFrame, vocab=None, skills=None, id_col: str = "doc_id",
                        text_col: str = "text") -> DataFrame:
    """Basic analyser: +1 per domain keyword present, +0.5 per extracted skill containing
    one of the domain's keywords; only domains with a score > 0, as rows
    ``(id, domain, domain_ord, score)``."""
    vocab = V.IDENTIFY_BASIC if vocab is None else vocab
    skills = V.COMMON_SKILLS if skills is None else skills
    terms = _basic_terms(vocab, skills)
    wide = weighted_term_scores(docs, terms, id_col, text_col)
    domains = list(terms.keys())
    return (long_scores(wide, id_col, domains, [f"score_{i}" for i in range(len(domains))])
            .filter(F.col("score") > 0))


# --------------------------------------------------------------------------- D3
def _lookup_sum(m: Column):
    def merge(acc, sk):
        return acc + F.coalesce(F.try_element_at(m, sk), F.lit(0))
    return merge


def domain_scores_extended(docs: DataFrame, vocab: dict, skills: list[str],
                           skill_domain: dict, id_col: str = "doc_id", text_col: str = "text",
                           default_skills: list[str] | None = None) -> DataFrame:
    """Extended analyser: per domain min(0.5, 0.1 + (hits/len(vocab[d]))·0.4) + 0.1 per
    extracted skill mapped to the domain + 0.05 per extracted skill that is one of the
    domain's keywords; capped at 1. Duplicated keywords count in hits and denominator.
    Skills are extracted from the text (vocabulary order), ``default_skills`` when none.
    The skill bonus is a narrow lookup in literal maps (units of 0.05), carried beside the
    keyword sums. Rows ``(id, domain, domain_ord, score)``."""
    from talentgrid.operators.skills import extract_skills
    default_skills = V.DEFAULT_SKILLS_EXTENDED if default_skills is None else default_skills
    domains = list(vocab.keys())
    lens = [len(vocab[d]) for d in domains]
    d = extract_skills(docs, skills, text_col, limit=None, default=default_skills, out_col="_sk")
    bonus_cols = []
    for i, dom in enumerate(domains):
        kw_lower = {k.lower() for k in vocab[dom]}
        units = {}
        for sname in set(skills) | set(default_skills):
            u = (2 if skill_domain.get(sname) == dom else 0) + (1 if sname.lower() in kw_lower else 0)
            if u:
                units[sname] = u
        if units:
            m = F.create_map(*[x for k, u in units.items() for x in (F.lit(k), F.lit(u))])
            b = F.aggregate(F.col("_sk"), F.lit(0), _lookup_sum(m))
        else:
            b = F.lit(0)
        bonus_cols.append(b.alias(f"_b{i}"))
    d = d.select(id_col, text_col, *bonus_cols)
    carry = [f"_b{i}" for i in range(len(domains))]
    wide = _sums(d, _entries(vocab), len(domains), _present, id_col, F.lower(F.col(text_col)), "_k", carry)
    scores = [F.least(F.lit(1.0),
                      F.least(F.lit(0.5), F.lit(0.1) + (F.col(f"_k{i}") / F.lit(float(lens[i]))) * F.lit(0.4))
                      + F.col(f"_b{i}") * F.lit(0.05)) for i in range(len(domains))]
    wide = wide.select(id_col, *[s.alias(f"score_{i}") for i, s in enumerate(scores)])
    return long_scores(wide, id_col, domains, [f"score_{i}" for i in range(len(domains))])


# --------------------------------------------------------------------------- D4
def guess_domain(docs: DataFrame, vocab=None, id_col: str = "doc_id", title_col: str = "title",
                 text_col: str = "description") -> DataFrame:
    """Domain with the most keyword occurrences in ``title + " " + description``; null when
    nothing occurs. Ties go to the first domain."""
    vocab = V.SCRAPER_DOMAINS if vocab is None else vocab
    domains = _domains(vocab)
    d2 = docs.select(id_col, F.concat_ws(" ", F.coalesce(F.col(title_col), F.lit("")),
                                         F.coalesce(F.col(text_col), F.lit(""))).alias("_text"))
    wide = _sums(d2, _entries(vocab), len(domains), _times, id_col, F.lower(F.col("_text")), "occ_")
    cols = [F.col(f"occ_{i}") for i in range(len(domains))]
    main, best = argmax_domain(cols, domains)
    return wide.select(id_col, F.when(best > 0, main).alias("guessed_domain"),
                       best.cast("long").alias("occurrences"))


# --------------------------------------------------------------------------- D5
def classify_confidence(docs: DataFrame, vocab=None, id_col: str = "doc_id", text_col: str = "text",
                        default_domain: str = "informatique_reseaux") -> DataFrame:
    """Count of keywords present per domain; best domain (first on ties) with confidence
    min(1, n/5); (default_domain, 0.5) when nothing is present."""
    vocab = V.CLASSIFY_KEYWORDS if vocab is None else vocab
    domains = _domains(vocab)
    wide = _sums(docs, _entries(vocab), len(domains), _present, id_col, F.lower(F.col(text_col)), "n_")
    cols = [F.col(f"n_{i}") for i in range(len(domains))]
    main, best = argmax_domain(cols, domains)
    return wide.select(
        id_col,
        F.when(best == 0, F.lit(default_domain)).otherwise(main).alias("classification"),
        F.when(best == 0, F.lit(0.5)).otherwise(F.least(F.lit(1.0), best / F.lit(5.0))).alias("confidence"))


# --------------------------------------------------------------------------- D16 / D17
def competence_coverage(docs: DataFrame, competences: dict, id_col: str = "doc_id",
                        text_col: str = "text") -> DataFrame:
    """Per (document, domain, competence): keywords found / keywords listed (a
    deterministic level instead of a random draw). ``competences`` maps
    domain → {competence: [keywords]}. Rows (id, domain, competence, n_found, n_total,
    level). Hits are counted row by row into one column per competence
    (the competence list is known at plan time), then exploded back to rows."""
    rows, comps = [], []
    for di, (d, cs) in enumerate(competences.items()):
        for c, kws in cs.items():
            ci = len(comps)
            comps.append((d, c, len(kws)))
            for k in kws:
                rows.append((k, ci, None))
    wide = _sums(docs, rows, len(comps), _present, id_col, F.lower(F.col(text_col)), "_n")
    arr = F.array(*[F.struct(F.lit(d).alias("domain"), F.lit(c).alias("competence"),
                             F.col(f"_n{i}").cast("long").alias("n_found"),
                             F.lit(n).cast("long").alias("n_total"),
                             (F.col(f"_n{i}") / F.lit(float(n))).alias("level"))
                    for i, (d, c, n) in enumerate(comps)])
    return wide.select(id_col, F.inline(arr))


def domain_map(scores_long: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document with ``map<domain, score>`` (entries in domain order)."""
    entries = F.array_sort(F.collect_list(F.struct("domain_ord", "domain", "score")))
    return (scores_long.groupBy(id_col)
            .agg(F.map_from_entries(F.transform(entries, lambda e: F.struct(e["domain"], e["score"])))
                 .alias("domain_scores")))


def sorted_domain_scores(scores_long: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document the (domain, score) list sorted by score desc, ties in domain order."""
    e = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("_neg"), "domain_ord", "domain", "score")))
    return scores_long.groupBy(id_col).agg(F.transform(e, lambda x: F.struct(x["domain"], x["score"]))
                                           .alias("ranked_domains"))


def domain_prompt(vocab: dict, spark) -> DataFrame:
    """One descriptive text per domain: "Domaine: <label>. Mots-clés: k1, k2, ..."."""
    from talentgrid.functions.text import domain_label
    df = V.vocab_frame(spark, vocab)
    g = df.groupBy("domain", "domain_ord").agg(F.array_sort(F.collect_list(F.struct("kw_ord", "keyword"))).alias("_k"))
    return g.select("domain", F.concat(F.lit("Domaine: "), domain_label("domain"), F.lit(". Mots-clés: "),
                                       F.array_join(F.transform("_k", lambda e: e["keyword"]), ", ")).alias("prompt"))


def domain_summary(scores_long: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``domain_map`` and ``sorted_domain_scores`` from one aggregation per document."""
    e = F.collect_list(F.struct("domain_ord", "domain", "score"))
    x = scores_long.groupBy(id_col).agg(e.alias("_e"))
    by_ord = F.array_sort("_e")
    by_score = F.array_sort(F.transform("_e", lambda v: F.struct((-v["score"]).alias("_neg"), v["domain_ord"].alias("o"),
                                                                 v["domain"].alias("domain"), v["score"].alias("score"))))
    return x.select(id_col,
                    F.map_from_entries(F.transform(by_ord, lambda v: F.struct(v["domain"], v["score"])))
                    .alias("domain_scores"),
                    F.transform(by_score, lambda v: F.struct(v["domain"].alias("domain"), v["score"].alias("score")))
                    .alias("ranked_domains"))
