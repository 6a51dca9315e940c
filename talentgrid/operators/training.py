"""Training-set preparation: example building, filters, de-duplication, quota expansion,
prompt rendering, label indexing and an exact stratified split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentgrid import vocab as V
from talentgrid.functions.text import trim_ws, trimmed_length


def _spaced(domain: Column) -> Column:
    return F.replace(domain, F.lit("_"), F.lit(" "))


def category_to_domain(category: Column, mapping: dict | None = None,
                       default: str = "informatique_reseaux") -> Column:
    """Literal map lookup on the trimmed category; unknown or null → default."""
    mapping = V.CATEGORY_MAPPING if mapping is None else mapping
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(m, trim_ws(category)), F.lit(default))


def canonical_domain(domain: Column, aliases: dict | None = None) -> Column:
    aliases = V.DOMAIN_ALIASES if aliases is None else aliases
    m = F.create_map(*[x for k, v in aliases.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(m, domain), domain)


def label_index(domain: Column, domains: list[str] | None = None) -> Column:
    """Fixed ordinal of the domain in ``domains``; unknown → 0."""
    domains = V.TRAINING_DOMAINS if domains is None else domains
    m = F.create_map(*[x for i, d in enumerate(domains) for x in (F.lit(d), F.lit(i))])
    return F.coalesce(F.try_element_at(m, domain), F.lit(0))


def build_examples(rows: DataFrame, source_col: str = "source", text_col: str = "text",
                   category_col: str | None = "category", skills_col: str | None = "skills",
                   mapping: dict | None = None, default_domain: str = "informatique_reseaux",
                   min_len: int = 10) -> DataFrame:
    """Rows of a source → (instruction, input, output, domain): texts whose trimmed length
    exceeds ``min_len``; domain from the category map; CV wording when the source name
    mentions resume/cv, offer wording otherwise."""
    t = F.col(text_col)
    r = rows.filter(t.isNotNull() & (trimmed_length(t.cast("string")) > min_len))
    dom = category_to_domain(F.col(category_col).cast("string"), mapping, default_domain) \
        if category_col else F.lit(default_domain)
    skills = F.coalesce(F.col(skills_col).cast("string"), F.lit("Non spécifié")) if skills_col else F.lit("Non spécifié")
    src = F.lower(F.col(source_col))
    is_cv = src.contains("resume") | src.contains("cv")
    d = _spaced(dom)
    instr = F.when(is_cv, F.concat(F.lit("Analyse ce CV pour un poste dans le domaine "), d, F.lit("."))) \
        .otherwise(F.concat(F.lit("Analyse cette offre d'emploi dans le domaine "), d, F.lit(".")))
    out = F.when(is_cv, F.concat(F.lit("Compétences identifiées : "), skills,
                                 F.lit(". Ce profil est adapté pour des postes en "), d, F.lit("."))) \
        .otherwise(F.concat(F.lit("Compétences requises : "), skills,
                            F.lit(". Cette offre est classée dans le domaine "), d, F.lit(".")))
    return r.select("*", instr.alias("instruction"), t.cast("string").alias("input"), out.alias("output"),
                    dom.alias("domain"))


def required_fields(df: DataFrame) -> DataFrame:
    return df.dropna(subset=["instruction", "input", "output", "domain"])


def domain_in(df: DataFrame, domains: list[str], col: str = "domain") -> DataFrame:
    return df.filter(F.col(col).isin(domains))


def expand_to_quota(df: DataFrame, n_per_domain: int, domains: list[str] | None = None,
                    order_col: str = "ord", prefix_variant: bool = False, materialize_input: bool = True) -> DataFrame:
    """Every example of the listed domains, plus max(0, n − count) variants per domain:
    variant i copies the example at position i mod count and takes template i mod 5
    (CV or offer wording chosen from the base instruction). ``prefix_variant`` gives the
    other form: "Pour le domaine X: <instruction>" and every domain kept.

    Scale: counts are one aggregation; only domains *below* the quota — fewer than
    ``n_per_domain`` rows, a bound set by the caller — are ranked by a window; each base
    example then emits its own variants with ``explode(sequence(j, n−c−1, c))``, so no
    group of unbounded size is ever gathered and no join fans out.
    """
    x = df if (prefix_variant or domains is None) else domain_in(df, domains)
    if materialize_input:
        # read twice (counts, rows): written once to the shared folder instead of
        # recomputing the upstream plan
        from talentgrid.session import materialize
        x = materialize(x)
    cnt = x.groupBy("domain").agg(F.count(F.lit(1)).alias("_c"))
    small = cnt.filter(F.col("_c") < n_per_domain)
    # with a literal domain list the count table has at most one row per listed domain:
    # a proven bound, so it is broadcast; otherwise AQE decides from measured size
    small = F.broadcast(small) if (domains is not None and not prefix_variant) else small
    base = x.join(small, "domain")
    from pyspark.sql import Window
    base = base.withColumn("_j", F.row_number().over(Window.partitionBy("domain").orderBy(order_col)) - 1)
    n_add = F.lit(n_per_domain) - F.col("_c")
    var = base.filter(F.col("_j") < n_add).withColumn(
        "variant", F.explode(F.sequence(F.col("_j"), n_add - 1, F.col("_c"))))
    d = _spaced(F.col("domain"))
    if prefix_variant:
        instr = F.concat(F.lit("Pour le domaine "), d, F.lit(": "), F.col("instruction"))
    else:
        low = F.lower(F.col("instruction"))
        is_cv = F.lit(False)
        for term in V.CV_INSTRUCTION_TERMS:
            is_cv = is_cv | low.contains(term)
        cv_t = F.array(*[F.lit(t) for t in V.CV_TEMPLATES])
        job_t = F.array(*[F.lit(t) for t in V.JOB_TEMPLATES])
        tpl = F.element_at(F.when(is_cv, cv_t).otherwise(job_t), (F.col("variant") % 5 + 1).cast("int"))
        instr = F.replace(tpl, F.lit("{domain}"), d)
    cols = [c for c in x.columns if c != "instruction"]
    originals = x.withColumn("variant", F.lit(-1))
    variants = var.select(*cols, instr.alias("instruction"), "variant")
    return originals.unionByName(variants.select(*originals.columns))


def render_prompt(df: DataFrame) -> DataFrame:
    """Instruction-tuning text: ``<s>[INST] instruction\\ninput [/INST] output </s>`` when all
    three are non-empty, else the question/answer form from ``question``/``prompt`` and
    ``answer``/``response`` (missing columns count as empty)."""
    def c(name):
        return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in df.columns else F.lit("")
    full = (c("instruction") != "") & (c("input") != "") & (c("output") != "")
    qa_q = F.when(c("question") != "", c("question")).otherwise(c("prompt")) if "question" in df.columns else c("prompt")
    qa_a = F.when(c("answer") != "", c("answer")).otherwise(c("response")) if "answer" in df.columns else c("response")
    text = F.when(full, F.concat(F.lit("<s>[INST] "), c("instruction"), F.lit("\n"), c("input"), F.lit(" [/INST] "),
                                 c("output"), F.lit(" </s>"))) \
        .otherwise(F.concat(F.lit("<s>[INST] "), qa_q, F.lit(" [/INST] "), qa_a, F.lit(" </s>")))
    return df.withColumn("formatted_text", text)


#: Rows of one boundary group that may be ranked together.
SMALL = 4096


def stratified_split(df: DataFrame, label_col: str, id_col: str, ratio: float = 0.2, seed: int = 42,
                     small: int = SMALL) -> DataFrame:
    """Exact stratified split: per label the ``floor(ratio·n + 0.5)`` rows with the smallest
    md5(id|seed) go to ``eval``. A null label is a label like any other, and null ids keep their
    rows. Adds ``split``.

    Selection by digits, so that no stratum is ever ranked: rows are counted per label and next
    two hexadecimal digits of the hash (256 rows a label), the running sums tell which prefix the
    cut lies in, and only rows with that prefix are counted by the next digits, until at most
    ``small`` rows of a label are left (or the hash ends: rows of one id), which are ranked."""
    from pyspark.sql import Window
    from talentgrid.session import materialize
    df = materialize(df)
    h = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("|"), F.lit(str(seed))))
    x = df.withColumn("_h", h)
    left = x.groupBy(label_col).agg(F.count("*").alias("_n"))
    # per label: the prefix the cut lies in, how many rows of it go to eval, and its size
    cut = left.select(F.col(label_col).alias("_l"), F.lit("").alias("_p"), F.floor(F.lit(ratio) * F.col("_n") + F.lit(0.5)).cast("long").alias("_k"),
                      F.col("_n").alias("_size"))
    done, depth = None, 0
    while True:
        fine = (F.col("_size") <= small) | (F.length("_p") >= 32)
        done = cut.filter(fine) if done is None else done.unionByName(cut.filter(fine))
        open_ = cut.filter(~fine)
        if depth >= 32 or open_.isEmpty():
            break
        depth += 2
        met = x.select(F.col(label_col).alias("_lab"), "_h").join(open_, F.col("_lab").eqNullSafe(F.col("_l")) & F.col("_h").startswith(F.col("_p")))
        digits = met.groupBy("_l", "_k", F.substring("_h", 1, depth).alias("_q")).agg(F.count("*").alias("_n"))
        w = Window.partitionBy("_l").orderBy("_q").rowsBetween(Window.unboundedPreceding, -1)  # 256 rows a label
        digits = digits.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0)))
        cut = digits.filter((F.col("_before") <= F.col("_k")) & (F.col("_k") < F.col("_before") + F.col("_n")))
        cut = materialize(cut.select("_l", F.col("_q").alias("_p"), (F.col("_k") - F.col("_before")).alias("_k"), F.col("_n").alias("_size")))
    done = materialize(done)
    y = x.join(done, F.col(label_col).eqNullSafe(F.col("_l")), "left")
    head = F.expr("substring(_h, 1, length(_p))")
    at = F.col("_h").startswith(F.col("_p"))
    # a label whose cut takes all its rows has no prefix left
    easy = y.filter(F.col("_p").isNull() | ~at).withColumn("split", F.when(F.col("_p").isNull() | (head < F.col("_p")), "eval").otherwise("train"))
    hard = y.filter(at).withColumn("_r", F.row_number().over(Window.partitionBy("_l").orderBy("_h")))
    hard = hard.withColumn("split", F.when(F.col("_r") <= F.col("_k"), "eval").otherwise("train"))
    cols = df.columns + ["split"]
    return easy.select(*cols).unionByName(hard.select(*cols))


def random_split(df: DataFrame, id_col: str, ratio: float = 0.1, seed: int = 42) -> DataFrame:
    """The plain split: of all rows the ``floor(ratio·n + 0.5)`` of smallest hash go to ``eval``."""
    return stratified_split(df.withColumn("_one", F.lit(1)), "_one", id_col, ratio, seed).drop("_one")


def prompt_dataset(spark, sources: list[str], domains: list[str], n_per_domain: int, out_path: str | None = None,
                   mapping: dict | None = None) -> DataFrame:
    """End to end: read the training sources → examples → keep listed domains → required
    fields → de-duplicate (keep first) → expand to the per-domain quota → prompt text;
    written as CSV when ``out_path`` is given. Returns the prompts."""
    from talentgrid.operators.dedup import dedup_examples
    from talentgrid.sources.readers import read_training_sources
    src = read_training_sources(spark, sources)
    ex = required_fields(domain_in(build_examples(src, mapping=mapping), domains))
    ex = ex.withColumn("ord", F.struct(F.col("source"), F.col("_row")))
    ex = dedup_examples(ex, "ord")
    ex = expand_to_quota(ex.select("ord", "instruction", "input", "output", "domain"), n_per_domain, domains)
    out = render_prompt(ex)
    if out_path:
        out.select("instruction", "input", "output", "domain", "formatted_text").write.mode("overwrite") \
            .option("header", "true").option("escape", '"').csv(out_path)
    return out
