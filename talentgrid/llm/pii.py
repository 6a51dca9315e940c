"""Personal data: base spans, and terms that disclose them.

Base spans are e-mail addresses, IP numbers, payment cards and telephone numbers, found by
patterns. The values found are the protected entities. A term in a document of an entity
discloses it as far as knowing the term tells the entity: over all documents, the pointwise
mutual information of the two is set against the information of the entity,

    log2(N * n(entity, term) / (n(entity) * n(term))) / log2(N / n(entity)),

which is 1 when the term is only ever met with the entity and 0 when it tells nothing.
Pairs met in at least ``MIN_SUPPORT`` documents count. From ``GENERALISE_AT`` a term is
generalised all the way to the mark ``[TERM]`` (no broader word is looked up), from
``REMOVE_AT`` it goes, wherever it stands in the documents that name the entity. All counts are of documents, the two being anywhere in the text, the
term outside base spans when it is met with the entity. An entity of fewer documents than
the support has no pairs, so only the others are paired with the terms of their documents.

All of it is SQL functions. Counts are combined before each shuffle and the pair join is
salted, so an entity found in a third of all documents is spread over tasks. The patterns
are possessive and begin only where a match can begin, which gives the same matches as the
plain patterns in linear time and without deep recursion, also on very long texts.

Defined results: a null text is empty and has no spans; rows with equal id and text are one
document in the counts and all get its spans; spans of different kinds may overlap; an
empty table gives an empty result. Columns other than id and text are passed on untouched
by :func:`sanitise` and may bear any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentgrid.llm.common import key_of, stored

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
MIN_SUPPORT = 3
GENERALISE_AT = 0.75
REMOVE_AT = 0.95
SALTS = 16
#: So many terms are broadcast to be counted over all texts; more are joined after the count.
BROADCAST_TERMS = 500_000
#: Terms are counted in a sixteenth and in a quarter of the texts before all of them.
COUNTED_FIRST = (16, 4)

_LOCAL = "A-Za-z0-9._%+-"
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
#: Possessive forms; a start inside a run that has already failed is not tried again.
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # a whole run of digits with single separators, of 12 to 19 digits
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WORDS = r"[\p{L}\p{N}]{3,}+"
#: The same beside base spans, which are filled with a character that is none.
CLEAR_WORDS = r"(?<![\p{L}\p{N}\x{FFFF}])[\p{L}\p{N}]{3,}+(?!\x{FFFF})"


def running(lens: Column) -> Column:
    """Sums before each element of an array, in steps of 128 (linear on long arrays)."""
    step = 128
    grow = lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x))
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lens) - 1) / step).cast("int")),
                         lambda c: F.slice(lens, c * step + 1, step))
    heads = F.aggregate(F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x)),
                        F.array(F.lit(0)), grow)
    return F.flatten(F.transform(chunks, lambda c, i: F.aggregate(
        F.slice(c, 1, F.size(c) - 1), F.array(F.get(heads, i)), grow)))


def luhn(digits: Column) -> Column:
    def worth(c, i):
        n = c.cast("int")
        twice = F.when(n > 4, 2 * n - 9).otherwise(2 * n)
        return F.when(i % 2 == 1, twice).otherwise(n)
    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), worth), F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return luhn(F.regexp_replace(m, "[^0-9]", ""))
    if kind == "phone":
        return F.length(F.regexp_replace(m, "[^0-9]", "")).between(9, 15)
    return F.lit(True)


def _add_matches(d: DataFrame, col: str, text: str, pattern: str, when: Column) -> DataFrame:
    """Adds ``col``: array of (start, end, value) of the matches in ``text``."""
    none = F.array().cast("array<string>")
    d = d.withColumn(f"{col}_m", F.when(when, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none))
    some = F.size(f"{col}_m") > 0
    d = d.withColumn(f"{col}_g", F.when(some, F.slice(F.split(text, pattern, -1), F.lit(1), F.size(f"{col}_m"))))
    d = d.withColumn(f"{col}_l", F.when(some, F.zip_with(f"{col}_g", f"{col}_m", lambda g, m: F.length(g) + F.length(m))))
    d = d.withColumn(f"{col}_r", F.when(some, running(F.col(f"{col}_l"))))
    spans = F.transform(f"{col}_m", lambda m, i: F.struct(
        (F.get(f"{col}_r", i) + F.length(F.get(f"{col}_g", i))).alias("start"),
        (F.get(f"{col}_r", i) + F.get(f"{col}_l", i)).alias("end"), m.alias("value")))
    return d.withColumn(col, F.when(some, spans)).drop(f"{col}_m", f"{col}_g", f"{col}_l", f"{col}_r")


def base(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """(id, idk, th, body, base): the valid base spans (start, kind, end, value) in order;
    ``kind`` is the place in :data:`KINDS`, and (idk, th) the key of the document."""
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"))
    d = d.select("id", key_of(F.col("id")).alias("idk"), F.xxhash64("body").alias("th"), "body")
    cue = {"email": F.contains("body", F.lit("@")), "ip": F.contains("body", F.lit(".")), "card": F.lit(True),
           "phone": F.contains("body", F.lit("+"))}
    for kind in KINDS:
        d = _add_matches(d, kind, "body", PATTERNS[kind], cue[kind])
    def found(k, kind):
        some = F.filter(F.coalesce(kind, F.array().cast("array<struct<start:int,end:int,value:string>>")),
                        lambda s: valid(kind, s["value"]))
        return F.transform(some, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind"),
                                                    s["end"].alias("end"), s["value"].alias("value")))

    return d.select("id", "idk", "th", "body", F.sort_array(F.concat(*[found(k, kind) for k, kind in enumerate(KINDS)])).alias("base"))


def contexts(based: DataFrame) -> DataFrame:
    """One row per document with base spans: (idk, th), its distinct ``entities`` and the
    occurrences of terms, ``terms`` (start, end, value), none of them touching a base span."""
    d = based.filter(F.size("base") > 0).select("idk", "th", "body", "base").dropDuplicates(["idk", "th"])
    name = lambda s: F.concat_ws(":", s["kind"].cast("string"), F.lower(s["value"]))
    start = F.array().cast("array<struct<start:int,end:int>>")
    grown = lambda a, s: F.struct(F.element_at(a, -1)["start"].alias("start"), F.greatest(
        F.element_at(a, -1)["end"], s["end"]).alias("end"))
    union = F.aggregate("base", start, lambda a, s: F.when(
        (F.size(a) > 0) & (F.try_element_at(a, F.lit(-1))["end"] > s["start"]),
        F.concat(F.slice(a, 1, F.size(a) - 1), F.array(grown(a, s)))).otherwise(
        F.concat(a, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))))
    d = d.select("idk", "th", "body", F.array_distinct(F.transform("base", name)).alias("entities"), union.alias("u"))
    before = lambda i: F.coalesce(F.get("u", i - 1)["end"], F.lit(0))
    filled = F.transform("u", lambda s, i: F.concat(F.substring(F.col("body"), before(i) + 1, s["start"] - before(i)),
                                                    F.repeat(F.lit("\uffff"), s["end"] - s["start"])))
    rest = F.substring(F.col("body"), F.element_at("u", -1)["end"] + 1, F.length("body"))
    d = d.select("idk", "th", "entities", F.concat(F.array_join(filled, ""), rest).alias("clear"))
    d = _add_matches(d, "t", "clear", CLEAR_WORDS, F.lit(True))
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    terms = F.transform(F.coalesce("t", none), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), F.lower(t["value"]).alias("value")))
    return d.select("idk", "th", "entities", terms.alias("terms"))


def salted(few: DataFrame) -> DataFrame:
    return few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def of_entities(near: DataFrame, entities: DataFrame, *cols) -> DataFrame:
    """The rows of :func:`contexts`, one for each of their entities that ``entities`` has."""
    rows = near.select("idk", "th", F.explode("entities").alias("entity"), *cols, F.pmod(F.hash("idk", "th"), F.lit(SALTS)).alias("salt"))
    return rows.join(salted(entities), ["entity", "salt"], "left_semi")


def _documents_with(wanted: DataFrame, docs: DataFrame, text: Column) -> DataFrame:
    """(term, n_term): the number of documents that hold each of the terms asked for."""
    every = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(WORDS), F.lit(0)))
    words = docs.select(F.explode(every).alias("term"))
    few = wanted.count() <= BROADCAST_TERMS
    # only the terms asked for are shuffled, unless they are too many to broadcast
    counts = (words.join(F.broadcast(wanted), "term", "left_semi") if few else words).groupBy("term").agg(F.count("*").alias("n_term"))
    return counts if few else counts.join(wanted, "term", "left_semi")


def disclosures(near: DataFrame, docs: DataFrame, text: Column, n_docs: int, min_support: int = MIN_SUPPORT,
                generalise_at: float = GENERALISE_AT, remove_at: float = REMOVE_AT) -> DataFrame:
    """(entity, term, share, removed): the pairs whose disclosure is at least
    ``generalise_at``. ``near`` has the rows of :func:`contexts`."""
    n = F.lit(float(max(n_docs, 1)))
    alone = near.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_entity")) \
        .filter((F.col("n_entity") >= min_support) & (F.col("n_entity") < n))
    words = F.array_distinct(F.transform("terms", lambda t: t["value"]))
    pairs = of_entities(near, alone.select("entity"), words.alias("words")).select("entity", F.explode("words").alias("term")) \
        .groupBy("entity", "term").agg(F.count("*").alias("n_both")).filter(F.col("n_both") >= min_support)
    # a term is in as many documents at least as have it beside an entity: pairs whose share
    # is too small with that number already need no count over all texts
    seen = near.select(F.explode(words)).select(F.col("col").alias("term")).groupBy("term").agg(F.count("*").alias("n_seen"))
    most = F.log2(n * F.col("n_both") / (F.col("n_entity") * F.col("n_seen"))) / F.log2(n / F.col("n_entity"))
    pairs = pairs.join(alone, "entity").join(seen, "term").filter(most >= generalise_at - 1e-9).drop("n_seen")
    pairs = stored(pairs, "pii-met")
    # the share reaches generalise_at while the term is in at most so many documents
    most = n * F.col("n_both") / F.col("n_entity") * F.pow(n / F.col("n_entity"), F.lit(-generalise_at))
    wanted = stored(pairs.groupBy("term").agg(F.max(most * (1 + 1e-9)).alias("most")), "pii-terms")
    # what a part of the texts holds is in all of them: a term that is too common in a part needs
    # no count over the rest
    for parts in COUNTED_FIRST:
        part = docs.filter(F.pmod(F.xxhash64(text.cast("string")), F.lit(parts)) == 0)
        found = _documents_with(wanted.select("term"), part, text)
        wanted = stored(wanted.join(found, "term", "left").filter(F.coalesce("n_term", F.lit(0)) <= F.col("most")).select("term", "most"), "pii-terms")
    counts = _documents_with(wanted.select("term"), docs, text)
    share = F.log2(n * F.col("n_both") / (F.col("n_entity") * F.col("n_term"))) / F.log2(n / F.col("n_entity"))
    return pairs.join(counts, "term") \
        .select("entity", "term", share.alias("share")).filter(F.col("share") >= generalise_at) \
        .withColumn("removed", F.col("share") >= remove_at)


def spans(docs: DataFrame, id_col="doc_id", text_col="text", **thresholds) -> DataFrame:
    """(id, idk, th, base, terms): base spans and the added term spans of every row."""
    # one pass over the texts; only those with spans go on whole
    found = stored(base(docs, id_col, text_col).withColumn("body", F.when(F.size("base") > 0, F.col("body"))), "pii-base")
    near = stored(contexts(found), "pii-near")
    found = found.drop("body")
    pairs = stored(disclosures(near, docs, F.col(text_col), found.count(), **thresholds), "pii-pairs")
    hits = of_entities(near, pairs.select("entity").distinct(), "terms") \
        .select("idk", "th", "entity", "salt", F.explode("terms").alias("t")) \
        .select("idk", "th", "entity", F.col("t.value").alias("term"), F.col("t.start").alias("start"), F.col("t.end").alias("end"), "salt")
    hits = hits.join(salted(pairs), ["entity", "term", "salt"])
    per = hits.groupBy("idk", "th", "start", "end").agg(F.max("removed").alias("removed")) \
        .groupBy("idk", "th").agg(F.sort_array(F.collect_list(F.struct("start", "end", "removed"))).alias("terms"))
    none = F.array().cast("array<struct<start:int,end:int,removed:boolean>>")
    return found.join(per, ["idk", "th"], "left").withColumn("terms", F.coalesce("terms", none))


def labelled(spans_col: Column) -> Column:
    """``kind:start:end`` of spans (start, kind, end), comma-joined."""
    names = F.array(*[F.lit(k) for k in (*KINDS, TERM)])
    return F.array_join(F.transform(spans_col, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitise(docs: DataFrame, id_col="doc_id", text_col="text", **thresholds) -> DataFrame:
    """The input rows with every base span replaced by its kind in brackets, disclosing
    terms by ``[TERM]`` or, from ``remove_at``, by nothing. Overlapping spans are replaced
    together by the first."""
    got = spans(docs, id_col, text_col, **thresholds)
    base_marks = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.concat(
        F.lit("["), F.upper(F.get(F.array(*[F.lit(k) for k in KINDS]), s["kind"])), F.lit("]")).alias("put")))
    term_marks = F.transform("terms", lambda s: F.struct(s["start"].alias("start"), F.lit(len(KINDS)).alias("kind"), s["end"].alias("end"), F.when(
        s["removed"], F.lit("")).otherwise(F.lit("[TERM]")).alias("put")))
    # rows with equal id and text have equal spans
    marks = got.filter((F.size("base") > 0) | (F.size("terms") > 0)) \
        .select("idk", "th", F.sort_array(F.concat(base_marks, term_marks)).alias("marks")) \
        .groupBy("idk", "th").agg(F.first("marks").alias("marks"))
    body = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    d = docs.select(F.struct("*").alias("row"), body.alias("body"), key_of(F.col(id_col)).alias("idk"))
    d = d.withColumn("th", F.xxhash64("body")).join(marks, ["idk", "th"], "left")
    # union of overlapping spans, then the text between them
    start = F.array().cast("array<struct<start:int,kind:int,end:int,put:string>>")
    last = lambda a: F.element_at(a, -1)
    merge = lambda a, m: F.when((F.size(a) > 0) & (F.try_element_at(a, F.lit(-1))["end"] > m["start"]), F.concat(
        F.slice(a, 1, F.size(a) - 1), F.array(F.struct(last(a)["start"].alias("start"), last(a)["kind"].alias("kind"), F.greatest(
            last(a)["end"], m["end"]).alias("end"), last(a)["put"].alias("put"))))).otherwise(F.concat(a, F.array(m)))
    d = d.withColumn("u", F.when(F.col("marks").isNotNull(), F.aggregate("marks", start, merge)))
    cut = F.transform("u", lambda m, i: F.concat(F.substring(
        F.col("body"), F.coalesce(F.get("u", i - 1)["end"], F.lit(0)) + 1,
        m["start"] - F.coalesce(F.get("u", i - 1)["end"], F.lit(0))), m["put"]))
    rest = F.substring(F.col("body"), F.element_at("u", -1)["end"] + 1, F.length("body"))
    d = d.withColumn("clean", F.when(F.col("u").isNotNull(), F.concat(F.array_join(cut, ""), rest)))
    fields = [F.coalesce("clean", F.col("row")[c]).alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns]
    return d.select(*fields)
