"""CV × offer scorers with exact per-CV top-k — without a cross join.

The scorers (rules, vector bonus, weighted) depend on an offer only through its domain, the set
of CV skills its text contains and an offer-level number, and they never fall as a CV's skills
are found. Four exact reductions follow; together they replace the all-pairs nested loop:

1. **Classes of offers.** Offers of one domain and skill profile score alike up to their own
   order, so a class keeps its first ``k`` (a ``row_number() <= k`` window, which Spark plans as a
   ``WindowGroupLimit`` that also runs *before* the shuffle: a profile holding a third of all
   offers shrinks to ``k`` rows per map task). Classes are searched by their best member, and only
   the ``k`` best classes of a CV are opened.
2. **Profiles of CVs.** CVs with the same domain and skill list share one search.
3. **Blocks of classes, chunks of profiles.** Classes are dealt over blocks and profiles, in the
   order of their rarest skill, over chunks. A unit (block, chunk) gets the posting lists of the
   skills that its chunk names, nothing else of the offers' profiles; neither side is expanded
   into pairs.
4. **Frequent skills once per set.** Within a unit the scores over all classes are worked out once
   per set of frequent skills. Its ``k`` best and the classes on the profile's rarer lists hold the
   ``k`` best of the profile: any other class is beaten by ``k`` that only rise with rarer skills.

The skills searched for are those the CVs name, in a vocabulary or not; offers are read for all of
them in one pass (:mod:`talentgrid.operators.patterns`). Domains are values, not a list: CVs of any
domain, or of none, are served; a missing domain is the empty one, and two missing domains match.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talentgrid.operators.patterns import find_terms
from talentgrid.session import materialize

NO_SKILLS = "array<string>"


def top_k_per_group(df: DataFrame, group_cols, order_cols, k: int, rank_col: str = "rank") -> DataFrame:
    """``row_number() <= k`` per group (Spark plans a partial+final WindowGroupLimit)."""
    w = Window.partitionBy(*group_cols).orderBy(*order_cols)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)


def rerank(df: DataFrame, group_cols, score_col: str = "score", ord_col: str = "ord",
           rank_col: str = "rank") -> DataFrame:
    """Stable rank 1..n by score desc (ties keep input order)."""
    w = Window.partitionBy(*group_cols).orderBy(F.col(score_col).desc(), F.col(ord_col).asc())
    return df.withColumn(rank_col, F.row_number().over(w))


def domain_key(col: str | Column) -> Column:
    """Domain as a never-null key: a missing domain is the empty one."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def _skills() -> Column:
    return F.filter(F.coalesce(F.col("skills"), F.array().cast(NO_SKILLS)), lambda s: s.isNotNull())


@dataclass
class Scorer:
    """What a scorer adds to the search. ``score`` takes columns: hits h, skill units u, the
    offer-level number base, the domain match dm and the number n of the CV's skills, and may only
    rise with h, u and base; ``values`` is the same on NumPy arrays (n a number), step by step, so
    that both give the same doubles. ``order`` ranks offers of one class; ``own_domain``: an offer
    has a row per CV domain, and only those of the CV's domain are candidates."""

    score: Callable[[Column, Column, Column, Column, Column], Column]
    values: Callable
    order: list[Column]
    own_domain: bool = False
    needs_domain: bool = False  # an empty domain matches nothing


@dataclass
class Index:
    """The searchable side: ``members`` (cid and the offers of each class, k at most) and
    ``classes`` (cid, ck, prof, tprof, base, ord), with the skills ``found`` in offers."""

    members: DataFrame
    classes: DataFrame
    postings: DataFrame
    most: float


def skill_table(cvs: DataFrame) -> DataFrame:
    """(no, term): the distinct lower-cased skills that the CVs name."""
    names = cvs.select(F.explode(F.array_distinct(F.transform(_skills(), lambda s: F.lower(s)))).alias("term")).distinct()
    return materialize(names.filter("term <> ''").withColumn("no", F.monotonically_increasing_id()))


def offer_index(offers: DataFrame, scorer: Scorer, k: int) -> Index:
    """``offers``: (ck, prof, tprof, base, ord, offer_id, ...)."""
    by = [*scorer.order, F.col("offer_id").asc()]
    members = materialize(top_k_per_group(offers, ["ck", "prof", "tprof"], by, k, "_r"))
    classes = members.filter("_r = 1").select("ck", "prof", "tprof", "base", "ord", "offer_id") \
        .withColumn("cid", F.monotonically_increasing_id())
    classes = materialize(classes)
    # the profiles stay with the classes: what a match carries on is one offer, not its skills
    members = members.drop("_r").join(classes.select("cid", "ck", "prof", "tprof"), ["ck", "prof", "tprof"]).drop("prof", "tprof")
    postings = classes.select("cid", "ck", "prof", "tprof", "base", "ord", "offer_id", F.explode("prof").alias("no"))
    return Index(members, classes, postings, classes.agg(F.max("base")).first()[0] or 0.0)


def cv_profiles(cvs: DataFrame, skills: DataFrame, postings: DataFrame, cv_key: Column) -> DataFrame:
    """(pid, dk, ck, skills, n, sk): distinct domain and skill lists; ``sk`` holds their skills
    found in any offer from the rarest on: no, c (times in the list), w (weight of the last
    position: 15 among the first three, else 10), what c and units come to from there on, and term."""
    prof = cvs.select(domain_key("domain").alias("dk"), _skills().alias("skills")).distinct()
    prof = materialize(prof.withColumn("pid", F.monotonically_increasing_id()))
    named = prof.select("pid", F.posexplode(F.transform("skills", lambda s: F.lower(s))).alias("pos", "term")) \
        .groupBy("pid", "term").agg(F.count("*").alias("c"), F.max("pos").alias("last"))
    often = postings.groupBy("no").agg(F.count("*").alias("df"))
    known = named.join(skills, "term").join(often, "no")
    w = F.when(F.col("last") < 3, 15).otherwise(10)
    sk = known.groupBy("pid").agg(F.array_sort(F.collect_list(F.struct("df", "no", F.col("c").cast("long").alias("c"), w.cast("long").alias("w"), "term"))).alias("sk"))
    rest = lambda i, f: F.aggregate(F.slice(F.col("sk"), i + 1, F.size("sk")), F.lit(0).cast("long"), lambda a, s: a + f(s))
    bounded = F.transform("sk", lambda s, i: F.struct(
        s["no"].alias("no"), s["c"].alias("c"), s["w"].alias("w"), rest(i, lambda x: x["c"]).alias("rest_c"),
        rest(i, lambda x: x["c"] * (x["w"] + 5)).alias("rest_u"), s["term"].alias("term")))
    none = F.array().cast("array<struct<no:bigint,c:bigint,w:bigint,rest_c:bigint,rest_u:bigint,term:string>>")
    out = prof.join(sk, "pid", "left").withColumn("sk", F.when(F.col("sk").isNotNull(), bounded).otherwise(none))
    return materialize(out.select("pid", "dk", cv_key.alias("ck"), "skills", F.size("skills").alias("n"), "sk"))


def visits(prof: DataFrame, scorer: Scorer, most: float, first: int, last: int | None, theta: Column) -> DataFrame:
    """The postings to read: one row per profile and skill position in [first, last) whose
    bound reaches ``theta``, with the key (no, dkey); dkey is the CV's domain, or '*' for all."""
    x = prof.select("pid", "ck", "n", "sk", theta.alias("theta"), F.posexplode("sk").alias("at", "s"))
    x = x.filter((F.col("at") >= first) & (F.col("at") < last if last is not None else F.lit(True)))
    bound = lambda dm: scorer.score(F.col("s.rest_c"), F.col("s.rest_u"), F.lit(most), dm, F.col("n"))
    reaches = lambda dm: F.coalesce(bound(dm) >= F.col("theta"), F.lit(True))
    own = F.when(reaches(F.lit(True)), F.concat(F.lit("="), F.col("ck")))
    key = own if scorer.own_domain else F.when(reaches(F.lit(False)), F.lit("*")).otherwise(own)
    return x.withColumn("dkey", key).filter(F.col("dkey").isNotNull()) \
        .select("pid", "ck", "n", "sk", "at", F.col("s.no").alias("no"), "dkey")


def _met(wanted: DataFrame, index: Index, scorer: Scorer) -> DataFrame:
    """(profile, class) rows of the wanted postings, each pair where it first meets."""
    own = index.postings.withColumn("dkey", F.concat(F.lit("="), F.col("ck")))
    post = own if scorer.own_domain else own.unionByName(index.postings.withColumn("dkey", F.lit("*")))
    met = wanted.join(post.withColumnRenamed("ck", "ock"), ["no", "dkey"])
    rarer = F.slice(F.col("sk"), F.lit(1), F.col("at"))
    return met.filter(~F.exists(rarer, lambda s: F.array_contains("prof", s["no"]))).drop("at", "dkey", "no")


#: Classes of a block and profiles of a chunk: what one unit holds in memory.
BLOCK_CLASSES = 1 << 16
CHUNK_PROFILES = 1 << 15
#: A skill on more than this share of a block's classes is frequent there.
FREQUENT = 1 / 16
_FIRST = -(1 << 63)  # a null order or id comes first


def _best(score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, highest first, equal ones in order of place."""
    if len(score) > k:
        kth = np.partition(score, len(score) - k)[len(score) - k]
        above = np.flatnonzero(score > kth)
        at = np.sort(np.concatenate([above, np.flatnonzero(score == kth)[:k - len(above)]]))
    else:
        at = np.arange(len(score))
    return at[np.argsort(-score[at], kind="stable")]


FOUND = "pid long, cid long, h long, u long, dm boolean, hits array<long>, ord long, oid long"


def _unit_search(values: Callable, needs_domain: bool, k: int):
    """The k best classes of a block for every profile of a chunk (cogroup function)."""
    cols = [c.split()[0] for c in FOUND.split(", ")]

    def fn(profiles: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        cls = rows[rows["no"].isna()].sort_values(["ord", "oid", "cid"])
        if profiles.empty or cls.empty:
            return pd.DataFrame({c: [] for c in cols})
        m, cid, base = len(cls), cls["cid"].to_numpy("int64"), cls["base"].to_numpy("float64")
        order, oid = cls["ord"].to_numpy("int64"), cls["oid"].to_numpy("int64")
        domain, names = pd.factorize(cls["ck"])
        code = {name: i for i, name in enumerate(names)}
        by_cid = np.argsort(cid)
        lists = rows[rows["no"].notna()]

        skill, nos = pd.factorize(lists["no"].to_numpy("int64"))

        def places(ids: pd.Series):
            """All lists as one sorted array of skill * m + place, and where each skill begins."""
            size = np.fromiter(map(len, ids), "int64", len(ids))
            at = by_cid[np.searchsorted(cid[by_cid], np.concatenate([np.zeros(0, "int64"), *ids]).astype("int64"))]
            keys = np.repeat(skill, size) * m + at
            keys.sort()
            return keys, np.searchsorted(keys, np.arange(len(nos) + 1) * m)

        keys, begin = places(lists["cids"])
        tkeys, tbegin = places(lists["tcids"])
        number = {no: i for i, no in enumerate(nos.tolist())}
        on = [(keys[begin[i]:begin[i + 1]] - i * m, tkeys[tbegin[i]:tbegin[i + 1]] - i * m) for i in range(len(nos))]

        def score(h, u, at, dm, n):
            s = values(h, u, base[at], dm, n)
            return np.where(np.isnan(s), np.inf, s)

        work = []
        for i, (ck, n, nos, cs, ws) in enumerate(zip(profiles["ck"], profiles["n"], profiles["nos"], profiles["cs"], profiles["ws"])):
            named = [(number[no], c, w) for no, c, w in zip(nos.tolist(), cs.tolist(), ws.tolist()) if no in number]
            often = tuple(x for x in named if len(on[x[0]][0]) > m * FREQUENT)
            work.append(((ck, int(n), often), i, [x for x in named if len(on[x[0]][0]) <= m * FREQUENT]))
        work.sort(key=lambda x: x[0])
        every, highest, last, whose, won = np.arange(m), base.argmax(), None, [], []
        for key, i, rarer in work:
            ck, n, often = key
            if key != last:
                last, h, u = key, np.zeros(m, "int64"), np.zeros(m, "int64")
                for j, c, w in often:
                    at, titles = on[j]
                    h[at] += c
                    u[at] += c * w
                    u[titles] += 5 * c
                dm = (domain == code.get(ck, -1)) & (not needs_domain or ck != "")
                plain = score(h, u, every, dm, n)
                top = _best(plain, k)
                common, kth, h_most, u_most, any_dm = (top, h[top], u[top]), plain[top[-1]], h.max(), u.max(), dm.any()
            at, hh, uu = common
            if rarer:
                # where all its rarer skills could not lift a class over the k-th best, only classes
                # that stand before one of the best count
                most = score(h_most + sum(c for _, c, _ in rarer), u_most + sum(c * (w + 5) for _, c, w in rarer), highest, any_dm, n)
                to = top.max() + 1 if len(top) == k and most <= kth else m
                some = [(on[j][0][:np.searchsorted(on[j][0], to)], on[j][1][:np.searchsorted(on[j][1], to)], c, w) for j, c, w in rarer]
                for held, titles, c, w in some:
                    h[held] += c
                    u[held] += c * w
                    u[titles] += 5 * c
                at = np.sort(np.concatenate([top, *[held for held, *_ in some]]))
                at = at[np.r_[True, at[1:] != at[:-1]]]
                hh, uu = h[at], u[at]
                for held, titles, c, w in some:
                    h[held] -= c
                    u[held] -= c * w
                    u[titles] -= 5 * c
                j = _best(score(hh, uu, at, dm[at], n), k)
                at, hh, uu = at[j], hh[j], uu[j]
            whose.append(i)
            won.append((at, hh, uu, dm[at]))
        at, hh, uu, dms = (np.concatenate(x) for x in zip(*won))
        whose = np.repeat(whose, [len(x[0]) for x in won])
        hits = _hits(profiles["nos"].to_numpy()[whose], at, number, keys, m)
        out = {"pid": profiles["pid"].to_numpy("int64")[whose], "cid": cid[at], "h": hh, "u": uu, "dm": dms, "hits": hits, "ord": order[at], "oid": oid[at]}
        return pd.DataFrame(out, columns=cols)
    return fn


def _hits(named, at: np.ndarray, number: dict, keys: np.ndarray, m: int) -> list:
    """Of each row's ``named`` skills those on whose list its class stands."""
    size = np.fromiter(map(len, named), "int64", len(named))
    nos = np.concatenate([np.zeros(0, "int64"), *named]).astype("int64")
    lists = np.fromiter((number.get(no, -1) for no in nos.tolist()), "int64", len(nos))
    wanted = lists * m + np.repeat(at, size)
    found = np.searchsorted(keys, wanted)
    held = (lists >= 0) & (keys[np.minimum(found, len(keys) - 1)] == wanted) if len(keys) else np.zeros(len(nos), bool)
    row = np.repeat(np.arange(len(named)), size)[held]
    return np.split(nos[held], np.searchsorted(row, np.arange(1, len(named))))


def _blocks(index: Index, scorer: Scorer) -> tuple[DataFrame, list]:
    """The classes with group and block, and (grp, block, highest base) of all blocks. A group's
    blocks follow the offers' order: of equal scores the one in the earlier block comes first."""
    spark = index.classes.sparkSession
    least = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(_FIRST).cast("long"))
    grp = F.col("ck") if scorer.own_domain else F.lit("")
    cls = index.classes.select(grp.alias("grp"), "cid", "ck", "base", least("ord").alias("ord"), least("offer_id").alias("oid"), "prof", "tprof")
    n = max(spark.sparkContext.defaultParallelism, math.ceil(4 * cls.count() / BLOCK_CLASSES))
    cls = materialize(cls.repartitionByRange(n, "grp", "ord", "oid", "cid").withColumn("part", F.spark_partition_id()))
    blocks: dict = {}
    last, held = None, 0
    sizes = cls.groupBy("grp", "part").agg(F.count("*").alias("n"), F.max("base").alias("most"))  # a few a block
    for r in sorted(sizes.collect(), key=lambda r: (r.grp, r.part)):
        if last is None or last[0] != r.grp or held + r.n > BLOCK_CLASSES:
            last, held = (r.grp, len(blocks)), 0
        blocks.setdefault(last, []).append((r.part, r.most))
        held += r.n
    table = [(g, part, block) for (g, block), parts in blocks.items() for part, _ in parts]
    cls = cls.join(F.broadcast(spark.createDataFrame(table, "grp string, part int, block int")), ["grp", "part"]).drop("part")
    most = lambda parts: max(parts, key=lambda x: (x[1] is None or x[1] != x[1], x[1] or 0.0))[1]  # noqa: E731  unknown ones are highest
    return cls, [(g, block, most(parts)) for (g, block), parts in blocks.items()]


def _lists(it):
    """The posting lists of some classes: for every skill the classes that have it, and of them those
    that have it in the title. A unit joins those of one skill."""
    for df in it:
        for (grp, block), x in df.groupby(["grp", "block"]):
            cid, rows = x["cid"].to_numpy("int64"), np.arange(len(x))
            flat = lambda col: (np.concatenate([np.zeros(0, "int64"), *col]).astype("int64"), np.repeat(rows, [len(v) for v in col]))
            no, row = flat(x["prof"])
            if not len(no):
                continue
            nos, of = np.unique(no, return_inverse=True)
            keys = np.sort(of * len(x) + row)
            tno, trow = flat([v if v is not None else () for v in x["tprof"]])
            place = np.minimum(np.searchsorted(nos, tno), len(nos) - 1)
            tkeys = np.unique((place * len(x) + trow)[nos[place] == tno])
            tkeys = tkeys[np.isin(tkeys, keys, assume_unique=True)]
            edges = np.arange(1, len(nos)) * len(x)
            cids, tcids = (np.split(cid[k % len(x)], np.searchsorted(k, edges)) for k in (keys, tkeys))
            yield pd.DataFrame({"grp": grp, "block": block, "no": nos, "cids": cids, "tcids": tcids})


def _with_blocks(prof: DataFrame, scorer: Scorer, blocks: list) -> DataFrame:
    """Adds group and ``to``: the given blocks of it, as (block, highest base)."""
    kind, of = "array<struct<block:int,most:double>>", {}
    for g, block, most in blocks:
        of.setdefault(g, []).append((block, most))
    if scorer.own_domain:
        table = prof.sparkSession.createDataFrame(list(of.items()), f"grp string, to {kind}")
        return prof.withColumn("grp", F.col("ck")).join(F.broadcast(table), "grp")
    one = [F.struct(F.lit(b).alias("block"), F.lit(m).cast("double").alias("most")) for b, m in of.get("", [])]
    return prof.withColumn("grp", F.lit("")).withColumn("to", F.array(*one).cast(kind))  # one group: plain values


def _units(index: Index, prof: DataFrame, scorer: Scorer, placed: tuple | None = None) -> tuple[DataFrame, DataFrame]:
    """The two sides of the units (grp, block, chunk): profiles; classes and posting lists. With
    ``own_domain`` a profile meets only the blocks of its domain (grp), and of them those in ``to``."""
    cls, blocks = placed or _blocks(index, scorer)
    prof = prof if "to" in prof.columns else _with_blocks(prof, scorer, blocks)
    spark = prof.sparkSession
    chunks = max(1, math.ceil(prof.count() / CHUNK_PROFILES), math.ceil(2 * spark.sparkContext.defaultParallelism / max(1, len(blocks))))
    part = lambda f: F.transform("sk", lambda s: s[f])
    dealt = prof.select("pid", "ck", "n", part("no").alias("nos"), part("c").alias("cs"), part("w").alias("ws"), "grp", F.col("to.block").alias("to"))
    dealt = dealt.repartitionByRange(chunks, F.try_element_at("nos", F.lit(1)), F.col("pid")).withColumn("chunk", F.spark_partition_id())
    dealt = materialize(dealt)
    left = dealt.withColumn("block", F.explode("to")).drop("to")
    unit = ["grp", "block", "chunk"]
    wanted = dealt.select("grp", "chunk", "to").distinct().select("grp", F.explode("to").alias("block"), "chunk").distinct()
    cls = cls.join(F.broadcast(wanted.select("grp", "block").distinct()), ["grp", "block"], "left_semi")  # as many as there are blocks
    lists = cls.select("grp", "block", "cid", "prof", "tprof").mapInPandas(_lists, "grp string, block int, no long, cids array<long>, tcids array<long>")
    named = dealt.select(F.col("grp").alias("g"), F.col("chunk").alias("by"), F.explode("nos").alias("named")).distinct()
    lists = lists.join(named, (F.col("grp") == F.col("g")) & (F.col("no") == F.col("named"))) \
        .select("grp", "block", F.col("by").alias("chunk"), "no", "cids", "tcids").join(wanted, unit, "left_semi")
    info = cls.join(wanted, ["grp", "block"]).select(*unit, "cid", "ck", "base", "ord", "oid")
    return left, lists.unionByName(info, allowMissingColumns=True)


def _search_classes(index: Index, prof: DataFrame, scorer: Scorer, k: int) -> DataFrame:
    """The ``k`` best classes of every profile: (pid, cid, h, u, dm, hits, score, ord, oid). All
    profiles meet the first block of their group; the others only those that could score higher there
    than their ``k`` best so far, as equal scores come later."""
    scored = scorer.score(F.col("h"), F.col("u"), F.col("base"), F.col("dm"), F.col("n"))
    cls, blocks = placed = _blocks(index, scorer)
    unit = ["grp", "block", "chunk"]

    def met(profiles):
        left, right = _units(index, profiles, scorer, placed)
        found = left.groupBy(*unit).cogroup(right.groupBy(*unit)).applyInPandas(_unit_search(scorer.values, scorer.needs_domain, k), FOUND)
        return found.join(index.classes.select("cid", "base"), "cid").join(prof.select("pid", "n"), "pid").withColumn("score", scored).drop("base", "n")

    def best(found):
        return top_k_per_group(found, ["pid"], [F.col("score").desc(), F.col("ord").asc(), F.col("oid").asc()], k).drop("rank")

    first = {g: block for g, block, _ in reversed(blocks)}
    later = [x for x in blocks if x[1] != first[x[0]]]
    if not later:
        return best(met(prof))
    head = materialize(best(met(_with_blocks(prof, scorer, [x for x in blocks if x[1] == first[x[0]]]))))
    theta = head.groupBy("pid").agg(F.when(F.count("*") >= k, F.min("score")).alias("theta"))
    all_of = lambda f: F.coalesce(F.try_element_at(F.col("sk"), F.lit(1))[f], F.lit(0))
    bound = lambda x: scorer.score(all_of("rest_c"), all_of("rest_u"), x["most"], F.lit(True), F.col("n"))
    rest = _with_blocks(prof, scorer, later).join(theta, "pid", "left")
    rest = rest.withColumn("to", F.filter("to", lambda x: F.coalesce(bound(x) > F.col("theta"), F.lit(True)))).drop("theta")
    return best(head.unionByName(met(rest.filter(F.size("to") > 0))))


def search(cvs: DataFrame, index: Index, prof: DataFrame, scorer: Scorer, k: int, min_score: float | None = None) -> DataFrame:
    """The top ``k`` members per CV: (cv_id, rank, h, u, dm, hits, named, score and the members'
    columns); ``named``: number and term of the CV's skills found in any offer."""
    best = [F.col("score").desc(), F.col("ord").asc(), F.col("offer_id").asc()]
    scored = scorer.score(F.col("h"), F.col("u"), F.col("base"), F.col("dm"), F.col("n"))
    named = F.transform("sk", lambda s: F.struct(s["no"].alias("no"), s["term"].alias("term"))).alias("named")
    narrow = prof.select("pid", "dk", "ck", "n", "skills", named)
    classes = _search_classes(index, prof, scorer, k)
    opened = classes.select("pid", "cid", "h", "u", "dm", "hits").join(index.members.withColumnRenamed("ck", "ock"), "cid").join(narrow, "pid")
    opened = opened.withColumn("score", scored)
    opened = opened if min_score is None else opened.filter(F.col("score") >= F.lit(min_score).cast("double"))
    opened = top_k_per_group(opened, ["pid"], best, k)
    c = cvs.select("cv_id", domain_key("domain").alias("dk"), _skills().alias("skills"))
    return c.join(opened, ["dk", "skills"])


def _profiled(offers: DataFrame, skills: DataFrame, text: str, out: str) -> DataFrame:
    return find_terms(offers, text, skills.select("no", "term"), "_h").withColumn(out, F.transform("_h", lambda h: h["no"])).drop("_h")


NO_TITLE = "array<bigint>"


# ------------------------------------------------------------------ I2 rules scorer
def rules_score(h: Column, n: Column, dm: Column) -> Column:
    """min(1, 0.1 + 0.3·[domain match] + min(0.6, (hits/n)·0.6)); 0 skill bonus if n = 0."""
    sb = F.when(n > 0, F.least(F.lit(0.6), (h / n) * F.lit(0.6))).otherwise(F.lit(0.0))
    return F.least(F.lit(1.0), (F.lit(0.1) + F.when(dm, F.lit(0.3)).otherwise(F.lit(0.0))) + sb)


def rules_search(cvs: DataFrame, offers: DataFrame, k: int, separate: bool = False):
    """(index, profiles, scorer) of the rules scorer."""
    def values(h, u, base, dm, n):
        sb = np.minimum(0.6, (h / n) * 0.6) if n > 0 else 0.0
        return np.minimum(1.0, (0.1 + np.where(dm, 0.3, 0.0)) + sb)

    scorer = Scorer(lambda h, u, base, dm, n: rules_score(h, n, dm), values, [F.col("ord").asc()], needs_domain=separate)
    skills = skill_table(cvs)
    # a skill must lie within the title or the description: nothing spans the border
    text = F.concat_ws("\u0000", F.lower("title"), F.lower("description")) if separate else F.col("text")
    o = _profiled(offers.select("offer_id", domain_key("domain").alias("ck"), "ord", text.alias("text")), skills, "text", "prof")
    o = o.select("offer_id", "ck", "ord", "prof", F.array().cast(NO_TITLE).alias("tprof"), F.lit(0.0).alias("base"))
    index = offer_index(o, scorer, k)
    return index, cv_profiles(cvs, skills, index.postings, F.col("dk")), scorer


def match_rules(cvs: DataFrame, offers: DataFrame, k: int = 5, min_score: float = 0.0, separate: bool = False) -> DataFrame:
    """Top-``k`` offers per CV under the rules scorer, ``score >= min_score``.

    cvs: (cv_id, domain, skills array<string>); offers: (offer_id, domain, text lower-cased
    "title description", ord) → (cv_id, rank, offer_id, score, matched_skills, domain_match)

    ``separate``: the variant that looks for a skill in the title or in the description (columns
    ``title`` and ``description`` instead of ``text``) and matches no empty domain.
    """
    index, prof, scorer = rules_search(cvs, offers, k, separate)
    out = search(cvs, index, prof, scorer, k, min_score)
    return out.select("cv_id", "rank", "offer_id", "score", F.col("h").alias("matched_skills"), F.col("dm").alias("domain_match"))


# ------------------------------------------------------------------ I1 vector-bonus scorer
def bonus_score(raw: Column, h: Column, dm: Column) -> Column:
    """raw + 0.2·[domain match] + min(0.3, 0.05·hits) (no upper cap)."""
    return (raw + F.when(dm, F.lit(0.2)).otherwise(F.lit(0.0))) + F.least(F.lit(0.3), h * F.lit(0.05))


def match_bonus(cvs: DataFrame, offers: DataFrame, k: int = 5) -> DataFrame:
    """Top-``k`` per CV of raw + domain bonus + skills bonus.

    offers: (offer_id, domain, text = lower-cased content, raw_score, ord); a missing raw score
    counts as 0.
    → (cv_id, rank, offer_id, raw_score, domain_bonus, skills_bonus, matched_skills, score)
    """
    def values(h, u, base, dm, n):
        return (base + np.where(dm, 0.2, 0.0)) + np.minimum(0.3, h * 0.05)

    scorer = Scorer(lambda h, u, base, dm, n: bonus_score(base, h, dm), values, [F.col("base").desc(), F.col("ord").asc()])
    skills = skill_table(cvs)
    o = offers.select("offer_id", domain_key("domain").alias("ck"), "ord", "text", F.coalesce("raw_score", F.lit(0.0)).alias("base"))
    o = _profiled(o, skills, "text", "prof").select("offer_id", "ck", "ord", "prof", F.array().cast(NO_TITLE).alias("tprof"), "base")
    index = offer_index(o, scorer, k)
    out = search(cvs, index, cv_profiles(cvs, skills, index.postings, F.col("dk")), scorer, k)
    return out.select("cv_id", "rank", "offer_id", F.col("base").alias("raw_score"),
                      F.when(F.col("dm"), F.lit(0.2)).otherwise(F.lit(0.0)).alias("domain_bonus"),
                      F.least(F.lit(0.3), F.col("h") * F.lit(0.05)).alias("skills_bonus"),
                      F.col("h").alias("matched_skills"), "score")


# ------------------------------------------------------------------ I3 weighted scorer
def keyword_units(text: Column, weights: dict) -> Column:
    """Rows (ck, base, keywords) as an array: per domain min(30, Σ weights in hundredths) of its
    keywords in the text and which they are; for CVs of any other domain ('' here), nothing."""
    rows = []
    for d, kws in weights.items():
        hits = F.array_compact(F.array(*[F.when(text.contains(kw.lower()), F.struct(
            F.lit(kw).alias("kw"), F.lit(int(round(w * 100))).alias("w"))) for kw, w in kws.items()]))
        units = F.least(F.lit(30), F.aggregate(hits, F.lit(0), lambda a, h: a + h["w"]))
        rows.append(F.struct(F.lit(d).alias("ck"), units.cast("double").alias("base"), F.transform(hits, lambda h: h["kw"]).alias("keywords")))
    rows.append(F.struct(F.lit("").alias("ck"), F.lit(0.0).alias("base"), F.array().cast(NO_SKILLS).alias("keywords")))
    return F.array(*rows)


def match_weighted(cvs: DataFrame, offers: DataFrame, weights: dict, k: int = 5) -> DataFrame:
    """Top-``k`` per CV under the weighted scorer, computed in exact hundredths:
    min(100, 20 + min(50, Σ_hit (15 if the skill's last position < 3 else 10) + 5·[in title])
    + min(30, Σ weights of the CV domain's keywords present)) / 100.

    offers: (offer_id, text = lower(title + " " + description), title_lower, ord)
    cvs: (cv_id, domain, skills) → (cv_id, rank, offer_id, score, matched_skills, domain_units,
    skill_matches, domain_matches); CVs of a domain without weights have no keyword part.
    """
    def units(h, u, base, dm, n):
        return F.least(F.lit(100), F.lit(20) + F.least(F.lit(50), u) + base) / F.lit(100.0)

    def values(h, u, base, dm, n):
        return np.minimum(100.0, 20.0 + np.minimum(50, u) + base) / 100.0

    scorer = Scorer(units, values, [F.col("base").desc(), F.col("ord").asc()], own_domain=True)
    skills = skill_table(cvs)
    o = _profiled(offers.select("offer_id", "ord", "text", "title_lower"), skills, "text", "prof")
    o = _profiled(o, skills, "title_lower", "tprof")
    o = o.select("offer_id", "ord", "prof", "tprof", F.inline(keyword_units(F.col("text"), weights)))
    index = offer_index(o, scorer, k)
    listed = F.when(F.col("dk").isin(*weights), F.col("dk")).otherwise(F.lit(""))
    out = search(cvs, index, cv_profiles(cvs, skills, index.postings, listed), scorer, k)
    # the CV's own spelling of each skill found, at its first place
    low = F.transform("skills", lambda s: F.lower(s))
    names = index_names(out)
    return names.select("cv_id", "rank", "offer_id", "score", F.col("h").alias("matched_skills"),
                        F.col("base").cast("long").alias("domain_units"),
                        F.transform(F.filter("skills", lambda s: F.array_contains("found", F.lower(s))),
                                    lambda s: F.element_at("skills", F.array_position(low, F.lower(s)).cast("int"))).alias("skill_matches"),
                        F.col("keywords").alias("domain_matches"))


def index_names(rows: DataFrame) -> DataFrame:
    """Adds ``found``: the names of the skills in ``hits`` (the CV's own ones that the offer has)."""
    held = F.filter("named", lambda s: F.array_contains("hits", s["no"]))
    return rows.withColumn("found", F.transform(held, lambda s: s["term"]))


# ------------------------------------------------------------------ C2 / E2 / I7 / F1 / F8
def domain_similarity(cv_domain: Column, job_domain: Column, related: dict) -> Column:
    """1.0 same domain, 0.5 when the job domain is related to the CV domain (directed
    edges of a literal relation table), else 0.0."""
    pairs = [F.lit(f"{a}\u0001{b}") for a, bs in related.items() for b in bs]
    rel = F.array(*pairs) if pairs else F.array().cast("array<string>")
    key = F.concat(cv_domain, F.lit("\u0001"), job_domain)
    return F.when(cv_domain == job_domain, F.lit(1.0)).when(F.array_contains(rel, key), F.lit(0.5)).otherwise(F.lit(0.0))


def best_match_per_cv(cvs: DataFrame, matches: DataFrame, offer_domains: DataFrame | None = None) -> DataFrame:
    """Top-1 offer per CV with a domain-match flag; CVs without any match keep a filler
    row (null offer, score 0.0, no match). ``matches``: (cv_id, rank, offer_id, score)."""
    top = matches.filter(F.col("rank") == 1).select("cv_id", "offer_id", "score")
    if offer_domains is not None:
        top = top.join(offer_domains.select("offer_id", F.col("domain").alias("offer_domain")), "offer_id", "left")
    out = cvs.select("cv_id", F.col("domain").alias("cv_domain")).join(top, "cv_id", "left")
    dm = F.coalesce(F.col("offer_domain") == F.col("cv_domain"), F.lit(False)) if offer_domains is not None \
        else F.lit(None).cast("boolean")
    return out.select("cv_id", "cv_domain", "offer_id", F.coalesce("score", F.lit(0.0)).alias("score"),
                      dm.alias("domain_match"))


def domain_offers(cvs: DataFrame, offers: DataFrame, k: int = 5, score_col: str = "raw_score") -> DataFrame:
    """Fallback search for every CV: offers of the CV's main domain by stored score.
    The top-``k`` per domain is computed once (partial window limit) and joined to the
    CVs on the domain — ``k`` rows per CV whatever the size of the domain."""
    top = top_k_per_group(offers, ["domain"], [F.col(score_col).desc(), F.col("ord").asc()], k)
    return (cvs.select("cv_id", F.col("domain").alias("cv_domain"))
            .join(top.select(F.col("domain").alias("cv_domain"), "offer_id", F.col(score_col).alias("score"), "rank"),
                  "cv_domain")
            .select("cv_id", "rank", "offer_id", "score"))


def decode_text(path: str, content: bytes) -> str:
    """Text files: UTF-8, else Latin-1. Other kinds need an extractor of their own."""
    if not path.lower().endswith(".txt"):
        raise ValueError(f"no text extractor for {path.rsplit('.', 1)[-1].lower()} files")
    try:
        return content.decode("utf-8")
    except UnicodeDecodeError:
        return content.decode("latin-1")


def batch_match(files: DataFrame, offers: DataFrame, analyse: Callable[[DataFrame], DataFrame], k: int = 5, min_score: float = 0.3,
                use_fallback: bool = False, extract: Callable[[str, bytes], str] = decode_text) -> DataFrame:
    """Analyses and matches every CV file; a CV that fails gives an error row and stops nothing.

    files: (path, content), of which ``.pdf`` and ``.txt`` count; ``extract`` gives a file's text,
    and what it raises becomes the row's error, as does an empty text. ``analyse``: (cv_id, text) →
    (cv_id, domain, skills). offers: as for :func:`match_rules`. ``use_fallback``: the analysis
    alone, without offers.

    → one row per file: (cv_id = file stem, path, main_domain, skills, results
    array<struct<rank, offer_id, score, matched_skills, domain_match>>, error)
    """
    x = files.filter(F.lower("path").rlike("[.](pdf|txt)$")).select("path", "content")

    def texts(it):
        for df in it:
            out = []
            for path, content in zip(df["path"], df["content"]):
                try:
                    if content is None:
                        raise ValueError("unreadable file")
                    text = extract(path, bytes(content))
                    if not (text or "").strip():
                        raise ValueError("empty text")
                    out.append((path, text, None))
                except Exception as e:  # noqa: BLE001  the file's own failure is its result
                    out.append((path, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "text", "error"])

    read = x.mapInPandas(texts, "path string, text string, error string").withColumn("row", F.monotonically_increasing_id())
    read = materialize(read.withColumn("stem", F.regexp_extract("path", r"([^/]*)[.][^./]*$", 1)))
    found = materialize(analyse(read.filter("error is null").select(F.col("row").alias("cv_id"), "text")))
    if use_fallback:
        results = found.select("cv_id").limit(0).withColumn("results", F.lit(None))
    else:
        top = match_rules(found, offers, k, min_score)
        one = F.struct("rank", "offer_id", "score", "matched_skills", "domain_match")
        results = top.groupBy("cv_id").agg(F.array_sort(F.collect_list(one)).alias("results"))  # k at most
    out = read.join(found, read["row"] == found["cv_id"], "left").drop("cv_id").join(results, read["row"] == results["cv_id"], "left")
    kind = "array<struct<rank:int,offer_id:bigint,score:double,matched_skills:bigint,domain_match:boolean>>"
    return out.select(F.col("stem").alias("cv_id"), "path", F.col("domain").alias("main_domain"), F.coalesce("skills", F.array().cast(NO_SKILLS)).alias("skills"),
                      F.coalesce(F.col("results").cast(kind), F.array().cast(kind)).alias("results"), "error")


def global_top_k(df: DataFrame, k: int, score_col: str = "score", ord_col: str = "ord") -> DataFrame:
    """Global top-``k`` (TakeOrderedAndProject: per-partition top-k, then one merge)."""
    return df.orderBy(F.col(score_col).desc(), F.col(ord_col).asc()).limit(k)


def page_size(n: int | None, default: int = 5, lo: int = 1, hi: int = 20) -> int:
    """Validate a requested result count (1..20, default 5)."""
    if n is None:
        return default
    if not lo <= int(n) <= hi:
        raise ValueError(f"limit must be within {lo}..{hi}, got {n}")
    return int(n)


def hybrid_match(cv_vectors: DataFrame, offer_vectors: DataFrame, cvs: DataFrame, offers: DataFrame,
                 k: int = 5, min_score: float = 0.0) -> DataFrame:
    """Vector search (top-``k`` by cosine, then the CV's domain or all) merged with the
    rules scorer's top-``k``: vector results win on a shared id, the union is re-sorted by
    score (ties: vector rows first), re-ranked and cut to ``k``.

    cv_vectors: (qid, vec, domain); offer_vectors: (iid, vec, domain, ord)."""
    from talentgrid.operators.dedup import hybrid_merge
    from talentgrid.operators.vectors import vector_search
    # the merge reads it twice: k rows a CV, searched for once
    vec = materialize(vector_search(cv_vectors, offer_vectors, limit=k).select(
        F.col("qid").alias("cv_id"), F.col("iid").alias("offer_id"), F.col("cos").alias("score"), "rank"))
    scr = match_rules(cvs, offers, k=k, min_score=min_score)
    return hybrid_merge(vec, scr.select("cv_id", "offer_id", "score", "rank"), k)
