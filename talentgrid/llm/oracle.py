"""DuckDB twins of the opN queries that SQL can express."""

from __future__ import annotations

from talentgrid.llm import license, mixing


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


OP5 = """
with t as (select conv_id, turn, coalesce(role, 'unknown') as who, coalesce(text, '') as body from conversations),
p as (select distinct conv_id as c, who as perspective from t where who not in ('system', 'tool')),
x as (select *, case when who = perspective then 'assistant' when who in ('system', 'tool') then who else 'user' end as role,
    case when who <> perspective and who not in ('system', 'tool') then who end as name
    from t join p on t.conv_id is not distinct from p.c),
y as (select *, '<|im_start|>' || role || coalesce(' name=' || name, '') || chr(10) as head from x),
z as (select *, head || body || '<|im_end|>' || chr(10) as segment, row_number() over w - 1 as position,
    cast(sum(length(head) + length(body) + 11) over (w rows unbounded preceding) as bigint) as seg_end
    from y window w as (partition by conv_id, perspective order by turn nulls first, who, body))
select conv_id, perspective, position, role, name, case when who = perspective then 1 else 0 end as mask,
    seg_end - length(segment) as seg_start, seg_end,
    case when who = perspective then seg_end - length(segment) + length(head) end as mask_start,
    md5(segment) as segment_md5
from z
"""


OP2 = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * cast(x as double))) as v, row_number() over () as uid
    from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as (select q.uid as quid, q.vec_id as query_id, c.uid, c.vec_id, cast(list_dot_product(q.v, c.v) as bigint) as score
    from v q join v c on q.uid <> c.uid where q.vec_id % 20 = 0)
select query_id, rank, vec_id, score from (select *, row_number() over (partition by quid order by score desc, vec_id nulls last, uid) as rank from p)
where rank <= 20
"""


OP12 = """
with t as (select 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' as up, 'abcdefghijklmnopqrstuvwxyz' as low,
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+' as term),
d as (select row_number() over () as uid, doc_id, regexp_extract_all(translate(coalesce(text, ''), up, low), term) as terms from documents, t),
s as (select count(*) filter (len(terms) > 0) as n_docs, sum(len(terms)) as total from d),
q as (select row_number() over () as quid, item_id, regexp_extract_all(translate(coalesce(text, ''), up, low), term) as terms from benchmark, t),
qt as (select quid, item_id, term, count(*) as times from (select quid, item_id, unnest(terms) as term from q) group by all),
tf as (select uid, doc_id, n, term, count(*) as tf from (select uid, doc_id, len(terms) as n, unnest(terms) as term from d)
    where term in (select term from qt) group by all),
w as (select term, cast(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) as bigint) as w from tf, s group by term),
p as (select quid, item_id, uid, doc_id, cast(sum(times * w * ((1000000000 * tf) //
    (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // cast(total as bigint))))) as bigint) as score
    from qt join tf using (term) join w using (term), s group by all)
select item_id, rank, doc_id, score from (select *, cast(row_number() over (partition by quid order by score desc, doc_id nulls last, uid) as int) as rank
    from p where score > 0)
where rank <= 20
"""


def op9() -> str:
    known = "MAP {" + ", ".join(f"{_quoted(k)}: {_quoted(v)}" for k, v in license.SENTENCES.items()) + "}"
    norm = "trim(regexp_replace(regexp_replace(lower(s), " \
        "'^[^a-z0-9]*(?:copyright|\\(c\\)|©)(?:[^a-z0-9]+(?:c|[0-9]{4})\\b).*$', 'copyright'), '[^a-z0-9]+', ' ', 'g'))"
    steps, names = [], []
    for i, (name, ids) in enumerate(license.RULES):
        rule = _quoted("|" + "||".join(ids) + "|")
        steps.append(f"r{i + 1} as (select *, replace(rest{i}, {rule}, '|~|') as rest{i + 1}, "
                     f"case when contains(rest{i}, {rule}) then {_quoted(name)} end as f{i} from r{i})")
        names.append(f"f{i}")
    n = len(license.RULES)
    first = {}
    for i, (name, _) in enumerate(license.RULES):
        first.setdefault(name, []).append(f"f{i}")
    # a licence is listed once, at its first rule that matched
    listed = ", ".join(
        f"case when f{i} is not null" + "".join(f" and {f} is null" for f in first[name] if int(f[1:]) < i)
        + f" then f{i} end" for i, (name, _) in enumerate(license.RULES))
    return f"""
with s0 as (select doc_id, list_filter(
    regexp_split_to_array(regexp_replace(coalesce(text, ''), '[.!?]+(\\s|$)', chr(10), 'g'), '\\n'),
    lambda s: regexp_matches(lower(s), '{license.CUE}')) as cues from documents),
s as (select doc_id, list_transform(cues, lambda s: coalesce({known}[{norm}], 'unknown')) as ids from s0),
r0 as (select doc_id, ids, '|' || array_to_string(list_transform(ids, lambda s: s || '|'), '|') as rest0 from s),
{", ".join(steps)}
select doc_id, array_to_string(ids, ',') as sentence_ids,
    array_to_string(list_filter([{listed}], lambda f: f is not null), ',') as licenses,
    len(list_filter(string_split(rest{n}, '|'), lambda p: p <> '' and p <> '~')) as n_unknown
from r{n}
"""


def op10(weights=(5, 2, 1), share=1.5, cap=2.0) -> str:
    w = "[" + ", ".join(f"{float(x)}" for x in weights) + "]"
    return f"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as size,
    md5(coalesce('=' || cast(doc_id as varchar), '')) as key from documents),
s0 as (select source, cast(sum(size) as bigint) as source_size from d group by source),
s1 as (select *, {w}[1 + (row_number() over (order by source nulls last) - 1) % {len(weights)}] as weight,
    source_size * {cap} as most, sum(source_size) over () * {share} as total from s0),
s2 as (select *, total - coalesce(sum(most) over (order by most / weight, source nulls last rows between unbounded preceding and 1 preceding), 0) as rest,
    sum(weight) over (order by most / weight, source nulls last rows between current row and unbounded following) as w_rest,
    row_number() over (order by most / weight, source nulls last) as rn from s1),
s3 as (select *, most <= rest / w_rest * weight as capped from s2),
lv as (select rest as l_rest, w_rest as l_w from s3 where not capped order by rn limit 1),
s4 as (select s3.*, case when capped or l_rest is null then most else weight * l_rest / l_w end as target from s3 left join lv on true),
s5 as (select *, greatest(1, least({mixing.BLOCK_WORDS}, cast(ceil(source_size / {mixing.MIN_BLOCKS}) as bigint))) as width from s4),
s6 as (select *, cast(ceil(source_size / width) as bigint) as nb, case when source_size > 0 then floor(target / source_size) else 0 end as ep from s5),
s7 as (select *, ep * nb + (target - ep * source_size) / width as slots from s6),
s8 as (select *, sum(slots) over (order by source nulls last rows unbounded preceding) as upto, sum(slots) over () as all_slots from s7),
pts as (select i, (i + 1) * {mixing.PHI!r} - floor((i + 1) * {mixing.PHI!r}) as u
    from (select unnest(range(cast(ceil((select max(all_slots) from s8)) as bigint))) as i)),
hits as (select source, nb, row_number() over (partition by source order by i) - 1 as r from pts, s8
    where slots > 0 and u >= (upto - slots) / all_slots and u < upto / all_slots),
mult as (select source, r % nb as block, count(*) as m from hits where r // nb < {int(cap)} group by all),
pl as (select doc_id, source, size, cast(sum(size) over (partition by source order by key, size rows unbounded preceding) as bigint) - size as start,
    row_number() over () as rn from d),
parts as (select pl.rn, pl.source, pl.size, pl.start, s8.width, unnest(range(pl.start // s8.width, (pl.start + pl.size - 1) // s8.width + 1)) as block
    from pl join s8 on pl.source is not distinct from s8.source where pl.size > 0),
got as (select parts.rn, sum(m * (least(start + size, (parts.block + 1) * width) - greatest(start, parts.block * width))) as t
    from parts join mult on parts.source is not distinct from mult.source and parts.block = mult.block group by 1)
select pl.doc_id, pl.size, s8.source_size, s8.target, cast(coalesce(got.t, 0) as bigint) as taken, pl.source
from pl join s8 on pl.source is not distinct from s8.source left join got on got.rn = pl.rn
"""


ORACLE = {"op2_inner_product_topk": OP2, "op5_chat_perspectives": OP5, "op9_license_scan": op9(), "op10_source_mix": op10(),
          "op12_lexical_search": OP12}
