"""DuckDB SQL of the operators whose results SQL can say."""

from __future__ import annotations

#: op11: the offset of a zone is looked up a day and a half before and after a wall time; where the two differ, whichever fits tells.
STAMPS = r"""
with t as (select row_number() over () as k, stamp_id, source, zone, regexp_replace(raw, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') as s from stamps),
 g as (select *, case when regexp_full_match(s, '[0-9]{10}') then 's' when regexp_full_match(s, '[0-9]{13}') then 'ms'
     when regexp_full_match(s, '(20[0-9]{2}-[0-9]{2}-[0-9]{2}|20[0-9]{2}[0-9]{4}|[0-9]{2}[.][0-9]{2}[.]20[0-9]{2}|[0-9]{2} (Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) 20[0-9]{2}|[0-9]{2}/[0-9]{2}/20[0-9]{2})([T ][0-9]{2}:[0-9]{2}(:[0-9]{2})?( ?[AP]M)?( ?(Z|[+-][0-9]{2}:?[0-9]{2}))?)?') then 'x' end as form,
   regexp_extract(s, '^(20[0-9]{2})-?([0-9]{2})-?([0-9]{2})(?:[T ]|$)', ['y', 'm', 'd']) as iso, regexp_extract(s, '^([0-9]{2})[./]([0-9]{2})[./](20[0-9]{2})', ['a', 'b', 'y']) as eu, regexp_extract(s, '^([0-9]{2}) ([A-Z][a-z]{2}) (20[0-9]{2})', ['d', 'b', 'y']) as named,
   regexp_extract(s, '[T ]([0-9]{2}):([0-9]{2})(?::([0-9]{2}))?(?: ?([AP])M)?(?: ?(?:Z|[+-][0-9]{2}:?[0-9]{2}))?$', ['h', 'm', 's', 'p']) as c, regexp_extract(s, ':[0-9]{2}(?: ?[AP]M)? ?(?:(Z)|([+-])([0-9]{2}):?([0-9]{2}))$', ['z', 'g', 'h', 'm']) as o from t),
 n as (select k, stamp_id, source, zone, s, form, substr(s, 3, 1) = '/' as slashed,
   try_cast(coalesce(nullif(iso.y, ''), nullif(eu.y, ''), named.y) as int) as y, try_cast(coalesce(nullif(iso.d, ''), nullif(eu.a, ''), named.d) as int) as a,
   coalesce(try_cast(coalesce(nullif(iso.m, ''), eu.b) as int), list_position(['Jan', 'Feb', 'Mar', 'Apr', 'May', 'Jun', 'Jul', 'Aug', 'Sep', 'Oct', 'Nov', 'Dec'], named.b)) as b,
   coalesce(try_cast(c.h as int), 0) as h, coalesce(try_cast(c.m as int), 0) as mi, coalesce(try_cast(c.s as int), 0) as sec, nullif(c.p, '') as p, c.h = '' as dated,
   case when o.z = 'Z' then 0 when o.g <> '' then (case o.g when '-' then -60 else 60 end) * (try_cast(o.h as int) * 60 + try_cast(o.m as int)) end as off, coalesce(o.g <> '' and (try_cast(o.h as int) > 14 or try_cast(o.m as int) > 59), false) as badoff from g),
 ok as (select *, form = 'x' and mi <= 59 and sec <= 59 and not badoff and (case when p is null then h <= 23 else h between 1 and 12 end) and (off is not null or zone is not null) as timed,
   case p when 'A' then h % 12 when 'P' then h % 12 + 12 else h end * 3600 + mi * 60 + sec as clock from n),
 r as (select *, case when timed then try_cast(printf('%04d-%02d-%02d', y, b, a) as date) end as df, case when timed and slashed then try_cast(printf('%04d-%02d-%02d', y, a, b) as date) end as mf from ok),
 v as (select source, count(*) filter (df is not null and mf is null) as d, count(*) filter (df is null and mf is not null) as m from r where slashed group by source),
 j as (select r.*, case when form in ('s', 'ms') then 'epoch' when df is null and mf is null then 'bad' when df <> mf then (case when d > 10 * m or m > 10 * d then 'votes' else 'default' end) else 'plain' end as rule,
   case when df <> mf and m > 10 * d then mf else coalesce(df, mf) end as day from r left join v on r.source is not distinct from v.source),
 w as (select *, epoch(day::timestamp)::bigint + clock as wall from j),
 z as (select *, wall - 129600 as b4, wall + 129600 as af from w),
 q as (select *, epoch(timezone(zone, to_timestamp(b4)))::bigint - b4 as ob, epoch(timezone(zone, to_timestamp(af)))::bigint - af as oa from z),
 f as (select *, ob <> oa and epoch(timezone(zone, to_timestamp(wall - oa)))::bigint = wall as fa, ob <> oa and epoch(timezone(zone, to_timestamp(wall - ob)))::bigint = wall as fb from q)
select stamp_id, case rule when 'bad' then null when 'epoch' then (case form when 's' then try_cast(s as bigint) * 1000000 else try_cast(s as bigint) * 1000 end) else 1000000 * (wall - coalesce(off, case when fb and not fa then ob else oa end)) end as utc_us,
  rule, coalesce(rule in ('votes', 'default') or (rule = 'plain' and off is null and ob <> oa and fa = fb), false) as ambiguous from f
"""

_CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split({x}, ''), lambda d: ascii(d)::bigint)), lambda acc, d: list_reduce(list_prepend(xor(acc, d), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda c, _: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)), 4294967295)"


def crc32(x: str) -> str:
    """DuckDB's way to CRC-32 of an ASCII text."""
    return _CRC.format(x=x)


#: op12: prefixes as digests of lists of digests; a node's subtree is found along the path of one member of each node below it.
TRIE = f"""
with t as (select conv_id, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as item, length(coalesce(text, '')) as chars from conversations where conv_id is not null),
 o as (select conv_id, item, chars, row_number() over (partition by conv_id order by turn nulls first, item) as pos from t),
 c as (select conv_id, conv_id - conv_id % 100 as base, {crc32("conv_id::varchar")} % 6 as h from o group by conv_id),
 f as (select c.conv_id, o.pos, o.item, o.chars from c join o on o.conv_id = c.base and o.pos <= c.h),
 u as (select * from f union all select o.conv_id, o.pos + 1000000, o.item, o.chars from o join c on o.conv_id = c.conv_id and o.pos > c.h),
 r as (select conv_id, chars, row_number() over w as d, string_agg(item, ',') over w as p from u window w as (partition by conv_id order by pos rows unbounded preceding)),
 m as (select conv_id, 0 as d, '' as p, 0 as chars from c union all select conv_id, d, sha256(p), chars from r),
 l as (select conv_id, max(d) as n from m group by conv_id),
 g as (select d, p, min(m.conv_id) as conv_id, count(*) as n_convs, max(chars) as chars, coalesce(string_agg(m.conv_id::varchar, ',' order by m.conv_id) filter (l.n = d), '') as ends from m join l on l.conv_id = m.conv_id group by d, p),
 e as (select g.d, g.p, g.conv_id, g.n_convs, g.chars, g.ends, a.p as up from g left join m a on a.conv_id = g.conv_id and a.d = g.d - 1),
 k as (select up, d - 1 as d, count(*) as n from e where up is not null group by up, d),
 x as (select e.*, coalesce(k.n, 0) as n_children from e left join k on k.up = e.p and k.d = e.d),
 s as (select a.p, a.d, sum((x.n_convs - 1) * x.chars) as saved, count(*) filter (x.n_children = 0) as leaves from x join m a on a.conv_id = x.conv_id and a.d <= x.d group by a.p, a.d)
select x.conv_id, x.d::bigint as depth, q.conv_id as parent_conv_id, x.n_convs, x.n_children, s.leaves as n_leaves, s.saved::bigint as saved_tokens, sha256(x.ends) as ends_sha256
from x join s on s.p = x.p and s.d = x.d left join x q on q.p = x.up and q.d = x.d - 1
"""

ORACLES = {"op11_mixed_timestamps": STAMPS, "op12_conversation_trie": TRIE}
