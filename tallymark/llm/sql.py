"""Reference SQL for the queries that SQL can express on whole tables."""

BARE = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')"

EXACT = f"""
with d as (select doc_id, length(coalesce(text, '')) as n, {BARE} as bare from documents),
g as (
  select doc_id, sha256(bare) as text_sha256, count(*) over (partition by bare) as group_size,
    first_value(doc_id) over (partition by bare order by n desc, doc_id) as keep_id
  from d)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from g
"""

PERSPECTIVES = r"""
with t as (
  select conv_id, turn, coalesce(role, 'unknown') as speaker, coalesce(text, '') as text from conversations),
people as (select distinct conv_id, speaker as assistant from t where speaker <> 'system'),
s as (
  select t.conv_id, p.assistant, t.turn, t.speaker, t.text, t.speaker = p.assistant as mine,
    case when t.speaker = p.assistant then '<|im_start|>assistant' || chr(10)
         when t.speaker = 'system' then '<|im_start|>system' || chr(10)
         else '<|im_start|>user name=' || t.speaker || chr(10) end || t.text || '<|im_end|>' || chr(10) as segment
  from t join people p on t.conv_id = p.conv_id),
placed as (
  select *, cast(coalesce(sum(length(segment)) over (partition by conv_id, assistant order by turn, speaker, text
    rows between unbounded preceding and 1 preceding), 0) as bigint) as start
  from s)
select conv_id, assistant, turn, speaker, segment, start, start + length(segment) as "end",
  case when mine then start + 22 end as mask_start, case when mine then start + length(segment) - 1 end as mask_end
from placed
"""

MIX = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size, md5('0:' || doc_id) as key from documents),
s as (
  select source, sum(size)::bigint as source_size, [3, 1, 2][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as weight
  from d group by source),
o as (
  select *, coalesce(sum(2 * source_size) over before, 0)::bigint as stopped, coalesce(sum(weight) over before, 0)::bigint as gone,
    sum(source_size) over ()::bigint as total, sum(weight) over ()::bigint as weights
  from s
  window before as (order by source_size::double / weight, source nulls last rows between unbounded preceding and 1 preceding)),
l as (select *, (1.5::double * total - stopped) / (weights - gone) as level from o),
f as (select *, max(case when level * weight <= 2 * source_size then level end) over () as final from l),
t as (select source, source_size, least(2.0::double * source_size, coalesce(final * weight, 2.0::double * source_size)) as target from f),
p as (
  select doc_id, source, size,
    coalesce(sum(size) over (partition by source order by key rows between unbounded preceding and 1 preceding), 0)::bigint as start
  from d),
q as (
  select source, source_size, floor(target)::bigint as whole, ceil(source_size / 256)::bigint as blocks,
    case when source_size > 0 then floor(target)::bigint // source_size else 0 end as rounds
  from t),
n as (select *, rounds * blocks + ceil((whole - rounds * source_size) / 256)::bigint as slots from q),
u as (
  select *, coalesce(sum(slots) over (order by source nulls last rows between unbounded preceding and 1 preceding), 0)::bigint as first,
    greatest(1, ceil(log2(greatest(2, sum(slots) over ()))))::int as bits
  from n),
j as (select *, unnest(range(first, first + slots)) as j from u where slots > 0),
v as (select *, list_sum([((j >> k) & 1) << (bits - 1 - k) for k in range(bits)])::bigint as position from j),
r as (select *, row_number() over (partition by source order by position) - 1 as rank from v),
b as (
  select source, position, (rank % blocks) * 256 as start,
    least(256, source_size - (rank % blocks) * 256, whole - (rank // blocks) * source_size - (rank % blocks) * 256) as words
  from r),
places as (
  select p.doc_id, count(*)::bigint as slots, min(position) as first_position, max(position) as last_position
  from p join b on p.source is not distinct from b.source and p.start < b.start + b.words and b.start < p.start + p.size
  where p.size > 0 and b.words > 0
  group by p.doc_id)
select p.doc_id, p.size::bigint as size, t.source_size, t.target, coalesce(places.slots, 0)::bigint as slots, coalesce(places.first_position, -1) as first_position,
  coalesce(places.last_position, -1) as last_position,
  (greatest(0, least(p.start + p.size, floor(t.target)::bigint) - p.start)
   + greatest(0, least(p.start + p.size + t.source_size, floor(t.target)::bigint) - p.start - t.source_size))::bigint as taken
from p join t on p.source is not distinct from t.source left join places on places.doc_id = p.doc_id
"""

LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR = rf"""
with recursive w as materialized (select doc_id, regexp_extract_all({LOW}, '[^\x20\x09-\x0D]+') as w from documents),
x as materialized (
  select distinct doc_id, unnest(case when len(w) < 2 then [w[1]] else list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]) end) as shingle
  from w where len(w) > 0),
n as (select doc_id, count(*) as n from x group by doc_id),
common as (select a.doc_id as u, b.doc_id as v, count(*) as c from x a join x b on a.shingle = b.shingle and a.doc_id < b.doc_id group by all),
links as materialized (
  select u, v from common join n a on a.doc_id = u join n b on b.doc_id = v where 100 * c >= 80 * (a.n + b.n - c)),
both_ways as materialized (select u, v from links union all select v, u from links),
reached(doc_id, other) as (select doc_id, doc_id from documents union select r.doc_id, e.v from reached r join both_ways e on r.other = e.u),
c as (select doc_id, min(other) as component_id from reached group by doc_id)
select c.doc_id, coalesce(n, 0) as n_shingles, component_id, c.doc_id = component_id as kept from c left join n on n.doc_id = c.doc_id
"""

AUDIT = r"""
with t as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
    min(doc_id) over (partition by coalesce(text, '')) as first_id
  from documents),
m as (
  select t.doc_id, part, coalesce(quality = 1, false) as good, coalesce(toxic = 1, false) as toxic,
    case when len(w) < 200 then 'A' else '' end
    || case when 100 * len(list_distinct(w)) < 50 * len(w) then 'B' else '' end
    || case when 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) then 'C' else '' end
    || case when regexp_matches(text, '[#$%&*|]') then 'D' else '' end
    || case when t.doc_id > first_id then 'E' else '' end as fails
  from t left join labels l on t.doc_id = l.doc_id),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as f),
orders as (
  select a.f || b.f || c.f || d.f || e.f as filter_order from letters a, letters b, letters c, letters d, letters e
  where len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps as (select filter_order, unnest([1, 2, 3, 4, 5])::int as step from orders),
s as (select *, filter_order[step] as own, filter_order[1:step - 1] as before from steps),
counts as (select part, fails, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic from m group by all),
j as (
  select c.part, s.*, c.n, c.good, c.toxic, fails,
    contains(fails, own) as mine, before <> '' and fails <> '' and regexp_matches(fails, '[' || before || '0]') as earlier
  from counts c, s),
r as (
  select part, filter_order, step, own,
    coalesce(sum(n) filter (not mine and not earlier), 0)::bigint as kept,
    coalesce(sum(n) filter (mine and not earlier), 0)::bigint as removed,
    coalesce(sum(n) filter (mine and earlier), 0)::bigint as redundant,
    coalesce(sum(n) filter (fails = own), 0)::bigint as unique_fails,
    coalesce(sum(good) filter (mine and not earlier), 0)::bigint as good_lost,
    coalesce(sum(toxic) filter (mine and not earlier), 0)::bigint as toxic_lost
  from j group by all)
select * exclude (own), sum(removed) over (partition by part, own)::bigint as shapley from r
"""

PHRASES = rf"""
with p as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array({LOW}, '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as materialized (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from p),
totals as (select lang, sum(len(w))::bigint as n from w group by lang),
grams as (
  select lang, 1 as words, unnest(w) as phrase from w
  union all select lang, 2, unnest(list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) from w where len(w) > 1
  union all select lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2])) from w where len(w) > 2),
f as materialized (select lang, words, phrase, count(*)::bigint as f from grams group by all having count(*) >= 10),
c as (select *, string_split(phrase, ' ') as w from f where words > 1),
around as (
  select lang, phrase, max(f) as around from (
    select lang, f, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) as phrase from c where words = 3) group by all),
kept as (select c.* from c left join around r on c.lang = r.lang and c.phrase = r.phrase where words = 3 or around is null or 100 * around < 50 * c.f),
cuts as (
  select lang, phrase, f as a, unnest(range(1, words)) as k, w from kept),
sides as (select lang, phrase, a, k, array_to_string(w[1:k], ' ') as lft, array_to_string(w[k + 1:], ' ') as rgt from cuts),
scored as (
  select s.lang, s.phrase, s.a, k, x.f as l, y.f as r, ((1000000::hugeint * a * a) // (x.f::hugeint * y.f))::bigint as score
  from sides s join f x on x.lang = s.lang and x.phrase = lft join f y on y.lang = s.lang and y.phrase = rgt),
lowest as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from lowest)
select ranked.lang, rank, phrase, a, l, r, n, score from ranked join totals on ranked.lang = totals.lang where rank <= 2000
"""

SQL = {
    "op1_exact_dedup": EXACT, "op6_perspectives": PERSPECTIVES, "op9_mixing": MIX, "op11_superminhash": NEAR, "op12_filter_audit": AUDIT,
    "op13_collocations": PHRASES,
}
