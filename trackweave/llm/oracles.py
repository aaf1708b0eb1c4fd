"""SQL counterparts of the corpus queries that SQL can express, for DuckDB over the same tables."""

from __future__ import annotations

from trackweave.llm import chat, embedding_dedup, ngram_join, resampling, spelling, suffix_dedup

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _components(node: str, pairs: str) -> str:
    """``reach`` (node, other): everything that a node reaches over ``pairs`` (a, b), both ways."""
    return f"""both_ways as (select a, b from {pairs} union select b, a from {pairs}),
  reach as (
    select {node} as node, {node} as other from nodes
    union
    select reach.node, both_ways.b from reach join both_ways on reach.other = both_ways.a)"""


OP2 = f"""with recursive worded as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') as w from documents),
  shingles as (
    select distinct doc_id, array_to_string(w[i:i + {ngram_join.WORDS - 1}], ' ') as s
    from (select doc_id, w, unnest(range(1, greatest(len(w) - {ngram_join.WORDS - 2}, 2))) as i from worded where len(w) > 0)),
  nodes as (select d.doc_id, count(s) as n from documents d left join shingles on shingles.doc_id = d.doc_id group by d.doc_id),
  common as (
    select x.doc_id as a, y.doc_id as b, count(*) as both_have from shingles x join shingles y on x.s = y.s and x.doc_id < y.doc_id group by x.doc_id, y.doc_id),
  links as (
    select a, b from common join nodes m on m.doc_id = a join nodes n on n.doc_id = b
    where {ngram_join.DEN} * both_have >= {ngram_join.NUM} * (m.n + n.n - both_have)),
  {_components("doc_id", "links")}
select nodes.doc_id, n as n_shingles, min(other) as component_id from nodes join reach on reach.node = nodes.doc_id group by nodes.doc_id, n"""

OP4 = f"""with recursive usable as (
    select vec_id, cast(embedding as double[]) as v from embeddings where embedding is not null and len(embedding) > 0 and list_count(embedding) = len(embedding)),
  sized as (select vec_id, v, len(v) as dims, sqrt(list_dot_product(v, v)) as size from usable where isfinite(list_sum(v))),
  sound as (select * from sized where size > 0),
  links as (
    select x.vec_id as a, y.vec_id as b from sound x join sound y on x.vec_id < y.vec_id and x.dims = y.dims
    where list_dot_product(x.v, y.v) / (x.size * y.size) >= {embedding_dedup.COSINE}),
  nodes as (select vec_id from embeddings),
  {_components("vec_id", "links")},
  counted as (select a, count(*) as n from both_ways group by a)
select nodes.vec_id, coalesce(max(n), 0) as n_links, min(other) as component_id, nodes.vec_id = min(other) as kept
from nodes join reach on reach.node = nodes.vec_id left join counted on counted.a = nodes.vec_id group by nodes.vec_id"""


#: Bytes as hexadecimal digits, two a byte.
OP6 = f"""with raw as (select doc_id, hex(coalesce(text, '')) as h, length(hex(coalesce(text, ''))) // 2 as n from documents),
  strings as (
    select doc_id, i, substr(h, 2 * i + 1, {2 * suffix_dedup.LEAST}) as s
    from (select doc_id, h, unnest(range(0, n - {suffix_dedup.LEAST - 1})) as i from raw where n >= {suffix_dedup.LEAST})),
  later as (select doc_id, i from strings qualify row_number() over (partition by s order by doc_id, i) > 1),
  marked as (
    select doc_id, i, case when i <= lag(i) over (partition by doc_id order by i) + {suffix_dedup.LEAST} then 0 else 1 end as fresh from later),
  numbered as (select doc_id, i, sum(fresh) over (partition by doc_id order by i) as span from marked),
  spans as (select doc_id, span, min(i) as first, max(i) + {suffix_dedup.LEAST} as last from numbered group by doc_id, span),
  between_ as (
    select spans.*, coalesce(lag(last) over (partition by spans.doc_id order by span), 0) as before, h from spans join raw on raw.doc_id = spans.doc_id),
  kept as (
    select doc_id, count(*) as n_spans, sum(last - first) as removed, max(last) as ends,
      string_agg(substr(h, 2 * before + 1, 2 * (first - before)), '' order by span) as pieces
    from between_ group by doc_id)
select raw.doc_id, n as n_bytes, cast(coalesce(removed, 0) as bigint) as n_removed, coalesce(n_spans, 0) as n_spans,
  sha256(unhex(coalesce(pieces, '') || substr(h, 2 * coalesce(ends, 0) + 1))) as kept_sha256
from raw left join kept on kept.doc_id = raw.doc_id"""


#: The whole queue of copies in one order, as the rules say it.
OP7 = """with raw as (
    select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as size,
      md5('7919:' || coalesce(cast(doc_id as varchar), '') || ':' || md5(coalesce(text, ''))) as key from documents),
  sources as (select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source is null, source) - 1 as place from raw group by source),
  weighed as (
    select *, 3 * source_size as most, case place % 3 when 0 then 5e0 when 1 then 2e0 else 1e0 end as w, cast(sum(source_size) over () as double) as budget from sources),
  filled as (
    select *, (budget - coalesce(sum(most) over (order by most / w, place rows between unbounded preceding and 1 preceding), 0))
      / sum(w) over (order by most / w, place rows between current row and unbounded following) as level from weighed),
  levelled as (select *, level * w > most as fills from filled),
  goals as (
    select source, source_size, place, budget,
      case when fills then cast(most as double) else w * (select arg_min(level, (most / w, place)) from levelled where not fills) end as target from levelled),
  queue as (
    select r.doc_id, r.source, size, source_size, target, place, budget, row_number() over () as item,
      cast(sum(size) over (partition by r.source order by key rows unbounded preceding) as bigint) as upto
    from raw r join goals g on r.source is not distinct from g.source),
  copies as (
    select item, size, place, budget, cast(e * source_size + upto as double) / target as time from queue, range(3) t(e) where size > 0 and target > 0),
  ordered as (select *, cast(sum(size) over (order by time, place rows unbounded preceding) as bigint) as total from copies),
  edge as (select arg_min(time, total) as time, arg_min(place, total) as place, min(total) as total, arg_min(size, total) as size, any_value(budget) as budget from ordered where total > budget),
  taken as (
    select item, count(*) as n from ordered o left join edge on true
    where edge.time is null or o.time < edge.time or (o.time = edge.time and (o.place < edge.place or (o.place = edge.place and edge.total - edge.budget < edge.budget - (edge.total - edge.size))))
    group by item)
select doc_id, cast(size as bigint) as size, source_size, target, cast(size * coalesce(n, 0) as bigint) as taken from queue left join taken on taken.item = queue.item"""


#: The tree level by level, every raw template carrying the sums of its child, its pool and its node along.
OP3 = """with recursive parts as (
    select page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
      coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') as path from pages),
  named as (
    select *, array_to_string(list_transform(string_split(path, '/'), lambda s: case
        when regexp_full_match(s, '[0-9]+([.][A-Za-z]{1,5})?') then '{n}' || regexp_replace(s, '^[0-9]+', '')
        when regexp_full_match(s, '[a-f0-9]{8,}([.][A-Za-z]{1,5})?') and regexp_matches(split_part(s, '.', 1), '[0-9]') then '{h}' || regexp_replace(s, '^[a-f0-9]+', '')
        else s end), '/') as raw,
      try_cast(nullif(regexp_extract(path, '([0-9]+)[^/0-9]*$', 1), '') as bigint) as number from parts),
  known as (select doc_id as number, max(quality) as quality from labels where quality in (0, 1) group by doc_id),
  leaves as (
    select host, raw, case when raw = '' then [] else string_split(substr(raw, 2), '/') end as segments, count(distinct path) as urls,
      count(quality) as seen, count(case when quality = 1 then 1 end) as good
    from named left join known on known.number = named.number group by host, raw),
  tree as (
    select 0 as level, '' as template, * from leaves
    union all
    select level + 1, case when here is null then template
        when variable or alike > 1 then case
          when k_seen > 0 and power(k_good / k_seen::double - share, 2) * k_seen > 9 * share * (1 - share) then template || '/' || here
          when variable then template || '/*' else template || '/' || kind end
        else template || '/' || here end,
      host, raw, segments, urls, seen, good
    from (
      select *, case when variable then (n_good + 1)::double / (n_seen + 2) else (p_good + 1)::double / (p_seen + 2) end as share
      from (
        select *, children > 50 and max(case when here is not null then k_urls end) over node * 10 < n_urls as variable, count(distinct here) over pool as alike,
          sum(case when here is not null then seen end) over pool as p_seen, sum(case when here is not null then good end) over pool as p_good
        from (
          select *, case when k_seen = 0 then '*new' when k_good / k_seen::double < 0.5e0 then '*low' else '*' end as kind
          from (
            select *, sum(seen) over child as k_seen, sum(urls) over child as k_urls, sum(good) over child as k_good, count(distinct here) over node as children,
              sum(case when here is not null then urls end) over node as n_urls, sum(case when here is not null then seen end) over node as n_seen,
              sum(case when here is not null then good end) over node as n_good
            from (select *, segments[level + 1] as here from tree where level < (select max(len(segments)) from leaves)) t
            window child as (partition by host, template, here), node as (partition by host, template)) k) p
        window pool as (partition by host, template, kind), node as (partition by host, template)) q) r),
  done as (select * from tree where level = (select max(len(segments)) from leaves)),
  whole as (select coalesce(sum(good) / nullif(sum(seen), 0)::double, 1e0) as base from done),
  hosts as (select host, (sum(good) + 4 * base) / (sum(seen) + 4) as at_host from done, whole group by host, base),
  pure as (
    select d.host, template, (sum(good) + 4 * at_host) / (sum(seen) + 4) as purity from done d join hosts on hosts.host = d.host group by d.host, template, at_host),
  rules as (
    select * from (values ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')) r(act, h, p)),
  ruled as (
    select page_id, arg_max(h || p, len(h || p)) as rule, arg_max(act, len(h || p)) as act
    from named join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by page_id)
select n.page_id, n.host, n.path, rule, coalesce(act, case when purity < 0.5e0 then 'block' else 'allow' end) as verdict, d.template, round(purity, 6) as purity
from named n join done d on d.host = n.host and d.raw = n.raw join pure v on v.host = d.host and v.template = d.template left join ruled on ruled.page_id = n.page_id"""


def _crc_step(c: int) -> int:
    for _ in range(4):
        c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
    return c


def _crc32(text: str) -> str:
    """The CRC-32 of a text's UTF-8 bytes, a hexadecimal digit at a time, the lower one of a byte first."""
    steps = "[" + ", ".join(str(_crc_step(i)) for i in range(16)) + "]"
    digit = f"(instr('0123456789ABCDEF', substr(hex({text}), 2 * (i // 2) + 2 - i % 2, 1)) - 1)"
    digits = f"list_transform(range(length(hex({text}))), lambda i: cast({digit} as bigint))"
    return f"xor(list_reduce({digits}, lambda c, d: xor(c // 16, list_extract({steps}, cast(xor(c, d) & 15 as integer) + 1)), cast(4294967295 as bigint)), 4294967295)"


OP11 = f"""with texts as (
    select row_number() over () as item, 0 as goal, doc_id, text from documents union all select 0, 1, null, text from benchmark),
  spoken as (
    select item, goal, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from texts),
  said as (select item, goal, unnest(w) as word from spoken),
  hashed as (select word, {_crc32("word")} % {resampling.BUCKETS} as bucket from (select distinct word from said)),
  met as (select item, goal, bucket from said join hashed on hashed.word = said.word),
  counted as (select bucket, count(case when goal = 0 then 1 end) as s, count(case when goal = 1 then 1 end) as t from met group by bucket),
  sums as (select sum(s) as all_s, sum(t) as all_t from counted),
  gained as (
    select bucket, cast(floor(1000 * ln(cast((t + 1) * (all_s + {resampling.BUCKETS}) as double) / cast((s + 1) * (all_t + {resampling.BUCKETS}) as double))) as bigint) as gain from counted, sums),
  weighed as (select item, sum(gain) as gain from met join gained on gained.bucket = met.bucket where goal = 0 group by item),
  scored as (
    select s.item, doc_id, cast(len(w) as bigint) as n_features, coalesce(cast(floor(gain::double / nullif(len(w), 0)) as bigint), 0) as weight,
      cast('0x' || substr(sha256('{resampling.SEED}:' || coalesce(cast(doc_id as varchar), '')), 1, 8) as bigint) as h
    from spoken s left join weighed on weighed.item = s.item where goal = 0),
  rated as (select *, weight + cast(floor(-1000e0 * ln(-ln((h + 0.5e0) / 4294967296e0))) as bigint) as score from scored),
  able as (select item, row_number() over (order by score desc, doc_id nulls last, n_features, item) as place, count(*) over () as n from rated where n_features >= {resampling.LEAST_WORDS})
select doc_id, n_features, weight, score, case when place <= n * 10 // 100 then place end as rank from rated left join able on able.item = rated.item"""

#: Words one edit apart share what is left of them without one letter, at one place, or one is the other without a letter.
OP12 = f"""with recursive runs as (
    select coalesce(cast(doc_id as varchar), '') as d, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), '{_UPPER}', '{_LOWER}') as w from documents),
  each_ as (select d, w, count(*) as n from runs group by d, w),
  hashed as (select w, n, {_crc32("d || ':' || w")} as h from each_),
  typed as (select n, case when h % {spelling.TYPO} = 0 then substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) else w end as w from hashed),
  words as (select w as word, cast(sum(n) as bigint) as n from typed where length(w) >= {spelling.LEAST_LENGTH} group by w having sum(n) >= {spelling.LEAST_COUNT}),
  less as (select word, n, i, substr(word, 1, i) || substr(word, i + 2) as rest from (select word, n, unnest(range(length(word))) as i from words)),
  near as (
    select x.word, y.word as other, y.n as other_n from less x join less y on x.i = y.i and x.rest = y.rest and x.word <> y.word
    union select x.word, y.word, y.n from less x join words y on y.word = x.rest
    union select y.word, x.word, x.n from less x join words y on y.word = x.rest),
  best as (select word, count(*) as n_near, arg_min(other, (-other_n, other)) as other, max(other_n) as other_n from near group by word),
  formed as (
    select w.word, n, coalesce(n_near, 0) as n_near, case when other_n >= {spelling.RATIO} * n then other end as form, case when other_n >= {spelling.RATIO} * n then other_n end as form_n
    from words w left join best on best.word = w.word),
  walk as (
    select word, word as spot, 0 as step from formed union all select walk.word, form, step + 1 from walk join formed on formed.word = walk.spot where form is not null),
  ends as (select word, arg_max(spot, step) as root from walk group by word)
select f.word, form, root, n, n_near, form_n from formed f join ends on ends.word = f.word"""

_ESC = lambda x: f"regexp_replace({x}, '([[<])(\\\\*)(/?(?:INST\\]|s>))', '\\1\\2\\\\\\3', 'g')"

OP13 = f"""with rows_ as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
  placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as place from rows_),
  beside as (select *, lag(role) over w as before, lead(role) over w as after from placed window w as (partition by conv_id order by place)),
  pieces as (
    select *, case when before = role then '{chat.MORE}' else '{chat.OPEN}' || {_ESC("role")} || '{chat.CLOSE}' end || {_ESC("text")} || case when after = role then '' else '{chat.END}' end as piece from beside)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by place)) as turns_sha256,
  cast(coalesce(sum(case when role = '{chat.LOSS}' then length(text) end), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(case when role = '{chat.LOSS}' then text end, '' order by place), '')) as loss_sha256, cast(sum(length(piece)) as bigint) as formatted_chars
from pieces group by conv_id"""


ORACLES = {"op2_ngram_join": OP2, "op3_url_filters": OP3, "op4_embedding_dedup": OP4, "op6_suffix_dedup": OP6, "op7_mixing": OP7, "op11_resampling": OP11, "op12_spelling": OP12, "op13_chat": OP13}
