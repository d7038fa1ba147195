"""DuckDB SQL of the corpus queries that SQL can express, over whole tables."""

from __future__ import annotations

from .dartminhash import THRESHOLD, WORDS
from .ngram import PERCENT
from .ngram import WORDS as GRAM
from .substring import WINDOW
from .suffix import WINDOW as BYTES

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SUBSTRING = f"""
with w as (select row_number() over () as r, doc_id, {_WORDS} as ws from documents),
  win as (select r, s, array_to_string(ws[s : s + {WINDOW - 1}], ' ') as k from (select r, ws, unnest(range(1, len(ws) - {WINDOW - 2})) as s from w)),
  again as (select k from win group by k having count(*) > 1),
  gone as (select distinct r, s + i as p from win join again using (k), range({WINDOW}) t(i)),
  every as (select r, unnest(range(1, len(ws) + 1)) as p, unnest(ws) as word from w),
  kept as (select e.r, count(g.p) as n_removed, coalesce(string_agg(e.word, ' ' order by e.p) filter (g.p is null), '') as kept from every e left join gone g on g.r = e.r and g.p = e.p group by e.r)
select w.doc_id, len(ws)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from w left join kept using (r)
"""

SUFFIX = f"""
with w as (select row_number() over () as r, doc_id, hex(encode(coalesce(text, ''))) as h from documents),
  win as (select r, doc_id, s, substr(h, 2 * s - 1, {2 * BYTES}) as k from (select r, doc_id, h, unnest(range(1, len(h) // 2 - {BYTES - 2})) as s from w)),
  first as (select k, min(doc_id) as least from win group by k),
  gone as (select distinct r, s + i as p from (select r, s from win join first using (k) where least < doc_id), range({BYTES}) t(i)),
  every as (select r, p, substr(h, 2 * p - 1, 2) as b from (select r, h, unnest(range(1, len(h) // 2 + 1)) as p from w)),
  marked as (select e.r, e.p, e.b, g.p is not null as gone, lag(g.p is not null, 1, false) over (partition by e.r order by e.p) as before from every e left join gone g on g.r = e.r and g.p = e.p),
  kept as (select r, count_if(gone) as n_removed, count_if(gone and not before) as n_spans, coalesce(string_agg(b, '' order by p) filter (not gone), '') as kept from marked group by r)
select w.doc_id, (len(h) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(coalesce(kept, ''))) as kept_sha256 from w left join kept using (r)
"""

#: The k-th occurrence of a shingle in a text is an element of its own, so set similarity of these is weighted similarity.
NEAR_DUPLICATES = f"""
with recursive t as (select doc_id, text, {_WORDS} as ws from documents),
  u as (select text, min(doc_id) as rep, any_value(ws) as ws from t where len(ws) > 0 group by text),
  s as (select rep, unnest(case when len(ws) < {WORDS} then [array_to_string(ws, ' ')] else list_transform(range(1, len(ws) - {WORDS - 2}), lambda i: array_to_string(ws[i : i + {WORDS - 1}], ' ')) end) as g from u),
  e as (select rep, hash(g, n) as x from (select rep, g, row_number() over (partition by rep, g) as n from s)),
  size as (select rep, count(*) as n from e group by rep),
  shared as (select a.rep as a, b.rep as b, count(*) as c from e a join e b on a.x = b.x and a.rep < b.rep group by all),
  link as (select a, b from shared join size x on x.rep = a join size y on y.rep = b where c >= {THRESHOLD} * (x.n + y.n - c) - 1e-9),
  sym as (select a, b from link union all select b, a from link),
  reach as (select rep as a, rep as b from u union select r.a, y.b from reach r join sym y on y.a = r.b),
  class as (select a as rep, min(b) as class_id from reach group by a)
select t.doc_id, coalesce(c.class_id, t.doc_id) as class_id from t left join u on u.text = t.text left join class c on c.rep = u.rep
"""

JACCARD = f"""
with recursive t as (select doc_id, {_WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as ws from documents),
  g as (select doc_id, list_sort(list_distinct(case when len(ws) = 0 then [] when len(ws) < {GRAM} then [array_to_string(ws, ' ')] else list_transform(range(1, len(ws) - {GRAM - 2}), lambda i: array_to_string(ws[i : i + {GRAM - 1}], ' ')) end)) as s from t),
  u as (select s, min(doc_id) as rep, len(s) as n from g where len(s) > 0 group by s),
  e as (select rep, unnest(list_transform(s, lambda x: hash(x))) as x from u),
  shared as (select a.rep as a, b.rep as b, count(*) as c from e a join e b on a.x = b.x and a.rep < b.rep group by all),
  link as (select a, b from shared join u x on x.rep = a join u y on y.rep = b where 100 * c >= {PERCENT} * (x.n + y.n - c)),
  sym as (select a, b from link union all select b, a from link),
  reach as (select rep as a, rep as b from u union select r.a, y.b from reach r join sym y on y.a = r.b),
  class as (select a as rep, min(b) as least from reach group by a)
select g.doc_id, len(g.s)::bigint as n_shingles, coalesce(c.least, g.doc_id) as component_id from g left join u on u.s = g.s left join class c on c.rep = u.rep
"""

_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_BASE32 = " || ".join(f"substr('{_ALPHABET}', (((('0x' || substr(h, {5 * i + 1}, 5))::bigint >> {15 - 5 * j}) & 31) + 1)::int, 1)" for i in range(8) for j in range(4))

WARC = f"""
with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as h from pages),
  g as (select html, max(page_id) as first from p group by html)
select page_id, octet_length(encode(html))::bigint as payload_bytes, {_BASE32} as payload_digest, case when page_id is not distinct from first then 'response' else 'revisit' end as record_type, case when page_id is distinct from first then first end as refers_to from p join g using (html)
"""
