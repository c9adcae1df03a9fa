"""DuckDB SQL for the training-data queries that SQL can express, over the same tables."""

from __future__ import annotations

from . import chat

_WORD = r"[^\x20\x09-\x0D]+"

#: Records with equal payloads: the largest page_id is the response.  A digest's 40 hexadecimal digits are
#: eight groups of 20 bits, and each of those four characters of base32.
WARC = """with p as (select page_id, coalesce(html, '') as h, sha1(coalesce(html, '')) as hex from pages),
d as (select *, list_transform(range(8), lambda g: ('0x' || substr(hex, cast(g * 5 + 1 as bigint), 5))::int) as v, max(page_id) over (partition by h) as last from p)
select page_id, cast(octet_length(encode(h)) as bigint) as payload_bytes,
  list_aggregate(list_transform(flatten(list_transform(v, lambda x: [x >> 15, (x >> 10) & 31, (x >> 5) & 31, x & 31])), lambda c: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', c + 1, 1)), 'string_agg', '') as payload_digest,
  case when page_id = last then 'response' else 'revisit' end as record_type, case when page_id <> last then last end as refers_to from d"""

#: Sets of three-word shingles, their pairs by common shingles, and the least document reachable.
NEARDUP = f"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') as w from documents),
s as (select doc_id, case when len(w) >= 3 then list_distinct(list_transform(range(1, len(w) - 1), lambda k: array_to_string(w[k:k + 2], ' '))) when len(w) > 0 then [array_to_string(w, ' ')] else [] end as s from w),
sizes as (select doc_id, cast(len(s) as bigint) as n from s),
each as materialized (select doc_id, unnest(s) as x from s),
common as (select a.doc_id as a, b.doc_id as b, count(*) as c from each a join each b on a.x = b.x and a.doc_id < b.doc_id group by all),
links as materialized (select a, b from common join sizes p on p.doc_id = a join sizes q on q.doc_id = b where 100 * c >= 85 * (p.n + q.n - c)),
both_ as materialized (select a, b from links union all select b, a from links),
reach(a, b) as (select doc_id, doc_id from sizes union select reach.a, both_.b from reach join both_ on reach.b = both_.a)
select doc_id, n as n_shingles, min(b) as component_id, doc_id = min(b) as kept from sizes join reach on a = doc_id group by doc_id, n"""


def _escaped(text: str) -> str:
    text = rf"replace({text}, '\', '\b')"
    for sign in "<[":
        for rest in ("|", "s>", "/s>", "<SYS>>", "</SYS>>", "INST]", "/INST]"):
            text = rf"replace({text}, '{sign}{rest}', '{sign}\p{rest}')"
    return text


_ROLE = f"replace({_escaped('role')}, chr(10), '\\l')"
_MARKS = len(chat.TURN) + len(chat.END) + 1

#: Windows: every turn once in its own, and again as history where it lies close before one.
CHAT = rf"""with recursive every as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select * from (values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))),
t as (select *, row_number() over (partition by conv_id order by turn, role, text) as spot, len(regexp_extract_all(text, '[\p{{L}}\p{{N}}\p{{M}}]+|[^\s\p{{L}}\p{{N}}\p{{M}}]')) + {chat.MARKS} as size,
  {_MARKS} + length({_ROLE}) + length({_escaped('text')}) as chars from every),
u as (select *, first_value(role = 'system') over w as has_system, first_value(size) over w as first_size from t window w as (partition by conv_id order by spot)),
own as materialized (select *, case when has_system then spot - 1 else spot end as place, greatest({chat.BUDGET - chat.HISTORY} - case when has_system then first_size else 0 end, {max(1, chat.BUDGET // 4)}) as room,
  sum(size) over (partition by conv_id order by spot) - size - case when has_system then first_size else 0 end as start from u where not (has_system and spot = 1)),
g(conv_id, place, used, opens) as (select conv_id, 1::bigint, size::hugeint, true from own where place = 1
  union all select o.conv_id, o.place, case when g.used + o.size > o.room then o.size else g.used + o.size end, g.used + o.size > o.room from g join own o on o.conv_id = g.conv_id and o.place = g.place + 1),
opening as (select o.conv_id, o.start, g.place from g join own o using (conv_id, place) where g.opens),
again as (select o.conv_id, sum(o.chars) as chars from own o join opening p on p.conv_id = o.conv_id and p.start - o.start between 1 and {chat.HISTORY} and (p.place > 1 or not o.has_system) group by o.conv_id),
systems as (select u.conv_id, u.chars * count(*) as chars from u join opening p on p.conv_id = u.conv_id and p.place > 1 where u.has_system and u.spot = 1 group by u.conv_id, u.chars)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by spot)) as turns_sha256,
  cast(length(coalesce(string_agg(text, '' order by spot) filter (where role = 'assistant'), '')) as bigint) as loss_chars, sha256(coalesce(string_agg(text, '' order by spot) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(chars) + coalesce(any_value(a), 0) + coalesce(any_value(s), 0) as bigint) as formatted_chars
from u left join (select conv_id, chars as a from again) using (conv_id) left join (select conv_id, chars as s from systems) using (conv_id) group by conv_id"""

ORACLES = {"op3_chat_windows": CHAT, "op7_minhash_neardup": NEARDUP, "op8_seekable_warc": WARC}
