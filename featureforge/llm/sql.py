"""SQL of the queries that SQL can express, for DuckDB."""

DEDUP = r"""
with t as (
    select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as body from documents
), g as (
    select doc_id, sha256(body) as text_sha256,
           min(doc_id) over (partition by body) as keep_id, count(*) over (partition by body) as group_size
    from t
)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from g
"""


def _spans(kind: str, pattern: str, order: int, group: int = 0, least: int = 0) -> str:
    p = pattern.replace("'", "''")
    return f"""
    select doc_id, n, {order} as kind_order, '{kind}' as kind,
           (list_sum([length(x) for x in gaps[1:i + 1]]) + coalesce(list_sum([length(x) for x in found[1:i]]), 0))::bigint as start,
           length(found[i + 1]) as size
    from (
        select *, unnest(range(len(found))) as i from (
            select doc_id, n, regexp_extract_all(body, '{p}') as found, regexp_extract_all(body, '{p}', {group}) as parts,
                   regexp_split_to_array(body, '{p}') as gaps
            from t where regexp_matches(body, '{p}')
        )
    ) where length(parts[i + 1]) >= {least}
    """


# The patterns of the secret kinds.
SECRETS = f"""
with t as (
    select row_number() over () as n, doc_id, coalesce(text, '') as body from documents
), s as (
    {_spans("assign", '(?i)(password|passwd|secret|token|api_?key)["\']?\\x20*[:=]\\x20*["\']?([A-Za-z0-9+/_.=-]+)', 0, 2, 6)}
    union all {_spans("access", "AKIA[A-Z0-9]{16,}", 1)}
    union all {_spans("hex", "[0-9a-f]{24,}", 2)}
    union all {_spans("pem", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 3)}
), g as (
    select n, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access,
           count(*) filter (kind = 'hex') as n_hex,
           string_agg(kind || ':' || start || ':' || (start + size), ',' order by start, kind_order) filter (kind <> 'pem') as base,
           string_agg(kind || ':' || start || ':' || (start + size), ',' order by start, kind_order) as spans
    from s group by n
)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
       sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from t left join g using (n)
"""

# CRC-32 by bytes, with its table of 256 remainders computed; runs hold characters below U+0100 only.
VARIANTS = r"""
with crc as (
    select list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i)) as remainders
), runs as (
    select doc_id, run, count(*) as n from (
        select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) as run
        from documents
    ) group by all
), hashed as (
    select run, n, xor(list_reduce(
        flatten(list_transform(string_split(doc_id::varchar || ':' || run, ''),
                               lambda c: case when unicode(c) < 128 then [unicode(c)::bigint] else [195::bigint, unicode(c)::bigint - 64] end)),
        lambda c, b: xor(c >> 8, remainders[(xor(c, b) & 255) + 1]), 4294967295::bigint), 4294967295::bigint) as h
    from runs, crc
), words as (
    select word, sum(n)::bigint as n from (
        select case when h % 97 = 0 then left(run, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, n from hashed
    ) where length(word) >= 5 group by word having sum(n) >= 3
), cut as (
    select word, n, i, left(word, i - 1) || substr(word, i + 1) as rest from (select word, n, unnest(range(1, length(word) + 1)) as i from words)
), pairs as (
    select a.word, a.n, b.word as near, b.n as near_n from cut a join cut b on a.i = b.i and a.rest = b.rest and a.word <> b.word
    union select c.word, c.n, w.word, w.n from cut c join words w on c.rest = w.word
    union select w.word, w.n, c.word, c.n from cut c join words w on c.rest = w.word
), best as (
    select word, count(*) as n_near, first(near order by near_n desc, encode(near)) as form, max(near_n) as form_n from pairs group by word
), forms as (
    select word, n, coalesce(n_near, 0) as n_near, case when form_n >= 2 * n then form end as form, case when form_n >= 2 * n then form_n end as form_n
    from words left join best using (word)
), chains as (
    with recursive walk as (
        select word, word as at from words
        union all select walk.word, forms.form from walk join forms on forms.word = walk.at where forms.form is not null
    ) select walk.word, walk.at as root from walk join forms on forms.word = walk.at where forms.form is null
)
select word, form, root, n, n_near, form_n from forms join chains using (word)
"""

AUDIT = r"""
with t as (
    select doc_id, coalesce(lang, '') as part, coalesce(text, '') as body from documents
), w as (
    select *, regexp_extract_all(body, '[^\x20\x09-\x0D]+') as words from t
), f as (
    select part, len(words) < 200 as a, 100 * len(list_distinct(words)) < 50 * len(words) as b,
           100 * len(regexp_extract_all(body, '[A-Z]')) > 3 * length(body) as c, regexp_matches(body, '[#$%&*|]') as d,
           doc_id > min(doc_id) over (partition by body) as e,
           doc_id in (select doc_id from labels where quality = 1) as good, doc_id in (select doc_id from labels where toxic = 1) as toxic
    from w
), m as (
    select part, a::int + 2 * b::int + 4 * c::int + 8 * d::int + 16 * e::int as mask, count(*) as n,
           count(*) filter (good) as good, count(*) filter (toxic) as toxic
    from f group by all
), letters as (
    select unnest(range(5)) as i, unnest(['A', 'B', 'C', 'D', 'E']) as letter
), orders as (
    select [p.i, q.i, r.i, s.i, t.i] as o, p.letter || q.letter || r.letter || s.letter || t.letter as filter_order
    from letters p, letters q, letters r, letters s, letters t
    where len(list_distinct([p.i, q.i, r.i, s.i, t.i])) = 5
), steps as (
    select filter_order, unnest(range(1, 6)) as step, o from orders
), tests as (
    select filter_order, step::int as step, (1 << o[step])::int as own,
           coalesce(list_sum(list_transform(o[1:step - 1], lambda i: 1 << i)), 0)::int as before from steps
), found as (
    select part, filter_order, step, own,
           coalesce(sum(n) filter (mask & (own | before) = 0), 0)::bigint as kept,
           coalesce(sum(n) filter (mask & own <> 0 and mask & before = 0), 0)::bigint as removed,
           coalesce(sum(n) filter (mask & own <> 0 and mask & before <> 0), 0)::bigint as redundant,
           coalesce(sum(n) filter (mask = own), 0)::bigint as unique_fails,
           coalesce(sum(good) filter (mask & own <> 0 and mask & before = 0), 0)::bigint as good_lost,
           coalesce(sum(toxic) filter (mask & own <> 0 and mask & before = 0), 0)::bigint as toxic_lost
    from m, tests group by all
)
select * exclude (own), sum(removed) over (partition by part, own)::bigint as shapley from found
"""
