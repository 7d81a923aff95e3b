"""DuckDB SQL for the queries that SQL can express, over the whole tables."""

from __future__ import annotations

from revledger.llm import decontam, licenses, quality_rules, substring

_BLANK = r"'[\x20\x09-\x0D]+'"


def _words(column: str) -> str:
    return f"list_filter(string_split_regex(coalesce({column}, ''), {_BLANK}), lambda x: x <> '')"


# base32 of the hexadecimal SHA-1: each character is five bits, taken from
# the two hexadecimal digits that hold them
OP1 = """
with p as (
  select page_id, coalesce(html, '') as t, sha1(coalesce(html, '')) as h from pages
), b as (
  select page_id, t, list_transform(range(0, 32), lambda i: (
      (instr('0123456789abcdef', substr(h, (5 * i) // 4 + 1, 1)) - 1) * 16
      + greatest(instr('0123456789abcdef', coalesce(nullif(substr(h, (5 * i) // 4 + 2, 1), ''), '0')) - 1, 0)
    ) >> (3 - (5 * i) % 4)) as g from p
), d as (
  select page_id, strlen(t)::bigint as payload_bytes,
    list_aggregate(list_transform(g, lambda v: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v & 31) + 1)::int, 1)),
                   'string_agg', '') as payload_digest, t from b
), f as (select *, min(page_id) over (partition by t) as first from d)
select page_id, payload_bytes, payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type,
  case when page_id <> first then first end as refers_to, true as digest_ok from f
"""

OP6 = f"""
with recursive w as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), {_BLANK}), lambda x: x <> '') as words from documents
), s as (
  select distinct doc_id, unnest(case when len(words) = 0 then [] when len(words) < 3 then [words]
    else list_transform(range(1, len(words) - 1), lambda i: words[i:i + 2]) end) as shingle from w
), n as (select doc_id, count(*) as n from s group by doc_id),
common as (
  select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b using (shingle)
  where a.doc_id <> b.doc_id group by all
), links as (
  select a, b from common join n x on x.doc_id = a join n y on y.doc_id = b
  where 100 * c >= 85 * (x.n + y.n - c)
), reach(a, b) as (
  select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a
), comp as (select a, min(b) as m from reach group by a)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) as component_id,
  d.doc_id = least(d.doc_id, coalesce(m, d.doc_id)) as kept
from documents d left join n using (doc_id) left join comp on comp.a = d.doc_id
"""

OP7 = f"""
with w as (select doc_id, {_words('text')} as words from documents),
win as (
  select doc_id, words, unnest(range(1, len(words) - {substring.WINDOW - 2})) as i from w
), ranked as (
  select doc_id, i, row_number() over (partition by words[i:i + {substring.WINDOW - 1}] order by doc_id, i) as r
  from win
), gone as (
  select distinct doc_id, unnest(range(i, i + {substring.WINDOW})) as p from ranked where r > 1
), pos as (select doc_id, unnest(range(1, len(words) + 1)) as p, unnest(words) as word from w),
kept as (
  select doc_id, count(g.p) as n_removed, coalesce(string_agg(word, ' ' order by p) filter (g.p is null), '') as kept
  from pos left join gone g using (doc_id, p) group by doc_id
)
select doc_id, len(words)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed,
  sha256(coalesce(kept, '')) as kept_sha256 from w left join kept using (doc_id)
"""

_Q = quality_rules
OP9 = f"""
with w as (
  select doc_id, source, coalesce(text, '') as t, {_words('text')} as words from documents
), tri as (
  select doc_id, unnest(range(1, len(words) - 1)) as i,
    unnest(list_transform(range(1, len(words) - 1), lambda i: words[i:i + 2])) as k from w
), rep as (
  select doc_id, count(distinct p) as n_repeat_words from (
    select doc_id, unnest([i, i + 1, i + 2]) as p from (
      select doc_id, i, count(*) over (partition by doc_id, k) as c from tri) where c > 1) group by doc_id
), m as (
  select doc_id, source, len(words)::bigint as n_words,
    coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::bigint as word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
    length(t) - length(regexp_replace(t, '\\p{{Lu}}', '', 'g')) as n_upper,
    length(t) - length(regexp_replace(t, '\\p{{Ll}}', '', 'g')) as n_lower,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines
  from w
), r as (
  select *, coalesce(n_repeat_words, 0)::bigint as n_rep,
    (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines from m left join rep using (doc_id)
), b as (
  select *, list_filter([
    case when n_words < {_Q.MIN_WORDS} then 'short' end,
    case when 100 * n_rep > {int(100 * _Q.MAX_REPEATED)} * n_words then 'repeated' end,
    case when n_symbols > {_Q.MAX_SYMBOLS}::double * n_words then 'symbols' end,
    case when n_dup_lines >= {_Q.LEAST_DUP_LINES} and n_dup_lines > {_Q.MAX_DUP_LINES}::double * len(lines)
      then 'dup_lines' end,
    case when n_upper > {_Q.MAX_CAPITALS}::double * (n_upper + n_lower) then 'capitals' end],
    lambda x: x is not null) as broken from r
), h as (
  select source, count(*) as n, count(*) filter (len(broken) > 0) as f from b group by source
), pool as (select sum(f) / sum(n) as m, sum(n) as total, count(*) as hosts from h),
sp as (
  select m, (sum(n * (f / n - m) * (f / n - m)) - (any_value(hosts) - 1) * m * (1 - m)) / any_value(total) as between_
  from h, pool group by m
), pr as (
  select m, case when between_ > 0 then least({_Q.MAX_PRIOR_DOCS}, greatest(1.0, m * (1 - m) / between_ - 1))
    else {_Q.MAX_PRIOR_DOCS} end as wt from sp
), v as (select source, (f + wt * m) / (n + wt) > {_Q.MAX_HOST_RATE} as bad from h, pr)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_rep as n_repeat_words,
  list_contains(broken, 'short') or list_contains(broken, 'repeated') as base_failed,
  len(broken) = 0 and not bad as kept, array_to_string(broken, ',') as broken, bad as host_rejected
from b join v on b.source is not distinct from v.source
"""

_D = decontam


def _templates(table: str, key: str) -> str:
    name = _D.NAME_RULE[0]
    units = ", ".join(f"'{u}'" for u in _D.UNITS)
    punct = _D.PUNCTUATION.replace("'", "''")
    return f"""select {key}, words, list_transform(words, lambda x, i: case when x < chr(3) then '{_D.NAME}'
      when regexp_full_match(x, '[0-9]+') then '{_D.NUMBER}'
      when x in ({units}) and i > 1 and regexp_full_match(words[i - 1], '[0-9]+') then '{_D.UNIT}'
      else x end) as canon from (
    select {key}, list_filter(string_split_regex(regexp_replace(lower(regexp_replace(coalesce(text, ''),
      '{name}', concat('\\1', chr(2), '\\2'), 'g')), '{punct}', '', 'g'), '[\\x09-\\x0D\\x20]+'),
      lambda x: x <> '') as words from {table} where {key} is not null)"""


_HOLDERS = f"('{_D.NUMBER}', '{_D.NAME}', '{_D.UNIT}')"


def _window_keys(source: str, columns: str) -> str:
    """Windows of ``source`` (words, canon, size, i from 1): the template, or
    the words themselves when few of them are literal."""
    return f"""select {columns}, size, i - 1 as pos,
    case when len(list_filter(c, lambda x: x in {_HOLDERS})) <= size - least({_D.LEAST_LITERAL}, size)
      then list_prepend('t', c) else list_prepend('w', w) end as k,
    list_filter(list_transform(w, lambda x, j: case when c[j] in {_HOLDERS} then x end), lambda x: x is not null) as slots
  from (select *, words[i:i + size - 1] as w, canon[i:i + size - 1] as c from {source})"""


OP10 = f"""
with d as ({_templates('documents', 'doc_id')}), b as ({_templates('benchmark', 'item_id')}),
bw as (
  select item_id, len(words) as item_words, least(len(words), {_D.WINDOW}) as size, words, canon,
    unnest(range(1, len(words) - least(len(words), {_D.WINDOW}) + 2)) as i from b where len(words) >= 2
), bk as ({_window_keys('bw', 'item_id, item_words')}), sizes as (select distinct size from bk),
dw as (select doc_id, words, canon, size, unnest(range(1, len(words) - size + 2)) as i from d, sizes),
dk as ({_window_keys('dw', 'doc_id')}),
pairs as (
  select distinct doc_id, item_id, item_words, size, bk.pos as ipos, dk.pos as dpos, bk.slots as islots, dk.slots as dslots
  from dk join bk using (size, k)
), parted as (
  select *, dpos - ipos as diagonal, unnest([
    {{'kind': 0, 'number': dpos - ipos}},
    {{'kind': 1, 'number': dpos // (item_words * {_D.REGION})}},
    {{'kind': 2, 'number': (dpos + item_words * {_D.REGION} // 2) // (item_words * {_D.REGION})}}]) as part from pairs
), supported as (
  select *, count(*) over (partition by doc_id, item_id, part, diagonal) as support from parted
), chosen as (
  select * from supported
  qualify row_number() over (partition by doc_id, item_id, part, ipos order by support desc, dpos) = 1
), cover as (
  select doc_id, item_id, part, any_value(item_words) as item_words, count(distinct p) as n_covered from (
    select doc_id, item_id, part, item_words, unnest(range(ipos, ipos + size)) as p from chosen) group by all
), slots as (
  select distinct doc_id, item_id, part, z[1] as s, z[2] as t from (
    select doc_id, item_id, part, unnest(list_zip(islots, dslots)) as z from chosen)
), counted as (
  select doc_id, item_id, part, count(*) as n, count(*) filter (s <> t) as changed, count(distinct s) as ns,
    count(distinct t) as nt from slots group by all
), o as (
  select c.*, coalesce(n, 0)::bigint as n_slots, coalesce(changed, 0)::bigint as n_changed,
    coalesce(n, 0) = coalesce(ns, 0) and coalesce(n, 0) = coalesce(nt, 0) as consistent
  from cover c left join counted using (doc_id, item_id, part)
), judged as (
  select *, consistent and n_covered >= {_D.LEAK_SHARE} * item_words as leak from o
), best as (
  select * from judged qualify row_number() over (partition by doc_id, item_id order by leak desc,
    (leak and n_changed = 0) desc, n_covered desc, consistent desc, n_changed, n_slots) = 1
)
select doc_id, item_id, item_words::bigint as item_words, n_covered::bigint as n_covered, n_slots, n_changed, consistent,
  leak, leak and n_changed > 0 as reparameterised from best where leak
"""

_L = licenses


def _terms(column: str) -> str:
    stop = ", ".join(f"'{s}'" for s in _L.STOP_WORDS)
    return (f"list_filter(list_transform(string_split_regex(lower({column}), '{_L._SPLIT}'), "
            f"lambda x: regexp_replace(x, '^[.-]+|[.-]+$', '', 'g')), lambda x: x <> '' and x not in ({stop}))")


_NOTICES = ", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(_L.TEMPLATES))
_ANCHORS = ", ".join(f"'{a}'" for a in _L.ANCHORS)
OP4 = f"""
with t(template, license, notice) as (values {_NOTICES}),
laid as (select template, license, {_terms('notice')} as terms from t),
files as (
  select doc_id, text, concat_ws('/', case when length(text) < 1000 then concat_ws('/', source, lang)
    else concat_ws('/', source, lang, 'p' || floor(doc_id / 500)::bigint, 'q' || floor(doc_id / 20)::bigint) end,
    case when length(text) < 500 then 'LICENSE.' || doc_id else 'f' || doc_id || '.txt' end) as path
  from documents
), cut as (
  select doc_id, {_terms('text')} as terms from files where regexp_matches(text, '{_L.HAS_ANCHOR}')
), n as (select count(distinct doc_id) as n from cut),
known as (select distinct unnest(terms) as term from laid),
df as (select term, count(distinct doc_id) as df from (select doc_id, unnest(terms) as term from cut)
       semi join known using (term) group by term),
idf as (select term, 1 + coalesce(round(ln((n + 1.0::double) / (coalesce(df, 0) + 1)) / nullif(ln(n + 1.0::double), 0), 12), 1.0) as idf
        from known left join df using (term), n),
tw as (select template, license, term, count(*) * any_value(idf) as w
       from (select template, license, unnest(terms) as term from laid) join idf using (term) group by all),
tn as (select template, license, term, w, sqrt(sum(w * w) over (partition by template)) as tnorm from tw),
anchor as (
  select template, length, term, min(pos) as pos from (
    select template, len(terms) as length, unnest(terms) as term, unnest(range(0, len(terms))) as pos from laid)
  where term in ({_ANCHORS}) group by all
), laid_on as (
  select *, min(pos) over (partition by template) as first from anchor
  qualify length <= {_L.SHORT_TERMS} or pos = min(pos) over (partition by template)
), place as (
  select distinct doc_id, template, terms, length, i - pos as start
  from (select doc_id, terms, unnest(terms) as term, unnest(range(1, len(terms) + 1)) as i from cut) c
  join laid_on using (term)
), wt as (
  select doc_id, template, start, term, count(*) as tf from (
    select doc_id, template, start, unnest(terms[greatest(start, 1):start + length - 1]) as term from place) group by all
), x as (
  select doc_id, template, start, term, tf * coalesce(idf, 2.0) as x from wt left join idf using (term)
), sc as (
  select doc_id, any_value(license) as license,
    round(sum(x * w) / (sqrt(sum(x * x)) * any_value(tnorm)), 6) as score
  from x left join tn using (template, term) group by doc_id, template, start
), own as (
  select doc_id, license, score from sc where score >= {_L.THRESHOLD}
  qualify row_number() over (partition by doc_id order by score desc, license) = 1
), f as (
  select doc_id, path, license, score, regexp_replace(path, '/[^/]*$', '') as dir,
    lower(regexp_extract(path, '([^/.]*)[^/]*$', 1)) as base from files left join own using (doc_id)
), hold as (
  select dir, license, score from f
  where license is not null and base in ({', '.join(f"'{x}'" for x in _L.LICENSE_FILES)})
  qualify row_number() over (partition by dir order by score desc, path) = 1
), up as (
  select doc_id, array_to_string(string_split(path, '/')[1:i], '/') as dir, i from (
    select doc_id, path, unnest(range(0, len(string_split(path, '/')))) as i from f where license is null)
), near as (
  select doc_id, dir, license, score from up join hold using (dir)
  qualify row_number() over (partition by doc_id order by i desc) = 1
)
select f.doc_id, f.path, coalesce(f.license, near.license) as license, coalesce(f.score, near.score) as score,
  case when f.license is not null then 'own' when near.license is not null then 'inherited' else 'none' end as how,
  near.dir as from_dir
from f left join near using (doc_id)
"""

ORACLES = {"op1_warc": OP1, "op4_licenses": OP4, "op6_near_dedup": OP6, "op7_substring_dedup": OP7,
           "op9_quality_rules": OP9, "op10_decontamination": OP10}
