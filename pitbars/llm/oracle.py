"""DuckDB SQL for the numbered queries SQL can state."""

from __future__ import annotations

from pitbars.llm import warc
from pitbars.llm.chat import Template

_UNIT = "('0x' || substr({}, 1, 8))::BIGINT::DOUBLE / 4294967296.0"


def interleaving(n_shards: int = 40, seed: int = 7) -> str:
    shift = _UNIT.format(f"md5('{seed}:stratum:' || stratum)")
    return f"""
with crc_table as materialized (
  select list_transform(range(256), lambda n: list_reduce(list_prepend(n::bigint, [1, 1, 1, 1, 1, 1, 1, 1]::bigint[]),
    lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384::bigint) else c >> 1 end)) t
), slim as (
  select doc_id, coalesce('=' || source, '-') stratum, octet_length(encode(coalesce(text, ''))) + 16 size,
    hex(encode(coalesce(text, ''))) hx, md5('{seed}:' || coalesce(doc_id::varchar, '')) h
  from documents
), ranked as (
  select *, row_number() over (partition by stratum order by h, doc_id, size) k, count(*) over (partition by stratum) n
  from slim
), placed as (
  select *, row_number() over (order by (k::double - 1 + {shift}) / n::double, stratum, h, doc_id, size) - 1 pos,
    count(*) over () total
  from ranked
), cut as (select *, (pos * {n_shards}) // total shard from placed)
select doc_id, size::bigint size,
  xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(len(hx) // 2),
    lambda i: ('0x' || substr(hx, (2 * i + 1)::int, 2))::bigint)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])),
    4294967295::bigint) text_crc32, 'rows' law, shard::int shard,
  (pos - (shard * total + {n_shards - 1}) // {n_shards})::bigint slot, null::int grown_shard
from cut, crc_table"""


def quality(limit_docs: int = 10) -> str:
    ws = r"[\x20\x09-\x0D]+"
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    norm = f"trim(regexp_replace({lower.format('line')}, '{ws}', ' ', 'g'))"
    return rf"""
with docs as (
  select row_number() over () r, doc_id, coalesce('=' || source, '-') host, coalesce(text, '') body from documents
), words as (
  select r, list_filter(regexp_split_to_array(body, '{ws}'), lambda w: w <> '') w from docs
), windows as (
  select r, i, array_to_string(w[i:i + 7], ' ') g from (select r, w, unnest(range(1, len(w) - 6)) i from words)
), twice as (
  select r, i from windows qualify count(*) over (partition by r, g) > 1
), repeated as (
  select r, count(distinct i + k) n from twice, range(8) x(k) group by r
), lines as (
  select r, host, body, line, {norm} norm from (select r, host, body, unnest(string_split(body, chr(10))) line from docs)
), with_word as (
  select *, len(string_split(norm, ' ')) n from lines where norm <> ''
), dup as (
  select r, count(*) - count(distinct line) n from with_word group by r
), often as (
  select host, norm from with_word group by host, norm having count(distinct body) > {limit_docs}
), gone as (
  select r, sum(n) n from with_word join often using (host, norm) group by r
), figures as (
  select doc_id, len(w) n_words, len(array_to_string(w, '')) word_chars,
    len(regexp_replace(body, '[^#*$%&|<>]', '', 'g')) n_symbols, coalesce(dup.n, 0) n_dup_lines,
    coalesce(repeated.n, 0) n_repeat_words, coalesce(gone.n, 0)::bigint n_removed_words
  from docs join words using (r) left join dup using (r) left join repeated using (r) left join gone using (r)
), judged as (
  select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words base_failed from figures
)
select doc_id, n_words::bigint n_words, word_chars::bigint word_chars, n_symbols::bigint n_symbols, n_dup_lines::bigint n_dup_lines,
  n_repeat_words::bigint n_repeat_words, n_removed_words, base_failed,
  not base_failed and 100 * n_removed_words <= 50 * n_words kept
from judged"""


def near_duplicates(size: int = 2, percent: int = 80) -> str:
    """Every pair that shares a shingle is counted; equal sets are one class before that."""
    words = (
        "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
        "'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
    )
    return f"""
with recursive words as materialized (
  select doc_id, {words} w from documents
), sets as materialized (
  select doc_id, list_sort(list_distinct(case when len(w) = 0 then []::varchar[]
    when len(w) < {size} then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - {size} + 2), lambda i: array_to_string(w[i:i + {size} - 1], ' ')) end)) s from words
), classes as materialized (
  select s, min(doc_id) id, len(s) n from sets where len(s) > 0 group by s
), items as materialized (
  select id, n, unnest(s) g from classes
), pairs as materialized (
  select a.id a, b.id b, count(*) k, any_value(a.n) na, any_value(b.n) nb
  from items a join items b on a.g = b.g and a.id < b.id
    and 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n)
  group by a.id, b.id
), links as materialized (
  select a, b from pairs where 100 * k >= {percent} * (na + nb - k)
), both_ways as materialized (
  select a, b from links union all select b, a from links
), reach(id, root) as (
  select distinct a, a from both_ways union select b, root from reach join both_ways on a = id
), roots as (
  select id, min(root) root from reach group by id
)
select doc_id, len(sets.s)::bigint n_shingles, coalesce(root, id, doc_id) component_id,
  coalesce(root, id, doc_id) = doc_id kept
from sets left join classes on sets.s = classes.s and len(sets.s) > 0 left join roots using (id)"""


def vectors(least: float = 0.9) -> str:
    return f"""
with recursive unit as materialized (
  select vec_id, embedding::double[] v from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and list_max(list_transform(embedding, lambda x: abs(x))) > 0
), links as materialized (
  select a.vec_id a, b.vec_id b from unit a join unit b on a.vec_id <> b.vec_id and len(a.v) = len(b.v)
    and list_cosine_similarity(a.v, b.v) >= {least}
), reach(id, root) as (
  select distinct a, a from links union select b, root from reach join links on a = id
), roots as (
  select id, min(root) root from reach group by id
), counts as (
  select a id, count(*) n from links group by a
)
select vec_id, coalesce(n, 0)::bigint n_links, coalesce(root, vec_id) component_id, coalesce(root, vec_id) = vec_id kept
from embeddings left join roots on roots.id = vec_id left join counts on counts.id = vec_id"""


def _replaced(text: str, steps: tuple[tuple[str, str], ...]) -> str:
    for pattern, by in steps:
        pattern = pattern.replace("'", "''")
        text = f"regexp_replace({text}, '{pattern}', {'chr(10)' if by == chr(10) else repr(by)}, 'g')"
    return text


def _entities(text: str) -> str:
    """The named entities of the test pages; an ampersand last."""
    for name, char in (("quot", '"'), ("copy", "\u00a9"), ("middot", "\u00b7"), ("lt", "<"), ("gt", ">"), ("amp", "&")):
        text = f"replace({text}, '&{name};', '{char}')"
    return text


def _tidy(text: str) -> str:
    return f"trim({_replaced(text, warc.BLANKS)}, ' ' || chr(10))"


def warc_derivatives(date: str = warc.DATE) -> str:
    uuid = "'<urn:uuid:' || substr(h,1,8) || '-' || substr(h,9,4) || '-' || substr(h,13,4) || '-' || substr(h,17,4) || '-' || substr(h,21) || '>'"
    urn = lambda of: uuid.replace("h,", f"md5({of}),")
    crlf = "chr(13) || chr(10)"
    return f"""
with source as materialized (
  select page_id, coalesce(url, '') uri, coalesce(html, '') page,
    {urn("'response:' || coalesce(page_id::varchar, '') || ':' || coalesce(url, '')")} rid
  from pages
), found as materialized (
  select *, {_tidy(_entities(_replaced("page", warc.STEPS)))} body,
    replace({_tidy(_entities(f"regexp_extract(page, '{warc.TITLE}', 1)"))}, chr(10), ' ') title,
    regexp_extract(page, '{warc.LANG}', 1) lang, regexp_extract_all(page, '{warc.LINK}', 1) links,
    {urn("'conversion:' || rid")} cid, {urn("'metadata:' || rid")} mid, 'sha256:' || sha256(page) digest
  from source
), records as (
  select page_id, 'conversion' warc_type, cid record_id, rid refers_to, mid concurrent_to, uri target_uri,
    'text/plain; charset=utf-8' content_type, digest, body from found
  union all
  select page_id, 'metadata', mid, rid, cid, uri, 'application/warc-fields', digest,
    'title: ' || title || {crlf} || 'language: ' || lang || {crlf}
    || coalesce(list_reduce(list_prepend('', list_transform(links, lambda x: 'outlink: ' || x || {crlf})), lambda a, b: a || b), '')
    || 'source-http-header: HTTP/1.1 200 OK' || {crlf}
    || 'source-http-header: Content-Type: text/html; charset=utf-8' || {crlf}
    || 'source-http-header: Content-Length: ' || octet_length(encode(page)) || {crlf}
  from found
)
select page_id, warc_type, record_id, refers_to, concurrent_to, target_uri, '{date}' date, content_type,
  digest source_payload_digest, 'sha256:' || sha256(body) block_digest, octet_length(encode(body))::bigint content_length
from records"""


def chats() -> str:
    """Lengths from the marks of the default template and the characters that escaping adds."""
    t = Template()
    escaped = "replace(text, '\\', '\\\\')"
    for m in t.marks:
        escaped = f"replace({escaped}, '{m}', '{m[0]}\\{m[1:]}')"
    first, says, end = t.other
    opened = " ".join(f"when '{r}' then {len(a)}" for r, (a, _) in t.roles.items())
    closed = " ".join(f"when '{r}' then {len(b)}" for r, (_, b) in t.roles.items())
    loss = ", ".join(f"'{r}'" for r in t.loss_roles)
    return f"""
with own(conv_id, turn, role, text) as (
  values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text
  from (select conv_id, turn, role, text from conversations union all select * from own)
), placed as (
  select *, row_number() over w as k, lag(role) over w is not distinct from role and row_number() over w > 1 as stays
  from rows window w as (partition by conv_id order by turn nulls first, role, text)
), sized as (
  select *, length({escaped})
    + case when stays then {len(t.joint)}
      else case role {opened} else {len(first) + len(says)} + length({escaped.replace("text", "role")}) end
        + case role {closed} else {len(end)} end end as chars
  from placed
)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by k)) as turns_sha256,
  coalesce(sum(length(text)) filter (role in ({loss})), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by k) filter (role in ({loss})), '')) as loss_sha256,
  sum(chars)::bigint as formatted_chars
from sized group by conv_id"""
