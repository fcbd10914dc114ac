"""DuckDB SQL for the queries of this package that SQL can express."""

# The measures of the quality rules: least spread, whether a low value fails too, whether the measure belongs to the language.
_MEASURES = {
    "symbols_per_1000_words": (40, False, False), "dup_lines_per_1000_lines": (120, False, False), "repeats_per_1000_words": (100, False, False),
    "uppercase_per_1000_chars": (60, False, True), "marks_per_1000_words": (100, False, False), "chars_per_100_words": (60, True, True),
}

_EXACT = """
select doc_id, max(doc_id) over copies as keep_id, count(*) over copies as group_size,
       doc_id = max(doc_id) over copies as kept, sha256(coalesce(text, '')) as text_sha256
from documents
window copies as (partition by coalesce(text, ''))
"""


def _rules() -> str:
    """The rules in SQL: words and windows by position, sketches as counted buckets, fences by group, language and table."""
    measures = list(_MEASURES)
    long = " union all ".join(f"select lang_key, source_key, '{m}' as measure, {m} as v from measured" for m in measures)
    columns, inside, languages, chosen = [], [], [], []
    for m, (resolution, both, of_language) in _MEASURES.items():
        q25, q75 = (f"max({q}) filter (where measure = '{m}')" for q in ("q25", "q75"))
        spread = f"greatest({q75} - {q25}, {resolution})"
        low = f"greatest({q25} - 3 * {spread}, 0)" if both else "0"
        columns += [f"{low} as {m}_low", f"{q75} + 3 * {spread} as {m}_high"]
        inside.append(f"{m} between f.{m}_low and f.{m}_high")
        for e, wider in ((f"{m}_low", "least"), (f"{m}_high", "greatest")):
            mean = f"(l.{e} * l.rows + a.{e} * 50) // (l.rows + 50)"
            languages.append(f"{wider}({mean}, l.{e}) as {e}" if of_language else f"{mean} as {e}")
            chosen.append(f"(g.{e} * g.rows + l.{e} * 50) // (g.rows + 50) as {e}")
    languages, chosen = ", ".join(languages), ", ".join(chosen)
    return f"""
with docs as (
  select row_number() over () as rid, doc_id, coalesce(text, '') as t, coalesce('=' || lang, 'null') as lang_key,
         coalesce('=' || source, 'null') as source_key
  from documents
), split as (
  select *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') as ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as ls
  from docs
), positions as (
  select rid, ws, unnest(range(1, len(ws) - 1)) as p from split where len(ws) >= 3
), windows as (
  select rid, p, count(*) over (partition by rid, ws[p] || ' ' || ws[p + 1] || ' ' || ws[p + 2]) as k from positions
), repeated as (
  select rid, count(distinct q) as n from (select rid, unnest([p, p + 1, p + 2]) as q from windows where k > 1) group by rid
), counted as (
  select s.rid, doc_id, lang_key, source_key, len(ws) as n_words, length(array_to_string(ws, '')) as word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) as n_symbols, len(ls) - len(list_distinct(ls)) as n_dup_lines,
         coalesce(r.n, 0) as n_repeat_words, len(ls) as n_lines,
         length(regexp_replace(t, '[^!?~^_=+{{}}\\[\\]\\\\@]+', '', 'g')) as marks, length(regexp_replace(t, '[^\\p{{Lu}}]+', '', 'g')) as upper
  from split s left join repeated r on s.rid = r.rid
), measured as (
  select *, coalesce(1000 * n_symbols // nullif(n_words, 0), 0) as symbols_per_1000_words,
         coalesce(1000 * n_dup_lines // nullif(n_lines, 0), 0) as dup_lines_per_1000_lines,
         coalesce(1000 * n_repeat_words // nullif(n_words, 0), 0) as repeats_per_1000_words,
         coalesce(1000 * upper // nullif(word_chars, 0), 0) as uppercase_per_1000_chars,
         coalesce(1000 * marks // nullif(n_words, 0), 0) as marks_per_1000_words,
         coalesce(100 * word_chars // nullif(n_words, 0), 0) as chars_per_100_words
  from counted
), long as ({long}
), shifted as (
  select *, cast(pow(2, greatest(length(bin(v)) - 7, 0)) as bigint) as width from long
), sketch as (
  select lang_key, source_key, measure, v // width * width as bucket, count(*) as n from shifted group by all
), levels as (
  select 0 as level, lang_key, source_key, measure, bucket, n from sketch
  union all select 1, lang_key, '', measure, bucket, sum(n) from sketch group by all
  union all select 2, '', '', measure, bucket, sum(n) from sketch group by all
), ranked as (
  select *, sum(n) over (partition by level, lang_key, source_key, measure) as rows,
         sum(n) over (partition by level, lang_key, source_key, measure order by bucket) as up_to
  from levels
), quartiles as (
  select level, lang_key, source_key, measure, max(rows) as rows, min(bucket) filter (where 4 * up_to >= rows) as q25,
         min(bucket) filter (where 4 * up_to >= 3 * rows) as q75
  from ranked group by level, lang_key, source_key, measure
), fences as (
  select level, lang_key, source_key, max(rows) as rows, {", ".join(columns)}
  from quartiles group by level, lang_key, source_key
), languages as (
  select l.lang_key, {languages} from fences l, fences a where l.level = 1 and a.level = 2
), chosen as (
  select g.lang_key, g.source_key, {chosen} from fences g join languages l on l.lang_key = g.lang_key where g.level = 0
), judged as (
  select m.*, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, {" and ".join(inside)} as inside
  from measured m join chosen f on m.lang_key = f.lang_key and m.source_key = f.source_key
)
select doc_id, {", ".join(f"cast({c} as bigint) as {c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))},
       base_failed, not base_failed and inside as kept, {", ".join(f"cast({m} as bigint) as {m}" for m in measures)}
from judged
"""


_WARC = """
with p as (select page_id, coalesce(html, '') as t from pages),
r as (select *, strlen(t) >= 1000 and page_id < max(page_id) over (partition by t) as again, max(page_id) over (partition by t) as largest from p)
select page_id, strlen(t) as payload_bytes, sha1(t) as payload_digest, case when again then 'revisit' else 'response' end as record_type,
       case when again then largest end as refers_to
from r
"""

# The CRC-32 of the text column s of the table {rows}, as {rows}_crc(s, h): the table of remainders from its rule, then byte by byte.
_CRC = """
remainders as (
  select list(c order by i) as t from (
    select i, list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c
    from range(256) bytes(i))
), {rows}_crc as (
  select s, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(strlen(s)),
           lambda k: cast('0x' || substr(hex(encode(s)), 2 * k + 1, 2) as bigint))),
           lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295::bigint) as h
  from (select distinct s from {rows}), remainders
)"""

_RUNS = f"""
with ids as (select cast(doc_id as varchar) as s from documents where doc_id is not null), {_CRC.format(rows="ids")},
split as (
  select row_number() over () as rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as ws, coalesce(h, 1) as h, coalesce(h, 1) // 10 as g
  from documents left join ids_crc on s = cast(doc_id as varchar)
), planned as (
  select *, g % greatest(len(ws), 1) as a, 1 + (len(ws) - g % greatest(len(ws), 1)) // (3 + g % 8) as p from split
), docs as (
  select rid, doc_id, case when h % 10 = 0 then list_transform(range(len(ws)), lambda i: ws[1 + case when i < a then i else a + (i - a) % p end])
                           else ws end as ws
  from planned
), windows as (
  select rid, i, array_to_string(ws[i + 1:i + 6], ' ') as w from (select rid, ws, unnest(range(greatest(len(ws) - 5, 0))) as i from docs)
), islands as (
  select rid, q, i - row_number() over (partition by rid, q order by i) as island, i
  from (select x.rid, x.i, y.i - x.i as q from windows x join windows y on x.rid = y.rid and x.w = y.w and x.i < y.i)
), stretched as (
  select rid, min(i) as start, count(*) + 5 + q as length, q as period from islands group by rid, q, island
), runs as (
  select rid, start, length, min(period) as period from stretched where length >= greatest(12, 2 * period) group by all
), listed as (
  select rid, count(*) as n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as lines,
         first(struct_pack(start, length, period) order by length desc, start, period) as best
  from runs group by rid
), gone as (
  select distinct rid, unnest(range(start + period, start + length)) as i from runs
), kept as (
  select w.rid, string_agg(w.word, ' ' order by w.i) as t
  from (select rid, unnest(ws) as word, unnest(range(len(ws))) as i from docs) w anti join gone g on w.rid = g.rid and w.i = g.i
  group by w.rid
)
select doc_id, coalesce(n_runs, 0) as n_runs, best.start as start, best.length as length, best.period as period,
       1000 * best.length // best.period as exponent_milli, sha256(coalesce(lines, '')) as runs_sha256, sha256(coalesce(t, '')) as collapsed_sha256
from docs d left join listed l on d.rid = l.rid left join kept k on d.rid = k.rid
"""

_VARIANTS = f"""
with recursive found as (
  select cast(doc_id as varchar) as id, unnest(regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\u00C0-\u00FF]+')) as run
  from documents
), named as (
  select coalesce(id, '') || ':' || run as s, run, count(*) as times from found where length(run) >= 5 group by all
), {_CRC.format(rows="named")}, spelled as (
  select case when h % 97 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, times
  from named join named_crc using (s)
), words as (
  select word, cast(sum(times) as bigint) as n from spelled where length(word) >= 5 group by word having sum(times) >= 3
), cut as (
  select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as rest from (select word, n, unnest(range(1, length(word) + 1)) as i from words)
), pairs as (
  select x.word as u, y.word as v, y.n as vn from cut x join cut y on x.i = y.i and x.rest = y.rest and x.word <> y.word
  union select x.word, y.word, y.n from cut x join words y on x.rest = y.word
  union select y.word, x.word, x.n from cut x join words y on x.rest = y.word
), near as (
  select u, count(*) as n_near, max(vn) as form_n, first(v order by vn desc, encode(v)) as form from pairs group by u
), formed as (
  select word, n, coalesce(n_near, 0) as n_near, case when form_n >= 2 * n then form end as form, case when form_n >= 2 * n then form_n end as form_n
  from words left join near on u = word
), chain as (
  select word, word as at from formed
  union all select c.word, f.form from chain c join formed f on f.word = c.at where f.form is not null
), ends as (
  select c.word, c.at as root from chain c join formed f on f.word = c.at where f.form is null
)
select word, form, root, n, n_near, form_n from formed join ends using (word)
"""


ORACLES: dict[str, str] = {
    "op2_quality_rules": _rules(), "op4_exact_dedup": _EXACT, "op11_warc": _WARC, "op12_periodic_runs": _RUNS, "op13_spelling_variants": _VARIANTS,
}
