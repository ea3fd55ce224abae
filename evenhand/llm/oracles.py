"""DuckDB SQL with the rows of the registered queries that SQL can express."""

from __future__ import annotations

from evenhand.llm import decontam, line_dedup, quality
from evenhand.llm.common import LOWER, UPPER
from evenhand.llm.ngram_join import PERCENT, N

ORACLES: dict[str, str] = {}

SPACED = r"[^\x20\x09-\x0D]+"
PLAIN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def words(text: str, pattern: str, fold: bool) -> str:
    whole = f"coalesce({text}, '')"
    whole = f"translate({whole}, '{UPPER}', '{LOWER}')" if fold else whole
    return f"regexp_extract_all({whole}, '{pattern}')"


ORACLES["op3_decontamination"] = f"""
with docs as (select doc_id, {words("text", PLAIN, True)} as w from documents),
items as (select coalesce(item_id::varchar, '') as item, {words("text", PLAIN, True)} as w from benchmark),
windows as (
    select distinct item, w[i : i + {decontam.WINDOW_WORDS - 1}] as g
    from (select item, w, unnest(range(1, greatest(len(w) - {decontam.WINDOW_WORDS - 1}, 1) + 1)) as i
          from items where len(w) > 0)
),
tokens as (select doc_id, unnest(w) as term, unnest(range(len(w))) as pos from docs),
grams as (
    select doc_id, i, w[i : i + n - 1] as g, n
    from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i
          from docs, (select distinct len(g) as n from windows) where len(w) >= n)
),
found as (select doc_id, i, n, item from grams join windows using (g)),
hit as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + n)) as p from found) group by 1),
per_doc as (select doc_id, list_sort(list(distinct item)) as l from found group by 1),
counts as (select term, count(*) as n from tokens group by 1),
stretches as (
    select row_number() over () as stretch, * from (
        select distinct item, list_sort(list_distinct(w[i : i + {decontam.WINDOW_WORDS - 1}])) as t, few from (
            select item, w, unnest(s) as i, len(s) <= {decontam.FEW_WINDOWS} as few from (
                select *, list_distinct(list_concat(range(1, l + 1, {decontam.WINDOW_WORDS // 2}), [l])) as s
                from (select *, greatest(len(w) - {decontam.WINDOW_WORDS - 1}, 1) as l from items where len(w) > 0))))
),
ranked as (
    select 2 * stretch + (r - 1) // {decontam.ANCHORS} as stretch, item, term, (r - 1) % {decontam.ANCHORS} + 1 as r from (
        select stretch, item, len(t) as all_terms, few, term, row_number() over (partition by stretch order by n, term) as r,
            count(*) over (partition by stretch) as known
        from (select *, unnest(t) as term from stretches) join counts using (term))
    where known >= least(all_terms, {decontam.ANCHORS})
        and (r <= {decontam.ANCHORS} or few and known >= {2 * decontam.ANCHORS} and r <= {2 * decontam.ANCHORS})
),
near as (
    select doc_id, count(distinct item) as n, array_to_string(list_sort(list(distinct item)), ',') as near_items from (
        select a.doc_id, r1.item from tokens a join ranked r1 on a.term = r1.term and r1.r = 1
        left join ranked r2 on r2.stretch = r1.stretch and r2.r = 2 left join ranked r3 on r3.stretch = r1.stretch and r3.r = 3
        join tokens b on b.doc_id = a.doc_id and b.term = coalesce(r2.term, a.term)
            and abs(b.pos - a.pos) < {decontam.NEAR_WINDOWS * decontam.WINDOW_WORDS}
        join tokens c on c.doc_id = a.doc_id and c.term = coalesce(r3.term, a.term)
        where greatest(a.pos, b.pos, c.pos) - least(a.pos, b.pos, c.pos)
            < {decontam.NEAR_WINDOWS * decontam.WINDOW_WORDS}
    ) group by 1
)
select d.doc_id, len(w)::bigint as n_words, coalesce(h.n, 0)::bigint as n_hit, coalesce(len(l), 0)::bigint as n_items,
    sha256(coalesce(array_to_string(l, ','), '')) as items_sha256,
    coalesce(h.n, 0) > 0 and 20 * coalesce(h.n, 0) >= len(w) as contaminated, coalesce(k.n, 0)::bigint as n_near,
    coalesce(k.near_items, '') as near_items
from docs d left join hit h using (doc_id) left join per_doc p using (doc_id) left join near k using (doc_id)
"""

FAILS = f"""
    (len(lw) <= {quality.ENTRY_WORDS} and not regexp_matches(t, '{quality.CLOSING.replace("'", "''")}'))
    or (len(lw) <= {quality.BOILERPLATE_WORDS} and regexp_matches(lower(t), '{quality.BOILERPLATE}'))
    or length(t) - length(regexp_replace(t, '{quality.SYMBOLS}', '', 'g')) > {quality.SYMBOL_SHARE} * len(lw)
    or (len(lw) >= {quality.ECHO_WORDS} and
        len(list_filter(range(1, len(lw)), lambda i: lw[i] = lw[i + 1])) >= {quality.ECHO_SHARE} * len(lw))
"""
ORACLES["op4_quality"] = f"""
with docs as (
    select row_number() over () as r, doc_id, coalesce(text, '') as text, {words("text", SPACED, False)} as w
    from documents
),
lines as (
    select r, l, trim(l, {WHITE}) as t, {words("l", SPACED, False)} as lw
    from (select r, unnest(string_split(text, chr(10))) as l from docs) where trim(l, {WHITE}) <> ''
),
judged as (
    select r, count(*) as n_lines, count(*) - count(distinct l) as n_dup_lines,
        count(*) filter ({FAILS}) as n_bad_lines,
        coalesce(sum(len(array_to_string(lw, ''))) filter (not ({FAILS})), 0) as kept_chars
    from lines group by 1
),
grams as (
    select r, i, w[i : i + 4] as g
    from (select r, w, unnest(range(1, len(w) - 3)) as i from docs where len(w) >= 5)
),
again as (select r, i from (select r, i, count(*) over (partition by r, g) as n from grams) where n > 1),
repeated as (select r, count(distinct p) as n from (select r, unnest(range(i, i + 5)) as p from again) group by 1),
facts as (
    select doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
        (length(text) - length(regexp_replace(text, '{quality.SYMBOLS}', '', 'g')))::bigint as n_symbols,
        coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n, 0)::bigint as n_repeat_words,
        coalesce(n_lines, 0)::bigint as n_lines, coalesce(n_bad_lines, 0)::bigint as n_bad_lines,
        coalesce(kept_chars, 0)::bigint as kept_chars
    from docs left join judged using (r) left join repeated using (r)
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
    not (n_words < 10 or 100 * n_repeat_words > 20 * n_words)
        and 100 * kept_chars >= {quality.KEPT_PERCENT} * word_chars as kept,
    n_lines, n_bad_lines, kept_chars
from facts
"""

ORACLES["op10_ngram_join"] = f"""
with recursive docs as (select doc_id, {words("text", SPACED, True)} as w from documents),
sets as (
    select doc_id, case when len(w) >= {N}
        then list_distinct(list_transform(range(1, len(w) - {N - 2}), lambda i: array_to_string(w[i : i + {N - 1}], ' ')))
        when len(w) > 0 then [array_to_string(w, ' ')] else [] end as s
    from docs
),
elements as (select doc_id, unnest(s) as g from sets),
pairs as (
    select a.doc_id as x, b.doc_id as y, count(*) as n
    from elements a join elements b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2
),
links as (
    select x, y from pairs p join sets a on a.doc_id = x join sets b on b.doc_id = y
    where 100 * n >= {PERCENT} * (len(a.s) + len(b.s) - n)
),
both_ways as (select x, y from links union all select y, x from links),
reach as (
    select doc_id, doc_id as other from sets
    union
    select r.doc_id, l.y from reach r join both_ways l on r.other = l.x
)
select s.doc_id, any_value(len(s.s))::bigint as n_shingles, min(r.other) as component_id
from sets s join reach r using (doc_id) group by 1
"""

ORACLES["op13_line_dedup"] = f"""
with lines as (
    select r, doc_id, unnest(l) as line, unnest(range(len(l))) as i
    from (select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents)
),
keyed as (select *, translate(trim(line, {WHITE}), '{UPPER}', '{LOWER}') as k from lines),
shared as (
    select k, count(distinct r) as n, max(doc_id) as last from keyed
    where length(k) >= {line_dedup.LEAST_CHARS} group by 1 having count(distinct r) >= {line_dedup.LEAST_DOCS}
),
judged as (select r, d.doc_id, i, line, case when last is distinct from d.doc_id then n end as n
           from keyed d left join shared using (k))
select any_value(doc_id) as doc_id, count(*) as n_lines, count(n) as n_dropped, coalesce(max(n), 0)::bigint as most_docs,
    sha256(coalesce(string_agg(line, chr(10) order by i) filter (n is null), '')) as kept_sha256
from judged group by r
"""

# crc32 of a text of digits, bit by bit.
CRC32 = """
    xor(4294967295::ubigint, list_reduce(
        list_prepend(4294967295::ubigint, list_transform(string_split(conv_id::varchar, ''), lambda c: ord(c)::ubigint)),
        lambda a, b: list_reduce(
            list_prepend(xor(a, b), list_transform(range(8), lambda x: x::ubigint)),
            lambda r, i: case when r & 1 = 1 then xor(r >> 1, 3988292384::ubigint) else r >> 1 end)))
"""
ORACLES["op12_prefix_trie"] = f"""
with said as (
    select conv_id, turn, {{'r': coalesce(role, ''), 't': coalesce(text, '')}} as s,
        sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as digest
    from conversations where conv_id is not null
),
convs as (
    select conv_id, list(s order by turn nulls first, digest) as t, {CRC32} % 6 as h from said group by conv_id
),
rebuilt as (
    select c.conv_id, list_concat(case when b.t is null then [] else b.t[1:c.h] end, c.t[c.h + 1:]) as t
    from convs c left join convs b on b.conv_id = c.conv_id - c.conv_id % 100
),
prefixes as (select conv_id, len(t) as n, d, t[1:d] as p from (select *, unnest(range(len(t) + 1)) as d from rebuilt)),
nodes as (
    select p, d, min(conv_id) as conv_id, count(*) as n_convs, coalesce(length(p[d].t), 0) as chars,
        sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (n = d), '')) as ends_sha256
    from prefixes group by p, d
),
children as (select p[1:d - 1] as p, count(*) as n from nodes where d > 0 group by 1),
below as (
    select p[1:a] as p, sum((n_convs - 1) * chars) as saved, count(*) filter (n is null) as leaves
    from (select *, unnest(range(d + 1)) as a from nodes left join children using (p)) group by 1
)
select x.conv_id, x.d as depth, y.conv_id as parent_conv_id, x.n_convs, coalesce(c.n, 0)::bigint as n_children,
    leaves as n_leaves, saved::bigint as saved_tokens, x.ends_sha256
from nodes x join below on below.p = x.p left join children c on c.p = x.p
    left join nodes y on x.d > 0 and y.p = x.p[1:x.d - 1]
"""
