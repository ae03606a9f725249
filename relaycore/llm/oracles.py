"""DuckDB SQL for the operators whose result SQL can state; plain definitions, without the operators' methods."""

import re
import string

from .license_scan import PHRASES, TEMPLATES

_LOW = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
_SPACED = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
_PLAIN = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _windows(rows: str, key: str, least: int) -> str:
    """(key, n, pos, window): runs of n words at their place, from 1; n is `least`, or all words where there are fewer."""
    return f"select {key}, n, pos, array_to_string(w[pos:pos + n - 1], ' ') as win from (select {key}, w, least({least}, len(w)) as n, unnest(range(1, len(w) - least({least}, len(w)) + 2)) as pos from {rows} where len(w) > 0)"


LINE_QUALITY = rf"""
with docs as (select doc_id, source as host, coalesce(text, '') as text, {_SPACED.format("coalesce(text, '')")} as w from documents),
triples as (select doc_id, pos, win, count(*) over (partition by doc_id, win) as times from ({_windows("(select doc_id, w from docs where len(w) >= 3)", "doc_id", 3)})),
repeated as (select doc_id, count(distinct pos + k) as n from triples, (select unnest([0, 1, 2]) as k) where times > 1 group by doc_id),
lines as (select doc_id, host, text, line, array_to_string({_SPACED.format(_LOW.replace("text", "line"))}, ' ') as key, len({_SPACED.format("line")}) as words from (select doc_id, host, text, unnest(string_split(text, chr(10))) as line from docs) where regexp_matches(line, '[^\x20\x09-\x0D]')),
dups as (select doc_id, count(*) - count(distinct line) as n from lines group by doc_id),
limits as (select host, greatest(50.0, count(distinct doc_id) * 0.02) as most from docs group by host),
frequent as (select c.host, c.key from (select host, key, count(distinct doc_id) as n from lines group by all) c join limits on c.host is not distinct from limits.host where n > most),
gone as (select doc_id, sum(words) as n from lines join frequent f on lines.host is not distinct from f.host and lines.key = f.key group by doc_id),
judged as (select d.doc_id, len(d.w) as n_words, length(regexp_replace(d.text, '[\x20\x09-\x0D]+', '', 'g')) as word_chars, length(d.text) - length(regexp_replace(d.text, '[#*$%&|<>]', '', 'g')) as n_symbols,
 coalesce(dups.n, 0) as n_dup_lines, coalesce(repeated.n, 0) as n_repeat_words, coalesce(gone.n, 0)::bigint as n_removed
 from docs d left join dups using (doc_id) left join repeated using (doc_id) left join gone using (doc_id))
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words,
 n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
 not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and not (n_removed > 0 and (n_words - n_removed < 50 or n_words - n_removed < 0.3 * n_words)) as kept, n_removed
from judged
"""

DECONTAMINATION = f"""
with docs as (select doc_id, {_PLAIN} as w from documents), items as (select item_id, {_PLAIN} as w from benchmark),
wanted as (select distinct item_id, n, win from ({_windows("items", "item_id", 10)})),
sizes as (select distinct n from wanted),
places as (select doc_id, n, pos, array_to_string(w[pos:pos + n - 1], ' ') as win from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as pos from docs, sizes where len(w) >= n)),
met as (select doc_id, item_id, n, pos from places join wanted using (n, win)),
hit as (select doc_id, count(distinct pos + k) as n from (select distinct doc_id, n, pos, unnest(range(n)) as k from (select distinct doc_id, n, pos from met)) group by doc_id),
named as (select doc_id, count(*) as n, string_agg(item_id::varchar, ',' order by item_id::varchar) as ids from (select distinct doc_id, item_id from met) group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(hit.n, 0)::bigint as n_hit, coalesce(named.n, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(hit.n, 0) > 0 as contaminated
from docs left join hit using (doc_id) left join named using (doc_id)
"""

NGRAM_JOIN = f"""
with recursive docs as (select doc_id, {_SPACED.format(_LOW)} as w from documents),
sets as (select distinct doc_id, win from ({_windows("docs", "doc_id", 5)})),
sized as (select doc_id, count(*) as n from sets group by doc_id),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as common from sets a join sets b using (win) where a.doc_id <> b.doc_id group by all),
links as (select a, b from shared join sized x on x.doc_id = a join sized y on y.doc_id = b where 100 * common >= 75 * (x.n + y.n - common)),
reached(a, b) as (select doc_id, doc_id from docs union select reached.a, links.b from reached join links on links.a = reached.b),
least as (select a, min(b) as component_id from reached group by a)
select doc_id, coalesce(n, 0)::bigint as n_shingles, component_id from docs left join sized using (doc_id) join least on a = doc_id
"""

_LICENSE_ROWS = [(label, re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())) for label, text in TEMPLATES]
_QUOTED = lambda words: "[" + ",".join(f"'{w}'" for w in words) + "]"
#: Any line, and any window of the template's size, that holds 92 hundredths of its words.
LICENSE_SCAN = f"""
with docs as (select doc_id, {_PLAIN} as w, {_LOW} as low from documents),
templates(label, words, size) as (values {",".join(f"('{label}', {_QUOTED(sorted(set(words)))}, {max(16, 1 << (2 * len(words) - 1).bit_length())})" for label, words in _LICENSE_ROWS)}),
phrases(label, words) as (values {",".join(f"('{label}', {_QUOTED(phrase.split())})" for phrase, label in PHRASES)}),
places as (select doc_id, label, pos - 1 as place from (select doc_id, label, words, w, unnest(range(1, len(w) - len(words) + 2)) as pos from docs, phrases where len(w) >= len(words)) where w[pos:pos + len(words) - 1] = words),
based as (select doc_id, count(*) as n, min(place) as first_word, max(place) as last_word, list(distinct label) as labels from places group by doc_id),
possible as (select d.doc_id, t.* from docs d join templates t on 100 * len(list_intersect(d.w, t.words)) >= 92 * len(t.words)),
blocks as (select doc_id, 0 as size, regexp_extract_all(line, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as words from (select doc_id, unnest(string_split(low, chr(10))) as line from docs where doc_id in (select doc_id from possible))
 union all select doc_id, size, w[place + 1:place + size] from (select doc_id, w, size, unnest(range(0, len(w), size // 2)) as place from docs join (select distinct doc_id, size from possible) using (doc_id))),
met as (select s.doc_id, s.label, max(len(list_intersect(b.words, s.words)) / len(s.words)) as held from possible s join blocks b on b.doc_id = s.doc_id and b.size in (0, s.size) group by all having max(100 * len(list_intersect(b.words, s.words)) - 92 * len(s.words)) >= 0),
more as (select doc_id, list(distinct label) as labels, max(held) as held from met group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word, coalesce(array_to_string(list_sort(based.labels), ','), '') as base_labels,
 coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(based.labels, []), coalesce(more.labels, [])))), ','), '') as labels, case when n > 0 then 1.0::double else coalesce(held, 0)::double end as score
from docs left join based using (doc_id) left join more using (doc_id)
"""
