"""DuckDB statements for the queries that SQL can express over whole tables.

The others have none: trained models, vocabularies, edit distances, XXH64 fingerprints and approximate search are held
against brute force in the tests.
"""

from __future__ import annotations

from returnlens.llm import quality, warc

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def _characters(values: str) -> str:
    return "[" + values.replace("|", r"\|").replace("]", r"\]").replace("'", "''") + "]"


def _bare(text: str) -> str:
    return f"length(regexp_replace({text}, '{SPACE}', '', 'g'))"


def _count(text: str, characters: str) -> str:
    return f"len(regexp_extract_all({text}, '{_characters(characters)}'))"


FINISHED = ", ".join(f"'{c}'" for c in quality.FINISHED)
# The trimmed characters, the line end among them, as text of a statement.
TRIMMED = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || '" + quality.CLOSERS.replace("'", "''") + "'"

QUALITY = f"""
with docs as (
  select row_number() over () as row_id, doc_id, coalesce(text, '') as t from documents
), cut as (
  select *, regexp_extract_all(t, '{WORD}') as words, string_split(t, chr(10)) as lines from docs
), places as (
  select row_id, unnest(range(1, len(words) - {quality.WINDOW - 2})) as i,
    unnest(list_transform(range(1, len(words) - {quality.WINDOW - 2}),
      lambda i: array_to_string(words[i:i + {quality.WINDOW - 1}], ' '))) as content
  from cut where len(words) >= {quality.WINDOW}
), windows as (
  select row_id, i, count(*) over (partition by row_id, content) as n from places
), repeated as (
  select row_id, count(distinct i + j) as n_repeat_words
  from (select row_id, i, unnest(range(0, {quality.WINDOW})) as j from windows where n > 1) group by row_id
), lines as (
  select row_id, unnest(lines) as line from cut
), worded as (
  select row_id, line, regexp_extract_all(line, '{WORD}') as words from lines
), judged as (
  select row_id, line, len(words) as n, {_bare('line')} as solid,
    {_count('line', quality.SYMBOLS)} as symbols, {_count('line', '!?')} as shouts,
    right(rtrim(line, {TRIMMED}), 1) as last,
    len(regexp_extract_all(line, '{SPACE}{_characters(quality.SEPARATORS)}{SPACE}')) as menu,
    len(list_filter(range(1, len(words)), lambda i: words[i] = words[i + 1])) as stutter
  from worded where len(words) > 0
), passed as (
  select row_id, count(*) - count(distinct line) as n_dup_lines,
    coalesce(sum(solid) filter (where not (
      100 * symbols > {quality.MOST_SYMBOLS} * solid
      or (n >= {quality.SHOUT_WORDS} and 100 * shouts >= {quality.MOST_SHOUTS} * n)
      or (n <= {quality.MENU_WORDS} and last not in ({FINISHED})) or menu >= 2
      or (n <= {quality.BOILERPLATE_WORDS} and regexp_matches(line, '{quality.BOILERPLATE}'))
      or 100 * stutter > {quality.MOST_STUTTER} * n)), 0) as left_chars
  from judged group by row_id
), counted as (
  select doc_id, len(words)::bigint as n_words, {_bare('t')}::bigint as word_chars,
    {_count('t', quality.SYMBOLS)}::bigint as n_symbols, coalesce(n_dup_lines, 0)::bigint as n_dup_lines,
    coalesce(n_repeat_words, 0)::bigint as n_repeat_words, coalesce(left_chars, 0) as left_chars
  from cut left join passed using (row_id) left join repeated using (row_id)
), failed as (
  select *, n_words < {quality.LEAST_WORDS} or 100 * n_repeat_words > {quality.MOST_REPEATED} * n_words as base_failed
  from counted
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and 100 * left_chars >= {quality.LEAST_LEFT} * word_chars as kept
from failed
"""

WARC = f"""
with pages_ as (
  select page_id, coalesce(html, '') as html from pages
), coded as (
  select *, list_transform(range(0, 8), lambda g: list_sum(list_transform(range(0, 5), lambda k:
    (strpos('0123456789abcdef', substr(sha1(html), (5 * g + k + 1)::int, 1)) - 1) * (1 << (16 - 4 * k))))::bigint) as v,
    max(page_id) over (partition by html) as owner
  from pages_
)
select page_id, strlen(html)::bigint as payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i:
    substr('{warc.BASE32}', ((v[i // 4 + 1] >> (15 - 5 * (i % 4))) & 31)::int + 1, 1)), '') as payload_digest,
  case when page_id = owner then 'response' else 'revisit' end as record_type,
  case when page_id = owner then null else owner end as refers_to
from coded
"""

NEGATIVES = """
with vectors as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)) as whole
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select a.vec_id as anchor_id, r.vec_id, a.label = r.label as alike,
    list_dot_product(a.whole, r.whole)::bigint as score
  from vectors a join vectors r on a.vec_id % 100 = 0 and a.vec_id <> r.vec_id
), positives as (
  select anchor_id, vec_id as positive_id, score as positive_score
  from scored where alike
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
)
select anchor_id, positive_id,
  row_number() over (partition by anchor_id, positive_id order by score desc, vec_id)::int as rank,
  vec_id as negative_id, positive_score, score as negative_score
from positives join scored using (anchor_id)
where not alike and 80 * positive_score <= 100 * score and 100 * score <= 100 * positive_score
qualify row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) <= 5
"""

ORACLE: dict[str, str] = {
    "op7_warc_archive": WARC,
    "op10_quality_rules": QUALITY,
    "op11_hard_negatives": NEGATIVES,
}
