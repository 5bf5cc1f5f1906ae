"""DuckDB SQL of the queries that SQL can express."""

#: Words are runs of anything but blanks; windows of eight words are compared whole.
OP8 = r"""
with d as (
  select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w
  from documents),
win as (
  select doc_id, i, array_to_string(w[i:i + 7], ' ') as x
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 6, 1))) as i from d)),
twice as (
  select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, x) as n from win) where n > 1),
cover as (
  select doc_id, sum(least(8, coalesce(nxt - i, 8))) as n_repeat_words
  from (select doc_id, i, lead(i) over (partition by doc_id order by i) as nxt from twice) group by doc_id),
m as (
  select d.doc_id, len(w)::bigint as n_words,
    coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint as n_symbols,
    len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))::bigint
      - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))))::bigint as n_dup_lines,
    coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
    len(string_split(t, chr(10))) as n_lines,
    len(regexp_extract_all(t, '\p{Lu}')) as n_upper, len(regexp_extract_all(t, '\p{L}')) as n_letters
  from d left join cover using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 20 or 100 * n_repeat_words > 30 * n_words) as base_failed,
  not (n_words < 20 or n_symbols * 10 > n_words * 3 or word_chars > n_words * 20 or word_chars < n_words * 2
    or n_upper * 2 > n_letters or n_dup_lines * 10 > n_lines * 5 or n_repeat_words * 100 > n_words * 30) as kept
from m
"""

OP7 = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
    ('0x' || substr(md5('mix:17:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint as u
  from documents),
s as (
  select source, source_size, [5.0::double, 2.0::double, 1.0::double][(row_number() over (order by source asc nulls last) - 1) % 3 + 1] as weight
  from (select source, sum(size)::bigint as source_size from d group by source)),
c as (select *, source_size * 2.0::double as cap, sum(source_size) over ()::double as everything from s),
l as (
  select *, (everything * 1.5::double - coalesce(sum(cap) over before, 0)) / (sum(weight) over () - coalesce(sum(weight) over before, 0)) as level
  from c window before as (order by cap / weight, weight, cap rows between unbounded preceding and 1 preceding)),
t as (
  select source, source_size, coalesce(least(cap, max(case when level * weight <= cap then level end) over () * weight), cap) as target from l),
f as (
  select *, case when source_size > 0 then floor(target / source_size) else 0 end::bigint as whole from t),
r as (
  select d.doc_id, d.size, d.u, f.source_size, f.target, f.whole, f.target - f.whole * f.source_size as rest,
    sum(d.size) over (partition by d.source order by d.u range between unbounded preceding and current row) as upto,
    sum(d.size) over (partition by d.source, d.u) as own
  from d join f on d.source is not distinct from f.source)
select doc_id, size, source_size, target, (size * (whole + case when rest > 0 and upto - own / 2.0::double <= rest then 1 else 0 end))::bigint as taken
from r
"""

#: Letters of more than one byte that the tables hold, each for a control character: DuckDB's distance counts bytes.
_LETTERS = "èéêçÉÈÊÇöäüßÄÖÜóíñÓÍÑáÁúÚàâî"
_BYTES = " || ".join(f"chr({i})" for i in (*range(1, 9), 11, 12, *range(14, 32)))


def op9(edits: int) -> str:
    """A line within some edits of another keeps one of that many parts and one more, moved by as many places at most; ids are unique here."""
    p = edits + 1
    return rf"""
with l as (
  select doc_id, i - 1 as line_no, line, length(line) as n
  from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from documents)
  where length(line) >= 20),
f as (select line, n, row_number() over (order by line) as id, min(struct_pack(doc_id := doc_id, line_no := line_no)) as p from l group by line, n),
own as (
  select id, n as m, part, substring(line, (n * part // {p})::bigint + 1, (n * (part + 1) // {p} - n * part // {p})::bigint) as x
  from f, (select unnest(range({p})) as part)),
met as (
  select id, m, part, substring(line, (m * part // {p} + shift)::bigint + 1, (m * (part + 1) // {p} - m * part // {p})::bigint) as x
  from (select id, line, n, n - less as m, part, shift from f, (select unnest(range({p})) as less), (select unnest(range({p})) as part), (select unnest(range(-{edits}, {p})) as shift))
  where m * part // {p} + shift >= 0 and m * (part + 1) // {p} + shift <= n),
pairs as (select distinct least(met.id, own.id) as u, greatest(met.id, own.id) as v from met join own using (m, part, x) where met.id <> own.id),
near as (
  select distinct case when a.p < b.p then b.line else a.line end as line
  from pairs join f a on a.id = u join f b on b.id = v
  where levenshtein(translate(a.line, '{_LETTERS}', {_BYTES}), translate(b.line, '{_LETTERS}', {_BYTES})) <= {edits}),
gone as (
  select l.doc_id, list(l.line_no) as g from l join f on l.line = f.line left join near on l.line = near.line
  where near.line is not null or l.doc_id <> f.p.doc_id or l.line_no <> f.p.line_no group by l.doc_id),
t as (
  select d.doc_id, d.text is null as absent, coalesce(len(g), 0)::bigint as lines_gone,
    case when g is null then d.text else
      coalesce(array_to_string(list_filter(string_split(d.text, chr(10)), lambda x, i: not list_contains(g, i - 1)), chr(10)), '') end as text
  from documents d left join gone on d.doc_id = gone.doc_id)
select doc_id, lines_gone, len(string_split(coalesce(text, ''), chr(10)))::bigint as n_lines, length(text)::bigint as n_chars, sha256(text) as text_sha256
from t
"""


#: All scores of the anchors; components in whole steps are exact in doubles.
OP11 = """
with e as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id as anchor_id, b.vec_id as row_id, a.label = b.label as same, list_inner_product(a.v, b.v)::bigint as score
  from e a join e b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
p as (
  select anchor_id, row_id as positive_id, score as positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, row_id) <= 5),
n as (
  select p.*, row_id as negative_id, score as negative_score, row_number() over (partition by p.anchor_id, positive_id order by score desc, row_id)::int as rank
  from p join s on p.anchor_id = s.anchor_id and not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= 10
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Checksums by the usual table of 256 remainders, made here by eight shifts each; buckets and counts over distinct features.
OP13 = rf"""
with step as (
  select b, list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384::bigint) else c >> 1 end, b::bigint) as c from range(256) r(b)),
tab as (select list(c order by b) as tab from step),
texts as (select doc_id, coalesce(text, '') as text, true as own from documents union all select null, coalesce(text, ''), false from benchmark),
w as (select doc_id, own, row_number() over () as k, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from texts),
f as (
  select k, own, f, count(*) as n
  from (select k, own, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as f from w) group by all),
hexed as (select f, hex(encode(f)) as h from (select distinct f from f)),
bytes as (select f, list_transform(range(1, len(h) // 2 + 1), lambda i: ('0x' || substring(h, 2 * i - 1, 2))::bigint) as x from hexed),
crc as (select f, xor(list_reduce(x, lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295::bigint), 4294967295::bigint) % 10000 as bucket from bytes, tab),
counts as (select bucket, coalesce(sum(n) filter (own), 0) as s, coalesce(sum(n) filter (not own), 0) as t from f join crc using (f) group by bucket),
every as (select coalesce(sum(s), 0)::double as s, coalesce(sum(t), 0)::double as t from counts),
gain as (select bucket, floor(1000 * ln((c.t + 1)::double * (e.s + 10000) / ((c.s + 1)::double * (e.t + 10000)))) as gain from counts c, every e),
mean as (select k, sum(n)::bigint as n_features, floor(sum(n * gain) / sum(n))::bigint as weight from f join crc using (f) join gain using (bucket) where own group by k),
d as (
  select doc_id, coalesce(n_features, 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight, len(w) >= 20 as drawable,
    (('0x' || substring(sha256('7:' || doc_id), 1, 8))::bigint + 0.5::double) / 4294967296 as u
  from w left join mean using (k) where own),
s as (select *, weight + floor(-1000 * ln(-ln(u)))::bigint as score from d),
r as (select *, row_number() over (partition by drawable order by score desc, doc_id) as place, 25 * count(*) over (partition by drawable) // 100 as drawn from s)
select doc_id, n_features, weight, score, case when drawable and place <= drawn then place end as rank from r
"""


SQL: dict[str, str] = {"op9_line_dedup": op9(1), "op8_quality_rules": OP8, "op7_mix_sources": OP7, "op11_hard_negatives": OP11, "op13_importance_resampling": OP13}
