"""The queries of the training-data operators and, where SQL can express them, the same in DuckDB's SQL."""

from __future__ import annotations

from . import exact_dedup, langid, license_scan, line_dedup, mixing, packing, pii, quality, simhash, suffix_dedup
from .common import materialised, table

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def op1_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(spark, f"{sf_dir}/documents.parquet")


def op2_license_scans(spark, sf_dir):
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def op3_simhash(spark, sf_dir):
    return simhash.simhash(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op4_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "first_slot", "last_slot")


def op5_quality(spark, sf_dir):
    return quality.verdicts(quality.ledger(table(spark, sf_dir, "documents")))


def quality_ablations(spark, sf_dir):
    """What each rule of the current policy does alone, from the ledger as it is stored."""
    return quality.ablations(materialised(quality.ledger(table(spark, sf_dir, "documents")), "quality-ledger"))


def op6_language_id(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark, sf_dir):
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"))


def op8_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark, sf_dir):
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def op10_pii(spark, sf_dir):
    return pii.personal_data(table(spark, sf_dir, "documents"), redacted=False).drop("redacted")


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_exact_dedup, op2_license_scans, op3_simhash, op4_mixing, op5_quality, op6_language_id, op7_suffix_dedup, op8_packing, op9_line_dedup, op10_pii, pipeline, quality_ablations,
)}

# Sums, targets and positions in closed form; the slots of the schedule, and of each document the first and the last.
OP4 = rf"""
with sized as (select doc_id, source, len({WORDS})::bigint as size, row_number() over (partition by doc_id order by source) as copy from documents),
s as (select source, sum(size)::bigint as source_size from sized group by source),
w as (select *, row_number() over (order by source is null, source) - 1 as nth from s),
t as (select *, [5.0, 2.0, 1.0][nth % 3 + 1]::double as weight, source_size * 2.0::double as cap, sum(source_size) over () * 1.5::double as budget from w),
r as (select *, (budget - coalesce(sum(cap) over (order by cap / weight, nth rows between unbounded preceding and 1 preceding), 0)) / sum(weight) over (order by cap / weight, nth rows between current row and unbounded following) as rate from t),
k as (select arg_min(rate, (cap / weight, nth)) as rate from r where rate * weight <= cap),
plan as (select source, nth, source_size, case when k.rate is null then cap else least(cap, k.rate * weight) end as target from r, k),
cuts as (select *, ceil(target / {mixing.BLOCK})::bigint as slots, sum(target) over (order by nth) as upto, sum(target) over () as everything from plan),
points as (select i as slot, ((i % {mixing.SPAN}) * {mixing.STEP}) % {mixing.SPAN} as point from (select unnest(range((select sum(slots)::bigint from cuts))) as i)),
hits as (select nth, slots, slot, row_number() over (partition by nth order by slot) - 1 as rank from points join cuts on point >= (upto - target) / everything * {mixing.SPAN} and point < upto / everything * {mixing.SPAN}),
short as (select cuts.nth, slots, (select count(*) from hits where hits.nth = cuts.nth) as got from cuts),
late as (select nth, unnest(range(got, slots)) as rank from short where got < slots),
schedule as (select nth, rank, slot from hits where rank < slots union all select nth, rank, (select sum(slots)::bigint from cuts) + row_number() over (order by rank, nth) - 1 from late),
placed as (select doc_id, size, nth, source_size, target, round(target)::bigint as goal,
    (sum(size) over (partition by sized.source order by md5('7:' || doc_id || ':' || copy)))::bigint - size as start
    from sized join plan on sized.source is not distinct from plan.source),
mixed as (select *, greatest(0, least(start + size, goal) - start)::bigint as one, greatest(0, least(start + source_size + size, goal) - start - source_size)::bigint as two from placed)
select doc_id, size, source_size, target, one + two as taken, a.slot as first_slot, z.slot as last_slot from mixed
left join schedule a on a.nth = mixed.nth and one > 0 and a.rank = start // {mixing.BLOCK}
left join schedule z on z.nth = mixed.nth and one > 0 and z.rank = (case when two > 0 then start + source_size + two - 1 else start + one - 1 end) // {mixing.BLOCK}"""

OP5 = rf"""
with d as (select doc_id, coalesce(text, '') as t, {WORDS} as w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from documents),
one as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as i from d),
win as (select doc_id, i, word || ' ' || lead(word) over o || ' ' || lead(word, 2) over o as g from one window o as (partition by doc_id order by i)),
twice as (select doc_id, i from win where g is not null qualify count(*) over (partition by doc_id, g) > 1),
cover as (select doc_id, count(distinct p) as n from (select doc_id, unnest([i, i + 1, i + 2]) as p from twice) group by doc_id),
top as (select doc_id, max(n) as n from (select doc_id, word, count(*) as n from one group by all) group by doc_id),
m as (select doc_id, t, lines, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: len(x))), 0)::bigint as word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint as n_symbols,
    (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(cover.n, 0)::bigint as n_repeat_words, coalesce(top.n, 0) as most, len(regexp_extract_all(t, '\p{{L}}')) as letters
    from d left join cover using (doc_id) left join top using (doc_id)),
f as (select *, ((n_words < 50)::int + 2 * (100 * n_repeat_words > 50 * n_words)::int + case when n_words = 0 then 0 else
    4 * (not (word_chars between 2 * n_words and 15 * n_words))::int + 8 * (10 * n_symbols > 3 * n_words)::int + 16 * (2 * n_dup_lines > len(lines))::int + 32 * (2 * letters < word_chars)::int
    + 64 * (not regexp_matches(t, '[.!?。！？।؟…:;]'))::int + 128 * (10 * len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)\s*$'))) > 3 * len(lines))::int
    + 256 * (10 * most > 3 * n_words)::int + 512 * (10 * len(list_filter(lines, lambda x: regexp_matches(x, '^\s*[-*•‣▪]'))) > 9 * len(lines))::int + 1024 * (n_words > 1000000)::int end)::bigint as failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed, (failed & 3) <> 0 as base_failed, (failed & 47) = 0 and bit_count(failed & {quality.Policy.mask(quality.POLICIES[quality.CURRENT].soft)}) <= 1 as kept, 2 as policy from f"""

_POLICY = quality.POLICIES[quality.CURRENT]


def _keeps(without: str | None = None) -> str:
    hard, soft = (quality.Policy.mask(tuple(r for r in rules if r != without)) for rules in (_POLICY.rules, _POLICY.soft))
    return f"((failed & {hard}) = 0 and bit_count(failed & {soft}) <= {_POLICY.tolerated})"


ABLATIONS = f"with ledger as ({OP5}) " + " union all ".join(
    f"select '{r}' as rule, coalesce(sum((failed >> {quality.RULES[r]}) & 1), 0)::bigint as fails, count(*) filter ({_keeps(r)} and not {_keeps()}) as alone, coalesce(sum(n_words) filter ({_keeps(r)} and not {_keeps()}), 0)::bigint as words_alone from ledger"
    for r in (*_POLICY.rules, *_POLICY.soft))

# All windows of 50 bytes, as hexadecimal strings.
OP7 = """
with b as (select doc_id, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, '')))::bigint as n from documents),
win as (select doc_id, p, substr(h, 2 * p + 1, 100) as w from (select doc_id, h, unnest(range(0, greatest(n - 49, 0))) as p from b)),
gone as (select doc_id, p from win qualify min(doc_id) over (partition by w) < doc_id),
runs as (select doc_id, p, sum(new) over (partition by doc_id order by p) as run from (select *, case when p <= lag(p) over (partition by doc_id order by p) + 50 then 0 else 1 end as new from gone)),
spans as (select doc_id, min(p) as s, max(p) + 50 as e from runs group by doc_id, run),
kept as (select doc_id, s, e, coalesce(lag(e) over (partition by doc_id order by s), 0) as upto from spans),
text as (select k.doc_id, string_agg(substr(h, 2 * upto + 1, 2 * (s - upto)), '' order by s) || substr(any_value(h), 2 * max(e) + 1) as h, sum(e - s)::bigint as n_removed, count(*) as n_spans from kept k join b using (doc_id) group by k.doc_id)
select b.doc_id, b.n as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(text.h, b.h))) as kept_sha256 from b left join text using (doc_id)"""

# DuckDB's levenshtein counts bytes, so the letters of the test tables beyond ASCII become control characters first.
_LETTERS = "éèêçàüöäßñíóúáÉÈÊÇÀÜÖÄÑÍÓÚÁ"
_BYTES = "".join(map(chr, [*range(1, 9), *range(14, 14 + len(_LETTERS) - 8)]))
OP9 = f"""
with recursive l as (select doc_id, pos, translate(line, '{_LETTERS}', '{_BYTES}') as line from
    (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos from documents) where len(trim(line)) >= 20),
d as (select line, min((doc_id, pos)) as first from l group by line),
u as (select *, row_number() over (order by line) as i, len(line) as n from d),
keys as (select i, line, n, unnest([n, n - 1]) as k from u),
halves as (select i, line, n, k, 0 as side, substr(line, 1, k // 2) as half from keys union all select i, line, n, k, 1, right(line, k - k // 2) from keys),
near as (select distinct a.i as x, b.i as y from halves a join halves b on a.k = b.k and a.side = b.side and a.half = b.half and a.i <> b.i and (a.n = a.k or b.n = b.k) where levenshtein(a.line, b.line) <= 1),
reach as (select x, y from near union select reach.x, near.y from reach join near on reach.y = near.x),
class as (select u.i, u.line, u.first, least(u.first, coalesce(min(o.first), u.first)) as keep from u left join reach on reach.x = u.i left join u o on o.i = reach.y group by u.i, u.line, u.first),
gone as (select distinct doc_id, pos, first <> keep as near from l join class using (line) where (doc_id, pos) <> keep),
by_doc as (select doc_id, count(*) as n_dropped, sum(near::int)::bigint as n_near, string_agg(pos::varchar, ',' order by pos) as dropped from gone group by doc_id)
select d.doc_id, coalesce(len(string_split(text, chr(10))), 0)::bigint as n_lines, coalesce(n_dropped, 0)::bigint as n_dropped, coalesce(n_near, 0)::bigint as n_near, coalesce(dropped, '') as dropped
from documents d left join by_doc using (doc_id)"""

SQL = {
    "op1_exact_dedup": """
        select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size, doc_id = max(doc_id) over same as kept, text_sha256
        from (select doc_id, sha256(coalesce(text, '')) as text_sha256 from documents)
        window same as (partition by text_sha256)""",
    "op4_mixing": OP4,
    "op5_quality": OP5,
    "quality_ablations": ABLATIONS,
    "op7_suffix_dedup": OP7,
    "op9_line_dedup": OP9,
}
