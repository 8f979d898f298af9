"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

from hopframe.llm.licenses import default_templates

WORD = r"[^\x20\x09-\x0D]+"
LICENSE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def quality_rules() -> str:
    return rf"""
with d as (
  select row_number() over (order by doc_id) as rid, doc_id, source as host, coalesce(text, '') as text,
         regexp_extract_all(coalesce(text, ''), '{WORD}') as words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as lines
  from documents),
windows as (
  select rid, i, list_slice(words, i, i + 4) as w
  from (select rid, words, unnest(range(1, len(words) - 3)) as i from d where len(words) >= 5)),
twice as (select rid, w from windows group by rid, w having count(*) > 1),
repeated as (
  select rid, count(distinct i + k) as n
  from windows join twice using (rid, w) cross join range(0, 5) r(k) group by rid),
split as (
  select rid, host, text, regexp_extract_all(unnest(lines), '{WORD}') as lw from d),
norm as (
  select rid, host, text, lower(array_to_string(lw, ' ')) as h, sum(len(lw)) as n from split group by rid, host, text, h),
per_line as (
  select host, h, count(distinct text) as documents, min(rid) as first_rid from norm group by host, h
  having count(distinct text) > 20),
hosts as (select host, count(distinct text) as host_documents from d group by host),
frequent as (
  select p.host, h, first_rid from per_line p join hosts t on p.host is not distinct from t.host
  where documents > 0.005 * host_documents),
removed as (
  select rid, sum(n) as removed from norm n join frequent f on n.host is not distinct from f.host and n.h = f.h
  where rid <> first_rid group by rid),
counts as (
  select rid, doc_id, len(words) as n_words, length(array_to_string(words, '')) as word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
         len(lines) - len(list_distinct(lines)) as n_dup_lines,
         coalesce(r.n, 0) as n_repeat_words, coalesce(removed, 0) as n_removed_words
  from d left join repeated r using (rid) left join removed using (rid))
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols,
       n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words,
       n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
       not (n_words < 10 or 100 * n_repeat_words > 20 * n_words)
         and n_words - n_removed_words >= 0.2 * n_words as kept,
       n_removed_words::bigint as n_removed_words
from counts"""


def license_scans(min_coverage=0.75, max_stretch=1.5, slack=2) -> str:
    rows = []
    for number, (phrase, label, base) in enumerate(default_templates()):
        parts = phrase.split()
        rows += [f"({number}, '{label}', {str(base).lower()}, {len(parts) - 1}, {t}, '{a}', '{b}')"
                 for t, (a, b) in enumerate(zip(parts, parts[1:]))]
    return rf"""
with tpl(template, label, is_base, n_pairs, t, a, b) as (values {', '.join(rows)}),
d as (
  select row_number() over (order by doc_id) as rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{LICENSE_WORD}') as words
  from documents),
pairs as (
  select rid, i, words[i + 1] as a, words[i + 2] as b
  from (select rid, words, unnest(range(0, len(words) - 1)) as i from d where len(words) > 1)),
votes as (
  select rid, template, label, is_base, n_pairs, i - t as diagonal, list(distinct t) as found
  from pairs join tpl using (a, b) group by all),
fresh as (
  select *, coalesce((diagonal - lag(diagonal) over o > {slack})::int, 0) as fresh
  from votes window o as (partition by rid, template order by diagonal)),
islands as (
  select *, sum(fresh) over (partition by rid, template order by diagonal) as island from fresh),
spans as (
  select rid, template, label, is_base, n_pairs, island,
         min(diagonal + list_min(found)) as start, max(diagonal + list_max(found) + 1) as stop,
         len(list_distinct(flatten(list(found)))) / n_pairs as coverage,
         coalesce(list(diagonal) filter (where len(found) = n_pairs), []) as places
  from islands group by rid, template, label, is_base, n_pairs, island),
judged as (
  select *, len(places) > 0 or (coverage >= {min_coverage} and stop - start + 1 <= {max_stretch} * (n_pairs + 1)) as ok
  from spans),
per_doc as (
  select rid, coalesce(sum(len(places)) filter (where is_base), 0) as n_base,
         min(list_min(places)) filter (where is_base) as first_word,
         max(list_max(places)) filter (where is_base) as last_word,
         string_agg(distinct label, ',' order by label) filter (where is_base and len(places) > 0) as base_labels,
         string_agg(distinct label, ',' order by label) filter (where ok) as labels,
         max(coverage) as score
  from judged group by rid)
select doc_id, len(words)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word,
       last_word::bigint as last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels,
       coalesce(score, 0.0)::double as score
from d left join per_doc using (rid)"""


def mixing(weights=(3.0, 1.0, 2.0), share=1.5, cap=2.0, seed=7, block=32, shard_documents=5000) -> str:
    def hexes(text, chars):
        return f"('0x' || substr(md5({text}), 1, {chars}))::bigint"

    return rf"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::bigint as size from documents),
shape as (select greatest(1, ceil(count(*) / {shard_documents}))::bigint as n_shards from sized),
keyed as (select *, concat_ws(':', '{seed}', doc_id, size) as k from sized),
spread as (select doc_id, source, size, md5(k) as ord, {hexes('k', 8)} % n_shards as shard from keyed, shape),
shards as (select source, shard, sum(size)::bigint as shard_size from spread group by all),
per_source as (select source, sum(shard_size)::bigint as source_size from shards group by all),
ranked as (
  select *, ([{', '.join(str(float(w)) for w in weights)}])[
           (((row_number() over (order by source is null, source)) - 1) % {len(weights)} + 1)::int] as weight,
         {cap} * source_size as lim, {share} * sum(source_size) over () as budget
  from per_source),
levels as (
  select *, lim / weight as ratio,
         (budget - coalesce(sum(lim) over (order by lim / weight, source is null, source
                                           rows between unbounded preceding and 1 preceding), 0))
         / sum(weight) over (order by lim / weight, source is null, source
                             rows between current row and unbounded following) as level
  from ranked),
aimed as (
  select source, source_size,
         least(lim, coalesce(max(case when level <= ratio then level end) over () * weight, lim)) as target from levels),
seats as (select round(sum(target) / {block})::bigint as n from aimed),
dealt as (
  select source, count(*) as quota from (
    select source, row_number() over (order by target / (2 * k - 1) desc, source is null, source) as place, n
    from (select source, target, unnest(range(1, n + 1)) as k, n from aimed, seats where target > 0))
  where place <= n group by source),
to_shards as (
  select h.source, shard, shard_size, a.source_size, a.target, coalesce(q.quota, 0) as source_quota
  from shards h join aimed a on h.source is not distinct from a.source
  left join dealt q on h.source is not distinct from q.source),
shard_seats as (
  select source, shard, count(*) as quota from (
    select source, shard, source_quota,
           row_number() over (partition by source order by shard_size / (2 * k - 1) desc, shard) as place
    from (select source, shard, shard_size, source_quota, unnest(range(1, source_quota + 1)) as k
          from to_shards where shard_size > 0))
  where place <= source_quota group by source, shard),
quotas as (
  select t.source, t.shard, shard_size, source_size, target, ceil(shard_size / {block})::bigint as blocks,
         least(coalesce(quota, 0), ({cap} * ceil(shard_size / {block}))::bigint) as quota,
         floor({hexes(f"concat_ws(':', '{seed}', coalesce(t.source, chr(0)), t.shard)", 12)} / 281474976710656.0
               * ceil(shard_size / {block}))::bigint as from_block
  from to_shards t left join shard_seats s on t.source is not distinct from s.source and t.shard = s.shard),
runs as (
  select *, quota // greatest(blocks, 1) as rounds, from_block * {block} as run_start,
         (from_block + quota - (quota // greatest(blocks, 1)) * blocks) * {block} as run_stop, blocks * {block} as axis
  from quotas),
placed as (
  select *, sum(size) over (partition by source, shard order by ord, doc_id
                            rows between unbounded preceding and current row) as stop
  from spread)
select p.doc_id, p.size, source_size, target,
       (rounds * p.size + greatest(0, least(stop, run_stop) - greatest(stop - p.size, run_start))
        + greatest(0, least(stop, run_stop - axis) - (stop - p.size)))::bigint as taken
from placed p join runs r on p.source is not distinct from r.source and p.shard = r.shard"""


# One row with the 256 steps of the checksum, made by its rule.
CRC_STEPS = """crc_steps as (
  select list_transform(range(0, 256), lambda i: list_reduce(
    range(0, 8), lambda c, k: if(c & 1 = 1, xor(c >> 1, 3988292384), c >> 1), i)) as steps)"""


def crc32(hexes: str) -> str:
    """Unsigned crc32 of bytes given as hex digits, with ``steps`` in scope."""
    return f"""xor(list_reduce(
      list_transform(range(0, length({hexes}) // 2), lambda i: ('0x' || substr({hexes}, (2 * i + 1)::bigint, 2))::bigint),
      lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"""


def resampling(buckets=10_000, seed=2024, percent=10, min_words=20) -> str:
    def features(source: str) -> str:
        return f"""regexp_extract_all(translate(coalesce({source}, ''), '{UPPER}', '{LOWER}'), '{LICENSE_WORD}')"""

    return rf"""
with {CRC_STEPS},
d as (select row_number() over () as rid, doc_id, {features('text')} as words from documents),
w as (select rid, unnest(words) as w from d),
b as (select unnest({features('text')}) as w from benchmark),
vocabulary as (select w, hex(encode(w)) as x from (select w from w union select w from b)),
codes as (select w, {crc32('x')} % {buckets} as bucket from vocabulary, crc_steps),
s as (select bucket, count(*) as s from w join codes using (w) group by bucket),
t as (select bucket, count(*) as t from b join codes using (w) group by bucket),
counts as (
  select n.bucket, coalesce(s, 0)::double as s, coalesce(t, 0)::double as t
  from range(0, {buckets}) n(bucket) left join s using (bucket) left join t using (bucket)),
gains as (
  select bucket, floor(1000 * ln((t + 1) * ((sum(s) over ()) + {buckets})
                                 / ((s + 1) * ((sum(t) over ()) + {buckets}))))::bigint as gain from counts),
weights as (
  select rid, floor(sum(gain)::double / count(*))::bigint as weight
  from w join codes using (w) join gains using (bucket) group by rid),
scored as (
  select rid, doc_id, len(words)::bigint as n_features, coalesce(weight, 0) as weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{seed}:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint
                                                + 0.5::double) / 4294967296)))::bigint as score
  from d left join weights using (rid)),
ranked as (
  select rid, row_number() over (order by score desc, doc_id nulls last, n_features) as place, count(*) over () as n
  from scored where n_features >= {min_words})
select doc_id, n_features, weight, score, case when place <= {percent} * n // 100 then place end as rank
from scored left join ranked using (rid)"""


def merkle() -> str:
    def enc(value: str) -> str:
        return f"coalesce(octet_length(encode({value}::varchar))::varchar || ':' || {value}::varchar, '-')"

    def leaf(n_chars: str) -> str:
        return "sha256(" + " || ".join(map(enc, ("doc_id", "source", "lang", n_chars, "text"))) + ")"

    return rf"""
with recursive {CRC_STEPS},
d as (
  select doc_id, lang, {leaf('n_chars')} as leaf,
         case when {crc32('hex(encode(doc_id::varchar))')} % 7 = 0 then {leaf('(n_chars + 1)')} end as tampered
  from documents, crc_steps),
p as (
  select *, row_number() over () as rid, dense_rank() over (order by lang nulls first) - 1 as tree,
         row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as spot from d),
up as (
  select tree, 0 as level, spot, leaf as node, count(*) over (partition by tree) as n from p
  union all
  select tree, level + 1, spot // 2, sha256(string_agg(node, '' order by spot)), (n + 1) // 2
  from up where n > 1 group by tree, level, spot // 2, n),
subroots as (select tree, node as subroot, max(level) over (partition by tree) as height from up where n = 1),
top as (
  select 0 as level, tree as spot, subroot as node, count(*) over () as n from subroots
  union all
  select level + 1, spot // 2, sha256(string_agg(node, '' order by spot)), (n + 1) // 2
  from top where n > 1 group by level, spot // 2, n),
top_places as (
  select tree, level, tree // (1::bigint << level) as spot from subroots, (select distinct level from top where n > 1)),
runs as (
  select tree, level, spot // 2 as parent, coalesce(max(node) filter (spot % 2 = 0), '') as c0,
         coalesce(max(node) filter (spot % 2 = 1), '') as c1
  from up where n > 1 group by all
  union all
  select t.tree, s.height + t.level, parent, c0, c1
  from (select level, spot // 2 as parent, coalesce(max(node) filter (spot % 2 = 0), '') as c0,
               coalesce(max(node) filter (spot % 2 = 1), '') as c1 from top where n > 1 group by all) r
  join (select s.tree, t.level, t.spot // 2 as parent from subroots s join top_places t using (tree)) t using (level, parent)
  join subroots s using (tree)),
steps as (
  select rid, r.level, case when level_at % 2 = 0 then '' else c0 end as lft, case when level_at % 2 = 0 then c1 else '' end as rgt
  from (select p.rid, p.tree, l.level,
               case when l.level < s.height then p.spot // (1::bigint << l.level)
                    else p.tree // (1::bigint << (l.level - s.height)) end as level_at
        from p join subroots s using (tree) join (select distinct tree, level from runs) l using (tree)) q
  join runs r on r.tree = q.tree and r.level = q.level and r.parent = q.level_at // 2),
proofs as (select rid, sha256(string_agg(lft || rgt, '' order by level)) as proof from steps group by rid),
folds as (
  select rid, 0 as level, coalesce(tampered, leaf) as node from p
  union all
  select rid, f.level + 1, sha256(lft || node || rgt) from folds f join steps using (rid, level)),
folded as (select rid, arg_max(node, level) as folded_root from folds group by rid)
select doc_id, leaf, subroot, t.node as root, coalesce(proof, sha256('')) as proof_sha256, folded_root,
       folded_root = t.node as verified
from p join subroots using (tree) join (select node from top where n = 1) t on true
left join proofs using (rid) join folded using (rid)"""


SQL = {
    "op4_license_scans": license_scans(),
    "op6_mixing": mixing(),
    "op8_quality_rules": quality_rules(),
    "op11_resampling": resampling(),
    "op12_merkle": merkle(),
}
