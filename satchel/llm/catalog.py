"""The registered queries of the corpus operators, each over its whole table, and SQL where it can express them."""

from __future__ import annotations

from . import byte_cnn, column_bwt, crc_ring, feistel_shards, matroska, mixing, ngram_join, ordinal_toxicity, pii, prefix_trie, ratio_rules, suffix_decontam, warc
from .shared import table


def queries():
    return {
        "op1_warc_index": lambda spark, d: warc.archive_round_trip(table(spark, d, "pages")),
        "op2_ngram_join": lambda spark, d: ngram_join.components_by_similarity(table(spark, d, "documents")),
        "op3_entropy_mix": lambda spark, d: mixing.mix_report(table(spark, d, "documents")),
        "op4_training_order": lambda spark, d: feistel_shards.training_order(table(spark, d, "documents")),
        "op5_pii_spans": lambda spark, d: pii.pii_report(table(spark, d, "documents")),
        "op6_toxicity_grades": lambda spark, d: ordinal_toxicity.toxicity_scores(table(spark, d, "documents"), table(spark, d, "labels")),
        "op7_byte_cnn": lambda spark, d: byte_cnn.quality_scores(table(spark, d, "documents"), table(spark, d, "labels")),
        "op8_matroska": lambda spark, d: matroska.media_features(table(spark, d, "documents")),
        "op9_suffix_decontam": lambda spark, d: suffix_decontam.decontamination_report(table(spark, d, "documents"), table(spark, d, "benchmark")),
        "op10_column_bwt": lambda spark, d: column_bwt.repeats_report(table(spark, d, "documents")),
        "op11_ratio_rules": lambda spark, d: ratio_rules.quality_rules(table(spark, d, "documents"), table(spark, d, "labels")),
        "op12_prefix_trie": lambda spark, d: prefix_trie.prefix_trie(table(spark, d, "conversations")),
        "op13_crc_resampling": lambda spark, d: crc_ring.resampled(table(spark, d, "documents"), table(spark, d, "benchmark")),
    }


#: SHA-1 in base32: five hexadecimal digits are four letters.
_BASE32 = "array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(h, 5 * (i // 4) + 1, 5))::BIGINT) >> (5 * (3 - i % 4))) & 31)::INT, 1)), '')"

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Sets of three-word shingles, links by their overlaps, and the smallest id within reach.
_JOIN = rf"""
    with recursive d as (select doc_id, regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+') as w from documents),
    s as (select doc_id, list_distinct(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from d),
    one as (select doc_id, len(s) as n, unnest(s) as x from s),
    met as (select a.doc_id as i, b.doc_id as j, a.n + b.n as n, count(*) as m from one a join one b on a.x = b.x and a.doc_id < b.doc_id and 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) group by all),
    link as (select i, j from met where 100 * m >= 90 * (n - m)), both_ as (select i, j from link union all select j, i from link),
    reach as (select i, j from both_ union select r.i, b.j from reach r join both_ b on r.j = b.i)
    select s.doc_id, len(s)::bigint as n_shingles, least(s.doc_id, coalesce(min(j), s.doc_id)) as component_id
    from s left join reach on i = s.doc_id group by s.doc_id, s.s"""

#: Windows of the items that occur in documents; windows that follow each other in both are one verbatim match.
_DECON = rf"""
    with d as (select doc_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
    b as (select coalesce(item_id::varchar, '') as item, row_number() over () as it, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
    bq as (select item, it, w, least(10, len(w)) as n, unnest(range(1, len(w) - least(10, len(w)) + 2)) as q from b where len(w) > 0),
    bw as (select item, it, n, q, array_to_string(w[q:q + n - 1], ' ') as k from bq),
    dp as (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as p from d, (select distinct n from bw) where len(w) >= n),
    m as (select doc_id, item, it, n, p, q from (select doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') as k from dp) join bw using (n, k)),
    hit as (select doc_id, count(distinct h) as n_hit from (select doc_id, unnest(range(p, p + n)) as h from m) group by 1),
    said as (select doc_id, count(*) as n_items, sha256(string_agg(item, ',' order by item)) as items_sha256 from (select distinct doc_id, item from m) group by 1),
    run as (select doc_id, item, min(p) - 1 as p, count(*) + n - 1 as words from (select *, p - row_number() over (partition by doc_id, it, p - q order by p) as g from m) group by doc_id, item, it, n, p - q, g),
    best as (select doc_id, words, p, item from (select *, row_number() over (partition by doc_id order by words desc, p, item) as r from run) where r = 1)
    select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, coalesce(items_sha256, sha256('')) as items_sha256, n_hit is not null as contaminated,
           coalesce(words, 0)::bigint as longest, best.p::bigint as longest_at, best.item as longest_item
    from d left join hit using (doc_id) left join said using (doc_id) left join best using (doc_id)"""

#: All windows of 200 bytes (400 hexadecimal digits), and the runs of bytes that repeated ones cover.
_REPEATS = """
    with t as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
    w as (select doc_id, i, md5(substr(h, 2 * i + 1, 400)) as k from (select doc_id, h, unnest(range(0, len(h) // 2 - 199)) as i from t where len(h) >= 400)),
    twice as (select k from w group by k having count(*) > 1),
    r as (select doc_id, i, i > coalesce(lag(i) over (partition by doc_id order by i) + 200, -1) as new from w semi join twice using (k)),
    span as (select doc_id, min(i) as a, max(i) + 200 as z from (select doc_id, i, sum(new::int) over (partition by doc_id order by i) as g from r) group by doc_id, g),
    cut as (select doc_id, a, z, coalesce(lag(z) over (partition by doc_id order by a), 0) as f from span),
    kept as (select doc_id, sum(z - a) as gone, count(*) as n, max(z) as z, string_agg(substr(h, 2 * f + 1, 2 * (a - f)), '' order by a) as h from cut join t using (doc_id) group by doc_id)
    select doc_id, (len(t.h) // 2)::bigint as n_bytes, coalesce(gone, 0)::bigint as n_removed, coalesce(n, 0)::bigint as n_spans,
           sha256(unhex(coalesce(kept.h, '') || substr(t.h, 2 * coalesce(kept.z, 0) + 1))) as kept_sha256
    from t left join kept using (doc_id)"""


#: crc32 of the strings k of a table, by the usual table of 256 steps; c is unsigned.
_CRC = """
    tab as (select list(c order by i) as t from (select i, list_reduce(list_prepend(i, [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c from (select unnest(range(0, 256)) as i))),
    crc as (select k, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::bigint)), lambda c, b: xor(c >> 8, t[1 + xor(c & 255, b)]))) as c from (select k, hex(encode(k)) as h from keys), tab)"""

#: Counts of words, lines and windows; gains of one and two words at a time.  Labels of fewer than 20,000 good ids are all taken.
_RULES = rf"""
    with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
    u as (select r, unnest(w) as k, generate_subscripts(w, 1) as i from d),
    keys as (select distinct k from (select k from u union all select doc_id::varchar from labels where doc_id is not null)), {_CRC},
    good as (select doc_id from labels join crc on k = doc_id::varchar where quality in (0, 1) and c % 3 <> 1 group by doc_id having min(quality) = 1),
    one as (select r, i, c from u join crc using (k)),
    next as (select r, c, lead(c) over (partition by r order by i) as c2 from one),
    f as (select r, c % 16384 as b from one union all select r, (c * 31 + c2) % 16384 from next where c2 is not null),
    t as (select r from d semi join good using (doc_id)),
    n as (select b, count(*) as s, count(t.r) as t from f left join t using (r) group by b),
    every as (select sum(s)::double as s, sum(t)::double as t from n),
    gain as (select b, floor(1000 * ln((n.t + 1)::double * every.s / (n.s::double * every.t + every.s)))::bigint as gain from n, every),
    ratio as (select r, sum(gain)::bigint as ratio, count(*) as n_features from f join gain using (b) group by r),
    five as (select r, i, k || ' ' || lead(k, 1) over o || ' ' || lead(k, 2) over o || ' ' || lead(k, 3) over o || ' ' || lead(k, 4) over o as x from u window o as (partition by r order by i)),
    win as (select r, i, count(*) over (partition by r, x) as n from five where x is not null),
    twice as (select r, count(distinct p) as n_repeat_words from (select r, unnest(range(i, i + 5)) as p from win where n > 1) group by r),
    line as (select r, count(*) - count(distinct x) as n_dup_lines from (select r, unnest(string_split(text, chr(10))) as x from d) where regexp_matches(x, '[^\x20\x09-\x0D]') group by r),
    found as (select doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words, coalesce(ratio, 0)::bigint as ratio, coalesce(n_features, 0)::bigint as n_features
        from d left join ratio using (r) left join twice using (r) left join line using (r))
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed, not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and ratio >= -100 * n_features as kept, ratio, n_features from found"""

#: Rebuilt conversations as strings of 64 digits a turn; nodes are their beginnings, subtrees those that begin alike.
_TRIE = rf"""
    with t as (select conv_id, row_number() over (partition by conv_id order by turn nulls first, role, text) - 1 as p, role, text from (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null)),
    keys as (select distinct conv_id::varchar as k from t), {_CRC},
    c as (select k::bigint as conv_id, c % 6 as h from crc),
    r as (select conv_id, p, role, text from t join c using (conv_id) where p >= h union all select c.conv_id, p, role, text from c join t on t.conv_id = c.conv_id - c.conv_id % 100 where p < h),
    path as (select conv_id, length(text) as chars, row_number() over o as depth, string_agg(md5(role) || md5(text), '') over o as k from r window o as (partition by conv_id order by p)),
    every as (select conv_id, chars, depth, k from path union all select conv_id, 0, 0, '' from c),
    node as (select k, min(conv_id) as conv_id, any_value(depth) as depth, any_value(chars) as chars, count(*) as n from every group by k),
    last as (select conv_id, max_by(k, depth) as k from every group by conv_id),
    sha as (select k, sha256(string_agg(conv_id::varchar, ',' order by conv_id)) as s from last group by k),
    kids as (select substr(k, 1, length(k) - 64) as k, count(*) as n_children from node where depth > 0 group by 1),
    low as (select node.*, coalesce(n_children, 0) as n_children from node left join kids using (k)),
    up as (select a.k, sum((z.n_children = 0)::int) as n_leaves, sum((z.n - 1) * z.chars) as saved from (select k, unnest(range(0, depth + 1)) as d from low) as x join low z on z.k = x.k join low a on a.k = substr(x.k, 1, 64 * x.d) group by a.k)
    select low.conv_id, low.depth, p.conv_id as parent_conv_id, low.n::bigint as n_convs, low.n_children::bigint as n_children, n_leaves::bigint as n_leaves, saved::bigint as saved_tokens, coalesce(s, sha256('')) as ends_sha256
    from low left join node p on low.depth > 0 and p.k = substr(low.k, 1, 64 * (low.depth - 1)) left join up on up.k = low.k left join sha on sha.k = low.k"""

#: Words of documents and target by bucket, gains, keyed Gumbel noise, and the places of the tenth that is drawn.
_RESAMPLED = rf"""
    with d as (select row_number() over () as r, doc_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
    f as (select r, unnest(w) as k from d),
    g as (select unnest(regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as k from benchmark),
    keys as (select distinct k from (select k from f union all select k from g)), {_CRC},
    s as (select c % 10000 as b, count(*) as s from f join crc using (k) group by 1),
    t as (select c % 10000 as b, count(*) as t from g join crc using (k) group by 1),
    n as (select (select count(*) from f)::double as s, (select count(*) from g)::double as t),
    gain as (select s.b, floor(1000 * ln((coalesce(t.t, 0) + 1)::double * (n.s + 10000) / ((s.s + 1)::double * (n.t + 10000))))::bigint as gain from s left join t using (b), n),
    weight as (select r, sum(gain)::bigint as weight from f join crc using (k) join gain on b = c % 10000 group by r),
    scored as (select d.doc_id, len(w)::bigint as n_features, coalesce(weight, 0)::bigint as weight, ('0x' || substr(sha256('2024:' || coalesce(d.doc_id::varchar, '')), 1, 8))::bigint as h from d left join weight using (r)),
    full_ as (select doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::bigint as score from scored),
    placed as (select *, row_number() over (order by score desc, doc_id nulls first, n_features, weight) as place, count(*) over () as n from full_ where n_features >= 20)
    select doc_id, n_features, weight, score, case when place <= n // 10 then place end as rank from placed
    union all select doc_id, n_features, weight, score, null from full_ where n_features < 20"""


def oracle_sql():
    return {
        "op1_warc_index": f"""
            with p as (select page_id, coalesce(html, '') as b, sha1(coalesce(html, '')) as h from pages),
            g as (select h, max(page_id) as last from p group by h)
            select page_id, strlen(b)::BIGINT as payload_bytes, {_BASE32} as payload_digest,
                   case when page_id is distinct from last then 'revisit' else 'response' end as record_type,
                   case when page_id is distinct from last then last end as refers_to
            from p join g using (h)""",
        "op2_ngram_join": _JOIN,
        "op9_suffix_decontam": _DECON,
        "op10_column_bwt": _REPEATS,
        "op11_ratio_rules": _RULES,
        "op12_prefix_trie": _TRIE,
        "op13_crc_resampling": _RESAMPLED,
    }
