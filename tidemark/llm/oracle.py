"""DuckDB SQL for the queries of this subpackage that SQL can express.

The trained models, the packing and the hash functions of sketches have no SQL;
their queries are tested against plain versions instead. License templates and
kinds of secrets are taken from their modules, as parameters; the search, the
voting and the linking are written out here.
"""

from __future__ import annotations

import re

from .license_scan import NOTICES, PHRASES, Scan
from .secrets import KINDS, SCOPE

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_NEAR_DUP = rf"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
    sets as (select doc_id, case when len(w) >= 2 then list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) when len(w) = 1 then w else [] end as s from w),
    each as (select doc_id, unnest(s) as g from sets), n as (select doc_id, len(s) as n from sets),
    pairs as (select a.doc_id as x, b.doc_id as y, count(*) as shared from each a join each b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
    links as (select x, y from pairs join n p on p.doc_id = x join n q on q.doc_id = y where 100 * shared >= 80 * (p.n + q.n - shared)),
    reach as (select doc_id as x, doc_id as y from sets union select reach.x, links.y from reach join links on links.x = reach.y)
    select n.doc_id, n.n as n_shingles, min(reach.y) as component_id, n.doc_id = min(reach.y) as kept from n join reach on reach.x = n.doc_id group by 1, 2"""

_RULES = rf"""with d as (select doc_id, coalesce(text, '') as text, {WORDS} as w from documents),
    lines as (select doc_id, unnest(string_split(text, chr(10))) as line from d),
    l as (select doc_id, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines from lines where regexp_matches(line, '[^\x20\x09-\x0D]') group by 1),
    starts as (select doc_id, w, unnest(range(1, len(w) - 6)) as i from d), grams as (select doc_id, i, w[i:i + 7] as g from starts),
    again as (select doc_id, i, count(*) over (partition by doc_id, g) as n from grams),
    r as (select doc_id, count(distinct p) as n_repeat_words from (select doc_id, unnest(range(i, i + 8)) as p from again where n > 1) group by 1),
    m as (select d.doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars, (length(text) - length(translate(text, '#*$%&|<>', '')))::bigint as n_symbols,
        coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_lines, 0) as n_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words from d left join l using (doc_id) left join r using (doc_id)),
    f as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed, (case when n_words < 20 then 1 else 0 end + case when 100 * n_repeat_words > 30 * n_words then 2 else 0 end + case when 10 * n_symbols > word_chars then 4 else 0 end
        + case when 100 * n_dup_lines > 30 * n_lines then 8 else 0 end + case when word_chars > 20 * n_words then 16 else 0 end + case when word_chars < 2 * n_words then 32 else 0 end)::bigint as failed_bits from m)
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, failed_bits = 0 as kept, failed_bits from f"""

_MIX = rf"""with recursive d as (select doc_id, source, len({WORDS})::bigint as size from documents),
    s as (select source, sum(size)::bigint as source_size, (row_number() over (order by source nulls last) - 1) % 3 + 1 as weight from d group by 1),
    rounds as (select 0 as step, 0.0::double as share, -1::bigint as capped union all
        select step + 1, n.more, n.full from rounds, lateral (select count(*) filter (where 3 * source_size <= rounds.share * weight) as full,
            (sum(source_size) - coalesce(sum(3 * source_size) filter (where 3 * source_size <= rounds.share * weight), 0))::double / sum(weight) filter (where not (3 * source_size <= rounds.share * weight)) as more from s) n
        where n.full <> rounds.capped and n.more is not null),
    last as (select share from rounds order by step desc limit 1),
    t as (select source, source_size, least(3.0 * source_size, share * weight) as target from s, last),
    r as (select doc_id, size, source_size, target, row_number() over (partition by d.source order by size, doc_id) - 1 as rank,
        round(case when source_size > 0 then target / source_size else 0 end * 16777216)::bigint as e, ('0x' || left(md5(coalesce(d.source, '')), 6))::bigint as o from d join t on d.source is not distinct from t.source)
    select doc_id, size, source_size, round(target, 6) as target, (((rank * e + o + e) >> 24) - ((rank * e + o) >> 24)) * size as taken from r"""

_WARC = """with p as (select page_id, coalesce(html, '') as html from pages), h as (select page_id, strlen(html)::bigint as payload_bytes, sha256(html) as payload_digest, min(page_id) over (partition by html) as first from p)
    select page_id, payload_bytes, payload_digest, case when payload_bytes >= 100 and first < page_id then 'revisit' else 'response' end as record_type,
        case when payload_bytes >= 100 and first < page_id then first end as refers_to from h"""

_HARD_NEGATIVES = """with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as q from embeddings
        where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    scored as (select a.vec_id as anchor_id, a.label = c.label as same, c.vec_id, list_sum(list_transform(list_zip(a.q, c.q), lambda p: p[1] * p[2]))::bigint as score
        from v a join v c on a.vec_id % 50 = 0 and (a.vec_id <> c.vec_id or a.label <> c.label)),
    positive as (select anchor_id, vec_id as positive_id, score as positive_score from scored where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
    select p.anchor_id, positive_id, row_number() over (partition by p.anchor_id, positive_id order by score desc, vec_id)::int as rank, vec_id as negative_id, positive_score, score as negative_score
    from positive p join scored s on s.anchor_id = p.anchor_id and not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score qualify rank <= 3"""

_LINE_DEDUP = r"""with l as (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents), place as (select doc_id, lines, unnest(range(1, len(lines) + 1)) as i from l),
    k as (select doc_id, i, lines[i] as line, translate(regexp_replace(lines[i], '^[ 	-]+|[ 	-]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from place),
    j as (select *, length(key) >= 10 and min(doc_id) over (partition by key) < doc_id as gone from k)
    select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) as kept_sha256 from j group by 1"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _secrets() -> str:
    each = " union all ".join(
        f"select r, {i} as kind, regexp_extract_all(text, {_quoted(k.pattern)}, 0) as m, regexp_extract_all(text, {_quoted(k.pattern)}, {k.group}) as c, regexp_split_to_array(text, {_quoted(k.pattern)}) as gaps from d where regexp_matches(text, {_quoted(k.pattern)})"
        for i, k in enumerate(KINDS)
    )
    of = lambda f: "[" + ", ".join(map(f, KINDS)) + "]"  # noqa: E731
    parts, strong, names = of(lambda k: _quoted(k.part)), of(lambda k: str(k.strong).lower()), of(lambda k: _quoted(k.name))
    listed = f"coalesce(string_agg(({names})[kind + 1] || ':' || start || ':' || stop, ',' order by start, kind, stop)"
    return f"""with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents), found as ({each}),
    places as (select r, kind, unnest(list_transform(range(1, len(m) + 1), lambda i: {{'start': (coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::bigint, 'size': length(m[i]), 'checked': length(c[i])}})) as s from found),
    kept as (select r, kind, s.start as start, s.start + s.size as stop, ({parts})[kind + 1] as part, ({strong})[kind + 1] as strong from places where s.checked between ({of(lambda k: str(k.least))})[kind + 1] and ({of(lambda k: str(k.most))})[kind + 1]),
    met as (select w.r, w.kind, w.start, w.stop, w.part, bool_or(o.part = 'secret') as secret, bool_or(o.part = 'identifier') as identifier, bool_or(o.part = 'endpoint') as endpoint
        from kept w join kept o on o.r = w.r and o.part <> w.part and greatest(o.start - w.stop, w.start - o.stop) <= {SCOPE} where not w.strong group by all),
    spans as (select r, kind, start, stop from kept where strong union all select r, kind, start, stop from met where case part when 'endpoint' then secret and identifier when 'secret' then identifier or endpoint else secret end)
    select doc_id, count(*) filter (where kind = 0) as n_assign, count(*) filter (where kind = 1) as n_access, count(*) filter (where kind = 2) as n_hex, sha256({listed} filter (where kind < 3), '')) as base_sha256, {listed}, '') as spans
    from d left join spans using (r) group by r, doc_id"""


def _licenses(scan: Scan) -> str:
    texts = [(label, phrase, "true") for phrase, label in PHRASES.items()] + [(label, notice, "false") for label, notice in NOTICES]
    words = lambda text: "[" + ", ".join(_quoted(w) for w in re.findall("[a-z0-9]+", text.lower())) + "]"  # noqa: E731
    rows = ", ".join(f"({i}, {_quoted(label)}, {exact}, {words(text)})" for i, (label, text, exact) in enumerate(texts))
    gram = lambda at: f"array_to_string(w[{at} + 1:{at} + {scan.k}], ' ')"  # noqa: E731
    least = f"case when wanted <= {scan.brief} then {scan.brief_cover} else {scan.cover} end"
    return rf"""with d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
    t as (select * from (values {rows}) v(template, label, exact, w)), told as (select template, label, exact, len(w) - {scan.k - 1} as wanted, unnest(range(0, len(w) - {scan.k - 1})) as t, w from t),
    known as (select template, label, exact, wanted, t, {gram("t")} as g from told), rolling as (select r, unnest(range(0, greatest(len(w) - {scan.k - 1}, 0))) as p, w from d),
    hits as (select r, template, label, exact, wanted, p - t as diagonal, count(*) as votes, min(t) as low, max(t) as high, list(t) as covered from (select r, p, {gram("p")} as g from rolling) join known using (g) group by all),
    jumps as (select *, coalesce((diagonal - lag(diagonal) over (partition by r, template order by diagonal) > {scan.slack})::int, 1) as jump from hits where not exact),
    runs as (select *, sum(jump) over (partition by r, template order by diagonal) as run from jumps),
    sized as (select *, diagonal - min(diagonal) over part as beyond, max(diagonal) over part - min(diagonal) over part > wanted + {scan.k} as wide from runs window part as (partition by r, template, run)),
    cuts as (select *, unnest(case when wide then [0, 1] else [0] end) as cut from sized),
    merged as (select r, label, wanted, min(diagonal + low) as first, max(diagonal + high) + {scan.k - 1} as last, len(list_distinct(flatten(list(covered)))) / wanted as cover from cuts
        group by r, template, label, wanted, run, cut, case when wide then floor((beyond + cut * (wanted + {scan.k}) / 2) / (wanted + {scan.k})) end),
    spans as (select r, label, diagonal as first, 1.0::double as cover, true as base from hits where exact and votes = wanted
        union all select r, label, first, cover, false from merged where cover >= {least} and last - first + 1 <= 2 * (wanted + {scan.k - 1}))
    select doc_id, len(any_value(w))::bigint as n_words, count(*) filter (where base) as n_base, min(first) filter (where base) as first_word, max(first) filter (where base) as last_word,
        coalesce(string_agg(distinct label, ',' order by label) filter (where base), '') as base_labels, coalesce(string_agg(distinct label, ',' order by label), '') as labels, coalesce(max(cover), 0)::double as score
    from d left join spans using (r) group by r, doc_id"""


ORACLE_SQL: dict[str, str] = {"op2_minhash_near_dup": _NEAR_DUP, "op3_quality_rules": _RULES, "op4_source_mix": _MIX, "op6_license_scan": _licenses(Scan()), "op8_warc": _WARC, "op10_secret_scan": _secrets(), "op12_hard_negatives": _HARD_NEGATIVES, "op13_line_dedup": _LINE_DEDUP}
