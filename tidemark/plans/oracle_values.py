"""Values and expressions that the DuckDB SQL has of its own, so that it can't agree with the engine by sharing its lists."""

#: Fixed values, as SQL lists.
TECH = """
    'rust', 'python', 'typescript', 'javascript', 'go', 'java', 'swift', 'react', 'nextjs', 'next.js', 'vue', 'svelte', 'angular',
    'postgresql', 'postgres', 'sqlite', 'mongodb', 'redis', 'mysql', 'docker', 'kubernetes', 'k8s', 'nginx', 'caddy',
    'tokio', 'axum', 'hyper', 'actix', 'warp', 'fastapi', 'flask', 'django', 'express', 'nestjs', 'hono', 'tailwind', 'shadcn', 'swiftui',
    'vercel', 'cloudflare', 'aws', 'gcp', 'jwt', 'oauth', 'ssh', 'tls', 'ssl', 'git', 'github', 'gitlab', 'telegram', 'slack', 'discord',
    'openai', 'anthropic', 'claude', 'gemini', 'elevenlabs', 'twilio', 'stripe', 'chromadb', 'lancedb', 'cozodb', 'pinecone',
    'mcp', 'grpc', 'graphql', 'rest', 'supabase', 'firebase', 'prisma'
"""
STOPWORDS = """
    'a', 'an', 'the', 'and', 'or', 'but', 'in', 'on', 'at', 'to', 'for',
    'of', 'with', 'by', 'from', 'is', 'are', 'was', 'were', 'be', 'been',
    'being', 'have', 'has', 'had', 'do', 'does', 'did', 'will', 'would',
    'could', 'should', 'may', 'might', 'shall', 'can', 'need', 'must',
    'not', 'all', 'each', 'every', 'this', 'that', 'it', 'its',
    'add', 'fix', 'update', 'remove', 'delete', 'change', 'modify',
    'implement', 'refactor', 'resolve', 'use', 'set', 'get', 'make',
    'move', 'rename', 'merge', 'revert', 'apply', 'handle', 'ensure',
    'check', 'verify', 'enable', 'disable', 'allow', 'prevent',
    'create', 'write', 'read', 'run', 'stop', 'start', 'init',
    'support', 'include', 'exclude', 'skip', 'show', 'hide',
    'bump', 'prepare', 'release', 'deploy', 'publish', 'ship',
    'new', 'old', 'file', 'files', 'code', 'data', 'type', 'types',
    'name', 'value', 'key', 'list', 'item', 'items', 'path', 'error',
    'bug', 'issue', 'test', 'tests', 'docs', 'doc', 'readme',
    'config', 'default', 'option', 'options', 'setting', 'settings',
    'mode', 'state', 'status', 'result', 'output', 'input',
    'log', 'logs', 'message', 'messages', 'event', 'events',
    'version', 'number', 'count', 'index', 'size', 'length',
    'first', 'last', 'next', 'prev', 'previous', 'current',
    'main', 'base', 'core', 'common', 'util', 'utils', 'helper',
    'info', 'warn', 'debug', 'trace',
    'co-authored-by', 'signed-off-by', 'commit', 'branch', 'pull',
    'request', 'review',
    'bar', 'foo', 'baz', 'tmp', 'var', 'ref', 'see', 'via', 'per',
    'net', 'url', 'dir', 'bin', 'lib', 'src', 'pkg', 'cmd',
    'also', 'now', 'then', 'when', 'only', 'just', 'still',
    'more', 'less', 'much', 'many', 'some', 'any', 'other',
    'better', 'proper', 'correct', 'minor', 'major', 'small', 'large',
    'internal', 'external', 'local', 'remote', 'global', 'public', 'private',
    'daemon', 'process', 'running', 'background', 'foreground',
    'writes', 'reads', 'opens', 'closes', 're-opens', 'poll', 'polling',
    'falling', 'through', 'floor', 'threshold'
"""
GENERIC_TAGS = """
    'feature', 'bugfix', 'refactor', 'docs', 'test', 'chore', 'performance', 'session', 'dependency', 'correction', 'feedback',
    'complete', 'release', 'architecture', 'detailed', 'plan', 'final', 'mvp', 'reference'
"""
#: Parts of messages that correct, and that decide.
CORRECTION = "regexp_matches({x}, 'не так|не то|стоп|stop|wrong|нет,|nope|переделай|redo|revert|откатить|верни|не делай|don''t|dont|не надо|лучше|better|instead|я имел в виду|i meant|это неправильно|that''s wrong|that is wrong|забудь|forget|ignore that')"
DECISION = "regexp_matches({x}, 'давай используем|let''s use|lets use|выбираем|we''ll go with|going with|решение:|decision:|decided|используем|будем использовать|архитектура:|architecture:|стек:|stack:|переходим на|switching to|migrating to')"


def embedding(texts: str) -> str:
    """CTEs from ``texts`` (text), distinct: ``vec`` (text, e) with the 256 numbers of each text, zeros for one without words."""
    byte = "('0x' || hex(encode(t))[2 * i + 1:2 * i + 2])::ubigint"
    step = f"list_reduce(list_transform(range(0, strlen(t)), lambda i: {byte}), lambda h, b: ((xor(h, b)::uhugeint * 1099511628211::uhugeint) % 18446744073709551616::uhugeint)::ubigint, ((14695981039346656037::uhugeint + s::uhugeint * 6364136223846793005::uhugeint) % 18446744073709551616::uhugeint)::ubigint)"
    return f"""tokens as (select text, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}_-]+'), lambda x: strlen(x) >= 2) as w from {texts}),
    gram as (select text, unnest(w) as t, 1.0::double / len(w) as share from tokens union all
        select text, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as t, 0.5::double / len(w) as share from tokens where len(w) > 1),
    weight as (select text, t, sum(share) as share from gram group by 1, 2),
    hashed as (select t, s, {step} as h from (select distinct t from weight), range(0, 4) r(s)),
    cell as (select t, (h % 256)::int as d, case when (h >> 8) % 2 = 0 then 1 else -1 end as sign from hashed union all
        select t, ((h >> 16) % 256)::int, case when (h >> 24) % 2 = 0 then 1 else -1 end from hashed),
    dims as (select text, d, sum(share * sign) as v from weight join cell using (t) group by 1, 2),
    scale as (select text, sqrt(sum(v * v)) as norm from dims group by 1),
    placed as (select text, map_from_entries(list((d, v / norm))) as m from dims join scale using (text) where norm > 0 group by 1),
    vec as (select t.text, list_transform(range(0, 256), lambda d: coalesce(m[d::int], 0.0::double)) as e from {texts} t left join placed using (text))"""


def kept_first(rows: str) -> str:
    """CTE ``folded`` (key, id, outcome) of ``rows`` (key, id, ts, e): each key's rows in order, a row near a kept one dropped."""
    return f"""r as (select *, row_number() over (partition by key order by ts, id) as n from {rows}),
    met as (select b.key, b.n, list(a.n) as l from r a join r b on a.key = b.key and a.n < b.n where list_dot_product(a.e, b.e) >= 0.92 group by 1, 2),
    x as (select r.key, r.n, r.id, coalesce(l, []) as l from r left join met using (key, n)),
    f as (select key, 0::bigint as n, []::bigint[] as kept, null::bigint as id, '' as outcome from (select distinct key from r) union all
        select f.key, x.n, case when list_has_any(x.l, f.kept) then f.kept else list_append(f.kept, x.n) end, x.id, case when list_has_any(x.l, f.kept) then 'deduped' else 'saved' end from f join x on x.key = f.key and x.n = f.n + 1),
    folded as (select key, id, outcome from f where n > 0)"""


def fold(rows: str) -> str:
    """CTE ``folded`` (key, id, outcome, score) of ``rows`` (key, id, ts, strength, e): each key's rows in order, the kept ones remembered."""
    return f"""r as (select *, row_number() over (partition by key order by ts, id) as n from {rows}),
    met as (select b.key, b.n, list({{'n': a.n, 'h': date_sub('minute', a.ts, b.ts) / 60, 's': list_dot_product(a.e, b.e)}}) as l from r a join r b on a.key = b.key and a.n < b.n where list_dot_product(a.e, b.e) >= 0.5 group by 1, 2),
    x as (select r.key, r.n, r.id, r.strength, coalesce(l, []) as l from r left join met using (key, n)),
    f as (select key, 0::bigint as n, []::bigint[] as kept, null::bigint as id, '' as outcome, null::double as score from (select distinct key from r) union all
        select key, n, case when outcome = 'saved' then list_append(kept, n) else kept end, id, outcome, case when outcome <> 'deduped' then score end from (
            select *, case when best >= 0.92 then 'deduped' when score::float < 0.4::float then 'low_importance' else 'saved' end as outcome from (
                select *, least(1.0, greatest(0.0, case when often = 0 and lately = 0 then greatest(0.4 * strength, 0.75 * strength) else 0.3 * often + 0.3 * lately + 0.4 * strength end)) as score from (
                    select *, coalesce(list_max(list_transform(k, lambda q: q.s)), -1) as best, least(1.0, len(list_filter(k, lambda q: list_position(kept, q.n) > len(kept) - 100)) / 5) as often,
                        coalesce(list_max(list_transform(list_filter(k, lambda q: list_position(kept, q.n) > len(kept) - 50), lambda q: exp(-q.h / 24))), 0) as lately from (
                        select f.key, x.n, f.kept, x.id, x.strength, list_filter(x.l, lambda q: list_contains(f.kept, q.n)) as k from f join x on x.key = f.key and x.n = f.n + 1))))),
    folded as (select key, id, outcome, score from f where n > 0)"""
