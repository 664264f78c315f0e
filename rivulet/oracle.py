"""The SQL (DuckDB dialect) that the core queries must agree with."""

from __future__ import annotations

from rivulet import vocabulary as V
from rivulet.functions import porter
from rivulet.sql import norm_sql

GATE_LINKS = [*V.TRANSPARENT_LINKS, *V.OPAQUE_LINKS, *V.SEMI_TRANSPARENT_LINKS, "profile_size", "other"]


def _in(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def _values(rows) -> str:
    cell = lambda v: str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(cell(v) for v in r) + ")" for r in rows)


_NORMED = f"""n AS (SELECT id, {norm_sql("subject")} AS subject, coalesce(context, 'general') AS context, {norm_sql("predicate")} AS predicate,
 {norm_sql("object")} AS object, coalesce(truth_value, 'M') AS truth_value, coalesce(source, 'unknown') AS source, coalesce(generation, 0) AS generation,
 coalesce(grade_level, 0) AS grade_level, coalesce(verified, false) AS verified, coalesce(needs_verification, false) AS needs_verification,
 coalesce(evidence_for, []) AS evidence_for, coalesce(evidence_against, []) AS evidence_against, generation AS raw_generation FROM entries)"""
_KB = f"""{_NORMED},
kb AS (SELECT * FROM n WHERE subject <> '' AND predicate <> '' AND object <> '' QUALIFY row_number() OVER (PARTITION BY subject, context, predicate, object ORDER BY id) = 1)"""
KB = f"WITH {_KB}\n"
KBR = f"WITH RECURSIVE {_KB}"
ATOM = "NOT contains({0}, ',')"
S, O = ATOM.format("subject"), ATOM.format("object")

_TREE = f"""
WITH RECURSIVE l AS (SELECT {norm_sql("child")} AS c, {norm_sql("ancestor")} AS p FROM hierarchy WHERE depth IS NULL OR depth = 1),
e AS (SELECT DISTINCT c, p FROM l WHERE c <> '' AND p <> '' AND c <> p),
"""
_ORPHANS = f"""
WITH t AS (SELECT {norm_sql("subject")} AS term FROM entries UNION SELECT {norm_sql("object")} FROM entries),
x AS (SELECT b.id AS bid, b.created_at AS made, b.deleted_at AS gone, e.* FROM bridge_examples e LEFT JOIN bridges b ON e.bridge_id = b.id WHERE e.bridge_id IS NOT NULL),
k AS (SELECT 'bridge_examples' AS table_name, cast(id AS varchar) AS record_key, created_at,
             CASE WHEN bid IS NULL THEN 'missing' WHEN gone IS NOT NULL THEN 'deleted' WHEN made > created_at THEN 'late' END AS reason FROM x),
c AS (SELECT 'centrality' AS table_name, subject AS record_key, created_at, 'missing' AS reason FROM centrality
      WHERE subject IS NOT NULL AND {norm_sql("subject")} <> '' AND {norm_sql("subject")} NOT IN (SELECT term FROM t WHERE term IS NOT NULL)),
o AS (SELECT table_name, record_key, coalesce(strftime(created_at, '%Y-%m'), 'unknown') AS ref_month, reason
      FROM (SELECT * FROM k UNION ALL SELECT * FROM c) WHERE reason IS NOT NULL)
"""


def _verdict(link: str, inherited: str) -> str:
    closed = _in([*V.OPAQUE_LINKS, *V.SEMI_TRANSPARENT_LINKS])
    return f"""CASE WHEN {link} IN {_in(V.TRANSPARENT_LINKS)} THEN 'allow:transparent'
 WHEN {link} IN {_in(V.SEMI_TRANSPARENT_LINKS)} AND {inherited} IN {_in(V.IDENTITY)} THEN 'allow:identity'
 WHEN {link} IN {closed} AND {inherited} IN {_in(V.INTRINSIC)} THEN 'block:intrinsic'
 WHEN {link} IN {closed} AND {inherited} IN {_in(V.RELATIONAL)} THEN 'allow:relational'
 WHEN {link} = 'profile_size' OR {inherited} = 'profile_size' THEN 'block:profile_size'
 WHEN {link} IN {closed} THEN 'allow:unverified' ELSE 'allow:default' END"""


_CHAINS = f"""{KB.rstrip()},
t AS (SELECT * FROM kb WHERE truth_value = 'T' AND {O} AND predicate NOT IN {_in(V.TRANSITIVE_SKIP)}),
ch AS (SELECT a.id AS a_id, b.context AS b_context, b.id AS b_id, a.subject, a.context, b.predicate, b.object, a.predicate AS link, a.object AS mid,
        {_verdict("a.predicate", "b.predicate")} AS verdict
       FROM t a JOIN t b ON a.object = b.subject AND (a.context = b.context OR a.context = 'general' OR b.context = 'general') AND a.subject <> b.object)
"""

_MERGE = f"""{KB.rstrip()},
g AS (SELECT subject, context, predicate, left(string_agg(DISTINCT object, ',' ORDER BY object), 100) AS o, count(DISTINCT object) AS k, min(id) AS first
      FROM kb WHERE truth_value = 'T' AND {O} GROUP BY ALL HAVING count(DISTINCT object) > 1),
m AS (SELECT subject, context, predicate, rtrim(o, '_') AS object, 'T' AS truth_value, 'merged ' || k AS evidence, first FROM g),
f AS (SELECT * FROM m ANTI JOIN kb USING (subject, context, predicate, object))
"""

_CROSS = f"""{KB.rstrip()},
e AS (SELECT * FROM kb WHERE truth_value = 'T' AND {S}),
tot AS (SELECT count(*) AS n FROM (SELECT DISTINCT subject, context FROM e)),
t AS (SELECT * FROM e WHERE {O} AND predicate NOT IN {_in(V.CROSS_SKIP)}),
g AS (SELECT predicate, object, count(*) AS n, min(id) AS first FROM t GROUP BY ALL HAVING count(*) > 1 AND count(*) <= 0.5 * (SELECT n FROM tot)),
p AS (SELECT rtrim(left(a.subject || ',' || b.subject, 100), '_') AS subject, CASE WHEN a.context = b.context THEN a.context ELSE 'cross_domain' END AS context,
        'both_' || predicate AS predicate, object, first, a.subject AS s1, a.context AS c1, b.subject AS s2, b.context AS c2
      FROM g JOIN t a USING (predicate, object) JOIN t b USING (predicate, object) WHERE (a.subject, a.context) < (b.subject, b.context)),
d AS (SELECT * FROM p ANTI JOIN kb USING (subject, context, predicate, object) QUALIFY row_number() OVER (PARTITION BY subject, context, predicate, object ORDER BY first, s1, c1, s2, c2) = 1),
k AS (SELECT * FROM d ORDER BY first, s1, c1, s2, c2, subject, context, predicate, object LIMIT 50),
br AS (SELECT DISTINCT least(term_a, term_b) AS x, greatest(term_a, term_b) AS y, true AS known FROM bridges WHERE deleted_at IS NULL),
r AS (SELECT k.*, coalesce(known, false) OR row_number() OVER (PARTITION BY least(s1, s2), greatest(s1, s2) ORDER BY first, s1, c1, s2, c2, subject, context, k.predicate, k.object) > 1 AS ok
      FROM k LEFT JOIN br ON least(s1, s2) = x AND greatest(s1, s2) = y)
"""

_PROFILES = f"""{KB.rstrip()},
pr AS (SELECT subject, context, list_sort(list(DISTINCT predicate)) AS profile FROM kb WHERE truth_value = 'T' AND {S} AND predicate NOT IN {_in(V.ANALOGY_SKIP)} GROUP BY subject, context),
cl AS (SELECT context, profile, count(*) AS n, min(subject) AS first_subject FROM pr GROUP BY ALL),
sm AS (SELECT a.context, a.profile AS p1, b.profile AS p2, len(list_intersect(a.profile, b.profile)) / (len(a.profile) + len(b.profile) - len(list_intersect(a.profile, b.profile)))::DOUBLE AS sim
       FROM cl a JOIN cl b ON a.context = b.context AND a.profile < b.profile)
"""

_TAX = f"""{KBR},
e AS (SELECT DISTINCT subject AS c, object AS p FROM kb WHERE truth_value = 'T' AND predicate IN {_in(V.TAXONOMY_LINKS)} AND {O} AND subject <> object),
r AS (SELECT c, p, 1 AS d FROM e UNION SELECT r.c, e.p, r.d + 1 FROM r JOIN e ON r.p = e.c WHERE r.d < 10),
h AS (SELECT c AS child, p AS ancestor, min(d) AS depth FROM r GROUP BY c, p)
"""

_DOM = V.Domains()
_DOMAINS = f"""ex(k, d) AS (VALUES {_values(_DOM.exact_rows())}),
kw(k, d, w) AS (VALUES {_values([(k, d, w) for k, d in _DOM.keyword_rows() for w in sorted(set(k.split("_")))])}),
terms AS (SELECT DISTINCT unnest([subject, object]) AS term FROM kb),
sh AS (SELECT term, k, d, bool_and(length(w) >= 4) AS ok FROM (SELECT term, unnest(list_distinct(string_split(replace(lower(term), ' ', '_'), '_'))) AS w FROM terms) JOIN kw USING (w) GROUP BY ALL),
lab AS (SELECT term, d FROM terms JOIN ex ON replace(lower(term), ' ', '_') = ex.k UNION SELECT term, d FROM sh WHERE ok),
dom AS (SELECT term, coalesce(list_sort(list(d) FILTER (d IS NOT NULL)), []) AS domains FROM terms LEFT JOIN lab USING (term) GROUP BY term),
mx(a, b, s) AS (VALUES {_values([(a, b, float(s)) for a, b, s in _DOM.matrix()])})"""
_DKB = f"""{KB.rstrip()},
{_DOMAINS},
f AS (SELECT kb.*, s.domains AS sd, o.domains AS od FROM kb JOIN dom s ON kb.subject = s.term JOIN dom o ON kb.object = o.term),
prs AS (SELECT id, x, unnest(od) AS y FROM (SELECT id, unnest(sd) AS x, od FROM f)),
sc AS (SELECT f.id, coalesce(max(s), 0.5) AS score FROM f LEFT JOIN prs ON f.id = prs.id LEFT JOIN mx ON x = a AND y = b GROUP BY f.id),
pf AS (SELECT predicate, domain, count(*) AS n FROM (SELECT predicate, unnest(sd) AS domain FROM f WHERE truth_value = 'T' AND {S}) GROUP BY ALL)
"""


def _typed(side: int, labels: str) -> str:
    parts = [f"(predicate = '{p}' AND NOT list_has_any({labels}, [{', '.join(repr(x) for x in so[side])}]))" for p, so in V.TYPED_PREDICATES.items() if "*" not in so[side]]
    return f"(len({labels}) > 0 AND ({' OR '.join(parts)}))"


_BLOCKED = " OR ".join(f"(list_contains(sd, '{a}') AND list_contains(od, '{b}')) OR (list_contains(sd, '{b}') AND list_contains(od, '{a}'))" for a, b in V.HARD_BLOCKS)
_NONSENSE = f"""ns AS (SELECT id, CASE WHEN subject = object THEN 'self-referential' WHEN length(subject) < 2 OR length(object) < 2 THEN 'term too short'
 WHEN {_typed(0, "sd")} THEN 'subject domain' WHEN {_typed(1, "od")} THEN 'object domain' WHEN {_BLOCKED} THEN 'hard block' ELSE 'ok' END AS reason FROM f)"""
_TYPE_GATE = """us AS (SELECT predicate, sum(n) AS uses, list(DISTINCT domain) AS used FROM pf GROUP BY predicate),
tg AS (SELECT f.id, score, coalesce(uses, 0) >= 50 AND len(sd) > 0 AND NOT list_has_any(sd, coalesce(used, [])) AS alien FROM f JOIN sc ON f.id = sc.id LEFT JOIN us ON f.predicate = us.predicate),
gt AS (SELECT id, score, CASE WHEN score = 0 OR alien THEN 'block' WHEN score < 0.5 THEN 'verify' ELSE 'allow' END AS gate,
       CASE WHEN score = 0 THEN 0.0 WHEN alien THEN 0.1 ELSE score END AS confidence FROM tg)"""

_CLUSTER_PAIRS = [(d, k) for d, ks in V.CLUSTER_KEYWORDS.items() for k in ks]
_CLUSTER = f"""{KB.rstrip()},
kw(domain, k) AS (VALUES {_values(_CLUSTER_PAIRS)}),
t AS (SELECT * FROM kb WHERE truth_value = 'T'),
own AS (SELECT id AS entry_id, context AS domain, 1.0::DOUBLE AS confidence FROM t WHERE context NOT IN ('', 'general', 'cross_domain')),
gen AS (SELECT * FROM t WHERE context IN ('', 'general', 'cross_domain'))
"""

_NEAR = f"""{KBR},
e AS (SELECT id, subject, context, predicate, object FROM kb WHERE truth_value = 'T'%(edges)s),
b AS (SELECT id, subject AS here, object AS nxt FROM e%(back)s),
n1 AS (SELECT id, nxt FROM b WHERE here = '%(term)s'),
f1 AS (SELECT DISTINCT nxt AS here FROM n1 WHERE NOT contains(nxt, ',') AND nxt <> '%(term)s'),
n2 AS (SELECT id FROM b JOIN f1 USING (here)),
al AS (SELECT id, min(d) AS depth FROM (SELECT id, 1 AS d FROM n1 UNION ALL SELECT id, 2 FROM n2) GROUP BY id)
"""


def _near(term: str, context: str | None, both: bool, atomic: bool) -> str:
    edges = (f" AND context IN ('{context}', 'general')" if context else "") + (f" AND {S} AND {O}" if atomic else "")
    return _NEAR % {"edges": edges, "back": " UNION ALL SELECT id, object, subject FROM e" if both else "", "term": term}


def _bridge_add(undirected: bool) -> str:
    key = "least(a, b) AS x, greatest(a, b) AS y" if undirected else "a AS x, b AS y"
    return f"""WITH k AS (SELECT *, replace(lower(term_a), ' ', '_') AS a, replace(lower(term_b), ' ', '_') AS b FROM bridges),
q AS (SELECT *, {key} FROM k),
w AS (SELECT * FROM q WHERE id % 2 = 1 AND bridge_type IN {_in(V.BRIDGE_TYPES)} AND a IS NOT NULL AND b IS NOT NULL QUALIFY row_number() OVER (PARTITION BY x, y, bridge_type ORDER BY id) = 1)
SELECT id, a AS term_a, b AS term_b, bridge_type, coalesce(domain_a, '') AS domain_a, coalesce(domain_b, '') AS domain_b, coalesce(reason, '') AS reason, coalesce(strength, 0.5) AS strength,
coalesce(bidirectional, true) AS bidirectional, coalesce(teaching_note, '') AS teaching_note, coalesce(discovered_by, 'manual') AS discovered_by
FROM w ANTI JOIN (SELECT x, y, bridge_type FROM q WHERE id % 2 = 0) USING (x, y, bridge_type)"""


_SHARED = f"""{KB.rstrip()},
{_DOMAINS},
t AS (SELECT DISTINCT subject, predicate, object FROM kb WHERE truth_value = 'T' AND {S} AND predicate NOT IN {_in(V.NOISE_PREDICATES)}),
dl AS (SELECT subject, predicate, object, unnest(domains) AS domain FROM t JOIN dom ON subject = term),
d AS (SELECT * FROM dl SEMI JOIN (SELECT predicate, object FROM dl GROUP BY ALL HAVING count(DISTINCT domain) > 1) USING (predicate, object)),
pp AS (SELECT predicate, object, a.domain AS domain_a, b.domain AS domain_b, a.subject AS sa, b.subject AS sb FROM d a JOIN d b USING (predicate, object) WHERE a.domain < b.domain AND a.subject <> b.subject),
sm AS (SELECT predicate, object, domain_a, domain_b, min(sa) AS term_a, arg_min(sb, sa || chr(1) || sb) AS term_b, count(*) AS n_pairs,
        CASE WHEN object IN {_in(V.STRUCTURAL_WORDS)} THEN 'structural' ELSE 'emergent' END AS bridge_type,
        round(least(1.0, 0.4 + CASE WHEN predicate IN {_in(V.BRIDGE_PREDICATES)} THEN 0.3 ELSE 0 END + CASE WHEN object IN {_in(V.STRUCTURAL_WORDS)} THEN 0.2 ELSE 0 END + CASE WHEN length(object) > 5 THEN 0.1 ELSE 0 END), 2)::DOUBLE AS confidence
       FROM pp GROUP BY predicate, object, domain_a, domain_b)
"""

#: Parameters of queries on this store's own words: predicates that state a bridge, structural words, pairs looked at.
STATED_BY = ["similar_to", "symbolizes", "named_after"]
STRUCTURAL_WORDS = ["spring", "channel", "sluice", "lagoon", "marsh"]
PAIRS = 1000


def _structural(words) -> str:
    return f"""wd(w) AS (VALUES {_values([(w,) for w in words])}),
sw AS (SELECT subject, domains, list_sort(list(DISTINCT w)) AS ws FROM kb JOIN wd ON contains(object, w) JOIN dom ON subject = term WHERE truth_value = 'T' AND {S} AND len(domains) > 0 GROUP BY subject, domains),
sc AS (SELECT domains, ws, count(*) AS n, min(subject) AS first FROM sw GROUP BY ALL),
st AS (SELECT a.first AS term_a, b.first AS term_b, len(list_intersect(a.ws, b.ws)) AS n_shared, a.n * b.n AS n_pairs, round(least(0.9, 0.3 + 0.15 * len(list_intersect(a.ws, b.ws))), 2)::DOUBLE AS confidence
       FROM sc a JOIN sc b ON a.first < b.first AND a.domains <> b.domains AND len(list_intersect(a.ws, b.ws)) > 0)"""


def _chunks(source: str, key: str, text: str, size: int, overlap: int) -> str:
    """ch(key..., chunks): paragraphs packed into chunks, one paragraph a step."""
    trim = "trim({0}, ' ' || chr(10) || chr(9) || chr(13))".format
    return f"""pr AS (SELECT {key}, list_filter(list_transform(string_split_regex(coalesce({text}, ''), '\\n\\s*\\n'), lambda p: {trim("p")}), lambda p: p <> '') AS ps FROM {source}),
sg AS (SELECT {key}, ps, 0 AS i, '' AS cur, []::VARCHAR[] AS done FROM pr
 UNION ALL SELECT {key}, ps, i + 1, CASE WHEN brim THEN kept ELSE cur END || ps[i + 1] || chr(10) || chr(10), CASE WHEN brim THEN list_append(done, {trim("cur")}) ELSE done END
 FROM (SELECT *, length(cur) + length(ps[i + 1]) > {size} AND length(cur) > 0 AS brim, CASE WHEN length(cur) > {overlap} THEN right(cur, {overlap}) ELSE '' END AS kept FROM sg WHERE i < len(ps))),
ch AS (SELECT {key}, CASE WHEN {trim("cur")} <> '' THEN list_append(done, {trim("cur")}) ELSE done END AS chunks FROM sg WHERE i = len(ps))"""


_TOKENS = f"""{KB.rstrip()},
c AS (SELECT id, unnest(['subject', 'predicate', 'object']) AS col, unnest([subject, predicate, object]) AS v FROM kb WHERE truth_value = 'T'),
w AS (SELECT id, col, regexp_extract_all(replace(v, '_', ' '), '[\\p{{L}}\\p{{N}}]+') AS ws FROM c),
tk AS (SELECT ws[i] AS token, id AS entry_id, col, (i - 1)::INTEGER AS pos FROM (SELECT id, col, ws, unnest(range(1, len(ws) + 1)) AS i FROM w))
"""

_MANUAL = _values([(t, s) for t, ss in V.MANUAL_SYNONYMS.items() for s in ss])
_LOOKUP: dict[str, str] = {}
for _name, _others in V.PREDICATE_VARIANTS.items():
    _LOOKUP[_name] = _name
    for _x in _others:
        _LOOKUP[_x] = _name
_TASKS = "SELECT event_id AS id, event_type AS task_type, coalesce(json_extract_string(props, '$.text'), props) AS text, coalesce(cast(floor(coalesce(value, 0) % 10) AS INTEGER), 5) AS priority FROM events"


def _star() -> str:
    f = lambda s, ctx, p, o, frm: f"SELECT {norm_sql(s)} AS subject, '{ctx}' AS context, '{p}' AS predicate, {norm_sql(o)} AS object FROM {frm}"
    part = "('part_' || p_partkey)"
    return " UNION ".join([
        f("r_name", "general", "is_a", "'region'", "region"),
        f("n_name", "general", "located_in", "r_name", "nation JOIN region ON n_regionkey = r_regionkey"),
        f("n_name", "general", "is_a", "'nation'", "nation"),
        f("s_name", "economics", "located_in", "n_name", "supplier JOIN nation ON s_nationkey = n_nationkey"),
        f("s_name", "economics", "is_a", "'supplier'", "supplier"),
        f("s_name", "engineering", "produces", "('part_' || l_partkey)", "lineitem JOIN supplier ON l_suppkey = s_suppkey"),
        f("c_name", "economics", "located_in", "n_name", "customer JOIN nation ON c_nationkey = n_nationkey"),
        f("c_name", "economics", "related_to", "c_mktsegment", "customer"),
        f(part, "engineering", "is_a", "p_type", "part"),
        f(part, "engineering", "created_by", "p_brand", "part"),
        f(part, "engineering", "has_property", "('size_' || p_size)", "part"),
    ])


_CONTEXT = "CASE WHEN len(domains) = 0 THEN 'general' WHEN len(list_filter(domains, lambda x: x <> 'everyday')) = 0 THEN 'everyday' ELSE list_filter(domains, lambda x: x <> 'everyday')[1] END"


def _paths(start: str, end: str, outgoing: bool) -> str:
    """The shortest path of up to three hops, hop by hop; of equal ones the least fact ids."""
    atoms = f" AND {S} AND {O}" if outgoing else ""
    back = "" if outgoing else " UNION ALL SELECT id, predicate, object, subject FROM e"

    def hop(n: int, before: str, path: str, ids: str) -> str:
        seen = " UNION ALL ".join([f"SELECT '{start}' AS here", *[f"SELECT here FROM f{k}" for k in range(1, n)]])
        return f"""h{n} AS (SELECT nxt AS here, {path} AS path, {ids} AS ids FROM {before} QUALIFY row_number() OVER (PARTITION BY nxt ORDER BY {ids}, {path}) = 1),
f{n} AS (SELECT * FROM h{n} WHERE {ATOM.format("here")} AND here NOT IN ({seen}))"""

    step = "['--' || predicate || '-->', nxt]"
    hops = [hop(1, f"(SELECT * FROM b WHERE here = '{start}')", f"['{start}'] || {step}", "[id]")]
    hops += [hop(n, f"(SELECT b.*, path AS p, ids AS q FROM b JOIN f{n - 1} USING (here))", f"p || {step}", "list_append(q, id)") for n in (2, 3)]
    ends = " UNION ALL ".join(f"SELECT {n} AS hops, array_to_string(path, ' ') AS path FROM h{n} WHERE here = '{end}'" for n in (1, 2, 3))
    return f"""{KB.rstrip()},
e AS (SELECT id, subject, predicate, object FROM kb WHERE truth_value = 'T'{atoms}),
b AS (SELECT id, predicate, subject AS here, object AS nxt FROM e{back}),
{", ".join(hops)}, r AS ({ends})
SELECT hops::INTEGER AS hops, path FROM r WHERE hops = (SELECT min(hops) FROM r)"""


def _answer(terms: list[str]) -> str:
    like = " OR ".join(f"subject ILIKE '%{t}%' OR object ILIKE '%{t}%'" for t in terms)
    side = " OR ".join(f"replace(lower({c}), ' ', '_') = '{t}'" for t in terms for c in ("term_a", "term_b"))
    return f"""{KB.rstrip()},
hit AS (SELECT * FROM kb WHERE {like}),
lead AS (SELECT subject AS x FROM hit WHERE {S} ORDER BY truth_value, generation, id LIMIT 10),
near AS (SELECT * FROM kb WHERE truth_value = 'T' AND (subject IN (SELECT x FROM lead) OR object IN (SELECT x FROM lead)) AND id NOT IN (SELECT id FROM hit)),
br AS (SELECT * FROM bridges WHERE deleted_at IS NULL AND ({side})),
top AS (SELECT * FROM br ORDER BY strength DESC NULLS LAST, id LIMIT 5),
far AS (SELECT DISTINCT replace(lower(t), ' ', '_') AS t FROM (SELECT unnest([term_a, term_b]) AS t FROM top) WHERE t IS NOT NULL AND t <> '' AND t NOT IN {_in(terms)}),
beyond AS (SELECT kb.* FROM kb JOIN far ON subject = t WHERE truth_value = 'T' AND {O}),
pa AS ({_paths(terms[0], terms[1], False)})
SELECT 'hit' AS section, subject, context, predicate, object FROM hit UNION SELECT 'near', subject, context, predicate, object FROM near UNION SELECT 'bridge', term_a, coalesce(domain_a, ''), bridge_type, term_b FROM br
UNION SELECT 'beyond', subject, context, predicate, object FROM beyond UNION SELECT 'path', '{terms[0]}', '', path, '{terms[1]}' FROM pa"""


def _stems(tokens: str) -> str:
    """st(token, stem) of the words in the table ``tokens`` (token): Porter's steps, one a table."""
    pattern = "regexp_replace(regexp_replace(regexp_replace({0}, '[aeiou]', 'V', 'g'), '[^Vy]', 'C', 'g'), '^y', 'C')"
    for _ in range(3):  # y is a vowel after a consonant only
        pattern = f"replace(replace({pattern}, 'Cy', 'CV'), 'Vy', 'VC')"
    measure = lambda p: f"((length({p}) - length(replace({p}, 'VC', ''))) // 2)"
    short = lambda w, p: f"(ends_with({p}, 'CVC') AND right({w}, 1) NOT IN ('w', 'x', 'y'))"
    double = lambda w, p: f"(length({w}) > 1 AND right({w}, 1) = left(right({w}, 2), 1) AND ends_with({p}, 'C'))"
    ends = lambda s: f"ends_with(w, '{s}')"
    cut = lambda c, n: f"left({c}, length({c}) - {n})"
    step = lambda name, before, w: f"{name} AS (SELECT *, {pattern.format('w')} AS p FROM (SELECT token, {w} AS w FROM {before}))"

    def rules(pairs: list[tuple[str, str]], condition) -> str:
        """The longest suffix that fits is the only one that may apply."""
        by_size = sorted(pairs, key=lambda r: -len(r[0]))
        return "CASE " + " ".join(f"WHEN {ends(s)} THEN CASE WHEN {condition(s)} THEN {cut('w', len(s))} || '{new}' ELSE w END" for s, new in by_size) + " ELSE w END"

    positive = lambda s: f"{measure(cut('p', len(s)))} > 0"
    fourth = lambda s: f"{measure(cut('p', len(s)))} > 1" + (f" AND right({cut('w', 3)}, 1) IN ('s', 't')" if s == "ion" else "")
    rest, rest_p = cut("w", 1), cut("p", 1)
    return ",\n".join([
        f"w0 AS (SELECT token, token AS w FROM (SELECT DISTINCT token FROM {tokens}) WHERE length(token) > 2)",
        step("w1", "w0", f"CASE WHEN {ends('sses')} OR {ends('ies')} THEN {cut('w', 2)} WHEN {ends('s')} AND NOT {ends('ss')} THEN {rest} ELSE w END"),
        f"""w2 AS (SELECT token, CASE WHEN {ends('eed')} AND {measure(cut('p', 3))} > 0 THEN {rest} ELSE w END AS w,
 CASE WHEN {ends('eed')} THEN NULL WHEN {ends('ed')} AND contains({cut('p', 2)}, 'V') THEN {cut('w', 2)} WHEN {ends('ing')} AND contains({cut('p', 3)}, 'V') THEN {cut('w', 3)} END AS c, left(p, length(c)) AS cp FROM w1)""",
        step("w3", "w2", f"CASE WHEN c IS NULL THEN w WHEN regexp_matches(c, '(at|bl|iz)$') OR ({measure('cp')} = 1 AND {short('c', 'cp')}) THEN c || 'e' WHEN {double('c', 'cp')} AND right(c, 1) NOT IN ('l', 's', 'z') THEN {cut('c', 1)} ELSE c END"),
        step("w4", "w3", f"CASE WHEN {ends('y')} AND contains({rest_p}, 'V') THEN {rest} || 'i' ELSE w END"),
        step("w5", "w4", rules(porter.STEP2, positive)), step("w6", "w5", rules(porter.STEP3, positive)), step("w7", "w6", rules([(s, "") for s in porter.STEP4], fourth)),
        step("w8", "w7", f"CASE WHEN {ends('e')} AND ({measure(rest_p)} > 1 OR ({measure(rest_p)} = 1 AND NOT {short(rest, rest_p)})) THEN {rest} ELSE w END"),
        f"st AS (SELECT token, CASE WHEN {measure('p')} > 1 AND {double('w', 'p')} AND {ends('l')} THEN {rest} ELSE w END AS stem FROM w8 UNION ALL SELECT DISTINCT token, token FROM {tokens} WHERE length(token) <= 2)",
    ])


_CONFUSED = KB.rstrip() + """, c AS (SELECT id, subject, object AS confused_with, predicate AS reason, grade_level AS grade, generation FROM kb WHERE truth_value = 'F')
SELECT id, subject, confused_with, reason, grade FROM c ANTI JOIN (SELECT subject, confused_with FROM c WHERE generation = 0) USING (subject, confused_with) WHERE generation > 0
QUALIFY row_number() OVER (PARTITION BY subject, confused_with ORDER BY id) = 1"""


def _bar(share: str) -> str:
    n = f"cast(least(10, greatest(0, floor({share} * 10 + 1e-9))) AS INTEGER)"
    return f"repeat('█', {n}) || repeat('░', 10 - {n})"


_WORDS = r"regexp_extract_all(translate(lower(replace({0}, '_', ' ')), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[\p{{L}}\p{{N}}]+')"
_INDEX = f"""{KB.rstrip()},
c AS (SELECT id, unnest(['subject', 'context', 'predicate', 'object', 'source']) AS col, unnest([subject, context, predicate, object, source]) AS v FROM kb WHERE truth_value = 'T'),
w AS (SELECT id, col, {_WORDS.format("v")} AS ws FROM c),
"""


def queries() -> dict[str, str]:
    like = lambda t: f"(subject ILIKE '%{t}%' OR object ILIKE '%{t}%')"
    scoped = r"left(trim(regexp_replace(regexp_replace(lower(subject), '[^a-z0-9_\s\p{Z}\x{1c}-\x{1f}-]', '', 'g'), '[\s\p{Z}\x{1c}-\x{1f}-]+', '_', 'g'), '_'), 100)"
    best = """bs AS (SELECT least(term_a, term_b) AS term_a, greatest(term_a, term_b) AS term_b, strategy, bridge_type, confidence FROM al QUALIFY row_number() OVER (PARTITION BY least(term_a, term_b), greatest(term_a, term_b) ORDER BY strategy, -confidence, bridge_type) = 1)"""
    verify = "SELECT id, predicate, CASE WHEN predicate IN {0} THEN 'T' ELSE truth_value END AS truth_value, verified OR predicate IN {0} AS verified, false AS needs_verification FROM kb WHERE needs_verification ORDER BY id LIMIT 500"
    words = lambda c: f"regexp_extract_all(replace({c}, '_', ' '), '[\\p{{L}}\\p{{N}}]+')"  # noqa: E731, F841
    return {
        "p3_found": _TREE + "r AS (SELECT c, p FROM e UNION SELECT r.c, e.p FROM r JOIN e ON r.p = e.c)\nSELECT c AS child, p AS ancestor FROM r",
        "p3_depths": _TREE + "r AS (SELECT c, p, 1 AS d FROM e UNION SELECT r.c, e.p, r.d + 1 FROM r JOIN e ON r.p = e.c WHERE r.d < 200)\nSELECT c AS child, p AS ancestor, min(d) AS depth FROM r GROUP BY c, p",
        "p5_found": _ORPHANS + "SELECT table_name, record_key, ref_month, reason FROM o",
        "p5_by_month": _ORPHANS + "SELECT table_name, ref_month, reason, 'direct' AS kind, count(*) AS n FROM o GROUP BY table_name, ref_month, reason",
        "normalize_terms": f"SELECT id, {norm_sql('subject')} AS inserted, {scoped} AS scoped, replace(lower(subject), ' ', '_') AS looked_up FROM entries",
        "append_dedup": f"""WITH {_NORMED}, v AS (SELECT * FROM n WHERE subject <> '' AND predicate <> '' AND object <> ''),
o AS (SELECT * FROM v WHERE raw_generation = 0 QUALIFY row_number() OVER (PARTITION BY subject, context, predicate, object ORDER BY id) = 1),
w AS (SELECT * FROM v WHERE raw_generation > 0 QUALIFY row_number() OVER (PARTITION BY subject, context, predicate, object ORDER BY id) = 1)
SELECT id AS input_id, subject, context, predicate, object, (SELECT max(id) FROM o) + row_number() OVER (ORDER BY id) AS id FROM w ANTI JOIN o USING (subject, context, predicate, object)""",
        "star_triples": _star(),
        "find_exact": KB + "SELECT id, subject, context, predicate, object FROM kb WHERE predicate = 'is_a' AND truth_value = 'T'",
        "search_like": KB + f"SELECT id, subject, object, truth_value, generation FROM kb WHERE {like('tidal_b')}",
        "search_multi": KB + f"SELECT id, subject, object FROM kb WHERE {like('tizepebo')} OR {like('frozen_spring')}",
        "about": KB + f"SELECT id, context, predicate, object FROM kb WHERE subject = 'groundwater_basin' AND truth_value = 'T' AND {O} AND context IN ('chemistry', 'general')",
        "reverse": KB + f"SELECT id, subject, context, predicate FROM kb WHERE object = 'tidal_basin' AND truth_value = 'T' AND {S}",
        "unresolved": KB + "SELECT id, subject, context, predicate, object FROM kb WHERE truth_value = 'M' ORDER BY id LIMIT 30",
        "known_subjects": KB + f"SELECT DISTINCT subject FROM kb WHERE truth_value = 'T' AND {S}",
        "ambiguous_subjects": KB + "SELECT subject, count(DISTINCT context) AS n_contexts FROM kb WHERE context <> '' GROUP BY subject HAVING count(DISTINCT context) > 1",
        "subject_display": KB + "SELECT subject, context, CASE WHEN count(*) FILTER (context <> '') OVER (PARTITION BY subject) > 1 THEN subject || ' (' || context || ')' ELSE subject END AS display FROM (SELECT DISTINCT subject, context FROM kb)",
        "raw_lookup": KB + f"""SELECT 'about' AS section, subject, context, predicate, object FROM kb WHERE subject = 'tizepebo' AND truth_value = 'T' AND {O}
UNION ALL SELECT 'reverse', subject, context, predicate, object FROM kb WHERE object = 'tizepebo' AND truth_value = 'T' AND {S}
UNION ALL SELECT 'bridge', term_a, coalesce(domain_a, ''), bridge_type, term_b FROM bridges WHERE deleted_at IS NULL AND (term_a = 'tizepebo' OR term_b = 'tizepebo')""",
        "stats_source": KB + "SELECT source, count(*) AS n FROM kb GROUP BY source",
        "stats_grade_pivot": KB + "SELECT grade_level, count(*) FILTER (truth_value = 'T') AS t, count(*) FILTER (truth_value = 'F') AS f, count(*) FILTER (truth_value = 'M') AS m FROM kb GROUP BY grade_level",
        "stats_dashboard": KB + """SELECT 'truth' AS part, truth_value AS key, count(*) AS n FROM kb GROUP BY truth_value
UNION ALL SELECT 'grade', cast(grade_level AS varchar), count(*) FROM kb WHERE grade_level > 0 GROUP BY grade_level
UNION ALL SELECT * FROM (SELECT 'source', source, count(*) AS n FROM kb GROUP BY source ORDER BY n DESC, source LIMIT 15)""",
        "kb_report": KB + f"""SELECT count(*) AS total, count(*) FILTER (truth_value = 'T') AS n_t, count(*) FILTER (truth_value = 'F') AS n_f, count(*) FILTER (truth_value = 'M') AS n_m,
round(count(*) FILTER (truth_value = 'T') * 100.0 / count(*), 1)::DOUBLE AS pct_t, round(count(*) FILTER (truth_value = 'F') * 100.0 / count(*), 1)::DOUBLE AS pct_f, round(count(*) FILTER (truth_value = 'M') * 100.0 / count(*), 1)::DOUBLE AS pct_m,
count(DISTINCT subject) FILTER ({S}) AS n_subjects, count(DISTINCT predicate) AS n_predicates FROM kb""",
        "pulse_merge": _MERGE + "SELECT subject, context, predicate, object, truth_value, evidence FROM f ORDER BY first, subject, context, predicate, object LIMIT 50",
        "pulse_merge_all": _MERGE + "SELECT subject, context, predicate, object, truth_value, evidence FROM f",
        "pulse_transitive": _CHAINS + """, c AS (SELECT * FROM ch ANTI JOIN kb USING (subject, context, predicate, object) WHERE verdict LIKE 'allow%' QUALIFY row_number() OVER (PARTITION BY subject, context, predicate, object ORDER BY a_id, b_context, b_id) = 1)
SELECT subject, context, predicate, object, 'M' AS truth_value, 'transitive[' || link || '→' || predicate || ']: ' || subject || '(' || context || ')→' || mid || '→' || object AS evidence
FROM c ORDER BY a_id, b_context, b_id, subject, context, predicate, object LIMIT 50""",
        "transitive_blocked": _CHAINS + "SELECT link, predicate AS inherited, verdict, count(*) AS n FROM ch WHERE verdict LIKE 'block%' GROUP BY ALL",
        "pulse_cross_domain": _CROSS + "SELECT subject, context, predicate, object, 'T' AS truth_value, CASE WHEN ok THEN 'bridge-validated' ELSE 'shared' END AS evidence FROM r",
        "cross_groups": _CROSS + "SELECT predicate, object, n, first, n - 1 AS n_links FROM g",
        "pulse_analogy": _PROFILES + """, both_ AS (SELECT context, p1, p2, sim FROM sm WHERE sim >= 0.6 UNION ALL SELECT context, p2, p1, sim FROM sm WHERE sim >= 0.6 UNION ALL SELECT context, profile, profile, 1.0 FROM cl),
pq AS (SELECT a.subject, a.context, 'structurally_similar_to' AS predicate, b.subject AS object, sim FROM pr a JOIN both_ ON a.context = both_.context AND a.profile = p1 JOIN pr b ON b.context = both_.context AND b.profile = p2 WHERE a.subject < b.subject)
SELECT subject, context, predicate, object, 'T' AS truth_value, 'sim=' || cast(round_even(sim * 100, 0) AS INTEGER) || '%' AS evidence FROM pq ANTI JOIN kb USING (subject, context, predicate, object) ORDER BY subject, context, object LIMIT 50""",
        "profile_pairs": _PROFILES + "SELECT context, array_to_string(p1, ',') AS p1, array_to_string(p2, ',') AS p2, round(sim, 6) AS sim FROM sm WHERE sim >= 0.6",
        "profile_classes": _PROFILES + "SELECT context, array_to_string(profile, ',') AS profile, n, first_subject FROM cl",
        "verify_offline": KB + verify.format(_in(V.SAFE_CURRICULUM)),
        "update_truth": KB.rstrip() + f""",
v AS ({verify.format(_in(V.SAFE_PRODUCTION))}), u AS (SELECT id FROM v WHERE truth_value = 'T' AND verified)
SELECT kb.id, CASE WHEN u.id IS NOT NULL THEN 'T' ELSE truth_value END AS truth_value, verified OR u.id IS NOT NULL AS verified, needs_verification AND u.id IS NULL AS needs_verification,
len(evidence_for) + CASE WHEN u.id IS NOT NULL THEN 1 ELSE 0 END AS n_for, len(evidence_against) AS n_against FROM kb LEFT JOIN u ON kb.id = u.id""",
        "upsert_concepts": "SELECT subject, context, text AS definition, source FROM documents WHERE subject IS NOT NULL AND context IS NOT NULL AND text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY subject, context ORDER BY doc_id DESC) = 1",
        "gate_verdicts": KB.rstrip() + f", g(link) AS (VALUES {_values([(x,) for x in GATE_LINKS])}), p AS (SELECT DISTINCT predicate AS inherited FROM kb) SELECT link, inherited, {_verdict('link', 'inherited')} AS verdict FROM g, p",
        "chain_confidence": KB.rstrip() + f""", g(link) AS (VALUES {_values([(x,) for x in GATE_LINKS])}), p AS (SELECT DISTINCT predicate AS inherited FROM kb)
SELECT link, inherited, (CASE WHEN {_verdict('link', 'inherited')} LIKE 'block%' THEN 0.0 WHEN link IN {_in(V.TRANSPARENT_LINKS)} THEN 0.9 WHEN link IN {_in(V.SEMI_TRANSPARENT_LINKS)} THEN 0.6
 WHEN link IN {_in(V.OPAQUE_LINKS)} AND inherited IN {_in(V.RELATIONAL)} THEN 0.4 ELSE 0.3 END)::DOUBLE AS confidence FROM g, p""",
        "rule_suggest": KB + """SELECT context AS link, predicate AS inherited, count(*) FILTER (truth_value = 'T') AS approved, count(*) FILTER (truth_value = 'F') AS rejected, count(*) AS total,
CASE WHEN count(*) >= 5 AND count(*) FILTER (truth_value = 'F') / count(*)::DOUBLE >= 0.75 THEN 'block' WHEN count(*) >= 5 AND count(*) FILTER (truth_value = 'T') / count(*)::DOUBLE >= 0.75 THEN 'allow' ELSE 'uncertain' END AS suggestion
FROM kb WHERE truth_value IN ('T', 'F') GROUP BY context, predicate""",
        "predicate_normalize": KB.rstrip() + f", m(o, c) AS (VALUES {_values(sorted(_LOOKUP.items()))}) SELECT id, subject, coalesce(c, predicate) AS predicate, object FROM kb LEFT JOIN m ON predicate = o",
        "hierarchy_closure": _TAX + "SELECT child, ancestor, depth FROM h",
        "centrality": _TAX + f""", ends AS (SELECT subject AS s, 1 AS o, 0 AS i FROM kb WHERE truth_value = 'T' UNION ALL SELECT object, 0, 1 FROM kb WHERE truth_value = 'T'),
dg AS (SELECT s AS subject, cast(sum(o) AS BIGINT) AS od, cast(sum(i) AS BIGINT) AS ind FROM ends WHERE {ATOM.format("s")} GROUP BY s), hc AS (SELECT ancestor, count(*) AS k FROM h GROUP BY ancestor)
SELECT subject, od AS out_degree, ind AS in_degree, coalesce(k, 0) AS hierarchy_children, (od + ind + 2 * coalesce(k, 0))::DOUBLE AS score FROM dg LEFT JOIN hc ON subject = ancestor""",
        "synonyms": KB.rstrip() + f""", t AS (SELECT * FROM kb WHERE truth_value = 'T' AND {S} AND {O}), m(term, synonym) AS (VALUES {_MANUAL}),
al AS (SELECT object AS term, subject AS synonym, 'is_a' AS source, 0.8::DOUBLE AS weight, 1 AS o FROM t WHERE predicate IN ('is_a', 'subclass_of')
 UNION ALL SELECT subject, object, 'has_part', 0.6, 2 FROM t WHERE predicate IN ('has_part', 'has_component', 'contains') UNION ALL SELECT term, synonym, 'manual', 0.7, 3 FROM m)
SELECT term, synonym, source, weight FROM al QUALIFY row_number() OVER (PARTITION BY term, synonym ORDER BY o) = 1""",
        "domain_cluster": _CLUSTER + "SELECT * FROM own UNION ALL SELECT DISTINCT id, domain, 1.0::DOUBLE FROM gen JOIN kw ON contains('_' || subject || '_', '_' || k || '_') OR contains('_' || object || '_', '_' || k || '_')",
        "domain_cluster_like": _CLUSTER + "SELECT * FROM own UNION ALL SELECT DISTINCT id, domain, 1.0::DOUBLE FROM gen JOIN kw ON " + " OR ".join(f"{c} = k OR {c} LIKE k || '_%' OR {c} LIKE '%_' || k OR {c} LIKE '%_' || k || '_%'" for c in ("subject", "object")),
        "dedup_triples": KB + "SELECT id, subject, predicate, object FROM kb QUALIFY row_number() OVER (PARTITION BY subject, predicate, object ORDER BY id) = 1",
        "integrity": KB + f"""SELECT 'self_reference' AS "check", count(*) AS n FROM kb WHERE subject = object UNION ALL SELECT 'empty_field', 0
UNION ALL SELECT 'long_subject', count(*) FROM kb WHERE length(subject) > 80
UNION ALL SELECT 'lost_child', count(*) FROM (SELECT DISTINCT {norm_sql("child")} AS c FROM hierarchy) WHERE c <> '' AND c NOT IN (SELECT subject FROM kb)""",
        "neighbors_d2": _near("tizepebo", "earth_science", True, False) + "SELECT e.*, depth FROM e JOIN al USING (id)",
        "neighbors_out": _near("tizepebo", None, False, True) + "SELECT e.*, depth FROM e JOIN al USING (id)",
        "graph_size": _near("futadala", None, True, True) + "SELECT 'edges' AS kind, count(*) AS n FROM al UNION ALL SELECT 'nodes', count(DISTINCT x) FROM (SELECT unnest([subject, object]) AS x FROM e JOIN al USING (id))",
        "classify_domains": KB.rstrip() + f""",
{_DOMAINS} SELECT term, array_to_string(domains, ',') AS domains, {_CONTEXT} AS context FROM dom""",
        "classify_learned": KB.rstrip() + f""",
{_DOMAINS}, ck(domain, k) AS (VALUES {_values(_CLUSTER_PAIRS)}), tt AS (SELECT * FROM kb WHERE truth_value = 'T'),
ed AS (SELECT id, context AS domain FROM tt WHERE context NOT IN ('', 'general', 'cross_domain')
 UNION SELECT id, domain FROM (SELECT * FROM tt WHERE context IN ('', 'general', 'cross_domain')) JOIN ck ON contains('_' || subject || '_', '_' || k || '_') OR contains('_' || object || '_', '_' || k || '_')),
ll AS (SELECT subject AS term, list(DISTINCT domain) AS ds FROM kb JOIN ed USING (id) WHERE {S} GROUP BY subject)
SELECT term, array_to_string(list_sort(list_distinct(domains || coalesce(ds, []))), ',') AS domains FROM dom LEFT JOIN ll USING (term)""",
        "compat_score": _DKB + "SELECT id, score::DOUBLE AS score FROM sc",
        "domain_matrix": f"WITH mx(a, b, score) AS (VALUES {_values([(a, b, float(s)) for a, b, s in _DOM.matrix()])}) SELECT a, b, score::DOUBLE AS score FROM mx",
        "nonsense_filter": _DKB.rstrip() + f",\n{_NONSENSE} SELECT id, reason FROM ns",
        "predicate_profile": _DKB + "SELECT predicate, domain, n FROM pf",
        "type_gate": _DKB.rstrip() + f",\n{_TYPE_GATE} SELECT id, score::DOUBLE AS score, gate, confidence::DOUBLE AS confidence FROM gt",
        "scope_blocked": _DKB.rstrip() + f",\n{_NONSENSE},\n{_TYPE_GATE} SELECT CASE WHEN reason = 'ok' AND gate = 'block' THEN 'type gate' ELSE reason END AS reason, count(*) AS n FROM ns JOIN gt USING (id) WHERE reason <> 'ok' OR gate = 'block' GROUP BY 1",
        "domain_analysis": _DKB.rstrip() + f""", sj AS (SELECT DISTINCT subject, sd FROM f WHERE {S})
SELECT 'domain' AS part, d AS key, count(*) AS n FROM (SELECT unnest(sd) AS d FROM sj) GROUP BY d UNION ALL SELECT 'kind', CASE WHEN len(sd) = 0 THEN 'unclassified' WHEN len(sd) > 1 THEN 'several' ELSE 'one' END, count(*) FROM sj GROUP BY 2
UNION ALL SELECT 'suspicious', '', count(*) FROM f JOIN sc ON f.id = sc.id WHERE source LIKE 'idea:%' AND score > 0 AND score < 0.3""",
        "bridge_add_dedup": _bridge_add(False),
        "bridge_add_undirected": _bridge_add(True),
        "bridge_find": "SELECT id, term_a, term_b, strength FROM bridges WHERE replace(lower(term_a), ' ', '_') = 'tizepebo' OR replace(lower(term_b), ' ', '_') = 'tizepebo'",
        "bridge_between": "SELECT id, term_a, term_b FROM bridges WHERE (domain_a = 'chemistry' AND domain_b = 'physics') OR (domain_a = 'physics' AND domain_b = 'chemistry')",
        "bridge_stats": "SELECT bridge_type, count(*) AS n FROM bridges GROUP BY bridge_type",
        "bridge_examples": "SELECT b.id, count(e.id) AS n_examples FROM bridges b LEFT JOIN bridge_examples e ON e.bridge_id = b.id GROUP BY b.id",
        "bridge_facts": KB + "SELECT DISTINCT kb.id, b.id AS bridge_id FROM kb JOIN bridges b ON b.deleted_at IS NULL AND (replace(lower(term_a), ' ', '_') IN (subject, object) OR replace(lower(term_b), ' ', '_') IN (subject, object))",
        "bridge_discover_shared": _SHARED + "SELECT * FROM sm",
        "bridge_discover_stated": KB + f"SELECT DISTINCT subject AS term_a, object AS term_b, predicate, 'inspirational' AS bridge_type, 0.7::DOUBLE AS confidence FROM kb WHERE truth_value = 'T' AND predicate IN {_in(V.BRIDGE_PREDICATES)}",
        "bridge_discover_structural": KB.rstrip() + f",\n{_DOMAINS},\n{_structural(V.STRUCTURAL_WORDS)} SELECT * FROM st",
        "bridge_structural_words": KB.rstrip() + f",\n{_DOMAINS},\n{_structural(STRUCTURAL_WORDS)} SELECT * FROM st",
        "bridge_structural_members": KB.rstrip() + f",\n{_DOMAINS},\n{_structural(STRUCTURAL_WORDS)} SELECT subject, array_to_string(domains, ',') AS domains, array_to_string(ws, ',') AS words FROM sw",
        "bridge_shared_members": _SHARED + "SELECT predicate, object, domain, subject FROM d",
        "bridge_stated_by": KB + f"SELECT DISTINCT subject AS term_a, object AS term_b, predicate, 'inspirational' AS bridge_type, 0.7::DOUBLE AS confidence FROM kb WHERE truth_value = 'T' AND predicate IN {_in(STATED_BY)}",
        "bridge_potential": _SHARED.rstrip() + f""",
{_structural(V.STRUCTURAL_WORDS)},
al AS (SELECT term_a, term_b, 1 AS strategy, bridge_type, confidence FROM sm UNION ALL SELECT subject, object, 2, 'inspirational', 0.7::DOUBLE FROM kb WHERE truth_value = 'T' AND predicate IN {_in(V.BRIDGE_PREDICATES)} UNION ALL SELECT term_a, term_b, 3, 'structural', confidence FROM st),
{best} SELECT * FROM bs""",
        "bridge_relevant": KB.rstrip() + f""", w AS (SELECT DISTINCT t FROM (SELECT unnest([subject, object]) AS t FROM kb) WHERE {ATOM.format("t")}),
s AS (SELECT id, unnest([replace(lower(term_a), ' ', '_'), replace(lower(term_b), ' ', '_')]) AS side FROM bridges),
h AS (SELECT DISTINCT side FROM (SELECT DISTINCT side FROM s WHERE side <> '') JOIN w ON contains(t, side) OR contains(side, t))
SELECT DISTINCT id FROM s JOIN h USING (side)""",
        "bridge_pairs": _CROSS.rstrip().replace("LIMIT 50", f"LIMIT {PAIRS}") + f""",
{_DOMAINS.replace("terms AS (SELECT DISTINCT unnest([subject, object]) AS term FROM kb)", "terms AS (SELECT DISTINCT unnest(string_split(subject, ',')) AS term FROM r)")},
q AS (SELECT DISTINCT subject, string_split(subject, ',')[1] AS term_a, string_split(subject, ',')[2] AS term_b FROM r)
SELECT subject, term_a, term_b FROM q JOIN dom x ON term_a = x.term JOIN dom y ON term_b = y.term WHERE len(x.domains) > 0 AND len(y.domains) > 0 AND x.domains <> y.domains""",
        "fts_tokens": _TOKENS + "SELECT token, entry_id, col, pos FROM tk",
        "fts_index": _INDEX + f"""tk AS (SELECT unnest(ws) AS token FROM w),
{_stems("tk")} SELECT stem AS token, count(*) AS n FROM tk JOIN st USING (token) GROUP BY stem""",
        "fts_search": _INDEX + f"""m(term, synonym) AS (VALUES {_MANUAL}), sa AS (SELECT * FROM kb WHERE truth_value = 'T' AND {S} AND {O}),
sy AS (SELECT object AS term, subject AS synonym FROM sa WHERE predicate IN ('is_a', 'subclass_of') UNION SELECT subject, object FROM sa WHERE predicate IN ('has_part', 'has_component', 'contains') UNION SELECT term, synonym FROM m),
ph AS (SELECT row_number() OVER () AS id, {_WORDS.format("x")} AS ws FROM (SELECT 'tidal_basin' AS x UNION SELECT 'slow' UNION SELECT synonym FROM sy WHERE term IN ('tidal_basin', 'slow'))),
tk AS (SELECT unnest(ws) AS token FROM w UNION ALL SELECT unnest(ws) FROM ph),
{_stems("tk")},
pw AS (SELECT id, ws[i] AS token, i FROM (SELECT id, ws, unnest(range(1, len(ws) + 1)) AS i FROM ph)),
pp AS (SELECT DISTINCT ' ' || string_agg(stem, ' ' ORDER BY i) || ' ' AS phrase FROM pw JOIN st USING (token) GROUP BY id),
fw AS (SELECT id, col, ws[i] AS token, i FROM (SELECT id, col, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)),
fs AS (SELECT id, ' ' || string_agg(stem, ' ' ORDER BY i) || ' ' AS line FROM fw JOIN st USING (token) GROUP BY id, col)
SELECT id, subject, object FROM kb SEMI JOIN (SELECT DISTINCT id FROM fs JOIN pp ON contains(line, phrase)) USING (id)""",
        "fts_phrase": KB + "SELECT id, subject, object FROM kb WHERE truth_value = 'T' AND (contains(' ' || regexp_replace(subject, '[_,-]+', ' ', 'g') || ' ', ' tidal basin ') OR contains(' ' || regexp_replace(object, '[_,-]+', ' ', 'g') || ' ', ' tidal basin '))",
        "log_recent": "SELECT event_id AS id, event_type, 0 AS grade_level, props AS message FROM events ORDER BY event_id DESC LIMIT 50",
        "confusions": _CONFUSED,
        "show_confusions": f"SELECT subject || ' ≠ ' || confused_with AS shown, coalesce(reason, '') AS reason FROM ({_CONFUSED})",
        "show_unresolved": KB.rstrip() + """, u AS (SELECT * FROM kb WHERE truth_value = 'M' ORDER BY id LIMIT 30), a AS (SELECT subject FROM u WHERE context <> '' GROUP BY subject HAVING count(DISTINCT context) > 1)
SELECT id, CASE WHEN subject IN (SELECT subject FROM a) THEN subject || ' (' || context || ')' ELSE subject END || ' → ' || predicate || '(' || object || ')' AS shown FROM u""",
        "show_bridges": f"""SELECT id, coalesce(term_a, '?') || ' ↔ ' || coalesce(term_b, '?') AS shown, coalesce(nullif(bridge_type, ''), '?') AS bridge_type, coalesce(strength, 0.5) AS strength, {_bar("coalesce(strength, 0.5)")} AS bar,
CASE WHEN coalesce(domain_a, '') = '' AND coalesce(domain_b, '') = '' THEN '' ELSE coalesce(nullif(domain_a, ''), '?') || ' ↔ ' || coalesce(nullif(domain_b, ''), '?') END AS domains, coalesce(nullif(reason, ''), 'no reason given') AS reason, coalesce(teaching_note, '') AS teaching_note
FROM bridges WHERE deleted_at IS NULL""",
        "show_candidates": _SHARED.rstrip() + f""",
{_structural(V.STRUCTURAL_WORDS)},
al AS (SELECT term_a, term_b, 1 AS strategy, bridge_type, confidence FROM sm UNION ALL SELECT subject, object, 2, 'inspirational', 0.7::DOUBLE FROM kb WHERE truth_value = 'T' AND predicate IN {_in(V.BRIDGE_PREDICATES)} UNION ALL SELECT term_a, term_b, 3, 'structural', confidence FROM st),
{best} SELECT term_a || ' ↔ ' || term_b AS shown, confidence, {_bar("confidence")} AS bar, bridge_type AS suggested_type, CASE strategy WHEN 1 THEN 'shared property' WHEN 2 THEN 'stated by a fact' ELSE 'same structural words' END AS reason FROM bs""",
        "learner_report": KB + """SELECT CASE WHEN n >= 5 AND f / n::DOUBLE >= 0.75 THEN 'block' WHEN n >= 5 AND t / n::DOUBLE >= 0.75 THEN 'allow' ELSE 'uncertain' END AS suggestion, link, inherited,
round(CASE WHEN n >= 5 AND f / n::DOUBLE >= 0.75 THEN f ELSE t END / n::DOUBLE, 4) AS rate, n AS total
FROM (SELECT context AS link, predicate AS inherited, count(*) FILTER (truth_value = 'T') AS t, count(*) FILTER (truth_value = 'F') AS f, count(*) AS n FROM kb WHERE truth_value IN ('T', 'F') GROUP BY context, predicate)""",
        "p3_hierarchies": _TREE + """r AS (SELECT c, p, 1 AS d FROM e UNION SELECT r.c, e.p, r.d + 1 FROM r JOIN e ON r.p = e.c WHERE r.d < 200),
dp AS (SELECT c, p, min(d) AS d FROM r GROUP BY c, p), rg AS (SELECT c AS ring FROM dp WHERE c = p),
u AS (SELECT c, coalesce(list(p ORDER BY d, p) FILTER (c <> p), []) AS up, coalesce(max(d) FILTER (c <> p), 0) AS depth, min(ring) AS ring, bool_or(c = p) AS on_ring FROM dp LEFT JOIN rg ON p = ring GROUP BY c
      UNION ALL SELECT DISTINCT p, []::VARCHAR[], 0, NULL, false FROM dp WHERE p NOT IN (SELECT c FROM dp)),
b AS (SELECT p, count(*) AS k FROM dp WHERE c <> p GROUP BY p)
SELECT c AS node, coalesce(ring, up[-1], c) AS root, depth, array_to_string(list_prepend(c, up), '→') AS path, coalesce(k, 0) AS descendants,
CASE WHEN on_ring THEN 'ring' WHEN ring IS NOT NULL THEN 'to_ring' ELSE 'tree' END AS kind FROM u LEFT JOIN b ON u.c = b.p""",
        "question_terms": rf"""WITH q AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0b\f\r]+'), lambda w: length(w) > 2 AND replace(lower(w), '?', '') NOT IN {_in(V.STOP_WORDS)}) AS ws FROM documents),
i AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM q)
SELECT doc_id, (i - 1)::INTEGER AS pos, replace(replace(lower(ws[i]), '?', ''), '''s', '') AS term FROM i""",
        "reply_sections": r"""WITH s AS (SELECT doc_id, string_split_regex(text, '(?i)(?:^|\n)[ *#]*(?:REASONING|FACTS|CONFUSED)\s*:[ *]*') AS parts,
 list_transform(regexp_extract_all(text, '(?i)(?:^|\n)[ *#]*(REASONING|FACTS|CONFUSED)\s*:[ *]*', 1), lambda x: upper(x)) AS names FROM documents WHERE text IS NOT NULL)
SELECT doc_id, coalesce(trim(parts[list_position(names, 'FACTS') + 1], ' ' || chr(10) || chr(9)), '') AS facts, coalesce(trim(parts[list_position(names, 'CONFUSED') + 1], ' ' || chr(10) || chr(9)), '') AS confused,
coalesce(trim(parts[list_position(names, 'REASONING') + 1], ' ' || chr(10) || chr(9)), '') AS reasoning FROM s""",
        "chunk_text": f"WITH RECURSIVE {_chunks('documents', 'doc_id', 'text', 600, 80)} SELECT doc_id AS id, unnest(range(len(chunks)))::INTEGER AS chunk_no, unnest(chunks) AS chunk FROM ch",
        "wiki_extracts": rf"""WITH RECURSIVE x AS (SELECT doc_id, text, regexp_extract_all(text, '(?s)(<doc\s[^>]*>.*?</doc>)', 1) AS ds FROM documents WHERE text IS NOT NULL),
a AS (SELECT doc_id, regexp_extract(dd, 'title="([^"]*)"', 1) AS title, trim(regexp_extract(dd, '(?s)<doc\s[^>]*>(.*?)</doc>', 1), ' ' || chr(10) || chr(9)) AS body FROM (SELECT doc_id, unnest(ds) AS dd FROM x)
      UNION ALL SELECT doc_id, '', trim(text, ' ' || chr(10) || chr(9)) FROM x WHERE len(ds) = 0),
b AS (SELECT *, row_number() OVER () AS rn FROM a WHERE length(body) >= 100),
{_chunks('b', 'doc_id, title, rn', 'body', 1500, 200)} SELECT doc_id AS id, title, unnest(range(len(chunks)))::INTEGER AS chunk_no, unnest(chunks) AS chunk FROM ch""",
        "wiki_sections": rf"""WITH RECURSIVE x AS (SELECT doc_id, string_split_regex(text, '\n={{2,}}\s*\n|\n{{3,}}') AS ss FROM documents WHERE text IS NOT NULL),
y AS (SELECT doc_id, unnest(range(len(ss)))::INTEGER AS section, trim(unnest(ss), ' ' || chr(10) || chr(9) || chr(13)) AS body FROM x),
b AS (SELECT * FROM y WHERE length(body) >= 100),
{_chunks('b', 'doc_id, section', 'body', 1500, 200)} SELECT doc_id AS id, section, unnest(range(len(chunks)))::INTEGER AS chunk_no, unnest(chunks) AS chunk FROM ch""",
        "textbook_read": f"""WITH RECURSIVE b AS (SELECT doc_id // 50 AS part, string_agg(text, chr(10) || chr(10) ORDER BY doc_id, text) AS body FROM documents WHERE text IS NOT NULL GROUP BY doc_id // 50),
{_chunks('b', 'part', 'body', 1500, 200)} SELECT chunk, count(*) AS n FROM (SELECT unnest(chunks) AS chunk FROM ch) WHERE length(chunk) >= 50 GROUP BY chunk""",
        "reply_verdicts": r"""WITH d AS (SELECT doc_id, upper(regexp_extract(text, '(?i)VERDICT\s*:[\s*_`]*([TFM])', 1)) AS v, trim(regexp_extract(text, '(?i)REASON\s*:[ *_`]*([^\n]*)', 1)) AS reason FROM documents WHERE text LIKE '%VERDICT%')
SELECT doc_id, CASE WHEN v = '' THEN 'M' ELSE v END AS verdict, reason FROM d""",
        "reply_triples": f"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
i AS (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM l),
p AS (SELECT doc_id, (i - 1)::INTEGER AS line_no, list_transform(string_split(ltrim(ls[i], '-*•–0123456789.) ' || chr(9)), '|'), lambda x: trim(x)) AS p FROM i WHERE contains(ls[i], '|')),
q AS (SELECT doc_id, line_no, p[1] AS s, p[2] AS pr, p[3] AS o, upper(left(coalesce(p[4], ''), 1)) AS t FROM p WHERE len(p) >= 3 AND p[1] <> '' AND p[2] <> '' AND p[3] <> '')
SELECT doc_id, line_no, {norm_sql("s")} AS subject, {norm_sql("pr")} AS predicate, {norm_sql("o")} AS object, CASE WHEN t IN ('T', 'F', 'M') THEN t ELSE 'T' END AS truth_value FROM q""",
        "fnv1a": KB.rstrip() + """, h AS (SELECT id, list_reduce(list_transform(string_split(subject || '|' || context || '|' || predicate || '|' || object, ''), lambda c: ord(c)::UBIGINT),
 lambda a, b: ((xor(a, b)::UHUGEINT * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT, 14695981039346656037::UBIGINT) AS h FROM kb)
SELECT id, CASE WHEN h > 9223372036854775807 THEN (h::HUGEINT - 18446744073709551616::HUGEINT)::BIGINT ELSE h::BIGINT END AS quad_hash FROM h""",
        "pulse_profile_size": KB + f"""SELECT subject, 'profile_size' AS predicate, 'has_' || count(DISTINCT predicate) || '_predicates_and_' || count(DISTINCT object) || '_objects' AS object, 'merged ' || count(*) AS evidence
FROM kb WHERE truth_value = 'T' AND {S} GROUP BY subject HAVING count(*) >= 3""",
        "pulse_transitive_variant": _CHAINS.replace("(a.context = b.context OR a.context = 'general' OR b.context = 'general')", "true") + f""", c AS (SELECT * FROM ch ANTI JOIN kb USING (subject, context, predicate, object) WHERE verdict LIKE 'allow%' QUALIFY row_number() OVER (PARTITION BY subject, context, predicate, object ORDER BY a_id, b_context, b_id) = 1)
SELECT subject, context, predicate, object, CASE WHEN link IN {_in([*V.TRANSPARENT_LINKS, *V.SEMI_TRANSPARENT_LINKS])} THEN 'T' ELSE 'M' END AS truth_value
FROM c ORDER BY a_id, b_context, b_id, subject, context, predicate, object LIMIT 50""",
        "pulse_cross_variant": _CROSS.replace("count(*) <= 0.5 * (SELECT n FROM tot)", "count(*) <= 8").replace(f"predicate NOT IN {_in(V.CROSS_SKIP)}", "predicate <> 'profile_size'") + "SELECT subject, context, predicate, object, 'T' AS truth_value, CASE WHEN ok THEN 'bridge-validated' ELSE 'shared' END AS evidence FROM r",
        "profile_pairs_variant": _PROFILES + "SELECT context, array_to_string(p1, ',') AS p1, array_to_string(p2, ',') AS p2, round(sim, 6) AS sim FROM sm WHERE sim >= 0.3 AND len(p1) >= 3 AND len(p2) >= 3 AND len(list_intersect(p1, p2)) >= 2",
        "all_true": KB + "SELECT id, subject, context, predicate, object FROM kb WHERE truth_value = 'T'",
        "next_generation": KB + "SELECT (coalesce(max(generation), 0) + 1)::INTEGER AS generation FROM kb",
        "concept_lookup": "SELECT context, text AS definition FROM documents WHERE subject = 'groundwater_basin' AND context IS NOT NULL AND text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY context ORDER BY doc_id DESC) = 1",
        "kb_report_parts": _TAX + f""", src AS (SELECT source AS key, count(*) AS n FROM kb GROUP BY source ORDER BY n DESC, source LIMIT 10),
st AS (SELECT * FROM kb WHERE truth_value = 'T' AND {S} AND {O}), m(term, synonym) AS (VALUES {_MANUAL}),
sy AS (SELECT object, subject FROM st WHERE predicate IN ('is_a', 'subclass_of') UNION SELECT subject, object FROM st WHERE predicate IN ('has_part', 'has_component', 'contains') UNION SELECT term, synonym FROM m),
ct AS (SELECT DISTINCT x FROM (SELECT unnest([subject, object]) AS x FROM kb WHERE truth_value = 'T') WHERE {ATOM.format("x")}),
kw(domain, k) AS (VALUES {_values(_CLUSTER_PAIRS)}), tt AS (SELECT * FROM kb WHERE truth_value = 'T'),
dc AS (SELECT id, context FROM tt WHERE context NOT IN ('', 'general', 'cross_domain')
 UNION ALL SELECT DISTINCT id, domain FROM (SELECT * FROM tt WHERE context IN ('', 'general', 'cross_domain')) JOIN kw ON contains('_' || subject || '_', '_' || k || '_') OR contains('_' || object || '_', '_' || k || '_'))
SELECT 'source' AS part, key, n FROM src UNION ALL SELECT 'table', 'hierarchy', count(*) FROM h UNION ALL SELECT 'table', 'centrality', count(*) FROM ct UNION ALL SELECT 'table', 'synonyms', count(*) FROM sy
UNION ALL SELECT 'table', 'domains', count(*) FROM dc UNION ALL SELECT 'table', 'predicates', {len(_LOOKUP)}""",
        "compatible_pairs": _DKB + "SELECT id, len(sd) = 0 OR len(od) = 0 OR score >= 0.7 AS compatible, score > 0 AS analogous FROM f JOIN sc USING (id)",
        "clean_facts": _DKB.rstrip() + f",\n{_NONSENSE} SELECT id, subject, context, predicate, object FROM f JOIN ns USING (id) WHERE reason = 'ok'",
        "rule_learned": KB.rstrip() + f""", s AS (SELECT context AS l, predicate AS i, CASE WHEN count(*) >= 5 AND count(*) FILTER (truth_value = 'F') / count(*)::DOUBLE >= 0.75 THEN 'block' WHEN count(*) >= 5 AND count(*) FILTER (truth_value = 'T') / count(*)::DOUBLE >= 0.75 THEN 'allow' END AS what
 FROM kb WHERE truth_value IN ('T', 'F') GROUP BY context, predicate),
bi AS (SELECT DISTINCT i FROM s WHERE what = 'block'), bl AS (SELECT DISTINCT l FROM s WHERE what = 'block'), ai AS (SELECT DISTINCT i FROM s WHERE what = 'allow'), ap AS (SELECT l || '|' || i AS pair FROM s WHERE what = 'allow'),
g(link) AS (VALUES {_values([(x,) for x in GATE_LINKS])}), p AS (SELECT DISTINCT predicate AS inherited FROM kb),
v AS (SELECT link, inherited, link IN {_in([*V.OPAQUE_LINKS, *V.SEMI_TRANSPARENT_LINKS])} OR link IN (SELECT l FROM bl) AS closed, inherited IN {_in(V.INTRINSIC)} OR inherited IN (SELECT i FROM bi) AS intrinsic, inherited IN {_in(V.RELATIONAL)} OR inherited IN (SELECT i FROM ai) AS relational FROM g, p)
SELECT link, inherited, CASE WHEN link || '|' || inherited IN (SELECT pair FROM ap) THEN 'allow:override' WHEN link IN {_in(V.TRANSPARENT_LINKS)} THEN 'allow:transparent' WHEN link IN {_in(V.SEMI_TRANSPARENT_LINKS)} AND inherited IN {_in(V.IDENTITY)} THEN 'allow:identity'
 WHEN closed AND intrinsic THEN 'block:intrinsic' WHEN closed AND relational THEN 'allow:relational' WHEN link = 'profile_size' OR inherited = 'profile_size' THEN 'block:profile_size' WHEN closed THEN 'allow:unverified' ELSE 'allow:default' END AS verdict FROM v""",
        "path_bounded": _paths("tizepebo", "kekegete", False),
        "path_outgoing": _paths("tizepebo", "futadala", True),
        "question_answer": _answer(["tizepebo", "relate", "futadala"]),
        "p5_cascade": """WITH n1 AS (SELECT n_nationkey FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region WHERE r_name <> 'ASIA')),
c2 AS (SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM n1)), s2 AS (SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM n1)),
o AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS m, CASE WHEN c_acctbal < 0 THEN 1 WHEN o_custkey IN (SELECT c_custkey FROM c2) THEN 3 END AS level FROM orders JOIN customer ON o_custkey = c_custkey),
l AS (SELECT strftime(l_shipdate, '%Y-%m') AS m, s_acctbal < 0 AS gone, l_suppkey IN (SELECT s_suppkey FROM s2) AS far, level FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN o ON l_orderkey = o_orderkey),
a AS (SELECT 'nation' AS table_name, 'region' AS via, 'unknown' AS ref_month, 'missing' AS reason, 1 AS level FROM n1
 UNION ALL SELECT 'customer', 'nation', 'unknown', 'inherited', 2 FROM c2 UNION ALL SELECT 'supplier', 'nation', 'unknown', 'inherited', 2 FROM s2
 UNION ALL SELECT 'orders', 'customer', m, CASE WHEN level = 1 THEN 'deleted' ELSE 'inherited' END, level FROM o WHERE level IS NOT NULL
 UNION ALL SELECT 'lineitem', 'supplier', m, 'deleted', 1 FROM l WHERE gone
 UNION ALL SELECT 'lineitem', 'orders', m, 'inherited', 2 FROM l WHERE NOT gone AND level = 1
 UNION ALL SELECT 'lineitem', 'supplier', m, 'inherited', 3 FROM l WHERE NOT gone AND level IS DISTINCT FROM 1 AND far
 UNION ALL SELECT 'lineitem', 'orders', m, 'inherited', 4 FROM l WHERE NOT gone AND level IS NOT DISTINCT FROM 3 AND NOT far)
SELECT table_name, via, ref_month, reason, level, count(*) AS n FROM a GROUP BY ALL""",
        "seed_read": f"""SELECT * FROM (SELECT {norm_sql("subject")} AS subject, coalesce(context, 'general') AS context, {norm_sql("predicate")} AS predicate, {norm_sql("object")} AS object, coalesce(truth_value, 'T') AS truth_value, coalesce(source, 'seed') AS source, coalesce(generation, 0) AS generation FROM entries)
WHERE subject <> '' AND predicate <> '' AND object <> ''""",
        "conceptnet_read": f"""WITH nm(name, relation) AS (VALUES {_values(sorted((v, k) for k, v in V.CONCEPTNET_RELATIONS.items()))}),
kb AS (SELECT {norm_sql(norm_sql("subject"))} AS subject, name AS predicate, {norm_sql(norm_sql("object"))} AS object FROM entries JOIN nm ON lower(predicate) = name WHERE generation >= 1 AND {norm_sql("subject")} <> '' AND {norm_sql("object")} <> ''),
{_DOMAINS} SELECT subject, {_CONTEXT} AS context, predicate, object FROM kb JOIN dom ON subject = term""",
        "wikidata_read": f"""WITH nm(name, property) AS (VALUES {_values(sorted((v, k) for k, v in V.WIKIDATA_PROPERTIES.items()))}),
kb AS (SELECT {norm_sql("subject")} AS subject, name AS predicate, {norm_sql("object")} AS object FROM entries JOIN nm ON lower(predicate) = name WHERE {norm_sql("subject")} <> '' AND {norm_sql("object")} <> ''),
{_DOMAINS} SELECT subject, {_CONTEXT} AS context, predicate, object FROM kb JOIN dom ON subject = term""",
        "queue_order": _TASKS,
        "queue_next": f"SELECT * FROM ({_TASKS}) ORDER BY priority DESC, id LIMIT 20",
    }
