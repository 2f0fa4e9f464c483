"""SQL checks (DuckDB, RE2 patterns) of the queries, written from what the rules mean."""

from __future__ import annotations

from tonewright.functions import fixed_values as V
from tonewright.functions.text import sql_text as q
from tonewright.operators import hits as H
from tonewright.operators.detect import PREVIEW
from tonewright.plans.seeds import ACCEPTANCE_SQL, ALONE_SQL, LONG_SQL, SEEDED_SQL, SPANS_SQL

BAR = "¦"
#: RE2 has no look-ahead: pattern -> (pattern without it, condition on the text after the match).
AHEAD = {
    V.JUDGED["p36_absolute_claim"][2][1]: ("第一", "NOT regexp_matches(rest, '^[次步眼天时批版个章节行轮阶段部分篇张条页组列位层种项段级队人方，、]')"),
    V.JUDGED["p36_absolute_claim"][2][3]: ("唯一", r"regexp_matches(rest, '^\s*(?:能够|可以|能|真正|彻底|完全|满足|解决|正确|有效|值得|选择|出路|办法|途径)')"),
    V.JUDGED["p38_vague_elevation"][2][5]: (
        "(?:我|自己)?(?:成长了?很多|成长了不少|收获(?:了)?很多|受益匪浅|深有感触|感慨良多)",
        r"NOT regexp_matches(rest, '^[^。！？\n]{0,20}(?:因为|具体|比如|从[^。！？\n]{1,10}到)')",
    ),
}
BODY_SQL = (
    r"bare AS (SELECT *, regexp_replace(regexp_replace(text, '(?s)```.*?```', '', 'g'), '`[^`\n]+`', '', 'g') AS cut FROM seeded), "
    r"bodies AS (SELECT doc_id, text, CASE WHEN length(regexp_replace(cut, '^\s+|\s+$', '', 'g')) < 200 AND length(text) > 200 THEN text ELSE cut END AS body FROM bare)"
)
WITH = f"WITH {SEEDED_SQL}, {BODY_SQL}"


def words(expression: str, listed: list[str]) -> str:
    """List of the listed words that a text holds."""
    return f"list_filter([{', '.join(map(q, listed))}], lambda w: contains({expression}, w))"


def matches(expression: str, patterns: list[str], ignore_case: bool) -> str:
    flag = "(?i)" if ignore_case else ""
    parts = [f"regexp_extract_all({expression}, {q(flag + p)})" for p in patterns]
    return parts[0] if len(parts) == 1 else f"flatten([{', '.join(parts)}])"


def span_rows(source: str, expression: str, pattern: str) -> str:
    """SELECT of doc_id, s, e, t for every match of a pattern."""
    pattern, condition = AHEAD.get(pattern, (pattern, "true"))
    return (
        f"SELECT doc_id, s, s + length(t) AS e, t FROM (SELECT doc_id, t, s, substr(x, s + length(t) + 1) AS rest, substr(x, s, 1) AS prior FROM ("
        f"SELECT doc_id, x, m[i] AS t, (list_sum(list_transform(g[1:i], lambda p: length(p))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda p: length(p))), 0))::INT AS s "
        f"FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, {expression} AS x, regexp_extract_all({expression}, {q(pattern)}) AS m, string_split_regex({expression}, {q(pattern)}) AS g FROM {source})))) WHERE {condition}"
    )


def judged_rows(pattern_id: str, source: str = "bodies", expression: str = "body") -> str:
    """SELECT of doc_id, s, e, t: distinct spans of a judged pattern, with its least number."""
    _, least, patterns = V.JUDGED[pattern_id]
    union = " UNION ".join(span_rows(source, expression, p) for p in patterns)
    return f"SELECT * FROM ({union}) WHERE regexp_matches(t, '\\S') QUALIFY count(*) OVER (PARTITION BY doc_id) >= {least}"


def report(rows_sql: str, order: str = "s, e", more: str = "") -> str:
    """n_hits and matched a document, from rows with doc_id and t."""
    return f"{WITH}{more} SELECT b.doc_id, count(r.t) AS n_hits, coalesce(string_agg(r.t, '{BAR}' ORDER BY {order}), '') AS matched FROM bodies b LEFT JOIN ({rows_sql}) r ON b.doc_id = r.doc_id GROUP BY b.doc_id"


def listed_report(list_sql: str) -> str:
    return f"{WITH} SELECT doc_id, len(l)::BIGINT AS n_hits, array_to_string(l, '{BAR}') AS matched FROM (SELECT doc_id, {list_sql} AS l FROM bodies)"


def tier1_en_list(expression: str) -> str:
    return f"list_filter([{', '.join(map(q, V.TIER1_EN))}], lambda w: contains(lower({expression}), lower(rtrim(w, '.,;:!?'))))"


def parallel_list(expression: str, pattern: str, n: int) -> str:
    strong = "|".join(V.STRONG_KEYWORDS)
    known = "|".join(V.STRONG_KEYWORDS + V.WEAK_KEYWORDS)
    groups = [f"regexp_extract_all({expression}, {q(pattern)}, {g})" for g in range(n + 1)]
    item = "regexp_replace(g, " + q(f"^{V.WRAPPERS}+|{V.WRAPPERS}+$") + ", '', 'g')"
    parts = [f"z[{g + 1}]" for g in range(1, n + 1)]
    items = f"[{', '.join(parts)}]"
    short = f"list_max(list_transform({items}, lambda g: length({item}))) <= {V.LONGEST_ITEM}"
    any_strong = f"list_bool_or(list_transform({items}, lambda g: regexp_matches(g, {q(strong)})))"
    all_known = f"list_bool_and(list_transform({items}, lambda g: regexp_matches(g, {q(known)})))"
    zipped = f"list_transform(range(1, len({groups[0]}) + 1), lambda i: [{', '.join(f'({g})[i]' for g in groups)}])"
    return f"list_transform(list_filter({zipped}, lambda z: {short} AND ({any_strong} OR {all_known})), lambda z: z[1])"


def sentence_list(expression: str, pattern_id: str) -> str:
    pattern = V.SENTENCES[pattern_id]
    if pattern == V.TRIAD:
        return parallel_list(expression, pattern, 3)
    if pattern == V.FOURFOLD:
        return parallel_list(expression, pattern, 4)
    return matches(expression, [pattern], False)


MASKED_SQL = r", masked AS (SELECT doc_id, body, regexp_replace(regexp_replace(regexp_replace(body, '(?s)```.*?```', ' ', 'g'), '`[^`\n]+`', ' ', 'g'), '(?m)^\s*>.*$', ' ', 'g') AS x FROM bodies)"


def slang_rows(listed: list[str], covered: bool = True) -> str:
    parts = []
    for w in listed:
        if w.isascii():
            inner = span_rows("masked", "x", f"(?i){w}").replace("WHERE true", "WHERE NOT regexp_matches(rest, '^[A-Za-z]') AND (s = 0 OR NOT regexp_matches(prior, '[A-Za-z]'))")
        elif covered and w in H.COVERED:
            inner = span_rows("masked", "x", w).replace("WHERE true", f"WHERE s = 0 OR NOT contains({q(H.COVERED[w])}, prior)")
        else:
            inner = span_rows("masked", "x", w)
        parts.append(inner)
    return " UNION ALL ".join(parts)


def slang_sql() -> str:
    severity = "CASE WHEN h > 0 OR (l >= 6 AND l / (n / 100.0) > 0.55) THEN 'rewrite' WHEN l >= 3 AND l / (n / 100.0) > 0.25 THEN 'warn' ELSE 'pass' END"
    return (
        f"{WITH}{MASKED_SQL}, hard AS (SELECT doc_id, count(*) AS h, string_agg(t, '{BAR}' ORDER BY s, e) AS ht FROM ({slang_rows(V.HARD_SLANG)}) GROUP BY 1), "
        f"light AS (SELECT doc_id, count(*) AS l, string_agg(t, '{BAR}' ORDER BY s, e) AS lt FROM ({slang_rows(V.LIGHT_COLLOQUIAL)}) GROUP BY 1), "
        r"sized AS (SELECT b.doc_id, coalesce(h, 0) AS h, coalesce(l, 0) AS l, coalesce(ht, '') AS ht, coalesce(lt, '') AS lt, greatest(length(regexp_replace(body, '\s', '', 'g')), 1) AS n "
        "FROM bodies b LEFT JOIN hard USING (doc_id) LEFT JOIN light USING (doc_id)) "
        f"SELECT doc_id, ht AS hard_hits, lt AS light_hits, n::BIGINT AS n_chars, {severity} AS severity FROM sized"
    )


def hit_rows(scene: str) -> str:
    """UNION ALL of doc_id, category, pattern_id, t, penalty for a scene, before exemptions."""
    penalties = V.PROFILES[scene].get("penalties", {})
    each = lambda lst, category, pid, cost: f"SELECT doc_id, '{category}' AS category, {q(pid) if pid else 'NULL'} AS pattern_id, unnest({lst}) AS t, {cost} AS penalty FROM bodies"
    out = [each(words("body", V.TIER1_ZH), "tier1_zh", None, 5), each(tier1_en_list("body"), "tier1_en", None, 5), each(words("body", V.IDIOMS), "idiom_fillers", None, 3)]
    for category, cost, patterns, ignore_case in H.LISTED.values():
        out.append(each(matches("body", patterns, ignore_case), category, None, penalties.get(category, cost)))
    out.append(each(words("body", [w for w in V.RESIDUAL_WORDS if w not in V.TIER1_ZH]), "lexicon_residual", None, 4))
    for p in V.SENTENCES:
        out.append(each(sentence_list("body", p), "pattern", p, 0 if p == "p23_false_precision" else 2))
    out.append(each(matches("body", H.UNDUE_PATTERNS, True), "pattern", H.UNDUE, 2))
    hard, light = penalties.get(H.SLANG, 3), penalties.get(H.SLANG, 1)
    out.append(f"SELECT doc_id, 'pattern', '{H.SLANG}', t, {hard} FROM ({slang_rows(V.HARD_SLANG)})")
    if light > 0:
        out.append(f"SELECT doc_id, 'pattern', '{H.SLANG}', unnest(string_split(light_hits, '{BAR}')), {light} FROM graded WHERE severity <> 'pass' AND light_hits <> ''")
    for p in H.active(scene):
        cost = penalties.get(p, V.JUDGED[p][0])
        if cost > 0:
            out.append(f"SELECT doc_id, 'pattern', '{p}', t, {cost} FROM ({judged_rows(p)})")
    return " UNION ALL ".join(out)


def score_sql(scene: str) -> str:
    profile = V.PROFILES[scene]
    keep = ["true"]
    if profile.get("off"):
        keep.append(f"category NOT IN ({', '.join(map(q, profile['off']))})")
    for key, listed in profile.get("exempt", {}).items():
        keep.append(f"NOT (coalesce(pattern_id, category) = {q(key)} AND regexp_matches(t, {q('|'.join(listed))}))")
    warn_at, rewrite_at, block_at = profile["policy"]
    red = profile.get("compliance", [])
    own = f"coalesce(bool_or(pattern_id IN ({', '.join(map(q, red))})), false)" if red else "false"
    cross = []
    for name, other in V.PROFILES.items():
        if name != scene and other.get("compliance"):
            for p in other["compliance"]:
                cross.append(f"SELECT doc_id, '{p}' AS pid FROM ({judged_rows(p, 'seeded', 'text')}) SEMI JOIN (SELECT doc_id FROM seeded WHERE regexp_matches(text, {q('|'.join(other['domain']))})) USING (doc_id)")
    cross_sql = " UNION ".join(cross) if cross else "SELECT 0 AS doc_id, '' AS pid WHERE false"
    graded = slang_sql()
    graded = graded[len(WITH) + len(MASKED_SQL) :].lstrip(", ")
    return (
        f"{WITH}{MASKED_SQL}, {graded.split(' SELECT doc_id, ht AS hard_hits')[0]}, graded AS (SELECT doc_id, ht AS hard_hits{graded.split(' SELECT doc_id, ht AS hard_hits')[1]}), "
        f"found AS (SELECT * FROM ({hit_rows(scene)}) WHERE {' AND '.join(keep)}), crossed AS (SELECT DISTINCT doc_id, pid FROM ({cross_sql})), "
        f"sums AS (SELECT b.doc_id, length(body) AS n, coalesce(sum(penalty), 0) AS raw, count(f.t) AS hit_count, {own} AS own FROM bodies b LEFT JOIN found f ON b.doc_id = f.doc_id GROUP BY b.doc_id, body), "
        "based AS (SELECT *, greatest(0, trunc(100 - sqrt(raw * 1000.0 / greatest(n, 1)) * 10))::INT AS base FROM sums), "
        "scored AS (SELECT *, CASE WHEN raw <= 5 THEN greatest(85, base) ELSE base END AS score, own OR doc_id IN (SELECT doc_id FROM crossed) AS red FROM based) "
        f"SELECT doc_id, '{scene}' AS scene, score::INT AS score, raw::BIGINT AS raw, hit_count::BIGINT AS hit_count, n::BIGINT AS char_count, red::INT AS compliance_hit, "
        f"CASE WHEN red OR score <= {block_at} THEN 'block' WHEN score < {rewrite_at} THEN 'rewrite' WHEN score < {warn_at} THEN 'warn' ELSE 'pass' END AS action FROM scored"
    )


def summary_sql() -> str:
    scored = score_sql("base")
    head = scored[: scored.index(", crossed AS")]
    return (
        f"{head}, counted AS (SELECT doc_id, category, count(*) AS n FROM found GROUP BY 1, 2), joined AS (SELECT doc_id, string_agg(category || ': ' || n || ' 处', '；' ORDER BY category) AS s FROM counted GROUP BY 1) "
        "SELECT b.doc_id, coalesce('命中 ' || s, '未检测到明显 AI 味特征') AS summary FROM bodies b LEFT JOIN joined USING (doc_id)"
    )


def first_list(expression: str, patterns: list[str], prefix: str, ignore_case: bool) -> str:
    flag = "(?i)" if ignore_case else ""
    one = [f"CASE WHEN regexp_matches({expression}, {q(flag + p)}) THEN {q(prefix)} || substr(regexp_extract({expression}, {q(flag + p)}), 1, {PREVIEW}) || '...' END" for p in patterns]
    return f"list_filter([{', '.join(one)}], lambda w: w IS NOT NULL)"


def detector_list(name: str, x: str = "text") -> str:
    if name == "tier1":
        return f"list_transform({words(x, V.TIER1_ZH + V.TIER1_EN)}, lambda w: w || '@' || (len(string_split(string_split({x}, w)[1], chr(10))))::VARCHAR)"
    if name == "symmetry":
        across = f"list_transform(regexp_extract_all({x}, {q('(?i)' + V.CROSS_SENTENCE_EN)}), lambda w: '对称填充(EN-跨句): ' || substr(w, 1, {PREVIEW}) || '...')"
        return f"flatten([{first_list(x, V.SYMMETRY, '对称填充: ', False)}, {first_list(x, V.SYMMETRY_EN, '对称填充(EN): ', True)}, {across}])"
    if name == "mechanical":
        return f"list_transform(list_filter([{', '.join(map(q, V.MECHANICAL))}], lambda p: false OR " + "(" + " OR ".join(f"(p = {q(p)} AND regexp_matches({x}, {q(p)}))" for p in V.MECHANICAL) + ")), lambda p: '机械排序: ' || p)"
    if name == "summary_closer":
        return f"list_transform({words(x, V.CLOSERS)}, lambda w: '总结性结尾: ' || w || '...')"
    if name == "abstract":
        return f"list_transform({words(x, V.ABSTRACT_SUBJECTS)}, lambda w: '抽象主语: ' || w || '...')"
    if name == "idiom":
        return f"list_transform({words(x, V.IDIOMS)}, lambda w: '成语 filler: ' || w)"
    return f"CASE WHEN regexp_matches({x}, {q(V.EM_DASHES)}) THEN ['破折号过度使用（连续 2 个以上）'] ELSE []::VARCHAR[] END"


def detector_sql(name: str) -> str:
    return f"WITH {SEEDED_SQL} SELECT doc_id, len(l)::BIGINT AS n_found, array_to_string(l, '{BAR}') AS found FROM (SELECT doc_id, {detector_list(name)} AS l FROM seeded)"


def severity_sql(names: list[str]) -> str:
    total = " + ".join(f"len({detector_list(n)})" for n in names)
    return f"WITH {SEEDED_SQL} SELECT doc_id, n::BIGINT AS total, CASE WHEN n = 0 THEN '无大碍' WHEN n <= 2 THEN '轻改' ELSE '重写' END AS severity FROM (SELECT doc_id, {total} AS n FROM seeded)"


# --- scoring details ---


def cross_sql(scene: str = "base") -> str:
    parts = []
    for name, other in V.PROFILES.items():
        if name != scene:
            for p in other.get("compliance", []):
                parts.append(f"SELECT DISTINCT doc_id, '{p}' AS pid FROM ({judged_rows(p, 'seeded', 'text')}) SEMI JOIN (SELECT doc_id FROM seeded WHERE regexp_matches(text, {q('|'.join(other['domain']))})) USING (doc_id)")
    return f"WITH {SEEDED_SQL} SELECT s.doc_id, coalesce(string_agg(pid, ',' ORDER BY pid), '') AS red_lines FROM seeded s LEFT JOIN ({' UNION ALL '.join(parts)}) r ON s.doc_id = r.doc_id GROUP BY s.doc_id"


def own_compliance_sql() -> str:
    parts = [f"SELECT DISTINCT doc_id, '{p}' AS pid FROM ({judged_rows(p)})" for p in V.PROFILES["health-content"]["compliance"]]
    return f"{WITH} SELECT b.doc_id, coalesce(string_agg(pid, ',' ORDER BY pid), '') AS red_lines FROM bodies b LEFT JOIN ({' UNION ALL '.join(parts)}) r ON b.doc_id = r.doc_id GROUP BY b.doc_id"


def hit_rows_sql() -> str:
    scored = score_sql("base")
    head = scored[: scored.index(", crossed AS")]
    return f"{head} SELECT category, coalesce(pattern_id, '-') AS pattern_id, count(*) AS n, sum(penalty)::BIGINT AS penalty, count(DISTINCT doc_id) AS docs FROM found GROUP BY 1, 2"


def ordered_hits(scene: str = "base") -> str:
    """UNION ALL of doc_id, part, n, category, pattern_id, t: hits in the order in which a score lists them."""
    each = lambda lst, category, pid: f"doc_id, unnest({lst}) AS t, generate_subscripts({lst}, 1) AS n, '{category}' AS category, {q(pid) if pid else 'NULL'} AS pattern_id FROM bodies"
    placed = lambda rows, pid: f"doc_id, t, row_number() OVER (PARTITION BY doc_id ORDER BY s, e) AS n, 'pattern' AS category, '{pid}' AS pattern_id FROM ({rows})"
    listed = [each(matches("body", patterns, any_case), category, None) for category, _, patterns, any_case in H.LISTED.values()]
    parts = [each(words("body", V.TIER1_ZH), "tier1_zh", None), each(tier1_en_list("body"), "tier1_en", None), *listed[:5], each(words("body", V.IDIOMS), "idiom_fillers", None), *listed[5:]]
    parts.append(each(words("body", [w for w in V.RESIDUAL_WORDS if w not in V.TIER1_ZH]), "lexicon_residual", None))
    parts += [each(sentence_list("body", p), "pattern", p) for p in V.SENTENCES] + [each(matches("body", H.UNDUE_PATTERNS, True), "pattern", H.UNDUE)]
    light = f"string_split(light_hits, '{BAR}')"
    parts += [placed(slang_rows(V.HARD_SLANG), H.SLANG), each(light, "pattern", H.SLANG).replace("FROM bodies", "FROM graded WHERE severity <> 'pass' AND light_hits <> ''")]
    parts += [placed(judged_rows(p), p) for p in H.active(scene) if V.JUDGED[p][0] > 0]
    return " UNION ALL ".join(f"SELECT {no} AS part, {p}" for no, p in enumerate(parts))


def categories_sql() -> str:
    """Last matched text of each category among the first twenty hits of a document."""
    scored = score_sql("base")
    head = scored[: scored.index(", found AS")]
    spared = [f"NOT (coalesce(pattern_id, category) = {q(key)} AND regexp_matches(t, {q('|'.join(listed))}))" for key, listed in V.PROFILES["base"].get("exempt", {}).items()]
    return (
        f"{head}, numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY part, n) AS no FROM ({ordered_hits()}) WHERE {' AND '.join(spared or ['true'])}), "
        "lasting AS (SELECT doc_id, category, arg_max(t, no) AS t FROM numbered WHERE no <= 20 GROUP BY 1, 2), "
        "joined AS (SELECT doc_id, string_agg(category || '=' || t, '|' ORDER BY category) AS c FROM lasting GROUP BY 1) "
        "SELECT b.doc_id, coalesce(c, '') AS categories FROM bodies b LEFT JOIN joined USING (doc_id)"
    )


def detector_transport_sql() -> str:
    from tonewright.operators.model import MOCK_WORD

    return f"WITH {SEEDED_SQL} SELECT doc_id, contains(text, '{MOCK_WORD}')::BIGINT AS found, CASE WHEN contains(text, '{MOCK_WORD}') THEN 'p08:{MOCK_WORD}:0.9' ELSE '' END AS listed FROM seeded"


# --- density ---


def density_terms(x: str) -> tuple[str, str]:
    tier3 = " + ".join(f"len(regexp_extract_all({x}, {q(p)}))" for p in V.ABSTRACT_SUBJECTS + V.ABSTRACT_SUBJECTS_EN + V.CLOSERS + V.CLOSERS_EN)
    return f"len({words(x, V.IDIOMS)})::BIGINT", f"({tier3})::BIGINT"


def density_sql() -> str:
    a, b = density_terms("text")
    return f"WITH {SEEDED_SQL} SELECT doc_id, tier2, tier3, (tier2 >= 3 OR tier3 >= 1)::INT AS should_rewrite FROM (SELECT doc_id, {a} AS tier2, {b} AS tier3 FROM seeded)"


def paragraph_density_sql() -> str:
    a, b = density_terms("par")
    return (
        f"WITH {SEEDED_SQL}, pars AS (SELECT doc_id, generate_subscripts(p, 1) - 1 AS idx, unnest(p) AS par FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM seeded)) "
        f"SELECT doc_id, idx, tier2, tier3, (tier2 >= 2 OR tier3 >= 1)::INT AS should_rewrite, preview FROM (SELECT doc_id, idx, {a} AS tier2, {b} AS tier3, "
        f"substr(par, 1, {PREVIEW}) || CASE WHEN length(par) > {PREVIEW} THEN '...' ELSE '' END AS preview FROM pars) WHERE tier2 + tier3 > 0"
    )


# --- professionalism ---


def professional_sql(name: str) -> str:
    x = "text"
    abstract = " + ".join(f"(length({x}) - length(replace({x}, {q(w)}, ''))) // {len(w)}" for w in V.ABSTRACT_WORDS)
    specific = " + ".join(f"len(regexp_extract_all({x}, {q(p)}))" for p in V.SPECIFIC)
    clamp = lambda e: f"greatest(0, least(100, trunc({e})))"
    hollow_words = ", ".join(q(w) for w in V.ABSTRACT_WORDS)
    han = "".join(sorted(set(V.STOP_CHARACTERS)))
    mixed = "regexp_extract_all(regexp_replace(" + x + ", " + q(f"[{han}]") + r", ' ', 'g'), '[\x{4e00}-\x{9fff}]+')"
    return (
        f"WITH {SEEDED_SQL}, c AS (SELECT doc_id, length(regexp_replace({x}, '\\s', '', 'g')) AS chars, {abstract} AS ab, {specific} AS sp, NOT regexp_matches({x}, '\\S') AS blank, "
        f"list_filter(list_transform(string_split_regex({x}, '[。！？!?；;\\n]+'), lambda s: trim(regexp_replace(s, '^\\s+|\\s+$', '', 'g'))), lambda s: length(s) > 0) AS sents, "
        f"list_filter({mixed}, lambda w: length(w) BETWEEN 2 AND 6) AS w FROM seeded), "
        "d AS (SELECT *, greatest(chars / 100.0, 1.0) AS hundred, list_transform(sents, lambda s: length(regexp_replace(s, '\\s', '', 'g'))) AS lens, list_transform(sents, lambda s: length(s) - length(replace(replace(s, '，', ''), ',', ''))) AS commas, "
        f"list_filter(w, lambda v: length(v) >= 4) AS lw, list_filter(w, lambda v: length(v) >= 4 AND v IN ({hollow_words})) AS hw FROM c), "
        "e AS (SELECT *, CASE WHEN len(lens) >= 2 THEN CASE WHEN list_avg(lens) > 0 THEN list_stddev_samp(lens) / list_avg(lens) ELSE 0.0 END END AS cv, list_avg(commas) AS mc, "
        "len(lw)::DOUBLE / nullif(len(w), 0) * (1 - coalesce(len(hw)::DOUBLE / nullif(len(lw), 0), 0)) AS ratio FROM d), "
        f"m AS (SELECT doc_id, CASE WHEN blank THEN 50 ELSE trunc({clamp('100 - (ab / hundred - 2) * 12.5')} * 0.4::DOUBLE + {clamp('(sp / hundred - 0.5) * 22')} * 0.6::DOUBLE) END::INT AS specificity, "
        f"CASE WHEN blank THEN 50 ELSE {clamp('(sp / hundred - 0.5) * 28.5')} END::INT AS detail_density, "
        "CASE WHEN len(lens) < 2 THEN 50 WHEN cv <= 0.08 THEN 30 WHEN cv >= 0.5 THEN 100 ELSE trunc(30 + (cv - 0.08) / (0.5::DOUBLE - 0.08::DOUBLE) * 70) END::INT AS sentence_variance, "
        f"CASE WHEN blank OR len(w) = 0 THEN 50 ELSE {clamp('(ratio - 0.1) * 250')} END::INT AS professional_terms, "
        "CASE WHEN len(sents) = 0 THEN 50 WHEN mc < 0.5 THEN trunc(40 + mc * 40) WHEN mc <= 2 THEN 100 WHEN mc <= 3.5 THEN trunc(100 - (mc - 2) * 26.6) ELSE greatest(0, trunc(60 - (mc - 3.5) * 15)) END::INT AS complexity FROM e) "
        "SELECT doc_id, " + (name if name != "professionalism" else "trunc(round(specificity * 0.25 + detail_density * 0.25 + sentence_variance * 0.15 + professional_terms * 0.2 + complexity * 0.15, 9))::INT AS professionalism") + " FROM m"
    )


# --- character forensics ---

HAN_COUNTS = (
    "han AS (SELECT doc_id, regexp_extract_all(text, '[\\x{4e00}-\\x{9fff}]') AS l FROM seeded), chars AS (SELECT doc_id, len(l) AS total, unnest(l) AS ch, generate_subscripts(l, 1) AS pos FROM han), "
    "counts AS (SELECT doc_id, ch, any_value(total) AS total, count(*) AS n, min(pos) AS first FROM chars GROUP BY 1, 2), "
    "tops AS (SELECT * FROM counts QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) = 1)"
)


def dominant_sql() -> str:
    return f"WITH {SEEDED_SQL}, {HAN_COUNTS} SELECT s.doc_id, coalesce(CASE WHEN n::DOUBLE / total > 0.08 AND n > 20 THEN ch END, '') AS ch FROM seeded s LEFT JOIN tops t ON s.doc_id = t.doc_id"


def watermark_sql(clean: bool) -> str:
    wide, narrow = "".join(chr(c + 0xFEE0) for c in (*range(65, 91), *range(97, 123), *range(48, 58))), "".join(map(chr, (*range(65, 91), *range(97, 123), *range(48, 58))))
    notes = (
        ["CASE WHEN bom THEN '检测到 BOM (U+FEFF)，已移除' END", "CASE WHEN zw > 0 THEN '移除 ' || zw || ' 个零宽字符' END", "CASE WHEN fw > 0 THEN '替换 ' || fw || ' 处同形字/全角字符' END"]
        if clean
        else ["CASE WHEN zw > 0 THEN '检测到 ' || zw || ' 个零宽字符' END", "CASE WHEN bom THEN '检测到 BOM (U+FEFF)' END", "CASE WHEN fw > 0 THEN '检测到 ' || fw || ' 个全角 ASCII 字符' END", "CASE WHEN cc > 0 THEN '检测到 ' || cc || ' 个 CJK 兼容字符' END"]
    )
    out = f"translate(regexp_replace(text, '[\\x{{200b}}\\x{{200c}}\\x{{200d}}\\x{{feff}}]', '', 'g'), '{wide}', '{narrow}')" if clean else "text"
    return (
        f"WITH {SEEDED_SQL}, {HAN_COUNTS}, n AS (SELECT s.doc_id, text, len(regexp_extract_all(text, '[\\x{{200b}}\\x{{200c}}\\x{{200d}}\\x{{feff}}]')) AS zw, len(regexp_extract_all(text, '[Ａ-Ｚａ-ｚ０-９]')) AS fw, "
        "len(regexp_extract_all(text, '[\\x{f900}-\\x{faff}]')) AS cc, regexp_matches(text, '\\x{feff}') AS bom, coalesce(n::DOUBLE / total > 0.08 AND n > 20, false) AS sus, ch FROM seeded s LEFT JOIN tops t ON s.doc_id = t.doc_id) "
        f"SELECT doc_id, zw::BIGINT AS zero_width_removed, {'fw' if clean else '0'}::BIGINT AS homoglyph_replaced, bom::INT AS bom_detected, sus::INT AS synthid_suspect, CASE WHEN sus THEN ch ELSE '' END AS dominant_char, "
        f"array_to_string(list_filter([{', '.join(notes)}], lambda w: w IS NOT NULL), '|') AS warnings, md5({out}) AS cleaned_md5 FROM n"
    )


# --- scenes ---

FEATURES = ["chars", "emoji", "emoji_ratio", "first_person", "colloquial", "avg_sent_len", "has_code_fence", "inline_code", "tags", "url_or_path", "versions", "list_items", "latin_ratio"]


def features_cte() -> str:
    count = lambda p: f"len(regexp_extract_all(text, {q(p)}))::DOUBLE"
    return (
        f"WITH {SEEDED_SQL}, sized AS (SELECT *, greatest(length(regexp_replace(text, '\\s', '', 'g')), 1)::DOUBLE AS n, list_filter(string_split_regex(text, '[。！？!?\\n]+'), lambda s: regexp_matches(s, '\\S')) AS parts FROM seeded), "
        f"f AS (SELECT doc_id, text, n AS chars, {count(V.EMOJI)} AS emoji, {count(V.EMOJI)} / n * 1000 AS emoji_ratio, (length(text) - length(replace(text, '我', ''))) / n * 1000 AS first_person, "
        f"{count('[' + V.PARTICLES + ']')} / n * 1000 AS colloquial, coalesce(list_avg(list_transform(parts, lambda s: length(s))), 0.0) AS avg_sent_len, contains(text, '```')::INT::DOUBLE AS has_code_fence, "
        + ", ".join(f"{count(p)} AS {a}" for a, p in (("inline_code", "`[^`\\n]{1,40}`"), ("tags", "#[^\\s#]{1,20}"), ("url_or_path", "(?:https?://|/[\\pL\\pN_.-]+/)"), ("list_items", "(?m)^\\s*(?:[-*+]|\\d+[.)])\\s+")))
        # RE2's word boundary takes Chinese for one: neighbours are spelt out, separators doubled so that each serves twice.
        + ", len(regexp_extract_all(regexp_replace(text, '([^\\pL\\pN_.])', '\\1\\1', 'g'), '(?:^|[^\\pL\\pN_])v?\\d+\\.\\d+(?:\\.\\d+)?(?:$|[^\\pL\\pN_])'))::DOUBLE AS versions"
        + f", {count('[A-Za-z]{2,}')} / n * 1000 AS latin_ratio FROM sized)"
    )


def features_sql() -> str:
    return f"{features_cte()} SELECT doc_id, {', '.join(f'round({c}, 6) AS {c}' for c in FEATURES)} FROM f"


def scene_sql(columns: list[str], path: bool = False) -> str:
    has = lambda listed: f"regexp_matches(text, {q('|'.join(listed))})"
    weigh = lambda pairs: " + ".join(f"CASE WHEN {c} THEN {w}::DOUBLE ELSE 0 END" for w, c in pairs)
    social = [(2.0, "emoji >= 3"), (1.0, "emoji_ratio >= 8"), (1.5, "tags >= 2"), (2.0, "first_person >= 10"), (1.0, has(V.ACTIONS)), (1.0, "colloquial >= 6"), (1.0, "avg_sent_len > 0 AND avg_sent_len <= 20"), (0.5, "has_code_fence = 0")]
    health = [(1.5, f"regexp_matches(text, {q(V.ADVICE)})"), (0.8, has(V.SYMPTOMS)), (0.7, has(V.MEDICAL_ACTS)), (0.8, has(V.DISCLAIMERS)), (0.3, has(V.PETS)), (1.2, "first_person < 8")]
    tech = [(2.5, "has_code_fence >= 1"), (1.0, "inline_code >= 2"), (1.0, "url_or_path >= 2"), (0.5, "versions >= 1"), (1.0, has(V.METRICS)), (1.0, "latin_ratio >= 120"), (0.5, "list_items >= 3")]
    if path:
        social.append((0.35, "doc_id % 3 = 0"))
        tech.append((0.35, "doc_id % 3 = 1"))
    made = {"confidence": "round(confidence, 6)", "guessed_scene": "coalesce(guess, '-')", "needs_confirmation": "ask::INT", "score_social-note": "round(a, 6)", "score_health-content": "round(b, 6)", "score_tech-doc": "round(c, 6)"}
    return (
        f"{features_cte()}, s AS (SELECT doc_id, regexp_matches(text, '\\S') AS some, {weigh(social)} AS a, {weigh(health)} AS b, {weigh(tech)} AS c FROM f), "
        "r AS (SELECT *, CASE WHEN a >= b AND a >= c THEN 'social-note' WHEN b >= c THEN 'health-content' ELSE 'tech-doc' END AS name, greatest(a, b, c) AS top, a + b + c - greatest(a, b, c) - least(a, b, c) AS second FROM s), "
        "k AS (SELECT *, least(top / CASE WHEN name = 'social-note' THEN 6.0 ELSE 5.0 END, 0.97::DOUBLE) AS conf, (top - second) / (top + 1.0) AS lead FROM r), "
        "o AS (SELECT doc_id, a, b, c, CASE WHEN top < 2 THEN 'base' WHEN conf >= 0.6 AND lead >= 0.15 THEN name ELSE 'base' END AS scene, CASE WHEN top < 2 THEN 0.0 ELSE conf END AS confidence, "
        "CASE WHEN top >= 2 THEN name END AS guess, CASE WHEN top < 2 THEN true ELSE NOT (conf >= 0.6 AND lead >= 0.15) END AS ask FROM k) "
        f"SELECT doc_id, {', '.join(made.get(x, x) + ' AS ' + x.replace('-', '_') for x in columns)} FROM o"
    )


NAMES = ["", "base", "Default", " xiaohongshu ", "coder_pr", "Social Note", "pet health", "TECH_DOC", "unknown", "ops-log", "health_content", "tech-doc", "note"]


def alias_values() -> str:
    rows = [(s, s) for s in V.PROFILES] + [(a, s) for s, p in V.PROFILES.items() for a in p["aliases"]]
    return ", ".join(f"({q(a)}, {q(s)})" for a, s in rows)


def name_of_row() -> str:
    """The scene name that the queries on names ask for in a document."""
    return f"[{', '.join(map(q, NAMES))}][1 + doc_id % {len(NAMES)}]"


def by_name(sql: str) -> str:
    return f"WITH {SEEDED_SQL} SELECT doc_id, r.* FROM (SELECT doc_id, {name_of_row()} AS asked FROM seeded) JOIN ({sql}) r ON r.name = asked"


def with_scene_counts(sql: str) -> str:
    """A table of scenes with the number of documents that ask for each."""
    return f"SELECT t.*, docs FROM ({sql}) t JOIN (SELECT scene, count(*) AS docs FROM ({chosen_sql()}) GROUP BY 1) n ON n.scene = t.scene"


def with_word_counts(listed: list[str]) -> str:
    return f"WITH {SEEDED_SQL} SELECT w AS word, count(*) AS docs FROM (SELECT unnest({words('text', listed)}) AS w FROM seeded) GROUP BY 1"


def resolve_cte() -> str:
    return (
        f"WITH names(name) AS (VALUES {', '.join(f'({q(n)})' for n in NAMES)}), alias(a, scene) AS (VALUES {alias_values()}), keyed AS (SELECT name, replace(trim(lower(name)), ' ', '-') AS k FROM names), "
        "found AS (SELECT name, coalesce(x.scene, y.scene) AS scene FROM keyed LEFT JOIN alias x ON x.a = k LEFT JOIN alias y ON y.a = replace(k, '_', '-'))"
    )


def resolve_sql() -> str:
    return f"{resolve_cte()} SELECT name, coalesce(scene, 'base') AS profile, (scene IS NULL)::INT AS fell_back FROM found"


def canonical_sql() -> str:
    return f"{resolve_cte()} SELECT name, coalesce(scene, '?') AS canonical FROM found"


def active_sql() -> str:
    every = ", ".join(f"({q(p)})" for p in V.BASE_JUDGED)
    extra = ", ".join(f"({q(s)}, {q(p)})" for s, prof in V.PROFILES.items() for p in prof.get("extra", []))
    scenes = ", ".join(f"({q(s)})" for s in V.PROFILES)
    return f"SELECT scene, pattern_id FROM (VALUES {scenes}) s(scene) CROSS JOIN (VALUES {every}) p(pattern_id) UNION ALL SELECT * FROM (VALUES {extra}) e(scene, pattern_id)"


def profiles_sql() -> str:
    rows = ", ".join(f"({q(s)}, {q(p['label'])}, {p['policy'][0]}, {p['policy'][1]}, {p['policy'][2]})" for s, p in V.PROFILES.items())
    return f"SELECT * FROM (VALUES {rows}) t(scene, label, warn_at, rewrite_at, block_at)"


# --- phrases, punctuation, paragraphs ---


def chain(expression: str, steps: list[tuple[str, str]]) -> str:
    for pattern, by in steps:
        expression = f"regexp_replace({expression}, {q(pattern)}, {q(by)}, 'g')"
    return expression


def replacements_sql() -> str:
    return f"WITH {SEEDED_SQL} SELECT doc_id, md5({chain('text', V.PHRASES)}) AS md5 FROM seeded"


TIDY_STEPS = [("[,，]{2,}", "，"), (r"[ \t]{2,}", " "), ("(全方位|多维度|深度|全面)的", r"\1"), (r"\s+([，。！？；：）】」])", r"\1"), (r"^\s+", ""), (r"\s+$", "")]


def tidy_sql() -> str:
    return f"WITH {SEEDED_SQL} SELECT doc_id, md5({chain('text', TIDY_STEPS)}) AS md5 FROM seeded"


def phrases_sql() -> str:
    """What lies between protected parts replaced, then the whole tidied, if anything changed."""
    from tonewright.operators.phrases import PROTECTED

    changed = f"array_to_string(list_transform(range(1, len(g) + 1), lambda i: {chain('g[i]', V.PHRASES)} || coalesce(kept[i], '')), '')"
    return (
        f"WITH {SEEDED_SQL}, parted AS (SELECT doc_id, text, string_split_regex(text, {q(PROTECTED)}) AS g, regexp_extract_all(text, {q(PROTECTED)}) AS kept FROM seeded), "
        f"woven AS (SELECT doc_id, text AS given, {changed} AS text FROM parted), tidied AS (SELECT doc_id, CASE WHEN text = given THEN text ELSE {chain('text', TIDY_STEPS)} END AS o FROM woven) "
        "SELECT doc_id, length(o) AS n, md5(o) AS md5 FROM tidied"
    )


HAN_CLASS = r"\x{4e00}-\x{9fff}"
#: Chinese neighbours but the ellipsis, which the steps below look at apart.
NEAR_CLASS = rf"{HAN_CLASS}\x{{3000}}-\x{{303f}}\x{{ff00}}-\x{{ffef}}"


def ellipsis_sql() -> str:
    """Runs of dots, and of ellipses, beside Chinese; what has been replaced is one character of its own until the end."""
    dots = [(rf"([{NEAR_CLASS}…])\.{{3,}}", r"\1……"), (rf"\.{{3,}}([{NEAR_CLASS}…])", r"……\1")]
    # A run of ellipses is a neighbour to its own last one.
    runs = [(rf"([{NEAR_CLASS}])…+", "\\1\ue0ff"), (rf"…+([{NEAR_CLASS}])", "\ue0ff\\1"), ("…{2,}", "………"), ("\ue0ff", "……")]
    return chain("text", dots + runs)


def parens_sql() -> str:
    """Innermost pairs with Chinese in them or beside them, twice; within a pass, replaced ones are not Chinese to others."""
    inner = "[^()\\n\ue0f1\ue0f2]*"
    once = [(rf"\(({inner}[{HAN_CLASS}]{inner})\)", "\ue0f1\\1\ue0f2"), (rf"([{NEAR_CLASS}…])\(({inner})\)", "\\1\ue0f1\\2\ue0f2"), (rf"\(({inner})\)([{NEAR_CLASS}…])", "\ue0f1\\1\ue0f2\\2"), ("\ue0f1", "（"), ("\ue0f2", "）")]
    return chain("text", once * 2)


def widen_sql() -> str:
    """Character by character, with both neighbours."""
    near = f"[{NEAR_CLASS}…]"
    beside = lambda cls: f"(regexp_matches(coalesce(c[i - 1], ''), {q(cls)}) OR regexp_matches(coalesce(c[i + 1], ''), {q(cls)}))"
    alone = f"NOT {beside('[A-Za-z0-9]')}"
    made = f"CASE WHEN contains(',;:!?', c[i]) AND {beside(near)} THEN translate(c[i], ',;:!?', '，；：！？') WHEN c[i] = '.' AND {alone} AND {beside(near)} THEN '。' ELSE c[i] END"
    return f"array_to_string(list_transform(range(1, len(c) + 1), lambda i: {made}), '')"


def blanks_sql() -> str:
    between = (rf"([{HAN_CLASS}])[ \t]+([{HAN_CLASS}])", r"\1\2")
    # Twice, as a character that ends one match can't begin the next.
    return chain("text", [between, between, (r"[ \t]+([，。！？；：、）】」』…])", r"\1"), (r"([（【「『])[ \t]+", r"\1")])


#: Characters of a text, and its runs of one mark with what stands between them.
CHARACTERS = "string_split(text, '') AS c"
MIXED_MARKS = [("!", "!！"), ("?", "?？"), (".", "."), (",", ",，"), (";", ";；"), (":", ":：")]


def mixed_sql(half: str, run: str) -> str:
    """One mark's runs of two or more, next to Chinese and not to letters or digits, made one half-width mark."""
    side = lambda cls: f"(regexp_matches(right(coalesce(m[i - 1], ''), 1), {q(cls)}) OR regexp_matches(left(coalesce(m[i + 1], ''), 1), {q(cls)}))"
    whole = f"regexp_matches(m[i], {q(f'^[{run}]{{2,}}$')}) AND NOT {side('[A-Za-z0-9]')} AND {side(f'[{NEAR_CLASS}…]')}"
    return f"array_to_string(list_transform(range(1, len(m) + 1), lambda i: CASE WHEN {whole} THEN {q(half)} ELSE m[i] END), '')"


def punctuation_steps(names: list[str], source: str) -> tuple[str, str]:
    """CTEs that apply steps to doc_id, text of a source (other columns stay), and the name of the last."""
    mixed = [(mixed_sql(half, run), f"regexp_extract_all(text, {q(f'(?s)[{run}]+|[^{run}]+')}) AS m") for half, run in MIXED_MARKS]
    of = {
        "pn03_ellipsis": [(ellipsis_sql(), "0 AS x")], "pn04_precollapse": mixed, "pn05_parens": [(parens_sql(), "0 AS x")], "pn06_widen": [(widen_sql(), CHARACTERS)],
        "pn07_collapse": [(chain("text", [(m + "{2,}", m) for m in "，；：！？。"] + [("……+", "……")]), "0 AS x")], "pn08_spaces": [(blanks_sql(), "0 AS x")],
    }
    made, last = [], source
    for expression, helper in (step for name in names for step in of[name]):
        made.append(f"step{len(made)} AS (SELECT * EXCLUDE ({helper.split()[-1]}) REPLACE ({expression} AS text) FROM (SELECT *, {helper} FROM {last}))")
        last = f"step{len(made) - 1}"
    return ", ".join(made), last


def step_sql(name: str) -> str:
    made, last = punctuation_steps([name], "seeded")
    return f"WITH {SEEDED_SQL}, {made} SELECT doc_id, md5(text) AS md5 FROM {last}"


def normalized_cte(source: str = "seeded") -> str:
    """CTEs up to `normal` (doc_id, text): protected parts out, all steps, and the parts back."""
    from tonewright.operators.punctuation import HELD_BACK, HOLE

    held = q("(?:" + HELD_BACK.removeprefix("(?U)") + ")")
    made, last = punctuation_steps(["pn03_ellipsis", "pn04_precollapse", "pn05_parens", "pn06_widen", "pn07_collapse", "pn08_spaces"], "holed")
    back = f"array_to_string(list_transform(range(1, len(g) + 1), lambda i: g[i] || coalesce(kept[i], '')), '')"
    return (
        f"holed AS (SELECT doc_id, regexp_extract_all(text, {held}) AS kept, regexp_replace(text, {held}, {q(HOLE)}, 'g') AS text FROM {source}), {made}, "
        f"normal AS (SELECT doc_id, {back} AS text FROM (SELECT doc_id, kept, string_split(text, {q(HOLE)}) AS g FROM {last}))"
    )


def normalized_sql() -> str:
    return f"WITH {SEEDED_SQL}, {normalized_cte()} SELECT doc_id, length(text) AS n, md5(text) AS md5 FROM normal"


def tokens_list(x: str) -> str:
    """Protected tokens by kind, each once, in order of their first place."""
    from tonewright.operators.punctuation import PARTS, TOKENS

    # Word edges are those of ASCII in DuckDB: letters beyond it become one of its own, where numbers are looked for.
    plain = f"regexp_replace({x}, '[À-ÖØ-öø-ɏͰ-῿\\p{{Han}}]', 'x', 'g')"
    kinds = [(x, "(?s:```.*?```)"), *((x, k) for k in PARTS[1:]), *((plain, k) for k in TOKENS)]
    every = "flatten([" + ", ".join(f"regexp_extract_all({text}, {q(k)})" for text, k in kinds) + "])"
    return f"list_filter({every}, lambda t, i: list_position({every}, t) = i)"


def protected_tokens_sql() -> str:
    return f"WITH {SEEDED_SQL} SELECT doc_id, array_to_string({tokens_list('text')}, '|') AS tokens FROM seeded"


def tokens_preserved_sql() -> str:
    return f"WITH {SEEDED_SQL} SELECT doc_id, (len(list_filter({tokens_list('text')}, lambda t: NOT contains(replace(text, 'v1.', 'v 1.'), t))) = 0)::INT AS kept FROM seeded"


PUNCTUATION_SQL = {name: step_sql(name) for name in ("pn03_ellipsis", "pn04_precollapse", "pn05_parens", "pn06_widen", "pn07_collapse", "pn08_spaces")}


def normal_form_sql() -> str:
    return f"WITH {SEEDED_SQL} SELECT doc_id, md5({chain('lower(text)', [('[#*`>-]', ''), (chr(92) + 's', ''), ('[、，,/|·:：;；()（）\\[\\]【】.\"' + chr(39) + ']', '')])}) AS md5 FROM seeded"


def paragraphs_sql() -> str:
    return f"WITH {SEEDED_SQL} SELECT doc_id, CASE WHEN contains(text, chr(10) || chr(10)) THEN len(string_split_regex(text, '\\n\\s*\\n')) ELSE len(string_split(text, chr(10))) END::BIGINT AS n FROM seeded"


def notes_sql() -> str:
    from tonewright.operators.paragraphs import WORK_PHRASES

    line = "regexp_replace(x, '^\\s+|\\s+$', '', 'g')"
    han, letters = f"len(regexp_extract_all({line}, '[\\x{{4e00}}-\\x{{9fff}}]'))", f"len(regexp_extract_all({line}, '[A-Za-z]'))"
    note = f"(regexp_matches({line}, {q('(?i)' + WORK_PHRASES)}) OR ({han} = 0 AND len(regexp_extract_all({line}, '[A-Za-z]+')) >= 6))"
    keep = f"length({line}) = 0 OR (NOT contains(x, '✓') AND NOT contains(x, '✗') AND NOT ({letters} > {han} AND {note}))"
    return f"WITH {SEEDED_SQL} SELECT doc_id, md5(array_to_string(list_filter(string_split(regexp_replace(text, '(?is)<think>.*?</think>', '', 'g'), chr(10)), lambda x: {keep}), chr(10))) AS md5 FROM seeded"


def exact_copies_sql() -> str:
    form = chain("lower(coalesce(text, ''))", [("[#*`>-]", ""), ("\\s", ""), ("[、，,/|·:：;；()（）\\[\\]【】.\"'" + "]", "")])
    return f"SELECT doc_id, min(doc_id) OVER (PARTITION BY form) AS first_id, count(*) OVER (PARTITION BY form) AS copies FROM (SELECT doc_id, {form} AS form FROM documents)"


# --- rule rewriting, gates ---


def deleted_sql(pattern_id: str) -> str:
    from tonewright.functions import rewrite_values as R

    flags = "(?is)" if pattern_id == "p22" else "(?i)"
    pattern = flags + "|".join(sorted(R.DELETED[pattern_id], key=len, reverse=True))
    return f"WITH {SEEDED_SQL} SELECT doc_id, length(o) AS n, md5(o) AS md5 FROM (SELECT doc_id, regexp_replace(text, {q(pattern)}, '', 'g') AS o FROM seeded)"


def tier1_deleted_sql() -> str:
    expression = "text"
    for w in V.TIER1_ZH:
        expression = f"replace({expression}, {q(w)}, '')"
    return f"WITH {SEEDED_SQL} SELECT doc_id, length(o) AS n, md5(o) AS md5 FROM (SELECT doc_id, {expression} AS o FROM seeded)"


def gate_sql() -> str:
    return (
        f"SELECT doc_id, CASE WHEN compliance_hit = 1 OR action = 'block' THEN 2 WHEN action = 'warn' THEN 1 ELSE 0 END AS gated, compliance_hit * 2 AS ungated FROM ({score_sql('base')})"
    )


def eligible_sql() -> str:
    stripped = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"
    return (
        f"WITH {LONG_SQL}, t AS (SELECT doc_id, {stripped} AS t FROM long) SELECT doc_id, (length(t) >= 200 AND NOT contains(t, 'MEDIA:') AND NOT contains(t, '[[as_document]]') AND NOT contains(t, '[[audio_as_voice]]') "
        "AND NOT regexp_matches(t, '(?i)!\\[[^\\]]*\\]\\([^)]*\\)|<img\\s') AND len(regexp_extract_all(t, '[\\x{4e00}-\\x{9fff}]')) >= greatest(20, trunc(length(t) * 0.3)))::INT AS eligible FROM t"
    )


def structured_sql() -> str:
    url = r"(?:https?://|www\.)[^\s\x{4e00}-\x{9fff}\x{ff0c}\x{3002}\x{ff01}\x{ff1f}\x{ff1b}\x{ff1a}\x{3001}\x{ff08}\x{ff09}\x{3010}\x{3011}\x{300c}\x{300d}\x{300e}\x{300f}]+"
    return f"WITH {SEEDED_SQL} SELECT doc_id, regexp_matches(text, {q('(?s)```.*?```|`[^`' + chr(10) + ']+`|' + url + '|[A-Za-z0-9_.+-]+@[A-Za-z0-9-]+[.][A-Za-z0-9.-]+')})::INT AS structured FROM seeded"


def thinking_sql() -> str:
    return f"WITH {SEEDED_SQL} SELECT doc_id, md5(trim(regexp_replace(text, '(?s)<think>.*?</think>\\s*', '', 'g'))) AS md5 FROM seeded"


def report_sql() -> str:
    return f"SELECT doc_id, '{{\"score\":' || score || ',\"action\":\"' || action || '\"}}' AS report FROM ({score_sql('base')})"


def acceptance_sql() -> str:
    scored = score_sql("social-note").replace(SEEDED_SQL, ACCEPTANCE_SQL)
    kind = "CASE WHEN doc_id <= -100 THEN 'plain' WHEN doc_id < 0 THEN 'adversarial' ELSE 'corpus' END"
    return f"SELECT {kind} AS kind, count(*) AS n, count(*) FILTER (WHERE raw > 0 OR compliance_hit = 1) AS dirty, min(score) AS least, max(score) AS most FROM ({scored}) GROUP BY 1"


# --- implicit relational operators ---


def domain_sql() -> str:
    rows = ", ".join(f"({q(s)}, {q(w)})" for s, p in V.PROFILES.items() for w in p.get("domain", []))
    return f"WITH {SEEDED_SQL} SELECT profile, word, count(*) AS docs FROM seeded JOIN (VALUES {rows}) d(profile, word) ON contains(text, word) GROUP BY 1, 2"


def having_sql() -> str:
    scored = score_sql("base")
    return f"{scored[: scored.index(', crossed AS')]} SELECT doc_id, category, count(*) AS n FROM found GROUP BY 1, 2 HAVING count(*) >= 2"


def covered_sql() -> str:
    return f"{WITH}{MASKED_SQL} SELECT doc_id, t AS word, count(*) AS n FROM ({slang_rows(V.HARD_SLANG)}) GROUP BY 1, 2"


def outermost_sql() -> str:
    """Spans of all slang words that no other span covers: the furthest end of those before, by start and then longest first."""
    uncovered = slang_rows(V.HARD_SLANG + V.LIGHT_COLLOQUIAL, covered=False)
    return (
        f"{WITH}{MASKED_SQL}, spans AS (SELECT DISTINCT * FROM ({uncovered})), "
        "swept AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s, e DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS furthest FROM spans) "
        "SELECT doc_id, t AS word, count(*) AS n FROM swept WHERE furthest IS NULL OR e > furthest GROUP BY 1, 2"
    )


#: Versions of a document: as it is, with phrases replaced, and then without first-tier words.
def versions_sql() -> str:
    plain = chain("text", V.PHRASES)
    bare = plain
    for w in V.TIER1_ZH:
        bare = f"replace({bare}, {q(w)}, '')"
    made = f"{SEEDED_SQL.replace('seeded AS', 'given AS', 1)}, seeded AS (SELECT doc_id * 10 + v AS doc_id, t AS text FROM (SELECT doc_id, unnest([1, 2, 3]) AS v, unnest([text, {plain}, {bare}]) AS t FROM given))"
    scored = score_sql("base").replace(SEEDED_SQL, made)
    before = "lag(score) OVER (PARTITION BY doc_id // 10 ORDER BY doc_id)"
    return f"SELECT doc_id // 10 AS doc_id, (doc_id % 10)::INT AS version, score, coalesce({before}, -1) AS before, coalesce(score < {before}, false)::INT AS fell FROM ({scored})"


def cube_sql() -> str:
    """Hits by scene and category, each document scored in the scene that is asked for."""
    heads = {s: score_sql(s) for s in V.PROFILES}
    parts = [f"SELECT x.*, {q(s)} AS scene FROM ({h[: h.index(', crossed AS')]} SELECT doc_id, category, penalty FROM found) x JOIN chosen c ON c.doc_id = x.doc_id AND c.scene = {q(s)}" for s, h in heads.items()]
    return (
        f"WITH chosen AS ({chosen_sql()}), rows AS ({' UNION ALL '.join(parts)}) SELECT coalesce(scene, '*') AS scene, coalesce(category, '*') AS category, "
        "count(*) AS hits, sum(penalty)::BIGINT AS penalty, count(DISTINCT doc_id) AS docs FROM rows GROUP BY CUBE (scene, category)"
    )


def distinct_sql() -> str:
    return f"WITH {SEEDED_SQL} SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '[A-Z]{{2,}}'))), '|') AS acronyms FROM seeded"


def preview_sql() -> str:
    return f"WITH {SEEDED_SQL} SELECT doc_id, substr(text, 1, 50) AS preview FROM seeded"


# --- single rewriting patterns and the rest ---


def digest_sql(expression: str) -> str:
    return f"WITH {SEEDED_SQL} SELECT doc_id, length(o) AS n, md5(o) AS md5 FROM (SELECT doc_id, {expression} AS o FROM seeded)"


def rewriting_sql() -> dict[str, str]:
    from tonewright.functions import rewrite_values as R

    longest = lambda listed: "|".join(sorted(listed, key=len, reverse=True))
    plain = "text"
    for a, b in R.PLAIN_ZH.items():
        plain = f"replace({plain}, {q(a)}, {q(b)})"
    plain = chain(plain, [(rf"(?i)\b{a}\b", b) for a, b in R.PLAIN_EN.items()])
    from tonewright.operators.rewrite import LISTED_DELETIONS

    return {
        "rw12_delete_p10": digest_sql(chain("text", [(longest(R.ORDINALS_ZH), ""), (f"(?i)(?:{longest(R.ORDINALS_EN)})[,，]", ","), (f"(?i)(?:{longest(R.ORDINALS_EN)})", "")])),
        "rw16_verbs_p14": digest_sql(chain("text", [(f"{light}({verbs})", r"\1") for light, verbs in R.VERBS.items()])),
        "rw19_plain_p17": digest_sql(plain),
        "rw28_subjects_p26": digest_sql(chain("text", [(rf"(?i)(?:{R.ENGLISH_SUBJECTS})\s+([^。]*?[。！])", r"系统\1")])),
        "rw31_mechanical": digest_sql(chain("text", [(p, "") for p in V.MECHANICAL])),
        "rw35_listed": digest_sql(chain("text", [(p, "") for p in LISTED_DELETIONS])),
        "rw36_leftovers": digest_sql(chain("text", R.LEFTOVERS)),
        "rw39_final": digest_sql(chain("text", [("。{2,}", "。"), (r"\.{2,}", "."), (r"^[，,。！？\s]+", "")])),
    }


def trimmed(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def each_replaced_sql(steps: list[tuple[str, str]]) -> str:
    """Digest of the texts after steps of a pattern and what a match m becomes."""
    ctes = [SPANS_SQL]
    for n, (pattern, change) in enumerate(steps, 1):
        source = "spans" if n == 1 else f"s{n - 1}"
        woven = f"array_to_string(list_transform(list_zip(g, h), lambda z: coalesce(z[1], '') || coalesce(list_transform([z[2]], lambda m: {change})[1], '')), '')"
        ctes.append(f"s{n} AS (SELECT doc_id, {woven} AS text FROM (SELECT doc_id, string_split_regex(text, {q(pattern)}) AS g, regexp_extract_all(text, {q(pattern)}) AS h FROM {source}))")
    return f"WITH {', '.join(ctes)} SELECT doc_id, length(text) AS n, md5(text) AS md5 FROM s{len(steps)}"


def span_sql() -> dict[str, str]:
    """Patterns of which a part stays, and the layout. RE2 has no look-around, so p01 in English, left-overs and sentence joining have tests only."""
    from tonewright.functions import rewrite_values as R
    from tonewright.operators import rewrite as W

    group = lambda p, n: trimmed(f"regexp_extract(m, {q(p)}, {n})")
    any_case = lambda p: f"(?i){p}"
    pair = lambda a, b, between: f"array_to_string(list_filter([{a}, {b}], lambda p: p <> ''), '{between}')"
    bare = lambda x: trimmed(rf"regexp_replace({x}, '^[，,。.\s]+', '')")
    clause = "string_split(m, '，')[-1]"
    for word in R.CONNECTORS:
        clause = trimmed(f"replace({clause}, '{word}', '')")
    hands = r"string_split_regex(m, '(?i)on\s+the\s+other\s+hand')"
    first = rf"regexp_replace({trimmed(hands + '[1]')}, '(?i)^on\s+one\s+hand\s*[,.]?\s*', '')"
    rest = r"regexp_extract(m, '(?is)^.*?on\s+the\s+other\s+hand(.*)$', 1)"
    filler = (
        f"CASE WHEN contains(lower(m), 'on the other hand') THEN {pair(bare(first), bare(rest), ' ')} "
        rf"WHEN regexp_matches(m, '(?i)but\s+also') THEN {bare(r"regexp_replace(m, '(?is)^.*?but\s+also', '')")} "
        rf"WHEN regexp_matches(m, '(?i)\band\b') THEN {bare(r"regexp_replace(m, '(?is)^.*?\band\b', '')")} ELSE '' END"
    )
    both = any_case(W.COORDINATION_EN)
    line, gap = r"[ \t]*\n[ \t]*", r"[ \t]*\n[ \t]*\n+[ \t]*"
    parts = f"list_transform(string_split_regex(text, {q(gap)}), lambda p: {trimmed(f'regexp_replace(p, {q(line)}, chr(10), {q("g")})')})"
    laid = trimmed(f"array_to_string({parts}, chr(10) || chr(10))")
    from tonewright.operators.phrases import PROTECTED

    return {
        "rw02_layout": f"WITH {SPANS_SQL} SELECT doc_id, length(o) AS n, md5(o) AS md5 FROM (SELECT doc_id, {laid} AS o FROM spans)",
        "rw03_reversals_zh": each_replaced_sql([(any_case(W.REVERSAL_ZH), trimmed("'是' || regexp_replace(m, '(?s)^.*?而是', '')"))]),
        "rw09_imbalances": each_replaced_sql([(any_case(p), group(any_case(p), 1)) for p in (W.IMBALANCE_ZH, W.IMBALANCE_EN)]),
        "rw22_coordinations_zh": each_replaced_sql([(W.COORDINATION_ZH, r"trim(regexp_replace(regexp_replace(m, '^(?:既|不仅|不但)', ''), '(?s)^(.*?)(?:也|而且|又)', '\1'), '，, ')")]),
        "rw22_coordinations_en": each_replaced_sql([(both, f"CASE WHEN starts_with(lower(m), 'not only') THEN {pair(group(both, 2), group(both, 3), ' and ')} ELSE {group(both, 4)} END")]),
        "rw32_symmetry_zh": each_replaced_sql([(any_case(p), f"CASE WHEN contains(m, '，') THEN {trimmed(f"trim({clause}, '，。')")} ELSE '' END") for p in V.SYMMETRY]),
        "rw33_symmetry_en": each_replaced_sql([(any_case(p), filler) for p in V.SYMMETRY_EN]),
        "rw34_cross_sentence": each_replaced_sql([(any_case(p), trimmed(f"string_split(m, '{w}')[-1]")) for w, p in W.CROSS_SENTENCE.items()]),
        "ph01_protected_parts": (
            f"WITH {SPANS_SQL}, parted AS (SELECT doc_id, string_split_regex(text, {q(PROTECTED)}) AS g, regexp_extract_all(text, {q(PROTECTED)}) AS k FROM spans) "
            f"SELECT doc_id, len(k)::BIGINT AS parts, md5(array_to_string(k, '{BAR}')) AS parts_md5, md5(array_to_string(g, '{BAR}')) AS gaps_md5 FROM parted"
        ),
    }


def keyword_sql(listed: list[str]) -> str:
    return f"WITH {SEEDED_SQL} SELECT doc_id, array_to_string({words('text', listed)}, '|') AS found FROM seeded"


def counts_sql() -> str:
    abstract = " + ".join(f"(length(text) - length(replace(text, {q(w)}, ''))) // {len(w)}" for w in V.ABSTRACT_WORDS)
    specific = " + ".join(f"len(regexp_extract_all(text, {q(p)}))" for p in V.SPECIFIC)
    return f"WITH {SEEDED_SQL} SELECT doc_id, ({abstract})::BIGINT AS abstract_words, ({specific})::BIGINT AS specifics FROM seeded"


def accessor_sql() -> str:
    """Penalty, switches and exempt words by scene and rule, from one list of rows a kind."""
    lists = {
        "base": [(k, v) for k, v in ACCESSOR_COSTS.items()],
        "price": [(s, k, v) for s, p in V.PROFILES.items() for k, v in p.get("penalties", {}).items()],
        "off": [(s, c) for s, p in V.PROFILES.items() for c in p.get("off", [])],
        "red": [(s, c) for s, p in V.PROFILES.items() for c in p.get("compliance", [])],
        "spare": [(s, k, "|".join(w)) for s, p in V.PROFILES.items() for k, w in p.get("exempt", {}).items()],
    }
    value = lambda v: str(v) if isinstance(v, int) else q(v)
    rows = {name: ", ".join("(" + ", ".join(map(value, row)) + ")" for row in own) for name, own in lists.items()}
    return (
        f"SELECT s AS scene, k AS key, coalesce(pv, v) AS penalty, (oc IS NOT NULL)::INT AS off, (rc IS NOT NULL)::INT AS compliance, coalesce(xw, '') AS exempt "
        f"FROM (VALUES {', '.join(f'({q(s)})' for s in V.PROFILES)}) a(s) CROSS JOIN (VALUES {rows['base']}) b(k, v) LEFT JOIN (VALUES {rows['price']}) p(ps, pk, pv) ON ps = s AND pk = k "
        f"LEFT JOIN (VALUES {rows['off']}) o(os, oc) ON os = s AND oc = k LEFT JOIN (VALUES {rows['red']}) r(rs, rc) ON rs = s AND rc = k LEFT JOIN (VALUES {rows['spare']}) x(xs, xk, xw) ON xs = s AND xk = k"
    )


#: What a hit of each rule costs in the base scene.
ACCESSOR_COSTS = {p: v[0] for p, v in V.JUDGED.items()} | {"p27_over_colloquial": 3, "mechanical_ordering": 3, "symmetry_fillers": 4, "redundant_modifiers": 2, "tier1_zh": 5}
WHITELIST = ["今天天气不错，我们去河边走了走。", "总之就是这样。总之算了！", "\n高效赋能、全面协同、深度转型。\n苹果、梨子、桃子。\n"]


def whitelist_sql() -> str:
    listed = ", ".join(q(w.strip()) for w in WHITELIST)
    return f"WITH {ALONE_SQL} SELECT doc_id FROM alone WHERE regexp_replace(text, '^[\\s\\x{{3000}}\\x{{a0}}]+|[\\s\\x{{3000}}\\x{{a0}}]+$', '', 'g') IN ({listed})"


def asked_sql() -> str:
    """CASE of the scene that the queries on scene choice ask for."""
    return "CASE doc_id % 6 WHEN 0 THEN 'auto' WHEN 1 THEN 'base' WHEN 2 THEN 'XiaoHongShu' WHEN 3 THEN 'no such scene' WHEN 4 THEN 'pet health' END"


def chosen_sql() -> str:
    return f"SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN scene WHEN 2 THEN 'social-note' WHEN 4 THEN 'health-content' ELSE 'base' END AS scene FROM ({scene_sql(['scene'])})"


def profile_for_text_sql() -> str:
    rows = ", ".join(f"({q(s)}, {q(p['label'])}, {p['policy'][0]}, {p['policy'][2]})" for s, p in V.PROFILES.items())
    return f"SELECT doc_id, scene, label, warn_at, block_at FROM ({chosen_sql()}) JOIN (VALUES {rows}) p(s, label, warn_at, block_at) ON s = scene"


def score_by_row_sql() -> str:
    """Each document's score in the scene that is asked for, from the scores of all four scenes."""
    parts = [f"SELECT x.* FROM ({score_sql(s)}) x JOIN chosen c ON c.doc_id = x.doc_id AND c.scene = {q(s)}" for s in V.PROFILES]
    return f"WITH chosen AS ({chosen_sql()}) " + " UNION ALL ".join(parts)


def keys_sql() -> str:
    bare = "regexp_replace(line, '^[\\s\\x{3000}\\x{a0}\\x{85}\\x{1c}-\\x{1f}]+|[\\s\\x{3000}\\x{a0}\\x{85}\\x{1c}-\\x{1f}]+$', '', 'g')"
    side = lambda x: bare.replace("line", x)
    return (
        f"WITH {SEEDED_SQL}, b AS (SELECT doc_id, {bare} AS b FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM seeded)), "
        f"s AS (SELECT doc_id, {side('string_split(b, chr(61))[1]')} AS name, trim(trim({side('substr(b, position(chr(61) IN b) + 1)')}, chr(34)), chr(39)) AS value FROM b WHERE contains(b, '=') AND NOT starts_with(b, '#')) "
        "SELECT doc_id, name, value, (value <> '' AND NOT contains(value, '${') AND NOT starts_with(value, '$'))::INT AS usable FROM s"
    )


def top_scenes_sql() -> str:
    inner = scene_sql(["score_social-note", "score_health-content", "score_tech-doc"])
    return (
        f"SELECT doc_id, name, score, rank FROM (SELECT doc_id, name, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ord)::INT AS rank FROM ("
        f"SELECT doc_id, unnest([score_social_note, score_health_content, score_tech_doc]) AS score, unnest(['social-note', 'health-content', 'tech-doc']) AS name, unnest([0, 1, 2]) AS ord FROM ({inner}))) WHERE rank <= 2"
    )


def gate_density_sql() -> str:
    return f"SELECT doc_id, should_rewrite AS code FROM ({density_sql()})"


def preview_scene_sql() -> str:
    rows = ", ".join(f"({q(s)}, {q(p['label'])}, {p['policy'][0]}, {p['policy'][1]}, {p['policy'][2]}, {q(','.join(p.get('compliance', [])))})" for s, p in V.PROFILES.items())
    return f"SELECT doc_id, x.scene, label, warn_at, rewrite_at, block_at, compliance FROM ({scene_sql(['scene'])}) x JOIN (VALUES {rows}) p(scene, label, warn_at, rewrite_at, block_at, compliance) ON p.scene = x.scene"


def prompt_sql() -> str:
    from tonewright.operators.model import system_prompt

    system = " ".join(f"WHEN {q(name)} THEN {q(system_prompt(name))}" for name in V.PROFILES)
    user = "'---' || chr(10) || text || chr(10) || '---'"
    return f"WITH {SEEDED_SQL} SELECT doc_id, md5(CASE scene {system} END) AS system_md5, md5({user}) AS user_md5 FROM seeded JOIN ({chosen_sql()}) USING (doc_id)"


def item_length_sql() -> str:
    return f"WITH {SEEDED_SQL} SELECT doc_id, max(length(regexp_replace(s, {q(f'^{V.WRAPPERS}+|{V.WRAPPERS}+$')}, '', 'g')))::BIGINT AS longest FROM (SELECT doc_id, unnest(string_split_regex(text, '[、，,]')) AS s FROM seeded) GROUP BY 1"
