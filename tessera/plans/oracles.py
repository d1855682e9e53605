"""DuckDB SQL of the linkage queries."""

from __future__ import annotations

from tessera.functions.normalize import ACRONYM_SKIPS, CITY_NAMES, LEGAL_FORMS, LEGAL_TAIL, LEGAL_TERMS, NEARBY, STREET_WORDS

from .queries import HOT, KEEP, LITERALS, POLICY


def quoted(s: str | None) -> str:
    return "NULL" if s is None else "'" + s.replace("'", "''") + "'"


def chosen(table: dict[str, str], key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {quoted(a)} THEN {quoted(b)}" for a, b in table.items()) + f" ELSE {key} END"


def base(c: str) -> str:
    c = f"lower(coalesce({c}, ''))"
    for a, b in (("ß", "ss"), ("œ", "oe"), ("æ", "ae"), ("&", " and ")):
        c = f"replace({c}, '{a}', '{b}')"
    return rf"trim(regexp_replace(strip_accents({c}), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'))"


def name(b: str) -> str:
    """Of base text."""
    marked = rf"regexp_replace(' ' || {b} || ' ', '(?:^| )({LEGAL_TERMS})(?: |$)', ' ' || chr(1) || '\1' || chr(1) || ' ', 'g')"
    parts = f"list_transform(string_split({marked}, chr(1)), lambda x, i: CASE WHEN i % 2 = 0 THEN {chosen(LEGAL_FORMS, 'x')} ELSE x END)"
    return f"trim(regexp_replace(array_to_string({parts}, ''), ' +', ' ', 'g'))"


def address(b: str) -> str:
    """Of base text. Words are two spaces apart while the words that mean nearness go."""
    near = "|".join(t.replace(" ", " +") for t in NEARBY)
    bare = f"regexp_replace('  ' || replace({b}, ' ', '  ') || '  ', ' (?:{near}) ', '  ', 'g')"
    words = f"list_filter(string_split({bare}, ' '), lambda x: x <> '')"
    return f"array_to_string(list_transform({words}, lambda x: CASE {' '.join(f'WHEN x = {quoted(a)} THEN {quoted(v)}' for a, v in (STREET_WORDS | CITY_NAMES).items())} ELSE x END), ' ')"


def numbers(b: str) -> str:
    return rf"list_filter(string_split({b}, ' '), lambda x: regexp_full_match(x, '\d+[A-Za-z]?'))"


def postal(b: str) -> str:
    return rf"coalesce(list_filter(regexp_extract_all({b}, '\d+'), lambda x: length(x) IN (5, 6))[1], '')"


def words(c: str) -> str:
    return f"list_filter(string_split({c}, ' '), lambda x: x <> '')"


def jaccard(a: str, b: str) -> str:
    return f"CASE WHEN len(list_distinct({words(a)} || {words(b)})) = 0 THEN 1.0 ELSE len(list_intersect({words(a)}, {words(b)}))::DOUBLE / len(list_distinct({words(a)} || {words(b)})) END"


SKIPS = ", ".join(quoted(w) for w in ACRONYM_SKIPS)


def acronym(c: str) -> str:
    kept = f"list_filter(string_split({c}, ' '), lambda x: x <> '' AND x NOT IN ({SKIPS}))"
    return f"CASE WHEN len({kept}) >= 2 THEN array_to_string(list_transform({kept}, lambda x: x[1]), '') ELSE '' END"


ENT = r"""raw AS (SELECT doc_id, lang, string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}_]+', ' ', 'g')), ' ') AS t FROM documents),
ent AS (SELECT 'S' || (doc_id % 3 + 1) || '-' || doc_id AS entity_id, array_to_string(list_slice(t, 1, 8), ' ') AS business_name, array_to_string(list_slice(t, 9, 20), ' ') AS business_address, lang AS country FROM raw),
"""
BASED = ENT + f"""based AS (SELECT *, {base("business_name")} AS bn, {base("business_address")} AS ba FROM ent),
named AS (SELECT *, {name("bn")} AS name, {address("ba")} AS address FROM based),
cored AS (SELECT *, trim(regexp_replace(name, '{LEGAL_TAIL}', '')) AS core, {numbers("address")} AS nums, {postal("address")} AS postal FROM named),
d AS (SELECT entity_id, lower(country) AS country, name, core, array_to_string(list_sort({words("core")}), ' ') AS sorted_core, address, array_to_string(nums, ' ') AS numbers, postal,
    coalesce(list_filter({numbers("ba")}, lambda x: x <> postal)[1], '') AS street_number FROM cored),
"""
SIDES = BASED + """s AS (SELECT * FROM d WHERE entity_id LIKE 'S1-%'), t AS (SELECT * FROM d WHERE entity_id NOT LIKE 'S1-%'),
df AS (SELECT token, count(*) AS frequency FROM (SELECT entity_id, unnest(list_distinct(string_split(core, ' '))) AS token FROM s) WHERE token <> '' GROUP BY token),
"""
TRUTH = """truth AS (SELECT 'S1-' || a.doc_id AS source1_id, 'S' || (b.doc_id % 3 + 1) || '-' || b.doc_id AS target_id
    FROM documents a JOIN documents b ON a.text = b.text WHERE a.doc_id % 3 = 0 AND b.doc_id % 3 <> 0),
"""


def key_rows(t: str) -> str:
    def one(family: str, value: str, weight: float, when: str) -> str:
        return f"SELECT entity_id, '{family}' AS family, {value} AS key, {weight}::DOUBLE AS weight FROM {t} WHERE {when}"

    parts = [
        one("full", "name", 15, "name <> ''"), one("core", "core", 12, "core <> ''"), one("sorted", "sorted_core", 10, "sorted_core <> ''"),
        one("acronym", acronym("core"), 8, f"length({acronym('core')}) >= 2"), one("address", "address", 7, "address <> ''"),
        one("full_composite", "name || '|' || address", 25, "name <> '' AND address <> ''"), one("prefix", "left(core, 5)", 2, "length(core) >= 5"),
        f"SELECT entity_id, 'number', n, CASE WHEN length(n) >= 5 THEN 4.0 ELSE 0.5 END FROM (SELECT entity_id, unnest(list_distinct({words('numbers')})) AS n FROM {t})",
        f"SELECT entity_id, 'token', token, 6.0 FROM (SELECT entity_id, unnest(list_distinct(string_split(core, ' '))) AS token FROM {t}) x WHERE length(token) >= 3 AND NOT EXISTS (SELECT 1 FROM df WHERE df.token = x.token AND frequency > {HOT})",
    ]
    return " UNION ALL ".join(parts)


KEYS = SIDES + f"""ks AS ({key_rows("s")}), kt0 AS ({key_rows("t")}),
kt AS (SELECT * FROM kt0 WHERE EXISTS (SELECT 1 FROM ks WHERE ks.family = kt0.family AND ks.key = kt0.key)),
hs AS (SELECT family, key, count(*) AS n FROM ks GROUP BY ALL HAVING count(*) > {HOT}), ht AS (SELECT family, key, count(*) AS n FROM kt GROUP BY ALL HAVING count(*) > {HOT}),
bs AS (SELECT * FROM ks WHERE NOT EXISTS (SELECT 1 FROM hs WHERE hs.family = ks.family AND hs.key = ks.key)),
bt AS (SELECT * FROM kt WHERE NOT EXISTS (SELECT 1 FROM ht WHERE ht.family = kt.family AND ht.key = kt.key)),
"""


def best(*families: str) -> str:
    return f"max(CASE WHEN bs.family IN ({', '.join(map(quoted, families))}) THEN bs.weight * bt.weight ELSE 0.0 END)"


PAIRS = KEYS + f"""ev AS (SELECT bs.entity_id AS source1_id, bt.entity_id AS target_id, sum(bs.weight * bt.weight) AS evidence, count(*) AS support_count,
    {best("full", "core", "sorted", "acronym", "prefix", "lsh")} AS name_evidence, {best("address", "full_composite", "addr_lsh")} AS address_evidence,
    {best("number", "token", "phonetic")} AS structural_evidence, {best("full_composite", "full", "core", "sorted", "address")} AS exact_evidence
    FROM bs JOIN bt ON bs.family = bt.family AND bs.key = bt.key GROUP BY ALL),
pf AS (SELECT ev.*, s.name AS s_name, s.core AS s_core, s.address AS s_address, s.numbers AS s_numbers, s.country AS s_country, t.name AS t_name, t.core AS t_core, t.address AS t_address, t.numbers AS t_numbers, t.country AS t_country
    FROM ev JOIN s ON s.entity_id = source1_id JOIN t ON t.entity_id = target_id),
"""
SCORED = PAIRS + f"""sc0 AS (SELECT *, round({jaccard("s_core", "t_core")}, 9) AS name_score, round({jaccard("s_address", "t_address")}, 9) AS address_score,
    CASE WHEN max(evidence) OVER w > min(evidence) OVER w THEN (evidence - min(evidence) OVER w) / (max(evidence) OVER w - min(evidence) OVER w) ELSE 1.0 END AS ev_norm FROM pf WINDOW w AS (PARTITION BY source1_id)),
sc AS (SELECT *, round(0.31::DOUBLE * name_score + 0.31::DOUBLE * address_score + 0.08::DOUBLE * ev_norm + 0.05::DOUBLE * (CASE WHEN exact_evidence > 0 THEN 1 ELSE 0 END)
    + 0.05::DOUBLE * greatest(CASE WHEN structural_evidence > 0 THEN 1.0 ELSE 0.0 END, least(support_count, 4) / 4.0), 9) AS similarity FROM sc0),
"""
QUOTA = min(4, max(1, KEEP // 8))
SELECTED = SCORED + f"""se1 AS (SELECT *, exact_evidence > 0 OR (name_score >= 0.92 AND address_score >= 0.85) OR (name_score >= 0.95 AND address_score >= 0.70) OR (address_score >= 0.95 AND name_score >= 0.70) AS strong,
    max(similarity) OVER (PARTITION BY source1_id) AS top, count(*) OVER (PARTITION BY source1_id) AS n FROM sc),
se2 AS (SELECT *, row_number() OVER (PARTITION BY source1_id, strong, left(target_id, 3) ORDER BY similarity DESC, target_id) AS rp FROM se1),
se3 AS (SELECT *, CASE WHEN strong THEN 0 WHEN target_id LIKE 'S2-%' AND rp <= {QUOTA} THEN 1 WHEN target_id LIKE 'S3-%' AND rp <= {QUOTA} THEN 2 WHEN similarity >= greatest(0.55, round(top - 0.2, 9)) THEN 3 ELSE 4 END AS phase,
    CASE WHEN top >= 0.9 THEN 4 WHEN top >= 0.8 THEN {min(12, KEEP)} ELSE {min(24, KEEP)} END AS mk FROM se2),
se4 AS (SELECT *, row_number() OVER (PARTITION BY source1_id ORDER BY phase, similarity DESC, target_id) AS rr FROM se3),
se AS (SELECT *, row_number() OVER (PARTITION BY source1_id ORDER BY similarity DESC, target_id) AS rank FROM se4 WHERE n <= {KEEP} OR (phase < 4 AND rr <= {KEEP}) OR rr <= least(mk, {KEEP})),
"""
LABELLED = SELECTED + TRUTH + """pr AS (SELECT se.*, round(similarity, 6) AS probability, CASE WHEN truth.target_id IS NULL THEN 0 ELSE 1 END AS label FROM se LEFT JOIN truth USING (source1_id, target_id)),
"""


def f05(tp: str, pred: str, truth: str) -> str:
    p, r = f"({tp}::DOUBLE / {pred})", f"({tp}::DOUBLE / {truth})"
    return f"CASE WHEN {truth} = 0 THEN (CASE WHEN {pred} = 0 THEN 1.0 ELSE 0.0 END) WHEN {pred} = 0 OR {tp} = 0 THEN 0.0 ELSE 1.25 * {p} * {r} / (0.25 * {p} + {r}) END"


def counted(predicted: str) -> str:
    return f"""c AS (SELECT s.entity_id AS source1_id, s.country, coalesce(tc.n, 0) AS truth, coalesce(h.predicted, 0) AS predicted, coalesce(h.tp, 0) AS tp FROM s
    LEFT JOIN (SELECT source1_id, count(*) AS n FROM truth GROUP BY 1) tc ON tc.source1_id = s.entity_id
    LEFT JOIN (SELECT p.source1_id, count(*) AS predicted, count(truth.target_id) AS tp FROM {predicted} p LEFT JOIN truth USING (source1_id, target_id) GROUP BY 1) h ON h.source1_id = s.entity_id)"""


def ranked(policy: str, rows: str) -> str:
    """Decision policy over ``rows``; ``policy`` gives high, low, amb, delta, most and least as columns."""
    return f"""u AS (SELECT r.*, {policy}, (name_score >= 0.92 AND address_score >= 0.82) OR (name_score >= 0.95 AND address_score >= 0.70) OR (address_score >= 0.95 AND name_score >= 0.70) AS st,
    probability - coalesce(lead(probability) OVER w, 0) AS m, row_number() OVER w AS pos FROM {rows} r WINDOW w AS (PARTITION BY source1_id ORDER BY probability DESC, target_id)),
u2 AS (SELECT *, probability >= high OR m >= amb OR st AS c1 FROM u WHERE probability >= low AND probability >= least),
u3 AS (SELECT *, min(CASE WHEN c1 THEN pos END) OVER (PARTITION BY source1_id) AS f FROM u2),
u4 AS (SELECT *, row_number() OVER (PARTITION BY source1_id ORDER BY pos) AS k FROM u3 WHERE c1 AND (pos = f OR probability >= high + delta OR st))
SELECT source1_id, target_id FROM u4 WHERE k <= most"""


LIT = "lit AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {quoted(n)}, {quoted(a)})" for i, n, a in LITERALS) + ") v(id, business_name, business_address)),"
VARIED = SIDES + TRUTH + """mp AS (SELECT s.core AS s_core, t.core AS t_core, s.address AS s_address, t.address AS t_address FROM truth JOIN s ON s.entity_id = source1_id JOIN t ON t.entity_id = target_id),
vp AS (""" + " UNION ALL ".join(
    f"SELECT '{side}' AS side, token, unnest(list_filter(list_distinct({words(b)}), lambda x: length(x) >= 3)) AS target FROM (SELECT unnest(list_filter(list_distinct({words(a)}), lambda x: length(x) >= 3)) AS token, * FROM mp)"
    for side, a, b in (("name_forward", "s_core", "t_core"), ("name_reverse", "t_core", "s_core"), ("address_forward", "s_address", "t_address"), ("address_reverse", "t_address", "s_address"))
) + """),
vn AS (SELECT side, token, target, count(*) AS n FROM vp GROUP BY ALL HAVING count(*) >= 2),
vr AS (SELECT *, sum(n) OVER (PARTITION BY side, token) AS total, row_number() OVER (PARTITION BY side, token ORDER BY n DESC, target) AS r FROM vn),
"""  # fmt: skip
PREDICTED = LABELLED + "pd AS (SELECT * FROM pr WHERE probability >= 0.5),"

COLLAPSED = "c[1] || replace(c[2:], '7', '')"  # of a word's codes: h and w go, runs become one
for digit in "01234567":
    COLLAPSED = f"regexp_replace({COLLAPSED}, '{digit}+', '{digit}', 'g')"

ORACLES: dict[str, str] = {
    "normalize_names": f"WITH {BASED} z AS (SELECT 1) SELECT entity_id, name FROM named",
    "normalize_addresses": f"WITH {BASED} z AS (SELECT 1) SELECT entity_id, address FROM named",
    "normalize_literals": f"WITH {LIT} b AS (SELECT id, {base('business_name')} AS bn, {base('business_address')} AS ba FROM lit), n AS (SELECT *, {name('bn')} AS name FROM b) SELECT id, name, trim(regexp_replace(name, '{LEGAL_TAIL}', '')) AS core, {address('ba')} AS address, array_to_string({numbers('ba')}, ' ') AS numbers, {postal('ba')} AS postal FROM n",
    "core_sorted": f"WITH {BASED} z AS (SELECT 1) SELECT entity_id, country, core, sorted_core, numbers, array_to_string(list_filter({words('address')}, lambda x: x <> street_number AND x <> postal), ' ') AS street, postal FROM d",
    "acronyms": f"WITH {BASED} z AS (SELECT 1) SELECT entity_id, {acronym('core')} AS acronym FROM d",
    "entity_texts": f"WITH {ENT} z AS (SELECT 1) SELECT entity_id, concat_ws('; ', 'business name: ' || nullif(trim(business_name), ''), 'business address: ' || nullif(trim(business_address), ''), 'country: ' || nullif(trim(country), '')) AS text FROM ent",
    "token_df": f"WITH {SIDES} z AS (SELECT 1) SELECT token, frequency FROM df",
    "rare_tokens": f"WITH {SIDES} z AS (SELECT 1) SELECT token, entity_id FROM (SELECT entity_id, unnest(list_distinct(string_split(core, ' '))) AS token FROM t) x WHERE length(token) >= 3 AND NOT EXISTS (SELECT 1 FROM df WHERE df.token = x.token AND frequency > {HOT})",
    "key_histogram": f"WITH {KEYS} z AS (SELECT 1) SELECT family, count(*) AS n, count(DISTINCT key) AS distinct_keys, sum(weight) AS weight FROM ks GROUP BY family",
    "frequency_split": f"WITH {KEYS} z AS (SELECT 1) SELECT 'source' AS side, (SELECT count(*) FROM bs) AS bounded_rows, (SELECT count(DISTINCT (family, key)) FROM bs) AS bounded_keys, (SELECT count(*) FROM hs) AS hot_keys, (SELECT coalesce(sum(n), 0) FROM hs)::BIGINT AS hot_rows UNION ALL SELECT 'target', (SELECT count(*) FROM bt), (SELECT count(DISTINCT (family, key)) FROM bt), (SELECT count(*) FROM ht), (SELECT coalesce(sum(n), 0) FROM ht)::BIGINT",
    "blocking_evidence": f"WITH {PAIRS} z AS (SELECT 1) SELECT * FROM ev",
    "multi_route_merge": f"WITH {PAIRS} z AS (SELECT 1) SELECT source1_id, target_id, greatest(evidence, CASE WHEN support_count > 1 THEN 2.0 ELSE evidence END) AS evidence, name_evidence, address_evidence, structural_evidence, exact_evidence, CASE WHEN support_count > 1 THEN 0.5 ELSE 0.0 END::DOUBLE AS semantic_score, CASE WHEN support_count > 1 THEN 2 * support_count ELSE support_count END AS support_count, CASE WHEN support_count > 1 THEN 3 ELSE 0 END AS semantic_rank FROM ev",
    "low_candidates": f"WITH {PAIRS} z AS (SELECT 1) SELECT entity_id FROM s LEFT JOIN (SELECT source1_id, count(*) AS n FROM ev GROUP BY 1) c ON c.source1_id = entity_id WHERE coalesce(n, 0) < 4",
    "pair_scores": f"""WITH {PAIRS} z AS (SELECT 1), q AS (SELECT *, {words('s_core')} AS a, {words('t_core')} AS b, {words('s_numbers')} AS x, {words('t_numbers')} AS y, {acronym('s_core')} AS aa, {acronym('t_core')} AS ab FROM pf)
        SELECT source1_id, target_id, round({jaccard('s_core', 't_core')}, 6) AS name_jaccard, round(CASE WHEN least(len(a), len(b)) = 0 THEN 0.0 ELSE len(list_intersect(a, b))::DOUBLE / least(len(list_distinct(a)), len(list_distinct(b))) END, 6) AS name_containment,
        len(list_intersect({words('s_address')}, {words('t_address')}))::DOUBLE AS address_overlap, ((aa <> '' AND (aa = t_core OR aa = ab)) OR (ab <> '' AND ab = s_core))::INT::DOUBLE AS acronym_match,
        CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0.5 ELSE round(len(list_intersect(x, y))::DOUBLE / len(list_distinct(x || y)), 6) END AS number_jaccard, CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0.5 ELSE (x[1] = y[1])::INT::DOUBLE END AS first_number_match,
        round(least(length(s_name), length(t_name))::DOUBLE / greatest(length(s_name), length(t_name), 1), 6) AS name_length_ratio, s_country = t_country AS country_match FROM q""",
    "evidence_similarity": f"WITH {SCORED} z AS (SELECT 1) SELECT source1_id, target_id, round(ev_norm, 6) AS ev_norm, round(similarity, 6) AS similarity FROM sc",
    "adaptive_select": f"WITH {SELECTED} z AS (SELECT 1) SELECT source1_id, target_id, rank FROM se",
    "rank_windows": f"""WITH {SELECTED} k AS (SELECT source1_id, target_id, rank, row_number() OVER (PARTITION BY source1_id ORDER BY name_score DESC, target_id) AS name_rank, row_number() OVER (PARTITION BY source1_id ORDER BY address_score DESC, target_id) AS address_rank,
        row_number() OVER (PARTITION BY target_id ORDER BY similarity DESC, source1_id) AS reverse_rank FROM se) SELECT *, (rank = 1 AND reverse_rank = 1)::INT AS mutual_best, round(1.0::DOUBLE / (1 + abs(name_rank - address_rank)), 6) AS rank_agreement FROM k""",
    "source_bridge": f"""WITH {SELECTED} k AS (SELECT *, left(target_id, 2) AS side, row_number() OVER (PARTITION BY source1_id, left(target_id, 2) ORDER BY similarity DESC, target_id) AS k FROM se),
        o AS (SELECT a.source1_id, a.target_id, b.side = a.side AS same, 0.6 * ({jaccard('a.t_core', 'b.t_core')}) + 0.4 * ({jaccard('a.t_address', 'b.t_address')}) AS v,
            row_number() OVER (PARTITION BY a.source1_id, a.target_id, b.side = a.side ORDER BY b.k) AS r FROM k a JOIN k b ON a.source1_id = b.source1_id AND a.target_id <> b.target_id AND b.k <= 4),
        g AS (SELECT source1_id, target_id, coalesce(max(v) FILTER (NOT same), 0) AS op, coalesce(max(v) FILTER (same), 0) AS sa FROM o WHERE r <= 3 GROUP BY ALL)
        SELECT source1_id, target_id, round(coalesce(op, 0)::DOUBLE, 6) AS opposite_source_bridge, round(coalesce(sa, 0)::DOUBLE, 6) AS same_source_competition, round((coalesce(op, 0) - coalesce(sa, 0))::DOUBLE, 6) AS bridge_gap FROM k LEFT JOIN g USING (source1_id, target_id)""",
    "truth_pairs": f"WITH {TRUTH} z AS (SELECT 1) SELECT * FROM truth",
    "variation_map": f"WITH {VARIED} z AS (SELECT 1) SELECT side, token, target, round(n::DOUBLE / total, 9) AS prob FROM vr WHERE r <= 12",
    "semantic_topk": "WITH p AS (SELECT q.vec_id AS query_id, t.vec_id AS target_id, round(list_cosine_similarity(q.embedding::DOUBLE[], t.embedding::DOUBLE[]), 9) AS s FROM embeddings q, embeddings t WHERE q.vec_id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, target_id) AS rank FROM p) SELECT query_id, target_id, round(s, 5) AS score, rank FROM r WHERE rank <= 10",
    "retrieval_recall": f"WITH {PAIRS} {TRUTH} {counted('ev')} SELECT count(*) AS entities, sum(truth)::BIGINT AS pairs, round(sum(tp)::DOUBLE / sum(truth), 9) AS pair_recall, round(avg((tp = truth)::INT), 9) AS complete_recall, round(avg((tp = 0)::INT), 9) AS zero_hit_rate FROM c WHERE truth > 0",
    "country_diagnostics": f"WITH {PAIRS} {TRUTH} {counted('ev')} SELECT coalesce(nullif(country, ''), '<missing>') AS country, count(*) AS entities, sum(truth)::BIGINT AS truth_pairs, sum(tp)::BIGINT AS hit_pairs, round(sum(tp)::DOUBLE / nullif(sum(truth), 0), 9) AS pair_recall, round(avg(CASE WHEN truth > 0 THEN (tp = truth)::INT END), 9) AS complete_recall, round(avg(predicted), 9) AS avg_candidates FROM c GROUP BY 1",
    "candidate_stats": f"""WITH {PAIRS} c AS (SELECT coalesce(n, 0) AS n FROM s LEFT JOIN (SELECT source1_id, count(*) AS n FROM ev GROUP BY 1) x ON x.source1_id = s.entity_id), l AS (SELECT list_sort(list(n)) AS v FROM c)
        SELECT len(v) AS entities, list_sum(v)::BIGINT AS total, round(list_sum(v)::DOUBLE / len(v), 9) AS avg, v[len(v) // 2 + 1] AS median, v[len(v)] AS max, v[least(len(v) - 1, floor(len(v) * 0.95)::BIGINT) + 1] AS p95, v[least(len(v) - 1, floor(len(v) * 0.99)::BIGINT) + 1] AS p99 FROM l""",
    "macro_f05": f"WITH {PREDICTED} {counted('pd')} SELECT country, count(*) AS entities, round(avg({f05('tp', 'predicted', 'truth')}), 9) AS macro_f05 FROM c GROUP BY country",
    "precision_recall": f"WITH {PREDICTED} {counted('pd')} SELECT sum(tp)::BIGINT AS tp, sum(predicted)::BIGINT AS predicted, sum(truth)::BIGINT AS truth, round(sum(tp)::DOUBLE / sum(predicted), 9) AS precision, round(sum(tp)::DOUBLE / sum(truth), 9) AS recall FROM c",
    "threshold_sweep": f"""WITH {LABELLED} b AS (SELECT s.entity_id AS source1_id, coalesce(n, 0) AS truth FROM s LEFT JOIN (SELECT source1_id, count(*) AS n FROM truth GROUP BY 1) x ON x.source1_id = s.entity_id),
        th AS (SELECT DISTINCT probability AS p FROM pr UNION ALL SELECT 1.000001),
        e AS (SELECT th.p, b.source1_id, b.truth, count(pr.target_id) AS pred, coalesce(sum(pr.label), 0) AS tp FROM th CROSS JOIN b LEFT JOIN pr ON pr.source1_id = b.source1_id AND pr.probability >= th.p GROUP BY ALL)
        SELECT p AS threshold, macro_f05 FROM (SELECT p, round(avg({f05('tp', 'pred', 'truth')}), 9) AS macro_f05 FROM e GROUP BY p) ORDER BY macro_f05 DESC, threshold DESC LIMIT 1""",
    "decision_policy": f"WITH {LABELLED} {ranked(f'{POLICY.high} AS high, {POLICY.low} AS low, {POLICY.ambiguous_margin} AS amb, {POLICY.second_match_delta} AS delta, {POLICY.max_matches} AS most, {POLICY.min_absolute} AS least', 'pr')}",
    "country_policies": "WITH " + LABELLED + ranked("CASE s_country WHEN 'en' THEN 0.7 WHEN 'fr' THEN 0.5 ELSE 0.9 END::DOUBLE AS high, CASE s_country WHEN 'en' THEN 0.7::DOUBLE - 0.03::DOUBLE WHEN 'fr' THEN 0.5::DOUBLE - 0.03::DOUBLE ELSE 0.9::DOUBLE - 0.03::DOUBLE END AS low, 0.03::DOUBLE AS amb, 0.04::DOUBLE AS delta, 64 AS most, 0.0 AS least", "pr"),
    "submission_rows": f"WITH {LABELLED} z AS (SELECT 1) SELECT s.entity_id AS source1_id, coalesce(string_agg(target_id, ',' ORDER BY rank), '') AS candidate_entity_ids, coalesce(string_agg(target_id, ',' ORDER BY probability DESC, target_id) FILTER (probability >= 0.5), '') AS matched_entity_ids FROM s LEFT JOIN pr ON pr.source1_id = s.entity_id GROUP BY 1",
    "threshold_rows": f"WITH {LABELLED} z AS (SELECT 1) SELECT s.entity_id AS source1_id, coalesce(string_agg(target_id, ',' ORDER BY target_id) FILTER (probability >= 0.5), '') AS matched_entity_ids FROM s LEFT JOIN pr ON pr.source1_id = s.entity_id GROUP BY 1",
    "country_top2": f"WITH {SIDES} z AS (SELECT 1) SELECT country, count(*) AS entities FROM s WHERE country <> '' GROUP BY 1 ORDER BY entities DESC, country LIMIT 2",
    "stratified_split": f"""WITH {SIDES} {TRUTH} k AS (SELECT entity_id, least(coalesce(n, 0), 3)::INT AS stratum FROM s LEFT JOIN (SELECT source1_id, count(*) AS n FROM truth GROUP BY 1) x ON x.source1_id = entity_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('42:' || entity_id), entity_id) AS r, count(*) OVER (PARTITION BY stratum) AS n FROM k)
        SELECT entity_id, stratum, r <= CASE WHEN n > 1 THEN greatest(1, least(n - 1, round_even(n * 0.2, 0))) ELSE 0 END AS valid FROM r""",
    "composite_texts": f"WITH {ENT} z AS (SELECT 1) SELECT entity_id, trim(business_name || ' ' || business_address) AS text FROM ent",
    "max_id_bytes": f"WITH {ENT} z AS (SELECT 1) SELECT max(strlen(entity_id))::INT AS bytes FROM ent",
    "candidate_summary": f"WITH {PAIRS} k AS (SELECT * FROM (VALUES ('all'), ('exact'), ('structural'), ('none')) v(which)), n AS (SELECT which, source1_id, count(*) AS n FROM k JOIN ev ON CASE which WHEN 'all' THEN true WHEN 'exact' THEN exact_evidence > 0 WHEN 'structural' THEN structural_evidence > 0 ELSE evidence < 0 END GROUP BY ALL) SELECT which, coalesce(sum(n), 0)::BIGINT AS pairs, count(n) AS entities, round(coalesce(avg(n), 0), 9) AS avg FROM k LEFT JOIN n USING (which) GROUP BY which",
    "update_probabilities": f"WITH {LABELLED} z AS (SELECT 1) SELECT source1_id, target_id, round(CASE WHEN rank = 1 THEN 1 - probability ELSE probability END, 6) AS probability FROM pr",
    "preprocess_entities": f"WITH {BASED} z AS (SELECT 1) SELECT entity_id, country, name AS business_name_normalized, core AS business_name_core, address AS business_address_normalized, array_to_string({numbers('ba')}, ' ') AS business_address_numbers, coalesce(list_filter({numbers('ba')}, lambda x: x <> postal)[1], '') AS business_address_street_number, array_to_string(list_filter({words('address')}, lambda x: x <> coalesce(list_filter({numbers('ba')}, lambda y: y <> postal)[1], '') AND x <> postal), ' ') AS business_address_street, '' AS business_address_city, postal AS business_address_postal FROM cored",
    "address_components": f"""WITH {LIT} b AS (SELECT id, coalesce(business_address, '') AS c, {base('business_address')} AS ba FROM lit),
        n AS (SELECT id, c, {address('ba')} AS normalized, {numbers('ba')} AS nums FROM b),
        q AS (SELECT id, normalized, {postal('normalized')} AS postal, nums, c FROM n),
        q2 AS (SELECT *, coalesce(list_filter(nums, lambda x: x <> postal)[1], '') AS street_number FROM q),
        p0 AS (SELECT id, generate_subscripts(string_split_regex(c, '[,;|]+'), 1) AS k, unnest(string_split_regex(c, '[,;|]+')) AS part FROM b),
        p1 AS (SELECT id, k, {base('part')} AS pb FROM p0),
        p2 AS (SELECT id, k, {address('pb')} AS part FROM p1),
        p3 AS (SELECT p2.id, k, array_to_string(list_filter({words('part')}, lambda x: x <> street_number AND x <> postal), ' ') AS part FROM p2 JOIN q2 ON p2.id = q2.id WHERE part <> ''),
        l AS (SELECT id, list(part ORDER BY k) AS v FROM p3 GROUP BY id)
        SELECT q2.id, normalized, street_number, coalesce(v[1], '') AS street, CASE WHEN coalesce(len(v), 0) < 2 THEN '' WHEN v[-1] = v[1] AND len(v) > 2 THEN v[-2] ELSE v[-1] END AS city, postal FROM q2 LEFT JOIN l ON l.id = q2.id""",
    "phonetic_keys": f"""WITH {SIDES} w AS (SELECT entity_id, unnest(list_distinct(string_split(core, ' '))) AS token FROM s), l AS (SELECT entity_id, token, regexp_replace(token, '[^a-z]', '', 'g') AS x FROM w WHERE token <> ''),
        m AS (SELECT *, translate(x, 'abcdefghijklmnopqrstuvwxyz', '01230127022455012623017202') AS c FROM l)
        SELECT entity_id, token, CASE WHEN regexp_matches(token, '^[a-z]') THEN upper(x[1]) || rpad(left(replace({COLLAPSED}[2:], '0', ''), 3), 3, '0') ELSE '' END AS sound FROM m""",
    "validator_findings": f"""WITH {SIDES} bad AS (SELECT * FROM (VALUES (1, 'S1-0', 'S2-1,S2-1,S1-0'), (2, 'S1-3', 'S9-1,S3-2'), (3, 'S1-3', ''), (4, 'S1-999999999', 'S2-1'), (5, 'S1-6', 'S2-777777777,none')) v(n, source1_id, m)),
        e AS (SELECT source1_id, t FROM (SELECT source1_id, trim(unnest(string_split(m, ','))) AS t FROM bad) WHERE t <> '' AND lower(t) NOT IN ('none', 'nan'))
        SELECT 'duplicate_row' AS kind, source1_id, count(*)::VARCHAR AS detail FROM bad GROUP BY 2 HAVING count(*) > 1
        UNION ALL SELECT 'repeated_id', source1_id, t FROM e GROUP BY 2, 3 HAVING count(*) > 1
        UNION ALL SELECT DISTINCT 'self_match', source1_id, t FROM e WHERE t = source1_id
        UNION ALL SELECT DISTINCT 'wrong_prefix', source1_id, t FROM e WHERE NOT (t LIKE 'S2-%' OR t LIKE 'S3-%')
        UNION ALL SELECT 'missing_source', entity_id, '' FROM s WHERE entity_id NOT IN (SELECT source1_id FROM bad)
        UNION ALL SELECT DISTINCT 'extra_source', source1_id, '' FROM bad WHERE source1_id NOT IN (SELECT entity_id FROM s)
        UNION ALL SELECT DISTINCT 'unknown_id', source1_id, t FROM e WHERE t NOT IN (SELECT entity_id FROM t)""",
    "trigram_cosine": f"""WITH {PAIRS} w AS (SELECT source1_id, target_id, 's' AS side, ' ' || unnest({words('s_name')}) || ' ' AS w FROM pf UNION ALL SELECT source1_id, target_id, 't', ' ' || unnest({words('t_name')}) || ' ' FROM pf),
        g AS (SELECT source1_id, target_id, side, w[k : k + 2] AS g, count(*) AS n FROM (SELECT *, unnest(range(1, greatest(1, length(w) - 2) + 1)) AS k FROM w) GROUP BY ALL),
        q AS (SELECT source1_id, target_id, side, sqrt(sum(n * n)) AS q FROM g GROUP BY ALL),
        dt AS (SELECT a.source1_id, a.target_id, sum(a.n * b.n) AS dot FROM g a JOIN g b ON a.source1_id = b.source1_id AND a.target_id = b.target_id AND a.g = b.g AND a.side = 's' AND b.side = 't' GROUP BY ALL)
        SELECT pf.source1_id, pf.target_id, round(coalesce(dot / (x.q * y.q), 0), 6) AS cosine FROM pf LEFT JOIN dt USING (source1_id, target_id) LEFT JOIN q x ON x.source1_id = pf.source1_id AND x.target_id = pf.target_id AND x.side = 's' LEFT JOIN q y ON y.source1_id = pf.source1_id AND y.target_id = pf.target_id AND y.side = 't'""",
    "bounded_sample": f"""WITH {LABELLED} b AS (SELECT *, rank * 37 + length(source1_id) * 11 + length(target_id) * 13 AS spread, rank = 1 OR exact_evidence > 0 OR similarity >= 0.82 AS hard FROM pr),
        c AS (SELECT count(*) AS rows_all, count(*) FILTER (label = 1) AS p FROM b),
        o AS (SELECT 8 * (1 << k) AS mod FROM range(17) r(k)),
        f AS (SELECT mod, (SELECT p FROM c) + (SELECT count(*) FROM b WHERE label = 0 AND hard AND spread % mod = 0) AS kept FROM o),
        g AS (SELECT coalesce(min(mod) FILTER (kept <= 600), 8 * (1 << 16)) AS mod FROM f)
        SELECT source1_id, target_id, label FROM b, c, g WHERE rows_all <= 600 OR label = 1 OR (p < 600 AND hard AND spread % mod = 0)""",
}
