"""Relational operators as SQL over the model's frames.

A name in braces is a frame of the model or a base table. Texts in SHARED run as they
stand on both engines; DUAL holds a Spark text and the oracle's.
"""

from __future__ import annotations

SHARED = {
    "p2_search_case": "SELECT target_id, CASE WHEN any_xray = 1 THEN 'xray' WHEN any_nmr = 1 THEN 'nmr' WHEN any_em = 1 THEN 'em' ELSE 'none' END AS method FROM {target_stage}",
    "p3_null_safe_predicate": "SELECT target_id, coalesce(max_stage, -1) >= 8 AS top FROM {target_stage} WHERE coalesce(max_stage, -1) < 3",
    "p4_like_flags": "SELECT p_partkey, lower(p_name) LIKE '%green%' AS has_green, p_type LIKE 'PROMO%' AS is_promo FROM {part}",
    "p5_in_list": "SELECT target_id, centre IN ('NATION_1', 'NATION_5', 'NATION_9') AS held FROM {targets}",
    "p8_case_average": "SELECT centre, round(100 * avg(CASE WHEN censored THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 2) AS pct FROM {censoring} GROUP BY centre",
    "j1_left_dimension": "SELECT e.target_id, e.trial_id, e.status_raw, m.status_canon FROM {events} e LEFT JOIN {status_map} m ON e.status_raw = m.status_raw",
    "j2_inner_using": "SELECT target_id, organism, max_stage FROM {targets} JOIN {target_stage} USING (target_id)",
    "j3_left_star": """SELECT t.target_id, t.centre, s.max_stage, c.censored, l.n_labels FROM {targets} t LEFT JOIN {target_stage} s ON s.target_id = t.target_id
        LEFT JOIN {censoring} c ON c.target_id = t.target_id LEFT JOIN (SELECT target_id, count(*) AS n_labels FROM {labels_l1} GROUP BY target_id) l ON l.target_id = t.target_id""",
    "j4_composite_key": "SELECT a.target_id, b.n, b.pct FROM {activity} a LEFT JOIN {bulk_dates} b ON b.centre = a.centre AND b.d = a.stop_date",
    "j5_theta_self_join": "SELECT a.target_id AS chosen_id, b.target_id AS rejected_id FROM {targets} a JOIN {targets} b ON a.cluster70 = b.cluster70 AND a.target_id > b.target_id + 1",
    "j8_subquery_rewritten": "SELECT s.target_id, t.cluster70 FROM {censoring} s JOIN {targets} t ON t.target_id = s.target_id LEFT JOIN {labels_l2} l ON l.target_id = s.target_id WHERE l.target_id IS NULL",
    "j9_scalar_subquery": "SELECT c.target_id, (SELECT min(e.status_date) FROM {events} e WHERE e.target_id = c.target_id) AS first_event FROM {targets} c",
    "j10_semi_join": "SELECT target_id, centre FROM {targets} WHERE target_id IN (SELECT target_id FROM {labels_l2} WHERE deposited)",
    "j11_anti_join": "SELECT status_raw, count(*) AS n FROM {events} e WHERE NOT EXISTS (SELECT 1 FROM {status_map} m WHERE m.status_raw = e.status_raw) GROUP BY status_raw",
    "j12_hits_join": "SELECT h.k, t.target_id, t.centre FROM (SELECT doc_id AS k, doc_id * 7 AS target_id FROM {documents}) h JOIN {targets} t ON t.target_id = h.target_id",
    "j13_left_made_inner": "SELECT t.target_id, s.max_stage FROM {targets} t LEFT JOIN {target_stage} s ON s.target_id = t.target_id WHERE s.max_stage >= 5",
    "j15_grid_join": """SELECT c.target_id, c.gate, c.n_precedents, f.n_cluster_precedents, l.label FROM {context} c LEFT JOIN {cluster_features} f ON f.target_id = c.target_id
        LEFT JOIN {labels_l1} l ON l.target_id = c.target_id AND l.gate = c.gate""",
    "a2_filtered_aggregates": "SELECT centre, count(*) FILTER (WHERE censored) AS n_censored, count(*) FILTER (WHERE max_stage IS NULL) AS n_unknown, max(last_any) FILTER (WHERE max_stage >= 4) AS last_high FROM {censoring} GROUP BY centre",
    "a5_count_distinct": "SELECT count(DISTINCT seq_md5) AS n, count(*) - count(DISTINCT target_id) AS dup FROM {targets}",
    "a6_having_leaks": "SELECT cluster70, count(DISTINCT centre) AS k FROM {targets} GROUP BY cluster70 HAVING count(DISTINCT centre) > 1",
    "a7_max_nullif": "SELECT target_id, max(nullif(CASE WHEN size < 25 THEN '' ELSE kind END, '')) AS kind FROM {trials} GROUP BY target_id",
    "a8_bool_or_coalesce": "SELECT target_id, coalesce(bool_or(terminal), false) AS stopped FROM {canon} GROUP BY target_id",
    "a9_two_levels": """SELECT target_id, count(*) AS n_trials, max(n_parts) AS most_parts, bool_or(big) AS any_big FROM
        (SELECT target_id, trial_id, count(*) AS n_parts, bool_or(size > 40) AS big FROM {trials} GROUP BY target_id, trial_id) GROUP BY target_id""",
    "a10_any_value": "SELECT gate, min(in_loss) AS in_loss_all, count(*) AS n FROM {labels_l1} GROUP BY gate",
    "a11_group_by_all": "SELECT centre, organism, count(*) AS n FROM {targets} GROUP BY ALL",
    "a12_distinct": "SELECT DISTINCT centre, organism FROM {targets}",
    "a13_mode": "SELECT status_canon FROM {canon} WHERE status_canon IS NOT NULL GROUP BY status_canon ORDER BY count(*) DESC, status_canon LIMIT 1",
    "a14_archive_stats": "SELECT (SELECT count(*) FROM {targets}) AS n_targets, (SELECT count(*) FROM {events}) AS n_events, (SELECT count(*) FROM {labels_l2} WHERE deposited) AS n_deposited",
    "a15_outcomes_by_centre": "SELECT centre, outcome, count(*) AS n FROM {labels_l2} GROUP BY centre, outcome",
    "a16_value_counts": "SELECT status_raw, count(*) AS n FROM {events} GROUP BY status_raw",
    "w2_share_of_total": "SELECT status_canon, n, round(CAST(100 AS DOUBLE) * n / sum(n) OVER (), 4) AS pct FROM (SELECT status_canon, count(*) AS n FROM {canon} GROUP BY status_canon)",
    "w3_percentile_decile": """SELECT p.p_partkey, CAST(floor((k.below + 1 + (k.ties - 1) / CAST(2 AS DOUBLE)) / k.n * 10) AS INT) AS decile FROM {part} p JOIN (SELECT p_size, ties, sum(ties) OVER (ORDER BY p_size) - ties AS below,
        sum(ties) OVER () AS n FROM (SELECT p_size, CAST(count(*) AS DOUBLE) AS ties FROM {part} GROUP BY p_size)) k ON k.p_size = p.p_size""",
    "w4_group_size": "SELECT target_id, count(*) OVER (PARTITION BY cluster30) AS cluster_size FROM {targets}",
    "w5_dense_id_by_size": "SELECT cluster30, n, CAST(row_number() OVER (ORDER BY n DESC, cluster30) - 1 AS INT) AS cluster_id FROM (SELECT cluster30, count(*) AS n FROM {targets} GROUP BY cluster30)",
    "t1_order_limit": "SELECT centre, count(*) AS n FROM {targets} GROUP BY centre ORDER BY n DESC, centre LIMIT 15",
    "t2_nulls_last": "SELECT target_id, max_stage FROM {target_stage} ORDER BY max_stage ASC NULLS LAST, target_id LIMIT 50",
    "t4_order_hits": "SELECT target_id, n_close_precedents, n_cluster_precedents FROM {cluster_features} ORDER BY n_close_precedents DESC, n_cluster_precedents DESC, target_id LIMIT 40",
    "t6_sort_by_tokens": "SELECT conv_id, turn, CAST(floor(length(text) / CAST(4 AS DOUBLE)) AS INT) AS tokens FROM {conversations} ORDER BY tokens, conv_id, turn LIMIT 100",
    "u1_union_distinct": "SELECT chosen_id AS id FROM {labels_l3} WHERE hard UNION SELECT rejected_id AS id FROM {labels_l3} WHERE hard",
    "u2_oversample": "SELECT target_id, label FROM {labels_l1} UNION ALL SELECT target_id, label FROM {labels_l1} WHERE label = 'failed' UNION ALL SELECT target_id, label FROM {labels_l1} WHERE label = 'failed'",
    "t5_top_counterfactuals": "SELECT target_id, gate, delta FROM (SELECT target_id, gate, delta, row_number() OVER (PARTITION BY target_id ORDER BY delta DESC, gate) AS rn FROM (SELECT target_id, gate, n_precedents - n_precedents_cleared AS delta FROM {context})) WHERE rn <= 6",
    "d5_grouped_folds": "SELECT cluster_id, CAST((row_number() OVER (ORDER BY md5(CAST(cluster_id AS STRING)), cluster_id) - 1) % 5 AS INT) AS fold FROM (SELECT DISTINCT cluster_id FROM {splits} WHERE split_cluster = 'train')",
    "g1_stratum_key": "SELECT target_id, concat(CAST(least(seq_len, 3) AS STRING), '|', organism, '|', centre) AS stratum FROM {targets}",
    "g2_stratified_sample": """SELECT target_id, organism FROM (SELECT target_id, organism, row_number() OVER (PARTITION BY organism ORDER BY md5(CAST(target_id AS STRING)), target_id) AS rn,
        count(*) OVER (PARTITION BY organism) AS n FROM {targets}) WHERE rn <= round(n * CAST(0.3 AS DOUBLE))""",
    "g12_presence_test": "SELECT c_custkey, c_mktsegment IS NOT NULL AND lower(trim(c_mktsegment)) NOT IN ('', 'nan', 'none', '<na>') AS present FROM {customer}",
    "c8_by_reason": "SELECT censored_reason, max_stage, count(*) AS n FROM {censoring} GROUP BY censored_reason, max_stage",
    "d3_leave_centre_out": "SELECT centre, loco_eligible, count(*) AS n FROM {splits} GROUP BY centre, loco_eligible",
    "d2_temporal_split": "SELECT split_temporal, count(*) AS n, min(first_event) AS first_day, max(last_event) AS last_day FROM {splits} GROUP BY split_temporal",
    "x6_assemble_features": "SELECT c.target_id, c.gate, c.n_precedents, c.cluster_base_rate, f.cluster_censored_frac, f.closest_identity_band, t.organism FROM {context} c LEFT JOIN {cluster_features} f ON f.target_id = c.target_id LEFT JOIN {targets} t ON t.target_id = c.target_id",
    "x7_coverage": "SELECT gate, count(*) AS n, round(CAST(100 AS DOUBLE) * count(cluster_base_rate) / count(*), 2) AS pct FROM {context} GROUP BY gate",
    "x9_strength": "SELECT strength, count(*) AS n FROM {cluster_features} GROUP BY strength",
    "g5_gate_priors": "SELECT l.gate, round(avg(CASE WHEN l.label = 'cleared' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 6) AS prior FROM {labels_l1} l JOIN {splits} s ON s.target_id = l.target_id WHERE l.in_loss AND s.split_cluster = 'train' GROUP BY l.gate",
    "g4_task_quota": "SELECT conv_id, turn, role FROM (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) AS rn FROM {conversations}) WHERE rn <= 40",
    "m10_shrunk_rate": "SELECT c.target_id, c.gate, round(greatest(CAST(0.03 AS DOUBLE), least(CAST(0.97 AS DOUBLE), (c.n_precedents_cleared + 5 * CAST(0.5 AS DOUBLE)) / (c.n_precedents + 5))), 6) AS p FROM {context} c",
    "m11_clip": "SELECT target_id, gate, least(CAST(0.99 AS DOUBLE), greatest(CAST(0.01 AS DOUBLE), cluster_base_rate)) AS p FROM {context}",
    "b1_training_frame": """SELECT l.target_id, l.gate, l.label, s.split_cluster, c.n_precedents, c.cluster_base_rate FROM {labels_l1} l JOIN {splits} s ON s.target_id = l.target_id
        JOIN {context} c ON c.target_id = l.target_id AND c.gate = l.gate WHERE l.in_loss""",
    "f17_blank_junk": "SELECT c_custkey, CASE WHEN lower(trim(c_mktsegment)) IN ('machinery', 'unknown', 'n/a') THEN NULL ELSE c_mktsegment END AS organism FROM {customer}",
    "f25_precedent_note": """SELECT target_id, CASE WHEN censored_reason IN ('both', 'bulk_closure') THEN 'censored by bulk closure' WHEN censored THEN 'censored by wind-down'
        WHEN max_stage >= 8 THEN 'deposited' ELSE concat('stopped at stage ', coalesce(CAST(max_stage AS STRING), 'unknown')) END AS note FROM {censoring}""",
    "s7_text_normalise": "SELECT doc_id, CAST(length(trim(regexp_replace(text, '[ \t\n\r]+', ' '))) AS INT) AS n FROM (SELECT doc_id, replace(replace(text, chr(10), ' '), '  ', ' ') AS text FROM {documents})",
    "s8_md5_key": "SELECT doc_id, CASE WHEN text <> '' THEN md5(text) ELSE '' END AS seq_md5 FROM {documents}",
    "m14_brier": """SELECT l.gate, round(avg((c.cluster_base_rate - y) * (c.cluster_base_rate - y)), 6) AS brier FROM (SELECT *, CASE WHEN label = 'cleared' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS y FROM {labels_l1} WHERE in_loss) l
        JOIN {context} c ON c.target_id = l.target_id AND c.gate = l.gate WHERE c.cluster_base_rate IS NOT NULL GROUP BY l.gate""",
    "m14_auroc": """SELECT gate, CASE WHEN pos > 0 AND neg > 0 THEN round(u / (pos * neg), 6) END AS auroc FROM (SELECT gate, sum(p * (below + n / CAST(2 AS DOUBLE))) AS u, sum(p) AS pos, sum(n) AS neg FROM (
        SELECT gate, p, n, sum(n) OVER (PARTITION BY gate ORDER BY r) - n AS below FROM (SELECT l.gate, c.cluster_base_rate AS r, CAST(count(*) FILTER (WHERE l.label = 'cleared') AS DOUBLE) AS p, CAST(count(*) FILTER (WHERE l.label <> 'cleared') AS DOUBLE) AS n
        FROM {labels_l1} l JOIN {context} c ON c.target_id = l.target_id AND c.gate = l.gate WHERE l.in_loss AND c.cluster_base_rate IS NOT NULL GROUP BY l.gate, c.cluster_base_rate)) GROUP BY gate)""",
    "m13_reliability": """SELECT bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS rate FROM (SELECT c.cluster_base_rate AS p, CASE WHEN l.label = 'cleared' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS y,
        CASE WHEN c.cluster_base_rate < 0.1 THEN 0 WHEN c.cluster_base_rate < 0.2 THEN 1 WHEN c.cluster_base_rate < 0.30000000000000004 THEN 2 WHEN c.cluster_base_rate < 0.4 THEN 3 WHEN c.cluster_base_rate < 0.5 THEN 4
        WHEN c.cluster_base_rate < 0.6000000000000001 THEN 5 WHEN c.cluster_base_rate < 0.7000000000000001 THEN 6 WHEN c.cluster_base_rate < 0.8 THEN 7 WHEN c.cluster_base_rate < 0.9 THEN 8 ELSE 9 END AS bin
        FROM {labels_l1} l JOIN {context} c ON c.target_id = l.target_id AND c.gate = l.gate WHERE l.in_loss AND c.cluster_base_rate IS NOT NULL) GROUP BY bin""",
    "m15_bottleneck_top1": """SELECT count(*) AS n, round(avg(CASE WHEN gate = least(max_stage, 7) THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 6) AS accuracy FROM (SELECT l.target_id, l.gate, l.max_stage, row_number() OVER (PARTITION BY l.target_id ORDER BY c.cluster_base_rate, l.gate) AS rn,
        count(*) OVER (PARTITION BY l.target_id) AS k FROM {labels_l1} l JOIN {context} c ON c.target_id = l.target_id AND c.gate = l.gate WHERE c.cluster_base_rate IS NOT NULL AND NOT l.censored) WHERE rn = 1 AND k >= 2 AND max_stage < 8""",
}

_STD = "ACDEFGHIKLMNPQRSTVWY"
_SEQ = "upper(replace(text, 'ß', ' '))"
_COUNT = lambda a, s="s": f"(length({s}) - length(replace({s}, '{a}', '')))"
_N = " + ".join(_COUNT(a) for a in _STD)
# Hydropathy of the 20 standard residues (Kyte and Doolittle).
_KD = {"A": 1.8, "C": 2.5, "D": -3.5, "E": -3.5, "F": 2.8, "G": -0.4, "H": -3.2, "I": 4.5, "K": -3.9, "L": 3.8, "M": 1.9, "N": -3.5, "P": -1.6, "Q": -3.5, "R": -4.5, "S": -0.8, "T": -0.7, "V": 4.2, "W": -0.9, "Y": -1.3}
_GRAVY = " + ".join(f"{_COUNT(a)} * CAST({v} AS DOUBLE)" for a, v in _KD.items())
SHARED["m1_residue_counts"] = f"SELECT doc_id, {', '.join(f'CAST({_COUNT(a)} AS INT) AS n_{a.lower()}' for a in _STD)} FROM (SELECT doc_id, {_SEQ} AS s FROM {{documents}})"
SHARED["m2_gravy"] = f"SELECT doc_id, CASE WHEN {_N} > 0 THEN round(({_GRAVY}) / ({_N}), 6) END AS gravy, CASE WHEN {_N} > 0 THEN round(CAST({_COUNT('F')} + {_COUNT('W')} + {_COUNT('Y')} AS DOUBLE) / ({_N}), 6) END AS aromatic FROM (SELECT doc_id, {_SEQ} AS s FROM {{documents}})"
# pKa of charged groups (EMBOSS) with their sign; both ends of the chain count once.
_PKA = {"K": (10.8, 1), "R": (12.5, 1), "H": (6.5, 1), "D": (3.9, -1), "E": (4.1, -1), "C": (8.5, -1), "Y": (10.1, -1)}


def _charge(a: str | None, pka: float, sign: int, ph: float = 7.0) -> str:
    share = f"/ (1 + power(CAST(10 AS DOUBLE), CAST({(ph - pka) * sign} AS DOUBLE)))"
    return f"({sign} * {_COUNT(a) if a else 'CAST(1 AS DOUBLE)'} {share})"


SHARED["m3_net_charge"] = f"SELECT doc_id, round({' + '.join([_charge(a, *v) for a, v in _PKA.items()] + [_charge(None, 8.6, 1), _charge(None, 3.6, -1)])}, 6) AS net_charge FROM (SELECT doc_id, {_SEQ} AS s FROM {{documents}})"

DUAL = {
    "p1_select_except": ("SELECT * EXCEPT (text) FROM {documents}", "SELECT * EXCLUDE (text) FROM documents"),
    "p6_clamp_to_null": (
        "SELECT target_id, trial_id, CASE WHEN status_date BETWEEN DATE '1995-06-01' AND DATE '2001-09-30' THEN status_date END AS d FROM {events}",
        "SELECT target_id, trial_id, d FROM clean",
    ),
    "p9_numeric_name": (
        "SELECT c_custkey, CASE WHEN c_name RLIKE '^[0-9]+$' THEN concat('genus (taxon ', c_name, ')') ELSE c_name END AS organism FROM (SELECT c_custkey, regexp_replace(c_name, '[^0-9]', '') AS c_name FROM {customer})",
        "SELECT c_custkey, CASE WHEN regexp_matches(c_name, '^[0-9]+$') THEN concat('genus (taxon ', c_name, ')') ELSE c_name END AS organism FROM (SELECT c_custkey, regexp_replace(c_name, '[^0-9]', '', 'g') AS c_name FROM customer)",
    ),
    "j6_range_expansion": (
        "SELECT target_id, explode(sequence(0, least(max_stage, 7))) AS gate FROM {target_stage} WHERE max_stage IS NOT NULL",
        "SELECT target_id, gate FROM target_stage JOIN gates ON gate <= least(max_stage, 7) WHERE max_stage IS NOT NULL",
    ),
    "j7_cross_series": ("SELECT target_id, explode(sequence(0, 7)) AS gate FROM {targets}", "SELECT target_id, gate FROM targets CROSS JOIN gates"),
    "w6_running_product": (
        "SELECT target_id, transform(sequence(1, 8), k -> round(aggregate(slice(p, 1, k), 1.0D, (a, x) -> a * x), 9)) AS survival FROM (SELECT target_id, transform(array_sort(collect_list(struct(gate, coalesce(cluster_base_rate, 1.0D) AS r))), x -> x.r) AS p FROM {context} GROUP BY target_id)",
        "SELECT target_id, list(round(s, 9) ORDER BY gate) AS survival FROM (SELECT target_id, gate, product(coalesce(cluster_base_rate, 1.0::DOUBLE)) OVER (PARTITION BY target_id ORDER BY gate) AS s FROM context) GROUP BY target_id",
    ),
    "w7_argmax_first": (
        "SELECT target_id, cast(array_position(p, array_max(p)) - 1 AS INT) AS gate FROM (SELECT target_id, transform(array_sort(collect_list(struct(gate, n_precedents))), x -> x.n_precedents) AS p FROM {context} GROUP BY target_id)",
        "SELECT target_id, gate FROM (SELECT target_id, gate, row_number() OVER (PARTITION BY target_id ORDER BY n_precedents DESC, gate) AS rn FROM context) WHERE rn = 1",
    ),
    "g8_pivot_vector": (
        "SELECT target_id, transform(array_sort(collect_list(struct(gate, n_precedents))), x -> x.n_precedents) AS v FROM {context} GROUP BY target_id",
        "SELECT target_id, list(n_precedents ORDER BY gate) AS v FROM context GROUP BY target_id",
    ),
    "f3_extract_number": (
        "SELECT c_custkey, try_cast(nullif(regexp_extract(c_name, '([0-9]+)', 1), '') AS INT) AS n FROM {customer}",
        "SELECT c_custkey, try_cast(nullif(regexp_extract(c_name, '([0-9]+)', 1), '') AS INTEGER) AS n FROM customer",
    ),
    "f4_split_unnest": (
        "SELECT p_partkey, explode(split(p_name, ' ')) AS word FROM {part}",
        "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part",
    ),
    "f1_first_match": (
        "SELECT p_partkey, CASE WHEN p_name RLIKE '(?i)green|lime' THEN 'green' WHEN p_name RLIKE '(?i)red|rose' THEN 'red' WHEN p_type RLIKE '(?i)steel' THEN 'steel' ELSE 'other' END AS host, p_name RLIKE '(?i)blue' AS blue FROM {part}",
        "SELECT p_partkey, CASE WHEN regexp_matches(p_name, '(?i)green|lime') THEN 'green' WHEN regexp_matches(p_name, '(?i)red|rose') THEN 'red' WHEN regexp_matches(p_type, '(?i)steel') THEN 'steel' ELSE 'other' END AS host, regexp_matches(p_name, '(?i)blue') AS blue FROM part",
    ),
    "s6_is_nucleotide": (
        "SELECT doc_id, length(s) >= 12 AND length(regexp_replace(s, '[^ACGTUN]', '')) / CAST(length(s) AS DOUBLE) > 0.95D AS nucleotide FROM (SELECT doc_id, upper(text) AS s FROM {documents} WHERE text <> '')",
        "SELECT doc_id, length(s) >= 12 AND length(regexp_replace(s, '[^ACGTUN]', '', 'g')) / CAST(length(s) AS DOUBLE) > 0.95::DOUBLE AS nucleotide FROM (SELECT doc_id, upper(text) AS s FROM documents WHERE text <> '')",
    ),
    "s9_safe_int": (
        "SELECT c_custkey, try_cast(substr(c_name, 10, 20) AS INT) AS n FROM {customer}",
        "SELECT c_custkey, try_cast(substr(c_name, 10, 20) AS INTEGER) AS n FROM customer",
    ),
    "s10_prefix_key": (
        "SELECT c_custkey, substring_index(c_name, '#', 1) AS head FROM {customer}",
        "SELECT c_custkey, string_split(c_name, '#')[1] AS head FROM customer",
    ),
    "f6_last_element": (
        "SELECT p_partkey, trim(element_at(split(p_type, ' '), -1)) AS last_part FROM {part}",
        "SELECT p_partkey, trim(string_split(p_type, ' ')[-1]) AS last_part FROM part",
    ),
    "f7_ellipsis": (
        "SELECT doc_id, CASE WHEN length(text) > 140 THEN concat(rtrim(substr(text, 1, 137)), '...') ELSE text END AS short FROM {documents}",
        "SELECT doc_id, CASE WHEN length(text) > 140 THEN concat(rtrim(substr(text, 1, 137), ' '), '...') ELSE text END AS short FROM documents",
    ),
    "f9_clean_sequence": (
        "SELECT doc_id, upper(regexp_replace(text, '[^A-Za-z]', '')) AS s FROM {documents}",
        "SELECT doc_id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS s FROM documents",
    ),
    "f10_scoreable": (
        f"SELECT doc_id, n >= 20 AS scoreable FROM (SELECT doc_id, length(regexp_replace({_SEQ}, '[^{_STD}]', '')) AS n FROM {{documents}})",
        f"SELECT doc_id, n >= 20 AS scoreable FROM (SELECT doc_id, length(regexp_replace({_SEQ}, '[^{_STD}]', '', 'g')) AS n FROM documents)",
    ),
    "f13_shingles": (
        "SELECT item_id, size(array_distinct(CASE WHEN size(w) < 4 THEN array() ELSE transform(sequence(1, size(w) - 3), i -> array_join(slice(w, i, 4), ' ')) END)) AS n FROM (SELECT item_id, regexp_extract_all(lower(text), '([a-z0-9.%]+)', 1) AS w FROM {benchmark})",
        "SELECT item_id, CAST(len(list_distinct(list_transform(range(1, greatest(len(w) - 2, 1)), lambda i: array_to_string(w[i:i+3], ' ')))) AS INTEGER) AS n FROM (SELECT item_id, regexp_extract_all(lower(text), '([a-z0-9.%]+)', 1) AS w FROM benchmark)",
    ),
    "s4_longest_pick": (
        "SELECT target_id, max_by(name, struct(length(name), -trial_id, name)) AS name FROM {trials} GROUP BY target_id",
        "SELECT target_id, name FROM (SELECT target_id, name, row_number() OVER (PARTITION BY target_id ORDER BY length(name) DESC, trial_id, name DESC) AS rn FROM trials) WHERE rn = 1",
    ),
    "s12_first_source_wins": (
        "SELECT id, source FROM (SELECT id, source, row_number() OVER (PARTITION BY id ORDER BY pr) AS rn FROM (SELECT o_orderkey AS id, 'csv' AS source, 1 AS pr FROM {orders} WHERE o_orderstatus = 'F' UNION ALL SELECT target_id, 'reference', 2 FROM {targets})) WHERE rn = 1",
        "SELECT id, source FROM (SELECT id, source, row_number() OVER (PARTITION BY id ORDER BY pr) AS rn FROM (SELECT o_orderkey AS id, 'csv' AS source, 1 AS pr FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT target_id, 'reference', 2 FROM targets)) WHERE rn = 1",
    ),
    "u3_set_difference": (
        "SELECT p_partkey, array_sort(array_except(split(p_name, ' '), split(lower(p_type), ' '))) AS left_words FROM {part}",
        "SELECT p_partkey, list_sort(list_distinct(list_filter(string_split(p_name, ' '), lambda x: NOT list_contains(string_split(lower(p_type), ' '), x)))) AS left_words FROM part",
    ),
    "f11_identifiers": (
        "SELECT doc_id, size(array_distinct(regexp_extract_all(text, '([A-Z][a-z]+[0-9]+|[0-9][0-9][0-9][0-9]+)', 1))) AS n FROM {documents}",
        "SELECT doc_id, CAST(len(list_distinct(regexp_extract_all(text, '([A-Z][a-z]+[0-9]+|[0-9][0-9][0-9][0-9]+)', 1))) AS INTEGER) AS n FROM documents",
    ),
    "f14_jaccard": (
        "SELECT a.item_id AS a_id, b.item_id AS b_id, round(size(array_intersect(a.w, b.w)) / CAST(size(array_union(a.w, b.w)) AS DOUBLE), 6) AS jaccard FROM (SELECT item_id, array_distinct(split(lower(text), ' ')) AS w FROM {benchmark}) a JOIN (SELECT item_id, array_distinct(split(lower(text), ' ')) AS w FROM {benchmark}) b ON a.item_id + 1 = b.item_id",
        "SELECT a.item_id AS a_id, b.item_id AS b_id, round(len(list_intersect(a.w, b.w)) / CAST(len(list_distinct(list_concat(a.w, b.w))) AS DOUBLE), 6) AS jaccard FROM (SELECT item_id, list_distinct(string_split(lower(text), ' ')) AS w FROM benchmark) a JOIN (SELECT item_id, list_distinct(string_split(lower(text), ' ')) AS w FROM benchmark) b ON a.item_id + 1 = b.item_id",
    ),
    "f15_nearest_in_corpus": (
        """SELECT item_id, round(max(n / CAST(ka + kb - n AS DOUBLE)), 6) AS nearest FROM (SELECT a.item_id, a.k AS ka, b.k AS kb, b.item_id AS other, count(*) AS n FROM
        (SELECT item_id, size(s) AS k, explode(s) AS g FROM (SELECT item_id, array_distinct(split(lower(text), ' ')) AS s FROM {benchmark})) a JOIN
        (SELECT item_id, size(s) AS k, explode(s) AS g FROM (SELECT item_id, array_distinct(split(lower(text), ' ')) AS s FROM {benchmark})) b ON a.g = b.g AND a.item_id <> b.item_id GROUP BY 1, 2, 3, 4) GROUP BY item_id""",
        """SELECT item_id, round(max(n / CAST(ka + kb - n AS DOUBLE)), 6) AS nearest FROM (SELECT a.item_id, a.k AS ka, b.k AS kb, b.item_id AS other, count(*) AS n FROM
        (SELECT item_id, len(s) AS k, unnest(s) AS g FROM (SELECT item_id, list_distinct(string_split(lower(text), ' ')) AS s FROM benchmark)) a JOIN
        (SELECT item_id, len(s) AS k, unnest(s) AS g FROM (SELECT item_id, list_distinct(string_split(lower(text), ' ')) AS s FROM benchmark)) b ON a.g = b.g AND a.item_id <> b.item_id GROUP BY 1, 2, 3, 4) GROUP BY item_id""",
    ),
    "f16_list_join": (
        "SELECT centre, CASE WHEN size(w) = 1 THEN w[0] WHEN size(w) = 2 THEN concat(w[0], ' and ', w[1]) ELSE concat(array_join(slice(w, 1, size(w) - 1), ', '), ', and ', element_at(w, -1)) END AS said FROM (SELECT centre, array_sort(collect_set(organism)) AS w FROM {targets} GROUP BY centre)",
        "SELECT centre, CASE WHEN len(w) = 1 THEN w[1] WHEN len(w) = 2 THEN concat(w[1], ' and ', w[2]) ELSE concat(array_to_string(w[:-2], ', '), ', and ', w[-1]) END AS said FROM (SELECT centre, list_sort(list_distinct(list(organism))) AS w FROM targets GROUP BY centre)",
    ),
}
