"""Forecast, retrieval and corpus queries as SQL over the model's frames, in the manner of portable."""

from __future__ import annotations

from stagewise.bridge import LADDER
from stagewise.plans import terms

D = lambda x: f"CAST({x} AS DOUBLE)"
S = lambda x: f"CAST({x} AS STRING)"


def stage(c: str) -> str:
    return f"CASE {c} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(LADDER)) + " END"


def step(c: str) -> str:
    return f"CASE {c} " + " ".join(f"WHEN {k} THEN '{LADDER[k]} -> {LADDER[k + 1]}'" for k in range(8)) + " END"


def pct(c: str) -> str:
    return f"{S(f'CAST(floor(100 * {c} + {D(0.5)}) AS INT)')} || '%'"


def two(c: str) -> str:
    """A number of 0..1 with two decimals; halves go up."""
    n = f"CAST(floor(100 * {c} + {D(0.5)}) AS INT)"
    return f"{S(f'CAST(floor({n} / {D(100)}) AS INT)')} || '.' || lpad({S(f'{n} % 100')}, 2, '0')"


_P = f"greatest({D(0.01)}, least({D(0.99)}, (n_precedents_cleared + 5 * {D(0.5)}) / (n_precedents + 5)))"
# Conditional chance of each gate, the chance to be alive after it, what each gate loses, and both rules for the weakest gate.
_CONDITIONAL = f"SELECT target_id, {', '.join(f'max(CASE WHEN gate = {g} THEN {_P} END) AS p{g}' for g in range(8))} FROM {{context}} GROUP BY target_id"
_SURVIVAL = f"SELECT *, {', '.join(' * '.join(f'p{i}' for i in range(g + 1)) + f' AS s{g}' for g in range(8))} FROM ({_CONDITIONAL})"
_DROPS = f"SELECT *, {', '.join(f'{D(1) if g == 0 else f"s{g - 1}"} - s{g} AS d{g}' for g in range(8))} FROM ({_SURVIVAL})"
_MOST = f"greatest({', '.join(f'd{g}' for g in range(8))})"
_LEAST = f"least({', '.join(f'p{g}' for g in range(8))})"
_first = lambda c, best: "CASE " + " ".join(f"WHEN {c}{g} = {best} THEN {g}" for g in range(8)) + " END"
FORECAST = f"SELECT *, {_first('d', _MOST)} AS wall, {_first('p', _LEAST)} AS lowest FROM ({_DROPS})"

# X8 and F22: what the retrieved relatives say, for each query.
_USABLE = "NOT censored AND max_stage IS NOT NULL"
_PER_GATE = ", ".join(f"count(*) FILTER (WHERE {_USABLE} AND max_stage >= {g}) AS entered_{g}, count(*) FILTER (WHERE {_USABLE} AND max_stage > {g}) AS cleared_{g}" for g in range(8))
REQUEST = f"""SELECT query_id, count(*) AS n_hits, count(*) FILTER (WHERE {_USABLE}) AS n_precedents, count(*) FILTER (WHERE NOT censored AND identity >= {D(0.7)}) AS n_close, count(*) FILTER (WHERE censored) AS n_censored,
    max(identity) AS closest_identity, count(*) FILTER (WHERE {_USABLE} AND max_stage >= 8) AS n_deposited, {_PER_GATE} FROM {{relatives}} GROUP BY query_id"""
_STRENGTH = "CASE WHEN n_precedents >= 20 AND n_close >= 3 THEN 'STRONG' WHEN n_precedents >= 5 THEN 'MODERATE' WHEN n_precedents >= 1 THEN 'WEAK' ELSE 'NONE' END"

_AT = f"SELECT r.*, least(coalesce(q.max_stage, 0), 7) AS gate FROM {{relatives}} r JOIN {{splits}} q ON q.target_id = r.query_id"
_COUNTS = f"""SELECT query_id, gate, count(*) AS n_all, count(*) FILTER (WHERE censored) AS n_cens, count(*) FILTER (WHERE {_USABLE}) AS n_live,
    count(*) FILTER (WHERE {_USABLE} AND max_stage >= gate) AS entered, count(*) FILTER (WHERE {_USABLE} AND max_stage > gate) AS cleared FROM ({_AT}) GROUP BY query_id, gate"""
_FURTHEST = f"SELECT query_id, target_id AS far_id, max_stage AS far_stage FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY max_stage DESC, target_id) AS k FROM {{relatives}} WHERE {_USABLE}) WHERE k = 1"
_REASONS = f"""SELECT query_id, reason, n AS n_reason FROM (SELECT query_id, reason, n, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, reason) AS k FROM (
    SELECT a.query_id, lower(e.status_raw) AS reason, count(*) AS n FROM ({_AT}) a JOIN {{canon}} e ON e.target_id = a.target_id
    WHERE NOT a.censored AND a.max_stage = a.gate AND e.terminal AND e.status_raw <> 'RO3' GROUP BY a.query_id, lower(e.status_raw))) WHERE k = 1"""
_KINDS = f"""SELECT r.query_id, max(CASE WHEN t.kind LIKE '%BRASS' THEN e.stage_ord END) AS whole, max(CASE WHEN t.kind NOT LIKE '%BRASS' THEN e.stage_ord END) AS part FROM {{relatives}} r
    JOIN (SELECT target_id, trial_id, min(kind) AS kind FROM {{trials}} GROUP BY target_id, trial_id) t ON t.target_id = r.target_id
    JOIN {{canon}} e ON e.target_id = t.target_id AND e.trial_id = t.trial_id WHERE NOT r.censored AND r.max_stage IS NOT NULL GROUP BY r.query_id"""
FACTS = f"""SELECT c.query_id, c.gate,
    CASE WHEN entered = 1 THEN 'The one close relative that reached ' || {stage('c.gate')} || CASE WHEN cleared = 1 THEN ' got' ELSE ' did not get' END || ' through to ' || {stage('c.gate + 1')} || '.'
      WHEN entered > 0 THEN CASE WHEN cleared = 0 THEN 'None' ELSE {S('cleared')} END || ' of the ' || {S('entered')} || ' close relatives that reached ' || {stage('c.gate')} || ' got through to ' || {stage('c.gate + 1')} || '.'
      WHEN n_live > 0 THEN 'None of the close relatives reached ' || {stage('c.gate')} || '; the furthest, ' || {S('f.far_id')} || ', stopped at ' || {stage('f.far_stage')} || '.' END AS clearance,
    'Where relatives stopped at ' || {stage('c.gate')} || ', the reason most often recorded was "' || m.reason || '" (' || {S('m.n_reason')} || CASE WHEN m.n_reason = 1 THEN ' trial).' ELSE ' trials).' END AS stop_reason,
    CASE WHEN k.whole > k.part THEN 'Full-length constructs got further (' || {stage('k.whole')} || ') than truncated ones (' || {stage('k.part')} || ').'
      WHEN k.whole < k.part THEN 'Truncated constructs got further (' || {stage('k.part')} || ') than full-length ones (' || {stage('k.whole')} || ').' END AS constructs,
    CASE WHEN n_cens > 0 THEN {S('n_cens')} || ' of the ' || {S('n_all')} || ' relatives found ' || CASE WHEN n_cens = 1 THEN 'was' ELSE 'were' END || ' closed without a result and left out of these counts.' END AS censored_note
    FROM ({_COUNTS}) c LEFT JOIN ({_FURTHEST}) f ON f.query_id = c.query_id LEFT JOIN ({_REASONS}) m ON m.query_id = c.query_id LEFT JOIN ({_KINDS}) k ON k.query_id = c.query_id"""

# G6, G9, G10: text blocks and records. A target's phrasing follows its id, so that reruns agree.
_FORECAST_LINES = " || ".join(f"'  {LADDER[g]} -> {LADDER[g + 1]}: ' || {two(f'p{g}')} || ' conditional, ' || {two(f's{g}')} || ' cumulative' || chr(10)" for g in range(8))
FORECAST_BLOCK = f"SELECT target_id, wall, 'Model forecast (these numbers are fixed):' || chr(10) || {_FORECAST_LINES} || '  weakest point: ' || {step('wall')} || ' (largest loss of survival)' AS block FROM ({FORECAST})"
_ROW = f"'  ' || rpad({S('target_id')}, CAST(greatest(19, length({S('target_id')})) AS INT), ' ') || ' ' || rpad(centre, CAST(greatest(9, length(centre)) AS INT), ' ') || ' ' || rpad(organism, CAST(greatest(31, length(organism)) AS INT), ' ') || ' ' || CASE WHEN censored THEN rpad(coalesce({stage('max_stage')}, 'unknown'), 16, ' ') || ' censored at centre closure' ELSE coalesce({stage('max_stage')}, 'unknown') END"
_ROWS = f"SELECT query_id, {', '.join(f'max(CASE WHEN rn = {k} THEN {_ROW} END) AS r{k}' for k in range(1, 9))}, count(*) FILTER (WHERE rn <= 8 AND censored) AS shown_cens, count(*) FILTER (WHERE rn <= 8) AS shown FROM {{relatives}} GROUP BY query_id"
_TABLE = "coalesce(r1, '  (no precedent within 30% identity)') || " + " || ".join(f"coalesce(chr(10) || r{k}, '')" for k in range(2, 9))
_EVIDENCE = f"""'  ' || {S('f.n_cluster_precedents')} || ' uncensored precedents in the family, ' || {S('f.n_close_precedents')} || ' close ones' || coalesce(chr(10) || '  ' || {pct('f.cluster_censored_frac')} || ' of the family is censored', '')
    || chr(10) || '  evidence strength: ' || CASE WHEN f.strength = 'NONE' THEN 'WEAK' ELSE f.strength END"""
BLOCKS = f"""SELECT t.target_id, '  length: ' || {S('t.seq_len')} || ' residues' || chr(10) || '  organism: ' || t.organism || chr(10) || '  centre: ' || t.centre AS features, {_TABLE} AS precedents, {_EVIDENCE} AS evidence,
    p.block AS forecast, p.wall, f.strength, coalesce(r.shown, 0) AS shown, coalesce(r.shown_cens, 0) AS shown_cens, s.split_cluster, s.split_temporal, s.censored, s.max_stage
    FROM {{targets}} t JOIN {{splits}} s ON s.target_id = t.target_id JOIN {{cluster_features}} f ON f.target_id = t.target_id JOIN ({FORECAST_BLOCK}) p ON p.target_id = t.target_id LEFT JOIN ({_ROWS}) r ON r.query_id = t.target_id"""
_CITED = f"""SELECT a.query_id, max(CASE WHEN same_k = 1 AND at_wall THEN target_id END) AS same_id, max(CASE WHEN far_k = 1 THEN target_id END) AS far_id, max(CASE WHEN far_k = 1 THEN max_stage END) AS far_stage FROM (
    SELECT r.query_id, r.target_id, r.max_stage, r.max_stage = w.wall AS at_wall, row_number() OVER (PARTITION BY r.query_id, r.max_stage = w.wall ORDER BY r.rn) AS same_k, row_number() OVER (PARTITION BY r.query_id ORDER BY r.max_stage DESC, r.rn) AS far_k
    FROM {{relatives}} r JOIN ({FORECAST}) w ON w.target_id = r.query_id WHERE r.rn <= 8 AND NOT r.censored AND r.max_stage IS NOT NULL) a GROUP BY a.query_id"""
NARRATIVE = f"""SELECT b.target_id, b.wall, CASE b.target_id % 3 WHEN 0 THEN 'The forecast puts the main risk at ' WHEN 1 THEN 'The weakest point is ' ELSE 'If it stalls, it is most likely at ' END || {step('b.wall')} || '. '
    || CASE WHEN b.shown = 0 THEN 'There is no precedent for this family.' WHEN c.query_id IS NULL THEN 'The ' || {S('b.shown')} || ' precedents shown are all censored and say nothing either way.'
      WHEN c.same_id IS NOT NULL THEN {S('c.same_id')} || ' stopped at exactly this point.' WHEN c.far_stage > b.wall THEN 'It can be passed: ' || {S('c.far_id')} || ' reached ' || {stage('c.far_stage')} || '.'
      ELSE 'No uncensored precedent came this far; the furthest, ' || {S('c.far_id')} || ', stopped at ' || {stage('c.far_stage')} || '.' END
    || CASE b.strength WHEN 'STRONG' THEN ' The evidence is strong enough to take seriously.' WHEN 'MODERATE' THEN ' The evidence is moderate.' ELSE ' The evidence is thin.' END
    || CASE WHEN b.shown_cens = 0 THEN '' WHEN b.shown_cens = 1 THEN ' One of the precedents shown is censored.' ELSE ' ' || {S('b.shown_cens')} || ' of the precedents shown are censored.' END AS story
    FROM ({BLOCKS}) b LEFT JOIN ({_CITED}) c ON c.query_id = b.target_id"""
_TASKS = f"""SELECT b.target_id, b.split_cluster, b.split_temporal, k.task, b.features, b.evidence, b.precedents, b.forecast, n.story, b.max_stage FROM ({BLOCKS}) b JOIN ({NARRATIVE}) n ON n.target_id = b.target_id
    JOIN (SELECT 'pipeline_forecast' AS task, 0 AS from_stage, 8 AS to_stage UNION ALL SELECT 'gate_judgement', 0, 7 UNION ALL SELECT 'failure_attribution', 0, 3) k ON b.max_stage BETWEEN k.from_stage AND k.to_stage
    WHERE NOT (k.task = 'failure_attribution' AND b.censored)"""
RECORDS = f"""SELECT target_id, task, split_cluster, split_temporal, 'You judge how far a target will come.' AS system_text,
    CASE task WHEN 'pipeline_forecast' THEN 'Where will this target stop?' WHEN 'gate_judgement' THEN 'Will this target pass its next step?' ELSE 'This target stopped at ' || {stage('max_stage')} || '. Why?' END
    || chr(10) || chr(10) || 'Target features:' || chr(10) || features || chr(10) || chr(10) || 'Archive evidence:' || chr(10) || evidence || chr(10) || chr(10) || 'Precedents:' || chr(10) || precedents
    || CASE WHEN task = 'failure_attribution' THEN '' ELSE chr(10) || chr(10) || forecast END AS user_text, story AS assistant_text FROM ({_TASKS})"""
_ORDER = lambda split: f"SELECT target_id, task, row_number() OVER (PARTITION BY task ORDER BY md5({S('target_id')}), target_id) AS k FROM ({RECORDS}) WHERE {split}"
_TEMPORAL = "split_temporal = 'test'"
_SHARES = "CASE task WHEN 'pipeline_forecast' THEN 90 WHEN 'gate_judgement' THEN 80 ELSE 30 END"

_RANKED = f"""SELECT cluster_id, target_id, max_stage, censored, row_number() OVER (PARTITION BY cluster_id ORDER BY censored, coalesce(max_stage, 0) DESC, pos) AS place, count(*) OVER (PARTITION BY cluster_id) AS shown FROM (
    SELECT cluster_id, target_id, max_stage, censored, row_number() OVER (PARTITION BY cluster_id ORDER BY target_id) AS pos FROM {{splits}} WHERE max_stage IS NOT NULL) WHERE pos <= 6"""
RANKING = f"""SELECT r.cluster_id, t.target_id AS top_id, r.at_top, r.n_cens, CASE WHEN r.at_top = 1 THEN {S('t.target_id')} || ' is the strongest: the only one in this set to reach ' || {stage('t.max_stage')} || '.'
    ELSE {S('t.target_id')} || ' ranks first of the ' || {S('r.at_top')} || ' candidates that reached ' || {stage('t.max_stage')} || '.' END AS lead FROM (
    SELECT a.cluster_id, count(*) FILTER (WHERE a.max_stage = b.max_stage) AS at_top, count(*) FILTER (WHERE a.censored) AS n_cens FROM ({_RANKED}) a JOIN ({_RANKED}) b ON b.cluster_id = a.cluster_id AND b.place = 1 GROUP BY a.cluster_id) r
    JOIN ({_RANKED}) t ON t.cluster_id = r.cluster_id AND t.place = 1 WHERE t.shown >= 3"""

_HELD = "split_temporal = 'test' AND NOT censored AND max_stage < 8"
_MAJORITY = "SELECT max_stage AS pick FROM {splits} WHERE split_temporal = 'train' AND NOT censored AND max_stage < 8 GROUP BY max_stage ORDER BY count(*) DESC, max_stage LIMIT 1"
_hit = lambda name, pick: f"SELECT '{name}' AS contender, count(*) AS n, count(*) FILTER (WHERE {pick} = max_stage) AS hits FROM (SELECT s.target_id, s.max_stage, f.wall, f.lowest, m.pick FROM {{splits}} s JOIN ({FORECAST}) f ON f.target_id = s.target_id CROSS JOIN ({_MAJORITY}) m WHERE {_HELD.replace('split_temporal', 's.split_temporal').replace('censored', 's.censored').replace('max_stage', 's.max_stage')})"

SHARED = {
    "b6_forecast": f"SELECT target_id, wall, lowest, {', '.join(f'round(p{g}, 6) AS p{g}, round(s{g}, 6) AS s{g}' for g in range(8))} FROM ({FORECAST})",
    "b8_forecast_payload": f"""SELECT f.target_id, chr(123) || '"target":' || {S('f.target_id')} || ',"centre":"' || t.centre || '","conditional":[' || {" || ',' || ".join(two(f'f.p{g}') for g in range(8))} || '],"survival":[' || {" || ',' || ".join(two(f'f.s{g}') for g in range(8))}
        || '],"bottleneck":' || chr(123) || '"gate":' || {S('f.wall')} || ',"step":"' || {step('f.wall')} || '"' || chr(125) || ',"strength":"' || c.strength || '"' || chr(125) AS payload FROM ({FORECAST}) f JOIN {{targets}} t ON t.target_id = f.target_id JOIN {{cluster_features}} c ON c.target_id = f.target_id""",
    "x8_request_context": f"SELECT *, CASE WHEN n_close > 0 THEN {D(0.7)} WHEN n_precedents > 0 THEN {D(0.3)} ELSE {D(0)} END AS band, round({D('n_censored')} / n_hits, 6) AS censored_frac, CASE WHEN n_precedents > 0 THEN round({D('n_deposited')} / n_precedents, 6) END AS deposit_rate, {_STRENGTH} AS strength FROM ({REQUEST})",
    "f22_relative_facts": FACTS,
    "g7_orthologue_ranking": RANKING,
    "g9_text_blocks": f"SELECT target_id, features, precedents, evidence, forecast FROM ({BLOCKS})",
    "g10_narrative": NARRATIVE,
    "g6_chat_records": RECORDS,
    "g11_held_out_sets": " UNION ALL ".join(f"SELECT '{name}' AS set_name, target_id, task, CAST(k AS INT) AS k FROM ({_ORDER(where)}) WHERE k <= {_SHARES}" for name, where in (("valid", "split_cluster = 'valid'"), ("test", "split_cluster = 'test'"), ("test_temporal", "split_temporal = 'test'"))),
    "g13_round_robin": f"SELECT task, target_id FROM ({_ORDER(_TEMPORAL)}) ORDER BY k, task LIMIT 40",
    "m16_contenders": " UNION ALL ".join(_hit(name, pick) for name, pick in (("majority", "pick"), ("lowest", "lowest"), ("largest_drop", "wall"))),
    "f5_text_blob": "SELECT p_partkey, coalesce(p_name, '') || ' ' || coalesce(p_type, '') || ' ' || coalesce(p_brand, '') AS blob FROM {part}",
    "s20_fill_blank": "SELECT o.o_orderkey, coalesce(nullif(trim(CASE WHEN o.o_orderstatus = 'F' THEN '  ' ELSE o.o_orderpriority END), ''), c.c_mktsegment) AS method FROM {orders} o LEFT JOIN {customer} c ON c.c_custkey = o.o_custkey",
    "b15_choice_map": "SELECT p_partkey, CASE p_size % 7 WHEN 0 THEN 'ecoli' WHEN 1 THEN 'ecoli' WHEN 2 THEN 'ecoli' WHEN 3 THEN 'cell_free' WHEN 4 THEN 'insect' WHEN 5 THEN 'mammalian' ELSE 'yeast' END AS host, p_size % 7 = 2 AS cold_shock FROM {part}",
}

_PROTOCOL = """(SELECT p_partkey, p_name || CASE p_size % 8 WHEN 0 THEN ' grown in BL21(DE3) with IPTG' WHEN 1 THEN ' Sf9 cells, hexahistidine' WHEN 2 THEN ' Arctic Express at 12 C, MBP, TEV site' WHEN 3 THEN ' cell-free, strep-tag'
    WHEN 4 THEN ' auto-induction, SeMet, GST and thrombin' WHEN 5 THEN ' refolded from inclusion bodies, His6' WHEN 6 THEN ' HEK293, DDM detergent, SUMO' ELSE '' END AS t FROM %s)"""
_TYPED = "(SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN '>sp|' || p_name WHEN 1 THEN 'P0A6Y8' WHEN 2 THEN CASE WHEN p_size % 2 = 0 THEN '4XB7_A' ELSE '4XB7_ABCDEFG' END WHEN 3 THEN 'mkvlaaglck mkvlaaglck ' || upper(substr(p_brand, 1, 1)) ELSE p_name END AS t FROM %s)"
_WRITTEN = """(SELECT p_partkey, 'Weakest point: ' || CASE p_size % 3 WHEN 0 THEN 'soluble -> purified' WHEN 1 THEN 'cloned (easy)' ELSE 'nowhere' END || '. Text.' || chr(10) || 'selected -> cloned: 0.91 conditional, x' || chr(10) || p_name || chr(10) || 'Probability of success: 0.2 or so' || chr(10) || 'end' AS t FROM %s)"""
_LINES = r"(?m)^\s*\w[\w ]*->[\w ]*:\s*[0-9.]+\s*conditional.*$"
_PROBS = r"(?m)^\s*(Gate-by-gate outlook:|Probability of [^:]+:\s*[0-9.]+).*$"
_WALL = r"(?:Predicted bottleneck|Weakest point):\s*([\w ]+?)\s*(?:->|\(|\.|$)"
_LIST = ", ".join(f"'{x}'" for x in LADDER)


def _stripped(e: str) -> str:
    return "trim(" + terms.replace(e, terms.replace(e, terms.replace(e, "t", _LINES, ""), _PROBS, ""), r"\n\n\n+", "\n\n") + ")"


def _fasta(e: str) -> str:
    body = "CASE WHEN t LIKE '>%' THEN substr(t, instr(t, chr(10)) + 1) ELSE t END"
    seq = terms.replace(e, f"upper({body})", "[^ACDEFGHIKLMNPQRSTVWYBXZUO]", "")
    head = "CASE WHEN t LIKE '>%' THEN trim(" + ("element_at(split(substr(t, 2, instr(t, chr(10)) - 2), '[|]'), -1)" if e == "spark" else "string_split(substr(t, 2, instr(t, chr(10)) - 2), '|')[-1]") + ") ELSE '' END"
    std = terms.replace(e, "s", "[^ACDEFGHIKLMNPQRSTVWY]", "")
    return f"""SELECT p_partkey, name, s AS sequence, length({std}) >= 20 AS scoreable, CASE WHEN length(s) > 0 AND (length(s) - length({std})) / {D('length(s)')} > {D(0.2)} THEN 'mostly placeholders' ELSE '' END AS warning FROM (SELECT p_partkey, {head} AS name, {seq} AS s FROM
        (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN '>sp|' || p_brand || '|' || p_name || chr(10) ELSE '' END || p_type || chr(10) || p_name AS t FROM {'{part}' if e == 'spark' else 'part'}))"""


DUAL = {
    "f2_protocol_flags": (f"SELECT p_partkey, {terms.protocol_terms('spark', 't')} FROM {_PROTOCOL.replace('%s', '{part}')}", f"SELECT p_partkey, {terms.protocol_terms('duck', 't')} FROM {_PROTOCOL.replace('%s', 'part')}"),
    "f8_sniff": (f"SELECT p_partkey, {terms.sniff('spark', 't')} AS kind FROM {_TYPED.replace('%s', '{part}')}", f"SELECT p_partkey, {terms.sniff('duck', 't')} AS kind FROM {_TYPED.replace('%s', 'part')}"),
    "f12_strip_numbers": (f"SELECT p_partkey, {_stripped('spark')} AS kept FROM {_WRITTEN.replace('%s', '{part}')}", f"SELECT p_partkey, {_stripped('duck')} AS kept FROM {_WRITTEN.replace('%s', 'part')}"),
    "f23_resolve_fasta": (_fasta("spark"), _fasta("duck")),
    "f24_stated_wall": (
        f"SELECT p_partkey, said, CAST(nullif(array_position(array({_LIST}), said), 0) - 1 AS INT) AS gate FROM (SELECT p_partkey, lower(regexp_extract(t, r'{_WALL}', 1)) AS said FROM {_WRITTEN.replace('%s', '{part}')})",
        f"SELECT p_partkey, said, CAST(nullif(coalesce(list_position([{_LIST}], said), 0), 0) - 1 AS INTEGER) AS gate FROM (SELECT p_partkey, lower(regexp_extract(t, '{_WALL}', 1)) AS said FROM {_WRITTEN.replace('%s', 'part')})",
    ),
    "f21_caveats": (
        "SELECT target_id, filter(array(CASE WHEN n_cluster_precedents = 0 THEN 'no precedent' WHEN n_cluster_precedents < 5 THEN 'few precedents' END, CASE WHEN n_cluster_precedents > 0 AND n_close_precedents = 0 THEN 'distant relatives only' END, CASE WHEN cluster_censored_frac > 0 THEN 'censored relatives' END), x -> x IS NOT NULL) AS caveats FROM {cluster_features}",
        "SELECT target_id, list_filter([CASE WHEN n_cluster_precedents = 0 THEN 'no precedent' WHEN n_cluster_precedents < 5 THEN 'few precedents' END, CASE WHEN n_cluster_precedents > 0 AND n_close_precedents = 0 THEN 'distant relatives only' END, CASE WHEN cluster_censored_frac > 0 THEN 'censored relatives' END], lambda x: x IS NOT NULL) AS caveats FROM cluster_features",
    ),
    "s21_reference_lists": (
        "SELECT target_id, array_join(array_sort(array_distinct(transform(filter(split(refs, '[|]'), x -> x RLIKE '(?i)^pdb:[0-9a-z]+$'), x -> upper(substr(x, 5))))), '|') AS pdb_ids FROM (SELECT target_id, 'pdb:' || substr(seq_md5, 1, 4) || '|go:7|PDB:1abc|bad' AS refs FROM {targets})",
        "SELECT target_id, array_to_string(list_sort(list_distinct(list_transform(list_filter(string_split(refs, '|'), lambda x: regexp_matches(x, '(?i)^pdb:[0-9a-z]+$')), lambda x: upper(substr(x, 5))))), '|') AS pdb_ids FROM (SELECT target_id, 'pdb:' || substr(seq_md5, 1, 4) || '|go:7|PDB:1abc|bad' AS refs FROM targets)",
    ),
    "s5_chemistry_pick": (
        """SELECT target_id, coalesce(get(filter(q, x -> x.kind LIKE '%BRASS' AND NOT x.nt), 0).s, get(filter(q, x -> NOT x.nt), 0).s, q[0].s) AS protein, coalesce(get(filter(q, x -> x.nt), 0).s, '') AS dna FROM (SELECT target_id, array_sort(collect_list(struct(trial_id, s, kind, s LIKE 'A%' AS nt))) AS q
            FROM (SELECT target_id, trial_id, kind, CASE WHEN size % 3 = 0 THEN 'ACGTACGTACGT' ELSE upper(name) END AS s FROM {trials}) GROUP BY target_id)""",
        """SELECT target_id, coalesce(list_filter(q, lambda x: x.kind LIKE '%BRASS' AND NOT x.nt)[1].s, list_filter(q, lambda x: NOT x.nt)[1].s, q[1].s) AS protein, coalesce(list_filter(q, lambda x: x.nt)[1].s, '') AS dna FROM (SELECT target_id, list_sort(list({'trial_id': trial_id, 's': s, 'kind': kind, 'nt': s LIKE 'A%'})) AS q
            FROM (SELECT target_id, trial_id, kind, CASE WHEN size % 3 = 0 THEN 'ACGTACGTACGT' ELSE upper(name) END AS s FROM trials) GROUP BY target_id)""",
    ),
}

#: X8 and F22 over all relatives: their texts with the parts over {relatives} (a bounded head) replaced by frames made from whole families.
WHOLE = {
    "x8_request_context": SHARED["x8_request_context"].replace(f"({REQUEST})", "{request_counts}"),
    "f22_relative_facts": FACTS.replace(f"({_COUNTS})", "{fact_counts}").replace(f"({_FURTHEST})", "{furthest}").replace(f"({_REASONS})", "{stop_reasons}").replace(f"({_KINDS})", "{construct_stages}"),
}
